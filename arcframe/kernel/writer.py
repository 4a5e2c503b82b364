"""Record bytes of a written archive."""

from __future__ import annotations

import struct
import zlib

from ..vocabulary import DEFLATE, DESCRIPTOR, ENCRYPTED, MADE_BY, STORE, STRONG, UTF8, ZipFault

_MOST = 0xFFFFFFFE  # larger values go to Zip64 fields


def compress(data: bytes, method: str, level: int, codecs: dict) -> tuple[int, bytes, int]:
    """(method id, payload, crc): deflate unless it is asked not to, has nothing to do, or doesn't shrink the data."""
    crc = zlib.crc32(data)
    if method not in ("store", "deflate"):
        raise ZipFault("ZIP_INVALID_OPTION", f"method {method!r}")
    if method == "deflate" and data:
        packed = codecs[DEFLATE].compress(data, level)
        if len(packed) < len(data):
            return DEFLATE, packed, crc
    return STORE, data, crc


def extra_block(fields: list[tuple[int, bytes]]) -> bytes:
    return b"".join(struct.pack("<2H", i, len(d)) + bytes(d) for i, d in fields)


def _large(*values: int | None) -> bytes:
    data = b"".join(struct.pack("<Q", v) for v in values if v is not None)
    return struct.pack("<2H", 1, len(data)) + data if data else b""


def local_header(e: dict) -> bytes:
    """``layout``: buffered, descriptor (sizes follow the payload) or descriptor64."""
    hidden, hidden64 = e["layout"] != "buffered", e["layout"] == "descriptor64"
    large = hidden64 or not hidden and max(e["csize"], e["usize"]) > _MOST
    sizes = _large(0, 0) if hidden64 else _large(e["usize"], e["csize"]) if large else b""
    extra = sizes + e["extra"]
    csize, usize = (0xFFFFFFFF, 0xFFFFFFFF) if large else (0, 0) if hidden else (e["csize"], e["usize"])
    return struct.pack("<4s5H3L2H", b"PK\x03\x04", max(45 if large else 20, e["needed"]), e["flags"], e["method"], e["dos_time"], e["dos_date"], 0 if hidden else e["crc"], csize, usize, len(e["name"]), len(extra)) + e["name"] + extra


def descriptor(e: dict) -> bytes:
    if e["layout"] == "buffered":
        return b""
    if e["layout"] == "descriptor" and max(e["csize"], e["usize"]) > _MOST:
        raise ZipFault("ZIP_UNSUPPORTED_ZIP64_STREAMING", "over 4 GiB in the classic streaming layout", feature="zip64-streaming")
    return struct.pack("<4s3L" if e["layout"] == "descriptor" else "<4sLQQ", b"PK\x07\x08", e["crc"], e["csize"], e["usize"])


def central_header(e: dict, offset: int) -> bytes:
    both = e["layout"] == "descriptor64"
    usize, csize = (x if both or x > _MOST else None for x in (e["usize"], e["csize"]))
    far = offset if offset > _MOST else None
    large = _large(usize, csize, far)
    extra = large + e["extra"]
    classic = lambda big, value: value if big is None else 0xFFFFFFFF
    head = struct.pack(
        "<4s6H3L5H2L", b"PK\x01\x02", e["made_by"], max(45 if large else 20, e["needed"]), e["flags"], e["method"], e["dos_time"], e["dos_date"], e["crc"],
        classic(csize, e["csize"]), classic(usize, e["usize"]), len(e["name"]), len(extra), len(e["comment"]), 0, e["internal"], e["external"], classic(far, offset),
    )
    return head + e["name"] + extra + e["comment"]


def trailer(count: int, cd_size: int, cd_offset: int, comment: bytes = b"") -> bytes:
    """The end records; Zip64 ones only if a classic field overflows."""
    out = b""
    if count > 0xFFFE or max(cd_size, cd_offset) > _MOST:
        out = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, cd_size, cd_offset) + struct.pack("<4sLQL", b"PK\x06\x07", 0, cd_offset + cd_size, 1)
    return out + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, *[min(count, 0xFFFF)] * 2, min(cd_size, 0xFFFFFFFF), min(cd_offset, 0xFFFFFFFF), len(comment)) + comment


def written_flags(layout: str, raw_flags: int = 0) -> int:
    return UTF8 | (DESCRIPTOR if layout != "buffered" else 0) | raw_flags & (ENCRYPTED | STRONG)


def defaults(is_directory: bool) -> dict:
    """Attributes of an entry that states none: a plain file or directory of Unix."""
    return {"external": (0o40755 << 16) | 0x10 if is_directory else 0o100644 << 16, "internal": 0, "made_by": MADE_BY, "needed": 0}
