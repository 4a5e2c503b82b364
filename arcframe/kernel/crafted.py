"""Archives laid out by hand, with lies where they are wanted, to test readers with; it uses nothing else of the package."""

from __future__ import annotations

import struct
import zlib


def deflate(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


def raw_zip(entries: list[dict], *, comment: bytes = b"", prepend: bytes = b"", append: bytes = b"", zip64: bool = False, drop_record: bool = False, **lies: int) -> bytes:
    """Entries: name, data and optional payload, method, flags, time, date, extra_local, extra_central, comment, attributes, made_by, descriptor, and *_lie values."""
    body, directory = bytearray(prepend), bytearray()
    for e in entries:
        name = e["name"] if isinstance(e["name"], bytes) else e["name"].encode()
        data, method, flags = e.get("data", b""), e.get("method", 0), e.get("flags", 0)
        payload = bytearray(e["payload"] if "payload" in e else deflate(data) if method == 8 else data)
        if "corrupt_at" in e:
            payload[e["corrupt_at"]] ^= 0xFF
        crc, csize, usize = e.get("crc_lie", zlib.crc32(data)), e.get("csize_lie", len(payload)), e.get("usize_lie", len(data))
        kind = e.get("descriptor")
        flags |= 8 if kind else 0
        at = e.get("offset_lie", len(body) - len(prepend))
        time, date = e.get("time", 0), e.get("date", 0x21)
        local = (0, 0, 0) if kind else (e.get("lfh_crc_lie", crc), csize, usize)
        lname = e.get("lfh_name_lie", name)
        body += struct.pack("<4s5H3L2H", b"PK\3\4", 20, flags, e.get("lfh_method_lie", method), time, date, *local, len(lname), len(e.get("extra_local", b""))) + lname + e.get("extra_local", b"") + payload
        if kind:
            values = (e.get("d_crc_lie", zlib.crc32(data)), e.get("d_csize_lie", len(payload)), e.get("d_usize_lie", len(data)))
            body += (b"PK\7\10" if kind.startswith("signed") else b"") + struct.pack("<LQQ" if kind.endswith("64") else "<3L", *values)
        directory += struct.pack(
            "<4s6H3L5H2L", b"PK\1\2", e.get("made_by", 0x031E), 20, flags, method, time, date, crc, csize, usize, len(name), len(e.get("extra_central", b"")), len(e.get("comment", b"")), 0, 0, e.get("attributes", 0), at
        ) + name + e.get("extra_central", b"") + e.get("comment", b"")
    start = len(body) - len(prepend)
    n, size = lies.get("entries_lie", len(entries)), lies.get("cd_size_lie", len(directory))
    start = lies.get("cd_offset_lie", start)
    out = bytes(body) + bytes(directory)
    if zip64:
        if not drop_record:
            out += struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, lies.get("zip64_entries_lie", n), lies.get("zip64_entries_lie", n), size, start)
        out += struct.pack("<4sLQL", b"PK\6\7", 0, start + size, 1)
    return out + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, size, 0xFFFFFFFF if zip64 else start, len(comment)) + comment + append
