"""Layout, central directory, local headers and payloads of one archive, over a byte-range source."""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..vocabulary import DESCRIPTOR, ENCRYPTED, SAFE_INTEGER, STRONG, UTF8, ZipFault, enforce

_EOCD = struct.Struct("<4s4H2LH")
_LOCATOR = struct.Struct("<4sLQL")
_EOCD64 = struct.Struct("<4sQ2H2L4Q")
_CENTRAL = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")
#: What opening reads: the longest trailer with its comment, the Zip64 records, and a little more.
TAIL, LOCAL_AHEAD = 22 + 65_535 + 20 + 56 + 65_536, 1024
_U16, _U32 = 0xFFFF, 0xFFFFFFFF
Diagnose = Callable[[str, str | None], None]


@dataclass
class Bytes:
    """An archive in memory as a range source."""

    data: bytes

    def __post_init__(self) -> None:
        self.size = len(self.data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[max(at, 0) : max(at, 0) + n]


@dataclass
class Counted:
    """A range source that counts what is read of another."""

    inner: object
    reads: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.size = self.inner.size

    def read(self, at: int, n: int) -> bytes:
        self.reads.append((at, n))
        return self.inner.read(at, n)


class Windowed:
    """Serves ranges inside the cached tail for nothing, and refuses short reads."""

    def __init__(self, source):
        self.source, self.size = source, source.size
        self.from_ = max(0, self.size - TAIL)
        self.tail = self._exact(self.from_, self.size - self.from_)

    def _exact(self, at: int, n: int) -> bytes:
        got = self.source.read(at, n) if n else b""
        if len(got) != n:
            raise ZipFault("ZIP_RECORD_TRUNCATED", f"{len(got)} of {n} bytes at {at}")
        return got

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ZipFault("ZIP_RECORD_TRUNCATED", f"{n} bytes at {at} of {self.size}")
        return self.tail[at - self.from_ : at - self.from_ + n] if at >= self.from_ else self._exact(at, n)


@dataclass
class Layout:
    total_entries: int
    cd_size: int
    cd_offset: int
    base: int
    is_zip64: bool
    comment: bytes


def _safe(value: int, what: str) -> int:
    if value > SAFE_INTEGER:
        raise ZipFault("ZIP_VALUE_UNREPRESENTABLE", f"{what} is {value}")
    return value


def find_layout(source: Windowed, limits: dict, diagnose: Diagnose) -> Layout:
    """The trailer nearest the end whose comment ends with the file, its Zip64 form, and where the directory lies."""
    tail, shift = source.tail, source.from_
    ends, other = None, False
    at = len(tail)
    while (at := tail.rfind(b"PK\x05\x06", max(0, len(tail) - 22 - _U16), at + 3)) >= 0:
        if ends is None and at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            ends = at
        elif at + 22 <= len(tail):
            other = True
        if at == 0:
            break
    if ends is None:
        raise ZipFault("ZIP_EOCD_NOT_FOUND", "no trailer ends with the file" if other else "no trailer")
    if other:
        diagnose("ZIP_MULTIPLE_EOCD", None)
    _, disk, cd_disk, here, total, cd_size, cd_offset, n_comment = _EOCD.unpack_from(tail, ends)
    enforce(limits, "max_comment_bytes", n_comment, "archive comment length")
    classic = {"total entries": (total, _U16), "entries on disk": (here, _U16), "directory size": (cd_size, _U32), "directory offset": (cd_offset, _U32), "disk": (disk, _U16), "directory disk": (cd_disk, _U16)}
    cd_end, zip64 = ends, any(value == sentinel for value, sentinel in classic.values())
    if zip64:
        found = ends - 20
        if found < 0 or tail[found : found + 4] != b"PK\x06\x07":
            raise ZipFault("ZIP_ZIP64_LOCATOR_MISSING", "a field is a sentinel, but no locator stands before the trailer")
        _, _, pointed, disks = _LOCATOR.unpack_from(tail, found)
        if disks > 1:
            raise ZipFault("ZIP_UNSUPPORTED_MULTI_DISK", "several disks", feature="multi-disk")
        pointed = _safe(pointed, "Zip64 trailer offset")
        for cd_end in (pointed - shift, found - 56):
            if 0 <= cd_end <= len(tail) - 56 and tail[cd_end : cd_end + 4] == b"PK\x06\x06":
                break
        else:
            raise ZipFault("ZIP_ZIP64_EOCD_MISPLACED", "no Zip64 trailer where the locator points")
        _, _, _, _, disk, cd_disk, here, total, cd_size, cd_offset = _EOCD64.unpack_from(tail, cd_end)
        large = dict(zip(("total entries", "entries on disk", "directory size", "directory offset", "disk", "directory disk"), (total, here, cd_size, cd_offset, disk, cd_disk), strict=True))
        for what in ("entries on disk", "total entries", "directory size", "directory offset"):
            _safe(large[what], what)
        for what, (value, sentinel) in classic.items():
            if value not in (sentinel, large[what]):
                raise ZipFault("ZIP_ZIP64_CONTRADICTION", f"{what}: {value} and {large[what]}")
    if disk or cd_disk:
        raise ZipFault("ZIP_UNSUPPORTED_MULTI_DISK", "several disks", feature="multi-disk")
    if here != total:
        raise ZipFault("ZIP_EOCD_INCONSISTENT", f"{here} entries on this disk of {total}")
    enforce(limits, "max_entries", total, "entries")
    enforce(limits, "max_central_directory_bytes", cd_size, "central directory size")
    base = cd_end + shift - cd_offset - cd_size
    if base < 0:
        raise ZipFault("ZIP_EOCD_INCONSISTENT", "the central directory reaches into the trailer")
    if base:
        diagnose("ZIP_PREPENDED_DATA", None)
    return Layout(total, cd_size, cd_offset + base, base, zip64, tail[ends + 22 :])


def split_extra(extra: bytes) -> tuple[list[tuple[int, bytes]], bool]:
    """(id, data) fields, and whether one overruns; up to three bytes behind the last are let pass."""
    fields, at = [], 0
    while at + 4 <= len(extra):
        id_, n = struct.unpack_from("<2H", extra, at)
        if at + 4 + n > len(extra):
            return fields, True
        fields.append((id_, extra[at + 4 : at + 4 + n]))
        at += 4 + n
    return fields, False


def first_field(fields: list[tuple[int, bytes]], id_: int) -> bytes | None:
    return next((data for i, data in fields if i == id_), None)


def resolve_zip64(fields: list[tuple[int, bytes]], usize: int, csize: int, offset: int, disk: int) -> tuple[int, int, int, int, bool, bool]:
    """The four values with sentinels replaced in their fixed order; whether any was, and whether the field holds more."""
    data = first_field(fields, 0x0001)
    values, used, at = [usize, csize, offset, disk], False, 0
    if data is None:
        return (*values, False, False)
    for k, (sentinel, form, size) in enumerate(((_U32, "<Q", 8), (_U32, "<Q", 8), (_U32, "<Q", 8), (_U16, "<L", 4))):
        if values[k] == sentinel:
            if at + size <= len(data):
                values[k], used = _safe(struct.unpack_from(form, data, at)[0], "Zip64 field"), True
            at += size
    return (*values, used, len(data) > at)


def extra_times(fields: list[tuple[int, bytes]]) -> dict[str, int | None]:
    """Seconds of the UT field and milliseconds of the NTFS field, since 1970; absent parts are None."""
    out: dict[str, int | None] = dict.fromkeys(("ut_mtime", "ut_atime", "ut_ctime", "ntfs_mtime", "ntfs_atime", "ntfs_ctime"))
    if data := first_field(fields, 0x5455):
        at = 1
        for bit, name in ((1, "ut_mtime"), (2, "ut_atime"), (4, "ut_ctime")):
            if data[0] & bit:
                if at + 4 <= len(data):
                    out[name] = struct.unpack_from("<l", data, at)[0]
                at += 4
    if (data := first_field(fields, 0x000A)) and len(data) >= 4:
        at = 4
        while at + 4 <= len(data):
            tag, n = struct.unpack_from("<2H", data, at)
            if tag == 1 and n >= 24 and at + 28 <= len(data):
                for k, name in enumerate(("ntfs_mtime", "ntfs_atime", "ntfs_ctime")):
                    out[name] = struct.unpack_from("<Q", data, at + 4 + 8 * k)[0] // 10_000 - 11_644_473_600_000
                break
            at += 4 + n
    return out


def unix_ids(fields: list[tuple[int, bytes]]) -> tuple[int | None, int | None]:
    """uid and gid of the ux field, version 1."""
    data = first_field(fields, 0x7875)
    if not data or len(data) < 3 or data[0] != 1:
        return None, None
    n = data[1]
    if not 1 <= n <= 8 or len(data) < 3 + n:
        return None, None
    m = data[2 + n]
    if not 1 <= m <= 8 or len(data) < 3 + n + m:
        return None, None
    uid, gid = int.from_bytes(data[2 : 2 + n], "little"), int.from_bytes(data[3 + n : 3 + n + m], "little")
    return (uid, gid) if max(uid, gid) <= SAFE_INTEGER else (None, None)


def decode_name(raw: bytes, flags: int, decoder: Callable[[bytes], str] | None = None) -> tuple[str, str, bool]:
    """(name, encoding, whether bit 11 promised UTF-8 in vain)."""
    broken = False
    if flags & UTF8:
        try:
            return raw.decode(), "utf-8", False
        except UnicodeDecodeError:
            broken = True
    return (decoder(raw), "custom", broken) if decoder else (raw.decode("cp437"), "cp437", broken)


def read_entries(source: Windowed, layout: Layout, limits: dict, diagnose: Diagnose, decoder: Callable | None = None) -> list[dict]:
    """Exactly the declared records of the central directory, in its order."""
    raw = source.read(layout.cd_offset, layout.cd_size)
    entries, at = [], 0
    for k in range(layout.total_entries):
        if at >= len(raw):
            raise ZipFault("ZIP_CD_INCONSISTENT", f"the directory ends after {k} of {layout.total_entries} entries")
        if at + 46 > len(raw):
            beyond = source.size - layout.cd_offset - at
            raise ZipFault("ZIP_RECORD_TRUNCATED" if beyond < 46 else "ZIP_CD_INCONSISTENT", "a directory record is cut off")
        sig, made_by, needed, flags, method, time, date, crc, csize, usize, n_name, n_extra, n_comment, disk, internal, external, offset = _CENTRAL.unpack_from(raw, at)
        if sig != b"PK\x01\x02":
            raise ZipFault("ZIP_SIGNATURE_MISMATCH", f"no directory record at {layout.cd_offset + at}")
        end = at + 46 + n_name + n_extra + n_comment
        if end > len(raw):
            raise ZipFault("ZIP_CD_INCONSISTENT", "a record reaches past the directory")
        for name, n, what in (("max_name_bytes", n_name, "entry name"), ("max_extra_field_bytes", n_extra, "entry extra fields"), ("max_comment_bytes", n_comment, "entry comment")):
            enforce(limits, name, n, what)
        name_end, extra_end = at + 46 + n_name, at + 46 + n_name + n_extra
        raw_name = raw[at + 46 : name_end]
        fields, malformed = split_extra(raw[name_end:extra_end])
        name, encoding, broken = decode_name(raw_name, flags, decoder)
        if broken:
            diagnose("ZIP_INVALID_UTF8_NAME", name)
        if malformed:
            diagnose("ZIP_EXTRA_FIELD_MALFORMED", name)
        usize, csize, offset, disk, used, more = resolve_zip64(fields, usize, csize, offset, disk)
        if more:
            diagnose("ZIP_ZIP64_EXTRA_IGNORED", name)
        if disk:
            raise ZipFault("ZIP_UNSUPPORTED_MULTI_DISK", f"entry {name!r} starts on disk {disk}", name, feature="multi-disk")
        if (path := first_field(fields, 0x7075)) and path[0] == 1 and len(path) >= 5 and path[5:] != raw_name:
            diagnose("ZIP_UNICODE_PATH_CONFLICT", name)
        uid, gid = unix_ids(fields)
        entries.append({
            "ordinal": k, "name": name, "raw_name": raw_name, "name_encoding": encoding, "compression_method": method, "compressed_size": csize,
            "uncompressed_size": usize, "crc32": crc, "local_header_offset": offset + layout.base, "dos_date": date, "dos_time": time, "flags": flags,
            "version_made_by": made_by, "version_needed": needed, "internal_attributes": internal, "external_attributes": external,
            "comment": raw[extra_end:end], "extra_fields": [{"id": i, "data": d} for i, d in fields], "uses_zip64": used, "uid": uid, "gid": gid, **extra_times(fields),
        })
        at = end
    if at != len(raw):
        raise ZipFault("ZIP_CD_INCONSISTENT", "the directory holds more than its entries")
    starts = sorted([e["local_header_offset"] for e in entries] + [layout.cd_offset])
    shared = any(a == b for a, b in zip(starts, starts[1:]))
    for e in entries:
        k = bisect.bisect_right(starts, e["local_header_offset"])
        e["next_boundary"], e["shared_offset"] = starts[k] if k < len(starts) else source.size, shared
    return entries


def read_local(source: Windowed, at: int) -> dict:
    """The local header there: one read ahead, a second only if name and extra fields are longer."""
    if at < 0 or at + 30 > source.size:
        raise ZipFault("ZIP_RECORD_TRUNCATED", f"no room for a local header at {at}")
    head = source.read(at, min(30 + LOCAL_AHEAD, source.size - at))
    sig, needed, flags, method, time, date, crc, csize, usize, n_name, n_extra = _LOCAL.unpack_from(head)
    if sig != b"PK\x03\x04":
        raise ZipFault("ZIP_SIGNATURE_MISMATCH", f"no local header at {at}")
    size = 30 + n_name + n_extra
    if at + size > source.size:
        raise ZipFault("ZIP_RECORD_TRUNCATED", "a local header is cut off")
    if size > len(head):
        head = source.read(at, size)
    return {"version_needed": needed, "flags": flags, "method": method, "dos_time": time, "dos_date": date, "crc32": crc, "compressed_size": csize, "uncompressed_size": usize, "name": head[30 : 30 + n_name], "extra": head[30 + n_name : size], "data_start": at + size}


def check_entry(e: dict, local: dict, layout: Layout, size: int, limits: dict, diagnose: Diagnose) -> None:
    """Declared sizes, extent, and agreement of the two headers; the first fault is raised."""
    name = e["name"]
    enforce(limits, "max_entry_uncompressed_size", e["uncompressed_size"], f"entry {name!r} size")
    if e["compressed_size"] >= 1024:
        enforce(limits, "max_compression_ratio", e["uncompressed_size"] / e["compressed_size"], f"entry {name!r} ratio")
    end = local["data_start"] + e["compressed_size"] + (12 if local["flags"] & DESCRIPTOR else 0)
    if end > size:
        raise ZipFault("ZIP_RECORD_TRUNCATED", f"entry {name!r} ends past the file", name)
    if e["local_header_offset"] >= layout.cd_offset or e["shared_offset"] or end > e["next_boundary"]:
        raise ZipFault("ZIP_ENTRY_OVERLAP", f"entry {name!r} overlaps another or the directory", name)
    if local["method"] != e["compression_method"]:
        raise ZipFault("ZIP_CD_LFH_MISMATCH", f"entry {name!r}: methods {e['compression_method']} and {local['method']}", name)
    mine = (local["crc32"], local["compressed_size"], local["uncompressed_size"])
    if not local["flags"] & DESCRIPTOR and mine != (e["crc32"], e["compressed_size"], e["uncompressed_size"]) and mine != (e["crc32"], _U32, _U32):
        raise ZipFault("ZIP_SIZE_MISMATCH", f"entry {name!r}: the headers differ", name, expected_crc=e["crc32"], actual_crc=local["crc32"])
    if local["name"] != e["raw_name"]:
        diagnose("ZIP_NAME_MISMATCH", name)


def encryption_scheme(flags: int, method: int, ids: list[int]) -> str:
    return "aes" if method == 99 or 0x9901 in ids else "strong" if flags & STRONG else "zipcrypto"


def decode_payload(e: dict, payload: bytes, codecs: dict) -> bytes:
    """The content of an entry, no longer than declared."""
    name, method = e["name"], e["compression_method"]
    if e["flags"] & (ENCRYPTED | STRONG):
        scheme = encryption_scheme(e["flags"], method, [f["id"] for f in e["extra_fields"]])
        raise ZipFault("ZIP_UNSUPPORTED_ENCRYPTION", f"entry {name!r} is encrypted ({scheme})", name, feature=scheme)
    codec = codecs.get(method)
    if codec is None:
        raise ZipFault("ZIP_UNSUPPORTED_METHOD", f"entry {name!r}: method {method}", name, feature=f"method:{method}")
    if not hasattr(codec, "decompress"):
        raise ZipFault("ZIP_UNSUPPORTED_CODEC_MODE", f"entry {name!r}: {codec.name} only streams", name, feature=f"method:{method}")
    try:
        return codec.decompress(payload, e["uncompressed_size"])
    except ZipFault as fault:
        fault.entry = name
        raise
    except Exception as error:
        raise ZipFault("ZIP_DECOMPRESSION_FAILED", f"entry {name!r}: {error}", name) from None


def check_output(e: dict, data: bytes, verify_crc: bool = True) -> None:
    if len(data) != e["uncompressed_size"]:
        raise ZipFault("ZIP_SIZE_MISMATCH", f"entry {e['name']!r} has {len(data)} bytes, {e['uncompressed_size']} declared", e["name"])
    if verify_crc and (actual := zlib.crc32(data)) != e["crc32"]:
        raise ZipFault("ZIP_CRC_MISMATCH", f"entry {e['name']!r} is corrupt", e["name"], expected_crc=e["crc32"], actual_crc=actual)


class Archive:
    """One opened archive: its layout at once, its entries when first asked for."""

    def __init__(self, source, limits: dict, *, decoder: Callable | None = None, codecs: dict | None = None):
        self.found: list[tuple[str, str | None]] = []
        self.limits, self.decoder, self.codecs = limits, decoder, codecs or {}
        if source.size < 22:
            raise ZipFault("ZIP_EOCD_NOT_FOUND", "under 22 bytes")
        self.source = Windowed(source)
        self.layout = find_layout(self.source, limits, self.diagnose)
        self._entries: list[dict] | None = None

    def diagnose(self, code: str, name: str | None) -> None:
        self.found.append((code, name))

    @property
    def entries(self) -> list[dict]:
        if self._entries is None:
            self._entries = read_entries(self.source, self.layout, self.limits, self.diagnose, self.decoder)
        return self._entries

    def local(self, e: dict) -> dict:
        return read_local(self.source, e["local_header_offset"])

    def checked(self, e: dict) -> dict:
        local = self.local(e)
        check_entry(e, local, self.layout, self.source.size, self.limits, self.diagnose)
        return local

    def check_extents(self) -> None:
        """The first entry that reaches into another, into the directory or past the file is a fault."""
        for e in self.entries:
            local = self.local(e)
            end = local["data_start"] + e["compressed_size"] + (12 if local["flags"] & DESCRIPTOR else 0)
            if end > self.source.size:
                raise ZipFault("ZIP_RECORD_TRUNCATED", "past the file", e["name"])
            if e["local_header_offset"] >= self.layout.cd_offset or e["shared_offset"] or end > e["next_boundary"]:
                raise ZipFault("ZIP_ENTRY_OVERLAP", "overlap", e["name"])

    def descriptor_forms(self, e: dict, local: dict) -> dict[str, int]:
        """Lengths of the descriptors of 32-bit ("narrow") and 64-bit ("wide") sizes, behind the payload, that state the directory's values."""
        at = local["data_start"] + e["compressed_size"]
        head = self.source.read(at, min(24, self.source.size - at)) if at <= self.source.size else b""
        want, found = (e["crc32"], e["compressed_size"], e["uncompressed_size"]), {}
        for form, layout in (("narrow", "<3L"), ("wide", "<LQQ")):
            for skip in (4, 0):
                size = skip + struct.calcsize(layout)
                if len(head) >= size and (not skip or head[:4] == b"PK\x07\x08") and struct.unpack_from(layout, head, skip) == want:
                    found.setdefault(form, size)
        return found

    def record_mark(self, at: int) -> bytes:
        """The four bytes there, less at the end of the file."""
        return self.source.read(at, max(0, min(4, self.source.size - at)))

    def payload_extent(self, e: dict) -> tuple[int, int]:
        """Where a checked entry's payload begins, and its length."""
        local = self.checked(e)
        enforce(self.limits, "max_entry_compressed_size", e["compressed_size"], f"entry {e['name']!r} compressed size")
        return local["data_start"], e["compressed_size"]

    def payload(self, e: dict) -> bytes:
        return self.source.read(*self.payload_extent(e))

    def read(self, e: dict, verify_crc: bool = True) -> bytes:
        if e["flags"] & (ENCRYPTED | STRONG):
            decode_payload(e, b"", self.codecs)
        data = decode_payload(e, self.payload(e), self.codecs)
        check_output(e, data, verify_crc)
        return data

    def verify(self, e: dict) -> dict:
        """Never raises: header agreement for every entry, then encrypted, undecodable, unstreamable, then the content."""
        out = {"crc_match": False, "size_match": False, "local_header_match": False, "skipped": None}
        payload = None
        try:
            payload = self.payload(e)
            out["local_header_match"] = True
        except ZipFault:
            pass
        codec = self.codecs.get(e["compression_method"])
        if e["flags"] & (ENCRYPTED | STRONG):
            out["skipped"] = "encrypted"
        elif codec is None:
            out["skipped"] = "unsupported-method"
        elif not hasattr(codec, "decompress"):
            out["skipped"] = "stream-only-codec"
        elif payload is not None:
            try:
                data = decode_payload(e, payload, self.codecs)
                out["size_match"] = len(data) == e["uncompressed_size"]
                out["crc_match"] = zlib.crc32(data) == e["crc32"]
            except ZipFault:
                pass
        return out


def chunks(data: bytes, size: int = 65_536) -> Iterator[bytes]:
    for at in range(0, len(data), size):
        yield data[at : at + size]
