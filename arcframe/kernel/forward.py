"""Reading an archive front to back, from chunks, without its central directory."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

from ..vocabulary import DEFLATE, DESCRIPTOR, ENCRYPTED, STORE, STRONG, ZipFault, enforce
from .codecs import Inflator
from .reader import decode_name, encryption_scheme, extra_times, resolve_zip64, split_extra

_LOCAL = struct.Struct("<4s5H3L2H")
_RECORDS = (b"PK\x03\x04", b"PK\x01\x02")
_STOPS = (b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06")


class Cursor:
    """Bytes of a chunk stream, pulled as they are needed."""

    def __init__(self, chunks: Iterable[bytes]):
        self._chunks, self._held, self.offset = iter(chunks), bytearray(), 0

    def _fill(self, n: int) -> bool:
        while len(self._held) < n:
            chunk = next(self._chunks, None)
            if chunk is None:
                return False
            self._held += chunk
        return True

    def peek(self, n: int) -> bytes:
        self._fill(n)
        return bytes(self._held[:n])

    def take(self, n: int) -> bytes:
        if not self._fill(n):
            raise ZipFault("ZIP_STREAM_TRUNCATED", f"{len(self._held)} of {n} bytes left")
        out = bytes(self._held[:n])
        del self._held[:n]
        self.offset += n
        return out

    def pieces(self, n: int, size: int = 65_536) -> Iterator[bytes]:
        while n:
            out = self.take(min(n, size))
            n -= len(out)
            yield out

    def some(self) -> bytes:
        """Whatever is at hand, at least one byte; empty at the end."""
        if not self._held:
            self._fill(1)
        out = bytes(self._held[:65_536])
        del self._held[: len(out)]
        self.offset += len(out)
        return out

    def unread(self, data: bytes) -> None:
        self._held[:0] = data
        self.offset -= len(data)


def descriptor_length(head: bytes, crc: int, csize: int, usize: int) -> int:
    """Bytes of the descriptor that states these values: with or without signature, in 32 or 64 bits."""

    def read(form: str) -> tuple | None:
        return struct.unpack_from(form, head) if len(head) >= struct.calcsize(form) else None

    def record_at(n: int) -> bool:
        return head[n : n + 4] in _RECORDS

    signed = head[:4] == b"PK\x07\x08"
    forms = [("<4x3L", 16, signed), ("<4xLQQ", 24, signed), ("<3L", 12, True), ("<LQQ", 20, True)]
    for (short, n, ok), (long, m, _) in (forms[:2], forms[2:]):
        found = [size for form, size in ((short, n), (long, m)) if ok and read(form) == (crc, csize, usize)]
        if len(found) == 2:
            return n if record_at(n) else m
        if found:
            return found[0]
    for form, _, ok in forms:
        if ok and (got := read(form)) and got[1:] == (csize, usize):
            raise ZipFault("ZIP_CRC_MISMATCH", "the descriptor states another CRC-32", expected_crc=got[0], actual_crc=crc)
    raise ZipFault("ZIP_DESCRIPTOR_MISMATCH", "no descriptor states the measured values")


def walk(chunks: Iterable[bytes], limits: dict, codecs: dict, *, decoder=None, with_data: bool = False, decode: bool = True) -> Iterator[dict]:
    """One dict an entry, as they come; a fault ends it after the entries before.

    ``decode``: read contents and check them (encrypted or undecodable entries get an error_code and are stepped over);
    otherwise contents are stepped over, which costs a decode where a descriptor hides their length.
    """
    cursor, number, total = Cursor(chunks), 0, 0
    while True:
        mark = cursor.peek(4)
        if not mark or mark in _STOPS:
            return
        if len(mark) < 4:
            raise ZipFault("ZIP_STREAM_TRUNCATED", "the stream ends inside a signature")
        if mark != b"PK\x03\x04":
            raise ZipFault("ZIP_SIGNATURE_MISMATCH", f"{mark!r} at {cursor.offset} begins no record")
        enforce(limits, "max_entries", number + 1, "streamed entries")
        at = cursor.offset
        _, needed, flags, method, time, date, crc, csize, usize, n_name, n_extra = _LOCAL.unpack(cursor.take(30))
        enforce(limits, "max_name_bytes", n_name, "entry name")
        enforce(limits, "max_extra_field_bytes", n_extra, "entry extra fields")
        raw = cursor.take(n_name)
        fields, _ = split_extra(cursor.take(n_extra))
        usize, csize, *_ = resolve_zip64(fields, usize, csize, 0, 0)
        name, encoding, broken = decode_name(raw, flags, decoder)
        hidden, locked = bool(flags & DESCRIPTOR), bool(flags & (ENCRYPTED | STRONG))
        if hidden and (locked or method != DEFLATE):
            raise ZipFault("ZIP_UNSUPPORTED_CD_LESS_DESCRIPTOR", f"entry {name!r}: its end can't be told", name, feature="cd-less-descriptor")
        if not hidden:
            enforce(limits, "max_entry_uncompressed_size", usize, f"entry {name!r} size")
            if csize >= 1024:
                enforce(limits, "max_compression_ratio", usize / csize, f"entry {name!r} ratio")
        row = {
            "ordinal": number, "name": name, "raw_name": raw, "name_encoding": encoding, "is_directory": name.endswith("/"), "compression_method": method, "compressed_size": csize,
            "uncompressed_size": usize, "crc32": crc, "flags": flags, "version_needed": needed, "dos_date": date, "dos_time": time, "is_encrypted": locked, "offset": at,
            "extra_fields": [{"id": i, "data": d} for i, d in fields], "ut_mtime": extra_times(fields)["ut_mtime"], "invalid_utf8": broken, "error_code": None, "data": None,
        }
        out: list[bytes] = []
        if hidden:
            row["crc32"], row["compressed_size"], row["uncompressed_size"] = _hidden(cursor, name, limits, total, out if with_data else None)
            total += row["uncompressed_size"] if decode else 0
        elif not decode or csize == 0 and usize == 0 and not crc:
            for _ in cursor.pieces(csize):
                pass
        else:
            codec = codecs.get(method)
            if locked:
                row["error_code"] = "ZIP_UNSUPPORTED_ENCRYPTION"
                row["feature"] = encryption_scheme(flags, method, [i for i, _ in fields])
            elif codec is None:
                row["error_code"] = "ZIP_UNSUPPORTED_METHOD"
            elif method not in (STORE, DEFLATE) and not hasattr(codec, "decompressor"):
                row["error_code"] = "ZIP_UNSUPPORTED_CODEC_MODE"
            if row["error_code"]:
                for _ in cursor.pieces(csize):
                    pass
            else:
                total = _sized(cursor, row, limits, total, codec, out if with_data else None)
        row["data"] = b"".join(out) if with_data and not row["error_code"] else None
        number += 1
        yield row


def _hidden(cursor: Cursor, name: str, limits: dict, total: int, out: list | None) -> tuple[int, int, int]:
    """Decode a stream of unknown length, hold it against its descriptor; (crc, compressed size, size)."""
    z, crc, fed = Inflator(int(min(limits["max_entry_uncompressed_size"], 1 << 62))), 0, 0
    while not z.finished:
        chunk = cursor.some()
        if not chunk:
            raise ZipFault("ZIP_STREAM_TRUNCATED", f"the stream ends inside entry {name!r}", name)
        fed += len(chunk)
        piece = z.push(chunk)
        enforce(limits, "max_total_uncompressed_size", total + z.produced, "streamed output")
        crc = zlib.crc32(piece, crc)
        if out is not None:
            out.append(piece)
        if fed >= 1024:
            enforce(limits, "max_compression_ratio", z.produced / fed, f"entry {name!r} ratio")
    cursor.unread(z.leftover)
    if z.consumed >= 1024:
        enforce(limits, "max_compression_ratio", z.produced / z.consumed, f"entry {name!r} ratio")
    cursor.take(descriptor_length(cursor.peek(28), crc, z.consumed, z.produced))
    return crc, z.consumed, z.produced


def _sized(cursor: Cursor, row: dict, limits: dict, total: int, codec, out: list | None) -> int:
    """Decode a payload of known length and check it; the total of output so far."""
    name, most = row["name"], int(min(row["uncompressed_size"], limits["max_entry_uncompressed_size"]))
    own = row["compression_method"] in (STORE, DEFLATE)
    z = None if row["compression_method"] == STORE else Inflator(most) if own else codec.decompressor(most)
    made, crc = 0, 0
    lies = ZipFault("ZIP_SIZE_MISMATCH", f"entry {name!r} isn't as long as its header says", name)

    def account(piece: bytes) -> None:
        nonlocal made, crc
        made += len(piece)
        if made > most:
            raise lies
        enforce(limits, "max_total_uncompressed_size", total + made, "streamed output")
        crc = zlib.crc32(piece, crc)
        if out is not None:
            out.append(piece)

    for piece in cursor.pieces(row["compressed_size"]):
        try:
            piece = piece if z is None else z.push(piece)
        except ZipFault as fault:
            raise (lies if fault.code == "ZIP_INFLATE_OUTPUT_OVERFLOW" else fault) from None
        account(piece)
    if z is not None:
        account(z.end() or b"")
    if made != row["uncompressed_size"]:
        raise lies
    if crc != row["crc32"]:
        raise ZipFault("ZIP_CRC_MISMATCH", f"entry {name!r} is corrupt", name, expected_crc=row["crc32"], actual_crc=crc)
    return total + made
