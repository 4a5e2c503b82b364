"""Decoders and encoders by compression method, with bounded output."""

from __future__ import annotations

import zlib
from typing import Protocol

from ..vocabulary import DEFLATE, STORE, ZipFault


class Codec(Protocol):
    """What a registered codec may offer; every member but ``method`` and ``name`` may be absent. It must pickle."""

    method: int
    name: str

    def decompress(self, data: bytes, most: int) -> bytes: ...

    def compress(self, data: bytes, level: int) -> bytes: ...

    def decompressor(self, most: int): ...


class Inflator:
    """A resumable raw-DEFLATE decoder that takes any chunking and knows where the stream ends."""

    def __init__(self, most: int):
        self._z, self._most = zlib.decompressobj(-15), most
        self.consumed = self.produced = 0
        self.leftover = b""

    @property
    def finished(self) -> bool:
        return self._z.eof

    def push(self, chunk: bytes) -> bytes:
        if self._z.eof:
            self.leftover += chunk
            return b""
        out, data = [], bytes(chunk)
        while True:
            room = self._most - self.produced + 1  # one byte more than allowed shows an overflow
            try:
                piece = self._z.decompress(data, room)
            except zlib.error as e:
                raise ZipFault("ZIP_DEFLATE_CORRUPT", str(e)) from None
            self.produced += len(piece)
            out.append(piece)
            if self.produced > self._most:
                raise ZipFault("ZIP_INFLATE_OUTPUT_OVERFLOW", f"over {self._most} bytes")
            rest = self._z.unconsumed_tail
            self.consumed += len(data) - len(rest) - len(self._z.unused_data)
            if self._z.eof or not rest:
                self.leftover = self._z.unused_data
                return b"".join(out)
            data = rest

    def end(self) -> None:
        if not self._z.eof:
            raise ZipFault("ZIP_DEFLATE_TRUNCATED", "the stream ends inside a block")


def inflate_raw(data: bytes, most: int) -> bytes:
    """At most ``most`` bytes; more, a broken or an unfinished stream is a fault."""
    z = Inflator(most)
    out = z.push(data)
    z.end()
    return out


def deflate_raw(data: bytes, level: int = 6) -> bytes:
    if isinstance(level, bool) or not isinstance(level, int) or not 0 <= level <= 9:
        raise ZipFault("ZIP_INVALID_OPTION", f"level {level!r} is not 0 to 9")
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


class _Store:
    method, name = STORE, "store"

    def decompress(self, data: bytes, most: int) -> bytes:
        if len(data) > most:
            raise ZipFault("ZIP_INFLATE_OUTPUT_OVERFLOW", f"over {most} bytes")
        return data

    def compress(self, data: bytes, level: int) -> bytes:
        return data


class _Deflate:
    method, name = DEFLATE, "deflate"

    def decompress(self, data: bytes, most: int) -> bytes:
        return inflate_raw(data, most)

    def compress(self, data: bytes, level: int) -> bytes:
        return deflate_raw(data, level)

    def decompressor(self, most: int) -> Inflator:
        return Inflator(most)


_CODECS: dict[int, Codec] = {STORE: _Store(), DEFLATE: _Deflate()}


def register_codec(codec: Codec) -> None:
    """Add or override the codec of a method, on the driver; operators ship the registry with their tasks."""
    _CODECS[codec.method] = codec


def get_codec(method: int) -> Codec | None:
    return _CODECS.get(method)


def codec_table() -> dict[int, Codec]:
    """A copy to ship with a task."""
    return dict(_CODECS)


def active_deflate_tier() -> str:
    """The one tier there is: the native zlib of the executors."""
    return "native"
