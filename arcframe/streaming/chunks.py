"""Forward reading of archives whose chunks arrive over time, in any batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernel.codecs import codec_table
from ..kernel.forward import walk
from ..vocabulary import ZipFault, resolve_limits

_OUT = "archive_id string, ordinal int, name string, uncompressed_size long, crc32 long, offset long, data binary, error_code string"
_STATE = "next_seq long, base long, number int, total long, held binary, waiting binary, ended boolean"


def file_stream(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """A stream of (archive_id, content) of files as they appear; ``forward_entries`` takes it as it is."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select(F.col("path").alias("archive_id"), "content")


def chunked_entries(chunks: DataFrame, *, with_data: bool = False, limits: dict | None = None) -> DataFrame:
    """Entries of archives given as a stream of (archive_id string, seq long, chunk binary).

    Chunks may come late or out of order; each archive is read as far as its chunks reach without a gap. The state of
    an archive is the bytes of its unfinished entry and of chunks that came early, so a restart from the checkpoint
    gives the same rows. An empty chunk ends an archive: what is unfinished then is ZIP_STREAM_TRUNCATED.
    """
    bounds, codecs = resolve_limits(limits), codec_table()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        next_seq, base, number, total, held, waiting, ended = state.get if state.exists else (0, 0, 0, 0, b"", pickle.dumps({}), False)
        early = pickle.loads(bytes(waiting))  # noqa: S301 - our own state
        for frame in frames:
            early.update((int(s), bytes(c)) for s, c in zip(frame["seq"], frame["chunk"], strict=True) if int(s) >= next_seq)
        held, last = bytearray(held), False
        while next_seq in early:
            chunk = early.pop(next_seq)
            next_seq += 1
            last |= not chunk
            held += chunk
        rows, used = [], 0
        if not ended and held:
            try:
                for e in walk([bytes(held)], bounds | {"max_total_uncompressed_size": bounds["max_total_uncompressed_size"] - total}, codecs, with_data=with_data):
                    after = _end_of(bytes(held), e)
                    if after is None and not last:
                        break  # a descriptor may still grow by what comes next
                    rows.append([key[0], number, e["name"], e["uncompressed_size"], e["crc32"], base + e["offset"], e["data"], e["error_code"]])
                    number, total, used = number + 1, total + e["uncompressed_size"], after or len(held)
                else:
                    ended = len(held) - used >= 4  # a record that ends the entries
            except ZipFault as fault:
                if fault.code != "ZIP_STREAM_TRUNCATED" or last:
                    rows.append([key[0], number, None, None, None, None, None, fault.code])
                    ended = True
        held = b"" if ended else bytes(held[used:])
        state.update((next_seq, base + used, number, total, held, pickle.dumps({} if ended else early), ended))
        yield pd.DataFrame(rows, columns=["archive_id", "ordinal", "name", "uncompressed_size", "crc32", "offset", "data", "error_code"]).astype({"ordinal": "Int32", "uncompressed_size": "Int64", "crc32": "Int64", "offset": "Int64"})

    return chunks.select("archive_id", "seq", "chunk").groupBy("archive_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def _end_of(held: bytes, e: dict) -> int | None:
    """Where an entry ends in the held bytes; None if its descriptor could be longer than what is there."""
    head = e["offset"] + 30 + int.from_bytes(held[e["offset"] + 26 : e["offset"] + 28], "little") + int.from_bytes(held[e["offset"] + 28 : e["offset"] + 30], "little")
    end = head + e["compressed_size"]
    if not e["flags"] & 8:
        return end
    if len(held) < end + 28:
        return None
    from ..kernel.forward import descriptor_length

    return end + descriptor_length(held[end : end + 28], e["crc32"], e["compressed_size"], e["uncompressed_size"])
