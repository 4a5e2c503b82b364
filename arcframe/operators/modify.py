"""Changing archives: an overlay of edits, appended or rewritten, and the canonical form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import timestamp_to_dos
from ..kernel import writer
from ..kernel.codecs import codec_table
from ..kernel.reader import Archive, Bytes
from ..vocabulary import ENCRYPTED, EPOCH_DATE, EPOCH_TIME, MADE_BY, STRONG, UTF8, ZipFault, resolve_limits
from ..session import in_arrow
from ._run import batches
from .content import raw_payloads
from .write import pack_raw


def folded(names: list[str], edits: list[dict]) -> tuple[dict[str, int], dict[str, dict], bytes | None]:
    """Edits in order over an archive's names: (name -> source ordinal, name -> data written, comment or None).

    add needs the name free, replace and remove and rename need it there, rename needs the new one free.
    """
    if len(set(names)) < len(names):
        raise ZipFault("ZIP_DUPLICATE_ENTRY_NAME", "the archive repeats a name")
    kept, written, comment = {n: k for k, n in enumerate(names)}, {}, None
    for e in edits:
        op, name = e["op"], e.get("name")
        there = name in kept or name in written
        if op == "comment":
            comment = bytes(e["data"] or b"")
        elif op == "add":
            if there:
                raise ZipFault("ZIP_ENTRY_EXISTS", f"{name!r} is there", name)
            written[name] = e
        elif op not in ("replace", "remove", "rename"):
            raise ZipFault("ZIP_INVALID_OPTION", f"edit {op!r}")
        elif not there:
            raise ZipFault("ZIP_ENTRY_NOT_FOUND", f"{name!r} is not there", name)
        elif op == "rename":
            new = e["new_name"]
            if new in kept or new in written:
                raise ZipFault("ZIP_ENTRY_EXISTS", f"{new!r} is there", new)
            if name in kept:
                kept[new] = kept.pop(name)
            else:
                written[new] = written.pop(name)
        else:
            kept.pop(name, None)
            written.pop(name, None)
            if op == "replace":
                written[name] = e
    return kept, written, comment


def modify(archives: DataFrame, edits: DataFrame, *, compact: bool = False, limits: dict | None = None) -> DataFrame:
    """(archive_id, content, dead_ratio, error_code) of archives after their ``edits``.

    ``edits``: (archive_id, seq, op, name, new_name, data), op one of add, replace, remove, rename, comment, applied by
    seq. Appending keeps the old bytes as they are and writes new entries, a new directory and a new trailer behind;
    what was removed stays recoverable. ``compact`` rewrites without recompression and leaves nothing behind. An
    archive without edits comes back unchanged. One archive and its edits meet in one task.
    """
    bounds, codecs = resolve_limits(limits), codec_table()
    struct = F.struct("seq", "op", "name", "new_name", "data")
    grouped = edits.groupBy("archive_id").agg(F.sort_array(F.collect_list(struct)).alias("edits"))  # the edits of one archive
    rows = archives.select("archive_id", "content").join(grouped, "archive_id", "left")
    full = StructType().add("archive_id", archives.schema["archive_id"].dataType).add("content", "binary").add("dead_ratio", "double").add("error_code", "string")
    arrow = to_arrow_schema(full)

    def change(content: bytes, changes: list[dict]) -> tuple[bytes, float]:
        archive = Archive(Bytes(content), bounds, codecs=codecs)
        old = archive.entries
        kept, written, comment = folded([e["name"] for e in old], changes)
        untouched = {e["name"]: e["ordinal"] for e in old}
        parts: list[dict] = []
        for name, e in written.items():
            method, payload, crc = writer.compress(bytes(e["data"] or b""), "deflate", 6, codecs)
            parts.append({**writer.defaults(name.endswith("/")), "name": name.encode(), "method": method, "payload": payload, "crc": crc, "csize": len(payload), "usize": len(e["data"] or b""), "flags": UTF8, "dos_date": EPOCH_DATE, "dos_time": EPOCH_TIME, "comment": b"", "extra": b"", "layout": "buffered"})
        moved = {n: k for n, k in kept.items() if compact or untouched.get(n) != k}
        for name, k in moved.items():
            parts.append(_kept_spec(archive, old[k], None if old[k]["name"] == name else name))
        prefix = b"" if compact else content
        base = 0 if compact else archive.layout.base
        body, directory = [], []
        at = len(prefix) - base
        for e in sorted(parts, key=lambda e: e["name"]):
            head = writer.local_header(e)
            directory.append((e["name"], writer.central_header(e, at)))
            body += [head, e["payload"]]
            at += len(head) + len(e["payload"])
        live = sum(map(len, body))
        if not compact:
            where = archive.layout.cd_offset
            spans = _central_spans(content, where, len(old))
            for name, k in kept.items():
                if name not in moved:
                    directory.append((old[k]["raw_name"], content[spans[k][0] : spans[k][1]]))
                    live += old[k]["compressed_size"] + 30 + len(old[k]["raw_name"])
        tail = b"".join(x for _, x in sorted(directory, key=lambda x: x[0]))
        end = writer.trailer(len(directory), len(tail), at, archive.layout.comment if comment is None else comment)
        out = prefix + b"".join(body) + tail + end
        return out, max(0.0, 1 - (live + len(tail) + len(end)) / len(out))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(changed(stream), arrow, "content")

    def changed(stream: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in stream:
            for r in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                content, ratio, code = r["content"], 0.0, None
                if r["edits"]:
                    try:
                        content, ratio = change(bytes(content), r["edits"])
                    except ZipFault as fault:
                        content, ratio, code = None, None, fault.code
                yield {"archive_id": r["archive_id"], "content": content, "dead_ratio": ratio, "error_code": code}

    return in_arrow(rows, run, full)


def _kept_spec(archive: Archive, e: dict, new_name: str | None) -> dict:
    """A stored entry as it goes into a rewritten archive: payload and metadata kept, descriptor and Zip64 fields dropped."""
    payload = archive.payload(e)
    extra = writer.extra_block([(x["id"], x["data"]) for x in e["extra_fields"] if x["id"] != 1])
    flags = (e["flags"] & ~8) if new_name is None else (e["flags"] & (ENCRYPTED | STRONG)) | UTF8
    return {
        "name": e["raw_name"] if new_name is None else new_name.encode(), "method": e["compression_method"], "payload": payload, "crc": e["crc32"], "csize": len(payload), "usize": e["uncompressed_size"], "flags": flags,
        "dos_date": e["dos_date"], "dos_time": e["dos_time"], "external": e["external_attributes"], "internal": e["internal_attributes"], "made_by": e["version_made_by"], "needed": e["version_needed"], "comment": e["comment"], "extra": extra, "layout": "buffered",
    }


def _central_spans(content: bytes, at: int, n: int) -> list[tuple[int, int]]:
    spans = []
    for _ in range(n):
        end = at + 46 + sum(int.from_bytes(content[at + k : at + k + 2], "little") for k in (28, 30, 32))
        spans.append((at, end))
        at = end
    return spans


def dead_bytes(modified: DataFrame, bound: float = 0.5) -> DataFrame:
    """(archive_id, code) for modified archives of which more than ``bound`` is dead."""
    return modified.where(F.col("dead_ratio") > bound).select("archive_id", F.lit("ZIP_DEAD_BYTES_RATIO").alias("code"))


def canonicalize(archives: DataFrame, *, date: Column | None = None, keep_comments: bool = False, reset_attributes: bool = False, limits: dict | None = None) -> DataFrame:
    """(archive_id, content) in canonical form, without recompression; doing it again changes nothing.

    Names in UTF-8 and in order of their bytes, one pinned date, no extra fields (but those of encrypted entries), no
    comments unless kept, attributes kept unless reset. Archives that don't open or have an entry that fails its header
    checks have no row.
    """
    found = raw_payloads(archives, limits=limits, whole=True)
    dos = timestamp_to_dos(F.lit(None).cast("timestamp_ntz") if date is None else date)
    none = F.array().cast("array<struct<id: int, data: binary>>")
    rows = found.where("error_code is null").select(
        "archive_id", F.lit(None).cast("long").alias("seq"), "name", F.col("data").alias("payload"), "compression_method", "crc32", "uncompressed_size", "flags",
        dos["date"].alias("dos_date"), dos["time"].alias("dos_time"), (F.lit(None).cast("long") if reset_attributes else F.col("external_attributes")).alias("external_attributes"),
        F.lit(MADE_BY).alias("version_made_by"), F.when(F.col("is_encrypted"), F.filter("extra_fields", lambda x: x["id"] != 1)).otherwise(none).alias("extra"), "is_directory",
        (F.col("comment") if keep_comments else F.lit(b"")).alias("comment"),
    )
    plain = F.when(F.col("is_directory"), F.lit((0o40755 << 16) | 0x10)).otherwise(F.lit(0o100644 << 16))
    rows = rows.withColumn("external_attributes", F.coalesce("external_attributes", plain)).withColumn("is_directory", F.lit(False))
    return pack_raw(rows, limits=limits)
