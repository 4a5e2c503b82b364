"""Writing archives: pack rows, transplant stored payloads, assemble or stream the bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel import writer
from ..kernel.codecs import codec_table
from ..plans.archive import planned, validated
from ..session import in_arrow
from ..vocabulary import ENCRYPTED, MADE_BY, STRONG
from .content import raw_payloads

#: What a record kernel needs of an entry.
SPEC = "raw_name binary, method_id int, payload binary, crc long, csize long, usize long, flags int, dos_date int, dos_time int, external long, internal int, made_by int, needed int, comment binary, extra_block binary, layout string"
_FIELDS = [x.split()[0] for x in SPEC.split(", ")]


def _map(df: DataFrame, new: str, kernel, uses: list[str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``df`` (but ``drop``) and ``new`` ones that ``kernel(row)`` gives; only the columns it ``uses`` become Python objects."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = StructType.fromDDL(new)
    full = StructType([f for f in df.schema if f.name not in drop and f.name not in made.names] + list(made))
    arrow, added = to_arrow_schema(full), to_arrow_schema(made)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                rows = [kernel(r) for r in part.select([at[c] for c in uses]).to_pylist()]
                fresh = pa.Table.from_pylist(rows, added)
                columns = [fresh.column(f.name).combine_chunks() if f.name in added.names else part.column(at[f.name]).cast(f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return in_arrow(df, run, full)


def stop_at_errors(rows: DataFrame) -> DataFrame:
    """Fail the job, before anything is written, at a row with an error_code."""
    name = F.concat_ws(" ", F.col("error_code"), F.lit("entry"), F.col("name"))
    return rows.withColumn("raw_name", F.when(F.col("error_code").isNotNull(), F.raise_error(name).cast("binary")).otherwise(F.col("raw_name"))).drop("error_code")


def packed_specs(rows: DataFrame, *, limits: dict | None = None) -> DataFrame:
    """Compressed entries of (archive_id, name, data, [options]) rows; see ``plans.archive.OPTIONS``."""
    codecs = codec_table()
    fine = stop_at_errors(validated(rows, limits))

    def kernel(r: dict) -> dict:
        data = bytes(r["data"] or b"")
        if r["layout"] == "buffered":
            method, payload, crc = writer.compress(data, r["method"], r["level"], codecs)
        else:  # a streamed entry is compressed before its size is known
            import zlib

            method, crc = (8, zlib.crc32(data)) if r["method"] == "deflate" else (0, zlib.crc32(data))
            payload = codecs[method].compress(data, r["level"])
        extra = writer.extra_block([(x["id"], x["data"]) for x in r["extra"] or []])
        return {
            "method_id": method, "payload": payload, "crc": crc, "csize": len(payload), "usize": len(data), "flags": writer.written_flags(r["layout"]), "internal": 0, "made_by": MADE_BY, "needed": 0,
            "extra_block": extra, "comment": bytes(r["comment"] or b""),
        }

    keep = fine.select("archive_id", "seq", "name", "raw_name", "data", "method", "level", "layout", "extra", "comment", "dos_date", "dos_time", "external")
    return _map(keep, "method_id int, payload binary, crc long, csize long, usize long, flags int, internal int, made_by int, needed int, extra_block binary, comment binary", kernel, ["data", "method", "level", "layout", "extra", "comment"], ("data", "method", "level", "extra"))


def segments(specs: DataFrame, *, canonical: bool = True) -> DataFrame:
    """(archive_id, position, offset, local, payload, trail, central): the bytes of each entry and where they go."""

    hidden, wide, most = F.col("layout") != "buffered", F.col("layout") == "descriptor64", 0xFFFFFFFE
    large = wide | (~hidden & (F.greatest("csize", "usize") > most))
    head = 30 + F.octet_length("raw_name") + F.octet_length("extra_block") + F.when(large, 20).otherwise(0)
    length = head + F.octet_length("payload") + F.when(wide, 24).when(hidden, 16).otherwise(0)
    rows = planned(specs.select("archive_id", "seq", "name", *_FIELDS).withColumn("seg_length", length.cast("long")), canonical=canonical)

    def records(r: dict) -> dict:
        e = _spec(r)
        return {"local": writer.local_header(e), "trail": writer.descriptor(e), "central": writer.central_header(e, r["offset"])}

    uses = [c for c in _FIELDS if c != "payload"] + ["offset"]
    return _map(rows, "local binary, trail binary, central binary", records, uses).select("archive_id", "position", "offset", "local", "payload", "trail", "central")


def _spec(r: dict) -> dict:
    return {**r, "name": bytes(r["raw_name"]), "method": r["method_id"], "extra": bytes(r["extra_block"] or b""), "comment": bytes(r["comment"] or b"")}


def assemble(parts: DataFrame, *, comments: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """(archive_id, content): each archive's segments in order, its directory, its trailer. One archive meets in one task.

    ``comments``: (archive_id, archive_comment); ``prefixes``: (archive_id, prefix) that goes before. Archives of 1 GiB
    and more should be written from ``segments`` instead.
    """
    out = parts
    if comments is not None:
        out = out.join(comments.select("archive_id", "archive_comment"), "archive_id", "left")
    else:
        out = out.withColumn("archive_comment", F.lit(None).cast("binary"))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["position"])
        body = b"".join(x for r in rows for x in (r["local"], r["payload"], r["trail"]))
        directory = b"".join(r["central"] for r in rows)
        content = body + directory + writer.trailer(len(rows), len(directory), len(body), rows[0]["archive_comment"] or b"")
        return pa.table({"archive_id": table.column("archive_id").slice(0, 1), "content": pa.array([content], pa.binary())})

    return out.groupBy("archive_id").applyInArrow(join, f"archive_id {parts.schema['archive_id'].dataType.simpleString()}, content binary")


def pack(rows: DataFrame, *, canonical: bool = True, comments: DataFrame | None = None, limits: dict | None = None) -> DataFrame:
    """(archive_id, content) from (archive_id, name, data, [options]) rows.

    Canonical order is that of the names' bytes, else that of ``seq``. Rows that may not be written fail the job before
    anything is. The bytes follow from the rows alone, at any partitioning.
    """
    return assemble(segments(packed_specs(rows, limits=limits), canonical=canonical), comments=comments)


def file_name(archive_id: object) -> str:
    """A name in the target folder for any archive_id: a plain one as it is, others (paths, dots in front, null) by their hash."""
    import hashlib
    import re

    text = "" if archive_id is None else str(archive_id)
    if re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9._-]{0,99}", text) and not re.fullmatch("[0-9a-f]{64}", text):
        return f"{text}.zip"
    return f"{hashlib.sha256((b'' if archive_id is None else b'=') + text.encode()).hexdigest()}.zip"


def write_archives(parts: DataFrame, folder: str, *, chunk: int = 1 << 20) -> DataFrame:
    """Write ``segments`` rows to one file an archive below ``folder``, piece by piece; (archive_id, path, length) when it is run.

    No task ever holds an archive: its rows come sorted, payloads are passed on as they come, and only the directory is
    kept to the end. A file takes its name when it is complete, so a repeated task leaves no half one; it is archive_id if
    that is a plain file name, else a hash of it (see ``file_name``), never a place outside of ``folder``. ``folder`` is a place that all executors share, of any file system that Arrow knows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = f"archive_id {parts.schema['archive_id'].dataType.simpleString()}, path string, length long"
    rows = parts.select("archive_id", "position", "local", "payload", "trail", "central").repartition("archive_id").sortWithinPartitions("archive_id", "position")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        now, sink, done, directory, size, n, part = None, None, [], [], 0, 0, ""

        def finish() -> None:
            tail = b"".join(directory)
            end = writer.trailer(n, len(tail), size)
            sink.write(tail + end)
            sink.close()
            final = f"{root}/{file_name(now)}"
            system.move(part, final)
            done.append({"archive_id": now, "path": final, "length": size + len(tail) + len(end)})

        for batch in stream:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                if r["archive_id"] != now or sink is None:
                    if sink is not None:
                        finish()
                    now, directory, size, n, part = r["archive_id"], [], 0, 0, f"{root}/.{uuid.uuid4().hex}"
                    sink = system.open_output_stream(part, buffer_size=chunk)
                for piece in (r["local"], r["payload"], r["trail"]):
                    sink.write(piece)
                    size += len(piece)
                directory.append(r["central"])
                n += 1
        if sink is not None:
            finish()
        yield from pa.Table.from_pylist(done, arrow).to_batches()

    arrow = to_arrow_schema(StructType.fromDDL(out))
    return in_arrow(rows, run, out)


def pack_raw(rows: DataFrame, *, canonical: bool = True, comments: DataFrame | None = None, limits: dict | None = None) -> DataFrame:
    """As ``pack``, of payloads that are compressed already: (archive_id, name, payload, compression_method, crc32, uncompressed_size, [flags, version_needed, options])."""
    return assemble(segments(raw_specs(rows, limits=limits), canonical=canonical), comments=comments)


def raw_specs(rows: DataFrame, *, limits: dict | None = None) -> DataFrame:
    has = set(rows.columns)
    for c in ("dos_date", "dos_time"):
        if c in has:
            rows = rows.withColumnRenamed(c, f"_{c}")
    fine = stop_at_errors(validated(rows.drop("method"), limits))
    extra = F.coalesce("extra", F.array().cast("array<struct<id: int, data: binary>>"))
    block = F.aggregate(extra, F.lit(b""), lambda a, x: F.concat(a, _u16(x["id"]), _u16(F.octet_length(x["data"])), x["data"]))
    optional = lambda c, default: F.col(c) if c in has else F.lit(default)
    return fine.select(
        "archive_id", "seq", "name", "raw_name", F.col("compression_method").alias("method_id"), "payload", F.col("crc32").alias("crc"), F.octet_length("payload").cast("long").alias("csize"),
        F.col("uncompressed_size").alias("usize"), optional("flags", 0).bitwiseAND(ENCRYPTED | STRONG).bitwiseOR(0x0800).cast("int").alias("flags"), *[F.col(f"_{c}" if c in has else c).cast("int").alias(c) for c in ("dos_date", "dos_time")],
        (F.col("external_attributes") if "external_attributes" in has else F.col("external")).alias("external"), optional("internal_attributes", 0).cast("int").alias("internal"),
        optional("version_made_by", MADE_BY).cast("int").alias("made_by"), optional("version_needed", 0).cast("int").alias("needed"), F.coalesce("comment", F.lit(b"")).alias("comment"), block.alias("extra_block"), F.lit("buffered").alias("layout"),
    )


def _u16(value):
    """Two little-endian bytes of a number."""
    text = F.lpad(F.hex(value.cast("long")), 4, "0")
    return F.unhex(F.concat(F.substring(text, 3, 2), F.substring(text, 1, 2)))


def transplant(archives: DataFrame, *, verify: bool = True, limits: dict | None = None, where=None) -> DataFrame:
    """Entries with their stored payloads, ready for ``pack_raw``: merge, split and repack are unions and filters of these.

    Encrypted entries are refused (error_code); with ``verify`` contents are decoded first and broken ones refused.
    """
    found = raw_payloads(archives, where=where, limits=limits, verify=verify)
    code = F.when(F.col("is_encrypted"), "ZIP_UNSUPPORTED_ENCRYPTION").otherwise(F.col("error_code"))
    kept = F.filter("extra_fields", lambda x: x["id"] != 1)
    return found.select(
        "archive_id", F.col("ordinal").cast("long").alias("seq"), "name", F.col("data").alias("payload"), "compression_method", "crc32", "uncompressed_size", F.lit(0).alias("flags"), "version_needed",
        "dos_date", "dos_time", "external_attributes", "comment", kept.alias("extra"), code.alias("error"),
    )


def split_chunks(packed: DataFrame, size: int = 65_536) -> DataFrame:
    """(archive_id, seq, chunk) of packed archives, in chunks of 1 KiB to 16 MiB."""
    if not isinstance(size, int) or size <= 0:
        raise ValueError("ZIP_INVALID_OPTION: a chunk has a positive size")
    size = min(max(size, 1024), 16 << 20)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("content"), k * size + 1, F.lit(size)))
    return packed.select("archive_id", F.posexplode(cut).alias("seq", "chunk"))
