"""Queries over archives that no writer would make: lies, hostile names, odd fields, with SQL that states what must come of each.

Every row of a driver's table becomes one archive, laid out by hand in a shape that follows from its key; the SQL knows
the shapes, not the bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .functions import encryption_scheme, extended_timestamps, ratio
from .kernel.codecs import register_codec
from .kernel.crafted import deflate, raw_zip
from .operators.write import packed_specs
from .session import in_arrow, shared_folder
from .sources import read_archives, register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crafted(rows: DataFrame, make: Callable[[dict], bytes]) -> DataFrame:
    """(archive_id, content): the archive that ``make`` lays out for each row; archive_id is one of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["archive_id"] for r in part], pa.string()), pa.array([make(r) for r in part], pa.binary())], ["archive_id", "content"])

    return in_arrow(rows, run, "archive_id string, content binary")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("archive_id"), F.col("doc_id").alias("id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


def _case(column: str, values: list, n: int | None = None) -> str:
    """SQL: the value for each remainder of ``column``."""
    quoted = ["null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in values]
    return f"case {column} % {n or len(values)} " + " ".join(f"when {k} then {v}" for k, v in enumerate(quoted)) + " end"


# Opening.


def _layouts(r: dict) -> bytes:
    one, two = {"name": "a.txt", "data": r["data"], "method": 8}, {"name": "b.txt", "data": b"b"}
    plain = raw_zip([one, two], comment=b"note")
    return [
        lambda: plain, lambda: b"no archive at all, only some text", lambda: raw_zip([one, two], zip64=True), lambda: raw_zip([one, two], zip64=True, drop_record=True),
        lambda: raw_zip([one, two], zip64=True, zip64_entries_lie=3), lambda: raw_zip([one, two], prepend=b"#!/bin/sh\n" * 3), lambda: raw_zip([one, two], cd_offset_lie=1 << 30),
        lambda: raw_zip([one, two], entries_lie=0xFFFF), lambda: plain[:-1], lambda: raw_zip([one, two], append=b"more"), lambda: raw_zip([]), lambda: plain[:21],
    ][r["id"] % 12]()


_OPENED = {
    "error_code": [None, "ZIP_EOCD_NOT_FOUND", None, "ZIP_ZIP64_EOCD_MISPLACED", "ZIP_ZIP64_CONTRADICTION", None, "ZIP_EOCD_INCONSISTENT", "ZIP_ZIP64_LOCATOR_MISSING", "ZIP_EOCD_NOT_FOUND", "ZIP_EOCD_NOT_FOUND", None, "ZIP_EOCD_NOT_FOUND"],
    "total_entries": [2, None, 2, None, None, 2, None, None, None, None, 0, None],
    "is_zip64": [False, None, True, None, None, False, None, None, None, None, False, None],
    "base": [0, None, 0, None, None, 30, None, None, None, None, 0, None],
    "note": ["note", None, "", None, None, "", None, None, None, None, "", None],
}


def open_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.layout(crafted(_documents(spark, sf_dir), _layouts))
    known = lambda c, default: F.coalesce(c, F.lit(default)).alias(c)
    return found.select("archive_id", "error_code", known("total_entries", -1), known("is_zip64", False), known("base", -1), F.col("comment").cast("string").alias("note"))


def refused_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader of contents gives an archive that doesn't open one row with its code, and the others their entries."""
    made = crafted(_documents(spark, sf_dir), _layouts)
    shape = lambda f, how: f.groupBy("archive_id").agg(F.lit(how).alias("reader"), F.max("error_code").alias("error_code"), F.count("name").alias("entries"))
    moved = op.transplant(made).withColumnRenamed("error", "error_code")
    return shape(op.read_entries(made), "contents").unionAll(shape(op.raw_payloads(made), "payloads")).unionAll(shape(moved, "transplant"))


def canonical_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hostile and sound archives the sound ones come out in canonical form."""
    out = op.canonicalize(crafted(_documents(spark, sf_dir), _layouts))
    return op.read_entries(out).select("archive_id", "ordinal", "name", F.md5("data").alias("md5"), "error_code")


def _flaws(r: dict) -> bytes:
    one, two = {"name": "a.txt", "data": r["data"] + b"x", "method": 8}, {"name": "b.txt", "data": b"b"}
    path = struct.pack("<2HBL", 0x7075, 10, 1, 0) + b"other"
    shapes = [
        [one, two], [one, {**two, "name": "a.txt"}], [{**one, "extra_central": path}, two], [{**one, "extra_central": b"\1\0\x40\0x"}, two],
        [{**one, "name": b"\xff\xfe", "flags": 0x800}, two], [{**one, "extra_central": struct.pack("<2HQ", 1, 8, 5)}, two], [{**one, "lfh_name_lie": b"z.txt"}, two],
        [one, {**two, "offset_lie": 0}], [{**one, "lfh_method_lie": 0}, two], [{**one, "lfh_crc_lie": 1}, two], [{**one, "usize_lie": 2 << 30}, two],
    ]
    k = r["id"] % 12
    return raw_zip([one, two], entries_lie=9) if k == 11 else raw_zip(shapes[k])


_REMARKS = [None, "ZIP_DUPLICATE_NAME", "ZIP_UNICODE_PATH_CONFLICT", "ZIP_EXTRA_FIELD_MALFORMED", "ZIP_INVALID_UTF8_NAME", "ZIP_ZIP64_EXTRA_IGNORED", "ZIP_NAME_MISMATCH", "ZIP_ENTRY_OVERLAP", "ZIP_CD_LFH_MISMATCH", "ZIP_SIZE_MISMATCH", "ZIP_LIMIT_EXCEEDED", "ZIP_CD_INCONSISTENT"]


def open_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.diagnostics(crafted(_documents(spark, sf_dir), _flaws), validate="eager").select("archive_id", "seq", "code", "severity")


def strict_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.diagnostics(crafted(_documents(spark, sf_dir), _flaws), validate="eager", strict=True).select("archive_id", "code", "severity")


def hostile_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.verify_archives(crafted(_documents(spark, sf_dir), _flaws)).select("archive_id", "ok", "error_code", "entry_count", "failed")


# Fields of entries.


def extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, owners and Zip64 sizes as extra fields carry them, from the columns of orders."""

    def make(r: dict) -> bytes:
        ut = struct.pack("<2HBll", 0x5455, 9, 3, r["seconds"], -r["id"])
        ntfs = struct.pack("<2HL2H3Q", 0x000A, 32, 0, 1, 24, *[(r["seconds"] + k + 11_644_473_600) * 10_000_000 for k in range(3)])
        ux = struct.pack("<2H2BLBQ", 0x7875, 15, 1, 4, r["owner"], 8, r["id"])
        large = struct.pack("<2HQ", 1, 8, len(r["data"]))
        extra = (ut if r["id"] % 2 else b"") + (ntfs if r["id"] % 3 else b"") + (ux if r["id"] % 5 else b"") + (large if r["id"] % 7 == 0 else b"")
        return raw_zip([{"name": "order", "data": r["data"], "extra_central": extra, **({"usize_lie": 0xFFFFFFFF} if r["id"] % 7 == 0 else {})}])

    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("archive_id"), F.col("o_orderkey").alias("id"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("seconds"), F.col("o_custkey").alias("owner"), F.encode("o_orderpriority", "UTF-8").alias("data"))
    found = op.entries(crafted(rows, make)).withColumn("t", extended_timestamps())
    known = [F.coalesce(c, F.lit(0)).alias(c) for c in ("ut_mtime", "ut_atime", "ntfs_mtime", "ntfs_ctime", "uid", "gid")]
    return found.select(
        "archive_id", *known, "uses_zip64", "uncompressed_size",
        F.col("t.source").alias("source"), F.unix_seconds("t.mtime").alias("mtime"), F.size("extra_fields").alias("fields"),
    )


_CP437 = bytes(range(128, 256)).decode("cp437")


def legacy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in the old code page, and the same bytes through a caller's decoder."""
    rows = _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("archive_id"), F.col("p_partkey").alias("id"))
    made = crafted(rows, lambda r: raw_zip([{"name": b"n" + bytes([128 + r["id"] % 128]) + b".txt"}]))
    plain = op.entries(made).select("archive_id", "name", "name_encoding")
    hooked = op.entries(made, name_decoder=lambda raw: raw.decode("iso-8859-1")).select("archive_id", F.ascii(F.substring("name", 2, 1)).alias("code"), F.col("name_encoding").alias("hooked"))
    return plain.join(hooked, "archive_id")


def encrypted_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes by flags, method and fields; contents are refused, listing and verifying go on."""
    aes = struct.pack("<2H", 0x9901, 7) + b"\2\0AE\3\0\0"
    shapes = [{}, {"flags": 1}, {"flags": 0x41}, {"flags": 1, "method": 99}, {"flags": 1, "extra_central": aes}]
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "e", "data": r["data"], **shapes[r["id"] % 5]}]))
    listed = op.entries(made).select("archive_id", "is_encrypted", encryption_scheme().alias("scheme"))
    read = op.read_entries(made).select("archive_id", "error_code")
    seen = op.verify_archives(made).select("archive_id", "ok")
    return listed.join(read, "archive_id").join(seen, "archive_id")


def duplicate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entries of one name the last is found; every one is listed and remarked."""

    def make(r: dict) -> bytes:
        return raw_zip([{"name": n, "data": d} for n, d in zip(r["names"], r["values"], strict=True)])

    rows = _table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), F.col("o_custkey")).alias("archive_id")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.concat(F.lit("s"), "o_orderstatus").alias("n")))).alias("x"))  # the orders of one customer
    made = crafted(rows.select("archive_id", F.col("x.n").alias("names"), F.transform("x.o_orderkey", lambda k: F.encode(k.cast("string"), "UTF-8")).alias("values")), make)
    found = op.point_lookup(op.entries(made), "sO").select("archive_id", "ordinal")
    values = op.read_entries(made, ordinals=found).select("archive_id", F.col("data").cast("string").alias("value"))
    repeats = op.diagnostics(made).where("code = 'ZIP_DUPLICATE_NAME'").groupBy("archive_id").agg(F.count("*").alias("repeats"))
    return found.join(values, "archive_id").join(repeats, "archive_id", "left").select("archive_id", "ordinal", "value", F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"))


# Contents.


def broken_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a payload, by its code."""

    def make(r: dict) -> bytes:
        data = r["data"] * 4 + b"padding that is long enough to be cut"
        packed, n = deflate(data), len(data)
        lie = [{}, {"payload": packed[:-3]}, {"payload": b"\xff" + packed[1:]}, {"usize_lie": n - 1}, {"usize_lie": n + 1}, {"crc_lie": zlib.crc32(data) ^ 1}, {"method": 12}][r["id"] % 7]
        return raw_zip([{"name": "e", "data": data, "method": 8, **lie}])

    return op.read_entries(crafted(_documents(spark, sf_dir), make)).select("archive_id", "ordinal", "error_code", F.coalesce(F.octet_length("data"), F.lit(-1)).alias("length"))


def declared_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds on what is declared hold before anything is decoded."""
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "e" * (1 + r["id"] % 3 * 30), "data": r["data"]}]))
    read = op.read_entries(made, limits={"max_entry_uncompressed_size": 1500, "max_name_bytes": 60})
    return read.select("archive_id", "error_code", F.coalesce(F.octet_length("data"), F.lit(-1)).alias("length"))


def declared_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compression ratios, of entries with a KiB or more, and what a bound of 2 lets through."""
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "e", "data": r["data"], "usize_lie": len(r["data"]) * (1 + r["id"] % 3)}]))
    listed = op.entries(made).select("archive_id", F.coalesce(F.round(ratio(), 6), F.lit(0.0)).alias("ratio"))
    errors = op.read_entries(made, limits={"max_compression_ratio": 2}).select("archive_id", "error_code")
    return listed.join(errors, "archive_id")


class _Reversed:
    """Method 200: the bytes backwards; it picks up where the built-in codecs end."""

    method, name = 200, "reversed"

    def decompress(self, data: bytes, most: int) -> bytes:
        return data[::-1]


def custom_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered codec travels with the tasks."""
    register_codec(_Reversed())
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "e", "data": r["data"][::-1], "method": 200 if r["id"] % 2 else 201, "crc_lie": zlib.crc32(r["data"])}]))
    return op.read_entries(made).select("archive_id", F.md5("data").alias("md5"), "error_code")


def extract_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories are passed over; links come out as their text where they are let through; unsafe names are skipped."""
    link = {"attributes": 0o120777 << 16}

    def make(r: dict) -> bytes:
        return raw_zip([{"name": "dir/"}, {"name": "dir\\sub/./f.txt", "data": r["data"]}, {"name": "link", "data": b"dir", **link}, {"name": "../up", "data": b"u"}, {"name": "flag", "attributes": 0x10}])

    made = crafted(_documents(spark, sf_dir), make)
    return op.extract(made, reject_symlinks=False, on_unsafe="skip").select("archive_id", "ordinal", "path", F.md5("data").alias("md5"), "error_code")


def extract_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason not to extract an archive."""
    link = {"name": "link", "data": b"x", "attributes": 0o120777 << 16}
    shapes = [[{"name": "ok"}], [{"name": "ok"}, {"name": "../up"}], [{"name": "lpt3.log"}], [{"name": "same"}, {"name": "./same"}], [link, {"name": "ok"}]]
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"data": b"1", **e} for e in shapes[r["id"] % 5]]))
    return op.extract(made).select("archive_id", "ordinal", "path", "error_code")


def extract_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "t.txt", "data": r["data"], "method": 8}]))
    return op.extract(made, chunk=700).select("archive_id", "path", "chunk_no", F.md5("data").alias("md5"), F.octet_length("data").alias("length"), "error_code")


# Front to back.


def forward_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of known size: read and checked, or stepped over."""
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "a", "data": r["data"], "method": 8 * (r["id"] % 2)}, {"name": "b/"}, {"name": "c", "data": b"tail", **({"corrupt_at": 1} if r["id"] % 3 == 0 else {})}]))
    read = op.forward_entries(made, with_data=True).select("archive_id", "ordinal", "name", F.md5("data").alias("md5"), "error_code")
    passed = op.forward_entries(made, decode=False).select("archive_id", "ordinal", F.col("uncompressed_size").alias("declared"), F.col("error_code").alias("passed"))
    return read.join(passed, ["archive_id", "ordinal"])


def forward_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader without the directory can't tell: stored or encrypted entries of hidden length; locked and unknown ones are stepped over."""
    shapes = [{"descriptor": "signed"}, {"descriptor": "signed", "flags": 1, "method": 8}, {"flags": 1}, {"method": 12}, {"descriptor": "signless64", "method": 8}, {"descriptor": "signless", "method": 8, "d_crc_lie": 7}]
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "a", "data": r["data"] + b".", **shapes[r["id"] % 6]}, {"name": "b", "data": b"b"}]))
    return op.forward_entries(made).select("archive_id", "ordinal", "name", "error_code")


def trust_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of which the two readers see different things."""
    shapes = [{}, {"lfh_name_lie": b"z"}, {"lfh_name_lie": b"a/b"}]
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "a", "data": r["data"], **shapes[r["id"] % 3]}]))
    return op.trust_differences(made).select("archive_id", "directory_name", "stream_name", "differs")


def profile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures from the container profile, one or two in each shape."""
    zip64 = struct.pack("<2HQQ", 1, 16, 0, 0)
    shapes = [
        {}, {"method": 12}, {"flags": 1}, {"flags": 0x2000}, {"descriptor": "signed"}, {"descriptor": "signed64"}, {"descriptor": "signless", "d_crc_lie": 7}, {"lfh_name_lie": b"z"}, {"lfh_crc_lie": 7},
        {"descriptor": "signed64", "extra_local": zip64}, {"name": b"\x81"}, {"lfh_method_lie": 8},
    ]

    def make(r: dict) -> bytes:
        k = r["id"] % 14
        if k < 12:
            return raw_zip([{"name": "a", "data": r["data"] + b"x", **shapes[k]}])
        if k == 12:  # an archive extra-data record before the directory
            inner = raw_zip([{"name": "a", "data": r["data"]}])
            at = inner.rindex(b"PK\1\2")
            return inner[:at] + b"PK\6\x08\0\0\0\0" + inner[at:-6] + struct.pack("<L", at + 8) + inner[-2:]
        whole = raw_zip([{"name": "a", "data": r["data"]}])
        return whole[:-14] + struct.pack("<2H", 2, 1) + whole[-10:]  # more entries on this disk than in all

    return op.iso_findings(crafted(_documents(spark, sf_dir), make)).select("archive_id", "finding")


# Writing and changing.


def plan_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may not be written is known before anything is."""
    from .plans.archive import validated

    k = F.col("p_partkey") % 7
    name = F.when(k == 1, "../up").when(k == 2, F.repeat(F.lit("n"), 5000)).when(k == 3, "same").otherwise(F.concat(F.lit("n"), F.col("p_partkey")))
    rows = _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.concat(F.lit("a"), F.floor(F.col("p_partkey") / 50)).alias("archive_id"), name.alias("name"), F.encode("p_name", "UTF-8").alias("data"), F.when(k == 4, 11).otherwise(6).alias("level"),
        F.when(k == 5, "lzma").otherwise("deflate").alias("method"), F.encode(F.when(k == 6, F.repeat(F.lit("c"), 70000)), "UTF-8").alias("comment"),
    )
    return validated(rows).select("seq", "error_code")


def archive_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _table(spark, sf_dir, "customer").withColumn("archive_id", F.concat(F.lit("n"), F.col("c_nationkey")))
    notes = _table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("archive_id"), F.encode("n_name", "UTF-8").alias("archive_comment"))
    packed = op.pack(customers.select("archive_id", F.col("c_name").alias("name"), F.encode("c_mktsegment", "UTF-8").alias("data"), F.encode("c_mktsegment", "UTF-8").alias("comment")), comments=notes)
    whole = op.layout(packed).select("archive_id", F.col("comment").cast("string").alias("note"))
    return op.entries(packed).select("archive_id", "name", F.col("comment").cast("string").alias("remark")).join(whole, "archive_id")


def dead_bytes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of which an appended overlay leaves more than half dead."""
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "big", "data": r["data"] + b"#" * 5000}, {"name": "small", "data": b"s"}]))
    edits = _documents(spark, sf_dir).where("id % 2 = 0").select("archive_id", F.lit(1).alias("seq"), F.lit("remove").alias("op"), F.when(F.col("id") % 4 == 0, "big").otherwise("small").alias("name"), F.lit(None).cast("string").alias("new_name"), F.lit(None).cast("binary").alias("data"))
    return op.dead_bytes(op.modify(made, edits))


def encrypted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked entries are renamed and moved unread: the payload stays as it is."""
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "locked", "data": r["data"], "flags": 1}, {"name": "open", "data": b"o"}]))
    edits = _documents(spark, sf_dir).select("archive_id", F.lit(1).alias("seq"), F.lit("rename").alias("op"), F.lit("locked").alias("name"), F.lit("sealed").alias("new_name"), F.lit(None).cast("binary").alias("data"))
    moved = op.modify(made, edits, compact=True).where("error_code is null").select("archive_id", "content")
    return op.raw_payloads(moved).select("archive_id", "ordinal", "name", "is_encrypted", F.md5("data").alias("md5"), "error_code")


def edit_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that contradict the archive leave it out, with the reason."""
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "a", "data": r["data"]}, {"name": "b"}]))
    k = F.col("id") % 4
    kind = F.when(k == 0, "add").when(k == 1, "remove").when(k == 2, "rename").otherwise("replace")
    edits = _documents(spark, sf_dir).select("archive_id", F.lit(1).alias("seq"), kind.alias("op"), F.when(k == 1, "c").otherwise("a").alias("name"), F.lit("b").alias("new_name"), F.encode(F.lit("new"), "UTF-8").alias("data"))
    return op.modify(made, edits).select("archive_id", "error_code", F.col("content").isNotNull().alias("written"))


def entry_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty entries of the long documents, by archive and name."""
    made = crafted(_documents(spark, sf_dir), lambda r: raw_zip([{"name": "first", "data": r["data"]}, {"name": "second"}]))
    return op.entries(made).where("uncompressed_size > 1000").orderBy("archive_id", "ordinal").offset(40).limit(20).select("archive_id", "name", "uncompressed_size")


# Files.


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """What is written to one file for each conversation, and the folder."""
    folder = shared_folder(spark)
    chats = _table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id")).alias("archive_id"), F.concat(F.lit("t"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("name"), F.encode("text", "UTF-8").alias("data"))
    return op.write_archives(op.segments(packed_specs(chats)), folder), folder


def ranged_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written as files and read by ranges: every content, and the length of the file it lies in."""
    written, folder = _files(spark, sf_dir)
    written = written.select("archive_id", F.element_at(F.split("path", "/"), -1).alias("file"), "length").collect()  # one small row a file
    lengths = spark.createDataFrame([tuple(r) for r in written], "archive_id string, file string, length long")
    found = op.read_entries(read_archives(spark, folder, ranged=True)).select(F.element_at(F.split("archive_id", "/"), -1).alias("file"), "name", F.md5("data").alias("md5"), "error_code")
    sizes = op.layout(read_archives(spark, folder, ranged=True)).select(F.element_at(F.split("archive_id", "/"), -1).alias("file"), "file_length")
    return found.join(sizes, "file").join(lengths, "file").select("archive_id", "name", "md5", "error_code", (F.col("length") == F.col("file_length")).alias("whole"))


def source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data source over a folder: names go down to the reader, contents come by ranges."""
    written, folder = _files(spark, sf_dir)
    written.write.format("noop").mode("overwrite").save()
    register(spark)
    found = spark.read.format("arcframe").option("data", "true").load(folder).where("name in ('t000000', 't000001')")
    return found.select(F.regexp_extract("archive_id", "([^/]+)[.]zip$", 1).alias("archive_id"), "name", "uncompressed_size", F.md5("data").alias("md5"), "error_code")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        open_refusals, refused_archives, canonical_survivors, open_diagnostics, strict_diagnostics, hostile_verdicts, extra_fields, legacy_names, encrypted_entries, duplicate_lookup, broken_contents, declared_limits, declared_ratios,
        custom_codec, extract_tree, extract_refusals, extract_streamed, forward_buffered, forward_refusals, trust_conflicts, profile_findings, plan_refusals, archive_comments, dead_bytes_report, encrypted_copies, edit_refusals, entry_page, ranged_reads, source_filters,
    )
}

_D = "d as (select 'd' || doc_id archive_id, doc_id id, coalesce(text, '') t, octet_length(encode(coalesce(text, ''))) n from documents)"
_OPEN = ", ".join(f"{_case('id', values)} {name}" for name, values in _OPENED.items())
_SOUND = [v is None for v in _OPENED["error_code"]]
_SEVERITY = _case("id", [None, *["warning"] * 6, *["error"] * 5])

ORACLE_SQL: dict[str, str] = {
    "open_refusals": f"with {_D}, x as (select archive_id, {_OPEN} from d) select archive_id, error_code, coalesce(total_entries, -1)::bigint total_entries, coalesce(is_zip64, false) is_zip64, coalesce(base, -1)::bigint base, note from x",
    "refused_archives": f"with {_D}, x as (select archive_id, {_OPEN} from d) select archive_id, reader, error_code, coalesce(total_entries, 0)::bigint entries from x, (select unnest(['contents', 'payloads', 'transplant']) reader) where error_code is not null or total_entries > 0",
    "canonical_survivors": f"with {_D}, x as (select *, {_case('id', _OPENED['total_entries'])} k from d), e as (select archive_id, unnest([0, 1]) ordinal, t from x where k = 2) select archive_id, ordinal::int ordinal, case ordinal when 0 then 'a.txt' else 'b.txt' end as name, md5(case ordinal when 0 then t else 'b' end) md5, null::varchar error_code from e",
    "open_diagnostics": f"with {_D} select archive_id, 0 seq, {_case('id', _REMARKS)} code, {_SEVERITY} severity from d where id % 12 <> 0",
    "strict_diagnostics": f"with {_D} select archive_id, case when id % 12 < 7 then 'ZIP_STRICT_DIAGNOSTIC' else {_case('id', _REMARKS)} end code, 'error' severity from d where id % 12 <> 0",
    "hostile_verdicts": f"""with {_D}, x as (select *, id % 12 k from d) select archive_id, k < 7 ok, case k when 7 then 'ZIP_ENTRY_OVERLAP' when 11 then 'ZIP_CD_INCONSISTENT' end error_code,
  case when k in (7, 11) then 0 else 2 end::bigint entry_count, case when k in (8, 9, 10) then 1 else 0 end::bigint failed from x""",
    "extra_fields": """with o as (select *, o_orderkey id, epoch_us(o_orderdate) // 1000000 s, octet_length(encode(o_orderpriority)) n from orders)
select 'o' || id archive_id, case when id % 2 = 1 then s else 0 end::bigint ut_mtime, case when id % 2 = 1 then -id else 0 end::bigint ut_atime, case when id % 3 <> 0 then s * 1000 else 0 end::bigint ntfs_mtime, case when id % 3 <> 0 then (s + 2) * 1000 else 0 end::bigint ntfs_ctime,
  case when id % 5 <> 0 then o_custkey else 0 end::bigint uid, case when id % 5 <> 0 then id else 0 end::bigint gid, id % 7 = 0 uses_zip64, n::bigint uncompressed_size, case when id % 2 = 1 then 'ut' when id % 3 <> 0 then 'ntfs' else 'dos' end source,
  case when id % 6 <> 0 then s else epoch_us(timestamp '1980-01-01') // 1000000 end::bigint mtime, ((id % 2 <> 0)::int + (id % 3 <> 0)::int + (id % 5 <> 0)::int + (id % 7 = 0)::int)::int fields from o""",
    "legacy_names": f"select 'p' || p_partkey archive_id, 'n' || substr('{_CP437}', (p_partkey % 128 + 1)::bigint, 1) || '.txt' as name, 'cp437' name_encoding, (128 + p_partkey % 128)::int code, 'custom' hooked from part",
    "encrypted_entries": f"with {_D} select archive_id, id % 5 <> 0 is_encrypted, {_case('id', [None, 'zipcrypto', 'strong', 'aes', 'aes'])} scheme, case when id % 5 <> 0 then 'ZIP_UNSUPPORTED_ENCRYPTION' end error_code, true ok from d",
    "duplicate_lookup": """with o as (select 'c' || o_custkey archive_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 ordinal, o_orderkey::varchar as value, o_orderstatus s from orders),
r as (select archive_id, (count(*) - count(distinct s))::bigint repeats from o group by 1), l as (select archive_id, max(ordinal) ordinal from o where s = 'O' group by 1)
select archive_id, ordinal::int ordinal, value, repeats from l join o using (archive_id, ordinal) join r using (archive_id)""",
    "broken_contents": f"with {_D} select archive_id, 0 ordinal, {_case('id', [None, 'ZIP_DEFLATE_TRUNCATED', 'ZIP_DEFLATE_CORRUPT', 'ZIP_INFLATE_OUTPUT_OVERFLOW', 'ZIP_SIZE_MISMATCH', 'ZIP_CRC_MISMATCH', 'ZIP_UNSUPPORTED_METHOD'])} error_code, case when id % 7 = 0 then 4 * n + 37 else -1 end::int length from d",
    "declared_limits": f"with {_D} select archive_id, case when id % 3 = 2 or n > 1500 then 'ZIP_LIMIT_EXCEEDED' end error_code, case when id % 3 <> 2 and n <= 1500 then n else -1 end::int length from d",
    "declared_ratios": f"with {_D} select archive_id, case when n >= 1024 then 1.0 + id % 3 else 0 end::double ratio, case when id % 3 = 2 and n >= 1024 then 'ZIP_LIMIT_EXCEEDED' when id % 3 > 0 and n > 0 then 'ZIP_SIZE_MISMATCH' end error_code from d",
    "custom_codec": f"with {_D} select archive_id, case when id % 2 = 1 then md5(t) end md5, case when id % 2 = 0 then 'ZIP_UNSUPPORTED_METHOD' end error_code from d",
    "extract_tree": f"with {_D}, e as (select archive_id, unnest([1, 2]) ordinal, t from d) select archive_id, ordinal::int ordinal, case ordinal when 1 then 'dir/sub/f.txt' else 'link' end path, md5(case ordinal when 1 then t else 'dir' end) md5, null::varchar error_code from e",
    "extract_refusals": f"with {_D} select archive_id, {_case('id', [0, 1, 0, 1, 0])}::int ordinal, {_case('id', ['ok', None, None, 'same', 'link'])} path, {_case('id', [None, 'ZIP_PATH_TRAVERSAL', 'ZIP_PATH_TRAVERSAL', 'ZIP_EXTRACT_DUPLICATE_PATH', 'ZIP_SYMLINK_REJECTED'])} error_code from d",
    "extract_streamed": f"with {_D}, b as (select archive_id, hex(encode(t)) h, n from d), k as (select *, unnest(range(greatest(1, (n + 699) // 700)::bigint)) c from b) select archive_id, 't.txt' path, c::int chunk_no, md5(unhex(substr(h, (c * 1400 + 1)::bigint, 1400))) md5, least(700, n - 700 * c)::int length, null::varchar error_code from k",
    "forward_buffered": f"""with {_D}, e as (select *, unnest([0, 1, 2]) o from d) select archive_id, o::int ordinal, case when o = 2 and id % 3 = 0 then null else ['a', 'b/', 'c'][o + 1] end as name, case o when 0 then md5(t) when 1 then md5('') when 2 then case when id % 3 <> 0 then md5('tail') end end md5,
  case when o = 2 and id % 3 = 0 then 'ZIP_CRC_MISMATCH' end error_code, [n, 0, 4][o + 1]::bigint declared, null::varchar passed from e""",
    "forward_refusals": f"""with {_D}, x as (select *, id % 6 k from d) select archive_id, 0 ordinal, case when k in (2, 3, 4) then 'a' end as name, {_case('id', ['ZIP_UNSUPPORTED_CD_LESS_DESCRIPTOR', 'ZIP_UNSUPPORTED_CD_LESS_DESCRIPTOR', 'ZIP_UNSUPPORTED_ENCRYPTION', 'ZIP_UNSUPPORTED_METHOD', None, 'ZIP_CRC_MISMATCH'])} error_code from x
union all select archive_id, 1, 'b', null from x where k in (2, 3, 4)""",
    "trust_conflicts": f"with {_D} select archive_id, 'a' directory_name, {_case('id', ['a', 'z', 'a/b'])} stream_name, 'name' differs from d where id % 3 > 0",
    "profile_findings": f"""with {_D}, f as (select archive_id, unnest(case id % 14 when 1 then ['ISO-4.4.5'] when 2 then ['ISO-4.3.8', 'ISO-4.4.4'] when 3 then ['ISO-4.4.4'] when 5 then ['WF/DESCRIPTOR-WIDTH'] when 6 then ['WF/DESCRIPTOR-MISMATCH']
  when 7 then ['WF/LFH-NAME-MISMATCH'] when 8 then ['WF/LFH-CRC-MISMATCH'] when 10 then ['ISO-NOTE-1'] when 11 then ['WF/LFH-METHOD-MISMATCH'] when 12 then ['ISO-4.3.10'] when 13 then ['ISO-4.4.1.5'] else [] end) finding from d) select * from f""",
    "plan_refusals": """with p as (select *, p_partkey % 7 k, p_partkey // 50 g from part), c as (select *, count(*) filter (where k = 3) over (partition by g) same from p)
select p_partkey seq, case k when 1 then 'ZIP_INVALID_ENTRY_NAME' when 2 then case when count(*) over (partition by g, k) > 1 then 'ZIP_DUPLICATE_ENTRY_NAME' else 'ZIP_LIMIT_EXCEEDED' end when 3 then case when same > 1 then 'ZIP_DUPLICATE_ENTRY_NAME' end
  when 4 then 'ZIP_INVALID_OPTION' when 5 then 'ZIP_INVALID_OPTION' when 6 then 'ZIP_LIMIT_EXCEEDED' end error_code from c""",
    "archive_comments": "select 'n' || c_nationkey archive_id, c_name as name, c_mktsegment remark, n_name note from customer join nation on c_nationkey = n_nationkey",
    "dead_bytes_report": f"with {_D} select archive_id, 'ZIP_DEAD_BYTES_RATIO' code from d where id % 4 = 0",
    "encrypted_copies": f"with {_D}, e as (select *, unnest([0, 1]) o from d) select archive_id, o::int ordinal, ['open', 'sealed'][o + 1] as name, o = 1 is_encrypted, md5(case o when 0 then 'o' else t end) md5, null::varchar error_code from e",
    "edit_refusals": f"with {_D} select archive_id, {_case('id', ['ZIP_ENTRY_EXISTS', 'ZIP_ENTRY_NOT_FOUND', 'ZIP_ENTRY_EXISTS', None])} error_code, id % 4 = 3 written from d",
    "ranged_reads": "select 'c' || conv_id archive_id, 't' || lpad(turn::varchar, 6, '0') as name, md5(text) md5, null::varchar error_code, true whole from conversations",
    "source_filters": "select 'c' || conv_id archive_id, 't' || lpad(turn::varchar, 6, '0') as name, octet_length(encode(text))::bigint uncompressed_size, md5(text) md5, null::varchar error_code from conversations where turn < 2",
    "entry_page": f"with {_D} select archive_id, 'first' as name, n::bigint uncompressed_size from d where n > 1000 order by encode(archive_id) limit 20 offset 40",
}
