"""Queries over the driver's tables that exercise the archive operators, with SQL that computes the same from the rows.

Rows are packed into archives of bounded size, the operators work on the bytes, and the SQL never sees an archive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import operators as op
from .functions import dos_to_timestamp, external_attributes, glob, is_symlink, name_error, sanitize_path, timestamp_to_dos, unix_mode
from .operators.write import assemble, packed_specs
from .session import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, method: str = "deflate") -> DataFrame:
    name = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id"), F.lit(".txt")))
    group = F.concat(F.lit("docs-"), F.floor(F.col("doc_id") / 64))
    return _table(spark, sf_dir, "documents").select(group.alias("archive_id"), name.alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"), F.lit(method).alias("method"))


def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.inventory(op.entries(op.pack(_documents(spark, sf_dir))))
    return found.select("archive_id", "entry_count", F.col("uncompressed_size").alias("bytes"), "directories", "encrypted")


def entry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.entries(op.pack(_documents(spark, sf_dir))).select("archive_id", "ordinal", "name", "uncompressed_size", "is_directory")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _documents(spark, sf_dir).where("name like '%/100.txt'").select("name").first()[0]
    read = op.read_entries(op.pack(_documents(spark, sf_dir)), names=[name])
    return read.select("archive_id", "name", F.md5("data").alias("md5"))


def entry_content_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.read_entries(op.pack(_documents(spark, sf_dir))).select("archive_id", "name", F.md5("data").alias("md5"), "error_code")


def entry_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.entry_chunks(op.pack(_documents(spark, sf_dir)), size=1000).select("archive_id", "name", "chunk_no", F.octet_length("data").alias("length"))


def entry_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id") % 4).alias("archive_id"), F.concat(F.lit("i"), F.col("item_id")).alias("name"), F.encode("text", "UTF-8").alias("data"))
    return op.entries(op.pack(rows)).select("name", "crc32")


def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.verify_archives(op.pack(_documents(spark, sf_dir)))


def corruption_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = op.segments(packed_specs(_documents(spark, sf_dir, "store")))
    other = F.when(F.substring("payload", 1, 1) == F.lit(b"X"), F.lit(b"Y")).otherwise(F.lit(b"X"))
    hit = (F.col("position") % 7 == 3) & (F.octet_length("payload") > 0)
    broken = parts.withColumn("payload", F.when(hit, F.concat(other, F.substring(F.col("payload"), F.lit(2), F.octet_length("payload")))).otherwise(F.col("payload")))
    return op.verify_entries(assemble(broken)).where("not ok").select("archive_id", "ordinal", "crc_match", "size_match", "local_header_match", "error_code")


def _chats(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    name = F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("-"), F.col("role"))
    return _table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id")).alias("archive_id"), name.alias("name"), F.encode("text", "UTF-8").alias("data"), F.lit(layout).alias("layout"))


def forward_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.forward_entries(op.pack(_chats(spark, sf_dir, "descriptor")), with_data=True).select("archive_id", "ordinal", "name", "uncompressed_size", F.md5("data").alias("md5"), "error_code")


def forward_scan_zip64(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.forward_entries(op.pack(_chats(spark, sf_dir, "descriptor64")))
    return found.groupBy("archive_id").agg(F.count("name").alias("n"), F.sum("uncompressed_size").alias("bytes"), F.count("error_code").alias("errors"))


def forward_vs_central(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op.pack(_chats(spark, sf_dir, "descriptor"))
    seen = op.trust_differences(packed).agg(F.count("*").alias("differences"))
    return seen.crossJoin(op.entries(packed).agg(F.count("*").alias("entries")))  # one row each


def store_layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.entries(op.pack(_documents(spark, sf_dir, "store"))).select("archive_id", "name", "local_header_offset", "compressed_size")


def archive_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pack(_documents(spark, sf_dir, "store")).select("archive_id", F.octet_length("content").alias("length"))


def archive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.layout(op.pack(_documents(spark, sf_dir, "store"))).select("archive_id", "total_entries", "cd_size", "cd_offset", "base", "is_zip64", "error_code")


def archive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.split_chunks(op.pack(_documents(spark, sf_dir, "store")), 65_536).select("archive_id", "seq", F.octet_length("chunk").alias("length"))


def method_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), F.floor(F.col("doc_id") / 64)).alias("archive_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("name"), F.encode(F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(F.col("doc_id") % 3 == 1, F.lit("ab")).otherwise(F.repeat(F.lit("ab"), 200)), "UTF-8").alias("data"))
    return op.inventory(op.entries(op.pack(rows))).select("archive_id", "entry_count", "stored", "deflated")


def local_header_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op.pack(_documents(spark, sf_dir))
    local = op.local_headers(packed).select("archive_id", "ordinal", F.col("crc32").alias("c"), F.col("uncompressed_size").alias("u"), F.col("name").alias("n"))
    both = op.entries(packed).join(local, ["archive_id", "ordinal"])
    same = (F.col("c") == F.col("crc32")) & (F.col("u") == F.col("uncompressed_size")) & (F.col("n") == F.col("raw_name"))
    return both.groupBy("archive_id").agg(F.count("*").alias("entries"), F.bool_and(same).alias("agree"))


def dos_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    dos = timestamp_to_dos(F.col("ts").cast("timestamp_ntz"))
    rows = _table(spark, sf_dir, "events").select("event_id", dos.alias("d"))
    return rows.select("event_id", F.col("d.date").alias("dos_date"), F.col("d.time").alias("dos_time"), F.unix_seconds(dos_to_timestamp(F.col("d.date"), F.col("d.time")).cast("timestamp")).alias("back"))


def dated_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.floor(F.col("o_orderkey") / 256)).alias("archive_id"), F.col("o_orderkey").cast("string").alias("name"), F.encode("o_orderpriority", "UTF-8").alias("data"), F.col("o_orderdate").cast("timestamp_ntz").alias("date"))
    return op.entries(op.pack(rows)).select("name", F.unix_seconds("last_modified").alias("modified"))


def unix_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = (F.col("p_size") * 1021 % 65536).cast("int")
    rows = _table(spark, sf_dir, "part").select("p_partkey", mode.alias("mode"), (F.col("p_partkey") % 2 == 0).alias("dir"))
    rows = rows.withColumn("attributes", external_attributes(F.col("mode"), F.col("dir")))
    return rows.select("p_partkey", "attributes", unix_mode(F.lit(0x032D), F.col("attributes")).alias("back"), is_symlink(F.col("attributes")).alias("link"))


#: For each rule of the path gate a name that breaks it, or just not.
_HOSTILE = [
    "..", "a/../b", "logs\\..\\..\\boot.ini", "/abs/path", "\\rooted", "D:notes", "z:/deep/file", "//server/x", "pic.png:zone", "a/b:c", "nul", "PRN.log", "sub/Com5", "lpt9.a.b", "con.d/readme",
    "lpt0", "console", "com", "nul_", "x///y/./z", "", "./.", "/", "...", "sp ace/ok.txt",
]


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.element_at(F.array(*[F.lit(x) for x in _HOSTILE]), (F.col("page_id") % len(_HOSTILE) + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(k).alias("name"))


def sanitize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("page_id", "name", sanitize_path(F.col("name")).alias("path"))


def writer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("page_id", "name", name_error(F.col("name")).alias("error_code"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry table in which names repeat, as a raw builder could make it."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    ordinal = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*order)).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _table(spark, sf_dir, "lineitem").select("l_suppkey", *order).repartition(parts, "l_suppkey").select(
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("archive_id"), ordinal.alias("ordinal"), (F.col("l_partkey") % 50).cast("string").alias("name"), F.col("l_quantity").cast("long").alias("uncompressed_size"),
        F.lit(False).alias("is_directory"), F.lit(0).cast("long").alias("external_attributes"),
    )


def extract_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extraction_plan(_lines(spark, sf_dir), on_duplicate="first").select("archive_id", "ordinal", "path", "error_code")


def extract_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extraction_plan(_lines(spark, sf_dir), on_duplicate="last").select("archive_id", "ordinal", "path", "position")


def extract_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.extraction_plan(_lines(spark, sf_dir)).where("error_code is not null").select("archive_id", "ordinal", "error_code")


def extract_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = op.extraction_plan(_lines(spark, sf_dir), on_duplicate="first", limits={"max_total_uncompressed_size": 1000})
    return plan.where("error_code is not null").select("archive_id", "ordinal", "error_code")


def extract_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op.pack(_documents(spark, sf_dir))
    return op.extract(packed, where=F.col("name").startswith("fr/")).select("archive_id", "path", F.md5("data").alias("md5"), "error_code")


def filtered_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = op.entries(op.pack(_documents(spark, sf_dir)))
    return table.where(glob(F.col("name"), "[ef][nr]/*/1*.txt") & ~glob(F.col("name"), "**/*5.txt")).select("archive_id", "name")


def duplicate_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of equal content across archives, as a rollup; checksum and size can agree where contents differ."""
    read = op.read_entries(op.pack(_documents(spark, sf_dir))).where("error_code is null")
    return read.groupBy(F.sha2("data", 256)).agg(F.count("*").alias("n")).where("n > 1").groupBy("n").agg(F.count("*").alias("groups"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").withColumn("archive_id", F.concat(F.lit("o"), F.floor(F.col("o_orderkey") / 256))).withColumn("name", F.col("o_orderkey").cast("string"))


def _modified(spark: SparkSession, sf_dir: str, compact: bool) -> DataFrame:
    orders = _orders(spark, sf_dir)
    packed = op.pack(orders.select("archive_id", "name", F.encode("o_orderpriority", "UTF-8").alias("data")))
    edits = orders.where("o_orderstatus <> 'O'").select(
        "archive_id", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "replace").when(F.col("o_orderkey") % 3 == 1, "remove").otherwise("rename").alias("op"), "name",
        F.concat(F.lit("new-"), F.col("name")).alias("new_name"), F.encode(F.lit("changed"), "UTF-8").alias("data"),
    )
    return op.modify(packed, edits, compact=compact).select("archive_id", "content")


def modify_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.read_entries(_modified(spark, sf_dir, False)).select("archive_id", "name", F.col("data").cast("string").alias("value"), "error_code")


def modify_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.read_entries(_modified(spark, sf_dir, True)).select("archive_id", "name", F.col("data").cast("string").alias("value"), "error_code")


def transplant_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op.pack(_documents(spark, sf_dir))
    pair = F.concat(F.lit("pair-"), F.floor(F.substring("archive_id", 6, 20).cast("long") / 2))
    moved = op.transplant(packed).where("error is null").withColumn("archive_id", pair)
    return op.read_entries(op.pack_raw(moved)).select("archive_id", "name", F.md5("data").alias("md5"), "error_code")


def determinism_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    date = F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderdate").cast("timestamp_ntz"))
    packed = op.pack(orders.select("archive_id", "name", F.encode("o_orderpriority", "UTF-8").alias("data"), date.alias("date"), F.col("o_orderkey").alias("seq")), canonical=False)
    return op.determinism_offenders(op.entries(packed)).select("archive_id", "name", "concern")


def determinism_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op.determinism(op.entries(op.pack(_chats(spark, sf_dir, "descriptor"))))
    return found.select("archive_id", "entry_count", "deterministic", "canonical_order", "no_data_descriptors")


def canonicalize_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir).select("archive_id", "name", F.encode("o_orderpriority", "UTF-8").alias("data"), F.col("o_orderdate").cast("timestamp_ntz").alias("date"), (-F.col("o_orderkey")).alias("seq"))
    once = stored(op.canonicalize(op.pack(orders, canonical=False)))
    twice = op.canonicalize(once).withColumnRenamed("content", "again")
    verdict = op.determinism(op.entries(once)).select("archive_id", "deterministic")
    return once.join(twice, "archive_id").join(verdict, "archive_id").select("archive_id", (F.col("content") == F.col("again")).alias("same"), "deterministic")


def assertion_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op.pack(_documents(spark, sf_dir, "store"))
    return op.assertions(packed, op.entries(packed)).where("not ok").groupBy("check").agg(F.count("*").alias("archives"))


def iso_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op.pack(_documents(spark, sf_dir))
    found = op.iso_findings(packed).groupBy("archive_id").agg(F.count("*").alias("n"))
    return packed.select("archive_id").join(found, "archive_id", "left").select("archive_id", F.coalesce("n", F.lit(0)).alias("findings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        archive_inventory, entry_listing, point_lookup, entry_content_roundtrip, entry_chunks, entry_crc32, verify_report, corruption_report, forward_scan, forward_scan_zip64, forward_vs_central,
        store_layout_offsets, archive_length, archive_layout, archive_chunks, method_mix, local_header_agreement, dos_timestamps, dated_entries, unix_attributes, sanitize_paths, writer_names,
        extract_dedup_first, extract_dedup_last, extract_duplicates, extract_budget, extract_contents, filtered_listing, duplicate_contents, modify_overlay, modify_compact, transplant_merge, determinism_offenders, determinism_report,
        canonicalize_idempotent, assertion_results, iso_profile,
    )
}

_D = "d as (select 'docs-' || (doc_id // 64) archive_id, lang || '/' || source || '/' || doc_id || '.txt' name, coalesce(text, '') t, octet_length(encode(coalesce(text, ''))) n from documents)"
_C = "c as (select 'c' || conv_id archive_id, lpad(turn::varchar, 6, '0') || '-' || role name, text t, octet_length(encode(text)) n from conversations)"
_L = "l as (select 's' || l_suppkey archive_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) ordinal, (l_partkey % 50)::varchar path, l_quantity::bigint n from lineitem)"
_O = "o as (select 'o' || (o_orderkey // 256) archive_id, o_orderkey::varchar name, * from orders)"
_H = "[" + ", ".join("'" + x + "'" for x in _HOSTILE) + "]"
_N = f"n as (select page_id, case when page_id % 2 = 0 then regexp_replace(url, '^https?://', '') else {_H}[page_id % {len(_HOSTILE)} + 1] end as name from pages)"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(hex(b), (2 * i + 1)::int, 2))::bigint)), "
    "lambda c, x: list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)), 4294967295)"
)
_OVERLAY = f"""with {_O} select archive_id, case when o_orderstatus <> 'O' and o_orderkey % 3 = 2 then 'new-' || name else name end as name,
  case when o_orderstatus <> 'O' and o_orderkey % 3 = 0 then 'changed' else o_orderpriority end as value, null::varchar error_code from o where o_orderstatus = 'O' or o_orderkey % 3 <> 1"""

ORACLE_SQL: dict[str, str] = {
    "archive_inventory": f"with {_D} select archive_id, count(*) entry_count, sum(n)::bigint bytes, 0::bigint directories, 0::bigint encrypted from d group by 1",
    "entry_listing": f"with {_D} select archive_id, (row_number() over (partition by archive_id order by encode(name)) - 1)::int ordinal, name, n::bigint uncompressed_size, false is_directory from d",
    "point_lookup": f"with {_D} select archive_id, name, md5(t) md5 from d where name like '%/100.txt'",
    "entry_content_roundtrip": f"with {_D} select archive_id, name, md5(t) md5, null::varchar error_code from d",
    "entry_chunks": f"with {_D}, k as (select *, unnest(range(greatest(1, (n + 999) // 1000)::bigint)) chunk_no from d) select archive_id, name, chunk_no::int chunk_no, least(1000, n - 1000 * chunk_no)::int length from k",
    "entry_crc32": f"with e as (select 'i' || item_id as name, encode(text) b from benchmark) select name, {_CRC}::bigint crc32 from e",
    "verify_report": f"with {_D} select archive_id, true ok, null::varchar error_code, count(*) entry_count, 0::bigint failed from d group by 1",
    "corruption_report": f"with {_D}, p as (select archive_id, (row_number() over (partition by archive_id order by encode(name)) - 1)::int ordinal, n from d) select archive_id, ordinal, false crc_match, true size_match, true local_header_match, 'ZIP_CRC_MISMATCH' error_code from p where ordinal % 7 = 3 and n > 0",
    "forward_scan": f"with {_C} select archive_id, (row_number() over (partition by archive_id order by encode(name)) - 1)::int ordinal, name, n::bigint uncompressed_size, md5(t) md5, null::varchar error_code from c",
    "forward_scan_zip64": f"with {_C} select archive_id, count(*) n, sum(n)::bigint bytes, 0::bigint errors from c group by 1",
    "forward_vs_central": f"with {_C} select 0::bigint differences, count(*) entries from c",
    "store_layout_offsets": f"with {_D} select archive_id, name, coalesce(sum(30 + octet_length(encode(name)) + n) over (partition by archive_id order by encode(name) rows between unbounded preceding and 1 preceding), 0)::bigint local_header_offset, n::bigint compressed_size from d",
    "archive_length": f"with {_D} select archive_id, (22 + sum(76 + 2 * octet_length(encode(name)) + n))::int length from d group by 1",
    "archive_layout": f"with {_D} select archive_id, count(*) total_entries, sum(46 + octet_length(encode(name)))::bigint cd_size, sum(30 + octet_length(encode(name)) + n)::bigint cd_offset, 0::bigint base, false is_zip64, null::varchar error_code from d group by 1",
    "archive_chunks": f"with {_D}, a as (select archive_id, (22 + sum(76 + 2 * octet_length(encode(name)) + n))::bigint size from d group by 1), k as (select *, unnest(range((size + 65535) // 65536)) seq from a) select archive_id, seq::int seq, least(65536, size - 65536 * seq)::int length from k",
    "method_mix": "select 'm' || (doc_id // 64) archive_id, count(*) entry_count, count_if(doc_id % 3 <> 2)::bigint stored, count_if(doc_id % 3 = 2)::bigint deflated from documents group by 1",
    "local_header_agreement": f"with {_D} select archive_id, count(*) entries, true agree from d group by 1",
    "dos_timestamps": "select event_id, ((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts))::int dos_date, (hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::int dos_time, (epoch_us(ts) // 2000000 * 2)::bigint back from events",
    "dated_entries": "select o_orderkey::varchar as name, (epoch_us(o_orderdate) // 2000000 * 2)::bigint modified from orders",
    "unix_attributes": """with m as (select p_partkey, p_size * 1021 % 65536 as m, p_partkey % 2 = 0 d from part), t as (select *, case when m & 61440 = 0 then m | case when d then 16384 else 32768 end else m end t from m)
select p_partkey, ((t::bigint << 16) | case when d then 16 else 0 end)::bigint attributes, t::int back, t & 61440 = 40960 link from t""",
    "sanitize_paths": rf"""with {_N}, s as (select *, replace(name, '\', '/') f, list_filter(string_split(replace(name, '\', '/'), '/'), lambda x: x <> '' and x <> '.') p from n)
select page_id, name, case when name = '' or starts_with(f, '/') or regexp_matches(f, '^[A-Za-z]:') or len(p) = 0
  or len(list_filter(p, lambda x: x = '..' or contains(x, ':') or regexp_matches(lower(x), '^(con|prn|aux|nul|com[1-9]|lpt[1-9])([.]|$)'))) > 0 then null else array_to_string(p, '/') end path from s""",
    "writer_names": rf"""with {_N}, s as (select *, string_split(name, '/') p from n)
select page_id, name, case when name = '' or contains(name, '\') or starts_with(name, '/') or regexp_matches(name, '^[A-Za-z]:') or list_contains(p, '..') or len(list_filter(p, lambda x: x <> '' and x <> '.')) = 0 then 'ZIP_INVALID_ENTRY_NAME' end error_code from s""",
    "extract_dedup_first": f"with {_L} select archive_id, min(ordinal) ordinal, path, null::varchar error_code from l group by archive_id, path",
    "extract_dedup_last": f"with {_L} select archive_id, max(ordinal) ordinal, path, min(ordinal) as position from l group by archive_id, path",
    "extract_duplicates": f"with {_L}, r as (select *, row_number() over (partition by archive_id, path order by ordinal) k from l) select archive_id, min(ordinal) ordinal, 'ZIP_EXTRACT_DUPLICATE_PATH' error_code from r where k > 1 group by 1",
    "extract_budget": f"with {_L}, r as (select *, sum(n) over (partition by archive_id order by ordinal) s from l) select archive_id, min(ordinal) ordinal, 'ZIP_LIMIT_EXCEEDED' error_code from r where s > 1000 group by 1",
    "extract_contents": f"with {_D} select archive_id, name path, md5(t) md5, null::varchar error_code from d where starts_with(name, 'fr/')",
    "filtered_listing": f"with {_D} select archive_id, name from d where regexp_matches(name, '^[ef][nr]/[^/]*/1[^/]*[.]txt$') and not regexp_matches(name, '5[.]txt$')",
    "duplicate_contents": "with g as (select coalesce(text, '') t, count(*) n from documents group by 1 having count(*) > 1) select n, count(*) groups from g group by n",
    "modify_overlay": _OVERLAY,
    "modify_compact": _OVERLAY,
    "transplant_merge": f"with {_D} select 'pair-' || (substr(archive_id, 6)::bigint // 2) archive_id, name, md5(t) md5, null::varchar error_code from d",
    "determinism_offenders": f"""with {_O}, p as (select *, lag(encode(name)) over (partition by archive_id order by o_orderkey) before from o)
select archive_id, name, 'timestamp' concern from p where o_orderkey % 5 = 0 union all select archive_id, name, 'order' from p where before > encode(name)""",
    "determinism_report": f"with {_C} select archive_id, count(*) entry_count, true deterministic, true canonical_order, false no_data_descriptors from c group by 1",
    "canonicalize_idempotent": f"with {_O} select archive_id, true same, true deterministic from o group by 1",
    "assertion_results": f"with {_D}, a as (select archive_id from d group by 1) select unnest(['zip64', 'deflate-only']) as \"check\", count(*) archives from a",
    "iso_profile": f"with {_D} select archive_id, 0::bigint findings from d group by 1",
}
