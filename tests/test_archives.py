"""The operators over archive tables."""

from __future__ import annotations

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from arcframe import operators as op
from arcframe.functions import cp437_to_string, dos_to_timestamp, encryption_scheme, sanitize_path, timestamp_to_dos
from arcframe.kernel.codecs import get_codec, register_codec
from arcframe.sources import read_archives, register
from arcframe.streaming import chunked_entries

from arcframe.kernel.crafted import raw_zip

TWO = [{"name": "a.txt", "data": b"hello hello hello hello", "method": 8}, {"name": "b/c.bin", "data": bytes(range(256)) * 9}]


def table(spark, **archives: bytes):
    return spark.createDataFrame([(k, v) for k, v in archives.items()], "archive_id string, content binary")


@pytest.fixture(scope="module")
def hostile(spark):
    return table(
        spark, good=raw_zip(TWO), corrupt=raw_zip([{**TWO[1], "corrupt_at": 7}, TWO[0]]), junk=b"no archive", locked=raw_zip([{**TWO[0], "flags": 1}]), method=raw_zip([{**TWO[1], "method": 12}]),
        overlap=raw_zip([TWO[0], {**TWO[1], "offset_lie": 0}]), mismatch=raw_zip([{**TWO[0], "lfh_crc_lie": 1}]), twice=raw_zip([TWO[0], TWO[0]]),
    ).cache()


def test_layout_and_entries(hostile):
    rows = {r.archive_id: r for r in op.layout(hostile).collect()}
    assert rows["junk"].error_code == "ZIP_EOCD_NOT_FOUND" and rows["good"].total_entries == 2
    assert op.entries(hostile).where("archive_id = 'twice'").count() == 2
    assert [r.ordinal for r in op.point_lookup(op.entries(hostile), "a.txt").where("archive_id = 'twice'").collect()] == [1]
    codes = {(r.archive_id, r.code) for r in op.diagnostics(hostile, validate="eager").collect()}
    assert {("junk", "ZIP_EOCD_NOT_FOUND"), ("overlap", "ZIP_ENTRY_OVERLAP"), ("mismatch", "ZIP_SIZE_MISMATCH"), ("twice", "ZIP_DUPLICATE_NAME")} <= codes
    assert op.diagnostics(hostile, strict=True).where("code = 'ZIP_STRICT_DIAGNOSTIC'").count() == 1
    with pytest.raises(Exception, match="ZIP_EOCD_NOT_FOUND"):
        op.entries(hostile, mode="raise").collect()


def test_verify_agrees_with_kernel(spark, hostile):
    from arcframe.kernel.codecs import codec_table
    from arcframe.kernel.reader import Archive, Bytes
    from arcframe.vocabulary import resolve_limits

    got = {(r.archive_id, r.ordinal): r for r in op.verify_entries(hostile).collect()}
    for row in hostile.where("archive_id <> 'junk'").collect():
        a = Archive(Bytes(bytes(row.content)), resolve_limits(), codecs=codec_table())
        for e in a.entries:
            want, mine = a.verify(e), got[row.archive_id, e["ordinal"]]
            assert {k: mine[k] for k in want} == want, (row.archive_id, mine)
    report = {r.archive_id: (r.ok, r.error_code, r.entry_count) for r in op.verify_archives(hostile).collect()}
    assert report["good"] == (True, None, 2) and report["locked"][0] and not report["method"][0] and not report["corrupt"][0]
    assert report["junk"] == (False, "ZIP_EOCD_NOT_FOUND", 0) and report["overlap"] == (False, "ZIP_ENTRY_OVERLAP", 0)


def test_reading(hostile):
    read = {(r.archive_id, r.name): r for r in op.read_entries(hostile, where=F.col("name").startswith("b")).collect()}
    assert bytes(read["good", "b/c.bin"].data) == TWO[1]["data"] and read["corrupt", "b/c.bin"].error_code == "ZIP_CRC_MISMATCH"
    assert op.read_entries(hostile, names=["b/c.bin"], verify_crc=False).where("archive_id = 'corrupt'").first().error_code is None
    pieces = op.entry_chunks(hostile, where=F.col("name") == "b/c.bin", size=1000).where("archive_id = 'good'").orderBy("chunk_no").collect()
    assert b"".join(bytes(r.data) for r in pieces) == TWO[1]["data"]
    raw = op.raw_payloads(hostile).where("archive_id = 'good' and ordinal = 1").first()
    assert bytes(raw.data) == TWO[1]["data"]


def test_custom_codec(spark):
    class Reverse:
        method, name = 77, "reverse"

        def decompress(self, data, most):
            return data[::-1]

    register_codec(Reverse())
    assert get_codec(77).name == "reverse"
    odd = table(spark, x=raw_zip([{"name": "r", "data": b"abc", "method": 77, "crc_lie": __import__("zlib").crc32(b"cba"), "lfh_crc_lie": __import__("zlib").crc32(b"cba")}]))
    assert bytes(op.read_entries(odd).first().data) == b"cba"
    from arcframe.kernel import codecs

    codecs._CODECS.pop(77)


def test_extraction(spark):
    link = {"name": "link", "data": b"/etc", "attributes": 0xA1FF << 16}
    cases = table(
        spark, slip=raw_zip([{"name": "../evil.txt"}, {"name": "ok.txt", "data": b"x"}]), device=raw_zip([{"name": "aux.txt"}]), twice=raw_zip([{"name": "same.txt", "data": b"1"}, {"name": "./same.txt", "data": b"2"}]), link=raw_zip([link]), fine=raw_zip([{"name": "d/"}, {"name": "d\\x", "data": b"y"}])
    )
    codes = {r.archive_id: r.error_code for r in op.extract(cases).collect()}
    assert codes == {"slip": "ZIP_PATH_TRAVERSAL", "device": "ZIP_PATH_TRAVERSAL", "twice": "ZIP_EXTRACT_DUPLICATE_PATH", "link": "ZIP_SYMLINK_REJECTED", "fine": None}
    skip = {(r.archive_id, r.path): bytes(r.data) for r in op.extract(cases, on_unsafe="skip", on_duplicate="last", reject_symlinks=False).collect()}
    assert skip == {("slip", "ok.txt"): b"x", ("twice", "same.txt"): b"2", ("link", "link"): b"/etc", ("fine", "d/x"): b"y"}


def test_functions(spark):
    names = ["..", "a/../b", "/abs", "D:notes", "z:/deep", "//host/x", "logs\\..\\boot", "n\0b", "pic.png:zone", "aux\n", "console", "lpt0", "lpt9.a", "a//./b", "", "."]
    got = [r.p for r in spark.createDataFrame([(n,) for n in names], "n string").select(sanitize_path(F.col("n")).alias("p")).collect()]
    assert got == [None] * 9 + ["aux\n", "console", "lpt0", None, "a/b", None, None]
    high = spark.createDataFrame([(bytes(range(1, 256)),)], "b binary").select(cp437_to_string(F.col("b"))).first()[0]
    assert high == bytes(range(1, 256)).decode("cp437")
    row = spark.sql("select 22992 d, 65535 t").select(dos_to_timestamp(F.col("d"), F.col("t")).alias("x"), dos_to_timestamp(F.lit(0), F.lit(0)).alias("z")).first()
    assert row.z == datetime.datetime(1980, 1, 1) and row.x > datetime.datetime(2024, 1, 1)
    times = spark.sql("select explode(array(timestamp_ntz'1979-12-31 23:59:59', timestamp_ntz'2108-01-01', timestamp_ntz'2020-02-03 04:05:07', null)) t").select(timestamp_to_dos(F.col("t")).alias("x")).collect()
    assert [tuple(r.x) for r in times] == [(0x21, 0, "before-1980"), (0xFF9F, 0xBF7D, "after-2107"), (20547, 8355, None), (0x21, 0, None)]
    schemes = spark.sql("select 1 flags, 99 compression_method, array(named_struct('id', 1)) extra_fields union all select 65, 8, array() union all select 1, 8, array(named_struct('id', 39169)) union all select 1, 0, array() union all select 0, 0, array()")
    assert [r[0] for r in schemes.select(encryption_scheme()).collect()] == ["aes", "strong", "aes", "zipcrypto", None]


def test_packing(spark):
    rows = [("x", "b.txt", b"b" * 500), ("x", "a.txt", b"a"), ("x", "dir", None), ("y", "é", b"")]
    frame = spark.createDataFrame([(*r, r[1] == "dir") for r in rows], "archive_id string, name string, data binary, is_directory boolean")
    packed = {r.archive_id: bytes(r.content) for r in op.pack(frame.repartition(3)).collect()}
    again = {r.archive_id: bytes(r.content) for r in op.pack(frame.coalesce(1)).collect()}
    assert packed == again
    z = zipfile.ZipFile(io.BytesIO(packed["x"]))
    assert z.namelist() == ["a.txt", "b.txt", "dir/"] and z.read("b.txt") == b"b" * 500 and z.testzip() is None
    assert [i.compress_type for i in z.infolist()] == [0, 8, 0]
    for layout in ("descriptor", "descriptor64"):
        streamed = op.pack(frame.withColumn("layout", F.lit(layout))).where("archive_id = 'x'").first().content
        assert zipfile.ZipFile(io.BytesIO(bytes(streamed))).read("b.txt") == b"b" * 500
    for name in ("", "/x", "a\\b", "../x", "C:/x"):
        with pytest.raises(Exception, match="ZIP_INVALID_ENTRY_NAME"):
            op.pack(spark.createDataFrame([("x", name, b"")], "archive_id string, name string, data binary")).collect()
    with pytest.raises(Exception, match="ZIP_DUPLICATE_ENTRY_NAME"):
        op.pack(spark.createDataFrame([("x", "a", b""), ("x", "a", b"")], "archive_id string, name string, data binary")).collect()
    pieces = op.split_chunks(spark.createDataFrame([("x", b"z" * 5000)], "archive_id string, content binary"), 10).orderBy("seq").collect()
    assert [len(r.chunk) for r in pieces] == [1024] * 4 + [904]


def test_modifying(spark):
    base = table(spark, m=raw_zip([{"name": "a", "data": b"1"}, {"name": "b", "data": b"2"}, {"name": "c", "data": b"3"}]), same=raw_zip(TWO), broken=b"junk")
    edits = spark.createDataFrame(
        [("m", 1, "replace", "a", None, b"new"), ("m", 2, "remove", "b", None, None), ("m", 3, "rename", "c", "b", None), ("m", 4, "add", "d", None, b"4"), ("m", 5, "comment", None, None, b"hi"), ("broken", 1, "remove", "x", None, None)],
        "archive_id string, seq long, op string, name string, new_name string, data binary",
    )
    want = {"a": b"new", "b": b"3", "d": b"4"}
    for compact in (False, True):
        out = {r.archive_id: r for r in op.modify(base, edits, compact=compact).collect()}
        z = zipfile.ZipFile(io.BytesIO(bytes(out["m"].content)))
        assert {n: z.read(n) for n in z.namelist()} == want and z.comment == b"hi"
        assert bytes(out["same"].content) == raw_zip(TWO) and out["broken"].error_code == "ZIP_EOCD_NOT_FOUND"
        original = raw_zip([{"name": "a", "data": b"1"}, {"name": "b", "data": b"2"}, {"name": "c", "data": b"3"}])
        assert bytes(out["m"].content).startswith(original) != compact
    for op_, name, new, code in (("add", "a", None, "ZIP_ENTRY_EXISTS"), ("remove", "zz", None, "ZIP_ENTRY_NOT_FOUND"), ("rename", "a", "b", "ZIP_ENTRY_EXISTS"), ("zap", "a", None, "ZIP_INVALID_OPTION")):
        one = spark.createDataFrame([("m", 1, op_, name, new, b"")], edits.schema)
        assert op.modify(base.where("archive_id = 'm'"), one).first().error_code == code
    assert op.dead_bytes(op.modify(base, edits), 0.1).count() == 1


def test_canonical_form(spark):
    messy = table(spark, x=raw_zip([{**TWO[1], "time": 5, "extra_local": b"\x55\x54\0\0", "extra_central": b"\x55\x54\0\0", "comment": b"c"}, {**TWO[0], "descriptor": "signed"}], prepend=b"stub"))
    once = op.canonicalize(messy)
    assert op.determinism(op.entries(once)).first().deterministic and not op.determinism(op.entries(messy)).first().deterministic
    assert bytes(op.canonicalize(once).first().content) == bytes(once.first().content)
    concerns = {(r.name, r.concern) for r in op.determinism_offenders(op.entries(messy)).collect()}
    assert {("b/c.bin", "timestamp"), ("a.txt", "order"), ("b/c.bin", "extra-field"), ("a.txt", "version-made-by"), ("a.txt", "data-descriptor")} <= concerns
    assert op.iso_findings(once).count() == 0
    assert {r.finding for r in op.iso_findings(table(spark, x=raw_zip([{**TWO[0], "method": 12}]), y=b"junk")).collect()} >= {"ISO-4.4.5", "WF/EOCD-NOT-FOUND"}


def test_trust(spark):
    lies = table(spark, name=raw_zip([{**TWO[0], "lfh_name_lie": b"z.txt"}]), fine=raw_zip(TWO))
    assert [(r.archive_id, r.differs) for r in op.trust_differences(lies).collect()] == [("name", "name")]


def test_sources(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.zip").write_bytes(raw_zip([{"name": f"n{k}", "data": b"x" * k}, {"name": "common", "data": b"c"}]))
    whole, ranged = read_archives(spark, str(tmp_path)), read_archives(spark, str(tmp_path), ranged=True)
    names = lambda df: sorted(r.name for r in op.entries(df).select("name").collect())
    assert names(whole) == names(ranged) == ["common"] * 3 + ["n0", "n1", "n2"]
    register(spark)
    paths = ",".join(str(tmp_path / f"{k}.zip") for k in range(3))
    found = spark.read.format("arcframe").option("data", "true").load(paths)
    assert {bytes(r.data) for r in found.where("name = 'n2'").collect()} == {b"xx"}
    whole.createOrReplaceTempView("zips")
    assert spark.sql("select e.name from zips, lateral zip_entries(content) e where e.uncompressed_size = 2").collect()[0][0] == "n2"
    assert spark.sql("select l.total_entries from zips, lateral zip_layout(content) l").count() == 3
    assert spark.sql("select e.name from zips, lateral zip_forward(content) e").count() == 6


def test_chunk_stream(spark, tmp_path):
    data = raw_zip([{"name": "a", "data": b"abc" * 400, "method": 8, "descriptor": "signed"}, {"name": "b", "data": b"tail"}, {"name": "c", "data": b"q" * 90, "method": 8}])
    cut = [data[a : a + 60] for a in range(0, len(data), 60)] + [b""]
    rows = [("x", k, c) for k, c in enumerate(cut)] + [("gone", 0, data[:40]), ("gone", 1, b"")]
    schema = "archive_id string, seq long, chunk binary"
    for k, at in enumerate(range(0, len(rows), 7)):  # out of order inside and across files
        spark.createDataFrame(list(reversed(rows[at : at + 7])), schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{len(rows) - k:03}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = chunked_entries(stream, with_data=True).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = sorted((r.archive_id, r.ordinal, r.name, bytes(r.data or b""), r.error_code) for r in spark.table("seen").collect())
    assert got == [("gone", 0, None, b"", "ZIP_STREAM_TRUNCATED"), ("x", 0, "a", b"abc" * 400, None), ("x", 1, "b", b"tail", None), ("x", 2, "c", b"q" * 90, None)]


def test_written_files(spark, tmp_path):
    from arcframe.functions import glob
    from arcframe.operators.write import packed_specs

    frame = spark.createDataFrame([(f"z{k % 3}", f"n{k:02}", b"x" * 50 * k) for k in range(30)], "archive_id string, name string, data binary")
    parts = op.segments(packed_specs(frame))
    done = op.write_archives(parts, str(tmp_path / "out")).collect()
    packed = {r.archive_id: bytes(r.content) for r in op.pack(frame).collect()}
    assert {r.archive_id: open(r.path, "rb").read() for r in done} == packed and all(r.length == len(packed[r.archive_id]) for r in done)
    assert len(list((tmp_path / "out").iterdir())) == 3
    names = spark.createDataFrame([("a/b/c.txt",), ("a/c.txt",), ("c.txt",), ("a/c1txt",), ("d.txt\n",)], "n string")
    hits = lambda p: [r.n for r in names.where(glob(F.col("n"), p)).collect()]
    assert hits("**/*.txt") == ["a/b/c.txt", "a/c.txt", "c.txt"] and hits("*/*.txt") == ["a/c.txt"] and hits("?.txt") == ["c.txt"] and hits("[!d]*.txt") == ["c.txt"]


def test_file_names(spark, tmp_path):
    """No archive_id is written outside of the folder, and no two to one file."""
    from arcframe.operators.write import file_name, packed_specs

    ids = ["plain-1.x", "../up", "a/b", ".hidden", "file:/tmp/z", "C:\\x", "nul\0", "", "é", "0" * 64, None]
    frame = spark.createDataFrame([(k, "n", b"x") for k in ids], "archive_id string, name string, data binary")
    done = op.write_archives(op.segments(packed_specs(frame)), str(tmp_path / "out")).collect()
    assert len(done) == len(ids) and sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(file_name(k) for k in ids)
    assert file_name("plain-1.x") == "plain-1.x.zip" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_only_wanted_entries_are_decoded(spark):
    """A broken payload that the filter leaves out does no harm, and what isn't asked for isn't read."""
    from arcframe.operators.content import read_entries

    cases = table(spark, x=raw_zip([{**TWO[1], "name": "bad", "corrupt_at": 3}, TWO[0], {"name": "more", "data": b"m"}]))
    out = op.extract(cases, where=F.col("name") == "a.txt").collect()
    assert [(r.path, r.error_code) for r in out] == [("a.txt", None)]
    wanted = spark.createDataFrame([("x", 2)], "archive_id string, ordinal int")
    assert [(r.ordinal, bytes(r.data)) for r in read_entries(cases, ordinals=wanted).collect()] == [(2, b"m")]


def test_archives_that_do_not_open(hostile):
    """They are rows with a code, or missing where only whole archives come out; no job fails."""
    for found, column in ((op.raw_payloads(hostile), "error_code"), (op.transplant(hostile), "error"), (op.read_entries(hostile), "error_code")):
        assert [(r[column], r.name) for r in found.where("archive_id = 'junk'").collect()] == [("ZIP_EOCD_NOT_FOUND", None)]
    kept = {r.archive_id for r in op.canonicalize(hostile.where("archive_id <> 'twice'")).collect()}
    assert kept == {"good", "corrupt", "locked", "method"}


def test_equal_contents_not_equal_checksums(spark, tmp_path):
    """Two texts of one length and CRC-32 are no duplicates."""
    from arcframe.queries import duplicate_contents

    rows = [(1, "plumless"), (2, "buckeroo"), (3, "same"), (4, "same"), (5, None), (6, "")]
    spark.createDataFrame([(k, t, "en", "web") for k, t in rows], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in duplicate_contents(spark, str(tmp_path)).collect()] == [(2, 2)]


def test_tasks_do_not_carry_all_files(spark):
    """Files come in runs of bounded number and size, and what goes to a task doesn't grow with their number."""
    from pyspark.cloudpickle import dumps

    from arcframe.sources.datasource import ENTRY, MOST_BYTES, ArchiveReader, runs
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ENTRY)
    few, many = ([(f"/a/{k}.zip", 10) for k in range(n)] for n in (10, 20_000))
    assert len(dumps(ArchiveReader(few, False, schema))) == len(dumps(ArchiveReader(many, False, schema)))
    found = ArchiveReader(many, False, schema).partitions()
    assert len(found) <= 64 and [p for x in found for p in x.paths] == [p for p, _ in many]
    assert [len(x.paths) for x in runs([("big", MOST_BYTES), ("a", 1), ("b", 1)])] == [1, 1, 1] and [x.paths for x in runs([])] == [[]]


def test_long_names_and_comments_are_not_sorted(spark):
    """Names count as repeated by a short key, and a comment's length is known before: neither is shuffled."""
    from arcframe.plans.archive import validated

    rows = spark.createDataFrame([(1, "n" * 70), (2, "n" * 70), (3, "n" * 71), (4, "m" * 70), (5, "a"), (6, "a"), (7, "b")], "seq long, name string").selectExpr("'x' archive_id", "seq", "name", "cast(name as binary) data", "cast(repeat('c', 70000) as binary) comment")
    found = validated(rows).select("seq", "error_code")
    assert {r.seq: r.error_code for r in found.collect()} == {k: "ZIP_LIMIT_EXCEEDED" if k in (3, 4, 7) else "ZIP_DUPLICATE_ENTRY_NAME" for k in range(1, 8)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "Window" in x)
    assert "_key" in window and "raw_name" not in window
    below = plan.splitlines()[plan.splitlines().index(window) + 1]
    assert not any(f"{c}#" in below.split("[")[1].split(" AS ")[0] for c in ("comment", "raw_name"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extraction_sorts_twice(spark):
    for how in ("error", "first", "last"):
        rows = spark.createDataFrame([("x", 1, "n", 1, False, 0)], "archive_id string, ordinal long, name string, uncompressed_size long, is_directory boolean, external_attributes long")
        plan = _plan(op.extraction_plan(rows, on_duplicate=how))
        assert plan.count("Sort [") == 2 and plan.count("hashpartitioning(archive_id") == 1 and "REPARTITION_BY_NUM" in plan


def test_canonical_archives_are_made_once(spark):
    from arcframe.queries import canonicalize_idempotent

    assert _plan(canonicalize_idempotent(spark, "/root/testdata/sf0.001")).count("FlatMapGroupsInArrow") == 1


def test_batches_are_bounded_by_their_payload():
    """Modified archives leave a task by bounded batches."""
    import pyarrow as pa

    from arcframe.operators._run import batches

    rows = ({"content": bytes(9 << 20)} for _ in range(5))
    assert [b.num_rows for b in batches(rows, pa.schema([("content", pa.binary())]), "content")] == [2, 2, 1]
