"""The kernels alone, on hostile and ordinary bytes."""

from __future__ import annotations

import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest

from arcframe.kernel import codecs, forward, reader, writer
from arcframe.operators.forward import forward_rows
from arcframe.vocabulary import DEFAULT_LIMITS, DIAGNOSTICS, ERROR_CODES, ZipFault, enforce, resolve_limits

from arcframe.kernel.crafted import deflate, raw_zip

TWO = [{"name": "a.txt", "data": b"hello hello hello hello", "method": 8}, {"name": "b/c.bin", "data": bytes(range(256)) * 9}]


def archive(data: bytes, **limits: float) -> reader.Archive:
    return reader.Archive(reader.Bytes(data), resolve_limits(limits), codecs=codecs.codec_table())


def code_of(run) -> str | None:
    try:
        run()
    except ZipFault as fault:
        assert fault.code in ERROR_CODES
        return fault.code
    return None


def read_all(data: bytes, **limits: float) -> list[bytes]:
    a = archive(data, **limits)
    return [a.read(e) for e in a.entries]


def test_vocabularies():
    assert (len(ERROR_CODES), len(DIAGNOSTICS), len(DEFAULT_LIMITS)) == (39, 12, 9)
    for bad in ({"nope": 1}, {"max_entries": 0}, {"max_entries": float("nan")}, {"max_entries": -1}, {"max_entries": "9"}):
        assert code_of(lambda bad=bad: resolve_limits(bad)) == "ZIP_LIMIT_INVALID"
    limits = resolve_limits({"max_entries": 5, "max_name_bytes": float("inf")})
    enforce(limits, "max_entries", 5, "at the bound")
    assert code_of(lambda: enforce(limits, "max_entries", 6, "over")) == "ZIP_LIMIT_EXCEEDED"


def test_reads_own_and_foreign():
    assert read_all(raw_zip(TWO)) == [e["data"] for e in TWO]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("é.txt", "text " * 500)
        z.writestr("empty", b"")
        z.mkdir("dir")
    a = archive(buffer.getvalue())
    assert [e["name"] for e in a.entries] == ["é.txt", "empty", "dir/"] and a.read(a.entries[0]) == b"text " * 500


@pytest.mark.parametrize(
    ("data", "code"),
    [
        (b"", "ZIP_EOCD_NOT_FOUND"), (b"x" * 100, "ZIP_EOCD_NOT_FOUND"), (raw_zip(TWO, append=b"garbage"), "ZIP_EOCD_NOT_FOUND"), (raw_zip(TWO, entries_lie=9), "ZIP_CD_INCONSISTENT"), (raw_zip(TWO, entries_lie=1), "ZIP_CD_INCONSISTENT"),
        (raw_zip(TWO, cd_offset_lie=5000), "ZIP_EOCD_INCONSISTENT"), (raw_zip([{**TWO[0], "usize_lie": 2 << 30}]), "ZIP_LIMIT_EXCEEDED"), (raw_zip([TWO[0], {**TWO[1], "offset_lie": 0}]), "ZIP_ENTRY_OVERLAP"),
        (raw_zip([{**TWO[0], "lfh_method_lie": 0}]), "ZIP_CD_LFH_MISMATCH"), (raw_zip([{**TWO[0], "lfh_crc_lie": 1}]), "ZIP_SIZE_MISMATCH"), (raw_zip([{**TWO[1], "corrupt_at": 7}]), "ZIP_CRC_MISMATCH"),
        (raw_zip([{**TWO[0], "usize_lie": 5}]), "ZIP_INFLATE_OUTPUT_OVERFLOW"), (raw_zip([{**TWO[0], "usize_lie": 50}]), "ZIP_SIZE_MISMATCH"), (raw_zip([{**TWO[0], "flags": 1}]), "ZIP_UNSUPPORTED_ENCRYPTION"), (raw_zip([{**TWO[1], "method": 12}]), "ZIP_UNSUPPORTED_METHOD"),
        (raw_zip(TWO, zip64=True, drop_record=True), "ZIP_ZIP64_EOCD_MISPLACED"), (raw_zip(TWO, zip64=True, zip64_entries_lie=3), "ZIP_ZIP64_CONTRADICTION"), (raw_zip(TWO, zip64=True), None), (raw_zip(TWO, prepend=b"stub" * 9), None),
        (raw_zip([{"name": "empty", "data": b"", "method": 8}]), None),
    ],
)
def test_refusals(data, code):
    assert code_of(lambda: read_all(data)) == code


def test_diagnostics():
    def codes(data):
        a = archive(data)
        for e in a.entries:
            a.checked(e)
        return [c for c, _ in a.found]

    assert codes(raw_zip(TWO, prepend=b"stub")) == ["ZIP_PREPENDED_DATA"]
    assert codes(raw_zip([{"name": "inner", "data": raw_zip(TWO)}])) == ["ZIP_MULTIPLE_EOCD"]
    assert codes(raw_zip([{**TWO[0], "lfh_name_lie": b"other"}])) == ["ZIP_NAME_MISMATCH"]
    assert codes(raw_zip([{**TWO[0], "name": b"\xff\xfe", "flags": 0x800}])) == ["ZIP_INVALID_UTF8_NAME"]
    assert codes(raw_zip([{**TWO[0], "extra_central": b"\1\0\x40\0x"}])) == ["ZIP_EXTRA_FIELD_MALFORMED"]
    assert codes(raw_zip([{**TWO[0], "extra_central": struct.pack("<2HQ", 1, 8, 5)}])) == ["ZIP_ZIP64_EXTRA_IGNORED"]
    assert codes(raw_zip([{**TWO[0], "extra_central": struct.pack("<2HBL", 0x7075, 10, 1, 0) + b"other"}])) == ["ZIP_UNICODE_PATH_CONFLICT"]


def test_fields():
    fields, bad = reader.split_extra(struct.pack("<2HBlll", 0x5455, 13, 7, -5, 6, 7) + struct.pack("<2HBB4sB4s", 0x7875, 11, 1, 4, b"\1\2\0\0", 4, b"\5\0\0\0") + b"\0\0")
    assert not bad and reader.unix_ids(fields) == (513, 5)
    assert [reader.extra_times(fields)[f"ut_{t}"] for t in ("mtime", "atime", "ctime")] == [-5, 6, 7]
    ticks = (11_644_473_600_000 + 1234) * 10_000
    ntfs, _ = reader.split_extra(struct.pack("<2HL2H3Q", 0x000A, 32, 0, 1, 24, ticks, ticks, ticks))
    assert reader.extra_times(ntfs)["ntfs_mtime"] == 1234
    assert reader.resolve_zip64([(1, struct.pack("<QQ", 7, 9))], 0xFFFFFFFF, 0xFFFFFFFF, 3, 0) == (7, 9, 3, 0, True, False)
    assert code_of(lambda: reader.resolve_zip64([(1, struct.pack("<Q", 1 << 60))], 0xFFFFFFFF, 1, 3, 0)) == "ZIP_VALUE_UNREPRESENTABLE"
    assert reader.decode_name(bytes(range(128, 256)), 0)[0] == bytes(range(128, 256)).decode("cp437")
    assert reader.decode_name("é".encode("shift-jis", "replace"), 0, lambda b: "x")[:2] == ("x", "custom")


def test_ranged_reads():
    large = raw_zip([{"name": f"e{k:05}", "data": bytes([k % 251]) * 400} for k in range(2000)])
    source = reader.Counted(reader.Bytes(large))
    a = reader.Archive(source, resolve_limits(), codecs=codecs.codec_table())
    assert len(source.reads) == 1 and source.reads[0][1] == 131_169 and len(a.entries) == 2000
    source.reads.clear()
    assert a.read(a.entries[3]) == bytes([3]) * 400
    assert [n for _, n in source.reads] == [1054, 400]
    source.reads.clear()
    a.read(a.entries[1999])
    assert source.reads == []


def test_written_bytes():
    assert hashlib.sha256(writer.trailer(0, 0, 0)).hexdigest() == "8739c76e681f900923b900c9df0ef75cf421d39cabb54650c4b9ad19b6a76d85"
    e = {**writer.defaults(False), "name": b"n", "method": 0, "crc": zlib.crc32(b"x"), "csize": 1, "usize": 1, "flags": 0x800, "dos_date": 0x21, "dos_time": 0, "comment": b"", "extra": b"", "layout": "buffered"}
    body = writer.local_header(e) + b"x"
    data = body + writer.central_header(e, 0) + writer.trailer(1, len(writer.central_header(e, 0)), len(body))
    assert read_all(data) == [b"x"] and zipfile.ZipFile(io.BytesIO(data)).read("n") == b"x"
    many = writer.trailer(70_000, 10, 20)
    assert many[:4] == b"PK\6\6" and struct.unpack("<H", many[-12:-10])[0] == 0xFFFF
    assert struct.unpack_from("<L", writer.central_header({**e, "usize": 5 << 30}, 0), 24)[0] == 0xFFFFFFFF


@pytest.mark.parametrize("kind", ["signed", "plain", "signed64", "plain64"])
def test_forward_descriptors(kind):
    data = raw_zip([{"name": "a", "data": b"abc" * 999, "method": 8, "descriptor": kind}, {"name": "e", "data": b"", "method": 8, "descriptor": kind}, {"name": "z", "data": b"tail"}])
    want = [("a", b"abc" * 999, 2997), ("e", b"", 0), ("z", b"tail", 4)]
    for size in (1, 7, 64, 10**6):
        rows = list(forward.walk(reader.chunks(data, size), resolve_limits(), codecs.codec_table(), with_data=True))
        assert [(r["name"], r["data"], r["uncompressed_size"]) for r in rows] == want
    skipped = list(forward.walk([data], resolve_limits(), codecs.codec_table(), decode=False))
    assert [r["name"] for r in skipped] == ["a", "e", "z"]


@pytest.mark.parametrize(
    ("entry", "code"),
    [
        ({"d_crc_lie": 5, "descriptor": "signed", "method": 8}, "ZIP_CRC_MISMATCH"), ({"d_usize_lie": 5, "descriptor": "signed", "method": 8}, "ZIP_DESCRIPTOR_MISMATCH"),
        ({"descriptor": "signed", "method": 0}, "ZIP_UNSUPPORTED_CD_LESS_DESCRIPTOR"), ({"crc_lie": 5}, "ZIP_CRC_MISMATCH"), ({"usize_lie": 3}, "ZIP_SIZE_MISMATCH"), ({"flags": 1}, "ZIP_UNSUPPORTED_ENCRYPTION"), ({"method": 12}, "ZIP_UNSUPPORTED_METHOD"),
    ],
)
def test_forward_refusals(entry, code):
    rows = list(forward_rows([raw_zip([{"name": "x", "data": b"some data", **entry}])], resolve_limits(), codecs.codec_table()))
    assert rows[-1]["error_code"] == code


def test_inflator():
    data = deflate(b"abc" * 5000)
    for size in (1, 13, 10**6):
        z = codecs.Inflator(15_000)
        out = b"".join(z.push(c) for c in reader.chunks(data + b"more", size))
        z.end()
        assert out == b"abc" * 5000 and z.leftover == b"more" and (z.consumed, z.produced) == (len(data), 15_000)
    assert code_of(lambda: codecs.inflate_raw(data, 14_999)) == "ZIP_INFLATE_OUTPUT_OVERFLOW"
    assert code_of(lambda: codecs.inflate_raw(data[:-3], 15_000)) == "ZIP_DEFLATE_TRUNCATED"
    assert code_of(lambda: codecs.inflate_raw(b"\xff" * 9, 99)) == "ZIP_DEFLATE_CORRUPT"
    assert code_of(lambda: codecs.deflate_raw(b"x", 11)) == "ZIP_INVALID_OPTION"


def test_mutations_are_typed():
    """Every truncation and many flips give a typed fault or a sound read, both ways of reading."""
    whole = raw_zip([*TWO, {"name": "d", "data": b"z" * 300, "method": 8, "descriptor": "signed"}])
    draw = random.Random(0xC0FFEE)
    cases = [whole[:n] for n in range(0, len(whole), 7)]
    for _ in range(400):
        at, value = draw.randrange(len(whole)), draw.randrange(256)
        cases.append(whole[:at] + bytes([value]) + whole[at + 1 :])
    for case in cases:
        code_of(lambda case=case: read_all(case))
        for row in forward_rows([case], resolve_limits(), codecs.codec_table()):
            assert row["error_code"] is None or row["error_code"] in ERROR_CODES
