"""Reading and verifying contents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cross_check_error, declared_size_error, extent_error, is_encrypted
from ..kernel.codecs import codec_table
from ..kernel.reader import decode_payload, split_extra
from ..vocabulary import DESCRIPTOR, ZipFault
from ._run import per_archive
from .scan import LOCAL, RAW_ENTRY, entries, opened, with_derived


def _selected(archives: DataFrame, where: Column | None, limits: dict | None) -> tuple[DataFrame, tuple[str, ...]]:
    """The archives with the ordinals that ``where`` selects (a condition on entry columns), others dropped."""
    if where is None:
        return archives, ()
    return _of(archives, entries(archives, limits=limits).where(where))


def _of(archives: DataFrame, chosen: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    wanted = chosen.groupBy("archive_id").agg(F.collect_list("ordinal").alias("_wanted"))
    return archives.join(wanted, "archive_id"), ("_wanted",)


def _each(archive, row: dict) -> Iterator[dict]:
    wanted = None if row.get("_wanted") is None else set(row["_wanted"])
    return (e for e in archive.entries if wanted is None or e["ordinal"] in wanted)


def read_entries(archives: DataFrame, *, where: Column | None = None, names: list[str] | None = None, ordinals: DataFrame | None = None, verify_crc: bool = True, limits: dict | None = None, mode: str = "report") -> DataFrame:
    """(archive_id, ordinal, name, data, error_code): contents of selected entries, only those are decoded.

    ``names`` selects inside the kernel; ``where`` is any condition on entry columns and is applied before decoding, and
    ``ordinals`` is such a selection made before: (archive_id, ordinal) rows, archives without one are not opened.
    """
    start = opened(limits)
    archives, carry = _selected(archives, where, limits) if ordinals is None else _of(archives, ordinals)
    few = None if names is None else frozenset(names)

    def kernel(source, row: dict) -> Iterator[dict]:
        try:
            archive = start(source)
            found = list(_each(archive, row))
        except ZipFault as fault:
            if mode == "raise":
                raise
            yield {"ordinal": None, "name": None, "data": None, "error_code": fault.code}
            return
        for e in found:
            if few is None or e["name"] in few:
                out = {"ordinal": e["ordinal"], "name": e["name"], "data": None, "error_code": None}
                try:
                    out["data"] = archive.read(e, verify_crc)
                except ZipFault as fault:
                    if mode == "raise":
                        raise
                    out["error_code"] = fault.code
                yield out

    return per_archive(archives, kernel, "ordinal int, name string, data binary, error_code string", *carry)


def entry_chunks(archives: DataFrame, *, where: Column | None = None, size: int = 65_536, limits: dict | None = None) -> DataFrame:
    """Contents in chunks (archive_id, ordinal, chunk_no, data); a fault is a last row with error_code."""
    read = read_entries(archives, where=where, limits=limits)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length("data") - 1) / size).cast("int"))), lambda k: F.substring(F.col("data"), k * size + 1, F.lit(size)))
    return read.select("archive_id", "ordinal", "name", F.posexplode_outer(cut).alias("chunk_no", "data"), "error_code")


def raw_payloads(archives: DataFrame, *, where: Column | None = None, limits: dict | None = None, verify: bool = False, whole: bool = False) -> DataFrame:
    """Entry columns with the stored payload, undecoded, after the header checks; ``verify`` decodes it to check it too.

    An archive that doesn't open has one row, with its error_code only. ``whole``: so has one of which an entry fails
    the header checks, and none of its payloads is given.
    """
    start = opened(limits)
    archives, carry = _selected(archives, where, limits)
    codecs = codec_table()

    def kernel(source, row: dict) -> Iterator[dict]:
        try:
            archive = start(source)
            found = list(_each(archive, row))
            for e in found if whole else ():
                archive.payload_extent(e)
        except ZipFault as fault:
            yield {"error_code": fault.code}
            return
        for e in found:
            data, code = None, None
            try:
                data = archive.payload(e)
                if verify and e["compression_method"] in codecs and hasattr(codecs[e["compression_method"]], "decompress"):
                    archive.read(e)
            except ZipFault as fault:
                code = fault.code
            yield {**e, "data": data, "error_code": code}

    return with_derived(per_archive(archives, kernel, f"{RAW_ENTRY}, data binary, error_code string", *carry))


def audit(archives: DataFrame, *, decode: bool = True, limits: dict | None = None, verdict: bool = False) -> DataFrame:
    """Every entry beside its local header and, with ``decode``, the size and CRC-32 that its payload gives.

    Facts only; the checks over them are columns (see ``functions.checks``). ``descriptor``: right, width, none, or null for an
    entry that has none; ``before_directory`` and ``behind_directory``: what begins there. ``verdict`` adds a row without an ordinal for each
    archive, whose header_error is what keeps the whole archive from being read, or null.
    """
    start = opened(limits)

    def kernel(source, row: dict) -> Iterator[dict]:
        archive, fault = None, None
        try:
            archive = start(source)
            found = archive.entries
            if verdict:
                archive.check_extents()
        except ZipFault as error:
            fault = error
        if verdict:
            yield {"header_error": fault.code if fault else None}
        if fault:
            return
        layout, last = archive.layout, max((e["local_header_offset"] for e in found), default=None)
        signed = archive.record_mark(layout.cd_offset + layout.cd_size)
        for e in found:
            out = {**e, "cd_offset": layout.cd_offset, "file_length": source.size, "local": None, "header_error": None, "decode_error": None, "behind_directory": signed}
            codec = archive.codecs.get(e["compression_method"])
            out["decodable"] = None if codec is None else hasattr(codec, "decompress")
            try:
                out["local"] = archive.checked(e) if decode else archive.local(e)
            except ZipFault as fault:
                out["header_error"] = fault.code
                try:
                    out["local"] = archive.local(e)
                except ZipFault:
                    pass
            if local := out["local"]:
                forms = archive.descriptor_forms(e, local) if local["flags"] & DESCRIPTOR else {}
                wide = any(i == 1 for i, _ in split_extra(local["extra"])[0])
                out["descriptor"] = None if not local["flags"] & DESCRIPTOR else "right" if ("wide" if wide else "narrow") in forms else "width" if forms else "none"
                end = local["data_start"] + e["compressed_size"] + max(forms.values(), default=0)
                if e["local_header_offset"] == last and end + 4 <= layout.cd_offset:
                    out["before_directory"] = archive.record_mark(end)
            if decode and not out["header_error"] and not e["flags"] & 0x41 and out["decodable"]:
                try:
                    data = decode_payload(e, archive.payload(e), archive.codecs)
                    out["actual_size"], out["actual_crc"] = len(data), zlib.crc32(data)
                except ZipFault as fault:
                    out["decode_error"] = fault.code
            yield out

    facts = f"cd_offset long, file_length long, local {LOCAL}, header_error string, decodable boolean, actual_size long, actual_crc long, decode_error string, descriptor string, before_directory binary, behind_directory binary"
    return with_derived(per_archive(archives, kernel, f"{RAW_ENTRY}, {facts}"))


def verify_entries(archives: DataFrame, *, limits: dict | None = None) -> DataFrame:
    """(archive_id, ordinal, name, ok, crc_match, size_match, local_header_match, skipped, error_code)."""
    return _verified(audit(archives, limits=limits), limits)


def _verified(facts: DataFrame, limits: dict | None) -> DataFrame:
    error = F.coalesce(F.when(F.col("local").isNull(), F.col("header_error")), declared_size_error(limits or {}), extent_error(), cross_check_error())
    skipped = F.when(is_encrypted(), "encrypted").when(F.col("decodable").isNull(), "unsupported-method").when(~F.col("decodable"), "stream-only-codec")
    checked = facts.withColumns({"_error": error, "skipped": skipped})
    yes = lambda c: F.coalesce(c, F.lit(False)) & F.col("skipped").isNull()
    checked = checked.withColumns({
        "local_header_match": F.col("_error").isNull(), "crc_match": yes(F.col("actual_crc") == F.col("crc32")), "size_match": yes(F.col("actual_size") == F.col("uncompressed_size")),
    })
    code = F.coalesce("_error", "decode_error", F.when(F.col("skipped").isNull() & ~F.col("size_match"), "ZIP_SIZE_MISMATCH"), F.when(F.col("skipped").isNull() & ~F.col("crc_match"), "ZIP_CRC_MISMATCH"))
    ok = F.col("local_header_match") & F.col("crc_match") & F.col("size_match")
    return checked.select("archive_id", "ordinal", "name", ok.alias("ok"), "crc_match", "size_match", "local_header_match", "skipped", code.alias("error_code"))


def verify_archives(archives: DataFrame, *, limits: dict | None = None) -> DataFrame:
    """(archive_id, ok, error_code, entry_count, failed): entries that are sound or rightly skipped make an archive ok.

    One pass over the archives: the kernel gives each a row of its own beside those of its entries.
    """
    each = _verified(audit(archives, limits=limits, verdict=True), limits)
    entry = F.col("ordinal").isNotNull()
    fine = F.col("ok") | (F.col("skipped").isin("encrypted", "stream-only-codec") & F.col("local_header_match"))
    code = F.max(F.when(~entry, F.col("error_code"))).alias("error_code")
    found = each.groupBy("archive_id").agg(code, F.count_if(entry).alias("n"), F.count_if(entry & ~F.coalesce(fine, F.lit(False))).alias("bad"))
    whole = F.col("error_code").isNull()
    n, bad = (F.when(whole, F.col(c)).otherwise(0) for c in ("n", "bad"))
    return found.select("archive_id", (whole & (bad == 0)).alias("ok"), "error_code", n.alias("entry_count"), bad.alias("failed"))
