"""Operators over archive tables: (archive_id, content binary) or (archive_id, path string) rows in, DataFrames out."""

from .content import audit, entry_chunks, raw_payloads, read_entries, verify_archives, verify_entries
from .extract import extract, extraction_plan
from .forward import forward_entries, trust_differences
from .modify import canonicalize, dead_bytes, modify
from .reports import assertions, determinism, determinism_offenders, inventory, iso_findings
from .scan import diagnostics, entries, layout, local_headers, point_lookup
from .write import pack, pack_raw, segments, split_chunks, transplant, write_archives

__all__ = [
    "assertions", "audit", "canonicalize", "dead_bytes", "determinism", "determinism_offenders", "diagnostics", "entries", "entry_chunks", "extract", "extraction_plan",
    "forward_entries", "inventory", "iso_findings", "layout", "local_headers", "modify", "pack", "pack_raw", "point_lookup", "raw_payloads", "read_entries", "segments", "split_chunks",
    "transplant", "trust_differences", "verify_archives", "verify_entries", "write_archives",
]
