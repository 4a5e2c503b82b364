"""Closed vocabularies: error codes, diagnostics, limits, flags and record signatures."""

from __future__ import annotations

import math

# The codes that results carry.
ERROR_KINDS = {
    "base": ("ZIP_INVALID_OPTION", "ZIP_INPUT_TOO_LARGE", "ZIP_ENTRY_NOT_FOUND", "ZIP_ENTRY_EXISTS", "ZIP_API_MISUSE", "ZIP_STRICT_DIAGNOSTIC", "ZIP_INTERNAL"),
    "format": (
        "ZIP_EOCD_NOT_FOUND", "ZIP_EOCD_INCONSISTENT", "ZIP_ZIP64_LOCATOR_MISSING", "ZIP_ZIP64_EOCD_MISPLACED", "ZIP_CD_INCONSISTENT", "ZIP_RECORD_TRUNCATED",
        "ZIP_SIGNATURE_MISMATCH", "ZIP_STREAM_TRUNCATED", "ZIP_VALUE_UNREPRESENTABLE", "ZIP_INVALID_ENTRY_NAME", "ZIP_DUPLICATE_ENTRY_NAME", "ZIP_DEFLATE_TRUNCATED", "ZIP_DEFLATE_CORRUPT",
    ),
    "security": ("ZIP_ENTRY_OVERLAP", "ZIP_CD_LFH_MISMATCH", "ZIP_ZIP64_CONTRADICTION", "ZIP_PATH_TRAVERSAL", "ZIP_SYMLINK_REJECTED", "ZIP_EXTRACT_DUPLICATE_PATH"),
    "data": ("ZIP_CRC_MISMATCH", "ZIP_SIZE_MISMATCH", "ZIP_INFLATE_OUTPUT_OVERFLOW", "ZIP_DESCRIPTOR_MISMATCH", "ZIP_DECOMPRESSION_FAILED"),
    "limit": ("ZIP_LIMIT_EXCEEDED", "ZIP_LIMIT_INVALID"),
    "unsupported": (
        "ZIP_UNSUPPORTED_ENCRYPTION", "ZIP_UNSUPPORTED_METHOD", "ZIP_UNSUPPORTED_MULTI_DISK", "ZIP_UNSUPPORTED_ZIP64_STREAMING", "ZIP_UNSUPPORTED_CD_LESS_DESCRIPTOR", "ZIP_UNSUPPORTED_CODEC_MODE",
    ),
}
ERROR_CODES = {code: kind for kind, codes in ERROR_KINDS.items() for code in codes}
DIAGNOSTICS = {
    "ZIP_PREPENDED_DATA": "info", "ZIP_MULTIPLE_EOCD": "info", "ZIP_NAME_MISMATCH": "warning", "ZIP_UNICODE_PATH_CONFLICT": "warning",
    "ZIP_INVALID_UTF8_NAME": "warning", "ZIP_DUPLICATE_NAME": "warning", "ZIP_EXTRA_FIELD_MALFORMED": "warning", "ZIP_TIMESTAMP_NOT_PINNED": "info",
    "ZIP_TIMESTAMP_CLAMPED": "info", "ZIP_NONDETERMINISTIC_CODEC": "info", "ZIP_DEAD_BYTES_RATIO": "info", "ZIP_ZIP64_EXTRA_IGNORED": "warning",
}
DEFAULT_LIMITS = {
    "max_entries": 100_000, "max_entry_uncompressed_size": 1 << 30, "max_entry_compressed_size": (1 << 30) + (1 << 20), "max_total_uncompressed_size": 8 << 30,
    "max_compression_ratio": 1024, "max_name_bytes": 4096, "max_extra_field_bytes": 65_535, "max_comment_bytes": 65_535, "max_central_directory_bytes": 256 << 20,
}
SKIP_REASONS = ("encrypted", "stream-only-codec", "unsupported-method")
CONCERNS = ("timestamp", "order", "utf8-flag", "extra-field", "version-made-by", "data-descriptor")
STORE, DEFLATE, AES = 0, 8, 99
ENCRYPTED, DESCRIPTOR, STRONG, UTF8 = 0x0001, 0x0008, 0x0040, 0x0800
MADE_BY, EPOCH_DATE, EPOCH_TIME = 0x032D, 0x0021, 0
SAFE_INTEGER = (1 << 53) - 1


class ZipFault(Exception):
    """One of the stable error codes, with what is known about it."""

    def __init__(self, code: str, message: str, entry: str | None = None, **payload: object):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.entry, self.payload = code, message, entry, payload

    @property
    def kind(self) -> str:
        return ERROR_CODES[self.code]


def resolve_limits(overrides: dict[str, float] | None = None) -> dict[str, float]:
    """The nine bounds, with overrides: known names, positive numbers, infinity allowed."""
    limits: dict[str, float] = dict(DEFAULT_LIMITS)
    for name, value in (overrides or {}).items():
        if name not in limits or isinstance(value, bool) or not isinstance(value, (int, float)) or math.isnan(value) or value <= 0:
            raise ZipFault("ZIP_LIMIT_INVALID", f"{name} = {value!r} is no limit")
        limits[name] = value
    return limits


def enforce(limits: dict[str, float], name: str, observed: float, what: str) -> None:
    """At the bound passes; beyond it doesn't."""
    if observed > limits[name]:
        raise ZipFault("ZIP_LIMIT_EXCEEDED", f"{what}: {observed} is over {name} = {limits[name]}", limit=name, configured=limits[name], observed=observed)
