"""Entry names: decoding, the path gate of extraction, and the writer's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import UTF8

_HIGH = bytes(range(128, 256))
#: A device of Windows, with anything after a dot. \z is the very end (in Java $ also stands before a last line feed).
_DEVICE = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.|\z)"


def cp437_to_string(raw: Column) -> Column:
    """Bytes of the old IBM code page; every byte has a character."""
    return F.translate(F.decode(raw, "ISO-8859-1"), _HIGH.decode("latin-1"), _HIGH.decode("cp437"))


def decode_name(raw: Column, flags: Column) -> Column:
    """UTF-8 if bit 11 is set and the bytes are valid, else CP437."""
    utf8 = (flags.bitwiseAND(UTF8) != 0) & F.is_valid_utf8(raw.cast("string"))
    return F.when(utf8, raw.cast("string")).otherwise(cp437_to_string(raw))


def sanitize_path(name: Column) -> Column:
    """The safe relative form of an entry name, or null: no traversal, root, drive, stream, device or NUL."""
    slashed = F.replace(name, F.lit("\\"), F.lit("/"))
    segments = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    bad = F.exists(segments, lambda s: (s == "..") | s.contains(":") | s.rlike(_DEVICE))
    unsafe = (name == "") | name.contains("\0") | slashed.startswith("/") | slashed.rlike("^[A-Za-z]:") | bad | (F.size(segments) == 0)
    return F.when(~unsafe, F.array_join(segments, "/"))


def name_error(name: Column) -> Column:
    """ZIP_INVALID_ENTRY_NAME for a name that may not be written, else null. Devices and inner colons are allowed here."""
    segments = F.split(name, "/")
    bad = (name == "") | name.contains("\0") | name.contains("\\") | name.startswith("/") | name.rlike("^[A-Za-z]:") | F.array_contains(segments, "..")
    empty = F.size(F.filter(segments, lambda s: (s != "") & (s != "."))) == 0
    return F.when(F.coalesce(bad | empty, F.lit(True)), F.lit("ZIP_INVALID_ENTRY_NAME"))


def written_name(name: Column, directory: Column) -> Column:
    return F.when(directory & ~name.endswith("/"), F.concat(name, F.lit("/"))).otherwise(name)


def glob(name: Column, pattern: str) -> Column:
    """Shell pattern over whole names: * and ? stop at slashes, ** doesn't, [...] is a set."""
    import re

    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("**/", at):
            out, at = out + "(?:.*/)?", at + 3
            continue
        if pattern.startswith("**", at):
            out, at = out + ".*", at + 2
            continue
        end = pattern.find("]", at + 2) if c == "[" else -1
        if end > 0:
            inner = pattern[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
            continue
        out, at = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), at + 1
    return name.rlike(f"(?s)^{out}\\z")
