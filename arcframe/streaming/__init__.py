"""Archives that arrive as streams."""

from .chunks import chunked_entries, file_stream

__all__ = ["chunked_entries", "file_stream"]
