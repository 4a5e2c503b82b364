"""Where archives come from: binary files, byte ranges of large ones, and a data source over both."""

from .archives import read_archives
from .datasource import ArchiveSource, register
from .ranges import open_range

__all__ = ["ArchiveSource", "open_range", "read_archives", "register"]
