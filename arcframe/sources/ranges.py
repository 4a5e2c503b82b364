"""Byte ranges of files that executors open themselves."""

from __future__ import annotations


def file_system(path: str) -> tuple[object, str]:
    """The file system that Arrow knows for a path, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sized_files(path: str, pattern: str = "*.zip") -> list[tuple[str, int]]:
    """The path itself if it is a file; all files below it whose names match the pattern if it is a folder; a last part with
    wildcards is the pattern. (path, size), sorted."""
    import fnmatch

    from pyarrow import fs

    folder, _, last = path.rpartition("/")
    if any(c in last for c in "*?["):
        path, pattern = folder, last
    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.Directory:
        return [(path, info.size or 0)]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    base = at.rstrip("/")
    return sorted((path.rstrip("/") + f.path[len(base) :], f.size or 0) for f in found if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))


class FileRange:
    """A file of any file system that Arrow knows, read by ranges; nothing is read until asked for."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self._file = system.open_input_file(at)
        self.size = self._file.size()

    def read(self, at: int, n: int) -> bytes:
        return self._file.read_at(n, at)

    def close(self) -> None:
        self._file.close()


def open_range(path: str) -> FileRange:
    return FileRange(path)
