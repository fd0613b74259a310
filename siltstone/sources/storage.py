"""Listing and opening files on any storage that Arrow knows (local, HDFS, S3, GCS), on the driver and in workers."""

from __future__ import annotations

import fnmatch
import posixpath
import re
from typing import BinaryIO

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path on it) of a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def list_files(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files with one of the suffixes below a folder or matching a pattern (*, ?), sorted.
    Paths carry the scheme of what was asked for."""
    system, inner = file_system(path)
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    if any(c in inner for c in "*?["):
        base = posixpath.dirname(inner[: min(inner.index(c) for c in "*?[" if c in inner)])
        test = re.compile(fnmatch.translate(inner)).match
    else:
        if system.get_file_info(inner).type == fs.FileType.File:
            return [(scheme + inner, system.get_file_info(inner).size)]
        base, test = inner, lambda p: True
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(suffixes) and test(f.path))


def open_file(path: str) -> BinaryIO:
    """A stream of the bytes of a file, as they are."""
    system, inner = file_system(path)
    return system.open_input_stream(inner, compression=None)
