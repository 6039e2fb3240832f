"""Stores that tasks open by themselves, for reading a part of a file: local folders and what pyarrow has a file system for."""

from __future__ import annotations

import re
import uuid
from fnmatch import fnmatch

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if re.match("file:", path):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
    return fs.LocalFileSystem(), path


def listed(path: str) -> list[tuple[str, int]]:
    """(URI or path, bytes) of the file, of the files in the folder, or of those that a pattern with * or ? in names meets."""
    system, own = opened(path)
    lead = path[: len(path) - len(own)] if path.endswith(own) else ""
    fixed = re.match(r"[^*?\[]*", own)[0]
    if fixed != own:
        base = fixed.rpartition("/")[0] or "/"
        found = [f for f in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if fnmatch(f.path, own) and f.path.count("/") == own.count("/")]
    else:
        info = system.get_file_info(own)
        found = system.get_file_info(fs.FileSelector(own)) if info.type == fs.FileType.Directory else [info]
    out = sorted((lead + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    if not out:
        raise FileNotFoundError(path)
    return out


def part(path: str, start: int, size: int) -> bytes:
    """Bytes of a file, fewer at its end."""
    system, own = opened(path)
    with system.open_input_file(own) as f:
        return f.read_at(size, start)


def put(path: str, content: bytes) -> None:
    """A whole file under its name or none: it is written under another one first, so that a task may run again."""
    system, own = opened(path)
    folder, _, name = own.rpartition("/")
    system.create_dir(folder, recursive=True)
    other = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(other) as f:
        f.write(content)
    system.move(other, own)
