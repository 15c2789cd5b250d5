"""Files of recordings in local folders and in other stores, by Arrow's file systems."""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow.fs as fs


@dataclass(frozen=True)
class Entry:
    path: str
    size: int
    mtime_ns: int


def plain(path: str) -> str:
    """Local paths without ``file:``, ``~`` and variables; URIs of other stores as they are."""
    path = os.path.expanduser(os.path.expandvars(path))
    url = urlparse(path)
    return url.path if url.scheme == "file" else path


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path inside it, what to put before its paths to get URIs)."""
    path = plain(path)
    if "://" not in path:
        return fs.LocalFileSystem(), path, ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def kind(path: str) -> fs.FileType:
    store, inner, _ = store_of(path)
    return store.get_file_info(inner).type


def listed(path: str) -> list[Entry]:
    """The files of a folder by name, or the one file."""
    store, inner, before = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner))
    return sorted((Entry(before + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File), key=lambda e: e.path)


def size_of(path: str) -> int:
    store, inner, _ = store_of(path)
    return store.get_file_info(inner).size


def read_text(path: str) -> str:
    """FileNotFoundError if there is none."""
    store, inner, _ = store_of(path)
    with store.open_input_stream(inner) as f:
        return f.read().decode("utf-8")


def write_bytes(path: str, data: bytes) -> None:
    store, inner, _ = store_of(path)
    with store.open_output_stream(inner) as f:
        f.write(data)


def make_folder(path: str) -> None:
    store, inner, _ = store_of(path)
    store.create_dir(inner, recursive=True)


def delete(path: str) -> None:
    """Delete a file or a folder with all in it; nothing happens if there is none."""
    store, inner, _ = store_of(path)
    what = store.get_file_info(inner).type
    if what == fs.FileType.Directory:
        store.delete_dir(inner)
    elif what == fs.FileType.File:
        store.delete_file(inner)
