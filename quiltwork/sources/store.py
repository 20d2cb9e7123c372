"""Files by address, on any store that pyarrow knows: local folders, HDFS, S3 and others. Tasks and driver reach the same files."""

from __future__ import annotations

import os

from pyarrow import fs


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The store of an address and the path there; addresses without a scheme are local."""
    if "://" in address:
        return fs.FileSystem.from_uri(address)
    if address.startswith("file:"):
        address = address.removeprefix("file:")
    return fs.LocalFileSystem(), os.path.abspath(address)


def listed(address: str, extensions: tuple[str, ...]) -> list[tuple[str, int]]:
    """Path and size of the files at or below an address that end in an extension, in order of path; hidden ones and those in hidden folders are left out."""
    store, root = opened(address)
    found = store.get_file_info(root)
    if found.type == fs.FileType.File:
        return [(found.path, found.size)]
    rows = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda path: any(p[:1] in "._" for p in path.removeprefix(root).strip("/").split("/"))
    return sorted((r.path, r.size) for r in rows if r.type == fs.FileType.File and r.path.lower().endswith(extensions) and not hidden(r.path))


def read(store: fs.FileSystem, path: str) -> bytes:
    with store.open_input_stream(path) as stream:
        return stream.read()


def write(store: fs.FileSystem, path: str, content: bytes) -> None:
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as stream:
        stream.write(content)
