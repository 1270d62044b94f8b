"""Files and byte ranges of a store that the driver and the executors share, by pyarrow's file systems."""

from __future__ import annotations

import os
import uuid


def open_fs(uri: str):
    """(file system, path in it) of a URI or an absolute local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def listed(uri: str, *endings: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder and its folders with one of the endings, by name.

    Names that begin with a dot or an underscore, as unfinished ones do, are left out.
    """
    from pyarrow import fs

    store, path = open_fs(uri)
    here = store.get_file_info(path)
    if here.type == fs.FileType.File:
        return [(path, here.size)]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    seen = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(endings) and f.base_name[0] not in "._"]
    return sorted(seen)


def read_range(store, path: str, start: int = 0, length: int | None = None) -> bytes:
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def write_whole(uri: str, data: bytes) -> None:
    """Under another name first, so that a task that is run again leaves no half file."""
    store, path = open_fs(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)
