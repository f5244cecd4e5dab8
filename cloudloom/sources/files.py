"""Files by path or URI, the same on the driver and on executors."""

from __future__ import annotations

import fnmatch
import os
from typing import BinaryIO


def _store(path: str):
    """The store and the path in it, for a path with a scheme; None for a plain one."""
    if "://" not in path or path.startswith("file:"):
        return None, path.removeprefix("file://").removeprefix("file:")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def open_read(path: str) -> BinaryIO:
    store, inner = _store(path)
    return open(inner, "rb") if store is None else store.open_input_file(inner)


def open_write(path: str) -> BinaryIO:
    store, inner = _store(path)
    if store is not None:
        return store.open_output_stream(inner)
    os.makedirs(os.path.dirname(inner) or ".", exist_ok=True)
    return open(inner, "wb")


def move(source: str, target: str) -> None:
    store, inner = _store(source)
    if store is None:
        os.replace(inner, _store(target)[1])
    else:
        store.move(inner, _store(target)[1])


def remove(path: str) -> None:
    store, inner = _store(path)
    if store is not None:
        store.delete_file(inner)
    elif os.path.exists(inner):
        os.remove(inner)


def listed(path: str, patterns: tuple[str, ...]) -> list[str]:
    """Files of a folder whose names fit, whatever their case, in order; a path that is a file is itself."""
    store, inner = _store(path)
    if store is None:
        if os.path.isfile(inner):
            return [path]
        names = sorted(os.listdir(inner)) if os.path.isdir(inner) else []
        return [os.path.join(path, n) for n in names if any(fnmatch.fnmatch(n.lower(), p) for p in patterns)]
    from pyarrow import fs

    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else []
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File)
    return [f"{path.rstrip('/')}/{n}" for n in names if any(fnmatch.fnmatch(n.lower(), p) for p in patterns)]
