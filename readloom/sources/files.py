"""Files on local, shared or object stores, as the executors open them."""

from __future__ import annotations

import glob
import gzip
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs as pafs


@dataclass(frozen=True)
class File:
    path: str
    size: int

    @property
    def compressed(self) -> bool:
        return self.path.endswith(".gz")


def system_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path on it; a path without a scheme is a local one."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*://", path) and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), re.sub(r"^file:/*(?=/)", "", path)


def _hidden(path: str) -> bool:
    return any(part.startswith(("_", ".")) for part in path.split("/"))


def files_of(paths: str | Sequence[str]) -> list[File]:
    """Files of a path, a local pattern, a directory with those below it, or a list of such, in order."""
    out: list[File] = []
    for p in [paths] if isinstance(paths, str) else paths:
        system, at = system_of(p)
        local = isinstance(system, pafs.LocalFileSystem)
        scheme = "" if local else p[: p.index("://") + 3]
        for one in (sorted(glob.glob(at)) or [at]) if local and not os.path.exists(at) else [at]:
            info = system.get_file_info(one)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(p)
            found = [info]
            if info.type == pafs.FileType.Directory:
                inside = system.get_file_info(pafs.FileSelector(one, recursive=True))
                files = [i for i in inside if i.type == pafs.FileType.File and not _hidden(i.path[len(one) :])]
                found = sorted(files, key=lambda i: i.path)
            out += [File(scheme + i.path, i.size) for i in found]
    return out


def open_binary(file: File, plain: bool = False) -> BinaryIO:
    """The content, decompressed if its name ends in .gz unless it is wanted as it is."""
    system, at = system_of(file.path)
    raw = open(at, "rb") if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(at)
    return gzip.open(raw, "rb") if file.compressed and not plain else raw
