"""Paths with an inner part: ``file::group``."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

SEPARATOR = "::"
#: Fixed value: the first bytes of an HDF5 file.
MAGIC = b"\x89HDF\r\n\x1a\n"


@dataclass(frozen=True)
class InnerPath:
    """A file and the name of a node in it. Iterates as (file, name)."""

    file: Path
    name: str = "/"

    def __iter__(self) -> Iterator:
        return iter((self.file, self.name))

    def __truediv__(self, child: str) -> InnerPath:
        return InnerPath(self.file, f"{self.name.rstrip('/')}/{child}")

    def __str__(self) -> str:
        return f"{self.file}{SEPARATOR}{self.name}"

    def resolve(self) -> InnerPath:
        return InnerPath(self.file.resolve(), self.name)

    def exists(self) -> bool:
        """The file is there and has the node. Looking inside needs h5py; the root needs only the file."""
        if not self.file.exists():
            return False
        if self.name.strip("/") == "":
            return True
        from countlake.sources.hdf5 import library

        with library().File(self.file, "r") as f:
            return self.name in f

    @contextmanager
    def open(self, mode: str = "r"):
        from countlake.sources.hdf5 import library

        with library().File(self.file, mode) as f:
            yield f

    @contextmanager
    def open_group(self, mode: str = "r", group_mode: str = "r", track_order: bool | None = None):
        """The node as a group; group_mode "a" creates it."""
        if group_mode not in ("r", "a"):
            raise ValueError(f"group_mode {group_mode!r} is not r or a")
        with self.open(mode) as f:
            if group_mode == "a" and self.name not in f:
                yield f.create_group(self.name, track_order=track_order)
            else:
                yield f[self.name]

    @classmethod
    def __get_pydantic_core_schema__(cls, source, handler):
        """Lets pydantic models have fields of this type: strings and paths are parsed, and written as ``file::name``."""
        from pydantic_core import core_schema

        return core_schema.no_info_plain_validator_function(inner_path, serialization=core_schema.to_string_ser_schema())

    def _repr_html_(self) -> str:
        from countlake.functions.misc import html_card

        return html_card("InnerPath", {"file": str(self.file), "name": self.name})


PathLike = str | os.PathLike | InnerPath


def split_path(text: str) -> tuple[Path, str]:
    """(file, name) of ``file::name``; an empty name is "/". A bare .h5 file counts as its root."""
    file, sep, name = text.partition(SEPARATOR)
    if SEPARATOR in name or not file or (not sep and not file.lower().endswith(".h5")):
        raise ValueError(f"{text!r} does not name a node of a file")
    return Path(file), name or "/"


def has_inner(src: PathLike) -> bool:
    """Whether src points into a file: by type, by ``::``, by suffix .h5, or by what the file begins with."""
    if isinstance(src, InnerPath):
        return True
    text = os.fspath(src)
    if text.count(SEPARATOR) == 1 or text.lower().endswith(".h5"):
        return True
    try:
        with open(text, "rb") as f:
            return f.read(len(MAGIC)) == MAGIC
    except OSError:
        return False


def inner_path(src: PathLike, name: str | None = None) -> InnerPath:
    if isinstance(src, InnerPath):
        if name is not None:
            raise TypeError("the path has a name already")
        return src
    if not isinstance(src, (str, os.PathLike)):
        raise TypeError(f"{type(src).__name__} is not a path")
    if name is not None:
        return InnerPath(Path(src), name or "/")
    text = os.fspath(src)
    return InnerPath(*split_path(text)) if SEPARATOR in text or text.lower().endswith(".h5") else InnerPath(Path(text))


def make_path(src: PathLike) -> Path | InnerPath:
    return inner_path(src) if has_inner(src) else Path(src)
