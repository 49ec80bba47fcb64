"""The binary count format: header, ones, multi, place_ones, place_multi, count_multi.

A file is 256 int32 of header (number of patterns, number of pixels, zeros) and then 4-byte
little-endian items, section after section. It is readable only if its size is exactly what the
header and the ones and multi sections demand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HEADER_BYTES = 1024
ITEM = np.dtype("<i4")


class DamagedFile(ValueError):
    """The bytes are not a whole count file."""


@dataclass(frozen=True)
class CountFile:
    num_pix: int
    ones: np.ndarray
    multi: np.ndarray
    place_ones: np.ndarray
    place_multi: np.ndarray
    count_multi: np.ndarray

    @property
    def num_data(self) -> int:
        return len(self.ones)


def expected_size(num_data: int, s1: int, sm: int) -> int:
    return HEADER_BYTES + ITEM.itemsize * (2 * num_data + s1 + 2 * sm)


def parse(data: bytes | memoryview | None) -> CountFile:
    """The parts of a count file; DamagedFile if its size or a row length is impossible."""
    if data is None or len(data) < HEADER_BYTES:
        raise DamagedFile("shorter than a header")
    n, num_pix = (int(x) for x in np.frombuffer(data, ITEM, 2))
    if n < 0 or num_pix < 0 or len(data) < expected_size(n, 0, 0) or (len(data) - HEADER_BYTES) % ITEM.itemsize:
        raise DamagedFile("header and size disagree")
    items = np.frombuffer(data, ITEM, offset=HEADER_BYTES)
    ones, multi = items[:n], items[n : 2 * n]
    if n and (ones.min() < 0 or multi.min() < 0):
        raise DamagedFile("negative row length")
    s1, sm = int(ones.sum(dtype=np.int64)), int(multi.sum(dtype=np.int64))
    if len(data) != expected_size(n, s1, sm):
        raise DamagedFile("size is not what the row lengths demand")
    rest = items[2 * n :]
    return CountFile(num_pix, ones, multi, rest[:s1], rest[s1 : s1 + sm], rest[s1 + sm :])


def header(num_data: int, num_pix: int) -> bytes:
    head = np.zeros(HEADER_BYTES // ITEM.itemsize, ITEM)
    head[:2] = num_data, num_pix
    return head.tobytes()


def assemble(num_pix: int, sections: list[np.ndarray]) -> bytes:
    """A whole file from its five sections; every section is cast to 4-byte items."""
    return header(len(sections[0]), num_pix) + b"".join(np.ascontiguousarray(s, ITEM).tobytes() for s in sections)
