"""Row layouts and the small facts that a table of rows does not hold itself."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from enum import IntFlag
from typing import NamedTuple, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame

ROWS = "pattern_id long, place_ones array<int>, place_multi array<int>, count_multi array<int>"
ENTRIES = "pattern_id long, pixel_id int, cnt long"
PIXELS = "pixel_id int, qx double, qy double, qz double, factor double, mask int"


class PixelType(IntFlag):
    """Fixed values of the pixel mask."""

    GOOD = 0
    CORNER = 1
    BAD = 2


class SparsePattern(NamedTuple):
    """One pattern: places that counted once, and places with higher counts."""

    num_pix: int
    place_ones: list[int]
    place_multi: list[int]
    count_multi: list[int]

    def dense(self) -> np.ndarray:
        out = np.zeros(self.num_pix, np.int64)
        out[list(self.place_ones)] = 1
        out[list(self.place_multi)] = self.count_multi
        return out


@dataclass(frozen=True)
class PatternMeta:
    num_data: int
    num_pix: int
    format_version: str = "2"

    def to_json(self) -> str:
        return json.dumps(asdict(self))


@dataclass(frozen=True)
class DetectorMeta:
    num_pix: int
    detd: float
    ewald_rad: float

    def to_json(self) -> str:
        return json.dumps(asdict(self))


@runtime_checkable
class PatternSource(Protocol):
    """Anything that yields patterns: ``rows`` in the layout ROWS, and ``meta``."""

    meta: PatternMeta

    @property
    def rows(self) -> DataFrame: ...
