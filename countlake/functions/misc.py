"""Small helpers: sizes, ranges, bit masks, cards."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

#: Units of sizes.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB", "EB"]


def pretty_size(size: float) -> str:
    """1024 -> "1.00 KB"; what is below one KB is printed as it is."""
    if size < 1024:
        return f"{size} B"
    power = 0
    while size >= 1024 and power + 1 < len(UNITS):
        size, power = size / 1024, power + 1
    return f"{size:.2f} {UNITS[power]}"


def divide_range(start: int, stop: int, n: int) -> list[tuple[int, int]]:
    """At most n adjacent ranges that cover start .. stop, nearly equal, the longer ones first."""
    if n <= 0:
        raise ValueError(f"cannot divide into {n} ranges")
    each, longer = divmod(stop - start, n)
    edges = [start + each * k + min(k, longer) for k in range(n + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def bit_flags(flags: int | Sequence[int]) -> int:
    """An integer is a bit mask of eight bits; a sequence lists bit positions."""
    value = int(flags) if not isinstance(flags, Sequence) else sum({1 << int(i) for i in flags})
    if not 0 <= value <= 255:
        raise ValueError("masks have eight bits")
    return value


def format_value(value: object) -> str:
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{value:,}"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def html_card(title: str, metrics: dict[str, object], *, details: dict[str, object] | None = None, bars: Sequence[tuple[str, float]] = ()) -> str:
    """A plain HTML summary for notebooks: a table of facts and, for shares, meters in percent."""
    line = lambda k, v: f"<tr><th align='left'>{escape(str(k))}</th><td>{escape(format_value(v))}</td></tr>"
    rows = "".join(line(k, v) for k, v in [*metrics.items(), *(details or {}).items()])
    meters = "".join(f"<div>{escape(k)} <meter min='0' max='100' value='{min(100.0, max(0.0, v)):.1f}'></meter> {v:.1f}%</div>" for k, v in bars)
    return f"<section><strong>{escape(title)}</strong><table>{rows}</table>{meters}</section>"
