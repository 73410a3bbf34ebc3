"""Text and SVG rendering of small results that were already aggregated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BARS = "▁▂▃▄▅▆▇█"


def sparkline(values: Sequence[float | None], width: int | None = None) -> str:
    """A bar for each value, between the series' extremes; a gap for a missing one."""
    if width and len(values) > width:
        values = values[-width:]
    known = [v for v in values if v is not None]
    if not known:
        return " " * len(values)
    low, high = min(known), max(known)
    step = lambda v: 3 if high == low else min(7, int((v - low) / (high - low) * 7))
    return "".join(" " if v is None else BARS[step(v)] for v in values)


def percentile_bar(percentile: float, width: int = 21) -> str:
    at = min(width - 1, max(0, round(percentile / 100 * (width - 1))))
    return "".join("●" if k == at else "|" if k == width // 2 else "-" for k in range(width))


def table_lines(df: DataFrame, markdown: bool = False, rows: int = 1000) -> str:
    """A report's rows as text; more than ``rows`` are refused, not cut."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report of over {rows} rows is no table to print")
    text = [[("" if v is None else f"{v:g}" if isinstance(v, float) else str(v)) for v in r] for r in found]
    if markdown:
        return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in text)])
    wide = [max(map(len, c)) for c in zip(df.columns, *text, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide, strict=True)).rstrip() for r in [list(df.columns), *text])


def line_chart(labels: Sequence[str], series: Mapping[str, Sequence[float | None]], title: str, mark: str | None = None, size: tuple[int, int] = (720, 360)) -> str:
    """An SVG line chart; a missing value breaks its line, ``mark`` gets a vertical rule."""
    wide, high = size
    top = max((v for s in series.values() for v in s if v is not None), default=1.0) or 1.0
    x = lambda k: 50 + k * (wide - 170) / max(1, len(labels) - 1)
    y = lambda v: high - 40 - v / top * (high - 90)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}"><text x="50" y="24">{escape(title)}</text>']
    if mark in labels:
        out.append(f'<line x1="{x(labels.index(mark)):.1f}" x2="{x(labels.index(mark)):.1f}" y1="40" y2="{high - 40}" stroke="#999" stroke-dasharray="4"/>')
    out += [f'<text x="{x(k):.1f}" y="{high - 20}" font-size="10">{escape(t)}</text>' for k, t in enumerate(labels)]
    for n, (name, values) in enumerate(series.items()):
        shade = f"hsl({n * 360 // max(1, len(series))},60%,45%)"
        path, pen = [], "M"
        for k, v in enumerate(values):
            if v is None:
                pen = "M"
                continue
            path.append(f"{pen}{x(k):.1f},{y(v):.1f}")
            pen = "L"
        out.append(f'<path d="{" ".join(path)}" fill="none" stroke="{shade}"/><text x="{wide - 115}" y="{60 + 16 * n}" fill="{shade}" font-size="12">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"])


def resolved(wanted: DataFrame, series: DataFrame) -> DataFrame:
    """(name, word): the series that stands for each wanted name: that of the name itself, else the first in order whose
    part before a hyphen is the name; null if there is none."""
    keyed = series.select("word", F.explode(F.array_distinct(F.array("word", F.substring_index("word", "-", 1)))).alias("name"))
    best = keyed.groupBy("name").agg(F.min(F.struct(F.col("word") != F.col("name"), "word"))["word"].alias("word"))
    return wanted.select("name").distinct().join(best, "name", "left")
