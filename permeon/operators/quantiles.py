"""Exact quantiles by narrowing, with bounded memory in every task and on the driver.

Spark's exact ``percentile`` keeps every distinct value of a column in one
buffer. Here each round asks a sketch for a narrow value interval around each
wanted rank, counts on both sides of it, and goes on inside; when few values
are left they are ranked directly. All columns share each pass.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from permeon.functions.cleaning import finite_or_null

LEAF_ROWS = 4096
COLUMNS_PER_PASS = 64
SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class _Interval:
    """``below`` values are < lo; ``at_lo``/``interior``/``at_hi`` split the rest up to hi."""

    col: str
    rank: float
    lo: float
    hi: float
    below: int
    at_lo: int
    interior: int
    at_hi: int
    stalled: bool = False

    @property
    def inside(self) -> int:
        return self.at_lo + self.interior + (self.at_hi if self.hi > self.lo else 0)

    @property
    def open(self) -> bool:
        return not self.stalled and self.interior > LEAF_ROWS

    def holds_ranks(self) -> bool:
        first, last = math.floor(self.rank), math.ceil(self.rank)
        return self.below <= first and last < self.below + self.inside

    def edge(self, k: int) -> float | None:
        """The k-th value (0-based) if it lies on an end of the interval."""
        if k < self.below + self.at_lo:
            return self.lo
        if k >= self.below + self.at_lo + self.interior:
            return self.hi
        return None


def _tally(c: Column, lo: float, hi: float) -> list[Column]:
    lo_, hi_ = F.lit(float(lo)), F.lit(float(hi))
    return [
        F.count_if(c < lo_),
        F.count_if(c == lo_),
        F.count_if((c > lo_) & (c < hi_)),
        F.count_if(c == hi_),
    ]


def _count(df: DataFrame, cells: Sequence[_Interval], column: Mapping[str, Column]) -> list[_Interval]:
    row = df.agg(
        *[e.alias(f"t{i}_{j}") for i, s in enumerate(cells) for j, e in enumerate(_tally(column[s.col], s.lo, s.hi))]
    ).first()
    return [
        replace(s, below=row[f"t{i}_0"], at_lo=row[f"t{i}_1"], interior=row[f"t{i}_2"], at_hi=row[f"t{i}_3"])
        for i, s in enumerate(cells)
    ]


def _propose(df: DataFrame, cells: Sequence[_Interval], column: Mapping[str, Column], margin: float) -> list[_Interval]:
    # Cells that still look at the same interval share one sketch.
    shared: dict[tuple, list[int]] = {}
    for i, s in enumerate(cells):
        shared.setdefault((s.col, s.lo, s.hi), []).append(i)
    sketches, slots = [], {}
    for j, ((c, lo, hi), members) in enumerate(shared.items()):
        inside = F.when(column[c].between(F.lit(float(lo)), F.lit(float(hi))), column[c])
        points = []
        for i in members:
            s = cells[i]
            size = max(s.inside, 1)
            slots[i] = (f"p{j}", len(points))
            points.append(max(0.0, (math.floor(s.rank) - s.below) / size - margin))
            points.append(min(1.0, (math.ceil(s.rank) + 1 - s.below) / size + margin))
        grid = F.array(*[F.lit(x) for x in points])
        sketches.append(F.percentile_approx(inside, grid, SKETCH_ACCURACY).alias(f"p{j}"))
    row = df.agg(*sketches).first()
    return [
        replace(s, lo=row[slots[i][0]][slots[i][1]], hi=row[slots[i][0]][slots[i][1] + 1])
        for i, s in enumerate(cells)
    ]


def _narrow(df: DataFrame, cells: list[_Interval], column: Mapping[str, Column]) -> list[_Interval]:
    margin = 2.0 / SKETCH_ACCURACY
    while True:
        todo = [i for i, s in enumerate(cells) if s.open]
        if not todo:
            return cells
        tried = _count(df, _propose(df, [cells[i] for i in todo], column, margin), column)
        missed = False
        for i, new in zip(todo, tried):
            if new.holds_ranks():
                cells[i] = replace(new, stalled=new.interior * 2 > cells[i].interior)
            else:
                missed = True
        margin = margin * 8 if missed else margin


def _pick_interior(df: DataFrame, cells: Sequence[_Interval], column: Mapping[str, Column]) -> dict:
    """Values at the ranks that fall strictly inside an interval: (cell, rank) -> value."""
    wanted = [
        (i, k) for i, s in enumerate(cells) for k in {math.floor(s.rank), math.ceil(s.rank)} if s.edge(k) is None
    ]
    if not wanted:
        return {}
    targets = sorted({i for i, _ in wanted})
    probes = F.array(
        *[
            F.when(
                (column[cells[i].col] > F.lit(float(cells[i].lo))) & (column[cells[i].col] < F.lit(float(cells[i].hi))),
                F.struct(F.lit(i).alias("cell"), column[cells[i].col].alias("value")),
            )
            for i in targets
        ]
    )
    counts = (
        df.select(F.inline(F.array_compact(probes))).groupBy("cell", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    # A few thousand values per cell at most: the narrowing stopped at LEAF_ROWS.
    upto = Window.partitionBy("cell").orderBy("value")
    placed = counts.select("cell", "value", "n", F.sum("n").over(upto).alias("last"))
    first = {i: cells[i].below + cells[i].at_lo for i in targets}
    hit = None
    for i, k in wanted:
        offset = k - first[i]
        one = (F.col("cell") == i) & (F.col("last") > offset) & (F.col("last") - F.col("n") <= offset)
        hit = one if hit is None else hit | one
    rows = placed.filter(hit).collect()
    return {
        (i, k): r["value"]
        for i, k in wanted
        for r in rows
        if r["cell"] == i and r["last"] - r["n"] <= k - first[i] < r["last"]
    }


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column; a column without values gives Nones.

    NULL, NaN and the infinities are skipped. Wide tables are worked through some
    columns at a time; each pass then reads only those columns.
    """
    out: dict[str, list[float | None]] = {}
    for i in range(0, len(cols), COLUMNS_PER_PASS):
        out |= _exact_quantiles(df, cols[i : i + COLUMNS_PER_PASS], probs)
    return out


def _exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    df = df.select(*[finite_or_null(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(cols)])
    column = {c: F.col(f"v{i}") for i, c in enumerate(cols)}
    row = df.agg(
        *[
            e
            for i, c in enumerate(cols)
            for e in (
                F.count(column[c]).alias(f"n{i}"),
                F.min(column[c]).alias(f"lo{i}"),
                F.max(column[c]).alias(f"hi{i}"),
            )
        ]
    ).first()
    cells: list[_Interval] = []
    for i, c in enumerate(cols):
        n = row[f"n{i}"]
        if n:
            cells += [_Interval(c, p * (n - 1), row[f"lo{i}"], row[f"hi{i}"], 0, 0, n, 0) for p in probs]
    # A long column is counted after its first narrowing; a short one is ranked as it is.
    short = [i for i, s in enumerate(cells) if not s.open]
    for i, counted in zip(short, _count(df, [cells[i] for i in short], column) if short else []):
        cells[i] = counted
    cells = _narrow(df, cells, column)
    inner = _pick_interior(df, cells, column)

    out: dict[str, list[float | None]] = {c: [] for c in cols}
    for i, s in enumerate(cells):
        k0, k1 = math.floor(s.rank), math.ceil(s.rank)
        a, b = (s.edge(k) if s.edge(k) is not None else inner[(i, k)] for k in (k0, k1))
        out[s.col].append(float(a + (b - a) * (s.rank - k0)))
    return {c: v or [None] * len(probs) for c, v in out.items()}


def approx_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float | None]]:
    """Sketch quantiles in a single pass, for when a rank error of 1/accuracy will do."""
    grid = F.array(*[F.lit(float(p)) for p in probs])
    row = df.agg(
        *[F.percentile_approx(finite_or_null(F.col(f"`{c}`")), grid, accuracy).alias(f"q{i}") for i, c in enumerate(cols)]
    ).first()
    return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(cols)}
