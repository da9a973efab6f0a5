"""Joins of overlapping boxes and intervals through grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of the finest cells, and how often it doubles at each level of the grid.
CELL, LEVELS = 256.0, (0, 2, 4)


def _placed(df: DataFrame, spans: list[tuple[str, str]], cell: float, levels: tuple[int, ...], mark: str) -> DataFrame:
    """df once for each cell it covers at its own level, the first whose cells are as wide as it, and at all coarser ones."""
    wide = F.greatest(*(F.col(hi) - F.col(lo) for lo, hi in spans)) if len(spans) > 1 else F.col(spans[0][1]) - F.col(spans[0][0])
    own = F.lit(levels[-1])
    for level in reversed(levels[:-1]):
        own = F.when(wide <= cell * 2.0**level, level).otherwise(own)
    rows = df.withColumn(f"_own{mark}", own).withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(f"_own{mark}"))))
    rows = rows.withColumn(f"_side{mark}", F.lit(cell) * F.pow(F.lit(2.0), F.col("_level")))
    for i, (lo, hi) in enumerate(spans):
        rows = rows.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(F.col(lo) / F.col(f"_side{mark}")), F.floor(F.col(hi) / F.col(f"_side{mark}")))))
    return rows


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_spans: list[tuple[str, str]], b_spans: list[tuple[str, str]], cell: float = CELL, levels: tuple[int, ...] = LEVELS, closed: bool = False, also: Column | None = None) -> DataFrame:
    """The pairs of a and b with equal keys whose spans overlap in every dimension; closed: also those that only touch.

    spans: columns of the least and greatest place in each dimension (x1, x2), (y1, y2); the columns of a and b but for the keys must
    differ in name. A row stands in the few cells it covers at its level and once or so at each coarser one, so it is never
    multiplied by its size, and rows of one key spread over cells. A pair meets in all cells that both cover, at all levels they
    share, and is given in one: at the coarser one of its two levels, in the cell of the first corner of what they share. So the
    pairs that are formed grow with what lies near, not with the square of a key's rows. `also`: a further condition of the pairs.
    """
    met = _placed(a, a_spans, cell, levels, "a").join(_placed(b, b_spans, cell, levels, "b"), [*keys, "_level", *(f"_c{i}" for i in range(len(a_spans)))])
    test = F.col("_level") == F.greatest("_owna", "_ownb")
    for i, ((a0, a1), (b0, b1)) in enumerate(zip(a_spans, b_spans, strict=True)):
        first, last = F.greatest(a0, b0), F.least(a1, b1)
        test &= ((first <= last) if closed else (first < last)) & (F.col(f"_c{i}") == F.floor(first / F.col("_sidea")))
    if also is not None:
        test &= also
    return met.where(test).drop("_level", "_owna", "_ownb", "_sidea", "_sideb", *(f"_c{i}" for i in range(len(a_spans))))
