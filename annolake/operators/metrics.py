"""Precision, recall and their summaries from matches, all groups in one pass.

A metric that has no ground truth has no row: absence is never a number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolake.functions import geometry
from annolake.sources.shared import settled

#: Recall levels at which precision is read, prefixes of a detection list, and the usual settings.
LEVELS, PREFIXES, MOST = 101, (1, 10, 100), 100
#: The scope of all sets together.
WHOLE = "<Concat>"
THRESHOLDS_2D = [0.5 + 0.05 * i for i in range(10)]
THRESHOLDS_3D = [0.05 + 0.05 * i for i in range(10)]
AREAS_2D = [("all", 0.0, 1e10), ("small", 0.0, 1024.0), ("medium", 1024.0, 9216.0), ("large", 9216.0, 1e10)]
AREAS_3D = [("all", 0.0, 1e5), ("near", 0.0, 10.0), ("medium", 10.0, 35.0), ("far", 35.0, 1e5)]


def positives(gt: DataFrame, areas: list[tuple[str, float, float]], size_col: str = "area", by: tuple[str, ...] = ("category_name",)) -> DataFrame:
    """(by, area_range, npig): the truths that count in each range."""
    a = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")) for n, lo, hi in areas))).alias("a")
    inside = ~F.col("ignore") & (F.col(size_col) >= F.col("a.lo")) & (F.col(size_col) <= F.col("a.hi"))
    return gt.select(*by, size_col, "ignore", a).where(inside).groupBy(*by, F.col("a.n").alias("area_range")).agg(F.count("*").alias("npig"))


def precision_recall(matches: DataFrame, npig: DataFrame, prefixes: tuple[int, ...] = (MOST,), by: tuple[str, ...] = ("category_name",), ties: tuple[str, ...] = ("image_id", "rank", "det_id"), bands: int | None = None) -> DataFrame:
    """Running precision and recall with the envelope: keys, pos, rc, before (the recall one row earlier), pr, env, score, npig.

    Ignored detections count on neither side. Sampled splitters over (group, score, ties) cut the matches into bands of about
    equal size, as many as there are shuffle partitions, so that a group of a third of all detections, with whatever
    distribution of scores, is sorted by many tasks. Counts run within a band and are written once; what the better bands hold is
    added from a table with a row for each group and band. The envelope likewise runs from the worse end of a band, with the
    best of the worse bands. The ties must tell all rows of a group apart.
    """
    keys = [*by, "area_range", "thr", "max_dets"]
    rows = matches.select("*", F.explode(F.array(*map(F.lit, prefixes))).alias("max_dets")).where(F.col("rank") <= F.col("max_dets"))
    counts = F.when(F.col("matched").isNotNull() & ~F.col("ignored"), 1).otherwise(0)
    wrong = F.when(F.col("matched").isNull() & ~F.col("ignored"), 1).otherwise(0)
    order = [*keys, F.desc("score"), *ties]
    rows = rows.select(*keys, *(t for t in ties if t not in keys), "score", counts.alias("tp_row"), wrong.alias("fp_row"))
    n = bands or int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).withColumn("band", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "band").orderBy(F.desc("score"), *ties)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*keys, "band", "score", "tp_row", "fp_row", F.sum("tp_row").over(so_far).alias("tp"), F.sum("fp_row").over(so_far).alias("fp"), F.row_number().over(inside).alias("pos"))
    rows = settled(rows, "curve")
    better = Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*keys, "band").agg(F.sum("tp_row").alias("tp_in"), F.sum("fp_row").alias("fp_in"), F.count("*").alias("n_in"))
    held = held.select(*keys, "band", *(F.coalesce(F.sum(f"{c}_in").over(better), F.lit(0)).alias(f"{c}_0") for c in ("tp", "fp", "n")))
    rows = rows.join(held, [*keys, "band"]).join(npig, [*by, "area_range"])
    tp, total = F.col("tp") + F.col("tp_0"), F.col("tp") + F.col("tp_0") + F.col("fp") + F.col("fp_0")
    rows = rows.select(*keys, "band", (F.col("pos") + F.col("n_0")).alias("pos"), (tp / F.col("npig")).alias("rc"), ((tp - F.col("tp_row")) / F.col("npig")).alias("before"), F.when(total > 0, tp / total).otherwise(0.0).alias("pr"), "score", "npig")
    worse = Window.partitionBy(*keys).orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    best = rows.groupBy(*keys, "band").agg(F.max("pr").alias("best")).select(*keys, "band", F.max("best").over(worse).alias("beyond"))
    back = Window.partitionBy(*keys, "band").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.max("pr").over(back)).join(best, [*keys, "band"])
    return rows.select(*keys, "pos", "rc", "before", "pr", F.greatest("own", "beyond").alias("env"), "score", "npig")


def _levels_of(levels: int) -> tuple[Column, Column]:
    """First and last recall level that a row of the curve answers for: those above the recall before it, up to its own."""
    last = levels - 1
    low = F.when(F.col("pos") == 1, 0).otherwise(F.floor(F.col("before") * last + 1e-9) + 1)
    return low.cast("int"), F.floor(F.col("rc") * last + 1e-9).cast("int")


def interpolate(curve: DataFrame, by: tuple[str, ...] = ("category_name",), levels: int = LEVELS) -> DataFrame:
    """(keys, level, precision, score): at each recall level the envelope at the first position that reaches it, else 0.

    A position answers for the levels between the recall before it and its own, so nothing is multiplied by the levels.
    """
    keys = [*by, "area_range", "thr", "max_dets"]
    lo, hi = _levels_of(levels)
    rows = curve.withColumns({"lo": lo, "hi": hi}).where("hi >= lo")
    return rows.select(*keys, F.explode(F.sequence("lo", "hi")).alias("level"), F.col("env").alias("precision"), "score")


def average_precision(curve: DataFrame, npig: DataFrame, thresholds: int, by: tuple[str, ...] = ("category_name",), prefixes: tuple[int, ...] = (MOST,), levels: int = LEVELS) -> DataFrame:
    """(by, area_range, max_dets, thr, npig, ap, ar): mean precision over the levels, and final recall, from one pass over the
    curve; 0 where nothing was detected."""
    keys = [*by, "area_range", "thr", "max_dets"]
    groups = npig.select(*by, "area_range", "npig", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("thr")).select("*", F.explode(F.array(*map(F.lit, prefixes))).alias("max_dets"))
    lo, hi = _levels_of(levels)
    found = curve.groupBy(*keys).agg((F.sum(F.col("env") * F.greatest(hi - lo + 1, F.lit(0))) / levels).alias("ap"), F.max("rc").alias("ar"))
    return groups.join(found, keys, "left").select(*keys, "npig", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


def average_recall(matches: DataFrame, npig: DataFrame, thresholds: int, by: tuple[str, ...] = ("category_name",), prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """(by, area_range, thr, max_dets, ar) by counting alone: the final recall needs no order."""
    counts = matches.where("matched IS NOT NULL AND NOT ignored").groupBy(*by, "area_range", "thr").agg(*(F.count_if(F.col("rank") <= m).alias(f"tp_{m}") for m in prefixes))
    return _recalls(npig, counts, thresholds, by, prefixes)


def _recalls(npig: DataFrame, counts: DataFrame, thresholds: int, by: tuple[str, ...], prefixes: tuple[int, ...]) -> DataFrame:
    groups = npig.select(*by, "area_range", "npig", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("thr"))
    rows = groups.join(counts, [*by, "area_range", "thr"], "left")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("max_dets"), (F.coalesce(F.col(f"tp_{m}"), F.lit(0)) / F.col("npig")).alias("ar")) for m in prefixes))).alias("x")
    return rows.select(*by, "area_range", "thr", each).select(*by, "area_range", "thr", "x.*")


def _cell_names(rows: DataFrame, areas: list[tuple[str, float, float]], thresholds: int) -> DataFrame:
    """rows with the area_range and thr of their cell."""
    return rows.withColumn("area_range", F.element_at(F.array(*(F.lit(n) for n, *_ in areas)), (F.floor(F.col("cell") / thresholds) + 1).cast("int"))).withColumn("thr", F.col("cell") % thresholds)


def _in_cells(rows: DataFrame, cells: int) -> DataFrame:
    return rows.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))


def _reached(by: int, own: bool):
    """Of a band of a group, for each cell: the levels that its hits newly reach with the envelope within the band, and the band's best precision.
    own: for each scope too, from the rows that are its own (column `set`)."""
    def curve(rows: pa.Table, before: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if before.num_rows and rows.num_rows:
            rows = rows.sort_by("at")
            hits, misses = (rows.column(c).to_numpy() for c in ("hits", "misses"))
            of = {WHOLE: (hits, misses)}
            for o in before.column("o")[0].as_py():
                scope = o["scope"] if own else WHOLE
                if scope not in of:
                    inside = pc.fill_null(pc.equal(rows.column("set"), scope), False).to_numpy()
                    of[scope] = hits[inside], misses[inside]
                h, m = of[scope]
                at = np.flatnonzero((h >> o["cell"]) & 1)
                if not len(at):
                    continue
                tp = o["tp_0"] + np.arange(1, len(at) + 1)
                fp = o["fp_0"] + np.cumsum((m >> o["cell"]) & 1)[at]
                env = np.maximum.accumulate((tp / (tp + fp))[::-1])[::-1]
                low = np.where(tp == 1, -1, (LEVELS - 1) * (tp - 1) // o["npig"])
                levels = (LEVELS - 1) * tp // o["npig"] - low
                out.append((scope, o["cell"], 0, None, float(env[0])))
                out += [(scope, o["cell"], int(levels[i]), float(env[i]), None) for i in np.flatnonzero(levels > 0)]
        scopes, cells, levels, found, best = zip(*out, strict=True) if out else ([], [], [], [], [])
        keys = [c.take(pa.array(np.zeros(len(out), int))) for c in rows.columns[: by + 1]] if rows.num_rows else [pa.array([], f.type) for f in rows.schema][: by + 1]
        columns = {**dict(zip(rows.column_names, keys, strict=False)), **({"scope": pa.array(scopes, pa.string())} if own else {})}
        return pa.table({**columns, "cell": pa.array(cells, pa.int32()), "levels": pa.array(levels, pa.int32()), "own": pa.array(found, pa.float64()), "best": pa.array(best, pa.float64())})

    return curve


def cell_precision(cells: DataFrame, npig: DataFrame, areas: list[tuple[str, float, float]], thresholds: int, by: tuple[str, ...] = ("category_name",), ties: tuple[str, ...] = ("image_id", "rank", "det_id"), bands: int | None = None, own: str | None = None) -> DataFrame:
    """average_precision from match_cells: (by, area_range, thr, max_dets, npig, ap, ar), at most MOST detections of an image and category.

    A detection is sorted once, whatever the number of ranges and thresholds, and only if it is not ignored everywhere. The bands are
    those of precision_recall; what the better ones hold comes from a table with a row for each group, band and cell. A band gives
    only the levels that it newly reaches, at most LEVELS of a group and cell, and its best precision for the better bands.

    own: a column of which each value is a group of its own as well; the result and npig have the further key `scope` of both_scopes. The ties
    must begin with it, so that the order of all is also that of each, and a detection is still sorted once.
    """
    if own and ties[0] != own:
        raise ValueError(f"ties must begin with {own}")
    count, all_by = len(areas) * thresholds, (["scope"] if own else []) + [*by]
    key, order = [*all_by, "cell"], [*by, F.desc("score"), *ties]
    rows = cells.where((F.col("rank") <= MOST) & ((F.col("hits") != 0) | (F.col("misses") != 0)))
    n = bands or int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_set = [F.col(own).cast("string").alias("set")] if own else []
    rows = rows.select(*dict.fromkeys([*by, "score", *ties, "hits", "misses"])).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = settled(rows.select(*by, F.spark_partition_id().alias("band"), F.monotonically_increasing_id().alias("at"), *of_set, "hits", "misses"), "curve")
    held = rows.groupBy(*by, "band", *(["set"] if own else []), "hits", "misses").agg(F.count("*").alias("k"))
    if own:
        held = both_scopes(held, "set")
    held = _in_cells(held, count).groupBy(*key, "band").agg(*(F.sum(F.expr(f"(shiftright({c}, cell) & 1) * k")).alias(f"{t}_in") for c, t in (("hits", "tp"), ("misses", "fp"))))
    held = settled(held, "held")
    better = Window.partitionBy(*key).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.select(*key, "band", *(F.coalesce(F.sum(f"{t}_in").over(better), F.lit(0)).alias(f"{t}_0") for t in ("tp", "fp")))
    sums = _cell_names(sums, areas, thresholds).join(npig, [*all_by, "area_range"])
    before = sums.groupBy(*by, "band").agg(F.collect_list(F.struct(*(["scope"] if own else []), "cell", "tp_0", "fp_0", "npig")).alias("o"))
    kinds = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*by, "band")), *(["scope string"] if own else [])])
    reached = rows.groupBy(*by, "band").cogroup(before.groupBy(*by, "band")).applyInArrow(_reached(len(by), bool(own)), f"{kinds}, cell int, levels int, own double, best double")
    worse = Window.partitionBy(*key).orderBy(F.desc("band")).rangeBetween(Window.unboundedPreceding, -1)
    found = reached.withColumn("beyond", F.max("best").over(worse)).groupBy(*key).agg((F.sum(F.col("levels") * F.greatest("own", "beyond")) / LEVELS).alias("ap"))
    found = held.groupBy(*key).agg(F.sum("tp_in").alias("tp")).join(found, key, "left")
    groups = npig.select(*all_by, "area_range", "npig", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("thr"))
    out = groups.join(_cell_names(found, areas, thresholds), [*all_by, "area_range", "thr"], "left")
    return out.select(*all_by, "area_range", "thr", F.lit(MOST).alias("max_dets"), "npig", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce(F.col("tp") / F.col("npig"), F.lit(0.0)).alias("ar"))


def cell_positives(cells: DataFrame, areas: list[tuple[str, float, float]], by: tuple[str, ...] = ("category_name",)) -> DataFrame:
    """positives from the truths' rows of matching.scene_cells; rows with the same hits are counted together first."""
    same = cells.where("rank = 0").groupBy(*by, "hits").agg(F.count("*").alias("k"))
    area = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for i, (n, *_) in enumerate(areas)))).alias("a")
    inside = same.select(*by, "hits", "k", area).where("shiftright(hits, a.i) & 1 = 1")
    return inside.groupBy(*by, F.col("a.n").alias("area_range")).agg(F.sum("k").alias("npig"))


def cell_recall(cells: DataFrame, npig: DataFrame, areas: list[tuple[str, float, float]], thresholds: int, by: tuple[str, ...] = ("category_name",), prefixes: tuple[int, ...] = PREFIXES) -> DataFrame:
    """average_recall from match_cells: rows with the same hits and place are counted together first."""
    place = F.coalesce(*(F.when(F.col("rank") <= m, m) for m in sorted(prefixes)))
    same = cells.where("hits <> 0").groupBy(*by, "hits", place.alias("place")).agg(F.count("*").alias("k")).where("place IS NOT NULL")
    bit = F.expr("(shiftright(hits, cell) & 1) * k")
    counts = _cell_names(_in_cells(same, len(areas) * thresholds), areas, thresholds).groupBy(*by, "area_range", "thr").agg(*(F.sum(F.when(F.col("place") <= m, bit).otherwise(0)).alias(f"tp_{m}") for m in prefixes))
    return _recalls(npig, counts, thresholds, by, prefixes)


def summarize(table: DataFrame, recalls: DataFrame, mode: str = "2D", by: tuple[str, ...] = ()) -> DataFrame:
    """The thirteen statistics, one row per `by`: means over the groups that exist, null where none does. recalls: average_recall."""
    parts = ("small", "medium", "large") if mode == "2D" else ("near", "medium", "far")
    named = (("ap50", 0), ("ap75", 5), ("ap95", 9)) if mode == "2D" else (("ap15", 2), ("ap25", 4), ("ap50", 9))
    whole = F.col("area_range") == "all"
    stats = [F.avg(F.when(whole, F.col("ap"))).alias("ap")]
    stats += [F.avg(F.when(whole & (F.col("thr") == i), F.col("ap"))).alias(n) for n, i in named]
    stats += [F.avg(F.when(F.col("area_range") == p, F.col("ap"))).alias(f"ap_{p}") for p in parts]
    ars = [F.avg(F.when(whole & (F.col("max_dets") == m), F.col("ar"))).alias(f"ar_{m}") for m in PREFIXES]
    ars += [F.avg(F.when((F.col("area_range") == p) & (F.col("max_dets") == MOST), F.col("ar"))).alias(f"ar_{p}") for p in parts]
    table = table.where(F.col("max_dets") == MOST)
    if by:
        return table.groupBy(*by).agg(*stats).join(recalls.groupBy(*by).agg(*ars), list(by))
    return table.agg(*stats).crossJoin(recalls.agg(*ars))  # one row each


def category_ap(table: DataFrame, by: tuple[str, ...] = ("category_name",)) -> DataFrame:
    """(by, ap): AP in percent per category, over thresholds, all areas and 100 detections."""
    return table.where("area_range = 'all' AND max_dets = 100").groupBy(*by).agg((F.avg("ap") * 100).alias("ap"))


def vocabulary_mean(per_category: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """(vocabulary, ap): the mean AP of a named vocabulary, null unless all of it was evaluated; NaN passes through."""
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("vocabulary"), F.array(*map(F.lit, v)).alias("names")) for n, v in vocabularies.items()))).alias("v")
    listed = per_category.sparkSession.range(1).select(rows).select("v.vocabulary", F.explode("v.names").alias("category_name"))
    joined = listed.join(per_category.select("category_name", "ap"), "category_name", "left")
    return joined.groupBy("vocabulary").agg(F.when(F.expr("count_if(ap IS NULL)") == 0, F.avg("ap")).alias("ap"))


def both_scopes(matches: DataFrame, order_col: str = "dataset_id") -> DataFrame:
    """matches once for their own set and once for all sets together (`scope`); ties over all sets go by set, then image."""
    own = matches.withColumn("scope", F.col(order_col).cast("string"))
    return own.unionByName(matches.withColumn("scope", F.lit(WHOLE)))


def localisation_errors(best: DataFrame) -> DataFrame:
    """Mean errors of matched pairs. best: structs g and d with u, v, z, w, h, l and optionally r, a rotation."""
    out = [F.avg(F.sqrt((F.col("g.u") - F.col("d.u")) ** 2 + (F.col("g.v") - F.col("d.v")) ** 2)).alias("pixel_error")]
    out += [F.avg(F.abs(F.col(f"g.{c}") - F.col(f"d.{c}"))).alias(f"{c}_error") for c in ("z", "w", "h", "l")]
    if "r" in best.schema["g"].dataType.names:
        out.append(F.avg(geometry.rotation_angle(F.col("g.r"), F.col("d.r"))).alias("angle_error"))
    return best.agg(F.count("*").alias("n"), *out)
