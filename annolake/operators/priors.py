"""Size and depth priors of categories."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annolake.sources.shared import settled, shared_path


def compute_priors(anns: DataFrame, vocabulary: DataFrame, fields: tuple[str, ...] = ("w3", "h3", "l3", "czm", "cym"), default_mean: float = 1.0, default_std: float = 1.0) -> DataFrame:
    """(category_name, n, <field>_mean, <field>_std) for the vocabulary and "<all>": sample deviations; defaults for empty classes."""
    stats = [f(F.col(c)).alias(f"{c}_{n}") for c in fields for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    own = anns.groupBy("category_name").agg(F.count("*").alias("n"), *stats)
    every = anns.agg(F.count("*").alias("n"), *stats).withColumn("category_name", F.lit("<all>"))
    out = vocabulary.select("category_name").join(own, "category_name", "left").unionByName(every)
    return out.fillna({"n": 0} | {f"{c}_mean": default_mean for c in fields} | {f"{c}_std": default_std for c in fields})


class SortedValues:
    """Values of categories in order, with running counts and sums: how many there are up to a place, and their sum.

    Equal values are counted first; sampled splitters cut the (category, value) order into parts, and counts run within a
    part, so that a category of a third of all rows is many tasks' work. It is written once, a folder for each part. The driver
    holds a row for each category and part; a question about a place reads the part that the place lies in.
    """

    def __init__(self, rows: DataFrame, value: str):
        spark = rows.sparkSession
        self.spark, n = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        counted = rows.groupBy("category_name", F.col(value).alias("s")).agg(F.count("*").alias("c"))
        cut = counted.repartitionByRange(n, "category_name", "s").withColumn("part", F.spark_partition_id())
        so_far = Window.partitionBy("category_name", "part").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
        path = shared_path(spark, "sorted-values")
        cut.select("category_name", "part", "s", F.sum("c").over(so_far).alias("n"), F.sum(F.col("c") * F.col("s")).over(so_far).alias("total")).write.partitionBy("part").parquet(path)
        self.table = spark.read.schema("category_name string, s double, n long, total double, part int").parquet(path)
        parts = self.table.groupBy("category_name", "part").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.max("n").alias("n"), F.max_by("total", "s").alias("total")).collect()
        self.parts: dict = {}
        for r in sorted(parts, key=lambda r: r.part):
            before = self.parts.setdefault(r.category_name, [])
            n0, t0 = (before[-1][4], before[-1][5]) if before else (0, 0.0)
            before.append((r.part, r.lo, r.hi, (n0, t0), n0 + r.n, t0 + r.total))

    def ends(self, name: str) -> tuple[float, float]:
        return self.parts[name][0][1], self.parts[name][-1][2]

    def up_to(self, places: set[tuple[str, float]]) -> dict[tuple[str, float], tuple[int, float]]:
        """(count, sum) of the values up to and with each (category, place)."""
        out, asked = {}, []
        for name, x in places:
            part = next((p for p in reversed(self.parts[name]) if p[1] <= x), None)
            if part is None:
                out[name, x] = (0, 0.0)
            elif x >= part[2]:
                out[name, x] = (part[4], part[5])
            else:
                out[name, x] = part[3]
                asked.append((name, part[0], x))
        if asked:
            at = self.spark.createDataFrame(asked, "category_name string, part int, x double")
            own = self.table.where(F.col("part").isin(sorted({a[1] for a in asked})))
            met = own.join(F.broadcast(at), ["category_name", "part"]).where("s <= x")  # a row for each place asked for
            for r in met.groupBy("category_name", "x").agg(F.max("n").alias("n"), F.max_by("total", "s").alias("total")).collect():
                n0, t0 = out[r.category_name, r.x]
                out[r.category_name, r.x] = (n0 + r.n, t0 + r.total)
        return out


def _between(centres: list[float]) -> list[tuple[float, float, int]]:
    """(from, to, bin): the stretches of places, open below and closed above, whose nearest centre is a bin's; of equal distances and of equal centres the lower bin's."""
    order = sorted(range(len(centres)), key=lambda i: (centres[i], i))
    order = [i for k, i in enumerate(order) if not k or centres[i] != centres[order[k - 1]]]
    out, low = [], -math.inf
    for i, following in zip(order, [*order[1:], None], strict=True):
        high = math.inf if following is None else (centres[i] + centres[following]) / 2
        if following is not None and following < i:
            high = math.nextafter(high, -math.inf)  # a place in the middle goes to the lower number
        out.append((low, high, i))
        low = high
    return out


def depth_bins(anns: DataFrame, n: int, size_col: str = "diagonal", depth_col: str = "depth", rounds: int = 1000, least: int = 5) -> DataFrame:
    """(category_name, bin, centre, n, depth_mean, depth_std): one-dimensional k-means on the box's diagonal, all
    categories at once. Centres start as a geometric series; a round assigns every row to its nearest centre; a
    category ends when its rounded mean distance no longer falls. Bins of fewer than `least` rows use their `least`
    nearest rows for the depth. The annotations are read once; a round only looks running counts and sums up at the bins'
    borders and centres (SortedValues). The driver holds centres: a row for each category and bin.
    """
    spark = anns.sparkSession
    rows = settled(anns.select("category_name", F.col(size_col).cast("double").alias("s"), F.col(depth_col).cast("double").alias("z")), "sizes")
    values = SortedValues(rows.where("category_name IS NOT NULL AND s IS NOT NULL"), "s")
    known, best = {}, {}
    for name in values.parts:
        lo, hi = (max(x, 1e-6) for x in values.ends(name))
        known[name] = [lo * math.pow(hi / lo, k / max(n - 1, 1)) for k in range(n)]
    live = set(known)
    for _ in range(rounds):
        if not live:
            break
        stretches = {name: _between(known[name]) for name in live}
        places = {(name, x) for name in live for lo, hi, i in stretches[name] for x in (lo, hi, known[name][i])}
        at = values.up_to(places)
        for name in sorted(live):
            distance, count, moved = 0.0, 0, list(known[name])
            for lo, hi, i in stretches[name]:
                (n0, t0), (n1, t1) = at[name, lo], at[name, hi]
                centre = known[name][i]
                nc, tc = at[name, min(max(centre, lo), hi)] if lo <= centre <= hi else (n0, t0)
                distance += (t1 - tc) - centre * (n1 - nc) + centre * (nc - n0) - (tc - t0)
                count += n1 - n0
                if n1 > n0:
                    moved[i] = (t1 - t0) / (n1 - n0)
            rounded = round(distance / count, 4)
            if name in best and rounded >= best[name]:
                live.discard(name)
            else:
                best[name], known[name] = rounded, moved
    table = spark.createDataFrame([(name, i, c) for name, cs in known.items() for i, c in enumerate(cs)], "category_name string, bin int, centre double")
    # As in the rounds, places between centres decide; a table of categories and bins.
    borders = spark.createDataFrame([(name, lo, hi, i) for name, cs in known.items() for lo, hi, i in _between(cs)], "category_name string, lo double, hi double, bin int")
    lists = borders.groupBy("category_name").agg(F.collect_list(F.struct("lo", "hi", "bin")).alias("b"))
    final = rows.join(lists, "category_name").select("category_name", "z", F.expr("filter(b, x -> s > x.lo AND s <= x.hi)[0].bin").alias("bin"))
    own = final.groupBy("category_name", "bin").agg(F.count("*").alias("n"), F.avg("z").alias("depth_mean"), F.coalesce(F.stddev_samp("z"), F.lit(0.0)).alias("depth_std"))
    joined = table.join(own, ["category_name", "bin"], "left").fillna({"n": 0})
    few = joined.where(F.col("n") < least).select("category_name", "bin", "centre")
    near = rows.join(few, "category_name").withColumn("r", F.row_number().over(Window.partitionBy("category_name", "bin").orderBy(F.abs(F.col("s") - F.col("centre")), "s", "z"))).where(F.col("r") <= least)
    filled = near.groupBy("category_name", "bin").agg(F.avg("z").alias("fm"), F.coalesce(F.stddev_samp("z"), F.lit(0.0)).alias("fs"))
    return joined.join(filled, ["category_name", "bin"], "left").select("category_name", "bin", "centre", "n", F.coalesce("fm", "depth_mean").alias("depth_mean"), F.coalesce("fs", "depth_std").alias("depth_std"))
