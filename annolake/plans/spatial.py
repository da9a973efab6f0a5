"""Queries of the point, raster, streaming and source operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions import geometry
from annolake.operators import gates, points, raster, suppression
from annolake.plans.fixtures import view, with_views
from annolake.sources import documents
from annolake.sources.shared import shared_path
from annolake.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


def _r(c, digits: int = 5):
    return F.round(c + 1e-9, digits)


#: The points' camera.
FX, FY, CX, CY = 500.0, 500.0, 320.0, 240.0
_XYZ = f"pts AS (SELECT *, (u - {CX}) * depth / {FX} AS x, (v - {CY}) * depth / {FY} AS y, depth AS z FROM fx_points)"


def _cloud(spark, sf_dir) -> DataFrame:
    p = geometry.backproject(F.col("u"), F.col("v"), F.col("depth"), *(F.lit(k) for k in (FX, FY, CX, CY)))
    return view(spark, sf_dir, "fx_points").withColumn("p", p).select("image_id", "inst_id", "pt_id", "u", "v", "depth", *(F.get("p", i).alias(c) for i, c in enumerate("xyz")))


@_query(f"WITH {_XYZ} SELECT pt_id, round(x + 1e-9, 5) AS x, round(y + 1e-9, 5) AS y, z, round(abs(0.6 * y + 0.8 * z - 2) + 1e-9, 5) AS off_plane FROM pts")
def backprojected_points(spark, sf_dir):
    plane = F.array(*(F.lit(v) for v in (0.0, 0.6, 0.8, -2.0)))
    rows = _cloud(spark, sf_dir)
    return rows.select("pt_id", _r(F.col("x")).alias("x"), _r(F.col("y")).alias("y"), "z", _r(geometry.plane_distance(plane, F.array("x", "y", "z"))).alias("off_plane"))


@_query(f"""WITH {_XYZ}, m AS (SELECT image_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS uu, var_pop(y) AS vv, var_pop(z) AS ww, covar_pop(x, y) AS uv, covar_pop(x, z) AS uw, covar_pop(y, z) AS vw FROM pts GROUP BY 1),
    k AS (SELECT *, (uw * vv - vw * uv) / (uu * vv - uv * uv) AS za, (vw * uu - uw * uv) / (uu * vv - uv * uv) AS zb, (uv * ww - vw * uw) / (uu * ww - uw * uw) AS ya, (vw * uu - uv * uw) / (uu * ww - uw * uw) AS yc,
        (uv * ww - uw * vw) / (vv * ww - vw * vw) AS xb, (uw * vv - uv * vw) / (vv * ww - vw * vw) AS xc FROM m WHERE n > 10),
    e AS (SELECT *, ww - za * uw - zb * vw AS ez, vv - ya * uv - yc * vw AS ey, uu - xb * uv - xc * uw AS ex FROM k),
    p AS (SELECT *, least(ez, ey, ex) AS mse, CASE least(ez, ey, ex) WHEN ex THEN [-1, xb, xc] WHEN ey THEN [ya, -1, yc] ELSE [za, zb, -1] END AS w FROM e),
    q AS (SELECT *, CASE WHEN w[2] > 0 THEN -1 ELSE 1 END / sqrt(w[1] * w[1] + w[2] * w[2] + w[3] * w[3]) AS f FROM p)
    SELECT image_id, round(f * w[1] + 1e-9, 5) AS a, round(f * w[2] + 1e-9, 5) AS b, round(f * w[3] + 1e-9, 5) AS c, round(-f * (w[1] * mx + w[2] * my + w[3] * mz) + 1e-9, 5) AS d, round(mse + 1e-9, 5) AS mse FROM q
    UNION ALL SELECT image_id, NULL, NULL, NULL, NULL, NULL FROM m WHERE n <= 10""")
def ground_planes(spark, sf_dir):
    return points.fit_ground_plane(_cloud(spark, sf_dir), ["image_id"]).select("image_id", *(_r(F.col(c)).alias(c) for c in ("a", "b", "c", "d", "mse")))


_TURNED = f"""{_XYZ}, yw AS (SELECT inst_id, 0.5 * atan2(2 * covar_samp(x, z), var_samp(x) - var_samp(z)) AS yaw FROM pts GROUP BY 1),
    t AS (SELECT inst_id, yaw, y, cos(yaw) * x + sin(yaw) * z AS a, -sin(yaw) * x + cos(yaw) * z AS b FROM pts JOIN yw USING (inst_id)),
    e AS (SELECT inst_id, count(*) AS n, max(a) - min(a) AS dx, max(y) - min(y) AS dy, max(b) - min(b) AS dz, (max(a) + min(a)) / 2 AS cx, (max(b) + min(b)) / 2 AS cz FROM t GROUP BY 1)"""


@_query(f"WITH {_TURNED} SELECT inst_id, n, round(dx + 1e-9, 4) AS dx, round(CASE WHEN dy < 2.25 THEN 4.5 ELSE dy END + 1e-9, 4) AS dy, round(dz + 1e-9, 4) AS dz, (dx >= 1.5 AND dz >= 1.25) OR (dz >= 1.5 AND dx >= 1.25) AS ok FROM e WHERE n >= 3")
def fitted_boxes(spark, sf_dir):
    cloud = _cloud(spark, sf_dir)
    prior = cloud.select("inst_id").distinct().select("inst_id", F.lit("table").alias("category_name"), F.lit(2.5).alias("w"), F.lit(4.5).alias("h"), F.lit(3.0).alias("l"))
    out = points.fit_box(cloud, ["inst_id"], prior).where("n >= 3")
    return out.select("inst_id", "n", F.round(F.col("dx") + 1e-9, 4).alias("dx"), F.round(F.col("dy") + 1e-9, 4).alias("dy"), F.round(F.col("dz") + 1e-9, 4).alias("dz"), "ok")


@_query(f"""WITH {_XYZ}, e AS (SELECT inst_id, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM pts GROUP BY 1),
    c AS (SELECT inst_id, i * 2 + j AS proposal, (x0 + x1) / 2 + sx * (x1 - x0) / 2 AS ax, (z0 + z1) / 2 + sz * (z1 - z0) / 2 AS az, sx * CASE WHEN j = 0 THEN 3.0 ELSE 2.0 END AS lx, sz * CASE WHEN j = 0 THEN 2.0 ELSE 3.0 END AS lz
        FROM e CROSS JOIN (VALUES (0, 1, 1), (1, -1, 1), (2, -1, -1), (3, 1, -1)) s(i, sx, sz) CROSS JOIN range(2) t(j)),
    b AS (SELECT inst_id, proposal, least(ax, ax - lx) AS xl, greatest(ax, ax - lx) AS xh, least(az, az - lz) AS zl, greatest(az, az - lz) AS zh FROM c),
    m AS (SELECT b.*, p.z, CASE WHEN p.x = 0 THEN 1e-4 ELSE p.x END AS x, p.z / (CASE WHEN p.x = 0 THEN 1e-4 ELSE p.x END) AS s FROM b JOIN pts p USING (inst_id)),
    r AS (SELECT inst_id, proposal, x > xl AND x < xh AND z > zl AND z < zh AS inside, list_sort(list_filter([
        CASE WHEN xl * s BETWEEN zl AND zh THEN {{'r': xl * xl + (xl * s) * (xl * s), 'f': abs(xl - x) + abs(xl * s - z)}} END, CASE WHEN xh * s BETWEEN zl AND zh THEN {{'r': xh * xh + (xh * s) * (xh * s), 'f': abs(xh - x) + abs(xh * s - z)}} END,
        CASE WHEN zl / s BETWEEN xl AND xh THEN {{'r': (zl / s) * (zl / s) + zl * zl, 'f': abs(zl / s - x) + abs(zl - z)}} END, CASE WHEN zh / s BETWEEN xl AND xh THEN {{'r': (zh / s) * (zh / s) + zh * zh, 'f': abs(zh / s - x) + abs(zh - z)}} END], lambda t: t IS NOT NULL))[1].f AS far FROM m),
    l AS (SELECT inst_id, proposal, avg(CASE WHEN inside THEN 1.0 ELSE 0 END) AS inside, CASE WHEN count(far) >= 3 THEN avg(far) + 5.0 * (1 - avg(CASE WHEN inside THEN 1.0 ELSE 0 END)) ELSE 'infinity'::DOUBLE END AS loss FROM r GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY inst_id ORDER BY loss, proposal) AS k FROM l)
    SELECT inst_id, proposal::INT AS proposal, round(loss + 1e-9, 5) AS loss, round(inside + 1e-9, 5) AS inside FROM k WHERE k = 1""")
def footprints(spark, sf_dir):
    """The best of the eight rectangles of size 2 x 3 for every object."""
    cloud = _cloud(spark, sf_dir)
    e = cloud.groupBy("inst_id").agg(*(f(c).alias(n + c) for c in "xz" for n, f in (("lo", F.min), ("hi", F.max))))
    b = e.select("inst_id", *(((F.col(f"lo{c}") + F.col(f"hi{c}")) / 2).alias(f"c{c}") for c in "xz"), *((F.col(f"hi{c}") - F.col(f"lo{c}")).alias(f"d{c}") for c in "xz"), F.lit(2.0).alias("w"), F.lit(3.0).alias("l"))
    out = points.search_footprints(cloud.select("inst_id", "x", "z"), b, ["inst_id"])
    return out.select("inst_id", "proposal", _r(F.col("loss")).alias("loss"), _r(F.col("inside")).alias("inside"))


@_query(f"WITH {_XYZ}, q AS (SELECT inst_id, quantile_cont(x, 0.97) - quantile_cont(x, 0.03) AS ex, quantile_cont(z, 0.97) - quantile_cont(z, 0.03) AS ez FROM pts GROUP BY 1) SELECT inst_id, round(ex + 1e-9, 5) AS ex, round(ez + 1e-9, 5) AS ez FROM q")
def robust_extents(spark, sf_dir):
    return points.robust_extent(_cloud(spark, sf_dir), ["inst_id"]).select("inst_id", _r(F.col("ex")).alias("ex"), _r(F.col("ez")).alias("ez"))


def _trim(src: str, lo: float, hi: float, name: str) -> str:
    q = ", ".join(f"quantile_cont({c}, {lo}) AS {c}0, quantile_cont({c}, {hi}) AS {c}1" for c in "xyz")
    ok = " AND ".join(f"{c} BETWEEN {c}0 AND {c}1" for c in "xyz")
    return f"q{name} AS (SELECT inst_id, {q} FROM {src} GROUP BY 1), m{name} AS (SELECT s.inst_id, x, y, z, {ok} AS ok, sum(CASE WHEN {ok} THEN 1 ELSE 0 END) OVER (PARTITION BY s.inst_id) AS n FROM {src} s JOIN q{name} USING (inst_id)), {name} AS (SELECT inst_id, x, y, z FROM m{name} WHERE ok OR n < 10)"


@_query(f"WITH {_XYZ}, {_trim('pts', 0.01, 0.99, 'ta')}, {_trim('ta', 0.05, 0.95, 'tb')} SELECT inst_id, count(*) AS n, round(avg(x) + 1e-9, 5) AS x, round(avg(z) + 1e-9, 5) AS z FROM tb GROUP BY 1")
def robust_centers(spark, sf_dir):
    return points.robust_center(_cloud(spark, sf_dir), ["inst_id"]).select("inst_id", "n", _r(F.col("x")).alias("x"), _r(F.col("z")).alias("z"))


@_query(f"WITH {_XYZ} SELECT inst_id, round(avg(CASE WHEN abs(x) <= 2.1 AND abs(y) <= 1.05 AND abs(z - 3) <= 2.1 THEN 1.0 ELSE 0 END) + 1e-9, 5) AS support FROM pts GROUP BY 1")
def supported_points(spark, sf_dir):
    cloud = _cloud(spark, sf_dir)
    b = cloud.select("inst_id").distinct().select("inst_id", *(F.lit(v).alias(n) for n, v in (("cx", 0.0), ("cy", 0.0), ("cz", 3.0), ("dx", 4.0), ("dy", 2.0), ("dz", 4.0), ("yaw", 0.0))))
    return points.point_support(cloud, b, ["inst_id"]).select("inst_id", _r(F.col("support")).alias("support"))


def _eigen_sql(n: int) -> str:
    """The n-th eigenvalue's vector: the longest cross product of two rows of the covariance less the eigenvalue, its largest component positive."""
    rows = [[("xx", "xy", "xz")[j] if i == 0 else (("xy", "yy", "yz")[j] if i == 1 else ("xz", "yz", "zz")[j]) for j in range(3)] for i in range(3)]
    m = [[f"({rows[i][j]} - e{n})" if i == j else rows[i][j] for j in range(3)] for i in range(3)]
    cross = [[f"({m[a][(k + 1) % 3]} * {m[b][(k + 2) % 3]} - {m[a][(k + 2) % 3]} * {m[b][(k + 1) % 3]})" for k in range(3)] for a, b in ((0, 1), (0, 2), (1, 2))]
    return ", ".join(f"[{', '.join(c)}] AS v{n}{i}" for i, c in enumerate(cross))


_LONGEST = "CASE WHEN list_sum(list_transform(v{0}0, lambda a: a * a)) >= greatest(list_sum(list_transform(v{0}1, lambda a: a * a)), list_sum(list_transform(v{0}2, lambda a: a * a))) THEN v{0}0 WHEN list_sum(list_transform(v{0}1, lambda a: a * a)) >= list_sum(list_transform(v{0}2, lambda a: a * a)) THEN v{0}1 ELSE v{0}2 END AS w{0}"
_SIGNED = "list_transform(w{0}, lambda a: a / sqrt(w{0}[1] * w{0}[1] + w{0}[2] * w{0}[2] + w{0}[3] * w{0}[3]) * sign(w{0}[CASE WHEN abs(w{0}[1]) >= greatest(abs(w{0}[2]), abs(w{0}[3])) THEN 1 WHEN abs(w{0}[2]) >= abs(w{0}[3]) THEN 2 ELSE 3 END])) AS a{0}"


@_query(f"""WITH {_XYZ}, c AS (SELECT inst_id, count(*) AS n, var_samp(x) AS xx, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, var_samp(y) AS yy, covar_samp(y, z) AS yz, var_samp(z) AS zz FROM pts GROUP BY 1 HAVING count(*) >= 4),
    q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt((power(xx - q, 2) + power(yy - q, 2) + power(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
    f AS (SELECT *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / power(p, 3) / 2))) / 3 AS f FROM p),
    e AS (SELECT *, q + 2 * p * cos(f) AS e0, 2 * q + 2 * p * cos(f) + 2 * p * cos(f + 2 * pi() / 3) AS outer_two, 3 * q AS t FROM f), g AS (SELECT *, t - outer_two AS e1 FROM e),
    v AS (SELECT inst_id, n, {_eigen_sql(0)}, {_eigen_sql(1)} FROM g), w AS (SELECT inst_id, n, {_LONGEST.format(0)}, {_LONGEST.format(1)} FROM v), a AS (SELECT inst_id, n, {_SIGNED.format(0)}, {_SIGNED.format(1)} FROM w),
    r AS (SELECT *, [a0[2] * a1[3] - a0[3] * a1[2], a0[3] * a1[1] - a0[1] * a1[3], a0[1] * a1[2] - a0[2] * a1[1]] AS a2 FROM a),
    s AS (SELECT inst_id, any_value(n) AS n, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2, {", ".join(f"{f}(x * a{j}[1] + y * a{j}[2] + z * a{j}[3]) AS {n}{j}" for j in range(3) for n, f in (("lo", "min"), ("hi", "max")))} FROM r JOIN pts USING (inst_id) GROUP BY 1)
    SELECT inst_id, n, {", ".join(f"round(hi{j} - lo{j} + 1e-9, 4) AS d{j}" for j in range(3))}, {", ".join(f"round({' + '.join(f'a{j}[{i + 1}] * (lo{j} + hi{j}) / 2' for j in range(3))} + 1e-9, 4) AS c{i}" for i in range(3))}, {", ".join(f"round(a{j}[{i + 1}] + 1e-9, 4) AS r{i}{j}" for i in range(3) for j in range(3))} FROM s""")
def principal_boxes(spark, sf_dir):
    """Extents along all principal axes, longest first, centre and rotation; SQL solves the cubic equation."""
    out = points.pca_box_3d(_cloud(spark, sf_dir), "inst_id").where("n >= 4")
    cells = [_r(F.get(F.get("rotation", i), j), 4).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return out.select("inst_id", "n", *(_r(F.get("dims", j), 4).alias(f"d{j}") for j in range(3)), *(_r(F.get("center", i), 4).alias(f"c{i}") for i in range(3)), *cells)


@_query("SELECT inst_id, least(count(*), 20) AS n FROM fx_points GROUP BY 1")
def capped_points(spark, sf_dir):
    return points.cap_points(_cloud(spark, sf_dir), ["inst_id"], most=20).groupBy("inst_id").agg(F.count("*").alias("n"))


@_query("SELECT inst_id, pt_id FROM (SELECT inst_id, pt_id, row_number() OVER (PARTITION BY inst_id ORDER BY pt_id) - 1 AS r FROM fx_points) WHERE r % 3 = 0 AND r < 15")
def strided_points(spark, sf_dir):
    return points.stride_sample(_cloud(spark, sf_dir), ["inst_id"], "pt_id", 3, 5).select("inst_id", "pt_id")


@_query("SELECT image_id, arg_max(inst_id, (c, -inst_id)) AS cand_id FROM (SELECT image_id, inst_id, max(depth) AS c FROM fx_points GROUP BY 1, 2) GROUP BY 1")
def best_ground_masks(spark, sf_dir):
    c = _cloud(spark, sf_dir).groupBy("image_id", F.col("inst_id").alias("cand_id")).agg(F.max("depth").alias("conf"))
    return points.best_ground_mask(c).select("image_id", "cand_id")


@_query("WITH o AS (SELECT inst_id, avg(depth) AS d FROM fx_points GROUP BY 1), g AS (SELECT inst_id, y * 3 + s AS ord, -abs(d - (2 + y + 0.5 * s)) AS score, s <> 1 AS p FROM o CROSS JOIN range(4) a(y) CROSS JOIN range(3) b(s)) SELECT inst_id, CAST(arg_max(ord, (p, score, -ord)) AS INT) AS ord FROM g GROUP BY 1")
def best_poses(spark, sf_dir):
    # Poses tie where the mean lies midway between two of them: its last bit must not depend on how the points are dealt out.
    o = points.ordered_mean(_cloud(spark, sf_dir), ["inst_id"], "depth", "pt_id").withColumnRenamed("mean", "d")
    g = points.pose_grid(o, [0.0, 1.0, 2.0, 3.0], [0.0, 1.0, 2.0]).withColumn("score", -F.abs(F.col("d") - (2 + F.col("yaw") + 0.5 * F.col("scale")))).withColumn("passes", F.col("scale") != 1)
    return points.best_candidate(g, ["inst_id"]).select("inst_id", F.col("order").alias("ord"))


_RUNS = """px AS (SELECT DISTINCT image_id, inst_id, v, unnest(range(u0, u1 + 1))::INT AS u FROM fx_mask_runs)"""


def _merged(spark, sf_dir) -> DataFrame:
    return raster.merge_runs(view(spark, sf_dir, "fx_mask_runs"))


@_query(f"WITH {_RUNS}, g AS (SELECT *, u - row_number() OVER (PARTITION BY inst_id, v ORDER BY u) AS g FROM px) SELECT image_id, inst_id, v, min(u) AS u0, max(u) AS u1 FROM g GROUP BY image_id, inst_id, v, g")
def merged_runs(spark, sf_dir):
    return _merged(spark, sf_dir)


@_query(f"WITH {_RUNS} SELECT inst_id, count(*) AS pixels, min(u) AS x1, max(v) AS y2, round(avg(u) + 1e-9, 5) AS cu, round(avg(v) + 1e-9, 5) AS cv FROM px GROUP BY 1 HAVING count(*) >= 10 AND max(u) - min(u) + 1 >= 3 AND (count(*) >= 100 OR count(*) / 2880.0 >= 0.001)")
def mask_statistics(spark, sf_dir):
    out = raster.mask_size_ok(raster.mask_stats(_merged(spark, sf_dir)), 2880)
    return out.select("inst_id", "pixels", "x1", "y2", _r(F.col("cu")).alias("cu"), _r(F.col("cv")).alias("cv"))


@_query(f"WITH {_RUNS}, n AS (SELECT inst_id, count(*) AS n FROM px GROUP BY 1), o AS (SELECT x.inst_id AS a, y.inst_id AS b, count(*) AS shared_px FROM px x JOIN px y ON x.image_id = y.image_id AND x.v = y.v AND x.u = y.u AND x.inst_id < y.inst_id GROUP BY 1, 2) SELECT a, b, shared_px AS both_px, round(shared_px::DOUBLE / (p.n + q.n - shared_px) + 1e-9, 6) AS iou FROM o JOIN n p ON p.inst_id = a JOIN n q ON q.inst_id = b")
def overlapping_masks(spark, sf_dir):
    return raster.mask_overlaps(_merged(spark, sf_dir)).select("a", "b", F.col("both").alias("both_px"), _r(F.col("iou"), 6).alias("iou"))


@_query(f"""WITH RECURSIVE {_RUNS}, n AS (SELECT image_id, inst_id, count(*) AS n, (count(*) % 97) / 97.0::DOUBLE AS conf FROM px GROUP BY 1, 2),
    o AS (SELECT x.inst_id AS a, y.inst_id AS b, count(*) AS shared_px FROM px x JOIN px y ON x.image_id = y.image_id AND x.v = y.v AND x.u = y.u AND x.inst_id <> y.inst_id GROUP BY 1, 2),
    high AS (SELECT a, list(b) AS others FROM o JOIN n p ON p.inst_id = a JOIN n q ON q.inst_id = b WHERE shared_px::DOUBLE / (p.n + q.n - shared_px) > 0.3 GROUP BY 1),
    m AS MATERIALIZED (SELECT image_id, inst_id, conf, coalesce(others, []) AS others, row_number() OVER (PARTITION BY image_id ORDER BY inst_id) AS rk FROM n LEFT JOIN high ON a = inst_id),
    walk AS (SELECT image_id, rk, [{{'id': inst_id, 'conf': conf}}] AS kept FROM m WHERE rk = 1
        UNION ALL SELECT image_id, rk, CASE WHEN met IS NULL THEN list_append(kept, own) WHEN own.conf > met.conf THEN list_append(list_filter(kept, lambda k: k.id <> met.id), own) ELSE kept END
        FROM (SELECT m.image_id, m.rk, w.kept, {{'id': m.inst_id, 'conf': m.conf}} AS own, list_filter(w.kept, lambda k: list_contains(m.others, k.id))[1] AS met FROM walk w JOIN m ON m.image_id = w.image_id AND m.rk = w.rk + 1) s),
    last AS (SELECT image_id, arg_max(kept, rk) AS kept FROM walk GROUP BY 1), p AS (SELECT image_id, unnest(kept) AS k, generate_subscripts(kept, 1) - 1 AS place FROM last)
    SELECT image_id, k.id AS inst_id, k.conf AS conf, place FROM p""")
def deduplicated_masks(spark, sf_dir):
    runs = _merged(spark, sf_dir)
    inst = runs.groupBy("image_id", "inst_id").agg((F.sum(F.col("u1") - F.col("u0") + 1) % 97 / 97.0).alias("conf"))
    return suppression.dedup_masks(inst, raster.mask_overlaps(runs), 0.3)


@_query(f"""WITH {_RUNS}, near AS (SELECT a.image_id, a.inst_id, a.v, a.u, count(*) FILTER (b.v = a.v AND b.u <> a.u) AS h, count(*) FILTER (b.u = a.u AND b.v <> a.v) AS w FROM px a JOIN px b ON a.inst_id = b.inst_id AND abs(a.v - b.v) <= 1 AND abs(a.u - b.u) <= 1 AND (a.v = b.v OR a.u = b.u) GROUP BY 1, 2, 3, 4)
    SELECT inst_id, count(*) AS pixels FROM near WHERE h = 2 - CASE WHEN u = 0 THEN 1 ELSE 0 END - CASE WHEN u = 63 THEN 1 ELSE 0 END AND w = 2 - CASE WHEN v = 0 THEN 1 ELSE 0 END - CASE WHEN v = 47 THEN 1 ELSE 0 END GROUP BY 1""")
def eroded_masks(spark, sf_dir):
    out = raster.erode_mask(_merged(spark, sf_dir), 1, 1, 48, 64)
    return out.groupBy("inst_id").agg(F.sum(F.col("u1") - F.col("u0") + 1).alias("pixels"))


@_query("""WITH g AS (SELECT image_id, v, u::INT AS u, ln(1 + ((base * 7 + u * 3) % 50) / 10.0::DOUBLE) AS d FROM fx_lines, range(0, 64) r(u)),
    o AS (SELECT du::INT AS du, dv::INT AS dv FROM range(-1, 2) a(du), range(-1, 2) b(dv)), near AS (SELECT image_id, u - du AS u, v - dv AS v, du, dv, d FROM g, o),
    n AS (SELECT g.image_id, g.u, g.v, any_value(g.d) AS d, max(b.d) FILTER (du = 1 AND dv = -1) AS a1, max(b.d) FILTER (du = 1 AND dv = 0) AS a2, max(b.d) FILTER (du = 1 AND dv = 1) AS a3,
        max(b.d) FILTER (du = -1 AND dv = -1) AS b1, max(b.d) FILTER (du = -1 AND dv = 0) AS b2, max(b.d) FILTER (du = -1 AND dv = 1) AS b3, max(b.d) FILTER (du = 0 AND dv = 1) AS c1, max(b.d) FILTER (du = 0 AND dv = -1) AS c2
        FROM g JOIN near b ON g.image_id = b.image_id AND g.u = b.u AND g.v = b.v GROUP BY 1, 2, 3),
    e AS (SELECT *, sqrt(power(coalesce(a1, d) + 2 * coalesce(a2, d) + coalesce(a3, d) - coalesce(b1, d) - 2 * coalesce(b2, d) - coalesce(b3, d), 2) + power(coalesce(b3, d) + 2 * coalesce(c1, d) + coalesce(a3, d) - coalesce(b1, d) - 2 * coalesce(c2, d) - coalesce(a1, d), 2)) > 2 AS edge FROM n),
    s AS (SELECT image_id, u + du AS u, v + dv AS v FROM e, o WHERE edge GROUP BY 1, 2, 3), m AS (SELECT g.image_id, g.u, g.v, s.u IS NULL AS good FROM g LEFT JOIN s ON s.image_id = g.image_id AND s.u = g.u AND s.v = g.v),
    t AS (SELECT image_id, count(*) FILTER (good) < 20 OR count(*) FILTER (good) < 0.35 * count(*) AS all_of_it FROM m GROUP BY 1)
    SELECT image_id, count(*) AS n, sum(u * (v + 1))::BIGINT AS places FROM m JOIN t USING (image_id) WHERE good OR all_of_it GROUP BY 1""")
def smooth_depth_pixels(spark, sf_dir):
    """Pixels away from depth edges, of all pixels of an image's depth lines: how many, and a sum over their places."""
    px = _lines(spark, sf_dir).select("image_id", "v", F.posexplode("depth").alias("u", "depth"))
    return raster.drop_depth_edges(px, ["image_id"], threshold=2.0).groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("u") * (F.col("v") + 1)).cast("long").alias("places"))


def _lines(spark, sf_dir) -> DataFrame:
    """One depth line, 64 wide, for each image and row that has an event."""
    return view(spark, sf_dir, "fx_lines").select("image_id", "v", F.expr("transform(sequence(0, 63), u -> (1 + (base * 7 + u * 3) % 50 / 10D))").alias("depth"))


@_query("""WITH b AS (SELECT inst_id, image_id, min(u0) AS x1, max(u1) AS x2, min(v) AS y1, max(v) AS y2 FROM fx_mask_runs GROUP BY 1, 2), d AS (SELECT inst_id, 1 + ((base * 7 + u * 3) % 50) / 10.0::DOUBLE AS d FROM b JOIN fx_lines l ON l.image_id = b.image_id AND l.v BETWEEN y1 AND y2, unnest(range(x1, x2 + 1)) c(u))
    SELECT inst_id, count(*) AS pixels, round(avg(CASE WHEN d BETWEEN 1.8 AND 4.2 THEN 1.0 ELSE 0 END) + 1e-9, 5) AS support, round(median(d) + 1e-9, 5) AS median, (count(*) >= 16 AND avg(CASE WHEN d BETWEEN 1.8 AND 4.2 THEN 1.0 ELSE 0 END) >= 0.2 AND abs(median(d) - 3) / 3 <= 0.5) AS ok FROM d GROUP BY 1""")
def depth_supports(spark, sf_dir):
    b = view(spark, sf_dir, "fx_mask_runs").groupBy(F.col("inst_id"), "image_id").agg(*(e.cast("double").alias(n) for n, e in (("x1", F.min("u0")), ("x2", F.max("u1")), ("y1", F.min("v")), ("y2", F.max("v")))))
    b = b.withColumns({"z_min": F.lit(2.0), "z_max": F.lit(4.0), "center_z": F.lit(3.0)})
    out = raster.depth_support(b, _lines(spark, sf_dir), "inst_id")
    return out.select("inst_id", "pixels", _r(F.col("support")).alias("support"), _r(F.col("median")).alias("median"), "ok")


@_query(f"""WITH {_RUNS}, a AS (SELECT image_id, v, u, 1 + min(inst_id % 7) AS da FROM px GROUP BY 1, 2, 3), b AS (SELECT image_id, v, u + 1 AS u, 1 + min(inst_id % 5) AS db FROM px GROUP BY 1, 2, u),
    j AS (SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.u, b.u) AS u, coalesce(a.v, b.v) AS v, da, db, da IS NOT NULL AND db IS NOT NULL AS met FROM a FULL JOIN b ON a.image_id = b.image_id AND a.v = b.v AND a.u = b.u),
    g AS (SELECT image_id, count(*) FILTER (met)::DOUBLE / count(*) AS sil, count(*) FILTER (met) AS overlap, median(CASE WHEN met THEN da END) AS median_a, median(CASE WHEN met THEN db END) AS median_b, median(CASE WHEN met THEN abs(db - da) / da END) AS rel, median(CASE WHEN met THEN db - da END) AS bias,
        min(u) FILTER (da IS NOT NULL) AS au0, max(u) FILTER (da IS NOT NULL) AS au1, min(v) FILTER (da IS NOT NULL) AS av0, max(v) FILTER (da IS NOT NULL) AS av1, min(u) FILTER (db IS NOT NULL) AS bu0, max(u) FILTER (db IS NOT NULL) AS bu1, min(v) FILTER (db IS NOT NULL) AS bv0, max(v) FILTER (db IS NOT NULL) AS bv1 FROM j GROUP BY 1),
    w AS (SELECT *, greatest(least(au1, bu1) - greatest(au0, bu0) + 1, 0) * greatest(least(av1, bv1) - greatest(av0, bv0) + 1, 0) AS w FROM g),
    i AS (SELECT *, w::DOUBLE / ((au1 - au0 + 1) * (av1 - av0 + 1) + (bu1 - bu0 + 1) * (bv1 - bv0 + 1) - w) AS bi FROM w)
    SELECT image_id, round(sil + 1e-9, 6) AS silhouette_iou, overlap, median_a, median_b, round(rel + 1e-9, 6) AS rel_error, bias, round(bi + 1e-9, 6) AS bbox_iou, round(0.6 * sil + 0.25 * bi + 0.15 * (1 - least(coalesce(rel, 1), 1)) + 1e-9, 6) AS score FROM i""")
def layer_alignments(spark, sf_dir):
    px = _merged(spark, sf_dir).select("image_id", "inst_id", "v", F.explode(F.sequence("u0", "u1")).alias("u"))
    a = px.groupBy("image_id", "v", "u").agg((1 + F.min(F.col("inst_id") % 7)).cast("double").alias("depth"))
    b = px.groupBy("image_id", "v", (F.col("u") + 1).alias("u")).agg((1 + F.min(F.col("inst_id") % 5)).cast("double").alias("depth"))
    out = raster.layer_alignment(a, b, ["image_id"])
    return out.select("image_id", "overlap", "median_a", "median_b", "bias", *(_r(F.col(c), 6).alias(c) for c in ("silhouette_iou", "rel_error", "bbox_iou", "score")))


@_query("SELECT image_id, 'depth' AS channel, count(*) AS n, count(*) FILTER (depth < 1.5) AS nan, count(*) FILTER (depth > 5.5) AS inf, count(*) FILTER (depth BETWEEN 1.5 AND 5.5) AS valid, min(depth) FILTER (depth BETWEEN 1.5 AND 5.5) AS min, max(depth) FILTER (depth BETWEEN 1.5 AND 5.5) AS max FROM fx_points GROUP BY 1")
def raster_healths(spark, sf_dir):
    px = _cloud(spark, sf_dir).withColumn("depth", F.when(F.col("depth") < 1.5, float("nan")).when(F.col("depth") > 5.5, float("inf")).otherwise(F.col("depth")))
    return raster.raster_health(px, ["image_id"], ["depth"]).select("image_id", "channel", "n", "nan", "inf", "valid", "min", "max")


def _steps(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("ts", F.col("user_id").alias("run_id"), F.col("event_id").alias("iteration"), F.col("value").alias("loss"), (F.col("value") / 100).alias("data_s"), (F.col("event_id") % 7).cast("double").alias("compute_s"), (F.col("event_id") % 3).cast("double").alias("eval_s"))


@_query("""WITH RECURSIVE s AS (SELECT user_id AS run_id, event_id AS iteration, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
    w AS (SELECT run_id, iteration, loss, r, CASE WHEN loss > 4 * (2 * loss) THEN 2 * loss ELSE 2 * loss * (1 - 0.02::DOUBLE) + loss * 0.02::DOUBLE END AS ema, loss > 4 * (2 * loss) AS diverging FROM s WHERE r = 1
        UNION ALL SELECT s.run_id, s.iteration, s.loss, s.r, CASE WHEN s.loss > 4 * w.ema THEN w.ema ELSE w.ema * (1 - 0.02::DOUBLE) + s.loss * 0.02::DOUBLE END, s.loss > 4 * w.ema FROM w JOIN s ON s.run_id = w.run_id AND s.r = w.r + 1)
    SELECT run_id, iteration, round(ema + 1e-9, 4) AS ema, diverging FROM w""")
def diverging_steps(spark, sf_dir):
    return jobs.divergence(_steps(spark, sf_dir)).select("run_id", "iteration", F.round(F.col("ema") + 1e-9, 4).alias("ema"), "diverging")


@_query("""WITH s AS (SELECT user_id AS run_id, value / 100 + event_id % 7 + event_id % 3 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT run_id, count(*) AS n, round(avg(t) + 1e-9, 5) AS total_s FROM s WHERE r > least(5, n - 1) GROUP BY 1""")
def iteration_throughput(spark, sf_dir):
    return jobs.throughput(_steps(spark, sf_dir)).select("run_id", "n", _r(F.col("total_s")).alias("total_s"))


@_query("""SELECT user_id AS run_id, count(*) AS n, round(avg(value / 100 + event_id % 7 + event_id % 3) + 1e-9, 5) AS total_s FROM events GROUP BY 1""")
def streamed_throughput(spark, sf_dir):
    """Windows of the stream over the events table, put together again per run."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    steps = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), (F.col("value") / 100).alias("data_s"), (F.col("event_id") % 7).cast("double").alias("compute_s"), (F.col("event_id") % 3).cast("double").alias("eval_s"))
    at = shared_path(spark, "throughput")
    jobs.write_updates(jobs.throughput_stream(steps, "6 hours"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    out = jobs.latest_updates(spark, f"{at}/out", ["run_id", "start"])
    return out.groupBy("run_id").agg(F.sum("n").alias("n"), _r(F.sum(F.col("total_s") * F.col("n")) / F.sum("n")).alias("total_s"))


@_query("""SELECT image_id, category_name AS label, (sk % 100) / 100.0::DOUBLE AS score, x1 FROM (SELECT b.*, CAST((pk * 7 + sk * 3) % 500 AS DOUBLE) AS x1 FROM fx_base b)""")
def lenient_records(spark, sf_dir):
    """Records of three container shapes with differing field names."""
    b = view(spark, sf_dir, "fx_base").withColumn("box", F.array(((F.col("pk") * 7 + F.col("sk") * 3) % 500).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))).withColumn("score", (F.col("sk") % 100) / 100)
    def rec(box: str, label: str, score: str):
        return F.to_json(F.collect_list(F.struct("image_id", F.col("box").alias(box), F.col("category_name").alias(label), F.col("score").alias(score))))
    a = b.where("image_id % 3 = 0").groupBy("image_id").agg(rec("bbox", "label", "score").alias("json")).select("json")
    c = b.where("image_id % 3 = 1").groupBy("image_id").agg(rec("box", "category_name", "conf").alias("j")).select(F.concat(F.lit('{"detections": '), "j", F.lit("}")).alias("json"))
    d = b.where("image_id % 3 = 2").groupBy("image_id").agg(rec("bbox_xyxy", "phrase", "confidence").alias("j")).select(F.concat(F.lit('{"'), F.col("image_id").cast("string"), F.lit('": '), "j", F.lit("}")).alias("json"))
    return documents.normalize_records(a.unionByName(c).unionByName(d)).select("image_id", "label", "score", F.get("box", 0).alias("x1"))


@_query("""SELECT count(*) AS n, count(DISTINCT image_id) AS images, round(avg(score), 6) AS mean_score, max(score) AS best FROM fx_detections""")
def set_statistics(spark, sf_dir):
    from annolake.operators.stats import stats_record

    return stats_record(view(spark, sf_dir, "fx_detections"), {"n": F.count("*"), "images": F.countDistinct("image_id"), "mean_score": F.round(F.avg("score"), 6), "best": F.max("score")})


_HALF = "CASE WHEN {0} > pi() / 2 THEN {0} - pi() WHEN {0} < -pi() / 2 THEN {0} + pi() ELSE {0} END"
_TURN = "(({0} + pi()) - floor(({0} + pi()) / (2 * pi())) * (2 * pi()) - pi())"


@_query(f"""WITH RECURSIVE o AS (SELECT DISTINCT inst_id FROM fx_points),
    y AS (SELECT inst_id, k, {_HALF.format(_TURN.format("t"))} AS y FROM (SELECT inst_id, k, (inst_id % 50) * 0.13 + (k - 1) * ((inst_id % 7) * 0.011 + 0.01) AS t FROM o, range(1, 13) r(k))),
    w AS (SELECT inst_id, k, [y] AS kept FROM y WHERE k = 1 UNION ALL
        SELECT y.inst_id, y.k, CASE WHEN len(list_filter(w.kept, lambda p: abs({_HALF.format(_TURN.format("(y.y - p)"))}) <= radians(5.0))) > 0 THEN w.kept ELSE list_append(w.kept, y.y) END FROM w JOIN y ON y.inst_id = w.inst_id AND y.k = w.k + 1),
    s AS (SELECT inst_id, k, 1 + (k - 1) * ((inst_id % 5) * 0.005 + 0.01) AS s FROM o, range(1, 9) r(k)),
    v AS (SELECT inst_id, k, [s] AS kept FROM s WHERE k = 1 UNION ALL
        SELECT s.inst_id, s.k, CASE WHEN len(list_filter(v.kept, lambda p: abs(ln(s.s / p)) < 0.04)) > 0 THEN v.kept ELSE list_append(v.kept, s.s) END FROM v JOIN s ON s.inst_id = v.inst_id AND s.k = v.k + 1)
    SELECT w.inst_id, len(w.kept) * len(v.kept) AS n, round(list_sum(w.kept) + 1e-9, 5) AS yaws, round(list_sum(v.kept) + 1e-9, 5) AS scales FROM w JOIN v USING (inst_id) WHERE w.k = 12 AND v.k = 8""")
def merged_poses(spark, sf_dir):
    """Grids of each object's own yaws and scales, near-equal ones merged."""
    o = _cloud(spark, sf_dir).select("inst_id").distinct()
    steps = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    yaws = F.transform(steps(12), lambda k: (F.col("inst_id") % 50) * 0.13 + k * ((F.col("inst_id") % 7) * 0.011 + 0.01))
    scales = F.transform(steps(8), lambda k: 1 + k * ((F.col("inst_id") % 5) * 0.005 + 0.01))
    grid = points.pose_grid(o, yaws, scales)
    first = lambda c: F.aggregate(F.sort_array(F.collect_set(c)), F.lit(0.0), lambda a, x: a + x)
    return grid.groupBy("inst_id").agg(F.count("*").alias("n"), _r(first("yaw")).alias("yaws"), _r(first("scale")).alias("scales"))
