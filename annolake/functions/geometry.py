"""3D geometry columns. Points are array<double>(3), rotations and corner lists arrays of arrays.

Camera frame: x right, y down, z forward. Dimensions are [w, h, l], lying along the object's z, y and x axes.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from annolake.functions.boxes import box, clip

# Corner signs along the object's x, y and z axes, and the corners of each face in order.
CORNER_SIGNS = ((-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1))
FACES = ((0, 1, 2, 3), (3, 2, 6, 7), (0, 1, 5, 4), (0, 3, 7, 4), (1, 2, 6, 5), (4, 5, 6, 7))


def bound(f):
    """f with its arguments computed once each, however often it uses them; without this, chains of f would grow exponentially."""
    @functools.wraps(f)
    def once(*args):
        named = F.struct(*((a if isinstance(a, Column) else F.lit(a)).alias(f"_{i}") for i, a in enumerate(args)))
        return F.get(F.transform(F.array(named), lambda s: f(*(s[f"_{i}"] for i in range(len(args))))), 0)

    return once


def vec(*x) -> Column:
    return F.array(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in x))


def mat(rows) -> Column:
    return F.array(*(vec(*r) for r in rows))


def at(m: Column, i: int, j: int) -> Column:
    return F.get(F.get(m, i), j)


def dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, i) * F.get(b, i) for i in range(1, 3)), F.get(a, 0) * F.get(b, 0))


@bound
def cross(a: Column, b: Column) -> Column:
    a, b = [F.get(a, i) for i in range(3)], [F.get(b, i) for i in range(3)]
    return vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


@bound
def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@bound
def plus(a: Column, b: Column) -> Column:
    return vec(*(F.get(a, i) + F.get(b, i) for i in range(3)))


@bound
def minus(a: Column, b: Column) -> Column:
    return vec(*(F.get(a, i) - F.get(b, i) for i in range(3)))


@bound
def times(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    return vec(*(at(m, i, 0) * F.get(v, 0) + at(m, i, 1) * F.get(v, 1) + at(m, i, 2) * F.get(v, 2) for i in range(3)))


@bound
def matmul(a: Column, b: Column) -> Column:
    return mat([[at(a, i, 0) * at(b, 0, j) + at(a, i, 1) * at(b, 1, j) + at(a, i, 2) * at(b, 2, j) for j in range(3)] for i in range(3)])


@bound
def transpose(m: Column) -> Column:
    return mat([[at(m, j, i) for j in range(3)] for i in range(3)])


def identity() -> Column:
    return mat([[1, 0, 0], [0, 1, 0], [0, 0, 1]])


def determinant(m: Column) -> Column:
    p, q, r = ([at(m, i, j) for j in range(3)] for i in range(3))
    return p[0] * (q[1] * r[2] - q[2] * r[1]) + p[1] * (q[2] * r[0] - q[0] * r[2]) + p[2] * (q[0] * r[1] - q[1] * r[0])


def box_corners(center: Column, dims: Column, rotation: Column | None = None) -> Column:
    """The eight corners in the fixed order."""
    w, h, length = (F.get(dims, i) for i in range(3))
    out = []
    for sx, sy, sz in CORNER_SIGNS:
        local = length * (sx / 2), h * (sy / 2), w * (sz / 2)
        out.append(vec(*(F.get(center, i) + local[i] for i in range(3))) if rotation is None else plus(center, times(rotation, vec(*local))))
    return F.when(center.isNotNull() & dims.isNotNull(), F.array(*out))


def project_points(points: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    return F.transform(points, lambda p: vec(F.try_divide(fx * p[0], p[2]) + cx, F.try_divide(fy * p[1], p[2]) + cy))


def _numbers(a: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The doubles of a column, or of lists of one length, and which of them are there; lists of another length have none."""
    if size is None:
        return np.asarray(pc.cast(a, pa.float64()).to_numpy(zero_copy_only=False), float), a.is_valid().to_numpy(zero_copy_only=False)
    values, known = np.full((len(a), size), np.nan), np.zeros((len(a), size), bool)
    own = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(a), size), False).to_numpy(zero_copy_only=False))
    flat = a.take(pa.array(own)).flatten()
    values[own], known[own] = (x.reshape(-1, size) for x in _numbers(flat))
    return values, known


def _lists(values: np.ndarray) -> pa.Array:
    """(n, k, ...) as lists of k, and so on."""
    out = pa.array(values.ravel(), pa.float64())
    for axis in range(values.ndim - 1, 0, -1):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, values.shape[axis]), pa.int32()), out)
    return out


def _projected(behind: str, near: float, corners: pa.Array, *camera: pa.Array) -> tuple[np.ndarray, ...]:
    """The raw and clipped boxes (n, 4) around projected corners, which of them are there, and which boxes lie all behind."""
    (p, known), ((fx, _), (fy, _), (cx, _), (cy, _), (w, has_w), (h, has_h)) = _numbers(corners, 24), map(_numbers, camera)
    p, known = p.reshape(-1, 8, 3), known.reshape(-1, 8, 3)
    z, deep, fine = p[:, :, 2], known[:, :, 2], known.any(axis=(1, 2))
    all_behind = deep.all(axis=1) & ~((z > 0) | np.isnan(z)).any(axis=1)
    if behind == "clamp":
        z, deep = np.where(deep, np.where(z < 1e-6, 1e-6, z), 1e-6), np.ones_like(deep)
    elif behind == "null":
        fine = fine & deep.all(axis=1) & ~(np.abs(z) < 1e-6).any(axis=1)
        if near > 1e-6:
            fine &= ~(z <= near).any(axis=1)
    places, there = [], []
    for axis, (f, c, side, has) in enumerate(((fx, cx, w, has_w), (fy, cy, h, has_h))):
        there.append(known[:, :, axis] & deep & (z != 0))
        places.append(f[:, None] * p[:, :, axis] / np.where(z == 0, 1.0, z) + c[:, None])
        if behind == "corner":
            close, low = deep & (z <= 0.2), known[:, :, axis] & (p[:, :, axis] < 0)
            places[axis] = np.where(close, np.where(low, 0.0, side[:, None] - 1), places[axis])
            there[axis] = np.where(close, low | has[:, None], there[axis])
    raw = np.stack([agg(np.where(m, x, rest), axis=1) for agg, rest in ((np.min, np.inf), (np.max, -np.inf)) for x, m in zip(places, there, strict=True)], axis=1)
    most = np.stack([np.where(has_w, w - 1, np.inf), np.where(has_h, h - 1, np.inf)] * 2, axis=1)
    clipped = np.minimum(np.maximum(raw, 0.0), most)
    found = fine & np.isfinite(raw).all(axis=1) & (clipped[:, 2] > clipped[:, 0]) & (clipped[:, 3] > clipped[:, 1])
    return raw, clipped, found, all_behind


def project_box(corners: Column, fx: Column, fy: Column, cx: Column, cy: Column, width: Column, height: Column, behind: str = "null", near: float = 1e-6) -> Column:
    """struct<raw, clipped>: the 2D box of the projected corners; null where it is not finite or nothing of it is inside the image.

    behind: "null" gives null where some |z| is below 1e-6 (or, with a larger near, some z is not above it);
    "clamp" raises z to 1e-6; "corner" puts corners with z up to .2 onto the image's corner on their side.
    """
    def projected(*columns: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            raw, clipped, found, _ = _projected(behind, near, *columns)
        return pa.StructArray.from_arrays([_lists(raw), _lists(clipped)], ["raw", "clipped"], mask=pa.array(~found))

    return F.arrow_udf(projected, "raw array<double>, clipped array<double>")(F.flatten(corners), fx, fy, cx, cy, width, height)


def _valid(corners: pa.Array, eps: float, least_area: float) -> pa.Array:
    p, known = _numbers(corners, 24)
    a, b, c, d = (p.reshape(-1, 8, 3)[:, [f[i] for f in FACES]] for i in range(4))
    with np.errstate(all="ignore"):
        n, n2 = np.cross(b - a, c - a), np.cross(c - a, d - a)
        size, size2 = (np.sqrt((x * x).sum(axis=2)) for x in (n, n2))
        sound = (np.abs(((d - a) * n).sum(axis=2)) <= eps * np.maximum(size, 1e-12)) & (size / 2 > least_area) & (size2 / 2 > least_area)
    return pa.array(sound.all(axis=1) & known.all(axis=1))


def box3d_valid(corners: Column, eps: float = 1e-4, least_area: float = 1e-8) -> Column:
    """Every face plane within eps and no triangle of a face without area; false where a number is missing or not finite."""
    return (F.size(corners) == 8) & F.arrow_udf(lambda c: _valid(c, eps, least_area), "boolean")(F.flatten(corners))


def extent(center: Column, dims: Column) -> Column:
    """struct<x0, x1, y0, y1, z0, z1, v>: the sides of a box without rotation, and its volume."""
    sides, volume = [], F.lit(1.0)
    for axis, d in ((0, 2), (1, 1), (2, 0)):
        c, size = F.get(center, axis), F.get(dims, d)
        sides += [(c - size / 2).alias(f"{'xyz'[axis]}0"), (c + size / 2).alias(f"{'xyz'[axis]}1")]
        volume = volume * size
    return F.struct(*sides, volume.alias("v"))


def extent_iou3d(a: Column, b: Column) -> Column:
    """3D IoU of two extents; 0 where the union is not positive or not known."""
    both = F.lit(1.0)
    for k in "xyz":
        both = both * F.greatest(F.least(a[f"{k}1"], b[f"{k}1"]) - F.greatest(a[f"{k}0"], b[f"{k}0"]), F.lit(0.0))
    return F.greatest(F.try_divide(both, a["v"] + b["v"] - both), F.lit(0.0))


def aabb_iou3d(center_a: Column, dims_a: Column, center_b: Column, dims_b: Column) -> Column:
    """3D IoU of boxes without rotation. Pairs of a join take extents made before it: this, for each pair, is much more code."""
    return extent_iou3d(extent(center_a, dims_a), extent(center_b, dims_b))


def _cut(*columns: pa.Array) -> pa.Array:
    with np.errstate(all="ignore"):
        raw, clipped, found, all_behind = _projected("clamp", 1e-6, *columns)
        whole, seen = ((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) for b in (raw, clipped))
        return pa.array(np.where(all_behind | ~found | (whole <= 0), 1.0, 1 - seen / whole))


def truncation(corners: Column, fx, fy, cx, cy, width: Column, height: Column) -> Column:
    """The share of the projected area that lies outside the image; 1 where the box is all behind."""
    return F.arrow_udf(_cut, "double")(F.flatten(corners), fx, fy, cx, cy, width, height)


def backproject(u: Column, v: Column, depth: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """The point seen at a pixel; null where the depth is 0."""
    return F.when(depth != 0, vec((u - cx) * depth / fx, (v - cy) * depth / fy, depth))


def plane_distance(plane: Column, point: Column, signed: bool = False) -> Column:
    """Distance to (a, b, c, d); infinite for a plane without a normal."""
    n = F.sqrt(F.get(plane, 0) * F.get(plane, 0) + F.get(plane, 1) * F.get(plane, 1) + F.get(plane, 2) * F.get(plane, 2))
    d = F.get(plane, 0) * F.get(point, 0) + F.get(plane, 1) * F.get(point, 1) + F.get(plane, 2) * F.get(point, 2) + F.get(plane, 3)
    return F.when(n <= 1e-8, float("inf")).otherwise((d if signed else F.abs(d)) / n)


def rotate_y(yaw: Column) -> Column:
    c, s = F.cos(yaw), F.sin(yaw)
    return mat([[c, 0, s], [0, 1, 0], [-s, 0, c]])


@bound
def align_vectors(a: Column, b: Column) -> Column:
    """The rotation that takes direction a to direction b; the identity where they are parallel already."""
    na, nb = norm(a), norm(b)
    ua, ub = vec(*(F.get(a, i) / na for i in range(3))), vec(*(F.get(b, i) / nb for i in range(3)))
    v, c = cross(ua, ub), dot(ua, ub)
    s2 = dot(v, v)
    x, y, z = (F.get(v, i) for i in range(3))
    f = F.try_divide(1 - c, s2)
    turned = mat([[1 - f * (y * y + z * z), f * x * y - z, f * x * z + y], [f * x * y + z, 1 - f * (x * x + z * z), f * y * z - x], [f * x * z - y, f * y * z + x, 1 - f * (x * x + y * y)]])
    return F.when(s2 <= 1e-16, identity()).otherwise(turned)


def euler_to_matrix(rx: Column, ry: Column, rz: Column) -> Column:
    """Rz * Ry * Rx."""
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return mat([[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]])


@bound
def matrix_to_euler(m: Column) -> Column:
    """(rx, ry, rz) of Rz * Ry * Rx."""
    sy = F.sqrt(at(m, 0, 0) * at(m, 0, 0) + at(m, 1, 0) * at(m, 1, 0))
    usual = vec(F.atan2(at(m, 2, 1), at(m, 2, 2)), F.atan2(-at(m, 2, 0), sy), F.atan2(at(m, 1, 0), at(m, 0, 0)))
    return F.when(sy > 1e-6, usual).otherwise(vec(F.atan2(-at(m, 1, 2), at(m, 1, 1)), F.atan2(-at(m, 2, 0), sy), F.lit(0.0)))


@bound
def quaternion_to_matrix(q: Column) -> Column:
    """From (w, x, y, z), scaled to unit length."""
    n = F.sqrt(sum((F.get(q, i) * F.get(q, i) for i in range(1, 4)), F.get(q, 0) * F.get(q, 0)))
    w, x, y, z = (F.get(q, i) / n for i in range(4))
    return mat([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def yaw_of(m: Column) -> Column:
    return F.atan2(at(m, 0, 2), at(m, 2, 2))


def wrap_angle(a: Column, period: float = 2 * math.pi) -> Column:
    """Into [-period / 2, period / 2)."""
    return a - F.floor((a + period / 2) / period) * period


def yaw_mod_pi(a: Column) -> Column:
    """Into [0, pi): a box turned by half a turn is the same box."""
    return a - F.floor(a / math.pi) * math.pi


def virtual_depth(depth: Column, fy: Column, height: Column, focal0: float = 512.0, height0: float = 512.0) -> Column:
    return depth * (height0 * fy) / (focal0 * height.cast("double"))


def eval_scale(width: Column, height: Column, least: float = 512.0, most: float = 4096.0) -> Column:
    """Resize factor: the shorter side to least, unless the longer one then passes most."""
    s = least / F.least(width, height)
    return F.when(s * F.greatest(width, height) > most, most / F.greatest(width, height)).otherwise(s)


def _ray_turned(back: bool, rotation: pa.Array, *camera: pa.Array) -> pa.Array:
    """The shortest rotation of the camera's axis onto each pixel's ray, or back, times a rotation."""
    (m, known), pairs = _numbers(rotation, 9), [_numbers(c) for c in camera]
    u, v, fx, fy, cx, cy = (x for x, _ in pairs)
    found = known.all(axis=1) & np.all([k for _, k in pairs], axis=0) & (fx != 0) & (fy != 0)
    with np.errstate(all="ignore"):
        x, y = (u - cx) / fx, (v - cy) / fy
        size = np.sqrt(x * x + y * y + 1)
        x, y, z = x / size, y / size, 1 / size
        ray = [[1 - x * x / (1 + z), -x * y / (1 + z), x], [-x * y / (1 + z), 1 - y * y / (1 + z), y], [-x, -y, z]]
        if back:
            ray = list(zip(*ray, strict=True))
        out = np.stack([ray[i][0] * m[:, j] + ray[i][1] * m[:, 3 + j] + ray[i][2] * m[:, 6 + j] for i in range(3) for j in range(3)], axis=1)
    lists = _lists(out.reshape(-1, 3, 3))
    return pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array(~found))


def _turn_by_ray(back: bool, rotation: Column, *camera) -> Column:
    return F.arrow_udf(lambda *columns: _ray_turned(back, *columns), "array<array<double>>")(F.flatten(rotation), *camera)


def to_allocentric(rotation: Column, u, v, fx, fy, cx, cy) -> Column:
    """The rotation as seen along the ray through pixel (u, v); null where something is missing or a focal length is 0."""
    return _turn_by_ray(True, rotation, u, v, fx, fy, cx, cy)


def from_allocentric(rotation: Column, u, v, fx, fy, cx, cy) -> Column:
    return _turn_by_ray(False, rotation, u, v, fx, fy, cx, cy)


def rotation_valid(m: Column, tolerance: float = 0.1) -> Column:
    return F.coalesce(F.abs(determinant(m) - 1) <= tolerance, F.lit(False))


def rotation_angle(a: Column, b: Column) -> Column:
    """The angle between two rotations, the cosine clamped: the trace of a times b transposed."""
    t = [at(a, i, 0) * at(b, i, 0) + at(a, i, 1) * at(b, i, 1) + at(a, i, 2) * at(b, i, 2) for i in range(3)]
    return F.acos(clip((t[0] + t[1] + t[2] - 1) / 2, -1, 1))


def mirror_center(center: Column) -> Column:
    return vec(-F.get(center, 0), F.get(center, 1), F.get(center, 2))


#: The diagonals of the two matrices between which a mirrored pose stands.
MIRROR_LEFT, MIRROR_RIGHT = (1, -1, -1), (-1, -1, 1)


@bound
def mirror_pose(m: Column) -> Column:
    """M1 * R * M2 for a horizontal flip, both diagonal. The box is that of the mirrored scene, turned by half a turn about its y axis."""
    return mat([[at(m, i, j) * (MIRROR_LEFT[i] * MIRROR_RIGHT[j]) for j in range(3)] for i in range(3)])


def scale_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, sx: Column, sy: Column) -> Column:
    return F.struct((fx * sx).alias("fx"), (fy * sy).alias("fy"), (cx * sx).alias("cx"), (cy * sy).alias("cy"))


def world_to_camera(point: Column, pose_rotation: Column, pose_origin: Column) -> Column:
    """(p - t) * R for a camera pose (R, t)."""
    d = [F.get(point, i) - F.get(pose_origin, i) for i in range(3)]
    return vec(*(at(pose_rotation, 0, i) * d[0] + at(pose_rotation, 1, i) * d[1] + at(pose_rotation, 2, i) * d[2] for i in range(3)))


def world_to_camera_rotation(rotation: Column, pose_rotation: Column) -> Column:
    return matmul(transpose(pose_rotation), rotation)


def box_of_points(xs: Column, ys: Column) -> Column:
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
