"""3D IoU of oriented boxes, for pairs that a join has already narrowed down.

A box cut by the six half spaces of another: each of its faces is clipped polygon by polygon, and the cuts
are closed by the other box's clipped faces; the volume is the sum of the tetrahedra from an inner point to
all faces. All pairs of a batch are clipped together, as padded arrays of polygons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from annolake.functions.geometry import CORNER_SIGNS, FACES

#: Pairs clipped together; bounds the arrays.
TOGETHER = 4096


def _half_spaces(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outward normals (n, 6, 3) and offsets (n, 6) of the boxes' faces, and which boxes have six."""
    a, b, c = (corners[:, [f[i] for f in FACES]] for i in range(3))
    normal = np.cross(b - a, c - a)
    size = np.linalg.norm(normal, axis=2)
    normal = normal / np.maximum(size, 1e-300)[:, :, None]
    outwards = (normal * (corners.mean(axis=1)[:, None] - a)).sum(axis=2) <= 0
    normal = np.where(outwards[:, :, None], normal, -normal)
    return normal, (normal * a).sum(axis=2), (size >= 1e-12).all(axis=1)


def _clip(polygons: np.ndarray, counts: np.ndarray, normal: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of polygons (m, k, 3), of which the first counts points are there, with normal . p <= offset. Only polygons that reach beyond are cut."""
    dp = polygons[:, :, 0] * normal[:, None, 0] + polygons[:, :, 1] * normal[:, None, 1] + polygons[:, :, 2] * normal[:, None, 2] - offset[:, None]
    rows = np.flatnonzero(((np.arange(polygons.shape[1])[None, :] < counts[:, None]) & ~(dp <= 0)).any(axis=1))
    if not len(rows):
        return polygons, counts
    points, left = _cut(polygons[rows], counts[rows], dp[rows])
    width = max(polygons.shape[1], points.shape[1])
    out = np.zeros((len(polygons), width, 3))
    out[:, : polygons.shape[1]] = polygons
    out[rows, : points.shape[1]] = points
    counts = counts.copy()
    counts[rows] = left
    return out, counts


def _cut(polygons: np.ndarray, counts: np.ndarray, dp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of polygons where dp, given at their points, is not above 0."""
    m, k, _ = polygons.shape
    place = np.arange(k)[None, :]
    there = place < counts[:, None]
    after = np.where(place + 1 < counts[:, None], place + 1, 0)
    q = np.take_along_axis(polygons, after[:, :, None], axis=1)
    dq = np.take_along_axis(dp, after, axis=1)
    crossing = there & (((dp < 0) & (dq > 0)) | ((dq < 0) & (dp > 0)))
    share = np.where(crossing, dp / np.where(crossing, dp - dq, 1.0), 0.0)
    points = np.stack([polygons, polygons + (q - polygons) * share[:, :, None]], axis=2).reshape(m, 2 * k, 3)
    kept = np.stack([there & (dp <= 0), crossing], axis=2).reshape(m, 2 * k)
    counts = kept.sum(axis=1)
    order = np.argsort(~kept, axis=1, kind="stable")[:, : max(int(counts.max(initial=0)), 1)]
    return np.take_along_axis(points, order[:, :, None], axis=1), counts


def _cones(polygons: np.ndarray, counts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Volumes of the cones from an inner point over each polygon."""
    p = polygons - inside[:, None]
    triangles = np.cross(p[:, 1:-1], p[:, 2:])
    volumes = np.abs((p[:, :1] * triangles).sum(axis=2)) / 6
    return np.where(np.arange(1, p.shape[1] - 1)[None, :] < counts[:, None] - 1, volumes, 0.0).sum(axis=1)


def box_volumes(corners: np.ndarray) -> np.ndarray:
    n = len(corners)
    faces = corners[:, FACES].reshape(n * len(FACES), 4, 3)
    return _cones(faces, np.full(len(faces), 4), np.repeat(corners.mean(axis=1), len(FACES), axis=0)).reshape(n, -1).sum(axis=1)


def intersection_volumes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Volumes that the boxes a and b (n, 8, 3) have in common, pair by pair."""
    n, sides = len(a), len(FACES)
    (normal_a, offset_a, sound_a), (normal_b, offset_b, sound_b) = _half_spaces(a), _half_spaces(b)
    polygons, counts = np.concatenate([a[:, FACES], b[:, FACES]], axis=1).reshape(n * 2 * sides, 4, 3), np.full(n * 2 * sides, 4)
    by = [np.concatenate([np.repeat(y[:, None], sides, axis=1), np.repeat(x[:, None], sides, axis=1)], axis=1) for x, y in ((normal_a, normal_b), (offset_a, offset_b))]
    for side in range(sides):
        polygons, counts = _clip(polygons, counts, by[0][:, :, side].reshape(-1, 3), by[1][:, :, side].reshape(-1) + 1e-12)
    # A face that both boxes share counts once.
    same = ((np.abs(normal_a[:, None] - normal_b[:, :, None]) < 1e-9).all(axis=3) & (np.abs(offset_a[:, None] - offset_b[:, :, None]) < 1e-9)).any(axis=2)
    there = (counts >= 3).reshape(n, 2 * sides) & ~np.concatenate([np.zeros_like(same), same], axis=1)
    use = there.reshape(-1)[:, None] & (np.arange(polygons.shape[1])[None, :] < counts[:, None])
    points = np.where(use[:, :, None], polygons, 0.0).reshape(n, -1, 3).sum(axis=1)
    inside = points / np.maximum(use.reshape(n, -1).sum(axis=1), 1)[:, None]
    volumes = np.where(there, _cones(polygons, counts, np.repeat(inside, 2 * sides, axis=0)).reshape(n, -1), 0.0).sum(axis=1)
    return np.where(sound_a & sound_b & (there.sum(axis=1) >= 4), volumes, 0.0)


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of the boxes a and b (n, 8, 3), pair by pair; 0 where one is not finite or has no volume.

    Boxes that fill their axis-aligned hulls are compared by those; the others are clipped.
    """
    finite = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=(1, 2))
    a, b = (np.where(finite[:, None, None], c, 0.0) for c in (a, b))
    lo, hi = [c.min(axis=1) for c in (a, b)], [c.max(axis=1) for c in (a, b)]
    both = np.clip(np.minimum(hi[0], hi[1]) - np.maximum(lo[0], lo[1]), 0, None).prod(axis=1)
    hulls = [(h - k).prod(axis=1) for k, h in zip(lo, hi, strict=True)]
    edges = [np.abs(np.einsum("ij,ij->i", c[:, 1] - c[:, 0], np.cross(c[:, 3] - c[:, 0], c[:, 4] - c[:, 0]))) for c in (a, b)]
    straight = np.all([np.isclose(h, e, rtol=1e-9) for h, e in zip(hulls, edges, strict=True)], axis=0)
    union = hulls[0] + hulls[1] - both
    found = np.where(straight & (union > 1e-12), both / np.where(union > 1e-12, union, 1.0), 0.0)
    turned = np.flatnonzero(finite & ~straight & (both > 0))
    for at in range(0, len(turned), TOGETHER):
        k = turned[at : at + TOGETHER]
        common = intersection_volumes(a[k], b[k])
        union = box_volumes(a[k]) + box_volumes(b[k]) - common
        found[k] = np.where(union > 1e-12, common / np.where(union > 1e-12, union, 1.0), 0.0)
    return np.where(finite, found, 0.0)


def iou3d_of(a, b) -> float:
    a, b = np.array([list(p) for p in a], float), np.array([list(p) for p in b], float)
    return float(ious(a[None], b[None])[0]) if a.shape == b.shape == (8, 3) else 0.0


def _iou3d(a: pa.Array, b: pa.Array) -> pa.Array:
    """a, b: the numbers of each box's corners; 0 where there are not 24."""
    sound = np.flatnonzero(np.all([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) == 24 for c in (a, b)], axis=0))
    out = np.zeros(len(a))
    if len(sound):
        out[sound] = ious(*(c.take(pa.array(sound)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 3) for c in (a, b)))
    return pa.array(out)


def iou3d(a: Column, b: Column) -> Column:
    """IoU of two corner lists; 0 where one is null or not sound. Corners travel as plain numbers, and are named once here, so that they are computed once."""
    return F.arrow_udf(_iou3d, "double")(F.flatten(a), F.flatten(b))


def _posed(*columns: pa.Array) -> pa.Array:
    """center, dims of either box, then perhaps the rotation that both have, as plain numbers; 0 where some are missing."""
    lengths = (3, 3, 3, 3, 9)[: len(columns)]
    sound = np.flatnonzero(np.all([pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) == k for c, k in zip(columns, lengths, strict=True)], axis=0))
    out = np.zeros(len(columns[0]))
    if len(sound):
        parts = [c.take(pa.array(sound)).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c, k in zip(columns, lengths, strict=True)]
        r = parts[4].reshape(-1, 3, 3) if len(parts) == 5 else None
        out[sound] = ious(*(corners_of(parts[i], parts[i + 1], r) for i in (0, 2)))
    return pa.array(out)


def corners_of(center: np.ndarray, dims: np.ndarray, rotation: np.ndarray | None = None) -> np.ndarray:
    """The eight corners (n, 8, 3) in the fixed order; the rotation turns the box about the origin of its centre."""
    local = dims[:, None, ::-1] * (np.array(CORNER_SIGNS) / 2)
    turn = lambda v: v if rotation is None else sum(rotation[:, None, :, j] * v[:, :, j, None] for j in range(3))
    return turn(center[:, None]) + turn(local)


def posed_iou3d(center_a: Column, dims_a: Column, center_b: Column, dims_b: Column, rotation: Column | None = None) -> Column:
    """iou3d of the corners of two boxes, both turned by one rotation about the origin: six numbers of a box travel instead of 24."""
    return F.arrow_udf(_posed, "double")(center_a, dims_a, center_b, dims_b, *([] if rotation is None else [F.flatten(rotation)]))


def may_overlap(a: Column, b: Column) -> Column:
    """Cheap test for the join: the axis-aligned hulls overlap."""
    def hull(c: Column, i: int, agg) -> Column:
        return agg(F.transform(c, lambda p: p[i]))

    ok = F.lit(True)
    for i in range(3):
        ok = ok & (hull(a, i, F.array_max) > hull(b, i, F.array_min)) & (hull(b, i, F.array_max) > hull(a, i, F.array_min))
    return ok
