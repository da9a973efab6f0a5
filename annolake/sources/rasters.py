"""Raster and point files: depth (.npy, .png) and mask arrays (.npy), point clouds (.ply), one task per batch of files."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolake.functions.labels import label_and_index, path_stem

#: Units of a stored depth value per metre.
DEPTH_UNITS = 8000.0


#: Fixed values of the format: a PNG file's first bytes.
PNG = bytes([0x89, 0x50, 0x4E, 0x47, 0x0D, 0x0A, 0x1A, 0x0A])


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def png_array(content: bytes) -> np.ndarray:
    """(height, width) of a grey PNG of 8 or 16 bits without interlacing; ValueError for damaged files and other kinds.

    A byte's prediction needs its left, upper and upper left neighbour, so all bytes of a diagonal are restored at once,
    whatever filters their lines have.
    """
    if not content.startswith(PNG):
        raise ValueError("no PNG file")
    at, chunks, ended = len(PNG), [], False
    while at + 12 <= len(content) and not ended:
        size, kind = struct.unpack_from(">I4s", content, at)
        body = content[at + 8 : at + 8 + size]
        if len(body) < size or content[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("damaged PNG: a chunk is cut or its checksum is wrong")
        chunks.append((kind, body))
        at, ended = at + 12 + size, kind == b"IEND"
    if not ended or chunks[0][0] != b"IHDR":
        raise ValueError("damaged PNG: no header or no end")
    width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[0][1])
    if colour or bits not in (8, 16) or interlaced:
        raise ValueError("only grey PNG of 8 or 16 bits without interlacing")
    n = bits // 8
    try:
        data = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    except zlib.error as error:
        raise ValueError(f"damaged PNG: {error}") from error
    if len(data) != height * (1 + width * n) or not height or not width:
        raise ValueError("damaged PNG: the lines don't fill the image")
    lines = np.frombuffer(data, np.uint8).reshape(height, -1)
    kinds, raw = lines[:, 0], lines[:, 1:].reshape(height, width, n).astype(np.int16)
    if kinds.max() > 4:
        raise ValueError("damaged PNG: unknown line filter")
    if not kinds.any():
        out = raw
    else:
        padded = np.zeros((height + 1, width + 1, n), np.int16)
        for d in range(height + width - 1):
            r = np.arange(max(0, d - width + 1), min(height, d + 1))
            c = d - r
            left, up, corner = padded[r + 1, c], padded[r, c + 1], padded[r, c]
            guess = left + up - corner
            dl, du, dc = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
            nearest = np.where((dl <= du) & (dl <= dc), left, np.where(du <= dc, up, corner))
            predicted = np.choose(kinds[r][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, nearest])
            padded[r + 1, c + 1] = (raw[r, c] + predicted) & 0xFF
        out = padded[1:, 1:]
    return np.ascontiguousarray(out.astype(np.uint8)).view(">u2" if n == 2 else np.uint8)[..., 0].astype(np.uint16 if n == 2 else np.uint8)


def _depth_lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, image, content in zip(f["path"], f["image"], f["content"], strict=True):
            try:
                a = png_array(content) if path.lower().endswith(".png") else np.load(io.BytesIO(content), allow_pickle=False)
            except ValueError as error:
                raise ValueError(f"{path}: {error}") from error
            d = a / DEPTH_UNITS if np.issubdtype(a.dtype, np.integer) else a
            yield pd.DataFrame({"image": image, "v": np.arange(len(d), dtype=np.int32), "depth": list(np.asarray(d, np.float32))})


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """(image, v, depth array): one row per image line of .npy and .png files; integer arrays are in DEPTH_UNITS per metre. A damaged file is an error that names it."""
    files = _files(spark, path, "*.{npy,png}").select("path", path_stem(F.col("path")).alias("image"), "content")
    return files.mapInPandas(_depth_lines, "image string, v int, depth array<float>")


def _runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for image, content in zip(f["image"], f["content"], strict=True):
            m = np.load(io.BytesIO(content), allow_pickle=False).astype(bool)
            m = m.reshape(-1, *m.shape[-2:])
            edge = np.diff(np.pad(m, ((0, 0), (0, 0), (1, 1))).astype(np.int8), axis=2)
            i, v, u0 = np.nonzero(edge == 1)
            _, _, u1 = np.nonzero(edge == -1)
            yield pd.DataFrame({"image": image, "inst_id": i.astype(np.int64), "v": v.astype(np.int32), "u0": u0.astype(np.int32), "u1": (u1 - 1).astype(np.int32)})


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(image, inst_id, v, u0, u1): runs of boolean arrays (instances, [1,] height, width)."""
    files = _files(spark, path, "*.npy").select(path_stem(F.col("path")).alias("image"), "content")
    return files.mapInPandas(_runs, "image string, inst_id long, v int, u0 int, u1 int")


_TYPES = {"float": "f", "float32": "f", "double": "d", "float64": "d", "uchar": "B", "uint8": "B", "char": "b", "int8": "b", "short": "h", "ushort": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I"}


def ply_vertices(content: bytes) -> np.ndarray:
    """x, y, z of a PLY file's vertices, plain or little-endian."""
    head, _, body = content.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    kind = next(x[1] for x in lines if x and x[0] == "format")
    n, names, types, inside = 0, [], [], False
    for x in lines:
        if x and x[0] == "element":
            inside = x[1] == "vertex"
            n = int(x[2]) if inside else n
        elif x and x[0] == "property" and inside:
            types.append(x[1])
            names.append(x[2])
    at = [names.index(c) for c in "xyz"]
    if kind == "ascii":
        rows = [r.split() for r in body.decode("ascii", "replace").splitlines()[:n]]
        return np.array([[float(r[i]) for i in at] for r in rows], float).reshape(-1, 3)
    order = "<" if "little" in kind else ">"
    fmt = order + "".join(_TYPES[t] for t in types)
    return np.array([[row[i] for i in at] for row in struct.iter_unpack(fmt, body[: n * struct.calcsize(fmt)])], float).reshape(-1, 3)


def _points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, label, idx, content in zip(f["path"], f["label"], f["idx"], f["content"], strict=True):
            p = ply_vertices(content)
            yield pd.DataFrame({"path": path, "label": label, "idx": pd.array([idx] * len(p), "Int32"), "pt_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, idx, pt_id, x, y, z) of PLY files; label and index come from names such as label_12.ply."""
    files = _files(spark, path, "*.ply").withColumn("l", label_and_index(F.col("path"))).select("path", "l.label", "l.idx", "content")
    return files.mapInPandas(_points, "path string, label string, idx int, pt_id long, x double, y double, z double")


def first_existing(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """(key, path): for each key the listed path of lowest priority. wanted: key, priority, path; listing: path."""
    return wanted.join(listing.select("path").distinct(), "path").groupBy("key").agg(F.min_by("path", "priority").alias("path"))
