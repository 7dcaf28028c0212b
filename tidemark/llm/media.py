"""Copies of images, cropped, turned, resized or relit, by local descriptors and geometric consensus.

Corners are found on several scales.  The patch around each is turned to its own
direction and compared at fixed pairs of points, which gives 128 bits.  Bits are
split into tables; descriptors that agree in one table, up to a query's weakest
bits, meet in a join, and those within a Hamming distance are matches.  Two matches fix a shift, turn and change
of size; images are copies when enough matches agree in one of these.

An image is a value of a binary column: width and height as little-endian 32-bit
numbers, then a byte for each pixel, row by row.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BinaryType

from tidemark.llm.hashing import mix
from tidemark.llm.shared import cut, ship

#: Tables, each of which has a quarter of a descriptor's bits as key; bits of a table whose two points differ least,
#: and how many of these a query flips at once, so that it also finds keys that an edit has changed there.
TABLES, TABLE_BITS, WEAK, FLIPPED = 4, 32, 4, 2
#: Keys fall into so many cells of a table, of which a bitmap says whether any query has a key there.
CELL_BITS = 25
#: How far the points of a descriptor lie from its corner at most, in pixels of its scale.
RADIUS = 15
#: Images of one size that are described together.
TOGETHER = 16


@dataclass(frozen=True)
class Settings:
    """scales: sizes at which corners are sought; area: pixels of a scale for each corner that is described there, strongest first;
    distance: bits in which matches may differ; agreeing: matches that must agree, each of another corner; slack: in pixels."""

    scales: tuple[float, ...] = (1.0, 0.8, 0.64, 0.512)
    area: int = 200
    distance: int = 18
    agreeing: int = 5
    slack: float = 3.0


def pack(image: np.ndarray) -> bytes:
    return struct.pack("<II", image.shape[1], image.shape[0]) + np.ascontiguousarray(np.clip(image, 0, 255), np.uint8).tobytes()


def unpack(data: bytes | None) -> np.ndarray:
    """The pixels; an image without any if the value is null or malformed."""
    if not data or len(data) < 8:
        return np.zeros((0, 0), np.uint8)
    width, height = struct.unpack("<II", data[:8])
    if width * height != len(data) - 8:
        return np.zeros((0, 0), np.uint8)
    return np.frombuffer(data, np.uint8, offset=8).reshape(height, width)


def _pattern() -> np.ndarray:
    """Fixed pairs of points in a disc, drawn from a seed: 128 x 2 x 2.

    A turned patch grows brighter along x, so pairs lie across: their
    comparisons come out either way equally often.
    """
    rng = np.random.default_rng(64)
    points = rng.normal(0, RADIUS / 2.2, (20_000, 2, 2))
    apart = np.abs(points[:, 0] - points[:, 1])
    good = (np.linalg.norm(points, axis=2).max(axis=1) <= RADIUS - 0.5) & (apart[:, 0] < 0.25 * apart[:, 1]) & (apart[:, 1] > 3)
    return points[good][:128]


_PAIRS = _pattern()
#: The disc whose centre of brightness gives a patch's direction.
_DISC = [(y, x) for y in range(-13, 14) for x in range(-13, 14) if x * x + y * y <= 169]
_DISC_Y, _DISC_X = np.array(_DISC).T


def _smooth(images: np.ndarray) -> np.ndarray:
    """Means of three by three pixels, twice; of a stack of images."""
    for _ in range(2):
        p = np.pad(images, [(0, 0)] * (images.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
        rows = p[..., :-2, :] + p[..., 1:-1, :] + p[..., 2:, :]
        images = (rows[..., :-2] + rows[..., 1:-1] + rows[..., 2:]) * np.float32(1 / 9)
    return images


def resized(images: np.ndarray, scale: float) -> np.ndarray:
    """A stack of images at another size, between four pixels each."""
    if scale == 1:
        return images
    for axis in (-2, -1):
        n = images.shape[axis]
        at = np.clip((np.arange(max(1, round(n * scale))) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        part = (at - low).astype(np.float32)
        part = part[:, None] if axis == -2 else part
        images = np.take(images, low, axis) * (1 - part) + np.take(images, np.minimum(low + 1, n - 1), axis) * part
    return images


def describe(images: np.ndarray, settings: Settings = Settings()) -> dict[str, np.ndarray]:
    """Corners of a stack of images of one size: image, x, y, scale, angle, b0, b1, w0, w1; none of images too small or flat.

    The last two hold the places of each table's weakest bits, five bits a place.
    """
    found: list[dict[str, np.ndarray]] = []
    smooth = _smooth(images.astype(np.float32)) if images.size else images
    for scale in settings.scales if images.size else ():
        level = resized(smooth, scale)
        height, width = level.shape[1:]
        if min(height, width) <= 2 * RADIUS + 4:
            continue
        gy, gx = np.gradient(level, axis=(1, 2))
        xx, yy, xy = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        strength = xx * yy - xy * xy - np.float32(0.04) * (xx + yy) ** 2
        inner = strength[:, RADIUS:-RADIUS, RADIUS:-RADIUS]
        rows = np.maximum.reduce([strength[:, RADIUS + d : height - RADIUS + d] for d in (-2, -1, 0, 1, 2)])
        best = inner == np.maximum.reduce([rows[:, :, RADIUS + d : width - RADIUS + d] for d in (-2, -1, 0, 1, 2)])
        n, y, x = np.nonzero(best & (inner > 1e-3))
        y, x = y + RADIUS, x + RADIUS
        order = np.lexsort((x, y, -strength[n, y, x], n))
        n, y, x = n[order], y[order], x[order]
        rank = np.arange(len(n)) - np.searchsorted(n, n)
        keep = rank < max(1, height * width // settings.area)
        n, y, x = n[keep], y[keep], x[keep]
        patch = level[n[:, None], y[:, None] + _DISC_Y, x[:, None] + _DISC_X]
        angle = np.arctan2(patch @ _DISC_Y.astype(np.float32), patch @ _DISC_X.astype(np.float32))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(c * _PAIRS[None, :, :, 0] - s * _PAIRS[None, :, :, 1]).astype(int) + x[:, None, None]
        py = np.rint(s * _PAIRS[None, :, :, 0] + c * _PAIRS[None, :, :, 1]).astype(int) + y[:, None, None]
        soft = _smooth(level)
        value = soft[n[:, None, None], py, px]
        bits = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1, bitorder="little").view("<i8")
        order = np.argsort(np.abs(value[:, :, 0] - value[:, :, 1]).reshape(-1, TABLES, TABLE_BITS), axis=2)[:, :, :WEAK].reshape(-1, 2, TABLES // 2 * WEAK)
        weak = (order << (5 * np.arange(TABLES // 2 * WEAK))).sum(axis=2)
        place = lambda v: ((v + 0.5) / scale - 0.5).astype(np.float32)  # noqa: B023, E731
        found.append({"image": n, "x": place(x), "y": place(y), "scale": np.full(len(n), 1 / scale, np.float32), "angle": angle.astype(np.float32), "b0": bits[:, 0], "b1": bits[:, 1], "w0": weak[:, 0], "w1": weak[:, 1]})
    if not found:
        return {k: np.zeros(0, t) for k, t in (("image", int), ("x", "f4"), ("y", "f4"), ("scale", "f4"), ("angle", "f4"), ("b0", "i8"), ("b1", "i8"), ("w0", "i8"), ("w1", "i8"))}
    every = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
    order = np.argsort(every["image"], kind="stable")
    return {k: v[order] for k, v in every.items()}


def table_keys(b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """A key for each table of each descriptor, TABLES in a row."""
    half, mask = TABLES // 2, np.uint64((1 << TABLE_BITS) - 1)
    parts = [(b.view(np.uint64) >> np.uint64(TABLE_BITS * i)) & mask for b in (b0, b1) for i in range(half)]
    return np.array([p.astype(np.int64) | t << TABLE_BITS for t, p in enumerate(parts)]).T.reshape(-1, TABLES)


def probed_keys(b0: np.ndarray, b1: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
    """The keys of each descriptor, and those with up to FLIPPED of a table's weakest bits turned over."""
    places = np.array([w >> 5 * (t * WEAK + j) & 31 for w in (w0, w1) for t in range(TABLES // 2) for j in range(WEAK)]).T.reshape(-1, TABLES, WEAK)
    bits = np.int64(1) << places
    flips = [bits[:, :, list(c)].sum(axis=2) for k in range(FLIPPED + 1) for c in combinations(range(WEAK), k)]
    keys = table_keys(b0, b1)
    return np.concatenate([keys ^ f for f in flips], axis=1)


def cells(keys: np.ndarray) -> np.ndarray:
    """The cell of each key's table that it falls into."""
    return (mix(keys.astype(np.uint64)) >> np.uint64(64 - CELL_BITS)).astype(np.int64) + (keys >> TABLE_BITS << CELL_BITS)


def consensus(z: np.ndarray, w: np.ndarray, turn: np.ndarray, ratio: np.ndarray, corner: np.ndarray, other: np.ndarray, settings: Settings = Settings()) -> tuple[int, complex, complex]:
    """How many corners agree in one map z -> a z + b at most, with a and b; places are complex numbers.

    Every two matches apart give a map, which is tried if its turn and change of
    size are about those of both matches.
    """
    best = (0, 1 + 0j, 0j)
    first, second = np.triu_indices(len(z), 1)
    apart = np.abs(z[first] - z[second])
    ok = apart > 6
    first, second = first[ok], second[ok]
    a = (w[second] - w[first]) / (z[second] - z[first])
    fits = np.abs(a) > 1e-6
    for i in (first, second):
        fits &= np.abs(np.angle(a * np.exp(-1j * turn[i]))) < 0.5
        fits &= np.abs(np.log(np.maximum(np.abs(a), 1e-9) / ratio[i])) < 0.35
    first, a = first[fits], a[fits]
    b = w[first] - a * z[first]
    for at in range(0, len(a), 4096):
        good = np.abs(a[at : at + 4096, None] * z + b[at : at + 4096, None] - w) <= settings.slack
        for i in np.flatnonzero(good.sum(axis=1) > best[0]).tolist():
            n = min(len(set(corner[good[i]].tolist())), len(set(other[good[i]].tolist())))
            if n > best[0]:
                best = (n, complex(a[at + i]), complex(b[at + i]))
    return best


_CORNER = pa.struct([("x", pa.float32()), ("y", pa.float32()), ("scale", pa.float32()), ("angle", pa.float32()), ("b0", pa.int64()), ("b1", pa.int64()), ("w0", pa.int64()), ("w1", pa.int64())])
CORNERS = "array<struct<x:float,y:float,scale:float,angle:float,b0:bigint,b1:bigint,w0:bigint,w1:bigint>>"
#: Images that a task describes, about.
PER_TASK = 500


def spread(rows: DataFrame, key: str = "id") -> DataFrame:
    """The rows over enough tasks for the work that an image is, however few bytes they have."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PER_TASK)), key)


def descriptors(images: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, id, digest, corners) of all images with an id and bytes; ``images`` has id and image.  The images themselves aren't moved."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for at in range(0, given.num_rows, TOGETHER):
                part = given.slice(at, TOGETHER)
                data = part["image"].to_pylist()
                pixels = [unpack(d) for d in data]
                corners: list[dict[str, np.ndarray]] = [{}] * len(data)
                for shape in {p.shape for p in pixels}:
                    own = [i for i, p in enumerate(pixels) if p.shape == shape]
                    found = describe(np.stack([pixels[i] for i in own]), settings)
                    ends = np.searchsorted(found["image"], np.arange(len(own) + 1))
                    for k, i in enumerate(own):
                        corners[i] = {f: found[f][ends[k] : ends[k + 1]] for f in _CORNER.names}
                sizes = [len(c["x"]) for c in corners]
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([c[f] for c in corners]), _CORNER.field(f).type) for f in _CORNER.names], fields=list(_CORNER))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), flat)
                digests = pa.array([hashlib.sha256(d).digest() for d in data], pa.binary())
                yield pa.RecordBatch.from_arrays([part["row"], part["id"], digests, lists], names=["row", "id", "digest", "corners"])

    given = images.where("id IS NOT NULL AND image IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "image")
    return given.mapInArrow(described, f"row bigint, id bigint, digest binary, corners {CORNERS}")


def _keyed(seen: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (id, corners) a row per key and corner: key, cell, id, corner, b0, b1; all keys that a query tries, or those of an image whose cell is ``seen``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _bitmap(seen.value) if seen else None
        for given in batches:
            lists = given["corners"]
            flat = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            ids, corner = np.repeat(given["id"].to_numpy(), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            b0, b1, w0, w1 = (np.asarray(flat.field(f)) for f in ("b0", "b1", "w0", "w1"))
            keys = probed_keys(b0, b1, w0, w1) if whole is None else table_keys(b0, b1)
            cell = cells(keys)
            keep = np.ones(keys.shape, bool) if whole is None else (whole[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            of, _ = np.nonzero(keep)
            columns = [keys[keep], cell[keep].astype(np.int32), ids[of], corner[of].astype(np.int32), b0[of], b1[of]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["key", "cell", "id", "corner", "b0", "b1"])

    return made


_ROW = "key bigint, cell int, id bigint, corner int, b0 bigint, b1 bigint"
#: Cells that share a row of the bitmap.
_BUCKET = 32768


def cells_in_use(keyed: DataFrame) -> Broadcast:
    """Bitmaps of the cells that occur: TABLES * 2 ** CELL_BITS bits at most (16 MB), whatever the input."""
    place = (F.col("cell") + 1).cast("long")
    maps = keyed.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return keyed.sparkSession.sparkContext.broadcast({r["bucket"] - 1: bytes(r["bits"]) for r in maps.collect()})


def _bitmap(rows: dict[int, bytes]) -> np.ndarray:
    whole = np.zeros((TABLES << CELL_BITS) // 8, np.uint8)
    for bucket, bits in rows.items():
        whole[bucket * (_BUCKET // 8) :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return whole


def _agreed(settings: Settings) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for query, node, pairs, q, c in frame.itertuples(index=False):
                one, two = np.array([p["corner"] for p in pairs]), np.array([p["corner2"] for p in pairs])
                x, y, u, v = ([p[f] for p in side] for side in (q, c) for f in ("x", "y"))
                z, w = np.array(x)[one] + 1j * np.array(y)[one], np.array(u)[two] + 1j * np.array(v)[two]
                turn = np.array([p["angle"] for p in c])[two] - np.array([p["angle"] for p in q])[one]
                ratio = np.array([p["scale"] for p in c])[two] / np.array([p["scale"] for p in q])[one]
                n, a, b = consensus(z, w, turn, ratio, one, two, settings)
                if n >= settings.agreeing:
                    rows.append((query, node, n, b.real, b.imag, float(np.angle(a)), abs(a)))
            yield pd.DataFrame(rows, columns=["first", "node", "agreeing", "dx", "dy", "turn", "scale"])

    return made


def find_copies(queries: DataFrame, images: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, class_id, members, agreeing, dx, dy, turn, scale): the images that each query is a copy of; both have id and image.

    Images with equal bytes are one class, named by its smallest id; a class is
    described and matched once, and ``members`` says how many images it has (see
    image_classes for which).  Queries with equal bytes are matched once too, and
    each is returned.  A query's pixel z = x + iy lies at scale * exp(i turn) * z
    + dx + i dy in the image.  Null, malformed, flat and very small images have
    no corners and match nothing; null ids are left out.  Repeated ids of images
    count once per row.  An empty table on either side gives an empty result;
    other columns are ignored.
    """
    ship(images.sparkSession)
    every = cut(descriptors(images, settings), "image-corners")
    asked = cut(descriptors(queries, settings), "query-corners")
    classes, described = _represented(every)
    named, q = _represented(asked)
    q_rows = cut(q.select(F.col("node").alias("id"), "corners").mapInArrow(_keyed(), _ROW), "query-keys")
    index = described.select(F.col("node").alias("id"), "corners").mapInArrow(_keyed(cells_in_use(q_rows)), _ROW)
    index = index.drop("cell").withColumnsRenamed({"id": "node", "corner": "corner2", "b0": "c0", "b1": "c1"})
    apart = F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("c1")))
    met = q_rows.withColumnRenamed("id", "first").join(index, "key").where(apart <= settings.distance).select("first", "node", F.struct("corner", "corner2").alias("pair"))
    several = met.groupBy("first", "node").agg(F.collect_set("pair").alias("pairs"))
    several = cut(several.where(F.size(F.array_distinct(F.col("pairs.corner"))) >= settings.agreeing), "image-matches")
    q = q.select(F.col("node").alias("first"), F.col("corners").alias("q_corners"))
    known = several.join(q, "first").join(described, "node").select("first", "node", "pairs", "q_corners", "corners")
    found = known.mapInPandas(_agreed(settings), "first long, node long, agreeing int, dx double, dy double, turn double, scale double")
    each = asked.select(F.col("id").alias("query_id"), "digest").join(named.select("digest", F.col("node").alias("first")), "digest")
    counts = classes.select("node", "class_id", "members")
    return each.join(found, "first").join(counts, "node").select("query_id", "class_id", "members", "agreeing", "dx", "dy", "turn", "scale")


def copies_report(found: DataFrame) -> DataFrame:
    """A row for each query that has copies: how many classes and images, the class with most corners in agreement and where it lies, and all class ids."""
    order = F.struct(F.col("agreeing"), -F.col("class_id"))
    best = F.max_by(F.struct("class_id", "agreeing", "dx", "dy", "turn", "scale"), order).alias("best")
    each = found.groupBy("query_id").agg(F.count("*").alias("n_classes"), F.sum("members").alias("n_images"), best, F.array_sort(F.collect_set("class_id")).alias("class_ids"))
    return each.select("query_id", "n_classes", "n_images", "best.*", "class_ids")


def _represented(described: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(digest, node, class_id, members) of images with equal bytes, and (node, corners) of one image of each class."""
    classes = described.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("least"), F.count("*").alias("members"))
    classes = cut(classes.select("digest", F.col("least.row").alias("node"), F.col("least.id").alias("class_id"), "members"), "image-classes")
    return classes, described.join(classes.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "corners")


def image_classes(images: DataFrame) -> DataFrame:
    """(id, class_id) of all images; null images and ids are left out."""
    rows = images.where("id IS NOT NULL AND image IS NOT NULL").select("id", F.sha2("image", 256).alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.min("id").alias("class_id")), "digest").select("id", "class_id")


_bases: dict[tuple[int, int], np.ndarray] = {}


def _basis(numbers: int, size: int) -> np.ndarray:
    """A fixed smooth texture for each number of a vector."""
    if (numbers, size) not in _bases:
        noise = np.random.default_rng(96).normal(0, 1, (numbers, size, size)).astype(np.float32)
        smooth = _smooth(noise).reshape(numbers, -1)
        _bases[numbers, size] = smooth / smooth.std(axis=1, keepdims=True)
    return _bases[numbers, size]


def drawing(vector: np.ndarray | None, size: int = 96) -> bytes | None:
    """An image of a vector: textures weighted by its numbers; null for no, not finite or only zero numbers."""
    if vector is None or not len(vector) or not np.isfinite(vector).all() or not np.any(vector):
        return None
    v = np.asarray(vector, np.float32)
    image = (v / np.linalg.norm(v)) @ _basis(len(v), size)
    return pack(np.rint(128 + 40 * image).reshape(size, size))


@pandas_udf(BinaryType())
def drawn(vectors: pd.Series) -> pd.Series:
    """Images of a column of vectors."""
    return pd.Series([drawing(v) for v in vectors], dtype=object)


def turned(image: np.ndarray, angle: float, margin: int) -> np.ndarray:
    """An image turned about its middle, without a margin."""
    (height, width), (cy, cx) = image.shape, ((n - 1) / 2 for n in image.shape)
    y, x = np.mgrid[margin : height - margin, margin : width - margin]
    c, s = np.cos(angle), np.sin(angle)
    u, v = c * (x - cx) + s * (y - cy) + cx, c * (y - cy) - s * (x - cx) + cy
    low_u, low_v = np.clip(u.astype(int), 0, width - 2), np.clip(v.astype(int), 0, height - 2)
    p, q, image = np.clip(u - low_u, 0, 1), np.clip(v - low_v, 0, 1), image.astype(float)
    top = image[low_v, low_u] * (1 - p) + image[low_v, low_u + 1] * p
    return top * (1 - q) + (image[low_v + 1, low_u] * (1 - p) + image[low_v + 1, low_u + 1] * p) * q


def edit(image: np.ndarray, kind: int) -> np.ndarray:
    """One of four edits: cropped and relit; turned; made smaller and darker; made larger and cropped."""
    height, width = image.shape
    if kind == 0:
        return image[height // 10 :, width // 6 :] * 0.8 + 30
    if kind == 1:
        return turned(image, 0.4, min(height, width) // 8)
    if kind == 2:
        return resized(image[None].astype(np.float32), 0.8)[0] * 0.9
    return resized(image[None].astype(np.float32), 1.3)[0][height // 10 : height + height // 6, width // 6 : width + width // 5]


@pandas_udf(BinaryType())
def edited(images: pd.Series, kinds: pd.Series) -> pd.Series:
    """Each image with the edit of its kind, by the rest of dividing it by four."""
    pixels = [unpack(i) for i in images]
    return pd.Series([pack(edit(p, int(k) % 4)) if p.size else None for p, k in zip(pixels, kinds, strict=True)], dtype=object)
