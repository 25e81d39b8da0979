"""Product quantisation of vectors in whole numbers, with nearest entries found by a ball search.

Components become floor(scale * x); a vector is cut into equal parts, and each part position has a codebook of its own. Rounds of assignment and averaging
refine the codebooks; a code is the nearest entry of each part.

Search: the entries of a part position are the points of a vantage-point tree. Each node knows within which distances of its vantage entry the entries of its two
children lie. A child is visited unless the triangle inequality says that all of it is farther than the best entry so far. Distances are compared as floating-point
numbers whose lower bounds are rounded down and upper bounds up, and equal bounds are visited, so no entry that might be nearest, or as near with a lower index, is passed over;
which of two entries is nearer is decided on exact whole squared distances.

Sums and counts by (part, entry, component) are made inside tasks, so entries x components x parts rows a task are shuffled; the driver holds the codebooks, whose size is set
by the parameters and the dimension alone.

Rows whose vector is null or holds null or non-finite components are left out. Rows that share a vec_id are rows like others; where the first entries are chosen, null ids come last and
equal ids are ordered by their components. With fewer kept rows than entries there are as many entries as rows. Null labels are one label. Vectors of different lengths, or whose
length isn't a multiple of the parts, are an error, as are components from 2^28 on after scaling, whose sums might not fit whole numbers of 64 bits. An empty table
gives an empty one. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import stored
from marginalia.llm.skew import join_counted

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Scaled components must be smaller.
LARGEST = 1 << 28
#: Below this, squared distances of a part are whole numbers that doubles hold exactly.
EXACT_SQUARE = 1 << 53
#: Relative error allowed for a distance: far above that of a square root in double precision.
SLACK = 2.0**-40


# --- the tree ------------------------------------------------------------------------------------------------------------------------


@dataclass
class Child:
    """A subtree, with the least and the largest distance of its entries from the vantage entry above, rounded down and up."""

    least: float
    largest: float
    node: Node


@dataclass
class Node:
    entry: int
    children: list[Child]


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances, as 64-bit whole numbers."""
    gap = points - entry
    return np.einsum("ij,ij->i", gap, gap).astype(np.int64)


def grow(book: np.ndarray, members: list[int]) -> Node:
    """The vantage entry is the first; the others are split at their median distance from it."""
    first, rest = members[0], members[1:]
    if not rest:
        return Node(first, [])
    far = np.sqrt(squared(book[rest], book[first]).astype(np.float64))
    order = np.argsort(far, kind="stable")
    cuts = [order[: (len(rest) + 1) // 2], order[(len(rest) + 1) // 2 :]]
    return Node(first, [Child(float(far[c].min()) * (1 - SLACK), float(far[c].max()) * (1 + SLACK), grow(book, [rest[i] for i in c])) for c in cuts if len(c)])


class PartTree:
    """Nearest entries of one part position."""

    def __init__(self, book: np.ndarray) -> None:
        self.book, self.root = book, grow(book, list(range(len(book))))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each point; of entries that are equally near the one with the lowest index."""
        entry = np.zeros(len(points), np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        self._visit(self.root, points, np.arange(len(points)), entry, best)
        return entry, best

    def _visit(self, node: Node, points: np.ndarray, rows: np.ndarray, entry: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        far = squared(points[rows], self.book[node.entry])
        had = best[rows]
        better = (far < had) | ((far == had) & (node.entry < entry[rows]))
        entry[rows[better]], best[rows[better]] = node.entry, far[better]
        if not node.children:
            return
        at = np.sqrt(far.astype(np.float64))
        inner_first = at <= node.children[0].largest if len(node.children) > 1 else np.ones(len(rows), bool)
        for side, order in ((inner_first, node.children), (~inner_first, node.children[::-1])):
            for child in order:
                bound = np.maximum(at * (1 - SLACK) - child.largest, child.least - at * (1 + SLACK))  # no entry of the child is nearer
                open_rows = side & (bound <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK))
                self._visit(child.node, points, rows[open_rows], entry, best)


# --- rows ----------------------------------------------------------------------------------------------------------------------------


def whole_components(vectors: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their components as whole numbers); vectors is an Arrow list array of numbers."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
    flat = vectors.flatten()
    values = np.asarray(flat.fill_null(float("nan")) if flat.null_count else flat, np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(lengths)
    kept = np.asarray(vectors.is_valid()) & (bad[ends] == bad[ends - lengths])
    sizes = np.unique(lengths[kept])
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes[:5].tolist()}")
    whole = np.floor(values[np.repeat(kept, lengths)] * scale)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a scaled component is not below {LARGEST}")
    return kept, whole.astype("<i4").reshape(int(kept.sum()), int(sizes[0]) if len(sizes) else 0)


def compact(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, dim, packed): kept rows with their whole components as little-endian 32-bit numbers."""
    shape = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, dim int, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = whole_components(batch.column("vector"), scale)
            mask = pa.array(kept)
            packed = pa.array([row.tobytes() for row in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(mask), batch.column("label").filter(mask), pa.array(np.full(len(whole), whole.shape[1], np.int32)), packed], ["vec_id", "label", "dim", "packed"])

    return rows.select("vec_id", "label", F.col(vector).alias("vector")).mapInArrow(run, shape)


def _matrix(packed: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), "<i4").reshape(len(packed), dim)


def _fits(dim: int, parts: int, *arrays: np.ndarray) -> type:
    """Doubles are faster than 64-bit whole numbers, and as exact while squares stay small."""
    largest = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    return np.float64 if (2 * largest) ** 2 * max(1, dim // parts) < EXACT_SQUARE else np.int64


def assign(whole: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, squared distances), rows x parts. books: parts x entries x width."""
    parts, _, width = books.shape
    kind = _fits(parts * width, parts, whole, books)
    points, trees = whole.astype(kind), [PartTree(b.astype(kind)) for b in books]
    found = [trees[p].nearest(np.ascontiguousarray(points[:, p * width : (p + 1) * width])) for p in range(parts)]
    return np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def averaged(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the mean of its parts, rounded down; entries that no part chose stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            whole = _matrix(batch.column("packed"), parts * width).astype(np.int64)
            chosen, _ = assign(whole, books)
            for p in range(parts):
                np.add.at(counts[p], chosen[:, p], 1)
                order = np.argsort(chosen[:, p], kind="stable")
                at = np.searchsorted(chosen[order, p], np.arange(entries))
                used = np.flatnonzero(np.diff(np.append(at, len(order))))
                if len(used):
                    sums[p, used] += np.add.reduceat(whole[order, p * width : (p + 1) * width], at[used], axis=0)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array([row.tolist() for row in sums[p, e]], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    made = rows.select("packed").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
    fresh = books.copy()
    for r in totals.collect():  # parts x entries rows
        fresh[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return fresh


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the rows with the smallest ids; None without rows."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), F.hex("packed")).limit(entries).select("packed").collect()
    if not first:
        return None
    whole = np.stack([np.frombuffer(r["packed"], "<i4") for r in first]).astype(np.int64)
    if whole.shape[1] % parts:
        raise ValueError(f"{whole.shape[1]} components can't be cut into {parts} equal parts")
    return np.ascontiguousarray(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2))


def encode(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256)"""
    if not 0 < entries <= 256:
        raise ValueError("codes are two hexadecimal digits a part: 1 to 256 entries")
    rows = stored(compact(vectors, vector, scale))
    lengths = [r["dim"] for r in rows.select("dim").distinct().limit(2).collect()]
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths}")
    books = first_books(rows, parts, entries)
    shape = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"{shape}, label_error long, codebooks_sha256 string")
    for _ in range(rounds):
        books = averaged(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, far = assign(_matrix(batch.column("packed"), books.shape[0] * books.shape[2]).astype(np.int64), books)
            codes = pa.array([row.tobytes().hex() for row in chosen.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(far.sum(1))], ["vec_id", "label", "code", "error"])

    coded = stored(rows.select("vec_id", "label", "packed").mapInArrow(run, shape))
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")).select(_key().alias("key"), "label_error", "n"))
    joined = join_counted(coded.withColumn("key", _key()), sums, ["key"], "n")
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _key():
    """The label as text, with a text of its own for null."""
    return F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
