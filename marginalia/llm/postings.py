"""Postings of chunks of documents, dealt over buckets of hashes, and the answers that come back by chunk.

A task turns a chunk of documents into one row a bucket: the sorted hashes, and for those that one document of the chunk has, which one. A hash that
several have is known to be shared; it is sent once, without documents, so that other chunks learn of it. So a hash costs a bucket one entry a
chunk, however many documents have it. What names the documents travels in one of a chunk's rows only. A bucket sees
the hashes of all chunks, so it knows which are shared, and answers each chunk for its own documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import blobs

NULL_ID = np.iinfo(np.int64).min
POSTED = "key long, bucket int, docs binary, hashes binary, owner binary"
_POSTED = ["key", "bucket", "docs", "hashes", "owner"]


def deal(df: DataFrame, column: str, parts: int) -> DataFrame:
    """All rows of a bucket (or chunk) in one partition; buckets go one by one over the partitions, chunks by hash."""
    number = F.col(column) if column == "bucket" else F.xxhash64(column)
    return df.repartitionById(parts, F.pmod(number, F.lit(parts)).cast("int"))


def post(key: int, docs: np.ndarray, sets: list[np.ndarray], buckets: int, count: int | None = None) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """docs: a row of integers for each document, which come back with the answers; column `count` gets the number of its hashes that are known to be shared.
    One row a bucket; that of bucket key % buckets, always there, carries docs. Besides, hash and document of the postings known to be shared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, doc = hashes[order], doc[order]
    cuts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, np.int64)
    times = np.diff(np.r_[cuts, len(hashes)])
    several = np.repeat(times > 1, times)
    if count is not None:
        docs[:, count] = np.bincount(doc[several], minlength=len(docs))
    rows, h, owner = [], hashes[cuts], np.where(times > 1, 0, doc[cuts] + 1)  # 0: several
    by_bucket, ends = bucket_cuts(h, buckets)
    head = blobs.pack(docs.reshape(-1))
    for b in range(buckets):
        some = by_bucket[ends[b] : ends[b + 1]]
        if len(some) or b == key % buckets:
            rows.append((key, b, head if b == key % buckets else b"", blobs.pack_sorted(h[some]), blobs.pack(owner[some].astype(np.uint32))))
    return rows, hashes[several], doc[several]


def bucket_cuts(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ascending hashes in order of bucket, then hash, and where each bucket begins."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def posted_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], _POSTED)


def shared_of(rows: list[dict]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """For the rows of one bucket: row, and hash and document of the postings of one document in its chunk whose hash is in others too."""
    known, shared = np.empty(0, np.uint64), np.empty(0, np.uint64)
    for low in range(0, len(rows), 64):  # what is held are the rows as they were sent and two tables of hashes, which are sorted in place
        some = [blobs.unpack_sorted(r["hashes"]) for r in rows[low : low + 64]]
        several = [x[blobs.unpack(r["owner"], np.uint32) == 0] for x, r in zip(some, rows[low : low + 64], strict=True)]
        known = np.concatenate([known, *some])
        known.sort()
        again = np.r_[False, known[1:] == known[:-1]] if len(known) else np.empty(0, bool)
        shared = np.unique(np.concatenate([shared, known[again], *several]))
        known = known[~again]
    del known
    for r in rows:
        h, owner = blobs.unpack_sorted(r["hashes"]), blobs.unpack(r["owner"], np.uint32).astype(np.int64)
        one = owner > 0
        h, owner = h[one], owner[one] - 1
        at = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
        hit = shared[at] == h if len(shared) else np.zeros(len(h), bool)
        yield r, h[hit], owner[hit]


def groups_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    groups: dict[int, list[dict]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            groups.setdefault(r[column], []).append(r)
    for name in sorted(groups):
        yield sorted(groups.pop(name), key=lambda r: (r["key"], r["bucket"]))


def documents_of(rows: list[dict], width: int = 3) -> np.ndarray:
    """The integers that post() was given, from whichever row of a chunk carries them."""
    return blobs.unpack(next(r["docs"] for r in rows if r["docs"]), np.int64).reshape(-1, width)
