"""Suffix-array dedup: removal of passages of LENGTH bytes that an earlier document has, by sparse prefix doubling.

Prefix doubling gives every position a rank for its first 1, 2, 4, ... bytes from the pair of ranks at growing offsets, sorts the pairs across
the cluster in each round, and goes on where ranks are shared. Done so for every byte position it moves several hundred times the input (tests/llm/doubling.py has it;
the README has the figures), since nearly all positions share their first few bytes. Here only a sample of positions is ranked across the cluster, and only from the offset on at
which most are unique. It is no full suffix array, and ranks are 64-bit fingerprints instead of places in a sorted order:

(1) Ranks of 1, 2, 4, ... NAMED bytes are fingerprints of pairs of fingerprints and are made inside each task.
(2) Of each window of ranks that a string of LENGTH bytes spans, the place of the smallest one is sampled: equal strings sample the same place. The sampled ranks
    are sorted across the cluster in buckets; a string whose rank there is in no other document is unique and ends here.
(3) The rest get their rank for LENGTH bytes: sorted with the others of the same rank, each is extended to both sides of its sampled place,
    byte by byte, and gets its first document. It is a repeat if that has a smaller doc_id.

Ranks travel as sorted numbers of chunks of documents, so the two exchanges are a small part of the text. What one chunk can decide itself (a rank that two of its
documents share, a string of which it has an earlier document) is decided there, so a line that very many documents have costs a bucket
one entry a chunk. Copies of whole texts are found by two hashes of them beforehand, over salts, and aren't ranked. Texts are shuffled once, by doc_id; the exchange serves
all three steps.

Ranks are equal if their 64-bit fingerprints of NAMED bytes are; around equal ranks up to EXTRA bytes on either side are compared, by 64-bit fingerprint too.
Long texts are worked through in segments.

Defined results: a null or empty text has no bytes. Rows of one doc_id don't remove from one another. A row without doc_id keeps all its
bytes and removes nothing; the smallest long as doc_id counts as none. Without rows there is no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from marginalia.llm import blobs
from marginalia.llm.common import shuffle_width, text_batches
from marginalia.llm.postings import NULL_ID, POSTED, bucket_cuts, deal, documents_of, groups_of, post, posted_batch, shared_of

LENGTH, NAMED = 50, 32
EXTRA = LENGTH - NAMED
CHUNK_BYTES, SEGMENT, SALTS = 2_000_000, 1 << 20, 32
_ASKED_BITS = np.uint64(16)  # of a rank, the top 48 bits are asked about in the first step
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_TOP = np.uint64(2**64 - 1)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * _A + second
    mixed ^= mixed >> np.uint64(32)
    mixed *= _B
    mixed ^= mixed >> np.uint64(29)
    return mixed


def _ranks(data: np.ndarray) -> np.ndarray:
    """Fingerprints of NAMED bytes from each position on; garbage for the last ones."""
    ranks, reach = _pair((data.astype(np.uint64) + np.uint64(1)) * _C, np.uint64(0)), 1
    while reach < NAMED:
        ranks = _pair(ranks, np.concatenate([ranks[reach:], np.zeros(reach, np.uint64)])[: len(ranks)])
        reach *= 2
    return ranks


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Smallest (or largest) of `width` values from each place on, places beyond the end not counting."""
    pick, fill = (np.minimum, _TOP) if least else (np.maximum, np.uint64(0))
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out, np.concatenate([out[step:], np.full(min(step, len(out)), fill)]))
        done += step
    return out


def string_ranks(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """data: texts one after the other; ends: where each position's text ends. In segments: where it begins, the places of the
    strings of LENGTH bytes in it, the smallest rank of each, and all ranks of the segment."""
    for at in range(0, len(data), SEGMENT):
        part = data[at : at + SEGMENT + LENGTH - 1]
        ranks = _ranks(part)
        smallest = _slide(ranks, EXTRA + 1, True)
        places = np.flatnonzero(ends[at : at + SEGMENT] - np.arange(at, min(at + SEGMENT, len(data))) >= LENGTH)
        yield at, places, smallest[places], ranks


def _text_buffers(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]


def _chunks(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[int, list[tuple]]]:
    """(doc_id, h, text as bytes and more columns) of rows, about CHUNK_BYTES at a time, each chunk with a number of its own."""
    part, rows, size, n = TaskContext.get().partitionId(), [], 0, 0
    for batch in batches:
        columns = [batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), _text_buffers(batch, batch.schema.get_field_index("text")), *(batch.column(c).to_pylist() for c in more)]
        for row in zip(*columns, strict=True):
            rows.append(row)
            size += len(row[2])
            if size >= CHUNK_BYTES:
                yield (part << 32) + n, rows
                rows, size, n = [], 0, n + 1
    if rows:
        yield (part << 32) + n, rows


def _lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes; for each the end of its text and the number of its text; where each text begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(ends, sizes), np.repeat(np.arange(len(texts)), sizes), ends - sizes


def _ask_ranks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for key, rows in _chunks(batches):
        data, ends, doc, _ = _lay_out([r[2] for r in rows])
        found: list[list[np.ndarray]] = [[] for _ in rows]
        for at, places, smallest, _ in string_ranks(data, ends):
            if len(places):
                own = doc[at + places]
                turn = np.flatnonzero(np.r_[True, (smallest[1:] != smallest[:-1]) | (own[1:] != own[:-1])])
                cuts = np.flatnonzero(np.r_[True, own[turn][1:] != own[turn][:-1]])
                for d, some in zip(own[turn][cuts].tolist(), np.split(smallest[turn], cuts[1:]), strict=True):
                    found[d].append(some >> _ASKED_BITS)
        sets = [np.unique(np.concatenate(f)) if f else np.empty(0, np.uint64) for f in found]
        posted, h, own = post(key, np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1, 2), sets, buckets)
        # what is known to be shared passes by the buckets, as an answer under a negative number
        yield posted_batch([*posted, (key, -1 - key % buckets, b"", blobs.pack_sorted(h), blobs.pack(own.astype(np.uint32)))])


ANSWERED = "key long, bucket int, docs binary, hashes binary, doc binary"


def _shared_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups_of(batches, "bucket"):
        if rows[0]["bucket"] < 0:
            yield _emit([(r["key"], r["bucket"], r["docs"], r["hashes"], r["owner"]) for r in rows], _ANSWERED)
            continue
        for r, h, doc in shared_of(rows):
            yield _emit([(r["key"], r["bucket"], r["docs"], blobs.pack_sorted(h), blobs.pack(doc.astype(np.uint32)))], _ANSWERED)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups_of(batches, "key"):
        docs = documents_of(rows, 2)
        h = np.concatenate([blobs.unpack_sorted(r["hashes"]) for r in rows])
        doc = np.concatenate([blobs.unpack(r["doc"], np.uint32) for r in rows]).astype(np.int64)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
        own = docs[doc[cuts]]
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array([blobs.pack_sorted(x) for x in np.split(h, cuts[1:])] if len(cuts) else [], pa.binary())], ["doc_id", "h", "ranks"])


# --- the strings left: (rank, document, place of the rank) with EXTRA bytes on either side ---------------------------------------------

STRINGS = "key long, bucket int, docs binary, ids binary, ranks binary, doc binary, place binary, sides binary, reach binary"
_STRINGS, _ANSWERED = ([x.split()[0] for x in c.split(", ")] for c in (STRINGS, ANSWERED))


def _emit(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    types = {"key": pa.int64(), "bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names)


def _ask_strings(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for key, rows in _chunks(batches, "ranks"):
        data, ends, doc, begins = _lay_out([r[2] for r in rows])
        padded = np.concatenate([np.zeros(EXTRA, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        shared = [blobs.unpack_sorted(r[3]) for r in rows]
        sizes = np.array([len(s) for s in shared])
        starts, flat = np.cumsum(sizes) - sizes, np.concatenate([*shared, np.empty(0, np.uint64)])
        parts: list[tuple[np.ndarray, ...]] = []
        for at, places, smallest, ranks in string_ranks(data, ends):
            if not len(places):
                continue
            own = doc[at + places]
            keep = np.zeros(len(places), bool)
            cuts = np.r_[np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), len(own)]
            asked = smallest >> _ASKED_BITS
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                d = own[a]
                some = flat[starts[d] : starts[d] + sizes[d]]
                if len(some):
                    found = np.searchsorted(some, asked[a:b])
                    keep[a:b] = some[np.minimum(found, len(some) - 1)] == asked[a:b]
            places, smallest, own = places[keep], smallest[keep], own[keep]
            if not len(places):
                continue
            ranked = np.zeros(len(places), np.int64)
            for off in range(EXTRA, -1, -1):  # the leftmost place of the smallest rank
                hit = ranks[places + off] == smallest
                ranked[hit] = places[hit] + off
            first = np.flatnonzero(np.r_[True, (ranked[1:] != ranked[:-1]) | (own[1:] != own[:-1])])
            last = np.r_[first[1:], len(ranked)] - 1
            x = ranked[first]
            parts.append((smallest[first], own[first], at + x, x - places[last], x - places[first]))  # rank, document, its place, least and most bytes before it
        if not parts:
            yield _emit([(key, key % buckets, blobs.pack(np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1)), *[b""] * 6)], _STRINGS)
            continue
        rank, own, x, least, most = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((own, rank))
        rank, own, x, least, most = rank[order], own[order], x[order], least[order], most[order]
        reach, ids = np.arange(EXTRA), np.array([r[0] for r in rows], np.int64)
        head, out = blobs.pack(np.array([(r[0], r[1]) for r in rows], np.int64).reshape(-1)), []
        before = padded[x[:, None] + reach] * (reach >= EXTRA - most[:, None])  # padded is EXTRA bytes ahead
        after = padded[x[:, None] + EXTRA + NAMED + reach] * (reach < EXTRA - least[:, None])
        sides = np.concatenate([before, after], 1).astype(np.uint8)
        # strings that an earlier document of this chunk has are decided; what is decided whole passes by the buckets
        bits, place = _later(rank, ids[own], sides, least, most), (x - begins[own]).astype(np.int64)
        known = np.flatnonzero(bits)
        out.append((key, -1 - key % buckets, b"", b"", b"", blobs.pack(own[known].astype(np.uint32)), blobs.pack(place[known]), b"", blobs.pack(bits[known].astype(np.uint32))))
        open_ = np.flatnonzero(bits != (2 << most) - (1 << least))
        by_bucket, cuts = bucket_cuts(rank[open_], buckets)
        for b in range(buckets):
            some = open_[by_bucket[cuts[b] : cuts[b + 1]]]
            if len(some) or b == key % buckets:
                there = np.unique(own[some])
                out.append((key, b, head if b == key % buckets else b"", blobs.pack(np.diff(ids[there], prepend=0)), blobs.pack_sorted(rank[some]), blobs.pack(own[some].astype(np.uint32)), blobs.pack(place[some]), blobs.pack(sides[some].reshape(-1)), blobs.pack((least * 32 + most)[some].astype(np.uint16))))
        yield _emit(out, _STRINGS)


def _numbers(docs: np.ndarray) -> np.ndarray:
    """Each document's place among the different ones there, as their ids are sent."""
    return np.unique(docs, return_inverse=True)[1]


def _later(ranks: np.ndarray, ids: np.ndarray, sides: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each ranked place the strings that a smaller id has too, as bits by bytes before the rank. The strings around equal ranks are told apart by
    extending the rank to both sides, byte by byte."""
    wide = sides.astype(np.uint64)
    before, after = [np.zeros(len(ranks), np.uint64)], [np.zeros(len(ranks), np.uint64)]
    for i in range(EXTRA):
        before.append(_pair(before[-1], wide[:, EXTRA - 1 - i] + np.uint64(1)))
        after.append(_pair(after[-1], wide[:, EXTRA + i] + np.uint64(1)))
    strings, owners, ways = [], [], []
    for a in range(EXTRA + 1):
        some = np.flatnonzero((least <= a) & (a <= most))
        strings.append(_pair(_pair(ranks[some] + np.uint64(a), before[a][some]), after[EXTRA - a][some]))
        owners.append(some)
        ways.append(np.full(len(some), a))
    names, owner, way = np.concatenate(strings), np.concatenate(owners), np.concatenate(ways)
    order = np.argsort(names, kind="stable")
    names, owner, way = names[order], owner[order], way[order]
    if not len(names):
        return np.zeros(len(ranks), np.int64)
    cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    first = np.repeat(np.minimum.reduceat(ids[owner], cuts), np.diff(np.r_[cuts, len(names)]))
    later = ids[owner] > first
    return np.bincount(owner[later], np.exp2(way[later]), minlength=len(ranks)).astype(np.int64)


def _first_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket side: back go the strings that a smaller doc_id has too."""
    names = ["key", "bucket", "docs", "doc", "place", "bits"]
    for rows in groups_of(batches, "bucket"):
        if rows[0]["bucket"] < 0:
            yield _emit([(r["key"], r["bucket"], b"", r["doc"], r["place"], r["reach"]) for r in rows], names)
            continue
        ranks = np.concatenate([blobs.unpack_sorted(r["ranks"]) for r in rows])
        docs = [blobs.unpack(r["doc"], np.uint32).astype(np.int64) for r in rows]
        ids = np.concatenate([np.cumsum(blobs.unpack(r["ids"], np.int64))[_numbers(d)] for r, d in zip(rows, docs, strict=True)])
        sides = np.concatenate([blobs.unpack(r["sides"], np.uint8) for r in rows]).reshape(-1, 2 * EXTRA)
        reach = np.concatenate([blobs.unpack(r["reach"], np.uint16) for r in rows]).astype(np.int64)
        bits = _later(ranks, ids, sides, reach // 32, reach % 32)
        at, out = 0, []
        for r, d in zip(rows, docs, strict=True):
            mine = bits[at : at + len(d)]
            at += len(d)
            some = np.flatnonzero(mine)
            place = blobs.unpack(r["place"], np.int64)
            if len(some) or r["docs"]:
                out.append((r["key"], r["bucket"], r["docs"], blobs.pack(d[some].astype(np.uint32)), blobs.pack(place[some]), blobs.pack(mine[some].astype(np.uint32))))
        yield _emit(out, names)


FOUND = "key long, bucket int, docs binary, doc binary, place binary, bits binary"


def _spans(starts: np.ndarray) -> np.ndarray:
    """Runs (from, to) that strings of LENGTH at these ascending places cover; touching ones are one run."""
    new = np.flatnonzero(np.r_[True, np.diff(starts) > LENGTH])
    return np.stack([starts[new], starts[np.r_[new[1:], len(starts)] - 1] + LENGTH], 1)


def _found_by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups_of(batches, "key"):
        docs = documents_of(rows, 2)
        doc, place, bits = (np.concatenate([blobs.unpack(r[c], t) for r in rows]).astype(np.int64) for c, t in (("doc", np.uint32), ("place", np.int64), ("bits", np.uint32)))
        at, way = np.nonzero((bits[:, None] >> np.arange(EXTRA + 1)) & 1)
        doc, start = doc[at], place[at] - way
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        if not len(doc):
            continue
        cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        own = docs[doc[cuts]]
        spans = [_spans(np.unique(x)).astype("<i8").tobytes() for x in np.split(start, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(spans, pa.binary())], ["doc_id", "h", "spans"])


def repeated_spans(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text, any other columns) with spans, binary: little-endian 64-bit (from, to) pairs of bytes to remove; null for none.

    Columns named spans, h or h2 are replaced.
    """
    spark = documents.sparkSession
    text_batches(spark)
    buckets = shuffle_width(spark)
    others = [c for c in documents.columns if c not in ("doc_id", "text", "spans", "h", "h2")]
    text, key = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    # the keys can't be null and every use has the same columns, so all joins read one and the same exchange
    rows = documents.select(key.alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"), *others)
    firsts = documents.filter(F.col("doc_id").isNotNull()).select(key.alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2"))
    firsts = firsts.groupBy("h", "h2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    keyed = firsts.select(F.col("first").alias("doc_id"), "h")

    asked = rows.join(keyed, ["doc_id", "h"], "left_semi").mapInArrow(lambda b: _ask_ranks(b, buckets), POSTED)
    answered = deal(deal(asked, "bucket", buckets).mapInArrow(_shared_ranks, ANSWERED), "key", buckets).mapInArrow(_by_document, "doc_id long not null, h long not null, ranks binary")
    left = rows.join(answered, ["doc_id", "h"]).mapInArrow(lambda b: _ask_strings(b, buckets), STRINGS)
    found = deal(deal(left, "bucket", buckets).mapInArrow(_first_documents, FOUND), "key", buckets).mapInArrow(_found_by_document, "doc_id long not null, h long not null, spans binary")
    found = found.groupBy("doc_id", "h").agg(F.first("spans").alias("spans"))
    # texts of which there are very many copies meet their first in SALTS tasks
    first = firsts.filter("n > 1").select("h", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hashed = documents.select(key.alias("doc_id"), F.xxhash64(text).alias("h"), F.xxhash64(text, F.lit(1)).alias("h2"), F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int").alias("salt"))
    copies = hashed.join(first, ["h", "h2", "salt"]).filter("doc_id > first").select("doc_id", "h").distinct().withColumn("copy", F.lit(True))
    whole = rows.join(found, ["doc_id", "h"], "left").join(copies, ["doc_id", "h"], "left")
    size = F.octet_length("text")
    spans = F.when(F.col("copy") & (size >= LENGTH), _whole(size)).otherwise(F.col("spans"))
    return whole.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "text", *others, spans.alias("spans"))


def _whole(size: Column) -> Column:
    """(0, size) as bytes, the low byte first."""
    big = F.lpad(F.hex(size.cast("long")), 16, "0")
    little = F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(8)])
    return F.unhex(F.concat(F.lit("00" * 8), little))


def _kept(text: bytes, spans: bytes | None) -> tuple[bytes, np.ndarray]:
    runs = np.frombuffer(spans, "<i8").reshape(-1, 2) if spans else np.empty((0, 2), np.int64)
    edges = [0, *runs.reshape(-1).tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), runs


def dedup_digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, text, spans in zip(batch.column(0).to_pylist(), _text_buffers(batch, 1), batch.column(2).to_pylist(), strict=True):
                kept, runs = _kept(text, spans)
                out.append((d, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(documents.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """The columns of documents, with the removed bytes gone from text (halves of characters at the edges too) and n_chars anew, where it is there."""
    columns = documents.columns
    others = [c for c in columns if c not in ("doc_id", "text")]
    packed = documents.select("doc_id", "text", F.struct(F.col("text").isNull().alias("null"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("others"))
    marked = repeated_spans(packed).select("doc_id", "others", "text", "spans")
    schema = StructType([StructField(c, marked.schema[c].dataType) for c in ("doc_id", "others", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nulls = batch.column(1).field("null").to_pylist()
            texts = [None if null else _kept(text, spans)[0].decode("utf-8", "ignore") for null, text, spans in zip(nulls, _text_buffers(batch, 2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "others", "text"])

    cut = marked.mapInArrow(run, schema)
    values = {c: F.col(f"others.c{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    values |= {"n_chars": F.length("text")} if "n_chars" in columns else {}
    return cut.select(*[values[c].cast(documents.schema[c].dataType).alias(c) for c in columns])
