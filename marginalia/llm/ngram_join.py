"""N-gram Jaccard join: pairs of texts whose sets of word shingles overlap by THRESHOLD % of their union, exactly.

Candidates. (1) A text can only have a partner if that share of its own shingles also occurs in other texts, which one exchange of postings
settles for every text; most texts end here. (2) Texts with equal sets are one set from now on. (3) In each remaining set the
shingles that occur in no other set come first, then the rare ones; a partner must share one of the first n - ceil(share * n) + 1,
so only those are posted.

Index. Shingles are hashed into GROUPS groups, and the counts of a set are its point. The sets of a posted shingle go into an R-tree
(bulk loaded, boxes with maxima): the overlap of a set with anything in a box is at most the sum of the smaller coordinates of point and
upper corner, and must reach 3/7 of both sizes (for 75 %), so boxes and then points are skipped. All candidates come from these trees, in two searches: first
each tree is asked for the partners of its earliest set, its hub; then, where a shingle's sets still belong to several components, for
the partners of each set in other components. Surviving pairs are verified on the sets themselves. What is posted has a fixed size: of the posted
shingles before it a set carries MINIMA minima, and a pair with an equal one was made before.

Links inside a component are counted, not written: its sets are cut into blocks, and pairs of blocks intersect their sets in a task that
returns sums. Shingles and components with many sets are cut into size classes (partners are in the same or the next one) and these into blocks by hash,
so no task holds a hot group.

Shingles count as equal by 64-bit hash, sets by 64-bit hash of all their shingles.

Defined results: a null, empty or wordless text has no shingles, links with nothing and is its own component. Rows with equal text
are linked whatever their doc_id. Rows without a doc_id join the component of an equal set that has one, and else are linked with equal sets alone and
have a null component. The smallest long as doc_id counts as none. Without rows there is no result. Other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import blobs
from marginalia.llm.common import LOWER, UPPER, WORD_PATTERN, broadcast_if_small, settle, shuffle_width, stored, text_batches
from marginalia.llm.components import connected_components
from marginalia.llm.postings import NULL_ID, POSTED, bucket_cuts, deal, documents_of, groups_of, post, posted_batch, shared_of

WORDS, THRESHOLD = 5, 75
GROUPS, LEAF, BROADCAST_ROWS = 64, 16, 500_000
#: Sets of one shingle in a block, shingles of all sets in a block of a component, pairs of one set in a task, running minima of a posting.
BLOCK, BLOCK_SHINGLES, FAN, MINIMA = 1024, 1_000_000, 4096, 4
SALTS = 16
CHUNK_CHARS = 4_000_000
_WORD = re.compile(WORD_PATTERN)
_LOWER = str.maketrans(UPPER, LOWER)
_MULTIPLIER, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FINISH
    h = (h ^ (h >> np.uint64(29))) * _MULTIPLIER
    return h ^ (h >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Ascending distinct hashes of the runs of `words` words of each text; of all words where there are fewer."""
    known, out = _WordHashes(), []
    for t in texts:  # the words of one text at a time
        s = _WORD.findall((t or "").lower() if (t or "").isascii() else (t or "").translate(_LOWER))
        h = np.fromiter(map(known.__getitem__, s), np.uint64, len(s))
        k = min(words, len(h))
        rolled = np.zeros(len(h) - k + 1 if k else 0, np.uint64)
        for j in range(k):
            rolled = (rolled + h[j : len(h) - k + 1 + j]) * _MULTIPLIER
            rolled ^= rolled >> np.uint64(31)
        out.append(np.unique(_finish(rolled + np.uint64(k))))
    return out


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def least_overlap(n: np.ndarray, m: np.ndarray | int, threshold: int = THRESHOLD) -> np.ndarray:
    """Smallest intersection of sets of n and m with 100 * intersection >= threshold * union."""
    return -(-threshold * (n + m) // (100 + threshold))


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both) and both > 0


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups_of(batches, "bucket"):
        for r, _, doc in shared_of(rows):
            shared = np.bincount(doc).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((r["key"], r["bucket"], r["docs"], blobs.pack(shared)), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["key", "bucket", "docs", "shared"])


def _sum_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in groups_of(batches, "key"):
        docs = documents_of(rows, 4)
        shared = docs[:, 3].copy()
        for r in rows:
            some = blobs.unpack(r["shared"], np.uint32)
            shared[: len(some)] += some
        null = docs[:, 0] == NULL_ID
        yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0], mask=null), pa.array(docs[:, 1]), pa.array(docs[:, 2]), pa.array(shared)], ["doc_id", "n", "sid", "shared"])


def describe_sets(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, sid, shared) for every row: set size, set id, and how many shingles other rows have too."""
    spark = documents.sparkSession
    text_batches(spark)
    buckets = shuffle_width(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, size, n = TaskContext.get().partitionId(), [], [], 0, 0

        def flush() -> pa.RecordBatch:
            sets = shingle_sets(texts, words)
            docs = np.array([(NULL_ID if d is None else d, len(s), set_id(s), 0) for d, s in zip(ids, sets, strict=True)], np.int64).reshape(-1, 4)
            return posted_batch(post((part << 32) + n, docs, sets, buckets, count=3)[0])

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t)
                size += len(t)
                if size >= CHUNK_CHARS:
                    yield flush()
                    ids, texts, size, n = [], [], 0, n + 1
        if ids:
            yield flush()

    posted = _rows_of(documents).mapInArrow(run, POSTED)
    counted = deal(posted, "bucket", buckets).mapInArrow(_shared_counts, "key long, bucket int, docs binary, shared binary")
    return deal(counted, "key", buckets).mapInArrow(_sum_shared, "doc_id long, n long, sid long, shared long")


def _rows_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


# --- the sets that may have partners ------------------------------------------------------------------------------------------

SETS = "sid long, doc_id long, n long, shingles binary, counts binary"


def candidate_sets(documents: DataFrame, alive: DataFrame, words: int = WORDS) -> DataFrame:
    """alive: (sid, doc_id), one text of each set. Their shingles and group counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            counts = [np.bincount((s >> np.uint64(40)) % np.uint64(GROUPS), minlength=GROUPS).astype(np.uint32) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in sets], pa.int64()), batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([c.tobytes() for c in counts], pa.binary())],
                ["sid", "doc_id", "n", "shingles", "counts"],
            )

    ids = broadcast_if_small(alive.select("doc_id"), BROADCAST_ROWS)
    return _rows_of(documents).join(ids, "doc_id", "left_semi").mapInArrow(run, SETS)


CHUNK = "key long, docs binary, lengths binary, shingles binary"
POSTINGS = "token long, sid long, doc_id long, n long, behind long, minima binary"


def _chunk_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    types = {"key": pa.int64(), "bucket": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names)


def postings_of(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """A row for each shingle of a set of which a partner must have one, but for those that no other set has.

    behind: how many shingles of the set come from this one on; minima: of the posted ones before it, the least by MINIMA hashes.
    Chunks of sets ask buckets of hashes in how many sets each of their shingles is, once a chunk.
    """
    buckets = shuffle_width(sets.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            docs = np.array(list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True)), np.int64).reshape(-1, 3)
            yield _chunk_rows([((part << 32) + n, docs.tobytes(), docs[:, 2].tobytes(), b"".join(batch.column(3).to_pylist()))], ["key", "docs", "lengths", "shingles"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, times = np.unique(np.frombuffer(shingles, np.uint64), return_counts=True)
                order, cuts = bucket_cuts(h, buckets)
                parts = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield _chunk_rows([(key, b, blobs.pack_sorted(h[some]), blobs.pack(times[some].astype(np.uint32))) for b, some in parts], ["key", "bucket", "hashes", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, "bucket"):
            known, n = np.empty(0, np.uint64), np.empty(0, np.int64)
            for low in range(0, len(rows), 64):
                h = np.concatenate([known, *(blobs.unpack_sorted(r["hashes"]) for r in rows[low : low + 64])])
                known, place = np.unique(h, return_inverse=True)
                n = np.bincount(place, np.concatenate([n, *(blobs.unpack(r["times"], np.uint32) for r in rows[low : low + 64])]), minlength=len(known)).astype(np.int64)
            for r in rows:
                found = n[np.searchsorted(known, blobs.unpack_sorted(r["hashes"]))]
                yield _chunk_rows([(r["key"], r["bucket"], blobs.pack(found))], ["key", "bucket", "counts"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, "key"):
            yield _chunk_rows([(rows[0]["key"], blobs.pack(np.concatenate([blobs.unpack(r["counts"], np.int64) for r in rows])))], ["key", "counts"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, lengths, shingles, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, h = np.frombuffer(docs, np.int64).reshape(-1, 3), np.frombuffer(shingles, np.uint64)
                doc = np.repeat(np.arange(len(docs)), np.frombuffer(lengths, np.int64))
                names = np.unique(h)
                times = np.empty(len(names), np.int64)
                times[bucket_cuts(names, buckets)[0]] = blobs.unpack(counts, np.int64)
                n = times[np.searchsorted(names, h)]
                order = np.lexsort((h, n, doc))
                order = order[n[order] > 1]
                h, doc = h[order], doc[order]
                have = np.bincount(doc, minlength=len(docs))
                own = docs[:, 2] - have
                take = np.clip(docs[:, 2] - (-(-threshold * docs[:, 2] // 100)) + 1 - own, 0, have)
                place = np.arange(len(doc)) - (np.cumsum(have) - have)[doc]
                some = place < take[doc]
                h, doc, place = h[some], doc[some], place[some]
                least = np.full((len(h), MINIMA), np.iinfo(np.uint64).max, np.uint64)
                for d, at in zip(np.flatnonzero(take).tolist(), np.flatnonzero(place == 0).tolist(), strict=True):
                    for j in range(MINIMA if take[d] > 1 else 0):
                        least[at + 1 : at + take[d], j] = np.minimum.accumulate(_finish(h[at : at + take[d] - 1] + np.uint64(j)))
                columns = [pa.array(x) for x in (h.view(np.int64), *(docs[doc, i] for i in range(3)), docs[doc, 2] - own[doc] - place)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x.tobytes() for x in least], pa.binary())], ["token", "sid", "doc_id", "n", "behind", "minima"])

    chunks = stored(sets.select("sid", "doc_id", "n", "shingles").mapInArrow(gather, CHUNK))
    asked = chunks.select("key", "shingles").mapInArrow(ask, "key long, bucket int, hashes binary, times binary")
    counted = deal(asked, "bucket", buckets).mapInArrow(count, "key long, bucket int, counts binary")
    counts = deal(counted, "key", buckets).mapInArrow(assemble, "key long, counts binary")
    return chunks.join(counts, "key").select("docs", "lengths", "shingles", "counts").mapInArrow(choose, POSTINGS)


def verify(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b, ok) for distinct pairs of set ids. A set with many pairs meets them in several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    for side in ("a", "b"):
        hot = pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias(f"fan_{side}")).filter(f"fan_{side} > 1")
        hot = broadcast_if_small(settle(hot), BROADCAST_ROWS)  # at most pairs / FAN rows
        other = "b" if side == "a" else "a"
        fan = F.coalesce(F.col(f"fan_{side}"), F.lit(1))
        pairs = pairs.join(hot, side, "left").withColumn(f"salt_{side}", F.pmod(F.xxhash64(other), fan).cast("int")).drop(f"fan_{side}")
        copies = sets.select(F.col("sid").alias(side), F.col("shingles").alias(f"set_{side}")).join(hot, side, "left")
        copies = copies.withColumn(f"salt_{side}", F.explode(F.sequence(F.lit(0), fan - 1))).drop(f"fan_{side}")
        pairs = pairs.join(copies, [side, f"salt_{side}"]).drop(f"salt_{side}")
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, ok boolean")


# --- the R-tree -----------------------------------------------------------------------------------------------------------------


class CountTree:
    """Points in leaves of LEAF, sorted by size and tiled by their largest spread; upper corners and size ranges of every node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(sizes, kind="stable")
        tile = LEAF * LEAF
        order = np.concatenate([s[np.argsort(points[s, np.argmax(points[s].var(0))], kind="stable")] for s in np.split(order, range(tile, len(order), tile))])
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > 1:
            cuts = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, low, high))

    def search(self, point: np.ndarray, size: int, threshold: int = THRESHOLD) -> np.ndarray:
        """Places of the points whose sets may be linked with a set of these counts."""
        nodes = np.zeros(1, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            bound = np.minimum(top[nodes], point).sum(1)
            nodes = nodes[(bound >= least_overlap(low[nodes], size, threshold)) & (threshold * low[nodes] <= 100 * size) & (100 * high[nodes] >= threshold * size)]
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        bound = np.minimum(self.points[nodes], point).sum(1)
        n = self.sizes[nodes]
        return self.order[nodes[(bound >= least_overlap(n, size, threshold)) & (threshold * n <= 100 * size) & (100 * n >= threshold * size)]]


def _points(rows: list[tuple], place: int) -> np.ndarray:
    return np.frombuffer(b"".join(r[place] for r in rows), np.uint32).reshape(-1, GROUPS).astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first columns, from batches that are sorted by them."""
    name, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != name:
                if group:
                    yield name, group
                name, group = row[:keys], []
            group.append(row[keys:])
    if group:
        yield name, group


def _pair_rows(found: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])


def hub_pairs(posted: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """posted: (token, sid, doc_id, n, counts). Pairs of the earliest set of each shingle with those of its others that the trees leave."""
    hub = F.min(F.struct("doc_id", "sid", "n", "counts")).alias("hub")
    hubs = posted.groupBy("token").agg(hub, F.count(F.lit(1)).alias("m")).filter("m > 1")
    hubs = hubs.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hubs = hubs.select("token", "block", "blocks", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.counts").alias("hub_counts"))
    hot = broadcast_if_small(settle(hubs.filter("blocks > 1 and block = 0").select("token", "blocks")), BROADCAST_ROWS)  # at most postings / BLOCK rows
    dealt = posted.join(hot, "token", "left").withColumn("block", F.pmod(F.xxhash64("sid"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    rows = dealt.join(hubs.drop("blocks"), ["token", "block"]).select("token", "block", "sid", "n", "counts", "hub", "hub_n", "hub_counts")

    def near_hubs(columns: list[list]) -> Iterator[tuple[int, int]]:
        """All groups of some rows at once: those of at most LEAF points are a leaf of a tree and so a comparison of points, larger ones are searched."""
        token, block, sid, n, counts, hub, hub_n, hub_counts = columns
        names, sid, n, hub, hub_n = np.array([token, block]), *(np.array(c) for c in (sid, n, hub, hub_n))
        points, hubs = (np.frombuffer(b"".join(c), np.uint32).reshape(-1, GROUPS) for c in (counts, hub_counts))
        starts = np.flatnonzero(np.r_[True, (names[:, 1:] != names[:, :-1]).any(0)])
        sizes = np.diff(np.r_[starts, len(sid)])
        leaf = np.repeat(sizes <= LEAF, sizes)
        ok = np.zeros(len(sid), bool)
        bound = np.minimum(points[leaf], hubs[leaf]).sum(1, dtype=np.int64)
        ok[leaf] = (bound >= least_overlap(n[leaf], hub_n[leaf], threshold)) & (threshold * n[leaf] <= 100 * hub_n[leaf]) & (100 * n[leaf] >= threshold * hub_n[leaf])
        for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
            some = slice(start, start + size)
            ok[start + CountTree(points[some].astype(np.int64), n[some]).search(hubs[start].astype(np.int64), int(hub_n[start]), threshold)] = True
        ok &= sid != hub
        return zip(sid[ok].tolist(), hub[ok].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in range(8)]
        for batch in batches:
            for c, more in zip(columns, batch.columns, strict=True):
                c.extend(more.to_pylist())
            if len(columns[0]) > 50_000:  # a group may be cut here: its hub goes with each of its rows
                yield _pair_rows({(min(p), max(p)) for p in near_hubs(columns)})
                columns = [[] for _ in range(8)]
        if columns[0]:
            yield _pair_rows({(min(p), max(p)) for p in near_hubs(columns)})

    return rows.repartition("token", "block").sortWithinPartitions("token", "block").mapInArrow(run, "a long, b long").distinct()


def _dealt(rows: DataFrame, key: str, weight: str, most: int) -> DataFrame:
    """rows with i and j, a pair of blocks of their key, for each pair that they belong to, and mine, their own block.

    Keys of more than `most` weight are cut into classes of size n (partners are in the same or the next class), and these by hash into blocks; a
    block is numbered class * 2^32 + hash. Other keys are one block.
    """
    of_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / THRESHOLD)) * 0.999999).cast("long")
    sized = rows.withColumn("class", of_class)
    totals = sized.groupBy(key, "class").agg(F.sum(weight).alias("w"))
    cut = totals.groupBy(key).agg(F.sum("w").alias("w"), F.map_from_entries(F.collect_list(F.struct("class", F.ceil(F.col("w") / most).cast("long").alias("k")))).alias("k"))  # a class for each third of size
    cut = broadcast_if_small(settle(cut.filter(F.col("w") > most).select(key, "k")), BROADCAST_ROWS // 8)
    joined = sized.join(cut, key, "left")
    k = lambda c: F.coalesce(F.try_element_at("k", c), F.lit(0).cast("long"))
    number = lambda c, i: F.shiftleft(c, 32) + i
    c = F.col("class")
    mine = F.when(F.col("k").isNull(), F.lit(0).cast("long")).otherwise(number(c, F.pmod(F.xxhash64("sid"), F.greatest(k(c), F.lit(1).cast("long")))))
    near = lambda at: F.transform(F.filter(F.sequence(F.lit(0).cast("long"), k(at)), lambda i: i < k(at)), lambda i: number(at, i))
    others = F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.concat(near(c - 1), near(c), near(c + 1)))
    out = joined.withColumn("mine", mine).withColumn("other", F.explode(others))
    return out.select(*rows.columns, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))


def cross_pairs(posted: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """posted: (token, sid, part, n, behind, minima, counts). Pairs (a, b) of sets in different components that a shared shingle and the tree leave."""

    def pairs_of(pair: tuple[int, int], group: list[tuple]) -> Iterator[tuple[int, int]]:
        blocks, sids, parts, sizes, behind, minima, _ = zip(*group, strict=True)
        blocks, parts, n, behind = np.array(blocks), np.array(parts), np.array(sizes), np.array(behind)
        side, points = np.flatnonzero(blocks == pair[1]), _points(group, 6)
        if not len(side) or len(np.unique(parts)) < 2:
            return
        least = np.frombuffer(b"".join(minima), np.uint64).reshape(-1, MINIMA)
        top, tree = np.iinfo(np.uint64).max, CountTree(points[side], n[side])
        for i in np.flatnonzero(blocks == pair[0]).tolist():
            near = side[tree.search(points[i], sizes[i], threshold)]
            near = near[(parts[near] != parts[i]) & (np.minimum(behind[near], behind[i]) >= least_overlap(n[near], sizes[i], threshold))]
            near = near[~((least[near] == least[i]) & (least[i] != top)).any(1)]
            for j in near.tolist():
                if pair[0] != pair[1] or sids[i] < sids[j]:
                    yield min(sids[i], sids[j]), max(sids[i], sids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        for (_, i, j), group in _groups(batches, 3):
            for p in pairs_of((i, j), group):
                found.add(p)
                if len(found) > 100_000:
                    yield _pair_rows(found)
                    found = set()
        yield _pair_rows(found)

    dealt = _dealt(posted.withColumn("one", F.lit(1).cast("long")), "token", "one", BLOCK).select("token", "i", "j", "mine", "sid", "part", "n", "behind", "minima", "counts")
    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "sid").mapInArrow(run, "a long, b long").distinct()


def set_links(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links between set ids that give the right components."""
    posted = stored(postings_of(sets, threshold))
    pointed = posted.join(sets.select("sid", "counts"), "sid")
    tried = stored(verify(stored(hub_pairs(pointed.select("token", "sid", "doc_id", "n", "counts"), threshold)), sets, threshold))
    links = tried.filter("ok").select("a", "b")
    parts = settle(connected_components(links))
    placed = posted.drop("doc_id").join(parts.select(F.col("node").alias("sid"), "part"), "sid", "left").withColumn("part", F.coalesce("part", "sid"))
    placed = stored(placed)
    several = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select("token")
    open_groups = placed.join(several, "token", "left_semi").join(sets.select("sid", "counts"), "sid")
    pairs = cross_pairs(open_groups.select("token", "sid", "part", "n", "behind", "minima", "counts"), threshold).join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = verify(stored(pairs), sets, threshold).filter("ok").select("a", "b")
    return links.unionByName(stored(more))


# --- counting links inside components ---------------------------------------------------------------------------------------------


def intersections(first: list[np.ndarray], second: list[np.ndarray], columns: int = 2048, rare: int = 16) -> np.ndarray:
    """Sizes of the intersections of every set of one list with every set of the other. Shingles that at most `rare` sets have are counted pair by
    pair, the others as products of 0/1 matrices of some columns at a time."""
    flat = [np.concatenate(x) for x in (first, second)]
    common = np.intersect1d(*flat)  # shingles on both sides
    out = np.zeros((len(first), len(second)), np.float32)
    if not len(common):
        return out
    cells = []
    for sets, values in zip((first, second), flat, strict=True):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        order = np.argsort(at[hit], kind="stable")
        cells.append((row[hit][order], at[hit][order]))
    often = sum(np.bincount(at, minlength=len(common)) for _, at in cells) > rare
    few = [(row[~often[at]], at[~often[at]]) for row, at in cells]
    at = np.concatenate([few[0][1], few[1][1]])
    order = np.argsort(at, kind="stable")  # in each column the sets of the first list, then those of the second
    at, row, side = at[order], np.concatenate([few[0][0], few[1][0]])[order], np.repeat([0, 1], [len(few[0][1]), len(few[1][1])])[order]
    for step in range(1, rare):
        pair = np.flatnonzero((at[step:] == at[:-step]) & (side[step:] > side[:-step]))
        np.add.at(out, (row[pair], row[pair + step]), 1)
    number = np.cumsum(often) - 1
    cells = [(row[often[at]], number[at[often[at]]]) for row, at in cells]
    for low in range(0, int(often.sum()), columns):
        wide = min(columns, int(often.sum()) - low)
        sides = []
        for (row, at), sets in zip(cells, (first, second), strict=True):
            a, b = np.searchsorted(at, (low, low + wide))
            matrix = np.zeros((len(sets), wide), np.float32)
            matrix[row[a:b], at[a:b] - low] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def count_links(members: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """members: (sid, part, n, copies, shingles). (sid, links): how many documents with another set each set is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), group in _groups(batches, 3):
            mine, sids, n, copies = (np.array([r[c] for r in group]) for c in range(4))
            shingles = [np.frombuffer(r[4], np.uint64) for r in group]
            a, b = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            if not len(a) or not len(b):
                continue
            for low in range(0, len(a), 1024):
                some = a[low : low + 1024]
                for from_ in range(0, len(b), 4096):
                    other = b[from_ : from_ + 4096]
                    both = intersections([shingles[x] for x in some], [shingles[x] for x in other]).astype(np.int64)
                    ok = (100 + threshold) * both >= threshold * (n[some][:, None] + n[other][None, :])
                    ok &= some[:, None] != other[None, :]
                    ids, links = [sids[some]], [ok @ copies[other]]
                    if i != j:
                        ids, links = [*ids, sids[other]], [*links, copies[some] @ ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], ["sid", "links"])

    dealt = _dealt(members, "part", "n", BLOCK_SHINGLES).select("part", "i", "j", "mine", "sid", "n", "copies", "shingles")
    return dealt.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(run, "sid long, links long").groupBy("sid").agg(F.sum("links").alias("links"))


def _salted_join(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left join with a table of one row a key, whose keys may be hot among the rows: by key and salt."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"], "left").drop("_salt")


def join_components(documents: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and n_links (documents linked with this one) for every row."""
    described = stored(describe_sets(documents, words))
    alive = described.filter((F.col("n") > 0) & (100 * F.col("shared") >= threshold * F.col("n")))
    classes = stored(alive.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))
    sets = stored(candidate_sets(documents, classes.filter("doc_id is not null"), words))
    if described.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        sets = stored(sets.dropDuplicates(["sid"]))  # rows that share an id have all been taken
    parts = settle(connected_components(set_links(sets, threshold)).withColumnRenamed("node", "sid"))
    linked_sets = classes.join(parts, "sid")
    links = count_links(linked_sets.drop("doc_id").join(sets.select("sid", "shingles"), "sid"), threshold)
    least = linked_sets.groupBy("part").agg(F.min("doc_id").alias("least"))
    placed = _salted_join(linked_sets.select("sid", "part"), least, "part").select("sid", "least")
    named = classes.filter("copies > 1").select("sid", "doc_id", "copies").join(placed, "sid", "full").join(links, "sid", "left")
    named = stored(named.select("sid", F.coalesce("least", "doc_id").alias("least"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("links")))
    joined = _salted_join(described.select("doc_id", "n", "sid"), named, "sid")
    component = F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    n_links = F.when(F.col("n") > 0, F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), n_links.alias("n_links"))
