"""LM scoring with a hidden Markov language model over tokens.

Tokens are the words of a text and one end. Hidden states emit the end, each token that has at least 1 / VOCABULARY of the training tokens
(so at most VOCABULARY of them, whatever the corpus) and LEAST_COUNT occurrences, and, for every other token, one of ENDINGS classes by its
last two code points, which in turn emits its tokens by their smoothed share: P(token | state) = P(class | state) * P(token | class), and
the second factor is 1 for tokens with an emission of their own. Every training token adds to the counts.

Steps. (1) One pass over the texts writes chunks of documents: the different tokens by hash, and the documents as sequences of their numbers. (2) Each chunk
sends its tokens with their numbers of occurrences to buckets of hashes: one entry for a token and chunk, so a token that every document has is no hot
key. A bucket sums them over the training chunks, names the tokens with an emission of their own, and answers every chunk for its own tokens.
(3) Baum-Welch: each iteration's expected counts by (class, state) are summed within tasks and then across the cluster by class; at most VOCABULARY +
ENDINGS rows reach the driver. Sequences are whole: those of more than PIECE tokens are worked through in pieces, whose messages to one another
come from products of transfer matrices, so nothing is cut. Iterations go on until the gain of a token is below SETTLED; they start on one in WARM_ONE_IN
chunks by hash (and the first), and when that has settled go on with all. (4) The scaled forward recursion gives each document's exact likelihood.

Tokens count as equal by 64-bit hash. Defined results: a null or empty text is the end alone. Without training tokens every count is 0
and the model is uniform. Repeated rows count as often as they occur. A very long text is a chunk of its own, with a few numbers for each of its
tokens in memory. Other columns are left out; without rows there is no result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import blobs
from marginalia.llm.common import LOWER, UPPER, WORD_PATTERN, remainder_of, shuffle_width, stored, text_batches
from marginalia.llm.postings import bucket_cuts, deal, groups_of

STATES, VOCABULARY, LEAST_COUNT, ENDINGS, PIECE = 6, 131_072, 4, 1024, 2048
#: Iterations stop at this gain of log10 likelihood a token, and must by MOST_ITERATIONS; the first ones use one in so many chunks.
SETTLED, MOST_ITERATIONS, WARM_ONE_IN = 0.002, 100, 8
#: Characters of one chunk of documents, tokens worked on at a time.
CHUNK_CHARS, BATCH_TOKENS = 6_000_000, 300_000
EMISSION_PRIOR, TRANSITION_PRIOR, STICKY = 20.0, 1.0, 0.9
_WORD = re.compile(WORD_PATTERN)
_LOWER = str.maketrans(UPPER, LOWER)
END = "\n"  # no word holds it
_END_HASH = np.uint64(xxhash.xxh3_64_intdigest(END))


def tokens_of(text: str) -> list[str]:
    return [*_WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower()), END]


# --- chunks -----------------------------------------------------------------------------------------------------------------------

CHUNK = "key long, train boolean, n_tokens long, hashes binary, endings binary, docs binary, lengths binary, ids binary"
_CHUNK = ["key", "train", "n_tokens", "hashes", "endings", "docs", "lengths", "ids"]
_TYPES = {"key": pa.int64(), "train": pa.bool_(), "n_tokens": pa.int64(), "bucket": pa.int32()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names)


def _encode_chunk(key: int, docs: list[tuple[int | None, str, bool]]) -> tuple:
    split = [tokens_of(t) for _, t, _ in docs]
    lengths = np.array([len(s) for s in split], np.int64)
    names = dict.fromkeys(w for s in split for w in s)
    for i, w in enumerate(names):
        names[w] = i
    ids = np.fromiter((names[w] for s in split for w in s), np.int64, int(lengths.sum()))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    ends: dict[str, int] = {}
    endings = np.fromiter((ends[e] if (e := w[-2:]) in ends else ends.setdefault(e, xxhash.xxh3_64_intdigest(e) % ENDINGS) for w in names), np.uint16, len(names))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    owners = np.array([(d is None, d or 0) for d, _, _ in docs], np.int64)
    return key, docs[0][2], len(ids), blobs.pack_sorted(hashes[order]), blobs.pack(endings[order]), blobs.pack(owners.reshape(-1)), blobs.pack(lengths), blobs.pack(rank[ids])


def encode(documents: DataFrame) -> DataFrame:
    text_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        chunks: dict[bool, list] = {True: [], False: []}  # of training documents and others, so that a chunk is one or the other
        sizes = {True: 0, False: 0}
        for batch in batches:
            for doc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                kind = doc[2]
                chunks[kind].append(doc)
                sizes[kind] += len(doc[1])
                if sizes[kind] >= CHUNK_CHARS:
                    yield _batch([_encode_chunk((part << 32) + n, chunks[kind])], _CHUNK)
                    chunks[kind], sizes[kind], n = [], 0, n + 1
        for chunk in chunks.values():
            if chunk:
                yield _batch([_encode_chunk((part << 32) + n, chunk)], _CHUNK)
                n += 1

    train = remainder_of(F.col("doc_id")) != 1
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), train.alias("train")).mapInArrow(run, CHUNK)


# --- counts of tokens ---------------------------------------------------------------------------------------------------------------

_POSTED, POSTED = ["key", "bucket", "train", "hashes", "endings", "times"], "key long, bucket int, train boolean, hashes binary, endings binary, times binary"
_COUNTED, COUNTED = ["key", "bucket", "hashes", "counts", "classes"], "key long, bucket int, hashes binary, counts binary, classes binary"


def _post_counts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, train, hashes, endings, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h, e, rows = blobs.unpack_sorted(hashes), blobs.unpack(endings, np.uint16), []
            times = np.bincount(blobs.unpack(ids, np.uint32), minlength=len(h)).astype(np.uint32)
            order, cuts = bucket_cuts(h, buckets)
            for b in range(buckets):
                some = order[cuts[b] : cuts[b + 1]]
                if len(some):
                    rows.append((key, b, train, blobs.pack_sorted(h[some]), blobs.pack(e[some]), blobs.pack(times[some])))
            yield _batch(rows, _POSTED)


def _count_bucket(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of a bucket's tokens over training chunks; answers to its chunks in order of their hashes, and one row (key -1) with the
    tokens of at least `least` and, by ending, occurrences and numbers of the others. Of the chunks' rows only one is unpacked at a time."""
    for rows in groups_of(batches, "bucket"):
        known, counts, ending = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint16)
        for low in range(0, len(rows), 64):
            some = [r for r in rows[low : low + 64] if r["train"]]
            h = np.concatenate([known, *(blobs.unpack_sorted(r["hashes"]) for r in some)])
            n = np.concatenate([counts, *(blobs.unpack(r["times"], np.uint32).astype(np.int64) for r in some)])
            e = np.concatenate([ending, *(blobs.unpack(r["endings"], np.uint16) for r in some)])
            known, first, place = np.unique(h, return_index=True, return_inverse=True)
            counts, ending = np.bincount(place, n, minlength=len(known)).astype(np.int64), e[first]
        own = (counts >= least) & (known != _END_HASH)
        rest = ~own & (known != _END_HASH)
        classes = np.stack([np.bincount(ending[rest], counts[rest], minlength=ENDINGS), np.bincount(ending[rest], minlength=ENDINGS)]).astype(np.int64)
        sums = np.array([counts.sum(), len(known), counts[known == _END_HASH].sum()], np.int64)
        yield _batch([(-1, rows[0]["bucket"], blobs.pack_sorted(known[own]), blobs.pack(np.r_[sums, counts[own]]), blobs.pack(classes.reshape(-1)))], _COUNTED)
        for r in rows:
            h = blobs.unpack_sorted(r["hashes"])
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            c = np.where(known[at] == h, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
            yield _batch([(r["key"], r["bucket"], b"", blobs.pack(c.astype(np.uint64)), b"")], _COUNTED)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's counts in order of bucket, then hash."""
    for rows in groups_of(batches, "key"):
        yield _batch([(rows[0]["key"], blobs.pack(np.concatenate([blobs.unpack(r["counts"], np.uint64) for r in rows])))], ["key", "counts"])


@dataclass(frozen=True)
class Lexicon:
    """Classes: 0 is the end, then the tokens with an emission of their own by hash, then the endings."""

    own: np.ndarray  # hashes, ascending
    counts: np.ndarray  # of every class
    logs: np.ndarray  # of every ending, log10 of its occurrences + half of its tokens and one more
    tokens: int
    distinct: int

    def classes_of(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.own, hashes), max(0, len(self.own) - 1))
        hit = self.own[at] == hashes if len(self.own) else np.zeros(len(hashes), bool)
        return np.where(hashes == _END_HASH, 0, np.where(hit, 1 + at, 1 + len(self.own) + endings)).astype(np.int64)


def count_tokens(chunks: DataFrame, vocabulary: int = VOCABULARY) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and (key, counts) for every chunk."""
    buckets = shuffle_width(chunks.sparkSession)
    n = chunks.filter("train").agg(F.sum("n_tokens")).first()[0] or 0
    least = max(LEAST_COUNT, -(-n // vocabulary))
    posted = chunks.select("key", "train", "hashes", "endings", "ids").mapInArrow(lambda b: _post_counts(b, buckets), POSTED)
    counted = stored(deal(posted, "bucket", buckets).mapInArrow(lambda b: _count_bucket(b, least), COUNTED))
    own, counts, endings, sums = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], np.zeros((2, ENDINGS), np.int64), np.zeros(3, np.int64)
    for r in counted.filter("key = -1").select("hashes", "counts", "classes").toLocalIterator():  # a row a bucket; at most `vocabulary` tokens in all
        own.append(blobs.unpack_sorted(r["hashes"]))
        c = blobs.unpack(r["counts"], np.int64)
        sums += c[:3]
        counts.append(c[3:])
        endings += blobs.unpack(r["classes"], np.int64).reshape(2, ENDINGS)
    hashes, c = np.concatenate(own), np.concatenate(counts)
    order = np.argsort(hashes)
    lexicon = Lexicon(hashes[order], np.concatenate([sums[2:], c[order], endings[0]]).astype(float), np.log10(endings[0] + 0.5 * (endings[1] + 1)), int(sums[0]), int(sums[1]))
    return lexicon, deal(counted.filter("key >= 0"), "key", buckets).mapInArrow(_assemble, "key long, counts binary")


# --- the model ----------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class HiddenMarkov:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states

    @staticmethod
    def initial(class_counts: np.ndarray, states: int) -> HiddenMarkov:
        """Sticky states that each prefer another part of the classes, the same on every run."""
        share = _share(class_counts)
        emit = share[:, None] * (np.random.default_rng(7).gamma(2.0, 0.5, (len(share), states)) + 0.05)
        move = np.full((states, states), (1 - STICKY) / max(1, states - 1))
        np.fill_diagonal(move, STICKY if states > 1 else 1.0)
        return HiddenMarkov(np.full(states, 1 / states), move, emit / emit.sum(0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> HiddenMarkov:
        """Expected counts, smoothed: emissions towards the share of the class in the corpus."""
        emit = emit + EMISSION_PRIOR * _share(class_counts)[:, None]
        start, move = start + 1.0, move + TRANSITION_PRIOR
        return HiddenMarkov(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _share(class_counts: np.ndarray) -> np.ndarray:
    return (class_counts + 0.5) / (class_counts.sum() + 0.5 * len(class_counts))


class Pieces:
    """Sequences in pieces of at most PIECE, laid out step by step, the longest pieces first, so that one step of all pieces is a slice."""

    def __init__(self, sequences: list[np.ndarray], opens: list[bool]) -> None:
        self.order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        lengths = np.array([len(sequences[i]) for i in self.order])
        self.steps = int(lengths[0])
        self.width = np.searchsorted(-lengths, -np.arange(self.steps), side="left")  # pieces longer than t
        self.at = np.r_[0, np.cumsum(self.width)]
        self.flat = np.empty(int(self.at[-1]), np.int64)
        for j, i in enumerate(self.order):
            self.flat[self.at[: lengths[j]] + j] = sequences[i]
        self.opens = np.array([opens[i] for i in self.order])
        self.last = self.at[lengths - 1] + np.arange(len(lengths))  # of each piece, the place of its last token


def _transfer(model: HiddenMarkov, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each piece: state before it -> state at its end, as a matrix that sums to 1, and log10 of its scale."""
    k, n = len(model.start), len(pieces.order)
    product, logs = np.broadcast_to(np.eye(k), (n, k, k)).copy(), np.zeros(n)
    for t in range(pieces.steps):
        w = pieces.width[t]
        moved = (product[:w].reshape(-1, k) @ model.move).reshape(w, k, k)
        if t == 0:
            moved[pieces.opens] = model.start  # every row; a first piece has no state before it
        moved *= model.emit[pieces.flat[pieces.at[t] : pieces.at[t] + w]][:, None, :]
        s = moved.sum((1, 2))
        logs[:w] += np.log10(s)
        product[:w] = moved / s[:, None, None]
    return product, logs


def _forward(model: HiddenMarkov, pieces: Pieces, before: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward messages (all of them, or the last of each piece), their scales, and log10 likelihood of each piece after what is before it."""
    k, n = len(model.start), len(pieces.order)
    alpha, scale = np.empty((len(pieces.flat) if keep else n, k)), np.empty(len(pieces.flat) if keep else 0)
    total, a = np.zeros(n), np.where(pieces.opens[:, None], model.start, before @ model.move)
    for t in range(pieces.steps):
        w, at = pieces.width[t], pieces.at[t]
        a = (a if t == 0 else a[:w] @ model.move) * model.emit[pieces.flat[at : at + w]]
        s = a.sum(1)
        a /= s[:, None]
        total[:w] += np.log10(s)
        if keep:
            alpha[at : at + w], scale[at : at + w] = a, s
        else:
            alpha[:w] = a
    return alpha, scale, total


def _cut(sequences: list[np.ndarray]) -> list[tuple[int, int]]:
    return [(i, at) for i, s in enumerate(sequences) for at in range(0, len(s), PIECE)]


def _batches_of(parts: list[tuple[int, int]], sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of pieces, about BATCH_TOKENS at a time, pieces of like length together."""
    sizes = np.array([min(PIECE, len(sequences[i]) - at) for i, at in parts])
    order = np.argsort(-sizes, kind="stable")
    turn = np.cumsum(sizes[order]) // BATCH_TOKENS
    yield from (x.tolist() for x in np.split(order, np.flatnonzero(np.diff(turn)) + 1))


def _messages(model: HiddenMarkov, sequences: list[np.ndarray], parts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """For each piece what comes before it (distribution of the state) and after it (likelihood by state, scaled); only sequences of several pieces need any."""
    k = len(model.start)
    before, after = np.zeros((len(parts), k)), np.ones((len(parts), k))
    long = [p for p, (i, _) in enumerate(parts) if len(sequences[i]) > PIECE]
    if not long:
        return before, after
    matrices = np.empty((len(parts), k, k)) if len(long) > len(parts) // 2 else {}
    for some in _batches_of([parts[p] for p in long], sequences):
        chosen = [long[x] for x in some]
        pieces = Pieces([sequences[i][at : at + PIECE] for i, at in (parts[p] for p in chosen)], [parts[p][1] == 0 for p in chosen])
        for j, m in zip(pieces.order, _transfer(model, pieces)[0], strict=True):
            matrices[chosen[j]] = m
    for p in long:
        i, at = parts[p]
        if at + PIECE < len(sequences[i]):
            v = matrices[p][0] if at == 0 else before[p] @ matrices[p]
            before[p + 1] = v / v.sum()
    for p in reversed(long):
        if parts[p][1] > 0:
            v = matrices[p] @ after[p]
            after[p - 1] = v / v.sum()
    return before, after


def expected_counts(model: HiddenMarkov, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward over whole sequences: start, move and emission counts, and log10 likelihood."""
    k, parts = len(model.start), _cut(sequences)
    start, move, emitted, logs = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape), 0.0
    before, after = _messages(model, sequences, parts)
    for some in _batches_of(parts, sequences):
        pieces = Pieces([sequences[i][at : at + PIECE] for i, at in (parts[p] for p in some)], [parts[p][1] == 0 for p in some])
        numbers = np.array(some)[pieces.order]
        alpha, scale, total = _forward(model, pieces, before[numbers], True)
        beta = after[numbers] / (alpha[pieces.last] * after[numbers]).sum(1, keepdims=True)
        gamma = np.empty_like(alpha)
        for t in range(pieces.steps - 1, -1, -1):
            w, at = pieces.width[t], pieces.at[t]
            gamma[at : at + w] = alpha[at : at + w] * beta[:w]
            ahead = beta[:w] * model.emit[pieces.flat[at : at + w]] / scale[at : at + w, None]
            if t:
                behind = alpha[pieces.at[t - 1] : pieces.at[t - 1] + w]
                move += (behind.T @ ahead) * model.move
                beta[:w] = ahead @ model.move.T
            else:
                inside = ~pieces.opens
                move += (before[numbers][inside].T @ ahead[inside]) * model.move
        start += gamma[: pieces.width[0]][pieces.opens].sum(0)
        for i in range(k):
            emitted[:, i] += np.bincount(pieces.flat, gamma[:, i], minlength=len(emitted))
        logs += float(total.sum())
    return start, move, emitted, logs


def log_likelihoods(model: HiddenMarkov, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 of the exact likelihood of each sequence."""
    out, parts = np.zeros(len(sequences)), _cut(sequences)
    before, _ = _messages(model, sequences, parts)
    for some in _batches_of(parts, sequences):
        pieces = Pieces([sequences[i][at : at + PIECE] for i, at in (parts[p] for p in some)], [parts[p][1] == 0 for p in some])
        numbers = np.array(some)[pieces.order]
        np.add.at(out, [parts[p][0] for p in numbers.tolist()], _forward(model, pieces, before[numbers], False)[2])
    return out


def _sequences(lexicon: Lexicon, hashes: bytes, endings: bytes, lengths: bytes, ids: bytes) -> list[np.ndarray]:
    classes = lexicon.classes_of(blobs.unpack_sorted(hashes), blobs.unpack(endings, np.uint16))
    return np.split(classes[blobs.unpack(ids, np.uint32)], np.cumsum(blobs.unpack(lengths, np.int64))[:-1])


def train(chunks: DataFrame, lexicon: Lexicon, states: int = STATES) -> tuple[HiddenMarkov, list[tuple[bool, float]]]:
    """chunks: those to learn from. Returns the model, and for every iteration whether it used all chunks and the log10 likelihood a token."""
    model, history, whole = HiddenMarkov.initial(lexicon.counts, states), [], False
    columns = [f"s{i}" for i in range(states)]
    schema = "class int, " + ", ".join(f"{c} double" for c in columns)
    if not lexicon.tokens:
        return model, history
    first = chunks.agg(F.min("key")).first()[0]
    some = chunks.filter((F.pmod(F.xxhash64("key"), F.lit(WARM_ONE_IN)) == 0) | (F.col("key") == first))
    for _ in range(MOST_ITERATIONS):

        def run(batches: Iterator[pa.RecordBatch], current: HiddenMarkov = model) -> Iterator[pa.RecordBatch]:
            m, k = current.emit.shape
            start, move, emit, logs, n = np.zeros(k), np.zeros((k, k)), np.zeros((m, k)), 0.0, 0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    sequences = _sequences(lexicon, *row)
                    found = expected_counts(current, sequences)
                    start, move, emit, logs, n = start + found[0], move + found[1], emit + found[2], logs + found[3], n + sum(map(len, sequences))
            if n:
                table = np.vstack([emit, move, start, np.full(k, logs), np.full(k, n)])  # classes, then k rows of moves, start, likelihood, tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(table)), pa.int32()), *[pa.array(table[:, i]) for i in range(k)]], ["class", *columns])

        summed = (chunks if whole else some).select("hashes", "endings", "lengths", "ids").mapInArrow(run, schema).groupBy("class").agg(*[F.sum(c).alias(c) for c in columns])
        found = summed.toArrow().sort_by("class")  # classes + states + 3 rows
        table = np.stack([found[c].to_numpy() for c in columns], 1)
        model = HiddenMarkov.from_counts(table[-3], table[-states - 3 : -3], table[: -states - 3], lexicon.counts)
        history.append((whole, float(table[-2, 0] / table[-1, 0])))
        if len(history) > 1 and history[-2][0] == whole and history[-1][1] - history[-2][1] < SETTLED:
            if whole:
                return model, history
            whole = True
    raise RuntimeError(f"the model has not settled after {MOST_ITERATIONS} iterations")


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score_texts(documents: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row."""
    buckets = shuffle_width(documents.sparkSession)
    chunks = stored(encode(documents))
    lexicon, counts = count_tokens(chunks, vocabulary)
    model, _ = train(chunks.filter("train"), lexicon, states)
    least = 1 + len(lexicon.own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = math.log10(lexicon.tokens + 0.5 * (lexicon.distinct + 1))
        for batch in batches:
            for hashes, endings, docs, lengths, ids, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, n = blobs.unpack_sorted(hashes), blobs.unpack(lengths, np.int64)
                c = np.empty(len(h))
                c[bucket_cuts(h, buckets)[0]] = blobs.unpack(counts, np.uint64)
                classes = lexicon.classes_of(h, blobs.unpack(endings, np.uint16))
                logs = np.log10(c + 0.5)
                inside = np.where(classes >= least, logs - lexicon.logs[np.maximum(classes - least, 0)], 0.0)
                flat, cuts = blobs.unpack(ids, np.uint32), np.cumsum(n) - n
                sums = [np.add.reduceat(x[flat], cuts) for x in (logs - whole, inside)]
                known = np.add.reduceat((c > 0)[flat].astype(np.int64), cuts)
                score = log_likelihoods(model, np.split(classes[flat], cuts[1:])) + sums[1]
                owner = blobs.unpack(docs, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(owner[:, 1], mask=owner[:, 0] == 1), *map(pa.array, (n, known, sums[0], score))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    joined = chunks.select("key", "hashes", "endings", "docs", "lengths", "ids").join(counts, "key").drop("key")
    scored = joined.mapInArrow(run, SCORED)
    return scored.select("doc_id", (remainder_of(F.col("doc_id")) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score")
