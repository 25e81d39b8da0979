"""Best-fit packing with large-item matching.

Texts become token ids; a document longer than a sequence is cut into whole sequences and a rest. The lengths, at most `capacity`
different ones, are counted across the corpus; packing is decided on those counts alone: lengths above a third of the capacity
go at most two to a sequence, the longest first, each with the longest partner that still fits; smaller ones then go, the
longest first, where they leave the smallest gap. The plan, a few rows for each length, is a table of ranges: the documents of
one length, numbered across the cluster, find their sequence and place by their number. So no task sees more than its own rows.

Defined results: a null text is empty and has one token, the end (id 0). Repeated rows are packed each. Extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import salted_rank, stored, text_batches

CAPACITY, END_ID, SALTS = 2048, 0, 64
#: Words whose ids one worker remembers; a bound on its memory.
MOST_KNOWN = 600_000
TOKENIZER = "word_bpe_49k.json"
_known: dict[str, dict[str, bytes]] = {}
_ends: dict[str, np.ndarray] = {}
_tokenizers: dict[str, object] = {}
#: Tokens of this tokenizer never span these characters, so the ids of a text are those of the parts between them.
_PART = re.compile(r"[^ \n\t\r]+")
#: Letters whose lower case has the ids of the word itself, then signs of ASCII without apostrophe.
_LETTERS_SIGNS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e]+)([!-&(-/:-@\\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _ids(encoded) -> np.ndarray:
    return np.array(encoded.ids, dtype="<u4")


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes; remembers the ids of parts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        if path not in _tokenizers:
            tokenizer = Tokenizer.from_file(path)
            ends = np.zeros(tokenizer.get_vocab_size(), bool)
            ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
            _tokenizers[path], _known[path], _ends[path] = tokenizer, {}, ends
        self.tokenizer, self.known, self.ends = _tokenizers[path], _known[path], _ends[path]

    def learn(self, parts: list[str]) -> None:
        """Encode parts joined by spaces; the offsets of the tokens say which part each belongs to."""
        for i in range(0, len(parts), 2048):
            some = parts[i : i + 2048]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids = _ids(encoded)
            starts = np.array([o[0] for o in encoded.offsets], dtype=np.int64)
            edges = np.cumsum([0] + [len(x) + 1 for x in some])
            cuts = np.searchsorted(starts, edges)
            raw = ids.tobytes()
            for part, a, b in zip(some, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                self.known[part] = raw[4 * a : 4 * b]

    def learn_letters(self, words: list[str]) -> None:
        """Encode words of letters joined by spaces: the tokenizer takes each as one piece, whose last token is marked as an end. Every word has one end at least, so if their
        number is right each has one; if not, the offsets decide."""
        for i in range(0, len(words), 2048):
            some = words[i : i + 2048]
            ids = _ids(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0])
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw = ids.tobytes()
                self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(some, [0, *ends], ends))  # noqa: B905
            else:
                self.learn(some)

    def add(self, parts: set[str]) -> None:
        """Letters with signs after them are two pieces to the tokenizer, so their ids are those of both; upper and lower case have the same."""
        shaped, letters, signs, rest = [], [], [], []
        for part in parts:
            found = _LETTERS_SIGNS.fullmatch(part)
            if found:
                shaped.append(part)
                letters.append(found[1].lower())
                signs.append(found[2])
            else:
                rest.append(part)
        self.learn(sorted(rest + list(set(filter(None, signs)).difference(self.known))))
        self.learn_letters(sorted(set(letters).difference(self.known)))
        known = self.known
        for part, w, s in zip(shaped, letters, signs, strict=True):
            known[part] = known[w] + known[s] if s else known[w]

    def of(self, texts: list[str]) -> list[bytes]:
        split = [_PART.findall(t) if "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t else t.split() for t in texts]  # not white space to the tokenizer
        words = set().union(*split)
        missing = words.difference(self.known)
        if missing:
            if len(self.known) + len(missing) > MOST_KNOWN:
                self.known.clear()
                missing = words
            self.add(missing)
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in split]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of at most `capacity` ids of every document."""
    text_batches(documents.sparkSession)
    width, end = 4 * capacity, np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            names = batch.column(0).to_pylist()
            texts = batch.column(1)
            for i in range(0, batch.num_rows, 256):
                for name, raw in zip(names[i : i + 256], ids.of(texts.slice(i, 256).to_pylist()), strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), width)):
                        part = raw[at : at + width]
                        rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Run:
    """Items of one length, numbers first .. first + count - 1: `each` of them to a sequence, from `sequence` on, at `offset`."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs that place all items, and the number of sequences. counts: how many items of each length, 1 to capacity."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    placed = [0] * (capacity + 1)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (first sequence, number of sequences)
    made = 0

    def put(length: int, count: int, each: int, sequence: int, offset: int) -> None:
        runs.append(Run(length, placed[length], count, each, sequence, offset))
        placed[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if count and gap:
            gaps.setdefault(gap, []).append((sequence, count))

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            partner = min(capacity - length, length)
            while partner > third and not (left[partner] - (partner == length)):
                partner -= 1
            if partner <= third:
                leave(capacity - length, made, n := left[length])
                put(length, n, 1, made, 0)
            elif partner == length:
                n = left[length] // 2
                leave(capacity - 2 * length, made, n)
                put(length, 2 * n, 2, made, 0)
            else:
                n = min(left[length], left[partner])
                leave(capacity - length - partner, made, n)
                put(length, n, 1, made, 0)
                put(partner, n, 1, made, length)
            made += n
    for length in range(third, 0, -1):
        while left[length]:
            gap = min((g for g in gaps if g >= length), default=0)
            each = (gap or capacity) // length
            if gap:
                sequence, room = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            else:
                gap, sequence, room = capacity, made, -(-left[length] // each)
                made += room
            full = min(room, left[length] // each)
            if full:
                put(length, full * each, each, sequence, capacity - gap)
                leave(gap - each * length, sequence, full)
            rest = min(left[length], each - 1) if full < room else 0
            if rest and rest == left[length]:
                put(length, rest, rest, sequence + full, capacity - gap)
                leave(gap - rest * length, sequence + full, 1)
                full += 1
            leave(gap, sequence + full, room - full)
    return runs, made


def pack(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    cut = stored(pieces(documents, tokenizer_path or default_tokenizer(), capacity))
    counts = {row["length"]: row["count"] for row in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    runs, _ = plan(counts, capacity)
    runs.sort(key=lambda r: (r.length, r.first))
    table = np.array([(r.length, r.first, r.each, r.sequence, r.offset) for r in runs], dtype=np.int64).reshape(-1, 5)
    shift = 46  # numbers of items of one length stay below 2^46
    starts = (table[:, 0] << shift) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            run = table[np.searchsorted(starts, (length << shift) + rank, side="right") - 1] if batch.num_rows else table[:0]
            number = rank - run[:, 1]
            sequence, offset = run[:, 3] + number // np.maximum(run[:, 2], 1), run[:, 4] + number % np.maximum(run[:, 2], 1) * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    salt = F.xxhash64("doc_id", "piece", F.lit("salt"))
    ranked = salted_rank(cut, ["length"], [F.col("doc_id"), F.col("piece")], salt, SALTS)
    return ranked.mapInArrow(place, PIECES + ", sequence_id long, offset long")
