"""Toxicity: a classifier regularised by counterfactuals.

A logistic model over words and beginnings of words, present or not. Besides the log loss on labelled documents it pays for
every change of score that comes from swapping an identity term in a labelled sentence for another of the same group, so
that a neutral mention of a group doesn't raise the score by itself.

Fitting uses a bounded sample: at most `most_rows` labelled documents, those with the smallest hash of their id. From it come all features of LEAST_DOCUMENTS
documents that tell the classes apart by LEAST_EVIDENCE (natural log of the likelihood ratio), and all swaps: their penalty is quadratic in the weights of the
features of identity terms, so it is kept as one matrix over these, summed over all sentences of the sample. Every document is scored, over its whole text.

Defined results: a null or empty text has no features and gets the score of the intercept. Labels that are null are ignored; several
labels of one document count as toxic if one of them is. Without any toxic or any clean label the score is the smoothed share of
toxic labels. Rows that share a doc_id are scored each, and the one with the smallest text is learnt from; texts of any length are read whole; other columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marginalia.llm.common import remainder_of, stored, text_batches

MOST_ROWS, LEAST_DOCUMENTS, LEAST_EVIDENCE = 20_000, 3, 5.0
SHORTEST, LONGEST = 3, 8  # of beginnings of words
L2, FAIRNESS, STEPS = 1e-4, 1.0, 400
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")
#: Terms that may be swapped for one another, in four languages.
IDENTITY_GROUPS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["gay", "straight", "lesbian", "bisexual", "transgender"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["black", "white", "asian", "latino"], ["immigrants", "natives", "refugees", "foreigners"], ["old", "young"], ["disabled", "deaf", "blind"],
    ["femmes", "hommes"], ["femme", "homme"], ["musulmans", "chrétiens", "juifs"], ["musulman", "chrétien", "juif"], ["immigrés", "étrangers", "réfugiés"], ["noirs", "blancs"],
    ["frauen", "männer"], ["frau", "mann"], ["muslime", "christen", "juden"], ["ausländer", "flüchtlinge", "einwanderer"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["musulmanes", "cristianos", "judíos"], ["inmigrantes", "extranjeros", "refugiados"], ["negros", "blancos"],
]
SWAPS = {term: group[(i + 1) % len(group)] for group in IDENTITY_GROUPS for i, term in enumerate(group)}


def features_of_word(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def words_in(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(text: str) -> set[str]:
    return {f for w in words_in(text) for f in features_of_word(w)}


def swapped(text: str) -> Iterator[tuple[set[str], set[str]]]:
    """For each sentence with identity terms: the features of it, and of it with each term swapped."""
    lowered = text.lower()
    if SWAPS.keys() & set(_WORD.findall(lowered)):
        for sentence in _SENTENCE.findall(lowered):
            words = set(_WORD.findall(sentence))
            if SWAPS.keys() & words:
                other = {SWAPS.get(w, w) for w in words}
                yield ({f for w in words for f in features_of_word(w)}, {f for w in other for f in features_of_word(w)})


@dataclass(frozen=True)
class ToxicityModel:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)

    def logit(self, text: str) -> float:
        return self.intercept + math.fsum(self.weights[f] for f in features_of(text) if f in self.weights)


def sample_labels(labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most most_rows documents whose crc32 remainder isn't 0."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder_of(F.col("doc_id")) != 0))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)


def fit(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> ToxicityModel:
    """most_rows bounds what is broadcast, stored and learnt from."""
    text_batches(documents.sparkSession)
    chosen = F.broadcast(sample_labels(labels, most_rows))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    train = stored(rows.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    totals = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), sum(n for y, n in totals.items() if y != 1)
    prior = math.log((toxic + 0.5) / (clean + 0.5)) if toxic + clean else math.log(0.5 / 1.5)
    if not toxic or not clean:
        return ToxicityModel(prior)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in features_of(text):
                    seen.setdefault(f, [0, 0])[y == 1] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["feature", "toxic", "clean"])

    counted = train.select("toxic", "text").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    rate = (a + b) / float(toxic + clean)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (F.lit(float(n)) * rate))).otherwise(0.0)
    evidence = part(a, toxic) + part(b, clean)
    best = counted.filter(a + b >= LEAST_DOCUMENTS).select("feature", evidence.alias("evidence")).filter(F.col("evidence") >= LEAST_EVIDENCE).orderBy("feature")  # bounded by the sample
    terms = sorted({f for t in SWAPS for f in features_of_word(t)})
    names = list(dict.fromkeys([r["feature"] for r in best.collect()] + terms))
    index = {f: i for i, f in enumerate(names)}

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(index[f] for f in features_of(text) if f in index) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(y == 1) for y in batch.column(0).to_pylist()], pa.int32()), pa.array(found, pa.list_(pa.int32()))], ["toxic", "features"])

    def sum_swaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the changes s of all swaps, the sum of s s', a cell a row; the cell (-1, -1) is their number."""
        for batch in batches:
            cells: Counter[tuple[int, int]] = Counter()
            for text in batch.column(0).to_pylist():
                for x, z in swapped(text):
                    change = [*((index[f], 1) for f in x - z), *((index[f], -1) for f in z - x)]
                    cells.update({(-1, -1): 1})
                    for i, u in change:
                        for j, v in change:
                            cells[i, j] += u * v
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in cells], pa.int32()), pa.array([j for _, j in cells], pa.int32()), pa.array(cells.values(), pa.int64())], ["i", "j", "n"])

    rows = train.select("toxic", "text").mapInArrow(look_up, "toxic int, features array<int>").collect()  # at most most_rows
    swaps = train.select("text").mapInArrow(sum_swaps, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).orderBy("i", "j").collect()  # at most len(terms)^2 cells
    return _train(names, [(r["toxic"], r["features"]) for r in rows], {(r["i"], r["j"]): r["n"] for r in swaps}, prior)


def _train(names: list[str], rows: list[tuple[int, list[int]]], swaps: dict[tuple[int, int], int], prior: float) -> ToxicityModel:
    """Accelerated gradient descent on log loss + FAIRNESS * mean squared change of score over swaps + L2."""
    rows = sorted(rows)
    y = np.array([k for k, _ in rows], dtype=float)
    at, col = np.repeat(np.arange(len(rows)), [len(c) for _, c in rows]), np.array([i for _, c in rows for i in c], dtype=np.int64)
    weight = FAIRNESS / max(1, swaps.get((-1, -1), 0))
    cells = [(i, j, weight * n) for (i, j), n in swaps.items() if i >= 0]
    s_row, s_col = (np.array([c[k] for c in cells], dtype=np.int64) for k in (0, 1))
    s_value = np.array([c[2] for c in cells], dtype=float)
    n, d = len(rows), len(names)
    # a diagonal bound on the curvature gives each weight a step of its own
    wide = np.bincount(at, minlength=n) + 1.0
    curve = 0.25 * np.bincount(col, wide[at], minlength=d) / n + L2 + 2 * np.bincount(s_row, np.abs(s_value), minlength=d)
    w, v, b, c = np.zeros(d), np.zeros(d), prior, prior
    b_curve = 0.25 * wide.mean()
    for t in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(at, v[col], minlength=n), -500, 500)))
        grad = np.bincount(col, (p - y)[at], minlength=d) / n + L2 * v + 2 * np.bincount(s_row, s_value * v[s_col], minlength=d)
        w_new, b_new = v - grad / curve, c - (p - y).mean() / b_curve
        k = t / (t + 3)
        v, c, w, b = w_new + k * (w_new - w), b_new + k * (b_new - b), w_new, b_new
    return ToxicityModel(float(b), {f: float(x) for f, x in zip(names, w, strict=True) if x})


def score(documents: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """documents with the probability of being toxic. The model is bounded by the sample that it was fitted on and travels with the task."""
    text_batches(documents.sparkSession)
    schema = documents.schema
    keep = [c for c in documents.columns if c != name]
    place = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = model.weights, {}
        for batch in batches:
            scores = []
            for text in batch.column(place).to_pylist():
                words = words_in(text or "")
                for w in words:
                    if w not in known:
                        known[w] = tuple(f for f in features_of_word(w) if f in weights)
                hit = {f for w in words for f in known[w]}
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, model.intercept + math.fsum(weights[f] for f in hit))))))
                if len(known) > 300_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return documents.select(*keep).mapInArrow(run, StructType([schema[c] for c in keep] + [StructField(name, DoubleType())]))


def toxicity(documents: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    model = fit(documents, labels, most_rows)
    scored = score(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (remainder_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
