"""Quality rules: weak supervision in place of all-must-pass filters.

Each rule votes good (1), bad (0) or abstains (null). Expectation-maximisation over the votes, without any labels, estimates how
often each rule votes good or bad on good and on bad documents, and the share of good documents; a document's posterior
probability of being good then decides. Documents with the same votes are alike, so the corpus is reduced to counts of vote
patterns (at most 3^rules rows, whatever the corpus) and the iterations run on those counts.

Defined results: a null or empty text has no words, fails the base rule and is not kept. Rows are judged one by one, so repeated rows
get equal results. Texts of any length are read whole. An empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE_CLASS, let, stored, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Common words of four languages: text without any of them is a list, a table or noise.
FUNCTION_WORDS = "the of and to in is that it for with are be der die das und in den zu ist nicht für le la les de des et un une du en que est el los las y por con no se para".split()
MOST_ITERATIONS, CLOSE_ENOUGH, SMOOTHING = 20_000, 1e-9, 1.0


def counts_of(text: Column) -> dict[str, Column]:
    """Base counts, each a function of the text and of `words`, a column of its words."""
    words = F.col("words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(words),
        "n_lines": let(lines, F.size).cast("long"),
        "n_closed_lines": F.size(F.filter(lines, lambda x: x.rlike(rf"[.!?…:;\"'»”)][{SPACE_CLASS}]*$"))).cast("long"),
        "n_loud_words": F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}{2,}"))).cast("long"),
        "n_function_words": F.size(F.filter(words, lambda w: F.lower(w).isin(FUNCTION_WORDS))).cast("long"),
    }


def repeated_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more in the text.

    Windows are sorted by hash, so equal ones become neighbours; the places of those are sorted again and their overlapping
    triples measured. Neighbours count as equal by the 64-bit hash of their words.
    """

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows), lambda s: let(places(s), covered)))


@dataclass(frozen=True)
class QualityRule:
    """Votes good or bad where the condition holds, else abstains."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), F.lit(0)).when(F.expr(self.good), F.lit(1)).cast("tinyint")


#: Conditions over the base counts. Thresholds follow common practice for web text.
RULES = [
    QualityRule("length", "n_words >= 80", "n_words < 50"),
    QualityRule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars > 12 * n_words or word_chars < 2 * n_words"),
    QualityRule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    QualityRule("duplicate_lines", "n_dup_lines = 0 and n_lines >= 3", "10 * n_dup_lines > 3 * n_lines"),
    QualityRule("repetition", "20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    QualityRule("loud_words", "50 * n_loud_words <= n_words", "10 * n_loud_words > 3 * n_words"),
    QualityRule("closed_lines", "10 * n_closed_lines >= 6 * n_lines", "10 * n_closed_lines < 3 * n_lines"),
    QualityRule("function_words", "10 * n_function_words >= n_words", "50 * n_function_words < n_words"),
]


@dataclass(frozen=True)
class LabelModel:
    """log_odds[j][v]: what vote v of rule j adds to the log odds of good; prior: those without any vote."""

    prior: float
    log_odds: list[tuple[float, float]]
    iterations: int

    def posterior(self, votes: list[Column]) -> Column:
        total = F.lit(self.prior)
        for vote, (bad, good) in zip(votes, self.log_odds, strict=True):
            total = total + F.when(vote == 1, F.lit(good)).when(vote == 0, F.lit(bad)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_label_model(patterns: list[tuple[tuple[int | None, ...], int]]) -> LabelModel:
    """Expectation-maximisation over (votes, count). Good and bad each have their own rate of good votes for each rule.

    Abstaining carries no information. The first guess of a pattern is its share of good votes, which fixes which class is which;
    counts are smoothed by SMOOTHING on either side, so no rate is 0 or 1. It is an error if the guesses still move after MOST_ITERATIONS.
    """
    width = len(patterns[0][0]) if patterns else 0
    guess = [(sum(v or 0 for v in votes) + 1.0) / (sum(v is not None for v in votes) + 2.0) for votes, _ in patterns]
    prior, odds, step = 0.0, [(0.0, 0.0)] * width, 0
    for step in range(1, MOST_ITERATIONS + 1):
        total = sum(n for _, n in patterns)
        good = sum(g * n for g, (_, n) in zip(guess, patterns, strict=True))
        prior = math.log((good + SMOOTHING) / (total - good + SMOOTHING))
        odds = []
        for j in range(width):
            seen = [[SMOOTHING, SMOOTHING], [SMOOTHING, SMOOTHING]]  # [bad, good documents][bad, good votes]
            for g, (votes, n) in zip(guess, patterns, strict=True):
                if votes[j] is not None:
                    seen[1][votes[j]] += g * n
                    seen[0][votes[j]] += (1 - g) * n
            share = [[x / sum(pair) for x in pair] for pair in seen]
            odds.append((math.log(share[1][0] / share[0][0]), math.log(share[1][1] / share[0][1])))
        new = [1 / (1 + math.exp(-max(-700.0, min(700.0, prior + sum(odds[j][v] for j, v in enumerate(votes) if v is not None))))) for votes, _ in patterns]
        moved = max((abs(a - b) for a, b in zip(new, guess, strict=True)), default=0.0)
        guess = new
        if moved < CLOSE_ENOUGH:
            return LabelModel(prior, odds, step)
    raise RuntimeError(f"the label model still moves after {MOST_ITERATIONS} iterations")


def quality(documents: DataFrame, rules: list[QualityRule] = RULES) -> DataFrame:
    """doc_id, base counts, base_failed, kept and quality (posterior probability) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), words_of(F.col("text")).alias("words"))
    counted = split.select("doc_id", *[c.alias(name) for name, c in counts_of(F.col("text")).items()])
    voted = counted.select("*", *[r.vote().alias(f"vote_{r.name}") for r in rules])
    votes = [f"vote_{r.name}" for r in rules]
    voted = stored(voted)
    seen = voted.groupBy(*votes).count().orderBy(*votes).collect()  # at most 3^rules rows
    model = fit_label_model([(tuple(row[:-1]), row[-1]) for row in seen])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = voted.withColumn("quality", model.posterior([F.col(v) for v in votes]) if seen else F.lit(0.0)).withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
