"""Small tables with everything that may go wrong in them, and a plain way to read results."""

from __future__ import annotations

import random

WORDS = "the of and to river stone light garden winter under over open quiet road letter music paper window morning silver".split()
#: Columns that clash with names the operators use inside; the values are noise.
EXTRA = "h long, n long, part long, size long, rank long, key long, spans string, host string, values string, score double, copies int, words int, templates string"


def text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def edited(base: str, seed: int, changes: int) -> str:
    rng, words = random.Random(seed), base.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"changed{rng.randrange(1000)}"
    return " ".join(words)


def corpus() -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): nulls, empty, very short and long texts, copies, near copies, shared passages, a repeated row."""
    base, passage = text(1, 120), text(2, 30)
    rows: list[tuple[int | None, str | None, str | None]] = [(0, base, "a"), (1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, "one", "b"), (5, "ONE", "b"), (6, "one two three four", "c")]
    rows += [(10 + i, base, "a") for i in range(3)]
    rows += [(20 + i, edited(base, i, 2 + i), "a") for i in range(8)]
    rows += [(40 + i, text(100 + i, 40) + "\n" + passage + "\n" + text(200 + i, 40), "d") for i in range(6)]
    rows += [(60, text(7, 3000), "e"), (61, text(7, 3000)[50:] + " é", "e"), (62, "x" * 300, None), (63, "x" * 200, None), (64, "añó 日本語 " * 20, "f"), (65, "a\x00b <|endoftext|> tail", "f")]
    rows += [(70, text(9, 60), "g"), (70, text(9, 60), "g"), (None, base, "a"), (None, None, None)]
    return rows


def documents(spark, rows=None):
    """With extra columns; some of the rows have nulls in all of them."""
    rows = corpus() if rows is None else rows
    noise = lambda i: (i, i, i, i, i, i, "s", "h", "v", 0.5, i, i, "t") if i % 3 else (None,) * 13
    data = [(d, t, "en" if i % 2 else None, s, None if t is None else len(t), *noise(i)) for i, (d, t, s) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA).repartition(3)


def collected(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
