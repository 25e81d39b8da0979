r"""Line deduplication: lines that many documents share go from all of them.

Every document is exploded into its lines; a line's key is the line without white space at both ends, A-Z lower-cased. Keys are hashed, distinct documents
counted for each hash, and lines whose key is found in too many documents are dropped; the others are put together again by their position.

Only what is short is shuffled by line: hashes, ids and positions. Texts are shuffled once, to meet the positions that they lose. Equality of keys rests on two independent
64-bit hashes, 128 bits together.

Documents are told apart by doc_id, a whole number: rows that share one count once for a key, rows without one are told apart by their text. A null text is an empty one, an empty text one empty
line, which stays as its key is too short. Rows that are wholly equal get equal results. Texts of any length are worked through whole; their cost is linear in the number of lines. An empty
table gives an empty one. Other columns of the input aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import let, lower_ascii, stored
from marginalia.llm.skew import join_counted

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """Texts of ASCII alone are lower-cased as bytes, others by a table of letters."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


def _hashes(*parts: Column | str, names: tuple[str, str]) -> list[Column]:
    """Two hashes whose seeds differ."""
    return [F.xxhash64(*parts).alias(names[0]), F.xxhash64(F.lit(1), *parts).alias(names[1])]


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, r1, r2, text): (r1, r2) names a row by its id and text; null texts are empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", *_hashes(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), text, names=("r1", "r2")), text.alias("text"))


def exploded(docs: DataFrame, least_chars: int = 1) -> DataFrame:
    """(doc_id, r1, r2, place, h1, h2) for each line with a key that is long enough."""
    lines = _named(docs).select("doc_id", "r1", "r2", F.posexplode(F.split("text", "\n")).alias("place", "_line"))
    keyed = lines.select("doc_id", "r1", "r2", "place", line_key(F.col("_line")).alias("_key"))
    return keyed.filter(F.char_length("_key") >= least_chars).select("doc_id", "r1", "r2", "place", *_hashes("_key", names=("h1", "h2")))


def frequent_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(h1, h2, n): keys found in at least least_docs documents, and in how many."""
    document = F.coalesce(F.col("doc_id").cast("long"), F.col("r1"))
    counted = exploded(docs, least_chars).groupBy("h1", "h2").agg(F.countDistinct(document).alias("n"))
    return counted.filter(F.col("n") >= least_docs)


def dropped_places(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(r1, r2, places): where each row that loses lines loses them."""
    frequent = stored(frequent_lines(docs, least_docs, least_chars))
    lost = join_counted(exploded(docs, least_chars).select("r1", "r2", "place", "h1", "h2"), frequent, ["h1", "h2"], "n")
    return lost.groupBy("r1", "r2").agg(F.collect_set("place").alias("places"))  # wholly equal rows lose the same places


def drop_frequent_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """docs with `text` put together from the lines that stay, and (n_lines, n_dropped) added or replaced; a null text stays null."""
    added = ("n_lines", "n_dropped")
    rest = [c for c in docs.columns if c not in added]
    other = [c for c in rest if c != "text"]
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = _hashes(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), whole, names=("r1", "r2"))
    rows = docs.select(*names, F.struct(*other).alias("_row"), F.col("text").isNotNull().alias("_has"), whole.alias("_text"))
    met = rows.join(dropped_places(docs.select("doc_id", "text"), least_docs, least_chars), ["r1", "r2"], "left")
    kept = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("places")), lambda i: F.get(lines, i))
    left = F.when(F.col("places").isNull(), F.col("_text")).otherwise(F.array_join(let(F.split("_text", "\n"), kept), "\n"))
    text = F.when(F.col("_has"), left).alias("text")
    n_lines = F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1
    n_dropped = F.when(F.col("places").isNull(), 0).otherwise(F.size("places"))
    return met.select(*[text if c == "text" else F.col(f"_row.{c}").alias(c) for c in rest], n_lines.cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))


def line_digest(docs: DataFrame, least_docs: int = 10, least_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)"""
    kept = drop_frequent_lines(docs.select("doc_id", "text"), least_docs, least_chars)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
