"""Document fingerprints: Order MinHash, a sketch that follows edit distance.

The k-mers of a text are numbered by occurrence, so that every (k-mer, number) is distinct. One hash deals them over BINS bins; in
each bin the PICKED smallest are selected, put back in text order, and the tuple is hashed. (One permutation cut into bins
stands for BINS independent permutations: same selection rule, one pass; the tests measure both against one another.) Two texts share a bin's value if
they share its minimal k-mers in the same order, so moved passages count as changes, unlike in a plain MinHash.

A k-mer is CHAR_K code points in every text, so that texts of any two sizes and scripts can be compared. A place has PLACE_BITS bits, as many
as the longest text can need, and the rest of 64 are the hash of the k-mer. Bins are compared by VALUE_BITS bits, so two different tuples agree by chance in one of
2^VALUE_BITS bins.

Defined results: a null text is empty; an empty text has an empty fingerprint, and two of them have likeness 1. Rows of equal doc_id follow one another in order
of their text, rows without one come first, in order of a hash. Ids may be any long, spread in any way; rows that share one id are sorted by one task.
Other columns are left out; without rows there is no result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import broadcast_if_small, let, settle

BINS_LOG2, PICKED, CHAR_K = 6, 2, 4
PLACE_BITS = 31
PLACE_MASK = (1 << PLACE_BITS) - 1
VALUE_BITS = 24
#: K-mers of a bin that are sorted of a long text.
LIKELY = 12
#: Documents in one range of neighbours, quantiles of ids that cut ranges, ranges in one group of ranges, first documents that may be broadcast, ranges of rows without id.
RANGE_ROWS, QUANTILES, GROUP, BROADCAST_ROWS, NULL_RANGES = 256, 4096, 4096, 500_000, 64


def _places(b: Column, first: Column) -> Column:
    """Places of the k-mers that start at a code point from `first` on; a place is the 1-based byte it starts at, four bytes a code point."""
    start, last = first * 4 + 1, (F.octet_length(b) - 4 * CHAR_K + 1).cast("int")
    return F.when(start <= last, F.sequence(start, last, F.lit(4))).otherwise(F.array().cast("array<int>"))


def _packed(text: Column, first: Column, shift: Column | None = None) -> Column:
    """(k-mer hash | place, moved on by `shift`) of every CHAR_K code points in a row, from the code point `first` on; of all of them where there are fewer."""

    def of_bytes(b: Column) -> Column:  # a k-mer is cut out of the bytes without a search
        kmer = lambda at: F.xxhash64(F.substring(b, at, F.lit(4 * CHAR_K))).bitwiseAND(F.lit(~PLACE_MASK))
        place = lambda at: (at if shift is None else at + shift).cast("long")
        lone = F.when(F.octet_length(b) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(b).bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(place(F.lit(1)))))
        return F.when(F.octet_length(b) < 4 * CHAR_K, lone).otherwise(F.transform(_places(b, first), lambda at: kmer(at).bitwiseOR(place(at))))

    return let(F.encode(text, "UTF-32"), of_bytes)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BINS_LOG2)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit(PLACE_MASK))


def _occurrences(s: Column, shared: Column, own: Column) -> Column:
    """Occurrence numbers from 0 of sorted (k-mer hash | place) of two texts: places up to `shared` are in both, up to `own` in the first, the others in the second.

    A k-mer's occurrences in the second text go on from those in the shared part, as those in the rest of the first do.
    """

    def starts_after_first(before: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(before, i) < F.get(s, i).bitwiseAND(F.lit(~PLACE_MASK)))

    def of_run(start: Column, end: Column) -> Column:
        at = lambda i: _place(F.get(s, i))
        upto = lambda most, stop: F.size(F.filter(F.sequence(start, stop), lambda i: at(i) <= most))
        whole = F.sequence(F.lit(0), end - start - 1)

        def split(first: Column) -> Column:  # `first` occurrences in the first text, at least one, and at least one in the second alone
            both = F.when(at(start) > shared, F.lit(0)).otherwise(upto(shared, start + first - 1))
            rest = lambda n: F.concat(F.sequence(F.lit(0), first - 1), F.sequence(n, n + (end - start - first) - 1))
            return F.when(at(start + first - 1) <= shared, whole).otherwise(let(both, rest))

        of_one = (at(end - 1) <= own) | (at(start) > own)
        return F.when(end - start == 1, F.array(F.lit(0))).when(of_one, whole).otherwise(let(upto(own, end - 1), split))

    starts = F.concat(F.array(F.lit(0)), let(F.concat(F.slice(s, 1, 1), s), starts_after_first))
    return F.flatten(let(starts, lambda a: F.zip_with(a, F.concat(F.slice(a, F.lit(2), F.size(a)), F.array(F.size(s))), of_run)))


def _tuples(picked: Column) -> Column:
    """One value for each bin that has k-mers: bin number | hash of its k-mers in text order."""

    def value(p: Column, i: Column) -> Column:
        x, y = F.get(p, i), F.get(p, i + 1)
        a, b = F.shiftright(x, PLACE_BITS), F.shiftright(y, PLACE_BITS)
        both = y.isNotNull() & (_bin(x) == _bin(y))
        ordered = F.when(_place(x) <= _place(y), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        h = F.when(both, ordered).otherwise(F.xxhash64(a))
        return (F.shiftleft(_bin(x), VALUE_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << VALUE_BITS) - 1)))).cast("int")

    firsts = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (_bin(F.get(p, i)) != _bin(F.get(p, F.greatest(i - 1, F.lit(0))))))
    return let(picked, lambda p: F.when(F.size(p) == 0, F.array().cast("array<int>")).otherwise(F.transform(firsts(p), lambda i: value(p, i))))


def sketches(ordered: Column, shared: Column, own: Column) -> Column:
    """(values, edited_values): the bins' values of two texts as arrays of int in order of bins, from their sorted (k-mer hash | place), those of their common start given once.

    Places up to `shared` are in both texts, up to `own` in the first, the others in the second.

    Of long texts only the numbered k-mers whose place inside their bin is below a share that leaves at least about LIKELY of them a bin and text are sorted. If these
    fill every bin of both, the smallest are among them; if not, all are sorted.
    """
    inside = (1 << (64 - BINS_LOG2)) - 1
    full = PICKED << BINS_LOG2
    smallest = lambda t: F.filter(t, lambda x, i: F.coalesce(_bin(x.bitwiseXOR(F.get(t, i - PICKED))) != 0, F.lit(True)))

    def picked(m: Column) -> Column:
        first = lambda t: let(F.filter(t, lambda x: _place(x) <= own), smallest)
        second = lambda t: let(F.filter(t, lambda x: (_place(x) <= shared) | (_place(x) > own)), smallest)
        return let(F.sort_array(m), lambda t: F.struct(first(t).alias("values"), second(t).alias("edited_values")))

    def of_numbered(s: Column, numbers: Column) -> Column:
        hashed = lambda i: F.xxhash64(F.shiftright(F.get(s, i), PLACE_BITS), F.get(numbers, i))
        mixed = lambda i: hashed(i).bitwiseAND(F.lit(~PLACE_MASK)).bitwiseOR(_place(F.get(s, i)))
        every = F.sequence(F.lit(0), F.size(s) - 1)
        # texts of one length have 2/3 of the k-mers each; an edited text that is shorter keeps the shared half, with 9 likely k-mers a bin
        limit = F.floor(F.lit(float(inside)) * (LIKELY << BINS_LOG2) * 1.5 / F.size(s)).cast("long")
        likely = let(limit, lambda most: F.filter(every, lambda i: hashed(i).bitwiseAND(F.lit(inside)) < most))
        filled = lambda p: (F.size(p["values"]) == full) & (F.size(p["edited_values"]) == full)
        few = lambda: let(picked(F.transform(likely, mixed)), lambda p: F.when(filled(p), p).otherwise(picked(F.transform(every, mixed))))
        chosen = F.when(F.size(s) > LIKELY * 1.5 * (1 << BINS_LOG2), few()).otherwise(picked(F.transform(every, mixed)))
        return let(chosen, lambda p: F.struct(_tuples(p["values"]).alias("values"), _tuples(p["edited_values"]).alias("edited_values")))

    none = F.array().cast("array<int>")

    def of_sorted(s: Column) -> Column:
        return let(_occurrences(s, shared, own), lambda numbers: of_numbered(s, numbers))

    # two references to the sorted array keep its sort a step of its own, in compiled code
    return F.when(F.size(ordered) == 0, F.struct(none.alias("values"), none.alias("edited_values"))).otherwise(let(ordered, of_sorted))


def with_sketches(rows: DataFrame) -> DataFrame:
    """rows (text, next_text) with values and edited_values, the sketches of the text and of its edited text, and edited_sha256.

    The k-mers of the text's first half are hashed, sorted and numbered once for both; places of those that reach into the other text follow all of the text's own.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    shared = F.greatest(n - half - (CHAR_K - 1), F.lit(0))
    rows = rows.withColumn("_shared", shared).withColumn("_own", n * 4).withColumn("_edited", edited)
    both = F.concat(_packed(F.col("text"), F.lit(0)), _packed(F.col("_edited"), F.col("_shared"), F.col("_own")))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)).withColumn("_sorted", F.sort_array(both))
    rows = rows.withColumn("_sketches", sketches(F.col("_sorted"), F.col("_shared") * 4, F.col("_own")))
    return rows.select("*", "_sketches.*").drop("_shared", "_own", "_edited", "_sorted", "_sketches")


def as_string(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that have k-mers in either text."""
    bins = lambda v: F.transform(v, lambda x: F.shiftright(x, VALUE_BITS))
    n = F.size(F.array_union(bins(a), bins(b)))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def _cut_points(ids: DataFrame, n: int) -> list[int]:
    """Ascending quantiles of the ids, at most QUANTILES."""
    parts = min(QUANTILES, -(-n // RANGE_ROWS))
    if parts < 2:
        return []
    return sorted(set(ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * QUANTILES)).first()[0]))


def _range_of(key: Column, cuts: list[int], lowest: int, highest: int, n: int) -> Column:
    """How many quantiles are at most the key, and which of the equal widths that the space between two of them is cut into."""
    step = max(1, int(len(cuts) ** 0.5))
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    if not cuts:
        return F.lit(0).cast("long")
    heads, every = longs(cuts[::step]), longs(cuts)
    upto = lambda values: F.size(F.filter(values, lambda c: c <= key))
    group = upto(heads) - 1
    quantile = F.when(group < 0, F.lit(0)).otherwise(group * step + upto(F.slice(every, group * step + 1, F.lit(step))))
    pieces = -(-n // (RANGE_ROWS * (len(cuts) + 1)))
    if pieces == 1:
        return quantile.cast("long")
    wide = lambda x: x.cast("decimal(20,0)")
    low, high = (F.get(longs(x), quantile) for x in ([lowest, *cuts], [*cuts, highest]))
    inside = F.floor((wide(key) - wide(low)) * F.lit(pieces) / F.greatest(wide(high) - wide(low), F.lit(1).cast("decimal(20,0)")))
    return quantile.cast("long") * pieces + F.greatest(F.least(inside.cast("long"), F.lit(pieces - 1)), F.lit(0))


def with_next(rows: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame] | None = None, derived: Sequence[str] = ()) -> DataFrame:
    """rows (doc_id, text and columns) with next_<column>: the values of the next greater doc_id, after the last those of the first.

    derive: adds columns to rows that have their neighbours; for those named in `derived` there is next_<column> too, without another shuffle.

    Ids are cut into ranges of about RANGE_ROWS, by quantiles and equal widths between these; within a range a window looks ahead, and each range also
    gets a copy of the first document of the range that follows.
    """
    lowest, highest, n, nulls = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    cuts = _cut_points(rows.select("doc_id"), n)
    key, place = F.col("doc_id"), _range_of(F.col("doc_id"), cuts, lowest or 0, highest or 0, n)
    if nulls:
        h = F.xxhash64("text")
        key, place = F.coalesce(key, h), F.when(F.col("doc_id").isNull(), F.shiftrightunsigned(h, 58) % NULL_RANGES - NULL_RANGES).otherwise(place)
    ranges = settle(rows.select(key.alias("key"), place.alias("range")).groupBy("range").agg(F.min("key").alias("first")))
    groups = ranges.groupBy(F.floor(F.col("range") / GROUP).alias("group")).agg(F.min("range").alias("start"))
    after = groups.select("group", F.lead("start").over(W.orderBy("group")).alias("following"))
    inside = W.partitionBy("group").orderBy("range")
    ordered = ranges.withColumn("group", F.floor(F.col("range") / GROUP)).join(after, "group")
    ends = ordered.select("range", F.coalesce(F.lead("range").over(inside), F.col("following")).alias("to"))
    bottom = ranges.agg(F.min("range")).first()[0]
    links = ranges.alias("r").join(ends.select(F.col("range").alias("before"), F.coalesce("to", F.lit(bottom)).alias("target")).alias("e"), F.col("r.range") == F.col("e.target"))
    links = broadcast_if_small(settle(links.select(F.col("r.range").alias("_at"), F.col("r.first").alias("_first"), F.col("e.before").alias("_before"))), BROADCAST_ROWS)
    keyed = rows.withColumn("_key", key).withColumn("_range", place)
    joined = keyed.join(links, (F.col("_key") == F.col("_first")) & (F.col("_range") == F.col("_at")), "left")
    here, copy = F.struct(F.col("_range").alias("at"), F.lit(False).alias("copy")), F.struct(F.col("_before").alias("at"), F.lit(True).alias("copy"))
    dealt = joined.select(*rows.columns, "_key", F.inline(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, copy))).alias("_at", "_copy"))
    window = W.partitionBy("_at").orderBy("_copy", "_key", "text")
    ahead = dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    if derive is not None:
        made = derive(ahead)
        ahead = made.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in derived])
    return ahead.filter(~F.col("_copy")).drop("_copy", "_key", "_at")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, edited_fingerprint, edited_sha256, near_edited, near_next for every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    edited = with_next(rows, ["text"], with_sketches, ["values"])
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "edited_sha256",
        as_string(F.col("values")).alias("fingerprint"),
        as_string(F.col("edited_values")).alias("edited_fingerprint"),
        likeness(F.col("values"), F.col("edited_values")).alias("near_edited"),
        likeness(F.col("values"), F.col("next_values")).alias("near_next"),
    )
