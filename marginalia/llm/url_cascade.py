"""URL filters: a Bloom filter cascade that is exact over the corpus's key universe.

Level 0 holds the listed keys. Keys of the universe that are not listed but pass level 0 go into level 1; listed keys that pass
level 1 go into level 2; and so on until a level lets nothing wrong through. A key is listed if it passes level 0 and isn't
taken back by level 1, unless level 2 restores it, and so on. Since the universe is every key of the corpus, the answer is
exact for every row, with filters of a few bits a key and without joining rows to the list.

Keys are dealt over shards by hash, so that one shard's filters stay small however long the list is; every shard has its own
cascade. Filters of at most BROADCAST_BYTES in all are broadcast, larger ones meet the rows by shard and salt.

Defined results: a null url or one without "://" has an empty host and path, fits no rule and is judged like any other key. Repeated rows get
equal verdicts, urls may have any length, and without rows there is no result. Columns of the rows stay, but for host, path, rule and verdict.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import lower_ascii, settle

BITS_PER_KEY, HASHES, KEYS_PER_SHARD, MOST_LEVELS = 8, 5, 1 << 16, 64
BROADCAST_BYTES, SALTS = 4 << 20, 8


@dataclass(frozen=True)
class Rule:
    """A host, meant with its subdomains, and the beginning of a path: `net/de/`."""

    action: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, start = self.pattern.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column, value: str = "pattern") -> Column:
    """`value` of the longest rule that fits, the first listed of equally long ones; null if none does."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)) if rules else []:
        chosen = F.when(rule.fits(host, path), F.lit(getattr(rule, value))).otherwise(chosen)
    return chosen


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(HASHES)]


def _passes(words: Column, key: Column, level: int, bits: int) -> Column:
    test = F.lit(True)
    for place in _places(key, level, bits):
        test = test & (F.getbit(F.element_at(words, (F.floor(place / 64) + 1).cast("int")), (place % 64).cast("int")) == 1)
    return test


@dataclass
class Cascade:
    """filters: one row for each shard with a column of 64-bit words for each level."""

    filters: DataFrame | None
    bits: list[int]
    shards: int

    @property
    def size_bytes(self) -> int:
        return sum(self.bits) * self.shards // 8

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with a boolean column that says whether the key is listed."""
        if self.filters is None:
            return rows.withColumn(name, F.lit(False))
        filters = self.filters.withColumnRenamed("shard", "_shard")
        keyed = rows.withColumn("_key", key).withColumn("_shard", _shard(F.col("_key"), self.shards))
        if self.size_bytes <= BROADCAST_BYTES:
            keyed = keyed.join(F.broadcast(filters), "_shard")
        else:  # a key that very many rows have is dealt over the salts
            salted = filters.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["_shard", "_salt"])
        listed = F.lit(False)
        for level in reversed(range(len(self.bits))):
            listed = _passes(F.col(f"_level{level}"), F.col("_key"), level, self.bits[level]) & ~listed
        return keyed.withColumn(name, listed).select(*rows.columns, name)


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int")


def _filter_of(spark: SparkSession, keys: DataFrame, level: int, bits: int, shards: int) -> DataFrame:
    """(shard, words): the Bloom filter of each shard's keys, every shard with all its words."""
    n = bits // 64
    ones = keys.select("shard", F.explode(F.array(*_places(F.col("key"), level, bits))).alias("place"))
    ones = ones.select("shard", F.floor(F.col("place") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bits"))
    blank = spark.range(shards * n).select(F.floor(F.col("id") / n).cast("int").alias("shard"), (F.col("id") % n).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = ones.unionByName(blank).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias(f"_level{level}"))


def build_cascade(universe: DataFrame) -> Cascade:
    """universe: distinct rows (key string, listed boolean); every key that will ever be asked about."""
    spark = universe.sparkSession
    n = universe.agg(F.count_if("listed")).first()[0]
    if not n:
        return Cascade(None, [], 1)
    shards = -(-n // KEYS_PER_SHARD)
    keyed = universe.withColumn("shard", _shard(F.col("key"), shards))
    inside, outside = (keyed.filter(c).select("shard", "key") for c in (F.col("listed"), ~F.col("listed")))
    filters, bits = None, []
    for level in range(MOST_LEVELS):
        fullest = inside.groupBy("shard").count().agg(F.max("count")).first()[0]
        if not fullest:
            break
        bits.append(64 * -(-fullest * BITS_PER_KEY // 64))
        made = settle(_filter_of(spark, inside, level, bits[-1], shards))
        small = F.broadcast(made) if bits[-1] * shards // 8 <= BROADCAST_BYTES else made
        wrong = settle(outside.join(small, "shard").filter(_passes(F.col(f"_level{level}"), F.col("key"), level, bits[-1])).select("shard", "key"))
        filters = made if filters is None else filters.join(made, "shard")
        inside, outside = wrong, inside
    else:
        raise RuntimeError("the cascade doesn't end; are keys listed and not listed at once?")
    return Cascade(settle(filters), bits, shards)


def judge_urls(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """pages with host, path, rule and verdict.

    The cascade encodes the keys (host and path) that the rules block against all keys of the table, and its exact answer is
    the verdict: keys that no rule covers are not listed and so allowed. Columns of pages with these names are replaced.
    """
    url = F.col("url")
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*own, host_of(url).alias("host"), path_of(url).alias("path"))
    key = F.concat("host", "path")
    seen = rows.select("host", "path").distinct()
    universe = seen.select(key.alias("key"), F.coalesce(longest_rule(rules, F.col("host"), F.col("path"), "action") == "block", F.lit(False)).alias("listed"))
    cascade = build_cascade(settle(universe))
    marked = cascade.mark(rows.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path"))), key, "_listed")
    return marked.select(*own, "host", "path", "rule", F.when(F.col("_listed"), "block").otherwise("allow").alias("verdict"))
