"""A Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources' roots, and a proof for each document.

Superblock reduction: the leaves of a source are numbered, and fanout^levels consecutive ones make a bucket. One call for each bucket collapses all its levels at once,
giving its root and the siblings of each of its leaves; bucket roots are reduced in the same way, until each tree has one node. A leaf's proof is what its bucket has
below and what its bucket's root has above.

A bucket has at most fanout^levels rows, whatever the size of its source. Leaves are numbered by ranges of (source, order), so a source may hold any share of all rows, and
no task holds more than a range or a bucket. Only the one root and the number of sources reach the driver.

Nulls: a null field is `-`; a null source is a source, the first one; rows without doc_id come first in their source, and count as an empty id where tampering is
decided; a null text isn't tampered with. Rows that share a doc_id are ordered by their leaf; wholly equal rows stand next to one another in any order, which changes
no digest of the tree. Texts are hashed whole. An empty table gives an empty one. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import broadcast_if_small, remainder_of, stored

FANOUT = 3
#: Levels that one call collapses: a bucket has 3^7 = 2187 leaves.
LEVELS = 7
#: A row a source; up to so many are broadcast.
BROADCAST_SOURCES = 50_000
DIGEST_BYTES = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGESTS = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, place long"


# --- plain trees, inside a bucket or along one proof ---------------------------------------------------------------------------------


def parent(run: list[bytes]) -> bytes:
    """The digest over the hexadecimal texts of consecutive digests."""
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(nodes: list[bytes], levels: int, fanout: int = FANOUT) -> tuple[bytes, list[bytes]]:
    """(root, siblings of each node from bottom to top, left to right, one after the other) of consecutive nodes that start a run at each level."""
    proofs, at = [b""] * len(nodes), nodes
    for level in range(levels):
        runs = [at[i : i + fanout] for i in range(0, len(at), fanout)]
        others = [b"".join(run[:j] + run[j + 1 :]) for run in runs for j in range(len(run))]
        width = fanout**level
        proofs = [p + others[i // width] for i, p in enumerate(proofs)]
        at = [parent(run) for run in runs]
    if len(at) != 1:
        raise ValueError(f"{levels} levels leave {len(at)} of {len(nodes)} nodes")
    return at[0], proofs


def fold(digest: bytes, place: int, n: int, proof: bytes, fanout: int = FANOUT) -> tuple[bytes, bytes]:
    """(root, what is left of the proof) for the digest at a place among n."""
    at = 0
    while n > 1:
        first = place - place % fanout
        size = min(fanout, n - first)
        run = [proof[at + i * DIGEST_BYTES : at + (i + 1) * DIGEST_BYTES] for i in range(size - 1)]
        at += (size - 1) * DIGEST_BYTES
        run.insert(place - first, digest)
        digest, place, n = parent(run), place // fanout, -(-n // fanout)
    return digest, proof[at:]


# --- leaves --------------------------------------------------------------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): tampered is the digest of the row without line feeds in its text, null where that is the row as it was."""
    fields = [F.col(c) for c in FIELDS]
    bad = (remainder_of(F.col("doc_id"), 2) == 0) & F.col("text").contains("\n")
    changed = F.when(bad, leaf_digest([*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))]))
    return docs.select("doc_id", "source", leaf_digest(fields).alias("leaf"), changed.alias("tampered"))


# --- places --------------------------------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, group: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """rows, to which are added `place`, from 0 inside their group, and `n`, the size of the group; and (group, n), one row each.

    Sorted by ranges of (group, order); a table with a row for each group that a range holds tells what lies before it. rows must be stored; their place in
    the files is the last of the order, so that equal rows don't have to share a range.
    """
    order = [*order, F.col("_tie")]
    key = F.struct(F.col(group).isNotNull(), F.col(group), *order)
    ranged = stored(rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    all_of = W.partitionBy(group)
    before = F.coalesce(F.sum("_size").over(all_of.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_part"), before.alias("_before"), F.sum("_size").over(all_of).alias("n"))
    local = F.row_number().over(W.partitionBy(group, "_range").orderBy(*order)) - 1
    joined = ranged.withColumn("_local", local).join(sizes, (F.col("_range") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    groups = sizes.filter("_before = 0").select(F.col("_group").alias(group), "n")  # the first range of each
    return joined.select(*rows.columns, (F.col("_before") + F.col("_local")).alias("place"), "n"), groups


# --- superblocks ---------------------------------------------------------------------------------------------------------------------


def superblocks(nodes: DataFrame, most: int, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes: stored, (tree, place, n, digest) and further columns; most: the largest n. Returns

    - nodes without digest, with `proof`, the siblings up to the root of the bucket,
    - (tree, bucket, above, root): for each bucket the siblings from its root up to the root of the tree.
    """
    width = fanout**levels
    carried = [c for c in nodes.columns if c not in ("tree", "place", "n", "digest")]
    kinds = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in carried)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        root, proofs = collapse([bytes(d) for d in frame["digest"]], min(levels, height(int(frame["n"].iloc[0]), fanout)), fanout)
        out = frame[["tree", "place", "n", "bucket", *carried]].copy()
        out["proof"], out["root"] = proofs, [root] + [None] * (len(frame) - 1)
        return out

    bucketed = nodes.withColumn("bucket", F.expr(f"place div {width}"))
    shape = "tree long, place long, n long, bucket long, " + (f"{kinds}, " if kinds else "") + "proof binary, root binary"
    made = stored(bucketed.groupBy("tree", "bucket").applyInPandas(run, shape))
    roots = made.filter("root is not null")
    below = made.drop("root")
    if most <= width:
        return below, roots.select("tree", "bucket", F.lit(b"").alias("above"), "root")
    upper = roots.select("tree", F.col("bucket").alias("place"), F.expr(f"(n + {width - 1}) div {width}").alias("n"), F.col("root").alias("digest"))
    lower, higher = superblocks(upper, -(-most // width), fanout, levels)
    met = lower.join(higher.withColumnRenamed("tree", "_tree").withColumnRenamed("bucket", "_bucket"), (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.col("_bucket")))
    return below, met.select("tree", F.col("place").alias("bucket"), F.concat("proof", "above").alias("above"), "root")


# --- the manifest --------------------------------------------------------------------------------------------------------------------


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, place): digests as lower-case hexadecimal text."""
    spark = docs.sparkSession
    id_type, source_type = (docs.schema[c].dataType for c in ("doc_id", "source"))
    rows = stored(leaves(docs))
    ordered, sources = placed(rows, "source", [F.col("doc_id"), F.col("leaf")])

    # sources are numbered by their order, which is the place of their subroot in the upper tree
    named = stored(sources.withColumn("_all", F.lit(True)))
    trees, _ = placed(named.withColumnRenamed("n", "n_docs"), "_all", [F.col("source").isNotNull(), F.col("source")])
    trees = stored(trees.select("source", F.col("place").alias("tree"), "n_docs"))
    n_trees, most = (int(x or 0) for x in trees.agg(F.count(F.lit(1)), F.max("n_docs")).first())
    if not n_trees:
        return spark.createDataFrame([], f"doc_id {id_type.simpleString()}, source {source_type.simpleString()}, {DIGESTS}")

    numbers = trees.select(F.col("source").alias("_source"), "tree")
    nodes = stored(_with_tree(ordered, numbers).select("tree", "place", "n", F.col("leaf").alias("digest"), F.col("doc_id").cast("string").alias("doc_id"), "source", "leaf", "tampered"))  # pandas has no whole numbers with nulls
    below, above = superblocks(nodes, most, fanout, levels)
    subroots = stored(above.filter("bucket = 0").select("tree", F.col("root").alias("subroot")))
    tops = stored(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(n_trees).cast("long").alias("n"), F.col("subroot").alias("digest")))
    top_below, top_above = superblocks(tops, n_trees, fanout, levels)
    top = top_below.join(top_above.select(F.col("bucket").alias("_bucket"), F.col("above").alias("_above")), F.col("bucket") == F.col("_bucket"))
    root = bytes(top_above.select("root").first()["root"])
    top = stored(top.select(F.col("place").alias("tree"), F.concat("proof", "_above").alias("top")).join(subroots, "tree"))

    # bucket by bucket: what lies above it in its own tree, and above that tree's root
    upper = above.select("tree", "bucket", "above").join(broadcast_if_small(top, BROADCAST_SOURCES), "tree").select(F.col("tree").alias("_tree"), F.col("bucket").alias("_bucket"), F.concat("above", "top").alias("above"), "subroot")
    whole = below.join(upper, (F.col("tree") == F.col("_tree")) & (F.col("bucket") == F.col("_bucket")))
    whole = whole.select("doc_id", "source", "leaf", "tampered", "subroot", "tree", "place", "n", F.concat("proof", "above").alias("proof"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests, folded = [], []
            for leaf, tampered, tree, place, n, proof in zip(frame["leaf"], frame["tampered"], frame["tree"], frame["place"], frame["n"], frame["proof"], strict=True):
                digests.append(hashlib.sha256(proof.hex().encode()).hexdigest())
                found, rest = fold(bytes(tampered if tampered is not None else leaf), int(place), int(n), bytes(proof), fanout)
                found, rest = fold(found, int(tree), n_trees, rest, fanout)
                if rest:
                    raise ValueError("a proof has more siblings than its tree has places")
                folded.append(found)
            out = frame[["doc_id", "source"]].copy()
            out["leaf"], out["subroot"], out["root"] = [x.hex() for x in frame["leaf"]], [x.hex() for x in frame["subroot"]], root.hex()
            out["proof_sha256"], out["folded_root"], out["verified"] = digests, [x.hex() for x in folded], [x == root for x in folded]
            out["place"] = frame["place"]
            yield out

    made = whole.mapInPandas(verify, f"doc_id string, source string, {DIGESTS}")
    return made.withColumn("doc_id", F.col("doc_id").cast(id_type)).withColumn("source", F.col("source").cast(source_type))


def _with_tree(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The number of each row's source. A few sources are broadcast; many are joined in a shuffle that splits its skewed parts."""
    return rows.join(broadcast_if_small(numbers, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
