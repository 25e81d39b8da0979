
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEEDED = ("item_id", "index", "is_decorative", "description")


def _kind(v: Column, name: str) -> Column:
    """The JSON type of a field: BIGINT for whole numbers, so true is none; null where the field is missing."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))


def parsed_judgments(raw: DataFrame, batch_size: int | None = None, needed: tuple[str, ...] = NEEDED) -> DataFrame:
    """(pos, item_id, index, is_decorative, description, errors): every judgment with all that is wrong with it (V5); good ones have no errors.

    raw: (pos, raw), the JSON text of one judgment and its place. batch_size: where given, the index must lie below. The first good judgment of an address counts, others are
    duplicates. A field of the wrong type is null in the result; numbers with a fraction or beyond 64 bits are no whole numbers.
    """
    v = F.try_parse_json("raw")
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    wanted = F.array(*[F.lit(n) for n in needed])
    kind = {n: _kind(v, n) for n in needed}
    here = {n: F.array_contains(keys, n) for n in needed}
    index = F.when(kind["index"] == "BIGINT", F.try_variant_get(v, "$.index", "bigint"))
    listed = lambda names: F.array_join(F.array_sort(names), ", ")
    missing, more = F.array_except(wanted, keys), F.array_except(keys, wanted)
    wrong = lambda name, want: F.when(here[name] & ~F.coalesce(kind[name] == want, F.lit(False)), F.concat(F.lit(f"{name} must be "), F.lit({"BIGINT": "a whole number", "BOOLEAN": "true or false", "STRING": "a text"}[want])))
    outside = F.when(index < 0, "index is negative") if batch_size is None else F.when((index < 0) | (index >= batch_size), f"index is not below {batch_size}")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    found = [
        F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), listed(missing))), F.when(F.size(more) > 0, F.concat(F.lit("unexpected keys: "), listed(more))),
        wrong("index", "BIGINT"), outside, wrong("is_decorative", "BOOLEAN"), wrong("description", "STRING"),
    ]
    errors = F.when(is_object, F.array_compact(F.array(*found))).otherwise(F.array(F.lit("not a JSON object")))
    address = F.when(kind["item_id"] == "STRING", F.try_variant_get(v, "$.item_id", "string")).otherwise(F.to_json(F.try_variant_get(v, "$.item_id", "variant"))) if "item_id" in needed else F.lit(None).cast("string")
    rows = raw.select(
        "pos", address.alias("item_id"), index.alias("index"), F.when(kind["is_decorative"] == "BOOLEAN", F.try_variant_get(v, "$.is_decorative", "boolean")).alias("is_decorative"),
        F.when(kind["description"] == "STRING", F.try_variant_get(v, "$.description", "string")).alias("description"), errors.alias("errors"),
    )
    first = rows.filter(F.size("errors") == 0).groupBy(F.coalesce("item_id", F.lit("")).alias("_item"), F.col("index").alias("_index")).agg(F.min("pos").alias("_first"))
    met = rows.join(first, (F.coalesce("item_id", F.lit("")) == F.col("_item")) & (F.col("index") == F.col("_index")) & (F.size("errors") == 0), "left")
    twice = F.when(F.col("pos") > F.col("_first"), F.array(F.lit("duplicate judgment for this address"))).otherwise(F.array().cast("array<string>"))
    return met.select(*[c for c in rows.columns if c != "errors"], F.concat("errors", twice).alias("errors"))


def parsed_replies(replies: DataFrame, batch_size: int) -> DataFrame:
    """(reply, judgments, error): a model's reply as the judgments of a batch, or why all of it is refused (V5): it must be a JSON list, in a fence or not, of good judgments with different
    indices. replies: (reply, text). Judgments are (index, is_decorative, description), by their place."""
    bare = F.trim(F.regexp_replace(F.trim("text"), r"^```[^\n]*\n|```$", ""))
    listed = F.try_parse_json(bare)
    entries = F.try_variant_get(listed, "$", "array<variant>")
    rows = replies.select("reply", bare.alias("bare"), F.coalesce(F.schema_of_variant(listed).startswith("ARRAY"), F.lit(False)).alias("is_list"), F.transform(entries, lambda e: F.to_json(e)).alias("entries"))
    each = rows.filter("is_list").select("reply", F.posexplode("entries").alias("pos", "raw"))
    checked = parsed_judgments(each.select(F.struct("reply", "pos").alias("pos"), "raw"), batch_size, NEEDED[1:])
    # an index is unique inside its own reply
    first = F.struct("pos.pos", F.struct("index", "is_decorative", "description").alias("j"), F.filter("errors", lambda e: ~e.startswith("duplicate") & ~e.startswith("unexpected")).alias("errors"))
    grouped = checked.groupBy("pos.reply").agg(F.array_sort(F.collect_list(first)).alias("all"))  # the judgments of one batch
    joined = rows.join(grouped, "reply", "left")
    bad = F.try_element_at(F.flatten(F.transform("all", lambda x: x["errors"])), F.lit(1))
    indices = F.transform("all", lambda x: x["j"]["index"])
    error = F.when(~F.col("is_list"), "not a JSON list").when(bad.isNotNull(), bad).when(F.size(F.array_distinct(indices)) < F.size(indices), "duplicate index")
    good = F.when(error.isNull(), F.coalesce(F.transform("all", lambda x: x["j"]), F.array()))
    return joined.select("reply", good.alias("judgments"), error.alias("error"))
