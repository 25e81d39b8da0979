"""Each stage of the pipeline against a plain version, on a corpus with everything in it."""

from __future__ import annotations

import collections
import zlib

import numpy as np
import pytest

from marginalia.llm import packing, toxicity
from marginalia.llm.mixing import mix
from tests.llm.fixtures import corpus, text
from tests.llm.test_dedup import brute_components

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def run_of_stages(spark, tmp_path_factory):
    """The tables between the stages."""
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in corpus() if d != 70 or t]
    rows += [(1000 + i, text(5000 + i, 40) + (" horrid nastyword" if i % 4 == 0 else ""), "en", "abc"[i % 3], 0) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    tables = [spark.read.parquet(f"{folder}/documents.parquet")]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{folder}/{i}")
        tables.append(spark.read.parquet(f"{folder}/{i}"))
    return folder, tables


def key(r):
    return (r["doc_id"], r["text"])


def test_toxic_documents_go_and_clean_ones_stay(spark, run_of_stages):
    folder, (documents, after, *_) = run_of_stages
    model = toxicity.fit(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    expected = collections.Counter(key(r) for r in documents.collect() if model.logit(r["text"] or "") < 0)
    assert collections.Counter(map(key, after.collect())) == expected and after.columns == documents.columns
    kept = {r["doc_id"] for r in after.collect()}
    assert not [i for i in range(120) if i % 4 == 0 and 1000 + i in kept] and all(1000 + i in kept for i in range(120) if i % 4)


def test_one_document_of_each_group_stays(run_of_stages):
    before, after = (t.collect() for t in run_of_stages[1][1:3])
    named = brute_components([key(r) for r in before])
    expected = {d for d, _, c, _ in named if d == c}
    assert {r["doc_id"] for r in after} == expected


def test_repeated_passages_go(run_of_stages):
    before, after = (t.collect() for t in run_of_stages[1][2:4])
    first: dict[bytes, int] = {}
    for r in before:
        raw = (r["text"] or "").encode()
        for i in range(len(raw) - 49):
            first[raw[i : i + 50]] = min(r["doc_id"] if r["doc_id"] is not None else 1 << 62, first.get(raw[i : i + 50], 1 << 62))
    expected = collections.Counter()
    for r in before:
        raw = (r["text"] or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if r["doc_id"] is not None and first[raw[i : i + 50]] < r["doc_id"]:
                gone[i : i + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left:
            expected[(r["doc_id"], left, len(left))] += 1
    assert collections.Counter((*key(r), r["n_chars"]) for r in after) == expected


def test_the_mix_takes_effect(run_of_stages):
    before, after = run_of_stages[1][3:5]
    copies: collections.Counter = collections.Counter()
    for r in mix(before).collect():
        copies[r["doc_id"]] = max(copies[r["doc_id"]], r["copies"])
    expected: collections.Counter = collections.Counter()
    for r in before.collect():
        expected[key(r)] += copies[r["doc_id"]]
    expected = +expected
    assert collections.Counter(map(key, after.collect())) == expected and after.columns == before.columns


def test_everything_left_is_packed(run_of_stages):
    from tokenizers import Tokenizer

    before, after = run_of_stages[1][4:6]
    tokenizer, expected = Tokenizer.from_file(packing.default_tokenizer()), collections.Counter()
    for r in before.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            expected[(r["doc_id"], k, at, zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["ids_crc32"]) for r in after.collect()) == expected


def test_run_is_the_stages(spark, run_of_stages):
    folder, tables = run_of_stages
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert collections.Counter(tuple(r[c] for c in columns) for r in pipeline.run(spark, folder).collect()) == collections.Counter(tuple(r[c] for c in columns) for r in tables[-1].collect())


@pytest.mark.parametrize("rows", [0, 12])
def test_the_whole_run_of_empty_tables_and_of_extra_columns(spark, tmp_path, rows):
    from tests.llm.fixtures import documents

    data = [(i, (None, "", text(i, 30))[i % 3], (None, "a")[i % 2]) for i in range(rows)]
    documents(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert (out.count() > 0) == (rows > 0)
