"""Line deduplication, the Merkle manifest and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import merkle, pq_codes, skew
from marginalia.llm.line_dedup import drop_frequent_lines, line_digest
from marginalia.llm.merkle import manifest
from marginalia.llm.pq_codes import PartTree, encode
from tests.llm.fixtures import collected, corpus, documents, text

BLANKS = " \t\n\x0b\x0c\r"
UP = {c: c + 32 for c in range(65, 91)}


# --- lines ---------------------------------------------------------------------------------------------------------------------------


def lined():
    """Frequent lines in other cases and with blanks, one in nine documents only, one often in a single document, repeated rows, texts without an id."""
    rows = [(500 + i, f"own {i}\n  Shared LINE\t\n\n{'Nine' if i < 9 else 'ten'}\nend {i}\r", "s") for i in range(14)]
    rows += [(100, "often\n" * 40, "s"), (101, "shared line", "s"), (102, "shared line\nshared line\n", None), (103, "Été\nÀ B", "s"), (103, "Été\nÀ B", "s")]
    rows += [(200 + i, f"ÀÉ Z\n{i}\n\n", "s") for i in range(10)] + [(300 + i, "àé z", "s") for i in range(3)]
    rows += [(None, "ten\nno id", "s"), (None, "ten\nno id", "s"), (None, None, None), (400, "\n\n", "s"), (401, "", "s"), (402, text(1, 5000).replace(" ", "\n") + "\nten", "s")]
    return rows + corpus()


def brute_lines(rows, least=10):
    key = lambda line: line.strip(BLANKS).translate(UP)
    seen = defaultdict(set)
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(d if d is not None else t)
    gone = {k for k, docs in seen.items() if len(k) >= 1 and len(docs) >= least}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = ("doc_id", "n_lines", "n_dropped", "kept_sha256")


def test_line_dedup_matches_brute_force(spark):
    found = collected(line_digest(documents(spark, lined())), *LINES)
    assert found == brute_lines(lined()) and any(r[2] for r in found)


def test_line_dedup_without_a_broadcast_of_all_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    assert collected(line_digest(documents(spark, lined())), *LINES) == brute_lines(lined())


def test_line_dedup_keeps_columns_and_null_texts(spark):
    docs = documents(spark, lined()).withColumn("n_lines", F.lit("old"))
    out = drop_frequent_lines(docs)
    assert set(out.columns) == {*docs.columns, "n_dropped"} and dict(out.dtypes)["n_lines"] == "bigint"
    rows = {r["doc_id"]: r for r in out.filter("doc_id is not null").collect()}
    assert rows[500]["text"] == "own 0\n\nNine\nend 0\r" and rows[401]["text"] == "" and out.filter("text is null").count() == documents(spark, lined()).filter("text is null").count()


def test_line_dedup_of_an_empty_table(spark):
    assert line_digest(documents(spark, [])).collect() == []


def test_line_dedup_stays_native(spark):
    plan = line_digest(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


# --- manifest ------------------------------------------------------------------------------------------------------------------------


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def tree(digests):
    """(root, siblings of each)"""
    at, place, sib = digests, list(range(len(digests))), [[] for _ in digests]
    while len(at) > 1:
        runs = [at[i : i + 3] for i in range(0, len(at), 3)]
        for j, p in enumerate(place):
            run = runs[p // 3]
            sib[j] += run[: p % 3] + run[p % 3 + 1 :]
            place[j] = p // 3
        at = [sha("".join(r)) for r in runs]
    return at[0], sib


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: sha("".join(map(field, r)))
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, parts = [], []
    for s in sources:
        ordered = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, sib = tree([leaf(r) for r in ordered])
        subs.append(sub)
        parts.append((ordered, sib))
    root, tops = tree(subs)
    out = []
    for (ordered, sib), top, sub in zip(parts, tops, subs, strict=True):
        for r, own in zip(ordered, sib, strict=True):
            bad = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0 and r[4] is not None and "\n" in r[4]
            out.append((r[0], leaf(r), sub, root, sha("".join(own + top)), not bad))
    return sorted(out, key=repr)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified")


def manifest_rows():
    rows = [(d, s, "en" if i % 2 else None, None if t is None else len(t), t) for i, (d, t, s) in enumerate(corpus())]
    rows += [(1000 + i, "hot", "de", i, f"a\nb {i}") for i in range(100)]
    return rows + [(5000 + i, f"one {i}", "fr", 1, "x\ny") for i in range(12)] + [(2**60 + 1, "é", "fr", 3, "\n"), (2**60 + 2, "z", None, None, "big")]


def as_table(spark, rows):
    from tests.llm.fixtures import EXTRA

    extra = ", ".join(f"{c.split()[0]}" for c in EXTRA.split(", "))
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    return frame.withColumns({c: F.lit("noise") for c in [*extra.split(", "), "tree", "place", "digest", "bucket", "proof", "leaf"]})


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_matches_brute_force_whatever_the_size_of_buckets(spark, levels):
    rows = manifest_rows()
    found = manifest(as_table(spark, rows), levels=levels)
    assert collected(found, *MANIFEST) == brute_manifest(rows)
    for r in found.collect():
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_manifest_joins_many_sources_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_SOURCES", 0)
    rows = manifest_rows()
    assert collected(manifest(as_table(spark, rows), levels=2), *MANIFEST) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(spark):
    one = [(7, None, None, None, None)]
    r = manifest(as_table(spark, one)).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["verified"] and r["proof_sha256"] == sha("")
    assert manifest(as_table(spark, [])).collect() == []


def test_fold_takes_back_what_collapse_gives():
    for n in (1, 2, 3, 4, 9, 10, 28):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        root, proofs = merkle.collapse(leaves, merkle.height(n))
        assert all(merkle.fold(d, i, n, p) == (root, b"") for i, (d, p) in enumerate(zip(leaves, proofs, strict=True)))
        assert all(merkle.fold(b"\0" * 32, i, n, p)[0] != root for i, p in enumerate(proofs))


# --- codes ---------------------------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label); whole numbers of any size."""
    kept = [(v, [math.floor(4096 * float(np.float32(x))) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    part = lambda e, p: e[p * width : (p + 1) * width]
    books = [[part(e, p) for _, e, _ in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, e, _ in kept:
                groups[near(part(e, p), book)[1]].append(part(e, p))
            books[p] = [[sum(col) // len(groups[i]) for col in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(book)]
    digest = sha(",".join(str(x) for book in books for c in book for x in c))
    coded = [(v, [near(part(e, p), books[p]) for p in range(parts)], lab) for v, e, lab in kept]
    total = defaultdict(int)
    for _, c, lab in coded:
        total[lab] += sum(d for d, _ in c)
    return sorted(((v, "".join(f"{i:02x}" for _, i in c), sum(d for d, _ in c), total[lab], digest) for v, c, lab in coded), key=repr)


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def vectors(n=150, dim=16, scale=0.3):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, scale, dim)], int(i % 4) if i % 5 else None) for i in range(n)]
    rows += [(n + i, [0.25 * ((i + j) % 3) for j in range(dim)], 9) for i in range(20)]  # many ties
    bad = [None, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [0.0] * (dim - 1)]
    return rows + [(-9 + i, v, 1) for i, v in enumerate(bad)] + [(3, rows[3][1], 2), (None, rows[5][1], 2), (-1, None, None)]


def embeddings(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    return frame.withColumns({c: F.lit("noise") for c in ("key", "n", "part", "entry", "packed", "dim", "code", "error")})


def test_codes_match_brute_force(spark):
    assert collected(encode(embeddings(spark, vectors())), *CODES) == brute_codes(vectors())


def test_codes_of_large_components_are_exact(spark):
    rows = vectors(40, 8, 9000.0)
    assert collected(encode(embeddings(spark, rows)), *CODES) == brute_codes(rows)


def test_codes_of_few_rows_and_of_none(spark):
    rows = vectors()[:5]
    assert collected(encode(embeddings(spark, rows)), *CODES) == brute_codes(rows)
    assert encode(embeddings(spark, [])).collect() == [] and encode(embeddings(spark, [(1, None, 2), (2, [None] * 8, 2)])).collect() == []


def test_codes_with_many_labels_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_SHARE", 3)
    assert collected(encode(embeddings(spark, vectors())), *CODES) == brute_codes(vectors())


@pytest.mark.parametrize("rows", [[(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 12, 1)], [(1, [1e9] * 8, 1)]])
def test_codes_refuse_what_has_no_defined_result(spark, rows):
    with pytest.raises(Exception, match="lengths|equal parts|not below"):
        encode(embeddings(spark, rows).coalesce(1)).collect()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=20), st.lists(st.lists(st.integers(-6, 6), min_size=2, max_size=2), min_size=1, max_size=30))
def test_the_tree_finds_the_nearest_entry_with_the_lowest_index(book, points):
    for kind in (np.int64, np.float64):
        entry, far = PartTree(np.array(book, kind)).nearest(np.array(points, kind))
        assert [(int(d), int(e)) for e, d in zip(entry, far, strict=True)] == [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book)) for x in points]


def test_the_tree_passes_subtrees_over():
    book = np.array([[i * 1000.0, 0.0] for i in range(16)])
    visited = []
    tree_ = PartTree(book)
    plain = tree_._visit
    tree_._visit = lambda node, points, rows, *rest: (visited.append(len(rows)), plain(node, points, rows, *rest))[1]
    tree_.nearest(np.array([[15000.0, 1.0]]))
    assert sum(visited) < 16 and pq_codes.SLACK > 2**-50
