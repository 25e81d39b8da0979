from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import blobs
from marginalia.llm.components import connected_components
from marginalia.llm.ngram_join import CountTree, join_components, least_overlap, shingle_sets
from marginalia.llm.suffix_dedup import dedup_digest, remove_repeats
from tests.llm.doubling import removed_bytes
from tests.llm.fixtures import collected, corpus, documents, edited, text


def brute_spans(rows):
    """Straight from the contract: all 50-byte strings of all documents."""
    first: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t, *_ in rows]
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - 49):
                first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - 49) if d is not None else ():
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


DIGEST = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup_matches_brute_force(spark):
    assert collected(dedup_digest(documents(spark)), *DIGEST) == brute_spans(corpus())


def test_suffix_dedup_agrees_with_prefix_doubling_by_the_book(spark):
    rows = [(i, t, None) for i, t in enumerate([text(1, 60), text(2, 30) + text(1, 60)[40:300], "ab" * 60, "xab" * 40, None, text(1, 60), "short", text(3, 20) + "ab" * 30])]
    docs = documents(spark, rows)
    expected = {r["doc_id"]: r["n_removed"] for r in removed_bytes(docs.select("doc_id", "text")).collect()}
    assert expected and {r["doc_id"]: r["n_removed"] for r in dedup_digest(docs).collect() if r["n_removed"]} == expected


def test_suffix_dedup_of_periodic_and_shuffled_texts(spark):
    rng = random.Random(5)
    pieces = [text(i, 9) for i in range(6)] + ["ab" * 40, "z" * 90]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(5))), None) for i in rng.sample(range(1000), 60)]
    assert collected(dedup_digest(documents(spark, rows)), *DIGEST) == brute_spans(rows)


def test_suffix_dedup_works_through_long_texts_in_segments(spark, monkeypatch):
    from marginalia.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "SEGMENT", 97)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 500)
    data = np.frombuffer(text(3, 200).encode(), np.uint8)
    ends = np.full(len(data), len(data))
    cut = np.concatenate([s for _, _, s, _ in suffix_dedup.string_ranks(data, ends)])
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 20)
    whole = np.concatenate([s for _, _, s, _ in suffix_dedup.string_ranks(data, ends)])
    assert (cut == whole).all()


def test_suffix_dedup_of_an_empty_table(spark):
    assert dedup_digest(documents(spark, [])).collect() == []


def test_remove_repeats_keeps_columns_and_nulls(spark):
    docs = documents(spark)
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id is not null").collect()}
    assert texts[1] is None and texts[2] == "" and texts[10] == "" and texts[0] == corpus()[0][1]


def brute_components(rows, words=5):
    sets = []
    for d, t, *_ in rows:
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append((d, frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()))
    part, links = list(range(len(sets))), [0] * len(sets)
    find = lambda x: x if part[x] == x else find(part[x])
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                part[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least: dict[int, int | None] = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min((x for x in (d, least.get(find(i))) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)], links[i]) for i, (d, s) in enumerate(sets)), key=repr)


JOINED = ("doc_id", "n_shingles", "component_id", "n_links")


def test_join_matches_brute_force(spark):
    rows = corpus()
    found = collected(join_components(documents(spark)), *JOINED)
    assert found == brute_components(rows)


def test_join_counts_links_of_repeated_rows_with_partners(spark):
    a, b = text(1, 120), edited(text(1, 120), 3, 2)
    assert collected(join_components(documents(spark, [(1, a, None), (1, a, None), (2, b, None)])), *JOINED) == [(1, 116, 1, 2), (1, 116, 1, 2), (2, 116, 1, 2)]
    rows = [(1, a, None), (1, a, None), (2, b, None), (2, a, None), (3, b, None), (3, text(9, 40), None), (4, text(9, 40), None), (4, edited(a, 5, 3), None), (5, "one two", None), (5, "one two", None)]
    assert collected(join_components(documents(spark, rows)), *JOINED) == brute_components(rows)


def test_join_loses_no_link_in_a_large_group_of_near_copies(spark, monkeypatch):
    from marginalia.llm import ngram_join

    for name, value in (("BLOCK", 16), ("BLOCK_SHINGLES", 1500), ("FAN", 5), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = [(i, edited(text(i // 120, 90), i, i % 9), None) for i in range(240)]
    rows += [(300 + i, " ".join(text(1000 + i // 3, 60).split(" ")[i % 3 * 4 :]), None) for i in range(60)]
    random.Random(1).shuffle(rows)
    assert collected(join_components(documents(spark, rows)), *JOINED) == brute_components(rows)


def test_every_candidate_of_the_join_comes_out_of_a_tree(spark, monkeypatch):
    from marginalia.llm import ngram_join

    docs = documents(spark, [(i, f"{edited(text(i // 20, 90), i, i % 3)} end{i}", None) for i in range(40)])
    assert any(r["n_links"] for r in join_components(docs).collect())

    def nothing(posted, threshold=75):
        return posted.select("sid").limit(0).selectExpr("sid as a", "sid as b")

    for name in ("hub_pairs", "cross_pairs"):
        monkeypatch.setattr(ngram_join, name, nothing)
    assert not any(r["n_links"] for r in join_components(docs).collect())


def test_what_the_join_moves_follows_the_text_not_its_square(spark):
    """Ten texts and their concatenation: postings have a fixed size, whatever the length of the set."""
    from marginalia.llm import ngram_join

    texts = [text(i, 2000) for i in range(10)]
    docs = documents(spark, [(i, t, None) for i, t in enumerate([*texts, " ".join(texts)])])
    described = ngram_join.describe_sets(docs)
    sets = ngram_join.candidate_sets(docs, described.select("sid", "doc_id"))
    moved = ngram_join.postings_of(sets)
    assert moved.count() * (5 * 8 + 8 * ngram_join.MINIMA) <= 10 * 2 * sum(map(len, texts))


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_intersections_are_counted_exactly(seed):
    from marginalia.llm.ngram_join import intersections

    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 2**63, 400)[: rng.integers(1, 60)] % rng.integers(5, 300)).astype(np.uint64) for _ in range(9)]
    found = intersections(sets[:4], sets[4:], columns=int(rng.integers(1, 50)), rare=int(rng.integers(1, 12)))
    assert found.astype(int).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[4:]] for a in sets[:4]]


def test_join_of_an_empty_table_and_of_empty_texts(spark):
    assert join_components(documents(spark, [])).collect() == []
    assert collected(join_components(documents(spark, [(1, None, None), (2, "", None)])), *JOINED) == [(1, 0, 1, 0), (2, 0, 2, 0)]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 400), st.integers(0, 10_000))
def test_the_tree_never_loses_a_point_within_the_bound(n, seed):
    rng = np.random.default_rng(seed)
    points = rng.poisson(rng.uniform(0.5, 6), (n, 8))
    sizes = points.sum(1)
    tree = CountTree(points, sizes)
    for i in rng.integers(0, n, 5).tolist():
        bound = np.minimum(points, points[i]).sum(1)
        fits = (bound >= least_overlap(sizes, int(sizes[i]))) & (75 * sizes <= 100 * sizes[i]) & (100 * sizes >= 75 * sizes[i])
        assert set(np.flatnonzero(fits).tolist()) == set(tree.search(points[i], int(sizes[i])).tolist())


def test_shingles_follow_order_and_number_of_words():
    a, b, c, d = shingle_sets(["a b c d e f", "b a c d e f", "a b", "a b a b"])
    assert len(a) == 2 and not set(a.tolist()) & set(b.tolist()) and c.tolist() != d.tolist()


def test_components_of_a_long_chain_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 240)] + [(7, 7)]
    found = {r["node"]: r["part"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[i] == 200 for i in range(200, 240))
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_sorted_numbers_survive_packing(values):
    ordered = np.array(sorted(values), np.uint64)
    assert blobs.unpack_sorted(blobs.pack_sorted(ordered)).tolist() == ordered.tolist()


def test_a_bucket_of_postings_is_counted_without_copies_of_its_hashes():
    import tracemalloc

    import numpy as np

    from marginalia.llm import blobs
    from marginalia.llm.postings import shared_of

    rng = np.random.default_rng(3)
    rows, sent, times = [], [], {}
    for key in range(130):
        h = np.unique(rng.integers(0, 1 << 20, 2000)).astype(np.uint64)
        owner = rng.integers(0, 50, len(h))
        for x, o in zip(h.tolist(), owner.tolist(), strict=True):
            times[x] = times.get(x, 0) + (1 if o else 2)
        rows.append({"key": key, "bucket": 0, "docs": b"", "hashes": blobs.pack_sorted(h), "owner": blobs.pack(owner.astype(np.uint32))})
        sent.append((h, owner))
    tracemalloc.start()
    found = shared_of(rows)
    first = next(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 8 * sum(len(h) for h, _ in sent)
    for (_, got, docs), (h, owner) in zip([first, *found], sent, strict=True):
        want = [(x, o - 1) for x, o in zip(h.tolist(), owner.tolist(), strict=True) if o and times[x] > 1]
        assert list(zip(got.tolist(), docs.tolist(), strict=True)) == want
    assert [(len(h), len(d)) for _, h, d in shared_of([dict(rows[0], hashes=b"", owner=b"")])] == [(0, 0)]
