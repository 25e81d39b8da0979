from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash

from marginalia.llm import hmm_lm, order_minhash, packing, template_html, toxicity, weak_quality
from marginalia.llm.mixing import mix
from marginalia.llm.order_minhash import fingerprints
from marginalia.llm.url_cascade import Rule, build_cascade, judge_urls
from tests.llm.fixtures import collected, corpus, documents, text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op1 ----------------------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div class="topbar">Site</div><nav><a href="/">Home</a></nav>
<div id="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text.<p>Second &lt;p&gt;<br>line.<ul><li>One<li>Two</ul>
<div class="share">Share this</div><!-- no --><script>var x = "</p>";</script></article><section class="comments"><p>Nice!</p></section><aside>More</aside><footer>(c)</footer></body></html>"""


def test_article_without_everything_around_it():
    assert template_html.main_text(PAGE) == "Head & line\nFirst bold text.\nSecond <p> line.\nOne\nTwo"
    assert template_html.main_text("") == "" and template_html.main_text("<p>a<p>b") == "a\nb" and template_html.main_text("a &amp;amp; b") == "a &amp; b"


def test_subtrees_that_recur_on_a_host_go_and_sentences_that_recur_stay(spark):
    def page(i, banner):
        return f"<body><div class='box'><p>{banner}</p></div><div><p>Own text {i}.</p><p>Shared sentence.</p></div></body>"

    rows = [(i, f"http://one.example/{i}", page(i, "Welcome to one")) for i in range(6)] + [(10 + i, f"http://two.example/{i}", page(i, f"Only {i}")) for i in range(6)]
    rows += [(20, None, None), (21, "http://one.example/z", ""), (22, "no url", "<p>x</p>"), (0, "http://one.example/0", page(0, "Welcome to one"))]
    pages = spark.createDataFrame([(*r, "noise") for r in rows], "page_id long, url string, html string, host string")
    out = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in template_html.extract(pages).collect()}
    assert "Welcome" not in out[(1, "http://one.example/1")][0] and "Only 1" in out[(11, "http://two.example/1")][0]
    assert out[(20, None)] == ("", 0) and out[(22, "no url")] == ("x", 1) and template_html.extract(pages.limit(0)).collect() == []


def test_a_sentence_shared_by_articles_stays(spark):
    rows = [(i, f"http://one.example/{i}", f"<body><nav>Menu</nav><article><p>Own {i}.</p><p>Shared sentence.</p></article></body>") for i in range(8)]
    out = template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Own {r['page_id']}.\nShared sentence." for r in out)


def test_many_templates_meet_their_pages_in_a_join(spark, monkeypatch):
    monkeypatch.setattr(template_html, "BROADCAST_HASHES", -1)
    rows = [(i, f"http://one.example/{i}", f"<body><div class='x'><p>Banner</p></div><div><p>Own {i}</p></div></body>") for i in range(5)]
    assert {r["text"] for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {f"Own {i}" for i in range(5)}


def test_copies_of_a_page_are_no_templates(spark):
    page = lambda i, nav="": f"<body>{nav}<article><h1>Head {i}</h1><div>Body of article {i}.</div></article></body>"
    rows = [(i, f"http://one.example/1?page={i}", page(1, f"<p>Print {i}</p>")) for i in range(4)] + [(10, "http://one.example/2", page(2))]
    out = template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == ("Head 2\nBody of article 2." if r["page_id"] == 10 else "Head 1\nBody of article 1.") for r in out)


def test_twenty_pages_are_enough_on_a_host_of_any_size(spark):
    box = "<div><p>Boxed words</p></div>"
    rows = [(i, f"http://one.example/{i}", f"<body>{box if i < 25 else ''}<section><p>Own {i}</p></section></body>") for i in range(1500)]
    out = template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {f"Own {i}" for i in range(1500)}


def test_names_and_forms_never_take_the_whole_text():
    read = template_html.main_text
    assert read('<article class="post promo"><p>body</p></article>') == "body" and read('<main><div class="search"><p>body text</p></div></main>') == "body text"
    form = '<body><form action="x"><div class="topbar">Site</div><h2>Head</h2><p>The long text of a page inside a form.</p><input><button>Go</button></form></body>'
    assert read(form) == "Head\nThe long text of a page inside a form."
    assert read('<body><form><label>Name</label><input><button>Go</button></form><p>Text of the page.</p></body>') == "Text of the page."
    assert read('<div class="ad"><p>Everything is here.</p></div>') == "Everything is here."
    long = "<p>A much longer comment than the text itself, and then some more of it.</p>" * 5
    assert read(f'<article><p>Text.</p></article><div class="comments">{long}</div>') == "Text." and read(f'<article><p>Text.</p></article><div class="promo">{long}</div>') == "Text."


def test_comments_adverts_and_further_reading_inside_an_article_go():
    body = "<h1>Head</h1><p>The first paragraph of the text.</p><p>The second paragraph of it, a longer one.</p>"
    for name in ("related-articles", "newsletter-signup", "comment-list", "post-share-buttons", "ad-slot-2"):
        assert template_html.main_text(f'<article>{body}<div class="{name}"><p>Not this</p></div></article>').count("\n") == 2, name
    for name in ("post-header", "entry-footer-text", "content-body", "login-story"):
        assert template_html.main_text(f'<article>{body}<div class="{name}"><p>But this</p></div></article>').endswith("But this"), name


def test_a_sentence_on_few_pages_of_a_large_host_stays(spark):
    """Twenty-five of sixty: more than twenty, less than half."""
    rows = [(i, f"http://one.example/{i}", f"<body><p>Own text {i}.</p>{'<p>Shared sentence.</p>' if i < 25 else ''}</body>") for i in range(60)]
    out = {r["page_id"]: r["text"] for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Own text 3.\nShared sentence." and out[40] == "Own text 40."


def test_a_container_with_most_of_the_article_stays():
    html = "<article><h1>Head</h1><div><p>The whole long body.</p></div><ul><li>Box</li></ul></article>"
    assert template_html.main_text(html, template_html.template_hashes(html)) == "Head\nThe whole long body."


def test_all_articles_and_the_text_of_main_are_read():
    html = "<body><p>Out</p><article><p>One.</p></article><article><p>The second one.</p></article><main><p>Lead.</p><article><p>Third.</p></article></main></body>"
    assert template_html.main_text(html) == "One.\nThe second one.\nLead.\nThird."

def test_scripts_class_names_and_depth_do_not_cost_text():
    read = template_html.main_text
    assert read('<script>var a = "<!--";</script><style>a{content:"<!--"}</style><article><p>one</p></article>') == "one"
    assert read("<script>if(i<n){// don't}</script><p>It's the text</p><p title=don't>two</p>") == "It's the text\ntwo"
    assert read('<article><div class="post-with-ad-free-promo"><p>body</p></div></article>') == "body"
    assert read('<article class="entry search-friendly"><p>body</p></article>') == "body"
    assert read("<h1>Site</h1><h1>Head</h1><article><p>body</p></article>") == "Head\nbody" and read("<h1>Site</h1><article><h1>Head</h1></article>") == "Head"
    assert read("<main><p>hi</p></main><div class='comments-list'><article><p>c</p></article></div><div id=siteFooter>f</div>") == "hi"
    assert read("<div class=widget><h1>Head</h1></div><form><article><p>x</p></article></form>") == "Head\nx"
    for html in ("<div>" * 100_000 + "deep", "<b>" * 100_000 + "deep" + "</i>" * 100_000, "<td><div>" * 50_000 + "deep"):
        assert read(html, {1}) == "deep" and (template_html.template_hashes(html) or "<b>" in html)


def test_a_very_long_page_is_read_whole():
    assert template_html.main_text("<div>" * 300 + "<p>para  graph</p>" * 200_000).count("para graph") == 200_000


def test_recurrence_decides_where_elements_and_names_say_nothing(spark):
    """Brute force: generated pages of plain div elements, whose own blocks are known; menus differ in their links from page to page."""
    rng, rows, own = random.Random(5), [], {}
    for i in range(240):
        host = f"h{i % 3}.example"
        links = "".join(f"<li><a href='/{rng.random()}'>{text(rng.randrange(10**6), 1)}</a></li>" for _ in range(rng.randrange(3, 9)))
        blocks = [text(1000 * i + j, rng.randrange(3, 40)) for j in range(rng.randrange(1, 6))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        box = f"<div><b>{host}</b> box {rng.randrange(4)}</div>"
        rows.append((i, f"http://{host}/{i}", f"<body><div>Welcome to {host}</div><div><ul>{links}</ul></div>{box}<div>{body}</div><div><p>Imprint of {host}</p></div></body>"))
        own[i] = "\n".join(blocks)
    out = {r["page_id"]: r["text"] for r in template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == own
    assert all(template_html.main_text(h) != own[i] for i, _, h in rows)


def test_templates_change_the_driver_like_pages_without_article_and_names(spark):
    def page(i):
        return f"<body><div><ul><li><a href='/{i}'>w{i}</a></li><li><a href='/x'>v{i % 7}</a></li></ul></div><div><h1>Head {i}</h1><p>{text(i, 30)}</p></div><div>&copy; host</div></body>"

    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(40)]
    out = template_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"Head {i}\n{text(i, 30)}" for i in range(40)}


# --- op2 ----------------------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer, expected = Tokenizer.from_file(packing.default_tokenizer()), collections.Counter()
    for d, t, _ in corpus():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            expected[(d, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    out = packing.pack(documents(spark)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert len(sequences) == math.ceil(sum(r["length"] for r in out) / 2048)
    assert packing.pack(documents(spark, [])).collect() == []


def test_ids_of_parts_are_the_ids_of_the_text():
    ids = packing.Ids(packing.default_tokenizer())
    for t in ["", " ", "don't STOP now\x85x \x1c y", "é ́x ΣΣ", "<|endoftext|> 12 ab12", "日本 \U0001f44d\U0001f3fd", "a" * 500]:
        assert np.frombuffer(ids.of([t])[0], "<u4").tolist() == ids.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_places_every_item_once_and_pairs_large_ones():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 101, rng.integers(1, 300)).tolist()
        counts = collections.Counter(lengths)
        runs, made = packing.plan(counts, 100)
        fill, seen = collections.Counter(), collections.Counter()
        for r in runs:
            for number in range(r.count):
                seq, offset = r.sequence + number // r.each, r.offset + number % r.each * r.length
                assert offset == fill[seq]
                fill[seq] += r.length
                seen[r.length] += 1
        assert seen == counts and max(fill.values()) <= 100 and len(fill) == made
        large = sum(n for length, n in counts.items() if length > 50)
        assert max(large, math.ceil(sum(lengths) / 100)) <= made <= 1 + 11 / 9 * max(large, math.ceil(sum(lengths) / 100)) + 1


# --- op4 ----------------------------------------------------------------------------------------------------------------------------


def test_quality_counts_match_brute_force(spark):
    rows = [*corpus(), (90, "a b c d a b c e a b c", None), (91, "x x x x", None), (92, "##\nq\nq\n\nq %", None), (93, "a b c", None)]

    def counts(t):
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    out = weak_quality.quality(documents(spark, rows))
    found = collected(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == sorted(((d, *counts(t)) for d, t, _ in rows), key=repr)
    assert not [r for r in out.collect() if r["kept"] and r["base_failed"]] and weak_quality.quality(documents(spark, [])).collect() == []


def test_label_model_finds_the_reliable_rules():
    rng = np.random.default_rng(2)
    truth, votes = rng.random(4000) < 0.8, []
    for accuracy, speaks in ((0.95, 0.9), (0.9, 0.7), (0.6, 0.8)):
        right, there = rng.random(4000) < accuracy, rng.random(4000) < speaks
        votes.append([int(t == r) if s else None for t, r, s in zip(truth, right, there, strict=True)])
    model = weak_quality.fit_label_model(sorted(collections.Counter(zip(*votes, strict=True)).items(), key=repr))
    gap = [good - bad for bad, good in model.log_odds]
    assert min(gap[:2]) > 2 * gap[2] > 0


# --- op5 ----------------------------------------------------------------------------------------------------------------------------


def brute_forward(model, sequence):
    a, total = model.start * model.emit[sequence[0]], 0.0
    for x in sequence[1:]:
        s = a.sum()
        total += math.log10(s)
        a = a / s @ model.move * model.emit[x]
    return total + math.log10(a.sum())


def brute_expected(model, sequence):
    """Forward and backward messages without scaling in small texts, token by token."""
    n, k = len(sequence), len(model.start)
    alpha, beta = np.zeros((n, k)), np.ones((n, k))
    alpha[0] = model.start * model.emit[sequence[0]]
    for t in range(1, n):
        alpha[t] = alpha[t - 1] @ model.move * model.emit[sequence[t]]
    for t in range(n - 2, -1, -1):
        beta[t] = model.move @ (model.emit[sequence[t + 1]] * beta[t + 1])
    total = alpha[-1].sum()
    gamma, move = alpha * beta / total, np.zeros((k, k))
    for t in range(1, n):
        move += np.outer(alpha[t - 1], model.emit[sequence[t]] * beta[t]) * model.move / total
    emitted = np.zeros(model.emit.shape)
    np.add.at(emitted, sequence, gamma)
    return gamma[0], move, emitted


def test_forward_recursion_is_exact_for_short_and_long_sequences(monkeypatch):
    rng = np.random.default_rng(1)
    model = hmm_lm.HiddenMarkov.initial(rng.random(40) * 10, 3)
    sequences = [rng.integers(0, 40, n) for n in (1, 2, 300, 1500, 1024, 2048, 2049, 5000)]
    expected = [brute_forward(model, s) for s in sequences]
    assert np.allclose(hmm_lm.log_likelihoods(model, sequences), expected)
    for piece, batch in ((7, 50), (1, 3), (100, 10**6)):
        monkeypatch.setattr(hmm_lm, "PIECE", piece)
        monkeypatch.setattr(hmm_lm, "BATCH_TOKENS", batch)
        assert np.allclose(hmm_lm.log_likelihoods(model, sequences), expected)


def test_expected_counts_are_exact_whatever_the_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    model = hmm_lm.HiddenMarkov.initial(rng.random(12) * 10, 3)
    sequences = [rng.integers(0, 12, n) for n in (1, 2, 5, 30, 61, 60, 59)]
    parts = [brute_expected(model, s) for s in sequences]
    expected = [sum(p[i] for p in parts) for i in range(3)]
    for piece in (4096, 1, 7, 30):
        monkeypatch.setattr(hmm_lm, "PIECE", piece)
        *found, logs = hmm_lm.expected_counts(model, sequences)
        assert all(np.allclose(a, b) for a, b in zip(found, expected, strict=True)) and np.isclose(logs, sum(brute_forward(model, s) for s in sequences))


def two_languages(n):
    rng = random.Random(3)
    words = [[f"a{i}xa" for i in range(30)], [f"b{i}yb" for i in range(30)]]
    return [(i, " ".join(rng.choice(words[i % 2]) for _ in range(60)), None) for i in range(n)]


def test_states_learn_languages_and_likelihood_rises(spark):
    docs = documents(spark, two_languages(120))
    chunks = hmm_lm.encode(docs)
    lexicon, _ = hmm_lm.count_tokens(chunks)
    model, history = hmm_lm.train(chunks.filter("train"), lexicon, states=2)
    full = [gain for whole, gain in history if whole]
    assert len(lexicon.own) == 60 and full[-1] >= full[0] and (model.emit[1:].max(1) > 20 * model.emit[1:].min(1))[:60].mean() > 0.9
    held = [r for r in hmm_lm.score_texts(docs, states=2).collect() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.2


def test_probabilities_of_all_tokens_and_one_unknown_of_each_ending_add_up_to_one(spark):
    docs = documents(spark, [(0, "aa bb cc aa bb aa aa aa bb bb bb", None), (2, "aa cc dd", None), (3, "zz ee", None)])
    chunks = hmm_lm.encode(docs)
    lexicon, _ = hmm_lm.count_tokens(chunks)
    model, _ = hmm_lm.train(chunks.filter("train"), lexicon, states=2)
    assert np.allclose(model.emit.sum(0), 1) and len(lexicon.own) == 2  # aa and bb
    endings = lexicon.counts[1 + len(lexicon.own) :]
    distinct = 2 * (10**lexicon.logs - endings) - 1
    assert np.allclose((endings + 0.5 * distinct + 0.5) / 10**lexicon.logs, 1) and distinct.sum() == lexicon.distinct - 3


def test_lm_counts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "CHUNK_CHARS", 3000)
    rows = [*corpus(), (80, text(80, 30_000), "a")]
    out = hmm_lm.score_texts(documents(spark, rows), states=2).collect()
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1
    tokens = [hmm_lm.tokens_of(t or "") for _, t, _ in rows]
    counts = collections.Counter(w for (d, *_), ts in zip(rows, tokens, strict=True) if not held(d) for w in ts)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((d, held(d), len(ts), sum(counts[w] > 0 for w in ts), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts), 5)) for (d, *_), ts in zip(rows, tokens, strict=True)), key=repr)
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out), key=repr)
    assert found == expected and all(r["score"] < 0 for r in out)
    assert hmm_lm.score_texts(documents(spark, []), states=2).collect() == []


# --- op6 ----------------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weights[s] for s in open_) if open_ else 0
        more = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        if not more:
            return {s: 2.0 * sizes[s] if s in full else weights[s] * level for s in names}
        full |= more


def test_mix_meets_its_targets(spark):
    rows = [(i, text(i, 5 + i * 7 % 90), "abcdefg"[i % 7] if i % 11 else None) for i in range(700)] + [(900, None, "a"), (901, "", None), (5, text(5, 40), "f")]
    docs = documents(spark, rows)
    out = mix(docs).collect()
    sizes: collections.Counter = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets, taken = brute_targets(dict(sizes)), collections.Counter()
    for r in out:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], targets[r["source"]])
        taken[r["source"]] += r["taken"]
    assert len(out) == len(rows) and all(abs(taken[s] - targets[s]) <= 10 for s in targets)
    again = mix(docs.repartition(5))
    columns = ("doc_id", "size", "taken")
    assert collected(again, *columns) == sorted((tuple(r[c] for c in columns) for r in out), key=repr)
    assert mix(documents(spark, [])).collect() == [] and all(r["taken"] == 0 for r in mix(documents(spark, [(1, None, None)])).collect())


# --- op8 ----------------------------------------------------------------------------------------------------------------------------


def test_fingerprints_follow_the_contract(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 70]
    out = {r["doc_id"]: r for r in fingerprints(documents(spark, rows)).collect()}
    ordered = sorted(rows)
    for i, (d, t, _) in enumerate(ordered):
        t, following = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        expected = t[: len(t) - half] + following[:half]
        r = out[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(expected.encode()).hexdigest() and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if expected == t:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
    assert out[0]["fingerprint"] == out[10]["fingerprint"] and out[10]["near_next"] == 1 and out[1]["fingerprint"] == "" and out[20]["near_next"] > 0.3


def test_fingerprints_notice_order(spark):
    words = text(5, 200).split(" ")
    swapped = " ".join(words[100:] + words[:100])
    r = {r["doc_id"]: r for r in fingerprints(documents(spark, [(1, " ".join(words), None), (2, swapped, None), (3, " ".join(words), None)])).collect()}
    assert r[3]["near_next"] == 1 and r[1]["near_next"] < 0.9


def test_fingerprints_compare_texts_on_both_sides_of_any_length(spark):
    base = text(3, 60)
    spaced, dense = "é" + base[:255], "".join(base[:330].split())
    rows = [(1, base[:260], None), (2, base[:250], None), (3, spaced, None), (4, spaced[:255], None), (5, dense[:255], None), (6, dense[:240] + " " + dense[240:255] + " a b c d", None), (7, "日本語学" * 20, None), (8, "日本語学" * 20 + "x", None)]
    r = {r["doc_id"]: r["near_next"] for r in fingerprints(documents(spark, rows)).collect()}
    assert all(r[d] > 0.5 for d in (1, 3, 5, 7)), r


def test_sketch_of_lone_and_few_code_points(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "abcd", None), (4, "abcd", None), (5, "\U0001f44dabc", None), (6, "\U0001f44dabc", None), (7, "aaaaaaaa", None), (8, "aaaaaaaa", None)]
    r = {r["doc_id"]: r for r in fingerprints(documents(spark, rows)).collect()}
    assert all(r[d]["near_next"] == 1 for d in (1, 3, 5, 7)) and all(r[d]["near_next"] == 0 for d in (2, 4, 6)) and len(r[1]["fingerprint"]) == 8


def test_fingerprints_of_odd_tables(spark):
    assert fingerprints(documents(spark, [])).collect() == []
    assert len(fingerprints(documents(spark)).collect()) == len(corpus())
    assert fingerprints(documents(spark, [(7, "only one", None)])).collect()[0]["near_next"] == 1


def hash_of(*parts, seed=42):
    """xxHash64 of columns in a row, each seeded with what came before."""
    for p in parts:
        data = p if isinstance(p, bytes) else p[0].to_bytes(p[1], "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_sketch(t, k=4, low=31):
    """The selection rule word by word: number the k-mers, deal them over 64 bins, take the two smallest of each, back into text order."""
    raw = [t[i : i + k].encode("utf-32-be") for i in range(max(1, len(t) - k + 1))] if t else []
    kmers = [hash_of(x) >> low for x in raw]
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for place, x in enumerate(kmers):
        h = hash_of((x, 8), (seen[x], 4)) >> low
        seen[x] += 1
        bins[(h >> (64 - low - 6)) & 63].append((h, place))
    out = {}
    for b, found in bins.items():
        ordered = [h for h, _ in sorted(sorted(found)[:2], key=lambda f: f[1])]
        out[b] = hash_of(*((h, 8) for h in ordered)) & 0xFFFFFF
    return out


def test_edited_fingerprints_match_brute_force_at_any_lengths(spark):
    """The k-mers that a text shares with its edited text are handled once; neighbours are empty, short, long, equal and full of repeats."""
    words = ["".join(random.Random(i).choices("abcde ", k=n)) for i, n in enumerate([3000, 40, 2500, 0, 1700, 5000])]
    texts = [*words, words[0], words[0], "a" * 3000, "ab" * 900, "abcdefg", "abcdef", "abc", None, "x", "\U0001f44d" * 9, words[5]]
    rows = {r["doc_id"]: r for r in fingerprints(documents(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    line = lambda t: "".join(f"{b << 24 | v:08X}" for b, v in sorted(brute_sketch(t).items(), key=lambda f: f[0] ^ 32))  # noqa: E731 (bins in order of signed hashes)
    for i, t in enumerate(texts):
        t, other = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert (rows[i]["fingerprint"], rows[i]["edited_fingerprint"]) == (line(t), line(t[: len(t) - half] + other[:half])), i


def test_fingerprints_and_likeness_match_brute_force(spark):
    rows = [(d, t, s) for d, t, s in corpus() if d is not None and d != 70] + [(90, "\U0001f44d日本" * 50, None), (91, "abab" * 40, None)]
    out = {r["doc_id"]: r for r in fingerprints(documents(spark, rows)).collect()}
    ordered = sorted(rows)
    for i, (d, t, _) in enumerate(ordered):
        mine, other = brute_sketch(t or ""), brute_sketch(ordered[(i + 1) % len(ordered)][1] or "")
        assert sorted(int(out[d]["fingerprint"][j : j + 8], 16) for j in range(0, len(out[d]["fingerprint"]), 8)) == sorted((b << 24) + v for b, v in mine.items())
        n = len(mine.keys() | other.keys())
        assert np.isclose(out[d]["near_next"], sum(mine.get(b) == v for b, v in other.items()) / n if n else 1)


def test_one_permutation_in_bins_agrees_with_independent_permutations():
    """Likeness of the sketch against Order MinHash with 256 permutations of their own, over pairs from equal to unrelated."""
    rng, gaps = random.Random(2), []
    for i in range(24):
        a = text(i, 120)
        words = a.split(" ")
        for _ in range(i):
            words[rng.randrange(len(words))] = text(rng.randrange(10**6), 1)
        b = " ".join(words if i % 3 else words[60:] + words[:60])
        numbered = []
        for t in (a, b):
            seen, places = collections.Counter(), []
            for j in range(len(t) - 3):
                places.append((t[j : j + 4], seen[t[j : j + 4]]))
                seen[t[j : j + 4]] += 1
            numbered.append(places)
        agree = 0
        for seed in range(256):
            picks = [[x for _, _, x in sorted(sorted((xxhash.xxh64_intdigest(repr(x), seed=seed), j, x) for j, x in enumerate(p))[:2], key=lambda y: y[1])] for p in numbered]
            agree += picks[0] == picks[1]
        x, y = brute_sketch(a), brute_sketch(b)
        gaps.append(sum(x.get(k) == v for k, v in y.items()) / len(x.keys() | y.keys()) - agree / 256)
    assert abs(np.mean(gaps)) < 0.05 and np.mean(np.abs(gaps)) < 0.1, gaps


def test_half_equal_texts_of_any_length_are_alike(spark):
    rows = [(i, text(i, 3000)[:n], None) for i, n in enumerate((10, 20, 50, 100, 200, 250, 260, 300, 500, 512, 600, 1000, 3000, 10_000))]
    rows = [(2 * i, t, None) for i, t, _ in rows] + [(2 * i + 1, "", None) for i, *_ in rows]
    out = {r["doc_id"]: r for r in fingerprints(documents(spark, rows)).collect()}
    near = [out[d]["near_edited"] for d, t, _ in rows if t]  # about a quarter: two picks, each in the half that stays
    assert min(near) > 0.1 and np.mean(near) > 0.2, near


def test_neighbours_of_ids_at_the_ends_and_in_heaps(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "RANGE_ROWS", 3)
    monkeypatch.setattr(order_minhash, "QUANTILES", 5)
    ids = [-(2**63), -(2**63) + 1, *range(1, 90), 10**15, 2**63 - 2, 2**63 - 1]
    rows = [(d, f"text {d}", None) for d in ids]
    random.Random(1).shuffle(rows)
    frame = documents(spark, rows).select("doc_id", "text")
    assert collected(order_minhash.with_next(frame, ["text"]), "doc_id", "next_text") == sorted(((d, f"text {ids[(i + 1) % len(ids)]}") for i, d in enumerate(ids)), key=repr)
    cuts = order_minhash._cut_points(frame, len(ids))
    spread = frame.groupBy(order_minhash._range_of(frame["doc_id"], cuts, min(ids), max(ids), len(ids)).alias("r")).count().collect()
    assert max(r["count"] for r in spread) <= 25
    nulls = documents(spark, [(None, f"n{i}", None) for i in range(50)] + [(5, "five", None)]).select("doc_id", "text")
    found = order_minhash.with_next(nulls, ["text"]).collect()
    assert sorted(r["next_text"] for r in found) == sorted(r["text"] for r in found) and [r["next_text"] for r in found if r["text"] == "five"][0].startswith("n")


# --- op9 ----------------------------------------------------------------------------------------------------------------------------

RULES = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "org/es/")]


def test_rules_and_odd_urls(spark):
    urls = {1: "HTTP://A.Example.COM/en/72?x=/en/", 2: "http://shop.com/en/8#top", 3: "http://b.net/de/1", 4: "https://x.org/es/", 5: None, 6: "no scheme com/en/", 7: "ftp://other.com?en", 8: "http://xcom/en/", 9: "http://b.net", 10: ""}
    pages = spark.createDataFrame([(k, u, "noise", None) for k, u in urls.items()] + [(2, urls[2], "again", None)], "page_id long, url string, host string, verdict string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, RULES).collect()}
    assert out[1] == ("a.example.com", "/en/72", "example.com/en/7", "allow") and out[2] == ("shop.com", "/en/8", "com/en/", "block")
    assert out[3][2:] == ("net/de/", "allow") and out[4][2:] == ("org/es/", "block") and out[5] == ("", "", None, "allow") == out[6] == out[10]
    assert out[7] == ("other.com", "", None, "allow") and out[8][2] is None and judge_urls(pages.limit(0), RULES).collect() == []


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    from marginalia.llm import url_cascade

    monkeypatch.setattr(url_cascade, "KEYS_PER_SHARD", 300)
    monkeypatch.setattr(url_cascade, "BITS_PER_KEY", 3)
    universe = spark.range(3000).selectExpr("concat('k', id) as key", "id % 7 = 0 as listed")
    cascade = build_cascade(universe)
    marked = cascade.mark(universe, universe["key"], "found")
    assert len(cascade.bits) > 2 and cascade.shards == 2 and marked.filter("found <> listed").count() == 0


# --- op10 ---------------------------------------------------------------------------------------------------------------------------


def toxic_rows():
    return [(i, text(i, 30) + (" horrid nastyword" if i % 4 == 0 else "") + (" women" if i % 4 == 0 and i % 8 else ""), None) for i in range(400)]


def test_toxicity_learns_words_and_not_mentions(spark):
    rows = toxic_rows() + [(1000, None, None), (1001, "", None), (1002, "quiet women walk by the river", None), (1003, "a horrid nastyword", None)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), None) for i in range(400)] + [(None, 1, 1, None), (3, None, None, None)], "doc_id long, quality int, toxic int, score double")
    out = {r["doc_id"]: r for r in toxicity.toxicity(documents(spark, rows), labels).collect()}
    assert len(out) == len(rows) and all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    held = [d for d, r in out.items() if r["held_out"] and d < 400]
    assert all(out[d]["predicted"] == int(d % 4 == 0) for d in held) and out[1003]["predicted"] == 1 and out[1002]["predicted"] == 0 and 0 <= out[1000]["score"] == out[1001]["score"] < 0.5


def test_swaps_lower_the_weight_of_identity_terms():
    rows = [(1, [0, 1])] * 10 + [(0, [2])] * 10
    plain, fair = (toxicity._train(["bad", "women", "men"], rows, swaps, 0.0).weights for swaps in ({}, {(-1, -1): 5, (1, 1): 5, (1, 2): -5, (2, 1): -5, (2, 2): 5}))
    assert abs(fair["women"] - fair["men"]) < 0.5 * abs(plain["women"] - plain["men"])


def test_the_matrix_of_swaps_is_the_sum_over_sentences(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(toxicity, "_train", lambda names, rows, swaps, prior: seen.update(names=names, swaps=swaps) or toxicity.ToxicityModel(0.0))
    rows = toxic_rows()
    toxicity.fit(documents(spark, rows), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int"))
    trained = [t for d, t, _ in rows if zlib.crc32(str(d).encode()) % 5 != 0 and d < 400]
    expected, n = np.zeros((len(seen["names"]),) * 2), 0
    for t in trained:
        for x, z in toxicity.swapped(t):
            change = np.array([(f in x) - (f in z) for f in seen["names"]])
            expected += np.outer(change, change)
            n += 1
    found = np.zeros_like(expected)
    for (i, j), v in seen["swaps"].items():
        if i >= 0:
            found[i, j] = v
    assert n > 0 and seen["swaps"][-1, -1] == n and (found == expected).all()


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(documents(spark), none).collect()} == {0}
    assert toxicity.toxicity(documents(spark, []), none).collect() == []


# --- very long texts ------------------------------------------------------------------------------------------------------------------


def test_a_very_long_text_is_worked_on_whole_by_every_operator(spark):
    """Three million characters in one row, with a neighbour; what each operator says of it is known."""
    from marginalia.llm.ngram_join import join_components
    from marginalia.llm.suffix_dedup import dedup_digest

    words = 400_000
    long = " ".join(f"w{i}" for i in range(words))
    rows = [(0, text(1, 30), "a"), (1, long, "a"), (2, long[100:], "b"), (3, None, "b")]
    docs = documents(spark, rows)
    by = lambda frame: {r["doc_id"]: r for r in frame.collect()}
    found = by(mix(docs))
    assert found[1]["size"] == words and found[3]["size"] == 0
    found = by(weak_quality.quality(docs))
    assert found[1]["n_words"] == words and found[1]["n_repeat_words"] == 0 and found[3]["n_words"] == 0
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert set(by(toxicity.toxicity(docs, labels))) == {0, 1, 2, 3}
    found = by(hmm_lm.score_texts(docs, states=2))
    assert found[1]["n_tokens"] == words + 1 and math.isfinite(found[1]["score"])
    found = by(join_components(docs))
    assert found[1]["n_shingles"] == words - 4 and found[2]["component_id"] == 1 and found[2]["n_links"] == 1
    found = by(dedup_digest(docs))
    assert found[2]["n_removed"] == len(long) - 100 and found[1]["n_removed"] == 0
    found = by(fingerprints(docs))
    assert found[1]["n_chars"] == len(long) and found[1]["near_next"] > 0.7


def test_remembered_ids_are_those_of_the_tokenizer_and_a_word_with_signs_costs_no_other_encoding():
    from marginalia.llm.packing import Ids, default_tokenizer

    ids, encoded = Ids(default_tokenizer()), []
    ids.known.clear()
    whole = ids.tokenizer
    odd = ["a\x1cb c\x1dd", "a\xa0b　c d\x85e\x0bf", "don't!! it's 12\tab", "<|endoftext|> a<|startoftext|>b", "İx İ ŉa K Á. ab́ ſ, ΣΣ Σ", "ab__ a_b a's '' ab@@ ​ xª, ½", "ẛ̣ ﬁn. a\x00b", ""]
    for texts in ([t] for t in odd * 2):
        assert ids.of(texts) == [b"".join(i.to_bytes(4, "little") for i in whole.encode(t, add_special_tokens=False).ids) for t in texts]

    learn = ids.learn_letters
    ids.learn_letters = lambda words: (encoded.extend(words), learn(words))
    ids.of(["Zubrelliko zubrelliko, ZUBRELLIKO!!! zubrelliko"])
    ids.of(["zubrelliko;;"])
    assert encoded == ["zubrelliko"]
