"""Operators with numpy in tasks, against brute force."""

import os
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from postmill.llm import decontamination, html_text, quality, simhash, toxicity
from postmill.llm._words import ALNUM, NOT_SPACE, slices

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "  x  ", "Ab ab\tAB\n\nab ab", "é漢 \U0001f600ñ a-b_c", "end\n", "\n\n", "w " * 40 + "\nw w\nw w", "\x00 \x7f ok", " nbsp stays", "last"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize(("kind", "words"), [(ALNUM, alnum), (NOT_SPACE, lambda t: spaced(lower(t)))])
@pytest.mark.parametrize("cut", [0, 3])
def test_words(kind, words, cut):
    got = []
    for _, _, texts in slices(pa.array(TEXTS).slice(cut), lower=True):
        w = texts.words(kind)
        got += [[w.bytes_of(k).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(w.counts))]
    assert got == [words(t) for t in TEXTS[cut:]]


def hits_by_hand(text, items):
    words, hit, ids = alnum(text), set(), set()
    for item, body in items:
        own = alnum(body)
        k = min(13, len(own))
        for s in range(len(own) - k + 1 if own else 0):
            for at in range(len(words) - k + 1):
                if words[at : at + k] == own[s : s + k]:
                    hit |= set(range(at, at + k))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


BENCH = [(1, " ".join(f"passage{i}" for i in range(20))), (2, "idiot"), (3, None), (4, "..."), (5, "IDIOT"), (5, "word, word word"), (None, "tail of words")]


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_contamination(spark, odd_docs, no_docs, most):
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    items = [b for b in BENCH if b[0] is not None]
    found = decontamination.find_contamination(odd_docs, bench, max_bytes=most).collect()
    assert len(found) == 11
    for r in found:
        n, n_hit, ids = hits_by_hand(r["text"], BENCH)
        assert (r["n_words"], r["n_hit"], r["contaminated"]) == (n, n_hit, n_hit > 0 and 20 * n_hit >= n)
        assert sorted(r["hit_items"]) == hits_by_hand(r["text"], items)[2]
        assert r["score"] == ("x" if r["doc_id"] == 1 else None)
    assert decontamination.find_contamination(no_docs, bench).count() == 0
    assert decontamination.find_contamination(odd_docs, bench.limit(0)).where("contaminated").count() == 0
    clean = decontamination.decontaminate(odd_docs, bench, max_bytes=most)
    assert clean.columns == odd_docs.columns and {r["doc_id"] for r in clean.collect()} == {1, 2, 3, 4, None, 8}
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(odd_docs, bench, mode="spans", max_bytes=most).collect()}
    assert cut[9] == "" and cut[2] is None and cut[5].split() == [f"passage{i}" for i in range(20, 30)] and cut[8].startswith("General Public")


def print_by_hand(text):
    words = spaced(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def groups_by_hand(values, radius):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == print_by_hand(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_forest(radius):
    rng = np.random.default_rng(radius)
    fps = np.array([int(rng.integers(1 << 63)) ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 5)))) for _ in range(6) for _ in range(1)] * 30, np.uint64)
    fps = fps ^ np.array([sum(1 << int(b) for b in set(rng.integers(0, 64, 3).tolist())) for _ in fps], np.uint64)
    new = np.zeros(len(fps), bool)
    new[[0, 50, 51]] = True
    root, bounds = simhash.block_forest(fps, new, radius), [0, 50, 51, len(fps)]
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        hand = [lo + r for r in groups_by_hand(fps[lo:hi].tolist(), radius)]
        same = lambda g: [[x for x in range(len(g)) if g[x] == v] for v in dict.fromkeys(g)]
        assert same(root[lo:hi].tolist()) == same(hand)


@pytest.mark.parametrize("most", [4096, 7])
def test_near_duplicates(spark, odd_docs, no_docs, most, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_BUCKET", most)
    monkeypatch.setattr(simhash, "BLOCK", 40)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    rows = docs.collect()
    groups = groups_by_hand([print_by_hand(r["text"]) for r in rows], 3)
    least = defaultdict(list)
    for r, g in zip(rows, groups, strict=True):
        least[g].append(r["doc_id"])
    hand = sorted((r["doc_id"] is None, r["doc_id"], f"{print_by_hand(r['text']):016x}", min((x for x in least[g] if x is not None), default=None)) for r, g in zip(rows, groups, strict=True))
    got = sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == hand
    assert simhash.near_duplicates(no_docs).count() == 0


def test_tables_of_pieces_are_exact():
    rng = np.random.default_rng(3)
    for parts, _ in simhash.PARTS:
        tables = simhash.masks(3, parts)
        for _ in range(200):
            a = int(rng.integers(1 << 63))
            b = a ^ sum(1 << int(x) for x in rng.choice(64, 3, replace=False))
            assert any((a & m) == (b & m) for m in tables)


def stats_by_hand(text):
    text = text or ""
    words = spaced(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if spaced(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)]


def test_quality_statistics():
    got = []
    for _, _, texts in slices(pa.array(TEXTS), lower=False):
        got += np.stack(quality.text_stats(texts), axis=1).tolist()
    assert got == [stats_by_hand(t) for t in TEXTS]


def test_quality_rejects_outliers_and_keeps_the_rest(spark, odd_docs, no_docs):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(60, 400)))), "en", "s") for i in range(120)]
    rows += [(1000, " ".join(word() + "%%%###" for _ in range(200)), "en", "s"), (1001, " ".join("x" * 60 for _ in range(100)) + " q " * 3, "en", "s"), (1002, "few words", "en", "s")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i]["kept"] for i in range(120)) >= 118
    assert not got[1000]["kept"] and got[1000]["distance"] > quality.CUTOFF and not got[1001]["kept"]
    assert got[1002]["base_failed"] and not got[1002]["kept"]
    odd = quality.judge(odd_docs).collect()
    assert len(odd) == 11 and all(r["kept"] == (not r["base_failed"]) for r in odd)  # too few rows for estimates
    assert quality.judge(no_docs).count() == 0


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train_on(docs, labels)
    held = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(toxicity.fold() == 1).collect()
    bad, good = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good)
    assert auc > 0.85  # some labels of these tables are wrong on purpose


def test_toxicity_of_misspellings_and_odd_rows(spark, odd_docs, no_docs):
    fine = ["the river ran along the old road", "green hills and open fields", "a letter came in the morning"]
    texts = [f"{fine[i % 3]} {i}" for i in range(60)] + [f"{fine[i % 3]} you {w} {i}" for i in range(20) for w in ("moron", "worthless", "disgusting")]
    model = toxicity.train(texts, [0] * 60 + [1] * 60)
    scores = [float(s) for _, _, t in slices(pa.array(["green morning fields", "oh worthlesss one", "", None]), lower=True) for s in model.score(toxicity.text_logits(t, model))]
    assert 20 * scores[0] < scores[1] and scores[2] == scores[3] == 0.0
    got = toxicity.score(odd_docs, model)
    assert got.columns == [c for c in odd_docs.columns if c != "score"] + ["score"] and got.count() == 11
    assert toxicity.score(no_docs, model).count() == 0
    one_class = toxicity.train(["a b", "c"], [1, 1])
    assert [r["score"] for r in toxicity.score(odd_docs, one_class).collect()] == [0.0] * 11


def distances_by_hand(stats):
    """Robust distances of the rows of one group, the subsets taken from sorted distances; and that of the best of the starts."""
    n, *_ = counts = np.array(stats, float).T
    x = np.stack([np.log1p(n), 2 * np.log(np.maximum(counts[1], 1) / n), np.sqrt(np.minimum(counts[2] / n, 4)), np.sqrt(np.log1p(counts[3])) / 2, np.sqrt(counts[4] / n)], axis=1)
    floors = np.array(quality.FLOORS)

    def floored(cov):
        return cov - np.diag(cov.diagonal()) + np.diag(np.maximum(cov.diagonal(), floors**2))

    def distance(mean, cov):
        return np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)

    def step(mean, cov):
        near = x[np.argsort(distance(mean, cov), kind="stable")[: int(np.ceil(0.75 * len(x)))]]
        return near.mean(axis=0), floored(1.4121 * np.cov(near.T, bias=True))

    quartile = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    sd = np.maximum((quartile[2] - quartile[0]) / 1.349, floors)
    z = (x - quartile[1]) / sd
    found = []
    for v in (None, np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]):
        like = np.eye(5) if v is None else v.T @ v
        scale = np.sqrt(np.maximum(like.diagonal(), 1e-12))
        state = quartile[1], floored(like / np.outer(scale, scale) * np.outer(sd, sd))
        for _ in range(40):
            state = step(*state)
        found.append((np.linalg.slogdet(state[1])[1], distance(*state)))
    best = min(found, key=lambda f: f[0])[1]
    return best / max(1.0, np.quantile(best, 0.5, method="inverted_cdf") / 4.3515)


def test_robust_distances_equal_brute_force(spark):
    rng = np.random.default_rng(11)

    def text(k):
        n = int(rng.integers(60, 500))
        words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9)))) + ("#" if rng.random() < 0.02 * (k % 7 == 0) else "") for _ in range(n)]
        lines = [" ".join(words[i : i + 12]) for i in range(0, n, 12)]
        return "\n".join(lines + lines[: int(rng.integers(0, 3))] * (k % 5 == 0) + [" ".join(w + "%%%###" for w in words[:150])] * (k % 10 >= 8))

    rows = [(k, text(k), "en", "ab"[k % 2]) for k in range(300)]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    for source in "ab":
        own = [got[k] for k, _, _, s in rows if s == source and not got[k]["base_failed"]]
        hand = distances_by_hand([[r[c] for c in quality.STATS] for r in own])
        assert np.allclose([r["distance"] for r in own], hand, rtol=0.15, atol=0.1)
        clear = np.abs(np.log(hand / quality.CUTOFF)) > 0.15
        assert [r["kept"] for r, c in zip(own, clear, strict=True) if c] == (hand <= quality.CUTOFF)[clear].tolist() and (hand > quality.CUTOFF).sum() >= 10


PAGE = """<html><head><title>T</title></head><body><header>Top</header><nav><ul><li>m</ul></nav><div class="cookie-notice">We use</div>
<article><h1>One &amp; two</h1><p>three <b>fo</b>ur<br>five<!-- no --><p>six<script>var a="</p>";</script><aside>side</aside></article>
<section id="comments">first!</section><form>q<input></form><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "One & two three four five six"
    assert html_text.main_text("") == html_text.main_text("<p>text</p><nav>x</nav>")[:0] == ""
    assert html_text.main_text("<p>text</p><nav>x</nav>") == "text"
    assert html_text.main_text("plain  text &lt; <i>more") == "plain text < more"


def test_no_class_of_a_wrapper_empties_a_page():
    for name in ("with-sidebar", "sidebar", "share", "comments", "social-science"):
        assert html_text.main_text(f"<div class='{name}'><article><p>a story<div class=social-science>and more</div></article></div><div class=sidebar>s</div>") == "a story and more"
        assert html_text.main_text(f"<div class='{name}'><p>a story of some length</p></div><div class=sidebar>s</div>") == "a story of some length"
    assert html_text.main_text("<article><h2 id='comments'>On</h2><p class='share'>only <b class='notice'>inline</b> text<table class=related><tr><td>cell</table></article>") == "On only inline text cell"
    assert html_text.main_text("<article><p>one <span class='ad-box'>buy <b>this</b></span> two<div class=share>x</div></article>") == "one two"
    assert html_text.main_text("<form><article>a story</article></form>") == html_text.main_text("<article>a story</article><aside><article>not this</article></aside>") == "a story"


def test_deep_pages_take_linear_time():
    deep = "<div>x " * 20000 + "</p>" * 20000
    began = time.time()
    assert len(html_text.main_text(deep)) == 39999 and sum(html_text.page_tokens(deep).values()) == 40000
    assert time.time() - began < 5


STORY = "<html><body><div class='layout with-sidebar'><div class=top><a href=/>Home</a> <a href=/x>News {i}</a></div><div class=body><h1>Head {i}</h1><p>{story}</p>{more}<ul class=refs><li><a href=/q>Link {i}</a></li></ul></div><div class=sidebar>Ask {i}</div><div class=foot><p>All rights</p></div></div></body></html>"


def story_pages(n, host="h.org"):
    story = lambda i: " ".join(f"word{i}x{k}" for k in range(20 + i))
    return [(i, f"http://{host}/{i}", STORY.format(i=i, story=story(i), more="<form>Send</form>" if i % 3 == 0 else ""), f"Head {i} " + story(i)) for i in range(n)]


def test_the_template_decides(spark):
    """Slots of a host's template against their known texts; without the template, the rows differ."""
    rows = story_pages(12) + [(100, "http://few.org/", STORY.format(i=1, story="alone", more=""), None), (None, "http://h.org/z", "<p>another layout</p>", "another layout")]
    df = spark.createDataFrame([(*r[:3], "clash", "clash") for r in rows], "page_id long, url string, html string, `TEXT` string, `a.b` string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    want = {r[0]: r[3] for r in rows}
    assert {k: v for k, v in got.items() if k != 100} == {k: v for k, v in want.items() if k != 100}
    assert all(html_text.main_text(r[2]) != r[3] for r in rows[:12])
    assert html_text.extract(df.limit(0)).count() == 0


def test_classes_without_one_order_are_no_template(spark):
    """Texts on every page whose order changes belong to the pages."""
    parts = ["<p>alpha text</p>", "<p>beta text</p>", "<p>gamma text</p>"]
    page = lambda i: f"<html><body><div class=a>{''.join(parts[(i + k) % 3] for k in range(3))}<p>story {i} {'x' * i}</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://h.org/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {i: re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", page(i))).strip() for i in range(12)}


def test_template_of_pages_without_article(spark):
    page = lambda i: f"<html><body><div class=a><p>Welcome to our site</p></div><div class=b><p>story {i} of many</p><p>and part {i * 7}</p></div><div class=c><p>All rights belong to us</p></div></body></html>"
    rows = [(i, "http://h.org/x", page(i), "clash") for i in range(12)] + [(99, None, None, "clash"), (None, "http://h.org/y", "", None)]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3]["text"] == "story 3 of many and part 21" and got[3]["n_chars"] == 27
    assert got[99]["text"] == got[None]["text"] == ""


def test_pages_equal_brute_force(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())


def test_template_inside_the_article(spark):
    """Containers of the template whose class names what lies beside the text go, with constant texts in other containers; the article's own paragraphs stay, even those that all pages share."""
    page = lambda i: f"<html><body><div class=menu{i}>m{i}</div><article><h2 id='social-{i}'>Head {i}</h2><p>Read this first</p><p class=share>story {i}</p><div>Print</div><div class=share>sent {i} times</div></article></body></html>"
    df = spark.createDataFrame([(i, "http://h.org/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {i: f"Head {i} Read this first story {i}" for i in range(12)}


def test_tokens_differ_by_the_tags_around_them(spark):
    """A text that is constant in the foot of each page is a page's own text elsewhere."""
    page = lambda i: f"<html><body><div class=b><p>story {i}</p>{'<p>Call us</p>' if i == 3 else ''}</div><ul class=c><li>Call us</li></ul></body></html>"
    df = spark.createDataFrame([(i, "http://h.org/x", page(i)) for i in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == {i: f"story {i}" + (" Call us" if i == 3 else "") for i in range(12)}


def test_copies_of_a_page_are_no_template(spark):
    mirror = "<html><body><div class=a><h1>A story</h1><p>of some length</p></div><div class=b><p>and its end</p></div></body></html>"
    df = spark.createDataFrame([(i, "http://h.org/x", mirror) for i in range(8)] + [(9, "http://h.org/y", "<p>other</p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got == dict.fromkeys(range(8), "A story of some length and its end") | {9: "other"}


def test_score_is_the_smooth_maximum_of_word_averages():
    rng = np.random.default_rng(4)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS), -1.5, 0.7, 0.2)
    texts = ["You FOOL, stop it now", "a", "", None, "??", "é漢 und so weiter " * 50, "x" * 300]
    grams = lambda w, n: [toxicity._gram_buckets(np.frombuffer(g, np.uint8), n)[0] for g in (w[i : i + n] for i in range(len(w) - n + 1))]
    want = []
    for t in texts:
        logits = []
        for word in alnum(t):
            edged = b" " + word.encode() + b" "
            own = [model.weight[g] for n in toxicity.GRAMS for g in grams(edged, n)]
            logits.append(sum(own) / max(1, len(own)) + model.bias)
        sharp = toxicity.SHARPNESS
        z = np.log(sum(np.exp(sharp * x) for x in logits)) / sharp if logits else None
        want.append(0.0 if z is None else 1 / (1 + np.exp(-(model.scale * z + model.offset))))
    got = np.concatenate([model.score(toxicity.text_logits(t, model)) for _, _, t in slices(pa.array(texts), lower=True)])
    assert np.allclose(got, want)


def test_the_threshold_lies_where_most_more_toxic_texts_are_above():
    score = lambda z, y: toxicity.Model(np.zeros(1), 0, *toxicity._calibrated(np.array(z, float), np.array(y, float), np.ones(len(z)))).score(np.array(z, float))
    assert (score([5, 4, 3, 0, -1], [1, 1, 0, 0, 0]) >= 0.7).tolist() == [True, True, False, False, False]
    assert not (score([5, 4, 3], [0, 1, 0]) >= 0.7).any()  # no cut gains
    assert not (score([2, 2, 2, 1], [1, 0, 0, 0]) >= 0.7).any()  # equal logits stay together
    assert (score([1, 2], [1, 1]) >= 0.7).all()


OUTSIDE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {shared!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from postmill.llm import decontamination, toxicity
docs = spark.createDataFrame([(1, "you damn fool", "en"), (2, "a fine day for all of them", "en"), (3, "damn fools", "en"), (4, "damn fool there", "en"), (5, "quite fine", "en")], "doc_id int, text string, lang string")
bench = spark.createDataFrame([(1, "a fine day for all of them")], "item_id int, text string")
labels = spark.createDataFrame([(n, int(n in (1, 3, 4))) for n in range(1, 6)], "doc_id int, toxic int")
assert [r["doc_id"] for r in decontamination.find_contamination(docs, bench).where("contaminated").collect()] == [2]
assert toxicity.score(docs, toxicity.train_on(docs, labels)).count() == 5
print("well")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """From a folder and with a path that workers don't have."""
    code = OUTSIDE.format(repo=str(Path(__file__).parents[2]), shared=f"file://{tmp_path}")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.stdout.strip().endswith("well"), run.stderr[-3000:]
