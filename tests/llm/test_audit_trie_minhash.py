"""Filter audit, conversation trie and MinHash groups against plain Python."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postmill.llm import _keys, conversation_trie, filter_audit, minhash
from postmill.llm._words import slices


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Filter audit


def audit_by_hand(docs, labels):
    first, rows = {}, []
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, part in docs:
        w, body = spaced(t), t or ""
        fails = "".join(x for x, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", body)) > 3 * len(body), re.search("[#$%&*|]", body) is not None,
            i is not None and first[body] < i), strict=True) if bad)
        rows.append((part or "", fails, any(a == i and q == 1 for a, q, _ in labels if a is not None), any(a == i and x == 1 for a, _, x in labels if a is not None)))
    out = set()
    for part in {r[0] for r in rows}:
        own, removed_of, steps = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = own
            for n, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_of[f] += len(gone)
                again = sum(f in r[1] for r in own) - len(gone)
                steps.append((part, "".join(order), n + 1, len(left), len(gone), again, sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f))
        out |= {(*s[:-1], removed_of[s[-1]]) for s in steps}
    return out


def test_filter_audit(spark, odd_docs, no_docs):
    words = " ".join(f"w{i}" for i in range(220))
    more = [(10, words, "en"), (11, words, "de"), (12, words, None), (11, words, "de"), (None, words, "en"), (13, words + " AB" * 40, "en"), (14, words + " #", "de"), (15, "a b " * 300, "en"), (16, "", "en")]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd_docs.collect()] + more
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id bigint, text string, lang string, part string, mask string, n int")
    labels = [(10, 1, 0), (10, 0, 1), (11, 1, None), (None, 1, 1), (15, None, 1), (99, 1, 1), (11, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == 600 * len({r[0] for r in found}) and set(found) == audit_by_hand(rows, labels)
    assert filter_audit.audit(no_docs, marks).count() == 0
    assert filter_audit.audit(odd_docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_cells_come_back_exactly(spark):
    rng = random.Random(3)
    counted = [("p", bool(m % 2), False, m, rng.randrange(10**12)) for m in range(8)]
    sums = filter_audit.spectrum(spark.createDataFrame(counted, "part string, good boolean, toxic boolean, mask int, n bigint"), 3)
    assert sums.count() == 2 and all(len(r["sums"]) == 8 for r in sums.collect())
    cells = filter_audit.cells(sums, 3).first()
    assert cells["n"] == [c[4] for c in counted] and cells["good"] == [c[4] if c[1] else 0 for c in counted] and not any(cells["toxic"])


def test_filters_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "x", "en"), (2, "x", "en"), (3, "xyz", "en")], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, marks, {"S": F.length("text") < 2}).collect()}
    assert set(got) == {("SE", 1), ("SE", 2), ("ES", 1), ("ES", 2)}
    assert (got["SE", 1]["removed"], got["SE", 2]["removed"], got["SE", 2]["redundant"], got["ES", 1]["removed"], got["ES", 2]["removed"]) == (2, 0, 1, 1, 1)
    assert got["SE", 1]["shapley"] == 3 and got["ES", 1]["shapley"] == 1


# Conversation trie


def trie_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest(), (r, t)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = sum(1 for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes))
        saved = sum((len(nodes[p]) - 1) * len(spaced(p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        out.add((min(members), len(path), parent, len(members), sum(len(q) == len(path) + 1 for q in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def odd_conversations():
    rows = [(c, t, "user", f"turn {t % 2} of them") for c in range(1, 40) for t in range(c % 5)]
    rows += [(0, 0, "user", "one two"), (0, 1, "assistant", "three"), (0, 2, "user", "four five six")]
    rows += [(45, 5, "user", "late"), (45, None, "user", "first"), (45, None, None, "first"), (45, 5, "user", "late"), (45, 5, None, None)]
    rows += [(c, 1, "user", "only") for c in (61, 62, 63, 64, 65, 66, 67)] + [(None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(80, t, "user", f"long {t % 3}") for t in range(37)] + [(83, t, "user", f"long {t % 3}") for t in range(37)] + [(99, t, "user", f"long {t % 3}") for t in range(21)]
    return rows + [(104, 0, "u", "x" * 200_000 + " y"), (104, 0, "u", "x" * 200_000 + " y"), (-7, 0, "u", "below zero")]


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("small", [False, True])
def test_conversation_trie(spark, monkeypatch, small):
    rows = [r for r in odd_conversations() if r[0] is None or r[0] >= 0]
    if small:  # hot names, several chunks to a digest
        monkeypatch.setattr(_keys, "LEAST", 3)
        monkeypatch.setattr(_keys, "SHARES", 40)
        monkeypatch.setattr(conversation_trie, "CHUNK", 2)
    table = spark.createDataFrame([(*r, "a", "b") for r in rows], "conv_id bigint, turn bigint, role string, text string, name string, depth string")
    got = conversation_trie.trie(table)
    assert got.columns == NODE
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == trie_by_hand(rows)


def test_tries_of_odd_tables(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert conversation_trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert conversation_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], schema)).count() == 0
    one = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # all its turns are replaced by those of an absent base
    rows = [(one, 0, "a", "b")]
    assert {tuple(r) for r in conversation_trie.trie(spark.createDataFrame(rows, schema)).collect()} == trie_by_hand(rows)


def test_running_sums_over_parts(spark):
    rows = [(k, n) for k in (1, 2, None) for n in range(50 if k == 1 else 3)]
    df = spark.createDataFrame(rows, "k bigint, n bigint")
    got = {(r["k"], r["n"]): r["upto"] for r in _keys.running_within(df, "k", ["n"], "t", upto=F.col("n")).collect()}
    assert got == {(k, n): n * (n + 1) // 2 for k, n in rows}


# MinHash


def sets_by_hand(text):
    words = spaced(lower(text))
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def groups_by_hand(rows):
    sets, root = [sets_by_hand(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    known = lambda ids: min((x for x in ids if x is not None), default=None)
    out = []
    for i, (doc, _) in enumerate(rows):
        c = known(least[find(i)])
        out.append((doc, len(sets[i]), c, doc == c))
    return sorted(out, key=str)


def near_copies():
    rng = random.Random(5)
    rows, n = [], 100
    for size, copies, edits in ((300, 25, 12), (120, 12, 9), (60, 20, 5), (12, 10, 1), (2000, 6, 90)):
        base = [f"b{n}w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(edits + 1)):
                own[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
            rows.append((n, " ".join(own)))
            n += 1
    slide = [f"s{i}" for i in range(200)]
    return rows + [(n + k, " ".join(slide[k * 9 : k * 9 + 100])) for k in range(10)]  # a chain: neighbours are alike, ends aren't


@pytest.mark.parametrize("small", [False, True])
def test_minhash_groups(spark, odd_docs, monkeypatch, small):
    if small:
        monkeypatch.setattr(_keys, "LEAST", 3)
        monkeypatch.setattr(_keys, "SHARES", 40)
        monkeypatch.setattr(minhash, "CHUNK", 3)
        monkeypatch.setattr(minhash, "FILTER_BITS", 1 << 15)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + near_copies() + [(3, "Idiot"), (500, "idiot"), (501, "a  B"), (502, "A b"), (503, "a b a b")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, node string, n int")
    got = minhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == groups_by_hand(rows)


def test_minhash_of_an_empty_table(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(no_docs.unionByName(spark.createDataFrame([(1, None, None, None, None, None, None)], no_docs.schema))).collect()] == [(1, 0, 1, True)]


def test_signatures_tell_similarity():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**6, 4000)]
    for shared in (0.9, 0.8, 0.5):
        other = words[: int(4000 * shared)] + [f"v{i}" for i in rng.integers(0, 10**6, int(4000 * (1 - shared)))]
        sets, firsts = zip(*(minhash.shingle_sets(t) for _, _, t in slices(pa.array([" ".join(words), " ".join(other), ""]), lower=True)), strict=True)
        a, b = (set(sets[0][firsts[0][k] : firsts[0][k + 1]].tolist()) for k in (0, 1))
        sig = minhash.signatures(sets[0], firsts[0], 400)
        assert len(a) == len(sets_by_hand(" ".join(words))) and firsts[0][3] == firsts[0][2]
        assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.08


def test_long_sets_are_hashed_in_runs(monkeypatch):
    sets = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64))
    first = np.array([0, 0, 4000, 4003, 5000])
    whole = minhash.signatures(sets, first, 7)
    monkeypatch.setattr(minhash, "RUN", 64)
    assert (minhash.signatures(sets, first, 7) == whole).all()


def test_banding_misses_at_most_what_it_says():
    for n in (10, 1 << 25, 1 << 33, 1 << 40):
        bands, rows = minhash.banding(n)
        assert (1 - 0.8**rows) ** bands <= minhash.MISS
