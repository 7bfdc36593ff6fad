"""Benchmark decontamination with a broadcast hash set of the benchmark's word windows.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words, but not none, is one
window. Each task hashes its texts' windows, looks them up in the broadcast set, and verifies every
hit by the words themselves, so that a hash can't make a hit. Rows never move between tasks.

What is broadcast grows with the benchmark, so its size is checked first. Items are cut into pieces of
at most ``PIECE`` windows, repeated pieces of an item count once, and pieces are dealt to as many sets
as it takes for each to hold at most ``max_bytes``, as counted. The documents pass one set after
another, each adding its hits, with a table written in between, so that no task holds two sets.

Defined results: a null text has no words and isn't contaminated; an item without words hits
nothing; items that repeat count once by id, and items without an id mark words but aren't listed;
equal rows give equal rows; empty tables give empty or clean results. New columns replace columns
of ``docs`` of the same name; all others are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ASCII_LOWER, ASCII_UPPER, mapped, small_batches, table, written
from ._words import ALNUM, Words, slices, window_hashes

PIECE = 4096
WINDOW = 13  #: Fixed value of the contract.
MIN_SHARE = 20  #: Fixed value of the contract: contaminated from a 20th of the words on.
MAX_BROADCAST_BYTES = 8 << 20  # of text; a set takes about seven times as much in memory

NO_WORD = "".join(c for c in map(chr, range(128)) if not c.isalnum())
_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
_NEW = {"n_words": pa.int64(), "hit_spans": _SPANS, "hit_items": pa.list_(pa.string())}
_DDL = "n_words bigint, hit_spans array<struct<first:int,after:int>>, hit_items array<string>"


class WindowSet:
    """The windows of some items in flat arrays: by size, the sorted hashes and the words they start at."""

    def __init__(self, items: list[tuple], size: int):
        self.ids = [i for i, _ in items]
        self.seen: dict[tuple[int, int], dict[bytes, set]] = {}  # windows that texts have hit, by size and hash
        parts, base = [], 0
        for lo, _, texts in slices(pa.array([text for _, text in items], pa.string()), lower=True):
            w = texts.words(ALNUM)
            parts.append((texts.data, w.starts + base, w.ends + base, w.text_of() + lo, w.hashes(), w.counts))
            base += len(texts.data)
        none = (np.empty(0, np.uint8), *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64), np.empty(0, np.int64))
        self.data, self.starts, self.ends, self.owner, hashes, counts = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        last, own = np.repeat(np.cumsum(counts), counts), np.minimum(np.repeat(counts, counts), size)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(own).tolist():
            at = window_hashes(hashes, k)
            place = np.flatnonzero((np.arange(len(at)) + k <= last[: len(at)]) & (own[: len(at)] == k))
            place = place[np.argsort(at[place], kind="stable")]
            quick = np.zeros(1 << 20, bool)  # lets few hashes pass that aren't there
            quick[at[place] & np.uint64((1 << 20) - 1)] = True
            self.by_size[k] = (quick, at[place], place)

    @classmethod
    def of(cls, arrays: dict) -> WindowSet:
        made = cls.__new__(cls)
        vars(made).update(arrays)
        return made

    def _windows(self, k: int, h: int, places: np.ndarray) -> dict[bytes, set]:
        """The word sequences behind a hash, with the ids of their items."""
        if (k, h) not in self.seen:
            found = defaultdict(set)
            for at in places.tolist():
                words = (self.data[self.starts[j] : self.ends[j]].tobytes() for j in range(at, at + k))
                found[b" ".join(words)].add(self.ids[self.owner[at]])
            self.seen[k, h] = found
        return self.seen[k, h]

    def hits(self, w: Words) -> list[tuple[int, int, set]]:
        """(first word, size, ids) of every window of the texts that is in the set."""
        out, hashes, last = [], w.hashes(), np.repeat(w.first[1:], w.counts)
        for k, (quick, known, place) in sorted(self.by_size.items()):
            at = window_hashes(hashes, k)
            maybe = np.flatnonzero(quick[at & np.uint64((1 << 20) - 1)] & (np.arange(len(at)) + k <= last[: len(at)]))
            lo, hi = np.searchsorted(known, at[maybe], "left"), np.searchsorted(known, at[maybe], "right")
            for i, a, b in zip(maybe[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                ids = self._windows(k, int(at[i]), place[a:b]).get(b" ".join(w.bytes_of(j) for j in range(i, i + k)))
                if ids is not None:
                    out.append((i, k, ids))
        return out


def _scan(batch: pa.RecordBatch, windows: WindowSet, text: str) -> pa.RecordBatch:
    """Adds the hits of one set to what earlier ones have found."""
    names = batch.schema.names
    had = "hit_spans" in names
    n_words, spans, items = [], [], []
    for lo, hi, texts in slices(batch.column(names.index(text)), lower=True):
        w = texts.words(ALNUM)
        cover, of = np.zeros(len(w) + 1, np.int64), defaultdict(set)
        owner = w.text_of()
        for i, k, ids in windows.hits(w):
            cover[i] += 1
            cover[i + k] -= 1
            of[int(owner[i])] |= ids
        if had:
            for i, (old, old_items) in enumerate(zip(batch["hit_spans"][lo:hi].to_pylist(), batch["hit_items"][lo:hi].to_pylist(), strict=True)):
                of[i] |= set(old_items)
                for s in old:
                    cover[w.first[i] + s["first"]] += 1
                    cover[w.first[i] + s["after"]] -= 1
        hit = np.cumsum(cover)[:-1] > 0
        for i in range(hi - lo):
            own = np.concatenate([[0], hit[w.first[i] : w.first[i + 1]].view(np.int8), [0]]) if of.get(i) else np.zeros(2, np.int8)
            edge = np.diff(own)
            spans.append([{"first": a, "after": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
            items.append(sorted(of[i], key=lambda x: (x is None, x)) if i in of else [])
        n_words += w.counts.tolist()
    new = dict(zip(_NEW, (n_words, spans, items), strict=True))
    kept = [(n, batch.column(i)) for i, n in enumerate(names) if n not in _NEW]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(v, _NEW[k]) for k, v in new.items()], names=[n for n, _ in kept] + list(new))


def item_pieces(benchmark: DataFrame, item_id: str, item_text: str, size: int) -> DataFrame:
    """(id, text, bytes) of the items' pieces, each once: PIECE windows, so pieces overlap by all words of a window but one."""
    lower = F.translate(F.coalesce(F.col(item_text).cast("string"), F.lit("")), ASCII_UPPER + NO_WORD, ASCII_LOWER + " " * len(NO_WORD))
    words = benchmark.select(F.col(item_id).cast("string").alias("id"), F.array_remove(F.split(lower, " "), "").alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(PIECE))
    cut = words.select("id", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, F.lit(PIECE + size - 1)), " "))).alias("text"))
    return cut.distinct().withColumn("bytes", F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)) + 16)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (words, from 0, the end exclusive), hit_items and contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = written(spark, item_pieces(benchmark, item_id, item_text, size), "pieces")
    total = pieces.agg(F.sum("bytes")).first()[0] or 0
    sets = 1 + total // max_bytes
    dealt = lambda: pieces.withColumn("set", F.pmod(F.xxhash64("id", "text"), F.lit(sets)))
    while sets > 1 and (dealt().groupBy("set").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).agg(F.max(F.when(F.col("n") > 1, F.col("b")))).first()[0] or 0) > max_bytes:
        sets *= 2
    out = docs.drop(*_NEW, "n_hit", "contaminated")
    for k in range(sets):
        # Plain arrays: what is broadcast is unpickled before any task function, so a class of this package would have to be installed there.
        shared = spark.sparkContext.broadcast(vars(WindowSet([(r["id"], r["text"]) for r in dealt().where(F.col("set") == k).collect()], size)))
        plain = out.drop(*_NEW)
        added = _DDL
        out = written(spark, out, "decontamination") if k else out
        out = mapped(out, lambda batches, shared=shared: (_scan(b, WindowSet.of(shared.value), text) for b in batches), added, dropped=tuple(c for c in out.columns if c not in plain.columns))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["after"] - s["first"])
    out = out.withColumn("n_hit", n_hit).withColumn("hit_items", F.array_compact("hit_items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text: str = "text", **options) -> DataFrame:
    """``documents``: without contaminated rows. ``spans``: all rows, the words of hits taken out of their texts. Columns stay as they are."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in (*_NEW, "n_hit", "contaminated")}
    found = find_contamination(docs.withColumnsRenamed(own), benchmark, text=own.get(text, text), **options)
    columns = [F.col("`" + own.get(c, c).replace("`", "``") + "`").alias(c) for c in docs.columns]
    if mode == "documents":
        return found.where(~F.col("contaminated")).select(columns)
    cut = found.select(*columns, F.col("hit_spans").alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts = b.schema.names.index(text), []
            for lo, hi, t in slices(b.column(at), lower=True):
                w = t.words(ALNUM)
                for i, spans in zip(range(lo, hi), b["__spans"][lo:hi].to_pylist(), strict=True):
                    whole, begin, out, done = b.column(at)[i], t.offsets[i - lo], [], 0
                    raw = whole.as_buffer().to_pybytes() if whole.is_valid else b""
                    for s in spans:
                        out.append(raw[done : w.starts[w.first[i - lo] + s["first"]] - begin])
                        done = w.ends[w.first[i - lo] + s["after"] - 1] - begin
                    texts.append((b"".join(out) + raw[done:]).decode() if whole.is_valid else None)
            kept = [n for n in b.schema.names if n not in (text, "__spans")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(texts, pa.string())], names=[*kept, text])

    done = mapped(cut, run, "__text string", dropped=(text, "__spans"))
    return done.select(*(F.col("__text").alias(c) if c == text else F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort("hit_items")
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
k AS (SELECT item_id, words, CAST(least({WINDOW}, len(words)) AS BIGINT) AS n FROM b WHERE len(words) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS gram FROM (SELECT item_id, n, words, unnest(range(1, CAST(len(words) - n + 2 AS BIGINT))) AS i FROM k)),
sizes AS (SELECT DISTINCT n FROM g),
w AS (SELECT doc, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
      FROM (SELECT doc, n, words, unnest(range(1, CAST(len(words) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(words) >= n)),
h AS (SELECT doc, i, w.n AS n, item_id FROM w JOIN g ON w.gram = g.gram AND w.n = g.n),
c AS (SELECT doc, count(DISTINCT place) AS n_hit FROM (SELECT doc, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc, i, n FROM h)) GROUP BY doc),
x AS (SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {MIN_SHARE} * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (doc) LEFT JOIN x USING (doc)"""
}
QUERIES = {"op2_decontaminate": op2_decontaminate}
