"""SimHash near-duplicates with a bit-sliced comparison of fingerprints.

Links are exact. Fingerprints that differ in at most ``radius`` of 64 bits agree on the rest, so
with the bits cut into ``parts`` pieces they agree whole on some ``parts`` - radius of them: each
choice of pieces is a table whose key is those pieces' bits, and linked fingerprints share a bucket
of some table. ``parts`` follows the number of distinct fingerprints, so that buckets stay small.

Within a bucket the bits stand vertically: plane b holds bit b of all fingerprints of a block as one
long integer. A plane against itself, shifted by s places, gives bit b of the differences of all
pairs (i, i + s) at once; a carry-save counter of a few more such integers adds up their distances,
and once every pair of the block is beyond the radius the block is left. What a bucket returns is a
spanning forest of its links, never its pairs. Buckets over ``MAX_BUCKET`` are dealt to a grid of
chunk pairs, so no task holds more than two chunks of a bucket.

``similar_groups`` is for similarities rather than bits. Its fingerprints are ``WIDE_BITS`` long, so that
their distance tells the Jaccard similarity of two texts' shingles: linked shingles agree on a bit with
probability 1 - acos(2s / (1 + s)) / pi. Buckets are by random choices of bits, fewer to a key than the
logarithm of the number of fingerprints, in as many tables as find a pair at the least similarity with
``WIDE_RECALL``. Both numbers follow the data's size; the bucket's work is the same.

Components come from rounds of large-star and small-star over tables in the shared folder. Only
counts reach the driver.

Defined results: a null text, and one without words, has fingerprint zero and is linked like any
other; equal rows give equal rows; a component whose ids are all null has a null id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import remove, small_batches, table, written
from ._words import NOT_SPACE, Texts, mixed, slices, window_hashes

SEED = 42  #: Fixed value of the contract.
SHINGLE, RADIUS = 3, 3
MAX_BUCKET = 4096
HUB_SALTS = 16
BLOCK = 16384
WIDE_BITS, WIDE_SHINGLE, WIDE_SIMILARITY = 512, 5, 0.8
WIDE_RADIUS, WIDE_RECALL = 88, 0.93  # at similarity 0.8 distances are 77 +- 8, at 0.7 98 +- 9, at 0.6 118 +- 10
WIDE_LOAD = 32  # unrelated fingerprints to a bucket
#: parts -> distinct fingerprints up to which its tables' buckets stay small.
PARTS = ((4, 1 << 22), (5, 1 << 30), (6, 1 << 38), (8, 1 << 62))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """``bytes.lower`` and ``bytes.split`` touch ASCII letters and ASCII white space only."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(x) for x in zip(*(words[k:] for k in range(size)), strict=False)] if len(words) >= size else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """id and fp, a signed 64-bit integer, of every row."""
    return with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").cast("binary").alias("__text")), "id", size=size)


def with_fingerprint(rows: DataFrame, *kept: str, size: int = SHINGLE) -> DataFrame:
    """The columns ``kept`` and fp of every row; its text is the binary column __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size) for t in b["__text"]]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*kept, "fp"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", fp bigint")


def masks(radius: int, parts: int) -> list[int]:
    """The bits that each table's key holds, as signed 64-bit integers."""
    edges = [round(k * 64 / parts) for k in range(parts + 1)]
    pieces = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    chosen = [sum(c) for c in combinations(pieces, parts - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def block_forest(fps: np.ndarray, new_bucket: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of a block, the place of its root: roots are equal just where links join them.

    ``fps``: 64-bit integers, one for each fingerprint or a row of several.
    ``new_bucket`` marks the first fingerprint of each bucket. Pairs of different buckets don't count.
    """
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    as_int = lambda flags: int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    planes = [as_int(bits[:, b]) for b in range(bits.shape[1])]
    every = (1 << n) - 1
    width = radius.bit_length()
    spare = (1 << width) - 1 - radius  # counters start here, so that they overflow just beyond the radius
    next_same = as_int(~new_bucket[1:]) if n > 1 else 0
    root, same = np.arange(n), every
    for s in range(1, n):
        same &= next_same >> (s - 1)
        if not same:
            break
        near = same
        counter = [every if spare >> k & 1 else 0 for k in range(width)]
        for b, plane in enumerate(planes):
            carry = plane ^ (plane >> s)
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            near &= ~carry
            if b % 4 == 3 and not near:
                break
        if near:
            at = np.flatnonzero(np.unpackbits(np.frombuffer(near.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))
            _join(root, at, at + s)
    return root


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i], then points everything to its root again."""
    apart = root[a] != root[b]
    if not apart.any():
        return
    for x, y in zip(root[a[apart]].tolist(), root[b[apart]].tolist(), strict=True):
        while root[x] != x:
            x = root[x]
        while root[y] != y:
            y = root[y]
        root[max(x, y)] = min(x, y)
    while (root != root[root]).any():
        root[:] = root[root]


def bucket_edges(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (no, key, cell, node, fingerprint in one or more columns), sorted, to (u, v): a forest of each bucket's links."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
        root = block_forest(np.ascontiguousarray(rows[:, 4:]).view(np.uint64), new, radius)
        child, nodes = np.flatnonzero(root != np.arange(len(root))), rows[:, 3]
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["u", "v"])

    kept = None
    for b in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns], axis=1)
        kept = rows if kept is None else np.concatenate([kept, rows])
        while len(kept) >= BLOCK:
            starts = np.flatnonzero((kept[1:, :3] != kept[:-1, :3]).any(axis=1)) + 1
            starts = starts[starts <= BLOCK] if (starts <= BLOCK).any() else starts[:1]
            if not len(starts):
                break
            yield edges(kept[: starts[-1]])
            kept = kept[starts[-1] :]
    if kept is not None and len(kept):
        yield edges(kept)


def links(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that join just the fingerprints that chains of links join. ``distinct``: column fp, each once, n rows."""
    parts = next((p for p, most in PARTS if n <= most and p > radius), max(8, radius + 2))
    keys = [F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius, parts)]
    return _bucketed(distinct.select(F.col("fp").alias("node"), "fp"), ["fp"], keys, radius)


def _bucketed(prints: DataFrame, columns: list[str], keys: list[Column], radius: int) -> DataFrame:
    """Edges (u, v) between nodes of prints (node, fingerprint in ``columns``) that share a key of the same place in ``keys``."""
    of = [F.struct(F.lit(no).alias("no"), key.alias("key")) for no, key in enumerate(keys)]
    keyed = prints.select("node", *columns, F.inline(F.array(*of)))
    hot = keyed.groupBy("no", "key").count().where(F.col("count") > MAX_BUCKET)
    hot = written(prints.sparkSession, hot.select("no", "key", F.ceil(F.col("count") / MAX_BUCKET).cast("int").alias("chunks")), "hot")
    if hot.isEmpty():
        cells = keyed.select("no", "key", F.lit(0).alias("cell"), "node", *columns)
    else:
        own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        others = F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)
        cell = F.transform(others, lambda j: F.when(F.col("chunks").isNull(), 0).otherwise(F.least(own, j) * F.col("chunks") + F.greatest(own, j)))
        cells = keyed.join(hot, ["no", "key"], "left").select("no", "key", F.explode(cell).alias("cell"), "node", *columns)
    dealt = cells.repartition("no", "key", "cell").sortWithinPartitions("no", "key", "cell", "node")
    return dealt.mapInArrow(lambda batches: bucket_edges(batches, radius), "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (u, v), u != v; the root is the component's least node."""
    spark = edges.sparkSession
    now, last = written(spark, edges, "edges"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(HUB_SALTS - 1))))  # a hub's edges are dealt out
        large = both.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(HUB_SALTS)).cast("int")).join(salted, ["u", "salt"])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(spark, large, "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, written(spark, moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        remove(spark, large)
        remove(spark, before)


def grouped(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: id, fp, root, which names the row's component, and component_id, the least id that links reach."""
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, id_col=id_col, text=text, size=size), "prints")
    nodes = written(spark, prints.groupBy("fp").agg(F.min("id").alias("least_id")), "nodes")
    roots = components(links(nodes.select("fp"), nodes.count(), radius))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = named.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: id, fingerprint (16 hex digits) and component_id, the least id that links reach."""
    groups = grouped(docs, id_col=id_col, text=text, size=size, radius=radius)
    return groups.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide_prints(texts: Texts, size: int = WIDE_SHINGLE) -> np.ndarray:
    """A row of ``WIDE_BITS`` / 64 integers for each text (lower-cased): majorities of the bits of its shingles' hashes; zero without words."""
    words, n = texts.words(NOT_SPACE), len(texts.offsets) - 1
    hashes, counts = words.hashes(), words.counts
    last = np.repeat(words.first[1:], counts)
    long = window_hashes(hashes, size)
    whole = np.arange(len(long)) + size <= last[: len(long)]
    owner = words.text_of()
    rows = [(owner[: len(long)][whole], long[whole])]
    for k in range(1, size):  # texts of fewer words are one shingle
        short = np.flatnonzero(counts == k)
        rows.append((short, window_hashes(hashes, k)[words.first[short]] if len(short) else np.empty(0, np.uint64)))
    owner, shingles = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, shingles = owner[order], shingles[order]
    ones, total = np.zeros((n, WIDE_BITS), np.int64), np.bincount(owner, minlength=n)
    salts = mixed(np.arange(1, WIDE_BITS // 64 + 1, dtype=np.uint64))
    for lo in range(0, len(owner), 1 << 15):
        own = owner[lo : lo + (1 << 15)]
        bits = np.unpackbits(mixed(shingles[lo : lo + (1 << 15), None] ^ salts).view(np.uint8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        cut = np.union1d(cut, np.arange(0, len(own), 255))  # each byte of an integer counts up to 255
        sums = np.add.reduceat(np.ascontiguousarray(bits).view(np.uint64), cut, axis=0).view(np.uint8)
        np.add.at(ones, own[cut], sums)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64)


def wide_masks(n: int, similarity: float = WIDE_SIMILARITY, recall: float = WIDE_RECALL) -> list[tuple[int, int]]:
    """(place of the 64-bit integer, bits of it) for each table of n fingerprints."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    bits = min(48, max(6, math.ceil(math.log2(max(1, n) / WIDE_LOAD))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    rng = np.random.default_rng(tables)
    chosen = [sum(1 << int(b) for b in rng.choice(64, bits, replace=False)) for _ in range(tables)]
    return [(no % (WIDE_BITS // 64), m - (1 << 64) if m >> 63 else m) for no, m in enumerate(chosen)]


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = WIDE_SHINGLE, radius: int = WIDE_RADIUS) -> DataFrame:
    """Per row of ``docs``: id, the hash of its text (Spark's xxhash64), node, which names its fingerprint, and root, which names the group that similar texts form."""
    spark = docs.sparkSession
    columns = [f"f{k}" for k in range(WIDE_BITS // 64)]
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [wide_prints(t, size) for _, _, t in slices(b["text"], lower=True)]
            fps = np.concatenate([np.empty((0, len(columns)), np.uint64), *parts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["id"], b["text_hash"], *(pa.array(np.ascontiguousarray(fps[:, k])) for k in range(len(columns)))], names=["id", "text_hash", *columns])

    prints = written(spark, rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, " + ", ".join(f"{c} bigint" for c in columns)), "wide")
    nodes = written(spark, prints.select(columns).distinct().select(F.monotonically_increasing_id().alias("node"), *columns), "wide-nodes")
    keys = [F.col(columns[k]).bitwiseAND(F.lit(m)) for k, m in wide_masks(nodes.count())]
    roots = components(_bucketed(nodes, columns, keys, radius))
    of = nodes.join(roots.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").select("node", F.coalesce("root", "node").alias("root"), *columns)
    return prints.join(of, columns).select("id", "text_hash", "node", "root")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLE_SQL: dict[str, str] = {}
