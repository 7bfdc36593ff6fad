"""MinHash near-duplicates: banded minima of many universal hashes, verified, then components.

Nodes are the distinct sets of shingles, so copies are one node. A signature holds the minimum of each of
``bands * rows`` multiply-add hashes over a set's shingles; sets that agree on all minima of a band share
its bucket. A band's length grows with the number of documents, and the bands are as many as leave a
pair at the threshold without a bucket with a probability of ``MISS`` at most.

A bucket never gives out its pairs. First each member meets the bucket's least node alone: of the centres whose
signature agrees, a member is held against the likeliest one on full sets, then against the others that it isn't joined with yet;
large-star and small-star rounds turn confirmed links into components. What is left are members outside of their
bucket's largest component. They meet its members in cells of at most ``CHUNK`` by ``CHUNK``; signatures tell which
rows have a likely partner, and of these full sets tell the links, of which one for each stranger and component comes out. So groups
of copies cost as many comparisons as they have members, what a cell gives out grows with its rows, and no link between different
components is passed over.

Full sets (64-bit hashes of shingles) are made from the texts again, only for nodes with a likely partner. A centre with many
members is repeated, its members dealt over its copies.

Defined results: a null text, and one without words, has an empty set and is linked with nothing, not even its equals; a text of one
word is one shingle; equal rows give equal rows; a component whose ids are all null has a null id, and its rows are kept; rows
of a null id in another component aren't; an empty table gives an empty result; texts of any length count whole; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._keys import spread_join
from ._shared import small_batches, table, written
from ._words import NOT_SPACE, Texts, mixed, slices, window_hashes
from .simhash import components

SHINGLE, PERCENT = 2, 80  #: Fixed values of the contract.
MISS = 1e-7  # probability that a pair at the threshold shares no bucket
ROWS = ((1 << 22, 5), (1 << 28, 6), (1 << 36, 8))  # documents up to which a band has so many minima; 10 beyond
DEVIATIONS = 5  # a signature's estimate may be so many standard deviations below the threshold
CHUNK = 1024
FILTER_BITS = 1 << 27  # of the bitmap that is broadcast: 16 MB at most
RUN = 1 << 16  # shingles hashed at a time


def banding(documents: int, percent: int = PERCENT) -> tuple[int, int]:
    """(bands, minima to a band)."""
    rows = next((r for most, r in ROWS if documents <= most), 10)
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows)), rows


def least_agreement(hashes: int, percent: int = PERCENT) -> float:
    """The share of equal minima under which a pair isn't held against full sets."""
    s = percent / 100
    return s - DEVIATIONS * math.sqrt(s * (1 - s) / hashes)


def shingle_sets(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts (lower-cased), sorted within each, and the place of each text's first."""
    words = texts.words(NOT_SPACE)
    hashes, counts, owner = words.hashes(), words.counts, words.text_of()
    last = np.repeat(words.first[1:], counts)
    long = window_hashes(hashes, size)
    whole = np.arange(len(long)) + size <= last[: len(long)]
    found = [(owner[: len(long)][whole], long[whole])]
    for k in range(1, size):  # texts of fewer words are one shingle
        short = np.flatnonzero(counts == k)
        found.append((short, window_hashes(hashes, k)[words.first[short]] if len(short) else np.empty(0, np.uint64)))
    owner, shingles = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    return shingles[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def signatures(shingles: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """A row of ``hashes`` minima for each set; those of empty sets mean nothing."""
    rng = np.random.default_rng(13)
    a, b = (rng.integers(0, 1 << 32, hashes, np.uint32) for _ in range(2))
    a |= np.uint32(1)
    out = np.full((len(first) - 1, hashes), np.uint32(0xFFFFFFFF))
    short = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(first))
    lo = 0
    while lo < len(full):  # whole sets, or runs of one that is longer
        hi = max(lo + 1, int(np.searchsorted(first[full], first[full[lo]] + RUN)))
        begin, end = first[full[lo]], first[full[hi - 1] + 1]
        cuts = first[full[lo:hi]] - begin
        for at in range(begin, end, RUN) if hi == lo + 1 else [begin]:
            own = short[at : min(end, at + RUN)] if hi == lo + 1 else short[begin:end]
            for k in range(hashes):
                least = np.minimum.reduceat(own * a[k] + b[k], cuts)
                out[full[lo:hi], k] = np.minimum(out[full[lo:hi], k], least)
        lo = hi
    return out


def digests(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell a set: sums of its shingles' hashes."""
    total = np.zeros((2, len(shingles) + 1), np.uint64)
    for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
        np.cumsum(mixed(shingles ^ np.uint64(salt)), out=total[k, 1:])
    of = total[:, first[1:]] - total[:, first[:-1]]
    return of[0].view(np.int64), of[1].view(np.int64)


def _binary(parts: np.ndarray, offsets: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(parts).view(np.uint8).reshape(-1)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def _matrix(column: pa.Array, hashes: int) -> np.ndarray:
    """Signatures of a binary column as rows of numbers."""
    raw = b"".join(x.as_buffer() for x in column)
    return np.frombuffer(raw, np.uint32).reshape(-1, hashes)


def with_signatures(rows: DataFrame, hashes: int, size: int = SHINGLE) -> DataFrame:
    """(id, row_key, text) to (id, row_key, n, s1, s2, sig): size, two digests and signature of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in slices(b["text"], lower=True):
                sets, first = shingle_sets(texts, size)
                s1, s2 = digests(sets, first)
                sig = _binary(signatures(sets, first, hashes), np.arange(hi - lo + 1) * 4 * hashes)
                yield pa.RecordBatch.from_arrays([b["id"][lo:hi], b["row_key"][lo:hi], pa.array(np.diff(first)), pa.array(s1), pa.array(s2), sig], names=["id", "row_key", "n", "s1", "s2", "sig"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row_key bigint, n bigint, s1 bigint, s2 bigint, sig binary")


class _Search:
    """Nodes, buckets and the links that have been confirmed so far."""

    def __init__(self, rows: DataFrame, documents: int, size: int, percent: int):
        self.rows, self.size, self.percent, self.spark = rows, size, percent, rows.sparkSession
        self.bands, self.band_rows = banding(documents, percent)
        self.hashes = self.bands * self.band_rows
        self.prints = written(self.spark, with_signatures(rows, self.hashes, size), "minima")
        # One row stands for a set; the digests are held against the set that is made of its text again.
        nodes = self.prints.where("n > 0").groupBy("s1", "s2").agg(F.max("n").alias("n"), F.max("sig").alias("sig"), F.min("row_key").alias("row_key"), F.min("id").alias("least_id"), F.count("*").alias("copies"))
        self.nodes = written(self.spark, nodes.withColumn("node", F.monotonically_increasing_id()), "sets")
        self.n_nodes, self.edges, self.sets = self.nodes.count(), None, None

    def buckets(self) -> DataFrame:
        """(key, band, node, center, n): members of all buckets of two or more."""
        keys = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.substring("sig", 4 * self.band_rows * b + 1, 4 * self.band_rows)).alias("key")) for b in range(self.bands)]
        banded = self.nodes.select("node", F.inline(F.array(*keys)))
        shared = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("center")).where("n > 1")
        shared = written(self.spark, shared, "buckets")
        return written(self.spark, spread_join(banded, shared, "key", total=self.n_nodes * self.bands, heavy=shared.select("key", "n")), "members")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(u, v, agree) of those pairs whose sizes and signatures allow a link."""
        total, hashes, percent, least = pairs.count(), self.hashes, self.percent, least_agreement(self.hashes, self.percent)
        sides = pairs
        for side in "uv":
            own = self.nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
            sides = spread_join(sides, own, side, total=total)
            if side == "v":
                sides = sides.where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                agree = (_matrix(b["sig_u"], hashes) == _matrix(b["sig_v"], hashes)).mean(axis=1)
                near = pa.array(agree >= least)
                yield pa.RecordBatch.from_arrays([b["u"].filter(near), b["v"].filter(near), pa.array(agree).filter(near)], names=["u", "v", "agree"])

        return written(self.spark, sides.select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u bigint, v bigint, agree double"), "likely")

    def add_sets(self, wanted: DataFrame) -> None:
        """Makes the sets of nodes that haven't any yet, from the texts again.

        Tasks pass over texts that no wanted row can be, by a bitmap of at most ``FILTER_BITS``; what it lets through by chance goes in the join."""
        wanted = wanted.distinct() if self.sets is None else wanted.distinct().join(self.sets.select("node"), "node", "left_anti")
        wanted = written(self.spark, wanted.join(self.nodes.select("node", "row_key", "s1", "s2"), "node"), "wanted")
        if wanted.isEmpty():
            return
        bit = F.pmod(F.xxhash64("row_key"), F.lit(FILTER_BITS))
        maps = wanted.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("map")).collect()
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for r in maps:  # buckets of 32,768 bits; both count from 1
            own = np.frombuffer(r["map"], np.uint8)
            bits[(r["no"] - 1) * 4096 : (r["no"] - 1) * 4096 + len(own)] = own
        shared, size = self.spark.sparkContext.broadcast(bits), self.size

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b["bit"].to_numpy()
                b = b.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
                for lo, hi, t in slices(b["text"], lower=True):
                    whole, first = shingle_sets(t, size)
                    s1, s2 = digests(whole, first)
                    yield pa.RecordBatch.from_arrays([b["row_key"][lo:hi], pa.array(s1), pa.array(s2), _binary(whole, first * 8)], names=["row_key", "of1", "of2", "set"])

        found = self.rows.select("row_key", bit.alias("bit"), "text").mapInArrow(sets, "row_key bigint, of1 bigint, of2 bigint, set binary")
        found = found.groupBy("row_key", "of1", "of2").agg(F.first("set").alias("set"))  # repeated rows become one before they move
        made = found.join(wanted.withColumnRenamed("row_key", "__key"), (F.col("row_key") == F.col("__key")) & (F.col("of1") == F.col("s1")) & (F.col("of2") == F.col("s2"))).select("node", "set")
        made = written(self.spark, made, "node-sets")
        self.sets = made if self.sets is None else self.sets.unionByName(made)

    def add_edges(self, found: DataFrame) -> None:
        found = written(self.spark, found, "links")
        self.edges = found if self.edges is None else self.edges.unionByName(found)

    def confirm(self, pairs: DataFrame) -> None:
        """Adds the pairs (u, v) that full sets confirm: each v is held against its u."""
        pairs = written(self.spark, pairs, "asked")
        share = max(CHUNK, pairs.count() // CHUNK)
        centers = pairs.groupBy("u").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
        hot = F.broadcast(centers.where("salts > 1").withColumnRenamed("u", "hot"))  # at most CHUNK rows
        salt = F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int")
        members = pairs.join(hot, F.col("u") == F.col("hot"), "left").select(F.col("v").alias("node"), "u", salt.alias("salt"), F.lit(True).alias("member"))
        own = centers.select(F.col("u").alias("node"), "u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
        places = members.unionByName(own).groupBy("node").agg(F.collect_list(F.struct("u", "salt", "member")).alias("places"))
        percent = self.percent

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Sets sorted by place, a centre before its members."""
            center, of = np.empty(0, np.uint64), (None, None)
            for b in batches:
                u, v = [], []
                for cu, salt, member, node, raw in zip(*(b[c].to_pylist() for c in ("u", "salt", "member", "node")), b["set"], strict=True):
                    own = np.frombuffer(raw.as_buffer(), np.uint64)
                    if not member:
                        center, of = own.copy(), (cu, salt)
                    elif of == (cu, salt):
                        at = np.minimum(np.searchsorted(center, own), len(center) - 1)
                        both = int(np.count_nonzero(center[at] == own))
                        if 100 * both >= percent * (len(center) + len(own) - both):
                            u.append(cu), v.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        dealt = self.sets.join(places, "node").select("node", "set", F.inline("places")).repartition("u", "salt").sortWithinPartitions("u", "salt", "member")
        self.add_edges(dealt.select("u", "salt", "member", "node", "set").mapInArrow(compare, "u bigint, v bigint"))

    def roots(self) -> DataFrame:
        """(node, root) of the nodes that confirmed links join so far."""
        return written(self.spark, components(self.edges), "roots")

    def apart(self, pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose ends aren't joined yet."""
        for side in "uv":
            own = roots.select(F.col("node").alias(f"of_{side}"), F.col("root").alias(f"root_{side}"))
            pairs = pairs.join(own, F.col(side) == F.col(f"of_{side}"), "left")
        return pairs.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v")

    def cells(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        """(key, band, i, j, partner, node, root): the buckets of three or more that are of several components, in cells of at most ``CHUNK`` strangers by ``CHUNK`` members.

        Strangers are the members outside a bucket's largest component. So its pairs within that component are in no cell."""
        of = members.where("n > 2").join(roots, "node", "left").select("key", "band", "node", F.coalesce("root", "node").alias("root"))
        parts = of.groupBy("key", "root").agg(F.count("*").alias("size"))
        main = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("n"))
        main = written(self.spark, main.where("main.size < n").select("key", "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.size")).alias("strangers")), "open")
        opened = spread_join(of, main, "key", total=members.count(), heavy=main.select("key", "n"))
        opened = written(self.spark, opened.select("key", "band", "n", "strangers", "node", "root", (F.col("root") != F.col("main")).alias("stranger")), "opened")
        ceil = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
        every = lambda n: F.sequence(F.lit(0), ceil(n) - 1)
        own = lambda n: F.pmod(F.xxhash64("node"), ceil(n)).cast("int")
        asking = opened.where("stranger").select("key", "band", own("strangers").alias("i"), F.explode(every("n")).alias("j"), F.lit(False).alias("partner"), "node", "root")
        asked = opened.select("key", "band", F.explode(every("strangers")).alias("i"), own("n").alias("j"), F.lit(True).alias("partner"), "node", "root")
        return asking.unionByName(asked)

    def likely_cells(self, cells: DataFrame) -> DataFrame:
        """The rows of cells that have a likely partner in another component there. A pair counts in the first band it shares alone."""
        total, hashes, percent, least, width = cells.count(), self.hashes, self.percent, least_agreement(self.hashes, self.percent), self.band_rows
        signed = spread_join(cells, self.nodes.select("node", "n", "sig"), "node", total=total)

        def keep(rows: pa.Table) -> np.ndarray:
            partner, node, root, n, band = (rows[c].to_numpy() for c in ("partner", "node", "root", "n", "band"))
            sig, kept = _matrix(rows["sig"].combine_chunks(), hashes), np.zeros(len(node), bool)
            others = np.flatnonzero(partner)
            for x in np.flatnonzero(~partner):
                some = others[(root[others] != root[x]) & (100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x]))]
                same = sig[some] == sig[x]
                near = same.mean(axis=1) >= least
                some, same = some[near], same[near]
                first = np.argmax(same[:, : self_bands * width].reshape(len(some), self_bands, width).all(axis=2), axis=1)
                hit = some[first == band[x]]
                kept[hit] = True
                kept[x] |= len(hit) > 0
            return kept

        self_bands = self.bands

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _by_cell(batches):
                yield from rows.select(_CELL).filter(pa.array(keep(rows))).combine_chunks().to_batches()

        dealt = signed.select(*_CELL, "n", "sig").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "partner", "node")
        return written(self.spark, dealt.mapInArrow(run, "key bigint, band int, i int, j int, partner boolean, node bigint, root bigint"), "likely-cells")

    def confirm_cells(self, cells: DataFrame) -> None:
        """Adds, for each stranger of a cell and each other component there, the first link that full sets confirm."""
        percent = self.percent
        whole = spread_join(cells, self.sets, "node", total=cells.count())

        def links(rows: pa.Table) -> Iterator[tuple[int, int]]:
            partner, node, root = (rows[c].to_numpy() for c in ("partner", "node", "root"))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"].combine_chunks()]
            sizes = np.array([len(x) for x in sets])
            others = np.flatnonzero(partner)
            for x in np.flatnonzero(~partner):
                own = sets[x]
                some = others[(root[others] != root[x]) & (100 * np.minimum(sizes[others], len(own)) >= percent * np.maximum(sizes[others], len(own)))]
                if not len(some):
                    continue
                joined = np.concatenate([sets[y] for y in some])
                hit = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
                both = np.add.reduceat(hit, np.cumsum(sizes[some]) - sizes[some], dtype=np.int64)
                linked = some[100 * both >= percent * (sizes[some] + len(own) - both)]
                for y in linked[np.unique(root[linked], return_index=True)[1]]:
                    yield int(node[x]), int(node[y])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _by_cell(batches):
                pairs = list(links(rows))
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

        dealt = whole.select(*_CELL, "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "partner", "node")
        self.add_edges(dealt.mapInArrow(run, "u bigint, v bigint"))


_CELL = ["key", "band", "i", "j", "partner", "node", "root"]


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by cell, a cell at a time."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cell = np.stack([b[c].to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = tuple(cell[:, lo].tolist())
            if kept and now != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(lo, hi - lo))
            last = now
    if kept:
        yield pa.Table.from_batches(kept)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id (the least id that links reach) and kept (whether it is the row's own)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("row_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    search = _Search(rows, docs.count(), size, percent)
    members = search.buckets()
    likely = search.likely(members.where("node != center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct())
    roots = spark.createDataFrame([], "node bigint, root bigint")
    if not likely.isEmpty():
        search.add_sets(likely.select(F.explode(F.array("u", "v")).alias("node")))
        search.confirm(likely.groupBy("v").agg(F.max_by("u", F.struct("agree", "u")).alias("u")).select("u", "v"))
        roots = search.roots()
        rest = written(spark, search.apart(likely, roots), "rest")  # other centres of members that aren't joined with them
        if not rest.isEmpty():
            search.confirm(rest)
            roots = search.roots()
    open_cells = search.likely_cells(search.cells(members, roots))
    if not open_cells.isEmpty():
        search.add_sets(open_cells.select("node"))
        search.confirm_cells(open_cells)
        roots = search.roots()

    rooted = search.nodes.select("node", F.struct("s1", "s2").alias("set"), "least_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(spark, rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(rooted.select("set", "root"), ids.select("root", "component_id"), "root", total=search.n_nodes, heavy=ids.select("root", "n")).select("set", "component_id")
    prints = search.prints.select("id", "n", F.when(F.col("n") > 0, F.struct("s1", "s2")).alias("set"))
    empty = prints.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    full = spread_join(prints.where("n > 0").select("id", "n", "set"), named, "set", total=search.prints.count(), heavy=rooted.select("set", F.col("copies").alias("n"))).select("id", "n", "component_id")
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) < {SHINGLE} THEN list_distinct([array_to_string(words, ' ')]) ELSE
    list_distinct(list_transform(range(1, CAST(len(words) AS BIGINT)), lambda i: words[i] || ' ' || words[i + 1])) END AS own, len(words) AS n_words FROM w),
k AS (SELECT doc_id, n_words, CASE WHEN n_words = 0 THEN 0 ELSE len(own) END AS n, CASE WHEN n_words > 0 THEN sha256(array_to_string(list_sort(own), chr(10))) END AS node, own FROM s),
nodes AS (SELECT node, any_value(n) AS n, any_value(own) AS own, min(doc_id) AS least FROM k WHERE node IS NOT NULL GROUP BY node),
t AS (SELECT node, n, unnest(own) AS shingle FROM nodes),
p AS (SELECT x.node AS u, y.node AS v, any_value(x.n) AS nu, any_value(y.n) AS nv, count(*) AS common FROM t x JOIN t y ON x.shingle = y.shingle AND x.node < y.node
    AND 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) GROUP BY 1, 2),
e AS (SELECT u, v FROM p WHERE 100 * common >= {PERCENT} * (nu + nv - common)),
e2 AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT reach.node, e2.v FROM reach JOIN e2 ON reach.other = e2.u),
c AS (SELECT reach.node, min(least) AS component_id FROM reach JOIN nodes ON nodes.node = reach.other GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN k.node IS NULL THEN doc_id ELSE component_id END AS component_id,
    CASE WHEN k.node IS NULL THEN true ELSE doc_id IS NOT DISTINCT FROM component_id END AS kept FROM k LEFT JOIN c ON k.node = c.node"""


QUERIES = {"op13_minhash": op13_minhash}
ORACLE_SQL = {"op13_minhash": _sql()}
