"""The trie of conversation prefixes, by prefix doubling.

Turns get dense names first: equal (role, text) have equal numbers. A block of 2**k turns, at a place that is a
multiple of its length, is named by the pair of its halves, so all blocks have names after as many rounds as
the longest conversation has binary digits. A prefix of d turns is the blocks of d's binary digits, the longest first; going down
again from the longest blocks, it is named by the pair of the prefix without its last block and that block. A number
is given once in all rounds, so a prefix's name is a node of the trie. Each round handles half the rows of the
one below.

Nodes are rows grouped by name. Sums over subtrees need no paths: a node belongs to its smallest member, and what belongs
to one conversation is the lower end of its path. The subtree of a node has the whole ends of its other
members, and of its own smallest member the end from the node on. So one sum over members and one running sum along
each path give them.

No group meets in one task: names of turns that a large share of conversations begins with are salted (``spread_join``), places in
conversations and sums along paths are two-level (``running_within``), everything else is partial sums. A digest has to go
over a node's ids one after another; ids are joined in chunks where they lie, and where a node has several chunks one task
takes a row for each and feeds them to the hash as they come, keeping one at a time.

Defined results: a null role or text is empty; a null turn is first; turns of equal place are in the order of the SHA-256 of
(role, text), so equal rows are turns of their own; rows of a null conv_id belong to no conversation and are left out; a
negative conv_id has its base as SQL's remainder gives it; a conversation that is left without turns is a member of the
root; an empty table has no nodes; texts of any length are read once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._keys import dense_names, running_within, spread_join
from ._shared import SPACE_WORD, table, written

FAMILY, HEADS = 20, 4  #: Fixed values of the contract: conversations to a base, and numbers of turns taken from it (0 to 3).
CHUNK = 4096
ROOT = 0  # the root's name


def turns_of(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, name, words) of every turn; turns of equal role and text have equal names, from 1 on."""
    spark = rows.sparkSession
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    content = F.unhex(F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    words = F.regexp_count(text_, F.lit(SPACE_WORD)).cast("long")
    read = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), content.alias("content"), words.alias("words"))
    read = written(spark, read, "turns")
    names, _ = dense_names(read, ["content"], ROOT + 1, "contents")
    named = spread_join(read, names.select("content", "name"), "content", total=read.count(), heavy=names.select("content", "n"))
    placed = running_within(named, "conv", ["turn", "content"], "places", pos=F.lit(1))
    return placed.select("conv", F.col("pos").cast("int").alias("pos"), "name", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first turns taken from its family's base: its turns, and (conv, length) of each, those without turns too."""
    spark = turns.sparkSession
    turns = written(spark, turns, "own")
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = convs.select("conv", "n", (F.col("conv") - F.col("conv") % FAMILY).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    first = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "words"))).alias("head"))  # at most three turns
    convs = convs.join(first.withColumnRenamed("conv", "base"), "base", "left")  # a family has at most FAMILY members
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<pos int, name bigint, words bigint>>")), lambda t: t["pos"] <= F.col("h"))
    convs = written(spark, convs.select("conv", "n", "h", head.alias("head")), "convs")
    taken = convs.select("conv", F.inline("head"))
    own = spread_join(turns, convs.select("conv", "h", F.size("head").alias("m")), "conv", total=turns.count(), heavy=convs.select("conv", "n"))
    own = own.where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "name", "words")
    lengths = convs.select("conv", (F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).cast("int").alias("length"))
    return taken.unionByName(own), lengths


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, name, words): the name of each prefix of one turn or more, and the words of its last turn."""
    spark = turns.sparkSession
    blocks = [written(spark, turns.select("conv", (F.col("pos") - 1).alias("at"), "name", "words"), "blocks0")]
    total, free = blocks[0].count(), (blocks[0].agg(F.max("name")).first()[0] or ROOT) + 1
    while total:
        half = F.col("at") % 2 == 0
        both = blocks[-1].groupBy("conv", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(half, F.col("name"))).alias("left"), F.max(F.when(~half, F.col("name"))).alias("right"), F.max(F.when(~half, F.col("words"))).alias("words"))
        both = written(spark, both.where("left IS NOT NULL AND right IS NOT NULL"), "halves")
        total = both.count()
        if total:
            named, free = _named(both, total, free)
            blocks.append(written(spark, named, f"blocks{len(blocks)}"))
    done = None
    for k in reversed(range(len(blocks))):
        ends = blocks[k].where("at % 2 = 0").select("conv", "at", F.shiftleft("at", k).alias("before"), F.col("name").alias("right"), "words")
        rest = ends.where("at = 0").select("conv", "at", F.lit(ROOT).cast("long").alias("left"), "right", "words")
        if done is not None:
            known = done.select("conv", F.col("depth").alias("before"), F.col("name").alias("left"))
            rest = rest.unionByName(ends.where("at > 0").join(known, ["conv", "before"]).select("conv", "at", "left", "right", "words"))
        rest = written(spark, rest, "steps")
        named, free = _named(rest, rest.count(), free)
        of_round = written(spark, named.select("conv", F.shiftleft(F.col("at") + 1, k).alias("depth"), "name", "words"), f"prefixes{k}")
        done = of_round if done is None else done.unionByName(of_round)
    return done


def _named(pairs: DataFrame, total: int, free: int) -> tuple[DataFrame, int]:
    """Rows (conv, at, left, right, words) with one name for each pair, from ``free`` on, and the next free name."""
    spark = pairs.sparkSession
    pairs = pairs.withColumn("pair", F.struct("left", "right"))
    names, free = dense_names(pairs, ["pair"], free, "names")
    named = spread_join(pairs.select("conv", "at", "words", "pair"), names.select("pair", "name"), "pair", total=total, heavy=names.select("pair", "n"))
    return named.select("conv", "at", "name", "words"), free


def digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of each name of rows (name, conv): SHA-256 of its ids, ascending, comma-joined."""
    spark = ends.sparkSession
    placed = written(spark, ends.repartitionByRange("name", "conv").withColumn("part", F.spark_partition_id()), "ends")
    nth = F.row_number().over(Window.partitionBy("part", "name").orderBy("conv")) - 1
    chunks = placed.withColumn("chunk", F.floor(nth / CHUNK)).groupBy("name", "part", "chunk").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    chunks = written(spark, chunks.select("name", "part", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")), "chunks")
    many = chunks.groupBy("name").agg(F.count("*").alias("n"), F.max("ids").alias("ids"))
    single = many.where("n = 1").select("name", F.sha2("ids", 256).alias("ends_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks sorted by name, part and chunk."""
        name, state = None, None
        for b in batches:
            out: list[tuple[int, str]] = []
            for n, ids in zip(b["name"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if n == name:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((name, state.hexdigest()))
                    name, state = n, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], names=["name", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    rest = chunks.join(many.where("n > 1").select("name"), "name", "left_semi").repartition("name").sortWithinPartitions("name", "part", "chunk")
    return single.unionByName(rest.select("name", "ids").mapInArrow(run, "name bigint, ends_sha256 string"))


def trie(rows: DataFrame, **columns: str) -> DataFrame:
    """A row for each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = rows.sparkSession
    turns, lengths = rebuilt(turns_of(rows, **columns))
    paths = lengths.select("conv", F.lit(0).alias("depth"), F.lit(ROOT).cast("long").alias("name"), F.lit(0).cast("long").alias("words"))
    found = prefixes(turns)
    paths = written(spark, paths.unionByName(found.select("conv", F.col("depth").cast("int").alias("depth"), "name", "words")), "paths")
    nodes = written(spark, paths.groupBy("name").agg(F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.count("*").alias("n"), F.first("words").alias("words")), "nodes")
    n_nodes = nodes.count()

    # The name of each node's parent: the prefix of its smallest member that is a turn shorter.
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    linked = written(spark, nodes.join(above, ["conv", "depth"], "left"), "linked")
    children = linked.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children.withColumnRenamed("parent", "name"), "name", "left").fillna(0, ["n_children"])
    nodes = nodes.withColumn("saved", (F.col("n") - 1) * F.col("words"))
    upto = written(spark, running_within(nodes, "conv", ["depth"], "ends-of-paths", upto=F.col("saved")), "upto")
    whole = upto.groupBy("conv").agg(F.sum("saved").alias("whole"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    whole = whole.where("whole > 0 OR leaf > 0")
    sizes = lengths.select("conv", (F.col("length") + 1).alias("n"))
    below = spread_join(paths.select("name", "conv"), whole, "conv", total=paths.count(), heavy=sizes).groupBy("name").agg(F.sum("whole").alias("below"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    of_parent = spread_join(linked.where("parent IS NOT NULL").select("name", "parent"), parents, "parent", total=n_nodes, heavy=children.select("parent", F.col("n_children").alias("n")))
    ends = digests(paths.join(lengths.withColumnRenamed("length", "depth"), ["conv", "depth"]).select("name", "conv"))
    joined = upto.join(below, "name", "left").join(of_parent.drop("parent"), "name", "left").join(ends, "name", "left")
    saved = F.coalesce("below", F.lit(0)) - (F.col("upto") - F.col("saved"))
    return joined.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def _sql() -> str:
    return f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))) AS t),
own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', role, text))) AS p FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT c, c - c % {FAMILY} AS base, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % {HEADS} AS h FROM (SELECT DISTINCT c FROM own), crc),
heads AS (SELECT conv.c, p AS pos, role, text FROM conv JOIN own ON own.c = base AND p <= h),
taken AS (SELECT c, count(*) AS m FROM heads GROUP BY c),
built AS (SELECT * FROM heads UNION ALL SELECT c, p - h + coalesce(m, 0), role, text FROM own JOIN conv USING (c) LEFT JOIN taken USING (c) WHERE p > h),
whole AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM built GROUP BY c),
path AS (SELECT c, d, CASE WHEN d = 0 THEN 'root' ELSE sha256(CAST(to_json(turns[:d]) AS VARCHAR)) END AS node, coalesce(len(turns), 0) AS length,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].text, '{SPACE_WORD}')) END AS words
    FROM (SELECT c, turns, unnest(range(CAST(coalesce(len(turns), 0) + 1 AS BIGINT))) AS d FROM conv LEFT JOIN whole USING (c))),
node AS (SELECT node, d, min(c) AS c, count(*) AS n, min(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (length = d), '')) AS ends FROM path GROUP BY ALL),
up AS (SELECT node.*, path.node AS parent FROM node LEFT JOIN path ON path.c = node.c AND path.d = node.d - 1),
child AS (SELECT parent AS node, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY 1),
sub AS (SELECT path.node, sum((n - 1) * node.words) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM node LEFT JOIN child USING (node) JOIN path ON path.c = node.c AND path.d <= node.d GROUP BY 1)
SELECT up.c AS conv_id, CAST(up.d AS BIGINT) AS depth, p.c AS parent_conv_id, up.n AS n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, up.ends AS ends_sha256
FROM up LEFT JOIN child USING (node) LEFT JOIN sub USING (node) LEFT JOIN node p ON p.node = up.parent"""


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLE_SQL = {"op12_conversation_trie": _sql()}
