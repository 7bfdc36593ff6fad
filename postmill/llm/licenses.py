"""License scans as an exact set-similarity join of text blocks with license templates.

A block is ``BLOCK`` consecutive words of a text, one every ``STRIDE`` words, so that a template of
up to ``STRIDE`` + 1 words lies whole in some block wherever it stands; for longer templates, such as
whole license texts, both grow. A block meets a template if
it holds at least ``least`` of the template's distinct words. The join is exact:

* words are ordered by their count in the whole corpus, the rarest first;
* prefix filter: a block that meets a template holds one of the template's |T| - least + 1 rarest words,
  so only blocks around such words are formed, and they join the templates on them;
* length filter: the block holds at least ``least`` words of any template;
* positional filter: from the first common word on, both have enough words left.

What passes is verified by the size of the intersection within ``SPAN`` times the template's length of words, so that words which
are scattered over a block are no notice, and by the words that tell a template from others, such as a license's name or version: those
that must be in that stretch, and those that must not. Base phrases are templates that must be
met whole, and whose words must then stand consecutively. Words of no template can't be in an
intersection, so they get no place in the order.

Only the word counts of the templates' own vocabulary reach the driver. The templates are fixed,
so their broadcast table is bounded. Only DataFrame functions are used.

Defined results: a null or empty text has no words and no labels, and score 0; equal rows give
equal rows; null ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ._shared import ALNUM_WORD, ASCII_LOWER, ASCII_UPPER, table


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False
    containment: float = 0.8
    telling: tuple[str, ...] = ()  # words that tell it from others, so they must be there
    barred: tuple[str, ...] = ()  # words of other licenses whose notices hold all of these words

    @property
    def words(self) -> list[str]:
        return re.findall(ALNUM_WORD, self.text.lower())

    @property
    def least(self) -> int:
        n = len(set(self.words))
        return n if self.phrase else math.ceil(self.containment * n - 1e-9)


BLOCK, STRIDE, SPAN = 64, 32, 2
OTHER_GPL = ("lesser", "library", "affero")
_NO_WORD = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: The phrases and labels of the contract, then notices of common licenses.
TEMPLATES = (
    Template("mit", "mit license", phrase=True),
    Template("apache", "apache license", phrase=True),
    Template("gpl", "general public license", phrase=True),
    Template("notice-mit", "Released under the MIT License", telling=("mit",)),
    Template("notice-apache-2.0", "Licensed under the Apache License, Version 2.0", telling=("apache", "2", "0")),
    Template("notice-gpl-2.0", "This work is licensed under the GNU General Public License, version 2", telling=("general", "2"), barred=OTHER_GPL),
    Template("notice-gpl-3.0", "This work is licensed under the GNU General Public License, version 3", telling=("general", "3"), barred=OTHER_GPL),
    Template("notice-cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", telling=("cc", "nc")),
    Template("notice-cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", telling=("cc", "sa")),
    Template("grant-mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    Template("terms-bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("rights-reserved", "Copyright all rights reserved"),
)


def word_array(text: Column) -> Column:
    """Words with A-Z in lower case. All other ASCII signs become blanks first, since ``split`` takes a tenth of ``regexp_extract_all``'s time."""
    apart = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER + _NO_WORD, ASCII_LOWER + " " * len(_NO_WORD))
    return F.array_remove(F.split(apart, " "), "")


def frequency_ranks(docs: DataFrame, templates: tuple[Template, ...], text: str) -> dict[str, int]:
    """Each word of a template with its place in the order: by count over all texts, then by the word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    words = docs.select(F.explode(word_array(F.col(text))).alias("word")).where(F.col("word").isin(vocabulary))
    counts = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}
    return {w: n for n, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _prefixes(spark: SparkSession, templates: tuple[Template, ...], ranks: dict[str, int]) -> DataFrame:
    """A row for each template and word of its prefix."""
    rows = []
    for t in templates:
        order = sorted({ranks[w] for w in t.words})
        prefix = order[: len(order) - t.least + 1]
        rows += [(rank, at, t.label, t.phrase, t.words, order, prefix, t.least, list(t.telling), list(t.barred)) for at, rank in enumerate(prefix)]
    return spark.createDataFrame(rows, "rank int, t_at int, label string, phrase boolean, t_words array<string>, t_ranks array<int>, t_prefix array<int>, least int, telling array<string>, barred array<string>")


def license_blocks(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row of ``docs``: id, n_words, and ``found``, an array of (label, phrase, score, start, places).

    ``start`` is the word at which the block starts, ``places`` the words at which a phrase starts.
    """
    stride = max([STRIDE, *(len(t.words) - 1 for t in templates)])  # a template must fit into a block wherever it stands
    block = BLOCK // STRIDE * stride
    ranks = frequency_ranks(docs, templates, text)
    prefixes = _prefixes(docs.sparkSession, templates, ranks)
    rare = sorted({w for t in templates for w in sorted(set(t.words), key=ranks.get)[: len(set(t.words)) - t.least + 1]})

    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), word_array(F.col(text)).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    own_block = lambda i: (i - i % stride)
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(own_block(i), F.greatest(own_block(i) - stride, F.lit(0))))))
    with_starts = words.select("row", "id", "words", starts.alias("starts"))
    blocks = with_starts.select(
        "row", "id", F.size("words").cast("long").alias("n_words"),
        F.explode_outer(F.transform("starts", lambda s: F.struct(s.alias("start"), F.slice("words", s + 1, F.lit(block)).alias("tokens")))).alias("block"),
    )
    rank_of = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    b_ranks = F.array_sort(F.array_distinct(F.filter(F.transform("block.tokens", lambda w: rank_of[w]), lambda r: r.isNotNull())))
    ranked = blocks.withColumn("b_ranks", b_ranks)
    probes = ranked.select("*", F.posexplode_outer("b_ranks").alias("b_at", "b_rank"))

    left = F.least(F.size("t_ranks") - F.col("t_at"), F.size("b_ranks") - F.col("b_at"))
    passes = (F.col("b_rank") == F.col("rank")) & (F.size("b_ranks") >= F.col("least")) & (left >= F.col("least"))
    first = F.array_min(F.array_intersect("t_prefix", "b_ranks"))  # a pair that shares several prefix words counts once
    pairs = probes.join(F.broadcast(prefixes), passes & (F.col("rank") == first), "left")
    overlap = F.size(F.array_intersect("t_ranks", "b_ranks"))
    at = F.sequence(F.lit(0), F.size("block.tokens") - F.size("t_words"))
    places = F.filter(at, lambda k: F.slice("block.tokens", k + 1, F.size("t_words")) == F.col("t_words"))
    places = F.when(F.col("phrase"), F.transform(places, lambda k: k + F.col("block.start")))
    span = F.least(F.size("t_words") * SPAN, F.lit(block))

    def held(k: Column) -> Column:
        """How many of the template's words the stretch from word k holds; null where a word that tells is missing, or one that bars it is there."""
        told = lambda w: (F.size(F.array_except("telling", w)) == 0) & (F.size(F.array_intersect("barred", w)) == 0)
        return let(F.slice("block.tokens", k + 1, span), lambda w: F.when(told(w), F.size(F.array_intersect("t_words", w))))

    own = F.filter(F.transform("block.tokens", lambda w, k: F.when(F.array_contains("t_words", w), k)), lambda k: k.isNotNull())
    best = F.when(F.col("phrase"), overlap).otherwise(F.array_max(F.transform(own, held)))
    pairs = pairs.withColumn("best", F.when(F.col("label").isNotNull() & (overlap >= F.col("least")), best))
    met = F.when(F.col("best") >= F.col("least"), F.struct("label", "phrase", (F.col("best") / F.size("t_ranks")).alias("score"), F.col("block.start").alias("start"), places.alias("places")))
    met_pairs = pairs.select("row", "id", "n_words", met.alias("met"))
    real = F.col("met").isNotNull() & (~F.col("met.phrase") | (F.size("met.places") > 0))
    found = F.collect_list(F.when(real, F.col("met")))
    return met_pairs.groupBy("row").agg(F.first("id").alias(id_col), F.first("n_words").alias("n_words"), found.alias("found")).drop("row")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda f: f["phrase"])
    places = F.array_distinct(F.flatten(F.transform(base, lambda f: F.transform(f["places"], lambda p: F.struct(f["label"].alias("label"), p.alias("at"))))))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda f: f["label"]))), ",")
    at = F.transform("places", lambda p: p["at"])
    return found.withColumn("places", places).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda f: f["score"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    places, meets = [], []
    for t in TEMPLATES:
        w = t.words
        if t.phrase:
            test = " AND ".join(f"words[i + {k}] = '{x}'" for k, x in enumerate(w))
            places.append(f"SELECT doc, '{t.label}' AS label, i - 1 AS place FROM p WHERE {test}")
        else:
            distinct = ", ".join(f"'{x}'" for x in sorted(set(w)))
            told = "".join(f" AND list_contains(tokens, '{x}')" for x in t.telling) + "".join(f" AND NOT list_contains(tokens, '{x}')" for x in t.barred)
            n = f"len(list_intersect(tokens, [{distinct}]))"
            stretch = f"SELECT doc, words[i : least(i + {min(SPAN * len(w), BLOCK)}, (i - 1) // {STRIDE} * {STRIDE} + {BLOCK} + 1) - 1] AS tokens FROM p WHERE words[i] IN ({distinct})"
            meets.append(f"SELECT doc, '{t.label}' AS label, {n} / {len(set(w))} AS score FROM ({stretch}) WHERE {n} >= {t.least}{told}")
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{ALNUM_WORD}') AS words FROM documents),
p AS (SELECT doc, words, unnest(range(1, len(words) + 1)) AS i FROM d),
base AS ({' UNION ALL '.join(places)}),
met AS (SELECT doc, label, 1.0 AS score FROM base UNION ALL {' UNION ALL '.join(meets)}),
x AS (SELECT doc, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc),
y AS (SELECT doc, max(score) AS score, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM met GROUP BY doc)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN x USING (doc) LEFT JOIN y USING (doc)"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLE_SQL = {"op1_license_scan": _sql()}
