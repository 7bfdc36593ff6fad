"""Main text of web pages by deduction of each host's template from equivalence classes of tokens.

Tokens are a page's tags, with class and id, and its text blocks, each told apart by the names of the
tags around it. A token's occurrence vector says how often it stands on each page of the host; copies
of a page count as one page. Tokens with equal vectors are an equivalence class. A class is valid if it
is large (``CLASS_SIZE`` tokens), frequent (``SUPPORT`` of the host's pages, at least ``MIN_PAGES``), and if
its tokens stand in one order and nest in one way on every page. The tags of valid classes, nested, are
the template's containers; its texts are constant. What remains lies in slots: a slot is a container
without the containers in it.

Which slots hold the main text is told by what all pages of the host have in them: it is the deepest
container with ``MAIN_SHARE`` of the text outside links, with all containers in it but those that consist
of links. Names help to tell a container of the template that lies beside the text (``AWAY``,
``AWAY_WORDS``), but a name is void where the container holds the article, or most of the text where no
container is an article; so no class of a wrapper can empty a page.

Fallback, by HTML alone: on hosts without such a template, and on pages without its main container, a
page's own article counts, or else all text, without tags whose names say that they lie beside it.
Within the main container, tags such as ``nav`` or ``form`` and hidden ones are left out on any page.

No host meets in one task: vectors, orders and slot sizes are sums over (host, token), and a host's
template is as large as a page's frequent tokens, however many pages it has. Templates join pages as
rows; AQE broadcasts them where they are small by its own measure and else splits skewed hosts.

Defined results: null and empty html give the empty text; a url without a host is grouped as host
""; null ids stay; equal rows give equal rows; an empty table gives an empty result. ``text`` and
``n_chars`` replace columns of ``pages`` of the same name; all others are kept. Pages are read in time
linear in their length, however deep their tags nest.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import mapped, small_batches, table, written

CLASS_SIZE, SUPPORT, MIN_PAGES = 3, 0.6, 5
MAIN_SHARE, LINK_SHARE = 0.7, 0.5
SALTS = 32

#: Tag names of HTML by what they mean for main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
AWAY = frozenset("head nav header footer aside form button select option menu dialog".split())
MAIN = frozenset("article main".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words in class, id or role that name containers beside the article.
AWAY_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "dialog footer header hidden masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay popup promo promoted promotion "
    "recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
#: Those of them that name adverts, which may stand within a line too.
ADVERT_WORDS = frozenset("ad ads advert advertisement adverts adsense promo promoted promotion sponsor sponsored".split())
#: Words that say nothing of their own beside those of AWAY_WORDS, as in ad-box or site-footer.
PLAIN_WORDS = frozenset("area bar block bottom box button container content form global group inner item items left list main outer page post right section site slot text title top unit wrap wrapper".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'<>/=]+)""")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", name, attributes), ("close", name, "") and ("text", "", text) in page order; comments and raw elements are passed over."""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
        elif name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else n
        else:
            yield "open", name, m[3]


def _marks(attributes: str) -> tuple[str, bool]:
    """Class, id and role of a tag, and whether it is hidden."""
    if not attributes.strip():
        return "", False
    found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    marks = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) is not None
    return marks, hidden


def names_beside(marks: str, among: frozenset[str] = AWAY_WORDS) -> bool:
    """Whether a class, id or role names what lies beside the text: a word of ``among``, alone or with PLAIN_WORDS and numbers."""
    for mark in marks.split():
        words = [w for w in re.split(r"[^a-z]+", mark) if w]
        if any(w in among for w in words) and all(w in among or w in PLAIN_WORDS for w in words):
            return True
    return False


class Tag:
    """An open tag: its key within the names of the tags around it, and what its name and its marks say."""

    __slots__ = ("around", "away", "key", "main", "name", "path", "role", "worded")

    def __init__(self, name: str, around: Tag | None, marks: str, hidden: bool, in_main: bool):
        self.name, self.around = name, around
        self.path = token_key(f"{around.path if around else 0}/{name}")
        self.key = token_key(f"{self.path}<{marks}")
        self.main = name in MAIN or "articlebody" in marks
        self.away = hidden or name in AWAY and not (name == "header" and in_main)
        # A heading's id is a slug of its text, and a paragraph of the article is text whatever its class.
        self.worded = name not in ("html", "body") and name not in MAIN and not (in_main and name in TEXT) and names_beside(marks)
        self.role = None


def token_key(token: str) -> int:
    return xxhash.xxh64_intdigest(token, 0) >> 1


class Block:
    """A text block: its text, its key within the names of the tags around it, the tag around it, and how many of its characters are in links."""

    __slots__ = ("key", "linked", "tag", "text")

    def __init__(self, text: str, tag: Tag | None, linked: int):
        self.text, self.tag, self.linked = text, tag, min(linked, len(text))
        self.key = token_key(f"{tag.path if tag else 0}>{text}")


def blocks(page: str) -> Iterator[Block | Tag]:
    """The page's tags, as they open, and its text blocks, in page order. Inline tags don't part blocks; adverts and hidden ones are left out with their text."""
    pieces: list[str] = []
    linked, in_link = 0, 0
    stack: list[Tag] = []
    open_names: Counter = Counter()
    mains = 0
    muted: list[str] = []

    def pop() -> Tag:
        nonlocal mains
        t = stack.pop()
        open_names[t.name] -= 1
        mains -= t.main
        return t

    for kind, name, value in events(page):
        if kind == "text":
            if not muted:
                pieces.append(value)
                linked += len(value) if in_link else 0
        elif name in INLINE:
            if kind == "open" and name not in VOID:
                in_link += name == "a"
                if muted or value and (marked := _marks(value)) and (marked[1] or names_beside(marked[0], ADVERT_WORDS)):
                    muted.append(name)
            elif kind == "close":
                in_link = max(0, in_link - (name == "a"))
                if name in muted:
                    while muted.pop() != name:
                        pass
        else:
            text = " ".join(html_entities.unescape("".join(pieces)).split()) if pieces else ""
            if text:
                yield Block(text, stack[-1] if stack else None, linked)
            pieces.clear()
            muted.clear()
            linked = in_link = 0
            if kind == "close":
                if open_names[name] > 0:
                    while pop().name != name:
                        pass
            elif name not in VOID:
                while stack and stack[-1].name in CLOSES.get(name, ()):
                    pop()
                marks, hidden = _marks(value)
                tag = Tag(name, stack[-1] if stack else None, marks, hidden, mains > 0)
                stack.append(tag)
                open_names[name] += 1
                mains += tag.main
                yield tag
    text = " ".join(html_entities.unescape("".join(pieces)).split())
    if text:
        yield Block(text, stack[-1] if stack else None, linked)


def page_tokens(page: str) -> Counter:
    """Keys of the page's tags and text blocks with their counts."""
    return Counter(t.key for t in blocks(page))


BESIDE, ARTICLE = 1, 2  # what the names of a container say


def page_structure(page: str, classes: dict[int, int]) -> tuple[dict[int, int], dict[int, list[int]]]:
    """How the classes (token to class) stand on a page: a hash of each class's order and nesting, and for each container (0: the page)
    the container around it, what its names say, and the characters of its slot, all and in links."""
    orders: dict[int, int] = {}
    found = {0: [0, 0, 0, 0]}

    def container(tag: Tag | None) -> int:
        """The innermost tag of the template from ``tag`` outwards; ``role`` remembers it."""
        passed = []
        while tag is not None and tag.role is None and tag.key not in classes:
            passed.append(tag)
            tag = tag.around
        at = 0 if tag is None else tag.key if tag.key in classes else tag.role
        for t in passed:
            t.role = at
        return at

    for token in blocks(page):
        around = container(token.around if isinstance(token, Tag) else token.tag)
        of = classes.get(token.key)
        if of is not None:
            orders[of] = token_key(f"{orders.get(of, 0)},{token.key},{around}")
        if isinstance(token, Tag):
            if of is not None:
                found.setdefault(token.key, [around, (token.away or token.worded) * BESIDE | token.main * ARTICLE, 0, 0])
        elif of is None:
            found[around][2] += len(token.text)
            found[around][3] += token.linked
    return orders, found


def main_slots(found: dict[int, tuple[int, int, int, int]]) -> tuple[int | None, list[int]]:
    """The main container of a template (None: it has none), and the containers in it that lie beside the text.

    ``found``: of each container the one around it, what its names say, and the characters of its slot on all pages, all and in links."""
    inner = defaultdict(list)
    for key, (around, *_) in found.items():
        if key:
            inner[around].append(key)
    order = [0]
    for key in order:
        order += inner[key]
    total, linked, holds = ({k: found[k][i] for k in order} for i in (2, 3, 1))
    for key in reversed(order[1:]):
        around = found[key][0]
        total[around] += total[key]
        linked[around] += linked[key]
        holds[around] |= holds[key] & ARTICLE
    some_article = holds[0] & ARTICLE
    beside: set[int] = set()
    for key in order[1:]:
        void = holds[key] & ARTICLE if some_article else 2 * (total[key] - linked[key]) > total[0] - linked[0]
        if found[key][0] in beside or found[key][1] & BESIDE and not void:
            beside.add(key)
    mass = {k: 0 if k in beside else found[k][2] - found[k][3] for k in order}
    for key in reversed(order[1:]):
        mass[found[key][0]] += mass[key]
    main = [k for k in order if mass[k] and mass[k] >= MAIN_SHARE * mass[0]]
    if not main or not main[-1]:
        return None, []
    within = [main[-1]]
    for key in within:
        within += inner[key]
    return main[-1], [k for k in within[1:] if k in beside or total[k] and linked[k] >= LINK_SHARE * total[k]]


def main_text(page: str, template: frozenset[int] = frozenset(), main: int | None = None, beside: frozenset[int] = frozenset()) -> str:
    """The text of the main container's slots; by HTML alone where there is none."""
    tokens = list(blocks(page))
    found, tags = [t for t in tokens if isinstance(t, Block)], [t for t in tokens if isinstance(t, Tag)]
    if main is not None and any(t.key == main for t in tags):
        step = lambda at, t: "main" if not at and t.key == main else "beside" if at == "main" and (t.away or t.key in beside) else at
        top = ""
    else:
        wrapper, articles = _wrappers(found, tags)
        step = lambda at, t: "beside" if (t.away or t.worded) and not wrapper(t) else "main" if not at and (t.main or not articles) else at
        top = "" if articles else "main"
    roles: dict[int, str] = {}
    for t in tags:  # a tag comes after those around it
        at = roles[id(t.around)] if t.around is not None else top
        roles[id(t)] = at if at == "beside" else step(at, t)
    own = [b for b in found if (roles[id(b.tag)] if b.tag is not None else top) == "main"]
    return " ".join(b.text for b in own if b.key not in template or written_in_article(b.tag))


def written_in_article(tag: Tag | None) -> bool:
    """Whether only tags of running text part a block from an article: then it is the article's, even where all pages share it."""
    while tag is not None and tag.name in TEXT:
        tag = tag.around
    return tag is not None and tag.main


def _wrappers(found: list[Block], tags: list[Tag]) -> tuple[Callable[[Tag], bool], bool]:
    """Whether a tag holds all text of articles, or most of the text where the page has none; and whether it has any."""
    texts, in_article = Counter(), set()
    for t in tags:
        if t.main or id(t.around) in in_article:
            in_article.add(id(t))
    articles = any(id(b.tag) in in_article for b in found)
    for b in found:
        if b.tag is not None and (not articles or id(b.tag) in in_article):
            texts[id(b.tag)] += len(b.text)
    whole = sum(texts.values()) if articles else sum(len(b.text) for b in found)
    for t in reversed(tags):
        if t.around is not None:
            texts[id(t.around)] += texts[id(t)]
    return lambda t: texts[id(t)] > (whole - 1 if articles else whole / 2), articles


def host(url: Column) -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return found


def classes(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, classes): the tokens of each large and frequent equivalence class of a host."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    rows = pages.select(host(F.col(url)).alias("host"), F.coalesce(html, F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for b in batches:
            hosts, pages_of, keys, counts = [], [], [], []
            for h, text in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
                page = xxhash.xxh128_digest(text)
                if (h, page) in seen:
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((h, page))
                tokens = page_tokens(text)
                tokens[0] = 1  # stands for the page
                hosts.append(h)
                pages_of.append(page)
                keys.append(list(tokens.keys()))
                counts.append(list(tokens.values()))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages_of, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["host", "page", "tokens", "counts"])

    found = rows.mapInArrow(run, "host string, page binary, tokens array<bigint>, counts array<int>")
    once = found.groupBy("host", "page").agg(F.first(F.arrays_zip("tokens", "counts")).alias("tokens"))  # copies of a page are one page
    tokens = once.select("host", "page", F.inline("tokens").alias("token", "n"))
    vectors = tokens.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    vectors = written(spark, vectors.where(F.col("pages") >= MIN_PAGES), "vectors")
    totals = vectors.where("token = 0").select("host", F.col("pages").alias("all_pages"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = vectors.where("token != 0").withColumn("salt", F.pmod("token", F.lit(SALTS)).cast("int"))  # a host's frequent tokens are dealt out
    frequent = salted.join(totals, ["host", "salt"]).where(F.col("pages") >= SUPPORT * F.col("all_pages"))
    own = frequent.groupBy("host", "pages", "vector").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= CLASS_SIZE)
    return own.groupBy("host").agg(F.collect_list("tokens").alias("classes"))


def _with(pages: DataFrame, per_host: DataFrame, url: str, how: str) -> DataFrame:
    return pages.join(per_host.withColumnRenamed("host", "__host"), host(F.col(url)) == F.col("__host"), how)


def templates(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, template, main, beside): the tokens of each host's valid classes, its main container, and the containers in it that don't count."""
    spark = pages.sparkSession
    candidates = written(spark, classes(pages, url=url, html=html), "classes")
    rows = _with(pages.select(F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html")), candidates, "url", "inner").select("__host", "html", "classes")
    parts = ("class", "low", "high", "around", "says", "chars", "links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[int, int]] = {}
        for b in batches:
            sums: dict[tuple[str, int, bool], list[int]] = {}
            for h, text, own in zip(b["__host"].to_pylist(), b["html"].to_pylist(), b["classes"], strict=True):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = {t: k for k, c in enumerate(sorted(map(sorted, own.as_py()))) for t in c}
                orders, found = page_structure(text, known[h])
                for k, order in orders.items():
                    now = sums.setdefault((h, k, True), [order, order, 0, 0, 0, 0])
                    now[0], now[1] = min(now[0], order), max(now[1], order)
                for key, (around, says, chars, links) in found.items():
                    now = sums.setdefault((h, key, False), [0, 0, around, says, 0, 0])
                    now[4] += chars
                    now[5] += links
            keys = list(sums)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], *([sums[k][i] for k in keys] for i in range(6))]
            types = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "key", *parts])

    ddl = "host string, key bigint, class boolean, low bigint, high bigint, around bigint, says bigint, chars bigint, links bigint"
    sums = rows.mapInArrow(run, ddl).groupBy("host", "key", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"), *(F.max(c).alias(c) for c in ("around", "says")), *(F.sum(c).alias(c) for c in ("chars", "links")))
    one = sums.groupBy("host").agg(F.collect_list(F.struct("key", *parts)).alias("parts")).join(candidates, "host")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, mains, besides = [], [], []
            for rows_of, own in zip(b["parts"].to_pylist(), b["classes"].to_pylist(), strict=True):
                valid = {r["key"] for r in rows_of if r["class"] and r["low"] == r["high"]}
                template = {t for k, c in enumerate(sorted(map(sorted, own))) if k in valid for t in c}
                main, beside = main_slots(_merged({r["key"]: (r["around"], r["says"], r["chars"], r["links"]) for r in rows_of if not r["class"]}, template))
                tokens.append(sorted(template))
                mains.append(main)
                besides.append(beside)
            yield pa.RecordBatch.from_arrays([b["host"], pa.array(tokens, pa.list_(pa.int64())), pa.array(mains, pa.int64()), pa.array(besides, pa.list_(pa.int64()))], names=["host", "template", "main", "beside"])

    return one.select("host", "parts", "classes").mapInArrow(choose, "host string, template array<bigint>, main bigint, beside array<bigint>")


def _merged(found: dict[int, tuple[int, int, int, int]], template: set[int]) -> dict[int, tuple[int, int, int, int]]:
    """Containers that turned out not to be in a valid class become part of the one around them."""

    def outer(key: int) -> int:
        seen = set()
        while key and (key not in template or key in seen or key not in found):
            seen.add(key)
            key = found[key][0] if key in found and found[key][0] not in seen else 0
        return key

    out = {k: [outer(found[k][0]), found[k][1], 0, 0] for k in found if k == 0 or k in template}
    out.setdefault(0, [0, 0, 0, 0])
    for key, (_, _, chars, links) in found.items():
        out[outer(key)][2] += chars
        out[outer(key)][3] += links
    return {k: tuple(v) for k, v in out.items()}


def extract(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars."""
    spark = pages.sparkSession
    deduced = written(spark, templates(pages, url=url, html=html), "templates").select("host", F.struct("template", "main", "beside").alias("__template"))
    rows = _with(pages.drop("text", "n_chars"), deduced, url, "left").drop("__host")
    kept = [c for c in rows.columns if c != "__template"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset] = {}
        for b in batches:
            texts = []
            for page, template in zip(b[html].to_pylist(), b["__template"].to_pylist(), strict=True):
                own = template or {}
                sets = []
                for name in ("template", "beside"):
                    key = tuple(own.get(name) or ())
                    if len(known) > 1000:
                        known.clear()
                    sets.append(known.setdefault(key, frozenset(key)))
                texts.append(main_text(page or "", sets[0], own.get("main"), sets[1]))
            yield pa.RecordBatch.from_arrays([b[c] for c in kept] + [pa.array(texts, pa.string())], names=[*kept, "text"])

    return mapped(rows, run, "text string", dropped=("__template",)).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op6_html_text": op6_html_text}
ORACLE_SQL: dict[str, str] = {}
