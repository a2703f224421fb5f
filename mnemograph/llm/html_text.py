"""Main text of web pages: page templates are deduced per host, slots are extracted.

Tokens are block tags with the path that leads to them (implied ends included), and text
runs outside marked content. Over the pages of a host each token has an occurrence vector:
how often each page holds it. It is never gathered; its sums against two page hashes are
aggregated instead, so a host with a third of all pages is combined before the shuffle and
lands in no single task. Tokens of equal vectors that occur on a tenth of the host's pages
form an equivalence class, and at most ten times a page's tokens are left per host.

A second reading checks the classes: one is valid if its tokens come in one order on every
page and each of its instances lies within one slot of any other class (of two that
overlap, the one that is still open inside the other goes). Valid classes nest into the
host's template, and what lies between consecutive tokens is a slot. Text, links and
markup of each slot are added up over the host and give the slots of the main text.

The third reading extracts: text of main slots without fixed template text, and without
what markup inside a slot names as something else (menus, notices, comments, ...).
Pages of hosts without a template, or without text in its main slots, are judged alone.

Templates reach tasks as a broadcast up to ENTRIES tokens; beyond, pages are dealt by
host and salt, and each task reads a host's template before its pages.

Defined results: a null html is empty and gives an empty text. White space is Python's
(with no-break spaces), ``<br>`` counts as white space. A heading inside an article's own
header stays. A null url, or one without a host, belongs to no host. Repeated rows are
extracted each; null ids stay. Pages of any length are read whole, an empty table gives
none, and other columns are not read. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (text_slices needs it)
from pyspark.sql import Column, DataFrame, functions as F

from mnemograph.llm.common import arrow_map, no_cycles, stage, text_slices, unstage

SLICE_BYTES = 8 << 20       # of html that a task holds at a time
KEYS = 100_000              # sums that a task combines before it sends them on
SALTS = 32                  # parts of a host where templates are not broadcast
ENTRIES = 200_000           # template tokens of all hosts that are broadcast
SUPPORT = 0.1               # share of a host's pages that a template token occurs on
FIXED = 0.5                 # ... and a fixed text, on three different pages at least
BAD = 0.01                  # share of a class's pages on which it may overlap another

VOID, RAW, INLINE, BLOCK = 1, 2, 3, 4
#: What is not a block: elements without content, with content that is no text, within lines.
KINDS = {
    **dict.fromkeys("area base col embed hr link meta param source track".split(), VOID),
    **dict.fromkeys("script style title textarea xmp iframe noembed noframes noscript template svg "
                    "math object select button audio video canvas".split(), RAW),
    **dict.fromkeys("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd "
                    "label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u "
                    "var wbr".split(), INLINE)}
#: What an opening tag ends when it is the innermost open element.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEAVES = set("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table thead tbody tfoot tr td th dl dt dd "
             "figure figcaption header hgroup".split())
NOISE_TAGS = set("nav footer aside form menu dialog head".split())
NOISE_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos "
    "promotion banner banners cookie cookies consent gdpr notice notices notification alert alerts "
    "sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header "
    "masthead topbar toolbar comment comments respond reply replies disqus discussion related "
    "recommended recommendations share sharing social newsletter subscribe subscription signup "
    "login search popup modal overlay pager pagination skip widget widgets teaser teasers".split())
NOT_NOISE = set("has with no without main content article post entry story body page layout".split())
CONTENT = re.compile(r"(?:article|post|entry|story|main|page|blog)?[-_]?(?:content|body|text)"
                     r"|article|post|entry|story|main", re.I)
BEST = re.compile(r"(?:article|post|entry|story)[-_]?(?:content|body|text)|articlebody", re.I)

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)"
    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HEADING = re.compile(r"h[1-6]\Z")

_names: dict[tuple, tuple[int, int, str]] = {}
_paths: dict[tuple, tuple[int, int, int]] = {}


class Block(NamedTuple):
    text: str
    rank: int           # of the marked content around it, 0 without
    noise: bool
    linked: int         # characters within links
    place: int          # the innermost container, by its number on the page
    title: bool
    key: int            # token of a text that may be fixed, else 0


def hash64(*parts: str | bytes) -> int:
    h = blake2b(digest_size=8)
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass") if isinstance(p, str) else p)
        h.update(b"\0")
    return int.from_bytes(h.digest(), "little", signed=True)


def named(tag: str, attributes: str) -> tuple[int, int, str]:
    """(noise, content rank, signature) that a tag's name and attributes tell."""
    found = _names.get((tag, attributes))
    if found is None:
        values = {a.lower(): x or y or z for a, x, y, z in ATTRIBUTE.findall(attributes)}
        labels = [*values.get("class", "").split(), *values.get("id", "").split(),
                  *values.get("role", "").split()]
        noise = rank = 0
        for label in labels:
            words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", label)]
            if NOISE_WORDS.intersection(words) and not NOT_NOISE.intersection(words):
                noise = 1
            if CONTENT.fullmatch(label):
                rank = max(rank, 2 if BEST.fullmatch(label) else 1)
            noise = max(noise, words == ["post", "comment"] or words == ["article", "comment"])
        if tag in ("html", "body", "main"):
            noise = 0
        rank = 2 if tag == "article" or values.get("itemprop", "").lower() == "articlebody" else \
            max(rank, 1) if tag == "main" else rank
        noise = 1 if noise or tag in NOISE_TAGS else 2 if tag == "header" else 0
        sign = re.sub(r"\d+", "#", f"{values.get('class', '')} {values.get('id', '')}".lower())
        if len(_names) > 50_000:
            _names.clear()
        found = _names[tag, attributes] = noise, rank, sign
    return found


def parsed(html: str) -> list[int | Block]:
    """Tag tokens and blocks of text of a page, in page order."""
    out: list[int | Block] = []
    # Open block elements: (tag, path, noise, rank, number, container)
    stack: list[tuple] = [("", 0, 0, 0, 0, 0)]
    text: list[str] = []
    at, linked, in_link, number = 0, 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                tag, path, noise, rank, _, place = stack[-1]
                noise = noise == 1 or noise == 2 and not HEADING.match(tag)
                out.append(Block(words, rank, noise, linked, place, tag == "h1",
                                 0 if rank else hash64(str(path), words)))
            text.clear()
        linked = 0

    def close() -> None:
        out.append(~stack.pop()[1])

    def said(part: str) -> None:
        nonlocal linked
        part = unescape(part) if "&" in part else part
        text.append(part)
        if in_link:
            linked += len(part.strip())

    found = TAG.finditer(html)
    while (m := next(found, None)) is not None:
        start = m.start()
        if start > at:
            said(html[at:start])
        at = m.end()
        end, tag, attributes = m.groups()
        if tag is None:
            continue
        kind = KINDS.get(tag)
        if kind is None:
            tag = tag.lower()
            kind = KINDS.get(tag, BLOCK)
        if kind == INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = not end
            continue
        if kind == RAW:
            if not end and (not attributes.endswith("/") or tag in ("script", "style")):
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = len(html) if stop is None else html.find(">", stop.end() - 1) + 1 or len(html)
                found = TAG.finditer(html, at)
            continue
        if text:
            flush()
        if end:
            if stack[-1][0] == tag:
                close()
            elif any(e[0] == tag for e in stack):
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        while stack[-1][0] == "p" or stack[-1][0] in ENDS.get(tag, ()):
            close()
        _, path, was, above, _, place = stack[-1]
        made = _paths.get((path, tag, attributes))
        if made is None:
            if len(_paths) > 100_000:
                _paths.clear()
            noise, rank, sign = named(tag, attributes)
            made = _paths[path, tag, attributes] = hash64(str(path), tag, sign), noise, rank
        path, noise, rank = made
        if noise == 2 and above < 2:
            noise = 1           # a page's header, not an article's
        out.append(path)
        if kind == VOID:
            continue
        number += 1
        stack.append((tag, path, 1 if noise == 1 or was == 1 else max(noise, was), max(rank, above),
                      number, place if tag in LEAVES else number))
    if at < len(html):
        said(html[at:])
    flush()
    while len(stack) > 1:
        close()
    return out


class Template(NamedTuple):
    classes: dict[int, int]             # class of a token
    sizes: dict[int, int]               # tokens of a class
    main: frozenset                     # (class, gap) of slots of the main text
    drops: bool                         # whether fixed texts are dropped


def template(keys: list[int], classes: list[int], main: list | None, drops: bool) -> Template:
    sizes: dict[int, int] = {}
    for c in classes:
        sizes[c] = sizes.get(c, 0) + 1
    slots = frozenset((m["class"], m["gap"]) for m in main or ())
    return Template(dict(zip(keys, classes)), sizes, slots, drops)


class Placed:
    """A page's blocks in the slots of its template."""

    def __init__(self, items: list[int | Block], t: Template | None):
        self.blocks: list[tuple[Block, tuple[int, int], bool]] = []
        self.bad: set[int] = set()
        self.orders: dict[int, set[int]] = {}
        open_: list[list] = []          # class, tokens seen, hash of their order
        active: set[int] = set()
        for item in items:
            block = None if isinstance(item, int) else item
            key = item if block is None else block.key
            c = t.classes.get(key) if t and key else None
            if c is not None:
                if c in active:
                    while open_[-1][0] != c:    # still open inside: not in one slot
                        self.bad.add(open_[-1][0])
                        active.discard(open_.pop()[0])
                    if key in open_[-1][1]:
                        self.bad.add(c)
                        open_[-1][1:] = [{key}, key]
                    else:
                        open_[-1][1].add(key)
                        open_[-1][2] = (open_[-1][2] * 1_000_003 + key) % (1 << 61)
                else:
                    active.add(c)
                    open_.append([c, {key}, key])
                if len(open_[-1][1]) == t.sizes[c]:
                    self.orders.setdefault(c, set()).add(open_[-1][2])
                    active.discard(open_.pop()[0])
            if block is not None:
                slot = (open_[-1][0], len(open_[-1][1])) if open_ else (0, 0)
                self.blocks.append((block, slot, c is not None))
        self.bad.update(active)


def alone(blocks: list[Block]) -> list[Block]:
    """The main text of blocks by their markup, or by the densest container."""
    blocks = [b for b in blocks if not b.noise]
    best = max((b.rank for b in blocks), default=0)
    if best:
        return [b for b in blocks if b.rank == best]
    blocks = [b for b in blocks if 2 * b.linked < len(b.text)]
    sums: dict[int, int] = {}
    for b in blocks:
        sums[b.place] = sums.get(b.place, 0) + len(b.text)
    most = max(sums.values(), default=0)
    return [b for b in blocks if 5 * sums[b.place] >= most or b.title]


def extracted(items: list[int | Block], t: Template | None) -> str:
    placed = Placed(items, t).blocks
    kept = []
    if t is not None:
        kept = alone([b for b, slot, fixed in placed
                      if slot in t.main and not (fixed and t.drops and not b.rank)])
    if not kept:
        kept = alone([b for b, _, _ in placed])
    return "\n".join(b.text for b in kept)


def host_of(url: Column) -> Column:
    """The host of an address, empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1),
                              F.lit("")))


TOKEN = ("host string, key bigint, kind int, pages bigint, total bigint, sum_a bigint, sum_b bigint")


def sent(sums: dict, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*[(*k, *v) for k, v in sums.items()]))
    sums.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def add(sums: dict, key: tuple, *values: int) -> None:
    old = sums.get(key)
    if old is None:
        sums[key] = list(values)
    else:
        for i, v in enumerate(values):
            old[i] += v


def tokens(pages: DataFrame) -> DataFrame:
    """Occurrence sums of every token of every host: kind 0 tags, 1 texts, 2 whole pages."""
    schema = pa.schema([("host", pa.string()), ("key", pa.int64()), ("kind", pa.int32()),
                        *((n, pa.int64()) for n in ("pages", "total", "sum_a", "sum_b"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for part in text_slices(batches, "html", SLICE_BYTES):
            with no_cycles():
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    page = hash64(html or "")
                    a, b = page & 0x3FFFFFFF, page >> 30 & 0x3FFFFFFF
                    counts: dict = {(host, page, 2): 1}
                    for item in parsed(html or ""):
                        if isinstance(item, int):
                            key = host, item, 0
                        elif item.key and not item.noise:
                            key = host, item.key, 1
                        else:
                            continue
                        counts[key] = counts.get(key, 0) + 1
                    for key, n in counts.items():
                        add(sums, key, 1, n, n * a, n * b)
            if len(sums) > KEYS:
                yield sent(sums, schema)
        if sums:
            yield sent(sums, schema)

    wide = "decimal(20,0)"
    return arrow_map(pages.where("host <> ''").select("host", "html"), run, TOKEN) \
        .groupBy("host", "key", "kind").agg(
            F.sum("pages").alias("pages"), F.sum("total").alias("total"),
            F.sum(F.col("sum_a").cast(wide)).alias("sum_a"),
            F.sum(F.col("sum_b").cast(wide)).alias("sum_b"))


def classes(found: DataFrame) -> DataFrame:
    """(host, keys, classes): tokens of equal vectors; a class is named by its least token."""
    counts = found.where("kind = 2").groupBy("host").agg(
        F.sum("pages").alias("n"), F.count(F.lit(1)).alias("n_different")) \
        .where("n_different > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    often = found.where("kind < 2 AND pages > 1") \
        .withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(counts, ["host", "salt"]) \
        .where(F.col("pages") >= F.when(F.col("kind") == 0, SUPPORT).otherwise(FIXED) * F.col("n")) \
        .where("kind = 0 OR n_different > 2")
    grouped = often.groupBy("host", "pages", "total", "sum_a", "sum_b").agg(
        F.collect_list("key").alias("keys")).where(F.size("keys") > 1)
    return grouped.select("host", F.explode("keys").alias("key"), F.array_min("keys").alias("class")) \
        .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("key", "class"))).alias("t")) \
        .select("host", F.col("t.key").alias("keys"), F.col("t.class").alias("classes"))


def met(pages: DataFrame, templates: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on slices of pages, with a function that gives a page's template by its host.

    ``templates`` is a stage table with (host, keys, classes, main, drops).
    """
    entries = templates.agg(F.sum(F.size("keys"))).collect()[0][0] or 0
    if entries <= ENTRIES:
        held = {r.host: template(r.keys, r.classes, r.main, r.drops) for r in templates.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(held)

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from work(text_slices(batches, "html", SLICE_BYTES), shared.value.get)
        return arrow_map(pages, plain, schema)

    salted = pages.withColumn("role", F.lit(1)) \
        .withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")) \
        .unionByName(templates.withColumn("role", F.lit(0)).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), allowMissingColumns=True)
    stream = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "role")

    def sorted_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, Template] = {}

        def slices() -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "html", SLICE_BYTES):
                roles = part.column("role").to_pylist()
                start = 0
                for i, role in enumerate(roles + [0]):
                    if role == 0:
                        if start < i:
                            yield part.slice(start, i - start)
                        start = i + 1
                        if i < len(roles):
                            r = part.slice(i, 1).to_pylist()[0]
                            last.clear()
                            last[r["host"]] = template(r["keys"], r["classes"], r["main"], r["drops"])
        yield from work(slices(), last.get)

    return arrow_map(stream, sorted_, schema)


SLOT = ("host string, class bigint, gap int, pages bigint, bad bigint, first bigint, last bigint, "
        "chars bigint, marked bigint, linked bigint, fixed bigint")


def slots(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Sums of each class (gap -1) and slot of each host."""
    schema = pa.schema([("host", pa.string()), ("class", pa.int64()), ("gap", pa.int32()),
                        *((n, pa.int64()) for n in ("pages", "bad", "first", "last", "chars",
                                                    "marked", "linked", "fixed"))])

    def work(parts: Iterator[pa.RecordBatch], lookup: Callable) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for part in parts:
            with no_cycles():
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    t = lookup(host)
                    if t is None:
                        continue
                    placed = Placed(parsed(html or ""), t)
                    for c in placed.orders.keys() | placed.bad:
                        orders = placed.orders.get(c, {0})
                        row = sums.setdefault((host, c, -1), [0, 0, min(orders), max(orders), 0, 0, 0, 0])
                        row[0] += 1
                        row[1] += c in placed.bad
                        row[2], row[3] = min(row[2], *orders), max(row[3], *orders)
                    for block, slot, fixed in placed.blocks:
                        if not block.noise:
                            n = len(block.text)
                            add(sums, (host, *slot), 1, 0, 0, 0, n, n if block.rank else 0,
                                block.linked, n if fixed and not block.rank else 0)
            if len(sums) > KEYS:
                yield sent(sums, schema)
        if sums:
            yield sent(sums, schema)

    total = [F.sum(n).alias(n) for n in ("pages", "bad", "chars", "marked", "linked", "fixed")]
    return met(pages.select("host", "html"), templates, work, SLOT).groupBy("host", "class", "gap") \
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), *total)


def judged(templates: DataFrame, sums: DataFrame) -> DataFrame:
    """Templates of valid classes, with the slots of the main text.

    A slot belongs to it if most of its text is marked content. Hosts that mark none take
    slots whose text is mostly not links and a fifth of the longest such slot's at least.
    """
    valid = sums.where("gap = -1").where((F.col("first") == F.col("last"))
                                         & (F.col("bad") <= BAD * F.col("pages"))).select("host", "class")
    tokens_ = templates.select("host", F.explode(F.arrays_zip("keys", "classes")).alias("t")) \
        .select("host", F.col("t.keys").alias("key"), F.col("t.classes").alias("class"))
    # Without the classes that go, texts of their slots lie in the slot around; it is kept as well.
    left = tokens_.join(valid, ["host", "class"]).groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("key", "class"))).alias("t"))
    text = sums.where("gap >= 0")
    most = text.groupBy("host").agg(
        F.max(F.when(2 * F.col("marked") > F.col("chars"), 1).otherwise(0)).alias("marks"),
        F.max(F.when(2 * F.col("linked") < F.col("chars"), F.col("chars") - F.col("fixed"))).alias("most"),
        (2 * F.sum("fixed") < F.sum("chars")).alias("drops"))
    main = text.join(most, "host").where(
        F.when(F.col("marks") == 1, 2 * F.col("marked") > F.col("chars"))
        .otherwise((2 * F.col("linked") < F.col("chars"))
                   & (5 * (F.col("chars") - F.col("fixed")) >= F.col("most")))) \
        .groupBy("host").agg(F.collect_list(F.struct("class", "gap")).alias("main"),
                             F.first("drops").alias("drops"))
    return left.join(main, "host").select(
        "host", F.col("t.key").alias("keys"), F.col("t.class").alias("classes"), "main", "drops")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = stage(tokens(rows), "html-tokens")
    first = stage(classes(found).withColumn("main", F.lit(None).cast("array<struct<class:bigint,gap:int>>"))
                  .withColumn("drops", F.lit(False)), "html-classes")
    unstage(found)
    # Classes that fail go; the slots of their hosts are measured again between what is left.
    checked = stage(judged(first, slots(rows, first)), "html-valid")
    smaller = stage(checked.join(first.select("host", F.size("keys").alias("n")), "host")
                    .where(F.size("keys") < F.col("n")).drop("n"), "html-smaller")
    templates = stage(checked.join(smaller.select("host"), "host", "left_anti").unionByName(
        judged(smaller, slots(rows, smaller))), "html-templates") if smaller.count() else checked
    unstage(first, smaller)
    kinds = rows.schema

    def work(parts: Iterator[pa.RecordBatch], lookup: Callable) -> Iterator[pa.RecordBatch]:
        for part in parts:
            with no_cycles():
                texts = [extracted(parsed(html or ""), lookup(host)) for host, html in
                         zip(part.column("host").to_pylist(), part.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())],
                                             ["id", "url", "text"])

    out = f"id {kinds['id'].dataType.simpleString()}, url string, text string"
    return met(rows, templates, work, out).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
