"""Main text of web pages by equivalence classes of template tokens over each host's pages.

Tokens are a page's containers (elements that hold blocks), opened and closed, by their path of tags, classes and ids
where that is on enough of the host's pages, else by their path of tags alone; and the text that a container itself
holds, as one token. Tokens whose occurrences on every page of the host are equally many are one class: their vectors of
counts meet in two sums of hashes, so no page's tokens are gathered with another's. A class is valid if its tokens come in one
order on SUPPORT of its pages, each occurrence after the other, and cross no larger class: of two classes every
occurrence of one lies between two tokens that follow one another in the other. Valid classes nest, each in the class
whose token opens last before it, and make up the host's template; what a container of a valid class holds that isn't
template is a slot, and a container whose own text is template on that many pages is none.

Of the slots, those in the host's articles and main elements are content, whichever hold the most (see ``templates``);
where it has neither, the slot with the most text outside links and every other slot in its class, or in one nested in
that, which typically holds a passage. A page's text is what its content containers and its own articles hold,
without the noise nested in them (menus, adverts, forms, scripts, comments and the like, by fixed names). Pages of hosts
with too few pages, or without any of their host's slots, choose by marks and mass from themselves alone.

Defined results: null html is an empty page with empty text, so is an empty one; a null url is a host of its own without
a template; repeated rows are extracted one by one; an empty table gives an empty result; malformed markup is read as
far as it goes (unclosed elements end with their parents, an unfinished tag at the end is dropped). Slots of equal mass:
the larger token. A long or deep page is read in one pass and held whole. Only id, url and html are read, so other
columns may have any names. Text inside chosen containers is never dropped for being repeated.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small_batches, staged, type_of
from .url_filter import host_of

LEAST_PAGES = 3  # of a host that a template is deduced for
SUPPORT = 0.6  # share of a host's pages that hold a template token
NESTED = 4  # levels of classes below the heaviest slot's that further slots are looked for in
PASSAGE = 40  # characters outside links that a further slot typically holds

#: Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|title|object|select"
FOREIGN = "svg|math"  # these alone may close themselves
NOISE = frozenset("head nav aside footer form script style noscript template iframe textarea title svg math object select button dialog menu".split())
CONTAINERS = frozenset("html body article main section div nav aside header footer form ul ol table tbody tr td blockquote figure details dl center".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption th thead tfoot summary br hr legend fieldset option head".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation sidebar footer header masthead topbar cookie cookies consent notice notices alert popup modal newsletter subscribe signup login share sharing social related recommended comment comments respond disqus breadcrumb breadcrumbs pagination pager widget skip toolbar copyright".split()
)
CONTENT_WORDS = frozenset("article content post entry story main text body".split())
#: Words that are no noise beside a content word in one class, as in entry-header.
WEAK_WORDS = frozenset("header banner notice notices alert".split())
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:{FOREIGN})\b[^>]*/>|<({RAW}|{FOREIGN})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Page:
    """A page's pieces: (container, noise, in a link, text), None between blocks; and its containers in their order."""

    def __init__(self, html: str) -> None:
        self.pieces: list[tuple[int, bool, bool, str] | None] = []
        self.paths: list[int] = [0]
        self.tags: list[int] = [0]
        self.parents: list[int] = [-1]
        self.kinds: list[int] = [0]  # 3 article, 2 main, 1 named as content, 0 other
        self.noisy: list[bool] = [False]
        self.opens: list[int] = [0]  # places of the tokens on the page
        self.closes: list[int] = [0]
        self._read(html)

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, container, noise, in a link, in an article or main
        at, noise, link, inside = 0, False, False, False
        pieces = self.pieces
        place = 1

        def end(k: int) -> None:
            nonlocal place
            for tag, container, *_ in reversed(stack[k:]):
                if tag in CONTAINERS:
                    self.closes[container] = place
                    place += 1
            del stack[k:]

        for m in _TOKEN.finditer(html):
            raw, closing, tag, attributes = m.groups()
            if raw is not None:
                continue
            if tag is None:
                text = m[0]
                if text[0] != "<" or text == "<":
                    pieces.append((at, noise, link, unescape(text) if "&" in text else text))
                continue
            tag = tag.lower()
            if tag in BREAKS:
                pieces.append(None)
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        end(k)
                        break
                    if stack[k][0] in CONTAINERS and tag not in CONTAINERS:
                        break  # an inline or paragraph end doesn't close a container
                _, at, noise, link, inside = stack[-1] if stack else ("", 0, False, False, False)
                continue
            if tag == "body":
                while stack and stack[-1][0] != "html":
                    end(len(stack) - 1)
            elif tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6") or tag in CONTAINERS:
                # these end an open paragraph and what is open inside it, an item the last one
                ended = "li" if tag == "li" else "p"
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == ended:
                        end(k)
                        break
                    if stack[k][0] in CONTAINERS:
                        break
            _, at, noise, link, inside = stack[-1] if stack else ("", 0, False, False, False)
            if tag in VOID or attributes.endswith("/"):
                continue
            names = [(a.lower(), (b or c or d).lower()) for a, b, c, d in _NAMES.findall(attributes)] if attributes else []
            role = next((v for a, v in names if a == "role"), "")
            kind = 3 if tag == "article" else 2 if tag == "main" or role == "main" else 0
            words, noises = set(), set()
            for name in (x for a, v in names if a != "role" for x in v.split()):
                parts = set(_SPLIT.split(name))
                words |= parts
                noises |= parts & (NOISE_WORDS - WEAK_WORDS if parts & CONTENT_WORDS else NOISE_WORDS)
            strange = tag in NOISE or (tag == "header" and not inside) or bool(attributes and _HIDDEN.search(attributes))
            if not kind and tag not in ("html", "body"):
                strange = strange or bool(noises) or role in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert")
                kind = 1 if words & CONTENT_WORDS else 0
            if kind == 3 and words & {"comment", "comments", "related", "promo"}:
                strange = True
            noise, link, inside = noise or strange, link or tag == "a", inside or kind >= 2
            if tag in CONTAINERS:
                label = tag + "".join(sorted(f".{w}" for a, v in names if a == "class" for w in v.split())) + "".join(f"#{v}" for a, v in names if a == "id")
                self.paths.append(below(self.paths[at], label))
                self.tags.append(below(self.tags[at], tag))
                self.parents.append(at)
                self.kinds.append(kind)
                self.noisy.append(noise)
                self.opens.append(place)
                self.closes.append(0)
                place += 2  # the container's own text is a token after its opening
                at = len(self.paths) - 1
            stack.append((tag, at, noise, link, inside))
        end(0)
        self.closes[0] = place

    def mass(self) -> list[int]:
        """Characters outside links and noise that each container itself holds."""
        got = [0] * len(self.paths)
        for piece in self.pieces:
            if piece and not piece[1] and not piece[2]:
                got[piece[0]] += len(piece[3].strip())
        return got

    def whole(self, mass: list[int]) -> list[int]:
        """Mass with what is nested: containers come after those around them."""
        got = list(mass)
        for i in range(len(got) - 1, 0, -1):
            got[self.parents[i]] += got[i]
        return got

    def own_texts(self) -> list[int]:
        """A hash of the text that each container itself holds, links and noise included; 0 for none."""
        texts: list[list[str]] = [[] for _ in self.paths]
        for piece in self.pieces:
            if piece:
                texts[piece[0]] += piece[3].split()
        return [below(p, " ".join(t)) if t else 0 for p, t in zip(self.tags, texts, strict=True)]

    def tokens(self, frequent: set[int]) -> list[int]:
        """Each container's token: its whole path where that is the template's, else its path of tags."""
        return [p if p in frequent else q for p, q in zip(self.paths, self.tags, strict=True)]

    def chosen(self, frequent: set[int] | None, content: set[int] | None) -> set[int]:
        """Content containers: the template's content slots and the page's own articles, or the page's own best."""
        articles = {i for i, k in enumerate(self.kinds) if k == 3 and not self.noisy[i]}
        if content:
            tokens = self.tokens(frequent)
            found = {i for i, t in enumerate(tokens) if not self.noisy[i] and t in content}
            if found:
                # an article that is template and not content is a teaser
                return found | {i for i in articles if tokens[i] not in frequent}
        if articles:
            return articles
        mass = self.mass()
        whole = self.whole(mass)
        for kind in (2, 1):
            of_kind = [i for i, k in enumerate(self.kinds) if k == kind and not self.noisy[i]]
            if of_kind:
                return {max(of_kind, key=lambda i: (whole[i], -i))}
        return {max(range(len(mass)), key=lambda i: (mass[i], -i))}

    def text(self, chosen: set[int]) -> str:
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):
            inside[i] = i in chosen or (i > 0 and inside[parent])
        blocks: list[str] = []
        block: list[str] = []
        for piece in self.pieces:
            if piece is None:
                if block:
                    blocks += "".join(block).split()
                    block = []
            elif not piece[1] and inside[piece[0]]:
                block.append(piece[3])
        blocks += "".join(block).split()
        return " ".join(blocks)


def below(parent: int, label: str) -> int:
    """The signed 64-bit token of a label under a parent's."""
    return xxhash.xxh64_intdigest(label, seed=parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


_LONGS = ("p", "q", "x", "open", "close", "kind", "outer", "mass", "whole", "noisy")


def _lists(rows: list[list[int]]) -> pa.Array:
    return pa.array(rows, pa.list_(pa.int64()))


def _tokens(batches):
    """Each page's containers, one list for each of their facts, and how often each token occurs."""
    for batch in batches:
        facts: dict[str, list] = {name: [] for name in (*_LONGS, "t", "n")}
        for html in batch.column(1).to_pylist():
            page = Page(html or "")
            mass, texts = page.mass(), page.own_texts()
            outer = [0] * len(mass)  # mark of the containers around
            for i in range(1, len(mass)):
                outer[i] = max(outer[page.parents[i]], page.kinds[page.parents[i]])
            counts: dict[int, int] = {}
            for many in (page.paths, page.tags, texts):
                for t in many:
                    counts[t] = counts.get(t, 0) + 1
            whole, noisy = page.whole(mass), [int(x) for x in page.noisy]
            for name, got in zip((*_LONGS, "t", "n"), (page.paths, page.tags, texts, page.opens, page.closes, page.kinds, outer, mass, whole, noisy, list(counts), list(counts.values())), strict=True):
                facts[name].append(got)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(_lists, facts.values())], ["host", "r", *facts])


def arranged(events: list[tuple[int, int, int]]) -> list[tuple[int, int, bool, int]]:
    """(class, order, whether it crosses a larger class, the class that it is nested in or 0) of each class on a page.

    Events are (place, class, token). The order is a hash of a class's tokens in their places where all its
    occurrences repeat it, else 0.
    """
    events.sort()
    places: dict[int, list[int]] = {}
    tokens: dict[int, list[int]] = {}
    for at, c, t in events:
        places.setdefault(c, []).append(at)
        tokens.setdefault(c, []).append(t)
    rounds, orders = {}, {}
    for c, ts in tokens.items():
        k = len(set(ts))
        regular = len(ts) % k == 0 and ts == ts[:k] * (len(ts) // k)
        orders[c] = below(1, ",".join(map(str, ts[:k]))) if regular else 0
        rounds[c] = np.array(places[c]).reshape(-1, k) if regular else np.array(places[c]).reshape(1, -1)
    flat = {c: np.array(at) for c, at in places.items()}
    nested = lambda a, b: bool((np.ptp(np.searchsorted(flat[a], rounds[b]), axis=1) == 0).all())
    out = []
    for b in places:
        crossed, parent, nearest = False, 0, -1
        for a in places:
            if a == b:
                continue
            if nested(a, b):
                gap = int(np.searchsorted(flat[a], flat[b][0]))
                if 0 < gap < len(flat[a]) and flat[a][gap - 1] > nearest:
                    parent, nearest = a, int(flat[a][gap - 1])
            elif not nested(b, a) and (len(flat[b]), b) < (len(flat[a]), a):
                crossed = True
        out.append((b, orders[b], crossed, parent))
    return out


_FACTS = ("c", "order", "crossed", "parent")
_SLOTS = ("st", "sc", "sx", "by_path", "skind", "souter", "smass", "swhole")


def _arrange(batches):
    """How a page's classes lie, and what its slots hold: lists by class, then lists by container of a class."""
    for batch in batches:
        columns = {name: batch.column(batch.schema.get_field_index(name)).to_pylist() for name in (*_LONGS, "known", "classes")}
        out: dict[str, list] = {name: [] for name in (*_FACTS, *_SLOTS)}
        for row in range(batch.num_rows):
            p, q, x, opens, closes, kind, outer, mass, whole, noisy = (columns[name][row] for name in _LONGS)
            of = dict(zip(columns["known"][row], columns["classes"][row], strict=True))
            events, slots = [], []
            for i in range(len(p)):
                t = p[i] if p[i] in of else q[i]
                if t in of:
                    events += ((opens[i], of[t], t), (closes[i], of[t], ~t))
                    if i and not noisy[i]:
                        slots.append((t, of[t], x[i], int(t == p[i]), kind[i], outer[i], mass[i], whole[i]))
                if x[i] and x[i] in of:
                    events.append((opens[i] + 1, of[x[i]], x[i]))
            for names, got in ((_FACTS, arranged(events)), (_SLOTS, slots)):
                for k, name in enumerate(names):
                    out[name].append([int(g[k]) for g in got])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(_lists, out.values())], ["host", "r", *out])


def _extract(batches):
    for batch in batches:
        known = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
        texts = []
        for html, (frequent, content) in zip(batch.column(2).to_pylist(), known, strict=True):
            page = Page(html or "")
            texts.append(page.text(page.chosen(set(frequent or ()), set(content or ()))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])


def _schema(names: tuple[str, ...]) -> str:
    return ", ".join(["host string", "r long", *(f"{name} array<long>" for name in names)])


def classes(each: DataFrame) -> DataFrame:
    """(host, all, known, classes): each host's frequent tokens with the class of each; as long as a page's tokens at most, over SUPPORT."""
    hosts = each.groupBy("host").agg(F.count("*").alias("all")).where(F.col("all") >= LEAST_PAGES)
    met = each.select("host", "r", F.explode(F.arrays_zip("t", "n")).alias("x")).select("host", "r", "x.t", "x.n").where("t <> 0 OR n > 0")
    # equal vectors of counts, by two sums that can't overflow
    part = lambda *c: F.sum(F.pmod(F.xxhash64(*c), F.lit((1 << 31) - 1)))
    vectors = met.groupBy("host", "t").agg(F.count("*").alias("pages"), part("r", "n").alias("u"), part("n", "r").alias("v"))
    frequent = vectors.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("all"))
    pairs = F.array_sort(F.collect_list(F.struct("t", F.xxhash64("pages", "u", "v").alias("c"))))
    return frequent.groupBy("host", "all").agg(pairs.alias("m")).select("host", "all", F.col("m.t").alias("known"), F.col("m.c").alias("classes"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, frequent, content): the tokens of each host's valid classes and those of its content slots; one short row a host."""
    each = staged(pages.where("host is not null").mapInArrow(_tokens, _schema((*_LONGS, "t", "n"))), "tokens")
    found = staged(classes(each), "classes")
    laid = staged(each.join(found, "host").select("host", "r", *_LONGS, "known", "classes").mapInArrow(_arrange, _schema((*_FACTS, *_SLOTS))), "laid")
    # valid: one order on enough of a class's pages, without crossing
    of_page = laid.select("host", F.explode(F.arrays_zip(*_FACTS)).alias("x")).select("host", "x.*")
    orders = of_page.groupBy("host", "c", "order", "parent").agg(F.count("*").alias("n"), F.count_if(F.expr("crossed = 0")).alias("uncrossed"))
    orders = orders.groupBy("host", "c", "order").agg(F.sum("n").alias("n"), F.sum("uncrossed").alias("uncrossed"), F.max_by("parent", "n").alias("parent"))
    valid = orders.groupBy("host", "c").agg(F.sum("n").alias("pages"), F.max(F.when(F.col("order") != 0, F.col("uncrossed"))).alias("good"), F.max_by("parent", "n").alias("parent"))
    valid = staged(valid.where(F.col("good") >= SUPPORT * F.col("pages")).select("host", "c", "parent"), "valid")
    # what one page has of a slot, then on how many pages its text is the same
    slots = laid.select("host", "r", F.explode(F.arrays_zip(*_SLOTS)).alias("x")).select("host", "r", "x.*")
    slots = slots.join(valid, (slots["host"] == valid["host"]) & (slots["sc"] == valid["c"])).select(slots["host"], "r", "c", "parent", F.col("st").alias("t"), "sx", "by_path", "skind", "souter", "smass", "swhole")
    page = slots.groupBy("host", "t", "r").agg(
        F.min("c").alias("c"), F.min("parent").alias("parent"), F.max(F.when(F.col("by_path") == 1, F.col("skind"))).alias("k1"), F.min("skind").alias("k2"), F.min("souter").alias("outer"), F.sum("smass").alias("mass"), F.sum("swhole").alias("whole"), F.bit_xor("sx").alias("text")
    )
    alike = page.groupBy("host", "t", "text").agg(
        F.min("c").alias("c"), F.min("parent").alias("parent"), F.count("*").alias("same"), F.max("k1").alias("k1"), F.min("k2").alias("k2"), F.min("outer").alias("outer"), F.sum("mass").alias("mass"), F.sum("whole").alias("whole"), F.sum(F.log1p("mass")).alias("logs")
    )
    sums = alike.groupBy("host", "t").agg(
        F.min("c").alias("c"), F.min("parent").alias("parent"), F.sum("same").alias("pages"), F.max("same").alias("same"), F.coalesce(F.max("k1"), F.min("k2")).alias("kind"), F.min("outer").alias("outer"), F.sum("mass").alias("mass"), F.sum("whole").alias("whole"), F.sum("logs").alias("logs")
    )
    members = F.collect_list(F.struct("t", "c", "parent", "kind", "outer", "mass", "whole", (F.expm1(F.col("logs") / F.col("pages"))).alias("usual"), (F.col("same") < SUPPORT * F.col("pages")).alias("varies")))
    hosts = sums.groupBy("host").agg(members.alias("m"))
    total = lambda which: F.aggregate(F.filter("m", which), F.lit(0).cast("long"), lambda s, x: s + x["whole"])
    article = lambda x: (x["kind"] == 3) & (x["outer"] < 3)
    main = lambda x: (x["kind"] == 2) & (x["outer"] < 2)
    hosts = hosts.withColumns({"articles": total(article), "mains": total(main), "heavy": F.array_max(F.transform(F.filter("m", lambda x: x["varies"]), lambda x: F.struct(x["mass"], x["t"], x["c"])))})
    # articles hold the page where main adds less than they have; else main does, and articles of less are teasers
    marked = F.exists("m", lambda x: x["kind"] >= 2)
    by_mark = F.when(2 * F.col("articles") >= F.col("mains"), F.filter("m", article)).otherwise(F.filter("m", main))
    # the classes below the heaviest slot's: nesting is as deep as pages are, so a few steps down reach what pages hold
    hosts = hosts.withColumn("near", F.array(F.col("heavy.c")))
    for _ in range(NESTED):
        nested = F.transform(F.filter("m", lambda x: F.array_contains("near", x["parent"])), lambda x: x["c"])
        hosts = hosts.withColumn("near", F.array_union("near", nested))
    by_mass = F.filter("m", lambda x: x["varies"] & ((x["t"] == F.col("heavy.t")) | (F.array_contains("near", x["c"]) & (x["usual"] >= PASSAGE))))
    return hosts.select("host", F.transform("m", lambda x: x["t"]).alias("frequent"), F.transform(F.when(marked, by_mark).otherwise(by_mass), lambda x: x["t"]).alias("content"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars."""
    small_batches(pages.sparkSession, 500)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    found = staged(templates(source.select("host", "html", F.xxhash64("id", "url").alias("r"))), "templates")
    joined = source.join(found, "host", "left").select("id", "url", "html", "frequent", "content")
    out = joined.mapInArrow(_extract, f"id {type_of(pages, id_col)}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
