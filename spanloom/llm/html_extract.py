"""Main text of web pages by equivalence classes of template tokens.

Tokens of a page are its elements (by their path) and its text blocks (by path and text). Over all
distinct pages of a host (rows of the same markup are one page) each token has an occurrence vector:
how often it stands in each page. Vectors are compared by support and an order-free hash, so no host is ever gathered. Tokens that share a vector
and are frequent form a class; a class of two or more tokens that keep their order on a page is
valid there. Valid classes nest into the host's template. Its elements that stand once, and the
elements that hold them, are the template's slots; its text that stands on nearly all pages is constant.

What the slots hold is then added up over the host's distinct pages: characters that are neither
constant, linked nor in an aside, with more weight where a name says article. The innermost slot that
holds most of them is the host's article, and it is what is extracted from each page that has it.
Names of elements are evidence within slots: they weigh, and they take asides out of the article.
Only pages without that slot (other layouts, hosts of one distinct page) are read by names alone.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, checkpointed, table

#: A token is frequent if it stands in at least this share of the host's distinct pages, and in two at least: a vector over one page compares nothing.
SHARE = 0.5
LEAST_PAGES = 2
#: Text is constant only where it stands on this share of the pages, and on so many that chance and shared passages are unlikely.
CONSTANT_SHARE = 0.9
CONSTANT_PAGES = 4
#: The article is the innermost slot with this share of the host's open text.
HOLDS = 0.7
#: Characters weigh this much more where a name says article; constant ones so little that they only count where there is nothing else.
MARKED = 3.0
CONSTANT = 1e-3
#: Pages that a task remembers at once, so as to read a repeated one only once; the memory is emptied when full.
REMEMBER = 100_000
#: Template tokens that are broadcast at once; beyond, pages and templates are joined by host and salt, templates repeated by salt.
BROADCAST_TOKENS = 200_000
SALTS = 32
#: In a slot that nothing names, more linked text than this share means a menu.
LINKED = 0.5

#: Elements whose content is no text of the page, up to their end tags; fixed by HTML.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style title noscript template iframe svg math object canvas textarea select audio video".split()}
#: Those that run to the end of the page where they have no end tag; others are then elements like any.
TO_THE_END = frozenset(("script", "style", "textarea"))
#: Elements without text that may stand in a head; any other one ends it, as its end tag may be left out.
HEAD = frozenset("base basefont bgsound link meta".split())
#: A slash that ends an unquoted value, not the tag.
VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that are never part of an article.
ASIDE = frozenset("nav footer aside form button menu dialog fieldset label".split())
#: Words in class, id and role that say so, too.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar rail aside widget related recommended recommendations teaser teasers "
    "cookie cookies consent notice notices alert popup modal overlay gdpr newsletter subscribe subscription signup login search form share sharing social comment comments commentlist reply replies respond response responses discussion disqus pagination pager toolbar "
    "copyright legal disclaimer complementary contentinfo".split()
)
ARTICLE_WORDS = frozenset("article post entry story content main articlebody".split())
NAMES = re.compile(r"[a-z0-9]+|[A-Z][a-z0-9]*")
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<bad>/?[a-zA-Z])[^<>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Numbers in names that differ from page to page, such as post-1234; a single digit belongs to the name.
NUMBER = re.compile("[0-9]{2,}")


class Block:
    """A run of text between block elements: text, length of its linked part, token, whether it is in an aside, an article, a main element, elements before it, the element it is in (-1: none)."""

    __slots__ = ("after", "article", "aside", "inside", "linked", "main", "text", "token")

    def __init__(self, text, linked, token, aside, article, main, after, inside):
        self.text, self.linked, self.token, self.aside, self.article, self.main, self.after, self.inside = text, linked, token, aside, article, main, after, inside


def marks(attrs: str) -> tuple[str, set[str], bool]:
    """Of an element: what names it in a path, the words in its names, whether it is hidden."""
    if not attrs or attrs.isspace():
        return "", set(), False
    named, words, hidden = [], set(), False
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden":
            hidden = True
        elif key == "style":
            hidden |= bool(HIDDEN.search(value))
        else:
            named.append(f"{key}={NUMBER.sub('#', value)}")
            words |= {w.lower() for w in NAMES.findall(value)}
            if key == "itemprop" and value.lower() == "articlebody":
                words.add("articlebody")
    return " ".join(named), words, hidden


def parse(page: str) -> tuple[list[int], list[Block], list[int]]:
    """Path tokens of all elements in page order, all blocks with text, and of each element the one that it is in (-1: none)."""
    from xxhash import xxh64_intdigest as digest

    tokens: list[int] = []
    parents: list[int] = []
    blocks: list[Block] = []
    # tag, path, aside, article, main, number of the element, place in the stack of the nearest block element at or above it
    stack: list[tuple[str, int, bool, bool, bool, int, int]] = [("", 0, False, False, False, -1, 0)]
    # where the open elements of each tag stand in the stack, so that no tag looks through it
    opened: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, path, _, article, main, inside, _ = stack[stack[-1][6]]
                blocks.append(Block(text, linked, digest(text.encode(), path), stack[-1][2], article, main, len(tokens), inside))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        decoded = html_lib.unescape(text) if "&" in text else text
        parts.append(decoded)
        if in_link:
            linked += len(decoded.strip())

    def close(k: int) -> None:
        """Close the elements from place k of the stack on."""
        nonlocal in_link
        while len(stack) > k:
            was = stack.pop()[0]
            opened[was].pop()
            in_link -= was == "a"

    in_head = False
    unclosed: set[str] = set()
    at = 0
    while m := PIECE.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "head":
            flush()
            in_head = not m["end"]
            continue
        if tag in RAW and not m["end"]:
            if m["attrs"].endswith("/") and (tag in ("svg", "math") or not VALUE_SLASH.search(m["attrs"])):
                continue
            # an end tag that was not found once is not looked for again
            end = None if tag in unclosed else RAW[tag].search(page, at)
            if end or tag in TO_THE_END:
                if tag in ("template", "textarea", "select"):
                    flush()
                at = end.end() if end else len(page)
                continue
            unclosed.add(tag)
        if in_head:
            if tag in HEAD:
                continue
            in_head = False
        block = tag in BLOCKS
        if m["end"]:
            if block:
                flush()
            if opened.get(tag):
                close(opened[tag][-1])
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if block:
            flush()
            # what closes by itself is a block element, so only the nearest one can be closed
            if (k := stack[-1][6]) and (stack[k][0] == "p" or stack[k][0] in CLOSED_BY_ITSELF.get(tag, ())):
                close(k)
        name, words, hidden = marks(m["attrs"])
        _, path, aside, article, main, inside, nearest = stack[-1]
        path = digest(f"{tag} {name}".encode(), path)
        tokens.append(path)
        parents.append(inside)
        if tag in VOID:
            continue
        if tag not in ("html", "body"):
            shy = words & ASIDE_WORDS
            if tag in ("article", "main"):
                shy &= {"comment", "comments", "reply", "teaser", "related", "ad", "advert", "sponsored", "promo"}
            elif words & ARTICLE_WORDS:
                shy -= {"header", "main"}
            aside = aside or hidden or tag in ASIDE or tag == "header" and not article or bool(shy)
            if not aside and (tag == "article" or "articlebody" in words):
                article = True
            elif not aside and (tag == "main" or "main" in words or words & ARTICLE_WORDS and block):
                main = True
        in_link += tag == "a"
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, path, aside, article, main, len(tokens) - 1, len(stack) if block else nearest))
    if at < len(page):
        add(page[at:])
    flush()
    return tokens, blocks, parents


def occurrences(page: str) -> dict[int, tuple[int, int, bool]]:
    """How often each token stands on the page, where first, and whether it is an element (or else a text block)."""
    tokens, blocks, _ = parse(page)
    elements = set(tokens)
    found: dict[int, tuple[int, int, bool]] = {}
    for i, t in enumerate(all_tokens(tokens, blocks)):
        n, first, element = found.get(t) or (0, i, t in elements)
        found[t] = (n + 1, first, element)
    return found


def all_tokens(tokens: list[int], blocks: list[Block]) -> list[int]:
    """Elements and blocks in page order: a block follows the elements that were open or closed before it."""
    out: list[int] = []
    at = 0
    for b in blocks:
        out += tokens[at : b.after]
        out.append(b.token)
        at = b.after
    return out + tokens[at:]


class Template(NamedTuple):
    """What is frequent on a host. ``tokens``: (token, class, 1 for an element that stands once where it stands, 1 for constant text, mean place, support), tokens unsigned; ``article``: the slot to extract, or None."""

    tokens: list[tuple[int, int, int, int, float, int]]
    article: int | None = None


NOTHING = Template([])


def valid_template(tokens: list[int], template: Template) -> tuple[set[int], dict[int, int]]:
    """Of a host's template what is valid on a page: its constant texts, and its elements that stand once, with their support.

    The single tokens of a class must come in the order that they have over all pages. From the
    widest class down, a class must nest: it lies within one slot of each class already taken, or that one within a slot of it.
    """
    places: dict[int, list[int]] = {t: [] for t, *_ in template.tokens}
    for i, t in enumerate(tokens):
        if t in places:
            places[t].append(i)
    classes: dict[int, list[tuple[float, int, int, int, int]]] = {}
    for t, c, once, constant, rank, support in template.tokens:
        if places[t]:
            classes.setdefault(c, []).append((rank, t, once, constant, support))
    taken: list[list[int]] = []
    constants: set[int] = set()
    single: dict[int, int] = {}
    for members in sorted(classes.values(), key=lambda m: (-len(m), min(m))):
        members.sort()
        alone = [places[m[1]][0] for m in members if len(places[m[1]]) == 1]
        if alone != sorted(alone):
            continue
        own = sorted(i for m in members for i in places[m[1]])
        if not all(bisect_left(a, own[0]) == bisect_left(a, own[-1]) or bisect_left(own, a[0]) == bisect_left(own, a[-1]) for a in taken):
            continue
        taken.append(own)
        constants |= {m[1] for m in members if m[3]}
        single |= {m[1]: m[4] for m in members if m[2] and len(places[m[1]]) == 1}
    return constants, single


class Layout:
    """A page seen through its host's template: constant texts, the elements that are slots and their names over all pages of the host."""

    def __init__(self, page: str, template: Template):
        self.tokens, self.blocks, self.parents = parse(page)
        if template.tokens:
            self.constants, self.single = valid_template(all_tokens(self.tokens, self.blocks), template)
        else:  # nothing to compare with: the elements that stand once on the page cut it
            self.constants, self.single = set(), {t: 1 for t, n in Counter(self.tokens).items() if n == 1}
        # an element that holds slots is one, too; it is known by the best supported, first of them
        best: dict[int, tuple[int, int]] = {}
        for i in range(len(self.tokens) - 1, -1, -1):
            own = best.get(i)
            if (support := self.single.get(self.tokens[i])) is not None:
                own = max(own or (0, 0), (support, -i))
            if own:
                best[i] = own
                up = self.parents[i]
                if up >= 0:
                    best[up] = max(best.get(up, own), own)
        mask = (1 << 64) - 1
        self.slots = {i: t if (t := self.tokens[i]) in self.single else (t * 31 + self.tokens[-k] * 17 + 1) & mask for i, (_, k) in best.items()}

    def open_text(self) -> dict[int, float]:
        """Weight of the open text in each slot and all that it holds; slot 0 is the page. Slots without any are left out."""
        inside = [0.0] * (len(self.tokens) + 1)
        for b in self.blocks:
            if b.aside or b.linked > LINKED * len(b.text):
                continue
            weight = float(len(b.text) - b.linked)
            if b.article or b.main:
                weight *= MARKED
            elif b.token in self.constants:
                weight *= CONSTANT
            inside[b.inside] += weight
        for i in range(len(self.tokens) - 1, -1, -1):
            inside[self.parents[i]] += inside[i]
        return {0: inside[-1]} | {slot: inside[i] for i, slot in self.slots.items() if inside[i] > 0}

    def depths(self) -> list[int]:
        """How many elements hold each one, itself included."""
        depth = [0] * (len(self.parents) + 1)
        for i, up in enumerate(self.parents):
            depth[i] = depth[up] + 1
        return depth

    def within(self, slot_at: int) -> list[bool]:
        """For each block, whether the element holds it."""
        held = [False] * (len(self.tokens) + 1)
        for i, up in enumerate(self.parents):
            held[i] = i == slot_at or held[up]
        return [held[b.inside] for b in self.blocks]

    def unlinked(self, blocks: list[Block]) -> list[str]:
        """The texts of blocks whose slots, between the elements that stand once, are not mostly links."""
        cuts = [i for i, t in enumerate(self.tokens) if t in self.single]
        slots = [bisect_left(cuts, b.after) for b in blocks]
        size, linked = Counter(), Counter()
        for slot, b in zip(slots, blocks, strict=True):
            size[slot] += len(b.text)
            linked[slot] += b.linked
        return [b.text for slot, b in zip(slots, blocks, strict=True) if linked[slot] <= LINKED * size[slot]]


def extract(page: str, template: Template = NOTHING) -> tuple[str, str]:
    """The article's blocks, and what decided on them: ``template`` or ``names``."""
    layout = Layout(page, template)
    at = next((i for i, slot in layout.slots.items() if slot == template.article), None) if template.article is not None else None
    open_blocks = [b for b in layout.blocks if not b.aside]
    if at is None:
        for kind in ("article", "main"):
            if named := [b.text for b in open_blocks if getattr(b, kind)]:
                return "\n\n".join(named), "names"
        return "\n\n".join(layout.unlinked([b for b in open_blocks if b.token not in layout.constants] or open_blocks)), "names"
    inside = [b for b, held in zip(layout.blocks, layout.within(at), strict=True) if held and not b.aside]
    kind = next((k for k in ("article", "main") if any(getattr(b, k) for b in inside)), None)
    if kind:
        # names within the slot are the nearer evidence; what they name beside it, as a second article, belongs to it unless it is mostly links
        held = {id(b) for b in inside if getattr(b, kind)}
        beside = [b for b in open_blocks if getattr(b, kind) and id(b) not in held]
        if sum(b.linked for b in beside) > LINKED * sum(len(b.text) for b in beside):
            beside = []
        held |= {id(b) for b in beside}
        return "\n\n".join(b.text for b in open_blocks if id(b) in held), "template"
    return "\n\n".join(layout.unlinked([b for b in inside if b.token not in layout.constants] or inside)), "template"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null and other texts have the empty host."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def markup_of(html: Column) -> Column:
    """The page as text; null markup is empty."""
    return F.coalesce(html.cast("string"), F.lit(""))


class Seen:
    """The pages that a task has met; it forgets them all when it holds REMEMBER, so that its size is bounded."""

    def __init__(self) -> None:
        self.met: set[tuple[str, int]] = set()

    def first(self, host: str, key: int) -> bool:
        if (host, key) in self.met:
            return False
        if len(self.met) >= REMEMBER:
            self.met.clear()
        self.met.add((host, key))
        return True


def keyed_pages(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    markup = markup_of(F.col(html_col))
    return pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(markup).alias("page"), markup.alias("html"))


def token_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, token, page, n, first, element``: one row per token of a distinct page; pages of a host with the same markup are one."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for host, key, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not seen.first(host, key):
                    continue
                found = occurrences(page)
                n, first, element = zip(*found.values(), strict=True) if found else ((), (), ())
                for col, v in zip(rows, ([host] * len(found), map(_signed, found), [key] * len(found), n, first, element), strict=True):
                    col.extend(v)
            types = (pa.string(), *[pa.int64()] * 4, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["host", "token", "page", "n", "first", "element"])

    counts = keyed_pages(pages, url_col, html_col).mapInArrow(run, "host string, token long, page long, n long, first long, element boolean")
    # copies that other tasks read: a page's tokens meet by page, so no frequent token gathers in one task
    return counts.repartition("host", "page").dropDuplicates(["host", "page", "token"])


def templates(counts: DataFrame, hosts: DataFrame) -> DataFrame:
    """``host, tokens``: (token, class, once, constant, rank, support) of the classes of two or more frequent tokens that share an occurrence vector.

    ``hosts`` has the number of distinct ``pages`` per ``host``. At most 1 / SHARE times the tokens of its average page are frequent on a host, so a template is no larger than that.
    The vectors' hash takes each page once (see token_counts), so that nothing cancels out in it.
    """
    vectors = counts.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("support"),
        F.max("n").alias("most"),
        F.avg("first").alias("rank"),
        F.max("element").alias("element"),
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
    )
    frequent = vectors.where(F.col("support") >= LEAST_PAGES).join(hosts.where(F.col("pages") >= LEAST_PAGES), "host").where(F.col("support") >= SHARE * F.col("pages"))
    member = F.struct(
        "token",
        "rank",
        (F.col("element") & (F.col("most") == 1)).cast("int").alias("once"),
        (~F.col("element") & (F.col("support") >= CONSTANT_PAGES) & (F.col("support") >= CONSTANT_SHARE * F.col("pages"))).cast("int").alias("constant"),
    )
    classes = frequent.groupBy("host", "support", "vector").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    each = classes.select("host", "support", F.explode("members").alias("t"), F.xxhash64("support", "vector").alias("class"))
    row = F.struct(F.col("t.token").alias("token"), "class", F.col("t.once").alias("once"), F.col("t.constant").alias("constant"), F.col("t.rank").alias("rank"), "support")
    return each.groupBy("host").agg(F.collect_list(row).alias("tokens"))


def with_templates(keyed: DataFrame, found: DataFrame, size: int, *columns: str) -> DataFrame:
    """Pages (``host`` and others) with the ``columns`` of their host in ``found``, null where it has none.

    Few template tokens are broadcast; with more, both sides are shuffled by host and salt, so that a large host spreads over SALTS tasks.
    """
    if size <= BROADCAST_TOKENS:
        return keyed.join(F.broadcast(found.select("host", *columns)), "host", "left")
    repeated = found.select("host", *columns, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return keyed.withColumn("__salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(repeated, ["host", "__salt"], "left").drop("__salt")


def template_reader() -> Callable[[pa.Scalar, pa.Scalar | None], Template]:
    """Turns a host's columns into its template; the last one is kept, as pages of a host often follow each other."""
    last: list = [None, None, NOTHING]

    def read(raw: pa.Scalar, article: pa.Scalar | None) -> Template:
        if last[0] is None or not raw.equals(last[0]) or article != last[1]:
            tokens = [(x["token"] & (1 << 64) - 1, x["class"], x["once"], x["constant"], x["rank"], x["support"]) for x in raw.as_py() or []]
            slot = None if article is None or article.as_py() is None else article.as_py() & (1 << 64) - 1
            last[:] = raw, article, Template(tokens, slot)
        return last[2]

    return read


def articles(pages: DataFrame, found: DataFrame, hosts: DataFrame, size: int, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, article``: of each host with a template the innermost slot that holds a share of HOLDS of the open text of all its distinct pages.

    A page gives one row per slot that holds open text, at most as many as its host's template has elements and those around them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, seen = template_reader(), Seen()
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for host, key, page, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if not raw.is_valid or not seen.first(host, key):
                    continue
                layout = Layout(page.as_py(), template(raw, None))
                all_depths = layout.depths()
                depth = {slot: all_depths[i] for i, slot in layout.slots.items()}
                for slot, weight in layout.open_text().items():
                    for col, v in zip(rows, (host, key, _signed(slot), depth.get(slot, 0), weight), strict=True):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["host", "page", "slot", "depth", "weight"])

    joined = with_templates(keyed_pages(pages, url_col, html_col), found, size, "tokens").select("host", "page", "html", "tokens")
    per_page = joined.mapInArrow(run, "host string, page long, slot long, depth int, weight double")
    # copies in other tasks are equal rows
    once = per_page.dropDuplicates(["host", "slot", "page"])
    slots = once.groupBy("host", "slot").agg(F.max("depth").alias("depth"), F.sum(F.round("weight", 3).cast("decimal(38,3)")).cast("double").alias("weight"), F.count(F.lit(1)).alias("n"))
    # one pass: a host's slots, no more than its template's elements and those around them, are judged within its row
    hosted = slots.groupBy("host").agg(F.collect_list(F.struct("depth", "weight", "slot", "n")).alias("slots")).join(hosts, "host")
    whole = F.filter("slots", lambda s: s["slot"] == 0)[0]["weight"]
    held = F.filter("slots", lambda s: (s["slot"] != 0) & (s["weight"] >= HOLDS * F.col("all")) & (s["n"] >= SHARE * F.col("pages")))
    return hosted.withColumn("all", whole).where("all > 0").select("host", F.array_max(held)["slot"].alias("article"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, the main ``text`` of every page, from its whole markup and empty where there is none, and ``decided``, by ``template`` or ``names``.

    Null markup counts as empty. Pages with a null or odd URL share the empty host. A host of one distinct page (however
    many rows it has) has no template: names decide, and where nothing is named all text outside menus stays. Every row, repeated ones too,
    gives one row. Other columns are not read, whatever their names. An empty table gives an empty one.
    """
    hosts = pages.groupBy(host_of(F.col(url_col)).alias("host")).agg(F.countDistinct(F.xxhash64(markup_of(F.col(html_col)))).alias("pages"))
    found = checkpointed(templates(token_counts(pages, url_col, html_col), hosts))
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    found = checkpointed(found.join(articles(pages, found, hosts, size, url_col, html_col), "host", "left"))
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = with_templates(keyed, found, size, "tokens", "article").select("id", "url", "html", "tokens", "article")
    names = [id_col, "url", "text", "decided"]
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), *[T.StructField(c, T.StringType()) for c in names[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = template_reader()
        for b in batches:
            got = [extract(page.as_py() or "", template(raw, article)) for page, raw, article in zip(b.column(2), b.column(3), b.column(4), strict=True)]
            texts, decided = zip(*got, strict=True) if got else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(decided, pa.string())], names=names)

    return joined.mapInArrow(run, schema)


def op10_equivalence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``: page_id, url, text, n_chars, decided. Nulls, repeated rows and empty tables as in extract_pages."""
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "decided")


QUERIES = {"op10_equivalence_classes": op10_equivalence_classes}
ORACLES: dict[str, str] = {}
