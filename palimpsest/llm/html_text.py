"""Operator 13: the main text of web pages, by the template that the pages of a host share."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import common

#: Share of a host's pages that a token must be on to belong to its template.
SUPPORT = 0.5
#: Pages of a host from which constant text counts as template, and the share of pages that must have it.
PAGES, CONSTANT = 5, 0.95
#: Largest share of a host's text that may be constant: beyond it the pages are copies of each other, not a frame.
MOST_CONSTANT = 0.3
#: Share of pages on which a class of tokens may be out of order or torn before it stops being valid.
TORN = 0.05
#: How often classes are found: between two times, tokens are told apart by the gaps that they stand in.
ROUNDS = 2
#: Share of its text inside links from which a slot is a list of links.
LINKS = 0.5
#: Share of a host's text that the chosen container must hold.
MOST_TEXT = 0.8
#: Deepest nesting that is told apart; what lies deeper is taken as being at that depth.
DEPTH = 256

# What HTML defines of its elements: fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
_INLINE = frozenset("a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i img ins kbd label mark math object q rp rt ruby s samp select small span strike strong sub sup svg time tt u var video wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "thead": ("tr td th thead tbody tfoot", "table"), "tbody": ("tr td th thead tbody tfoot", "table"), "tfoot": ("tr td th thead tbody tfoot", "table")}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that aren't the article, wherever they are.
ASIDE_TAGS = frozenset("nav header footer aside form head button select datalist dialog menu svg canvas audio video object".split()) | _RAW
#: Roles that aren't, as ARIA names them.
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark what isn't.
ASIDE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs"
    " header masthead footer comment comments reply replies discussion disqus respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager widget toolbar skip".split()
)
#: A word after one of these tells of the rest of the page ("has-sidebar").
_HAS = frozenset("has with no without".split())

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """A run of text between block elements: the path of elements around it, its text, its code points within links."""

    path: tuple[str, ...]
    text: str
    linked: int
    heading: bool


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: In page order: paths of the elements as they open, with `/` before them as they close, and text runs with theirs.
    tokens: list[str] = field(default_factory=list)


def _role(tag: str, attributes: str) -> str:
    """A tag with what its class, id and role say, digits as 0: tokens of one role are the same element of a template."""
    if not attributes:
        return tag
    found = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            if name == "hidden" or (a or b or c).lower() == "true":
                found.append("!hidden")
            continue
        sign = {"class": ".", "id": "#", "role": "@", "itemprop": "@"}[name]
        found += [sign + "-".join("0" if w.isdigit() else w for w in _WORD.findall(_CAMEL.sub("-", unescape(v)).lower())) for v in (a or b or c).split()]
    return tag + "".join(sorted(set(found)))


def _shut(tag: str, stack: list[str], names: list[str]) -> int:
    """The depth to which an opening tag closes what is open, by HTML's rules of omitted end tags."""
    depth = len(names)
    if tag in _CLOSES_P or tag in _CLOSES:
        for i in range(len(names) - 1, -1, -1):
            if names[i] == "p":
                depth = i
                break
            if names[i] not in _INLINE:
                break
    if tag in _CLOSES:
        ends, stops = _CLOSES[tag]
        own, bounds = ends.split(), stops.split()
        for i in range(depth - 1, -1, -1):
            if names[i] in own:
                depth = i
            elif names[i] in bounds:
                break
    return depth


def parse(html: str) -> Page:
    """A page's blocks and tokens. Tags that aren't closed, or close what isn't open, are taken as browsers take them."""
    page, names, stack, roles = Page(), [], [""], []
    text: list[str] = []
    linked = 0
    opened: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                b = Block(opened, whole, linked, any(n in _HEADINGS for n in names))
                page.blocks.append(b)
                page.tokens.append(_text_token(b))
            text.clear()
        linked = 0

    def add(s: str) -> None:
        nonlocal opened, linked
        if not text:
            if not s or s.isspace():
                return
            opened = tuple(roles)
        # a button or an advert within a line of text: the line goes on after it
        if any(n in _INLINE and _split(r)[2] for n, r in zip(reversed(names), reversed(roles), strict=True)):
            if not text:
                text.append("")
            return
        text.append(s)
        if "a" in names:
            linked += len(s.strip())

    def close(depth: int) -> None:
        if any(n not in _INLINE for n in names[depth:]):
            flush()
        while len(names) > depth:
            page.tokens.append("/" + stack.pop())
            names.pop()
            roles.pop()

    at = 0
    while True:
        m = _PIECE.search(html, at)
        if not m:
            break
        add(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            # an end tag closes the nearest open element of its name; inline ones don't reach beyond their block
            for i in range(len(names) - 1, -1, -1):
                if names[i] == tag:
                    close(i)
                    break
                if tag in _INLINE and names[i] not in _INLINE:
                    break
            else:
                if tag == "p":
                    flush()
            continue
        if tag in ("br", "wbr"):
            if tag == "br":
                add(" ")
            continue
        close(_shut(tag, stack, names))
        if tag not in _INLINE and tag not in _RAW:
            flush()
        if tag in _VOID:
            continue
        role = _role(tag, m[3])
        raw = tag in _RAW and not m[3].rstrip().endswith("/")
        if raw:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            page.tokens += [f"{stack[-1]}>{role}", f"/{stack[-1]}>{role}"]
            continue
        if len(names) < DEPTH:
            names.append(tag)
            roles.append(role)
            stack.append(role if tag in _INLINE else f"{stack[-1]}>{role}" if len(names) < 24 else role)
            page.tokens.append(stack[-1])
    add(html[at:])
    flush()
    return page


def _aside(tag: str, marks: list[str]) -> bool:
    """Whether an element's tag, role, class or id says that it isn't the article."""
    if tag in ASIDE_TAGS or "!hidden" in marks:
        return True
    for mark in marks if tag not in ("html", "body", "main") else ():
        words = mark[1:].split("-")
        if mark[0] == "@":
            if mark[1:] in ASIDE_ROLES:
                return True
        elif tag == "article":
            # an article's classes say what it allows ("comments-open"); one that is named so and nothing else is a comment
            if all(w in ASIDE_WORDS or w == "0" for w in words):
                return True
        elif "".join(words) in ASIDE_WORDS or any(w in ASIDE_WORDS and not (i and words[i - 1] in _HAS) for i, w in enumerate(words)):
            return True
    return False


@lru_cache(1 << 14)
def _split(role: str) -> tuple[str, list[str], bool]:
    tag, *marks = re.split(r"(?=[.#@!])", role)
    return tag, marks, _aside(tag, marks)


def excluded(path: tuple[str, ...], heading: bool = False) -> bool:
    """Whether an element of the path is a menu, header, footer, sidebar, notice, advert, form, script or comments.

    The header of an article keeps its headings.
    """
    inside = False
    for role in path:
        tag, marks, aside = _split(role)
        if aside and not (heading and inside and (tag == "header" or any(m.endswith("header") for m in marks))):
            return True
        inside = inside or tag in ("article", "main")
    return False


def semantic(path: tuple[str, ...]) -> int:
    """The depth of the element that says it is the article (0: none): article, else what is named so, else main."""
    for test in (lambda t, m: t == "article" or "@articlebody" in m or "@article" in m, lambda t, m: t == "main" or "@main" in m):
        for i, role in enumerate(path):
            tag, marks, _ = _split(role)
            if test(tag, marks):
                return i + 1
    return 0


def _hash(strings: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64).view(np.int64)


def _text_token(b: Block) -> str:
    return ">".join(b.path) + "\x00" + b.text


def _slot(path: tuple[str, ...]) -> str:
    """The path of a block's block elements: the slot of the template that it fills."""
    return ">".join(r for r in path if _split(r)[0] not in _INLINE)


def choose(slots: list[tuple[str, int, int]]) -> str:
    """The container, as a path, whose slots hold the article. slots: path, code points, those within links.

    Of slots that no rule excludes: the element that says it is the article where one does; else the deepest element
    that holds MOST_TEXT of their text outside lists of links.
    """
    open_ = [(tuple(s.split(">")), n, linked) for s, n, linked in slots if s and not excluded(tuple(s.split(">")))]
    named: Counter[str] = Counter()
    for path, n, _ in open_:
        if depth := semantic(path):
            named[">".join(path[:depth])] += n
    if named:
        return max(named, key=lambda s: (named[s], -len(s)))
    own: Counter[str] = Counter()
    for path, n, linked in open_:
        if linked < LINKS * n:
            for depth in range(1, len(path) + 1):
                own[">".join(path[:depth])] += n
    if not own:
        return ""
    total = max(own.values())
    # a lone paragraph is no container: its element must hold others, unless nothing else has text
    blocks = {">".join(path) for path, _, _ in open_}
    good = [s for s, n in own.items() if n >= MOST_TEXT * total and any(b != s and b.startswith(s + ">") for b in blocks)] or [s for s, n in own.items() if n >= MOST_TEXT * total]
    return max(good, key=lambda s: (s.count(">"), s))


def text_of(page: Page, container: str, constant: frozenset[int]) -> str:
    """The blocks in the container's slots, joined. Pages without that container choose one by themselves."""
    kept = [b for b in page.blocks if not excluded(b.path, b.heading)]
    held = lambda b, at: (_slot(b.path) + ">").startswith(at + ">") or _slot(b.path).rpartition(">")[2].partition(".")[0] == "h1"  # noqa: E731  (the title may stand above)
    inside = [b for b in kept if held(b, container)] if container and any((_slot(b.path) + ">").startswith(container + ">") for b in kept) else []
    if not inside:
        slots: dict[str, list[int]] = {}
        for b in kept:
            s = slots.setdefault(_slot(b.path), [0, 0])
            s[0] += len(b.text)
            s[1] += b.linked
        own = choose([(s, n, linked) for s, (n, linked) in slots.items()])
        inside = [b for b in kept if not own or held(b, own)]
    if constant:
        hashes = _hash([_text_token(b) for b in inside]) if inside else []
        inside = [b for b, h in zip(inside, hashes, strict=True) if int(h) not in constant]
    return "\n".join(b.text for b in inside)


def host(url: Column) -> Column:
    """The host that a url names, in lower case; empty if none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_SKELETON = "host string, page long, tokens array<long>, marks array<struct<token: long, n: int, size: long, at: int>>, slots array<string>, blocks array<struct<at: int, slot: int, chars: int, linked: int>>"
_MARKS = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("size", pa.int64()), ("at", pa.int32())]))


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, page, tokens, marks, slots, blocks): a page's tags and text runs as hashes in page order, and its runs of text.

    marks has each different token with its count on the page, its code points (0 for tags) and its first place; runs that
    a rule leaves out are in tokens only. blocks has the place of each run among the tokens, which of slots (paths of
    elements) it fills, and its size. page is a hash of the tokens.
    """
    blocks_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("at", "slot", "chars", "linked")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole, 256, "html"):
                all_tokens, all_marks, all_slots, all_blocks, ids = [], [], [], [], []
                for html in b.column("html").to_pylist():
                    page = parse(html or "")
                    slots: dict[str, int] = {}
                    sizes: dict[str, int] = {}
                    blocks = []
                    places = (i for i, t in enumerate(page.tokens) if "\x00" in t)
                    for x, at in zip(page.blocks, places, strict=True):
                        blocks.append({"at": at, "slot": slots.setdefault(_slot(x.path), len(slots)), "chars": len(x.text), "linked": x.linked})
                        sizes[page.tokens[at]] = 0 if excluded(x.path, x.heading) else len(x.text)
                    counts = Counter(page.tokens)
                    first = {t: i for i, t in zip(range(len(page.tokens) - 1, -1, -1), reversed(page.tokens))}
                    of = dict(zip(counts, _hash(list(counts)).tolist(), strict=True))
                    tokens = np.array([of[t] for t in page.tokens], np.int64)
                    all_tokens.append(tokens)
                    ids.append(xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63))
                    all_marks.append([{"token": of[t], "n": n, "size": sizes.get(t, 0), "at": first[t]} for t, n in counts.items() if sizes.get(t, 1)])
                    all_slots.append(list(slots))
                    all_blocks.append(blocks)
                columns = [b.column("host"), pa.array(ids, pa.int64()), pa.array(all_tokens, pa.list_(pa.int64())), pa.array(all_marks, _MARKS), pa.array(all_slots, pa.list_(pa.string())), pa.array(all_blocks, blocks_type)]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "tokens", "marks", "slots", "blocks"])

    return pages.select("host", "html").mapInArrow(run, _SKELETON)


def _classes(skeleton: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, of, template): the frequent tokens of each host with the class of their occurrence vector, by token.

    A token's vector has its count on every page of the host. It is summed up as two sums of halves of a hash of page and
    count, so that tokens with the same vector, and by chance no others, get the same class; sums combine before the
    shuffle. Tokens on less than SUPPORT of the pages (text: CONSTANT) are data. place is a token's place in its class by
    where it stands on all pages: they are the same pages for all of a class. A host has 1 / SUPPORT x a page's tokens at most.
    """
    each = skeleton.select("host", "page", F.explode("marks").alias("c")).select("host", "page", "c.*")
    h = F.xxhash64("page", "n")
    vectors = each.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high"), F.max("size").alias("size"), F.sum("at").alias("at"))
    text = F.col("size") > 0
    share = F.when(text, CONSTANT).otherwise(SUPPORT)
    often = vectors.join(hosts, "host").filter((F.col("of") > 1) & (F.col("pages") >= share * F.col("of"))).select("host", "of", "token", "at", text.alias("text"), F.xxhash64("pages", "low", "high").alias("class"))
    w = Window.partitionBy("host", "class")
    placed = often.repartition("host").withColumns({"place": F.row_number().over(w.orderBy("at", "token")) - 1, "members": F.count(F.lit(1)).over(w).cast("int"), "valid": F.lit(True)})
    return placed.groupBy("host", "of").agg(F.sort_array(F.collect_list(F.struct(*_ENTRY))).alias("template"))


#: A gap of a template: the class whose tokens are around it and the place of the one before it. Outside all classes:
_OUTSIDE = (0, 0)


def walk(classes: list[int | None], places: list[int], members: list[int]) -> tuple[set[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """Goes over a page's frequent tokens: the classes that aren't valid on it, the gap that each token stands in, and the
    gap that begins after it.

    A class is valid if its tokens come in one order, each as often, and if it nests: what begins in one of its gaps ends
    there. Tokens whose class is None are of none.
    """
    bad, around, after = set(), [], []
    stack: list[tuple[int, int]] = []
    for c, k, n in zip(classes, places, members, strict=True):
        i = len(stack) - 1
        while c is not None and i >= 0 and stack[i][0] != c:
            i -= 1
        if c is None:
            around.append(stack[-1] if stack else _OUTSIDE)
        elif k == 0:
            if i >= 0:
                bad.add(c)
                del stack[i]
            around.append(stack[-1] if stack else _OUTSIDE)
            if n > 1:
                stack.append((c, 0))
        elif i < 0:
            bad.add(c)
            around.append(stack[-1] if stack else _OUTSIDE)
        else:
            bad.update(s[0] for s in stack[i + 1 :])
            if stack[i][1] != k - 1:
                bad.add(c)
            del stack[i:]
            around.append(stack[-1] if stack else _OUTSIDE)
            if k < n - 1:
                stack.append((c, k))
        after.append(stack[-1] if stack else _OUTSIDE)
    return bad | {s[0] for s in stack}, around, after


def torn_classes(tokens: list[int], classes: dict[int, int]) -> set[int]:
    """The classes whose tokens, on one page, don't come round in one order, or that don't nest."""
    order: dict[int, list[int]] = {}
    for t in dict.fromkeys(t for t in tokens if t in classes):
        order.setdefault(classes[t], []).append(t)
    seen = [t for t in tokens if t in classes]
    return walk([classes[t] for t in seen], [order[classes[t]].index(t) for t in seen], [len(order[classes[t]]) for t in seen])[0]


_ENTRY = ("token", "class", "place", "members", "text", "valid")


def _matched(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[int], dict[str, list]]]:
    """(row, tokens, places, entries, template) of each page whose host has a template: where its tokens are of the template, and which."""
    known: dict[str, tuple[np.ndarray, dict[str, list]]] = {}
    for i, name in enumerate(b.column("host").to_pylist()):
        if name not in known:
            t = b.column("template")[i].values
            fields = {n: t.field(n) for n in _ENTRY}
            lists = {n: x.to_pylist() for n, x in fields.items() if n != "token"}
            lists["class"] = [c if v else None for c, v in zip(lists["class"], lists["valid"], strict=True)]
            known[name] = fields["token"].to_numpy(), lists
        have, template = known[name]
        tokens = b.column("tokens")[i].values.to_numpy()
        found = np.minimum(np.searchsorted(have, tokens), len(have) - 1)
        at = np.flatnonzero(have[found] == tokens)
        yield i, tokens, at, found[at].tolist(), template


def _walk(entries: list[int], template: dict[str, list]) -> tuple[set[int], list[tuple[int, int]], list[tuple[int, int]]]:
    return walk([template["class"][x] for x in entries], [template["place"][x] for x in entries], [template["members"][x] for x in entries])


def _with_template(skeleton: DataFrame, found: DataFrame) -> DataFrame:
    return skeleton.join(common.small_side(found.select("host", "template"), found.count(), 1 << 13), "host")


def _torn(skeleton: DataFrame, found: DataFrame) -> DataFrame:
    """(host, torn): the classes that are out of order, or don't nest, on more than TORN of a host's pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, bad, names = [], [], b.column("host").to_pylist()
            for i, _, _, entries, template in _matched(b):
                torn = _walk(entries, template)[0]
                hosts += [names[i]] * len(torn)
                bad += torn
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(bad, pa.int64())], names=["host", "class"])

    pages = _with_template(skeleton.select("host", "tokens"), found).mapInArrow(run, "host string, class long")
    counts = pages.groupBy("host", "class").agg(F.count(F.lit(1)).alias("n")).join(found.select("host", "of"), "host")
    return counts.filter(F.col("n") > TORN * F.col("of")).groupBy("host").agg(F.collect_list("class").alias("torn"))


def _gap(gaps: list[tuple[int, int]]) -> np.ndarray:
    g = np.array(gaps, np.int64).reshape(-1, 2).astype(np.uint64)
    return (g[:, 0] ^ (g[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)


def _told_apart(skeleton: DataFrame, found: DataFrame) -> DataFrame:
    """The skeletons with frequent tags named by the gap of the valid classes that they stand in: tags that are alike but stand in
    two gaps have two roles. What isn't frequent can't become so; runs of text keep their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, renamed, marks = [], [], []
            for i, tokens, at, entries, template in _matched(b):
                own = tokens[at]
                text = np.array([template["text"][x] for x in entries], bool)
                new = np.where(text, own, (own.view(np.uint64) ^ _gap(_walk(entries, template)[1])).view(np.int64))
                tokens = tokens.copy()
                tokens[at] = new
                names, first, n = np.unique(new, return_index=True, return_counts=True)
                rows.append(i)
                renamed.append(tokens)
                marks.append([{"token": t, "n": k, "size": int(text[f]), "at": int(at[f])} for t, f, k in zip(names.tolist(), first.tolist(), n.tolist(), strict=True)])
            kept = b.take(pa.array(rows, pa.int64()))
            columns = [kept.column("host"), kept.column("page"), pa.array(renamed, pa.list_(pa.int64())), pa.array(marks, _MARKS), kept.column("slots"), kept.column("blocks")]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "tokens", "marks", "slots", "blocks"])

    return _with_template(skeleton, found).mapInArrow(run, _SKELETON)


def _filled(skeleton: DataFrame, found: DataFrame) -> DataFrame:
    """(host, page, gap, slot, chars, linked): the text that a page has in each gap of the template, by path. Runs that
    belong to the template are in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            names, pages, slots, blocks = (b.column(c).to_pylist() for c in ("host", "page", "slots", "blocks"))
            for i, _, at, entries, template in _matched(b):
                gaps = _gap([_OUTSIDE, *_walk(entries, template)[2]]).view(np.int64)
                text = {p for p, x in zip(at.tolist(), entries, strict=True) if template["text"][x]}
                sums: dict[tuple[int, int], list[int]] = {}
                for x, g in zip(blocks[i], gaps[np.searchsorted(at, [x["at"] for x in blocks[i]])].tolist(), strict=True):
                    if x["at"] not in text:
                        s = sums.setdefault((g, x["slot"]), [0, 0])
                        s[0] += x["chars"]
                        s[1] += x["linked"]
                out += [(names[i], pages[i], g, slots[i][s], *n) for (g, s), n in sums.items()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["host", "page", "gap", "slot", "chars", "linked"])

    return _with_template(skeleton, found).mapInArrow(run, "host string, page long, gap long, slot string, chars long, linked long")


def templates(pages: DataFrame) -> DataFrame:
    """(host, container, constant): where a host's template has the article, and the text runs that belong to the template.

    Tokens are tags in their place among other elements, and runs of text in theirs. Those with one occurrence vector are
    a class. A class is valid if on nearly all pages its tokens come in one order, as often each, and nest with other
    classes. Tags are then told apart by the gap of the valid classes that they stand in, and classes are found again; the
    valid ones are the template, the rest are data. Slots are the gaps that the template leaves open: a list of links is
    told by what a gap holds on all pages, and the container by what fills the gaps.
    """
    skeleton = common.stage(skeletons(pages), "page-skeletons")
    hosts = common.stage(skeleton.groupBy("host").agg(F.count(F.lit(1)).alias("of")), "page-hosts")
    told = skeleton
    for i in range(ROUNDS):
        found = common.stage(_classes(told, hosts), "page-classes")
        valid = F.transform("template", lambda x: x.withField("valid", ~F.array_contains(F.coalesce("torn", F.array().cast("array<long>")), x["class"])))
        found = common.stage(found.join(_torn(told, found), "host", "left").select("host", "of", valid.alias("template")), "page-template")
        if i < ROUNDS - 1:
            told = common.stage(_told_apart(told, found), "page-told-apart")
    runs = skeleton.select("host", F.explode("marks").alias("x")).select("host", "x.token", (F.col("x.size") * F.col("x.n")).alias("size")).filter("size > 0")
    fixed = found.filter(F.col("of") >= PAGES).select("host", F.explode("template").alias("x")).filter("x.valid and x.text").select("host", "x.token")
    sums = runs.groupBy("host", "token").agg(F.sum("size").alias("size"))
    share = sums.join(fixed.withColumn("fixed", F.lit(True)), ["host", "token"], "left").groupBy("host").agg(F.sum("size").alias("whole"), F.sum(F.when(F.col("fixed"), F.col("size")).otherwise(0)).alias("part"))
    frame = common.stage(share.filter(F.col("part") <= MOST_CONSTANT * F.col("whole")).select("host"), "page-frames")
    constant = fixed.join(frame, "host").groupBy("host").agg(F.collect_list("token").alias("constant"))  # at most a page's runs
    # runs are of the template where they are constant; elsewhere they fill its slots
    framed = F.coalesce("framed", F.lit(False)) & (F.col("of") >= PAGES)
    marked = found.join(frame.withColumn("framed", F.lit(True)), "host", "left").select("host", F.transform("template", lambda x: x.withField("text", x["text"] & x["valid"] & framed)).alias("template"))
    filled = _filled(told, common.stage(marked, "page-marked")).groupBy("host", "gap", "slot").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    w = Window.partitionBy("host", "gap")
    listed = F.sum("linked").over(w) >= LINKS * F.sum("chars").over(w)
    slots = filled.repartition("host").withColumn("linked", F.when(listed, F.col("chars")).otherwise(0))
    # slots of a tenth of the pages: at most ten times a page's slots, however many pages
    common_slots = slots.join(hosts, "host").filter(F.col("pages") >= 0.1 * F.col("of")).groupBy("host").agg(F.collect_list(F.struct("slot", "gap", "chars", "linked")).alias("slots"))
    pick = F.udf(lambda rows: choose([(r["slot"], r["chars"], r["linked"]) for r in sorted(rows, key=lambda r: (r["slot"], r["gap"]))]), T.StringType(), useArrow=True)
    return common_slots.select("host", pick("slots").alias("container")).join(constant, "host", "full")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page. pages: page_id, url, html.

    Null and empty html give an empty text, as do pages that are nothing but frame. Pages without a host, or alone on
    theirs, are read by the same rules without a template. Repeated pages are pages of their own; a host whose pages
    repeat each other's text loses none of it (MOST_CONSTANT). Very long pages are parsed once, by one task, in memory of
    some times their size. Other columns are ignored, whatever their names. No pages give no rows.
    """
    known = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    found = common.stage(templates(known.filter("host <> ''")), "page-templates")
    # a template is a path and a page's constant runs
    joined = known.join(common.small_side(found, found.count(), 1 << 11), "host", "left")
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in common.pieces(whole, 256, "html"):
                texts = [text_of(parse(html or ""), container or "", frozenset(constant or ())) for html, container, constant in zip(b.column("html").to_pylist(), b.column("container").to_pylist(), b.column("constant").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "container", "constant").mapInArrow(run, schema)
