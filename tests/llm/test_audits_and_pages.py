"""Operators 11 to 13 against plain versions of what they must do."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import divergence, filter_audit, html_text, queries

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EXTRA = ["part", "mask", "n", "kept", "term", "docs", "place", "value", "item", "host", "page", "tokens", "container", "constant", "digest", "good", "shard"]


def odd_documents(spark):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "", "en", "a"), (4, "Same text HERE #", "en", "a"), (5, "Same text HERE #", "de", "b"), (5, "Same text HERE #", "de", "b"), (5, "Other same text", "de", ""), (None, "Same text HERE #", None, "b"), (None, None, "", ""), (7, LONG, "en", "a"), (8, LONG, "en", "b"), (9, "Ünïcödé ÄÖ ünïcödé \x1c z\x0bz\x0cz", "fr", "c"), (10, "a " * 300, "en", "\u00e9"), (11, "ABC " * 80 + "x " * 130, "en", "z"), (12, "tea Tea TEA tEa", "de", "b")]
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], f"doc_id long, text string, lang string, source string, {', '.join(f'{e} string' for e in EXTRA)}").repartition(3)


# 11 ------------------------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """Five filters run over the documents one after the other, in every order."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if d is not None and d > first[t] else set()
        rows.append((lang or "", fails, d in good and d is not None, d in toxic and d is not None))
    out = {}
    for part in {r[0] for r in rows}:
        removed_by = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += here
                removed_by[f] += len(here)
                out[part, order, step] = [len(left), len(here), redundant, sum(r[0] == part and r[1] == {f} for r in rows), sum(r[2] for r in here), sum(r[3] for r in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


@pytest.mark.parametrize("kind", ["odd", "random"])
def test_filter_audit(spark, kind):
    if kind == "odd":
        docs = odd_documents(spark)
        labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 1, 1), (7, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    else:
        rnd = random.Random(4)
        texts = [" ".join(rnd.choice(["aa", "BB", "c#", "d", f"x{i}"]) for i in range(rnd.randrange(150, 260))) for _ in range(20)]
        docs = spark.createDataFrame([(i, rnd.choice(texts), rnd.choice(["en", "de"])) for i in range(120)], "doc_id long, text string, lang string").repartition(5)
        labels = spark.createDataFrame([(i, rnd.randrange(2), rnd.randrange(2)) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audit(docs, labels).collect()}
    assert got == plain_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.collect()])


def test_filter_audit_of_nothing(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.filter("false"), labels).collect() == []
    assert filter_audit.audit(docs, labels).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


# 12 ------------------------------------------------------------------------------------------------------------------


def plain_divergence(docs, least=3, top=200):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for t, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        counts[lang, source].update(w)
        in_docs[lang].update(set(w))
    out = {}
    for lang in {g for g, _ in groups}:
        kept = [w for w, n in in_docs[lang].items() if n >= least]
        own = {s: Counter({w: counts[lang, s][w] for w in kept}) for g, s in groups if g == lang}
        whole = sum(own.values(), Counter())
        p = lambda c: {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}  # noqa: B023, E731
        shares, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            f = lambda a, b: (a - b) ** 2 // b
            pairs = [(sum(f(shares[s][w], shares[o][w]) for w in kept), o) for o in own if o != s]
            terms = [(f(shares[s][w], q[w]), w) for w in kept if own[s][w] > 0 and shares[s][w] > q[w]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out |= {(lang, s, part, i): (item, v) for i, (v, item) in enumerate(rows[: top if part == "term" else None], 1)}
    return out


def divergence_rows(df):
    return {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"]) for r in df.collect()}


def test_divergence_of_odd_documents(spark, monkeypatch):
    docs = odd_documents(spark)
    plain = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert divergence_rows(divergence.audit(docs)) == plain_divergence(plain)
    assert divergence.audit(docs.filter("false")).collect() == []


@pytest.mark.parametrize(("top", "tile"), [(200, 512), (5, 2)])
def test_divergence(spark, monkeypatch, top, tile):
    """Many ties at the cut, terms that begin alike, sources dealt to several tiles."""
    monkeypatch.setattr(divergence, "TOP", top)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "HELD", 50)
    rnd = random.Random(7)
    vocab = ["a" * k for k in range(1, 12)] + ["pre" * 9 + x for x in "abcdé漢z"] + ["ß", "éa", "éA", "z"] + [f"{x}{y}" for x in "klm" for y in "stuv"]
    docs = [(" ".join(rnd.choice(vocab) if rnd.random() < 0.9 else rnd.choice(vocab[:4]) for _ in range(rnd.randrange(0, 40))), rnd.choice(["en", "de"]), f"s{rnd.randrange(7)}") for _ in range(90)]
    docs += [("only here", "xx", "one"), ("", "yy", "two"), (None, "yy", "three")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)
    assert divergence_rows(divergence.audit(df)) == plain_divergence(docs, top=top)


def test_terms_of_a_long_text_are_those_of_the_whole():
    t = ("Été déjà-vu x1y Zz漢字 " * 200_000).encode()
    assert divergence.document_terms(t) == Counter({k.encode(): 200_000 for k in ("Été", "déjà", "vu", "x", "y", "zz漢字")})
    assert divergence.document_terms(b"") == Counter() and divergence.document_terms(b"a" * (3 << 20)) == Counter([b"a" * (3 << 20)])


# 13 ------------------------------------------------------------------------------------------------------------------

FRAME = """<!DOCTYPE html><html><head><title>{t}</title><style>p>a{{}}</style><script>var x = "<p>no</p>";</script></head><body class="post has-sidebar">
<header class="site"><h1>The Daily</h1><nav><ul><li><a href="/a">{m}</a></li></ul></nav></header>
<div class="cookie-notice">We use cookies</div><div id="page"><main>{open}<h1>{t}</h1>{body}{close}
<section class="comments"><article class="comment"><p>First! {m}</p></article></section></main>
<aside><p>Related: {m}</p></aside></div><form><label>Mail</label><button>Go {m}</button></form><footer>&copy; {m}</footer></body></html>"""


def page(title, body, more, tag="article"):
    return FRAME.format(t=title, body=body, m=more, open=f"<{tag}>", close=f"</{tag}>")


def extracted(spark, pages):
    df = spark.createDataFrame([(i, *p, *["x"] * len(EXTRA)) for i, p in enumerate(pages)], f"page_id long, url string, html string, {', '.join(f'{e} string' for e in EXTRA)}").repartition(3)
    got = html_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r["page_id"]: r for r in got.collect()}
    assert all(r["n_chars"] == len(r["text"]) and r["url"] == pages[i][0] for i, r in rows.items())
    return [rows[i]["text"] for i in range(len(pages))]


@pytest.mark.parametrize("tag", ["article", "section", "div"])
def test_page_without_its_frame(spark, tag):
    """The frame goes, whatever element holds the article; only text within it stays, in order, references decoded."""
    pages = [(f"https://h.example/{i}", page(f"Title {i}", f"<p>One&nbsp;{i} &lt;b&gt; <b>bo</b>ld\n\n text<br>on<p>Two <a href=x>link {i}</a>.<ul><li>item {i}<li>next {i}</ul><table><tr><td>c{i}<td>d{i}</table><blockquote>Said &#233;{i}</blockquote><p>{'more words ' * 40}{i}", f"m{i}", tag)) for i in range(8)]
    got = extracted(spark, pages)
    for i, t in enumerate(got):
        assert t.split("\n") == [f"Title {i}", f"One {i} <b> bold text on", f"Two link {i}.", f"item {i}", f"next {i}", f"c{i}", f"d{i}", f"Said é{i}", ("more words " * 40 + str(i)).strip()]


def test_constant_text_is_template_but_copies_are_not(spark):
    """A line that all pages of a host have in the article's place belongs to the frame; pages that are copies lose nothing."""
    body = "<p>Always this line.</p><p>{}</p>"
    words = lambda i: " ".join(f"w{i * 50 + k}" for k in range(50))
    a = [(f"http://a.example/{i}", page(f"T{i}", body.format(words(i)), "x")) for i in range(8)]
    b = [(f"http://b.example/{i}", page("T", body.format(words(99)), "x")) for i in range(8)]
    c = [(f"http://c.example/{i}", page(f"T{i}", body.format(words(i)), "x")) for i in range(3)]
    got = extracted(spark, a + b + c)
    assert got[:8] == [f"T{i}\n{words(i)}" for i in range(8)]
    assert got[8:16] == [f"T\nAlways this line.\n{words(99)}"] * 8
    assert got[16:] == [f"T{i}\nAlways this line.\n{words(i)}" for i in range(3)]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>word{i} &amp; more</p>" for i in range(20_000)) + "</article>"
    pages = [(None, None), ("", ""), ("no url", "plain text, no markup"), ("http://x.example/", "<p>unclosed <b>bold<p>next &am &bogus; &copy"), ("http://x.example/2", "a < b <3 <!-- gone <p> --> c <!-- open"), ("http://y.example/", "<nav>only frame</nav>"), ("http://z.example/", deep), ("http://z.example/", deep), ("http://l.example/", long), ("http://q.example/", "<article><p title='a>b' class=\"x\">quoted</p><script>if (a<b) {}</script><p hidden>no</p><p>in <button>Share</button> line</p></article><p title=\"open"), ("http://r.example/", "</p></div><p>stray</p></article>")]
    got = extracted(spark, pages)
    assert got[:8] == ["", "", "plain text, no markup", "unclosed bold\nnext &am &bogus; ©", "a < b <3 c", "", "deep", "deep"]
    assert got[8].split("\n") == [f"word{i} & more" for i in range(20_000)]
    assert got[9:] == ["quoted\nin line", "stray"]
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(df).collect() == []


def test_classes_out_of_order():
    assert html_text.torn_classes([1, 2, 1, 2, 9, 3], {1: 0, 2: 0, 3: 1}) == set()
    assert html_text.torn_classes([1, 2, 2, 1], {1: 0, 2: 0}) == {0}
    assert html_text.torn_classes([1, 1, 2], {1: 0, 2: 0}) == {0}


def test_slots_are_what_the_template_leaves_open(spark):
    """A constant run is template, so the container is told by what fills the slots: the counter outside it isn't the article."""
    said = "Words that all pages of this host say. " * 8
    html = "<body><div class=about><p>{c}</p></div><div class=text><h2>Head {i}</h2><p>{a}</p><p>{b}</p></div><div class=seen><p>read {i} times</p></div></body>"
    more = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    got = extracted(spark, [(f"http://s.example/{i}", html.format(c=said, i=i, a=more(i, 90), b=more(i + 50, 60))) for i in range(8)])
    assert got == [f"Head {i}\n{more(i, 90)}\n{more(i + 50, 60)}" for i in range(8)]


def test_walk_of_a_template():
    """Class 1 is around class 2, which comes twice in one of its gaps; tokens of no class stand where they are."""
    bad, around, after = html_text.walk([1, 2, 2, 2, 2, None, 1, 1], [0, 0, 1, 0, 1, 0, 1, 2], [3, 2, 2, 2, 2, 1, 3, 3])
    assert bad == set() and around == [(0, 0), (1, 0), (1, 0), (1, 0), (1, 0), (1, 0), (0, 0), (0, 0)]
    assert after == [(1, 0), (2, 0), (1, 0), (2, 0), (1, 0), (1, 0), (1, 1), (0, 0)]
    assert html_text.walk([1, 2, 1, 2], [0, 0, 1, 1], [2, 2, 2, 2])[0] == {2}  # ends beyond the gap that it began in
    assert html_text.walk([1, 1], [1, 0], [2, 2])[0] == {1} and html_text.walk([1, 2], [0, 0], [2, 1])[0] == {1}


def test_pages_query(spark, sf_dir):
    """Held against the article elements of the given pages, read plainly."""
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        from html import unescape

        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in queries.op13_html_text(spark, sf_dir).collect()} == want


def test_a_worker_keeps_one_operators_tables():
    from palimpsest.llm import common

    made = []
    make = lambda k: lambda: made.append(k) or [k]
    a = common.held(("a",), make("a"))
    assert common.held(("a",), make("a")) is a and made == ["a"]
    common.held(("b",), make("b"))
    assert common.held(("a",), make("a")) is not a and made == ["a", "b", "a"]
    common.let_go()
    common.held(("a",), make("a"))
    assert made == ["a", "b", "a", "a"]
