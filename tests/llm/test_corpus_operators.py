"""The ten operators: odd inputs, and results against brute force, libraries and held-out rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import bktree, byte_bpe, common, decontaminate, elias_fano, exact_dedup, language, lm_scoring, near_copies, ppm, queries, secrets, simhash, token_counts, token_files, tokenizing, toxicity

WORD, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Nulls, empty and long texts, ties, repeated rows, repeated ids, odd characters.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "Same text here"), (5, "Same  text\nhere"), (5, "Same  text\nhere"), (None, "Same text here"), (None, None), (7, LONG), (8, LONG), (9, "Ünïcödé ﬁ ΑΣ <|endoftext|> 漢字 \x1c z"), (10, "a"), (11, "🙂" * 3)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with further columns whose names the operators use themselves."""
    extra = ["n_tokens", "kept", "fp", "score", "ids", "word", "block", "shard", "label", "lang_pred"]
    return spark.createDataFrame([(d, t, "en", *["x"] * len(extra)) for d, t in ODD], f"doc_id long, text string, lang string, {', '.join(f'{e} string' for e in extra)}").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return common.documents(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


# 1 -------------------------------------------------------------------------------------------------------------------


def test_exact_dedup_odd(odd, empty):
    got = exact_dedup.refine(odd).collect()
    assert len(got) == len(ODD)
    by = collections.defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    for text, k in (("", 4), ("Sametexthere", 4), (re.sub(r"\s", "", LONG), 2)):
        rows = by[hashlib.sha256(text.encode()).hexdigest()]
        assert len(rows) == k == rows[0]["group_size"] and sum(r["kept"] for r in rows) == 1
    assert {r["keep_id"] for r in by[hashlib.sha256(b"Sametexthere").hexdigest()]} == {5}  # one more code point
    assert {r["keep_id"] for r in by[hashlib.sha256(b"").hexdigest()]} == {3}  # most code points
    assert exact_dedup.refine(empty).collect() == []


def test_exact_dedup_keeps_one_row_of_each(odd, empty):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == [3, 5, 7, 9, 10, 11] and len(kept.collect()) == len(ids)
    assert exact_dedup.keep_one(empty).collect() == []


def test_exact_dedup_beyond_the_broadcast_bound(docs, monkeypatch):
    small = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.refine(docs).collect()}
    monkeypatch.setattr(common, "fits_broadcast", lambda *a, **k: False)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.refine(docs, every_digest=False).collect()} == small


def test_exact_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a b", "x"), (1, "ab", "x"), (1, "other", "x"), (None, "n n", "x"), (None, "nn", "x"), (None, "n n", "y"), (None, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3)
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in exact_dedup.keep_one(docs).collect())
    assert kept == [("1", "a b"), ("1", "other"), ("None", ""), ("None", "n n")]


@pytest.mark.parametrize("words", [1, 64])
def test_exact_dedup_with_a_full_sieve(docs, monkeypatch, words):
    """However many keys share the bitmap, results stay the same: only more rows are hashed whole."""
    want = {tuple(r) for r in exact_dedup.refine(docs, every_digest=False).collect()}
    ids = {r["doc_id"] for r in exact_dedup.keep_one(docs).collect()}
    monkeypatch.setattr(common, "SIEVE_WORDS", words)
    monkeypatch.setattr(common, "fits_broadcast", lambda *a, **k: False)
    assert {tuple(r) for r in exact_dedup.refine(docs, every_digest=False).collect()} == want
    assert {r["doc_id"] for r in exact_dedup.keep_one(docs).collect()} == ids
    assert {r["doc_id"] for r in common.drop_ids(docs, docs.filter("doc_id % 3 = 0").select("doc_id")).collect()} == {r["doc_id"] for r in docs.filter("doc_id % 3 <> 0").collect()}


def test_exact_dedup_oracle(spark, sf_dir):
    got = sorted(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in queries.op1_exact_dedup(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op1_exact_dedup"]).fetchall())


# 2, 7 ----------------------------------------------------------------------------------------------------------------


def test_encoder_is_the_library(texts):
    e = tokenizing.Encoder(WORD)
    odd = [t or "" for _, t in ODD] + ["don't it's ...x!", "½²Ⅷ12", "é é", "İstanbul ΟΔΟΣ.", " lead", "trail ", "a\n\nb"]
    for t in [*texts.values(), *odd]:
        assert e.ids([t])[0].tolist() == e.library.encode(t, add_special_tokens=False).ids
    line, sizes = e.ids(odd)
    assert sizes.tolist() == [len(e.library.encode(t, add_special_tokens=False).ids) for t in odd] and len(line) == sizes.sum()


def test_full_memos_change_nothing(texts, monkeypatch):
    monkeypatch.setattr(tokenizing, "MEMO", 50)
    monkeypatch.setattr(tokenizing, "WORDS", 50)
    e = tokenizing.Encoder(WORD)
    for t in list(texts.values())[:60]:
        assert e.ids([t])[0].tolist() == e.library.encode(t, add_special_tokens=False).ids
    assert len(e.parts) < 2000


def test_new_words_share_calls_and_space():
    """Different words reach the library many in a text and take few bytes; letters, marks and their mixtures give its ids."""
    e = tokenizing.Encoder(WORD)
    library, sent = e.library, []

    class Counted:
        def encode_batch_fast(self, texts, **how):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **how)

    e.library = Counted()
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_000)]
    tracemalloc.start()
    line, sizes = e.ids([" ".join(words), " ".join(w.capitalize() + "***" for w in words)])
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(sent) < len(words) // 50 and kept < 100 * len(words)
    assert line.tolist() == [i for t in ("", "***") for w in words for i in library.encode(w + t, add_special_tokens=False).ids] and sizes.sum() == len(line)
    odd = [f"{c} a{c}b {c}!! {c}'s x{c}*** {c}\u0301 {c}.\u0338" for c in map(chr, range(0xC0, 0x250))]
    odd += [f"word{c} word{c}{c} a{c}b {c} {c}a \u00c9{c}'s x'{c}t" for c in map(chr, range(33, 127))] + ["a</w> </w>b", "x<|endoftext|>", "q\u2028r\x85s"]
    line, sizes = e.ids(odd)
    want = [library.encode(t, add_special_tokens=False).ids for t in odd]
    assert sizes.tolist() == list(map(len, want)) and line.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("text", [LONG[:60_000], "x" * 9_000 + " y" * 4_000, "ab cd\n" * 3_000 + "q" * 7_000 + " end"])
@pytest.mark.parametrize(("window", "overlap"), [(2_000, 16), (5_000, 300)])
def test_windows_meet_at_stable_boundaries(text, window, overlap):
    e = tokenizing.encoder(WORD)
    assert e.count_huge(text, window, overlap) == len(e.library.encode(text, add_special_tokens=False).ids)


def test_token_counts_odd(odd, empty):
    got = token_counts.count_tokens(odd, WORD).collect()
    library = tokenizing.encoder(WORD).library
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for _, t in ODD)
    assert token_counts.count_tokens(empty, WORD).collect() == []


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [0, 5, 5, 9, 1_000_000], list(range(0, 5000, 3)), [7] * 600])
def test_elias_fano(values):
    data = elias_fano.encode(np.array(values))
    s = elias_fano.Sequence(data)
    assert [s.select(i) for i in range(len(values))] == values and s.size() == len(data)
    for i in range(0, len(values), 37):
        for n in (0, 1, 5, 256, 300, len(values) - i):
            assert i + n > len(values) or s.select_run(i, n).tolist() == values[i : i + n]
    with pytest.raises(IndexError):
        s.select(len(values))


def test_elias_fano_opens_without_tables():
    """Whatever an open sequence holds is a view of the code itself."""
    data = encode = elias_fano.encode(np.arange(0, 3_000_000, 7))
    s = elias_fano.Sequence(data)
    assert all(isinstance(v, int) or v.base is not None for v in vars(s).values())
    assert s.select(200_000) == 1_400_000 and len(encode) == s.size()


def test_elias_fano_is_near_the_bound():
    v = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 10_000))
    assert len(elias_fano.encode(v)) * 8 / len(v) < 2.75 + np.log2((1 << 30) / len(v))


@pytest.mark.parametrize("shard_bytes", [16, 200, 1 << 24])
def test_token_files_round_trip(spark, odd, empty, tmp_path, monkeypatch, shard_bytes):
    monkeypatch.setattr(token_files, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(token_files, "MOST_SHARDS", 40)
    out = str(tmp_path / "t")
    token_files.write(odd, out, WORD, 2, segment=64)
    library = tokenizing.encoder(WORD).library
    rows = sorted(((d, t or "") for d, t in ODD), key=lambda x: (x[0] is not None, x[0] or 0))
    starts = token_files.read(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in starts] == [d for d, _ in rows]
    assert [r["start"] for r in starts] == np.cumsum([0, *[r["n_tokens"] for r in starts][:-1]]).tolist()
    expect = collections.Counter((d, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for d, t in ODD for ids in [library.encode(t or "", add_special_tokens=False).ids])
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in starts) == expect
    ties = spark.createDataFrame([(1, f"text number {i % 4}") for i in range(40)], "doc_id long, text string")
    orders = []
    for k in (1, 5):
        token_files.write(ties.repartition(k), f"{out}{k}", WORD, 2, segment=16)
        orders.append([r["ids_crc32"] for r in token_files.read(spark, f"{out}{k}").orderBy("start").collect()])
    assert orders[0] == orders[1] and len(orders[0]) == 40
    token_files.write(empty, out + "e", WORD, 2)
    assert token_files.read(spark, out + "e").collect() == []


def test_segment_gives_single_documents():
    blob = token_files.pack([None, 3, 3, 10], [np.array(x, "<u2") for x in ([5], [6, 7], [8], [])], np.dtype("<u2"))
    s = token_files.Segment(blob)
    assert [s.doc_id(i) for i in range(4)] == [None, 3, 3, 10]
    for size in (1, 2, 3, 9):
        runs = list(s.runs(size))
        assert [d for names, _ in runs for d in names] == [None, 3, 3, 10] and [int(b) for _, x in runs for b in x[:-1]] == [0, 1, 3, 4]
    assert [s.document(i).tolist() for i in range(4)] == [[5], [6, 7], [8], []]


# 3 -------------------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in common.documents(spark, sf).select("doc_id", "lang").collect()}
    got = queries.op3_language(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd(spark, odd, empty):
    train = spark.createDataFrame([(1, "the cat and the dog that there", "en"), (2, "der hund und die katze nicht", "de"), (3, None, "fr"), (4, "кот и собака это", "ru"), (5, "x", None)], "doc_id long, text string, lang string")
    m = language.fit(train)
    assert m.languages == ["de", "en", "ru"]
    got = {r["text"]: r["lang_pred"] for r in language.predict(odd, m).collect()}
    assert got[None] == got[""] == got["🙂" * 3] == "und"
    mixed = spark.createDataFrame([(1, "the cat and the dog that there " * 3 + "и это кот и собака")], "doc_id long, text string")
    r = language.predict(mixed, m, switch=2.0).first()
    assert r["lang_pred"] == "en" and [s["lang"] for s in r["spans"]] == ["en", "ru"]
    assert language.predict(empty, m).collect() == []
    assert language.predict(odd, language.fit(train.filter("false"))).filter("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    emit = rng.normal(0, 2, (7, 3))
    emit[:, 0] += seed  # from mixed to one language all through
    cost = lambda p: sum(emit[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
    best = max(map(cost, itertools.product(range(3), repeat=7)))
    for cuts in ([], [3], [1, 2, 5]):
        assert cost(language.path_labels(lambda cuts=cuts: iter(np.split(emit, cuts)), 3, 1.5)) == pytest.approx(best)


def test_language_scores_are_plain_ones(spark, sf_dir, texts, docs, monkeypatch):
    """The query against a plain reading: smoothed trigrams by counting, a script's languages only, the best path."""
    held = common.text_bucket("doc_id", 3) == 1
    train = [(r["lang"], r["text"]) for r in docs.filter(~held).filter("text is not null and lang is not null").collect()]
    names = sorted({lang for lang, _ in train})
    table, kind = language.tables()
    symbols = lambda word: [int(table[min(ord(c), 65535)]) for c in word]
    plain = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    counts = {x: [collections.Counter() for _ in range(3)] for x in names}
    uses = {x: collections.Counter() for x in names}
    for lang, t in train:
        for word in plain(t):
            uses[lang][int(kind[ord(word[0])])] += 1
            line = [0, 0, *symbols(word), 0]
            for i in range(2, len(line)):
                for n in range(3):
                    counts[lang][n][tuple(line[i - n : i + 1])] += 1
    before = {x: [collections.Counter(), collections.Counter(), collections.Counter()] for x in names}
    for x in names:
        for n in range(3):
            for g, k in counts[x][n].items():
                before[x][n][g[:-1]] += k

    def p(x, g):
        c1, c2, c3 = counts[x]
        one = (c1[g[2:]] + 0.5) / (before[x][0][()] + 0.5 * 64)
        two = (c2[g[1:]] + 8 * one) / (before[x][1][g[1:-1]] + 8)
        return (c3[g] + 8 * two) / (before[x][2][g[:-1]] + 8)

    model = language.fit(docs.filter(~held))
    assert model.languages == names
    sample = [t for t in list(texts.values())[:12] if t]
    for t in sample:
        w = language.code([t])
        assert len(w.begins) == len(plain(t))
        got = language.scored(model, w)
        for i, word in enumerate(plain(t)[:200]):
            line, script = [0, 0, *symbols(word), 0], int(kind[ord(word[0])])
            want = [sum(np.log(p(x, tuple(line[j - 2 : j + 1]))) for j in range(2, len(line))) if model.scripts[script][names.index(x)] else None for x in names]
            for a, b in zip(got[i], want, strict=True):
                assert b is None or a == pytest.approx(b, abs=2e-3)
    whole = language.label(model, sample)
    monkeypatch.setattr(language, "STRETCH", 300)
    for a, b in zip(whole, language.label(model, sample), strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_language_memory_of_a_long_text(spark):
    import tracemalloc

    m = language.fit(spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string"))
    text = "the cat and the dog " * 400_000  # 8 MB
    tracemalloc.start()
    path, letters = language.label(m, [text])[0]
    assert tracemalloc.get_traced_memory()[1] < 120 << 20 and len(path) == len(letters) == 2_000_000
    tracemalloc.stop()


# 4 -------------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op4_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    # a third of this table's toxic labels are on texts without any sign of it; hardly a clean text may be rejected
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in got) >= 0.95 * len(got)
    clean = [r for r in got if labels[r["doc_id"]] == 0]
    assert sum(r["predicted"] == 0 for r in clean) >= 0.99 * len(clean)
    marked = [r for r in got if labels[r["doc_id"]] == 1]
    assert sum(r["predicted"] for r in marked) >= 0.65 * len(marked)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_odd(spark, odd, empty):
    train = spark.createDataFrame([(i, ("vile idiot scum " if i % 2 else "kind gentle words ") * 3 + f"doc{i}") for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2) for i in range(80)], (500, None), (None, 1)], "doc_id long, toxic int")
    m = toxicity.fit(train, labels)
    out = toxicity.score(odd, m)
    assert out.count() == len(ODD) and out.filter("score is null or score < 0 or score > 1").count() == 0
    probe = spark.createDataFrame([(1, "such scum"), (2, "such gentle")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.score(probe, m).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.score(empty, m).collect() == []
    none = toxicity.fit(train, labels.filter("false"))
    assert {r["score"] for r in toxicity.score(odd, none).collect()} == {0.5}


def test_toxicity_of_a_thinned_class(spark):
    """A word that most toxic texts hold, but more ordinary ones: thinning the ordinary class may not turn its texts toxic."""
    rnd = random.Random(4)
    rows = []
    for i in range(6000):
        toxic = int(i % 10 == 0)
        w = [rnd.choice(["river", "stone", "garden", "window", "morning", "paper"]) for _ in range(8)]
        if rnd.random() < (0.8 if toxic else 0.15):
            w[rnd.randrange(8)] = "zyxwvq"
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    full, thin = ({r["doc_id"]: r for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs.drop("toxic"), docs.drop("text"), max_per_class=m)).collect()} for m in (20_000, 600))
    assert sum(full[i]["predicted"] == thin[i]["predicted"] for i in full) >= 0.97 * len(full)
    assert abs(np.mean([r["score"] for r in thin.values()]) - 0.1) < 0.03


def test_toxic_probabilities_are_kneser_neys_and_add_up():
    """Both classes' tables against a recursion over counted strings."""
    rnd = random.Random(2)
    groups = [[" ".join("".join(rnd.choice(a) for _ in range(rnd.randrange(1, 6))) for _ in range(30))] for a in ("abcab", "bcdea")]
    coded = [toxicity.code(g).grams for g in groups]
    grams = np.unique(np.concatenate(coded))
    counts = [np.array([np.sum(c == g) for g in grams]) for c in coded]
    contexts, rows, prob = toxicity.likelihoods(grams, *counts)
    for r in [*rows, *prob]:
        assert np.allclose(r.sum(1), 1, atol=1e-5)
    occurs = []  # of each class and order: how often, or after how many symbols, an n-gram occurs
    for group in groups:
        own = [collections.Counter() for _ in range(6)]
        for word in group[0].split():
            line = [0] * 4 + [ord(c) - 96 for c in word] + [0]
            own[5].update(tuple(line[i - 4 : i + 1]) for i in range(4, len(line)))
        # white space of its own: the text's end is an empty expression only where a blank stands there
        for n in range(4, 0, -1):
            own[n].update(g[1:] for g in own[n + 1])
        occurs.append(own)
    for n in (1, 2):
        both = occurs[0][n] + occurs[1][n]
        occurs[0][n] = occurs[1][n] = both

    def p(own, g):
        if not g:
            return 1 / 32
        after = [k for x, k in own[len(g)].items() if x[:-1] == g[:-1]]
        low = p(own, g[1:])
        return low if not after else (max(own[len(g)][g] - 0.75, 0) + 0.75 * len(after) * low) / sum(after)

    for i, c in enumerate(contexts.tolist()):
        before = tuple(c >> 5 * k & 31 for k in (3, 2, 1, 0))
        for own, r in zip(occurs, rows, strict=True):
            for s in range(8):
                assert r[i, s] == pytest.approx(p(own, (*before, s)), abs=1e-5)
    table = toxicity.ratios(grams, *counts)
    assert table[(contexts[0] << 5) | 1] == pytest.approx(np.log(rows[0][0, 1] / rows[1][0, 1]), abs=2e-2)


def blankless(rnd, n):
    """Texts with hardly a blank: letters, digits and marks of several scripts."""
    return ["".join(rnd.choice("abcdeéßΣσς漢字0123.,-İ") for _ in range(rnd.randrange(n, 4 * n))) + rnd.choice(["", " end", ". "]) + "".join(rnd.choice("xyzабв") for _ in range(rnd.randrange(n))) for _ in range(20)]


def test_texts_without_blanks_score_as_whole_ones(spark, texts, docs, monkeypatch):
    """A word that no stretch holds is summed up over its stretches: labels, letters and ratios are those of the whole text."""
    rnd = random.Random(6)
    some = [*blankless(rnd, 400), "a" * 3000, "а" * 1500 + "b" * 1500, "..." * 900, "x"]
    model = language.fit(docs)
    table = np.random.default_rng(3).normal(size=toxicity.SYMBOLS**toxicity.ORDER).astype(np.float16)
    want, ratios = language.label(model, some), toxicity.comparisons(table, some)
    grams = [np.sort(toxicity.code([t]).grams) for t in some]
    for longest in (7, 64, 333):
        monkeypatch.setattr(language, "STRETCH", longest)
        monkeypatch.setattr(toxicity, "STRETCH", longest)
        for x, y in zip(want, language.label(model, some), strict=True):
            assert (x is None) == (y is None)
            if x is not None:
                assert (x[0] == y[0]).all() and (x[1] == y[1]).all()
        got = toxicity.comparisons(table, some)
        assert np.allclose(got[0], ratios[0]) and (got[1] == ratios[1]).all()
        for t, g in zip(some, grams, strict=True):
            own = np.sort(np.concatenate(list(toxicity.long_grams(t))))
            assert (own[own > 0] == g[g > 0]).all()


def test_a_long_text_without_blanks_takes_bounded_memory(spark, docs):
    import tracemalloc

    model, table, text = language.fit(docs), np.zeros(toxicity.SYMBOLS**toxicity.ORDER, np.float16), "ab" * (1 << 22)
    for work in (lambda: language.label(model, [text]), lambda: toxicity.comparisons(table, [text])):
        tracemalloc.start()
        work()
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


def test_toxicity_of_long_texts_by_stretches(texts, monkeypatch):
    rng = np.random.default_rng(1)
    table = rng.normal(0, 1, 32**5).astype(np.float16)
    some = [*list(texts.values())[:20], LONG, "", "one"]
    whole, count = toxicity.comparisons(table, some)
    monkeypatch.setattr(toxicity, "STRETCH", 200)
    cut, cut_count = toxicity.comparisons(table, some)
    assert count.tolist() == cut_count.tolist() and np.allclose(whole, cut, equal_nan=True)
    import tracemalloc

    monkeypatch.setattr(toxicity, "STRETCH", 1 << 18)
    tracemalloc.start()
    toxicity.features(table, ["some words here " * 500_000])  # 8 MB
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()


# 5 -------------------------------------------------------------------------------------------------------------------


def brute_classes(prints: dict, radius: int) -> dict:
    """Least doc_id of each class, by comparing all fingerprints."""
    ids, root = sorted(prints), {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in ids}


def test_simhash_query(spark, sf_dir, texts):
    got = queries.op5_simhash(spark, sf_dir).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got}
    shingles = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        shingles[d] = sh
    df = spark.createDataFrame([(d, x) for d, sh in shingles.items() for x in sh], "d long, x string").select("d", F.xxhash64("x").alias("h"))
    hashes = collections.defaultdict(list)
    for r in df.collect():
        hashes[r["d"]].append(r["h"])
    for d in texts:
        assert prints[d] == sum((sum((h >> i) & 1 for h in hashes[d]) * 2 > len(hashes[d])) << i for i in range(64))
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_classes(prints, 4)


@pytest.mark.parametrize(("tree", "target"), [(8, 4), (40, 4), (4096, 1024)])
def test_simhash_links_of_a_dense_group(spark, tree, target):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    near = {centre} | {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(12), 2)} | {rnd.getrandbits(64) for _ in range(200)}
    chain, x = [], rnd.getrandbits(64)
    for _ in range(6):
        x ^= sum(1 << i for i in rnd.sample(range(64), 4))
        chain.append(x)
    fps = sorted(near | set(chain))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.link(spark.createDataFrame([(s,) for s in signed], "fp long"), 4, tree, target).collect()
    root = {s: s for s in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in edges:
        root[find(r["u"])] = find(r["v"])
    want = brute_classes(dict(enumerate(fps)), 4)
    for (i, s), (j, t) in itertools.combinations(enumerate(signed), 2):
        assert (find(s) == find(t)) == (want[i] == want[j])


@pytest.mark.parametrize("count", [10, 1 << 22, 1 << 30, 1 << 40])
def test_masks_lose_no_pair(count):
    masks, rnd = simhash.shard_masks(count, 4), random.Random(1)
    for _ in range(500):
        d = sum(1 << i for i in rnd.sample(range(64), 4))
        assert any(not d & m for m in masks)


@pytest.mark.parametrize("at_once", [64, 1 << 19])
def test_bk_trees_find_all(monkeypatch, at_once):
    monkeypatch.setattr(bktree, "AT_ONCE", at_once)
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 16, 400).astype(np.uint64))
    for group in (np.zeros(len(fps), int), rng.integers(0, 9, len(fps)), np.arange(len(fps))):
        pairs = [p for a, h in bktree.Forest(fps, group).near(3) for p in zip(a.tolist(), h.tolist(), strict=True)]
        assert len(pairs) == len(set(pairs))
        assert set(pairs) == {(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}
    none = bktree.Forest(fps[:0], np.empty(0, int))
    assert list(none.near(3)) == []


def test_bk_tree_follows_only_edges_within_the_radius():
    """Edges are distances to the parent, and a search visits a part of the nodes, the same ones as a plain tree's."""
    fps = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 2000, np.uint64))
    tree = bktree.Forest(fps, np.zeros(len(fps), int))
    list(tree.near(4))
    assert tree.visited < 0.3 * len(fps) ** 2
    plain = {}

    def insert(x):
        node = root
        while (d := (node ^ x).bit_count()) in plain[node]:
            node = plain[node][d]
        plain[node][d] = x
        plain[x] = {}

    ints = [int(x) for x in fps]
    root = ints[0]
    plain[root] = {}
    for x in ints[1:]:
        insert(x)
    visited = 0
    for x in ints:
        todo = [root]
        while todo:
            node = todo.pop()
            visited += 1
            d = (node ^ x).bit_count()
            todo += [c for e, c in plain[node].items() if abs(e - d) <= 4]
    assert tree.visited == visited


def test_simhash_odd(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    assert simhash.near_duplicates(empty).collect() == []


def brute_copies(texts: dict, words: int, least: float) -> dict:
    sets = {d: set(simhash.shingle_hashes(t, words).tolist()) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if (not x and not y) or (x and y and len(x & y) >= least * len(x | y)):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    size = collections.Counter(map(find, texts))
    return {d: find(d) for d in texts if size[find(d)] > 1}


@pytest.mark.parametrize("tree", [4, 2048])
def test_near_copies(spark, texts, tree):
    rnd = random.Random(2)
    more = dict(texts)
    base = next(t for t in texts.values() if 150 < len(t.split()) < 400).split()
    for i in range(30):  # a group of near copies, each with its own edits
        w = list(base)
        for _ in range(rnd.randrange(1, 6)):
            w[rnd.randrange(len(w))] = f"edit{rnd.randrange(1000)}"
        more[100_000 + i] = " ".join(w)
    more |= {200_000: "", 200_001: " \n"}
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(df, tree=tree).collect()}
    assert got == brute_copies(more, 5, 0.8)


def test_near_copies_with_repeated_lines(spark):
    """A line said once in one copy and many times in the other adds nothing to the sets, so it may not part them."""
    rnd = random.Random(3)
    texts = {}
    for i in range(20):
        w, line = ([f"w{rnd.randrange(10**6)}" for _ in range(n)] for n in (200, 5))
        texts[i] = " ".join([*w, *line])
        texts[100 + i] = " ".join([*w, *line * 100])
    want = brute_copies(texts, 5, 0.8)
    assert len(want) == len(texts)
    got = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_rows_that_share_a_doc_id_are_judged_by_their_own_texts(spark):
    """An unrelated text under the id of a copy or a leak stays; copies under one id, and leaks without one, go."""
    rnd = random.Random(11)
    a, c, leak = ([f"w{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(3))
    b = [*a[:30], "edited", *a[31:]]
    a, b, c, leak = (" ".join(x) for x in (a, b, c, leak))
    schema = "doc_id long, text string, tag int"
    rows = [(1, a, 0), (5, b, 1), (5, c, 2), (7, c + " more", 3), (7, c + " more still", 4), (None, a + " end", 5), (None, "none like it at all", 6), (8, "", 7), (8, None, 8), (9, a, 9), (9, a, 10)]
    kept = sorted(r["tag"] for r in near_copies.keep_one(spark.createDataFrame(rows, schema).repartition(3)).collect())
    assert kept == [0, 2, 6, 7] or kept == [0, 2, 6, 8]
    rows = [(5, f"x y z {leak} u v", 0), (5, c, 1), (None, leak, 2), (None, a, 3), (6, b, 4)]
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert sorted(r["tag"] for r in decontaminate.clean(spark.createDataFrame(rows, schema), bench).collect()) == [1, 3, 4]


def test_similar_sets(spark):
    rnd = np.random.default_rng(5)
    for n in (0, 1, 60):
        sets = [np.unique(rnd.integers(0, 40, rnd.integers(0, 30))).astype(np.uint64) for _ in range(n)]
        jac = lambda x, y: len(np.intersect1d(x, y)) / max(1, len(np.union1d(x, y))) if len(x) + len(y) else 1.0
        pairs = [(i, j) for i in range(n) for j in range(i) if jac(sets[i], sets[j]) >= 0.5]
        want = bktree.Union(n)
        for i, j in pairs:
            want.join(np.array([i]), np.array([j]))
        assert (near_copies.similar(sets, 0.5).label == want.label).all()
        # those that are known to be of one class, and those of the largest class, needn't ask
        assert (near_copies.similar(sets, 0.5, want.label).label == want.label).all()
        if n:
            asked = want.label != np.argmax(np.bincount(want.label))
            assert (near_copies.similar(sets, 0.5, np.where(asked, -1 - np.arange(n), 0), asked).label == want.label).all()


def test_a_large_class_of_near_copies_costs_work_in_proportion(spark):
    """Twice the copies in a shard, about twice the comparisons: sets of one class aren't compared with each other."""
    import time

    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 62, 300)

    def took(n):
        sets = []
        for _ in range(n):
            x = base.copy()
            x[rnd.integers(0, 300, 12)] = rnd.integers(0, 1 << 62, 12)
            sets.append(np.unique(x).astype(np.uint64))
        began = time.process_time()
        assert (near_copies.similar(sets, 0.8).label == 0).all()
        return time.process_time() - began

    took(100)
    assert took(4000) < 12 * max(took(1000), 0.05)


def test_near_copies_odd(odd, empty):
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert {1, 4, 7, 9, 10, 11} <= set(ids) and not {2, 3, 8} & set(ids)
    assert near_copies.keep_one(empty).collect() == []


# 6 -------------------------------------------------------------------------------------------------------------------


def plain_spans(text):
    """The contract read literally."""
    out = []
    for m in re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII).finditer(text):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_base_spans(texts):
    rnd = random.Random(4)
    bits = ["password", "Token", "API_KEY", "apikey", " = ", ":", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "secret=token:abcdefgh", "é", "\n", " ", "ſecret=abcdefg", "xyz", "deadbeef"]
    for t in [*texts.values(), *["".join(rnd.choice(bits) for _ in range(12)) for _ in range(3000)]]:
        assert secrets.base_spans(t) == plain_spans(t)


def test_secret_scan_odd_and_learnt(spark, odd, empty):
    rnd = random.Random(1)
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    prose = ["internationalisation_of_documents plainlongordinarywords-and-more", "theprocessingofverylongwords withoutanydigitsinside"]
    train = spark.createDataFrame([(i, f"token = \"{key(40)}\" {prose[i % 2]} AKIA{''.join(rnd.choice('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') for _ in range(16))}") for i in range(60)], "doc_id long, text string")
    m = secrets.fit(train)
    assert set(m.kinds) == {"assign", "access", "hex"} and len(m.kinds["hex"].states) < 60
    probe = "0A" + key(38).upper() + " and internationalisationprocess"
    assert any(k.startswith("like_") for k, _, _ in secrets.all_spans(m, "code " + key(20) + "X" + key(19)))
    assert not [s for s in secrets.all_spans(m, probe) if s[1] > 45]
    out = secrets.scan(odd, m)
    assert out.count() == len(ODD) and out.filter("n_assign + n_access + n_hex > 0").count() == 0
    assert {r["base_sha256"] for r in out.collect()} == {hashlib.sha256(b"").hexdigest()}
    assert secrets.scan(empty, secrets.fit(empty)).collect() == []


def test_automaton_merges_and_scores():
    a = secrets.Automaton(["ab12"] * 50 + ["ab34"] * 50)
    assert a.bits("ab56") < a.bits("zz99") and a.bits("ab12") < a.bits("ab1")
    loop = secrets.Automaton(["0" * n for n in range(1, 40)] * 5)
    assert len(loop.states) < 20


class PlainAutomaton:
    """State merging read literally: classes of prefixes, whose counts are sums over their members."""

    def __init__(self, examples, alpha=secrets.ALPHA):
        lines = ["".join(map(secrets.symbol, e)) for e in examples]
        self.prefixes = {x[:i] for x in lines for i in range(len(x) + 1)} | {""}
        self.stop, self.go = collections.Counter(lines), collections.Counter(x[: i + 1] for x in lines for i in range(len(x)))
        self.of, self.alpha = {p: p for p in self.prefixes}, alpha
        settled, again = [""], True
        while again:
            again = False
            for red in list(settled):
                for s in sorted({p[-1] for p in self.prefixes if p and self.of[p[:-1]] == self.of[red]}):
                    blue = self.child(red, s)
                    if blue in {self.of[x] for x in settled}:
                        continue
                    for other in settled:
                        if self.alike(self.of[other], blue):
                            self.unite(self.of[other], blue)
                            break
                    else:
                        settled.append(blue)
                    again = True
                    break
                if again:
                    break

    def child(self, state, s):
        found = {self.of[p + s] for p in self.prefixes if self.of[p] == self.of[state] and p + s in self.of}
        return found.pop() if found else None

    def counts(self, state):
        own = [p for p in self.prefixes if self.of[p] == state]
        go = collections.Counter()
        for p in own:
            go.update({q[-1]: self.go[q] for q in self.prefixes if q[:-1] == p and q})
        return sum(self.stop[p] for p in own), go

    def alike(self, a, b):
        (x, p), (y, q) = self.counts(a), self.counts(b)
        n, m = x + sum(p.values()), y + sum(q.values())
        far = lambda k, h: n and m and abs(k / n - h / m) > np.sqrt(0.5 * np.log(2 / self.alpha)) * (n**-0.5 + m**-0.5)
        if far(x, y) or any(far(p[s], q[s]) for s in p | q):
            return False
        return all(c == d or self.alike(c, d) for s in p.keys() & q.keys() if (c := self.child(a, s)) is not None and (d := self.child(b, s)) is not None)

    def unite(self, a, b):
        todo = [(a, b)]
        while todo:
            a, b = (self.of[x] for x in todo.pop())
            if a != b:
                for p in self.prefixes:
                    if self.of[p] == b:
                        self.of[p] = a
                after = collections.defaultdict(list)
                for p in self.prefixes:
                    if p and self.of[p[:-1]] == a:
                        after[p[-1]].append(p)
                todo += [(x[0], y) for x in after.values() for y in x[1:]]

    def bits(self, text):
        at, out = self.of[""], 0.0
        for s in map(secrets.symbol, text):
            stop, go = self.counts(at) if at is not None else (0, collections.Counter())
            out -= np.log2((go[s] + 0.5) / (stop + sum(go.values()) + 6) / secrets.WIDTH.get(s, 1))
            at = self.child(at, s) if at is not None else None
        stop, go = self.counts(at) if at is not None else (0, collections.Counter())
        return out - np.log2((stop + 0.5) / (stop + sum(go.values()) + 6))


@pytest.mark.parametrize("seed", range(4))
def test_automata_are_those_of_plain_state_merging(seed):
    rnd = random.Random(seed)
    make = [lambda: f"k{rnd.randrange(100)}-" + rnd.choice("xyZ") * rnd.randrange(1, 4), lambda: "ab" * rnd.randrange(1, 5), lambda: str(rnd.randrange(10**5))]
    examples = [rnd.choice(make[: 1 + seed % 3])() for _ in range(40)]
    own, plain = secrets.Automaton(examples), PlainAutomaton(examples)
    for t in [*examples[:10], "k1-", "abab9", "", "zzZ", "k1-xxxxxxxx", "00"]:
        assert own.bits(t) == pytest.approx(plain.bits(t))


def test_free_tokens_and_their_cost():
    """A token is scored where no base span touches it; one pass over both, however many there are."""
    import time

    text = " ".join(f"token={'ab1' * 3}{i} free{i:05d}x some.words.inside. é-dashes-" for i in range(4_000))
    base, found = secrets.base_spans(text), []
    began = time.process_time()
    found = list(secrets.candidates(text, base))
    assert time.process_time() - began < 1
    want = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]+(?:\.+[A-Za-z0-9+/_=-]+)*", text) if m.end() - m.start() >= secrets.LEAST_TOKEN]
    starts = np.array([a for _, a, _ in base])
    free = [(a, z) for a, z in want if not any(base[i][1] < z and a < base[i][2] for i in range(max(0, int(np.searchsorted(starts, a)) - 2), min(len(base), int(np.searchsorted(starts, z)) + 1)))]
    assert [(a, z) for _, a, z in found] == free and len(free) >= 12_000
    assert {text[a:z] for _, a, z in found[:3]} == {"free00000x", "some.words.inside", "-dashes-"}


def test_short_credentials_are_found(spark):
    """A six-character value like those of learnt assignments, standing free, and a dotted one; plain words are not."""
    rnd = random.Random(3)
    value = lambda: "".join(rnd.choice("ABCDEFGH") + rnd.choice("0123456789") for _ in range(3))
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(6, 12))) for _ in range(900)]
    train = spark.createDataFrame([(i, f"password: {value()} " + " ".join(rnd.sample(words, 9)) + f" secret={value()}.{value()}") for i in range(300)], "doc_id long, text string")
    m = secrets.fit(train)
    text = f"say {value()} or {value()}.{value()} to decade facade " + " ".join(words[:50])
    assert [text[a:z] for k, a, z in secrets.all_spans(m, text)] == [text.split()[1], text.split()[3]]
    again = secrets.fit(train.repartition(7))
    assert again.ordinary.states == m.ordinary.states and again.kinds["assign"].states == m.kinds["assign"].states


def test_secret_query(spark, sf_dir, texts):
    for r in queries.op6_secrets(spark, sf_dir).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()


# 8 -------------------------------------------------------------------------------------------------------------------


def test_byte_bpe_is_tiktoken(texts):
    import tiktoken

    b = byte_bpe.coder(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rnd = random.Random(7)
    fuzz = ["".join(rnd.choice("a b\n\t'sté1½.\x1c　I'm") for _ in range(80)) for _ in range(400)]
    for t in [*texts.values(), *fuzz, *[t or "" for _, t in ODD]]:
        ids = b.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert b.decode(ids) == t.encode()


def test_perfect_hash():
    b = byte_bpe.coder(RANKS, P.PATTERN)
    assert sorted(b.whole.ids) == list(range(len(b.ranks))) and all(b.whole.get(k) == i for k, i in b.ranks.items())
    assert b.whole.get(b"no such token at all") is None


def test_byte_bpe_odd(odd, empty):
    got = byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in got) and len(got) == len(ODD)
    assert byte_bpe.digests(empty, RANKS, P.PATTERN).collect() == []


# 9 -------------------------------------------------------------------------------------------------------------------


def plain_words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))


@pytest.mark.parametrize("block", [4_000, 24 << 20])
def test_lm_base_score(spark, docs, texts, block):
    held = common.text_bucket("doc_id", 10) == 0
    got = {r["doc_id"]: r for r in lm_scoring.score(docs.repartition(3), held, block_bytes=block).collect()}
    train = {d for d in texts if zlib.crc32(str(d).encode()) % 10}
    count = collections.Counter(w for d in train for w in [*plain_words(texts[d]), "\n"])
    n, v = sum(count.values()), len(count)
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        w = [*plain_words(t), "\n"]
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d not in train, len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-6)
        assert r["score"] < 0


def test_lm_blocks_are_bounded_and_long_texts_are_cut(spark, monkeypatch):
    """A text longer than a block is scored in pieces as if it were whole."""
    rnd = random.Random(6)
    texts = {i: " ".join(rnd.choice(["tree", "Ünï", "house", "漢字", "a"]) for _ in range(n)) + rnd.choice(["", " "]) for i, n in enumerate([3, 5000, 0, 40, 700, 2500, 12])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    held = F.col("doc_id") % 3 == 0
    size = F.octet_length("text") - F.col("lead")
    for block in (300, 4_000):
        cut = lm_scoring.blocks(df, held, block)
        assert cut.groupBy("block").agg(F.sum(size).alias("b")).filter(f"b > {block} + 600").count() == 0
        assert cut.agg(F.sum(size)).first()[0] == sum(len(t.encode()) for t in texts.values())
        small, whole = ({r["doc_id"]: tuple(r) for r in lm_scoring.score(df, held, b).collect()} for b in (block, 1 << 24))
        assert small.keys() == whole.keys() == texts.keys()
        for i in texts:
            assert small[i] == pytest.approx(whole[i])
    monkeypatch.setattr(lm_scoring, "ROWS_A_TASK", 16)
    salted = {r["doc_id"]: tuple(r) for r in lm_scoring.score(df, held, 300).collect()}
    assert all(salted[i] == pytest.approx(whole[i]) for i in texts)


def test_lm_words_that_no_piece_holds(spark):
    """Words longer than a piece are one token each, the same one wherever they are cut, and pieces stay bounded."""
    rnd = random.Random(4)
    giant, other = "".join(rnd.choice("abÉ漢") for _ in range(3000)), "Q" * 1700
    texts = [(1, giant), (2, f"one {giant} two {giant.upper() if giant.isascii() else giant}"), (3, f"{other} {other.lower()}x {other}"), (4, "one two"), (5, other), (6, giant[:-1] + "!"), (7, "a\u00a0b " * 900), (8, f" {giant}\n"), (9, "")]
    df, held = spark.createDataFrame(texts, "doc_id long, text string").repartition(2), F.col("doc_id") % 2 == 0
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t)
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in texts}
    count = collections.Counter(w for i, _ in texts if i % 2 for w in tokens[i])
    ends = sum(i % 2 for i, _ in texts)
    n, v = sum(count.values()) + ends, len(count) + 1
    whole = {r["doc_id"]: r["score"] for r in lm_scoring.score(df, held).collect()}
    for block in (400, 1000, 1 << 24):
        got = {r["doc_id"]: r for r in lm_scoring.score(df, held, block_bytes=block).collect()}
        for i, w in tokens.items():
            base = sum(math.log10(count[x] + 0.1) for x in w) + math.log10(ends + 0.1) - (len(w) + 1) * math.log10(n + 0.1 * (v + 1))
            r = got[i]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(count[x] > 0 for x in w) + 1, n)
            assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(whole[i])
        size = lm_scoring.blocks(df, held, block).agg(F.max(F.length("text"))).first()[0]
        assert size <= max(block // 2, 1) + lm_scoring.LEAD or block > 10_000


def test_lm_odd(odd, empty):
    held = common.text_bucket("doc_id", 10) == 0
    got = lm_scoring.score(odd, held).collect()
    assert len(got) == len(ODD) and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in got)
    assert lm_scoring.score(empty, held).collect() == []
    assert len(lm_scoring.score(odd, F.lit(True)).collect()) == len(ODD)  # nothing to learn from


def test_lm_score_holds_every_context(spark, docs, texts):
    """Scores are those of one table of all contexts, and contexts of any length count however rare they are."""
    held = common.text_bucket("doc_id", 10) == 0
    model = lm_scoring.train_ppm(docs.select(F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out")))
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, held, block_bytes=40_000, order=ppm.ORDER).collect()}
    want = ppm.score(model.rows, model.index(), [texts[d].encode() for d in got])
    assert list(got.values()) == pytest.approx(want.tolist(), rel=1e-4)
    rows = [(i, "the common text " * 500) for i in range(40)] + [(100, "zqxjw"), (101, "zqxjw"), (102, "zqwjx")]
    rare = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(rare, F.col("doc_id") > 100).collect()}
    assert got[101] > got[102] + 3  # said once among 320,000 bytes


@pytest.mark.parametrize("order", [0, 2, 5])
def test_gram_costs(spark, order):
    learnt, asked = [b"abracadabra", b"abc", b""], [b"abra", b"zzbrad", "é".encode()]
    count = [collections.Counter() for _ in range(order + 1)]
    pad = lambda t: b"\xff" * order + t + b"\xff"
    for t in map(pad, learnt):
        for i in range(order, len(t)):
            for n in range(order + 1):
                count[n][t[i - n : i], t[i]] += 1

    def p(context, n):
        below = p(context, n - 1) if n else [1 / 256] * 256
        own = [count[n][context[len(context) - n :], s] for s in range(256)]
        if not sum(own):
            return below
        kinds = sum(k > 0 for k in own)
        rest = sum(b for k, b in zip(own, below, strict=True) if not k)
        return [(k if k else kinds * b / rest) / (sum(own) + kinds) for k, b in zip(own, below, strict=True)]

    rows = [(g, 1) for g in ppm.grams(learnt, order)[0].tolist()] + [(g, 0) for g in ppm.grams(asked, order)[0].tolist()]
    df = spark.createDataFrame(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got = {r["gram"]: r["cost"] for r in lm_scoring.gram_costs(df, order).collect()}
    for t in map(pad, learnt + asked):
        for i in range(order, len(t)):
            gram = int.from_bytes(t[i - order : i + 1], "big")
            assert got[gram] == pytest.approx(np.log10(p(t[i - order : i], order)[t[i]]), abs=1e-9)


def test_ppm_probabilities_add_up():
    t = [b"abracadabra", b"abc", b""]
    tables = []
    g, _ = ppm.grams(t)
    for n in range(ppm.ORDER + 1):
        tables.append(np.unique(g.astype(np.int64) % (1 << 8 * (n + 1)), return_counts=True))
    m = ppm.build("t", tables)
    assert np.allclose((10.0 ** m.rows.astype(float)).sum(1), 1, atol=1e-4)
    cost = ppm.score(m.rows, m.index(), [b"abra", b"zzzz", b""])
    assert cost[0] > cost[1] and cost[2] < 0


def test_ppm_prefers_the_corpus(spark, docs, texts):
    m = lm_scoring.train_ppm(docs.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("held_out")))
    t = next(x for x in texts.values() if len(x) > 400).encode()
    noise = bytes(random.Random(1).choices(range(33, 127), k=len(t)))
    own, other = ppm.score(m.rows, m.index(), [t, noise])
    assert own > 2 * other / 3


# 10 ------------------------------------------------------------------------------------------------------------------


def edit_distance(a, b):
    """Least edits of a against any stretch of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(5))
def test_alignment(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 40)
    edits, s, e = decontaminate.alignment(a, b)
    assert edits == edit_distance(a.tolist(), b.tolist())
    full = np.zeros((13, e - s + 1), int)
    full[:, 0], full[0] = range(13), range(e - s + 1)
    for i in range(12):
        for j in range(e - s):
            full[i + 1, j + 1] = min(full[i, j + 1] + 1, full[i + 1, j] + 1, full[i, j] + (a[i] != b[s + j]))
    assert full[-1, -1] == edits


def test_decontaminate_query(spark, sf_dir, texts):
    items = {r["item_id"]: decontaminate.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op10_decontaminate(spark, sf_dir).collect()}
    for d, t in texts.items():
        w = decontaminate.words(t)
        for i, item in items.items():
            holds = f" {' '.join(item)} " in f" {' '.join(w)} "
            if holds:
                assert got.get((d, i)) == 0
            elif (d, i) in got:
                assert got[d, i] == edit_distance(item, w) <= 0.2 * len(item)


def test_decontaminate_recall_under_edits(spark, texts):
    rnd = random.Random(3)
    filler = [w for t in list(texts.values())[:60] for w in decontaminate.words(t)]
    bench, rows = [], []
    for i in range(80):
        a = rnd.randrange(len(filler) - 200)
        item = filler[a : a + rnd.randrange(15, 60)]
        bench.append((i, " ".join(item)))
        w = list(item)
        for _ in range(int(0.12 * len(w))):
            p = rnd.randrange(len(w))
            w[p : p + 1] = rnd.choice([[], [rnd.choice(filler)], [w[p], "inserted"]])
        b = rnd.randrange(len(filler) - 200)
        rows.append((i, " ".join(["zq"] * 30 + w + filler[b : b + 60])))
    out = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=4_000)
    got = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    near = {(i, i) for i in range(80) if edit_distance(decontaminate.words(bench[i][1]), decontaminate.words(rows[i][1])) <= 0.2 * len(bench[i][1].split()) + 1e-9}
    assert len(near & got) >= 0.9 * len(near) and len(near) > 70


def test_decontaminate_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text here"), (5, "Text here"), (4, " ".join(f"w{i}" for i in range(20, 60))), (None, "x y z")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find(odd.filter("doc_id is not null"), bench).collect())
    # short items are found anywhere in a text, as they are
    assert got == [(4, 3, 0), (4, 5, 0), (5, 3, 0), (5, 3, 0), (5, 5, 0), (5, 5, 0), (7, 4, 0), (8, 4, 0)]
    assert decontaminate.find(empty, bench).collect() == []
    assert decontaminate.find(odd, bench.filter("false")).collect() == []
    kept = decontaminate.clean(odd, bench)
    # a leak without a doc_id goes like others; a short item within a longer text is no leak unless it is asked for
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 6
    part = spark.createDataFrame([(1, "well, text here it is")], "doc_id long, text string")
    assert decontaminate.clean(part, bench).count() == 1 and decontaminate.clean(part, bench, least_words=2).count() == 0


def test_decontaminate_scripts_without_blanks_and_long_items(spark):
    rnd = random.Random(8)
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(120))
    thai = "".join(chr(0x0E01 + rnd.randrange(40)) for _ in range(80))
    long = " ".join(f"v{rnd.randrange(5000)}" for _ in range(6000))
    edited = long.split()
    for _ in range(300):
        edited[rnd.randrange(6000)] = "other"
    bench = spark.createDataFrame([(1, han), (2, thai), (3, long)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "前" * 40 + han[:50] + "改" + han[51:] + "後" * 9), (2, "x " + thai + " y"), (3, "a b c " * 50 + " ".join(edited) + " z" * 50), (4, "x y z"), (5, "今日は" * 30)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontaminate.find(docs, bench).collect()}
    assert got.keys() == {(1, 1), (2, 2), (3, 3)} and got[1, 1] == 1 and got[2, 2] == 0


def test_decontaminate_looks_at_different_parts_once(monkeypatch):
    """Words come from the different parts between blanks, not from each text; their numbers are those of words()."""
    items = [(1, "the quick brown fox jumps over the lazy dog"), (2, "\u039f\u0394\u039f\u03a3 don't"), (3, "\u00e9")]
    index = decontaminate.Index(items, 0.8, 4, 16, 5, 5)
    read, split = [], decontaminate.words
    text = "said (the) Quick brown fox, jumps over the lazy dog's tail " * 3 + "dog's"
    with monkeypatch.context() as m:
        m.setattr(decontaminate, "words", lambda t: read.append(len(t)) or split(t))
        found = index.search([text] * 300)
    assert [r[:3] for r in found] == [(i, 1, 0) for i in range(300)] and sum(read) < 2 * len(text)
    rnd = random.Random(4)
    odd = ["", " ", "\n", "x", *("".join(rnd.choice("the fox\u00c9\u00e9\u0301\u0130\u00df_'.!\u03a3\u03c3\n\t\u6f22\u00b21") for _ in range(rnd.randint(0, 40))) for _ in range(500)), "\u039f\u0394\u039f\u03a3 don't"]
    line, bounds = index._lines(pa.array(odd))
    for i, t in enumerate(odd):
        assert line[bounds[i] : bounds[i + 1]].tolist() == [*(index.numbers.get(w, 0) for w in decontaminate.words(t)), -1]


def test_decontaminate_index_is_no_larger_than_its_items():
    """One item of thousands of words takes no table of coins: the index holds its words and its keys."""
    import tracemalloc

    rnd = random.Random(2)
    text = " ".join(f"v{rnd.randrange(6000)}" for _ in range(6000))
    tracemalloc.start()
    decontaminate.Index([(1, text)], 0.8, decontaminate.WALKS, decontaminate.TABLES, decontaminate.PLACES, 5)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
