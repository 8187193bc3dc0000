"""Operators 11 to 13 against plain Python on small tables with nulls, blanks, ties, repeated rows and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.llm import lang_id, packed, phrases, ranked

# ---------------------------------------------------------------- packed numbers


def test_packed_numbers():
    r = np.random.default_rng(1)
    for values in (np.empty(0, np.int64), np.array([0, 254, 255, 256, 2**32 - 1]), r.integers(0, 1000, 500)):
        assert (packed.unpack(packed.pack(values), len(values)) == values).all()
    keys = np.sort(r.integers(0, 2**64, 300, dtype=np.uint64))
    assert (packed.unpack_keys(packed.pack_keys(keys)) == keys).all() and len(packed.unpack_keys(packed.pack_keys(keys[:0]))) == 0
    runs, starts = np.array([3, 5, 9, 0, 2, 7]), np.array([0, 3, 5])
    assert (packed.ungap(packed.gaps(runs, starts), starts) == runs).all()


# ---------------------------------------------------------------- 11: languages

WORDS = {"en": "the of and to in is that it was for", "de": "der die und das nicht ein ist von mit zu", "ru": "и в не на что он как это по но", "zz": "qix qax zoq xaz qoz zix"}


def sentence(r, lang, n):
    return " ".join(r.choices(WORDS[lang].split(), k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def tongues(spark):
    r = random.Random(5)
    rows = [(k, sentence(r, lang, r.randint(3, 60)), lang, 0.5, "x") for k, lang in enumerate(r.choices(["en", "en", "en", "de", "ru"], k=400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")


def test_languages(spark, tongues):
    model = lang_id.fit(tongues.where("doc_id % 4 <> 2"), bits=11, clusters=3)
    assert model.languages == ["de", "en", "ru"] and 3 <= len(model.centroids) <= 9 and model.documents == tongues.where("doc_id % 4 <> 2").count()
    out = lang_id.identify(tongues, model)
    assert out.columns == [*tongues.columns, "lang_pred_", "score_", "rejected"]  # names that clash
    rows = out.collect()
    assert len(rows) == 400 and all(r.lang_pred_ == r.lang and 0 < r.score_ <= 1 for r in rows) and sum(r.rejected for r in rows if r.doc_id % 4 == 2) <= 5
    far = "qzxj kvwq zzzq xqjk " * 8
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " 12 .,! \n"), (4, far), (4, far), (None, "der und das nicht"), (5, "the of and " * 60_000)], "doc_id long, text string")
    got = {(r.doc_id, r.text and r.text[:5]): (r.lang_pred, r.score, r.rejected) for r in lang_id.identify(odd, model).collect()}
    assert got[1, None] == got[2, ""] == got[3, " 12 ."] == ("und", 0.0, True)
    assert got[4, "qzxj "][2] and got[4, "qzxj "][0] in model.languages and got[None, "der u"][0] == "de" and got[5, "the o"][0] == "en"
    assert lang_id.identify(odd, model).count() == 7
    assert {r.lang_pred for r in lang_id.identify(odd.where("doc_id = 4"), model, reject=True).collect()} == {"und"}


def test_languages_equal_texts_and_empty_tables(spark, tongues):
    tongues = tongues.select("doc_id", "text", "lang")
    none = lang_id.fit(tongues.limit(0))
    assert [r.lang_pred for r in lang_id.identify(tongues.limit(2), none).collect()] == ["und", "und"]
    blank = lang_id.fit(spark.createDataFrame([(None, "en"), ("", "de"), ("the of", None)], "text string, lang string"))
    assert blank.languages == [] and lang_id.identify(tongues.limit(0), blank).count() == 0
    model = lang_id.fit(tongues, bits=11)
    many = tongues.limit(1).crossJoin(spark.range(3000)).select("doc_id", "text", "lang").union(tongues).repartition(6)
    again = lang_id.fit(many, order=F.col("doc_id"), bits=11, shown=4000)  # a row that is there 3,000 times is drawn once
    assert again.documents == 3400 and again.languages == model.languages and len(again.centroids) > len(again.languages)
    twice = tongues.limit(20).union(tongues.limit(20)).repartition(5)
    assert lang_id.identify(twice, model).groupBy("doc_id").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0


def test_language_features_against_a_loop():
    texts = ["Ab c", "", "ÄB-12 x", "a", "日本 語"]
    tf, lettered = lang_id.counts(texts, 20)
    letters = [re.sub(r"[^a-zäöüé日本語]+", " ", f" {t.lower()} ") for t in texts]
    grams = [Counter(g for n in (1, 2, 3) for k in range(len(t) - n + 1) if (g := t[k : k + n]).strip()) for t in letters]
    assert tf.sum(1).tolist() == [sum(g.values()) for g in grams] and (tf > 0).sum(1).tolist() == [len(g) for g in grams]
    assert lettered.tolist() == [True, False, True, True, True]
    alone = np.concatenate([lang_id.counts([t], 20)[0] for t in texts])
    assert (alone == tf).all()  # neighbours don't count


# ---------------------------------------------------------------- 12: phrases


def mined(rows, least=10, best=2000, inside=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(w[k : k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cands.items():
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= inside * a for q, b in cands.items()):
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


def phrase_rows(seed, n):
    r = random.Random(seed)
    vocabulary = ["a", "b", "New", "york", "city", "é", "ß", "naïve", "x" * 300, "q1", "\x1c"]
    marks = ["", "", "", ",", ".", "\n", "\t", " ; "]
    return [("".join(r.choice(vocabulary) + r.choice(marks) + " " for _ in range(r.randint(0, 60))) if r.random() > 0.1 else None, r.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize(("shard", "together"), [(500_000, 400_000), (40, 64)])
def test_phrases_against_a_loop(spark, monkeypatch, shard, together):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "TOGETHER", together)
    rows = phrase_rows(3, 150)
    rows += rows[:20]  # repeated rows count
    docs = spark.createDataFrame([(k, t, lang, 1, 2) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, rank int, score int").repartition(3)
    for least, best, inside in ((10, 2000, 50), (4, 7, 90)):
        got = sorted(map(tuple, phrases.collocations(docs, least=least, best=best, inside=inside).collect()))
        assert got == mined(rows, least, best, inside)


def test_phrases_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "text string, lang string")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for rows in ([], [(None, None), ("", "en")], [("one two three", "en")]):
        out = phrases.collocations(make(rows))
        assert out.columns == columns and out.collect() == []
    long = [("the same words again " * 30_000, "en"), ("same. words, again; " * 20, "en")]
    assert sorted(map(tuple, phrases.collocations(make(long)).collect())) == mined(long)


def test_bitmaps_shift_over_blocks():
    own = phrases.Gathered()
    own.add([("a b " * 40).encode(), b"a. b a b"])
    row = dict(zip([c.split()[0] for c in phrases.SHARDS.split(", ")], own.row("en", 1), strict=True))
    parts = list(phrases.Bitmaps(row, phrases.Filter(None)).counted(None))
    assert sorted(n for _, counts in parts for n in counts.tolist()) == [40, 41]  # b a: 39 + 1; a b: 40 + 1
    flags = np.random.default_rng(2).integers(0, 2**64, 1000, dtype=np.uint64)
    assert phrases.Filter(None).has(flags).all()


def test_filter_loses_no_key(spark):
    keys = np.random.default_rng(3).integers(-(2**63), 2**63, 5000)
    made = phrases.bloom(spark.createDataFrame([(int(k),) for k in keys], "key long"), len(keys))
    assert made.has(keys.view(np.uint64)).all()
    assert made.has(np.random.default_rng(4).integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.02
    assert not phrases.bloom(spark.createDataFrame([], "key long"), 0).has(np.arange(10, dtype=np.uint64)).any()


# ---------------------------------------------------------------- 13: search


def searched(docs, items, best=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    terms = [(i, split(t)) for i, t in docs]
    size, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    for item, text in items:
        scored = []
        for doc, t in terms:
            tf, score = Counter(t), 0
            for w in split(text):
                if tf[w]:
                    m = 100 - 75 + 75 * len(t) * size // total
                    score += math.floor(1000 * math.log((2 * size + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:best], 1)]
    return out


def search_rows(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7))}" for _ in range(300)] + ["Ünï", "naïve", "don't"]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(0, 50))) if r.random() > 0.05 else None for _ in range(n)]
    docs = [(r.choice([k, -k, k]), t) for k, t in enumerate(texts)]
    docs += docs[:10] + [(None, texts[3]), (None, texts[4]), (7, "?!"), (2**62, "w1 " * 40_000)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for k in range(15)] + [(15, None), (16, "..."), (3, "w1 w1 w2"), (None, "w1 naïve")]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(1_000_000, 4096), (200, 4)])
def test_search_against_a_loop(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "BLOCK", block)
    docs, items = search_rows(9, 200)
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, score int").repartition(4)
    for best in (10, 3):
        index = ranked.build(table)
        got = sorted(map(tuple, ranked.search(index, spark.createDataFrame(items, "item_id long, text string"), best=best).collect()), key=repr)
        assert got == sorted(searched(docs, items, best), key=repr)


def test_search_edges(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "..")], "doc_id long, text string")
    for table in (docs, docs.limit(0)):
        assert ranked.search(ranked.build(table), items).collect() == []
    some = spark.createDataFrame([(5, "A b c"), (4, "a B c")], "doc_id long, text string")
    assert [(r.rank, r.doc_id) for r in ranked.search(ranked.build(some), items).collect()] == [(1, 4), (2, 5)]  # equal scores
    out = ranked.search(ranked.build(some), items.limit(0))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_search_lengths_beyond_64_bits():
    row = dict(zip([c.split()[0] for c in ranked.INDEX.split(", ")], ranked._shard([1], [np.arange(3, dtype=np.uint64)]), strict=True))
    shared = ranked.Shared(np.arange(3, dtype=np.uint64), [1, 1, 1], [[(0, 1)]], 10**18, 3 * 10**18, 10)
    shard = ranked.Shard(row, shared)
    assert shard.lists[0][1] == [10**9 // (1000 + 8 * (25 + 75 * 3 * 10**18 // (3 * 10**18)))]
