"""Compactions at once, rows that share an id, and copies told apart by id and text."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioframe.llm import embed_dedup, ngram_join, rollups, storage
from folioframe.llm import sketch as sk

ROWS = "source string, lang string, tokenizer string, tokens long"


@pytest.mark.parametrize("between", ["_open", "_follow", "totals"])
def test_two_compactions_at_once(spark, tmp_path, between):
    rows = spark.createDataFrame([("x", "en", "t", 5)], ROWS)
    store, other = (rollups.RollupStore(spark, f"{tmp_path.as_uri()}/{between}") for _ in range(2))
    assert store.commit("a", rollups.inserts(rows)) and store.commit("b", rollups.inserts(rows))
    assert store.compact() and store.commit("c", rollups.inserts(rows))
    call, done = getattr(store, between), []

    def during(*args):
        if between == "_open":
            out = call(*args)
        if not done:
            done.append(True)
            assert other.commit("d", rollups.inserts(rows)) and other.compact()
        return out if between == "_open" else call(*args)

    setattr(store, between, during)
    try:
        store.compact()
    except Exception as e:  # what it was about to read has been compacted away by the other
        assert "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "FAILED_READ_FILE" in str(e), e
    fresh = rollups.RollupStore(spark, store.path)
    assert [(r.n_docs, r.n_tokens) for r in fresh.totals().collect()] == [(4, 20)] and fresh.batches() == ["a", "b", "c", "d"]
    assert not any(fresh.commit(b, rollups.inserts(rows)) for b in "abcd") and fresh.commit("e", rollups.inserts(rows)) and fresh.compact() and not fresh.compact()
    assert [(r.n_docs, r.n_tokens) for r in fresh.totals().collect()] == [(5, 25)]


def test_a_mark_left_empty(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("x", "en", "t", 5)], ROWS)
    store = rollups.RollupStore(spark, tmp_path.as_uri() + "/empty")
    store.commit("a", rollups.inserts(rows))
    (tmp_path / "empty" / "bases").mkdir()
    (tmp_path / "empty" / "bases" / f"{1:012d}").touch()
    assert not store.compact() and [r.n_tokens for r in store.totals().collect()] == [5]
    monkeypatch.setattr(rollups, "STALE", -1)
    assert store.compact() and [r.n_tokens for r in store.totals().collect()] == [5] and store.batches() == ["a"]


def test_vectors_that_share_an_id(spark):
    r = random.Random(6)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [0.01, 1.0])]
    out = sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert out == [(1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False)]
    many = [(r.randrange(40), [math.cos(a), math.sin(a), 0.1]) for a in (r.random() * 6 for _ in range(120))]
    many += many[:5]
    unit = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for _, v in many]
    near = lambda a, b: sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= 0.95
    root = list(range(len(many)))
    for _ in many:
        for a in range(len(many)):
            for b in range(a):
                if near(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    least = {k: min(many[j][0] for j in range(len(many)) if root[j] == k) for k in set(root)}
    want = sorted((many[a][0], sum(near(a, b) for b in range(len(many)) if b != a), least[root[a]], many[a][0] == least[root[a]]) for a in range(len(many)))
    assert sorted(map(tuple, embed_dedup.near_duplicates(spark.createDataFrame(many, "vec_id long, embedding array<double>"), shards=3).collect())) == want


def test_one_of_each_text(spark):
    words = [f"w{k}" for k in range(40)]
    near = [*words[:20], "other", *words[21:]]
    texts = [(1, "a b c"), (1, "d e f"), (2, "a b c"), (1, "a b c"), (None, "d e f"), (None, "x y"), (None, "x y"), (7, " ".join(words)), (5, " ".join(near)), (8, " ".join(reversed(words)))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id long, text string, row int, key string").repartition(3)
    for percent, big in ((60, [(5, " ".join(near))]), (95, [(5, " ".join(near)), (7, " ".join(words))])):
        got = sorted(((r.doc_id or 0, r.text) for r in ngram_join.one_of_each_text(docs, width=3, percent=percent).collect()))
        assert got == sorted([(1, "a b c"), (1, "d e f"), (0, "x y"), (8, " ".join(reversed(words))), *big])
    assert ngram_join.one_of_each_text(docs, width=3).columns == docs.columns and ngram_join.one_of_each_text(docs.limit(0)).count() == 0
    stage = corpus_pipeline.drop_near_duplicates(spark, docs, "").where("doc_id = 1")
    assert sorted(r.text for r in stage.collect()) == ["a b c", "d e f"]  # unrelated texts that share an id
    assert stage.select(F.count("*")).first()[0] == 2


@pytest.mark.parametrize("bits", [0, 3, 7, 11, 17])
def test_packed_sets_at_any_number_of_buckets(bits):
    r = np.random.default_rng(bits)
    for n in (0, 1, 300, 5000):
        keys = np.unique(r.integers(0, 1 << 32 + bits, n, dtype=np.uint64))
        data = ngram_join.pack_keys(keys, bits)
        assert (ngram_join.unpack_keys(data, bits) == keys).all() and len(data) == len(keys) * (-(-(32 + bits) // 8))


@pytest.mark.parametrize("bits", [3, 7, 11, 14, 17])
def test_hot_columns_are_few_at_any_number_of_buckets(spark, bits):
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 400_000, dtype=np.uint64)
    hot = np.repeat(keys[:3], 4000)
    sketch = np.zeros(sk.CELLS, np.int64)
    sk.add(sketch, np.concatenate([keys, hot]))
    rows = [(k, bytearray(d), 0) for k, d in sk.parts(sketch)] + [(0, bytearray(b""), len(keys) + len(hot))]
    flags = sk.hot_flags(spark.createDataFrame(rows, "part int, data binary, n long"), min(16 << bits, ngram_join.MOST_HOT))
    assert sk.marked(flags, keys[3:]).mean() < 0.01 and (bits < 7 or sk.marked(flags, keys[:3]).all())


def test_result_is_the_same_at_any_number_of_partitions(spark):
    r = random.Random(9)
    texts = []
    for k in range(120):
        words = [f"w{r.randrange(30)}" for _ in range(25)] if k % 3 == 0 else list(words)
        if k % 3:
            words[r.randrange(25)] = "x"
        texts.append((k, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "5", "300"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, ngram_join.jaccard_components(docs, width=2, percent=70).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len({c for _, _, c in found[0]}) < 120


def test_batches_are_bounded_in_bytes(spark):
    """Packed rows are megabytes long: a batch holds few of them, whatever their number."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    storage.bounded_batches(spark.range(1))
    assert int(spark.conf.get(key)) <= 8 << 20
