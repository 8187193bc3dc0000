"""Blocks compared in tiles."""

import numpy as np

from folioframe.llm import ngram_join


def test_tiles_deal_rows_linearly(spark, monkeypatch):
    """A block whose rows are all open is compared in tiles that grow with it: a row is in eight of them at most."""
    dealt = []
    by_part = ngram_join._by_part
    monkeypatch.setattr(ngram_join, "_by_part", lambda df, *more: (dealt.append(df.count()), by_part(df, *more))[1])
    n = 640
    blocks = spark.createDataFrame([(0, k) for k in range(n)], "pivot long, sid long")
    rows = spark.createDataFrame([(k, k // 2 * 2 if k > 600 else k) for k in range(n)], "sid long, key long")

    def verify(pdf):
        key = pdf["key"].to_numpy()
        return ngram_join.linked_tiles(pdf, lambda at: np.nonzero(np.triu(key[at][:, None] == key[at][None, :], 1)))

    edges = {tuple(sorted(e)) for e in ngram_join.linked_blocks(blocks, rows, verify, 16, 4).select("src", "dst").collect()}
    assert edges == {(k, k + 1) for k in range(600, n, 2)}
    assert dealt[1] <= 8 * n


def test_overlaps_by_strips(monkeypatch):
    rng = np.random.default_rng(5)
    keys = [np.unique(np.concatenate([np.arange(30) + 40 * (k % 3), rng.integers(200, 230, 3)])).astype(np.uint64) for k in range(70)]
    n = np.array([len(k) for k in keys], float)
    want = [(i, j) for i in range(70) for j in range(i + 1, 70) if 100 * len(both := np.intersect1d(keys[i], keys[j])) >= 85 * (n[i] + n[j] - len(both))]
    monkeypatch.setattr(ngram_join, "CELLS", 1400, raising=False)
    assert sorted(zip(*(x.tolist() for x in ngram_join.overlap_links(n, keys, 85)), strict=True)) == want
