"""The registered queries against their SQL, and the pipeline's stages on a small table."""

import pytest

import corpus_pipeline
from folioframe.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, same):
    same(registry.queries()[name], SQL[name])


def test_names():
    assert {n.split("_")[0] for n in registry.queries()} >= {f"op{k}" for k in range(1, 11)}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes[1] <= sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.where("NOT exact").count() == 0 and out.count() == sizes[-1]
    assert docs.groupBy("doc_id").count().where("count > 3").count() == 0


def small(spark):
    """Copies, near copies, a toxic text, blanks, nulls and repeated rows."""
    words = [f"word{k}" for k in range(60)]
    near = list(words)
    near[30] = "other"
    texts = [" ".join(words), " ".join(words), " ".join(near), "one\ntwo lines", "one\nthree lines", None, "", " ", " ".join(reversed(words))]
    rows = [(k, t, "en", "s" if k % 2 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8], (None, "no id here", None, "t", 10)], "doc_id long, text string, lang string, source string, n_chars long")


def labelled(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(name, spark, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty = small(spark).limit(0)
    out = stage(spark, spark.createDataFrame([], empty.schema), labelled(spark, tmp_path, [(1, 1, 0)]))
    assert out.count() == 0 and (name == "piece_encoding" or out.columns == empty.columns)


def test_line_stage_against_a_loop(spark):
    docs = small(spark)
    out = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").where("doc_id IS NOT NULL").collect()}
    seen: list[set] = []

    def repeats(line):
        grams = {line[k : k + 8] for k in range(max(1, len(line) - 7))}
        hit = any(100 * len(grams & x) >= 80 * len(grams | x) for x in seen)
        seen.append(grams)
        return hit

    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy("doc_id").collect():
        want = r.text if r.text is None else "\n".join(x for x in r.text.split("\n") if not x.strip() or not repeats(x.strip()))
        assert out[r.doc_id].text == want and out[r.doc_id].n_chars == (r.n_chars if want is None else len(want))


def test_copy_stage_against_a_loop(spark):
    docs = small(spark)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    rows = docs.dropDuplicates().collect()
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if (t or "").split() else set()
    kept, blank = [], False
    for r in sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id):
        g = grams(r.text)
        if not g:
            kept += [] if blank else [r.doc_id]
            blank = True
        elif not any(100 * len(g & grams(o.text)) >= 80 * len(g | grams(o.text)) for o in rows if o.doc_id in kept and grams(o.text)):
            kept.append(r.doc_id)
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == kept and sum(r.doc_id is None for r in out) == 1


def test_toxic_stage_and_encoding_stage(spark, tmp_path):
    docs = spark.createDataFrame([(k, ("grobble snark " if k % 3 == 0 else "kind words ") + f"and more text {k} here", "en", "s", 9) for k in range(400)] + [(900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = labelled(spark, tmp_path, [(k, 1, int(k % 3 == 0)) for k in range(300)])
    left = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    assert left == {k for k in range(400) if k % 3} | {900}
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=(corpus_pipeline.TOKENIZERS / "piece_bpe_32k.model").read_bytes())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids == (None if texts[r.doc_id] is None else lib.encode(texts[r.doc_id])) for r in corpus_pipeline.encode(spark, docs, sf).collect())
