"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, html_text, lang_id, line_dedup, lm_score, mixing, mpeg, ngram_join, phrases, piece_fst, ranked, rollups, toxicity
from .storage import bounded_batches, durable, shared_folder

#: Where the public tokenizers' files are.
TOKENIZERS = Path("/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; a document labelled as low quality weighs a quarter."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    weight = F.when(F.col("quality") == 0, 0.25).otherwise(1.0)
    mixed = mixing.mix(sized.join(labels, "doc_id", "left"), size=F.col("size"), quality=weight)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


OP1_SQL = r"""
WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN q.quality = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents d LEFT JOIN q USING (doc_id)),
k AS (SELECT *, -ln((('0x' || substr(md5('17:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0::DOUBLE) / w AS key FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, source_size * 3 AS cap, source_size * 3 / w AS ratio FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
lvl AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM lvl) * w) AS target FROM l),
a AS (
  SELECT k.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.size, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN ahead + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END))::BIGINT AS taken, source
FROM a
"""


def op3_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as MPEG audio and read back."""
    return mpeg.store_texts(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.9 or more."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT g.doc_id, any_value(len(g.g))::BIGINT AS n_shingles, min(r.b) AS component_id FROM g JOIN reach r ON g.doc_id = r.a GROUP BY g.doc_id
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, from a classifier fitted on labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "guessed_lang")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_piece_fst(spark: SparkSession, sf_dir: str, model: Path = TOKENIZERS / "piece_bpe_32k.model") -> DataFrame:
    """The SentencePiece encoding of every document, decoded again."""
    return piece_fst.encode_texts(table(spark, sf_dir, "documents"), model.read_bytes())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, exactly or nearly, an earlier line."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document between the benchmark's model and that of all documents."""
    scored = lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.withColumn("score", F.round("score", 6))


OP9_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
l AS (SELECT r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
x AS MATERIALIZED (SELECT r, own, unnest(w) AS w, unnest(list_concat([' '], w[:-2])) AS u FROM l WHERE len(w) > 0),
g AS (SELECT r, own, u, w, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT r, own, u, NULL, count(*) FROM x GROUP BY r, own, u),
c AS (SELECT u, w, coalesce(sum(n) FILTER (own), 0) AS b, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM g GROUP BY u, w),
s AS (SELECT count(DISTINCT w)::DOUBLE AS v, coalesce(count(*) FILTER (own) / nullif(count(*) FILTER (NOT own), 0), 1.0)::DOUBLE AS m FROM x),
e AS (
  SELECT g.r, sum(g.n * CASE WHEN g.w IS NULL THEN ln(c.t * s.m + 0.1 * s.v) - ln(c.b - g.n + 0.1 * s.v) ELSE ln(c.b - g.n + 0.1) - ln(c.t * s.m + 0.1) END) AS loss
  FROM g JOIN c ON g.u = c.u AND g.w IS NOT DISTINCT FROM c.w, s WHERE g.own GROUP BY g.r)
SELECT l.doc_id, len(l.w)::BIGINT AS n_tokens, round(e.loss / len(l.w), 6) AS score FROM l LEFT JOIN e USING (r) WHERE l.own
"""


def op11_lang_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from centroids of those whose id's checksum leaves no rest of 2 by 4."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = lang_id.fit(docs.where(~held_out), order=F.col("doc_id"))
    return lang_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two or three words of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
x AS MATERIALIZED (SELECT lang, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM w WHERE len(w) > 0),
f1 AS MATERIALIZED (SELECT lang, a AS p, count(*)::HUGEINT AS f FROM x GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, a, b, a || ' ' || b AS p, count(*)::HUGEINT AS f FROM x WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, a, b, c, a || ' ' || b || ' ' || c AS p, count(*)::HUGEINT AS f FROM x WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cut AS (
  SELECT lang, p, f, 1 AS k, a AS lp, b AS rp FROM f2 UNION ALL SELECT lang, p, f, 1, a, b || ' ' || c FROM f3 UNION ALL SELECT lang, p, f, 2, a || ' ' || b, c FROM f3),
f AS (SELECT lang, p, f FROM f1 UNION ALL SELECT lang, p, f FROM f2),
s AS (SELECT cut.lang, cut.p, cut.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * cut.f * cut.f) // (l.f * r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.p = cut.lp JOIN f r ON r.lang = cut.lang AND r.p = cut.rp),
o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, p, max(f) AS f FROM (SELECT lang, a || ' ' || b AS p, f FROM f3 UNION ALL SELECT lang, b || ' ' || c, f FROM f3) GROUP BY lang, p),
kept AS (SELECT o.* FROM o LEFT JOIN longer g ON g.lang = o.lang AND g.p = o.p WHERE g.f IS NULL OR 100 * g.f < 50 * o.a),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT t.lang, t.rank, t.p AS phrase, t.a::BIGINT AS a, t.l::BIGINT AS l, t.r::BIGINT AS r, n.n, t.score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for every item of the benchmark."""
    return ranked.search(ranked.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
x AS MATERIALIZED (SELECT r, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM r),
s AS (SELECT count(DISTINCT r)::HUGEINT AS n, count(*)::HUGEINT AS l FROM x),
d AS (SELECT r, any_value(doc_id) AS doc_id, 100 - 75 + ((75 * count(*)::HUGEINT * (SELECT n FROM s)) // (SELECT l FROM s)) AS m FROM x GROUP BY r),
tf AS MATERIALIZED (SELECT r, w, count(*)::BIGINT AS tf FROM x GROUP BY r, w),
w AS (SELECT w, floor(1000 * ln((2 * (SELECT n FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf GROUP BY w),
b AS (SELECT row_number() OVER () AS b, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
q AS (SELECT b, any_value(item_id) AS item_id, w, count(*) AS q FROM (SELECT b, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM b) GROUP BY b, w),
c AS (
  SELECT b, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, r, sum(q * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (w) JOIN w USING (w) JOIN d USING (r) GROUP BY b, r),
k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
"""


#: Rank files of the byte-pair versions that are counted beside the rule-based ones.
BYTE_PAIR = {"byte-bpe-50k": "byte_bpe_50k.tiktoken"}


def _rollup(spark: SparkSession, sf_dir: str, counts: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Token totals by source, language and tokenizer version after four batches, one of them sent twice.

    All documents are inserted; those labelled toxic are deleted; of those labelled as low quality, and not deleted,
    the first line is cut and the counts are revised.
    """
    store = rollups.RollupStore(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    cut = F.regexp_replace("text", r"^[^\n]*\n", "")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", *[count(text).alias(f"{name}_{k}") for name, text in (("old", F.col("text")), ("new", cut)) for k, count in enumerate(counts.values())])
    bounded_batches(docs)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counted = durable(docs, "counts").join(labels, "doc_id", "left")  # counts are joined, not texts
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.col(f"old_{k}").alias("tokens"), F.col(f"new_{k}").alias("new_tokens")) for k, v in enumerate(counts)]))
    revised = F.coalesce((F.col("quality") == 0) & (F.coalesce("toxic", F.lit(0)) != 1), F.lit(False))
    rows = counted.select("source", "lang", "toxic", revised.alias("revised"), each.alias("e")).select("source", "lang", "toxic", "revised", "e.*")
    store.commit("load", rollups.inserts(rows))
    store.commit("toxic", rollups.deletes(rows.where("toxic = 1")))
    store.commit("cut", rollups.revisions(rows.where("revised")))
    store.compact()
    store.commit("toxic", rollups.deletes(rows.where("toxic = 1")))
    return store.totals()


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the byte-pair tokenizer and of the rule-based ones."""
    counts = {v: functools.partial(rollups.count, tokenizer=v) for v in rollups.TOKENIZERS}
    return _rollup(spark, sf_dir, counts | {v: rollups.bpe_count(TOKENIZERS / file) for v, file in BYTE_PAIR.items()})


def rollup_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches counted by the rule-based versions alone, which SQL can count too."""
    return _rollup(spark, sf_dir, {v: functools.partial(rollups.count, tokenizer=v) for v in rollups.TOKENIZERS})


ROLLUP_SQL = r"""
WITH l AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.source, d.lang, CASE WHEN l.quality = 0 THEN regexp_replace(coalesce(d.text, ''), '^[^\n]*\n', '') ELSE coalesce(d.text, '') END AS text
  FROM documents d LEFT JOIN l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic <> 1)
SELECT source, lang, 'space-1' AS tokenizer, count(*)::BIGINT AS n_docs, sum(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))::BIGINT AS n_tokens FROM d GROUP BY source, lang
UNION ALL
SELECT source, lang, 'split-1', count(*)::BIGINT, sum(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]')))::BIGINT FROM d GROUP BY source, lang
"""


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95 or more."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = r"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mix_sources": op1_mix_sources, "op2_ngram_join": op2_ngram_join, "op3_mpeg_audio": op3_mpeg_audio, "op4_toxicity": op4_toxicity, "op5_token_rollup": op5_token_rollup, "rollup_by_rule": rollup_by_rule, "op6_embedding_dedup": op6_embedding_dedup, "op7_html_text": op7_html_text, "op8_line_dedup": op8_line_dedup, "op9_lm_score": op9_lm_score, "op10_piece_fst": op10_piece_fst, "op11_lang_centroid": op11_lang_centroid, "op12_phrases": op12_phrases, "op13_ranked_search": op13_ranked_search}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_ngram_join": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "op9_lm_score": OP9_SQL, "op12_phrases": OP12_SQL, "op13_ranked_search": OP13_SQL, "rollup_by_rule": ROLLUP_SQL}
