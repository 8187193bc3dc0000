"""From raw documents to token ids: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import line_dedup, mixing, ngram_join, piece_fst, toxicity
from folioframe.llm.registry import TOKENIZERS
from folioframe.llm.mixing import WORD
from folioframe.llm.storage import durable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, does not reject.

    Texts without words, null ones too, hold nothing toxic and stay, whatever the model's bias is. Repeated rows share a
    fate; an empty table gives an empty table. All columns are kept, whatever their names.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # names of the score's columns can't clash with these
    rows = docs.select(*[docs[c].alias(n) for c, n in names.items()])
    scored = toxicity.score(rows, model, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    worded = F.coalesce(F.regexp_like(names["text"], F.lit(WORD)), F.lit(False))
    return scored.where((F.col("predicted") == 0) | ~worded).select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, exactly or nearly, an earlier line.

    No document goes; one whose lines all repeat is left without words, for the next stage to judge. n_chars follows
    the text; null texts keep theirs. Repeated rows lose the same lines.
    """
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    Documents without words, such as copies that lost every line, are one group: that of the least id stays. Rows are
    told apart by id and text, so unrelated texts that share an id, or have none, stay.
    """
    worded = F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    blank = docs.where(~worded).orderBy(F.col("doc_id").asc_nulls_last(), *[c for c in ("source", "lang") if c in docs.columns]).limit(1)
    return ngram_join.one_of_each_text(docs.where(worded), width=5, percent=80).union(blank)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; one labelled as low quality weighs a quarter, as in op1.

    Null texts have no words and cost no budget. Each row counts, also where rows are equal; null sources are a source.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return mixing.mixed_rows(docs, qualities=labels.select("doc_id", F.when(F.col("quality") == 0, 0.25).otherwise(1.0)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece numbers of every document; null texts have null ids, repeated rows are encoded each."""
    return piece_fst.encode_texts(docs, (TOKENIZERS / "piece_bpe_32k.model").read_bytes())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("piece_encoding", encode),
]

#: A trained classifier and an encoder have no SQL; tests hold each stage against plain Python on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before it kept is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
