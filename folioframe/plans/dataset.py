"""Question-answer pairs and training records from chunks, in columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import heading_tail, strip

# Instructions in rotation, the name of a nameless document.
BLANK_INSTRUCTIONS = (
    "请阅读以下内容，并回答与之相关的问题。",
    "请根据以下内容，提炼其中的关键信息。",
    "请依据以下内容作答，不要引入内容之外的信息。",
    "请阅读以下资料，并用简洁的语言总结要点。",
)
THIS_DOCUMENT = "本文档"
TABLE_LINE, TABLE_RULE = r"^\s*\|.*\|\s*$", r"^\s*\|[\s:\-|]+\|\s*$"
CONTEXT_LIMIT = 4000
PAIR = ("doc_id", "chunk_id", "heading_path", "question", "answer", "context", "generated_by")


def one_granularity(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each document's parents if it has any, else its children, else all: no passage appears twice.

    Which it is takes one small row a document, so a long document isn't sorted for it.
    """
    has = chunks.groupBy(doc).agg(F.max(F.when(F.col("kind") == "parent", 2).when(F.col("kind") == "child", 1).otherwise(0)).alias("__best"))
    rank = F.when(F.col("kind") == "parent", 2).when(F.col("kind") == "child", 1).otherwise(0)
    return chunks.join(has, doc).where((F.col("__best") == 0) | (rank == F.col("__best"))).drop("__best")


def table_columns(text: Column) -> Column:
    """Names in the first non-blank line if it is a row of a Markdown table, else none."""
    line = F.get(F.filter(F.split(text, "\r\n|[\n\r]"), lambda x: strip(x) != ""), F.lit(0))
    cells = F.filter(F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip), lambda x: x != "")
    return F.when(line.rlike(TABLE_LINE) & ~line.rlike(TABLE_RULE), cells).otherwise(F.array().cast("array<string>"))


def rule_questions(kind: Column, path: Column, text: Column, name: Column, n: int) -> Column:
    """Questions that the chunk's place answers, first come first, at most n."""
    topic = heading_tail(path)
    named = topic != ""
    about = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    table = F.concat(
        F.array(about("《", name, "》中", F.when(named, about("「", topic, "」的表格")).otherwise("文中的表格"), "包含哪些内容？")),
        F.transform(F.slice(table_columns(text), 1, n), lambda c: about("表中「", c, "」这一列有哪些取值？")),
    )
    general = F.when(named, F.array(about("「", topic, "」这一节讲了什么？"), about("请简要介绍《", name, "》中「", topic, "」的主要内容。"))).otherwise(F.array(about("《", name, "》的这部分内容讲了什么？")))
    return F.slice(F.array_distinct(F.concat(F.when(kind == "table", table).otherwise(F.array().cast("array<string>")), general)), 1, n)


def build_pairs(chunks: DataFrame, docs: DataFrame | None = None, *, mode: str = "blank", per_chunk: int = 1, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """Pairs of one granularity: `rule` asks what the structure answers with the text, anything else leaves answers blank."""
    n = max(1, int(per_chunk or 1))
    rows = one_granularity(chunks)
    if docs is not None:
        names = docs.select(F.col("doc_id").cast("string").alias("__doc"), F.col(name_col).alias("__name"))
        rows = rows.join(names, F.col("doc_id").cast("string") == F.col("__doc"), "left")
    else:
        rows = rows.withColumn("__name", F.lit(None).cast("string"))
    name = F.coalesce(F.when(F.col("__name") != "", F.col("__name")), F.lit(THIS_DOCUMENT))
    text = strip(F.coalesce("text", F.lit("")))
    empty = F.lit("")
    if mode == "rule":
        asked = F.explode(rule_questions(F.col("type"), F.col("heading_path"), F.coalesce("text", F.lit("")), name, n))
        answer, context = text, empty
    else:
        mode, answer, context = "blank", empty, text
        asked = F.explode(F.array(*[F.lit(BLANK_INSTRUCTIONS[i % len(BLANK_INSTRUCTIONS)]) for i in range(n)]))
    return rows.where(text != "").select(
        F.coalesce(F.col("doc_id").cast("string"), empty).alias("doc_id"), F.coalesce(id_col, empty).alias("chunk_id"), F.coalesce("heading_path", empty).alias("heading_path"),
        asked.alias("question"), answer.alias("answer"), context.alias("context"), F.lit(mode).alias("generated_by"),
    )


def _metadata() -> Column:
    return F.struct("doc_id", "chunk_id", "heading_path", "generated_by").alias("metadata")


def alpaca(pairs: DataFrame) -> DataFrame:
    """Instruction records."""
    return pairs.select(F.col("question").alias("instruction"), F.col("context").alias("input"), F.col("answer").alias("output"), _metadata())


def sharegpt(pairs: DataFrame) -> DataFrame:
    """Conversations of two turns; what there is to read goes into the first."""
    human = F.when(F.col("context") != "", F.concat("question", F.lit("\n\n参考内容："), "context")).otherwise(F.col("question"))
    turn = lambda who, value: F.struct(F.lit(who).alias("from"), value.alias("value"))
    return pairs.select(F.array(turn("human", human), turn("gpt", F.col("answer"))).alias("conversations"), _metadata())


def conversations(turns: DataFrame, *, key: str, order: str, role: str, text: str, roles: dict[str, str]) -> DataFrame:
    """Chat turns as one record a conversation, turns in order; roles are renamed, others kept as they are.

    A conversation's turns meet in one row, as the record needs; that bounds it, not the number of conversations.
    """
    names = F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])
    turn = F.struct(F.col(order).alias("n"), F.coalesce(names[F.col(role)], F.col(role)).alias("from"), F.coalesce(text, F.lit("")).alias("value"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("t")).select(key, F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def model_pairs(replies: DataFrame, *, reply: str, n: int) -> DataFrame:
    """Pairs from a model's replies: the JSON array between the first [ and the last ], items with a question, at most n."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), "array<struct<question:string,answer:string>>")
    good = F.filter(found, lambda x: x.isNotNull() & (strip(F.coalesce(x["question"], F.lit(""))) != ""))
    rest = [c for c in replies.columns if c not in (reply, "question", "answer", "generated_by")]
    picked = replies.select(*rest, F.explode(F.slice(good, 1, n)).alias("__p"))
    return picked.select(*rest, strip(F.col("__p.question")).alias("question"), strip(F.coalesce("__p.answer", F.lit(""))).alias("answer"), F.lit("model").alias("generated_by"))


def document_ids(ids: Sequence[object]) -> list[str]:
    """Ids trimmed, blanks out, first mention kept; none is an error."""
    out = list(dict.fromkeys(s for s in (str(i).strip() for i in ids if i is not None) if s))
    if not out:
        raise ValueError("E03: no documents named")
    return out
