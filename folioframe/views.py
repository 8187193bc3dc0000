"""Registered queries of the smaller operators: gates, cells, labels, joins by key, page measures; with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import STRIP, query, table
from .functions import text as tx
from .functions.tokens import CJK
from .operators import grid, layout, tree
from .plans import catalog, dataset, keyed, stats
from .shared import shared_folder
from .sources import files

# ---------------------------------------------------------------- files


@query("""WITH f AS (SELECT doc_id, ['docx', 'pptx', 'xlsx', 'pdf', 'doc', 'txt', 'exe', ''][doc_id % 8 + 1] AS ext, CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 17 = 0 THEN 524288001 ELSE n_chars END AS size FROM documents)
    SELECT doc_id, ext, CASE WHEN ext NOT IN ('docx', 'pptx', 'xlsx', 'pdf', 'doc', 'ppt', 'xls') THEN 'E03' WHEN size = 0 OR size > 524288000 THEN 'E05' WHEN ext NOT IN ('docx', 'pptx', 'xlsx') THEN 'E03' ELSE 'ok' END AS code FROM f""")
def file_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (documents stand in for them) and why they are not taken."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("docx", "pptx", "xlsx", "pdf", "doc", "txt", "exe", "")]), (F.col("doc_id") % 8 + 1).cast("int"))
    size = F.when(F.col("doc_id") % 13 == 0, 0).when(F.col("doc_id") % 17 == 0, files.LARGEST + 1).otherwise(F.col("n_chars"))
    listed = table(spark, sf_dir, "documents").select("doc_id", ext.alias("ext"), size.alias("size"))
    return files.gated(listed).select("doc_id", "ext", F.coalesce("code", F.lit("ok")).alias("code"))


@query("SELECT source AS folder, doc_id::INTEGER AS page FROM documents WHERE doc_id % 3 > 0")
def page_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of pages among files."""
    name = F.concat(F.element_at(F.array(F.lit("q"), F.lit("p"), F.lit("p")), (F.col("doc_id") % 3 + 1).cast("int")), "doc_id", F.lit(".png"))
    listed = table(spark, sf_dir, "documents").select(name.alias("name"), F.concat(F.lit("file:/pages/"), "source", F.lit("/"), name).alias("path"))
    return files.snapshots(listed).select(F.col("doc_id").alias("folder"), "page")


# ---------------------------------------------------------------- cells and lines


ESCAPED = r"regexp_replace(coalesce(text, ''), '<([A-Za-z/!?])', '&lt;\1', 'g')"


@query(rf"""WITH e AS (SELECT doc_id, {STRIP % rf"replace(replace(replace({ESCAPED}, '|', '\|'), chr(13) || chr(10), chr(10)), chr(10), '<br>')"} AS cell FROM documents)
    SELECT doc_id, length(cell)::INTEGER AS n, md5(cell) AS digest FROM e""")
def markdown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = tx.markdown_cell(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cell).alias("n"), F.md5(cell.cast("binary")).alias("digest"))


@query(rf"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    j AS (SELECT doc_id, list_reduce(l, lambda a, b: CASE WHEN a = '' OR b = '' THEN a || b WHEN right(a, 1) = '-' AND NOT regexp_matches(left(b, 1), '[{CJK}]') THEN left(a, length(a) - 1) || b WHEN regexp_matches(right(a, 1), '[{CJK}]') OR regexp_matches(left(b, 1), '[{CJK}]') THEN a || b ELSE a || ' ' || b END) AS t FROM l)
    SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS digest FROM j""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as one text."""
    text = layout.join_lines(F.split("text", "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query("""SELECT doc_id, CASE WHEN n_chars % 40 >= 10 THEN 'text' WHEN lang = 'en' THEN 'scanned' ELSE 'blank' END AS kind FROM documents""")
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = layout.page_kind(F.col("n_chars") % 40, F.when(F.col("lang") == "en", True))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"))


@query(r"""WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS r FROM documents),
    c AS (SELECT doc_id, r, unnest(string_split(row, '|')) AS t, generate_subscripts(string_split(row, '|'), 1) - 1 AS c FROM r)
    SELECT doc_id, count(*)::BIGINT AS cells, sum(length(trim(t)))::BIGINT AS chars, max(c)::INTEGER AS last, count(*) FILTER (r = 0)::BIGINT AS heads FROM c WHERE trim(t) <> '' GROUP BY doc_id""")
def plain_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at bars as the rows of an extracted table: its cells."""
    rows = F.transform(F.split("text", "\n"), lambda x: F.split(x, r"\|"))
    cells = table(spark, sf_dir, "documents").select("doc_id", F.explode(layout.plain_cells(rows)).alias("c"))
    return cells.groupBy("doc_id").agg(F.count("*").alias("cells"), F.sum(F.length("c.text")).cast("long").alias("chars"), F.max("c.c").alias("last"), F.count_if(F.col("c.is_header")).alias("heads"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber - 1 AS r, bool_or(l_quantity < 30) AS head FROM lineitem GROUP BY ALL)
    SELECT l_orderkey, CASE WHEN NOT coalesce(bool_or(head) FILTER (r = 0), false) THEN 0 WHEN NOT coalesce(bool_or(head) FILTER (r = 1), false) THEN 1 WHEN NOT coalesce(bool_or(head) FILTER (r = 2), false) THEN 2 ELSE 3 END AS heads FROM h GROUP BY l_orderkey""")
def header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leading rows of each order's lines that hold a head cell (a small quantity)."""
    cell = F.struct((F.col("l_linenumber") - 1).cast("int").alias("r"), (F.col("l_quantity") < 30).alias("is_header"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(grid.header_rows(F.collect_list(cell)).alias("heads"))


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS r0, l_linenumber + l_quantity::INTEGER % 5 AS r1, l_partkey::INTEGER % 6 AS c0, l_partkey::INTEGER % 6 + l_suppkey::INTEGER % 4 AS c1 FROM lineitem)
    SELECT k AS l_orderkey, r0, c0, least(r1, 4) - r0 + 1 AS rowspan, least(c1, 5) - c0 + 1 AS colspan FROM m WHERE r0 BETWEEN 2 AND 4 AND c0 BETWEEN 1 AND 5""")
def merge_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged ranges, one a line, held to a region of each order's sheet."""
    as_int = lambda c: F.col(c).cast("int")
    merges = table(spark, sf_dir, "lineitem").select("l_orderkey", as_int("l_linenumber").alias("r0"), (as_int("l_linenumber") + F.round("l_quantity").cast("int") % 5).alias("r1"), (as_int("l_partkey") % 6).alias("c0"), (as_int("l_partkey") % 6 + as_int("l_suppkey") % 4).alias("c1"))
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("top"), F.lit(4).alias("bottom"), F.lit(1).alias("left"), F.lit(5).alias("right"))
    return grid.clip_spans(merges, found, ["l_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber WHEN 1 THEN l_returnflag WHEN 2 THEN strftime(DATE '1899-12-30' + l_quantity::INTEGER + 2, '%Y-%m-%d') WHEN 3 THEN CASE WHEN l_discount > 0 THEN 'TRUE' ELSE 'FALSE' END
    WHEN 4 THEN coalesce(map {0: '#NULL!', 7: '#DIV/0!', 15: '#VALUE!', 23: '#REF!', 29: '#NAME?', 36: '#NUM!', 42: '#N/A'}[l_quantity::INTEGER], '#N/A') WHEN 5 THEN (l_quantity::INTEGER)::VARCHAR ELSE '' END AS shown FROM lineitem""")
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cells of each kind show: text, dates from day numbers, truths, errors, numbers."""
    line = F.col("l_linenumber")
    kind = F.when(line == 1, "text").when(line == 2, "date").when(line == 3, "bool").when(line == 4, "error").when(line == 5, "number").otherwise("blank")
    number = F.when(line == 2, F.round("l_quantity") + 2).when(line == 3, F.col("l_discount")).otherwise(F.round("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", grid.cell_value(kind, number.cast("double"), F.col("l_returnflag")).alias("shown"))


# ---------------------------------------------------------------- labels for people


@query("""WITH e AS (SELECT event_id, value, floor(value) * 100 AS ms, props FROM events)
    SELECT event_id, CASE WHEN ms < 1000 THEN (ms::BIGINT)::VARCHAR || 'ms' WHEN ms / 1000 < 60 THEN printf('%.1fs', ms / 1000) ELSE (floor(ms / 60000)::BIGINT)::VARCHAR || 'm' || (floor((ms / 1000) % 60 + 0.5)::BIGINT)::VARCHAR || 's' END AS span,
      CASE WHEN event_id % 5 = 0 THEN '—' WHEN event_id % 101 <= 1 THEN (event_id % 101 * 100)::VARCHAR || '%' ELSE (event_id % 101)::VARCHAR || '%' END AS share,
      CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 301 - 100 <= 1 THEN greatest((event_id % 301 - 100) * 100, 0)::DOUBLE ELSE least(event_id % 301 - 100, 100)::DOUBLE END AS progress,
      CASE WHEN length(props) > 6 THEN left(props, 6) || '…' ELSE props END AS short FROM e""")
def people_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, shares, progress and shortened texts as people read them."""
    known = lambda c: F.when(F.col("event_id") % 5 != 0, c)
    return table(spark, sf_dir, "events").select(
        "event_id", tx.milliseconds_label(F.floor("value") * 100).alias("span"), tx.percent_label(known(F.col("event_id") % 101)).alias("share"),
        tx.progress_value(known(F.col("event_id") % 301 - 100)).alias("progress"), tx.shortened(F.col("props"), 6).alias("short"),
    )


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS docs, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'F') / count(*)::DOUBLE AS cover FROM orders GROUP BY 1)
    SELECT day::VARCHAR AS day, greatest(done, docs)::BIGINT AS imported, cover * 100 AS text_coverage, (floor(docs * 100 * 1.7 / 50 + 0.5) * 50)::BIGINT AS characters FROM d""")
def trend_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a trend as they are shown."""
    done = F.count_if(F.col("o_orderstatus") == "F")
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("docs_created"), done.alias("imported"), (done / F.count("*")).alias("text_coverage"))
    return stats.trend_view(days).select(F.col("day").cast("string").alias("day"), "imported", "text_coverage", stats.characters_label(F.col("docs_created") * 100).cast("long").alias("characters"))


# ---------------------------------------------------------------- catalogue, chunks and nodes


@query("""SELECT doc_id, source FROM documents WHERE CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'failed' END = 'ok' AND source ILIKE '%C1%'""")
def export_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "ok").otherwise("failed").alias("status"))
    return catalog.exportable(docs, "C1", name="source").select("doc_id", "source")


@query("""SELECT doc_id, CASE WHEN n_chars <= 2000 THEN len(string_split(text, chr(10))) END::VARCHAR AS nodes FROM documents""")
def tree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nodes (lines) of stored trees that are small enough to be opened."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("size"), F.split("text", "\n").alias("nodes"))
    return catalog.ir_summary(rows, largest=2000).select("doc_id", F.col("node_count").cast("string").alias("nodes"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'It broke' WHEN 'view' THEN 'It was seen' ELSE 'Unknown' END AS message, CASE event_type WHEN 'error' THEN 'Try again' WHEN 'view' THEN '' ELSE 'Report it' END AS advice FROM events""")
def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    return catalog.decorate_codes(rows, "event_type", {"error": ("It broke", "Try again"), "view": ("It was seen", "")}, ("Unknown", "Report it")).select("event_id", "message", "advice")


@query("""WITH s AS (SELECT source, list_sort(list_distinct(list(lang))) AS l FROM documents GROUP BY source)
    SELECT source, array_to_string(list_filter(l, lambda x: x NOT IN ('en', 'it', 'de')), ',') AS unnamed, array_to_string(list_filter(['en', 'it', 'de'], lambda x: NOT list_contains(l, x)), ',') AS absent FROM s""")
def package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members (languages of a source) that a manifest doesn't name, and names without a member."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("members"))
    unnamed, absent = catalog.missing_members(F.array(F.lit("en"), F.lit("it"), F.lit("de")), F.col("members"))
    return rows.select("source", F.array_join(unnamed, ",").alias("unnamed"), F.array_join(absent, ",").alias("absent"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'failed' END AS event FROM orders WHERE o_orderstatus <> 'O'""")
def closing_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("canceled")
    return catalog.terminal_state(table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")), status="status").select("o_orderkey", "event")


CHUNKS = "SELECT doc_id AS seq, 'c' || doc_id AS id, source AS doc_id, [doc_id % 7, doc_id % 11 + 7] AS node_ids FROM documents"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.alias("seq"), F.concat(F.lit("c"), k).alias("id"), F.col("source").alias("doc_id"), F.array(k % 7, k % 11 + 7).alias("node_ids"))


@query(f"""WITH c AS ({CHUNKS}), n AS (SELECT doc_id, unnest(node_ids) AS node, seq, id FROM c) SELECT doc_id, node, arg_min(id, seq) AS chunk_id FROM n GROUP BY doc_id, node""")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_chunk_of_node(_chunks(spark, sf_dir))


@query(f"""WITH c AS ({CHUNKS}) SELECT id FROM c WHERE list_has_any(node_ids, [3, 9]) AND doc_id <> 'src1'""")
def doubtful_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold a node read with low confidence."""
    sure = F.when(F.col("node").isin(3, 9) & (F.col("doc_id") != "src1"), 0.5).otherwise(0.9)
    nodes = _chunks(spark, sf_dir).select("doc_id", F.explode("node_ids").alias("node")).distinct().select("doc_id", F.col("node").alias("id"), sure.alias("confidence"))
    return tree.low_confidence_chunks(_chunks(spark, sf_dir), nodes).select("id")


@query(f"""WITH c AS ({CHUNKS}) SELECT seq, id, doc_id FROM c WHERE doc_id NOT IN ('src1', 'src2') UNION ALL SELECT -seq, 'n' || seq, doc_id FROM c WHERE doc_id IN ('src1', 'src2') AND seq % 3 = 0""")
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of two documents replaced by new ones."""
    base = _chunks(spark, sf_dir).select("seq", "id", "doc_id")
    fresh = base.where(F.col("doc_id").isin("src1", "src2") & (F.col("seq") % 3 == 0)).select((-F.col("seq")).alias("seq"), F.concat(F.lit("n"), "seq").alias("id"), "doc_id")
    return catalog.replace_documents(base, fresh)


NODES = """SELECT l_orderkey AS doc_id, l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'R' THEN 'paragraph' ELSE 'heading' END AS type, l_quantity > 40 AS ocr, [l_linenumber, l_linenumber + 1] AS pages FROM lineitem"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "R", "paragraph").otherwise("heading")
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), line.alias("id"), kind.alias("type"), F.struct((F.col("l_quantity") > 40).alias("ocr")).alias("content"), F.array(line, line + 1).alias("pages"))


@query(f"SELECT doc_id, type, count(*)::BIGINT AS nodes FROM ({NODES}) GROUP BY doc_id, type")
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.type_counts(_nodes(spark, sf_dir))


@query(f"""WITH n AS ({NODES}), p AS (SELECT doc_id, id, type, ocr, unnest(pages) AS page FROM n)
    SELECT doc_id, max(page)::BIGINT AS pages, count(DISTINCT page) FILTER (ocr)::BIGINT AS ocr_pages, count(DISTINCT id)::BIGINT AS nodes, max(CASE WHEN type = 'table' THEN 1.0 END)::VARCHAR AS table_confidence FROM p GROUP BY doc_id""")
def page_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, pages read by OCR, nodes and table confidence of each document."""
    found = tree.page_metrics(_nodes(spark, sf_dir))
    return found.select("doc_id", F.col("pages").cast("long").alias("pages"), "ocr_pages", "nodes", F.col("table_confidence").cast("string").alias("table_confidence"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 'renamed ' || c_custkey ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_custkey % 50 <> 11
    UNION ALL SELECT -c_custkey, 'new', 0.0 FROM customer WHERE c_custkey % 100 = 3""")
def stored_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stored by key, after rows were changed, added and taken out, each in its own part."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    stored = keyed.store_keyed(rows, f"{shared_folder(spark, 'keyed')}/customer", ["c_custkey"], parts=8)
    renamed = rows.where("c_custkey % 50 = 7").select("c_custkey", F.concat(F.lit("renamed "), "c_custkey").alias("c_name"), "c_acctbal")
    stored.upsert(renamed.union(rows.where("c_custkey % 100 = 3").select(-F.col("c_custkey"), F.lit("new"), F.lit(0.0))))
    stored.delete(rows.where("c_custkey % 50 = 11").select("c_custkey"))
    return stored.rows()


# ---------------------------------------------------------------- pairs


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(10) || '| Name | ' || lang || ' ||' || chr(10) || text WHEN 1 THEN '|---|:-:|' || chr(10) || text ELSE text END AS text FROM documents),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1] AS line FROM t),
    c AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(line), '^\|+|\|+$', '', 'g'), '|'), lambda x: trim(x)), lambda x: x <> '') AS c, regexp_matches(line, '^\s*\|.*\|\s*$') AND NOT regexp_matches(line, '^\s*\|?[\s:|-]+\|?\s*$') AS is_row FROM l)
    SELECT doc_id, CASE WHEN is_row THEN len(c) ELSE 0 END::INTEGER AS n, CASE WHEN is_row THEN array_to_string(c, '/') ELSE '' END AS names FROM c""")
def table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a first line that is a row of a table; a third of the documents get one, a third a rule."""
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n| Name | "), "lang", F.lit(" ||\n"))).when(F.col("doc_id") % 3 == 1, "|---|:-:|\n").otherwise("")
    text = F.concat(head, "text")
    found = dataset.table_columns(text)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n"), F.array_join(found, "/").alias("names"))


@query("""WITH r AS (SELECT doc_id, lang, source, unnest([1, 2]) AS k FROM documents) SELECT doc_id, CASE k WHEN 1 THEN 'What is ' || source || '?' ELSE 'Which language?' END AS question, CASE k WHEN 1 THEN 'A source.' ELSE lang END AS answer, 'model' AS generated_by FROM r WHERE k = 1 OR doc_id % 2 = 0""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in a model's replies, in which other words stand around a list of them, some without a question."""
    first = F.format_string('{"question": "  What is %s? ", "answer": "A source. "}', "source")
    second = F.when(F.col("doc_id") % 2 == 0, F.format_string('{"question": "Which language?", "answer": "%s"}', "lang")).otherwise(F.lit('{"question": " ", "answer": "no"}'))
    reply = F.concat(F.lit("Here they are:\n["), first, F.lit(", null, "), second, F.lit(', {"question": "one too many", "answer": ""}]\nDone.'))
    limit = F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)
    rows = table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"), limit.alias("most"))
    both = dataset.model_pairs(rows.where("most = 2"), reply="reply", n=2).union(dataset.model_pairs(rows.where("most = 1"), reply="reply", n=1))
    return both.select("doc_id", "question", "answer", "generated_by")
