"""The registered queries of the library itself, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.tokens import CJK, LETTER, RUN, SPACE, estimate_tokens
from .operators import grid, layout, tour, tree
from .plans import catalog, chunking, dataset, paged, render, stats
from .plans.packing import Options
from .shared import shared_folder
from .sources import files, markup, office_writer
from .streaming import events, stateful

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with SQL if there is any."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


COST = rf"CASE WHEN regexp_matches(r, '^[{CJK}]') THEN len(r) WHEN regexp_matches(r, '^[0-9]') THEN (len(r) + 2) // 3 WHEN regexp_matches(r, '^[{LETTER}]') THEN (len(r) + 3) // 4 WHEN r[1] = chr(10) THEN 1 ELSE len(r) END"
TOKENS = rf"coalesce(list_sum([{COST} FOR r IN regexp_extract_all(coalesce(text, ''), '{RUN}')]), 0)::BIGINT"
STRIP = rf"regexp_replace(%s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"

# ---------------------------------------------------------------- text functions


@query(f"SELECT doc_id, {TOKENS} AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query(rf"""SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[{SPACE}]+', '', 'g'))::BIGINT AS visible,
    CASE WHEN n_chars = 0 THEN 1.0 ELSE least(1.0, length(regexp_replace(coalesce(text, ''), '[{SPACE}]+', '', 'g')) / n_chars::DOUBLE) END AS coverage FROM documents""")
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible characters, and their share of a stated count: 1 at most, 1 for none, null for no statement."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.visible_chars(F.col("text")).alias("visible"), tree.coverage(tx.visible_chars(F.col("text")), F.col("n_chars")).alias("coverage"))


@query("SELECT doc_id, sha256(text) AS hash, length(text)::BIGINT AS size FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.length("text").cast("long").alias("size"))


@query("SELECT doc_id, (lag(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id))::VARCHAR AS duplicate_of FROM documents")
def duplicate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return catalog.earlier_duplicate(docs, content="hash", order=["doc_id"], id_col="doc_id").select("doc_id", F.col("duplicate_of").cast("string").alias("duplicate_of"))


@query(rf"""WITH b AS (SELECT doc_id, regexp_split_to_array(text, '\n[{SPACE}]*\n') AS b FROM documents),
    p AS (SELECT doc_id, [array_to_string([x FOR x IN [{STRIP % 'l'} FOR l IN string_split(q, chr(10))] IF x <> ''], ' ') FOR q IN b] AS p FROM b)
    SELECT doc_id, len([x FOR x IN p IF x <> ''])::INTEGER AS n, array_to_string([x FOR x IN p IF x <> ''], chr(10)) AS joined FROM p""")
def blank_line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.paragraphs(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").alias("n"), F.array_join("p", "\n").alias("joined"))


# RE2 has no look-ahead: newlines after an end are taken along, and blank pieces are joined to the piece before by running numbers.
SENTENCES = rf"""WITH m AS (SELECT doc_id, regexp_replace(text, '([。！？；…]+[」』”’）】》]*[ \t]*)|([.!?;]+[")\]'']*)(?:([ \t]+)|(\n+)|$)|(\n+)', '\1\2\3\4\5' || chr(1114110), 'g') AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(string_split(t, chr(1114110))) AS p, generate_subscripts(string_split(t, chr(1114110)), 1) AS k FROM m),
    q AS (SELECT *, sum(CASE WHEN regexp_matches(p, '^[{SPACE}]*$') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM p WHERE p <> ''),
    s AS (SELECT doc_id, g, string_agg(p, '' ORDER BY k) AS sentence FROM q GROUP BY doc_id, g)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS n, sentence FROM s"""


@query(SENTENCES)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("n", "sentence"))


NO_FILE = r"""regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g')"""


@query(rf"""WITH s AS (SELECT page_id, regexp_replace({STRIP % NO_FILE}, '[ .]+$', '') AS a FROM pages),
    t AS (SELECT page_id, CASE WHEN length(a) > 100 THEN regexp_replace(substr(a, 1, 100), '[ .]+$', '') ELSE a END AS a FROM s)
    SELECT page_id, CASE WHEN a = '' THEN '未命名' WHEN regexp_matches(upper(split_part(a, '.', 1)), '^(CON|PRN|AUX|NUL|(COM|LPT)[1-9])$') THEN '_' || a ELSE a END AS name FROM t""")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_filename(F.col("url")).alias("name"))


@query(r"SELECT page_id, length(regexp_replace(html, '<([A-Za-z/!?])', '&lt;\1', 'g'))::INTEGER AS n, md5(regexp_replace(html, '<([A-Za-z/!?])', '&lt;\1', 'g')) AS digest FROM pages")
def escape_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tx.escape_tags(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(out).alias("n"), F.md5(out.cast("binary")).alias("digest"))


@query(r"""WITH p AS (SELECT page_id, [x FOR x IN string_split(replace(url, '\', '/'), '/') IF x NOT IN ('', '.', '..')] AS p FROM pages),
    q AS (SELECT page_id, CASE WHEN p[1] = 'assets' THEN p[2:] ELSE p END AS p FROM p)
    SELECT page_id, CASE WHEN len(p) > 0 THEN 'assets/' || array_to_string(p, '/') ELSE '' END AS ref FROM q""")
def image_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.image_ref(F.col("url")).alias("ref"))


@query("""SELECT event_id, CASE WHEN json_type(props) = 'ARRAY' THEN json_array_length(props)::INTEGER WHEN trim(props) = '' OR props IS NULL THEN 0 ELSE 1 END AS n FROM events""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.size(tx.json_list(F.col("props"))).alias("n"))


@query("""WITH l AS (SELECT c_custkey, r_name || '>' || n_name || '>' || c_name AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT c_custkey, p AS path, string_split(p, '>')[-1] AS tail FROM l""")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of containers around a leaf: region, nation, customer."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rows.select("c_custkey", tx.heading_path(F.array("r_name", "n_name", "c_name")).alias("path"))
    return out.withColumn("tail", tx.heading_tail(F.col("path")))


# ---------------------------------------------------------------- chunks and what follows from them


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and children of every document, whole texts, default settings; a Python loop is the test's oracle."""
    docs = table(spark, sf_dir, "documents")
    return chunking.chunk_texts(docs).select("id", "doc_id", "seq", "parent_id", "kind", "type", "text", "token_count", "char_count", "heading_path", "node_ids", "hash")


@query()
def rechunk_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents cut again with a smaller target and more overlap."""
    chunks = chunking.chunk_texts(table(spark, sf_dir, "documents"), options=Options().changed(target=128, hard=256, overlap=0.2))
    return chunks.select("id", "doc_id", "seq", "kind", "token_count", "hash")


@query()
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_texts(table(spark, sf_dir, "documents"))
    return chunks.agg(F.count("*").alias("total"), F.countDistinct("doc_id").alias("docs"), F.avg("token_count").alias("mean_tokens"))


@query(rf"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    c AS MATERIALIZED (SELECT doc_id, i, {TOKENS} AS cost FROM l),
    g AS (SELECT doc_id, i, 0 AS bin, cost AS used, cost FROM c WHERE i = 1 UNION ALL
      SELECT c.doc_id, c.i, g.bin + CASE WHEN g.used + c.cost > 256 THEN 1 ELSE 0 END, CASE WHEN g.used + c.cost > 256 THEN c.cost ELSE g.used + c.cost END, c.cost FROM g JOIN c ON c.doc_id = g.doc_id AND c.i = g.i + 1)
    SELECT doc_id, bin::INTEGER AS bin, (min(i) - 1)::INTEGER AS first, (max(i) - 1)::INTEGER AS last, sum(cost)::BIGINT AS cost FROM g GROUP BY doc_id, bin""")
def greedy_pack_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed greedily to 256 tokens a bin: first line, last line and cost of every bin of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return grid.pack_lines(docs, key="doc_id", lines="lines", budget=256)


def _pseudo_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id"), F.concat(F.lit("c"), F.col("doc_id")).alias("id"), F.when(F.col("doc_id") % 3 == 0, "parent").otherwise("child").alias("kind"), F.lit("text").alias("type"), "text", F.concat(F.col("source"), F.lit(">"), F.col("lang")).alias("heading_path"))


@query(rf"""SELECT doc_id::VARCHAR AS doc_id, 'c' || doc_id AS chunk_id, source || '>' || lang AS heading_path, t.q AS question, '' AS answer, {STRIP % 'text'} AS context, 'blank' AS generated_by
    FROM documents, (VALUES ('请阅读以下内容，并回答与之相关的问题。'), ('请根据以下内容，提炼其中的关键信息。')) t(q) WHERE {STRIP % 'text'} <> ''""")
def blank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.build_pairs(_pseudo_chunks(spark, sf_dir), per_chunk=2)


@query(rf"""SELECT doc_id::VARCHAR AS doc_id, 'c' || doc_id AS chunk_id, source || '>' || lang AS heading_path, unnest(['「' || lang || '」这一节讲了什么？', '请简要介绍《' || source || '》中「' || lang || '」的主要内容。']) AS question,
    {STRIP % 'text'} AS answer, '' AS context, 'rule' AS generated_by FROM documents WHERE {STRIP % 'text'} <> ''""")
def rule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.build_pairs(_pseudo_chunks(spark, sf_dir), table(spark, sf_dir, "documents"), mode="rule", per_chunk=3, name_col="source")


@query(rf"""SELECT '请阅读以下内容，并回答与之相关的问题。' AS instruction, {STRIP % 'text'} AS input, '' AS output, doc_id::VARCHAR AS doc_id, 'blank' AS generated_by FROM documents WHERE {STRIP % 'text'} <> ''""")
def alpaca_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.alpaca(dataset.build_pairs(_pseudo_chunks(spark, sf_dir))).select("instruction", "input", "output", "metadata.doc_id", "metadata.generated_by")


@query(rf"""SELECT doc_id::VARCHAR AS doc_id, 'human' AS first_from, '请阅读以下内容，并回答与之相关的问题。' || chr(10) || chr(10) || '参考内容：' || {STRIP % 'text'} AS first_value, 'gpt' AS second_from FROM documents WHERE {STRIP % 'text'} <> ''""")
def sharegpt_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conversations")
    return dataset.sharegpt(dataset.build_pairs(_pseudo_chunks(spark, sf_dir))).select("metadata.doc_id", c[0]["from"].alias("first_from"), c[0]["value"].alias("first_value"), c[1]["from"].alias("second_from"))


@query("""SELECT conv_id, count(*)::INTEGER AS turns, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, ',' ORDER BY turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, text) AS roles,
    sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id""")
def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dataset.conversations(table(spark, sf_dir, "conversations"), key="conv_id", order="turn", role="role", text="text", roles={"user": "human", "assistant": "gpt"})
    c = F.col("conversations")
    return out.select("conv_id", F.size(c).alias("turns"), F.array_join(F.transform(c, lambda t: t["from"]), ",").alias("roles"), F.aggregate(c, F.lit(0).cast("long"), lambda a, t: a + F.length(t["value"])).alias("chars"))


@query("""WITH k AS (SELECT doc_id % 7 AS d, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'child' WHEN doc_id % 2 = 0 THEN 'parent' ELSE 'child' END AS kind FROM documents)
    SELECT d AS doc, doc_id, kind FROM k WHERE kind = CASE WHEN d = 0 THEN 'child' ELSE 'parent' END""")
def granularity_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 7 == 0, "child").when(F.col("doc_id") % 2 == 0, "parent").otherwise("child")
    return dataset.one_granularity(table(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("doc"), "doc_id", kind.alias("kind")), "doc")


# ---------------------------------------------------------------- tables, trees, regions


@query("""WITH c AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::INTEGER AS r, l_returnflag AS f, CASE WHEN l_quantity > 45 THEN '' ELSE l_linestatus END AS s, l_quantity > 45 AS wide FROM lineitem)
    SELECT l_orderkey, max(r)::INTEGER + 1 AS n_rows, 2 AS n_cols, string_agg(f || ',' || s, ';' ORDER BY r) AS body, bool_or(wide) AS merged FROM c GROUP BY l_orderkey""")
def table_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse cells of each order's lines as a dense grid; the first cell of a line of large quantity spans both columns."""
    lines = grid.numbered(table(spark, sf_dir, "lineitem"), key="l_orderkey", order=["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"])
    wide = F.col("l_quantity") > 45
    cell = lambda c, across, text: F.struct(F.col("r"), F.lit(c).alias("c"), F.lit(1).alias("rowspan"), across.alias("colspan"), F.col(text).alias("text"), F.lit(False).alias("is_header"))
    first, second = cell(0, F.when(wide, 2).otherwise(1), "l_returnflag"), cell(1, F.lit(1), "l_linestatus")
    cells = lines.select("l_orderkey", F.explode(F.when(wide, F.array(first)).otherwise(F.array(first, second))).alias("cell"))
    rows = cells.groupBy("l_orderkey").agg(F.collect_list("cell").alias("cells"))
    out = rows.select("l_orderkey", grid.dense(F.col("cells")).alias("g"), grid.has_merged(F.col("cells")).alias("merged"))
    return out.select("l_orderkey", F.size("g").alias("n_rows"), F.size(F.get("g", F.lit(0))).alias("n_cols"), F.array_join(F.transform("g", lambda r: F.array_join(r, ",")), ";").alias("body"), "merged")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber * 2 + (CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS r, 1 AS k FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber * 2, 3 FROM lineitem WHERE l_discount > 0.05),
    d AS (SELECT DISTINCT l_orderkey, r FROM c), i AS (SELECT *, r - row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS g FROM d),
    j AS (SELECT c.l_orderkey, c.r, c.k, i.g FROM c JOIN i USING (l_orderkey, r)), e AS (SELECT DISTINCT l_orderkey, g, k FROM j),
    f AS (SELECT *, k - row_number() OVER (PARTITION BY l_orderkey, g ORDER BY k) AS h FROM e)
    SELECT j.l_orderkey, min(j.r)::INTEGER AS r0, max(j.r)::INTEGER AS r1, min(j.k)::INTEGER AS c0, max(j.k)::INTEGER AS c1, count(*)::BIGINT AS cells FROM j JOIN f ON j.l_orderkey = f.l_orderkey AND j.g = f.g AND j.k = f.k GROUP BY j.l_orderkey, j.g, f.h""")
def region_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of cells made from lineitem, cut into regions: islands of rows, then islands of the columns they use."""
    li = table(spark, sf_dir, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") * 2 + F.when(F.col("l_quantity") > 40, 1).otherwise(0)).alias("r"), F.lit(1).alias("c"))
    b = li.where("l_discount > 0.05").select("l_orderkey", F.col("l_linenumber") * 2, F.lit(3))
    return grid.regions(a.union(b), key=["l_orderkey"]).groupBy("l_orderkey", "row_island", "col_island").agg(
        F.min("r").cast("int").alias("r0"), F.max("r").cast("int").alias("r1"), F.min("c").cast("int").alias("c0"), F.max("c").cast("int").alias("c1"), F.count("*").alias("cells")
    ).drop("row_island", "col_island")


@query("""WITH h AS (SELECT o_custkey, o_orderkey, (o_orderkey % 4 + 1)::INTEGER AS level FROM orders)
    SELECT a.o_orderkey AS id, a.level, (SELECT max(b.o_orderkey) FROM h b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey < a.o_orderkey AND b.level < a.level)::VARCHAR AS parent FROM h a""")
def section_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings with levels (each customer's orders) and the nearest heading above of a smaller level."""
    heads = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("level"))
    return tree.heading_parents(heads, key="o_custkey", order="id", level="level").select("id", "level", F.col("parent").cast("string").alias("parent"))


@query("""SELECT r_regionkey || ':' || r_name AS id, 1 AS depth, r_name AS path FROM region UNION ALL
    SELECT n_nationkey || ':' || n_name, 2, r_name || '>' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL
    SELECT c_custkey || ':' || c_name, 3, r_name || '>' || n_name || '>' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def container_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root-to-self paths of a tree that is given by parent pointers."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda k, n: F.concat(F.col(k), F.lit(":"), F.col(n))
    regions = t("region").select(name("r_regionkey", "r_name").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"))
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(name("n_nationkey", "n_name"), name("r_regionkey", "r_name"), "n_name")
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(name("c_custkey", "c_name"), name("n_nationkey", "n_name"), "c_name")
    out = tree.chains(regions.union(nations).union(customers), id_col="id", parent_col="parent", label_col="label")
    return out.select("id", F.size("labels").alias("depth"), F.array_join("labels", ">").alias("path"))


# Each customer's orders as a tree: the parent is the nearest order before of a smaller level, children come latest first;
# some parents are missing.
FOREST = """WITH RECURSIVE h AS (SELECT o_custkey AS d, o_orderkey AS id, o_orderkey % 4 + 1 AS level FROM orders),
    n AS (SELECT a.d, a.id, a.level, CASE WHEN a.id % 97 = 0 THEN -1 ELSE (SELECT max(b.id) FROM h b WHERE b.d = a.d AND b.id < a.id AND b.level < a.level) END AS up FROM h a),
    t AS (SELECT d, id, level, [-id] AS path, [id] AS ids FROM n WHERE up IS NULL UNION ALL SELECT n.d, n.id, n.level, list_append(t.path, -n.id), list_append(t.ids, n.id) FROM n JOIN t ON n.d = t.d AND n.up = t.id),
    p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY path) - 1 AS pre, len(path) - 1 AS depth FROM t),
    s AS (SELECT d, id, count(*) AS size FROM (SELECT d, unnest(ids) AS id FROM t) GROUP BY d, id),
    o AS (SELECT n.d, n.id, n.level, row_number() OVER (PARTITION BY n.d ORDER BY -n.id) - 1 + (SELECT count(*) FROM t WHERE t.d = n.d) AS pre FROM n LEFT JOIN t ON n.d = t.d AND n.id = t.id WHERE t.id IS NULL)"""


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("level"))
    nodes = tree.heading_parents(heads, key="o_custkey", order="id", level="level")
    nodes = nodes.withColumn("parent", F.when(F.col("id") % 97 == 0, -1).otherwise(F.col("parent"))).withColumn("turn", -F.col("id"))
    return tour.toured(nodes, doc="o_custkey", id_col="id", parent="parent", order="turn")


@query(FOREST + """ SELECT p.d AS o_custkey, p.id, pre::BIGINT AS pre, (pre + size - 1 - depth)::VARCHAR AS post, depth::VARCHAR AS depth, (pre + size - 1)::BIGINT AS last FROM p JOIN s ON p.d = s.d AND p.id = s.id
    UNION ALL SELECT d, id, pre::BIGINT, NULL, NULL, pre::BIGINT FROM o""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the nodes of a forest in reading order, by leaving, depths and subtrees; orphans last."""
    return _forest(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("post", "depth")})


@query(FOREST + """ SELECT d AS o_custkey, id, list_filter(ids, lambda x: x % 4 + 1 <= 2)[-1]::VARCHAR AS owner FROM p UNION ALL SELECT d, id, CASE WHEN level <= 2 THEN id::VARCHAR END FROM o""")
def subtree_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest node of level 1 or 2 around each node, found by intervals."""
    found = tour.owners(_forest(spark, sf_dir), F.col("id") % 4 + 1 <= 2, doc="o_custkey", id_col="id")
    return found.select("o_custkey", "id", F.col("owner").cast("string").alias("owner"))


@query(FOREST + """ SELECT d AS o_custkey, id FROM p WHERE len(list_filter(ids, lambda x: x % 11 = 0)) = 0 UNION ALL SELECT d, id FROM o WHERE id % 11 <> 0""")
def subtree_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that are neither marked nor below a marked one."""
    return tour.without_subtrees(_forest(spark, sf_dir), F.col("id") % 11 == 0, doc="o_custkey").select("o_custkey", "id")


@query("""WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source, lang)
    SELECT source, arg_max(lang, n * 1000000000000 - first) AS level FROM c GROUP BY source""")
def parse_level_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each group; of equals, the one seen first."""
    return tree.vote(table(spark, sf_dir, "documents"), key="source", value="lang", order="doc_id").withColumnRenamed("lang", "level")


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'warning' WHEN length(d.text) < 500 THEN 'warning' WHEN e.user_id IS NOT NULL THEN 'warning' ELSE 'ok' END AS status
    FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id) LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') e ON d.doc_id = e.user_id""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status from degraded pages, coverage and warnings; labels and events stand in for them."""
    t = lambda n: table(spark, sf_dir, n)
    docs = t("documents").select("doc_id", F.when(F.length("text") < 500, 0.5).otherwise(1.0).alias("coverage")).join(t("labels").groupBy("doc_id").agg(F.max("toxic").alias("degraded")), "doc_id", "left")
    warned = t("events").where("event_type = 'error'").select(F.col("user_id").alias("doc_id"))
    return tree.document_status(docs, warned, key="doc_id", degraded="degraded", coverage="coverage").select("doc_id", "status")


# ---------------------------------------------------------------- catalogue


@query("SELECT p_partkey, p_name FROM part WHERE p_size = 10 AND p_name ILIKE '%a%' ORDER BY p_partkey DESC LIMIT 20 OFFSET 20")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.select_rows(table(spark, sf_dir, "part"), {"p_size": 10, "p_brand": None}, "a", ["p_name"])
    return catalog.page(rows.select("p_partkey", "p_name"), [F.desc("p_partkey")], number=2)


@query("""WITH r AS (SELECT p_partkey, p_name FROM part WHERE p_size < 20) SELECT *, (SELECT count(*) FROM r)::BIGINT AS total FROM r ORDER BY p_partkey LIMIT 50 OFFSET 100""")
def counted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page with the number of rows of all pages."""
    return catalog.page_with_total(table(spark, sf_dir, "part").where("p_size < 20").select("p_partkey", "p_name"), [F.col("p_partkey")], number=3, size=50)


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' AND (props ILIKE '%1%' OR event_type ILIKE '%1%')")
def event_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.select_rows(table(spark, sf_dir, "events"), {"event_type": "error"}, "1", ["props", "event_type"]).select("event_id", "event_type", "user_id")


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders)::BIGINT AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30 OFFSET 870""")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 30 of all orders by price, read from the part that holds it."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    stored = paged.store_pages(rows, shared_folder(spark, "pages"), [F.desc("o_totalprice"), F.asc("o_orderkey")], part_rows=50_000)
    return stored.page(30, 30)


@query("SELECT event_id, event_type, props FROM events WHERE props ILIKE '%: 4_}%' OR event_type ILIKE '%: 4_}%'")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that hold a pattern with a wildcard, from the parts that have its trigrams."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    stored = paged.store_keywords(rows, shared_folder(spark, "keywords"), ["props", "event_type"], [F.asc("props"), F.asc("event_id")], part_rows=20_000)
    return stored.search(": 4_}")


@query("""SELECT doc_id, '{"a":{"lang":"' || lang || '","n":[' || length(text) || ',{"x":' || doc_id || ',"y":null}]},"é":"' || source || '"}' AS canonical FROM documents""")
def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents as nested JSON with unsorted keys, in canonical form."""
    inner = F.struct(F.lit(None).cast("string").alias("y"), F.col("doc_id").alias("x"))
    n = F.format_string('[ %s , %s ]', F.length("text").cast("string"), F.to_json(inner, {"ignoreNullFields": "false"}))
    body = F.format_string('{ "\\u00e9" : "%s",\n "a": { "n" : %s, "lang": "%s" } }', "source", n, "lang")
    return table(spark, sf_dir, "documents").select("doc_id", tx.canonical_json(body).alias("canonical"))


@query("""SELECT source, count(*)::BIGINT AS n, median(length(text))::DOUBLE AS median FROM documents GROUP BY source UNION ALL SELECT NULL, count(*)::BIGINT, median(length(text))::DOUBLE FROM documents""")
def exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of the lengths of texts, by source and over all."""
    rows = table(spark, sf_dir, "documents").select("source", F.length("text").alias("size"))
    whole = stats.exact_medians(rows, "size").select(F.lit(None).cast("string").alias("source"), "n", "median")
    return stats.exact_medians(rows, "size", ["source"]).union(whole)


@query("SELECT c_custkey, c_name, count(o_orderkey)::BIGINT AS chunks FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with the number of rows that belong to it, counted before the join."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("chunks"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], [F.col("event_id")])


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.oldest(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    gone = t("orders").join(t("customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
    return catalog.cascade({"lines": (t("lineitem"), "l_orderkey")}, gone, "o_orderkey")["lines"].select("l_orderkey", "l_linenumber")


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return catalog.patch(base, base.where("s_acctbal < 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")), "s_suppkey")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "nation")
    return catalog.upsert(base, base.where("n_regionkey = 1").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), ["n_nationkey"])


@query("""WITH r AS (SELECT p_partkey, p_name, p_size, sum(p_size) OVER (ORDER BY p_partkey DESC ROWS UNBOUNDED PRECEDING) AS running, row_number() OVER (ORDER BY p_partkey DESC) AS n FROM part)
    SELECT p_partkey, running::BIGINT AS running FROM r WHERE n = 1 OR running <= 500""")
def running_log_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return catalog.within_budget(files, size="p_size", order=[F.desc("p_partkey")], budget=500).select("p_partkey", "running")


@query("""WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY lang, lower(source) ORDER BY doc_id) AS k FROM documents)
    SELECT doc_id, CASE WHEN k > 1 THEN substr(doc_id::VARCHAR, 1, 8) || '-' || source ELSE source END AS file_name FROM n""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unique_names(table(spark, sf_dir, "documents"), folder="lang", name="source", order="doc_id", id_col="doc_id").select("doc_id", "file_name")


# ---------------------------------------------------------------- dashboard


@query("SELECT lang, count(*)::BIGINT AS count, count(*) FILTER (n_chars > 1000)::BIGINT AS recent FROM documents GROUP BY lang")
def format_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(table(spark, sf_dir, "documents"), "lang", F.col("n_chars") > 1000)


@query("SELECT k.event_type, count(e.event_id)::BIGINT AS count FROM (VALUES ('click'), ('error'), ('view'), ('canceled')) k(event_type) LEFT JOIN events e USING (event_type) GROUP BY k.event_type")
def status_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dense_counts(table(spark, sf_dir, "events"), "event_type", ["click", "error", "view", "canceled"])


@query(f"""WITH t AS (SELECT {TOKENS} AS n FROM documents), b AS (SELECT * FROM (VALUES ('0-128', 0, 128), ('128-256', 128, 256), ('256-512', 256, 512), ('512-1024', 512, 1024), ('>=1024', 1024, NULL)) b(bucket, min, max))
    SELECT b.bucket, b.min, b.max::VARCHAR AS max, count(n)::BIGINT AS count FROM b LEFT JOIN t ON n >= b.min AND (b.max IS NULL OR n < b.max) GROUP BY ALL""")
def token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.token_histogram(table(spark, sf_dir, "documents").select(estimate_tokens(F.col("text")).alias("token_count"))).withColumn("max", F.col("max").cast("string"))


@query("SELECT o_custkey, c_name, count(*)::BIGINT AS chunks, sum(o_orderkey)::BIGINT AS tokens FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey, c_name ORDER BY chunks DESC, o_custkey LIMIT 20")
def chunks_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return stats.top_documents(table(spark, sf_dir, "orders"), names, key="o_custkey", name="c_name", tokens="o_orderkey")


@query("SELECT 'E0' || (user_id % 9) AS code, count(*)::BIGINT AS count, CASE WHEN user_id % 9 = 1 THEN '文件损坏' ELSE '发生未知错误' END AS message FROM events WHERE event_type = 'error' GROUP BY ALL ORDER BY count DESC, code LIMIT 5")
def fail_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("level"), F.concat(F.lit("E0"), F.col("user_id") % 9).alias("code"))
    return stats.top_failures(events, {"E01": "文件损坏"})


@query("""WITH n AS (SELECT event_type AS type, value AS ms FROM events ORDER BY event_id DESC LIMIT 2000)
    SELECT type, count(*)::BIGINT AS samples, round_even(avg(ms), 0) AS avg_ms, round_even(quantile_cont(ms, 0.5), 0) AS p50_ms FROM n GROUP BY ROLLUP (type)""")
def duration_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duration_stats(table(spark, sf_dir, "events"), type_col="event_type", ms=F.col("value"), newest=F.col("event_id"))


@query("""WITH d AS (SELECT ts::DATE AS day, count(*) AS imported, count(*) FILTER (event_type = 'error') AS parsed_fail, avg(value) AS mean FROM events WHERE event_type <> 'view' OR day(ts) <> 7 GROUP BY 1)
    SELECT c.day::DATE::VARCHAR AS day, coalesce(imported, 0)::BIGINT AS imported, coalesce(parsed_fail, 0)::BIGINT AS parsed_fail FROM range(DATE '2023-12-20', DATE '2024-02-01', INTERVAL 1 DAY) c(day) LEFT JOIN d ON c.day::DATE = d.day""")
def trend_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where((F.col("event_type") != "view") | (F.dayofmonth("ts") != 7))
    per_day = stats.daily(events, F.to_date("ts"), {"imported": F.lit(1), "parsed_fail": F.when(F.col("event_type") == "error", 1).otherwise(0)})
    return stats.trend(per_day, F.lit("2023-12-20"), F.lit("2024-01-31")).withColumn("day", F.col("day").cast("string"))


@query("SELECT o_orderdate::DATE::VARCHAR AS day, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done FROM orders GROUP BY 1")
def daily_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.daily(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), {"n": F.lit(1), "done": F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)}).withColumn("day", F.col("day").cast("string"))


@query("""WITH r AS (SELECT *, CASE event_type WHEN 'error' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS k FROM events)
    SELECT user_id, (event_id % 3)::VARCHAR AS stage, min(ts) AS started, max(ts) AS ended, count(*)::BIGINT AS events,
      CASE max(k) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS level, CASE WHEN max(k) > 0 THEN 'c' || arg_max(event_id, k * 1000000000000 - event_id) END AS code, min(event_id) AS first_order
    FROM r GROUP BY user_id, event_id % 3""")
def stage_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).cast("string").alias("stage"), "ts", "event_id", level.alias("level"), F.concat(F.lit("c"), F.col("event_id")).alias("code"), F.col("props").alias("message"))
    return stats.stage_timeline(e, key=["user_id"], stage="stage", ts="ts", order="event_id", level="level", code="code", message="message").drop("message")


@query("""WITH d AS (SELECT coalesce(CASE lang WHEN 'en' THEN 'L0' WHEN 'de' THEN 'L1' END, 'unknown') AS level, n_chars FROM documents), c AS (SELECT level, count(*) AS documents, sum(n_chars) AS pages FROM d GROUP BY level),
    k AS (SELECT * FROM (VALUES ('L0'), ('L1'), ('L2'), ('unknown')) k(level)), j AS (SELECT k.level, coalesce(documents, 0)::BIGINT AS documents, coalesce(pages, 0)::BIGINT AS pages FROM k LEFT JOIN c USING (level))
    SELECT level, documents, pages, pages AS count, round_even(pages / (sum(pages) OVER ())::DOUBLE, 4) AS page_ratio FROM j""")
def level_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "L0").when(F.col("lang") == "de", "L1").alias("level"), "n_chars")
    return stats.level_distribution(docs, level="level", pages="n_chars")


@query("""WITH c AS (SELECT count(*)::BIGINT AS chunks_total, count(DISTINCT o_custkey) AS d, avg(o_totalprice) AS m FROM orders), s AS (SELECT count(*)::BIGINT AS docs_total, count(*) FILTER (c_mktsegment IN ('BUILDING')) AS ok, count(*) FILTER (c_mktsegment IN ('BUILDING', 'MACHINERY')) AS p FROM customer)
    SELECT docs_total, round_even(ok / p::DOUBLE, 4) AS success_rate, chunks_total, round_even(round_even(chunks_total / d::DOUBLE, 4), 2) AS avg_chunks_per_doc, round_even(m, 1) AS avg_chunk_tokens FROM c, s""")
def ratio_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "ok").when(F.col("c_mktsegment") == "MACHINERY", "failed").alias("status"))
    chunks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_totalprice").alias("token_count"))
    return stats.cards(docs, chunks)


DOCS = """SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'warning' ELSE 'failed' END AS status, o_orderkey % 40 AS pages, o_orderkey % 3 AS degraded_pages, o_orderkey % 5 AS ocr_pages,
    o_totalprice / 1000000 AS text_coverage, CASE WHEN o_orderkey % 2 = 0 THEN 0.5 END AS table_confidence, NULL::DOUBLE AS ocr_confidence, o_orderdate FROM orders"""


@query(f"""WITH d AS ({DOCS}),
    e AS (SELECT count(*)::BIGINT AS docs_total, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01')::BIGINT AS docs_recent, sum(pages)::BIGINT AS pages_total, sum(degraded_pages)::BIGINT AS degraded_pages, sum(ocr_pages)::BIGINT AS ocr_pages,
      round_even(avg(text_coverage), 4) AS avg_text_coverage, round_even(avg(table_confidence), 4)::DOUBLE AS avg_table_confidence, round_even(avg(ocr_confidence), 4) AS avg_ocr_confidence,
      count(*) FILTER (status <> 'failed') / count(*)::DOUBLE AS good FROM d),
    c AS (SELECT count(*)::BIGINT AS n, count(DISTINCT l_orderkey) AS k, avg(l_quantity) AS m FROM lineitem),
    t AS (SELECT count(*) FILTER (event_type = 'view')::BIGINT AS q, count(*) FILTER (event_type = 'click')::BIGINT AS r, count(*) FILTER (event_type = 'error')::BIGINT AS f, round_even(avg(value) FILTER (event_type NOT IN ('view', 'click')), 0) AS a, round_even(quantile_cont(value, 0.5) FILTER (event_type NOT IN ('view', 'click')), 0) AS p FROM events)
    SELECT docs_total, docs_recent, pages_total, degraded_pages, ocr_pages, avg_text_coverage, avg_table_confidence, avg_ocr_confidence, round_even(good, 4) AS success_rate, n AS chunks_total, round_even(round_even(n / k::DOUBLE, 4), 2) AS avg_chunks_per_doc, round_even(m, 1) AS avg_chunk_tokens,
      q AS tasks_queued, r AS tasks_running, f AS tasks_failed, a AS avg_duration_ms, p AS p50_duration_ms, round_even(ocr_pages / pages_total::DOUBLE, 4) AS ocr_ratio, docs_total AS documents, n AS chunk_total, docs_recent AS imported_7d FROM e, c, t""")
def dashboard_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All headline numbers; orders stand in for documents, order lines for chunks, events for tasks."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "warning").otherwise("failed")
    key = F.col("o_orderkey")
    docs = table(spark, sf_dir, "orders").select(
        status.alias("status"), (key % 40).alias("pages"), (key % 3).alias("degraded_pages"), (key % 5).alias("ocr_pages"), (F.col("o_totalprice") / 1000000).alias("text_coverage"),
        F.when(key % 2 == 0, 0.5).alias("table_confidence"), F.lit(None).cast("double").alias("ocr_confidence"), "o_orderdate",
    )
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("token_count"))
    state = F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    tasks = table(spark, sf_dir, "events").select(state.alias("status"), F.when(~F.col("event_type").isin("view", "click"), F.col("value")).alias("ms"))
    return stats.all_cards(docs, chunks, tasks, F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done FROM orders")
def all_time_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over all days of the daily sums."""
    per_day = stats.daily(table(spark, sf_dir, "orders"), F.to_date("o_orderdate"), {"n": F.lit(1), "done": F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)})
    return stats.all_time(per_day, ["n", "done"])


@query("SELECT 'documents' AS name, count(*)::BIGINT AS rows FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n in ("documents", "events", "orders")]
    return parts[0].union(parts[1]).union(parts[2])


# ---------------------------------------------------------------- rendering


LINES = rf"[x FOR x IN [{STRIP % "regexp_replace(l, '<([A-Za-z/!?])', '&lt;\\1', 'g')"} FOR l IN string_split(text, chr(10))] IF x <> '']"


@query(rf"""WITH d AS (SELECT doc_id, {LINES} AS l FROM documents WHERE len([x FOR x IN string_split(text, chr(10)) IF x <> '']) > 0)
    SELECT doc_id::VARCHAR AS doc_id, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10) || chr(10)) || chr(10) ELSE '' END AS body FROM d""")
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Markdown, from its lines as paragraphs."""
    return render.render_texts(table(spark, sf_dir, "documents"), id_col="doc_id", blocks=F.filter(F.split("text", "\n"), lambda x: x != ""))


# ---------------------------------------------------------------- office files, made from the tables and read back

VISIBLE = rf"regexp_replace(%s, '[{SPACE}\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffe}}\x{{ffff}}]+', '', 'g')"


def _text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("none")).alias("title"), F.split("text", "\n").alias("lines"))
    return office_writer.made(docs, "docx", office_writer.text_document, id_col="doc_id", columns=["title", "lines"])


@query(rf"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, text, [x FOR x IN string_split(text, chr(10)) IF {STRIP % 'x'} <> ''] AS l FROM documents WHERE text IS NOT NULL)
    SELECT doc_id::VARCHAR AS doc_id, 'ok' AS status, 'L0' AS parse_level, 1.0::DOUBLE AS text_coverage, len(l)::BIGINT + 1 AS nodes, length({VISIBLE % "source || text"})::BIGINT AS visible FROM d""")
def docx_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a text file, read back: status, coverage, nodes and visible characters."""
    rows = files.measured(files.parsed(_text_files(spark, sf_dir)))
    found = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + tree.numerator(n["content"]))
    return rows.select("doc_id", "status", "parse_level", "text_coverage", F.size("nodes").cast("long").alias("nodes"), found.alias("visible"))


@query("""SELECT l_orderkey::VARCHAR AS doc_id, 'A1:D' || (count(*) + 1) AS region, (4 * count(*) + 4)::BIGINT AS cells, 'ok' AS status FROM lineitem GROUP BY l_orderkey""")
def xlsx_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a sheet with a head row, read back: its one region and cells."""
    cells = F.struct("l_linenumber", F.array(*[F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")]).alias("row"))
    head = F.array(F.array(*[F.lit(x) for x in ("Line", "Part", "Flag", "Status")]))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cells)).alias("lines"))
    orders = orders.select("l_orderkey", F.lit("Lines").alias("name"), F.concat(head, F.transform("lines", lambda x: x["row"])).alias("rows"))
    rows = files.measured(files.parsed(office_writer.made(orders, "xlsx", office_writer.workbook, id_col="l_orderkey", columns=["name", "rows"])))
    return rows.select("doc_id", "status", F.explode(F.filter("nodes", lambda n: n["type"] == "sheet_region")).alias("n")).select("doc_id", "status", F.col("n.content.range").alias("region"), F.size("n.content.cells").cast("long").alias("cells"))


@query(rf"""SELECT conv_id::VARCHAR AS doc_id, count(*)::BIGINT AS slides, sum(length({VISIBLE % "role || text"}))::BIGINT AS visible, 'ok' AS status FROM conversations GROUP BY conv_id""")
def pptx_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as slides, one a turn, read back: slides and visible characters."""
    turn = F.struct("turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t")).select("conv_id", F.col("t.role").alias("titles"), F.col("t.text").alias("bodies"))
    rows = files.measured(files.parsed(office_writer.made(talks, "pptx", office_writer.slides, id_col="conv_id", columns=["titles", "bodies"])))
    found = F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + tree.numerator(n["content"]))
    return rows.select("doc_id", F.size(F.filter("nodes", lambda n: n["type"] == "slide")).cast("long").alias("slides"), found.alias("visible"), "status")


@query(rf"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, {LINES} AS l FROM (SELECT doc_id, source, regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffe}}\x{{ffff}}]+', '', 'g') AS text FROM documents WHERE text IS NOT NULL))
    SELECT doc_id::VARCHAR AS doc_id, array_to_string(list_concat(['# ' || source], l), chr(10) || chr(10)) || chr(10) AS body FROM d""")
def import_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to nodes to Markdown: the way of an import and an export."""
    return render.render_parsed(files.parsed(_text_files(spark, sf_dir)))


# ---------------------------------------------------------------- page layout and views


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity / 20.0 >= 1.55 THEN 1 WHEN l_quantity / 20.0 >= 1.30 THEN 2 WHEN l_quantity / 20.0 >= 1.12 THEN 3 END::VARCHAR AS level FROM lineitem""")
def heading_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", layout.heading_level(F.col("l_quantity"), F.lit(20.0)).cast("string").alias("level"))


@query("""WITH c AS (SELECT l_orderkey, round(l_quantity, 1) AS s, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL) SELECT l_orderkey, arg_max(s, n * 1000 - s) AS body FROM c GROUP BY l_orderkey""")
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.body_size(table(spark, sf_dir, "lineitem"), key="l_orderkey", size="l_quantity", page="l_linenumber")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey::DOUBLE AS top, o_orderkey + 200.0 AS bottom FROM orders),
    s AS (SELECT *, CASE WHEN lag(bottom) OVER w IS NULL OR top - lag(bottom) OVER w > 1.6 * (bottom - top) THEN 1 ELSE 0 END AS s FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY top))
    SELECT o_orderkey, sum(s) OVER (PARTITION BY o_custkey ORDER BY top ROWS UNBOUNDED PRECEDING)::BIGINT AS paragraph FROM s""")
def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").cast("double").alias("top"), (F.col("o_orderkey") + 200.0).alias("bottom"))
    return layout.paragraph_numbers(lines, key=["o_custkey"], top="top", bottom="bottom").select("o_orderkey", "paragraph")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x, l_discount AS y FROM lineitem), b AS (SELECT o_orderkey, 10.0 AS x0, 30.0 AS x1, 0.0 AS y0, 0.05 AS y1 FROM orders WHERE o_orderstatus = 'F')
    SELECT l_orderkey, l_linenumber, l_partkey FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.o_orderkey = p.l_orderkey AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)""")
def outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    boxes = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(10.0).alias("x0"), F.lit(30.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.05).alias("y1"))
    return layout.outside(points, boxes, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT count(*)::BIGINT AS samples, count(*) FILTER (quality = 1)::BIGINT AS passed, count(*) FILTER (quality = 0)::BIGINT AS failed,
    round_even(count(*) FILTER (quality = 0 AND toxic = 1) / count(*) FILTER (quality = 0)::DOUBLE, 4) AS graceful_rate, avg(toxic::DOUBLE) AS mean_coverage, avg(doc_id::DOUBLE) AS mean_seconds, count(*)::BIGINT AS level_L0, 0::BIGINT AS level_L1, 0::BIGINT AS level_L2 FROM labels""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("passed"), (F.col("toxic") == 1).alias("graceful"), F.col("toxic").cast("double").alias("coverage"), F.col("doc_id").cast("double").alias("seconds"), F.lit("L0").alias("level"))
    return stats.corpus_summary(rows, passed="passed", graceful="graceful", coverage="coverage", seconds="seconds", level="level")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def since_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.since_days(table(spark, sf_dir, "events"), "ts", 7, F.lit("2024-01-31")).select("event_id")


@query("""SELECT user_id, unnest(['queued', 'running', 'error', 'done']) AS step, unnest([CASE WHEN k < c THEN 'done' WHEN k = c THEN CASE WHEN f THEN 'failed' ELSE 'active' END WHEN f THEN 'skipped' ELSE 'pending' END FOR k IN [0, 1, 2, 3]]) AS state
    FROM (SELECT user_id, (count(*) % 4)::INTEGER AS c, count(*) FILTER (event_type = 'error') % 2 = 1 AS f FROM events GROUP BY user_id)""")
def step_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") % 4).cast("int").alias("c"), (F.count_if(F.col("event_type") == "error") % 2 == 1).alias("f"))
    return rows.select("user_id", F.explode(stats.step_states(["queued", "running", "error", "done"], F.col("c"), F.col("f"))).alias("s")).select("user_id", "s.*")


# ---------------------------------------------------------------- markup and streams


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every document's text read as Markdown."""
    return markup.blocks(table(spark, sf_dir, "documents")).select("doc_id", "n", "kind", "level", "text", F.size("cells").alias("cells"))


@query("""SELECT l_orderkey, 0 AS n, (2 * count(*) + 2)::INTEGER AS cells, 1 AS head_rows, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS body FROM lineitem GROUP BY l_orderkey""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a table within a page, with tags left out as pages may, read back."""
    line = F.struct("l_linenumber", "l_returnflag", F.concat(F.lit("<tr><td>"), F.col("l_linenumber"), F.lit("<td>"), F.col("l_returnflag"), F.lit("</td>")).alias("html"))
    pages = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("t"))
    html = F.concat(F.lit("<html><body><p>Lines<table><thead><tr><th>Line<th>Flag</thead>"), F.array_join(F.col("t.html"), "\n"), F.lit("</table><p>end"))
    found = markup.tables(pages.select("l_orderkey", html.alias("html")), id_col="l_orderkey")
    body = F.filter(found["cells"], lambda c: c["r"] > 0)
    pairs = F.transform(F.filter(body, lambda c: c["c"] == 0), lambda a: F.concat(a["text"], F.lit(":"), F.get(F.filter(body, lambda b: (b["r"] == a["r"]) & (b["c"] == 1)), F.lit(0))["text"]))
    return found.select("l_orderkey", "n", F.size(found["cells"]).alias("cells"), "head_rows", F.array_join(pairs, ",").alias("body"))


@query("""WITH e AS (SELECT user_id % 10 AS task, event_id, CASE WHEN event_type = 'view' THEN 'progress' ELSE event_type END AS kind FROM events),
    s AS (SELECT *, count(*) OVER (PARTITION BY task) AS n, row_number() OVER (PARTITION BY task, kind ORDER BY event_id DESC) AS k FROM e)
    SELECT task, event_id, kind FROM s WHERE n <= 900 OR kind <> 'progress' OR k <= 450""")
def event_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that a log trimmed to 900 a task keeps."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("task"), "event_id", F.when(F.col("event_type") == "view", "progress").otherwise(F.col("event_type")).alias("kind"))
    return events.retained(e, task="task", seq="event_id", kind="kind", most=900)


@query("""WITH e AS (SELECT user_id AS task_id, event_type AS event FROM events), t AS (SELECT user_id AS task_id, CASE WHEN user_id % 3 = 0 THEN 'done' WHEN user_id % 3 = 1 THEN 'canceled' ELSE 'running' END AS status FROM events GROUP BY user_id)
    SELECT task_id, event, count(*)::BIGINT AS n FROM (SELECT * FROM e UNION ALL SELECT task_id, CASE status WHEN 'done' THEN 'done' ELSE 'failed' END FROM t WHERE status <> 'running') GROUP BY task_id, event""")
def terminal_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a closing one for every task that has ended without."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("event"))
    state = F.when(F.col("task_id") % 3 == 0, "done").when(F.col("task_id") % 3 == 1, "canceled").otherwise("running")
    tasks = e.select("task_id").distinct().withColumn("status", state)
    return events.backfilled(e, tasks).groupBy("task_id", "event").agg(F.count("*").alias("n"))


@query("""SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts)::VARCHAR AS start, least(greatest(arg_max(value / 100, ts), 0.0), 1.0) AS progress FROM events GROUP BY 1, 2""")
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last progress of each task in each six hours."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", (F.col("value") / 100).alias("value"))
    return events.throttled(e, task="user_id", ts="ts", value="value", every="6 hours").withColumn("start", F.col("start").cast("string"))


@query("SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS n, count(*) FILTER (event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1")
def streamed_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sums by a stream over the event file, read from the sink once it has taken all there is."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    sums = events.daily(stream, ts="ts", sums={"n": F.lit(1), "errors": F.when(F.col("event_type") == "error", 1).otherwise(0)})
    place = shared_folder(spark, "daily")
    events.deliver(sums, lambda batch, number: batch.write.mode("overwrite").parquet(f"{place}/sums"), f"{place}/checkpoint", mode="complete").awaitTermination()
    return spark.read.schema(sums.schema).parquet(f"{place}/sums").withColumn("day", F.col("day").cast("string"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@query("""WITH e AS (SELECT (user_id % 10)::VARCHAR AS task_id, event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'progress' ELSE event_type END AS kind FROM events),
    s AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n, row_number() OVER (PARTITION BY task_id, kind ORDER BY event_id DESC) AS k FROM e)
    SELECT task_id, event_id AS seq, kind FROM s WHERE n <= 900 OR kind <> 'progress' OR k <= 450""")
def stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trimmed logs that a stream over the events holds as its state, read from its checkpoint."""
    kind = F.when(F.col("event_type").isin("view", "click", "signup"), "progress").otherwise(F.col("event_type"))
    rows = _event_stream(spark, sf_dir).select((F.col("user_id") % 10).alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"))
    place = shared_folder(spark, "retention")
    stateful.running(stateful.retained_stream(stateful.logged(rows), most=900), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return stateful.retained_log(spark, f"{place}/checkpoint").select("task_id", "seq", "kind")


@query("""WITH e AS (SELECT (user_id % 10) || ':' || ts::DATE AS task_id, (epoch_us(ts) // 1000) AS ms, ts, CASE event_type WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'done' ELSE 'progress' END AS kind FROM events),
    f AS (SELECT task_id, min(ts) FILTER (kind = 'progress') AS run, min(ts) FILTER (kind = 'cancel') AS c, min(ts) FILTER (kind = 'done') AS d, max(ms) AS latest FROM e GROUP BY task_id),
    g AS (SELECT *, CASE WHEN d IS NOT NULL AND (c IS NULL OR d < c) THEN 'done' WHEN c IS NULL THEN NULL WHEN run IS NULL OR run > c THEN 'at once'
        WHEN d IS NOT NULL AND (epoch_us(d) // 1000) < (epoch_us(c) // 1000) + 3600000 THEN 'done' WHEN latest >= (epoch_us(c) // 1000) + 3600000 OR (SELECT max(ms) FROM e) >= (epoch_us(c) // 1000) + 3600000 THEN 'forced' END AS how FROM f),
    k AS (SELECT *, CASE how WHEN 'done' THEN (epoch_us(d) // 1000) WHEN 'at once' THEN (epoch_us(c) // 1000) WHEN 'forced' THEN (epoch_us(c) // 1000) + 3600000 END AS ended FROM g)
    SELECT k.task_id, CASE WHEN how = 'done' THEN 'done' WHEN how IS NULL THEN 'running' ELSE 'canceled' END AS status, coalesce(ended, 0)::BIGINT AS ended, coalesce(how = 'forced', false) AS forced,
      (count(*) FILTER (e.kind = 'progress' AND (ended IS NULL OR how = 'done' AND e.ts < k.d OR how = 'at once' AND e.ts < k.c OR how = 'forced' AND e.ms < ended)) + CASE WHEN how IN ('done', 'at once') THEN 1 ELSE 0 END)::BIGINT AS events
    FROM k JOIN e USING (task_id) GROUP BY k.task_id, how, ended, d, c HAVING events > 0 OR how IS NOT NULL""")
def stream_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How tasks end that a watchdog stops an hour after a request, and how many of their events it lets through."""
    kind = F.when(F.col("event_type") == "error", "cancel").when(F.col("event_type") == "purchase", "done").otherwise("progress")
    task = F.concat_ws(":", (F.col("user_id") % 10).cast("string"), F.to_date("ts").cast("string"))
    rows = _event_stream(spark, sf_dir).select(task.alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"))
    place = shared_folder(spark, "watchdog")
    made = stateful.watched(stateful.logged(rows), grace=3600, hold=30 * 86400)
    stateful.running(made, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    end = F.col("kind").isin(*events.ENDS)
    return spark.read.schema(made.schema).parquet(f"{place}/out").groupBy("task_id").agg(
        F.coalesce(F.max(F.when(end, F.col("kind"))), F.lit("running")).alias("status"), F.coalesce(F.max(F.when(end, F.unix_millis("at"))), F.lit(0)).alias("ended"),
        (F.count("code") > 0).alias("forced"), F.count("seq").alias("events"),
    )


@query("""WITH e AS (SELECT user_id::VARCHAR AS task_id, ts, event_type FROM events),
    a AS (SELECT t.task_id, CASE WHEN t.task_id::BIGINT % 2 = 0 THEN 'done' ELSE 'failed' END AS kind FROM e t WHERE t.event_type = 'error' AND t.ts + INTERVAL 2 HOUR < (SELECT max(ts) FROM e)
      AND NOT EXISTS (SELECT 1 FROM e c WHERE c.event_type = 'purchase' AND c.task_id = t.task_id AND c.ts BETWEEN t.ts - INTERVAL 2 HOUR AND t.ts + INTERVAL 2 HOUR)),
    b AS (SELECT task_id, CASE event_type WHEN 'purchase' THEN 'done' ELSE 'progress' END AS kind, 0 AS added FROM e UNION ALL SELECT task_id, kind, 1 FROM a)
    SELECT task_id, kind, count(*)::BIGINT AS events, sum(added)::BIGINT AS added FROM b GROUP BY task_id, kind""")
def stream_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of events with a closing one for every end (an error) that has none (a purchase) within two hours."""
    rows = _event_stream(spark, sf_dir)
    kind = F.when(F.col("event_type") == "purchase", "done").otherwise("progress")
    feed = stateful.logged(rows.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at")))
    status = F.when(F.col("event_type") != "error", "running").when(F.col("user_id") % 2 == 0, "done").otherwise("canceled")
    ended = _event_stream(spark, sf_dir).select(F.col("user_id").alias("task_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ended_at")).withWatermark("ended_at", "0 seconds")
    place = shared_folder(spark, "closing")
    made = stateful.closing_feed(feed, ended, within="2 hours")
    stateful.running(made, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    out = spark.read.schema(made.schema).parquet(f"{place}/out")
    return out.groupBy("task_id", "kind").agg(F.count("*").alias("events"), F.count_if(F.col("seq").isNull()).alias("added"))


from . import views  # noqa: E402, F401  the queries of the smaller operators
