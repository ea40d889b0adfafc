"""Queries: text functions, blocks, chunks, hashing, sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.analyze import analyzed, beside_model, sparse_terms, trigram_text, websearch
from corvane.functions.embedding import HashEmbedder, embedded
from corvane.operators import blocks as B
from corvane.operators import chunking, drafting, sync, tables
from corvane.plans import views as V


def boilerplate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.boilerplate_keys(V.lines(spark, sf_dir), ratio=0.01)


KEYS = f"""{V.LINES}, k AS (SELECT doc, page, trim(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '\\d+', '#', 'g')) AS key, length(text) <= 160 AS short FROM lines),
n AS (SELECT doc, count(DISTINCT page) AS n FROM k GROUP BY 1 HAVING n >= 4),
b AS (SELECT k.doc, key, count(DISTINCT page) AS pages FROM k JOIN n USING (doc) WHERE short AND key <> '' GROUP BY k.doc, key, n.n HAVING pages >= greatest(4, floor(n.n * 0.01)))"""


def boilerplate_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.lines(spark, sf_dir)
    keys = B.boilerplate_keys(rows, ratio=0.01).select(F.col("doc").alias("d"), F.col("key").alias("k"))
    left = rows.join(keys, (F.col("doc") == F.col("d")) & (T.boilerplate_key(F.col("text")) == F.col("k")), "left_anti")
    return left.groupBy("doc").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


REMOVED_SQL = f"""WITH {KEYS} SELECT l.doc, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM lines l
WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = l.doc AND b.key = trim(regexp_replace(regexp_replace(l.text, '\\s+', ' ', 'g'), '\\d+', '#', 'g'))) GROUP BY 1"""


def section_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders are a customer's table of contents; the rest its pages."""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("page"), "o_orderpriority", "o_orderkey")
    toc = o.where("o_orderpriority = '1-URGENT'").select("doc", F.col("o_orderkey").alias("pos"), F.lit(1).alias("level"), F.concat(F.lit("order "), "o_orderkey").alias("title"), "page")
    return B.section_map(toc, o.select("doc", "page").distinct()).groupBy("section").agg(F.count(F.lit(1)).alias("pages"), F.sum("page").alias("total"))


ASOF_SQL = """WITH o AS (SELECT o_custkey AS doc, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS page, o_orderpriority AS p, o_orderkey AS k FROM orders),
t AS (SELECT doc, page, max(k) AS k FROM o WHERE p = '1-URGENT' GROUP BY 1, 2), g AS (SELECT DISTINCT doc, page FROM o),
a AS (SELECT g.doc, g.page, t.k FROM g ASOF LEFT JOIN t ON g.doc = t.doc AND g.page >= t.page)
SELECT CASE WHEN k IS NULL THEN '' ELSE 'order ' || CAST(k AS VARCHAR) END AS section, count(*) AS pages, CAST(sum(page) AS BIGINT) AS total FROM a GROUP BY 1"""


def forward_fill_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "lineitem").withColumn("label", F.when(F.col("l_linenumber") % 3 == 1, F.concat("l_returnflag", "l_linestatus")).otherwise(""))
    filled = B.fill_forward(rows, "label", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return filled.groupBy("l_orderkey", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("total"))


FILL_SQL = """WITH f AS (SELECT *, last_value(CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag || l_linestatus END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM lineitem)
SELECT l_orderkey, coalesce(label, '') AS label, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM f GROUP BY 1, 2"""


def long_prose_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.split_long(V.table(spark, sf_dir, "documents").select("doc_id", "text"), 1200, 200)
    return rows.select("doc_id", "part", F.length("text").alias("n"), F.md5("text").alias("hash"))


WINDOWS_SQL = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (SELECT doc_id, text, n, unnest(range(0, CASE WHEN n > 1200 THEN CAST(ceil((n - 1200) / 1000.0) AS BIGINT) ELSE 0 END + 1)) AS p FROM d)
SELECT doc_id, CAST(p AS INT) AS part, CAST(length(substr(text, p * 1000 + 1, 1200)) AS INT) AS n, md5(substr(text, p * 1000 + 1, 1200)) AS hash FROM w WHERE n > 1200
UNION ALL SELECT doc_id, CAST(0 AS INT), CAST(n AS INT), md5(text) FROM d WHERE n <= 1200"""


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


TOKENS_SQL = """SELECT doc_id, CAST(greatest(1, round_even((length(text) - o) / 4.0 + o / 1.5, 0)) AS INT) AS tokens
FROM (SELECT doc_id, text, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS o FROM documents)"""


def content_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.array(F.col("lang")), F.col("text")).alias("hash"))
    return d.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


DUPS_SQL = """SELECT md5(lang || '||' || lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING n > 1"""


def cell_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise_cell(F.col("text"))).alias("hash"))


CELL_SQL = "SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))) AS hash FROM documents"


def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = V.table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


WORDS_SQL = "SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[가-힣]+')) AS w FROM documents) GROUP BY 1"


def strip_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names with every particle, and with none."""
    n = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.explode(F.array(*map(F.lit, (*T.PARTICLES, "")))).alias("p"))
    return n.select(F.concat("name", "p").alias("word"), T.strip_particles(F.concat("name", "p")).alias("stem"))


PARTICLES_SQL = "WITH p AS (SELECT unnest([" + ", ".join(f"'{p}'" for p in (*T.PARTICLES, "")) + "]) AS p) SELECT n_name || p AS word, n_name AS stem FROM nation, p"


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    said = F.concat(F.lit("SR"), F.lpad((F.col("p_partkey") % 900).cast("string"), 3, "0"), F.lit(" V4 needs "), F.col("p_size").cast("string"), F.lit(" GB and DDR5-"), F.col("p_size").cast("string"), F.lit(" for "), "p_brand", F.lit(" [1]"))
    return p.select("p_partkey", said.alias("said"), F.concat(F.lit("memory: "), ((F.col("p_size") / 2).cast("int") * 2).cast("string"), F.lit("GB, DDR5-"), F.col("p_size").cast("string")).alias("evidence"))


SPECS = """specs AS (SELECT p_partkey, 'SR' || lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0') || ' V4 needs ' || p_size || ' GB and DDR5-' || p_size || ' for ' || p_brand || ' [1]' AS said,
  'memory: ' || (p_size // 2 * 2) || 'GB, DDR5-' || p_size AS evidence, p_size, p_brand FROM part)"""
IDENT = r"\b(?:[A-Za-z]{1,6}[0-9][A-Za-z0-9./\-]*|[0-9]{1,4}(?:\.[0-9]+)?\s?(?:TB|GB|MB|PB|KB|W|V|A|U|mm|cm|kg|lb|MHz|GHz|MT/s|Gb/s|Gbps|inch|nm)|[0-9][A-Za-z][A-Za-z0-9]{2,})\b"


def identifier_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir).select("p_partkey", F.array_join(T.identifiers(F.col("said")), "|").alias("found"))


IDENT_SQL = f"""WITH {SPECS}, f AS (SELECT p_partkey, regexp_extract_all(said, '(?i){IDENT}') AS x FROM specs),
b AS (SELECT p_partkey, unnest(flatten(list_transform(x, lambda y: [trim(y), replace(trim(y), ' ', '')]))) AS v, unnest(range(2 * len(x))) AS i FROM f)
SELECT p_partkey, string_agg(v, '|' ORDER BY i) AS found FROM (SELECT p_partkey, v, min(i) AS i FROM b GROUP BY 1, 2) GROUP BY 1"""


def products_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir).select(F.explode(T.products_in(F.col("said"))).alias("product")).groupBy("product").agg(F.count(F.lit(1)).alias("n"))


PRODUCTS_SQL = f"WITH {SPECS} SELECT '{T.BRAND} SR' || lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0') || ' V4' AS product, count(*) AS n FROM specs GROUP BY 1"


def grounding_unsupported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _specs(spark, sf_dir).select("p_partkey", F.array_join(T.unsupported(F.col("said"), F.array("evidence")), "|").alias("missing"))


GROUNDING_SQL = f"""WITH {SPECS} SELECT p_partkey, array_to_string(list_filter([p_size || ' GB', 'SR' || lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0'), 'DDR5-' || p_size],
  lambda c: NOT contains(lower(replace(replace(evidence, ' ', ''), ',', '')), lower(replace(c, ' ', '')))), '|') AS missing FROM specs"""


def citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.query_log(spark, sf_dir)
    said = F.concat(F.lit("see ["), (F.col("k") % 12).cast("string"), F.lit("] and ["), F.length("answer").cast("string"), F.lit("]"))
    return e.select("id", F.array_join(T.cited(said, F.lit(10)), ",").alias("cited"))


CITED_SQL = """WITH e AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(json_extract_string(props, '$.k') AS INT) % 12 AS a, length(props) AS b FROM events)
SELECT id, CASE WHEN a BETWEEN 1 AND 10 AND b BETWEEN 1 AND 10 THEN CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE least(a, b) || ',' || greatest(a, b) END END AS cited FROM e"""


def citation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    path = F.when(F.col("p_size") % 2 == 0, "a.PPTX").otherwise("a.pdf")
    return p.select("p_partkey", T.citation(F.col("p_brand"), path, (F.col("p_size") % 5).cast("int"), (F.col("p_size") % 5 + F.col("p_size") % 2).cast("int"), F.col("p_type")).alias("citation"))


RENDER_SQL = """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand || ' · ' || p_type ELSE p_brand || ' ' || CASE WHEN p_size % 2 = 0 THEN '슬라이드 ' ELSE 'p' END || (p_size % 5)
  || CASE WHEN p_size % 2 = 0 THEN '' ELSE '-' || (p_size % 5 + p_size % 2) END END AS citation FROM part"""


def intent_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations, each followed by one of some question endings."""
    ends = ["", " 비교해 주세요", " how to INSTALL it", " 무게는?", " 용량", " x vs y"]
    c = V.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(*map(F.lit, ends))).alias("e"), "text")
    said = F.concat("text", "e")
    return c.select("e", T.intent(said, F.array().cast("array<string>")).alias("intent")).groupBy("e", "intent").agg(F.count(F.lit(1)).alias("n"))


INTENT_SQL = """WITH c AS (SELECT text, unnest(['', ' 비교해 주세요', ' how to INSTALL it', ' 무게는?', ' 용량', ' x vs y']) AS e FROM conversations), s AS (SELECT e, text || e AS q, lower(text || e) AS low FROM c)
SELECT e, CASE WHEN regexp_matches(low, '비교|차이|대비|vs|versus|어느 쪽|중 어떤') THEN 'comparison' WHEN regexp_matches(low, '방법|절차|설치|설정|구성하|어떻게|순서|how to|install|configure') THEN 'procedure'
  WHEN regexp_matches(q, '용량|최대|최소|몇|얼마|크기|무게|속도|전력|개수|수량|사양|스펙|지원|온도|높이|효율') OR regexp_matches(rtrim(q), '(는|은|까)\\?$') THEN 'spec' ELSE 'general' END AS intent, count(*) AS n FROM s GROUP BY 1, 2"""


def analyze_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.table(spark, sf_dir, "conversations").where("role = 'user'")
    a = c.select("conv_id", "turn", analyzed(F.col("text")).alias("a"))
    return a.select("conv_id", "turn", F.size("a.terms").alias("n_terms"), "a.intent")


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select("doc_id", embedded(F.col("text"), HashEmbedder(64), strict=False).alias("v"))
    return d.select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their lines, ten to a page; each seventh line with words is
    a row of a table."""
    is_row = (F.col("pos") % 7 == 3) & (F.trim("text") != "")
    pairs = F.when(is_row, F.array(F.struct(F.lit("line").alias("k"), F.col("text").alias("v"))))
    b = V.lines(spark, sf_dir).select(F.col("page").alias("doc"), "pos", F.when(is_row, "table_row").otherwise("prose").alias("kind"), "text", pairs.alias("pairs"), F.lit("").alias("grp"), F.lit("").alias("unit"), (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), F.col("doc").alias("section_path"))
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("doc "), "doc_id").alias("title"), F.array().cast("array<string>").alias("products"))
    return chunking.chunk(b, docs).select("document_id", "ordinal", "kind", "section_path", "page_from", "page_to", "token_count", "content_hash")


CHUNK_SQL = """WITH RECURSIVE l AS (SELECT doc_id AS doc, source, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT *, pos % 7 = 3 AND trim(text) <> '' AS is_row FROM l),
p AS (SELECT doc, source, pos, is_row, CASE WHEN is_row THEN ['line: ' || text] WHEN length(text) <= 1200 THEN [text] ELSE list_transform(range(0, CAST(ceil((length(text) - 1200) / 1000.0) AS INT) + 1), lambda j: substr(text, j * 1000 + 1, 1200)) END AS parts FROM k),
b AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos, part) AS i FROM (SELECT doc, source, pos, is_row, unnest(parts) AS text, generate_subscripts(parts, 1) AS part FROM p)),
n AS (SELECT doc, max(i) AS n FROM b GROUP BY 1),
st AS (SELECT doc, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS f, CAST(0 AS BIGINT) AS size, CAST([] AS STRUCT(r BOOLEAN, a BIGINT, z BIGINT)[]) AS done FROM n
  UNION ALL SELECT b.doc, b.i, CASE WHEN is_row OR (size + length(text) >= 1200 AND length(text) > 200) THEN b.i + 1 WHEN size + length(text) >= 1200 THEN b.i ELSE f END,
    CASE WHEN is_row OR (size + length(text) >= 1200 AND length(text) > 200) THEN 0 WHEN size + length(text) >= 1200 THEN length(text) ELSE size + length(text) END,
    CASE WHEN is_row THEN list_concat(done, list_concat(CASE WHEN f < b.i THEN [{'r': false, 'a': f, 'z': b.i - 1}] ELSE [] END, [{'r': true, 'a': b.i, 'z': b.i}]))
      WHEN size + length(text) >= 1200 THEN list_append(done, {'r': false, 'a': f, 'z': b.i}) ELSE done END
  FROM st JOIN b ON b.doc = st.doc AND b.i = st.i + 1),
c AS (SELECT st.doc, CASE WHEN f <= n THEN list_append(done, {'r': false, 'a': f, 'z': n}) ELSE done END AS done FROM st JOIN n ON n.doc = st.doc AND n.n = st.i),
u AS (SELECT doc, unnest(done) AS x, generate_subscripts(done, 1) - 1 AS ordinal FROM c),
body AS (SELECT u.doc, ordinal, any_value(x.r) AS is_row, any_value(source) AS source, min(pos) // 10 + 1 AS page_from, max(pos) // 10 + 1 AS page_to, string_agg(text, chr(10) ORDER BY i) AS body FROM u JOIN b ON b.doc = u.doc AND b.i BETWEEN x.a AND x.z GROUP BY 1, 2),
t AS (SELECT *, 'doc ' || doc || chr(10) || CASE WHEN coalesce(source, '') <> '' THEN source || chr(10) ELSE '' END || body AS content FROM body),
o AS (SELECT *, length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g')) AS o FROM t)
SELECT doc AS document_id, CAST(ordinal AS INT) AS ordinal, CASE WHEN is_row THEN 'table_row' ELSE 'prose' END AS kind, coalesce(source, '') AS section_path, CAST(page_from AS INT) AS page_from, CAST(page_to AS INT) AS page_to,
  CAST(greatest(1, round_even((length(content) - o) / 4.0 + o / 1.5, 0)) AS INT) AS token_count, md5('||' || lower(trim(regexp_replace(body, '\\s+', ' ', 'g')))) AS content_hash FROM o"""


def table_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per region: a header, a group row, and nations whose first cell
    is merged over the region."""
    n = V.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    rows = F.transform("x", lambda x, i: F.array(F.when(i == 0, "here").otherwise(""), x["n_name"], x["n_nationkey"].cast("string")))
    raw = F.concat(F.array(F.array(F.lit("place"), F.lit("name"), F.lit("")), F.array(F.lit("nations"), F.lit(""), F.lit(""))), rows)
    out = tables.table_rows(n.select("n_regionkey", raw.alias("rows")))
    return out.select("n_regionkey", "row_no", "grp", tables.rendered(F.col("grp"), F.col("pairs"), F.lit("")).alias("text"))


TABLE_SQL = """SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS row_no, 'nations' AS grp,
  '[nations]' || chr(10) || 'place: here' || chr(10) || 'name: ' || n_name || chr(10) || 'col2: ' || n_nationkey AS text FROM nation"""


def unit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    blocks = p.select(F.col("p_brand").alias("doc"), F.col("p_size").alias("page"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("x (Unit: k"), F.col("p_partkey").cast("string"), F.lit(") y"))).otherwise(F.col("p_name")).alias("text"))
    return B.unit_notes(blocks, ["doc", "page"])


UNITS_SQL = "SELECT p_brand AS doc, p_size AS page, 'Unit: k' || min(p_partkey) AS unit FROM part WHERE p_partkey % 7 = 0 GROUP BY 1, 2"


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", (F.col("doc_id") % 20 + 1).alias("page_count"))
    return B.scanned(rows)


SCANNED_SQL = "SELECT doc_id AS doc, CAST(length(text) AS BIGINT) AS chars, length(text) / (doc_id % 20 + 1) < 120 AS needs_review FROM documents"


def _sync(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The table as indexed documents; as files, French ones have changed,
    German ones moved, Spanish ones gone, and there are some new ones."""
    d = V.table(spark, sf_dir, "documents")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    known = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("/r/"), F.col("doc_id").cast("string")).alias("source_path"), F.sha2(F.concat_ws("|", "doc_id", "text"), 256).alias("sha256"), F.lit("indexed").alias("status"), F.col("n_chars").alias("byte_size"), at.alias("source_mtime"))
    lang = F.col("lang")
    path = F.when(lang == "de", F.concat(F.lit("/r/moved/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("/r/"), F.col("doc_id").cast("string")))
    files = d.where("lang <> 'es'").select(path.alias("path"), F.when(lang == "fr", F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), at.alias("mtime"), F.when(lang == "fr", F.sha2("text", 256)).otherwise(F.sha2(F.concat_ws("|", "doc_id", "text"), 256)).alias("sha256"))
    new = V.table(spark, sf_dir, "region").select(F.concat(F.lit("/r/new"), F.col("r_regionkey").cast("string")).alias("path"), F.lit(1).cast("long").alias("size"), at.alias("mtime"), F.sha2("r_name", 256).alias("sha256"))
    return files.unionByName(new), known


def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, known = _sync(spark, sf_dir)
    return sync.plan(files, known, "/r/").withColumn("document_id", F.coalesce("document_id", F.lit(-1)))


SYNC_SQL = """SELECT CASE WHEN lang = 'de' THEN '/r/moved/' ELSE '/r/' END || doc_id AS path, CASE lang WHEN 'fr' THEN 'changed' WHEN 'de' THEN 'moved' WHEN 'es' THEN 'missing' ELSE 'unchanged' END AS action, doc_id AS document_id FROM documents
UNION ALL SELECT '/r/new' || r_regionkey, 'new', -1 FROM region"""


def skip_known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, known = _sync(spark, sf_dir)
    return sync.skip_known(files, known).select("path", "size")


SKIP_SQL = "SELECT '/r/' || doc_id AS path, n_chars + 1 AS size FROM documents WHERE lang = 'fr' UNION ALL SELECT '/r/new' || r_regionkey, 1 FROM region"


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers merged with the suppliers' rows under their keys."""
    c, s = V.table(spark, sf_dir, "customer"), V.table(spark, sf_dir, "supplier")
    stored = c.select(F.col("c_custkey").cast("string").alias("sha256"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("balance"))
    fresh = s.select((F.col("s_suppkey") * 20).cast("string").alias("sha256"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("balance"))
    return sync.upsert_documents(stored, fresh, keep=("title",))


UPSERT_SQL = """WITH s AS (SELECT CAST(s_suppkey * 20 AS VARCHAR) AS k, s_name, s_acctbal FROM supplier)
SELECT coalesce(CAST(c_custkey AS VARCHAR), k) AS sha256, coalesce(c_name, s_name) AS title, CASE WHEN k IS NOT NULL THEN s_acctbal ELSE c_acctbal END AS balance FROM customer FULL JOIN s ON CAST(c_custkey AS VARCHAR) = k"""


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    return sync.latest_versions(o, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


LATEST_SQL = "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def doc_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    chunks = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.length("o_orderpriority").alias("token_count"))
    return sync.rollup(docs, chunks)


ROLLUP_SQL = "SELECT c_custkey AS id, c_name AS title, count(o_orderkey) AS chunks, CAST(coalesce(sum(length(o_orderpriority)), 0) AS BIGINT) AS tokens FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2"


def draft_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("document"), F.col("p_size").alias("page"), F.when(F.col("p_size") % 3 == 0, "Memory specification").when(F.col("p_size") % 3 == 1, "Power").otherwise("Other").alias("section"), F.col("p_name").alias("key"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " GB").otherwise(" pieces")).alias("value"), "p_partkey")
    return drafting.candidates(rows).select("p_partkey", "score")


DRAFT_SQL = """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 6 WHEN p_size % 3 = 1 THEN 3 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END + 1 + 2 AS score FROM part
WHERE regexp_matches(p_name, '[a-z]') AND NOT regexp_matches(p_name, '^[0-9]') AND NOT regexp_full_match(p_name, '[A-Z0-9][A-Z0-9/-]{2,}') AND length(trim(p_name)) BETWEEN 2 AND 40 AND length(CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN ' GB' ELSE ' pieces' END) >= 3"""


def draft_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drafts taken of all parts: four of a brand, nine of a kind, one of a
    brand's section."""
    p = V.table(spark, sf_dir, "part")
    rows = p.select(
        F.col("p_brand").alias("document"), F.col("p_partkey").alias("page"), F.concat(F.when(F.col("p_size") % 3 == 0, "Memory specification ").otherwise("Power "), (F.col("p_size") % 7).cast("string")).alias("section"),
        F.lower(F.substring_index("p_type", " ", -1)).alias("key"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " GB").otherwise(" pieces")).alias("value"),
    )
    return drafting.pick(drafting.candidates(rows), 4, 9).select("document", "page", "section", "key", "score")


PICK_SQL = """WITH RECURSIVE r AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, document, page, key, value, section) AS i FROM (
    SELECT p_brand AS document, p_partkey AS page, CASE WHEN p_size % 3 = 0 THEN 'Memory specification ' ELSE 'Power ' END || (p_size % 7) AS section,
      lower(string_split(p_type, ' ')[-1]) AS key, p_size || CASE WHEN p_size % 2 = 0 THEN ' GB' ELSE ' pieces' END AS value,
      CASE WHEN p_size % 3 = 0 THEN 6 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 0 ELSE 3 END + 3 AS score FROM part)
  WHERE length(value) >= 3 AND regexp_matches(key, '[a-z]') AND length(key) BETWEEN 2 AND 40),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, d VARCHAR, k VARCHAR, s VARCHAR)[]) AS took
  UNION ALL SELECT r.i, CASE WHEN len(list_filter(took, lambda x: x.d = r.document)) < 4 AND len(list_filter(took, lambda x: x.k = r.key)) < 9 AND len(list_filter(took, lambda x: x.d = r.document AND x.s = r.section)) = 0
    THEN list_append(took, {'i': r.i, 'd': r.document, 'k': r.key, 's': r.section}) ELSE took END FROM st JOIN r ON r.i = st.i + 1)
SELECT document, page, section, key, score FROM r JOIN (SELECT unnest(took).i AS i FROM (SELECT took FROM st ORDER BY i DESC LIMIT 1)) USING (i)"""


def narrowed_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name one, several or none of their documents' products."""
    p = V.table(spark, sf_dir, "part")
    said = F.concat("p_name", F.when(F.col("p_size") % 4 == 0, " in SR650").when(F.col("p_size") % 4 == 1, " SR650a and SR630").when(F.col("p_size") % 4 == 2, " SR630.").otherwise(""))
    own = F.array(F.lit("ThinkSystem SR650 V4"), F.lit("ThinkSystem SR630 V4"))
    return p.select("p_partkey", F.array_join(T.narrow_products(said, own), "|").alias("products"))


NARROW_SQL = """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ThinkSystem SR650 V4' WHEN 2 THEN 'ThinkSystem SR630 V4' ELSE 'ThinkSystem SR650 V4|ThinkSystem SR630 V4' END AS products FROM part"""


def path_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sparse, exact and trigram paths look for in questions about
    parts, some under a product filter."""
    p = V.table(spark, sf_dir, "part")
    terms = F.concat(F.array(F.lit("SR650"), F.lit("v4")), F.when(F.col("p_size") % 3 > 0, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("메모리"))).otherwise(F.array().cast("array<string>")))
    products = F.when(F.col("p_size") % 5 > 0, F.array(F.lit("ThinkSystem SR650 V4"))).otherwise(F.array().cast("array<string>"))
    asked = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, "메모리 용량은").otherwise(F.col("p_name")).alias("q"), terms.alias("t"), products.alias("own"), F.array(F.lit("SR650"), F.lit("V4"), F.lit("4X97B17362")).alias("i"))
    sparse = sparse_terms(F.col("t"), F.col("own"), F.size("own") > 0)
    return asked.select("p_partkey", websearch(sparse, " OR ").alias("sparse"), websearch(beside_model(F.col("i"), F.col("own")), " ").alias("exact"), trigram_text(F.col("q"), F.col("t")).alias("trigram"))


PATHS_SQL = """WITH q AS (SELECT p_partkey, p_size, p_name, list_concat(list_concat(['SR650', 'v4'], CASE WHEN p_size % 3 > 0 THEN string_split(p_type, ' ') ELSE [] END), CASE WHEN p_size % 2 = 0 THEN ['메모리'] ELSE [] END) AS t, p_size % 5 > 0 AS named FROM part),
k AS (SELECT *, CASE WHEN named THEN list_filter(t, lambda x: NOT list_contains(['thinksystem', 'sr650', 'v4'], lower(x))) ELSE t END AS kept, list_filter(t, lambda x: (x = '메모리') = (p_size % 2 = 0)) AS own FROM q)
SELECT p_partkey, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE t END, ' OR ') AS sparse, CASE WHEN named THEN '4X97B17362' ELSE 'SR650 4X97B17362' END AS exact,
  array_to_string(own, ' ') AS trigram FROM k"""


_ALL = (boilerplate_keys, boilerplate_removed, section_asof, forward_fill_labels, long_prose_windows, token_estimate, content_hash_dups, cell_normalise, word_tokens, strip_particles, identifier_extract, products_found, grounding_unsupported, citation_parse, citation_render, intent_classify, analyze_questions, hash_embedding, chunk_documents, table_key_values, unit_notes, scanned_documents, sync_plan, skip_known_files, upsert_documents, latest_version, doc_rollup, draft_candidates, draft_picks, narrowed_products, path_queries)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "boilerplate_keys": f"WITH {KEYS} SELECT doc, key, pages FROM b", "boilerplate_removed": REMOVED_SQL, "section_asof": ASOF_SQL, "forward_fill_labels": FILL_SQL, "long_prose_windows": WINDOWS_SQL, "token_estimate": TOKENS_SQL,
    "content_hash_dups": DUPS_SQL, "cell_normalise": CELL_SQL, "word_tokens": WORDS_SQL, "strip_particles": PARTICLES_SQL, "identifier_extract": IDENT_SQL, "products_found": PRODUCTS_SQL, "grounding_unsupported": GROUNDING_SQL,
    "citation_parse": CITED_SQL, "citation_render": RENDER_SQL, "intent_classify": INTENT_SQL, "table_key_values": TABLE_SQL, "unit_notes": UNITS_SQL, "scanned_documents": SCANNED_SQL, "sync_plan": SYNC_SQL, "skip_known_files": SKIP_SQL,
    "upsert_documents": UPSERT_SQL, "latest_version": LATEST_SQL, "doc_rollup": ROLLUP_SQL, "draft_candidates": DRAFT_SQL, "chunk_documents": CHUNK_SQL, "draft_picks": PICK_SQL, "narrowed_products": NARROW_SQL, "path_queries": PATHS_SQL,
}
