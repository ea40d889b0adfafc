"""Queries: search paths, fusion, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.embedding import EchoGenerator, HashEmbedder, embedded
from corvane.operators import answering, ranking, search
from corvane.plans import views as V
from corvane.settings import Settings

TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+|[가-힣]+')"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as questions, each with the vector of its number."""
    b, e = V.table(spark, sf_dir, "benchmark"), V.table(spark, sf_dir, "embeddings")
    return b.join(e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id", "left").select(F.col("item_id").alias("query_id"), F.array("text").alias("terms"), "vector")


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked, s = V.document_chunks(spark, sf_dir), _questions(spark, sf_dir), Settings()
    paths = {"dense": search.dense(asked, chunks, s.search_candidates), "sparse": search.sparse(asked, _contents(spark, sf_dir), s.search_candidates)}
    fused = search.fuse(paths, s.path_weights, s.rrf_k, s.search_candidates)
    named = fused.join(chunks.select(F.col("id").alias("chunk_id"), "content_hash"), "chunk_id")
    return search.dedupe(named, F.col("content_hash")).where(F.col("rank") <= s.search_top_k).select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


SPARSE_SQL = f"""
words AS (SELECT doc_id AS chunk_id, {TOKENS.format('text')} AS w FROM documents),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT chunk_id, unnest(w) AS term, len(w) AS n FROM words) GROUP BY 1, 2),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark),
sparse_s AS (SELECT query_id, chunk_id, round(0.1 * sum(tf) / (1 + ln(max(n))), 9) AS score FROM post JOIN asked USING (term) GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sparse_s QUALIFY rank <= 50)"""
COSINE = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9)"
HYBRID_SQL = f"""WITH {SPARSE_SQL},
dense_s AS (SELECT q.item_id AS query_id, d.doc_id AS chunk_id, {COSINE} AS score
  FROM benchmark q JOIN embeddings b ON b.vec_id = q.item_id, documents d JOIN embeddings a ON a.vec_id = d.doc_id),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_s QUALIFY rank <= 50),
both_ AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS s FROM dense UNION ALL SELECT query_id, chunk_id, 1.0 / (60 + rank) FROM sparse),
fused AS (SELECT query_id, chunk_id, round(sum(CAST(s AS DOUBLE)), 9) AS score FROM both_ GROUP BY 1, 2),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM fused QUALIFY r <= 50),
once AS (SELECT c.*, row_number() OVER (PARTITION BY query_id, md5(d.text) ORDER BY r) AS n FROM cut c JOIN documents d ON d.doc_id = c.chunk_id QUALIFY n = 1)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r) AS INT) AS rank FROM once QUALIFY rank <= 10"""


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "embeddings")
    asked = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.dense(asked, e.select(F.col("vec_id").alias("id"), "embedding"), 10).select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


DENSE_SQL = f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, {COSINE} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM s QUALIFY rank <= 10"""


def sparse_or_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.sparse(_questions(spark, sf_dir), _contents(spark, sf_dir), 50).select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


SPARSE_TOP_SQL = f"WITH {SPARSE_SQL} SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM sparse"


def _brand_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    return p.select("p_brand", "p_type").distinct().select(F.concat_ws("|", "p_brand", "p_type").alias("query_id"), F.array("p_brand").alias("identifiers"), F.array("p_brand").alias("products"), F.split("p_type", " ").alias("terms"), F.lit("spec").alias("intent"), F.col("p_type").alias("trigram_text"))


def exact_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with all words of a brand."""
    chunks = V.part_chunks(spark, sf_dir).select("id", "content")
    asked = V.table(spark, sf_dir, "part").select("p_brand").distinct().select(F.col("p_brand").alias("query_id"), F.array("p_brand").alias("identifiers"))
    found = search.exact(asked, search.postings(chunks, only=search.asked_terms(asked, "identifiers")), 50)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


EXACT_SQL = f"""WITH {V.PART_CHUNKS},
w AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT id, {TOKENS.format('content')} AS t FROM part_chunks)),
q AS (SELECT DISTINCT p_brand AS query_id, {TOKENS.format('p_brand')} AS t FROM part),
qt AS (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS k FROM q),
occ AS (SELECT query_id, id AS chunk_id, k, pos FROM w JOIN qt USING (term)),
seen AS (SELECT query_id, chunk_id FROM occ GROUP BY 1, 2 HAVING count(DISTINCT k) = 2),
step AS (SELECT o.query_id, o.chunk_id, o.pos,
  max(CASE WHEN k = 0 THEN pos END) OVER w AS p0, max(CASE WHEN k = 1 THEN pos END) OVER w AS p1
  FROM occ o JOIN seen USING (query_id, chunk_id) WINDOW w AS (PARTITION BY o.query_id, o.chunk_id ORDER BY pos)),
cover AS (SELECT *, least(p0, p1) AS s, lag(CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN least(p0, p1) ELSE -1 END, 1, -1) OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS before FROM step),
scored AS (SELECT query_id, chunk_id, round(sum(0.1 / greatest(1, pos - s)), 9) AS score FROM cover WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND s > before GROUP BY 1, 2)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM scored QUALIFY rank <= 50"""


def trigram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by word similarity to each part type."""
    chunks = V.part_chunks(spark, sf_dir).select("id", "content")
    asked = V.table(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("query_id"), F.col("p_type").alias("trigram_text"))
    return search.trigram(asked, chunks, 50).select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


_GRAMS = "list_transform(range(1, length({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3))"
TRIGRAM_TOP_SQL = f"""WITH {V.PART_CHUNKS},
w AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT id, regexp_extract_all(lower(content), '\\w+') AS w FROM part_chunks)),
g AS (SELECT id, i, {_GRAMS.format("w")} AS l FROM w),
seq AS (SELECT id, flatten(list(list_filter(l, lambda x, k: list_position(l, x) = k) ORDER BY i)) AS s FROM g GROUP BY 1),
q AS (SELECT query_id, list_distinct(flatten(list({_GRAMS.format("w")}))) AS want FROM (SELECT p_type AS query_id, unnest(regexp_extract_all(lower(p_type), '\\w+')) AS w FROM (SELECT DISTINCT p_type FROM part)) GROUP BY 1),
met AS (SELECT query_id, id, want, s, list_filter(range(1, len(s) + 1), lambda i: list_contains(want, s[i])) AS hits FROM seq, q),
a AS (SELECT *, unnest(hits) AS a FROM met),
ab AS (SELECT query_id, id, want, s, a, unnest(list_filter(hits, lambda b: b >= a)) AS b FROM a),
best AS (SELECT query_id, id AS chunk_id, round(max(len(list_intersect(s[a:b], want)) / (len(want) + len(list_distinct(s[a:b])) - len(list_intersect(s[a:b], want)))), 9) AS score FROM ab GROUP BY 1, 2)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank FROM best WHERE score >= 0.6 QUALIFY rank <= 50"""


def trigram_set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations with a common trigram, by Jaccard of their trigrams."""
    n = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("content"))
    grams = search.gram_index(n)
    size = grams.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = grams.join(size, "chunk_id").alias("a"), grams.join(size, "chunk_id").alias("b")
    both = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.chunk_id") < F.col("b.chunk_id"))).groupBy(F.col("a.chunk_id").alias("left_id"), F.col("b.chunk_id").alias("right_id")).agg(F.count(F.lit(1)).alias("c"), F.max("a.n").alias("x"), F.max("b.n").alias("y"))
    return both.select("left_id", "right_id", F.round(F.col("c") / (F.col("x") + F.col("y") - F.col("c")), 6).alias("similarity"))


TRIGRAM_SQL = """WITH w AS (SELECT DISTINCT n_nationkey AS id, '  ' || unnest(regexp_extract_all(lower(n_name), '\\w+')) || ' ' AS w FROM nation),
g AS (SELECT DISTINCT id, substr(w, i, 3) AS gram FROM (SELECT id, w, unnest(range(1, length(w) - 1)) AS i FROM w)),
s AS (SELECT id, count(*) AS n FROM g GROUP BY 1)
SELECT a.id AS left_id, b.id AS right_id, round(count(*) / (max(x.n) + max(y.n) - count(*)), 6) AS similarity
FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id JOIN s x ON x.id = a.id JOIN s y ON y.id = b.id GROUP BY 1, 2"""


def acl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the groups en and es, one without groups, and one
    without a limit see; French documents are public."""
    d = V.table(spark, sf_dir, "documents").withColumn("acl", F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.array("lang")))
    out = None
    for name, groups in (("en+es", ["en", "es"]), ("none", []), ("all", None)):
        part = d.where(search.acl_predicate(F.col("acl"), groups)).groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("reader"), "source", "n")
        out = part if out is None else out.unionByName(part)
    return out


ACL_SQL = """SELECT 'en+es' AS reader, source, count(*) AS n FROM documents WHERE lang IN ('fr', 'en', 'es') GROUP BY 2
UNION ALL SELECT 'none', source, count(*) FROM documents WHERE lang = 'fr' GROUP BY 2 UNION ALL SELECT 'all', source, count(*) FROM documents GROUP BY 2"""


def product_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = V.part_chunks(spark, sf_dir).withColumns({"status": F.lit("indexed"), "acl_groups": F.array().cast("array<string>")})
    return chunks.where(search.Filters(products=["Brand#11", "Brand#23"], document_ids=list(range(1, 31))).predicate()).groupBy("section_path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


OVERLAP_SQL = "SELECT p_type AS section_path, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') AND p_size BETWEEN 1 AND 30 GROUP BY 1"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and type as ranked hits, best price first."""
    c = V.part_chunks(spark, sf_dir)
    asked = c.withColumn("query_id", F.col("products")[0])
    return search.top(asked, 1_000_000_000, F.desc("p_retailprice"), F.asc("id")).withColumnRenamed("id", "chunk_id")


RANKED_SQL = f"{V.PART_CHUNKS}, ranked AS (SELECT *, product AS query_id, id AS chunk_id, row_number() OVER (PARTITION BY product ORDER BY p_retailprice DESC, id) AS rank FROM part_chunks)"


def section_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cap_sections(_ranked(spark, sf_dir), 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


CAP_SQL = f"""WITH {RANKED_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id, section_path ORDER BY rank) > 3 AS late FROM ranked)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS INT) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY late, rank) <= 10"""


def diversify_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _ranked(spark, sf_dir).where("rank <= 30").select("query_id", "chunk_id", "rank", "content", "document_id", "section_path")
    return ranking.diversify(hits, 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


DIVERSE_SQL = f"""WITH RECURSIVE {RANKED_SQL},
h AS (SELECT query_id, chunk_id, rank, document_id, section_path, list_distinct({TOKENS.format("substr(content, strpos(content, chr(10)) + 1)")}) AS w FROM ranked WHERE rank <= 30),
st AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(c BIGINT, d BIGINT, s VARCHAR, w VARCHAR[])[]) AS picked, CAST([] AS BIGINT[]) AS later FROM h
  UNION ALL SELECT query_id, rank, CASE WHEN ok THEN list_append(picked, {{'c': chunk_id, 'd': document_id, 's': section_path, 'w': w}}) ELSE picked END, CASE WHEN ok THEN later ELSE list_append(later, chunk_id) END
  FROM (SELECT st.query_id, h.rank, picked, later, h.chunk_id, h.document_id, h.section_path, h.w,
    len(picked) < 10 AND len(list_filter(picked, lambda x: x.d = h.document_id AND x.s = h.section_path)) < 3
    AND len(list_filter(picked, lambda x: len(list_intersect(x.w, h.w)) / len(list_distinct(list_concat(x.w, h.w))) >= 0.9)) = 0 AS ok
    FROM st JOIN h ON h.query_id = st.query_id AND h.rank = st.i + 1)),
done AS (SELECT query_id, list_concat(list_transform(picked, lambda x: x.c), later)[1:10] AS c FROM st QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i DESC) = 1)
SELECT query_id, unnest(c) AS chunk_id, CAST(unnest(range(1, len(c) + 1)) AS INT) AS rank FROM done"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand and type: the parts of that type as candidates."""
    c = V.part_chunks(spark, sf_dir).withColumnRenamed("id", "chunk_id")
    asked = V.table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    met = c.join(asked, F.col("section_path") == F.col("p_type")).withColumn("query_id", F.concat_ws("|", "p_brand", "p_type"))
    scored = met.withColumn("score", F.round(F.col("p_retailprice") / 1000, 6)).withColumn("paths", F.create_map(F.lit("sparse"), F.lit(1)))
    return search.top(scored, 30, F.desc("score"), F.asc("chunk_id"))


def rules_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rules(_brand_questions(spark, sf_dir), _hits(spark, sf_dir), 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


RULES_SQL = f"""WITH {V.PART_CHUNKS}, q AS (SELECT DISTINCT p_brand || '|' || p_type AS query_id, p_brand, p_type FROM part),
m AS (SELECT query_id, p_brand, p_type, c.*, id AS chunk_id, round(p_retailprice / 1000, 6) AS s FROM part_chunks c JOIN q ON c.section_path = q.p_type),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM m QUALIFY r <= 30),
t AS (SELECT query_id, any_value(lower(p_brand)) AS ident, bool_or(contains(lower(content), lower(p_brand))) AS ident_seen, list_distinct(list_transform(string_split(any_value(p_type), ' '), lambda x: lower(x))) AS terms FROM h GROUP BY 1),
f AS (SELECT h.*, 3.0 * CASE WHEN contains(lower(content), t.ident) THEN 1 ELSE 0 END + 1.5 * CASE WHEN product = p_brand THEN 1 ELSE 0 END
  + 1.5 * len(list_filter(t.terms, lambda x: contains(lower(content), x))) / len(t.terms) + 1.6 * len(list_filter(t.terms, lambda x: contains('name brand type size', x))) / len(t.terms)
  + 1.0 * len(list_filter(t.terms, lambda x: contains(lower(section_path), x))) / len(t.terms) + 0.8 + 0.6 / 3.0 + 2.0 * s / max(s) OVER (PARTITION BY h.query_id) AS score
  FROM h JOIN t USING (query_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, r) AS rank FROM f QUALIFY rank <= 10)
SELECT query_id, chunk_id, round(round(score, 9), 6) AS score, CAST(rank AS INT) AS rank FROM g"""


def discriminating_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir).select("query_id", F.array(F.lit("no-such-code")).alias("identifiers"), F.flatten(F.transform("terms", T.tokens)).alias("terms"))
    hits = V.table(spark, sf_dir, "benchmark").select(((F.col("item_id") + 1)).alias("query_id"), F.col("text").alias("content"))
    found = ranking.discriminating(asked, hits)
    return found.select("query_id", F.array_join("idents", ",").alias("idents"), F.array_join(F.array_sort(F.array_distinct("terms")), ",").alias("terms"))


DISCRIMINATING_SQL = f"""WITH q AS (SELECT item_id AS query_id, list_distinct({TOKENS.format('text')}) AS terms FROM benchmark),
k AS (SELECT q.query_id, q.terms, list_filter(q.terms, lambda x: contains(lower(b.text), x)) AS seen FROM q LEFT JOIN benchmark b ON b.item_id + 1 = q.query_id)
SELECT query_id, 'no-such-code' AS idents, array_to_string(list_sort(CASE WHEN len(coalesce(seen, [])) > 0 THEN seen ELSE terms END), ',') AS terms FROM k"""


def interleave_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each type, a comparison of three brands, round robin."""
    c = V.part_chunks(spark, sf_dir).withColumnRenamed("id", "chunk_id")
    brands = F.array(*map(F.lit, ["Brand#11", "Brand#22", "Brand#33"]))
    rows = c.where(F.arrays_overlap("products", brands)).withColumn("product_no", F.array_position(brands, F.col("products")[0]))
    ranked = rows.withColumn("pq", F.concat_ws("|", "section_path", "product_no"))
    each = search.top(ranked, search.per_product(10, 3), F.desc("p_retailprice"), F.asc("chunk_id"), by="pq").withColumn("query_id", F.col("section_path"))
    return search.interleave(each, 10).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


INTERLEAVE_SQL = """WITH b AS (SELECT *, list_position(['Brand#11', 'Brand#22', 'Brand#33'], p_brand) AS no FROM part WHERE p_brand IN ('Brand#11', 'Brand#22', 'Brand#33')),
e AS (SELECT *, row_number() OVER (PARTITION BY p_type, no ORDER BY p_retailprice DESC, p_partkey) AS r FROM b QUALIFY r <= 4)
SELECT p_type AS query_id, p_partkey AS chunk_id, CAST(row_number() OVER (PARTITION BY p_type ORDER BY r, no) AS INT) AS rank FROM e QUALIFY rank <= 10"""


def neighbor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = V.part_chunks(spark, sf_dir).withColumn("document_id", F.lit(1).cast("long"))
    hits = chunks.select(F.lit("q").alias("query_id"), F.col("id").alias("chunk_id"), "document_id", "ordinal", "kind")
    return search.neighbours(hits, chunks, 1).select("chunk_id", F.array_join("neighbours", "|").alias("neighbours"))


NEIGHBOR_SQL = """SELECT a.p_partkey AS chunk_id, coalesce(string_agg('size: ' || CAST(b.p_size AS VARCHAR) || ' mm', '|' ORDER BY b.p_partkey), '') AS neighbours
FROM part a LEFT JOIN (SELECT p_partkey, p_size, p_partkey - 1 AS beside FROM part UNION ALL SELECT p_partkey, p_size, p_partkey + 1 FROM part) b ON b.beside = a.p_partkey GROUP BY 1"""


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.length("text").alias("n"))
    ranked = search.top(d, 1_000_000_000, F.asc("chunk_id"))
    return search.within_budget(ranked, F.col("n") + 60, Settings().context_chars).select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank"))


BUDGET_SQL = """WITH r AS (SELECT source AS query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, sum(length(text) + 60) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents)
SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM r WHERE rank = 1 OR used <= 14449"""


def answer_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole path from questions to judged answers with the test providers."""
    embedder = HashEmbedder(64)
    chunks = V.part_chunks(spark, sf_dir).withColumns({"embedding": embedded(F.col("content"), embedder), "page_from": F.lit(1), "page_to": F.lit(1), "content_hash": F.md5("content"), "token_count": T.token_estimate(F.col("content"))}).drop("p_retailprice")
    docs = chunks.select(F.col("document_id").alias("id")).distinct().select("id", F.concat(F.lit("Guide "), "id").alias("title"), F.concat(F.lit("guide"), "id", F.lit(".pdf")).alias("source_path"), F.lit("indexed").alias("status"), F.array().cast("array<string>").alias("acl_groups"))
    asked = V.table(spark, sf_dir, "part").select("p_type").distinct().select(F.col("p_type").alias("query_id"), F.concat(F.lit("What is the size of "), F.lower("p_type"), F.lit("?")).alias("question"))
    hits = answering.retrieve(asked, chunks, docs, embedder)
    return answering.answer_batch(asked, hits, EchoGenerator()).select("query_id", "answer", "answered", "grounded", F.size("cited").alias("n_cited"), F.array_join("unsupported", ",").alias("unsupported"))


QUERIES = {f.__name__: f for f in (hybrid_rrf, dense_topk, sparse_or_topk, exact_and, trigram_topk, trigram_set_similarity, acl_filter, product_overlap, section_cap, diversify_greedy, rules_rerank, discriminating_terms, interleave_products, neighbor_rows, context_budget, answer_echo)}
ORACLES = {"hybrid_rrf": HYBRID_SQL, "dense_topk": DENSE_SQL, "sparse_or_topk": SPARSE_TOP_SQL, "exact_and": EXACT_SQL, "trigram_topk": TRIGRAM_TOP_SQL, "trigram_set_similarity": TRIGRAM_SQL, "acl_filter": ACL_SQL, "product_overlap": OVERLAP_SQL, "section_cap": CAP_SQL, "diversify_greedy": DIVERSE_SQL, "rules_rerank": RULES_SQL, "discriminating_terms": DISCRIMINATING_SQL, "interleave_products": INTERLEAVE_SQL, "neighbor_rows": NEIGHBOR_SQL, "context_budget": BUDGET_SQL}
