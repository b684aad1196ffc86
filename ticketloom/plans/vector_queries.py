"""Queries for vectors, similarity search and retrieval.

Query sets are derived from the data: class centroids, the first row of every
class, a sample of every class, or the benchmark texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions import constants as K
from ticketloom.functions import text as T
from ticketloom.operators import evaluate as E
from ticketloom.operators import sampling as X
from ticketloom.operators import terms as R
from ticketloom.operators import vectors as V
from ticketloom.operators.neighbours import NeighbourIndex, recall
from ticketloom.plans import sqltext as Q
from ticketloom.plans.label_queries import hash_rank_sql
from ticketloom.plans.registry import query, table, text_table
from ticketloom.plans.text_queries import template_sql

DIM = 64


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("category")
    )


CORPUS_SQL = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS category FROM embeddings"


def topk_sql(queries: str, corpus: str, k: int, extra: str = "true") -> str:
    """Exact cosine top-k of (qid, vec) against (id, vec, ...); a zero vector is similar to nothing."""
    cosine = "list_cosine_similarity(q.vec, c.vec)"
    return f"""
    SELECT qid, id, score, rank FROM (
        SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
            SELECT q.qid, c.id, CASE WHEN isnan({cosine}) THEN 0 ELSE round({cosine}, 6) END AS score
            FROM ({queries}) q JOIN ({corpus}) c ON {extra}))
    WHERE rank <= {k}
    """


# --- profiles ----------------------------------------------------------------------
PARTS_SQL = """
SELECT label, pos, avg(x::DOUBLE) AS value
FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos
"""


@query("category_centroids", f"SELECT label, pos, round(value, 6) AS value FROM ({PARTS_SQL})")
def category_centroids(spark, sf_dir):
    centroids = V.category_centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return centroids.select("label", F.posexplode("centroid").alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "centroid_similarity",
    f"""
    WITH c AS (SELECT label, list(value ORDER BY pos) AS vec FROM ({PARTS_SQL}) GROUP BY label)
    SELECT a.label AS class_a, b.label AS class_b, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity
    FROM c a JOIN c b ON a.label < b.label
    """,
)
def centroid_similarity(spark, sf_dir):
    return V.centroid_similarity(table(spark, sf_dir, "embeddings"), "label", "embedding")


@query(
    "vector_profile",
    """
    SELECT count(*) AS n, max(len(embedding)) AS dim, round(min(list_min(embedding))::DOUBLE, 6) AS min_value,
           round(max(list_max(embedding))::DOUBLE, 6) AS max_value,
           round(sum(list_sum(embedding::DOUBLE[])) / sum(len(embedding)), 6) AS mean_value FROM embeddings
    """,
)
def vector_profile(spark, sf_dir):
    return V.vector_profile(table(spark, sf_dir, "embeddings"), "embedding")


@query(
    "attach_vectors",
    "SELECT d.doc_id, d.lang, e.label, len(e.embedding) AS dim FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id",
)
def attach_vectors(spark, sf_dir):
    documents = text_table(spark, sf_dir, "documents").select("doc_id", "lang")
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return V.attach_vectors(documents, vectors, "doc_id").select(
        "doc_id", "lang", "label", F.size("embedding").alias("dim")
    )


# --- search ------------------------------------------------------------------------
def _centroid_queries(spark, sf_dir):
    return V.category_centroids(_vectors(spark, sf_dir), "category", "vec", "vec").withColumnRenamed("category", "qid")


CENTROID_QUERIES_SQL = f"SELECT label AS qid, list(value ORDER BY pos) AS vec FROM ({PARTS_SQL}) GROUP BY label"


@query("query_corpus_scores", topk_sql(CENTROID_QUERIES_SQL, CORPUS_SQL, 20))
def query_corpus_scores(spark, sf_dir):
    """Class centroids against the whole corpus."""
    return V.search(_centroid_queries(spark, sf_dir), _vectors(spark, sf_dir), k=20)


def _first_of_class(spark, sf_dir):
    return E.first_n(_vectors(spark, sf_dir), "category", "id", 1).select(F.col("id").alias("qid"), "vec", "category")


FIRST_SQL = (
    f"SELECT id AS qid, vec, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS r "
    f"FROM ({CORPUS_SQL})) WHERE r = 1"
)


@query("topk_per_query", topk_sql(FIRST_SQL, CORPUS_SQL, 5))
def topk_per_query(spark, sf_dir):
    return V.search(_first_of_class(spark, sf_dir), _vectors(spark, sf_dir), k=5)


@query("similar_by_id", topk_sql(FIRST_SQL, CORPUS_SQL, 5, "q.qid <> c.id"))
def similar_by_id(spark, sf_dir):
    """Neighbours of stored rows, the row itself excluded by id."""
    return V.search(_first_of_class(spark, sf_dir), _vectors(spark, sf_dir), k=5, exclude_self=True)


@query("similar_all", topk_sql(CORPUS_SQL.replace("vec_id AS id", "vec_id AS qid"), CORPUS_SQL, 3, "q.qid <> c.id"))
def similar_all(spark, sf_dir):
    """Every stored row as a query, on the block grid that large query sets use."""
    corpus = _vectors(spark, sf_dir)
    return V.search(corpus.withColumnRenamed("id", "qid"), corpus, k=3, exclude_self=True, max_shipped=0)


SAMPLED_SQL = (
    f"SELECT id AS qid, vec, category FROM (SELECT *, {hash_rank_sql('id', 'category')} AS r FROM ({CORPUS_SQL})) WHERE r <= 3"
)


@query("similar_in_category", topk_sql(SAMPLED_SQL, CORPUS_SQL, 3, "q.category = c.category AND q.qid <> c.id"))
def similar_in_category(spark, sf_dir):
    """A few random rows of every class against the rest of their class."""
    corpus = _vectors(spark, sf_dir)
    sampled = X.cap_per_class(corpus, "category", "id", 3).withColumnRenamed("id", "qid")
    return V.search(sampled, corpus, k=3, group="category", exclude_self=True)


CAPPED_SQL = f"SELECT id, vec, category FROM (SELECT *, {hash_rank_sql('id', 'category')} AS r FROM ({CORPUS_SQL})) WHERE r <= 2000"


@query("search_sampled", topk_sql(CENTROID_QUERIES_SQL, CAPPED_SQL, 5))
def search_sampled(spark, sf_dir):
    """Search over at most 2,000 rows per class: a balanced sample is the operator."""
    corpus = X.cap_per_class(_vectors(spark, sf_dir), "category", "id", 2000)
    return V.search(_centroid_queries(spark, sf_dir), corpus, k=5)


@query("search_filtered", topk_sql(CENTROID_QUERIES_SQL, f"SELECT * FROM ({CORPUS_SQL}) WHERE category IN (1, 2, 3)", 5))
def search_filtered(spark, sf_dir):
    condition = F.col("category").isin(1, 2, 3)
    return V.search_filtered(_centroid_queries(spark, sf_dir), _vectors(spark, sf_dir), condition, k=5)


# --- classification by neighbours --------------------------------------------------
KNN_SPLIT_SQL = f"""
SELECT *, {hash_rank_sql('id', 'category')} <= floor(count(*) OVER (PARTITION BY category) * 0.2::DOUBLE + 0.5::DOUBLE) AS is_test
FROM ({CORPUS_SQL})
"""
KNN_SQL = f"""
SELECT qid, first(category ORDER BY votes DESC, category) AS prediction, max(votes) AS votes FROM (
    SELECT qid, category, count(*) AS votes FROM (
        SELECT q.id AS qid, c.category,
               row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.vec, c.vec), 6), c.id) AS rank
        FROM (SELECT * FROM ({KNN_SPLIT_SQL}) WHERE is_test) q JOIN (SELECT * FROM ({KNN_SPLIT_SQL}) WHERE NOT is_test) c ON true)
    WHERE rank <= 10 GROUP BY qid, category)
GROUP BY qid
"""


@query("knn_classify", KNN_SQL)
def knn_classify(spark, sf_dir):
    """Ten nearest training vectors of every test vector."""
    split = X.stratified_split(_vectors(spark, sf_dir), "category", "id")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test").withColumnRenamed("id", "qid")
    return V.knn_classify(train, test, "category", "id", "qid", k=10)


@query("knn_classify_indexed")
def knn_classify_indexed(spark, sf_dir):
    """The same with a neighbour index over the training vectors."""
    split = X.stratified_split(_vectors(spark, sf_dir), "category", "id")
    train, test = split.filter(~F.col("is_test")), split.filter("is_test").withColumnRenamed("id", "qid")
    index = NeighbourIndex.build(train, metric="euclidean")
    return V.knn_classify(train, test, "category", "id", "qid", k=10, find=lambda rows: index.search(rows, 10))


@query("similar_all_indexed")
def similar_all_indexed(spark, sf_dir):
    """Every stored row as a query of the neighbour index: cells meet only the queries that look into them."""
    corpus = _vectors(spark, sf_dir)
    index = NeighbourIndex.build(corpus)
    return index.search(corpus.withColumnRenamed("id", "qid"), k=3, exclude_self=True)


@query("neighbour_recall", "SELECT 3 * count(*) AS possible, true AS recall_reached FROM embeddings")
def neighbour_recall(spark, sf_dir):
    """Whether the index finds nine of ten rows of the exact search, every row a query."""
    exact, found = similar_all(spark, sf_dir), similar_all_indexed(spark, sf_dir)
    return recall(exact, found).select("possible", (F.col("recall") >= 0.9).alias("recall_reached"))


# --- text search -------------------------------------------------------------------
def embed_sql(source: str, key: str, col: str, dim: int = DIM) -> str:
    """Hashed term counts of every text, scaled to unit length."""
    return f"""
    SELECT {key}, list_transform(counts, lambda x: CASE WHEN norm = 0 THEN 0::DOUBLE ELSE CAST((x / norm) AS FLOAT)::DOUBLE END) AS vec
    FROM (SELECT {key}, counts, sqrt(list_sum(list_transform(counts, lambda x: x * x))) AS norm
          FROM (SELECT {key}, list(coalesce(n, 0)::DOUBLE ORDER BY b) AS counts
                FROM (SELECT {key}, b FROM (SELECT {key} FROM ({source})), generate_series(0, {dim - 1}) AS g(b))
                LEFT JOIN (SELECT {key}, b, count(*) AS n
                           FROM (SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {dim} AS b
                                 FROM (SELECT {key}, unnest({Q.tokens(col)}) AS term FROM ({source})))
                           GROUP BY {key}, b) USING ({key}, b)
                GROUP BY {key}))
    """


def _embedded_documents(spark, sf_dir):
    documents = text_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        "text",
        T.clean_query_text(F.col("text")).alias("clean_text"),
        F.col("lang").alias("category"),
    )
    return V.embed_texts(documents, "clean_text", "vec", DIM)


def _embedded_queries(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("qid"), "text", T.clean_query_text(F.col("text")).alias("clean_text")
    )
    return V.embed_texts(items, "clean_text", "vec", DIM)




def _clean_sql(source: str, key: str, name: str) -> str:
    return f"SELECT {key} AS {name}, clean_text FROM ({Q.query_text_sql(source, key, 'text')})"


DOC_VECTORS_SQL = embed_sql(_clean_sql("documents", "doc_id", "id"), "id", "clean_text")
ITEM_VECTORS_SQL = embed_sql(_clean_sql("benchmark", "item_id", "qid"), "qid", "clean_text")


@query(
    "embed_texts",
    f"SELECT id, len(vec) AS dim, round(list_sum(vec), 4) AS total, round(list_max(vec), 4) AS top FROM ({DOC_VECTORS_SQL})",
)
def embed_texts(spark, sf_dir):
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _embedded_documents(spark, sf_dir).select(
        "id",
        F.size("vec").alias("dim"),
        F.round(total, 4).alias("total"),
        F.round(F.array_max("vec").cast("double"), 4).alias("top"),
    )


TEXT_TOP_SQL = topk_sql(ITEM_VECTORS_SQL, DOC_VECTORS_SQL, 20)


def _text_results(spark, sf_dir, k=20):
    corpus = _embedded_documents(spark, sf_dir)
    results = V.search(_embedded_queries(spark, sf_dir), corpus, k=k)
    return results.join(corpus.select("id", "category"), "id")


@query(
    "search_by_text",
    f"SELECT qid, id, rank, round(score, 5) AS score, lang AS category FROM ({TEXT_TOP_SQL}) JOIN documents ON doc_id = id WHERE rank <= 5",
)
def search_by_text(spark, sf_dir):
    """Benchmark texts as free-text queries over all documents."""
    return _text_results(spark, sf_dir, 5).withColumn("score", F.round("score", 5)).select(
        "qid", "id", "rank", "score", "category"
    )


@query(
    "search_category_distribution",
    f"SELECT qid, lang AS category, count(*) AS n FROM ({TEXT_TOP_SQL}) JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY qid, lang",
)
def search_category_distribution(spark, sf_dir):
    return _text_results(spark, sf_dir, 5).groupBy("qid", "category").agg(F.count("*").alias("n"))


def _expected(spark, sf_dir):
    """Benchmark texts expect documents in English."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.lit("en").alias("expected"))


HITS_SQL = f"""
WITH top AS (SELECT qid, rank, lang AS category FROM ({TEXT_TOP_SQL}) JOIN documents ON doc_id = id),
     hits AS (SELECT i.item_id AS qid, 'en' AS expected, coalesce(bool_or(t.category = 'en'), false) AS hit,
                     min(t.rank) FILTER (t.category = 'en') AS rank,
                     coalesce(string_agg(t.category, ',' ORDER BY t.rank) FILTER (t.rank <= 3), '') AS top_categories,
                     coalesce(first(t.category ORDER BY t.rank), 'Unknown') AS top_category
              FROM benchmark i LEFT JOIN (SELECT * FROM top WHERE rank <= 5) t ON t.qid = i.item_id GROUP BY i.item_id)
"""


def _hits(spark, sf_dir):
    return E.rank_of_expected(_text_results(spark, sf_dir), _expected(spark, sf_dir), 5)


@query("rank_of_expected", f"{HITS_SQL} SELECT * FROM hits")
def rank_of_expected(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(
    "search_hit_rate",
    f"{HITS_SQL} SELECT count(*) AS queries, count(*) FILTER (hit) AS hits, "
    "round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS hit_rate FROM hits",
)
def search_hit_rate(spark, sf_dir):
    return E.search_hit_rate(_hits(spark, sf_dir))


@query("search_confusion", f"{HITS_SQL} SELECT expected, top_category AS actual, count(*) AS n FROM hits GROUP BY expected, top_category")
def search_confusion(spark, sf_dir):
    return E.search_confusion(_hits(spark, sf_dir))


@query(
    "search_accuracy_by_category",
    f"{HITS_SQL} SELECT expected, count(*) FILTER (hit) AS hits, count(*) AS queries, "
    "round(count(*) FILTER (hit)::DOUBLE / count(*), 6) AS accuracy FROM hits GROUP BY expected",
)
def search_accuracy_by_category(spark, sf_dir):
    return E.search_accuracy_by_category(_hits(spark, sf_dir))


VECTOR_HITS_SQL = f"""
WITH top AS (SELECT t.qid, t.rank, c.category FROM ({topk_sql(FIRST_SQL, CORPUS_SQL, 20, 'q.qid <> c.id')}) t
             JOIN ({CORPUS_SQL}) c ON c.id = t.id),
     misses AS (SELECT qid, category AS expected FROM ({FIRST_SQL}) f
                WHERE NOT EXISTS (SELECT 1 FROM top WHERE top.qid = f.qid AND rank <= 1 AND top.category = f.category))
SELECT qid, expected, top.category, count(*) AS n, round(count(*) * 100.0::DOUBLE / 20, 6) AS pct
FROM top JOIN misses USING (qid) GROUP BY qid, expected, top.category
"""


@query("search_miss_analysis", VECTOR_HITS_SQL)
def search_miss_analysis(spark, sf_dir):
    """Rows whose nearest neighbour is of another class: classes of their top 20."""
    corpus = _vectors(spark, sf_dir)
    queries = _first_of_class(spark, sf_dir)
    results = V.search(queries, corpus, k=20, exclude_self=True).join(corpus.select("id", "category"), "id")
    hits = E.rank_of_expected(results, queries.select("qid", F.col("category").alias("expected")), 1)
    return E.search_miss_analysis(results, hits, 20)


# --- two retrievers ----------------------------------------------------------------
LEXICAL_SQL = f"""
SELECT qid, id, score, rank FROM (
    SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
        WITH d AS (SELECT doc_id AS id, unnest({Q.tokens('text', K.ENGLISH_STOPWORDS)}) AS term FROM documents),
             tf AS (SELECT id, term, count(*) AS tf FROM d GROUP BY ALL),
             len AS (SELECT id, sum(tf) AS n FROM tf GROUP BY id),
             mean AS (SELECT coalesce(sum(n), 0)::DOUBLE / (SELECT count(*) FROM documents) AS mean FROM len),
             df AS (SELECT term, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf
                    FROM tf GROUP BY term),
             q AS (SELECT qid, term, count(*) AS n
                   FROM (SELECT item_id AS qid, unnest({Q.tokens('text', K.ENGLISH_STOPWORDS)}) AS term FROM benchmark) GROUP BY ALL)
        SELECT qid, id, round(sum(q.n * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len.n / mean))), 6) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (id), mean GROUP BY qid, id))
WHERE rank <= 5
"""


def _four_digits(col: str):
    """Rounded as a binary number: a decimal rounding moves values that only look like halves."""
    return F.floor(F.col(col) * 1e4 + 0.5) / 1e4


def _lexical(spark, sf_dir, k):
    """Benchmark texts against an inverted index of the documents, by BM25."""
    documents = text_table(spark, sf_dir, "documents")
    index = R.TermIndex.build(R.bm25_weights(R.term_lists(documents, "text", K.ENGLISH_STOPWORDS, keep=["doc_id"]), "doc_id"), "doc_id")
    items = R.term_lists(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "qid"), "text", K.ENGLISH_STOPWORDS, keep=["qid"])
    return index.top_k(R.counted_terms(items, "qid").withColumnRenamed("tf", "weight"), "qid", k)


@query("lexical_search", f"SELECT qid, id, rank, floor(score * 1e4 + 0.5) / 1e4 AS score FROM ({LEXICAL_SQL})")
def lexical_search(spark, sf_dir):
    return _lexical(spark, sf_dir, 5).select("qid", "id", "rank", _four_digits("score").alias("score"))


def _fused_sql(first: float, second: float) -> str:
    return f"""
    SELECT * FROM (
        SELECT qid, id, floor(score * 1e4 + 0.5) / 1e4 AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
            SELECT qid, id, round(coalesce(a.score, 0) * {first} + coalesce(b.score, 0) * {second}, 8) AS score
            FROM (SELECT * FROM ({TEXT_TOP_SQL}) WHERE rank <= 5) a FULL JOIN ({LEXICAL_SQL}) b USING (qid, id)))
    WHERE rank <= 5
    """


def _two_retrievers(spark, sf_dir, weights):
    by_vector = lambda k: V.search(_embedded_queries(spark, sf_dir), _embedded_documents(spark, sf_dir), k=k)
    found = V.hybrid_retrieve(by_vector, lambda k: _lexical(spark, sf_dir, k), weights)
    return found.withColumn("score", _four_digits("score"))


@query("hybrid_fusion", _fused_sql(0.5, 0.5))
def hybrid_fusion(spark, sf_dir):
    """Two result lists of the benchmark texts, by vector and by words, in equal parts."""
    return _two_retrievers(spark, sf_dir, (0.5, 0.5))


@query("hybrid_retrieve", _fused_sql(0.7, 0.3))
def hybrid_retrieve(spark, sf_dir):
    """Benchmark texts against all documents by vector and by words."""
    return _two_retrievers(spark, sf_dir, (0.7, 0.3))


# --- retrieval context -------------------------------------------------------------
CONTEXT_SQL = (
    f"SELECT qid, string_agg(text, chr(10) ORDER BY rank) AS context FROM ({TEXT_TOP_SQL}) JOIN documents ON doc_id = id "
    "WHERE rank <= 3 GROUP BY qid"
)


@query("rag_context", CONTEXT_SQL)
def rag_context(spark, sf_dir):
    results = V.search(_embedded_queries(spark, sf_dir), _embedded_documents(spark, sf_dir), k=3)
    documents = text_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.rag_context(results, documents, "qid", "id", "text")


_LISTING = "'" + "\n".join(f"- {c}" for c in K.TICKET_CATEGORIES) + "'"


@query(
    "rag_batch",
    f"""
    SELECT i.item_id AS qid, i.text AS ticket, c.context,
           {template_sql(K.CLASSIFICATION_TEMPLATE, categories=_LISTING, ticket_content='i.text', context='c.context')} AS prompt,
           v.response
    FROM benchmark i JOIN ({CONTEXT_SQL}) c ON c.qid = i.item_id
    JOIN (SELECT qid, first(lang ORDER BY n DESC, lang) AS response
          FROM (SELECT qid, lang, count(*) AS n FROM ({TEXT_TOP_SQL}) JOIN documents ON doc_id = id WHERE rank <= 3
                GROUP BY qid, lang) GROUP BY qid) v ON v.qid = i.item_id
    """,
)
def rag_batch(spark, sf_dir):
    """Context, prompt and neighbour-vote response for every benchmark text."""
    return V.rag_batch(_embedded_queries(spark, sf_dir), _embedded_documents(spark, sf_dir), K.TICKET_CATEGORIES, k=3)


