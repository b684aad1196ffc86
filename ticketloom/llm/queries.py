"""The registered queries of this subpackage and, where SQL can say them, their statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import exact_dedup as exact
from ticketloom.llm import jaccard_join as jaccard
from ticketloom.llm import licenses, line_dedup, mixing, source_audit, vector_codes, vector_dedup
from ticketloom.llm import quality_net as net
from ticketloom.llm import quality_rules as rules
from ticketloom.llm import sentencepieces as pieces
from ticketloom.llm import token_counts as tokens
from ticketloom.llm import toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op9_exact_dedup",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS l, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k,
             count(*) OVER (PARTITION BY h) AS group_size
      FROM n WINDOW w AS (PARTITION BY h ORDER BY l DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM g""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir)).drop("row")


@query(
    "op6_quality_rules",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
h AS (SELECT r, i, [ws[i], ws[i + 1], ws[i + 2]] AS x FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS n FROM h),
k AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM c WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, t, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS caps, length(regexp_replace(t, '[^!?]+', '', 'g')) AS marks
      FROM d JOIN w USING (r) LEFT JOIN k USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * caps > 50 * word_chars OR 2 * marks > n_words OR word_chars > 20 * n_words) AS kept
FROM m""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = rules.cascade(documents(spark, sf_dir), report=base)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *base, failed.alias("base_failed"), "kept")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


@query("op2_mix_sources")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


@query("op4_license_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


@query(
    "op1_line_dedup",
    r"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line, unnest(x) AS t
           FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos
      FROM (SELECT *, len(regexp_extract_all(t, '[^ 	-
]+')) AS n FROM l) WHERE n > 0),
s AS (SELECT doc_id, pos, list(n) OVER a AS na, list(t) OVER a AS ta, list(n) OVER b AS nb, list(t) OVER b AS tb
      FROM w WINDOW a AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING),
                    b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, list_filter(range(1, len(na) + 1), lambda k: list_sum(na[1:k]) >= 50)[1] AS ka,
             list_filter(range(1, len(nb) + 1), lambda k: list_sum(nb[len(nb) - k + 1:]) >= 50)[1] AS kb FROM s),
p AS (SELECT doc_id, pos, ka AS k, ta[1:ka] AS run FROM r WHERE ka IS NOT NULL
      UNION SELECT doc_id, pos - kb + 1, kb, tb[len(tb) - kb + 1:] FROM r WHERE kb IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS copy FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS pos FROM o WHERE copy > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, count(w.pos) - count(g.pos) AS n_worded_left,
             coalesce(string_agg(l.t, chr(10) ORDER BY l.line) FILTER (WHERE g.pos IS NULL), '') AS text
      FROM l LEFT JOIN w USING (doc_id, line) LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = w.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_worded_left, 0) AS n_worded_left, k.text FROM documents d LEFT JOIN k USING (doc_id)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op7_quality_net")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoding_digest(documents(spark, sf_dir), pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def codes_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds written out, one after the other."""
    xs = [f"x{k}" for k in range(width)]
    distance = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in xs)
    cut = ", ".join(f"v[{width} * p + {k + 1}] AS x{k}" for k in range(width))
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT a.r, a.p, min(struct_pack(d := {distance}, e := b.e)) AS m FROM parts a JOIN b{r} b USING (p) GROUP BY ALL)"
        )
        if r < rounds:
            new = ", ".join(f"coalesce((s.{x} - ((s.{x} % s.n) + s.n) % s.n) // s.n, b.{x})::BIGINT AS {x}" for x in xs)
            sums = ", ".join(f"sum(parts.{x}) AS {x}" for x in xs)
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, {new} FROM b{r} b LEFT JOIN (SELECT p, m.e AS e, count(*) AS n, {sums} "
                f"FROM a{r} JOIN parts USING (r, p) GROUP BY ALL) s USING (p, e))"
            )
    decimals = " || ',' || ".join(xs)
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
                  list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, {cut} FROM k, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, {", ".join(xs)} FROM parts WHERE r <= {entries}),
{(chr(10)).join(s + "," for s in steps)}
c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg({decimals}, ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN k USING (r)"""


@query("op11_vector_codes", codes_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(embeddings(spark, sf_dir))


@query(
    "op12_source_audit",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term FROM c GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
f AS (SELECT lang, source, term, coalesce(n, 0) AS n, v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n,
             (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v))::BIGINT AS p FROM f),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v))::BIGINT AS q
      FROM (SELECT lang, term, v, sum(n) AS n FROM f GROUP BY ALL)),
o AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
           LEFT JOIN o ON o.lang = a.lang AND o.source = a.source AND o.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
z AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u)
SELECT * FROM z WHERE part = 'pair' OR rank <= 10""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(documents(spark, sf_dir))


@query(
    "op13_vector_dedup",
    """
WITH RECURSIVE u AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id FROM u a JOIN u b ON a.r <> b.r
                   WHERE list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) >= 0.95),
x AS (SELECT r AS a, r AS b FROM u UNION SELECT x.a, l.b FROM x JOIN l ON x.b = l.a),
c AS (SELECT x.a AS r, min(vec_id) AS component_id FROM x JOIN u ON u.r = x.b GROUP BY x.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM u JOIN c USING (r) LEFT JOIN n USING (r)
UNION ALL SELECT vec_id, 0, vec_id, true FROM embeddings
WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(embeddings(spark, sf_dir))
