"""Exact, lexical, semantic and fused retrieval, with its indexes and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import postings, search
from quillstone.operators.digests import set_digest
from quillstone.registry import query
from quillstone.sources.shared import exists, shared_folder, state_of
from quillstone.sources.tables import table, units

#: The query that the registered searches run: a literal, its words, and the vector of one document.
LITERAL = "the and"
WORDS = ["the", "tion", "ing", "the"]
VECTOR_ID = 0
TOP = 20
#: Documents for each band of the index, up to 64 bands.
UNITS_OF_BAND = 50_000

_EXACT = f"""SELECT doc_id AS unit, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), '{LITERAL}')"""
TERMS_SQL = f"regexp_extract_all(translate(lower(text), '{X.MARKED}', '{X.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"
_BM25 = rf"""
WITH d AS (SELECT doc_id, {TERMS_SQL} AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
q(term, times) AS (VALUES ('the', 2), ('tion', 1), ('ing', 1)),
t AS (SELECT doc_id, len(w) AS size, term, times, len(list_filter(w, lambda x: x = term)) AS tf FROM d, q),
f AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM t GROUP BY term),
i AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 0.000001 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM f, s),
r AS (SELECT doc_id, round(-sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM t JOIN i USING (term), s WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id AS unit, score, row_number() OVER (ORDER BY score, doc_id) AS rank FROM r"""
_COSINE = """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
c AS (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(v, v)), 6) AS score FROM embeddings, q)
SELECT vec_id AS unit, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM c"""


def _units(spark: SparkSession, sf: str) -> DataFrame:
    return units(spark, sf).select(F.col("source_order").alias("unit"), "text")


def _exact(spark: SparkSession, sf: str) -> DataFrame:
    return search.exact(_units(spark, sf), LITERAL)


def published_index(spark: SparkSession, sf: str) -> str:
    """The folder of the index of the documents as their files are now; it is published when it is first asked for, by source."""
    docs = table(spark, sf, "documents")
    folder = f"{shared_folder(spark)}/quillstone-postings/{state_of(docs)}"
    if not exists(spark, f"{folder}/manifests/_SUCCESS"):
        bands = max(1, min(64, docs.count() // UNITS_OF_BAND))
        postings.publish(docs.select(F.col("source").alias("representation"), F.col("doc_id").alias("unit"), "text"), folder, bands)
    return folder


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    return postings.bm25(spark, published_index(spark, sf), WORDS)


def _semantic(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit"), "embedding")
    return search.cosine(vectors, vectors.where(F.col("unit") == VECTOR_ID).select("embedding"))


#: What an exact search selects.
SELECTED_SQL = f"SELECT * FROM ({_EXACT}) WHERE rank <= {TOP}"


@query(SELECTED_SQL)
def exact_search(spark: SparkSession, sf: str) -> DataFrame:
    """Units that hold a literal, in source order."""
    return search.top(_exact(spark, sf), [F.col("unit")], TOP).select("unit", "rank")


@query(f"SELECT * FROM ({_BM25}) WHERE rank <= {TOP}")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best units by BM25."""
    return search.top(_lexical(spark, sf), [F.col("score"), F.col("unit")], TOP).select("unit", "score", "rank")


@query(f"SELECT * FROM ({_COSINE}) WHERE rank <= {TOP}")
def semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best units by cosine."""
    return search.top(_semantic(spark, sf), [F.desc("score"), F.col("unit")], TOP).select("unit", "score", "rank")


_CHANNELS = f"""SELECT unit, 'exact' AS channel, rank FROM ({_EXACT}) WHERE rank <= {TOP} UNION ALL SELECT unit, 'lexical', rank FROM ({_BM25}) WHERE rank <= {TOP}
UNION ALL SELECT unit, 'semantic', rank FROM ({_COSINE}) WHERE rank <= {TOP}"""


@query(f"""SELECT unit, score, row_number() OVER (ORDER BY score DESC, unit) AS rank, row_number() OVER (ORDER BY score DESC, unit) <= {TOP} AS selected, channels
FROM (SELECT unit, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(channel, ',' ORDER BY channel) AS channels FROM ({_CHANNELS}) GROUP BY unit)""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal ranks of three channels, added; all candidates stay, the first are selected."""
    channels = {
        "exact": search.top(_exact(spark, sf), [F.col("unit")], TOP),
        "lexical": search.top(_lexical(spark, sf), [F.col("score"), F.col("unit")], TOP),
        "semantic": search.top(_semantic(spark, sf), [F.desc("score"), F.col("unit")], TOP),
    }
    return search.fuse(channels, TOP)


@query(f"""SELECT unit, row_number() OVER (ORDER BY e, r, unit) AS rank FROM (SELECT unit, min(CASE channel WHEN 'exact' THEN 0 ELSE 1 END) AS e, min_by(rank, CASE channel WHEN 'exact' THEN 0 ELSE 1 END) AS r
FROM ({_CHANNELS}) WHERE channel <> 'semantic' GROUP BY unit) QUALIFY rank <= {TOP}""")
def exact_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """Exact hits before lexical ones."""
    exact = search.top(_exact(spark, sf), [F.col("unit")], TOP).select("unit", F.lit(0).alias("e"), "rank")
    lexical = search.top(_lexical(spark, sf), [F.col("score"), F.col("unit")], TOP).select("unit", F.lit(1).alias("e"), "rank")
    best = exact.union(lexical).groupBy("unit").agg(F.min(F.struct("e", "rank")).alias("k"))
    return search.top(best, [F.col("k.e"), F.col("k.rank"), F.col("unit")], TOP).select("unit", "rank")


@query(f"WITH e AS ({_EXACT}) SELECT unit, 'unique_exact_guard' AS reason FROM e WHERE (SELECT count(*) FROM e) = 1 UNION ALL SELECT NULL, 'fused' WHERE (SELECT count(*) FROM ({_EXACT})) <> 1")
def exact_guard(spark: SparkSession, sf: str) -> DataFrame:
    """The only exact hit, if there is just one; else word that channels are to be fused."""
    two = _exact(spark, sf).select("unit").limit(2).agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("u"))
    return two.select(F.when(F.col("n") == 1, F.col("u")).alias("unit"), F.when(F.col("n") == 1, "unique_exact_guard").otherwise("fused").alias("reason"))


@query("""SELECT item_id, count(doc_id) AS n_documents, CAST(coalesce(sum((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text)), 0) AS BIGINT) AS n_occurrences
FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY item_id""")
def anchor_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each anchor text occurs."""
    return search.occurrences(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, q.label = v.label AS relevant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(v.e, v.e)), 6) DESC, v.vec_id) AS rank FROM q, v WHERE q.vec_id <> v.vec_id)
SELECT query_id, count(*) FILTER (relevant) AS n_relevant, CAST(min(rank) FILTER (relevant) AS BIGINT) AS first_rank FROM s WHERE rank <= 10 GROUP BY query_id""")
def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Where relevant vectors rank for each query of a stated set."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 100 = 0")
    ranked = search.nearest(vectors.select("vec_id", "embedding", "label"), queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label")), 10)
    relevant = F.col("label") == F.col("q_label")
    return ranked.groupBy("query_id").agg(F.count_if(relevant).alias("n_relevant"), F.min(F.when(relevant, F.col("rank"))).alias("first_rank"))


@query("""SELECT doc_id AS source_order, 'unit_' || left(sha256('unit-v1:' || doc_id || ':' || sha256(text)), 24) AS unit_id, sha256(text) AS digest FROM documents WHERE text <> ''""")
def retrieval_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of retrieval, named by what they hold."""
    return units(spark, sf).where("text <> ''").select("source_order", "unit_id", F.sha2("text", 256).alias("digest"))


@query(f"""SELECT doc_id, sha256(text) AS body, sha256(replace(lower(text), 'ß', 'ss')) AS body_folded, CAST(len({TERMS_SQL}) AS BIGINT) AS n_terms FROM documents""")
def exact_lexical_projection(spark: SparkSession, sf: str) -> DataFrame:
    """What the exact and lexical indexes hold of each unit."""
    return _units(spark, sf).select(F.col("unit").alias("doc_id"), F.sha2("text", 256).alias("body"), F.sha2(X.folded(F.col("text")), 256).alias("body_folded"), F.size(X.terms(F.col("text"))).cast("long").alias("n_terms"))


#: The index holds what the labels cover, with the ends of texts trimmed as it was when they were indexed.
_PART = "string_agg(prefix || ':' || part, ',' ORDER BY prefix)"


def _state_sql(text: str, rows: str) -> str:
    return f"""SELECT source, sha256({_PART}) AS f, CAST(sum(k) AS BIGINT) AS n FROM (SELECT source, left(d, 2) AS prefix, count(*) AS k, sum(('0x' || substr(d, 3, 8))::BIGINT) || '-' || sum(('0x' || substr(d, 11, 8))::BIGINT) || '-' || sum(('0x' || substr(d, 19, 8))::BIGINT) || '-' || count(*) AS part
FROM (SELECT source, sha256({text}) AS d FROM {rows}) GROUP BY 1, 2) GROUP BY source"""


@query(f"""WITH a AS ({_state_sql("text", "documents")}),
b AS ({_state_sql("trim(text)", "documents JOIN embeddings ON vec_id = doc_id")})
SELECT a.source, CASE WHEN b.source IS NULL THEN 'not_found' WHEN a.n <> b.n THEN 'incomplete' WHEN a.f <> b.f THEN 'stale' ELSE 'fresh' END AS state FROM a LEFT JOIN b ON a.source = b.source""")
def index_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an index still holds what its documents say: it has one vector for each document, and was built of trimmed texts."""
    docs = table(spark, sf, "documents")
    indexed = docs.join(table(spark, sf, "embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"))

    def state(rows: DataFrame, text: Column) -> DataFrame:
        own = rows.select("source", F.sha2(text, 256).alias("d"))
        counts = own.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
        return set_digest(own, ["source"], "d").join(counts, F.col("source") == F.col("s")).select("source", F.col("digest").alias("f"), "n")

    now, then = state(docs, F.col("text")), state(indexed, F.trim("text")).select(F.col("source").alias("b"), F.col("f").alias("bf"), F.col("n").alias("bn"))
    found = F.when(F.col("b").isNull(), "not_found").when(F.col("n") != F.col("bn"), "incomplete").when(F.col("f") != F.col("bf"), "stale").otherwise("fresh")
    return now.join(then, F.col("source") == F.col("b"), "left").select("source", found.alias("state"))


@query("""SELECT e.vec_id AS unit, d.doc_id IS NOT NULL AS has_unit, len(e.embedding) = 64 AS whole FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id""")
def semantic_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each vector has its unit and all its numbers."""
    known = table(spark, sf, "documents").select("doc_id")
    rows = table(spark, sf, "embeddings").join(known, F.col("vec_id") == F.col("doc_id"), "left")
    return rows.select(F.col("vec_id").alias("unit"), F.col("doc_id").isNotNull().alias("has_unit"), (F.size("embedding") == 64).alias("whole"))


@query("""SELECT doc_id, 'search_document: title=' || source || ' lang=' || lang || chr(10) || text AS input FROM documents""")
def semantic_input(spark: SparkSession, sf: str) -> DataFrame:
    """What is handed to the embedding model."""
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("search_document: title="), "source", F.lit(" lang="), "lang", F.lit("\n"), "text").alias("input"))


@query("""SELECT label, count(*) AS n, CAST(min(vec_id) AS BIGINT) AS first_id FROM embeddings GROUP BY label""")
def semantic_publish(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors by profile, as they are published."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))


