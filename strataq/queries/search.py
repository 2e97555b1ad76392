"""Full text, vectors, hybrid scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataq.functions.scalar import tokens
from strataq.functions.vectors import cosine, dot, negative_l2, squared_l2
from strataq.operators import graph, hybrid, text, vector
from strataq.queries.registry import query
from strataq.session import table

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def toks(column: str) -> str:
    return f"list_filter(regexp_split_to_array({LOWER.format(column)}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def docs(s, d):
    return table(s, d, "documents")


def bm25_sql(terms: list[str], every: str, wanted: str | None = None, k: int = 10) -> str:
    part = " + ".join(f"ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, _ in enumerate(terms))
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS t{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS df{i}" for i, _ in enumerate(terms))
    some = " + ".join(f"t{i}" for i, _ in enumerate(terms))
    return f"""
WITH a AS (SELECT doc_id, {every} AS e, {wanted or every} AS w FROM documents), c AS (SELECT doc_id, len(e) AS dl, {tf} FROM a),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {df} FROM c)
SELECT doc_id, round({part}, 6) AS score FROM c, st WHERE {some} > 0 ORDER BY score DESC, doc_id LIMIT {k}"""


def ranked(scores, k=10):
    return scores.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


@query("s4_tokenizer", f"SELECT doc_id, len({toks('text')})::BIGINT AS n FROM documents")
def _(s, d):
    return docs(s, d).select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n"))


@query("f1_search_term", f"SELECT doc_id FROM documents WHERE list_contains({toks('text')}, 'license')")
def _(s, d):
    return text.search(docs(s, d), "doc_id", "LICENSE", "text")


@query("f2_search_field", f"SELECT doc_id FROM documents WHERE list_contains({toks('source')}, 'src3')")
def _(s, d):
    return text.search(docs(s, d), "doc_id", "SRC3", "source")


@query("f3_bm25_top", bm25_sql(["with", "license"], toks("text")))
def _(s, d):
    return ranked(text.bm25(docs(s, d), "doc_id", "with License", ("text",)))


@query("f3_bm25_multiplicity", f"SELECT doc_id, round(2 * score, 6) AS score FROM ({bm25_sql(['reserved'], toks('text')).replace('round(', '(').replace(', 6) AS score', ') AS score')}) ORDER BY 2 DESC, doc_id LIMIT 10")
def _(s, d):
    return ranked(text.bm25(docs(s, d), "doc_id", "reserved reserved", ("text",)))


@query("f4_bm25_field", bm25_sql(["src1"], f"list_concat({toks('text')}, {toks('source')})", toks("source")))
def _(s, d):
    return ranked(text.bm25(docs(s, d), "doc_id", "src1", ("text", "source"), field="source"))


@query("f5_bm25_index", bm25_sql(["idiot", "clown"], toks("text"), k=25))
def _(s, d):
    return ranked(text.bm25(docs(s, d), "doc_id", "idiot clown", ("text",)), 25)


@query("f6_match", f"SELECT doc_id FROM documents WHERE instr({LOWER.format('text')}, 'licensed under') > 0 ORDER BY doc_id LIMIT 20")
def _(s, d):
    return text.match(docs(s, d), "text", "Licensed UNDER").select("doc_id").orderBy("doc_id").limit(20)


@query("f7_term_dictionary", f"SELECT DISTINCT unnest({toks('text')}) AS term FROM documents")
def _(s, d):
    return text.postings(docs(s, d), "doc_id", "text").select("term").distinct()


@query("a14_document_frequency", f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS postings FROM (SELECT doc_id, unnest({toks('text')}) AS term FROM documents) GROUP BY term")
def _(s, d):
    # one row a (document, term) first, so the distinct count needs no second shuffle of tokens
    each = text.postings(docs(s, d), "doc_id", "text").groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("postings"))


@query("a14_corpus_stats", f"SELECT count(*) AS doc_count, sum(len({toks('text')}))::BIGINT AS total_terms, round(avg(len({toks('text')})), 6) AS average_length FROM documents")
def _(s, d):
    return text.corpus_stats(docs(s, d), "text").withColumn("average_length", F.round("average_length", 6))


Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def vecs(s, d):
    return table(s, d, "embeddings")


@query("s5_s9_measures", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {Q0}), 6) AS cosine, round(list_inner_product(embedding::DOUBLE[], {Q0}), 6) AS dot, round(-list_distance(embedding::DOUBLE[], {Q0}), 6) AS neg_l2, round(list_distance(embedding::DOUBLE[], {Q0}) ** 2, 6) AS sq_l2 FROM embeddings WHERE vec_id > 0")
def _(s, d):
    v = vecs(s, d)
    q = F.array(*[F.lit(float(x)) for x in vector.vector_of(v, 0)])
    e = F.col("embedding")
    return v.where("vec_id > 0").select("vec_id", F.round(cosine(e, q), 6).alias("cosine"), F.round(dot(e, q), 6).alias("dot"), F.round(negative_l2(e, q), 6).alias("neg_l2"), F.round(squared_l2(e, q), 6).alias("sq_l2"))


def _scored(df):
    return df.withColumn("score", F.round("score", 6))


@query("v1_top_cosine", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {Q0}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 10")
def _(s, d):
    v = vecs(s, d)
    return _scored(vector.top(v, vector.vector_of(v, 0), 10))


@query("v1_top_dot", f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {Q0}), 6) AS score FROM embeddings ORDER BY list_inner_product(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 10")
def _(s, d):
    v = vecs(s, d)
    return _scored(vector.top(v, vector.vector_of(v, 0), 10, "dot"))


@query("v3_v4_nearest", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {Q0}) ** 2, 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {Q0}), vec_id LIMIT 10")
def _(s, d):
    v = vecs(s, d)
    return vector.nearest(v, vector.vector_of(v, 0), 10).withColumn("distance", F.round("distance", 6))


@query("v5_filtered", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {Q0}) ** 2, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY list_distance(embedding::DOUBLE[], {Q0}), vec_id LIMIT 10")
def _(s, d):
    v = vecs(s, d)
    return vector.nearest(v, vector.vector_of(v, 0), 10, allowed=v.where("label = 3")).withColumn("distance", F.round("distance", 6))


@query("v7_similar_to", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {Q0}), 6) AS score FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {Q0}) >= 0.2 ORDER BY 2 DESC, vec_id LIMIT 15")
def _(s, d):
    return _scored(vector.similar_to(vecs(s, d), 0, 15, threshold=0.2))


def _graph_part(s, d):
    v = vecs(s, d).select("vec_id", "label")
    spokes = v.select(F.col("vec_id").alias("src"), F.lit("label").alias("label"), (F.col("label") + 1_000_000).cast("long").alias("dst"))
    back = spokes.select(F.col("dst").alias("src"), "label", F.col("src").alias("dst"))
    return hybrid.graph_scores(graph.traverse(spokes.unionByName(back), 0, 2)).where("id < 1000000")


HYBRID = """
WITH t AS ({bm}), v AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], {q}) AS v FROM embeddings ORDER BY v DESC, id LIMIT 100),
vis AS (SELECT 0::BIGINT AS id, 0 AS depth UNION ALL SELECT label + 1000000, 1 FROM embeddings WHERE vec_id = 0
 UNION ALL SELECT vec_id, 2 FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0) AND vec_id <> 0),
g AS (SELECT id, 1.0 / row_number() OVER (ORDER BY depth, id) AS g FROM vis),
u AS (SELECT id FROM t UNION SELECT id FROM v UNION SELECT id FROM g WHERE id < 1000000)
SELECT id, round({w}, 6) AS score FROM u LEFT JOIN t USING (id) LEFT JOIN v USING (id) LEFT JOIN g USING (id) ORDER BY score DESC, id LIMIT 20"""
_BM = bm25_sql(["license"], toks("text"), k=10**9).replace("SELECT doc_id, round(", "SELECT doc_id AS id, (").replace(", 6) AS score", ") AS t").replace("ORDER BY score DESC, doc_id LIMIT 1000000000", "")


def _parts(s, d):
    v = vecs(s, d)
    t = text.bm25(docs(s, d), "doc_id", "license", ("text",)).select(F.col("doc_id").alias("id"), F.col("score").alias("text"))
    c = vector.top(v, vector.vector_of(v, 0), 100).select(F.col("vec_id").alias("id"), F.col("score").alias("vector"))
    return t, c, _graph_part(s, d)


@query("h1_hybrid_search", HYBRID.format(bm=_BM, q=Q0, w="0.34 * coalesce(t, 0) + 0.33 * coalesce(v, 0) + 0.33 * coalesce(g, 0)"))
def _(s, d):
    return hybrid.combine(*_parts(s, d), 20).withColumn("score", F.round("score", 6))


@query("h2_hybrid_weights", HYBRID.format(bm=_BM, q=Q0, w="CASE WHEN id % 10 = 3 THEN 1.0 ELSE 0.2 END * coalesce(t, 0) + CASE WHEN id % 10 = 3 THEN 2.0 ELSE 0.5 END * coalesce(v, 0) + CASE WHEN id % 10 = 3 THEN 0.0 ELSE 0.3 END * coalesce(g, 0)"))
def _(s, d):
    own = docs(s, d).where("doc_id % 10 = 3").select(F.col("doc_id").alias("id"), F.lit(1.0).alias("text_w"), F.lit(2.0).alias("vector_w"), F.lit(0.0).alias("graph_w"))
    own = own.unionByName(vecs(s, d).where("vec_id % 10 = 3").select(F.col("vec_id").alias("id"), F.lit(1.0).alias("text_w"), F.lit(2.0).alias("vector_w"), F.lit(0.0).alias("graph_w"))).dropDuplicates(["id"])
    return hybrid.combine(*_parts(s, d), 20, (0.2, 0.5, 0.3), own).withColumn("score", F.round("score", 6))


@query("h3_plan_order", "SELECT * FROM (VALUES (0, 'inverted'), (1, 'btree'), (2, 'adjacency'), (3, 'hnsw_or_ivf')) AS t(step, index_name)")
def _(s, d):
    return s.createDataFrame(list(enumerate(hybrid.plan_order(["Vector", "Search", "Sql", "Graph", "Hybrid", "Search"]))), "step int, index_name string")
