"""Queries over the vector table: distances, exact and hashed search, quantizers, graphs.

The query set is every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.config import HashIndex
from vecloom.functions import keys, vector
from vecloom.operators import graph, items, lsh, quantize, search, tasks
from vecloom.operators.knn import knn
from vecloom.runtime import scratch
from vecloom.sources import table

K = 10
#: Similarity that selects something on these tables; operators default to the stricter thresholds of a live store.
NEAR = 0.3
PAIR = {"id_col": "vec_id", "vector_col": "embedding"}
#: Tables wide enough for a recall of 0.9 and more on these vectors, which hardly cluster.
WIDE, WIDE_MULTI = lsh.Planes(24, 4, True), lsh.Planes(24, 8, False)
#: Cells, probes and training steps of the two cell searches, for the same recall.
IVF, IVF_WIDE = (16, 12, 10), (32, 24, 10)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).filter("vec_id % 50 = 0")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits, and no negative zero."""
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def _pairs(spark: SparkSession, sf_dir: str, name: str, measure) -> DataFrame:  # noqa: ANN001
    """A measure of every vector against the first one."""
    first = _all(spark, sf_dir).orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return _rounded(_all(spark, sf_dir).join(F.broadcast(first)).select("vec_id", measure(F.col("embedding"), F.col("q")).alias(name)), name)


def _measure(name: str, measure):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: _pairs(spark, sf_dir, name, measure)


def _knn(metric: str):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = knn(_all(spark, sf_dir), _asked(spark, sf_dir), K, metric, **PAIR)
        if metric == "dot":
            return _rounded(found.select("query_id", "item_id", "rank", (-F.col("distance")).alias("similarity")), "similarity")
        return _rounded(found, "distance")

    return query


def vec_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_all(spark, sf_dir).select("vec_id", vector.norm(F.col("embedding")).alias("norm")), "norm")


def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.transform("embedding", lambda x: x * 2)
    return _rounded(_all(spark, sf_dir).select("vec_id", F.posexplode(vector.normalize(doubled)).alias("pos", "value")).withColumn("pos", F.col("pos").cast("bigint")), "value")


def vec_is_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("vec_id", vector.is_normalized(F.col("embedding")).alias("normalized"))


def similarity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn(_all(spark, sf_dir), _asked(spark, sf_dir), None, "cosine", most_distance=1.0 - NEAR, **PAIR)
    return _rounded(near.select("query_id", "item_id", (1.0 - F.col("distance")).alias("similarity")), "similarity")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similarity_edges(_all(spark, sf_dir), NEAR, 32, **PAIR)


def similarity_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_edges(spark, sf_dir), "similarity")


def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hops(_edges(spark, sf_dir), _asked(spark, sf_dir).select(F.col("vec_id").alias("node")), 2)


def graph_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of few but weaker links merged with the usual one, the best eight links a node."""
    whole = _edges(spark, sf_dir)
    weak = graph.similarity_edges(_all(spark, sf_dir), 0.2, 4, **PAIR)
    return _rounded(graph.merge_edges(whole, weak, 8), "similarity")


def hnsw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(_all(spark, sf_dir), "vec_id")


def hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(graph.layered_search(_all(spark, sf_dir), _asked(spark, sf_dir), K, **PAIR), "distance")


def lsh_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.buckets(_all(spark, sf_dir), lsh.SINGLE, **PAIR)


def mplsh_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.buckets(_all(spark, sf_dir), lsh.MULTI, **PAIR)


def lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lsh.lsh_search(_all(spark, sf_dir), _asked(spark, sf_dir), K, 0.0, WIDE, **PAIR), "similarity")


def lsh_bucket_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opt-in limit: of every bucket at most the hundred rows with the least ids."""
    return _rounded(lsh.lsh_search(_all(spark, sf_dir), _asked(spark, sf_dir), K, 0.2, bucket_limit=100, **PAIR), "similarity")


def mplsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.candidates(_all(spark, sf_dir), _asked(spark, sf_dir), WIDE_MULTI, 9, **PAIR)


def lsh_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lsh.lsh_rerank(_all(spark, sf_dir), _asked(spark, sf_dir), K, WIDE, **PAIR), "distance")


def _book(spark: SparkSession, sf_dir: str, k: int = 8) -> np.ndarray:
    return quantize.first_rows(_all(spark, sf_dir), k, **PAIR)


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quantize.assign(_all(spark, sf_dir), _book(spark, sf_dir), **PAIR).withColumnRenamed("id", "vec_id"), "distance")


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = quantize.step(_all(spark, sf_dir), _book(spark, sf_dir), **PAIR)
    rows = [(c, p, float(v)) for c, row in enumerate(after) for p, v in enumerate(row)]
    return _rounded(spark.createDataFrame(rows, "code bigint, pos bigint, value double"), "value")


def kmeans_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the clusters after ten steps from sixteen centroids."""
    book = quantize.train(_all(spark, sf_dir), 16, 10, **PAIR)
    return quantize.assign(_all(spark, sf_dir), book, **PAIR).groupBy("code").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("distance"))


def optimistic_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quantize.optimistic(_all(spark, sf_dir), _book(spark, sf_dir, 16), 1.3, **PAIR).withColumnRenamed("id", "vec_id"), "distance")


def _ivf_search(spark: SparkSession, sf_dir: str, cells: int, probes: int, steps: int) -> DataFrame:
    book = quantize.train(_all(spark, sf_dir), cells, steps, **PAIR)
    return _rounded(quantize.ivf_search(_all(spark, sf_dir), _asked(spark, sf_dir), book, K, probes, **PAIR), "distance")


def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three quarters of the trained cells: these vectors have hardly any clusters, so fewer lose too many."""
    return _ivf_search(spark, sf_dir, *IVF)


def ivf_nprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf_search(spark, sf_dir, *IVF_WIDE)


def ivf_stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of ``ivf_search`` as a stored index, of which the probed folders are read."""
    cells, probes, steps = IVF
    book = quantize.train(_all(spark, sf_dir), cells, steps, **PAIR)
    path = scratch(spark, "cells")
    quantize.write_cells(_all(spark, sf_dir), book, path, **PAIR)
    return _rounded(quantize.stored_ivf_search(spark, path, _asked(spark, sf_dir), book, K, probes, **PAIR), "distance")


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the ten exact hits of all asked vectors that each search finds (``mplsh_search``: that its candidates hold)."""
    exact = knn(_all(spark, sf_dir), _asked(spark, sf_dir), K, "l2sq", **PAIR)
    searches = (ivf_search, ivf_nprobe_search, lsh_search, lsh_rerank, mplsh_search, optimistic_search, adaptive_search, hybrid_search)
    parts = [search.recall(f(spark, sf_dir), exact).agg(F.lit(f.__name__).alias("search"), F.round(F.avg("recall"), 4).alias("recall")) for f in searches]
    return reduce(DataFrame.unionByName, parts)


def _pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.pq_encode(_all(spark, sf_dir), quantize.product_book(_all(spark, sf_dir), 8, 16, 0, **PAIR), **PAIR)


def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pq(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode("codes").alias("part", "code")).select("vec_id", F.col("part").cast("bigint").alias("part"), F.col("code").cast("bigint").alias("code"))


def pq_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pq(spark, sf_dir).select(F.col("id").alias("vec_id"), quantize.pack_codes(F.col("codes"), 4).alias("packed"))


def pq_reconstruct_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pq(spark, sf_dir).select(F.col("id").alias("vec_id"), "error"), "error")


def pq_trained_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error of a product quantizer of eight parts and 256 codes, trained until it settles or for 100 steps."""
    book = quantize.product_book(_all(spark, sf_dir), 8, 256, 100, **PAIR)
    return quantize.pq_encode(_all(spark, sf_dir), book, **PAIR).agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("error"))


def _levels(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Two levels of eight codes: the first vectors, and their halves."""
    first = _book(spark, sf_dir, 8)
    return np.stack([first, first * 0.5])


def rq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = quantize.rq_encode(_all(spark, sf_dir), _levels(spark, sf_dir), **PAIR)
    return coded.select(F.col("id").alias("vec_id"), F.posexplode("codes").alias("level", "code")).select("vec_id", F.col("level").cast("bigint").alias("level"), F.col("code").cast("bigint").alias("code"))


def rq_reconstruct_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quantize.rq_encode(_all(spark, sf_dir), _levels(spark, sf_dir), **PAIR).select(F.col("id").alias("vec_id"), "error"), "error")


def rq_trained_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean squared error after one and after both levels of a trained residual quantizer."""
    levels = quantize.rq_train(_all(spark, sf_dir), 2, 16, 5, **PAIR)
    parts = [quantize.rq_encode(_all(spark, sf_dir), levels[:n], **PAIR).agg(F.lit(n).cast("bigint").alias("levels"), F.round(F.avg("error"), 6).alias("error")) for n in (1, 2)]
    return parts[0].unionByName(parts[1])


def optimistic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.optimistic_search(_all(spark, sf_dir), _asked(spark, sf_dir), K, WIDE_MULTI, **PAIR), "distance")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search.hybrid_search(_all(spark, sf_dir), _asked(spark, sf_dir), K, **PAIR), "distance")


def hybrid_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_quality(_all(spark, sf_dir), _asked(spark, sf_dir), K, **PAIR)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the ten exact hits that nine probes of the multi-probe tables hold."""
    exact = knn(_all(spark, sf_dir), _asked(spark, sf_dir), K, "l2sq", **PAIR)
    return _rounded(search.recall(mplsh_search(spark, sf_dir), exact), "recall")


def hnsw_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = knn(_all(spark, sf_dir), _asked(spark, sf_dir), K, "l2sq", **PAIR)
    return search.recall(hnsw_search(spark, sf_dir), exact)


def adaptive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the statistics of the table, with wide tables."""
    return _adaptive(None)(spark, sf_dir)


def _adaptive(mode: str | None):  # noqa: ANN202
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _all(spark, sf_dir).count()
        stats = {"queries": 5000, "rows": rows, "memory": rows * 256, "latency_ms": 20.0}
        book = quantize.train(_all(spark, sf_dir), IVF[0], IVF[2], **PAIR) if mode == "quantization" else None
        how = HashIndex(tables=WIDE.tables, planes=WIDE.bits, threshold=0.2)
        return _rounded(search.adaptive_search(_all(spark, sf_dir), _asked(spark, sf_dir), K, stats, book, mode, config=how, probes=IVF[1], multi=WIDE_MULTI, **PAIR), "distance")

    return query


def graph_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten nodes that a best-first search from the least id visits."""
    first = _all(spark, sf_dir).agg(F.min("vec_id")).first()[0]
    return _rounded(graph.best_first(_edges(spark, sf_dir), _all(spark, sf_dir), _asked(spark, sf_dir), K, first, **PAIR), "similarity")


def kmeans_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the vectors that one step assigns anew."""
    before = _book(spark, sf_dir)
    found = quantize.change_rate(_all(spark, sf_dir), before, quantize.step(_all(spark, sf_dir), before, **PAIR), **PAIR)
    return _rounded(found, "rate")


def quantize_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every kind of quantizer through the one that chooses between them."""
    books = {"standard": _book(spark, sf_dir), "optimistic": _book(spark, sf_dir, 16), "product": quantize.product_book(_all(spark, sf_dir), 8, 16, 0, **PAIR), "residual": _levels(spark, sf_dir)}
    parts = [quantize.encode(_all(spark, sf_dir), kind, book, **PAIR).select(F.lit(kind).alias("kind"), F.col("id").alias("vec_id"), F.posexplode("codes").alias("part", "code")) for kind, book in books.items()]
    return reduce(DataFrame.unionByName, parts).select("kind", "vec_id", F.col("part").cast("bigint").alias("part"), F.col("code").cast("bigint").alias("code"))


def vector_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of the caller's own for every vector: its largest absolute number."""
    return _rounded(tasks.per_vector(_all(spark, sf_dir), lambda x: np.abs(x).max(axis=1), **PAIR).withColumnRenamed("id", "vec_id"), "value")


def vector_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit keys of vectors; a vector and its double differ."""
    return _all(spark, sf_dir).select("vec_id", keys.fnv1a64(F.col("embedding")).alias("hash"), (keys.fnv1a64(F.col("embedding")) == keys.fnv1a64(F.transform("embedding", lambda x: x * 2))).alias("same"))


def hnsw_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A beam as wide as a segment visits all that is linked, which makes the search exact."""
    return _rounded(graph.layered_search(_all(spark, sf_dir), _asked(spark, sf_dir), K, beam=4096, **PAIR), "distance")


def query_cache_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached results of doubled queries of different ages: which of all vectors find results, and what their first hit is."""
    from vecloom.operators import cache

    asked = _asked(spark, sf_dir).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x * 2).alias("vector"))
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    results = cache.to_remember(knn(_all(spark, sf_dir), _asked(spark, sf_dir), K, "l2sq", **PAIR), asked, K)
    # ages of half a minute to nine and a half, by the first hit, which is the query itself
    aged = results.withColumn("cached_at", now - F.make_dt_interval(mins=((F.col("hits")[0]["item_id"] / 50) % 10).cast("int"), secs=F.lit(30)))
    found = cache.remembered(aged, _all(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), K, cache.nanoseconds(now))
    return found.select("query_id", F.size("hits").cast("bigint").alias("hits"), F.col("hits")[0]["item_id"].alias("first"))


def similar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached query most like each asked one, at the similarity that selects something here."""
    from vecloom.operators.cache import similar_queries

    rows = _all(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return _rounded(similar_queries(rows.filter("id % 50 <> 0"), rows.filter("id % 50 = 0"), NEAR), "similarity")


def query_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every vector and of its double are the same."""
    rows = _all(spark, sf_dir)
    return rows.select("vec_id", (keys.query_key(F.col("embedding"), K) == keys.query_key(F.transform("embedding", lambda x: x * 2), K)).alias("same"), (keys.query_key(F.col("embedding"), K) == keys.query_key(F.col("embedding"), K + 1)).alias("same_limit"))


def arena_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense row numbers, and the chunk of 512 rows that holds each."""
    rows = items.numbered(_all(spark, sf_dir).select("vec_id"), ["vec_id"])
    return rows.select("vec_id", "idx", F.floor(F.col("idx") / 512).alias("chunk"))


def hydrate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits with the source and size of their documents; hits without a document drop out."""
    hits = knn(_all(spark, sf_dir), _asked(spark, sf_dir), K, "l2sq", **PAIR)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.length("text").cast("bigint").alias("chars"))
    return items.hydrate(hits.select("query_id", "item_id", "rank"), docs, "source", "chars")


QUERIES = {
    "knn_l2": _knn("l2sq"),
    "knn_cosine": _knn("cosine"),
    "knn_dot": _knn("dot"),
    "auto_metric_knn": _knn("auto"),
    "dist_l2sq": _measure("distance", vector.l2sq),
    "dist_euclidean": _measure("distance", vector.euclidean),
    "dist_cosine": _measure("distance", vector.cosine_distance),
    "dist_early_stop": _measure("distance", lambda a, b: vector.early_stop(a, b, 1.2, 64)),
    "sim_cosine": _measure("similarity", vector.cosine),
    "sim_dot": _measure("similarity", vector.dot),
    **{f.__name__: f for f in (vec_norm, vec_normalize, vec_is_normalized, similarity_threshold, similarity_graph_edges, graph_two_hop, graph_merge_edges, hnsw_levels, hnsw_search, hnsw_recall, lsh_build, mplsh_build, lsh_search, mplsh_search, lsh_rerank, kmeans_assign, kmeans_step, kmeans_train, optimistic_quantize, ivf_search, ivf_nprobe_search, pq_encode, pq_pack, pq_reconstruct_error, rq_encode, rq_reconstruct_error, rq_trained_error, optimistic_search, hybrid_search, hybrid_quality, ann_recall, adaptive_search, similar_query, query_cache_key, arena_lookup, hydrate_candidates, ivf_stored_search, index_recall, pq_trained_error, lsh_bucket_limit, graph_best_first, kmeans_change_rate, quantize_dispatch, vector_task, vector_hash, hnsw_exact, query_cache_get)},
    **{f"adaptive_{mode}": _adaptive(mode) for mode in ("lsh", "quantization", "hybrid", "standard")},
}


# SQL. Folds run left to right over doubles, as the expressions do.


def _sum(term: str, a: str, b: str) -> str:
    return f"list_sum([{term} for x in list_zip({a}::double[], {b}::double[])])"


def _sq(a: str, b: str) -> str:
    return _sum("(x[1]-x[2])*(x[1]-x[2])", a, b)


def _dot(a: str, b: str) -> str:
    return _sum("x[1]*x[2]", a, b)


def _len(v: str) -> str:
    return f"sqrt({_dot(v, v)})"


def _cos(a: str, b: str) -> str:
    return f"({_dot(a, b)} / ({_len(a)} * {_len(b)}))"


Q = "q as (select vec_id as query_id, embedding as qv from embeddings where vec_id % 50 = 0)"


def _top(measure: str, name: str, order: str, where: str = "true", k: int = K, shown: str | None = None) -> str:
    return f"""
with {Q}, d as (select query_id, vec_id as item_id, {measure} as m from q, embeddings),
r as (select *, row_number() over (partition by query_id order by {order}, item_id) as rank from d where {where})
select query_id, item_id, rank::bigint as rank, round({shown or "m"}, 6) + 0.0 as {name} from r where rank <= {k}"""


def _first(measure: str, name: str) -> str:
    return f"select vec_id, round({measure}, 6) + 0.0 as {name} from embeddings, (select embedding as q from embeddings order by vec_id limit 1)"


def _planes(p: lsh.Planes) -> str:
    sign = ">=" if p.inclusive else ">"
    return f"""
planes as (select t, h, list(((g*7919+104729)*(g+17)) % 2003 / 1001.0::double - 1.0 order by j) as plane
  from (select t, h, j, ((t*{p.bits}+h)*64+j)::bigint as g from range({p.tables}) a(t), range({p.bits}) b(h), range(64) c(j)) group by t, h),
b as (select vec_id, t::bigint as table_id, sum(case when {_dot("embedding", "plane")} {sign} 0 then 1::bigint << h::bigint else 0 end)::bigint as bucket from embeddings, planes group by vec_id, t)"""


def _probes(p: lsh.Planes, n: int) -> str:
    flips = ", ".join(f"xor(bucket, {1 << i}::bigint)" for i in range(p.bits))
    return f"unnest(list_slice([bucket, {flips}], 1, {n}))"


def _candidates(p: lsh.Planes, n: int) -> str:
    return f"""{_planes(p)},
asked as (select vec_id as query_id, table_id, {_probes(p, n)} as bucket from b where vec_id % 50 = 0),
cand as (select distinct a.query_id, b.vec_id as item_id from asked a join b on a.table_id = b.table_id and a.bucket = b.bucket)"""


_SCORED = f"""scored as (select c.query_id, c.item_id, {_cos("qe.embedding", "ie.embedding")} as s, {_sq("qe.embedding", "ie.embedding")} as d
  from cand c join embeddings qe on qe.vec_id = c.query_id join embeddings ie on ie.vec_id = c.item_id)"""
_EXACT = f"""exact as (select * from (select query_id, vec_id as item_id, {_sq("qv", "embedding")} as d, row_number() over (partition by query_id order by {_sq("qv", "embedding")}, vec_id) as rank from q, embeddings))"""


def _book_sql(k: int, name: str = "book") -> str:
    return f"{name} as (select row_number() over (order by vec_id) - 1 as code, embedding as c from (select * from embeddings order by vec_id limit {k}))"


_ASSIGN = f"assigned as (select vec_id, embedding, arg_min(code, (d, code)) as code, min(d) as d from (select vec_id, embedding, code, {_sq('embedding', 'c')} as d from embeddings, book) group by vec_id, embedding)"


def _trained(k: int, steps: int) -> str:
    """k-means from the first k vectors, step by step, as ``book``."""
    parts = [_book_sql(k, "book0")]
    for i in range(steps):
        near = f"select vec_id, embedding, arg_min(code, (d, code)) as code from (select vec_id, embedding, code, {_sq('embedding', 'c')} as d from embeddings, book{i}) group by vec_id, embedding"
        means = f"select code, list(v order by i) as c from (select code, i, avg(v) as v from (select code, unnest(embedding::double[]) as v, unnest(range(64)) as i from ({near})) group by code, i) group by code"
        parts.append(f"book{i + 1} as materialized (select b.code, coalesce(m.c, b.c::double[]) as c from book{i} b left join ({means}) m on m.code = b.code)")
    return ", ".join([*parts, f"book as (select * from book{steps})"])


def _ivf(k: int, nprobe: int, steps: int) -> str:
    return f"""
with {Q}, {_trained(k, steps)}, {_ASSIGN},
probe as (select query_id, qv, code from (select query_id, qv, code, row_number() over (partition by query_id order by {_sq("qv", "c")}, code) as p from q, book) where p <= {nprobe}),
r as (select query_id, vec_id as item_id, {_sq("qv", "embedding")} as m, row_number() over (partition by query_id order by {_sq("qv", "embedding")}, vec_id) as rank from probe join assigned using (code))
select query_id, item_id, rank::bigint as rank, round(m, 6) + 0.0 as distance from r where rank <= {K}"""


_PQ = f"""{_book_sql(16)}, parts as (select p, code, c[p*8+1:p*8+8] as s from book, range(8) r(p)),
coded as (select vec_id, p, arg_min(code, (d, code)) as code, min(d) as d from (select vec_id, p, code, {_sq("embedding[p*8+1:p*8+8]", "s")} as d from embeddings, parts) group by vec_id, p)"""
_RQ = f"""{_book_sql(8)}, l0 as (select vec_id, embedding, arg_min(code, (d, code)) as c0 from (select vec_id, embedding, code, {_sq("embedding", "c")} as d from embeddings, book) group by vec_id, embedding),
rest as (select vec_id, c0, [x[1]-x[2] for x in list_zip(embedding::double[], c::double[])] as r from l0 join book on code = c0),
l1 as (select vec_id, c0, arg_min(code, (d, code)) as c1, min(d) as d from (select vec_id, c0, code, {_sq("r", "[y*0.5::double for y in c::double[]]")} as d from rest, book) group by vec_id, c0)"""
_EDGES = f"""edges as (select * from (select a.vec_id as src, b.vec_id as dst, {_cos("a.embedding", "b.embedding")} as similarity,
  row_number() over (partition by a.vec_id order by {_cos("a.embedding", "b.embedding")} desc, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id where {_cos("a.embedding", "b.embedding")} >= {NEAR}) where rank <= 32)"""
_FNV = "list_reduce(list_concat([2166136261::bigint], [ascii(c)::bigint for c in string_split({key}, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_HASHED = """hashed as (select *, row_number() over (partition by query_id order by s desc, item_id) as rank from scored where s >= 0.2),
good as (select query_id, count(*) as hits, max(d) as most, arg_min(d, rank) as first from hashed where rank <= 10 group by query_id)"""


def _visits(k: int) -> str:
    """Best-first search, a step a table: nodes seen, and of those not yet visited the most similar."""
    near = f"round({_cos('qe.embedding', 'ie.embedding')}, 9)"
    parts = ["e as materialized (select src, dst from edges)", f"s1 as materialized (select q.query_id, m.vec_id as node, {near} as s from q join embeddings qe on qe.vec_id = q.query_id, (select vec_id, embedding from embeddings order by vec_id limit 1) m, (select embedding from embeddings order by vec_id limit 1) ie)"]
    done = "(select null::bigint as query_id, null::bigint as node where false)"
    for i in range(1, k + 1):
        parts.append(f"v{i} as materialized (select query_id, arg_max(node, (s, -node)) as node, max(s) as s, {i}::bigint as visit from s{i} x where not exists (select 1 from {done} d where d.query_id = x.query_id and d.node = x.node) group by query_id)")
        done = "(" + " union all ".join(f"select query_id, node from v{j}" for j in range(1, i + 1)) + ")"
        parts.append(f"s{i + 1} as materialized (select * from s{i} union all select n.query_id, n.node, {near} as s from (select distinct v.query_id, e.dst as node from v{i} v join e on e.src = v.node) n join embeddings qe on qe.vec_id = n.query_id join embeddings ie on ie.vec_id = n.node where not exists (select 1 from s{i} x where x.query_id = n.query_id and x.node = n.node))")
    visits = " union all ".join(f"select * from v{i}" for i in range(1, k + 1))
    return f"with {Q}, {_EDGES}, {', '.join(parts)} select query_id, node as item_id, visit, round(s, 6) + 0.0 as similarity from ({visits})"


@lru_cache(maxsize=1)
def _oracle() -> dict[str, str]:
    o = {
        "knn_l2": _top(_sq("qv", "embedding"), "distance", "m"),
        "knn_cosine": _top(f"1.0 - {_cos('qv', 'embedding')}", "distance", "m"),
        "knn_dot": _top(_dot("qv", "embedding"), "similarity", "m desc"),
        "auto_metric_knn": f"""with {Q}, n as (select bool_and(abs({_dot("embedding", "embedding")} - 1.0) < 1e-6) as ok from embeddings),
d as (select query_id, vec_id as item_id, case when ok then 1.0 - {_cos("qv", "embedding")} else {_sq("qv", "embedding")} end as m from q, embeddings, n),
r as (select *, row_number() over (partition by query_id order by m, item_id) as rank from d)
select query_id, item_id, rank::bigint as rank, round(m, 6) + 0.0 as distance from r where rank <= {K}""",
        "dist_l2sq": _first(_sq("embedding", "q"), "distance"),
        "dist_euclidean": _first(f"sqrt({_sq('embedding', 'q')})", "distance"),
        "dist_cosine": _first(f"1.0 - {_cos('embedding', 'q')}", "distance"),
        "sim_cosine": _first(_cos("embedding", "q"), "similarity"),
        "sim_dot": _first(_dot("embedding", "q"), "similarity"),
        "dist_early_stop": "with t as (select vec_id, " + ", ".join(f"{_sq(f'embedding[1:{n}]', f'q[1:{n}]')} as s{n}" for n in (16, 32, 48, 64)) + " from embeddings, (select embedding as q from embeddings order by vec_id limit 1)) select vec_id, round(sqrt(case when s16 > 1.44 then s16 when s32 > 1.44 then s32 when s48 > 1.44 then s48 else s64 end), 6) + 0.0 as distance from t",
        "vec_norm": f"select vec_id, round({_len('embedding')}, 6) + 0.0 as norm from embeddings",
        "vec_normalize": f"select vec_id, (unnest(range(64)))::bigint as pos, round(unnest([x / n for x in d]), 6) + 0.0 as value from (select vec_id, [x * 2 for x in embedding::double[]] as d, {_len('[y * 2 for y in embedding::double[]]')} as n from embeddings)",
        "vec_is_normalized": f"select vec_id, abs({_dot('embedding', 'embedding')} - 1.0) < 1e-6 as normalized from embeddings",
        "similarity_threshold": f"with {Q} select query_id, vec_id as item_id, round({_cos('qv', 'embedding')}, 6) + 0.0 as similarity from q, embeddings where {_cos('qv', 'embedding')} >= {NEAR}",
        "similarity_graph_edges": f"with {_EDGES} select src, dst, round(similarity, 6) + 0.0 as similarity, rank::bigint as rank from edges",
        "graph_two_hop": f"""with {_EDGES}, h as (select vec_id as start, vec_id as node, 0 as hop from embeddings where vec_id % 50 = 0),
h1 as (select start, dst as node, 1 as hop from h join edges on node = src), h2 as (select start, dst as node, 2 as hop from h1 join edges on node = src)
select start, node, min(hop)::bigint as hop from (select * from h union all select * from h1 union all select * from h2) group by start, node""",
        "graph_merge_edges": f"""with {_EDGES}, part as (select * from (select a.vec_id as src, b.vec_id as dst, {_cos("a.embedding", "b.embedding")} as similarity,
  row_number() over (partition by a.vec_id order by {_cos("a.embedding", "b.embedding")} desc, b.vec_id) as rank from embeddings a join embeddings b on a.vec_id <> b.vec_id where {_cos("a.embedding", "b.embedding")} >= 0.2) where rank <= 4),
m as (select src, dst, max(similarity) as similarity from (select src, dst, similarity from edges union all select src, dst, similarity from part) group by src, dst),
r as (select *, row_number() over (partition by src order by similarity desc, dst) as rank from m)
select src, dst, round(similarity, 6) + 0.0 as similarity, rank::bigint as rank from r where rank <= 8""",
        "hnsw_levels": f"select id, least(case when h = 0 then 32 else length(bin(h & -h)) - 1 end, 32)::bigint as level from (select vec_id as id, {_FNV.format(key='vec_id::varchar')} as h from embeddings)",
        "lsh_build": f"with {_planes(lsh.SINGLE)} select vec_id as id, table_id, bucket from b",
        "mplsh_build": f"with {_planes(lsh.MULTI)} select vec_id as id, table_id, bucket from b",
        "mplsh_search": f"with {_candidates(WIDE_MULTI, 9)} select query_id, item_id from cand",
        "lsh_search": f"with {_candidates(WIDE, 1)}, {_SCORED}, r as (select *, row_number() over (partition by query_id order by s desc, item_id) as rank from scored where s >= 0.0) select query_id, item_id, rank::bigint as rank, round(s, 6) + 0.0 as similarity from r where rank <= {K}",
        "lsh_rerank": f"""with {Q}, {_candidates(WIDE, 1)}, {_SCORED}, {_EXACT},
f as (select * from (select query_id, item_id, d, row_number() over (partition by query_id order by s desc, item_id) as n from scored) where n <= {2 * K}),
e as (select query_id from f group by query_id having count(*) >= {K}),
u as (select query_id, item_id, min(d) as d from (select query_id, item_id, d from f union all select query_id, item_id, d from exact where rank <= {K} and query_id not in (select query_id from e)) group by query_id, item_id),
r as (select *, row_number() over (partition by query_id order by d, item_id) as rank from u)
select query_id, item_id, rank::bigint as rank, round(d, 6) + 0.0 as distance from r where rank <= {K}""",
        "kmeans_assign": f"with {_book_sql(8)}, {_ASSIGN} select vec_id, code, round(d, 6) + 0.0 as distance from assigned",
        "kmeans_step": f"""with {_book_sql(8)}, {_ASSIGN}, m as (select code, i - 1 as pos, avg(v) as value from (select code, unnest(embedding::double[]) as v, unnest(range(1, 65)) as i from assigned) group by code, i)
select b.code, r.pos::bigint as pos, round(coalesce(m.value, b.c[r.pos + 1]), 6) + 0.0 as value from book b cross join range(64) r(pos) left join m on m.code = b.code and m.pos = r.pos""",
        "optimistic_quantize": f"""with {_book_sql(16)}, d as (select vec_id, code, sqrt({_sq("embedding", "c")}) as d from embeddings, book),
p as (select vec_id, arg_min(code, (d, code)) filter (code < 8) as near, min(d) filter (code < 8) as nd, arg_min(code, (d, code)) as best, min(d) as bd from d group by vec_id)
select vec_id, case when nd > 1.3 then best else near end as code, round(case when nd > 1.3 then bd else nd end, 6) + 0.0 as distance from p""",
        "ivf_search": _ivf(*IVF),
        "ivf_stored_search": _ivf(*IVF),
        "ivf_nprobe_search": _ivf(*IVF_WIDE),
        "kmeans_train": f"with {_trained(16, 10)}, {_ASSIGN} select code, count(*) as n, round(avg(d), 6) as distance from assigned group by code",
        "kmeans_change_rate": f"""with {_trained(8, 1)}, old as (select vec_id, arg_min(code, (d, code)) as code from (select vec_id, code, {_sq("embedding", "c")} as d from embeddings, book0) group by vec_id),
new as (select vec_id, arg_min(code, (d, code)) as code from (select vec_id, code, {_sq("embedding", "c")} as d from embeddings, book) group by vec_id)
select count(*) as rows, count_if(old.code <> new.code)::bigint as changed, round(count_if(old.code <> new.code)::double / count(*), 6) + 0.0 as rate from old join new using (vec_id)""",
        "vector_task": "select vec_id, round(list_max([abs(x) for x in embedding::double[]]), 6) + 0.0 as value from embeddings",
        "lsh_bucket_limit": f"""with {_planes(lsh.SINGLE)}, kept as (select * from (select *, row_number() over (partition by table_id, bucket order by vec_id) as place from b) where place <= 100),
cand as (select distinct a.vec_id as query_id, k.vec_id as item_id from b a join kept k on a.table_id = k.table_id and a.bucket = k.bucket where a.vec_id % 50 = 0),
{_SCORED}, r as (select *, row_number() over (partition by query_id order by s desc, item_id) as rank from scored where s >= 0.2) select query_id, item_id, rank::bigint as rank, round(s, 6) + 0.0 as similarity from r where rank <= {K}""",
        "query_cache_get": f"select vec_id as query_id, {K}::bigint as hits, vec_id as first from embeddings where vec_id % 50 = 0 and (vec_id // 50) % 10 < 5",
        "graph_best_first": _visits(K),
        "pq_encode": f"with {_PQ} select vec_id, p::bigint as part, code from coded",
        "pq_pack": f"with {_PQ} select vec_id, sum(code << (p * 4)::bigint)::bigint as packed from coded group by vec_id",
        "pq_reconstruct_error": f"with {_PQ} select vec_id, round(sum(d), 6) + 0.0 as error from coded group by vec_id",
        "rq_encode": f"with {_RQ} select vec_id, 0::bigint as level, c0 as code from l1 union all select vec_id, 1::bigint, c1 from l1",
        "rq_reconstruct_error": f"with {_RQ} select vec_id, round(d, 6) + 0.0 as error from l1",
        "optimistic_search": f"""with {Q}, {_candidates(WIDE_MULTI, 9)}, {_SCORED}, {_EXACT},
h as (select * from (select query_id, item_id, d, row_number() over (partition by query_id order by d, item_id) as n from scored) where n <= {K}),
f as (select query_id from h group by query_id having count(*) >= {K}),
u as (select query_id, item_id, d, 0 as turn from h union all select e.query_id, e.item_id, e.d, 1 from exact e where e.rank <= {2 * K} and e.query_id not in (select query_id from f) and not exists (select 1 from h where h.query_id = e.query_id and h.item_id = e.item_id)),
r as (select *, row_number() over (partition by query_id order by turn, d, item_id) as rank from u)
select query_id, item_id, rank::bigint as rank, round(d, 6) + 0.0 as distance, case when turn = 0 then 'lsh' else 'exact' end as source from r where rank <= {K}""",
        "hybrid_quality": f"with {_candidates(lsh.SINGLE, 1)}, {_SCORED}, {_HASHED} select query_id, hits, hits = {K} and most <= {search.SPREAD} * first as valid from good",
        "hybrid_search": f"""with {Q}, {_candidates(lsh.SINGLE, 1)}, {_SCORED}, {_EXACT}, {_HASHED},
firm as (select query_id from good where hits = {K} and most <= {search.SPREAD} * first),
h as (select query_id, item_id, d from hashed where rank <= case when query_id in (select query_id from firm) then {K} else {2 * K} end),
u as (select query_id, item_id, d, 0 as turn from h union all select e.query_id, e.item_id, e.d, 1 from exact e where e.rank <= {K} and e.query_id not in (select query_id from firm) and not exists (select 1 from h where h.query_id = e.query_id and h.item_id = e.item_id)),
r as (select *, row_number() over (partition by query_id order by d, turn, item_id) as rank from u)
select query_id, item_id, rank::bigint as rank, round(d, 6) + 0.0 as distance, case when turn = 0 then 'lsh' else 'exact' end as source from r where rank <= {K}""",
        "ann_recall": f"""with {Q}, {_candidates(WIDE_MULTI, 9)}, {_EXACT}
select e.query_id, round(avg(case when c.item_id is null then 0.0::double else 1.0::double end), 6) as recall from exact e left join cand c on c.query_id = e.query_id and c.item_id = e.item_id where e.rank <= {K} group by e.query_id""",
        "similar_query": f"""with {Q}, d as (select query_id, vec_id as cached_id, {_cos("qv", "embedding")} as s from q, embeddings where vec_id % 50 <> 0 and {_cos("qv", "embedding")} >= {NEAR}),
r as (select *, row_number() over (partition by query_id order by s desc, cached_id) as n from d) select query_id, cached_id, round(s, 6) + 0.0 as similarity from r where n = 1""",
        "query_cache_key": "select vec_id, true as same, false as same_limit from embeddings",
        "arena_lookup": "select vec_id, i as idx, i // 512 as chunk from (select vec_id, row_number() over (order by vec_id) - 1 as i from embeddings)",
        "hydrate_candidates": f"with {Q}, {_EXACT} select e.query_id, e.item_id, e.rank::bigint as rank, d.source, length(d.text) as chars from exact e join documents d on d.doc_id = e.item_id where e.rank <= {K}",
    }
    shown = "case when turn = 0 then 'lsh' else 'exact' end as source"
    o["adaptive_search"] = o["optimistic_search"].replace(shown, "'hnsw' as index_type")
    o["adaptive_lsh"] = f"select *, 'lsh' as index_type from ({o['lsh_rerank']})"
    o["adaptive_quantization"] = f"select *, 'quantization' as index_type from ({o['ivf_search']})"
    o["adaptive_standard"] = f"select *, 'standard' as index_type from ({o['knn_l2']})"
    o["adaptive_hybrid"] = o["hybrid_search"].replace(_candidates(lsh.SINGLE, 1), _candidates(WIDE, 1)).replace(shown, "'hybrid' as index_type")
    o["hnsw_exact"] = o["knn_l2"]
    codes = {"standard": ("kmeans_assign", "0::bigint"), "optimistic": ("optimistic_quantize", "0::bigint"), "product": ("pq_encode", "part"), "residual": ("rq_encode", "level")}
    o["quantize_dispatch"] = " union all ".join(f"select '{kind}' as kind, vec_id, {part} as part, code::bigint as code from ({o[name]})" for kind, (name, part) in codes.items())
    return o


ORACLE = _oracle()
