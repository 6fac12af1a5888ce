"""Queries over the access log and the event stream: accesses, prediction, caches, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import keys
from vecloom.operators import access, cache, metrics, ordered
from vecloom.sources import table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.delivered_once(table(spark, sf_dir, "access_log"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses with a usable latency, in milliseconds."""
    return _log(spark, sf_dir).filter(F.col("latency_ms") >= 0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.counts(_log(spark, sf_dir))


def access_pattern_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of keys accessed within a day of the newest access."""
    log = _log(spark, sf_dir)
    return access.fresh(access.counts(log), access.newest(log))


def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.frequent(access.counts(_log(spark, sf_dir)), 5, 100)


def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.transitions(_log(spark, sf_dir))


def predict_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest next items after each."""
    return access.predict(access.transitions(_log(spark, sf_dir)))


def warming_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys accessed at least three times, lately, that the cache does not hold."""
    log = _log(spark, sf_dir)
    return access.warming(access.counts(log), access.newest(log), table(spark, sf_dir, "cache_items"), 3, 24 * 30)


def warming_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: keys to warm, batches of a thousand, and how many the store can deliver."""
    found = warming_candidates(spark, sf_dir).join(table(spark, sf_dir, "store_items").select(F.col("id").alias("item_key"), F.lit(1).alias("held")), "item_key", "left")
    return found.agg(F.count("*").alias("candidates"), F.ceil(F.count("*") / 1000).alias("batches"), F.count("held").alias("warmed"), (F.count("*") - F.count("held")).alias("failed"))


def lru_residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.residency(_log(spark, sf_dir), 50, 16)


def lru_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of sixteen shards that hold fifty items each, over the access log in order."""
    return cache.hit_counts(_log(spark, sf_dir), keys.shard_of(F.col("item_key"), 16), 50, "item_key", ("ts", "seq"))


def latency_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 6).alias("latency"))


def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.success_rates(_log(spark, sf_dir), "op", "success")
    return rates.withColumn("rate", F.round("rate", 6))


def ewma_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordered.ewma(_timed(spark, sf_dir), "op", ["ts", "seq"], "latency_ms")
    return found.withColumn("ewma", F.round("ewma", 6))


def ewma_int_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number mean in microseconds."""
    return ordered.ewma_int(_timed(spark, sf_dir).withColumn("us", F.floor(F.col("latency_ms") * 1000)), "op", ["ts", "seq"], "us")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics an index keeps of its operations."""
    log = _log(spark, sf_dir)
    sums = log.groupBy("op").agg(F.count("*").alias("queries"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"), F.max("ts").alias("last"))
    return sums.join(ordered.ewma(log.filter("latency_ms >= 0"), "op", ["ts", "seq"], "latency_ms").select("op", F.round("ewma", 6).alias("latency")), "op", "left")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with their documents, and what a store a thousand times as large would hold."""
    docs = table(spark, sf_dir, "documents").groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("docs"))
    return table(spark, sf_dir, "collections").join(docs, "name", "left").select("name", "dimension", F.coalesce("docs", F.lit(0)).alias("docs")).withColumn("rows", F.col("docs") * 100000)


def search_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = keys.search_tier(F.col("rows"))
    return _sizes(spark, sf_dir).select("name", "rows", *[c.cast("bigint").alias(n) if n != "mode" else c.alias(n) for n, c in tier.items()])


def adaptive_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index for each collection at its size, memory and the search latency of the log."""
    asked = _log(spark, sf_dir).agg(F.count_if(F.col("op") == "search").alias("queries"))
    sized = _sizes(spark, sf_dir).withColumn("memory", F.col("rows") * F.col("dimension").cast("bigint") * 4).join(F.broadcast(asked))
    # a busy store: latency grows with the rows
    return sized.select("name", "rows", "memory", keys.best_index(F.col("queries"), F.col("rows"), F.col("memory"), F.col("rows") / 10000.0, 100).alias("index_type"))


def adaptive_batch_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch size after each day's failures and latency, from five hundred."""
    days = _timed(spark, sf_dir).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.avg((~F.coalesce("success", F.lit(False))).cast("double")).alias("failure"), F.avg("latency_ms").alias("latency"))
    return days.select("day", "n", keys.next_batch_size(F.lit(500), F.col("failure"), F.col("latency")).alias("size"))


def metric_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("outcome", F.when(F.col("success"), "ok").when(~F.col("success"), "failed").otherwise("unknown"))
    return metrics.counters(log, "op", "outcome")


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.histogram(_timed(spark, sf_dir), "op", F.col("latency_ms") / 1000, metrics.CACHE_BOUNDS)
    return found.withColumn("sum", F.round("sum", 6))


def store_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.histogram(_events(spark, sf_dir), "event_type", F.col("value") / 10, metrics.STORE_BOUNDS)
    return found.withColumn("sum", F.round("sum", 6))


def check_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of verification runs, in seconds."""
    runs = table(spark, sf_dir, "verification_results").withColumn("kind", F.lit("check"))
    found = metrics.histogram(runs, "kind", F.col("duration_ns") / 1e9, metrics.CHECK_BOUNDS)
    return found.withColumn("sum", F.round("sum", 6))


def verification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.check_report(table(spark, sf_dir, "verification_results"))


def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_values(_timed(spark, sf_dir), "op", "latency_ms", "ts", "seq")


def tumbling_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute windows of the log, as the index monitor sees it."""
    log = _log(spark, sf_dir)
    found = metrics.tumbling(log, "ts", "5 minutes", "op", F.when(F.col("latency_ms") >= 0, F.col("latency_ms")), "success")
    return found.withColumns({"latency": F.round("latency", 6), "rate": F.round("rate", 6)})


QUERIES = {f.__name__: f for f in (access_counts, access_pattern_expiry, frequent_items, transition_counts, predict_next, warming_candidates, warming_report, lru_residency, lru_hit_rate, latency_mean, hit_rate, ewma_latency, ewma_int_latency, index_stats, search_params, adaptive_choice, adaptive_batch_size, metric_counters, latency_histogram, store_histogram, check_histogram, verification_report, gauge_last, tumbling_index_stats)}

_LOG = """log as (select seq, ts, ingested_at, user_id, item_key, lower(trim(op)) as op, latency_ms, success from (select *, row_number() over (partition by seq order by ingested_at, ts, user_id nulls first, item_key nulls first, op, latency_ms nulls first, success nulls first) as rn from access_log) where rn = 1),
timed as (select * from log where latency_ms >= 0)"""
_COUNTS = "counts as (select item_key, count(*) as accesses, max(ts) as last_access from log where item_key is not null group by item_key)"
_FNV = "list_reduce(list_concat([2166136261::bigint], [ascii(c)::bigint for c in string_split(item_key, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_WARM = f"{_LOG}, {_COUNTS}, warm as (select * from counts where accesses >= 3 and last_access >= (select max(ts) from log) - interval 720 hours and item_key not in (select id from cache_items))"
_SIZES = "sizes as (select c.name, c.dimension, coalesce(d.docs, 0) * 100000 as rows from collections c left join (select collection, count(*) as docs from documents group by 1) d on d.collection = c.name)"
_EWMA = "ewma as (select op, count(*) as n, list_reduce(list(latency_ms order by ts, seq), lambda s, v: 0.9::double * s + 0.1::double * v) as ewma from timed group by op)"


def _tier(a: object, b: object, c: object, d: object) -> str:
    return f"case when rows < 10000 then {a} when rows < 100000 then {b} when rows < 1000000 then {c} else {d} end"


def _histogram(source: str, label: str, value: str, bounds: tuple[float, ...]) -> str:
    les = ", ".join(f"{b}::double" for b in bounds)
    return f"select {label}, le, count_if(v <= le)::bigint as n, count(*) as total, round(sum(v), 6) as sum from (select {label}, {value} as v from {source}), (select unnest([{les}]) as le) where v is not null group by {label}, le"


ORACLE = {
    "access_counts": f"with {_LOG}, {_COUNTS} select * from counts",
    "access_pattern_expiry": f"with {_LOG}, {_COUNTS} select * from counts where last_access >= (select max(ts) from log) - interval 24 hours",
    "frequent_items": f"with {_LOG}, {_COUNTS} select * from counts where accesses >= 5 order by accesses desc, item_key limit 100",
    "transition_counts": f"with {_LOG} select prev, next, count(*) as n from (select item_key as prev, lead(item_key) over (partition by user_id order by ts, seq, item_key) as next from log where item_key is not null and user_id is not null) where next is not null group by 1, 2",
    "predict_next": f"""with {_LOG}, t as (select prev, next, count(*) as n from (select item_key as prev, lead(item_key) over (partition by user_id order by ts, seq, item_key) as next from log where item_key is not null and user_id is not null) where next is not null group by 1, 2),
s as (select prev as key, next as candidate, 0.6::double * n as score from t union all select a.next, b.next, 0.3::double * b.n from t a join t b on a.prev = b.prev),
u as (select key, candidate, round(sum(score), 6) as score from s group by 1, 2), r as (select *, row_number() over (partition by key order by score desc, candidate) as rank from u)
select key, candidate, score, rank::bigint as rank from r where rank <= 5""",
    "warming_candidates": f"with {_WARM} select * from warm",
    "warming_report": f"with {_WARM} select count(*) as candidates, ceil(count(*) / 1000.0)::bigint as batches, count_if(item_key in (select id from store_items))::bigint as warmed, count_if(item_key not in (select id from store_items))::bigint as failed from warm",
    "lru_residency": f"with {_LOG}, l as (select item_key, max((ts, seq)) as last, {_FNV} % 16 as shard from log where item_key is not null group by item_key), r as (select *, row_number() over (partition by shard order by last desc, item_key) as place from l) select shard, item_key, place::bigint as place from r where place <= 50",
    "lru_hit_rate": f"""with {_LOG}, a as (select shard, item_key, row_number() over (partition by shard order by ts, seq, item_key) as i from (select item_key, ts, seq, {_FNV} % 16 as shard from log where item_key is not null)),
p as (select *, lag(i) over (partition by item_key order by i) as before from a),
d as (select p.shard, p.i, count(distinct q.item_key) as between from p join p q on q.shard = p.shard and q.i > p.before and q.i < p.i group by p.shard, p.i)
select p.shard::bigint as shard, count(*) as accesses, count_if(p.before is not null and coalesce(d.between, 0) < 50)::bigint as hits from p left join d on d.shard = p.shard and d.i = p.i group by p.shard""",
    "latency_mean": f"with {_LOG} select op, count(*) as n, round(avg(latency_ms), 6) as latency from timed group by op",
    "hit_rate": f"with {_LOG} select op, round(avg(case when success then 1.0::double when not success then 0.0::double end), 6) as rate, count(success) as n from log group by op",
    "ewma_latency": f"with {_LOG}, {_EWMA} select op, n, round(ewma, 6) as ewma from ewma",
    "ewma_int_latency": f"with {_LOG} select op, count(*) as n, list_reduce(list_concat([0::bigint], list(floor(latency_ms * 1000)::bigint order by ts, seq)), lambda s, v: (9 * s + v) // 10) as ewma from timed group by op",
    "index_stats": f"with {_LOG}, {_EWMA} select l.op, count(*) as queries, round(avg(case when success then 1.0::double when not success then 0.0::double end), 6) as rate, max(ts) as last, round(any_value(ewma), 6) as latency from log l left join ewma e on e.op = l.op group by l.op",
    "search_params": f"with {_SIZES} select name, rows, {_tier(8, 16, 32, 64)}::bigint as nprobe, {_tier(64, 128, 256, 512)}::bigint as ef, {_tier(repr('sequential'), repr('parallel'), repr('parallel'), repr('parallel'))} as mode, {_tier(1, 2, 4, 8)}::bigint as workers from sizes",
    "adaptive_choice": f"with {_LOG}, {_SIZES}, q as (select count_if(op = 'search') as queries from log), m as (select name, rows, rows * dimension * 4 as memory, queries from sizes, q) select name, rows, memory, case when queries < 100 then 'hnsw' when rows > 1000000 and memory > 1073741824 then 'lsh' when rows > 1000000 and rows / 10000.0 > 100 then 'quantization' else 'hnsw' end as index_type from m",
    "adaptive_batch_size": f"with {_LOG}, d as (select date_trunc('day', ts) as day, count(*) as n, avg(case when coalesce(success, false) then 0.0::double else 1.0::double end) as failure, avg(latency_ms) as latency from timed group by 1) select day, n, greatest(100, least(2000, case when failure > 0.1 then 400 when failure < 0.01 and latency < 100 then 600 else 500 end))::bigint as size from d",
    "metric_counters": f"with {_LOG} select op, case when success then 'ok' when not success then 'failed' else 'unknown' end as outcome, count(*) as n from log group by 1, 2",
    "latency_histogram": f"with {_LOG} " + _histogram("timed", "op", "latency_ms / 1000", metrics.CACHE_BOUNDS),
    "store_histogram": _histogram("events", "event_type", "value / 10", metrics.STORE_BOUNDS),
    "check_histogram": _histogram("(select 'check' as kind, * from verification_results)", "kind", "duration_ns / 1e9", metrics.CHECK_BOUNDS),
    "verification_report": "select count_if(end_time is not null)::bigint as finished, count_if(end_time is null)::bigint as unfinished, sum(checked)::bigint as checked, sum(mismatches)::bigint as mismatches, sum(repaired)::bigint as repaired, coalesce(sum(len(errors)), 0)::bigint as errors, count_if(end_time is not null and (epoch_us(end_time) - epoch_us(start_time)) * 1000 <> duration_ns)::bigint as wrong_durations from verification_results",
    "gauge_last": f"with {_LOG} select op, arg_max(latency_ms, (ts, seq)) as latency_ms from timed group by op",
    "tumbling_index_stats": f"with {_LOG} select op, time_bucket(interval 5 minutes, ts) as start, count(*) as n, round(avg(case when latency_ms >= 0 then latency_ms end), 6) as latency, round(avg(case when success then 1.0::double when not success then 0.0::double end), 6) as rate from log group by 1, 2",
}
