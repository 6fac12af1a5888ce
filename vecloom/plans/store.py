"""Queries over the item store and its cached copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import keys, metadata
from vecloom.operators import cache, items
from vecloom.runtime import scratch
from vecloom.sources import table

PROBE = "note"


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "store_items")


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cache_items")


def _cached_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cached rows that count: the latest of each id."""
    return items.last_write(_cache(spark, sf_dir), "id", "cached_at")


def _flat(df: DataFrame) -> DataFrame:
    """Columns of an item without its content; missing numbers are -1."""
    return df.select("id", F.col("content.type").alias("type"), F.coalesce(F.octet_length("content.data").cast("bigint"), F.lit(-1)).alias("bytes"), F.coalesce("created_at", F.lit(-1)).alias("created_at"), F.coalesce("expires_at", F.lit(-1)).alias("expires_at"))


_FLAT = "id, content.type as type, coalesce(octet_length(encode(content.data)), -1)::bigint as bytes, coalesce(created_at, -1)::bigint as created_at, coalesce(expires_at, -1)::bigint as expires_at"


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item of the greatest id."""
    rows = _store(spark, sf_dir)
    return _flat(items.by_id(rows, rows.agg(F.max("id")).first()[0]))


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items named by the access log's searches."""
    asked = table(spark, sf_dir, "access_log").filter("lower(trim(op)) = 'search' and item_key is not null").select(F.col("item_key").alias("id"))
    return _flat(items.by_ids(_store(spark, sf_dir), asked))


def predicate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(items.where(_store(spark, sf_dir), (F.col("content.type") == "code") & (F.octet_length("content.data") > 1024) & F.col("expires_at").isNotNull()))


def full_scan_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any hundred items: the first by id."""
    return _flat(items.where(_store(spark, sf_dir), F.lit(True), 100))


def projection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).select("id")


def dataset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).agg(F.count("*").alias("n"))


def recent_items_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day before the newest item, newest first, a thousand at most; times in microseconds."""
    return items.recent(_store(spark, sf_dir)).select("id", F.expr("created_at div 1000").alias("created_us"))


def batch_set_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.problems(_store(spark, sf_dir))


def content_type_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).groupBy(F.coalesce("content.type", F.lit("?")).alias("type")).agg(F.count("*").alias("n"), F.max(keys.valid_type(F.col("content.type"))).alias("valid"))


def dimension_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).groupBy(F.coalesce(F.size("vector"), F.lit(-1)).cast("bigint").alias("dimension")).agg(F.count("*").alias("n"))


def write_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid items are written and read again; what should have been written and is not there."""
    rows = _store(spark, sf_dir)
    good = rows.join(items.problems(rows).select("id").distinct(), "id", "left_anti")
    path = scratch(spark, "written")
    written = items.write_batch(good, path)
    return items.unwritten(good, path).agg(F.count("*").alias("missing")).withColumn("written", F.lit(written).cast("bigint"))


def delete_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store without the items that the access log deletes."""
    return items.delete(_store(spark, sf_dir), _deleted(spark, sf_dir)).select("id", "created_at")


def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "access_log").filter("lower(trim(op)) = 'delete' and item_key is not null").select(F.col("item_key").alias("id")).distinct()


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every deleted id whether store and cache held it, and whether they still do."""
    gone = _deleted(spark, sf_dir)
    has = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(True))
    store, cached = _store(spark, sf_dir), _cache(spark, sf_dir)
    out = gone
    for df, name in ((store, "store_before"), (cached, "cache_before"), (items.delete(store, gone), "store_after"), (items.delete(cached, gone), "cache_after")):
        out = out.join(has(df, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after the cached copies are written back to it."""
    updates = _cached_once(spark, sf_dir).select("id", "content", "vector", "metadata", "created_at", "expires_at")
    return _flat(items.upsert(_store(spark, sf_dir), updates))


def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached_once(spark, sf_dir).select("id", "cache_key", F.coalesce(F.octet_length("content.data"), F.lit(-1)).cast("bigint").alias("bytes"), "cached_at")


def flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and ends of every batch of 2000 rows in order of creation."""
    rows = _store(spark, sf_dir).select("id", "created_at")
    return items.flush_batches(rows, ["created_at", "id"]).groupBy("batch").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def ingest_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid vectors with their cell and hash bucket in the first table, as an index would store them."""
    from vecloom.operators import lsh, quantize

    rows = table(spark, sf_dir, "embeddings")
    coded = quantize.assign(rows, quantize.first_rows(rows, 8, "vec_id", "embedding"), "vec_id", "embedding").select(F.col("id").alias("vec_id"), "code")
    hashed = lsh.buckets(rows, lsh.SINGLE, "vec_id", "embedding").filter("table_id = 0").select(F.col("id").alias("vec_id"), "bucket")
    return coded.join(hashed, "vec_id")


def read_through_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every accessed key is read from."""
    asked = table(spark, sf_dir, "access_log").filter("item_key is not null").select(F.col("item_key").alias("id"))
    found = items.read_through(asked, _cached_once(spark, sf_dir), _store(spark, sf_dir))
    return found.select("id", "source", F.col("content.type").alias("type"))


def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the metadata; broken metadata reads as empty."""
    parsed = F.try_parse_json("metadata")
    return _store(spark, sf_dir).select("id", F.try_variant_get(parsed, "$.collection", "string").alias("collection"), F.try_variant_get(parsed, "$.index_type", "string").alias("index_type"), F.try_variant_get(parsed, "$.noise_level", "double").alias("noise_level"))


def metadata_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with the index of its item put in, read again; what was no object becomes one."""
    put = metadata.put(F.col("metadata"), index_type=F.lit("ivf"), vector_idx=F.length("id"))
    back = F.try_parse_json("written")
    return _store(spark, sf_dir).withColumn("written", put).select("id", F.try_variant_get(back, "$.collection", "string").alias("collection"), F.try_variant_get(back, "$.index_type", "string").alias("index_type"), F.try_variant_get(back, "$.vector_idx", "bigint").alias("vector_idx"))


def compression_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries above the threshold, by type: number and bytes."""
    rows = _cache(spark, sf_dir).filter(keys.compressible(F.col("content.data")))
    return rows.groupBy(F.coalesce("content.type", F.lit("?")).alias("type")).agg(F.count("*").alias("n"), F.sum(F.octet_length("content.data").cast("bigint")).alias("bytes"))


def compression_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes before and after compression, and texts that do not come back."""
    rows = _store(spark, sf_dir).select(F.encode("content.data", "utf-8").alias("data")).filter("data is not null")
    held = rows.withColumn("held", cache.compressed(F.col("data")))
    return held.agg(F.sum(F.octet_length("data").cast("bigint")).alias("bytes"), F.sum(F.octet_length("held").cast("bigint")).alias("held"), F.count_if(~cache.inflated(F.col("held")).eqNullSafe(F.col("data"))).alias("lost"))


def _now(df: DataFrame) -> DataFrame:
    return F.broadcast(df.agg(F.max(cache.nanoseconds(F.col("cached_at"))).alias("now")))


def ttl_live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that live a week after the newest was cached, with their time to live."""
    rows = _cache(spark, sf_dir)
    alive = cache.live(rows.join(_now(rows)), F.col("now") + F.lit(7 * keys.DAY_NS))
    return alive.select("cache_key", "cached_at", "ttl_ns")


def byte_budget_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four shards of a mebibyte keep of the cached entries, newest first."""
    rows = _cached_once(spark, sf_dir).filter("content.data is not null").select("id", F.octet_length("content.data").cast("bigint").alias("bytes"), F.unix_micros(F.col("cached_at").cast("timestamp")).alias("at"))
    return cache.within_budget(rows, 1 << 20, 4)


def shard_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).select("id", keys.shard_of(F.col("id"), 16).alias("shard"))


def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: items checked, missing in the cache, differing by field, and mismatching at all (as a repair would mend)."""
    joined = _compared(spark, sf_dir)
    return joined.agg(F.count("*").alias("checked"), *[F.count_if(F.col(c)).alias(c) for c in ("missing", "type", "data", "vector", "metadata")], F.count_if(F.col("missing") | F.col("type") | F.col("data") | F.col("vector") | F.col("metadata")).alias("mismatches"))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda df, n: df.select("id", F.struct(F.col("content.type").alias("type"), F.col("content.data").alias("data"), "vector", "metadata").alias(n))
    both = side(_store(spark, sf_dir), "s").join(side(_cached_once(spark, sf_dir), "c"), "id", "left")
    missing = F.col("c").isNull()
    return both.select("id", missing.alias("missing"), *[(~missing & ~F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}"))).alias(f) for f in ("type", "data", "vector", "metadata")])


def consistency_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the repair does with every id of the store: insert, update or keep."""
    c = _compared(spark, sf_dir)
    return c.select("id", F.when(F.col("missing"), "insert").when(F.col("type") | F.col("data") | F.col("vector") | F.col("metadata"), "update").otherwise("keep").alias("action"))


QUERIES = {f.__name__: f for f in (metadata_put, point_lookup, multi_get, predicate_scan, full_scan_limit, projection_ids, dataset_size, recent_items_scan, batch_set_validation, content_type_validation, dimension_validation, write_verification, delete_by_ids, delete_cascade, upsert_items, last_write_wins, flush_batches, ingest_enriched, read_through_get, metadata_extract, compression_candidates, compression_round_trip, ttl_live_entries, byte_budget_eviction, shard_of_key, consistency_check, consistency_repair)}

_VALID = "coalesce(content.type in ('text', 'code', 'math', 'json', 'markdown', ''), false)"
_BYTES = "octet_length(encode(content.data))"
_ONCE = "once as (select * from (select *, row_number() over (partition by id order by cached_at desc) as rn from cache_items) where rn = 1)"
_GONE = "gone as (select distinct item_key as id from access_log where lower(trim(op)) = 'delete' and item_key is not null)"
_PROBLEMS = f"""problems as (
  select id, 'id' as problem from store_items where id is null or length(id) > 256 or id = ''
  union all select id, 'content_type' from store_items where not {_VALID}
  union all select id, 'dimension' from store_items where vector is null or len(vector) <> 64
  union all select id, 'content_data' from store_items where coalesce({_BYTES} > 65535, false)
  union all select id, 'expiry' from store_items where coalesce(expires_at < created_at, false))"""
_FNV = "list_reduce(list_concat([2166136261::bigint], [ascii(c)::bigint for c in string_split(id, '')]), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
_COMPARED = f"""{_ONCE}, compared as (select s.id, c.id is null as missing,
  c.id is not null and s.content.type is distinct from c.content.type as type, c.id is not null and s.content.data is distinct from c.content.data as data,
  c.id is not null and s.vector is distinct from c.vector as vector, c.id is not null and s.metadata is distinct from c.metadata as metadata
  from store_items s left join once c on s.id = c.id)"""
_NS = "epoch_us(cached_at) * 1000"
_JSON = "case when json_valid(metadata) then metadata end"

ORACLE = {
    "point_lookup": f"select {_FLAT} from store_items where id = (select max(id) from store_items)",
    "multi_get": f"select {_FLAT} from store_items where id in (select item_key from access_log where lower(trim(op)) = 'search')",
    "predicate_scan": f"select {_FLAT} from store_items where content.type = 'code' and {_BYTES} > 1024 and expires_at is not null",
    "full_scan_limit": f"select {_FLAT} from store_items order by id limit 100",
    "projection_ids": "select id from store_items",
    "dataset_size": "select count(*) as n from store_items",
    "recent_items_scan": "select id, created_at // 1000 as created_us from store_items where created_at >= (select max(created_at) from store_items) - 86400000000000 order by created_at desc, id limit 1000",
    "batch_set_validation": f"with {_PROBLEMS} select * from problems",
    "content_type_validation": f"select coalesce(content.type, '?') as type, count(*) as n, bool_or({_VALID}) as valid from store_items group by 1",
    "dimension_validation": "select coalesce(len(vector), -1)::bigint as dimension, count(*) as n from store_items group by 1",
    "write_verification": f"with {_PROBLEMS} select 0::bigint as missing, count(*) as written from store_items where id not in (select id from problems)",
    "delete_by_ids": f"with {_GONE} select id, created_at from store_items where id not in (select id from gone)",
    "delete_cascade": f"with {_GONE} select id, id in (select id from store_items) as store_before, id in (select id from cache_items) as cache_before, false as store_after, false as cache_after from gone",
    "upsert_items": f"with {_ONCE} select {_FLAT} from store_items where id not in (select id from once) union all select {_FLAT} from once",
    "last_write_wins": f"with {_ONCE} select id, cache_key, coalesce({_BYTES}, -1)::bigint as bytes, cached_at from once",
    "flush_batches": "select i // 2000 as batch, count(*) as n, min(created_at) as first, max(created_at) as last from (select created_at, row_number() over (order by created_at, id) - 1 as i from store_items) group by 1",
    "read_through_get": f"with {_ONCE}, k as (select distinct item_key as id from access_log where item_key is not null) select k.id, case when c.id is not null then 'cache' when s.id is not null then 'store' else 'miss' end as source, case when c.id is not null then c.content.type else s.content.type end as type from k left join once c on k.id = c.id left join store_items s on k.id = s.id",
    "metadata_put": "select id, case when json_valid(metadata) then json_extract_string(metadata, '$.collection') end as collection, 'ivf' as index_type, length(id) as vector_idx from store_items",
    "metadata_extract": f"select id, json_extract_string({_JSON}, '$.collection') as collection, json_extract_string({_JSON}, '$.index_type') as index_type, try_cast(json_extract_string({_JSON}, '$.noise_level') as double) as noise_level from store_items",
    "compression_candidates": f"select coalesce(content.type, '?') as type, count(*) as n, sum({_BYTES})::bigint as bytes from cache_items where {_BYTES} > 1024 group by 1",
    "ttl_live_entries": f"with n as (select max({_NS}) as now from cache_items), t as (select cache_key, cached_at, case when expires_at > {_NS} then expires_at - {_NS} else 86400000000000 end as ttl_ns from cache_items) select cache_key, cached_at, ttl_ns from t, n where now + 604800000000000 - {_NS} < ttl_ns",
    "byte_budget_eviction": f"with {_ONCE}, e as (select id, {_BYTES}::bigint as bytes, {_FNV} % 4 as shard, epoch_us(cached_at) as age from once where content.data is not null and {_BYTES} <= 1048576), t as (select shard, id, bytes, sum(bytes) over (partition by shard order by age desc, id)::bigint as total from e) select shard, id, bytes, total from t where total <= 1048576",
    "shard_of_key": f"select id, {_FNV} % 16 as shard from store_items",
    "consistency_check": f"with {_COMPARED} select count(*) as checked, count_if(missing)::bigint as missing, count_if(type)::bigint as type, count_if(data)::bigint as data, count_if(vector)::bigint as vector, count_if(metadata)::bigint as metadata, count_if(missing or type or data or vector or metadata)::bigint as mismatches from compared",
    "consistency_repair": f"with {_COMPARED} select id, case when missing then 'insert' when type or data or vector or metadata then 'update' else 'keep' end as action from compared",
}

from vecloom.plans.vectors import _ASSIGN, _book_sql, _planes  # noqa: E402
from vecloom.operators.lsh import SINGLE  # noqa: E402

ORACLE["ingest_enriched"] = f"with {_book_sql(8)}, {_ASSIGN}, {_planes(SINGLE)} select vec_id, code, bucket from assigned join b using (vec_id) where table_id = 0"
