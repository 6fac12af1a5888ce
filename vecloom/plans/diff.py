"""Queries on the differences between the store and its cached copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators.diff import item_diff
from vecloom.sources import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return item_diff(table(spark, sf_dir, "store_items"), table(spark, sf_dir, "cache_items"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids for each kind of difference."""
    found = p5_found(spark, sf_dir)
    return found.groupBy("field").agg(F.count("*").alias("ids"))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}


def _json(side: str) -> str:
    """A JSON text as the sorted list of its nodes, numbers by value."""
    atom = "case when j.type in ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') then 'n' || (j.atom ->> '$')::double::varchar else j.type || coalesce(j.atom ->> '$', '') end"
    return f"select p.id, list_sort(list(j.fullkey || ':' || {atom})) as v from pair p, json_tree(p.{side}) j group by p.id"


_FOUND = f"""
with c as (select * from (select *, row_number() over (partition by id order by cached_at desc) as rn from cache_items) where rn = 1),
b as (select s.id, s.content.type as st, c.content.type as ct, s.content.data as sd, c.content.data as cd,
    coalesce(list_sort(map_entries(s.content.format)), []) as sf, coalesce(list_sort(map_entries(c.content.format)), []) as cf,
    s.vector as sv, c.vector as cv, s.metadata as sm, c.metadata as cm, s.created_at as sc, c.created_at as cc, s.expires_at as se, c.expires_at as ce
  from store_items s join c on s.id = c.id),
pair as (select id, sm, cm from b where sm <> cm and json_valid(sm) and json_valid(cm)),
sj as ({_json("sm")}), cj as ({_json("cm")}),
same as (select sj.id from sj join cj on sj.id = cj.id where sj.v = cj.v),
found as (
  select id, 'missing_in_cache' as field from store_items where id not in (select id from c)
  union all select id, 'missing_in_store' from c where id not in (select id from store_items)
  union all select id, 'content_type' from b where st is distinct from ct
  union all select id, 'content_data' from b where sd is distinct from cd
  union all select id, 'content_format' from b where sf is distinct from cf
  union all select id, 'vector' from b where sv is distinct from cv
  union all select id, 'metadata' from b where sm is distinct from cm and id not in (select id from same)
  union all select id, 'created_at' from b where sc is distinct from cc
  union all select id, 'expires_at' from b where se is distinct from ce)"""

ORACLE = {
    "p5_found": f"{_FOUND} select id, field from found",
    "p5_report": f"{_FOUND} select field, count(*) as ids from found group by field",
}
