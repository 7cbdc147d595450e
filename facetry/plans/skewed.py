"""Queries of problem 3: per-feature results under heavy skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.operators.skew import feature_members, feature_results, heavy_features
from facetry.sources.tables import table


def p3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = feature_results(feature_members(table(spark, sf_dir, "label2data")))
    return found.select(
        "saved_features", "feature_id", "members", "rows", F.round("weight_sum", 6).alias("weight_sum"), "weight_max",
        F.round("mean_weight", 9).alias("mean_weight"), "top_doc_id", "file_members", F.round("share", 9).alias("share"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_features(feature_results(feature_members(table(spark, sf_dir, "label2data"))))


_MEMBERS = r"""
with rows as (
  select saved_features, try_cast(nullif(regexp_extract(translate(feature_key, '０１２３４５６７８９', '0123456789'),
           '^\s*(?:[A-Za-z]+[_\- ]?)?(\d+)(?:\.0*)?\s*$', 1), '') as bigint) as feature_id,
         doc_id, case when not isnan(weight) then weight end as weight
  from label2data),
members as (
  select saved_features, feature_id, doc_id, count(*) as r, max(weight) as w
  from rows where feature_id is not null and doc_id is not null group by all),
features as (
  select saved_features, feature_id, count(*) as members, sum(r)::bigint as rows, sum(w) as weight_sum, max(w) as weight_max, avg(w) as mean_weight,
         first(doc_id order by w desc, doc_id) filter (w is not null) as top_doc_id
  from members group by all),
files as (select *, sum(members) over (partition by saved_features)::bigint as file_members from features)
"""

QUERIES = {"p3_found": p3_found, "p3_features": p3_features}
SQL = {
    "p3_found": _MEMBERS + "select saved_features, feature_id from files where members * 100 > file_members * 4",
    "p3_features": _MEMBERS
    + """select saved_features, feature_id, members, rows, round(weight_sum, 6) as weight_sum, weight_max,
      round(mean_weight, 9) as mean_weight, top_doc_id, file_members, round(members / file_members, 9) as share from files""",
}
