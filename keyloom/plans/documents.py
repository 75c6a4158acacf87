"""Queries of nested drawings: a part plays one, with two layers and two assets made from its numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents
from ..sources.corpus import spread, table
from .registry import query

#: The same text in both dialects.
DRAWING = """'{"v":"5.5.2","fr":' || case when p_partkey % 3 = 0 then 30 else p_size end || ',"ip":0.4,"op":' || p_partkey % 300 || ',"w":' || case when p_partkey % 4 = 0 then 512 else p_size * 20 end || ',"h":512,"ddd":0,"layers":['
|| '{"ty":' || p_partkey % 7 || ',"ind":1,"ip":-3.5,"op":9999,"st":0.5,"parent":' || p_size % 3 || ',"ddd":' || p_size % 2 || ',"nm":"first","shapes":[' || case when p_size % 5 = 0 then '' else '{"ty":"gr","it":[{"ty":"' || case when p_size % 4 = 0 then 'sr' else 'rc' end || '","w":1.23456}]},{"ty":"gr","it":[]},7' end || ']},'
|| '{"ty":' || p_size % 6 || ',"ind":2,"ip":0,"op":1,"hasMask":' || case when p_size % 2 = 0 then 'true' else 'false' end || ',"shapes":[{"ty":"' || case when p_size % 4 = 1 then 'mm' else 'el' end || '"}],"ks":{"p":{"a":1,"k":[{"t":0.6,"s":[' || p_size * 30 || ',5]},{"t":2.5}]}}}],'
|| '"assets":[{"id":"a","layers":[{"ty":' || p_size % 7 || '}]},{"id":"b","w":1}]}'"""


def drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", F.expr(DRAWING).alias("text"))


GOOD = "in (0, 1, 3, 4, 5)"


@query(f"select p_partkey, (p_partkey % 7 {GOOD})::int + (p_size % 6 {GOOD})::int as n_layers, 1 + (p_size % 7 {GOOD})::int as n_assets from part")
def schema_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drawings(spark, sf_dir).select("p_partkey", documents.schema_filter(documents.parse(F.col("text"))).alias("d"))
    return kept.select("p_partkey", F.size("d.layers").alias("n_layers"), F.size("d.assets").alias("n_assets"))


@query("select p_partkey, (p_partkey % 7 = 4 and p_size % 5 <> 0) or p_partkey % 7 in (0, 1) or p_size % 6 in (0, 1, 4) as valid from part")
def validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawings(spark, sf_dir).select("p_partkey", documents.is_valid(documents.parse(F.col("text"))).alias("valid"))


@query("""select p_partkey, rule, severity, place from (
select p_partkey, 'frame rate' as rule, 'Error' as severity, null::int as place from part where p_partkey % 3 <> 0 and p_size not in (30, 60)
union all select p_partkey, 'width', 'Error', null from part where p_partkey % 4 <> 0 and p_size * 20 <> 512
union all select p_partkey, 'duration', 'Error', null from part where p_partkey % 300 - 0.4 > 180
union all select p_partkey, 'three dimensions', 'Warning', 0 from part where p_size % 2 = 1
union all select p_partkey, 'text layer', 'Warning', 0 from part where p_partkey % 7 = 5
union all select p_partkey, 'text layer', 'Warning', 1 from part where p_size % 6 = 5
union all select p_partkey, 'image layer', 'Warning', 0 from part where p_partkey % 7 = 2
union all select p_partkey, 'image layer', 'Warning', 1 from part where p_size % 6 = 2
union all select p_partkey, 'mask', 'Note', 1 from part where p_size % 2 = 0
union all select p_partkey, 'merge', 'Warning', 1 from part where p_size % 4 = 1)""")
def sticker_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.violations(drawings(spark, sf_dir), "p_partkey", "text")


@query("""select p_partkey, 'root' as scope, 0 as pos, p_partkey % 7 as ty, 1 as ind, p_size % 3 as parent from part union all select p_partkey, 'root', 1, p_size % 6, 2, null from part union all select p_partkey, 'a', 0, p_size % 7, null, null from part""")
def layer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.layers(drawings(spark, sf_dir), "p_partkey", "text").select("p_partkey", "scope", "pos", F.col("ty").cast("bigint").alias("ty"), "ind", "parent")


@query()
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.walk(drawings(spark, sf_dir), "p_partkey", "text")


@query("""select p_partkey as key, cast(greatest(512, floor((greatest(case when p_partkey % 4 = 0 then 512 else p_size * 20 end, p_size * 30) * 1.1::double + 15) / 16) * 16) as int) as w, cast(p_partkey % 300 as int) as op,
cast(case when p_size % 3 in (1, 2) then p_size % 3 end as bigint) as parent, cast((p_partkey % 7 <> 4 or p_size % 5 <> 0)::int + 1 as int) as n_layers from part where p_partkey % 7 <> 4 or p_size % 5 <> 0""")
def repair_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and first layer of repaired drawings whose first layer stays."""
    fixed = documents.repaired(drawings(spark, sf_dir), "p_partkey", "text").select("key", documents.parse(F.col("text")).alias("d"))
    first = F.col("d.layers")[0]
    return fixed.where(first["ind"] == 1).select("key", F.col("d.w").cast("int").alias("w"), F.col("d.op").cast("int").alias("op"), first["parent"].cast("bigint").alias("parent"), F.size("d.layers").alias("n_layers"))


@query("select p_partkey as key, case when p_size % 5 <> 0 then 1.235::double end as w, false as named from part")
def strip_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.stripped(drawings(spark, sf_dir), "p_partkey", "text")
    width = F.get_json_object("text", "$.layers[0].shapes[0].it[0].w").cast("double")
    return out.select("key", width.alias("w"), F.get_json_object("text", "$.layers[0].nm").isNotNull().alias("named"))


@query("select user_id, count(*) as n, count(distinct json_extract_string(props, '$.page')) as pages from events group by 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.variant_get(F.try_parse_json("props"), "$.page", "string")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct(page).alias("pages"))
