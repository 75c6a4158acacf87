"""Queries of audits and metrics: line items play generations, events a training log, orders a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, metrics
from ..sources.corpus import table
from .corpus import SAMPLES, samples
from .registry import query


@query("""
with r as (select doc_id, doc_id % 7 <> 0 as ok, lang, case when doc_id % 7 = 0 then 'no target in ' || source end as error from documents)
select cast(count(*) as bigint) as total, cast(sum(ok::int) as bigint) as valid, cast(sum((not ok)::int) as bigint) as invalid, round(sum(ok::int) / greatest(1, count(*))::double, 6) as valid_rate,
  (select string_agg(lang || '=' || n, ',' order by lang) from (select lang, count(*) as n from r group by 1)) as tasks,
  (select string_agg(error, ',' order by error) from (select distinct error from r where not ok order by error limit 20)) as errors from r""")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select((F.col("doc_id") % 7 != 0).alias("ok"), "lang", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("no target in "), "source")).alias("error"))
    out = metrics.audit(rows, "ok", "lang", "error")
    tasks = F.array_join(F.transform(F.map_entries("tasks"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select("total", "valid", "invalid", F.round("valid_rate", 6).alias("valid_rate"), tasks.alias("tasks"), F.array_join("errors", ",").alias("errors"))


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as prompt_id", "l_linenumber as candidate", "l_partkey", "l_suppkey", "l_returnflag as task", "l_returnflag = 'N' as valid", "l_linestatus = 'O' as eos",
        "l_tax < 0.07 as bos", "l_discount < 0.09 as decoded", "cast(l_extendedprice as bigint) % 5000 as tokens", "cast(l_quantity as bigint) as layers",
    )


GENERATIONS = """generations as (select l_orderkey as prompt_id, l_linenumber as candidate, l_partkey, l_suppkey, l_returnflag as task, l_returnflag = 'N' as valid, l_linestatus = 'O' as eos, l_tax < 0.07 as bos,
  l_discount < 0.09 as decoded, cast(trunc(l_extendedprice) as bigint) % 5000 as tokens, cast(trunc(l_quantity) as bigint) as layers from lineitem)"""


@query(f"""with {GENERATIONS} select task, count(*) as total, round(avg(decoded::int), 6) as decoded_rate, round(avg(valid::int), 6) as valid_rate, round(avg(eos::int), 6) as eos_rate, round(avg(bos::int), 6) as bos_rate,
  round(sum(tokens) / count(*)::double, 6) as avg_tokens, round(sum(case when decoded then layers else 0 end) / greatest(1, sum(decoded::int))::double, 6) as avg_layers from generations group by task""")
def generation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.generation_metrics(generations(spark, sf_dir), ["task"])
    return out.select("task", "total", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query(f"""with {GENERATIONS}, s as (select *, case when valid then 1000.0::double else 0 end + case when eos then 100.0::double else 0 end + least(tokens, 4096) * 0.01::double + least(layers, 256) * 0.1::double as score
  from generations where decoded and tokens >= 10),
r as (select *, row_number() over (partition by prompt_id order by score desc, candidate, l_partkey, l_suppkey) as k, count(*) over (partition by prompt_id) as survivors from s)
select prompt_id, candidate, l_partkey, round(score, 4) as score, survivors from r where k = 1""")
def best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.best_of_n(generations(spark, sf_dir), "prompt_id", ["candidate", "l_partkey", "l_suppkey"])
    return out.select("prompt_id", "candidate", "l_partkey", F.round("score", 4).alias("score"), "survivors")


@query("""
with r as (select event_id // 16 as batch, value as loss, (event_type = 'purchase')::int as eos, length(props) as length from events where event_id // 16 < 8),
b as (select batch, avg(loss) as loss, sum(eos) as eos, sum(length) as length, count(*) as n from r group by 1)
select round(coalesce(avg(loss), 0), 6) as loss, round(sum(eos) / greatest(1, sum(n))::double, 6) as eos_rate, round(sum(length) / greatest(1, sum(n))::double, 6) as avg_length from b""")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr("event_id div 16 as batch", "value as loss", "cast(event_type = 'purchase' as int) as eos", "length(props) as length")
    out = metrics.eval_metrics(rows, "batch", 8)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


LOG = "case event_type when 'click' then 'best_updated' when 'view' then 'eval_step' when 'purchase' then 'run_finished' else event_type end"


@query(f"""with log as (select user_id, {LOG} as event, case when event_id % 3 = 0 then value end as eval_loss, value / 2 as best_eval from events)
select user_id, round(min(coalesce(eval_loss, case when event = 'best_updated' then best_eval end)), 6) as best from log where event in ('best_updated', 'run_finished', 'eval_step') group by 1""")
def best_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").selectExpr("user_id", f"{LOG} as event", "case when event_id % 3 = 0 then value end as eval_loss", "value / 2 as best_eval")
    return metrics.best_loss(log, ["user_id"]).select("user_id", F.round("best", 6).alias("best"))


@query("""
with recursive e as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as k from events),
f as (select user_id, event_id, k, value as best, 0 as waited, false as stopped from e where k = 1
  union all select e.user_id, e.event_id, e.k, case when e.value < f.best - 0.5 then e.value else f.best end, case when e.value < f.best - 0.5 then 0 else f.waited + 1 end,
    f.stopped or (case when e.value < f.best - 0.5 then 0 else f.waited + 1 end) >= 4 from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, event_id as step, round(best, 6) as best, waited, stopped from f""")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.early_stopping(table(spark, sf_dir, "events"), "user_id", "event_id", "value", patience=4, min_delta=0.5)
    return out.select("user_id", "step", F.round("best", 6).alias("best"), "waited", "stopped")


@query("""select user_id, event_id, round(min(value) over w, 6) as best_before, min(value) over w is null or value < min(value) over w as improved
from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)""")
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.running_best(table(spark, sf_dir, "events"), "user_id", "event_id", "value")
    return out.select("user_id", "event_id", F.round("best_before", 6).alias("best_before"), "improved")


@query("select o_orderpriority as split, o_orderstatus as task, count(*) as n from orders group by rollup (1, 2)")
def bench_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), F.col("o_orderstatus").alias("task"))
    return o.rollup("split", "task").agg(F.count("*").alias("n"))


@query("select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by 1")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.newest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""with l as (select o_custkey as doc_id, o_orderkey as ind, case when o_orderkey % 3 = 0 then o_orderkey - 1 when o_orderkey % 7 = 0 then 999999999 end as parent, o_orderkey as pos from orders)
select c.doc_id, c.ind, c.parent, p.pos as parent_pos, case when p.pos is not null then c.parent end as kept_parent from l c left join (select doc_id, ind, min(pos) as pos from l group by 1, 2) p on p.doc_id = c.doc_id and p.ind = c.parent""")
def parent_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.expr("case when o_orderkey % 3 = 0 then o_orderkey - 1 when o_orderkey % 7 = 0 then 999999999 end")
    layers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ind"), parent.alias("parent"), F.col("o_orderkey").alias("pos"))
    return graph.parent_of(layers).select("doc_id", "ind", "parent", "parent_pos", "kept_parent")


@query("""select l_orderkey, l_linenumber, l_partkey, p_name as asset from lineitem left join (select p_partkey, min(p_name) as p_name from part group by 1) on p_partkey = l_partkey""")
def asset_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    assets = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return graph.asset_of(layers, assets, "l_partkey", "p_partkey", "p_name", "asset").select("l_orderkey", "l_linenumber", "l_partkey", "asset")


@query("select o_custkey, o_orderkey, case when o_orderstatus = 'F' then lag(o_orderkey) over (partition by o_custkey order by o_orderkey) end as matte from orders")
def matte_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.matte_source(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey", F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey", "matte")


@query("""with recursive l as (select o_custkey as doc, o_orderkey as ind, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent, cast(round(o_totalprice) as bigint) % 7 as dx from orders),
c as (select doc, ind, ind as node, parent, dx, 1 as depth from l union all select c.doc, c.ind, l.ind, l.parent, c.dx + l.dx, c.depth + 1 from c join l on l.doc = c.doc and l.ind = c.parent)
select doc, ind, cast(max(depth) as int) as depth, cast(arg_max(dx, depth) as bigint) as dx from c group by 1, 2""")
def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    layers = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ind"), prev.alias("parent"), F.expr("cast(round(o_totalprice) as bigint) % 7").alias("dx"))
    return graph.ancestor_sums(layers, "dx")


@query("""with recursive l as (select o_custkey as doc, o_orderkey as ind, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as parent from orders),
gone as (select doc, ind from l where ind % 5 = 0 union select l.doc, l.ind from l join gone g on g.doc = l.doc and l.parent = g.ind)
select doc, ind from l where not exists (select 1 from gone g where g.doc = l.doc and g.ind = l.ind)""")
def recursive_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    layers = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ind"), prev.alias("parent"))
    return graph.delete_with_children(layers, layers.where("ind % 5 = 0").select("doc", "ind")).select("doc", "ind")


@query("""select label, round(min(embedding[1]), 6) as x_min, round(max(embedding[1]), 6) as x_max, round(min(embedding[2]), 6) as y_min, round(max(embedding[2]), 6) as y_max from embeddings group by label""")
def bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))
    out = graph.bounding_box(e, ["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query("select label, round(avg(embedding[1]), 5) as x, round(avg(embedding[2]), 5) as y from embeddings group by label")
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.round(F.avg(F.col("embedding")[0]), 5).alias("x"), F.round(F.avg(F.col("embedding")[1]), 5).alias("y"))


@query(f"""with {SAMPLES} select view, count(*) as n, count(distinct source) as sources from views join samples using (idx) group by view having count(*) > 0""")
def view_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.views import explode_views

    s = samples(spark, sf_dir)
    return explode_views(s, "idx").join(s.select("idx", "source"), "idx").groupBy("view").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))
