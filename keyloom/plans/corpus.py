"""Queries over stand-in training rows: documents with their labels play the samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, views
from ..operators.rank import global_rank
from ..sources.corpus import row_subset, scan_parquet, table, with_position
from .registry import query

#: The stand-in, once for DuckDB.
SAMPLES = """
samples as (
  select d.doc_id as idx, case when d.doc_id % 11 = 0 then '' else d.text end as detail,
    case when l.quality is not null then 'q' || l.quality end as image, case when l.toxic = 1 then 'v' end as video,
    case when d.doc_id % 7 <> 0 then 't' end as target, d.source,
    case d.doc_id % 5 when 0 then 'text' when 1 then ' Text-Image_to-drawing ' when 2 then 'video2drawing' when 3 then 'mixed' end as task_type
  from documents d left join labels l using (doc_id)),
normal as (
  select *, case when task_type is null or task_type = 'text' then 'text' when task_type like '%Text-Image%' then 'image' when task_type = 'video2drawing' then 'video' else 'mixed' end as label
  from samples),
views as (
  select idx, view from normal, (select unnest(['text', 'image', 'video']) as view) v
  where target is not null and (label = 'mixed' or label = view)
    and case view when 'text' then detail <> '' when 'image' then detail <> '' and image is not null else video is not null end)
"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in rows: text, the label as an image, toxic as a video, task labels in several spellings."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    task = F.expr("case doc_id % 5 when 0 then 'text' when 1 then ' Text-Image_to-drawing ' when 2 then 'video2drawing' when 3 then 'mixed' end")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("idx"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.col("text")).alias("detail"),
        F.expr("'q' || quality").alias("image"),
        F.when(F.col("toxic") == 1, "v").alias("video"),
        F.when(F.col("doc_id") % 7 != 0, "t").alias("target"),
        "source",
        task.alias("task_type"),
    )


def sample_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.explode_views(samples(spark, sf_dir), "idx")


@query("select count(*) as n_rows, count(distinct l_orderkey) as n_orders, 1 as n_files from lineitem")
def scan_parquet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(scan_parquet(spark, f"{sf_dir}/lineitem.parquet"))
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct("l_orderkey").alias("n_orders"), F.least(F.lit(1), F.count_distinct("file_path")).cast("int").alias("n_files"))


@query("select o_orderkey, o_custkey, o_totalprice from (select *, row_number() over () - 1 as i from orders) where i % 997 = 3")
def row_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_position(table(spark, sf_dir, "orders"))
    wanted = rows.where("row_index % 997 = 3").select("file_path", "row_index")
    return rows.join(wanted, ["file_path", "row_index"], "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"with {SAMPLES} select idx, md5(coalesce(nullif(video, ''), nullif(detail, ''), nullif(image, ''))) as value_md5 from samples")
def first_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("idx", F.md5(views.first_present("video", "detail", "image").cast("binary")).alias("value_md5"))


@query(f"with {SAMPLES} select idx, label from normal")
def norm_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("idx", views.normalize_task(F.col("task_type")).alias("label"))


@query(f"with {SAMPLES} select idx, view from views")
def task_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_views(spark, sf_dir)


@query(f"with {SAMPLES} select v.view, count(idx) as n from (select unnest(['text', 'image', 'video']) as view) v left join views using (view) group by 1")
def task_view_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.histogram(sample_views(spark, sf_dir))


RATIOS = {"text": 1.0, "image": 1.2, "video": 1.4}
RESAMPLED = """
ranked as (select view, idx, row_number() over (partition by view order by idx) - 1 as i, count(*) over (partition by view) as pool, count(*) over () as total from views),
needed as (select *, greatest(1, cast(round_even(total * (case view when 'text' then 1.0::double when 'image' then 1.2::double else 1.4::double end / 3.6::double), 0) as int)) as need from ranked),
drawn as (select view, idx, cast(ceil((need - i) / pool::double) as int) as reps from needed where i < need)
"""


@query(f"with {SAMPLES}, {RESAMPLED} select view, idx, reps from drawn")
def ratio_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ratio_resample(sample_views(spark, sf_dir), "idx", RATIOS)


@query(f"with {SAMPLES}, {RESAMPLED} select idx, view, n from views join (select idx, cast(sum(reps) as bigint) as n from drawn group by 1) using (idx)")
def mixed_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = sample_views(spark, sf_dir)
    return views.mixed_views(v, views.ratio_resample(v, "idx", RATIOS), "idx")


@query("""
with best as (select case event_type when 'click' then 'text' when 'view' then 'image' when 'purchase' then 'video' end as view, min(value) as loss from events group by 1),
three as (select v.view, b.loss, count(b.loss) over () = 3 as complete from (select unnest(['text', 'image', 'video']) as view) v left join best b using (view))
select view, round(case when complete then 0.25::double + greatest(loss, 1e-6::double) else case view when 'text' then 1.0::double when 'image' then 1.2::double else 1.4::double end end, 6) as ratio from three""")
def adaptive_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_type when 'click' then 'text' when 'view' then 'image' when 'purchase' then 'video' end")
    best = table(spark, sf_dir, "events").groupBy(kind.alias("view")).agg(F.min("value").alias("loss"))
    three = spark.createDataFrame([(v,) for v in views.VIEWS], "view string").join(best, "view", "left")
    complete = three.agg((F.count("loss") == 3).alias("complete"))
    ratio = views.adaptive_ratio(F.col("loss"), F.col("complete"), F.col("view"))
    return three.crossJoin(F.broadcast(complete)).select("view", F.round(ratio, 6).alias("ratio"))


@query("select x.position, o.o_orderkey, o.o_orderstatus from (select unnest([3, 3, 1, 700, -5, 123456789]) as id, unnest([0, 1, 2, 3, 4, 5]) as position) x join orders o on o.o_orderkey = x.id")
def row_subset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame(list(enumerate([3, 3, 1, 700, -5, 123456789])), "position int, id long")
    return row_subset(table(spark, sf_dir, "orders"), ids, "o_orderkey").select("position", "o_orderkey", "o_orderstatus")


@query("""
with r as (select doc_id as idx, doc_id % 23 < 4 as ok, count(*) over () as n from documents),
two as (select idx, case when ok then idx end as good, n from r union all select idx + n, case when ok then idx end, n from r where idx < 15)
select idx, chosen from (select idx, n, first_value(good ignore nulls) over (order by idx rows between current row and 15 following) as chosen from two) where idx < n""")
def next_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 23 < 4).alias("ok"))
    return views.next_valid(rows, "idx", "ok", run=256)


@query(f"with {SAMPLES} select source, count(*) as n from normal where label = 'image' group by source")
def filter_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).where(views.normalize_task(F.col("task_type")) == "image")
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("""
select conv_id, count(*) as n_turns, cast(sum(case when role = 'user' then 1 else 0 end) as bigint) as n_user, md5(string_agg(role || ':' || text, chr(10) order by turn)) as chat_md5
from conversations group by conv_id""")
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chat = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.md5(chat.cast("binary")).alias("chat_md5"))


@query(f"""
with {SAMPLES} select v.idx, v.view, case view when 'text' then 'text' when 'image' then 'image,text' else 'video' end as parts from views v""")
def condition_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir)
    m = assembly.messages(F.col("detail"), F.col("image"), F.col("video"), F.col("view"))
    kinds = F.array_join(F.transform(m[1]["content"], lambda p: p["kind"]), ",")
    return sample_views(spark, sf_dir).join(s, "idx").select("idx", "view", kinds.alias("parts"))


LIMIT = 512


@query(f"""
with t as (select doc_id, length(text) // 7 as condition, n_chars // 3 as target, doc_id % 3 = 0 as media from documents),
r as (select *, case when media then greatest(1, {LIMIT} - condition) else least(target, {min(1024, max(256, LIMIT // 2))}) end as room from t),
k as (select *, least(target, room) as kept_target from r),
c as (select *, case when media then condition else least(condition, greatest(1, {LIMIT} - kept_target)) end as kept_condition from k)
select doc_id, cast(kept_target as bigint) as target_length, cast(kept_condition as bigint) as condition_length, target > room as truncated_target, kept_condition < condition as truncated_condition,
  media and kept_condition + kept_target > {LIMIT} as overflow from c""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("length(text) div 7").alias("condition"), F.expr("n_chars div 3").alias("target"), (F.col("doc_id") % 3 == 0).alias("media"))
    out = assembly.budgets(F.col("condition"), F.col("target"), F.col("media"), LIMIT)
    return rows.select("doc_id", *[(v.cast("bigint") if k.endswith("length") else v).alias(k) for k, v in out.items()])


#: Arrays to assemble: the lengths of a document's words, and its turn of small numbers.
ARRAYS = """
arrays as (select doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) as condition,
  list_transform(range(1, 3 + doc_id % 6), lambda x: x * doc_id) as target from documents)
"""


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.expr("transform(split(text, ' '), w -> cast(length(w) as bigint))").alias("condition"),
        F.expr("transform(sequence(1L, 2 + doc_id % 6), x -> x * doc_id)").alias("target"),
    )


@query(f"with {ARRAYS} select doc_id, list_concat(condition, target) as input_ids, list_concat(list_transform(condition, lambda x: -100::bigint), target) as labels from arrays")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("condition"), F.col("target")
    return arrays(spark, sf_dir).select("doc_id", F.concat(c, t).alias("input_ids"), assembly.labels(c, t).alias("labels"))


@query(f"with {ARRAYS} select doc_id, case when len(target) > 4 then list_concat(list_slice(target, 1, 3), [-1::bigint]) else target end as target from arrays")
def cut_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("doc_id", assembly.cut_target(F.col("target"), F.lit(4), -1).alias("target"))


@query(f"""
with {ARRAYS}, b as (select *, doc_id // 8 as batch_id from arrays),
w as (select batch_id, max(len(condition)) as c, max(len(target)) as t from b group by 1)
select doc_id, batch_id, list_concat(condition, list_transform(range(c - len(condition)), lambda x: 0::bigint)) as condition,
  list_concat(target, list_transform(range(t - len(target)), lambda x: -100::bigint)) as target from b join w using (batch_id)""")
def collate_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = global_rank(arrays(spark, sf_dir), "doc_id", name="row")
    return assembly.collate(rows, "row", 8, {"condition": 0, "target": assembly.IGNORED}).select("doc_id", "batch_id", "condition", "target")


@query(f"with {ARRAYS} select doc_id, list_concat(list_transform(range(greatest(0, 12 - len(condition))), lambda x: 9::bigint), condition) as prompt from arrays")
def left_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays(spark, sf_dir).select("doc_id", assembly.pad(F.col("condition"), 9, F.lit(12), left=True).alias("prompt"))


@query(f"""
with {ARRAYS} select reason, count(*) as n from (select case when len(condition) <> len(condition) - (doc_id % 13 = 0)::int then 'mask length'
  when doc_id % 5 = 0 and len(condition) <> len(target) then 'label length' when doc_id % 4 = 3 then 'grid shape' when (doc_id % 8) * 16 // 4 <> 16 then 'media tokens' end as reason from arrays) group by 1""")
def shape_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrays(spark, sf_dir)
    mask = F.when(F.col("doc_id") % 13 == 0, F.slice("condition", F.lit(1), F.greatest(F.lit(0), F.size("condition") - 1))).otherwise(F.col("condition"))
    grid = F.when(F.col("doc_id") % 4 == 3, F.array(F.lit(1).cast("bigint"), F.lit(4).cast("bigint"))).otherwise(F.array(F.col("doc_id") % 8, F.lit(4).cast("bigint"), F.lit(4).cast("bigint")))
    label = F.when(F.col("doc_id") % 5 == 0, F.col("target")).otherwise(F.col("condition"))
    reason = assembly.shape_reason(F.col("condition"), mask, label, grid, F.lit(16))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("select sha1(text) as key, count(*) as n, min(doc_id) as first_id from documents group by 1")
def media_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.sha1(F.col("text").cast("binary")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("select page_id, list_transform(range(0, 8), lambda i: cast(floor(i * (length(html) - 1) / 7::double) as int)) as frames from pages")
def frame_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight of a clip's frames, evenly spread, fractions cut off; the page's length plays the clip's."""
    return table(spark, sf_dir, "pages").select("page_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.floor(i * (F.length("html") - 1) / 7.0).cast("int")).alias("frames"))


@query(f"""
with {SAMPLES}, firsts as (select source from samples order by idx limit 400) select coalesce(nullif(source, ''), 'unknown') as source, count(*) as n from firsts group by 1""")
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = samples(spark, sf_dir).dropDuplicates(["idx"]).orderBy("idx").limit(400)
    return firsts.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


@query("select distinct user_id, first_event from (select user_id, min(event_id) as first_event from events group by 1) order by first_event limit 50")
def first_k_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event")).orderBy("first_event").limit(50)
