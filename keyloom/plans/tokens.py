"""Queries of the token language: a part plays a drawing of four commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec, drawing_codec
from ..sources.corpus import table
from .registry import query

BASE = 248320
#: Of ids of assets, which are text.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SHIFT = BASE - codec.FIRST
AT = {k: v + SHIFT for k, v in codec.offsets().items() if v is not None}
C0 = codec.COMMAND + SHIFT

#: The same tokens in SQL. 2.5 rounds to 2, and a negative place goes below its band: there is no clamping.
TOKENS = f"""tokens as (select p_partkey as doc_id, list_concat([{C0}, p_size % 60 + {AT["FREQUENCY"]}, {AT["TIME"]}, p_partkey % 240 + {AT["TIME"]}, {512 + AT["SPACE"]}, {512 + AT["SPACE"]}],
  list_concat([{C0 + 3}, {AT["ANIMATED"]}, cast(round_even(p_size / 2.0::double, 0) as bigint) + {AT["SPACE"]}, {AT["SPACE"]} - p_size], [{C0 + 9}, p_partkey % 101 + {AT["OPACITY"]}, {C0 + 27}]))::bigint[] as tokens from part)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda e: F.expr(f"cast({e} as double)")
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), d(v))])
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("animation").alias("command"), pairs(FR="p_size % 60", IP="0", OP="p_partkey % 240", W="512", H="512", DDD="-2001").alias("params")),
        F.struct(F.lit(1).alias("pos"), F.lit("position").alias("command"), pairs(ANIMATED="0", X="p_size / 2.0", Y="-p_size").alias("params")),
        F.struct(F.lit(2).alias("pos"), F.lit("opacity").alias("command"), pairs(X="p_partkey % 101").alias("params")),
        F.struct(F.lit(3).alias("pos"), F.lit("/layer").alias("command"), pairs(NONE="1").alias("params")),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.*")


def encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode(commands(spark, sf_dir), BASE)


@query(f"with {TOKENS} select doc_id, tokens from tokens")
def encode_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir)


@query("""select p_partkey as doc_id, k as at, (['animation', 'position', 'opacity', '/layer'])[r] as command, v as params from (
select p_partkey, unnest([1, 2, 3, 4]) as r, unnest([0, 6, 10, 12]) as k, unnest([['FR=' || p_size % 60, 'IP=0', 'OP=' || p_partkey % 240, 'W=512', 'H=512'],
['ANIMATED=0', 'X=' || cast(round_even(p_size / 2.0::double, 0) as bigint), 'Y=' || -p_size], ['ANIMATED=' || (p_partkey % 101 + 15712 - 0)], []]) as v from part)""".replace("15712", str(codec.offsets()["OPACITY"] - codec.offsets()["ANIMATED"])))
def decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back from tokens: opacity left its first parameter out, so its value binds to that one by position."""
    rows = codec.decode(encoded(spark, sf_dir), BASE)
    pairs = F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint")))
    return rows.select("doc_id", "at", "command", pairs.alias("params"))


@query(f"with {TOKENS} select doc_id, list_transform(list_concat(tokens, [7, 151936, {BASE + 50000}]), lambda t: case when t >= {C0} and t < {BASE + codec.ADDED} then t - {SHIFT} else t end) as tokens from tokens")
def unshift_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.concat("tokens", F.array(*[F.lit(x).cast("bigint") for x in (7, 151936, BASE + 50000)]))
    return encoded(spark, sf_dir).select("doc_id", F.transform(more, lambda t: codec.unshift(t, BASE)).alias("tokens"))


NOISY = f"""noisy as (select doc_id, list_concat(case when doc_id % 3 = 0 then [] else [{codec.BOS + SHIFT}]::bigint[] end, list_concat(tokens, case when doc_id % 4 = 0 then [{BASE}]::bigint[] else [{BASE}, {codec.EOS + SHIFT}, 5, {codec.EOS + SHIFT}]::bigint[] end)) as tokens, tokens as plain from tokens)"""


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    longs = lambda *x: F.array(*[F.lit(v).cast("bigint") for v in x]).cast("array<bigint>")
    head = F.when(F.col("doc_id") % 3 == 0, longs()).otherwise(longs(codec.BOS + SHIFT))
    tail = F.when(F.col("doc_id") % 4 == 0, longs(BASE)).otherwise(longs(BASE, codec.EOS + SHIFT, 5, codec.EOS + SHIFT))
    return encoded(spark, sf_dir).select("doc_id", F.concat(head, "tokens", tail).alias("tokens"))


@query(f"with {TOKENS}, {NOISY} select doc_id, plain as tokens from noisy")
def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir).select("doc_id", codec.clean(F.col("tokens"), BASE).alias("tokens"))


@query(f"with {TOKENS}, {NOISY} select doc_id, doc_id % 3 <> 0 as has_bos, doc_id % 4 <> 0 as has_eos, cast(len(plain) + (doc_id % 3 <> 0)::int + case when doc_id % 4 = 0 then 0 else 2 end as int) as n_valid from noisy")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noisy(spark, sf_dir).select("doc_id", codec.stats(F.col("tokens"), BASE).alias("s")).select("doc_id", "s.*")


@query(f"with {TOKENS} select doc_id, list_concat([{codec.BOS + SHIFT}]::bigint[], list_concat(tokens, [{codec.EOS + SHIFT}]::bigint[])) as tokens from tokens")
def wrap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, sf_dir).select("doc_id", codec.wrap(F.col("tokens"), BASE).alias("tokens"))


@query("""select p_partkey as doc_id, '(animation FR=' || p_size % 60 || ' IP=0 OP=' || p_partkey % 240 || ' W=512 H=512)' || chr(10) || '(position ANIMATED=0 X=' || cast(round_even(p_size / 2.0::double, 0) as bigint) || ' Y=' || -p_size || ')' || chr(10)
|| '(opacity ANIMATED=' || (p_partkey % 101 + 15712) || ')' || chr(10) || '(/layer)' as text from part""".replace("15712", str(codec.offsets()["OPACITY"] - codec.offsets()["ANIMATED"])))
def sequence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.to_text(codec.decode(encoded(spark, sf_dir), BASE))


@query("""select p_partkey as doc_id, k as pos, c as command, cast(d as int) as depth, x from (select p_partkey, unnest([0, 1, 2, 3, 4]) as k, unnest(['layer', 'group', 'point', '/group', '/layer']) as c, unnest([0, 1, 2, 1, 0]) as d,
unnest([p_size::double, null, p_size / 2.0::double, null, null]) as x from part)""")
def parse_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("(layer X="), "p_size", F.lit(' nm="a b")\n(group)\n  (point X='), (F.col("p_size") / 2.0).cast("string"), F.lit(" Y=[1, 2])\n(/group)\n(/layer)"))
    rows = codec.from_text(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return rows.select("doc_id", "pos", "command", "depth", F.col("params")["X"].alias("x"))


def drawings_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .documents import drawings

    return drawings(spark, sf_dir)


@query()
def encode_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawing_codec.encode_drawings(drawings_of_parts(spark, sf_dir), "p_partkey", "text", BASE, longest=4096, vocabulary=VOCABULARY)


@query("""with l as (select (p_partkey % 7 in (0, 1, 3, 5) or p_partkey % 7 = 4 and p_size % 5 <> 0 and p_size % 4 <> 0)::int + (p_size % 6 in (0, 1, 3, 5) or p_size % 6 = 4 and p_size % 4 <> 1)::int as n,
(p_size % 7 in (0, 1, 3, 5))::int as inner_n from part)
select count(*) as total, count(*) as encoded, count(*) as decoded, cast(sum(n) as bigint) as layers, cast(sum(inner_n) as bigint) as asset_layers from l""")
def roundtrip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape layers without shapes that the language knows are lost to the repair; all other layers of supported types come back."""
    out = drawing_codec.roundtrip_report(drawings_of_parts(spark, sf_dir), "p_partkey", "text", BASE, VOCABULARY)
    return out.select("total", "encoded", "decoded", "layers", "asset_layers")
