"""Chat formatting (operator 2): schema fingerprints select declarative mappings, DataFrame functions only.

A row's fingerprint is a hash of the nested field paths that it fills. A registry maps fingerprints to mappings, each
of which says, as SQL over the row, what the row's turns are; so prompt, instruction and message layouts
in one table become the same array of (role, text). A template marks the turns, and control strings inside a text
are escaped so that reading back gives exactly what went in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_or_null, folded, literal_rows

#: The template's marks, and strings that other templates use for control.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
FOREIGN = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Roles under the loss mask.
LEARNED = "assistant"


@dataclass(frozen=True)
class Mapping:
    """paths: nested fields that make the layout, those of array elements with []; optional ones may be null.
    turns: SQL of an array of struct(role, text) over the row."""

    name: str
    paths: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = ()


def _pair(user: str, assistant: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {user}), named_struct('role', 'assistant', 'text', {assistant}))"


_ROLE = "case lower(m.from) when 'human' then 'user' when 'gpt' then 'assistant' else m.from end"

MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Mapping("from_value", ("conversations[].from", "conversations[].value"), f"transform(conversations, m -> named_struct('role', {_ROLE}, 'text', m.value))"),
    Mapping("prompt_response", ("prompt", "response"), _pair("prompt", "response")),
    Mapping("prompt_completion", ("prompt", "completion"), _pair("prompt", "completion")),
    Mapping("instruction", ("instruction", "output"), _pair("concat_ws('\\n', instruction, nullif(input, ''))", "output"), ("input",)),
    Mapping("question_answer", ("question", "answer"), _pair("question", "answer")),
    Mapping("turn", ("role", "text"), "array(named_struct('role', role, 'text', text))", ("conv_id", "turn")),
)


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a type, in order; elements of arrays are marked []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: Column) -> Column:
    """Hash of a set of paths, whatever their order."""
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def row_fingerprint(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Of the paths that the mappings know and whose top-level field isn't null in the row."""
    optional = {p for m in mappings for p in m.optional}
    known = {p for m in mappings for p in m.paths} - optional
    there = [p for p in field_paths(df.schema) if p in known]
    top = lambda p: p.split("[")[0].split(".")[0]
    filled = [F.when(F.col(f"`{top(p)}`").isNotNull(), F.lit(p)) for p in there]
    return fingerprint(F.array_compact(F.array(*filled))) if filled else fingerprint(F.array().cast("array<string>"))


def turns_of(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The row's turns, array of (role, text), by the mapping its fingerprint selects; null if none fits."""
    here = set(field_paths(df.schema))
    print_ = row_fingerprint(df, mappings)
    kind = "array<struct<role:string,text:string>>"
    out = F.lit(None).cast(kind)
    for m in mappings:
        if set(m.paths) <= here:
            sql = reduce(lambda s, p: s if p in here else s.replace(f"nullif({p}, '')", "null"), m.optional, m.turns)
            out = F.when(print_ == fingerprint(F.array(*map(F.lit, m.paths))), F.expr(sql).cast(kind)).otherwise(out)
    return out


def escape(text: Column) -> Column:
    """Backslashes are doubled; then one goes behind the first character of each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in FOREIGN:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turns: Column) -> Column:
    """Turns as one string; null roles and texts are empty."""
    clean = lambda c: escape(F.coalesce(c, F.lit("")))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), clean(t["role"]), F.lit(TEXT), clean(t["text"]), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """The turns that a rendered string holds, and where each text stands in it: (role, text, start, end)."""
    whole = F.filter(F.split(formatted, r"(?<=<\|end\|>)", -1), lambda p: p != "")
    cut = F.transform(whole, lambda p: F.struct(F.length(p).alias("size"), F.split(p, r"<\|turn\|>|<\|text\|>|<\|end\|>", -1).alias("part")))


    def sums(sizes: Column) -> Column:
        def step(before: Column, i: Column) -> tuple[Column, Column]:
            end = before + F.get(sizes, i)
            return end, F.array(end)

        return folded(F.size(sizes), F.array().cast("array<int>"), step)

    # the sizes are bound to a name, else each step would reckon all of them
    ends = F.flatten(F.transform(F.array(F.transform(whole, F.length)), sums))

    def one(c: Column, end: Column) -> Column:
        role, text = F.get(c["part"], F.lit(1)), F.get(c["part"], F.lit(2))
        stop = end - F.lit(len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"), (stop - F.length(text)).alias("start"), stop.alias("end"))

    return F.zip_with(cut, ends, one)


def format_chats(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Every row with its turns (null where no layout fits) and the formatted string, after its own columns.

    Those two columns replace any of the same name. Empty tables give no rows.
    """
    turns = turns_of(df, mappings)
    return df.withColumns({"chat_turns": turns}).withColumn("chat_text", render(F.col("chat_turns")))


def gather(rows: DataFrame) -> DataFrame:
    """(conv_id, chat_turns): rows by turn become conversations, ordered by turn (null first), role and text.

    A conversation is one string in the end, so its rows meet in one place; equal rows stay as they are.
    """
    rows = columns_or_null(rows, conv_id="bigint", turn="bigint", role="string", text="string")
    rows = rows.fillna("", ["role", "text"])
    one = rows.select("conv_id", "turn", F.get(turns_of(rows), F.lit(0)).alias("t"))
    sets = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "t.role", "t.text"))).alias("all"))
    return sets.select("conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chat_turns"))


#: Fixed value: the conversation that the query adds.
EXTRA = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns_or_null(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv_id="bigint", turn="bigint", role="string", text="string")
    extra = literal_rows(spark, [(-1, 0, "user", EXTRA), (-1, 1, "assistant", EXTRA)], "conv_id bigint, turn bigint, role string, text string")
    formatted = gather(rows.unionByName(extra)).select("conv_id", render(F.col("chat_turns")).alias("chat_text"))
    back = formatted.select("conv_id", "chat_text", parse(F.col("chat_text")).alias("turns"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform(F.filter("turns", lambda t: t["role"] == LEARNED), lambda t: unescape(F.substring(F.col("chat_text"), t["start"] + 1, t["end"] - t["start"])))
    read = back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), joined.alias("all"), F.array_join(masked, "").alias("loss"), F.length("chat_text").cast("bigint").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", digest("all").alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")


def oracle() -> str:
    mark = len(TURN) + len(TEXT) + len(END)
    escapes = "text"
    for a, b in [("\\", "\\\\"), *((m, m[0] + "\\" + m[1:]) for m in FOREIGN)]:
        escapes = f"replace({escapes}, '{a}', '{b}')"
    return f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{EXTRA}' union all select -1, 1, 'assistant', '{EXTRA}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(length({escapes.replace("text", "role", 1)}) + length({escapes}) + {mark}) as bigint) as formatted_chars
from rows group by conv_id"""
