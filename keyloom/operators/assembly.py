"""Assembling training sequences: token budgets, truncation, label masks, padding into batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the label that a loss ignores.
IGNORED = -100


def reserve(limit: int) -> int:
    """Tokens of a sequence that a target may claim beside text."""
    return min(1024, max(256, limit // 2))


def budgets(condition: Column, target: Column, media: Column, limit: int) -> dict[str, Column]:
    """Lengths after truncation, which sides were cut, and whether the row must be rejected.

    Beside media the condition stays whole: the target gets what it leaves, one token at least, and a condition that
    leaves too little is an overflow. Beside text the target gets its reserve, the condition what that leaves.
    """
    room = F.when(media, F.greatest(F.lit(1), F.lit(limit) - condition)).otherwise(F.least(target, F.lit(reserve(limit))))
    kept_target = F.least(target, room)
    kept_condition = F.when(media, condition).otherwise(F.least(condition, F.greatest(F.lit(1), F.lit(limit) - kept_target)))
    return {
        "target_length": kept_target,
        "condition_length": kept_condition,
        "truncated_target": target > room,
        "truncated_condition": kept_condition < condition,
        "overflow": media & (kept_condition + kept_target > limit),
    }


def cut_target(tokens: Column, budget: Column, eos: int) -> Column:
    """The target, or its first budget - 1 tokens and the end."""
    return F.when(F.size(tokens) > budget, F.concat(F.slice(tokens, F.lit(1), budget - 1), F.array(F.lit(eos)).cast("array<bigint>"))).otherwise(tokens)


def labels(condition: Column, target: Column) -> Column:
    """Ignored over the condition, then the target."""
    return F.concat(F.array_repeat(F.lit(IGNORED).cast("bigint"), F.size(condition)), target)


def pad(tokens: Column, value: int, width: Column, left: bool = False) -> Column:
    fill = F.array_repeat(F.lit(value).cast("bigint"), F.greatest(F.lit(0), width - F.size(tokens)))
    return F.concat(fill, tokens) if left else F.concat(tokens, fill)


def collate(rows: DataFrame, index: str, batch: int, pads: dict[str, int]) -> DataFrame:
    """Rows with batch_id = index // batch and their arrays padded on the right to the longest of the batch."""
    dealt = rows.withColumn("batch_id", F.floor(F.col(index) / batch).cast("bigint"))
    widths = dealt.groupBy("batch_id").agg(*[F.max(F.size(c)).alias(f"_{c}") for c in pads])
    both = dealt.join(widths, "batch_id")
    return both.select(*[pad(F.col(c), pads[c], F.col(f"_{c}")).alias(c) if c in pads else F.col(c) for c in dealt.columns])


def shape_reason(ids: Column, mask: Column, label: Column, grid: Column | None = None, media_tokens: Column | None = None, merge: int = 2) -> Column:
    """Why a row's arrays don't fit one another; null if they do."""
    reason = F.when(F.size(ids) != F.size(mask), "mask length").when(F.size(ids) != F.size(label), "label length")
    if grid is not None:
        patches = F.aggregate(grid, F.lit(1).cast("bigint"), lambda a, x: a * x)
        reason = reason.when(F.size(grid) != 3, "grid shape").when(F.floor(patches / (merge * merge)) != media_tokens, "media tokens")
    return reason


def messages(detail: Column, image: Column, video: Column, view: Column, system: str = "You draw animations.") -> Column:
    """System and user turn of a view: text alone, image with text if there is any, video alone; null if nothing is there."""
    part = "struct<kind:string,value:string>"
    text = F.when(detail.isNotNull() & (detail != ""), F.struct(F.lit("text").alias("kind"), detail.alias("value")).cast(part))
    media = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), c.alias("value")).cast(part))
    parts = F.array_compact(
        F.when(view == "text", F.array(text)).when(view == "image", F.when(image.isNotNull(), F.array(media("image", image), text)).otherwise(F.array(F.lit(None).cast(part)))).otherwise(F.array(media("video", video)))
    )
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    whole = F.array(turn("system", F.array(F.struct(F.lit("text").alias("kind"), F.lit(system).alias("value")).cast(part))), turn("user", parts))
    return F.when(F.size(parts) > 0, whole)
