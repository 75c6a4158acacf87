"""Audits, generation and evaluation metrics, best checkpoints, early stopping, best of N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of a candidate's score, caps of its counts, fewest tokens of a candidate.
WEIGHTS = {"valid": 1000.0, "eos": 100.0, "tokens": 0.01, "layers": 0.1}
TOKEN_CAP, LAYER_CAP, LEAST_TOKENS = 4096, 256, 10
#: Events whose loss counts towards a stage's best; `best_updated` may carry it under another name.
LOSS_EVENTS = ("best_updated", "run_finished", "eval_step")


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def audit(rows: DataFrame, ok: str, task: str, error: str, samples: int = 20) -> DataFrame:
    """One row: totals, share of valid rows, rows by task, the first `samples` different errors."""
    tasks = rows.groupBy(task).agg(F.count("*").alias("n"), F.count_if(F.col(ok)).alias("good"))
    by_task = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(task), F.col("n")))))
    errors = rows.where(~F.col(ok) & F.col(error).isNotNull()).select(error).distinct().orderBy(error).limit(samples).agg(F.array_sort(F.collect_list(error)).alias("errors"))
    whole = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("good"), F.lit(0)).alias("valid"), by_task.alias("tasks"))
    return whole.withColumn("invalid", F.col("total") - F.col("valid")).withColumn("valid_rate", F.col("valid") / F.greatest(F.lit(1), "total")).crossJoin(errors)


def generation_metrics(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rates over all generations, tokens over all, layers over those that decode."""
    n = F.greatest(F.lit(1), F.count("*"))
    good = F.count_if("decoded")
    return rows.groupBy(*group).agg(
        F.count("*").alias("total"),
        *[(F.count_if(c) / n).alias(f"{c}_rate") for c in ("decoded", "valid", "eos", "bos")],
        (F.sum("tokens") / n).alias("avg_tokens"),
        (F.coalesce(F.sum(F.when(F.col("decoded"), F.col("layers"))), F.lit(0)) / F.greatest(F.lit(1), good)).alias("avg_layers"),
    )


def eval_metrics(rows: DataFrame, batch: str, batches: int) -> DataFrame:
    """Means over the first batches: of the batches' losses, and of the rows' flags and lengths."""
    first = rows.where(F.col(batch) < batches)
    by_batch = first.groupBy(batch).agg(F.avg("loss").alias("loss"), F.sum("eos").alias("eos"), F.sum("length").alias("length"), F.count("*").alias("n"))
    n = F.greatest(F.lit(1), F.sum("n"))
    return by_batch.agg(mean_or_zero(F.col("loss")).alias("loss"), (F.sum("eos") / n).alias("eos_rate"), (F.sum("length") / n).alias("avg_length"))


def best_loss(events: DataFrame, group: list[str]) -> DataFrame:
    """The least loss of the events that report one."""
    loss = F.coalesce(F.col("eval_loss"), F.when(F.col("event") == "best_updated", F.col("best_eval")))
    return events.where(F.col("event").isin(*LOSS_EVENTS)).groupBy(*group).agg(F.min(loss).alias("best"))


def early_stopping(evals: DataFrame, run: str, step: str, loss: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """(run, step, best, waited, stopped): a fold over each run's evaluations in order.

    An evaluation is better if it undercuts the best so far by more than min_delta; waited counts those since that
    aren't; stopped holds from the first time that patience is reached.
    """
    # the state of a step depends on min_delta and the state before, so it is a fold; a run's evaluations are few
    ordered = F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), F.col(loss).alias("loss"))))
    state = "struct<best:double,waited:int,stopped:boolean,out:array<struct<step:bigint,best:double,waited:int,stopped:boolean>>>"
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(False).alias("stopped"), F.array().alias("out")).cast(state)

    def fold(s: Column, e: Column) -> Column:
        better = e["loss"] < s["best"] - min_delta
        best, waited = F.when(better, e["loss"]).otherwise(s["best"]), F.when(better, 0).otherwise(s["waited"] + 1)
        stopped = s["stopped"] | (waited >= patience)
        one = F.struct(e["step"].cast("bigint").alias("step"), best.alias("best"), waited.alias("waited"), stopped.alias("stopped"))
        return F.struct(best.alias("best"), waited.alias("waited"), stopped.alias("stopped"), F.concat(s["out"], F.array(one)).alias("out"))

    runs = evals.groupBy(run).agg(ordered.alias("e"))
    return runs.select(run, F.explode(F.aggregate("e", start, fold, lambda s: s["out"])).alias("s")).select(run, "s.*")


def running_best(evals: DataFrame, run: str, step: str, loss: str) -> DataFrame:
    """Without min_delta the best before each step is a window minimum."""
    before = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return evals.withColumn("best_before", F.min(loss).over(before)).withColumn("improved", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def candidate_score(valid: Column, eos: Column, tokens: Column, layers: Column) -> Column:
    return (
        F.when(valid, WEIGHTS["valid"]).otherwise(0.0)
        + F.when(eos, WEIGHTS["eos"]).otherwise(0.0)
        + F.least(tokens, F.lit(TOKEN_CAP)) * WEIGHTS["tokens"]
        + F.least(layers, F.lit(LAYER_CAP)) * WEIGHTS["layers"]
    )


def best_of_n(candidates: DataFrame, prompt: str, order: list[str]) -> DataFrame:
    """Each prompt's best candidate of those that decode and have enough tokens; of equal ones the first in order.

    The best is an aggregate, so only one row of a prompt leaves each task.
    """
    rest = [c for c in candidates.columns if c != prompt]
    fit = candidates.where(F.col("decoded") & (F.col("tokens") >= LEAST_TOKENS))
    score = candidate_score(F.col("valid"), F.col("eos"), F.col("tokens"), F.col("layers"))
    key = F.struct((-score).alias("down"), *order)
    best = fit.groupBy(prompt).agg(F.min_by(F.struct(*rest, score.alias("score")), key).alias("b"), F.count("*").alias("survivors"))
    return best.select(prompt, "b.*", "survivors")


def newest(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """The row of each group with the greatest order (a checkpoint to resume from)."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("b")).select(*group, "b.*")
