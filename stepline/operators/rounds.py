"""Scores over rounds: change, plateaus, when to stop, which version is best."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["capture_id"]


def _w(keys, order):
    return Window.partitionBy(*keys).orderBy(order)


def compare_scores(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score", epsilon: float = 1.0) -> DataFrame:
    """Change to the version before, and whether it is none to speak of."""
    delta = F.col(score) - F.lag(score).over(_w(keys, order))
    return rounds.withColumn("delta", delta).withColumn("improved", F.col("delta") > 0).withColumn("converged", F.abs("delta") < epsilon)


def round_plateau(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score") -> DataFrame:
    """Third and further equal scores in a row."""
    w = _w(keys, order)
    return rounds.withColumn("plateau", F.coalesce((F.col(score) == F.lag(score, 1).over(w)) & (F.col(score) == F.lag(score, 2).over(w)), F.lit(False)))


def no_improvement_streak(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score", limit: int = 3) -> DataFrame:
    """Rounds since the last that was better than all before, and whether they reach the limit."""
    w = _w(keys, order)
    best = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = rounds.withColumn("_better", best.isNull() | (F.col(score) > best))
    island = better.withColumn("_island", F.sum(F.col("_better").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    streak = F.row_number().over(_w([*keys, "_island"], order)) - 1
    return island.withColumn("streak", streak).withColumn("stuck", F.col("streak") >= limit).drop("_better", "_island")


def convergence_stall(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score", epsilon: float = 5.0) -> DataFrame:
    """Small changes twice in a row, or a step back."""
    w = _w(keys, order)
    moved = rounds.withColumn("_d", F.col(score) - F.lag(score).over(w))
    twice = (F.abs("_d") < epsilon) & (F.abs(F.lag("_d").over(w)) < epsilon)
    return moved.withColumn("stall", F.coalesce(twice, F.lit(False))).withColumn("regression", F.coalesce(F.col("_d") < 0, F.lit(False))).drop("_d")


def pick_best(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score", blocked: str = "blocked") -> DataFrame:
    """The version without blockers first, then the highest score, then the earliest."""
    w = Window.partitionBy(*keys).orderBy(F.col(blocked).asc(), F.col(score).desc(), F.col(order).asc())
    return rounds.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stop_reason(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score", blocked: str = "blocked", passing: int = 75, epsilon: float = 5.0, most: int = 5) -> DataFrame:
    """The first round that stops, and why: passed, else regression, convergence, or the most rounds."""
    marked = convergence_stall(rounds, keys, order, score, epsilon).withColumn("_n", F.row_number().over(_w(keys, order)))
    last = F.max(order).over(Window.partitionBy(*keys))
    reason = (
        F.when((F.col(score) >= passing) & ~F.col(blocked), "passed")
        .when(F.col("regression"), "regression")
        .when(F.col("stall"), "converged")
        .when((F.col("_n") >= most) | (F.col(order) == last), "max_rounds")
    )
    return marked.withColumn("reason", reason).filter("reason is not null").groupBy(*keys).agg(F.min_by("reason", order).alias("reason"), F.min(order).alias("stopped_at"))


def unknowns_dropped_guard(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score", unknowns: str = "n_unknowns") -> DataFrame:
    """Rounds whose score rose while fewer unknowns were declared: suspicious."""
    w = _w(keys, order)
    hit = (F.col(score) > F.lag(score).over(w)) & (F.col(unknowns) < F.lag(unknowns).over(w))
    return rounds.withColumn("suspicious", F.coalesce(hit, F.lit(False)))


def iteration_report(rounds: DataFrame, keys=KEYS, order: str = "version", score: str = "score") -> DataFrame:
    """Each version's score, change, best so far and whether it is the best of all."""
    w = _w(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = pick_best(rounds, keys, order, score).select(*keys, F.col(order).alias("_best"))
    out = rounds.withColumn("delta", F.col(score) - F.lag(score).over(w)).withColumn("best_so_far", F.max(score).over(upto))
    return out.join(best, keys).withColumn("is_best", F.col(order) == F.col("_best")).drop("_best")


def version_check(rounds: DataFrame, keys=KEYS, order: str = "version") -> DataFrame:
    """Gaps in the numbering of versions."""
    w = _w(keys, order)
    return rounds.withColumn("_d", F.col(order) - F.lag(order).over(w)).filter("_d <> 1").select(*keys, order, F.col("_d").alias("step"))
