"""Session metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tarnlight.functions import fixed as X


def normalize_recommendations(recommended: DataFrame, known: DataFrame, session: str, item: str) -> DataFrame:
    """recommended: session, place, item. Trimmed, known, first occurrence, first ten; adds rank."""
    clean = recommended.withColumn(item, F.trim(F.col(item).cast("string"))).where(F.col(item) != "")
    clean = clean.join(known.select(F.col(item).cast("string").alias(item)).distinct(), item, "left_semi")
    first = clean.groupBy(session, item).agg(F.min("place").alias("place"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(session).orderBy("place", item)))
    return ranked.where(F.col("rank") <= X.TOP_K).select(session, item, "rank")


def summary(sessions: DataFrame, by_scenario: bool = False) -> DataFrame:
    """sessions: scenario, first_hit_turn, reciprocal_rank. Overall (scenario null), and a row for each scenario if asked."""
    hit = F.col("first_hit_turn").isNotNull().cast("double")
    aggs = (
        F.count("*").alias("sample_count"), F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 6).alias("hit_rate_at_10"),
        F.round(F.coalesce(F.avg(F.coalesce("reciprocal_rank", F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.avg(F.coalesce("first_hit_turn", F.lit(X.MAX_TURNS + 1)).cast("double")), 6).alias("mttc"),
    )
    if not by_scenario:
        return sessions.agg(*aggs)
    return sessions.rollup("scenario").agg(*aggs)


def technical_score(summed: DataFrame) -> DataFrame:
    """Adds efficiency (null without sessions) and technical_score."""
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (X.MAX_TURNS + 1 - F.col("mttc")) / 10))
    rows = summed.withColumn("efficiency", F.when(F.col("mttc").isNotNull(), F.round(efficiency, 6)))
    return rows.withColumn("technical_score", F.round(0.5 * F.col("hit_rate_at_10") + 0.3 * F.col("mrr") + 0.2 * F.col("efficiency"), 6))


def token_usage(usage: DataFrame, session: str) -> DataFrame:
    """Sums of the counts that are not negative."""
    total = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0)).cast("long").alias(c)
    return usage.groupBy(session).agg(total("prompt_tokens"), total("completion_tokens"))
