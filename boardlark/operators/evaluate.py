"""Retrieval quality: recall at k, first hit rank, reciprocal rank, their means, and means that leave out NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, must, rank): the first rank at which a title holds each wanted text, null if none does; a blank text is held by any.
    cases: case_id, must (array); retrieved: case_id, rank, title.  Joined on the case, so each wanted text meets the case's own results alone."""
    wanted = cases.select("case_id", F.explode("must").alias("must")).withColumn("must", F.trim("must"))
    met = wanted.join(retrieved, "case_id", "left").withColumn("at", F.when(F.contains("title", "must"), F.col("rank")))
    return met.groupBy("case_id", "must").agg(F.min("at").alias("rank")).withColumn("rank", F.when(F.col("must") == "", 1).otherwise(F.col("rank")))


def scored(cases: DataFrame, retrieved: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    """case_id, recall_at_k for each k, first_hit_rank, reciprocal_rank.  A case without wanted texts has recall 1 and rank 0."""
    found = hits(cases, retrieved)
    recalls = [F.avg((F.coalesce(F.col("rank") <= k, F.lit(False))).cast("double")).alias(f"recall_at_{k}") for k in at]
    by_case = found.groupBy("case_id").agg(*recalls, F.min("rank").alias("first_hit_rank"))
    out = cases.select("case_id").join(by_case, "case_id", "left")
    out = out.withColumns({f"recall_at_{k}": F.coalesce(f"recall_at_{k}", F.lit(1.0)) for k in at})
    return out.withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)))


def means(results: DataFrame, at: tuple[int, ...] = (5, 10)) -> DataFrame:
    return results.agg(*[F.coalesce(F.avg(f"recall_at_{k}"), F.lit(0.0)).alias(f"recall_at_{k}") for k in at], F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"), F.count("*").alias("n"))


def mean_of_numbers(x: Column | str) -> Column:
    """The mean without NaN and null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.avg(F.when(~F.isnan(x), x))


def clean_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN becomes null, as artifacts are written."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def with_scores(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """Samples with their scores; of several scores of a case the last (by _ord) counts."""
    last = scores.groupBy("case_id").agg(F.max_by(F.struct(*[c for c in scores.columns if c not in ("case_id", "_ord")]), "_ord").alias("s")).select("case_id", "s.*")
    return samples.join(last, "case_id", "left")


def top_titles(ranked: DataFrame, by: list[str], most: int) -> DataFrame:
    """case_id, rank, title of the best rows of each case."""
    order = Window.partitionBy("case_id").orderBy(*by)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("case_id", "rank", "title")
