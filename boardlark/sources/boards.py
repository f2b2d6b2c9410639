"""Board sites: where list pages are, which kind of reader they take, and which board a stored post came from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Site:
    """One board.  list_form holds {page}; min_pages raises a crawl's page limit; kind names an entry of parsers.BOARDS, or `json` for json_items()."""

    key: str
    name: str
    kind: str
    source_type: str
    list_form: str
    min_pages: int = 1


def table(spark: SparkSession, sites: list[Site]) -> DataFrame:
    """The sites as rows with their position; a few dozen, made at the driver."""
    return spark.createDataFrame([(k, s.key, s.name, s.kind, s.source_type, s.list_form, s.min_pages) for k, s in enumerate(sites)], "pos int, key string, name string, kind string, source_type string, list_form string, min_pages int")


def list_pages(sites: DataFrame, most: int) -> DataFrame:
    """(key, page, url) of every list page up to the limit, one row each, to be fetched where they lie."""
    pages = sites.withColumn("page", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(most), F.col("min_pages")))))
    return pages.select("key", "page", F.replace("list_form", F.lit("{page}"), F.col("page").cast("string")).alias("url"))


def of_posts(posts: DataFrame, sites: DataFrame) -> DataFrame:
    """(_ord, key): each post's board, by the first board that has one of its source types."""
    types = posts.select("_ord", F.explode("source_type").alias("source_type"))
    return types.join(sites, "source_type").groupBy("_ord").agg(F.min_by("key", "pos").alias("key"))


def detail_ids(url: Column | str) -> Column:
    """struct(nttId, bbsId) of a detail page's address, '' where it lacks one."""
    u = F.col(url) if isinstance(url, str) else url
    return F.struct(F.regexp_extract(u, r"[?&]nttId=([^&#]*)", 1).alias("nttId"), F.regexp_extract(u, r"[?&]bbsId=([^&#]*)", 1).alias("bbsId"))
