"""JSON-array snapshots, with the exact position of every element; a reader that keeps the last good one; cases and records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlark.functions.urls import canonical
from boardlark.operators.store import Files, StoreError


def array(spark: SparkSession, path: str) -> DataFrame:
    """(_ord, raw) of one JSON file that is an array: each object with its position; other elements are left out but count.  Anything but an array raises
    StoreError.  One file is one JSON value, so it is read as one; for large inputs use lines()."""
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kind = whole.select(F.schema_of_variant("v").startswith("ARRAY")).first()
    if kind is None or not kind[0]:
        raise StoreError("a snapshot is a JSON array")
    items = whole.select(F.posexplode(F.expr("CAST(v AS ARRAY<VARIANT>)")).alias("_ord", "e"))
    return items.where(F.schema_of_variant("e").startswith("OBJECT")).select(F.col("_ord").cast("bigint").alias("_ord"), F.to_json("e").alias("raw"))


def lines(spark: SparkSession, path: str, order: str | None = None) -> DataFrame:
    """The same from JSON lines, in parallel; `order` names a field that gives the position, else it follows file and line."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw"))
    return rows.withColumn("_ord", F.get_json_object("raw", f"$.{order}").cast("bigint") if order else F.monotonically_increasing_id())


def previous_posts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last snapshot's posts (JSON lines) with canonical URLs; rows without one are left out; an absent or unreadable file gives no rows."""
    try:
        posts = spark.read.schema(schema).json(path)
        return posts.where("original_url IS NOT NULL AND original_url <> ''").withColumn("original_url", canonical("original_url"))
    except Exception:  # no last snapshot: everything is new
        return spark.createDataFrame([], schema)


class Watched:
    """A snapshot that is read again when its file changes; if that fails, the last good one stays."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.stamp: tuple[int, int] | None = None
        self.last: DataFrame | None = None

    def read(self) -> DataFrame:
        files = Files(self.spark, self.path)
        try:
            status = files.fs.getFileStatus(files.path(self.path))
            stamp = (status.getModificationTime(), status.getLen())
            if stamp != self.stamp:
                fresh = array(self.spark, self.path).cache()
                fresh.count()
                if self.last is not None:
                    self.last.unpersist()
                self.last, self.stamp = fresh, stamp
        except Exception as e:
            if self.last is None:
                raise StoreError("the snapshot can't be read") from e
        return self.last


def records(raw: DataFrame) -> DataFrame:
    """Audit records (id, title, source, url, content) from (_ord, raw)."""
    text = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.get_json_object("raw", f"$.{k}")), F.lit("")) for k in keys], F.lit(""))
    return raw.select(text("id", "original_url").alias("id"), text("title").alias("title"), text("source_name", "source").alias("source"), text("original_url", "url").alias("url"), text("content").alias("content"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases (id, question, filters, tags, must) from a YAML or JSON list; a small file, read at the driver."""
    text = Files(spark, path).read(path)
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, list):
        raise StoreError("cases are a list")
    rows = [(str(c["id"]), c["question"], {k: str(v) for k, v in (c.get("filters") or {}).items()}, list(c.get("tags") or []), list(c.get("must_include_titles") or [])) for c in found]
    return spark.createDataFrame(rows, "case_id string, question string, filters map<string,string>, tags array<string>, must array<string>")
