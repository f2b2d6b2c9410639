"""The published store: tables written aside, checked, and swapped in; child tables as views; the chat log.

A store is a folder of generations; `current` names the one that readers use, and its replacement is the commit.  Paths go through the file system that
the session knows, so a store may lie anywhere Spark writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boardlark.functions.text import truncate
from boardlark.operators.dedup import stale
from boardlark.operators.facets import cube
from boardlark.operators.normalize import suffixed_ids
from boardlark.rules import UNIVERSITY, Taxonomy
from boardlark.schemas import CHAT_MESSAGES, STORE_VERSION


class StoreError(Exception):
    """A store can't be read or a publication is refused."""


class Files:
    """The few file operations that a publication needs, on any file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, p: str, text: str) -> None:
        """Written aside and renamed over the old file in one step, so a reader finds the old text or the new one."""
        aside = f"{p}.{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(aside))
        stream.write(bytearray(text.encode()))
        stream.close()
        overwrite = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        self.jvm.java.lang.reflect.Array.set(overwrite, 0, getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        context.rename(self.path(aside), self.path(p), overwrite)


class Lock:
    """One writer at a time: a file that only one process can create.  acquire() says at once whether it did."""

    def __init__(self, spark: SparkSession, path: str):
        self.files, self.path, self.held = Files(spark, path), path, False

    def acquire(self) -> bool:
        self.held = self.held or self.files.fs.createNewFile(self.files.path(self.path))
        return self.held

    def release(self) -> None:
        if self.held:
            self.files.delete(self.path)
            self.held = False


def guard(new_count: int, old_count: int, min_records: int = 1, min_retain_ratio: float = 0.5) -> None:
    """Raises StoreError if a snapshot is too small, or too small beside the rows of the old one that retention would keep."""
    if new_count < min_records:
        raise StoreError(f"{new_count} records are fewer than {min_records}")
    if old_count > 0 and new_count < old_count * min_retain_ratio:
        raise StoreError(f"{new_count} records are below {min_retain_ratio} of {old_count}")


def retained(posts: DataFrame, today) -> int:
    return posts.where(~stale(today, meta="source_meta" in posts.columns)).count()


def children(notices: DataFrame) -> dict[str, DataFrame]:
    """The four child tables with their order columns.  Names, groups and tags are distinct within a notice; attachments are not."""
    clean = lambda c: F.array_distinct(F.filter(c, lambda v: v.isNotNull() & (v != "")))
    fan = lambda c, name: notices.select(F.col("id").alias("notice_id"), F.posexplode(clean(c)).alias("ordinal", name))
    files = notices.select(F.col("id").alias("notice_id"), F.posexplode("attachments").alias("ordinal", "a")).select("notice_id", "ordinal", "a.name", "a.url")
    return {"notice_sources": fan("sources", "source_name"), "notice_source_groups": fan("source_groups", "source_group"), "notice_tags": fan("tags", "tag"), "notice_attachments": files}


def nested(notices: DataFrame, child: DataFrame, value: str, to: str) -> DataFrame:
    """Notices with a child table's values as an ordered array, empty where it has none."""
    lists = child.groupBy(F.col("notice_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", value))), lambda x: x[value]).alias(to))
    return notices.join(lists, "id", "left").withColumn(to, F.coalesce(to, F.array().cast(child.schema[value].dataType.simpleString().join(("array<", ">")))))


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        """keep: generations that stay besides the current one, for readers that have opened them."""
        self.spark, self.root, self.files, self.keep = spark, root.rstrip("/"), Files(spark, root), keep

    def publish(self, notices: DataFrame, min_records: int = 1, min_retain_ratio: float = 0.5, old_count: int | None = None, taxonomy: Taxonomy = UNIVERSITY) -> int:
        """Writes notices (classified and searchable, ids suffixed) and their facet cube as a new generation and makes it current.  On any failure the old
        generation stays and the new one goes."""
        name = f"gen-{uuid.uuid4().hex}"
        where = f"{self.root}/{name}"
        try:
            suffixed_ids(notices).drop("_ord").write.parquet(f"{where}/notices")
            rows = self.spark.read.parquet(f"{where}/notices")
            n = rows.count()
            before = old_count if old_count is not None else self._rows()
            guard(n, before, min_records, min_retain_ratio)
            if rows.groupBy("id").count().where("count > 1").limit(1).count():
                raise StoreError("a suffixed id meets another notice's own id")
            cube(rows, taxonomy).write.parquet(f"{where}/facet_cube")
            previous = self._current()
            older = [g for g in [previous["generation"], *previous.get("older", [])]] if previous else []
            self.files.replace(f"{self.root}/current", json.dumps({"generation": name, "version": STORE_VERSION, "older": older[: self.keep]}))
        except Exception:
            self.files.delete(where)
            raise
        for g in older[self.keep :]:
            self.files.delete(f"{self.root}/{g}")
        return n

    def _current(self) -> dict | None:
        p = f"{self.root}/current"
        return json.loads(self.files.read(p)) if self.files.exists(p) else None

    def _rows(self) -> int:
        try:
            return self.notices().count()
        except StoreError:
            return 0

    def _table(self, name: str) -> DataFrame:
        now = self._current()
        if not now or now.get("version") != STORE_VERSION:
            raise StoreError("there is no store of this version")
        return self.spark.read.parquet(f"{self.root}/{now['generation']}/{name}")

    def notices(self) -> DataFrame:
        return self._table("notices")

    def ordered(self) -> DataFrame:
        return self.notices().orderBy(F.desc_nulls_last("published_at"), F.asc("id"))

    def by_id(self, notice_id: str) -> DataFrame:
        return self.notices().where(F.col("id") == notice_id).limit(1)

    def facets(self, audience: str | None, group: str | None, taxonomy: Taxonomy = UNIVERSITY) -> tuple[dict, str | None]:
        """The facets of a cell and the group that counts: the asked one if its audience has it.  Computed from the notices where the cube lacks the cell."""
        at = lambda df, a, g: df.where((F.col("audience") == (a or "")) & (F.col("source_group") == (g or ""))).first()
        try:
            cells = self._table("facet_cube")
            base = at(cells, audience, None)
        except Exception:  # an unreadable cube is computed anew
            base = None
        if base is None:
            cells = cube(self.notices() if not audience else self.notices().where(F.col("audience_group") == audience), taxonomy)
            base = at(cells, audience, None)
        if base is None:
            return {k: [] for k in ("audience_groups", "source_groups", "sources", "categories", "departments")}, None
        counts = group if group in base["source_groups"] else None
        row = at(cells, audience, counts) if counts else base
        return {k: list(row[k]) for k in ("audience_groups", "source_groups", "sources", "categories", "departments")}, counts


class ChatLog:
    """An append-only table of messages; writing is best-effort, reading an absent log gives no rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, messages: DataFrame) -> bool:
        try:
            messages.write.mode("append").parquet(self.path)
            return True
        except Exception:  # the answer matters more than its log
            return False

    def read(self) -> DataFrame:
        if not Files(self.spark, self.path).exists(self.path):
            return self.spark.createDataFrame([], CHAT_MESSAGES)
        return self.spark.read.schema(CHAT_MESSAGES).parquet(self.path)

    def session(self, session_id: str) -> DataFrame:
        return self.read().where(F.col("session_id") == session_id).orderBy("id")


def trimmed_sessions(messages: DataFrame, session: str = "session_id", order: str = "id", content: str = "content", most: int = 10, chars: int = 500) -> DataFrame:
    """The last messages of each session, each cut to so many characters."""
    k = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("_k", k).where(F.col("_k") <= most).drop("_k").withColumn(content, truncate(content, chars))


def aligned(old: DataFrame, new: DataFrame, adapt: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rows of an older table beside newer ones, columns that it lacks as null."""
    return (adapt(old) if adapt else old).unionByName(new, allowMissingColumns=True)
