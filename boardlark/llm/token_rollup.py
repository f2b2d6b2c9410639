"""Token counts as delta-maintained rollups.

A change inserts a document's count, deletes it, or revises it from an old to a new number.  A batch of changes is added up by source, language and
tokenizer version into signed deltas and committed under its id, once.  Totals are the sum of all committed deltas.

Commit.  A batch's deltas are written to a folder of their own under `live`; the commit is the creation of the file `ids/<batch>`, which the file system
grants to one writer only, and which names that folder and holds a digest of its deltas.  A batch that is committed again is skipped if its deltas are the
same and is an error if they aren't.  Folders that no id names (a writer was lost) are never read.

Compaction.  compact() writes the sum of all committed deltas aside and creates the next file in `snapshots`, again granted to one writer only; it names the
table and the folders that it holds.  Only who has created it deletes, and only what the snapshot before it had replaced, so that readers have the time
of one compaction; ids stay for good.  Readers list `live` before they look for the newest snapshot, so that a folder is counted once, in the snapshot or by
itself.

The store lies in a folder that driver and executors share, on a file system that creates files exclusively (HDFS and local ones do).

Cases: null labels are a group of their own; null counts are 0; an unknown op is an error; a group that comes to no documents and no tokens leaves the
totals; an empty batch commits and changes nothing; equal changes in one batch count each; a revision or deletion of what was never inserted is
booked as given, unless verified() has taken it out; a batch id holds letters, digits, `_` and `-`; columns besides those named are ignored.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from boardlark.llm.shared import arrow_pass

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def deltas(changes: DataFrame) -> DataFrame:
    """The signed deltas of changes (op, source, lang, tokenizer, n_tokens, and old_tokens for a revision)."""
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.when(F.col("op").isin(INSERT, DELETE, REVISE), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    docs = F.when(op == INSERT, 1).when(op == DELETE, -1).otherwise(0)
    tokens = F.when(op == INSERT, n).when(op == DELETE, -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("bigint")).alias("docs"), F.sum(tokens.cast("bigint")).alias("tokens"))


def verified(changes: DataFrame, ledger: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(changes that fit, changes that don't): revisions and deletions need a row of the ledger (id, keys, n_tokens: what is counted now) with the old
    number, insertions need that there is none.  A null id fits nothing but an insertion."""
    keys = [id_col, "source", "lang", "tokenizer"]
    now = ledger.select(*[F.col(k).alias(f"_{k}") for k in keys], F.coalesce("n_tokens", F.lit(0)).alias("_now")).distinct()
    same = (F.col(id_col) == F.col(f"_{id_col}")) & F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys[1:]))
    both = changes.join(now, same, "left")
    was = F.coalesce(F.when(F.col("op") == REVISE, F.col("old_tokens")).otherwise(F.col("n_tokens")), F.lit(0))
    fits = F.when(F.col("op") == INSERT, F.col("_now").isNull()).otherwise(F.coalesce(F.col("_now") == was, F.lit(False)))
    return both.where(fits).select(*changes.columns), both.where(~fits).select(*changes.columns)


class RollupStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for d in ("ids", "live", "snapshots", "sums"):
            self._fs.mkdirs(self._path(f"{self.root}/{d}"))

    def _names(self, folder: str) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")) if not (n := s.getPath().getName()).startswith((".", "_")))

    def _create(self, file: str, content: dict) -> bool:
        """Creates a file that must not exist; False if it does.  A file without an end is of a writer that was lost, and is taken over."""
        path = self._path(f"{self.root}/{file}")
        try:
            stream = self._fs.create(path, False)
        except Py4JJavaError:
            if self._fs.exists(path) and self._read(file) is not None:
                return False
            if not self._fs.exists(path):
                raise
            stream = self._fs.create(path, True)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def _read(self, file: str) -> dict | None:
        path = self._path(f"{self.root}/{file}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def _drop(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def _table(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(DELTA).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], DELTA)

    def committed(self) -> list[str]:
        """The ids of all committed batches."""
        return [b for b in self._names("ids") if self._read(f"ids/{b}")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch; False if it had been committed with the same deltas, ValueError if with others."""
        if not re.fullmatch("[A-Za-z0-9_-]+", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        name = f"{batch}.{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.root}/live/{name}")
        seal = self._table([f"live/{name}"]).where("docs <> 0 OR tokens <> 0").agg(F.count("*"), F.sum(F.xxhash64("source", "lang", "tokenizer", "docs", "tokens").cast("decimal(38,0)"))).first()
        digest = f"{seal[0]}:{seal[1]}"
        if self._create(f"ids/{batch}", {"folder": name, "digest": digest}):
            return True
        self._drop(f"live/{name}")
        if self._read(f"ids/{batch}")["digest"] != digest:
            raise ValueError(f"batch {batch} was committed with other changes")
        return False

    def _state(self) -> tuple[DataFrame, list[str], int, dict]:
        """The sum of all committed deltas, the folders under `live` that are in it, and the newest snapshot's number and content."""
        live = self._names("live")  # before the snapshot is looked for
        numbers = [int(n) for n in self._names("snapshots") if self._read(f"snapshots/{n}")]
        last = max(numbers, default=0)
        snapshot = self._read(f"snapshots/{last:09d}") if last else {"sum": None, "folders": []}
        fresh = [n for n in live if n not in set(snapshot["folders"]) and (self._read(f"ids/{n.partition('.')[0]}") or {}).get("folder") == n]
        rows = self._table(([f"sums/{snapshot['sum']}"] if snapshot["sum"] else []) + [f"live/{n}" for n in fresh])
        total = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 OR tokens <> 0")
        return total, fresh, last, snapshot

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens."""
        return self._state()[0]

    def compact(self) -> bool:
        """Folds all committed batches into a new snapshot; False, with nothing deleted, if another compaction came first."""
        total, fresh, last, before = self._state()
        name = uuid.uuid4().hex
        total.write.parquet(f"{self.root}/sums/{name}")
        still = [n for n in before["folders"] if n in set(self._names("live"))]
        if not self._create(f"snapshots/{last + 1:09d}", {"sum": name, "folders": still + fresh}):
            self._drop(f"sums/{name}")
            return False
        for n in still:
            self._drop(f"live/{n}")
        for n in self._names("snapshots"):
            if int(n) < last:
                old = self._read(f"snapshots/{n}")
                if old:
                    self._drop(f"sums/{old['sum']}")
                self._drop(f"snapshots/{n}")
        return True


def rank_tokens(df: DataFrame, ranks_path: str, text: str = "text", keep: list[str] | None = None, to: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of tokens of each text by a public rank file."""
    with open(ranks_path, "rb") as f:  # the vocabulary's size, whatever the input
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def make():
        import base64

        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def work(batch: pa.RecordBatch) -> dict:
            return {to: pa.array([len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()], pa.int64())}

        return work

    return arrow_pass(df, text, df.columns if keep is None else keep, StructType([StructField(to, LongType())]), make)
