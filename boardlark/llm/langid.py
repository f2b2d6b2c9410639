"""Language identification by rank-order profiles.

A profile lists the most frequent character n-grams (one to three letters, words padded by one blank) in falling order.  A document's own list is
compared to each language's: the distance is the sum over the document's n-grams of how far each is out of place, and the profile's length for one
that the profile lacks.  The nearest language wins; the score is one less the ratio of its distance to the next one's.

Letters of all scripts are folded to lower case and keep their code point, so an n-gram is a number of at most 63 bits.  Profiles are counted over all
learnable documents: each task adds up its n-grams by language, Spark adds the tasks.

Cases: `und` with score 0 where the text is null or has no letter, or where there is no profile to compare with; ties of n-grams go to the smaller number, of
languages to the one that sorts first; documents with a null language are predicted but not learned from; very long texts are read whole; repeated rows count
and are predicted each; an empty table gives no rows; an added column takes the place of an equally named one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from boardlark.llm.shared import arrow_pass, sliced, utf8

#: N-grams in a profile, for documents and languages.
LENGTH = 400
UNKNOWN = "und"
#: Code points from here on hold no letters (they are tags and private use).
_END = 0x32400
#: Languages, and n-grams of them, whose counts one task holds at once.
_HELD, _HELD_GRAMS = 16, 2_000_000
#: Bits of a code point, and the number that stands for a blank, below all letters.
_BITS, _BLANK = 21, 1


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """Code point to that of the lower-case letter, 0 for everything that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(_END):
        if chr(cp).isalpha():
            table[cp] = ord(chr(cp).lower()[0])
    return table


def grams(codes: np.ndarray) -> np.ndarray:
    """The n-grams of a text as numbers: the letters' code points side by side, so that longer n-grams are larger."""
    c = np.concatenate([[0], codes, [0]]).astype(np.int64)
    c = np.concatenate([c[:1], c[1:][(c[1:] > 0) | (c[:-1] > 0)]])
    letters = c > 0
    c[~letters] = _BLANK
    two = c[:-1] << _BITS | c[1:]
    return np.concatenate([c[letters], two, (two[:-1] << _BITS | c[2:])[letters[1:-1]]])


def ranked(g: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent n-grams, most frequent first; of equally frequent ones the smaller number."""
    g, count = np.unique(g, return_counts=True)
    if len(g) > length:
        often = count >= np.partition(count, len(count) - length)[len(count) - length]
        g, count = g[often], count[often]
    return g[np.argsort(-count, kind="stable")[:length]]


def _added(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The counts of two sorted lists of n-grams together."""
    if a is None:
        return b
    g, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([a[1], b[1]]), len(g)).astype(np.int64)


def texts_codes(column: pa.Array) -> Iterator[np.ndarray]:
    """The letter codes of each row's text."""
    data, offsets, _ = utf8(column)
    table = letter_codes()
    whole = table[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    for a, b in zip(starts[:-1], starts[1:]):
        yield whole[a:b]


class Profiles:
    """The languages' ranked n-grams, as one sorted list of all n-grams and each language's rank of them."""

    def __init__(self, rows: list[tuple[str, int, int]], length: int = LENGTH):
        self.langs = sorted({r[0] for r in rows})
        self.length = length
        self.known = np.array(sorted({r[1] for r in rows}), np.int64)
        at = {int(g): k for k, g in enumerate(self.known)}
        self.ranks = np.full((len(self.known) + 1, len(self.langs)), -1, np.int32)
        for lang, gram, rank in rows:
            self.ranks[at[gram], self.langs.index(lang)] = rank

    def distances(self, top: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.known, top)
        k[(k == len(self.known)) | (self.known[np.minimum(k, len(self.known) - 1)] != top)] = len(self.known)
        ranks = self.ranks[k]
        return np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(top))[:, None])).sum(0)

    def predict(self, codes: np.ndarray) -> tuple[str, float]:
        if not self.langs or not codes.any():
            return UNKNOWN, 0.0
        d = self.distances(ranked(grams(codes), self.length))
        best = int(d.argmin())
        if len(d) == 1:
            return self.langs[0], 1.0
        second = int(np.partition(d, 1)[1])
        return self.langs[best], float(1 - d[best] / second) if second else 0.0


def learn(df: DataFrame, text: str = "text", lang: str = "lang", usable: Column | None = None, length: int = LENGTH) -> DataFrame:
    """The profiles as rows (lang, gram, rank), from all rows with a text and a language for which `usable` holds."""
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = (rows.where(usable) if usable is not None else rows).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    schema = StructType([StructField("lang", StringType()), StructField("gram", LongType()), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def let_go() -> Iterator[pa.RecordBatch]:
            for name, (g, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], schema.names)
            held.clear()

        for batch in sliced(batches, "text"):
            by: dict[str, list[np.ndarray]] = {}
            for name, codes in zip(batch.column("lang").to_pylist(), texts_codes(batch.column("text"))):
                if codes.any():
                    by.setdefault(name, []).append(grams(codes))
            for name, got in by.items():
                if name not in held and len(held) >= _HELD or sum(len(g) for g, _ in held.values()) >= _HELD_GRAMS:
                    yield from let_go()
                held[name] = _added(held.get(name), np.unique(np.concatenate(got), return_counts=True))
        yield from let_go()

    total = rows.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = (F.desc("n"), F.asc("gram"))
    part = total.withColumn("part", F.col("gram") % 16)
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("r") <= length)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)) - 1
    return part.select("lang", "gram", rank.alias("rank")).where(F.col("rank") < length)


def collect_profiles(profiles: DataFrame, length: int = LENGTH) -> Profiles:
    """The profiles at the driver: at most `length` rows for each language."""
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()], length)


def identify(df: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def make():
        model = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            langs, scores = zip(*(model.predict(c) for c in texts_codes(batch.column(text))))
            return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}

        return work

    added = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return arrow_pass(df, text, df.columns if keep is None else keep, added, make)
