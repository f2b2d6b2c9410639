"""Toxicity by the nearest labelled examples.

Learning.  Up to PER_CLASS labelled documents of each class (the first by a hash of their id) are the examples.  Terms are the first
STEM letters of a text's lower-case words; all that two or more examples hold, of whichever class, make the vocabulary.  Examples become vectors of length 1 over it:
(1 + log frequency) times the inverse document frequency, which is counted over all documents, times FLOOR plus the absolute log ratio of the term's
shares of the two classes (delta TF-IDF, after Martineau and Finin, 2009).  No term is left out for its ratio, and every example that holds a term of
the vocabulary can be found.

Search.  A block-max inverted index gives the exact k nearest by cosine.  Lists of rare terms are added up; for a frequent term each block of examples has
the largest weight within it, so that sum and maxima bound a block's cosines.  The blocks of the largest bounds are read first, then only those whose bound
reaches the k-th best so far; what may be among the k best is computed again in full precision.  A text without any term of the vocabulary has no neighbours.

Score.  Neighbours vote by cosine / (distance + SOFT), each class weighted to its share among all labelled documents, with a prior vote for these
shares.  The votes of the examples, each judged without itself and its copies, are put in order by isotonic regression, and between the middles of its
steps a vote's probability is interpolated; texts without neighbours get the share of toxic documents among the examples without any.  Evidence names the nearest
examples.

Cases: null and empty texts have no terms; very long texts are read whole, one at a time; without labels of both classes there are no examples and every
score is the share of toxic labels, or 0; conflicting labels of one id count as toxic; an id with several texts gives one example, the text of the
smallest digest; equal texts count once in the class shares; ties in cosine go to the example of the smaller id (as text); repeated rows are scored each; columns of the
input may have any names (an added column takes the place of an equally named one, unless `score` and `evidence` are given other names); an
empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from boardlark.llm.shared import Scratch, arrow_pass, sliced, small_batches

#: Labelled documents of each class that are learned from, at most.
PER_CLASS = 5000
#: A term must be in so many examples; in one alone it can't bring it nearer to another.
LEAST = 2
#: Letters of a stem: of 4, 5 and 6 (and whole words beside stems of 4), the one of the best held-out accuracy.
STEM = 4
#: Weight of a term that is as frequent in both classes, beside the absolute log ratio of the classes' shares.
FLOOR = 0.5
#: Terms that more than this share of the examples hold are kept by block, DENSE of them at most; the others as lists.
OFTEN, DENSE = 0.05, 1500
#: Texts that are searched together.
BATCH = 64
#: Neighbours, examples in a block, softness of the distance weights, and examples shown as evidence.
NEIGHBOURS, BLOCK, SOFT, SHOWN = 25, 64, 0.05, 3
#: Single-precision sums may be off by less than this; what is so near to the k-th best is computed again.
SLACK = 1e-5
#: The weight of a vote for the shares of all labels, beside the neighbours'; far neighbours alone don't outweigh it.
PRIOR = 2.0
#: From this score on a document is predicted toxic.
TOXIC_FROM = 0.3

_WORD = re.compile(r"[^\W\d_]+").findall


def counted(text: str | None) -> Counter:
    """How often each term is in a text."""
    return Counter([w[:STEM] for w in _WORD((text or "").lower())])


def numbered(text: str | None, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's terms, ascending, and how often each occurs."""
    found = sorted((at, n) for t, n in counted(text).items() if (at := vocabulary.get(t)) is not None)
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places begin[0] ... begin[0] + n[0] - 1, begin[1] ..., in a row."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


class BlockMaxIndex:
    """Vectors with positive weights, in blocks of BLOCK consecutive ones, for the exact nearest by cosine."""

    def __init__(self, term: np.ndarray, owner: np.ndarray, weight: np.ndarray, size: int, n_terms: int, rank: np.ndarray | None = None):
        """Entries (term, owner, weight) in ascending order of owner, each vector of length 1.  rank: an order of the vectors for ties, their number by default."""
        self.size, self.blocks, self.n_terms = size, max(1, -(-size // BLOCK)), n_terms
        self.rank = np.arange(size) if rank is None else rank
        self.term, self.value = term.astype(np.int32), weight
        self.starts = np.searchsorted(owner, np.arange(size + 1))
        held = np.bincount(term, minlength=n_terms)
        often = np.argsort(-held, kind="stable")[:DENSE]
        often = often[held[often] > OFTEN * size]
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        rest = np.flatnonzero(self.row[term] < 0)
        rest = rest[np.argsort(term[rest], kind="stable")]
        self.owner, self.weight = owner[rest].astype(np.int64), weight[rest]
        self.edges = np.concatenate([[0], np.cumsum(np.where(self.row < 0, held, 0))])
        self.most = np.zeros((len(often), self.blocks), np.float32)
        at = np.flatnonzero(self.row[term] >= 0)
        np.maximum.at(self.most, (self.row[term[at]], owner[at] // BLOCK), weight[at].astype(np.float32))
        self.dense = self.query = None

    def _prepare(self) -> None:
        """The frequent terms' weights by block, and a row for a query; made where the index is used, so that it travels without them."""
        owner = np.repeat(np.arange(self.size), np.diff(self.starts))
        at = np.flatnonzero(self.row[self.term] >= 0)
        dense = np.zeros((self.blocks * BLOCK, len(self.most)), np.float32)
        dense[owner[at], self.row[self.term[at]]] = self.value[at]
        self.dense, self.query = dense.reshape(self.blocks, BLOCK, -1), np.zeros(self.n_terms)

    def exact(self, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The cosines with these vectors in full precision."""
        self.query[terms] = weights
        n = self.starts[ids + 1] - self.starts[ids]
        at = _spans(self.starts[ids], n)
        product = self.query[self.term[at]] * self.value[at]
        self.query[terms] = 0
        return np.add.reduceat(product, np.cumsum(n) - n) if len(ids) else np.zeros(0)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the k vectors of the largest positive cosine and those cosines, larger first, then by rank.  without: for each
        query the numbers of vectors left out, or None."""
        if self.dense is None:
            self._prepare()
        q, every = len(queries), np.arange(len(queries))
        part, x = np.zeros((q, self.blocks * BLOCK), np.float32), np.zeros((q, len(self.most)), np.float32)
        for i, (terms, weights) in enumerate(queries):
            row = self.row[terms]
            lists = row < 0
            x[i, row[~lists]] = weights[~lists]
            n = self.edges[terms[lists] + 1] - self.edges[terms[lists]]
            place = _spans(self.edges[terms[lists]], n)
            part[i] = np.bincount(self.owner[place], np.repeat(weights[lists], n) * self.weight[place], self.blocks * BLOCK)
            if without and without[i] is not None:
                part[i, without[i]] = -np.inf
        part = part.reshape(q, self.blocks, BLOCK)
        bound = part.max(2) + x @ self.most
        found = np.full(part.shape, -1, np.float32)

        def read(which: np.ndarray, blocks: np.ndarray) -> None:
            """The cosines of these pairs of a query and a block; each block is taken up once for all its queries."""
            order = np.argsort(blocks, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1) if len(order) else []:
                b, own = blocks[at[0]], which[at]
                found[own, b] = part[own, b] + x[own] @ self.dense[b].T

        # The blocks of the largest bounds give a threshold, and only blocks whose bound reaches it are read besides.
        some = min(self.blocks, 2 + -(-2 * k // BLOCK))
        first = np.argpartition(-bound, some - 1, axis=1)[:, :some]
        read(np.repeat(every, some), first.ravel())
        near = np.take_along_axis(found, first[:, :, None], 1).reshape(q, -1)
        least = np.maximum(0, np.partition(near, near.shape[1] - k, axis=1)[:, -k]) if near.shape[1] >= k else np.zeros(q)
        need = (bound > 0) & (bound >= (least - 2 * SLACK)[:, None])
        np.put_along_axis(need, first, False, 1)
        read(*np.nonzero(need))
        out = []
        for (terms, weights), own, low in zip(queries, found.reshape(q, -1), least):
            ids = np.flatnonzero((own > 0) & (own >= low - 2 * SLACK))
            if len(ids) > k:
                ids = ids[own[ids] >= np.partition(own[ids], len(ids) - k)[len(ids) - k] - 2 * SLACK]
            cosines = self.exact(ids, terms, weights)
            best = np.lexsort((self.rank[ids], -np.round(cosines, 12)))
            best = best[cosines[best] > 1e-12][:k]
            out.append((ids[best], cosines[best]))
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": None, "query": None}


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float]]:
    """Weighted isotonic regression by pooling adjacent violators: (where each step begins, its value)."""
    steps: list[list[float]] = []
    order = np.argsort(x, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(x[order])) + 1) if len(x) else []:
        steps.append([float(x[at[0]]), float((y[at] * w[at]).sum()), float(w[at].sum())])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, a, b = steps.pop()
            steps[-1][1] += a
            steps[-1][2] += b
    return [s[0] for s in steps], [s[1] / s[2] for s in steps]


class Voter:
    """The vocabulary, the index of the examples and their labels; gives a text's neighbours and their vote."""

    def __init__(self, words: list[str], weight: np.ndarray, examples: list[tuple[str, int, np.ndarray, np.ndarray, str]], shares: tuple[float, float]):
        """words, weight: the terms and their weights; examples: id, label, numbers of the terms held, how often each, a name of the text;
        shares: of labels 0 and 1 among all that may be learned from."""
        self.words, self.weight, self.shares = words, weight, shares
        n = Counter(e[1] for e in examples)
        self.class_weight = {c: shares[c] * len(examples) / n[c] if n[c] else 0.0 for c in (0, 1)}
        held = [e for e in examples if len(e[2])]
        self.bare = {c: self.class_weight[c] * sum(e[1] == c and not len(e[2]) for e in examples) for c in (0, 1)}
        frequent = np.bincount(np.concatenate([e[2] for e in held] or [np.zeros(0, np.int64)]), minlength=len(words)) > OFTEN * len(held)
        # Examples alike stand side by side, so that a block's maxima are near its members' weights; the order changes no result.
        held = sorted(held, key=lambda e: (e[1], self._heaviest(e, frequent), len(e[2]), e[0]))
        self.ids, self.labels = [e[0] for e in held], np.array([e[1] for e in held], np.int64)
        rank = np.empty(len(held), np.int64)
        rank[sorted(range(len(held)), key=self.ids.__getitem__)] = np.arange(len(held))
        self.copies: dict[str, list[int]] = {}
        for i, e in enumerate(held):
            self.copies.setdefault(e[4], []).append(i)
        term = np.concatenate([e[2] for e in held] or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(held)), [len(e[2]) for e in held])
        self.index = BlockMaxIndex(term, owner, np.concatenate([self.weights(e[2], e[3]) for e in held] or [np.zeros(0)]), len(held), len(words), rank)
        self._vocabulary: dict[str, int] | None = None

    def _heaviest(self, e: tuple, frequent: np.ndarray) -> int:
        at = np.flatnonzero(frequent[e[2]])
        return int(e[2][at][np.argmax(self.weights(e[2], e[3])[at])]) if len(at) else -1

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.weight[terms]
        return w / np.sqrt((w * w).sum())

    def neighbours(self, texts: list[str | None], without: list[str] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the numbers of the nearest examples and their cosines.  without: for each text the name of a text whose examples are left out."""
        if self._vocabulary is None:
            self._vocabulary = {t: i for i, t in enumerate(self.words)}
        out = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
        for a in range(0, len(texts) if self.ids else 0, BATCH):
            found = [(i, *numbered(t, self._vocabulary)) for i, t in enumerate(texts[a : a + BATCH], a)]
            found = [f for f in found if len(f[1])]
            skipped = [self.copies.get(without[i]) for i, *_ in found] if without else None
            for (i, *_), near in zip(found, self.index.nearest([(t, self.weights(t, n)) for _, t, n in found], NEIGHBOURS, skipped) if found else []):
                out[i] = near
        return out

    def vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        toxic = self.labels[ids] == 1
        w = np.where(toxic, self.class_weight[1], self.class_weight[0]) * cosines / (np.maximum(0, 1 - cosines) + SOFT)
        return round(float((w[toxic].sum() + PRIOR * self.shares[1]) / (w.sum() + PRIOR)), 9)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_vocabulary": None}


class Model:
    """A voter, and the probability that its votes stand for."""

    def __init__(self, share: float, voter: Voter | None = None, shared=None, votes: list[tuple[int, float, bool]] = ()):
        """share: of toxic labels; shared: the voter as a broadcast; votes: of each example its label, its vote, whether it had neighbours."""
        self.share, self.voter, self.shared = share, voter, shared
        near = [(y, v) for y, v, met in votes if met]
        bare = Counter(y for y, _, met in votes if not met)
        bare = {c: bare[c] * voter.class_weight[c] for c in (0, 1)} if voter else {0: 0.0, 1: 0.0}
        self.empty = (bare[1] + PRIOR * share) / (bare[0] + bare[1] + PRIOR)
        y, x = np.array([a for a, _ in near], float), np.array([b for _, b in near], float)
        w = np.array([voter.class_weight[int(a)] for a in y]) if voter else y
        starts, values = isotonic(x, y, w)
        ends = [*starts[1:], float(x.max())] if starts else []
        self.centres, self.values = [(a + b) / 2 for a, b in zip(starts, ends)], values

    def probability(self, vote: float) -> float:
        """Interpolated between the middles of the steps."""
        k = bisect_right(self.centres, vote)
        if k == 0 or k == len(self.centres):
            return self.values[min(k, len(self.values) - 1)]
        a, b = self.centres[k - 1], self.centres[k]
        p, q = self.values[k - 1], self.values[k]
        return round(p + (q - p) * (vote - a) / (b - a), 9)

    def scorer(self):
        """A function from texts to the probability that each is toxic, and its nearest examples as (id, label, cosine).  It holds no voter itself."""
        shared, light = self.shared, Model.__new__(Model)
        light.centres, light.values = self.centres, self.values
        empty = self.empty if self.voter else self.share

        def scores(texts: list[str | None]) -> list[tuple[float, list[tuple[str, int, float]]]]:
            if not light.centres:
                return [(empty, [])] * len(texts)
            voter = shared.value
            return [
                (light.probability(voter.vote(ids, near)), [(voter.ids[i], int(voter.labels[i]), float(c)) for i, c in zip(ids[:SHOWN], near)]) if len(ids) else (empty, [])
                for ids, near in voter.neighbours(texts)
            ]

        return scores


def document_frequencies(docs: DataFrame, text: str, words: list[str], shared) -> tuple[int, np.ndarray]:
    """The number of rows, and in how many each term of the vocabulary occurs.  Each task adds up its rows; one row for each term and task is shuffled."""
    schema = StructType([StructField("term", IntegerType()), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = {t: i for i, t in enumerate(shared.value)}, 0
        total = np.zeros(len(shared.value), np.int64)
        for batch in sliced(batches, "text"):
            for t in batch.column("text").to_pylist():
                rows += 1
                total[[at for w in {w[:STEM] for w in _WORD((t or "").lower())} if (at := known.get(w)) is not None]] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int32()), pa.array([rows, *total[some]], pa.int64())], schema.names)

    with small_batches(docs.sparkSession):
        found = docs.select(F.col(text).alias("text")).mapInArrow(count, schema).groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(words) + 1, np.int64)
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the model.  `usable` is a condition on the labels' rows.  Of the examples only the terms reach the driver, as numbers: those of at most
    2 * PER_CLASS texts, and the vocabulary with its document frequencies."""
    context = docs.sparkSession.sparkContext
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = (known.where(usable) if usable is not None else known).groupBy(F.col(id_col).cast("string").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = scratch.table(known, "labels")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    shares = (n.get(0, 0) / max(1, sum(n.values())), n.get(1, 0) / max(1, sum(n.values())))
    first = [known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS) for c in (0, 1)]
    chosen = F.broadcast(scratch.table(first[0].union(first[1]), "chosen"))  # at most 2 * PER_CLASS rows of two short values
    texts = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen, "doc_id")
    texts = texts.withColumn("name", F.md5(F.col("text").cast("binary"))).groupBy("doc_id").agg(F.min_by(F.struct("label", "name", "text"), F.struct("name", "label")).alias("e"))
    texts = scratch.table(texts.select("doc_id", "e.*"), "texts")
    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.countDistinct("name").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model(shares[1])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"terms": pa.array([list(counted(x)) for x in batch.column("text").to_pylist()], pa.list_(pa.string()))}

        return work

    # Copies of a text count once.
    one = arrow_pass(texts.dropDuplicates(["name", "label"]), "text", ["label"], StructType([StructField("terms", ArrayType(StringType()))]), make)
    per = one.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    with small_batches(docs.sparkSession):
        telling = per.where(F.col("all") >= LEAST).orderBy("term").toArrow()
    words = telling.column("term").to_pylist()
    bad, every = (telling.column(c).to_numpy().astype(float) for c in ("bad", "all"))
    shared = context.broadcast(words)
    rows, frequency = document_frequencies(docs, text_col, words, shared)
    ratio = ((bad + 0.5) / (size[1] + 1)) / ((every - bad + 0.5) / (size[0] + 1))
    weight = np.log((1 + rows) / (0.5 + np.maximum(1, frequency))) * (FLOOR + np.abs(np.log(ratio)))

    def make_numbers():
        vocabulary, kind = {t: i for i, t in enumerate(shared.value)}, pa.list_(pa.int32())

        def work(batch: pa.RecordBatch) -> dict:
            found = [numbered(x, vocabulary) for x in batch.column("text").to_pylist()]
            return {"terms": pa.array([t for t, _ in found], kind), "counts": pa.array([n for _, n in found], kind)}

        return work

    kind = ArrayType(IntegerType())
    held = arrow_pass(texts, "text", ["doc_id", "label", "name"], StructType([StructField("terms", kind), StructField("counts", kind)]), make_numbers)
    with small_batches(docs.sparkSession):
        held = held.select("doc_id", "label", "name", "terms", "counts").toArrow()
    columns = [held.column(c).to_pylist() for c in ("doc_id", "label", "name")]
    voter = Voter(words, weight, [(i, y, t.values.to_numpy(), c.values.to_numpy(), m) for i, y, m, t, c in zip(*columns, held.column("terms"), held.column("counts"))], shares)
    del held, columns, telling
    shared.unpersist()
    shared = context.broadcast(voter)

    def make_votes():
        def work(batch: pa.RecordBatch) -> dict:
            found = shared.value.neighbours(batch.column("text").to_pylist(), batch.column("name").to_pylist())
            return {"vote": pa.array([shared.value.vote(*f) for f in found], pa.float64()), "met": pa.array([len(f[0]) > 0 for f in found], pa.bool_())}

        return work

    votes = arrow_pass(texts, "text", ["doc_id", "label", "name"], StructType([StructField("vote", DoubleType()), StructField("met", BooleanType())]), make_votes)
    with small_batches(docs.sparkSession):
        votes = votes.select("doc_id", "label", "vote", "met").toArrow()  # at most 2 * PER_CLASS rows
    scratch.only()
    return Model(shares[1], voter, shared, list(zip(*(votes.column(c).to_pylist() for c in ("label", "vote", "met")))))


def classify(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, score: str = "score", evidence: str = "evidence") -> DataFrame:
    """The kept columns (all by default), score and evidence (the nearest examples as id, label and cosine)."""
    of = model.scorer()

    def make():
        kind = pa.list_(pa.struct([("example", pa.string()), ("label", pa.int32()), ("cosine", pa.float64())]))

        def work(batch: pa.RecordBatch) -> dict:
            scores, found = zip(*of(batch.column(text).to_pylist()))
            rows = [[{"example": i, "label": y, "cosine": c} for i, y, c in e] for e in found]
            return {score: pa.array(scores, pa.float64()), evidence: pa.array(rows, kind)}

        return work

    shown = ArrayType(StructType.fromDDL("example string, label int, cosine double"))
    return arrow_pass(df, text, df.columns if keep is None else keep, StructType([StructField(score, DoubleType()), StructField(evidence, shown)]), make)
