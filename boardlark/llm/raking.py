"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic).  Starting from each cell's tokens, ROUNDS times each dimension's totals are scaled to their
targets in turn.  A cell's factor is its fitted weight over its tokens.  Documents are then sampled with probability min(1, s * factor), where s makes
the expected tokens a share of all; a document's draw is a hash of its id, so the sample is repeatable.

All of it is DataFrame expressions.  Only the cells, one row for each combination of labels that occurs, are brought together, up to ONE_TASK of them; more are
fitted by partial totals that are joined back, to the same result.

With `whole`, probabilities themselves are fitted (fit_whole): cells capped at 1 are made up for by the others of their source, language and topic, and the
budget is lowered where the targets can't be met at it, so that the expected sample has the target shares, for any number of cells.  Without it, capped
cells miss them.

Cases: null labels are a value of their own; null and empty texts have no tokens and are kept, as they cost nothing; a null id is hashed as the empty
string; repeated rows are drawn alike; very long texts count whole; an empty table gives no rows; columns of the input may have any names; where a marginal can't be met because a cell is empty or capped at 1, the nearest fit of the last round stands.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlark.llm.shared import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: Target shares are the present shares to this power, scaled to 1: below 1 lifts what is rare.
POWER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
ROUNDS = 10
#: Share of all tokens that a sample is expected to hold.
BUDGET = 0.8
#: For the fit of probabilities the budget isn't lowered below this share for targets that contradict each other; the nearest fit stands then.
LEAST_BUDGET = 0.5
SEED = "mix-1"
#: Cells that are fitted in one task, or on the driver, at most; more go by joined totals.
ONE_TASK = 200_000
#: The topic of a text, first match wins; the marks that redaction leaves count as what they stand for.
TOPIC = """CASE WHEN contains(lower(text), 'licen') THEN 'legal' WHEN contains(text, '|') THEN 'tabular' WHEN contains(text, '@') OR contains(text, '[EMAIL]') OR contains(text, '[PHONE]') THEN 'contact'
WHEN contains(text, '!!') OR contains(text, '%%%') OR contains(text, '###') THEN 'noisy' ELSE 'prose' END"""
TOKENS = "CAST(ceil(coalesce(octet_length(text), 0) / 4) AS BIGINT)"
#: For the fit of probabilities: rounds at one budget at most, and how near to its target each share must come.
FIT_ROUNDS, NEAR = 300, 1e-4
Fit = TypeVar("Fit")


def labelled(df: DataFrame, topic: str = TOPIC, tokens: str = TOKENS) -> DataFrame:
    """The columns of df and _source, _lang, _topic and _tokens."""
    return df.withColumns({"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_topic": F.expr(f"coalesce({topic}, '')"), "_tokens": F.expr(tokens)})


def fit(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """_source, _lang, _topic, weight (fitted tokens) and probability of every cell of labelled() documents.  targets: for a dimension, a table of
    (value, share); without it, the tempered present shares."""
    names = [f"_{d}" for d in DIMENSIONS]
    scratch = Scratch(docs.sparkSession, "raking")
    cells = scratch.table(docs.groupBy(*names).agg(F.sum("_tokens").alias("tokens")), "cells")
    if cells.limit(ONE_TASK + 1).count() > ONE_TASK:
        return _fit_large(cells, scratch, targets, budget, rounds)
    # One partition of a checked size: all windows below then need no exchange.
    cells = cells.coalesce(1)
    every = Window.partitionBy(F.lit(1))
    by = {d: Window.partitionBy(f"_{d}") for d in DIMENSIONS}
    for d in DIMENSIONS:
        if targets and d in targets:
            want = targets[d].select(F.col("value").alias(f"_{d}"), F.col("share").alias("want"))
            cells = cells.join(want, f"_{d}", "left").withColumn("want", F.coalesce("want", F.lit(0.0))).withColumnRenamed("want", f"to_{d}").coalesce(1)
        else:
            tempered = F.pow(F.sum("tokens").over(by[d]).cast("double"), F.lit(POWER[d]))
            cells = cells.withColumn("own", tempered).withColumn("first", F.row_number().over(by[d].orderBy(*[f"_{x}" for x in DIMENSIONS])) == 1)
            cells = cells.withColumn(f"to_{d}", F.try_divide("own", F.sum(F.when(F.col("first"), F.col("own"))).over(every))).drop("own", "first")
    cells = cells.withColumn("total", F.sum("tokens").over(every).cast("double")).withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = F.sum("weight").over(by[d])
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.try_divide(F.col(f"to_{d}") * F.col("total"), now)).otherwise(F.lit(0.0)))
    cells = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.try_divide("weight", "tokens")))
    # Cells in falling order of factor: if the first k are taken whole, the rest share what is left of the budget.
    falling = Window.orderBy(F.desc_nulls_last("factor"), *[f"_{x}" for x in DIMENSIONS])
    before = falling.rowsBetween(Window.unboundedPreceding, -1)
    after = falling.rowsBetween(0, Window.unboundedFollowing)
    left = F.greatest(F.lit(0.0), F.lit(budget) * F.col("total") - F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    cells = cells.withColumn("scale", F.try_divide(left, F.sum("weight").over(after)))
    fits = F.min(F.when(F.col("scale") * F.col("factor") <= 1, F.struct(-F.col("factor"), "scale"))).over(every)["scale"]
    cells = cells.withColumn("probability", F.when(F.col("factor").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(fits, F.lit(1e300)) * F.col("factor"))))
    return F.broadcast(cells.select(*[f"_{d}" for d in DIMENSIONS], "weight", "probability"))  # ONE_TASK rows at most


def _fit_large(cells: DataFrame, scratch: Scratch, targets: dict[str, DataFrame] | None, budget: float, rounds: int) -> DataFrame:
    """fit() for any number of cells: totals by partial aggregation, joined back and written at each step, so that no group of cells meets in one task."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in DIMENSIONS:
        now = cells.groupBy(f"_{d}").agg(F.sum("tokens").alias("own"))
        if targets and d in targets:
            want = now.select(f"_{d}").join(targets[d].select(F.col("value").alias(f"_{d}"), F.col("share").alias("want")), f"_{d}", "left").select(f"_{d}", F.coalesce("want", F.lit(0.0)).alias("want"))
        else:
            now = now.select(f"_{d}", F.pow(F.col("own").cast("double"), F.lit(POWER[d])).alias("own"))
            every = float(now.agg(F.sum("own")).first()[0] or 0)
            want = now.select(f"_{d}", F.try_divide("own", F.lit(every)).alias("want"))
        cells = cells.join(want.withColumnRenamed("want", f"to_{d}"), f"_{d}")
    cells = scratch.table(cells.withColumn("weight", F.col("tokens").cast("double")), "weighed")
    step = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = cells.groupBy(f"_{d}").agg(F.sum("weight").alias("now"))
            cells = cells.join(now, f"_{d}").withColumn("weight", F.when(F.col("now") > 0, F.col("weight") * F.try_divide(F.col(f"to_{d}") * total, F.col("now"))).otherwise(F.lit(0.0))).drop("now")
            step += 1
            cells = scratch.table(cells, f"weighed-{step}")
            scratch.drop(f"weighed-{step - 1}" if step > 1 else "weighed")
    cells = cells.withColumn("factor", F.when(F.col("tokens") > 0, F.try_divide("weight", "tokens")))
    # The scale at which cells taken whole and shares of the others come to the budget: from none taken whole on, the set only grows.
    scale, taken = 0.0, -1
    while True:
        whole = F.coalesce(F.col("factor") * scale > 1, F.lit(False))
        n, held, rest = cells.agg(F.count_if(whole), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("weight")))).first()
        if n == taken or not rest:
            break
        taken, scale = n, max(0.0, budget * total - (held or 0)) / rest
    return cells.select(*[f"_{d}" for d in DIMENSIONS], "weight", F.when(F.col("factor").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("factor") * scale)).alias("probability"))


def largest(at: Callable[[float, bool], Fit | None], most: float, budget: float) -> Fit:
    """The fit at(b, nearest) with the largest budget b up to `most` at which it is found, LEAST_BUDGET at least; if none is found there, the nearest one
    stands.  Of the fits that are found the last one is returned."""
    low, high = min(LEAST_BUDGET, budget), most
    found = at(high, False) if high >= low else None
    if found is not None:
        return found
    p = at(low, False) if high >= low else None
    if p is None:
        return at(low, True)
    for _ in range(12):
        middle = (low + high) / 2
        found = at(middle, False)
        if found is None:
            high = middle
        else:
            low, p = middle, found
    return p


def bounded(tokens: np.ndarray, groups: list[np.ndarray], shares: list[np.ndarray], budget: float, rounds: int = FIT_ROUNDS, near: float = NEAR) -> np.ndarray:
    """Probabilities of cells, such that in each dimension the expected tokens have the given shares (groups: each cell's value; shares: of each value,
    which sum to 1), at the largest() budget."""
    total = tokens.sum()
    members = [[np.flatnonzero(g == v) for v in range(len(a))] for g, a in zip(groups, shares)]
    most = min([budget, *(tokens[m].sum() / (total * x) for ms, a in zip(members, shares) for m, x in zip(ms, a) if x > 0)])

    def fill(w: np.ndarray, t: np.ndarray, want: float) -> np.ndarray:
        """min(t, l * w) with l such that the sum is `want`, or all of t; what has no weight gets none."""
        order = np.argsort(np.where(w > 0, t / np.maximum(w, 1e-300), np.inf), kind="stable")
        w, t = w[order], t[order]
        left, rest = want - (np.cumsum(t) - t), np.cumsum(w[::-1])[::-1]
        scale = np.divide(left, rest, out=np.zeros(len(w)), where=rest > 0)
        fits = np.flatnonzero((scale * w <= t) & (w > 0))
        out = np.empty(len(w))
        out[order] = np.minimum(t, max(0.0, scale[fits[0]]) * w) if len(fits) else np.where(w > 0, t, 0.0)
        return out

    def at(b: float, nearest: bool = False) -> np.ndarray | None:
        w = tokens * b
        for _ in range(rounds):
            for ms, a in zip(members, shares):
                for m, x in zip(ms, a):
                    w[m] = fill(w[m], tokens[m], b * total * x)
            if all(np.abs(np.bincount(g, w, len(a)) / (b * total) - a).max() <= near for g, a in zip(groups, shares)):
                return w / tokens
        return w / tokens if nearest else None

    return largest(at, most, budget)


def _bounded_large(cells: DataFrame, scratch: Scratch, targets: dict[str, DataFrame] | None, budget: float, rounds: int = FIT_ROUNDS, near: float = NEAR) -> DataFrame:
    """The cells that have tokens, with weight and probability: bounded() for any number of cells and values.  Totals are partial aggregates that are joined
    back, and weights are written at each step, so that no group of cells meets in one task and only single numbers come to the driver."""
    names = [f"_{d}" for d in DIMENSIONS]
    cells = cells.where("tokens > 0").withColumn("tokens", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    most = budget
    for d in DIMENSIONS:
        own = cells.groupBy(f"_{d}").agg(F.sum("tokens").alias("own"))
        if targets and d in targets:
            given = targets[d].groupBy(F.col("value").alias(f"_{d}")).agg(F.last("share").cast("double").alias("want"))
            own = own.join(given, f"_{d}", "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
        else:
            own = own.withColumn("want", F.pow("own", F.lit(POWER[d])))
        own = scratch.table(own, f"own_{d}")
        every = own.agg(F.sum("want")).first()[0] or 1.0
        own = own.withColumn(f"to_{d}", F.col("want") / F.lit(every))
        least = own.where(F.col(f"to_{d}") > 0).agg(F.min(F.try_divide("own", F.lit(total) * F.col(f"to_{d}")))).first()[0]
        most = most if least is None else min(most, least)
        cells = cells.join(own.select(f"_{d}", f"to_{d}"), f"_{d}")
    cells = scratch.table(cells, "weighed")
    step = 0

    def spread(now: DataFrame, d: str, b: float) -> DataFrame:
        """Each value's cells get min(tokens, scale * weight), with a scale such that they sum to the target.  It starts where it would stand without caps and
        grows by what the capped cells leave to the others, until it caps no more of them; a value whose cells are all capped keeps the scale that caps them."""
        nonlocal step
        scales = now.groupBy(f"_{d}").agg(F.coalesce(F.try_divide(F.max(f"to_{d}") * F.lit(b * total), F.sum("weight")), F.lit(0.0)).alias("scale"))
        over = (F.col("weight") > 0) & (F.col("scale") * F.col("weight") > F.col("tokens"))
        capped = 0
        while True:
            sums = now.join(scales, f"_{d}").groupBy(f"_{d}").agg(
                F.max("scale").alias("scale"), F.max(f"to_{d}").alias("to"), F.count_if(over).alias("n"),
                F.sum(F.when(over, F.col("tokens")).otherwise(0.0)).alias("held"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("rest"),
            )
            left = F.try_divide(F.col("to") * F.lit(b * total) - F.col("held"), F.col("rest"))
            step += 1
            written = scratch.table(sums.select(f"_{d}", F.greatest("scale", left).alias("scale"), "n"), f"scales-{step}")
            n = written.agg(F.sum("n")).first()[0] or 0
            scales = written.drop("n")
            if n == capped:
                break
            capped = n
        weight = F.when(F.col("weight") > 0, F.least("tokens", F.col("scale") * F.col("weight"))).otherwise(F.lit(0.0))
        return now.join(scales, f"_{d}").withColumn("weight", weight).drop("scale")

    def off(now: DataFrame, d: str, b: float) -> float:
        """How far the share of the worst value is from its target."""
        share = F.try_divide(F.sum("weight"), F.lit(b * total))
        worst = now.groupBy(f"_{d}").agg(F.abs(share - F.max(f"to_{d}")).alias("off")).agg(F.max("off")).first()[0]
        return float("inf") if worst is None else worst

    best: list[str] = []

    def at(b: float, nearest: bool) -> DataFrame | None:
        nonlocal step
        now, last = cells.withColumn("weight", F.col("tokens") * F.lit(b)), ""
        for _ in range(rounds):
            for d in DIMENSIONS:
                now = spread(now, d, b)
                step += 1
                last = f"weighed-{step}"
                now = scratch.table(now, last)
                scratch.only("cells", "weighed", last, *best)
            if all(off(now, d, b) <= near for d in DIMENSIONS):
                best[:] = [last]
                return now
        return now if nearest else None

    found = largest(at, most, budget) if total else cells.withColumn("weight", F.lit(0.0))
    return found.select(*names, "weight", F.least(F.lit(1.0), F.try_divide("weight", "tokens")).alias("probability"))


def fit_whole(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, rounds: int = FIT_ROUNDS) -> DataFrame:
    """As fit(), with probabilities that keep the target shares.  Up to ONE_TASK cells are fitted on the driver, more of them by joined totals, to the same
    result."""
    names = [f"_{d}" for d in DIMENSIONS]
    scratch = Scratch(docs.sparkSession, "raking")
    cells = scratch.table(docs.groupBy(*names).agg(F.sum("_tokens").alias("tokens")), "cells")
    rows = cells.limit(ONE_TASK + 1).collect()
    if len(rows) > ONE_TASK:
        free = cells.where("tokens <= 0").select(*names, F.lit(0.0).alias("weight"), F.lit(1.0).alias("probability"))
        return _bounded_large(cells, scratch, targets, budget, rounds).unionByName(free)
    held = [r for r in rows if r["tokens"] > 0]
    tokens = np.array([r["tokens"] for r in held], float)
    groups, shares = [], []
    for d in DIMENSIONS:
        values, group = np.unique(np.array([r[f"_{d}"] for r in held], object), return_inverse=True) if held else (np.zeros(0, object), np.zeros(0, int))
        if targets and d in targets:
            want = {r["value"]: r["share"] for r in targets[d].collect()}
            share = np.array([want.get(v, 0.0) for v in values], float)
        else:
            share = np.bincount(group, tokens, len(values)) ** POWER[d]
        groups.append(group)
        shares.append(share / share.sum() if share.sum() > 0 else share)
    p = bounded(tokens, groups, shares, budget, rounds) if held else np.zeros(0)
    out = [(*(r[n] for n in names), float(r["tokens"] * x), float(min(1.0, x))) for r, x in zip(held, p)]
    out += [(*(r[n] for n in names), 0.0, 1.0) for r in rows if not r["tokens"]]
    fitted = docs.sparkSession.createDataFrame(out, ", ".join(f"{n} string" for n in names) + ", weight double, probability double")
    return F.broadcast(fitted)  # ONE_TASK rows at most


def draw(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id, 52 bits of its hash."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def mixed(df: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, topic: str = TOPIC, id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """The columns of labelled(), weight, probability and selected of every row.  whole: probabilities of fit_whole()."""
    docs = labelled(df, topic)
    cells = fit_whole(docs, targets, budget) if whole else fit(docs, targets, budget)
    return docs.join(cells, [f"_{d}" for d in DIMENSIONS]).withColumn("selected", draw(id_col) < F.col("probability"))


def sample(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The selected rows, with the columns of df, whatever their names: the row travels as one value beside what is computed."""
    if not {"source", "lang", "text", id_col} <= set(df.columns):
        raise ValueError("a sample needs the columns source, lang, text and the id")
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), "source", "lang", "text", F.col(id_col).alias("doc_id"))
    return mixed(whole, **options).where("selected").select("_row.*")
