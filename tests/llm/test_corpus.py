"""Operators that look across documents: near copies, toxicity, rollups, mixing, and the pipeline."""

import collections
import decimal
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardlark.llm import minhash, queries, raking, shared, token_rollup, toxicity
from boardlark.llm.shared import Scratch, held_out

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(rows, n):
    """All pairs by brute force."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def check_components(df, rows, n):
    want = plain_components(rows, n)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.fixture(scope="module")
def mutated():
    """Families of near copies at all distances around the threshold, with a large family."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for size in (150, 30, 12, 12, 6):
        base = [rng.choice(vocabulary) for _ in range(80)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 5, 6, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, mutated, monkeypatch):
    df = spark.createDataFrame(mutated, "doc_id bigint, text string")
    check_components(minhash.near_duplicates(df, words=2), mutated, 2)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    check_components(minhash.near_duplicates(df, words=1), mutated, 1)


def test_near_duplicates_over_documents(spark, sf, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = queries.op4_minhash(spark, sf)
    check_components(out, rows, 2)
    assert all(r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]], 2)) for r in out.collect())


def test_near_duplicates_odd_rows(odd, empty):
    out = minhash.near_duplicates(odd, words=2).collect()
    assert len(out) == odd.count() and minhash.near_duplicates(empty, words=2).count() == 0
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert by[5][0]["component_id"] == 1 and not by[5][0]["kept"] and by[2][0]["component_id"] == 2 and by[2][0]["n_shingles"] == 0
    assert by[7][0]["n_shingles"] == 1 and by[None][0]["kept"] and by[None][0]["component_id"] is None


def test_sketch_fills_and_concentrates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 500):
        s = minhash.sketch(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)))
        assert len(s) == minhash.T and (s >> np.uint64(32)).max() < 2 * minhash.T
    a = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64))
    equal = (minhash.sketch(a[:800]) == minhash.sketch(a[100:900])).mean()  # Jaccard 700 / 900
    assert abs(equal - 7 / 9) < 0.1


def test_components_of_a_path(spark):
    n = 40
    order = random.Random(2).sample(range(n), n)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(100, 101)], "a bigint, b bigint")
    out = {r["node"]: r["root"] for r in minhash.components(edges, Scratch(spark, "t"), "c").collect()}
    assert {out[k] for k in range(n)} == {0} and out[101] == 100


def test_block_max_index_is_exact(monkeypatch):
    rng = np.random.default_rng(6)
    dense = np.where(rng.random((300, 90)) < np.linspace(0.5, 0.02, 90), rng.random((300, 90)) + 0.1, 0)
    dense[150:160] = dense[40:50]  # ties
    dense /= np.maximum(1e-9, np.sqrt((dense**2).sum(1, keepdims=True)))
    owner, term = np.nonzero(dense)
    rank = rng.permutation(300)
    for often, block in ((0.1, 64), (2.0, 16), (0.0, 7)):
        monkeypatch.setattr(toxicity, "OFTEN", often)
        monkeypatch.setattr(toxicity, "BLOCK", block)
        index = toxicity.BlockMaxIndex(term, owner, dense[owner, term], 300, 90, rank)
        asked = [(np.flatnonzero(v), v[v > 0]) for v in dense[:70]]
        for outs in (None, [[k, 299 - k] if k % 3 else None for k in range(70)]):
            for k, (v, (ids, scores)) in enumerate(zip(dense, index.nearest(asked, 10, outs))):
                want = sorted((-round(s, 12), rank[i], i) for i, s in enumerate(dense @ v) if s > 0 and not (outs and outs[k] and i in outs[k]))[:10]
                assert ids.tolist() == [i for *_, i in want] and np.allclose(scores, [-s for s, *_ in want])


def plain_toxicity(docs, labels):
    """Scores and evidence by dense cosines with every example, from the definitions alone; docs: {id: text}, labels: {id: label}."""
    def terms(text):
        return collections.Counter(w[:4] for w in re.findall(r"[^\W\d_]+", text.lower()))

    held_out_id = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnable = {i: y for i, y in labels.items() if not held_out_id(i)}
    share = sum(learnable.values()) / len(learnable)
    examples = sorted((str(i), y, docs[i]) for i, y in learnable.items() if i in docs)
    own = {t: terms(t) for t in docs.values()}
    one = {(t, y) for _, y, t in examples}
    n = {c: sum(y == c for _, y in one) for c in (0, 1)}
    held = {c: collections.Counter(w for t, y in one if y == c for w in own[t]) for c in (0, 1)}
    vocabulary = sorted(w for w in {*held[0], *held[1]} if held[0][w] + held[1][w] >= 2)
    frequency = collections.Counter(w for t in docs.values() for w in own[t])
    factor = {w: np.log((1 + len(docs)) / (0.5 + frequency[w])) * (0.5 + abs(np.log(((held[1][w] + 0.5) / (n[1] + 1)) / ((held[0][w] + 0.5) / (n[0] + 1))))) for w in vocabulary}

    def vector(text):
        v = np.array([(1 + np.log(own[text][w])) * factor[w] if own[text][w] else 0 for w in vocabulary])
        return v / np.sqrt((v * v).sum()) if v.any() else v

    matrix, y = np.stack([vector(t) for *_, t in examples]), np.array([e[1] for e in examples])
    weight = np.array([1 - share, share]) * len(y) / np.bincount(y, minlength=2)

    def vote(text, skip=False):
        c = matrix @ vector(text)
        if skip:
            c[[k for k, e in enumerate(examples) if e[2] == text]] = 0
        near = [k for k in np.lexsort((np.arange(len(c)), -np.round(c, 12))) if c[k] > 1e-12][:25]
        w = weight[y[near]] * c[near] / (np.maximum(0, 1 - c[near]) + 0.05)
        return near, c, round(float(((w * y[near]).sum() + 2 * share) / (w.sum() + 2)), 9)

    votes = [vote(t, True) for *_, t in examples]
    met = [k for k, v in enumerate(votes) if v[0]]
    starts, values = toxicity.isotonic(np.array([votes[k][2] for k in met]), y[met].astype(float), weight[y[met]])
    centres = (np.array(starts) + np.array([*starts[1:], max(votes[k][2] for k in met)])) / 2
    out = {}
    for i, t in docs.items():
        near, c, v = vote(t)
        out[i] = float(np.interp(v, centres, values)), [(examples[k][0], int(y[k]), c[k]) for k in near[:3]]
    return out


def test_toxicity_equals_dense_brute_force(spark, sf, docs):
    """Every score and all evidence of the query, and that every document that shares a term with an example has neighbours."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = plain_toxicity(texts, labels)
    got = {r["doc_id"]: r for r in queries.op3_toxicity(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (score, near) in want.items():
        assert got[i]["score"] == pytest.approx(score, abs=1e-6), i
        assert got[i]["evidence"] == ",".join(f"{e}:{y}:{spark_round(c)}" for e, y, c in near), i
    assert len({r["score"] for r in got.values()}) > 50 and all(r["evidence"] for r in got.values())


def spark_round(x):
    return float(decimal.Decimal(repr(float(x))).quantize(decimal.Decimal("0.0001"), decimal.ROUND_HALF_UP))


def test_toxicity_flags_insults_of_a_small_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    insults = [i for i, t in texts.items() if len(re.findall("idiot|disgusting|worthless|stupid|pathetic|scum|moron", (t or "").lower())) >= 3]
    flagged = {r["doc_id"] for r in queries.op3_toxicity(spark, sf).where("predicted = 1").collect()}
    assert insults and len(flagged & set(insults)) >= 0.9 * len(insults)


def test_isotonic():
    starts, values = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert starts == [0.1, 0.2, 0.4] and values == [0.0, 0.5, 1.0]


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit >= 0.8 * sum(r["toxic"] for r in rows) and hit >= 0.9 * sum(r["predicted"] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_odd_rows(spark, odd, empty, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels, usable=~held_out(F.col("doc_id")))
    out = toxicity.classify(odd, model).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out) and toxicity.classify(empty, model).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert toxicity.classify(odd, none, keep=["doc_id"]).where("score <> 0").count() == 0
    named = toxicity.classify(odd, model, score="s", evidence="e")
    assert named.columns == [*odd.columns, "s", "e"] and {r["score"] for r in named.collect()} == {0.5}
    twice = toxicity.learn(odd, spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (8, None)], "doc_id bigint, toxic int"))
    assert toxicity.classify(odd, twice).count() == odd.count()


def test_rollup_is_idempotent_and_exact(spark):
    store = token_rollup.RollupStore(spark, f"{Scratch(spark, 'r').root}/s")
    change = "op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"
    rng = random.Random(1)
    totals = collections.Counter()
    for b in range(5):
        rows = []
        for _ in range(50):
            op, s, lang, n, old = rng.choice(["insert", "insert", "delete", "revise"]), rng.choice(["a", None]), rng.choice(["x", "y"]), rng.randrange(100), rng.randrange(100)
            rows.append((op, s, lang, "t1", n, old))
            totals[s, lang] += {"insert": n, "delete": -n, "revise": n - old}[op]
        df = spark.createDataFrame(rows, change)
        assert store.commit(f"b{b}", df) and not store.commit(f"b{b}", df)
        if b == 1:
            again = df
        if b == 2:
            store.compact()
            assert not store.commit("b1", again)
    assert store.commit("none", spark.createDataFrame([], change))
    assert {(r["source"], r["lang"]): r["tokens"] for r in store.totals().collect()} == dict(totals)
    store.compact()
    assert {(r["source"], r["lang"]): r["tokens"] for r in store.totals().collect()} == dict(totals) and len(store.committed()) == 6


CHANGE = "doc_id bigint, op string, source string, lang string, tokenizer string, n_tokens bigint, old_tokens bigint"


def rollup_totals(store):
    return sorted(tuple(r) for r in store.totals().collect())


def test_rollup_lost_writers_and_races(spark):
    """Folders without an id, a compaction that another overtook, one that was lost before deleting, and a repeated id with other content."""
    store = token_rollup.RollupStore(spark, f"{Scratch(spark, 'r').root}/s")
    row = lambda n, op="insert": spark.createDataFrame([(1, op, "a", "x", "t", n, None)], CHANGE)
    token_rollup.deltas(row(99)).write.parquet(f"{store.root}/live/b9.lost")  # a writer lost before its commit
    assert store.commit("b1", row(5)) and store.commit("b2", row(10)) and rollup_totals(store) == [("a", "x", "t", 2, 15)]
    with pytest.raises(ValueError, match="other changes"):
        store.commit("b1", row(6))
    with pytest.raises(ValueError):
        store.commit("../b", row(6))
    with pytest.raises(Exception, match="unknown change"):
        store.commit("b3", row(1, "upsert"))
    other = token_rollup.RollupStore(spark, store.root)
    state = store._state()
    late = other._state()  # both see the same state
    store._state = lambda: state
    assert store.compact()
    other._state = lambda: late
    assert not other.compact()  # overtaken: nothing is deleted
    del store._state, other._state
    assert rollup_totals(store) == rollup_totals(other) == [("a", "x", "t", 2, 15)]
    assert store.commit("b4", row(1)) and not store.commit("b2", row(10))
    store._drop = lambda folder: None  # lost before it deletes
    assert store.compact() and rollup_totals(other) == [("a", "x", "t", 3, 16)]
    del store._drop
    assert other.commit("b5", row(16, "delete")) and other.compact() and rollup_totals(store) == [("a", "x", "t", 2, 0)]
    assert other.compact() and other.compact() and rollup_totals(store) == [("a", "x", "t", 2, 0)]
    assert store._names("live") == ["b9.lost"] and store.committed() == ["b1", "b2", "b4", "b5"] and len(store._names("sums")) == 2


def test_rollup_verified(spark):
    ledger = spark.createDataFrame([(1, "a", None, "t", 5)], "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")
    changes = spark.createDataFrame([(1, "revise", "a", None, "t", 7, 5), (1, "revise", "a", None, "t", 7, 4), (2, "revise", "a", None, "t", 7, 0), (1, "delete", "a", None, "t", 5, None), (1, "insert", "a", None, "t", 5, None), (None, "insert", "a", None, "t", 5, None)], CHANGE)
    good, bad = token_rollup.verified(changes, ledger)
    assert sorted((r["doc_id"] or 0, r["op"], r["old_tokens"] or 0) for r in good.collect()) == [(0, "insert", 0), (1, "delete", 0), (1, "revise", 5)] and bad.count() == 3


def test_rollup_odd_rows(spark, odd, empty):
    def run(rows):
        rows = rows.select("doc_id", "text", "source", "lang", F.lit(1).cast("long").alias("estimate"), F.lit(2).cast("long").alias("words"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("name"))
        return queries.token_rollup_of(rows, Scratch(spark, "odd")).collect()

    out = run(odd)
    texts = {r["text"] or "" for r in odd.collect()}
    assert sum(r["n_docs"] for r in out if r["tokenizer"] == "words") == len(texts) and any(r["source"] is None or r["lang"] is None for r in out) and run(empty) == []
    # Of the text of ids 1, 5 and 5 the row of id 1 stays; the text without an id stays too.
    assert {(r["source"], r["lang"]): r["n_docs"] for r in out if r["tokenizer"] == "words"}["c", "en"] == 2


def test_rollup_query_equals_plain_counts(spark, sf, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want, seen = collections.Counter(), set()
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        for name, n in (("byte_bpe_50k", len(tok.encode(r["text"], add_special_tokens=False).ids)), ("words", len(WORD.findall(r["text"])))):
            want[r["source"], r["lang"], name] += n
    got = queries.op2_token_rollup(spark, sf).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): r["n_tokens"] for r in got} == dict(want)
    assert sum(r["n_docs"] for r in got) == 2 * len(seen)


def test_raking_meets_targets(spark, sf, docs):
    labelled = raking.labelled(docs)
    want = spark.createDataFrame([("en", 0.25), ("fr", 0.25), ("de", 0.25), ("es", 0.25)], "value string, share double")
    cells = raking.fit(labelled, {"lang": want}, rounds=25)
    share = {r["_lang"]: r["w"] for r in cells.groupBy("_lang").agg(F.sum("weight").alias("w")).collect()}
    assert all(w == pytest.approx(sum(share.values()) / 4, rel=1e-3) for w in share.values())
    out = raking.mixed(docs).collect()
    assert len(out) == docs.count() and all(0 <= r["probability"] <= 1 for r in out)
    expected = sum(r["_tokens"] * r["probability"] for r in out)
    assert expected == pytest.approx(raking.BUDGET * sum(r["_tokens"] for r in out), rel=0.02)


def test_raking_whole_sample_has_the_target_shares(spark, docs, odd, empty):
    out = raking.mixed(docs, whole=True).collect()
    assert len(out) == docs.count() and all(0 <= r["probability"] <= 1 for r in out)
    kept = sum(r["_tokens"] * r["probability"] for r in out)
    assert 0 < kept <= (raking.BUDGET + 0.001) * sum(r["_tokens"] for r in out)
    for d in raking.DIMENSIONS:
        now, got = collections.Counter(), collections.Counter()
        for r in out:
            now[r[f"_{d}"]] += r["_tokens"]
            got[r[f"_{d}"]] += r["_tokens"] * r["probability"]
        all_ = sum(n ** raking.POWER[d] for n in now.values())
        assert all(got[v] / kept == pytest.approx(n ** raking.POWER[d] / all_, abs=1e-3) for v, n in now.items())
    assert raking.mixed(odd, whole=True).count() == odd.count() and raking.mixed(empty, whole=True).count() == 0


def test_raking_large_equals_small(docs, odd, empty, spark, monkeypatch):
    want = {"lang": spark.createDataFrame([("en", 0.5), ("fr", 0.25), ("de", 0.25)], "value string, share double")}
    for rows in (docs, odd, empty):
        for targets in (None, want):
            out = []
            for most in (200_000, 0):
                monkeypatch.setattr(raking, "ONE_TASK", most)
                out.append({(r["_source"], r["_lang"], r["_topic"]): (r["weight"], r["probability"]) for r in raking.fit(raking.labelled(rows), targets).collect()})
            assert set(out[0]) == set(out[1]) and all(out[0][k] == pytest.approx(out[1][k], rel=1e-9, abs=1e-9) for k in out[0])


def test_raking_whole_large_equals_small(docs, odd, empty, spark, monkeypatch):
    """Beyond ONE_TASK cells the same probabilities come out: with caps that bind, without rows, and where no fit is found."""
    want = {"lang": spark.createDataFrame([("en", 0.5), ("fr", 0.25), ("de", 0.25)], "value string, share double")}
    for rows, options in ((docs, {"budget": 0.66}), (odd, {"rounds": 1}), (odd, {"rounds": 1, "targets": want}), (empty, {})):
        out = []
        labelled = raking.labelled(rows, topic="'any'" if rows is docs else raking.TOPIC)
        for most in (200_000, 0):
            monkeypatch.setattr(raking, "ONE_TASK", most)
            out.append({(r["_source"], r["_lang"], r["_topic"]): (r["weight"], r["probability"]) for r in raking.fit_whole(labelled, **options).collect()})
        assert set(out[0]) == set(out[1]) and all(out[0][k] == pytest.approx(out[1][k], rel=1e-9, abs=1e-9) for k in out[0])
        assert rows is not docs or {p == 1 for _, p in out[0].values()} == {True, False}


def test_raking_budget_search():
    for edge in (0.79, 0.6, 0.4):
        tried = []
        got = raking.largest(lambda b, nearest: tried.append(b) or (b if b <= edge or nearest else None), 0.75, 0.8)
        assert got == (0.75 if edge > 0.75 else pytest.approx(edge, abs=1e-4) if edge > 0.5 else 0.5) and len(tried) <= 14


def test_raking_zero_shares_leave_the_rest_whole():
    """Where a share of 0 empties a cell and the others of its group can't reach the target, they are taken whole."""
    tokens = np.array([10.0, 10.0, 40.0])
    p = raking.bounded(tokens, [np.array([0, 0, 1]), np.array([0, 1, 1])], [np.array([0.5, 0.5]), np.array([0.0, 1.0])], 0.8, rounds=1)
    assert p[0] == 0 and p[1] > 0 and p[2] > 0
    p = raking.bounded(tokens, [np.array([0, 1, 1]), np.array([0, 0, 1])], [np.array([0.0, 1.0]), np.array([0.5, 0.5])], 0.8, rounds=1)
    assert p.tolist() == pytest.approx([0, 1, 0.375])


def test_raking_odd_rows(odd, empty):
    out = raking.mixed(odd).collect()
    assert len(out) == odd.count() and all(r["selected"] for r in out if r["text"] in (None, ""))
    assert raking.sample(odd).columns == odd.columns and raking.mixed(empty).count() == 0


def test_pipeline_stages(spark, sf, docs):
    """Each stage on the one before: what it may drop, and what brute force says must go."""
    scratch = Scratch(spark, "stages")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.table(stage(spark, now, sf), name)
        if name != "encoding":
            assert out.columns == docs.columns
        before, after = {r["doc_id"]: r for r in now.collect()}, {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "near_copies":
            want = plain_components([(i, r["text"]) for i, r in before.items()], 5)
            assert set(after) == set(want.values())
        if name == "personal_data":
            assert set(after) == set(before) and not any(re.search(r"[\w.]+@[\w-]+\.\w", r["text"]) for r in after.values())
        if name == "toxicity":
            plain = plain_toxicity({i: r["text"] for i, r in before.items()}, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()})
            assert set(after) == {i for i, (score, _) in plain.items() if score < toxicity.TOXIC_FROM}
        if name == "mixing":
            cells = collections.Counter((r["source"], r["lang"]) for r in before.values())
            assert set(after) < set(before) and len({(r["source"], r["lang"]) for r in after.values()}) > 0.7 * len(cells)
        if name == "encoding":
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(queries.tokenizer_path())
            assert set(after) == set(before) and all(after[i]["token_ids"] == tok.encode(r["text"], add_special_tokens=False).ids for i, r in before.items())
        now = out
    assert set(now.columns) == {"doc_id", "lang", "source", "token_ids", "n_tokens", "decoded_sha256"}


def test_pipeline_odd_rows(spark, odd, empty, sf):
    """Extra columns with clashing names pass through; rows are judged each; nothing but copies and sampled-out rows goes."""
    clash = odd.withColumns({"weight": F.lit(1.5), "probability": F.lit("p"), "_tokens": F.lit(7), "evidence": F.lit("e"), "_row": F.lit(0)})
    for rows in (clash, clash.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            got = out.collect()
            if name == "encoding":
                assert len(got) == rows.count() and set(out.columns) == {"doc_id", "lang", "source", "token_ids", "n_tokens", "decoded_sha256"}
                assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (2, 3))
                break
            assert out.columns == clash.columns
            before = rows.collect()
            if name == "near_copies":  # ids 1, 5 and 5 have one text, and ids 2, 3 and 6 no word
                texts = [r["text"] for r in before if (r["text"] or "").strip()]
                assert len(got) == len(before) - len(texts) + len(set(texts)) and {r["text"] for r in got} == {r["text"] for r in before}
            elif name == "personal_data":
                assert len(got) == len(before)
                assert {r["text"] for r in got if r["doc_id"] == 8} <= {"mail [EMAIL], call [PHONE], card [CARD], host 10.0.0.256 or [IP]"}
            elif name == "toxicity":
                assert {2, 3, 6} <= {r["doc_id"] for r in got} or not before
            assert all((r["score"], r["weight"], r["probability"], r["_tokens"], r["evidence"], r["_key"], r["_row"]) == (0.5, 1.5, "p", 7, "e", "k", 0) for r in got)
            rows = out


def test_one_of_each_judges_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (3, text), (3, text), (3, "another text of quite different words than the first"), (None, "a lone text without any id of its own here"), (2, ""), (2, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, _row string")
    got = minhash.one_of_each(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["_row"]) for r in got) == sorted([(3, text, "x"), (3, rows[4][1], "x"), (0, rows[5][1], "x"), (2, "", "x"), (2, "", "x")])
    assert minhash.one_of_each(df.limit(0)).count() == 0


def test_near_duplicates_null_ids(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (1, text), (None, "a lone text without any id")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect()) == [(0, 0, True), (0, 1, False), (1, 1, True)]


def test_scratch_folder_and_session_settings(spark, sf, docs):
    """No operator changes the session's settings; without a shared folder a local session gets its own and a cluster an error."""
    before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
    for name in ("op3_toxicity", "op8_langid", "op10_raking"):
        queries.QUERIES[name](spark, sf).count()
    assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        applicationId = "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    Context.master = "local[2]"
    assert shared.scratch_root(Session()).startswith("file:")
    for Context.master in ("local-cluster[2,1,1024]", "spark://h:7077", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.scratch_root(Session())
