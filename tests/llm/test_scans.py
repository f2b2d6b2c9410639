"""Operators that judge each text by itself: personal data, tokens, media, language, quality rules, sharding."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boardlark.llm import bpe, divergence, hash_tree, jpeg, langid, pii, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    def fine(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1]))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return sorted(((k, m.start(), m.end()) for k, r in BASE.items() for m in r.finditer(text) if fine(k, m[0])), key=lambda x: (x[1], list(BASE).index(x[0])))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- 4(é%0\n", max_size=60))
def test_pii_equals_plain_expressions(text):
    assert [x[:3] for x in pii.find(text) if x[0] in pii.BASE_KINDS] == plain_spans(text)


def test_pii_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [x[0] for x in pii.find(t)]
    assert "iban" in kinds("account GB82 WEST 1234 5698 7654 32 please") and "iban" not in kinds("account GB83 WEST 1234 5698 7654 32")
    for t in ("BE68 5390 0754 7034 EUR", "pay GB82WEST12345698765432 FROM HIM", "NO93 8601 1117 947"):
        assert kinds("iban " + t) == ["iban"], t
    assert "iban" not in kinds("iban BE68 5390 0754 703") and "iban" not in kinds("iban BE68 5390 0754 70345")
    assert kinds("my social security number 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    near, far, against = (pii.score(t, "card", t.index("4"), len(t)) for t in ("card 4111", "xyz 4111", "order 4111"))
    assert against < far < near
    assert pii.masked("x a@b.co y", pii.find("x a@b.co y")) == "x [EMAIL] y"


def test_pii_time_is_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@b." * 70_000, "@" * 300_000):
        pii.find(text)


def test_pii_query_over_odd_rows(odd, empty):
    rows = {(r["doc_id"], r["n_email"]): r for r in pii.digests(pii.detect(odd, keep=["doc_id"])).collect()}
    r = rows[8, 1]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert rows[3, 0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[3, 0]["spans"] == ""
    assert pii.digests(pii.detect(empty, keep=["doc_id"])).count() == 0
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where("text IS NULL").count() == 1


def test_pii_query_equals_plain(spark, sf, docs):
    want = {r["doc_id"]: plain_spans(r["text"]) for r in docs.collect()}
    for r in queries.op1_pii(spark, sf).collect():
        spans = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def tokenizers_pair():
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(queries.tokenizer_path())
    theirs.no_truncation()
    theirs.no_padding()
    return bpe.Tokenizer(queries.tokenizer_path()), theirs


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab 'st\n\r\t!?é1", max_size=80)))
def test_bpe_equals_the_library(tokenizers_pair, text):
    own, theirs = tokenizers_pair
    ids = own.encode(text)
    assert ids == theirs.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_long_and_special(tokenizers_pair):
    own, theirs = tokenizers_pair
    for text in ("aaaa" * 5000, "<|endoftext|>a<|endoftext|>", "the" * 3000, "\x1c\x1d x\x85y", ""):
        assert own.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    assert own.decode([10**6]) == ""


def test_merge_automaton_small():
    # a b -> ab, ab a -> aba, a a -> aa: paths are exactly the encodings.
    tokens = {0: b"a", 1: b"b", 2: b"ab", 3: b"aba", 4: b"aa"}
    merges = [(0, 1, 2), (2, 0, 3), (0, 0, 4)]
    auto = bpe.MergeAutomaton(tokens, merges)

    def encode(word):
        ids = [0 if c == 97 else 1 for c in word]
        for u, v, w in merges:
            k = 0
            while k + 1 < len(ids):
                if (ids[k], ids[k + 1]) == (u, v):
                    ids[k : k + 2] = [w]
                k += 1
        return ids

    for n in range(1, 11):
        for bits in range(2**n):
            word = bytes(97 + (bits >> k & 1) for k in range(n))
            assert auto.walk(word) == encode(word), word


def test_bpe_query(spark, sf, docs, odd, empty, tokenizers_pair):
    _, theirs = tokenizers_pair
    want = {r["doc_id"]: theirs.encode(r["text"], add_special_tokens=False).ids for r in docs.collect()}
    for r in queries.op9_bpe(spark, sf).collect():
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    path = queries.tokenizer_path()
    trip = bpe.decode(bpe.encode(odd, path), path)
    assert trip.where("coalesce(text, '') <> decoded").count() == 0 and trip.count() == odd.count()
    assert bpe.digests(bpe.round_trip(empty, path, keep=["doc_id"])).count() == 0
    assert bpe.digests(bpe.round_trip(odd, path, keep=["doc_id"])).where("n_tokens = 0 AND doc_id IN (2, 3)").count() == 2


def payload(data):
    p = np.full(max(576, -(-len(data) // 576) * 576), 255, np.uint8)
    p[: len(data)] = np.frombuffer(data, np.uint8)
    return p


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=2000), min_size=1, max_size=4))
def test_jpeg_round_trip(parts):
    payloads = [payload(p) for p in parts]
    for p, images in zip(payloads, jpeg.decode_many(jpeg.encode_many(payloads))):
        assert (jpeg.payload_of(images) == p).all()


def test_jpeg_readers_agree_and_wide_images():
    rng = np.random.default_rng(1)
    for n in (576, 5760, 300_000):
        p = payload(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        file = jpeg.encode(p)
        image = jpeg.Image(file)
        thumb = jpeg.decode_many([file])[0][0][1]
        assert (jpeg.payload_of([(image, thumb)]) == p).all()
        if n < 10_000:
            assert (jpeg._slow(file, image) + 128 == thumb).all()
    with pytest.raises(ValueError):
        jpeg.Image(b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00")


def test_jpeg_reads_ac_coefficients_and_several_components():
    """A hand-made 16 x 8 image of three components with AC coefficients, without restarts."""
    dc, ac = {0: 2, 1: 2, 2: 2}, {0: 1, 0x11: 2}
    dcc, acc = jpeg.codes(dc), jpeg.codes(ac)
    bits = ""

    def put(pair):
        return format(pair[0], f"0{pair[1]}b")

    for y, cb, cr in ((1, 0, 0), (3, 1, -1)):
        for d in (y, cb, cr) if (y, cb, cr) == (1, 0, 0) else (2, 1, -1):
            size = abs(d).bit_length()
            bits += put(dcc[size]) + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
            bits += put(acc[0x11]) + "1" + put(acc[0])
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes([8] + [1] * 63) + b"\xff\xc0\x00\x11\x08\x00\x08\x00\x10\x03" + b"".join(bytes([k, 0x11, 0]) for k in (1, 2, 3))
    file = head + jpeg._dht(0, dc) + jpeg._dht(16, ac) + b"\xff\xda\x00\x0c\x03" + b"".join(bytes([k, 0]) for k in (1, 2, 3)) + b"\x00\x3f\x00" + scan + b"\xff\xd9"
    (image, thumb), = jpeg.decode_many([file])[0]
    assert (image.width, image.height) == (16, 8) and thumb.tolist() == [[129, 131]]


def test_jpeg_query(spark, sf, docs, odd, empty):
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    files = {}
    for r in queries.op7_jpeg(spark, sf).collect():
        t = texts[r["doc_id"]]
        p = payload(t).tobytes()
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert files.setdefault(t, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
        # The feature from the definition: a byte a block, 24 blocks a row, the thumbnail is the payload itself.
        width, height = re.fullmatch(r"(\d+)x(\d+);.*", r["feature"]).groups()
        assert int(width) * int(height) == 64 * len(p)
    out = jpeg.store(odd, keep=["doc_id", "lang"])
    assert out.where("length(media) = media_bytes AND sha2(media, 256) = media_sha256").count() == odd.count()
    assert out.where("doc_id IN (2, 3) AND payload_bytes = 576").count() == 2 and jpeg.store(empty).count() == 0


def test_langid(spark, sf, docs, odd, empty):
    rows = queries.op8_langid(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)
    model = langid.collect_profiles(langid.learn(odd))
    out = {r["doc_id"]: r for r in langid.identify(odd, model, keep=["doc_id", "lang", "score"]).collect()}
    assert [out[k]["lang_pred"] for k in (2, 3, 6)] == ["und"] * 3 and out[9]["lang_pred"] == "ja" and all(0 <= r["score"] <= 1 for r in out.values())
    none = langid.collect_profiles(langid.learn(empty))
    assert langid.identify(empty, none).count() == 0 and langid.identify(odd, none).where("lang_pred <> 'und'").count() == 0


def plain_ranks(texts, length=400):
    """The most frequent n-grams of texts, as strings; a blank sorts below letters and shorter n-grams below longer ones."""
    n = collections.Counter()
    for t in texts:
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
        for w in letters.split():
            padded = f" {w} "
            n.update(w)
            n.update(padded[k : k + 2] for k in range(len(padded) - 1))
            n.update(padded[k : k + 3] for k in range(len(padded) - 2))
        # Between two words stands one blank, which pairs with both.
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0].replace(" ", "\x01")))][:length]


def test_langid_equals_plain_counts_in_all_scripts(spark):
    """Profiles and predictions beside a plain computation, over Latin, Cyrillic, Greek, Hangul and Han."""
    rng = np.random.default_rng(8)
    words = {
        "de": "der die und für über straße nicht größe wäre schön", "fr": "les été où déjà garçon même naïve cœur avec vous", "ru": "и в не на что быть который этот человек ёлка мы", "uk": "і в не на що бути який цей людина їжак ґанок",
        "el": "και το να του η με που από για ότι ένας", "ko": "그리고 나는 학교 에서 공부 한다 오늘 날씨 가 좋다", "zh": "我 是 在 学校 学习 今天 天气 很好 他们 我们",
    }
    rows = [(k, " ".join(rng.choice(words[lang].split(), 30)) + ("!" if k % 3 else "."), lang) for k, lang in enumerate(sorted(words) * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = rows[:70]
    profiles = {lang: {g: r for r, g in enumerate(plain_ranks([t for _, t, x in known if x == lang]))} for lang in words}
    learned = langid.learn(df, usable=F.col("doc_id") < 70)

    def string(g):
        out = ""
        while g:
            out, g = chr(g & 0x1FFFFF) + out, g >> 21
        return out.replace("\x01", " ")

    got = collections.defaultdict(dict)
    for r in learned.collect():
        got[r["lang"]][string(r["gram"])] = r["rank"]
    assert dict(got) == profiles
    for r in langid.identify(df, langid.collect_profiles(learned)).collect():
        own = plain_ranks([r["text"]])
        d = {lang: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)) for lang, p in profiles.items()}
        first, second = sorted(d.values())[:2]
        assert d[r["lang_pred"]] == first and r["lang_pred"] == min(x for x in d if d[x] == first) and r["score"] == pytest.approx(1 - first / second) and r["lang_pred"] == r["lang"]


def test_divergence(spark, sf, docs, odd, empty):
    for r in queries.op6_divergence(spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = WORD.findall(r["text"])
        windows = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        seen, copies = set(), 0
        for line in r["text"].split("\n"):
            if WORD.search(line):
                copies += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"])), copies, len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    out = divergence.judge(odd).collect()
    assert len(out) == odd.count() and all(r["kept"] is not None for r in out) and divergence.judge(empty).count() == 0
    assert {r["base_failed"] for r in out if r["doc_id"] in (2, 3, 6, 7)} == {True}


def test_divergence_judges_every_language_by_its_own(spark):
    """Prose of a language without a list of words is kept beside its like; below REF_FROM documents a language rejects nothing; junk goes."""
    prose = lambda w: " ".join(f"{w}{k}る{chr(0x3041 + k % 80)}" for k in range(60)) + "。"
    rows = [(k, prose("日本語の文章" + chr(0x4E00 + k)), "ja") for k in range(30)] + [(100 + k, " ".join(f"word{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(90)), "en") for k in range(26)]
    rows += [(200, prose("한국어"), "ko"), (201, " ".join(f"#{j}$%&|{j * 7}" for j in range(90)), "ja")]
    out = {r["doc_id"]: r for r in divergence.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(out[k]["kept"] for k in (*range(30), *range(100, 126), 200)) and not out[201]["kept"] and out[200]["class_distance"] is None and out[0]["word_distance"] is None


def test_divergence_distance(spark):
    row = spark.createDataFrame([([1, 0], [0, 1], [2, 2])], "p array<bigint>, q array<bigint>, r array<bigint>").select(divergence.distance("p", "q").alias("far"), divergence.distance("r", "r").alias("same")).first()
    assert row["far"] == pytest.approx(1.0) and row["same"] == pytest.approx(0.0)


def test_hash_tree(spark, sf, docs, odd, empty):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = queries.op5_hash_tree(spark, sf).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"key"}
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t)) and r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    out = hash_tree.assign(odd, queries.TREE).collect()
    assert len(out) == odd.count() and all(r["shard"] is not None and r["slot"] is not None for r in out)
    assert hash_tree.assign(empty, queries.TREE).count() == 0


def test_hash_tree_weights(spark):
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    N = hash_tree.Node
    tree = N("root", children=(N("a", children=(N("s0", 3.0, 0), N("s1", 1.0, 1))), N("b", children=(N("s2", 4.0, 2), N("s3", 0.0, 3)))))
    heavier = N("root", children=(N("a", children=(N("s0", 3.0, 0), N("s1", 2.0, 1))), N("b", children=(N("s2", 4.0, 2), N("s3", 0.0, 3)))))
    counts = {r["shard"]: r["count"] for r in hash_tree.assign(ids, tree).groupBy("shard").count().collect()}
    assert 3 not in counts and abs(counts[0] - 7500) < 400 and abs(counts[1] - 2500) < 300 and abs(counts[2] - 10_000) < 450
    moved = hash_tree.assign(ids, tree, heavier).where("shard <> grown_shard").groupBy("shard", "grown_shard").count().collect()
    assert {(r["shard"], r["grown_shard"]) for r in moved} <= {(2, 0), (2, 1), (0, 1)}  # only into the subtree that grew
