"""Byte-pair encoding by a tokenization automaton, and decoding by its arc labels.

The merges of a public vocabulary are compiled, in order, into a deterministic automaton over tokens: each merge (u, v) -> w is a gadget that
redirects the u-arcs to a copy of their target that lacks the v-arc, and lays a w-arc beside every u-arc, to where u then v led.  A token
sequence is a path from the start state if and only if it is the encoding of its bytes.  As all arcs of one label share their target, the
automaton has one start state and at most one further state for each merge; the rows of its transition table are filled as they are met.

Encoding: a text is pre-split as the vocabulary's file says; over the bytes of a word, a trie with failure links lists the tokens that end at
each byte, longest first, and the automaton's table tells the one that may follow the path so far.  Time is linear in the word's length.

Cases: null text counts as empty; empty text has no ids; a special token's string in a text becomes that token; ids outside the vocabulary
decode to nothing; bytes that aren't UTF-8 after decoding become U+FFFD; repeated rows are encoded each; very long texts are encoded whole, one at a time; an
empty table gives no rows; an added column takes the place of an equally named one; a vocabulary whose file asks for a normaliser or another splitting is refused.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from boardlark.llm.shared import arrow_pass, lists

#: White space as the Unicode property has it; Python's own notion also holds U+001C to U+001F.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: How byte-level vocabularies split a text before the merges.
PRE_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same for texts of code points below 256, where the classes can be written out; the plain engine is twice as fast on it.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r\x20\x85\xa0"
NARROW_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words that a worker's cache holds before it starts anew.
CACHE_WORDS = 200_000
#: Longer words aren't kept in the cache.
CACHE_BYTES = 64
#: Entries of the automaton's table that a worker keeps before it starts anew.
CACHE_PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    rest = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """States are numbered from 0, the start; `target[t]` is where every t-arc leads.  `born` and `made` are the merge steps at which a token
    or state came to be, -1 for those of the bytes."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = tokens
        self.parent, self.lacks, self.made = [0], [-1], [-1]
        self.target: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self._row: dict[int, bool] = {}
        for t, b in tokens.items():
            if len(b) == 1:
                self.target[t], self.born[t] = 0, -1
        for step, (u, v, w) in enumerate(merges):
            self._gadget(step, u, v, w)
        self._trie()
        self.ready()

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        if u not in self.target or v not in self.target or w in self.target:
            return
        at = self.target[u]
        if not self.arc(at, v):  # an earlier merge always takes one of the two away
            return
        self.target[w], self.born[w], self.left[w] = self.target[v], step, u
        self.parent.append(at)
        self.lacks.append(v)
        self.made.append(step)
        self.target[u] = len(self.parent) - 1

    def arc(self, state: int, token: int) -> bool:
        """Whether the state has an arc with this label."""
        key = state << 32 | token
        known = self._row.get(key)
        if known is not None:
            return known
        s, t = state, token
        while True:
            if t not in self.born:
                found = False
                break
            if self.made[s] > self.born[t]:  # older than the state: as in the state it was copied from
                if self.lacks[s] == t:
                    found = False
                    break
                s = self.parent[s]
            elif self.born[t] < 0:
                found = s == 0 or self.lacks[s] != t
                break
            elif self.lacks[s] == t:
                found = False
                break
            else:  # laid beside the arcs of its left part
                t = self.left[t]
        self._row[key] = found
        return found

    def _trie(self) -> None:
        step: dict[int, int] = {}
        ends, fail = [-1], [0]
        by_depth: list[list[tuple[int, int, int]]] = []
        for t in self.born:
            node = 0
            for depth, b in enumerate(self.labels[t]):
                key = node << 8 | b
                nxt = step.get(key)
                if nxt is None:
                    nxt = step[key] = len(ends)
                    ends.append(-1)
                    fail.append(0)
                    while len(by_depth) <= depth:
                        by_depth.append([])
                    by_depth[depth].append((node, b, nxt))
                node = nxt
            ends[node] = t
        shorter = [0] * len(ends)
        for depth, level in enumerate(by_depth):
            for node, b, nxt in level:
                if depth:
                    f = fail[node]
                    while f and f << 8 | b not in step:
                        f = fail[f]
                    fail[nxt] = step.get(f << 8 | b, 0)
                shorter[nxt] = fail[nxt] if ends[fail[nxt]] >= 0 else shorter[fail[nxt]]
        #: For each node, the tokens that end there, longest first, each with its length.
        self.outs: list[tuple[tuple[int, int], ...]] = []
        for node in range(len(ends)):
            own = ((ends[node], len(self.labels[ends[node]])),) if ends[node] >= 0 else ()
            self.outs.append(own)
        for level in by_depth:
            for _, _, node in level:
                self.outs[node] += self.outs[shorter[node]] if shorter[node] else ()
        self.step, self.fail = step, fail

    def ready(self) -> None:
        """Empties the tables that fill as they are used."""
        self.moves = dict(self.step)  # node and byte to node, failures resolved
        self.pairs: dict[int, bool] = {}  # last token and token to whether the arc is there; the start counts as token 2**20
        self._row = {}

    def walk(self, word: bytes) -> list[int]:
        """The ids of one pre-split word.  The encoding of a prefix ends in one certain token, the one among those that end there which has an arc
        after the encoding of what comes before it; of short words only the prefixes that the last token leads back to are looked at."""
        moves, node, nodes = self.moves, 0, []
        for b in word:
            key = node << 8 | b
            node = moves.get(key, -1)
            if node < 0:
                node = self._move(key)
            nodes.append(node)
        n = len(word)
        last = [-1] * (n + 1)
        last[0] = 1 << 20
        if n <= CACHE_BYTES:
            self._last(n, nodes, last)
        else:
            for i in range(1, n + 1):
                self._last(i, nodes, last)
        ids, labels = [], self.labels
        while n:
            t = last[n]
            ids.append(t)
            n -= len(labels[t])
        ids.reverse()
        return ids

    def _last(self, i: int, nodes: list[int], last: list[int]) -> int:
        """The last token of the encoding of the first i bytes."""
        pairs = self.pairs
        for t, size in self.outs[nodes[i - 1]]:
            before = last[i - size]
            if before < 0:
                before = self._last(i - size, nodes, last)
            key = before << 20 | t
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.arc(0 if i == size else self.target[before], t)
            if ok:
                last[i] = t
                return t
        raise ValueError("the vocabulary lacks a byte")

    def _move(self, key: int) -> int:
        node, b = key >> 8, key & 255
        while node and node << 8 | b not in self.step:
            node = self.fail[node]
        node = self.moves[key] = self.step.get(node << 8 | b, 0)
        return node


class _Words(dict):
    def __init__(self, automaton: MergeAutomaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.automaton.walk(word.encode()))
        if len(self.automaton.pairs) >= CACHE_PAIRS:
            self.automaton.ready()
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


def _refuse_others(spec: dict) -> None:
    """Raises ValueError for settings that would give other ids than this encoder's."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [f"model {k}" for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += ["model type"] * (model.get("type") not in (None, "BPE")) + ["normalizer"] * bool(spec.get("normalizer"))
    odd += ["pre_tokenizer"] * (split.get("type") != "ByteLevel" or bool(split.get("add_prefix_space")) or split.get("use_regex") is False)
    odd += ["decoder"] * ((spec.get("decoder") or {}).get("type") != "ByteLevel")
    odd += sorted({f"added token's {k}" for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip") if x.get(k)})
    if odd:
        raise ValueError(f"this vocabulary needs more than byte-level merges: {', '.join(odd)}")


class Tokenizer:
    """A byte-level BPE vocabulary in the JSON form of public tokenizers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _refuse_others(spec)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {s: i for s, i in model["vocab"].items() if s not in self.special}
        tokens = {i: to_bytes(s) for s, i in vocab.items()}
        merges = []
        for m in model["merges"]:
            u, v = m if isinstance(m, list) else m.split(" ")
            merges.append((vocab[u], vocab[v], vocab[u + v]))
        self.automaton = MergeAutomaton(tokens, merges)
        self.decode_table = tokens | {i: s.encode() for s, i in self.special.items()}
        self._ready()

    def _ready(self) -> None:
        self._wide, self._narrow, self._is_narrow = regex.compile(PRE_SPLIT).findall, re.compile(NARROW_SPLIT).findall, re.compile("[\x00-\xff]*").fullmatch
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._words = _Words(self.automaton)
        self.automaton.ready()

    def __getstate__(self) -> dict:
        return {"automaton": self.automaton, "special": self.special, "decode_table": self.decode_table}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()

    def _split(self, text: str) -> list[str]:
        return self._narrow(text) if self._is_narrow(text) else self._wide(text)

    def encode(self, text: str) -> list[int]:
        words = self._words
        if self._special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(words.__getitem__, self._split(text))))
        ids: list[int] = []
        for part in self._special.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids.extend(chain.from_iterable(map(words.__getitem__, self._split(part))))
        return ids

    def decode_bytes(self, ids) -> bytes:
        get = self.decode_table.get
        return b"".join([get(i, b"") for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def shared_tokenizer(spark, path: str):
    """The compiled vocabulary as a broadcast; its size is that of the vocabulary, whatever the input."""
    return spark.sparkContext.broadcast(Tokenizer(path))


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, ids: str = "token_ids") -> DataFrame:
    """The kept columns (all by default) and the array of each text's token ids."""
    model = shared_tokenizer(df.sparkSession, tokenizer_path)

    def make():
        tok = model.value

        def work(batch: pa.RecordBatch) -> dict:
            out, sizes = [], []
            for t in batch.column(text).to_pylist():
                got = tok.encode(t or "")
                sizes.append(len(got))
                out.append(np.array(got, np.int32))
            return {ids: lists(np.concatenate(out), sizes, pa.int32())}

        return work

    return arrow_pass(df, text, df.columns if keep is None else keep, StructType([StructField(ids, ArrayType(IntegerType()))]), make)


def decode(df: DataFrame, tokenizer_path: str, ids: str = "token_ids", keep: list[str] | None = None, text: str = "decoded") -> DataFrame:
    """The kept columns and the text that the ids stand for, special tokens included."""
    model = shared_tokenizer(df.sparkSession, tokenizer_path)

    def make():
        tok = model.value

        def work(batch: pa.RecordBatch) -> dict:
            return {text: pa.array([tok.decode([i for i in x or () if i is not None]) for x in batch.column(ids).to_pylist()], pa.string())}

        return work

    keep = df.columns if keep is None else keep
    return arrow_pass(df.select(*dict.fromkeys([*keep, ids])), None, [*dict.fromkeys([*keep, ids])], StructType([StructField(text, StringType())]), make)


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """encode() and decode() in one pass: the kept columns, token_ids and decoded."""
    model = shared_tokenizer(df.sparkSession, tokenizer_path)

    def make():
        tok = model.value

        def work(batch: pa.RecordBatch) -> dict:
            flat, sizes, texts = [], [], []
            for t in batch.column(text).to_pylist():
                got = tok.encode(t or "")
                sizes.append(len(got))
                flat.append(np.array(got, np.int32))
                texts.append(tok.decode(got))
            return {"token_ids": lists(np.concatenate(flat), sizes, pa.int32()), "decoded": pa.array(texts, pa.string())}

        return work

    added = StructType([StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return arrow_pass(df, text, df.columns if keep is None else keep, added, make)


def digests(df: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside doc_id, from round_trip()."""
    return df.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
