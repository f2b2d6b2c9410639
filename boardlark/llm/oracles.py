"""SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from boardlark.llm import divergence, hash_tree, raking

_SPACE = r"[\x20\x09-\x0D]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}+'), lambda w: w <> '')"


def near_duplicates(words: int, similar: int) -> str:
    """All pairs of documents with a common shingle, confirmed, and what is reachable over them."""
    shingle = " || ' ' || ".join(f"words[i + {k}]" for k in range(words))
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOWER)} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(words) >= {words} THEN list_transform(range(1, len(words) - {words - 2}), lambda i: {shingle}) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= {similar} * (nx.n + ny.n - k)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM reach r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, least(min(y), x) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _crc32() -> str:
    """The checksum of a text's bytes: the table of the reflected polynomial from its rule, then a fold over the bytes."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
    digit = lambda k: f"(strpos('0123456789ABCDEF', p[{k}]) - 1)"
    octets = f"list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: CAST({digit(1)} * 16 + {digit(2)} AS BIGINT))"
    return f"""crc_table AS (SELECT {table} AS tbl), crc AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM documents, crc_table)"""


def _hash(key: str, digits: int = 13) -> str:
    return f"CAST('0x' || substr(md5({key}), 1, {digits}) AS BIGINT)"


def _descend(tree: hash_tree.Node, key: str) -> str:
    """The shard of a key, as nested choices."""
    if tree.shard >= 0:
        return str(tree.shard)
    if len(tree.children) == 1:
        return _descend(tree.children[0], key)
    draw = [f"-ln((CAST({_hash(f"{key} || ':{c.name}'")} AS DOUBLE) + 1) / {2**52 + 1}.0) / {c.total!r}" for c in tree.children]
    least = f"list_position([{', '.join(draw)}], list_min([{', '.join(draw)}]))"
    return f"CASE {least} {' '.join(f'WHEN {i} THEN {_descend(c, key)}' for i, c in enumerate(tree.children, 1))} END"


def sharding(tree: hash_tree.Node, grown: hash_tree.Node, blocks: int = 1024) -> str:
    key = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return f"""WITH {_crc32()}, d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, text_crc32, {_descend(tree, key)} AS shard, {_descend(grown, key)} AS grown_shard,
{_hash(f"{key} || ':block'", 6)} % {blocks} AS block FROM documents JOIN crc USING (doc_id))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM d"""


def _distance(p: str, q: str) -> str:
    share = lambda x: f"list_transform({x}, lambda v: v / nullif(CAST(list_sum({x}) AS DOUBLE), 0))"
    pairs = f"list_zip({share(p)}, {share(q)})"
    part = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform({pairs}, lambda z: {part('z[1]', 'z[2]')} + {part('z[2]', 'z[1]')})) / 2)) END"


def quality() -> str:
    d, q = divergence, lambda words: ", ".join(f"'{w}'" for w in words)
    listed = {lang: w.split() for lang, w in d.COMMON.items()}
    every = sorted({w for ws in listed.values() for w in ws})
    steps = [("t0", "t", r"\p{Ll}+"), ("t1", "t0", f"{_SPACE}+"), ("t2", "t1", r"\p{Lu}+"), ("t3", "t2", r"\p{Nd}+"), ("t4", "t3", r"""[.,;:!?''"()-]+"""), ("t5", "t4", r"[\p{Lo}\p{Lm}\p{M}]+")]
    chain = ", ".join(f"r{k} AS (SELECT *, regexp_replace({before}, '{pattern}', '', 'g') AS {to} FROM {'base' if k == 0 else f'r{k - 1}'})" for k, (to, before, pattern) in enumerate(steps))
    hits = " ".join(f"WHEN '{lang}' THEN list_transform([{q(ws)}], lambda r: len(list_filter(met, lambda m: m = r)))" for lang, ws in listed.items())
    return rf"""WITH base AS (SELECT doc_id, coalesce(lang, '*') AS ref, coalesce(text, '') AS t FROM documents), {chain},
f AS (SELECT doc_id, ref, {_words('t')} AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  length(t2) - length(regexp_replace(t2, '[#*$%&|<>]', '', 'g')) AS n_symbols, [length(t) - length(t0), length(t0) - length(t1), length(t1) - length(t2), length(t2) - length(t3), length(t3) - length(t4), length(t4) - length(t5), length(t5)] AS classes FROM r5),
g AS (SELECT doc_id, ref, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, classes, words,
  list_filter(list_transform(words, lambda w: lower(trim(w, '.,;:!?'))), lambda w: w IN ({q(every)})) AS met FROM f),
win AS (SELECT doc_id, i, array_to_string(words[i:i + {d.WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - {d.WINDOW - 2})) AS i FROM g)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, sum(step) AS n_repeat_words FROM (SELECT doc_id, least({d.WINDOW}, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - {d.WINDOW})) AS step FROM twice) GROUP BY doc_id),
h AS (SELECT *, CASE ref {hits} END AS hit FROM g), k AS (SELECT *, CASE WHEN hit IS NOT NULL THEN list_append(hit, n_words - list_sum(hit)) END AS common FROM h),
rc AS (SELECT ref, list(s ORDER BY j) AS ref_classes FROM (SELECT ref, j, sum(v) AS s FROM (SELECT ref, unnest(classes) AS v, generate_subscripts(classes, 1) AS j FROM k) GROUP BY ref, j HAVING count(*) >= {d.REF_FROM}) GROUP BY ref),
pool AS (SELECT list(s ORDER BY j) AS ref_classes FROM (SELECT j, sum(v) AS s FROM (SELECT unnest(classes) AS v, generate_subscripts(classes, 1) AS j FROM k) GROUP BY j)),
rw AS (SELECT ref, list(s ORDER BY j) AS ref_common FROM (SELECT ref, j, sum(v) AS s FROM (SELECT ref, unnest(common) AS v, generate_subscripts(common, 1) AS j FROM k) GROUP BY ref, j HAVING count(*) >= {d.REF_FROM}) GROUP BY ref),
m AS (SELECT k.*, CASE WHEN k.ref = '*' THEN pool.ref_classes ELSE rc.ref_classes END AS ref_classes, ref_common, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM k LEFT JOIN rc ON rc.ref = k.ref LEFT JOIN rw ON rw.ref = k.ref LEFT JOIN rep ON rep.doc_id = k.doc_id, pool),
z AS (SELECT *, round({_distance('classes', 'ref_classes')}, 9) AS class_distance, round({_distance('common', 'ref_common')}, 9) AS word_distance, n_words < {d.LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * d.REPEAT_MOST)} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed,
NOT base_failed AND NOT coalesce((list_sum(classes) >= {d.CHARS_FROM} AND class_distance > {d.CLASSES_MOST}) OR (n_words >= {d.WORDS_FROM} AND word_distance > {d.WORDS_MOST}), FALSE) AS kept FROM z"""


def mixing() -> str:
    r = raking
    topic = " ".join(r.TOPIC.split())
    cells = ", ".join(r.DIMENSIONS)
    steps, last = [], "c1"
    for k in range(r.ROUNDS):
        for d in r.DIMENSIONS:
            name = f"s{k}{d}"
            now = f"sum(weight) OVER (PARTITION BY {d})"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN {now} > 0 THEN weight * (to_{d} * total / {now}) ELSE 0 END AS weight) FROM {last})")
            last = name
    targets = ", ".join(f"(SELECT pow(sum(x.tokens), {r.POWER[d]}) / (SELECT sum(pow(s, {r.POWER[d]})) FROM (SELECT sum(tokens) AS s FROM c0 GROUP BY {d})) FROM c0 x WHERE x.{d} = c0.{d}) AS to_{d}" for d in r.DIMENSIONS)
    order = f"factor DESC NULLS LAST, {cells}"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce({topic}, '') AS topic, CAST(ceil(strlen(coalesce(text, '')) / 4) AS BIGINT) AS tokens FROM documents),
c0 AS (SELECT {cells}, sum(tokens) AS tokens FROM d GROUP BY ALL), c1 AS (SELECT *, {targets}, CAST(sum(tokens) OVER () AS DOUBLE) AS total, CAST(tokens AS DOUBLE) AS weight FROM c0),
{', '.join(steps)}, f AS (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens END AS factor FROM {last}),
g AS (SELECT *, greatest(0, {r.BUDGET} * total - coalesce(sum(tokens) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM f),
s AS (SELECT max_by(scale, factor) AS scale FROM g WHERE scale * factor <= 1),
p AS (SELECT {cells}, weight, CASE WHEN factor IS NULL THEN 1 ELSE least(1, coalesce(s.scale, 1e300) * factor) END AS probability FROM g, s)
SELECT doc_id, source, lang, topic, d.tokens, round(weight, 3) AS cell_weight, round(probability, 9) AS probability, {_hash(f"coalesce(CAST(doc_id AS VARCHAR), '') || ':{r.SEED}'")} / {float(2**52)!r} < probability AS selected FROM d JOIN p USING ({cells})"""
