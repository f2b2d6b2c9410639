"""Quality rules by distribution divergence.

A document's histogram of character classes, and its histogram of the common words of its language, are compared to the language's reference by the
Jensen-Shannon distance (base 2, so 0 to 1).  The references are the totals over all documents of the language, whichever it is; a null language is compared
to the total over all documents.  Common words are listed for some languages; others are judged by character classes only.  Guards: a language's
reference counts from REF_FROM documents on, the classes from CHARS_FROM characters on, the words from WORDS_FROM words on, and a document below a guard isn't
rejected by that test.  Base rules reject documents that are very short or repeat themselves.

All of it is DataFrame expressions.  The counts are written to the shared folder, so texts are read once; one row for each language is joined, by broadcast
only where Spark finds that table small.

Cases: null and empty texts have no words, so the base rules reject them; very long texts are counted whole; repeated rows are judged each by itself; a language
named like POOLED is compared like null; extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlark.llm.shared import Scratch

#: The most common short words of each language.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by this are at from",
    "fr": "de la le et les des en un du une que pour est par dans qui avec pas sur au",
    "de": "der die und in den von zu das mit sich des auf für ist im nicht dem ein eine als",
    "es": "de la que el en y los se las del un por con no su una para es al lo",
}
POOLED = "*"
#: The space characters of the contract: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: Lengths from which a test counts, and distances above which it rejects.
CHARS_FROM, WORDS_FROM = 200, 100
#: Documents from which a language has a reference.
REF_FROM = 20
CLASSES_MOST, WORDS_MOST = 0.30, 0.30
#: Base rules: at least so many words, at most this share of them in repeated windows of WINDOW words.
LEAST_WORDS, REPEAT_MOST, WINDOW = 20, 0.30, 8


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """For every row: doc_id, ref (the language, POOLED for null), the base counts, and the two histograms `classes` (lower, space, upper, digits,
    punctuation, letters without case, rest) and `common` (the listed words, then all others)."""
    listed = {lang: words.split() for lang, words in COMMON.items()}
    every = sorted({w for words in listed.values() for w in words})
    ref_words = ", ".join(f"'{lang}', array({_quoted(words)})" for lang, words in listed.items())
    d = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col), F.lit(POOLED)).alias("ref"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    )
    d = d.withColumn("words", F.array_remove(F.split("t", f"{SPACE}+"), ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]")))
    # What is left after each class is taken out; every further step reads a much shorter text.
    for k, (before, pattern) in enumerate((("t", r"\p{Ll}+"), ("t0", f"{SPACE}+"), ("t1", r"\p{Lu}+"), ("t2", r"\p{Nd}+"), ("t3", r"""[.,;:!?'"()-]+"""), ("t4", r"[\p{Lo}\p{Lm}\p{M}]+"))):
        d = d.withColumn(f"t{k}", F.regexp_replace(before, pattern, ""))
    left = [F.length(c) for c in ("t", "t0", "t1", "t2", "t3", "t4", "t5")]
    d = d.select(
        "doc_id", "ref", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("t2") - F.length(F.regexp_replace("t2", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[(a - b).cast("long") for a, b in zip(left, left[1:])], left[-1].cast("long")).alias("classes"),
        F.expr(f"filter(transform(words, w -> lower(trim(BOTH '.,;:!?' FROM w))), w -> w IN ({_quoted(every)}))").alias("met"),
        F.expr(f"CASE WHEN size(words) > {WINDOW} THEN transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) END").alias("windows"),
    )
    d = d.withColumn("ordered", F.expr("CASE WHEN size(windows) > size(array_distinct(windows)) THEN array_sort(transform(windows, (h, i) -> struct(h, i))) END"))
    d = d.withColumn("again", F.expr("array_sort(transform(filter(transform(ordered, (s, k) -> struct(s.i AS i, get(ordered, k - 1).h <=> s.h OR get(ordered, k + 1).h <=> s.h AS twice)), s -> s.twice), s -> s.i))"))
    repeated = F.expr(f"coalesce(aggregate(again, struct(0 AS n, {-WINDOW} AS before), (a, p) -> struct(a.n + least({WINDOW}, p - a.before) AS n, p AS before), a -> a.n), 0)")
    common = F.expr(f"transform(element_at(map({ref_words}), ref), r -> size(filter(met, m -> m = r)))")
    d = d.select("doc_id", "ref", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"), "classes", common.alias("hits"))
    common = F.expr("CASE WHEN hits IS NOT NULL THEN transform(concat(hits, array(n_words - aggregate(hits, 0, (a, x) -> a + x))), x -> CAST(x AS BIGINT)) END")
    return d.withColumn("common", common).drop("hits")


def references(counted: DataFrame) -> DataFrame:
    """ref, ref_classes and ref_common: the totals over all documents of each language, and of all of them as POOLED."""
    n_classes, n_common = 7, 1 + max(len(w.split()) for w in COMMON.values())
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(n_classes)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(n_common)]
    by_lang = counted.groupBy("ref").agg(*sums, F.count("*").alias("n"))
    classes = F.array(*[f"c{i}" for i in range(n_classes)])
    pooled = by_lang.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(n_classes)]).select(F.lit(POOLED).alias("ref"), classes.alias("ref_classes"), F.lit(None).cast("array<bigint>").alias("ref_common"))
    own = by_lang.where((F.col("ref") != POOLED) & (F.col("n") >= REF_FROM)).select("ref", classes.alias("ref_classes"), F.nullif(F.array_compact(F.array(*[f"w{i}" for i in range(n_common)])), F.array().cast("array<bigint>")).alias("ref_common"))
    return own.unionByName(pooled)


def distance(p: str, q: str) -> Column:
    """The Jensen-Shannon distance of two count arrays of one length; null where either is null or has no counts."""
    total = lambda x: f"aggregate({x}, 0D, (a, x) -> a + x)"
    share = lambda x: f"transform({x}, v -> v / nullif({total(x)}, 0D))"
    term = "CASE WHEN a > 0 THEN a * log2(2 * a / (a + b)) ELSE 0D END + CASE WHEN b > 0 THEN b * log2(2 * b / (a + b)) ELSE 0D END"
    terms = f"zip_with({share(p)}, {share(q)}, (a, b) -> CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN {term} END)"
    return F.expr(f"CASE WHEN {total(p)} > 0 AND {total(q)} > 0 THEN sqrt(greatest(0D, aggregate({terms}, 0D, (s, x) -> s + x) / 2)) END")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base counts, class_distance, word_distance, base_failed and kept of every row."""
    counted = Scratch(df.sparkSession, "divergence").table(counts(df, id_col, text_col, lang_col), "counts")
    d = counted.join(references(counted), "ref", "left")
    d = d.withColumn("class_distance", F.round(distance("classes", "ref_classes"), 9)).withColumn("word_distance", F.round(distance("common", "ref_common"), 9))
    d = d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > int(100 * REPEAT_MOST) * F.col("n_words")))
    chars = F.expr("aggregate(classes, 0L, (a, x) -> a + x)")
    odd = ((chars >= CHARS_FROM) & (F.col("class_distance") > CLASSES_MOST)) | ((F.col("n_words") >= WORDS_FROM) & (F.col("word_distance") > WORDS_MOST))
    d = d.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")
