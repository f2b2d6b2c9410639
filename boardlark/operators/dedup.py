"""First-wins merging by URL and by title with provenance, retention, and the index of known URLs.

Posts carry `_ord`, their position; the first of a group survives.  Merging goes twice: equal canonical URLs, then equal titles; it isn't transitive.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlark.functions.dates import cutoff, parse_date
from boardlark.functions.text import token
from boardlark.functions.urls import canonical
from boardlark.rules import RETENTION_DAYS

META = ("source_name", "source_type", "category_raw", "original_url", "published_at", "crawled_at", "is_permanent_notice")
LISTS = ("source_name", "source_type", "category_raw")


def title_key(title: Column | str) -> Column:
    return token(F.coalesce(F.col(title) if isinstance(title, str) else title, F.lit("")))


def in_sequence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The old posts and then the new ones, positions renumbered so that all old ones come first."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_ord", F.struct("_src", "_ord")).drop("_src")


def by_url(posts: DataFrame, keep_blank: bool = True, canonicalize: bool = True) -> DataFrame:
    """The first post of each canonical URL; a later one only sets its permanent flag.  A missing URL is canonicalised too, so all posts without one
    are one; keep_blank=False drops them."""
    d = posts.withColumn("original_url", canonical("original_url") if canonicalize else F.coalesce("original_url", F.lit("")))
    if not keep_blank:
        d = d.where(~F.col("original_url").isin("", "https://"))
    first = d.groupBy("original_url").agg(F.min_by(F.struct(*d.columns), "_ord").alias("p"), F.bool_or(F.coalesce("is_permanent_notice", F.lit(False))).alias("flag"))
    return first.select("p.*", "flag").withColumn("is_permanent_notice", F.when(F.col("flag"), True).otherwise(F.col("is_permanent_notice"))).drop("flag").select(*posts.columns)


def by_title(posts: DataFrame) -> DataFrame:
    """One post for each title; the survivor gathers the others' sources, types and categories, attachments of new URLs, permanent flag, and a list of
    where each was seen (source_meta).  Blank titles don't merge."""
    key = F.when(title_key("title") != "", F.concat(F.lit("t"), title_key("title"))).otherwise(F.concat(F.lit("o"), F.to_json(F.struct("_ord"))))
    meta = F.struct(*[F.coalesce(c, F.lit(False)).alias(c) if c == "is_permanent_notice" else F.col(c) for c in META])
    d = posts.withColumn("_key", key)
    grouped = d.groupBy("_key").agg(
        F.min_by(F.struct(*posts.columns), "_ord").alias("p"),
        F.count("*").alias("_n"),
        F.bool_or(F.coalesce("is_permanent_notice", F.lit(False))).alias("_flag"),
        F.array_sort(F.collect_list(F.struct("_ord", meta.alias("m"), F.coalesce("attachments", F.array().cast(posts.schema["attachments"].dataType)).alias("a")))).alias("_all"),
    )
    merged = F.col("_n") > 1
    rest = F.transform(F.expr("slice(_all, 2, _n - 1)"), lambda x: x["m"])
    had = F.coalesce(F.size("p.source_meta") > 0, F.lit(False)) if "source_meta" in posts.columns else F.lit(False)
    own = F.array(F.get("_all", F.lit(0))["m"])
    seeded = F.when(had, F.col("p.source_meta")).otherwise(own) if "source_meta" in posts.columns else own
    name = lambda m: F.struct(m["source_name"], m["source_type"], m["category_raw"], m["original_url"])
    entry = lambda seed: lambda m: F.struct(name(m).alias("name"), F.lit(seed).alias("stays"), m.alias("v"))
    # An entry stays if it is a seed or the first of its name.
    kept = _firsts(F.concat(F.transform(seeded, entry(True)), F.transform(rest, entry(False))))
    # A file stays if it is the survivor's own, has no URL, or is the first of its URL.
    link = lambda a: F.coalesce(a["url"], F.lit(""))
    files = F.flatten(F.transform("_all", lambda x, i: F.transform(x["a"], lambda a: F.struct(link(a).alias("name"), ((i == 0) | (link(a) == "")).alias("stays"), a.alias("v")))))
    out = grouped.select("p", "_n", "_flag", "_all", kept.alias("_meta"), _firsts(files).alias("_files"))
    columns = [F.when(merged, _merged_list(c)).otherwise(F.col(f"p.{c}")).alias(c) for c in LISTS]
    columns += [F.when(merged, F.col("_flag")).otherwise(F.col("p.is_permanent_notice")).alias("is_permanent_notice"), F.when(merged, F.col("_files")).otherwise(F.col("p.attachments")).alias("attachments")]
    before = F.col("p.source_meta") if "source_meta" in posts.columns else F.lit(None)
    columns.append(F.when(merged, F.col("_meta")).otherwise(before).alias("source_meta"))
    done = {*LISTS, "is_permanent_notice", "attachments", "source_meta"}
    return out.select(*[F.col(f"p.{c}") for c in posts.columns if c not in done], *columns)


def _firsts(entries: Column) -> Column:
    """The values of a list of (name, stays, v) without those that don't stay and whose name stands before them, in order.  Equal names are brought side by
    side by sorting, so a list of n takes n log n steps; no lambda may reach outside its own element, as it would evaluate that anew for each."""
    placed = F.sort_array(F.transform(entries, lambda e, i: F.struct(e["name"].alias("name"), i.alias("i"), e["stays"].alias("stays"), e["v"].alias("v"))))
    before = F.concat(F.array(F.lit(None)), F.transform(placed, lambda e: F.struct(e["name"].alias("name"))))
    pairs = F.zip_with(placed, before, lambda e, b: F.struct(e.alias("e"), b.alias("b")))
    kept = F.filter(pairs, lambda p: p["e"].isNotNull() & (p["e"]["stays"] | p["b"].isNull() | ~p["e"]["name"].eqNullSafe(p["b"]["name"])))
    return F.transform(F.sort_array(F.transform(kept, lambda p: F.struct(p["e"]["i"].alias("i"), p["e"]["v"].alias("v")))), lambda e: e["v"])


def _merged_list(column: str) -> Column:
    return F.expr(f"array_distinct(filter(flatten(transform(_all, x -> coalesce(x.m.{column}, array()))), v -> v IS NOT NULL AND v <> ''))")


def merge(existing: DataFrame, new: DataFrame, keep_blank: bool = True) -> tuple[DataFrame, dict[str, int]]:
    """All posts merged by URL and title, and how many each step removed."""
    both = in_sequence(existing, new)
    first = by_url(both, keep_blank)
    out = by_title(first)
    n, after_url, after_title = both.count(), first.count(), out.count()
    return out, {"url_removed": n - after_url, "title_removed": after_url - after_title}


def stale(today: date | str, days: int = RETENTION_DAYS, dates: tuple[str, ...] = ("published_at",), meta: bool = True) -> Column:
    """Whether a post is past retention: not permanent, with a date, and every date at or before the cutoff.  With entries in source_meta, only their
    flags count and not the post's own."""
    own = F.coalesce("is_permanent_notice", F.lit(False))
    seen = F.array(*[parse_date(d) for d in dates])
    if meta:
        has = F.coalesce(F.size("source_meta") > 0, F.lit(False))
        permanent = F.when(has, F.exists("source_meta", lambda m: F.coalesce(m["is_permanent_notice"], F.lit(False)))).otherwise(own)
        seen = F.concat(seen, F.coalesce(F.transform("source_meta", lambda m: parse_date(m["published_at"])), F.array().cast("array<date>")))
    else:
        permanent = own
    seen = F.array_compact(seen)
    return ~permanent & (F.size(seen) > 0) & F.forall(seen, lambda d: d <= cutoff(today, days))


def prune(posts: DataFrame, today: date | str, days: int = RETENTION_DAYS) -> DataFrame:
    return posts.where(~stale(today, days, meta="source_meta" in posts.columns))


def known_urls(posts: DataFrame) -> DataFrame:
    """(url, _ord): every post's URL and those of its source_meta; the latest post of a URL counts."""
    own = posts.select("_ord", F.col("original_url").alias("url"))
    if "source_meta" in posts.columns:
        own = own.union(posts.select("_ord", F.explode(F.transform("source_meta", lambda m: m["original_url"])).alias("url")))
    return own.where("url IS NOT NULL AND url <> ''").withColumn("url", canonical("url")).groupBy("url").agg(F.max("_ord").alias("_ord"))


def provenance(posts: DataFrame) -> DataFrame:
    """The long form of by_title(): for every post, the position of its title's survivor and where it was seen.  One row a post, so a title that a third of
    all posts share stays spread over tasks; use it where source_meta arrays would grow too long."""
    key = F.when(title_key("title") != "", F.concat(F.lit("t"), title_key("title"))).otherwise(F.concat(F.lit("o"), F.to_json(F.struct("_ord"))))
    d = posts.withColumn("_key", key)
    first = d.groupBy("_key").agg(F.min("_ord").alias("survivor"))
    return d.select("_key", "_ord", *META).join(first, "_key").drop("_key")
