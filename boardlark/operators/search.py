"""Faceted keyword search with synonym-aware weights, stable pages and exact totals.

Two modes differ as their names say.  `primary`: a row is a candidate if the phrase or any expanded term occurs (LIKE, case-insensitive, with the
query's wildcards alive), the newest CANDIDATES candidates are ranked, and the total counts all candidates.  `fallback`: the phrase, or at least two
of the unexpanded terms (or the only one), and the total counts the matches.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlark.functions.dates import comparable, recency
from boardlark.functions.text import compact, facet_value, source_names
from boardlark.rules import ALL_TOKENS, CANDIDATES, EMPTY_TOKENS, PAGE_SIZE, PAGE_SIZE_MOST, STOP_WORDS, SYNONYMS, UNIVERSITY, Taxonomy


def squeeze(q: str | None) -> str:
    return " ".join((q or "").split())


def value_or_none(x: str | None) -> str | None:
    """A filter's value; None if it means no filter."""
    v = squeeze(x)
    return None if v.lower() in EMPTY_TOKENS or v.lower() in ALL_TOKENS else v


def terms(q: str | None, stop_words: frozenset[str] = STOP_WORDS) -> list[str]:
    """The query's words without stop-words and single letters (single digits stay), distinct; all its words if nothing else is left."""
    words = [w for w in re.split(r"[^\w]+", squeeze(q).lower()) if w]
    telling = [w for w in words if w not in stop_words and (len(w) > 1 or w.isdigit())]
    return list(dict.fromkeys(telling or words))


def _synonyms(term: str, synonyms: tuple[tuple[str, ...], ...]) -> tuple[str, ...]:
    return next((g for g in synonyms if term in {m.lower() for m in g}), ())


def expanded(words: list[str], synonyms: tuple[tuple[str, ...], ...] = SYNONYMS) -> list[str]:
    """The terms, each followed by the members of its first synonym group as they are written there; distinct regardless of case."""
    out: dict[str, str] = {}
    for w in words:
        if w and w.lower() not in out:
            for m in (w, *_synonyms(w.lower(), synonyms)):
                out.setdefault(m.lower(), m)
    return list(out.values())


def term_groups(q: str | None, synonyms: tuple[tuple[str, ...], ...] = SYNONYMS) -> list[list[str]]:
    """One sorted group of lower-case words for each term that no earlier group holds."""
    found: list[list[str]] = []
    for w in terms(q):
        if not any(w in g for g in found):
            found.append(sorted({w, *(m.lower() for m in _synonyms(w, synonyms))}))
    return found


def searchable(df: DataFrame) -> DataFrame:
    """Adds searchable_text and searchable_compact to classified() rows: all that a query may hit, lower case, one field a line."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("title", "content", "audience_group")]
    parts += [F.col("source_groups"), facet_value("source"), facet_value("department"), facet_value("category"), source_names("sources", "source"), F.filter("tags", lambda t: t != "")]
    text = F.lower(F.concat_ws("\n", *parts))
    return df.withColumn("searchable_text", text).withColumn("searchable_compact", compact("searchable_text"))


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def _like(column: str, needle: str) -> Column:
    """LIKE %needle% regardless of case; the needle's own wildcards count.  Without any it is a plain search, as the columns are lower case."""
    return F.col(column).ilike(f"%{needle}%") if re.search(r"[%_\\]", needle) else F.contains(column, F.lit(needle.lower()))


def candidate(q: str, synonyms: tuple[tuple[str, ...], ...] = SYNONYMS) -> Column:
    """The primary mode's candidate predicate."""
    needles = [squeeze(q).lower(), *expanded(terms(q), synonyms)]
    return _any([c for n in needles for c in (_like("searchable_text", n), _like("searchable_compact", "".join(n.split())))])


def _holds(needle: str) -> Column:
    tight = "".join(needle.split())
    return F.contains("searchable_text", F.lit(needle)) | (F.contains("searchable_compact", F.lit(tight)) if tight else F.lit(False))


def matches_any(q: str, synonyms: tuple[tuple[str, ...], ...] = SYNONYMS) -> Column:
    """The primary mode's exact test: the phrase or any expanded term, as written."""
    return _any([_holds(n) for n in (squeeze(q).lower(), *expanded(terms(q), synonyms))])


def matches_some(q: str) -> Column:
    """The fallback mode's test: the phrase, or at least two of the terms, or the only term."""
    words = terms(q)
    n = reduce(lambda a, b: a + b, [_holds(w).cast("int") for w in words], F.lit(0))
    return _holds(squeeze(q).lower()) | ((n >= min(2, len(words))) if words else F.lit(False))


def score(groups: list[list[str]], today: date | str) -> Column:
    """For each group that occurs at all: 1, and 7 in the title, 3 in the tags, 2 in source or category, 1 in the content; then the recency of scored
    rows.  A list of single terms as groups gives the score by terms."""
    low = {c: F.lower(F.coalesce(x, F.lit(""))) for c, x in (("title", F.col("title")), ("content", F.col("content")), ("source", facet_value("source")), ("category", facet_value("category")))}
    tags = F.lower(F.array_join("tags", " "))
    total = F.lit(0)
    for g in groups:
        within = lambda x, g=g: _any([F.contains(x, F.lit(m)) for m in g])
        weight = 1 + 7 * within(low["title"]).cast("int") + 3 * within(tags).cast("int") + 2 * (within(low["source"]) | within(low["category"])).cast("int") + within(low["content"]).cast("int")
        total = total + F.when(within(F.col("searchable_text")), weight).otherwise(0)
    return F.when(total > 0, total + F.when(F.col("published_at").isNotNull(), recency("published_at", today)).otherwise(0)).otherwise(total).cast("int")


def latest(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("published_at"), F.asc("title"), F.asc("id"))


def ranked(df: DataFrame, q: str | None, today: date | str, synonyms: tuple[tuple[str, ...], ...] = SYNONYMS) -> DataFrame:
    """Rows with their score, best first, then newest, then by title and id."""
    groups = term_groups(q, synonyms)
    return df.withColumn("score", score(groups, today) if groups else F.lit(0)).orderBy(F.desc("score"), comparable("published_at").desc(), F.asc("title"), F.asc("id"))


@dataclass(frozen=True)
class Filters:
    audience: str | None = None
    source_group: str | None = None
    source: str | None = None
    category: str | None = None
    department: str | None = None


def filtered(df: DataFrame, filters: Filters, known_groups: list[str] | None = None, taxonomy: Taxonomy = UNIVERSITY, normalized_sources: bool = False) -> DataFrame:
    """All filters that are set.  A source group that isn't among the audience's known ones, and a source outside the audiences where it counts, are
    ignored.  normalized_sources: compare the source names' facet values (fallback mode) and not the names as they are."""
    audience, group, source = value_or_none(filters.audience), value_or_none(filters.source_group), value_or_none(filters.source)
    if audience:
        df = df.where(F.col("audience_group") == audience)
    if group and (known_groups is None or group in known_groups):
        df = df.where(F.array_contains("source_groups", group))
    if source and audience in taxonomy.source_filter_audiences:
        df = df.where(F.array_contains("source_names" if normalized_sources else "sources", source))
    for column, value in (("category", value_or_none(filters.category)), ("department", value_or_none(filters.department))):
        if value:
            df = df.where(F.col(column) == value)
    return df


def clamp(page: int | None, size: int | None, total: int) -> tuple[int, int, int]:
    """Page, page size and number of pages, all within bounds."""
    size = PAGE_SIZE if size is None else min(PAGE_SIZE_MOST, max(1, size))
    pages = max(1, math.ceil(total / size))
    return min(max(1, page or 1), pages), size, pages


class Page:
    """One page of found rows.  The total is counted when it is asked for; the first page doesn't need it."""

    def __init__(self, ordered: DataFrame, met: DataFrame, page: int | None, size: int | None):
        """ordered: all rows that pages are cut from; met: the rows that the total counts."""
        self._ordered, self._met, self._asked = ordered, met, page
        self.size = clamp(None, size, 0)[1]

    @cached_property
    def total(self) -> int:
        return self._met.count()

    @property
    def page(self) -> int:
        return 1 if (self._asked or 1) <= 1 else clamp(self._asked, self.size, self.total)[0]

    @property
    def pages(self) -> int:
        return clamp(None, self.size, self.total)[2]

    @property
    def items(self) -> DataFrame:
        at = self.page
        return (self._ordered.offset((at - 1) * self.size) if at > 1 else self._ordered).limit(self.size)

    def any(self) -> bool:
        """Whether the total is above 0, without counting."""
        return not self._met.limit(1).isEmpty()


def search(df: DataFrame, q: str | None = None, page: int = 1, size: int | None = None, today: date | str | None = None, mode: str = "primary", synonyms: tuple[tuple[str, ...], ...] = SYNONYMS) -> Page:
    """One page over searchable() rows that are filtered already.  A blank query lists the newest."""
    today = today or date.today()
    if not squeeze(q):
        return Page(latest(df), df, page, size)
    if mode == "fallback":
        met = found = df.where(matches_some(q))
    else:
        met = df.where(candidate(q, synonyms))
        found = latest(met).limit(CANDIDATES).where(matches_any(q, synonyms))
    return Page(ranked(found, q, today, synonyms), met, page, size)


def relevant(df: DataFrame, q: str | None, most: int, today: date | str, or_latest: bool = True, mode: str = "primary") -> DataFrame:
    """The best `most` rows for a question; the newest if none matches, unless that is switched off."""
    hits = search(df, q, 1, most, today, mode)
    return search(df, None, 1, most, today).items if or_latest and not hits.any() else hits.items
