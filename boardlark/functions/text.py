"""String and list functions as Column to Column.  White space is Unicode white space and U+001C to U+001F."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardlark.rules import ALL_TOKENS, EMPTY_TOKENS

#: White space for Java patterns.
WS = r"[\s\x1c-\x1f]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sub(x: Column | str, pattern: str, by: str) -> Column:
    """regexp_replace with Unicode classes."""
    return F.regexp_replace(_col(x), F.lit(f"(?U){pattern}"), F.lit(by))


def strip(x: Column | str) -> Column:
    return sub(x, rf"^{WS}+|{WS}+\z", "")


def collapse(x: Column | str) -> Column:
    """White space runs become one blank; none at the ends."""
    return strip(sub(x, rf"{WS}+", " "))


def token(x: Column | str) -> Column:
    return F.lower(collapse(x))


def compact(x: Column | str) -> Column:
    return sub(x, rf"{WS}+", "")


def blank_to_null(x: Column | str) -> Column:
    """Stripped, or null if nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def non_blank(values: Column | str) -> Column:
    """The stripped, non-blank elements of a list; an empty list for null."""
    kept = F.filter(F.transform(_col(values), strip), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def first_non_blank(*columns: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def includes_any(x: Column | str, needles: tuple[str, ...] | list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_col(x), F.lit(n)) for n in needles], F.lit(False))


def facet_value(x: Column | str) -> Column:
    """Collapsed, or null for a token that means empty."""
    v = collapse(x)
    return F.when(~F.lower(v).isin(*EMPTY_TOKENS), v)


def filter_value(x: Column | str) -> Column:
    """facet_value(), or null for a token that means no filter."""
    v = facet_value(x)
    return F.when(~F.lower(v).isin(*ALL_TOKENS), v)


def filter_values(x: Column | str) -> Column:
    """The filter values of a comma-separated string, distinct, in order."""
    return F.array_distinct(F.array_compact(F.transform(F.split(_col(x), ","), filter_value)))


def source_names(sources: Column | str, source: Column | str) -> Column:
    """The facet values of the list and then of the single source, distinct, in order."""
    every = F.concat(F.coalesce(_col(sources), F.array().cast("array<string>")), F.array(_col(source)))
    return F.array_distinct(F.array_compact(F.transform(every, facet_value)))


def source_label(x: Column | str, prefix: str = "한국항공대학교") -> Column:
    """Without the institution's name in front, unless nothing would be left."""
    v = collapse(x)
    return F.coalesce(F.nullif(sub(v, rf"^{prefix}{WS}*", ""), F.lit("")), v)


def slug(x: Column | str) -> Column:
    """Lower case, other than a-z, 0-9 and Hangul syllables become dashes, none at the ends, 48 characters; `notice` if empty."""
    v = F.regexp_replace(F.regexp_replace(F.lower(_col(x)), "[^a-z0-9가-힣]+", "-"), r"^-+|-+\z", "")
    return F.coalesce(F.nullif(F.left(v, F.lit(48)), F.lit("")), F.lit("notice"))


def strip_html(x: Column | str) -> Column:
    v = F.regexp_replace(_col(x), r"(?i)<script[^>]*>[\s\S]*?</script>", "")
    v = F.regexp_replace(v, r"(?i)<style[^>]*>[\s\S]*?</style>", "")
    return collapse(F.regexp_replace(v, "<[^>]+>", " "))


def truncate(x: Column | str, most: int, mark: str = "...") -> Column:
    x = _col(x)
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit(mark))).otherwise(x)


def excerpt(x: Column | str, most: int = 180) -> Column:
    v = collapse(x)
    return F.when(F.length(v) > most, F.concat(F.left(v, F.lit(most - 1)), F.lit("…"))).otherwise(v)


def visible_length(x: Column | str) -> Column:
    """Non-space characters outside Markdown images, link targets and bare URLs."""
    v = F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"!\[[^\]]*\]\([^)]*\)", " ")
    v = F.regexp_replace(v, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.length(compact(sub(v, r"https?://\S+", " ")))


def safe_log_value(x: Column | str, most: int = 200) -> Column:
    v = strip(F.coalesce(_col(x), F.lit("")))
    media = F.split_part(v, F.lit(","), F.lit(1))
    cut = F.concat(F.left(v, F.lit(most)), F.lit("...<truncated:"), F.length(v).cast("string"), F.lit(" chars>"))
    return F.when(F.startswith(v, F.lit("data:")), F.concat(truncate(media, most), F.lit(",<omitted>"))).when(F.length(v) <= most, v).otherwise(cut)


def inline_space(x: Column | str) -> Column:
    """Runs of blanks and tabs become one blank; none at the ends."""
    return strip(F.regexp_replace(_col(x), "[ \\t]+", " "))


def clean_lines(x: Column | str) -> Column:
    """Each line collapsed; blank lines dropped."""
    lines = F.transform(F.split(_col(x), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), collapse)
    return F.array_join(F.filter(lines, lambda v: v != ""), "\n")


def board_label(x: Column | str) -> Column:
    """A board's name without its usual ending, unless nothing would be left."""
    v = strip(x)
    return F.coalesce(blank_to_null(F.regexp_replace(v, r"공지사항\z", "")), v)


def collapse_blank_lines(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(x), "\r", ""), "\n{3,}", "\n\n")


def number_or(x: Column | str, default: int) -> Column:
    return F.coalesce(F.expr("try_cast({} AS INT)".format(f"`{x}`")) if isinstance(x, str) else x.try_cast("int"), F.lit(default))
