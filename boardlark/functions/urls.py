"""URL functions.  Exact re-encoding follows the standard library, so these are Arrow UDFs, batch by batch; host and key filters are plain columns."""

from __future__ import annotations

import posixpath
from urllib.parse import parse_qs, parse_qsl, unquote, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from boardlark.functions.text import _col, strip
from boardlark.rules import URL_RULES, UrlRule


def _applies(rule: UrlRule, host: str, path: str) -> bool:
    named = host in rule.hosts if rule.exact else host.endswith(rule.hosts)
    return named and path.startswith(rule.path_starts) and path.endswith(rule.path_ends) and rule.path_has in path


def canonical_url(url: str, rules: tuple[UrlRule, ...] = URL_RULES) -> str:
    """The URL without what doesn't tell pages apart: by the first rule that fits, else without parameters and fragment and with sorted query pairs."""
    try:
        parts = urlparse(url)
    except ValueError:
        return url
    scheme, host = parts.scheme or "https", parts.netloc.lower()
    query = parse_qs(parts.query, keep_blank_values=True)
    last = {k: v[-1] for k, v in query.items()}
    for rule in rules:
        if not _applies(rule, host, parts.path):
            continue
        if rule.bare:
            return urlunparse((scheme, parts.netloc, parts.path.rstrip("/"), "", "", ""))
        if all(k in last for k in (*rule.need, *rule.need_value)) and (rule.equals is None or last.get(rule.equals[0], "") == rule.equals[1]):
            return urlunparse((scheme, parts.netloc, parts.path, "", urlencode([(k, last[k]) for k in rule.keep if k in last]), ""))
    return urlunparse((scheme, parts.netloc, parts.path, "", urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True))), ""))


def canonical(x: Column | str, rules: tuple[UrlRule, ...] = URL_RULES) -> Column:
    """canonical_url() of a column; null counts as empty."""

    @F.pandas_udf(StringType())
    def run(urls: pd.Series) -> pd.Series:
        return urls.fillna("").map(lambda u: canonical_url(u, rules))

    return run(_col(x))


def canonical_plain(x: Column | str) -> Column:
    """The rule for all other sites as plain columns, for URLs whose query needs no re-encoding: no fragment, query pairs sorted."""
    url = F.regexp_replace(_col(x), "#.*$", "")
    base, query = F.split_part(url, F.lit("?"), F.lit(1)), F.regexp_extract(url, r"\?(.*)$", 1)
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    return F.when(F.size(pairs) > 0, F.concat(base, F.lit("?"), F.array_join(pairs, "&"))).otherwise(base)


def joined(base: Column | str, link: Column | str) -> Column:
    """A link made absolute."""

    @F.pandas_udf(StringType())
    def run(bases: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b or "", v or "") for b, v in zip(bases, links)])

    return run(_col(base), _col(link))


def escaped(x: Column | str) -> Column:
    """Blanks and parentheses as percent codes, so that a Markdown link holds the URL."""
    return F.replace(F.replace(F.replace(_col(x), F.lit(" "), F.lit("%20")), F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def first_non_data(*columns: Column | str) -> Column:
    """The first value that is neither empty nor a data or javascript URL; '' if none is."""
    return F.coalesce(*[F.when(~F.lower(_col(c)).rlike("^(data:|javascript:)") & (_col(c) != ""), _col(c)) for c in columns], F.lit(""))


def cleaned(x: Column | str) -> Column:
    """Without backslashes and outer quotes."""
    return F.regexp_replace(F.replace(strip(F.coalesce(_col(x), F.lit(""))), F.lit("\\"), F.lit("")), r"""^["']+|["']+\z""", "")


def path_of(x: Column | str) -> Column:
    """The path without query, fragment and parameters."""
    return F.regexp_extract(_col(x), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)


def decoded(x: Column | str) -> Column:
    """Percent codes decoded; the text itself where they are broken."""
    return F.coalesce(F.try_url_decode(F.replace(_col(x), F.lit("+"), F.lit("%2B"))), _col(x))


def suffix(x: Column | str) -> Column:
    """The last suffix of the last path part, lower case, '' if there is none."""
    name = F.regexp_extract(F.regexp_replace(decoded(x), r"/+\z", ""), r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)\z", 1))


def asset_name(url: Column | str, fallback: Column | str) -> Column:
    """The last part of the URL's path, or the fallback, which data URLs also take."""
    name = F.nullif(F.regexp_extract(F.regexp_replace(decoded(path_of(url)), r"/+\z", ""), r"([^/]*)\z", 1), F.lit(""))
    return F.when(F.lower(strip(url)).startswith("data:"), _col(fallback)).otherwise(F.coalesce(name, _col(fallback)))


def name_suffix(value: str) -> str:
    return posixpath.splitext(unquote(value))[1].lower()
