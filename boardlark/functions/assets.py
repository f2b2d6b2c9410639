"""Asset tests: content types, suffixes, fallback bodies, triggers."""

from __future__ import annotations

import ipaddress
from functools import reduce
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardlark.functions.text import _col, strip, visible_length
from boardlark.functions.urls import path_of, suffix

# --- Fixed values: suffixes and content types. ---
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".gif")
HWP_SUFFIXES = (".hwp", ".hwpx")
IMAGE_TYPES = ("image/png", "image/jpeg", "image/webp", "image/gif")
HWP_TYPES = ("application/haansofthwp", "application/hwp", "application/x-hwp", "application/vnd.hancom.hwp", "application/vnd.hancom.hwpx")
# --- Fixed values: bodies that stand for a missing text. ---
FALLBACK_PREFIXES = ("[이미지 본문]", "[동영상 본문]", "[첨부파일 공지]", "**[이미지 본문]**", "**[동영상 본문]**", "**[첨부파일 공지]**")
FALLBACK_VALUES = ("", "본문 정보가 비어 있습니다.")
#: Visible characters below which a body needs text.
LEAST_TEXT = 30


def type_base(x: Column | str) -> Column:
    return F.lower(strip(F.split_part(F.coalesce(_col(x), F.lit("")), F.lit(";"), F.lit(1))))


def _is(name: Column | str, url: Column | str, content_type: Column | str | None, suffixes: tuple[str, ...], types: tuple[str, ...]) -> Column:
    fits = suffix(name).isin(*suffixes) | suffix(path_of(url)).isin(*suffixes)
    return fits | type_base(content_type).isin(*types) if content_type is not None else fits


def is_image(name: Column | str, url: Column | str, content_type: Column | str | None = None) -> Column:
    return _is(name, url, content_type, IMAGE_SUFFIXES, IMAGE_TYPES)


def is_hwp(name: Column | str, url: Column | str, content_type: Column | str | None = None) -> Column:
    return _is(name, url, content_type, HWP_SUFFIXES, HWP_TYPES)


def attachment_type(name: Column | str, url: Column | str) -> Column:
    return F.when(is_image(name, url), "image_attachment").when(is_hwp(name, url), "hwp_attachment")


def is_fallback(content: Column | str) -> Column:
    v = strip(F.coalesce(_col(content), F.lit("")))
    return v.isin(*FALLBACK_VALUES) | reduce(lambda a, b: a | b, [F.startswith(v, F.lit(p)) for p in FALLBACK_PREFIXES])


def needs_text(content: Column | str, least: int = LEAST_TEXT) -> Column:
    return is_fallback(content) | (visible_length(content) < least)


def safe_url(url: str, domains: tuple[str, ...] = (), resolve=None) -> bool:
    """Whether a URL may be fetched: http or https, an allowed domain, and a global address.  A host name's addresses come from resolve(host), which
    the caller gives; without it names pass on the other tests alone."""
    parts = urlparse(url)
    host = (parts.hostname or "").lower().rstrip(".")
    if parts.scheme not in ("http", "https") or not host or host == "localhost":
        return False
    if domains and not any(host == d.lower().rstrip(".") or host.endswith("." + d.lower().rstrip(".")) for d in domains):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        addresses = resolve(host) if resolve else ["8.8.8.8"]
        return bool(addresses) and all(ipaddress.ip_address(a).is_global for a in addresses)
