"""Replays of incremental board crawls, page signatures, recency decisions, robots rules, request rates."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlark.functions.dates import cutoff, parse_date
from boardlark.rules import RETENTION_DAYS

STOPS = ("fetch_failed", "empty_page", "repeated_page", "old_notice", "no_new_general")


def recent_policy(published_at: Column | str, permanent: Column | str, today: date | str, days: int = RETENTION_DAYS) -> Column:
    """struct(include, stop): permanent notices always go in; a general one at or before the cutoff stays out and stops its board."""
    flag = F.coalesce(F.col(permanent) if isinstance(permanent, str) else permanent, F.lit(False))
    old = F.coalesce(parse_date(published_at) <= cutoff(today, days), F.lit(False)) & ~flag
    return F.struct((~old).alias("include"), old.alias("stop"))


def page_limit(most: int, least: int = 1) -> int | None:
    """Pages to read: none means all; a board's least number raises the limit."""
    return None if most <= 0 else max(most, least)


def signatures(items: DataFrame) -> DataFrame:
    """(board, page, signature, repeated): a page's URLs in order; repeated if an earlier page of the board had the same."""
    pages = items.groupBy("board", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]).alias("urls"))
    pages = pages.withColumn("signature", F.sha2(F.array_join("urls", "\n").cast("binary"), 256))
    k = F.row_number().over(Window.partitionBy("board", "signature").orderBy("page"))
    return pages.select("board", "page", "signature", (k > 1).alias("repeated"))


def before_stop(items: DataFrame, stop: Column) -> DataFrame:
    """Items of each board up to and with the first for which `stop` holds."""
    earlier = Window.partitionBy("board").orderBy("page", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("_s", F.coalesce(F.max(stop.cast("int")).over(earlier), F.lit(0))).where("_s = 0").drop("_s")


def permanent_first(items: DataFrame) -> DataFrame:
    return items.orderBy("board", "page", F.desc("is_permanent_notice"), "pos")


def replay_board(pages: list[list[dict]], known: set[str], dates: dict[str, str | None], today: date, limit: int | None = None, days: int = RETENTION_DAYS) -> tuple[list[dict], str]:
    """What one board's crawl takes, and why it stops.  pages: items (url, is_permanent_notice, published_at); known URLs aren't taken again; `known` and
    `dates` grow as URLs are taken, so a later board sees them."""
    edge = pd.Timestamp(today) - pd.Timedelta(days=days)
    old = lambda d: pd.notna(x := pd.to_datetime(d, errors="coerce")) and x <= edge
    taken, seen, signatures_seen = [], set(known), set()
    for k, page in enumerate(pages, 1):
        if limit is not None and k > limit:
            return taken, "page_limit"
        if not page:
            return taken, "empty_page"
        mark = tuple(i["url"] for i in page)
        if mark in signatures_seen:
            return taken, "repeated_page"
        signatures_seen.add(mark)
        fixed, general = [i for i in page if i["is_permanent_notice"]], [i for i in page if not i["is_permanent_notice"]]
        stale_page = bool(general) and all(i["url"] in seen for i in general)
        once: set[str] = set()
        for item in fixed if stale_page else fixed + general:
            url = item["url"]
            if url in once:
                continue
            once.add(url)
            if url in seen:
                if not item["is_permanent_notice"] and old(dates.get(url)):
                    return taken, "old_notice"
                continue
            seen.add(url)
            if not item["is_permanent_notice"] and old(item["published_at"]):
                return taken, "old_notice"
            known.add(url)
            dates[url] = item["published_at"]
            taken.append(item | {"page": k})
        if stale_page:
            return taken, "no_new_general"
    return taken, "fetch_failed"


def replay(items: DataFrame, known: DataFrame, today: date | str, limit: int | None = None) -> DataFrame:
    """(board, page, url, stop): what each board takes and why it stops, every board by itself over the same known URLs (url, published_at)."""
    day = pd.Timestamp(str(today)).date()
    listed = items.select("board", "page", "pos", "url", "is_permanent_notice", "published_at").join(known.select("url", F.col("published_at").alias("known_at"), F.lit(True).alias("known")), "url", "left")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page", "pos"])
        held = rows[rows["known"].eq(True)]
        pages = [g.to_dict("records") for _, g in rows.groupby("page", sort=True)]
        taken, stop = replay_board(pages, set(held["url"]), dict(zip(held["url"], held["known_at"])), day, limit)
        return pd.DataFrame([(key[0], i["page"], i["url"], stop) for i in taken] or [(key[0], None, None, stop)], columns=["board", "page", "url", "stop"])

    return listed.groupBy("board").applyInPandas(run, "board string, page long, url string, stop string")


def replay_in_order(items: DataFrame, known: DataFrame, today: date | str, limit: int | None = None) -> DataFrame:
    """The exact sequence, boards one after the other by name, where a later board knows what earlier ones took.  That order is the meaning, so it is one
    task; replay() is the parallel form."""
    day = pd.Timestamp(str(today)).date()
    rows = items.select("board", "page", "pos", "url", "is_permanent_notice", "published_at").withColumn("kind", F.lit(1))
    old = known.select(F.lit("").alias("board"), F.lit(0).cast("long").alias("page"), F.lit(0).cast("long").alias("pos"), "url", F.lit(False).alias("is_permanent_notice"), "published_at", F.lit(0).alias("kind"))
    one = rows.unionByName(old).repartition(1).sortWithinPartitions("kind", "board", "page", "pos")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(batches), ignore_index=True)
        held = whole[whole["kind"] == 0]
        urls, dates = set(held["url"]), dict(zip(held["url"], held["published_at"]))
        out = []
        for board, own in whole[whole["kind"] == 1].groupby("board", sort=True):
            taken, stop = replay_board([g.to_dict("records") for _, g in own.groupby("page", sort=True)], urls, dates, day, limit)
            out += [(board, i["page"], i["url"], stop) for i in taken] or [(board, None, None, stop)]
        yield pd.DataFrame(out, columns=["board", "page", "url", "stop"])

    return one.mapInPandas(run, "board string, page long, url string, stop string")


def rates(events: DataFrame, key: str, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """(key, start, n): requests of each key in each tumbling window."""
    return events.groupBy(F.col(key).alias("key"), F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "n")


def violations(events: DataFrame, key: str, most: int, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """The windows in which a key has more requests than allowed, and how many were over."""
    return rates(events, key, ts, width).where(F.col("n") > most).withColumn("over", F.col("n") - most)


def client_key(trusted: Column, client_ip: Column, real_ip: Column, peer: Column) -> Column:
    """Who a request counts for: the forwarded client if its token is trusted, else the proxy's, else the peer."""
    first = F.nullif(F.trim(F.split_part(client_ip, F.lit(","), F.lit(1))), F.lit(""))
    return F.coalesce(F.when(trusted, first), F.nullif(F.trim(real_ip), F.lit("")), peer, F.lit("unknown"))


def robots_rules(text: str, agent: str) -> list[tuple[str, str]]:
    """(action, prefix) of the groups that name the agent, else of the * groups.  An empty Disallow allows all and is left out."""
    groups: list[tuple[list[str], list[tuple[str, str]]]] = []
    for line in text.splitlines():
        name, colon, value = line.split("#", 1)[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if not groups or groups[-1][1]:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
        elif name in ("allow", "disallow") and groups:
            groups[-1][1].append((name, value))
    named = [r for agents, r in groups if any(a != "*" and a in agent.lower() for a in agents)]
    return [x for r in named or [r for agents, r in groups if "*" in agents] for x in r if x[1]]


def allowed(urls: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Adds `allowed`: by the longest rule (host, action, prefix) that the path starts with, Allow before Disallow on equal length; true without any."""
    met = urls.join(rules, (urls["host"] == rules["host"]) & F.startswith(urls[path], rules["prefix"]), "left").drop(rules["host"])
    best = F.max(F.struct(F.length("prefix").alias("n"), (F.col("action") == "allow").alias("ok")))
    return met.groupBy(*urls.columns).agg(best.alias("_b")).withColumn("allowed", F.coalesce("_b.ok", F.lit(True))).drop("_b")
