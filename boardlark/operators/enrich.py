"""Bodies that are images or files: which posts need a text, from which assets, by what trigger, within which budget.

Text extraction and generation are protocols (see sources.providers); nothing here calls a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlark.functions.assets import LEAST_TEXT, attachment_type, needs_text
from boardlark.functions.text import blank_to_null, strip

ASSETS_MOST, CALLS_MOST = 3, 50
OVER_BUDGET = "enrichment_call_budget_exceeded"


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def assets(content_assets: str = "content_assets", attachments: str = "attachments", most: int = ASSETS_MOST) -> Column:
    """Inline images, then image and document attachments; each URL once, at most so many."""
    kind = "struct<type:string,name:string,url:string,source:string>"
    images = F.transform(
        F.filter(content_assets, lambda a: (a["type"] == "inline_image") & blank_to_null(a["url"]).isNotNull()),
        lambda a: F.struct(F.lit("inline_image").alias("type"), F.coalesce(F.nullif(a["name"], F.lit("")), F.lit("inline-image")).alias("name"), strip(a["url"]).alias("url"), F.lit("body").alias("source")),
    )
    files = F.transform(
        F.filter(attachments, lambda a: blank_to_null(a["url"]).isNotNull()),
        lambda a: F.struct(attachment_type(F.coalesce(F.nullif(a["name"], F.lit("")), a["url"]), a["url"]).alias("type"), F.coalesce(F.nullif(a["name"], F.lit("")), strip(a["url"])).alias("name"), strip(a["url"]).alias("url"), F.lit("attachment").alias("source")),
    )
    both = F.concat(F.coalesce(images, _empty(kind)), F.coalesce(F.filter(files, lambda a: a["type"].isNotNull()), _empty(kind)))
    urls = F.transform(both, lambda a: a["url"])
    first = F.filter(F.transform(both, lambda a, i: F.struct(a.alias("a"), i.alias("i"))), lambda x: F.array_position(urls, x["a"]["url"]) == x["i"] + 1)
    return F.slice(F.transform(first, lambda x: x["a"]), 1, most)


def wanted(posts: DataFrame, least: int = LEAST_TEXT) -> Column:
    """Whether a post has assets and no text to speak of; an earlier success doesn't matter."""
    return (F.size(assets()) > 0) & needs_text("content", least)


def trigger(content: str = "content", content_assets: str = "content_assets", attachments: str = "attachments") -> Column:
    """What a post's body is made of, the first of the labels that fits."""
    image = F.coalesce(F.exists(content_assets, lambda a: a["type"] == "inline_image"), F.lit(False))
    types = F.transform(attachments, lambda a: attachment_type(F.coalesce(a["name"], F.lit("")), F.coalesce(a["url"], F.lit(""))))
    hwp, picture = (F.coalesce(F.array_contains(F.array_compact(types), t), F.lit(False)) for t in ("hwp_attachment", "image_attachment"))
    starts = F.startswith(strip(F.coalesce(content, F.lit(""))), F.lit("[이미지 본문]"))
    return (
        F.when(image & hwp & picture, "inline_image_and_mixed_attachments")
        .when(image & hwp, "inline_image_and_hwp_attachment")
        .when(image & picture, "inline_image_and_image_attachment")
        .when(hwp & picture, "mixed_attachments")
        .when(image & starts, "image_only_body")
        .when(hwp, "hwp_attachment_only")
        .when(picture, "image_attachment_only")
        .when(image, "inline_image")
        .otherwise("unknown")
    )


def planned_calls(posts: DataFrame, most: int = CALLS_MOST) -> DataFrame:
    """Adds calls (one for each image and one for the text, 0 for a post that isn't wanted), calls_before and within_budget, in the order of _ord.

    The running sum goes over the totals of position ranges first, so no task holds all posts."""
    per = F.size(F.filter(assets(), lambda a: a["type"] != "hwp_attachment")) + 1
    d = posts.withColumn("calls", F.when(wanted(posts), per).otherwise(0).cast("long")).withColumn("_part", F.floor(F.col("_ord") / 4096))
    parts = d.groupBy("_part").agg(F.sum("calls").alias("_sum"))
    starts = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum("calls").over(Window.partitionBy("_part").orderBy("_ord")) - F.col("calls")
    d = d.join(starts, "_part").withColumn("calls_before", F.col("_before") + within)
    return d.withColumn("within_budget", (F.col("calls") > 0) & (F.col("calls_before") < most)).drop("_part", "_before")


def enrich(posts: DataFrame, read_asset: Callable[[dict], str | None], write_text: Callable[[dict, list[str]], str | None], most: int = CALLS_MOST, least: int = LEAST_TEXT) -> DataFrame:
    """(_ord, status, detail, content): the exact run, in order, with a call counted when it is made.  The order is the meaning here, so the posts that
    are wanted go through one task in sequence; planned_calls() is the parallel estimate.  read_asset gives an asset's text or None; write_text the body."""
    todo = posts.where(wanted(posts, least)).select("_ord", "title", "content", assets().alias("assets")).repartition(1).sortWithinPartitions("_ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = 0
        for b in batches:
            rows = []
            for post in b.to_dict("records"):
                texts, over = [], used >= most
                for a in post["assets"] if not over else ():
                    if a["type"] != "hwp_attachment":
                        if used >= most:
                            over = True
                            break
                        used += 1
                    text = read_asset(a)
                    if text:
                        texts.append(text)
                if over:
                    rows.append((post["_ord"], "skipped", OVER_BUDGET, None))
                elif not texts:
                    rows.append((post["_ord"], "failed", "no_extracted_text", None))
                elif used >= most:
                    rows.append((post["_ord"], "skipped", OVER_BUDGET, None))
                else:
                    used += 1
                    body = write_text(post, texts)
                    short = len("".join((body or "").split())) < least
                    rows.append((post["_ord"], "failed" if short else "success", "generated_content_too_short" if short else "", None if short else body))
            yield pd.DataFrame(rows, columns=["_ord", "status", "detail", "content"])

    return todo.mapInPandas(run, "_ord bigint, status string, detail string, content string")


def run_counts(results: DataFrame, total: int) -> DataFrame:
    """target_count, attempted, succeeded, failed and skipped of a run over so many posts."""
    n = lambda s: F.count_if(F.col("status") == s)
    return results.agg(F.count("*").alias("target_count"), (n("success") + n("failed")).alias("attempted"), n("success").alias("succeeded"), n("failed").alias("failed"), (F.lit(total) - n("success") - n("failed")).alias("skipped"))


def refreshed(content: Column, original: Column, fresh: Column, status: Column) -> tuple[Column, Column]:
    """(content, content_original) after a page was read again: the original always follows, the content only where no enrichment succeeded."""
    return F.when(status == "success", content).otherwise(fresh), fresh


def refreshed_posts(posts: DataFrame, pages: DataFrame) -> DataFrame:
    """Posts after their pages were read again, with `outcome`.  posts: _ord, original_url, content, content_original, status (of the enrichment) and board
    (null where none fits); pages: original_url, html_found and fresh (the parsed body, null where parsing failed).  A post without a usable page stays as it is."""
    of = pages.select(F.col("original_url").alias("_url"), "html_found", blank_to_null("fresh").alias("fresh")).dropDuplicates(["_url"])
    both = posts.join(of, F.col("original_url") == F.col("_url"), "left").drop("_url")
    outcome = F.when(F.col("board").isNull(), "skipped_no_board").when(~F.coalesce("html_found", F.lit(False)), "failed_fetch").when(F.col("fresh").isNull(), "failed_parse")
    both = both.withColumn("outcome", outcome.when(F.col("status") == "success", "preserved_enriched").otherwise("succeeded"))
    content, original = refreshed(F.col("content"), F.col("content_original"), F.col("fresh"), F.col("status"))
    used = F.col("outcome").isin("succeeded", "preserved_enriched")
    out = both.withColumns({"content": F.when(used, content).otherwise(F.col("content")), "content_original": F.when(used, original).otherwise(F.col("content_original"))})
    return out.select(*posts.columns, "outcome")


def refresh_counts(results: DataFrame) -> DataFrame:
    """total, succeeded, preserved_enriched (which succeeded too), failed_fetch, failed_parse and skipped_no_board of refreshed_posts()."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    single = [n(o).alias(o) for o in ("preserved_enriched", "failed_fetch", "failed_parse", "skipped_no_board")]
    return results.agg(F.count("*").alias("total"), n("succeeded", "preserved_enriched").alias("succeeded"), *single)


def reply_object(raw: Column | str) -> Column:
    """struct(object, error): a model's reply as a JSON object in text form; an error for anything else."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    parsed = F.try_parse_json(raw)
    good = F.coalesce(parsed.isNotNull() & F.startswith(F.ltrim(F.regexp_replace(raw, r"\s+", " ")), F.lit("{")), F.lit(False))
    return F.struct(F.when(good, F.to_json(parsed)).alias("object"), F.when(~good, F.lit("llm_json_parse_failed")).alias("error"))


def filled_content(content: Column | str, images: Column | str, embeds: Column | str, attachments: Column | str) -> Column:
    """A missing body from inline images, else embeds, else attachments, as a list of labels."""

    def labels(column: Column | str) -> Column:
        named = F.transform(column, lambda a: blank_to_null(F.coalesce(F.nullif(a["name"], F.lit("")), a["url"])))
        return F.array_join(F.transform(F.array_distinct(F.array_compact(named)), lambda x: F.concat(F.lit("- "), x)), "\n")

    def body(column: Column | str, mark: str, what: str) -> Column:
        head = F.concat(F.lit(f"**[{mark} 본문]** 텍스트 본문 없음 ({what} "), F.size(column).cast("string"), F.lit("개)"))
        return F.when(F.size(column) > 0, F.concat(head, F.when(labels(column) != "", F.concat(F.lit("\n\n"), labels(column))).otherwise(F.lit(""))))

    files = F.when((F.size(attachments) > 0) & (labels(attachments) != ""), F.concat(F.lit("**[첨부파일 공지]**\n\n"), labels(attachments)))
    have = F.nullif(F.col(content) if isinstance(content, str) else content, F.lit(""))
    return F.coalesce(have, body(images, "이미지", "이미지"), body(embeds, "동영상", "동영상"), files, F.lit(""))
