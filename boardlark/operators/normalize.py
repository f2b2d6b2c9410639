"""Raw notices of any shape to canonical ones.

A raw table has `_ord` (the position in its array, from 0) and `raw` (one JSON object as text), as sources.snapshot reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlark.functions.dates import normalize_date
from boardlark.functions.text import blank_to_null, non_blank, slug
from boardlark.operators.markdown import normalized_content
from boardlark.rules import ALIASES, ATTACHMENT_NAME, NO_CONTENT, NO_TITLE


def _string(key: str) -> Column:
    """The value if it is a JSON string."""
    value = F.try_variant_get("_v", f"$.{key}", "string")
    return F.when(F.schema_of_variant(F.expr(f"variant_get(_v, '$.{key}')")) == "STRING", value)


def _strings(key: str) -> Column:
    """A JSON string, or the strings of a JSON array, as a list without blanks."""
    items = F.expr(f"transform(try_variant_get(_v, '$.{key}', 'array<variant>'), x -> CASE WHEN schema_of_variant(x) = 'STRING' THEN try_variant_get(x, '$', 'string') END)")
    single = _string(key)
    return non_blank(F.when(single.isNotNull(), F.array(single)).otherwise(items))


def _first(keys: tuple[str, ...]) -> Column:
    return F.coalesce(*[blank_to_null(_string(k)) for k in keys])


def _first_list(keys: tuple[str, ...]) -> Column:
    out = F
    for k in keys:
        out = out.when(F.size(_strings(k)) > 0, _strings(k))
    return out.otherwise(F.array().cast("array<string>"))


def attachments(key: str = "attachments") -> Column:
    """Strings become unnamed attachments; objects give url (or href, link) and name (or filename, title); what has no url goes."""
    part = lambda *names: "coalesce(" + ", ".join(f"nullif(trim(try_variant_get(x, '$.{n}', 'string')), '')" for n in names) + ")"
    one = f"""CASE WHEN schema_of_variant(x) = 'STRING' THEN named_struct('name', '{ATTACHMENT_NAME}', 'url', nullif(trim(try_variant_get(x, '$', 'string')), ''))
    WHEN schema_of_variant(x) LIKE 'OBJECT%' THEN named_struct('name', coalesce({part("name", "filename", "title")}, '{ATTACHMENT_NAME}'), 'url', {part("url", "href", "link")}) END"""
    return F.coalesce(F.expr(f"filter(transform(try_variant_get(_v, '$.{key}', 'array<variant>'), x -> {one}), a -> a.url IS NOT NULL)"), F.array().cast("array<struct<name:string,url:string>>"))


def tags(raw: Column, categories: Column, sources: Column) -> Column:
    return F.array_distinct(F.concat(raw, categories, sources))


def notices(raw: DataFrame, render: bool = True) -> DataFrame:
    """Canonical notices in input order (_ord).  render: turn HTML bodies into Markdown."""
    d = raw.withColumn("_v", F.try_parse_json("raw")).where(F.schema_of_variant("_v").startswith("OBJECT"))
    # A field that is there but of no use still hides the later date fields.
    date = F.coalesce(*[F.nullif(_string(k), F.lit("")) for k in ALIASES["date"]])
    d = d.select(
        "_ord",
        F.coalesce(_first(ALIASES["title"]), F.concat(F.lit(NO_TITLE), (F.col("_ord") + 1).cast("string"))).alias("title"),
        F.coalesce(_first(ALIASES["content"]), F.lit(NO_CONTENT)).alias("content"),
        _first_list(ALIASES["source"]).alias("sources"),
        _first_list(ALIASES["category"]).alias("categories"),
        _first(ALIASES["department"]).alias("department"),
        _first(ALIASES["url"]).alias("url"),
        normalize_date(date).alias("published_at"),
        _first(ALIASES["id"]).alias("given"),
        _strings("tags").alias("raw_tags"),
        attachments().alias("attachments"),
    )
    d = d.withColumns({"source": F.get("sources", F.lit(0)), "category": F.get("categories", F.lit(0))})
    seed = F.concat_ws("-", "title", F.coalesce("published_at", F.lit("")), F.coalesce("source", F.lit("")), (F.col("_ord") + 1).cast("string"))
    return d.select(
        F.coalesce("given", slug(seed)).alias("id"), "title", (normalized_content("content") if render else F.col("content")).alias("content"), "url", "source", "sources", "category", "department",
        "published_at", tags(F.col("raw_tags"), F.col("categories"), F.col("sources")).alias("tags"), "attachments", "_ord",
    )


def suffixed_ids(df: DataFrame) -> DataFrame:
    """The k-th row of an id, in input order, becomes id-k; the first keeps it."""
    k = F.row_number().over(Window.partitionBy("id").orderBy("_ord"))
    return df.withColumn("_k", k).withColumn("id", F.when(F.col("_k") > 1, F.concat_ws("-", "id", "_k")).otherwise(F.col("id"))).drop("_k")


def required_failure(title: Column | str, content: Column | str) -> Column:
    """Why a row can't be used (required_field_empty:title,content), or null."""
    missing = F.array_compact(F.array(F.when(blank_to_null(title).isNull(), "title"), F.when(blank_to_null(content).isNull(), "content")))
    return F.when(F.size(missing) > 0, F.concat(F.lit("required_field_empty:"), F.array_join(missing, ",")))
