"""Facets of a set of classified notices, one by one and as a cube over (audience, source group).

The cube has a cell for no filter, for each audience, and for each group within them; cells are keyed by '' for no filter.  Cells that don't filter by
group come from the notices themselves, so a notice of two groups counts once there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardlark.functions.text import facet_value
from boardlark.operators.classify import audience as audience_of
from boardlark.operators.classify import groups as groups_of
from boardlark.operators.classify import in_order
from boardlark.rules import CATEGORIES_MOST, CATEGORIES_SHOWN, ONE_OFF_MOST, UNIVERSITY, Taxonomy


def _values(df: DataFrame, column: Column) -> DataFrame:
    return df.select(column.alias("value")).where("value IS NOT NULL AND value <> ''").distinct()


def _ranked(values: DataFrame, order: tuple[str, ...], unknown: bool) -> DataFrame:
    """(value, ordinal): known values in their order; unknown ones after them, sorted, or not at all."""
    position = F.array_position(F.array(*[F.lit(g) for g in order]), F.col("value"))
    rows = values.withColumn("_p", position)
    rows = rows if unknown else rows.where("_p > 0")
    by = Window.orderBy(F.when(F.col("_p") > 0, F.col("_p")).otherwise(len(order) + 1), "value")  # as many rows as labels
    return rows.select("value", F.row_number().over(by).alias("ordinal"))


def audiences(df: DataFrame, taxonomy: Taxonomy = UNIVERSITY) -> DataFrame:
    return _ranked(_values(df, F.col("audience_group")), taxonomy.audience_order, False)


def source_groups(df: DataFrame, taxonomy: Taxonomy = UNIVERSITY) -> DataFrame:
    return _ranked(_values(df, F.explode("source_groups")), taxonomy.group_order, True)


def departments(df: DataFrame) -> DataFrame:
    return _values(df, facet_value("department"))


def scoped_sources(df: DataFrame, audience: Column | None = None, group: Column | None = None, taxonomy: Taxonomy = UNIVERSITY, names: str = "sources") -> Column:
    """A notice's sources that belong to the audience and group by themselves; all of them if none does.  names: the column of source names."""

    def belongs(source: Column) -> Column:
        alone = F.array(source)
        own = audience_of(alone, taxonomy)
        fits = F.lit(True)
        if audience is not None:
            fits = fits & (audience.isNull() | (own == audience))
        if group is not None:
            fits = fits & (group.isNull() | F.array_contains(groups_of(alone, own, F.col("title"), F.col("category"), taxonomy), group))
        return fits

    kept = F.filter(names, belongs)
    return F.when(F.size(kept) > 0, kept).otherwise(F.col(names))


def sources(df: DataFrame, audience: str | None = None, group: str | None = None, taxonomy: Taxonomy = UNIVERSITY, names: str = "sources") -> DataFrame:
    a, g = (F.lit(x) if x else None for x in (audience, group))
    return _values(df, F.explode(scoped_sources(df, a, g, taxonomy, names)))


def useful_category(value: Column) -> Column:
    return F.length(value).between(2, 24) & ~value.rlike("[<>]")


def categories(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., value): categories of two notices or more that look like one; none at all if there are too many or too many one-offs; the first 12."""
    by = by or []
    counts = df.select(*by, facet_value("category").alias("value")).where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n"))
    cell = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    counts = counts.withColumn("_all", F.count("*").over(cell)).withColumn("_once", F.sum((F.col("n") == 1).cast("int")).over(cell))
    kept = counts.where((F.col("n") >= 2) & useful_category(F.col("value")) & (F.col("_all") <= CATEGORIES_MOST) & (F.col("_once") / F.col("_all") <= ONE_OFF_MOST))
    return kept.withColumn("_r", F.row_number().over(cell.orderBy("value"))).where(F.col("_r") <= CATEGORIES_SHOWN).select(*by, "value")


def cube(df: DataFrame, taxonomy: Taxonomy = UNIVERSITY, names: str = "sources") -> DataFrame:
    """One row for each cell: audience, source_group ('' for none) and the five facets."""
    base = df.select("audience_group", "source_groups", names, "title", "category", "department")
    nothing = F.lit(None).cast("string")
    plain = base.withColumn("cells", F.array(F.struct(nothing.alias("a"), nothing.alias("g")), F.struct(F.col("audience_group").alias("a"), nothing.alias("g"))))
    grouped = F.flatten(F.transform(F.array_distinct("source_groups"), lambda g: F.array(F.struct(nothing.alias("a"), g.alias("g")), F.struct(F.col("audience_group").alias("a"), g.alias("g")))))
    # Every notice goes once to each cell it belongs to; the cells without a group hold it once, however many groups it has.
    rows = plain.withColumn("cell", F.explode(F.concat("cells", grouped))).withColumn("a", F.col("cell.a")).withColumn("g", F.col("cell.g"))
    enabled = F.col("a").isin(*taxonomy.source_filter_audiences) if taxonomy.source_filter_audiences else F.lit(False)
    scoped = F.when(F.coalesce(enabled, F.lit(False)), scoped_sources(rows, F.col("a"), F.col("g"), taxonomy, names)).otherwise(F.array().cast("array<string>"))
    listed = rows.groupBy("a", "g").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(scoped)))).alias("sources"), F.array_sort(F.collect_set(facet_value("department"))).alias("departments"))
    kept = categories(rows.withColumns({"a": F.coalesce("a", F.lit("")), "g": F.coalesce("g", F.lit(""))}), ["a", "g"]).groupBy("a", "g").agg(F.array_sort(F.collect_set("value")).alias("categories"))
    per_audience = rows.where("g IS NOT NULL").groupBy("a").agg(in_order(F.collect_set("g"), taxonomy.group_order).alias("source_groups"))
    seen = [r["value"] for r in audiences(df, taxonomy).orderBy("ordinal").collect()]  # at most the audiences of the taxonomy
    empty = F.array().cast("array<string>")
    out = listed.withColumns({"audience": F.coalesce("a", F.lit("")), "source_group": F.coalesce("g", F.lit(""))}).drop("a", "g")
    out = out.join(per_audience.select(F.coalesce("a", F.lit("")).alias("audience"), "source_groups"), "audience", "left")
    out = out.join(kept.select(F.col("a").alias("audience"), F.col("g").alias("source_group"), "categories"), ["audience", "source_group"], "left")
    every = F.array(*[F.lit(x) for x in seen]).cast("array<string>").alias("audience_groups")
    return out.select("audience", "source_group", every, F.coalesce("source_groups", empty).alias("source_groups"), "sources", F.coalesce("categories", empty).alias("categories"), "departments")
