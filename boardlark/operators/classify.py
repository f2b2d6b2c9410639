"""Two-level classification by ordered rules, compiled from a Taxonomy to column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardlark.functions.text import facet_value, filter_value, includes_any, source_names
from boardlark.rules import UNIVERSITY, Taxonomy


def _array(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def in_order(groups: Column, order: tuple[str, ...]) -> Column:
    """Distinct values, known ones in their order, then unknown ones sorted."""
    known = _array(order)
    rest = F.array_sort(F.array_except(groups, known))
    return F.concat(F.filter(known, lambda g: F.array_contains(groups, g)), rest)


def audience(names: Column, taxonomy: Taxonomy = UNIVERSITY) -> Column:
    """The audience of a list of source names: the first rule that fits."""
    joined = F.array_join(names, " ")
    out = None
    for label, needles, exact in taxonomy.audience_rules:
        fits = F.arrays_overlap(names, _array(needles)) if exact else includes_any(joined, needles)
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return F.when(F.size(names) == 0, taxonomy.default_audience).otherwise(out.otherwise(taxonomy.default_audience))


def common_group(title: Column, category: Column, taxonomy: Taxonomy = UNIVERSITY) -> Column:
    """The group that category and title name, in rule order."""
    value = F.concat_ws(" ", F.coalesce(facet_value(category), F.lit("")), F.coalesce(title, F.lit("")))
    _, rules, default = taxonomy.common
    out = F
    for group, needles in rules:
        out = out.when(includes_any(value, needles), group)
    return out.otherwise(default) if rules else F.lit(default)


def per_source_groups(names: Column, taxonomy: Taxonomy = UNIVERSITY) -> Column:
    """The groups of each source, first rule that fits it, as a set in known order."""
    _, rules, _ = taxonomy.per_source

    def one(name: Column) -> Column:
        out = F
        for group, needles in rules:
            out = out.when(includes_any(name, needles), group)
        return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")

    return in_order(F.array_distinct(F.array_compact(F.transform(names, one))), taxonomy.group_order)


def groups(names: Column, of_audience: Column, title: Column, category: Column, taxonomy: Taxonomy = UNIVERSITY) -> Column:
    """The groups of a notice within its audience; empty for audiences without any."""
    joined = F.array_join(names, " ")
    out = F.when(of_audience == taxonomy.common[0], F.array(common_group(title, category, taxonomy)))
    own = per_source_groups(names, taxonomy)
    out = out.when(of_audience == taxonomy.per_source[0], F.when(F.size(own) > 0, own).otherwise(_array(taxonomy.per_source[2])))
    for label, (rules, first_only, default) in taxonomy.joined.items():
        met = F.array_compact(F.array(*[F.when(F.contains(joined, F.lit(needle)), F.lit(group)) for group, needle in rules]))
        met = F.slice(met, 1, 1) if first_only else in_order(met, taxonomy.group_order)
        out = out.when(of_audience == label, F.when(F.size(met) > 0, met).otherwise(_array(default)))
    return out.otherwise(F.array().cast("array<string>"))


def classified(df: DataFrame, taxonomy: Taxonomy = UNIVERSITY) -> DataFrame:
    """Adds source_names, audience_group, source_groups and source_group (the first of them) to rows with title, source, sources and category."""
    df = df.withColumn("source_names", source_names("sources", "source"))
    df = df.withColumn("audience_group", audience(F.col("source_names"), taxonomy))
    df = df.withColumn("source_groups", groups(F.col("source_names"), F.col("audience_group"), F.col("title"), F.col("category"), taxonomy))
    return df.withColumn("source_group", F.get("source_groups", F.lit(0)))


def by_audience(df: DataFrame, wanted: str | None) -> DataFrame:
    """Rows of an audience; all rows for a token that means no filter."""
    value = filter_value(F.lit(wanted))
    return df.where(value.isNull() | (F.col("audience_group") == value))


def by_group(df: DataFrame, wanted: str | None) -> DataFrame:
    value = filter_value(F.lit(wanted))
    return df.where(value.isNull() | F.array_contains("source_groups", value))
