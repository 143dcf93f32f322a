"""Soil units: links down the hierarchy, component mixtures and horizon states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import stripped


def missing_links(units: DataFrame, legends: DataFrame, components: DataFrame) -> DataFrame:
    """(mukey, missing) for units whose legend or components are not there."""
    no_legend = units.join(legends.select("lkey"), "lkey", "left_anti").select("mukey", F.concat(F.lit("legend:"), F.col("lkey").cast("string")).alias("missing"))
    no_parts = units.join(components.select("mukey"), "mukey", "left_anti").select("mukey", F.concat(F.lit("components:"), F.col("mukey").cast("string")).alias("missing"))
    return no_legend.unionByName(no_parts)


def mixtures(components: DataFrame) -> DataFrame:
    """Per unit: components, exact listed total, unlisted rest and percentage state. Nothing is normalised."""
    text = stripped(F.col("percent").cast("string"))
    value = F.when(text != "", text.cast("decimal(12,4)"))
    s = components.groupBy("mukey").agg(F.count("*").alias("component_count"), F.count(value).alias("_known"), F.sum(value).alias("_sum"))
    total = F.when(F.col("_known") == F.col("component_count"), F.col("_sum"))
    state = F.when(total.isNull(), "unknown").when(total < 100, "under_100").when(total > 100, "over_100").otherwise("sums_to_100")
    return s.select("mukey", "component_count", total.alias("listed_total"), F.when(total <= 100, 100 - total).alias("unlisted"), state.alias("percentage_state"))


def horizon_states(components: DataFrame, horizons: DataFrame) -> DataFrame:
    """Per component: horizons and whether their absence needs review."""
    n = horizons.groupBy("cokey").agg(F.count("*").alias("_n"))
    count = F.coalesce("_n", F.lit(0))
    state = F.when(count > 0, "records_present").when(F.col("compkind") == "Miscellaneous area", "absent_miscellaneous_area").otherwise("absent_requires_review")
    return components.join(n, "cokey", "left").select("cokey", count.alias("horizon_count"), state.alias("horizon_state"))


def horizon_adjacency(horizons: DataFrame) -> DataFrame:
    """Gaps and overlaps between a component's horizons in order of depth."""
    from lodestrata.operators.sequences import adjacency_class, adjacent_pairs

    pairs = adjacent_pairs(horizons.select("cokey", "chkey", "top", "bottom"), ["cokey"], ["top", "chkey"], ["top"])
    return pairs.select("cokey", "chkey", adjacency_class(F.col("bottom"), F.col("next_top")).alias("relation"))
