"""Span prices and cost reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmill.functions import times
from spanmill.functions.genai import canonical_model


def price_book(pricing: DataFrame) -> DataFrame:
    """One row per canonical model with its prices by exact name and provider, by provider, by name, and any.

    A dated name and its plain form share a row and keep their own prices: ``exact`` is looked up first. ``by_provider``
    and ``any_provider`` serve names that are not listed; they prefer the plain name, then the latest version (a list
    without dates counts as oldest), then the name. ``colliding`` counts (name, provider) pairs listed with several
    prices of one version, of which the lowest is taken.
    """
    price = F.struct(F.col("input_cost_per_1k").alias("input"), F.col("output_cost_per_1k").alias("output"))
    listed = pricing.select(
        canonical_model("model_name").alias("price_key"), "model_name", "provider", price.alias("price"),
        F.coalesce("updated_at", F.timestamp_seconds(F.lit(0))).alias("version"),
    ).distinct()
    # Partitioned once by the outer key, which serves all groupings.
    versions = listed.repartition("price_key").groupBy("price_key", "model_name", "provider", "version").agg(
        F.min("price").alias("price"), (F.count(F.lit(1)) > 1).cast("int").alias("several")
    )
    names = versions.groupBy("price_key", "model_name", "provider").agg(
        F.max("version").alias("version"), F.max_by("price", "version").alias("price"), F.max_by("several", "version").alias("several")
    )
    plain = (F.col("model_name") == F.col("price_key")).cast("int")
    providers = names.groupBy("price_key", "provider").agg(
        F.collect_list(F.struct(F.concat_ws("\n", "model_name", "provider").alias("name"), "price")).alias("exact"),
        F.collect_list(F.struct("model_name", "price")).alias("names"),
        F.max_by("price", F.struct(plain, "version", "model_name")).alias("price"), F.sum("several").alias("several"),
    )
    by_name = F.flatten(F.collect_list("names"))
    return providers.groupBy("price_key").agg(
        F.map_from_entries(F.flatten(F.collect_list("exact"))).alias("exact"),
        F.map_from_entries(F.collect_list(F.struct("provider", "price"))).alias("by_provider"),
        F.array_sort(by_name).alias("by_name"),
        F.min_by("price", "provider").alias("any_provider"), F.sum("several").alias("colliding"),
    )


def price_spans(spans: DataFrame, pricing: DataFrame) -> DataFrame:
    """``cost_usd`` from tokens and prices per 1000; unpriced spans stay null.

    Looks up the exact (provider, name), then the canonical model of the provider, then the exact name and at last the
    model under any provider, which prices wrapper providers. One left join: it is a broadcast while the price list is
    below Spark's broadcast threshold and a shuffle join beyond it.
    """
    named = F.filter("by_name", lambda n: n["model_name"] == F.col("model"))
    price = F.coalesce(
        F.try_element_at("exact", F.concat_ws("\n", "model", "provider")), F.try_element_at("by_provider", F.col("provider")),
        F.get(named, F.lit(0))["price"], F.col("any_provider"),
    )
    return (
        spans.withColumn("price_key", canonical_model("model"))
        .join(price_book(pricing), "price_key", "left")
        .withColumn("_price", price)
        .withColumn(
            "cost_usd",
            F.col("input_tokens") / 1000 * F.col("_price.input")
            + F.col("output_tokens") / 1000 * F.col("_price.output"),
        )
        .drop("price_key", "exact", "by_provider", "by_name", "any_provider", "colliding", "_price")
    )


def total_cost(spans: DataFrame, as_of, **width: int) -> DataFrame:
    """Sum over the last hour, 0 when there is none."""
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 1})))
    return recent.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"))


def cost_by_model(spans: DataFrame, as_of, **width: int) -> DataFrame:
    """Cost per model over the last 24 hours, highest first, with the unpriced spans."""
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 24})))
    return (
        recent.groupBy("model")
        .agg(F.sum("cost_usd").alias("cost"), F.count_if(F.col("cost_usd").isNull()).alias("unpriced_spans"))
        .orderBy(F.col("cost").desc_nulls_last(), "model")
    )


def cost_per_user(spans: DataFrame, as_of, **width: int) -> DataFrame:
    recent = spans.filter(times.within("start_time", as_of, **(width or {"hours": 24})))
    return recent.groupBy("user_id").agg(
        F.sum("cost_usd").alias("cost"), F.count(F.lit(1)).alias("span_count")
    )


def avg_cost_per_user(spans: DataFrame, as_of, **width: int) -> DataFrame:
    return cost_per_user(spans, as_of, **width).agg(
        F.avg("cost").alias("avg_cost_per_user"), F.count(F.lit(1)).alias("users")
    )


def daily_cost(spans: DataFrame, budget_usd: float = 100.0) -> DataFrame:
    """Cost per day, and whether the day went over the budget."""
    return (
        spans.groupBy(times.day_of("start_time").alias("day"))
        .agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"))
        .withColumn("over_budget", F.col("cost") > budget_usd)
        .orderBy("day")
    )
