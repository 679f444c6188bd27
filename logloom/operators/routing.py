"""Which provider serves a model id, and which catalogue entries are real."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _claims(providers: DataFrame, column: str) -> DataFrame:
    """(claim, provider, place): place is the order of declaration."""
    return providers.select(
        "provider", "position", F.posexplode(F.coalesce(F.col(column), F.array().cast("array<string>"))).alias("pos", "claim")
    ).select("claim", "provider", F.struct("position", "pos").alias("place"))


def _first_claim(claims: DataFrame, name: str) -> DataFrame:
    return claims.groupBy("claim").agg(F.min(F.struct("place", "provider")).alias(name))


def route_models(models: DataFrame, providers: DataFrame, default: str | None = None, model: str = "model") -> DataFrame:
    """Provider per distinct model id: exact id, else declared prefix, else default.

    Among several matching prefixes the first declared wins.  Instead of
    comparing every id with every prefix, an id is joined to the prefixes by
    its own leading substrings, of just the lengths that are declared.
    """
    ids = models.select(F.col(model).alias("model")).where(F.col("model").isNotNull()).distinct()
    exact = _first_claim(_claims(providers, "models"), "__exact").withColumnRenamed("claim", "model")
    prefixes = _first_claim(_claims(providers, "prefixes"), "__hit")
    lengths = prefixes.agg(F.collect_set(F.length("claim")).alias("n")).scalar()
    heads = ids.select("model", F.explode(lengths).alias("n")).where(F.length("model") >= F.col("n"))
    by_prefix = (
        heads.select("model", F.left("model", F.col("n")).alias("claim"))
        .join(prefixes, "claim")
        .groupBy("model")
        .agg(F.min("__hit").alias("__prefix"))
    )
    routed = ids.join(exact, "model", "left").join(by_prefix, "model", "left")
    fallback = F.lit(default).cast("string")
    return routed.select(
        "model",
        F.coalesce(F.col("__exact.provider"), F.col("__prefix.provider"), fallback, F.lit("unrouted")).alias("provider"),
        F.when(F.col("__exact").isNotNull(), "exact")
        .when(F.col("__prefix").isNotNull(), "prefix")
        .when(fallback.isNotNull(), "default")
        .otherwise("unrouted")
        .alias("matched_by"),
    )


def attach_provider(df: DataFrame, routes: DataFrame, model: str = "model") -> DataFrame:
    """Routes joined back to full rows; the route table has one row per distinct id."""
    return df.join(routes.select(F.col("model").alias(model), "provider"), model, "left")


def candidate_ids(providers: DataFrame, reached: DataFrame, fetched: DataFrame, previous: DataFrame) -> DataFrame:
    """(provider, status, id) to list: fetched ids, else the last good ones, else declared.

    `reached` holds the providers that answered, `fetched` and `previous` one row
    per (provider, id).
    """
    answered = reached.select("provider", F.lit("ok").alias("__now")).distinct()
    known = previous.select("provider", F.lit("stale").alias("__old")).distinct()
    state = (
        providers.join(answered, "provider", "left")
        .join(known, "provider", "left")
        .select("provider", "models", F.coalesce("__now", "__old", F.lit("declared")).alias("status"))
    )

    def listed(status: str, ids: DataFrame) -> DataFrame:
        return state.where(F.col("status") == status).join(ids, "provider").select("provider", "status", "id")

    declared = state.where(F.col("status") == "declared").select("provider", "status", F.explode("models").alias("id"))
    ids = ("provider", "id")
    return listed("ok", fetched.select(*ids)).unionByName(listed("stale", previous.select(*ids))).unionByName(declared)


def routable_catalog(candidates: DataFrame, providers: DataFrame, default: str | None = None) -> DataFrame:
    """Candidate ids kept only where routing sends the id to that very provider.

    `candidates` is (provider, status, id), one row per id.
    """
    routes = route_models(candidates, providers, default, model="id").select(
        F.col("model").alias("id"), F.col("provider").alias("__to")
    )
    return candidates.join(routes, "id").where(F.col("provider") == F.col("__to")).select("provider", "status", "id").distinct()


def catalog_counts(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Routable ids per listed provider, 0 where none of its ids is routed to it."""
    listed = candidates.select("provider", "status").distinct()
    counts = catalog.groupBy("provider").agg(F.count("*").alias("n"))
    return listed.join(counts, "provider", "left").select(
        "provider", "status", F.coalesce("n", F.lit(0)).cast("bigint").alias("routable")
    )
