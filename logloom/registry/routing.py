"""Queries on model routing and provider catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import fixtures as fx
from logloom.operators import routing
from logloom.registry.base import query, with_ctes

DEFAULT = "campus"
# name, exact ids, prefixes; in declared order.
PROVIDERS = (
    ("campus", [], []),
    ("vendor", ["standard"], ["acme/", "~"]),
    ("deep", [], ["acme/deep/"]),
    ("direct", [], ["claude-"]),
    ("lab", ["local4", "local9", "economy"], ["local4", "local9", "economy"]),
)


def _providers(spark: SparkSession) -> DataFrame:
    rows = [(n, i, m, p) for i, (n, m, p) in enumerate(PROVIDERS)]
    return spark.createDataFrame(rows, "provider string, position int, models array<string>, prefixes array<string>")


_ROUTE = """routes AS (
  SELECT model, CASE WHEN model = 'standard' THEN 'vendor' WHEN model IN ('local4', 'local9', 'economy') THEN 'lab'
    WHEN starts_with(model, 'acme/') OR starts_with(model, '~') THEN 'vendor' WHEN starts_with(model, 'claude-') THEN 'direct'
    WHEN starts_with(model, 'local4') OR starts_with(model, 'local9') OR starts_with(model, 'economy') THEN 'lab' ELSE {default} END AS provider,
  CASE WHEN model IN ('standard', 'local4', 'local9', 'economy') THEN 'exact'
    WHEN starts_with(model, 'acme/') OR starts_with(model, '~') OR starts_with(model, 'claude-') OR starts_with(model, 'local4')
      OR starts_with(model, 'local9') THEN 'prefix' ELSE {how} END AS matched_by
  FROM (SELECT DISTINCT model FROM ids) d)"""
IDS = f"ids AS ({fx.MODEL_IDS})"


@query("route_models", with_ctes(IDS, _ROUTE.format(default="'campus'", how="'default'"), body="SELECT * FROM routes"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_models(fx.run_view(spark, sf_dir, fx.MODEL_IDS, "part"), _providers(spark), DEFAULT)


@query("route_models_strict", with_ctes(IDS, _ROUTE.format(default="'unrouted'", how="'unrouted'"), body="SELECT * FROM routes"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_models(fx.run_view(spark, sf_dir, fx.MODEL_IDS, "part"), _providers(spark), None)


@query(
    "attach_provider",
    with_ctes(IDS, _ROUTE.format(default="'campus'", how="'default'"), body="SELECT r.provider, count(*) AS parts FROM ids JOIN routes r USING (model) GROUP BY 1"),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.run_view(spark, sf_dir, fx.MODEL_IDS, "part")
    routes = routing.route_models(ids, _providers(spark), DEFAULT)
    return routing.attach_provider(ids, routes).groupBy("provider").agg(F.count("*").alias("parts"))


# Which provider lists an id goes by part key: campus and vendor answer, direct
# only has an older list, deep and lab have neither.
_OWNER = "CASE WHEN p_partkey % 3 = 0 THEN 'campus' WHEN p_partkey % 3 = 1 THEN 'vendor' ELSE 'direct' END"
_CANDIDATES = f"""cand AS (
  SELECT DISTINCT {_OWNER} AS provider, CASE WHEN p_partkey % 3 = 2 THEN 'stale' ELSE 'ok' END AS status, model AS id FROM ids
  UNION ALL SELECT 'lab', 'declared', 'local4' UNION ALL SELECT 'lab', 'declared', 'local9' UNION ALL SELECT 'lab', 'declared', 'economy')"""


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    owned = fx.run_view(spark, sf_dir, f"SELECT {_OWNER} AS provider, model AS id FROM (SELECT p_partkey, model FROM ({fx.MODEL_IDS}) i) j", "part").distinct()
    providers = _providers(spark)
    fetched = owned.where(F.col("provider") != "direct")
    previous = owned.where(F.col("provider") == "direct")
    reached = fetched.select("provider")
    candidates = routing.candidate_ids(providers, reached, fetched, previous)
    return candidates, routing.routable_catalog(candidates, providers, DEFAULT)


@query(
    "routable_catalog",
    with_ctes(
        IDS, _CANDIDATES, _ROUTE.format(default="'campus'", how="'default'").replace("FROM ids", "FROM (SELECT id AS model FROM cand) c"),
        body="SELECT c.provider, c.status, c.id FROM cand c JOIN routes r ON r.model = c.id AND r.provider = c.provider",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir)[1]


@query(
    "catalog_counts",
    with_ctes(
        IDS, _CANDIDATES, _ROUTE.format(default="'campus'", how="'default'").replace("FROM ids", "FROM (SELECT id AS model FROM cand) c"),
        body="""SELECT c.provider, c.status, count(r.model) AS routable FROM cand c LEFT JOIN routes r ON r.model = c.id AND r.provider = c.provider GROUP BY 1, 2""",
    ),
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.catalog_counts(*_catalog(spark, sf_dir))
