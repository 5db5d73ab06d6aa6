"""All registered queries."""

from __future__ import annotations

from tallygrain.plans.anomaly_queries import ANOMALY
from tallygrain.plans.base import Query
from tallygrain.plans.churn_queries import CHURN
from tallygrain.plans.contract_queries import CONTRACTS
from tallygrain.plans.feature_queries import FEATURES
from tallygrain.plans.forecast_queries import FORECAST
from tallygrain.plans.kpi_queries import KPI
from tallygrain.plans.profile_queries import PROFILE
from tallygrain.plans.retrieval_queries import RETRIEVAL
from tallygrain.plans.source_queries import SOURCE
from tallygrain.plans.statistics_queries import STATISTICS

FAMILIES = (KPI, CONTRACTS, PROFILE, STATISTICS, FEATURES, FORECAST, ANOMALY, CHURN, RETRIEVAL, SOURCE)


def queries() -> dict[str, Query]:
    return {name: query for family in FAMILIES for name, query in family.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.sql.items()}
