"""All registered queries."""

from workloads import q_analytics, q_backtest, q_falsify, q_features, q_models, q_operations, q_options  # noqa: F401
from workloads.registry import QUERIES, oracle_statements  # noqa: F401
