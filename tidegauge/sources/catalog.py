"""The example ecosystem: tables, dependencies and latency profiles, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: name, layer, source, hour, criticality, latency mean, deviation, weekend factor, dependencies
TABLES = (
    ("raw_orders", 0, "postgres_prod", 1, "HIGH", 18, 3.2, 0.6, ""),
    ("raw_customers", 0, "postgres_prod", 1, "HIGH", 12, 2.1, 0.5, ""),
    ("raw_products", 0, "postgres_prod", 1, "MEDIUM", 8, 1.5, 1.0, ""),
    ("raw_inventory", 0, "erp_api", 2, "HIGH", 35, 6.8, 0.3, ""),
    ("raw_payments", 0, "payment_gateway", 1, "HIGH", 22, 4.1, 0.7, ""),
    ("raw_sessions", 0, "clickstream_s3", 3, "LOW", 55, 9.2, 1.3, ""),
    ("raw_support_tickets", 0, "zendesk_api", 4, "LOW", 28, 5.5, 0.4, ""),
    ("stg_orders", 1, "dbt", 3, "HIGH", 14, 2.8, 0.6, "raw_orders raw_customers"),
    ("stg_payments", 1, "dbt", 3, "HIGH", 16, 3.1, 0.7, "raw_payments raw_orders"),
    ("stg_inventory", 1, "dbt", 4, "MEDIUM", 20, 4.0, 0.4, "raw_inventory raw_products"),
    ("stg_sessions", 1, "dbt", 5, "LOW", 38, 7.0, 1.2, "raw_sessions raw_customers"),
    ("int_order_payments", 1, "dbt", 5, "HIGH", 25, 4.5, 0.6, "stg_orders stg_payments"),
    ("int_fulfillment", 1, "dbt", 5, "HIGH", 22, 4.2, 0.4, "stg_orders stg_inventory"),
    ("int_customer_ltv", 1, "dbt", 6, "MEDIUM", 45, 8.5, 0.8, "stg_orders stg_sessions stg_payments"),
    ("mart_revenue", 2, "dbt", 7, "CRITICAL", 18, 3.5, 0.5, "int_order_payments"),
    ("mart_inventory_health", 2, "dbt", 7, "HIGH", 15, 2.9, 0.4, "int_fulfillment stg_inventory"),
    ("mart_customer_360", 2, "dbt", 8, "HIGH", 30, 5.5, 0.7, "int_customer_ltv int_order_payments"),
    ("mart_ops_dashboard", 2, "dbt", 8, "CRITICAL", 12, 2.2, 0.5, "mart_revenue mart_inventory_health"),
    ("mart_support_kpis", 2, "dbt", 8, "MEDIUM", 20, 3.8, 0.3, "int_customer_ltv raw_support_tickets"),
    ("mart_exec_summary", 2, "dbt", 9, "CRITICAL", 25, 4.5, 0.4, "mart_revenue mart_customer_360 mart_ops_dashboard"),
    ("mart_finance_close", 2, "spark_job", 6, "CRITICAL", 48, 9.1, 0.2, "stg_payments int_order_payments"),
    ("mart_churn_signals", 2, "ml_pipeline", 7, "MEDIUM", 65, 12.0, 0.9, "int_customer_ltv stg_sessions"),
)
NAMES = tuple(t[0] for t in TABLES)
EDGES = tuple((parent, t[0]) for t in TABLES for parent in t[8].split())


def nodes(spark: SparkSession, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(table_name, layer, source, schedule_hour, criticality); `names` renames the tables in order."""
    return spark.createDataFrame([(n, *t[1:5]) for n, t in zip(names, TABLES, strict=True)], "table_name string, layer int, source string, schedule_hour int, criticality string")


def edges(spark: SparkSession, names: tuple[str, ...] = NAMES) -> DataFrame:
    """(parent, child)."""
    renamed = dict(zip(NAMES, names, strict=True))
    return spark.createDataFrame([(renamed[a], renamed[b]) for a, b in EDGES], "parent string, child string")
