"""CREATE, ALTER, TRUNCATE and DROP of tables and views: the session catalogue's entry and the registry's together."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandline.operators.catalog import Registry


def create_table(spark: SparkSession, registry: Registry, name: str, schema: str, engine: str = "sql") -> int:
    """A parquet table; the registry's entry comes last, so a failure leaves nothing registered."""
    if name.lower() in registry.tables:
        return registry.create(name, engine, schema)
    spark.sql(f"CREATE TABLE `{name.lower()}` ({schema}) USING parquet")
    return registry.create(name, engine, schema)


def add_column(spark: SparkSession, registry: Registry, name: str, column: str) -> None:
    """ALTER TABLE ... ADD COLUMN; rows that are there have nulls in it."""
    schema = registry.get(name)[2]
    spark.sql(f"ALTER TABLE `{name.lower()}` ADD COLUMNS ({column})")
    registry.alter(name, f"{schema}, {column}")


def truncate_table(spark: SparkSession, registry: Registry, name: str) -> None:
    registry.get(name)
    spark.sql(f"TRUNCATE TABLE `{name.lower()}`")


def create_view(spark: SparkSession, registry: Registry, name: str, query: str, tables: list[str]) -> int:
    """A view over tables of one engine, under whose name it is routed."""
    engine = registry.route(tables)
    if name.lower() not in registry.tables:
        spark.sql(f"CREATE VIEW `{name.lower()}` AS {query}")
    return registry.create(name, engine, query)


def drop_view(spark: SparkSession, registry: Registry, name: str) -> None:
    registry.drop(name)
    spark.sql(f"DROP VIEW IF EXISTS `{name.lower()}`")


def drop_table(spark: SparkSession, registry: Registry, name: str) -> None:
    registry.drop(name)
    spark.sql(f"DROP TABLE IF EXISTS `{name.lower()}`")
