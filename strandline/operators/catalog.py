"""Catalogue: tables and their engines, routing, zero-DDL, permissions, schema history, audit log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import logs, metrics
from strandline.sources.store import _exists

ALL_TABLES = 0
ACTIONS = ("READ", "WRITE", "DDL")


class CatalogError(LookupError):
    """A table that is not there, or a statement that spans engines."""


def auto_engine(table: str) -> tuple[str, str]:
    """(engine, schema) of a table that an insert creates: names with `log` are logs, the rest metrics."""
    return ("logs", logs.SCHEMA) if "log" in table.lower() else ("metrics", metrics.SCHEMA)


@dataclass
class Registry:
    """Names in any case; each change counts the schema version up and is kept in the history."""

    tables: dict[str, tuple[int, str, str]] = field(default_factory=dict)  # name -> (id, engine, schema)
    version: int = 0
    history: list[tuple[int, str, str, str, str]] = field(default_factory=list)  # version, action, table, engine, schema
    saved: int = 0  # changes that are in the stored history

    def create(self, name: str, engine: str, schema: str) -> int:
        if name.lower() in self.tables:
            raise CatalogError(f"table {name} exists")
        self.version += 1
        number = 1 + max((t[0] for t in self.tables.values()), default=0)
        self.tables[name.lower()] = (number, engine, schema)
        self.history.append((self.version, "CREATE", name.lower(), engine, schema))
        return number

    def drop(self, name: str) -> None:
        number, engine, schema = self.get(name)
        del self.tables[name.lower()]
        self.version += 1
        self.history.append((self.version, "DROP", name.lower(), engine, schema))

    def alter(self, name: str, schema: str) -> None:
        number, engine, _ = self.get(name)
        self.version += 1
        self.tables[name.lower()] = (number, engine, schema)
        self.history.append((self.version, "ALTER", name.lower(), engine, schema))

    HISTORY = "version int, action string, name string, engine string, schema string"

    def history_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.history, self.HISTORY)

    def save(self, spark: SparkSession, path: str) -> None:
        """Appends the changes since the last save to the stored history, an append-only table. Two sessions that made
        the same version do not both save: the later one is refused."""
        stored = 0
        if _exists(spark, path):
            stored = spark.read.schema(self.HISTORY).parquet(path).agg(F.max("version")).first()[0] or 0
        if stored != self.saved:
            raise CatalogError(f"another session has saved version {stored}")
        if new := [h for h in self.history if h[0] > self.saved]:
            spark.createDataFrame(new, self.HISTORY).coalesce(1).write.mode("append").parquet(path)
            self.saved = self.version

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Registry:
        """The registry of a stored history, its changes made again in order."""
        out = cls()
        for version, action, name, engine, schema in spark.read.schema(cls.HISTORY).parquet(path).orderBy("version").collect():
            if action == "CREATE":
                out.create(name, engine, schema)
            elif action == "ALTER":
                out.alter(name, schema)
            else:
                out.drop(name)
            if out.version != version:
                raise CatalogError(f"the history lacks version {out.version}")
        out.saved = out.version
        return out

    def get(self, name: str) -> tuple[int, str, str]:
        if name.lower() not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[name.lower()]

    def route(self, names: list[str]) -> str:
        """The engine of a statement's tables, which must be one."""
        engines = {self.get(n)[1] for n in names}
        if len(engines) != 1:
            raise CatalogError("tables of several engines")
        return engines.pop()

    def for_insert(self, name: str) -> tuple[int, str, str]:
        """The table of an insert, created by its name if it is not there."""
        if name.lower() not in self.tables:
            self.create(name, *auto_engine(name))
        return self.get(name)


def effective_permissions(users: DataFrame, user_roles: DataFrame, roles: DataFrame, grants: DataFrame, tables: DataFrame) -> DataFrame:
    """(user_id, table_id, action) that users may do: grants of their roles that exist, table 0 meaning every table;
    a role with `is_admin` may do all. The five tables are small ones of the catalogue."""
    held = users.select("user_id").join(user_roles, "user_id").join(roles.select("role_id", "is_admin"), "role_id")
    granted = held.filter("NOT is_admin").join(grants, "role_id").select("user_id", F.col("table_id").alias("on_table"), "action")
    every = tables.select("table_id")
    wide = granted.filter(F.col("on_table") == ALL_TABLES).select("user_id", "action").crossJoin(every).select("user_id", "table_id", "action")
    own = granted.filter(F.col("on_table") != ALL_TABLES).join(every, F.col("on_table") == F.col("table_id"), "left_semi").select("user_id", F.col("on_table").alias("table_id"), "action")
    admin = held.filter("is_admin").select("user_id").crossJoin(every).select("user_id", "table_id", F.explode(F.array(*map(F.lit, ACTIONS))).alias("action"))
    return own.unionByName(wide).unionByName(admin).distinct()
