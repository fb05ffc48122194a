"""A workspace: one folder of Parquet tables, replaced as a whole or not at all.

Every save writes a new generation beside the old one and then moves a small pointer file;
readers see the one or the other, and a failed build leaves the old one untouched.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks import schema
from lodeworks.operators.query import EntityQuery, valid_identifier
from lodeworks.operators.sanitize import sanitization_status

POINTER = "CURRENT"


def _link(source: str, target: str) -> None:
    try:
        shutil.copytree(source, target, copy_function=os.link)
    except OSError:  # a file system without links
        shutil.rmtree(target, ignore_errors=True)
        shutil.copytree(source, target)


class Workspace:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    @property
    def exists(self) -> bool:
        return os.path.exists(os.path.join(self.root, POINTER))

    @property
    def current(self) -> str:
        with open(os.path.join(self.root, POINTER), encoding="utf-8") as f:
            return os.path.join(self.root, json.load(f)["generation"])

    def version(self) -> int:
        with open(os.path.join(self.root, POINTER), encoding="utf-8") as f:
            return json.load(f)["schema_version"]

    def save(self, tables: dict[str, DataFrame], unchanged: set[str] = frozenset()) -> None:
        """All tables as a new generation; the pointer moves last.

        The files of ``unchanged`` tables are linked from the present generation.
        """
        generation = f"g-{uuid.uuid4().hex}"
        target = os.path.join(self.root, generation)
        held = {n: os.path.join(self.current, n) for n in unchanged} if unchanged and self.exists else {}
        held = {n: path for n, path in held.items() if os.path.exists(path)}
        try:
            # Most tables are small; several jobs at once keep the executors busy.
            with ThreadPoolExecutor(8) as pool:
                list(pool.map(lambda name: _link(held[name], os.path.join(target, name)) if name in held else self._write(tables.get(name), name, target), schema.DDL))
        except BaseException:
            shutil.rmtree(target, ignore_errors=True)
            raise
        old = self.current if self.exists else None
        pending = os.path.join(self.root, POINTER + ".new")
        with open(pending, "w", encoding="utf-8") as f:
            json.dump({"generation": generation, "schema_version": schema.SCHEMA_VERSION}, f)
        os.replace(pending, os.path.join(self.root, POINTER))
        if old:
            shutil.rmtree(old, ignore_errors=True)

    def _write(self, df: DataFrame | None, name: str, target: str) -> None:
        df = schema.conform(df, name) if df is not None else self.spark.createDataFrame([], schema.DDL[name])
        df.write.parquet(os.path.join(target, name))

    def tables(self) -> dict[str, DataFrame]:
        version = self.version()
        if version > schema.SCHEMA_VERSION:
            raise schema.SchemaVersionError(f"schema version {version} is newer than this engine")
        found = {n: self.spark.read.parquet(os.path.join(self.current, n)) for n in schema.DDL if os.path.exists(os.path.join(self.current, n))}
        if version < schema.SCHEMA_VERSION:
            return schema.upgrade(found, version)
        schema.validate(found)
        return found

    def status(self) -> str:
        try:
            rows = self.tables()["metadata"].where(F.col("key").isin("sanitize_status", "sanitize_skipped")).collect()
        except Exception:
            return "unknown"
        return sanitization_status({r["key"]: r["value"] for r in rows})

    def query(self, allow_unverified: bool = False) -> EntityQuery:
        return EntityQuery(self.spark, self.tables(), self.status(), allow_unverified)

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """One table replaced by ``change`` of it, in a new generation; rows changed in number."""
        tables = self.tables()
        valid_identifier(table, tuple(schema.DDL))
        before = tables[table].count()
        tables[table] = change(tables[table])
        self.save(tables)
        return abs(self.tables()[table].count() - before)

    def execute_write(self, sql: str) -> int:
        """UPDATE, DELETE or INSERT of one table, by rewriting it; the number of affected rows."""
        text = sql.strip().rstrip(";")
        tables = self.tables()
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        if m := re.fullmatch(r"(?is)DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.+))?", text):
            name, test = valid_identifier(m[1], tuple(schema.DDL)), m[2] or "true"
            hit = F.coalesce(F.expr(test), F.lit(False))
            affected = tables[name].where(hit).count()
            tables[name] = tables[name].where(~hit)
        elif m := re.fullmatch(r"(?is)UPDATE\s+(\w+)\s+SET\s+(.+?)(?:\s+WHERE\s+(.+))?", text):
            name, test = valid_identifier(m[1], tuple(schema.DDL)), m[3] or "true"
            hit = F.coalesce(F.expr(test), F.lit(False))
            affected = tables[name].where(hit).count()
            new = {}
            for part in re.split(r",(?=\s*\w+\s*=)", m[2]):
                column, value = part.split("=", 1)
                new[valid_identifier(column.strip())] = F.when(hit, F.expr(value)).otherwise(F.col(column.strip()))
            tables[name] = tables[name].withColumns(new)
        elif m := re.fullmatch(r"(?is)INSERT\s+INTO\s+(\w+)\s*(\([^)]*\))?\s*((?:VALUES|SELECT).+)", text):
            name = valid_identifier(m[1], tuple(schema.DDL))
            rows = self.spark.sql(m[3] if m[3].lower().startswith("select") else f"SELECT * FROM {m[3]}")
            names = [c.strip() for c in m[2].strip("()").split(",")] if m[2] else tables[name].columns
            rows = schema.conform(rows.toDF(*names), name)
            affected = rows.count()
            tables[name] = tables[name].unionByName(rows)
        else:
            raise ValueError("only UPDATE, DELETE and INSERT of one table can be executed")
        self.save(tables)
        return affected
