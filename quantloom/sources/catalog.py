"""Looking at tables: names and counts, columns, and queries with a bounded, readable result."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 500


def list_tables(spark: SparkSession) -> DataFrame:
    """(table, rows) of every table and view of the current database, counted in one job."""
    names = [t.name for t in spark.catalog.listTables()]
    counts = [spark.table(n).agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n in names]
    out = spark.createDataFrame([], "table string, rows long")
    for c in counts:
        out = out.unionByName(c)
    return out


def key_columns(spark: SparkSession, table: str) -> list[str]:
    """The columns of a table's primary key: of its constraint, in catalogues that have them, else those named
    in its property ``primary_key`` (separated by commas). Views have none."""
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect():  # a row per column and detail
        if found := re.search(r"PRIMARY KEY \(([^)]*)\)", r.data_type or ""):
            return [c.strip(" `") for c in found.group(1).split(",")]
    named = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
    return [c.strip(" `") for c in named.get("primary_key", "").split(",") if c.strip(" `")]


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """(column, type, notnull, default, key) of a table; an unknown one raises. The default is the expression that
    the catalogue has for the column, the key its place in the primary key, from 1, or 0."""
    if not spark.catalog.tableExists(table):
        raise ValueError(f'Unknown table "{table}"')
    keys = key_columns(spark, table)
    rows = [(f.name, f.dataType.simpleString(), not f.nullable, (f.metadata or {}).get("CURRENT_DEFAULT"), keys.index(f.name) + 1 if f.name in keys else 0) for f in spark.table(table).schema]
    return spark.createDataFrame(rows, "column string, type string, notnull boolean, default string, key int")


def query_sql(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """Any SQL, with named or positional arguments."""
    return spark.sql(text, args=args)


def markdown(df: DataFrame, max_rows: int = MAX_ROWS) -> str:
    """A table of the first rows; more are counted in a last line."""
    rows = df.take(max_rows)
    cell = lambda v: "NULL" if v is None else str(v).replace("|", "\\|")
    lines = [f"| {' | '.join(df.columns)} |", f"| {' | '.join('---' for _ in df.columns)} |", *(f"| {' | '.join(map(cell, r))} |" for r in rows)]
    if len(rows) == max_rows and (more := df.count() - max_rows) > 0:
        lines.append(f"... ({more} more rows)")
    return "\n".join(lines)
