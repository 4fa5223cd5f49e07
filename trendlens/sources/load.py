"""Sources and input checks.

CSV: read every column as string, map the usual NA spellings to NULL, then
``try_cast`` by role -- ``inferSchema`` would turn a numeric column with one
``NA`` into a string column, and ``nullValue`` accepts a single spelling.
SQL: a query over catalog/temp views (``spark.sql``), or a JDBC query read
with partitioning options for a remote database.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.roles import Roles

# fixed values: the NA spellings a pandas CSV reader treats as missing by default
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, roles: Roles | None = None, multi_line: bool = False) -> DataFrame:
    """A1.  Quotes inside quoted fields are doubled.  ``multi_line`` admits line
    breaks inside quotes; a file is then one task, so it is off by default."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("escape", '"')
           .option("multiLine", multi_line).option("mode", "FAILFAST").csv(path))
    na = F.array(*[F.lit(v) for v in NA_VALUES])
    cols = {c: F.when(~F.array_contains(na, F.col(c)), F.col(c)) for c in raw.columns}
    df = raw.select(*[cols[c].alias(c) for c in raw.columns])
    if roles is None:
        return df
    numeric = set(roles.numerics) | set(roles.targets) | {f"{t}Std" for t in roles.targets}
    return df.select(*[(F.expr(f"try_cast(`{c}` as double)").alias(c) if c in numeric else F.col(c))
                       for c in df.columns])


def read_sql(spark: SparkSession, query: str) -> DataFrame:
    """A2: SQL over views registered in the session catalog."""
    return spark.sql(query)


def jdbc_reader(spark: SparkSession, url: str, query: str, *, user: str | None = None,
                password: str | None = None, partition_column: str | None = None,
                lower: int | None = None, upper: int | None = None,
                num_partitions: int | None = None, fetch_size: int = 10000):
    """A2 (remote DB): a configured JDBC reader; call ``.load()`` to run.

    With a partition column the read is split into ``num_partitions``
    parallel range queries instead of one connection pulling everything.
    """
    r = (spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size))
    if partition_column:
        r = (r.option("dbtable", f"({query}) q").option("partitionColumn", partition_column)
              .option("lowerBound", lower).option("upperBound", upper)
              .option("numPartitions", num_partitions or 8))
    else:
        r = r.option("query", query)
    if user is not None:
        r = r.option("user", user)
    if password is not None:
        r = r.option("password", password)
    return r


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    """A4: schema-only check listing every missing column (no job)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def check_roles(df: DataFrame, roles: Roles) -> None:
    """A5: inputs declared, table non-empty, targets present."""
    if not roles.inputs:
        raise ValueError("no input columns declared")
    if not roles.targets:
        raise ValueError("no output targets declared")
    require_columns(df, roles.columns)
    if df.isEmpty():
        raise ValueError("input table is empty")


def load(spark: SparkSession, source: str, roles: Roles, *, kind: str = "auto",
         key: Sequence[str] = ()) -> DataFrame:
    """Load a CSV path, a parquet path/table, or a SQL query; keep the
    roles' columns (plus key and ``<target>Std`` columns) so later scans are
    pruned to what the analysis uses."""
    if kind == "auto":
        s = source.strip().lower()
        kind = "sql" if s.startswith(("select", "with")) else ("csv" if s.endswith(".csv") else "parquet")
    if kind == "csv":
        df = read_csv(spark, source, roles)
    elif kind == "sql":
        df = read_sql(spark, source)
    else:
        df = spark.read.parquet(source)
    require_columns(df, roles.columns)
    extra = [f"{t}Std" for t in roles.targets if f"{t}Std" in df.columns]
    return df.select(*key, *roles.columns, *extra)
