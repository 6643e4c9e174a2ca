"""Extracts, database reads, staging and result tables.

Schemas are always declared (never inferred): an inferred CSV schema costs a
full extra pass over the data and can change between files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .. import schema as S


def read_extract(spark: SparkSession, path: str, schema: StructType, null_value: str = "NULL",
                 date_format: str = "yyyy-MM-dd") -> DataFrame:
    """A1/A2: CSV with a header row and a declared schema; the text sentinel
    ``null_value`` reads as null in every column."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", null_value)
            .option("dateFormat", date_format).option("mode", "PERMISSIVE").csv(path))


def write_extract(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header (no row-number column, unlike ``write.csv`` in R)."""
    df.write.mode(mode).option("header", True).csv(path)


def jdbc_options(url: str, table: str | None = None, query: str | None = None,
                 partition_column: str | None = None, lower_bound=None, upper_bound=None,
                 num_partitions: int | None = None, fetch_size: int = 10000, **extra) -> dict:
    """A3: options of a parallel JDBC read.  Base tables are read (optionally
    split on a numeric/date column into ``num_partitions`` ranges) and the
    computation runs in Spark; ``query`` is for small lookups only, because a
    query source cannot be range-partitioned."""
    if (table is None) == (query is None):
        raise ValueError("give exactly one of table / query")
    opts = {"url": url, "fetchsize": str(fetch_size)}
    if table is not None:
        opts["dbtable"] = table
    else:
        opts["query"] = query
    if partition_column:
        if None in (lower_bound, upper_bound, num_partitions):
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        if query is not None:
            raise ValueError("a partitioned read needs a table, not a query")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound),
                    upperBound=str(upper_bound), numPartitions=str(num_partitions))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              **kw) -> DataFrame:
    """A3: database source (``spark.read.format('jdbc')``)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, query, **kw)).load()


def read_domain(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """A4: the domain tables stored as ``<root>/<name>`` with declared schemas."""
    return {name: spark.read.format(fmt).schema(sch).load(f"{root.rstrip('/')}/{name}")
            for name, sch in S.DOMAIN.items()}


def save_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
               fmt: str = "parquet") -> None:
    """Persistent result table (drop + create = overwrite).  Optional
    partition columns (e.g. a month) enable partition pruning on read."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def stage(df: DataFrame, name: str, persist: bool = True) -> DataFrame:
    """A session-scoped intermediate (``SELECT ... INTO #t``): a temp view,
    persisted so later statements reuse it."""
    if persist:
        df = df.persist()
    df.createOrReplaceTempView(name)
    return df


def unstage(spark: SparkSession, name: str) -> None:
    """Drop a staged intermediate and free its cache."""
    if spark.catalog.tableExists(name):
        spark.table(name).unpersist()
        spark.catalog.dropTempView(name)


def top_rows(df: DataFrame, n: int = 6, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows in a stated order (``TOP n`` / ``head``)."""
    return df.orderBy(*(order_by or df.columns[:1])).limit(n)
