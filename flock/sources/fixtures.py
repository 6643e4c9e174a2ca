"""Adapter: the driver's TPC-H-style test tables seen as the domain tables.

The mapping is fixed by FIXTURES.md section 2 and written a second time, as
SQL text, in ``flock.plans.sqltext`` for the DuckDB check.  Everything here is
lazy column arithmetic over parquet scans, so Catalyst prunes the columns and
pushes filters of the consuming query into the scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the adapter (FIXTURES.md section 2).
MARITAL_BY_SEGMENT = {"BUILDING": 143, "HOUSEHOLD": 144, "MACHINERY": 1792, "FURNITURE": 1886}
OPPORTUNITY_BY_EVENT = {"signup": 13, "purchase": 26, "click": 11, "view": 7, "error": 24}
OPPORTUNITY_IDS = (4, 7, 11, 13, 24, 25, 26)
ONLINE_PRIORITY = "5-LOW"
ONLINE_CAMPUS = 30
SERVING_REGION = "EUROPE"
SMALL_GROUP_REGION = "ASIA"
FAMILY_GROUP_BASE = 1000000   # family group ids: base + custkey % (50 + custkey % 400)
SERVICE_GROUP_BASE = 3000000  # service group ids: base + campus id


# Declared schemas of the driver's tables (no footer-based schema inference per read).
FIXTURE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in FIXTURE_SCHEMAS:
        reader = reader.schema(FIXTURE_SCHEMAS[name])
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col, mapping):
    return reduce(lambda acc, kv: acc.when(col == kv[0], F.lit(kv[1])),
                  list(mapping.items())[1:],
                  F.when(col == list(mapping)[0], F.lit(list(mapping.values())[0])))


def family_id_expr(custkey):
    return F.lit(FAMILY_GROUP_BASE) + custkey % (F.lit(50) + custkey % 400)


def person(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k * 7 % 2400).cast("int"))
        .cast("timestamp_ntz").alias("created_ts"),
        F.when(k % 5 == 0, k).alias("foreign_id"),
        F.lit(1).cast("int").alias("record_type_id"),
        F.nullif(F.col("c_nationkey") % 3, F.lit(0)).cast("int").alias("gender"),
        (F.lit(1930) + k % 80).cast("int").alias("birth_year"),
        _case(F.col("c_mktsegment"), MARITAL_BY_SEGMENT).cast("int").alias("marital_status_id"),
        (k % 3).cast("int").alias("age_classification"),
        family_id_expr(k).alias("primary_family_id"),
    )


def person_alias(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.when(k % 10 == 9, k - 1).otherwise(k).alias("person_id"),
        k.alias("alias_person_id"),
    )


def attendance(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("person_alias_id"),
        F.col("o_orderkey").alias("occurrence_id"),
        F.col("o_orderdate").alias("start_ts"),
        (F.col("o_orderstatus") != "P").cast("int").alias("did_attend"),
    )


def attendance_occurrence(spark, sf_dir):
    online = F.col("o_orderpriority") == ONLINE_PRIORITY
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(online, F.lit(SERVICE_GROUP_BASE + ONLINE_CAMPUS))
        .otherwise(F.lit(SERVICE_GROUP_BASE + 1)).cast("long").alias("group_id"),
    )


def group(spark, sf_dir):
    supplier_groups = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("group_type_id"),
        F.lit(None).cast("int").alias("campus_id"))
    family_groups = table(spark, sf_dir, "customer").select(
        family_id_expr(F.col("c_custkey")).alias("id")).distinct().select(
        "id", F.lit(None).cast("long").alias("group_type_id"), F.lit(None).cast("int").alias("campus_id"))
    # the two service groups that attendance occurrences point at
    rows = ", ".join(f"({SERVICE_GROUP_BASE + c}L, CAST(NULL AS BIGINT), {c})" for c in (1, ONLINE_CAMPUS))
    service_groups = spark.sql(f"SELECT * FROM VALUES {rows} AS v(id, group_type_id, campus_id)")
    return supplier_groups.unionByName(family_groups).unionByName(service_groups)


def group_type(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    purpose = (F.when((F.col("r_name") == SERVING_REGION) & (F.col("s_suppkey") % 7 == 0), F.lit(184))
               .when(F.col("r_name") == SMALL_GROUP_REGION, F.lit(157176)))
    return j.select(F.col("s_suppkey").alias("id"), purpose.cast("int").alias("purpose_value_id"))


def group_member(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    supplier_members = (li.join(o, li.l_orderkey == o.o_orderkey)
                        .select(F.col("l_suppkey").alias("group_id"), F.col("o_custkey").alias("person_id"))
                        .distinct())
    family_members = table(spark, sf_dir, "customer").select(
        family_id_expr(F.col("c_custkey")).alias("group_id"), F.col("c_custkey").alias("person_id"))
    return supplier_members.unionByName(family_members)


def gift(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("o_custkey").alias("person_alias_id"),
        F.col("l_shipdate").alias("created_ts"),
    )


def connection_request(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("person_alias_id"),
        _case(F.col("event_type"), OPPORTUNITY_BY_EVENT).cast("int").alias("opportunity_id"),
    )


def connection_opportunity(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i})" for i in OPPORTUNITY_IDS) + " AS v(id)")


def daily_attendance(spark, sf_dir):
    """Dense daily check-ins for the day-grain streak: events minus errors,
    online = a view.  ``person_alias_id`` is the event's user."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    return e.select(
        F.col("user_id").alias("person_alias_id"),
        F.col("ts").alias("start_ts"),
        (F.col("event_type") == "view").cast("int").alias("is_online"),
    )


_BUILDERS = {
    "person": person,
    "person_alias": person_alias,
    "attendance": attendance,
    "attendance_occurrence": attendance_occurrence,
    "group": group,
    "group_type": group_type,
    "group_member": group_member,
    "gift": gift,
    "connection_request": connection_request,
    "connection_opportunity": connection_opportunity,
}


class Domain(dict):
    """Lazy mapping name -> DataFrame; a table is built on first access."""

    def __init__(self, spark, sf_dir):
        super().__init__()
        self.spark = spark
        self.sf_dir = sf_dir

    def __missing__(self, name):
        df = _BUILDERS[name](self.spark, self.sf_dir)
        self[name] = df
        return df


def load_domain(spark: SparkSession, sf_dir: str) -> Domain:
    return Domain(spark, sf_dir)
