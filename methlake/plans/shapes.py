"""Driver tables projected into the shapes of the domain, and the same projections as SQL.

The projections stand in for signal data; they make no biological claim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from methlake.plans.registry import table

READS_SQL = """
SELECT l_orderkey AS read_id, CAST(l_linenumber % 5 AS INT) AS contig, l_partkey AS ref_start,
       l_partkey + CAST(l_quantity AS BIGINT) AS ref_end, l_returnflag = 'R' AS is_reverse,
       (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END)
       + (CASE l_linenumber WHEN 7 THEN 256 WHEN 6 THEN 2048 ELSE 0 END)
       + (CASE WHEN l_suppkey % 10 = 0 THEN 4 ELSE 0 END)
       + (CASE WHEN l_linestatus = 'F' THEN 1024 ELSE 0 END) AS flag
FROM lineitem
"""
PROBES_SQL = "SELECT CAST(p_size % 5 AS INT) AS contig, p_partkey AS pos, 'cg' || CAST(p_partkey AS VARCHAR) AS cg_id FROM part"
SCORES_SQL = """
SELECT event_id, event_type AS sample_id, user_id AS probe, least(255, CAST(floor(value * 0.512) AS INT)) AS ml FROM events
"""
CALLS_SQL = f"""
SELECT event_id, sample_id, probe, ml, CASE WHEN ml / CAST(256 AS DOUBLE) >= CAST(CAST(0.7 AS FLOAT) AS DOUBLE) THEN TRUE
  WHEN ml / CAST(256 AS DOUBLE) < CAST(CAST(0.3 AS FLOAT) AS DOUBLE) THEN FALSE END AS is_mod FROM ({SCORES_SQL}) s
"""
MASS_SQL = """
SELECT c_mktsegment AS sample_id, n_name AS leaf, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
"""
NODES_SQL = """
SELECT r_name AS node, 'ROOT' AS parent FROM region
UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
"""


def uniform_sql(seed: str, *keys: str) -> str:
    """The SQL spelling of `functions.numeric.uniform`."""
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496)"


def reads(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    flag = (
        F.when(c("l_returnflag") == "R", 16).otherwise(0)
        + F.when(c("l_linenumber") == 7, 256).when(c("l_linenumber") == 6, 2048).otherwise(0)
        + F.when(c("l_suppkey") % 10 == 0, 4).otherwise(0)
        + F.when(c("l_linestatus") == "F", 1024).otherwise(0)
    )
    return table(spark, sf, "lineitem").select(
        c("l_orderkey").alias("read_id"),
        (c("l_linenumber") % 5).cast("int").alias("contig"),
        c("l_partkey").alias("ref_start"),
        (c("l_partkey") + c("l_quantity").cast("bigint")).alias("ref_end"),
        (c("l_returnflag") == "R").alias("is_reverse"),
        flag.alias("flag"),
    )


def probes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        (F.col("p_size") % 5).cast("int").alias("contig"),
        F.col("p_partkey").alias("pos"),
        F.concat(F.lit("cg"), F.col("p_partkey").cast("string")).alias("cg_id"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return scores_of(table(spark, sf, "events"))


def scores_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id",
        F.col("event_type").alias("sample_id"),
        F.col("user_id").alias("probe"),
        F.least(F.lit(255), F.floor(F.col("value") * 0.512).cast("int")).alias("ml"),
    )


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    region, nation = table(spark, sf, "region"), table(spark, sf, "nation")
    return region.select(F.col("r_name").alias("node"), F.lit("ROOT").alias("parent")).unionByName(
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_name").alias("node"), F.col("r_name").alias("parent")
        )
    )


def leaf_cents(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, leaf, cents): integer mass, so sums and ties are exact."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("c_mktsegment").alias("sample_id"), F.col("n_name").alias("leaf"))
        .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    )
