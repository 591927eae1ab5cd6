"""Training labels to sparse target distributions over the leaves of the tree.

Grammar: `leaf:<leaf>`, `node:<node>` (uniform over its leaves), `mix:<node>=<mass>;<node>=<mass>` (each part
uniform over its node's leaves; names may hold commas and `=`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# ---- fixed values ---------------------------------------------------------------------------------
MASS_TOLERANCE = 1e-3
SMALLEST_MASS = 1e-13
LOG_FLOOR = -30.0
# ---------------------------------------------------------------------------------------------------


def parse_targets(labels: DataFrame) -> DataFrame:
    """(row, form, node, mass): the parts of every non-empty target. Unknown forms have form null."""
    target = F.trim("target")
    body = F.regexp_replace(target, "^(leaf|node|mix):", "")
    form = F.nullif(F.regexp_extract(target, "^(leaf|node|mix):", 1), F.lit(""))
    whole = F.array(F.struct(body.alias("node"), F.lit("1").alias("mass")))
    parts = F.transform(
        F.split(body, ";"),
        lambda p: F.struct(
            F.regexp_extract(p, "^(.*)=([^=]*)$", 1).alias("node"), F.regexp_extract(p, "^(.*)=([^=]*)$", 2).alias("mass")
        ),
    )
    return (
        labels.filter(target != "")
        .select("row", form.alias("form"), F.explode(F.when(form == "mix", parts).otherwise(whole)).alias("part"))
        .select("row", "form", "part.node", F.col("part.mass").try_cast("double").alias("mass"))
    )


def target_distribution(labels: DataFrame, closure: DataFrame) -> DataFrame:
    """(row, leaf, q): mass of every leaf a target touches. closure: node, leaf."""
    sizes = closure.groupBy("node").agg(F.count("*").alias("n_leaves"))
    parts = parse_targets(labels).join(sizes, "node")
    return (
        parts.join(closure.select("node", "leaf"), "node")
        .groupBy("row", "leaf")
        .agg(F.sum(F.col("mass") / F.col("n_leaves")).alias("q"))
    )


def target_issues(labels: DataFrame, closure: DataFrame) -> DataFrame:
    """(row, issue) of every target that must be rejected."""
    nodes = closure.groupBy("node").agg(
        F.count("*").alias("n_leaves"), F.max((F.col("node") == F.col("leaf")).cast("int")).alias("is_leaf")
    )
    parts = parse_targets(labels).join(nodes, "node", "left")
    per_part = parts.select(
        "row",
        F.when(F.col("form").isNull(), "unreadable target")
        .when(F.col("node") == "", "part of a mix without a name")
        .when(F.col("n_leaves").isNull(), "unknown node")
        .when((F.col("form") == "leaf") & ~((F.col("n_leaves") == 1) & (F.col("is_leaf") == 1)), "node with classes below it")
        .when(F.col("mass").isNull(), "unreadable share")
        .alias("issue"),
        "mass",
    )
    sums = per_part.groupBy("row").agg(
        F.min("issue").alias("issue"), F.sum("mass").alias("total")
    ).select(
        "row", F.coalesce("issue", F.when(F.abs(F.col("total") - 1) >= MASS_TOLERANCE, "masses do not sum to 1")).alias("issue")
    )
    untargeted = labels.filter((F.trim("target") == "") & (F.trim("in_training") == "1")).select(
        "row", F.lit("in training without a target").alias("issue")
    )
    return sums.filter("issue is not null").unionByName(untargeted)


def row_order_issues(labels: DataFrame) -> DataFrame:
    """Rows that break the rule that row i is on line i (labels carry a zero-based `line`)."""
    return labels.filter(F.col("row").isNull() | (F.col("row") != F.col("line")))


def normalised(targets: DataFrame) -> DataFrame:
    """Targets rescaled to sum to one per row."""
    return targets.withColumn("q", F.col("q") / F.sum("q").over(Window.partitionBy("row")))


def log_target_rows(targets: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(row, log_q): floored log masses of all k classes as one array. targets: row, leaf_idx, q."""
    held = targets.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("leaf_idx", "q"))).alias("q"))

    def mass(i):
        return F.coalesce(F.element_at("q", i), F.lit(0.0))

    log_q = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: F.greatest(F.ln(F.greatest(mass(i), F.lit(SMALLEST_MASS))), F.lit(LOG_FLOOR)).cast("float"),
    )
    return rows.select("row").join(held, "row", "left").select("row", log_q.alias("log_q"))


def log_targets(targets: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(row, leaf_idx, log_q): the same in long form, for export."""
    return log_target_rows(targets, rows, k).select("row", F.posexplode("log_q").alias("leaf_idx", "log_q"))
