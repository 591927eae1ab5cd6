"""Class trees: closures, rollup, descent, alerts, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from methlake.functions.numeric import softmax
from methlake.operators import tree as TR
from methlake.plans import shapes
from methlake.plans.registry import query, table
from methlake.plans.shapes import MASS_SQL, NODES_SQL

# ---- a tree whose leaves grow with the data: region -> nation -> supplier ----------------------------

_BIG_SQL = f"""{NODES_SQL} UNION ALL SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _big_nodes(spark, sf) -> DataFrame:
    suppliers = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    return shapes.nodes(spark, sf).unionByName(
        suppliers.select(F.col("s_name").alias("node"), F.col("n_name").alias("parent"))
    )


_CLOSURE_SQL = f"""WITH RECURSIVE t AS ({_BIG_SQL}), d(node, root, depth, root_depth) AS (
  SELECT node, node, 1, 1 FROM t WHERE parent = 'ROOT'
  UNION ALL SELECT t.node, t.node, d.depth + 1, d.depth + 1 FROM t JOIN d ON t.parent = d.node AND d.node = d.root),
 up(node, anc) AS (SELECT node, node FROM t UNION ALL SELECT up.node, t.parent FROM up JOIN t ON t.node = up.anc WHERE t.parent <> 'ROOT'),
 lv AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t)),
 dep AS (SELECT DISTINCT node, depth FROM d)
"""


@query(
    "leaf_sets_closure",
    _CLOSURE_SQL + """SELECT up.anc AS node, dep.depth AS depth, CAST(count(*) AS BIGINT) AS n_leaves, min(up.node) AS first_leaf
    FROM up JOIN lv ON lv.node = up.node JOIN dep ON dep.node = up.anc GROUP BY 1, 2""",
)
def leaf_sets_closure(spark, sf):
    return TR.leaf_closure(_big_nodes(spark, sf)).groupBy("node", "depth").agg(
        F.count("*").alias("n_leaves"), F.min("leaf").alias("first_leaf")
    )


@query(
    "hier_levels",
    _CLOSURE_SQL + """SELECT dep.depth AS depth, up.anc AS node, up.node AS leaf FROM up JOIN lv ON lv.node = up.node JOIN dep ON dep.node = up.anc""",
)
def hier_levels(spark, sf):
    return TR.level_membership(_big_nodes(spark, sf))


# ---- mass of order value over region -> nation ------------------------------------------------------

_TOTAL_SQL = f"m AS ({MASS_SQL}), tot AS (SELECT sample_id, sum(cents) AS total FROM m GROUP BY 1)"
_NODE_SQL = f"""WITH {_TOTAL_SQL}, nm AS (
  SELECT sample_id, leaf AS node, 2 AS depth, r_name AS parent, cents FROM m JOIN nation ON n_name = leaf JOIN region ON n_regionkey = r_regionkey),
 node AS (SELECT sample_id, node, depth, parent, cents FROM nm UNION ALL SELECT sample_id, parent, 1, 'ROOT', sum(cents) FROM nm GROUP BY 1, 2)
"""


def _shares(spark, sf) -> DataFrame:
    """Leaf mass as exact cents; shares are taken once sums and comparisons are done."""
    return shapes.leaf_cents(spark, sf)


@query(
    "tree_rollup",
    _NODE_SQL + "SELECT sample_id, node, CAST(depth AS INT) AS depth, CAST(cents AS BIGINT) AS cents FROM node",
)
def tree_rollup(spark, sf):
    return TR.node_mass(_shares(spark, sf), shapes.nodes(spark, sf), ["sample_id"], "cents", height=2)


_DESCENT_SQL = _NODE_SQL + """, best AS (SELECT *, row_number() OVER (PARTITION BY sample_id, parent ORDER BY cents DESC, node) AS k FROM node),
 s1 AS (SELECT sample_id, node, cents FROM best WHERE parent = 'ROOT' AND k = 1),
 s2 AS (SELECT b.sample_id, b.node, b.cents FROM best b JOIN s1 ON b.sample_id = s1.sample_id AND b.parent = s1.node AND b.k = 1),
 st AS (SELECT sample_id, 1 AS depth, node, cents FROM s1 UNION ALL SELECT sample_id, 2, node, cents FROM s2),
 steps AS (SELECT st.sample_id, depth, node, CAST(cents AS DOUBLE) / CAST(total AS DOUBLE) AS p, CASE depth WHEN 1 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.047 AS DOUBLE) END AS tau
   FROM st JOIN tot ON st.sample_id = tot.sample_id),
 judged AS (SELECT *, min(CASE WHEN p >= tau THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY depth) = 1 AS met FROM steps)
"""


def _thresholds(spark) -> DataFrame:
    return spark.createDataFrame([(1, 0.2), (2, 0.047)], "depth int, tau double")


def _leaf_mass(spark, sf) -> DataFrame:
    """Mass per leaf with its sample's total; a sample has no more rows than the tree has leaves."""
    return _shares(spark, sf).withColumn("total", F.sum("cents").over(Window.partitionBy("sample_id")).cast("double"))


def _steps(spark, sf) -> DataFrame:
    """Descent over integer mass; thresholds are applied to shares of the sample's total."""
    mass = _leaf_mass(spark, sf)
    p = mass.select("sample_id", "leaf", (F.col("cents") / F.col("total")).alias("p"))
    return TR.descend(p, shapes.nodes(spark, sf), _thresholds(spark), ["sample_id"], height=2)


@query(
    "tree_descent",
    _DESCENT_SQL + "SELECT sample_id, CAST(depth AS INT) AS depth, node, round(p, 6) AS p, tau, met FROM judged",
)
def tree_descent(spark, sf):
    return _steps(spark, sf).withColumn("p", F.round("p", 6))


@query(
    "tree_call",
    _DESCENT_SQL + """SELECT sample_id, arg_max(node, depth) FILTER (WHERE met) AS call, CAST(coalesce(max(depth) FILTER (WHERE met), 0) AS INT) AS call_depth,
    round(coalesce(arg_max(p, depth) FILTER (WHERE met), 0), 6) AS call_p FROM judged GROUP BY sample_id""",
)
def tree_call(spark, sf):
    return TR.call(_steps(spark, sf), ["sample_id"]).withColumn("call_p", F.round("call_p", 6))


@query(
    "leaf_alerts",
    _DESCENT_SQL + """, c AS (SELECT sample_id, arg_max(node, depth) FILTER (WHERE met) AS call FROM judged GROUP BY sample_id),
      r AS (SELECT n_name AS leaf, CASE WHEN n_nationkey % 2 = 0 THEN CAST(0.041 AS DOUBLE) ELSE CAST(0.044 AS DOUBLE) END AS p_min FROM nation)
    SELECT m.sample_id, m.leaf, round(CAST(cents AS DOUBLE) / CAST(total AS DOUBLE), 6) AS p, p_min FROM m JOIN tot ON m.sample_id = tot.sample_id JOIN r ON r.leaf = m.leaf
    JOIN c ON c.sample_id = m.sample_id WHERE CAST(cents AS DOUBLE) / CAST(total AS DOUBLE) >= p_min AND (c.call IS NULL OR c.call <> m.leaf)""",
)
def leaf_alerts(spark, sf):
    mass = _leaf_mass(spark, sf).select("sample_id", "leaf", (F.col("cents") / F.col("total")).alias("p"))
    rules = table(spark, sf, "nation").select(
        F.col("n_name").alias("leaf"), F.when(F.col("n_nationkey") % 2 == 0, 0.041).otherwise(0.044).alias("p_min")
    )
    calls = TR.call(_steps(spark, sf), ["sample_id"])
    return TR.alerts(mass, rules, calls, ["sample_id"]).withColumn("p", F.round("p", 6))


# ---- descent of probability arrays ------------------------------------------------------------------

_CLASSES = [f"c{i}" for i in range(64)]
_A, _A2, _B = range(20), range(20, 40), range(40, 63)
_CHILDREN = {"ROOT": ["A", "B", "c63"], "A": [*(f"c{i}" for i in _A), "A2"], "A2": [f"c{i}" for i in _A2], "B": [f"c{i}" for i in _B]}
_P64_SQL = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 4) AS z FROM embeddings),
 x AS (SELECT vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS w FROM e),
 p AS (SELECT vec_id, list_transform(w, lambda v: v / list_sum(w)) AS p FROM x)"""


@query(
    "tree_descent_arrays",
    _P64_SQL + """, n AS (SELECT vec_id, p, list_sum(p[1:40]) AS a, list_sum(p[41:63]) AS b, p[64] AS c63, list_sum(p[21:40]) AS a2 FROM p),
     k AS (SELECT vec_id, 1 AS depth, 'ROOT' AS parent, unnest(['A', 'B', 'c63']) AS node, unnest([a, b, c63]) AS m FROM n
      UNION ALL SELECT vec_id, 2, 'A', unnest(list_append(list_transform(range(20), lambda i: 'c' || CAST(i AS VARCHAR)), 'A2')), unnest(list_append(p[1:20], a2)) FROM n
      UNION ALL SELECT vec_id, 3, 'A2', unnest(list_transform(range(20, 40), lambda i: 'c' || CAST(i AS VARCHAR))), unnest(p[21:40]) FROM n
      UNION ALL SELECT vec_id, 2, 'B', unnest(list_transform(range(40, 63), lambda i: 'c' || CAST(i AS VARCHAR))), unnest(p[41:63]) FROM n),
     b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, parent ORDER BY m DESC, node) AS r FROM k),
     s1 AS (SELECT * FROM b WHERE r = 1 AND parent = 'ROOT'), s2 AS (SELECT b.* FROM b JOIN s1 ON b.vec_id = s1.vec_id AND b.parent = s1.node WHERE b.r = 1),
     s3 AS (SELECT b.* FROM b JOIN s2 ON b.vec_id = s2.vec_id AND b.parent = s2.node WHERE b.r = 1),
     s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3),
     t AS (SELECT vec_id, depth, node, m, CAST(m AS FLOAT) >= CAST(CASE depth WHEN 1 THEN 0.55 WHEN 2 THEN 0.2 ELSE 0.5 END AS FLOAT) AS ok FROM s)
    SELECT vec_id, CAST(depth AS INT) AS depth, node, round(m, 6) AS p, bool_and(ok) OVER (PARTITION BY vec_id ORDER BY depth) AS met FROM t""",
)
def tree_descent_arrays(spark, sf):
    logits = F.transform("embedding", lambda x: x.cast("double") * 4)
    predictions = table(spark, sf, "embeddings").select("vec_id", softmax(logits).alias("probs"))
    walked = TR.descend_arrays(predictions, _CHILDREN, _CLASSES, {1: 0.55, 2: 0.2})
    return walked.select("vec_id", F.explode("steps").alias("s")).select(
        "vec_id", "s.depth", "s.node", F.round("s.p", 6).alias("p"), "s.met"
    )


# ---- labels and validation --------------------------------------------------------------------------


@query(
    "label_expansion",
    """WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN r_name WHEN c_custkey % 17 = 1 THEN 'NOWHERE' ELSE n_name END AS label
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
     c AS (SELECT n_name AS class, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 7)
    SELECT c_custkey, label, class FROM l LEFT JOIN c ON label = class OR label = r_name""",
)
def label_expansion(spark, sf):
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    placed = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    key = F.col("c_custkey")
    label = F.when(key % 3 == 0, F.col("r_name")).when(key % 17 == 1, "NOWHERE").otherwise(F.col("n_name"))
    classes = nation.filter("n_nationkey <> 7").select(F.col("n_name").alias("class"))
    return TR.expand_labels(placed.select("c_custkey", label.alias("label")), shapes.nodes(spark, sf), classes).select(
        "c_custkey", "label", "class"
    )


@query(
    "duplicate_nodes",
    "SELECT p_name AS node, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_nodes(spark, sf):
    return TR.duplicate_nodes(table(spark, sf, "part").select(F.col("p_name").alias("node"), F.col("p_type").alias("parent")))


@query(
    "missing_leaves",
    """SELECT n_name AS node FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)""",
)
def missing_leaves(spark, sf):
    rich = table(spark, sf, "customer").filter("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    classes = table(spark, sf, "nation").join(rich, "n_nationkey").select(F.col("n_name").alias("class"))
    return TR.missing_leaves(shapes.nodes(spark, sf), classes)
