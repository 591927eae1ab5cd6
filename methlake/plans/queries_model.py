"""Network arithmetic, losses, federated sums, optimiser steps, and the streaming count."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from methlake.functions import numeric as N
from methlake.model import federated as FED, fit as FIT, gradients as G, network
from methlake.model.predict import nearest_temperature, signed_sums
from methlake.operators import calls as C
from methlake.plans import shapes
from methlake.plans.registry import dealt, query, table
from methlake.plans.shapes import CALLS_SQL
from methlake.session import shared_dir
from methlake.streaming import counts as STREAM

# ---- calibration and row functions --------------------------------------------------------------------

_CENTERS, _LOG_TEMPS = [200.0, 400.0, 1500.0, 9000.0], [0.4, 0.1, -0.05, -0.3]


@query(
    "temperature_nearest",
    """WITH c AS (SELECT user_id, CAST(sum(event_id % 50) AS DOUBLE) AS n FROM events GROUP BY 1),
     b AS (SELECT * FROM (VALUES (0, CAST(200 AS DOUBLE), CAST(0.4 AS DOUBLE)), (1, 400, 0.1), (2, 1500, -0.05), (3, 9000, -0.3)) v(i, center, lt)),
     r AS (SELECT user_id, n, lt, row_number() OVER (PARTITION BY user_id ORDER BY abs(center - n), i) AS k FROM c, b)
    SELECT user_id, CAST(n AS BIGINT) AS n, round(exp(lt), 6) AS temperature FROM r WHERE k = 1""",
)
def temperature_nearest(spark, sf):
    covered = table(spark, sf, "events").groupBy("user_id").agg(F.sum(F.col("event_id") % 50).alias("n"))
    return covered.withColumn("temperature", F.round(nearest_temperature(F.col("n"), _CENTERS, _LOG_TEMPS), 6))


_Z_SQL = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 8) AS z FROM embeddings"


def _logits(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 8).alias("z"))


def _signed_round(x, digits: int):
    """Rounded half away from zero; what rounds to zero keeps its sign, as in the SQL."""
    return F.signum(x) * F.abs(F.round(x, digits))


def _rounded(c, digits: int = 6):
    return F.transform(c, lambda x: _signed_round(x, digits))


@query(
    "softmax_rows",
    f"""WITH e AS (SELECT vec_id, list_transform(z, lambda x: x / CAST(1.7 AS DOUBLE)) AS s FROM ({_Z_SQL}) q), m AS (SELECT vec_id, s, list_max(s) AS top FROM e),
     w AS (SELECT vec_id, list_transform(s, lambda x: exp(x - top)) AS w FROM m), t AS (SELECT vec_id, w, list_sum(w) AS total FROM w)
    SELECT vec_id, list_transform(w, lambda x: round(x / total, 6)) AS p FROM t""",
)
def softmax_rows(spark, sf):
    return _logits(spark, sf).select("vec_id", _rounded(N.softmax(F.col("z"), 1.7)).alias("p"))


@query(
    "set_nll",
    f"""WITH e AS (SELECT vec_id, label, z FROM ({_Z_SQL}) q), m AS (SELECT vec_id, z, list_max(z) AS top,
      list_transform(range(64), lambda j: CASE WHEN j % 5 = label % 5 THEN z[j + 1] END) AS kept FROM e),
     s AS (SELECT vec_id, list_sum(list_transform(z, lambda x: exp(x - top))) AS whole, list_sum(list_transform(list_filter(kept, lambda x: x IS NOT NULL), lambda x: exp(x - top))) AS part, z, kept, top FROM m)
    SELECT vec_id, round(ln(whole) - ln(part), 6) AS loss,
     list_transform(range(64), lambda j: round(exp(z[j + 1] - top) / whole - CASE WHEN kept[j + 1] IS NULL THEN 0 ELSE exp(z[j + 1] - top) / part END, 5)) AS gradient FROM s""",
)
def set_nll(spark, sf):
    mask = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: (j % 5 == F.col("label") % 5).cast("int"))
    rows = _logits(spark, sf).withColumn("mask", mask)
    z, m = F.col("z"), F.col("mask")
    return rows.select(
        "vec_id", F.round(N.set_nll(z, m), 6).alias("loss"),
        _rounded(N.set_nll_gradient(z, m), 5).alias("gradient"),
    )


@query(
    "layer_norm",
    f"""WITH m AS (SELECT vec_id, z, list_avg(z) AS mean FROM ({_Z_SQL}) q), v AS (SELECT *, list_avg(list_transform(z, lambda x: (x - mean) * (x - mean))) AS var FROM m)
    SELECT vec_id, list_transform(z, lambda x, i: round((x - mean) / sqrt(var + CAST(1e-5 AS DOUBLE)) * (CASE WHEN i % 2 = 1 THEN 1 ELSE CAST(0.5 AS DOUBLE) END) + i, 5)) AS y FROM v""",
)
def layer_norm(spark, sf):
    gain = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.when(i % 2 == 1, 1.0).otherwise(0.5))
    shift = F.sequence(F.lit(1), F.lit(64))
    return _logits(spark, sf).select("vec_id", _rounded(N.layer_norm(F.col("z"), gain, shift), 5).alias("y"))


@query("silu", f"SELECT vec_id, list_transform(z, lambda x: round(x / (1 + exp(-x)), 6)) AS y FROM ({_Z_SQL}) q")
def silu(spark, sf):
    return _logits(spark, sf).select("vec_id", _rounded(F.transform("z", N.silu)).alias("y"))


# ---- projections --------------------------------------------------------------------------------------


@query(
    "ternary_projection",
    """WITH x AS (SELECT l_orderkey AS row, l_partkey AS probe, CAST(sign(sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END)) AS INT) AS t FROM lineitem GROUP BY 1, 2),
     w AS (SELECT p_partkey AS probe, unnest([0, 1, 2, 3]) AS k, unnest([p_size, p_partkey % 7 - 3, p_partkey % 11 - 5, p_partkey % 3 - 1]) AS w FROM part),
     s AS (SELECT row, k, CAST(sum(t * w) AS DOUBLE) / 8 AS v FROM x JOIN w ON x.probe = w.probe WHERE t <> 0 GROUP BY 1, 2)
    SELECT row, list(v ORDER BY k) AS z FROM s GROUP BY row""",
)
def ternary_projection(spark, sf):
    c = F.col
    sign = F.signum(F.sum(F.when(c("l_linenumber") % 2 == 0, 1).otherwise(-1))).cast("int")
    items = table(spark, sf, "lineitem")
    items = dealt(items.select("l_orderkey", "l_partkey", "l_linenumber"), items, "l_orderkey")
    x = items.groupBy(c("l_orderkey").alias("row"), c("l_partkey").alias("probe_idx")).agg(sign.alias("t"))
    parts = (c("p_size"), c("p_partkey") % 7 - 3, c("p_partkey") % 11 - 5, c("p_partkey") % 3 - 1)
    w = table(spark, sf, "part").select(
        c("p_partkey").alias("probe_idx"), F.array(*[e.cast("double") / 8 for e in parts]).alias("w")
    )
    return signed_sums(x.filter("t != 0").join(w, "probe_idx"), 4, "row")


@query(
    "linear_layer",
    f"""WITH e AS (SELECT vec_id, z FROM ({_Z_SQL}) q), o AS (SELECT range AS o FROM range(8))
    SELECT vec_id, CAST(o AS INT) AS o, round(list_sum(list_transform(z, lambda x, i: x * ((o * 7 + (i - 1) * 3) % 11 - 5) / 10)) + CAST(o AS DOUBLE) / 4, 5) AS y FROM e, o""",
)
def linear_layer(spark, sf):
    weight = (np.add.outer(np.arange(8) * 7, np.arange(64) * 3) % 11 - 5) / 10.0
    bias = np.arange(8) / 4.0

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "y": list(np.stack(pdf["z"].to_numpy()) @ weight.T + bias)})

    out = _logits(spark, sf).select("vec_id", "z").mapInPandas(run, "vec_id bigint, y array<double>")
    return out.select("vec_id", F.posexplode("y").alias("o", "y")).withColumn("y", _signed_round(F.col("y"), 5))


@query(
    "matrix_product",
    """WITH c AS (SELECT vec_id, i - 1 AS i, CAST(floor(embedding[i] * 100) AS BIGINT) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) q)
    SELECT CAST(a.i AS INT) AS i, CAST(b.i AS INT) AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY 1, 2""",
)
def matrix_product(spark, sf):
    """X'X: one partial product per task, added by block."""
    hundred = F.lit(100).cast("float")  # the product is one of single precision, as in the SQL
    x = table(spark, sf, "embeddings").select(F.transform("embedding", lambda v: F.floor(v * hundred).cast("double")).alias("x"))

    def run(batches):
        total = {}
        for pdf in batches:
            if len(pdf):
                a = np.stack(pdf["x"].to_numpy())
                G.add_into(total, {"xx": a.T @ a})
        if total:
            yield G.rows_of(total)

    flat = G.sum_blocks(x.mapInPandas(run, G.PARTS_SCHEMA)).select(F.posexplode("values").alias("at", "v"))
    return flat.select(
        F.floor(F.col("at") / 64).cast("int").alias("i"), (F.col("at") % 64).cast("int").alias("j"), F.round("v").cast("bigint").alias("v")
    )


# ---- losses -------------------------------------------------------------------------------------------

_LEVELS = {"A": list(range(40)), "B": list(range(40, 63)), "c63": [63], "A2": list(range(20, 40))}
_LOSS_SQL = f"""e AS (SELECT vec_id, label, z, list_transform(range(64), lambda j: CASE WHEN j = label THEN ln(CAST(0.91 AS DOUBLE)) ELSE ln(CAST(0.09 AS DOUBLE) / 63) END) AS t FROM ({_Z_SQL}) q),
 m AS (SELECT *, list_max(z) AS zt, list_max(t) AS tt FROM e),
 s AS (SELECT *, ln(list_sum(list_transform(z, lambda x: exp((x - zt) / 2)))) AS zn, list_sum(list_transform(t, lambda x: exp((x - tt) / 2))) AS tn,
   list_sum(list_transform(z, lambda x: exp(x - zt))) AS pn FROM m),
 kd AS (SELECT vec_id, 4 * list_sum(list_transform(range(64), lambda j: exp((t[j + 1] - tt) / 2) / tn * (ln(exp((t[j + 1] - tt) / 2) / tn + CAST(1e-12 AS DOUBLE)) - ((z[j + 1] - zt) / 2 - zn)))) AS kd FROM s),
 lv AS (SELECT * FROM (VALUES ('A', range(40)), ('B', range(40, 63)), ('c63', [63]), ('A2', range(20, 40))) v(node, members)),
 nm AS (SELECT vec_id, node, list_sum(list_transform(members, lambda j: exp(t[j + 1]))) AS q, list_sum(list_transform(members, lambda j: exp(z[j + 1] - zt) / pn)) AS p FROM s, lv)"""


@query(
    "kl_hier_loss",
    f"""WITH {_LOSS_SQL}, h AS (SELECT vec_id, sum(-CAST(0.2 AS DOUBLE) * q * ln(greatest(p, CAST(1e-8 AS DOUBLE)))) AS h FROM nm GROUP BY 1)
    SELECT kd.vec_id, round(kd, 5) AS kd, round(h, 5) AS hier FROM kd JOIN h ON kd.vec_id = h.vec_id""",
)
def kl_hier_loss(spark, sf):
    """Both terms of the row loss, the second by joining classes to the nodes that hold them."""
    log_t = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(j == F.col("label"), float(np.log(0.91))).otherwise(float(np.log(0.09 / 63))))
    rows = _logits(spark, sf).withColumn("t", log_t)
    kd = rows.select("vec_id", N.kd_loss(F.col("z"), F.col("t"), 2.0).alias("kd"))
    members = spark.createDataFrame([(n, j) for n, js in _LEVELS.items() for j in js], "node string, j int")
    mass = F.arrays_zip(N.softmax(F.col("z")).alias("p"), F.transform("t", lambda x: F.exp(x)).alias("q"))
    per_class = rows.select("vec_id", F.posexplode(mass).alias("j", "m")).select("vec_id", "j", "m.p", "m.q")
    nodes = per_class.join(F.broadcast(members), "j").groupBy("vec_id", "node").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    hier = nodes.groupBy("vec_id").agg(F.sum(N.level_cross_entropy(F.col("q"), F.col("p"), 0.2)).alias("hier"))
    return kd.join(hier, "vec_id").select("vec_id", F.round("kd", 5).alias("kd"), F.round("hier", 5).alias("hier"))


@query(
    "training_loss",
    f"""WITH {_LOSS_SQL}, h AS (SELECT vec_id, sum(-CAST(0.2 AS DOUBLE) * q * ln(greatest(p, CAST(1e-8 AS DOUBLE)))) AS h FROM nm GROUP BY 1),
     w AS (SELECT s.vec_id, s.z, s.zt, s.pn, list_max(list_transform(s.z, lambda x: -x)) AS st FROM s),
     c AS (SELECT vec_id, z, zt, pn, st, list_sum(list_transform(z, lambda x: exp(-x - st))) AS sn FROM w),
     k AS (SELECT vec_id, list_sum(list_transform(z, lambda x: exp(x - zt) / pn * (ln(exp(x - zt) / pn + CAST(1e-12 AS DOUBLE)) - (-x - st - ln(sn))))) AS cons FROM c)
    SELECT kd.vec_id, round((1 + kd.vec_id % 3) * (kd + h), 4) AS loss, round(CAST(0.5 AS DOUBLE) * cons, 4) AS consistency FROM kd JOIN h ON kd.vec_id = h.vec_id JOIN k ON k.vec_id = kd.vec_id""",
)
def training_loss(spark, sf):
    """Row losses as the training step computes them; the shallow view is the negated logits here."""
    levels = np.zeros((len(_LEVELS), 64))
    for i, js in enumerate(_LEVELS.values()):
        levels[i, js] = 1.0

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            z = np.stack(pdf["z"].to_numpy())
            log_t = np.where(np.arange(64)[None, :] == pdf["label"].to_numpy()[:, None], np.log(0.91), np.log(0.09 / 63))
            weight = 1.0 + pdf["vec_id"].to_numpy() % 3
            loss, cons, _, _ = network.training_loss(z, log_t, weight, levels, 2.0, 0.2, -z, np.ones(len(z)), 0.5)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "loss": loss, "consistency": cons})

    rows = _logits(spark, sf).mapInPandas(run, "vec_id bigint, loss double, consistency double")
    return rows.select("vec_id", F.round("loss", 4).alias("loss"), F.round("consistency", 4).alias("consistency"))


# ---- federated sums: every supplier nation is a site ---------------------------------------------------

_GRADS_SQL = """g AS (SELECT s_nationkey AS site, l_returnflag AS name, l_partkey AS i, CAST(sum(CAST(l_quantity AS BIGINT) - 25) AS BIGINT) AS g
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def _site_gradients(spark, sf) -> DataFrame:
    items, sites = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    return items.join(sites, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        F.col("s_nationkey").alias("site"), F.col("l_returnflag").alias("name"), F.col("l_partkey").alias("i")
    ).agg(F.sum(F.col("l_quantity").cast("bigint") - 25).alias("g"))


@query(
    "grad_norm",
    f"WITH {_GRADS_SQL} SELECT site, round(sqrt(CAST(sum(g * g) AS DOUBLE)), 6) AS norm FROM g GROUP BY site",
)
def grad_norm(spark, sf):
    return _site_gradients(spark, sf).groupBy("site").agg(
        F.round(F.sqrt(F.sum(F.col("g") * F.col("g")).cast("double")), 6).alias("norm")
    )


@query(
    "grad_merge_sgd",
    f"""WITH {_GRADS_SQL}, s AS (SELECT name, i, sum(g) AS g FROM g GROUP BY 1, 2),
     w AS (SELECT name, p_partkey AS i, p_size / CAST(8 AS DOUBLE) AS w FROM part, (VALUES ('A'), ('N'), ('R')) x(name))
    SELECT w.name, w.i, round(w.w - coalesce(s.g, 0) * (CAST(0.25 AS DOUBLE) / 64), 6) AS w FROM w LEFT JOIN s ON s.name = w.name AND s.i = w.i""",
)
def grad_merge_sgd(spark, sf):
    tensors = F.array(*[F.lit(x) for x in "ANR"])  # one per return flag
    base = table(spark, sf, "part").select(
        F.explode(tensors).alias("name"), F.col("p_partkey").alias("i"), (F.col("p_size") / 8.0).alias("w")
    )
    summed = FED.sum_updates(_site_gradients(spark, sf))
    moved = F.col("w") - F.coalesce("g", F.lit(0)) * (0.25 / 64)
    return base.join(summed, ["name", "i"], "left").select("name", "i", F.round(moved, 6).alias("w"))


@query(
    "upper_median_outlier",
    """WITH n AS (SELECT l_suppkey % 7 AS grp, l_suppkey AS site, CAST(sum(CASE WHEN l_suppkey % 13 = 0 THEN 40 ELSE 1 END * l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY grp) AS c FROM n),
     m AS (SELECT grp, v AS median FROM r WHERE k = c // 2)
    SELECT n.site, n.v, m.median, n.v > 10 * m.median AS outlier FROM n JOIN m ON n.grp = m.grp""",
)
def upper_median_outlier(spark, sf):
    boost = F.when(F.col("l_suppkey") % 13 == 0, 40).otherwise(1)
    norms = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("grp"), F.col("l_suppkey").alias("site")).agg(
        F.sum(boost * F.col("l_quantity")).cast("bigint").alias("v")
    )
    return norms.join(FED.upper_median(norms, "v", ["grp"]), "grp").select(
        "site", "v", "median", (F.col("v") > FED.OUTLIER * F.col("median")).alias("outlier")
    )


@query(
    "label_counts",
    """SELECT o_orderpriority AS label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_custkey % 9 AS site, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) s GROUP BY 1""",
)
def label_counts(spark, sf):
    per_site = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 9).alias("site"), F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return per_site.groupBy("label").agg(F.sum("n").alias("n"))


@query(
    "patch_tensor_checks",
    """WITH p AS (SELECT p_name AS name, max(p_size) AS shape FROM part GROUP BY 1), m AS (SELECT p_name AS name, max(p_size) AS shape FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1)
    SELECT p.name, CASE WHEN m.name IS NULL THEN 'unexpected' ELSE 'shape' END AS issue FROM p LEFT JOIN m ON m.name = p.name WHERE m.name IS NULL OR m.shape <> p.shape""",
)
def patch_tensor_checks(spark, sf):
    part = table(spark, sf, "part")
    shape = lambda df, as_: df.groupBy(F.col("p_name").alias("name")).agg(F.max("p_size").alias(as_))
    both = shape(part, "new").join(shape(part.filter("p_partkey % 9 <> 0"), "old"), "name", "left")
    return both.filter("old is null or old <> new").select("name", F.when(F.col("old").isNull(), "unexpected").otherwise("shape").alias("issue"))


@query(
    "adamw_step",
    """WITH p AS (SELECT p_partkey, p_size / CAST(10 AS DOUBLE) AS w, (p_partkey % 21 - 10) / CAST(10 AS DOUBLE) AS g, (p_partkey % 5 - 2) / CAST(4 AS DOUBLE) AS m, (p_partkey % 7) / CAST(8 AS DOUBLE) AS v FROM part),
     n AS (SELECT p_partkey, w, m * CAST(0.9 AS DOUBLE) + g * (1 - CAST(0.9 AS DOUBLE)) AS m, v * CAST(0.99 AS DOUBLE) + g * g * (1 - CAST(0.99 AS DOUBLE)) AS v FROM p)
    SELECT p_partkey, round(w * (1 - CAST(0.01 AS DOUBLE) * CAST(0.05 AS DOUBLE)) - CAST(0.01 AS DOUBLE) * (m / (1 - pow(CAST(0.9 AS DOUBLE), 3))) / (sqrt(v / (1 - pow(CAST(0.99 AS DOUBLE), 3))) + CAST(1e-8 AS DOUBLE)), 5) AS w FROM n""",
)
def adamw_step(spark, sf):
    k = F.col("p_partkey")
    single = lambda c: F.array(c.cast("double"))
    blocks = table(spark, sf, "part").select(
        F.lit("w").alias("name"), F.array(F.lit(1)).cast("array<bigint>").alias("shape"), k.alias("block"),
        single(F.col("p_size") / 10.0).alias("values"), single((k % 5 - 2) / 4.0).alias("m"), single((k % 7) / 8.0).alias("v"),
        F.array((k % 21 - 10) / 10.0).alias("g"),
    )
    grads = blocks.select("name", "block", F.col("g").alias("values"))
    moved = FIT.adamw(blocks.drop("g"), grads, 3, 0.01, (0.9, 0.99), 1e-8, 0.05, kind="double")
    return moved.select(F.col("block").alias("p_partkey"), F.round(F.get("values", F.lit(0)).cast("double"), 5).alias("w"))


# ---- streaming ----------------------------------------------------------------------------------------


@query(
    "stream_counts",
    f"""SELECT probe, CAST(count(*) FILTER (WHERE is_mod) AS BIGINT) AS n_mod, CAST(count(*) FILTER (WHERE NOT is_mod) AS BIGINT) AS n_unmod
    FROM ({CALLS_SQL}) c WHERE is_mod IS NOT NULL GROUP BY probe""",
)
def stream_counts(spark, sf):
    """The whole events table as a file stream; partial counts per micro-batch, added up."""
    from methlake.functions import reads as R

    schema = table(spark, sf, "events").schema
    # the table lies beside others in one folder, so the stream takes it by name
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)

    def to_counts(batch: DataFrame) -> DataFrame:
        scored = shapes.scores_of(batch).withColumn("outcome", R.outcome(F.col("ml")))
        return C.tally(scored, ["probe"])

    run = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    STREAM.accumulate(stream, to_counts, f"{run}/counts", f"{run}/checkpoint").awaitTermination()
    return STREAM.totals(spark, f"{run}/counts", ["probe"])
