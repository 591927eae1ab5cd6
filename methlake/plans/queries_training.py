"""Training tables: targets, balance, depth, background bank, augmentation draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from methlake.functions.numeric import uniform
from methlake.operators import tree as TR
from methlake.operators.asof import asof_join
from methlake.plans import shapes
from methlake.plans.registry import query, table
from methlake.plans.shapes import NODES_SQL, uniform_sql
from methlake.training import augment as AUG
from methlake.training import balance as BAL
from methlake.training import depth as DEPTH
from methlake.training import purity as PUR
from methlake.training import targets as TG

# ---- targets: every customer is a row labelled by its nation, its region, or a mixture ----------------

_LABELS_SQL = """SELECT c_custkey AS row, n_name, r_name, c_custkey % 5 AS k FROM customer
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_UNDER_SQL = "SELECT r_name AS node, n_name AS leaf FROM region JOIN nation ON n_regionkey = r_regionkey"


def _placed(spark, sf) -> DataFrame:
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("c_custkey").alias("row"), "n_name", "r_name", (F.col("c_custkey") % 5).alias("k"))


def _labels(spark, sf) -> DataFrame:
    k, n, r = F.col("k"), F.col("n_name"), F.col("r_name")
    target = (
        F.when(k == 0, F.concat(F.lit("leaf:"), n))
        .when(k == 1, F.concat(F.lit(" node:"), r))
        .when(k == 2, F.concat(F.lit("mix:"), n, F.lit("=0.75;"), r, F.lit("=0.25")))
        .when(k == 3, F.concat(F.lit("node:"), n))
        .otherwise("")
    )
    return _placed(spark, sf).select("row", target.alias("target"), F.lit("1").alias("in_training"))


def _closure(spark, sf) -> DataFrame:
    return TR.leaf_closure(shapes.nodes(spark, sf), height=2)


@query(
    "target_grammar",
    f"""WITH l AS ({_LABELS_SQL}), u AS ({_UNDER_SQL}), s AS (SELECT node, count(*) AS n FROM u GROUP BY 1),
     p AS (SELECT row, n_name AS leaf, 1.0 AS q FROM l WHERE k IN (0, 3) UNION ALL SELECT row, n_name, 0.75 FROM l WHERE k = 2
       UNION ALL SELECT row, u.leaf, CAST(1 AS DOUBLE) / s.n FROM l JOIN u ON u.node = r_name JOIN s ON s.node = r_name WHERE k = 1
       UNION ALL SELECT row, u.leaf, CAST(0.25 AS DOUBLE) / s.n FROM l JOIN u ON u.node = r_name JOIN s ON s.node = r_name WHERE k = 2)
    SELECT row, leaf, round(sum(CAST(q AS DOUBLE)), 6) AS q FROM p GROUP BY 1, 2""",
)
def target_grammar(spark, sf):
    return TG.target_distribution(_labels(spark, sf), _closure(spark, sf)).withColumn("q", F.round("q", 6))


@query(
    "target_issues",
    f"""WITH l AS ({_LABELS_SQL}) SELECT row, CASE row % 7 WHEN 1 THEN 'unknown node' WHEN 2 THEN 'node with classes below it' WHEN 3 THEN 'masses do not sum to 1'
      WHEN 4 THEN 'unreadable target' WHEN 5 THEN 'in training without a target' END AS issue FROM l WHERE row % 7 BETWEEN 1 AND 5""",
)
def target_issues(spark, sf):
    m, n, r = F.col("row") % 7, F.col("n_name"), F.col("r_name")
    target = (
        F.when(m == 0, F.concat(F.lit("mix:"), n, F.lit("=0.9995")))
        .when(m == 1, F.concat(F.lit("node:"), n, F.lit("x")))
        .when(m == 2, F.concat(F.lit("leaf:"), r))
        .when(m == 3, F.concat(F.lit("mix:"), n, F.lit("=0.998")))
        .when(m == 4, n)
        .when(m == 5, "  ")
        .otherwise(F.concat(F.lit("leaf:"), n))
    )
    labels = _placed(spark, sf).select("row", target.alias("target"), F.lit("1").alias("in_training"))
    return TG.target_issues(labels, _closure(spark, sf))


@query(
    "log_targets",
    f"""WITH l AS ({_LABELS_SQL}), c AS (SELECT n_name AS leaf, n_nationkey AS leaf_idx FROM nation)
    SELECT row, leaf_idx, round(CAST(CAST(greatest(ln(greatest(CASE WHEN n_name = leaf THEN 1.0 ELSE 0.0 END, CAST(1e-13 AS DOUBLE))), -30) AS FLOAT) AS DOUBLE), 4) AS log_q
    FROM l, c""",
)
def log_targets(spark, sf):
    rows = _placed(spark, sf)
    targets = rows.join(table(spark, sf, "nation"), "n_name").select(
        "row", F.col("n_nationkey").alias("leaf_idx"), F.lit(1.0).alias("q")
    )
    dense = TG.log_targets(targets, rows, 25)  # the nations are classes 0..24
    joined = dense.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("leaf_idx"), F.col("n_name").alias("leaf")), "leaf_idx")
    return joined.select("row", "leaf_idx", F.round(F.col("log_q").cast("double"), 4).alias("log_q"))


# ---- balance: every order is a row, its line numbers are leaves weighed by quantity -------------------

_Q_SQL = """q AS (SELECT l_orderkey AS row, l_linenumber AS leaf_idx, 'L' || CAST(l_linenumber AS VARCHAR) AS leaf, sum(l_quantity) AS m FROM lineitem GROUP BY 1, 2),
 t AS (SELECT row, leaf, leaf_idx, m / sum(m) OVER (PARTITION BY row) AS q FROM q),
 r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY q DESC, leaf_idx) AS k FROM t),
 tops AS (SELECT row, max(CASE WHEN k = 1 THEN leaf END) AS leaf, max(CASE WHEN k = 1 THEN q END) AS best, coalesce(max(CASE WHEN k = 2 THEN q END), 0) AS second FROM r GROUP BY row),
 com AS (SELECT * FROM tops WHERE best >= CAST(0.5 AS DOUBLE) - CAST(1e-6 AS DOUBLE) AND best > second + CAST(1e-6 AS DOUBLE)),
 cnt AS (SELECT leaf, count(*) AS n FROM com GROUP BY leaf), med AS (SELECT coalesce(median(n), 1.0) AS median FROM cnt),
 names AS (SELECT 'L' || CAST(i AS VARCHAR) AS leaf FROM range(1, 10) x(i)),
 w AS (SELECT names.leaf, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN CAST(8 AS DOUBLE) ELSE greatest(CAST(0.3 AS DOUBLE), least(CAST(8 AS DOUBLE), pow(median / n, CAST(0.5 AS DOUBLE)))) END AS weight
   FROM names LEFT JOIN cnt ON names.leaf = cnt.leaf, med)"""


def _targets(spark, sf) -> DataFrame:
    mass = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("leaf_idx"))
        .agg(F.sum("l_quantity").alias("q"))
    )
    return TG.normalised(
        mass.select("row", F.concat(F.lit("L"), F.col("leaf_idx").cast("string")).alias("leaf"), "q")
    ).withColumn("leaf_idx", F.expr("cast(substr(leaf, 2) as int)"))


def _leaf_list(spark) -> DataFrame:
    return spark.range(1, 10).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("leaf"))


@query(
    "leaf_frequency",
    f"WITH {_Q_SQL} SELECT leaf, CAST(count(*) AS BIGINT) AS n, round(avg(best), 6) AS mean_best, round(avg(second), 6) AS mean_second FROM com GROUP BY leaf",
)
def leaf_frequency(spark, sf):
    chosen = BAL.committed(BAL.top_two(_targets(spark, sf), ["row"]))
    return chosen.groupBy("leaf").agg(
        F.count("*").alias("n"), F.round(F.avg("best"), 6).alias("mean_best"), F.round(F.avg("second"), 6).alias("mean_second")
    )


@query("leaf_weights_median", f"WITH {_Q_SQL} SELECT leaf, CAST(n AS BIGINT) AS n, round(weight, 6) AS weight FROM w")
def leaf_weights_median(spark, sf):
    tops = BAL.top_two(_targets(spark, sf), ["row"])
    return BAL.leaf_weights(tops, _leaf_list(spark), BAL.RowBalance()).withColumn("weight", F.round("weight", 6))


@query(
    "row_weights",
    f"""WITH {_Q_SQL}, x AS (SELECT t.row, sum(t.q * w.weight) * max(tops.best) AS x FROM t JOIN w ON t.leaf = w.leaf JOIN tops ON tops.row = t.row GROUP BY t.row)
    SELECT row, round(x * (SELECT CAST(1.5 AS DOUBLE) * count(*) / sum(x) FROM x), 6) AS weight FROM x""",
)
def row_weights(spark, sf):
    cfg = BAL.RowBalance(mean=1.5)
    targets = _targets(spark, sf)
    weights = BAL.leaf_weights(BAL.top_two(targets, ["row"]), _leaf_list(spark), cfg)
    return BAL.row_weights(targets, weights, cfg).withColumn("weight", F.round("weight", 6))


# ---- beta codes: every embedding is a profile of 64 codes ---------------------------------------------

_CODE_SQL = """codes AS (SELECT row, label, col, CASE WHEN c > 250 THEN 255 ELSE c END AS code FROM
  (SELECT vec_id AS row, label, i - 1 AS col, CAST(floor(abs(embedding[i]) * 1000) AS INT) % 256 AS c FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings) y) z)"""


def _corpus(spark, sf) -> DataFrame:
    thousand = F.lit(1000).cast("float")  # the product is one of single precision, as in the SQL
    code = F.transform("embedding", lambda x: F.floor(F.abs(x) * thousand).cast("int") % 256)
    hexed = F.transform(code, lambda c: F.lpad(F.hex(F.when(c > PUR.TOP_CODE, PUR.MISSING_CODE).otherwise(c)), 2, "0"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row"), "label", F.unhex(F.array_join(hexed, "")).alias("codes")
    )


@query(
    "code_histogram",
    f"WITH {_CODE_SQL} SELECT col, code, CAST(count(*) AS BIGINT) AS n FROM codes GROUP BY 1, 2",
)
def code_histogram(spark, sf):
    return PUR.explode_codes(_corpus(spark, sf)).groupBy("col", "code").agg(F.count("*").alias("n"))


_B_SQL = "b AS (SELECT *, (code + CAST(0.5 AS DOUBLE)) / 250 AS beta FROM codes WHERE code <= 250)"
_PROFILE_SQL = "avg(beta) AS mean, sqrt(greatest(0, avg(beta * beta) - avg(beta) * avg(beta))) AS sd"


@query(
    "column_profile",
    f"WITH {_CODE_SQL}, {_B_SQL}, p AS (SELECT col, {_PROFILE_SQL} FROM b GROUP BY col) SELECT col, round(mean, 6) AS mean, round(sd, 6) AS sd FROM p",
)
def column_profile(spark, sf):
    return PUR.profile(PUR.explode_codes(_corpus(spark, sf))).select(
        "col", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd")
    )


_MARKS_SQL = f"""{_CODE_SQL}, {_B_SQL}, pb AS (SELECT col, {_PROFILE_SQL} FROM b WHERE label < 5 GROUP BY col), pc AS (SELECT col, {_PROFILE_SQL} FROM b WHERE label >= 5 GROUP BY col),
 marks AS (SELECT pb.col, pb.mean AS mean_bg, pc.mean AS mean_cand, abs(pb.mean - pc.mean) / (pb.sd + pc.sd + CAST(0.05 AS DOUBLE)) AS score FROM pb JOIN pc ON pb.col = pc.col ORDER BY score DESC, col LIMIT 20)"""


def _marks(corpus: DataFrame) -> DataFrame:
    side = lambda cond: PUR.profile(PUR.explode_codes(corpus.filter(cond)))
    return PUR.markers(side("label < 5"), side("label >= 5"), 20)


@query(
    "marker_topk",
    f"WITH {_MARKS_SQL} SELECT col, round(mean_bg, 6) AS mean_bg, round(mean_cand, 6) AS mean_cand, round(score, 6) AS score FROM marks",
)
def marker_topk(spark, sf):
    return _marks(_corpus(spark, sf)).select(
        "col", *[F.round(c, 6).alias(c) for c in ("mean_bg", "mean_cand", "score")]
    )


@query(
    "immune_projection",
    f"""WITH {_MARKS_SQL}, s AS (SELECT codes.row, sum((b.beta - mean_cand) * (mean_bg - mean_cand)) AS num,
       sum(CASE WHEN b.beta IS NOT NULL THEN (mean_bg - mean_cand) * (mean_bg - mean_cand) END) AS den, count(b.beta) AS covered
       FROM codes JOIN marks ON codes.col = marks.col LEFT JOIN b ON b.row = codes.row AND b.col = codes.col WHERE codes.label >= 5 GROUP BY codes.row)
    SELECT row, round(CASE WHEN covered > 18 AND den > 0 THEN greatest(0, least(1, num / den)) ELSE 1 END, 6) AS fraction FROM s""",
)
def immune_projection(spark, sf):
    corpus = _corpus(spark, sf)
    marks = _marks(corpus)
    codes = PUR.explode_codes(corpus.filter("label >= 5"), marks.select("col"))
    return PUR.background_fraction(codes, marks, min_covered=18).withColumn("fraction", F.round("fraction", 6))


# ---- background bank: customers drawn per nation, in seeded hash order --------------------------------

_POOL_SQL = """pool AS (SELECT c_custkey AS row, n_name AS leaf, CASE WHEN n_nationkey % 2 = 0 THEN 'immune' ELSE 'tissue' END AS kind
 FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""
_BANK_SQL = f"""{_POOL_SQL}, size AS (SELECT kind, leaf, count(*) AS n FROM pool GROUP BY 1, 2 HAVING count(*) >= 2),
 quota AS (SELECT kind, greatest(1, (CASE WHEN kind = 'immune' THEN 45 ELSE 19 END) // count(*)) AS quota, CASE WHEN kind = 'immune' THEN 0 ELSE 1 END AS kr,
    CASE WHEN kind = 'immune' THEN CAST(0.7 AS DOUBLE) ELSE 1 - CAST(0.7 AS DOUBLE) END AS share FROM size GROUP BY kind),
 pick AS (SELECT pool.*, row_number() OVER (PARTITION BY pool.kind, pool.leaf ORDER BY {uniform_sql('5', 'row')}, row) AS k FROM pool),
 lim AS (SELECT pick.row, pick.leaf, pick.kind, kr, share FROM pick JOIN size ON size.kind = pick.kind AND size.leaf = pick.leaf JOIN quota ON quota.kind = pick.kind WHERE k <= quota AND k <= 64),
 ord AS (SELECT *, row_number() OVER (ORDER BY kr, leaf, row) AS o FROM lim),
 kept AS (SELECT *, share / count(*) OVER (PARTITION BY kind) AS w FROM ord WHERE o <= 64),
 bank AS (SELECT row, leaf, kind, CAST(o - 1 AS INT) AS bank_idx, sum(w) OVER (ORDER BY o ROWS UNBOUNDED PRECEDING) AS cum_weight FROM kept)"""


def _bank(spark, sf) -> DataFrame:
    pool = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("c_custkey").alias("row"),
            F.col("n_name").alias("leaf"),
            F.when(F.col("n_nationkey") % 2 == 0, "immune").otherwise("tissue").alias("kind"),
        )
    )
    cfg = PUR.PurityConfig(0.5, 0.2, 0.9, (), (), (), bank_size=64, min_rows_per_leaf=2, seed=5)
    return PUR.bank(pool, cfg)


@query("stratified_bank", f"WITH {_BANK_SQL} SELECT row, leaf, kind, bank_idx, round(cum_weight, 6) AS cum_weight FROM bank")
def stratified_bank(spark, sf):
    return _bank(spark, sf).withColumn("cum_weight", F.round("cum_weight", 6))


@query(
    "cumulative_weights_asof",
    f"""WITH {_BANK_SQL}, d AS (SELECT event_id, {uniform_sql('9', 'event_id')} AS u FROM events),
     a AS (SELECT list(cum_weight ORDER BY cum_weight) AS cum, max(cum_weight) AS top FROM bank)
    SELECT event_id, CAST(least(len(list_filter(cum, lambda c: c < u * top)), len(cum) - 1) AS INT) AS bank_idx FROM d, a""",
)
def cumulative_weights_asof(spark, sf):
    draws = table(spark, sf, "events").select("event_id", uniform(9, F.col("event_id")).alias("u_bg"))
    return AUG.pick_background(draws, _bank(spark, sf)).select("event_id", "bank_idx")


@query(
    "asof_neighbours",
    """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'purchase'), p AS (SELECT event_id AS id, user_id AS u, ts AS t FROM events WHERE event_type = 'purchase'),
     b AS (SELECT c.event_id, p.id AS before FROM c ASOF LEFT JOIN p ON c.user_id = p.u AND c.ts >= p.t),
     f AS (SELECT c.event_id, p.id AS after FROM c ASOF LEFT JOIN p ON c.user_id = p.u AND c.ts <= p.t)
    SELECT b.event_id, before, after FROM b JOIN f ON b.event_id = f.event_id""",
)
def asof_neighbours(spark, sf):
    """For every other event its user's last purchase before it and the first after it."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    bought = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("before"), F.col("event_id").alias("after"))
    rest, at = events.filter("event_type <> 'purchase'"), F.col("ts")
    both = asof_join(asof_join(rest, bought, at, at, ["before"], ["user_id"]), bought, at, at, ["after"], ["user_id"], "forward")
    return both.select("event_id", "before", "after")


# ---- read depth ---------------------------------------------------------------------------------------

_MU, _R, _SCALES = 6.0, 2.5, [0.5, 1.0, 2.5]
_DEPTH_SQL = f"""d AS (SELECT CAST(d AS INT) AS d, exp(lgamma(d + CAST({_R} AS DOUBLE)) - lgamma(CAST({_R} AS DOUBLE)) - lgamma(CAST(d + 1 AS DOUBLE)) + d * ln(1 - CAST({_R} AS DOUBLE) / ({_R} + {_MU}))) AS w FROM range(1, 31) x(d)),
 p AS (SELECT d, w / sum(w) OVER () AS p FROM d), s AS (SELECT * FROM (VALUES (0, CAST(0.5 AS DOUBLE)), (1, CAST(1 AS DOUBLE)), (2, CAST(2.5 AS DOUBLE))) v(tab, f)),
 m AS (SELECT tab, CAST(greatest(1, least(30, floor(d * f + 0.5))) AS INT) AS depth, sum(p) AS p FROM p, s GROUP BY 1, 2),
 g AS (SELECT tab, CAST(k AS INT) AS k FROM s, range(1, 31) y(k)),
 cdf AS (SELECT g.tab, k, CAST(sum(coalesce(p, 0)) OVER (PARTITION BY g.tab ORDER BY k ROWS UNBOUNDED PRECEDING) AS FLOAT) AS c FROM g LEFT JOIN m ON m.tab = g.tab AND m.depth = g.k),
 lut AS (SELECT cdf.tab, CAST(b AS INT) AS bin, 1 + CAST(count(*) FILTER (WHERE k < 30 AND CAST((b + 0.5) / 4096 AS FLOAT) > c) AS INT) AS depth FROM cdf, range(4096) z(b) GROUP BY 1, 2)"""


def _depth_table(spark) -> DataFrame:
    return DEPTH.depth_table(DEPTH.scaled_cdf(DEPTH.base_pmf(spark, _MU, _R), _SCALES))


@query(
    "depth_lut_lookup",
    f"""WITH {_DEPTH_SQL}, u AS (SELECT CAST(l_linenumber % 3 AS INT) AS tab, CAST(least(4095, floor({uniform_sql('depth', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')} * 4096)) AS INT) AS bin FROM lineitem)
    SELECT u.tab AS "table", lut.depth, CAST(count(*) AS BIGINT) AS n FROM u JOIN lut ON u.tab = lut.tab AND u.bin = lut.bin GROUP BY 1, 2""",
)
def depth_lut_lookup(spark, sf):
    draws = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 3).cast("int").alias("table"),
        uniform("depth", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("u"),
    )
    return DEPTH.draw_depth(draws, _depth_table(spark)).groupBy("table", "depth").agg(F.count("*").alias("n"))


# ---- augmentation draws: every labelled document is a training row ------------------------------------

_LEVELS = [500, 2000, 10000]
_PAIR_SQL = "pairs AS (SELECT doc_id AS row, quality, CAST(cov AS INT) AS coverage FROM labels, (VALUES (500), (2000), (10000)) v(cov))"


def _pairs(spark, sf) -> DataFrame:
    return AUG.coverage_pairs(table(spark, sf, "labels").select(F.col("doc_id").alias("row"), "quality"), _LEVELS)


def _u(name: str) -> str:
    return uniform_sql(f"3:{name}", "row", "coverage")


@query(
    "coverage_cross",
    f"""WITH {_PAIR_SQL} SELECT row, coverage, {_u('noise')} < CAST(0.4 AS DOUBLE) AS sequenced,
     CASE WHEN {_u('scale')} >= CAST(0.2 AS DOUBLE) THEN 1 ELSE 0 END + CASE WHEN {_u('scale')} >= CAST(0.2 AS DOUBLE) + CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS "table",
     round(coverage / CAST(20000 AS DOUBLE) * (1 - CAST(0.1 AS DOUBLE)), 6) AS keep_p FROM pairs""",
)
def coverage_cross(spark, sf):
    cfg = AUG.AugmentConfig(nano_prob=0.4, probe_mask_prob=0.1, depth_weights=(0.2, 0.5, 0.3), seed=3)
    return AUG.row_draws(_pairs(spark, sf), cfg, 20_000).select(
        "row", "coverage", "sequenced", "table", F.round("keep_p", 6).alias("keep_p")
    )


@query(
    "purity_draws",
    f"""WITH {_PAIR_SQL} SELECT row, coverage, round(CASE WHEN quality = 1 AND {_u('mix')} < CAST(0.6 AS DOUBLE) THEN CAST(0.2 AS DOUBLE) + (CAST(0.9 AS DOUBLE) - CAST(0.2 AS DOUBLE)) * {_u('pi')} ELSE 1 END, 6) AS purity FROM pairs""",
)
def purity_draws(spark, sf):
    draws = AUG.row_draws(_pairs(spark, sf), AUG.AugmentConfig(seed=3), 20_000).withColumn("eligible", F.col("quality") == 1)
    return draws.select("row", "coverage", F.round(AUG.purity_of(draws, 0.6, 0.2, 0.9), 6).alias("purity"))


@query(
    "consistency_depth",
    f"""WITH {_PAIR_SQL} SELECT row, coverage, round(least(exp(ln(CAST(300 AS DOUBLE)) + (ln(CAST(5000 AS DOUBLE)) - ln(CAST(300 AS DOUBLE))) * {_u('cons')}), coverage), 4) AS shallow FROM pairs""",
)
def consistency_depth(spark, sf):
    u = uniform("3:cons", F.col("row"), F.col("coverage"))
    return _pairs(spark, sf).select(
        "row", "coverage", F.round(AUG.shallow_coverage(u, 300.0, 5000.0, F.col("coverage")), 4).alias("shallow")
    )


@query(
    "epoch_batches",
    f"""WITH {_PAIR_SQL}, o AS (SELECT row, coverage, row_number() OVER (ORDER BY {uniform_sql('3:7', 'row', 'coverage')}, row, coverage) - 1 AS rn, count(*) OVER () AS n FROM pairs)
    SELECT row, coverage, CAST(rn // 16 AS BIGINT) AS batch FROM o""",
)
def epoch_batches(spark, sf):
    return AUG.epoch_batches(_pairs(spark, sf), 16, seed=3, epoch=7).select("row", "coverage", "batch")


@query(
    "learning_rate",
    """SELECT event_id, round(CAST(0.003 AS DOUBLE) * CAST(0.5 AS DOUBLE) * (1 + cos(pi() * (event_id % 40) / 40)), 9) AS lr FROM events""",
)
def learning_rate(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.round(AUG.cosine_rate(0.003, F.col("event_id") % 40, 40), 9).alias("lr")
    )


@query(
    "purity_mix",
    """WITH e AS (SELECT event_id, (event_id % 251 + CAST(0.5 AS DOUBLE)) / 250 AS beta, CASE WHEN user_id % 6 <> 0 THEN (user_id % 251 + CAST(0.5 AS DOUBLE)) / 250 END AS bg,
       CASE WHEN event_id % 3 = 0 THEN 1 ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS pi, 1 + event_id % 9 AS d FROM events),
     m AS (SELECT *, CASE WHEN pi < 1 AND bg IS NOT NULL THEN pi * beta + (1 - pi) * bg ELSE beta END AS mixed FROM e)
    SELECT event_id, round(mixed, 6) AS mixed, round(mixed * (1 - CAST(0.03 AS DOUBLE)) + (1 - mixed) * CAST(0.03 AS DOUBLE), 6) AS noisy,
     CAST(CASE WHEN 2 * floor(d * mixed) > d THEN 1 WHEN 2 * floor(d * mixed) < d THEN -1 ELSE 0 END AS INT) AS call FROM m""",
)
def purity_mix(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    beta = PUR.decode_beta(e % 251)
    bg = F.when(u % 6 != 0, PUR.decode_beta(u % 251))
    pi = F.when(e % 3 == 0, 1.0).otherwise((e % 100).cast("double") / 100)
    mixed = table(spark, sf, "events").select("event_id", AUG.mix_beta(beta, bg, pi).alias("m"))
    depth = 1 + e % 9
    return mixed.select(
        "event_id",
        F.round("m", 6).alias("mixed"),
        F.round(AUG.noisy_beta(F.col("m"), 0.03), 6).alias("noisy"),
        AUG.majority(F.floor(depth * F.col("m")), depth).cast("int").alias("call"),
    )


@query(
    "dropout_mask",
    f"""SELECT vec_id, list_transform(range(64), lambda j: CASE WHEN CAST(CAST('0x' || substr(md5('drop|' || CAST(vec_id AS VARCHAR) || '|' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 >= CAST(0.25 AS DOUBLE)
      THEN 1 / (1 - CAST(0.25 AS DOUBLE)) ELSE 0 END) AS mask FROM embeddings""",
)
def dropout_mask(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: AUG.dropout_scale(uniform("drop", F.col("vec_id"), j), 0.25)).alias("mask"),
    )
