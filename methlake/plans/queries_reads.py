"""Reads, probes, calls and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from methlake.functions import reads as R
from methlake.operators import calls as C
from methlake.operators import ordered as O
from methlake.operators import qc
from methlake.operators import references as REF
from methlake.plans import shapes
from methlake.plans.registry import query, spread, table
from methlake.plans.shapes import CALLS_SQL, PROBES_SQL, READS_SQL

PAIR_BIN = 32  # spans here are at most 50 long


def _calls(spark, sf) -> DataFrame:
    return shapes.scores(spark, sf).withColumn("outcome", R.outcome(F.col("ml"))).withColumn("probe_id", F.col("probe"))


@query(
    "read_filter",
    f"""SELECT contig, CAST(count(*) AS BIGINT) AS n_reads,
    CAST(count(*) FILTER (WHERE (flag & 2308) = 0) AS BIGINT) AS n_kept,
    CAST(count(*) FILTER (WHERE (flag & 2308) = 0 AND (flag & 16) <> 0) AS BIGINT) AS n_reverse
    FROM ({READS_SQL}) r GROUP BY contig""",
)
def read_filter(spark, sf):
    keep = R.is_primary_mapped(F.col("flag"))
    return shapes.reads(spark, sf).groupBy("contig").agg(
        F.count("*").alias("n_reads"),
        F.count_if(keep).alias("n_kept"),
        F.count_if(keep & R.is_reverse(F.col("flag"))).alias("n_reverse"),
    )


_PAIRS_SQL = f"""
SELECT r.*, p.pos, p.cg_id, p.pos + CASE WHEN r.is_reverse THEN 1 ELSE 0 END AS site
FROM ({READS_SQL}) r JOIN ({PROBES_SQL}) p ON r.contig = p.contig
 AND p.pos + CASE WHEN r.is_reverse THEN 1 ELSE 0 END >= r.ref_start
 AND p.pos + CASE WHEN r.is_reverse THEN 1 ELSE 0 END < r.ref_end
"""


@query(
    "read_probe_interval_join",
    f"""SELECT cg_id, CAST(count(*) AS BIGINT) AS n_reads, CAST(sum(site - ref_start) AS BIGINT) AS offset_sum
    FROM ({_PAIRS_SQL}) x WHERE (flag & 2308) = 0 GROUP BY cg_id""",
)
def read_probe_interval_join(spark, sf):
    kept = shapes.reads(spark, sf).filter(R.is_primary_mapped(F.col("flag")))
    pairs = C.read_probe_pairs(kept, shapes.probes(spark, sf), PAIR_BIN)
    site = C.site_on_read(F.col("pos"), F.col("is_reverse"))
    return pairs.groupBy("cg_id").agg(
        F.count("*").alias("n_reads"), F.sum(site - F.col("ref_start")).alias("offset_sum")
    )


@query(
    "read_probe_reverse_shift",
    f"""SELECT contig, is_reverse, CAST(count(*) AS BIGINT) AS n_pairs,
    CAST(count(*) FILTER (WHERE pos < ref_start) AS BIGINT) AS n_left_of_read,
    CAST(max(site - ref_start) AS BIGINT) AS max_offset FROM ({_PAIRS_SQL}) x GROUP BY contig, is_reverse""",
)
def read_probe_reverse_shift(spark, sf):
    pairs = C.read_probe_pairs(shapes.reads(spark, sf), shapes.probes(spark, sf), PAIR_BIN, replicas=4)
    site = C.site_on_read(F.col("pos"), F.col("is_reverse"))
    return pairs.groupBy("contig", "is_reverse").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("pos") < F.col("ref_start")).alias("n_left_of_read"),
        F.max(site - F.col("ref_start")).alias("max_offset"),
    )


@query(
    "call_thresholds",
    f"""SELECT sample_id, ml, is_mod, CAST(count(*) AS BIGINT) AS n FROM ({CALLS_SQL}) c GROUP BY 1, 2, 3""",
)
def call_thresholds(spark, sf):
    called = shapes.scores(spark, sf).withColumn("is_mod", R.call(F.col("ml")))
    return called.groupBy("sample_id", "ml", "is_mod").agg(F.count("*").alias("n"))


_TALLY_SQL = f"""SELECT probe, CAST(count(*) FILTER (WHERE is_mod) AS BIGINT) AS n_mod,
CAST(count(*) FILTER (WHERE NOT is_mod) AS BIGINT) AS n_unmod FROM ({CALLS_SQL}) c WHERE is_mod IS NOT NULL GROUP BY probe"""


@query("probe_tally", _TALLY_SQL)
def probe_tally(spark, sf):
    return C.tally(_calls(spark, sf), ["probe"])


@query("tally_merge_shards", _TALLY_SQL)
def tally_merge_shards(spark, sf):
    parts = C.tally(_calls(spark, sf), ["sample_id", "probe"])
    return C.sum_counts(parts, ["probe"])


@query(
    "counts_fraction",
    f"""SELECT probe, n_mod, n_unmod, printf('%.4f', CAST(n_mod AS DOUBLE) / (n_mod + n_unmod)) AS fraction
    FROM ({_TALLY_SQL}) t WHERE n_mod + n_unmod > 0""",
)
def counts_fraction(spark, sf):
    return C.with_fraction_text(C.tally(_calls(spark, sf), ["probe"]))


@query(
    "ternary_call",
    f"""SELECT probe, CASE WHEN 2 * n_mod > n_mod + n_unmod THEN 1 WHEN 2 * n_mod < n_mod + n_unmod THEN -1 ELSE 0 END AS by_beta,
    CASE WHEN n_mod > n_unmod THEN 1 WHEN n_mod < n_unmod THEN -1 ELSE 0 END AS by_counts
    FROM ({_TALLY_SQL}) t""",
)
def ternary_call(spark, sf):
    counts = C.betas(C.tally(_calls(spark, sf), ["probe"]))
    return counts.select(
        "probe",
        C.ternary_of_beta(F.col("beta")).cast("int").alias("by_beta"),
        C.ternary_of_counts(F.col("n_mod"), F.col("n_unmod")).cast("int").alias("by_counts"),
    )


@query(
    "ternary_vector",
    f"""WITH t AS (SELECT sample_id, probe, count(*) FILTER (WHERE is_mod) AS m, count(*) FILTER (WHERE NOT is_mod) AS u
      FROM ({CALLS_SQL}) c WHERE is_mod IS NOT NULL GROUP BY 1, 2)
    SELECT sample_id, CAST(c_custkey AS INT) AS probe_idx, CASE WHEN m > u THEN 1 ELSE -1 END AS t
    FROM t JOIN customer ON 'cg' || CAST(probe AS VARCHAR) = 'cg' || CAST(c_custkey AS VARCHAR)
    WHERE m <> u AND c_nationkey % 3 <> 0""",
)
def ternary_vector(spark, sf):
    dictionary = (
        table(spark, sf, "customer")
        .filter("c_nationkey % 3 <> 0")
        .select(F.concat(F.lit("cg"), F.col("c_custkey")).alias("cg_id"), F.col("c_custkey").cast("int").alias("probe_idx"))
    )
    values = C.betas(C.tally(_calls(spark, sf), ["sample_id", "probe"])).select(
        "sample_id", F.concat(F.lit("cg"), F.col("probe")).alias("probe_id"), "beta"
    )
    return C.ternary_vector(values, dictionary).withColumn("t", F.col("t").cast("int"))


@query(
    "ternary_last_wins",
    """WITH v AS (SELECT event_id, event_type AS sample_id, CAST(user_id AS INT) AS probe_idx,
        CASE WHEN event_id % 4 = 0 THEN 0 WHEN value > 60 THEN 1 ELSE -1 END AS t FROM events),
     r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, probe_idx ORDER BY event_id DESC) AS k FROM v WHERE t <> 0)
    SELECT sample_id, probe_idx, t FROM r WHERE k = 1""",
)
def ternary_last_wins(spark, sf):
    events = table(spark, sf, "events")
    values = events.select(
        F.col("event_type").alias("sample_id"),
        F.concat(F.lit("cg"), F.col("user_id")).alias("probe_id"),
        F.when(F.col("event_id") % 4 == 0, 0.5).when(F.col("value") > 60, 1.0).otherwise(0.0).cast("float").alias("beta"),
        F.col("event_id").alias("ord"),
    )
    dictionary = events.select(
        F.concat(F.lit("cg"), F.col("user_id")).alias("cg_id"), F.col("user_id").cast("int").alias("probe_idx")
    ).distinct()
    return C.ternary_vector(values, dictionary).withColumn("t", F.col("t").cast("int"))


@query(
    "covered_distinct",
    f"""SELECT sample_id, CAST(count(is_mod) AS BIGINT) AS n_called, CAST(count(*) - count(is_mod) AS BIGINT) AS n_filtered,
    CAST(count(DISTINCT CASE WHEN is_mod IS NOT NULL THEN probe END) AS BIGINT) AS n_covered
    FROM ({CALLS_SQL}) c GROUP BY sample_id""",
)
def covered_distinct(spark, sf):
    totals = C.run_totals(C.counted(_calls(spark, sf), ["sample_id"], "probe"), ["sample_id"], "probe")
    return totals.select("sample_id", "n_called", "n_filtered", "n_covered")


@query(
    "merged_shard_totals",
    f"""SELECT sample_id, CAST(count(is_mod) AS BIGINT) AS n_called, CAST(count(*) - count(is_mod) AS BIGINT) AS n_filtered, TRUE AS within_3_percent
    FROM ({CALLS_SQL}) c GROUP BY sample_id""",
)
def merged_shard_totals(spark, sf):
    """Totals of seven shards of the calls, each a table with a sketch of its covered probes, united and held to the exact count."""
    calls = _calls(spark, sf).withColumn("shard", F.col("event_id") % 7)
    parts = C.run_totals(C.counted(calls, ["sample_id", "shard"], "probe"), ["sample_id", "shard"], "probe")
    exact = C.run_totals(C.counted(calls, ["sample_id"], "probe"), ["sample_id"], "probe").select("sample_id", "n_covered")
    merged = C.merged_totals(parts, ["sample_id"]).join(exact, "sample_id")
    near = F.abs(F.col("n_covered_estimate") - F.col("n_covered")) <= 0.03 * F.col("n_covered")
    return merged.select("sample_id", "n_called", "n_filtered", near.alias("within_3_percent"))


@query(
    "probes_on_contigs",
    f"""SELECT contig, CAST(count(DISTINCT cg_id) AS BIGINT) AS n_probes FROM ({PROBES_SQL}) p
    WHERE contig IN (SELECT contig FROM ({READS_SQL}) r WHERE (flag & 2308) = 0) GROUP BY contig""",
)
def probes_on_contigs(spark, sf):
    used = shapes.reads(spark, sf).filter(R.is_primary_mapped(F.col("flag"))).select("contig").distinct()
    return shapes.probes(spark, sf).join(used, "contig", "left_semi").groupBy("contig").agg(
        F.countDistinct("cg_id").alias("n_probes")
    )


# ---- whole read decode ------------------------------------------------------------------------------
# Every line item becomes a read of n x ACGT (n <= 16) with a zero delta per listed cytosine; half of the
# reads are implicit and list only every cytosine up to n / 2. Probability bytes come from an md5 digest.

_READ_SQL = """
SELECT *, 1 + CAST(l_quantity AS INT) % 16 AS n, l_linenumber % 2 = 0 AS implicit, l_returnflag = 'R' AS rev,
 md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)) AS digest FROM lineitem
"""


def read_calls_sql(probes: str, place: str = "l_partkey") -> str:
    """Counts of the sequenced reads at the probes of a query; place: where a line item's read begins."""
    return f"""WITH r AS ({_READ_SQL}), p AS ({probes}),
    j AS (SELECT r.*, p.cg_id, p.pos + CASE WHEN rev THEN 1 ELSE 0 END - {place} AS q FROM r JOIN p
      ON l_linenumber % 5 = p.contig AND p.pos + CASE WHEN rev THEN 1 ELSE 0 END >= {place}
      AND p.pos + CASE WHEN rev THEN 1 ELSE 0 END < {place} + 4 * n),
    c AS (SELECT *, CASE WHEN rev THEN n - 1 - q // 4 ELSE q // 4 END AS ord FROM j
      WHERE (NOT rev AND q % 4 = 1) OR (rev AND q % 4 = 2)),
    s AS (SELECT *, CASE WHEN ord < CASE WHEN implicit THEN (n + 1) // 2 ELSE n END
        THEN CAST('0x' || substr(digest, CAST(2 * ord + 1 AS INT), 2) AS INT) WHEN implicit THEN 0 END AS score FROM c)
    SELECT cg_id AS probe_id,
      CAST(count(*) FILTER (WHERE score / CAST(256 AS DOUBLE) >= CAST(CAST(0.7 AS FLOAT) AS DOUBLE)) AS BIGINT) AS n_mod,
      CAST(count(*) FILTER (WHERE score / CAST(256 AS DOUBLE) < CAST(CAST(0.3 AS FLOAT) AS DOUBLE)) AS BIGINT) AS n_unmod
    FROM s WHERE score IS NOT NULL GROUP BY cg_id HAVING n_mod + n_unmod > 0"""


READ_CALLS_SQL = read_calls_sql(PROBES_SQL)


def sequenced_reads(spark, sf) -> DataFrame:
    """Line items as aligned reads: contig, pos, flag, l_seq, cigar, seq, mm, ml (and l_orderkey)."""
    n = 1 + F.col("l_quantity").cast("int") % 16
    implicit = F.col("l_linenumber") % 2 == 0
    listed = F.when(implicit, ((n + 1) / 2).cast("int")).otherwise(n)
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return spread(items).select(
        "l_orderkey",
        (F.col("l_linenumber") % 5).cast("int").alias("contig"),
        F.col("l_partkey").alias("pos"),
        F.when(F.col("l_returnflag") == "R", 16).otherwise(0).alias("flag"),
        (4 * n).alias("l_seq"),
        F.array((4 * n * 16).cast("bigint")).alias("cigar"),
        F.unhex(F.repeat(F.lit("1248"), n)).alias("seq"),
        F.concat(F.when(implicit, "C+m").otherwise("C+m?"), F.repeat(F.lit(",0"), listed), F.lit(";")).alias("mm"),
        F.unhex(
            F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
        ).alias("ml"),
    )


@query("read_calls_full", READ_CALLS_SQL)
def read_calls_full(spark, sf):
    return C.tally(C.read_calls(sequenced_reads(spark, sf), shapes.probes(spark, sf), width=4 * PAIR_BIN), ["probe_id"])


# ---- read expressions -------------------------------------------------------------------------------

_TAGGED_SQL = """
SELECT l_suppkey, l_linenumber, l_returnflag, l_linenumber % 2 = 0 AS g1, l_returnflag = 'R' AS asked, l_linenumber % 3 = 0 AS g3,
 l_partkey % 7 AS d1, l_suppkey % 5 AS d2, CAST(l_quantity AS BIGINT) AS d3 FROM lineitem
"""


def _items(spark, sf) -> DataFrame:
    columns = ["l_suppkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    return spread(table(spark, sf, "lineitem").select(*columns))


def _tagged(spark, sf) -> DataFrame:
    c = F.col
    mm = F.concat(
        F.when(c("l_linenumber") % 2 == 0, "A+a,1,2;").otherwise(""),
        F.when(c("l_returnflag") == "R", "C+m?,").otherwise("C+m,"),
        (c("l_partkey") % 7).cast("string"), F.lit(", "), (c("l_suppkey") % 5).cast("string"), F.lit(";"),
        F.when(c("l_linenumber") % 3 == 0, F.concat(F.lit(" C+mh.,"), c("l_quantity").cast("bigint").cast("string"), F.lit(";"))).otherwise(""),
    )
    return _items(spark, sf).withColumn("mm", mm)


@query(
    "mm_parse",
    f"""WITH t AS ({_TAGGED_SQL}), g AS (
      SELECT 'A' AS base, TRUE AS implicit, 1 AS n_codes, 0 AS ml_start, 2 AS n_deltas, 3 AS delta_sum FROM t WHERE g1
      UNION ALL SELECT 'C', NOT asked, 1, CASE WHEN g1 THEN 2 ELSE 0 END, 2, d1 + d2 FROM t
      UNION ALL SELECT 'C', TRUE, 2, 2 + CASE WHEN g1 THEN 2 ELSE 0 END, 1, d3 FROM t WHERE g3)
    SELECT base, implicit, CAST(n_codes AS INT) AS n_codes, CAST(count(*) AS BIGINT) AS n_groups, CAST(sum(ml_start) AS BIGINT) AS ml_starts,
      CAST(sum(n_deltas) AS BIGINT) AS n_deltas, CAST(sum(delta_sum) AS BIGINT) AS delta_sum FROM g GROUP BY 1, 2, 3""",
)
def mm_parse(spark, sf):
    groups = _tagged(spark, sf).select(F.explode(R.parse_mm(F.col("mm"))).alias("g")).select("g.*")
    return groups.groupBy("base", "implicit", "n_codes").agg(
        F.count("*").alias("n_groups"),
        F.sum("ml_start").alias("ml_starts"),
        F.sum(F.size("deltas")).alias("n_deltas"),
        F.sum(F.aggregate("deltas", F.lit(0).cast("bigint"), lambda a, d: a + d)).alias("delta_sum"),
    )


@query(
    "mod_code_histogram",
    f"""WITH t AS ({_TAGGED_SQL}), k AS (SELECT l_suppkey, 'A+a' AS mod_code FROM t WHERE g1 UNION ALL SELECT l_suppkey, 'C+m' FROM t
      UNION ALL SELECT l_suppkey, 'C+m' FROM t WHERE g3 UNION ALL SELECT l_suppkey, 'C+h' FROM t WHERE g3)
    SELECT l_suppkey, mod_code, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1, 2""",
)
def mod_code_histogram(spark, sf):
    return qc.mod_code_histogram(_tagged(spark, sf).withColumn("flag", F.lit(0)), ["l_suppkey"])


@query(
    "tag_quality",
    f"""WITH t AS ({_TAGGED_SQL}), r AS (SELECT *, CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END AS flag,
      CASE WHEN g1 THEN 2 ELSE 0 END + 2 + CASE WHEN g3 THEN 2 ELSE 0 END AS want, l_suppkey % 4 <> 0 AS has_mm FROM t),
     s AS (SELECT *, want + CASE WHEN d1 = 0 THEN 1 ELSE 0 END AS have FROM r)
    SELECT l_suppkey, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (WHERE flag = 0) AS BIGINT) AS primary_mapped,
     CAST(count(*) FILTER (WHERE flag = 0 AND has_mm) AS BIGINT) AS with_mm,
     CAST(count(*) FILTER (WHERE flag = 0 AND has_mm AND d2 <> 1) AS BIGINT) AS with_ml,
     CAST(count(*) FILTER (WHERE flag = 0 AND has_mm AND d2 <> 1 AND (d2 = 2 OR have <> want)) AS BIGINT) AS ml_length_mismatch,
     CAST(count(*) FILTER (WHERE flag = 0 AND has_mm AND d3 % 2 = 0 AND d3 <> 10) AS BIGINT) AS mn_mismatch
    FROM s GROUP BY l_suppkey""",
)
def tag_quality(spark, sf):
    c = F.col
    want = F.when(c("l_linenumber") % 2 == 0, 2).otherwise(0) + 2 + F.when(c("l_linenumber") % 3 == 0, 2).otherwise(0)
    have = (want + F.when(c("l_partkey") % 7 == 0, 1).otherwise(0)).cast("int")
    d2, d3 = c("l_suppkey") % 5, c("l_quantity").cast("bigint")
    sampled = _tagged(spark, sf).select(
        "l_suppkey",
        F.when(c("l_linenumber") == 7, 256).otherwise(0).alias("flag"),
        F.lit(10).alias("l_seq"),
        F.when(c("l_suppkey") % 4 != 0, c("mm")).alias("mm"),
        F.encode(F.repeat(F.lit("x"), have), "UTF-8").alias("ml"),
        F.when(d2 == 2, "s").when(d2 != 1, "C").alias("ml_kind"),
        F.when(d3 % 2 == 0, d3).alias("mn"),
    )
    return qc.tag_quality(sampled, ["l_suppkey"])


@query(
    "mm_delta_running_sum",
    """SELECT user_id, event_id, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT) % 5 + 1)
      OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS base_index FROM events""",
)
def mm_delta_running_sum(spark, sf):
    delta = F.get_json_object("props", "$.k").cast("bigint") % 5
    events = table(spark, sf, "events").select("user_id", "event_id", delta.alias("delta"))
    summed = O.running_sum(events, ["user_id"], "event_id", F.col("delta") + 1, "base_index", block=4096)
    return summed.select("user_id", "event_id", (F.col("base_index") - 1).alias("base_index"))


@query(
    "base_ordinals",
    """WITH p AS (SELECT doc_id, text, length(text) AS n, list_transform(string_split(text, chr(10)), lambda x: length(x) + 1) AS len FROM documents),
     q AS (SELECT doc_id, CAST(coalesce(list_sum(len[1 : i]), 0) AS BIGINT) AS pos, text, n FROM (SELECT *, unnest(range(len(len))) AS i FROM p) u WHERE n > 0)
    SELECT DISTINCT doc_id, pos, substr(text, pos + 1, 1) = 'e' AS on_base, CAST(CASE WHEN doc_id % 2 = 1
      THEN n - pos - 1 - length(replace(substr(text, pos + 2), 'e', '')) ELSE pos - length(replace(substr(text, 1, pos), 'e', '')) END AS BIGINT) AS ordinal
    FROM q WHERE pos < n""",
)
def base_ordinals(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text")).withColumn("n", F.length("text")).filter("n > 0")
    lengths = F.transform(F.split("text", "\n", -1), lambda x: F.length(x).cast("bigint") + 1)
    grow = lambda starts, n: F.concat(starts, F.array(F.element_at(starts, -1) + n))
    grid = F.filter(F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), grow), lambda p: p < F.col("n"))
    placed = docs.withColumn("pos", F.explode(grid))
    return placed.select(
        "doc_id",
        "pos",
        (F.substr("text", (F.col("pos") + 1).cast("int"), F.lit(1)) == "e").alias("on_base"),
        R.base_ordinal(F.col("text"), F.col("pos"), "e", F.col("doc_id") % 2 == 1).alias("ordinal"),
    )


_CIGAR_SQL = """
WITH r AS (SELECT l_suppkey, l_linenumber AS a, CAST(l_quantity AS BIGINT) AS b, CAST(round(l_discount * 100) AS BIGINT) AS c,
   CAST(round(l_tax * 100) AS BIGINT) AS d, l_suppkey % 20 AS e, l_partkey FROM lineitem),
 s AS (SELECT *, b + d + e AS span, l_partkey % (b + d + e + 3) AS o FROM r)
SELECT l_suppkey, CAST(sum(span) AS BIGINT) AS spans, CAST(count(hit) AS BIGINT) AS n_aligned, CAST(sum(hit) AS BIGINT) AS read_offsets
FROM (SELECT *, CASE WHEN o < b THEN a + o WHEN o >= b + d AND o < span THEN a + b + c + (o - b - d) END AS hit FROM s) x GROUP BY l_suppkey
"""


@query("cigar_offsets", _CIGAR_SQL)
def cigar_offsets(spark, sf):
    c = F.col
    op = lambda n, code: n.cast("bigint") * 16 + code
    cigar = F.array(
        op(c("l_linenumber"), 4), op(c("l_quantity"), 0), op(F.round(c("l_discount") * 100), 1),
        op(F.round(c("l_tax") * 100), 2), op(c("l_suppkey") % 20, 7), op(F.lit(3), 5),
    )
    placed = _items(spark, sf).withColumn("cigar", cigar).withColumn("span", R.reference_span(c("cigar")))
    hit = R.read_offset_at(c("cigar"), c("l_partkey") % (c("span") + 3))
    return placed.withColumn("hit", hit).groupBy("l_suppkey").agg(
        F.sum("span").alias("spans"), F.count("hit").alias("n_aligned"), F.sum("hit").alias("read_offsets")
    )


# ---- ordered operators ------------------------------------------------------------------------------

_SPANS_SQL = """
SELECT o_orderkey // 100 AS file, o_orderkey * 10 AS first, CASE WHEN o_orderkey % 100 = 99 AND o_custkey % 7 <> 0 THEN 9223372036854775807
  WHEN o_custkey % 97 = 0 THEN o_orderkey * 10 + 11 ELSE o_orderkey * 10 + 10 END AS stop FROM orders WHERE o_custkey % 89 <> 0 OR o_orderkey % 3 = 0
"""


@query(
    "shard_chain_check",
    f"""WITH s AS ({_SPANS_SQL}), d AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE first % 1730 = 0),
     l AS (SELECT file, first, stop, lead(first) OVER (PARTITION BY file ORDER BY first, stop) AS nxt FROM d)
    SELECT file, CAST(count(*) AS BIGINT) AS n_shards, CAST(min(first) AS BIGINT) AS origin,
     bool_and(CASE WHEN nxt IS NULL THEN stop = 9223372036854775807 ELSE stop = nxt END) AND (file % 2 = 1 OR min(first) = file * 1000) AS complete FROM l GROUP BY file""",
)
def shard_chain_check(spark, sf):
    key, eof = F.col("o_orderkey"), F.lit(qc.SPAN_EOF)
    stop = (
        F.when((key % 100 == 99) & (F.col("o_custkey") % 7 != 0), eof)
        .when(F.col("o_custkey") % 97 == 0, key * 10 + 11)
        .otherwise(key * 10 + 10)
    )
    spans = (
        table(spark, sf, "orders")
        .filter("o_custkey % 89 <> 0 or o_orderkey % 3 = 0")
        .select(F.floor(key / 100).alias("file"), (key * 10).alias("first"), stop.alias("stop"))
        .withColumn("origin", F.when(F.col("file") % 2 == 0, F.col("file") * 1000))  # where the header of every other file ends
    )
    return qc.shard_chain(spans.unionByName(spans.filter("first % 1730 = 0")), ["file"])


@query(
    "chunk_merge_islands",
    """WITH s AS (SELECT CAST(l_linenumber % 5 AS INT) AS contig, l_partkey * 3 AS start, l_partkey * 3 + CAST(l_quantity AS BIGINT) % 4 AS stop
        FROM lineitem),
     o AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
     i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY start, stop) AS island FROM o)
    SELECT contig, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop FROM i GROUP BY contig, island""",
)
def chunk_merge_islands(spark, sf):
    chunks = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 5).cast("int").alias("contig"),
        (F.col("l_partkey") * 3).alias("start"),
        (F.col("l_partkey") * 3 + F.col("l_quantity").cast("bigint") % 4).alias("stop"),
    )
    return O.merge_intervals(chunks, ["contig"], block=1024).select("contig", "start", "stop")


@query(
    "equal_count_chunks",
    f"""WITH p AS (SELECT DISTINCT contig, pos FROM ({PROBES_SQL}) x), t AS (SELECT greatest(1, count(*) // 64) AS target FROM p),
     n AS (SELECT contig, count(*) AS len FROM p GROUP BY contig),
     k AS (SELECT contig, len, greatest(1, (len + target - 1) // target) AS k FROM n, t),
     r AS (SELECT p.contig, pos, row_number() OVER (PARTITION BY p.contig ORDER BY pos) - 1 AS rn, (len + k - 1) // k AS per FROM p JOIN k ON p.contig = k.contig)
    SELECT contig, CAST(rn // per AS BIGINT) AS chunk, CAST(min(pos) AS BIGINT) AS start, CAST(max(pos) + 1 AS BIGINT) AS stop, CAST(count(*) AS BIGINT) AS n
    FROM r GROUP BY contig, rn // per""",
)
def equal_count_chunks(spark, sf):
    return REF.equal_count_chunks(shapes.probes(spark, sf), n_chunks=64, block=1024)


@query(
    "lpt_shards",
    """WITH RECURSIVE c AS (SELECT p_brand AS contig, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1),
     w(k, contig, n, shard, loads) AS (
       SELECT CAST(0 AS BIGINT), CAST('' AS VARCHAR), CAST(0 AS BIGINT), 0, [CAST(0 AS BIGINT), 0, 0, 0]
       UNION ALL SELECT c.k, c.contig, c.n, list_position(loads, list_min(loads)) - 1,
         list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + c.n ELSE x END)
       FROM w JOIN c ON c.k = w.k + 1)
    SELECT contig, CAST(n AS BIGINT) AS n, CAST(shard AS INT) AS shard FROM w WHERE k > 0""",
)
def lpt_shards(spark, sf):
    sizes = table(spark, sf, "part").groupBy(F.col("p_brand").alias("contig")).agg(F.count("*").alias("n"))
    return REF.balanced_shards(sizes, 4)


@query(
    "dedupe_last_wins",
    """WITH r AS (SELECT p_size, p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_size, p_brand ORDER BY p_partkey DESC) AS k FROM part)
    SELECT p_size, p_brand, p_partkey, p_name FROM r WHERE k = 1""",
)
def dedupe_last_wins(spark, sf):
    return O.last_per_group(table(spark, sf, "part"), ["p_size", "p_brand"], F.col("p_partkey"), ["p_partkey", "p_name"])


@query(
    "alignment_bins",
    """WITH r AS (SELECT l_partkey * 4099 AS b, l_partkey * 4099 + CAST(l_quantity AS BIGINT) * CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 900 WHEN 3 THEN 90000 ELSE 300 END - 1 AS e FROM lineitem)
    SELECT CAST(CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20)
      WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = e >> 26 THEN 1 + (b >> 26) ELSE 0 END AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""",
)
def alignment_bins(spark, sf):
    start = F.col("l_partkey") * 4099
    step = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 2, 900).when(F.col("l_linenumber") == 3, 90000).otherwise(300)
    spans = table(spark, sf, "lineitem").select(start.alias("b"), (start + F.col("l_quantity").cast("bigint") * step).alias("e"))
    return spans.groupBy(REF.alignment_bin(F.col("b"), F.col("e")).alias("bin")).agg(F.count("*").alias("n"))
