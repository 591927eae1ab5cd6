"""Text inputs, references, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from methlake.functions.parse import csv_fields
from methlake.operators import qc
from methlake.operators import references as REF
from methlake.plans import shapes
from methlake.plans.registry import dealt, query, spread, table
from methlake.plans.shapes import PROBES_SQL, READS_SQL
from methlake.sources import text as T

# ---- text rows --------------------------------------------------------------------------------------

@query(
    "beta_clean",
    """WITH e AS (SELECT event_type, event_id % 13 AS k, event_id % 1000 AS m FROM events)
    SELECT event_type, CAST(count(*) FILTER (WHERE k IN (4, 5, 9, 10, 11, 12)) AS BIGINT) AS n_used,
     CAST(count(*) FILTER (WHERE k = 5) AS BIGINT) AS n_out_of_range, CAST(count(*) FILTER (WHERE k IN (6, 7, 8)) AS BIGINT) AS n_bad,
     CAST(sum(CASE k WHEN 5 THEN 1700 WHEN 9 THEN 100 WHEN 10 THEN 250 WHEN 11 THEN m WHEN 12 THEN m ELSE 0 END) AS BIGINT) AS milli_sum
    FROM e GROUP BY event_type""",
)
def beta_clean(spark, sf):
    k = F.col("event_id") % 13
    texts = dict(enumerate(["", "NA", "NaN", ".", "-1", "1.7", "abc", "0.5f", "inf", "1e-1", "+.25"]))
    text = F.concat(F.lit("0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    for i, t in texts.items():
        text = F.when(k == i, t).otherwise(text)
    beta, out_of_range, bad = T.beta_value(F.col("v"))
    judged = table(spark, sf, "events").select("event_type", text.alias("v")).select(
        "event_type", beta.alias("beta"), out_of_range.alias("oor"), bad.alias("bad")
    )
    return judged.groupBy("event_type").agg(
        F.count("beta").alias("n_used"),
        F.count_if("oor").alias("n_out_of_range"),
        F.count_if("bad").alias("n_bad"),
        F.sum(F.round(F.col("beta").cast("double") * 1000).cast("bigint")).alias("milli_sum"),
    )


@query(
    "csv_quoted_fields",
    """SELECT doc_id, 3 AS n_fields, md5(text) AS quoted, CAST(doc_id AS VARCHAR) AS plain, lang || '"' AS inner_quote FROM documents""",
)
def csv_quoted_fields(spark, sf):
    line = F.concat(
        F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('",'), F.col("doc_id").cast("string"),
        F.lit(","), F.col("lang"), F.lit('"\r'),
    )
    f = csv_fields(line)
    return spread(table(spark, sf, "documents").select("doc_id", "text", "lang")).select("doc_id", f.alias("f")).select(
        "doc_id",
        F.size("f").alias("n_fields"),
        F.md5(F.get("f", F.lit(0))).alias("quoted"),
        F.get("f", F.lit(1)).alias("plain"),
        F.get("f", F.lit(2)).alias("inner_quote"),
    )


@query(
    "counts_text_rows",
    """WITH r AS (SELECT o_custkey % 100 AS p, o_orderkey % 11 AS k, o_orderkey % 17 AS m, o_orderkey % 23 AS u FROM orders)
    SELECT 'cg' || CAST(p AS VARCHAR) AS probe_id, CAST(count(*) FILTER (WHERE k < 7 OR k > 9) AS BIGINT) AS n_ok, CAST(count(*) FILTER (WHERE k BETWEEN 7 AND 9) AS BIGINT) AS n_bad,
     CAST(sum(CASE WHEN k BETWEEN 7 AND 9 THEN NULL ELSE m END) AS BIGINT) AS n_mod, CAST(sum(CASE WHEN k BETWEEN 7 AND 9 THEN NULL ELSE u END) AS BIGINT) AS n_unmod
    FROM r GROUP BY p""",
)
def counts_text_rows(spark, sf):
    c = F.col
    k, m, u = c("o_orderkey") % 11, (c("o_orderkey") % 17).cast("string"), (c("o_orderkey") % 23).cast("string")
    probe = F.concat(F.lit("cg"), (c("o_custkey") % 100).cast("string"))
    tab = lambda *x: F.concat_ws("\t", *x)
    line = (
        F.when(k == 5, tab(probe, F.concat(F.lit("+"), m), u))
        .when(k == 6, tab(probe, F.concat(F.lit(" "), m, F.lit(" ")), u, F.lit("0.5")))
        .when(k == 7, tab(probe, m))
        .when(k == 8, tab(probe, F.concat(m, F.lit(".0")), u))
        .when(k == 9, tab(probe, F.concat(F.lit("-"), m), u))
        .otherwise(tab(probe, m, u))
    )
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey"))
    rows = T.count_rows(orders.select(line.alias("line")))
    return rows.groupBy("probe_id").agg(
        F.count_if("ok").alias("n_ok"),
        F.count_if(~F.col("ok")).alias("n_bad"),
        F.sum(F.when(F.col("ok"), F.col("n_mod"))).alias("n_mod"),
        F.sum(F.when(F.col("ok"), F.col("n_unmod"))).alias("n_unmod"),
    )


@query(
    "pileup_text_rows",
    """WITH r AS (SELECT l_linenumber % 5 AS contig, l_suppkey % 13 AS k, l_partkey AS pos, CAST(l_quantity AS BIGINT) AS m FROM lineitem)
    SELECT 'chr' || CAST(contig AS VARCHAR) AS contig, CAST(count(*) FILTER (WHERE k NOT IN (1, 2, 3)) AS BIGINT) AS n_ok, CAST(count(*) FILTER (WHERE k IN (2, 3)) AS BIGINT) AS n_bad,
     CAST(sum(CASE WHEN k NOT IN (1, 2, 3) THEN m END) AS BIGINT) AS n_mod, CAST(sum(CASE WHEN k NOT IN (1, 2, 3) THEN pos END) AS BIGINT) AS pos_sum
    FROM r WHERE k <> 1 GROUP BY contig""",
)
def pileup_text_rows(spark, sf):
    c = F.col
    k = c("l_suppkey") % 13
    contig = F.concat(F.lit("chr"), (c("l_linenumber") % 5).cast("string"))
    pos, m = c("l_partkey").cast("string"), c("l_quantity").cast("bigint").cast("string")
    fill = [F.lit("x")] * 9
    full = F.concat_ws("\t", contig, pos, *fill, m, F.lit("3"))
    line = (
        F.when(k == 1, F.concat(F.lit("#"), full))
        .when(k == 2, F.concat_ws("\t", contig, pos, *fill, m))
        .when(k == 3, F.concat_ws("\t", contig, F.concat(pos, F.lit("x")), *fill, m, F.lit("3")))
        .otherwise(full)
    )
    items = spread(table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", "l_quantity"))
    lines = items.select(
        F.lit("p").alias("path"), F.lit(0).alias("block"), F.lit(0).alias("row"), line.alias("line")
    )
    rows = T.pileup_rows(lines)
    used = F.col("ok")
    return rows.groupBy("contig").agg(
        F.count_if(used).alias("n_ok"),
        F.count_if(~used).alias("n_bad"),
        F.sum(F.when(used, F.col("n_mod"))).alias("n_mod"),
        F.sum(F.when(used, F.col("pos"))).alias("pos_sum"),
    )


# ---- pileups against probe maps ---------------------------------------------------------------------

_SITES_SQL = """SELECT l_returnflag AS sample_id, CAST(l_linenumber % 5 AS INT) AS contig, l_partkey AS pos,
 CAST(l_quantity AS BIGINT) AS n_mod, CAST(round(l_tax * 100) AS BIGINT) AS n_unmod FROM lineitem"""


def _sites(spark, sf) -> DataFrame:
    c = F.col
    return table(spark, sf, "lineitem").select(
        c("l_returnflag").alias("sample_id"), (c("l_linenumber") % 5).cast("int").alias("contig"), c("l_partkey").alias("pos"),
        c("l_quantity").cast("bigint").alias("n_mod"), F.round(c("l_tax") * 100).cast("bigint").alias("n_unmod"), "l_suppkey",
    )


@query(
    "pileup_equi_join",
    f"""SELECT s.sample_id, p.cg_id AS probe_id, CAST(sum(n_mod) AS BIGINT) AS n_mod, CAST(sum(n_unmod) AS BIGINT) AS n_unmod
    FROM ({_SITES_SQL}) s JOIN ({PROBES_SQL}) p ON s.contig = p.contig AND s.pos = p.pos GROUP BY 1, 2""",
)
def pileup_equi_join(spark, sf):
    return REF.pileup_counts(_sites(spark, sf), shapes.probes(spark, sf), ["sample_id"])


@query(
    "pileup_best_reference",
    f"""WITH s AS ({_SITES_SQL.replace("l_returnflag AS sample_id", "l_suppkey AS sample_id")}),
     m AS (SELECT 'A' AS assembly, 0 AS rank, contig, pos, cg_id FROM ({PROBES_SQL}) p UNION ALL SELECT 'B', 1, CAST((contig + 1) % 5 AS INT), pos, cg_id FROM ({PROBES_SQL}) p),
     c AS (SELECT sample_id, assembly, rank, cg_id, sum(n_mod) AS n_mod, sum(n_unmod) AS n_unmod FROM s JOIN m ON s.contig = m.contig AND s.pos = m.pos GROUP BY 1, 2, 3, 4),
     n AS (SELECT sample_id, assembly, rank, count(*) FILTER (WHERE n_mod + n_unmod > 0) AS n, sum(n_mod) AS total FROM c GROUP BY 1, 2, 3),
     b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, rank) AS k FROM n)
    SELECT sample_id, assembly, CAST(n AS BIGINT) AS n_covered, CAST(total AS BIGINT) AS n_mod FROM b WHERE k = 1""",
)
def pileup_best_reference(spark, sf):
    sites = _sites(spark, sf).withColumn("sample_id", F.col("l_suppkey"))
    maps = shapes.probes(spark, sf).select(
        F.explode(
            F.array(
                F.struct(F.lit("A").alias("assembly"), F.lit(0).alias("rank"), F.col("contig").alias("contig")),
                F.struct(F.lit("B").alias("assembly"), F.lit(1).alias("rank"), ((F.col("contig") + 1) % 5).alias("contig")),
            )
        ).alias("m"),
        "pos",
        F.col("cg_id").alias("probe_id"),
    ).select("m.*", "pos", "probe_id")
    counts = sites.join(maps, ["contig", "pos"]).groupBy("sample_id", "assembly", "rank", "probe_id").agg(
        F.sum("n_mod").alias("n_mod"), F.sum("n_unmod").alias("n_unmod")
    )
    return REF.best_pileup_reference(counts, ["sample_id"]).groupBy("sample_id", "assembly").agg(
        F.count_if(F.col("n_mod") + F.col("n_unmod") > 0).alias("n_covered"), F.sum("n_mod").alias("n_mod")
    )


_CHROM = "CASE WHEN p_size % 24 < 22 THEN 'chr' || CAST(p_size % 24 + 1 AS VARCHAR) WHEN p_size % 24 = 22 THEN 'chrX' ELSE 'chrY' END"


@query(
    "alias_expand",
    f"""WITH p AS (SELECT {_CHROM} AS contig, 'NC_' || lpad(CAST(60925 + p_size % 24 AS VARCHAR), 6, '0') || '.1' AS alias, p_partkey AS pos FROM part),
      u AS (SELECT contig, pos FROM p UNION ALL SELECT alias, pos FROM p)
    SELECT contig, CAST(count(*) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM u GROUP BY contig""",
)
def alias_expand(spark, sf):
    k = (F.col("p_size") % 24).cast("int")
    chrom = F.when(k < 22, F.concat(F.lit("chr"), (k + 1).cast("string"))).when(k == 22, "chrX").otherwise("chrY")
    probes = table(spark, sf, "part").select(chrom.alias("contig"), F.col("p_partkey").alias("pos"))
    return REF.with_aliases(probes, REF.alias_table(spark)).groupBy("contig").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum")
    )


_NAMES_SQL = """SELECT p_brand, p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'NC_' WHEN 1 THEN 'chr' WHEN 2 THEN 'CP' WHEN 3 THEN '' ELSE 'scaffold' END || CAST(p_size AS VARCHAR) AS contig
FROM part"""


@query(
    "contig_naming",
    f"""WITH n AS ({_NAMES_SQL}), k AS (SELECT *, CASE WHEN contig LIKE 'NC\\_%' ESCAPE '\\' THEN 'RefSeq' WHEN contig LIKE 'chr%' THEN 'UCSC' WHEN contig LIKE 'CP%' THEN 'GenBank'
      WHEN regexp_full_match(contig, '[0-9]*') THEN 'Ensembl' ELSE 'other' END AS kind FROM n)
    SELECT p_brand, string_agg(DISTINCT kind, ' / ' ORDER BY kind) || ' (e.g. ' || arg_min(contig, p_partkey) || ')' AS naming FROM k GROUP BY p_brand""",
)
def contig_naming(spark, sf):
    k = F.col("p_partkey") % 5
    stem = F.when(k == 0, "NC_").when(k == 1, "chr").when(k == 2, "CP").when(k == 3, "").otherwise("scaffold")
    names = table(spark, sf, "part").select(
        "p_brand", F.col("p_partkey").alias("ord"), F.concat(stem, F.col("p_size").cast("string")).alias("contig")
    )
    return REF.naming_summary(names, ["p_brand"])


# ---- headers against assemblies: every supplier is a file whose contigs are its line items -----------

_ASSEMBLY_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS assembly, {rank} AS rank, {i} AS i, '{REF.t2t_accession(i) if rank == 0 else c}' AS map_name, '{c}' AS chrom, CAST({n} AS BIGINT) AS length"
    for rank, (a, lengths) in enumerate(REF.CONTIG_LENGTHS.items())
    for i, (c, n) in enumerate(zip(REF.CHROMOSOMES, lengths))
)
_HEADERS_SQL = f"""
SELECT l_suppkey AS path, l_orderkey * 8 + l_linenumber AS rid, CASE WHEN l_partkey % 3 = 0 THEN a.chrom WHEN l_partkey % 3 = 1 THEN 'chrchr' || substr(a.chrom, 4)
  ELSE 'contig' || CAST(l_partkey AS VARCHAR) END AS name, a.length
FROM lineitem JOIN asm a ON a.rank = l_suppkey % 2 AND a.i = l_partkey % 24
"""
_BEST_SQL = f"""
WITH asm AS ({_ASSEMBLY_SQL}), h AS ({_HEADERS_SQL}),
 sc AS (SELECT path, assembly, rank, count(*) AS matched FROM (SELECT DISTINCT path, length FROM h) d JOIN asm ON asm.length = d.length AND asm.i < 22 GROUP BY 1, 2, 3),
 best AS (SELECT path, assembly, matched FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY matched DESC, rank DESC) AS k FROM sc) x WHERE k = 1)
"""


def _headers(spark, sf) -> DataFrame:
    c = F.col
    asm = REF.assembly_contigs(spark).select(
        "rank", "chrom", "length", F.array_position(F.lit(list(REF.CHROMOSOMES)), c("chrom")).alias("i1")
    )
    items = table(spark, sf, "lineitem")
    k = c("l_partkey") % 3
    name = F.when(k == 0, c("chrom")).when(k == 1, F.concat(F.lit("chrchr"), F.expr("substr(chrom, 4)"))).otherwise(
        F.concat(F.lit("contig"), c("l_partkey").cast("string"))
    )
    return items.join(asm, (c("rank") == c("l_suppkey") % 2) & (c("i1") - 1 == c("l_partkey") % 24)).select(
        c("l_suppkey").alias("path"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("rid"), name.alias("name"), "length"
    )


@query("assembly_best_match", _BEST_SQL + "SELECT path, assembly, CAST(matched AS BIGINT) AS matched FROM best")
def assembly_best_match(spark, sf):
    return REF.best_assembly(_headers(spark, sf), REF.assembly_contigs(spark), ["path"])


_MATCH_SQL = (
    _BEST_SQL
    + """, w AS (SELECT b.path, a.map_name, a.chrom, a.length FROM best b JOIN asm a ON a.assembly = b.assembly AND a.i < 22),
 j AS (SELECT w.*, h.rid, h.name, regexp_replace(h.name, '^(chr)+', '') = regexp_replace(w.chrom, '^(chr)+', '') OR h.name = w.map_name AS named
       FROM w LEFT JOIN h ON h.path = w.path AND h.length = w.length),
 m AS (SELECT path, map_name, chrom, CASE WHEN count(name) = 1 THEN max(name) ELSE arg_min(name, rid) FILTER (WHERE named) END AS contig FROM j GROUP BY 1, 2, 3)
"""
)


@query("contig_match", _MATCH_SQL + "SELECT path, map_name, contig FROM m")
def contig_match(spark, sf):
    headers, asm = _headers(spark, sf), REF.assembly_contigs(spark)
    chosen = REF.best_assembly(headers, asm, ["path"])
    headers = dealt(headers, table(spark, sf, "lineitem"), "path", "length")
    return REF.match_contigs(headers, chosen, asm, ["path"]).select("path", "map_name", "contig")


@query(
    "missing_contigs_anti",
    _MATCH_SQL + "SELECT path, chrom FROM m WHERE contig IS NULL",
)
def missing_contigs_anti(spark, sf):
    headers, asm = _headers(spark, sf), REF.assembly_contigs(spark)
    chosen = REF.best_assembly(headers, asm, ["path"])
    headers = dealt(headers, table(spark, sf, "lineitem"), "path", "length")
    return REF.match_contigs(headers, chosen, asm, ["path"]).filter("contig is null").select("path", "chrom")


@query(
    "index_mapped_reads",
    f"""SELECT l_suppkey AS path, CAST(sum(CASE WHEN contig IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS mapped
    FROM (SELECT l_suppkey, l_linenumber % 7 AS rid, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2) i
    LEFT JOIN (SELECT DISTINCT contig FROM ({PROBES_SQL}) p WHERE contig <> 3) c ON c.contig = i.rid GROUP BY l_suppkey""",
)
def index_mapped_reads(spark, sf):
    index = table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("path"), (F.col("l_linenumber") % 7).alias("rid")
    ).agg(F.sum("l_quantity").cast("bigint").alias("mapped"))
    wanted = shapes.probes(spark, sf).filter("contig <> 3").select(F.col("contig").alias("rid")).distinct()
    return qc.mapped_on(index, wanted, ["path"])


# ---- warnings and tiers -----------------------------------------------------------------------------


@query(
    "warning_rollup",
    """SELECT user_id % 20 AS path, event_type AS code, arg_min('value ' || CAST(event_id * 3 AS VARCHAR), event_id)
      || CASE WHEN count(*) > 1 THEN ' (and ' || CAST(count(*) - 1 AS VARCHAR) || ' more like it)' ELSE '' END AS message, CAST(count(*) AS BIGINT) AS n
    FROM events GROUP BY 1, 2""",
)
def warning_rollup(spark, sf):
    warnings = table(spark, sf, "events").select(
        (F.col("user_id") % 20).alias("path"),
        F.col("event_type").alias("code"),
        F.concat(F.lit("value "), (F.col("event_id") * 3).cast("string")).alias("message"),
        "event_id",
    )
    return qc.warning_rollup(warnings, ["path"], F.col("event_id"))


@query(
    "coverage_tier",
    """WITH c AS (SELECT o_custkey, CAST(sum(CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE o_orderkey % 2500 END) AS BIGINT) AS n FROM orders GROUP BY 1)
    SELECT CASE WHEN n = 0 THEN 'none' WHEN n < 10000 THEN 'low' ELSE 'adequate' END AS tier, CASE WHEN n = 0 THEN 'fatal' WHEN n < 10000 THEN 'warn' ELSE 'info' END AS level,
     CAST(count(*) AS BIGINT) AS n_samples FROM c GROUP BY 1, 2""",
)
def coverage_tier(spark, sf):
    weight = F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(F.col("o_orderkey") % 2500)
    covered = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(weight).alias("n"))
    return covered.groupBy(qc.coverage_tier(F.col("n")).alias("tier"), qc.coverage_level(F.col("n")).alias("level")).agg(
        F.count("*").alias("n_samples")
    )


@query(
    "checks_superseded",
    """WITH pre AS (SELECT DISTINCT user_id, event_type AS code, 'pre' AS message FROM events WHERE event_id % 3 <> 0),
      run AS (SELECT DISTINCT user_id, event_type AS code, 'run' AS message FROM events WHERE value > 200)
    SELECT * FROM pre WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.user_id = pre.user_id AND run.code = pre.code) UNION ALL SELECT * FROM run""",
)
def checks_superseded(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.col("event_type").alias("code"), "event_id", "value")
    pre = events.filter("event_id % 3 <> 0").select("user_id", "code", F.lit("pre").alias("message")).distinct()
    run = events.filter("value > 200").select("user_id", "code", F.lit("run").alias("message")).distinct()
    return qc.supersede(pre, run, ["user_id"])


@query(
    "preflight_issues",
    """WITH f AS (SELECT s_suppkey AS path, s_suppkey % 17 AS k, CAST(round(abs(s_acctbal) * 100) AS BIGINT) % 9 AS j FROM supplier),
     p AS (SELECT *, k NOT IN (0, 1, 2, 3, 4, 5) AS placed FROM f),
     u AS (SELECT *, placed AND j NOT IN (0, 1, 2, 3) AS usable FROM p),
     i AS (
      SELECT path, 'fatal' AS level, 'CRAM' AS code FROM u WHERE k = 0
      UNION ALL SELECT path, 'fatal', 'NOT_BAM' FROM u WHERE k = 1
      UNION ALL SELECT path, 'fatal', 'UNALIGNED' FROM u WHERE k = 2
      UNION ALL SELECT path, 'fatal', 'WRONG_REFERENCE' FROM u WHERE k = 3
      UNION ALL SELECT path, 'fatal', 'UNKNOWN_REFERENCE' FROM u WHERE k = 4
      UNION ALL SELECT path, 'fatal', 'NO_PROBE_MAP' FROM u WHERE k = 5
      UNION ALL SELECT path, 'warn', 'MISSING_CONTIGS' FROM u WHERE k = 6
      UNION ALL SELECT path, 'info', 'REFERENCE' FROM u WHERE placed
      UNION ALL SELECT path, 'warn', 'INDEX_MISMATCH' FROM u WHERE k IN (7, 8)
      UNION ALL SELECT path, 'warn', 'INDEX_UNREADABLE' FROM u WHERE k = 9
      UNION ALL SELECT path, 'info', 'NO_INDEX' FROM u WHERE placed AND k IN (11, 12, 13, 14, 15, 16)
      UNION ALL SELECT path, 'fatal', 'NO_MAPPED_READS' FROM u WHERE k = 10 OR (placed AND j = 0)
      UNION ALL SELECT path, 'fatal', 'NO_MOD_TAGS' FROM u WHERE placed AND j = 1
      UNION ALL SELECT path, 'fatal', 'NO_5MC' FROM u WHERE placed AND j = 2
      UNION ALL SELECT path, 'fatal', 'NO_ML' FROM u WHERE placed AND j = 3
      UNION ALL SELECT path, 'warn', 'ONLY_5HMC' FROM u WHERE usable AND j = 4
      UNION ALL SELECT path, 'warn', 'PARTIAL_MOD_TAGS' FROM u WHERE usable AND j = 5
      UNION ALL SELECT path, 'warn', 'ML_MISMATCH' FROM u WHERE usable AND j = 6
      UNION ALL SELECT path, 'warn', 'MN_MISMATCH' FROM u WHERE usable AND j = 7
      UNION ALL SELECT path, 'info', 'MOD_TAGS' FROM u WHERE usable)
    SELECT path, level, code FROM i""",
)
def preflight_issues(spark, sf):
    c = F.col
    k, j = c("s_suppkey") % 17, F.round(F.abs(c("s_acctbal")) * 100).cast("bigint") % 9
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    facts = table(spark, sf, "supplier").select(
        c("s_suppkey").alias("path"),
        F.when(k == 0, "cram").when(k == 1, "other").otherwise("bam").alias("container"),
        F.lit(None).cast("string").alias("error"),
        F.when(k == 2, 0).otherwise(25).alias("n_refs"),
        F.lit(1000).alias("size"),
        F.when(k.between(6, 8) | (k == 10), "read").when(k == 9, "unreadable").otherwise("none").alias("index_state"),
        F.lit("cut").alias("index_error"),
        F.when(k == 7, 24).otherwise(25).alias("index_refs"),
        F.when(k == 8, 1001).otherwise(1000).alias("index_reach"),
        F.when(k == 10, 0).otherwise(5).alias("mapped_on_probes"),
        F.when(~k.isin(3, 4), REF.GRCH38).alias("assembly"),
        F.when(k == 3, "GRCh37/hg19").alias("unsupported"),
        (k != 5).alias("has_probe_map"),
        F.when(k == 6, strings("chr3")).otherwise(strings()).alias("missing"),
        F.lit("UCSC (e.g. chr1)").alias("naming"),
        F.when(j == 0, 0).otherwise(100).alias("primary_mapped"),
        F.when(j <= 1, 0).when(j == 5, 89).otherwise(90).alias("with_mm"),
        F.when(j == 3, 0).otherwise(80).alias("with_ml"),
        F.when(j == 6, 5).otherwise(4).alias("ml_length_mismatch"),
        F.when(j == 7, 5).otherwise(4).alias("mn_mismatch"),
        F.when(j == 2, strings("A+a")).when(j == 4, strings("C+h")).otherwise(strings("C+m", "A+a")).alias("mod_codes"),
    )
    return qc.preflight_issues(facts).select("path", "level", "code")


@query("sha_fingerprint", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 12) AS short FROM documents")
def sha_fingerprint(spark, sf):
    digest = F.sha2("text", 256)
    return table(spark, sf, "documents").select("doc_id", digest.alias("sha"), F.substring(digest, 1, 12).alias("short"))


@query("crc_fingerprint")
def crc_fingerprint(spark, sf):
    """Checksum of every text (no such function on the SQL side; tested against zlib)."""
    return table(spark, sf, "documents").select("doc_id", F.crc32("text").alias("crc"))


@query(
    "malformed_reads",
    f"""SELECT contig, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_bad_aux, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_usable
    FROM (SELECT *, read_id % 19 <> 0 AS ok FROM ({READS_SQL}) r WHERE (flag & 2308) = 0) x GROUP BY contig""",
)
def malformed_reads(spark, sf):
    reads = shapes.reads(spark, sf).select("*", (F.col("read_id") % 19 != 0).alias("aux_ok"))
    return qc.malformed_aux(reads, ["contig"])
