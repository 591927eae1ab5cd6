"""Inputs and outputs as files: tables written in an exchange format, read back by the readers, and used."""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from methlake.model import network, weights as W
from methlake.operators import calls as C
from methlake.operators import references as REF
from methlake.operators.ordered import row_ordinal
from methlake.plans import shapes
from methlake.plans.queries_model import _Z_SQL, _logits
from methlake.plans.queries_reads import _TALLY_SQL, PAIR_BIN, READ_CALLS_SQL, _calls, read_calls_sql, sequenced_reads
from methlake.plans.registry import query, table
from methlake.plans.shapes import PROBES_SQL
from methlake.session import shared_dir
from methlake.sources import bam, text as T
from methlake.sources.bam import MAX_POSITION
from methlake.sources.bam_write import frame_bytes
from methlake.sources.files import open_output
from methlake.sources.tensors import BLOCK, read_tensors, write_tensors


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query(
    "counts_file_round_trip",
    f"SELECT 'cg' || CAST(probe AS VARCHAR) AS probe_id, n_mod, n_unmod FROM ({_TALLY_SQL}) t",
)
def counts_file_round_trip(spark, sf):
    """Five partial count tables, one per event type, written as text and added up again."""
    parts = C.tally(_calls(spark, sf), ["sample_id", "probe"])
    out = _folder(spark)
    named = C.with_fraction_text(parts.withColumn("probe_id", F.concat(F.lit("cg"), F.col("probe").cast("string"))))
    named.select("sample_id", "probe_id", "n_mod", "n_unmod", "fraction").write.partitionBy("sample_id").option("sep", "\t").option(
        "header", True
    ).csv(out)
    counts, _ = T.read_counts(spark, out)
    return C.sum_counts(counts, ["probe_id"])


@query(
    "pileup_file_scan",
    f"""SELECT p.cg_id AS probe_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_mod, CAST(sum(l_suppkey % 9) AS BIGINT) AS n_unmod
    FROM lineitem l JOIN ({PROBES_SQL}) p ON l.l_linenumber % 5 = p.contig AND l.l_partkey = p.pos GROUP BY 1""",
)
def pileup_file_scan(spark, sf):
    c = F.col
    fill = [F.lit("m"), F.lit("."), F.lit("+")] + [F.lit("0")] * 6
    items = table(spark, sf, "lineitem")
    line = F.concat_ws(
        "\t", F.concat(F.lit("chr"), (c("l_linenumber") % 5).cast("string")), c("l_partkey").cast("string"), *fill,
        c("l_quantity").cast("bigint").cast("string"), (c("l_suppkey") % 9).cast("string"),
    )
    out = _folder(spark)
    items.select(line.alias("value")).write.text(out)
    sites, _ = T.read_pileup(spark, out)
    probes = shapes.probes(spark, sf).withColumn("contig", F.concat(F.lit("chr"), F.col("contig").cast("string")))
    return REF.pileup_counts(sites, probes, [])


@query(
    "beta_file_scan",
    """WITH v AS (SELECT user_id % 10 AS s, user_id AS probe, event_id % 101 AS b FROM events WHERE event_id % 7 <> 0)
    SELECT probe, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE b > 50) AS BIGINT) AS n_plus, CAST(count(*) FILTER (WHERE b < 50) AS BIGINT) AS n_minus FROM v GROUP BY probe""",
)
def beta_file_scan(spark, sf):
    """Beta tables with quoted ids and missing values."""
    beta = F.when(F.col("event_id") % 7 == 0, "NA").otherwise(F.format_string("%.2f", (F.col("event_id") % 101) / 100.0))
    line = F.concat(F.lit('"cg'), F.col("user_id").cast("string"), F.lit('",x,'), beta)
    out = _folder(spark)
    events = table(spark, sf, "events")
    # lines are complete already, so the writer only adds its header, the column name, to every file
    lines = events.select(line.alias("Name,note,Beta"))
    lines.write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\x01").csv(out)
    values, _ = T.read_betas(spark, out)
    t = C.ternary_of_beta(F.col("beta"))
    return values.groupBy(F.expr("cast(substr(probe_id, 3) as bigint)").alias("probe")).agg(
        F.count("*").alias("n"), F.count_if(t == 1).alias("n_plus"), F.count_if(t == -1).alias("n_minus")
    )


@query(
    "tensor_file_round_trip",
    """WITH e AS (SELECT label, vec_id, unnest(embedding) AS v FROM embeddings)
    SELECT 'layer.' || CAST(label AS VARCHAR) AS name, CAST(count(*) AS BIGINT) AS n, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM e GROUP BY 1""",
)
def tensor_file_round_trip(spark, sf):
    """One matrix per label (its embeddings as rows), written to a tensor file and read back."""
    e = table(spark, sf, "embeddings")
    sized = e.groupBy("label").agg(F.count("*").alias("rows"))
    ranked = row_ordinal(e, ["label"], "vec_id", "r")
    flat = ranked.join(sized, "label").select(
        F.concat(F.lit("layer."), F.col("label").cast("string")).alias("name"),
        F.array(F.col("rows"), F.lit(64).cast("bigint")).alias("shape"),
        F.posexplode("embedding").alias("j", "v"), "r",
    ).withColumn("at", F.col("r") * 64 + F.col("j"))
    blocks = (
        flat.groupBy("name", "shape", F.floor(F.col("at") / BLOCK).cast("int").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("vs"))
        .select("name", "shape", "block", F.transform("vs", lambda x: x["v"]).alias("values"))
    )
    folder = _folder(spark)
    stored = spark.read.parquet(W.publish(blocks, folder))
    path = f"{folder}/t.safetensors"
    write_tensors(stored, path)
    values = read_tensors(spark, path).select("name", F.explode("values").alias("v"))
    return values.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 5).alias("total"))


# ---- the whole network with weights given by formulas ---------------------------------------------------

_WIDTHS = [(8, 64), (8, 8), (4, 8)]  # first.1, trunk.0.lin, heads.h.0


def _formula_weights() -> dict[str, np.ndarray]:
    w = {}
    for k, ((lin, norm), (out, width)) in enumerate(zip(network.stage_names("h", 1), _WIDTHS)):
        o = np.arange(out)
        w[f"{lin}.weight"] = (np.add.outer(o * 7, np.arange(width) * 3 + k * 5) % 11 - 5) / 8.0
        w[f"{lin}.bias"] = (o % 5 - 2) / 4.0
        w[f"{norm}.weight"], w[f"{norm}.bias"] = 1 + (o % 3) / 4.0, (o % 4) / 8.0
    w["heads.h.4.weight"] = (np.add.outer(np.arange(5) * 7, np.arange(4) * 3 + 15) % 11 - 5) / 8.0
    w["heads.h.4.bias"] = (np.arange(5) % 5 - 2) / 4.0
    return w


def _linear_sql(h: str, k: int, out: int) -> str:
    inner = f"list_sum(list_transform({h}, lambda x, i: x * ((o * 7 + (i - 1) * 3 + {k * 5}) % 11 - 5) / 8))"
    return f"list_transform(range({out}), lambda o: {inner} + CAST(o % 5 - 2 AS DOUBLE) / 4)"


def _stage_sql(k: int, source: str, out: int, residual: bool) -> str:
    y = "((u[o + 1] - m) / sd * (1 + CAST(o % 3 AS DOUBLE) / 4) + CAST(o % 4 AS DOUBLE) / 8)"
    act = f"{y} / (1 + exp(-{y}))"
    return f""" u{k} AS (SELECT vec_id, h, {_linear_sql('h', k, out)} AS u FROM {source}), m{k} AS (SELECT *, list_avg(u) AS m FROM u{k}),
 d{k} AS (SELECT *, sqrt(list_avg(list_transform(u, lambda x: (x - m) * (x - m))) + CAST(1e-5 AS DOUBLE)) AS sd FROM m{k}),
 s{k} AS (SELECT vec_id, list_transform(range({out}), lambda o: {'h[o + 1] + ' if residual else ''}{act}) AS h FROM d{k})"""


@query(
    "network_forward",
    f"""WITH z AS (SELECT vec_id, z AS h FROM ({_Z_SQL}) q),{_stage_sql(0, 'z', 8, False)},{_stage_sql(1, 's0', 8, True)},{_stage_sql(2, 's1', 4, False)},
    l AS (SELECT vec_id, {_linear_sql('h', 3, 5)} AS z FROM s2), t AS (SELECT vec_id, list_transform(z, lambda x: exp(x - list_max(z))) AS w FROM l)
    SELECT vec_id, list_transform(w, lambda x: round(x / list_sum(w), 5)) AS probs FROM t""",
)
def network_forward(spark, sf):
    w = _formula_weights()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                logits, _ = network.forward(w, np.stack(pdf["z"].to_numpy()), "h", 1)
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "p": list(network.softmax(logits))})

    out = _logits(spark, sf).select("vec_id", "z").mapInPandas(run, "vec_id bigint, p array<double>")
    return out.select("vec_id", F.transform("p", lambda x: F.round(x, 5)).alias("probs"))


READS_A_FILE = 16_000  # some thousand orders' reads
_REFS = [(f"c{i}", (1 << 31) - 1) for i in range(5)]


def _alignment_files(reads, folder: str, index: bool = False) -> list[tuple]:
    """(path, first contig, first pos, last contig, last pos) of files of neighbouring reads, by contig and pos.

    A range of places is dealt to each task, which writes its reads as files of a fixed number, one after the other.
    """

    def write(batches):
        held = []
        for pdf in batches:
            held.append(pdf)
            while sum(map(len, held)) >= READS_A_FILE:
                some = pd.concat(held, ignore_index=True)
                yield _write_file(some.iloc[:READS_A_FILE].reset_index(drop=True), folder, index)
                held = [some.iloc[READS_A_FILE:]]
        if sum(map(len, held)):
            yield _write_file(pd.concat(held, ignore_index=True), folder, index)

    placed = reads.drop("l_orderkey").repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos")
    made = placed.mapInPandas(write, "path string, contig int, pos bigint, last_contig int, last_pos bigint").collect()
    return sorted(map(tuple, made))


def _write_file(reads: pd.DataFrame, folder: str, index: bool) -> pd.DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}.bam"  # its own name, whichever attempt of a task writes it
    made = frame_bytes(_REFS, reads, level=1)  # read once
    for data, name in zip(made, (path, path + ".csi")[: 1 + index]):
        with open_output(name) as f:
            f.write(data)
    ends = [int(reads[c].iloc[i]) for i in (0, -1) for c in ("contig", "pos")]
    return pd.DataFrame([[path, *ends]], columns=["path", "contig", "pos", "last_contig", "last_pos"])


def _regions(files: list[tuple], windows: list[tuple], longest: int) -> dict[str, list[list]]:
    """By path the windows (contig, first, last) that a file's reads, none longer than `longest`, can overlap; files without any are left out."""
    windows, out = sorted(windows), {}
    for path, contig, pos, last_contig, last_pos in files:
        # windows of a contig do not overlap: one more may begin before the file's first read and reach into it
        k = max(0, bisect_left(windows, (contig, pos)) - 1)
        until = bisect_right(windows, (last_contig, last_pos + longest, MAX_POSITION))
        found = [[f"c{c}", b, e + 1] for c, b, e in windows[k:until] if (c, e) >= (contig, pos)]
        if found:
            out[path] = found
    return out


@query("alignment_file_counts", READ_CALLS_SQL)
def alignment_file_counts(spark, sf):
    """The reads of `read_calls_full` written as alignment files, scanned in several splits a file, and counted."""
    paths = [f[0] for f in _alignment_files(sequenced_reads(spark, sf), _folder(spark))]
    scanned = bam.scan(spark, paths, splitBytes=100_000).filter("kind = 'read'").withColumn("contig", F.col("rid"))
    return C.tally(C.read_calls(scanned, shapes.probes(spark, sf), width=4 * PAIR_BIN), ["probe_id"])


SPACING = 200  # places between neighbouring parts, so that reads and probes spread over many windows of the index
_PANEL_SQL = f"SELECT contig, {SPACING} * pos + 1 AS pos, cg_id FROM ({PROBES_SQL}) q WHERE contig IN (1, 3) AND pos % 1000 < 100"
_PANEL_CALLS_SQL = read_calls_sql(_PANEL_SQL, f"{SPACING} * l_partkey")


def _panel(spark, sf):
    probes = shapes.probes(spark, sf).filter("contig IN (1, 3) AND pos % 1000 < 100")
    return probes.withColumn("pos", F.col("pos") * SPACING + 1)


@query("indexed_file_counts", _PANEL_CALLS_SQL)
def indexed_file_counts(spark, sf):
    """A panel's counts from indexed alignment files: the scan reads only the stretches that can hold its probes."""
    reads = sequenced_reads(spark, sf).withColumn("pos", F.col("pos") * SPACING)
    files, panel = _alignment_files(reads, _folder(spark), index=True), _panel(spark, sf)
    windows = _regions(files, [tuple(w) for w in C.probe_windows(panel).collect()], 4 * PAIR_BIN)
    scanned = bam.scan(spark, sorted(windows), splitBytes=100_000, regions=windows).filter("kind = 'read'").withColumn("contig", F.col("rid"))
    return C.tally(C.read_calls(scanned, panel, width=4 * PAIR_BIN), ["probe_id"])


@query(
    "indexed_position_filter",
    f"""SELECT CAST(l_linenumber % 5 AS INT) AS rid, CAST({SPACING} * l_partkey AS INT) AS pos, CAST(count(*) AS BIGINT) AS n
    FROM lineitem WHERE l_linenumber % 5 IN (2, 4) AND {SPACING} * l_partkey >= 100000 AND {SPACING} * l_partkey < 160000 GROUP BY ALL""",
)
def indexed_position_filter(spark, sf):
    """Reads by reference and position: ordinary filters, which the source turns into a look-up in the index."""
    reads = sequenced_reads(spark, sf).withColumn("pos", F.col("pos") * SPACING)
    files = _alignment_files(reads, _folder(spark), index=True)
    wanted = bam.scan(spark, [f[0] for f in files], columns=["rid", "pos"]).filter("rid IN (2, 4) AND pos >= 100000 AND pos < 160000")
    return wanted.groupBy("rid", "pos").agg(F.count("*").alias("n"))
