"""Whole jobs: from input files to counts, features, predictions and reports, for one sample or a cohort."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from methlake.functions import reads as R
from methlake.model.artifact import Model
from methlake.model.predict import predict, project
from methlake.operators import calls as C, qc, references as REF, report as REP
from methlake.session import shared_dir
from methlake.sources import bam, text as T
from methlake.sources.bam_index import index_path
from methlake.sources.files import qualified

VALUES = ("sample_id", "probe_id", "beta", "block", "row")
WARNINGS = "path string, code string, message string"


# ---- alignments -----------------------------------------------------------------------------------


def resolve(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, assembly, matched) of every header, and (path, assembly, map_name, chrom, contig, rid) of its autosomes."""
    refs = bam.scan(spark, paths, emit="refs")
    asm = REF.assembly_contigs(spark)
    chosen = REF.best_assembly(refs, asm, ["path"])
    return chosen, REF.match_contigs(refs, chosen, asm, ["path"])


def _group(assembly: str = "assembly", name: str = "map_name"):
    return F.concat_ws(":", assembly, name)


def probe_sites(spark: SparkSession, model: Model) -> DataFrame:
    """(contig, pos, cg_id) of all probe maps of a model; contig is assembly:name."""
    maps = None
    for assembly in model.assemblies():
        one = T.read_probe_bed(spark, model.path(REF.PROBE_FILE[assembly]), strict=False)
        one = REF.site_map(one.withColumn("contig", F.concat_ws(":", F.lit(assembly), "contig")))
        maps = one if maps is None else maps.unionByName(one)
    if maps is None:
        raise FileNotFoundError(f"no probe map of any assembly lies in {model.folder}")
    return maps


def bam_counts(
    spark: SparkSession, paths: list[str], model: Model, low: float = R.THRESHOLD_LOW, high: float = R.THRESHOLD_HIGH,
    shard: str | None = None,
) -> Scanned:
    """Counts (sample_id, probe_id, n_mod, n_unmod), warnings (path, code, message), extents (path, first, stop, origin).

    Totals of the run (`Scanned.totals`) come from the stored table too, without another pass over the files.

    All three come out of one scan: damage and extents travel beside the reads as rows without a position, reads meet
    broadcast sites in the scan's own stage, and only counters are shuffled. The result, no larger than probes times
    files, is stored in the shared folder.
    """
    try:
        return _bam_counts(spark, paths, model, low, high, {"shard": shard} if shard else {})
    except Exception as e:  # noqa: BLE001
        if bam.NOT_CHAINED not in str(e) or shard:
            raise
        return _bam_counts(spark, paths, model, low, high, {"splitBytes": 0})  # a file whose splits do not meet is read whole


class Scanned(tuple):
    """(counts, warnings, extents) of a scan, and beside them the `totals` of each file: n_called, n_filtered, n_covered."""

    totals: DataFrame

    def __new__(cls, counts: DataFrame, warnings: DataFrame, spans: DataFrame, totals: DataFrame) -> "Scanned":
        made = super().__new__(cls, (counts, warnings, spans))
        made.totals = totals
        return made


#: What travels beside the calls of a scan.
BESIDE = ["kind", "vpos", "stop", "origin", "code", "message"]
#: What counting takes out of a record.
COUNTED = ["path", "kind", "vpos", "rid", "pos", "flag", "l_seq", "cigar", "seq", "mm", "ml", "aux_ok", "code", "message", "stop", "origin"]


def wanted_regions(matched: DataFrame, sites: DataFrame) -> dict[str, list]:
    """path -> [[contig of the file, first, last]]: where reads can meet probes (a reverse read meets one a base further on).

    The windows are bounded by the length of the references, 16 kb each; they come to the driver, which plans the scan.
    """
    windows: dict[str, list] = {}
    for w in C.probe_windows(sites).collect():
        windows.setdefault(w["contig"], []).append((w["first"], w["last"] + 1))
    out: dict[str, list] = {}
    for m in matched.filter("contig is not null").select("path", "chrom", _group().alias("contig")).collect():  # 22 a file at most
        out.setdefault(m["path"], []).extend([m["chrom"], b, e] for b, e in windows.get(m["contig"], []))
    return out


def _bam_counts(spark, paths, model, low, high, options) -> Scanned:
    _, matched = resolve(spark, paths)
    sites = probe_sites(spark, model)
    if not options and any(index_path(p) is not None for p in paths):
        options = {"regions": wanted_regions(matched, sites)}
    rows = bam.scan(spark, paths, columns=COUNTED, **options)
    contigs = matched.filter("contig is not null").select("path", "rid", _group().alias("contig"))
    is_read = F.col("kind") == "read"
    # placed reads whose optional fields broke off before a modification tag was seen
    malformed = is_read & R.is_primary_mapped(F.col("flag")) & ~F.col("aux_ok") & F.col("mm").isNull() & (F.col("rid") >= 0) & (F.col("pos") >= 0)
    kinds = F.when(malformed, F.array(F.lit("read"), F.lit("malformed"))).otherwise(F.array("kind"))
    usable = is_read & C.is_usable()
    marked = (
        rows.withColumn("kind", F.explode(kinds))
        .withColumn("pos", F.when(usable, F.col("pos")))
        .withColumn("vpos", F.when(F.col("kind") == "span", F.col("vpos")))
        .withColumn("sample_id", F.col("path"))
        .join(F.broadcast(contigs), ["path", "rid"], "left")  # 22 rows a file at most
    )
    calls = C.read_calls(marked, sites, low, high, carry=BESIDE)
    found = C.counted(calls, ["sample_id", *BESIDE])
    stored = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex}"
    found.filter("kind != 'read' or n_mod + n_unmod + n_filtered > 0").write.parquet(stored)
    table = spark.read.parquet(stored)
    counted = table.filter("kind = 'read'")
    counts = counted.filter("n_mod + n_unmod > 0").select("sample_id", "probe_id", "n_mod", "n_unmod")
    aux = F.concat(F.col("n").cast("string"), F.lit(" reads have malformed optional fields"))
    is_issue = F.col("kind") == "issue"
    warnings = table.filter("kind in ('issue', 'malformed')").select(
        F.col("sample_id").alias("path"),
        F.when(is_issue, F.col("code")).otherwise("BAM_AUX").alias("code"),
        F.when(is_issue, F.col("message")).otherwise(aux).alias("message"),
    )
    spans = table.filter("kind = 'span'").select(F.col("sample_id").alias("path"), F.col("vpos").alias("first"), "stop", "origin")
    return Scanned(counts, warnings, spans, C.run_totals(counted, ["sample_id"]).drop("covered"))


#: What preflight looks at.
JUDGED = ["path", "kind", "flag", "l_seq", "mm", "ml", "ml_kind", "mn", "aux_ok", "code", "message"]


def preflight(spark: SparkSession, paths: list[str], model: Model | None = None, records: int = 0) -> tuple[DataFrame, DataFrame]:
    """Facts (one row per file) and issues (path, rank, level, code, message) of alignment files.

    records: judge tags by so many reads at the start of a file; 0, the default, by all of them.
    """
    files = bam.scan(spark, paths, emit="files")
    refs = bam.scan(spark, paths, emit="refs")
    readable = [r["path"] for r in files.filter("container = 'bam' and error is null").select("path").collect()]  # of the user's files
    sample = bam.scan(spark, readable, primaryLimit=records, tags="lenient", columns=JUDGED) if readable else spark.createDataFrame([], bam.READS_SCHEMA)
    chosen, matched = resolve(spark, paths)
    maps = model.assemblies() if model is not None else list(REF.PROBE_FILE)
    found = matched.groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("contig").isNull(), F.col("chrom")))).alias("missing"),
        F.array_sort(F.collect_list("rid")).alias("rids"),
    )
    present = matched.filter("contig is not null").withColumn("ord", F.col("rid"))
    naming = REF.naming_summary(present, ["path"])
    old = F.create_map(*[x for n, name in REF.UNSUPPORTED_CHR1.items() for x in (F.lit(n), F.lit(name))])
    unsupported = refs.groupBy("path").agg(F.max(F.element_at(old, F.col("length").cast("int"))).alias("unsupported"))
    read = sample.filter("kind = 'read'")
    tags = qc.tag_quality(read, ["path"])
    codes = qc.mod_code_histogram(read, ["path"]).groupBy("path").agg(
        F.array_sort(F.collect_list("mod_code")).alias("mod_codes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("mod_code", "n")))).alias("mod_code_reads"),
    )
    facts = (
        files.join(chosen.select("path", "assembly"), "path", "left")
        .join(unsupported, "path", "left")
        .join(found, "path", "left")
        .join(naming, "path", "left")
        .join(tags, "path", "left")
        .join(codes, "path", "left")
        .withColumn("has_probe_map", F.coalesce(F.col("assembly").isin(*maps), F.lit(False)) if maps else F.lit(False))
        .withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
        .withColumn("mod_codes", F.coalesce("mod_codes", F.array().cast("array<string>")))
        .withColumn(
            "mapped_on_probes",
            F.aggregate(
                F.filter("index_mapped", lambda m: F.array_contains(F.col("rids"), m["rid"])),
                F.lit(0).cast("bigint"), lambda a, m: a + m["mapped"],
            ),
        )
        .withColumn("programs", qc.program_list(F.col("header")))
        .withColumn("sort_order", qc.sort_order(F.col("header")))
        .fillna(0, ["records", "primary_mapped", "with_mm", "with_ml", "ml_length_mismatch", "mn_mismatch"])
    )
    damage = sample.filter("kind = 'issue'").select(
        "path", F.lit(qc.LEVELS.index("warn")).alias("rank"), F.lit("warn").alias("level"), "code", "message"
    )
    return facts, qc.preflight_issues(facts).unionByName(damage)


def stop_if_unusable(issues: DataFrame) -> None:
    """Raise on the first fatal finding of a file the user named."""
    fatal = issues.filter("level = 'fatal'").orderBy("path", "code").first()
    if fatal is not None:
        raise ValueError(f"{fatal['path']} is not usable: {fatal['code']}: {fatal['message']}")


def bam_values(counts: DataFrame) -> DataFrame:
    return _values(C.betas(counts))


def _values(df: DataFrame) -> DataFrame:
    """Betas in the common form; only beta tables have an order among rows of one probe."""
    if "ord" in df.columns:
        return df.select("sample_id", "probe_id", "beta", "ord.block", "ord.row")
    return df.select("sample_id", "probe_id", "beta", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"))


# ---- text inputs ----------------------------------------------------------------------------------


def pileup_values(spark: SparkSession, paths: list[str], model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Betas, warnings, and (sample_id, assembly) of pileups, each against the assembly that covers most of its sites."""
    sites, bad = T.read_pileup(spark, paths)
    T.require_rows(sites, paths, "pileup")
    maps = None
    for rank, assembly in enumerate(REF.CONTIG_LENGTHS):
        if assembly not in model.assemblies():
            continue
        one = T.read_probe_bed(spark, model.path(REF.PROBE_FILE[assembly]), strict=False)
        one = REF.with_aliases(one, REF.alias_table(spark)) if assembly == REF.T2T else REF.with_bare_names(one)
        one = REF.site_map(one).select(F.lit(assembly).alias("assembly"), F.lit(rank).alias("rank"), "contig", "pos", F.col("cg_id").alias("probe_id"))
        maps = one if maps is None else maps.unionByName(one)
    per_site = sites.groupBy(F.col("path").alias("sample_id"), "contig", "pos").agg(
        F.sum("n_mod").alias("n_mod"), F.sum("n_unmod").alias("n_unmod")
    )
    counts = (
        per_site.join(maps, ["contig", "pos"])
        .groupBy("sample_id", "assembly", "rank", "probe_id")
        .agg(F.sum("n_mod").alias("n_mod"), F.sum("n_unmod").alias("n_unmod"))
    )
    best = REF.best_pileup_reference(counts, ["sample_id"])
    return _values(C.betas(best)), _row_warnings(bad), best.select("sample_id", "assembly").distinct()


def beta_values(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    values, bad = T.read_betas(spark, paths)
    T.require_rows(T.read_lines(spark, paths), paths, "beta table")
    return _values(values.withColumnRenamed("path", "sample_id")), _row_warnings(bad)


def _row_warnings(bad: DataFrame) -> DataFrame:
    message = F.concat(F.col("n").cast("string"), F.lit(" rows, the first at line "), F.col("first_line").cast("string"))
    return bad.select("path", "code", message.alias("message"))


def counts_values(spark: SparkSession, paths: list[str], warnings: list[str] = [], ranges: list[str] = [],  # noqa: B006
                  sample_id: str = "counts") -> tuple[DataFrame, DataFrame]:
    """Betas of one sample from count tables added up, with the warnings that travelled with them.

    Where every table brings its extent, the extents must chain from one record to the end of the file.
    """
    parts, bad = T.read_counts(spark, paths)
    carried, spans = T.read_side_files(spark, warnings, ranges)
    if ranges and len(ranges) == len(paths):
        chain = qc.shard_chain(spans.withColumn("sample_id", F.lit(sample_id)), ["sample_id"]).first()
        if chain is None or not chain["complete"]:
            raise ValueError("the count tables do not cover the file exactly once")
    total = C.sum_counts(parts.withColumn("sample_id", F.lit(sample_id)), ["sample_id", "probe_id"])
    every = _row_warnings(bad).unionByName(carried.select("path", "code", "message"))
    return _values(C.betas(total)), every.withColumn("path", F.lit(sample_id))


def cohort_samples(spark: SparkSession, cohort: DataFrame) -> DataFrame:
    """(sample_id, path, label, input_id): every line of a cohort and the input whose values it has.

    input_id is the kind and the qualified path, so that a file listed twice, or by two names, is read once.
    """
    listed = cohort.select("sample_id", "input", "kind", "label").collect()  # the user's list of files
    rows = [(r["sample_id"], r["input"], r["label"], f"{r['kind']}:{qualified(spark, r['input'])}") for r in listed]
    return spark.createDataFrame(rows, "sample_id bigint, path string, label string, input_id string")


def cohort_values(spark: SparkSession, cohort: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Betas of all inputs of a cohort (sample_id = input_id of `cohort_samples`) and their warnings (path = input_id)."""
    ids = {r["input_id"] for r in cohort_samples(spark, cohort).select("input_id").distinct().collect()}
    parts = []
    for kind in T.COHORT_KINDS:
        paths = sorted(i.partition(":")[2] for i in ids if i.startswith(kind + ":"))
        if not paths:
            continue
        if kind == "bam":
            counts, warnings, _ = bam_counts(spark, paths, model)
            found = bam_values(counts), warnings
        elif kind == "pileup":
            found = pileup_values(spark, paths, model)[:2]
        else:
            found = beta_values(spark, paths)
        name = lambda c: F.concat(F.lit(f"{kind}:"), F.col(c)).alias(c)  # noqa: B023, E731
        parts.append((found[0].withColumn("sample_id", name("sample_id")), found[1].withColumn("path", name("path"))))
    if not parts:
        raise ValueError("the cohort lists no input")
    values, warnings = parts[0]
    for v, w in parts[1:]:
        values, warnings = values.unionByName(v), warnings.unionByName(w)
    return values, warnings


# ---- features, predictions, reports ---------------------------------------------------------------


def features(values: DataFrame, model: Model) -> DataFrame:
    """(sample_id, probe_idx, t) over the model's dictionary."""
    probes = model.dictionary()
    again = T.repeated_probe_ids(probes).first()
    if again is not None:
        raise ValueError(f"the probe dictionary lists {again['cg_id']} more than once")
    ordered = values.withColumn("ord", F.struct("block", "row")).drop("block", "row")
    return C.ternary_vector(ordered, probes)


def reported(values: DataFrame, model: Model, warnings: DataFrame | None = None, prechecks: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, n_covered, temperature, probs, report, input_checks) of every sample with covered probes.

    samples: sample_id; with it, exactly these are reported, covered or not.
    """
    spark = values.sparkSession
    scored = predict(project(features(values, model), model, samples=samples), model).filter(F.col("head") == model.lineage.head)
    ran = warnings if warnings is not None else spark.createDataFrame([], WARNINGS)
    rolled = qc.warning_rollup(ran, ["path"], F.col("message")).select("path", F.lit("warn").alias("level"), "code", "message")
    pre = prechecks.filter("level != 'info'") if prechecks is not None else spark.createDataFrame([], "path string, level string, code string, message string")
    checks = qc.supersede(pre.select("path", "level", "code", "message"), rolled, ["path"])
    listed = checks.groupBy(F.col("path").alias("sample_id")).agg(F.array_sort(F.collect_list(F.struct("level", "code", "message"))).alias("input_checks"))
    none = F.expr("cast(array() as array<struct<level:string,code:string,message:string>>)")
    whole = REP.with_report(scored, model.lineage).join(listed, "sample_id", "left")
    return whole.withColumn("input_checks", F.coalesce("input_checks", none)).drop("head", "logits")


# ---- sinks ----------------------------------------------------------------------------------------


def write_counts(counts: DataFrame, out: str, warnings: DataFrame | None = None, spans: DataFrame | None = None) -> None:
    """Counts as tab-separated text by probe id, with warnings and extents next to them."""
    table = C.with_fraction_text(counts).orderBy("probe_id").select("probe_id", "n_mod", "n_unmod", "fraction")
    table.write.mode("overwrite").option("sep", "\t").option("header", True).csv(out)
    if warnings is not None:
        rolled = qc.warning_rollup(warnings, [], F.col("message"))
        line = F.concat(F.col("code"), F.lit("\t"), F.regexp_replace("message", "[\t\n]", " "))
        rolled.select(line.alias("value")).write.mode("overwrite").text(out + ".warnings")
    if spans is not None:
        whole = spans.agg(F.min("first").alias("first"), F.max("stop").alias("stop"), F.min("origin").alias("origin")).filter("first is not null")
        whole.select(F.concat_ws("\t", "first", "stop", "origin").alias("value")).write.mode("overwrite").text(out + ".range")


def write_lines(values: DataFrame, out: str) -> None:
    """One document per line, e.g. JSON Lines."""
    values.select("value").write.mode("overwrite").text(out)


def inspection_text(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, value): what the checks of a file found, most severe first."""
    listed = qc.ordered_issues(issues)
    lines = F.transform("issues", lambda i: F.concat(i["level"], F.lit(" "), i["code"], F.lit(": "), i["message"], F.coalesce(F.concat(F.lit(" ("), i["hint"], F.lit(")")), F.lit(""))))
    head = F.format_string(
        "File: %s\nAssembly: %s (contig names: %s)\nReads: %d in all, %d primary and mapped, %d of these tagged\n",
        "path", F.coalesce("assembly", F.lit("none")), F.coalesce("naming", F.lit("?")), "records", "primary_mapped", "with_mm",
    )
    return facts.join(listed, "path", "left").select(
        "path", F.concat(head, F.coalesce(F.array_join(lines, "\n"), F.lit("")), F.lit("\n")).alias("value")
    )


def inspection_json(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, value): facts and issues of a file as JSON."""
    listed = qc.ordered_issues(issues).select("path", F.transform("issues", lambda i: i.dropFields("o")).alias("issues"))
    whole = facts.drop("header", "rids", "index_mapped").join(listed, "path", "left")
    return whole.select("path", F.to_json(F.struct("*")).alias("value"))
