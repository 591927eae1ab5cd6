"""Line-oriented inputs. Every reader keeps `path` (one sample per file) and accounts for unreadable rows.

Line numbers need no shuffle: a line's place inside its file split follows from the row id Spark hands out
in scan order, and only the few split sizes are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from methlake.functions.parse import csv_fields, field, is_missing_beta, strict_float, strict_uint
from methlake.sources.files import qualified

# ---- fixed values: recognised CSV headers, lower case ---------------------------------------------
BETA_ID_HEADERS = ("name", "id_ref", "probe_id")
BETA_VALUE_HEADERS = ("beta", "methylation_call")
COHORT_KINDS = ("bam", "pileup", "beta")
# ---------------------------------------------------------------------------------------------------

BOM = "﻿"


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, row, line): `block` is the offset of the file split, `row` grows in scan order.

    `path` is decoded, and plain for local files, as `files.qualified` gives it for a path the user names.
    """
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(paths).select(
        F.regexp_replace(uri, "^file:/+", "/").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def split_offsets(lines: DataFrame) -> DataFrame:
    """(path, block, first_row, before): row id of each split's first line and the lines before it."""
    per_split = lines.groupBy("path", "block").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return per_split.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")


def with_line_numbers(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Add the one-based `line_no` to rows that still carry (path, block, row)."""
    return rows.join(split_offsets(lines), ["path", "block"]).withColumn(
        "line_no", F.col("before") + F.col("row") - F.col("first_row") + 1
    ).drop("before", "first_row")


def first_lines(lines: DataFrame) -> DataFrame:
    """(path, first_row, head): the first line of every file."""
    return (
        lines.filter("block = 0")
        .groupBy("path")
        .agg(F.min("row").alias("first_row"), F.min_by("line", "row").alias("head"))
    )


def bad_row_report(bad: DataFrame, lines: DataFrame, code: str) -> DataFrame:
    """(path, code, n, first_line) of rows a reader skipped."""
    first = bad.groupBy("path").agg(
        F.count("*").alias("n"), F.min(F.struct("block", "row")).alias("at")
    ).select("path", "n", "at.block", "at.row")
    return with_line_numbers(first, lines).select(
        "path", F.lit(code).alias("code"), "n", F.col("line_no").alias("first_line")
    )


def is_blank(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s", "")) == ""


# ---- pileups --------------------------------------------------------------------------------------


def pileup_rows(lines: DataFrame) -> DataFrame:
    """Parsed pileup rows with `ok`; comments and blank lines are gone, a column header is not an error.

    Thirteen or more tab-separated columns: 0 contig, 1 start, 11 modified, 12 canonical.
    """
    f = F.split("line", "\t")
    rows = lines.filter(~F.col("line").startswith("#") & ~is_blank(F.col("line"))).select(
        "path", "block", "row",
        F.size(f).alias("n_fields"),
        field(f, 1).alias("start_text"),
        field(f, 0).alias("contig"),
        strict_uint(field(f, 1)).alias("pos"),
        strict_uint(field(f, 11)).alias("n_mod"),
        strict_uint(field(f, 12)).alias("n_unmod"),
    )
    ok = (F.col("n_fields") >= 13) & F.col("pos").isNotNull() & F.col("n_mod").isNotNull() & F.col("n_unmod").isNotNull()
    return rows.withColumn("ok", ok)


def require_rows(rows: DataFrame, paths: list[str], what: str) -> None:
    """An error if one of the named files has no row at all; one short row comes back for each file."""
    there = {r["path"] for r in rows.select("path").distinct().collect()}
    absent = [p for p in paths if qualified(rows.sparkSession, p) not in there]
    if absent:
        raise ValueError(f"nothing to read in {what} {absent[0]}")


def read_pileup(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Site counts (path, contig, pos, n_mod, n_unmod) and the report of malformed rows."""
    lines = read_lines(spark, paths)
    rows = pileup_rows(lines)
    heads = first_lines(lines).select("path", F.col("first_row").alias("head_row"))
    header_like = (F.col("n_fields") >= 2) & F.col("start_text").rlike("[A-Za-z]")
    bad = (
        rows.filter(~F.col("ok"))
        .join(heads, "path")
        .filter(~((F.col("row") == F.col("head_row")) & header_like))
    )
    sites = rows.filter("ok").select("path", "contig", "pos", "n_mod", "n_unmod")
    return sites, bad_row_report(bad, lines, "PILEUP_ROWS")


# ---- beta tables ----------------------------------------------------------------------------------


def beta_value(text: Column) -> tuple[Column, Column, Column]:
    """(beta, out_of_range, bad) of a trimmed value; -1 means unmethylated, a missing value is nothing."""
    v = strict_float(text)
    number = v.isNotNull() & ~F.isnan(v)
    finite = number & (F.abs(v) != F.lit(float("inf")))
    inside = ((v >= 0) & (v <= 1)) | (v == -1)
    beta = F.when(finite, F.when(v == -1, F.lit(0.0)).otherwise(v)).cast("float")
    bad = ~F.coalesce(finite, F.lit(False)) & ~is_missing_beta(text) & ~F.coalesce(F.isnan(v), F.lit(False))
    return beta, finite & ~inside, bad


def read_betas(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, probe_id, beta, ord) and the report of unreadable and out-of-range values.

    Columns are found by name in each file's own header. Out-of-range betas are used as given.
    """
    lines = read_lines(spark, paths)
    heads = first_lines(lines)
    names = F.transform(
        csv_fields(F.regexp_replace("head", f"^{BOM}+", "")), lambda h: F.lower(F.trim(h))
    )

    def column(options: tuple[str, ...]) -> Column:
        places = F.transform(names, lambda h, i: F.when(h.isin(*options), i))
        return F.array_min(F.filter(places, lambda p: p.isNotNull()))

    located = heads.select(
        "path",
        F.col("first_row").alias("head_row"),
        column(BETA_ID_HEADERS).alias("id_at"),
        column(BETA_VALUE_HEADERS).alias("beta_at"),
    ).withColumn(
        "id_at", F.coalesce("id_at", F.raise_error(F.concat(F.lit("no probe id column in "), F.col("path"))))
    ).withColumn(
        "beta_at", F.coalesce("beta_at", F.raise_error(F.concat(F.lit("no beta column in "), F.col("path"))))
    )
    f = csv_fields(F.col("line"))
    rows = (
        lines.filter(~is_blank(F.col("line")))
        .join(located, "path")
        .filter("row != head_row")
        .withColumn("f", f)
        .select(
            "path", "block", "row",
            field(F.col("f"), F.col("id_at")).alias("probe_id"),
            F.trim(F.coalesce(field(F.col("f"), F.col("beta_at")), F.lit(""))).alias("text"),
        )
        .filter("probe_id != ''")
    )
    beta, out_of_range, bad = beta_value(F.col("text"))
    judged = rows.select("path", "block", "row", "probe_id", beta.alias("beta"), out_of_range.alias("oor"), bad.alias("bad"))
    report = bad_row_report(judged.filter("bad"), lines, "CSV_VALUES").unionByName(
        bad_row_report(judged.filter("oor"), lines, "CSV_RANGE")
    )
    values = judged.filter("beta is not null").select(
        "path", "probe_id", "beta", F.struct("block", "row").alias("ord")
    )
    return values, report


# ---- count tables ---------------------------------------------------------------------------------


def count_rows(lines: DataFrame) -> DataFrame:
    """Parsed `probe_id, n_mod, n_unmod` lines with `ok`; further columns are ignored."""
    f = F.split("line", "\t")
    rows = lines.filter(~is_blank(F.col("line"))).select(
        *[c for c in ("path", "block", "row") if c in lines.columns],
        "line",
        field(f, 0).alias("probe_id"),
        strict_uint(F.trim(field(f, 1))).alias("n_mod"),
        strict_uint(F.trim(field(f, 2))).alias("n_unmod"),
    )
    return rows.withColumn("ok", F.col("n_mod").isNotNull() & F.col("n_unmod").isNotNull())


def read_counts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, probe_id, n_mod, n_unmod) of count tables and the report of bad rows. The header is optional."""
    lines = read_lines(spark, paths)
    heads = first_lines(lines).filter(F.col("head").startswith("probe_id")).select("path", F.col("first_row").alias("row"))
    rows = count_rows(lines.join(heads, ["path", "row"], "left_anti"))
    return (
        rows.filter("ok").select("path", "probe_id", "n_mod", "n_unmod"),
        bad_row_report(rows.filter(~F.col("ok")), lines, "COUNTS_ROWS"),
    )


def read_side_files(spark: SparkSession, warnings: list[str], ranges: list[str]) -> tuple[DataFrame, DataFrame]:
    """Warning lines (path, code, message) and extents (path, first, stop, origin) written next to count tables.

    origin, where the header ends, is null in extents of two numbers.
    """
    def lines(paths: list[str]) -> DataFrame:
        return read_lines(spark, paths) if paths else spark.createDataFrame([], "path string, block bigint, row bigint, line string")

    w = lines(warnings).filter(F.contains("line", F.lit("\t"))).select(
        "path",
        F.substring_index("line", "\t", 1).alias("code"),
        F.expr("substr(line, instr(line, '\t') + 1)").alias("message"),
    )
    numbers = F.filter(F.split("line", r"\s+"), lambda x: x != "")
    r = lines(ranges).filter(~is_blank(F.col("line"))).select(
        "path", strict_uint(F.get(numbers, F.lit(0))).alias("first"), strict_uint(F.get(numbers, F.lit(1))).alias("stop"),
        strict_uint(F.get(numbers, F.lit(2))).alias("origin"),
    )
    return w, r


# ---- probe dictionaries ---------------------------------------------------------------------------


def read_probe_bed(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(contig, pos, cg_id, probe_idx, ord) of a probe map; `probe_idx` is its place in the file.

    strict: a row of fewer than four columns is an error (feature dictionary). Otherwise short and
    unreadable rows are skipped (coordinate map).
    """
    lines = read_lines(spark, path)
    numbered = with_line_numbers(lines, lines)
    f = F.split("line", "\t")
    body = numbered.filter(
        ~((F.col("line_no") == 1) & F.col("line").startswith("chrom")) & ~is_blank(F.col("line"))
    ).select(
        F.col("line_no").alias("ord"),
        F.size(f).alias("n"),
        field(f, 0).alias("contig"),
        strict_uint(field(f, 1)).alias("pos"),
        field(f, 3).alias("cg_id"),
    )
    if strict:
        short = F.raise_error(F.concat(F.lit("probe map: fewer than 4 columns at line "), F.col("ord").cast("string")))
        body = body.withColumn("cg_id", F.when(F.col("n") < 4, short.cast("string")).otherwise(F.col("cg_id")))
    else:
        body = body.filter((F.col("n") >= 4) & F.col("pos").isNotNull())
    # the dictionary is a fixed model input of bounded size, so one ordered pass numbers it
    return body.withColumn(
        "probe_idx", (F.row_number().over(Window.orderBy("ord")) - 1).cast("int")
    ).select("contig", "pos", "cg_id", "probe_idx", "ord")


def repeated_probe_ids(probes: DataFrame) -> DataFrame:
    """Ids listed more than once; a feature dictionary must have none."""
    return probes.groupBy("cg_id").agg(F.count("*").alias("n")).filter("n > 1")


# ---- cohorts --------------------------------------------------------------------------------------


def read_cohort(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, input, kind, label) of a `path TAB kind TAB label` list; malformed lines are an error."""
    lines = read_lines(spark, path)
    f = F.split("line", "\t")
    rows = with_line_numbers(
        lines.filter(~is_blank(F.col("line")) & ~F.col("line").startswith("#")), lines
    )
    complain = F.raise_error(
        F.concat(F.lit("cohort line "), F.col("line_no").cast("string"), F.lit(": expected path, kind, label"))
    ).cast("string")
    kind = field(f, 1)
    return rows.select(
        (F.col("line_no") - 1).alias("sample_id"),
        field(f, 0).alias("input"),
        F.when((F.size(f) >= 3) & kind.isin(*COHORT_KINDS), kind).otherwise(complain).alias("kind"),
        field(f, 2).alias("label"),
    )
