"""Input quality: coverage tiers, tag statistics, shard extents, warnings, and the preflight issue list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from methlake.functions import reads as R

# ---- fixed values: levels and limits --------------------------------------------------------------
LEVELS = ("info", "warn", "fatal")  # ascending
LOW_COVERAGE = 10_000               # probes recommended
PARTIAL_TAGS, LENGTH_MISMATCH = 0.9, 0.05
SPAN_EOF = (1 << 63) - 1
# ---------------------------------------------------------------------------------------------------


def coverage_tier(n_covered: Column) -> Column:
    return F.when(n_covered == 0, "none").when(n_covered < LOW_COVERAGE, "low").otherwise("adequate")


def coverage_level(n_covered: Column) -> Column:
    return F.when(n_covered == 0, "fatal").when(n_covered < LOW_COVERAGE, "warn").otherwise("info")


def warning_rollup(warnings: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per code: the first message and how many more like it there were."""
    rolled = warnings.groupBy(*keys, "code").agg(F.min_by("message", order).alias("first"), F.count("*").alias("n"))
    more = F.concat(F.col("first"), F.lit(" (and "), (F.col("n") - 1).cast("string"), F.lit(" more like it)"))
    return rolled.select(*keys, "code", F.when(F.col("n") > 1, more).otherwise(F.col("first")).alias("message"), "n")


def supersede(prechecks: DataFrame, recovered: DataFrame, keys: list[str]) -> DataFrame:
    """Checks of the run replace prechecks of the same code."""
    kept = prechecks.join(recovered.select(*keys, "code").distinct(), [*keys, "code"], "left_anti")
    return kept.unionByName(recovered)


def shard_chain(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_shards, origin, complete): do the shards' extents cover a file exactly once?

    spans: keys, first, stop and, where known, origin, the end of the header, at which the first shard must start. Every
    stop but the last must be the start of exactly one other shard, matched by an equality join rather than by sorting
    all shards in one task. The returned `origin` is where the first shard starts.
    """
    known = F.col("origin") if "origin" in spans.columns else F.lit(None).cast("bigint")
    spans = spans.withColumn("_header", known).drop("origin")
    stops = spans.filter(F.col("stop") != SPAN_EOF).groupBy(*keys, F.col("stop").alias("at")).agg(F.count("*").alias("n_stop"))
    firsts = spans.filter(F.col("first") != SPAN_EOF).groupBy(*keys, F.col("first").alias("at")).agg(F.count("*").alias("n_first"))
    ends = spans.groupBy(*keys).agg(
        F.count("*").alias("n_shards"), F.min("first").alias("origin"), F.max("stop").alias("last_stop"),
        F.count_if((F.col("stop") == SPAN_EOF) & (F.col("first") != SPAN_EOF)).alias("n_ends"),
        F.count_if(F.col("first") != SPAN_EOF).alias("n_real"), F.min("_header").alias("header"),
    )
    seams = firsts.join(stops, [*keys, "at"], "full").join(ends.select(*keys, "origin"), keys)
    is_origin = F.col("at") == F.col("origin")
    broken = seams.filter(
        (F.coalesce("n_first", F.lit(0)) != 1)
        | (F.coalesce("n_stop", F.lit(0)) != F.when(is_origin, 0).otherwise(1))
    ).groupBy(*keys).agg(F.count("*").alias("n_broken"))
    return ends.join(broken, keys, "left").select(
        *keys,
        "n_shards",
        "origin",
        (
            F.col("n_broken").isNull()
            & (F.col("last_stop") == SPAN_EOF)
            & ((F.col("n_ends") == 1) | (F.col("n_real") == 0))
            & (F.col("header").isNull() | (F.col("n_real") == 0) | (F.col("origin") == F.col("header")))
        ).alias("complete"),
    )


def tag_quality(sampled: DataFrame, keys: list[str]) -> DataFrame:
    """Counters over sampled records (flag, l_seq, mm, ml, ml_kind, mn)."""
    primary = R.is_primary_mapped(F.col("flag"))
    tagged = primary & F.col("mm").isNotNull()
    listed = tagged & F.col("ml_kind").isNotNull()
    ml_length = F.when(F.col("ml_kind") == "C", F.octet_length("ml")).otherwise(F.lit(-1))
    return sampled.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.count_if(primary).alias("primary_mapped"),
        F.count_if(tagged).alias("with_mm"),
        F.count_if(listed).alias("with_ml"),
        F.count_if(listed & (ml_length != R.expected_ml_length(F.col("mm")))).alias("ml_length_mismatch"),
        F.count_if(tagged & F.col("mn").isNotNull() & (F.col("mn") != F.col("l_seq"))).alias("mn_mismatch"),
    )


def mod_code_histogram(sampled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mod_code, n): mentions of every modification code on primary mapped reads."""
    return (
        sampled.filter(R.is_primary_mapped(F.col("flag")) & F.col("mm").isNotNull())
        .select(*keys, F.explode(R.mm_codes(F.col("mm"))).alias("mod_code"))
        .groupBy(*keys, "mod_code")
        .agg(F.count("*").alias("n"))
    )


def program_list(header: Column) -> Column:
    """Distinct `name version` of the program lines of a header text, in order."""
    lines = F.filter(F.split(header, "\n"), lambda line: line.startswith("@PG\t"))

    def tag(line: Column, key: str) -> Column:
        found = F.filter(F.split(line, "\t"), lambda f: f.startswith(key + ":"))
        return F.substr(F.get(found, F.lit(0)), F.lit(len(key) + 2))

    named = F.filter(lines, lambda line: tag(line, "PN").isNotNull())
    return F.array_distinct(
        F.transform(
            named,
            lambda line: F.concat(tag(line, "PN"), F.coalesce(F.concat(F.lit(" "), tag(line, "VN")), F.lit(""))),
        )
    )


def sort_order(header: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(header, r"(?m)^@HD\t(?:.*\t)?SO:([^\t\n]*)", 1), F.lit("")), F.lit("unknown"))


def preflight_issues(facts: DataFrame) -> DataFrame:
    """(path, level, code, message): every check of an alignment file, most severe first.

    facts holds one row per file: container, error, n_refs, size, index_* (as scanned), assembly (null when
    none matches), unsupported (its name, if known), has_probe_map, missing (array of autosomes), naming,
    mapped_on_probes, the tag counters, and mod_codes (array of codes seen).
    """
    c = F.col
    aligned = (c("container") == "bam") & (c("n_refs") > 0)
    placed = aligned & c("assembly").isNotNull() & c("has_probe_map")
    has_5mc = F.exists("mod_codes", lambda m: m.startswith("C+m") | (m == "C+C"))
    has_5hmc = F.exists("mod_codes", lambda m: m.startswith("C+h"))
    n, mm, ml = c("primary_mapped"), c("with_mm"), c("with_ml")
    tagged = placed & (n > 0) & (mm > 0)
    usable = tagged & (has_5mc | has_5hmc) & (ml > 0)
    index_fits = (c("index_state") == "read") & (c("index_refs") == c("n_refs"))
    stale = index_fits & (c("index_reach") > c("size"))
    s = lambda x: c(x).cast("string") if isinstance(x, str) else x.cast("string")
    t = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    codes = F.array_join(F.array_sort("mod_codes"), ", ")
    checks = [
        ("fatal", "CRAM", c("container") == "cram", F.lit("CRAM input; convert it to BAM")),
        ("fatal", "NOT_BAM", c("container") == "other", t("no readable BAM header: ", F.coalesce("error", F.lit("?")))),
        ("fatal", "UNALIGNED", (c("container") == "bam") & (c("n_refs") == 0), F.lit("no reference sequences in the header")),
        ("fatal", "WRONG_REFERENCE", aligned & c("assembly").isNull() & c("unsupported").isNotNull(),
         t("aligned to ", c("unsupported"))),
        ("fatal", "UNKNOWN_REFERENCE", aligned & c("assembly").isNull() & c("unsupported").isNull(),
         t("none of the ", s("n_refs"), " contigs has a known autosome length")),
        ("fatal", "NO_PROBE_MAP", aligned & c("assembly").isNotNull() & ~c("has_probe_map"),
         t("aligned to ", c("assembly"), ", for which the model has no probe map")),
        ("warn", "MISSING_CONTIGS", placed & (F.size("missing") > 0),
         t(s(F.size("missing")), " of 22 autosomes are absent: ", F.array_join("missing", ", "))),
        ("info", "REFERENCE", placed, t(c("assembly"), ", contigs ", F.coalesce("naming", F.lit("?")))),
        ("warn", "INDEX_MISMATCH", placed & (((c("index_state") == "read") & (c("index_refs") != c("n_refs"))) | stale),
         F.lit("the index belongs to another file; it is not used")),
        ("warn", "INDEX_UNREADABLE", placed & (c("index_state") == "unreadable"), F.coalesce("index_error", F.lit("?"))),
        ("info", "NO_INDEX", placed & (c("index_state") == "none"), F.lit("no index next to the file")),
        ("fatal", "NO_MAPPED_READS",
         placed & ((index_fits & ~stale & c("index_reach").isNotNull() & (c("mapped_on_probes") == 0)) | (n == 0)),
         F.lit("no mapped reads on the probe contigs or in the sample")),
        ("fatal", "NO_MOD_TAGS", placed & (n > 0) & (mm == 0), t("none of ", s(n), " primary reads carries modification tags")),
        ("fatal", "NO_5MC", tagged & ~has_5mc & ~has_5hmc, t("no cytosine methylation codes (", codes, ")")),
        ("fatal", "NO_ML", tagged & (has_5mc | has_5hmc) & (ml == 0), F.lit("tagged reads come without probabilities")),
        ("warn", "ONLY_5HMC", usable & ~has_5mc, F.lit("cytosine calls are 5hmC only")),
        ("warn", "PARTIAL_MOD_TAGS", usable & (mm.cast("double") < PARTIAL_TAGS * n),
         t("only ", s(mm), " of ", s(n), " primary reads are tagged")),
        ("warn", "ML_MISMATCH", usable & (c("ml_length_mismatch").cast("double") > LENGTH_MISMATCH * mm),
         t(s("ml_length_mismatch"), " reads have a probability list of the wrong length")),
        ("warn", "MN_MISMATCH", usable & (c("mn_mismatch").cast("double") > LENGTH_MISMATCH * mm),
         t(s("mn_mismatch"), " reads were trimmed after tagging")),
        ("info", "MOD_TAGS", usable, t(s(mm), " of ", s(n), " primary reads tagged; codes ", codes)),
    ]
    found = F.array(
        *[
            F.when(
                F.coalesce(cond, F.lit(False)),
                F.struct(
                    F.lit(LEVELS.index(level)).alias("rank"), F.lit(level).alias("level"), F.lit(code).alias("code"),
                    message.alias("message"),
                ),
            )
            for level, code, cond, message in checks
        ]
    )
    return facts.select("path", F.explode(F.filter(found, lambda i: i.isNotNull())).alias("i")).select(
        "path", "i.rank", "i.level", "i.code", "i.message"
    )


HINTS = {
    "UNKNOWN_REFERENCE": "align to one of the supported assemblies",
    "WRONG_REFERENCE": "align again to a supported assembly, or lift the calls over",
    "NO_PROBE_MAP": "take a model that comes with this assembly's probe map",
    "MISSING_CONTIGS": "probes on the absent contigs cannot be covered; align to the whole assembly",
    "INDEX_MISMATCH": "make the index anew",
    "INDEX_UNREADABLE": "make the index anew",
    "NO_INDEX": "an index lets region reads skip most of the file",
    "NO_MAPPED_READS": "map the reads, keeping their modification tags",
    "NO_MOD_TAGS": "call bases with a modification model and keep the tags when aligning",
    "NO_5MC": "call bases with a model for 5mC in CpG",
    "NO_ML": "keep the ML tag wherever the file is converted",
    "ONLY_5HMC": "calls without 5mC tell methylated sites only in part",
    "PARTIAL_MOD_TAGS": "a step before dropped the tags of some reads",
    "ML_MISMATCH": "MM and ML were changed apart; go back to the file of the base caller",
    "MN_MISMATCH": "trim reads before calling, or with a tool that adjusts the tags",
    "BAM_CORRUPT": "copy or sort the file again; what could not be read is left out",
    "BAM_RECORD": "the program that wrote these records should be checked",
    "BAM_AUX": "the program that wrote these reads' tags should be checked",
}


def hint(code: Column) -> Column:
    """What a user can do about a finding; null where there is nothing to do."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), code)


def ordered_issues(issues: DataFrame) -> DataFrame:
    """Issues of each file by descending level, as one array per file, with hints."""
    w = F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("o"), "level", "code", "message", hint(F.col("code")).alias("hint"))))
    return issues.groupBy("path").agg(w.alias("issues"))


def mapped_on(index: DataFrame, contigs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mapped): reads an index counts on the given references. index: keys, rid, mapped."""
    marked = index.join(contigs.select("rid", F.lit(True).alias("wanted")), "rid", "left")
    return marked.groupBy(*keys).agg(F.sum(F.when(F.col("wanted"), F.col("mapped")).otherwise(0)).alias("mapped"))


def malformed_aux(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Primary mapped reads whose optional fields do not parse, and those that do."""
    return reads.filter(R.is_primary_mapped(F.col("flag"))).groupBy(*keys).agg(
        F.count_if(~F.col("aux_ok")).alias("n_bad_aux"), F.count_if("aux_ok").alias("n_usable")
    )
