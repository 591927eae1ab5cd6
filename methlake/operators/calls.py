"""Reads and probes to per-probe methylation calls, and calls to counts, fractions and ternary vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from methlake.functions import reads as R
from methlake.functions.numeric import ratio_4dp
from methlake.operators import read_sites
from methlake.operators.intervals import interval_join, with_bins

READ_BIN = 131_072  # several spans of a long read, so that most reads touch one bin; some dozen sites lie in it


def is_usable() -> Column:
    """Primary mapped reads, placed on a reference, that carry a modification tag (flag, rid, pos, mm)."""
    return R.is_primary_mapped(F.col("flag")) & (F.col("rid") >= 0) & (F.col("pos") >= 0) & F.col("mm").isNotNull()


def site_on_read(pos: Column, reverse: Column) -> Column:
    """Where a read sees a CpG: the C itself, or one base on for a reverse alignment (its G)."""
    return pos + F.when(reverse, 1).otherwise(0)


def read_probe_pairs(
    reads: DataFrame, probes: DataFrame, width: int = READ_BIN, replicas: int = 1, how: str = "inner"
) -> DataFrame:
    """Every (read, probe) whose cytosine lies inside the read's reference span.

    reads: contig, ref_start, ref_end, is_reverse, ...; probes: contig, pos, ...
    """
    site = site_on_read(F.col("pos"), F.col("is_reverse"))
    inside = (site >= F.col("ref_start")) & (site < F.col("ref_end"))
    return interval_join(reads, probes, width, inside, replicas=replicas, how=how)


def read_calls(
    reads: DataFrame,
    probes: DataFrame,
    low: float = R.THRESHOLD_LOW,
    high: float = R.THRESHOLD_HIGH,
    width: int = READ_BIN,
    single_numeric_code: bool = True,
    carry: list[str] = [],  # noqa: B006
) -> DataFrame:
    """Outcome of every (aligned read, probe inside its span): 1, -1, 0, or null where nothing is called.

    reads: contig, pos, flag, l_seq, cigar, seq, mm, ml (+ sample_id); probes: contig, pos, cg_id.
    The sites of a bin are gathered into one array beforehand, so a read meets them in one row per bin it touches. It is
    decoded there, once, and only if a site lies inside its span; each site is then mapped through the CIGAR to one read
    base, whose ordinal among the read's cytosines is looked up in the tag (`read_sites`, for a batch of reads at once).
    With the gathered sites broadcast this is one pipelined stage: sequences are never shuffled. With columns to `carry`,
    rows that meet no probe (or have no position) stay, with a null probe.
    """
    sample = [*(c for c in ("sample_id",) if c in reads.columns), *carry]
    spans = reads.select(
        *sample,
        "contig",
        F.col("pos").cast("bigint").alias("ref_start"),
        (F.col("pos") + R.reference_span(F.col("cigar"))).alias("ref_end"),
        R.is_reverse(F.col("flag")).alias("is_reverse"),
        "l_seq", "cigar", "seq", "mm", "ml",
    )
    keep = bool(carry)
    bins = probes.groupBy("contig", F.floor(F.col("pos") / width).cast("bigint").alias("bin")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "cg_id"))).alias("near")  # bounded by the bin's width
    )
    met = with_bins(spans, width, keep_empty=keep).join(bins, ["contig", "bin"], "left" if keep else "inner").drop("contig", "bin")
    fields = [met.schema[c] for c in sample] + [T.StructField("probe_id", bins.schema["near"].dataType.elementType["cg_id"].dataType), T.StructField("outcome", T.ByteType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def decode(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            yield from read_sites.outcomes(batch, arrow, low, high, single_numeric_code, keep)

    return met.mapInArrow(decode, schema)


#: Probes closer than this are one window of an indexed scan, and no window spans more than that (a slot of the index).
WINDOW = 16_384


def probe_windows(probes: DataFrame) -> DataFrame:
    """(contig, first, last): places of the first and last probe of every slot that has any; no more rows than slots."""
    slot = F.floor(F.col("pos") / WINDOW)
    return probes.groupBy("contig", slot.alias("slot")).agg(F.min("pos").alias("first"), F.max("pos").alias("last")).drop("slot")


def tally(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Exact modified / unmodified counters; partial sums are combined before the shuffle."""
    counts = calls.groupBy(*keys).agg(
        F.count_if(F.col("outcome") == 1).alias("n_mod"), F.count_if(F.col("outcome") == -1).alias("n_unmod")
    )
    return counts.filter(F.col("n_mod") + F.col("n_unmod") > 0)


def counted(calls: DataFrame, keys: list[str], probe: str = "probe_id") -> DataFrame:
    """(keys, probe, n_mod, n_unmod, n_filtered, n): calls by outcome, those between the thresholds as filtered; and all rows."""
    return calls.groupBy(*keys, probe).agg(
        F.count_if(F.col("outcome") == 1).alias("n_mod"),
        F.count_if(F.col("outcome") == -1).alias("n_unmod"),
        F.count_if(F.col("outcome") == 0).alias("n_filtered"),
        F.count("*").alias("n"),
    )


SKETCH_BITS = 14  # 2^14 registers: a standard error of about 0.8 %


def run_totals(counts: DataFrame, keys: list[str], probe: str = "probe_id") -> DataFrame:
    """Totals of counted calls: calls kept, calls between the thresholds, probes covered, and a sketch of these.

    Totals of shards cannot add up their covered probes, as shards share probes; the sketches unite (`merged_totals`).
    """
    covered = F.col("n_mod") + F.col("n_unmod") > 0
    return counts.groupBy(*keys).agg(
        F.sum(F.col("n_mod") + F.col("n_unmod")).alias("n_called"),
        F.sum("n_filtered").alias("n_filtered"),
        F.count_if(covered).alias("n_covered"),
        F.hll_sketch_agg(F.when(covered, F.col(probe)), F.lit(SKETCH_BITS)).alias("covered"),
    )


def merged_totals(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of shards as one: exact sums, and the covered probes estimated from the united sketches."""
    return parts.groupBy(*keys).agg(
        F.sum("n_called").alias("n_called"),
        F.sum("n_filtered").alias("n_filtered"),
        F.hll_sketch_estimate(F.hll_union_agg("covered")).alias("n_covered_estimate"),
    )


def sum_counts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Add count tables: shards of one sample sum exactly to the whole."""
    return parts.groupBy(*keys).agg(F.sum("n_mod").alias("n_mod"), F.sum("n_unmod").alias("n_unmod"))


def betas(counts: DataFrame) -> DataFrame:
    """Covered rows only, with the fraction modified in single precision."""
    total = F.col("n_mod") + F.col("n_unmod")
    return counts.filter(total > 0).withColumn("beta", (F.col("n_mod") / total).cast("float"))


def with_fraction_text(counts: DataFrame) -> DataFrame:
    total = F.col("n_mod") + F.col("n_unmod")
    return counts.filter(total > 0).withColumn("fraction", ratio_4dp(F.col("n_mod"), total))


def ternary_of_beta(beta: Column) -> Column:
    return F.when(beta > 0.5, 1).when(beta < 0.5, -1).otherwise(0).cast("tinyint")


def ternary_of_counts(n_mod: Column, n_unmod: Column) -> Column:
    """The same decision without a division."""
    return F.signum((n_mod - n_unmod).cast("double")).cast("tinyint")


def ternary_vector(values: DataFrame, probes: DataFrame, keys: list[str] = ["sample_id"]) -> DataFrame:  # noqa: B006
    """Sparse ternary features of every sample: (keys, probe_idx, t), t in {-1, +1}.

    Unknown probes are dropped and missing ones are simply absent. When an id repeats, the last value that
    is not exactly 0.5 wins, in (beta, line order) as given by an optional `ord` column.
    """
    known = values.join(probes.select(F.col("cg_id").alias("probe_id"), "probe_idx"), "probe_id")
    decided = known.withColumn("t", ternary_of_beta(F.col("beta"))).filter("t != 0")
    if "ord" not in values.columns:
        return decided.select(*keys, "probe_idx", "t")
    return decided.groupBy(*keys, "probe_idx").agg(F.max_by("t", "ord").alias("t"))
