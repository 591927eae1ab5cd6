"""Which reference assembly a header or a pileup belongs to, and what its contigs are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from methlake.operators.ordered import row_ordinal

# ---- fixed values: assemblies ---------------------------------------------------------------------
T2T, GRCH38 = "T2T-CHM13v2.0", "GRCh38"
PROBE_FILE = {T2T: "probes.T2T.bed", GRCH38: "probes.hg38.bed"}
CHROMOSOMES = tuple(f"chr{i}" for i in range(1, 23)) + ("chrX", "chrY")
AUTOSOMES = 22
# contig lengths in chromosome order 1..22, X, Y
CONTIG_LENGTHS = {
    T2T: (
        248387328, 242696752, 201105948, 193574945, 182045439, 172126628, 160567428, 146259331,
        150617247, 134758134, 135127769, 133324548, 113566686, 101161492, 99753195, 96330374,
        84276897, 80542538, 61707364, 66210255, 45090682, 51324926, 154259566, 62460029,
    ),
    GRCH38: (
        248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636,
        138394717, 133797422, 135086622, 133275309, 114364328, 107043718, 101991189, 90338345,
        83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415,
    ),
}
# the first assembly's accessions run in chromosome order from this number
T2T_ACCESSION_FIRST = 60925
# chromosome 1 lengths of assemblies that are recognised only to name them
UNSUPPORTED_CHR1 = {249250621: "GRCh37/hg19", 247249719: "NCBI36/hg18"}
# ---------------------------------------------------------------------------------------------------


def t2t_accession(i: int) -> str:
    return f"NC_{T2T_ACCESSION_FIRST + i:06d}.1"


def assembly_contigs(spark: SparkSession) -> DataFrame:
    """(assembly, rank, map_name, chrom, length, autosome): 48 rows."""
    rows = [
        (name, rank, t2t_accession(i) if name == T2T else chrom, chrom, length, i < AUTOSOMES)
        for rank, (name, lengths) in enumerate(CONTIG_LENGTHS.items())
        for i, (chrom, length) in enumerate(zip(CHROMOSOMES, lengths))
    ]
    return spark.createDataFrame(
        rows, "assembly string, rank int, map_name string, chrom string, length bigint, autosome boolean"
    )


def naming_class(contig: Column) -> Column:
    return (
        F.when(contig.startswith("NC_"), "RefSeq")
        .when(contig.startswith("chr"), "UCSC")
        .when(contig.startswith("CP"), "GenBank")
        .when(contig.rlike("^[0-9]*$"), "Ensembl")
        .otherwise("other")
    )


def naming_summary(contigs: DataFrame, keys: list[str], name: str = "contig", order: str = "ord") -> DataFrame:
    """(keys, naming): distinct kinds in order, with the first contig as an example."""
    return contigs.groupBy(*keys).agg(
        F.concat(
            F.array_join(F.array_sort(F.collect_set(naming_class(F.col(name)))), " / "),
            F.lit(" (e.g. "),
            F.min_by(name, order),
            F.lit(")"),
        ).alias("naming")
    )


def strip_chr(contig: Column) -> Column:
    """Every leading `chr`, however often it is repeated."""
    return F.regexp_replace(contig, "^(chr)+", "")


def best_assembly(headers: DataFrame, contigs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, assembly, matched): most autosome lengths present in the header; the later assembly on ties.

    headers: keys, name, length. Headers that match nothing are absent.
    """
    lengths = headers.select(*keys, "length").distinct()
    scored = (
        lengths.join(F.broadcast(contigs.filter("autosome")), "length")  # 44 rows
        .groupBy(*keys, "assembly", "rank")
        .agg(F.count("*").alias("matched"))
    )
    return scored.groupBy(*keys).agg(
        F.max_by(F.struct("assembly", "matched"), F.struct("matched", "rank")).alias("best")
    ).select(*keys, "best.assembly", "best.matched")


def match_contigs(headers: DataFrame, chosen: DataFrame, contigs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, assembly, map_name, chrom, contig, rid): the header's own name of each autosome, null where it is missing.

    A length held by one contig identifies it. Among several of equal length the one of matching name is
    taken (chr prefixes aside), and none if no name matches.
    """
    wanted = chosen.select(*keys, "assembly").join(F.broadcast(contigs.filter("autosome")), "assembly")  # 44 rows
    sized = headers.select(*keys, "length", F.struct(F.col("name").alias("contig"), "rid").alias("held"))
    pairs = wanted.join(sized, [*keys, "length"], "left")
    name = F.col("held.contig")
    named = F.when((strip_chr(name) == strip_chr(F.col("chrom"))) | (name == F.col("map_name")), F.col("held"))
    return (
        pairs.groupBy(*keys, "assembly", "map_name", "chrom")
        .agg(
            F.count("held").alias("n"),
            F.first("held", ignorenulls=True).alias("only"),
            F.min_by(named, named["rid"]).alias("by_name"),
        )
        .withColumn("held", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("by_name")))
        .select(*keys, "assembly", "map_name", "chrom", "held.contig", "held.rid")
    )


def alias_table(spark: SparkSession) -> DataFrame:
    """(contig, alias) in both directions for the first assembly."""
    pairs = [(t2t_accession(i), chrom) for i, chrom in enumerate(CHROMOSOMES)]
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "contig string, alias string")


def with_aliases(probes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Probe sites under every name of their contig. The alias table has 48 rows."""
    renamed = probes.join(F.broadcast(aliases), "contig").drop("contig").withColumnRenamed("alias", "contig")
    return probes.unionByName(renamed.select(*probes.columns))


def with_bare_names(probes: DataFrame) -> DataFrame:
    """Probe sites on `chr` contigs, also under the name without the prefix."""
    bare = probes.filter(F.col("contig").startswith("chr")).withColumn("contig", F.expr("substr(contig, 4)"))
    return probes.unionByName(bare)


def site_map(probes: DataFrame) -> DataFrame:
    """One probe per (contig, pos): the last one listed."""
    return probes.groupBy("contig", "pos").agg(F.max_by("cg_id", "ord").alias("cg_id"))


def pileup_counts(sites: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per probe: rows of one site are added over strands and modification codes alike."""
    return (
        sites.join(probes.select("contig", "pos", F.col("cg_id").alias("probe_id")), ["contig", "pos"])
        .groupBy(*keys, "probe_id")
        .agg(F.sum("n_mod").alias("n_mod"), F.sum("n_unmod").alias("n_unmod"))
    )


def best_pileup_reference(counts_by_assembly: DataFrame, keys: list[str]) -> DataFrame:
    """The counts against whichever assembly covers strictly more probes; the first assembly on ties.

    counts_by_assembly: keys, assembly, rank, probe_id, n_mod, n_unmod.
    """
    covered = counts_by_assembly.groupBy(*keys, "assembly", "rank").agg(
        F.count_if(F.col("n_mod") + F.col("n_unmod") > 0).alias("n")
    )
    chosen = covered.groupBy(*keys).agg(F.max_by("assembly", F.struct("n", -F.col("rank"))).alias("assembly"))
    return counts_by_assembly.join(chosen, [*keys, "assembly"])


def equal_count_chunks(probes: DataFrame, n_chunks: int, block: int = 65_536) -> DataFrame:
    """(contig, chunk, start, stop, n): contiguous stretches of about equal numbers of probe positions."""
    sites = probes.select("contig", "pos").distinct()
    per_contig = sites.groupBy("contig").agg(F.count("*").alias("len"))
    target = per_contig.agg(F.greatest(F.lit(1), F.floor(F.sum("len") / n_chunks)).alias("target"))
    k = F.greatest(F.lit(1), F.ceil(F.col("len") / F.col("target")))
    sized = per_contig.crossJoin(target).select("contig", F.ceil(F.col("len") / k).alias("per"))  # one row
    ranked = row_ordinal(sites, ["contig"], "pos", "rn", block)
    return (
        ranked.join(sized, "contig")
        .groupBy("contig", F.floor(F.col("rn") / F.col("per")).alias("chunk"))
        .agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count("*").alias("n"))
    )


def balanced_shards(sizes: DataFrame, n_shards: int) -> DataFrame:
    """(contig, n, shard): largest contig first, each into the shard that holds least so far.

    The contig list of a header is short; the running loads are folded over it inside one expression.
    """
    ordered = sizes.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "contig", "n"))).alias("items"))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), n_shards).alias("loads"),
        F.expr("cast(array() as array<struct<contig:string,n:bigint,shard:int>>)").alias("out"),
    )

    def place(state: Column, item: Column) -> Column:
        shard = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        loads = F.transform(state["loads"], lambda load, i: load + F.when(i == shard, item["n"]).otherwise(0))
        entry = F.struct(item["contig"].cast("string").alias("contig"), item["n"].alias("n"), shard.alias("shard"))
        return F.struct(loads.alias("loads"), F.concat(state["out"], F.array(entry)).alias("out"))

    return ordered.select(F.explode(F.aggregate("items", start, place, lambda s: s["out"])).alias("r")).select("r.*")


def alignment_bin(begin: Column, end: Column) -> Column:
    """Smallest bin of the five-level 16 kb scheme that contains [begin, end)."""
    last, bin_ = end - 1, F.lit(0).cast("bigint")
    for level in range(1, 6):
        shift = 29 - 3 * level
        first = ((1 << (3 * level)) - 1) // 7
        same = F.shiftright(begin, shift) == F.shiftright(last, shift)
        bin_ = F.when(same, F.lit(first) + F.shiftright(begin, shift)).otherwise(bin_)
    return bin_
