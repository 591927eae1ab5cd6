"""Expressions over one aligned read: flags, CIGAR, base-modification tags.

Layouts used throughout
  cigar   array<bigint>, one packed `length << 4 | op` per operation
  seq     string with one hex digit per base, i.e. `hex()` of the 4-bit packed sequence
  mm      string, the base-modification tag;  ml  binary, one probability byte per call
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from methlake.functions.binding import let

# ---- fixed values: alignment format -------------------------------------------------------------
FLAG_UNMAPPED, FLAG_REVERSE, FLAG_SECONDARY, FLAG_SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x800
BASE_CODES = "=ACMGRSVTWYHKDBN"          # letter of each 4-bit code, in code order
CIGAR_OPS = "MIDNSHP=X"                  # letter of each operation code, in code order
OPS_ON_REFERENCE = (0, 2, 3, 7, 8)       # M D N = X advance the reference
OPS_ALIGNED = (0, 7, 8)                  # M = X advance both
OPS_ON_READ_ONLY = (1, 4)                # I S advance the read
THRESHOLD_LOW, THRESHOLD_HIGH = 0.3, 0.7  # below: unmodified; at or above: modified
# -------------------------------------------------------------------------------------------------

_EXCLUDED = FLAG_UNMAPPED | FLAG_SECONDARY | FLAG_SUPPLEMENTARY


def is_primary_mapped(flag: Column) -> Column:
    """Duplicates, QC failures and mapping quality are deliberately not looked at."""
    return flag.bitwiseAND(F.lit(_EXCLUDED)) == 0


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(F.lit(FLAG_REVERSE)) != 0


def complement(bases: Column) -> Column:
    return F.translate(bases, "ACGT", "TGCA")


def op_code(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(15))


def op_length(packed: Column) -> Column:
    return F.shiftright(packed, 4)


def reference_span(cigar: Column) -> Column:
    return F.aggregate(
        cigar,
        F.lit(0).cast("bigint"),
        lambda acc, c: acc + F.when(op_code(c).isin(*OPS_ON_REFERENCE), op_length(c)).otherwise(0),
    )


def read_offset_at(cigar: Column, reference_offset: Column) -> Column:
    """Zero-based read position aligned to a reference offset; null on a deletion, skip or beyond the span."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("q"), F.lit(0).cast("bigint").alias("r"), F.lit(None).cast("bigint").alias("hit")
    )

    def step(s: Column, c: Column) -> Column:
        op, n = op_code(c), op_length(c)
        aligned = op.isin(*OPS_ALIGNED)
        inside = aligned & (reference_offset >= s["r"]) & (reference_offset < s["r"] + n)
        return F.struct(
            (s["q"] + F.when(aligned | op.isin(*OPS_ON_READ_ONLY), n).otherwise(0)).alias("q"),
            (s["r"] + F.when(op.isin(*OPS_ON_REFERENCE), n).otherwise(0)).alias("r"),
            F.when(inside, s["q"] + reference_offset - s["r"]).otherwise(s["hit"]).alias("hit"),
        )

    return F.aggregate(cigar, start, step, lambda s: s["hit"])


def parse_mm(mm: Column, single_numeric_code: bool = True) -> Column:
    """The modification tag as array<struct<base, implicit, n_codes, deltas, ml_start>>.

    A group without `?` is implicit: bases it does not list count as unmodified. `ml_start` is where the
    group's probabilities begin; groups of other bases take up room too. A numeric (ontology) code is one
    code; `single_numeric_code=False` counts its digits instead.
    """
    blocks = F.filter(F.transform(F.split(mm, ";"), lambda b: F.trim(b)), lambda b: b != "")
    heads = F.filter(blocks, lambda b: F.length(F.substring_index(b, ",", 1)) >= 3)

    def group(b: Column) -> Column:
        head = F.substring_index(b, ",", 1)
        codes = F.regexp_replace(F.substr(head, F.lit(3)), "[?.]", "")
        n_codes = F.greatest(F.length(codes), F.lit(1))
        if single_numeric_code:
            n_codes = F.when(codes.rlike("^[0-9]+$"), F.lit(1)).otherwise(n_codes)
        listed = F.transform(F.slice(F.split(b, ","), 2, 1 << 30), lambda d: F.trim(d))
        deltas = F.transform(F.filter(listed, lambda d: d.rlike(r"^\+?[0-9]+$")), lambda d: d.cast("bigint"))
        return F.struct(
            F.substring(head, 1, 1).alias("base"),
            (~F.contains(head, F.lit("?"))).alias("implicit"),
            n_codes.alias("n_codes"),
            deltas.alias("deltas"),
        )

    def placed(groups: Column) -> Column:
        return F.transform(
            groups,
            lambda g, i: F.struct(
                g["base"].alias("base"),
                g["implicit"].alias("implicit"),
                g["n_codes"].alias("n_codes"),
                g["deltas"].alias("deltas"),
                F.aggregate(
                    F.slice(groups, F.lit(1), i),
                    F.lit(0).cast("bigint"),
                    lambda acc, h: acc + F.size(h["deltas"]) * h["n_codes"],
                ).alias("ml_start"),
            ),
        )

    return let(F.transform(heads, group), placed)


def mm_codes(mm: Column) -> Column:
    """Labels such as `C+m` of every listed modification; the `?` / `.` mode is dropped."""
    blocks = F.filter(F.transform(F.split(mm, ";"), lambda b: F.trim(b)), lambda b: b != "")
    heads = F.filter(F.transform(blocks, lambda b: F.substring_index(b, ",", 1)), lambda h: F.length(h) >= 3)

    def labels(h: Column) -> Column:
        stem, body = F.substring(h, 1, 2), F.regexp_replace(F.substr(h, F.lit(3)), "[?.]+$", "")
        letters = F.filter(F.split(body, ""), lambda c: c != "")
        return F.when(body.rlike("^[0-9]*$"), F.array(F.concat(stem, body))).otherwise(
            F.transform(letters, lambda c: F.concat(stem, c))
        )

    return F.flatten(F.transform(heads, labels))


def expected_ml_length(mm: Column) -> Column:
    blocks = F.filter(F.transform(F.split(mm, ";"), lambda b: F.trim(b)), lambda b: b != "")
    heads = F.filter(blocks, lambda b: F.length(F.substring_index(b, ",", 1)) >= 3)

    def n(b: Column) -> Column:
        body = F.regexp_replace(F.substr(F.substring_index(b, ",", 1), F.lit(3)), "[?.]+$", "")
        codes = F.when(body.rlike("^[0-9]*$"), F.lit(1)).otherwise(F.greatest(F.length(body), F.lit(1)))
        deltas = F.size(F.filter(F.slice(F.split(b, ","), 2, 1 << 30), lambda d: d != ""))
        return (codes * deltas).cast("bigint")

    return F.aggregate(F.transform(heads, n), F.lit(0).cast("bigint"), lambda a, x: a + x)


def base_ordinal(seq: Column, pos: Column, symbol: Column | str, from_end: Column) -> Column:
    """How many earlier bases equal `symbol`, counted in the basecalled direction.

    One pass of string replacement over the prefix (or, for a reverse alignment, the suffix), so no
    per-base rows and no per-base array are built.
    """
    symbol = F.lit(symbol) if isinstance(symbol, str) else symbol
    before = F.substr(seq, F.lit(1), pos.cast("int"))
    after = F.substr(seq, (pos + 2).cast("int"))

    def count(part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, symbol, F.lit("")))).cast("bigint")

    return F.when(from_end, count(after)).otherwise(count(before))


def delta_index(deltas: Column, ordinal: Column) -> Column:
    """Which listed delta points at the base of this ordinal; null when it is not listed.

    The k-th delta points at ordinal sum(deltas[0..k]) + k.
    """
    start = F.struct(
        F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("next"), F.lit(None).cast("bigint").alias("hit")
    )
    return F.aggregate(
        deltas,
        start,
        lambda s, d: F.struct(
            (s["k"] + 1).alias("k"),
            (s["next"] + d + 1).alias("next"),
            F.when(s["next"] + d == ordinal, s["k"]).otherwise(s["hit"]).alias("hit"),
        ),
        lambda s: s["hit"],
    )


def byte_at(data: Column, i: Column) -> Column:
    """Unsigned byte of a binary column; null outside it."""
    return F.when(
        (i >= 0) & (i < F.octet_length(data)),
        F.conv(F.hex(F.substr(data, (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int"),
    )


def call_score(groups: Column, ml: Column, ordinal: Column) -> Column:
    """Summed probability bytes of a cytosine over all its codes and groups; null where none is listed.

    Methylation kinds are added together. Bytes are summed as integers and the sum stops at 256 (= 1.0),
    which is exact.
    """

    def of_group(total: Column, g: Column) -> Column:
        def add(k: Column) -> Column:
            at = g["ml_start"] + k * g["n_codes"]
            return F.aggregate(
                F.sequence(F.lit(0), g["n_codes"] - 1),
                total,
                lambda acc, c: let(
                    byte_at(ml, at + c), lambda b: F.when(b.isNull(), acc).otherwise(F.coalesce(acc, F.lit(0)) + b)
                ),
            )

        return let(delta_index(g["deltas"], ordinal), lambda k: F.when(k.isNull(), total).otherwise(add(k)))

    cytosine = F.filter(groups, lambda g: g["base"] == "C")
    total = F.aggregate(cytosine, F.lit(None).cast("int"), of_group)
    return let(total, lambda t: F.when(t > 256, 256).otherwise(t))


def call(score: Column, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH) -> Column:
    """True = modified, false = unmodified, null = in between. Thresholds are single precision."""
    p = score.cast("double") / 256.0
    f32 = lambda v: F.lit(v).cast("float").cast("double")
    return F.when(p >= f32(high), True).when(p < f32(low), False)


def outcome(score: Column, low: float = THRESHOLD_LOW, high: float = THRESHOLD_HIGH) -> Column:
    """1 = modified, -1 = unmodified, 0 = between the thresholds; null where there is no score."""
    return let(
        call(score, low, high),
        lambda m: F.when(score.isNull(), F.lit(None)).when(m.isNull(), 0).when(m, 1).otherwise(-1).cast("tinyint"),
    )
