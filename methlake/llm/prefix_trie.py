"""The trie of conversations' prefixes, by digests of fixed-length blocks of turns.

Method: turns are cut into blocks of `block` turns. Conversations are grouped by the digests of their successive blocks
first. Where all conversations of a group go on through one whole block, none leaves inside it, so its nodes are read off one
of them (a straight block). Only inside the other blocks, where siblings diverge or end, turns are grouped one by one.

* A prefix's digest is the XOR over its turns of a 128-bit hash of (place, role, text): digests of blocks add up in any order,
  so they come from aggregates and running XORs; a conversation of very many turns is cut into spans that carry totals. Two of
  10^12 different prefixes share a digest with a chance of about 10^-15.
* Subtrees need no walk: the bytes saved under a node are, summed over its members, the bytes of their turns from there on that
  belong to nodes with a smaller member, and each leaf counts for the members' path that owns it. Both are grouped sums.
* Texts are reduced to digests and lengths in the first scan. All groups are aggregated before their shuffle; joins of hot
  groups have one row a group on the other side, so Spark can split them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methlake.llm.shared import stored

BLOCK = 4
#: Blocks of one conversation that are scanned in a row; ids in one packed row.
SPAN = 4096
PACKED = 4096
NODE = ["x", "y", "depth"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (turns of its conversation), a, b (digest of role and text), bytes (of the text).

    Turns are ordered by turn, null first; those of one turn by their digests. A null role or text counts as empty. Rows
    without conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = [F.xxhash64(F.lit(k), role, text).alias(c) for k, c in ((1, "a"), (2, "b"))]
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", *hashed, F.octet_length(text).cast("bigint").alias("bytes"))
    # sorted ranges of all rows: a conversation of any size is spread over several
    order = [F.col("turn").asc_nulls_first(), "a", "b"]
    ranged = stored(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    of_part = Window.partitionBy("conv_id", "part")
    counts = ranged.groupBy("conv_id", "part").agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("conv_id", "part", before.alias("before"), F.sum("here").over(Window.partitionBy("conv_id")).alias("n"))
    placed = ranged.withColumn("i", F.row_number().over(of_part.orderBy(*order))).join(counts, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("i") + F.col("before")).alias("pos"), "n", "a", "b", "bytes")


def spliced(turns: DataFrame, source: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first `shared` (at most `most`) turns of conversation `source`, then the own turns after as
    many. Both are functions of conv_id. Returns (turns, members: conv_id, n), members without turns included."""
    convs = stored(turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumns({"source": source, "h": shared}), "convs")
    theirs = convs.select(F.col("conv_id").alias("source"), F.col("own").alias("theirs"))
    convs = convs.join(theirs, "source", "left").withColumn("taken", F.least("h", F.coalesce("theirs", F.lit(0))))
    convs = stored(convs.withColumn("n", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))), "convs")
    lent = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("source"), "pos", "a", "b", "bytes")
    first = convs.select("conv_id", "source", "h", "n").join(lent, "source").where("pos <= h")
    rest = turns.drop("n").join(convs.select("conv_id", "h", "n", "taken"), "conv_id").where("pos > h").withColumn("pos", F.expr("pos - h + taken"))
    columns = ["conv_id", "pos", "n", "a", "b", "bytes"]
    return stored(first.select(*columns).unionAll(rest.select(*columns)), "turns"), convs.select("conv_id", "n")


def _xor(*columns: str) -> Column:
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out.bitwiseXOR(F.col(c))
    return out


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """A row for each block of each conversation: k, turns in it, and digest and bytes before it (x0, y0, before) and after it."""
    rows = turns.groupBy("conv_id", "k").agg(F.bit_xor("tx").alias("bx"), F.bit_xor("ty").alias("by"), F.sum("bytes").alias("bytes"), F.count("*").alias("turns"), F.max("n").alias("n"))
    rows = rows.withColumn("span", F.expr(f"k div {SPAN}"))
    carried = rows.groupBy("conv_id", "span").agg(F.bit_xor("bx").alias("sx"), F.bit_xor("by").alias("sy"), F.sum("bytes").alias("sb"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("conv_id", "span", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(c) for c, f in (("sx", F.bit_xor), ("sy", F.bit_xor), ("sb", F.sum))])
    inside = Window.partitionBy("conv_id", "span").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    for c, f in (("bx", F.bit_xor), ("by", F.bit_xor), ("bytes", F.sum)):
        rows = rows.withColumn(f"i_{c}", F.coalesce(f(c).over(inside), F.lit(0)))
    rows = rows.join(carried, ["conv_id", "span"])
    return rows.select(
        "conv_id", "k", "n", "turns", "bytes", ((F.col("k") * block) + F.col("turns")).alias("depth"),
        _xor("i_bx", "sx").alias("x0"), _xor("i_by", "sy").alias("y0"), (F.col("i_bytes") + F.col("sb")).alias("before"),
        _xor("i_bx", "sx", "bx").alias("x"), _xor("i_by", "sy", "by").alias("y"),
    )


def _straight(blocks: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """The whole blocks (by the node at their end) that all conversations of the node before them go through."""
    whole = blocks.where(F.col("turns") == block).groupBy(*NODE).agg(F.count("*").alias("through"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    whole = stored(whole, "blocks")
    root = members.agg(F.lit(0).cast("bigint").alias("x0"), F.lit(0).cast("bigint").alias("y0"), F.lit(block).cast("bigint").alias("depth"), F.count("*").alias("there"))
    above = whole.select(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("depth") + block).alias("depth"), F.col("through").alias("there"))
    return whole.join(above.unionAll(root), ["x0", "y0", "depth"]).where("through = there").select(*NODE, F.lit(True).alias("straight"))


def _ends_digest(ends: DataFrame) -> DataFrame:
    """x, y, depth, n_ends, ends_sha256: ids of one node are packed where they lie sorted, then run through SHA-256 in order."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, depth, conv = (batch.column(c).to_pylist() for c in (*NODE, "conv_id"))
            rows, at = [], 0
            for i in range(1, len(x) + 1):
                if i == len(x) or i - at == PACKED or (x[i], y[i], depth[i]) != (x[at], y[at], depth[at]):
                    rows.append((x[at], y[at], depth[at], conv[at], i - at, ",".join(map(str, conv[at:i]))))
                    at = i
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, count, state = None, 0, hashlib.sha256()
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids", "some"))):
                if row[:3] != node:
                    if node is not None:
                        out.append((*node, count, state.hexdigest()))
                    node, count, state = row[:3], 0, hashlib.sha256()
                state.update((("," if count else "") + row[4]).encode())
                count += row[3]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(done, r)) for r in out], schema=kept)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(done, (*node, count, state.hexdigest())))], schema=kept)

    names, kinds = [*NODE, "first", "ids", "some"], [*[pa.int64()] * 5, pa.string()]
    done = [*NODE, "n_ends", "ends_sha256"]
    kept = pa.schema([*[(c, pa.int64()) for c in done[:4]], ("ends_sha256", pa.string())])
    packed = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(pack, "x bigint, y bigint, depth bigint, first bigint, ids bigint, some string")
    return packed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "x bigint, y bigint, depth bigint, n_ends bigint, ends_sha256 string")


def trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node, the root (depth 0) included; no members, no rows.

    turns: as turns_of gives them, n being the turns of the conversation; members: conv_id, n, also of conversations without
    turns. Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, n_ends. (conv_id, depth) is unique.
    """
    turns = turns.withColumns({"k": F.expr(f"(pos - 1) div {block}"), "tx": F.xxhash64(F.lit(1), "pos", "a", "b"), "ty": F.xxhash64(F.lit(2), "pos", "a", "b")})
    blocks = stored(_blocks(turns, block), "blocks")
    flagged = stored(blocks.join(_straight(blocks, members, block), NODE, "left").withColumn("straight", F.col("straight").isNotNull()), "blocks")

    # members' rows at nodes: straight blocks as one (at the node of their end), turns elsewhere, and the root
    parent = [F.col("x0").alias("px"), F.col("y0").alias("py")]
    as_one = flagged.where("straight").select("conv_id", *NODE, *parent, "before", "bytes", "straight")
    inside = Window.partitionBy("conv_id", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = turns.select("conv_id", "k", "pos", "tx", "ty", F.col("bytes").alias("own")).join(flagged.where("NOT straight").select("conv_id", "k", "x0", "y0", "before"), ["conv_id", "k"])
    for c, f in (("tx", F.bit_xor), ("ty", F.bit_xor), ("own", F.sum)):
        steps = steps.withColumn(f"to_{c}", f(c).over(inside))
    steps = steps.select(
        "conv_id", _xor("x0", "to_tx").alias("x"), _xor("y0", "to_ty").alias("y"), F.col("pos").alias("depth"),
        _xor("x0", "to_tx", "tx").alias("px"), _xor("y0", "to_ty", "ty").alias("py"), F.expr("before + to_own - own").alias("before"), F.col("own").alias("bytes"), F.lit(False).alias("straight"),
    )
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    roots = members.select("conv_id", zero.alias("x"), zero.alias("y"), zero.alias("depth"), none.alias("px"), none.alias("py"), zero.alias("before"), zero.alias("bytes"), F.lit(False).alias("straight"))
    paths = stored(as_one.unionAll(steps).unionAll(roots), "paths")
    nodes = paths.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("head"), *[F.min(c).alias(c) for c in ("px", "py", "before", "bytes", "straight")])
    nodes = stored(nodes, "nodes")

    ends = blocks.where(F.col("depth") == F.col("n")).select("conv_id", *NODE).unionAll(members.where("n = 0").select("conv_id", zero.alias("x"), zero.alias("y"), zero.alias("depth")))
    below = nodes.where("depth > 0").groupBy("px", "py", F.expr(f"depth - IF(straight, {block}, 1)").alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below.withColumnsRenamed({"px": "x", "py": "y"}), NODE, "left").join(_ends_digest(ends), NODE, "left")
    nodes = stored(nodes.fillna({"n_children": 0, "n_ends": 0, "ends_sha256": NO_ENDS}), "nodes")

    # what each member adds to the nodes above those that it owns (whose smallest member it is)
    owned = nodes.groupBy(F.col("head").alias("conv_id")).agg(F.min("before").alias("since"), F.max(F.expr("IF(n_children = 0, 1, 0)")).alias("leaf"))
    total = blocks.where(F.col("depth") == F.col("n")).select("conv_id", F.expr("before + bytes").alias("total"))
    adds = members.select("conv_id").join(owned, "conv_id", "left").join(total, "conv_id", "left").select("conv_id", F.coalesce("since", "total", F.lit(0)).alias("since"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    sums = paths.select("conv_id", *NODE, "before").join(adds, "conv_id").groupBy(*NODE).agg(
        F.sum(F.greatest(F.lit(0), F.col("since") - F.col("before"))).alias("saved"), F.sum("leaf").alias("n_leaves")
    )
    nodes = stored(nodes.join(sums, NODE), "nodes")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").cast("bigint").alias("saved_tokens"), "ends_sha256", "n_ends"]
    heads = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("head").alias("parent_conv_id"))
    alone = nodes.where("NOT straight").join(heads, ["px", "py", "depth"], "left").withColumn("conv_id", F.col("head")).select(*columns)
    # a straight block's nodes have the same members, so one conversation's turns tell them all
    chains = nodes.where("straight").withColumn("k", F.expr(f"(depth - 1) div {block}")).drop("bytes")
    spread = turns.select(F.col("conv_id").alias("head"), "k", "pos", "bytes").join(chains, ["head", "k"])
    passed = F.sum("bytes").over(Window.partitionBy("head", "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    spread = spread.withColumn("passed", passed).withColumns({
        "saved": F.expr("saved - (n_convs - 1) * passed"), "n_children": F.expr("IF(pos = depth, n_children, 1)"), "n_ends": F.expr("IF(pos = depth, n_ends, 0)"),
        "ends_sha256": F.when(F.col("pos") == F.col("depth"), F.col("ends_sha256")).otherwise(NO_ENDS), "parent_conv_id": F.col("head"), "conv_id": F.col("head"),
    }).withColumn("depth", F.col("pos"))
    return alone.unionAll(spread.select(*columns))
