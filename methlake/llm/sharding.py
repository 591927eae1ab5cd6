"""Sharding by balanced label propagation.

Vertices are distinct texts, weighted by their rows; two are linked where they share a line of `min_line` characters. Links
stay bipartite (text, line), so a line in very many texts is no clique. In each round a line takes the shard of most of its
texts, a text asks for the shard of most of its lines, and requests are granted by quotas: what two shards want to swap
balances, the rest must fit into what the target has free. A grant is drawn by a hash, so it needs no ranking. At last rows
are numbered within their label in one distributed sort, copies of a text side by side and unlinked texts last; what exceeds
a shard's exact size (row counts at most one apart) fills the shards that have room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methlake.llm.shared import stored

SHARDS = 40
ROUNDS = 4
SLACK = 0.05
MIN_LINE = 40
OVERHEAD = 16


def text_links(texts: DataFrame, min_line: int) -> DataFrame:
    """texts: g, text (distinct). Returns g, line for lines that more than one text holds."""
    lines = texts.select("g", F.explode(F.array_distinct(F.split("text", "\n"))).alias("l")).where(F.length("l") >= min_line).select("g", F.xxhash64("l").alias("line"))
    held = stored(lines.distinct(), "lines")
    # stored, so that the join reads two plain shuffles, of which AQE can split a line that very many texts hold
    shared = stored(held.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "often")
    return held.join(shared, "line")


def propagate(vertices: DataFrame, links: DataFrame, shards: int, rounds: int, slack: float) -> DataFrame:
    """vertices: g, n. links: g, line. Returns g, n, label."""
    labels = stored(vertices.withColumn("label", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")), "labels")
    loads = _loads(labels, shards)
    cap = (1 + slack) * sum(loads) / shards
    for turn in range(rounds):
        votes = links.join(labels, "g").groupBy("line", "label").agg(F.sum("n").alias("votes"))
        led = votes.groupBy("line").agg(F.max(F.struct("votes", (-F.col("label")).alias("less"))).alias("top")).select("line", (-F.col("top.less")).alias("want"))
        led = stored(led, "led")
        asked = links.join(led, "line").groupBy("g", "want").agg(F.count("*").alias("gain"))
        best = asked.groupBy("g").agg(F.max(F.struct("gain", (-F.col("want")).alias("less"))).alias("top")).select("g", (-F.col("top.less")).alias("want"))
        # a text of more than half a shard's rows stays where it is
        moves = stored(labels.join(best, "g", "left").withColumn("want", F.when(F.col("n") <= cap / 2, F.coalesce("want", "label")).otherwise(F.col("label"))), "moves")
        asks = {(r["label"], r["want"]): r["n"] for r in moves.where("want <> label").groupBy("label", "want").agg(F.sum("n").alias("n")).collect()}  # shards^2 at most
        if not asks:
            break
        chance = _chances(asks, loads, cap)
        granted = F.create_map(*[F.lit(x) for (s, t), p in sorted(chance.items()) for x in (s * shards + t, p)])
        draw = F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(1 << 30)) / F.lit(1 << 30)
        move = (F.col("want") != F.col("label")) & (draw < granted[F.col("label") * shards + F.col("want")])
        labels = stored(moves.select("g", "n", F.when(move, F.col("want")).otherwise(F.col("label")).alias("label")), "labels")
        loads = _loads(labels, shards)
    return labels


def _loads(labels: DataFrame, shards: int) -> list[int]:
    got = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _chances(asks: dict[tuple[int, int], int], loads: list[int], cap: float) -> dict[tuple[int, int], float]:
    """Share of each (from, to) request to grant; under 1, so that two texts that want each other's place do not just swap."""
    rest, swap = {}, {}
    for (s, t), n in asks.items():
        swap[s, t] = min(n, asks.get((t, s), 0))
        rest[t] = rest.get(t, 0) + n - swap[s, t]
    out = {}
    for (s, t), n in asks.items():
        fits = min(1.0, max(0.0, cap - loads[t]) / rest[t]) if rest[t] else 0.0
        out[s, t] = 0.75 * (swap[s, t] + (n - swap[s, t]) * fits) / n
    return out


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `rank`, their place in the order, from 0: a stored range sort, then a few offsets."""
    again = rows.withColumn("__u", F.monotonically_increasing_id())  # equal rows can part
    cut = again.repartitionByRange(*order, "__u").sortWithinPartitions(*order, "__u")
    kept = stored(cut.withColumn("__pid", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("__u"), name)
    offsets, total = [], 0
    for r in sorted(kept.groupBy("__pid").agg(F.count("*").alias("n")).collect()):  # as many as partitions
        offsets.append((r["__pid"], total))
        total += r["n"]
    starts = rows.sparkSession.createDataFrame(offsets, "__pid int, __start bigint")
    return kept.join(F.broadcast(starts), "__pid").withColumn("rank", F.col("__start") + F.col("__at")).drop("__pid", "__at", "__start")


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), index.cast("int") + 1)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK, min_line: int = MIN_LINE) -> DataFrame:
    """key, size (UTF-8 bytes of the text and 16), text_crc32, law ("rows"), shard, slot (gapless from 0), grown_shard (null).

    Row counts of the shards are at most one apart. Rows of equal texts share a shard unless its size cuts them; a null text
    counts as the empty one. Repeated rows and null keys are rows like others.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(whole) + OVERHEAD).cast("bigint").alias("size"), F.crc32(whole.cast("binary")).alias("crc"), F.unhex(F.md5(whole.cast("binary"))).alias("g"))
    rows = stored(rows, "rows")
    vertices = rows.groupBy("g").agg(F.count("*").alias("n"))
    links = stored(text_links(docs.select(F.unhex(F.md5(whole.cast("binary"))).alias("g"), whole.alias("text")), min_line), "shared")
    labels = propagate(vertices, links, shards, rounds, slack)
    alone = labels.join(links.select("g").distinct().withColumn("linked", F.lit(True)), "g", "left").select("g", "label", F.coalesce(~F.col("linked") & (F.col("n") == 1), F.col("n") == 1).alias("alone"))
    alone = stored(alone, "alone")  # a text with very many rows: AQE can split the join of two plain shuffles
    ranked = numbered(rows.join(alone, "g"), ["label", "alone", "g", "key"], "ranked")
    loads = {r["label"]: r["n"] for r in ranked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    load = [loads.get(s, 0) for s in range(shards)]
    total = sum(load)
    size = [total // shards + (s < total % shards) for s in range(shards)]
    first = [sum(load[:s]) for s in range(shards)]
    over = [sum(max(0, n - c) for n, c in zip(load[:s], size[:s])) for s in range(shards)]
    room = [max(0, c - n) for n, c in zip(load, size)]
    room_first = [sum(room[:s]) for s in range(shards)]
    inside = F.col("rank") - _pick(first, F.col("label"))
    stays = inside < _pick(size, F.col("label"))
    spill = inside - _pick(size, F.col("label")) + _pick(over, F.col("label"))  # rank among all rows that exceed their shard
    to = F.size(F.filter(F.array(*[F.lit(v).cast("bigint") for v in room_first]), lambda v: v <= spill)) - 1
    shard = F.when(stays, F.col("label")).otherwise(to).cast("int")
    filled = _pick([min(n, c) for n, c in zip(load, size)], to)
    slot = F.when(stays, inside).otherwise(filled + spill - _pick(room_first, to)).cast("bigint")
    return ranked.select(F.col("key").alias(key), "size", F.col("crc").cast("bigint").alias("text_crc32"), F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
