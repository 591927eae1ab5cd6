"""Class trees: closures, mass rollup, greedy descent and alerts.

A tree is a DataFrame (node, parent) with parent ROOT at the top. It is a model artefact of a few hundred
nodes, whatever the size of the cohort, so Catalyst usually broadcasts its closure.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from methlake.functions.binding import let
from methlake.session import shared_dir

ROOT = "ROOT"
DEFAULT_THRESHOLD = 0.5  # of a depth without a calibrated one


def paths(nodes: DataFrame, height: int | None = None) -> DataFrame:
    """(node, ancestor, depth_of_ancestor, depth): every node with itself and each ancestor below the root.

    With the height known the walk is unrolled into that many joins of one plan. Otherwise pointers are doubled: a round joins
    the pairs found so far with the jumps of twice the last length, so 1,000 levels take 10 rounds. Nodes that no path from
    the root reaches, those of a cycle too, are left out.
    """
    if height is None:
        return _doubled(nodes.select("node", "parent"))
    level = nodes.filter(F.col("parent") == ROOT).select("node", F.array("node").alias("trail"))
    levels = [level]
    while len(levels) < height:
        above = levels[-1].select(F.col("node").alias("parent"), "trail")
        levels.append(nodes.join(above, "parent").select("node", F.concat("trail", F.array("node")).alias("trail")))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("node", F.posexplode("trail").alias("i", "ancestor"), F.size("trail").alias("depth")).select(
        "node", "ancestor", (F.col("i") + 1).alias("depth_of_ancestor"), "depth"
    )


def _doubled(nodes: DataFrame) -> DataFrame:
    """`paths` by pointer doubling; pairs and jumps are stored after every round."""
    n = nodes.count()
    jumps = _stored(nodes.select("node", F.col("parent").alias("ancestor")))
    pairs = _stored(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up")).distinct())
    length = 1
    while length <= n and not jumps.isEmpty():  # in a tree jumps end at the root, in a cycle they never do
        onward = jumps.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("to"))
        pairs = _stored(pairs.unionByName(pairs.join(onward, "ancestor").select("node", F.col("to").alias("ancestor"), (F.col("up") + length).alias("up"))))
        jumps = _stored(jumps.join(onward, "ancestor").select("node", F.col("to").alias("ancestor")))
        length *= 2
    depths = pairs.filter(F.col("ancestor") == ROOT).select("node", F.col("up").alias("depth"))
    found = pairs.filter(F.col("ancestor") != ROOT).join(depths, "node")
    return found.select("node", "ancestor", (F.col("depth") - F.col("up")).alias("depth_of_ancestor"), "depth")


def _stored(level: DataFrame) -> DataFrame:
    path = f"{shared_dir(level.sparkSession)}/level-{uuid.uuid4().hex}"
    level.write.parquet(path)
    return level.sparkSession.read.schema(level.schema).parquet(path)


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = nodes.select(F.col("parent").alias("node")).distinct()
    return nodes.join(parents, "node", "left_anti").select("node")


def leaf_closure(nodes: DataFrame, height: int | None = None) -> DataFrame:
    """(node, leaf, depth): the leaves under every node, a leaf under itself; depth is the node's."""
    ends = leaves(nodes).withColumnRenamed("node", "leaf")
    return (
        paths(nodes, height)
        .withColumnRenamed("node", "leaf")
        .join(ends, "leaf")
        .select(F.col("ancestor").alias("node"), "leaf", F.col("depth_of_ancestor").alias("depth"))
    )


def level_membership(nodes: DataFrame) -> DataFrame:
    """(depth, node, leaf): nodes of every depth that hold a leaf, as 0/1 matrices in sparse form."""
    return leaf_closure(nodes).select("depth", "node", "leaf")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")


def missing_leaves(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Leaves of the tree that are no output class (must be empty)."""
    return leaves(nodes).join(classes.select(F.col("class").alias("node")), "node", "left_anti")


def expand_labels(labels: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(labels..., class): the class a label names, else every class under the node it names."""
    named = classes.select(F.col("class").alias("label"), "class", F.lit(0).alias("rank"))
    below = (
        leaf_closure(nodes)
        .select(F.col("node").alias("label"), F.col("leaf").alias("class"))
        .join(classes.select("class"), "class")
        .join(classes.select(F.col("class").alias("label")), "label", "left_anti")
        .select("label", "class", F.lit(1).alias("rank"))
    )
    return labels.join(named.unionByName(below).drop("rank"), "label", "left")


def node_mass(
    leaf_mass: DataFrame, nodes: DataFrame, keys: list[str], value: str = "p", height: int | None = None
) -> DataFrame:
    """(keys, node, depth, value): summed mass of the leaves under every node. Unlisted leaves weigh nothing."""
    return (
        leaf_mass.join(leaf_closure(nodes, height), "leaf")
        .groupBy(*keys, "node", "depth")
        .agg(F.sum(value).alias(value))
    )


def descend(
    leaf_mass: DataFrame,
    nodes: DataFrame,
    thresholds: DataFrame,
    keys: list[str],
    height: int,
    value: str = "p",
) -> DataFrame:
    """Greedy walk from the root, always into the child of greatest mass (alphabetically first on ties).

    Per sample the best child of each inner node is kept in one map, no larger than the tree, and the walk is
    an expression over that map: the number of shuffles does not depend on the height of the tree.
    One row per step: keys, depth, node, value, tau, met. A step counts as met only if all before it are.
    """
    mass = node_mass(leaf_mass, nodes, keys, value, height)
    best = (
        mass.join(nodes, "node")
        .groupBy(*keys, "parent")
        .agg(F.min_by(F.struct("node", F.col(value).alias("p")), F.struct(-F.col(value), F.col("node"))).alias("pick"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("parent", "pick"))).alias("picks"))
    )
    taus = thresholds.agg(F.map_from_entries(F.collect_list(F.struct(F.col("depth").cast("int"), "tau"))).alias("taus"))

    def step(trail: Column, depth: Column) -> Column:
        def entry(pick: Column) -> Column:
            so_far = F.coalesce(F.get(trail, F.size(trail) - 1)["met"], F.lit(True))
            tau = F.coalesce(F.element_at("taus", depth), F.lit(DEFAULT_THRESHOLD))
            p = pick["p"].cast("double")
            return F.struct(
                depth.alias("depth"), pick["node"].alias("node"), p.alias("p"), tau.alias("tau"), (so_far & (p >= tau)).alias("met")
            )

        return let(
            F.element_at("picks", _last_node(trail)),
            lambda pick: F.when(pick.isNotNull(), F.concat(trail, F.array(entry(pick)))).otherwise(trail),
        )

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(height)), F.expr(_NO_STEPS), step)
    steps = best.crossJoin(taus).select(*keys, F.explode(walk).alias("step"))  # one row of thresholds
    return steps.select(*keys, "step.*")


_NO_STEPS = "cast(array() as array<struct<depth:int,node:string,p:double,tau:double,met:boolean>>)"


def _last_node(trail: Column) -> Column:
    return F.coalesce(F.get(trail, F.size(trail) - 1)["node"], F.lit(ROOT))


def call(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, call, call_depth, call_p): the deepest accepted step; no call where none is."""
    met = F.col("met")
    return steps.groupBy(*keys).agg(
        F.max_by(F.when(met, F.col("node")), F.when(met, F.col("depth"))).alias("call"),
        F.coalesce(F.max(F.when(met, F.col("depth"))), F.lit(0)).alias("call_depth"),
        F.coalesce(F.max_by(F.when(met, F.col("p")), F.when(met, F.col("depth"))), F.lit(0.0)).alias("call_p"),
    )


def alerts(leaf_mass: DataFrame, rules: DataFrame, calls: DataFrame, keys: list[str], value: str = "p") -> DataFrame:
    """Leaves whose mass reaches their own alert level although they were not the call."""
    hits = leaf_mass.join(rules, "leaf").filter(F.col(value) >= F.col("p_min"))
    return hits.join(calls.select(*keys, F.col("call").alias("leaf")), [*keys, "leaf"], "left_anti")


def descend_arrays(
    predictions: DataFrame, children: dict[str, list[str]], classes: list[str], thresholds: dict[int, float],
    probs: str = "probs",
) -> DataFrame:
    """`descend` for a probability array per row, adding `steps` array<struct<depth,node,p,tau,met>>.

    The tree travels as plain expressions, so a cohort is descended in projections with no shuffle: the mass of every node is
    a sum of array elements, the heaviest child of every inner node is picked once a row, and a step looks its pick up.
    """
    at = {c: i for i, c in enumerate(classes)}

    def members(node: str) -> list[int]:
        kids = children.get(node, [])
        return [i for k in kids for i in members(k)] if kids else [at[node]] if node in at else []

    def height(node: str) -> int:
        return 1 + max(map(height, children[node])) if children.get(node) else 0

    def mass(p: Column, node: str) -> Column:
        total = F.lit(0.0)
        for i in members(node):
            total = total + F.get(p, F.lit(i)).cast("double")
        return total

    inner = [node for node, kids in children.items() if kids]
    if ROOT not in inner:
        return predictions.withColumn("steps", F.expr(_NO_STEPS))
    place = F.create_map(*[x for i, node in enumerate(inner) for x in (F.lit(node), F.lit(i))])

    def heaviest(p: Column) -> Column:
        """For every inner node the least (-mass, node): its heaviest child, the first by name among equals."""
        kids = [[F.struct((-mass(p, k)).alias("neg"), F.lit(k).alias("node")) for k in sorted(children[node])] for node in inner]
        return F.array(*[F.array_min(F.array(*k)) for k in kids])

    single = lambda x: x.cast("float").cast("double")

    def walk(picks: Column, depth: int, at_node: Column, met: Column, trail: list[Column]) -> Column:
        if depth > height(ROOT):
            return F.filter(F.array(*trail), lambda s: s.isNotNull())
        tau = F.lit(float(thresholds.get(depth, DEFAULT_THRESHOLD)))

        def on(pick: Column) -> Column:
            so_far = met & (single(-pick["neg"]) >= single(tau))
            step = F.struct(F.lit(depth).alias("depth"), pick["node"].alias("node"), (-pick["neg"]).alias("p"), tau.alias("tau"), so_far.alias("met"))
            return walk(picks, depth + 1, F.element_at(place, pick["node"]), so_far, [*trail, F.when(pick.isNotNull(), step)])

        return let(F.get(picks, at_node), on)

    steps = let(F.col(probs), lambda p: let(heaviest(p), lambda picks: walk(picks, 1, F.lit(inner.index(ROOT)), F.lit(True), [])))
    return predictions.withColumn("steps", steps)
