"""Decision trees and forests grown level by level from distributed counts.

One aggregate a level counts (node, feature value, label) for all open nodes; a node's best
threshold comes from running sums over its distinct values.  A tree becomes one CASE
expression, so applying it costs a projection.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import arrays as A
from quern.operators.rows import key_range


@dataclass
class Tree:
    """A split (feature <= threshold goes left), or a leaf with a label."""

    feature: str | None = None
    threshold: float | None = None
    left: Tree | None = None
    right: Tree | None = None
    label: object = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.label)
        return F.when(F.col(self.feature) <= self.threshold, self.left.column()).otherwise(self.right.column())

    def nodes(self) -> list[Tree]:
        return [self] if self.feature is None else [self, *self.left.nodes(), *self.right.nodes()]


def split_scores(df: DataFrame, node: list[str], value: str, label: str) -> DataFrame:
    """node columns, threshold, score: the mean gini of both sides of every value, 1 where a
    side is empty."""
    whole = not node
    if whole:
        df, node = df.withColumn("_all", F.lit(0)), ["_all"]
    counts = df.groupBy(*node, F.col(value).alias("_v"), label).agg(F.count("*").alias("_c"))
    # for every value: counts of each label at or below it, summed up range by range
    ranged = counts.withColumn("_range", key_range(counts, "_v", counts.count(), 16))
    values = ranged.select(*node, "_range", "_v").distinct()
    labels = counts.groupBy(*node, label).agg(F.sum("_c").alias("t"))
    parts = ranged.groupBy(*node, label, "_range").agg(F.sum("_c").alias("_p"))
    grid = values.join(labels, node)
    full = grid.join(counts, [*node, "_v", label], "left").fillna(0, ["_c"])
    starts = values.select(*node, "_range").distinct().join(labels.drop("t"), node).join(parts, [*node, label, "_range"], "left").fillna(0, ["_p"])
    before = F.sum("_p").over(W.partitionBy(*node, label).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = starts.select(*node, label, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_c").over(W.partitionBy(*node, label, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    run = full.join(starts, [*node, label, "_range"]).withColumn("l", F.col("_before") + within)
    sides = run.groupBy(*node, "_v").agg(*(F.sum(x).alias(n) for n, x in (("nl", F.col("l")), ("nr", F.col("t") - F.col("l")), ("ql", F.col("l") * F.col("l")), ("qr", (F.col("t") - F.col("l")) * (F.col("t") - F.col("l"))))))
    gini = lambda q, n: 1.0 - F.col(q) / (F.col(n) * F.col(n))
    score = F.when((F.col("nl") == 0) | (F.col("nr") == 0), 1.0).otherwise((gini("ql", "nl") + gini("qr", "nr")) / 2.0)
    return sides.select(*([] if whole else node), F.col("_v").alias("threshold"), score.alias("score"))


def best_split(df: DataFrame, node: list[str], value: str, label: str) -> DataFrame:
    """node columns, threshold, score of the best value; the largest one among equals."""
    s = split_scores(df, node, value, label)
    best = F.min_by("threshold", F.struct(F.round("score", 12), -F.col("threshold"))).alias("threshold")
    return s.groupBy(*node).agg(best, F.min("score").alias("score"))


def grow(df: DataFrame, features: list[str], label: str, depth: int = 4, seed: int = 0, weight: Column | None = None, splitter: str = "best", min_rows: int = 2) -> Tree:
    """Each path uses a feature once, in an order drawn from the seed.  ``splitter``: "best",
    or "random" for a threshold between the column's extremes.  ``weight`` is how often a row
    counts, as a bootstrap sample has it."""
    rng = random.Random(seed)
    data = df.select(*features, label) if weight is None else df.select(*features, label, F.explode(F.array_repeat(F.lit(0), weight.cast("int"))).alias("_w")).drop("_w")
    extremes = data.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    order = rng.sample(features, len(features))
    root = Tree()
    paths: dict[int, Tree] = {0: root}
    node = F.lit(0)
    for level in range(depth + 1):
        rows = data.withColumn("_node", node).where("_node >= 0")
        votes = rows.groupBy("_node", label).agg(F.count("*").alias("_c")).collect()  # labels of open nodes
        by: dict[int, dict] = {}
        for r in votes:
            by.setdefault(r["_node"], {})[r[label]] = r["_c"]
        open_ = {}
        for k, t in paths.items():
            seen = by.get(k, {})
            t.label = mode(seen)
            if level < min(depth, len(order)) and len(seen) > 1 and sum(seen.values()) >= min_rows:
                open_[k] = t
        if not open_:
            break
        feature = order[level]
        if splitter == "best":
            rows = rows.where(F.col("_node").isin(list(open_)))
            cuts = {r["_node"]: r["threshold"] for r in best_split(rows, ["_node"], feature, label).where("score < 1").collect()}
        else:
            i = features.index(feature)
            cuts = {k: rng.uniform(extremes[f"lo{i}"], extremes[f"hi{i}"]) for k in sorted(open_)}
        paths = {}
        for k, t in open_.items():
            if k in cuts:
                t.feature, t.threshold, t.left, t.right = feature, float(cuts[k]), Tree(label=t.label), Tree(label=t.label)
                paths[2 * k + 1], paths[2 * k + 2] = t.left, t.right
        if not paths:
            break
        node = _below(node, {k: float(cuts[k]) for k in open_ if k in cuts}, feature)
    return root


def mode(counts: dict) -> object:
    """The commonest value, the smallest one in writing among equals; None without any."""
    return min(counts, key=lambda x: (-counts[x], str(x))) if counts else None


def _below(node: Column, cuts: dict[int, float], feature: str) -> Column:
    """The node one level down: -1 where the row's node is not split.  The former node is
    named once, so that the expression grows with the depth and no faster."""
    at = F.create_map(*(F.lit(x) for kv in sorted(cuts.items()) for x in kv))

    def down(k: Column) -> Column:
        return A.let(F.try_element_at(at, k), lambda t: F.when(t.isNull(), -1).otherwise(F.when(F.col(feature) <= t, 2 * k + 1).otherwise(2 * k + 2)))

    return A.let(node, down)


def bootstrap(id_col: str, seed: int) -> Column:
    """How often a row counts in a sample of the table's size: 0, 1 or 2 times, once on average,
    by arithmetic on an integer id, so that any engine draws alike."""
    return (F.col(id_col) * 7919 + seed * 104_729) % 1_000_003 % 3


def forest(df: DataFrame, features: list[str], label: str, trees: int = 10, id_col: str | None = None, subset: int | None = None, seed: int = 0, **options) -> list[Tree]:
    rng = random.Random(seed)
    out = []
    for _ in range(trees):
        some, own = rng.sample(features, subset or len(features)), rng.randrange(1000)
        out.append(grow(df, some, label, seed=own, weight=bootstrap(id_col, own) if id_col else F.pmod(F.xxhash64(*features, F.lit(own)), F.lit(3)), **options))
    return out


def vote(trees: list[Tree]) -> Column:
    """The commonest label; among equals the smallest."""
    votes = F.array_sort(F.array(*(t.column() for t in trees)))
    counted = F.transform(F.array_distinct(votes), lambda x: F.struct(F.size(F.filter(votes, lambda y: y == x)).alias("n"), x.alias("v")))
    best = F.aggregate(counted, F.element_at(counted, 1), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return best["v"]
