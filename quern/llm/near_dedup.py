"""Near-duplicate detection: circulant MinHash, banding, exact Jaccard, components.

A document's set is its distinct word shingles.  Two permutations of 32-bit numbers give
all signature coordinates: the first scatters the shingles, the second is shifted around
its circle by k for coordinate k.  Documents that agree on all coordinates of a band are
candidates.  Every link is confirmed on the full sets, 100 * intersection >= threshold *
union, and components of confirmed links give each document its class.  Words are known by
64-bit hashes (see ``hashing``).

Nothing emits all pairs of a group.  Documents with equal sets are one node, and a node's
shingles that no other candidate has bound what it can be linked to: nodes with too many of
them drop out.  Of the nodes in a band, the one with the smallest share of such shingles is
the head.  Round one compares each node with its best head, round two with its other heads,
where they are not joined yet; round three compares what shares a band and still lies in
different components, as far as the bound allows.  So a large group of near copies costs
about one comparison a member, and no candidate that could join two components is left out.

Defined cases: null and empty texts, and texts without a word, have the empty set and no
links; with fewer words than a shingle has, the whole sequence is the one shingle; a null id
is a document of its own whose component is null; rows that repeat an id are one document
for linking; other columns are ignored; an empty table gives an empty result.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import hashing as H
from quern.llm.scratch import drop, release_shuffles, stage
from quern.llm.workers import lean

WORDS, THRESHOLD = 5, 80
#: A pair at Jaccard 0.8 shares no band with probability (1 - 0.8**5)**32 = 3e-6.
BANDS, ROWS = 32, 5
#: Coordinates beyond those of the bands, which make the signatures' estimates sharper.
EXTRA = 320
#: Standard deviations below the threshold from which an estimate rules a pair out (5e-6).
SIGMAS = 4.43
_SEED = np.uint32(0x5BD1E995)


def least_agreement(threshold: int, coordinates: int) -> float:
    """Share of equal coordinates that a pair at the threshold falls below with probability 5e-6."""
    j = threshold / 100.0
    return j - SIGMAS * math.sqrt(j * (1 - j) / coordinates)


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x85EBCA6B)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(shingles: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of the non-empty sets ``shingles[first[i]:first[i + 1]]``."""
    out = np.empty((len(first) - 1, coordinates), np.uint32)
    step = 1 << 16
    at = 0
    while at < len(first) - 1:
        end = max(at + 1, int(np.searchsorted(first, first[at] + step, "right")) - 1)
        x = _permute((shingles[first[at] : first[end]] >> H.U64(32)).astype(np.uint32) ^ _SEED)
        edges = first[at:end] - first[at]
        for k in range(coordinates):
            out[at:end, k] = np.minimum.reduceat(_permute(x + np.uint32(k)), edges)
        at = end
    return out


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, first, _ = H.word_hashes(texts, lower=True)
    keys, doc = H.windows(h, first, words)
    edges = np.searchsorted(doc, np.arange(len(first)))
    out = []
    for i in range(len(first) - 1):
        n = first[i + 1] - first[i]
        if n == 0:
            out.append(np.zeros(0, H.U64))
        elif n < words:
            key = np.array([n], H.U64)
            for w in h[first[i] : first[i + 1]]:
                key = H.mix(key * H.U64(0xD1342543DE82EF95) + w)
            out.append(key)
        else:
            out.append(np.unique(keys[edges[i] : edges[i + 1]]))
    return out


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(df: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, n, set_key, bands (hashes) and sig (a byte a coordinate) of every row."""
    source = df.select(F.col(id_col).alias("id"), df[text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                sets = shingle_sets(part.column(1), words)
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                keys: list = [None] * len(sets)
                hashes: list = [None] * len(sets)
                sigs: list = [None] * len(sets)
                if len(full):
                    sig = signatures(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])]), bands * rows + EXTRA)
                    low = (sig & np.uint32(255)).astype(np.uint8)
                    wide = sig[:, : bands * rows].reshape(len(full), bands, rows).astype(H.U64)
                    key = np.broadcast_to(np.arange(1, bands + 1, dtype=H.U64), (len(full), bands)).copy()
                    for r in range(rows):
                        key = H.mix(key * H.U64(0xD1342543DE82EF95) + wide[:, :, r])
                    for j, i in enumerate(full):
                        keys[i], hashes[i], sigs[i] = _set_key(sets[i]), H.signed(key[j]), low[j].view(np.int8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int8()))], ["id", "n", "set_key", "bands", "sig"])

    return source.mapInArrow(lean(run), "id long, n long, set_key binary, bands array<long>, sig array<tinyint>")


def _sets_of(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """node, n, sig and the sorted set of each node, made anew from the texts."""
    found = df.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")).join(nodes, "node").select("node", "text", "set_key", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                sets = shingle_sets(part.column(1), words)
                same = [_set_key(s) == w for s, w in zip(sets, part.column(2).to_pylist())]
                kept = part.filter(pa.array(same, pa.bool_()))
                blobs = pa.array([s.tobytes() for s, ok in zip(sets, same) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(3), kept.column(4), blobs], ["node", "n", "sig", "set"])

    return found.mapInArrow(lean(run), "node long, n long, sig array<tinyint>, set binary").dropDuplicates(["node", "sig", "n"])


def _agreement(a: Column, b: Column) -> Column:
    """Share of equal coordinates of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda t, x: t + x) / F.size(a)


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        out[i] = len(np.intersect1d(np.frombuffer(x, H.U64), np.frombuffer(y, H.U64), assume_unique=True))
    return pd.Series(out)


def _facts(sets: DataFrame) -> DataFrame:
    """node, n (shingles), a: those of them that another of the nodes has too.  A node of
    several sets has the smallest n and the largest set as a, so that it bounds each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                found = [np.frombuffer(x, H.U64) for x in part.column(1).to_pylist()]
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
                h = np.concatenate([np.zeros(0, H.U64), *found])
                yield pa.RecordBatch.from_arrays([pa.array(H.signed(h)), pa.array(node, pa.int64())], ["h", "node"])

    each = sets.select("node", "set").mapInArrow(lean(run), "h long, node long")
    own = each.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("top")).where("node = top").groupBy("node").agg(F.count("*").alias("own"))
    sizes = sets.groupBy("node").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("texts"))
    own_ = F.when(F.col("texts") == 1, F.coalesce("own", F.lit(0))).otherwise(0)
    return sizes.join(own, "node", "left").select("node", "n", (F.col("most") - own_).alias("a"))


def _possible(n: str, a: str, m: str, b: str, threshold: int) -> str:
    """SQL: whether sets of n and m shingles, a and b of them not their own, can be linked.
    The intersection has min(a, b) at most, and the union the rest at least."""
    return f"100 * least({a}, {b}) >= {threshold} * ({n} + {m} - least({a}, {b}))"


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose full sets meet the threshold; pairs whose signatures
    agree on less than ``least`` are ruled out before their sets are moved."""
    meta = sets.select("node", "n", "sig")
    left, right = meta.toDF("a", "na", "sa"), meta.toDF("b", "nb", "sb")
    p = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))
    # pairs that several texts of a node repeat stay: a distinct here would keep Spark from splitting
    # the tasks of a node with many pairs
    p = stage(p.where(_agreement(F.col("sa"), F.col("sb")) >= least).select("a", "b", "na", "nb"), "likely")
    blob = sets.select("node", "n", "set")
    both = p.join(blob.toDF("a", "na", "xa"), ["a", "na"]).join(blob.toDF("b", "nb", "xb"), ["b", "nb"])
    common = both.select("a", "b", "na", "nb", _common("xa", "xb").alias("c"))
    return common.where(100 * F.col("c") >= threshold * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame | None:
    """(node, root): the smallest node each node can reach, for the nodes of (a, b) edges;
    None where there is no edge.  Each step hooks every node to the neighbour, or itself,
    with the smallest hash and contracts; hashes rather than ids keep chains from being slow."""
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if live.isEmpty():
        return None
    total = None
    while True:
        ends = live.select("a", "b").union(live.select("b", "a"))
        best = F.min_by("b", F.struct(F.xxhash64("b"), "b"))
        near = ends.groupBy("a").agg(best.alias("m"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        hook = stage(near.select(F.col("a").alias("node"), F.least(rank("a"), rank("m"))["v"].alias("to")), "hooks")
        next_ = stage(live.join(hook.toDF("a", "ta"), "a").join(hook.toDF("b", "tb"), "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        moved = hook if total is None else total.join(hook.toDF("to", "far"), "to", "left").select("node", F.coalesce("far", "to").alias("to"))
        moved = stage(moved, "roots")
        drop(live, hook, *([total] if total is not None else []))
        live, total = next_, moved
        if live.isEmpty():
            break
    least = total.groupBy("to").agg(F.min("node").alias("root"))
    return total.join(least, "to").select("node", "root")


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after the links (a, b) between nodes are added."""
    if labels is None:
        got = components(links)
        return None if got is None else stage(got, "labels")
    ends = links.join(labels.toDF("a", "ra"), "a", "left").join(labels.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    got = components(ends)
    if got is None:
        return labels
    got = stage(got, "joined")
    old = labels.join(got.toDF("root", "far"), "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    new = got.join(labels.select("node"), "node", "left_anti")
    return stage(old.unionByName(new), "labels")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    if labels is None:
        return pairs
    p = pairs.join(labels.toDF("a", "ra"), "a", "left").join(labels.toDF("b", "rb"), "b", "left")
    return p.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept."""
    spark, least = df.sparkSession, least_agreement(threshold, bands * rows + EXTRA)
    docs = stage(sketches(df, id_col, text_col, words, bands, rows), "sketches")
    nodes = stage(docs.where("n > 0 AND id IS NOT NULL").groupBy("set_key").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    release_shuffles(spark)
    # rows that repeat an id are one document, so their sets' nodes belong together
    held = docs.where("n > 0 AND id IS NOT NULL").select("id", "set_key").join(nodes.select("set_key", "node"), "set_key").select("id", "node")
    several = held.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("id", "b")
    again = stage(held.join(several, "id").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "again")
    cells = nodes.select("node", F.posexplode("bands").alias("band", "bucket")).dropDuplicates(["node", "bucket"])
    held = stage(cells.groupBy("bucket").count().where("count > 1").select("bucket"), "buckets")
    shared = cells.join(held, "bucket")
    taking = shared.select("node").distinct()
    sets = stage(_sets_of(df, nodes.join(taking, "node").select("node", "set_key", "n", "sig"), id_col, text_col, words), "sets")
    release_shuffles(spark)
    facts = stage(_facts(sets).where(f"100 * a >= {threshold} * n"), "facts")
    shared = stage(shared.join(facts, "node"), "cells")
    release_shuffles(spark)

    # the node with the fewest shingles of its own is most likely to be near the others
    central = F.struct(F.col("a") / F.col("n"), -F.col("node"))
    heads = shared.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "a"), central).alias("h"), F.count("*").alias("size")).where("size > 1")
    heads = stage(heads.select("bucket", F.col("h.node").alias("head"), F.col("h.n").alias("hn"), F.col("h.a").alias("ha")), "heads")
    star = shared.join(heads, "bucket").where(f"node <> head AND {_possible('n', 'a', 'hn', 'ha', threshold)}")
    star = stage(star.groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.first(F.col("ha") / F.col("hn")).alias("q")), "star")
    first = star.groupBy("a").agg(F.max_by("b", F.struct("q", -F.col("b"))).alias("b"))
    labels = _relabel(None, stage(confirm(first, sets, threshold, least), "links"))
    release_shuffles(spark)
    labels = _relabel(labels, stage(confirm(_apart(star.select("a", "b").join(first, ["a", "b"], "left_anti"), labels), sets, threshold, least), "links"))
    release_shuffles(spark)
    # what shares a band and is still apart: in each band, the members outside its largest
    # component against all others, as far as the bound lets them link
    cell = shared
    if labels is not None:
        cell = cell.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        cell = cell.withColumn("root", F.col("node"))
    cell = stage(cell.select("bucket", "band", "node", "n", "a", "root"), "labelled")
    parts = cell.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    marks = nodes.groupBy("node").agg(F.count("*").alias("texts"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    mixed = stage(cell.join(parts.select("bucket", "top"), "bucket").join(marks, "node"), "mixed")
    other = mixed.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("node", "n", "a", "root", "texts", "bands", "sig")))
    # a pair counts in the first band that it shares, and where its signatures agree enough
    here = F.array_position(F.zip_with("bands", "bands_b", lambda x, y: x == y), True) == F.col("band") + 1
    alike = _agreement(F.col("sig"), F.col("sig_b")) >= least
    rest = mixed.where("root <> top").join(other, "bucket").where(f"root <> root_b AND (root_b = top OR node < node_b) AND {_possible('n', 'a', 'n_b', 'a_b', threshold)}")
    rest = rest.where((F.col("texts") + F.col("texts_b") > 2) | (here & alike))
    known = star.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = rest.select(F.greatest("node", "node_b").alias("a"), F.least("node", "node_b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    labels = _relabel(labels, stage(confirm(rest, sets, threshold, least), "links"))
    release_shuffles(spark)
    if not again.isEmpty():
        labels = _relabel(labels, again)
    drop(sets, mixed, shared, cell, star, heads, facts)

    out = docs.join(nodes.select("set_key", "node"), "set_key", "left")
    if labels is not None:
        out = out.join(labels, "node", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "node", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
