"""Mixing sources to target weights by entropy balancing.

Rates of documents are to stay as close to 1 as they can (in relative entropy) while each
source's expected words meet its target.  The answer is an exponential tilt,
``rate = min(cap, exp(lambda_source * size / mean size of the source))``, whose multipliers
maximise a concave dual.  The dual falls apart into one for each source, so Newton steps run
for all sources in parallel, each in a task that holds the source's counts of sizes.
Rates become whole copies: the integer part for every document, and one more for those
whose id hashes low enough against the rest, with one threshold a source set so that the
words taken meet the target to within about one document.

Whatever there is of a source (its size, target, multiplier, threshold) stays in tables; the
driver sees numbers of the whole mix only, so sources may be many.

Defined cases: a null text has size 0 and is taken 0 words; null is a source of its own,
last in order; rows that repeat an id share its hash and hence its copies; a source without
words gets nothing; columns of the input keep their names, whatever they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.scratch import drop, stage
from quern.llm.workers import release

#: No document is taken more often than this.
CAP = 3.0
NEWTON_STEPS, TOLERANCE = 60, 1e-9
#: Buckets of the two histograms that place a source's rounding threshold.
BUCKETS = 4096
#: Documents a source that fill what its threshold leaves of its target.
FILL = 4
#: Sources up to which a table of them is copied to all tasks (about 100 bytes each).
SMALL_PLAN = 10_000


def word_count(text: Column) -> Column:
    """Number of runs outside space and 0x09-0x0D; null counts 0.  Each word becomes one
    letter and white space goes, which needs no array of words."""
    letters = F.regexp_replace(text, "[^ \\t\\n\\x0B\\f\\r]+", "a")
    return F.coalesce(F.length(F.translate(letters, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def _numbered(per: DataFrame) -> DataFrame:
    """Adds k: the source's place in the order of code points, null last.  Ranges of sources are
    sorted by themselves and written; only their sizes are added up."""
    last = F.col("source").isNull()
    ranged = per.repartitionByRange(last, "source").sortWithinPartitions(last, "source")
    ranged = stage(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sources")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_first"))
    return ranged.join(starts, F.col("_part") == F.col("_of")).withColumn("k", F.col("_first") + F.col("_at")).drop("_part", "_at", "_of", "_first")


def shares(per: DataFrame, cap: float = CAP) -> DataFrame:
    """Adds target to (source, words): weights 1, 2, 3, 1, ... in order of code points (null
    last) share all words; no target passes ``cap`` times its source, and what is above
    is shared again by weight until none is.  That is least(cap * words, level * weight) for
    one level, which rises step by step."""
    weighed = _numbered(per).withColumn("weight", (1 + F.col("k") % 3).cast("double"))
    most = F.col("words").cast("double") * cap
    level = 0.0
    while True:
        over = F.lit(level) * F.col("weight") > most
        got = weighed.agg(F.sum("words").alias("all"), F.sum(F.when(over, most).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not got["all"] or not got["open"]:
            break
        new = (got["all"] - got["full"]) / got["open"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return weighed.withColumn("target", F.least(most, F.lit(level) * F.col("weight"))).drop("weight", "k")


def _tilt(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(F.lit(700.0), lam * size / mean)))


def solve(size: np.ndarray, n: np.ndarray, target: float, cap: float = CAP) -> float:
    """The multiplier of a source with ``n`` documents of each ``size``, by safeguarded Newton
    steps; infinite where every document is taken ``cap`` times, or none."""
    words = float((size * n).sum())
    if words <= 0 or not 0 < target < cap * words * (1 - 1e-12):
        return math.inf if target > 0 else -math.inf
    x, lam, low, high = size / (words / n.sum()), 0.0, -math.inf, math.inf
    for _ in range(NEWTON_STEPS):
        rate = np.minimum(cap, np.exp(np.minimum(700.0, lam * x)))
        gap = target - float((n * rate * size).sum())
        if abs(gap) <= TOLERANCE * target:
            break
        if gap > 0:
            low = lam
        else:
            high = lam
        slope = float((n * rate * size * x)[rate < cap].sum())
        step = lam + (gap / slope if slope > 0 else math.copysign(1.0, gap))
        step = min(max(step, lam - 4.0), lam + 4.0)
        if not low < step < high:
            step = (low + high) / 2 if math.isfinite(low + high) else lam + math.copysign(1.0, gap)
        lam = step
    return lam


def mix_to_targets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str | None, float] | None = None, cap: float = CAP) -> DataFrame:
    """One row per input row: id, size, source_size, target, rate, copies, taken.  ``targets``
    gives target words by source; by default all words shared as ``shares`` does."""
    docs = stage(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    out = _copies(docs, _plan(docs, targets, cap), cap)
    return out.select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP) -> DataFrame:
    """The input's rows with their columns, each as often as the mix takes it."""
    docs = df.select(F.struct(*(df[c] for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    plan = _plan(stage(docs.drop("row"), "sizes"), None, cap)
    taken = _copies(docs, plan, cap).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def _unit(id_: Column) -> Column:
    """A number in (0, 1) that depends on the id alone."""
    return (F.shiftrightunsigned(F.xxhash64(id_, F.lit("mix")), 11).cast("double") + 0.5) / float(1 << 53)


def _key(unit: Column) -> Column:
    return (unit * float(1 << 53)).cast("long")


def _order(rate: Column, unit: Column) -> Column:
    """Where in [0, 1) a document stands in its source's queue for one more copy; those with
    a larger fraction stand nearer the front.  1 for those without a fraction."""
    part = rate - F.floor(rate)
    return F.when(part <= 1e-12, F.lit(1.0)).otherwise(unit / (unit + part))


def _with(docs: DataFrame, table: DataFrame, columns: list[str], small: bool) -> DataFrame:
    """docs with the columns of their source's row in ``table``; ``small``: SMALL_PLAN rows at most."""
    some = table.select(F.col("source").alias("_source"), *columns)
    return docs.join(F.broadcast(some) if small else some, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _placed(docs: DataFrame, plan: DataFrame, columns: list[str], cap: float, small: bool) -> DataFrame:
    """Adds the source's facts, and the document's rate, hash and place in the queue."""
    lam, mean, size = F.col("lam"), F.col("mean"), F.col("size")
    rate = F.when(size == 0, 0.0).when(lam == math.inf, cap).when(lam == -math.inf, 0.0).otherwise(_tilt(lam, size.cast("double"), mean, cap))
    rows = _with(docs, plan, ["lam", "mean", *columns], small).withColumn("rate", rate).withColumn("unit", _unit(F.col("id")))
    return rows.withColumn("place", _order(F.col("rate"), F.col("unit")))


def _copies(docs: DataFrame, plan: DataFrame, cap: float) -> DataFrame:
    rows = _placed(docs, plan, ["words", "target", "cut", "more"], cap, plan.count() <= SMALL_PLAN)
    more = ((F.col("place") < F.col("cut")) | ((F.col("place") < 1.0) & F.array_contains("more", _key(F.col("unit"))))).cast("long")
    return rows.withColumn("copies", F.floor("rate").cast("long") + more)


def _plan(docs: DataFrame, targets: dict | None, cap: float) -> DataFrame:
    """A row a source: words, target, lam, mean, and what places its rounding: cut and more."""
    counted = stage(docs.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    per = stage(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs")), "words")
    if targets is None:
        per = shares(per, cap)
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "of string, t double")
        per = per.join(given, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("target", F.least(F.lit(cap) * F.col("words"), F.coalesce("t", F.lit(0.0)))).drop("of", "t")
    per = stage(per.withColumn("mean", F.coalesce(F.col("words") / F.col("docs"), F.lit(1.0))), "targets")

    small = per.count() <= SMALL_PLAN

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        some = pdf[pdf["size"] > 0]
        lam = solve(some["size"].to_numpy(float), some["n"].to_numpy(float), float(pdf["target"].iloc[0]), cap)
        release(cycles=False)
        return pdf[["source", "words", "target", "mean"]].iloc[:1].assign(lam=[lam])

    kind = docs.schema["source"].dataType.simpleString()
    facts = _with(counted, per, ["words", "target", "mean"], small).groupBy("source")
    solved = stage(facts.applyInPandas(one, f"source {kind}, words long, target double, mean double, lam double"), "solved")
    plan = stage(_cuts(docs, solved, cap, small), "plan")
    drop(counted, per, solved)
    return plan


def _cuts(docs: DataFrame, solved: DataFrame, cap: float, small: bool) -> DataFrame:
    """``solved`` with cut, the place in the queue up to which one more copy keeps the words
    taken within the target, found by two histograms of BUCKETS places each; and more, the
    keys of FILL documents behind it that each fill most of what is then left."""
    queue = _placed(docs.where("size > 0"), solved, ["target"], cap, small)
    base = queue.groupBy("source").agg(F.sum(F.floor("rate") * F.col("size")).alias("base"), F.first("target").alias("t"))
    state = stage(base.select("source", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.greatest(F.lit(0.0), F.col("t") - F.col("base")).alias("need")), "cuts")
    queue = queue.where("place < 1.0").select("source", "size", "place", _key(F.col("unit")).alias("key"))
    for _ in range(2):
        place = F.floor((F.col("place") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS)
        here = _with(queue, state, ["lo", "hi", "need"], small).where("place >= lo AND place < hi")
        bins = here.withColumn("b", F.least(F.lit(BUCKETS - 1), place)).groupBy("source", "b").agg(F.sum("size").alias("w"), F.first("need").alias("need"))
        upto = F.sum("w").over(W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, 0))
        hits = bins.withColumn("upto", upto).where("upto > need").groupBy("source").agg(F.min(F.struct("b", "upto", "w")).alias("x"))
        # without a bucket that passes the need, all of them are taken
        hit = state.join(hits.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        step, x = (F.col("hi") - F.col("lo")) / BUCKETS, F.col("x")
        next_ = hit.select("source", F.when(x.isNull(), F.col("hi")).otherwise(F.col("lo") + step * x["b"]).alias("lo"), F.when(x.isNull(), F.col("hi")).otherwise(F.col("lo") + step * (x["b"] + 1)).alias("hi"), F.when(x.isNull(), F.col("need")).otherwise(F.col("need") - (x["upto"] - x["w"])).alias("need"))
        last, state = state, stage(next_, "cuts")
        drop(last)
    none = F.array().cast("array<long>")
    state = stage(state.select("source", F.col("lo").alias("cut"), "need", none.alias("tried"), none.alias("more")), "cuts")
    for _ in range(FILL):
        behind = _with(queue, state, ["cut", "need", "tried"], small).where("need >= 1 AND place >= cut AND size <= need").where(~F.array_contains("tried", F.col("key")))
        best = behind.groupBy("source").agg(F.max(F.struct("size", "key")).alias("x")).select("source", F.col("x.key").alias("best"))
        # rows that repeat the document's id are taken with it
        whole = _with(queue, best, ["best"], small).where("key = best").groupBy("source", "key").agg(F.sum("size").alias("w"))
        got = state.join(whole.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        fits = F.col("w") <= F.col("need")
        tried = F.when(F.col("key").isNull(), F.col("tried")).otherwise(F.concat("tried", F.array("key")))
        next_ = got.select("source", "cut", F.when(fits, F.col("need") - F.col("w")).otherwise(F.col("need")).alias("need"), tried.alias("tried"), F.when(fits, F.concat("more", F.array("key"))).otherwise(F.col("more")).alias("more"))
        last, state = state, stage(next_, "cuts")
        drop(last)
    facts = state.select(F.col("source").alias("of"), "cut", "more")
    out = solved.join(facts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("cut", F.coalesce("cut", F.lit(0.0))).withColumn("more", F.coalesce("more", none))
