"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own content says so (see CUT; text of scripts that have no
such place is cut at MAX_CHARS), so equal passages give equal chunks wherever they stand.  Every distinct chunk is compared by content once and gets a
verified identifier; a document is then the ordered list of its chunks' identifiers (its
recipe), and documents are compared by these short lists.  A text is shuffled at most once,
as chunks that a map-side aggregate has already thinned; recipes carry everything after that.

Defined cases: a null text counts as empty; empty texts are equal to each other (the
empty recipe); rows that repeat an id count as rows of their group and share its decision;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.scratch import stage

#: A chunk has MIN_CHARS characters or more, ends after the next place where the content
#: allows a cut, and has MAX_CHARS at most.
MIN_CHARS, MAX_CHARS = 512, 4096
#: A cut follows a space or mark (or one of the commonest signs, where words are not spaced) and
#: two characters of a part of their alphabet.  Such places are some hundred characters apart, so
#: that two texts that share a passage soon cut it alike.  Few ranges keep the search cheap.
CUT = "[,. ،一-亿][aeiostAEIOST0-3а-дα-δا-ت一-嘀][bcdijkBCDIJK5-7б-вβ-γب-ث一-俿]"
#: Characters of a cut.
CUT_CHARS = 3


def normalised(text: Column | str) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")


def chunks(text: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    """The content-defined chunks of a text, in order; together they are the text."""
    pattern = f"(?s)(.{{{low},{high - CUT_CHARS}}}?{CUT}|.{{1,{high}}})"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def fingerprint(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk, F.length(chunk))
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def colliding_chunks(texts: DataFrame, bits: int = 64) -> DataFrame:
    """(fp, chunk, variant): the chunks whose fingerprint another content has too, numbered
    from 0 within a fingerprint.  Every distinct chunk content takes part; a chunk that
    many documents share is thinned before the shuffle."""
    each = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    distinct = each.select(fingerprint(F.col("chunk"), bits).alias("fp"), F.encode("chunk", "UTF-8").alias("chunk")).distinct()
    sides = distinct.groupBy("fp").agg(F.collect_set("chunk").alias("contents")).where(F.size("contents") > 1)
    return sides.select("fp", F.posexplode(F.array_sort("contents")).alias("variant", "chunk")).select("fp", F.col("chunk").cast("string").alias("chunk"), "variant")


def recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(id, recipe, text_sha256) of every row, with verified chunk identifiers."""
    texts = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    clash = stage(colliding_chunks(texts, bits), "chunk-clashes")
    plain = texts.select("id", F.transform(chunks(F.col("norm")), lambda c: F.struct(fingerprint(c, bits).alias("fp"), F.lit(0).alias("variant"))).alias("recipe"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"))
    if clash.isEmpty():
        return plain
    keyed = stage(texts.withColumn("row", F.monotonically_increasing_id()), "chunk-texts")
    each = keyed.select("id", "row", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), F.posexplode_outer(chunks(F.col("norm"))).alias("at", "chunk"))
    each = each.withColumn("fp", fingerprint(F.col("chunk"), bits))
    named = each.join(clash, ["fp", "chunk"], "left")
    part = F.when(F.col("at").isNotNull(), F.struct("at", "fp", F.coalesce("variant", F.lit(0)).alias("variant")))
    return named.groupBy("row", "id", "text_sha256").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "id", F.transform("parts", lambda p: F.struct(p["fp"].alias("fp"), p["variant"].alias("variant"))).alias("recipe"), "text_sha256"
    )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row per input row: id, keep_id (smallest id of its equal texts), group_size,
    kept, text_sha256.  ``bits`` shortens the fingerprints, to test the handling of clashes."""
    rows = stage(recipes(df, id_col, text_col, bits), "recipes")
    groups = rows.groupBy("recipe").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    # written first, so that the join deals both sides anew and Spark can split a hot group's rows
    groups = stage(groups.where("group_size > 1"), "groups")
    out = rows.join(groups, "recipe", "left")
    alone = F.col("group_size").isNull()
    keep, size = F.when(alone, F.col("id")).otherwise(F.col("keep_id")), F.coalesce("group_size", F.lit(1).cast("long"))
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")
