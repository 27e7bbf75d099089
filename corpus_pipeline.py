"""A corpus pipeline: documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet in the shared folder and gives the next stage what it reads back.  All stages but
the last return the columns of documents, and pass over other columns.

Defined cases: a text that is null or has no letter is rejected by the first stage, as is one
whose language is not sure; a null language teaches nothing and rejects nothing; rows with a
null id are kept wherever their text is not a copy of another row's; of rows with equal texts
one stays, whatever their ids; texts of one id are one document for the near duplicates; a null
source is a source of its own; an empty table gives an empty result.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid
from quern.llm.exact_dedup import exact_dedup, normalised
from quern.llm.mixing import mixed_documents
from quern.llm.near_dedup import near_dedup
from quern.llm.packing import pack_documents
from quern.llm.scratch import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language the model is less sure of than this is rejected, as is one without letters.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(langid.remainder("doc_id", 5) != 0))
    found = langid.identify(docs, model, keep=tuple(COLUMNS))
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return sure.select(*(F.col(f"_keep_{c}").alias(c) for c in COLUMNS))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: of the rows with the group's smallest id, the
    first by language, source, n_chars and text, nulls first.  A null id is larger than any
    other, so a group without ids keeps one row too."""
    told = exact_dedup(docs).where("kept").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    told = stage(told, "kept-texts")
    rows = docs.select(*COLUMNS, F.sha2(F.encode(normalised("text"), "UTF-8"), 256).alias("text_sha256"))

    def of(some: DataFrame) -> DataFrame:
        # the id is part of the key, so that rows of a hot text are dealt apart
        some = some.select(F.col("text_sha256").alias("sha"), "keep_id")
        return rows.join(some, (F.col("text_sha256") == F.col("sha")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")

    several = told.where("n > 1")
    if several.isEmpty():
        return of(told).select(*COLUMNS)
    row = F.struct("doc_id", "lang", "source", "n_chars", "text")
    one = of(several).groupBy("text_sha256").agg(F.min(row).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in COLUMNS))
    return of(told.where("n = 1")).select(*COLUMNS).unionByName(one)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the operator keeps.  Texts of one id are one document, kept or dropped
    together; rows with a null id, and texts without a word, stay."""
    dropped = near_dedup(docs).where("NOT kept AND n_shingles > 0").select(F.col("doc_id").alias("gone")).distinct()
    worded = F.coalesce(F.col("text"), F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    return docs.join(dropped, (F.col("doc_id") == F.col("gone")) & worded, "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
