"""A training corpus from `documents`: classify, dedup by lines, near copies and repeats, pack.

Each stage takes (spark, docs, sf_dir), where docs is what its predecessor
returned, written as Parquet and read again.  All but the last return the
columns of `documents`; n_chars follows the text.  Nulls: a null text scores as
an empty one and is packed as one; a null doc_id is treated as an id of its own
for each text.  Without labels of both classes the first stage keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import bagminhash, line_dedup, pack, quality, repeats
from tremor.llm import kernel as K
from tremor.llm.queries import ship, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold go; equal ids are judged one by one by their texts."""
    ship(spark)
    model = quality.train(docs, K.read(spark, sf_dir, "labels"))
    return quality.keep(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, but for the first; a document that loses all its text stays, empty."""
    ship(spark)
    return _counted(line_dedup.dedup(docs.select(*COLUMNS)))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least id.

    Rows that share an id, or have none, are told apart by id and text; of rows
    equal in both one stays.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    shared = K.materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("shared")), "shared-ids")
    own = F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    named = docs.join(shared, "doc_id", "left") if shared.limit(1).count() else docs.withColumn("shared", F.lit(None).cast("boolean"))
    odd = F.coalesce("shared", F.lit(False)) | F.col("doc_id").isNull()
    keyed = named.withColumns({"_odd": odd, "_key": F.when(odd, own).otherwise(F.col("doc_id").cast("long"))}).drop("shared")
    lost = bagminhash.classes(keyed.select("_key", "text"), id_col="_key").where("_key <> class_id").select("_key").distinct()
    left = keyed.join(lost, "_key", "left_anti")
    return left.where("not _odd").select(*COLUMNS).unionByName(left.where("_odd").dropDuplicates(["_key"]).select(*COLUMNS))


def dedup_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that another document has too go, in all of them; the words around them stay."""
    ship(spark)
    out = repeats.remove_repeats(docs.select(*COLUMNS), unit="words", across=True)
    return _counted(out.select(*(F.col("kept").cast("string").alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in COLUMNS)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as the packing query returns them."""
    ship(spark)
    out = pack.pack(docs, vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_near),
    ("suffix-array dedup", dedup_repeats),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = K.read(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = K.materialise(stage(spark, docs, sf_dir), f"stage{k}")
        K.forget(*before)
        before = [docs]
    return docs
