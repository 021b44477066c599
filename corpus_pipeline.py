"""The corpus pipeline: four stages over ``documents``, each writing what the next one reads.

All stages take any extra columns along (the last returns pieces only), give no rows for an empty table, and keep a
null text as an empty one and a row without an id. Ties (equal scores or texts) fall alike. Repeated rows of one id
stay until near-dedup, which keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabspark.llm import minhash, packing, quality, toxicity
from tabspark.llm.common import read, shared_dir, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones among them, does not reject; all if the labels
    do not tell toxic from clean ones."""
    model = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model) if model.trees else docs


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules, learned from the labelled ones among them, accept; all if there is nothing to
    learn from, as rules that score all texts alike tell none apart."""
    rules = quality.learn(docs, read(spark, sf_dir, "labels"))
    return quality.good_only(docs, rules) if rules.rules else docs


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near duplicates (similarity 0.8 or more). Rows without
    an id all stay; of repeated rows of one id one with the greatest text stays, which is the text that was judged."""
    kept = minhash.classes(docs, 80).filter("kept and doc_id is not null").select("doc_id")
    named = docs.filter("doc_id is not null")
    if not named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc_nulls_last("text"), F.xxhash64(*docs.columns)))
        named = named.withColumn("_place", place).filter("_place = 1")
    return named.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents left, with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_dedup", drop_near_copies), ("pack", pack)]
ORACLE_SQL = None  # the models can't be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = read(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
