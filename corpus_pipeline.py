"""A training corpus from raw documents: toxic ones go, one of each near-duplicate class stays, repeated passages and contaminated documents go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkrank.llm import bpe, decontaminate, neardup, substrings, toxicity
from walkrank.llm.queries import table, tokenizer_path
from walkrank.llm.scratch import Folders, Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: No SQL expresses the first and the last stage.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled rows among these, scores below 0.5.

    Null and empty texts have the score of no terms; repeated rows stay or go
    together; without labels of both kinds all stay; columns beyond those of
    documents are not kept.
    """
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.select(*COLUMNS), machine, score="__toxicity").where("__toxicity < 0.5").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with __key, one of each group of equal id and text, or of equal texts without an id; __key is null without id and words.

    __key is the id where no id has several texts, else a hash of both, so
    that each row is a document of its own. Groups collapse by partial
    aggregates, so a row that is repeated often is no hot spot.
    """
    scratch = Scratch(spark, "one-of-each")
    docs = docs.select(*COLUMNS)
    digest = F.xxhash64(F.col("text").isNull(), "text")
    several = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi")
    row = F.xxhash64(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text").isNull(), "text")
    own = F.col("doc_id") if several.isEmpty() else row
    keyed = docs.withColumn("__key", F.when(F.col("doc_id").isNotNull(), own).when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), row))
    again, seen = scratch.measured(keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.count("*").alias("c")).where("c > 1").select("__key"), "again", n=F.count("*"))
    if not seen["n"]:
        return keyed
    some = keyed.where("__key IS NOT NULL")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    twice = some.join(again, "__key", "left_semi").groupBy("__key", "doc_id", "text").agg(F.min(F.struct(*rest)).alias("__rest"))
    once = some.join(again, "__key", "left_anti").unionByName(keyed.where("__key IS NULL"))
    return scratch.save(once.unionByName(twice.select("__key", "doc_id", "text", "__rest.*")), "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row: that of the smallest id, or one without an id if none has any.

    Rows are compared by their texts, so rows that share an id or have none
    are documents of their own, and repeated rows are one. Rows without words
    are near duplicates of nothing: of those only repeats of an id go.
    """
    rows = one_of_each(spark, docs)
    classes = neardup.link_classes(rows, doc_id="__key", words=5, percent=80).select(F.col("doc_id").alias("__key"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("first")
    stay = rows.where("__key IS NOT NULL").select("__key", "doc_id").join(classes, "__key").groupBy("component_id").agg(first).select(F.col("first.__key").alias("__key"))
    return rows.join(stay, "__key", "left_semi").unionByName(rows.where("__key IS NULL")).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages of 35 words that occur more than once. Texts without such words stay as they are."""
    out = substrings.remove_repeats(docs.select(*COLUMNS), window=35)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in 20 is in an occurrence of a benchmark window of 13 words."""
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), window=13)
    return decontaminate.digests(found).where(~F.col("contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for each row: null texts count as empty, repeated rows and null ids stay."""
    return bpe.bpe_round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("byte-pair encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each but the last keeps is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with Folders(spark):  # what the stage itself writes goes with it
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.drop(f"stage-{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
