"""Corpus pipeline: language ID, near-dedup, secret removal, source mixing, tokenisation.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import discard, scratch_path
from quirelake.llm import langid, mixing, near, pieces, secrets
from quirelake.llm.common import durable, fresh, sent, table
from quirelake.llm.queries import default_vocabulary

#: Documents whose language has a lower calibrated probability are rejected.
LEAST_SCORE = 0.4
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows of ``docs`` that have a language; rejects texts without a letter or a likely language.

    A null or empty text has no letter. Repeated rows go or stay together. Without any row
    that has a language all go. An empty table gives an empty one, and other columns stay
    as they are, whatever their names.
    """
    model = langid.train(docs)
    found = model.column(F.col("text"))
    return docs.where((found["lang"] != langid.UND) & (found["score"] >= LEAST_SCORE))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    Rows are told apart by doc_id and text, so a doc_id on several texts is several
    documents; a null doc_id comes after all others. Of rows that repeat both, the first by
    their other columns stays. Null and wordless texts are one group. An empty table gives
    an empty one, and other columns stay as they are, whatever their names.
    """
    groups = near.similar_groups(docs.select("doc_id", "text"))
    rows = durable(groups.groupBy("part", "id", "text_key").agg(F.count("*").alias("n")))
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key", "n")).alias("first")).select("first.*")
    others = rows.join(firsts.select(F.col("id").alias("first_id"), F.col("text_key").alias("first_key")), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key")), "left_anti")
    repeated = durable(firsts.where("n > 1").select(F.col("id").alias("named"), "text_key"))
    gone = durable(others.select(F.col("id").alias("named"), "text_key").unionByName(repeated))
    key, whole = fresh(docs.columns, "near_key", "near_whole")
    keyed = docs.withColumn(key, near.text_key(F.col("text")))
    same = lambda keys: keyed["doc_id"].eqNullSafe(keys["named"]) & (keyed[key] == keys["text_key"])
    left = keyed.join(out := sent(gone), same(out), "left_anti").select(docs.columns)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = keyed.join(out := sent(repeated), same(out), "left_semi").groupBy("doc_id", key).agg(F.min_by(row, F.to_json(row)).alias(whole))
    return left.unionByName(several.select(f"{whole}.*"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by a mark of its kind; ``n_chars`` becomes the new length.

    A null text stays null with its ``n_chars``; no row goes. An empty table gives an empty
    one, and other columns stay as they are, whatever their names.
    """
    text = secrets.redacted(F.col("text"))
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out rows as the mix takes them: twice, once or never.

    Rows without words belong to no budget: they go or stay with the hash of their doc_id.
    Rows that repeat a doc_id are taken together. A null source is a source. An empty
    table gives an empty one, and other columns stay as they are, whatever their names.
    """
    plan, copy = fresh(docs.columns, "mix_plan", "mix_copy")
    mixed = mixing.with_copies(docs, mixing.mixture(docs), plan).where(F.col(plan)["copies"] > 0)
    return mixed.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(plan)["copies"]))).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row; null and empty texts have the end id alone.

    Repeated rows stay, an empty table gives an empty result, other columns go.
    """
    coded = pieces.encode_documents(docs, default_vocabulary())
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("remove_secrets", remove_secrets), ("mix_sources", mix_sources), ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared checkpoint folder and read again, and deleted once the next one is written."""
    root, before = scratch_path(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := f"{root}/{name}")
        docs = spark.read.parquet(path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs
