"""Word frequencies as a source: tables made from a corpus, or read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.guards import letter_words
from quirelake.functions.text import casefold


def build_lexicon(texts: DataFrame, text_col: str = "text", least: int = 1) -> DataFrame:
    """``word, n``: folded words of the texts that occur ``least`` times or more. Counts are combined before the shuffle, so a word that every text has is one row a task."""
    words = texts.select(F.explode(letter_words(F.col(text_col))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def save_lexicon(lexicon: DataFrame, path: str) -> None:
    """Writes a lexicon in the order of its words, so that each file has a range of them and a lookup of few words skips the others."""
    lexicon.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, n`` from a saved lexicon, or from text files of a word and, after a tab, its count (1 if there is none) a line; words are folded, lines that start with # passed over."""
    if not path.endswith((".txt", ".tsv")):
        return spark.read.parquet(path).select("word", "n")
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    rows = lines.select(casefold(F.trim(parts[0])).alias("word"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("long"), F.lit(1)).alias("n"))
    return rows.groupBy("word").agg(F.sum("n").alias("n"))
