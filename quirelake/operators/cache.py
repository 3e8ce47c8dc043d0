"""Reuse of earlier results: a checkpoint table keyed by source hash and page, versioned by a repair signature."""

from __future__ import annotations

import json
from collections.abc import Mapping
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.repair import repair

#: Fixed value: version of the repair rules that signatures start with.
RULES_VERSION = "4"


def source_hash(content: Column) -> Column:
    """SHA-256 of a source's bytes."""
    return F.sha2(content.cast("binary"), 256)


def repair_signature(settings: Mapping[str, object]) -> str:
    """SHA-256 of the rules' version, a bar and the model settings as compact JSON in their own order; any change of a setting changes it."""
    return sha256(f"{RULES_VERSION}|{json.dumps(dict(settings), separators=(',', ':'), ensure_ascii=False, default=str)}".encode()).hexdigest()


def signature_of(settings: Column) -> Column:
    """:func:`repair_signature` of a struct of settings in each row; null settings stand as JSON's null."""
    return F.sha2(F.concat(F.lit(f"{RULES_VERSION}|"), F.to_json(settings, {"ignoreNullFields": "false"})), 256)


def repaired_blocks(blocks: Column) -> Column:
    """Array of block structs with repaired text; tables and verse keep their lines."""
    return F.transform(blocks, lambda b: b.withField("text", repair(b["text"], F.coalesce(b["role"].isin("table", "poetry"), F.lit(False)))))


def as_block(text: Column) -> Column:
    """One paragraph block of a page's text."""
    return F.array(F.struct(text.alias("text"), F.lit("paragraph").alias("role"), F.lit(False).alias("bold"), F.lit(False).alias("italic")))


def with_defaults(blocks: Column) -> Column:
    """Stored blocks with missing parts filled in: empty text, paragraph, not bold, not italic."""
    return F.transform(blocks, lambda b: F.struct(F.coalesce(b["text"], F.lit("")).alias("text"), F.coalesce(b["role"], F.lit("paragraph")).alias("role"), F.coalesce(b["bold"], F.lit(False)).alias("bold"), F.coalesce(b["italic"], F.lit(False)).alias("italic")))


def complete_rows(checkpoint: DataFrame) -> DataFrame:
    """Complete pages of a checkpoint, the missing parts of their blocks filled in."""
    return checkpoint.where("complete").select("source_hash", "page_number", "raw_text", "repaired_text", "layout", with_defaults(F.col("blocks")).alias("blocks"), with_defaults(F.col("raw_blocks")).alias("raw_blocks"), "repair_signature")


def full_blocks(rows: DataFrame, blocks: str, text: str) -> DataFrame:
    """``rows`` whose column ``blocks``, where it is null or empty, has the page's text as one paragraph."""
    return rows.withColumn(blocks, F.when(F.coalesce(F.size(blocks) > 0, F.lit(False)), F.col(blocks)).otherwise(as_block(F.coalesce(text, F.lit("")))))


def with_action(pages: DataFrame, stored: DataFrame | None, signature: str) -> DataFrame:
    """``pages`` (source_hash, page_number) with ``action``: reused (stored with this signature), repaired (stored with another one) or missing."""
    if stored is None:
        return pages.select("source_hash", "page_number", F.lit("missing").alias("action"))
    joined = pages.select("source_hash", "page_number").join(stored.select("source_hash", "page_number", F.coalesce("repair_signature", F.lit("")).alias("was")), ["source_hash", "page_number"], "left")
    return joined.select("source_hash", "page_number", F.when(F.col("was").isNull(), "missing").when(F.col("was") == signature, "reused").otherwise("repaired").alias("action"))


def reuse(pages: DataFrame, checkpoint: DataFrame, signature: str) -> DataFrame:
    """``pages`` (source_hash, page_number) with ``action`` and ``blocks``.

    Same signature: stored blocks, or the stored text as one paragraph if there are none
    (``reused``). Other signature: the raw blocks, or the raw text, repaired again
    (``repaired``). No complete row: ``missing``, with null blocks. Repair is computed for
    stale rows only.
    """
    stored = complete_rows(checkpoint)
    acted = pages.select("source_hash", "page_number").join(stored.withColumn("was", F.coalesce("repair_signature", F.lit(""))), ["source_hash", "page_number"], "left")
    same = F.col("was") == signature
    out = ["source_hash", "page_number"]
    fresh = full_blocks(acted.where(same), "blocks", "repaired_text").select(*out, F.lit("reused").alias("action"), "blocks")
    stale = full_blocks(acted.where(~same), "raw_blocks", "raw_text").select(*out, F.lit("repaired").alias("action"), repaired_blocks(F.col("raw_blocks")).alias("blocks"))
    missing = acted.where("was IS NULL").select(*out, F.lit("missing").alias("action"), F.lit(None).cast(fresh.schema["blocks"].dataType).alias("blocks"))
    return fresh.unionByName(stale).unionByName(missing)


def page_rows(blocks: DataFrame, signature: str) -> DataFrame:
    """Checkpoint rows of repaired blocks (source_hash, page_number, block_no, raw_text, text, role, bold, italic, layout, error); a page with an error is not complete."""
    item = lambda text: F.struct(F.col("block_no"), F.coalesce(text, F.lit("")).alias("text"), F.col("role"), F.col("bold"), F.col("italic"))
    ordered = lambda text: F.array_sort(F.collect_list(item(text)))
    grouped = blocks.groupBy("source_hash", "page_number").agg(F.first("layout").alias("layout"), ordered("raw_text").alias("raw_blocks"), ordered("text").alias("blocks"), F.min("error").alias("error"))
    text = lambda c, sep: F.array_join(F.transform(c, lambda b: b["text"]), sep)
    return grouped.select("source_hash", "page_number", text(F.col("raw_blocks"), "\n").alias("raw_text"), text(F.col("blocks"), "\n\n").alias("repaired_text"), "layout", "blocks", "raw_blocks", F.lit(signature).alias("repair_signature"), F.col("error").isNull().alias("complete"), "error")


def latest(rows: DataFrame) -> DataFrame:
    """The row of each page with the highest ``wave``."""
    columns = [c for c in rows.columns if c not in ("source_hash", "page_number", "wave")]
    last = F.max_by(F.struct(*columns), "wave").alias("last")
    return rows.groupBy("source_hash", "page_number").agg(last).select("source_hash", "page_number", "last.*")


def merge(checkpoint: DataFrame, changed: DataFrame) -> DataFrame:
    """The table with changed pages in place of their old rows."""
    keep = checkpoint.join(changed.select("source_hash", "page_number"), ["source_hash", "page_number"], "left_anti")
    return keep.unionByName(changed, allowMissingColumns=True)


def save(checkpoint: DataFrame, path: str) -> None:
    """Writes pages by source; only the sources present in ``checkpoint`` are replaced."""
    checkpoint.write.mode("overwrite").partitionBy("source_hash").option("partitionOverwriteMode", "dynamic").parquet(path)
