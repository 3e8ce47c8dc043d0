"""Row types of the document engine. Order is data: (book_id, page_number, block_no) orders every block."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "x1", "y1")])
STYLED = [T.StructField("text", T.StringType()), T.StructField("role", T.StringType()), T.StructField("bold", T.BooleanType()), T.StructField("italic", T.BooleanType())]
BLOCKS = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("block_no", T.IntegerType()), *STYLED, T.StructField("bbox", BOX)])
PAGES = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()), T.StructField("layout", T.StringType()), T.StructField("is_blank", T.BooleanType())])
IMAGES = T.StructType([T.StructField("book_id", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("image_no", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("alt", T.StringType())])
CHECKPOINT_BLOCK = T.StructType([*STYLED, T.StructField("block_no", T.IntegerType()), T.StructField("bbox", BOX)])
CHECKPOINT = T.StructType(
    [
        T.StructField("source_hash", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("raw_text", T.StringType()), T.StructField("repaired_text", T.StringType()), T.StructField("layout", T.StringType()),
        T.StructField("blocks", T.ArrayType(CHECKPOINT_BLOCK)), T.StructField("raw_blocks", T.ArrayType(CHECKPOINT_BLOCK)), T.StructField("repair_signature", T.StringType()), T.StructField("complete", T.BooleanType()),
    ]
)
ROLES = ("page-number", "footnote", "heading", "table", "paragraph", "poetry")
LAYOUTS = ("single-column", "multi-column")
