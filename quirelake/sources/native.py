"""Text layers of page documents: spans to lines to blocks, and the optional PDF scan."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.errors import MissingDependency
from quirelake.functions.text import is_blank, strip

#: Pages of a book that a task draws.
SPAN = 32
RAW_BLOCKS = "book_id string, page_number int, width double, height double, block_no int, kind int, x0 double, y0 double, x1 double, y1 double, lines array<array<struct<text:string,font:string>>>"


def block_text(lines: Column) -> Column:
    """Text of an array of lines of spans: spans of a line run together, blank lines go, lines end in LF, ends stripped."""
    joined = F.transform(lines, lambda spans: F.array_join(F.transform(spans, lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    return strip(F.array_join(F.filter(joined, lambda x: ~is_blank(x)), "\n"))


def any_font(lines: Column, *names: str) -> Column:
    """Whether the font of any span has one of the names in it, whatever the case."""
    fonts = F.transform(F.flatten(lines), lambda s: F.lower(F.coalesce(s["font"], F.lit(""))))
    return F.exists(fonts, lambda f: reduce(or_, (F.contains(f, F.lit(n)) for n in names)))


def flatten_spans(raw: DataFrame) -> DataFrame:
    """``raw`` (RAW_BLOCKS) as text blocks with text, bold and italic; other kinds than 0 and blocks without text go."""
    kept = raw.where("kind = 0").withColumn("text", block_text(F.col("lines"))).where("text <> ''")
    return kept.withColumn("bold", any_font(F.col("lines"), "bold")).withColumn("italic", any_font(F.col("lines"), "italic", "oblique")).drop("kind", "lines")


def split_sidecar(texts: DataFrame, id_col: str = "book_id", text_col: str = "text") -> DataFrame:
    """``book_id, page_number, text``: pages of a text at form feeds; blank pages go but keep their number."""
    pages = texts.select(F.col(id_col).alias("book_id"), F.posexplode(F.split(F.col(text_col), "\f")).alias("place", "text"))
    return pages.where(~is_blank(F.col("text"))).select("book_id", (F.col("place") + 1).alias("page_number"), "text")


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``book_id, content``: files of a folder, named by their path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("book_id"), "content")


def has_pdf_library() -> bool:
    return importlib.util.find_spec("fitz") is not None


def scan_pdf(files: DataFrame) -> DataFrame:
    """Raw blocks (RAW_BLOCKS) of PDF files (book_id, content); pages without blocks have one row of kind -1.

    Raises without the PDF library.
    """
    if not has_pdf_library():
        raise MissingDependency("reading PDF files needs PyMuPDF")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        names = ["book_id", "page_number", "width", "height", "block_no", "kind", "x0", "y0", "x1", "y1", "lines"]
        for batch in batches:
            for book, content in zip(batch["book_id"], batch["content"]):
                rows = []
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for n, page in enumerate(doc, 1):
                        size = (float(page.rect.width), float(page.rect.height))
                        found = page.get_text("dict").get("blocks", [])
                        for k, b in enumerate(found, 1):
                            lines = [[{"text": s.get("text", ""), "font": s.get("font", "")} for s in line.get("spans", [])] for line in b.get("lines", [])]
                            rows.append((book, n, *size, k, int(b.get("type", 0)), *map(float, b["bbox"]), lines))
                        if not found:
                            rows.append((book, n, *size, 0, -1, 0.0, 0.0, 0.0, 0.0, []))
                yield pd.DataFrame(rows, columns=names)

    return files.select("book_id", "content").mapInPandas(step, RAW_BLOCKS)


def page_counts(files: DataFrame) -> DataFrame:
    """``book_id, pages`` of PDF files; raises without the PDF library."""
    if not has_pdf_library():
        raise MissingDependency("counting pages needs PyMuPDF")
    return scan_pdf(files).groupBy("book_id").agg(F.max("page_number").alias("pages"))


def render_pages(files: DataFrame, dpi: int = 300, wanted: DataFrame | None = None) -> DataFrame:
    """``book_id, page_number, name, image``: every page, or the ``wanted`` ones (book_id, page_number), as PNG bytes; raises without the PDF library."""
    if not has_pdf_library():
        raise MissingDependency("rendering pages needs PyMuPDF")

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for book, content, numbers in zip(batch["book_id"], batch["content"], batch["numbers"]):
                chosen = None if numbers is None else set(numbers)
                with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                    for n in (n for n in range(1, len(doc) + 1) if chosen is None or n in chosen):
                        page = doc[n - 1]
                        image = page.get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72), alpha=False).tobytes("png")
                        yield pd.DataFrame({"book_id": [book], "page_number": [n], "name": [f"rendered_{n:05d}.png"], "image": [image]})

    if wanted is None:
        named = files.select("book_id", "content", F.lit(None).cast("array<int>").alias("numbers"))
    else:  # the numbers of a range of pages go with the file, and ranges of a book to several tasks
        span = F.floor((F.col("page_number") - 1) / SPAN).alias("span")
        ranges = wanted.groupBy("book_id", span).agg(F.collect_set(F.col("page_number").cast("int")).alias("numbers"))
        named = files.select("book_id", "content").join(ranges, "book_id").repartition("book_id", "span").select("book_id", "content", "numbers")
    return named.mapInPandas(step, "book_id string, page_number int, name string, image binary")
