"""Layout: roles of blocks, running headers, columns and blank pages.

Blocks are rows (book_id, page_number, block_no, text, x0, y0, x1, y1) and pages rows
(book_id, page_number, width, height). Everything is a projection, one aggregate by book
or page, or an anti-join; only the repeated texts of a book are ever compared with blocks.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.functions.lexicon import CHAPTER_WORDS
from quirelake.functions.text import WS, WS_SET, W, casefold, is_upper, let, splitlines, strip, where

FOOTNOTE_BELOW, TOP_MARGIN, BOTTOM_MARGIN = 0.78, 0.12, 0.88
LEAST_COLUMN_BLOCKS = 8
#: Repeated texts of all books that are sent to every task, at most; beyond, blocks are shuffled to them.
SENT_HEADERS = 250_000
_CHAPTER = rf"(?iu)\A(?:{'|'.join(CHAPTER_WORDS)})(?!{W})"
_PAGE_NUMBER = rf"(?iu)\A[-–—]?{WS}*(?:\p{{Nd}}{{1,4}}|[ivxlcdm]{{1,12}}){WS}*[-–—]?\z"


def is_page_number(text: Column) -> Column:
    """One to four digits or one to twelve letters of Roman numerals, between optional dashes."""
    return strip(text).rlike(_PAGE_NUMBER)


def block_role(text: Column, y0: Column, height: Column) -> Column:
    """The first that holds: page-number, footnote, heading, table, paragraph."""
    return let(strip(text), lambda t: (
        F.when(t.rlike(_PAGE_NUMBER), "page-number")
        .when((y0 > height * FOOTNOTE_BELOW) & (F.char_length(t) < 240), "footnote")
        .when((F.char_length(t) <= 90) & (is_upper(t) | t.rlike(_CHAPTER)), "heading")
        .when(t.rlike(rf"\t|{WS}{{3,}}"), "table")
        .otherwise("paragraph")
    ))


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    return (y0 < height * TOP_MARGIN) | (y1 > height * BOTTOM_MARGIN)


def header_key(text: Column) -> Column:
    """Folded text with white space as single spaces and digit runs as one sign, so that page numbers don't tell headers apart."""
    odd_run = f" {WS}++|[{WS_SET}&&[^ ]]{WS}*+"  # single spaces stay as they are
    return let(strip(text), lambda t: F.regexp_replace(where(casefold(t), lambda t: t.rlike(odd_run), lambda t: F.regexp_replace(t, odd_run, " ")), r"\p{Nd}+", "#"))


def repeated_margins(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``book_id, header, n``: margin texts that a book has at least max(3, pages // 4) times."""
    counts = blocks.where(in_margin(F.col("y0"), F.col("y1"), F.col("height"))).groupBy("book_id", header_key(F.col("text")).alias("header")).agg(F.count("*").alias("n"))
    books = pages.groupBy("book_id").agg(F.count("*").alias("pages"))
    return counts.join(books, "book_id").where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") / 4))).select("book_id", "header", "n")


def with_page_size(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    return blocks.join(pages.select("book_id", "page_number", "width", "height"), ["book_id", "page_number"])


def drop_headers(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """Blocks without page numbers and without the repeated texts of their book, wherever on the page they stand."""
    found = durable(repeated.select("book_id", "header"))
    keyed = blocks.where(~is_page_number(F.col("text"))).withColumn("header", header_key(F.col("text")))
    return keyed.join(F.broadcast(found) if found.count() <= SENT_HEADERS else found, ["book_id", "header"], "left_anti").drop("header")


def page_layout(blocks: DataFrame) -> DataFrame:
    """``book_id, page_number, layout`` of pages with blocks: multi-column when left and right hold three blocks or more each and the middle a quarter at most."""
    centre = (F.col("x0") + F.col("x1")) / 2
    n, left, right = F.count("*"), F.count_if(centre < F.col("width") * 0.45), F.count_if(centre > F.col("width") * 0.55)
    multi = (n >= LEAST_COLUMN_BLOCKS) & (left >= 3) & (right >= 3) & (n - left - right <= n * 0.25)
    return blocks.groupBy("book_id", "page_number").agg(F.when(multi, "multi-column").otherwise("single-column").alias("layout"))


def page_flags(pages: DataFrame, blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """``book_id, page_number, layout, is_blank``: the layout from all blocks, blank when none is kept."""
    left = kept.groupBy("book_id", "page_number").agg(F.count("*").alias("n"))
    return (
        pages.select("book_id", "page_number")
        .join(page_layout(blocks), ["book_id", "page_number"], "left")
        .join(left, ["book_id", "page_number"], "left")
        .select("book_id", "page_number", F.coalesce("layout", F.lit("single-column")).alias("layout"), (F.coalesce("n", F.lit(0)) == 0).alias("is_blank"))
    )


def books_needing_ocr(books: DataFrame, flags: DataFrame) -> DataFrame:
    """``book_id, needs_ocr``: the book has no native page, or a blank one."""
    blank = flags.groupBy("book_id").agg(F.bool_or("is_blank").alias("blank"))
    return books.select("book_id").join(blank, "book_id", "left").select("book_id", F.coalesce("blank", F.lit(True)).alias("needs_ocr"))


def heading_of(text: Column, role: Column) -> Column:
    """A block's chapter title or null: its first line, if it is a heading or the line is short and begins with a chapter word."""
    opens = lambda first: let(casefold(first), lambda x: reduce(or_, (F.startswith(x, F.lit(w.casefold())) for w in CHAPTER_WORDS)))
    first = F.coalesce(F.try_element_at(splitlines(strip(text)), F.lit(1)), F.lit(""))
    return let(first, lambda x: F.when((role == "heading") | ((F.char_length(x) <= 80) & opens(x)), x))


def looks_poetic(text: Column) -> Column:
    """Three lines or more that aren't blank, over 70 % of them short; lengths count white space."""
    lines = F.filter(splitlines(text), lambda x: strip(x) != "")
    return let(lines, lambda x: (F.size(x) >= 3) & (F.size(F.filter(x, lambda y: F.char_length(y) <= 42)) / F.size(x) > 0.7))


def analyse(blocks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept blocks with their roles, and page flags."""
    sized = with_page_size(blocks, pages)
    kept = drop_headers(sized, repeated_margins(sized, pages)).withColumn("role", block_role(F.col("text"), F.col("y0"), F.col("height")))
    return kept, page_flags(pages, sized, kept)
