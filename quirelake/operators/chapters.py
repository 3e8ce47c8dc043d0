"""Chapters: ordered blocks of a book become numbered chapters.

A book's pages are parted into ranges. Within a range a window over its blocks counts the
headings and the chapters that have a body; a range's totals, one row, say what it hands on:
its last title, how many chapters it has, and whether its first blocks go on with a chapter
that has begun before. Only these rows are scanned book by book, so the pages of a giant
book are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.functions.text import is_blank
from quirelake.operators.layout import heading_of
from quirelake.operators.ranges import running, span_of

ORDER = ("page_number", "block_no")


def chapter_blocks(blocks: DataFrame) -> DataFrame:
    """Body blocks with ``chapter_no`` and ``chapter_title``, which is null before the first heading.

    ``blocks`` has book_id, page_number, block_no, text and role. Blank blocks are passed
    over. A heading closes the chapter before it and gives the next one its title (its
    first line; the rest of it is lost); of headings with nothing between them the last
    counts, and one with nothing after it is lost.
    """
    book = ["book_id", "_span"]
    here = Window.partitionBy(*book).orderBy(*ORDER)
    upto, earlier = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    marked = blocks.where(~is_blank(F.col("text"))).withColumn("heading", heading_of(F.col("text"), F.col("role"))).withColumn("_span", span_of(F.col("page_number")))
    body, at = F.col("heading").isNull(), F.struct(*ORDER)
    parted = marked.withColumn("_segment", F.count("heading").over(upto)).withColumn("_opened", F.last("heading", ignorenulls=True).over(upto))
    last_body = F.last(F.when(body, F.col("_segment")), ignorenulls=True).over(earlier)
    opens = body & (last_body.isNull() | (last_body < F.col("_segment")))
    # Both the totals and the rows are made from this, and a heading may be costly to tell.
    ranked = durable(parted.withColumn("_opens", opens.cast("int")).withColumn("_rank", F.sum("_opens").over(upto)))

    totals = ranked.groupBy(*book).agg(
        F.max("_rank").alias("chapters"), F.max_by("heading", F.when(~body, at)).alias("title"), F.max(F.when(~body, at)).alias("heading_at"), F.max(F.when(body, at)).alias("body_at"), F.bool_or(body & (F.col("_segment") == 0)).alias("goes_on")
    )
    before = Window.partitionBy("book_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    heading_at, body_at = F.max("heading_at").over(before), F.max("body_at").over(before)
    within = F.coalesce(F.col("goes_on") & (heading_at.isNull() | (body_at > heading_at)) & body_at.isNotNull(), F.lit(False)).cast("int")
    totals = totals.withColumn("_within", within).withColumn("_title", F.last("title", ignorenulls=True).over(before))
    firsts = totals.select(*book, "_title", (F.coalesce(F.sum(F.col("chapters") - F.col("_within")).over(before), F.lit(0)) - F.col("_within")).alias("_first"))

    numbered = ranked.where(body).join(firsts, book)
    return numbered.withColumn("chapter_title", F.coalesce("_opened", "_title")).withColumn("chapter_no", (F.col("_first") + F.col("_rank")).cast("int")).drop("heading", "_span", "_segment", "_opened", "_opens", "_rank", "_title", "_first")


def titled_blocks(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """:func:`chapter_blocks` of the blocks of ``books`` (book_id, title), with the book's title before the first heading."""
    titles = books.select("book_id", F.col("title").alias("book_title"))
    return chapter_blocks(blocks).join(titles, "book_id").withColumn("chapter_title", F.coalesce("chapter_title", "book_title")).drop("book_title")


def chapters(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """``book_id, chapter_no, title, n_blocks, n_chars``; a book without body has one empty chapter with its own title.

    ``books`` has book_id and title.
    """
    made = chapter_blocks(blocks).groupBy("book_id", "chapter_no").agg(F.first("chapter_title").alias("chapter_title"), F.count("*").alias("n_blocks"), F.sum(F.char_length("text")).alias("n_chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    named = books.select("book_id", "title").join(made, "book_id", "left")
    return named.select("book_id", F.coalesce("chapter_no", F.lit(1)).alias("chapter_no"), F.coalesce("chapter_title", "title").alias("title"), zero("n_blocks"), zero("n_chars"))


def image_offsets(counts: DataFrame) -> DataFrame:
    """``counts`` (book_id, chapter_no, n_images) with the number of images in the book's earlier chapters."""
    return running(counts, "book_id", "chapter_no", F.col("n_images"), "image_offset")


def progress(pages: DataFrame) -> DataFrame:
    """``book_id, page_number, percent, step``: whole percent done after each page and the change since the page before."""
    numbered = running(pages.select("book_id", "page_number"), "book_id", "page_number", F.lit(1), "_before", "_all")
    percent = lambda done: F.floor(done / F.greatest(F.col("_all"), F.lit(1)) * 100).cast("int")
    return numbered.select("book_id", "page_number", percent(F.col("_before") + 1).alias("percent"), (percent(F.col("_before") + 1) - percent(F.col("_before"))).alias("step"))
