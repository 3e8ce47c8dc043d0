"""The whole conversion: pages and blocks, or files, to repaired, chaptered, packaged books, reusing what a page log has.

Only settings, the choice of engines and the callers' callbacks touch the driver. Pages
that the log answers are neither recognised nor repaired again. The others are written once
as a list of work, dealt into waves by their order. A wave is a job of its own: its blank
pages are drawn and recognised, its blocks repaired, and its rows committed to the log before
the next wave begins; then progress and previews are told. Whether to stop is asked before
each wave and again and again while it runs; a stopped or killed run has lost the wave that
ran, with at most its pages' engine and model calls, and no wave before. All outputs are made
from what was committed.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quirelake.durable import discard, durable, scratch_path
from quirelake.errors import Cancelled, MissingDependency
from quirelake.functions.guards import decide
from quirelake.functions.providers import TextModel, ask_model, make_model
from quirelake.functions.repair import repair
from quirelake.functions.text import is_blank, settle
from quirelake.operators.cache import complete_rows, full_blocks, page_rows, repair_signature, source_hash, with_action
from quirelake.operators.chapters import chapters, titled_blocks
from quirelake.operators.layout import analyse, books_needing_ocr
from quirelake.operators.pagelog import PageLog
from quirelake.operators.render import STYLE, book_files, placed_figures
from quirelake.operators.rows import stacked
from quirelake.plans.jobs import numbered, stoppable
from quirelake.sinks.archive import archives
from quirelake.sources import native, ocr
from quirelake.sources.config import Settings
from quirelake.sources.images import prepare_images

LOGGER = logging.getLogger(__name__)
PAGE = ["book_id", "page_number"]
KEYS = [*PAGE, "block_no"]
STYLED = ["text", "role", "bold", "italic"]
Progress = Callable[[int, int, str], None]
Preview = Callable[[str, int, str, str], None]


def repair_blocks(blocks: DataFrame, make_model: Callable[[], TextModel] | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """``blocks`` with ``raw_text`` and repaired ``text``; with a model, its guarded answers where they hold. Without a ``lexicon`` (word) no answer is refused for its words."""
    lines = F.coalesce(F.col("role").isin("table", "poetry"), F.lit(False))
    done = settle(blocks.withColumn("raw_text", F.col("text")), "text", F.when(is_blank(F.col("raw_text")), "").otherwise(repair(F.col("raw_text"), lines)))
    if make_model is None:
        return done
    done = durable(done)  # the model is asked once
    keyed = done.select(F.to_json(F.struct(*KEYS)).alias("key"), F.col("text").alias("rules"))
    answers = durable(ask_model(keyed, make_model))
    decided = decide(keyed.join(answers, "key"), lexicon).select("key", F.col("text").alias("final"))
    return done.withColumn("key", F.to_json(F.struct(*KEYS))).join(decided, "key", "left").withColumn("text", F.coalesce("final", "text")).drop("key", "final")


def recognised_blocks(images: DataFrame, wanted: DataFrame, make: Callable[[], ocr.ImageEngine], profile: ResourceProfile | None = None) -> DataFrame:
    """One paragraph block, with its ``error`` if it failed, for each of the ``wanted`` pages (book_id, page_number) that has images (book_id, page_number, image_no, image)."""
    texts = ocr.page_texts(ocr.recognise_images(images.join(wanted.select(*PAGE), PAGE, "left_semi"), make, profile))
    return texts.select(*PAGE, F.lit(1).alias("block_no"), "text", F.lit("paragraph").alias("role"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), "error")


def _blocks_of(rows: DataFrame, column: str, *more: str) -> DataFrame:
    """Blocks of checkpoint rows, numbered from 1."""
    spread = rows.select(F.col("source_hash").alias("book_id"), "page_number", *more, F.posexplode(column).alias("place", "b"))
    return spread.select(*PAGE, (F.col("place") + 1).alias("block_no"), *[F.col(f"b.{c}").alias(c) for c in STYLED], *more)


class _Work:
    """The pages to do, written once: blocks, and the blank pages to recognise, each by wave."""

    def __init__(self, spark: SparkSession, missing: DataFrame, blocks: DataFrame, blank: DataFrame, waves: int):
        self.spark, self.path = spark, scratch_path(spark, "work")
        dealt = numbered(missing.select(*PAGE), *PAGE)
        n = max(1, missing.count())
        self.waves = min(waves, n)
        wave = dealt.select(*PAGE, F.floor(F.col("number") * self.waves / F.lit(n)).cast("int").alias("wave"))
        for name, rows in (("blocks", blocks), ("blank", blank)):
            # A wave's pages are spread over all tasks, so a wave has work for the whole cluster.
            spread = rows.join(wave, PAGE).repartition("wave", F.pmod(F.xxhash64(*PAGE), F.lit(spark.sparkContext.defaultParallelism)))
            spread.write.partitionBy("wave").parquet(f"{self.path}/{name}")
        self.schemas = {"blocks": blocks.schema, "blank": blank.schema}

    def of(self, name: str, wave: int) -> DataFrame:
        """The rows of one wave, read from its own folder."""
        schema = self.schemas[name]
        whole = self.spark.read.schema(StructType([*schema.fields, StructField("wave", IntegerType())])).parquet(f"{self.path}/{name}")
        return whole.where(F.col("wave") == wave).select(*schema.fieldNames())

    def close(self) -> None:
        discard(self.spark, self.path)


def _run(work: _Work, log: PageLog, signature: str, made: Callable[[DataFrame, DataFrame], DataFrame], total: int, told: int, progress: Progress | None, preview: Preview | None, cancelled: Callable[[], bool] | None) -> list[str]:
    """The waves of the log that the work gave, one after another; each is committed before the next begins."""
    written: list[str] = []
    for wave in range(work.waves):
        if cancelled is not None and cancelled():
            raise Cancelled(f"stopped after {told} of {total} pages")
        rows = page_rows(made(work.of("blocks", wave), work.of("blank", wave)).withColumnRenamed("book_id", "source_hash"), signature)
        try:
            name = stoppable(work.spark, cancelled, lambda: log.write(rows))  # noqa: B023
        except Cancelled as e:
            raise Cancelled(f"stopped after {told} of {total} pages") from e
        written.append(name)
        done = log.rows([name])
        told += done.count()
        if preview is not None:
            for r in done.where("complete").select("source_hash", "page_number", "raw_text", "repaired_text").orderBy("source_hash", "page_number").toLocalIterator():
                preview(*r)
        if progress is not None:
            progress(told, total, f"{told} of {total} pages")
    return written


def read_waves(spark: SparkSession, table: str) -> DataFrame | None:
    """The last row of each page in the log that runs have written, or None if there is none."""
    return PageLog(spark, table).read()


def convert(
    blocks: DataFrame, pages: DataFrame, books: DataFrame, settings: Settings | None = None, checkpoint: DataFrame | None = None, images: DataFrame | Callable[[DataFrame], DataFrame] | None = None,
    make_engine: Callable[[], ocr.ImageEngine] | None = None, texts: DataFrame | None = None, make_model: Callable[[], TextModel] | None = None, lexicon: DataFrame | None = None, style: str = STYLE, table: str | None = None,
    waves: int = 1, progress: Progress | None = None, preview: Preview | None = None, cancelled: Callable[[], bool] | None = None, figures: DataFrame | None = None, covers: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """``blocks``, ``chapters``, ``archives``, the new ``checkpoint`` rows and the ``failed`` pages with their errors.

    ``blocks`` are native text blocks with geometry, ``pages`` their sizes, ``books``
    book_id, title, author, language. ``checkpoint`` has the book id as source hash.
    ``images`` are page images, or what makes them for the blank pages (book_id,
    page_number) that it is given, a wave at a time. ``texts`` are pages read in another way
    (book_id, page_number, text, error), which are paragraphs as they stand. ``figures``
    (book_id, page_number, figure_no, path, alt, media_type, content) are pictures that the
    books show at the end of the chapter that their page is in, ``covers`` (book_id, path,
    content) their covers. Pages are done in ``waves``, each committed to the log at
    ``table``, or else to one in the session's checkpoint folder, and all results are made
    from that, so engines and models are asked once for a page. A page whose recognition
    failed is written as incomplete, so that a later run tries it again, and its book gets no
    archive. ``progress`` is told (pages done, pages, message) and ``preview`` (book_id,
    page_number, raw text, repaired text) after each wave. ``cancelled`` is asked by another
    thread while jobs run; with ``lexicon`` (word) answers that bring other words are refused.
    """
    if cancelled is not None and cancelled():
        raise Cancelled("stopped before it began")
    spark = blocks.sparkSession
    settings = settings or Settings()
    signature = repair_signature(asdict(settings.ai))
    kept, flags = analyse(blocks, pages)
    if texts is not None:
        flags = stacked(flags, texts.select(*PAGE, F.lit("single-column").alias("layout"), F.lit(False).alias("is_blank")))
    none = F.lit(None).cast("string").alias("error")

    def listed() -> tuple[DataFrame, DataFrame | None, _Work, dict[str, int]]:
        """What each page needs, and the work written down."""
        known = durable(flags)
        stored = complete_rows(checkpoint) if checkpoint is not None else None
        state = durable(with_action(known.select(F.col("book_id").alias("source_hash"), "page_number"), stored, signature))
        page = [F.col("source_hash").alias("book_id"), "page_number"]
        missing = state.where("action = 'missing'").select(*page)
        todo = kept.select(*KEYS, "text", "role", F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"), none).join(missing, PAGE, "left_semi")
        if texts is not None:
            plain = [F.lit(1).alias("block_no"), "text", F.lit("paragraph").alias("role"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), "error"]
            todo = stacked(todo, texts.join(missing, PAGE, "left_semi").select(*PAGE, *plain))
        todo = todo.join(known.select(*PAGE, "layout"), PAGE)
        if stored is not None:
            stale = state.where("action = 'repaired'").select("source_hash", "page_number")
            raw = full_blocks(stored.join(stale, ["source_hash", "page_number"], "left_semi"), "raw_blocks", "raw_text")
            todo = stacked(todo, _blocks_of(raw, "raw_blocks", "layout").withColumn("error", none))
        blank = known.where("is_blank").join(missing, PAGE, "left_semi").select(*PAGE, "layout")
        work = _Work(spark, state.where("action <> 'reused'").select(*page), todo, blank, waves)
        reused = stored.join(state.where("action = 'reused'").select("source_hash", "page_number"), ["source_hash", "page_number"], "left_semi") if stored is not None else None
        return known, reused, work, {r["action"]: r["count"] for r in state.groupBy("action").count().collect()}  # three rows

    known, reused, work, counts = stoppable(spark, cancelled, listed)

    def made(part: DataFrame, blank: DataFrame) -> DataFrame:
        if images is not None and make_engine is not None:
            pictures = images(blank.select(*PAGE)) if callable(images) else images
            part = stacked(part, recognised_blocks(pictures, blank, make_engine, ocr.gpu_profile(spark, settings.ocr)).join(blank, PAGE).select(part.columns))
        return repair_blocks(part, make_model, lexicon)

    log = PageLog(spark, table if table is not None else scratch_path(spark, "pages"))
    try:
        fresh = log.rows(_run(work, log, signature, made, sum(counts.values()), counts.get("reused", 0), progress, preview, cancelled))
    finally:
        work.close()
    log.compact()
    done = _blocks_of(fresh.where("complete"), "blocks")
    if reused is not None:
        done = stacked(done, _blocks_of(full_blocks(reused, "blocks", "repaired_text"), "blocks"))
    failed = fresh.where("NOT complete").select(F.col("source_hash").alias("book_id"), "page_number", "error")
    good = books.join(failed.select("book_id").distinct(), "book_id", "left_anti")
    titled = titled_blocks(done, good)
    placed = placed_figures(figures.join(good.select("book_id"), "book_id", "left_semi"), titled) if figures is not None else None
    files = book_files(good, titled, style, images=placed, covers=covers)
    return {"blocks": done, "chapters": chapters(done, books), "archives": archives(files), "files": files, "checkpoint": fresh, "failed": failed}


def distinct_files(files: DataFrame) -> DataFrame:
    """``book_id, content``: each file once, named by the SHA-256 of its bytes. Of equal files with names (book_id) that of the least name is read; bytes are shuffled only where there are no names."""
    hashed = files.select(source_hash(F.col("content")).alias("book_id"), "content", *([F.col("book_id").alias("name")] if "book_id" in files.columns else []))
    if "name" not in hashed.columns:
        return hashed.dropDuplicates(["book_id"])
    firsts = durable(hashed.groupBy("book_id").agg(F.min("name").alias("name")))
    return hashed.join(firsts, ["book_id", "name"], "left_semi").select("book_id", "content")


def convert_files(
    files: DataFrame, settings: Settings | None = None, table: str | None = None, resume: bool = False, scan: Callable[[DataFrame], DataFrame] | None = None, render: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None, make_engine: Callable[[], ocr.ImageEngine] | None = None, recognise: Callable[[DataFrame], DataFrame] | None = None, make_text_model: Callable[[], TextModel] | None = None, **options,
) -> dict[str, DataFrame]:
    """:func:`convert` of PDF ``files`` (content, and book_id where they have names), with the books named by the SHA-256 of their bytes; a file given twice is one book.

    Text layers are scanned; of pages without text images are rendered, prepared and read
    by the recogniser that the settings name, which must be installed if any page needs it.
    Books without a text layer go whole to the document recogniser, if that is the one.
    With ``resume`` the rows in ``table`` are taken as the checkpoint. ``scan``, ``render``,
    ``prepare``, ``make_engine``, ``recognise`` and ``make_text_model`` stand for the
    installed libraries, programs and servers; ``options`` are those of :func:`convert`.
    """
    settings = settings or Settings()
    spark = files.sparkSession
    if scan is None and not native.has_pdf_library():
        raise MissingDependency("reading PDF files needs PyMuPDF")
    cancelled = options.get("cancelled")
    if cancelled is not None and cancelled():
        raise Cancelled("stopped before it began")
    named = distinct_files(files)
    raw = stoppable(spark, cancelled, lambda: durable((scan or native.scan_pdf)(named)))
    pages = raw.select(*PAGE, "width", "height").distinct()
    blocks = native.flatten_spans(raw).drop("width", "height")
    epub = settings.epub
    books = named.select("book_id").distinct().select("book_id", F.lit(epub.title).alias("title"), F.lit(epub.author).alias("author"), F.lit(epub.language).alias("language"))
    checkpoint = read_waves(spark, table) if resume and table is not None else None
    known = complete_rows(checkpoint).select(F.col("source_hash").alias("book_id"), "page_number") if checkpoint is not None else None
    flags = analyse(blocks, pages)[1]
    needed = flags.join(known, PAGE, "left_anti") if known is not None else flags
    without_text = books.join(pages.select("book_id").distinct(), "book_id", "left_anti").select("book_id")
    open_books = without_text if known is None else without_text.join(known.select("book_id").distinct(), "book_id", "left_anti")
    needs = books_needing_ocr(needed.select("book_id").distinct().unionByName(open_books), needed).where("needs_ocr")
    texts = None
    if needs.limit(1).count():
        there = None if make_engine or recognise else ocr.available_everywhere(spark)
        engine = settings.ocr.engine if there is None else ocr.choose_engine(settings.ocr.engine, is_available=there.__contains__)
        if recognise is not None or engine == ocr.DOCUMENT_ENGINE:
            read = recognise or (lambda f: ocr.recognise_documents(f, settings.ocr))
            side = stoppable(spark, cancelled, lambda: durable(read(named.join(open_books, "book_id", "left_semi"))))
            texts = native.split_sidecar(side.where("error IS NULL")).withColumn("error", F.lit(None).cast("string"))
            texts = texts.unionByName(side.where("error IS NOT NULL").select("book_id", F.lit(1).alias("page_number"), "text", "error"))
        if make_engine is None and needed.where("is_blank").limit(1).count():
            there = there if there is not None else ocr.available_everywhere(spark)
            name = engine if engine not in ("auto", ocr.DOCUMENT_ENGINE) else ocr.choose_engine("auto", images_only=True, is_available=there.__contains__)
            make_engine = ocr.engine_maker(name, settings.ocr)
    pictures = None
    if make_engine is not None:
        draw = render or (lambda f, wanted: native.render_pages(f, settings.ocr.dpi, wanted))
        ready = prepare or (lambda images: prepare_images(images, settings.ocr.split_double_pages))
        pictures = lambda wanted: ready(draw(named, wanted))
    asked = make_text_model or (None if settings.ai.provider == "rule" else lambda: make_model(settings.ai))
    if asked is not None and options.get("lexicon") is None:
        LOGGER.warning("no lexicon is given, so no answer of the model is refused for the words that it brings")
    style = Path(epub.style_path).read_text(encoding="utf-8") if epub.style_path else STYLE
    if epub.cover and options.get("covers") is None:  # one picture of the settings, for every book
        cover = spark.createDataFrame([(epub.cover, Path(epub.cover).read_bytes())], "path string, content binary")
        options["covers"] = books.select("book_id").crossJoin(F.broadcast(cover))
    return convert(blocks, pages, books, settings, checkpoint, pictures, make_engine, texts, asked, style=style, table=table, **options)
