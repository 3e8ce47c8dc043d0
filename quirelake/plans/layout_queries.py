"""Queries of sources and layout, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.text import strip
from quirelake.operators import layout
from quirelake.plans import fixtures
from quirelake.plans.fixtures import BLOCKS_SQL, HEIGHT, WIDTH
from quirelake.sources import native, ocr

ID = ["book_id", "page_number", "block_no"]
#: Strip, page number and folded header in SQL; the tables have ASCII white space only.
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
IS_PAGE_NUMBER = r"regexp_full_match(" + STRIP.format("text") + r", '(?i)[-–—]?\s*(\p{Nd}{1,4}|[ivxlcdm]{1,12})\s*[-–—]?')"
HEADER = STRIP.format(r"regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '\p{Nd}+', '#', 'g')")
KEPT_SQL = f"""{BLOCKS_SQL}, keyed AS (
  SELECT *, {HEADER} AS header FROM blocks
), repeated AS (
  SELECT m.book_id, header, n FROM (SELECT book_id, header, count(*) AS n FROM keyed WHERE y0 < {HEIGHT} * 0.12 OR y1 > {HEIGHT} * 0.88 GROUP BY ALL) m
  JOIN (SELECT book_id, count(*) AS pages FROM pages0 GROUP BY 1) p USING (book_id) WHERE n >= greatest(3, pages // 4)
), kept AS (
  SELECT * FROM keyed k WHERE NOT {IS_PAGE_NUMBER} AND NOT EXISTS (SELECT 1 FROM repeated r WHERE r.book_id = k.book_id AND r.header = k.header)
)"""
ROLE = rf"""CASE WHEN {IS_PAGE_NUMBER} THEN 'page-number' WHEN y0 > {HEIGHT} * 0.78 AND length({STRIP.format("text")}) < 240 THEN 'footnote'
    WHEN length({STRIP.format("text")}) <= 90 AND ((regexp_matches({STRIP.format("text")}, '\p{{Lu}}') AND NOT regexp_matches({STRIP.format("text")}, '[\p{{Ll}}\p{{Lt}}]'))
         OR regexp_matches({STRIP.format("text")}, '(?i)^(bölüm|chapter|kısım)([^\p{{L}}\p{{N}}_]|$)')) THEN 'heading'
    WHEN regexp_matches({STRIP.format("text")}, '\t|\s{{3,}}') THEN 'table' ELSE 'paragraph' END"""
LAYOUT_SQL = f"""layouts AS (
  SELECT book_id, page_number, CASE WHEN count(*) >= 8 AND count(*) FILTER (WHERE (x0 + x1) / 2 < {WIDTH} * 0.45) >= 3 AND count(*) FILTER (WHERE (x0 + x1) / 2 > {WIDTH} * 0.55) >= 3
    AND count(*) FILTER (WHERE (x0 + x1) / 2 BETWEEN {WIDTH} * 0.45 AND {WIDTH} * 0.55) <= count(*) * 0.25 THEN 'multi-column' ELSE 'single-column' END AS layout
  FROM blocks GROUP BY ALL)"""


def block_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as numbered lines."""
    d = fixtures.documents(spark, sf_dir)
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).select("doc_id", (F.col("place") + 1).cast("long").alias("line_no"), "line")


def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as spans of lines, put together again, with the font flags of the block."""
    d = fixtures.documents(spark, sf_dir)
    font = lambda w: F.when(F.char_length(w) % 7 == 0, "Serif-BOLD").when(F.char_length(w) % 11 == 0, "Sans-Oblique").otherwise("Serif")
    lines = F.transform(F.split("text", "\n"), lambda line: F.transform(F.split(line, " "), lambda w: F.struct(w.alias("text"), font(w).alias("font"))))
    raw = d.select(F.col("doc_id").cast("string").alias("book_id"), F.lit(1).alias("page_number"), F.lit(1).alias("block_no"), (F.col("doc_id") % 10 == 9).cast("int").alias("kind"), lines.alias("lines"))
    return native.flatten_spans(raw).select("book_id", "text", "bold", "italic")


def sidecar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with form feeds for line ends of every third line and a blank page in front, split into pages."""
    text = F.concat(F.lit(" \f"), F.replace("text", F.lit(".\n"), F.lit(".\f")))
    pages = native.split_sidecar(fixtures.documents(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id")
    return pages.select(F.col("book_id").alias("doc_id"), F.col("page_number").cast("long").alias("page_number"), "text")


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.blocks(spark, sf_dir).where(layout.is_page_number(F.col("text"))).select(*ID, "text")


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.sized_blocks(spark, sf_dir)
    return b.select(*ID, layout.block_role(F.col("text"), F.col("y0"), F.col("height")).alias("role"))


def repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.repeated_margins(fixtures.sized_blocks(spark, sf_dir), fixtures.book_pages(spark, sf_dir))


def header_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.sized_blocks(spark, sf_dir)
    return layout.drop_headers(b, layout.repeated_margins(b, fixtures.book_pages(spark, sf_dir))).select(*ID, "text")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_layout(fixtures.sized_blocks(spark, sf_dir))


def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.analyse(fixtures.blocks(spark, sf_dir), fixtures.book_pages(spark, sf_dir))[1]


def needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd-numbered sources lose their page 10s' blankness, so both answers occur; one more book has no page at all."""
    flags = layout.analyse(fixtures.blocks(spark, sf_dir), fixtures.book_pages(spark, sf_dir))[1]
    books = fixtures.books(spark, sf_dir).select("book_id").unionByName(spark.range(1).select(F.lit("no pages").alias("book_id")))
    return layout.books_needing_ocr(books, flags.where(~(F.col("is_blank") & (F.char_length("book_id") == 4))))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = fixtures.sized_blocks(spark, sf_dir)
    title = layout.heading_of(F.col("text"), layout.block_role(F.col("text"), F.col("y0"), F.col("height")))
    return b.select(*ID, title.alias("heading")).where("heading IS NOT NULL")


def poetic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents tested as verse; odd ones with a line end after each comma and full stop, so that some are."""
    lines = lambda mark: lambda t: F.replace(t, F.lit(f"{mark} "), F.lit(f"{mark}\n"))
    text = F.when(F.col("doc_id") % 2 == 1, lines(",")(lines(".")(F.col("text")))).otherwise(F.col("text"))
    return fixtures.documents(spark, sf_dir).select("doc_id", layout.looks_poetic(text).alias("poetic"))


def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank pages with the image that stands at their place."""
    flags = layout.analyse(fixtures.blocks(spark, sf_dir), fixtures.book_pages(spark, sf_dir))[1]
    images = fixtures.book_pages(spark, sf_dir).select("book_id", (F.col("page_number") - 1).alias("place"), F.concat(F.lit("rendered_"), F.format_string("%05d", "page_number"), F.lit(".png")).alias("image"))
    return flags.where("is_blank").join(images.withColumn("page_number", F.col("place") + 1), ["book_id", "page_number"]).select("book_id", "page_number", "image")


def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a document with made-up confidences, some of them not numbers, joined as a recogniser's word table."""
    w = F.split("text", "[ \n]+")
    conf = F.transform(w, lambda x, i: F.when(i % 7 == 3, "n/a").when(i % 5 == 4, "-1").otherwise((F.char_length(x) * 10).cast("string")))
    d = fixtures.documents(spark, sf_dir).select("doc_id", ocr.join_words(w, conf).alias("r"))
    return d.select("doc_id", "r.text", F.round(F.col("r.confidence"), 6).alias("confidence"))


def engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best recogniser of hosts, one for each customer key pattern."""
    offers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("host"), F.explode(F.array(*[F.lit(e) for e in ocr.PREFERENCE])).alias("engine"))
    place = F.array_position(F.array(*[F.lit(e) for e in ocr.PREFERENCE]), F.col("engine"))
    offers = offers.withColumn("available", F.floor(F.col("host") / F.pow(F.lit(2), place - 1)) % 2 == 1)
    return ocr.best_engines(offers).withColumn("host", F.col("host").cast("long"))


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelake.operators.cache import source_hash

    return fixtures.documents(spark, sf_dir).select("doc_id", source_hash(F.col("text")).alias("sha256"))


def stripped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stripped lines with their number: grouped counts over stripped text."""
    lines = fixtures.documents(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(strip(F.col("line")).alias("line")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (block_scan, span_lines, sidecar_pages, page_numbers, roles, repeated_headers, header_removal, columns, blank_pages, needs_ocr, headings, poetic_blocks, page_images, ocr_confidence, engine_choice, content_hash, stripped_lines)}

BLANK_SQL = f"""{KEPT_SQL}, {LAYOUT_SQL}, flags AS (
  SELECT p.book_id, p.page_number, l.layout, NOT EXISTS (SELECT 1 FROM kept k WHERE k.book_id = p.book_id AND k.page_number = p.page_number) AS is_blank
  FROM pages0 p JOIN layouts l USING (book_id, page_number))"""

ORACLES = {
    "block_scan": "SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)",
    "span_lines": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: replace(x, ' ', '')), lambda x: NOT regexp_full_match(x, '\s*')) AS lines,
        list_transform(string_split_regex(text, '[ \n]'), lambda w: length(w)) AS n FROM documents WHERE doc_id % 10 <> 9)
      SELECT CAST(doc_id AS VARCHAR) AS book_id, regexp_replace(array_to_string(lines, chr(10)), '^\s+|\s+$', '', 'g') AS text, len(list_filter(n, lambda k: k % 7 = 0)) > 0 AS bold,
             len(list_filter(n, lambda k: k % 7 <> 0 AND k % 11 = 0)) > 0 AS italic FROM l WHERE len(lines) > 0""",
    "sidecar_pages": r"""WITH p AS (SELECT doc_id, string_split(' ' || chr(12) || replace(text, '.' || chr(10), '.' || chr(12)), chr(12)) AS pages FROM documents),
      e AS (SELECT doc_id, pages, unnest(generate_series(1, len(pages))) AS page_number FROM p)
      SELECT doc_id, page_number, pages[page_number] AS text FROM e WHERE NOT regexp_full_match(pages[page_number], '\s*')""",
    "page_numbers": f"WITH {BLOCKS_SQL} SELECT book_id, page_number, block_no, text FROM blocks WHERE {IS_PAGE_NUMBER}",
    "roles": f"WITH {BLOCKS_SQL} SELECT book_id, page_number, block_no, {ROLE} AS role FROM blocks",
    "repeated_headers": f"WITH {KEPT_SQL} SELECT book_id, header, n FROM repeated",
    "header_removal": f"WITH {KEPT_SQL} SELECT book_id, page_number, block_no, text FROM kept",
    "columns": f"WITH {BLOCKS_SQL}, {LAYOUT_SQL} SELECT book_id, page_number, layout FROM layouts",
    "blank_pages": f"WITH {BLANK_SQL} SELECT book_id, page_number, layout, is_blank FROM flags",
    "needs_ocr": f"WITH {BLANK_SQL} SELECT b.book_id, coalesce(bool_or(is_blank), true) AS needs_ocr FROM (SELECT DISTINCT source AS book_id FROM documents UNION ALL SELECT 'no pages') b LEFT JOIN (SELECT * FROM flags WHERE NOT (is_blank AND length(book_id) = 4)) f ON f.book_id = b.book_id GROUP BY 1",
    "headings": f"""WITH {BLOCKS_SQL}, r AS (SELECT *, {ROLE} AS role, string_split({STRIP.format("text")}, chr(10))[1] AS first FROM blocks)
      SELECT book_id, page_number, block_no, first AS heading FROM r WHERE role = 'heading' OR length(first) <= 80 AND regexp_matches(lower(first), '^(bölüm|chapter|kısım)')""",
    "poetic_blocks": r"""WITH l AS (SELECT doc_id, list_filter(string_split(CASE WHEN doc_id % 2 = 1 THEN replace(replace(text, '. ', '.' || chr(10)), ', ', ',' || chr(10)) ELSE text END, chr(10)), lambda x: NOT regexp_full_match(x, '\s*')) AS lines FROM documents)
      SELECT doc_id, len(lines) >= 3 AND len(list_filter(lines, lambda x: length(x) <= 42)) / len(lines) > 0.7 AS poetic FROM l""",
    "page_images": f"WITH {BLANK_SQL} SELECT book_id, page_number, 'rendered_' || lpad(CAST(page_number AS VARCHAR), 5, '0') || '.png' AS image FROM flags WHERE is_blank",
    "ocr_confidence": r"""WITH w AS (SELECT doc_id, string_split_regex(text, '[ \n]+') AS w FROM documents),
      e AS (SELECT doc_id, i, w[i] AS word, CASE WHEN (i - 1) % 7 = 3 OR (i - 1) % 5 = 4 THEN NULL ELSE length(w[i]) * 10 END AS c FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w))
      SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE word <> ''), '') AS text, round(coalesce(avg(c / 100.0) FILTER (WHERE word <> ''), 0), 6) AS confidence FROM e GROUP BY doc_id""",
    "engine_choice": """SELECT CAST(c_custkey AS BIGINT) AS host, CASE WHEN c_custkey % 2 = 1 THEN 'ocrmypdf' WHEN c_custkey // 2 % 2 = 1 THEN 'paddleocr' WHEN c_custkey // 4 % 2 = 1 THEN 'tesseract' ELSE 'easyocr' END AS engine
      FROM customer WHERE c_custkey % 16 <> 0""",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "stripped_lines": r"SELECT regexp_replace(line, '^\s+|\s+$', '', 'g') AS line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
}
