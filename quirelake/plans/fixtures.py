"""Deterministic inputs derived from ``documents``: damaged texts, and books of positioned blocks.

Each has an SQL statement that DuckDB runs to the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.ranges import running

HEIGHT, WIDTH = 840, 600
#: Document numbers in a range of a book's pages.
DOCUMENTS = 8192
#: What kind 7 puts after a sentence.
BROKEN_TURKISH = ". © Bug ün i çin k itap\tdegil ol du "


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files make fewer tasks than there are cores; larger inputs are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def damage(doc_id: Column, t: Column) -> Column:
    """One of nine kinds of damage of a document's text by doc_id % 9, made by literal replacements."""
    kind = doc_id % 9
    put = lambda text, old, new: F.replace(text, F.lit(old), F.lit(new))
    kinds = [put(t, " ", "  "), put(t, "er", "e-\nr"), put(t, ", ", " ,"), put(t, ". ", "."), put(t, "\n", "\n\n\n"), F.concat(t, F.lit(" 15")), put(put(t, " the ", " “ the ” "), "tion", "tTon"), put(t, ". ", BROKEN_TURKISH), put(t, "\n", "\n- ")]
    text = kinds[-1]
    for k, c in reversed(list(enumerate(kinds[:-1]))):
        text = F.when(kind == k, c).otherwise(text)
    return text


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, kind, text``: every document with its kind of :func:`damage`."""
    return documents(spark, sf_dir).select("doc_id", (F.col("doc_id") % 9).alias("kind"), damage(F.col("doc_id"), F.col("text")).alias("text"))


DAMAGED_SQL = """damaged AS (
  SELECT doc_id, doc_id % 9 AS kind, CASE doc_id % 9
    WHEN 0 THEN replace(text, ' ', '  ') WHEN 1 THEN replace(text, 'er', 'e-' || chr(10) || 'r') WHEN 2 THEN replace(text, ', ', ' ,')
    WHEN 3 THEN replace(text, '. ', '.') WHEN 4 THEN replace(text, chr(10), chr(10) || chr(10) || chr(10)) WHEN 5 THEN text || ' 15'
    WHEN 6 THEN replace(replace(text, ' the ', ' “ the ” '), 'tion', 'tTon')
    WHEN 7 THEN replace(text, '. ', '. © Bug ün i çin k itap' || chr(9) || 'degil ol du ')
    ELSE replace(text, chr(10), chr(10) || '- ') END AS text
  FROM documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, page_number, width, height, doc_id, text``: a book for each source, a page for each document."""
    d = documents(spark, sf_dir).select(F.col("source").alias("book_id"), "doc_id", "text")
    numbered = running(d, "book_id", "doc_id", F.lit(1), "_before", span=DOCUMENTS)
    return numbered.select("book_id", (F.col("_before") + 1).alias("page_number"), F.lit(WIDTH).cast("long").alias("width"), F.lit(HEIGHT).cast("long").alias("height"), "doc_id", "text")


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`pages`, after every nine of them one page more that has neither document nor text, so that every tenth page of a book is blank."""
    page = lambda number, doc, text: F.struct(number.alias("page_number"), doc.alias("doc_id"), text.alias("text"))
    number = F.col("page_number") + F.floor((F.col("page_number") - 1) / 9)
    own, blank = page(number, F.col("doc_id"), F.col("text")), page(number + 1, F.lit(None).cast("long"), F.lit(None).cast("string"))
    both = F.when(F.col("page_number") % 9 == 0, F.array(own, blank)).otherwise(F.array(own))
    return pages(spark, sf_dir).select("book_id", "width", "height", F.explode(both).alias("p")).select("book_id", "p.page_number", "width", "height", "p.doc_id", "p.text")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, page_number, block_no, text, x0, y0, x1, y1``: lines as blocks with running headers, page numbers, chapter heads, tables and notes put in.

    One pass: a page makes an array of its blocks, which is then spread into rows. Pages are
    dealt out by book and number first, so that a book with most of the pages isn't one task.
    """
    page, doc = F.col("page_number"), F.col("doc_id")
    base = book_pages(spark, sf_dir).repartition("book_id", "page_number").withColumn("lines", F.coalesce(F.split("text", "\n"), F.array().cast("array<string>")))
    n = F.size("lines").cast("long")
    long = lambda v: v.cast("long") if isinstance(v, Column) else F.lit(v).cast("long")
    block = lambda no, text, x0, y0, x1, y1: F.struct(long(no).alias("block_no"), text.alias("text"), *[long(v).alias(k) for k, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))])
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    full, two = page % 10 != 0, F.coalesce(doc % 5 == 0, F.lit(False))
    down = lambda k: F.floor(k * 480 / n)
    line = lambda x, k: block(k + 2, x, F.when(two & (k % 2 == 1), 330).otherwise(30), down(k) + 160, F.when(two & (k % 2 == 0), 270).otherwise(570), down(k + 1) + 160)
    fixed = (
        (F.lit(True), block(0, text("Journal ", F.col("book_id"), " - ", page), 200, 10, 400, 40)),
        (page % 10 == 1, block(1, text("Chapter ", F.floor(page / 10) + 1), 200, 120, 400, 150)),
        (full & (page % 6 == 0), block(9000, text("left\tright\t", page), 30, 645, 570, 650)),
        (full & (page % 4 == 0), block(9001, text("Note ", page, " see text"), 30, 700, 570, 720)),
        (F.lit(True), block(9999, text("- ", page, " -"), 290, 800, 310, 820)),
    )
    put_in = F.filter(F.array(*[F.when(wanted, b) for wanted, b in fixed]), lambda b: b.isNotNull())
    every = F.concat(put_in, F.transform("lines", line))
    return base.select("book_id", "page_number", F.explode(every).alias("b")).select("book_id", "page_number", "b.*")


def sized_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).withColumns({"width": F.lit(WIDTH).cast("long"), "height": F.lit(HEIGHT).cast("long")})


BLOCKS_SQL = """docs0 AS (
  SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, doc_id, string_split(text, chr(10)) AS lines FROM documents
), pages0 AS (
  SELECT book_id, k + (k - 1) // 9 AS page_number, doc_id, lines FROM docs0 UNION ALL SELECT book_id, k + (k - 1) // 9 + 1, NULL, [] FROM docs0 WHERE k % 9 = 0
), lines0 AS (
  SELECT *, unnest(generate_series(1, len(lines))) AS i, len(lines) AS n FROM pages0
), blocks AS (
  SELECT book_id, page_number, i + 1 AS block_no, lines[i] AS text, CASE WHEN doc_id % 5 = 0 AND i % 2 = 0 THEN 330 ELSE 30 END AS x0,
         (i - 1) * 480 // n + 160 AS y0, CASE WHEN doc_id % 5 = 0 AND i % 2 = 1 THEN 270 ELSE 570 END AS x1, i * 480 // n + 160 AS y1 FROM lines0
  UNION ALL SELECT book_id, page_number, 0, 'Journal ' || book_id || ' - ' || page_number, 200, 10, 400, 40 FROM pages0
  UNION ALL SELECT book_id, page_number, 1, 'Chapter ' || (page_number // 10 + 1), 200, 120, 400, 150 FROM pages0 WHERE page_number % 10 = 1
  UNION ALL SELECT book_id, page_number, 9000, 'left' || chr(9) || 'right' || chr(9) || page_number, 30, 645, 570, 650 FROM pages0 WHERE page_number % 6 = 0 AND page_number % 10 <> 0
  UNION ALL SELECT book_id, page_number, 9001, 'Note ' || page_number || ' see text', 30, 700, 570, 720 FROM pages0 WHERE page_number % 4 = 0 AND page_number % 10 <> 0
  UNION ALL SELECT book_id, page_number, 9999, '- ' || page_number || ' -', 290, 800, 310, 820 FROM pages0
)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``book_id, title, author, language``: one for each source."""
    ids = documents(spark, sf_dir).select(F.col("source").alias("book_id")).distinct()
    return ids.select("book_id", F.concat(F.lit("Book <"), F.col("book_id"), F.lit("> & more")).alias("title"), F.concat(F.lit('The "'), F.col("book_id"), F.lit('" authors')).alias("author"), F.lit("en").alias("language"))


BOOKS_SQL = """books AS (
  SELECT DISTINCT source AS book_id, 'Book <' || source || '> & more' AS title, 'The "' || source || '" authors' AS author, 'en' AS language FROM documents)"""


def conversation_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: user turns are headings, the others body blocks; book_id is the conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select(F.col("conv_id").cast("string").alias("book_id"), F.lit(1).cast("long").alias("page_number"), F.col("turn").alias("block_no"), "text", F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("role"))


def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, rules, answer``: whole damaged texts on one line with a made-up model answer of one of eight kinds by doc_id % 8.

    0 the same, 1 half of it, 2 twice, 3 without quotes, 4 a capital inside a word, 5 fenced,
    6 a new word, 7 no answer.
    """
    d = damaged(spark, sf_dir)
    text = F.concat(F.lit("“"), F.rtrim(F.replace("text", F.lit("\n"), F.lit(" "))), F.lit("”"))
    k, t = F.col("doc_id") % 8, F.col("rules")
    marked = F.translate(t, "“”", "")
    answer = (
        F.when(k == 0, marked).when(k == 1, F.substr(marked, F.lit(1), F.floor(F.char_length(marked) / 2).cast("int"))).when(k == 2, F.concat(marked, F.lit(" "), F.translate(marked, "", ""))).when(k == 3, F.translate(marked, "", ""))
        .when(k == 4, F.concat(marked, F.lit(" aB"))).when(k == 5, F.concat(F.lit("```text\n"), marked, F.lit("\n```"))).when(k == 6, F.concat(marked, F.lit(" zzyzx")))
    )
    return d.select("doc_id", text.alias("rules")).select(F.col("doc_id").alias("key"), "rules", answer.alias("answer"))


MODEL_PAIRS_SQL = f"""{DAMAGED_SQL}, rules0 AS (
  SELECT doc_id AS key, '“' || rtrim(replace(text, chr(10), ' '), ' ') || '”' AS rules FROM damaged
), marked0 AS (
  SELECT key, rules, replace(replace(rules, '“', chr(57344)), '”', chr(57345)) AS m FROM rules0
), pairs AS (
  SELECT key, rules, CASE key % 8 WHEN 0 THEN m WHEN 1 THEN substr(m, 1, length(m) // 2) WHEN 2 THEN m || ' ' || replace(replace(m, chr(57344), ''), chr(57345), '')
    WHEN 3 THEN replace(replace(m, chr(57344), ''), chr(57345), '') WHEN 4 THEN m || ' aB' WHEN 5 THEN '```text' || chr(10) || m || chr(10) || '```'
    WHEN 6 THEN m || ' zzyzx' END AS answer
  FROM marked0)"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word, n``: folded words of all documents; stands in for a table of word frequencies."""
    from quirelake.functions.guards import letter_words

    words = documents(spark, sf_dir).select(F.explode(letter_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))
