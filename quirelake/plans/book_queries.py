"""Queries of guards, checkpoint reuse, chapters and book markup, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.functions import guards
from quirelake.functions.repair import repair
from quirelake.functions.text import count_of, html_escape, mime_type, settle
from quirelake.operators import cache, chapters, layout, render
from quirelake.plans import fixtures
from quirelake.plans.fixtures import BLOCKS_SQL, BOOKS_SQL, DAMAGED_SQL, MODEL_PAIRS_SQL
from quirelake.plans.layout_queries import KEPT_SQL, ROLE, STRIP
from quirelake.plans.repair_queries import r1_sql, r2_sql, r3_sql, r4_sql, r5_sql, r6_sql, r7_sql, r8_sql
from quirelake.sinks.archive import archive_digests

# --- guards ----------------------------------------------------------------------------


def style_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes as tokens, and back where the answer has as many of each."""
    p = fixtures.model_pairs(spark, sf_dir)
    protected = guards.protect_quotes(F.col("rules"))
    return p.select("key", count_of(protected, guards.TOKENS[0]).alias("opening"), guards.restore_quotes(protected, F.col("answer")).alias("restored"))


def clean_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole damaged texts as answers with fences and think elements in every order."""
    nl = F.lit("\n")
    t, k = F.col("text"), F.col("doc_id") % 5
    answer = (
        F.when(k == 0, F.concat(F.lit("  ```text\n"), t, F.lit("\n``` ")))
        .when(k == 1, F.concat(F.lit("<think>a\nb</think>\n"), t))
        .when(k == 2, F.concat(F.lit("```\n<think>x</think> "), t, nl, F.lit("```")))
        .when(k == 3, F.concat(F.lit("<think>x</think>```\n"), t))
        .otherwise(t)
    )
    return fixtures.damaged(spark, sf_dir).select("doc_id", guards.clean_output(answer).alias("clean"))


def cheap_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, quotation and case guards of each answer."""
    p = fixtures.model_pairs(spark, sf_dir).where("answer IS NOT NULL")
    a = F.translate("answer", guards.TOKENS, guards.QUOTES)
    return p.select("key", guards.length_ok(F.col("rules"), a).alias("length_ok"), guards.quotes_ok(F.col("rules"), a).alias("quotes_ok"), guards.case_ok(a).alias("case_ok"))


def new_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that an answer has more often than its source."""
    return guards.new_words(fixtures.model_pairs(spark, sf_dir), "key", "rules", "answer")


def vocabulary_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fixtures.model_pairs(spark, sf_dir)
    return guards.unknown_words(p, fixtures.lexicon(spark, sf_dir), "key", "rules", "answer")


def similarity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of the standard library's matcher, which SQL can't express."""
    p = fixtures.model_pairs(spark, sf_dir).where("answer IS NOT NULL")
    return p.select("key", F.round(guards.similarity(F.col("rules"), F.col("answer")), 9).alias("ratio"))


def guard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that stands for each pair and why its answer was refused."""
    return guards.decide(fixtures.model_pairs(spark, sf_dir), fixtures.lexicon(spark, sf_dir))


def word_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset of words of each language."""
    words = fixtures.documents(spark, sf_dir).select("lang", F.explode(guards.letter_words(F.col("text"))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


# --- checkpoint ------------------------------------------------------------------------

CURRENT = "current"


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages of all books but every seventh; odd ones have an old signature, every fifth no blocks, every eleventh isn't complete."""
    p = fixtures.pages(spark, sf_dir).where("page_number % 7 <> 0")
    n = F.col("page_number")
    p = p.withColumn("raw", fixtures.damage(F.col("doc_id"), F.col("text")))
    part = lambda text, role: F.struct(text.alias("text"), F.lit(role).cast("string").alias("role"), (n % 3 == 0).alias("bold"), F.lit(None).cast("boolean").alias("italic"))
    none = F.array().cast("array<struct<text:string,role:string,bold:boolean,italic:boolean>>")
    blocks = lambda text: F.when(n % 5 == 0, none).otherwise(F.array(part(text, None), part(F.lit("A  B\nC"), "table")))
    return p.select(F.col("book_id").alias("source_hash"), "page_number", F.col("raw").alias("raw_text"), F.concat("text", F.lit(" stored")).alias("repaired_text"), F.lit("single-column").alias("layout"), blocks(F.lower("text")).alias("blocks"), blocks(F.col("raw")).alias("raw_blocks"), F.when(n % 2 == 1, "old").otherwise(CURRENT).alias("repair_signature"), (n % 11 != 0).alias("complete"))


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is taken from the checkpoint, repaired again or missing, with the first block's text and flags."""
    pages = fixtures.pages(spark, sf_dir).select(F.col("book_id").alias("source_hash"), "page_number")
    r = cache.reuse(pages, checkpoint(spark, sf_dir), CURRENT)
    first = F.try_element_at("blocks", F.lit(1))
    return r.select("source_hash", "page_number", "action", F.coalesce(F.size("blocks"), F.lit(0)).cast("long").alias("n_blocks"), first["text"].alias("text"), first["role"].alias("role"), first["bold"].alias("bold"), first["italic"].alias("italic"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures of the settings that each customer's row makes: some have no key, names have quotes and letters beyond ASCII."""
    c, key = spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("c_custkey")
    settings = F.struct(
        F.element_at(F.array(F.lit("rule"), F.lit("ollama")), (key % 2 + 1).cast("int")).alias("provider"), F.when(key % 3 == 0, F.concat(F.lit('k"'), F.col("c_nationkey").cast("string"))).alias("api_key"),
        F.concat(F.lit("ü "), F.col("c_name")).alias("model"), (key % 600).cast("long").alias("timeout_seconds"),
    )
    return c.select(key.cast("long").alias("c_custkey"), cache.signature_of(settings).alias("signature"))


def state_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and characters in each book's state document, written as JSON in parts and read back page by page."""
    from quirelake.sources.state import pages_of_parts, state_parts

    rows = pages_of_parts(state_parts(checkpoint(spark, sf_dir)))
    return rows.groupBy("source_hash").agg(F.count("*").alias("pages"), F.sum(F.char_length("raw_text")).alias("raw_chars"), F.count_if("complete").alias("complete"))


# --- chapters and markup ---------------------------------------------------------------


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = fixtures.sized_blocks(spark, sf_dir)
    kept = layout.drop_headers(sized, layout.repeated_margins(sized, fixtures.book_pages(spark, sf_dir)))
    return kept.withColumn("role", layout.block_role(F.col("text"), F.col("y0"), F.col("height"))).select("book_id", "page_number", "block_no", "text", "role", (F.col("block_no") % 10 == 3).alias("bold"), (F.col("block_no") % 10 == 4).alias("italic"))


def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of contents: chapters of every book with their blocks and characters after repair."""
    b = _roles(spark, sf_dir)
    repaired = settle(b, "text", repair(F.col("text"), F.col("role") == "table"))
    made = chapters.chapters(repaired, fixtures.books(spark, sf_dir))
    return made.select("book_id", F.col("chapter_no").cast("long").alias("chapter_no"), "title", "n_blocks", "n_chars")


def chapter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body blocks with their chapters, unrepaired."""
    b = chapters.titled_blocks(_roles(spark, sf_dir), fixtures.books(spark, sf_dir))
    return b.select("book_id", "page_number", "block_no", F.col("chapter_no").cast("long").alias("chapter_no"), "chapter_title")


def conversation_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with user turns as headings: leading bodies, headings in a row and trailing headings."""
    b = fixtures.conversation_blocks(spark, sf_dir)
    books = b.select("book_id").distinct().select("book_id", F.concat(F.lit("Talk "), F.col("book_id")).alias("title"))
    return chapters.chapters(b, books).select("book_id", F.col("chapter_no").cast("long").alias("chapter_no"), "title", "n_blocks", "n_chars")


def image_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fixtures.pages(spark, sf_dir).select("book_id", F.col("page_number").alias("chapter_no"), (F.col("doc_id") % 4).alias("n_images"))
    return chapters.image_offsets(counts)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = chapters.progress(fixtures.pages(spark, sf_dir))
    return p.select("book_id", "page_number", F.col("percent").cast("long").alias("percent"), F.col("step").cast("long").alias("step"))


def page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a page joined in order by line ends and by blank lines."""
    item = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    text = lambda sep: F.array_join(F.transform(item, lambda x: x["text"]), sep)
    return fixtures.blocks(spark, sf_dir).groupBy("book_id", "page_number").agg(text("\n").alias("raw"), text("\n\n").alias("spaced"))


def block_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup of whole documents and of kept blocks: roles, bold and italic, verse, strong and emphasis."""
    d = fixtures.documents(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("book_id"), F.lit(0).cast("long").alias("page_number"), F.lit(0).cast("long").alias("block_no"), F.replace("text", F.lit(" the "), F.lit(" _the_ ")).alias("text"), F.lit("paragraph").alias("role"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))
    b = _roles(spark, sf_dir).unionByName(d)
    return b.select("book_id", "page_number", "block_no", render.block_html(F.col("text"), F.col("role"), F.col("bold"), F.col("italic")).alias("html"))


def chapter_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = chapters.titled_blocks(_roles(spark, sf_dir), fixtures.books(spark, sf_dir))
    return render.chapter_pages(render.chapter_bodies(body)).select("book_id", "name", "content")


def _toc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.chapters(_roles(spark, sf_dir), fixtures.books(spark, sf_dir))


def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.navigation(_toc_rows(spark, sf_dir), fixtures.books(spark, sf_dir))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture from every document of each book."""
    kinds = F.array(*[F.lit(x) for x in ("a.png", "b.JPG", "c.gif", "d", "e.svg")])
    p = fixtures.pages(spark, sf_dir)
    return p.select("book_id", F.col("page_number").cast("int").alias("image_no"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("path"), F.lit(None).cast("string").alias("media_type"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = render.manifest_items(_toc_rows(spark, sf_dir), _pictures(spark, sf_dir), _pictures(spark, sf_dir).where("image_no = 1"))
    return m.select("book_id", F.col("kind").cast("long").alias("kind"), F.col("n").cast("long").alias("n"), "item_id", "href", "media_type", "properties")


def package_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = fixtures.books(spark, sf_dir)
    return render.package(render.manifest_items(_toc_rows(spark, sf_dir)), books)


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pictures(spark, sf_dir).select("book_id", F.col("image_no").cast("long").alias("image_no"), mime_type(F.col("path")).alias("media_type"))


def required_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that lack some entries by the number of their book's pages."""
    have = F.filter(F.array(*[F.lit(x) for x in render.REQUIRED_FILES]), lambda x, i: F.col("k") % (i + 2) != 0)
    p = fixtures.pages(spark, sf_dir).select("book_id", F.col("doc_id").alias("k"))
    m = render.missing_files(p.select(F.col("k").alias("book_id"), have.alias("names")))
    return m.select(F.col("book_id").alias("doc_id"), F.array_join("missing", ",").alias("missing"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", html_escape(F.col("html")).alias("html"))


def book_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every book built as an archive, checked and read back: size, digest of the entries in order, their number and error."""
    books = fixtures.books(spark, sf_dir)
    return archive_digests(render.book_files(books, chapters.titled_blocks(_roles(spark, sf_dir), books)))


def illustrated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of every book that shows a figure from each of its documents and has a cover: place, name, size and digest."""
    books, kinds = fixtures.books(spark, sf_dir), F.array(*[F.lit(x) for x in ("a.png", "b.JPG", "c.gif", "d", "e.svg")])
    blocks = durable(chapters.titled_blocks(_roles(spark, sf_dir), books))  # chapters, markup and figures are made from them
    d = F.col("doc_id")
    drawn = fixtures.book_pages(spark, sf_dir).where("doc_id IS NOT NULL").select(
        "book_id", "page_number", F.lit(1).alias("figure_no"), F.element_at(kinds, (d % 5 + 1).cast("int")).alias("path"), F.concat(F.lit('"'), d.cast("string"), F.lit('" & more')).alias("alt"),
        F.when(d % 2 == 0, "image/x-made").alias("media_type"), F.col("text").cast("binary").alias("content"),
    )
    covers = books.select("book_id", F.lit("front.jpg").alias("path"), F.col("title").cast("binary").alias("content"))
    files = render.book_files(books, blocks, images=render.placed_figures(drawn, blocks), covers=covers)
    return files.select("book_id", "place", "name", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        style_tokens, clean_answers, cheap_guards, new_words, vocabulary_guard, similarity_guard, guard_decision, word_bags, cache_reuse, signatures, state_documents, toc, chapter_split, conversation_chapters,
        image_offset, progress, page_join, block_markup, chapter_markup, navigation, manifest, package_file, media_types, required_files, escaped, book_archives, illustrated_files,
    )
}

# --- SQL -------------------------------------------------------------------------------

_esc = lambda c: f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_count = lambda c, q: f"(length({c}) - length(replace({c}, {q}, '')))"
_back = lambda c: f"replace(replace({c}, chr(57344), '“'), chr(57345), '”')"
_WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
_letters = lambda c: f"list_transform(regexp_extract_all({c}, '\\p{{L}}+'), lambda w: replace(lower(w), 'ß', 'ss'))"
RESTORED = f"CASE WHEN {_count('rules', repr('“'))} = {_count('answer', 'chr(57344)')} AND {_count('rules', repr('”'))} = {_count('answer', 'chr(57345)')} THEN {_back('answer')} END"
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', ''), '(?i)^```(?:text|plaintext)?\s*', ''), '\s*```$', ''), '(?s)^<think>.*?</think>\s*', ''), '^\s+|\s+$', '', 'g')"
NEW_WORDS = f"""{MODEL_PAIRS_SQL}, bag AS (
  SELECT key, word, sum(n) AS extra FROM (SELECT key, unnest({_letters('answer')}) AS word, 1 AS n FROM pairs WHERE answer IS NOT NULL UNION ALL SELECT key, unnest({_letters('rules')}), -1 FROM pairs) GROUP BY ALL
), fresh AS (SELECT key, word, CAST(extra AS BIGINT) AS extra FROM bag WHERE extra > 0 AND length(word) >= 3)"""
LEXICON = f"lexicon AS (SELECT DISTINCT word FROM (SELECT unnest({_letters('text')}) AS word FROM documents))"
ROLES_SQL = f"{KEPT_SQL}, {BOOKS_SQL}, roled AS (SELECT book_id, page_number, block_no, text, {ROLE} AS role, block_no % 10 = 3 AS bold, block_no % 10 = 4 AS italic FROM kept)"
# A book's blocks in order: running number of headings, the title of the last one, and chapters by the numbers that have a body.
CHAPTERED = """headed AS (
  SELECT *, CASE WHEN role = 'heading' OR length(first) <= 80 AND regexp_matches(lower(first), '^(bölüm|chapter|kısım)') THEN first END AS heading
  FROM (SELECT *, string_split({strip}, chr(10))[1] AS first FROM {rows} WHERE NOT regexp_full_match(text, '\\s*'))
), parts AS (
  SELECT *, count(heading) OVER w AS segment, last_value(heading IGNORE NULLS) OVER w AS opened FROM headed WINDOW w AS (PARTITION BY book_id ORDER BY page_number, block_no ROWS UNBOUNDED PRECEDING)
), body AS (
  SELECT p.*, coalesce(opened, title) AS chapter_title, dense_rank() OVER (PARTITION BY p.book_id ORDER BY segment) AS chapter_no FROM parts p JOIN books b ON b.book_id = p.book_id WHERE heading IS NULL
), chapters AS (
  SELECT book_id, chapter_no, any_value(chapter_title) AS title, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM body GROUP BY book_id, chapter_no
  UNION ALL SELECT book_id, 1, title, 0, 0 FROM books WHERE book_id NOT IN (SELECT book_id FROM body)
)"""
_chaptered = lambda rows: CHAPTERED.format(rows=rows, strip=STRIP.format("text"))
_CHAIN = (r1_sql, r2_sql, r3_sql, r4_sql, r5_sql, r6_sql, r7_sql, r8_sql, r4_sql)
_SP = r"[\t-\r\x1c- \x85\xa0]"
BLANKS = rf"regexp_replace(replace(text, chr(160), ' '), '[ \t]{{2,}}', ' ', 'g')"


def _repaired(rows: str) -> str:
    """The rules as CTEs over the columns of ``rows``; tables keep their line ends."""
    out, last = [], rows
    for k, rule in enumerate(_CHAIN):
        text = f"CASE WHEN role = 'table' THEN {BLANKS} ELSE {rule('text')} END" if rule is r4_sql else rule("text")
        out.append(f"fix{k} AS MATERIALIZED (SELECT * REPLACE ({text} AS text) FROM {last})")
        last = f"fix{k}"
    out.append(f"fixed AS (SELECT * REPLACE (regexp_replace(regexp_replace(text, '^{_SP}+', ''), '{_SP}+$', '') AS text) FROM {last})")
    return ", ".join(out)


_MARKUP = f"replace(regexp_replace(regexp_replace({_esc('text')}, '\\*\\*([^\\n]+?)\\*\\*', '<strong>\\1</strong>', 'g'), '_([^\\n]+?)_', '<em>\\1</em>', 'g'), chr(10), '<br/>')"
_POETIC = "(len(vl) >= 3 AND len(list_filter(vl, lambda x: length(x) <= 42)) / len(vl) > 0.7)"
HTML = f"""(SELECT CASE WHEN role = 'heading' THEN '<h2>' || h || '</h2>' WHEN role = 'footnote' THEN '<p class="footnote">' || h || '</p>' WHEN {_POETIC} THEN '<p class="poetry">' || h || '</p>' ELSE '<p>' || h || '</p>' END
  FROM (SELECT CASE WHEN italic THEN '<em>' || s || '</em>' ELSE s END AS h, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_full_match(x, '\\s*')) AS vl FROM (SELECT CASE WHEN bold THEN '<strong>' || m || '</strong>' ELSE m END AS s FROM (SELECT {_MARKUP} AS m))))"""
_no = lambda c: f"lpad(CAST({c} AS VARCHAR), CAST(greatest(4, length(CAST({c} AS VARCHAR))) AS INTEGER), '0')"


def _page(title: str, body: str, attributes: str, css: str, language: str = _esc("language")) -> str:
    return f"""{_q(render.HEAD)} || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="' || {language} || '">' || chr(10) || '<head>' || chr(10) || '  <title>' || {_esc(title)}
      || '</title>' || chr(10) || '  <link rel="stylesheet" type="text/css" href="{css}"/>' || chr(10) || '</head>' || chr(10) || '<body' || {attributes} || '>' || chr(10) || {body} || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)"""


CHAPTER_NAME = f"'chapter-' || {_no('chapter_no')}"
PICTURES = "pictures AS (SELECT book_id, k AS image_no, ['a.png', 'b.JPG', 'c.gif', 'd', 'e.svg'][doc_id % 5 + 1] AS path FROM docs0)"
MIME = "CASE WHEN lower(path) LIKE '%.jpg' THEN 'image/jpeg' WHEN path LIKE '%.gif' THEN 'image/gif' WHEN path LIKE '%.svg' THEN 'image/svg+xml' ELSE 'image/png' END"
SUFFIX = "CASE WHEN contains(path, '.') THEN '.' || string_split(path, '.')[2] ELSE '' END"
ITEMS = f"""items AS (
  SELECT book_id, CAST(0 AS BIGINT) AS kind, CAST(0 AS BIGINT) AS n, 'nav' AS item_id, 'nav.xhtml' AS href, 'application/xhtml+xml' AS media_type, 'nav' AS properties FROM books
  UNION ALL SELECT book_id, 0, 1, 'css', 'styles/book.css', 'text/css', NULL FROM books
  UNION ALL SELECT book_id, 1, chapter_no, {CHAPTER_NAME}, 'text/' || {CHAPTER_NAME} || '.xhtml', 'application/xhtml+xml', NULL FROM chapters)"""
ID_HASH = "sha256(book_id || chr(31) || title || chr(31) || author)"
CHECKPOINT = f"""{DAMAGED_SQL}, pg AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id, text FROM documents),
  ck AS (SELECT book_id, n, d.text AS raw, pg.text AS text, n % 2 = 0 AS same FROM pg JOIN damaged d USING (doc_id) WHERE n % 7 <> 0)"""

#: What SQL can say of the ratio: an answer that goes on after the whole source.
DECIDED = f"""{NEW_WORDS}, {LEXICON}, judged AS (
  SELECT key, rules, answer, {RESTORED} AS restored FROM pairs
), cleaned AS (
  SELECT *, {CLEAN.format("restored")} AS c FROM judged
), unknown AS (
  SELECT DISTINCT key FROM (SELECT key, word, sum(n) AS extra FROM (SELECT key, unnest({_letters("c")}) AS word, 1 AS n FROM cleaned WHERE c IS NOT NULL UNION ALL SELECT key, unnest({_letters("rules")}), -1 FROM cleaned) GROUP BY ALL)
  WHERE extra > 0 AND length(word) >= 3 AND word NOT IN (SELECT word FROM lexicon)
), decided AS (
  SELECT key, rules, c, CASE WHEN answer IS NULL THEN 'unavailable' WHEN restored IS NULL THEN 'tokens' WHEN c = '' THEN 'empty' WHEN NOT {_WORDS.format("c")} / greatest(1, {_WORDS.format("rules")}) BETWEEN 0.65 AND 1.45 THEN 'length'
    WHEN starts_with(c, rules) AND 2 * length(rules) / (length(rules) + length(c)) < 0.72 THEN 'similarity' WHEN {_count('rules', repr('“'))} <> {_count('c', repr('“'))} OR {_count('rules', repr('”'))} <> {_count('c', repr('”'))} THEN 'quotes'
    WHEN key IN (SELECT key FROM unknown) THEN 'vocabulary' WHEN regexp_matches(c, '[a-zçğıöşü][A-ZÇĞİÖŞÜ]') THEN 'case' END AS reject_reason FROM cleaned
)"""


def _nav_sql() -> str:
    list_ = f"'  <nav epub:type=' || chr(34) || 'toc' || chr(34) || ' id=' || chr(34) || 'toc' || chr(34) || '>' || chr(10) || '    <h1>' || {_esc('title')} || '</h1>' || chr(10) || '    <ol>' || items || '</ol>' || chr(10) || '  </nav>'"
    return _page("title", list_, "''", "styles/book.css")


NAV_ITEMS = f"l AS (SELECT book_id, string_agg('<li><a href=\"text/' || {CHAPTER_NAME} || '.xhtml\">' || {_esc('title')} || '</a></li>', chr(10) ORDER BY chapter_no) AS items FROM chapters GROUP BY 1)"
PACKED = f"""p AS (SELECT book_id, string_agg('<item id="' || item_id || '" href="' || href || '" media-type="' || media_type || '"' || CASE WHEN properties IS NULL THEN '' ELSE ' properties="' || properties || '"' END || '/>', ' ' ORDER BY kind, n) AS manifest,
    string_agg('<itemref idref="' || item_id || '"/>', ' ' ORDER BY n) FILTER (WHERE kind = 1) AS spine FROM items GROUP BY 1), h AS (SELECT *, {ID_HASH} AS h FROM books)"""
OPF = f"""{_q(render.HEAD)} || '<package version="3.0" unique-identifier="book-id" xmlns="http://www.idpf.org/2007/opf">' || chr(10) || '  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">' || chr(10)
        || '    <dc:identifier id="book-id">urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '</dc:identifier>' || chr(10) || '    <dc:title>' || {_esc('title')} || '</dc:title>' || chr(10)
        || '    <dc:creator>' || {_esc('author')} || '</dc:creator>' || chr(10) || '    <dc:language>' || language || '</dc:language>' || chr(10) || '    <meta property="dcterms:modified">{render.MODIFIED}</meta>' || chr(10) || '  </metadata>' || chr(10) || '  <manifest>' || chr(10) || '    ' || manifest
        || chr(10) || '  </manifest>' || chr(10) || '  <spine>' || chr(10) || '    ' || spine || chr(10) || '  </spine>' || chr(10) || '</package>' || chr(10)"""
JOINED = f"html AS (SELECT *, {HTML} AS html FROM body), joined AS (SELECT book_id, chapter_no, any_value(chapter_title) AS title, string_agg(html, '' ORDER BY page_number, block_no) AS html FROM html GROUP BY book_id, chapter_no)"
CHAPTER_PAGE = _page("title", f"'  <h1>' || {_esc('title')} || '</h1>' || coalesce(html, '')", f"' id=' || chr(34) || {CHAPTER_NAME} || chr(34)", "../styles/book.css", _q(render.CHAPTER_LANGUAGE))
#: A stored entry takes its name twice, its bytes and 76 more; the end of the archive takes 22.
ARCHIVED = f"""{JOINED}, {ITEMS}, {NAV_ITEMS}, {PACKED}, entries AS (
  SELECT book_id, 0 AS place, 'mimetype' AS name, {_q(render.MIMETYPE)} AS content FROM books UNION ALL SELECT book_id, 1, 'META-INF/container.xml', {_q(render.CONTAINER)} FROM books UNION ALL SELECT book_id, 2, 'EPUB/styles/book.css', {_q(render.STYLE)} FROM books
  UNION ALL SELECT book_id, 3, 'EPUB/nav.xhtml', {_nav_sql()} FROM books JOIN l USING (book_id)
  UNION ALL SELECT book_id, 3 + chapter_no, 'EPUB/text/' || {CHAPTER_NAME} || '.xhtml', {CHAPTER_PAGE} FROM (SELECT c.book_id, c.chapter_no, c.title, j.html FROM chapters c LEFT JOIN joined j USING (book_id, chapter_no))
  UNION ALL SELECT book_id, 1073741824, 'EPUB/package.opf', {OPF} FROM h JOIN p USING (book_id)
)"""

#: Figures in the last chapter that has begun by their page, numbered through the book, behind their chapters' text; their files and items, and the cover's.
PICTURED = f"""starts AS (SELECT book_id, chapter_no, min(page_number) AS first FROM body GROUP BY ALL), placed AS (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no, page_number) AS image_no FROM (
    SELECT p.book_id, p.page_number, p.doc_id, any_value(['a.png', 'b.JPG', 'c.gif', 'd', 'e.svg'][p.doc_id % 5 + 1]) AS path, any_value('"' || p.doc_id || '" & more') AS alt, coalesce(max(s.chapter_no), 1) AS chapter_no
    FROM pages0 p LEFT JOIN starts s ON s.book_id = p.book_id AND s.first <= p.page_number WHERE p.doc_id IS NOT NULL GROUP BY ALL)
), shown AS (
  SELECT book_id, chapter_no, string_agg('<figure><img src="../images/image-' || {_no('image_no')} || {SUFFIX} || '" alt="' || {_esc('alt')} || '"/></figure>', '' ORDER BY image_no) AS figures FROM placed GROUP BY ALL
), pictured AS (
  SELECT book_id, chapter_no, coalesce(j.html, '') || coalesce(figures, '') AS html FROM joined j FULL JOIN shown USING (book_id, chapter_no))"""
ILLUSTRATED = (
    ARCHIVED.replace(f"{JOINED}, ", f"{JOINED}, {PICTURED}, ").replace("LEFT JOIN joined j USING", "LEFT JOIN pictured j USING")
    .replace(ITEMS, ITEMS[:-1] + f""" UNION ALL SELECT book_id, 2, image_no, 'image-' || {_no('image_no')}, 'images/image-' || {_no('image_no')} || {SUFFIX}, CASE WHEN doc_id % 2 = 0 THEN 'image/x-made' ELSE {MIME} END, NULL FROM placed
  UNION ALL SELECT book_id, 3, 0, 'cover', 'images/cover.jpg', 'image/jpeg', 'cover-image' FROM books)""")
    .rstrip()[:-1] + f""" UNION ALL SELECT book_id, 268435456 + image_no, 'EPUB/images/image-' || {_no('image_no')} || {SUFFIX}, text FROM placed JOIN documents USING (doc_id) UNION ALL SELECT book_id, 536870912, 'EPUB/images/cover.jpg', title FROM books)"""
)

ORACLES = {
    "illustrated_files": f"WITH {ROLES_SQL}, {_chaptered('roled')}, {ILLUSTRATED} SELECT book_id, CAST(place AS BIGINT) AS place, name, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256 FROM entries",
    "guard_decision": f"WITH {DECIDED} SELECT key, CASE WHEN reject_reason IS NULL THEN c ELSE rules END AS text, reject_reason FROM decided",
    "book_archives": f"""WITH {ROLES_SQL}, {_chaptered('roled')}, {ARCHIVED}
      SELECT book_id, CAST(sum(strlen(content) + 2 * strlen(name) + 76) + 22 AS BIGINT) AS bytes, sha256(string_agg(name || chr(10) || content || chr(10), '' ORDER BY place)) AS sha256, count(*) AS entries, CAST(NULL AS VARCHAR) AS error FROM entries GROUP BY book_id""",
    "style_tokens": f"WITH {MODEL_PAIRS_SQL} SELECT key, {_count('rules', repr('“'))} AS opening, {RESTORED} AS restored FROM pairs",
    "clean_answers": f"""WITH {DAMAGED_SQL}, a AS (SELECT doc_id, text AS t FROM damaged), b AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  ```text' || chr(10) || t || chr(10) || '``` ' WHEN 1 THEN '<think>a' || chr(10) || 'b</think>' || chr(10) || t
      WHEN 2 THEN '```' || chr(10) || '<think>x</think> ' || t || chr(10) || '```' WHEN 3 THEN '<think>x</think>```' || chr(10) || t ELSE t END AS a FROM a) SELECT doc_id, {CLEAN.format('a')} AS clean FROM b""",
    "cheap_guards": f"""WITH {MODEL_PAIRS_SQL}, b AS (SELECT key, rules, {_back('answer')} AS a FROM pairs WHERE answer IS NOT NULL)
      SELECT key, {_WORDS.format('a')} / greatest(1, {_WORDS.format('rules')}) BETWEEN 0.65 AND 1.45 AS length_ok, {_count('rules', repr('“'))} = {_count('a', repr('“'))} AND {_count('rules', repr('”'))} = {_count('a', repr('”'))} AS quotes_ok,
        NOT regexp_matches(a, '[a-zçğıöşü][A-ZÇĞİÖŞÜ]') AS case_ok FROM b""",
    "new_words": f"WITH {NEW_WORDS} SELECT key, word, extra FROM fresh",
    "vocabulary_guard": f"WITH {NEW_WORDS}, {LEXICON} SELECT key, word, extra FROM fresh WHERE word NOT IN (SELECT word FROM lexicon)",
    "word_bags": f"SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest({_letters('text')}) AS word FROM documents) GROUP BY ALL",
    "cache_reuse": f"""WITH {CHECKPOINT}, r AS (SELECT book_id, n, raw AS text, 'paragraph' AS role FROM ck WHERE NOT same AND n % 11 <> 0), {_repaired('r')}
      SELECT pg.book_id AS source_hash, pg.n AS page_number, CASE WHEN ck.n IS NULL OR ck.n % 11 = 0 THEN 'missing' WHEN same THEN 'reused' ELSE 'repaired' END AS action,
        CAST(CASE WHEN ck.n IS NULL OR ck.n % 11 = 0 THEN 0 WHEN ck.n % 5 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n_blocks, CASE WHEN ck.n % 11 = 0 THEN NULL WHEN same AND ck.n % 5 = 0 THEN ck.text || ' stored' WHEN same THEN lower(ck.text) ELSE f.text END AS text,
        CASE WHEN ck.n % 11 <> 0 THEN 'paragraph' END AS role, CASE WHEN ck.n % 11 <> 0 THEN ck.n % 5 <> 0 AND ck.n % 3 = 0 END AS bold, CASE WHEN ck.n % 11 <> 0 THEN false END AS italic
      FROM pg LEFT JOIN ck ON ck.book_id = pg.book_id AND ck.n = pg.n LEFT JOIN fixed f ON f.book_id = pg.book_id AND f.n = pg.n""",
    "signatures": """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, sha256('4|{"provider":"' || ['rule', 'ollama'][c_custkey % 2 + 1] || '","api_key":' || CASE WHEN c_custkey % 3 = 0 THEN '"k\\"' || c_nationkey || '"' ELSE 'null' END
      || ',"model":"ü ' || c_name || '","timeout_seconds":' || c_custkey % 600 || '}') AS signature FROM customer""",
    "state_documents": f"WITH {CHECKPOINT} SELECT book_id AS source_hash, count(*) AS pages, CAST(sum(length(raw)) AS BIGINT) AS raw_chars, count(*) FILTER (WHERE n % 11 <> 0) AS complete FROM ck GROUP BY 1",
    "toc": f"WITH {ROLES_SQL}, {_repaired('roled')}, {_chaptered('fixed')} SELECT book_id, chapter_no, title, n_blocks, n_chars FROM chapters",
    "chapter_split": f"WITH {ROLES_SQL}, {_chaptered('roled')} SELECT book_id, page_number, block_no, chapter_no, chapter_title FROM body",
    "conversation_chapters": f"""WITH turns AS (SELECT CAST(conv_id AS VARCHAR) AS book_id, 1 AS page_number, turn AS block_no, text, CASE WHEN role = 'user' THEN 'heading' ELSE 'paragraph' END AS role FROM conversations),
      books AS (SELECT DISTINCT book_id, 'Talk ' || book_id AS title FROM turns), {_chaptered('turns')} SELECT book_id, chapter_no, title, n_blocks, n_chars FROM chapters""",
    "image_offset": """WITH c AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_no, doc_id % 4 AS n_images FROM documents)
      SELECT *, CAST(coalesce(sum(n_images) OVER (PARTITION BY book_id ORDER BY chapter_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS image_offset FROM c""",
    "progress": """WITH c AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, count(*) OVER (PARTITION BY source) AS total FROM documents),
      p AS (SELECT book_id, page_number, CAST(floor(page_number / total * 100) AS BIGINT) AS percent FROM c)
      SELECT *, percent - coalesce(lag(percent) OVER (PARTITION BY book_id ORDER BY page_number), 0) AS step FROM p""",
    "page_join": f"WITH {BLOCKS_SQL} SELECT book_id, page_number, string_agg(text, chr(10) ORDER BY block_no) AS raw, string_agg(text, chr(10) || chr(10) ORDER BY block_no) AS spaced FROM blocks GROUP BY ALL",
    "block_markup": f"""WITH {ROLES_SQL}, b AS (SELECT * FROM roled UNION ALL SELECT 'doc' || doc_id, 0, 0, replace(text, ' the ', ' _the_ '), 'paragraph', false, false FROM documents)
      SELECT book_id, page_number, block_no, {HTML} AS html FROM b""",
    "chapter_markup": f"""WITH {ROLES_SQL}, {_chaptered('roled')}, {JOINED} SELECT book_id, 'EPUB/text/' || {CHAPTER_NAME} || '.xhtml' AS name, {CHAPTER_PAGE} AS content FROM joined""",
    "navigation": f"WITH {ROLES_SQL}, {_chaptered('roled')}, {NAV_ITEMS} SELECT book_id, {_nav_sql()} AS nav FROM books JOIN l USING (book_id)",
    "manifest": f"""WITH {ROLES_SQL}, {_chaptered('roled')}, {PICTURES}, {ITEMS} SELECT * FROM items
      UNION ALL SELECT book_id, 2, image_no, 'image-' || {_no('image_no')}, 'images/image-' || {_no('image_no')} || {SUFFIX}, {MIME}, NULL FROM pictures UNION ALL SELECT book_id, 3, 0, 'cover', 'images/cover' || {SUFFIX}, {MIME}, 'cover-image' FROM pictures WHERE image_no = 1""",
    "package_file": f"WITH {ROLES_SQL}, {_chaptered('roled')}, {ITEMS}, {PACKED} SELECT book_id, {OPF} AS opf FROM h JOIN p USING (book_id)",
    "media_types": f"WITH {BLOCKS_SQL}, {PICTURES} SELECT book_id, image_no, {MIME} AS media_type FROM pictures",
    "required_files": """SELECT doc_id, array_to_string(list_sort(list_filter(['mimetype', 'META-INF/container.xml', 'EPUB/package.opf', 'EPUB/nav.xhtml'], lambda x, i: doc_id % (i + 1) = 0)), ',') AS missing FROM documents""",
    "escaped": f"SELECT page_id, {_esc('html')} AS html FROM pages",
}
