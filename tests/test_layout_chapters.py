import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as tx
from quirelake.operators import chapters, layout


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


TEXTS = ["", " a ", " x\x1c", "A B", "ABC1", "12", "ÇĞ İ", "aB", "line\nnext\r\nlast\n", "\n", "a\x0bb\x0cc\x85d e", "Straße ΑΣ ſ", "ǅ A", "  two  words\tand\n more "]


@pytest.mark.parametrize(("ours", "python"), [(tx.strip, str.strip), (tx.is_upper, str.isupper), (tx.splitlines, str.splitlines), (tx.words, str.split), (tx.is_blank, lambda t: not t.strip())])
def test_text_functions_are_pythons(spark, ours, python):
    assert column(spark, ours, TEXTS) == [python(t) for t in TEXTS]


def test_casefold_of_every_letter(spark):
    letters = [c for c in map(chr, range(1, 0x11000)) if c.casefold() != c and not 0xD800 <= ord(c) < 0xE000]
    texts = ["".join(letters[k : k + 40]) for k in range(0, len(letters), 40)] + ["oﬃce ﬁnd Straße ẞ", "ΑΣ ſ", None]
    fold = lambda t: t.replace("Σ", "σ").casefold()
    assert column(spark, tx.casefold, texts) == [None if t is None else fold(t) for t in texts]


def test_html_escape_and_counts(spark):
    import html

    assert column(spark, tx.html_escape, ["<a b='c' d=\"e\">&amp;"]) == [html.escape("<a b='c' d=\"e\">&amp;")]
    assert column(spark, lambda c: tx.count_of(c, "aa"), ["aaaa", "b", None]) == [2, 0, None]
    assert column(spark, tx.mime_type, ["a.png", "b.JPEG", "c.x.gif", "d", "e.odd"]) == ["image/png", "image/jpeg", "image/gif", "image/png", "image/png"]
    assert column(spark, tx.casefold, ["ÀSS ſ ß", "İ"]) == ["àss s ss", "i̇"]


def test_page_numbers(spark):
    yes = ["1", "- 12 -", "1234", "xii", "— IV —", " 7 ", "mild", "ilim", "٣"]
    no = ["12345", "", "a1", "1 2", "xiiiiiiiiiiii", "--3"]
    assert column(spark, layout.is_page_number, yes + no) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(
    ("text", "y0", "role"),
    [("12", 700, "page-number"), ("a note", 700, "footnote"), ("n" * 240, 700, "paragraph"), ("A TITLE", 100, "heading"), ("Chapter one", 100, "heading"), ("chapters are long", 100, "paragraph"), ("bölüm", 1, "heading"), ("Kısım: 2", 1, "heading"), ("A" * 91, 1, "paragraph"), ("a\tb", 1, "table"), ("a   b", 1, "table"), ("2024!", 1, "paragraph"), ("plain", 1, "paragraph"), ("edge", 655.2, "paragraph")],
)
def test_roles(spark, text, y0, role):
    assert column(spark, lambda c: layout.block_role(c, F.lit(y0), F.lit(840.0)), [text]) == [role]


def block(book, page, no, text, y0=150, y1=170, x0=0, x1=100, width=600, height=840):
    return (book, page, no, text, float(x0), float(y0), float(x1), float(y1), float(width), float(height))


BLOCKS = "book_id string, page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, width double, height double"


def test_headers_columns_and_blank_pages(spark):
    rows = []
    for p in range(1, 5):
        rows += [block("b", p, 0, f"My  Journal {p}", 10, 40), block("b", p, 9, str(p), 800, 820), block("b", p, 1, "My journal 99", 300, 320)]
        rows += [block("b", p, 10 + k, f"text {'x' * k}", x0=0 if k < 4 else 400, x1=200 if k < 4 else 600) for k in range(8 if p < 4 else 0)]
    rows += [block("c", 1, 0, "once", 10, 40), block("c", 2, 0, "once", 10, 40)]
    df = spark.createDataFrame(rows, BLOCKS)
    pages = df.select("book_id", "page_number", "width", "height").distinct()
    assert sorted(map(tuple, layout.repeated_margins(df, pages).collect())) == [("b", "#", 4), ("b", "my journal #", 4)]
    kept, flags = layout.analyse(df.drop("width", "height"), pages)
    assert {(r.book_id, r.page_number) for r in flags.where("is_blank").collect()} == {("b", 4)}
    assert kept.where("text LIKE 'My%'").count() == 0 and kept.where("book_id = 'c'").count() == 2
    assert {r.page_number: r.layout for r in flags.where("book_id = 'b'").collect()} == {1: "multi-column", 2: "multi-column", 3: "multi-column", 4: "single-column"}
    books = spark.createDataFrame([("b",), ("c",), ("d",)], "book_id string")
    assert {r.book_id: r.needs_ocr for r in layout.books_needing_ocr(books, flags).collect()} == {"b": True, "c": False, "d": True}


@pytest.mark.parametrize(("left", "right", "middle", "want"), [(3, 3, 2, "multi-column"), (3, 3, 1, "single-column"), (4, 3, 3, "single-column"), (5, 3, 2, "multi-column"), (6, 2, 0, "single-column"), (4, 4, 0, "multi-column")])
def test_columns(spark, left, right, middle, want):
    xs = [(0, 100)] * left + [(500, 600)] * right + [(250, 350)] * middle
    df = spark.createDataFrame([block("b", 1, i, "t", x0=a, x1=b) for i, (a, b) in enumerate(xs)], BLOCKS)
    assert layout.page_layout(df).first().layout == want


def test_headings_and_verse(spark):
    role = lambda r: lambda c: layout.heading_of(c, F.lit(r))
    assert column(spark, role("paragraph"), ["Chapter 1\nbody", "chapters ahead", "none", " BÖLÜM 2", "chapter " + "x" * 80, ""]) == ["Chapter 1", "chapters ahead", None, "BÖLÜM 2", None, None]
    assert column(spark, role("heading"), ["Any\nthing", ""]) == ["Any", ""]
    assert column(spark, layout.looks_poetic, ["a\nb\nc", "a\nb", "a\nb\n" + "x" * 50, "a\n\nb\nc\n", "a\nb\nc\n" + "y" * 60]) == [True, False, False, True, True]


def plain_chapters(blocks, title):
    out, now, body = [], title, []
    for text, role in blocks:
        if not text.strip():
            continue
        if role == "heading":
            if body:
                out.append((now, body))
            now, body = text.strip().splitlines()[0], []
        else:
            body.append(text)
    return [*out, (now, body)] if body else out or [(title, [])]


@pytest.mark.parametrize("marks", ["", "h", "b", "hb", "bhb", "hhb", "bh", "hbhhbb", "bbhbh", " h b ", "hbhbhb"])
def test_chapters(spark, marks):
    rows = [("k", 1 + i // 3, i % 3, " " if m == " " else f"T{i}\nrest", "heading" if m == "h" else "paragraph") for i, m in enumerate(marks)]
    df = spark.createDataFrame(rows, "book_id string, page_number int, block_no int, text string, role string")
    books = spark.createDataFrame([("k", "Book")], "book_id string, title string")
    found = [(r.title, r.n_blocks) for r in chapters.chapters(df, books).orderBy("chapter_no").collect()]
    assert found == [(t, len(b)) for t, b in plain_chapters([(r[3], r[4]) for r in rows], "Book")]


def test_offsets_and_progress(spark):
    df = spark.createDataFrame([("b", 1, 2), ("b", 2, 0), ("b", 3, 5), ("c", 1, 1)], "book_id string, chapter_no int, n_images int")
    assert {(r.book_id, r.chapter_no): r.image_offset for r in chapters.image_offsets(df).collect()} == {("b", 1): 0, ("b", 2): 2, ("b", 3): 2, ("c", 1): 0}
    pages = spark.createDataFrame([("b", i) for i in (1, 2, 3)], "book_id string, page_number int")
    assert [(r.percent, r.step) for r in chapters.progress(pages).orderBy("page_number").collect()] == [(33, 33), (66, 33), (100, 34)]
