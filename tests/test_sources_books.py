import io
import sys
import zipfile
from hashlib import sha256

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quirelake import errors
from quirelake.operators import render
from quirelake.plans.convert import convert, convert_files, read_waves
from quirelake.sinks import archive
from quirelake.sources import images, native, ocr
from quirelake.sources.config import OcrSettings, Settings
from quirelake.streaming import repair_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('[ocr]\nengine = "tesseract"\ndpi = 400\n[ai]\nprovider = "ollama"\ntimeout_seconds = 300\n')
    s = Settings.load(str(f))
    assert (s.ocr.engine, s.ocr.dpi, s.ai.timeout_seconds, s.epub.language) == ("tesseract", 400, 300, "tr")
    assert Settings.load(str(tmp_path / "absent.toml")) == Settings()
    m = s.merged({"ocr.dpi": 150, "epub.title": "T", "ai.model": None})
    assert (m.ocr.dpi, m.epub.title, m.ai.model) == (150, "T", s.ai.model)
    for bad in ({"ocr.dpi": 100}, {"ocr.engine": "x"}, {"ai.timeout_seconds": 1}, {"performance.workers": 0}, {"ocr.gpu": "yes"}):
        with pytest.raises(ValueError):
            s.merged(bad)


def test_spans(spark):
    span = lambda t, f="Serif": {"text": t, "font": f}
    rows = [("b", 1, 1, 0, [[span("Hel"), span("lo", "SemiBold")], [span("  ")], [span(" world ")]]), ("b", 1, 2, 1, [[span("image")]]), ("b", 1, 3, 0, [[span(" ")]]), ("b", 1, 4, 0, [[span("x", "Sans-Oblique")]])]
    df = spark.createDataFrame(rows, "book_id string, page_number int, block_no int, kind int, lines array<array<struct<text:string,font:string>>>")
    assert [(r.block_no, r.text, r.bold, r.italic) for r in native.flatten_spans(df).orderBy("block_no").collect()] == [(1, "Hello\n world", True, False), (4, "x", False, True)]


def test_sidecar(spark):
    df = spark.createDataFrame([("b", "one\f \ftwo\f"), ("c", "")], "book_id string, text string")
    assert sorted(map(tuple, native.split_sidecar(df).collect())) == [("b", 1, "one"), ("b", 3, "two")]


def test_missing_pdf_library(spark):
    files = spark.createDataFrame([("b", b"%PDF")], "book_id string, content binary")
    if not native.has_pdf_library():
        with pytest.raises(errors.MissingDependency):
            native.scan_pdf(files)
        for f in (native.page_counts, native.render_pages):
            with pytest.raises(errors.MissingDependency):
                f(files)


def test_word_tables(spark):
    df = spark.createDataFrame([([" a ", "", "b", None, "c"], ["90", "50", "n/a", "10", "-1"]), (["x"], ["-1"]), ([], [])], "w array<string>, c array<string>")
    assert [(r.r.text, round(r.r.confidence, 9)) for r in df.select(ocr.join_words(F.col("w"), F.col("c")).alias("r")).collect()] == [("a b c", 0.9), ("x", 0.0), ("", 0.0)]


def test_engine_choice(tmp_path):
    assert ocr.choose_engine("tesseract", is_available=lambda n: n == "tesseract") == "tesseract"
    with pytest.raises(errors.MissingDependency, match="paddleocr"):
        ocr.choose_engine("paddleocr", is_available=lambda n: n == "tesseract")
    with pytest.raises(errors.OcrError):
        ocr.engine_maker("ocrmypdf", OcrSettings())
    assert ocr.choose_engine("auto", is_available=lambda n: n in ("tesseract", "ocrmypdf")) == "ocrmypdf"
    assert ocr.choose_engine("ocrmypdf", images_only=True, is_available=lambda n: n == "easyocr") == "easyocr"
    with pytest.raises(errors.MissingDependency):
        ocr.choose_engine(is_available=lambda n: False)
    assert ocr.first_existing([None, tmp_path / "no", tmp_path]) == str(tmp_path)
    (tmp_path / "tur.traineddata").touch()
    assert ocr.data_folder("tur+eng", ["/none", tmp_path]) == str(tmp_path) and ocr.data_folder("deu", [tmp_path]) is None


class Reads:
    def read(self, image):
        if image == b"bad":
            raise ValueError("unreadable")
        if image == b"words":
            return ocr.Read([" two ", "", "words"], ["90", "-1", "n/a"], words=True)
        return ocr.Read([image.decode()], ["0.5"])


def test_recognise_images(spark):
    df = spark.createDataFrame([("b", 1, 2, b"right"), ("b", 1, 1, b"left"), ("b", 2, 1, b"bad"), ("b", 2, 2, b"good"), ("b", 3, 1, b"words")], "book_id string, page_number int, image_no int, image binary")
    found = ocr.recognise_images(df, Reads)
    assert {(r.page_number, r.image_no): (r.text, r.confidence) for r in found.collect()} == {(1, 1): ("left", 0.5), (1, 2): ("right", 0.5), (2, 1): (None, 0.0), (2, 2): ("good", 0.5), (3, 1): ("two words", 0.9)}
    pages = {r.page_number: (r.text, r.error) for r in ocr.page_texts(found).collect()}
    assert pages == {1: ("left\n\nright", None), 2: (None, "ValueError: unreadable"), 3: ("two words", None)}

    def missing():
        raise errors.MissingDependency("no engine")

    with pytest.raises(Exception, match="no engine"):
        ocr.recognise_images(df, missing).collect()


def test_word_program():
    from types import SimpleNamespace

    asked = []

    def run(command, input, **_):
        asked.append(command)
        return SimpleNamespace(returncode=int(input == b"bad"), stderr=b"broken", stdout="level\tconf\ttext\n1\t-1\t\n5\t96.5\tBir\n5\t80\t\"iki\n".encode())

    program = ocr.WordProgram(OcrSettings(language="tur+eng"), programs=["/bin/sh"], run=run)
    got = program.read(b"image")
    assert asked[0] == ["/bin/sh", "stdin", "stdout", "-l", "tur+eng", "--psm", "3", "tsv"]
    assert got == ocr.Read(["", "Bir", '"iki'], ["-1", "96.5", "80"], words=True)
    with pytest.raises(errors.OcrError, match="broken"):
        program.read(b"bad")


def test_line_models():
    found = ocr.LineModel(lambda path: [("a", 0.5), ("b", None)] if open(path, "rb").read() == b"x" else []).read(b"x")
    assert found == ocr.Read(["a", "b"], ["0.5"]) and ocr.LineModel(lambda path: []).read(b"") == ocr.Read([], [])


def test_recognise_documents(spark):
    def run(command, input, **_):
        from pathlib import Path
        from types import SimpleNamespace

        assert command[0] == "ocrmypdf" and command[-2:] == ["-", "-"] and command[command.index("-l") + 1] == "tur"
        Path(command[command.index("--sidecar") + 1]).write_text("one\ftwo")
        return SimpleNamespace(returncode=6 if input == b"ok" else 2, stderr=b"broken file")

    df = spark.createDataFrame([("a", b"ok"), ("b", b"no")], "book_id string, content binary")
    found = {r.book_id: r for r in ocr.recognise_documents(df, OcrSettings(), run).collect()}
    assert (found["a"].text, found["a"].confidence) == ("one\ftwo", 0.9) and found["b"].error == "OcrError: broken file"


def test_images():
    page = np.full((200, 100), 255, np.uint8)
    page[50:150, 20:80] = 0
    assert images.crop_borders(page).shape == (120, 80)
    assert images.crop_borders(np.full((9, 9), 255, np.uint8)).shape == (9, 9)
    small = np.full((200, 200), 255, np.uint8)
    small[90:100, 90:100] = 0
    assert images.crop_borders(small).shape == (200, 200)  # too little would stay
    assert [p.shape for p in images.split_double(np.zeros((100, 145)))] == [(100, 72), (100, 73)] and len(images.split_double(np.zeros((100, 144)))) == 1
    out = images.enhance(np.dstack([page] * 3))
    assert out.dtype == np.uint8 and out.shape == page.shape and out[100, 50] == 0 and out[5, 5] == 255
    assert images.image_names(3, 1) == ["page_00003.png"] and images.image_names(3, 2) == ["page_00003_1.png", "page_00003_2.png"]


@pytest.mark.parametrize("degrees", [-6.0, -1.5, 2.0, 7.0])
def test_deskew(degrees):
    page = np.full((300, 200), 255, np.uint8)
    page[60:240:12, 40:160] = 0
    crooked = images.turned(page, degrees)
    assert abs(abs(images.slant(crooked < images.PAPER)) - abs(degrees)) < 0.7
    back = images.deskew(crooked)
    assert abs(images.slant(back < 200)) < 0.7
    assert np.array_equal(images.deskew(page), page) and images.slant(np.zeros((5, 5), bool)) == 0
    far = images.turned(page, 20.0)
    assert np.array_equal(images.deskew(far), far)


BOOKS = [("b1", 'A "book" & <more>', "Me", "en"), ("b2", "Empty", "You", "tr")]
BOOK_SCHEMA = "book_id string, title string, author string, language string"


def blocks_of(spark):
    rows = []
    for p in (1, 2, 3, 4):
        rows += [("b1", p, 0, f"Header {p}", 200.0, 10.0, 400.0, 40.0), ("b1", p, 9, f"- {p} -", 290.0, 800.0, 310.0, 820.0)]
    rows += [("b1", 1, 1, "CHAPTER ONE", 200.0, 100.0, 400.0, 130.0), ("b1", 1, 2, "Bug ün  **çok** a_b_c & co.", 30.0, 200.0, 570.0, 300.0), ("b1", 2, 1, "Son 12", 30.0, 200.0, 570.0, 300.0), ("b1", 3, 1, "CHAPTER <TWO>", 30.0, 100.0, 570.0, 140.0), ("b1", 3, 2, "left\tright", 30.0, 200.0, 570.0, 300.0)]
    df = spark.createDataFrame(rows, "book_id string, page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double").selectExpr("*", "block_no = 2 AS bold", "false AS italic")
    pages = df.selectExpr("book_id", "page_number", "600D AS width", "840D AS height").distinct()
    return df, pages, spark.createDataFrame(BOOKS, BOOK_SCHEMA)


def test_conversion_from_end_to_end(spark):
    df, pages, books = blocks_of(spark)
    scans = spark.createDataFrame([("b1", 4, 1, b"scanned icin"), ("b1", 1, 1, b"not needed")], "book_id string, page_number int, image_no int, image binary")
    out = convert(df, pages, books, images=scans, make_engine=Reads)
    toc = {(r.book_id, r.chapter_no): (r.title, r.n_blocks) for r in out["chapters"].collect()}
    assert toc == {("b1", 1): ("CHAPTER ONE", 2), ("b1", 2): ("CHAPTER <TWO>", 2), ("b2", 1): ("Empty", 0)}
    texts = {(r.page_number, r.block_no): r.text for r in out["blocks"].collect()}
    assert texts[1, 2] == "Bugün **çok** a_b_c & co." and texts[2, 1] == "Son" and texts[4, 1] == "scanned için"
    made = {r.book_id: r for r in out["archives"].collect()}
    assert all(r.error is None for r in made.values())
    with zipfile.ZipFile(io.BytesIO(made["b1"].archive)) as z:
        assert z.namelist()[:4] == ["mimetype", "META-INF/container.xml", "EPUB/styles/book.css", "EPUB/nav.xhtml"] and z.namelist()[-1] == "EPUB/package.opf"
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        one = z.read("EPUB/text/chapter-0001.xhtml").decode()
    assert "<p><strong>Bugün <strong>çok</strong> a<em>b</em>c &amp; co.</strong></p>" in one and 'lang="tr"' in one and '<body id="chapter-0001">' in one
    # A second run takes every page from the table, without recognition.
    table = out["checkpoint"]
    assert table.count() == 4 and out["failed"].count() == 0
    again = convert(df, pages, books, checkpoint=table)
    assert {(r.page_number, r.text) for r in again["blocks"].collect()} == {(r.page_number, r.text) for r in out["blocks"].collect()}
    assert again["checkpoint"].count() == 0
    other = convert(df, pages, books, Settings().merged({"ai.model": "x"}), checkpoint=table)
    assert {r.text for r in other["blocks"].collect()} == set(texts.values()) and other["checkpoint"].count() == 4
    with pytest.raises(errors.Cancelled):
        convert(df, pages, books, cancelled=lambda: True)


RAW = {1: "First page 1", 2: None, 3: "Third  page", 4: None}


def scanned(files):
    rows = [(n, 1 if t else 0, 0 if t else -1, [[{"text": t, "font": "Serif"}]] if t else []) for n, t in RAW.items()]
    pages = files.sparkSession.createDataFrame(rows, "page_number int, block_no int, kind int, lines array<array<struct<text:string,font:string>>>")
    return files.select("book_id").crossJoin(F.broadcast(pages)).selectExpr("book_id", "page_number", "600D width", "840D height", "block_no", "kind", "30D x0", "200D y0", "570D x1", "300D y1", "lines")


def drawn(files, wanted):
    return files.join(wanted, "book_id").selectExpr("book_id", "page_number", "1 image_no", "encode(concat('icin ', page_number, ' ', decode(content, 'utf-8')), 'utf-8') image")


def counting(folder, fails=()):
    """An engine that leaves a file for each call."""

    class Counts:
        def read(self, image):
            import uuid

            (folder / uuid.uuid4().hex).write_bytes(image)
            if any(f in image for f in fails):
                raise ValueError("unreadable")
            return ocr.Read([image.decode()])

    return Counts


def test_files_to_books(spark, tmp_path):
    """Each blank page is read once for all outputs; failed pages are tried again by the next run, the others aren't read again."""
    calls, table = tmp_path / "calls", str(tmp_path / "pages")
    calls.mkdir()
    files = spark.createDataFrame([(b"one",), (b"two",)], "content binary")
    told, seen = [], []
    go = lambda make, **more: convert_files(files, Settings().merged({"epub.title": "T"}), table, scan=scanned, render=drawn, prepare=lambda i: i, make_engine=make, waves=3, progress=lambda *a: told.append(a), preview=lambda *a: seen.append(a), **more)
    out = go(lambda: counting(calls, [b"2 two"])())
    assert len(list(calls.iterdir())) == 4 and told[-1][:2] == (8, 8) and [a for a, *_ in told] == sorted(a for a, *_ in told) and len(seen) == 7
    assert [(r.page_number, r.error) for r in out["failed"].collect()] == [(2, "ValueError: unreadable")]
    texts = {(r.page_number, r.text) for r in out["blocks"].collect()}
    assert {(1, "First page"), (3, "Third page"), (2, "için 2 one"), (4, "için 4 one"), (4, "için 4 two")} == texts
    assert out["archives"].count() == 1 and out["checkpoint"].count() == 8 and out["chapters"].count() == 2
    assert len(list(calls.iterdir())) == 4
    # The failed page alone is read by the next run, and both books are made.
    told.clear()
    again = go(lambda: counting(calls)(), resume=True)
    assert len(list(calls.iterdir())) == 5 and again["checkpoint"].count() == 1 and again["failed"].count() == 0 and told[-1][:2] == (8, 8)
    made = again["archives"].collect()
    assert len(made) == 2 and all(r.error is None for r in made)
    # Nothing is left to read: no engine is asked for, and none needs to be installed.
    last = convert_files(files, Settings().merged({"epub.title": "T"}), table, resume=True, scan=scanned)
    assert last["checkpoint"].count() == 0 and sorted(r.archive for r in last["archives"].collect()) == sorted(r.archive for r in made)


def test_a_stopped_run_keeps_its_waves(spark, tmp_path):
    calls, table = tmp_path / "calls", str(tmp_path / "pages")
    calls.mkdir()
    files = spark.createDataFrame([(b"one",)], "content binary")
    told = []  # a stop is asked for all the time, so it comes after the first wave
    go = lambda **more: convert_files(files, None, table, scan=scanned, render=drawn, prepare=lambda i: i, make_engine=lambda: counting(calls)(), waves=4, **more)
    with pytest.raises(errors.Cancelled, match="of 4 pages"):
        go(cancelled=lambda: bool(told), progress=lambda *a: told.append(a))
    before = read_waves(spark, table).count()
    out = go(resume=True)
    assert out["checkpoint"].count() == 4 - before and out["archives"].count() == 1 and {r.page_number for r in out["blocks"].collect()} == {1, 2, 3, 4}


def test_missing_engines_are_told_before_the_run(spark, tmp_path):
    files = spark.createDataFrame([(b"one",)], "content binary")
    with pytest.raises(errors.MissingDependency):
        convert_files(files, Settings().merged({"ocr.engine": "paddleocr"}), scan=scanned, render=drawn)
    if not native.has_pdf_library():
        with pytest.raises(errors.MissingDependency):
            convert_files(files)


def test_documents_without_pages(spark):
    """Whole documents: pages at form feeds, blank ones left out; a failed document is told and gets no book."""
    files = spark.createDataFrame([(b"ok",), (b"no",)], "content binary")
    read = lambda f: f.selectExpr("book_id", "if(content = X'6F6B', 'Bug ün 1\n\f \fCHAPTER', null) text", "0.9D confidence", "if(content = X'6F6B', null, 'OcrError: x') error")
    out = convert_files(files, scan=lambda f: scanned(f).limit(0), recognise=read)
    assert {(r.page_number, r.text, r.role) for r in out["blocks"].collect()} == {(1, "Bugün", "paragraph"), (3, "CHAPTER", "paragraph")}
    assert [r.error for r in out["failed"].collect()] == ["OcrError: x"] and out["archives"].count() == 1


def test_command_line(spark, tmp_path, capsys):
    from quirelake.__main__ import arguments, main, settings_of

    (tmp_path / "s.toml").write_text('[ocr]\nengine = "easyocr"\ngpu = true\n[performance]\ncache_dir = "%s"\n' % (tmp_path / "cache"))
    given = arguments().parse_args(["in", "out", "--config", str(tmp_path / "s.toml"), "--language", "eng", "--ai-provider", "ollama"])
    s = settings_of(given)
    assert (s.ocr.engine, s.ocr.gpu, s.ocr.language, s.ai.provider, s.performance.keep_temp) == ("easyocr", True, "eng", "ollama", False)
    (tmp_path / "a.pdf").write_bytes(b"one")
    calls = tmp_path / "calls"
    calls.mkdir()
    code = main([str(tmp_path / "a.pdf"), str(tmp_path / "a.epub"), "--config", str(tmp_path / "s.toml"), "--waves", "2"], spark, scan=scanned, render=drawn, prepare=lambda i: i, make_engine=lambda: counting(calls)())
    said = capsys.readouterr()
    assert code == 0 and said.out.strip() == str(tmp_path / "a.epub") and "100 % 4 of 4 pages" in said.err
    archive.check_archive((tmp_path / "a.epub").read_bytes())


def test_archives_are_checked_and_repeat(spark):
    good = {n: b"<a/>" for n in render.REQUIRED_FILES} | {"mimetype": b"application/epub+zip"}
    archive.check_archive(archive.build_archive(good.items()))
    assert archive.build_archive(good.items()) == archive.build_archive(good.items())
    for change in ({"mimetype": b"text"}, {"EPUB/nav.xhtml": b"<a>"}, {"x.xml": b"\x01"}):
        with pytest.raises(errors.ArchiveError):
            archive.check_archive(archive.build_archive((good | change).items()))
    with pytest.raises(errors.ArchiveError, match="EPUB/nav.xhtml"):
        archive.check_archive(archive.build_archive((k, v) for k, v in good.items() if "nav" not in k))
    rows = [("b", i, n, c) for i, (n, c) in enumerate(good.items())] + [("bad", 0, "mimetype", b"x")]
    found = {r.book_id: r.error for r in archive.archives(spark.createDataFrame(rows, "book_id string, place int, name string, content binary")).collect()}
    assert found["b"] is None and found["bad"].startswith("missing")


def test_images_in_books(spark):
    chapters = spark.createDataFrame([("b", 1, "One", "<p>x</p>"), ("b", 2, "Two", "")], "book_id string, chapter_no int, chapter_title string, body string")
    pictures = spark.createDataFrame([("b", 2, 1, "p/a.jpg", 'An "alt"', None)], "book_id string, chapter_no int, image_no int, path string, alt string, media_type string")
    pages = {r.chapter_no: r.content for r in render.chapter_pages(chapters, pictures).collect()}
    assert '<figure><img src="../images/image-0001.jpg" alt="An &quot;alt&quot;"/></figure>' in pages[2] and "figure" not in pages[1]
    items = render.manifest_items(chapters, pictures, pictures)
    assert {(r.item_id, r.media_type, r.properties) for r in items.where("kind > 1").collect()} == {("image-0001", "image/jpeg", None), ("cover", "image/jpeg", "cover-image")}
    assert render.image_entries(pictures.withColumn("content", F.lit(b"x"))).first().name == "EPUB/images/image-0001.jpg"


def test_stream_upserts(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    write = lambda rows: spark.createDataFrame(rows, repair_stream.PAGES).write.mode("append").parquet(source)
    go = lambda signature, k: repair_stream.start(spark.readStream.schema(repair_stream.PAGES).parquet(source), signature, table, str(tmp_path / "progress")).awaitTermination(120)
    write([("a", 1, "Bug ün"), ("a", 2, "x  y"), ("b", 1, "icin")])
    go("s1", 1)
    write([("a", 2, "new 5"), ("c", 1, "z")])
    go("s2", 2)
    found = {(r.source_hash, r.page_number): (r.repaired_text, r.repair_signature) for r in read_waves(spark, table).collect()}
    assert found == {("a", 1): ("Bugün", "s1"), ("a", 2): ("new", "s2"), ("b", 1): ("için", "s1"), ("c", 1): ("z", "s2")}


def test_archives_are_streamed(spark):
    """Figures of archives that no value or task holds whole, of several books in one task; a chapter is a row of its own all the way."""
    good = {n: b"<a/>" for n in render.REQUIRED_FILES} | {"mimetype": b"application/epub+zip"}
    rows = [(b, i, n, c) for b in ("b", "c") for i, (n, c) in enumerate(good.items())] + [("bad", 0, "mimetype", b"x"), ("c", 9, "ü.xml", b"<z/>")]
    files = spark.createDataFrame(rows[::-1], "book_id string, place int, name string, content binary")
    found = {r.book_id: r for r in archive.archive_digests(files).collect()}
    for r in archive.archives(files).collect():
        parts = b"".join(n.encode() + b"\n" + c + b"\n" for n, c in archive.entries(bytes(r.archive)))
        assert found.pop(r.book_id)[1:] == (len(r.archive), sha256(parts).hexdigest(), len(r.names), r.error)
    assert not found
    books = spark.createDataFrame([("b", "T", "A", "en"), ("none", "N", "A", "en")], "book_id string, title string, author string, language string")
    blocks = spark.createDataFrame([("b", 1, k, f"text {k}", "paragraph", False, False, k, f"C{k}") for k in (1, 2)], "book_id string, page_number long, block_no long, text string, role string, bold boolean, italic boolean, chapter_no int, chapter_title string")
    made = render.book_files(books, blocks)
    gathered = [x for x in made._jdf.queryExecution().optimizedPlan().toString().split("collect_list(")[1:] if "page_number" not in x.split(", 0, 0)")[0]]
    assert gathered and not any("body" in x.split(", 0, 0)")[0] for x in gathered)
    by = {(r.book_id, r.place): r.content for r in made.collect()}
    assert "text 2" in by["b", 5] and "<h1>N</h1>" in by["none", 4] and by["b", 3].count("<li>") == 2 and by["none", 1 << 30].count("itemref") == 1
