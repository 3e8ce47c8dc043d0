"""The conversion's promises: what a stop leaves, files given twice, models, covers and figures, the page log and the book sink."""

import io
import json
import threading
import time
import uuid
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirelake import errors
from quirelake.functions import guards
from quirelake.operators import render
from quirelake.operators.pagelog import PageLog
from quirelake.plans.convert import convert, convert_files, read_waves
from quirelake.plans.jobs import numbered, stoppable
from quirelake.sinks import archive, books
from quirelake.sources import lexicon, ocr
from quirelake.sources.config import Settings

LINES = "array<array<struct<text:string,font:string>>>"


def scan(pages):
    """A scanner that finds these pages (text or None) in every file."""

    def found(files):
        rows = [(n, 1 if t else 0, 0 if t else -1, [[{"text": t, "font": "Serif"}]] if t else []) for n, t in enumerate(pages, 1)]
        table = files.sparkSession.createDataFrame(rows, f"page_number int, block_no int, kind int, lines {LINES}")
        return files.select("book_id").crossJoin(F.broadcast(table)).selectExpr("book_id", "page_number", "600D width", "840D height", "block_no", "kind", "30D x0", "200D y0", "570D x1", "300D y1", "lines")

    return found


def draw(files, wanted):
    return files.join(wanted, "book_id").selectExpr("book_id", "page_number", "1 image_no", "encode(concat('page text ', page_number), 'utf-8') image")


def engine(folder, seconds=0.0):
    class Reads:
        def read(self, image):
            (folder / uuid.uuid4().hex).write_bytes(image)
            time.sleep(seconds)
            return ocr.Read([image.decode()])

    return Reads


def calls(folder):
    return len(list(folder.iterdir()))


@pytest.fixture
def run(spark, tmp_path):
    folder, table = tmp_path / "calls", str(tmp_path / "pages")
    folder.mkdir()
    files = spark.createDataFrame([(b"one",)], "content binary")

    def go(pages=(None,) * 24, waves=6, seconds=0.0, **more):
        return convert_files(files, None, table, scan=scan(pages), render=draw, prepare=lambda i: i, make_engine=engine(folder, seconds), waves=waves, **more)

    go.folder, go.table = folder, table
    return go


def test_a_stop_after_the_first_wave(spark, run):
    """Of 24 blank pages in six waves only those of the waves begun are read, and they are in the log; the next run reads the others alone."""
    told, seen = [], []
    with pytest.raises(errors.Cancelled, match="of 24 pages"):
        run(progress=lambda *a: told.append(a), preview=lambda *a: seen.append(a), cancelled=lambda: bool(told))
    before = calls(run.folder)
    assert before <= 8 and told == [(4, 24, "4 of 24 pages")] and [(n, t) for _, n, t, _ in seen] == [(n, f"page text {n}") for n in (1, 2, 3, 4)]
    assert read_waves(spark, run.table).where("complete").count() == 4
    out = run(resume=True, progress=lambda *a: told.append(a))
    assert calls(run.folder) == before + 20 and told[-1][:2] == (24, 24) and out["checkpoint"].count() == 20 and out["blocks"].count() == 24 and out["archives"].count() == 1


def test_a_stop_while_a_wave_runs(spark, run):
    """The running wave is interrupted; the waves before it stay."""
    told, began = [], time.time()
    with pytest.raises(errors.Cancelled):
        run(waves=2, pages=(None,) * 12, seconds=1.5, progress=lambda *a: told.append(time.time()), cancelled=lambda: bool(told) and time.time() > told[0] + 1)
    assert len(told) == 1 and time.time() - told[0] < 20 and time.time() > began
    assert read_waves(spark, run.table).count() == 6


def test_stoppable_jobs(spark):
    assert stoppable(spark, lambda: False, lambda: spark.range(10).count()) == 10 == stoppable(spark, None, lambda: spark.range(10).count())
    stop = threading.Event()
    threading.Timer(1, stop.set).start()
    slow = F.udf(lambda x: time.sleep(60) or x, "long")
    began = time.time()
    with pytest.raises(errors.Cancelled):
        stoppable(spark, stop.is_set, lambda: spark.range(2).select(slow("id")).collect(), 0.1)
    assert time.time() - began < 30 and spark.range(5).count() == 5
    with pytest.raises(ZeroDivisionError):
        stoppable(spark, lambda: False, lambda: 1 // 0)


def test_numbers_in_order(spark):
    rows = spark.range(1000).selectExpr("concat('b', id % 7) AS book_id", "id AS page_number").repartition(13)
    found = sorted(tuple(r) for r in numbered(rows, "book_id", "page_number").select("number", "book_id", "page_number").collect())
    assert [n for n, *_ in found] == list(range(1000)) and [x[1:] for x in found] == sorted(x[1:] for x in found)
    assert numbered(rows.limit(0), "book_id").count() == 0


def test_a_file_given_twice_is_one_book(spark, tmp_path):
    named = spark.createDataFrame([("b/x.pdf", b"same"), ("a/x.pdf", b"same"), ("c", b"other")], "book_id string, content binary")
    for files in (named, named.select("content")):
        out = convert_files(files, scan=scan(["The text of the page"]))
        assert out["blocks"].groupBy("book_id").agg(F.count("*").alias("n")).select("n").collect() == [(1,), (1,)] and out["archives"].count() == 2


def test_names_of_books(spark, tmp_path, capsys):
    """Inputs of one name in two folders, and one file in two places, each give a book of their own."""
    from quirelake.__main__ import main

    (tmp_path / "s.toml").write_text('[performance]\ncache_dir = "%s"\n' % (tmp_path / "cache"))
    for name, content in (("a/x.pdf", b"one"), ("b/x.pdf", b"two"), ("b/copy.pdf", b"one")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    assert main([str(tmp_path / "in"), str(tmp_path / "out"), "--config", str(tmp_path / "s.toml"), "--waves", "1"], spark, scan=scan(["Some text"])) == 0
    made = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert set(made) == {"a/x.epub", "b/x.epub", "b/copy.epub"} and made["a/x.epub"] == made["b/copy.epub"] != made["b/x.epub"]
    for data in made.values():
        archive.check_archive(data)
    assert sorted(capsys.readouterr().out.split()) == sorted(str(tmp_path / "out" / n) for n in made)


def mends():
    class Mends:
        """A model that mends two words."""

        def available(self):
            return True

        def correct(self, text):
            return text.replace("hbuse", "house").replace("gardqn", "garden")

    return Mends


def test_corrections_get_through(spark, tmp_path):
    files = spark.createDataFrame([(b"one",)], "content binary")
    page = "The old hbuse stands in the wide gardqn behind the hill"
    go = lambda **more: {r.text for r in convert_files(files, scan=scan([page]), make_text_model=mends(), **more)["blocks"].collect()}
    assert go() == {"The old house stands in the wide garden behind the hill"}
    (tmp_path / "words.tsv").write_text("# words\nHouse\t3\ngarden\t2\nhouse\n")
    known = lexicon.read_lexicon(spark, str(tmp_path / "words.tsv"))
    assert sorted(tuple(r) for r in known.collect()) == [("garden", 2), ("house", 4)]
    assert go(lexicon=known) == {"The old house stands in the wide garden behind the hill"}
    assert go(lexicon=known.where("word <> 'garden'")) == {page}


def test_lexicons(spark, tmp_path):
    texts = spark.createDataFrame([("The cat. THE dog",), ("a straße",), (None,)], "text string")
    lexicon.save_lexicon(lexicon.build_lexicon(texts), str(tmp_path / "words"))
    assert {r.word: r.n for r in lexicon.read_lexicon(spark, str(tmp_path / "words")).collect()} == {"the": 2, "cat": 1, "dog": 1, "a": 1, "strasse": 1}
    assert {r.word for r in lexicon.build_lexicon(texts, least=2).collect()} == {"the"}
    pairs = spark.createDataFrame([(1, "the cat", "the dog mouse"), (2, "a", "a mouse mouse")], "key long, rules string, answer string")
    known = lexicon.build_lexicon(texts)
    want = [(1, "mouse", 1), (2, "mouse", 2)]
    assert sorted(tuple(r) for r in guards.unknown_words(pairs, known, "key", "rules", "answer").collect()) == want


def test_covers_and_figures(spark, tmp_path):
    """A cover from the settings, and figures at the end of their chapters, numbered through the book."""
    (tmp_path / "front.jpg").write_bytes(b"JPEG")
    files = spark.createDataFrame([(b"one",)], "content binary")
    pages = ["Chapter 1", "Body of the first", "Chapter 2", "Body of the second"]
    book = "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"
    rows = [(book, 4, 1, "p/z.png", "last", None, b"Z"), (book, 1, 1, "p/a", "no ending", "image/gif", b"A"), (book, 2, 2, "p/c.svg", None, None, b"C"), (book, 2, 1, "p/b.jpg", 'An "alt"', None, b"B")]
    figures = spark.createDataFrame(rows, "book_id string, page_number int, figure_no int, path string, alt string, media_type string, content binary")
    out = convert_files(files, Settings().merged({"epub.cover": str(tmp_path / "front.jpg")}), scan=scan(pages), figures=figures)
    made = out["archives"].first()
    assert made.error is None
    with zipfile.ZipFile(io.BytesIO(made.archive)) as z:
        names = z.namelist()
        assert names[4:] == ["EPUB/text/chapter-0001.xhtml", "EPUB/text/chapter-0002.xhtml", "EPUB/images/image-0001", "EPUB/images/image-0002.jpg", "EPUB/images/image-0003.svg", "EPUB/images/image-0004.png", "EPUB/images/cover.jpg", "EPUB/package.opf"]
        assert [z.read(n) for n in names[6:11]] == [b"A", b"B", b"C", b"Z", b"JPEG"]
        one, two, opf = (z.read(n).decode() for n in ("EPUB/text/chapter-0001.xhtml", "EPUB/text/chapter-0002.xhtml", "EPUB/package.opf"))
    assert one.count("<figure>") == 3 and '<img src="../images/image-0002.jpg" alt="An &quot;alt&quot;"/>' in one and '<img src="../images/image-0004.png" alt="last"/>' in two
    assert '<item id="image-0001" href="images/image-0001" media-type="image/gif"/>' in opf and '<item id="image-0003" href="images/image-0003.svg" media-type="image/svg+xml"/>' in opf
    assert '<item id="cover" href="images/cover.jpg" media-type="image/jpeg" properties="cover-image"/>' in opf and opf.index('id="image-0004"') < opf.index('id="cover"') < opf.index("<spine>")


def test_a_figure_in_a_book_without_body(spark):
    files = spark.createDataFrame([("b", "T", "A", "en")], "book_id string, title string, author string, language string")
    blocks = spark.createDataFrame([], "book_id string, page_number int, block_no int, text string, role string, bold boolean, italic boolean, chapter_no int, chapter_title string")
    figures = spark.createDataFrame([("b", 9, 1, "x.png", "alt", None, b"X")], "book_id string, page_number int, figure_no int, path string, alt string, media_type string, content binary")
    made = archive.archives(render.book_files(files, blocks, images=render.placed_figures(figures, blocks))).first()
    with zipfile.ZipFile(io.BytesIO(made.archive)) as z:
        assert made.error is None and "<h1>T</h1><figure>" in z.read("EPUB/text/chapter-0001.xhtml").decode()


def page(n, text, complete=True):
    return ("h", n, text, text.upper(), complete)


PAGE = "source_hash string, page_number int, raw_text string, repaired_text string, complete boolean"


def test_the_page_log(spark, tmp_path):
    log = PageLog(spark, str(tmp_path / "log"))
    assert log.read() is None and log.waves() == [] and not log.compact(0 + 1)
    write = lambda *rows, **more: log.write(spark.createDataFrame(list(rows), PAGE), **more)
    state = lambda: {r.page_number: r.raw_text for r in log.read().collect()}
    first = write(page(1, "a"), page(2, "b"))
    write(page(2, "c"))
    assert state() == {1: "a", 2: "c"} and log.waves()[0] == first
    # A kill between files and commit, and one within a commit: nothing but that wave is lost.
    spark.createDataFrame([page(1, "lost")], PAGE).write.parquet(f"{log.path}/data/lost")
    Path(log._commit_file(2)).write_text('{"waves": {"lo')
    assert state() == {1: "a", 2: "c"}
    write(page(3, "d"))
    assert state() == {1: "a", 2: "c", 3: "d"}
    # A stream's batch counts once.
    assert write(page(4, "s0"), stream="s", batch=0) and write(page(4, "again"), stream="s", batch=0) is None and write(page(4, "s1"), stream="s", batch=1)
    assert state()[4] == "s1"
    # Compaction keeps the last rows, and a wave that comes later still wins.
    want = state()
    assert not log.compact(50) and log.compact(2) and state() == want and len(log.waves()) == 1
    write(page(1, "z"))
    assert write(page(4, "again"), stream="s", batch=1) is None
    assert state() == {**want, 1: "z"}
    assert log.vacuum(0) == 6 and state() == {**want, 1: "z"} and log.vacuum() == 0


def test_compaction_gives_way_to_another_writer(spark, tmp_path):
    log, other = (PageLog(spark, str(tmp_path / "log")) for _ in range(2))
    for n in range(3):
        log.write(spark.createDataFrame([page(n, "a")], PAGE))
    latest = log._latest
    log._latest = lambda s: (other.write(spark.createDataFrame([page(0, "new")], PAGE)), latest(s))[1]
    assert not log.compact(2)
    assert {r.page_number: r.raw_text for r in log.read().collect()} == {0: "new", 1: "a", 2: "a"}


def test_many_waves_are_one_scan(spark, tmp_path):
    log = PageLog(spark, str(tmp_path / "log"))
    one = log.write(spark.createDataFrame([page(0, "a")], PAGE))
    import shutil

    for n in range(1, 300):
        shutil.copytree(f"{log.path}/data/{one}", f"{log.path}/data/w{n}")
        assert log._make(n, {"waves": {f"w{n}": n}})
    found = log.read()
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1 and found.count() == 1 and len(log.waves()) == 300


FILES = "book_id string, place long, name string, content binary"


def made_book(book, extra=()):
    need = {n: b"<a/>" for n in render.REQUIRED_FILES} | {"mimetype": b"application/epub+zip"}
    return [(book, k, n, c) for k, (n, c) in enumerate([*need.items(), *extra])]


def test_books_are_written_by_tasks(spark, tmp_path):
    rows = made_book("a", [("EPUB/é.xhtml", b"<b/>")]) + made_book("bad", [("EPUB/x.xhtml", b"<b>")]) + made_book("c")
    files = spark.createDataFrame(rows, FILES).repartition(5)
    names = spark.createDataFrame([("a", "one/a.epub"), ("a", "two.epub"), ("bad", "bad.epub"), ("c", "c.epub")], "book_id string, target string")
    out = tmp_path / "out"
    errors_found = books.write_books(files, names, str(out))
    assert list(errors_found) == ["bad.epub"] and "not well formed" in errors_found["bad.epub"]
    assert {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()} == {"one/a.epub", "two.epub", "c.epub", books.ERRORS}
    assert list(archive.entries((out / "two.epub").read_bytes())) == [(n, c) for b, _, n, c in rows if b == "a"]
    with zipfile.ZipFile(out / "two.epub") as z:
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED and i.date_time == (1980, 1, 1, 0, 0, 0) for i in z.infolist())
    assert books.write_books(files.where("book_id = 'c'"), names, str(out)) == {} and not (out / books.ERRORS).exists()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    broken = F.udf(lambda b: b if b != b"boom" else 1 / 0, "binary")
    files = spark.createDataFrame(made_book("a") + made_book("z", [("boom", b"boom")]), FILES).withColumn("content", broken("content"))
    names = spark.createDataFrame([("a", "a.epub"), ("z", "z.epub")], "book_id string, target string")
    with pytest.raises(Exception, match="ZeroDivision|division"):
        books.write_books(files, names, str(out))
    assert not out.exists() or not [p for p in out.rglob("*") if p.is_file()]


def test_engines_are_asked_on_every_machine(spark):
    offers = ocr.engine_offers(spark, lambda name: name == "tesseract").collect()
    assert {(r.engine, r.available) for r in offers} == {(n, n == "tesseract") for n in ocr.PREFERENCE}
    assert ocr.available_everywhere(spark, lambda name: name in ("tesseract", "easyocr")) == {"tesseract", "easyocr"}
    with pytest.raises(errors.MissingDependency):
        ocr.choose_engine("paddleocr", is_available=ocr.available_everywhere(spark, lambda name: False).__contains__)


def test_a_gpu_is_asked_for(spark, monkeypatch):
    """On a cluster the stage of recognition asks for a GPU a task; locally there is nobody to ask."""
    wish = Settings().merged({"ocr.gpu": True}).ocr
    assert ocr.gpu_profile(spark, wish) is None

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

    profile = ocr.gpu_profile(Cluster, wish)
    assert profile.taskResources["gpu"].amount == 1 and profile.executorResources["gpu"].amount == 1 and ocr.gpu_profile(Cluster, Settings().ocr) is None


def test_work_is_read_by_waves(spark, tmp_path):
    """Each wave reads its own folder, not the whole work."""
    from quirelake.plans.convert import _Work

    missing = spark.range(40).selectExpr("'b' AS book_id", "CAST(id + 1 AS int) AS page_number")
    blocks = missing.selectExpr("*", "1 AS block_no", "concat('t', page_number) AS text")
    work = _Work(spark, missing, blocks, missing.limit(0).selectExpr("*", "'x' AS layout"), 4)
    assert [sorted(r.page_number for r in work.of("blocks", w).collect()) for w in range(4)] == [list(range(10 * w + 1, 10 * w + 11)) for w in range(4)]
    assert work.of("blank", 0).count() == 0 and "PartitionFilters: [isnotnull(wave" in work.of("blocks", 1)._jdf.queryExecution().executedPlan().toString()
    work.close()
    assert not Path(work.path.removeprefix("file:")).exists()


def test_convert_takes_tables_alone(spark):
    blocks = spark.createDataFrame([("b", 1, 1, "Bug ün", 30.0, 200.0, 570.0, 300.0, False, False)], "book_id string, page_number int, block_no int, text string, x0 double, y0 double, x1 double, y1 double, bold boolean, italic boolean")
    pages = spark.createDataFrame([("b", 1, 600.0, 840.0)], "book_id string, page_number int, width double, height double")
    out = convert(blocks, pages, spark.createDataFrame([("b", "T", "A", "en")], "book_id string, title string, author string, language string"))
    assert [r.text for r in out["blocks"].collect()] == ["Bugün"] and json.loads(out["archives"].select("names").toJSON().first())["names"][0] == "mimetype"
