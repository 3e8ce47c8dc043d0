"""Command line: ``python -m quirelake INPUT OUTPUT`` turns PDF files into book archives."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirelake.plans.convert import convert_files
from quirelake.sinks.books import write_books
from quirelake.sources.config import OCR_ENGINES, PROVIDERS, Settings
from quirelake.sources.lexicon import build_lexicon, read_lexicon, save_lexicon
from quirelake.sources.native import read_binary


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quirelake", description="Convert scanned or mixed PDF files into EPUB 3 books.")
    p.add_argument("input", help="a PDF file, or a folder of them")
    p.add_argument("output", help="the book to write, or for a folder the folder of the books")
    p.add_argument("--config", help="a TOML file of settings")
    p.add_argument("--ocr-engine", choices=OCR_ENGINES)
    p.add_argument("--ai-provider", choices=PROVIDERS)
    p.add_argument("--language", help="language of the recogniser")
    p.add_argument("--resume", action="store_true", help="go on from what an earlier run has written")
    p.add_argument("--gpu", action="store_true")
    p.add_argument("--keep-temp", action="store_true")
    p.add_argument("--lexicon", help="words that a model may bring: a saved lexicon, or a .txt or .tsv file; without it any word is taken")
    p.add_argument("--build-lexicon", action="store_true", help="make the lexicon OUTPUT from the text files INPUT, and stop")
    p.add_argument("--waves", type=int, default=8, help="parts in which pages are repaired and saved")
    p.add_argument("--verbose", action="store_true")
    return p


def settings_of(given: argparse.Namespace) -> Settings:
    """The file's settings with the options that were given; a flag that wasn't leaves the file's value."""
    return Settings.load(given.config).merged({"ocr.engine": given.ocr_engine, "ai.provider": given.ai_provider, "ocr.language": given.language, "ocr.gpu": given.gpu or None, "performance.keep_temp": given.keep_temp or None})


def targets(paths: list[tuple[str, str]], given: str, output: str) -> tuple[str, list[tuple[str, str]]]:
    """The folder to write to, and (book, file name in it) of each input (book, path): the output itself for one file, else the inputs' own places below the output with another ending."""
    root = Path(given).absolute()
    if len(paths) == 1 and not root.is_dir() and not Path(output).is_dir():
        return str(Path(output).absolute().parent), [(paths[0][0], Path(output).name)]
    plain = lambda p: Path(p.removeprefix("file:").replace("///", "/") if p.startswith("file:") else p)
    below = lambda p: p.relative_to(root) if p.is_relative_to(root) and p != root else Path(p.name)
    return str(Path(output).absolute()), [(book, str(below(plain(p)).with_suffix(".epub"))) for book, p in paths]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, **replacements) -> int:
    given = arguments().parse_args(argv)
    logging.basicConfig(level=logging.INFO if given.verbose else logging.WARNING)
    settings = settings_of(given)
    spark = spark or SparkSession.builder.appName("quirelake").getOrCreate()
    if given.build_lexicon:
        save_lexicon(build_lexicon(spark.read.text(given.input), "value"), given.output)
        return 0
    files = read_binary(spark, given.input)
    paths = [(r.id, r.book_id) for r in files.select(F.sha2("content", 256).alias("id"), "book_id").orderBy("book_id").collect()]  # a name for each file
    folder, places = targets(paths, given.input, given.output)
    names = dict(places)

    def told(done: int, total: int, message: str) -> None:
        print(f"{100 * done // max(total, 1):3d} % {message}", file=sys.stderr)

    table = str(Path(settings.performance.cache_dir).absolute() / "pages")
    if given.lexicon:
        replacements["lexicon"] = read_lexicon(spark, given.lexicon)
    out = convert_files(files, settings, table, given.resume, progress=told, waves=given.waves, **replacements)
    for r in out["failed"].limit(20).collect():
        print(f"page {r.page_number} of {names[r.book_id]} failed: {r.error}", file=sys.stderr)
    errors = write_books(out["files"], spark.createDataFrame(places, "book_id string, target string"), folder)
    made = {r.book_id for r in out["files"].select("book_id").distinct().collect()}  # an id for each book
    for target, error in sorted(errors.items()):
        print(f"{target} is not valid: {error}", file=sys.stderr)
    written = [target for book, target in places if book in made and target not in errors]
    for target in written:
        print(Path(folder, target))
    return 0 if len(written) == len(places) else 1


if __name__ == "__main__":
    sys.exit(main())
