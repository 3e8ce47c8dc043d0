"""Giant books: the same chapters and numbers whatever the ranges, and no task with a whole book."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators import chapters, ranges

BLOCKS = "book_id string, page_number int, block_no int, text string, role string"


def made_blocks(seed, books=6, pages=60):
    r = random.Random(seed)
    rows = []
    for b in range(books):
        share = r.choice([0.0, 0.05, 0.4, 0.9])
        for p in r.sample(range(1, pages + 1), r.randint(1, pages)):
            for k in range(r.randint(0, 4)):
                heading = r.random() < share
                rows.append((f"b{b}", p, k, r.choice([" ", "\n"]) if r.random() < 0.1 else f"title {p}.{k}\nrest" if heading else f"body {p}.{k}", "heading" if heading else "paragraph"))
    return rows


def plain_chapters(rows):
    """A walk over each book's blocks in their order."""
    out = []
    for book in {r[0] for r in rows}:
        title, number, open_ = None, 0, False
        for _, p, k, text, role in sorted(x for x in rows if x[0] == book):
            if not text.strip():
                continue
            if role == "heading":
                title, open_ = text.strip().split("\n")[0], False
                continue
            number += not open_
            open_ = True
            out.append((book, p, k, number, title))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 2, 7, 1000])
def test_chapters_do_not_depend_on_ranges(spark, monkeypatch, span):
    monkeypatch.setattr(ranges, "SPAN", span)
    rows = made_blocks(span)
    found = chapters.chapter_blocks(spark.createDataFrame(rows, BLOCKS)).select("book_id", "page_number", "block_no", "chapter_no", "chapter_title")
    assert sorted(map(tuple, found.collect()), key=str) == plain_chapters(rows)


@pytest.mark.parametrize("span", [1, 3, 100])
def test_running_sums_do_not_depend_on_ranges(spark, monkeypatch, span):
    monkeypatch.setattr(ranges, "SPAN", span)
    r = random.Random(span)
    rows = [(f"g{g}", n, r.randint(0, 5)) for g in range(4) for n in r.sample(range(200), 50)]
    found = {(x.g, x.n): (x.before, x.all) for x in ranges.running(spark.createDataFrame(rows, "g string, n int, v int"), "g", "n", F.col("v"), "before", "all").collect()}
    for g, n, _ in rows:
        assert found[g, n] == (sum(v for h, m, v in rows if h == g and m < n), sum(v for h, m, v in rows if h == g))
    assert len(found) == len(rows)


def test_progress_of_a_book(spark, monkeypatch):
    monkeypatch.setattr(ranges, "SPAN", 2)
    found = sorted(tuple(x) for x in chapters.progress(spark.createDataFrame([("b", n) for n in (1, 2, 3, 7, 9, 12, 13)], "book_id string, page_number int")).collect())
    whole = [100 * k // 7 for k in range(8)]
    assert [x[2] for x in found] == whole[1:] and [x[3] for x in found] == [b - a for a, b in zip(whole, whole[1:])]


def test_a_giant_book_is_spread_over_all_tasks(spark, monkeypatch):
    """One book has 90 % of all pages: after each shuffle the fullest task has less than twice the median's rows."""
    monkeypatch.setattr(ranges, "SPAN", 64)
    pages = spark.range(1, 200_001).selectExpr("if(id % 10 = 0, concat('b', id % 100), 'giant') AS book_id", "CAST(id AS int) AS page_number", "1 AS block_no", "if(id % 97 = 0, 'heading', 'paragraph') AS role", "concat('text ', id) AS text")
    found = chapters.chapter_blocks(pages)
    dealt = pages.withColumn("_span", ranges.span_of(F.col("page_number"))).repartition(16, "book_id", "_span").groupBy(F.spark_partition_id()).count()
    rows = sorted(r[1] for r in dealt.collect())
    assert len(rows) == 16 and rows[-1] < 2 * rows[8]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(book_id" in plan and found.where("book_id = 'giant'").agg(F.max("chapter_no")).first()[0] == 200_000 // 97 - 200_000 // 970 + 1
