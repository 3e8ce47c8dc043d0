"""The stream of pages against the batch analysis, whatever the order of the pages."""

import random

import pytest
from pyspark.sql import functions as F

from quirelake.operators import layout
from quirelake.streaming import page_stream


def made_pages(seed=4):
    r = random.Random(seed)
    rows = []
    for b, n in (("one", 13), ("two", 4), ("three", 1)):
        for p in range(1, n + 1):
            blocks = [(0, f"Journal {p} of {b}", 200.0, 10.0, 400.0, 40.0, False, False)] if r.random() < 0.8 else []
            if p % 5:
                blocks += [(k + 1, r.choice(["Plain text", "CHAPTER", "a\tb", f"x {p}.{k}"]), *((30.0, 160.0 + 40 * k, 270.0, 190.0 + 40 * k) if k % 2 else (330.0, 160.0 + 40 * k, 570.0, 190.0 + 40 * k)), k == 2, False) for k in range(r.randint(1, 11))]
            blocks.append((99, f"- {p} -", 290.0, 800.0, 310.0, 820.0, False, False))
            rows.append((b, p, n, 600.0, 840.0, [] if (b, p) == ("one", 3) else blocks))
    return rows


@pytest.mark.parametrize("order", [1, 2])
def test_rows_of_the_batch(spark, tmp_path, order):
    rows = made_pages()
    whole = spark.createDataFrame(rows, page_stream.PAGES)
    blocks = whole.select("book_id", "page_number", F.explode("blocks").alias("b")).select("book_id", "page_number", "b.*")
    kept, flags = layout.analyse(blocks, whole.select("book_id", "page_number", "width", "height"))
    want = sorted(tuple(r) for r in kept.select("book_id", "page_number", "block_no", "text", "role", "bold", "italic").collect())
    sent = rows + rows[:4]  # some pages are sent twice
    random.Random(order).shuffle(sent)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def go(part):
        spark.createDataFrame(part, page_stream.PAGES).coalesce(1).write.mode("append").parquet(source)
        stream = page_stream.analysed_pages(spark.readStream.schema(page_stream.PAGES).parquet(source))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).format("parquet").option("path", out).start().awaitTermination(300)
        return spark.read.parquet(out)

    last = max(k for k, row in enumerate(sent) if row[0] == "one" and row not in sent[:k])
    first = go(sent[:last])
    assert first.where("book_id = 'one'").count() == 0  # its last page hasn't come
    found = go(sent[last:])
    assert sorted(tuple(r) for r in found.select("book_id", "page_number", F.explode("blocks").alias("b")).select("book_id", "page_number", "b.*").collect()) == want
    assert sorted(map(tuple, found.select("book_id", "page_number", "layout", "is_blank").collect())) == sorted(map(tuple, flags.collect()))
    assert go(rows[:2]).count() == len(rows)  # a page that comes again after its book gives nothing
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "progress"))
    assert state.count() == 0
