"""Layout of a stream of pages: running headers, page numbers and blank pages of each book, as soon as its last page has come.

Whether a margin text is a running header depends on all pages of a book, so a page can't be
judged when it comes. Everything that a page tells alone (roles, layout, header keys) is
computed by built-in functions before; the state of a book holds the counts of its margin
texts and the pages that wait. With the last page the book is released page by page and its
state dropped but for a mark, so a page that is sent again is passed over. The order in which
pages come doesn't matter, and the rows are those of the batch ``analyse``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirelake.operators.layout import LEAST_COLUMN_BLOCKS, block_role, header_key, in_margin, is_page_number

#: Rows of the stream: a page with its blocks and the number of pages of its book.
PAGES = "book_id string, page_number int, pages int, width double, height double, blocks array<struct<block_no:int,text:string,x0:double,y0:double,x1:double,y1:double,bold:boolean,italic:boolean>>"
BLOCKS = "array<struct<block_no:int,text:string,role:string,bold:boolean,italic:boolean>>"
RELEASED = "book_id string, page_number int, layout string, is_blank boolean, kept string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepared(pages: DataFrame) -> DataFrame:
    """What a page tells alone: its layout, the keys of its margin texts, and its blocks without page numbers as JSON, each with its role and key."""
    blocks, width, height = F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType)), F.col("width"), F.col("height")
    centre = lambda b: (b["x0"] + b["x1"]) / 2
    side = lambda test: F.size(F.filter(blocks, test))
    n, left, right = F.size(blocks), side(lambda b: centre(b) < width * 0.45), side(lambda b: centre(b) > width * 0.55)
    multi = (n >= LEAST_COLUMN_BLOCKS) & (left >= 3) & (right >= 3) & (n - left - right <= n * 0.25)
    headers = F.transform(F.filter(blocks, lambda b: in_margin(b["y0"], b["y1"], height)), lambda b: header_key(b["text"]))
    body = F.filter(blocks, lambda b: ~is_page_number(b["text"]))
    described = F.transform(body, lambda b: F.struct(header_key(b["text"]).alias("header"), b["block_no"].alias("block_no"), b["text"].alias("text"), block_role(b["text"], b["y0"], height).alias("role"), b["bold"].alias("bold"), b["italic"].alias("italic")))
    return pages.select("book_id", "page_number", "pages", F.when(multi, "multi-column").otherwise("single-column").alias("layout"), headers.alias("headers"), F.to_json(described, {"ignoreNullFields": "false"}).alias("body"))


class BookPages(StatefulProcessor):
    """Pages of a book that wait, and the counts of its margin texts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "page_number int", "layout string, body string")
        self.counts = handle.getMapState("counts", "header string", "n int")
        self.come = handle.getValueState("come", "n int, released boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        come, released = self.come.get() if self.come.exists() else (0, False)
        if released:
            return
        pages = 0
        for batch in rows:
            for number, of, layout, headers, body in zip(batch["page_number"], batch["pages"], batch["layout"], batch["headers"], batch["body"]):
                page, pages = (int(number),), int(of)
                if self.waiting.containsKey(page):
                    continue
                come += 1
                self.waiting.updateValue(page, (layout, body))
                for h in headers:
                    n = self.counts.getValue((h,))[0] if self.counts.containsKey((h,)) else 0
                    self.counts.updateValue((h,), (n + 1,))
        if come < pages:
            self.come.update((come, False))
            return
        repeated = {h for (h,), (n,) in self.counts.iterator() if n >= max(3, pages // 4)}
        for (number,), (layout, body) in self.waiting.iterator():
            kept = [b for b in json.loads(body) if b.pop("header") not in repeated]
            yield pd.DataFrame([(key[0], number, layout, not kept, json.dumps(kept))], columns=["book_id", "page_number", "layout", "is_blank", "kept"])
        self.waiting.clear()
        self.counts.clear()
        self.come.update((come, True))

    def close(self) -> None:
        pass


def analysed_pages(pages: DataFrame) -> DataFrame:
    """``book_id, page_number, layout, is_blank, blocks`` of a stream of pages (PAGES), book by book; blocks are those that are kept, with their roles.

    Sets the session's state store to the one that such state needs. A book whose pages don't
    all come waits for ever; pages without blocks must be sent too.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    released = prepared(pages).groupBy("book_id").transformWithStateInPandas(statefulProcessor=BookPages(), outputStructType=RELEASED, outputMode="Append", timeMode="None")
    return released.select("book_id", "page_number", "layout", "is_blank", F.from_json("kept", BLOCKS).alias("blocks"))
