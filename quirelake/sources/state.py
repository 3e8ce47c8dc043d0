"""State files of interrupted conversions: JSON documents as checkpoint rows, and back.

A document is one value, or a row for each of its parts in order: a book's document holds each
page's text four times, so that of a large book is only ever written and read part by part.
For the same reason parts are compressed, each by itself, before they are dealt out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable
from quirelake.operators.rows import stacked

#: Documents whose heads are sent to every task, at most.
SENT_DOCUMENTS = 1_000_000
#: Bytes of pages that a task hands on at once, about.
HANDED = 1 << 20
#: Place of a document's opening and, with the other sign, of its end.
OPENING = -(1 << 40)
#: Strings, marks, other values and white space of JSON.
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]:,]|[^\s"{}\[\]:,]++|\s++', re.S)
BLOCK = "struct<text:string,role:string,bold:boolean,italic:boolean>"
COLUMNS = ("page_number", "raw_text", "repaired_text", "layout", "blocks", "raw_blocks", "repair_signature", "complete")


def state_pages(documents: DataFrame, errors: bool = False) -> DataFrame:
    """Checkpoint rows of state documents (``value``): one for each page.

    A document is parsed once, as a variant, and each page and field of it by itself: what has
    another type than it should is null, its page incomplete, so that it is made again, and
    all other pages stay as they are. The page's number is its key. Pages that aren't objects
    are left out, and so are texts that aren't JSON; with ``errors`` both have rows, too,
    and a column says what is wrong with a row.
    """
    parsed = documents.select(F.try_parse_json("value").alias("v"))
    book = parsed.select("v", F.try_variant_get("v", "$.source_hash", "string").alias("source_hash"), F.try_variant_get("v", "$.pages", "map<string,variant>").alias("pages"))
    each = book.select("source_hash", F.explode_outer("pages").alias("key", "page"), F.when(F.col("v").isNull(), "not JSON").when(F.col("pages").isNull(), "no pages").alias("wrong"))
    return _typed(each, errors)


def _typed(each: DataFrame, errors: bool) -> DataFrame:
    """Checkpoint rows of pages (source_hash, key, page as a variant, wrong)."""
    kinds = {c.split(":", 1)[0]: c.split(":", 1)[1] for c in ("raw_text:string", "repaired_text:string", "layout:string", f"blocks:array<{BLOCK}>", f"raw_blocks:array<{BLOCK}>", "repair_signature:string", "complete:boolean")}
    shape = F.schema_of_variant
    is_object = F.startswith(shape(F.col("page")), F.lit("OBJECT"))
    given = {c: F.variant_get("page", f"$.{c}", "variant") for c in kinds}
    # Anything can be read as a string, so a text must be one.
    typed = {c: F.when((shape(given[c]) == "STRING") if kind == "string" else F.lit(True), F.try_variant_get("page", f"$.{c}", kind)) for c, kind in kinds.items()}
    odd = [F.when(given[c].isNotNull() & ~F.is_variant_null(given[c]) & typed[c].isNull(), c) for c in kinds]
    number = F.col("key").try_cast("int")
    wrong = F.coalesce("wrong", F.when(F.col("key").isNull(), "no pages").when(~is_object, "not an object").when(number.isNull(), "no page number"), F.nullif(F.concat_ws(", ", *odd), F.lit("")))
    rows = each.select("source_hash", number.alias("page_number"), *[value.alias(c) for c, value in typed.items()], is_object.alias("object"), wrong.alias("error"))
    rows = rows.withColumn("complete", F.when(F.col("error").isNotNull(), False).otherwise(F.coalesce("complete", F.lit(True))))
    out = ["source_hash", *COLUMNS]
    return rows.select(*out, "error") if errors else rows.where("object AND page_number IS NOT NULL").select(*out)


def _tokens(parts: Iterable[str]) -> Iterator[str]:
    """Tokens of a document that comes in parts; ValueError where a string has no end."""
    held = ""
    for part in parts:
        held, at = held + part, 0
        while (m := _TOKEN.match(held, at)) and (m.end() < len(held) or m[0] in "{}[]:,"):
            at = m.end()
            if not m[0].isspace():
                yield m[0]
        held = held[at:]
    at = 0
    while at < len(held):
        if (m := _TOKEN.match(held, at)) is None:
            raise ValueError("a string has no end")
        at = m.end()
        if not m[0].isspace():
            yield m[0]


def _members(tokens: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Names and first tokens of an object's members, from behind its opening; whoever asks for the next one has taken the value's other tokens."""
    names: set[str] = set()
    token = next(tokens)
    while token != "}" or names:
        name = json.loads(token)
        if not isinstance(name, str) or name in names or next(tokens) != ":":
            raise ValueError("not an object's member")
        names.add(name)
        yield name, next(tokens)
        if (mark := next(tokens)) == "}":
            return
        if mark != ",":
            raise ValueError("no comma")
        token = next(tokens)


def _value(first: str, tokens: Iterator[str]) -> str:
    """The text of the value that begins with a token."""
    out, depth = [first], (first in "{[") - (first in "}]:,")
    if depth < 0:
        raise ValueError("no value")
    while depth:
        out.append(token := next(tokens))
        depth += (token in "{[") - (token in "}]")
    return "".join(out)


def scan_document(parts: Iterable[str]) -> Iterator[tuple[str | None, str | None, str | None, str | None]]:
    """``(key, page, None, None)`` for each page of a document in parts, as text that is not parsed, and at last ``(None, None, source hash, what is wrong)``. One page is held at a time."""
    tokens, found, paged = _tokens(parts), None, False
    try:
        first = next(tokens)
        if first != "{":
            json.loads(_value(first, tokens))
        else:
            for name, token in _members(tokens):
                if name == "pages" and token == "{":
                    paged = True
                    for key, opening in _members(tokens):
                        yield key, _value(opening, tokens), None, None
                    continue
                text = _value(token, tokens)
                value = json.loads(text)
                if name == "source_hash":
                    found = value if value is None or isinstance(value, str) else text
        wrong = "not JSON" if next(tokens, None) is not None else None if paged else "no pages"
    except (ValueError, StopIteration, RuntimeError):  # a generator tells a text that ends too early by RuntimeError
        wrong = "not JSON"
    yield None, None, None if wrong == "not JSON" else found, wrong


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document, place, part) with the part compressed, its length first."""
    codec = pa.Codec("zstd")
    for batch in batches:
        texts = batch.column("part").cast(pa.binary())
        parts = [None if t is None else len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in (texts[k].as_buffer() if texts[k].is_valid else None for k in range(len(texts)))]
        yield pa.RecordBatch.from_arrays([batch.column("document"), batch.column("place"), pa.array(parts, pa.binary())], names=["document", "place", "part"])


def _unpacked(part: pa.Scalar) -> str:
    if not part.is_valid:
        return ""
    packed = part.as_buffer()
    size = int.from_bytes(packed.slice(0, 8).to_pybytes(), "little")
    return pa.Codec("zstd").decompress(packed.slice(8), size, asbytes=True).decode() if size else ""


def _scanned(heads: bool):
    """Rows ``document, key, page, source_hash, wrong`` of :func:`scan_document` over packed parts in order: of the documents' heads, or of their pages."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.column("document").slice(k, 1), batch.column("part")[k]) for batch in batches for k in range(batch.num_rows))
        ahead = next(rows, None)

        def of_document(name: pa.Array) -> Iterator[str]:
            nonlocal ahead
            while ahead is not None and ahead[0].equals(name):
                yield _unpacked(ahead[1])
                ahead = next(rows, None)

        def handed(name: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            names = pa.concat_arrays([name] * len(found))
            return pa.RecordBatch.from_arrays([names, *[pa.array(column, pa.string()) for column in zip(*found)]], names=["document", "key", "page", "source_hash", "wrong"])

        while ahead is not None:
            name = ahead[0]
            mine, found, size = of_document(name), [], 0
            for row in scan_document(mine):
                if (row[0] is None) != heads:
                    continue
                found.append(row)
                size += len(row[1] or "") + 64
                if size > HANDED:
                    yield handed(name, found)
                    found, size = [], 0
            if found:
                yield handed(name, found)
            for _ in mine:  # what follows a mistake
                pass

    return step


def pages_of_parts(parts: DataFrame, errors: bool = False) -> DataFrame:
    """:func:`state_pages` of documents whose texts are rows (document, place, part): a task goes through a document's parts in order and hands on a few pages at a time.

    Parts are dealt out and put in order once, compressed, and kept so: a document is gone
    through for its head, which its end decides, and again for its pages. A page's own text
    that isn't JSON makes that page wrong, no other one.
    """
    kind, place = (parts.schema[c].dataType.simpleString() for c in ("document", "place"))
    packed = parts.select("document", "place", "part").mapInArrow(_packed, f"document {kind}, place {place}, part binary")
    dealt = durable(packed.repartition("document").sortWithinPartitions("document", "place"))
    row = f"document {kind}, key string, page string, source_hash string, wrong string"
    heads = durable(dealt.mapInArrow(_scanned(True), row).select("document", "source_hash", "wrong"))
    texts = dealt.mapInArrow(_scanned(False), row).select("document", "key", F.try_parse_json("page").alias("page"))
    sent = F.broadcast(heads) if heads.count() <= SENT_DOCUMENTS else heads
    each = texts.join(sent.where("wrong IS NULL").select(F.col("document").alias("of"), "source_hash"), F.col("document").eqNullSafe(F.col("of"))).select("source_hash", "key", "page", F.when(F.col("page").isNull(), "not JSON").alias("wrong"))
    none = heads.where("wrong IS NOT NULL").select("source_hash", F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("page"), "wrong")
    return _typed(each.unionByName(none), errors)


def read_state(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """:func:`state_pages` of state files, whole; the files' own source hash is taken as it stands."""
    return state_pages(spark.read.text(path, wholetext=True), errors)


def _page() -> Column:
    parts = lambda c: F.transform(c, lambda b: F.struct(*[b[n].alias(n) for n in ("text", "role", "bold", "italic")])).alias(c)
    return F.struct(*[parts(c) if c in ("blocks", "raw_blocks") else F.col(c) for c in COLUMNS])


def state_json(checkpoint: DataFrame) -> DataFrame:
    """``source_hash, json``: the state document of each source, its pages in order, as one value; :func:`state_parts` are the same text for any size."""
    entries = F.array_sort(F.collect_list(F.struct("page_number", _page().alias("page"))))
    pages = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["page_number"].cast("string"), e["page"])))
    return checkpoint.groupBy("source_hash").agg(pages.alias("pages")).select("source_hash", F.to_json(F.struct("source_hash", "pages"), {"ignoreNullFields": "false"}).alias("json"))


def state_parts(checkpoint: DataFrame) -> DataFrame:
    """``document, place, part``: the state document of each source, named by it, as a row for its opening, each page and its end; the parts in order of place are the text of :func:`state_json`."""
    name = F.regexp_replace(F.to_json(F.struct("source_hash"), {"ignoreNullFields": "false"}), r"\}\z", "")
    sources = durable(checkpoint.groupBy("source_hash").agg(F.min("page_number").cast("long").alias("first")))
    sent = F.broadcast(sources) if sources.count() <= SENT_DOCUMENTS else sources  # pages stay where they are
    frame = F.array(F.struct(F.lit(OPENING).alias("place"), F.concat(name, F.lit(',"pages":{')).alias("part")), F.struct(F.lit(-OPENING).alias("place"), F.lit("}}").alias("part")))
    ends = sources.select(F.col("source_hash").alias("document"), F.explode(frame).alias("f")).select("document", "f.*")
    place = F.col("page_number").cast("long")
    entry = F.concat(F.lit('"'), F.col("page_number").cast("string"), F.lit('":'), F.to_json(_page(), {"ignoreNullFields": "false"}))
    pages = checkpoint.select(F.col("source_hash").alias("document"), place.alias("place"), entry.alias("entry"))
    pages = pages.join(sent, F.col("document").eqNullSafe(F.col("source_hash")))
    return stacked(ends, pages.select("document", "place", F.concat(F.when(F.col("place") > F.col("first"), ",").otherwise(""), "entry").alias("part")), key="document")
