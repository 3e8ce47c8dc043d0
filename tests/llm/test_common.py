"""What all operators do alike: invalid UTF-8, ids of any type, settings of the session."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quirelake.llm import chat, common, covertree, langid, media, mixing, near, ngram, pieces, secrets, sharding, simhash
from quirelake.llm.queries import default_vocabulary

BROKEN = b"good \xff\x80 words api_key = 0123456789abcdef0123 \xc3 end of it"
SHOWN = BROKEN.decode("utf-8", "replace")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", bytearray(BROKEN)), ("b", bytearray(SHOWN.encode())), ("c", bytearray(b"plain words here")), ("d", None), (None, bytearray(b"x"))]
    return spark.createDataFrame(rows, "doc_id string, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))


def by_id(df, key="id"):
    rows = df.collect()
    assert sorted(str(r[key]) for r in rows) == ["None", "a", "b", "c", "d"]
    return {r[key]: r for r in rows}


def test_media(docs):
    rows = by_id(media.probe_media(media.store_texts(docs)))
    stored = BROKEN + bytes(-len(BROKEN) % 64)
    assert rows["a"].n_bytes == len(BROKEN) and rows["a"].tracks[0].payload_sha256 == hashlib.sha256(stored).hexdigest()  # the bytes as they stand


def test_fingerprints(docs):
    rows = by_id(simhash.simhash_groups(docs))
    assert rows["a"].fp == rows["b"].fp and rows["b"].component_id == "a"
    rows = by_id(near.similar_groups(docs))
    assert rows["a"].node == rows["b"].node and rows["b"].component_id == "a"


def test_languages(docs):
    model = langid.train(docs)
    rows = by_id(docs.select("doc_id", model.column(F.col("text")).alias("f")), "doc_id")
    assert rows["a"].f == rows["b"].f and rows["a"].f.lang == "en"


def test_secrets(docs):
    found = {r.id: (r.kind, r.start, r.finding) for r in secrets.scan_secrets(docs).collect()}
    assert found["a"] == found["b"] == ("assigned", SHOWN.index("0123"), "0123456789abcdef0123")
    rows = by_id(docs.select("doc_id", secrets.redacted(F.col("text")).alias("t")), "doc_id")
    assert rows["a"].t == rows["b"].t and rows["d"].t is None


def test_scores(docs):
    rows = by_id(ngram.score_texts(docs, F.lit(ngram.COUNTED)))
    assert tuple(rows["a"])[1:] == tuple(rows["b"])[1:]


def test_pieces(docs):
    rows = by_id(pieces.encode_documents(docs, default_vocabulary()))
    assert rows["a"].ids == rows["b"].ids and rows["a"].decoded == SHOWN


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1]), (None, [1.0, 0.0])], "vec_id string, embedding array<float>")
    assert sorted((str(r.id), r.n_links, r.component_id) for r in covertree.near_vectors(df).collect()) == [("None", 0, None), ("a", 1, "a"), ("b", 1, "a")]


def test_mixing_and_sharding(docs):
    mixed = mixing.with_copies(docs, mixing.mixture(docs), "m")
    rows = by_id(mixed, "doc_id")
    assert rows["a"].m.copies >= 0
    rows = by_id(sharding.shard_rows(docs, shards=2))
    assert rows["a"].size == len(BROKEN) + 1


def test_conversations(spark):
    turns = spark.createDataFrame([("x", "1", "user", bytearray(BROKEN)), ("x", "2", "assistant", bytearray(b"ok")), (None, "1", None, None)], "conv_id string, turn string, role string, raw binary")
    rows = {r.conv_id: r for r in chat.format_conversations(turns.withColumn("text", F.col("raw").cast("string"))).collect()}
    assert chat.read_turns(rows["x"].formatted) == [("user", SHOWN), ("assistant", "ok")] and chat.read_turns(rows[None].formatted) == [("", "")]


def test_batches_are_bounded_unless_chosen(spark):
    common.python_batches(spark)
    assert spark.conf.get(common.BATCH_SETTING).rstrip("b") == str(common.BATCH_BYTES)
    spark.conf.set(common.BATCH_SETTING, "12345")
    common.python_batches(spark)
    assert spark.conf.get(common.BATCH_SETTING).rstrip("b") == "12345"
    spark.conf.set(common.BATCH_SETTING, str(common.BATCH_BYTES))


def test_fresh_names():
    assert common.fresh(["plan", "Plan_", "x"], "plan", "plan", "y") == ["plan__", "plan___", "y"]


def test_workers_keep_one_operators_tables():
    kept = {"one": 1}
    common.keeps("test", kept.clear)
    common.working("test")
    assert kept
    common.working("another")
    assert not kept
    common._CLEARERS.pop("test")
