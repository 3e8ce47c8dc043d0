import math
from collections import Counter

import corpus_pipeline
import pytest
from helpers import SCHEMA, WORD, edge_table, prose
from test_mixing_sharding import plain_targets
from test_near import plain_similar_groups

from quirelake.llm import langid, secrets
from quirelake.llm.mixing import id_hash
from quirelake.llm.pieces import codec
from quirelake.llm.queries import default_vocabulary


def documents():
    rows = [(i, prose(i, 12 + i % 30), "en", f"s{i % 4}", 1) for i in range(80)]
    rows += [(100 + i, rows[3][1], "en", "s1", 1) for i in range(15)]  # copies
    rows += [(200, f'{rows[5][1]} token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" {prose(77, 9)}', "en", "s2", 1), (201, "12 34 !!", "en", "s0", 1), (202, None, None, "s0", 1), (203, "", "en", None, 1)]
    return rows


def test_run_against_brute_force(spark, tmp_path):
    rows = documents()
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # Language: what has a letter stays. Groups: the smallest id stays. Secrets are replaced.
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    parts = plain_similar_groups([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if parts[r[0]] == r[0]]
    text = {r[0]: secrets.default_scanner().redact(r[1]) for r in kept}
    assert "[ASSIGNED]" in text[200]
    # Mix: thresholds on the hash, tried one after another.
    source, size = {r[0]: r[3] for r in kept}, {i: len(WORD.findall(t)) for i, t in text.items()}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    want = plain_targets(total)
    ids = spark.createDataFrame([(i,) for i in text], "doc_id long")
    key = {r.doc_id: r.h for r in ids.select("doc_id", id_hash(ids.doc_id).alias("h")).collect()}
    copies = {}
    for s in total:
        passes = math.floor(want[s] / total[s])
        rest, best, run = want[s] - passes * total[s], 0, 0
        mine = sorted((i for i in text if source[i] == s), key=key.get)
        for k, i in enumerate(mine, 1):
            run += size[i]
            if abs(run - rest) < abs(sum(size[j] for j in mine[:best]) - rest):
                best = k
        copies |= {i: passes + (i in mine[:best]) for i in mine}
    tool = codec(default_vocabulary()).library
    expected = sorted((i, tool.encode(text[i], add_eos=True)) for i in text for _ in range(copies[i]))
    assert sorted((r.doc_id, r.ids) for r in found) == expected


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "remove_secrets", "mix_sources", "tokenize"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.count() > 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = corpus_pipeline.language_id(spark, docs, sf_dir)
    gone = docs.join(left.select("doc_id"), "doc_id", "left_anti")
    assert gone.where("text RLIKE '[a-zA-Z]{3}'").count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_edge_tables(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = edge_table(spark).selectExpr(*[c.split()[0] for c in SCHEMA.split(", ")])
    stage(spark, df, sf_dir).collect()
    assert stage(spark, df.limit(0), sf_dir).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_clashing_columns_stay(spark, sf_dir, name):
    """Extra columns named like what the stages use inside keep their values."""
    df = edge_table(spark).where("doc_id IS NOT NULL")
    for c in ("mix_plan", "mix_copy", "mix_plan_source", "plan", "of_source", "near_key", "near_whole", "named", "text_key", "part", "node", "first", "n", "last", "source_size", "target", "copies"):
        df = df.selectExpr("*", f"'clash' AS {c}")
    out = dict(corpus_pipeline.STAGES)[name](spark, df, sf_dir)
    if name == "tokenize":
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == df.count()
        return
    assert out.columns == df.columns
    rows = out.collect()
    assert rows and all(r[c] == "clash" for r in rows for c in df.columns[5:])


def test_dedup_of_repeated_rows(spark, sf_dir):
    rows = [(1, "one text that is here", "en", "a", 1)] * 3 + [(None, "row without id", "en", "a", 1), (4, None, None, None, None), (5, "", "en", None, 0)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert sorted((r.doc_id or -1) for r in left) == [-1, 1, 4]


def test_dedup_of_ids_on_several_texts(spark, sf_dir):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = lambda rows: sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA), sf_dir).collect())
    assert near([(5, a), (5, b)]) == sorted([(5, a), (5, b)])
    assert near([(3, a), (5, a), (5, b)]) == sorted([(3, a), (5, b)])
    assert near([(5, a), (5, a.upper()), (6, c), (7, c + " end")]) == sorted([(5, min(a, a.upper(), key=lambda t: kept_key(spark, t))), (6, c)])


def kept_key(spark, text):
    from pyspark.sql import functions as F

    from quirelake.llm.near import text_key

    return spark.range(1).select(text_key(F.lit(text)).alias("k")).first().k


def test_rejection_threshold_is_used(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 8), "en" if i % 2 else "fr", "a", 1) for i in range(40)], SCHEMA)
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.language_id(spark, docs, sf_dir).count() == 0
    assert langid.UND == "und"
