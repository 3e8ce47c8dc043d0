"""Every registered query of the document engine against its SQL, and no rule query without effect."""

import re

import duckdb
import pytest

from quirelake.plans.registry import ORACLES, QUERIES

TABLES = "documents conversations pages customer".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows_of(frame):
    cols = sorted(frame.columns)
    f = frame[cols].astype(object)
    return cols, sorted(map(str, f.where(f.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    assert len(found) > 0
    if name in ORACLES:
        assert rows_of(found) == rows_of(duck.execute(ORACLES[name]).df())


RULES = [n for n in QUERIES if n[0] == "r" and n[1].isdigit()]


@pytest.mark.parametrize("name", RULES)
def test_rule_queries_change_rows(spark, sf_dir, name):
    from quirelake.plans.fixtures import damaged

    changed = QUERIES[name](spark, sf_dir).alias("a").join(damaged(spark, sf_dir).alias("b"), "doc_id").where("a.text <> b.text").count()
    assert changed > 5


def test_paragraphs_are_repaired_alone(spark, sf_dir):
    """The query without SQL: each paragraph by the plain rules."""
    import re

    from test_repair import PAIRS

    from quirelake.plans.fixtures import damaged
    from quirelake.plans.repair_queries import _cases

    def plain(t):
        for k in (0, 1, 2, 3, 4, 5, 6, 7, 3):
            t = PAIRS[k][1](t)
        return t.strip()

    found = {r.doc_id: r.text for r in QUERIES["repair_keep_paragraphs"](spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in damaged(spark, sf_dir).select("doc_id", "text").unionByName(_cases(spark)).collect()}
    assert found.keys() == texts.keys()
    for i, t in texts.items():
        if len(t) < 6000:
            assert found[i] == "\n\n".join(p for p in map(plain, re.split(r"\n\s*\n", t)) if p), i


@pytest.mark.parametrize(("name", "most"), [("roles", 1), ("toc", 4), ("chapter_split", 4), ("chapter_markup", 4), ("navigation", 5), ("book_archives", 5), ("blank_pages", 8), ("manifest", 8)])
def test_inputs_are_scanned_few_times(spark, sf_dir, name, most):
    """Scans of texts; numbers of pages are counted by a scan of two narrow columns for each of them."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert 1 <= len(scans) <= 2 * most + 3 and sum("text#" in s for s in scans) <= most


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["book_id", "chapter_no", "title", "n_blocks", "n_chars"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
