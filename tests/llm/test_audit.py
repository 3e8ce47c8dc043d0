import random
from itertools import permutations

import numpy as np
import pytest
from helpers import SCHEMA, WORD, edge_rows, edge_table

from quirelake.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def plain_masks(rows):
    """(id, part, letters failed) by the stated conditions."""
    first = {}
    for i, t, _, _, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, _, source, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        failed = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t],
        }
        out.append((i, source or "", {k for k, v in failed.items() if v}))
    return out


def plain_audit(rows, labels):
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, shapley = {}, {}
    masks = plain_masks(rows)
    for part in {p for _, p, _ in masks}:
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                f = [0] * 6
                for i, p, failed in masks:
                    if p != part:
                        continue
                    gone = bool(failed & set(order[: step - 1]))
                    removed = own in failed and not gone
                    for k, x in enumerate((not gone and own not in failed, removed, own in failed and gone, failed == {own}, removed and i in good, removed and i in toxic)):
                        f[k] += x
                out[part, "".join(order), step] = f
                shapley[part, own] = shapley.get((part, own), 0) + f[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found_by(df, labels):
    rows = audit.audit_filters(df, labels).collect()
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(found) == len(rows)
    return found


def made_rows():
    r = random.Random(3)
    words = ["plain", "words", "UPPER", "ca$h", "été", "x", "y1", "y2", "y3", "z" * 30]
    rows = []
    for i in range(300):
        t = r.choice(["\t", " ", "\n"]).join(r.choice(words[: r.randint(1, 10)]) for _ in range(r.choice([3, 49, 50, 51, 80])))
        rows.append((i // 2 if i % 10 == 0 else i, rows[-1][1] if i % 7 == 3 else t, "en", r.choice(["a", "b", None, ""]), 1))
    return rows + [(900, " ".join(f"w{k}" for k in range(50)), "en", "clean", 1), (None, "", "en", "a", 0), (None, "", "en", "a", 0), (901, None, "en", "a", 0), (902, "", "en", "a", 0)]


def test_matrices_have_the_stated_shape():
    m = audit.outcome_matrices(5)
    assert {v.shape for k, v in m.items() if k != "own"} == {(32, 600)} and all(np.issubdtype(v.dtype, np.integer) for v in m.values())
    assert ((m["kept"] + m["removed"] + m["redundant"]).max(axis=0) == 1).all()
    assert (m["removed"].reshape(32, 120, 5).sum(axis=2) == (np.arange(32) > 0)[:, None]).all()  # a failing document goes once in each order


def test_against_brute_force(spark):
    rows = made_rows()
    labels = [(i, i % 3 == 0, i % 5 == 0) for i in range(0, 300, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (900, 1, 0)]
    labels = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels]
    found = found_by(spark.createDataFrame(rows, SCHEMA).repartition(7), spark.createDataFrame(labels, LABELS))
    assert found == plain_audit(rows, labels) and len(found) == 600 * 4


def test_edge_cases(spark):
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, 1)], LABELS).selectExpr("*", "'clash' AS id", "'clash' AS part", "1 AS n")
    df = edge_table(spark).selectExpr("*", "'clash' AS mask", "'clash' AS key", "'clash' AS part", "1 AS words", "1 AS good")
    assert found_by(df, labels) == plain_audit(edge_rows(), [(5, 1, 1)])


def test_ids_of_another_type_and_invalid_text(spark):
    df = spark.createDataFrame([("b", bytearray(b"x \xff"), "s"), ("a", bytearray("x �".encode()), "s"), ("c", None, "s")], "doc_id string, raw binary, source string")
    found = {r.filter_order + str(r.step): r for r in audit.audit_filters(df.selectExpr("doc_id", "CAST(raw AS string) AS text", "source"), spark.createDataFrame([], "doc_id string, quality int, toxic int")).collect()}
    assert found["EABCD1"].removed == 1 and found["EABCD1"].kept == 2


def test_copies_of_a_third_of_all_rows_are_no_single_tasks_work(spark):
    n = 6000
    df = spark.range(n).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the one text', concat('text ', id)) AS text", "'s' AS source")
    masks = audit.failure_masks(df)
    assert masks.where("mask >= 16").count() == n // 3 - 1
    rows = df.selectExpr("doc_id", "'k' AS key").repartition(64, "doc_id", "key")  # as the join with the first copies deals rows out
    assert max(len(x) for x in rows.rdd.glom().collect()) < n / 20


@pytest.mark.parametrize("labelled", [True, False])
def test_empty_tables(spark, labelled):
    labels = spark.createDataFrame([(1, 1, 1)] if labelled else [], LABELS)
    assert audit.audit_filters(spark.createDataFrame([], SCHEMA), labels).collect() == []
    if not labelled:
        assert found_by(spark.createDataFrame(edge_rows()[:3], SCHEMA), labels) == plain_audit(edge_rows()[:3], [])


def test_very_long_text(spark):
    text = "Word$ " * 400_000
    found = found_by(spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA), spark.createDataFrame([], LABELS))
    assert found["s", "ABCDE", 2][:4] == (0, 1, 0, 0) and found["s", "BCDEA", 2][2] == 1
