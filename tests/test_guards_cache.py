import json
import sys
from difflib import SequenceMatcher

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quirelake.functions import guards, providers
from quirelake.operators import cache
from quirelake.sources import state
from quirelake.sources.config import ModelSettings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
RULES = "“Merhaba dünya” dedi ve sonra eve gitti çocuk."
T0, T1 = guards.TOKENS[:2]
PROTECTED = RULES.replace("“", T0).replace("”", T1)


def decide(spark, answer, rules=RULES, lexicon=("merhaba", "dünya", "kadın")):
    pairs = spark.createDataFrame([(1, rules, answer)], "key long, rules string, answer string")
    words = spark.createDataFrame([(w,) for w in lexicon], "word string")
    row = guards.decide(pairs, words).first()
    return row.text, row.reject_reason


@pytest.mark.parametrize(
    ("answer", "reason"),
    [(PROTECTED, None), (f"```text\n{PROTECTED}\n```", None), (f"<think>hm\nx</think>\n{PROTECTED}", None), (None, "unavailable"), (RULES, "tokens"), (f"{T0}{T1}", "length"), (PROTECTED + " ek" * 9, "length"), (f"{T0}bambaşka sözler{T1} yazıldı burada hepsi yeni uydurma kelimeler", "similarity"), (PROTECTED.replace("çocuk", "zzyzx"), "vocabulary"), (PROTECTED.replace("çocuk", "kadın"), None), (PROTECTED.replace("gitti", "gitTi"), "case"), (PROTECTED.replace(" ve ", "« ve "), "quotes")],
)
def test_decisions(spark, answer, reason):
    text, got = decide(spark, answer)
    assert got == reason
    assert text == (RULES if reason else guards_clean(answer))


def guards_clean(answer):
    inner = answer.split("</think>\n")[-1].removeprefix("```text\n").removesuffix("\n```")
    return inner.replace(T0, "“").replace(T1, "”")


def test_empty_and_blank(spark):
    assert decide(spark, "``` ```", "plain text") == ("plain text", "empty")
    assert decide(spark, "anything", " \n ") == ("", "blank")


def test_fence_before_think_stays(spark):
    df = spark.createDataFrame([("<think>x</think>```\nbody\n```",)], "t string")
    assert df.select(guards.clean_output(F.col("t"))).first()[0] == "```\nbody"


def test_similarity_is_the_librarys(spark):
    pairs = [("abcd", "bcde"), ("", ""), ("same", "same"), ("kitap", "katip"), (None, "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(guards.similarity("a", "b").alias("s")).collect()]
    assert got == [None if a is None else SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]


def test_matcher_is_the_librarys(monkeypatch):
    import random

    from quirelake.functions import similar

    monkeypatch.setattr(similar, "SMALL", 30)  # nearly all parts are found by hashes
    r = random.Random(5)
    for k in range(600):
        letters = "ab" if k % 3 else "abcdefğ "
        a = "".join(r.choice(letters) for _ in range(r.randint(0, 70)))
        b = list(a)
        for _ in range(r.randint(0, 20)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randint(0, 3)] = [r.choice(letters) for _ in range(r.randint(0, 3))]
        b = "".join(b)
        want = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert similar.ratio(a, b) == pytest.approx(want, abs=1e-12)
        for least in (0.3, 0.72, want):
            assert (similar.decided(a, b, least) < least) == (want < least)


def test_long_texts_are_decided_early():
    """Shuffled words have every letter in common; whole texts near the threshold are decided rightly."""
    import random
    import time

    from quirelake.functions import similar

    r = random.Random(2)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    text = [r.choice(words) for _ in range(16_000)]
    a, b = " ".join(text), " ".join(r.sample(text, len(text)))
    began = time.process_time()
    assert similar.decided(a, b, 0.72) < 0.72 and time.process_time() - began < 1.5 and len(a) > 90_000
    for cut in (10_000, 30_000, 60_000):
        c = a[:cut] + b[: len(a) - cut]
        assert (similar.decided(a[:40_000], c[:40_000], 0.72) < 0.72) == (similar.ratio(a[:40_000], c[:40_000]) < 0.72)


def test_runs_are_found_once(monkeypatch):
    """A text with hundreds of changed marks costs one search of its runs, not a search of its length for each piece; repeated lines, whose places are too many, are searched in longer runs."""
    import random
    import time

    from quirelake.functions import similar

    r = random.Random(3)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    a = " ".join(r.choice(words) + (" “" if k % 9 == 0 else "") for k in range(6000))
    began = time.process_time()
    assert similar.matched(a, a.replace("“", "")) == len(a) - a.count("“") and time.process_time() - began < 0.6  # 1.7 s before
    monkeypatch.setattr(similar, "SMALL", 30)
    for run, places in ((1, 1), (2, 4), (3, 1), (16, 4)):
        monkeypatch.setattr(similar, "RUN", run)
        monkeypatch.setattr(similar, "PLACES", places)
        for _ in range(60):
            lines = ["".join(r.choice("abcdefğ ") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 12))]
            a = "".join(r.choice(lines) for _ in range(r.randint(0, 60)))
            b = list(r.choice((a, a + " " + a, a[::-1])))
            for _ in range(r.randint(0, 12)):
                at = r.randrange(len(b) + 1)
                b[at : at + r.randint(0, 6)] = [r.choice("abc “") for _ in range(r.randint(0, 3))]
            b = "".join(b)
            want = SequenceMatcher(None, a, b, autojunk=False).ratio()
            assert similar.ratio(a, b) == pytest.approx(want, abs=1e-12)
            for least in (0.3, 0.72, want):
                assert (similar.decided(a, b, least) < least) == (want < least)


def test_similarity_of_whole_documents(spark, sf_dir):
    from quirelake.plans.book_queries import similarity_guard
    from quirelake.plans.fixtures import model_pairs

    found = {r.key: r.ratio for r in similarity_guard(spark, sf_dir).collect()}
    pairs = [r for r in model_pairs(spark, sf_dir).where("answer IS NOT NULL").collect()]
    assert found.keys() == {r.key for r in pairs}
    for r in pairs:
        if len(r.rules) < 2500:
            assert found[r.key] == pytest.approx(SequenceMatcher(None, r.rules, r.answer, autojunk=False).ratio(), abs=1e-8)
    assert max(len(r.rules) for r in pairs) > 10_000


class Shout:
    def __init__(self, fail=False, up=True):
        self.fail, self.up = fail, up

    def available(self):
        return self.up

    def correct(self, text):
        if self.fail or "boom" in text:
            raise RuntimeError("no")
        return text.upper()


def test_models_in_partitions(spark):
    df = spark.createDataFrame([(1, "a “b”"), (2, "boom"), (3, "")], "key long, rules string")
    ask = lambda make: {r.key: r.answer for r in providers.ask_model(df, make).collect()}
    assert ask(Shout) == {1: f"A {T0}B{T1}", 2: None, 3: None}
    assert ask(lambda: Shout(up=False)) == {1: None, 2: None, 3: None}


def test_request_payloads(monkeypatch):
    sent = {}

    class Reply:
        status = 200

        def __init__(self, body):
            self.body = body

        def read(self):
            return json.dumps(self.body).encode()

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return None

    def urlopen(request, timeout):
        sent.update(url=getattr(request, "full_url", request), timeout=timeout)
        if request.data:
            sent.update(body=json.loads(request.data), auth=request.get_header("Authorization"))
        return Reply({"response": " fixed ", "choices": [{"message": {"content": " fixed "}}]})

    monkeypatch.setattr(providers.urllib.request, "urlopen", urlopen)
    s = ModelSettings(provider="ollama", base_url="http://host/", model="m", timeout_seconds=9)
    model = providers.make_model(s)
    assert model.available() and sent["url"] == "http://host/api/tags"
    assert model.correct("metin") == "fixed" and sent["url"] == "http://host/api/generate" and sent["timeout"] == 9
    assert (sent["body"]["prompt"], sent["body"]["stream"], sent["body"]["think"], sent["body"]["options"]) == ("metin", False, False, {"temperature": 0, "num_ctx": 4096})
    chat = providers.make_model(ModelSettings(provider="openai-compatible", base_url="http://host", api_key="k", model="m"))
    assert chat.correct("metin") == "fixed" and sent["auth"] == "Bearer k" and sent["body"]["messages"][1] == {"role": "user", "content": "metin"}
    assert not providers.make_model(ModelSettings()).available()


def test_command_model():
    model = providers.make_model(ModelSettings(provider="local", command=("python", "-c", "import sys; print(sys.stdin.read().upper())")))
    assert model.available() and model.correct("abc") == "ABC"
    with pytest.raises(RuntimeError):
        providers.make_model(ModelSettings(provider="local", command=("false",))).correct("x")


def page(n, signature, blocks, complete=True, raw="Bug ün", text="stored"):
    item = [{"text": t, "role": r, "bold": None, "italic": None} for t, r in blocks]
    return ("h", n, raw, text, "single-column", item, [{"text": "a- b\n c", "role": None, "bold": True, "italic": None}] if blocks else [], signature, complete)


SCHEMA = "source_hash string, page_number int, raw_text string, repaired_text string, layout string, blocks array<struct<text:string,role:string,bold:boolean,italic:boolean>>, raw_blocks array<struct<text:string,role:string,bold:boolean,italic:boolean>>, repair_signature string, complete boolean"


def test_reuse(spark):
    table = spark.createDataFrame([page(1, "now", [("one", None), (None, "table")]), page(2, "now", []), page(3, "old", [("x", None)]), page(4, "old", []), page(5, "now", [("y", None)], complete=False)], SCHEMA)
    pages = spark.createDataFrame([("h", n) for n in range(1, 7)], "source_hash string, page_number int")
    found = {r.page_number: (r.action, [tuple(b) for b in r.blocks] if r.blocks is not None else None) for r in cache.reuse(pages, table, "now").collect()}
    plain = lambda t: (t, "paragraph", False, False)
    assert found == {1: ("reused", [plain("one"), ("", "table", False, False)]), 2: ("reused", [plain("stored")]), 3: ("repaired", [("ab c", "paragraph", True, False)]), 4: ("repaired", [plain("Bugün")]), 5: ("missing", None), 6: ("missing", None)}


def test_merge_and_save(spark, tmp_path):
    old = spark.createDataFrame([page(1, "a", []), page(2, "a", [])], SCHEMA)
    new = spark.createDataFrame([page(2, "b", []), page(3, "b", [])], SCHEMA)
    merged = cache.merge(old, new)
    assert {r.page_number: r.repair_signature for r in merged.collect()} == {1: "a", 2: "b", 3: "b"}
    cache.save(merged, str(tmp_path / "t"))
    cache.save(new.withColumn("source_hash", F.lit("other")), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("source_hash").count().count() == 2


def test_signatures():
    from dataclasses import asdict
    from hashlib import sha256

    form = '4|{"provider":"rule","base_url":"http://localhost:11434","api_key":null,"model":"ü","command":["a"],"timeout_seconds":120}'
    assert cache.repair_signature(asdict(ModelSettings(model="ü", command=("a",)))) == sha256(form.encode()).hexdigest()
    assert cache.repair_signature({"model": "m", "timeout": 1}) != cache.repair_signature({"model": "m", "timeout": 2})


def test_signatures_of_rows(spark):
    from dataclasses import asdict

    s = ModelSettings(model='a "b" ü', command=("x", "y"), api_key=None)
    kinds = "provider string, base_url string, api_key string, model string, command array<string>, timeout_seconds int"
    rows = spark.createDataFrame([(tuple(asdict(s).values()),)], f"s struct<{', '.join(k.replace(' ', ':', 1) for k in kinds.split(', '))}>")
    assert rows.select(cache.signature_of(F.col("s")).alias("x")).first().x == cache.repair_signature(asdict(s))


def test_state_round_trip(spark, tmp_path):
    table = spark.createDataFrame([page(2, "a", [("x", "table")]), page(10, "a", []), page(1, None, [])], SCHEMA)
    (row,) = state.state_json(table).collect()
    data = json.loads(row.json)
    assert list(data["pages"]) == ["1", "2", "10"] and data["pages"]["2"]["blocks"][0]["role"] == "table"
    data["pages"]["3"] = "not an object"
    (tmp_path / "h.state.json").write_text(json.dumps(data, indent=2))
    back = state.read_state(spark, str(tmp_path / "h.state.json"))
    assert sorted(map(str, back.collect())) == sorted(map(str, table.collect()))


def test_odd_state_pages(spark, tmp_path):
    """A page with fields of other types is incomplete with its error; the others, of the same document, are whole."""
    good = {"page_number": 1, "raw_text": "a", "repaired_text": "b", "layout": "single-column", "blocks": [{"text": "x", "role": "table", "bold": True, "italic": None}], "raw_blocks": [], "repair_signature": "s", "complete": True}
    pages = {"1": good, "2": good | {"blocks": "none"}, "3": 7, "x": good, "4": {"raw_text": "only"}, "5": good | {"complete": False, "layout": None}, "6": good | {"raw_text": {"a": 1}}}
    (tmp_path / "a.state.json").write_text(json.dumps({"source_hash": "h", "pages": pages}))
    (tmp_path / "b.state.json").write_text("{broken")
    rows = {(r.page_number, r.error): r for r in state.read_state(spark, str(tmp_path), errors=True).collect()}
    assert set(rows) == {(1, None), (2, "blocks"), (3, "not an object"), (None, "no page number"), (4, None), (5, None), (6, "raw_text"), (None, "not JSON")}
    assert rows[1, None].blocks[0].text == "x" and rows[1, None].complete and not rows[2, "blocks"].complete and rows[2, "blocks"].raw_text == "a" and rows[4, None].complete and not rows[5, None].complete
    plain = state.read_state(spark, str(tmp_path))
    assert sorted(r.page_number for r in plain.collect()) == [1, 2, 4, 5, 6] and "error" not in plain.columns


def test_state_documents_in_parts(spark):
    """The same document part by part: cut anywhere it gives the same pages, and no value holds more than one of them."""
    table = spark.createDataFrame([page(2, "a", [("x", "table")]), page(10, 'q"\\{', []), page(1, None, [])], SCHEMA)
    (row,) = state.state_json(table).collect()
    parts = state.state_parts(table)
    assert "".join(r.part for r in sorted(parts.collect(), key=lambda r: r.place)) == row.json and parts.count() == 5
    assert "collect_list" not in parts._jdf.queryExecution().optimizedPlan().toString()
    cut = spark.createDataFrame([("d", k, row.json[k : k + 3]) for k in range(0, len(row.json), 3)], "document string, place int, part string")
    for given in (parts, cut):
        assert sorted(map(str, state.pages_of_parts(given).collect())) == sorted(map(str, table.collect()))
    odd = {"a": '{"source_hash":"h","pages":{"1":{"raw_text":"r"},"2":7,"x":{},"3":{"a":tru}}, "more":[1]}', "b": '{"pages":{"1":{}},', "c": '{"pages":3,"source_hash":"k"}', "d": '{"pages":{"1":{},"1":{}}}', "e": "[1", "f": '{"pages":{}} x', "g": "", "h": "5"}
    rows = spark.createDataFrame([(n, 0, t) for n, t in odd.items()], "document string, place int, part string")
    found = sorted((r.source_hash or "", r.page_number or 0, r.error or "") for r in state.pages_of_parts(rows, errors=True).collect())
    assert found == sorted([("h", 1, ""), ("h", 2, "not an object"), ("h", 0, "no page number"), ("h", 3, "not JSON"), ("k", 0, "no pages"), ("", 0, "no pages")] + [("", 0, "not JSON")] * 5)


def test_state_documents_are_dealt_out_once_and_compressed(spark, sf_dir):
    """Pages aren't joined with their own damage or shuffled to their document's head; parts are dealt out once for both readings, and take less room than the text that they hold four times."""
    from quirelake.plans.book_queries import checkpoint

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    given = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = checkpoint(spark, sf_dir)
        parts = state.state_parts(kept)
        assert plan(kept).count("SortMergeJoin") == plan(parts).count("SortMergeJoin") == 1  # that of the running page numbers
        assert "REPARTITION_BY" not in plan(state.pages_of_parts(parts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", given)
    texts = spark.createDataFrame([(1, 0, None), (1, 1, ""), (None, 2, "ş\U0001f600\x00"), (2, 3, "word " * 9999)], "document long, place int, part string")
    packed = next(state._packed(iter(texts.toArrow().combine_chunks().to_batches())))
    assert [state._unpacked(p) for p in packed.column("part")] == ["", "", "ş\U0001f600\x00", "word " * 9999]
    sizes = parts.mapInArrow(state._packed, "document string, place long, part binary").selectExpr("sum(length(part)) AS n").first().n
    assert sizes < kept.selectExpr("sum(length(raw_text)) AS n").first().n


def test_state_documents_hand_on_some_pages_at_a_time(spark, monkeypatch):
    rows = [page(k, "a" * 50, []) for k in range(1, 40)]
    monkeypatch.setattr(state, "HANDED", 300)
    table = spark.createDataFrame(rows, SCHEMA)
    batch = next(state._packed(iter(state.state_parts(table).orderBy("place").toArrow().combine_chunks().to_batches())))
    pages = list(state._scanned(False)(iter([batch])))
    assert len(pages) > 5 and sum(b.num_rows for b in pages) == 39 and [b.num_rows for b in state._scanned(True)(iter([batch]))] == [1]
