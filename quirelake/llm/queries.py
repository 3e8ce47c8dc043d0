"""The registered queries of the corpus operators and their SQL statements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import audit, chat, covertree, langid, lines, media, mixing, ngram, pieces, search, secrets, sharding, simhash
from quirelake.llm.common import table


def default_vocabulary() -> str:
    """The merge-type vocabulary file installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def remainder(id_col: str, divisor: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = media.probe_media(media.store_texts(table(spark, sf_dir, "documents"))).withColumn("t", F.col("tracks")[0])
    t, keys = F.col("t"), F.col("t.keyframes")
    feature = F.format_string(
        "%s %d Hz, %d ms, %d samples, %d keyframes of %d bytes from %d to %d", t["codec"], t["timescale"], (t["duration"] * 1000 / t["timescale"]).cast("long"), t["n_samples"],
        F.size(keys), F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a + k["length"]), keys[0]["offset"], F.element_at(keys, -1)["offset"] + F.element_at(keys, -1)["length"],
    )
    return probed.select(F.col("id").alias("doc_id"), "n_bytes", t["payload_bytes"].alias("payload_bytes"), t["payload_sha256"].alias("payload_sha256"), t["tail_crc32"].alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 3) != 1))
    found = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), model.column(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "kind", F.col("start").alias("start_char"), F.col("end").alias("end_char"), F.sha2("finding", 256).alias("finding_sha256"), "score", "is_secret")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remainder("doc_id", 7)
    kind = F.when(left == 2, ngram.UNSEEN).when(left == 5, ngram.DELETED).otherwise(ngram.COUNTED)
    scored = ngram.score_texts(table(spark, sf_dir, "documents"), kind)
    return scored.withColumnRenamed("id", "doc_id").withColumn("held_out", F.coalesce(left == 2, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_documents(table(spark, sf_dir, "documents"), default_vocabulary())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.with_copies(docs, mixing.mixture(docs), "mix").withColumn("size", mixing.word_count(F.col("text")))
    return mixed.select("doc_id", "size", F.col("mix.source_size").alias("source_size"), F.col("mix.target").alias("target"), (F.col("size") * F.col("mix.copies")).alias("taken"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    formatted = chat.format_conversations(turns.unionByName(extra))

    @F.pandas_udf("n_turns long, turns string, loss string")
    def read(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, marked in zip(texts, spans):
            back = chat.read_turns(text)
            rows.append((len(back), "".join(f"{role}\n{said}\n" for role, said in back), chat.read_loss(text, [(s["start"], s["end"]) for s in marked])))
        return pd.DataFrame(rows, columns=["n_turns", "turns", "loss"])

    found = formatted.select("conv_id", "formatted", read("formatted", "spans").alias("r"))
    return found.select("conv_id", "r.n_turns", F.sha2("r.turns", 256).alias("turns_sha256"), F.char_length("r.loss").cast("long").alias("loss_chars"), F.sha2("r.loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_media_columns, op2_simhash_dedup, op3_language_id, op4_secret_scan, op5_lm_scoring, op6_sentencepiece, op7_embedding_dedup, op8_source_mixing, op9_kd_sharding, op10_chat_format, op11_filter_audit, op12_line_dedup, op13_lexical_search)}

#: Water-filled targets, then the running sum of sizes by 48-bit hash against what each target leaves over whole passes.
MIXING_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s
), r AS (
  SELECT *, cap / w AS ratio, row_number() OVER o AS k,
         (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS line
  FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, coalesce(least(cap, w * (SELECT arg_min(line, k) FROM r WHERE line <= ratio)), cap) AS target FROM r
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), g AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS unit, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM d GROUP BY source, h
), b AS (
  SELECT p.source, p.source_size, p.target, p.passes,
         max(g.h) FILTER (WHERE g.unit > 0 AND g.upto - g.unit <= p.target - p.passes * p.source_size
                          AND (g.upto <= p.target - p.passes * p.source_size OR (p.target - p.passes * p.source_size - g.upto + g.unit) * 2 > g.unit)) AS last
  FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source GROUP BY ALL
)
SELECT d.doc_id, d.size, b.source_size, b.target, d.size * (b.passes + CASE WHEN d.h <= b.last THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

#: Links by brute force, then the smallest vector reachable by following them.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), parts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT p.x AS vec_id, coalesce(n, 0) AS n_links, component_id, p.x = component_id AS kept FROM parts p LEFT JOIN counts c ON c.x = p.x
"""

_CONTROLS = ", ".join(f"'{c}'" for c in chat.CONTROLS)
_ESCAPED = "(length({0}) + (length({0}) - length(replace({0}, chr(92), ''))) + list_sum(list_transform([" + _CONTROLS + "], lambda c: (length({0}) - length(replace({0}, c, ''))) // length(c))))"
#: A turn is three control strings, its role and its text; each backslash and each control string in these adds a backslash.
CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {len(chat.TURN + chat.TEXT + chat.END)}) AS formatted
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""

#: Every order and step over every document's failures.
AUDIT_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, {'A': len(words) < 50, 'B': 100 * len(list_distinct(words)) < 65 * len(words), 'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS x FROM w
), m AS (
  SELECT part, MAP {'A': x.A, 'B': x.B, 'C': x.C, 'D': x.D, 'E': x.E} AS x, x.A::INT + x.B::INT + x.C::INT + x.D::INT + x.E::INT AS failed,
    EXISTS (FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1) AS good, EXISTS (FROM labels l WHERE l.doc_id = f.doc_id AND l.toxic = 1) AS toxic FROM f
), h AS (
  SELECT part, x, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (
  SELECT a.c || b.c || d.c || e.c || g.c AS filter_order FROM l a, l b, l d, l e, l g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(generate_series(1, 5)) AS step)
), r AS (
  SELECT part, filter_order, step, c, n, good, toxic, x[c] AS own, failed, len(list_filter(string_split(before, ''), lambda b: b <> '' AND x[b])) > 0 AS gone FROM h, s
), t AS (
  SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (own AND failed = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0) AS toxic_lost FROM r GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM t
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Keys of all lines, those that five documents hold, and the lines that stay in their order.
LINES_SQL = rf"""
WITH l AS (
  SELECT row, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS place FROM (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents)
), k AS (
  SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {lines.LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT doc_id) >= {lines.LEAST_DOCUMENTS}
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND s.last IS DISTINCT FROM k.doc_id AS gone FROM k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY row, doc_id
"""

_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Every document's score for every item.
SEARCH_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS t FROM documents), s AS (
  SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0
), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL), p AS (
  SELECT row, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT *, unnest(t) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * s.n + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, s.n
), e AS (
  SELECT row, doc_id, item_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * s.n) // s.total)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY row, doc_id, item_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, row) AS INT) AS rank, doc_id, score FROM e WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

ORACLES = {"op11_filter_audit": AUDIT_SQL, "op12_line_dedup": LINES_SQL, "op13_lexical_search": SEARCH_SQL, "op7_embedding_dedup": EMBEDDING_SQL, "op8_source_mixing": MIXING_SQL, "op10_chat_format": CHAT_SQL}
