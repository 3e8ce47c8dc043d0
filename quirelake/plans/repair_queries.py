"""Queries of the repair rules over damaged texts, each with SQL that uses no look-around."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import repair as rules
from quirelake.functions.lexicon import HINTS, LETTERS, LOWERS, MERGE_WORDS, PHRASES
from quirelake.plans.fixtures import DAMAGED_SQL, damaged

#: Literal texts for what the damaged documents don't show: (id, text).
CASES = (
    (1, "onu biç  gelmez diye Biç gelmiyor, biçim"), (2, "KALDIR : DIM ve kaldır:dım dedi"), (3, "a h met ile A h met, de vam y er g eldi"), (4, "Cunku SEHIR simdi icin kitabi daha once"),
    (5, "he r han gi kend i çin b ir bi r a ma"), (6, "o ' n bu 'x' e ' y"), (7, "trolsüz güç"), (8, "Son söz kitap! 12 /"), (9, "sonu ab|  7"), (10, "a- b- c ve di- \n yor so-  nra"),
    (11, "12\xa0\xa034\t \tx"), (12, "Bir.\n\n\nIki\n\n- Uc\n- Dort\n\nson"), (13, "kisa\nbir\nsiir"), (14, "a.b..c...d T.C. x ,y;z!w"), (15, "der “ söz ” ve ‘ ic ’ \" duz \" bitti"), (16, "x 15 16"), (17, "  \n "), (18, ""), (19, "daTa geTdi T aTB"), (20, "her, hangi her-hangi her  hangi"),
)


def _cases(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.struct((F.lit(-i)).cast("long").alias("doc_id"), F.lit(t).alias("text")) for i, t in CASES])).alias("c")).select("c.*")


def _over(rule: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = damaged(spark, sf_dir).select("doc_id", "text").unionByName(_cases(spark))
        return d.select("doc_id", rule(F.col("text")).alias("text"))

    return query


QUERIES = {
    "r1_phrases": _over(rules.common_phrases), "r2_hyphens": _over(rules.join_hyphens), "r3_confusions": _over(rules.fix_confusions), "r4_space": _over(rules.normalize_space), "r4_space_kept": _over(lambda t: rules.normalize_space(t, F.lit(True))),
    "r5_merge": _over(rules.merge_broken), "r6_punctuation": _over(rules.fix_punctuation), "r7_artifacts": _over(rules.drop_page_artifacts), "r8_paragraphs": _over(rules.rebuild_paragraphs), "repair_full": _over(rules.repair),
    "repair_keep_lines": _over(lambda t: rules.repair(t, True)), "repair_keep_paragraphs": _over(lambda t: rules.repair(t, keep_paragraphs=True)),
}

# --- SQL -------------------------------------------------------------------------------

SPACE = r"[\t-\r\x1c- \x85\xa0]"
_quote = lambda s: "'" + s.replace("'", "''") + "'"
_chars = lambda s: " || ".join([_quote(p) if p not in ("\n", "\t", "\xa0") else f"chr({ord(p)})" for p in _split(s)]) or "''"


def _split(s: str) -> list[str]:
    out, word = [], ""
    for c in s:
        if c in "\n\t\xa0":
            out += [word] * bool(word) + [c]
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


INPUT = DAMAGED_SQL + ", input AS (SELECT doc_id, text FROM damaged UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i}, {_chars(t)})" for i, t in CASES) + ") v(doc_id, text))"


def _replace(text: str, pattern: str, to: str, options: str = "g") -> str:
    return f"regexp_replace({text}, {_quote(pattern)}, {_quote(to)}, '{options}')"


def _twice(text: str, pattern: str, to: str, options: str = "g") -> str:
    """For patterns that hold the characters round a match: a second pass takes the neighbours that the first has used up."""
    return _replace(_replace(text, pattern, to, options), pattern, to, options)


_EDGE, _END = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def r1_sql(t: str) -> str:
    t = _twice(t, rf"(^|{SPACE})©($|{SPACE})", r"\1o\2")
    t = _twice(t, rf"{_EDGE}[bB][iI][çÇ]({SPACE}+[gG][eE][lL](?:[mM][eE][zZ]|[mM][eE]|[mM][iI][yY][oO][rR]|[dD][iI]))", r"\1hiç\2")
    t = _twice(t, rf"{_EDGE}[kK][aA][lL][dD][ıIiİ][rR]{SPACE}*:{SPACE}*[dD][ıIiİ][mM]{_END}", r"\1kaldırdım\2")
    for a, b in PHRASES:
        t = _twice(t, f"{_EDGE}{a}{_END}", rf"\1{b}\2")
    for a, b in HINTS:
        insensitive = "".join("[iIıİ]" if c == "i" else f"[{c}{c.upper()}]" if c.isalpha() else c for c in a)
        t = _twice(t, f"{_EDGE}{insensitive}{_END}", rf"\1{b}\2")
    return t


def r2_sql(t: str) -> str:
    return _replace(_replace(t, rf"([{LETTERS}]+)-[ \t]*\n{SPACE}*([{LETTERS}]+)", r"\1\2"), rf"([{LETTERS}]+)-{SPACE}+([{LETTERS}]+)", r"\1\2")


def r3_sql(t: str) -> str:
    return _twice(t, rf"([{LOWERS}])T([{LOWERS}])", r"\1r\2")


def r4_sql(t: str) -> str:
    """Line by line: the separator before a line is a line end if the line before ends a sentence or this one is empty or opens with a dash."""
    blanks = _replace(f"replace({t}, chr(160), ' ')", r"[ \t]{2,}", " ")
    return (
        f"(WITH s AS (SELECT string_split({blanks}, chr(10)) AS l), e AS (SELECT l[i] AS x, i, CASE WHEN i = 1 THEN '' WHEN (i > 2 OR l[i - 1] <> '') AND l[i - 1] <> '' AND right(l[i - 1], 1) IN ('.', '!', '?', ':', ';', '…') OR (l[i] = '' AND i < len(l)) "
        f"OR left(l[i], 1) IN ('-', '–', '—', '•') THEN chr(10) ELSE ' ' END AS sep FROM s, unnest(generate_series(1, len(l))) u(i)) SELECT regexp_replace(string_agg(sep || x, '' ORDER BY i), '\\n{{3,}}', chr(10) || chr(10), 'g') FROM e)"
    )


def r6_sql(t: str) -> str:
    t = _replace(t, rf"{SPACE}+([,.;:!?])", r"\1")
    t = _replace(t, rf"([,;:!?])([{LETTERS}])", r"\1 \2")
    t = _twice(t, rf"(^|[^.])\.([{LETTERS}])", r"\1. \2")
    t = _replace(t, rf"([\"“‘]){SPACE}+", r"\1")
    t = _replace(t, rf"{SPACE}+([\"”’])", r"\1")
    return _twice(t, rf"{_EDGE}([{LETTERS}]){SPACE}+'{SPACE}+([{LETTERS}]){_END}", r"\1\2'\3\4")


def r7_sql(t: str) -> str:
    t = _replace(t, r"^[tT]rolsüz($|[^\p{L}\p{N}_])", r"Kontrolsüz\1", "")
    return _replace(t, rf"{SPACE}+([{LETTERS}]{{1,5}}[!|]{SPACE}+)?\p{{Nd}}{{1,3}}{SPACE}*/?{SPACE}*$", "", "")


def r8_sql(t: str) -> str:
    lines = f"list_filter(list_transform(string_split_regex(p, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{{85}}]'), lambda x: {_strip('x')}), lambda x: x <> '')"
    paragraphs = f"list_filter(list_transform(string_split_regex({t}, '\\n{SPACE}*\\n'), lambda p: {lines}), lambda l: len(l) > 0)"
    verse = "len(list_filter(l, lambda x: left(x, 1) IN ('-', '–', '—', '•'))) > 0 OR (len(l) >= 3 AND len(list_filter(l, lambda x: length(x) <= 42)) / len(l) > 0.7)"
    return f"array_to_string(list_transform({paragraphs}, lambda l: CASE WHEN {verse} THEN array_to_string(l, chr(10)) ELSE array_to_string(l, ' ') END), chr(10) || chr(10))"


def _strip(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '^{SPACE}+', ''), '{SPACE}+$', '')"


#: Word and gap tokens, then left to right: state 0 nothing open, a word is held until the next one joins it or not.
MERGE_SQL = """
(SELECT coalesce(list_reduce(list_prepend('', list_transform(regexp_extract_all({t}, '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+)'), lambda x: x)), lambda a, x:
   CASE WHEN regexp_full_match(x, '[\\p{{L}}\\p{{N}}_]+') AND regexp_matches(a, '(^|\\x01)[\\p{{L}}]{{1,12}}' || chr(2) || '{space}+$') AND regexp_full_match(x, '\\p{{L}}{{1,12}}')
             AND list_contains({words}, lower(regexp_extract(a, '([\\p{{L}}]+)' || chr(2) || '{space}+$', 1) || x))
        THEN regexp_replace(a, chr(2) || '{space}+$', '') || x
        WHEN regexp_full_match(x, '[\\p{{L}}\\p{{N}}_]+') THEN replace(a, chr(2), '') || chr(1) || x || chr(2) ELSE a || x END), ''))"""


def r5_sql(t: str) -> str:
    words = "[" + ", ".join(_quote(w) for w in sorted(MERGE_WORDS)) + "]"
    once = lambda x: f"replace(replace({MERGE_SQL.format(t=x, space=SPACE, words=words)}, chr(1), ''), chr(2), '')"
    return once(once(t))


def _steps(*names: str, first: str = "input", keys: str = "doc_id", last_select: str = "SELECT doc_id, text FROM {last}") -> str:
    """One CTE for each rule, so that a text is computed once."""
    by_name = {"r1": r1_sql, "r2": r2_sql, "r3": r3_sql, "r4": r4_sql, "r5": r5_sql, "r6": r6_sql, "r7": r7_sql, "r8": r8_sql, "blanks": lambda t: _replace(f"replace({t}, chr(160), ' ')", r"[ \t]{2,}", " "), "strip": _strip}
    out, last = f"WITH {INPUT}{'' if first == 'input' else PARAGRAPHS}", first
    for k, n in enumerate(names):
        out += f", s{k} AS MATERIALIZED (SELECT {keys}, {by_name[n]('text')} AS text FROM {last})"
        last = f"s{k}"
    return f"{out} {last_select.format(last=last)}"


#: The paragraphs of each text with their places.
PARAGRAPHS = f", parted AS (SELECT doc_id, string_split_regex(text, '\\n{SPACE}*\\n') AS p FROM input), paragraphs AS (SELECT doc_id, i AS place, p[i] AS text FROM parted, unnest(generate_series(1, len(p))) u(i))"
_CHAIN = ("r1", "r2", "r3", "r4", "r5", "r6", "r7", "r8", "r4", "strip")
ORACLES = {
    "r1_phrases": _steps("r1"), "r2_hyphens": _steps("r2"), "r3_confusions": _steps("r3"), "r4_space": _steps("r4"), "r4_space_kept": _steps("blanks"), "r5_merge": _steps("r5"), "r6_punctuation": _steps("r6"), "r7_artifacts": _steps("r7"), "r8_paragraphs": _steps("r8"),
    "repair_full": _steps(*_CHAIN),
    "repair_keep_paragraphs": _steps(*_CHAIN, first="paragraphs", keys="doc_id, place", last_select="SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY place) FILTER (WHERE text <> ''), '') AS text FROM {last} GROUP BY doc_id"),
    "repair_keep_lines": _steps("r1", "r2", "r3", "blanks", "r5", "r6", "r7", "r8", "blanks", "strip"),
}
