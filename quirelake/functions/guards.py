"""Guards on what a text model returns: each is a column expression, and one ``decide`` joins them.

Two things need Python: the similarity (see ``similar``), computed only for rows that every
cheaper guard has let through and only as far as its threshold needs, and the difference of
two bags of words, which stay in their row so that no word is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from quirelake.durable import durable
from quirelake.functions import similar
from quirelake.functions.lexicon import LOWERS, UPPERS
from quirelake.functions.text import WS, casefold, count_of, is_blank, let, settle, strip, words

#: Typographic quotes, in order, and the private code points that stand for them in a model's input.
QUOTES = "“”‘’«»"
TOKENS = "".join(chr(0xE000 + i) for i in range(len(QUOTES)))
LEAST_LENGTH, MOST_LENGTH, LEAST_SIMILARITY = 0.65, 1.45, 0.72
#: Distinct words that are sent to every task to be looked up, at most.
SENT_WORDS = 1_000_000
#: Shortest word that has to be known.
LEAST_WORD = 3


def protect_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, TOKENS)


def restore_quotes(protected: Column, output: Column) -> Column:
    """Output with its quotes back; null if it has another number of any token than its input."""
    return let(protected, lambda p: F.when(reduce(and_, (count_of(p, t) == count_of(output, t) for t in TOKENS)), F.translate(output, TOKENS, QUOTES)))


def clean_output(text: Column) -> Column:
    """Strips, then drops an opening fence, a closing fence and a leading think element, in this order."""
    text = F.regexp_replace(strip(text), rf"(?i)\A```(?:text|plaintext)?{WS}*", "")
    text = F.regexp_replace(text, rf"{WS}*```\n?\z", "")
    return strip(F.regexp_replace(text, rf"(?s)\A<think>.*?</think>{WS}*", ""))


def length_ok(original: Column, output: Column) -> Column:
    ratio = F.size(words(output)) / F.greatest(F.lit(1), F.size(words(original)))
    return ratio.between(LEAST_LENGTH, MOST_LENGTH)


def quotes_ok(original: Column, output: Column) -> Column:
    return reduce(and_, (count_of(original, q) == count_of(output, q) for q in QUOTES))


def case_ok(output: Column) -> Column:
    """No capital right after a lower-case letter, anywhere in the output."""
    return ~output.rlike(f"[{LOWERS}][{UPPERS}]")


def letter_words(text: Column) -> Column:
    """Folded runs of letters. Where every letter folds to one letter, its lower case, the whole text is made lower case first."""
    runs = lambda t: F.regexp_extract_all(t, F.lit(r"(\p{L}+)"), F.lit(1))
    return F.when(text.rlike(r"[\p{L}&&[^\x00-\xb4\xb6-\xde\xe0-\xff]]"), F.transform(runs(text), casefold)).otherwise(runs(F.lower(text)))


@F.pandas_udf(DoubleType())
def similarity(original: pd.Series, output: pd.Series) -> pd.Series:
    """Ratio of matching characters; null if either is null."""
    return pd.Series([None if a is None or b is None else similar.ratio(a, b) for a, b in zip(original, output)], dtype="float64")


@F.pandas_udf(DoubleType())
def similarity_or_bound(original: pd.Series, output: pd.Series) -> pd.Series:
    """A number that is below LEAST_SIMILARITY if and only if the ratio is, as soon as that is certain; null if either is null."""
    return pd.Series([None if a is None or b is None else similar.decided(a, b, LEAST_SIMILARITY) for a, b in zip(original, output)], dtype="float64")


@F.arrow_udf(ArrayType(StructType([StructField("word", StringType()), StructField("extra", LongType())])))
def extra_words(output: pa.Array, original: pa.Array) -> pa.Array:
    """Words of three letters or more that one bag has more often than the other, and how much; null bags are empty."""
    words = pa.concat_arrays([output.flatten(), original.flatten()]).dictionary_encode()
    row = np.concatenate([pc.list_parent_indices(bags).to_numpy() for bags in (output, original)]).astype(np.int64)
    code = words.indices.to_numpy().astype(np.int64)
    sign = np.where(np.arange(len(row)) < len(output.flatten()), 1, -1)
    kinds = max(1, len(words.dictionary))
    keys, place = np.unique(row * kinds + code, return_inverse=True)
    extra = np.bincount(place, sign, len(keys)).astype(np.int64)
    keep = (extra > 0) & (pc.utf8_length(words.dictionary).to_numpy() >= LEAST_WORD)[keys % kinds] if len(keys) else np.zeros(0, bool)
    keys, extra = keys[keep], extra[keep]
    offsets = np.searchsorted(keys, np.arange(len(output) + 1) * kinds).astype(np.int32)
    rows = pa.StructArray.from_arrays([words.dictionary.take(pa.array(keys % kinds)), pa.array(extra)], names=["word", "extra"])
    return pa.ListArray.from_arrays(pa.array(offsets), rows)


def new_words(pairs: DataFrame, key: str, original: str, output: str) -> DataFrame:
    """``key, word, extra``: words of three letters or more that the output has more often than the original. Both bags stay in their row, nothing is shuffled."""
    fresh = extra_words(letter_words(F.col(output)), letter_words(F.col(original)))
    return pairs.select(key, F.explode(fresh).alias("w")).select(key, "w.word", "w.extra")


def unknown_words(pairs: DataFrame, lexicon: DataFrame, key: str, original: str, output: str) -> DataFrame:
    """Rows of :func:`new_words` that ``lexicon`` (word) doesn't have.

    The words to look up are few beside a lexicon, so these are what is sent to its scan,
    if they are counted to be; only what it knows of them comes back.
    """
    found = durable(new_words(pairs, key, original, output).select(key, "word", "extra"))
    asked = durable(found.select("word").distinct())
    known = lexicon.select("word").join(F.broadcast(asked) if asked.count() <= SENT_WORDS else asked, "word", "left_semi").distinct()
    return found.join(known, "word", "left_anti").select(key, "word", "extra")


def decide(pairs: DataFrame, lexicon: DataFrame | None, key: str = "key", rules: str = "rules", answer: str = "answer") -> DataFrame:
    """``key, text, reject_reason``: the model's text where every guard holds, else the rules' text and why.

    ``pairs`` has the rules' text and the model's answer with quotes as tokens; a null
    answer means that the model was not available or failed. ``key`` must be unique. Without
    a ``lexicon`` (word) there is no guard of words. The first failing guard in the order
    below gives the reason.
    """
    base = pairs.select(key, F.col(rules).alias("rules"), F.col(answer).alias("answer"))
    r = F.col("rules")

    def early(restored: Column, c: Column) -> Column:
        return F.when(is_blank(r), "blank").when(F.col("answer").isNull(), "unavailable").when(restored.isNull(), "tokens").when(c == "", "empty").when(~length_ok(r, c), "length")

    judged = let(restore_quotes(protect_quotes(r), F.col("answer")), lambda x: let(clean_output(x), lambda c: F.struct(c.alias("clean"), early(x, c).alias("early"))))
    base = settle(base, "j", judged).select(key, "rules", F.when(F.col("j.early").isNull(), F.col("j.clean")).alias("clean"), F.col("j.early").alias("early"))
    c = F.col("clean")
    checked = base.withColumn("ratio", similarity_or_bound(r, c))
    if lexicon is None:
        checked = checked.withColumn("unknown", F.lit(None).cast("boolean"))
    else:
        unknown = unknown_words(base.where(c.isNotNull() & (r != c)), lexicon, key, "rules", "clean").select(key).distinct().withColumn("unknown", F.lit(True))
        unknown = durable(unknown)
        checked = checked.join(F.broadcast(unknown) if unknown.count() <= SENT_WORDS else unknown, key, "left")
    reason = F.coalesce("early", F.when(F.col("ratio") < LEAST_SIMILARITY, "similarity").when(~quotes_ok(r, c), "quotes").when(F.col("unknown"), "vocabulary").when(~case_ok(c), "case"))
    return checked.withColumn("reject_reason", reason).select(key, F.when(F.col("reject_reason").isNull(), c).when(F.col("reject_reason") == "blank", "").otherwise(r).alias("text"), "reject_reason")
