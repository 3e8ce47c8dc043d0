"""Plain restatements that the operators are held against."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, links):
    """node -> smallest node reachable."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def prose(seed, words):
    r = random.Random(seed)
    syllables = "th er on an re he in ed nd ha at en es of or".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(words))


def edge_rows():
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10), (2, None, "en", "a", None), (3, "", None, None, 0), (4, "  \t\n ", "fr", "b", 5), (5, long, "en", "b", len(long)), (6, long, "de", "b", len(long)),
        (7, "été œuvre 😀 naïve ▁ x", "fr", None, 20), (7, "été œuvre 😀 naïve ▁ x", "fr", None, 20), (None, "row without id", "en", "c", 14), (8, "12345 67 !!", None, "c", 11), (9, "a", "en", "c", 1),
    ]


def edge_table(spark):
    """The edge rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    for name in ("id", "fp", "h", "size", "point", "bucket", "kind", "vector", "shard", "chunk"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df
