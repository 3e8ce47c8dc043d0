"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are vendor-shaped keys, private-key blocks (armoured ones and such as break off
before their END line too), passwords in addresses, values assigned to a credential word or
said to be it, and long unbroken runs that mix letters and digits. A forest over the
candidate's length, character transitions, dictionary coverage, path (of the file, if there
is a column of it, and round the candidate) and neighbouring words, trained on labelled
findings, then decides which are secrets. The dictionary is the whole words of a public
tokenizer's vocabulary, whose path is a parameter. Every pattern takes time in proportion
to the text.
"""

from __future__ import annotations

import importlib.util
import random
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import python_batches, valid_utf8, values, working
from quirelake.llm.forest import Forest, fit_forest

#: Kinds of candidates and their patterns, in the order of precedence; key blocks, found by their marks, come before all.
PATTERNS = (
    ("url_password", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@\"'<>]*+:(?P<inner>[^\s/@\"'<>]{3,}+)@(?=[A-Za-z0-9\[])"),
    ("aws_key_id", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("github_token", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}"),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("google_key", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}"),
    ("stripe_key", r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    ("service_token", r"(?<![A-Za-z0-9_-])(?:glpat-|npm_|pypi-|hf_|sk-|dop_v1_|shpat_)(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{20,}+"),
    ("jwt", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*?eyJ[A-Za-z0-9_-]{8})[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    ("assigned", r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)[\"']?[ \t]{0,4}(?:=|:|is[ \t](?=[ \t]{0,4}[\"']?[^\s\"'<>,;]*[0-9]))[ \t]{0,4}[\"']?(?P<value>[^\s\"'<>,;]{6,})"),
    ("long_run", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"),
)
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: Kinds of which a part alone is the candidate.
_INNER = {"assigned": "value", "url_password": "inner"}
_VENDOR = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS if k not in ("url_password", "assigned", "long_run")))
_KEY_MARK = re.compile(r"-{4,5} ?(?:(?P<begin>BEGIN)|END) [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)? ?-{4,5}")
_GAP = r"(?:\s|\\[nr]|[\"'+,;])"
#: What follows the BEGIN line of a block that breaks off: header lines, then encoded lines; a short last line only where the text ends or by its padding.
_KEY_BODY = re.compile(rf"(?:{_GAP}*+[A-Za-z][A-Za-z0-9-]*+: [^\n\\]*+)*+(?:{_GAP}++(?:[A-Za-z0-9+/]{{24,}}+={{0,2}}|[A-Za-z0-9+/]++={{1,2}}(?![A-Za-z0-9+/=])|=[A-Za-z0-9+/]{{4}}(?![A-Za-z0-9+/=])|[A-Za-z0-9+/]++(?=\s*+\Z)))++")
#: Words that go with credentials, words that go with harmless identifiers, words found inside names and placeholders.
CREDENTIAL_WORDS = frozenset("password passwd pwd passphrase secret token key apikey api_key access auth credential credentials bearer private login".split())
HARMLESS_WORDS = frozenset("commit sha sha1 sha256 md5 checksum hash digest uuid guid id revision version build etag integrity serial isbn order invoice phone card example sample test placeholder dummy image base64 file path url".split())
DICTIONARY = frozenset("your here change changeme example sample test token password secret key api placeholder insert none null true false admin user default value name data file image index page text line word book chapter build release version module package class function object string number integer config setting service server client local host main master branch commit hash the and for with from that this have will into over under about after before between content header footer title link home about search result system process thread".split())
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
FEATURES = ("length", "digits", "uppers", "lowers", "others", "distinct", "entropy", "digit_letter_moves", "case_moves", "vowel_share", "longest_letter_run", "dictionary", "slashes", "path_before", "url_before", "assigned_before", "credential_near", "harmless_near", "vendor", "repeats", "hex_only", "groups", "trial_path", "live_path")
THRESHOLD = 0.5
#: Characters looked at before a candidate.
NEAR = 40
#: Parts of file paths that go with trials and generated files, and with settings in use.
TRIAL_PATHS = frozenset("test tests testing spec example examples sample samples fixture fixtures mock mocks doc docs lock readme snapshot vendor node_modules dist".split())
LIVE_PATHS = frozenset("env config conf settings credentials secrets secret deploy production prod terraform pem key ini properties".split())


def _key_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of each private-key block, however long: from a BEGIN line to the END line before the next BEGIN line, or, where there is none, to the end of its encoded lines."""
    out, first = [], None

    def broken_off() -> None:
        if first and (body := _KEY_BODY.match(text, first.end())):
            out.append((first.start(), body.end()))

    for m in _KEY_MARK.finditer(text):
        if m["begin"]:
            broken_off()
            first = m
        elif first and m.start() > first.end():
            out.append((first.start(), m.end()))
            first = None
    broken_off()
    return out


def _between(text: str, low: int, high: int) -> Iterator[tuple[str, int, int]]:
    """Candidates other than key blocks within a part of the text."""
    while m := _ANY.search(text, low, high):
        kind, low = m.lastgroup, m.end()
        start, end = m.span(_INNER.get(kind, kind))
        if kind == "assigned":
            end = start + len(text[start:end].rstrip(".!?)]}"))
            if vendor := _VENDOR.match(text, start, high):  # of its own kind, and no shorter than the value
                kind, end = vendor.lastgroup, max(end, vendor.end())
                low = max(low, end)
        if end - start >= (3 if kind == "url_password" else 6):
            yield kind, start, end


def candidates(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each candidate from left to right, not overlapping; none for null or empty texts."""
    if not text:
        return []
    out, low = [], 0
    for start, end in _key_blocks(text):
        out += [*_between(text, low, start), ("private_key", start, end)]
        low = end
    return [*out, *_between(text, low, len(text))]


def default_vocabulary() -> str | None:
    """The merge-type vocabulary file installed beside the libraries, if there is one."""
    if importlib.util.find_spec("public_tokenizers") is None:
        return None
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def dictionary(vocabulary: str | None = None) -> frozenset[str]:
    """The fixed words, and the vocabulary's pieces that are whole words of four letters or more, in lower case."""
    if vocabulary is None:
        return DICTIONARY
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = (model.id_to_piece(k) for k in range(model.get_piece_size()))
    return DICTIONARY | {p[1:].lower() for p in pieces if p.startswith("\u2581") and len(p) > 4 and p[1:].isascii() and p[1:].isalpha()}


def _coverage(s: str, known: frozenset[str] = DICTIONARY) -> float:
    """Share of the characters that dictionary words of three letters or more cover, longest first from the left."""
    low, at, got = s.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(14, len(low) - at), 2, -1) if low[at : at + n] in known), 0)
        got += n
        at += n or 1
    return got / max(1, len(s))


def features(text: str, kind: str, start: int, end: int, path: str | None = None, known: frozenset[str] = DICTIONARY) -> list[float]:
    """FEATURES of a candidate with a dictionary; without a path those of the path are 0."""
    places = set(re.findall(r"[a-z_]+", (path or "").lower()))
    s = text[start:end]
    n = len(s)
    cls = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    letters = [c for c in s if c.isalpha()]
    moves = [a + b for a, b in zip(cls, cls[1:])]
    counts = np.array([s.count(c) for c in set(s)], float) / n
    before = text[max(0, start - NEAR) : start]
    near = [w.lower() for w in _WORD.findall(before)[-4:]] + [w.lower() for w in _WORD.findall(text[end : end + NEAR])[:2]]
    parts = {p for w in near for p in (w, *w.split("_"))}
    run = max(map(len, re.findall(r"[a-z]+|[A-Z]+", s)), default=0)
    return [
        n, cls.count("d") / n, cls.count("u") / n, cls.count("l") / n, cls.count("o") / n, len(set(s)) / n, float(-(counts * np.log2(counts)).sum()),
        sum(m in ("dl", "ld", "du", "ud") for m in moves) / n, sum(m in ("lu", "ul") for m in moves) / n, sum(c in "aeiouAEIOU" for c in letters) / max(1, len(letters)), run / n,
        _coverage(s, known), s.count("/"), float(bool(re.search(r"[/\\.]$", before))), float("://" in before), float(bool(re.search(r"(?:[=:]|\bis)\s*[\"']?$", before))),
        float(bool(parts & CREDENTIAL_WORDS)), float(bool(parts & HARMLESS_WORDS)), float(kind not in ("assigned", "long_run")), sum(a == b for a, b in zip(s, s[1:])) / n, float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), s.count("-") / n,
        float(bool(places & TRIAL_PATHS)), float(bool(places & LIVE_PATHS)),
    ]


def labelled_findings(n: int = 3000, seed: int = 5) -> list[tuple[str, str, int, str | None]]:
    """(text, finding, 1 if a secret, path or None) with invented secrets and look-alikes in invented surroundings; the same for a seed.

    Half have a path, which goes with the label in three of four cases.
    """
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    plain = lambda k: " ".join(word() for _ in range(k))
    names = "password passwd pwd token secret api_key apikey access_key auth_key client_secret".split()
    equals = lambda: r.choice(["=", " = ", ": ", ":", '="', " = \"", ': "', " is "])
    compound = lambda sep: sep.join(r.choice([word(), r.choice(sorted(DICTIONARY))]) for _ in range(r.randint(4, 8)))
    common = r.sample(sorted(w for w in dictionary(default_vocabulary()) if w.islower() and 4 <= len(w) <= 9), 60)
    term = lambda: r.choice([word(), r.choice(common)])
    chosen = [
        lambda: f"{term()}{pick(string.digits, r.randint(1, 4))}{term()}", lambda: f"{term().capitalize()}{pick(string.digits, r.randint(2, 4))}{r.choice('!?#$*')}",
        lambda: f"{term()}{r.choice('_.-')}{term()}{pick(string.digits, r.randint(2, 4))}", lambda: term().replace("o", "0").replace("e", "3").replace("a", "@") + pick(string.digits, 2),
    ]
    person = lambda: (r.choice(chosen)() + pick(string.digits, 6))[: r.randint(8, 20)]
    block = lambda kind: f"-----BEGIN {kind}-----\n" + "\n".join(pick(b64, 64) for _ in range(r.randint(1, 30))) + r.choice([f"\n{pick(b64, 20)}==", f"\n-----END {kind}-----"])
    secrets = [
        lambda: ("", block(r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "OPENSSH PRIVATE KEY", "EC PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]))),
        lambda: (f"{plain(3)} {r.choice(names)}{equals()}", person()),
        lambda: (f"{plain(3)} {r.choice(names)}{equals()}", person()),
        lambda: (f"{plain(2)} {r.choice(['https', 'postgres', 'mysql', 'ftp', 'redis', 'mongodb'])}://{word()}:", f"{r.choice([person, lambda: pick(alnum, r.randint(8, 20))])()}@{word()}.{word()}"),
        lambda: (f"{plain(2)} ", f"{r.choice(['sk_live_', 'rk_live_', 'npm_', 'hf_', 'glpat-', 'sk-'])}{pick(alnum, 34)}1"),
        lambda: (f"{plain(3)} ", r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + r.choice(["", string.digits]), 16)),
        lambda: (f"{plain(3)} {r.choice(names)}{equals()}", pick(hexes, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (f"{plain(3)} {r.choice(names)}{equals()}", pick(alnum, r.randint(10, 48))),
        lambda: (f"{plain(3)} {r.choice(names)}{equals()}", pick(string.ascii_letters, r.randint(5, 10)) + pick("!@#$%^&*0123456789", r.randint(2, 5)) + pick(alnum, 3)),
        lambda: (f"{plain(2)} ", "ghp_" + pick(alnum, 36)),
        lambda: (f"{plain(2)} ", "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)),
        lambda: (f"{plain(2)} ", "AIza" + pick(alnum + "_-", 35)),
        lambda: (f"{plain(2)} bearer ", f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum, 43)}"),
        lambda: (f"{plain(2)} {r.choice(['bearer', 'secret', 'auth', 'key'])} ", pick(b64, r.choice([32, 40, 44, 64]))),
    ]
    harmless = [
        lambda: (f"{plain(2)} {r.choice(['commit', 'sha1', 'revision', 'checksum', 'md5', 'sha256', 'etag', 'build'])}{r.choice([' ', ': ', '='])}", pick(hexes, r.choice([32, 40, 64]))),
        lambda: (f"{plain(2)} {r.choice(['id', 'uuid', 'guid', 'order'])} ", "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))),
        lambda: (f"{plain(2)} {r.choice(names)}{equals()}", r.choice(["your_api_key_here", "changeme", "placeholder", "example", "xxxxxxxxxxxx", "test_password", "insert_token_here", "none_default", "password", "********", "secret_value", "<redacted>", "${TOKEN}"])),
        lambda: (f"{plain(2)} {r.choice(names)}: ", word() + word() + word()),
        lambda: (f"{plain(2)} {r.choice(names)}{equals()}", r.choice(["", "the ", "my_", "new-"]) + r.choice(["required", "optional", "expired", "invalid", "disabled", "missing", "unknown", "forgotten", "protected", term(), f"{term()}_{term()}", f"get{term().capitalize()}()", f"process.env.{term().upper()}", f"os.environ[{term()}]", f"${{{term()}}}", f"<{term()}>", f"{{{{{term()}}}}}", "*" * r.randint(6, 12), "x" * r.randint(6, 12)])),
        lambda: (f"{plain(2)} {r.choice(['https', 'postgres', 'mysql'])}://{word()}:", f"{r.choice(['password', 'pass', 'PASSWORD', '${PASSWORD}', 'xxxxx', '****', 'secret', 'changeme', '{password}', term()])}@{word()}.{word()}"),
        lambda: (f"{plain(2)} {r.choice(['integrity', 'digest', 'hash', 'etag', 'checksum'])} {r.choice(['sha512-', 'sha256:', 'sha384-', ''])}", pick(r.choice([hexes, b64]), r.choice([44, 64, 86]))),
        lambda: (f"{plain(2)} ", "-".join(term() for _ in range(r.randint(4, 8)))),
        lambda: (f"{plain(2)} ", "_".join(term() for _ in range(r.randint(4, 8))) + pick(string.digits, r.randint(1, 3))),
        lambda: (f"{plain(2)} ", compound("-") + pick(string.digits, 2)),
        lambda: (f"{plain(2)} ", compound("_") + pick(string.digits, 1)),
        lambda: (f"{plain(2)} https://{word()}.example/", compound("/") + pick(string.digits, 3)),
        lambda: (f"{plain(2)} path /", compound("/") + "/" + pick(hexes, 12)),
        lambda: (f"{plain(2)} data:image/png;base64,", pick(b64, r.randint(40, 200))),
        lambda: (f"{plain(2)} {r.choice(['isbn', 'serial', 'phone', 'invoice', 'card'])} ", pick(string.digits, 4) + "-" + pick(string.digits, 8) + "-" + pick(string.ascii_uppercase, 8)),
        lambda: (f"{plain(2)} ", "".join(word() for _ in range(r.randint(6, 10))) + pick(string.digits, 1)),
        lambda: (f"{plain(2)} ", "=" * r.randint(18, 30) + pick(alnum, 4)),
    ]
    out = []
    for i in range(n):
        before, s = r.choice(secrets if i % 2 else harmless)()
        likely, other = (LIVE_PATHS, TRIAL_PATHS) if i % 2 else (TRIAL_PATHS, LIVE_PATHS)
        path = f"{word()}/{r.choice(sorted(likely if r.random() < 0.75 else other))}/{word()}.txt" if r.random() < 0.5 else None
        out.append((f"{before}{s}{r.choice([' ', chr(34), chr(10)])}{plain(3)}", s, i % 2, path))
    return out


@dataclass(frozen=True)
class SecretScanner:
    forest: Forest
    threshold: float = THRESHOLD
    known: frozenset[str] = DICTIONARY

    def scan(self, text: str | None, path: str | None = None) -> list[tuple[str, int, int, float]]:
        """(kind, start, end, probability) of every candidate."""
        found = candidates(text)
        if not found:
            return []
        p = self.forest.predict(np.array([features(text, *c, path, self.known) for c in found], float))
        return [(*c, float(x)) for c, x in zip(found, p)]

    def redact(self, text: str | None) -> str | None:
        """The text with each secret replaced by a mark of its kind; other text is untouched."""
        found = [f for f in self.scan(text) if f[3] >= self.threshold]
        if not found:
            return text
        out, at = [], 0
        for kind, start, end, _ in found:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join([*out, text[at:]])


def fit_scanner(findings: Iterable[tuple], threshold: float = THRESHOLD, known: frozenset[str] = DICTIONARY) -> SecretScanner:
    """A scanner from labelled findings (text, finding, label and, if known, path) and a dictionary; a finding that no pattern proposes is left out."""
    x, y = [], []
    for text, finding, label, *path in findings:
        at = text.index(finding)
        for kind, start, end in candidates(text):
            if start < at + len(finding) and at < end:
                x.append(features(text, kind, start, end, path[0] if path else None, known))
                y.append(label)
    return SecretScanner(fit_forest(np.array(x, float), np.array(y)), threshold, known)


@lru_cache(maxsize=1)
def default_scanner() -> SecretScanner:
    """The scanner of :func:`labelled_findings` and the default dictionary, trained once in each process."""
    return fit_scanner(labelled_findings(), known=dictionary(default_vocabulary()))


def scan_secrets(docs: DataFrame, scanner: SecretScanner | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``id, kind, start, end, finding, score, is_secret``: one row for each candidate of each row of ``docs``; ``path_col`` names the column of file paths, if there is one.

    Positions are in code points of the text, in which invalid UTF-8 stands as replacement
    characters. Null and empty texts have no row; texts are taken whole, however long;
    repeated rows give repeated findings. Ids keep their type. Other columns are ignored
    whatever their names. An empty table gives an empty result.
    """
    python_batches(docs.sparkSession)
    names = ["id", "kind", "start", "end", "finding", "score", "is_secret"]
    scanner = scanner or default_scanner()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, k, s, e, t[s:e], p, p >= scanner.threshold) for at, (t, path) in enumerate(zip(values(batch.column(1)), values(batch.column(2)))) for k, s, e, p in scanner.scan(t, path)]
            at, *cols = list(zip(*rows)) if rows else [[]] * len(names)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    kept = docs.select(F.col(id_col).alias("id"), valid_utf8(F.col(text_col)).alias("text"), (valid_utf8(F.col(path_col)) if path_col else F.lit(None).cast("string")).alias("path"))
    return kept.mapInArrow(step, f"id {kept.schema['id'].dataType.simpleString()}, kind string, start long, end long, finding string, score double, is_secret boolean")


def redacted(text: Column, scanner: SecretScanner | None = None) -> Column:
    """A text column with its secrets replaced; null stays null, invalid UTF-8 becomes replacement characters."""
    scanner = scanner or default_scanner()

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        working("secrets")
        parts = (pa.array([scanner.redact(t) for t in texts.slice(low, 256).to_pylist()], pa.string()) for low in range(0, max(1, len(texts)), 256))
        return pa.concat_arrays(list(parts))

    return of(valid_utf8(text))
