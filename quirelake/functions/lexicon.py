"""Fixed values of the Turkish repair rules, and the pattern compiler for broken words."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from quirelake.functions.text import WS, W

# Words that may be put together again.
MERGE_WORDS = frozenset("ahmet ama ancak arasında artık aynı başladı ben bir böyle bugün bunun çok çünkü daha devam dedi değil diye geldi gibi gitti hangi her herhangi için ile insan kitap kendi olarak oldu onun sonra şey vardı verildi yer yok zaman".split())
# Phrases replaced as they stand, in this order.
PHRASES = (
    ("Bug ün", "Bugün"), ("bug ün", "bugün"), ("Her hangi", "Herhangi"), ("her hangi", "herhangi"), ("i çin", "için"), ("I çin", "İçin"),
    ("a h met", "Ahmet"), ("A h met", "Ahmet"), ("k itap", "kitap"), ("g eldi", "geldi"), ("de vam", "devam"), ("y er", "yer"),
)
# Words written without Turkish letters, replaced whatever their case, in this order.
HINTS = (("cunku", "çünkü"), ("degil", "değil"), ("daha once", "daha önce"), ("icin", "için"), ("kitabi", "kitabı"), ("sehir", "şehir"), ("sey", "şey"), ("simdi", "şimdi"))
# Letters of the rules, and the lower-case ones.
LETTERS = "A-Za-zÇĞİÖŞÜçğıöşü"
LOWERS = "a-zçğıöşü"
UPPERS = "A-ZÇĞİÖŞÜ"
# Words that open a chapter heading.
CHAPTER_WORDS = ("Bölüm", "Chapter", "Kısım")
#: Longest part of a word that is put together.
LONGEST_PART = 12


@lru_cache(maxsize=1)
def _folded() -> dict[str, str]:
    """folded letter -> every letter of the basic plane that folds to it."""
    out: dict[str, str] = {}
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha() and len(f := c.casefold()) == 1:
            out[f] = out.get(f, "") + c
    return out


def _letter(c: str) -> str:
    same = _folded().get(c, c)
    return same if len(same) == 1 else f"[{same}]"


def _pattern(endings: list[tuple[str, ...]]) -> str:
    """A pattern for the given sequences, with common beginnings written once."""
    by_first: dict[str, list[tuple[str, ...]]] = {}
    for seq in endings:
        if seq:
            by_first.setdefault(seq[0], []).append(seq[1:])
    arms = [first + _pattern(rest) for first, rest in by_first.items()]
    if () in endings:
        arms.append("")
    return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"


@lru_cache(maxsize=8)
def merge_pattern(words: frozenset[str] = MERGE_WORDS) -> str:
    """Pattern of two whole words with white space between them that together make one of ``words``; groups 1 and 2 are the parts. Most places are within a word of plain letters, which is told fastest."""
    splits = [(*map(_letter, w[:k]), f"{WS}++", *map(_letter, w[k:])) for w in sorted(words) for k in range(1, len(w)) if k <= LONGEST_PART and len(w) - k <= LONGEST_PART]
    return rf"(?<![a-z])(?<!{W})(?={_pattern(splits)}(?!{W}))({W}+){WS}+({W}+)"


def merge_passes(words: Iterable[str] = MERGE_WORDS) -> int:
    """Passes after which merging changes nothing more: the deepest nesting of words made of words."""
    known = set(words)
    depth: dict[str, int] = {}
    for w in sorted(known, key=len):
        depth[w] = 1 + max((depth[p] for k in range(1, len(w)) for p in (w[:k], w[k:]) if p in known), default=0)
    return max(depth.values(), default=0)
