"""Misread letters of scans: which letters are taken for which, and the skeleton in which such pairs are equal."""

from __future__ import annotations

import functools
import re

import xxhash

#: (print, misread as). Fixed values, known confusions of character recognition.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("a", "o"), ("t", "f"), ("s", "f"), ("n", "u"), ("u", "n"), ("o", "0"), ("i", "j"), ("i", "l"), ("l", "i"),
    ("h", "b"), ("l", "1"), ("d", "cl"), ("w", "vv"), ("m", "rn"), ("b", "6"), ("g", "9"), ("v", "y"), ("in", "m"), ("t", "7"), ("s", "5"),
    ("ll", "u"), ("é", "6"), ("i", "1"), ("r", "n"), ("c", "o"), ("z", "2"), ("b", "8"), ("a", "q"), ("ü", "u"), ("ß", "b"), ("f", "t"), ("h", "li"), ("rn", "m"), ("e", "6"), ("m", "in"),
]

#: Letters in one class share a skeleton letter; sequences are folded first. Fixed values.
SEQUENCES = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("in", "m")]
CLASSES = ["eco0aqéèêëàâäáãóòôöõç6", "tfs57ß", "nuüúùûñ", "ijl1íìîï", "hb8", "g9", "vyÿý", "z2"]


@functools.cache
def _fold_table() -> dict[int, str]:
    return {ord(ch): cls[0] for cls in CLASSES for ch in cls}


def skeleton(text: str) -> str:
    """Small letters with confusable letters made equal; everything else is dropped but single blanks."""
    text = text.lower()
    for a, b in SEQUENCES:
        text = text.replace(a, b)
    return re.sub(r"[^\w]+", " ", text.translate(_fold_table())).strip()


#: A letter's share in an anagram hash has 46 bits: sums stay below 2**53 for words of up to 64 letters.
SHARE_BITS = (1 << 46) - 1


def letter_value(ch: str) -> int:
    """As Spark's xxhash64 of the letter, so that words are hashed by a built-in expression."""
    return xxhash.xxh64(ch.encode(), seed=42).intdigest() & SHARE_BITS


def anagram_hash(word: str) -> int:
    return sum(map(letter_value, word))
