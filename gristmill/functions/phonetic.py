"""Phonetic keys of names, by rules in the manner of metaphone codes (the primary code; up to six consonants a word)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import product

import pandas as pd
from pyspark.sql import functions as F

_VOWELS = set("aeiouy")
_FIRST = {"kn": "n", "gn": "n", "pn": "n", "wr": "r", "ps": "s", "x": "s", "wh": "w"}
_PAIRS = {"sch": "SK", "tch": "X", "ch": "X", "sh": "X", "ph": "F", "th": "0", "ck": "K", "dge": "J", "dgi": "J", "dgy": "J", "gh": "", "tia": "X", "tio": "X", "cia": "X", "sio": "X"}
_SINGLE = {"b": "P", "d": "T", "f": "F", "j": "J", "k": "K", "l": "L", "m": "M", "n": "N", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "v": "F", "x": "KS", "z": "S"}


def word_key(word: str, length: int = 6) -> str:
    """Key of a word of letters a-z; a vowel counts only at the start, as A."""
    for prefix, sound in _FIRST.items():
        if word.startswith(prefix):
            word = sound + word[len(prefix) :]
            break
    out, i = [], 0
    while i < len(word):
        c = word[i]
        if i and c == word[i - 1] and c != "c":
            i += 1
            continue
        pair = next((p for p in _PAIRS if word.startswith(p, i)), None)
        if pair is not None:
            out.append(_PAIRS[pair])
            i += len(pair) - (pair[-1] in _VOWELS)
            continue
        after = word[i + 1 : i + 2]
        if c in _VOWELS:
            out.append("A" if i == 0 else "")
        elif c == "c":
            out.append("S" if after in ("e", "i", "y") else "K")
        elif c == "g":
            out.append("J" if after in ("e", "i", "y") else "K")
        elif c == "h":
            out.append("H" if after in _VOWELS and (i == 0 or word[i - 1] in _VOWELS) else "")
        elif c == "w":
            out.append("A" if i == 0 else "")
        else:
            out.append(_SINGLE.get(c, ""))
        i += 1
    return "".join(out)[:length]


def name_key(clean: str) -> str:
    """Keys of a cleaned name's words, sorted and joined by #."""
    return "#".join(sorted(word_key(w) for w in clean.split()))


def name_keys(clean: str, nicknames: Mapping[str, set[str]]) -> list[str]:
    """name_key, and the keys with nicknames replaced by the full names they may stand for."""
    options = [sorted({k, *nicknames.get(k, ())}) for k in (word_key(w) for w in clean.split())]
    return sorted({"#".join(sorted(p)) for p in product(*options)})


def name_keys_udf(nicknames: Mapping[str, set[str]]):
    """Arrow UDF from cleaned names to arrays of name_keys; null for null."""

    @F.pandas_udf("array<string>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for names in batches:
            yield names.map(lambda n: None if n is None else name_keys(n, nicknames))

    return keys
