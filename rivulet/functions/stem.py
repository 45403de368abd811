"""English stems by the published Porter2 algorithm, for tokens.

The only text function that leaves the JVM: the distinct tokens of an Arrow batch are stemmed, each once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fixed values of the algorithm: exceptions, suffixes with what replaces them, double letters, letters before "li".
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()},
}
AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"

_V = "aeiouy"
_REGION = re.compile(rf"[{_V}][^{_V}]")
_SHORT = re.compile(rf"(?:^[{_V}][^{_V}]|[^{_V}][{_V}][^{_V}wxY])$")
_HAS_VOWEL = re.compile(f"[{_V}]")


def _ending(word: str, suffixes) -> str:
    """The longest of the suffixes that the word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default="")


def _regions(w: str) -> tuple[int, int]:
    """Where the parts behind the first and the second consonant that follows a vowel begin."""
    first = re.match("gener|commun|arsen", w) or _REGION.search(w)
    r1 = first.end() if first else len(w)
    second = _REGION.search(w, r1)
    return r1, second.end() if second else len(w)


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    """The stem of a token of letters in lower case; other tokens stay as they are."""
    if not word.replace("'", "").isalpha():
        return word
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in EXCEPTIONS:
        return EXCEPTIONS[w]
    w = w.removeprefix("'")
    w = re.sub(rf"(?:^|(?<=[{_V}]))y", "Y", w)
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):  # 0
        if w.endswith(s):
            w = w[: -len(s)]
            break
    if w.endswith("sses"):  # 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _HAS_VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    w = _step_1b(w, r1)
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:  # 1c
        w = w[:-1] + "i"
    s = _ending(w, STEP_2)
    at = len(w) - len(s)
    if s and at >= r1 and (s != "ogi" or w[:at].endswith("l")) and (s != "li" or w[at - 1] in LI_ENDING):
        w = w[:at] + STEP_2[s]
    s = _ending(w, STEP_3)
    at = len(w) - len(s)
    if s and at >= r1 and (s != "ative" or at >= r2):
        w = w[:at] + STEP_3[s]
    s = _ending(w, STEP_4)
    at = len(w) - len(s)
    if s and at >= r2 and (s != "ion" or w[:at].endswith(("s", "t"))):
        w = w[:at]
    at = len(w) - 1  # 5
    if w.endswith("e") and (at >= r2 or (at >= r1 and not _SHORT.search(w[:at]))):
        w = w[:at]
    elif w.endswith("ll") and at >= r2:
        w = w[:at]
    return w.replace("Y", "y")


def _step_1b(w: str, r1: int) -> str:
    s = _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    at = len(w) - len(s)
    if s in ("eed", "eedly"):
        return w[:at] + "ee" if at >= r1 else w
    if not s or not _HAS_VOWEL.search(w[:at]):
        return w
    w = w[:at]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w.endswith(DOUBLES):
        return w[:-1]
    return w + "e" if r1 >= len(w) and _SHORT.search(w) else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(tokens: pd.Series) -> pd.Series:
    lists = pa.array(tokens, pa.list_(pa.string()))
    flat = lists.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    out = pa.ListArray.from_arrays(lists.offsets, stems.take(flat.indices)) if len(lists) else lists
    return pd.Series([None if t is None else s for t, s in zip(tokens, out.to_pylist(), strict=True)], dtype=object)


def stem_tokens(tokens: Column) -> Column:
    return _stems(tokens)
