"""Porter's stemmer (1980) as an Arrow UDF; meant for the distinct vocabulary."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffixes with their replacements, in the paper's order.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
PAIRS2 = [p.split(":") for p in STEP2.split()]
PAIRS3 = [p.split(":") for p in STEP3.split()]
DROPPED = sorted(STEP4.split(), key=len, reverse=True)


def _shape(w: str) -> str:
    """v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return len(w) > 2 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def porter(w: str) -> str:
    if len(w) < 3:
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        base = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), None)
        if base is not None and "v" in _shape(base):
            w = base
            if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _cvc(w)):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for pairs in (PAIRS2, PAIRS3):
        hit = max((p for p in pairs if w.endswith(p[0])), key=lambda p: len(p[0]), default=None)
        if hit and _measure(w[: -len(hit[0])]):
            w = w[: -len(hit[0])] + hit[1]
    hit = next((s for s in DROPPED if w.endswith(s)), None)
    if hit and _measure(w[: -len(hit)]) > 1 and (hit != "ion" or w[: -len(hit)].endswith(("s", "t"))):
        w = w[: -len(hit)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def stem(s: pd.Series) -> pd.Series:
    return s.map(lambda w: None if w is None else porter(w))
