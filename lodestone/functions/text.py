"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words too common to be concepts.
STOPWORDS = (
    "the", "and", "for", "with", "use", "used", "using", "via", "instead", "over", "than", "this", "that", "these", "those", "our", "was", "were", "are", "not", "but",
    "from", "into", "onto", "off", "due", "per", "add", "added", "new", "old", "set", "get", "all", "any", "can", "will", "has", "have", "its", "their",
)
#: Latin letters with marks and their plain letters, by Unicode's decomposition; then marks on their own, which go.
MARKED = {chr(c): d[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
MARKS = "".join(map(chr, range(0x300, 0x370)))
CHARS_PER_TOKEN = 3.5
SPACE = r"[\s\x0B\u0085   -     　﻿]"


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalise(text: Column) -> Column:
    return trim(F.regexp_replace(F.lower(text), f"{SPACE}+", " "))


def fold(text: Column) -> Column:
    """Lower case without accents. Text with as many bytes as characters is ASCII and has none."""
    plain = F.translate(text, "".join(MARKED) + MARKS, "".join(MARKED.values()))
    return F.lower(F.when(F.length(text) == F.octet_length(text), text).otherwise(plain))


def tokens(text: Column) -> Column:
    """Words in lower case without accents, in order: runs of Unicode letters and numbers."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def significant_tokens(text: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(normalise(text), "[^a-z0-9]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def fnv1a32(text: Column) -> Column:
    """FNV-1a over UTF-16 units below U+10000, as 8 hex digits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def utf16_length(text: Column) -> Column:
    """Characters, those above U+FFFF as two units."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def estimate_tokens(text: Column) -> Column:
    """ceil(UTF-16 length / 3.5)."""
    return F.ceil(utf16_length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def title(text: Column) -> Column:
    """The first level-one heading, or ''."""
    return trim(F.regexp_extract(text, r"(?m)^#\s+(.+?)\s*$", 1))


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null without one."""
    return F.try_element_at(F.filter(F.transform(F.split(text, r"\r?\n"), trim), lambda x: x != ""), F.lit(1))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


def slug(text: Column, ascii_only: bool = False) -> Column:
    """NFKD without accents, lower case, runs of other characters as '-'. NFKD
    has no built-in; texts known to be ASCII skip it."""
    folded = text if ascii_only else _fold(text)
    s = F.regexp_replace(F.regexp_replace(F.lower(folded), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "untitled").otherwise(s)


def footprint_id(created: Column, slug_: Column, suffix: Column) -> Column:
    """fp_<YYYYMMDD>_<slug with underscores>_<suffix>; created is ISO text in UTC."""
    return F.concat_ws("_", F.lit("fp"), F.translate(F.substring(created, 1, 10), "-", ""), F.translate(slug_, "-", "_"), suffix)


def suffix(*keys: Column) -> Column:
    """Six characters of a 32-letter alphabet that follow from the keys."""
    alphabet = F.lit("0123456789abcdefghjkmnpqrstvwxyz")
    h = F.xxhash64(*keys)
    return F.concat(*[F.substring(alphabet, (F.pmod(F.shiftright(h, 5 * i), F.lit(32)) + 1).cast("int"), F.lit(1)) for i in range(6)])


def version_parts(text: Column) -> Column:
    """Numbers that the parts of a version begin with, cut at '.' and '-', of any size; parts without one count as 0."""
    number = lambda p: F.regexp_extract(p, r"^\s*\+?([0-9]+)", 1).try_cast("double")
    return F.transform(F.split(text, "[.-]"), lambda p: F.coalesce(F.when(number(p) < float("inf"), number(p)), F.lit(0.0)))


def is_newer(a: Column, b: Column) -> Column:
    """Whether version a is later than b; missing parts are 0."""
    n = F.greatest(F.size(version_parts(a)), F.size(version_parts(b)))
    pad = lambda v: F.slice(F.concat(version_parts(v), F.array_repeat(F.lit(0.0), n)), F.lit(1), n)
    return pad(a) > pad(b)


def looks_like_file(target: Column) -> Column:
    """Whether a target of a query is a path: it has a slash, a backslash or an extension."""
    return target.rlike(r"[/\\\\]|\.[A-Za-z0-9]+$")


def split_csv(text: Column) -> Column:
    """Parts between commas, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), trim), lambda x: x != "")


def parse_rejected(text: Column) -> Column:
    """(option, reason) of "option: reason", cut at the first colon; without one there is no reason."""
    at = F.instr(text, ":")
    option = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    reason = F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")
    return F.struct(trim(option).alias("option"), trim(reason).alias("reason"))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")
