"""White-space words and their token ids.

The vocabulary's normaliser and pre-tokeniser never join text across white
space and its special strings hold none, so a text's ids are the ids of its
white-space words in a row. Each distinct word needs the library once."""

from __future__ import annotations

import re
import string
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import remembered

#: Unicode white space. str.split() also splits at U+001C to U+001F, which the library keeps.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = re.compile("[\x1c-\x1f]")
WIDE = re.compile("[̀-\U0010ffff]")
MARKS = string.punctuation
#: Words of more characters are passed to the library each time, so that memory stays bounded.
LONGEST_KEPT = 64


def words(text: str) -> list[str]:
    """White-space words, in lower case where that can't change the ids: below
    U+0300 lower case commutes with the library's normaliser, and a text that
    may hold special strings, which are told apart by case, stays as it is."""
    if "<|" not in text and not WIDE.search(text):
        text = text.lower()
    if SEPARATORS.search(text):
        return [w for w in SPACES.split(text) if w]
    return text.split()


def little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    made = array("I", ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class Coder:
    """The ids of words. Words met lately are remembered in two generations of
    about `room` each; longer ones than LONGEST_KEPT only while they are used."""

    def __init__(self, path: str, room: int = 900_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.room, self.young, self.old = room, {}, {}

    def encode(self, new: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        """Put new words among the young. The library cuts marks off letters, so
        a word of letters and ASCII marks behind them is made of the two."""
        young, old = self.young, self.old
        parts, unknown = {}, {}
        for w in new:
            core = w.rstrip(MARKS)
            if len(core) == len(w) or not core.isalpha():
                unknown[w] = None
            else:
                parts[w] = core, w[len(core) :]
                for x in parts[w]:
                    if (b := old.get(x)) is not None:
                        young[x] = b
                    elif x not in young:
                        unknown[x] = None
        unknown = list(unknown)
        young.update((w, little(ids)) for w, ids in zip(unknown, self.encode(unknown), strict=True))
        for w, (core, marks) in parts.items():
            young[w] = young[core] + young[marks]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, little-endian unsigned 32-bit."""
        split = [words(t) for t in texts]
        found = [list(map(self.young.get, s)) for s in split]
        gaps = [[i for i, b in enumerate(f) if b is None] if None in f else () for f in found]
        missing = {s[i] for s, g in zip(split, gaps, strict=True) for i in g}
        if missing:
            again = {w: self.old[w] for w in missing if w in self.old}
            self.young.update(again)
            self.learn([w for w in missing if w not in again])
            for s, f, g in zip(split, found, gaps, strict=True):
                for i in g:
                    f[i] = self.young[s[i]]
        out = [b"".join(f) for f in found]
        if len(self.young) > self.room:
            self.young, self.old = {}, self.young
        for w in [w for w in missing if len(w) > LONGEST_KEPT]:
            for part in (w, w.rstrip(MARKS), w[len(w.rstrip(MARKS)) :]):
                self.young.pop(part, None)
                self.old.pop(part, None)
        return out


def slices(texts: pa.Array, most: int = 2_000_000):
    """Runs of texts of about `most` bytes, so that a batch of long texts is worked off in parts."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(sizes):
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        end = max(end, at + 1)
        yield at, end
        at = end


def coder(path: str) -> Coder:
    """One per worker process."""
    return remembered(("words", path), lambda: Coder(path))
