"""Pre-tokens of texts as spans over one array of code points.

Code points are put into four classes (white space, letters, numbers, others) by a table made once in
a process, and pieces are runs of one class with the tokenizers' exceptions:
contractions after an apostrophe, and a space that belongs to the piece behind it.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import numpy as np

from tillwise.llm.arrays import span_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
#: White space of the pre-token patterns (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    map(chr, range(0x2000, 0x200B)))
#: The pre-token pattern of the lower-casing scheme (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def classes() -> np.ndarray:
    points = np.arange(0x110000, dtype=np.uint32).view("U1")
    letter, number = np.char.isalpha(points), np.char.isnumeric(points)
    table = np.where(letter, LETTER, np.where(number, NUMBER, OTHER)).astype(np.uint8)
    table[[ord(c) for c in WHITE]] = SPACE
    return table


class Pieces:
    """Spans of the pre-tokens of some texts: text, start and end in the code points, and hash."""

    def __init__(self, texts: list[str], joined_space: bool):
        """``joined_space``: numbers are runs, white space is kept, and one space joins the piece
        behind it; without it, every digit is a piece and white space is dropped."""
        self.joined = "".join(texts)
        self.points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        self.offsets = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]
        n = len(self.points)
        kind = classes()[self.points]
        opens = np.zeros(n + 1, bool)  # a text begins here
        opens[self.offsets] = True
        begin = opens[:-1].copy()
        begin[1:] |= kind[1:] != kind[:-1]
        apostrophe = np.flatnonzero(begin & (self.points == 0x27))
        if joined_space:
            last = np.flatnonzero((kind == SPACE) & np.r_[kind[1:] != SPACE, True] & ~opens[1:])
            begin[last] = True  # the last white space before other text stands alone ...
            blank = last[self.points[last] == 0x20]
            begin[blank + 1] = False  # ... or, as a space, opens the next piece
            apostrophe = apostrophe[begin[apostrophe]]
        else:
            begin |= kind == NUMBER
        self._contractions(apostrophe, begin, opens)
        start = np.flatnonzero(begin)
        end = np.r_[start[1:], n] if n else start
        if not joined_space:
            held = kind[start] != SPACE
            start, end = start[held], end[held]
        self.start, self.end = start, end
        self.row = np.searchsorted(self.offsets, start, side="right") - 1
        self.hash = span_hashes(self.points, start, end, None)

    def _contractions(self, at: np.ndarray, begin: np.ndarray, opens: np.ndarray) -> None:
        """An apostrophe that opens a piece takes one of s, t, m, d, re, ve, ll behind it."""
        n = len(self.points)
        ahead = lambda k: np.where(at + k < n, self.points[np.minimum(at + k, n - 1)], 0)
        if not len(at):
            return
        same = ~opens[np.minimum(at + 1, n)]
        one, two = np.where(same, ahead(1), 0), np.where(same & ~opens[np.minimum(at + 2, n)], ahead(2), 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        begin[at[short | long] + 1] = False
        for held, size in ((short, 2), (long, 3)):
            behind = at[held] + size
            begin[behind[behind < n]] = True

    def text(self, k: int) -> str:
        return self.joined[self.start[k]:self.end[k]]


class Scheme:
    """How a tokenizer file cuts texts: its special strings, its normal form and its pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = json.load(file)
        pre, normal = self.spec["pre_tokenizer"], self.spec["normalizer"]
        self.specials = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]
               for t in self.spec["added_tokens"]):
            raise ValueError("special strings that take up their surroundings are not supported")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) \
            if self.specials else None
        if normal is None and pre["type"] == "ByteLevel" and pre["use_regex"] \
                and not pre["add_prefix_space"]:
            self.joined_space, self.lower = True, False
        elif normal and [s["type"] for s in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"] \
                and pre["pretokenizers"][0]["pattern"] == {"Regex": WORD_PATTERN}:
            self.joined_space, self.lower = False, True
        else:
            raise ValueError("this kind of pre-tokenizer is not supported")

    def normal(self, text: str) -> str:
        if self.lower and not text.isascii():
            # code points are lower-cased one by one, so a final sigma is like any other
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.lower() if self.lower else text

    def parts(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[tuple[int, int]]]:
        """Normal texts between special strings, the text each belongs to, and the special ids as
        (part they stand before, id)."""
        out, owner, found = [], [], []
        for k, text in enumerate(texts):
            at = 0
            for m in self.cut.finditer(text) if self.cut and "<" in text else ():
                out.append(self.normal(text[at:m.start()]))
                owner.append(k)
                found.append((len(out), self.specials[m[0]]))
                at = m.end()
            out.append(self.normal(text[at:] if at else text))
            owner.append(k)
        return out, np.array(owner, np.int64), found
