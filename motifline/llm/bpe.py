"""Byte-pair encoding by backtracking over longest token matches, and decoding.

An Aho-Corasick automaton lists the longest token that starts at every place of a
word. The encoder takes longest matches from left to right; a token is kept only
when it is compatible with the one before it, that is, when merging the bytes of
the two gives just these two tokens. Otherwise the next shorter token is tried,
and a place from which nothing fits is never entered again. So every place is
left at most once, and the result is exactly that of the merge list.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame

from motifline.llm.common import map_column

CACHED_WORDS, CACHED_CHARS, CACHED_PAIRS = 200_000, 48, 500_000

# Fixed value: the word pattern that byte-level vocabularies of this kind are made for.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if it prints, else one from 256 up."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, spare = {b: chr(b) for b in prints}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tables of one vocabulary file; made once in each task."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        letters = byte_letters()
        ids: dict[str, int] = made["model"]["vocab"]
        added = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        # Latin-1 letters stand for bytes here, so that positions are byte positions.
        plain = str.maketrans({c: chr(b) for b, c in enumerate(letters)})
        self.tokens = {t.translate(plain): i for t, i in ids.items() if t not in added}
        size = 1 + max([*ids.values(), *added.values()])
        self.rank = [-1] * size  # when a token is made; bytes are there from the start
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(made["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.merged[left, right] = n
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = n, (left, right)
        self.automaton = ahocorasick.Automaton()
        self.length = [0] * size
        for t, i in self.tokens.items():
            # A longer token that no merge makes can't come out of the merge list.
            if len(t) == 1 or self.parts[i] is not None:
                self.automaton.add_word(t, (len(t), i))
            self.length[i] = len(t)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        for t, i in self.tokens.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := self.tokens.get(t[:n])) is not None and (n == 1 or self.parts[j] is not None):
                    self.shorter[i] = j
                    break
        self.fits: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(WORDS)
        self.added = added
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        texts = [b""] * size
        for t, i in self.tokens.items():
            texts[i] = t.encode("latin-1")
        for t, i in added.items():
            texts[i] = t.encode()
        self.bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.cache: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Would the merge list leave `a` and `b` beside each other?

        Undo merges from the last; a pair that meets across the seam and merges
        before the merge that was undone last breaks the two tokens. Of equal
        merges the left one comes first, so on the right a tie counts too.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        left, right, before = a, b, len(self.merged)
        fits = True
        while True:
            if self.merged.get((left, right), before) < before:
                fits = False
                break
            if self.rank[left] > self.rank[right]:
                before = self.rank[left]
                left = self.parts[left][1]
            elif self.parts[right] is not None:
                before = self.rank[right] + 1
                right = self.parts[right][0]
            else:
                break
        self.fits[a, b] = fits
        return fits

    def word(self, text: str) -> list[int]:
        """Tokens of one word."""
        data = text.encode().decode("latin-1")
        whole = self.tokens.get(data)
        n = len(data)
        longest: list[int | None] = [None] * (n + 1)
        width = [0] * (n + 1)
        for end, (size, token) in self.automaton.iter(data):
            start = end + 1 - size
            if size > width[start]:
                width[start], longest[start] = size, token
        if whole is not None and longest[0] == whole and self.parts[whole] is None:
            return [whole]
        out: list[int] = []
        closed = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + self.length[token]
            if not closed[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, longest[end]
            elif token in self.shorter:
                token = self.shorter[token]
            else:
                closed[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def encode(self, text: str) -> bytes:
        """Tokens of a whole text as little-endian 32-bit numbers."""
        cache, out = self.cache, []
        if len(cache) > CACHED_WORDS:
            cache.clear()
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                out.append(np.uint32(self.added[part]).tobytes())
                continue
            for w in self.words.findall(part):
                got = cache.get(w)
                if got is None:
                    got = np.array(self.word(w), dtype="<u4").tobytes()
                    if len(w) <= CACHED_CHARS:
                        cache[w] = got
                out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Text of tokens in UTF-8: gather each token's stretch of the byte table. Broken sequences become U+FFFD."""
        at = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        starts = self.offsets[at]
        sizes = self.offsets[at + 1] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        data = self.bytes[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes()
        return data.decode("utf-8", "replace").encode()


def encode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, n_tokens, and ids: the tokens of each whole text as an array.

    A null text counts as an empty one: no tokens. Repeated rows are encoded alike;
    other columns don't matter.
    """

    def make():
        v = Vocabulary(path)

        def one(t):
            ids = np.frombuffer(v.encode(t or ""), dtype="<u4").astype(np.int32)
            return len(ids), ids

        return one

    return map_column(df, keep, text, make, "n_tokens long, ids array<int>")


def decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Columns `keep` and text: the text of the tokens. Null or no tokens: empty text."""

    def make():
        v = Vocabulary(path)
        return lambda x: (v.decode(np.asarray(x or [], dtype="<u4").tobytes()).decode(),)

    return map_column(df, keep, ids, make, "text string")


def round_trip(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Digests of encoding each text and decoding its tokens, in one pass without keeping either."""

    def make():
        v = Vocabulary(path)

        def one(t):
            ids = v.encode(t or "")
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids)).hexdigest()

        return one

    return map_column(df, keep, text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
