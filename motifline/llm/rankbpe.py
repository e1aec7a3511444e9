"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

A long text is cut before it reaches the library, so that a task holds the tokens of
one piece at a time. Cuts stand only where a letter, digit or punctuation mark is
followed by a space or line break: no match of the splitting pattern reaches over such
a place or looks behind it, so the tokens of the pieces in a row are those of the
whole text. A stretch without such a place stays in one piece. Decoding joins the raw
bytes of the tokens; they need not be UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from motifline.llm.common import map_column

PIECE_CHARS = 1 << 16
#: After a character that is no white space, before a space or line break.
SAFE_PLACE = r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])"


class Coder:
    """One rank file with its splitting pattern."""

    def __init__(self, rank_path: str, pattern: str):
        import regex
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.library = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.safe = regex.compile(SAFE_PLACE)
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    def pieces(self, text: str, chars: int = PIECE_CHARS) -> Iterator[str]:
        """`text` in pieces of about `chars` characters that can be encoded one by one."""
        start = 0
        while len(text) - start > chars:
            cut = self.safe.search(text, start + chars)
            if cut is None:
                break
            yield text[start : cut.start()]
            start = cut.start()
        if start < len(text):
            yield text[start:] if start else text

    def tokens(self, text: str) -> Iterator[list[int]]:
        for piece in self.pieces(text):
            yield self.library.encode_ordinary(piece)

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of their decimal ids joined by commas, digest of the decoded bytes."""
        n, ids, data = 0, hashlib.sha256(), hashlib.sha256()
        for some in self.tokens(text):
            ids.update(((n > 0) * "," + ",".join([self.decimal[i] for i in some])).encode())
            data.update(self.library.decode_bytes(some))
            n += len(some)
        return n, ids.hexdigest(), data.hexdigest()


@lru_cache(maxsize=2)
def coder(rank_path: str, pattern: str) -> Coder:
    """The coder of a worker process, read once from the file."""
    return Coder(rank_path, pattern)


def encode(df: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep`, n_tokens, and ids: the tokens of each whole text as an array.

    A null text counts as an empty one: no tokens. Strings of special tokens are ordinary
    text. Repeated rows are encoded alike, null keys pass, other columns don't matter; an
    empty table gives an empty one.
    """

    def make():
        c = coder(rank_path, pattern)

        def one(t):
            ids = np.concatenate([np.empty(0, np.int32), *[np.array(some, dtype=np.int32) for some in c.tokens(t or "")]])
            return len(ids), ids

        return one

    return map_column(df, keep, text, make, "n_tokens long, ids array<int>")


def decode(df: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """Columns `keep` and data: the raw bytes of the tokens. Null or no tokens: no bytes. An unknown id fails."""

    def make():
        c = coder(rank_path, pattern)
        return lambda x: (c.library.decode_bytes(x or []),)

    return map_column(df, keep, ids, make, "data binary")


def round_trip(df: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Digests of encoding each text and decoding its tokens, in one pass that holds the tokens of one piece.

    Nulls, empty texts, repeated rows and other columns as in `encode`.
    """

    def make():
        c = coder(rank_path, pattern)
        return lambda t: c.digests(t or "")

    return map_column(df, keep, text, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
