"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

The leaves cut a text without gaps, so equal roots mean equal texts and a leaf's
place follows from the lengths before it. All cuts depend on the text around them
only: an edit changes the leaves it touches and the nodes above them, and later
parts come back into step. A fingerprint is the tree as a string:

    root|section:paragraph-leaf.leaf,paragraph-leaf;section:...

with eight letters for a node (48 bits) and, after a leaf's, its length in hex.
"""

from __future__ import annotations

import re
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b, sha256
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
WORD = re.compile(r"\S*\s*")
LONG_LEAF, LEAF_ENDS, SECTION_ENDS = 160, 8, 4  # one word in 8 may end a long leaf, one paragraph in 4 a section

Leaf = tuple[str, int]


def _name(kind: bytes, data: bytes) -> str:
    return b64encode(blake2b(kind + data, digest_size=6).digest()).decode()


def _leaves(paragraph: str) -> Iterator[str]:
    for sentence in SENTENCE.findall(paragraph):
        if len(sentence) <= LONG_LEAF:
            yield sentence
            continue
        start = at = 0
        for word in WORD.findall(sentence):
            at += len(word)
            if word and crc32(word.encode()) % LEAF_ENDS == 0:
                yield sentence[start:at]
                start = at
        if start < len(sentence):
            yield sentence[start:]


class Tree:
    """root, length, and sections: lists of (name, length, paragraphs), these of (name, length, leaves)."""

    __slots__ = ("root", "length", "sections")

    def __init__(self, root: str, sections: list):
        self.root, self.sections = root, sections
        self.length = sum(s[1] for s in sections)

    @classmethod
    def of(cls, text: str) -> Tree:
        sections, paragraphs = [], []
        for line in text.splitlines(keepends=True):
            leaves = [(_name(b"l", x.encode()), len(x)) for x in _leaves(line)]
            name = _name(b"p", "".join(f"{a}{n:x}" for a, n in leaves).encode())
            paragraphs.append((name, len(line), leaves))
            if not line.strip() or crc32(name.encode()) % SECTION_ENDS == 0:
                sections.append(cls._section(paragraphs))
                paragraphs = []
        if paragraphs:
            sections.append(cls._section(paragraphs))
        # The root covers the text itself as well, so it doesn't rest on 48-bit names alone.
        return cls(blake2b("".join(s[0] for s in sections).encode() + b"|" + text.encode(), digest_size=16).hexdigest(), sections)

    @staticmethod
    def _section(paragraphs: list) -> tuple:
        return _name(b"s", "".join(p[0] for p in paragraphs).encode()), sum(p[1] for p in paragraphs), paragraphs

    def __str__(self) -> str:
        return f"{self.root}|" + ";".join(
            f"{s}:" + ",".join(f"{p}-" + ".".join(f"{a}{n:x}" for a, n in leaves) for p, _, leaves in paragraphs)
            for s, _, paragraphs in self.sections
        )

    @classmethod
    def read(cls, fingerprint: str) -> Tree:
        root, _, rest = fingerprint.partition("|")
        sections = []
        for s in filter(None, rest.split(";")):
            name, _, inner = s.partition(":")
            paragraphs = []
            for p in inner.split(","):
                leaves = [(x[:8], int(x[8:], 16)) for x in p[9:].split(".")]
                paragraphs.append((p[:8], sum(n for _, n in leaves), leaves))
            sections.append((name, sum(p[1] for p in paragraphs), paragraphs))
        return cls(root, sections)


def _met(a: list, b: list) -> tuple[int, list, list]:
    """Code points of nodes that both lists have, and the nodes left over on either side."""
    left = Counter(x[0] for x in b)
    common, rest_a = 0, []
    taken: Counter[str] = Counter()
    for x in a:
        if taken[x[0]] < left[x[0]]:
            taken[x[0]] += 1
            common += x[1]
        else:
            rest_a.append(x)
    rest_b = []
    for x in b:
        if taken[x[0]] > 0:
            taken[x[0]] -= 1
        else:
            rest_b.append(x)
    return common, rest_a, rest_b


def likeness(a: Tree, b: Tree) -> float:
    """Share of the two texts in common nodes: 1 for equal roots, else from 0 to below 1.

    Goes down only where names differ: sections first, then the paragraphs of
    sections without a partner, then the leaves of paragraphs without one.
    """
    if a.root == b.root:
        return 1.0
    common, x, y = _met(a.sections, b.sections)
    for _ in range(2):
        met, x, y = _met([c for n in x for c in n[2]], [c for n in y for c in n[2]])
        common += met
    whole = a.length + b.length
    return min(2 * common / whole, 1 - 1e-9)


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: (start, end) in the first and (start, end) in the second, in order."""
    out: list[tuple[int, int, int, int]] = []

    def down(x: list, y: list, at: int, bt: int, depth: int) -> None:
        ends = lambda nodes, start: [start, *(start := start + n[1] for n in nodes)]
        xs, ys = ends(x, at), ends(y, bt)
        for op, i, j, k, m in SequenceMatcher(None, [n[0] for n in x], [n[0] for n in y], autojunk=False).get_opcodes():
            if op == "equal":
                continue
            if depth < 2 and i < j and k < m:
                down([c for n in x[i:j] for c in n[2]], [c for n in y[k:m] for c in n[2]], xs[i], ys[k], depth + 1)
            elif out and (out[-1][1], out[-1][3]) == (xs[i], ys[k]):
                out[-1] = (out[-1][0], xs[j], out[-1][2], ys[m])
            else:
                out.append((xs[i], xs[j], ys[k], ys[m]))

    if a.root != b.root:
        down(a.sections, b.sections, 0, 0, 0)
    return out


def fingerprints(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns `keep` and the fingerprint of each whole text; a null text counts as an empty one."""
    from motifline.llm.common import map_column

    return map_column(df, keep, text, lambda: lambda t: (str(Tree.of(t or "")),), "fingerprint string")


def _placed(df: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, kind, doc_id, text): each row in its bucket of ids (kind 0), and the row
    that follows a bucket's last, in descending order, once more in that bucket (kind 1).

    The upper ends of buckets are ids that exist, so the row after a bucket's last is
    known by its id alone. A null id comes last. After the very last comes the first.
    """
    ids = df.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"))
    shares = [i / buckets for i in range(1, buckets)]
    row = ids.agg(F.max("_id").alias("top"), F.percentile_approx("_id", shares, 10_000).alias("ends")).first()
    if row.top is None:
        return df.selectExpr("0 as bucket", "0 as kind", "cast(doc_id as long) as doc_id", "text")
    ends = sorted(set(row.ends or []) - {row.top})
    marks = F.lit(ends) if ends else F.expr("cast(array() as array<long>)")
    at = F.size(F.filter(marks, lambda e: e < F.col("_id")))
    place = lambda b, kind: F.struct(b.cast("int").alias("bucket"), F.lit(kind).alias("kind"))
    again = F.when(F.array_contains(marks, F.col("_id")), place(at + 1, 1)).when(F.col("_id") == row.top, place(F.lit(0), 1))
    return (
        df.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("_id"))
        .withColumn("_place", F.explode(F.array_compact(F.array(place(at, 0), again))))
        .selectExpr("_place.bucket as bucket", "_place.kind as kind", "doc_id", "text")
    )


def against_edits(df: DataFrame, buckets: int) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how like they are.

    Edited: the last third of the code points replaced by as many of the next
    document's first, in descending order of doc_id (ties by text, nulls last).
    Texts are shuffled once by ranges of ids; a task holds two texts at a time.
    A null text counts as an empty one; repeated rows follow each other.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def result(own: tuple, following: tuple) -> tuple:
        doc_id, text, tree = own
        k = len(text) // 3
        edited = text[: len(text) - k] + following[1][:k]
        other = Tree.of(edited)
        return (
            doc_id,
            len(text),
            sha256(edited.encode()).hexdigest(),
            str(tree),
            str(other),
            likeness(tree, other),
            likeness(tree, following[2]),
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, bucket = None, None
        for batch in batches:
            rows = []
            for b, kind, doc_id, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind and before is None:
                    continue  # a second row of the id that follows
                now = (doc_id, text or "", Tree.of(text or ""))
                if before is not None and b == bucket:
                    rows.append(result(before, now))
                before, bucket = None if kind else now, b
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    placed = _placed(df, buckets).repartition(buckets, "bucket")
    ordered = placed.sortWithinPartitions("bucket", "kind", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(task, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
