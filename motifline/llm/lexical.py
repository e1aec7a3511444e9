"""Ranked lexical search by best-first descent over document intervals.

Documents are cut into blocks; in a block every query term has a posting list in
document order with a sparse table of range maxima over its impacts. An interval of
documents is bounded by the sum, over the query's terms, of the largest impact that
each list has inside it: one table lookup per term. Intervals are taken best bound
first and split at the document that holds the largest impact: that document is scored
exactly, what lies left and right of it goes back with bounds of its own. Intervals of
a few documents are scored whole. A query is done when no interval can hold a document
that is among the k best; blocks of one task share what they have found.

No posting is shuffled: blocks are made of the rows a task reads anyway, so a common
word or a group of copies is as spread as the rows are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from motifline.llm.common import drop_staged, slices
from motifline.plans.blocks import stage

BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
#: Intervals of at most this many documents are scored whole.
LEAF_DOCS = 16
#: Intervals handled at once: few at first, while the best documents are not known.
FIRST_ROUND, MOST_AT_ONCE = 8, 256
#: Terms of the queries that are searched in one go; more queries make more goes.
BATCH_TERMS = 1_000_000

_TERM_BYTES = bytes(
    b if b >= 128 or chr(b).isalnum() else 32 for b in (ord(chr(b).lower()) if b < 128 else b for b in range(256))
)


def words(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, digits and anything beyond ASCII; only A-Z in lower case."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Block:
    """Posting lists of some documents, with range-maximum tables."""

    def __init__(self, ids: np.ndarray, impacts: Sequence[np.ndarray], terms: Sequence[np.ndarray], vocabulary: int):
        sizes = np.array([len(t) for t in terms], dtype=np.int64)
        flat = np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64)
        self.ids, self.docs = ids, len(ids)
        order = np.argsort(flat, kind="stable")  # documents stay in order inside a list
        self.doc = np.repeat(np.arange(len(ids)), sizes)[order]
        self.impact = np.concatenate([*impacts, np.empty(0, np.int64)]).astype(np.int64)[order]
        self.key = flat[order] * self.docs + self.doc
        self.begin = np.searchsorted(flat[order], np.arange(vocabulary + 1))
        longest = int(np.diff(self.begin).max(initial=1))
        self.level = np.zeros(longest + 1, dtype=np.int64)
        for n in range(2, longest + 1):
            self.level[n] = self.level[n >> 1] + 1
        # table[j, p]: place of the largest of the 2**j impacts from p on. Lists stand one
        # behind another; what would reach into the next list is never asked for.
        self.table = np.empty((int(self.level[longest]) + 1, len(flat)), dtype=np.int32)
        self.table[0] = np.arange(len(flat))
        for j in range(1, len(self.table)):
            half, last = 1 << (j - 1), self.table[j - 1]
            self.table[j] = last
            left, right = last[:-half], last[half:]
            self.table[j, : len(left)] = np.where(self.impact[left] >= self.impact[right], left, right)

    def maxima(self, start: np.ndarray, end: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval (row) and term (column): the largest weighted impact, 0 if there is none, and its place."""
        size = end - start
        some = size > 0
        level = self.level[np.where(some, size, 1)]
        left = self.table[level, np.where(some, start, 0)]
        right = self.table[level, np.where(some, end - (1 << level), 0)]
        place = np.where(self.impact[left] >= self.impact[right], left, right)
        return np.where(some, self.impact[place] * weights, 0), place

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """Scores and ids of the k best documents that score at least `least`; and how many were scored.

        Documents that tie with the last one are ordered by id.
        """
        there = (self.begin[terms] < self.begin[terms + 1]) & (weights > 0)
        terms, weights = terms[there], weights[there]
        best, best_ids, scored = np.empty(0, np.int64), np.empty(0, np.int64), 0
        lo, hi = np.zeros(1, np.int64), np.full(1, self.docs)
        start, end = self.begin[terms][None, :], self.begin[terms + 1][None, :]
        values, places = self.maxima(start, end, weights)
        bound, at_once = values.sum(1), FIRST_ROUND
        while len(bound):
            keep = bound >= least
            if not keep.all():
                lo, hi, start, end, bound, values, places = (a[keep] for a in (lo, hi, start, end, bound, values, places))
                if not len(bound):
                    break
            if len(bound) > at_once:
                order = np.argpartition(-bound, at_once)
                now, later = order[:at_once], order[at_once:]
            else:
                now, later = np.arange(len(bound)), np.empty(0, np.int64)
            at_once = min(2 * at_once, MOST_AT_ONCE)
            small = hi[now] - lo[now] <= LEAF_DOCS
            whole, cut = now[small], now[~small]
            found, found_ids = [], []
            if len(whole):
                s, n = start[whole], (end - start)[whole]
                sizes = n.ravel()
                till = np.cumsum(sizes)
                at = np.arange(till[-1]) + np.repeat(s.ravel() - till + sizes, sizes)
                total = np.zeros(self.docs, np.int64)
                np.add.at(total, self.doc[at], self.impact[at] * np.repeat(np.broadcast_to(weights, n.shape).ravel(), sizes))
                hit = np.flatnonzero(total)
                found, found_ids = [total[hit]], [hit]
                scored += len(hit)
            children = ()
            if len(cut):
                lead = values[cut].argmax(1)
                split = self.doc[places[cut, lead]]
                asked = terms[None, :] * self.docs + split[:, None]
                at = np.searchsorted(self.key, asked.ravel()).reshape(asked.shape)
                holds = (at < end[cut]) & (self.key[np.minimum(at, len(self.key) - 1)] == asked)
                total = (np.where(holds, self.impact[np.minimum(at, len(self.key) - 1)], 0) * weights).sum(1)
                found.append(total)
                found_ids.append(split)
                scored += len(split)
                new = (np.concatenate([lo[cut], split + 1]), np.concatenate([split, hi[cut]]),
                       np.concatenate([start[cut], at + holds]), np.concatenate([at, end[cut]]))
                v, p = self.maxima(new[2], new[3], weights)
                children = (*new, v.sum(1), v, p)
            if found:
                best = np.concatenate([best, *found])
                best_ids = np.concatenate([best_ids, *[self.ids[d] for d in found_ids]])
                order = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[order], best_ids[order]
                if len(best) == k:
                    least = max(least, int(best[-1]))
            rest = [a[later] for a in (lo, hi, start, end, bound, values, places)]
            lo, hi, start, end, bound, values, places = (
                [np.concatenate([a, b]) for a, b in zip(rest, children, strict=True)] if children else rest
            )
        good = best >= least
        return best[good], best_ids[good], scored


def _vectors(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """key, n (terms of the text), and those of the vocabulary with how often they occur; only texts with a term."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("n long, terms array<int>, counts array<int>")])
    types = [to_arrow_type(f.dataType) for f in schema]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for b in slices(batches, 256):
            n, terms, counts = [], [], []
            for t in b.column(1).to_pylist():
                found = words(t)
                here = [(i, c) for w, c in Counter(found).items() if (i := known(w)) is not None]
                here.sort()
                n.append(len(found))
                terms.append(np.array([i for i, _ in here], dtype=np.int32))
                counts.append(np.array([c for _, c in here], dtype=np.int32))
            columns = [b.column(0), *[pa.array(v, type=t) for v, t in zip((n, terms, counts), types[1:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, text).mapInArrow(task, schema).where("n > 0")


def _frequencies(vectors: DataFrame, size: int) -> list[int]:
    """How many rows hold each term of the vocabulary."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, np.int64)
        for b in batches:
            seen += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], names=["term", "df"])

    out = [0] * size
    for r in vectors.select("terms").mapInArrow(task, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def _best_of_blocks(
    vectors: DataFrame, key: str, queries: list[tuple[np.ndarray, np.ndarray]], size: int, docs: int, total: int, k: int
) -> DataFrame:
    """(query, key, score): of each task, the k best documents of each query."""
    schema = T.StructType([T.StructField("query", T.IntegerType()), vectors.schema[key], T.StructField("score", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries]

        def search(rows: list[tuple]) -> None:
            # Documents of one kind stand together, so that intervals have tight bounds.
            rows.sort(key=lambda r: (int(r[2][r[3].argmax()]), r[1]))
            block = Block(
                np.array([r[0] for r in rows], dtype=np.int64),
                [1_000_000_000 * r[3] // (1000 * r[3] + 12 * (100 - 25 + 25 * r[1] * docs // total)) for r in rows],
                [r[2] for r in rows], size,
            )
            for q, (terms, weights) in enumerate(queries):
                scores, ids = best[q]
                least = int(scores[-1]) if len(scores) == k else 1
                more, more_ids, _ = block.search(terms, weights, k, least)
                if len(more):
                    scores, ids = np.concatenate([scores, more]), np.concatenate([ids, more_ids])
                    order = np.lexsort((ids, -scores))[:k]
                    best[q] = scores[order], ids[order]

        rows, postings = [], 0
        for b in batches:
            ids, n = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            terms, counts = b.column(2), b.column(3)
            cuts = terms.offsets.to_numpy()
            flat, times = terms.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
            for i in range(b.num_rows):
                if cuts[i] == cuts[i + 1]:
                    continue
                rows.append((int(ids[i]), int(n[i]), flat[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]]))
                postings += int(cuts[i + 1] - cuts[i])
                if len(rows) == BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    search(rows)
                    rows, postings = [], 0
        if rows:
            search(rows)
        numbers = np.repeat(np.arange(len(queries), dtype=np.int32), [len(s) for s, _ in best])
        columns = [pa.array(numbers), *[pa.array(np.concatenate([*c, np.empty(0, np.int64)])) for c in ([i for _, i in best], [s for s, _ in best])]]
        yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(to_arrow_type(schema[key].dataType)), columns[2]], names=schema.names)

    return vectors.where(F.col(key).isNotNull()).mapInArrow(task, schema)


def _queries(items: DataFrame, item: str, text: str) -> Iterator[dict]:
    """Items in batches, each a map from item to how often it has each term."""
    rows = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).alias("item"), F.col(text).alias("text")).distinct()
    # Rows are dealt by hash, so that a batch is of like size; a term takes two characters at least.
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    goes = -(-chars // (2 * BATCH_TERMS)) or 1
    for go in range(goes):
        found: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(goes)) == go).collect():
            found.setdefault(r.item, Counter()).update(words(r.text))
        yield {i: c for i, c in found.items() if c}


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """item, rank, key, score: the k best documents of each item, all if fewer score above 0.

    Every row of `docs` is a document of its own, so a repeated row can be listed twice; ties
    go to the smaller key. Rows with a null key count in the statistics and are not listed.
    Null and empty texts have no terms. Item rows without an id or text give nothing,
    repeated ones count once, and different texts of one item are one query. Keys are
    integers. Empty tables give an empty result; other columns don't matter.
    """
    names = T.StructType([T.StructField("query", T.IntegerType()), items.schema[item]])
    spark, parts = docs.sparkSession, []
    for found in _queries(items, item, item_text):
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*found.values())))}
        vectors = stage(_vectors(docs, key, text, vocabulary))
        whole = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total")).first()
        df = _frequencies(vectors, len(vocabulary))
        queries = []
        for c in found.values():
            terms = np.array([vocabulary[w] for w in c], dtype=np.int64)
            weights = np.array([n * term_weight(whole.docs, df[vocabulary[w]]) for w, n in c.items()], dtype=np.int64)
            queries.append((terms, weights))
        best = stage(_best_of_blocks(vectors, key, queries, len(vocabulary), whole.docs, whole.total or 1, k))
        drop_staged(vectors)
        # As many rows as the batch has items.
        ids = spark.createDataFrame([(q, i) for q, i in enumerate(found)], names)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col(key))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(ranked.join(ids, "query").select(item, "rank", key, "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


ORACLE = """
with docs as (
  select doc_id, row_number() over () as r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents),
sized as (select doc_id, r, ws, len(ws) as n from docs where len(ws) > 0),
whole as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from sized),
counted as (select r, t, count(*) as tf from (select r, unnest(ws) as t from sized) group by r, t),
wanted as (
  select item_id, t, count(*) as times from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as t
    from (select distinct item_id, text from benchmark where item_id is not null)) group by item_id, t),
weighed as (select t, cast(floor(1000 * ln((2 * big_n + 2) / (2 * df + 1))) as bigint) as w from (select t, count(*) as df from counted group by t), whole),
scored as (
  select item_id, r, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * big_n) // big_l))))) as bigint) as score
  from wanted join weighed using (t) join counted using (t) join sized using (r), whole group by item_id, r)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from scored join sized using (r) where score > 0 and doc_id is not null qualify rank <= 20"""
