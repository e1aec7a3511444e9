"""Nearest known word by edit distance: descent of tries of the known words, from both ends.

The words of a model are cut into shards: a shard holds the words that start with one
prefix, the shortest that leaves at most SHARD_WORDS of them. A task gets some shards,
one large or many small ones, and the words asked for in them. It builds tries with a
root for each shard, of the words and of the words read backwards, and takes the asked
words through them together with their rows of the Levenshtein table: the state a
Levenshtein automaton is in after the letters of a trie node.

Distances are tried in ascending order. Of k edits, either at most k // 2 fall on the
first half of the asked word, or at most (k - 1) // 2 on the rest. So a descent from
the front or one from the back finds every word within k edits, and in that half a
descent goes on only within about half of the edits. A node whose row holds nothing
within reach is not entered.

Each word first searches the shard its own prefix leads to. Beyond it, only shards
whose prefix can be within the distance found so far are searched.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from motifline.plans.blocks import attach, stage

SHARD_WORDS, ASKED_AT_ONCE = 262_144, 4_096
#: Shards of fewer words share a task, up to about this many words in all.
TASK_WORDS = 16_384
#: Pairs of an asked word and a trie node that are open at once.
OPEN_PAIRS = 1 << 19
FAR = 1 << 29


class Levels:
    """Prefixes of words in order of model and letters, one level of nodes for each number of letters.

    Level 0 has one node for each model. `place` are the words' numbers.
    """

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, model: np.ndarray, place: np.ndarray):
        longest = letters.shape[1]
        same = np.ones((len(sizes), longest), dtype=bool)
        same[1:] = letters[1:] == letters[:-1]
        shared = np.logical_and.accumulate(same, axis=1).sum(1)  # letters in common with the word before
        shared[1:][model[1:] != model[:-1]] = -1
        shared[:1] = -1
        # Of each level's nodes: last letter, a bound of the least place below, place of the word that ends there or -1, first child.
        self.letter, self.least, self.word, self.children = [], [], [], []
        above = np.zeros(len(sizes), dtype=np.int32)
        for depth in range(longest + 1):
            here = np.flatnonzero((sizes >= depth) & (shared < depth))
            self.least.append(np.minimum.reduceat(place, here) if len(here) else here)
            self.letter.append(letters[here, depth - 1] if depth else np.zeros(len(here), dtype=letters.dtype))
            self.word.append(np.where(sizes[here] == depth, place[here], -1))
            if depth:
                self.children.append(np.searchsorted(above[here], np.arange(len(self.word[depth - 1]) + 1)).astype(np.int32))
            above = (np.searchsorted(here, np.arange(len(sizes)), side="right") - 1).astype(np.int32)
        self.children.append(np.zeros(len(self.word[-1]) + 1, dtype=np.int32))

    def within(self, letters: np.ndarray, sizes: np.ndarray, root: np.ndarray, most: np.ndarray, edits: int, best: np.ndarray) -> None:
        """Lower `best` to the least place of a word within `edits` of each asked word, by ways whose cost
        after each number of the asked word's letters is at most `most`."""
        # A column of the table is a row here, so that every step runs over all pairs at once. Cells out of reach are `far`.
        far, kind = (100, np.int8) if edits < 100 else (FAR, np.int32)
        letters, most = np.ascontiguousarray(letters.T), np.ascontiguousarray(most.T.astype(kind))
        steps = np.minimum(np.arange(len(most)), far).astype(kind)[:, None]
        stack = [(0, np.arange(len(sizes)), root, np.where(steps > most, kind(far), steps))]
        while stack:
            depth, who, node, table = stack.pop()
            word = self.word[depth][node]
            ends = np.flatnonzero(word >= 0)
            ends = ends[table[sizes[who[ends]], ends] <= edits]
            np.minimum.at(best, who[ends], word[ends])
            # Go on where an earlier word can come out.
            go = np.flatnonzero(self.least[depth][node] < best[who])
            start, end = (self.children[depth][node[go] + i].astype(np.int64) for i in (0, 1))
            till = np.cumsum(end - start)
            if not len(till) or not till[-1]:
                continue
            if till[-1] > OPEN_PAIRS and len(go) > 1:
                half = len(go) // 2
                stack += [(depth, who[some], node[some], table[:, some]) for some in (go[half:], go[:half])]
                continue
            parent = np.repeat(go, end - start)
            child = np.arange(till[-1]) - np.repeat(till - end, end - start)
            who, above = who[parent], table[:, parent]
            new = np.empty_like(above)
            new[0] = min(depth + 1, far)
            other = np.take(letters, who, axis=1) != self.letter[depth + 1][child]
            np.minimum(above[1:] + kind(1), above[:-1] + other, out=new[1:])
            for j in range(1, len(new)):
                np.minimum(new[j], new[j - 1] + kind(1), out=new[j])
            np.putmask(new, new > np.take(most, who, axis=1), far)
            near = np.flatnonzero(new.min(0) < far)
            stack.append((depth + 1, who[near], child[near], new[:, near]))


class Trie:
    """Words of one or more models, to be searched from both ends."""

    def __init__(self, words: list[str], models: Sequence[int] | None = None):
        pairs = sorted(set(zip(models if models is not None else [0] * len(words), words, strict=True)))
        self.words, model = [w for _, w in pairs], np.array([m for m, _ in pairs], dtype=np.int64)
        self.models = np.unique(model)
        letters, sizes = coded(self.words)
        self.alphabet = np.unique(letters[letters > 0])
        letters = self._lettered(letters)
        place, back = np.arange(len(sizes)), turned(letters, sizes)
        order = np.lexsort([*back.T[::-1], model])
        self.longest = letters.shape[1]
        self.ahead = Levels(letters, sizes, model, place)
        self.back = Levels(back[order], sizes[order], model[order], place[order])

    def _lettered(self, letters: np.ndarray) -> np.ndarray:
        """Code points by their number in the words' alphabet from 1 on, others by one more; 0 stays."""
        number = np.searchsorted(self.alphabet, letters)
        known = np.append(self.alphabet, 0)[number] == letters
        codes = np.where(letters > 0, np.where(known, number, len(self.alphabet)) + 1, 0)
        return codes.astype(np.uint8 if len(self.alphabet) < 255 else np.int32)

    def nearest(self, asked: list[str], upto: np.ndarray, models: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each asked word, the place of its model's nearest word, first of equals, and the distance.

        -1 where no word is within `upto` edits.
        """
        letters, sizes = coded(asked)
        letters = self._lettered(letters)
        models = np.zeros(len(asked), dtype=np.int64) if models is None else models
        root = np.searchsorted(self.models, models)
        best, distance = np.full(len(asked), -1, dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
        rest = np.flatnonzero((upto >= 0) & np.isin(models, self.models))
        edits, most = 0, max(self.longest, letters.shape[1])
        while len(rest) and edits <= most:
            for some in np.array_split(rest, -(-len(rest) // 1024)):
                best[some] = self._within(letters[some], sizes[some], root[some], edits)
            distance[rest] = edits
            edits += 1
            rest = rest[(best[rest] < 0) & (upto[rest] >= edits)]
        return best, distance

    def _within(self, letters: np.ndarray, sizes: np.ndarray, root: np.ndarray, edits: int) -> np.ndarray:
        """First word within `edits` of each asked word, -1 if there is none."""
        best = np.full(len(sizes), len(self.words), dtype=np.int64)
        column, half, size = np.arange(letters.shape[1] + 1), (sizes // 2)[:, None], sizes[:, None]

        def bounds(first: np.ndarray, least: int) -> np.ndarray:
            """Edits allowed up to each column: `least` in the first ones, none behind the word."""
            return np.where(column > size, -1, np.where(column < first, least, edits)).astype(np.int32)

        self.ahead.within(letters, sizes, root, bounds(half + 1, edits // 2), edits, best)
        if edits:
            self.back.within(turned(letters, sizes), sizes, root, bounds(size - half, (edits - 1) // 2), edits, best)
        return np.where(best < len(self.words), best, -1)


def turned(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The coded words read backwards."""
    from_end = sizes[:, None] - 1 - np.arange(letters.shape[1])[None, :]
    return np.where(from_end >= 0, np.take_along_axis(letters, np.maximum(from_end, 0), axis=1), 0).astype(letters.dtype)


def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, a row each, and their lengths. Codes are positive; what follows a word is 0."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros((len(words), int(sizes.max(initial=0))), dtype=np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<i4")
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat + 1
    return out, sizes


def _shards(known: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Known words with the `_shard` they are in; the shards; `total` of the models that are cut into several.

    A shard has its `prefix`, its number `_shard` and `_bucket`, which small shards share.
    A word that is itself a prefix of too many gets a shard of its own.
    """
    totals = stage(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")))
    whole = totals.where(F.col("total") <= SHARD_WORDS).select(*keys, F.lit("").alias("prefix"), F.col("total").alias("_words"))
    large = totals.where(F.col("total") > SHARD_WORDS)
    if large.isEmpty():
        found, large = whole, None
    else:
        heads = "transform(sequence(1, length(state) + 1), n -> if(n > length(state), state || '\\0', left(state, n)))"
        heads = known.join(large, list(keys)).select(*keys, "state", F.explode(F.expr(heads)).alias("prefix"))
        fitting = heads.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("_words")).where(F.col("_words") <= SHARD_WORDS)
        shortest = F.expr("min_by(prefix, length(prefix))").alias("prefix")
        cut = stage(heads.join(fitting, [*keys, "prefix"]).groupBy(*keys, "state").agg(shortest))
        found = whole.unionByName(cut.groupBy(*keys, "prefix").agg(F.count(F.lit(1)).alias("_words")))
    numbered = stage(found.withColumn("_shard", F.monotonically_increasing_id()))
    buckets = numbered.agg(F.expr(f"cast(1 + coalesce(sum(_words), 0) div {TASK_WORDS} as bigint)").alias("n")).first().n
    bucket = f"if(_words > {TASK_WORDS}, -1 - _shard, pmod(xxhash64(_shard), {buckets}L))"
    shards = numbered.select(*keys, "prefix", "_shard", F.expr(bucket).alias("_bucket"))
    held = known.join(shards.where("prefix = ''").drop("prefix"), list(keys))
    if large is not None:
        held = held.unionByName(cut.join(shards, [*keys, "prefix"]).select(*held.columns))
    return held.select("state", "_shard", "_bucket"), shards, large


def _search(routes: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pattern, mapped_to, distance of the routes that find a word within `upto` edits in their shard.

    The asked words of a bucket are dealt into parts of about ASKED_AT_ONCE; its shards go to each of them.
    """
    routes = stage(routes.select(*keys, "pattern", "upto", "_shard", "_bucket"))
    parts = stage(routes.groupBy("_bucket").agg(F.expr(f"cast(1 + count(1) div {ASKED_AT_ONCE} as int)").alias("_parts")))
    tasks = int(routes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number of tasks is given: by their bytes alone, many searches would be put into one task.
    asked = routes.join(parts, "_bucket").select(*keys, "pattern", "upto", "_shard", "_bucket", F.expr("cast(pmod(xxhash64(pattern), _parts) as int)").alias("_part"))
    words = held.join(parts, "_bucket").select("state", "_shard", "_bucket", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    schema = T.StructType([*[routes.schema[c] for c in keys], *T.StructType.fromDDL("pattern string, mapped_to string, distance int")])
    fields = to_arrow_schema(schema)

    def task(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return fields.empty_table()
        trie = Trie(b["state"].to_pylist(), b["_shard"].to_pylist())
        upto = a["upto"].fill_null(FAR).to_numpy()
        best, distance = trie.nearest(a["pattern"].to_pylist(), upto, a["_shard"].to_numpy())
        hit = np.flatnonzero(best >= 0)
        found = a.select([*keys, "pattern"]).take(pa.array(hit))
        words = pa.array([trie.words[i] for i in best[hit]], pa.string())
        return pa.Table.from_arrays([*found.columns, words, pa.array(distance[hit], pa.int32())], names=schema.names)

    on = ["_bucket", "_part"]
    return asked.repartition(tasks, *on).groupBy(*on).cogroup(words.repartition(tasks, *on).groupBy(*on)).applyInArrow(task, schema)


def _spread_distinct(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Distinct (keys, col) in as many partitions as a shuffle has; a small table would be merged into one."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*keys, col).repartition(tasks, *keys, col).distinct()


def nearest_states(patterns: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest state of each distinct pattern: least edit distance, then first by name.

    Words of any length and any letters. Columns: keys, pattern, mapped_to, distance; the
    last two are null without a model. What is found is written, so the result can be read
    more than once.
    """
    on = [*keys, "pattern"]
    pattern, known = _spread_distinct(patterns, keys, "pattern"), stage(_spread_distinct(states, keys, "state"))
    same = known.select(*keys, F.col("state").alias("pattern"), F.lit(True).alias("_known"))
    marked = stage(pattern.join(same, on, "left"))
    seen = marked.where("_known").select(*on, F.col("pattern").alias("mapped_to"), F.lit(0).alias("distance"))
    unseen = marked.where("_known is null").select(*on)
    if unseen.isEmpty():
        return seen
    held, shards, large = _shards(known, keys)
    home = unseen.join(shards.where("prefix = ''"), list(keys))
    if large is not None:
        lead = F.explode(F.expr("transform(sequence(1, greatest(length(pattern), 1)), n -> left(pattern, n))")).alias("prefix")
        leads = unseen.join(large, list(keys)).select(*on, lead)
        home = home.unionByName(leads.join(shards.where("prefix <> ''"), [*keys, "prefix"]))
    found = _search(home.withColumn("upto", F.lit(None).cast("int")), held, keys)
    if large is not None:
        found = stage(found)
        # The edits from a prefix to the nearest beginning of the word: no word of the shard is nearer.
        least = "array_min(transform(sequence(0, length(pattern)), n -> levenshtein(trim(trailing '\\0' from prefix), left(pattern, n))))"
        others = (
            unseen.join(found.select(*on, F.col("distance").alias("upto")), on, "left")
            .join(shards.where("prefix <> ''"), list(keys))
            .where(f"{least} <= coalesce(upto, {FAR}) and (upto is null or not startswith(pattern, prefix))")
        )
        more = _search(others, held, keys)
        found = found.unionByName(more).groupBy(*on).agg(F.expr("min(struct(distance, mapped_to))").alias("_b")).select(*on, "_b.mapped_to", "_b.distance")
    return seen.unionByName(stage(unseen.join(found, on, "left")))
