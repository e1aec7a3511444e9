"""Near-duplicate documents: weighted minwise signatures of bags of word shingles.

A bag holds each five-word shingle with its number of occurrences. The discretised
weight axis is cut into dyadic blocks [0,1), [1,2), [2,4), ... Each (shingle, block)
has a Poisson process of points whose rate is the width of the block; a point falls
on a place of the block and on one register. A bag sees the points below its weight,
so two bags see the same points on the part of the weights that they share, and each
register's first point agrees with the probability of the weighted Jaccard
similarity. Points are drawn by increasing time, and none later than the slowest
register's, so a process stops after few of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifline.llm.common import apart, slices
from motifline.plans.blocks import stage

WORDS, BANDS, ROWS = 5, 24, 5
#: Letters that a Python worker takes up at once, beyond one row. Its arrays hold some hundred bytes for each, and workers share an executor's memory.
CHUNK_BYTES = 1 << 18
#: Ratio of the sizes that a band of sizes holds.
SIZE_BAND = 1.1
# A fixed odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Shingler:
    """Hashes of all shingles of several texts at once, by prefix sums of a polynomial."""

    def __init__(self, size: int = CHUNK_BYTES):
        self._grow(size)

    def _grow(self, size: int) -> None:
        powers = np.full(size, BASE, dtype=U)
        inverse = np.full(size, INVERSE, dtype=U)
        powers[0] = inverse[0] = 1
        self.powers, self.inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)

    def bags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, weight), ordered by text and shingle. A text of fewer words than a shingle
        is one shingle, one without words has none. Words are what white space parts."""
        lines = [" ".join(t.split()) for t in texts]
        held = np.array([i for i, t in enumerate(lines) if t], dtype=np.int64)
        data = np.frombuffer("\n".join(t for t in lines if t).encode(), dtype=np.uint8)
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, U), np.empty(0, np.int64)
        if len(data) > len(self.powers):
            self._grow(len(data))
        sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * self.powers[: len(data)], dtype=U)])
        cuts = np.flatnonzero((data == 32) | (data == 10))
        starts, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(data)]])
        words = mixed((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(U))
        breaks = np.concatenate([[0], np.flatnonzero(data[cuts] == 10) + 1, [len(words)]])
        counts = np.diff(breaks)
        doc = np.repeat(np.arange(len(held)), counts)
        n = len(words)
        total = words * U(0xD6E8FEB86659FD93)
        for j in range(1, WORDS):
            factor = U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
            total[: n - j] += np.where(doc[j:] == doc[: n - j], words[j:] * factor, U(0)) if n > j else U(0)
        # A place starts a shingle if the whole shingle is in its text, or if it starts a shorter text.
        place = np.arange(n) - breaks[doc]
        whole = place <= np.maximum(counts[doc] - WORDS, 0)
        doc, total = doc[whole], mixed(total[whole])
        order = np.lexsort((total, doc))
        doc, total = doc[order], total[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])])
        first = np.flatnonzero(new)
        return held[doc[first]], total[first], np.diff(np.concatenate([first, [len(doc)]]))


def signatures(n: int, doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """First times of all registers for `n` bags, infinite for empty ones."""
    out = np.full((n, registers), np.inf)
    slowest = np.full(n, np.inf)
    # Processes: one per shingle and block of the weight axis that its weight reaches into.
    parts = [(doc, shingle, np.ones(len(doc)), np.ones(len(doc)))]
    low, level = 1, 0
    reach = np.flatnonzero(weight > low)
    while len(reach):
        level += 1
        seed = shingle[reach] + U((level * 0xA0761D6478BD642F) & (2**64 - 1))
        parts.append((doc[reach], seed, np.minimum(weight[reach] - low, low).astype(float), np.full(len(reach), float(low))))
        low *= 2
        reach = reach[weight[reach] > low]
    owner, seed, seen, rate = (np.concatenate(c) for c in zip(*parts, strict=True))
    seed = mixed(seed)
    time = np.zeros(len(owner))
    step = 0
    while len(owner):
        step += 1
        draw = mixed(seed + U((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        time = time - np.log(((draw >> U(11)).astype(float) + 1) * 2.0**-53) / rate
        keep = time < slowest[owner]
        if not keep.all():
            owner, seed, seen, rate, time, draw = (c[keep] for c in (owner, seed, seen, rate, time, draw))
        if not len(owner):
            break
        again = mixed(draw ^ U(0x2545F4914F6CDD1D))
        register = ((again >> U(40)) * U(registers)) >> U(24)
        below = ((again & U(0xFFFFFFFF)).astype(float) * 2.0**-32) * rate < seen
        hit = np.flatnonzero(below)
        np.minimum.at(out.reshape(-1), owner[hit] * registers + register[hit].astype(np.int64), time[hit])
        touched = np.unique(owner[hit]) if step > 8 else slice(None)
        slowest[touched] = out[touched].max(axis=1)
    return out


def band_keys(times: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of registers."""
    bits = np.ascontiguousarray(times[:, : bands * rows]).view(U).reshape(len(times), bands, rows)
    key = np.zeros(bits.shape[:2], dtype=U)
    for r in range(rows):
        key = mixed(key * U(31) + bits[:, :, r])
    return key.view(np.int64)


def overlap(a: bytes, b: bytes) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """Of two packed bags: weight of the first, common weight, weighted Jaccard similarity, the shingles that weigh more in the first, and by how much."""
    x, y = (np.frombuffer(v, dtype="<u8").reshape(2, -1) for v in (a, b))
    _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = np.minimum(x[1][i], y[1][j])
    over = x[1].copy()
    over[i] -= both
    common, size = int(both.sum()), int(x[1].sum())
    whole = size + int(y[1].sum()) - common
    return size, common, common / whole if whole else 0.0, x[0][over > 0], over[over > 0]


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches whose texts together have at most about a chunk of letters, at least one row each."""
    for b in slices(batches):
        texts = [t or "" for t in b.column(column).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > CHUNK_BYTES:
                yield b.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield b.slice(start), texts[start:]


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for b, texts in _chunks(batches, 1):
        doc, shingle, weight = shingler.bags(texts)
        size = np.bincount(doc, weight, minlength=len(texts)).astype(np.int64)
        keys = band_keys(signatures(len(texts), doc, shingle, weight, BANDS * ROWS))
        # A text without words has no keys.
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]), pa.int32()), pa.array(keys[size > 0].reshape(-1)))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["digest", "keys"])


def _bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for b, texts in _chunks(batches, 1):
        doc, shingle, weight = shingler.bags(texts)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        packed = [np.stack([shingle[i:e], weight[i:e].astype(U)]).tobytes() for i, e in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["digest", "bag"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): the least node of its connected component.

    Labels are halved by pointer jumping, so the number of rounds grows with the
    logarithm of a component's diameter. Every round is written to the shared folder.
    """
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_m"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("_old"), F.least("label", "_m").alias("_m"))
        jump = labels.select(F.col("node").alias("_m"), F.col("label").alias("_j"))
        after = stage(least.join(jump, "_m").select("node", F.least("_m", "_j").alias("label"), "_old"))
        changed = not after.where("label <> _old").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels


def compared(pairs: DataFrame, bags: DataFrame, excess: bool) -> DataFrame:
    """The pairs (a, b) of digests with the weight of a, common weight, similarity, and, if `excess` says so,
    the shingles that weigh more in a than in b, and by how much."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, common, like, over, extra = [], [], [], [], []
            for x, y in zip(*[batch.column(i).to_pylist() for i in (2, 3)], strict=True):
                z, c, s, o, e = overlap(x, y)
                sizes.append(z)
                common.append(c)
                like.append(s)
                over.append(o.view(np.int64) if excess else None)
                extra.append(e.astype(np.int64) if excess else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(common, pa.int64()), pa.array(like, pa.float64()), *[pa.array(x, pa.list_(pa.int64())) for x in (over, extra)]],
                names=["a", "b", "size", "common", "like", "over", "extra"],
            )

    one = pairs.join(bags.select(F.col("digest").alias("a"), F.col("bag").alias("_a")), "a")
    two = one.join(bags.select(F.col("digest").alias("b"), F.col("bag").alias("_b")), "b")
    return two.select("a", "b", "_a", "_b").mapInArrow(task, "a binary, b binary, size long, common long, like double, over array<long>, extra array<long>")


def common_share(least: float) -> float:
    """Part of both sizes that a near pair has in common, a little less so that rounding leaves no exact pair out."""
    return least / (1 + least) * (1 - 1e-9)


def digest_of(text: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def size_band(size: F.Column) -> F.Column:
    return F.floor(F.log(size) / math.log(SIZE_BAND))


def shared_beyond(beyond: DataFrame, least: float) -> DataFrame:
    """Pairs (digest, _d) around one pivot b and one shingle that both have beyond it, which a near pair may share first.

    `beyond` has a row for each such shingle of a member, and as `rest` what the member
    has beyond b of this shingle and all more frequent ones. Of a pair, digest is the
    smaller. A near pair needs so much common weight beyond b, by the sizes and what both
    share with b, that the first shingle it shares leaves that much in either member. So
    the smaller is met by what it needs with a member of its own size, and the larger, for
    each band of sizes below its own, by what it needs with the least size of the band.
    """
    share = common_share(least)
    small = beyond.where(F.col("rest") >= 2 * share * F.col("size") - F.col("common")).withColumn("band", size_band(F.col("size")))
    large, smallest = None, least * (1 - 1e-9)
    lowest = size_band(F.col("_size") * smallest)
    renamed = beyond.select("b", "over", *[F.col(c).alias("_d" if c == "digest" else f"_{c}") for c in beyond.columns if c not in ("b", "over")])
    for below in range(int(-math.log(smallest) / math.log(SIZE_BAND)) + 2):
        banded = renamed.withColumn("band", size_band(F.col("_size")) - below)
        from_size = F.greatest(F.col("_size") * smallest, F.pow(F.lit(SIZE_BAND), "band") * (1 - 1e-9))
        banded = banded.where((F.col("band") >= lowest) & (F.col("_rest") >= share * (F.col("_size") + from_size) - F.col("_common")))
        large = banded if large is None else large.union(banded)
    ordered = (F.col("size") < F.col("_size")) | ((F.col("size") == F.col("_size")) & (F.col("digest") < F.col("_d")))
    needed = share * (F.col("size") + F.col("_size")) - F.least("common", "_common")
    meet = ordered & (F.col("label") != F.col("_label")) & (F.col("size") >= F.col("_size") * smallest) & (F.least("rest", "_rest") >= needed)
    return small.join(large, ["b", "over", "band"]).where(meet).withColumn("needed", needed)


def unmet(stars: DataFrame, least: float) -> DataFrame:
    """Pairs (digest, _d) of different classes around one pivot that may still be near.

    `stars` has a row for each member of a pivot b: digest, label, top (the label of b),
    size, common (weight in common with b), over and extra (the shingles that it has
    beyond b, and how much of each). A near pair has |u & v| >= least * |u|, the same of
    v, and |u & v| >= least / (1 + least) * (|u| + |v|). What u and v share is at most
    min(|u & b|, |v & b|) and what both have beyond b of the same shingles. So a pair
    either shares such shingles of enough weight or is near enough by its sizes alone.
    """
    share = common_share(least)
    close = F.least("size", "_size") >= F.greatest("size", "_size") * least
    # Each pair once: members of the pivot's class meet those outside, and these each other.
    apart_ = close & (F.col("label") != F.col("_label")) & ((F.col("label") == F.col("top")) | (F.col("digest") < F.col("_d")))
    mixed = stars.where("label <> top").select("b").distinct()
    rows = stage(stars.join(mixed, "b", "left_semi"))
    every = rows.select("b", "digest", "size", "common", "label", F.explode(F.arrays_zip("over", "extra")).alias("x"))
    every = every.select("*", "x.over", "x.extra").drop("x")
    # Frequency orders the shingles of all members alike. Of u's shingles from the first that it
    # shares with v on, both must have what they need beyond b, least * |u| - |u & b| at the least.
    often = every.groupBy("b", "over").agg(F.count("*").alias("often"))
    rest = Window.partitionBy("b", "digest").orderBy("often", "over").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # A shingle that one member alone has meets nothing, but counts in the weights above.
    ranked = every.join(often, ["b", "over"]).withColumn("rest", F.sum("extra").over(rest))
    beyond = stage(ranked.where((F.col("rest") >= least * (1 - 1e-9) * F.col("size") - F.col("common")) & (F.col("often") > 1)).drop("often"))
    # Behind the last of these shingles both can share no more than either has left.
    after = F.least(F.col("rest") - F.col("extra"), F.col("_rest") - F.col("_extra"))
    met = (
        shared_beyond(beyond, least)
        .groupBy("b", "digest", "_d")
        .agg((F.sum(F.least("extra", "_extra")) + F.min(after)).alias("most"), F.max("needed").alias("needed"))
        .where("most >= needed")
        .select("digest", "_d")
    )
    low = rows.groupBy("b").agg(F.min("size").alias("_low"))
    loose = (
        rows.where("label <> top").join(low, "b").where(F.col("common") >= share * (F.col("size") + F.col("_low")))
        .select("b", F.col("digest").alias("_d"), F.col("size").alias("_size"), F.col("label").alias("_label"), F.col("common").alias("_common"))
    )
    bound = F.least("common", "_common") >= share * (F.col("size") + F.col("_size"))
    # A member outside is loose itself if it can be near another of these.
    sized = rows.join(loose, "b").where(apart_ & bound).select("digest", "_d")
    return met.union(sized)


def classes(docs: DataFrame, least: float = 0.8, text: str = "text") -> DataFrame:
    """(digest, label): classes of the texts that are near another text, by links of at least `least`.

    Candidates share a band of registers. In each band a member is compared with the
    band's pivot, its best connected text, which gives most links. Pairs of different
    classes in a band are then looked at, as far as their facts about the pivot leave
    open whether they are near. No link that could join two classes is lost, and
    members of one class are not compared.
    """
    texts = docs.select(digest_of(text).alias("digest"), F.col(text).alias("_text"))
    made = stage(texts.mapInArrow(_keys_of, "digest binary, keys array<long>"))
    # Registers of different bands hardly ever give one key; if they do, texts are compared in vain.
    rows = made.dropDuplicates(["digest"]).select("digest", F.explode("keys").alias("key"))
    shared = stage(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    # Only members of shared bands go on.
    members = stage(rows.join(shared, "key"))
    weight = members.groupBy("digest").agg(F.sum("n").alias("degree"))
    ranked = members.join(weight, "digest")
    best = ranked.groupBy("key").agg(F.max(F.struct("degree", "digest")).alias("p")).select("key", F.col("p.digest").alias("pivot"))
    bags = stage(
        texts.join(weight.select("digest").hint("shuffle_hash"), "digest").select("digest", "_text").mapInArrow(_bags_of, "digest binary, bag binary").dropDuplicates(["digest"])
    )
    star = members.join(best, "key").where("digest <> pivot").select(F.col("digest").alias("a"), F.col("pivot").alias("b")).distinct()
    facts = stage(compared(star, bags, excess=True))
    links = stage(facts.where(F.col("like") >= least).select("a", "b"))
    first = components(links)

    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        found = first.select(F.col("node").alias(column), F.col("label").alias("_found"))
        return df.join(found, column, "left").withColumn(name, F.coalesce("_found", column)).drop("_found")

    stars = labelled(labelled(facts, "a", "label"), "b", "top").select("b", F.col("a").alias("digest"), "size", "common", "label", "top", "over", "extra")
    pairs = unmet(stars, least).select(F.least("digest", "_d").alias("a"), F.greatest("digest", "_d").alias("b")).distinct()
    more = stage(compared(pairs, bags, excess=False).where(F.col("like") >= least).select("a", "b"))
    if more.isEmpty():
        return first.withColumnRenamed("node", "digest")
    return components(links.union(more)).withColumnRenamed("node", "digest")


def near_duplicates(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and class_id, the least doc_id of its class.

    Equal texts are one class, also empty ones; null counts as empty. Texts without
    words are near no other text, texts of under five words only near texts of the
    same words. A class without any doc_id has none. Other columns don't matter.
    """
    found = classes(docs, least, text)
    light = docs.select(F.col(key).alias("doc_id"), digest_of(text).alias("digest"))
    named = light.join(found, "digest", "left").select("doc_id", F.coalesce("label", "digest").alias("label"))
    firsts = stage(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")))
    return named.join(firsts, "label").select("doc_id", "class_id", "class_size")


def keep_first(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of `docs` with one document of each class: that with the least doc_id, of repeated rows one.

    Null ids come last, null texts count as empty ones, and of rows with one id the text
    with the smaller digest stays. Other columns pass, whatever their names.
    """
    return apart(docs, ("doc_id", "text"), lambda rows: _first_rows(rows, least))


def _first_rows(docs: DataFrame, least: float) -> DataFrame:
    found = classes(docs, least)
    light = docs.select("doc_id", digest_of("text").alias("_digest"))
    named = light.join(found.withColumnRenamed("digest", "_digest"), "_digest", "left").select("doc_id", "_digest", F.coalesce("label", "_digest").alias("_label"))
    # Nulls are last; of equal ids the smaller digest stays.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_digest"))
    kept = stage(named.groupBy("_label").agg(first.alias("f")).selectExpr("f.doc_id as _kept", "f._digest as _digest"))
    again = light.groupBy("doc_id", "_digest").agg(F.count("*").alias("_rows"))
    kept = kept.join(again, kept["_kept"].eqNullSafe(again["doc_id"]) & (kept["_digest"] == again["_digest"])).select(kept["_kept"], kept["_digest"], "_rows")
    whole = docs.withColumn("_own", digest_of("text"))
    stay = whole.join(kept.hint("shuffle_hash"), whole["doc_id"].eqNullSafe(kept["_kept"]) & (whole["_own"] == kept["_digest"])).select(*docs.columns, "_own", "_rows")
    once, repeated = stay.where("_rows = 1").select(docs.columns), stay.where("_rows > 1").dropDuplicates(["_own"]).select(docs.columns)
    return once.union(repeated)
