"""Removal of byte strings that repeat earlier documents, by a distributed merge of sorted suffixes.

A string of `LENGTH` bytes holds the least hashed `GRAM` bytes of its own at some
place, its anchor; equal strings have it at the same place. So only suffixes at
anchors are looked at, and of these only such whose gram is in a second document.

1. Anchors are met by hash. Each task sends a gram once for all of its documents.
2. Each task sorts the suffixes at shared anchors, together with what stands before
   them, into runs. A run is front-coded: each suffix is what it shares with the one
   before, and the rest. Suffixes are ordered by the hash of their gram first, so
   equal ranges of hashes are equal shares of the work.
3. The runs of a range are combined by a loser tree. A suffix comes with the length
   it shares with the last one that left the tree, so known prefixes are never
   compared again. In the merged order, strings of like grams stand together, and
   each string's first document decides which later ones lose it.

Of equal suffixes in one task only those of the least document are sent: the others
are decided on the spot. A passage of a third of all documents costs a task no more
than one of its own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm.common import free_shuffles
from motifline.plans.blocks import stage

LENGTH, GRAM = 50, 24
BEFORE = LENGTH - GRAM  # bytes before an anchor that a string may reach back
ANCHORS_A_FLUSH, SUFFIXES_A_RUN = 500_000, 100_000
# A key: hash, the string from the anchor on, the string before it backwards, and how long both are.
HASH = 6
KEY = HASH + LENGTH + BEFORE + 2
HASH_BITS = 8 * HASH

U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def _hashed(*words: np.ndarray) -> np.ndarray:
    """48-bit hashes of grams given as little-endian numbers of eight bytes."""
    h = words[0]
    for w in words[1:]:
        h = _mixed(h * U(0x9E3779B97F4A7C15) ^ w)
    return _mixed(h) >> U(64 - HASH_BITS)


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or greatest) of every `width` neighbours."""
    n = 1
    while 2 * n <= width:
        x = least(x[:-n], x[n:])
        n *= 2
    return least(x[: n - width], x[width - n :]) if n < width else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that are the least of some string of LENGTH bytes; ties count."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U)
    flat = np.frombuffer(data, dtype=np.uint8)
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(flat, (len(data) - 7, 8), (1, 1))).view("<u8").ravel()
    count = len(data) - GRAM + 1
    h = _hashed(*[words[i : i + count] for i in range(0, GRAM, 8)])
    least = _slide(h, BEFORE + 1, np.minimum)
    edge = np.zeros(BEFORE, dtype=U)
    at = np.flatnonzero(h <= _slide(np.concatenate([edge, least, edge]), BEFORE + 1, np.maximum))
    return at, h[at]


def _ranges(h: np.ndarray, ranges: int) -> np.ndarray:
    """Cuts of sorted hashes at the borders of equal ranges."""
    borders = np.array([-(-(i << HASH_BITS) // ranges) for i in range(ranges + 1)], dtype=U)
    return np.searchsorted(h, borders)


def _row(place: int, made: tuple) -> tuple[int, bytes]:
    data = pickle.dumps(made, protocol=5)
    return place, len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _made(blob: bytes) -> tuple:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time become Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["range", "blob"])


def _anchor_rows(ranges: int):
    def flush(ids: list[int], found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        doc = np.repeat(np.arange(len(ids)), [len(a) for a, _ in found])
        at, h = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((doc, h))
        doc, at, h = doc[order], at[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = np.concatenate([first[1:], [len(h)]])
        several = doc[first] != doc[last - 1]
        inside = np.repeat(several, last - first)
        names = np.array(ids, dtype=np.int64)
        # Shared within this task: known here, and sent on once without a place.
        rows = []
        own = np.flatnonzero(inside)
        for i, part in enumerate(np.array_split(own, min(ranges, 1 + len(own) // 20_000))):
            rows.append(_row(i % ranges, ("places", names[doc[part]], at[part].astype(np.int32))))
        sent = ~inside
        sent[first] = True
        doc, at, h, inside = doc[sent], at[sent], h[sent], inside[sent]
        cuts = _ranges(h, ranges)
        for r in range(ranges):
            s = slice(cuts[r], cuts[r + 1])
            if s.start < s.stop:
                docs, index = np.unique(doc[s], return_inverse=True)
                rows.append(
                    _row(
                        r,
                        (
                            "grams",
                            (h[s] & U(0xFFFFFFFF)).astype(np.uint32),
                            (h[s] >> U(32)).astype(np.uint16),
                            np.diff(names[docs], prepend=0),
                            index.astype(np.uint32 if len(docs) > 65_535 else np.uint16),
                            (at[s] & 0xFFFF).astype(np.uint16),
                            (at[s] >> 16).astype(np.uint16),
                            np.packbits(inside[s]),
                        ),
                    )
                )
        return _batch(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, size = [], [], 0
        for b in _slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = anchors(text.encode())
                if len(got[0]):
                    ids.append(doc_id)
                    found.append(got)
                    size += len(got[0])
                if size >= ANCHORS_A_FLUSH:
                    yield flush(ids, found)
                    ids, found, size = [], [], 0
        if size:
            yield flush(ids, found)

    return task


def _shared_places(group: pa.Table) -> pa.Table:
    """doc_id and place of the anchors of one range whose gram came from two tasks' documents, or was shared in one."""
    names, places, hashes, runs, ids, at, known = [], [], [], [], [], [], []
    for n, blob in enumerate(group["blob"].to_pylist()):
        kind, *made = _made(blob)
        if kind == "places":
            names.append(made[0])
            places.append(made[1])
            continue
        low, high, docs, index, near, far, inside = made
        hashes.append(low.astype(U) | (high.astype(U) << U(32)))
        runs.append(np.full(len(low), n, dtype=np.int32))
        ids.append(np.cumsum(docs)[index])
        at.append(near.astype(np.int32) | (far.astype(np.int32) << 16))
        known.append(np.unpackbits(inside, count=len(low)).astype(bool))
    if hashes:
        h, runs, ids, at, known = (np.concatenate(x) for x in (hashes, runs, ids, at, known))
        order = np.argsort(h, kind="stable")  # runs stay in order inside a hash
        h, runs, ids, at, known = h[order], runs[order], ids[order], at[order], known[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        last = np.concatenate([first[1:], [len(h)]])
        keep = np.repeat(runs[first] != runs[last - 1], last - first) & ~known
        names.append(ids[keep])
        places.append(at[keep])
    return pa.table({"doc_id": np.concatenate(names).astype(np.int64), "place": np.concatenate(places).astype(np.int32)})


def keys_at(data: bytes, at: np.ndarray) -> np.ndarray:
    """Key bytes of the suffixes at the places `at`, one line each."""
    padded = np.frombuffer(b"\0" * BEFORE + data + b"\0" * LENGTH, dtype=np.uint8)
    text = padded[at[:, None] + np.arange(BEFORE + LENGTH)[None, :]]
    out = np.empty((len(at), KEY), dtype=np.uint8)
    gram = np.ascontiguousarray(text[:, BEFORE : BEFORE + GRAM]).view("<u8")
    out[:, :HASH] = _hashed(*gram.T).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH :]
    out[:, HASH : HASH + LENGTH] = text[:, BEFORE:]
    out[:, HASH + LENGTH : KEY - 2] = text[:, BEFORE - 1 :: -1] if BEFORE else text[:, :0]
    out[:, KEY - 2] = np.minimum(LENGTH, len(data) - at)
    out[:, KEY - 1] = np.minimum(BEFORE, at)
    return out


def _hash_of(keys: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(keys), 8), dtype=np.uint8)
    wide[:, 8 - HASH :] = keys[:, :HASH]
    return wide.view(">u8").ravel().astype(U)


def front_coded(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Length that each sorted key shares with the one before, and the rests."""
    shared = np.zeros(len(keys), dtype=np.uint8)
    if len(keys) > 1:
        differ = keys[1:] != keys[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), KEY)
    return shared, keys[np.arange(KEY)[None, :] >= shared[:, None]].tobytes()


def sorted_run(keys: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray):
    """Different keys in order, (key number, doc, tag, place) of each key's least document, and
    (doc, tag, from, to) of what later documents with equal keys lose."""
    order = np.argsort(np.ascontiguousarray(keys).view(f"S{KEY}").ravel(), kind="stable")
    keys, doc, tag, at = keys[order], doc[order], tag[order], at[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
    number = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc, np.flatnonzero(new))
    later = doc > least[number]
    back, least_back = keys[later, KEY - 1].astype(np.int64), np.maximum(0, LENGTH - keys[later, KEY - 2].astype(np.int64))
    whole = least_back <= back
    lost = tuple(x[later][whole] for x in (doc, tag)) + ((at[later] - back)[whole], (at[later] - least_back + LENGTH)[whole])
    return keys[new], (number[~later], doc[~later], tag[~later], at[~later]), lost


def _suffix_rows(ranges: int):
    def flush(parts: list) -> pa.RecordBatch:
        keys, (number, doc, tag, at), lost = sorted_run(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        rows = []
        pieces = min(ranges, 1 + len(lost[0]) // 20_000)
        for i, part in enumerate(np.array_split(np.arange(len(lost[0])), pieces)):
            if len(part):
                rows.append(_row(i % ranges, ("lost", *(x[part] for x in lost))))
        cuts = _ranges(_hash_of(keys), ranges)
        for r in range(ranges):
            i, e = cuts[r], cuts[r + 1]
            if i < e:
                s = slice(*np.searchsorted(number, [i, e]))
                counts = np.bincount(number[s] - i, minlength=e - i).astype(np.uint32)
                rows.append(_row(r, ("run", *front_coded(keys[i:e]), counts, doc[s], tag[s], at[s].astype(np.int32))))
        return _batch(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in _slices(batches):
            for doc_id, tag, text, places in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = text.encode()
                at = np.unique(np.array(places, dtype=np.int64))
                at = at[at <= len(data) - GRAM]
                for i in range(0, len(at), SUFFIXES_A_RUN):
                    some = at[i : i + SUFFIXES_A_RUN]
                    parts.append((keys_at(data, some), np.full(len(some), doc_id, np.int64), np.full(len(some), tag, np.int32), some))
                    size += len(some)
                    if size >= SUFFIXES_A_RUN:
                        yield flush(parts)
                        parts, size = [], 0
        if size:
            yield flush(parts)

    return task


def merged(runs: list[tuple[np.ndarray, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, shared length with the key before, key) of all runs in order, by a loser tree.

    Each run waits with its next key and the length that this shares with the last
    key that left. Of two keys the one that shares more is less; only keys that share
    the same are compared, from there on. A loser keeps what it shares with its winner,
    which is what it shares with the last key when it is met again.
    """
    k = len(runs)
    place, cut = [0] * k, [0] * k
    key: list[bytes | None] = [None] * k
    shares = [0] * k
    lists = [s.tolist() for s, _ in runs]

    def advance(r: int) -> None:
        i = place[r]
        if i == len(lists[r]):
            key[r] = None
            return
        shared = lists[r][i]
        end = cut[r] + KEY - shared
        key[r] = key[r][:shared] + runs[r][1][cut[r] : end] if shared else runs[r][1][cut[r] : end]
        place[r], cut[r], shares[r] = i + 1, end, shared

    def wins(a: int, b: int) -> bool:
        x, y = key[a], key[b]
        if y is None:
            return True
        if x is None:
            return False
        if shares[a] != shares[b]:
            return shares[a] > shares[b]
        i = shares[a]
        if x == y:
            i = KEY
        else:
            while x[i] == y[i]:
                i += 1
        if i == KEY or x[i] < y[i]:
            shares[b] = i
            return True
        shares[a] = i
        return False

    for r in range(k):
        advance(r)
    leaves = 1
    while leaves < k:
        leaves *= 2
    losers = [-1] * leaves
    level = [r if r < k else -1 for r in range(leaves)]
    base = leaves
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            a, b = level[i], level[i + 1]
            if b >= 0 and (a < 0 or not wins(a, b)):
                a, b = b, a
            losers[base + i // 2] = b
            up.append(a)
        level = up
    top = level[0]
    while k and key[top] is not None:
        yield top, shares[top], key[top]
        advance(top)
        node = (leaves + top) // 2
        while node:
            other = losers[node]
            if other >= 0 and not wins(top, other):
                losers[node], top = top, other
            node //= 2


def first_documents(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For different keys with their least documents: the least document of the string that starts
    0, 1, ... BEFORE bytes before the anchor; the greatest number where no such string is."""
    text = np.concatenate([keys[:, KEY - 3 : HASH + LENGTH - 1 : -1], keys[:, HASH : HASH + LENGTH]], axis=1)
    base = pow(0x9E3779B97F4A7C15, 1, 1 << 64)
    powers = np.array([pow(base, i, 1 << 64) for i in range(text.shape[1])], dtype=U)
    inverse = np.array([pow(base, -i, 1 << 64) for i in range(BEFORE + 1)], dtype=U)
    sums = np.zeros((len(keys), text.shape[1] + 1), dtype=U)
    np.cumsum((text.astype(U) + U(1)) * powers[None, :], axis=1, out=sums[:, 1:], dtype=U)
    gram = _hash_of(keys) * U(0xA0761D6478BD642F)
    out = np.full((len(keys), BEFORE + 1), np.iinfo(np.int64).max)
    for back in range(BEFORE + 1):
        start = BEFORE - back
        rows = np.flatnonzero((keys[:, KEY - 1] >= back) & (keys[:, KEY - 2] >= LENGTH - back))
        if not len(rows):
            continue
        h = _mixed((sums[rows, start + LENGTH] - sums[rows, start]) * inverse[start] + gram[rows])
        order = np.argsort(h, kind="stable")
        rows, h = rows[order], h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        strings = text[rows, start : start + LENGTH]
        if (strings[1:] != strings[:-1])[~new[1:]].any():
            # Two strings of one hash: order by the strings themselves.
            order = np.argsort(np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel(), kind="stable")
            rows, strings = rows[order], strings[order]
            new = np.concatenate([[True], (strings[1:] != strings[:-1]).any(1)])
        least = np.minimum.reduceat(doc[rows], np.flatnonzero(new))
        out[rows, back] = least[np.cumsum(new) - 1]
    return out


def _lost_bytes(group: pa.Table) -> pa.Table:
    """(doc_id, tag, start, end) that documents lose by the runs of one range."""
    out, runs, held = [], [], []
    for blob in group["blob"].to_pylist():
        kind, *made = _made(blob)
        if kind == "lost":
            out.append(tuple(made))
        else:
            runs.append((made[0], made[1]))
            held.append(made[2:])
    if runs:
        order = [(r, s, x) for r, s, x in merged(runs)]
        new = np.array([s < KEY for _, s, _ in order])
        keys = np.frombuffer(b"".join(x for (_, s, x) in order if s < KEY), dtype=np.uint8).reshape(-1, KEY)
        # Entries of the runs in merged order: a run's keys leave the tree in its own order.
        number = np.cumsum(new) - 1
        came = np.array([r for r, _, _ in order])
        docs, tags, at, which = [], [], [], []
        for r, (counts, doc, tag, place) in enumerate(held):
            docs.append(doc)
            tags.append(tag)
            at.append(place.astype(np.int64))
            which.append(np.repeat(number[came == r], counts))
        doc, tag, at, which = (np.concatenate(x) for x in (docs, tags, at, which))
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, which, doc)
        lost = first_documents(keys, least)[which] < doc[:, None]
        edges = np.diff(np.pad(lost, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, low), (_, high) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        out.append((doc[row], tag[row], at[row] - (high - 1), at[row] - low + LENGTH))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
    return pa.table({n: c.astype(t) for n, c, t in zip(("doc_id", "tag", "start", "end"), columns, (np.int64, np.int32, np.int32, np.int32), strict=True)})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches):
        sizes, removed, spans, kept = [], [], [], []
        for text, lost in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            out, at, n = [], 0, 0
            for s, e in merged_spans(lost or []):
                out.append(data[at:s])
                at = e
                n += 1
            out.append(data[at:])
            data_kept = b"".join(out)
            sizes.append(len(data))
            removed.append(len(data) - len(data_kept))
            spans.append(n)
            kept.append(sha256(data_kept).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, spans)], pa.array(kept)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def merged_spans(spans: list) -> list[tuple[int, int]]:
    """Sorted spans without overlaps or touching ends, from rows with start and end."""
    out: list[tuple[int, int]] = []
    for x in sorted((x["start"], x["end"]) for x in spans):
        if out and x[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], x[1])
        else:
            out.append(x)
    return out


def repeated_spans(docs: DataFrame, ranges: int, text: str = "text") -> DataFrame:
    """(doc_id, tag, lost): spans of each text's bytes that lie in a string of LENGTH bytes which
    also starts in a document with a smaller id. `tag` tells texts of one doc_id apart."""
    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length(text) >= LENGTH)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("tag"), F.col(text).alias("_text")
    )
    sent = texts.select("doc_id", "_text").mapInArrow(_anchor_rows(ranges), "range int, blob binary")
    places = stage(sent.groupBy("range").applyInArrow(_shared_places, "doc_id long, place int"))
    del sent
    free_shuffles(docs.sparkSession)
    by_doc = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    runs = texts.join(by_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "tag", "_text", "places").mapInArrow(_suffix_rows(ranges), "range int, blob binary")
    lost = stage(runs.groupBy("range").applyInArrow(_lost_bytes, "doc_id long, tag int, start int, end int"))
    del runs
    free_shuffles(docs.sparkSession)
    return lost.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("lost"))


def without_repeats(docs: DataFrame, ranges: int, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that stay.

    A null text counts as an empty one. A null doc_id is neither smaller nor greater
    than others: such a row keeps all. Rows of one doc_id don't take from each other.
    """
    lost = repeated_spans(docs, ranges, text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(text).alias("tag"), F.col(text).alias("_text"))
    whole = rows.join(lost.hint("shuffle_hash"), ["doc_id", "tag"], "left").select("doc_id", "_text", "lost")
    return whole.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
