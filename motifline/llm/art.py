"""Conversation prefix trie from adaptive radix trees over turn ids.

A turn's id is the big-endian head of a digest of its role and text, ID_BYTES wide; a
conversation's key is its ids in a row. Keys are cut into pages of PAGE_TURNS turns, so
that no row holds a whole long conversation; a page knows the node it starts from
(`chain`). Pages are sorted by (chain, key, conversation) over the tasks, and each task
builds radix trees of a bounded number of pages: inner nodes branch by one byte, grow
from 4 to 16, 48 and 256 places, and carry the bytes that all below them share. Only
depths of whole turns give nodes of the trie. What a tree knows of a node is a partial
sum; partial sums of one prefix meet by the prefix' digest. So neither a common first
turn nor copies of one conversation come together in one task.

Sums over subtrees need no walk: a node belongs to its smallest member, and what a
conversation owns is the lower part of its path. A subtree holds all that its members
own, less what its own owner has above it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.llm.common import tasks_of
from motifline.plans.blocks import attach, int_div, running_totals, stage, with_position

ID_BYTES = 16
PAGE_TURNS = 128
#: Pages and bytes of keys in one tree, and rows in one batch of its nodes.
TREE_PAGES, TREE_BYTES, BATCH_NODES = 4096, 4 << 20, 4096
#: A conversation takes fewer than SHARED_TURNS turns from the first one of its FAMILY.
SHARED_TURNS, FAMILY = 9, 5
ROOT = bytes(ID_BYTES)


class Leaf:
    """What is known of one key."""

    __slots__ = ("key", "sums", "total")

    def __init__(self, key: bytes, sums: list):
        self.key, self.sums, self.total = key, sums, sums


class Inner:
    """Node of a radix tree: shared bytes, sums of the key that ends here, children by their next byte.

    Up to 4 or 16 children stand beside a sorted array of bytes, up to 48 in an array
    that a table of all bytes points into, and beyond in one place for each byte.
    """

    __slots__ = ("path", "sums", "total", "layout", "bytes", "children")

    def __init__(self, path: bytes):
        self.path, self.sums, self.total, self.layout = path, None, None, 4
        self.bytes, self.children = bytearray(), []

    def get(self, byte: int):
        if self.layout <= 16:
            i = bisect_left(self.bytes, byte)
            return self.children[i] if i < len(self.bytes) and self.bytes[i] == byte else None
        if self.layout == 48:
            place = self.bytes[byte]
            return self.children[place - 1] if place else None
        return self.children[byte]

    def put(self, byte: int, child: Leaf | Inner) -> None:
        """Set the child of a byte; a node without a free place grows first."""
        if self.layout <= 16:
            i = bisect_left(self.bytes, byte)
            if i < len(self.bytes) and self.bytes[i] == byte:
                self.children[i] = child
            elif len(self.children) < self.layout:
                self.bytes.insert(i, byte)
                self.children.insert(i, child)
            else:
                self._grow()
                self.put(byte, child)
        elif self.layout == 48:
            if place := self.bytes[byte]:
                self.children[place - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.bytes[byte] = len(self.children)
            else:
                self._grow()
                self.put(byte, child)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            table = bytearray(256)
            for place, byte in enumerate(self.bytes, 1):
                table[byte] = place
            self.layout, self.bytes = 48, table
        else:
            self.layout, self.children = 256, [self.children[p - 1] if p else None for p in self.bytes]
            self.bytes = bytearray()

    def items(self) -> list[tuple[int, Leaf | Inner]]:
        """(byte, child), by byte."""
        if self.layout <= 16:
            return list(zip(self.bytes, self.children, strict=True))
        if self.layout == 48:
            return [(b, self.children[p - 1]) for b, p in enumerate(self.bytes) if p]
        return [(b, c) for b, c in enumerate(self.children) if c is not None]


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common head."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Tree:
    """Adaptive radix tree over keys of whole turns; `add` brings sums together."""

    def __init__(self, add: Callable[[list, list], list]):
        self.root: Leaf | Inner | None = None
        self.add = add

    def insert(self, key: bytes, sums: list) -> None:
        parent, byte, at, node = None, 0, 0, self.root
        while node is not None:
            leaf = isinstance(node, Leaf)
            path = node.key[at:] if leaf else node.path
            n = _shared(path, key[at : at + len(path)])
            at += n
            if n == len(path) and at == len(key):
                node.sums = self.add(node.sums, sums) if node.sums else sums
                return
            if n < len(path) or leaf:
                # The keys part here: a new node takes the bytes they share.
                split = Inner(path[:n])
                if n == len(path):
                    split.sums = node.sums
                else:
                    if not leaf:
                        node.path = path[n + 1 :]
                    split.put(path[n], node)
                if at == len(key):
                    split.sums = sums
                else:
                    split.put(key[at], Leaf(key, sums))
                self._hang(parent, byte, split)
                return
            parent, byte, node, at = node, key[at], node.get(key[at]), at + 1
        self._hang(parent, byte, Leaf(key, sums))

    def _hang(self, parent: Inner | None, byte: int, node: Leaf | Inner) -> None:
        if parent is None:
            self.root = node
        else:
            parent.put(byte, node)

    def add_up(self) -> None:
        """Totals of all that hangs below each node, children first."""
        stack = [(self.root, False)] if self.root else []
        while stack:
            node, below_done = stack.pop()
            if isinstance(node, Leaf):
                node.total = node.sums
            elif not below_done:
                stack.append((node, True))
                stack.extend((c, False) for _, c in node.items())
            else:
                node.total = node.sums
                for _, c in node.items():
                    node.total = self.add(node.total, c.total) if node.total else c.total

    def turns(self, chain: bytes) -> Iterator[tuple[bytes, bytes | None, int, list, list | None]]:
        """(prefix, prefix one turn shorter, turns, totals, sums of the keys that end here) at depths of whole turns.

        A node whose shared bytes hold several turns gives several rows, a node inside a turn gives none.
        """
        self.add_up()
        # Of each node: the bytes above it, its own first one included, and the prefix of the last whole turn there.
        stack = [(self.root, b"", chain)] if self.root else []
        while stack:
            node, above, prefix = stack.pop()
            whole = node.key if isinstance(node, Leaf) else above + node.path
            if not above:
                yield chain, None, 0, node.total, None if whole else node.sums
            for t in range((len(above) - 1) // ID_BYTES + 1 if above else 1, len(whole) // ID_BYTES + 1):
                shorter, prefix = prefix, longer(chain, prefix, whole, t)
                yield prefix, shorter, t, node.total, node.sums if t * ID_BYTES == len(whole) else None
            if isinstance(node, Inner):
                stack.extend((c, whole + bytes([b]), prefix) for b, c in node.items())


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:ID_BYTES]


def longer(chain: bytes, prefix: bytes, key: bytes, turns: int) -> bytes:
    """Digest of the first `turns` turns of a page, from that of one turn less. A whole page's is made from its own digest."""
    if turns == PAGE_TURNS:
        return _digest(chain + _digest(key[: turns * ID_BYTES]))
    return _digest(prefix + key[(turns - 1) * ID_BYTES : turns * ID_BYTES])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, n, id, size (bytes of the text) of every turn. Turns of one number are ordered by id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length stands first, so that no two pairs of role and text read alike.
    pair = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.unhex(F.substring(F.sha2(pair, 256), 1, 2 * ID_BYTES)).alias("id"), F.octet_length(text).cast("long").alias("size"),
    )
    return with_position(rows, ["conv_id"], [F.asc_nulls_first("turn"), "id"], keep=["id", "size"])


def rebuilt_pages(turns: DataFrame) -> DataFrame:
    """conv_id, page, last (is it the conversation's last page), key and sizes of its turns.

    A conversation without a turn has one empty page.
    """
    h = f"cast(crc32(cast(cast(conv_id as string) as binary)) % {SHARED_TURNS} as int)"
    early = F.when(F.col("pos") < SHARED_TURNS - 1, F.struct("pos", "id", "size"))
    heads = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(early)).alias("head"), F.max("n").alias("n"))
    families = heads.select(F.col("conv_id").alias("family"), F.col("head").alias("shared"))
    made = stage(
        heads.selectExpr("conv_id", "n", f"{h} as h", f"conv_id - conv_id % {FAMILY} as family", "slice(head, 1, 0) as nothing")
        .join(families, "family", "left")
        .selectExpr("conv_id", "n", "h", "coalesce(slice(shared, 1, h), nothing) as shared")
    )
    sizes = made.selectExpr("conv_id", "h", "size(shared) as before", f"greatest(size(shared) + greatest(n - h, 0) - 1, 0) div {PAGE_TURNS} as last")
    # The one row of a conversation without a turn has no id and stands on page 0, like that of any other.
    first = made.selectExpr("conv_id", "explode(shared) as s").selectExpr("conv_id", "s.pos as at", "s.id as id", "s.size as size")
    empty = made.selectExpr("conv_id", "0L as at", "cast(null as binary) as id", "cast(null as bigint) as size")
    rows = first.unionByName(empty).join(sizes.select("conv_id", "last"), "conv_id")
    own = attach(turns.drop("n"), sizes, ["conv_id"], int_div("pos", 1 << 16)).where("pos >= h").selectExpr(
        "conv_id", "before + pos - h as at", "id", "size", "last"
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id", "size"))))
    pages = rows.unionByName(own).groupBy("conv_id", int_div("at", PAGE_TURNS).alias("page")).agg(listed.alias("t"), F.max("last").alias("last"))
    return pages.selectExpr(
        "conv_id", "page", "page = last as last", "unhex(array_join(transform(t, x -> hex(x.id)), '')) as key", "transform(t, x -> x.size) as sizes"
    )


def with_chains(pages: DataFrame) -> DataFrame:
    """Add `chain`, the prefix a page starts from. One digest a page is all that is gathered of a conversation."""
    whole = pages.where("not last").selectExpr("conv_id", "page", f"substring(unhex(sha2(key, 256)), 1, {ID_BYTES}) as digest")
    listed = whole.groupBy("conv_id").agg(F.expr("transform(array_sort(collect_list(struct(page, digest))), x -> x.digest)").alias("digests"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for conv, digests in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                chains, prefix = [], ROOT
                for d in digests:
                    prefix = _digest(prefix + d.as_py())
                    chains.append(prefix)
                columns = [pa.array([conv] * len(chains)), pa.array(range(1, len(chains) + 1)), pa.array(chains, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "page", "chain"])

    chains = listed.mapInArrow(task, "conv_id long, page long, chain binary")
    return pages.where("page = 0").withColumn("chain", F.lit(ROOT)).unionByName(pages.where("page > 0").join(chains, ["conv_id", "page"]))


def _in_trees(pages: DataFrame, make: Callable, add: Callable, rows_of: Callable, fields: str) -> DataFrame:
    """Rows of the trees that tasks build from sorted pages; `make` turns a row into the sums of its key."""
    order = ["chain", "key", "conv_id"]
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in fields.split(", ")]

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tree, chain, page, held, size = Tree(add), None, 0, 0, 0
        for b in batches:
            for i in range(b.num_rows):
                row = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                if row["chain"] != chain or held == TREE_PAGES or size > TREE_BYTES:
                    yield from rows_of(tree, chain, page)
                    tree, chain, page, held, size = Tree(add), row["chain"], row["page"], 0, 0
                tree.insert(row["key"], make(row))
                held, size = held + 1, size + len(row["key"])
        yield from rows_of(tree, chain, page)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in nodes(batches):
            held.append(row)
            if len(held) == BATCH_NODES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names=names)

    return pages.repartitionByRange(tasks_of(pages.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(task, fields)


def _members(pages: DataFrame) -> DataFrame:
    """Partial nodes: prefix, parent, depth, least member, number of members, bytes of the last text; and who ends there."""

    def make(row: dict) -> list:
        return [1, row["conv_id"], row["sizes"], [row["conv_id"]] if row["last"] else []]

    def add(a: list, b: list) -> list:
        return [a[0] + b[0], min(a[1], b[1]), a[2] if len(a[2]) > len(b[2]) else b[2], a[3]]

    def add_ends(a: list, b: list) -> list:
        # Sums of one key: the lists of those that end there are joined; nodes above don't carry them.
        out = add(a, b)
        out[3] = a[3] + b[3]
        return out

    def rows_of(tree: Tree, chain: bytes, page: int) -> Iterator[tuple]:
        tree.add = add
        for prefix, shorter, t, total, own in tree.turns(chain or ROOT):
            ends = own[3] if own else []
            listed = ",".join(map(str, ends)) if ends else None
            if t or page == 0:
                size = total[2][t - 1] if t else 0
                yield prefix, shorter, page * PAGE_TURNS + t, total[1], total[0], size, min(ends, default=None), listed

    fields = "prefix binary, shorter binary, depth long, least long, n long, size long, first_end long, ends string"
    return _in_trees(pages.select("chain", "key", "conv_id", "page", "sizes", "last"), make, add_ends, rows_of, fields)


def _owned_below(pages: DataFrame) -> DataFrame:
    """Partial sums of what the members of each prefix own: prefix, leaves, saved."""

    def add(a: list, b: list) -> list:
        return [a[0] + b[0], a[1] + b[1]]

    def rows_of(tree: Tree, chain: bytes, page: int) -> Iterator[tuple]:
        for prefix, _, t, total, _ in tree.turns(chain or ROOT):
            if t or page == 0:
                yield prefix, total[0], total[1]

    columns = ["chain", "key", "conv_id", "page", "all_leaves", "all_saved"]
    return _in_trees(pages.select(*columns), lambda row: [row["all_leaves"], row["all_saved"]], add, rows_of, "prefix binary, leaves long, saved long")


def _end_digests(parts: DataFrame) -> DataFrame:
    """prefix, ends_sha256: the lists of a prefix, in ascending order, run through one digest without being held."""
    lists = parts.where("ends is not null").select("prefix", "first_end", "ends")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix, digest = None, None
        for b in batches:
            done = []
            for p, ends in zip(b.column(0), b.column(1), strict=True):
                if (p := p.as_py()) == prefix:
                    digest.update(b",")
                else:
                    if digest:
                        done.append((prefix, digest.hexdigest()))
                    prefix, digest = p, hashlib.sha256()
                digest.update(ends.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["prefix", "ends_sha256"])
        if digest:
            yield pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([digest.hexdigest()])], names=["prefix", "ends_sha256"])

    dealt = lists.repartition(tasks_of(parts.sparkSession), "prefix").sortWithinPartitions("prefix", "first_end").select("prefix", "ends")
    return dealt.mapInArrow(task, "prefix binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct head of the rebuilt conversations.

    prefix (digest of the head), conv_id (smallest member), depth, parent_conv_id (null at
    the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first; turns of one number, repeated rows among them,
    all count and are ordered by the digest of role and text. Null roles and texts are
    empty ones. Rows without a conv_id take no part. No conversation: no row, not even the
    root. A conversation without a turn after rebuilding is a member of the root. Texts
    are digested where they are read and never moved; other columns don't matter.
    """
    pages = stage(with_chains(stage(rebuilt_pages(numbered_turns(conversations)))))
    parts = stage(_members(pages))
    nodes = parts.groupBy("prefix").agg(
        F.min("shorter").alias("shorter"), F.min("depth").alias("depth"), F.min("least").alias("least"), F.sum("n").alias("n"), F.max("size").alias("size")
    )
    kids = nodes.where("shorter is not null").groupBy("shorter").agg(F.count(F.lit(1)).alias("kids")).withColumnRenamed("shorter", "prefix")
    valued = nodes.join(kids, "prefix", "left").withColumns(
        {"kids": F.coalesce("kids", F.lit(0).cast("long")), "leaf": F.expr("if(kids is null, 1L, 0L)"), "saving": F.expr("(n - 1) * size")}
    )
    # What an owner has from its first own node down to each one.
    owned = stage(running_totals(valued, ["least"], ["depth"], {"leaves_to": "leaf", "saved_to": "saving"}))
    owners = owned.groupBy("least").agg(F.sum("leaf").alias("all_leaves"), F.sum("saving").alias("all_saved")).withColumnRenamed("least", "conv_id")
    weighed = attach(pages.drop("sizes", "last"), owners, ["conv_id"], F.col("page"))
    below = _owned_below(weighed).groupBy("prefix").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    above = owned.select(F.col("prefix").alias("shorter"), F.col("least").alias("parent_conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        owned.join(below, "prefix").join(above, "shorter", "left").join(_end_digests(parts), "prefix", "left")
        .select(
            "prefix", F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
            F.expr("leaves - leaves_to + leaf").alias("n_leaves"), F.expr("saved - saved_to + saving").alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )


#: crc32 of the digits of a number, bit by bit: a step for each digit and eight for its bits.
_CRC = (
    "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast({} as varchar), ''), lambda c: list_concat([cast(ord(c) as bigint)], [-1, -1, -1, -1, -1, -1, -1, -1])))), "
    "lambda a, e: case when e >= 0 then xor(a, e) when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295)"
)

ORACLE = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos
  from conversations where conv_id is not null),
convs as (select conv_id, conv_id - conv_id % 5 as family, {_CRC.format('conv_id')} % 9 as h from (select distinct conv_id from turns)),
shared as (select c.conv_id, t.pos, t.role, t.text from convs c join turns t on t.conv_id = c.family and t.pos < c.h),
counted as (select c.conv_id, c.h, count(s.pos) as n from convs c left join shared s using (conv_id) group by c.conv_id, c.h),
rebuilt as (
  select conv_id, pos + 1 as depth, role, text from shared
  union all select t.conv_id, c.n + t.pos - c.h + 1, t.role, t.text from turns t join counted c using (conv_id) where t.pos >= c.h),
heads as (
  select conv_id, depth, strlen(text) as size, list(strlen(role) || ':' || role || text) over (partition by conv_id order by depth) as path from rebuilt
  union all select conv_id, 0, 0, [] from convs),
lasts as (select conv_id, max(depth) as last from heads group by conv_id),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n, max(size) as size,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where depth = last), '') as ends
  from heads join lasts using (conv_id) group by path, depth),
kids as (select list_slice(path, 1, depth - 1) as path, count(*) as kids from nodes where depth > 0 group by all),
valued as (select nodes.*, coalesce(kids, 0) as kids from nodes left join kids on nodes.path = kids.path),
below as (
  select m.path, count(*) filter (where y.kids = 0) as leaves, sum((y.n - 1) * y.size) as saved
  from heads m join valued y on y.conv_id = m.conv_id and y.depth >= m.depth group by m.path)
select x.conv_id, x.depth, p.conv_id as parent_conv_id, x.n as n_convs, cast(x.kids as bigint) as n_children, b.leaves as n_leaves,
  cast(b.saved as bigint) as saved_tokens, sha256(x.ends) as ends_sha256
from valued x join below b on b.path = x.path left join nodes p on x.depth > 0 and p.path = list_slice(x.path, 1, x.depth - 1)"""
