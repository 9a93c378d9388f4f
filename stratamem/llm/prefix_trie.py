"""The prefix trie of conversations, from adaptive radix trees over turn ids.

A turn's id is 16 bytes of the digest of its role and text, so a conversation is a key of
ids one after the other, and a trie node is a prefix of whole ids. Each task keeps radix
trees of its own, whose nodes compress paths and change their layout with the number of
children (4, 16, 48 or 256); byte depths between two ids give no node. A task hands on one
row per node it saw, however many of its conversations share it, and the rows of all tasks
are added up by the node's digest.

Sums over a subtree need no second structure: a node belongs to its smallest member, so the
nodes of a conversation are the last ones of its path, from some depth on. The bytes above
that depth are those it shares with smaller conversations, which is what a subtree saves.
The trees are therefore built twice, the second time with each conversation's shared bytes.

Long conversations are cut into keys of ``KEY_TURNS`` turns; a later key grows in a tree of
its own, rooted at the digest of all turns before it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamem.llm.joins import left_join_unique
from stratamem.operators.topn import top_n_per_group
from stratamem.session import materialize

ID_BYTES = 16
HEADS = 9  # a conversation takes fewer than this many turns from its base
BASE_EVERY = 5
KEY_TURNS = 256
# A task's trees are handed on and begun anew after this many turns.
FLUSH_TURNS = 100_000
ROOT = bytes(ID_BYTES)

_KEYS_DDL = ("conv_id long, root binary, depth long, before long, key binary, sizes binary, last boolean, "
             "end_hi long, end_lo long, total long")
_KEYS = pa.schema([("conv_id", pa.int64()), ("root", pa.binary()), ("depth", pa.int64()), ("before", pa.int64()),
                   ("key", pa.binary()), ("sizes", pa.binary()), ("last", pa.bool_()), ("end_hi", pa.int64()),
                   ("end_lo", pa.int64()), ("total", pa.int64())])
_NODES_DDL = ("hi long, lo long, up_hi long, up_lo long, depth long, before long, conv_id long, n long, "
              "leaves long, saved long")
_NODES = pa.schema([(f.split()[0], pa.int64()) for f in _NODES_DDL.split(", ")])
NODE = ["hi", "lo"]


# -- the tree -----------------------------------------------------------------------


class Small:
    """Up to 4 or 16 children: their bytes in one string, searched as a whole."""

    __slots__ = ("limit", "keys", "kids")

    def __init__(self, limit: int = 4):
        self.limit, self.keys, self.kids = limit, bytearray(), []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid) -> Small | Indexed:
        if len(self.kids) < self.limit:
            self.keys.append(byte)
            self.kids.append(kid)
            return self
        grown = Small(16) if self.limit == 4 else Indexed()
        for k, v in self.items():
            grown.put(k, v)
        return grown.put(byte, kid)

    def items(self) -> Iterable:
        return zip(self.keys, self.kids)


class Indexed:
    """Up to 48 children behind an index of all bytes."""

    __slots__ = ("index", "kids")

    def __init__(self):
        self.index, self.kids = bytearray(256), []

    def get(self, byte: int):
        at = self.index[byte]
        return self.kids[at - 1] if at else None

    def put(self, byte: int, kid) -> Indexed | Full:
        if len(self.kids) < 48:
            self.kids.append(kid)
            self.index[byte] = len(self.kids)
            return self
        grown = Full()
        for k, v in self.items():
            grown.put(k, v)
        return grown.put(byte, kid)

    def items(self) -> Iterable:
        return ((b, self.kids[at - 1]) for b, at in enumerate(self.index) if at)


class Full:
    """A place for every byte."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids = [None] * 256

    def get(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid) -> Full:
        self.kids[byte] = kid
        return self

    def items(self) -> Iterable:
        return ((b, kid) for b, kid in enumerate(self.kids) if kid is not None)


class Node:
    """``path`` leads from the branch byte above to this node; ``held`` sums the keys that end here."""

    __slots__ = ("path", "held", "below")

    def __init__(self, path: bytes, held=None):
        self.path, self.held, self.below = path, held, Small()


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


# What a tree knows of a set of keys: their number, smallest conversation, summed and smallest
# shared bytes, and childless nodes.
Sums = tuple[int, int, int, int, int]


def add(a: Sums | None, b: Sums) -> Sums:
    return b if a is None else (a[0] + b[0], min(a[1], b[1]), a[2] + b[2], min(a[3], b[3]), a[4] + b[4])


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, sums: Sums) -> None:
        node, at = self.root, 0
        while True:
            path = node.path
            if path:
                same = len(path) if key.startswith(path, at) else _shared(path, key[at:at + len(path)])
                if same < len(path):
                    lower = Node(path[same + 1:], node.held)
                    lower.below = node.below
                    node.path, node.held, node.below = path[:same], None, Small().put(path[same], lower)
                at += same
            if at == len(key):
                node.held = add(node.held, sums)
                return
            kid = node.below.get(key[at])
            if kid is None:
                node.below = node.below.put(key[at], Node(key[at + 1:], sums))
                return
            node, at = kid, at + 1

    def nodes(self) -> list[tuple[bytes, Node, int]]:
        """Every radix node with the bytes that lead to it from its parent, and its parent's place; parents first."""
        out = [(self.root.path, self.root, -1)]
        at = 0
        while at < len(out):
            for byte, kid in out[at][1].below.items():
                out.append((bytes([byte]) + kid.path, kid, at))
            at += 1
        return out


def digest(above: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(above + turn, digest_size=ID_BYTES).digest()


def trie_rows(tree: RadixTree, root: bytes, depth: int, before: int, size_of: dict[bytes, int]) -> Iterator[tuple]:
    """The trie's nodes within a tree whose root is a prefix of ``depth`` turns and ``before`` bytes.

    The root itself is a row only as the root of all; a later key's root belongs to the key before.
    """
    nodes = tree.nodes()
    sums: list = [node.held for _, node, _ in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        sums[nodes[i][2]] = add(sums[nodes[i][2]], sums[i])

    def row(name, above, d, b, s):
        # Only a node's owner may share less than the bytes before it; it saves nothing there.
        saved = s[2] - s[0] * b + max(0, b - s[3])
        up = struct.unpack(">qq", above) if above is not None else (None, None)
        return (*struct.unpack(">qq", name), *up, d, b, s[1], s[0], s[4], saved)

    if depth == 0:
        yield row(root, None, 0, 0, sums[0])
    ends: list = []
    for (path, _, parent), s in zip(nodes, sums):
        rest, name, d, b = ends[parent] if parent >= 0 else (b"", root, depth, before)
        rest += path
        at = 0
        while len(rest) - at >= ID_BYTES:
            turn, at = rest[at:at + ID_BYTES], at + ID_BYTES
            above, name, d = name, digest(name, turn), d + 1
            yield row(name, above, d, b, s)
            b += size_of[turn]
        ends.append((rest[at:], name, d, b))


def _grow(batches: Iterator[pa.RecordBatch], flush_turns: int) -> Iterator[pa.RecordBatch]:
    """Rows of the trie's nodes from keys with their conversations' shared bytes and leaf counts."""
    trees: dict[bytes, tuple[RadixTree, int, int]] = {}
    size_of: dict[bytes, int] = {}
    turns = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        nonlocal trees, size_of, turns
        rows: list[tuple] = []
        for root, (tree, depth, before) in trees.items():
            for row in trie_rows(tree, root, depth, before, size_of):
                rows.append(row)
                if len(rows) == 20_000:
                    yield _batch(rows, _NODES)
                    rows = []
        if rows:
            yield _batch(rows, _NODES)
        trees, size_of, turns = {}, {}, 0

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in
                   ("conv_id", "root", "depth", "before", "key", "sizes", "shared", "leaf")]
        for conv, root, depth, before, key, sizes, shared, leaf in zip(*columns):
            n = len(key) // ID_BYTES
            for i, size in enumerate(struct.unpack(f"<{n}q", sizes)):
                size_of[key[ID_BYTES * i:ID_BYTES * (i + 1)]] = size
            if root not in trees:
                trees[root] = RadixTree(), depth, before
            trees[root][0].insert(key, (1, conv, shared, shared, leaf))
            turns += n + 1
            if turns >= flush_turns:
                yield from hand_on()
    yield from hand_on()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# -- rebuilt conversations ------------------------------------------------------------


def heads_taken(conv_id: int) -> int:
    """How many turns a conversation takes from its base."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _rebuild(key_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys from turns in order, the base's turns before the own ones."""
        rows: list[tuple] = []
        conv, own, drop = None, False, 0
        ids, sizes = bytearray(), []
        root = name = ROOT
        depth = start = total = 0

        def key(last: bool) -> tuple:
            return (conv, root, depth, start, bytes(ids), struct.pack(f"<{len(sizes)}q", *sizes), last,
                    *(struct.unpack(">qq", name) if last else (None, None)), total if last else None)

        for batch in batches:
            for c, mine, turn, size in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "own", "turn_id", "size")]):
                if c != conv:
                    if own:  # turns of a base alone make no conversation
                        rows.append(key(True))
                    conv, own, drop = c, False, heads_taken(c)
                    ids, sizes, root, name = bytearray(), [], ROOT, ROOT
                    depth = start = total = 0
                if mine:
                    own = True
                    if drop:
                        drop -= 1
                        continue
                if len(sizes) == key_turns:
                    rows.append(key(False))
                    depth, start, root = depth + len(sizes), total, name
                    ids, sizes = bytearray(), []
                name = digest(name, turn)
                ids += turn
                sizes.append(size)
                total += size
            if rows:
                yield _batch(rows, _KEYS)
                rows = []
        if own:
            yield _batch([key(True)], _KEYS)
    return run


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ending conversations, from rows in order; nothing of a node is held but the hash."""
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("ends_sha256", pa.string())])
    node, sha = None, None
    for batch in batches:
        rows = []
        for hi, lo, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if (hi, lo) != node:
                if node is not None:
                    rows.append((*node, sha.hexdigest()))
                node, sha = (hi, lo), hashlib.sha256(str(conv).encode())
            else:
                sha.update(b",%d" % conv)
        if rows:
            yield _batch(rows, schema)
    if node is not None:
        yield _batch([(*node, sha.hexdigest())], schema)


def turn_id(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256),
                               1, 2 * ID_BYTES))


def prefix_trie(conversations: DataFrame, key_turns: int = KEY_TURNS,
                flush_turns: int = FLUSH_TURNS) -> DataFrame:
    """The trie of all rebuilt conversations of ``conversations`` (conv_id, turn, role, text), one row per node.

    Turns go by ``turn``, null first, then by their role and text's digest; repeated rows are
    turns of their own. Null roles and texts are empty; rows without conv_id belong to no
    conversation and are left out, and other columns are ignored. Conversation c becomes the
    first h turns of conversation c - c % 5 (h is crc32 of c in decimal, modulo 9) and its own
    turns after its first h. No conversation, no node. Returns conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns, as ids and sizes, pass one task in order, and so do the ids of the
    conversations that end at one node, since SHA-256 reads them in order; neither is held.
    """
    if key_turns < HEADS:
        raise ValueError(f"a key holds at least the turns of a base: {key_turns}")
    spark = conversations.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_id(role, text).alias("turn_id"), F.octet_length(text).cast("long").alias("size"))
    heads = top_n_per_group(turns.filter(F.col("conv_id") % BASE_EVERY == 0), ["conv_id"],
                            [F.col("turn").asc_nulls_first(), F.col("turn_id")], HEADS - 1, rank_col="place")
    taker = F.try_add("conv_id", F.col("step"))
    taken = (heads.withColumn("step", F.explode(F.sequence(F.lit(1 - BASE_EVERY), F.lit(BASE_EVERY - 1))))
             .withColumn("taker", taker.cast("long")).filter(
                 (F.col("taker") - F.col("taker") % BASE_EVERY == F.col("conv_id"))
                 & (F.col("place") <= F.crc32(F.col("taker").cast("string").cast("binary")) % HEADS))
             .select(F.col("taker").alias("conv_id"), F.lit(False).alias("own"), F.col("place").cast("long").alias("turn"),
                     "turn_id", "size"))
    ordered = (taken.unionByName(turns.withColumn("own", F.lit(True))).repartition(tasks, "conv_id")
               .sortWithinPartitions("conv_id", "own", F.col("turn").asc_nulls_first(), "turn_id"))
    keys = materialize(ordered.mapInArrow(_rebuild(key_turns), _KEYS_DDL), "conversation-keys")

    def grown(rows: DataFrame) -> DataFrame:
        return rows.select("conv_id", "root", "depth", "before", "key", "sizes", "shared", "leaf").mapInArrow(
            lambda batches: _grow(batches, flush_turns), _NODES_DDL)

    # First the nodes with their owners and children, then what each conversation shares.
    seen = grown(keys.withColumns({"shared": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")})).groupBy(
        "hi", "lo").agg(F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"),
                        F.min("before").alias("before"), F.min("conv_id").alias("conv_id"))
    seen = materialize(seen, "trie-owners")
    none = F.lit(None).cast("long")
    owned = materialize(seen.select("hi", "lo", "before", "conv_id", F.lit(0).cast("long").alias("kids")).unionByName(
        seen.filter(F.col("up_hi").isNotNull()).select(
            F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), none.alias("before"), none.alias("conv_id"),
            F.lit(1).cast("long").alias("kids")))
        .groupBy(*NODE).agg(F.min("before").alias("before"), F.min("conv_id").alias("conv_id"),
                            F.sum("kids").alias("kids")), "trie-children")
    owners = owned.groupBy("conv_id").agg(
        F.min("before").alias("own_from"), F.max((F.col("kids") == 0).cast("long")).alias("own_leaf"))
    whole = F.max("total").over(Window.partitionBy("conv_id"))
    shares = keys.join(owners, "conv_id", "left").withColumns({
        "shared": F.coalesce("own_from", whole), "leaf": F.coalesce("own_leaf", F.lit(0).cast("long"))})
    parts = grown(shares).withColumn("kids", F.lit(0).cast("long")).unionByName(
        owned.select("hi", "lo", "kids"), allowMissingColumns=True)
    nodes = materialize(parts.groupBy(*NODE).agg(
        F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.min("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("kids").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "trie-nodes")
    ends = (keys.filter("last").select(F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo"), "conv_id")
            .repartition(tasks, *NODE).sortWithinPartitions(*NODE, "conv_id")
            .mapInArrow(_ends, "hi long, lo long, ends_sha256 string"))
    parents = nodes.filter(F.col("n_children") > 0).select(
        F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"),
        F.col("n_children").alias("siblings"))
    return left_join_unique(nodes, parents, ["up_hi", "up_lo"], "siblings", nodes.count()).join(
        ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
