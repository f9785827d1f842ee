"""The trie of conversation prefixes, built from a sorted list of conversations.

A turn is a 16-byte hash of role and text, a conversation the bytes of its turns one after the
other; so the order of bytes is the order of turn sequences, and neighbours in it share
the longest prefixes (LCP). Spark sorts the different sequences by range. Within a block of
sorted rows the edges between neighbours are taken in descending order of LCP, and union-find
joins the components at their ends: what a component has deeper than the edge is complete, and
at the depth of the edge the two meet in a branching node.

The first and the last row of a block share prefixes with rows of other blocks, so the nodes
along these two stay open. The block's forest is contracted to them: two rows that carry, for each
depth, the sums of all that is complete below. Contracted rows are again a sorted list of
rows, so blocks of a partition and then the partitions are merged by the same function across their
boundaries, until the root is complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.texts import only, stored

#: Bytes of a turn's hash.
KEY = 16
#: A block takes rows of about so many bytes of turn hashes.
BLOCK_BYTES = 1 << 20
#: So many contracted rows are merged among themselves.
MERGE_ROWS = 4096
#: Ids of members are hashed in pieces of about so many characters.
_PIECE = 1 << 16
#: Up to so many open nodes are broadcast (under 100 bytes each); more are joined by shuffle.
BROADCAST_NODES = 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ROW = (
    "path binary, lengths array<int>, n array<bigint>, least array<bigint>, children array<bigint>, "
    "leaves array<bigint>, saved array<bigint>, ends array<string>"
)
_NODE = (
    "conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends_sha256 string, parent_conv_id bigint, own_key binary, parent_key binary"
)


@dataclass
class Open:
    """What is known of a node that is not complete: sums over what hangs below it."""

    n: int = 0
    least: int | None = None
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    waiting: list[int] = field(default_factory=list)  # complete children, by place in the list of nodes

    def add(self, other: Open) -> None:
        self.n += other.n
        if other.least is not None and (self.least is None or other.least < self.least):
            self.least = other.least
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        self.waiting += other.waiting


@dataclass
class Row:
    """A sequence of turns, the texts' lengths, and what hangs at each depth along it."""

    path: bytes
    lengths: list[int]
    open: dict[int, Open]


def prefix_key(path: bytes, depth: int) -> bytes:
    return hashlib.blake2b(path[: depth * KEY], digest_size=16).digest()


def common_turns(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix, in turns."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    x = np.frombuffer(a, np.uint8, n * KEY)
    return int(np.argmax(x != np.frombuffer(b, np.uint8, n * KEY))) // KEY


class Forest:
    """Merges sorted rows; collects the nodes that get complete.

    ``known`` says that rows are contracted ones, so nodes were open before and others
    may wait for them by key. With ``whole`` there are no other rows and all nodes get complete.
    """

    def __init__(self, known: bool, whole: bool = False):
        self.known, self.whole = known, whole
        self.nodes: list[list] = []

    def merge(self, rows: list[Row]) -> list[Row]:
        """The contracted rows: the first and the last, or none if ``whole``."""
        last = len(rows) - 1
        parent = list(range(len(rows)))
        top = [len(r.lengths) for r in rows]  # the depth down from which a component is complete
        start, stop = list(range(len(rows))), list(range(len(rows)))
        kept: dict[int, dict[int, Open]] = {0: {}, last: {}}

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def lift(i: int, depth: int) -> None:
            """Complete the component's nodes deeper than ``depth``, or set them aside."""
            row = rows[i]
            if not self.whole and (start[i] == 0 or stop[i] == last):
                aside = kept[0 if start[i] == 0 else last]
                for k in [k for k in row.open if k > depth]:
                    aside[k] = row.open.pop(k)
            else:
                for k in range(top[i], depth, -1):
                    above = self._complete(row, k)
                    if k:
                        row.open.setdefault(k - 1, Open()).add(above)
            top[i] = depth

        edges = [common_turns(a.path, b.path) for a, b in zip(rows, rows[1:])]
        for i in sorted(range(last), key=lambda i: -edges[i]):
            a, b = find(i), find(i + 1)
            lift(a, edges[i])
            lift(b, edges[i])
            if len(rows[a].open) < len(rows[b].open):
                large, small = b, a
            else:
                large, small = a, b
            for k, own in rows[small].open.items():
                rows[large].open.setdefault(k, Open()).add(own)
            rows[small].open = {}
            parent[small] = large
            start[large], stop[large] = start[a], stop[b]
        root = find(0)
        if self.whole:
            lift(root, -1)
            return []
        kept[0].update(rows[root].open)
        out = [Row(rows[i].path, rows[i].lengths, kept[i]) for i in sorted(kept)]
        for row in out:
            for k, own in row.open.items():
                for place in own.waiting:
                    self.nodes[place][-1] = prefix_key(row.path, k)
                own.waiting = []
        return out

    def _complete(self, row: Row, depth: int) -> Open:
        """Makes the node at ``depth`` of a row a complete one; returns what it adds to its parent."""
        own = row.open.pop(depth, None) or Open()
        leaves = own.leaves if own.children else 1
        saved = own.saved + (own.n - 1) * (row.lengths[depth - 1] if depth else 0)
        for place in own.waiting:
            self.nodes[place][-3] = own.least
        key = prefix_key(row.path, depth) if self.known else None
        self.nodes.append(
            [own.least, depth, own.n, own.children, leaves, saved, own.ends or NO_ENDS, None, key, None]
        )
        return Open(own.n, own.least, 1, leaves, saved, None, [len(self.nodes) - 1])


def _read_rows(batch: pa.RecordBatch) -> Iterator[Row]:
    for r in batch.to_pylist():
        columns = zip(r["n"], r["least"], r["children"], r["leaves"], r["saved"], r["ends"])
        yield Row(r["path"], r["lengths"], {k: Open(*x) for k, x in enumerate(columns) if x[0] or x[1] is not None})


def _written(nodes: list[list], rows: list[Row], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Nodes and contracted rows, each in a column of its own, the other one null."""
    names = [f.name for f in out.field("node").type]
    fields = ("n", "least", "children", "leaves", "saved", "ends")
    flat = []
    for row in rows:
        at = [row.open.get(k) or Open() for k in range(len(row.lengths) + 1)]
        flat.append({"path": row.path, "lengths": row.lengths} | {f: [getattr(x, f) for x in at] for f in fields})
    for i in range(0, len(nodes), 10_000):
        part = [dict(zip(names, node)) for node in nodes[i : i + 10_000]]
        columns = [pa.array(part, out.field("node").type), pa.nulls(len(part), out.field("row").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=out)
    if flat:
        columns = [pa.nulls(len(flat), out.field("node").type), pa.array(flat, out.field("row").type)]
        yield pa.RecordBatch.from_arrays(columns, schema=out)


def _merged(known: bool, whole: bool, out: pa.Schema):
    """The function that merges the sorted rows of a partition, block by block."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, contracted = [], 0, []

        def closed(rows: list[Row], again: bool, last: bool = False):
            forest = Forest(known or again, last and whole)
            left = forest.merge(rows)
            return left, _written(forest.nodes, [], out)

        for batch in batches:
            for row in _read_rows(batch):
                block.append(row)
                size += len(row.path) + 64
                if size > BLOCK_BYTES:
                    left, nodes = closed(block, False)
                    yield from nodes
                    contracted += left
                    block, size = [], 0
                    if len(contracted) > MERGE_ROWS:
                        contracted, nodes = closed(contracted, True)
                        yield from nodes
        if block:
            left, nodes = closed(block, False, last=not contracted)
            yield from nodes
            contracted += left
        if contracted and (whole or len(contracted) > 2):
            contracted, nodes = closed(contracted, True, last=True)
            yield from nodes
        yield from _written([], contracted, out)

    return merge


def _turns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``conv_id``, ``n`` (from 0, in the conversation's order), ``key`` and ``length`` of each turn."""
    rows = only(df, columns).where("conv_id IS NOT NULL")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = rows.select("conv_id", "turn", key.alias("key"), F.length(text).alias("length"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("n"), "key", "length")


def conversations(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Every conversation as it stands: ``conv_id``, ``path``, ``lengths``."""
    return _sequences(_turns(df, columns).select("conv_id", F.struct("n", "key", "length").alias("turn")))


def _sequences(turns: DataFrame) -> DataFrame:
    turn_list = F.array_sort(F.collect_list("turn"))
    rows = turns.groupBy("conv_id").agg(turn_list.alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    return rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["length"]).alias("lengths"))


def rebuilt(df: DataFrame, columns: dict[str, str], every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that share openings: ``conv_id``, ``path``, ``lengths``.

    Of conversation ``c`` the first ``h`` turns are those of conversation ``c - c % every``, with
    ``h`` the crc32 of the decimal ``c`` modulo ``most``; its own turns after the first ``h`` follow.
    """
    turns = stored(_turns(df, columns), "turns")
    heads = turns.where(F.col("n") < most - 1).where(F.col("conv_id") % every == 0)
    heads = heads.groupBy("conv_id").agg(F.collect_list(F.struct("n", "key", "length")).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    ids = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    borrowed = ids.select("conv_id", base, h.alias("h")).join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.filter("head", lambda t: t["n"] < F.col("h"))
    # a conversation without a turn left has one row, its turn null, which is not collected
    opening = borrowed.select("conv_id", F.explode_outer(head).alias("turn"))
    own = turns.where(F.col("n") >= h).select("conv_id", F.struct("n", "key", "length").alias("turn"))
    return _sequences(opening.unionByName(own))


def _members(sequences: DataFrame) -> DataFrame:
    """Per different sequence (``path_id``) its ``members``, their least ``conv_id``, and ``ends``.

    ``ends`` is the SHA-256 of all members' ids in ascending order. However many there are, they are
    sorted by range and joined to pieces of text where they lie; only the pieces of a sequence
    meet in one task, one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, first, size = None, [], None, 0
        done: list[tuple] = []

        def cut():
            if ids:
                done.append((now, first, len(ids), ",".join(ids)))

        for batch in batches:
            for path_id, conv_id in zip(batch.column("path_id").to_pylist(), batch.column("conv_id").to_pylist()):
                if path_id != now or size > _PIECE:
                    cut()
                    now, ids, first, size = path_id, [], conv_id, 0
                ids.append(str(conv_id))
                size += len(ids[-1]) + 1
            if len(done) > 1000:
                yield as_batch(done)
                done = []
        cut()
        yield as_batch(done)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path_id", "first", "n", "ids"]
        )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, n, digest = None, None, 0, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["path_id"] != now:
                    if now is not None:
                        rows.append((now, first, n, digest.hexdigest()))
                    now, first, n, digest = r["path_id"], r["first"], 0, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(r["ids"].encode())
                n += r["n"]
            yield finished(rows)
        if now is not None:
            yield finished([(now, first, n, digest.hexdigest())])

    def finished(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path_id", "conv_id", "members", "ends"]
        )

    ids = sequences.select("path_id", "conv_id")
    ids = ids.repartitionByRange("path_id", "conv_id").sortWithinPartitions("path_id", "conv_id")
    parts = ids.mapInArrow(pieces, "path_id binary, first bigint, n bigint, ids string")
    parts = parts.repartition("path_id").sortWithinPartitions("path_id", "first")
    return parts.mapInArrow(hashed, "path_id binary, conv_id bigint, members bigint, ends string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of all sequences, from ``conv_id``, ``path`` and ``lengths``.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (what storing each node once saves in its
    subtree) and ``ends_sha256`` (of the ids that end at the node). No sequences give no nodes.
    One conversation is a value of 16 bytes a turn; all else is bounded by blocks and spread by range.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = f"node struct<{_struct(_NODE)}>, row struct<{_struct(_ROW)}>"
    out = to_arrow_schema(StructType.fromDDL(kind))
    sequences = stored(sequences.withColumn("path_id", F.unhex(F.md5("path"))), "sequences")
    members = _members(sequences).drop("path_id")
    leaves = members.join(sequences.select("conv_id", "path", "lengths"), "conv_id")

    def along(value: Column) -> Column:
        """An array with a value for each depth: nothing but at the end."""
        return F.concat(F.array_repeat(F.lit(None).cast("bigint"), F.size("lengths")), F.array(value))

    def counted(value: Column) -> Column:
        return F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.size("lengths")), F.array(value))

    nothing = F.lit(0).cast("bigint")
    rows = leaves.select(
        "path",
        "lengths",
        counted(F.col("members")).alias("n"),
        along(F.col("conv_id")).alias("least"),
        *[counted(nothing).alias(name) for name in ("children", "leaves", "saved")],
        F.concat(F.array_repeat(F.lit(None).cast("string"), F.size("lengths")), F.array("ends")).alias("ends"),
    )
    rows = rows.repartitionByRange("path").sortWithinPartitions("path")
    parts = stored(rows.mapInArrow(_merged(False, False, out), kind), "forests")
    # two rows a partition: the contracted forests
    edges = parts.where("row IS NOT NULL").select("row.*").repartition(1).sortWithinPartitions("path")
    rest = stored(edges.mapInArrow(_merged(True, True, out), kind), "boundary")
    nodes = parts.where("node IS NOT NULL").select("node.*").unionByName(rest.select("node.*"))
    opened = nodes.where("own_key IS NOT NULL").select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("found"))
    if opened.count() <= BROADCAST_NODES:
        opened = F.broadcast(opened)
    joined = nodes.join(opened, "parent_key", "left")
    return joined.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "found").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )


def _struct(ddl: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    return ", ".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))
