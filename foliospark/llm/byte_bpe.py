"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every piece of a text (a match of the splitting pattern) is encoded by itself. The
leaves of its tree stand for byte positions; a leaf holds the rank of the pair that
starts there, with the position in the low bits, so that the root is the leftmost pair
of the least rank. A merge changes three leaves - the merged token's, its live left
neighbour's and the one that is gone - and recomputes their paths to the root.

Texts consist mostly of pieces met before, so a task remembers a bounded number of them.
New pieces are encoded many at a time: pieces of one tree width are the rows of numpy
arrays, and each step makes one merge in every row that still has one. Long pieces,
which are few, take the same steps one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliospark.llm.texts import SLICE_BYTES, only, slices, texts_of

_NONE = np.int64(1) << 62
#: Pieces with more bytes than this are encoded one by one.
WIDEST = 256
#: Rows of the arrays that are worked on at once hold about so many tree nodes.
_NODES = 1 << 17
_SPACE_BEFORE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes pieces by the ranks of a vocabulary, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 100_000):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.known_runs: dict[str, bytes] = {}
        self.bits = max(1, max(ranks.values(), default=0).bit_length())
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << self.bits | right] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def ids(self, pieces: Iterable[str]) -> bytes:
        """The ids of pieces that are all known, as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, texts: list[str], split: regex.Pattern) -> list[bytes]:
        """The ids of every text.

        A space after a sign that is no white space always begins a piece, so the runs
        between such spaces are encoded apart, and runs met before are remembered too.
        """
        runs = [_runs(text) for text in texts]
        new = set().union(*runs) - self.known_runs.keys()
        if len(self.known_runs) + len(new) > self.remember:
            self.known_runs.clear()
            new = set().union(*runs)
        order = list(new)
        pieces = [split.findall(run) for run in order]
        self.learn(set().union(*pieces))
        self.known_runs.update(zip(order, map(self.ids, pieces)))
        return [b"".join(map(self.known_runs.__getitem__, r)) for r in runs]

    def learn(self, pieces: set[str]) -> None:
        """Encode what is not known yet, so that :meth:`ids` knows all of ``pieces``."""
        new = pieces - self.known.keys()
        if len(self.known) + len(new) > self.remember:
            self.known.clear()
            new = pieces
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self.known[piece] = rank.to_bytes(4, "little")
            elif len(data) > WIDEST:
                self.known[piece] = self._long(data)
            else:
                by_width.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for width, group in by_width.items():
            step = max(1, _NODES // width)
            for start in range(0, len(group), step):
                part = group[start : start + step]
                encoded = self._many([data for _, data in part], width)
                self.known.update(zip((piece for piece, _ in part), encoded))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens, ``_NONE`` where they do not merge."""
        if not len(self.pair_keys):
            return np.full(len(left), _NONE)
        keys = left << self.bits | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def _many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids of pieces of at most ``width`` bytes, a power of two."""
        n, shift = len(pieces), width.bit_length() - 1
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        live = np.arange(width) < lengths[:, None]
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        after[np.arange(n), lengths - 1] = width
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), _NONE)
        if width > 1:
            ranks = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
            fits = live[:, 1:] & (ranks < _NONE)
            tree[:, width : 2 * width - 1] = np.where(fits, ranks << shift | np.arange(width - 1), _NONE)
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        tree, flat_ids, flat_live = tree.reshape(-1), ids.reshape(-1), live.reshape(-1)
        after, before = after.reshape(-1), before.reshape(-1)
        while len(rows):
            top, first, edge = rows * (2 * width), rows * width, rows * (width + 1)
            root = tree[top + 1]
            at, merged = root & (width - 1), root >> shift
            gone = after[first + at]
            right, left = after[first + gone], before[edge + at]
            flat_ids[first + at] = merged
            flat_live[first + gone] = False
            after[first + at] = right
            before[edge + right] = at  # place ``width`` of a row stands for "none"
            tree[top + width + gone] = _NONE
            follows, leads = right < width, left >= 0
            ranks = self._pair_ranks(merged, flat_ids[first + np.where(follows, right, 0)])
            tree[top + width + at] = np.where(follows & (ranks < _NONE), ranks << shift | at, _NONE)
            left = np.where(leads, left, at)
            ranks = self._pair_ranks(flat_ids[first + left], merged)
            changed = top[leads] + width + left[leads]
            tree[changed] = np.where(ranks < _NONE, ranks << shift | left, _NONE)[leads]
            tops = np.concatenate([top, top, top])
            node = np.concatenate([gone, at, left]) + width
            for _ in range(shift):
                node >>= 1
                below = tops + 2 * node
                tree[tops + node] = np.minimum(tree[below], tree[below + 1])
            rows = rows[tree[top + 1] < _NONE]
        flat, ends = ids[live].astype("<u4").tobytes(), 4 * np.cumsum(live.sum(axis=1))
        starts = [0, *ends[:-1].tolist()]
        return [flat[a:b] for a, b in zip(starts, ends.tolist())]

    def _long(self, data: bytes) -> bytes:
        """The ids of one piece of any length."""
        n = len(data)
        width = 1 << (n - 1).bit_length()
        none = int(_NONE)
        ids = self.byte_ids[np.frombuffer(data, np.uint8)].tolist()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pairs, bits, mask, shift = self.pairs, self.bits, width - 1, width.bit_length() - 1

        def entry(i):
            rank = pairs.get(ids[i] << bits | ids[after[i]]) if after[i] >= 0 else None
            return none if rank is None else rank << shift | i

        tree = [none] * width + [entry(i) for i in range(n)] + [none] * (width - n)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i, value):
            node = i + width
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            i, merged = tree[1] & mask, tree[1] >> shift
            gone = after[i]
            ids[i], after[i] = merged, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            ids[gone] = -1
            put(gone, none)
            put(i, entry(i))
            if before[i] >= 0:
                put(before[i], entry(before[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def _runs(text: str) -> list[str]:
    """The text cut before every space that follows a sign other than white space."""
    if _SPACE_BEFORE.search(text):
        return _CUT.split(text)
    first, *others = text.split(" ")
    return [first, *[" " + run for run in others]]


def encode_texts(
    df: DataFrame,
    vocabulary: str,
    pattern: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Encode every text and decode its ids again.

    Returns per row: ``id``, ``n_tokens``, ``ids`` (array<int>, with ``with_ids``),
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` and ``round_trip`` (true if decoding gave the text's bytes).

    ``vocabulary`` is the path of a rank file on the driver; the ranks (a fixed
    file of about 1 MB) are broadcast. Special tokens are ordinary text. A null text is the
    empty text: no tokens. Repeated rows, equal texts and null ids are rows like any
    other. Texts are never cut. Columns other than the two named are not looked at.
    """
    spark = df.sparkSession
    # A worker keeps a broadcast value from task to task, and with it the encoder put there.
    shared = spark.sparkContext.broadcast({"ranks": read_ranks(vocabulary)})
    rows = only(df, {"id": id_column, "text": text_column})
    rows = rows.withColumn("text", rows["text"].cast("string"))
    kind = rows.schema["id"].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, split = shared.value, regex.compile(pattern)
        if "encoder" not in held:
            held["encoder"] = Encoder(held["ranks"])
        encoder = held["encoder"]
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = texts_of(batch, "text")
            ids = encoder.encode(texts, split)
            decoded = [encoder.decode(x) for x in ids]
            columns = {
                "id": batch.column("id"),
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                "round_trip": pa.array([x == text.encode() for x, text in zip(decoded, texts)], pa.bool_()),
            }
            if with_ids:
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return rows.mapInArrow(encoded, schema + ", ids array<int>" * with_ids)
