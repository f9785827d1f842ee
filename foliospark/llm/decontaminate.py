"""Finding benchmark passages in documents by spaced seeds.

A fixed mask picks some positions of a span of words and ignores the others, so a hash of
the picked words still agrees when an ignored word was replaced. The masks of a span are made
so that, wherever as many words are replaced as are tolerated, one of them ignores all of these;
so no overlap that counts is missed. Hashes of all benchmark positions go into a bit filter of
fixed size; document positions that pass it are joined with the benchmark's hashes. Around every
hit the words of document and item are then laid side by side, and an overlap counts if
enough of them agree, whatever the hash said.

Words are lower-cased (A-Z) and freed of ASCII punctuation at both ends; what is nothing
but punctuation is no word.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import bytes_of, only, slices, stored, text_slices
from foliospark.llm.words import WordHashes, mixed, multiplier

#: Words kept on both sides of a hit.
AROUND = 64
FILTER_BITS = 26
_PUNCTUATION = string.punctuation.encode()


class _Normal(WordHashes):
    """Hashes of normalised words; 0 for those that are nothing but punctuation."""

    def __missing__(self, word: bytes) -> int:
        bare = word.lower().strip(_PUNCTUATION)
        value = xxhash.xxh64_intdigest(bare) if bare else 0
        self.keep(word, value)
        return value


def normal_words(text: bytes, hashes: _Normal) -> np.ndarray:
    words = hashes.of(text.split())
    return words[words != 0]


@cache
def masks(span: int, percent: int) -> tuple[tuple[int, ...], ...]:
    """The positions that each mask of a span looks at.

    With ``s`` words that may differ, the positions are dealt out over ``s + 2`` parts in turn, and
    each mask ignores another ``s`` of the parts. Replaced words lie in ``s`` parts at most.
    """
    tolerated = span - -(-span * percent // 100)
    parts = min(span, tolerated + 2)
    return tuple(
        tuple(i for i in range(span) if i % parts not in ignored) for ignored in combinations(range(parts), min(tolerated, parts - 1))
    )


def seeds(words: np.ndarray, spans: tuple[int, ...], percent: int) -> list[tuple[int, np.ndarray]]:
    """The hashes of all positions, with their span: an array for each mask of each span."""
    found = []
    times = [words * multiplier(i) for i in range(max(spans, default=0))]
    for span in spans:
        n = max(0, len(words) - span + 1)
        for number, picked in enumerate(masks(span, percent)):
            total = np.full(n, span * 1000 + number, np.uint64)
            for i in picked:
                total += times[i][i : i + n]
            found.append((span, mixed(total)))
    return found


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _items(benchmark: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """``item_id``, ``passage`` (key of its words) and ``words`` (hashes) of items with words."""
    rows = only(benchmark, {"item_id": item_column, "text": text_column})
    rows = rows.withColumn("text", F.col("text").cast("string"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Normal()
        for batch in slices(batches, "text"):
            words = [normal_words(t, hashes) for t in bytes_of(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    pa.array([hashlib.blake2b(w.tobytes(), digest_size=16).digest() for w in words], pa.binary()),
                    pa.array([w.view(np.int64) for w in words], pa.list_(pa.int64())),
                ],
                names=["item_id", "passage", "words"],
            )

    kind = rows.schema["item_id"].dataType.simpleString()
    out = rows.mapInArrow(made, f"item_id {kind}, passage binary, words array<bigint>")
    return out.where("size(words) > 0")


def _seed_rows(passages: DataFrame, min_words: int, percent: int) -> DataFrame:
    """``hash``, ``passage`` and ``at`` (word number) of all seeds of the passages."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for passage, words in zip(batch.column("passage").to_pylist(), batch.column("words")):
                words = np.asarray(words.values).view(np.uint64)
                found = [x for _, x in seeds(words, (min(min_words, len(words)),), percent)]
                at = np.concatenate([np.arange(len(x)) for x in found])
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat), pa.array([passage] * len(flat), pa.binary()), pa.array(at.astype(np.int32))],
                    names=["hash", "passage", "at"],
                )

    return passages.select("passage", "words").mapInArrow(made, "hash bigint, passage binary, at int")


def _seed_filter(seed_rows: DataFrame) -> np.ndarray:
    """A bit for each hash, always 8 MB."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = (
        seed_rows.select(bit.alias("bit"))
        .selectExpr("shiftright(bit, 5) AS word", "shiftleft(1L, cast(bit % 32 AS int)) AS bits")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    found = words.toArrow()  # a row a word: 2**(FILTER_BITS - 5) at most
    bitmap = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bitmap


def _regions(rows: DataFrame, bitmap: np.ndarray, spans: tuple[int, ...], percent: int) -> DataFrame:
    """Stretches of documents with hits: ``region``, ``key``, ``id``, ``first``, ``words``, ``hits``."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)
    kind = rows.schema["id"].dataType.simpleString()
    longest = max(spans, default=0)
    hit_type = pa.struct([("hash", pa.int64()), ("at", pa.int32())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted = _Normal(), shared.value
        region = TaskContext.get().partitionId() << 33
        for batch, texts in text_slices(batches, "text", 1 << 20):
            # the words of all texts of the slice, one after the other
            own = [normal_words(text, hashes) for text in texts]
            ends = np.cumsum([len(w) for w in own])
            words = np.concatenate([*own, np.zeros(0, np.uint64)])
            end_of = np.repeat(ends, [len(w) for w in own])
            at, hit = [], []
            for span, values in seeds(words, spans, percent):
                bits = _bit(values)
                passes = np.flatnonzero((wanted[bits >> 5] >> (bits & 31).astype(np.uint32)) & np.uint32(1))
                passes = passes[passes + span <= end_of[passes]]  # not across the end of a text
                at.append(passes)
                hit.append(values[passes])
            at, hit = np.concatenate([*at, np.zeros(0, np.int64)]), np.concatenate([*hit, np.zeros(0, np.uint64)])
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, hit = at[order], hit[order]
            place = np.searchsorted(ends, at, side="right")
            starts = (ends - [len(w) for w in own])[place]
            cut = np.flatnonzero((np.diff(at) > 2 * AROUND) | (np.diff(place) > 0)) + 1
            low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
            firsts = np.maximum(starts[low], at[low] - AROUND)
            stops = np.minimum(ends[place[low]], at[high - 1] + longest + AROUND)
            take = pa.array(place[low].astype(np.int32))
            hits = pa.StructArray.from_arrays(
                [pa.array(hit.view(np.int64)), pa.array((at - starts).astype(np.int32))], fields=list(hit_type)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(region, region + len(low))),
                    batch.column("key").take(take),
                    batch.column("id").take(take),
                    pa.array((firsts - starts[low]).astype(np.int32)),
                    pa.array([words[i:j].view(np.int64) for i, j in zip(firsts, stops)], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array(np.append(low, len(at)).astype(np.int32)), hits),
                ],
                names=["region", "key", "id", "first", "words", "hits"],
            )
            region += len(low)

    schema = f"region bigint, key string, id {kind}, first int, words array<bigint>, hits array<struct<hash: bigint, at: int>>"
    return rows.mapInArrow(found, schema)


def overlap(document: np.ndarray, item: np.ndarray, shift: int, min_words: int, percent: int):
    """The overlap of an item laid ``shift`` words into a document: start in it, words, equal words.

    Counts every window of ``min_words`` words (of the whole item if that is shorter) of
    which ``percent`` per cent agree; None if there is no such window.
    """
    low, high = max(0, shift), min(len(document), shift + len(item))
    window = min(min_words, len(item))
    if high - low < window:
        return None
    equal = document[low:high] == item[low - shift : high - shift]
    sums = np.concatenate([[0], np.cumsum(equal)])
    good = 100 * (sums[window:] - sums[:-window]) >= percent * window
    if not good.any():
        return None
    covered = np.zeros(len(equal) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(good), 1)
    np.add.at(covered, np.flatnonzero(good) + window, -1)
    inside = np.cumsum(covered)[:-1] > 0
    where = np.flatnonzero(inside & equal)
    return low + int(where[0]), int(where[-1] - where[0] + 1), int((inside & equal).sum())


def row_key(id_column: Column, text_column: Column) -> Column:
    """Names a row by its id, or by its text where it has no id."""
    return F.coalesce(F.concat(F.lit("id:"), id_column.cast("string")), F.concat(F.lit("text:"), F.sha2(text_column, 256)))


def benchmark_overlaps(
    df: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    min_words: int = 13,
    percent: int = 80,
) -> DataFrame:
    """The overlaps of documents with benchmark items.

    A document overlaps an item if in ``min_words`` neighbouring words (in all words of a
    shorter item) ``percent`` per cent agree place by place. Returns a
    row for each document and item, the longest overlap of the two: ``key`` (names the
    row), ``id``, ``item_id``, ``first_word`` (from 0), ``n_words``, ``n_equal``.

    Null and empty texts, and items without words, overlap nothing. Items with the same
    words are searched once and all returned; documents without id are searched too. Rows
    that repeat an id and a text give one row.
    """
    items = stored(_items(benchmark, item_column, item_text_column), "items")
    passages = items.groupBy("passage").agg(F.first("words").alias("words"))
    lengths = items.select(F.least(F.size("words"), F.lit(min_words)).alias("n")).distinct().collect()
    spans = tuple(sorted(row["n"] for row in lengths))  # min_words lengths at most
    seed_rows = stored(_seed_rows(passages, min_words, percent), "seeds")
    rows = only(df, {"id": id_column, "text": text_column}).withColumn("text", F.col("text").cast("string"))
    rows = rows.select("id", "text", row_key(F.col("id"), F.col("text")).alias("key"))
    regions = stored(_regions(rows, _seed_filter(seed_rows), spans, percent), "regions")
    hits = regions.select("region", F.inline("hits")).withColumnRenamed("at", "place")
    shifts = hits.join(seed_rows, "hash").select("region", "passage", (F.col("place") - F.col("at")).alias("shift")).distinct()
    pairs = shifts.groupBy("region", "passage").agg(F.collect_list("shift").alias("shifts"))
    words = regions.select("region", "key", "id", "first", F.col("words").alias("document"))
    both = pairs.join(words, "region").join(passages.withColumnRenamed("words", "item"), "passage")

    kind = rows.schema["id"].dataType.simpleString()

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            laid = (batch.column(c) for c in ("document", "item", "first", "shifts"))
            keep, found = [], []
            for i, (document, item, first, shift_list) in enumerate(zip(*laid)):
                document, item, first = np.asarray(document.values), np.asarray(item.values), first.as_py()
                tried = [overlap(document, item, shift - first, min_words, percent) for shift in shift_list.as_py()]
                best = max((x for x in tried if x), key=lambda x: (x[2], x[1], -x[0]), default=None)
                if best:
                    keep.append(i)
                    found.append((best[0] + first, *best[1:]))
            columns = zip(*found) if found else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.take(pa.array(keep, pa.int32())).select(["key", "id", "passage"]).columns,
                    *(pa.array(c, pa.int64()) for c in columns),
                ],
                names=["key", "id", "passage", "first_word", "n_words", "n_equal"],
            )

    laid = both.select("key", "id", "passage", "document", "item", "first", "shifts")
    found = laid.mapInArrow(longest, f"key string, id {kind}, passage binary, first_word bigint, n_words bigint, n_equal bigint")
    best = found.groupBy("key", "id", "passage").agg(
        F.max_by(
            F.struct("first_word", "n_words", "n_equal"), F.struct(F.col("n_equal"), F.col("n_words"), -F.col("first_word"))
        ).alias("best")
    )
    named = best.join(items.select("passage", "item_id"), "passage")
    return named.select("key", "id", "item_id", "best.first_word", "best.n_words", "best.n_equal")


def decontaminate(df: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that overlap no benchmark item, with the columns of ``df``."""
    found = benchmark_overlaps(df, benchmark, id_column, text_column, **options)
    leaked = stored(found.select("key").distinct(), "leaked").withColumnRenamed("key", "leaked_key")
    own = row_key(df[f"`{id_column}`"], df[f"`{text_column}`"].cast("string"))
    return df.join(leaked, own == leaked["leaked_key"], "left_anti")
