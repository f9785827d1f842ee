"""Removing passages of lines that occur again elsewhere.

A rolling hash over the hashes of each two neighbouring lines with words chooses boundaries:
some of its bits say whether a chunk starts before the first of the two lines, others whether one
ends after the second. A chunk runs from such a start, or back from such an end, over the fewest
lines that are two lines with words and have words enough. So a chunk hangs on lines inside it
alone: it is cut in the same way wherever its lines stand, also if all around it differs.

Chunks with the same 128-bit key are brought together, and those that occur twice have their
bytes compared: Spark groups them by the bytes themselves. The lines between a chunk and the
next ones on both sides, of which no chunk may hold those at the edge of a passage, go along with it
and are compared with the lines around the first occurrence, one by one outwards. The first
occurrence stays, by id and place; all later ones go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliospark.llm.texts import free_name, only, stored, text_slices

_BASE = 0x9E3779B97F4A7C15
_FULL = 0xFFFFFFFFFFFFFFFF
#: Of eight values that the bits of a rolling hash have, so many are no boundary. A passage of two
#: lines has two places for one, so it is cut as a chunk but in one case of 64.
NO_BOUNDARY = 1
#: Lines that are compared around a chunk, each way. More stand between chunks by a chance below 1e-14.
AROUND = 8
#: The filter of repeated keys has so many bits, however many keys there are.
FILTER_BITS = 26


def boundaries(hashes: list[int]) -> tuple[list[bool], list[bool]]:
    """For each line, by its hash and that of the next one (of the one before): may a chunk start (end) there?"""
    starts, stops = [], [False]
    for one, two in zip(hashes, hashes[1:]):
        rolling = (one * _BASE + two) & _FULL
        rolling = (rolling ^ rolling >> 32) * _BASE & _FULL
        starts.append(rolling >> 61 >= NO_BOUNDARY)
        stops.append((rolling >> 58 & 7) >= NO_BOUNDARY)
    return [*starts, False], stops[: len(hashes)]


def chunks(text: bytes, min_words: int) -> Iterator[tuple[int, int, bytes, list[bytes], list[bytes]]]:
    """First line, line after the last, bytes, and the lines before and after (nearest first) of all chunks.

    Chunks start and end with a line that has words. There are two a line at most.
    """
    if text.count(b"\n") == 0:
        return
    lines = text.split(b"\n")
    places, starts, stops, before, at = [], [], [], [0], 0
    for place, line in enumerate(lines):
        n = len(line.split())
        if n:
            places.append(place)
            starts.append(at)
            stops.append(at + len(line))
            before.append(before[-1] + n)
        at += len(line) + 1
    may_start, may_end = boundaries([xxhash.xxh64_intdigest(lines[p]) for p in places])
    found, low, high = set(), 0, 1
    for i in range(len(places)):
        high = max(high, i + 1)
        while high < len(places) and before[high + 1] - before[i] < min_words:
            high += 1
        if high < len(places) and may_start[i]:
            found.add((i, high))
        while low + 1 < i and before[i + 1] - before[low + 1] >= min_words:
            low += 1
        if low < i and before[i + 1] - before[low] >= min_words and may_end[i]:
            found.add((low, i))
    first, last = {i for i, _ in found}, {j for _, j in found}
    for i, j in sorted(found):
        up, down = i - 1, j + 1
        while up >= 0 and i - up <= AROUND and up not in first:
            up -= 1
        while down < len(places) and down - j <= AROUND and down not in last:
            down += 1
        above = lines[places[up] + 1 if up >= 0 else 0 : places[i]][::-1]
        below = lines[places[j] + 1 : places[down] if down < len(places) else len(lines)]
        yield places[i], places[j] + 1, text[starts[i] : stops[j]], above[: 2 * AROUND], below[: 2 * AROUND]


def _chunk_rows(rows: DataFrame, min_words: int, bitmap=None) -> DataFrame:
    """A row a chunk: ``key``, ``id``, ``line``, ``stop``; with a filter also ``data`` and the lines ``above`` and ``below``."""
    kind = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch, texts in text_slices(batches, "text"):
            places, lines, stops, keys, data, above, below = [], [], [], [], [], [], []
            for place, text in enumerate(texts):
                for line, stop, chunk, before, after in chunks(text, min_words):
                    key = xxhash.xxh3_128_digest(chunk)
                    if wanted is not None:
                        bit = int.from_bytes(key[:4], "little") >> 32 - FILTER_BITS
                        if not wanted[bit >> 5] >> (bit & 31) & 1:
                            continue
                        data.append(chunk)
                        above.append(before)
                        below.append(after)
                    places.append(place)
                    lines.append(line)
                    stops.append(stop)
                    keys.append(key)
            columns = [
                pa.array(keys, pa.binary()),
                batch.column("id").take(pa.array(places, pa.int32())),
                pa.array(lines, pa.int32()),
                pa.array(stops, pa.int32()),
            ]
            names = ["key", "id", "line", "stop"]
            if wanted is not None:
                columns += [pa.array(data, pa.binary()), *(pa.array(x, pa.list_(pa.binary())) for x in (above, below))]
                names += ["data", "above", "below"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = ", data binary, above array<binary>, below array<binary>" if bitmap is not None else ""
    return rows.where("id IS NOT NULL").select("id", "text").mapInArrow(cut, f"key binary, id {kind}, line int, stop int{more}")


def _key_filter(keys: DataFrame) -> np.ndarray:
    """A bit for the first bytes of each key; always 8 MB."""
    byte = [F.conv(F.hex(F.substring("key", i, 1)), 16, 10).cast("bigint") for i in (1, 2, 3, 4)]
    number = byte[0] + byte[1] * 256 + byte[2] * 65536 + byte[3] * 16777216
    words = (
        keys.select(F.shiftright(number, 32 - FILTER_BITS).alias("bit"))
        .selectExpr("shiftright(bit, 5) AS word", "shiftleft(1L, cast(bit % 32 AS int)) AS bits")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    found = words.toArrow()  # a row a word: 2**(FILTER_BITS - 5) at most
    bitmap = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bitmap


def _alike(a: Column, b: Column) -> Column:
    """How many lines of two lists agree, from the first one on."""
    n = F.least(F.size(a), F.size(b))
    differ = F.transform(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x != y), lambda d: F.coalesce(d, F.lit(True)))
    return F.when(n > 0, F.coalesce(F.nullif(F.array_position(differ, True), F.lit(0)) - 1, n.cast("bigint"))).otherwise(0)


def repeated_chunks(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 10) -> DataFrame:
    """What to remove: ``id``, ``line`` (the first), ``stop`` (after the last), ``key`` (of a chunk's bytes),
    ``up`` and ``down`` (lines around it that repeat as well).

    An occurrence is an id and a line: rows that repeat an id with the same text are one. One that
    overlaps the first occurrence stays.
    """
    rows = only(df, {"id": id_column, "text": text_column}).withColumn("text", F.col("text").cast("string"))
    occurrences = _chunk_rows(rows, min_words).distinct()
    keys = occurrences.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    with_bytes = stored(_chunk_rows(rows, min_words, _key_filter(stored(keys, "keys"))), "chunks")
    own = F.struct("id", "line", "above", "below")
    # grouping by the bytes is the byte comparison
    groups = with_bytes.groupBy("key", "data").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = stored(groups, "groups")
    later = (F.col("id") != F.col("first.id")) | (F.col("line") >= F.col("first.line") + F.col("stop") - F.col("line"))
    variants = groups.groupBy("key").agg(F.count("*").alias("variants"), F.min("first").alias("first"))
    clear = variants.where("variants = 1").select("key", "first")
    mixed = variants.where("variants > 1").select("key")
    chunk = with_bytes.select("key", "id", "line", "stop", "above", "below")
    # what shares a key with a repeated chunk but not its bytes is told apart by them
    same = with_bytes.join(mixed, "key").join(groups, ["key", "data"]).select(*chunk.columns, "first")
    found = chunk.join(clear, "key").select(*chunk.columns, "first").unionByName(same).where(later)
    up, down = _alike(F.col("above"), F.col("first.above")), _alike(F.col("below"), F.col("first.below"))
    return found.select("id", "line", "stop", "key", up.cast("int").alias("up"), down.cast("int").alias("down")).distinct()


def line_dedup(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 10) -> DataFrame:
    """All rows of ``df``, their texts without passages that occurred before.

    A passage is two neighbouring lines or more, the first and the last with words, that have
    ``min_words`` words or more. Lines go that stand in a passage whose bytes stand at another
    place, in the same text or another, that comes first by id and line and does not overlap it; so
    each line that goes stays at an earlier place. A passage is found by the chunks cut inside it (see
    ``NO_BOUNDARY``; with 0 every line is a boundary and no passage is lost). Lines go whole, with
    their line break. The columns are those of ``df`` and one more, named by :func:`removed_column`:
    the number of lines removed.

    Null and empty texts, and texts of one line, stay as they are. A row without id stays as it
    is and makes no other row's passage a repetition. Rows that repeat an id and its text are
    changed alike.
    """
    removed = repeated_chunks(df, id_column, text_column, min_words)
    of_row = removed.groupBy("id").agg(F.collect_list(F.struct("line", "stop", "key", "up", "down")).alias("chunks"))
    names = df.columns
    gone, count, copy = free_name(df, "chunks"), removed_column(df), free_name(df, "line_dedup_text")
    of_row = of_row.select(F.col("id").alias(f"{gone}_id"), F.col("chunks").alias(gone))
    joined = df.join(of_row, df[f"`{id_column}`"] == of_row[f"{gone}_id"], "left").drop(f"{gone}_id")
    joined = joined.withColumn(copy, joined[f"`{text_column}`"].cast("string"))

    def shortened(text: bytes, chunk_list: list[dict]) -> tuple[bytes, int]:
        lines, gone_lines = text.split(b"\n"), set()
        for c in chunk_list:
            # another row with this id may have another text
            if xxhash.xxh3_128_digest(b"\n".join(lines[c["line"] : c["stop"]])) == c["key"]:
                first, stop = c["line"] - c["up"], c["stop"] + c["down"]
                # lines without words at the ends of a passage stay
                while first < c["line"] and not lines[first].split():
                    first += 1
                while stop > c["stop"] and not lines[stop - 1].split():
                    stop -= 1
                gone_lines.update(range(first, stop))
        return b"\n".join(x for i, x in enumerate(lines) if i not in gone_lines), len(gone_lines)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, copy):
            lists = batch.column(gone)
            counts = [0] * batch.num_rows
            new = batch.column(copy)
            if lists.null_count < len(lists):
                changed = [None if v is None else t for v, t in zip(new.is_valid().to_pylist(), texts)]
                for i, chunk_list in enumerate(lists.to_pylist()):
                    if chunk_list and changed[i] is not None:
                        changed[i], counts[i] = shortened(changed[i], chunk_list)
                new = pa.array(changed, pa.binary()).cast(new.type)
            columns = [new if name == text_column else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=[*names, count])

    out = StructType([*[StructField(f.name, StringType()) if f.name == text_column else f for f in df.schema], StructField(count, LongType())])
    return joined.mapInArrow(without, out)


def removed_column(df: DataFrame) -> str:
    """``n_removed``, or the first of ``n_removed_``, ... that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, "n_removed"
    while name in taken:
        name += "_"
    return name
