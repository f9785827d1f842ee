"""Near-duplicate documents by HyperMinHash registers, bands and exact verification.

A document is the set of its word shingles. Its sketch has ``REGISTERS`` buckets. Every
shingle falls into one bucket, which keeps the least of its hashes; buckets left empty
are filled in further rounds with other hash functions, so that a bucket of two sets
agrees with a probability equal to their Jaccard similarity, for small sets too. Of a
least hash the register stores the number of leading zeros and the mantissa bits after
the first one. Bands of four registers are bucket keys: at a similarity of 0.8 a pair
misses all 32 bands with a probability below 1e-7.

Equal sets are one vertex from the start. In each round every band bucket has a hub;
a vertex in another component than its hub is compared with it: first by the registers'
collision-corrected estimate, the most similar hub of each vertex then on the full
sets. Links join components. Buckets whose members are all in one component need no
more work; of the others the last round compares all vertices across components, block by
block with matrix products, so no link is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.texts import bytes_of, free_name, only, slices, stored
from foliospark.llm.words import WordHashes, mixed, shingle_hashes

REGISTERS = 128
BAND = 4
MANTISSA = 9
#: Fixed value of the HyperMinHash paper: the factor of the expected chance collisions.
COLLISIONS = 0.169919487159739093975315012348630288992889
#: How far below the threshold an estimate may be; over five standard deviations.
MARGIN = 0.2
STAR_ROUNDS = 2
#: Vertices of a bucket that are compared with each other in one go.
BLOCK = 512
_COLUMNS = 4096
#: The filter of wanted ids has so many bits, however many ids there are.
FILTER_BITS = 24


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bucket, of distinct shingles."""
    least = np.full(REGISTERS, np.uint64(0xFFFFFFFFFFFFFFFF))
    empty, turn = np.ones(REGISTERS, bool), 0
    bits = np.uint64(64 - (REGISTERS.bit_length() - 1))
    while len(shingles) and empty.any():
        hashes = np.sort(mixed(shingles, turn))
        buckets = (hashes >> bits).astype(np.int64)
        first = np.ones(len(hashes), bool)
        first[1:] = buckets[1:] != buckets[:-1]
        hashes, buckets = hashes[first], buckets[first]
        new = empty[buckets]
        least[buckets[new]] = hashes[new]
        empty[buckets] = False
        turn += 1
    return least


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of least hashes, as 16-bit registers."""
    bucket_bits = REGISTERS.bit_length() - 1
    value = (least << np.uint64(bucket_bits)) >> np.uint64(bucket_bits + 4)
    mantissa, exponent = np.frexp(value.astype(np.float64))
    zeros = 64 - bucket_bits - 4 - exponent
    digits = (mantissa * (2 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return (zeros.astype(np.int64) << MANTISSA | digits).astype(np.int16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band of a row of registers, different bands apart."""
    packed = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), -1)
    return mixed(packed + np.arange(packed.shape[1], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _sets(texts: list[bytes], width: int, hashes: WordHashes) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(hashes.of(t.lower().split()), width)) for t in texts]


def _key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """Per row ``id``, ``n`` (set size), ``vertex`` (128-bit key of the set), ``registers``, ``bands``."""
    rows = only(df, {"id": id_column, "text": text_column})
    rows = rows.withColumn("text", rows["text"].cast("string"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            sets = _sets(bytes_of(batch, "text"), width, hashes)
            registers = compressed(np.stack([sketch(s) for s in sets]))
            bands = band_keys(registers)
            full = np.array([len(s) > 0 for s in sets])
            ends = np.cumsum(np.concatenate([[0], full])).astype(np.int32)
            registers_of = pa.ListArray.from_arrays(pa.array(ends * REGISTERS), pa.array(registers[full].ravel()))
            bands_of = pa.ListArray.from_arrays(pa.array(ends * bands.shape[1]), pa.array(bands[full].ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                    registers_of,
                    bands_of,
                ],
                names=["id", "n", "vertex", "registers", "bands"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        signed, f"id {kind}, n bigint, vertex binary, registers array<smallint>, bands array<bigint>"
    )


def estimate(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """The Jaccard similarity by the registers, less the collisions expected by chance."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    ratio = n_a / n_b
    chance = F.lit(COLLISIONS * REGISTERS / 2**MANTISSA) * 4 * ratio / ((1 + ratio) * (1 + ratio))
    return (equal - chance) / (F.lit(float(REGISTERS)) - chance)


def _wanted_filter(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of the ids; always 2 MB."""
    bit = F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER_BITS)
    words = (
        ids.select(bit.alias("bit"))
        .selectExpr("shiftright(bit, 5) AS word", "shiftleft(1L, cast(bit % 32 AS int)) AS bits")
        .groupBy("word")
        .agg(F.bit_or("bits").alias("bits"))
    )
    found = words.toArrow()  # one row a word: 2**(FILTER_BITS - 5) at most
    bitmap = np.zeros(1 << FILTER_BITS - 5, np.uint32)
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return bitmap


def _full_sets(df: DataFrame, ids: DataFrame, width: int, id_column: str, text_column: str) -> DataFrame:
    """The sets (``vertex``, ``shingles`` as sorted 64-bit hashes) of the documents ``ids``.

    A filter of fixed size lets some others through as well.
    """
    wanted = df.sparkSession.sparkContext.broadcast(_wanted_filter(ids))
    rows = only(df, {"id": id_column, "text": text_column})
    bit = F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER_BITS)
    rows = rows.select(bit.alias("bit"), rows["text"].cast("string").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bitmap, given = WordHashes(), wanted.value, set()
        for batch in batches:
            bits = batch.column("bit").to_numpy()
            mask = (bitmap[bits >> 5] >> (bits & 31).astype(np.uint32)) & np.uint32(1)
            batch = batch.filter(pa.array(mask.astype(bool)))
            for part in slices([batch], "text"):
                sets = {_key(s): s.tobytes() for s in _sets(bytes_of(part, "text"), width, hashes) if len(s)}
                new = [k for k in sets if k not in given]
                given = given | set(new) if len(given) < 100_000 else set(new)  # copies are mostly seen again soon
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new, pa.binary()), pa.array([sets[k] for k in new], pa.binary())], names=["vertex", "shingles"]
                )

    # rows with the same set give it once each; grouping keeps one
    return rows.mapInArrow(made, "vertex binary, shingles binary").groupBy("vertex").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets reach the similarity, once each."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "left"):
            fits = []
            for x, y in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                fits.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = sets.select(F.col("vertex").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("vertex").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return both.mapInArrow(similar, "a binary, b binary").distinct()


def _close_rows(keys: list[int], shingles: list[np.ndarray], owns: np.ndarray, components: np.ndarray, percent: int):
    """The pairs of rows in different components whose sets are similar enough.

    The sizes of all intersections come from products of 0/1 matrices, a column for every
    hash that two rows have.
    """
    n = len(shingles)
    sizes = np.array([len(s) for s in shingles])
    _, inverse, counts = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    rows = np.repeat(np.arange(n), sizes)
    common = counts[inverse] > 1
    rows, columns = rows[common], number[inverse[common]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    both = np.zeros((n, n), np.float32)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, _COLUMNS):
        low, high = np.searchsorted(columns, [start, start + _COLUMNS])
        matrix = np.zeros((n, min(_COLUMNS, int(columns[high - 1]) + 1 - start)), np.float32)
        matrix[rows[low:high], columns[low:high] - start] = 1
        both += matrix @ matrix.T
    union = sizes[:, None] + sizes[None, :] - both
    fits = (100 * both >= percent * union) & (components[:, None] != components[None, :])
    if keys[0] != keys[1]:
        fits &= owns[:, None] != owns[None, :]  # pairs within a block are compared elsewhere
    left, right = np.nonzero(np.triu(fits, 1))
    return zip(left.tolist(), right.tolist())


def _across_components(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that join all components that similar pairs in a bucket join.

    ``open_rows`` has ``band``, its ``size``, ``vertex`` and ``component``. Buckets are cut
    into blocks, and every pair of blocks is a group of its own, so no task holds a large
    bucket. All pairs of a group are compared on their full sets, in numpy; of the links
    found those become rows that join components not yet joined in the group.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("vertex"), blocks).cast("int")
    dealt = open_rows.select("band", "vertex", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vertex", "component")
    wanted = sets.join(open_rows.select("vertex").distinct(), "vertex").select("vertex", F.col("shingles").alias("hashes"))
    groups = dealt.join(wanted, "vertex").repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(key, rows):
            kept = {r[1]: r for r in rows}  # repeated documents give a set more than once
            rows = list(kept.values())
            names = {c: i for i, c in enumerate({r[2] for r in rows})}
            found = []
            if len(names) > 1:
                shingles = [np.frombuffer(r[3], np.uint64) for r in rows]
                owns, owner = np.array([r[0] for r in rows]), np.array([names[r[2]] for r in rows])
                joined = list(range(len(names)))
                for i, j in _close_rows(key[1:], shingles, owns, owner, percent):
                    x, y = owner[i], owner[j]
                    while joined[x] != x:
                        x = joined[x]
                    while joined[y] != y:
                        y = joined[y]
                    if x != y:
                        joined[max(x, y)] = min(x, y)
                        found.append((rows[i][1], rows[j][1]))
            columns = [pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        current, rows = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("band", "low", "high", "own", "vertex", "component", "hashes")]
            for band, low, high, *row in zip(*columns):
                if (band, low, high) != current:
                    if rows:
                        yield pairs(current, rows)
                    current, rows = (band, low, high), []
                rows.append(row)
        if rows:
            yield pairs(current, rows)

    return groups.mapInArrow(compared, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node reachable over links (``a``, ``b``), of all linked nodes.

    Labels spread to neighbours, then each label is replaced by its own label, so the
    rounds grow with the logarithm of the longest path. Every round is written to shared
    storage.
    """
    both = stored(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .union(links.select(F.col("b"), F.col("a")))
        .distinct(),
        "edges",
    )
    labels = stored(
        both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")),
        "labels",
    )
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        step = step.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.col("label") != F.least("next", F.coalesce("far", "next"))).alias("moved")
        )
        step = stored(step, "labels")
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """``vertex`` and ``component`` after the links have joined components."""
    ends = members.select(F.col("vertex"), "component")
    edges = (
        links.join(ends.withColumnRenamed("vertex", "a").withColumnRenamed("component", "x"), "a")
        .join(ends.withColumnRenamed("vertex", "b").withColumnRenamed("component", "y"), "b")
        .where("x <> y")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
        .distinct()
    )
    labels = components(edges).withColumnRenamed("node", "component")
    joined = members.join(labels, "component", "left")
    return stored(joined.select("vertex", F.coalesce("label", "component").alias("component")), "components")


def near_duplicates(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = 5,
    percent: int = 80,
) -> DataFrame:
    """Each document's component of near duplicates.

    Documents are linked if 100 * |intersection| >= ``percent`` * |union| of their sets
    of ``width``-word shingles (lower-cased A-Z; a shorter text is one shingle). Returns a
    row per row of ``df``: ``id``, ``n_shingles``, ``vertex`` (key of the set),
    ``component_id`` (the least id reachable, its own included) and ``kept`` (``id`` is
    ``component_id``).

    Null and empty texts have no shingles and no links. A row without id is linked with
    nothing, has no ``component_id`` and is kept. Rows that repeat an id are judged row
    by row. Sets are held as 64-bit hashes, and equal sets are found by 128-bit keys.
    """
    signed = stored(signatures(df, width, id_column, text_column), "signatures")
    linkable = signed.where("id IS NOT NULL AND n > 0")
    vertices = stored(
        linkable.groupBy("vertex").agg(
            F.min("id").alias("id"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("bands").alias("bands")
        ),
        "vertices",
    )
    banded = vertices.select("vertex", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    buckets = stored(banded.join(shared, "band"), "buckets")
    comparable = stored(buckets.select("vertex").distinct().join(vertices.select("vertex", "id", "n", "registers"), "vertex"), "comparable")
    sketches = comparable.select("vertex", "n", "registers")
    sets = stored(_full_sets(df, comparable.select("id"), width, id_column, text_column), "sets")
    members = comparable.select("vertex", F.col("vertex").alias("component"))
    tested = None
    for turn in range(STAR_ROUNDS + 1):
        pending = buckets.join(members, "vertex")
        mixed_buckets = (
            pending.groupBy("band")
            .agg(
                F.count("*").alias("size"),
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.min(F.struct(F.xxhash64("vertex", F.lit(turn)), "vertex", "component")).alias("hub"),
            )
            .where("low <> high")
            .select("band", "size", F.col("hub.vertex").alias("b"), F.col("hub.component").alias("other"))
        )
        if turn < STAR_ROUNDS:
            pairs = pending.join(mixed_buckets, "band").where("component <> other").select(F.col("vertex").alias("a"), "b")
        else:
            open_rows = stored(pending.join(mixed_buckets.select("band", "size"), "band"), "open")
            pairs = _across_components(open_rows, sets, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if turn == STAR_ROUNDS:
            links = stored(pairs, "links")
            if not links.isEmpty():
                members = _merged(members, links)
            break
        ends = [
            sketches.select(F.col("vertex").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"registers_{x}"))
            for x in "ab"
        ]
        score = estimate(F.col("registers_a"), F.col("registers_b"), F.col("n_a"), F.col("n_b"))
        close = pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", score.alias("score"))
        close = close.where(F.col("score") >= percent / 100 - MARGIN)
        # of each vertex the likeliest partner
        ranked = close.select(F.explode(F.array("a", "b")).alias("vertex"), "a", "b", "score")
        close = ranked.groupBy("vertex").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("best"))
        close = stored(close.select("best.a", "best.b").distinct(), "likeliest")
        if close.isEmpty():
            continue
        tested = close if tested is None else stored(tested.union(close), "tested")
        links = stored(_verified(close, sets, percent), "links")
        if not links.isEmpty():
            members = _merged(members, links)
    classes = members.join(vertices.select("vertex", "id"), "vertex")
    named = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    of_vertex = members.join(named, "component").select("vertex", "component_id")
    rest = vertices.select("vertex", F.col("id").alias("least"))
    of_vertex = rest.join(of_vertex, "vertex", "left").select("vertex", F.coalesce("component_id", "least").alias("component_id"))
    keyed = signed.select("id", F.col("n").alias("n_shingles"), "vertex")
    out = keyed.join(of_vertex, "vertex", "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return out.select("id", "n_shingles", "vertex", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row of the least id stays.

    Rows without id and texts without words stay. Of rows that repeat an id and a text one
    stays; rows that share an id but not their text are judged by their texts.
    """
    found = near_duplicates(df, id_column, text_column, width, percent)
    verdicts = stored(found.select("id", "vertex", "kept"), "verdicts").where("id IS NOT NULL")
    repeated = stored(verdicts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    gone = stored(verdicts.where("NOT kept").select("id").distinct().join(repeated, "id", "left_anti"), "gone")
    own, text = df[f"`{id_column}`"], df[f"`{text_column}`"].cast("string")
    name, key = free_name(df, "near_dup_id"), free_name(df, "near_dup_vertex")
    if repeated.isEmpty():
        return df.join(gone.withColumnRenamed("id", name), own == F.col(name), "left_anti")
    rest = df.join(gone.union(repeated).withColumnRenamed("id", name), own == F.col(name), "left_anti")

    @F.pandas_udf("binary")
    def vertex(texts):
        import pandas as pd

        sets = _sets([(t or "").encode() for t in texts], width, WordHashes())
        return pd.Series([_key(s) if len(s) else None for s in sets])

    again = df.join(repeated.withColumnRenamed("id", name), own == F.col(name), "left_semi")
    again = again.dropDuplicates([id_column, text_column])
    staying = verdicts.where("kept").join(repeated, "id").distinct()
    staying = staying.select(F.col("id").alias(name), F.col("vertex").alias(key))
    same = (own == F.col(name)) & vertex(text).eqNullSafe(F.col(key))
    return rest.unionByName(again.join(staying, same, "left_semi"))
