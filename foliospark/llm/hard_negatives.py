"""Hard negatives of anchors, by joins with a threshold that is lowered until windows fill.

Vectors are rounded to whole numbers, so scores are exact. A join finds all rows whose score
with an anchor reaches the anchor's threshold. It works as L2AP does: dimensions are taken in a
fixed order, and the norms of what follows bound what they can add. An inverted index of a
group of rows leaves out the dimensions of a row from the place on where this bound alone is below
every threshold; partial scores are accumulated over the index, rows are dropped when the norms
of what remains cannot lift any of them, and what is left gets its exact score.

The first threshold of an anchor is high. Anchors whose five positives were not found above it
go into the next round with a lower one; then the same for the windows of scores below each
positive, whose lower end is the last threshold. So every round answers most anchors from
the few rows above a high threshold, and the last one leaves nothing out.

Rows are dealt out in groups by a hash, anchors in chunks; every group meets every chunk once,
both of bounded size, and returns the five best rows a window at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.texts import only, stored

#: Dimensions that are accumulated in one step.
STEP = 8
#: Anchors that are compared with a group in one step, rows of a group and anchors of a chunk at most.
ANCHORS, GROUP, CHUNK = 256, 16_384, 16_384
_PAIRS = 1 << 16
#: Below it, all sums of products are exact in double precision.
_EXACT = 2.0**53


def whole_numbers(df: DataFrame, id_column: str, label_column: str, vector_column: str, scale: float) -> DataFrame:
    """``id``, ``label``, ``vector`` (packed doubles, each the floor of ``scale`` times a component), ``square``, ``n``.

    Without the rows that have a null in one of the three, or a null or non-finite component.
    """
    rows = only(df, {"id": id_column, "label": label_column, "vector": vector_column})
    rows = rows.select(*[F.col(c).cast(k).alias(c) for c, k in (("id", "bigint"), ("label", "bigint"), ("vector", "array<double>"))])

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten()
            values = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            keep = np.flatnonzero(bad[ends] == bad[ends - sizes])
            packed = [values[e - n : e] for e, n in zip(ends[keep], sizes[keep])]
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take),
                    batch.column("label").take(take),
                    pa.array([v.tobytes() for v in packed], pa.binary()),
                    pa.array([float(v @ v) for v in packed], pa.float64()),
                    pa.array([len(v) for v in packed], pa.int32()),
                ],
                names=["id", "label", "vector", "square", "n"],
            )

    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    rows = rows.mapInArrow(rounded, "id bigint, label bigint, vector binary, square double, n int")
    return rows.distinct()


def unpacked(vectors: list[bytes], width: int) -> np.ndarray:
    """The packed vectors as rows of a matrix; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for row, data in zip(out, vectors):
        row[: len(data) // 8] = np.frombuffer(data)
    return out


def remaining_norms(x: np.ndarray) -> np.ndarray:
    """The norms of what follows each step, from all dimensions to none."""
    squares = np.add.reduceat(x * x, np.arange(0, x.shape[1], STEP), axis=1)
    after = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([after, np.zeros((len(x), 1))], axis=1))


def pairs_above(x: np.ndarray, q: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``q`` and ``x``, and scores, of all pairs whose score reaches the threshold of ``q``."""
    width = x.shape[1]
    largest = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(width, 1)
    if not largest < _EXACT / 2:  # so large numbers are compared as Python's, one by one
        whole = np.array([[int(v) for v in row] for row in q], object).reshape(q.shape)
        scores = whole @ np.array([[int(v) for v in row] for row in x], object).reshape(x.shape).T
        a, b = np.nonzero(scores >= thresholds[:, None])
        return a, b, scores[a, b]
    order = np.argsort(-(x * x).sum(axis=0), kind="stable")
    x, q = x[:, order], q[:, order]
    rest_x, rest_q = remaining_norms(x), remaining_norms(q)
    steps = rest_x.shape[1] - 1
    positive = thresholds > 0
    reach = np.where(positive[:, None], rest_q / np.where(positive, thresholds, 1)[:, None], np.inf).max(axis=0)
    reach[-1] = 0  # nothing follows the last step
    with np.errstate(invalid="ignore", over="ignore"):
        covered = np.nan_to_num(rest_x * reach, nan=np.inf) * (1 + 1e-9) < 1
    covered[:, -1] = True
    indexed = covered.argmax(axis=1)  # the steps of a row that are in the index
    rows = np.argsort(-indexed, kind="stable")
    rows = rows[indexed[rows] > 0] if positive.all() else rows
    partial = np.zeros((len(q), len(rows)))
    for step in range(steps):
        inside = int(np.searchsorted(-indexed[rows], -step, side="left"))
        if not inside:
            break
        part = slice(step * STEP, (step + 1) * STEP)
        partial[:, :inside] += q[:, part] @ x[rows[:inside], part].T
        if step % 2 and step + 1 < steps:
            bound = partial[:, :inside] + rest_q[:, step + 1, None] * rest_x[rows[:inside], step + 1] * (1 + 1e-9) + 1
            keep = np.ones(len(rows), bool)
            keep[:inside] = (bound >= thresholds[:, None]).any(axis=0)
            if keep.mean() < 0.9:
                rows, partial = rows[keep], partial[:, keep]
    ends = indexed[rows]
    bound = partial + rest_q[:, ends] * rest_x[rows, ends] * (1 + 1e-9) + 1
    a, b = np.nonzero(bound >= thresholds[:, None])
    b = rows[b]
    scores = np.empty(len(a))
    for i in range(0, len(a), _PAIRS):
        scores[i : i + _PAIRS] = np.einsum("ij,ij->i", q[a[i : i + _PAIRS]], x[b[i : i + _PAIRS]])
    good = scores >= thresholds[a]
    return a[good], b[good], scores[good].astype(np.int64)


def best(a: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best of each ``a``: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, a)) if scores.dtype != object else np.array(
        sorted(range(len(a)), key=lambda i: (a[i], -scores[i], ids[i])), np.int64
    )
    first = np.concatenate([[True], a[order][1:] != a[order][:-1]]) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _joined(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, k: int, same: bool) -> DataFrame:
    """``anchor``, ``place`` (of the window), ``id``, ``score``: per window the ``k`` best rows of each group.

    ``anchors`` has ``threshold`` and, if not ``same``, ``windows``: the positives' scores.
    """
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    groups = -(-n_rows // min(GROUP, max(256, n_rows // (4 * parallel))))
    chunks = -(-n_anchors // CHUNK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.pmod(F.xxhash64("id", "vector"), F.lit(groups)).cast("int")
    left = rows.select("id", "label", "vector", own.alias("group"), every(chunks).alias("chunk"))
    chunk = F.pmod(F.xxhash64("anchor"), F.lit(chunks)).cast("int").alias("chunk")
    right = anchors.select("anchor", "id", "label", "vector", "threshold", "windows", chunk, every(groups).alias("group"))
    names, kinds = ["anchor", "place", "id", "score"], (pa.int64(), pa.int32(), pa.int64(), pa.int64())

    def compared(x_table: pa.Table, q_table: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if x_table.num_rows and q_table.num_rows:
            vectors, asked = (t.column("vector").to_pylist() for t in (x_table, q_table))
            width = max(map(len, vectors + asked)) // 8
            x, x_ids, x_labels = unpacked(vectors, width), x_table["id"].to_numpy(), x_table["label"].to_numpy()
            names_of, q_ids, q_labels = (q_table[c].to_numpy() for c in ("anchor", "id", "label"))
            limits, windows = q_table["threshold"].to_numpy(), q_table["windows"].to_pylist()
            for i in range(0, len(asked), ANCHORS):
                some = slice(i, i + ANCHORS)
                a, b, scores = pairs_above(x, unpacked(asked[some], width), limits[some])
                if same:
                    fit = (x_labels[b] == q_labels[some][a]) & (x_ids[b] != q_ids[some][a])
                    asked_for = [(0, fit)]
                else:
                    other = x_labels[b] != q_labels[some][a]
                    lists = windows[some]
                    most = max(map(len, lists))
                    tops = np.array([w + [-1] * (most - len(w)) for w in lists], scores.dtype).reshape(len(lists), most)
                    asked_for = []
                    for j in range(most):
                        top = tops[a, j]
                        inside = (80 * top <= 100 * scores) & (100 * scores <= 100 * top)
                        asked_for.append((j, other & inside & (top >= 0)))
                for j, fit in asked_for:
                    at = np.flatnonzero(fit)
                    at = at[best(a[at], scores[at], x_ids[b[at]], k)]
                    limited = np.clip(scores[at], -(2**63), 2**63 - 1).astype(np.int64)
                    found.append((names_of[some][a[at]], np.full(len(at), j), x_ids[b[at]], limited))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    pairs = left.groupBy("group", "chunk").cogroup(right.groupBy("group", "chunk"))
    per_group = pairs.applyInArrow(compared, "anchor bigint, place int, id bigint, score bigint")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return per_group.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    anchors_every: int = 100,
    k: int = 5,
    scale: float = 256.0,
) -> DataFrame:
    """For every anchor and each of its positives, the hardest rows of other labels that are not too near.

    Components become whole numbers, the floor of ``scale`` times their value. The score of two rows is
    their inner product; higher ones come first, ties by smaller id. Anchors are the rows whose id is
    divisible by ``anchors_every``; an anchor's positives are its first ``k`` rows of the same label and
    another id. Of each positive the first ``k`` rows of other labels are returned whose score is at
    least 80 % of the positive's and at most the positive's: ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score``, ``negative_score``.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part. Rows
    that agree in id, label and whole numbers are one row. Vectors of different lengths are
    compared as if the shorter one went on with zeros; an empty one scores 0 with all. Scores are exact as far
    as they fit a bigint; others count as its nearest value. A positive with a negative score has no window.
    """
    rows = stored(whole_numbers(df, id_column, label_column, vector_column, scale), "vectors")
    named = rows.where(F.col("id") % anchors_every == 0).withColumn("anchor", F.monotonically_increasing_id())
    anchors = stored(named.withColumn("windows", F.array().cast("array<bigint>")), "anchors")
    totals = rows.agg(F.count("*").alias("n"), F.sum("square").alias("square"), F.max("n").alias("width")).first()
    n_rows, spread = totals["n"], ((totals["square"] or 0.0) / max(1, totals["n"] * (totals["width"] or 1))) ** 0.5
    # Scores of unlike rows scatter about 0 by the anchor's norm times the spread of a component.
    high = NormalDist().inv_cdf(1 - min(0.4, 50 / n_rows)) if n_rows else 0.0
    usual = F.sqrt("square") * spread

    positives, waiting, left = [], anchors, anchors.count()
    for times in (high, high / 2, None):
        if not left:
            break
        asked = waiting.withColumn("threshold", F.lit(float("-inf")) if times is None else usual * times)
        found = stored(_joined(rows, asked, n_rows, left, k, same=True), "positives")
        lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))
        whole = lists if times is None else lists.where(F.size("positives") == k)
        positives.append(whole)
        if times is not None:
            waiting = stored(waiting.join(whole.select("anchor"), "anchor", "left_anti"), "waiting")
            left = waiting.count()
    if not positives:
        return _result(None, rows.sparkSession)
    known = positives[0]
    for more in positives[1:]:
        known = known.unionByName(more)
    asked = anchors.drop("windows").join(known, "anchor")
    scores = F.transform("positives", lambda p: p["score"])
    asked = stored(asked.withColumn("windows", scores).where(F.array_max("windows") >= 0), "windows")

    negatives, waiting, left = [], asked, asked.count()
    least = F.array_min(F.filter("windows", lambda s: s >= 0)) * (0.8 - 1e-12)
    for times in (high, high / 2, None):
        if not left:
            break
        limit = least if times is None else F.greatest(least, usual * times)
        limited = waiting.withColumn("threshold", limit)
        found = stored(_joined(rows, limited, n_rows, left, k, same=False), "negatives")
        negatives.append(found)
        if times is not None:
            counts = found.groupBy("anchor", "place").agg(F.count("*").alias("n"))
            windows = limited.select("anchor", "threshold", F.posexplode("windows").alias("place", "top"))
            lacking = windows.join(counts, ["anchor", "place"], "left").where(F.coalesce("n", F.lit(0)) < k)
            lacking = lacking.where("top >= 0 AND threshold > 0.8 * top").select("anchor").distinct()
            lacking = stored(lacking, "lacking")
            negatives[-1] = found.join(lacking, "anchor", "left_anti")
            waiting = stored(waiting.join(lacking, "anchor", "left_semi"), "waiting")
            left = waiting.count()
    if not negatives:
        return _result(None, rows.sparkSession)
    mined = negatives[0]
    for more in negatives[1:]:
        mined = mined.unionByName(more)
    named = asked.select("anchor", F.col("id").alias("anchor_id"), F.posexplode("positives").alias("place", "positive"))
    return _result(mined.withColumnRenamed("id", "negative_id").join(named, ["anchor", "place"]), rows.sparkSession)


def _result(mined: DataFrame | None, spark) -> DataFrame:
    if mined is None:
        return spark.createDataFrame(
            [],
            "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
        )
    return mined.select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        "rank",
        "negative_id",
        F.col("positive.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
