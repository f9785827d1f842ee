"""Mixing sources along a time-varying curriculum.

Every source has a schedule: its weight over training time, piecewise linear from time 0 to
1. The integral of the schedule is the weight of the source as a whole, and by these weights
the sources share the demand for tokens. A source's demand up to a time follows from the
integral up to there; it is inverted, so that every token of the source has a time at which
training asks for it. Documents of a source stand in an order of their own, by a hash; the
tokens before a document say when the document is due, and sorting by that time (Spark's
range sort) gives the order of training, in which the sources mix as their schedules say.

Sums of the tokens before a document are made in three steps: by the first two hex digits of
the hash, by four, and among the documents that share four. No step needs more of a source at
one place than 256 sums or 1 in 65,536 of its documents, however large the source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.texts import stored

Knots = list[tuple[float, float]]

_SEGMENTS = "array<struct<t0: double, t1: double, w0: double, w1: double, a0: double, a1: double>>"
_WORD = r"[^\x20\x09-\x0D]+"


def segments(knots: Knots) -> list[tuple[float, float, float, float, float, float]]:
    """The pieces of a schedule: times, weights, and the integrals up to both ends."""
    times = [t for t, _ in knots]
    if len(knots) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError("a schedule is given at two times or more, rising from 0 to 1")
    if any(w < 0 for _, w in knots):
        raise ValueError("a weight is not negative")
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        after = area + (w0 + w1) / 2 * (t1 - t0)
        pieces.append((float(t0), float(t1), float(w0), float(w1), area, after))
        area = after
    return pieces


def _time_of(area: Column, pieces: Column) -> Column:
    """The time up to which the schedule's integral is ``area``."""
    piece = F.coalesce(F.get(F.filter(pieces, lambda p: p["a1"] > area), F.lit(0)), F.element_at(pieces, -1))
    rest = F.least(area, piece["a1"]) - piece["a0"]
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    root = F.sqrt(F.greatest(piece["w0"] * piece["w0"] + 2 * slope * rest, F.lit(0.0)))
    return F.when(rest <= 0, piece["t0"]).otherwise(piece["t0"] + 2 * rest / (piece["w0"] + root))


def _scheduled(sources: DataFrame, schedules: list[Knots] | dict[str | None, Knots]) -> DataFrame:
    """``source``, ``source_size``, ``weight`` and ``pieces``."""
    spark = sources.sparkSession
    if isinstance(schedules, dict):
        named = [("" if s is None else f"={s}", segments(knots)) for s, knots in schedules.items()]
        given = spark.createDataFrame([(s, p[-1][-1], p) for s, p in named], f"source string, weight double, pieces {_SEGMENTS}")
        joined = sources.join(given, "source", "left")
        return joined.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    cycle = [segments(knots) for knots in schedules]
    given = spark.createDataFrame(
        [(i, p[-1][-1], p) for i, p in enumerate(cycle)], f"turn int, weight double, pieces {_SEGMENTS}"
    )
    order = [F.col("source") == "", F.col("source")]
    placed = stored(sources.orderBy(*order).withColumn("part", F.spark_partition_id()), "sources")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    rank = placed.join(before, "part").withColumn("turn", ((F.col("before") + own - 1) % len(cycle)).cast("int"))
    return rank.join(given, "turn").select("source", "source_size", "weight", "pieces")


def source_targets(scheduled: DataFrame, demand: float, max_epochs: int) -> DataFrame:
    """The same rows with ``target``, the tokens asked of a source.

    ``demand`` tokens for each token there is are shared by weight. A target stops at
    ``max_epochs`` times the source's size, and what is over is shared anew among the rest, until
    no target is above. Each round takes one row of sums to the driver.
    """
    weight, limit = F.col("weight").cast("decimal(28, 12)"), F.col("source_size") * max_epochs
    totals = scheduled.agg(F.sum("source_size"), F.sum(weight)).first()
    wanted = float(totals[0] or 0) * demand
    share, full = (wanted / float(totals[1]) if totals[1] else 0.0), 0
    while True:
        above = F.col("weight") * share > limit
        row = scheduled.agg(
            F.count(F.when(above, 1)).alias("full"),
            F.sum(F.when(above, limit)).alias("taken"),
            F.sum(F.when(~above, weight)).alias("weight"),
        ).first()
        if row["full"] == full or not row["weight"]:
            break
        full = row["full"]
        share = (wanted - float(row["taken"] or 0)) / float(row["weight"])
    return scheduled.withColumn("target", F.least(F.col("weight") * share, limit.cast("double")))


def training_mix(
    df: DataFrame,
    schedules: list[Knots] | dict[str | None, Knots],
    demand: float = 1.5,
    max_epochs: int = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """When training takes each document, and how many of its words.

    ``schedules`` names the knots ``(time, weight)`` of each source's weight over time, or lists
    schedules that the sources take in turn, by code point, null last. A source without schedule
    or with weight 0 is not taken. The size of a text is its number of words; of null it is 0.
    ``demand`` and ``max_epochs`` are as in :func:`source_targets`.

    Returns a row for each row of ``df``: ``id``, ``size``, ``source_size``, ``target`` (of its
    source), ``taken`` (words, repeats counted), ``takes``, an array of ``epoch`` (from 0), ``at``
    (words of the source taken before), ``words`` and ``position`` (a time), and ``row``, a struct
    of the columns named in ``carry``, so that no name can clash. A source's words taken are its
    target, rounded: of the last document only the first words are taken. A document is taken
    once per epoch, so at most ``max_epochs`` times its size. Documents without words have no
    takes. Rows without id are documents too; rows that agree in id, text and source take turns among
    themselves. Orders depend on ids and texts alone, so reruns agree. An empty table gives none.
    """
    source = df[f"`{source_column}`"].cast("string")
    text, id_text = df[f"`{text_column}`"].cast("string"), df[f"`{id_column}`"].cast("string")
    carried = F.struct(*[df[f"`{c}`"] for c in carry]) if carry else F.lit(None).cast("struct<>")
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source"),
        df[f"`{id_column}`"].alias("id"),
        F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", id_text, text)).alias("place"),
        carried.alias("row"),
    )
    wide, narrow = F.substring("place", 1, 2).alias("wide"), F.substring("place", 1, 4).alias("narrow")
    sums = stored(rows.groupBy("source", wide, narrow).agg(F.sum("size").alias("size")), "sizes")
    sources = sums.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(stored(_scheduled(sources, schedules), "schedules"), demand, max_epochs)

    def before(keys: list[str], order: list[str]) -> Column:
        running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.sum("size").over(running) - F.col("size")

    known = ["source_size", "target", "weight", "pieces"]
    level = sums.groupBy("source", "wide").agg(F.sum("size").alias("size")).join(targets, "source")
    level = level.select("source", "wide", *known, before(["source"], ["wide"]).alias("start"))
    level = sums.join(level, ["source", "wide"])
    start = F.col("start") + before(["source", "wide"], ["narrow"])
    level = level.select("source", "narrow", *known, start.alias("start"))
    rows = rows.withColumn("narrow", narrow).join(level, ["source", "narrow"])
    rows = rows.withColumn("start", F.col("start") + before(["source", "narrow"], ["place", "id", "size"]))

    quota = F.round("target").cast("bigint")

    def take(epoch: Column) -> Column:
        at = epoch * F.col("source_size") + F.col("start")
        words = F.greatest(F.least(F.col("size"), quota - at), F.lit(0).cast("bigint"))
        time = _time_of(F.when(F.col("target") > 0, at / F.col("target") * F.col("weight")), F.col("pieces"))
        return F.struct(epoch.cast("int").alias("epoch"), at.alias("at"), words.alias("words"), time.alias("position"))

    takes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), take), lambda x: x["words"] > 0)
    rows = rows.withColumn("takes", takes)
    taken = F.aggregate("takes", F.lit(0).cast("bigint"), lambda total, x: total + x["words"])
    return rows.select("id", "size", "source_size", "target", taken.alias("taken"), "takes", "place", "row")


def by_first_position(mix: DataFrame) -> DataFrame:
    """The rows of :func:`training_mix` by the time they are first taken; those not taken come last."""
    return mix.orderBy(F.get("takes", F.lit(0))["position"].asc_nulls_last(), "place")


def training_order(mix: DataFrame) -> DataFrame:
    """A row for each take of :func:`training_mix`, in the order of training.

    Returns ``position``, ``epoch``, ``words`` (of the document's first ones), ``id`` and ``row``.
    """
    taken = mix.select("id", "row", "place", F.inline("takes"))
    return taken.orderBy("position", "epoch", "place").select("position", "epoch", "words", "id", "row")
