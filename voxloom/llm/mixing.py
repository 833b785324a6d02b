"""Mixing sources to target weights along a time-varying curriculum.

Each source has a share of all words (its target) and a schedule: how strongly
it is wanted at each time of the training, from 0 to 1. The schedule's integral
is the source's cumulative demand. A source offers its documents in a fixed
pseudo-random order, again and again; the document copy that starts at word p
of that stream is due when the cumulative demand reaches p, so inverting the
demand gives its training position. Copies are then sorted by position.

Defined results: a NULL text has size 0; a NULL source is a source of its own,
last in order; documents without words are taken 0 words; repeated rows are
separate documents; a text of any length is one document; an empty table gives
an empty result; other columns pass through ``mix`` unchanged, whatever their
names (a column ``__size`` is the size where there is no ``text``).
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.llm.shared import WORD, renamed

#: Weights by turns of the sources in code-point order, NULL last.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source gives at most this many times its own words.
MOST_REPEATS = 3
#: Knots (time, strength) of the schedule that goes with each weight.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.25), (0.75, 1.0), (1.0, 2.0)),
)
#: Documents that one window partition holds at most, about.
PER_BUCKET = 20_000


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def due_time(share, knots):
    """The time at which a schedule's integral reaches ``share`` of its whole."""
    areas = [
        (t1 - t0) * (m0 + m1) / 2 for (t0, m0), (t1, m1) in zip(knots, knots[1:], strict=False)
    ]
    whole, before, result = sum(areas), 0.0, None
    segments = []
    for ((t0, m0), (t1, m1)), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        segments.append((before / whole, t0, m0, (m1 - m0) / (t1 - t0)))
        before += area
    for low, t0, m0, slope in segments:
        rest = F.greatest((share - F.lit(low)) * F.lit(whole), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(m0 * m0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.lit(t0) + F.when(rest > 0, 2 * rest / (F.lit(m0) + root)).otherwise(0.0)
        result = time if result is None else F.when(share >= F.lit(low), time).otherwise(result)
    return F.least(result, F.lit(1.0))


def source_targets(sizes, weights=WEIGHTS, most_repeats=MOST_REPEATS):
    """Words wanted of each source, from one row per source: ``__key``, ``__source_size``.

    The level of the filling is the largest over all cuts of "smallest ceilings
    first" of what is left for the rest per unit of weight.
    """
    by_key = Window.orderBy("__key")
    turn = F.pmod(F.row_number().over(by_key) - 1, F.lit(len(weights)))
    given = F.array(*[F.lit(float(w)) for w in weights])
    table = (
        sizes.withColumn("__turn", turn)
        .withColumn("__weight", F.get(given, F.col("__turn")))
        .withColumn("__ceiling", (F.col("__source_size") * most_repeats).cast("double"))
    )
    whole = Window.orderBy(F.col("__ceiling") / F.col("__weight"), "__key")
    filled = F.coalesce(
        F.sum("__ceiling").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
    )
    open_weight = F.sum("__weight").over(whole.rowsBetween(0, Window.unboundedFollowing))
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("__source_size").over(everything).cast("double")
    return (
        table.withColumn("__level", (total - filled) / open_weight)
        .withColumn("__level", F.max("__level").over(everything))
        .withColumn("__target", F.least("__ceiling", F.col("__level") * F.col("__weight")))
        .withColumn("__words", total)
        .select("__key", "__turn", "__source_size", "__target", "__words")
    )


def plan_mix(docs, weights=WEIGHTS, schedules=SCHEDULES, most_repeats=MOST_REPEATS):
    """Add to each document ``__size`` and where its copies go.

    ``docs`` has ``doc_id``, ``source`` and either ``__size`` or ``text``. Adds
    ``__source_size``, ``__target``, ``__copies`` and ``__positions``, one
    training position in words per copy.

    Order within a source is that of the MD5 of the id; the first digits of it
    cut every source into buckets, so that no window holds a whole source.
    """
    if "__size" not in docs.columns:
        docs = docs.withColumn("__size", word_count(F.col("text")))
    digits = max(2, math.ceil(math.log(max(docs.count(), 1) / PER_BUCKET, 16)))
    keyed = (
        docs.withColumn(
            "__key",
            F.concat(
                F.when(F.col("source").isNull(), "1").otherwise("0"),
                F.coalesce(F.col("source").cast("string"), F.lit("")),
            ),
        )
        .withColumn("__order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("__bucket", F.substring("__order", 1, digits))
    )
    buckets = keyed.groupBy("__key", "__bucket").agg(F.sum("__size").alias("__bucket_size"))
    targets = source_targets(
        buckets.groupBy("__key").agg(F.sum("__bucket_size").alias("__source_size")),
        weights,
        most_repeats,
    )
    earlier = (
        Window.partitionBy("__key")
        .orderBy("__bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = F.coalesce(F.sum("__bucket_size").over(earlier), F.lit(0))
    offsets = buckets.withColumn("__ahead", ahead).drop("__bucket_size").join(targets, "__key")
    within = (
        Window.partitionBy("__key", "__bucket")
        .orderBy("__order", F.col("doc_id").asc_nulls_last(), "__size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = keyed.withColumn("__until", F.sum("__size").over(within)).join(
        offsets, ["__key", "__bucket"]
    )
    start = F.col("__ahead") + F.col("__until") - F.col("__size")
    source_size, target = F.col("__source_size"), F.col("__target")

    def starts_at(repeat):
        return start + repeat * source_size

    copies = sum(
        (
            F.when(starts_at(e) + F.col("__size") / 2 < target, 1).otherwise(0)
            for e in range(most_repeats)
        ),
        F.lit(0),
    )

    def position(repeat):
        share = F.when(target > 0, starts_at(repeat) / target).otherwise(0.0)
        time = None
        for turn, knots in enumerate(schedules):
            due = due_time(share, knots)
            time = due if time is None else F.when(F.col("__turn") == turn, due).otherwise(time)
        return time * F.col("__words")

    positions = F.array(*[position(e) for e in range(most_repeats)])
    return (
        rows.withColumn("__copies", copies)
        .withColumn("__positions", F.slice(positions, 1, F.col("__copies")))
        .drop("__key", "__order", "__bucket", "__until", "__ahead", "__turn", "__words")
    )


def in_order(planned):
    """Planned documents sorted by the position of their first copy, those not taken last."""
    first = F.coalesce(F.get("__positions", F.lit(0)), F.lit(math.inf))
    return planned.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id")


def mix(docs, **given):
    """The training order: every taken copy of every document, sorted by position.

    Returns the columns of ``docs``. Partitions hold ranges of positions.
    """
    rows, back = renamed(docs, () if "text" in docs.columns else ("__size",))
    copies = plan_mix(rows, **given).withColumn("__position", F.explode("__positions"))
    return back(
        copies.repartitionByRange("__position", "doc_id")
        .sortWithinPartitions("__position", "doc_id")
    )
