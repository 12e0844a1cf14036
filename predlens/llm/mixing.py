"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a hash of its documents. A document's virtual finish time is the
number of its source's words up to its end, divided by the source's target; a source that
must give more than it has is read again, up to three times. All copies are put in the order
of their finish times and the mix ends where the total budget does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from predlens.llm.hashing import ticket
from predlens.llm.running import running_total
from predlens.session import durable

WEIGHTS = (5, 2, 1)
PASSES = 3
GRID = 2**13  # steps of finish time in which the end of the budget is looked for: no more rows to sum up than some tens of thousands
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size) with each source's rank, weight and target.

    The targets share the total by weight; one above ``passes`` times its source's size stops
    there and the excess is shared by the others, until none is above. With the sources in the
    order of size for weight, the first k stop and the others share what is left: the first k
    whose share does not exceed the next source's limit is the answer. One row per source is
    small beside the documents, and these windows see only those rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1))
    stopped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * passes
    share = (F.sum("source_size").over(everything) - stopped) / F.sum("weight").over(onward)
    limit = F.col("source_size") * passes
    return (
        weighed.withColumn("share", share)
        .withColumn("fits", F.when(F.col("share") * F.col("weight") <= limit, F.col("share")))
        .withColumn("level", F.max("fits").over(everything))
        .withColumn("target", F.least(limit.cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight")))
        .select("source", "source_size", "rank", "weight", "target")
    )


def _finish(copy: int) -> Column:
    """Finish time of a copy; NULL for what the mix never takes."""
    ends = F.lit(copy) * F.col("source_size") + F.col("before") + F.col("size")
    return F.when((F.col("size") > 0) & (F.col("target") > 0), ends / F.col("target"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """One row per document: its size, source_size, target, copies and words taken, and first finish time.

    The mix is the longest run of copies in finish order whose words stay within the total of
    all sizes; up to a finish time of 1 no source exceeds its target, so only the copies after
    1 are looked through for the end. A NULL or wordless text has the size 0 and is taken 0
    times; a NULL source is a source of its own, the last. Repeated rows are queued one by one.
    Reads doc_id, text and source.
    """
    narrow = durable(
        docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32")),
        "sizes",
    )
    sources = durable(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes), "sources")
    queued = narrow.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    queued = queued.withColumn("ticket", ticket(F.col("doc_id"), F.col("size"), F.col("text_crc32")))
    order = [F.col("ticket"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    timed = durable(running_total(queued, "rank", order, "size"), "queue")
    last = _last_copy(timed, passes)
    copies = sum((F.when(_taken(copy, last), 1).otherwise(0) for copy in range(passes)), F.lit(0))
    return timed.select(
        "doc_id", "source", "text_crc32", "size", "source_size", "target",
        (copies * F.col("size")).cast("long").alias("taken"), copies.cast("int").alias("copies"), _finish(0).alias("finish"),
    )


def _place(copy: Column | int, finish: Column) -> Column:
    """What the global order of copies compares."""
    return F.struct(finish.alias("finish"), F.col("rank"), F.col("before"), (F.lit(copy) if isinstance(copy, int) else copy).alias("copy"))


def _taken(copy: int, last) -> Column:
    finish = _finish(copy)
    early = F.coalesce(finish <= 1, F.lit(False))
    if last is None:
        return early
    end = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["rank"]).alias("rank"), F.lit(last["before"]).alias("before"), F.lit(last["copy"]).alias("copy"))
    return early | F.coalesce(finish.isNotNull() & (_place(copy, finish) <= end), F.lit(False))


def _last_copy(timed: DataFrame, passes: int):
    """The place of the last copy taken after finish time 1, or None if there is none.

    The copies are counted in steps of finish time, the steps summed up, and only the copies
    of the step in which the budget ends are put in order.
    """
    copies = F.explode(F.array(*[_place(copy, _finish(copy)) for copy in range(passes)]))
    later = timed.select("size", copies.alias("place")).where("place.finish IS NOT NULL")
    whole = later.agg(F.sum(F.when(F.col("place.finish") <= 1, F.col("size"))).alias("taken")).first()
    budget = timed.agg(F.sum("size").alias("total")).first()["total"] or 0
    left = budget - (whole["taken"] or 0)
    step = F.least(F.floor((F.col("place.finish") - 1) * GRID), F.lit(PASSES * GRID)).cast("long")
    later = later.where(F.col("place.finish") > 1).withColumn("step", step)
    steps = later.groupBy("step").agg(F.sum("size").alias("size"))
    steps = steps.withColumn("through", F.sum("size").over(Window.orderBy("step")))
    inside = steps.where(F.col("through") <= left).agg(F.max("step").alias("step"), F.max("through").alias("through")).first()
    full, used = inside["step"], inside["through"] or 0
    crossing = steps.where(F.col("through") > left).agg(F.min("step").alias("step")).first()["step"]
    if crossing is not None:
        rows = later.where(F.col("step") == crossing).withColumn("through", F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
        last = rows.where(F.col("through") <= left - used).agg(F.max("place").alias("place")).first()["place"]
        if last is not None:
            return last
    return None if full is None else later.where(F.col("step") == full).agg(F.max("place").alias("place")).first()["place"]


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns.

    Rows that agree in doc_id, source, size and checksum are interchangeable: they share the
    copies taken of them.
    """
    key = ["__doc", "__source", "__size", "__crc"]
    decided = mix_documents(docs, weights, passes).groupBy(
        F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("text_crc32").alias("__c")
    ).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    keyed = docs.withColumns(dict(zip(key, [F.col("doc_id"), F.col("source"), words(F.col("text")), F.crc32(F.col("text").cast("binary"))])))
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(key, ["__d", "__s", "__n", "__c"])]
    joined = keyed.join(decided, same).where("__copies > 0")
    single = joined.where("__rows = 1").withColumn("__mine", F.col("__copies"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    extra = (number <= F.col("__copies") % F.col("__rows")).cast("long")
    shared = joined.where("__rows > 1").withColumn("__mine", F.floor(F.col("__copies") / F.col("__rows")) + extra)
    both = single.unionByName(shared).where("__mine > 0")
    return both.withColumn("__pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mine")))).select(*[F.col(f"`{c}`") for c in docs.columns])
