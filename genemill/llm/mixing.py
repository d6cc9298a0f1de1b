"""Sources mixed to target weights by weighted fair queueing.

Sources in code point order (null last) weigh `weights`, repeating, and share `share` times all words. A target stops at
`most` times the size of its source; the excess is shared again by weight until no target is above its stop.

Each source queues its documents in shuffled order (a hash of id and text), `most` times over. A document's virtual finish
time is the number of words its source has queued up to its end, divided by the target of the source. All queues are
sorted together by finish time and cut where the words taken reach the budget; since a source has queued its whole target
at time 1, each source ends within a document of its target.

Sizes are counted once and written as a slim table; everything after reads that table. Running totals of a queue come from
buckets of the hash whose totals are carried forward, so a source of any size is spread over many tasks; rows that are
equal in everything are one entry with a count. The joint order is a range sort that is written once; only the part in
which the budget ends is read again in order. Targets use whole numbers only.

Null and empty texts have size 0 and nothing is taken of them; a null id is an id of its own; repeated rows each get a
row. Empty tables give no rows. A source without words has target 0. Texts of any length are counted whole, in Arrow
buffers. Results depend on ids, sources and texts only, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genemill.llm.common import cut_table

WEIGHTS = (5, 2, 1)
SEED = 20
ROWS_OF_BUCKET = 2_000  # in expectation; a bucket of a queue is ordered in one task
MOST_BUCKET_BITS = 14  # beyond as many buckets of a queue they grow
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _word_counts(texts: pa.Array) -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, from the bytes of the whole array."""
    data = texts.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    if not len(data) or ends[-1] == ends[0]:
        return np.zeros(len(data), np.int64)
    word = ~_SPACE[np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = (ends[:-1] - ends[0])[np.diff(ends) > 0]
    begins[firsts] = word[firsts]
    # an empty text would make an empty slice, for which reduceat gives the element itself
    counts = np.zeros(len(data), np.int64)
    counts[np.diff(ends) > 0] = np.add.reduceat(begins, firsts, dtype=np.int64)
    return counts


@F.arrow_udf(T.LongType())
def n_words(texts: pa.Array) -> pa.Array:
    """Words of each text; null has none."""
    out = [pa.array(_word_counts(texts.slice(i, 512).fill_null("")), pa.int64()) for i in range(0, len(texts), 512)]
    return pa.concat_arrays(out) if out else pa.array([], pa.int64())


def _ranked(sources: DataFrame) -> DataFrame:
    """Add the place of each source in code point order (from 0, null last), by a distributed sort."""
    placed = cut_table(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    # one row for each partition of the sort
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id") - F.shiftleft(part, 33)
    return placed.withColumn("_part", part).join(offsets, "_part").select("source", "source_size", place.alias("place"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """source, source_size, place, weight, target from (source, source_size).

    share: numerator and denominator of the part of all words that is shared out. With all targets below their stops set
    to level * weight, the level that uses the budget is found by adding those at their stops until none is added.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut_table(_ranked(sizes).withColumn("weight", weight.cast("long")))
    wide = "decimal(38,0)"
    total = int(ranked.agg(F.sum(F.col("source_size").cast(wide))).first()[0] or 0)
    num, den = 0, 1  # budget words of a weight of 1, times share[1]
    while True:
        stop = F.col("source_size").cast("decimal(20,0)") * (most * share[1])
        over = stop * F.lit(den).cast("decimal(14,0)") <= F.col("weight").cast("decimal(10,0)") * F.lit(num).cast("decimal(24,0)")
        rest, full = ranked.agg(
            F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, stop.cast(wide)))
        ).first()
        if not rest:
            break
        level = (share[0] * total - int(full or 0), int(rest))
        if level == (num, den):
            break
        num, den = level
    # at the last level no further target reaches its stop
    target = F.when(over, (F.col("source_size") * most).cast("double")).otherwise(
        F.col("weight") * F.lit(float(num)) / F.lit(float(den * share[1]))
    )
    return ranked.withColumn("target", target)


def _running(df: DataFrame, buckets_bits: int) -> DataFrame:
    """Add `before`: words queued by the same source before a row, in the order of (key, doc_id, size)."""
    df = df.withColumn("_b", F.shiftright("key", 64 - buckets_bits) if buckets_bits else F.lit(0).cast("long"))
    sums = df.groupBy("place", "_b").agg(F.sum(F.col("size") * F.col("n")).alias("_sum"))
    earlier = Window.partitionBy("place").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("place", "_b", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("place", "_b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    return df.join(carried, ["place", "_b"]).withColumn("before", F.col("_carried") + F.col("_inside")).drop("_b", "_inside", "_carried")


def _key(seed: int, *columns: str) -> Column:
    """A hash of the columns, in which null differs from everything else."""
    parts = [x for c in columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *parts)


def _end_of_budget(queue: DataFrame, budget: int) -> tuple[float, int, int]:
    """(finish, place, end) of the last entry that is taken when entries go in that order while the budget lasts."""
    spark = queue.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), queue.count() // 1_000_000 + 1)
    order = ["finish", "place", "end"]
    queue = cut_table(queue.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    # a row for each part of the sort
    sums = queue.groupBy("_part").agg(F.sum("size").alias("_sum"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_upto", F.sum("_sum").over(upto))
    last = sums.where(F.col("_upto") > F.lit(budget)).orderBy("_part").select("_part", (F.col("_upto") - F.col("_sum")).alias("b")).first()
    if last is None:
        return (float("inf"), 0, 0)
    within = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = queue.where(F.col("_part") == last["_part"]).withColumn("_upto", F.sum("size").over(within) + last["b"])
    taken = inside.where(F.col("_upto") <= F.lit(budget)).orderBy(*[F.desc(c) for c in order]).select(*order).first()
    if taken is None:  # the budget ends with the part before
        taken = queue.where(F.col("_part") < last["_part"]).orderBy(*[F.desc(c) for c in order]).select(*order).first()
    return tuple(taken) if taken else (-1.0, 0, 0)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, key, size, source_size, target, copies, taken: a row for each row.

    copies: how often the mix has the document; taken: copies * size. key: the hash of id and text that shuffles.
    """
    sized = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        _key(seed, doc_id, source, text).alias("key"),
        n_words(F.col(f"`{text}`")).alias("size"),
    )
    sized = cut_table(sized)
    by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    by_source = cut_table(by_source.select("source", "source_size", "place", "target"))
    bits = min(MOST_BUCKET_BITS, int(sized.count() // ROWS_OF_BUCKET).bit_length())
    # equal rows are one entry with a count
    entries = sized.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("n"))
    same = F.expr("s.source <=> t.source")
    entries = entries.alias("s").join(by_source.alias("t"), same).select("s.*", "t.source_size", "t.place", "t.target")
    entries = cut_table(_running(entries, bits))
    rounds = F.sequence(F.lit(0), F.lit(most - 1))
    queue = entries.where("size > 0 AND target > 0").select("place", "size", "source_size", "target", "before", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    queue = queue.withColumn("round", F.explode(rounds))
    end = F.col("before") + F.col("i") * F.col("size") + F.col("round") * F.col("source_size")
    queue = queue.select("place", "size", end.alias("end"), (end / F.col("target")).alias("finish"))
    budget = int(by_source.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0) * share[0] // share[1]
    last = _end_of_budget(queue, budget)
    # each of n equal rows: one round is taken whole or not, so the count follows from its own ends
    rows = entries.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies: Column = F.lit(0)
    for k in range(most):
        end = F.col("before") + F.col("i") * F.col("size") + k * F.col("source_size")
        mark = F.struct((end / F.col("target")).alias("finish"), F.col("place"), end.alias("end"))
        bound = F.struct(
            F.lit(float(last[0])).alias("finish"), F.lit(int(last[1])).cast("long").alias("place"), F.lit(int(last[2])).cast("long").alias("end")
        )
        copies = copies + F.when(mark <= bound, 1).otherwise(0)
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), copies).otherwise(0).cast("long")
    rows = rows.withColumn("copies", copies)
    return rows.select(
        "doc_id", "source", "key", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixture(
    docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it was taken."""
    key = _key(seed, doc_id, source, text)
    # rows that are equal in id, source and text stand for each other
    times = mixed.where("copies > 0").groupBy("key").agg(F.sum("copies").alias("_copies"))
    one = docs.withColumn("_key", key).dropDuplicates(["_key"])
    out = one.join(times, one["_key"] == times["key"]).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
