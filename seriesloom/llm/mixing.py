"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source gets a target number of words: its share of the budget (all words there are) by weight, at most
``max_repeat`` times what it has; what is above that goes to the others by weight, until none is above (water filling,
solved in closed form over the table of sources). The documents of a source are shuffled by a hash of their id. The
e-th copy of a document finishes at the virtual time ``(e * source_size + words up to and with it) / target``. All
copies are put in order of that time and cut off where their sizes reach the budget.

Neither order needs one task to see all rows. A source's running sum is taken in two steps: sums over 4096 slots of the
shuffle hash, then inside a slot; so a source with a third of all rows is spread over 4096 keys. The global order is
range-partitioned into time slots likewise: the slot in which the budget is reached is found from slot sums, and is cut into
slots again until it has few rows (or one finish time), which alone are sorted. The driver sees 4096 sums at a time.

The order is cut off at the first finish time whose copies don't fit. A document of more words than are left then ends the
mix, so where single documents are as large as targets, sources may get less than their target (never more than a document more).

Defined results: a null text has size 0; a null source is a source of its own, the last; documents of size 0 are never
taken; documents with equal ids have the same place in the shuffle and are taken or left together when their finish
times agree; a text of any length is one document, never cut; an empty table gives an empty result; other columns of the input, of any
name, are ignored by :func:`mix_table` and kept by :func:`mix`, whose own column has underscores added to ``copies`` if the input has that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import SPACED_WORD, columns_of, materialize, whole_row

#: Slots of a source's shuffle order (three hex digits of the hash) and of a unit of virtual time.
TIME_SLOTS = 4096
#: Virtual time in which the first slots lie, with all beyond in the last; copies of a slot that are sorted in one task.
HORIZON, SORTED = 4.0, 20_000
#: The table of sources is broadcast up to so many rows and joined by shuffling beyond.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")))


def targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """From (source, source_size) to (source, source_size, target)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * max_repeat
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighed.withColumn("ratio", cap / F.col("weight")).select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
        F.row_number().over(by_ratio).alias("place"),
    )
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(everything)
    return levels.withColumn("level", level).select("source", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def joined_by_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """df with the columns of sources, joined null-safely."""
    if sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    right = sources.withColumnRenamed("source", "_source")
    return df.join(right, df["source"].eqNullSafe(right["_source"]), "left").drop("_source")


def mix_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, shuffle_key."""
    narrow = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), shuffle_key(F.col(id_col), seed).alias("shuffle_key")).withColumn("slot", F.conv(F.substring("shuffle_key", 1, 3), 16, 10).cast("int")))
    slots = narrow.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    sizes = slots.groupBy("source").agg(F.sum("slot_size").alias("source_size"))
    sources = materialize(targets(sizes, weights, max_repeat))
    before = slots.withColumn("before", F.sum("slot_size").over(Window.partitionBy("source").orderBy("slot")) - F.col("slot_size")).select(F.col("source").alias("_source"), F.col("slot").alias("_slot"), "before")
    inside = narrow.withColumn("inside", F.sum("size").over(Window.partitionBy("source", "slot").orderBy("shuffle_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = inside.join(before, inside["source"].eqNullSafe(before["_source"]) & (inside["slot"] == before["_slot"])).select("doc_id", "source", "size", "shuffle_key", (F.col("before") + F.col("inside")).alias("upto"))
    placed = materialize(joined_by_source(placed, sources))
    cut = cut_time(placed, max_repeat)
    copies = sum((F.when((F.col("size") > 0) & (finish(e) <= cut), 1).otherwise(0) for e in range(max_repeat)), F.lit(0))
    return placed.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies", "shuffle_key")


def finish(e: int | Column) -> Column:
    """The virtual finish time of a document's e-th copy."""
    return ((e if isinstance(e, Column) else F.lit(e)) * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")


def cut_time(placed: DataFrame, max_repeat: int) -> float:
    """The last finish time up to which all copies fit in the budget; the driver gets the sums of one round of slots at a time."""
    copies = placed.filter((F.col("size") > 0) & (F.col("target") > 0)).select("size", F.explode(F.array(*(finish(e) for e in range(max_repeat)))).alias("finish"))
    left, low, high, last = placed.agg(F.sum("size")).first()[0] or 0, 0.0, HORIZON, float("-inf")
    while True:
        slot = F.least(F.floor((F.col("finish") - low) * (TIME_SLOTS / (high - low))), F.lit(TIME_SLOTS - 1))
        sums = sorted(copies.groupBy(slot.alias("slot")).agg(F.sum("size"), F.count("*"), F.min("finish"), F.max("finish")).collect())
        for _, size, n, first, end in sums:
            if size > left:
                break
            left, last = left - size, end
        else:
            return float("inf")
        copies = copies.filter(F.col("finish").between(first, end))
        if first == end:
            return last
        if n <= SORTED:
            fits = copies.withColumn("upto", F.sum("size").over(Window.orderBy("finish"))).filter(F.col("upto") <= left).agg(F.max("finish")).first()[0]
            return last if fits is None else fits
        low, high = first, end


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, seed: int = 0) -> DataFrame:
    """The documents of the mix, with all their columns and ``copies``, how often each is taken.

    A source's documents are taken in shuffle order, so its part of the mix is a number of whole rounds and a last key:
    that small table is joined to the documents, and their texts are never shuffled.
    """
    decided = mix_table(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, max_repeat=max_repeat, seed=seed)
    most = decided.filter("size > 0").groupBy("source").agg(F.max(F.struct("copies", "shuffle_key")).alias("last"))
    most = materialize(most.select("source", F.col("last.copies").alias("most"), F.col("last.shuffle_key").alias("last_key")))
    rows = docs.select(whole_row(docs), F.col(source_col).alias("source"), shuffle_key(F.col(id_col), seed).alias("key"), n_words(F.col(text_col)).alias("size"))
    rounds = F.when(F.col("key") <= F.col("last_key"), F.col("most")).otherwise(F.col("most") - 1)
    name = "copies"
    while name in docs.columns:
        name += "_"
    return joined_by_source(rows, most).filter((rounds > 0) & (F.col("size") > 0)).select(*columns_of(docs), rounds.alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    from seriesloom.llm.common import table

    return mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH narrow AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, 'null') || ':0') AS k FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM narrow GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM sizes),
ratios AS (SELECT *, 3 * source_size / w AS ratio FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place FROM ratios),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY place LIMIT 1),
sources AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM chosen) * w) AS target FROM levels),
placed AS (SELECT n.doc_id, n.size, s.source_size, s.target, sum(n.size) OVER (PARTITION BY n.source ORDER BY n.k) AS upto FROM narrow n JOIN sources s ON n.source IS NOT DISTINCT FROM s.source),
copies AS (SELECT size, (e * source_size + upto)::DOUBLE / target AS finish FROM placed, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0 AND target > 0),
ordered AS (SELECT finish, sum(size) OVER (ORDER BY finish) AS total FROM copies),
cut AS (SELECT max(finish) AS c FROM ordered WHERE total <= (SELECT sum(size) FROM narrow))
SELECT doc_id, size, source_size, target, (CASE WHEN size = 0 OR target = 0 THEN 0 ELSE size * ((upto::DOUBLE / target <= (SELECT c FROM cut))::INT + ((source_size + upto)::DOUBLE / target <= (SELECT c FROM cut))::INT + ((2 * source_size + upto)::DOUBLE / target <= (SELECT c FROM cut))::INT) END)::BIGINT AS taken
FROM placed
"""
