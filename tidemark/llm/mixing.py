"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, table

#: A block of a source's documents has about this many rows at least; larger inputs have blocks of about the
#: square root of their rows, so that neither a block nor a source's list of blocks grows beyond that root.
LEAST_BLOCK = 512


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of sources (source, source_size), one row each.

    The sources, by code point and null last, weigh ``weights`` in turn and share ``share`` times all sizes. No
    target exceeds ``most`` times its source's size; the excess is shared again by weight until none does. That
    fixed point gives each source min(most * size, level * weight), and the level is found by taking sources in
    the order in which a rising level fills them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    level = (F.col("total") * share - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        sources.withColumn("weight", w)
        .withColumn("fill", F.col("source_size") * most / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(every))  # rises up to the last filled source, then falls
        .select("source", "source_size", "weight", F.least(F.col("source_size") * most, F.col("level") * F.col("weight")).alias("target"))
    )


#: What names a row: its id and source, and both hashes of its text.
_KEY = ["hash", "more", "doc_id", "source"]


def _named(doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("more"), doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source")]


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of docs.

    A document's size is its number of words (0 for a null text). Each document of a source is expected
    target / source_size times. Documents are set in a fixed order within their source (by size class, block,
    size, doc_id), the expected copies are prefix-summed, one offset in [0, 1) drawn from the seed and the
    source is added, and a document is emitted once for each integer that its stretch crosses. Sorting by size
    spreads the draw over all sizes, so the taken words come near the target. Since ``most`` bounds the
    expectation, no document is taken more than ceil(most) times.

    The prefix sums are in two levels, blocks and rows within a block, so no source is gathered in one task.
    A row's block follows from a digest of its id and text, so ids of any pattern, or none, fill blocks evenly.
    Null sources form one source, the last; null ids come first in a block; rows with equal id and size
    are interchangeable. An empty table gives an empty result. A source without words has target 0.
    """
    return _mix(docs, weights, share, most, seed).drop("hash", "more")


def _mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    rows = docs.select(*_named(F.col("doc_id"), F.col("source"), F.col("text")), size.alias("size"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("draw"))
    bits = F.length(F.bin("size"))
    lead = F.when(bits >= 3, F.expr("shiftright(size, length(bin(size)) - 3)") - 4).otherwise(F.lit(0))
    rows = cut(rows.withColumn("class", (bits * 4 + lead).cast("int")))

    per_class = cut(rows.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    every = per_class.agg(F.sum("n").alias("all"))
    blocks = per_class.crossJoin(F.broadcast(every)).select(  # one row: the total
        F.col("source").alias("s"), F.col("class").alias("c"), F.ceil(F.col("n") / F.greatest(F.lit(float(LEAST_BLOCK)), F.floor(F.sqrt("all")).cast("double"))).alias("n_blocks")
    )
    targets = source_targets(per_class.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)

    rows = rows.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select(*_KEY, "size", "class", (F.col("draw") % F.col("n_blocks")).alias("block"))
    per_block = rows.groupBy("source", "class", "block").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("class", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("offset")
    starts = per_block.withColumn("ahead", ahead).join(
        targets.select(F.col("source").alias("t"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate")), F.col("source").eqNullSafe(F.col("t"))
    ).select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("block").alias("b"), "ahead", "source_size", "target", "rate", offset)

    here = F.row_number().over(Window.partitionBy("source", "class", "block").orderBy("size", "doc_id"))
    upto = lambda k: F.floor(F.col("rate") * k + F.col("offset"))
    return (
        rows.withColumn("row", here)
        .join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")) & (F.col("block") == F.col("b")))
        .withColumn("row", F.col("row") + F.col("ahead"))
        .withColumn("copies", (upto(F.col("row")) - upto(F.col("row") - 1)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "hash", "more")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as ``mix`` takes it, 0 times or more; copies are equal rows.

    Rows with equal id, source and text share the copies that ``mix`` gives them, as evenly as can be. Other columns
    stay, whatever their names; an empty table gives an empty one.
    """
    taken = cut(_mix(docs, **options).groupBy(*_KEY).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies")).where("copies > 0"))
    taken = taken.select(*(F.col(c).alias(f"t_{c}") for c in taken.columns))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row).select("row", *_named(F.col("row.doc_id"), F.col("row.source"), F.col("row.text")))
    same = (F.col("hash") == F.col("t_hash")) & (F.col("more") == F.col("t_more")) & F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & F.col("source").eqNullSafe(F.col("t_source"))
    once = own.join(taken.where("t_rows = 1"), same).select("row", F.col("t_copies").alias("copies"))
    turn = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.to_json("row")))
    again = own.join(taken.where("t_rows > 1"), same).withColumn("turn", turn)
    shared = F.expr("t_copies div t_rows") + (F.col("turn") <= F.col("t_copies") % F.col("t_rows")).cast("long")
    every = once.unionByName(again.select("row", shared.alias("copies"))).where("copies > 0")
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and source of all documents, weights 5, 2, 1 and 150 %."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {
    "op7_mixing": rf"""
with d as (select doc_id, source, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 8))::bigint as draw, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
e as (select *, length(bin(size)) * 4 + case when length(bin(size)) >= 3 then (size >> (length(bin(size)) - 3)) - 4 else 0 end as class from d),
c as (select source, class, count(*) as n, sum(size) as size from e group by all),
b as (select source, class, ceil(n / greatest({LEAST_BLOCK}, floor(sqrt((select count(*) from d)))))::bigint as n_blocks from c),
s as (select source, sum(size)::bigint as source_size from c group by source),
w as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
f as (select *, source_size * 2.0::double / weight as fill from w),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(source_size * 2.0::double) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as level from f),
m as (select max(level) as level from l),
t as (select source, source_size, least(source_size * 2.0::double, m.level * weight) as target from l, m),
r as (select doc_id, e.source, size, source_size, target,
  row_number() over (partition by e.source order by e.class, draw % n_blocks, size, doc_id nulls first) as k
  from e join b on e.source is not distinct from b.source and e.class = b.class join t on e.source is not distinct from t.source),
x as (select *, case when source_size > 0 then target / source_size else 0 end as rate, ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::bigint / 4294967296.0::double as u from r),
y as (select *, (floor(rate * k + u) - floor(rate * (k - 1) + u))::bigint as copies from x)
select doc_id, size, source_size, target, copies * size as taken, copies, source from y
"""
}
