"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling, in DataFrame operations alone.

Each source is cut into blocks of rows. With integer weights ``w`` that add up to ``W``, block ``j`` (from 0) of a
source may start at its release ``floor(j * W / w)`` and must be out by its deadline ``ceil((j + 1) * W / w)``; one
block goes out in each slot, the released one with the earliest deadline. The schedule repeats every ``W`` slots, so it
is worked out once for ``W`` slots, by a fold in SQL, and joined to the blocks. After any number of slots each source
is less than one block from its share. Every row is kept, once: slots of a source that has run out stay empty, which
leaves the shares of the others to one another as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
#: What the default weights add up to, about (each source has one at least).
QUANTUM = 1000
#: Exponent of a source's share of rows in the default weights: below 1, small sources gain.
TEMPER = 0.5
#: Most sources that can be mixed; more are an error, not a slower plan.
MAX_SOURCES = 4096
#: Most that given weights may add up to: the length of the schedule.
MAX_SLOTS = 65_536
#: Hex digits that name the parts that each source's rows are numbered in, so that a large source is not one task's work.
PART_DIGITS = 3

_FOLD = """
aggregate(
  sequence(0, total - 1),
  named_struct('next', array_repeat(0L, size(ws)), 'slots', cast(array() as array<struct<i:int,k:bigint,release:bigint,deadline:bigint>>)),
  (acc, t) -> element_at(transform(
    array(array_min(transform(
      filter(sequence(0, size(ws) - 1), i -> acc.next[i] < ws[i] and acc.next[i] * total div ws[i] <= t),
      i -> struct(((acc.next[i] + 1) * total + ws[i] - 1) div ws[i] as deadline, i as i, acc.next[i] as k, acc.next[i] * total div ws[i] as release)
    ))),
    best -> named_struct(
      'next', transform(acc.next, (n, i) -> if(i = best.i, n + 1, n)),
      'slots', concat(acc.slots, array(named_struct('i', best.i, 'k', best.k, 'release', best.release, 'deadline', best.deadline)))
    )
  ), 1),
  acc -> acc.slots
)
"""


def _key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def default_weights(docs: DataFrame, source_col: str = "source", quantum: int = QUANTUM, temper: float = TEMPER) -> DataFrame:
    """``(key, w)`` of every source: integers of at least one, in proportion to its rows to the power ``temper``."""
    sizes = docs.groupBy(_key(F.col(source_col)).alias("key")).agg(F.pow(F.count("*").cast("double"), F.lit(temper)).alias("x"))
    one = _in_one_row(sizes, "key", "x").withColumn("all_x", F.expr("aggregate(s.x, 0D, (a, x) -> a + x)"))
    return one.select("all_x", F.inline("s")).select("key", F.greatest(F.lit(1), F.round(F.lit(quantum) * F.col("x") / F.col("all_x"))).cast("long").alias("w"))


def _in_one_row(table: DataFrame, *columns: str) -> DataFrame:
    """The rows of a table of sources as one sorted array ``s``; the check of their number bounds all that is broadcast."""
    one = table.groupBy().agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("s"))
    return one.withColumn("s", F.when(F.size("s") > MAX_SOURCES, F.raise_error(F.lit(f"more than {MAX_SOURCES} sources: group them first"))).otherwise(F.col("s")))


def schedule(weights: DataFrame) -> DataFrame:
    """``(key, w, total, k, slot, release, deadline)``: one row a slot of the repeating schedule, ``total`` of them."""
    one = _in_one_row(weights, "key", "w").select(
        F.col("s.key").alias("keys"), F.col("s.w").alias("ws"), F.expr("aggregate(s.w, 0L, (a, w) -> a + w)").alias("total")
    )
    slots = one.where("total > 0").select("keys", "ws", "total", F.posexplode(F.expr(_FOLD)).alias("slot", "x"))
    return slots.select(
        F.expr("keys[x.i]").alias("key"), F.expr("ws[x.i]").alias("w"), "total", F.col("x.k").alias("k"), F.col("slot").cast("long").alias("slot"), "x.release", "x.deadline"
    )


def ranked(docs: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``docs`` with ``_key`` and ``_rank``, the row's number in its source from 0, by the MD5 of the id as text.

    Parts are the leading digits of that hash, so numbers run on from part to part.
    """
    rows = docs.withColumn("_key", _key(F.col(source_col))).withColumn("_hash", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    rows = rows.withColumn("_part", F.substring("_hash", 1, PART_DIGITS))
    sizes = rows.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("_key", "_part").orderBy("_hash", F.col(id_col))
    return rows.withColumn("_own", F.row_number().over(own)).join(offsets, ["_key", "_part"]).withColumn("_rank", F.col("_offset") + F.col("_own") - 1)


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with struct ``mix``: block, place (in the block), slot, release, deadline. Order by slot and place.

    ``weights``: a positive integer for each source (sources it does not name get 1); default: ``default_weights``.
    A null source is a source of its own; rows that repeat an id are kept, in no fixed order among themselves; an
    empty table gives an empty table; other columns, of any name but ``mix`` (replaced), pass through unread.
    """
    if weights is None:
        table = default_weights(docs, source_col)
    else:
        if any(w < 1 for w in weights.values()) or sum(weights.values()) > MAX_SLOTS:
            raise ValueError(f"weights must be positive integers that add up to {MAX_SLOTS} at most")
        given = docs.sparkSession.createDataFrame([("null" if k is None else f"={k}", w) for k, w in weights.items()], "key string, w long")
        table = docs.select(_key(F.col(source_col)).alias("key")).distinct().join(F.broadcast(given), "key", "left").select("key", F.coalesce("w", F.lit(1)).alias("w"))
    names = [c for c in docs.columns if c != "mix"]
    inner = docs.select(F.struct(*names).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"))
    rows = ranked(inner, "_id", "_source").withColumn("_block", F.floor(F.col("_rank") / block_rows).cast("long"))
    # one row a unit of weight, and one a source
    plan = F.broadcast(schedule(table).select(*(F.col(c).alias(f"_{c}") for c in ("key", "w", "total", "k", "slot", "release", "deadline"))))
    of = F.broadcast(table.select(F.col("key").alias("_key"), F.col("w").alias("_own_w")))
    rows = rows.join(of, "_key").withColumn("_k", F.col("_block") % F.col("_own_w")).withColumn("_period", F.floor(F.col("_block") / F.col("_own_w")).cast("long"))
    late = F.col("_period") * F.col("_total")
    return rows.join(plan, ["_key", "_k"]).select(
        "_row.*",
        F.struct(
            F.col("_block").alias("block"),
            (F.col("_rank") % block_rows).cast("int").alias("place"),
            *((F.col(f"_{c}") + late).alias(c) for c in ("slot", "release", "deadline")),
        ).alias("mix"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows of ``mix`` in their order (range-partitioned and sorted), without the schedule."""
    return mixed.orderBy("mix.slot", "mix.place").drop("mix")


def oracle(block_rows: int = BLOCK_ROWS, quantum: int = QUANTUM) -> str:
    """DuckDB SQL of the schedule of ``documents`` with default weights."""
    return f"""
with recursive sizes as (select coalesce('=' || source, 'null') as key, count(*) as n from documents group by 1),
weights as (select key, cast(greatest(1, round({quantum}*sqrt(n)/(select sum(sqrt(n)) from sizes))) as bigint) as w from sizes),
one as (select list(key order by key) as keys, list(w order by key) as ws, cast(sum(w) as bigint) as total from weights),
-- earliest deadline among the released blocks; ties to the first key
choice(t, taken, pick) as (
  select cast(-1 as bigint), list_transform(ws, lambda w: cast(0 as bigint)), cast(0 as bigint) from one
  union all
  select t + 1, list_transform(taken, lambda n, j: n + cast(j = best as bigint)), best
  from (select t, taken, total, list_min(list_transform(
      list_filter(range(1, len(ws) + 1), lambda i: taken[i] < ws[i] and (taken[i]*total) // ws[i] <= t + 1),
      lambda i: (((taken[i] + 1)*total + ws[i] - 1) // ws[i])*100000 + i)) % 100000 as best
    from choice, one where t + 1 < total)
),
slots as (select keys[pick] as key, ws[pick] as w, total, t as slot, row_number() over (partition by pick order by t) - 1 as k from choice, one where t >= 0),
ranked as (select doc_id, source, coalesce('=' || source, 'null') as key,
  row_number() over (partition by source order by md5(coalesce(cast(doc_id as varchar), '')), doc_id) - 1 as r from documents)
select doc_id, source, r // {block_rows} as block, cast(r % {block_rows} as integer) as place,
  slot + ((r // {block_rows}) // w)*total as slot, (k*total) // w + ((r // {block_rows}) // w)*total as release,
  ((k + 1)*total + w - 1) // w + ((r // {block_rows}) // w)*total as deadline
from ranked join slots on slots.key = ranked.key and (r // {block_rows}) % w = k
"""
