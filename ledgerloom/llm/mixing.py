"""Mixing sources to target weights by weighted fair queueing, in native windows.

Every source is a queue of its documents in hashed (shuffled) order, sent up to
``repeats`` times. Serving one document takes its words divided by the source's
target, so at virtual time 1 every source has sent its target. Each copy of a
document gets a virtual time: the words its source has sent by then divided by
the target, counted to the middle of the copy, so that a cut rounds a source to
the nearest document and not always down. Copies are taken in the order of
virtual time until the budget of words is reached.

The cut is found without a global sort in one place: words are summed in cells
of virtual time, the cell in which the budget ends is divided once more, and
only the copies of that last sliver are ordered. The driver sees one cell number
each time and the last copy taken.

A source's running sum uses hash-range buckets (``ranks``), so a source with a
third of all rows is many small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import ranks

CELLS = 4096
_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(src, source_size, target) of each source; one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. A target above
    ``repeats`` times the source is cut there and the excess shared by weight
    among the others: with sources ordered by that bound per weight, the cut ones
    are the first ones, and the level of the others follows from what is left.
    """
    every = sized.groupBy("src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    every = every.select("src", "source_size", pick.cast("long").alias("weight"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    whole = Window.partitionBy()
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum(F.col("source_size") * repeats).over(before), F.lit(0)),
        "share": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    fits = exact("source_size") * repeats * exact("share") >= exact("weight") * exact("left")
    level = F.max(F.when(fits, F.struct((-F.col("place")).alias("first"), (F.col("left").cast("double") / F.col("share")).alias("level")))).over(whole)
    every = every.withColumn("place", F.row_number().over(order)).withColumn("cut", level)
    bound = (F.col("source_size") * repeats).cast("double")
    target = F.when(F.col("place") < -F.col("cut.first"), bound).otherwise(F.least(bound, F.col("weight") * F.col("cut.level")))
    return every.select("src", "source_size", target.alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``_row``, all columns of ``docs``, and ``_q``, what the queue needs; a null source is a source of its own."""
    source = F.col(source_col).cast("string")
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.struct(
            F.col(id_col).alias("id"), source.alias("source"), word_count(F.col(text_col)).alias("size"),
            F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("src"),
            F.conv(F.substring(key, 1, _BITS // 4), 16, 10).cast("long").alias("h"),
            F.coalesce(F.md5(F.col(text_col)), F.lit("")).alias("tie"),
        ).alias("_q"),
    )


def _queued(rows: DataFrame, targets: DataFrame, repeats: int) -> DataFrame:
    """Adds ``_times``: the virtual time of each copy of a row with words."""
    rows = rows.withColumns({"_src": F.col("_q.src"), "_bucket": F.shiftright(F.col("_q.h"), _BITS - 10).cast("int")})
    rows = ranks.with_offset(rows, ["_src"], "_bucket", F.col("_q.size"), "_before")
    inside = Window.partitionBy("_src", "_bucket").orderBy("_q.h", F.col("_q.id"), "_q.size", "_q.tie")
    sent = F.col("_before") + F.sum("_q.size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_sent", sent.cast("long")).join(targets.withColumnRenamed("src", "_src"), "_src")
    middle = lambda e: (2 * (F.col("_sent") + e * F.col("source_size")) - F.col("_q.size")) / (2 * F.col("target"))
    times = F.when((F.col("_q.size") > 0) & (F.col("target") > 0), F.array(*[middle(e) for e in range(repeats)]))
    return rows.withColumn("_times", times).drop("_sent", "_before", "_bucket", "_src")


_ORDER = ("time", "src", "h", "id", "size", "tie", "copy")


def _cut(queue: DataFrame, budget: int) -> dict | None:
    """The last copy taken within ``budget`` words, as its place in the order."""
    copies = queue.select(F.posexplode("_times").alias("copy", "time"), F.col("_q.*"))
    low, width, spent = 0.0, 1.0 / CELLS, 0
    cell = F.when(F.col("time") < 2, F.floor(F.col("time") * CELLS)).otherwise(2 * CELLS + F.floor(F.log2(F.greatest("time", F.lit(2.0))) * CELLS))
    for step in range(2):
        sums = copies.groupBy(cell.alias("cell")).agg(F.sum("size").alias("n"), F.min("time").alias("low"), F.max("time").alias("high"))
        upto = F.sum("n").over(Window.orderBy("cell"))
        last = sums.select("*", upto.alias("upto")).filter(F.col("upto") + spent > budget).orderBy("cell").limit(1).first()
        if last is None:
            break
        spent += last["upto"] - last["n"]
        copies = copies.filter(F.col("time").between(last["low"], last["high"]))
        low, width = last["low"], (last["high"] - last["low"]) / CELLS or 1.0
        cell = F.floor((F.col("time") - F.lit(low)) / F.lit(width))
        edge = last["low"]
    else:
        here = copies.select("*", (F.sum("size").over(Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)) + spent).alias("upto"))
        taken = here.filter(F.col("upto") <= budget).orderBy(*[F.col(c).desc() for c in _ORDER]).limit(1).first()
        return taken.asDict() if taken else {"time": edge}
    return None


def _taken(cut: dict | None, id_kind: str) -> Column:
    """Copies of the row that are not after the cut."""
    kinds = dict(zip(_ORDER, ("double", "string", "long", id_kind, "long", "string", "int"), strict=True))

    if cut is None:
        return F.coalesce(F.size("_times"), F.lit(0))

    def upto(time: Column, copy: Column) -> Column:
        if "src" not in cut:
            return time < cut["time"]
        mine = {"time": time, "copy": copy} | {c: F.col(f"_q.{c}") for c in ("src", "h", "id", "size", "tie")}
        last = F.struct(*[F.lit(cut[c]).cast(kinds[c]).alias(c) for c in _ORDER])
        return F.struct(*[mine[c].alias(c) for c in _ORDER]) <= last

    return F.coalesce(F.size(F.filter("_times", lambda t, i: upto(t, i))), F.lit(0))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, id_col: str = "doc_id",
    text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` columns (all by default) of every row and ``size``, ``source_size``, ``target``, ``copies``.

    ``copies`` says how often the mix takes the row, 0 to ``repeats``. The budget
    is the words of all rows. A null text has no words and is never taken; a null
    source is one source, the last one; a null id is a defined place in the shuffle.
    Repeated rows each have their own place. A kept column named like one of the four
    added ones is replaced. An empty table gives an empty result.
    """
    keep = docs.columns if keep is None else keep
    rows = _sized(docs, id_col, text_col, source_col)
    stats = durable(rows.select("_q"))
    targets = durable(source_targets(stats.select("_q.*"), weights, repeats))
    budget = stats.agg(F.sum("_q.size")).first()[0] or 0
    queue = durable(_queued(stats, targets, repeats))
    kind = stats.select("_q.id").schema[0].dataType.simpleString()
    taken = _taken(_cut(queue, budget), kind)
    small = set(keep) <= {id_col}
    full = queue if small else _queued(rows, targets, repeats)
    keep = [c for c in keep if c not in ("size", "source_size", "target", "copies")]
    mine = [F.col("_q.id").alias(c) if small else F.col("_row")[c].alias(c) for c in keep]
    return full.select(*mine, F.col("_q.size").alias("size"), "source_size", "target", taken.alias("copies"))
