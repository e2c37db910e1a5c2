"""Point-in-time features from a dyadic time tree.

What happened counts for a question at time t during one interval [lo, hi) of
times: from when it had happened and had been seen, until its window has
passed. Every interval is split into canonical nodes of a tree over time, kept
for each client; the values of equal (client, node) are added up, each question
is exploded to the ancestors of its time, the two meet in an equi-join, and the
nodes of a question are added up. No pair of an event and a question is formed.

The tree is walked down in steps of STEP levels. A block of 2^TOP microseconds
(51 days) has 64 children, a child is the block of the next step, down to single
microseconds. A (client, block) row says in 64 bits which children hold
questions; the dyadic nodes lie over those, so the many empty stretches of a
client's time make no nodes. An interval that takes in all questions of a block
is the block's root, one that takes in none is gone, and only its two ragged
ends go on to the next step, as long as they cut through the questions of a
child. The steps end as soon as no block has two different times (five steps
for times in whole seconds), and their rows shrink quickly. All joins are on
(client, block) or (client, node) with one row of a key on one side, so AQE can
split a hot client's other side; sums are combined before each shuffle; nothing
goes to the driver but whether there is a next step.

Items are distinct over nodes: of an item's lines, each brings in only the part
of its interval that no earlier line of the client and item covers. These parts
are disjoint, so an item lies on one node at most of any question's path and
counts may be added. The parts come from running maxima in blocks of 2^SPLIT
microseconds (5 hours) and over the maxima of earlier blocks, after equal lines
were added up, so no window gathers a hot client's hot item.

Defined cases: rows without a client or a needed time never count, and a sale
without a client or a time of sale asks nothing; null, infinite and not-a-number
amounts count 0 cents; fully equal clicks count once, equal sales and lines each
time (the lines of a repeated sale count for each); a null click id is the
smallest of its time; a question that nothing counts for has zeros and no last
click; empty tables give no rows, or zeros.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from ._store import store

TOP, STEP, SPLIT = 42, 6, 34
WINDOWS, HORIZON, LATE_MINUTES = (2, 14), 7, 240
DAY, MINUTE = 86_400_000_000, 60_000_000
COUNTED = ["n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"]


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a timestamp; one without a zone is read as UTC, whatever the session's zone."""
    c = F.col(name)
    if not isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z"):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def cents(amount: Column) -> Column:
    """floor(100 x + 0.5) as a whole number; what is null or not finite is 0."""
    x = F.floor(amount.cast("double") * 100 + 0.5)
    return F.when(F.abs(amount.cast("double")) < 9e15, x).otherwise(F.lit(0)).cast("long")


def _bit(child: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), child.cast("int"))


def _below(bits: Column, child: Column) -> Column:
    """How many of the children before this one (0 to 64) hold questions."""
    higher = F.call_function("shiftleft", F.lit(-1).cast("long"), child.cast("int"))
    return F.when(child >= 64, F.bit_count(bits)).otherwise(F.bit_count(bits.bitwiseAND(F.bitwise_not(higher))))


def _nodes(left: Column, right: Column) -> list[Column]:
    """The canonical nodes of ranks [left, right) in heap order (root 1, leaves 64 to 127), null where a level has none."""
    out = []
    for j in range(STEP):
        a, b = F.shiftright(left + ((1 << j) - 1), j), F.shiftright(right, j)
        out += [F.when((a < b) & (a % 2 == 1), a + (64 >> j)), F.when((a < b) & (b % 2 == 1), b + ((64 >> j) - 1))]
    return out


def _split(pieces: DataFrame, blocks: DataFrame, shift: int, values: Sequence[str]) -> DataFrame:
    """Pieces of (key, w, block, lo, hi) to nodes of their block (lo and hi null) and, as node 0, to pieces of its children."""
    child = shift - STEP
    size = F.lit(1 << child).cast("long")
    joined = pieces.join(blocks, ["key", "block"]).where((F.col("lo") <= F.col("last")) & (F.col("hi") > F.col("first")))
    start = F.shiftleft(F.col("block"), shift)
    joined = joined.withColumns({"x": F.col("lo") - start, "y": F.col("hi") - start, "all": (F.col("lo") <= F.col("first")) & (F.col("hi") > F.col("last"))})
    joined = joined.withColumns({"a": F.shiftright(F.col("x") + (size - 1), child), "b": F.shiftright(F.col("y"), child)})
    joined = joined.withColumns({"l": _below(F.col("bits"), F.col("a")), "r": _below(F.col("bits"), F.col("b"))})
    none = F.lit(None).cast("long")
    found = [F.when(F.col("all"), F.struct(F.lit(1).alias("node"), F.col("block").alias("at"), none.alias("from"), none.alias("to")))]
    for node in _nodes(F.col("l"), F.col("r")):
        found.append(F.when(~F.col("all") & node.isNotNull(), F.struct(node.cast("int").alias("node"), F.col("block").alias("at"), none.alias("from"), none.alias("to"))))

    def ragged(when: Column, c: Column, lo: Column, hi: Column) -> Column:
        held = F.col("bits").bitwiseAND(_bit(c)) != 0
        return F.when(~F.col("all") & when & held, F.struct(F.lit(0).alias("node"), (F.shiftleft(F.col("block"), STEP) + c).alias("at"), lo.alias("from"), hi.alias("to")))

    if child > 0:
        a, b, lo, hi = F.col("a"), F.col("b"), F.col("lo"), F.col("hi")
        found.append(ragged(a > b, b, lo, hi))  # both ends in one child
        found.append(ragged((a <= b) & (F.col("x") % size != 0), a - 1, lo, start + a * size))
        found.append(ragged((a <= b) & (F.col("y") % size != 0), b, start + b * size, hi))
    return joined.select("key", "w", F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("s"), *values).select(
        "key", "w", F.col("s.node").alias("node"), F.col("s.at").alias("block"), F.col("s.from").alias("lo"), F.col("s.to").alias("hi"), *values
    )


def stab(intervals: DataFrame, probes: DataFrame, windows: Sequence[int], sums: Sequence[str], largest: Sequence[str] = ()) -> DataFrame:
    """For each (key, t) of probes that lies in an interval of its key: the sums and largest values over those intervals.

    intervals: key, w, lo, hi (whole numbers, lo included and hi not) and the
    value columns; probes: key and t. w tells kinds of intervals apart; the
    columns are named value_w. Rows with a null key or bound match nothing.
    """
    values = [*sums, *largest]
    added = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in largest]
    whole = intervals.where("lo < hi and key is not null").withColumn("block", F.explode(F.sequence(F.shiftright("lo", TOP), F.shiftright(F.col("hi") - 1, TOP))))
    begin = F.shiftleft(F.col("block"), TOP)
    pieces = whole.select("key", "w", "block", F.greatest("lo", begin).alias("lo"), F.least("hi", begin + (1 << TOP)).alias("hi"), *values)
    left = store(probes.where("key is not null and t is not null").select("key", "t").distinct(), "tree-probes").df
    nodes, paths = [], []
    for step in range(TOP // STEP):
        shift = TOP - STEP * step
        left = left.withColumn("block", F.shiftright("t", shift))
        inside = F.shiftright("t", shift - STEP).bitwiseAND(F.lit(63).cast("long"))
        blocks = store(left.groupBy("key", "block").agg(F.bit_or(_bit(inside)).alias("bits"), F.min("t").alias("first"), F.max("t").alias("last")), "tree-blocks").df
        held = left.join(blocks, ["key", "block"])
        leaf = F.lit(64) + _below(F.col("bits"), inside)
        path = F.when(F.col("first") == F.col("last"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), *[F.shiftright(leaf, j) for j in range(STEP)]))
        paths.append(held.select("key", "t", "block", F.explode(path).alias("node")).withColumn("node", F.col("node") + 128 * step))
        found = store(_split(pieces, blocks, shift, values).groupBy("key", "w", "node", "block", "lo", "hi").agg(*added), "tree-nodes").df
        nodes.append(found.where("node > 0").drop("lo", "hi").withColumn("node", F.col("node") + 128 * step))
        if not blocks.where("first < last").limit(1).count():
            break
        left = store(held.where("first < last").select("key", "t"), "tree-probes").df
        pieces = found.where("node = 0").drop("node")
    union = functools.partial(functools.reduce, DataFrame.unionByName)
    met = union(paths).join(union(nodes), ["key", "block", "node"])
    pick = lambda c, w: F.when(F.col("w") == w, F.col(c))
    out = [F.sum(pick(c, w)).alias(f"{c}_{w}") for w in windows for c in sums] + [F.max(pick(c, w)).alias(f"{c}_{w}") for w in windows for c in largest]
    return met.groupBy("key", "t").agg(*out)


def _fresh_lines(lines: DataFrame) -> DataFrame:
    """Adds to (key, item, lo, sold, ...) the latest sale time of earlier rows of the same key and item, as `before`."""
    some = lines.where("item is not null").withColumn("part", F.shiftright("lo", SPLIT))
    per_part = some.groupBy("key", "item", "part").agg(F.max("sold").alias("latest"))
    earlier = Window.partitionBy("key", "item").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("key", "item", "part", F.max("latest").over(earlier).alias("earlier"))
    inside = Window.partitionBy("key", "item", "part").orderBy("lo", F.desc("sold")).rowsBetween(Window.unboundedPreceding, -1)
    out = some.join(per_part, ["key", "item", "part"]).withColumn("before", F.greatest("earlier", F.max("sold").over(inside))).drop("part", "earlier")
    return out.unionByName(lines.where("item is null").withColumn("before", F.lit(None).cast("long")))


def _events(df: DataFrame, kinds: list[Column], filled: dict[str, Column], values: Sequence[str], last: str) -> DataFrame:
    """One row for each interval; values that are not named are 0."""
    fields = [filled.get(c, F.lit(0)).cast("long").alias(c) for c in values]
    rows = df.select("key", F.explode(F.filter(F.array(*kinds), lambda k: k["lo"] < k["hi"])).alias("k"), *[x for x in df.columns if x != "key"])
    return rows.select("key", F.col("k.w").alias("w"), F.col("k.lo").alias("lo"), F.col("k.hi").alias("hi"), *fields, filled.get(last, F.lit(None)).cast("decimal(38,0)").alias(last))


def _interval(w: int, lo: Column, hi: Column, **more: Column) -> Column:
    return F.struct(F.lit(w).alias("w"), lo.alias("lo"), hi.alias("hi"), *[c.alias(name) for name, c in more.items()])


def point_in_time(
    sales: DataFrame, clicks: DataFrame, lines: DataFrame, at: Column, *, windows: Sequence[int] = WINDOWS, horizon: int = HORIZON, late_minutes: int = LATE_MINUTES
) -> DataFrame:
    """sale_id, d, t_us, label and the features of every sale with a client and a time of sale, for each window d (days).

    at: the question's time in epoch microseconds, over sales (which has the added column `sold`, its time of sale).
    """
    late = late_minutes * MINUTE
    dated = sales.withColumns({"sold": micros(sales, "sold_at"), "seen": micros(sales, "arrived_at") + late}).where("client_id is not null and sold is not null")
    own = dated.select(F.col("client_id").alias("key"), "sale_id", "sold", "seen", cents(F.col("total")).alias("cents"), at.cast("long").alias("t"))
    probes = own.select("key", "t")

    seen_clicks = clicks.where("client_id is not null").distinct()
    place = F.coalesce(F.col("click_id").cast("decimal(20,0)") + F.lit("9223372036854775809").cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    span = F.lit("36893488147419103232").cast("decimal(20,0)")  # 2^65, above any place
    c = seen_clicks.select(F.col("client_id").alias("key"), micros(clicks, "ts").alias("ts"), (micros(clicks, "arrived_at") + late).alias("seen"), (F.col("kind") == "purchase").alias("bought"), cents(F.col("value")).alias("cents"), place.alias("place"))
    c = c.where("ts is not null and seen is not null")
    latest = (F.col("ts").cast("decimal(18,0)") * span + F.col("place")).cast("decimal(38,0)")
    values, last = [*COUNTED, "n_next"], "last_click"
    until = lambda start, w: F.col(start) + w * DAY
    events = _events(
        c, [_interval(w, F.greatest("ts", "seen"), until("ts", w)) for w in windows], {"n_clicks": F.lit(1), "n_purchases": F.coalesce(F.col("bought"), F.lit(False)).cast("int"), "click_cents": F.col("cents"), last: latest}, values, last
    )
    shown = own.where("seen is not null")
    events = events.unionByName(_events(shown, [_interval(w, F.greatest("sold", "seen"), until("sold", w)) for w in windows], {"n_sales": F.lit(1), "sale_cents": F.col("cents")}, values, last))
    events = events.unionByName(_events(own, [_interval(0, F.col("sold") - horizon * DAY, F.col("sold"))], {"n_next": F.lit(1)}, values, last))

    shipped = lines.select("sale_id", F.col("item_id").alias("item"), cents(F.col("amount")).alias("cents"), micros(lines, "shipped_at").alias("shipped")).where("sale_id is not null and shipped is not null")
    carried = shipped.join(shown.select("key", "sale_id", "sold", "seen"), "sale_id").select("key", "item", F.greatest("sold", "seen", "shipped").alias("lo"), "sold", "cents")
    summed = carried.where(F.col("lo") < until("sold", max(windows))).groupBy("key", "item", "lo", "sold").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    fresh = _fresh_lines(summed)
    kinds = []
    for w in windows:
        new = F.greatest(F.col("lo"), F.col("before") + w * DAY)  # without an earlier line: lo
        at_once = F.col("item").isNotNull() & (new == F.col("lo"))
        kinds.append(_interval(w, F.col("lo"), until("sold", w), line=F.lit(True), item=at_once))
        kinds.append(F.when(F.col("item").isNotNull() & ~at_once, _interval(w, new, until("sold", w), line=F.lit(False), item=F.lit(True))))
    line = F.col("k.line").cast("long")
    events = events.unionByName(_events(fresh, kinds, {"n_lines": line * F.col("n"), "line_cents": line * F.col("cents"), "n_items": F.col("k.item").cast("int")}, values, last))

    found = stab(events, probes, [*windows, 0], values, [last])
    met = own.select("sale_id", "key", "t").join(found, ["key", "t"], "left")
    of = lambda name, w: F.coalesce(F.col(f"{name}_{w}"), F.lit(0)).cast("long").alias(name)
    place = F.pmod(F.col("last_click"), span.cast("decimal(38,0)"))
    rows = [F.struct(F.lit(w).alias("d"), *[of(x, w) for x in COUNTED], F.col(f"{last}_{w}").alias(last)) for w in windows]
    out = met.select("sale_id", F.col("t").alias("t_us"), (F.coalesce(F.col("n_next_0"), F.lit(0)) > 0).alias("label"), F.explode(F.array(*rows)).alias("f")).select("sale_id", "t_us", "label", "f.*")
    last_id = F.when(place > 0, (place - F.lit("9223372036854775809").cast("decimal(20,0)")).cast("long"))
    return out.withColumn("last_click_id", last_id).select(
        "sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"
    )
