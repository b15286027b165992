"""Numeric band join by dyadic cover.

An interval of integers is cut into its canonical power-of-two nodes (two a level at most, disjoint, and together just the
interval); a point lies in one node of each level, its ancestors. An equi-join on the node so yields each pair of interval
and point exactly once (`pairs`).

Where all pairs would grow with the square of the input, their counts, sums and nearest points are wanted, not the pairs:
`summaries` first adds up equal points (nothing is lost: count, checksum, first lines), lets each distinct value emit its
ancestors, and keeps per node a summary that can be added up: count, sum, checksum, and the first points from either side.
Intervals are split at their centre, so that in each part distances have one sign: sums of distances follow from count and
sum, and the nearest points are the first of a side. Distinct intervals, not items, meet the nodes.

Pairs with an item's own lines don't count. Their counts and sums are taken off by a join on the item; of the first points a
summary keeps two for each of the three first items, which leaves two after any one item goes, and such summaries merge.

Every step is an aggregate that combines before its shuffle, a window that keeps its first rows before its shuffle, or a
sort-merge join that adaptive execution may split. Nothing is broadcast; the driver gets one number, the widest interval.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, quoted, table

#: Cents beyond this never pair, so that all products stay within a long.
MOST = 9_000_000_000_000_000
#: Levels that are emitted at once: a node then merges 2^AT_ONCE summaries at most, however wide intervals are.
AT_ONCE = 4
KEEP, ITEMS = 2, 3


def band(p: Column, absolute: int = 100, per_mille: int = 1) -> tuple[Column, Column]:
    """Ends of the u with |u - p| <= absolute or 1000 |u - p| <= per_mille * max(u, p)."""
    share, top = F.expr("0L"), p
    if per_mille:
        share = F.when(p > 0, _div(p * per_mille, F.lit(1000))).otherwise(0)
        top = F.when(p > 0, _div(p * 1000, F.lit(1000 - per_mille))).otherwise(p)
    return p - F.greatest(F.lit(absolute).cast("long"), share), F.greatest(p + absolute, top)


def _div(a: Column, b: Column) -> Column:
    """floor(a / b) in exact integers; b isn't 0."""
    x, y = F.when(b < 0, -a).otherwise(a), F.abs(b)
    return F.call_function("div", x - F.pmod(x, y), y)


def levels(width: int) -> int:
    """The highest level that a cover of so many values can use."""
    return max(width, 1).bit_length() - 1


def cover(lo: Column, hi: Column, top: int) -> Column:
    """Canonical nodes (level, node) of the values lo to hi, none if hi < lo; top: levels(hi - lo + 1) or more."""
    parts = []
    for k in range(top + 1):
        a, b = F.shiftright(lo + ((1 << k) - 1), k), F.shiftright(hi + 1, k)
        open_ = a < b
        parts.append(F.when(open_ & (F.pmod(a, F.lit(2)) == 1), F.struct(F.lit(k).alias("level"), a.alias("node"))))
        parts.append(F.when(open_ & (F.pmod(b, F.lit(2)) == 1), F.struct(F.lit(k).alias("level"), (b - 1).alias("node"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def ancestors(value: Column, top: int) -> Column:
    """The nodes (level, node) that hold a value, from level 0 to top."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(value, k).alias("node")) for k in range(top + 1)])


def pairs(intervals: DataFrame, points: DataFrame, lo: str = "lo", hi: str = "hi", value: str = "value") -> DataFrame:
    """All columns of intervals and of points (whose names differ) for each point within an interval, each pair once.

    Rows with a null bound or value pair with nothing; equal rows pair each for itself.
    """
    taken = [*intervals.columns, *points.columns]
    level, node = free_name(taken, "__level"), free_name(taken, "__node")
    width = intervals.agg(F.max(F.col(lo) * -1 + F.col(hi) + 1)).first()[0]
    top, at = levels(int(width or 1)), free_name(taken, "__at")
    one = lambda df, nodes: df.withColumn(at, F.explode(nodes)).withColumns({level: F.col(at)["level"], node: F.col(at)["node"]}).drop(at)
    left = one(intervals.where(F.col(lo) <= F.col(hi)), cover(F.col(lo).cast("long"), F.col(hi).cast("long"), top))
    right = one(points.where(F.col(value).isNotNull()), ancestors(F.col(value).cast("long"), top))
    return left.join(right.hint("merge"), [level, node]).drop(level, node)


def _first(points: Column) -> Column:
    """Of sorted points those that a summary keeps: KEEP of each of the first ITEMS items."""

    def step(kept: Column, x: Column) -> Column:
        same = F.size(F.filter(kept, lambda y: y["line_item_id"] == x["line_item_id"]))
        new = (same == 0) & (F.size(F.array_distinct(F.transform(kept, lambda y: y["line_item_id"]))) < ITEMS)
        return F.when(F.size(kept) >= KEEP * ITEMS, kept).when(new | ((same > 0) & (same < KEEP)), F.array_append(kept, x)).otherwise(kept)

    return F.aggregate(points, F.slice(points, 1, 0), step)


def _merge(lists: Column) -> Column:
    return _first(F.array_sort(F.flatten(lists)))


def _keyed(points: Column, key) -> Column:
    """points with their order's first field set by key(u); the others (u, sale_id, later, line_no, line_item_id) stay."""
    return F.transform(points, lambda x: F.struct(key(x["u"]).alias("key"), *[x[c].alias(c) for c in ("u", "sale_id", "later", "line_no", "line_item_id")]))


def _leaves(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts by (u, item), and one summary for each distinct u."""
    counts = table(lines.groupBy("u", "line_item_id").agg(F.count("*").alias("n"), F.sum("crc").alias("crc")), "band-counts")
    by = Window.partitionBy("u", "line_item_id").orderBy("sale_id", "later", "line_no")
    two = lines.withColumn("at", F.row_number().over(by)).where(F.col("at") <= KEEP)
    points = F.array_sort(F.collect_list(F.struct(F.lit(0).cast("long").alias("key"), "u", "sale_id", "later", "line_no", "line_item_id")))
    firsts = two.groupBy("u", "line_item_id").agg(points.alias("points"))
    few = firsts.withColumn("at", F.row_number().over(Window.partitionBy("u").orderBy(F.col("points")[0]))).where(F.col("at") <= ITEMS)
    best = few.groupBy("u").agg(F.array_sort(F.flatten(F.collect_list("points"))).alias("points"))
    sums = counts.groupBy("u").agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))
    leaves = sums.join(best.hint("merge"), "u").select(F.lit(0).alias("level"), F.col("u").alias("node"), "n", (F.col("u") * F.col("n")).alias("total"), "crc", _keyed(F.col("points"), lambda u: u).alias("low"), _keyed(F.col("points"), lambda u: -u).alias("high"))
    return counts, table(leaves, "band-leaves")


def _tree(leaves: DataFrame, top: int) -> DataFrame:
    """Summaries of all nodes up to level top; a level is emitted from the last one that was written."""
    parts, base = [leaves], 0
    while base < top:
        above = list(range(base + 1, min(base + AT_ONCE, top) + 1))
        node = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("node", k - base).alias("node")) for k in above]))
        emitted = parts[-1].where(F.col("level") == base).select(node.alias("at"), "n", "total", "crc", "low", "high")
        merged = emitted.groupBy(F.col("at")["level"].alias("level"), F.col("at")["node"].alias("node")).agg(*[F.sum(c).alias(c) for c in ("n", "total", "crc")], F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
        parts.append(table(merged.withColumns({"low": _merge(F.col("low")), "high": _merge(F.col("high"))}), f"band-level{above[-1]}"))
        base = above[-1]
    return reduce(DataFrame.unionByName, parts)


def summaries(items: DataFrame, lines: DataFrame, absolute: int = 100, per_mille: int = 1) -> DataFrame:
    """items (item_id, p, others) with n_pairs, gap_sum, lines_crc and first, the KEEP nearest points of other items.

    lines: u, line_item_id, sale_id, later (whether line_no is null), line_no, crc. An item whose p is null has no pairs.
    """
    lo, hi = (x.alias(n) for x, n in zip(band(F.col("p"), absolute, per_mille), ("lo", "hi"), strict=True))
    prices = items.where(F.col("p").isNotNull()).groupBy("p").count().select("p", lo, hi)
    top = levels(prices.agg(F.max(F.greatest(F.col("p") - F.col("lo") + 1, F.col("hi") - F.col("p")))).first()[0] or 1)
    counts, leaves = _leaves(lines)
    nodes = _tree(leaves, top)
    at = F.explode(F.concat(F.transform(cover(F.col("lo"), F.col("p"), top), lambda x: F.struct(F.lit(True).alias("below"), x.alias("x"))), F.transform(cover(F.col("p") + 1, F.col("hi"), top), lambda x: F.struct(F.lit(False).alias("below"), x.alias("x")))))
    parts = prices.select("p", at.alias("at")).select("p", F.col("at")["below"].alias("below"), F.col("at")["x"]["level"].alias("level"), F.col("at")["x"]["node"].alias("node"))
    below, side = F.col("below"), F.when(F.col("below"), F.col("high")).otherwise(F.col("low"))
    met = parts.join(nodes.hint("merge"), ["level", "node"]).groupBy("p").agg(F.sum("n").alias("n"), F.sum(F.when(below, F.col("p") * F.col("n") - F.col("total")).otherwise(F.col("total") - F.col("p") * F.col("n"))).alias("gap"), F.sum("crc").alias("crc"), F.collect_list(side).alias("near"))
    near = _first(F.array_sort(_keyed(F.flatten("near"), lambda u: F.abs(u - F.col("p")))))
    by_price = table(met.select(F.col("p").alias("price"), F.col("n").alias("all_n"), F.col("gap").alias("all_gap"), F.col("crc").alias("all_crc"), near.alias("near")), "band-prices")
    wanted = items.where(F.col("p").isNotNull() & F.col("item_id").isNotNull()).groupBy("item_id", "p").count().select("item_id", "p", lo, hi)
    own = wanted.join(counts.withColumnRenamed("line_item_id", "item_id").hint("merge"), "item_id").where(F.col("u").between(F.col("lo"), F.col("hi")))
    own = own.groupBy(F.col("item_id").alias("own_id"), F.col("p").alias("own_p")).agg(F.sum("n").alias("own_n"), F.sum(F.abs(F.col("u") - F.col("p")) * F.col("n")).alias("own_gap"), F.sum("crc").alias("own_crc"))
    both = items.join(own.hint("merge"), (F.col("item_id") == F.col("own_id")) & (F.col("p") == F.col("own_p")), "left").join(by_price.hint("merge"), F.col("p") == F.col("price"), "left")
    rest = lambda a: (F.coalesce(f"all_{a}", F.lit(0)) - F.coalesce(f"own_{a}", F.lit(0))).cast("long")
    others = F.filter(F.coalesce("near", F.array().cast(by_price.schema["near"].dataType)), lambda x: ~x["line_item_id"].eqNullSafe(F.col("item_id")))
    return both.select(*[quoted(c) for c in items.columns], rest("n").alias("n_pairs"), rest("gap").alias("gap_sum"), rest("crc").alias("lines_crc"), F.slice(others, 1, KEEP).alias("first"))


def _cents(x: Column) -> Column:
    """floor(100 x + 0.5) in doubles; null where it isn't finite or beyond MOST."""
    x = F.floor(F.lit(100.0) * x.cast("double") + F.lit(0.5))
    return F.when(F.abs(x) <= MOST, x)


def unit_lines(sale_lines: DataFrame) -> DataFrame:
    """Lines that can pair, with unit price u and checksum of their key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = sale_lines.select("sale_id", "line_no", "item_id", F.col("quantity").cast("long").alias("q"), F.when(~F.isnan(F.col("amount").cast("double")), _cents(F.col("amount"))).alias("a"))
    rows = rows.where("sale_id IS NOT NULL AND item_id IS NOT NULL AND a IS NOT NULL AND q <> 0")
    return rows.select(_div(2 * F.col("a") + F.col("q"), 2 * F.col("q")).alias("u"), F.col("item_id").cast("long").alias("line_item_id"), F.col("sale_id").cast("long").alias("sale_id"), F.col("line_no").isNull().alias("later"), F.col("line_no").cast("long").alias("line_no"), F.crc32(F.concat_ws(",", text("sale_id"), text("line_no"), text("item_id")).cast("binary")).alias("crc"))


def digest(items: DataFrame, sale_lines: DataFrame) -> DataFrame:
    """Each item's two nearest lines by unit price, and count, sum of gaps and checksum of all its pairs.

    Null or non-finite prices and amounts, amounts or prices beyond 9e15 cents, null sale_id, item_id or quantity of a line and
    quantities of 0 pair with nothing; negative ones are divided down like others. An item without an item_id has no lines of
    its own, so all lines of its band pair. A null line_no comes last among equals and is empty text in the checksum. Repeated
    lines count each and take a rank each; items that repeat return their rows each. Items without pairs, and all items where
    there are no lines, give one row of rank 0; without items the result is empty. Names and other texts, of any length, are not read, nor
    are extra columns.
    """
    price = F.col("price").cast("double")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.when(~F.isnan(price), _cents(price)).alias("p"))
    found = summaries(rows, unit_lines(sale_lines))
    x = found.select("item_id", F.posexplode_outer("first").alias("at", "x"), "n_pairs", "gap_sum", "lines_crc")
    named = [F.col("x")[a].alias(b) for a, b in (("key", "gap"), ("u", "u"), ("sale_id", "sale_id"), ("line_no", "line_no"), ("line_item_id", "line_item_id"))]
    return x.select("item_id", F.coalesce(F.col("at") + 1, F.lit(0)).cast("int").alias("rank"), *named, "n_pairs", "gap_sum", "lines_crc")
