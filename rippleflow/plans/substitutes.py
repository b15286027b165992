"""Substitutes of lost products: firms that offer something alike are counted by operators.pools, not formed as pairs.

The other engine's SQL of these queries lies with the templates that join products, alike vectors and offers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import u01
from ..operators.iterate import cut
from ..operators.pools import best_of, united
from ..operators.similarity import all_pairs
from ..sources.adapter import Network


def _parts(n: Network) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lost (src, dst, product, amount, a), like (a, b, score) of lost classes, offers (firm, b)."""
    lost = cut(n.sql("SELECT e.src, CAST(e.dst AS BIGINT) AS dst, e.product, e.amount, e.product % s.vectors AS a FROM {edge_products} e CROSS JOIN {sizes} s"))
    like = cut(all_pairs(n["embeddings"], 0.3).join(lost.select("a").distinct(), "a", "left_semi"))
    offers = cut(n.sql("SELECT DISTINCT c.firm_id AS firm, c.product % s.vectors AS b FROM {capabilities} c CROSS JOIN {sizes} s WHERE c.product IS NOT NULL"))
    return lost, like.select("a", "b", "score"), offers


def _sizes(n: Network) -> tuple[DataFrame, DataFrame]:
    """lost and (product, pool)."""
    lost, like, offers = _parts(n)
    nameless = F.lit(-(1 << 63)).cast("long")  # a row without firm counts as one firm
    pool, _ = united(like.select("a", "b"), offers.select(F.coalesce("firm", nameless).alias("firm"), "b"))
    return lost, lost.select("product", "a").distinct().join(pool, "a").select("product", "pool")


def product_pools(n: Network) -> DataFrame:
    return _sizes(n)[1]


def _others(lost: DataFrame, like: DataFrame, offers: DataFrame) -> DataFrame:
    """lost with the number of firms, but for the link's two ends, that offer something like the product."""
    ends = lost.select("a", F.col("src").alias("firm")).union(lost.select("a", "dst")).join(offers.select("firm"), "firm", "left_semi").select("a", "firm")
    pool, held = united(like.select("a", "b"), offers.where("firm IS NOT NULL"), ends.where("a IS NOT NULL"))
    of = lambda end: held.select("a", F.col("firm").alias(end), F.lit(1).alias(f"is_{end}"))
    known = lost.join(pool, "a", "left").join(of("src"), ["a", "src"], "left").join(of("dst"), ["a", "dst"], "left")
    ends = F.coalesce("is_src", F.lit(0)) + F.when(F.col("src") == F.col("dst"), 0).otherwise(F.coalesce("is_dst", F.lit(0)))
    return known.select(*lost.columns, (F.coalesce("pool", F.lit(0)) - ends).cast("long").alias("others"))


def edge_candidates(n: Network) -> DataFrame:
    return _others(*_parts(n)).select("src", "dst", "product", F.col("others").alias("candidates"))


def link_features(n: Network) -> DataFrame:
    """Of links with products that someone could replace: the scarcest one's pool, their share of inbound volume, the customer's degree."""
    lost, size = _sizes(n)
    few = cut(lost.join(size, "product").groupBy("src", "dst").agg(F.min("pool").alias("pool"), F.sum("amount").alias("amount")))
    return n.sql(
        """SELECT f.src, f.dst, round(ln(f.pool), 6) AS log_pool, round(f.amount / (1.0 * i.w), 6) AS dependence, round(ln(d.degree), 6) AS log_degree
        FROM {few} f JOIN (SELECT dst, sum(weight) AS w FROM {relations} GROUP BY dst) i ON f.dst = i.dst JOIN {degrees} d ON f.dst = d.firm_id""",
        few=few,
    )


def specific_searches(n: Network) -> DataFrame:
    """Per lost product the number of its options and the best score of one.

    A class that three firms offer is left with an option whoever the link's ends are; only classes of fewer firms that score
    higher are looked at firm by firm.
    """
    lost, like, offers = _parts(n)
    offers = offers.where("firm IS NOT NULL")
    many = offers.groupBy("b").agg(F.count("*").alias("firms"))
    scored = cut(like.join(many, "b"))
    sure = scored.where("firms > 2").groupBy("a").agg(F.max("score").alias("sure"))
    thin = scored.where("firms <= 2").join(sure, "a", "left").where("sure IS NULL OR score > sure").select("a", "b", "score").join(offers, "b").select("a", "firm", "score")
    met = lost.select("a", "src", "dst").distinct().join(thin, "a").where("firm <> src AND firm <> dst").groupBy("a", "src", "dst").agg(F.max("score").alias("rare"))
    out = _others(lost, like, offers).join(sure, "a", "left").join(met, ["a", "src", "dst"], "left")
    return out.select(F.col("dst").alias("customer"), F.col("src").alias("firm"), "product", "amount", F.col("others").alias("options"), F.round(F.greatest("sure", "rare"), 6).alias("best"))


def _race(lost: DataFrame, lists: DataFrame) -> DataFrame:
    """Options of lost products with their arrival times in the race that _SPECIFIC's ticks run; no row is shuffled."""
    each = lost.join(lists, "a").select(*lost.columns, "score", F.explode("firms").alias("alt")).where("alt <> src AND alt <> dst")
    u = u01([F.lit("score"), F.col("dst") * 100000 + F.col("src"), F.col("product") * 100000 + F.col("alt")])
    return each.withColumn("time", -F.log(u) / F.col("score"))


def specific_candidates(n: Network, share: int = 128) -> DataFrame:
    """The first three options of every lost product, by an exponential race.

    The race is run twice: among one of `share` firms first, whose third time is a limit that no option of the three
    exceeds, then among all; only options within the limit (all, where a sample has fewer than three) are put in order.
    """
    lost, like, offers = _parts(n)
    lists = best_of(like.where("a IS NOT NULL"), offers.where("firm IS NOT NULL"))
    keys, link = ["dst", "src", "product"], lost.select("dst", "src", "product", "a")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("time", "alt"))
    some = lists.withColumn("firms", F.filter("firms", lambda x: F.pmod(F.xxhash64(x), F.lit(share)) == 0)).where("size(firms) > 0")
    limits = _race(link, some).withColumn("place", place).where("place <= 3").where("place = 3").select(*keys, F.col("time").alias("limit"))
    raced = _race(cut(link.join(limits, keys, "left")), lists).where("limit IS NULL OR time <= limit")
    first = raced.withColumn("place", place).where("place <= 3")
    return first.select(F.col("dst").alias("customer"), F.col("src").alias("firm"), "product", "alt")


def without_isolates(n: Network) -> DataFrame:
    """The firms that pruning keeps: not a supplier in debt, and with links to others that aren't, or products.

    Links are not made distinct by pairs, and of products only who sells any is asked for: what is sorted is a row a firm.
    """
    links = n["all_details"].select("src", "dst")
    suppliers = links.select(F.col("src").alias("firm_id")).distinct()
    gone = cut(n["firms"].where("capital < 0").select("firm_id").join(suppliers, "firm_id", "left_semi").distinct())
    kept = links.join(gone, F.col("src") == F.col("firm_id"), "left_anti").join(gone, F.col("dst") == F.col("firm_id"), "left_anti")
    sellers = n["lineitem"].select(F.col("l_suppkey").alias("firm_id")).distinct()
    present = kept.select(F.col("src").alias("firm_id")).union(kept.select("dst")).union(sellers).distinct()
    return n["firms"].select("firm_id").join(gone, "firm_id", "left_anti").join(present, "firm_id", "left_semi")


QUERIES: dict[str, Callable[[Network], DataFrame]] = {
    "F13_prune_isolates": without_isolates,
    "C39_link_features": link_features,
    "C4_product_pools": product_pools,
    "C5_edge_candidates": edge_candidates,
    "Z5_specific_searches": specific_searches,
    "Z9_specific_candidates": specific_candidates,
}
