"""From the table set to a pruned supply network: portfolios, edges with products, indexes, tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.iterate import cut
from ..operators.order import numbered
from ..operators.pools import best_of, sharing


@dataclass
class SupplyNetwork:
    """firms (firm_id, nation_id, is_oem, tier), edges (src, dst, weight, stochastic), edge_products (src, dst,
    product, amount, models), portfolio (firm_id, product, special)."""

    firms: DataFrame
    edges: DataFrame
    edge_products: DataFrame
    portfolio: DataFrame


def portfolios(tables: dict[str, DataFrame]) -> DataFrame:
    """firm_id, product, special: standard and special products by name."""
    standard = tables["ProductionCapabilities"].join(tables["Products"], "product_id", "left").select("firm_id", F.col("product_name").alias("product"), F.lit(False).alias("special"))
    special = tables["SpecialProductionCapabilities"].join(tables["SpecialProducts"], "special_product_id", "left").select("firm_id", F.col("special_product_name").alias("product"), F.lit(True).alias("special"))
    return standard.union(special).where("product is not null").distinct()


def edges_of(tables: dict[str, DataFrame], weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Edges (the relation of the greatest id for each pair of firms) and their products with counts and models."""
    pair = tables["SupplyRelations"].groupBy(F.col("source_firm_id").alias("src"), F.col("target_firm_id").alias("dst")).agg(F.max("relation_id").alias("relation_id"))
    detail = pair.join(tables["SupplyRelationDetails"].where("product_name is not null"), "relation_id")
    products = detail.groupBy("src", "dst", F.col("product_name").alias("product")).agg(F.count("*").alias("amount"), F.array_sort(F.collect_set("model_name")).alias("models"))
    total = products.groupBy("src", "dst").agg(F.sum("amount").alias("w"))
    weight = F.coalesce("w", F.lit(1).cast("long")) if weighted else F.lit(1).cast("long")
    edges = pair.join(total, ["src", "dst"], "left").select("src", "dst", weight.alias("weight"), F.col("w").isNull().alias("stochastic"))
    return edges, products


def prune(firms: DataFrame, edges: DataFrame, portfolio: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without suppliers that have no product, then without firms that have neither links nor products."""
    offered = portfolio.select("firm_id").distinct()
    empty = edges.select(F.col("src").alias("firm_id")).distinct().join(offered, "firm_id", "left_anti")
    kept = edges.join(empty, F.col("src") == F.col("firm_id"), "left_anti").join(empty, F.col("dst") == F.col("firm_id"), "left_anti")
    linked = kept.select(F.col("src").alias("firm_id")).union(kept.select("dst")).union(offered).distinct()
    left = firms.join(empty, "firm_id", "left_anti").join(linked, "firm_id", "left_semi")
    return left, kept


def load_network(tables: dict[str, DataFrame], weighted: bool = True) -> SupplyNetwork:
    """The whole preparation. Firms of relations that the firm table lacks count as firms."""
    edges, products = edges_of(tables, weighted)
    portfolio = cut(portfolios(tables))
    known = tables["Firms"].select("firm_id", "nation_id", "is_oem")
    more = edges.select(F.col("src").alias("firm_id")).union(edges.select("dst")).distinct().join(known, "firm_id", "left_anti")
    firms = known.unionByName(more.select("firm_id", F.lit(None).cast("int").alias("nation_id"), F.lit(False).alias("is_oem")))
    left, kept = prune(firms, edges, portfolio)
    kept = cut(kept)
    tier = graph.tiers(kept, left.select(F.col("firm_id").alias("node"))).withColumnRenamed("node", "firm_id")
    held = products.join(kept.select("src", "dst"), ["src", "dst"], "left_semi")
    return SupplyNetwork(left.join(tier, "firm_id"), kept, held, portfolio)


def delivered(network: SupplyNetwork) -> DataFrame:
    """firm_id, product: what firms supply on annotated links."""
    return network.edge_products.select(F.col("src").alias("firm_id"), "product").distinct()


def product_index(network: SupplyNetwork, with_delivered: bool = True) -> DataFrame:
    """product, firm_id: who offers what."""
    own = network.portfolio.select("product", "firm_id")
    return (own.union(delivered(network).select("product", "firm_id")) if with_delivered else own).distinct()


def _portfolio_sets(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(firm_id, s) and (s, product): firms by their distinct portfolios, told apart by 128 bits; s numbers them."""
    sets = index.where("firm_id is not null and product is not null").groupBy("firm_id").agg(F.array_sort(F.collect_set("product")).alias("set"))
    named = cut(sets.withColumn("digest", F.md5(F.to_json("set"))))
    numbers = cut(named.groupBy("digest").agg(F.first("set").alias("set")).withColumn("s", F.monotonically_increasing_id()))
    return named.join(numbers.select("digest", "s"), "digest").select("firm_id", "s"), numbers.select("s", F.explode("set").alias("product"))


def rivals(index: DataFrame) -> DataFrame:
    """firm_id, rival: firms that share a product, by one join on products.

    Firms of equal portfolios are joined once: the join runs over distinct sets of products. The result holds a row a
    pair of firms; rival_counts() counts without forming them.
    """
    of, by = _portfolio_sets(index)
    near = by.join(by.withColumnRenamed("s", "t"), "product").select("s", "t").distinct()
    return of.join(near, "s").join(of.select(F.col("firm_id").alias("rival"), F.col("s").alias("t")), "t").where("firm_id <> rival").select("firm_id", "rival")


def _offers(index: DataFrame) -> DataFrame:
    """firm, b: distinct offers without nulls; products that are no numbers by a hash of 64 bits."""
    kind = index.schema["product"].dataType.typeName()
    named = F.col("product").cast("long") if kind in ("byte", "short", "integer", "long") else F.xxhash64("product")
    return index.where("firm_id IS NOT NULL AND product IS NOT NULL").select(F.col("firm_id").cast("long").alias("firm"), named.alias("b")).distinct()


def rival_counts(index: DataFrame, heavy: int = 1024) -> DataFrame:
    """firm_id, rivals: with how many other firms a firm shares a product; firms without any are left out.

    A product of more than `heavy` firms isn't joined with itself. Firms are known by their set of such products; each
    such product has bitmaps of its firms, in blocks of places, and a set's bitmaps are united and counted, so all firms of
    a set cost one union. Firms that share a lesser product and no heavy one are counted as pairs, at most `heavy` an
    offer. The count is exact for any value of `heavy`. Rows without firm or product count nowhere.
    """
    plain = cut(_offers(index))
    if plain.groupBy("b").count().where(F.col("count") > heavy).isEmpty():
        return sharing(plain, pairs=False).select(F.col("firm").cast(index.schema["firm_id"].dataType).alias("firm_id"), F.col("others").alias("rivals"))
    offers = cut(index.where("firm_id is not null and product is not null").select("firm_id", "product").distinct())
    hot = cut(offers.groupBy("product").count().where(F.col("count") > heavy).select("product"))
    held = offers.join(hot, "product")
    sets = cut(held.groupBy("firm_id").agg(F.array_sort(F.collect_set("product")).alias("set")))
    placed = cut(numbered(sets, ["firm_id"], "place"))
    names = cut(placed.groupBy("set").agg(F.min("firm_id").alias("s")))
    bit = F.col("place") + 1
    bits = placed.select(F.explode("set").alias("product"), F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("at"))
    maps = cut(bits.groupBy("product", "block").agg(F.bitmap_construct_agg("at").alias("bits")))
    blocks = F.sequence(F.lit(1), F.lit(max(1, -(-placed.count() // 32768)))).cast("array<long>")
    # The join is on (product, block): a product that all firms offer is as many keys as there are blocks.
    wanted = names.select("s", F.explode("set").alias("product")).select("s", "product", F.explode(blocks).alias("block"))
    united = wanted.join(maps, ["product", "block"]).groupBy("s", "block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    by_set = names.join(united.groupBy("s").agg((F.sum("n") - 1).alias("many")), "s").select("set", "many")
    many = placed.select("firm_id", "set").join(by_set, "set").select("firm_id", "many")
    none = F.array().cast(sets.schema["set"].dataType)
    cold = cut(offers.join(hot, "product", "left_anti").join(sets, "firm_id", "left").select("firm_id", "product", F.coalesce("set", none).alias("set")))
    other = cold.select(F.col("firm_id").alias("rival"), "product", F.col("set").alias("other"))
    few = cold.join(other, "product").where("firm_id <> rival AND NOT arrays_overlap(set, other)").select("firm_id", "rival").distinct().groupBy("firm_id").agg(F.count("*").alias("few"))
    both = many.join(few, "firm_id", "full").select("firm_id", (F.coalesce("many", F.lit(0)) + F.coalesce("few", F.lit(0))).alias("rivals"))
    return both.where("rivals > 0")


def overlap_pool(index: DataFrame, lost: DataFrame | None = None) -> DataFrame:
    """lost, rival, weight: share of the lost firm's products that a rival offers; only the lost firms (all, if None) are expanded.

    Products' lists of firms meet at the lost firm and are counted there, so the result's pairs of firms are not shuffled.
    """
    kind = index.schema["firm_id"].dataType
    offers = cut(_offers(index))
    asked = None if lost is None else lost.select(F.col("firm_id").cast("long").alias("firm")).where("firm IS NOT NULL").distinct()
    found = sharing(offers, asked=asked)
    return found.select(F.col("firm").cast(kind).alias("lost"), F.col("other").cast(kind).alias("rival"), (F.col("shared") / F.col("own")).alias("weight"))


def best_alternatives(lost: DataFrame, sigma: DataFrame, index: DataFrame) -> DataFrame:
    """lost (search, product) -> search, firm_id, score, alt: each firm's best alike product (ties: the least number).

    Products are whole numbers, and a search has one. A firm's best alike product is found once a product that is searched
    for; the result has a row a search and firm, and these rows are made last and not shuffled.
    """
    nameless = F.lit(-(1 << 63)).cast("long")  # rows without firm are one firm
    like = sigma.join(lost.select("product").distinct(), "product", "left_semi").select(F.col("product").alias("a"), F.col("alt").alias("b"), "score")
    offers = index.select(F.coalesce("firm_id", nameless).alias("firm"), F.col("product").alias("b")).where("b IS NOT NULL")
    best = best_of(like, offers)
    found = best.join(lost.select("search", F.col("product").alias("a")), "a").select("search", F.explode("firms").alias("firm"), "score", F.col("b").alias("alt"))
    return found.select("search", F.nullif("firm", nameless).alias("firm_id"), "score", "alt")
