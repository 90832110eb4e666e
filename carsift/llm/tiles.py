"""Classes of similar items from candidate tiles, without listing all pairs of a tile.

Each item is first compared with its tile's smallest one, which costs comparisons in proportion to the tile's size. The links
found give classes; then only items of one tile that are still in different classes are compared with each other. Every pair
of a tile is thus compared or already in one class, so no class is missed. `leader_classes` first compares open tiles with a
few more of their items, one each round, which joins most classes of a large group of near copies at a cost linear in it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carsift.llm.components import components
from carsift.llm.scratch import written


BITS = 1024


def may_link(na: str, nb: str, xa: str, xb: str, num: int, den: int) -> Column:
    """A condition that sets of similarity num / den always meet, from hashed bitmaps (arrays of BITS / 64 longs).

    Sets differ in at least as many elements as their bitmaps in bits, so they share (na + nb - bits) / 2 elements at most;
    sets as similar as asked share num / (num + den) of na + nb. Sizes may be bounds from above.
    """
    differ = sum((F.bit_count(F.get(xa, F.lit(i)).bitwiseXOR(F.get(xb, F.lit(i)))) for i in range(BITS // 64)), F.lit(0))
    total = F.col(na) + F.col(nb)
    return (total - differ) * (num + den) >= 2 * num * total


def may_link_finely(na: str, nb: str, xa: str, xb: str, num: int, den: int) -> Column:
    """The condition of `may_link` from bitmaps of any one size: the larger they are, the fewer other pairs meet it."""
    differ = F.aggregate(F.zip_with(xa, xb, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    total = F.col(na) + F.col(nb)
    return (total - differ) * (num + den) >= 2 * num * total


def candidate_tiles(*members: DataFrame) -> DataFrame:
    """(key, id) -> (key, id, lead) for tiles of two items or more; lead is the tile's smallest id. Members may come in several
    tables that share no key: one after the other is shuffled, and only its repeated keys stay.

    Of tiles with the same items (by their number and three sums of 40-bit hashes) only one stays: similar items share most of
    their keys, and each such tile would give the same pairs again.
    """
    tile = Window.partitionBy("key")
    prints = [F.sum(F.shiftright(F.xxhash64("id", F.lit(i)), 24)).over(tile).alias(f"print{i}") for i in range(3)]
    sized = reduce(DataFrame.unionByName, [written(
        some.select("key", "id", F.count("*").over(tile).alias("m"), F.min("id").over(tile).alias("lead"), *prints).where("m > 1"), "sized") for some in members])
    once = sized.where("id = lead").groupBy("m", "lead", "print0", "print1", "print2").agg(F.min("key").alias("key")).select("key")
    return written(sized.select("key", "id", "lead").join(once, "key", "left_semi"), "tiles")


def _sided(signs: DataFrame, side: str) -> DataFrame:
    return signs.select(*[F.col(c).alias(f"{side}_{c}") for c in signs.columns])


def tile_classes(tiles: DataFrame, signs: DataFrame, may_link: Column, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of all items linked with another.

    signs: one row per id with columns that may_link reads as a_<column> and b_<column>: a condition that all links meet.
    verify: pairs (u, v) -> those that are links.
    """
    a, b = _sided(signs, "a"), _sided(signs, "b")
    stars = tiles.where("id > lead").select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct()
    tried = written(stars.join(a, F.col("u") == F.col("a_id")).join(b, (F.col("v") == F.col("b_id")) & may_link).select("u", "v"), "stars")
    links = written(verify(tried), "links")
    roots = components(links)

    member = tiles.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    split = member.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    still = written(member.join(split, "key", "left_semi"), "open")
    full = still.join(signs, "id")
    one, two = _sided(full, "a"), _sided(full, "b")
    apart = (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id")) & (F.col("a_root") != F.col("b_root"))
    across = one.join(two, apart & may_link).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")).distinct()
    rest = written(across.join(tried, ["u", "v"], "left_anti"), "across")
    more = written(verify(rest), "links")
    return components(links.unionByName(more))


def leader_classes(tiles: DataFrame, signs: DataFrame, may_link: Column, verify: Callable[[DataFrame], DataFrame], rounds: int = 4) -> DataFrame:
    """(node, root) as by tile_classes, in rounds.

    Every round compares the items of each tile that is still of several classes with one item of it, drawn anew by a hash; the
    links found join classes before the next round. What is apart after the last round is compared pair by pair, so `rounds`
    moves work but changes no class.
    """
    a, b = _sided(signs, "a"), _sided(signs, "b")
    tried = roots = None
    for turn in range(rounds + 1):
        if turn == 0:
            pairs = tiles.where("id > lead").select(F.col("lead").alias("u"), F.col("id").alias("v"))
        else:
            member = tiles.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
            drawn = F.xxhash64("id", F.lit(turn))
            sides = member.groupBy("key").agg(
                F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("id", drawn).alias("lead"), F.min_by("root", drawn).alias("lead_root"))
            still = member.join(sides.where("r0 < r1"), "key")
            if turn < rounds:
                pairs = still.where("root <> lead_root").select(F.least("lead", "id").alias("u"), F.greatest("lead", "id").alias("v"))
            else:
                full = written(still.select("key", "id", "root"), "open").join(signs, "id")
                one, two = _sided(full, "a"), _sided(full, "b")
                apart = (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id")) & (F.col("a_root") != F.col("b_root"))
                pairs = one.join(two, apart & may_link).select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
        fresh = pairs.distinct()
        if turn < rounds:
            fresh = fresh.join(a, F.col("u") == F.col("a_id")).join(b, (F.col("v") == F.col("b_id")) & may_link).select("u", "v")
        if tried is not None:
            fresh = fresh.join(tried, ["u", "v"], "left_anti")
        fresh = written(fresh, "compared")
        tried = fresh if tried is None else tried.unionByName(fresh)
        found = written(verify(fresh), "links")
        if turn == 0:
            roots = written(components(found), "roots")
            continue
        # classes are joined by links between their roots; single items that are linked now are classes of one so far
        root_of = lambda side: roots.withColumnsRenamed({"node": side, "root": f"{side}_root"})
        ends = found.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left").select(
            "u", "v", F.coalesce("u_root", "u").alias("ru"), F.coalesce("v_root", "v").alias("rv"))
        ends = written(ends, "ends")
        joined = written(components(ends.select(F.col("ru").alias("u"), F.col("rv").alias("v"))), "joined").withColumnsRenamed({"node": "old", "root": "new"})
        ids = ends.select(F.col("u").alias("node"), F.col("ru").alias("root")).unionByName(ends.select(F.col("v").alias("node"), F.col("rv").alias("root")))
        known = roots.unionByName(ids.join(roots, "node", "left_anti").distinct())
        roots = written(known.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
    return roots
