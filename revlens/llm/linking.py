"""Connected groups of similar items, without all pairs of a group.

Items are posted under keys; items that share a key may be similar. In a star round every key
names one centre, and only (centre, member) pairs are verified. Links found join items into
components. A key whose items all lie in one component has nothing left to tell. What remains
after the star rounds are keys that still hold several components: there, and only between
different components, all pairs are candidates (or those that a closer search names), so no
component is split that a link would join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import stored

STAR_ROUNDS = 2


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for all ends of the links ``a``, ``b``.

    Alternates two steps: every node tells its larger neighbours, then its smaller ones, of
    the smallest node it knows. Each is one grouping and one join on the edges; hot nodes
    are reduced by map-side minima and their join partitions can be split.
    """
    ends = F.struct(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = stored(links.filter("a <> b").select(ends.alias("e")).select("e.*").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        return r[0], r[1]

    now = state(edges)
    while now[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stored(large, "edges")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi")
        small = (
            moved.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
        )
        edges = stored(small, "edges")
        before, now = now, state(edges)
        if before == now:
            break
    leaves = edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return leaves.unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def with_component(df: DataFrame, comps: DataFrame | None) -> DataFrame:
    """``df`` with the component of ``id``; an item without links is its own component."""
    if comps is None:
        return df.withColumn("component", F.col("id"))
    return df.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))


def pairs_of_keys(open_keys: DataFrame) -> DataFrame:
    """(a, b): all pairs of items in different components under one key."""
    mine = open_keys.select("key", F.col("id").alias("a"), F.col("component").alias("ca"))
    other = open_keys.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    return mine.join(other, "key").filter("a < b and ca <> cb").select("a", "b").distinct()


def linked(
    postings: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    remaining: Callable[[DataFrame], DataFrame] | None = pairs_of_keys,
    star_rounds: int = STAR_ROUNDS,
    one_centre: bool = False,
) -> DataFrame | None:
    """id, component of the linked items among those posted as (key, id); None if none are.

    With ``one_centre`` an item is compared with one of its keys' centres a round, the smallest;
    where that joins it to its group, the other centres need no comparison any more.

    ``verify`` takes candidate pairs (a, b) with a < b and returns those that are links.
    ``remaining`` takes (key, id, component) of keys that hold several components after the
    star rounds and returns candidate pairs between components; with None the star rounds are all.
    """
    links, comps, tried = None, None, None
    for r in range(star_rounds + (remaining is not None)):
        placed = with_component(postings, comps)
        spread = placed.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.min(F.col("id").bitwiseXOR(F.lit(_salt(r)))).alias("centre"))
        live = spread.filter("first <> last").select("key", F.col("centre").bitwiseXOR(F.lit(_salt(r))).alias("centre"))
        if r < star_rounds:
            met = placed.join(live, "key").filter("id <> centre").select("id", "centre")
            met = met.groupBy("id").agg(F.min("centre").alias("centre")) if one_centre else met
            pairs = met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
            if comps is not None:
                pairs = _across(pairs, comps)
        else:
            pairs = remaining(stored(placed.join(live.select("key"), "key").select("key", "id", "component"), "open-keys"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        good = stored(verify(pairs), "links")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if good.isEmpty():
            continue
        links = good if links is None else links.unionByName(good)
        comps = stored(components(links), "components")
    return comps


def _salt(r: int) -> int:
    """Another order of the ids in each round; the first round takes the smallest id."""
    return 0 if r == 0 else (0x9E3779B97F4A7C15 * r) & 0x7FFFFFFFFFFFFFFF


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    out = pairs
    for end in ("a", "b"):
        named = comps.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        out = out.join(named, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return out.filter("ca <> cb").select("a", "b")
