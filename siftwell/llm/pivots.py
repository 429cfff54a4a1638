"""Links among the members of a pivot, without pairing all of them.

A bucket's members are first compared with its pivot alone. Members that this leaves in different components may still be linked to one
another. They are told apart by how they differ from a centre: D_x is what x lacks of the centre's set and has beyond it, so two members
differ in exactly D_x without D_y and D_y without D_x, and the similarity reaches ``percent`` in a hundred if and only if

    2 * (100 + percent) * |D_x and D_y| >= -(S_x + S_y),   with S_x = (100 - percent) * |x| - (100 + percent) * |D_x|.

So members with S_x + S_y >= 0 are linked, and all of these through the member with the largest S: one comparison a member. Any other
pair must share some of D, so many at least, and is found by a prefix filter: elements in one order, rare ones first, of which whatever
shares ``o`` shares one of all but the last o - 1. Elements with the same members (a paragraph's shingles) are one class with a weight, so a
shared paragraph is one row of the join and not a row a shingle; elements that half of the members differ in are turned round, which
makes the centre the majority's set; and elements that only one member, or one component, differs in link nothing and are left out.
The filter loses no pair. What it lets through is held against the formula with its exact overlap in D, and only what that links is
compared on full sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.common import Scratch, keyed
from siftwell.llm.components import components, extended

Pairs = Callable[[DataFrame], DataFrame]
#: The low bits of a class's number hold its weight; the largest stands for any weight from there on, which is then taken for enough.
WEIGHT_BITS = 20


def all_links(seen: DataFrame, links: DataFrame, compare: Pairs, differ: Pairs, percent: int, scratch: Scratch) -> DataFrame:
    """(id, component) of all members with a link. ``seen(a, b, na, nb)``: pivots a, their members b, and the sizes of their sets; ``links(a,
    b)``: those of these pairs that are similar, and any more. ``compare`` gives (a, b) of the pairs of a frame that are similar, ``differ``
    (a, b, d) with the elements that either set has alone."""
    return more_links(seen, components(links, scratch), compare, differ, percent, scratch)


def paired_links(buckets: DataFrame, seen: DataFrame, found: DataFrame, compare: Pairs, percent: int, scratch: Scratch) -> DataFrame:
    """``found(id, component)`` with the links of the pairs of each bucket of ``buckets(bucket, key)``, whose sizes the caller bounds: those of members in different
    components, neither of them the bucket's least key, which ``seen`` has compared, and whose set sizes allow ``percent`` in a hundred."""
    sizes = seen.select(F.col("a").alias("key"), F.col("na").alias("n")).unionByName(seen.select(F.col("b").alias("key"), F.col("nb").alias("n"))).distinct()
    label = found.select(F.col("id").alias("key"), "component")
    facts = scratch.save(sizes.join(label, "key", "left").select("key", "n", F.coalesce("component", "key").alias("c")))
    rows = scratch.save(buckets.join(facts, "key"))
    several = rows.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("key").alias("pivot")).filter("lo < hi").select("bucket", "pivot")
    rows = scratch.save(keyed(rows, scratch.save(several), "bucket").filter("key <> pivot").drop("pivot"))
    x, y = (rows.select("bucket", F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("c").alias(f"c{k}")) for k in "ab")
    pairs = x.join(y, "bucket").filter(f"a < b and ca <> cb and 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    more = scratch.save(compare(scratch.save(pairs.select("a", "b").distinct())))
    return found if more.isEmpty() else extended(found, more, scratch)


def more_links(seen: DataFrame, found: DataFrame, compare: Pairs, differ: Pairs, percent: int, scratch: Scratch) -> DataFrame:
    """As ``all_links``, from components that are ``found`` already."""
    members = _open_members(seen, found, scratch)
    if members.isEmpty():
        return found
    profile, items, sets = _profiles(members, differ, percent, scratch)
    for choose in (nearest, candidates):
        more = scratch.save(compare(choose(profile, items, sets, percent, scratch)))
        if not more.isEmpty():
            found = extended(found, more, scratch)
            label = found.select(F.col("id").alias("x"), "component")
            profile = scratch.save(profile.join(label, "x", "left").withColumn("c", F.coalesce("component", "x")).drop("component"))
    return found


def _open_members(seen: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(p, x, n, c, g): the members x of a group that lie in several components; c the component, g the group's size. A group has the members of all
    pivots that are in one component, these included, and goes by the least of its pivots, p: a member that met many pivots of a large component
    is in it once. Of a group of two the only pair has been compared."""
    label = found.select("id", "component")
    of = lambda rows, column, name: rows.join(label.withColumnsRenamed({"id": column, "component": name}), column, "left").withColumn(name, F.coalesce(name, column))
    pivots = scratch.save(of(seen.select(F.col("a").alias("p"), F.col("na").alias("n")).distinct(), "p", "cp"))
    least = scratch.save(pivots.groupBy("cp").agg(F.min("p").alias("q")))
    named = scratch.save(keyed(pivots, least, "cp").select("p", "q", "n"))
    met = seen.select(F.col("a").alias("p"), F.col("b").alias("x"), F.col("nb").alias("n")).join(named.select("p", "q"), "p").select("q", "x", "n")
    rows = met.unionByName(named.select("q", F.col("p").alias("x"), "n")).distinct().withColumnRenamed("q", "p")
    rows = scratch.save(of(rows, "x", "c").select("p", "x", "n", "c"))
    several = rows.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("g")).filter("lo < hi and g > 2").select("p", "g")
    return scratch.save(keyed(rows, scratch.save(several), "p"))


def _profiles(members: DataFrame, differ: Pairs, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(p, x, n, c, s): s is S of the docstring above; (p, x, e, w, k): the classes of D_x that may link, e a class's number, w its elements, k
    the members that differ in it; and (p, x, es): the same as arrays."""
    pairs = members.filter("x <> p").select(F.col("p").alias("a"), F.col("x").alias("b"))
    single = differ(pairs).select(F.col("a").alias("p"), F.col("b").alias("x"), F.explode("d").alias("e"))
    single = scratch.save(single.join(members.select("p", "x", "c"), ["p", "x"]))
    whole = scratch.save(single.groupBy("p", "x").agg(F.count("*").alias("d")))
    same = [F.bit_xor(F.xxhash64("x")).alias("k1"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("k2")]
    shared = single.groupBy("p", "e").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"), *same).filter("k > 1")
    size = scratch.save(members.select("p", "g").distinct())
    shared = keyed(shared, size, "p").withColumn("turned", 2 * F.col("k") > F.col("g")).filter("turned or lo < hi")
    classes = shared.groupBy("p", "k1", "k2", "k", "g", "turned").agg(F.min("e").alias("e"), F.count("*").alias("w"))
    most = (1 << WEIGHT_BITS) - 1
    number = F.col("e").bitwiseAND(F.lit(~most)).bitwiseOR(F.least("w", F.lit(most)))
    classes = scratch.save(classes.select("p", "e", number.alias("cl"), "w", F.when(F.col("turned"), F.col("g") - F.col("k")).otherwise(F.col("k")).alias("k"), "turned"))
    held = scratch.save(single.select("p", "x", "e").join(classes, ["p", "e"]).drop("e").withColumnRenamed("cl", "e"))
    scratch.drop(single)
    classes = classes.drop("e").withColumnRenamed("cl", "e")
    own = held.groupBy("p", "x").agg(F.collect_list("e").alias("own"), F.sum(F.when(F.col("turned"), F.col("w")).otherwise(0)).alias("ow"))
    # Written, and not grouped in place, so that adaptive execution can split a large group's members.
    turned = scratch.save(classes.filter("turned").groupBy("p").agg(F.collect_list("e").alias("all"), F.sum("w").alias("aw")))
    none = F.expr("cast(array() as array<bigint>)")
    state = members.join(own, ["p", "x"], "left").join(turned, "p", "left").join(whole, ["p", "x"], "left")
    state = state.withColumns({"own": F.coalesce("own", none), "all": F.coalesce("all", none), "d": F.coalesce("d", F.lit(0)) + F.coalesce("aw", F.lit(0)) - 2 * F.coalesce("ow", F.lit(0))})
    state = state.select("p", "x", "n", "c", F.concat(F.array_except("own", "all"), F.array_except("all", "own")).alias("es"), ((100 - percent) * F.col("n") - (100 + percent) * F.col("d")).alias("s"))
    state = scratch.save(state)
    items = scratch.save(state.select("p", "x", F.explode("es").alias("e")).join(classes.select("p", "e", "w", "k"), ["p", "e"]))
    scratch.drop(held, whole)
    return state.drop("es"), items, state.select("p", "x", "es")


def nearest(profile: DataFrame, items: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of each pivot's member of the largest S with the members of other components that are linked to it for certain."""
    best = profile.groupBy("p").agg(F.max(F.struct("s", "x", "c")).alias("m"))
    rows = keyed(profile, scratch.save(best.select("p", F.col("m.x").alias("m"), F.col("m.c").alias("cm"), F.col("m.s").alias("sm"))), "p").filter("c <> cm and s + sm >= 0")
    return rows.select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()


def candidates(profile: DataFrame, items: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of members in different components that share an element early enough for the overlap that they need, and that have
    that overlap.

    What a member needs at least follows from its own and the group's largest S; what a pair needs, its two positions are held against once
    they have met. Most of a group's members are usually in one component already, and none of these need meet another: only the rest
    bring their first elements, and of the others those come in that hold one of these elements.
    """
    sizes = profile.groupBy("p", "c").agg(F.count("*").alias("n"), F.max("s").alias("s"))
    groups = sizes.groupBy("p").agg(F.max(F.struct("n", "c")).alias("t"), F.max("s").alias("sm"), F.count("*").alias("several")).filter("several > 1").select("p", F.col("t.c").alias("main"), "sm")
    rows = scratch.save(keyed(profile.drop("n"), scratch.save(groups), "p"))
    member = Window.partitionBy("p", "x")
    upto = F.coalesce(F.sum("w").over(member.orderBy("k", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = scratch.save(items.withColumns({"upto": upto, "sh": F.sum("w").over(member)}).drop("w", "k"))
    needs = f"greatest(1, ceil(-({{0}}) / {2 * (100 + percent)}))"
    early = F.expr(f"upto <= sh - {needs.format('s + sm')}")
    rest = rows.filter("c <> main").drop("main")
    few = scratch.save(placed.join(rest, ["p", "x"]).filter(early).drop("sm"))
    held = keyed(placed, scratch.save(few.select("p", "e").distinct()), ["p", "e"], "left_semi")
    many = held.join(rows.filter("c = main").drop("main"), ["p", "x"]).filter(early).drop("sm")
    other = few.unionByName(many).withColumnsRenamed({"x": "y", "c": "cy", "s": "sy", "upto": "upto_y", "sh": "sh_y"})
    both = needs.format("s + sy")
    met = few.join(scratch.save(other), ["p", "e"]).filter("c <> cy").filter(f"upto <= sh - {both} and upto_y <= sh_y - {both}")
    met = met.select("p", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("s") + F.col("sy")).alias("ss")).distinct()
    met = met.join(sets, ["p", "x"]).join(sets.withColumnsRenamed({"x": "y", "es": "ey"}), ["p", "y"])
    most = (1 << WEIGHT_BITS) - 1
    weight = f"aggregate(array_intersect(es, ey), 0L, (acc, e) -> acc + if(e & {most} = {most}, {1 << 40}L, e & {most}))"
    met = met.filter(F.expr(f"{2 * (100 + percent)} * ({weight}) >= -ss"))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
