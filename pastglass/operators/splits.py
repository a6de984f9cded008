"""Splits that keep related records together: Boruvka contraction, size bands, systematic dealing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastglass.sources.tables import cut

#: A band of at least this many roots is dealt systematically; the roots of the others, less than this for each of at
#: most 65 bands, go one by one.
BAND = 20
#: Typical roots of a band in one turn of the systematic deal. Each end of a part is off by half a root or so.
TURN = 50
#: Blocks of the order of the hash within a band.
BLOCKS = 4096


def _halves(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))
    return edges.select(F.explode(ends).alias("e"), "w", "id").select("e.x", "e.y", "w", "id")


def _least(edges: DataFrame) -> DataFrame:
    """One edge, the least by (weight, id), for each unordered pair of different ends."""
    pairs = edges.filter(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct("w", "id").alias("r"))
    return pairs.groupBy("u", "v").agg(F.min("r").alias("r")).select("u", "v", "r.w", "r.id")


def spanning_forest(links: DataFrame, a: str, b: str, edge_id: str, weight: str | None = None, max_rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of the graph of links: forest has the edge ids of a least spanning forest, roots (node, root).

    Boruvka's rounds: every component picks its least edge by (weight, id), which is a strict order, so picks close
    only cycles of two, broken in favour of the smaller end; chains of picks are contracted by pointer doubling, and
    the edges are relabelled, freed of loops and reduced to the least of each pair. Each round halves the components
    at least; each is persisted in the shared folder, so a lost executor costs no more than the round. Everything is
    an aggregation with map-side combine or a join against a table with unique keys.

    Links with a null end, loops, and repeated or turned-round links are of no effect; a null weight counts as the
    least; without links both tables are empty. The root of a component is one of its nodes. An error is raised where
    max_rounds don't suffice, for which it takes more than 2 ** max_rounds nodes.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v"), (F.col(weight).cast("double") if weight else F.lit(0.0)).alias("w"), F.col(edge_id).alias("id"))
    edges = cut(_least(ends.filter(F.col("u").isNotNull() & F.col("v").isNotNull())))
    roots = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("root", F.col("node"))
    forest = edges.select("id").limit(0)
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        picks = _halves(edges).groupBy("x").agg(F.min(F.struct("w", "id", "y")).alias("p")).select("x", "p.y", "p.id")
        back = picks.select(F.col("x").alias("bx"), F.col("y").alias("by"))
        up = picks.join(back, F.col("y") == F.col("bx"), "left")
        up = cut(up.select("x", F.when((F.col("by") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("top"), "id"))
        forest = forest.union(up.select("id")).distinct()
        jump = up.select("x", "top")
        for _ in range(max_rounds):
            over = jump.select(F.col("x").alias("ox"), F.col("top").alias("otop"))
            jump = cut(jump.join(over, F.col("top") == F.col("ox")).select("x", F.col("otop").alias("top"), (F.col("otop") != F.col("top")).alias("moved")))
            if jump.filter("moved").isEmpty():
                break
            jump = jump.select("x", "top")
        else:
            raise RuntimeError(f"chains of picks not contracted in {max_rounds} rounds")
        to = jump.select(F.col("x").alias("jx"), "top")
        roots = cut(roots.join(to, F.col("root") == F.col("jx"), "left").select("node", F.coalesce("top", "root").alias("root")))
        edges = edges.join(to, F.col("u") == F.col("jx")).select(F.col("top").alias("u"), "v", "w", "id")
        edges = edges.join(to, F.col("v") == F.col("jx")).select("u", F.col("top").alias("v"), "w", "id")
        edges = cut(_least(edges))
    else:
        if not edges.isEmpty():
            raise RuntimeError(f"components not contracted in {max_rounds} rounds")
    return cut(forest), roots


def deal(sizes: DataFrame, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """(root, size) -> (root, size, band, split), splits having the given shares of the total size, about.

    Roots are stratified by band (the power of two of their size). The roots of a band lie on a line by their hash, each
    as long as its size; the line is cut into a whole number of turns, of about TURN typical roots, and each turn, from a
    place of its own by a hash, has a part for every split. A root goes to the split in whose part its middle lies, so every band is spread over the
    splits, off by half a root or so for each end of a part. Bands of less than BAND roots have no whole turns: their roots (a bounded number, among them any that
    outweighs all others) go one by one beforehand, largest first, to the split that lacks most, and the parts of a turn
    are made for what these left of each share. Running sums go over blocks, then within a block. Sizes of
    null or zero count as zero, weigh nothing, and are dealt by their hash.
    """
    names, seeded = list(shares), F.xxhash64("root", F.lit(seed))
    rows = sizes.select("root", F.coalesce("size", F.lit(0)).cast("long").alias("size")).withColumn("__h", seeded).withColumn("band", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size") + 0.5)).cast("int")).otherwise(-1))
    unit = F.pow(F.lit(2.0), F.col("band"))
    rows = rows.withColumn("__len", F.when(F.col("size") > 0, F.col("size") / (unit * 1.5 * TURN)).otherwise(0.0))
    rows = cut(rows.withColumn("__b", F.pmod("__h", F.lit(BLOCKS)).cast("int")))
    blocks = cut(rows.groupBy("band", "__b").agg(F.count("*").alias("__n"), F.sum("size").alias("__s"), F.sum("__len").alias("__l")))
    bands = blocks.groupBy("band").agg(F.sum("__n").alias("__n"), F.sum("__s").alias("__s"), F.sum("__l").alias("__l"))
    single = (F.col("__n") < BAND) & (F.col("band") >= 0)
    total = bands.agg(F.coalesce(F.sum("__s"), F.lit(0)).alias("__total"))
    few = bands.filter(single).select(F.col("band").alias("__few"))
    head_rows = rows.join(F.broadcast(few), F.col("band") == F.col("__few"))  # at most 65 bands
    line = head_rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("n"), F.col("__h").alias("h"), "root", "band"))).alias("l")).crossJoin(F.broadcast(total))  # one row
    targets = F.array(*[F.lit(float(shares[n])) for n in names])
    empty = F.struct(F.array(*[F.lit(0.0) for _ in names]).alias("got"), F.array().cast("array<int>").alias("to"))

    def step(acc, x):
        lack = F.zip_with(targets, acc["got"], lambda t, g: t * F.col("__total") - g)
        best = F.array_position(lack, F.array_max(lack)).cast("int") - 1
        got = F.transform(acc["got"], lambda g, i: F.when(i == best, g - x["n"]).otherwise(g))
        return F.struct(got.alias("got"), F.concat(acc["to"], F.array(best)).alias("to"))

    dealt = line.select("l", "__total", F.aggregate("l", empty, step).alias("d"))
    names_col = F.array(*[F.lit(n) for n in names])
    head = dealt.select(F.explode(F.arrays_zip(F.col("l"), F.col("d.to").alias("to"))).alias("z")).select(F.col("z.l.root").alias("root"), (-F.col("z.l.n")).alias("size"), F.col("z.l.band").alias("band"), F.element_at(names_col, F.element_at(F.array(F.col("z.to")), 1) + 1).alias("split"))
    need = F.transform(F.zip_with(targets, F.col("d.got"), lambda t, g: t * F.col("__total") - g), lambda v: F.greatest(v, F.lit(0.0)))
    left = dealt.select(need.alias("__need")).withColumn("__sum", F.aggregate("__need", F.lit(0.0), lambda s, v: s + v))
    left = left.select(F.when(F.col("__sum") > 0, F.transform("__need", lambda v: v / F.col("__sum"))).otherwise(targets).alias("__q"))
    # Where each block begins on its band's line, in turns.
    within = Window.partitionBy("band").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.join(F.broadcast(few), F.col("band") == F.col("__few"), "left_anti").select(F.col("band").alias("__band"), F.col("__b").alias("__k"), F.coalesce(F.sum("__l").over(within), F.lit(0.0)).alias("__base"), F.sum("__l").over(Window.partitionBy("band")).alias("__whole"))
    inner = Window.partitionBy("band", "__b").orderBy("__h", "root").rowsBetween(Window.unboundedPreceding, 0)
    tail = rows.join(F.broadcast(few), F.col("band") == F.col("__few"), "left_anti")
    tail = tail.withColumn("__in", F.sum("__len").over(inner)).join(places, (F.col("band") == F.col("__band")) & (F.col("__b") == F.col("__k"))).crossJoin(F.broadcast(left))  # one row
    turns = F.greatest(F.lit(1.0), F.round("__whole")) / F.greatest(F.col("__whole"), F.lit(1e-9))
    mid = (F.col("__base") + F.col("__in") - F.col("__len") / 2) * turns
    start = F.pmod(F.xxhash64("band", F.floor(mid), F.lit(seed)), F.lit(10000)) / 10000  # of each turn, lest equal sizes meet the parts alike in all
    tail = tail.withColumn("__ph", F.when(F.col("size") > 0, F.pmod(mid + start, F.lit(1.0))).otherwise(F.pmod("__h", F.lit(10000)) / 10000))
    split, upto = F.lit(None).cast("string"), F.lit(0.0)
    for i, n in enumerate(names):
        upto = upto + F.col("__q")[i]
        split = F.coalesce(split, F.when((F.col("__ph") < upto) & (F.col("__q")[i] > 0), F.lit(n)))
    last = F.element_at(names_col, F.array_position("__q", F.array_max("__q")).cast("int"))
    return head.unionByName(tail.select("root", "size", "band", F.coalesce(split, last).alias("split")))


def grouped_splits(sizes: DataFrame, roots: DataFrame, entity: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """(entity, root, split) for each entity of sizes (entity, size): entities of one root share one split.

    An entity without links is its own root. Null entities are left to the caller (see split_rows).
    """
    known = sizes.filter(F.col(entity).isNotNull()).join(roots, F.col(entity) == F.col("node"), "left").select(entity, F.coalesce("root", entity).alias("root"), "size")
    given = deal(known.groupBy("root").agg(F.sum("size").alias("size")), shares, seed).select(F.col("root").alias("__root"), "split")
    return known.join(given, F.col("root") == F.col("__root")).select(entity, "root", "split")


def split_rows(rows: DataFrame, assignment: DataFrame, entity: str, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """rows with their entity's split. A row without an entity is related to none and is dealt alone, by its hash."""
    u = F.pmod(F.xxhash64(F.struct("*"), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    names, upto, alone = list(shares), 0.0, F.lit(list(shares)[-1])
    for n in reversed(names):
        upto = sum(shares[m] for m in names[: names.index(n) + 1])
        alone = F.when(u < upto, F.lit(n)).otherwise(alone)
    given = assignment.select(F.col(entity).alias("__ent"), F.col("split").alias("__split"))
    out = rows.join(given, F.col(entity) == F.col("__ent"), "left")
    return out.withColumn("split", F.when(F.col(entity).isNull(), alone).otherwise(F.col("__split"))).drop("__ent", "__split")
