"""Costs of travel, room and layout plans, and searches for the cheapest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import save as _durable


def numbered_flights(flights: DataFrame, order: list[str], chunks: int = 512) -> DataFrame:
    """Flights with idx, their place (from 0) within origin and destination in a given order, whose first column is a
    number. Chunks of that order are numbered apart, from where the chunks before them end, so that no task sorts a route."""
    at = [i / chunks for i in range(1, chunks)]
    bounds = flights.agg(F.array_distinct(F.percentile_approx(order[0], at, 10_000)).alias("bounds"))  # one row
    key = F.col(order[0])
    cut = flights.join(F.broadcast(bounds)).withColumn("chunk", F.coalesce(F.size(F.filter("bounds", lambda b: b <= key)), F.lit(-1))).drop("bounds")
    sizes = cut.groupBy("origin", "dest", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("origin", "dest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("origin", "dest", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("origin", "dest", "chunk").orderBy(*order)) - 1
    return cut.withColumn("place", place).join(starts, ["origin", "dest", "chunk"]).withColumn("idx", (F.col("start") + F.col("place")).cast("int")).drop("chunk", "place", "start")


def wrapped(candidates: DataFrame, people: DataFrame, flights: DataFrame, dest: str) -> DataFrame:
    """Candidates whose genes count on from a route's first flight after its last one, so that any whole number picks a
    flight of any route. A route without flights keeps its genes."""
    sizes = flights.groupBy("origin", "dest").agg(F.count("*").alias("n"))
    genes = candidates.select("cand_id", F.posexplode("genes").alias("g", "gene")).withColumn("pos", F.floor(F.col("g") / 2))
    there = F.col("g") % 2 == 0
    rows = genes.join(people.select("pos", F.col("origin").alias("home")), "pos")
    rows = rows.select("cand_id", "g", "gene", F.when(there, F.col("home")).otherwise(F.lit(dest)).alias("origin"), F.when(there, F.lit(dest)).otherwise(F.col("home")).alias("dest"))
    rows = rows.join(sizes, ["origin", "dest"], "left").select("cand_id", "g", F.coalesce(F.pmod("gene", "n"), "gene").cast("int").alias("gene"))
    return rows.groupBy("cand_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "gene"))), lambda x: x["gene"]).alias("genes"))


def plan_flights(candidates: DataFrame, people: DataFrame, flights: DataFrame, dest: str) -> DataFrame:
    """(cand_id, name, out, back), a row for each person of each of candidates(cand_id, genes): gene 2i picks the
    flight of person i to the destination, gene 2i + 1 the one back. people(pos, name, origin). The tables of people
    and flights are dimensions that Spark broadcasts under its threshold."""
    genes = candidates.select("cand_id", F.posexplode("genes").alias("g", "idx"))
    rows = genes.select("cand_id", F.floor(F.col("g") / 2).alias("pos"), (F.col("g") % 2).alias("way"), F.col("idx").cast("int").alias("idx")).join(people, "pos")
    origin = F.when(F.col("way") == 0, F.col("origin")).otherwise(F.lit(dest))
    target = F.when(F.col("way") == 0, F.lit(dest)).otherwise(F.col("origin"))
    rows = rows.select("cand_id", "pos", "name", "way", "idx", origin.alias("o"), target.alias("d"))
    f = flights.select(F.col("origin").alias("o"), F.col("dest").alias("d"), "idx", F.struct("depart_min", "arrive_min", "price").alias("flight"))
    picked = rows.join(f, ["o", "d", "idx"])
    return picked.groupBy("cand_id", "pos", "name").agg(F.max(F.when(F.col("way") == 0, F.col("flight"))).alias("out"), F.max(F.when(F.col("way") == 1, F.col("flight"))).alias("back"))


def plan_cost(plan: DataFrame) -> DataFrame:
    """(cand_id, cost) of J9: prices, half of each minute in the air, 20 for each start before 8:00, each minute of
    waiting for the last arrival and from the first return, and 50 where the last arrival is after the first return."""
    air = (F.col("out.arrive_min") - F.col("out.depart_min")) + (F.col("back.arrive_min") - F.col("back.depart_min"))
    early = (F.col("out.depart_min") < 480).cast("int") + (F.col("back.depart_min") < 480).cast("int")
    n, last, first = F.count("*"), F.max("out.arrive_min"), F.min("back.depart_min")
    wait = n * last - F.sum("out.arrive_min") + F.sum("back.depart_min") - n * first
    return plan.groupBy("cand_id").agg((F.sum(F.col("out.price") + F.col("back.price")) + 0.5 * F.sum(air) + 20 * F.sum(early) + wait + F.when(last > first, 50).otherwise(0)).alias("cost"))


def cheapest_plan(costs: DataFrame) -> DataFrame:
    """The candidate with the lowest cost, ties to the smaller id."""
    return costs.orderBy("cost", "cand_id").limit(1)


def plan_detail(plan: DataFrame, best: DataFrame) -> DataFrame:
    """A row for each person of the chosen plan with both flights."""
    rows = plan.join(F.broadcast(best.select("cand_id")), "cand_id", "left_semi")
    return rows.select("name", F.col("out.depart_min").alias("out_depart"), F.col("out.arrive_min").alias("out_arrive"), F.col("out.price").alias("out_price"), F.col("back.depart_min").alias("back_depart"), F.col("back.arrive_min").alias("back_arrive"), F.col("back.price").alias("back_price"))


def dorm_slots(genes: Column, rooms: list[str], per_room: int = 2) -> Column:
    """H3: rooms that genes pick from a shrinking list of slots, in order; a gene beyond the list picks the last slot."""
    slots = F.array(*[F.lit(r) for r in rooms for _ in range(per_room)])
    start = F.struct(slots.alias("left"), F.array().cast("array<string>").alias("picked"))

    def take(acc: Column, g: Column) -> Column:
        at = F.least(g.cast("int"), F.size(acc["left"]) - 1) + 1
        left = F.concat(F.slice(acc["left"], F.lit(1), at - 1), F.slice(acc["left"], at + 1, F.greatest(F.size(acc["left"]) - at, F.lit(0))))
        return F.struct(left.alias("left"), F.concat(acc["picked"], F.array(F.element_at(acc["left"], at))).alias("picked"))

    return F.aggregate(genes, start, take)["picked"]


def dorm_cost(candidates: DataFrame, prefs: DataFrame, rooms: list[str], per_room: int = 2) -> DataFrame:
    """(cand_id, cost): 0 for each first choice, 1 for each second, else 3. prefs(pos, first, second)."""
    picked = candidates.select("cand_id", F.posexplode(dorm_slots(F.col("genes"), rooms, per_room)).alias("pos", "room"))
    rows = picked.join(prefs, "pos")
    return rows.groupBy("cand_id").agg(F.sum(F.when(F.col("room") == F.col("first"), 0).when(F.col("room") == F.col("second"), 1).otherwise(3)).alias("cost"))


def segment_crossings(layouts: DataFrame, links: DataFrame) -> DataFrame:
    """(cand_id, crossings): pairs of links whose lines cross strictly inside both. layouts(cand_id, name, x, y),
    links(idx, a, b)."""
    p, q = layouts.select("cand_id", F.col("name").alias("a"), F.col("x").alias("x1"), F.col("y").alias("y1")), layouts.select("cand_id", F.col("name").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    segments = links.join(p, "a").join(q, ["cand_id", "b"]).select("cand_id", "idx", "x1", "y1", "x2", "y2")
    other = segments.select("cand_id", *[F.col(c).alias(c + "_") for c in ("idx", "x1", "y1", "x2", "y2")])
    pairs = segments.join(other, "cand_id").where("idx < idx_")
    den = (F.col("y2_") - F.col("y1_")) * (F.col("x2") - F.col("x1")) - (F.col("x2_") - F.col("x1_")) * (F.col("y2") - F.col("y1"))
    ua = F.try_divide((F.col("x2_") - F.col("x1_")) * (F.col("y1") - F.col("y1_")) - (F.col("y2_") - F.col("y1_")) * (F.col("x1") - F.col("x1_")), F.nullif(den, F.lit(0.0)))
    ub = F.try_divide((F.col("x2") - F.col("x1")) * (F.col("y1") - F.col("y1_")) - (F.col("y2") - F.col("y1")) * (F.col("x1") - F.col("x1_")), F.nullif(den, F.lit(0.0)))
    cross = (ua > 0) & (ua < 1) & (ub > 0) & (ub < 1)
    return pairs.groupBy("cand_id").agg(F.sum(F.when(cross, 1).otherwise(0)).alias("crossings"))


def layout_cost(layouts: DataFrame, links: DataFrame, penalty_repeats: int = 1) -> DataFrame:
    """(cand_id, cost): crossings, and 1 - d / 50 for each pair of nodes nearer than 50, counted `penalty_repeats` times."""
    a, b = layouts.select("cand_id", "name", "x", "y"), layouts.select("cand_id", F.col("name").alias("n2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    near = a.join(b, "cand_id").where("name < n2").groupBy("cand_id").agg(F.sum(F.when(d < 50, 1 - d / 50).otherwise(0.0)).alias("near"))
    return near.join(segment_crossings(layouts, links), "cand_id", "left").select("cand_id", (F.coalesce("crossings", F.lit(0)) + penalty_repeats * F.col("near")).alias("cost"))


def random_candidates(spark, n: int, genes: int, most: int, seed: int = 1) -> DataFrame:
    """Candidates with uniform genes from 0 to `most`."""
    return spark.range(n).select(F.col("id").alias("cand_id"), F.array(*[F.floor(F.rand(seed + i) * (most + 1)).cast("int") for i in range(genes)]).alias("genes"))


def neighbours(starts: DataFrame, most: int) -> DataFrame:
    """(start, genes): each start and its genes moved by one, inside the bounds."""
    moves = F.flatten(F.transform(F.sequence(F.lit(0), F.size("genes") - 1), lambda i: F.array(*[F.transform("genes", lambda g, k: F.when(k == i, F.greatest(F.least(g + s, F.lit(most)), F.lit(0))).otherwise(g)) for s in (-1, 1)])))
    return starts.select("start", F.explode(F.concat(F.array("genes"), moves)).alias("genes")).distinct()


def hill_climb(starts: DataFrame, cost, most: int, rounds: int = 20) -> DataFrame:
    """(start, genes, cost): each start moves to its best neighbour until none is better. cost takes
    candidates(cand_id, genes) and returns (cand_id, cost); all starts and neighbours of a round are one job."""
    before = None
    for _ in range(rounds):
        tried = neighbours(starts, most).withColumn("cand_id", F.xxhash64("start", F.col("genes").cast("string")))
        tried = _durable(tried)
        priced = tried.join(cost(tried.select("cand_id", "genes")), "cand_id")
        best = _durable(priced.groupBy("start").agg(F.min(F.struct("cost", "genes")).alias("b")).select("start", "b.genes", "b.cost"))
        total = best.agg(F.sum("cost")).first()[0]
        if total == before:
            return best
        before, starts = total, best.select("start", "genes")
    return best


def anneal(starts: DataFrame, cost, most: int, temperature: float = 10_000.0, cool: float = 0.5, seed: int = 1) -> DataFrame:
    """(start, genes, cost): chains in parallel. In each step every chain tries one gene moved by one, and takes it
    if it is cheaper or by chance e^(-difference / temperature); the best plan a chain met is returned."""
    now = starts.select("start", "genes")
    here = _durable(now.join(cost(now.select(F.col("start").alias("cand_id"), "genes")).withColumnRenamed("cand_id", "start"), "start"))
    best, step = here, 0
    while temperature > 0.1:
        u = lambda k: F.pmod(F.xxhash64("start", F.lit(seed), F.lit(step), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0  # noqa: B023, E731
        at, way = F.floor(u(1) * F.size("genes")).cast("int"), F.when(u(2) < 0.5, -1).otherwise(1)
        moved = here.select("start", F.transform("genes", lambda g, i: F.when(i == at, F.greatest(F.least(g + way, F.lit(most)), F.lit(0))).otherwise(g)).alias("next"))
        priced = moved.join(cost(moved.select(F.col("start").alias("cand_id"), F.col("next").alias("genes"))).select(F.col("cand_id").alias("start"), F.col("cost").alias("after")), "start")
        both = here.join(priced, "start")
        take = (F.col("after") < F.col("cost")) | (u(3) < F.exp(-(F.col("after") - F.col("cost")) / temperature))
        here = _durable(both.select("start", F.when(take, F.col("next")).otherwise(F.col("genes")).alias("genes"), F.when(take, F.col("after")).otherwise(F.col("cost")).alias("cost")))
        best = _durable(best.unionByName(here).groupBy("start").agg(F.min(F.struct("cost", "genes")).alias("b")).select("start", "b.genes", "b.cost"))
        temperature, step = temperature * cool, step + 1
    return best


def genetic(spark, cost, genes: int, most: int, population: int = 50, elite: float = 0.2, mutation: float = 0.2, rounds: int = 5, seed: int = 1) -> DataFrame:
    """(cand_id, genes, cost): scored populations; the elite stays, the rest are mutations of one of the elite or
    crossings of two, drawn by hashes of their number."""
    people = random_candidates(spark, population, genes, most, seed)
    keep = max(1, int(population * elite))
    for r in range(rounds):
        scored = _durable(people.join(cost(people), "cand_id"))
        ranked = _durable(scored.orderBy("cost", "cand_id").limit(keep).withColumn("rank", F.row_number().over(Window.orderBy("cost", "cand_id")) - 1))  # the elite, a few rows
        if r == rounds - 1:
            return ranked.select("cand_id", "genes", "cost")
        u = lambda k: F.pmod(F.xxhash64("cand_id", F.lit(seed), F.lit(r), F.lit(k)), F.lit(1_000_003)) / 1_000_003.0  # noqa: B023, E731
        children = spark.range(keep, population).select(F.col("id").alias("cand_id"))
        a = ranked.select(F.col("rank").alias("ra"), F.col("genes").alias("ga"))
        b = ranked.select(F.col("rank").alias("rb"), F.col("genes").alias("gb"))
        drawn = children.select("cand_id", F.floor(u(1) * keep).cast("int").alias("ra"), F.floor(u(2) * keep).cast("int").alias("rb"), (u(3) < mutation).alias("mutate"), F.floor(u(4) * genes).cast("int").alias("at"), F.when(u(5) < 0.5, -1).otherwise(1).alias("way"))
        drawn = drawn.join(F.broadcast(a), "ra").join(F.broadcast(b), "rb")
        made = F.when(F.col("mutate"), F.transform("ga", lambda g, i: F.when(i == F.col("at"), F.greatest(F.least(g + F.col("way"), F.lit(most)), F.lit(0))).otherwise(g))).otherwise(F.concat(F.slice("ga", F.lit(1), F.col("at")), F.slice("gb", F.col("at") + 1, F.lit(genes))))
        people = _durable(ranked.select(F.col("rank").cast("long").alias("cand_id"), "genes").unionByName(drawn.select("cand_id", made.alias("genes"))))
    return people
