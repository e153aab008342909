"""Upkeep of the index: splits, repairs, merges, rebalancing and rebuilding, each a pass over the partitions it touches.

What travels to the driver has a row for each partition (sizes, centroids), never for a vector.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.arrow import matrix
from ..sources.scratch import stored
from . import kernels, kmeans, knn
from .index import Index, build, centroid_table, in_order

#: (vectors, places, passes, members and sums of all places where the vectors are one block of more) -> places.
Kernel = Callable[[np.ndarray, np.ndarray, int, kernels.Start | None], np.ndarray]
#: Members that a task improves at a time.
BLOCK = 16_384


def neighbours(index: Index, n: int) -> DataFrame:
    """cluster, rank, neighbour, distance: the n nearest other centroids of each, empty partitions included."""
    table = centroid_table(index.postings.sparkSession, index.centroids)
    found = knn.exact(table.select(F.col("cluster").alias("qid"), F.col("centroid").alias("vec")), table.select(F.col("cluster").alias("id"), F.col("centroid").alias("vec")), n, "l2", exclude_self=True)
    return found.select(F.col("qid").alias("cluster"), "rank", F.col("id").alias("neighbour"), "distance")


def halves_by_place(postings: DataFrame, places: DataFrame, least: int = 4) -> DataFrame:
    """``halves`` in order of places (id, cluster, pos) that are kept as members come and go (``operators.positions``)."""
    placed = postings.select("id", "cluster", "vec").join(places.select("id", "cluster", "pos"), ["id", "cluster"])
    n = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)  # a row for each partition
    return placed.join(F.broadcast(n), "cluster").withColumn("side", F.when(F.col("pos") < F.floor(F.col("n") / 2), 0).otherwise(1)).select("id", "cluster", "pos", "vec", "side")


def halves(postings: DataFrame, least: int = 4) -> DataFrame:
    """id, cluster, pos, vec and side: 0 for the first half in order of id, 1 for the rest; partitions under ``least`` members are left out."""
    return in_order(postings).where(F.col("n") >= least).withColumn("side", F.when(F.col("pos") < F.floor(F.col("n") / 2), 0).otherwise(1)).drop("n")


def _sums(members: DataFrame, places: int) -> dict[int, kernels.Start]:
    """Members and vector sums of each group's places: a row for each place comes to the driver."""
    rows = kmeans.statistics(members.select((F.col("grp") * places + F.col("place")).alias("cluster"), "vec")).select("cluster", "n", "a").collect()
    out: dict[int, kernels.Start] = {}
    for r in rows:
        grp, place = divmod(r["cluster"], places)
        n, a = out.setdefault(grp, (np.zeros(places), np.zeros((places, len(r["a"])))))
        n[place], a[place] = r["n"], r["a"]
    return out


def improved(members: DataFrame, kernel: Kernel, places: int, passes: int, worth: Callable[[np.ndarray, np.ndarray], float] = kernels.worth) -> DataFrame:
    """``members`` (id, grp, first, pos, place, vec) at the places that a kernel gives, each group by itself in order of (first, pos).

    No task holds more than a block of about BLOCK members. A group of one block takes its passes in one task. In a larger one
    each pass starts from the sums of the whole group, blocks move their members side by side, and sums are taken anew; the
    first pass that doesn't raise the group's worth is left out and ends it.
    """

    def step(table: DataFrame, turns: int, start: dict[int, kernels.Start] | None) -> DataFrame:
        def run(rows: pa.Table) -> pa.Table:
            grp = rows["grp"][0].as_py()
            if start is not None and grp not in start:
                return rows
            rows = rows.sort_by([("first", "ascending"), ("pos", "ascending")])
            to = kernel(matrix(rows["vec"]), rows["place"].to_numpy().astype(int), turns, start and start[grp])
            return rows.set_column(rows.schema.get_field_index("place"), "place", pa.array(to.astype(np.int64)))

        return table.groupBy("grp", "block").applyInArrow(run, table.schema)

    own = members.select(*[F.col(c).cast("long").alias(c) for c in ("id", "grp", "first", "pos", "place")], "vec", F.lit(0).cast("long").alias("block"))
    blocks = {r["grp"]: -(-r["n"] // BLOCK) for r in own.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = {g: b for g, b in blocks.items() if b > 1}
    if not many:
        return step(own, passes, None).drop("block")
    large = F.col("grp").isin(list(many))
    n = F.create_map(*[F.lit(x).cast("long") for gb in many.items() for x in gb])
    table = stored(own.where(large).withColumn("block", F.pmod(F.xxhash64("id"), n[F.col("grp")])))
    sums = _sums(table, places)
    for _ in range(passes):
        after = stored(step(table, 1, sums))
        then = _sums(after.where(F.col("grp").isin(list(sums))), places)
        sums = {g: then[g] for g in sums if worth(*then[g]) > worth(*sums[g])}
        if not sums:
            break
        better = F.col("grp").isin(list(sums))
        table = after.where(better).union(table.where(~better))
    return step(own.where(~large), passes, None).union(table).drop("block")


def sides(halved: DataFrame, kernel: Kernel = kernels.two_way, passes: int = 5, worth: Callable[[np.ndarray, np.ndarray], float] = kernels.worth) -> DataFrame:
    """halved with the sides that a kernel gives each partition's members, in order of pos."""
    members = halved.select("id", F.col("cluster").alias("grp"), F.lit(0).alias("first"), "pos", F.col("side").alias("place"), "vec")
    return improved(members, kernel, 2, passes, worth).select("id", F.col("grp").alias("cluster"), "pos", "vec", F.col("place").cast("int").alias("side"))


def oversize(index: Index) -> list[int]:
    return [r["cluster"] for r in index.sizes().where(F.col("n") > index.split_above).orderBy("cluster").collect()]


def _refreshed(postings: DataFrame, centroids: dict[int, list[float]], clusters: list[int]) -> dict[int, list[float]]:
    """Centroids of some partitions at their members' mean; an empty one keeps its centroid."""
    return {**centroids, **kmeans.means(kmeans.statistics(postings.where(F.col("cluster").isin(clusters))))}


def split(index: Index, which: list[int], kernel: Kernel = kernels.two_way, passes: int = 5, worth: Callable[[np.ndarray, np.ndarray], float] = kernels.worth) -> tuple[Index, dict[int, int]]:
    """Split partitions in two; side 1 becomes a new partition. The default kernel is coordinate descent from the halves, which no passes leave as they are."""
    new = {c: max(index.centroids) + 1 + i for i, c in enumerate(sorted(which))}
    if not new:
        return index, {}
    mine = F.col("cluster").isin(list(new))
    dealt = sides(halves(index.postings.where(mine)), kernel, passes, worth)
    names = F.create_map(*[F.lit(x).cast("long") for kv in new.items() for x in kv])
    moved = dealt.select("id", F.when(F.col("side") == 1, names[F.col("cluster")]).otherwise(F.col("cluster")).alias("cluster"), "vec")
    small = index.postings.where(mine).join(dealt.select("id"), "id", "left_anti").select("id", "cluster", "vec")
    centroids = {**index.centroids, **{n: index.centroids[c] for c, n in new.items()}}
    after = index.changed(stored(moved.union(small)), list(new))
    return replace(after, centroids=_refreshed(after.postings, centroids, [*new, *new.values()])).counted(splits=len(new)), new


def _near(centroids: dict[int, list[float]], to: list[float], leave: set[int], n: int) -> list[int]:
    far = {c: float(((np.array(v) - np.array(to)) ** 2).sum()) for c, v in centroids.items() if c not in leave}
    return sorted(far, key=lambda c: (far[c], c))[:n]


def mem_only_split(index: Index, which: list[int]) -> Index:
    """Split into the two halves as they stand, then give the members of both and of their neighbourhood to the nearest of all centroids."""
    return lire_split(index, which, rounds=0)


def lire_split(index: Index, which: list[int], rounds: int = 10, around: int | None = None) -> Index:
    """Split by two-means, then give every member of the halves and their ``around`` nearest partitions to its nearest centroid of all."""
    after, new = split(index, which, kernels.two_means, rounds)
    around = index.config.neighbours if around is None else around
    if not new or not around:
        return after
    touched = sorted({x for c, n in new.items() for x in (c, n, *_near(after.centroids, after.centroids[c], {c, n}, around))})
    return repaired(after, touched)


def repaired(index: Index, clusters: list[int]) -> Index:
    """Members of some partitions moved to their nearest centroid (centroids stay until all have moved)."""
    mine = F.col("cluster").isin(clusters)
    checked = stored(knn.nearest(index.postings.where(mine).withColumnRenamed("cluster", "held"), index.centroids, index.config.metric).select("id", "cluster", "held", "vec"))
    moved = checked.where("cluster <> held").count()
    after = index.changed(checked, clusters)
    return replace(after, centroids=_refreshed(after.postings, index.centroids, clusters)).counted(reassigned=moved)


def neighbourhoods(index: Index, pairs: list[tuple[int, int]], n: int) -> list[list[int]]:
    """For each two partitions: they and the n non-empty ones nearest to the middle of their centroids."""
    live = {r["cluster"] for r in index.sizes().collect()}
    out = []
    for pair in pairs:
        a, b = (np.array(index.centroids[c]) for c in pair)
        out.append([*pair, *_near({c: v for c, v in index.centroids.items() if c in live}, ((a + b) / 2).tolist(), set(pair), n)])
    return out


def neighbourhood(index: Index, clusters: tuple[int, int], n: int) -> list[int]:
    return neighbourhoods(index, [clusters], n)[0]


def coloured(groups: list[list[int]]) -> list[list[list[int]]]:
    """The groups in rounds in which no two share a member: each in the first round, in the order given, that it fits in."""
    rounds: list[tuple[set[int], list[list[int]]]] = []
    for group in groups:
        for held, own in rounds:
            if held.isdisjoint(group):
                held.update(group)
                own.append(group)
                break
        else:
            rounds.append((set(group), [group]))
    return [own for _, own in rounds]


def local_repairs(index: Index, groups: list[list[int]], passes: int = 5, live_means: bool = False) -> Index:
    """Coordinate descent over groups of partitions that share none, each by itself, all at once; in blocks.

    ``live_means``: one pass to the nearest mean instead.
    """
    near = sorted({c for g in groups for c in g})
    at = F.create_map(*[F.lit(x).cast("long") for i, g in enumerate(groups) for j, c in enumerate(g) for x in (c, i * len(near) + j)])[F.col("cluster")]
    most = max(map(len, groups))
    held = index.postings.where(F.col("cluster").isin(near)).withColumn("at", at)
    gathered = held.select("id", F.floor(F.col("at") / len(near)).alias("grp"), (F.col("at") % len(near)).alias("first"), F.col("id").alias("pos"), (F.col("at") % len(near)).alias("place"), "vec")
    after = None
    for places in sorted({len(g) for g in groups}):  # a group has no more places than partitions

        def kernel(x: np.ndarray, to: np.ndarray, turns: int, start: kernels.Start | None, places: int = places) -> np.ndarray:
            return kernels.nearest_live(x, to, places, start) if live_means else kernels.local(x, to, places, turns, start)

        own = [i for i, g in enumerate(groups) if len(g) == places]
        found = improved(gathered.where(F.col("grp").isin(own)), kernel, places, 1 if live_means else passes)
        after = found if after is None else after.union(found)
    names = F.array(*(F.array(*(F.lit(c).cast("long") for c in [*g, *[-1] * (most - len(g))])) for g in groups))
    moved = stored(after.select("id", names[F.col("grp").cast("int")][F.col("place").cast("int")].alias("cluster"), "vec"))
    index = index.changed(moved, near)
    return replace(index, centroids=_refreshed(index.postings, index.centroids, near))


def local_repair(index: Index, clusters: tuple[int, int], n: int = 5, passes: int = 5, live_means: bool = False) -> Index:
    """``local_repairs`` of a split's neighbourhood of n + 2 partitions."""
    return local_repairs(index, [neighbourhood(index, clusters, n)], passes, live_means)


def local_split(index: Index, which: list[int], n: int = 5, passes: int = 5) -> Index:
    """Split partitions, then repair the neighbourhood of each split, in rounds of those that share no partition."""
    index, new = split(index, which, passes=passes)
    for groups in coloured(neighbourhoods(index, sorted(new.items()), n)):
        index = local_repairs(index, groups, passes)
    return index


def boundary_sample(index: Index, clusters: tuple[int, int], n: int = 2, samples: int = 4) -> DataFrame:
    """cluster, rank, id, gap, vec: members of the n nearest partitions that stand most nearly between the two centroids."""
    near = neighbourhood(index, clusters, n)[2:]
    d1, d2 = (V.squared_l2(F.col("vec"), F.array(*map(F.lit, index.centroids[c]))) for c in clusters)
    found = index.postings.where(F.col("cluster").isin(near)).withColumn("gap", F.abs(d1 - d2)).withColumn("least", F.least(d1, d2))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("gap", "least", "id")).cast("long")
    return found.withColumn("rank", rank).where(F.col("rank") <= samples).select("cluster", "rank", "id", "gap", "vec")


def boundary_split(index: Index, cluster: int, n: int = 2, samples: int = 4, passes: int = 5) -> Index:
    """Split one partition while sampled neighbours weigh on the halves as ghosts (their number is bounded by n x samples)."""
    plain, new = split(index, [cluster], passes=0)
    ghosts = np.array([r["vec"] for r in boundary_sample(plain, (cluster, new[cluster]), n, samples).orderBy("cluster", "rank").collect()])

    def worth(n: np.ndarray, a: np.ndarray) -> float:
        held = kernels.dealt(ghosts, n, a)
        return kernels.worth(n + held.n, a + held.a)

    kernel = lambda x, side, turns, start: kernels.two_way(x, side, turns, start, ghosts)
    return split(index, [cluster], kernel, passes, worth if len(ghosts) else kernels.worth)[0].counted(ghosts=len(ghosts))


def sampled_repair(index: Index, cluster: int, n: int = 2, samples: int = 4, passes: int = 5) -> Index:
    """Split one partition while sampled neighbours may join a half where that gains."""
    plain, new = split(index, [cluster], passes=0)
    pair = (cluster, new[cluster])
    sample = boundary_sample(plain, pair, n, samples).select("id", "vec", F.lit(2).alias("place"))
    own = plain.postings.where(F.col("cluster").isin(list(pair))).select("id", "vec", F.when(F.col("cluster") == cluster, 0).otherwise(1).alias("place"))

    members = own.union(sample.select("id", "vec", "place")).select("id", F.lit(0).alias("grp"), F.col("place").alias("first"), F.col("id").alias("pos"), "place", "vec")
    moved = improved(members, kernels.adopting, 3, passes, lambda n, a: kernels.worth(n[:2], a[:2])).where("place < 2").select("id", "place")
    to = F.when(F.col("place") == 0, cluster).when(F.col("place") == 1, pair[1]).otherwise(F.col("cluster"))
    near = neighbourhood(plain, pair, n)
    held = plain.postings.where(F.col("cluster").isin(near))
    after = plain.changed(stored(held.join(moved, "id", "left").select("id", to.cast("long").alias("cluster"), "vec")), near)
    return replace(after, centroids=_refreshed(after.postings, plain.centroids, near))


def merge_targets(index: Index) -> DataFrame:
    """cluster, n, target of the partitions under the merge bound: the nearest other centroid, empty partitions included."""
    small = index.sizes().where(F.col("n") < index.merge_below)
    return small.join(neighbours(index, 1).select("cluster", F.col("neighbour").alias("target")), "cluster").select("cluster", "n", "target")


def merge(index: Index) -> Index:
    """Give the members of each partition under the bound to its target, smallest cluster first; emptied ones keep their centroid."""
    to: dict[int, int] = {}
    for r in merge_targets(index).orderBy("cluster").collect():
        if r["cluster"] not in to.values():  # a partition that has just received members waits for the next pass
            to[r["cluster"]] = to.get(r["target"], r["target"])
    to = {c: t for c, t in to.items() if t != c}
    if not to:
        return index
    names = F.create_map(*[F.lit(x).cast("long") for kv in to.items() for x in kv])
    touched = sorted({*to, *to.values()})
    held = index.postings.where(F.col("cluster").isin(touched))
    after = index.changed(held.select("id", F.coalesce(names[F.col("cluster")], F.col("cluster")).alias("cluster"), "vec"), touched)
    return replace(after, centroids=_refreshed(after.postings, index.centroids, sorted(set(to.values())))).counted(merges=len(to))


def rebalance_choice(index: Index, k2: int | None = None) -> DataFrame:
    """cluster, n, part (largest or smallest) of the partitions that a rebalancing pools; none where fewer than five hold members."""
    k2 = k2 or index.config.rebalance_k
    sizes = index.sizes()
    m = sizes.count()
    k = min(k2 // 2, m // 2) if m >= 5 else 0
    # a row for each partition, so one task orders them
    ranked = sizes.withColumn("head", F.row_number().over(Window.orderBy(F.desc("n"), "cluster"))).withColumn("tail", m + 1 - F.col("head"))
    return ranked.where((F.col("head") <= k) | (F.col("tail") <= k)).select("cluster", "n", F.when(F.col("head") <= k, "largest").otherwise("smallest").alias("part"))


def rebalance(index: Index, k2: int | None = None) -> Index:
    """Cluster the members of the largest and smallest partitions anew into as many partitions."""
    chosen = [r["cluster"] for r in rebalance_choice(index, k2).orderBy(F.desc("n"), "cluster").collect()]
    mine = F.col("cluster").isin(chosen)
    pool = index.postings.where(mine).select("id", "vec")
    if not chosen or pool.count() < 2 * len(chosen):
        return index
    found = kmeans.lloyd(pool, kmeans.first_seeds(pool, len(chosen)), 10)
    centroids = {**index.centroids, **dict(zip(chosen, found.values(), strict=True))}
    dealt = knn.nearest(pool, {c: centroids[c] for c in chosen}).select("id", "cluster", "vec")
    after = index.changed(dealt, chosen)
    return replace(after, centroids=_refreshed(after.postings, centroids, chosen)).counted(rebalanced=1)


def inserted(index: Index, vectors: DataFrame, move_centroids: bool = False) -> Index:
    """New vectors (id, vec) in their nearest partitions, all judged by the centroids before them; with ``move_centroids`` these follow."""
    fresh = knn.nearest(vectors.select("id", "vec"), index.centroids, index.config.metric)
    return _followed(index.changed(fresh)) if move_centroids else index.changed(fresh)


def _followed(index: Index) -> Index:
    return replace(index, centroids={**index.centroids, **kmeans.means(kmeans.statistics(index.postings))})


def deleted(index: Index, ids: DataFrame, move_centroids: bool = False) -> Index:
    """Without some ids; unknown ids don't matter."""
    after = index.changed(gone=ids)
    return _followed(after) if move_centroids else after


def rebuilt(index: Index) -> Index:
    """Clustered anew from the live vectors, with as many partitions as configured."""
    vectors = index.postings.select("id", "vec")
    return build(vectors, index.config) if vectors.count() >= 2 * index.config.nlist else index


def splits_due(step: Callable[[Index, list[int]], Index]) -> Callable[[Index], Index]:
    """``step`` over all partitions above the bound, again until there is none; one that a step leaves no smaller isn't asked again."""

    def due(index: Index) -> Index:
        held: set[int] = set()
        while True:
            before = {r["cluster"]: r["n"] for r in index.sizes().where(F.col("n") > index.split_above).collect()}
            which = sorted(c for c, n in before.items() if c not in held and n >= 4)
            if not which:
                return index
            index = step(index, which)
            after = {r["cluster"]: r["n"] for r in index.sizes().where(F.col("cluster").isin(which)).collect()}
            held |= {c for c in which if after.get(c, 0) >= before[c]}

    return due


def merges_due(index: Index) -> Index:
    """Merges, again while they leave fewer partitions with members."""
    filled = index.sizes().count()
    while True:
        index = merge(index)
        now = index.sizes().count()
        if now >= filled:
            return index
        filled = now


def one_after_another(step: Callable[[Index, int], Index]) -> Callable[[Index, list[int]], Index]:
    """A step of one partition, over several in order."""

    def over(index: Index, which: list[int]) -> Index:
        for c in which:
            index = step(index, c)
        return index

    return over


def every(step: Callable[[Index], Index], counter: str, period: str) -> Callable[[Index], Index]:
    """``step`` where a counter has reached the next multiple of a period of the configuration, once however many it has passed."""

    def due(index: Index) -> Index:
        reached = index.counters.get(counter, 0) // getattr(index.config, period)
        done = f"{counter}_done"
        if reached <= index.counters.get(done, 0):
            return index
        after = step(index)
        return replace(after, counters={**index.counters, **after.counters, done: reached})

    return due


def rebalances_due(index: Index) -> Index:
    """Rebalancing after a batch that held deletes, or whose inserts reach the period."""
    deletes = index.counters.get("deletes", 0)
    if deletes <= index.counters.get("deletes_done", 0):
        return every(rebalance, "inserts", "rebalance_every")(index)
    after = rebalance(index)
    reached = index.counters.get("inserts", 0) // index.config.rebalance_every
    return replace(after, counters={**index.counters, **after.counters, "deletes_done": deletes, "inserts_done": reached})


def _maintained(step: Callable[[Index, list[int]], Index]) -> Callable[[Index], Index]:
    return lambda index: merges_due(splits_due(step)(index))


#: What a policy does after a batch of updates.
POLICIES: dict[str, Callable[[Index], Index]] = {
    "frozen": lambda index: index,
    "rebuild": every(rebuilt, "operations", "rebuild_every"),
    "updatecentroids": lambda index: index,
    "lire": _maintained(lire_split),
    "dedrift": rebalances_due,
    "scdkm": _maintained(lambda index, which: split(index, which)[0]),
    "memonly": _maintained(mem_only_split),
    "localcdkm": _maintained(local_split),
    "bscdkm": _maintained(one_after_another(boundary_split)),
    "srcdkm": _maintained(one_after_another(sampled_repair)),
}
ALIASES = {"scdkmonly": "scdkm", "spfresh": "lire"}
#: Policies whose centroids never follow updates.
STILL = {"frozen", "rebuild"}
#: Policies whose upkeep has a period, for which operations are counted.
PERIODIC = {"rebuild", "dedrift"}


def policy(name: str) -> Callable[[Index, DataFrame, DataFrame], Index]:
    """(index, inserts, deleted ids) -> index after the batch and the policy's upkeep, by a name in any spelling."""
    key = name.lower().translate(str.maketrans("", "", " -_"))
    key = ALIASES.get(key, key)
    if key not in POLICIES:
        raise ValueError(f"unknown policy {name!r}")
    moves = key not in STILL

    def after(index: Index, new: DataFrame, gone: DataFrame) -> Index:
        then = deleted(inserted(index, new, moves), gone, moves)
        if key in PERIODIC:
            inserts, deletes = new.count(), gone.count()
            then = then.counted(inserts=inserts, deletes=deletes, operations=inserts + deletes)
        return POLICIES[key](then)

    return after
