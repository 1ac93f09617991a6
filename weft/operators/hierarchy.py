"""Parent-child rows to full hierarchies, by parallel tree contraction.

Rounds alternate two contractions on the nodes that are left. Raking removes every leaf into its
parent. Compression removes unary nodes (one child, one parent) whose random priority exceeds that of
both neighbours, so that no two neighbours go at once and a chain of length L is gone after O(log L)
rounds. A forest vanishes but for its roots; what cannot vanish is a cycle, which compression shrinks
to one node that is its own parent. Reversing the recorded contractions round by round gives every
removed node its root, depth, path and number of descendants, and every spliced node of a cycle the
key of that cycle. Each round is one written table of the nodes still active, so the total volume is
linear in the nodes and no tree, path or component is gathered anywhere. Where only cycles are wanted,
the last finish_rows nodes, a row of three numbers each, are contracted in one task.

A parent of very many nodes is no hot key: what its children tell it is added up before the shuffle, and
on the way back children of parents with hub_rows children or more are joined to salted copies of them.
A parent that is not in the table takes part as a root of its own and is removed at the end.

Defined cases: a row without id is left out; a repeated id keeps one row (largest parent). A parent
that is null or not in the table makes a root (`missing_parent` marks the latter). Nodes on a cycle
have `cycle_key`, the smallest id on it, and neither root, depth, path nor size; nodes below a cycle
have neither root, depth nor path, but their number of descendants, and in `chain` the ids from the
cycle down to them. One node of each cycle has all its ids in `ring`. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.skew import copied, heavy_groups, salted, without
from weft.plans.stage import counts_of, release, written

KEPT, RAKED, SPLICED, DONE = 0, 1, 2, 3


def _start(edges: DataFrame) -> DataFrame:
    """All nodes with their number of children; parents that are not in the table are roots that are not `real`."""
    nodes = edges.where("id is not null").groupBy("id").agg(F.max("parent").alias("parent")).withColumn("real", F.lit(True))
    nodes = written(nodes, "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    return nodes.join(kids, "id", "full").select(
        "id",
        "parent",
        F.col("parent").alias("boss"),
        F.coalesce("real", F.lit(False)).alias("real"),
        F.coalesce("k", F.lit(0)).alias("k"),
        F.lit(1).cast("bigint").alias("w"),
        F.lit(0).cast("bigint").alias("ew"),
        F.lit(None).cast("bigint").alias("emin"),
        F.lit(1).cast("bigint").alias("dist"),
        F.expr("cast(array() as array<bigint>)").alias("seg"),
    )


def _priority(c: Column, turn: int) -> Column:
    return F.xxhash64(c, F.lit(turn))


def _round(active: DataFrame, turn: int, with_paths: bool) -> DataFrame:
    """One rake and one compression; every active node with what became of it.

    w: nodes of the removed part below and with the node. ew, emin, dist, seg: nodes, smallest id,
    steps and ids (child first) of what was spliced out of the edge to the parent.
    """
    leaf = F.col("k") == 0
    told = (
        active.where("parent is not null and parent <> id")
        .groupBy(F.col("parent").alias("id"))
        .agg(
            F.sum(F.when(leaf, 1).otherwise(0)).alias("leaves"),
            F.sum(F.when(leaf, F.col("w") + F.col("ew")).otherwise(0)).alias("raked"),
            F.max(F.when(~leaf, F.col("id"))).alias("child"),
            F.max(F.when(~leaf, F.col("ew"))).alias("child_ew"),
        )
    )
    b = active.join(told, "id", "left")
    b = b.withColumn("leaves", F.coalesce("leaves", F.lit(0))).withColumn("w", F.col("w") + F.coalesce("raked", F.lit(0)))
    rake = (F.col("k") == 0) & F.col("parent").isNotNull()
    done = ((F.col("k") == 0) & F.col("parent").isNull()) | ((F.col("k") == 1) & (F.col("leaves") == 0) & (F.col("parent") == F.col("id")))
    mine = _priority(F.col("id"), turn)
    splice = (
        (F.col("k") == 1)
        & (F.col("leaves") == 0)
        & F.col("child").isNotNull()
        & (F.col("parent") != F.col("id"))
        & (mine > _priority(F.col("parent"), turn))
        & (mine > _priority(F.col("child"), turn))
    )
    b = b.withColumn("tag", F.when(done, DONE).when(rake, RAKED).when(splice, SPLICED).otherwise(KEPT))
    b = b.withColumn("k", F.col("k") - F.col("leaves")).drop("raked", "leaves")
    out = (
        b.where(F.col("tag") == SPLICED)
        .select(
            F.col("child").alias("id"),
            F.col("id").alias("via"),
            F.col("parent").alias("v_parent"),
            (F.col("w") + F.col("ew")).alias("v_ew"),
            F.least("id", "emin").alias("v_emin"),
            F.col("dist").alias("v_dist"),
            F.col("seg").alias("v_seg"),
        )
    )
    c = b.join(out, "id", "left")
    moved = F.col("via").isNotNull()
    return c.select(
        "id",
        F.when(moved, F.col("v_parent")).otherwise(F.col("parent")).alias("parent"),
        "boss",
        "real",
        "k",
        "w",
        (F.col("ew") + F.coalesce("v_ew", F.lit(0))).alias("ew"),
        F.least("emin", "v_emin").alias("emin"),
        (F.col("dist") + F.coalesce("v_dist", F.lit(0))).alias("dist"),
        (F.when(moved, F.concat("seg", F.array("via"), "v_seg")).otherwise(F.col("seg")) if with_paths else F.col("seg")).alias("seg"),
        "tag",
        "child",
        (F.col("w") + F.col("child_ew")).alias("base"),
    )


def _contract(edges: DataFrame, with_paths: bool, max_rounds: int, enough: int = 0) -> tuple[list[DataFrame], DataFrame | None]:
    """The recorded rounds, and the nodes left when there are at most `enough` (None if there are none)."""
    active, rounds = _start(edges), []
    for turn in range(max_rounds):
        core = (F.col("tag") == DONE) & F.col("parent").isNotNull()
        done = written(_round(active, turn, with_paths), f"round{turn}", kept=F.col("tag") == KEPT, spliced=F.col("tag") == SPLICED, cores=core)
        rounds.append(done)
        active = done.where(F.col("tag") == KEPT).drop("tag", "child", "base")
        if not counts_of(done)["kept"]:
            return rounds, None
        if counts_of(done)["kept"] <= enough:
            return rounds, active
    raise RuntimeError(f"contraction did not end in {max_rounds} rounds")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes (id, parent, emin) on a cycle, with its key: leaves are raked until none is left, then each cycle is followed."""
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    up = {i: p for i, p, _ in rows}
    least = {i: i if e is None else min(i, e) for i, _, e in rows}
    kids = dict.fromkeys(up, 0)
    for p in up.values():
        if p in kids:
            kids[p] += 1
    leaves = [i for i, k in kids.items() if not k]
    while leaves:
        p = up.pop(leaves.pop())
        if p in up:
            kids[p] -= 1
            if not kids[p]:
                leaves.append(p)
    out: list[tuple[int, int]] = []
    while up:  # each node that is left has one child
        ring, here = [], next(iter(up))
        while here in up:
            ring.append(here)
            here = up.pop(here)
        if here == ring[0]:
            out += [(i, min(least[i] for i in ring)) for i in ring]
    yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(2)], names=["id", "cycle_key"])


def cycles(edges: DataFrame, max_rounds: int = 400, finish_rows: int = 50_000) -> DataFrame:
    """The nodes on a cycle of edges(id, parent): id, cycle_key. A node that is its own parent is a cycle."""
    rounds, left = _contract(edges, False, max_rounds, finish_rows)
    is_core = (F.col("tag") == DONE) & F.col("parent").isNotNull()
    known: DataFrame | None = None
    if left is not None:
        known = written(left.select("id", "parent", "emin").repartition(1).mapInArrow(_finish, "id bigint, cycle_key bigint"), "cycles")
    for r in reversed(rounds):
        counts = counts_of(r)
        new = r.where(is_core).select("id", F.least("id", "emin").alias("cycle_key"))
        if not counts["cores"] and (known is None or not counts["spliced"]):
            continue
        if known is not None:
            spliced = r.where(F.col("tag") == SPLICED).select("id", "child")
            back = spliced.join(known.select(F.col("id").alias("child"), "cycle_key"), "child").select("id", "cycle_key")
            new = known.unionAll(new).unionAll(back)
        last, known = known, written(new, "cycles")
        if last is not None:
            release(last)
    for r in rounds:
        release(r)
    return known if known is not None else edges.sparkSession.createDataFrame([], "id bigint, cycle_key bigint")


def _under(gone: DataFrame, up: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """gone with what is known of each node's parent; the children of hubs by salt."""
    out = without(gone, hubs, ["parent"]).join(up, "parent", "left")
    if hubs is None:
        return out
    hot = salted(gone, hubs, ["parent"]).join(copied(up, hubs, ["parent"]), ["parent", "salt"], "left")
    return out.unionByName(hot.drop("salt"))


def hierarchy(edges: DataFrame, max_rounds: int = 400, hub_rows: int = 20_000) -> DataFrame:
    """id, parent, root, depth (0 at a root), path (ids, root first), n_descendants, cycle_key, missing_parent, chain, ring.

    chain, below a cycle: ids from the node of the cycle where it hangs to the node itself. ring, at one node of
    each cycle: all ids of the cycle, each followed by its parent.
    """
    rounds, _ = _contract(edges, True, max_rounds)
    # a child can change its parent only to one of its ancestors; nearly all children of a hub are its own
    kids = edges.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    hubs = heavy_groups(kids, ["parent"], hub_rows)
    resolved: list[DataFrame] = []
    for r in reversed(rounds):
        root = F.col("parent").isNull()
        new = r.where(F.col("tag") == DONE).select(
            "id",
            "boss",
            "real",
            F.when(root, ~F.col("real")).alias("apart"),
            F.when(root, F.col("id")).alias("root"),
            F.when(root, F.lit(0).cast("bigint")).alias("depth"),
            F.when(root, F.array("id")).alias("path"),
            F.when(root, F.col("w")).alias("size"),
            F.when(~root, F.least("id", "emin")).alias("cycle_key"),
            F.lit(None).cast("array<bigint>").alias("chain"),
            F.when(~root, F.concat(F.array("id"), "seg")).alias("ring"),
        )
        if resolved:
            known = reduce(DataFrame.unionAll, resolved)
            hangs = F.coalesce("chain", F.when(F.col("cycle_key").isNotNull(), F.array("id")))
            up = known.select(
                F.col("id").alias("parent"),
                F.col("apart").alias("u_apart"),
                F.col("root").alias("u_root"),
                F.col("depth").alias("u_depth"),
                F.col("path").alias("u_path"),
                hangs.alias("u_chain"),
            )
            down = known.select(F.col("id").alias("child"), F.col("size").alias("d_size"), F.col("cycle_key").alias("d_key"))
            nothing = F.lit(None).cast("bigint")
            gone = r.select("id", "boss", "real", "parent", "child", "dist", "seg", "w", "base", "tag")
            raked = gone.where(F.col("tag") == RAKED).drop("child").withColumn("d_size", nothing).withColumn("d_key", nothing)
            spliced = gone.where(F.col("tag") == SPLICED).join(down, "child", "left").drop("child")
            back = _under(raked.unionByName(spliced), up, hubs).select(
                "id",
                "boss",
                "real",
                F.col("u_apart").alias("apart"),
                F.col("u_root").alias("root"),
                (F.col("u_depth") + F.col("dist")).alias("depth"),
                F.concat("u_path", F.reverse("seg"), F.array("id")).alias("path"),
                F.when(F.col("tag") == RAKED, F.col("w")).when(F.col("d_key").isNull(), F.col("base") + F.col("d_size")).alias("size"),
                F.col("d_key").alias("cycle_key"),
                F.when(F.col("d_key").isNull(), F.concat("u_chain", F.reverse("seg"), F.array("id"))).alias("chain"),
                F.lit(None).cast("array<bigint>").alias("ring"),
            )
            new = new.unionAll(back)
        resolved.append(written(new, "resolved"))
    for r in rounds:
        release(r)
    apart = F.coalesce("apart", F.lit(False))  # the root is not in the table
    return reduce(DataFrame.unionAll, resolved).where("real").select(
        "id",
        F.col("boss").alias("parent"),
        F.when(apart, F.col("path")[1]).otherwise(F.col("root")).alias("root"),
        F.when(apart, F.col("depth") - 1).otherwise(F.col("depth")).alias("depth"),
        F.when(apart, F.slice("path", F.lit(2), F.size("path"))).otherwise(F.col("path")).alias("path"),
        (F.col("size") - 1).alias("n_descendants"),
        "cycle_key",
        (apart & (F.col("depth") == 1)).alias("missing_parent"),
        "chain",
        "ring",
    )


def descendants(nodes: DataFrame) -> DataFrame:
    """One row per node of a tree and each node below it: ancestor, descendant, distance.

    Every path names its ancestors, so the rows come from the paths themselves: no join, and a root
    with very many descendants is as many rows, not one large value.
    """
    steps = nodes.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return steps.where(F.col("at") < F.col("depth")).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def all_descendants(nodes: DataFrame) -> DataFrame:
    """descendants(), and the same for the nodes on and below a cycle: ancestor, descendant, distance.

    A chain names the ancestors up to the cycle and is exploded like a path. A node on a cycle is above
    all other nodes of that cycle and all that hang below any of them, by the fewest steps; it is not its
    own descendant. For this the members of a cycle are joined to the nodes that hang on it.
    """
    down = nodes.where("chain is not null").select(F.col("id").alias("descendant"), "chain", (F.size("chain") - 1).cast("bigint").alias("depth"))
    steps = down.select("descendant", "depth", F.posexplode("chain").alias("at", "ancestor"))
    below = steps.where((F.col("at") > 0) & (F.col("at") < F.col("depth"))).select("ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    rings = nodes.where("ring is not null").select("ring", F.posexplode("ring").alias("at", "hook"))
    hung = down.select("descendant", F.col("chain")[0].alias("hook"), "depth")
    on = rings.select(F.col("hook").alias("descendant"), "hook", F.lit(0).cast("bigint").alias("depth"))
    around = hung.unionAll(on).join(rings, "hook").select("descendant", "depth", "at", F.size("ring").alias("length"), F.posexplode("ring").alias("to", "ancestor"))
    over = around.where("ancestor <> descendant").select("ancestor", "descendant", (F.col("depth") + F.pmod(F.col("to") - F.col("at"), "length")).alias("distance"))
    return descendants(nodes).unionAll(below).unionAll(over)
