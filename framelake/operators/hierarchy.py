"""Parent-child rows to full hierarchies by tree contraction.

Each forward round rakes all leaves into their parents and splices out an
independent set of nodes with one child (those whose hash exceeds that of both
neighbours), so a forest of any shape vanishes in a logarithmic number of
rounds.  What is left are roots and, as cores that never terminate, loops
shrunk to a node that is its own parent.  The recorded contractions are then
undone in reverse order, newest first, which gives root, depth, path and
number of descendants of every node.  Each round is one job over the rows that
are still alive and is written to the shared folder.  Once at most ``finish_rows`` nodes
are alive (a fixed bound, whatever the input's size) one task contracts and
expands that core with the same two steps.

Defined results: ``parent`` null, 0 or without a row means no parent; rows with
a null id are left out; a repeated id keeps its smallest parent; nodes on a
loop and nodes hanging below one have status ``on_loop`` and ``below_loop`` and
null root, depth and path; nodes on a loop have null ``n_descendants``; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framelake.runtime import materialize

_RAKED, _SPLICED = 1, 2


def _hash(tree: str, node: Column, turn: int) -> Column:
    return F.xxhash64(F.col(tree), node, F.lit(turn))


def _contract(nodes: DataFrame, paths: bool, finish_rows: int) -> tuple[DataFrame, list[DataFrame], bool]:
    """(what stays, contractions by round, whether work is left) of ``tree, node, parent``."""
    live = nodes.withColumns({"own": F.lit(1).cast("bigint"), "up": F.lit(0).cast("bigint"), "hops": F.lit(1).cast("bigint")})
    if paths:
        live = live.withColumn("seg", F.array().cast("array<bigint>"))
    live = materialize(live, "tree-live")
    done: list[DataFrame] = []
    for turn in range(10_000):
        if live.count() <= finish_rows:
            return live, done, True
        has_child = live.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
        marked = live.join(has_child, ["tree", "node"], "left").withColumn("leaf", F.col("inner").isNull() & F.col("parent").isNotNull()).drop("inner")
        below = marked.where(F.col("parent").isNotNull()).groupBy("tree", F.col("parent").alias("node")).agg(
            F.count_if(~F.col("leaf")).alias("kids"),
            F.min(F.when(~F.col("leaf"), F.col("node"))).alias("kid"),
            F.min(F.when(~F.col("leaf"), F.col("up"))).alias("kid_up"),
            F.sum(F.when(F.col("leaf"), F.col("own") + F.col("up")).otherwise(0)).alias("gain"),
            F.count_if(F.col("leaf")).alias("raked"),
        )
        state = marked.join(below, ["tree", "node"], "left")
        mine = _hash("tree", F.col("node"), turn)
        unary = (F.col("kids") == 1) & (F.col("raked") == 0) & F.col("parent").isNotNull() & (F.col("parent") != F.col("node")) & (F.col("kid") != F.col("node"))
        # a loop of two: both neighbours are the same node, hashes still decide
        win = F.coalesce(unary & (mine > _hash("tree", F.col("parent"), turn)) & (mine > _hash("tree", F.col("kid"), turn)), F.lit(False))
        state = state.withColumn("kind", F.when(F.col("leaf"), _RAKED).when(win, _SPLICED).otherwise(0)).withColumn("own", F.col("own") + F.coalesce("gain", F.lit(0)))
        kept = ["parent", "own", "up", "hops"] + (["seg"] if paths else [])
        over = state.where(F.col("kind") == _SPLICED).select("tree", F.col("node").alias("parent"), *(F.col(c).alias(f"v_{c}") for c in kept))
        state = state.join(over, ["tree", "parent"], "left")
        moved = F.col("v_own").isNotNull() & (F.col("kind") != _RAKED)
        change = {
            "parent": F.when(moved, F.col("v_parent")).otherwise(F.col("parent")),
            "up": F.when(moved, F.col("up") + F.col("v_up") + F.col("v_own")).otherwise(F.col("up")),
            "hops": F.when(moved, F.col("hops") + F.col("v_hops")).otherwise(F.col("hops")),
        }
        if paths:
            change["seg"] = F.when(moved, F.concat("v_seg", F.array("parent"), "seg")).otherwise(F.col("seg"))
        seen = Observation()
        state = state.select("tree", "node", F.col("own"), "kind", "kid", "kid_up", *(e.alias(c) for c, e in change.items()))
        state = state.observe(seen, F.count_if(F.col("kind") > 0).alias("gone"))
        state = materialize(state, f"tree-{turn}")
        live = state.where(F.col("kind") == 0).drop("kind", "kid", "kid_up")
        if not seen.get["gone"]:
            return live, done, False
        done.append(state.where(F.col("kind") > 0))
    raise RuntimeError("the contraction does not end")


def _finish(core: pa.Table) -> pa.Table:
    """Contract and expand a bounded core in memory."""
    paths = "seg" in core.column_names
    tree, node = core["tree"].to_pandas(), core["node"].to_numpy()
    n = len(node)
    index = pd.MultiIndex.from_arrays([tree, node])
    up_id = core["parent"].to_pandas(types_mapper=pd.ArrowDtype)
    par = np.where(up_id.isna(), -1, index.get_indexer(pd.MultiIndex.from_arrays([tree, up_id.fillna(0).astype("int64")])))
    own, up, hops = (core[c].to_numpy().copy() for c in ("own", "up", "hops"))
    seg = core["seg"].to_pylist() if paths else None
    alive, me, rng = np.ones(n, bool), np.arange(n), np.random.default_rng(7)
    rounds: list[tuple] = []
    while True:
        kids = np.bincount(par[alive & (par >= 0)], minlength=n)
        leaf = np.flatnonzero(alive & (par >= 0) & (kids == 0))
        np.add.at(own, par[leaf], own[leaf] + up[leaf])
        alive[leaf] = False
        rounds.append((leaf, None, None))
        below = np.flatnonzero(alive & (par >= 0))
        kids = np.bincount(par[below], minlength=n)
        kid = np.full(n, -1)
        kid[par[below]] = below
        rank = rng.permutation(n)
        v = np.flatnonzero(alive & (kids == 1) & (par >= 0) & (par != me) & (kid != me))
        v = v[(rank[v] > rank[par[v]]) & (rank[v] > rank[kid[v]])]
        c = kid[v]
        rounds.append((v, c, up[c].copy()))
        up[c] += up[v] + own[v]
        hops[c] += hops[v]
        if paths:
            for a, b in zip(v, c):
                seg[b] = [*seg[a], int(node[a]), *seg[b]]
        par[c] = par[v]
        alive[v] = False
        if not len(leaf) and not len(v):
            break
    root, depth, total, status = np.full(n, -1), np.full(n, -1), np.full(n, -1), np.full(n, 2)  # status: 0 tree, 1 loop, 2 below
    free = np.flatnonzero(alive & (par < 0))
    root[free], depth[free], total[free], status[free] = free, 0, own[free], 0
    status[alive & (par >= 0)] = 1
    path: list = [None] * n
    if paths:
        for a in free:
            path[a] = [int(node[a])]
    for v, c, up_c in reversed(rounds):
        p = par[v]
        status[v] = np.where(status[p] == 0, 0, 2)
        total[v] = own[v]
        if c is not None:
            total[v] += total[c] + up_c
            status[v[status[c] == 1]] = 1
        root[v] = root[p]
        depth[v] = np.where(status[v] == 0, depth[p] + hops[v], -1)
        if paths:
            for a in v[status[v] == 0]:
                path[a] = [*path[par[a]], *seg[a], int(node[a])]
    in_tree = status == 0
    out = {
        "tree": core["tree"], "node": core["node"],
        "root": pa.array(np.where(root >= 0, node[root], 0), pa.int64(), mask=~in_tree),
        "depth": pa.array(depth, pa.int64(), mask=~in_tree),
        "total": pa.array(total, pa.int64(), mask=status == 1),
        "status": pa.array(np.array(["tree", "on_loop", "below_loop"])[status]),
    }
    if paths:
        out["path"] = pa.array(path, pa.list_(pa.int64()))
    return pa.table(out)


def hierarchy(df: DataFrame, *, id: str = "id", parent: str = "parent_id", tree: Column | None = None, paths: bool = True, finish_rows: int = 50_000) -> DataFrame:
    """``tree, node_id, root_id, depth, n_descendants, status`` and, with ``paths``, ``path``."""
    rows = df.select((tree if tree is not None else F.lit("")).alias("tree"), F.col(f"`{id}`").cast("bigint").alias("node"), F.nullif(F.col(f"`{parent}`").cast("bigint"), F.lit(0)).alias("parent"))
    rows = rows.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    known = rows.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = rows.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"))
    core, done, open_ = _contract(nodes, paths, finish_rows)
    cols = "tree string, node bigint, root bigint, depth bigint, total bigint, status string" + (", path array<bigint>" if paths else "")
    loop = F.col("parent").isNotNull()
    ended = core.select(
        "tree", "node",
        F.when(~loop, F.col("node")).alias("root"),
        F.when(~loop, F.lit(0).cast("bigint")).alias("depth"),
        F.when(~loop, F.col("own")).alias("total"),
        F.when(loop, "on_loop").otherwise("tree").alias("status"),
        *([F.when(~loop, F.array("node")).alias("path")] if paths else []),
    )
    parts = [materialize(core.groupBy().applyInArrow(_finish, cols) if open_ else ended, "tree-out")]
    spark = df.sparkSession

    def solved() -> DataFrame:
        """All parts so far as one scan; their sizes grow geometrically."""
        files = [p for part in parts for p in part.inputFiles()]
        return spark.read.schema(parts[0].schema).parquet(*files) if files else parts[0]

    for gone in reversed(done):
        # a raked leaf's parent is never spliced in the same round, so both kinds are undone together
        up = solved().select("tree", F.col("node").alias("parent"), "root", "depth", F.col("status").alias("p_status"), *(["path"] if paths else []))
        kid = solved().select("tree", F.col("node").alias("kid"), F.col("status").alias("k_status"), F.col("total").alias("k_total"))
        spliced = F.col("kind") == _SPLICED
        on_loop = spliced & (F.col("k_status") == "on_loop")
        on_loop = F.coalesce(on_loop, F.lit(False))
        total = F.col("own") + F.when(spliced, F.col("k_total") + F.col("kid_up")).otherwise(0)
        back = gone.withColumn("kid", F.when(spliced, F.col("kid"))).join(kid, ["tree", "kid"], "left").join(up, ["tree", "parent"]).select(
            "tree", "node", "root", (F.col("depth") + F.col("hops")).alias("depth"),
            F.when(~on_loop, total).alias("total"),
            F.when(on_loop, "on_loop").when(F.col("p_status") == "tree", "tree").otherwise("below_loop").alias("status"),
            *([F.concat("path", "seg", F.array("node")).alias("path")] if paths else []),
        )
        parts.append(materialize(back, "tree-out"))
    return solved().select("tree", F.col("node").alias("node_id"), F.col("root").alias("root_id"), "depth", (F.col("total") - 1).alias("n_descendants"), "status", *(["path"] if paths else []))


def descendants(nodes: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair with its distance, from the paths of :func:`hierarchy`."""
    pairs = nodes.where(F.col("depth") > 0).select("tree", "node_id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth").cast("int"))).alias("at", "ancestor_id"))
    return pairs.select("tree", "ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") - F.col("at")).alias("distance"))


def _loop_pairs(edges: DataFrame) -> DataFrame:
    """``tree, ancestor_id, descendant_id, distance`` inside loops, a node as its own ancestor included, by doubling the reach."""
    reach, known = materialize(edges.select("tree", F.col("parent").alias("ancestor_id"), F.col("node").alias("descendant_id"), F.lit(1).cast("bigint").alias("distance")), "loop-pairs"), -1
    while (n := reach.count()) != known:
        known = n
        further = reach.select("tree", F.col("descendant_id").alias("from"), F.col("ancestor_id").alias("to"), "distance")
        up = reach.select("tree", F.col("descendant_id").alias("to"), F.col("ancestor_id").alias("top"), F.col("distance").alias("more"))
        joined = further.join(up, ["tree", "to"]).select("tree", F.col("top").alias("ancestor_id"), F.col("from").alias("descendant_id"), (F.col("distance") + F.col("more")).alias("distance"))
        reach = materialize(reach.unionByName(joined).groupBy("tree", "ancestor_id", "descendant_id").agg(F.min("distance").alias("distance")), "loop-pairs")
    return reach


def all_descendants(df: DataFrame, *, id: str = "id", parent: str = "parent_id", tree: Column | None = None, finish_rows: int = 50_000) -> DataFrame:
    """Like :func:`descendants`, and also the pairs of nodes on loops and below them, with the shortest distance.

    A loop's nodes are ancestors of each other and of themselves, and of all that
    hangs below the loop.
    """
    rows = df.select((tree if tree is not None else F.lit("")).alias("tree"), F.col(f"`{id}`").cast("bigint").alias("node"), F.nullif(F.col(f"`{parent}`").cast("bigint"), F.lit(0)).alias("parent"))
    rows = rows.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min("parent").alias("parent"))
    nodes = materialize(hierarchy(rows, id="node", parent="parent", tree=F.col("tree"), finish_rows=finish_rows), "tree-nodes")
    odd = materialize(rows.join(nodes.where(F.col("status") != "tree").select("tree", F.col("node_id").alias("node"), "status"), ["tree", "node"]), "tree-loops")
    on_loop = F.col("status") == "on_loop"
    loops = _loop_pairs(odd.where(on_loop))
    # with their loop's edges cut, the nodes below hang from the loop's nodes as from roots
    cut = odd.select("tree", "node", F.when(~on_loop, F.col("parent")).alias("parent"))
    below = materialize(hierarchy(cut, id="node", parent="parent", tree=F.col("tree"), finish_rows=finish_rows), "tree-below")
    entry = below.where(F.col("depth") > 0).select("tree", F.col("root_id").alias("root"), "node_id", "depth")
    around = loops.where(F.col("ancestor_id") != F.col("descendant_id")).select("tree", F.col("descendant_id").alias("root"), "ancestor_id", "distance")
    around = entry.join(around, ["tree", "root"]).select("tree", "ancestor_id", F.col("node_id").alias("descendant_id"), (F.col("depth") + F.col("distance")).alias("distance"))
    return descendants(nodes).unionByName(descendants(below)).unionByName(loops).unionByName(around)
