"""Embedding near-duplicates: a robust-pruned flat graph.

1. Equal vectors become one class with a multiplicity, so exact copies are
   never paired.  Classes are assigned to the ``OVERLAP`` nearest of the
   centroids; that makes overlapping shards.  The number of centroids, and of
   the sample they are fitted on, grows with the root of the table.
2. Each shard builds its part of the graph: neighbours by cosine, robustly
   pruned (a neighbour is dropped if a kept one is closer to it than the node
   is, by the factor ``ALPHA``).  Only here is a shard beyond ``SHARD_ROWS``
   taken in parts, which share ``BRIDGES`` members.
3. Walks leave the shard: the lists of all shards are united, and a node also
   visits every shard in which one of its ``WALK`` closest neighbours of each
   list stands.  In a shard members and visitors are all compared with all
   members, in blocks, without exception; a block gives back which of them
   are connected, one row per member, never the pairs.  Components come from those.
4. Verification: two vectors that are linked are in one component, so exact
   link counts come from comparing the members of each component, in blocks
   (a large component is cut into chunks, each pair of chunks is a task); a
   block gives one count per row.
5. Audit: the link counts of all classes that hold a vec_id divisible by
   ``EVERY`` are taken by brute force against all rows, in blocks; recall is
   the mean over those that have links.  Below ``RECALL`` the graph is built
   anew with one more shard per vector; if the last build fails too, all
   classes are compared with all (exact, quadratic, in blocks over tasks).

Edge cases: vectors that are NULL, zero, hold NULL or non-finite numbers, or
have another length than the most frequent one link with nothing: n_links 0,
their own component.  NULL vec_ids take part; component_id is the smallest
vec_id that is not NULL (NULL if there is none), ``kept`` is false for them.
Repeated rows and ties: equal vectors link each other; rows that repeat a
vec_id each get their result.  An empty table gives no rows.  Other columns
are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components

OVERLAP, MOST_OVERLAP, SAMPLE, MEAN_ROWS, MOST_CENTROIDS = 2, 5, 16_384, 400, 1024
SHARD_ROWS, BRIDGES = 1200, 64
DEGREE, ALPHA, BEAM, STEPS, WALK = 24, 1.2, 12, 40, 3
CHUNK, SMALL = 1024, 128
EVERY, AUDIT, RECALL = 50, 4096, 0.95


def matrix(column):
    """A list<double> column as a 2-D array."""
    import numpy as np
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype="float64").reshape(len(column), -1)


def centroids_of(sample, k: int, rounds: int = 6, seed: int = 3):
    """Spherical k-means of unit vectors."""
    import numpy as np
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(sample[lo:lo + 1024] @ c.T, axis=1) for lo in range(0, len(sample), 1024)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-30), c)
    return c


def robust_prune(sim, degree: int = DEGREE, alpha: float = ALPHA):
    """Adjacency (rows x degree, -1 padded) of the vectors with this matrix of
    cosines: the closest first, skipping those that a kept one covers."""
    import numpy as np
    n = len(sim)
    wide = min(n - 1, 4 * degree)
    out = np.full((n, degree), -1, dtype="int32")
    if wide < 1:
        return out
    s = sim.copy()
    np.fill_diagonal(s, -np.inf)
    near = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1, kind="stable"), 1)
    gap = np.take_along_axis(1 - s, near, 1)
    alive = np.ones(near.shape, dtype=bool)
    rows = np.arange(n)
    for slot in range(degree):
        any_left = alive.any(axis=1)
        if not any_left.any():
            break
        at = np.argmax(alive, axis=1)
        pick = near[rows, at]
        out[any_left, slot] = pick[any_left]
        # candidates closer to the pick than to the node are covered
        covered = alpha * (1 - sim[pick[:, None], near]) <= gap
        alive &= ~covered
        alive[rows, at] = False
    return out


def range_search(sim, adjacency, start: int, radius: float):
    """Boolean (queries x nodes): nodes in range of each member, found by a
    greedy beam from ``start`` and by expanding what is in range."""
    import numpy as np
    n = len(sim)
    seen = np.zeros((n, n), dtype=bool)
    done = np.zeros((n, n), dtype=bool)
    seen[:, start] = True
    rows = np.arange(n)
    for _ in range(STEPS):
        open_ = np.where(seen & ~done, sim, -np.inf)
        best = np.argmax(open_, axis=1)
        # the best open node has to be among the beam of what has been seen
        kth = np.partition(np.where(seen, sim, -np.inf), n - min(BEAM, n), axis=1)[:, n - min(BEAM, n)]
        go = np.isfinite(open_[rows, best]) & (open_[rows, best] >= kth)
        if not go.any():
            break
        done[rows[go], best[go]] = True
        nxt = adjacency[best[go]]
        r, c = np.repeat(rows[go], nxt.shape[1]), nxt.ravel()
        seen[r[c >= 0], c[c >= 0]] = True
    links = np.zeros((n, n), dtype="float32")
    r, c = np.repeat(rows, adjacency.shape[1]), adjacency.ravel()
    links[r[c >= 0], c[c >= 0]] = 1
    near = sim >= radius
    while True:
        fresh = seen & near & ~done
        if not fresh.any():
            return seen & near
        done |= fresh
        busy = fresh.any(axis=1)
        seen[busy] |= (fresh[busy].astype("float32") @ links) > 0


def roots(linked):
    """Smallest index reachable for each row of a symmetric boolean matrix."""
    import numpy as np
    linked = linked | linked.T
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_rows(classes: DataFrame, overlap: int) -> DataFrame:
    """(cluster, node, vec): every class in its nearest clusters."""
    import numpy as np
    spark = classes.sparkSession
    total = classes.count()
    # both grow with the root of the table
    most = max(MOST_CENTROIDS, int(total ** 0.5))
    share = min(1.0, max(SAMPLE, 8 * most) / max(1, total))
    sample = classes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) <= int(share * (1 << 20))).select("vec").collect()
    if not sample:
        return classes.select(F.lit(0).alias("cluster"), "node", "vec")
    pool = np.array([r.vec for r in sample], dtype="float64")
    k = max(1, min(most, len(pool), total // MEAN_ROWS))
    held = spark.sparkContext.broadcast(centroids_of(pool, k))

    def assign(batches):
        import numpy as np
        c = held.value
        m = min(overlap, len(c))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                near = np.argsort(-(matrix(b.column(1)) @ c.T), axis=1, kind="stable")[:, :m]
                for j in range(m):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, j].astype("int32")), b.column(0), b.column(1)],
                                                     names=["cluster", "node", "vec"])

    rows = classes.select("node", "vec").mapInArrow(assign, "cluster int, node long, vec array<double>")
    return written(rows, "graph-shards")


def build(shards: DataFrame) -> DataFrame:
    """(node, adjacent array<long>): adjacency lists, closest first, one for
    each shard of a node."""

    def graph(t: pa.Table) -> pa.Table:
        import numpy as np
        nodes, x = np.asarray(t.column("node")), matrix(t.column("vec"))
        adj = robust_prune(x @ x.T)
        keep = adj >= 0
        cuts = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype("int32")
        return pa.table({"node": nodes, "adjacent": pa.ListArray.from_arrays(
            pa.array(cuts), pa.array(nodes[adj[keep]], pa.int64()))})

    size = shards.groupBy("cluster").agg(F.count("*").alias("n"))       # one row per cluster
    parts = F.ceil(F.col("n") / SHARD_ROWS).cast("long")
    # members that every part of a large shard shares: about BRIDGES by hash
    bridge = (parts > 1) & (F.pmod(F.xxhash64("node", F.lit("bridge")), F.col("n")) < BRIDGES)
    part = F.when(bridge, F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node", F.lit("part")), parts)))
    rows = shards.join(F.broadcast(size), "cluster").select("cluster", F.explode(part).alias("part"), "node", "vec")
    return rows.groupBy("cluster", "part").applyInArrow(graph, "node long, adjacent array<long>")


def visitors(shards: DataFrame, graph: DataFrame) -> DataFrame:
    """(cluster, node, vec): the shards that walks lead nodes to - those of
    their closest neighbours in the united lists - and that are not their own."""
    steps = graph.select(F.col("node").alias("walker"), F.explode(F.slice("adjacent", 1, WALK)).alias("node")).distinct()
    places = shards.select("cluster", "node")
    led = steps.join(places, "node").select("cluster", F.col("walker").alias("node")).distinct()
    led = led.join(places, ["cluster", "node"], "left_anti")
    return led.join(shards.select("node", "vec").dropDuplicates(["node"]), "node").select("cluster", "node", "vec")


def search(shards: DataFrame, cosine: float) -> DataFrame:
    """(a, b): each member of a block with the smallest member that pairs in
    range connect it to there, from (cluster, node, vec, guest).  Every member
    of a shard shares a block with every other and with every guest."""

    def find(t: pa.Table) -> pa.Table:
        import numpy as np
        order = np.argsort(np.asarray(t.column("node")), kind="stable")
        nodes, x = np.asarray(t.column("node"))[order], matrix(t.column("vec"))[order]
        found = roots(x @ x.T >= cosine)
        other = found != np.arange(len(nodes))
        return pa.table({"a": nodes[other], "b": nodes[found[other]]})

    one = lambda flag: F.ceil(F.sum(F.when(flag, 1).otherwise(0)) / CHUNK).cast("long")
    size = shards.groupBy("cluster").agg(one(~F.col("guest")).alias("own"), one(F.col("guest")).alias("guests"))
    chunk = F.when(F.col("guest"), F.col("own") + F.pmod(F.xxhash64("node"), F.col("guests"))).otherwise(
        F.pmod(F.xxhash64("node"), F.col("own")))
    last = F.when(F.col("guest"), F.col("own")).otherwise(F.col("own") + F.col("guests")) - 1
    rows = shards.join(F.broadcast(size), "cluster").select(               # one row per cluster
        "cluster", chunk.alias("chunk"), "node", "vec", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    rows = rows.select("cluster", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "vec")
    return rows.groupBy("cluster", "i", "j").applyInArrow(find, "a long, b long")


def counted(members: DataFrame, cosine: float) -> DataFrame:
    """(node, others): links of each class to other classes, copies counted,
    from (component, node, times, vec)."""
    size = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    rows = members.join(size, "component")
    total = size.agg(F.sum("size").alias("n")).first().n or 0
    buckets = max(1, total // CHUNK)
    small = F.col("size") <= SMALL
    chunks = F.when(small, 1).otherwise(F.ceil(F.col("size") / CHUNK)).cast("long")
    chunk = F.when(small, 0).otherwise(F.pmod(F.xxhash64("node"), chunks))
    rows = rows.withColumn("chunk", chunk).withColumn("chunks", chunks)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select(
        F.when(small, -1 - F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component")).alias("key"),
        small.alias("small"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
        F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"), "component", "node", "times", "vec")

    def compare(t: pa.Table) -> pa.Table:
        import numpy as np
        side, comp = np.asarray(t.column("side")), np.asarray(t.column("component"))
        nodes, times, x = np.asarray(t.column("node")), np.asarray(t.column("times")), matrix(t.column("vec"))
        one_chunk = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        a = np.flatnonzero(side == 0)
        b = a if one_chunk else np.flatnonzero(side == 1)
        out_a, out_b = np.zeros(len(a), "int64"), np.zeros(len(b), "int64")
        for lo in range(0, len(a), 512):
            own = a[lo:lo + 512]
            near = (x[own] @ x[b].T >= cosine) & (comp[own][:, None] == comp[b][None, :])
            near &= nodes[own][:, None] != nodes[b][None, :]
            out_a[lo:lo + 512] = near @ times[b]
            out_b += near.T @ times[own]
        if one_chunk:
            return pa.table({"node": nodes[a], "others": out_a})
        return pa.table({"node": np.concatenate([nodes[a], nodes[b]]), "others": np.concatenate([out_a, out_b])})

    each = rows.groupBy("key", "small", "i", "j").applyInArrow(compare, "node long, others long")
    return each.groupBy("node").agg(F.sum("others").alias("others"))


def audit(classes: DataFrame, links: DataFrame, cosine: float) -> float:
    """Recall of the link counts (node, others): the mean, over the ``asked``
    classes that have links by brute force, of the share found; 1 if none has.
    AUDIT of them at a time are held against all rows."""
    import numpy as np
    asked = classes.where("asked")
    rounds = max(1, -(-asked.count() // AUDIT))
    total, linked = 0.0, 0
    for turn in range(rounds):
        chosen = asked.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(rounds)) == turn)
        got = chosen.join(links, "node", "left").select("node", "vec", F.coalesce("others", F.lit(0)).alias("o")).collect()
        if not got:
            continue
        held = classes.sparkSession.sparkContext.broadcast(
            (np.array([r.node for r in got]), np.array([r.vec for r in got])))

        def block(batches):
            import numpy as np
            nodes, q = held.value
            n = np.zeros(len(nodes), dtype="int64")
            for whole in batches:
                for lo in range(0, whole.num_rows, 1024):
                    b = whole.slice(lo, 1024)
                    x, own, times = matrix(b.column(1)), np.asarray(b.column(0)), np.asarray(b.column(2))
                    near = (q @ x.T >= cosine) & (nodes[:, None] != own[None, :])
                    n += near @ times
            hit = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(n[hit])], names=["node", "n"])

        true = {r.node: r.n for r in classes.select("node", "vec", "times").mapInArrow(
            block, "node long, n long").groupBy("node").agg(F.sum("n").alias("n")).collect()}   # <= the round's classes
        total += sum(min(1.0, r.o / true[r.node]) for r in got if r.node in true)
        linked += len(true)
    return total / linked if linked else 1.0


def links(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vector_col).cast("array<double>").alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda t, x: t + x * x))
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = own.withColumn("norm", norm).withColumn("ok", F.coalesce(
        ~bad & (F.col("norm") > 0) & (F.col("norm") < float("inf")), F.lit(False)))
    size = own.where("ok").groupBy(F.size("raw").alias("s")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "s").limit(1).collect()
    good = F.col("ok") & (F.size("raw") == (size[0].s if size else -1))
    rows = own.select("vec_id", good.alias("good"), F.when(good, F.col("raw")).alias("raw"), "norm")
    classes = (rows.where("good").groupBy("raw").agg(F.count("*").alias("times"), F.min("vec_id").alias("smallest"),
                                                     F.coalesce(F.bool_or(F.col("vec_id") % EVERY == 0), F.lit(False)).alias("asked"),
                                                     F.first("norm").alias("norm"))
               .withColumn("node", F.monotonically_increasing_id()))
    classes = written(classes.select("node", "raw", "times", "smallest", "asked",
                                     F.transform("raw", lambda x: x / F.col("norm")).alias("vec")), "graph-classes")
    for overlap in range(OVERLAP, MOST_OVERLAP + 2):
        exact = overlap > MOST_OVERLAP                # no graph met the recall: all with all
        if exact:
            shards = classes.select(F.lit(0).alias("cluster"), "node", "vec", F.lit(False).alias("guest"))
        else:
            own = shard_rows(classes, overlap)
            shards = written(own.withColumn("guest", F.lit(False)).unionByName(
                visitors(own, build(own)).withColumn("guest", F.lit(True))), "graph-visits")
        found = components(written(search(shards, cosine), "graph-found"))
        comp = classes.join(found, "node", "left").select(
            "node", "times", "smallest", "vec", F.coalesce("component", "node").alias("component"))
        comp = written(comp, "graph-components")
        others = written(counted(comp.select("component", "node", "times", "vec"), cosine), "graph-counts")
        if exact or audit(classes, others, cosine) >= RECALL:
            break
    smallest = comp.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = (comp.select("node", "component").join(smallest, "component").join(others, "node", "left")
             .join(classes.select("node", "raw", "times"), "node")
             .select("raw", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.join(named, "raw", "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
