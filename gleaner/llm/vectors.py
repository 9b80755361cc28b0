"""Near-duplicate vectors by range search over robust-pruned graphs.

Vectors are compared only with vectors of an equal label and length, by cosine in double precision; a pair is linked
if it is `least` or more. Equal vectors are one node, with a number of its own and a multiplicity. Nodes are dealt to overlapping cluster
shards: a shard over SHARD_MOST nodes is split around pivots (a bounded sample of it, no two of them closer than
PIVOT_GAP, so that a dense cluster has one), each node going to its nearest, and to its second nearest unless that is too much farther
for any link to lead there. A part that has not shrunk to SHRINK of what it was is dense and stays whole. Each shard builds a robust-pruned
graph, choosing each node's candidates by one block product, which for shards of this size costs less than searching
for them; a node's lists from all its shards are united. In each shard every node is then searched for: a greedy search
from the shard's medoid and the node's own list finds the neighbourhood, which is expanded through all nodes within
reach. What is found is verified by the cosine itself.

Vectors keep the precision in which they come until they are compared, and a shard's vectors are shuffled once for
building and searching. No shuffle is by label alone, so that a hot label is split from the start.

The search finds every link of a shard if pruning had all nodes within reach of a node to choose from and dropped one
only for a kept one nearer to it by ALPHA: from a node a path leads to each linked one, ever nearer to it, hence inside
`reach`. Nodes with more within reach than CANDIDATES or DEGREE hold are `cut`; a shard that has one is compared by
full products instead. So all pairs in a shard are seen, and a pair in several counts in the first that both share.

A dense shard that pivots cannot split is compared in pairs of blocks of at most BLOCK nodes: as links are counted, its work
grows with the number of links. `audit` measures recall against all rows for a bounded set of queries; the query
does so and fails under RECALL_LEAST. Only pairs that no shard holds together can be missed.

Null, zero, null-holding and non-finite vectors, null labels and null ids are linked with nothing. Rows that repeat
an id are vectors of their own and share its result, their links added up. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gleaner.llm.common import components, table
from gleaner.operators.lineage import checkpoint
from gleaner.operators.sizes import BROADCAST_ROWS

LEAST = 0.93
SHARD_MOST, SHARD_AIM = 1200, 400
PIVOTS = 1024
PIVOT_GAP = 0.7
LEVELS = 8
SHRINK = 0.8
BLOCK = 2048
DEAL = 20_000
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
BEAM = 12
RECALL_LEAST = 0.9
#: A cell's rows are met by its count in so many tasks.
SALTS = 64
#: Vectors nearer than this (their cosine) have distances too short to be compared.
SAME = 1 - 5e-13


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def robust_prune(x: np.ndarray, least: float = LEAST, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row of unit vectors, its kept neighbours: nearest first, without those that a kept one is near to.

    And whether it is cut: whether rows with cosine of at least `least` were left out for want of room, or are too near to be told apart.
    """
    n = len(x)
    take = min(candidates, n - 1)
    if take <= 0:
        return [np.zeros(0, np.int64)] * n, np.zeros(n, bool)
    out, cut = [], np.zeros(n, bool)
    for begin in range(0, n, 256):
        own = x[begin : begin + 256]
        sims = own @ x.T
        sims[np.arange(len(own)), begin + np.arange(len(own))] = -np.inf
        short = (sims >= least - 1e-9).sum(1) > take
        near = np.argpartition(-sims, take - 1, axis=1)[:, :take]
        s = np.take_along_axis(sims, near, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        near, s = np.take_along_axis(near, order, 1), np.take_along_axis(s, order, 1)
        short |= s[:, 0] > SAME
        distance = np.sqrt(np.maximum(2 - 2 * s, 0))
        gathered = x[near]
        between = np.sqrt(np.maximum(2 - 2 * np.matmul(gathered, gathered.transpose(0, 2, 1)), 0))
        alive, kept, size = np.ones(near.shape, bool), np.zeros(near.shape, bool), np.zeros(len(own), np.int64)
        for c in range(take):
            now = alive[:, c] & (size < degree)
            short |= alive[:, c] & ~now & (s[:, c] >= least - 1e-9)
            kept[now, c] = True
            size += now
            alive[:, c + 1 :] &= ~(now[:, None] & (alpha * between[:, c, c + 1 :] <= distance[:, c + 1 :]))
        out += [near[i][kept[i]] for i in range(len(own))]
        cut[begin : begin + 256] = short
    return out, cut


def reach(least: float) -> float:
    """Cosine within which a path to a linked node stays: its steps are nearer to that node by ALPHA, less what rounding takes."""
    return 1 - (1 - least) * (1 + 1 / (ALPHA - 0.01)) ** 2


def products(x: np.ndarray, first: np.ndarray, second: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Both directions of all pairs of a row of `first` with one of `second` whose cosine is `least` or more; the two are equal or disjoint."""
    same, other = np.array_equal(first, second), x[second].T
    for begin in range(0, len(first), 256):
        own = first[begin : begin + 256]
        at, to = np.nonzero(x[own] @ other >= least)
        a, b = own[at], second[to]
        if same:
            yield a[a != b], b[a != b]
        else:
            yield a, b
            yield b, a


def merged(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least row of each component) after joining a with b."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            return parent
        parent = parent.copy()
        np.minimum.at(parent, high[apart], low[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def unseen(nodes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The distinct nodes among these that were not seen before; now they are."""
    nodes = nodes[~seen[nodes]]
    if len(nodes) > 64:
        fresh = np.zeros(len(seen), bool)
        fresh[nodes] = True
        nodes = np.flatnonzero(fresh)
    else:
        nodes = np.unique(nodes)
    seen[nodes] = True
    return nodes


def range_search(x: np.ndarray, lists: list[np.ndarray], least: float, beam: int = BEAM) -> list[np.ndarray]:
    """For each row, the other rows found with cosine of at least `least`."""
    n = len(x)
    a = np.concatenate([np.repeat(np.arange(n), [len(v) for v in lists]), np.concatenate(lists)]) if n else np.zeros(0, np.int64)
    b = np.concatenate([np.concatenate(lists), np.repeat(np.arange(n), [len(v) for v in lists])]) if n else a
    order = np.argsort(a, kind="stable")  # edges serve both ways
    bound = np.searchsorted(a[order], np.arange(n + 1))
    near = [np.unique(b[order[bound[i] : bound[i + 1]]]) for i in range(n)]
    medoid = int(np.argmax(x @ x.mean(0)))
    out = []
    for q in range(n):
        target = x[q]
        seen = np.zeros(n, bool)
        seen[near[q]] = seen[medoid] = True
        seen[q] = False
        fresh = np.flatnonzero(seen)
        seen[q] = True
        nodes, sims = fresh, x[fresh] @ target
        done = np.zeros(len(nodes), bool)
        while True:  # greedy: the best few are expanded until they all are
            top = np.argsort(-sims, kind="stable")[:beam]
            open_ = top[~done[top]]
            if not len(open_):
                break
            done[open_[:4]] = True
            fresh = unseen(np.concatenate([near[i] for i in nodes[open_[:4]].tolist()]), seen)
            if len(fresh):
                nodes, sims, done = np.append(nodes, fresh), np.append(sims, x[fresh] @ target), np.append(done, np.zeros(len(fresh), bool))
        while True:  # expansion: through all nodes within reach
            open_ = np.flatnonzero((sims >= reach(least)) & ~done)
            if not len(open_):
                break
            done[open_] = True
            fresh = unseen(np.concatenate([near[i] for i in nodes[open_].tolist()]), seen)
            if len(fresh):
                nodes, sims, done = np.append(nodes, fresh), np.append(sims, x[fresh] @ target), np.append(done, np.zeros(len(fresh), bool))
        out.append(nodes[sims >= least])
    return out


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Rows (id, label, v) that can have links; v in four bytes an element if it comes so, else in doubles."""
    v = F.col("v")
    kept = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast(kept).alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))


def with_count(rows: DataFrame, most: int) -> DataFrame:
    """Rows (cell, ...) with `m`, the number of rows of their cell if it is over `most`, else null."""
    counts = checkpoint(rows.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > most))
    if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts), "cell", "left")
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["cell", "salt"], "left").drop("salt")


def shards(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Nodes (id, v) with their `cell`s: a row for each. `nodes` has a first cell for each node."""
    kind = nodes.schema["v"].dataType.simpleString()
    v_type = to_arrow_type(nodes.schema["v"].dataType)

    def nearest(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "v": pa.array([], v_type), "of": pa.array([], pa.int64())})
        cell, of, kept = rows["cell"][0].as_py(), rows["m"][0].as_py(), []
        if pivots.num_rows:
            order = np.argsort(pivots["p_id"].to_numpy(), kind="stable")
            p, names = _unit(matrix(pivots["p_v"].take(pa.array(order)))), pivots["p_id"].to_numpy()[order]
            for i in range(len(p)):
                if len(kept) < PIVOTS and (not kept or (p[kept] @ p[i]).max() < PIVOT_GAP):
                    kept.append(i)
        if len(kept) < 2:  # dense: it stays whole
            return pa.table([rows["cell"].combine_chunks(), rows["id"].combine_chunks(), rows["v"].combine_chunks(), pa.array([of] * rows.num_rows, pa.int64())], ["cell", "id", "v", "of"])
        x, centres = _unit(matrix(rows["v"])), p[kept].T
        made = np.array([hash((cell, int(names[k]))) for k in kept], np.int64)
        to, order = [], []
        for a in range(0, len(x), 2048):
            sims = x[a : a + 2048] @ centres
            two = np.argsort(-sims, axis=1, kind="stable")[:, :2]
            angle = np.arccos(np.clip(np.take_along_axis(sims, two, 1), -1, 1))
            # Of a linked pair whose nearest pivots differ, neither is farther from the other's pivot than twice the link's angle more.
            used = np.stack([np.ones(len(two), bool), angle[:, 1] <= angle[:, 0] + 2 * np.arccos(least) + 1e-6], 1)
            to.append(made[two[used]])
            order.append(a + np.nonzero(used)[0])
        order = pa.array(np.concatenate(order))
        return pa.table([pa.array(np.concatenate(to)), rows["id"].take(order).combine_chunks(), rows["v"].take(order).combine_chunks(), pa.array([of] * len(order), pa.int64())], ["cell", "id", "v", "of"])

    # `of`: how many rows the cell had that a row's cell was split off; null at first.
    done, open_ = [], nodes.withColumn("of", F.lit(None).cast("long"))
    for level in range(LEVELS):
        sized = with_count(open_, SHARD_MOST)
        large = F.col("m").isNotNull() & (F.col("of").isNull() | (F.col("m") <= SHRINK * F.col("of")))
        done.append(sized.where(~large).drop("m", "of"))
        big = sized.where(large)
        if not big.limit(1).count():
            break
        deals = F.ceil(F.col("m") / DEAL)
        dealt = big.withColumn("deal", F.pmod(F.xxhash64("id"), deals))
        wanted = F.least(F.lit(4 * PIVOTS), F.ceil(2 * F.col("m") / SHARD_AIM) + 6)
        pivots = big.where(F.pmod(F.xxhash64(F.lit(level), "id"), F.col("m")) < wanted).select(F.col("cell").alias("p_cell"), F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)).alias("p_deal"), F.col("id").alias("p_id"), F.col("v").alias("p_v"))
        open_ = checkpoint(dealt.select("cell", "deal", "id", "v", "m").groupBy("cell", "deal").cogroup(pivots.groupBy("p_cell", "p_deal")).applyInArrow(nearest, f"cell bigint, id bigint, v {kind}, of bigint"))
    else:
        done.append(open_.drop("of"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def tasks(placed: DataFrame) -> DataFrame:
    """Adds `block` and the blocks `i`, `j` whose pairs a task counts; large cells meet in pairs of blocks."""
    n = F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")
    rows = with_count(placed, 2 * BLOCK).withColumn("n", n).withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("m", "n", "other")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """One row per input row: the key, n_links, component_id (smallest key reachable by links), kept (it is that key)."""
    rows = usable(vectors, key, vector, label)
    same = rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    name = [F.xxhash64("label", "v").alias("h1"), F.xxhash64(F.lit(17), "v", "label").alias("h2")]  # 128 bits: rows find their nodes by them
    # An id may stand for several nodes if it repeats: nodes are numbered, and the checkpoint makes the numbers last.
    nodes = checkpoint(same.select(F.monotonically_increasing_id().alias("node"), "id", "n", "v", *name, F.xxhash64(F.lit(5), "label", F.size("v")).alias("cell")))
    dealt = tasks(shards(nodes.select("cell", F.col("node").alias("id"), "v"), least)).select("cell", "i", "j", "block", "id", "v")
    spots = checkpoint(dealt.select("cell", "i", "j", "id"))
    cells = spots.groupBy("id").agg(F.array_sort(F.collect_set("cell")).alias("cells"))

    def once(shard: pa.Table, name: str = "id") -> pa.Table:
        """A shard's rows by id, each node once: two of its cells may have one name."""
        return shard.take(pa.array(np.unique(shard[name].to_numpy(), return_index=True)[1]))

    def build(shard: pa.Table) -> pa.Table:
        shard = once(shard)
        ids = shard["id"].to_numpy()
        lists, cut = robust_prune(_unit(matrix(shard["v"])), least)
        return pa.table([pa.array(ids), pa.array([ids[v] for v in lists], pa.list_(pa.int64())), pa.array(cut)], ["id", "near", "cut"])

    def search(shard: pa.Table, lists: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, ["id", "links", "root"])
        shard, lists = once(shard), once(lists, "r_id")  # both have the same ids
        ids, x = shard["id"].to_numpy(), _unit(matrix(shard["v"]))
        cell, i, j = (shard[c][0].as_py() for c in ("cell", "i", "j"))
        block = shard["block"].to_numpy()

        def walked() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            near = lists["near"].combine_chunks()
            flat, size = near.flatten().to_numpy(zero_copy_only=False), near.value_lengths().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
            here = ids[at] == flat  # neighbours in other shards only are no use in this one
            of = np.repeat(np.arange(len(ids)), size)[here]
            found = range_search(x, np.split(at[here], np.searchsorted(of, np.arange(1, len(ids)))), least)
            a, b = np.repeat(np.arange(len(ids)), [len(f) for f in found]), np.concatenate(found).astype(np.int64)
            pairs = np.unique(np.concatenate([a * len(ids) + b, b * len(ids) + a]))  # what either end has found
            a, b = pairs // len(ids), pairs % len(ids)
            mine = (np.minimum(block[a], block[b]) == i) & (np.maximum(block[a], block[b]) == j)
            yield a[mine], b[mine]

        # The pair counts here if no earlier cell holds both.
        own = lists["cells"].to_pylist()
        width = max(map(len, own))
        some = np.array([[c for c in cs if c < cell] + [None] * (width - sum(c < cell for c in cs)) for cs in own], object)
        earlier = np.where(some == None, 0, some).astype(np.int64) if width else np.zeros((len(ids), 0), np.int64)  # noqa: E711
        real = some != None  # noqa: E711
        n, total, parent = lists["n"].to_numpy(), np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a, b in products(x, np.flatnonzero(block == i), np.flatnonzero(block == j), least) if any(lists["cut"].to_pylist()) else walked():
            counts = np.ones(len(a), bool)
            for u in range(width):
                for w in range(width):
                    counts &= ~(real[a, u] & real[b, w] & (earlier[a, u] == earlier[b, w]))
            total += np.bincount(a[counts], weights=n[b[counts]], minlength=len(ids)).astype(np.int64)
            parent = merged(parent, a, b)
        return pa.table([pa.array(ids), pa.array(total), pa.array(ids[parent])], ["id", "links", "root"])

    # Building and searching share the exchange of the vectors.
    held = dealt.groupBy("cell", "i", "j")
    lists = held.applyInArrow(build, "id bigint, near array<bigint>, cut boolean")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"), F.max("cut").alias("cut"))
    ready = spots.join(united, "id").join(cells, "id").join(nodes.select(F.col("node").alias("id"), "n"), "id")
    ready = ready.select(F.col("cell").alias("r_cell"), F.col("i").alias("r_i"), F.col("j").alias("r_j"), F.col("id").alias("r_id"), "near", "cut", "cells", "n")
    found = checkpoint(held.cogroup(ready.groupBy("r_cell", "r_i", "r_j")).applyInArrow(search, "id bigint, links bigint, root bigint"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    # Components of nodes, named by their smallest id.
    named = nodes.select(F.col("node"), "id").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    facts = nodes.select("node", "h1", "h2", "n").join(links.withColumnRenamed("id", "node"), "node", "left").join(named.select("node", "component"), "node").join(smallest, "component")
    facts = facts.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "smallest")
    members = rows.select("id", *name).join(facts, ["h1", "h2"]).groupBy("id").agg(F.sum("links").alias("n_links"), F.min("smallest").alias("component_id"))
    out = vectors.select(F.col(key).cast("long").alias(key)).join(members.withColumnRenamed("id", key), key, "left")
    out = out.select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, result: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, most_queries: int = 256) -> float:
    """Share of the links of a bounded set of queries (first by a hash of the id) that `result` counts, by comparing them with all rows in blocks."""
    rows = usable(vectors, key, vector, label)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(most_queries).collect()
    if not some:
        return 1.0
    queries = [(r["id"], r["label"], _unit(np.array([r["v"]]))[0]) for r in some]

    asked: dict = {}
    for at, (_, own, q) in enumerate(queries):
        asked.setdefault((own, len(q)), []).append(at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries), np.int64)
        for batch in batches:
            groups: dict = {}
            for i, found in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).value_lengths().to_pylist(), strict=True)):
                if found in asked:
                    groups.setdefault(found, []).append(i)
            for found, of in groups.items():
                x = _unit(matrix(batch.column(1).take(pa.array(of))))
                total[asked[found]] += (x @ np.stack([queries[at][2] for at in asked[found]]).T >= least).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([q[0] for q in queries]), pa.array(total)], ["id", "total"])

    truth = rows.select("label", "v").mapInArrow(count, "id bigint, total bigint").groupBy("id").agg((F.sum("total") - 1).alias("total"))
    both = truth.join(result.select(F.col(key).alias("id"), "n_links").distinct(), "id").agg(F.sum(F.least("total", "n_links")).alias("hit"), F.sum("total").alias("all")).first()
    return both["hit"] / both["all"] if both["all"] else 1.0


def op1_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, after an audit of a bounded set of queries against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    out = checkpoint(near_duplicates(vectors))
    if (share := audit(vectors, out)) < RECALL_LEAST:
        raise RuntimeError(f"op1_vector_near_dedup: recall {share:.3f}")
    return out


#: Rows of op1_vector_near_dedup; its rows have links of a few steps only at the size where this runs.
SQL = """
WITH RECURSIVE
v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
),
r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
