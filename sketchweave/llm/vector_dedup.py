"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors form one class with a weight.  Class vectors are assigned to
overlapping shards by their nearest centroids; every shard builds the neighbour
lists of its members and prunes them robustly; the lists that one vector has in
several shards are united.  Each vector then searches the shards nearest to it,
greedily from the shard's medoids, and goes on expanding while vectors within
the range appear.  What is found is verified by cosine in double precision.
An audit compares a hashed sample of queries, drawn whatever was found for them,
with brute force; the sample grows until enough of its queries have links.  If
the recall is under the target, the search is done again over twice as many
shards, and over all of them at last by exact blocks instead of graphs.

A vector counts in its home shard only, so no pair has to be removed again, and
links leave a task as counts and as a spanning forest.

Vectors are compared with those of their own width, one width after the other.

Defined results: vectors that are null, zero or hold a null or non-finite
component have no links and are their own component;
repeated rows are links of each other; rows with a null id link like others,
but a component is named by its smallest id that isn't null (null if it has
none); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, pick, shuffle_width
from .components import components

RANGE = 0.95
#: Vectors of a shard on average; most centroids (the bound of what is broadcast); most vectors of a shard before it is split.
SHARD, CENTROIDS, SPLIT = 512, 4096, 8192
#: Shards that a vector stands in and searches; sample that centroids are fitted on.
OVERLAP, VISITS, FIT_ROWS = 2, 4, 20_000
#: Neighbours considered and kept, pruning factor, width of the search, medoids, members expanded and vectors gathered at a time.
NEAR, DEGREE, ALPHA, BEAM, MEDOIDS, EXPAND, GATHER = 48, 16, 1.2, 16, 4, 8, 1 << 16
#: Queries that an audit starts with and stops at, those with links that are enough, and the least recall.
AUDIT, MOST_AUDITED, ENOUGH, RECALL = 64, 4096, 64, 0.95
QUERIES = 512


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def centroids_of(x: np.ndarray, k: int, seed: int = 6, rounds: int = 8) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(axis=1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists: of the nearest, one stays if no kept one is clearly nearer to it than the node is."""
    m, out = len(x), []
    near = min(NEAR, m - 1)
    for a in range(0, m, QUERIES):
        part = np.arange(a, min(a + QUERIES, m))
        s = x[part] @ x.T
        s[np.arange(len(part)), part] = -2
        cand = np.argpartition(s, -near, axis=1)[:, -near:] if near else np.zeros((len(part), 0), np.int64)
        order = np.argsort(-np.take_along_axis(s, cand, axis=1), axis=1, kind="stable")
        cand = np.take_along_axis(cand, order, axis=1)
        dist = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(s, cand, axis=1)))
        alive, kept = np.ones(cand.shape, bool), np.zeros(cand.shape, bool)
        vec = x[cand]
        for j in range(cand.shape[1]):
            take = alive[:, j] & (kept.sum(axis=1) < DEGREE)
            kept[:, j] = take
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", vec[:, j], vec)))
            alive &= ~(take[:, None] & (ALPHA * between <= dist))
        out += [cand[i][kept[i]] for i in range(len(part))]
    return out


def medoids(x: np.ndarray) -> np.ndarray:
    """The members nearest to the mean and to a few spread directions."""
    first = int((x @ x.mean(axis=0)).argmax())
    chosen, best = [first], x @ x[first]
    while len(chosen) < min(MEDOIDS, len(x)):
        chosen.append(int(best.argmin()))
        best = np.maximum(best, x @ x[chosen[-1]])
    return np.array(chosen)


def reaching(nbr: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The starts, and one more for every part of the graph that they don't reach."""
    seen = np.zeros(len(nbr), bool)
    seen[start] = True
    edge, more = start, []
    while True:
        while len(edge):
            to = np.unique(nbr[edge])
            edge = to[~seen[to]]
            seen[edge] = True
        if seen.all():
            return np.concatenate([start, np.array(more, np.int64)])
        more.append(int(np.flatnonzero(~seen)[0]))
        edge = np.array(more[-1:])
        seen[edge] = True


def search(q: np.ndarray, x: np.ndarray, nbr: np.ndarray, start: np.ndarray, limit: float) -> np.ndarray:
    """Greedy search of every query at once.  A step expands a few of the best open members of each query, and
    every visited member within ``limit``, so that a range of very many members takes few steps.

    nbr: members x degree, padded with the member itself.  Returns the similarities of visited members, -2 elsewhere.
    """
    n, m = len(q), len(x)
    seen = np.full((n, m), -2.0, np.float32)
    open_ = np.full((n, m), -2.0, np.float32)
    seen_flat, open_flat, reached = seen.ravel(), open_.ravel(), np.zeros(n * m, bool)
    rows = np.arange(n)
    s = q @ x[start].T
    seen[:, start] = s
    open_[:, start] = s
    beam, most = min(BEAM, m), min(EXPAND, m)
    while len(rows):
        waiting = open_[rows]
        best = np.argpartition(waiting, m - most, axis=1)[:, m - most :]
        value = np.take_along_axis(waiting, best, axis=1)
        bar = np.partition(seen[rows], m - beam, axis=1)[:, m - beam, None]
        go = waiting >= limit
        np.put_along_axis(go, best, (value > -2) & ((value >= bar) | (value >= limit)), axis=1)
        of, at = np.nonzero(go)
        of = rows[of]
        rows = rows[go.any(axis=1)]
        open_[of, at] = -2
        for a in range(0, len(of), GATHER // 4):
            key = (of[a : a + GATHER // 4, None] * m + nbr[at[a : a + GATHER // 4]]).ravel()
            reached[key[seen_flat[key] <= -2]] = True
            new = np.flatnonzero(reached)
            reached[new] = False
            for b in range(0, len(new), GATHER):
                k = new[b : b + GATHER]
                seen_flat[k] = open_flat[k] = np.einsum("nd,nd->n", q[k // m], x[k % m])
    return seen


def read_groups(batches, key: int):
    """(key, table) of consecutive rows with one key."""
    held = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        cuts = np.append(np.append(0, np.flatnonzero(k[1:] != k[:-1]) + 1), len(k))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b <= a:
                continue
            if held and held[0].column(key)[0].as_py() != int(k[a]):
                yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(key)[0].as_py(), pa.Table.from_batches(held)


def vectors(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def clean(rows: DataFrame) -> DataFrame:
    """rows: id, vec.  Adds ok; vec as an array of doubles."""
    vec = F.col("vec").cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)
    return rows.select("id", F.transform(vec, lambda x: x + F.lit(0.0)).alias("vec"), F.coalesce(ok, F.lit(False)).alias("ok"))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", limit: float = RANGE, visits: int = VISITS, audit: int = AUDIT) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    buckets = shuffle_width(df.sparkSession)
    scratch = Scratch(df.sparkSession, "vectors")
    rows = pick(df, id=id_col, vec=vec_col).select(F.col("id").cast("long").alias("id"), "vec")
    rows = clean(rows)
    # Classes have a number of their own, whatever ids they have; rep is stable, as the table is written.
    equal = rows.where("ok").groupBy("vec").agg(F.min("id").alias("low"), F.count("*").alias("w")).sortWithinPartitions("vec")
    classes = scratch.table(equal.withColumn("rep", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy(F.size("vec").alias("width")).count().orderBy("width").collect()
    tops = classes.select("vec", "low", (F.col("w") - 1).alias("n_links"), F.col("rep").alias("component")).limit(0)
    for width, n in sizes:
        one = classes.where(F.size("vec") == width) if len(sizes) > 1 else classes
        counts, edges = _search(one, n, width, limit, visits, buckets, audit, scratch)
        found = components(edges, scratch)
        named = one.select("vec", "low", "rep", "w").join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        part = named.select("vec", "low", (F.coalesce("near", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
        tops = part if len(sizes) == 1 else tops.unionByName(part)
    # Written, so that the join reads plain shuffles and a large component can be split over tasks.
    lows = scratch.table(tops.groupBy("component").agg(F.min("low").alias("name")), "names")
    tops = tops.join(lows, "component").select("vec", "n_links", "name")
    good = rows.where("ok").join(tops, "vec").select("id", "n_links", F.col("name").alias("component_id"))
    bad = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return scratch.result(good.unionByName(bad).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def _search(classes: DataFrame, n: int, width: int, limit: float, visits: int, buckets: int, audit: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    share = min(1.0, FIT_ROWS / n)
    sample = classes.where(F.pmod(F.xxhash64(F.lit(6), "vec"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("rep", "vec").limit(2 * FIT_ROWS).toArrow().sort_by("rep")
    x = unit(np.array(sample["vec"].to_pylist() or classes.select("vec").limit(1).toArrow()["vec"].to_pylist(), np.float64))
    cells = centroids_of(x, min(CENTROIDS, -(-n // SHARD), len(x)))
    shared = spark.sparkContext.broadcast(cells)
    exact = False
    while True:
        counts, edges, recall = _search_once(classes, shared, len(cells), width, limit, min(visits, len(cells)), buckets, audit, exact, scratch)
        if recall >= RECALL or exact:
            return counts, edges
        exact = visits >= len(cells)
        visits *= 2


def _search_once(classes, shared, k, width, limit, visits, buckets, audit, exact, scratch):
    def assign(batches):
        cells = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, width)
            s = unit(v) @ cells.T
            top = np.argsort(-s, axis=1, kind="stable")[:, :visits]
            m = len(v)
            packed = pa.array([r.tobytes() for r in v], pa.binary())
            for rank in range(visits):
                yield pa.RecordBatch.from_arrays([pa.array(top[:, rank].astype(np.int64)), pa.array(np.full(m, rank), pa.int32()), batch.column(0), batch.column(1), packed], names=["cell", "rank", "rep", "w", "vec"])

    placed = classes.select("rep", "w", "vec").mapInArrow(assign, "cell long, rank int, rep long, w long, vec binary")
    placed = scratch.table(placed, "shards")
    # At most CENTROIDS rows, so a broadcast of a bounded size.
    parts = placed.where(F.col("rank") < OVERLAP).groupBy("cell").agg(F.ceil(F.count("*") / F.lit(SPLIT)).cast("long").alias("parts"))
    placed = placed.join(F.broadcast(parts), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    member = F.col("rank") < OVERLAP
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    shard = F.col("cell") * (1 << 20) + F.col("part")
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(shard.alias("shard"), (member & (F.col("part") == own)).alias("member"), ((F.col("rank") == 0) & (F.col("part") == own)).alias("home"), "rep", "w", "vec")

    def build(batches):
        for _, t in read_groups(batches, 0):
            x = unit(vectors(t["vec"], width)).astype(np.float32)
            rep = t["rep"].to_numpy()
            lists = prune(x) if len(x) > 1 else [np.zeros(0, np.int64)] * len(x)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array([rep[i].tolist() for i in lists], pa.list_(pa.int64()))], names=["rep", "near"])

    by_shard = lambda df: df.repartition(buckets, "shard").sortWithinPartitions("shard", "rep")
    lists = by_shard(placed.where("member").select("shard", "rep", "vec")).mapInArrow(build, "rep long, near array<long>")
    # One list per shard that a vector stands in: at most OVERLAP of DEGREE each.
    united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def look(batches):
        for _, t in read_groups(batches, 0):
            member = t["member"].to_numpy(zero_copy_only=False)
            at = np.flatnonzero(member)
            if not len(at):
                continue
            rep, home, weight = t["rep"].to_numpy(), t["home"].to_numpy(zero_copy_only=False)[at], t["w"].to_numpy()
            double = unit(vectors(t["vec"], width))
            q, x = double.astype(np.float32), double[at].astype(np.float32)
            place = {r: i for i, r in enumerate(rep[at].tolist())}
            degree = OVERLAP * DEGREE
            nbr = np.repeat(np.arange(len(at))[:, None], degree, axis=1)
            near = t["near"].to_pylist()
            for i, row in enumerate(at.tolist()):
                inside = [place[r] for r in near[row] or () if r in place]
                nbr[i, : len(inside)] = inside
            # Links back, so that every member can be reached.
            back = [[] for _ in at]
            for i in range(len(at)):
                for j in set(nbr[i].tolist()) - {i}:
                    if len(back[j]) < degree:
                        back[j].append(i)
            extra = np.repeat(np.arange(len(at))[:, None], degree, axis=1)
            for j, b in enumerate(back):
                extra[j, : len(b)] = b
            nbr = np.concatenate([nbr, extra], axis=1)
            start = reaching(nbr, medoids(x))
            total, left, right = np.zeros(len(rep), np.int64), [], []
            # Spanning forest: part of every vector of the shard; of links into one part, one is kept.
            part = np.arange(len(rep))
            for a in range(0, len(rep), QUERIES):
                found = q[a : a + QUERIES] @ x.T if exact else search(q[a : a + QUERIES], x, nbr, start, limit - 0.05)
                i, j = np.nonzero((found >= limit - 1e-4) & home[None, :])
                i, j = i + a, at[j]
                ok = np.concatenate([np.einsum("nd,nd->n", double[i[b : b + GATHER]], double[j[b : b + GATHER]]) >= limit for b in range(0, len(i), GATHER)] or [np.zeros(0, bool)]) & (i != j)
                i, j = i[ok], j[ok]
                total += np.bincount(i, weight[j], len(rep)).astype(np.int64)
                begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
                for b, e in zip(begin.tolist(), [*begin[1:].tolist(), len(i)]):
                    u, to = int(i[b]), j[b:e]
                    other = part[to]
                    for p in np.unique(other[other != part[u]]).tolist():
                        left.append(int(rep[u])), right.append(int(rep[to[other == p][0]]))
                        part[part == p] = part[u]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(total[some]), pa.nulls(len(some), pa.int64())], names=["a", "n", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.nulls(len(left), pa.int64()), pa.array(right, pa.int64())], names=["a", "n", "b"])

    found = by_shard(placed.join(united, "rep", "left").select("shard", "member", "home", "rep", "w", "vec", "near")).mapInArrow(look, "a long, n long, b long")
    found = scratch.table(found, "links")
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    return counts, found.where("b IS NOT NULL").select("a", "b"), audited(classes, counts, width, limit, audit)


def audited(classes: DataFrame, counts: DataFrame, width: int, limit: float, size: int) -> float:
    """Recall of a hashed sample of queries against brute force over all class vectors: of links, or of queries on average if that is less.

    The sample starts with about ``size`` queries and grows until ENOUGH of them have links, at most to MOST_AUDITED or all vectors.
    """
    if not size:
        return 1.0
    n = classes.count()
    while True:
        share = int(min(1.0, size / max(1, n)) * (1 << 30))
        picked = classes.where(F.pmod(F.xxhash64(F.lit(11), "vec"), F.lit(1 << 30)) < share).select("rep", "vec").toArrow()
        truth = _true_links(classes, picked, width, limit) if len(picked) else []
        if len(truth) >= ENOUGH or size >= min(n, MOST_AUDITED):
            break
        size = min(8 * size, MOST_AUDITED)
    if not truth:
        return 1.0
    found = {r.rep: r.near for r in counts.where(F.col("rep").isin([r.rep for r in truth])).collect()}
    pairs = [(min(r.n, found.get(r.rep, 0)), r.n) for r in truth]
    return min(sum(a for a, _ in pairs) / sum(b for _, b in pairs), sum(a / b for a, b in pairs) / len(pairs))


def _true_links(classes: DataFrame, picked: pa.Table, width: int, limit: float) -> list:
    """(rep, n) of the picked vectors that have links."""
    shared = classes.sparkSession.sparkContext.broadcast((picked["rep"].to_numpy(), unit(np.array(picked["vec"].to_pylist(), np.float64))))

    def run(batches):
        ids, q = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            v = np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, width)
            rep, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a in range(0, len(v), QUERIES):
                i, j = np.nonzero(unit(v[a : a + QUERIES]) @ q.T >= limit)
                other = rep[a + i] != ids[j]
                np.add.at(total, j[other], w[a + i[other]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["rep", "n"])

    return classes.select("rep", "w", "vec").mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n")).collect()
