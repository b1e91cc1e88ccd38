"""Near duplicates of embeddings by robust-pruned flat graphs over overlapping cluster shards.

Vectors of one label and length are compared by the cosine of their doubles.
Equal vectors of a label are one vertex from the start. Each label's vertices
are split by spherical k-means, fitted on a bounded sample (FIT rows a cluster,
by hash), until no shard has more than a few thousand; a vertex goes to its two
nearest clusters at first, and a copy of it to its nearest one below. What no
clustering takes apart is dealt by hash, and its shards are all asked by all.

A task builds the flat graph of a shard: candidates are a vertex's nearest
others, some drawn by hash and the ends of greedy searches from the medoid;
robust pruning (ALPHA) leaves at most DEGREE of them, and edges go both ways.
The graph of a label is the union of these lists: a vertex of two shards has
its list in each, and a search that comes to it goes on along both.

Every vertex is searched for: greedily from the shard's medoid and from its own
list, then the range is expanded along the lists of all that are within SLACK
of it. What it meets in another shard, or a vertex of both, makes a request
there, until no request is left. Every link is verified by its cosine in
doubles. Tasks put out what they count and a forest of the links, never the
pairs: as many rows as vertices times the shards that their range spans. A
request is answered once for a vertex and a shard, where only vertices at home
there count, so none counts twice.

The recall is audited against brute force: AUDIT vertices, drawn by hash, are
held against all vertices, and ``audit_recall`` is the share of their links
that the search found (1 where there are none).

Rows whose label is null, or whose vector is null, empty, zero or has a null or
non-finite entry, link with nothing and are components of their own. Repeated
rows and ids each count; null ids are passed over in the smallest id of a
component, unless it has no others; further columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.common import by_group, materialised, read
from wirespan.operators.components import connected_components, forest

THRESHOLD = 0.93
#: Vertices of a shard, and bytes of its vectors as doubles, at most.
SHARD, SHARD_BYTES = 2048, 8 << 20
#: Clusters of a split at most, rows that each is fitted on, and rounds of fitting.
CLUSTERS, FIT, ROUNDS = 64, 32, 6
#: Vertices that a task places at a time, and requests that it answers.
CHUNK = 8192
DEGREE, NEAREST, DRAWN, ALPHA = 24, 48, 8, 1.2
#: Candidates that a greedy search keeps, and how far below the threshold it still goes on.
BEAM, SLACK = 4, 0.05
#: Places from which a request searches, besides the medoid.
ENTRIES = 4
AUDIT = 256


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaling by powers of two first keeps squares of any doubles within range."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    scaled = np.ldexp(vectors, -exponent)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def decoded(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def _valid(batches):
    """vec_id, label and the vector's doubles as bytes; null where it links with nothing."""
    for batch in batches:
        vectors, labels = batch.column(2), batch.column(1)
        out = []
        for vector, label in zip(vectors, labels, strict=True):
            values = vector.values if vector.is_valid and label.is_valid else None
            good = values is not None and len(values) and not values.null_count
            x = np.asarray(values.to_numpy(zero_copy_only=False), np.float64) + 0.0 if good else None  # -0.0 becomes 0.0
            out.append(x.tobytes() if good and np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), labels, pa.array(out, pa.binary())], ["vec_id", "label", "vec"])


def clusters(frame: pd.DataFrame, k: int) -> np.ndarray:
    """k unit centres of a sample of rows (v, vec), in an order that only hashes decide."""
    x = unit(decoded(frame.sort_values("v").vec.tolist()))
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (x @ centre.T).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, nearest, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centre = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centre)
    return centre


def pruned(vec: np.ndarray, at: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: of each row's candidates (-1: none) the nearest, without those it covers, then the nearest left, and so on."""
    out = np.full((len(at), degree), -1, np.int32)
    safe = np.maximum(candidates, 0)
    near = np.einsum("id,ijd->ij", vec[at], vec[safe])
    alive = (candidates >= 0) & (candidates != at[:, None])
    order = np.argsort(np.where(alive, -near, np.inf), axis=1, kind="stable")
    safe, near, alive = (np.take_along_axis(x, order, 1) for x in (safe, near, alive))
    alive[:, 1:] &= ~((safe[:, 1:] == safe[:, :-1]) & alive[:, :-1])
    group = vec[safe]
    far = 2 - 2 * near
    rows = np.arange(len(at))
    for k in range(degree):
        best = alive.argmax(axis=1)
        some = alive[rows, best]
        if not some.any():
            break
        out[some, k] = safe[some, best[some]]
        apart = 2 - 2 * np.einsum("id,ijd->ij", group[rows, best], group)
        alive &= ~(some[:, None] & (ALPHA * ALPHA * apart <= far))
        alive[rows, best] = False
    return out


def built(vec: np.ndarray) -> tuple[np.ndarray, int]:
    """(lists of at most 2 DEGREE neighbours, -1 after the last; medoid) of unit vectors."""
    n = len(vec)
    medoid = int((vec @ vec.sum(axis=0)).argmax())
    if n == 1:
        return np.full((1, 1), -1, np.int32), medoid
    k = min(NEAREST, n - 1)
    lists = np.empty((n, DEGREE), np.int32)
    step = 256
    drawn = np.random.default_rng(n).integers(0, n, (n, DRAWN))
    for a in range(0, n, step):
        at = np.arange(a, min(n, a + step))
        near = vec[at] @ vec.T
        near[np.arange(len(at)), at] = -3
        nearest = np.argpartition(-near, k - 1, axis=1)[:, :k]
        lists[at] = pruned(vec, at, np.concatenate([nearest, drawn[at]], axis=1), DEGREE)
    # Edges both ways: what a vertex cannot hold is pruned again, with the ends of a search from the medoid.
    source, target = np.repeat(np.arange(n), DEGREE), lists.ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    rank = np.arange(len(target)) - np.searchsorted(target, target)
    back = np.full((n, 2 * DEGREE), -1, np.int32)
    held = rank < 2 * DEGREE
    back[target[held], rank[held]] = source[held]
    both = np.concatenate([lists, back], axis=1)
    out = np.empty((n, DEGREE), np.int32)
    for a in range(0, n, step):
        at = np.arange(a, min(n, a + step))
        reached, _ = greedy(vec, lists, vec[at], np.full((len(at), 1), medoid), None)
        out[at] = pruned(vec, at, np.concatenate([both[at], reached], axis=1), DEGREE)
    # A search must come to each vertex from somewhere: the edges to its nearest ones are kept both ways.
    first = np.where(out[:, :2] >= 0, out[:, :2], np.arange(n)[:, None])
    source, target = first.ravel(), np.repeat(np.arange(n), 2)
    order = np.argsort(source, kind="stable")
    source, target = source[order], target[order]
    rank = np.arange(len(source)) - np.searchsorted(source, source)
    more = np.full((n, DEGREE), -1, np.int32)
    held = (rank < DEGREE) & (source != target)
    more[source[held], rank[held]] = target[held]
    return np.concatenate([out, more], axis=1), medoid


def greedy(vec: np.ndarray, lists: np.ndarray, q: np.ndarray, starts: np.ndarray, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Searches for rows of q from starts (-1: none): the BEAM nearest vertices found and their cosines; seen (q x n) is brought up to date."""
    seen = np.zeros((len(q), len(vec)), bool) if seen is None else seen
    ids, near = np.full((len(q), BEAM), -1, np.int32), np.full((len(q), BEAM), -3.0)
    done = np.ones((len(q), BEAM), bool)

    def visit(rows: np.ndarray, found: np.ndarray) -> None:
        good = found >= 0
        good &= ~seen[rows[:, None], np.maximum(found, 0)]
        i, j = np.nonzero(good)
        value = np.full(found.shape, -3.0)
        value[i, j] = np.einsum("ij,ij->i", q[rows[i]], vec[found[i, j]])
        seen[rows[i], found[i, j]] = True
        all_ids, all_near = np.concatenate([ids[rows], found], axis=1), np.concatenate([near[rows], value], axis=1)
        all_done = np.concatenate([done[rows], ~good], axis=1)
        top = np.argpartition(-all_near, BEAM - 1, axis=1)[:, :BEAM]
        ids[rows], near[rows], done[rows] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_near, all_done))

    every = np.arange(len(q))
    for c in range(starts.shape[1]):  # one by one, as two starts may be the same
        visit(every, starts[:, c : c + 1])
    while len(rows := np.flatnonzero(~done.all(axis=1))):
        best = np.where(done[rows], -4.0, near[rows]).argmax(axis=1)
        done[rows, best] = True
        visit(rows, lists[ids[rows, best]])
    return ids, near


def ranged(vec: np.ndarray, lists: np.ndarray, q: np.ndarray, starts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of q, vertex, cosine) of at least the threshold: a greedy search, whose range is then expanded."""
    found: list[tuple] = []
    seen = np.zeros((len(q), len(vec)), bool)
    greedy(vec, lists, q, starts, seen)
    i, j = np.nonzero(seen)
    while len(i):
        near = np.concatenate([np.einsum("ij,ij->i", q[i[a : a + 65536]], vec[j[a : a + 65536]]) for a in range(0, len(i), 65536)])
        hit = near >= threshold
        found.append((i[hit], j[hit], near[hit]))
        go = near >= threshold - SLACK
        i, j = i[go], j[go]
        codes = []
        for a in range(0, len(i), 65536):
            nexts = lists[j[a : a + 65536]]
            rows = np.broadcast_to(i[a : a + 65536, None], nexts.shape)
            rows, nexts = rows[nexts >= 0], nexts[nexts >= 0]
            new = ~seen[rows, nexts]
            codes.append(np.unique(rows[new].astype(np.int64) * len(vec) + nexts[new]))
            seen[rows[new], nexts[new]] = True
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        i, j = code // len(vec), code % len(vec)
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, int) for k in range(3))


#: What tasks put out. kind: a count (q, n), a link (q, v), a request (q at node, from v with a cosine), a shard (node, blob).
COUNT, LINK, REQUEST, BUILT = 0, 1, 2, 3
OUT = "kind tinyint, q bigint, v bigint, node string, n bigint, near double, blob binary"


def _rows(kind: int, **columns) -> pd.DataFrame:
    size = len(next(iter(columns.values())))
    empty = {"q": 0, "v": 0, "node": None, "n": 0, "near": 0.0, "blob": None}
    return pd.DataFrame({"kind": np.full(size, kind, np.int8)} | {c: columns.get(c, [e] * size) for c, e in empty.items()})


def answers(node: str, shard: dict, vec: np.ndarray, q_ids: np.ndarray, q: np.ndarray, starts: np.ndarray, threshold: float) -> list[pd.DataFrame]:
    """Counts, links and requests of searches for the rows of q in one shard."""
    ids, places = shard["ids"], shard["places"]
    out = []
    for a in range(0, len(q), 1024):
        part = slice(a, a + 1024)
        i, j, near = ranged(vec, shard["lists"], q[part], starts[part], threshold)
        own = q_ids[part]
        other = ids[j] != own[i]
        i, j, near = i[other], j[other], near[other]
        counts = np.bincount(i, np.where(shard["home"][j], shard["copies"][j], 0), len(own)).astype(np.int64)
        some = np.flatnonzero(counts)
        out.append(_rows(COUNT, q=own[some], n=counts[some]))
        names, number = np.unique(np.concatenate([own[i], ids[j]]), return_inverse=True)
        _, used = forest(number[: len(i)], number[len(i) :], len(names))
        out.append(_rows(LINK, q=own[i[used]], v=ids[j[used]]))
        elsewhere = [(k, p) for k in np.unique(j) for p in places[k] if p != node]
        if elsewhere:
            at = pd.DataFrame(elsewhere, columns=["j", "node"])
            asks = pd.DataFrame({"q": own[i], "j": j, "near": near}).merge(at, on="j").sort_values(["q", "node", "near"], ascending=[True, True, False])
            asks = asks.groupby(["q", "node"]).head(ENTRIES)
            out.append(_rows(REQUEST, q=asks.q.to_numpy(), v=ids[asks.j.to_numpy()], node=asks.node.to_numpy(), near=asks.near.to_numpy()))
    return out


def packed(shard: dict) -> bytes:
    buffer = io.BytesIO()
    flat = [p for ps in shard["places"] for p in ps]
    np.savez(buffer, **{k: shard[k] for k in ("ids", "vec", "home", "copies", "lists", "medoid")}, places=np.array(flat, dtype=str), ends=np.cumsum([len(p) for p in shard["places"]]))
    return buffer.getvalue()


def unpacked(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob)) as z:
        shard = {k: z[k] for k in ("ids", "vec", "home", "copies", "lists", "medoid")}
        shard["places"] = [p.tolist() for p in np.split(z["places"], z["ends"][:-1])]
    return shard


def split(members: DataFrame, limit: int) -> DataFrame:
    """Rows (node, v, vec, main) of shards with at most about ``limit`` vertices, from rows of whole labels; main is false for further copies.

    A node's name has the way to it; parts of what no clustering takes apart end with ~ and a number.
    """
    done: list[DataFrame] = []
    while True:
        sizes = materialised(members.groupBy("node").agg(F.count("*").alias("size")))
        large = sizes.where(F.col("size") > limit)
        if not large.limit(1).count():
            return members if not done else _union([*done, members])
        both = materialised(by_group(members, sizes, ["node"], "size", "v"))
        done.append(both.where(F.col("size") <= limit).drop("size"))
        both = both.where(F.col("size") > limit)
        k = F.least(F.lit(CLUSTERS), F.ceil(F.col("size") * 4 / limit)).cast("int")
        hashed = F.pmod(F.xxhash64("v", F.lit("fit")), F.lit(1 << 30))
        sample = both.where(hashed < F.lit(float(FIT << 30)) * k / F.col("size")).withColumn("k", k).select("node", "v", "vec", "k")

        def fitted(frame: pd.DataFrame) -> pd.DataFrame:
            centres = clusters(frame, int(frame.k.iloc[0]))
            return pd.DataFrame({"node": [frame.node.iloc[0]], "centres": [centres.tobytes()]})

        fits = materialised(sample.groupBy("node").applyInPandas(fitted, "node string, centres binary"))
        parts = F.ceil(F.col("size") / CHUNK)
        rows = both.withColumn("part", F.pmod(F.xxhash64("v"), parts))
        centres = fits.join(large, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).select("node", "part", "centres")

        def placed(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left):
                return pd.DataFrame({"node": [], "child": [], "v": [], "vec": [], "main": []})
            x = unit(decoded(left.vec.tolist()))
            if not len(right):  # no row of a small sample: one child, which is dealt by hash
                order = np.zeros((len(x), 1), int)
            else:
                near = x @ np.frombuffer(right.centres.iloc[0], np.float64).reshape(-1, x.shape[1]).T
                order = np.argsort(-near, axis=1, kind="stable")[:, :2]
            first = pd.DataFrame({"node": left.node, "child": order[:, 0], "v": left.v, "vec": left.vec, "main": left.main})
            if order.shape[1] == 1:
                return first
            second = first.assign(child=order[:, 1], main=False)[left.main.to_numpy()]
            return pd.concat([first, second])

        children = materialised(rows.groupBy("node", "part").cogroup(centres.groupBy("node", "part")).applyInPandas(placed, "node string, child int, v bigint, vec binary, main boolean"))
        counts = children.groupBy("node", "child").agg(F.count("*").alias("n"))
        counts = materialised(counts.join(large, "node"))
        children = by_group(children, counts, ["node", "child"], "n", "v")
        name = F.concat_ws(".", "node", "child")
        dealt = F.concat(name, F.lit("~"), F.pmod(F.xxhash64("v", F.lit("deal")), F.ceil(F.col("n") * 2 / limit)).cast("string"))
        stuck = (F.col("n") > limit) & (F.col("n") > 0.9 * F.col("size"))
        children = materialised(children.withColumn("stuck", stuck).select(F.when(stuck, dealt).otherwise(name).alias("node"), "v", "vec", "main", "stuck"))
        done.append(children.where("stuck").drop("stuck"))
        members = children.where("not stuck").drop("stuck")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def search(vertices: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(q, n: other vertices' rows linked; links q, v that join what is linked) of vertices (v, node, vec, copies) in nodes (node, size, bytes)."""
    widest = nodes.agg(F.coalesce(F.max("bytes"), F.lit(8))).first()[0]
    limit = max(64, min(shard, SHARD_BYTES // widest))
    members = materialised(split(vertices.select("node", "v", "vec", F.lit(True).alias("main")), limit))
    places = members.groupBy("v").agg(F.collect_set("node").alias("places"))
    dealt = members.join(places, "v").join(vertices.select("v", "copies"), "v")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("v")
        raw = decoded(frame.vec.tolist())
        vec = unit(raw)
        lists, medoid = built(vec)
        made = {"ids": frame.v.to_numpy(), "vec": raw, "home": frame.main.to_numpy(), "copies": frame.copies.to_numpy(), "lists": lists, "medoid": np.int64(medoid), "places": frame.places.tolist()}
        starts = np.stack([np.full(len(vec), medoid), np.arange(len(vec))], axis=1)
        node = frame.node.iloc[0]
        return pd.concat([_rows(BUILT, node=[node], blob=[packed(made)]), *answers(node, made, vec, made["ids"], vec, starts, threshold)])

    first = materialised(dealt.groupBy("node").applyInPandas(build, OUT))
    shards = first.where(F.col("kind") == BUILT).select("node", "blob")
    found = [first]
    asked = members.select("v", "node").withColumnRenamed("v", "q")

    def requests(out: DataFrame) -> DataFrame:
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("near")).alias("less"), F.col("v")))), 1, ENTRIES)
        return out.where(F.col("kind") == REQUEST).groupBy("q", "node").agg(best.getField("v").alias("entries"))

    # Shards that were dealt by hash are asked by all of their family.
    family = F.substring_index("node", "~", 1)
    parts = members.where("node like '%~%'").select(family.alias("family"), F.col("node").alias("other")).distinct()
    all_ask = members.where("node like '%~%'").select(F.col("v").alias("q"), family.alias("family"), "node").join(parts, "family").where("other != node")
    new = requests(first).unionByName(all_ask.select("q", F.col("other").alias("node"), F.array().cast("array<bigint>").alias("entries")))

    def answer(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _rows(COUNT, q=np.zeros(0, np.int64))
        shard = unpacked(right.blob.iloc[0])
        vec = unit(shard["vec"])
        starts = np.full((len(left), ENTRIES + 1), -1, np.int64)
        starts[:, 0] = shard["medoid"]
        for i, entries in enumerate(left.entries):
            at = np.searchsorted(shard["ids"], entries)
            starts[i, 1 : 1 + len(entries)] = at
        return pd.concat(answers(key[0], shard, vec, left.q.to_numpy(), unit(decoded(left.vec.tolist())), starts, threshold))

    while True:
        new = new.groupBy("q", "node").agg(F.max("entries").alias("entries"))
        new = materialised(new.join(asked, ["q", "node"], "left_anti"))
        if not new.limit(1).count():
            break
        asked = asked.unionByName(new.select("q", "node"))
        n = materialised(new.groupBy("node").agg(F.count("*").alias("asks")))
        part = F.ceil(F.col("asks") / CHUNK)
        rows = by_group(new, n, ["node"], "asks", "q").withColumn("part", F.pmod(F.xxhash64("q"), part)).join(vertices.select(F.col("v").alias("q"), "vec"), "q")
        held = shards.join(n, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), part - 1))).select("node", "part", "blob")
        out = materialised(rows.groupBy("node", "part").cogroup(held.groupBy("node", "part")).applyInPandas(answer, OUT))
        found.append(out)
        new = requests(out)
    every = _union(found)
    return every.where(F.col("kind") == COUNT).groupBy("q").agg(F.sum("n").alias("n")), every.where(F.col("kind") == LINK).select("q", "v")


def audit(vertices: DataFrame, found: DataFrame, threshold: float = THRESHOLD, n: int = AUDIT) -> float:
    """The share of the links of n vertices, drawn by hash, that were found (v, n), by holding them against all vertices."""
    drawn = vertices.select("v", "node", "vec").orderBy(F.xxhash64("v", F.lit("audit")), "v").limit(n).collect()
    groups: dict[str, tuple] = {}
    for node in {r.node for r in drawn}:
        own = [r for r in drawn if r.node == node]
        groups[node] = (np.array([r.v for r in own]), unit(decoded([bytes(r.vec) for r in own])))
    sent = vertices.sparkSession.sparkContext.broadcast(groups)  # n vectors at most

    def held(batches):
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), object)
            ids, vecs, copies = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            for node in set(names.tolist()) & set(sent.value):
                own, q = sent.value[node]
                at = np.flatnonzero(names == node)
                x = unit(decoded(vecs.take(pa.array(at)).to_pylist()))
                links = (q @ x.T >= threshold) & (own[:, None] != ids[at][None, :])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(links @ copies[at])], ["v", "links"])

    true = vertices.select("v", "node", "vec", "copies").mapInArrow(held, "v bigint, links bigint").groupBy("v").agg(F.sum("links").alias("links"))
    both = true.join(found.select("v", "n"), "v", "left").agg(F.sum("links").alias("links"), F.sum(F.least("links", F.coalesce("n", F.lit(0)))).alias("found")).first()
    return both.found / both.links if both.links else 1.0


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept, audit_recall; ``shard`` bounds the vertices of a shard."""
    source = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    all_rows = materialised(source.mapInArrow(_valid, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vec binary"))
    good = all_rows.where("vec is not null")
    vertices = good.groupBy("label", "vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    vertices = materialised(vertices.withColumn("v", F.monotonically_increasing_id()))
    bytes_ = F.octet_length("vec")
    nodes = materialised(vertices.groupBy("label", bytes_.alias("bytes")).agg(F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id().cast("string")))
    named = materialised(by_group(vertices.withColumn("bytes", bytes_), nodes, ["label", "bytes"], "size", "v").select("v", "node", "size", "vec", "copies"))
    several = named.where("size > 1").drop("size")
    counts, links = search(several, nodes.where("size > 1"), threshold, shard)
    counts = materialised(counts.withColumnRenamed("q", "v"))
    recall = audit(several, counts, threshold)
    parts = connected_components(links, "q", "v")
    joined = materialised(vertices.join(counts, "v", "left").join(parts, "v", "left").withColumn("component", F.coalesce("component", "v")).withColumn("links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1))
    least = materialised(joined.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("size")))
    known = materialised(by_group(joined, least, ["component"], "size", "v").select("label", "vec", "links", "component_id", "copies"))
    linked = by_group(good, known, ["label", "vec"], "copies", "vec_id").select("vec_id", "links", "component_id")
    out = linked.unionByName(all_rows.where("vec is null").select("vec_id", F.lit(0).alias("links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", F.col("links").cast("bigint").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(float(recall)).alias("audit_recall"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: All pairs of a label, and the smallest id that links reach. Brute force finds every link, so the audited recall has to be 1.
ORACLE_SQL = f"""
with recursive good as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c))) and list_bool_or(list_transform(embedding, lambda c: c != 0))),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id != b.vec_id and list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(v, r) as (select vec_id, vec_id from embeddings union select reach.v, links.b from reach join links on links.a = reach.r)
select e.vec_id, (select count(*) from links where links.a = e.vec_id)::bigint as n_links, (select min(r) from reach where reach.v = e.vec_id) as component_id,
  e.vec_id = (select min(r) from reach where reach.v = e.vec_id) as kept, 1::double as audit_recall
from embeddings e
"""
