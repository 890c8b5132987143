"""Approximate nearest neighbours by NN-descent: a neighbour graph from neighbours of neighbours, greedy search.

Equal vectors are one node, with the smallest vec_ids that can be asked for. Nodes start with neighbours from leaves: in
each of TABLES random orders, by the signs of random projections, nodes that stand together are compared. The graph has a
row per node: the node, its DEGREE nearest and at most REVERSE of the nodes that list it (chosen by hash), each as a record
with its vector. A round is one exchange: each node takes what it was told into its list, compares its neighbours with each
other where one is new, tells each of those that are nearer than the last of its list, and tells those that it lists anew
who lists them. Of what a node is told only what can matter of a task's batch travels, so that a node in the midst of many lists gets
a bounded number from each. Rounds end when less than SETTLED of the entries are new; a round's table is deleted when
the next is written. A query starts at its own node and goes on from all of the BEAM best nodes that it hasn't gone on from,
until there is none: the front meets the graph, and what is near enough goes back to the query by one exchange. For all this
vectors are rounded to bytes; the BEAM best are then compared by exact cosines.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose length isn't the most
frequent one. Repeated rows of one vec_id are one row if equal; a query is never its own answer. With fewer than k
candidates all are returned. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonescope.llm.common import discard, only, pick_parts, settle

DEGREE = 32
REVERSE = 16
TABLES, LEAF, LEAF_LINKS = 6, 256, 8
#: Rows of a range of the random orders, a row per node and order; ranges are cut into leaves.
RANGE = 8192
OFFERS = 3
ROUNDS, SETTLED = 8, 0.03
BEAM = 128
#: How a node knows another: it is the node itself, it was listed, it was known to list the node, it now lists it, it is offered.
SELF, LISTED, BACKED, BACK, OFFER = range(5)
#: What a query has gone on from, and what it hasn't.
DONE, OPEN = range(2)
#: Groups compared at once, and records of one node held at once, in a task.
AT_ONCE, HELD = 1024, 20_000
MIXER = 0x9E3779B97F4A7C15


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the vectors that take part."""
    vec = F.col("embedding").cast("array<double>")
    rows = only(vectors, "vec_id", "embedding").select("vec_id", vec.alias("vec")).where(
        "vec is not null and vec_id is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf'))"
        " and exists(vec, x -> x <> 0)")
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (size["n"] if size else 0))


def nodes_of(rows: DataFrame, members: int) -> DataFrame:
    """node (smallest vec_id), vec, members (the smallest vec_ids) and bytes (the unit vector, rounded) per vector."""
    key = [F.xxhash64("vec").alias("one"), F.xxhash64(F.lit("two"), "vec").alias("two")]
    order = Window.partitionBy("one", "two").orderBy("vec_id")
    # Repeated rows go first, so that they don't take the places of other ids.
    distinct = rows.select("vec_id", "vec", *key).dropDuplicates(["one", "two", "vec_id"])
    keyed = distinct.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= members)
    per = keyed.groupBy("one", "two").agg(F.min("vec_id").alias("node"), F.first("vec").alias("vec"),
                                          F.slice(F.array_sort(F.collect_set("vec_id")), 1, members).alias("members"))

    def rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _matrix(batch.column(1).values.to_numpy(), batch.num_rows)
            vecs = vecs / np.abs(vecs).max(axis=1, keepdims=True)
            out = np.rint(vecs * 127).astype(np.int8)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in out], pa.binary())],
                                             names=["node", "vec", "members", "bytes"])

    return per.select("node", "vec", "members").mapInArrow(
        rounded, "node long, vec array<double>, members array<long>, bytes binary")


def _matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 1)


def record(size: int) -> np.dtype:
    """What one node knows of another: its id, their likeness, what it takes to enter its list, and its vector."""
    return np.dtype([("id", "<i8"), ("near", "<f4"), ("least", "<f4"), ("kind", "i1"), ("vec", "i1", (size,))])


def _units(vecs: np.ndarray) -> np.ndarray:
    vecs = vecs.astype(np.float32)
    return vecs / np.linalg.norm(vecs, axis=-1, keepdims=True)


def _unpack(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The records of all rows of (node, data), and the node of each."""
    data = batch.column(1).to_pylist()
    counts = [len(d) // kind.itemsize for d in data]
    return np.repeat(batch.column(0).to_numpy(), counts), np.frombuffer(b"".join(data), kind)


def _packed(owner: np.ndarray, recs: np.ndarray, sender: np.ndarray | None = None) -> tuple[pa.Array, pa.Array]:
    """(node, data): records that lie together by owner (and sender), a row for each."""
    new = np.diff(owner, prepend=owner[:1] - 1) != 0
    if sender is not None:
        new |= np.diff(sender, prepend=sender[:1]) != 0
    cuts = np.flatnonzero(new)
    ends = np.concatenate([cuts, [len(owner)]]).astype(np.int32) * recs.dtype.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                          pa.py_buffer(recs.tobytes())])
    return pa.array(owner[cuts], pa.int64()), data


def _rank(owner: np.ndarray) -> np.ndarray:
    """The number of each row among the rows of its owner, which lie together."""
    at = np.arange(len(owner))
    first = np.diff(owner, prepend=owner[:1] - 1) != 0
    return at - np.maximum.accumulate(np.where(first, at, 0))


def _once(owner: np.ndarray, recs: np.ndarray) -> np.ndarray:
    """Places of the records that stay when each owner keeps one of every id: that of the least kind."""
    order = np.lexsort((recs["kind"], recs["id"], owner))
    o, i = owner[order], recs["id"][order]
    return order[(np.diff(o, prepend=o[:1] - 1) != 0) | (np.diff(i, prepend=i[:1] - 1) != 0)]


def _nearest(owner: np.ndarray, recs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by owner and likeness, and whether each is among the `most` nearest of its owner."""
    order = np.lexsort((recs["id"], -recs["near"], owner))
    return order, _rank(owner[order]) < most


def _drawn(owner: np.ndarray, recs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of `places`, REVERSE of each owner's nodes that list it: by a hash of both ids, whatever the order they come in."""
    at = places[(recs["kind"][places] == BACKED) | (recs["kind"][places] == BACK)]
    mixed = (recs["id"][at].astype(np.uint64) ^ (owner[at].astype(np.uint64) << np.uint64(17))) * np.uint64(MIXER)
    order = np.lexsort((recs["id"][at], mixed >> np.uint64(20), owner[at]))
    return at[order[_rank(owner[at][order]) < REVERSE]]


def _known(owner: np.ndarray, recs: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of each owner's list, of the nodes kept that list it, and of itself; each lies by owner."""
    once = np.sort(_once(owner, recs))
    own = once[recs["kind"][once] == SELF]
    others = once[recs["kind"][once] != SELF]
    others = others[recs["id"][others] != owner[others]]
    order, good = _nearest(owner[others], recs[others], degree)
    listed, rest = others[order[good]], others[order[~good]]
    return listed, _drawn(owner, recs, rest), own


def _offers(recs: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Who is told of whom, and in which group: within each group start..stop of records, pairs of which one is new."""
    to, told, group = [np.empty(0, np.int64)], [recs[:0]], [np.empty(0, np.int64)]
    for a in range(0, len(start), AT_ONCE):
        first, size = start[a:a + AT_ONCE], (stop - start)[a:a + AT_ONCE]
        wide = np.arange(max(2, size.max()))
        there = wide < size[:, None]
        at = np.where(there, first[:, None] + wide, 0)
        vecs = _units(recs["vec"][at])
        near = vecs @ vecs.transpose(0, 2, 1)
        new = (recs["kind"][at] >= BACK) & there
        bad = ~(there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]))
        bad |= near <= recs["least"][at][:, :, None]
        near[bad] = -3
        near[:, wide, wide] = -3
        few = min(OFFERS, len(wide) - 1)
        best = np.argpartition(-near, few - 1, axis=2)[:, :, :few]
        value = np.take_along_axis(near, best, axis=2)
        g, i, j = np.nonzero(value > -3)
        out = recs[at[g, best[g, i, j]]]
        out["near"], out["kind"] = value[g, i, j], OFFER
        to.append(recs["id"][at[g, i]])
        told.append(out)
        group.append(a + g)
    return np.concatenate(to), np.concatenate(told), np.concatenate(group)


def _messages(to: np.ndarray, recs: np.ndarray, sender: np.ndarray, degree: int) -> tuple[pa.Array, pa.Array]:
    """Messages, a row for each sender and receiver; who is told of by many is told each id once, and of the
    `degree` nearest and the REVERSE drawn."""
    once = _once(to, recs)
    to, recs, sender = to[once], recs[once], sender[once]
    order, good = _nearest(to, recs, degree)
    keep = np.union1d(order[good], _drawn(to, recs, order[~good]))
    keep = keep[np.lexsort((sender[keep], to[keep]))]
    return _packed(to[keep], recs[keep], sender[keep])


def first_messages(nodes: DataFrame, size: int, ranges: int, seed: int = 0) -> DataFrame:
    """Each node tells of itself; in each leaf of each random order the nearest are told of each other."""
    kind = record(size)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = _units(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(-1, size))
            draw = np.random.default_rng(seed)
            for table in range(TABLES):
                signs = vecs @ draw.normal(size=(size, 60)) > 0
                code = signs @ (np.int64(1) << np.arange(59, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([table] * len(vecs), pa.int32()), pa.array(code), *batch.columns],
                                                 names=["table", "code", "node", "bytes"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, node = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            recs = np.zeros(len(node), kind)
            recs["id"], recs["least"], recs["kind"] = node, -2, OFFER
            recs["vec"] = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int8).reshape(-1, size)
            to, told = [np.empty(0, np.int64)], [recs[:0]]
            for t in np.unique(table):
                rows = np.flatnonzero(table == t)
                for at in np.array_split(rows, max(1, len(rows) // LEAF)):
                    vecs = _units(recs["vec"][at])
                    near = vecs @ vecs.T
                    np.fill_diagonal(near, -3)
                    few = min(LEAF_LINKS, len(at) - 1)
                    if few < 1:
                        continue
                    best = np.argpartition(-near, few - 1, axis=1)[:, :few]
                    out = recs[at[best]]
                    out["near"] = np.take_along_axis(near, best, axis=1)
                    to.append(np.repeat(node[at], few))
                    told.append(out.reshape(-1))
            to, told = np.concatenate(to), np.concatenate(told)
            yield pa.RecordBatch.from_arrays([*_messages(to, told, np.zeros(len(to), np.int64), TABLES * LEAF_LINKS)],
                                             names=["node", "data"])

    def selves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs = np.zeros(batch.num_rows, kind)
            recs["id"], recs["near"], recs["least"], recs["kind"] = batch.column(0).to_numpy(), 1, -2, SELF
            recs["vec"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int8).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*_packed(recs["id"], recs)], names=["node", "data"])

    spread = (nodes.select("node", "bytes").mapInArrow(coded, "table int, code long, node long, bytes binary")
              .repartitionByRange(ranges, "table", "code", "node").sortWithinPartitions("table", "code", "node"))
    told = spread.mapInArrow(leaves, "node long, data binary")
    return told.unionByName(nodes.select("node", "bytes").mapInArrow(selves, "node long, data binary"))


def step(rows: DataFrame, size: int, degree: int, parts: int) -> DataFrame:
    """One round: (node, data, fresh) of every node and its messages, which have no `fresh` (new ones in the list)."""
    kind = record(size)

    def emit(owner: np.ndarray, recs: np.ndarray) -> Iterator[pa.RecordBatch]:
        listed, backs, own = _known(owner, recs, degree)
        full = _rank(owner[listed]) == degree - 1
        least = np.full(len(own), -2, np.float32)
        least[np.searchsorted(owner[own], owner[listed][full])] = recs["near"][listed][full]
        place = np.concatenate([own, listed, backs])
        by = np.argsort(owner[place], kind="stable")
        place, part = place[by], np.repeat([SELF, LISTED, BACKED], [len(own), len(listed), len(backs)])[by]
        members = recs[place]  # of each node: itself, its list, those that list it
        member_of = owner[place]
        now = members.copy()
        now["kind"] = part
        now["least"][part == SELF] = least
        fresh = np.bincount(np.searchsorted(owner[own], member_of),
                            (part == LISTED) & (members["kind"] >= BACK), len(own)).astype(np.int64)
        node, data = _packed(member_of, now)
        yield pa.RecordBatch.from_arrays([node, data, pa.array(fresh)], names=["node", "data", "fresh"])
        start = np.flatnonzero(part == SELF)
        stop = np.append(start[1:], len(part))
        busy = np.add.reduceat(members["kind"] >= BACK, start) > 0 if len(start) else np.empty(0, bool)
        to, told, group = _offers(members, start[busy] + 1, stop[busy])
        # Those newly listed learn who lists them.
        new = np.flatnonzero((part == LISTED) & (members["kind"] >= BACK))
        back = now[part == SELF][np.searchsorted(owner[own], member_of[new])]
        back["near"], back["kind"] = members["near"][new], BACK
        node, data = _messages(np.concatenate([to, members["id"][new]]), np.concatenate([told, back]),
                               np.concatenate([owner[own][busy][group], member_of[new]]), degree)
        yield pa.RecordBatch.from_arrays([node, data, pa.nulls(len(node), pa.int64())], names=["node", "data", "fresh"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, recs = np.empty(0, np.int64), np.empty(0, kind)
        for batch in batches:
            more_owner, more = _unpack(batch, kind)
            owner, recs = np.concatenate([owner, more_owner]), np.concatenate([recs, more])
            # The last node's rows may go on in the next batch; of a node in the midst of many lists the best are held.
            stop = int(np.searchsorted(owner, owner[-1])) if len(owner) else 0
            if stop:
                yield from emit(owner[:stop], recs[:stop])
                owner, recs = owner[stop:], recs[stop:]
            if len(owner) > HELD:
                keep = np.concatenate(_known(owner, recs, degree))
                owner, recs = owner[keep], recs[keep]
        if len(owner):
            yield from emit(owner, recs)

    return (rows.repartition(parts, "node").sortWithinPartitions("node")
            .mapInArrow(run, "node long, data binary, fresh long"))


def descend(nodes: DataFrame, size: int, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph: (node, data), the records of the node itself, its list and some nodes that list it."""
    parts = pick_parts(nodes.sparkSession)
    count = nodes.count()
    # Ranges hold many leaves each, whatever the session's partitions, so that no leaf is cut short by its range.
    rows = first_messages(nodes, size, min(parts, 1 + TABLES * count // RANGE))
    for nth in range(rounds):
        before, rows = rows, settle(step(rows.select("node", "data"), size, degree, parts), "round")
        if nth:
            discard(before)
        if (rows.agg(F.sum("fresh")).first()[0] or 0) <= SETTLED * degree * count:
            break
    return rows.where("fresh is not null").select("node", "data")


def greedy(queries: DataFrame, graph: DataFrame, size: int, beam: int = BEAM) -> DataFrame:
    """(query, node): the best nodes found. queries: (query, start, bytes)."""
    parts = pick_parts(graph.sparkSession)
    kind = record(size)
    found = np.dtype([("id", "<i8"), ("near", "<f4"), ("kind", "i1")])
    schema = "query long, data binary, bytes binary, front array<long>, least float"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (query, data, bytes, least): the nodes of data that are near enough to enter the query's beam."""
        for batch in batches:
            nth, recs = _unpack(pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(1)],
                                                           names=["nth", "data"]), kind)
            asked = _units(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(-1, size))
            near = np.einsum("ij,ij->i", _units(recs["vec"]), asked[nth])
            good = near > batch.column(3).to_numpy()[nth]
            out = np.zeros(good.sum(), found)
            out["id"], out["near"], out["kind"] = recs["id"][good], near[good], OPEN
            owner = batch.column(0).to_numpy()[nth[good]]
            by = np.argsort(owner, kind="stable")
            owner, out = owner[by], out[by]
            keep = _once(owner, out)
            node, data = _packed(owner[keep], out[keep])
            none = len(node)
            yield pa.RecordBatch.from_arrays([node, data, pa.nulls(none, pa.binary())], names=["query", "data", "bytes"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's beam with what was found; the nodes in it that it hasn't gone on from are the front."""

        def emit(query: int, recs: np.ndarray, vec: bytes) -> tuple:
            owner = np.zeros(len(recs), np.int64)
            once = _once(owner, recs)
            order, good = _nearest(owner[once], recs[once], beam)
            best = recs[once][order[good]].copy()
            front = best["id"][best["kind"] == OPEN].tolist()
            best["kind"] = DONE
            return query, best.tobytes(), vec, front, float(best["near"][-1]) if len(best) == beam else -2.0

        last, recs, vec = None, np.empty(0, found), b""
        for batch in batches:
            out = []
            for query, data, own in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if query != last:
                    if last is not None:
                        out.append(emit(last, recs, vec))
                    last, recs, vec = query, np.empty(0, found), b""
                recs, vec = np.concatenate([recs, np.frombuffer(data, found)]), own or vec
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        if last is not None:
            out = zip(*[emit(last, recs, vec)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    names = ["query", "data", "bytes", "front", "least"]
    types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float32()]
    pool = queries.select("query", F.lit(b"").alias("data"), "bytes", F.array("start").alias("front"),
                          F.lit(-2.0).cast("float").alias("least"))
    first = True
    while True:
        # The start itself is among the records of its own node.
        front = pool.select("query", "bytes", "least", F.explode("front").alias("node"))
        scored = front.join(graph, "node").select("query", "data", "bytes", "least").mapInArrow(
            score, "query long, data binary, bytes binary")
        before, pool = pool, settle(pool.select("query", "data", "bytes").unionByName(scored).repartition(parts, "query")
                                    .sortWithinPartitions("query").mapInArrow(merge, schema), "beam")
        if not first:
            discard(before)
        first = False
        if pool.where(F.size("front") > 0).isEmpty():
            break

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, recs = _unpack(batch, found)
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(recs["id"])], names=["query", "node"])

    return pool.select("query", "data").mapInArrow(ids, "query long, node long")


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, asked: Column, k: int = 5, degree: int = DEGREE, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every vector for which `asked` (of vec_id) holds."""
    rows = usable(vectors)
    nodes = settle(nodes_of(rows, k + 1), "nodes")
    width = nodes.select(F.octet_length("bytes")).first()
    size = width[0] if width else 1
    graph = descend(nodes, size, degree)
    queries = rows.where(asked).select(F.col("vec_id").alias("query"), "vec").distinct()
    queries = settle(queries.join(nodes.select("vec", F.col("node").alias("start"), "bytes"), "vec"), "queries")
    found = greedy(queries, graph, size, beam)
    pairs = (found.join(queries.select("query", F.col("vec").alias("asked")), "query")
             .join(nodes.select("node", "vec", "members"), "node")
             .withColumn("score", _cosine("asked", "vec")).select("query", "score", F.explode("members").alias("vec_id"))
             .where("vec_id <> query"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", "vec_id", "score")
