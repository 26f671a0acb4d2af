"""Spreading activation of many asks at once over a staged edge table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import weights
from palimpsest.operators import staging

#: Rows of a counted side that are broadcast at most.
MOST_BROADCAST = 1 << 18
#: Edges whose own contribution is kept as evidence: fixed values of relationship types.
TYPED = ("CONTRADICTS", "SUPERSEDES", "CAUSES")
#: Buckets by node of the staged edges at least; a bucket has about so many edges.
BUCKETS, BUCKET_EDGES = 16, 1 << 20
#: Edges from which they are dealt by node in several passes, so that the disk holds a part of a shuffle at a time.
PASS_EDGES, PASSES = 1 << 23, 4
_STATE = "ask long, node long, score double, hops int, path string, strongest double, typed_edge string, typed_gain double, seed boolean, visited boolean, place int, spent int, ended string"
_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]]) for c in _STATE.split(", ")])


@dataclass(frozen=True)
class Budget:
    """What stops an ask's activation: rounds, expanded nodes, hops, and the scores and strengths that count at all."""

    rounds: int = 100
    visited: int = 500
    hops: int = 3
    least: float = 0.1
    strength: float = 0.1
    neighbours: int = 64
    decay: float = weights.ACTIVATION_DECAY


def edge_weight(type_: Column, strength: Column, confidence: Column) -> Column:
    """Type weight times strength, times confidence for inferred types (MATH-3)."""
    w = F.when(type_ == "SUPERSEDES", 1.0).when(type_ == "MENTIONS", 0.9).when(type_ == "CO_OCCURS", 0.8).when(type_ == "SIMILAR", 0.6).otherwise(0.5)
    return w * strength * F.when(type_.isin("SIMILAR", "RELATED_TO"), confidence).otherwise(F.lit(1.0))


def prepared(edges: DataFrame, superseded: DataFrame | None = None, budget: Budget = Budget()) -> DataFrame:
    """The edges that can carry activation as lists: node, others, types, weights, factors.

    edges: node, other, type, strength, confidence, both ways; they are read several times. superseded: node. Degrees count
    all edges. A node's list begins with its strongest edge, ties by other and type; types are places in the column's
    metadata, and what an edge passes on of a score is its weight times its factor, that of what the neighbour is. As an
    ask has expanded no more than budget.visited neighbours before, so many beyond budget.neighbours are all that can ever
    count; the rest of a hub is left where it is. The table lies in the shared folder, bucketed by node, so that rounds read it
    without a shuffle.
    """
    spark = edges.sparkSession
    n = edges.count()
    passes, buckets = PASSES if n > PASS_EDGES else 1, max(BUCKETS, n // BUCKET_EDGES)
    part = lambda df, key, i: df.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == i) if passes > 1 else df
    weighed: DataFrame | None = None
    made: list[str] = []
    for i in range(passes):
        near = part(edges.select("node", "other", "type", "strength", "confidence"), "other", i)
        near = near.withColumn("degree", F.count(F.lit(1)).over(Window.partitionBy("other"))).filter(F.col("strength") >= budget.strength)
        factor = F.lit(1.0)
        if superseded is not None:
            old = superseded.select(F.col("node").alias("other")).distinct().withColumn("old", F.lit(True))
            near, factor = near.join(part(old, "other", i), "other", "left"), F.when(F.col("old"), weights.SUPERSEDED_FACTOR).otherwise(F.lit(1.0))
        weight = edge_weight(F.col("type"), F.col("strength"), F.col("confidence")) * budget.decay
        one = near.select("node", "other", "type", "strength", weight.alias("weight"), (weights.hub_inhibition(F.col("degree")) * factor).alias("factor"))
        one = staging.stage(one, "weighed", made)
        weighed = one if weighed is None else weighed.unionByName(one)
    kinds = [r[0] for r in weighed.select("type").filter("type is not null").distinct().orderBy("type").collect()]
    code = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]).cast("array<string>"), F.col("type")) - 1, F.lit(-1)).cast("short")
    most = budget.neighbours + budget.visited
    path = staging.new_path(spark, "activation-edges")
    name = "activation_" + path.rpartition("-")[2]
    for i in range(passes):
        dealt = part(weighed, "node", i).select("node", "other", code.alias("type"), "strength", "weight", "factor").repartition(buckets, "node").sortWithinPartitions("node", F.desc("strength"), "other", "type")
        lists = dealt.select("node", "other", "type", "weight", "factor").mapInArrow(_lists(most), "node long, others array<long>, types array<short>, weights array<double>, factors array<double>")
        lists = lists.withColumn("types", F.col("types").alias("types", metadata={"kinds": kinds}))
        with staging.lean(spark):
            lists.write.mode("append").bucketBy(buckets, "node").option("path", path).saveAsTable(name)
    staging.drop(spark, made)
    table = spark.table(name)
    return table.withColumn("types", F.col("types").alias("types", metadata={"kinds": kinds}))


def _lists(most: int):
    """For mapInArrow over a node's edges in order: a row for each node with the first most of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def rows(t: pa.Table) -> pa.RecordBatch:
            node = t.column("node").to_numpy()
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
            keep = rank < most
            t = t.filter(pa.array(keep)) if not keep.all() else t
            ends = pa.array(np.append(0, np.cumsum(np.add.reduceat(keep.astype(np.int32), first))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)) for c in ("other", "type", "weight", "factor")]
            return pa.RecordBatch.from_arrays([pa.array(node[first]), *lists], names=["node", "others", "types", "weights", "factors"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            node = t.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1]))  # where the last node begins: it may go on in the next batch
            if last:
                yield rows(t.slice(0, last))
            held = t.slice(last, most)
        if held is not None:
            yield rows(held)

    return run


def spread(seeds: DataFrame, edges: DataFrame, budget: Budget = Budget(), typed: tuple[str, ...] = TYPED) -> tuple[DataFrame, DataFrame]:
    """Spreading activation of every ask: (ask, node, score, hops, path, typed_edge, typed_gain), and (ask, ended) (RET-10, RET-11).

    seeds: ask, node, score. edges: prepared() with the same budget.

    All asks go through the same rounds, each with a frontier and a budget of its own. A round expands an ask's nodes that
    were reached but not yet expanded, whose score is at least least and whose hops are fewer than hops, best first, no
    more than visited in all. A node passes score x share on along its strongest edges to nodes that no earlier round of
    the ask has expanded; contributions add up. Within a round an ask's nodes count as expanded one after another: an
    edge between two of them fires once, from the better to the worse, before the worse one passes on its score. The lists of
    an ask's nodes of a round, which the budget bounds, meet with what the ask has reached so far in one group, the only rows
    that a round shuffles; of an ask that ends there only what has activation leaves it.
    A node's hops and path are those of the strongest single contribution; a seed's stay. Evidence is the strongest
    contribution by an edge of a typed kind. An ask ends with frontier_exhausted, below_min_activation, hop_limit,
    node_budget or max_iterations. Repeated seeds count by their best score; null asks and nodes are left out.
    """
    first = seeds.filter("ask is not null and node is not null").groupBy(F.col("ask").cast("long").alias("ask"), F.col("node").cast("long").alias("node")).agg(F.max("score").cast("double").alias("score"))
    kinds = list(edges.schema["types"].metadata["kinds"])
    state = staging.stage(first.groupBy("ask").applyInArrow(lambda t: _begun(t, budget), _STATE), "active")
    done: list[DataFrame] = []
    rounds = 0
    while True:
        done.append(state.filter("ended is not null"))
        tally = state.agg(F.count_if(F.col("ended").isNull()).alias("live"), F.count("place").alias("front")).first()
        if not tally["live"]:
            break
        rounds += 1
        live = state.filter("ended is null")
        front = live.filter("place is not null").select(F.col("ask").alias("of"), F.col("node").alias("source"), F.col("place").alias("at"), "spent")
        front = F.broadcast(front) if tally["front"] <= MOST_BROADCAST else front.hint("shuffle_hash")
        cut = lambda c: F.slice(c, F.lit(1), F.col("spent") + budget.neighbours).alias(c)
        near = edges.join(front, F.col("node") == F.col("source")).select(F.col("of").alias("ask"), F.col("at").alias("place"), cut("others"), cut("types"), cut("weights"), cut("factors"))
        fire = _firing(budget, typed, kinds, rounds)
        state = staging.stage(live.groupBy("ask").cogroup(near.groupBy("ask")).applyInArrow(fire, _STATE), "active")
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    return ended.filter("node is not null").select("ask", "node", "score", "hops", "path", "typed_edge", "typed_gain"), ended.filter("node is null").select("ask", "ended")


def _begun(t: pa.Table, budget: Budget) -> pa.Table:
    node, n = t.column("node").to_numpy(), t.num_rows
    zero, none = np.zeros(n), [None] * n
    return _settled(t.column("ask")[0].as_py(), node, t.column("score").to_numpy(), np.zeros(n, np.int64), lambda i: str(node[i]), zero, none, np.full(n, np.nan), np.ones(n, bool), np.zeros(n, bool), budget, 0)


def _settled(ask: int, node, score, hops, path, strongest, typed_edge, typed_gain, seed, visited, budget: Budget, rounds: int) -> pa.Table:
    """An ask's rows after a round: the places of those that the next one expands, or why it has ended and what is active.

    path(i) gives the path of row i.
    """
    spent = int(visited.sum())
    strong = ~visited & (score >= budget.least)
    ready = np.flatnonzero(strong & (hops < budget.hops))
    why = "max_iterations" if rounds >= budget.rounds else "node_budget" if spent >= budget.visited else None
    if not why and not len(ready):
        why = "frontier_exhausted" if visited.all() else "below_min_activation" if not strong.any() else "hop_limit"
    keep, place = np.flatnonzero(score >= budget.least) if why else np.arange(len(node)), np.zeros(len(node), np.int32)
    if not why:
        ready = ready[np.lexsort((node[ready], -score[ready]))][: budget.visited - spent]
        place[ready] = np.arange(1, len(ready) + 1)
    at = keep.tolist()
    columns = [pa.array(np.full(len(at), ask)), pa.array(node[keep]), pa.array(score[keep]), pa.array(hops[keep].astype(np.int32)), pa.array([path(i) for i in at], pa.string()), pa.array(strongest[keep])]
    columns += [pa.array([typed_edge[i] for i in at], pa.string()), pa.array(typed_gain[keep], mask=np.isnan(typed_gain[keep])), pa.array(seed[keep]), pa.array(visited[keep]), pa.array(place[keep], mask=place[keep] == 0)]
    columns += [pa.array(np.full(len(at), spent, np.int32)), pa.array([why] * len(at), pa.string())]
    out = pa.Table.from_arrays(columns, schema=_ARROW)
    return pa.concat_tables([out, pa.Table.from_pylist([{"ask": ask, "ended": why}], schema=_ARROW)]) if why else out


def _firing(budget: Budget, typed: tuple[str, ...], kinds: list[str], rounds: int):
    """For applyInArrow over an ask's rows and the lists of its frontier: the rows after the round."""
    evidence = np.array([k in typed for k in kinds] + [False])  # the last is that of null

    def fire(state: pa.Table, lists: pa.Table) -> pa.Table:
        number = lambda c: state.column(c).to_numpy()
        node, score, hops, strongest = number("node"), number("score").copy(), number("hops").astype(np.int64), number("strongest").copy()
        path, typed_edge, typed_gain = state.column("path").to_pylist(), state.column("typed_edge").to_pylist(), state.column("typed_gain").fill_null(np.nan).to_numpy().copy()
        seed, visited, places = number("seed").copy(), number("visited").copy(), state.column("place").fill_null(0).to_numpy()
        front = np.flatnonzero(places)
        front = front[np.argsort(places[front])]  # by place
        lists = lists.take(np.argsort(lists.column("place").to_numpy(), kind="stable"))
        column = lambda c: (pa.concat_arrays(lists.column(c).chunks) if lists.column(c).num_chunks != 1 else lists.column(c).chunk(0)) if lists.num_rows else None
        if lists.num_rows:
            other, kind = column("others").flatten().to_numpy(), column("types").flatten().to_numpy().astype(np.int64)
            share = column("weights").flatten().to_numpy() * column("factors").flatten().to_numpy()
            place = np.repeat(lists.column("place").to_numpy().astype(np.int64), column("others").value_lengths().to_numpy())
        else:
            other, kind, share, place = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        keep = ~np.isin(other, node[visited])
        other, kind, share, place = other[keep], kind[keep], share[keep], place[keep]
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
        rank = np.arange(len(place)) - np.repeat(new, np.diff(np.append(new, len(place))))
        keep = rank < budget.neighbours
        other, kind, share, place, rank = other[keep], kind[keep], share[keep], place[keep], rank[keep]
        order = np.argsort(node[front])
        at = np.minimum(np.searchsorted(node[front][order], other), len(front) - 1)
        inside = node[front][order][at] == other if len(other) else np.zeros(0, bool)
        other_place = np.where(inside, order[at] + 1, 0) if len(other) else place
        # edges between nodes of the round, one after another
        for e in np.flatnonzero(other_place > place):
            a, b = front[place[e] - 1], front[other_place[e] - 1]
            gain = score[a] * share[e]
            if not gain > 0:
                continue
            score[b] += gain
            k = kind[e]
            if evidence[k] and gain > (0.0 if np.isnan(typed_gain[b]) else typed_gain[b]):
                typed_edge[b], typed_gain[b] = kinds[k], gain
            if not seed[b] and gain > strongest[b]:
                strongest[b], hops[b] = gain, hops[a] + 1
                path[b] = f"{path[a]} -[{kinds[k]}]-> {node[b]}" if k >= 0 and path[a] is not None else None
        visited[front] = True
        # to all others, by the final scores of the round's nodes
        out = np.flatnonzero(other_place == 0)
        gain = share[out] * score[front[place[out] - 1]] if len(out) else np.zeros(0)
        out, gain = out[gain > 0], gain[gain > 0]
        source = front[place[out] - 1] if len(out) else out
        # of equal contributions the first counts: that of the better source, then of its stronger edge
        order = np.lexsort((rank[out], place[out], -gain, other[out]))
        out, gain, source = out[order], gain[order], source[order]
        first = np.flatnonzero(np.append(True, other[out][1:] != other[out][:-1])) if len(out) else out
        reached, total = other[out][first], np.add.reduceat(gain, first) if len(out) else gain
        proof = np.flatnonzero(evidence[kind[out]])
        proof = proof[np.unique(other[out][proof], return_index=True)[1]]
        # rows that were there, then new ones
        was = np.argsort(node)
        at = was[np.minimum(np.searchsorted(node[was], reached), len(node) - 1)] if len(reached) else reached
        there = node[at] == reached if len(reached) else np.zeros(0, bool)
        more, n = np.flatnonzero(~there), len(node)
        to = np.where(there, at, 0)
        to[more] = n + np.arange(len(more))
        grow = lambda x, value: np.concatenate([x, np.full(len(more), value, x.dtype)])
        node, score, hops, strongest, typed_gain = np.concatenate([node, reached[more]]), grow(score, 0.0), grow(hops, 0), grow(strongest, 0.0), grow(typed_gain, np.nan)
        seed, visited, typed_edge = grow(seed, False), grow(visited, False), typed_edge + [None] * len(more)
        score[to] += total
        top = gain[first] if len(out) else gain
        better = ~seed[to] & (top > strongest[to])
        way = dict(zip(to[better].tolist(), zip(source[first][better].tolist(), kind[out][first][better].tolist(), strict=True), strict=True)) if len(out) else {}
        if len(out):
            hops[to[better]] = hops[source[first][better]] + 1
            strongest[to[better]] = top[better]
            where = to[np.searchsorted(reached, other[out][proof])]
            for i, p in zip(where.tolist(), proof.tolist(), strict=True):
                if gain[p] > (0.0 if np.isnan(typed_gain[i]) else typed_gain[i]):
                    typed_edge[i], typed_gain[i] = kinds[kind[out][p]], gain[p]

        def path_of(i: int) -> str | None:
            if i not in way:
                return path[i]
            a, k = way[i]
            return f"{path[a]} -[{kinds[k]}]-> {node[i]}" if k >= 0 and path[a] is not None else None

        return _settled(state.column("ask")[0].as_py(), node, score, hops, path_of, strongest, typed_edge, typed_gain, seed, visited, budget, rounds)

    return fire
