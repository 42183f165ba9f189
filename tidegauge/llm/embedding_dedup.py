"""Near-duplicate vectors by an inverted multi-index.

The halves of all (normalised) vectors get a codebook each; the product of both codebooks is
a grid of cells, and every vector lies in one. For centroid ``i`` against the query's own ``a`` a
neighbour is at least ``(d(q, i)**2 - d(q, a)**2) / (2 * |c_i - c_a|)`` away; a query reaches the
cells at which both halves' distances together stay within the search radius, ``reach`` of its
square: at 1, the default, no neighbour can be missed. With ``recall`` under 1 the reach is fitted:
``queries`` vectors, by hash order, meet all vectors, and the reach is taken that holds every pair
of ``recall`` of those that have any, and a half more; each counts once, whatever its group.
Members met are verified by cosine in double precision.

Equal vectors collapse first. The cells of a label, in grid order, are cut into groups of about
``block`` vectors, and a vector visits a group once, however many of its cells it reaches; so at
full reach it is sent to half of its label's groups at most. The members of a group are held while
its visitors stream by, and a group sends counts and a spanning forest of the links it finds, not
the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tidegauge.llm.components import components
from tidegauge.llm.text import map_batches
from tidegauge.llm.vectors import summed
from tidegauge.session import materialise, ship_package


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """``k`` centroids of the rows of ``x`` by k-means from evenly spaced rows; deterministic."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = (((c * c).sum(1)) - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def half_bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row, and how far a point of each centroid's region is at least."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
    own = d.argmin(1)
    apart = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1) - 2 * c @ c.T, 1e-12))
    bound = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart[own])
    bound[np.arange(len(x)), own] = 0
    return own, np.maximum(bound, 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _compare(least: float) -> object:
    """Stream ``(key, visitor, node, copies, embedding)`` sorted by key, members before visitors."""

    def forest(links: np.ndarray) -> np.ndarray:
        label = np.arange(len(links))
        while True:
            lower = np.minimum(label, np.where(links, label[None, :], len(label)).min(1))
            lower = lower[lower]
            if (lower == label).all():
                return label
            label = lower

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block, out = None, [], None, []

        def emit(u, v, n):
            out.append((np.asarray(u, dtype=np.int64), np.asarray(v, dtype=np.int64), np.asarray(n, dtype=np.int64)))

        def close():
            nonlocal block, parts
            if not parts:
                return
            nodes, copies, x = (np.concatenate([p[k] for p in parts]) for k in range(3))
            links = x @ x.T >= least
            np.fill_diagonal(links, False)
            label = forest(links)
            emit(nodes, nodes[label], links @ copies)
            block, parts = (nodes, copies, x, label), []

        for batch in batches:
            keys = batch.column("key").to_pylist()
            visitor, node, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("visitor", "node", "copies"))
            edges = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or visitor[i] != visitor[i - 1]] + [len(keys)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if keys[a] != key:
                    close()
                    key, block = keys[a], None
                vectors = batch.column("embedding").slice(a, b - a)
                x = _matrix(vectors, len(vectors[0]))
                if not visitor[a]:
                    parts.append((node[a:b], copies[a:b], x))
                    continue
                close()
                if block is None:
                    continue
                for lo in range(0, b - a, 512):
                    part = slice(a + lo, min(a + lo + 512, b))
                    links = x[lo : lo + 512] @ block[2].T >= least
                    links &= node[part][:, None] != block[0][None, :]
                    emit(node[part], node[part], links @ block[1])
                    emit(block[0], block[0], copies[part] @ links)
                    v, m = np.nonzero(links)
                    pairs = np.unique(np.stack([v, block[3][m]]), axis=1) if len(v) else np.zeros((2, 0), dtype=int)
                    emit(node[part][pairs[0]], block[0][pairs[1]], np.zeros(pairs.shape[1]))
            if out:
                u, v, n = (np.concatenate([o[k] for o in out]) for k in range(3))
                useful = (u != v) | (n > 0)
                yield pa.RecordBatch.from_pydict({"u": u[useful], "v": v[useful], "n": n[useful]})
                out.clear()
        close()
        if out:
            u, v, n = (np.concatenate([o[k] for o in out]) for k in range(3))
            yield pa.RecordBatch.from_pydict({"u": u, "v": v, "n": n})

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, sample: int = 4096, per_cell: int = 64, block: int = 2048, queries: int = 1024, recall: float = 1.0) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Two vectors link when their labels, of any type, are equal and not null, their lengths are
    equal and their cosine, in double precision whatever the components are, is ``least`` or more. Vectors that are null, empty, zero, or hold a null or a
    non-finite component, and rows with a null id, link with nothing. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest id reachable and ``kept``
    tells whether it is the row's own. Codebooks come from at most ``sample`` vectors, taken
    by hash order; every vector is indexed. An empty table gives an empty result.
    """
    held = vectors.schema["embedding"].dataType.elementType
    # floats stay as they are; whatever else is compared as doubles
    embedding = F.col("embedding") if isinstance(held, (FloatType, DoubleType)) else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", embedding.alias("embedding"), "label")
    spark = rows.sparkSession
    sound = F.coalesce(
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    hashed = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(7), "label", "embedding").alias("h2")]
    ids = materialise(rows.select("vec_id", sound.alias("sound"), *hashed))
    distinct = (
        rows.where(sound)
        .select("vec_id", "embedding", "label", *hashed)
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    )
    nodes = materialise(distinct)
    dims = [r.d for r in nodes.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]
    results = []
    for dim in dims:
        own = nodes.where(F.size("embedding") == dim)
        results.append(_links(own, dim, least, sample, per_cell, block, queries, recall))
    found = materialise(_union(results)) if results else spark.createDataFrame([], "u long, v long, n long")
    labels = components(found.select("u", "v"))
    linked = found.groupBy("u").agg(F.sum("n").alias("n"))
    members = nodes.join(linked, nodes.node == linked.u, "left").join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    members = members.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    placed = ids.where("sound").join(members, ["h1", "h2"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    rest = ids.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionAll(rest).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _fitted_reach(nodes: DataFrame, asked, books, cut: int, least: float, recall: float, bins: int = 200) -> float:
    """Share of the squared radius that holds all pairs of ``recall`` of the queries that have any."""
    q, labels, names = asked
    width = len(books[1])
    q1, qb1 = half_bounds(q[:, :cut], books[0])
    q2, qb2 = half_bounds(q[:, cut:], books[1])

    def fold(batches) -> np.ndarray:
        out = np.zeros((len(q), bins + 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("embedding"), q.shape[1])
            own, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "node"))
            hit = (v @ q.T >= least) & (own[:, None] == labels[None, :]) & (node[:, None] != names[None, :])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            v1, b1 = half_bounds(v[:, :cut], books[0])
            v2, b2 = half_bounds(v[:, cut:], books[1])
            # the vector of the lower cell visits the other's
            forward = v1[i] * width + v2[i] >= q1[j] * width + q2[j]
            need = np.where(forward, qb1[j, v1[i]] ** 2 + qb2[j, v2[i]] ** 2, b1[i, q1[j]] ** 2 + b2[i, q2[j]] ** 2)
            np.add.at(out, (j, np.minimum(np.ceil(need / (2 * (1 - least)) * bins), bins).astype(int)), 1)
        return out.ravel()

    length = len(q) * (bins + 1)
    found = summed(nodes.select("node", "label", "embedding"), fold, length).reshape(len(q), -1)
    linked = found[found.any(axis=1)] > 0
    if not len(linked):
        return 1.0
    largest = bins - linked[:, ::-1].argmax(axis=1)
    return min(1.0, 1.5 * np.quantile(largest, recall, method="higher") / bins + 0.02)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionAll(frame)
    return out


def _links(nodes: DataFrame, dim: int, least: float, sample: int, per_cell: int, block: int, queries: int, recall: float) -> DataFrame:
    spark = nodes.sparkSession
    total = nodes.count()
    rows = nodes.select("h1", "node", "label", "embedding").orderBy("h1", "node").limit(sample).collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    k = int(min(256, max(1, math.isqrt(max(1, total // per_cell)))))
    cut = max(1, dim // 2)
    books = (codebook(x[:, :cut], k), codebook(x[:, cut:], k) if dim > 1 else np.zeros((1, 0)))
    width = len(books[1])
    reach = 1.0
    if recall < 1:
        asked = (x[:queries], np.array([r.label for r in rows[:queries]]), np.array([r.node for r in rows[:queries]]))
        reach = _fitted_reach(nodes, asked, books, cut, least, recall)
    radius2 = reach * 2 * (1 - least) + 1e-9
    given = nodes.select("node", "copies", "embedding", "label")
    kind, label = (given.schema[c].dataType.simpleString() for c in ("embedding", "label"))
    # labels of one group are not listed; the others are a ``block``-th of the rows at most
    sizes = given.groupBy("label").count().where(F.col("count") > block).collect()
    parts = {r.label: -(-r["count"] // block) for r in sizes}

    def homes_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own1, bound1 = half_bounds(v[:, :cut], books[0])
        own2, bound2 = half_bounds(v[:, cut:], books[1])
        return own1 * width + own2, bound1**2, bound2**2

    def tally(batches) -> np.ndarray:
        out = np.zeros(len(books[0]) * width)
        for batch in batches:
            if batch.num_rows:
                out += np.bincount(homes_of(_matrix(batch.column("embedding"), dim))[0], minlength=len(out))
        return out

    # share of all vectors in the cells before each: a label's groups are equal parts of it
    cells = summed(given.select("embedding"), tally, len(books[0]) * width) if parts else np.zeros(len(books[0]) * width)
    before = (np.cumsum(cells) - cells) / max(cells.sum(), 1)

    def place(batch: pa.RecordBatch):
        home, far1, far2 = homes_of(_matrix(batch.column("embedding"), dim))
        groups = {label: np.minimum((before * n).astype(np.int64), n - 1) for label, n in parts.items()} if batch.num_rows else {}
        at, group, visitor = [], [], []
        for i, label in enumerate(batch.column("label").to_pylist()):
            of = groups.get(label)
            own = 0 if of is None else of[home[i]]
            met = []
            if of is not None:
                later = np.searchsorted(of, own, side="right")  # the other direction finds the rest
                met = np.unique(of[later:][(far1[i][:, None] + far2[i][None, :] <= radius2).ravel()[later:]]).tolist()
            at += [i] * (1 + len(met))
            group += [own, *met]
            visitor += [False] + [True] * len(met)
        at = pa.array(at, pa.int64())
        columns = {c: batch.column(c).take(at) for c in ("node", "copies", "embedding", "label")}
        yield columns | {"cells": np.array(group, dtype=np.int64), "visitor": pa.array(visitor, pa.bool_())}

    placed = map_batches(given, place, f"node long, copies long, embedding {kind}, label {label}, cells long, visitor boolean")
    placed = materialise(placed)
    blocks = placed.where("not visitor").groupBy("label", "cells").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    cut_up = placed.join(blocks, ["label", "cells"])
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    homes = cut_up.where("not visitor").withColumn("block", own)
    # members visit the later blocks of their own group
    inner = cut_up.where("not visitor and blocks > 1").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).where(F.col("block") > own).withColumn("visitor", F.lit(True))
    outer = cut_up.where("visitor").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    keyed = homes.unionAll(inner).unionAll(outer).select(F.concat_ws(":", "cells", "block", "label").alias("key"), "visitor", "node", "copies", "embedding")
    ship_package(spark)
    ordered = keyed.repartition("key").sortWithinPartitions("key", "visitor")
    return ordered.mapInArrow(_compare(least), "u long, v long, n long")
