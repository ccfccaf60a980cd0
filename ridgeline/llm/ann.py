"""Approximate nearest neighbours on robust-pruned directed graphs, one graph a shard.

Equal vectors are one node, which keeps the smallest ids that an answer can
need.  Nodes are dealt to cells around coarse centres fitted on a bounded
sample, cells too large for a shard are cut by a hash, and each shard builds a
graph: a greedy search for every vector proposes neighbours among what it
visited, and relaxed distance pruning keeps a few diverse ones.  The graphs are
written to the shared folder.  A query is searched with a beam in each shard of
the cells it may have neighbours in; how many cells that takes is measured on
the sample, and is all of them where cells don't part the vectors.  Shards hold
up to ``SHARD_ROWS`` vectors and blocks up to ``QUERY_BLOCK`` queries, so graphs
and queries are copied to few tasks.  Each shard's best are ranked by exact cosine
in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, partitions

SHARD_ROWS = 65_536  # most vectors of a shard: some 60 MB
LEAST_SHARD_ROWS = 4_096  # smaller shards only cost searches
QUERY_BLOCK = 65_536
CELLS = 1_024  # most centres
SAMPLE = 16_384  # vectors, about, that centres and probes are fitted on
PROBED = 0.99  # share of the sample's neighbours that the probed cells hold
DEGREE = 28
BUILD_BEAM = 48
SEARCH_BEAM = 96
WIDE = 4  # nodes expanded in a step
SEEN_CELLS = 1 << 24  # of the table of nodes seen, for the queries searched at once
ALPHA = 1.2


class Graph:
    """A directed graph over unit vectors; searches and pruning run for many nodes at once."""

    def __init__(self, x: np.ndarray, links: np.ndarray | None = None, start: int | None = None) -> None:
        self.x = x
        self.n = len(x)
        self.start = int((x @ x.mean(0)).argmax()) if start is None else start
        self.links = np.full((self.n, DEGREE), -1, np.int32) if links is None else links

    def batch(self, most: int) -> int:
        return max(1, min(most, SEEN_CELLS // self.n))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy beam search: the beam's nodes (-1: none), their similarities, and all nodes expanded."""
        m, n = len(q), self.n
        rows = np.arange(m)[:, None]
        ids = np.full((m, beam), -1, np.int64)
        sim = np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n), bool)
        ids[:, 0], sim[:, 0], open_[:, 0] = self.start, q @ self.x[self.start], True
        seen[:, self.start] = True
        expanded: list[np.ndarray] = []
        wide = min(WIDE, beam)
        while open_.any():
            best = np.argpartition(np.where(open_, -sim, np.inf), wide - 1, axis=1)[:, :wide]
            at = np.where(open_[rows, best], ids[rows, best], -1)
            open_[rows, best] = False
            expanded.append(at)
            found = []
            for k in range(wide):
                near = np.where(at[:, k : k + 1] >= 0, self.links[at[:, k]], -1)
                new = (near >= 0) & ~seen[rows, near]
                seen[np.broadcast_to(rows, near.shape)[new], near[new]] = True
                found.append(np.where(new, near, -1))
            near = np.concatenate(found, 1)
            r, c = np.nonzero(near >= 0)
            s = np.full(near.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("ed,ed->e", q[r], self.x[near[r, c]])
            all_sim = np.concatenate([sim, s], 1)
            keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            ids = np.take_along_axis(np.concatenate([ids, near], 1), keep, 1)
            sim = np.take_along_axis(all_sim, keep, 1)
            open_ = np.take_along_axis(np.concatenate([open_, near >= 0], 1), keep, 1)
        return ids, sim, np.concatenate(expanded, 1)

    def prune(self, p: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Neighbours (-1: none) of each node of ``p`` out of its row of candidates (-1: none).

        Nearest first, and each kept neighbour strikes out what is ``alpha`` times nearer to it than to the node.
        """
        c = np.sort(candidates, 1)
        live = (c >= 0) & (c != p[:, None])
        live[:, 1:] &= c[:, 1:] != c[:, :-1]
        to_p = np.where(live, np.maximum(0, 2 - 2 * np.einsum("md,mkd->mk", self.x[p], self.x[c])), np.inf)  # squared distances
        order = np.argsort(to_p, 1, kind="stable")[:, : 4 * DEGREE]
        c, to_p, live = (np.take_along_axis(a, order, 1) for a in (c, to_p, live))
        v = self.x[c]
        struck = np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))) * np.float32(alpha * alpha) <= to_p[:, None, :]
        out = np.full((len(p), DEGREE), -1, np.int32)
        count = np.zeros(len(p), np.int64)
        for k in range(c.shape[1]):
            take = np.flatnonzero(live[:, k] & (count < DEGREE))
            if len(take):
                out[take, count[take]] = c[take, k]
                count[take] += 1
                live[take] &= ~struck[take, k]
        return out

    def build(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        n = self.n
        if n > 1:
            d = min(DEGREE, n - 1)
            random = r.integers(0, n - 1, (n, d))
            self.links[:, :d] = random + (random >= np.arange(n)[:, None])  # any node but the own one
        batch = self.batch(256)
        for alpha in (1.0, ALPHA):
            order = r.permutation(n)
            for at in range(0, n, batch):
                part = order[at : at + batch]
                ids, _, expanded = self.search(self.x[part], BUILD_BEAM)
                self.links[part] = self.prune(part, np.concatenate([expanded, ids, self.links[part]], 1), alpha)
                self._back(part, alpha)

    def _back(self, part: np.ndarray, alpha: float) -> None:
        """Links back from the new neighbours of ``part``; where a node has too many, its candidates are pruned again."""
        to = self.links[part].ravel()
        by = np.repeat(part, DEGREE)[to >= 0]
        to = to[to >= 0]
        known = (self.links[to] == by[:, None]).any(1)
        to, by = to[~known], by[~known]
        order = np.argsort(to, kind="stable")
        to, by = to[order], by[order]
        nodes, first, times = np.unique(to, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 256):
            own = np.argsort(times, kind="stable")[at : at + 256]  # rows of like width together
            t, wide = nodes[own], int(times[own].max())
            new = np.full((len(t), wide), -1, np.int64)
            cell = np.arange(wide) < times[own][:, None]
            new[cell] = by[(first[own][:, None] + np.arange(wide))[cell]]
            both = np.concatenate([self.links[t], new], 1)
            fits = (both >= 0).sum(1) <= DEGREE
            packed = np.take_along_axis(both, np.argsort(both < 0, 1, kind="stable"), 1)[:, :DEGREE]
            self.links[t[fits]] = packed[fits]
            if not fits.all():
                self.links[t[~fits]] = self.prune(t[~fits], both[~fits], alpha)


def _usable(v: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~wrong & F.exists(v, lambda x: x != 0)


def _matrix(s) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in s]) if len(s) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# ---- cells ----


class Cells:
    """Centres for each length of vectors, and how many of the nearest ones a query probes."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[np.ndarray, int]] = {}

    def fit(self, x: np.ndarray, cells: int, k: int, seed: int = 0) -> None:
        """Spherical k-means; the probes are what ``PROBED`` of the sample's neighbours take, which are
        farther apart than those of the whole table and so rather need more."""
        r = np.random.default_rng(seed)
        u = _unit(x).astype(np.float32)
        cells = min(cells, max(1, len(u) // 16))
        centres = u[r.choice(len(u), cells, replace=False)]
        for _ in range(8):
            own = self._nearest(u, centres, 1)[:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, own, u)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), centres).astype(np.float32)
        own = self._nearest(u, centres, 1)[:, 0]
        asked = r.choice(len(u), min(len(u), 500), replace=False)
        ranks = []
        for at in range(0, len(asked), 64):
            some = asked[at : at + 64]
            s = u[some] @ u.T
            s[np.arange(len(some)), some] = -2
            near = np.argpartition(-s, min(k, len(u) - 1) - 1, axis=1)[:, :k]
            rank = np.argsort(np.argsort(-(u[some] @ centres.T), 1, kind="stable"), 1)
            ranks.append(np.take_along_axis(rank, own[near], 1).ravel())
        probes = int(np.quantile(np.concatenate(ranks), PROBED, method="higher")) + 1
        self.of[x.shape[1]] = centres, cells if cells <= 4 else probes

    @staticmethod
    def _nearest(u: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
        out = np.empty((len(u), k), np.int32)
        for at in range(0, len(u), 4096):
            s = -(u[at : at + 4096] @ centres.T)
            part = np.argpartition(s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.broadcast_to(np.arange(k), s.shape)
            out[at : at + 4096] = part
        return out

    def probe(self, vectors: list, every: bool) -> list[list[int]]:
        """The cells of each vector: its own, or all that a query looks into."""
        out: list[list[int]] = [[0]] * len(vectors)
        dims = np.array([len(v) for v in vectors])
        for dim, (centres, probes) in self.of.items():
            own = np.flatnonzero(dims == dim)
            if len(own):
                u = _unit(_matrix([vectors[k] for k in own])).astype(np.float32)
                for k, cells in zip(own, self._nearest(u, centres, probes if every else 1).tolist(), strict=True):
                    out[k] = cells
        return out


def _placed(df: DataFrame, sent, every: bool) -> DataFrame:
    """``df`` (h1, h2, v, ...) with ``cells array<int>``."""
    fields = df.schema.fields

    def run(batches):
        for b in batches:
            cells = sent.value.probe(b.column("v").to_pylist(), every)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], [*[f.name for f in fields], "cells"])

    return df.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", cells array<int>")


# ---- shards ----


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h1", "h2", "vec_id"])
    new = np.concatenate([[True], (pdf["h1"].to_numpy()[1:] != pdf["h1"].to_numpy()[:-1]) | (pdf["h2"].to_numpy()[1:] != pdf["h2"].to_numpy()[:-1])])
    x = _matrix(pdf["v"][new])
    g = Graph(_unit(x).astype(np.float32))
    g.build(seed=int(pdf["cell"].iloc[0]))
    row = {
        **{k: pdf[k].iloc[0] for k in ("dim", "cell", "sub")}, "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "starts": np.append(np.flatnonzero(new), len(pdf)).astype(np.int64).tobytes(),
        "hashes": pdf[["h1", "h2"]][new].to_numpy(np.int64).tobytes(), "vectors": x.tobytes(), "links": g.links.tobytes(), "start": g.start,
    }
    return pd.DataFrame([row])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine in double precision of one vector with rows, each summed in the same order."""
    dot = (x * q).sum(1)
    return dot / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def _search(k: int, beam: int):
    """The ``k`` best rows of a shard for each query: score, id, and whether the vectors are the same."""
    names = ["h1", "h2", "score", "vec_id", "same"]

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(index) and len(queries):
            i = index.iloc[0]
            x = np.frombuffer(i["vectors"], np.float64).reshape(-1, int(i["dim"]))
            ids, starts = np.frombuffer(i["ids"], np.int64), np.frombuffer(i["starts"], np.int64)
            hashes = np.frombuffer(i["hashes"], np.int64).reshape(-1, 2)
            g = Graph(_unit(x).astype(np.float32), np.frombuffer(i["links"], np.int32).reshape(len(x), -1), int(i["start"]))
            h = queries[["h1", "h2"]].to_numpy(np.int64)
            step = g.batch(256)
            for at in range(0, len(h), step):
                q = _matrix(queries["v"].iloc[at : at + step])
                found, _, _ = g.search(_unit(q).astype(np.float32), min(beam, max(k, len(x))))
                for row, own in enumerate(found):
                    own = own[own >= 0]
                    s, me, got = exact(q[row], x[own]), h[at + row], []
                    for t in np.argsort(-s, kind="stable"):
                        if len(got) >= k and got[k - 1][0] > s[t]:
                            break
                        same = bool((hashes[own[t]] == me).all())
                        got += [(float(s[t]), int(v), same) for v in ids[starts[own[t]] : starts[own[t] + 1]]]
                        got.sort(key=lambda r: (-r[0], r[1]))
                    out += [(int(me[0]), int(me[1]), *c) for c in got[:k]]
        return pd.DataFrame(out, columns=names).astype({"h1": "int64", "h2": "int64", "score": "float64", "vec_id": "int64", "same": "bool"})

    return run


def _distinct(df: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each vector, the first by ``order``; a vector of very many rows is cut down before any exchange."""
    rank = F.row_number().over(W.partitionBy("h1", "h2").orderBy(order))
    return df.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", beam: int = SEARCH_BEAM,
    shard_rows: int | None = None, probe_all: bool = False,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the ``k`` nearest rows of ``vectors`` found, by cosine.

    ``queries`` has the same columns; a query is never its own neighbour: of the
    rows with its id and vector one is left out.  Ties go to the smaller id; if
    there are fewer candidates all are returned.  Null ids, and vectors that are
    null, zero or hold a null or non-finite component, take no part; rows with one
    id are different rows; vectors of another length are never candidates.  An
    empty table gives an empty result; other columns are ignored.  ``shard_rows``
    sets the size of shards (default: by the table and the number of partitions),
    ``probe_all`` searches all shards whatever was measured.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
        v = v.filter(F.col("vec_id").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v"))
        return v.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})

    # an answer needs no more than the k + 1 smallest ids of equal vectors
    rows = materialize(_distinct(clean(vectors), "vec_id", k + 1), "vectors")
    every = clean(queries).select("vec_id", "h1", "h2", "v", "dim")
    asked = materialize(_distinct(every, "vec_id", 1).select("h1", "h2", "v", "dim"), "queries")
    n, m = rows.count(), asked.count()
    most = shard_rows or int(np.clip(n // max(1, 2 * partitions(spark)), LEAST_SHARD_ROWS, SHARD_ROWS))

    cells = Cells()
    if n > most:
        wanted = min(CELLS, -(-n // most))
        few = rows.filter(F.pmod(F.xxhash64(F.lit(2), "h1"), F.lit(n)) < SAMPLE).dropDuplicates(["h1", "h2"]).orderBy("h1", "h2").select("v", "dim").toPandas()
        for dim, part in few.groupby("dim"):
            cells.fit(_matrix(part["v"]), -(-wanted * len(part) // len(few)), k)
    if probe_all:
        cells.of = {d: (c, len(c)) for d, (c, _) in cells.of.items()}
    sent = spark.sparkContext.broadcast(cells)  # at most CELLS centres for the lengths in the sample
    rows = materialize(_placed(rows, sent, False).withColumn("cell", F.element_at("cells", 1)).drop("cells"), "cells")
    subs = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / (1.5 * most)).cast("int").alias("subs"))
    subs = materialize(subs, "shards")
    shards = subs.agg(F.coalesce(F.sum("subs"), F.lit(0))).first()[0]
    rows = rows.join(subs, ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("h1"), F.col("subs")).cast("int")).drop("subs")
    keys = ["dim", "cell", "sub"]
    # many more partitions than shards, and a stated number, so that two shards seldom meet in a task
    index = rows.repartition(8 * max(1, shards), *keys).groupBy(*keys).applyInPandas(
        _build, "dim int, cell int, sub int, ids binary, starts binary, hashes binary, vectors binary, links binary, start int"
    )
    index = materialize(index, "graphs")
    blocks = max(1, -(-m // QUERY_BLOCK))
    keys = [*keys, "block"]
    asked = _placed(asked, sent, True).withColumn("cell", F.explode("cells")).drop("cells").join(subs, ["dim", "cell"])
    asked = asked.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).withColumn("block", F.pmod(F.xxhash64("h2"), F.lit(blocks)).cast("int"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = 8 * max(1, shards) * blocks
    left, right = index.repartition(tasks, *keys), asked.select(*keys, "h1", "h2", "v").repartition(tasks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_search(k + 1, beam), "h1 long, h2 long, score double, vec_id long, same boolean")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "same"))), 1, k + 1)  # k + 1 of each shard
    best = materialize(found.groupBy("h1", "h2").agg(best.alias("best")), "found")
    got = every.select("vec_id", "h1", "h2").join(best, ["h1", "h2"])
    own = F.array_position(F.transform("best", lambda x: x["same"] & (x["vec_id"] == F.col("vec_id"))), True)
    rest = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("own")), 1, k)
    got = got.withColumn("own", own).select(F.col("vec_id").alias("query_id"), F.posexplode(rest).alias("at", "x"))
    return got.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
