"""Centroid clustering: Lloyd's rounds in integers, with the bounds and the ball search of the Shallot method.

Each vector remembers its centroid, the second-nearest one of its last search, an upper bound on the distance to the first
and a lower bound on the distance to all others. If these, or half the distance from the centroid to its nearest
neighbour, show that nothing can have changed, the vector is done. Else the exact distances to the two remembered
centroids are taken, and the scan starts from the closer one: its neighbours come in the order of their distance from it,
and the scan ends as soon as the next is farther than the distances to the best and second-best together. This ball
shrinks with each better second. Bounds are floating, rounded to the safe side, and excluded only where they are strictly
larger; survivors are compared by exact integer distances, ties by the smaller number.

Scale: vectors become integers once and are never shuffled; a round writes them with their bounds, so that a lost
executor costs one round of its rows. A task sends one row of sums for each cluster and component. Centroids are
broadcast: their number is a parameter, MOST_CENTROIDS at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import carried, materialize, release, unused

DIMS = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
MOST_CENTROIDS = 4096
#: Larger components would take squared distances beyond 64-bit integers.
LARGEST = 1 << 27
#: Numbers that a task works on at once.
BLOCK = 1 << 19
#: Floating distances are off by less than this part of them.
SLACK = 1e-12
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

_STATE = [T.StructField("vector", T.BinaryType()), T.StructField("near", T.IntegerType()), T.StructField("other", T.IntegerType()), T.StructField("upper", T.DoubleType()), T.StructField("lower", T.DoubleType()), T.StructField("distance", T.LongType())]


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have ``dims`` components, all of them finite numbers, and for these floor(scale * x) of each."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    flat = pc.cast(column.filter(right).flatten(), pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(flat).all(axis=1)
    good = right.to_numpy(zero_copy_only=False).astype(bool)
    good[good] = finite
    whole = np.floor(scale * flat[finite])
    if len(whole) and np.abs(whole).max() > LARGEST:
        raise ValueError(f"a vector has a component of {np.abs(whole).max():g} units, more than {LARGEST}: its distances would not fit 64-bit integers")
    return good, whole.astype(np.int64)


def packed(vectors: np.ndarray) -> pa.Array:
    """Vectors as a binary column of 32-bit integers."""
    n, dims = vectors.shape
    offsets = np.arange(n + 1, dtype=np.int32) * np.int32(4 * dims)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(vectors.astype("<i4").tobytes())])


def unpacked(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dims).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows."""
    apart = a - b
    return np.einsum("ij,ij->i", apart, apart)


class Search:
    """The centroids of a round, how far they moved to get here, and their neighbours in the order of distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids, k = centroids, len(centroids)
        apart = np.stack([squared(centroids, c) for c in centroids])
        order = np.argsort(apart, axis=1, kind="stable")
        self.neighbours = np.stack([row[row != i] for i, row in enumerate(order)]) if k > 1 else np.zeros((1, 0), dtype=np.int64)
        self.gaps = np.sqrt(np.take_along_axis(apart, self.neighbours, axis=1)) * (1 - SLACK)
        self.half = self.gaps[:, 0] / 2 if k > 1 else np.full(1, np.inf)
        self.first = before is None
        self.moved = np.zeros(k) if before is None else np.sqrt(squared(centroids, before)) * (1 + SLACK)
        top = np.argsort(self.moved)[::-1]
        # What any other centroid has moved at most.
        self.others_moved = np.full(k, self.moved[top[0]])
        self.others_moved[top[0]] = self.moved[top[1]] if k > 1 else 0.0

    def assign(self, v: np.ndarray, near: np.ndarray, other: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings the bounds and numbers of vectors up to these centroids, in place; the number of distances taken."""
        c, k, taken = self.centroids, len(self.centroids), 0
        if self.first:
            near[:], other[:], lower[:] = 0, min(1, k - 1), np.inf if k == 1 else -np.inf
            left = np.arange(len(v))
        else:
            upper += self.moved[near]
            lower -= self.others_moved[near]
            left = np.flatnonzero(upper * (1 + SLACK) >= np.maximum(lower, self.half[near]))
        best = squared(v[left], c[near[left]])
        taken += len(left)
        upper[left] = np.sqrt(best) * (1 + SLACK)
        stay = upper[left] >= np.maximum(lower[left], self.half[near[left]])
        left, best = left[stay], best[stay]
        if k == 1 or not len(left):
            return taken
        x, one, two = v[left], near[left].astype(np.int64), other[left].astype(np.int64)
        second = squared(x, c[two])
        taken += len(left)
        swap = (second < best) | (second == best) & (two < one)
        one[swap], two[swap], best[swap], second[swap] = two[swap], one[swap], second[swap], best[swap]
        start, skip, reach = one.copy(), two.copy(), np.sqrt(best) * (1 + SLACK)
        live = np.arange(len(left))
        for p in range(k - 1):
            live = live[self.gaps[start[live], p] <= reach[live] + np.sqrt(second[live]) * (1 + SLACK)]
            if not len(live):
                break
            j = self.neighbours[start[live], p]
            at, j = live[j != skip[live]], j[j != skip[live]]
            d = squared(x[at], c[j])
            taken += len(at)
            first = (d < best[at]) | (d == best[at]) & (j < one[at])
            runner = ~first & ((d < second[at]) | (d == second[at]) & (j < two[at]))
            up, to = at[first], at[runner]
            two[up], second[up] = one[up], best[up]
            one[up], best[up] = j[first], d[first]
            two[to], second[to] = j[runner], d[runner]
        near[left], other[left] = one, two
        upper[left], lower[left] = np.sqrt(best) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)
        return taken


def _stepped(sent, dims: int, keep: list[str], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: rows of the state after a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, BLOCK // dims)):
                part = batch.slice(at, max(1, BLOCK // dims))
                v = unpacked(part[names[0]], dims)
                near, other, upper, lower = (np.array(part[n].to_numpy(zero_copy_only=False)) for n in names[1:5])
                search.assign(v, near, other, upper, lower)
                state = [near, other, upper, lower, squared(v, search.centroids[near])]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), part[names[0]], *map(pa.array, state)], names=[*keep, *names])

    return run


def _sums(dims: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: cluster, n and the sums of components, a row for each cluster that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts = np.zeros((most, dims), dtype=np.int64), np.zeros(most, dtype=np.int64)
        for batch in batches:
            near = batch["near"].to_numpy(zero_copy_only=False)
            np.add.at(total, near, unpacked(batch["vector"], dims))
            counts += np.bincount(near, minlength=most)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], names=["near", "n", "sums"])

    return run


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floored mean of its vectors; one without vectors stays."""
    dims = centroids.shape[1]
    parts = state.mapInArrow(_sums(dims, len(centroids)), "near int, n long, sums array<long>")
    rows = parts.select("near", "n", F.posexplode("sums").alias("pos", "x")).groupBy("near", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["near"], r["pos"]] = r["x"] // r["n"]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, keep: Iterable[str] | None = None) -> DataFrame:
    """cluster, distance, cluster_inertia, inertia and centroid_sha256 for each kept vector, with the columns ``keep``.

    Kept are vectors (arrays of numbers) with ``dims`` components, none null, NaN or infinite; others have no row.
    Components count as floor(scale * x). The first centroids are the vectors with the smallest sha256 of
    ``seed:vec_id``, a null id being empty; of equal ids the one with the smaller packed vector comes first. With fewer
    vectors than clusters there are as many clusters as vectors; without any the result is empty. Repeated vectors and
    equal centroids are no special case: ties go to the smaller number, so that later equals stay empty and where they
    are. keep is all columns but the embedding if not given; columns with the names of results are replaced. A component
    beyond 2 ** 27 units is an error, as its distances would not fit a long.
    """
    if not 1 <= clusters <= MOST_CENTROIDS:
        raise ValueError(f"clusters must be from 1 to {MOST_CENTROIDS}")
    keep = carried(vectors, embedding, *ADDED) if keep is None else list(keep)
    names = [unused(f.name, keep) for f in _STATE]
    taken = vectors.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{embedding}`").alias(names[0]), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{vec_id}`").cast("string"), F.lit(""))), 256).alias(unused("hash", [*keep, *names])))
    digests = taken.columns[-1]

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, whole = integers(batch[names[0]], dims, scale)
            rest, n = batch.filter(pa.array(good)), len(whole)
            state = [packed(whole), pa.nulls(n, pa.int32()).fill_null(0), pa.nulls(n, pa.int32()).fill_null(0), pa.nulls(n, pa.float64()).fill_null(0), pa.nulls(n, pa.float64()).fill_null(0), pa.nulls(n, pa.int64()).fill_null(0)]
            yield pa.RecordBatch.from_arrays([*(rest[c] for c in keep), *state, rest[digests]], names=[*keep, *names, digests])

    fields = [T.StructField(f.name, f.dataType) for f in taken.schema.fields[: len(keep)]] + [T.StructField(n, f.dataType) for n, f in zip(names, _STATE, strict=True)]
    state = materialize(taken.mapInArrow(quantised, T.StructType([*fields, T.StructField(digests, T.StringType())])), "vectors", "zstd")
    start = [r[0] for r in state.orderBy(digests, names[0]).select(names[0]).limit(clusters).collect()]
    if not start:
        kinds = dict(zip(ADDED, ("int", "long", "long", "long", "string"), strict=True))
        return state.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    centroids, before = np.stack([np.frombuffer(x, dtype="<i4").astype(np.int64) for x in start]), None
    for t in range(rounds + 1):
        sent = vectors.sparkSession.sparkContext.broadcast(Search(centroids, before))
        after = materialize(state.select(*[F.col(f"`{c}`") for c in [*keep, *names]]).mapInArrow(_stepped(sent, dims, keep, names), T.StructType(fields)), "assigned", "zstd")
        release(state)
        state, before = after, centroids
        if t < rounds:
            centroids = moved(state.select(F.col(names[0]).alias("vector"), F.col(names[1]).alias("near")), centroids)
    near, distance = F.col(names[1]), F.col(names[5])
    sums = {r["near"]: r["s"] for r in state.groupBy(near.alias("near")).agg(F.sum(distance).alias("s")).collect()}
    told = [(i, sums.get(i, 0), sum(sums.values()), digest(c)) for i, c in enumerate(centroids)]
    key = unused("key", [*keep, *names])
    of = F.broadcast(vectors.sparkSession.createDataFrame(told, f"{key} int, cluster_inertia long, inertia long, centroid_sha256 string"))  # a row for each centroid
    both = state.alias("s").join(of.alias("o"), F.col(f"s.{names[1]}") == F.col(f"o.{key}"))
    return both.select(*[F.col(f"s.`{c}`").alias(c) for c in keep], F.col(f"o.{key}").alias("cluster"), F.col(f"s.{names[5]}").alias("distance"), *[F.col(f"o.{c}").alias(c) for c in ADDED[2:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return cluster(vectors.select("vec_id", "embedding"))


_ROUND = """
a{t} AS (
  SELECT vec_id, q, min(row(d, c)) AS best FROM (
    SELECT v.vec_id, v.q, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, c{t} c)
  GROUP BY vec_id, q),
m{t} AS (
  SELECT c, list(floor(s::DOUBLE / n)::BIGINT ORDER BY i) AS q FROM (
    SELECT best[2] AS c, i, sum(q[i]) AS s, count(*) AS n FROM a{t}, range(1, 65) r(i) GROUP BY ALL)
  GROUP BY c),
c{n} AS MATERIALIZED (SELECT c.c, coalesce(m.q, c.q) AS q FROM c{t} c LEFT JOIN m{t} m USING (c))"""

ORACLE_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT q, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)),
{",".join(_ROUND.format(t=t, n=t + 1) for t in range(ROUNDS))},
last AS (
  SELECT vec_id, min(row(d, c)) AS best FROM (
    SELECT v.vec_id, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, c{ROUNDS} c)
  GROUP BY vec_id)
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(q, ',')) AS centroid_sha256
FROM last JOIN c{ROUNDS} c ON c.c = best[2]
"""
