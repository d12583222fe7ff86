"""Exact top-k by inner product through a pivot-distance index.

Every vector gets one more component, sqrt(M^2 - |x|^2) for the largest norm M, and queries get 0:
then a larger inner product is a smaller distance.  A vector's key is its nearest pivot and the
distance to it; vectors in key order are cut into blocks, each an annulus [lo, hi] of one pivot.  By
the triangle inequality a query at distance d of the pivot is at least max(d - hi, lo - d) away from
all of a block.  Queries, grouped the same way, first search the annuli nearest to them; the k-th
score found there bounds the second round, which skips every annulus (and, inside one, every row)
that lies farther.  Nothing is approximate.

Pivots are a bounded sample (``PIVOTS`` vectors, by a hash of their id).  A pivot that a third of
all vectors share is as many blocks as it needs: ranges split equal distances by vec_id.

Defined cases: rows whose vector is null, or holds a null or non-finite component, and rows without
a vec_id take no part; shorter vectors count as padded with zeros; repeated rows are candidates each,
and a repeated query is answered each time; rows with the query's own id are its own; an empty table
gives no rows.  A long cannot hold every score of huge components: a scaled component or the score of
a compared pair beyond +-2^63 fails the job with an error that says so.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidewindow.sources.staging import stage

SCALE = 1024
K = 10
PIVOTS = 64
BLOCK = 4096
QUERIES = 512
FIRST = 2  # annuli of the first round
SLACK, RELATIVE = 1e-3, 1e-6  # rounding of distances, the second of the largest norm; scores are integers
EXACT = 2.0**53
LONG = 2.0**63
CLEAN = "vec_id long, vector binary, norm2 double"
KEYED = "vec_id long, vector binary, pivot int, dist double"
BLOCKS = "block long, pivot int, lo double, hi double, least long, ids binary, dists binary, vectors binary"
QBLOCKS = "qblock long, near array<double>, far array<double>, qids binary, qvectors binary"
FOUND = "qblock long, place int, query_id long, vec_id long, score long"


def _quantised(dim: int, scale: int):
    def quantise(batches):
        for batch in batches:
            ids, vectors, norms = [], [], []
            for vec_id, row in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                x = np.zeros(dim)
                x[: len(row)] = row.values.to_numpy(zero_copy_only=False)
                scaled = np.floor(scale * x)
                if np.abs(scaled).max(initial=0) >= LONG:
                    raise OverflowError(f"vec_id {vec_id}: a component times {scale} does not fit a long")
                v = scaled.astype("<i8")
                ids.append(vec_id), vectors.append(v.tobytes()), norms.append(float((v.astype(float) ** 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "vector", "norm2"])

    return quantise


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, vector (little-endian longs), norm2 of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
    valid = valid.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dim = valid.agg(F.max(F.size("embedding"))).first()[0] or 1
    return stage(valid.mapInArrow(_quantised(dim, scale), CLEAN))


def matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    if most(queries) * most(vectors) * queries.shape[1] < EXACT:
        return (queries.astype(float) @ vectors.astype(float).T).astype(np.int64)
    return queries @ vectors.T


def refuse_overflow(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray) -> None:
    """Fail where a score does not fit a long; ``own`` marks pairs that are not compared.

    Products of longs wrap, so a score that fits is right even if a part of its sum did not.
    Doubles settle nearly all pairs; those too near the edge for them are summed as Python integers.
    """
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    if most(queries) * most(vectors) * queries.shape[1] < LONG / 2:
        return
    q, x = queries.astype(float), vectors.astype(float)
    near = np.abs(q @ x.T) + (np.abs(q) @ np.abs(x).T) * queries.shape[1] * 1e-15 >= LONG
    for i, j in np.argwhere(near & ~own).tolist():
        score = sum(a * b for a, b in zip(queries[i].tolist(), vectors[j].tolist()))
        if not -(2**63) <= score < 2**63:
            raise OverflowError(f"the score {score} of a query and a vector does not fit a long")


def distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows, with their added component, to the pivots (which have theirs)."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p[:-1]) ** 2).sum(1) + (extra - p[-1]) ** 2)
    return out


def _keyed(pivots, top):
    def key(batches):
        for batch in batches:
            x = matrix(batch.column("vector")).astype(float) if batch.num_rows else np.zeros((0, 1))
            if not len(x):
                continue
            extra = np.sqrt(np.maximum(top - (x**2).sum(1), 0)) if top is not None else np.zeros(len(x))
            d = distances(x, extra, pivots)
            near = d.argmin(1)
            columns = [batch.column("vec_id"), batch.column("vector"), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near])]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vector", "pivot", "dist"])

    return key


def _in_blocks(batches, most: int):
    """Arrow tables of up to ``most`` consecutive rows of one pivot."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        while now.num_rows:
            pivot = now.column("pivot").to_numpy()
            same = int(np.argmax(pivot != pivot[0])) if (pivot != pivot[0]).any() else len(pivot)
            if same == len(pivot) and same < most:
                break
            yield now.slice(0, min(same, most))
            now = now.slice(min(same, most))
        held = now
    if held is not None and held.num_rows:
        yield held


def _pack(block: int):
    def pack(batches):
        base = TaskContext.get().partitionId() << 33
        for i, t in enumerate(_in_blocks(batches, block)):
            d = t.column("dist").to_numpy()
            ids = t.column("vec_id").to_numpy()
            row = {
                "block": base + i, "pivot": t.column("pivot")[0].as_py(), "lo": d[0], "hi": d[-1], "least": int(ids.min()),
                "ids": ids.tobytes(), "dists": d.tobytes(), "vectors": matrix(t.column("vector")).tobytes(),
            }
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, _schema(BLOCKS))

    return pack


def _pack_queries(pivots, block: int):
    def pack(batches):
        base = TaskContext.get().partitionId() << 33
        for i, t in enumerate(_in_blocks(batches, block)):
            q = matrix(t.column("vector"))
            d = distances(q.astype(float), np.zeros(len(q)), pivots)
            row = {
                "qblock": base + i, "near": d.min(0).tolist(), "far": d.max(0).tolist(),
                "qids": t.column("vec_id").to_numpy().tobytes(), "qvectors": q.tobytes(),
            }
            yield pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, _schema(QBLOCKS))

    return pack


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split(" ", 1) for f in text.split(", "))])


def _search(pivots, top: float, k: int):
    """Rows of (query block, annulus): the k best of the annulus for every query, by (score, smaller id)."""

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                qids, ids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q = np.frombuffer(r["qvectors"], "<i8").reshape(len(qids), -1)
                x = np.frombuffer(r["vectors"], "<i8").reshape(len(ids), -1)
                dists = np.frombuffer(r["dists"])
                floor = np.frombuffer(r["floors"], np.int64) if r["floors"] else None
                tie = np.frombuffer(r["ties"], np.int64) if r["ties"] else None
                places = np.arange(len(qids))
                if floor is not None:
                    p = pivots[r["pivot"]]
                    d = distances(q.astype(float), np.zeros(len(q)), p[None])[:, 0]
                    reach = radius(q, floor, top)
                    places = np.flatnonzero((d - dists[-1] <= reach) & (dists[0] - d <= reach))
                    if not len(places):
                        continue
                    a = np.searchsorted(dists, (d - reach)[places].min(), "left")
                    b = np.searchsorted(dists, (d + reach)[places].max(), "right")
                    ids, x = ids[a:b], x[a:b]
                if not len(ids):
                    continue
                refuse_overflow(q[places], x, qids[places][:, None] == ids[None, :])
                s = scores_of(q[places], x)
                n = min(k, len(ids))
                found = []
                for j, place in enumerate(places.tolist()):
                    mine = s[j]
                    mine[ids == qids[place]] = np.iinfo(np.int64).min  # the query's own rows take no place among the k
                    least = np.partition(mine, len(mine) - n)[len(mine) - n]
                    at = np.flatnonzero(mine >= least)
                    at = at[ids[at] != qids[place]]
                    if floor is not None:
                        at = at[(mine[at] > floor[place]) | ((mine[at] == floor[place]) & (ids[at] < tie[place]))]
                    at = at[np.lexsort((ids[at], -mine[at]))][:k]
                    found += [(r["qblock"], place, int(qids[place]), int(ids[c]), int(mine[c])) for c in at.tolist()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _schema(FOUND))], schema=_schema(FOUND))

    return search


def radius(q, floor, top: float):
    """How far a vector of at least this score may be; infinite where no k-th score is known."""
    open_ = floor == np.iinfo(np.int64).min
    far = np.sqrt(np.maximum(top + (q.astype(float) ** 2).sum(1) - 2 * np.where(open_, 0, floor).astype(float), 0))
    far = far + SLACK + RELATIVE * np.sqrt(top)
    return np.where(open_, np.inf, far)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Ranks per query; every task keeps its own k best before the shuffle."""
    order = Window.partitionBy("qblock", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _floors():
    """(qblock, place, score, vec_id) of the k-th hits -> per query block the packed floors and ties."""

    def pack(key, table):
        places = table.column("place").to_numpy()
        floors = np.full(int(places.max()) + 1, np.iinfo(np.int64).min)
        ties = floors.copy()
        floors[places], ties[places] = table.column("score").to_numpy(), table.column("vec_id").to_numpy()
        return pa.table({"qb": [key[0].as_py()], "floors": [floors.tobytes()], "ties": [ties.tobytes()]})

    return pack


def top_k(rows: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products of every query row.

    ``is_query`` is a condition on vec_id.
    """
    spark = rows.sparkSession
    clean = quantised(rows)
    sample = clean.orderBy(F.xxhash64("vec_id"), "vec_id").select("vector", "norm2").limit(pivots).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top = float(clean.agg(F.max("norm2")).first()[0])
    base = np.array([np.frombuffer(r["vector"], "<i8") for r in sample], float)
    points = np.unique(np.column_stack([base, np.sqrt(np.maximum(top - (base**2).sum(1), 0))]), axis=0)
    ordered = ("pivot", "dist", "vec_id")
    keyed = lambda df, t: df.mapInArrow(_keyed(points, t), KEYED).repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    index = stage(keyed(clean, top).mapInArrow(_pack(block), BLOCKS))
    asked = stage(keyed(clean.where(is_query), None).mapInArrow(_pack_queries(points, queries), QBLOCKS))
    # Every annulus with every query block: figures only, joined on the pivot.
    sides = asked.select("qblock", F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "d"))
    bound = F.greatest(F.lit(0.0), F.col("d.near") - F.col("hi"), F.col("lo") - F.col("d.far"))
    pairs = index.select("block", "pivot", "lo", "hi", "least").join(sides, "pivot").select("qblock", "block", bound.alias("bound"), "least")
    nearest = Window.partitionBy("qblock").orderBy("bound", "least", "block")
    pairs = stage(pairs.withColumn("turn", F.row_number().over(nearest)))
    search = _search(points, top, k)
    payload = ["qblock", "qids", "qvectors", "pivot", "ids", "dists", "vectors", "floors", "ties"]
    none = F.lit(None).cast("binary")
    first = pairs.where(F.col("turn") <= FIRST).select("qblock", "block").join(asked, "qblock").join(index, "block")
    first = first.withColumn("floors", none).withColumn("ties", none).select(payload)
    found = stage(_best(first.mapInArrow(search, FOUND), k).drop("rank"))
    kth = _best(found, k).where(F.col("rank") == k).select("qblock", "place", "score", "vec_id")
    kth = kth.groupBy("qblock").applyInArrow(_floors(), "qb long, floors binary, ties binary")
    known = asked.join(kth, asked["qblock"] == F.col("qb"), "left").drop("qb")
    known = stage(known.mapInArrow(_reach(top), QBLOCKS + ", floors binary, ties binary, reach double"))
    rest = pairs.where(F.col("turn") > FIRST).join(known, "qblock").where(F.col("bound") <= F.col("reach"))
    rest = rest.join(index.drop("lo", "hi", "least"), "block").select(payload)
    every = found.unionByName(rest.mapInArrow(search, FOUND))
    return _best(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _reach(top: float):
    """Complete the floors of a query block, and its largest radius."""

    def reach(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                q = np.frombuffer(r["qvectors"], "<i8").reshape(len(r["qids"]) // 8, -1)
                floors = np.full(len(q), np.iinfo(np.int64).min)
                ties = floors.copy()
                if r["floors"]:
                    some = np.frombuffer(r["floors"], np.int64)
                    floors[: len(some)], ties[: len(some)] = some, np.frombuffer(r["ties"], np.int64)
                out.append(r | {"floors": floors.tobytes(), "ties": ties.tobytes(), "reach": float(radius(q, floors, top).max())})
            if out:
                yield pa.RecordBatch.from_pylist(out, _schema(QBLOCKS + ", floors binary, ties binary, reach double"))

    return reach
