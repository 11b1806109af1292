"""Approximate nearest neighbours: IVF lists of product-quantised residuals.

Copies are searched once: a distinct vector has one row in the index, with the k + 1
smallest of its ids, and equal queries are one query until the end.

Fit (driver, numpy, on at most ``sample_rows`` distinct vectors): k-means centroids whose
number grows with the square root of the table as far as the sample trains them (an
eighth of its rows, 2,500 lists of 20,000 sampled vectors, from about 390,000 vectors
on; beyond that the lists grow, and raising ``sample_rows`` with the table keeps them
small), and codebooks of the residuals (two components to a code).  Residuals are
coded at length 1 and carry their scale, so tight and wide lists are told apart equally
well, and vectors are scaled and shifted to the middle of the sample, since that changes
no query's order and keeps float32 exact enough for any magnitude.

Index (one map): every vector gets its list, scale and codes; only these are written to
shared storage and shuffle.  Lists are put into blocks of bounded size: small lists
share a block, a large list is salted over several.

Probing: a list promises a query the product with its centroid plus ``reach`` standard
deviations of its residuals in the query's direction, and is probed if that is at least
the product of the k-th neighbour, as the sample shows it.  So each query has as many lists
as it needs; at least so many that they hold ``depth`` vectors.

Calibration: the true neighbours of up to 256 of the queries asked (a sample of the table says
nothing about queries that are unlike it) are found by brute force over the whole table,
in work linear in it.  ``reach`` is the smallest under which ``aim`` of them are
probed, and ``depth`` the smallest, and at least twelve for each wanted, that keeps 0.99
of the probed.

Search: a query goes to the blocks of its probed lists.  The queries of a block are
cut into chunks of bounded size, and the block is copied once a chunk, so copies
grow with the probing of a block and not with the number of all queries.  A task scores the probed lists of one block by asymmetric distance tables
(query x centroid plus one table entry for each code) and keeps the best ``depth``
of each query; the best ``depth`` of all blocks meet their original vectors in a join
by id and are ranked again by the exact product in double precision.

The work is queries x probed rows.  How small the probed share is depends on the
vectors: on clustered ones, or where lengths differ much, a few lists hold the
neighbours; on vectors without any structure (uniform on a sphere) most rows are probed
for a recall of 0.95, and the work then grows with queries x rows.  Many vectors that differ
but tie at the k-th place, or lie closer together than their codes tell, raise ``depth``.

Defined results: vectors that are null, zero, of another dimension than most, or
that hold a null or non-finite component take no part; ties go to the smaller
id; rows that repeat an id count as the one whose components are largest in order;
candidates with the query's id are left out; fewer candidates than k give all of
them; an empty table gives no rows; null ids take no part.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import arrow_map, drop, ship, stash

#: Sample that a query's level is read from; queries whose true neighbours are found by brute force.
SHOWN_BYTES = 8 << 20
MEASURED, MEASURED_BYTES = 256, 4 << 20


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's iterations; an empty cluster restarts at a random row."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        of = nearest(x, c)
        order = np.argsort(of, kind="stable")
        found, first, size = np.unique(of[order], return_index=True, return_counts=True)
        c[found] = np.add.reduceat(x[order], first, axis=0) / size[:, None]
        gone = np.setdiff1d(np.arange(len(c)), found)
        if len(gone):
            c[gone] = x[rng.choice(len(x), len(gone))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dims)


@dataclass
class Index:
    exponent: int  # vectors are halved as often, which costs no bit, so that float32 holds them
    origin: np.ndarray  # and then taken from here, which leaves the order of the products of a query
    centroids: np.ndarray
    books: np.ndarray  # parts x codes x dims of a part, of residuals of length 1
    shape: np.ndarray  # second moments of residuals of length 1
    sample: np.ndarray  # vectors that show how near a query's neighbours are
    spread: np.ndarray | None = None  # root mean square length of the residuals of a list
    sizes: np.ndarray | None = None
    near: int = 1  # the place in the sample that the k-th neighbour has
    reach: float = 0.0
    fill: int = 1  # rows that the probed lists hold at least

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.ldexp(x.astype(np.float64), -self.exponent) - self.origin, -1e12, 1e12).astype(np.float32)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        padded = np.zeros((len(x), parts * width), np.float32)
        padded[:, : x.shape[1]] = x
        return padded.reshape(len(x), parts, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, length of the residual, its scale and its codes for each vector."""
        x = self.place(x)
        of = nearest(x, self.centroids)
        rest, length = directions(x - self.centroids[of])
        rest = self._parts(rest)
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, j]), self.books[j]) for j in range(len(self.books))], axis=1)
        along, square = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
        for j in range(len(self.books)):
            coded = self.books[j][codes[:, j]]
            along, square = along + (rest[:, j] * coded).sum(axis=1), square + (coded * coded).sum(axis=1)
        scale = length * np.where(square > 0, along / np.maximum(square, 1e-30), 0)
        return of.astype(np.int32), length, scale.astype(np.float32), codes.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Product of each query's part with each code: queries x parts x codes."""
        return np.einsum("qpd,pcd->qpc", self._parts(q), self.books)

    def level(self, q: np.ndarray) -> np.ndarray:
        """About the product of each query (of length 1) with its k-th neighbour, from the sample."""
        at = min(self.near, len(self.sample)) - 1
        return np.concatenate([-np.partition(-(q[i : i + 256] @ self.sample.T), at, axis=1)[:, at] for i in range(0, len(q), 256)]) if len(q) else np.zeros(0, np.float32)

    def step(self, q: np.ndarray) -> np.ndarray:
        """Standard deviation of a query's products in each list: queries x lists."""
        along = np.sqrt(np.maximum(np.einsum("qd,de,qe->q", q, self.shape, q, optimize=True), 1e-12))
        rounding = 1e-6 * np.sqrt((self.centroids * self.centroids).sum(axis=1)) + 1e-30
        return along[:, None] * self.spread + rounding

    def promise(self, q: np.ndarray) -> np.ndarray:
        """The product that a list may hold for a query; empty lists hold none."""
        return np.where(self.sizes > 0, q @ self.centroids.T + self.reach * self.step(q), -np.inf).astype(np.float32)

    def least(self, q: np.ndarray) -> np.ndarray:
        """A query's lists with at least this promise are probed."""
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(q), 1024):
            promise = self.promise(q[i : i + 1024])
            order = np.argsort(-promise, axis=1)
            held = np.cumsum(self.sizes[order], axis=1)
            enough = np.minimum((held < self.fill).sum(axis=1), (self.sizes > 0).sum() - 1)
            lowest = promise[np.arange(len(promise)), order[np.arange(len(promise)), enough]]
            low = np.minimum(self.level(q[i : i + 1024]), lowest)
            out.append((low - 1e-5 * np.abs(low) - 1e-30).astype(np.float32))
        return np.concatenate(out)

    def approximate(self, q: np.ndarray, least: np.ndarray, lists: np.ndarray, scales: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products from the codes, queries x rows; -inf in lists that a query does not probe."""
        probed, coarse, tables = self.promise(q) >= least[:, None], q @ self.centroids.T, self.tables(q)
        score = np.full((len(q), len(lists)), -np.inf, np.float32)
        order = np.argsort(lists, kind="stable")
        inside, first = np.unique(lists[order], return_index=True)
        for own, at in zip(inside, np.split(order, first[1:]), strict=True):
            asking = np.flatnonzero(probed[:, own])
            found = np.zeros((len(asking), len(at)), np.float32)
            for j in range(codes.shape[1]):
                found += tables[asking, j][:, codes[at, j]]
            score[np.ix_(asking, at)] = found * scales[at] + coarse[asking, own][:, None]
        return score

    def search_block(self, q: np.ndarray, least: np.ndarray, ids: np.ndarray, lists: np.ndarray, scales: np.ndarray, codes: np.ndarray, depth: int):
        """(row of queries, id, approximate score) of the best ``depth`` of each query in one block."""
        by_id = np.argsort(ids)
        score = self.approximate(q, least, lists[by_id], scales[by_id], codes[by_id])
        row, at = best_of_each(score, depth)
        return row, ids[by_id][at], score[row, at]


def best_of_each(score: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``depth`` largest finite scores of each row; of equal ones at the cut the first stay."""
    kept = np.isfinite(score)
    if score.shape[1] > depth:
        cut = -np.partition(-score, depth - 1, axis=1)[:, depth - 1 : depth]
        over, tied = score > cut, score == cut
        kept &= over | tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= depth - over.sum(axis=1, keepdims=True))
    return np.nonzero(kept)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and their lengths; zero stays zero."""
    length = np.sqrt((x * x).sum(axis=1))
    return x / np.where(length > 0, length, 1)[:, None], length


def asking_vectors(x: np.ndarray) -> np.ndarray:
    """Queries of length 1, since their length does not change the order of their neighbours."""
    top = np.frexp(np.abs(x).max(axis=1, initial=0))[1].astype(np.int32)
    return directions(np.ldexp(x.astype(np.float64), -top[:, None]))[0].astype(np.float32)


def fit(sample: np.ndarray, rows: int, k: int, parts: int | None = None, rounds: int = 8) -> Index:
    """Scale, centroids and codebooks from a sample of a table of ``rows`` distinct vectors."""
    rng = np.random.default_rng(3)
    wide = sample.astype(np.float64)
    exponent = int(np.median(np.frexp(np.abs(wide).max(axis=1))[1]))
    origin = np.median(np.ldexp(wide, -exponent), axis=0)
    dims = wide.shape[1]
    parts = min(parts or -(-dims // 2), dims)
    made = Index(exponent, origin, np.zeros((1, dims), np.float32), np.zeros((parts, 1, -(-dims // parts)), np.float32), np.zeros((dims, dims), np.float32), np.zeros((0, dims), np.float32))
    x = made.place(wide)
    made.centroids = kmeans(x, max(1, min(int(4 * np.sqrt(rows)), 16384, len(x) // 8 or 1)), rounds, rng)
    rest, length = directions(x - made.centroids[nearest(x, made.centroids)])
    rest = rest[length > 0] if (length > 0).any() else rest
    made.shape = (rest.T @ rest / len(rest)).astype(np.float32)
    parted = made._parts(rest)
    made.books = np.stack([kmeans(np.ascontiguousarray(parted[:, j]), 256, rounds, rng) for j in range(parts)])
    made.sample = x[: max(1, SHOWN_BYTES // (4 * dims))]
    made.near = 1 + -(-k * len(made.sample) // max(rows, 1))
    return made


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _near_ones(found: DataFrame, best: Column, by: str, k: int) -> DataFrame:
    """The first k rows of each ``by``, ties to the smaller id."""
    return found.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(best, "vec_id"))).where(F.col("at") <= k)


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample_rows: int = 20_000,
    aim: float = 0.975,
    depth: int | None = None,
    block_rows: int = 8192,
    chunk_rows: int = 2048,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner product for each query.

    ``depth`` candidates a query are ranked exactly; if it is not given, about twelve for each
    wanted, and more if the codes put true neighbours of the measured queries further back.
    """
    spark = vectors.sparkSession
    ship(spark)
    of_type = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "array<float>" if of_type == "float" else "array<double>"

    def thin(df: DataFrame, name: str) -> DataFrame:
        good = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias(name), F.col(vector_col).cast(kind).alias("v"))
        return good.groupBy(name).agg(F.max("v").alias("v"))

    raw, asked = stash(thin(vectors, "vec_id"), "vectors"), stash(thin(queries, "query_id"), "queries")
    lengths = sorted(((r[1], r[0]) for r in raw.groupBy(F.size("v")).count().collect()), reverse=True)
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = lengths[0][1]
    every, asked = raw.where(F.size("v") == dims), asked.where(F.size("v") == dims)
    # one row a distinct vector, under its smallest id; no query needs more than k + 1 of its ids
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    good = every.withColumn("at", F.row_number().over(by_vector)).where(F.col("at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    good = stash(good.select(F.col("ids")[0].alias("vec_id"), "v", "ids"), "distinct")
    drop(raw)
    heads = stash(asked.groupBy("v").agg(F.min("query_id").alias("head")), "heads")
    members = asked.join(heads, "v").select("head", "query_id")
    rows = good.count()
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
    index = fit(_rows(sample.column("v"), dims), rows, k)
    first = spark.sparkContext.broadcast(index)

    def encoding():
        found = first.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            of, length, scale, codes = found.encode(_rows(b.column("v"), dims))
            return pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(of), pa.array(length), pa.array(scale), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "list", "length", "scale", "codes"])

        return step

    indexed = stash(arrow_map(good.select("vec_id", "v"), encoding, "vec_id long, list int, length float, scale float, codes binary"), "ivf")
    counts, index.sizes, index.spread = {}, np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids), np.float32)
    for own, n, square in indexed.groupBy("list").agg(F.count("*"), F.avg(F.col("length").cast("double") * F.col("length"))).collect():
        counts[own] = index.sizes[own] = n
        index.spread[own] = np.sqrt(square)
    index.fill = depth or 12 * k + 16
    measured = heads.orderBy(F.xxhash64("head"), "head").limit(max(16, min(MEASURED, MEASURED_BYTES // (8 * dims)))).select("v").toArrow()
    wanted = _rows(measured.column("v"), dims).astype(np.float64)
    depth = _calibrate(index, good, indexed, wanted, k, aim, depth)
    chunk_rows = max(1, min(chunk_rows, (1 << 22) // min(depth, block_rows)))
    shared = spark.sparkContext.broadcast(index)
    block_rows = max(256, min(block_rows, rows // 24))
    plan, block, room = [], 0, block_rows
    for own, n in sorted(counts.items()):
        salts = -(-n // block_rows)
        share = -(-n // salts)
        if share > room:
            block, room = block + 1, block_rows
        plan.append((own, block, salts))
        block, room = (block + salts - 1, block_rows - share) if salts > 1 else (block, room - share)
    blocks = spark.createDataFrame(plan, "list int, first int, salts int")
    spread = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("salts"))).cast("int")
    of_list = {own: (first, salts) for own, first, salts in plan}

    def routing():
        found = shared.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            cuts, goes = [], []
            for i in range(0, b.num_rows, 1024):
                q = asking_vectors(_rows(b.column("v").slice(i, 1024), dims))
                cuts.append(found.least(q))
                probed = found.promise(q) >= cuts[-1][:, None]
                goes += [sorted({f + s for own in np.flatnonzero(row).tolist() for f, n in [of_list[own]] for s in range(n)}) for row in probed]
            return pa.RecordBatch.from_arrays([b.column("head"), b.column("v"), pa.array(np.concatenate(cuts) if cuts else np.zeros(0, np.float32)), pa.array(goes, pa.list_(pa.int32()))], names=["head", "v", "least", "blocks"])

        return step

    # a block is copied once for every ``chunk_rows`` of the queries that probe it, and not at all if none does
    routed = stash(arrow_map(heads, routing, f"head long, v {kind}, least float, blocks array<int>"), "routed")
    asking = routed.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    asking = F.broadcast(stash(asking, "asking"))
    left = indexed.join(F.broadcast(blocks), "list").select("vec_id", "list", "scale", "codes", spread.alias("block")).join(asking, "block")
    left = left.select("vec_id", "list", "scale", "codes", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = routed.select("head", "v", "least", F.explode("blocks").alias("block")).join(asking, "block")
    right = right.select("head", "v", "least", "block", F.pmod(F.xxhash64("head"), F.col("chunks")).cast("int").alias("chunk"))

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        row, vec, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        ids = theirs.column("head").to_numpy()
        if ours.num_rows and theirs.num_rows:
            q = asking_vectors(_rows(theirs.column("v"), dims))
            row, vec, near = shared.value.search_block(q, theirs.column("least").to_numpy(), *_index_rows(ours), depth)
        return pa.table({"head": ids[row], "vec_id": vec, "near": near})

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "head long, vec_id long, near float")
    found = _near_ones(found, F.desc("near"), "head", depth).select("head", "vec_id")

    def products():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (_rows(b.column(c), dims).astype(np.float64) for c in ("v", "q"))
            return pa.RecordBatch.from_arrays([b.column("head"), b.column("vec_id"), b.column("ids"), pa.array((x * y).sum(axis=1))], names=["head", "vec_id", "ids", "score"])

        return step

    whole = found.join(good, "vec_id").join(heads.select("head", F.col("v").alias("q")), "head").select("head", "vec_id", "ids", "v", "q")
    exact = arrow_map(whole, products, "head long, vec_id long, ids array<long>, score double")
    # copies come back here, and every query leaves out itself
    exact = _near_ones(exact, F.desc("score"), "head", k + 1).select("head", "score", F.explode("ids").alias("vec_id"))
    exact = _near_ones(exact, F.desc("score"), "head", k + 1).drop("at")
    exact = exact.join(members, "head").where(F.col("vec_id") != F.col("query_id"))
    return _near_ones(exact, F.desc("score"), "query_id", k).select("query_id", F.col("at").alias("rank"), "vec_id", "score")


def _index_rows(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Ids, lists, scales and codes."""
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, -1)
    return *(b.column(c).to_numpy() for c in ("vec_id", "list", "scale")), codes


def _calibrate(index: Index, good: DataFrame, indexed: DataFrame, wanted: np.ndarray, k: int, aim: float, depth: int | None) -> int:
    """Set ``reach`` so that ``aim`` of the true neighbours of the queries ``wanted`` are probed; the depth that keeps 0.99 of these."""
    spark, default, dims = good.sparkSession, depth or index.fill, wanted.shape[1]
    if not len(wanted):
        return default
    shared = spark.sparkContext.broadcast(wanted)

    def truth():
        asked = shared.value

        def step(b: pa.RecordBatch) -> pa.Table:
            ids, x, made = b.column("vec_id").to_numpy(), _rows(b.column("v"), dims).astype(np.float64), []
            for i in range(0, len(x) or 1, 8192):
                by_id = i + np.argsort(ids[i : i + 8192])
                score = asked @ x[by_id].T
                row, at = best_of_each(score, k + 1)
                other = (asked[row] != x[by_id[at]]).any(axis=1)
                row, at = row[other], at[other]
                made.append(pa.table({"asked": pa.array(row.astype(np.int32)), "vec_id": ids[by_id[at]], "score": score[row, at]}))
            return pa.concat_tables(made)

        return step

    pairs = _near_ones(arrow_map(good.select("vec_id", "v"), truth, "asked int, vec_id long, score double"), F.desc("score"), "asked", k)
    pairs = indexed.join(F.broadcast(pairs.select("asked", "vec_id")), "vec_id").select("asked", "vec_id", "list", "scale", "codes").toArrow().sort_by([("asked", "ascending"), ("vec_id", "ascending")])
    if not pairs.num_rows:
        return default
    q, asked = asking_vectors(wanted), pairs.column("asked").to_numpy()
    _, lists, scales, codes = _index_rows(pairs)
    need = (index.level(q)[asked] - (q[asked] * index.centroids[lists]).sum(axis=1)) / index.step(q)[asked, lists]
    index.reach = max(0.0, float(np.quantile(need, aim, method="higher")))
    if depth:
        return depth
    least = index.least(q)
    bars = []
    for i in range(len(q)):
        own = asked == i
        near = index.approximate(q[i : i + 1], least[i : i + 1], lists[own], scales[own], codes[own])[0] if own.any() else np.zeros(0, np.float32)
        near = near[np.isfinite(near)]
        bars.append(np.sort(near - 1e-6 * np.abs(near)))
    known = spark.sparkContext.broadcast((index, q, least, bars))

    def places():
        found, q, least, bars = known.value

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            _, lists, scales, codes = _index_rows(b)
            ahead = [np.zeros(len(bar), np.int64) for bar in bars]
            for i in range(0, len(lists), 8192):
                near = found.approximate(q, least, lists[i : i + 8192], scales[i : i + 8192], codes[i : i + 8192])
                for own, bar, row in zip(ahead, bars, near, strict=True):
                    passed = np.bincount(np.searchsorted(bar, row[np.isfinite(row)], side="right"), minlength=len(bar) + 1)
                    own += passed[::-1].cumsum()[::-1][1:]
            return pa.RecordBatch.from_arrays([pa.array(np.arange(sum(map(len, bars)), dtype=np.int32)), pa.array(np.concatenate(ahead))], names=["pair", "ahead"])

        return step

    placed = arrow_map(indexed.select("vec_id", "list", "scale", "codes"), places, "pair int, ahead long").groupBy("pair").agg(F.sum("ahead")).collect()
    back = np.array([n for _, n in placed])
    return max(default, int(1.1 * np.quantile(back, 0.99, method="higher"))) if len(back) else default
