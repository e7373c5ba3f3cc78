"""Exact top-k by inner product over a pivot-distance index.

Vectors are made of integers, floor(scale * x). Equal vectors become one entry with their smallest ids (as many as a result can hold), so
copies cost nothing. Every entry is keyed by its nearest pivot and its distance to it; entries sorted by that key are cut into annuli, runs
of one pivot and neighbouring distances, each a block with its range of distances and its largest norm. For a query q at distance d from
the pivot, the triangle inequality keeps every x of an annulus [lo, hi] at least gap = max(0, lo - d, d - hi) away, and

    <q, x> = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + max |x|^2 - gap^2) / 2,    <q, x> <= <q, pivot> + |q| * hi.

Queries are taken in chunks of a fixed size. A first pass scores, for each query, the annuli around its own distance at its nearest pivot;
the k-th best score there is a threshold that the true k-th best reaches. A second pass expands, of each pivot, only the annuli whose
bounds reach the threshold, and raises it on the way. The result does not depend on the pivots, only the number of scores does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: pivots are fitted on at most so many vectors
SAMPLE = 8192
PIVOTS = 64
#: entries of an annulus, at most; of many components fewer, so that a block stays near a MB
ANNULUS = 512
#: queries of one pass over the index, and the bytes of their vectors, at most (but one query)
CHUNK = 16_384
CHUNK_BYTES = 32 << 20
#: scores at once in a task
SCORES = 1 << 19
LARGEST, EXACT = 2**63 - 1, 2**53
ENTRY = "vec binary, dims int, wide boolean, norm double, square long"


def quantized(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vec (the integers as bytes), dims, wide (float64 in place of int32, where an integer needs it), norm (squared length) and
    square (the same as an integer, kept within 64 bits) of every vector that takes part: not null, with an id, and without a component
    that is null, not finite or not finite times `scale`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column("vec")
            offsets, flat = np.asarray(column.offsets), column.values
            x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale) + 0.0  # a null is not finite here
            ids, vecs, dims, wide, norms, squares = [], [], [], [], [], []
            named, whole = rows.column("vec_id").to_pylist(), column.is_valid().to_numpy(zero_copy_only=False)
            for i, name in enumerate(named):
                own = x[offsets[i] : offsets[i + 1]]
                if name is None or not whole[i] or not np.isfinite(own).all():
                    continue
                large = bool((np.abs(own) >= 1 << 31).any())
                ids.append(name)
                vecs.append(own.tobytes() if large else own.astype("<i4").tobytes())
                dims.append(len(own))
                wide.append(large)
                norms.append(float(own @ own))
                squares.append(int(norms[-1]) if norms[-1] < EXACT else min(LARGEST, sum(int(v) ** 2 for v in own)))
            columns = [pa.array(ids, pa.int64()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32()), pa.array(wide, pa.bool_()), pa.array(norms, pa.float64()), pa.array(squares, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "vec", "dims", "wide", "norm", "square"])

    return common.pick(df, vec_id=(id_col, "long"), vec=(vector_col, "array<double>")).mapInArrow(run, f"vec_id long, {ENTRY}")


def numbers(data: bytes | memoryview, dims: int, wide: bool) -> np.ndarray:
    """Rows of float64 from the bytes of vectors of equal length."""
    return np.frombuffer(data, "<f8" if wide else "<i4").reshape(-1, dims).astype(np.float64)


def fit_pivots(rows: DataFrame, sample: int, pivots: int, rounds: int = 5) -> dict[int, np.ndarray]:
    """For each number of components in a sample of at most `sample` vectors: means of `rounds` rounds of k-means."""
    total = rows.count()
    taken = rows.select("vec", "dims", "wide").sample(min(1.0, sample / max(1, total)), 7).limit(sample).toArrow().to_pylist() if total else []
    out = {}
    for dims in {r["dims"] for r in taken if r["dims"]}:
        x = np.concatenate([numbers(r["vec"], dims, r["wide"]) for r in taken if r["dims"] == dims])
        x = np.unique(x, axis=0)
        rng = np.random.default_rng(3)
        centres = x[rng.permutation(len(x))[:pivots]]
        for _ in range(rounds):
            near = distances(x, centres).argmin(1)
            centres = np.stack([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        out[dims] = centres
    return out


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances, each computed from the differences, without cancellation."""
    return np.stack([np.sqrt(np.einsum("ij,ij->i", x - c, x - c)) for c in centres], 1)


def centres_of(pivots: dict[int, np.ndarray], dims: int) -> np.ndarray:
    """The pivots for vectors of `dims` components; the origin where the sample had none."""
    return pivots.get(dims, np.zeros((1, dims)))


def build(rows: DataFrame, pivots: dict[int, np.ndarray], copies: int) -> DataFrame:
    """The annuli of all quantized rows, stored: pivot, range of distances, what of it the annulus stands for, largest norm, vectors, ids.

    An entry keeps the `copies` smallest ids of its vector. The limit by groups cuts copies before the shuffle, so a vector that a third
    of all rows share is no hot key.
    """
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= copies)
    entries = few.groupBy("vec", "dims", "wide").agg(F.first("norm").alias("norm"), F.first("square").alias("square"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            pivot, far = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
            dims, wide = part.column("dims").to_numpy(), part.column("wide").to_numpy(zero_copy_only=False)
            vecs = part.column("vec").to_pylist()
            for d in np.unique(dims):
                for w in (False, True):
                    at = np.flatnonzero((dims == d) & (wide == w))
                    if len(at) and d:
                        apart = distances(numbers(b"".join(vecs[i] for i in at), d, w), centres_of(shared.value, int(d)))
                        pivot[at] = apart.argmin(1)
                        far[at] = apart[np.arange(len(at)), pivot[at]]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pivot), pa.array(far)], [*part.schema.names, "pivot", "far"])

    keys = ["dims", "wide", "pivot", "far"]
    placed = entries.mapInArrow(place, f"{ENTRY}, ids array<long>, pivot int, far double")
    ordered = placed.repartitionByRange(*keys, F.xxhash64("vec")).sortWithinPartitions(*keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if not part.num_rows:
                continue
            table = pa.Table.from_batches([part])
            d, w, p = (table[k].to_numpy() for k in ("dims", "wide", "pivot"))
            changes = np.flatnonzero((d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (p[1:] != p[:-1])) + 1
            for lo, hi in zip([0, *changes], [*changes, len(d)], strict=True):
                size = max(1, min(ANNULUS, (1 << 18) // max(1, int(d[lo]))))
                far = table["far"].to_numpy()
                for a in range(lo, hi, size):
                    b = min(hi, a + size)
                    own = table.slice(a, b - a)
                    ids = own["ids"].to_pylist()
                    yield pa.RecordBatch.from_pylist(
                        [
                            {
                                "dims": int(d[a]), "wide": bool(w[a]), "pivot": int(p[a]), "lo": float(far[a]), "hi": float(far[b - 1]),
                                "cover_lo": float(far[a]) if a > lo else -1.0, "cover_hi": float(far[b]) if b < hi else float("inf"),
                                "norm": float(own["norm"].to_numpy().max()), "vecs": b"".join(own["vec"].to_pylist()),
                                "ids": np.array([i for x in ids for i in x], "<i8").tobytes(), "each": np.array([len(x) for x in ids], "<i4").tobytes(),
                            }
                        ],
                        BLOCK_SCHEMA,
                    )

    return common.stored(ordered.select("dims", "wide", "pivot", "far", "norm", "vec", "ids").mapInArrow(cut, BLOCKS))


BLOCKS = "dims int, wide boolean, pivot int, lo double, hi double, cover_lo double, cover_hi double, norm double, vecs binary, ids binary, each binary"
BLOCK_SCHEMA = pa.schema(
    [("dims", pa.int32()), ("wide", pa.bool_()), ("pivot", pa.int32()), *((k, pa.float64()) for k in ("lo", "hi", "cover_lo", "cover_hi", "norm")), *((k, pa.binary()) for k in ("vecs", "ids", "each"))]
)


class Queries:
    """The queries of a chunk that have one number of components: vectors, numbers in the query table, squared norms, distances to all pivots."""

    def __init__(self, rows: list[dict], dims: int, centres: np.ndarray) -> None:
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.x = np.concatenate([numbers(r["vec"], dims, r["wide"]) for r in rows]) if dims else np.zeros((len(rows), 0))
        self.square = np.array([r["norm"] for r in rows])
        self.length = np.sqrt(self.square)
        self.far = distances(self.x, centres)
        self.inner = self.x @ centres.T
        self.home = self.far.argmin(1)
        self.largest = np.abs(self.x).max(initial=0.0)
        self.threshold = np.full(len(rows), -LARGEST - 1, np.int64)

    def bounds(self, block: dict) -> np.ndarray:
        """No entry of the block scores more with a query; errors of rounding are allowed for."""
        far = self.far[:, block["pivot"]]
        gap = np.maximum(0.0, np.maximum(block["lo"] - far, far - block["hi"]))
        longest = np.sqrt(block["norm"])
        by_gap = (self.square + block["norm"] - gap * gap) / 2
        by_pivot = self.inner[:, block["pivot"]] + self.length * block["hi"]
        slack = 1e-9 * (self.square + block["norm"] + self.length * (longest + block["hi"])) + 1
        return np.minimum(np.minimum(by_gap, by_pivot), self.length * longest) + slack

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact inner products: in float64 where all sums stay below 2^53, else of Python's integers, kept within 64 bits."""
        if x.shape[1] * self.largest * np.abs(x).max(initial=0.0) < EXACT:
            return self.x[at] @ x.T
        whole = np.vectorize(int, otypes=[object])
        return np.clip(whole(self.x[at]).dot(whole(x).T), -LARGEST - 1, LARGEST)


class Best:
    """The candidates of a task: the k best of each query by score, then by smallest id, kept after each `CHUNK` or so that are added."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.size, self.limit = k, [], 0, 1 << 16

    def add(self, n: np.ndarray, score: np.ndarray, first: np.ndarray, ids: np.ndarray) -> None:
        self.parts.append((n, score, first, ids))
        self.size += len(n)

    def settle(self) -> tuple[np.ndarray, ...]:
        n, score, first, ids = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        # descending integers without a change of sign that overflows
        order = np.lexsort((first, ~score, n))
        n, score, first, ids = n[order], score[order], first[order], ids[order]
        begins = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
        place = np.arange(len(n)) - np.repeat(begins, np.diff(np.append(begins, len(n))))
        keep = place < self.k
        self.parts = [(n[keep], score[keep], first[keep], ids[keep])]
        self.size = int(keep.sum())
        self.limit = max(1 << 16, 2 * self.size)
        return self.parts[0]


def scan(batches: Iterator[pa.RecordBatch], groups: dict[int, Queries], k: int, home: bool) -> Best:
    """The k best entries of these annuli for every query; with `home`, of the annuli around the query's own distance alone."""
    best = Best(k)
    number = {d: np.argsort(g.n) for d, g in groups.items()}
    threshold = {d: g.threshold.copy() for d, g in groups.items()}
    for part in batches:
        for i in range(part.num_rows):
            block = {c: part.column(c)[i].as_py() for c in ("dims", "wide", "pivot", "lo", "hi", "cover_lo", "cover_hi", "norm")}
            group = groups.get(block["dims"])
            if group is None:
                continue
            least = threshold[block["dims"]]
            if home:
                far = group.far[:, block["pivot"]]
                reached = (group.home == block["pivot"]) & (block["cover_lo"] <= far) & (far < block["cover_hi"])
            else:
                reached = ~(group.bounds(block) < least)  # what is no number is no bound
            active = np.flatnonzero(reached)
            if not len(active):
                continue
            each = np.frombuffer(part.column("each")[i].as_py(), "<i4")
            ids = np.frombuffer(part.column("ids")[i].as_py(), "<i8")
            x = numbers(part.column("vecs")[i].as_py(), block["dims"], block["wide"]) if block["dims"] else np.zeros((len(each), 0))
            starts = np.concatenate([[0], np.cumsum(each)[:-1]])
            step = max(1, SCORES // len(x))
            for a in range(0, len(active), step):
                at = active[a : a + step]
                s = group.scores(at, x).astype(np.int64)
                floor = least[at]
                if s.shape[1] > k:
                    floor = np.maximum(floor, np.partition(s, -k, 1)[:, -k])
                row, col = np.nonzero(s >= floor[:, None])
                held = np.empty(len(col), object)
                held[:] = [ids[b : b + c].tobytes() for b, c in zip(starts[col], each[col], strict=True)]
                best.add(group.n[at][row], s[row, col], ids[starts[col]], held)
            if best.size > best.limit:
                n, score, _, _ = best.settle()
                ends = np.flatnonzero(np.append(n[1:] != n[:-1], True))
                full = ends - np.concatenate([[-1], ends[:-1]]) == k
                for d, g in groups.items():
                    own = np.isin(n[ends], g.n) & full
                    at = number[d][np.searchsorted(g.n, n[ends][own], sorter=number[d])]
                    threshold[d][at] = np.maximum(threshold[d][at], score[ends][own])
    return best


def passed(index: DataFrame, groups: dict[int, Queries], k: int, home: bool) -> DataFrame:
    """n, score, ids: the k best entries of every task for every query of the chunk."""
    shared = index.sparkSession.sparkContext.broadcast(groups)

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = scan(batches, shared.value, k, home)
        if best.parts:
            n, score, _, ids = best.settle()
            for a in range(0, len(n), 1 << 16):
                yield common.batch(n=n[a : a + (1 << 16)], score=score[a : a + (1 << 16)], ids=pa.array([np.frombuffer(x, "<i8") for x in ids[a : a + (1 << 16)]], pa.list_(pa.int64())))

    columns = ["dims", "wide", "pivot", "lo", "hi", "cover_lo", "cover_hi", "norm", "vecs", "ids", "each"]
    return index.select(*columns).mapInArrow(run, "n long, score long, ids array<long>")


def top_entries(index: DataFrame, queries: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame | None:
    """n, score, ids: entries among which are the k best of each query of the table; None without queries."""
    found = None
    width = queries.agg(F.max(F.length("vec"))).first()[0] or 0
    for rows in common.chunks(queries, width, CHUNK, CHUNK_BYTES):
        groups = {d: Queries([r for r in rows if r["dims"] == d], d, centres_of(pivots, d)) for d in {r["dims"] for r in rows}}
        best = Window.partitionBy("n").orderBy(F.desc("score"))
        near = passed(index, groups, k, True).withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("n", "score").toArrow()
        known = dict(zip(near["n"].to_pylist(), near["score"].to_pylist(), strict=True))
        for g in groups.values():
            g.threshold = np.array([known.get(n, -LARGEST - 1) for n in g.n.tolist()], np.int64)
        part = common.stored(passed(index, groups, k, False))
        found = part if found is None else found.unionByName(part)
    return found


def search(
    df: DataFrame, is_query: Column | None = None, k: int = 10, scale: int = 1024, pivots: int = PIVOTS, sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding", queries: DataFrame | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of `df` with the highest integer inner product for each query, ties to the smaller id.

    Queries are the rows of `queries`, else the rows of `df` for which `is_query`, a condition on the column vec_id, holds; a row of `df` is
    no candidate of its own. Vectors are compared with vectors of as many components alone. Vectors that are null or hold a null or
    non-finite component, and rows without an id, take no part. A query finds fewer than k rows where there are no more. Rows that repeat
    an id are rows of their own: each queries, and each but the query itself (one row of its id and vector) is a candidate. Scores that 64
    bits don't hold stand at their limit. Columns of other names are left out. An empty table, or one without queries, gives no rows.
    """
    if (is_query is None) == (queries is None):
        raise ValueError("give either queries or is_query")
    rows = common.stored(quantized(df, scale, id_col, vector_col))
    asked = common.stored(quantized(queries, scale, id_col, vector_col)) if queries is not None else rows.where(is_query)
    table = common.stored(asked.groupBy("vec", "dims", "wide").agg(F.first("norm").alias("norm")).withColumn("n", F.monotonically_increasing_id()))
    centres = fit_pivots(rows, sample, pivots)
    found = top_entries(build(rows, centres, k + 1), table, centres, k + 1)
    if found is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("n").orderBy(F.desc("score"), "vec_id")
    each = found.select("n", "score", F.explode("ids").alias("vec_id"))
    top = each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    lists = top.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits"))
    named = asked.select(F.col("vec_id").alias("query_id"), "vec", "square").join(table.select("vec", "n").join(lists, "n"), "vec")
    own = F.array_position(F.transform("hits", lambda h: (h["vec_id"] == F.col("query_id")) & (h["score"] == F.col("square"))), F.lit(True)) if queries is None else F.lit(0)
    others = F.slice(F.filter("hits", lambda h, i: i + 1 != own), 1, k)
    placed = named.select("query_id", F.posexplode(others).alias("place", "hit"))
    return placed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
