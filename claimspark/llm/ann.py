"""Nearest neighbours in a forest of hash prefixes.

Every tree gives a vector a long string of bits: on which side of random planes it lies. A tree is the sorted array of its
strings, cut into stretches of some thousand neighbours by their first bits, and the vectors under a prefix are a range of
it. A query descends to the place of its own string in a few trees, where the longest common prefixes are, and then ascends in
all trees at once. How far follows from what it has found: two vectors at an angle share a bit with a known chance, so with
its ``k``-th best score so far a query knows at which depth a better vector would be missed by all trees with
a chance below ``miss``. It ascends twice: first with a high chance, which makes the ``k``-th best score a good bound, then
with the wanted one. Among clusters it stops deep with few candidates; where vectors lie anywhere it must climb, and
no count or share of the table is given. Vectors are dealt into bands of about equal norm, as the largest inner
product is the smallest angle only among those; bands that cannot reach the bound are not visited.
Stretches hold vectors in half precision, whose error is bounded: they only discard what cannot be among the best,
the rest is scored on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.llm.common import bucketed
from claimspark.session import materialise

TREES = 64
BITS = 48  # of a string
MISS = 0.08  # chance that a tree for tree search misses one of the k nearest
FIRST_MISS = 0.6  # of the first ascent
FIRST_TREES = 8  # of the descent
NEAR = 8  # neighbours in the sorted array, each way
BAND_RATIO = 1.1  # between the longest and the shortest norm of a band
BANDS = 64  # the last one holds all that is shorter
BLOCK_ROWS = 4096
BLOCK_QUERIES = 65_536
SCORE_CELLS = 1 << 20  # scores a task holds at once
INDEX_PIECES = 4  # files of the index for each shuffle partition; a task reads one, with all its stretches

FOUND = "row long, entry long, low double, high double"


def _number(df: DataFrame, column: str) -> np.dtype:
    """Type in which the components of a vector column are kept."""
    return np.dtype(np.float32 if df.schema[column].dataType.elementType.typeName() == "float" else np.float64)


def usable(vectors: DataFrame, id_col: str, vector_col: str, kind: np.dtype) -> DataFrame:
    """``id, v, norm`` of the rows that take part: not NULL, finite, not zero; ``v`` as bytes, ``norm`` as its logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells, norms = [], [], []
            for key, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = cell.values
                if key is None or values is None or not len(values) or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False).astype(kind) + 0  # the two zeros are one
                largest = float(np.abs(v).max())
                if 0 < largest < np.inf:
                    ids.append(key)
                    cells.append(v.astype(kind).tobytes())
                    norms.append(float(np.log(largest) + np.log(np.linalg.norm(v.astype(np.float64) / largest))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cells, pa.binary()), pa.array(norms, pa.float64())], ["id", "v", "norm"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(run, "id long, v binary, norm double")


def _norms(v: np.ndarray) -> np.ndarray:
    largest = np.abs(v).max(axis=1)
    return largest * np.linalg.norm(v / largest[:, None], axis=1)


class Planes:
    """Random planes of all trees; the same for the same seed."""

    def __init__(self, size: int, trees: int, bits: int, seed: int):
        self.trees, self.bits = trees, bits
        self.normals = np.random.default_rng(seed).normal(size=(size + 1, trees * bits))
        self.weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def strings(self, points: np.ndarray) -> np.ndarray:
        """Bit strings by point and tree, as whole numbers that sort like them."""
        out = np.empty((len(points), self.trees), np.int64)
        for a in range(0, len(points), 512):
            sides = (points[a : a + 512] @ self.normals > 0).reshape(-1, self.trees, self.bits)
            out[a : a + 512] = sides @ self.weights
        return out


def row_points(v: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Rows on the unit sphere: one more component brings them to the longest norm of their band."""
    norms = _norms(v)
    rest = np.sqrt(np.maximum(0.0, 1 - (norms / longest) ** 2))
    rest[rest <= 1e-3] = 0  # rounding
    return np.c_[v / longest[:, None], rest]


def query_points(v: np.ndarray) -> np.ndarray:
    return np.c_[v / _norms(v)[:, None], np.zeros(len(v))]


def ascent(cosine: np.ndarray, trees: int, bits: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """``depth, deep``: the first ``deep`` trees are entered at ``depth``, the others one bit below it.

    That is the deepest place where a vector at that cosine of the query is missed by all trees with a chance of at most ``miss``. Depth 0
    is the root, in one tree as it holds all; also where the prefixes of all trees would hold more rows than that.
    """
    share = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    with np.errstate(divide="ignore", invalid="ignore"):
        missed = np.log1p(-(share[:, None] ** np.arange(bits + 1)))  # by one tree at each depth
        missed = np.c_[missed, np.zeros(len(share))]
        depth = bits - np.argmax((trees * missed[:, bits::-1] <= np.log(miss)), axis=1)
        at, below = missed[np.arange(len(share)), depth], missed[np.arange(len(share)), depth + 1]
        needed = np.where(np.isinf(at), 1, np.ceil((np.log(miss) - trees * below) / (at - below)))
    needed = np.clip(needed, 1, trees).astype(int)
    work = needed * 0.5**depth + np.where(depth < bits, trees - needed, 0) * 0.5 ** (depth + 1.0)
    root = (work >= 1) | (depth == 0)
    return np.where(root, 0, depth), np.where(root, 1, needed)


def _matrix(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """Binary cells of one length as a matrix."""
    cells = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    offsets = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    size = np.dtype(kind).itemsize
    return np.frombuffer(cells.buffers()[2], kind, (offsets[-1] - offsets[0]) // size, offsets[0]).reshape(len(cells), -1)


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


STRETCH = "cell long, tree int, codes binary, entries binary, only binary, single binary, half binary"


def sort_stretch(strings: pa.Table) -> pa.Table:
    """One row: the strings of a stretch in order, and in the same order what belongs to them."""
    codes = strings["code"].to_numpy()
    order = np.argsort(codes, kind="stable")
    only = strings["only"].combine_chunks()
    parts = [
        codes[order], strings["entry"].to_numpy()[order], only.fill_null(0).to_numpy()[order],
        only.is_valid().to_numpy(zero_copy_only=False)[order], _matrix(strings["half"], np.float16)[order],
    ]
    first = strings.slice(0, 1)
    return pa.table([first["cell"], first["tree"], *[pa.array([part.tobytes()], pa.binary()) for part in parts]], names=[c.split()[0] for c in STRETCH.split(", ")])


def search_stretch(stretch: pa.Table, visits: pa.Table, k: int, bits: int, error: float) -> pa.Table:
    """What the queries that visit a stretch find in their ranges of it, without what cannot be among the ``k`` best."""
    schema = pa.schema([("row", pa.int64()), ("entry", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])
    if not len(stretch) or not len(visits):
        return schema.empty_table()
    code, entry, only, is_single = (
        np.frombuffer(stretch[c][0].as_buffer(), kind) for c, kind in (("codes", np.int64), ("entries", np.int64), ("only", np.int64), ("single", bool))
    )
    half = np.frombuffer(stretch["half"][0].as_buffer(), np.float16).reshape(len(code), -1).astype(np.float32)
    asked, ids, bound = (visits[c].to_numpy() for c in ("row", "id", "bound"))
    unit, own = _matrix(visits["unit"], np.float32), visits["code"].to_numpy()
    depth, longest = visits["depth"].to_numpy().astype(np.int64), float(visits["longest"][0].as_py())
    at, prefix = np.searchsorted(code, own), own >> np.maximum(bits - depth, 0)
    descent = depth < 0
    low = np.where(descent, np.maximum(at - NEAR, 0), np.searchsorted(code, prefix << np.maximum(bits - depth, 0)))
    high = np.where(descent, np.minimum(at + NEAR, len(code)), np.searchsorted(code, (prefix + 1) << np.maximum(bits - depth, 0)))
    least = bound / longest - error

    turns = np.lexsort((high, low))
    edges = np.flatnonzero(np.r_[True, (np.diff(low[turns]) != 0) | (np.diff(high[turns]) != 0), True])
    found = []
    for a, b in zip(edges[:-1], edges[1:]):
        l, h = low[turns[a]], high[turns[a]]
        if l >= h:
            continue
        step = max(1, SCORE_CELLS // int(h - l))
        for start in range(a, b, step):
            group = turns[start : min(b, start + step)]
            scores = (unit[group] @ half[l:h].T).astype(np.float64)
            scores[is_single[None, l:h] & (only[None, l:h] == ids[group, None])] = -np.inf
            floor = least[group]
            if h - l > k:
                floor = np.maximum(floor, np.partition(scores, h - l - k, axis=1)[:, h - l - k] - 2 * error)
            q, e = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
            found.append((asked[group[q]], entry[l + e], scores[q, e]))
    if not found:
        return schema.empty_table()
    rows, entries, scores = (np.concatenate(part) for part in zip(*found))
    return pa.table([rows, entries, (scores - error) * longest, (scores + error) * longest], schema=schema)


class Forest:
    """The sorted arrays of all trees over the distinct vectors of ``vectors``."""

    def __init__(self, vectors: DataFrame, k: int, id_col: str, vector_col: str, trees: int, bits: int, seed: int, block_rows: int):
        self.k, self.trees, self.bits, self.seed, self.block_rows = k, trees, bits, seed, block_rows
        self.kind = _number(vectors, vector_col)
        rows = materialise(usable(vectors, id_col, vector_col, self.kind), "ann-rows")
        usual = rows.groupBy(F.length("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).first()
        self.size = usual["n"] // self.kind.itemsize if usual else 0
        rows = self.sized(rows)
        # Of equal vectors the k + 1 smallest ids can be among the k best of a query that has one of them itself.
        place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
        first = rows.distinct().withColumn("place", place).filter(F.col("place") <= k + 1)
        entries = first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("norm").alias("norm"))
        self.entries = materialise(entries.select("*", F.monotonically_increasing_id().alias("entry")), "ann-entries")
        top = self.entries.agg(F.max("norm")).first()[0] or 0.0
        band = F.least(F.lit(BANDS), F.floor((F.lit(top) - F.col("norm")) / float(np.log(BAND_RATIO)) + 0.5)).cast("int")
        dealt = self.entries.withColumn("band", band)
        # At most BANDS + 1 rows: a band's longest norm, and how many first bits make a stretch of it.
        found = dealt.groupBy("band").agg(F.count("*").alias("rows"), F.exp(F.max("norm")).alias("longest")).collect()
        cut = {r["band"]: min(bits, max(0, int(np.ceil(np.log2(r["rows"] / block_rows))))) for r in found}
        self.bands = [(r["band"], r["longest"], cut[r["band"]]) for r in sorted(found, key=lambda r: r["band"])]
        self.error = 2**-11 + self.size**0.5 * 2**-25 + self.size * 2**-23  # of a score in half precision, over the norms
        self._store(dealt)

    def sized(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.length("v") == self.size * self.kind.itemsize)

    def _store(self, dealt: DataFrame) -> None:
        size, trees, bits, seed, kind = self.size, self.trees, self.bits, self.seed, self.kind
        longest, cut = {b: m for b, m, _ in self.bands}, {b: c for b, _, c in self.bands}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = Planes(size, trees, bits, seed)
            for batch in batches:
                if not len(batch):
                    continue
                bands, v = batch.column(1).to_pylist(), _matrix(batch.column(3), kind).astype(np.float64)
                points = row_points(v, np.array([longest[b] for b in bands]))
                codes = pa.array(list(planes.strings(points)), pa.list_(pa.int64()))
                halves = _binary(points[:, :-1].astype(np.float16))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([cut[b] for b in bands], pa.int32()), batch.column(2), halves, codes],
                    ["entry", "band", "cut", "only", "half", "codes"],
                )

        only = F.when(F.size("ids") == 1, F.element_at("ids", 1)).alias("only")
        schema = "entry long, band int, cut int, only long, half binary, codes array<long>"
        hashed = materialise(dealt.select("entry", "band", only, "v").mapInArrow(run, schema), "ann-strings")
        stretch = F.expr(f"shiftright(code, {bits} - cut)").alias("stretch")
        strings = hashed.select("entry", "band", "cut", "only", "half", F.posexplode("codes").alias("tree", "code"))
        strings = strings.select("*", stretch)
        # Stretches that their first bits leave too long, as vectors crowd there, are dealt into blocks.
        counts = hashed.select("band", "cut", F.posexplode("codes").alias("tree", "code")).select("band", "tree", stretch)
        counts = counts.groupBy("band", "tree", "stretch").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * self.block_rows)
        self.crowded = materialise(counts.select("band", "tree", "stretch", F.ceil(F.col("rows") / self.block_rows).cast("int").alias("blocks")), "ann-crowded")
        strings = strings.join(self.crowded, ["band", "tree", "stretch"], "left")
        block = F.coalesce(F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"), F.lit(0)).alias("block")
        strings = strings.select("*", block).select(self._cell(), "tree", "code", "entry", "only", "half")
        self.index = bucketed(strings.groupBy("cell").applyInArrow(sort_stretch, STRETCH), "ann-index", "cell", dealt=True, pieces=INDEX_PIECES)

    @staticmethod
    def _cell() -> Column:
        return F.xxhash64("band", "tree", "stretch", "block").alias("cell")

    def hashed(self, asked: DataFrame) -> DataFrame:
        """``row, id, unit, codes`` of the queries ``row, id, v``."""
        size, trees, bits, seed, kind = self.size, self.trees, self.bits, self.seed, self.kind

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes = Planes(size, trees, bits, seed)
            for batch in batches:
                if not len(batch):
                    continue
                points = query_points(_matrix(batch.column(2), kind).astype(np.float64))
                codes = pa.array(list(planes.strings(points)), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), _binary(points[:, :-1].astype(np.float32)), codes], ["row", "id", "unit", "codes"]
                )

        return asked.select("row", "id", "v").mapInArrow(run, "row long, id long, unit binary, codes array<long>")

    def visits(self, asked: DataFrame, miss: float | None, only_trees: int | None = None) -> DataFrame:
        """Where the queries ``row, id, unit, codes, bound`` go: one row per tree and band, without ``miss`` for the descent."""
        bands, trees, bits = self.bands, self.trees, self.bits
        step = max(1, 16_384 // (trees * max(1, len(bands))))

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, len(batch), step):
                    part = batch.slice(start, step)
                    codes = np.array(part.column(3).flatten(), np.int64).reshape(len(part), -1)
                    bound = np.array(part.column(4).fill_null(-np.inf), np.float64)
                    for band, longest, cut in bands:
                        reach = np.flatnonzero(bound <= longest * (1 + 1e-9))
                        if miss is None:
                            depths = np.full((len(reach), trees), -1)
                            use = np.broadcast_to(np.arange(trees) < only_trees, depths.shape)
                        else:
                            depth, deep = ascent(bound[reach] / longest, trees, bits, miss)
                            first = np.arange(trees) < deep[:, None]
                            depths = np.where(first, depth[:, None], depth[:, None] + 1)
                            use = first | ((depth[:, None] > 0) & (depths <= bits))
                        q, tree = np.nonzero(use)
                        taken = part.take(pa.array(reach[q]))
                        yield pa.RecordBatch.from_arrays(
                            [
                                taken.column(0), taken.column(1), taken.column(2), pa.array(bound[reach[q]]), pa.array(np.full(len(q), band, np.int32)),
                                pa.array(np.full(len(q), longest)), pa.array(np.full(len(q), cut, np.int32)), pa.array(tree.astype(np.int32)),
                                pa.array(codes[reach[q], tree]), pa.array(depths[q, tree].astype(np.int32)),
                            ],
                            ["row", "id", "unit", "bound", "band", "longest", "cut", "tree", "code", "depth"],
                        )

        schema = "row long, id long, unit binary, bound double, band int, longest double, cut int, tree int, code long, depth int"
        places = asked.select("row", "id", "unit", "codes", "bound").mapInArrow(plan, schema)
        # A prefix shorter than those of the stretches covers several of them.
        short = F.when(F.col("depth") >= 0, F.greatest(F.col("cut") - F.col("depth"), F.lit(0))).otherwise(F.lit(0))
        many = F.expr("shiftleft(1L, short)")
        start = F.expr(f"shiftleft(shiftright(code, {bits} - cut + short), short)")
        places = places.withColumn("short", short).withColumn("stretch", F.explode(F.sequence(start, start + many - 1)))
        places = places.join(self.crowded, ["band", "tree", "stretch"], "left")
        places = places.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
        return places.select(self._cell(), "row", "id", "unit", "bound", "longest", "code", "depth")

    def search(self, visits: DataFrame, only_trees: int | None = None) -> DataFrame:
        """``row, entry, low, high``: bounds of the scores of what may be among the best of a query, over its norm."""
        index = self.index if only_trees is None else self.index.filter(F.col("tree") < only_trees)
        k, bits, error = self.k, self.bits, self.error

        def run(stretch: pa.Table, asked: pa.Table) -> pa.Table:
            return search_stretch(stretch, asked, k, bits, error)

        visits = materialise(visits, "ann-visits")
        busiest = visits.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        turns = max(1, -(-busiest // BLOCK_QUERIES))  # more than one only where very many queries crowd
        found = []
        for turn in range(turns):
            own = visits.filter(F.pmod(F.xxhash64("row"), F.lit(turns)) == turn)
            found.append(index.groupBy("cell").cogroup(own.groupBy("cell")).applyInArrow(run, FOUND))
        out = found[0]
        for part in found[1:]:
            out = out.unionByName(part)
        return _best(out)


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("row", "entry").agg(F.max("low").alias("low"), F.max("high").alias("high"))


def _bounds(found: DataFrame, k: int) -> DataFrame:
    """``row, bound``: the ``k``-th best score that a query has for sure."""
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("low")))
    best = found.withColumn("place", place).filter(F.col("place") <= k)
    return best.groupBy("row").agg(F.count("*").alias("n"), F.min("low").alias("bound")).filter(F.col("n") == k).select("row", "bound")


def scores(pairs: DataFrame, kind: np.dtype) -> DataFrame:
    """``query_id, ids, score`` of ``query_id, ids, v, other``: double products, summed for each pair in the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v, other = (_matrix(batch.column(i), kind).astype(np.float64) for i in (2, 3))
                with np.errstate(over="ignore", invalid="ignore"):
                    sums = (v * other).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums)], ["query_id", "ids", "score"])

    return pairs.mapInArrow(run, "query_id long, ids array<long>, score double")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES,
    bits: int = BITS, miss: float = MISS, seed: int = 1, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` nearest of each query by inner product, ties to the smaller id.

    Each of the true ``k`` nearest is among them with a chance of at least ``1 - miss``, whatever the data; queries with fewer than ``k``
    candidates meet them all. Vectors that are NULL, zero or have NULL or non-finite components, and those whose length is not the most
    frequent one, take no part; neither do rows with NULL ids. A query does not meet rows with its own id. Of rows that
    repeat an id the best counts. Scores are sums of double products of the original vectors, taken for each pair in the same way, so
    equal vectors tie; a sum that is not a number ranks last. Other columns are ignored; an empty table gives an empty
    result. All rows are indexed; nothing is fitted to a sample.
    """
    forest = Forest(vectors, k, id_col, vector_col, trees, bits, seed, block_rows)
    asked = forest.sized(usable(queries, id_col, vector_col, forest.kind)).select("id", "v").distinct()
    asked = materialise(asked.select("*", F.monotonically_increasing_id().alias("row")), "ann-queries")
    hashed = materialise(forest.hashed(asked), "ann-query-strings")
    found, bound = None, hashed.select("row", F.lit(None).cast("double").alias("bound")).limit(0)
    for chance in (None, FIRST_MISS, miss):
        few = min(trees, FIRST_TREES) if chance is None else None
        new = forest.search(forest.visits(hashed.join(bound, "row", "left"), chance, few), few)
        found = materialise(new if found is None else _best(found.unionByName(new)), "ann-found")
        bound = _bounds(found, k)
    pairs = found.join(bound, "row", "left").filter("bound is null or high >= bound").select("row", "entry")
    pairs = pairs.join(forest.entries.select("entry", F.col("v").alias("other"), "ids"), "entry")
    pairs = pairs.join(asked.select("row", F.col("id").alias("query_id"), "v"), "row")
    scored = scores(pairs.select("query_id", "ids", "v", "other"), forest.kind).select("query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    best = scored.groupBy("query_id", "vec_id").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("ranked"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("ranked"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.coalesce("ranked", "score").alias("score"))
