"""Isolation forest (Liu, Ting and Zhou 2008) fitted on a bounded sample and applied to every row.

Rows, split features and thresholds are drawn from MD5 digests of seed, tree, node and key, so a forest does not
depend on partitioning and any engine with that function can repeat it. A tree never
sees more than ``sample_per_tree`` rows, whatever the size of the input; only its nodes leave the
executors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

TREES = 100
SAMPLE_PER_TREE = 256
SEED = 42
_NODE_SCHEMA = "tree int, node int, feature int, threshold double, low int, high int, path double"


def average_path(n: int) -> float:
    """Expected depth of an unsuccessful search in a tree over ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def draw(seed: int, tree: int, node: int, what: str, digits: int) -> int:
    """Number made of the first hexadecimal digits of a digest."""
    return int(hashlib.md5(f"{seed}|{tree}|{node}|{what}".encode()).hexdigest()[:digits], 16)


def grow_tree(rows: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes of one tree; a leaf has feature -1 and carries its expected path length.

    The root is node 1, the children of node n are 2n and 2n + 1.
    """
    depth_limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes: list[tuple] = []
    open_nodes = [(1, rows, 0)]
    while open_nodes:
        node, part, depth = open_nodes.pop()
        smallest, largest = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(largest > smallest)
        if depth >= depth_limit or len(part) <= 1 or not len(varying):
            nodes.append((node, -1, 0.0, node, node, depth + average_path(len(part))))
            continue
        feature = int(varying[draw(seed, tree, node, "feature", 8) % len(varying)])
        share = draw(seed, tree, node, "threshold", 13) / float(1 << 52)
        threshold = float(smallest[feature]) + share * float(largest[feature] - smallest[feature])
        goes_low = part[:, feature] <= threshold
        low, high = 2 * node, 2 * node + 1
        nodes.append((node, feature, threshold, low, high, 0.0))
        open_nodes += [(low, part[goes_low], depth + 1), (high, part[~goes_low], depth + 1)]
    return nodes


Grids = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def score_rows(rows: np.ndarray, grids: Grids, sample_size: int, block: int = 4096) -> np.ndarray:
    """Anomaly score in (0, 1] per row; equal rows are walked through the trees once.

    ``grids`` are the feature, threshold, low child, high child and path arrays, of shape (tree, node).
    """
    feature_of, threshold_of, low_of, high_of, path_of = grids
    distinct, back = np.unique(rows, axis=0, return_inverse=True)
    trees = np.arange(len(feature_of))
    scores = np.empty(len(distinct))
    for start in range(0, len(distinct), block):
        part = distinct[start : start + block]
        index = np.arange(len(part))[:, None]
        node = np.ones((len(part), len(trees)), dtype=np.int64)
        while True:
            feature = feature_of[trees, node]
            if (feature < 0).all():
                break
            goes_low = part[index, feature] <= threshold_of[trees, node]
            node = np.where(goes_low, low_of[trees, node], high_of[trees, node])
        depth = path_of[trees, node].mean(axis=1)
        scores[start : start + block] = 2.0 ** (-depth / average_path(sample_size))
    return scores[back.reshape(-1)]


@dataclass
class Forest:
    """A fitted forest; ``grids`` as in ``score_rows``."""

    features: list[str]
    sample_size: int
    grids: Grids

    def with_score(self, df: DataFrame, column: str = "anomaly_score") -> DataFrame:
        """Add the score; only the feature columns travel to Python, in Arrow batches."""
        shared = df.sparkSession.sparkContext.broadcast((self.grids, self.sample_size))

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            grids, sample_size = shared.value
            for batch in batches:
                yield pd.Series(score_rows(np.column_stack([s.to_numpy(float) for s in batch]), grids, sample_size))

        return df.withColumn(column, score(*[F.col(f).cast("double") for f in self.features]))


def _drawn(complete: DataFrame, key: list[str], share: float, seed: int) -> DataFrame:
    """The rows whose hash is in the lower ``share`` of its range, with the hash as ``draw``."""
    drawn = complete.withColumn("draw", F.md5(F.concat_ws("|", F.lit(str(seed)), *key).cast("binary")))
    bound = format(min(int(share * 2**32), 2**32 - 1), "08x")
    return drawn.filter(F.col("draw") < F.lit(bound)) if share < 1.0 else drawn


def _tree_samples(
    df: DataFrame, features: list[str], key: list[str], trees: int, per_tree: int, seed: int
) -> DataFrame:
    """``tree, place, features``: up to ``per_tree`` rows per tree without replacement, from the complete rows.

    Rows are put in the order of a hash of their key, and the trees take consecutive stretches of the
    first ``trees * per_tree`` of them, starting over when there are fewer. A bound on the hash keeps about
    twice that many of the complete rows, so no more than that ever reaches the sort; should the bound hold
    back too many, it is widened.
    """
    wanted = trees * per_tree
    complete = df.select(*key, *[F.col(f).cast("double") for f in features]).dropna(subset=features)
    share = min(1.0, 2.0 * wanted / max(complete.count(), 1))
    while share < 1.0 and _drawn(complete, key, share, seed).limit(wanted).count() < wanted:
        share = min(1.0, 2.0 * share)
    first = _drawn(complete, key, share, seed).orderBy("draw", *key).limit(wanted)
    # At most ``wanted`` rows are left, so one task can number them.
    everything = Window.partitionBy(F.lit(0))
    numbered = first.withColumns(
        {"n": F.count(F.lit(1)).over(everything), "r": F.row_number().over(everything.orderBy("draw", *key)) - 1}
    )
    slots = F.explode(F.sequence(F.col("r").cast("long"), F.lit(wanted - 1).cast("long"), F.col("n")))
    placed = numbered.withColumn("slot", slots).withColumns(
        {
            "tree": F.floor(F.col("slot") / per_tree).cast("int"),
            "place": (F.col("slot") % per_tree).cast("int"),
        }
    )
    return placed.filter(F.col("place") < F.col("n")).select("tree", "place", *features)


def fit_forest(
    df: DataFrame, features: list[str], key: list[str], trees: int = TREES, sample_per_tree: int = SAMPLE_PER_TREE, seed: int = SEED
) -> Forest:
    """Grow the forest; rows with a NULL feature are not used. Trees grow in tasks, one group of at most
    ``sample_per_tree`` rows each (256 in the published algorithm); their nodes are all that reaches the driver.

    ``key`` must be unique.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values("place")[features].to_numpy(float)
        nodes = grow_tree(rows, seed, tree)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "low", "high", "path"])
        out.insert(0, "tree", tree)
        out["rows"] = len(rows)
        return out

    samples = _tree_samples(df, features, key, trees, sample_per_tree, seed)
    nodes = samples.groupBy("tree").applyInPandas(grow, _NODE_SCHEMA + ", rows int").toPandas()
    if nodes.empty:
        raise ValueError("At least one complete numeric feature row is required.")
    shape = (trees, int(nodes["node"].max()) + 1)

    def grid(column: str, dtype) -> np.ndarray:
        out = np.zeros(shape, dtype=dtype)
        out[nodes["tree"], nodes["node"]] = nodes[column]
        return out

    grids = (
        grid("feature", np.int64), grid("threshold", float), grid("low", np.int64), grid("high", np.int64),
        grid("path", float),
    )
    return Forest(list(features), int(nodes["rows"].iloc[0]), grids)
