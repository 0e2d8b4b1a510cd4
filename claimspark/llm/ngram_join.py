"""Jaccard join of n-gram sets on prefix trees.

1. Blocks of documents ask how often each of their n-grams occurs in all documents (see ``blocks``). The common
   order of n-grams is: rarer ones (by powers of two) first, then by hash.
2. A link needs a common n-gram among the first ``n - ceil(threshold n) + 1`` of either set. Documents whose first
   n-grams all occur once have no link and go no further. Equal sets become one node.
3. Nodes that share such an n-gram and are of similar size form clusters: connected components over stars, never
   pairs. A link cannot leave its cluster.
4. Every cluster is joined in tasks. The ordered sets go into a trie; a set descends it with the overlap so far,
   shared by all sets below, and leaves a subtree when the remaining lengths cannot reach the threshold. Sets
   already connected are not compared again. A large cluster is dealt to pairs of its parts.
5. Components over the links give the class of each document.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimspark.llm.blocks import BLOCK_BYTES, MESSAGES, NO_ID, answered, ask, chunks, graded, in_blocks, mixed, unpacked
from claimspark.llm.common import give_back, partitions
from claimspark.llm.components import connected_components
from claimspark.session import materialise

PART_SETS = 4096  # sets of a cluster that one task holds on either side
LEAST_PART = 32
SALTS = 16

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word in ``data`` and its hash, ASCII letters lower-cased."""
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    word = np.cumsum(~space & np.r_[True, space[:-1]]) - 1
    place = np.arange(len(data)) - starts[np.maximum(word, 0)]
    place[space] = 0
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    values = _BYTE[_LOWER[data]] * powers[place]
    values[space] = 0
    return starts, mixed(np.add.reduceat(values, starts))


def ngram_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; fewer words form one sequence."""
    sets: list[np.ndarray] = []
    for first, last in chunks(texts):
        part = texts[first:last]
        starts, words = _words(np.frombuffer(b" ".join(part) + b" ", np.uint8))
        ends = np.cumsum([len(t) + 1 for t in part])
        bounds = np.r_[0, np.searchsorted(starts, ends)]
        grams = words[: max(0, len(words) - width + 1)].copy()
        for i in range(1, width):
            grams = grams * _NEXT + words[i : i + len(grams)]
        grams = mixed(grams)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= width:
                sets.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = np.uint64((int(whole) * int(_NEXT) + int(w)) % 2**64)
                sets.append(mixed(np.array([whole])))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def _key(h: np.ndarray) -> bytes:
    """128-bit name of a set."""
    return int(mixed(h).sum(dtype=np.uint64)).to_bytes(8, "big") + int(mixed(h + _BASE).sum(dtype=np.uint64)).to_bytes(8, "big")


_SETS = "doc_id long, n int, node binary, first array<long>, ordered binary"
_SETS_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int32()), ("node", pa.binary()), ("first", pa.list_(pa.int64())), ("ordered", pa.binary()),
])


def ordered_sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, block_bytes: int) -> DataFrame:
    """Per document the size of its set; for those that may have links also node, first n-grams and ordered set."""
    texts, _, bits = in_blocks(docs, id_col, text_col, block_bytes)

    def send(rows: pa.Table) -> pa.Table:
        sets = ngram_sets(unpacked(rows)[1], width)
        return ask(rows["block"][0].as_py(), np.sort(np.concatenate(sets)), bits)

    def order(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(rows):
            return _SETS_SCHEMA.empty_table()
        ids, parts = unpacked(rows)
        sets = ngram_sets(parts, width)
        every = np.concatenate(sets)
        sort = np.argsort(every, kind="stable")
        answers = dict(zip(replies["part"].to_pylist(), replies["payload"].to_pylist()))
        grade = np.empty(len(every), np.uint8)
        grade[sort] = graded(every[sort], bits, answers, True)
        out: dict[str, list] = defaultdict(list)
        at = 0
        for h in sets:
            g = grade[at : at + len(h)]
            at += len(h)
            n = len(h)
            out["n"].append(n)
            turn = np.lexsort((h, g))[: n - (n * percent + 99) // 100 + 1] if n else np.zeros(0, np.int64)
            shared = turn[g[turn] > 0]
            if len(shared):
                out["node"].append(_key(h))
                out["first"].append(h[shared].view(np.int64))
                out["ordered"].append(h[np.lexsort((h, g))].tobytes())
            else:
                for name in ("node", "first", "ordered"):
                    out[name].append(None)
        columns = [pa.array([None if i == NO_ID else i for i in ids], pa.int64()), *(pa.array(out[f.name], f.type) for f in list(_SETS_SCHEMA)[1:])]
        return pa.table(columns, schema=_SETS_SCHEMA)

    messages = texts.groupBy("block").applyInArrow(send, MESSAGES)
    replies = answered(messages, lambda counts: np.minimum(np.log2(counts).astype(np.int64), 15), True)
    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(order, _SETS)


class SetTrie:
    """Path-compressed trie of ordered token sequences, searched with overlap bounds.

    ``flat`` holds the tokens of all sets one after another, numbered from 0 to ``n_tokens``; ``bounds`` their ends.
    """

    STEP = 48  # tokens of an edge taken before the bounds are looked at again

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, members: np.ndarray, n_tokens: int):
        self.flat, self.seen = flat, np.zeros(n_tokens, np.int32)
        size = np.diff(bounds)
        members = np.array(sorted(members.tolist(), key=lambda m: flat[bounds[m] : bounds[m + 1]].astype(">u4").tobytes()), np.int64)
        nodes: list[list] = []  # start and end in flat, depth at the start, sets that end here, children
        path: list[tuple[int, int]] = []  # depth at the end, node
        roots: list[int] = []
        for i, m in enumerate(members.tolist()):
            common = 0
            if i:
                p = members[i - 1]
                k = min(size[p], size[m])
                same = flat[bounds[p] : bounds[p] + k] == flat[bounds[m] : bounds[m] + k]
                common = int(k if same.all() else same.argmin())
            last = None
            while path and path[-1][0] > common:
                last = path.pop()
            if last is not None and (path[-1][0] if path else 0) < common:  # split the edge at the common depth
                start, end, depth, own, children = nodes[last[1]]
                cut = start + common - depth
                nodes[last[1]] = [start, cut, depth, [], [len(nodes)]]
                nodes.append([cut, end, common, own, children])
                path.append((common, last[1]))
            if common == size[m] and path:
                nodes[path[-1][1]][3].append(m)
                continue
            (nodes[path[-1][1]][4] if path else roots).append(len(nodes))
            path.append((int(size[m]), len(nodes)))
            nodes.append([int(bounds[m]) + common, int(bounds[m + 1]), common, [m], []])
        count = len(nodes)
        self.start, self.end, self.depth = (np.array([x[i] for x in nodes], np.int64) for i in range(3))
        self.own, self.children = [x[3] for x in nodes], [x[4] for x in nodes]
        self.roots = np.array(roots, np.int64)
        self.least, self.most = np.full(count, 1 << 30), np.zeros(count, np.int64)
        self.alone = np.full(count, -1)  # the set, if only one lies at or below
        for i in sorted(range(count), key=lambda i: -self.depth[i]):
            sizes = [size[m] for m in self.own[i]]
            self.least[i] = min([*sizes, *(self.least[c] for c in self.children[i])])
            self.most[i] = max([*sizes, *(self.most[c] for c in self.children[i])])
            if len(self.own[i]) == 1 and not self.children[i]:
                self.alone[i] = self.own[i][0]

    def links(self, probe: np.ndarray, percent: int, wanted: np.ndarray) -> list[int]:
        """Sets in the trie that link with ``probe``; ``wanted`` (by set) may leave out single sets."""
        n, found = len(probe), []
        self.seen[probe] = np.arange(1, n + 1)
        nodes = self.roots
        overlap, passed = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        while len(nodes):
            at = self.start[nodes].copy()
            live = self._possible(nodes, overlap, passed, self.depth[nodes], n, percent)
            live &= (self.alone[nodes] < 0) | wanted[self.alone[nodes]]
            nodes, overlap, passed, at = nodes[live], overlap[live], passed[live], at[live]
            ended: list[tuple] = []
            while len(nodes):
                steps = np.minimum(self.end[nodes] - at, self.STEP)
                offsets = np.cumsum(steps) - steps
                places = self.seen[self.flat[np.repeat(at - offsets, steps) + np.arange(steps.sum())]]
                overlap = overlap + np.add.reduceat((places > 0).astype(np.int64), offsets)
                passed = np.maximum(passed, np.maximum.reduceat(places, offsets))
                at = at + steps
                done = at == self.end[nodes]
                ended.append((nodes[done], overlap[done], passed[done]))
                live = ~done
                live[live] = self._possible(nodes[live], overlap[live], passed[live], (self.depth[nodes] + at - self.start[nodes])[live], n, percent)
                nodes, overlap, passed, at = nodes[live], overlap[live], passed[live], at[live]
            below: list[tuple[int, int, int]] = []
            for some in ended:
                for i, o, p in zip(*(x.tolist() for x in some)):
                    for m in self.own[i]:
                        total = self.end[i] - self.start[i] + self.depth[i]
                        if wanted[m] and 100 * o >= percent * (n + total - o):
                            found.append(m)
                    below += [(c, o, p) for c in self.children[i]]
            nodes, overlap, passed = (np.array([x[j] for x in below], np.int64) for j in range(3))
        self.seen[probe] = 0
        return found

    def _possible(self, nodes, overlap, passed, depth, n: int, percent: int) -> np.ndarray:
        """Whether some set below can still link: by the sizes, and by what is left of both sets."""
        least, most = self.least[nodes], self.most[nodes]
        reach = overlap + np.minimum(most - depth, n - passed)
        fits = (100 * most >= percent * n) & (percent * least <= 100 * n)
        return fits & ((100 + percent) * reach >= percent * (n + np.maximum(least, -(-percent * n // 100))))


def trie_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect. With two sides, only links between sides are looked for."""
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.r_[0, np.cumsum([len(s) for s in sets])]
    two = bool(side.any() and not side.all())
    trie = SetTrie(flat, bounds, np.flatnonzero(side == 0) if two else np.arange(len(sets)), int(flat.max()) + 1)
    label, links = np.arange(len(sets)), []
    for y in np.flatnonzero(side == 1).tolist() if two else range(len(sets)):
        wanted = label != label[y]
        if not two:
            wanted[y:] = False
        for x in trie.links(flat[bounds[y] : bounds[y + 1]], percent, wanted):
            if label[x] != label[y]:
                links.append((x, y))
                label[label == label[x]] = label[y]
    return links


_LINKS = "a binary, b binary"
_LINKS_SCHEMA = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def cluster_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` inside clusters; ``members`` has ``node, ordered, cluster, parts``.

    A cluster of several parts is joined part by part and between each two parts.
    """
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = members.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(
        "node", "ordered", "cluster", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"),
        (F.col("part") > F.col("other")).alias("is_high"), "parts",
    )
    small = F.pmod(F.xxhash64("cluster"), F.lit(8 * partitions(members.sparkSession)))
    rows = rows.withColumn("task", F.when(F.col("parts") == 1, small).otherwise(F.xxhash64("cluster", "low", "high")))

    def join(rows: pa.Table) -> pa.Table:
        groups: dict[tuple, list[int]] = defaultdict(list)
        keys = zip(rows["cluster"].to_pylist(), rows["low"].to_pylist(), rows["high"].to_pylist())
        for i, key in enumerate(keys):
            groups[key].append(i)
        nodes, high = rows["node"].to_pylist(), np.array(rows["is_high"].to_pylist(), bool)
        a, b = [], []
        for own in groups.values():
            sets = [np.frombuffer(rows["ordered"][i].as_py(), np.uint64) for i in own]
            for x, y in trie_links(sets, high[own].astype(int), percent):
                a.append(nodes[own[x]])
                b.append(nodes[own[y]])
        del groups
        give_back()
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_LINKS_SCHEMA)

    return rows.groupBy("task").applyInArrow(join, _LINKS)


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
    block_bytes: int = BLOCK_BYTES, part_sets: int = PART_SETS,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Two rows link when 100 x intersection >= ``percent`` x union of their sets. A text with fewer words than
    ``width`` has one n-gram, its whole sequence; a NULL text or one without words has none and links with nothing.
    ``component_id`` is the smallest id reached by links, NULL ids aside, else the row's own id. Repeated rows and
    rows that share an id are documents of their own. N-grams are compared by 64-bit hashes. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sets = materialise(ordered_sets(docs, id_col, text_col, width, percent, block_bytes), "ngram-sets")
    nodes = materialise(sets.filter("node is not null").select("node", "n", "first", "ordered").dropDuplicates(["node"]), "ngram-nodes")
    # Sizes within 5 : 4 fall into the same or neighbouring classes, so they share one of the two groups.
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.26 if percent >= 80 else 101 / percent))))
    posts = nodes.select("node", F.explode("first").alias("gram"), size.alias("size"))
    posts = posts.select("node", "gram", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"))
    posts = posts.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    hubs = posts.groupBy("gram", "size", "salt").agg(F.min("node").alias("hub"))
    tops = hubs.groupBy("gram", "size").agg(F.min("hub").alias("top"), F.count("*").alias("hubs"))
    edges = posts.join(hubs, ["gram", "size", "salt"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    edges = edges.unionByName(hubs.join(tops.filter("hubs > 1"), ["gram", "size"]).select(F.col("hub").alias("a"), F.col("top").alias("b")))
    clusters = connected_components(edges.filter("a <> b"))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("members"))
    tasks = float(2 * np.sqrt(partitions(spark)))
    parts = F.greatest(F.ceil(F.col("members") / part_sets), F.least(F.ceil(F.col("members") / LEAST_PART), F.lit(int(tasks))))
    members = clusters.join(sizes.select("root", parts.cast("int").alias("parts")), "root").withColumnRenamed("root", "cluster")
    links = cluster_links(nodes.select("node", "ordered").join(members, "node"), percent)
    joined = connected_components(links)
    # Smallest id of each node, then of each component.
    ids = sets.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least_id"))
    ids = ids.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labels = ids.join(least, "root").select("node", "component_id")
    return sets.select("doc_id", "n", "node").join(labels, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest id, NULL ids last.

    Rows are told apart by their place in a written copy, whatever their ids: repeated rows are copies of one another and one stays, rows that share
    an id but no text all stay, as do rows without words. Of equal ids the first row in that copy stays. All columns pass
    through but one named ``ngram row``; an empty table gives an empty result.
    """
    rows = materialise(docs.withColumn("ngram row", F.monotonically_increasing_id()), "ngram-rows")
    labels = ngram_join(rows, "ngram row", text_col, **options).select(F.col("doc_id").alias("ngram row"), "component_id")
    known = rows.select("`ngram row`", F.col(id_col).alias("own_id"))
    best = labels.join(known, "ngram row").groupBy("component_id").agg(F.min(F.struct(F.col("own_id").isNull().alias("none"), "own_id", "`ngram row`")).alias("best"))
    return rows.join(best.select(F.col("best")["ngram row"].alias("ngram row")), "ngram row", "left_semi").drop("ngram row")
