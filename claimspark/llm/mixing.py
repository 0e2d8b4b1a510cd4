"""Mix sources to target weights.

The words of each source form one stream, packed into blocks of a fixed number of words; a source of few words has
smaller blocks. A source has as many slots in the mix as blocks of its mean length make up its target, rounded up or
down by a draw. The mix consists of output shards with a fixed number of slots, one block each. The whole part of
each expected count of a source in a shard is fixed; the slots that sources have left are dealt to the places that
shards have left by a pseudorandom permutation, so that both get exactly their number. The k-th slot of a source takes block ``permutation(k mod blocks)`` of
its pass ``k div blocks``; every pass has its own pseudorandom permutation, so a block is taken at most once
a pass and at most ``max_repeats`` times in all. All draws are hashes of seed, shard and source: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimspark.llm.common import WORDS, partitions
from claimspark.session import materialise

BLOCK_WORDS = 128
LEAST_BLOCKS = 16  # of a source, as far as its words reach; its blocks become smaller for it
SHARD_SLOTS = 4096
CHUNK_ROWS = 512  # mean rows of all sources in a piece of the stream that is numbered by one task
ROUNDS = 16


def _uniform(*columns: Column) -> Column:
    """Evenly spread number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def permuted(index: Column, size: Column, *key: Column) -> Column:
    """Image of ``index`` under a pseudorandom permutation of 0 .. size-1 chosen by ``key`` (swap-or-not shuffle)."""

    def swap(x: Column, turn: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("turn"), turn, *key), size) - x, size)
        high = F.greatest(x, partner)
        return F.when(F.pmod(F.xxhash64(F.lit("swap"), turn, high, *key), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _row_key(doc_id: Column, key: Column, content: Column) -> Column:
    return F.concat_ws(":", F.hex(content), F.coalesce(doc_id.cast("string"), F.lit("none")), key)


def _block_size(block_words: int) -> Column:
    """Words in a block of the source with ``source_size`` words."""
    return F.greatest(F.lit(1), F.least(F.lit(block_words), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = 3) -> DataFrame:
    """``key, source_size, target`` of each source; ``sizes`` has ``key, source, size``.

    Sources in code-point order, NULL last, weigh 1, 2, 3, repeating. A target above ``max_repeats`` times the
    source's size stops there and the excess is shared again by weight. That fixed point is reached at once: in
    the order of size by weight the stopped sources come first, and all others get the same level per weight.
    """
    per_source = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per_source = per_source.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))
    per_source = per_source.withColumns({
        "total": F.sum("source_size").over(everything).cast("double"),
        "most": (F.col("source_size") * max_repeats).cast("double"),
    })
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "key")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per_source = per_source.withColumn("level", level)
    free = F.when(F.col("most") >= F.col("level") * F.col("weight"), F.col("level"))
    shared = F.first(free, ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(shared, F.lit(0.0)) * F.col("weight"))
    return per_source.select("key", "source", "source_size", "total", target.alias("target"))


def mix_slots(targets: DataFrame, seed: int, block_words: int, shard_slots: int, max_repeats: int) -> DataFrame:
    """The mix as ``shard, key, k, block``: which block of which source fills each slot."""
    everything, by_key = Window.partitionBy(), Window.orderBy("key")
    n_blocks = F.ceil(F.col("source_size") / _block_size(block_words))
    sources = targets.filter("source_size > 0").select("key", n_blocks.alias("n_blocks"), (F.col("target") * n_blocks / F.col("source_size")).alias("expected"))
    # Both ends of a source's part are moved by the same draw and rounded down: its count is one of the two next to what is expected.
    sources = sources.withColumn("upto", F.sum("expected").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + _uniform(F.lit(seed), F.lit("round")))
    before = F.lag(F.floor("upto"), 1, 0).over(by_key)
    sources = sources.withColumn("all", F.least(F.floor("upto") - before, F.col("n_blocks") * max_repeats))
    sources = sources.withColumn("slots", F.sum("all").over(everything)).filter("`all` > 0")
    pairs = sources.withColumn("shard", F.explode(F.sequence(F.lit(0), F.ceil(F.col("slots") / shard_slots).cast("int") - 1)))
    pairs = pairs.withColumn("in_shard", F.least(F.lit(shard_slots), F.col("slots") - F.col("shard").cast("long") * shard_slots))
    pairs = pairs.withColumn("whole", F.expr("`all` * in_shard div slots"))
    pairs = materialise(pairs.select("shard", "key", "n_blocks", "all", "in_shard", "whole"), "mix-pairs")

    def left(most: str, by: str) -> DataFrame:
        """``by, place``: one row for each slot that a source, or place that a shard, has left, numbered from 0."""
        parts = pairs.groupBy(by).agg((F.first(most) - F.sum("whole")).alias("n"))
        parts = parts.withColumns({
            "end": F.sum("n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)), "n_left": F.sum("n").over(everything),
        }).filter("n > 0")
        return parts.select(by, "n_left", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)).alias("place"))

    own = left("all", "key").select("key", permuted(F.col("place"), F.col("n_left"), F.lit(seed), F.lit("left")).alias("place"))
    dealt = own.hint("merge").join(left("in_shard", "shard"), "place").groupBy("shard", "key").agg(F.count("*").alias("more"))
    pairs = pairs.join(dealt.hint("merge"), ["shard", "key"], "left").withColumn("count", F.col("whole") + F.coalesce("more", F.lit(0).cast("long")))
    along = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pairs = pairs.withColumn("end", F.sum("count").over(along))
    # The few counts are dealt out before they become many slots; a fixed number of tasks is not merged by their size.
    pairs = pairs.filter("count > 0").repartition(partitions(targets.sparkSession), "shard", "key")
    picked = pairs.select(
        "shard", "key", "n_blocks", F.explode(F.sequence(F.col("end") - F.col("count"), F.col("end") - 1)).alias("k")
    )
    turn = F.floor(F.col("k") / F.col("n_blocks"))
    block = permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.lit(seed), F.col("key"), turn)
    return picked.select("shard", "key", "k", block.alias("block"))


def _packed(docs: DataFrame, id_col, text_col, source_col, block_words: int, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the stream of their source, and the sources' targets."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long")
    sizes = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("hash"),
    ).withColumn("key", _source_key(F.col("source")))
    sizes = materialise(sizes, "mix-sizes")
    chunks = max(1, -(-sizes.count() // CHUNK_ROWS))
    sizes = sizes.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(chunks)).cast("int"))
    targets = materialise(source_targets(sizes, max_repeats), "mix-targets")
    in_chunk = Window.partitionBy("key", "chunk").orderBy("doc_id", "hash")
    rows = sizes.withColumns({
        "place": F.row_number().over(in_chunk),
        "within": F.sum("size").over(in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
    })
    along = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.groupBy("key", "chunk").agg(F.sum("size").alias("words"))
    starts = starts.withColumn("start", F.sum("words").over(along) - F.col("words"))
    starts = starts.join(targets.select("key", "source_size", "target"), "key").select("key", "chunk", "start", "source_size", "target")
    rows = rows.join(starts, ["key", "chunk"]).withColumn("offset", F.col("start") + F.col("within"))
    return rows, targets


def _taken_parts(rows: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """``rows`` once per block they reach into, with the words there and how often the mix takes the block."""
    # The planner cannot know how many slots the few shares become: without the hint it would broadcast them.
    taken = slots.groupBy("key", "block").agg(F.count("*").alias("times")).hint("merge")
    block_size = _block_size(block_words)
    first = F.floor(F.col("offset") / block_size)
    last = F.floor((F.col("offset") + F.col("size") - 1) / block_size)
    parts = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    low = F.greatest(F.col("block") * block_size, F.col("offset"))
    high = F.least((F.col("block") + 1) * block_size, F.col("offset") + F.col("size"))
    parts = parts.withColumns({"from": low - F.col("offset"), "words": F.coalesce(high - low, F.lit(0).cast("long"))})
    return parts.join(taken, ["key", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeats: int = 3,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    ``taken`` counts the row's words in the mix with repeats, at most ``max_repeats`` times its size. A NULL or
    empty text has size 0 and nothing is taken. A NULL source is a source of its own, last in order. NULL ids and
    repeated rows are packed like others. Other columns are ignored; an empty table gives an empty result.
    """
    rows, targets = _packed(docs, id_col, text_col, source_col, block_words, max_repeats)
    slots = mix_slots(targets, seed, block_words, shard_slots, max_repeats)
    parts = _taken_parts(rows, slots, block_words)
    own = ["key", "chunk", "place", "doc_id", "size", "source_size", "target"]
    return parts.groupBy(*own).agg(F.sum(F.col("words") * F.col("times")).alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, max_repeats: int = 3,
) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    A document whose blocks are taken up to n times appears n times: the i-th row has the words of the blocks
    taken at least i times, in order; a document taken as a whole keeps its text as it is. Documents without
    taken words do not appear. Rows that repeat id, source and text are one document and add up what is taken.
    """
    rows, targets = _packed(docs, id_col, text_col, source_col, block_words, max_repeats)
    slots = mix_slots(targets, seed, block_words, shard_slots, max_repeats)
    parts = _taken_parts(rows, slots, block_words).filter("times > 0")
    parts = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    pieces = parts.groupBy("doc_id", "key", "hash", "size", "chunk", "place", "copy").agg(
        F.sort_array(F.collect_list(F.struct("from", "words"))).alias("pieces"), F.sum("words").alias("words")
    ).withColumn("mix_row", _row_key(F.col("doc_id"), F.col("key"), F.col("hash"))).select("mix_row", "size", "words", "pieces")
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = _row_key(F.col(id_col), _source_key(F.col(source_col)), F.unhex(F.md5(text)))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row.alias("mix_row"))
    keyed = keyed.dropDuplicates(["mix_row"])
    text = F.coalesce(F.col("doc").getField(text_col), F.lit(""))
    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(tokens, (p["from"] + 1).cast("int"), p["words"].cast("int")))), "")
    mixed = keyed.join(pieces, "mix_row").withColumn("mix_text", F.when(F.col("words") == F.col("size"), text).otherwise(cut))
    own = [(F.col("mix_text") if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns]
    return mixed.select(*own)
