"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``nodes`` points on a ring of 64-bit hashes; a row stands where the hash of its text stands, so equal texts stand together, and belongs to
the shard of the next point clockwise. A shard is full as soon as it holds its bound of bytes, its share of all with a little slack. Rows
that find it full go on clockwise to the next point of a shard that is not. All rows on their way
arrive at once: each round a shard takes its arrivals in a fixed order, larger size classes first, until it is full, and the rest
move on. The row that fills a shard is found by sums over cells of that order and then inside one
cell, so no shard's rows ever meet in one task. Every round fills a shard or is the last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from claimspark.session import materialise

SHARDS = 8
NODES = 256  # points of a shard on the ring
SLACK = 0.002
RING_BITS = 12  # the ring is cut into 4,096 arcs in which points are looked up
CELL_BITS = 12  # the order of arrivals is cut into 4,096 cells for each size class


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """``node`` (rank on the ring), ``position`` and ``shard`` of every point; shards * nodes rows.

    A point's position depends on its shard and number only, so another shard adds points and moves none.
    """
    points = spark.range(shards * nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.concat_ws(":", F.lit("point"), F.col("id") % shards, F.floor(F.col("id") / shards))).alias("position")
    )
    return points.withColumn("node", F.row_number().over(Window.orderBy("position", "shard")) - 1)


def arcs(points: DataFrame) -> DataFrame:
    """For every arc of the ring its points in order and the first point behind it, clockwise."""
    spark = points.sparkSession
    width = 64 - RING_BITS
    inside = points.groupBy(F.shiftright("position", width).alias("arc")).agg(F.sort_array(F.collect_list(F.struct("position", "node"))).alias("points"))
    half = 1 << (RING_BITS - 1)
    whole = spark.range(-half, half).withColumnRenamed("id", "arc").join(inside, "arc", "left")
    onward = Window.orderBy("arc").rowsBetween(1, Window.unboundedFollowing)
    first = F.get("points", F.lit(0))["node"]
    return whole.select("arc", F.coalesce("points", F.array()).alias("points"), F.coalesce(F.first(first, True).over(onward), F.lit(0)).alias("next_node"))


def placed_rows(docs: DataFrame, shards: int, nodes: int, id_col: str, text_col: str) -> DataFrame:
    """Each row without its text: size, checksum, the point clockwise of it, its cell and its place in the order of arrivals."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("position"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(rows, "shard-rows")
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select(F.col("doc_id").alias("repeated_id"), F.lit(True).alias("repeated"))
    # Rows that repeat an id are told apart by their place in the written table.
    rows = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("repeated_id")), "left")
    draw = F.xxhash64(F.concat_ws(":", F.col("doc_id").cast("string"), F.when(F.col("repeated"), F.col("row").cast("string"))))
    size_class = 64 - F.length(F.bin("size"))
    cell = F.shiftleft(size_class, CELL_BITS) + F.shiftrightunsigned(draw, 64 - CELL_BITS).cast("int")
    lookup = F.broadcast(arcs(ring(docs.sparkSession, shards, nodes)))  # 2^RING_BITS rows with shards * nodes points
    rows = rows.withColumn("arc", F.shiftright("position", 64 - RING_BITS)).join(lookup, "arc")
    clockwise = F.get(F.filter("points", lambda p: p["position"] >= F.col("position")), F.lit(0))["node"]
    placed = rows.select("doc_id", "size", "text_crc32", "row", draw.alias("draw"), cell.alias("cell"), F.coalesce(clockwise, "next_node").alias("node"))
    return materialise(placed, "shard-placed")


def open_shards(points: DataFrame, closed: list[int]) -> DataFrame:
    """For every point the shard of the first point from it on, clockwise, that is not full."""
    shard = F.when(~F.col("shard").isin(closed), F.col("shard")) if closed else F.col("shard")
    onward = Window.orderBy("node").rowsBetween(0, Window.unboundedFollowing)
    around = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.select("node", F.coalesce(F.first(shard, True).over(onward), F.first(shard, True).over(around)).alias("shard"))


def _order(*more: str) -> Column:
    return F.struct("cell", "draw", "row", *more)


def shard(
    docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the number of UTF-8 bytes plus 1. The law is ``bytes``: no shard holds more than (1 + ``slack``) / ``shards`` of all bytes but for the row that
    filled it, and larger size classes are placed first. ``slot`` numbers a shard's rows without gaps from 0. ``grown_shard`` is NULL: where a
    full shard sends rows depends on all rows. Equal texts share a shard unless it fills up while they arrive; then the rest of them
    follows one way round the ring together. NULL and empty texts have size 1 and checksum 0. NULL and repeated ids and repeated rows are
    rows like others, told apart by their place in the table read. A row larger than a shard's bound fills one shard. Other columns
    are ignored. An empty table gives an empty result. The driver sees one number per shard and round.
    """
    spark = docs.sparkSession
    rows = placed_rows(docs, shards, nodes, id_col, text_col)
    points = materialise(ring(spark, shards, nodes), "shard-points")
    bound = (rows.agg(F.sum("size")).first()[0] or 0) * (1 + slack) / shards
    load, closed, taken, waiting = [0] * shards, [], [], rows
    while len(closed) < shards:
        arrivals = waiting.join(F.broadcast(open_shards(points, closed)), "node")  # shards * nodes rows
        cells = materialise(arrivals.groupBy("shard", "cell").agg(F.sum("size").alias("size")), "shard-cells")
        arrived = {r["shard"]: r["size"] for r in cells.groupBy("shard").agg(F.sum("size").alias("size")).collect()}
        filled = [s for s, size in arrived.items() if load[s] + size >= bound]
        if filled:
            held = spark.createDataFrame([(s, load[s]) for s in filled], "full_shard int, load long")
            upto = F.sum("size").over(Window.partitionBy("shard").orderBy("cell"))
            sums = cells.join(F.broadcast(held), F.col("shard") == F.col("full_shard")).select("shard", "cell", (F.col("load") + upto).alias("upto"), "size")
            last = sums.filter(F.col("upto") >= bound).groupBy("shard").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("size")).alias("before")), "cell").alias("last"))
            last = last.select(F.col("shard").alias("full_shard"), F.col("last.cell").alias("last_cell"), F.col("last.before").alias("before"))
            inside = arrivals.join(F.broadcast(last), (F.col("shard") == F.col("full_shard")) & (F.col("cell") == F.col("last_cell")))
            upto = F.sum("size").over(Window.partitionBy("shard").orderBy("draw", "row"))
            inside = inside.select("shard", _order().alias("end"), (F.col("before") + upto - F.col("size")).alias("ahead"))
            ends = inside.filter(F.col("ahead") < bound).groupBy(F.col("shard").alias("full_shard")).agg(F.max("end").alias("end"))
            late = F.coalesce(_order() > F.col("end"), F.lit(False))
            arrivals = arrivals.join(F.broadcast(ends), F.col("shard") == F.col("full_shard"), "left")  # one row per shard
            arrivals = materialise(arrivals.select(*rows.columns, F.when(~late, F.col("shard")).alias("shard")), "shard-round")
        else:
            arrivals = materialise(arrivals.select(*rows.columns, "shard"), "shard-round")
        taken.append(arrivals.filter("shard IS NOT NULL"))
        if not filled:
            break
        for s, size in arrived.items():
            load[s] += size
        closed += filled
        waiting = arrivals.filter("shard IS NULL").drop("shard")
    rows = reduce(DataFrame.unionByName, taken)
    counts = rows.groupBy(F.col("shard").alias("of_shard"), F.col("cell").alias("of_cell")).agg(F.count("*").alias("members"))
    ahead = F.sum("members").over(Window.partitionBy("of_shard").orderBy("of_cell")) - F.col("members")
    starts = materialise(counts.select("of_shard", "of_cell", ahead.alias("start")), "shard-starts")
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("draw", "row")) - 1
    numbered = rows.withColumn("rank", rank).join(starts, (F.col("shard") == F.col("of_shard")) & (F.col("cell") == F.col("of_cell")))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
