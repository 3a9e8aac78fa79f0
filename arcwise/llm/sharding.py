"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.llm.tables import read
from arcwise.storage import materialize

RING_BITS, CELL_BITS = 32, 22


def ring_point(*parts) -> F.Column:
    """A place on the ring, 0 to 2^32 - 1."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << RING_BITS) - 1))


def virtual_nodes(spark: SparkSession, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(place, shard) of each virtual node in ring order."""
    grid = spark.range(shards * nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("copy")
    )
    placed = grid.select(ring_point(F.lit("node"), "shard", "copy").alias("place"), "shard")
    return sorted((r["place"], r["shard"]) for r in placed.collect())


def fill_ring(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """How the keys of each arc are shared out: (arc, from, to, shard, first slot).

    ``counts[i]`` keys lie on the arc that ends at virtual node ``i``, which is
    of ``owners[i]``; an arc past the last node belongs to the first. In each
    round every arc offers what it has left to the next node clockwise whose shard has room,
    and a shard takes offers in ring order until it is full. An offer ends its arc or fills
    a shard, and nodes of full shards are stepped over for good, so time and memory follow the number of virtual
    nodes, not of keys or of nodes times shards.
    """
    n, used, pieces = len(owners), [0] * len(capacity), []
    following = list(range(n))  # of a node of a full shard: one further on
    nodes: dict[int, list[int]] = {}
    for i, shard in enumerate(owners):
        nodes.setdefault(shard, []).append(i)
    still_open = sum(capacity[s] > 0 for s in nodes)

    def close(shard):
        for i in nodes[shard]:
            following[i] = (i + 1) % n

    def next_open(i):
        while following[i] != i:
            following[i] = following[following[i]]
            i = following[i]
        return i

    if sum(counts) > sum(capacity[s] for s in nodes):
        raise ValueError("the capacities hold fewer keys than there are")
    if still_open:
        for shard in nodes:
            if capacity[shard] <= 0:
                close(shard)
    waiting = [(i, i % n, 0) for i, count in enumerate(counts) if count]
    while waiting:
        later = []
        for arc, node, done in waiting:
            node = next_open(node)
            shard = owners[node]
            take = min(counts[arc] - done, capacity[shard] - used[shard])
            pieces.append((arc, done, done + take, shard, used[shard]))
            used[shard] += take
            if used[shard] == capacity[shard] and still_open > 1:
                close(shard)
                still_open -= 1
            if done + take < counts[arc]:
                later.append((arc, node, done + take))
        waiting = later
    return pieces


def with_arc(df: DataFrame, places: list[int]) -> DataFrame:
    """Add ``arc``: how many virtual nodes lie before ``_point``."""
    cells: dict[int, list[int]] = {c: [] for c in range(1 << (RING_BITS - CELL_BITS))}
    for p in places:
        cells[p >> CELL_BITS].append(p)
    rows, before = [], 0
    for c, inside in cells.items():
        rows.append((c, before, inside))
        before += len(inside)
    # 1,024 rows, whatever the input
    table = df.sparkSession.createDataFrame(rows, "_cell long, _before int, _inside array<long>")
    found = df.withColumn("_cell", F.shiftright("_point", CELL_BITS)).join(F.broadcast(table), "_cell")
    nearer = F.size(F.filter("_inside", lambda p: p < F.col("_point")))
    return found.withColumn("arc", F.col("_before") + nearer).drop("_cell", "_before", "_inside")


def shard_rows(df: DataFrame, key: str, shards: int, nodes: int = 128) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless within its shard).

    A key belongs to the first virtual node clockwise of its hash. A shard holds
    at most its share of the rows, so counts differ by one at most; what doesn't
    fit continues clockwise to the next shard with room. Within an arc the rows
    with the smallest hashes stay. Every row counts, also with a null or repeated
    key: such rows lie at one point of the ring, in any order, and may be parted
    by a full shard. An empty table gives an empty result. Columns named ``shard`` or ``slot`` are replaced, all
    others kept whatever their names. ``df`` is written once; the driver sees one count for each virtual node.
    """
    spark = df.sparkSession
    ring = virtual_nodes(spark, shards, nodes)
    places, owners = [p for p, _ in ring], [s for _, s in ring]
    named = F.struct(*df.columns)
    rows = df.select(named.alias("_row"), F.col(key).alias("_key"))
    rows = rows.withColumn("_point", ring_point(F.lit("key"), F.coalesce(F.col("_key").cast("string"), F.lit(""))))
    rows = materialize(with_arc(rows, places), "keys")
    counts = [0] * (len(places) + 1)
    for r in rows.groupBy("arc").count().collect():
        counts[r["arc"]] = r["count"]
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    pieces = fill_ring(counts, owners, capacity)
    starts = [0] * len(counts)
    for i in range(1, len(counts)):
        starts[i] = starts[i - 1] + counts[i - 1]
    by_arc = {i: [] for i in range(len(counts))}
    for arc, lo, hi, shard, slot in pieces:
        by_arc[arc].append((starts[arc] + lo, starts[arc] + hi, shard, slot))
    # one row for each virtual node and one more; a node's list is no longer than the shards
    table = spark.createDataFrame(list(by_arc.items()), "arc int, _pieces array<struct<lo: long, hi: long, shard: int, slot: long>>")
    placed = with_global_index(rows, ["_point", "_key"], "_idx").join(F.broadcast(table), "arc")
    piece = F.filter("_pieces", lambda p: (p["lo"] <= F.col("_idx")) & (F.col("_idx") < p["hi"]))[0]
    placed = placed.withColumn("_piece", piece)
    return placed.select(
        *[F.col("_row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")],
        F.col("_piece.shard").alias("shard"),
        (F.col("_piece.slot") + F.col("_idx") - F.col("_piece.lo")).alias("slot"),
    )


def op10_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards with counts at most one apart (law ``rows``)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard_rows(docs, "doc_id", 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
