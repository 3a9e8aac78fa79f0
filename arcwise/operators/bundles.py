"""Small components packed whole into rows, so that one task can work on each without a shuffle.

A bundle is a row of some ``SIZE`` rows of a table, its columns as bytes of longs; no component of it has rows
elsewhere. Rows are packed as they lie: where all rows of a component lie together, they stay in place. Those of
components that lie apart are dealt by component, and components of more than ``MOST`` rows are handed back as a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcwise.operators.components import pieces, roots_of, star_labels
from arcwise.operators.graph import Graph
from arcwise.storage import dealt, forget, materialize, new_path, parts_for, rows_of

#: Rows of a bundle, and of a component that goes into one.
SIZE, MOST = 100_000, 300
#: Rows of an Arrow batch that is sent back.
BATCH = 50_000
WHOLE = ("tinyint", "smallint", "int", "bigint")

Arrays = dict[str, np.ndarray]


def packable(df: DataFrame, *columns: str) -> bool:
    """Whether these columns are whole numbers."""
    return all(kind in WHOLE for name, kind in df.dtypes if name in columns)


def _batches(columns: list[str], arrays: Arrays) -> Iterator[pa.RecordBatch]:
    n = len(arrays[columns[0]])
    for k in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(arrays[c][k : k + BATCH]) for c in columns], names=columns)


def _row(columns: list[str], arrays: Arrays, **also: int) -> pa.RecordBatch:
    packed = [pa.array([np.ascontiguousarray(arrays[c], np.int64).tobytes()], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in also.values()] + packed, names=[*also, *columns])


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, int], Arrays]]:
    """The numbers and the arrays of each row."""
    for k in range(len(batch)):
        numbers, arrays = {}, {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            value = column[k]
            if pa.types.is_binary(column.type):
                arrays[name] = np.frombuffer(value.as_py(), np.int64) if value.is_valid else None
            else:
                numbers[name] = value.as_py()
        yield numbers, arrays


def _packed(df: DataFrame, columns: list[str], label: str, key: str | None = None) -> DataFrame:
    """The rows of ``df`` as ``chunk`` and bytes; few to a file, as a reader holds some thousand rows at a time."""
    base = 0 if key is None else 1 << 60

    def pack(batches):
        for k, piece in enumerate(pieces(batches, columns, SIZE, key)):
            yield _row(columns, piece, chunk=base + (TaskContext.get().partitionId() << 32) + k)

    return _kept(df.mapInArrow(pack, _schema(columns)), label)


def _schema(columns: list[str]) -> str:
    return ", ".join(["chunk long", *[f"{c} binary" for c in columns]])


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.option("maxRecordsPerFile", 8).option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def unpacked(bundles: DataFrame, f: Callable[[Arrays], Arrays | Iterator[Arrays] | None], schema: str) -> DataFrame:
    """Rows of longs (or booleans) that ``f`` makes of each bundle; ``schema`` is theirs."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in batches:
            for numbers, arrays in _rows_of(batch):
                made = f(arrays | numbers)
                for one in [made] if isinstance(made, dict) else made or ():
                    yield from _batches(names, one)

    return bundles.mapInArrow(run, schema)


def repacked(bundles: DataFrame, columns: list[str], f: Callable[[Arrays], Iterator[Arrays]], label: str) -> DataFrame:
    """Bundles of what ``f`` makes of each, which may be several, with numbers of their own."""

    def run(batches):
        made = (one for batch in batches for numbers, arrays in _rows_of(batch) for one in f(arrays | numbers))
        for k, one in enumerate(made):
            yield _row(columns, one, chunk=(TaskContext.get().partitionId() << 32) + k)

    return _kept(bundles.mapInArrow(run, _schema(columns)), label)


def _marked(chunks: DataFrame, a: str, b: str, rows: int | None) -> DataFrame:
    """The chunks with ``open``, those of their vertices that are in other chunks as well (null for none)."""

    def ends(x):
        v = np.unique(np.concatenate([x[a], x[b]]))
        return {"v": v, "chunk": np.full(len(v), x["chunk"])}

    at = unpacked(chunks, ends, "v long, chunk long")
    apart = materialize(dealt(at, rows, "v").groupBy("v").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).where("lo <> hi").select("v"), "apart")
    if apart.isEmpty():
        open_at = chunks.sparkSession.createDataFrame([], "chunk long, `open` binary")
    else:
        # written, so that its size is known and the chunks are not shuffled for a few
        open_at = materialize(_by_chunk(at.join(apart, "v").select("chunk", "v"), ["v"]).withColumnRenamed("v", "open"), "open")
    return chunks.join(open_at, "chunk", "left")


def in_ranges(edges: DataFrame, rows: int | None) -> DataFrame:
    """Edges ``src, dst`` as chunks in the order of ``src``, whatever their components, with ``open``, the vertices that are in other chunks."""
    spark = edges.sparkSession
    long = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    laid = long.repartitionByRange(parts_for(spark, rows or 0), "src", "dst").sortWithinPartitions("src", "dst")
    return _marked(_packed(laid, ["src", "dst"], "chunks"), "src", "dst", rows)


def bundled(rows: DataFrame, a: str, b: str, *also: str) -> tuple[DataFrame, DataFrame | None]:
    """``chunk`` and the columns as bytes, and the rows of large components, None if there are none.

    Components are those of the pairs ``a, b``, which may be equal (a vertex alone); all columns are whole numbers.
    """
    columns, spark = [a, b, *also], rows.sparkSession
    chunks = _packed(rows.select(columns), columns, "chunks")

    marked = _marked(chunks, a, b, rows_of(rows))

    def closed(x):
        """The component of each row, and which rows' components are small and have no vertex elsewhere."""
        ids, inverse = np.unique(np.concatenate([x[a], x[b]]), return_inverse=True)
        k = len(x[a])
        root = roots_of(inverse[:k], inverse[k:], len(ids))
        bad = np.bincount(root[inverse[:k]], minlength=len(ids)) > MOST
        if x.get("open") is not None:
            bad[root[np.searchsorted(ids, x["open"])]] = True
        own = root[inverse[:k]]
        return own, ~bad[own]

    def split(x):
        own, good = closed(x)
        for kind in (True, False):
            rows = np.flatnonzero(good == kind)
            rows = rows[np.argsort(own[rows], kind="stable")]
            if len(rows):
                yield {c: x[c][rows] for c in columns} | {"_kept": np.array([kind])}

    both = repacked(marked, [*columns, "_kept"], split, "bundles")
    good = F.substring("_kept", 1, 1) == F.lit(b"\x01")
    bundles = both.where(good).drop("_kept")
    left = materialize(unpacked(both.where(~good), lambda x: {c: x[c] for c in columns}, ", ".join(f"{c} long" for c in columns)), "apart")
    forget(chunks)
    if left.isEmpty():
        return bundles, None
    labels = materialize(star_labels(left, a, b).select(F.col("id").alias(a), F.col("component").alias("_part")), "labels")
    m = left.count()
    named = materialize(dealt(left, m, a).join(labels, a, "left").withColumn("_part", F.coalesce("_part", a)), "named")
    large = materialize(named.groupBy("_part").count().where(F.col("count") > MOST).select("_part"), "large")
    small = named if large.isEmpty() else named.join(large, "_part", "left_anti")
    sorted_ = small.repartition(parts_for(spark, m), "_part").sortWithinPartitions("_part")

    more = _packed(sorted_, columns, "bundles", "_part")
    rest = None if large.isEmpty() else materialize(named.join(large, "_part", "left_semi").select(columns), "rest")
    return bundles.union(more), rest


def _by_chunk(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``chunk`` and the columns of its rows as bytes, in the order of the first column."""

    def pack(batches):
        for batch in batches:
            for k in range(len(batch)):
                fields = [v.to_numpy(zero_copy_only=False) for v in batch.column(1)[k].values.flatten()]
                order = np.argsort(fields[0], kind="stable")
                yield _row(columns, {c: v[order] for c, v in zip(columns, fields, strict=True)}, chunk=batch.column(0)[k].as_py())

    grouped = rows.groupBy("chunk").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    return grouped.mapInArrow(pack, _schema(columns))


def with_values(bundles: DataFrame, values: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """The bundles with ``ids``, the sorted vertices, and ``value`` of each by ``values`` (``id`` and that column), which may lack some."""
    columns = [c for c in bundles.columns if c != "chunk"]

    def ends(x):
        v = np.unique(np.concatenate([x[a], x[b]]))
        return {"id": v, "chunk": np.full(len(v), x["chunk"])}

    at = unpacked(bundles, ends, "id long, chunk long").join(values.select(F.col("id").cast("long").alias("id"), F.col(value).cast("long").alias(value)), "id")
    found = bundles.join(_by_chunk(at.select("chunk", "id", value), ["id", value]), "chunk")
    return _kept(found.select("chunk", *columns, F.col("id").alias("ids"), value), "valued")


def of_graph(g) -> tuple[DataFrame, Graph | None] | None:
    """The graph's small components as bundles of ``src, dst`` (a vertex alone as both), and the graph of the others; None if ids are no whole numbers.

    They are kept with the graph.
    """
    if not packable(g.edges, "src", "dst") or not packable(g.vertices, "id"):
        return None
    if g.packed is None:
        edges = g.edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        ends = g.vertices.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("n")).union(edges.select(F.explode(F.array("src", "dst")), F.lit(1)))
        alone = dealt(ends, rows_of(g.edges), "id").groupBy("id").agg(F.max("n").alias("n")).where("n = 0").select("id", "id")
        bundles, rest = bundled(edges.union(alone), "src", "dst")
        if rest is not None:
            rest = Graph(rest.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), rest.where("src <> dst"))
        g.packed = (bundles, rest)
    return g.packed


def by_order(g, order: DataFrame, value: str = "pos") -> DataFrame:
    """The graph's bundles with ``ids`` and ``value`` of each vertex, kept with the graph for the last order."""
    if g.ordered is None or g.ordered[0] is not order:
        g.ordered = (order, with_values(of_graph(g)[0], order, "src", "dst", value))
    return g.ordered[1]


def ends_in(ids: np.ndarray, x: Arrays) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``ids`` of both ends of the edges that have both there."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.minimum(np.searchsorted(ids, x[c]), len(ids) - 1) for c in ("src", "dst"))
    good = (x["src"] != x["dst"]) & (ids[a] == x["src"]) & (ids[b] == x["dst"])
    return a[good], b[good]


def neighbors(x: np.ndarray, y: np.ndarray, n: int) -> list[list[int]]:
    """The neighbours of each vertex of edges ``x, y`` between numbers below ``n``."""
    start, end = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.argsort(start, kind="stable")
    end, cuts = end[order].tolist(), np.concatenate([[0], np.cumsum(np.bincount(start, minlength=n))]).tolist()
    return [end[cuts[k] : cuts[k + 1]] for k in range(n)]
