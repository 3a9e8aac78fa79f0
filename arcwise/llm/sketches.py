"""Document fingerprints as invertible Bloom lookup sketches of paragraphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions.ranking import with_global_index
from arcwise.llm.tables import one_row_per_id, read
from arcwise.storage import materialize

#: Cells a sketch has: regions (one hash each) times cells a region; longest paragraph piece; peeling rounds; parts of a retry.
REGIONS, CELLS, PIECE, ROUNDS, PARTS = 3, 8, 256, 10, 4
CELL = "struct<n:int, k:bigint, h:bigint>"


def paragraphs(text) -> F.Column:
    """Digests of the distinct lines of a text; a long line counts by pieces of PIECE code points."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^\\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def _let(value: F.Column, body) -> F.Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _check(digest) -> F.Column:
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF))


def _in_cell(spots, j) -> F.Column:
    """Whether cell ``j`` is the one of its region that the bits of ``spots`` choose."""
    bits = F.call_function("shiftright", spots, F.shiftright(j, 3) * 3)
    return bits.bitwiseAND(F.lit(CELLS - 1)) == j.bitwiseAND(F.lit(CELLS - 1))


def sketch(digests, level) -> F.Column:
    """The cells of a set of digests: in each a count, and the digests and their checks under xor.

    A digest is in one cell of each region; ``level`` seeds the choice.
    """
    entries = F.transform(digests, lambda d: F.struct(d.alias("d"), F.xxhash64(d, level).alias("s"), _check(d).alias("h")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def cells(entries):
        def cell(j):
            own = F.filter(entries, lambda e: _in_cell(e["s"], j))
            return F.aggregate(own, zero, lambda c, e: F.struct((c["n"] + 1).alias("n"), c["k"].bitwiseXOR(e["d"]).alias("k"), c["h"].bitwiseXOR(e["h"]).alias("h")))

        return F.transform(F.sequence(F.lit(0), F.lit(REGIONS * CELLS - 1)), cell)

    return _let(entries, cells)


def subtract(a, b) -> F.Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))


def peel(cells, level) -> F.Column:
    """``cells`` and ``out``: what stays after peeling, and the digests found (sign, digest).

    A cell with a count of 1 or -1 whose digest fits its check holds one digest;
    all such are taken from their other cells, and so on.
    """
    out0 = F.array().cast("array<struct<n:int, d:bigint>>")
    start = F.struct(cells.alias("cells"), out0.alias("out"))

    def taken(state, found):
        def less(c, j):
            own = F.filter(found, lambda f: _in_cell(f["s"], j))
            return F.aggregate(own, c, lambda a, f: F.struct((a["n"] - f["n"]).alias("n"), a["k"].bitwiseXOR(f["d"]).alias("k"), a["h"].bitwiseXOR(f["h"]).alias("h")))

        digests = F.transform(found, lambda f: F.struct(f["n"].alias("n"), f["d"].alias("d")))
        fewer = F.struct(F.transform(state["cells"], less).alias("cells"), F.concat(state["out"], digests).alias("out"))
        return F.when(F.size(found) == 0, state).otherwise(fewer)

    def step(state, _):
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == _check(c["k"])))
        found = F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["k"].alias("d"), F.xxhash64(c["k"], level).alias("s"), c["h"].alias("h")))
        return _let(F.array_distinct(found), lambda f: taken(state, f))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def is_empty(cells) -> F.Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["h"] == 0))


def as_string(cells) -> F.Column:
    """Cells as hex digits: count, digests and checks of each."""
    return F.lower(F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"]), 6, "0"), F.lpad(F.hex(c["k"]), 16, "0"), F.lpad(F.hex(c["h"]), 8, "0"))), ""))


def differences(pairs: DataFrame, max_level: int = 40) -> DataFrame:
    """``id, side, digest`` for ``id, a, b``: digests that one of two sets has alone.

    ``side`` is 1 for ``a`` and -1 for ``b``. The sketches of both are subtracted
    and peeled. Where cells stay, the sketch is retried larger: with PARTS
    sketches for one, each over the digests that fall in its part. Only what
    failed is retried.
    """
    found, rest = [], pairs.select("id", "a", "b")
    for level in range(max_level):
        seed = F.lit(level)
        peeled = rest.withColumn("p", peel(subtract(sketch(F.col("a"), seed), sketch(F.col("b"), seed)), seed))
        done = materialize(peeled.select("id", F.when(is_empty(F.col("p.cells")), F.col("p.out")).alias("out"), F.when(~is_empty(F.col("p.cells")), F.struct("a", "b")).alias("again")), "peeled")
        found.append(done.where("out IS NOT NULL").select("id", F.explode("out").alias("o")).select("id", F.col("o.n").alias("side"), F.col("o.d").alias("digest")))
        failed = done.where("again IS NOT NULL")
        if failed.limit(1).count() == 0:
            return reduce(DataFrame.union, found)
        part = lambda d, level=level: F.pmod(F.xxhash64(d, F.lit("part"), F.lit(level)), F.lit(PARTS))
        split = failed.select("id", "again", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
        rest = split.select("id", F.filter("again.a", lambda d: part(d) == F.col("part")).alias("a"), F.filter("again.b", lambda d: part(d) == F.col("part")).alias("b"))
    raise RuntimeError(f"sketches failed {max_level} times")


def likeness(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """``id, near``: shared digests over all, from ``id, n_a, n_b`` and the differences; 1 for two empty sets."""
    apart = found.groupBy("id").agg(F.count(F.lit(1)).alias("apart"))
    both, d = F.col("n_a") + F.col("n_b"), F.coalesce("apart", F.lit(0))
    return sizes.join(apart, "id", "left").select("id", F.when(both > 0, (both - d) / (both + d)).otherwise(1.0).alias("near"))


def next_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, for_id, wanted``: each document, the one before it in id order
    (for the first: the last), and a quarter of that one's code points."""
    spark = docs.sparkSession
    sized = materialize(docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")), "lengths")
    placed = materialize(with_global_index(sized, ["doc_id"], "idx"), "order")
    last = placed.agg(F.max("idx")).first()[0]
    if last is None:
        return spark.createDataFrame([], "doc_id long, for_id long, wanted long")
    after = placed.select(F.when(F.col("idx") == last, 0).otherwise(F.col("idx") + 1).alias("idx"), F.col("doc_id").alias("for_id"), F.floor(F.col("n") / 4).alias("wanted"))
    return materialize(placed.select("idx", "doc_id").join(after, "idx").select("doc_id", "for_id", "wanted"), "next")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text ends in the start of the next document's, in place of its
    last quarter. Null texts count as empty: no paragraphs, a sketch of zeros, and
    alike to one another. The fingerprint is the text's sketch of 24 cells, of equal size for all; ``near_edited`` and
    ``near_next`` come from sketches that are retried as large as the difference needs. Rows without a doc_id take no part; of rows that repeat
    one, that with the least text is the document. The only document is its own
    next one. An empty table gives an empty result; other columns are ignored.
    """
    docs = one_row_per_id(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    following = next_documents(docs)
    heads = docs.join(following, "doc_id").select(
        F.col("for_id").alias("doc_id"), F.expr("substring(text, 1, int(wanted))").alias("_head"), paragraphs(F.col("text")).alias("c")
    )
    length = F.length("text")
    rows = docs.join(heads, "doc_id").withColumn("_kept", (length - F.floor(length / 4)).cast("int"))
    rows = rows.withColumn("_edited", F.concat(F.expr("substring(text, 1, _kept)"), F.col("_head")))
    rows = materialize(
        rows.select(
            "doc_id", length.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
            paragraphs(F.col("text")).alias("a"), paragraphs(F.col("_edited")).alias("b"), "c",
        ),
        "paragraphs",
    )
    # the first sketches are the fingerprints; the same ones are subtracted at level 0
    tagged = lambda kind, other: rows.select(F.struct(F.col("doc_id"), F.lit(kind).alias("kind")).alias("id"), "a", F.col(other).alias("b"))
    pairs = tagged(0, "b").union(tagged(1, "c"))
    near = materialize(likeness(pairs.select("id", F.size("a").alias("n_a"), F.size("b").alias("n_b")), differences(pairs)), "near")
    near = near.groupBy("id.doc_id").agg(F.max(F.when(F.col("id.kind") == 0, F.col("near"))).alias("near_edited"), F.max(F.when(F.col("id.kind") == 1, F.col("near"))).alias("near_next"))
    prints = rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(sketch(F.col("a"), F.lit(0))).alias("fingerprint"), as_string(sketch(F.col("b"), F.lit(0))).alias("edited_fingerprint")
    )
    return prints.join(near, "doc_id")


def op4_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of all documents and of their edited texts, compared by peeling."""
    return edit_fingerprints(read(spark, sf_dir, "documents").select("doc_id", "text"))
