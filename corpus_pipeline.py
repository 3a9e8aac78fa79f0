"""A corpus pipeline of five operators over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.mixing import mix_sources
from arcwise.llm.nearcopies import first_of_near_copies
from arcwise.llm.pieces import encode_and_decode
from arcwise.llm.quality import score_quality, train_quality
from arcwise.llm.substrings import remove_repeats
from arcwise.llm.tables import keyed_rows, parted, read
from arcwise.llm.tokencounts import tokenizer_path
from arcwise.storage import materialize

#: Near-duplicates: sets of five-word shingles with a Jaccard similarity of 4 / 5 or more, compared exactly. At 4 / 5 a
#: pair shares none of 20 bands of three minima with a chance of (1 - 0.8 ** 3) ** 20 = 5.9e-7. Bits of its SimHash
#: differ with a chance of 3 / 16 at most (sets of 4 and 5), so it leaves the radius with 7.9e-7 at most: together
#: under 1.5 in a million, and less above 4 / 5. The radius only chooses what is compared.
SHINGLE, OVER, UNDER, BITS, RADIUS, BANDS, ROWS = 5, 4, 5, 512, 140, 20, 3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts.

    Every row is scored by its text alone, so rows that repeat an id or have none are judged as any other, and null
    texts as empty ones. Labels without an id don't count. An empty table gives an empty one; columns are kept.
    """
    model = train_quality(docs, read(spark, sf_dir, "labels"))
    scored = score_quality(docs.select(F.struct(*docs.columns).alias("_row"), "text"), model)
    return scored.where("score >= 0.5").select("_row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates.

    Rows are told apart by ``keyed_rows``: the smallest doc_id stays, of rows that repeat it that with the least text, and
    rows without an id come last but are compared as any other. Null texts and texts without words are one group. An
    empty table gives an empty one; columns are kept.
    """
    keyed = keyed_rows(docs)
    kept = materialize(first_of_near_copies(keyed, SHINGLE, OVER, UNDER, BITS, RADIUS, BANDS, ROWS), "kept")
    gone = materialize(keyed.select("doc_id").join(kept, "doc_id", "left_anti"), "gone")
    some, stay = parted(keyed, gone)
    return some.join(gone, "doc_id", "left_anti").union(stay).select("_row.*")


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the runs of 20 words that came before; untouched texts keep their spacing, and null texts stay null.

    Rows are told apart by ``keyed_rows``, whose order says what came before, so rows that repeat an id or have none keep
    their own texts. A row of which nothing is left goes; one that had no words stays. An empty table gives an empty one.
    """
    # all columns but the text travel as one, so that the text moves once and no name can clash
    own = [c for c in docs.columns if c != "text"]
    keyed = keyed_rows(docs).select("doc_id", "text", F.struct(*[F.col("_row")[c].alias(c) for c in own]).alias("_own"))
    left = remove_repeats(keyed, whole=True).where("n_removed = 0 OR kept <> ''")
    chars = F.length("kept").cast(dict(docs.dtypes).get("n_chars", "long"))
    made = {"text": F.col("kept"), "n_chars": chars}
    return left.select(*[made.get(c, F.col("_own")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix of sources takes it, each by itself; a null source is a source, a null text has size 0."""
    return mix_sources(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row its ``doc_id``, the ids of its text's pieces, how many, and whether they decode to the text.

    Null texts count as empty: no pieces. Rows may repeat; an empty table gives an empty result.
    """
    path = tokenizer_path("piece_bpe_32k.model")
    done = encode_and_decode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    same = F.col("decoded") == F.translate("text", "▁", " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.split()[0])
    return docs


ORACLE_SQL = None
