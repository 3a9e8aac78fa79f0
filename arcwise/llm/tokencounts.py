"""Token counts through a cache of digests."""

from __future__ import annotations

import base64
import hashlib
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm.tables import read, small_batches
from arcwise.storage import materialize, new_path

# characters whose classes all Unicode versions in use agree on
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str, ranks_path: str | None = None) -> str:
    """Digest of all that decides a count: the tokenizer file and its library, and where ranks are used their file,
    library and pattern, and the rule that says which texts go by them."""
    import sentencepiece
    import tokenizers

    said = [tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__]
    files = [path]
    if ranks_path is not None and not path.endswith(".model"):
        import public_tokenizers
        import tiktoken

        files.append(ranks_path)
        said += [tiktoken.__version__, public_tokenizers.PATTERN, _PLAIN.pattern]
    digest = hashlib.sha256("\0".join(said).encode())
    for name in files:
        with open(name, "rb") as f:
            digest.update(hashlib.sha256(f.read()).digest())
    return digest.hexdigest()[:32]


def _counter(path: str, ranks_path: str | None):
    """A function from texts to their numbers of tokens.

    For a ``.json`` file with the same vocabulary as ranks, plain texts go through
    the faster encoder of the same merges; a text with a special token's string or
    with characters past the common Latin range goes through the file's own library.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def exact(texts):
        return [len(x.ids) for x in own.encode_batch(texts, add_special_tokens=False)]

    if ranks_path is None:
        return exact
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in own.get_added_tokens_decoder().values()]

    def count(texts):
        out = [0] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if _PLAIN.search(text) or any(s in text for s in special):
                rest.append(i)
            else:
                out[i] = len(plain.encode_ordinary(text))
        for i, n in zip(rest, exact([texts[i] for i in rest]), strict=True):
            out[i] = n
        return out

    return count


def count_tokens(docs: DataFrame, path: str, cache: str, ranks_path: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens`` of the column ``text``.

    The digest of a text (null counts as empty; nothing else is changed before
    the tokenizer's own rules) and the tokenizer's version are looked up in the
    Parquet table ``cache``, which is made if it isn't there. Of the texts that
    it lacks each is encoded once and its count appended; then all rows read their
    counts from the cache. Only the digests that are asked for are looked up. Texts may be of any length; columns of ``docs`` other
    than the two new ones are kept, and an empty table adds nothing. Rows may repeat. Two writers that
    append the same digest do no harm, since the lookup takes one count of each; ``compact_cache`` takes such rows out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_version(path, ranks_path)
    text = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    if not _exists(spark, cache):
        spark.createDataFrame([], CACHE_SCHEMA).write.parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    # each task sends a digest's text once, however many copies it has
    texts = docs.select(digest.alias("digest"), text.alias("text")).groupBy("digest").agg(F.first("text").alias("text"))

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(path, ranks_path)
        for batch in batches:
            counts = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["digest", "tokenizer", "n_tokens"]
            )

    texts.join(stored().select("digest"), "digest", "left_anti").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # own columns travel in one, so that no working name can clash with theirs
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.octet_length(text.cast("binary")).cast("long").alias("n_bytes"), digest.alias("digest"))
    asked = materialize(rows.select("digest").distinct(), "asked")
    # written, so that adaptive execution can split the rows of a much copied text
    counts = materialize(stored().join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    return rows.join(counts, "digest").select(*kept, "n_bytes", "n_tokens")


def compact_cache(spark: SparkSession, cache: str, compacted: str, keep: list[str] | None = None) -> None:
    """Write ``cache`` to the new folder ``compacted`` with one row for each text and tokenizer, of the versions ``keep`` (else of all)."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    if keep is not None:
        stored = stored.where(F.col("tokenizer").isin(keep))
    stored.groupBy("digest", "tokenizer").agg(F.max("n_tokens").alias("n_tokens")).write.parquet(compacted)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def op2_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, through a cache that is empty at first."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path, ranks = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken")
    counted = count_tokens(docs, path, new_path(spark, "token-cache"), ranks)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
