"""SentencePiece encoding over a trie of the distinct marked words, with forward states that prefixes share.

The words of some megabytes of text are put in a trie, which is walked depth first; the state of a node holds for every
word that starts with it. What a state is depends on the model's type, which is read from its file. For a
unigram model it is Viterbi's: the best score of the prefix and the piece that it ends in. A BPE model merges
pairs, so the pieces of the highest total score are not what its library returns; there the state is the one piece that
the prefix's encoding ends in, valid if merging it and the piece before it keeps the two apart. Models of other types, or
that change the text before they cut it, are refused.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from arcwise.llm.tables import read, small_batches
from arcwise.llm.tokencounts import tokenizer_path
from arcwise.llm.words import in_units

MARK = "▁"
#: Runs of marks with what follows; a line end is no part of any piece.
_WORDS = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
UNIT_BYTES, KEPT_WORDS, KEPT_PAIRS = 1 << 20, 600_000, 1_000_000


UNIGRAM, BPE = 1, 2


def _fields(raw: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = raw[at : at + size]
            at += size
        yield tag >> 3, value


def model_kind(path: str) -> int:
    """UNIGRAM or BPE, as the file says; an error for other types and for models that normalise their text.

    The encoder takes texts as they are, with one mark put first and marks in place of spaces.
    """
    # fixed values: field numbers of the file format; trainer 2 (type 3), normaliser 3 (map 2, first mark 3, spaces 4, marks 5)
    with open(path, "rb") as f:
        parts = dict((n, v) for n, v in _fields(f.read()) if n in (2, 3))
    trainer, rules = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"models of type {kind} are not supported")
    if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1):
        raise ValueError("models that normalise their text, or put no mark first, are not supported")
    return kind


def best_path(tail: str, before: list[tuple[float, int]], scores: dict[str, float], sizes: list[int], unknown: float) -> tuple[float, int]:
    """Viterbi's state of a word from those of all its shorter prefixes: its best score and the length of its last piece.

    ``tail`` is the word's end, as long as the longest piece at least, or the word. Of equal scores the longer last piece
    counts. A character that is no piece scores ``unknown``.
    """
    best = (before[-1][0] + scores.get(tail[-1], unknown), 1)
    for size in sizes:
        if 1 < size <= len(tail) and (score := scores.get(tail[-size:])) is not None:
            best = max(best, (before[-size][0] + score, size))
    return best


def trie_of(words: list[str]) -> Iterator[tuple[str, int]]:
    """The ends of the words in the trie, depth first: each word, and how many characters its path shares with that before.

    In the order of the words the paths are walked as in a tree of nodes, of which only the current path is held.
    """
    before = ""
    for word in sorted(words):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        yield word, shared
        before = word


class PieceTrie:
    """Encodes distinct words depth first over their trie, keeping the states of shared prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        self.kind = model_kind(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        self.bytes_of = [b""] * n
        self.byte_id, self.id, self.rank, self.score = [model.unk_id()] * 256, {}, {}, {}
        for i, text in enumerate(texts):
            if model.is_byte(i):
                self.byte_id[int(text[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(text[1:-1], 16)])
            elif not model.is_control(i) and not model.is_unknown(i):
                self.id[text] = i
                self.rank[text] = 0.0 if len(text) == 1 else -model.get_score(i) + 1
                self.score[text] = model.get_score(i)
                self.bytes_of[i] = text.replace(MARK, " ").encode()
        self.bytes_of[model.unk_id()] = " ⁇ ".encode()
        self.unknown = min(self.score.values(), default=0.0) - 10.0  # fixed value: the library's penalty
        self.sizes = sorted({len(t) for t in self.id})
        lengths = defaultdict(set)
        for text in self.id:
            if len(text) > 1:
                lengths[text[-3:]].add(len(text))
        for end, found in lengths.items():
            if len(end) == 3 and end[1:] in self.id:
                found.add(2)
        self.lengths = {end: sorted(found, reverse=True) for end, found in lengths.items()}
        self.longest = max(self.sizes, default=1)
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.apart: dict[tuple[str, str], bool] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merging makes the piece; None if merging its characters doesn't."""
        if piece not in self.halves:
            parts, last = list(piece), None
            while len(parts) > 1:
                found = [(self.rank.get(a + b, np.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(found)
                if rank == np.inf:
                    break
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = last if len(parts) == 1 and all(c in self.rank for c in piece) else None
        return self.halves[piece]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether merging the characters of both ends in just ``a`` and ``b``.

        Both are taken apart along their border, the part merged last first; a
        pair across the border must not have come sooner than that merge.
        """
        key = (a, b)
        known = self.apart.get(key)
        if known is None:
            rank, limit, known = self.rank, np.inf, True
            while a in rank and b in rank:
                across = rank.get(a + b)
                if across is not None and across < limit:
                    known = False
                    break
                if rank[a] > rank[b]:
                    limit = rank[a]
                    a = self.split(a)[1]
                elif rank[b]:
                    limit = rank[b] + 0.5  # of two equal merges the left one comes first
                    b = self.split(b)[0]
                else:
                    break
            if len(self.apart) > KEPT_PAIRS:
                self.apart.clear()
            self.apart[key] = known
        return known

    def last_piece(self, tail: str, before: list[str]) -> str:
        """The piece that the merging of a word ends in, from those of all its shorter prefixes; ``tail`` is its end."""
        rank, apart, i = self.rank, self.apart, len(tail)
        for n in (self.lengths.get(tail[-3:]) or (2,)) if i > 2 else (2,):
            if n > i:
                continue
            longer = tail[-n:]
            if longer in rank:
                last = before[-n]  # empty where the piece is the whole word
                good = apart.get((last, longer))
                if good is None:
                    good = self.split(longer) is not None and self.stay_apart(last, longer)
                    apart[last, longer] = good
                if good:
                    return longer
        return tail[-1]

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each of the distinct words as packed 32-bit numbers."""
        out: dict[str, bytes] = {}
        if self.kind == BPE:
            start, state, length = "", self.last_piece, len
        else:
            start, state, length = (0.0, 0), lambda tail, before: best_path(tail, before, self.score, self.sizes, self.unknown), itemgetter(1)
        states = [start]
        for word, shared in trie_of(words):
            del states[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                states.append(state(word[max(0, i - self.longest) : i], states))
            out[word] = self._ids(word, list(map(length, states)))
        return out

    def _ids(self, word: str, last: list[int]) -> bytes:
        """The ids of a word's pieces, back from its end by the lengths of the last pieces."""
        ids, at = [], len(word)
        while at:
            piece = word[at - last[at] : at]
            if piece in self.id:
                ids.append(self.id[piece])
            else:
                ids += [self.byte_id[x] for x in reversed(piece.encode())]
            at -= last[at]
        return array("i", ids[::-1]).tobytes()


def encode_pieces(docs: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the ids that the model's library gives for the text.

    Texts of any length are cut at their marks into words, which encode alone;
    the distinct new words of some megabytes of text are sorted and encoded
    together, and a bounded number of words is remembered. Null and empty texts
    have no ids. Rows may repeat; other columns are kept, a column named as
    ``out`` is replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    return docs.select(*kept).mapInArrow(_encoder(path, kept, column, out), _with(docs.select(*kept), out, ArrayType(IntegerType())))


def _with(docs: DataFrame, out: str, kind) -> StructType:
    return StructType([*docs.schema.fields, StructField(out, kind)])


def _encoder(path: str, kept: list[str], column: str, out: str):
    def run(batches):
        trie, known = PieceTrie(path), {}
        named = (b.rename_columns(["text" if c == column else f"_{c}" for c in b.schema.names]) for b in batches)
        for piece, _, _ in in_units(named, UNIT_BYTES):
            texts = piece.column("text").to_pylist()
            words = [_WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
            if len(known) > KEPT_WORDS:
                known.clear()
            known.update(trie.encode(list({w for found in words for w in found if w not in known})))
            parts = [b"".join(map(known.__getitem__, found)) for found in words]
            bounds = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*piece.columns, ids], [*kept, out])

    return run


def decode_pieces(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``, the text that the ids stand for; null ids give an empty text.

    The mark that encoding puts first is taken off, and bytes that are no UTF-8
    become U+FFFD. Ids past the vocabulary are an error.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != out]
    return docs.select(*kept).mapInArrow(_decoder(path, kept, ids, out), _with(docs.select(*kept), out, StringType()))


def _decoder(path: str, kept: list[str], ids: str, out: str):
    def run(batches):
        table = PieceTrie(path).bytes_of
        size = np.array([len(x) for x in table], np.int64)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(table), np.uint8)
        # a single byte past ASCII may make no character
        lone = np.array([len(x) == 1 and x[0] > 0x7F for x in table])
        marked = np.array([x[:1] == b" " for x in table])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                column = piece.column(kept.index(ids))
                found = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.array(column.value_lengths().fill_null(0), np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                firsts = bounds[:-1][counts > 0]
                skip = np.zeros(len(found), np.int64)
                skip[firsts] = marked[found[firsts]]
                length = size[found] - skip
                ends = np.cumsum(length)
                total = int(ends[-1]) if len(ends) else 0
                spots = np.repeat(start[found] + skip - (ends - length), length) + np.arange(total)
                raw = data[spots].tobytes()
                cuts = np.concatenate([[0], ends])[bounds]
                strange = np.add.reduceat(np.append(lone[found], False).astype(np.int64), bounds[:-1]) * (counts > 0) if len(found) else np.zeros(len(counts), np.int64)
                if strange.any():
                    texts = pa.array([raw[x:y].decode(errors="replace") for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())
                else:
                    texts = pa.StringArray.from_buffers(len(counts), pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([*piece.columns, texts], [*kept, out])

    return run


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids`` of the column ``text`` and ``decoded``, in one pass over the rows.

    Null and empty texts have no ids and decode to an empty text. Rows may repeat; other columns are kept, those named as
    the new ones are replaced; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    encode, decode = _encoder(path, kept, "text", "ids"), _decoder(path, [*kept, "ids"], "ids", "decoded")
    schema = StructType([*docs.select(*kept).schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return docs.select(*kept).mapInArrow(lambda batches: decode(encode(batches)), schema)


def op5_piece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    path = tokenizer_path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = encode_and_decode(docs, path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.lower(F.hex(F.xxhash64("ids"))).alias("ids_xxhash64"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.translate("text", MARK, " ")).alias("round_trip"),
    )
