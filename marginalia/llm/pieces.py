"""SentencePiece encoding and decoding over a relational lattice.

Texts become words, cut only where no piece of the vocabulary can cross.  Every
distinct word is exploded into its substrings of bounded length, an equi-join with
the piece table keeps those that are pieces (the edges), edges are grouped by word,
and a Viterbi pass over the words of a bucket picks the path of the largest score
sum; of equal paths the one with the longer last piece.  Documents become blocks
of word numbers, which stay where they are written; the distinct words of a block go,
one text per bucket of words, to the bucket's lattice, and their ids come back packed.

Files of the unigram kind bring their scores.  A file trained by pair merges only
ranks its pieces; they get the log-probabilities of Zipf's law over the rank and a
fixed ``COST`` a piece, so that the best path may differ from the merge order.
Characters without a piece become their bytes' pieces.

Defined results.  Null and empty texts have no pieces and decode to the empty text.
Blanks become U+2581, with one put in front as the model asks; a U+2581 of the text
itself decodes to a blank.  Rows repeat as given, ids may be null, extra columns are
ignored.  Words of more than ``LONGEST`` characters take the same pass in an Arrow
function, whose state is linear.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import stage_dealt

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
LONGEST = 128
COST = 5.0
BLOCK_CHARS = 1 << 24
NO_PIECE = (1 << 31) - 1  # the id of a character that no piece is
WORDS_AT_ONCE = 8192


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by text with their id and score; at most a vocabulary file's worth, about 1 MB."""

    pieces: dict[str, tuple[int, float]]
    texts: list[str]  # by id; control pieces are empty
    byte_ids: list[int]
    unknown: float
    longest: int
    prefix: bool
    words: str  # expression of the words of a text

    @cached_property
    def scores(self) -> np.ndarray:
        """Scores by id; 0 where an id is no piece of a text."""
        out = np.zeros(len(self.texts))
        for i, s in self.pieces.values():
            out[i] = s
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p, i) for p, (i, _) in self.pieces.items()], "piece string, id int")


def load(path: str = MODEL) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    merges = model.trainer_spec.model_type == 2
    raw = (lambda x: -math.log(1 - max(x, -1e6)) - COST) if merges else float
    score = lambda x: round(raw(x) * 2**20) / 2**20  # noqa: E731  sums of these are exact, so equal paths tie
    normal = {p.piece: (i, score(p.score)) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
    byte_ids = [0] * 256
    for i, p in enumerate(model.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
    # Signs that no piece has after another character than a sign or blank begin a word of their own.
    signs = {c for p in normal for c in p if not c.isalnum() and c != BLANK} | {"\n"}
    pairs = {(a, b) for p in normal for a, b in zip(p, p[1:])}
    while bad := {b for a, b in pairs if b in signs and a not in signs and a != BLANK}:
        signs -= bad
    s = re.escape("".join(sorted(signs)))
    return Vocabulary(
        normal, [p.piece if p.type in (1, 4) else "" for p in model.pieces], byte_ids, min(s for _, s in normal.values()) - 10.0,
        max(map(len, normal)), model.normalizer_spec.add_dummy_prefix,
        # No letter or figure is a sign: naming them spares a look through all signs for each.
        f"{BLANK}+(?:[0-9A-Za-z]+|[{s}]*)[^{BLANK}{s}]*|[{s}]+[0-9A-Za-z]*[^{BLANK}{s}]*|[^{BLANK}{s}]+")


def normalised(text: str | None, prefix: bool) -> str:
    text = (text or "").replace(" ", BLANK)
    return BLANK + text if text and prefix else text


def buckets_of(spark: SparkSession) -> int:
    """How many buckets the words are dealt to by their hash."""
    return max(512, int(spark.conf.get("spark.sql.shuffle.partitions")))


def blocks(docs: DataFrame, vocab: Vocabulary, buckets: int) -> DataFrame:
    """``block, docs, at, words``: a run of documents, its word numbers, packed, and its distinct words.

    ``words`` holds one text per bucket: the block's number and the words of that bucket,
    sorted, with a blank between, as no word has one.  Words are numbered in this order.
    """
    split, prefix = re.compile(vocab.words), vocab.prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        # The blocks of a task count up from its partition's number: no two tasks share a name.
        names = count(TaskContext.get().partitionId() << 32)

        def flush(ids: list, sums: list, at: list, number: dict) -> pa.RecordBatch:
            name, dealt = next(names), [[] for _ in range(buckets)]
            for w in sorted(number):
                dealt[zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets].append(w)
            place = np.empty(len(number), np.uint32)
            place[np.fromiter((number[w] for words in dealt for w in words), np.int64, len(number))] = np.arange(len(number))
            n = np.array([len(a) for a in at], np.int64)
            planes = place[np.concatenate([*at, np.zeros(0, np.uint32)])].view(np.uint8).reshape(-1, 4).T.tobytes()
            meta = pa.array([{"id": i, "crc": c, "n": k} for i, c, k in zip(ids, sums, n.tolist(), strict=True)],
                            pa.struct([("id", pa.int64()), ("crc", pa.int64()), ("n", pa.int64())]))
            texts = pa.array([{"bucket": b, "text": " ".join([str(name), *words])} for b, words in enumerate(dealt) if words],
                             pa.struct([("bucket", pa.int32()), ("text", pa.string())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), pa.ListArray.from_arrays([0, len(meta)], meta), pa.array([pack.compress(planes)], pa.binary()),
                 pa.ListArray.from_arrays([0, len(texts)], texts)], ["block", "docs", "at", "words"])

        ids, sums, at, number, size = [], [], [], {}, 0
        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                text = normalised(t.as_py(), prefix)
                if ids and size + len(text) > BLOCK_CHARS:
                    yield flush(ids, sums, at, number)
                    ids, sums, at, number, size = [], [], [], {}, 0
                ids.append(i.as_py())
                sums.append(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                at.append(np.fromiter((number.setdefault(w, len(number)) for w in split.findall(text)), np.uint32))
                size += len(text)
        if ids:
            yield flush(ids, sums, at, number)

    schema = "block bigint, docs array<struct<id:bigint,crc:bigint,n:bigint>>, at binary, words array<struct<bucket:int,text:string>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def edges(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``bucket, word, edges``: every piece inside every word, and every character, as one number of its end, start and id."""
    spots = words.select("bucket", "word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    last = F.least(F.lit(vocab.longest), F.length("word") - F.col("at") + 1)
    cuts = spots.select("bucket", "word", "at", F.explode(F.sequence(F.lit(1), last)).alias("n")).select(
        "bucket", "word", "at", "n", F.substring("word", F.col("at"), F.col("n")).alias("piece"))
    table = F.broadcast(vocab.table(words.sparkSession))  # a vocabulary file, of fixed size
    # A character without a piece keeps its edge, so every word has a path.
    found = cuts.join(table, "piece", "left").filter("id IS NOT NULL OR n = 1")
    edge = F.shiftleft((F.col("at") + F.col("n") - 1).cast("long"), 48) + F.shiftleft((F.col("at") - 1).cast("long"), 32) + F.coalesce("id", F.lit(NO_PIECE))
    return found.groupBy("bucket", "word").agg(F.collect_list(edge).alias("edges"))


def best_paths(words: list[str], lattice: pa.ListArray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of every word on the path with the largest score sum, one after the other, and how many each has.

    All words advance together, one position a step.
    """
    size = np.array([len(w) for w in words], np.int64)
    edge = lattice.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    word = np.repeat(np.arange(len(words)), lattice.value_lengths().to_numpy(zero_copy_only=False))
    order = np.lexsort((edge & (1 << 48) - 1, word, edge >> 48))
    edge, word = edge[order], word[order]
    end, start, piece = edge >> 48, edge >> 32 & 0xFFFF, edge & 0xFFFFFFFF
    score = np.where(piece == NO_PIECE, vocab.unknown, vocab.scores[np.where(piece == NO_PIECE, 0, piece)])
    sums = np.zeros((len(words), int(size.max(initial=0)) + 1))
    came, took = np.zeros(sums.shape, np.int16), np.zeros(sums.shape, np.int32)
    cut = np.searchsorted(end, np.arange(1, sums.shape[1] + 1))
    for at, (lo, hi) in enumerate(zip(cut, cut[1:]), 1):
        w = word[lo:hi]
        total = sums[w, start[lo:hi]] + score[lo:hi]
        first = np.flatnonzero(np.diff(w, prepend=-1))
        best = np.maximum.reduceat(total, first) if len(first) else total
        hit = np.flatnonzero(total == np.repeat(best, np.diff(first, append=len(w))))
        hit = hit[np.flatnonzero(np.diff(w[hit], prepend=-1))]  # of equal ones the earliest start
        sums[w[hit], at], came[w[hit], at], took[w[hit], at] = total[hit], start[lo:hi][hit], piece[lo:hi][hit]
    live, at, steps = np.arange(len(words)), size.copy(), []
    while len(live := live[at[live] > 0]):
        steps.append((live, at[live], took[live, at[live]]))
        at[live] = came[live, at[live]]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    word, at, ids = (np.concatenate(x) for x in zip(*steps))
    order = np.lexsort((at, word))
    word, at, ids = word[order], at[order], ids[order]
    lone = ids == NO_PIECE
    if lone.any():
        raw = [words[w][i - 1].encode("utf-8", "surrogatepass") for w, i in zip(word[lone].tolist(), at[lone].tolist())]
        times = np.ones(len(ids), np.int64)
        times[lone] = [len(r) for r in raw]
        word, ids, lone = np.repeat(word, times), np.repeat(ids, times), np.repeat(lone, times)
        ids[lone] = [vocab.byte_ids[b] for r in raw for b in r]
    return ids, np.bincount(word, minlength=len(words))


def viterbi(word: str, vocab: Vocabulary) -> list[int]:
    """The same pass over one long word."""
    sums, came = [0.0], [(-1, -1)]
    for end in range(1, len(word) + 1):
        best, how = None, (end - 1, -1)
        for start in range(max(0, end - vocab.longest), end):
            hit = vocab.pieces.get(word[start:end])
            if hit and (best is None or sums[start] + hit[1] > best):
                best, how = sums[start] + hit[1], (start, hit[0])
        if word[end - 1] not in vocab.pieces and (best is None or sums[end - 1] + vocab.unknown > best):
            best, how = sums[end - 1] + vocab.unknown, (end - 1, -1)
        sums.append(best)
        came.append(how)
    out, at = [], len(word)
    while at > 0:
        start, piece = came[at]
        out.extend([piece] if piece >= 0 else [vocab.byte_ids[b] for b in reversed(word[start:at].encode("utf-8", "surrogatepass"))])
        at = start
    return out[::-1]


def packed_ids(lists: list[bytes]) -> bytes:
    """Lists of 32-bit ids as their lengths and ids, byte by byte of the numbers, compressed."""
    n = np.array([len(x) >> 2 for x in lists], "<u4")
    flat = np.concatenate([n, np.frombuffer(b"".join(lists), "<u4")]).astype("<u4")
    return len(n).to_bytes(4, "little") + zstandard.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), 6)


def unpacked_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and ids of ``packed_ids``."""
    n = int.from_bytes(data[:4], "little")
    flat = np.frombuffer(zstandard.decompress(data[4:]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int32)
    return flat[:n], flat[n:]


def encode_words(packs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``block, bucket, ids``: the ids of the words of every text of ``packs``, packed.

    ``packs`` are dealt by bucket; its distinct words, their lattice and the answers
    stay in that partition.
    """
    texts = packs.groupBy("bucket").agg(F.collect_list("text").alias("texts"))
    words = packs.select("bucket", F.explode(F.split("text", " ")).alias("word"))
    # A block's number is no word of the lattice: no answer is asked for it.
    short = words.filter(F.length("word") <= LONGEST).distinct()
    paths = edges(short, vocab).groupBy("bucket").agg(F.collect_list("word").alias("words"), F.collect_list("edges").alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words, lattice = batch.column(2)[r].as_py() or [], batch.column(3)[r].values
                known = {}
                for lo in range(0, len(words), WORDS_AT_ONCE):
                    some = words[lo : lo + WORDS_AT_ONCE]
                    ids, n = best_paths(some, lattice[lo : lo + WORDS_AT_ONCE], vocab)
                    data, to = ids.astype("<u4").tobytes(), np.cumsum(n) * 4
                    known.update((w, data[a:b]) for w, a, b in zip(some, [0, *to.tolist()], to.tolist()))
                out = ([], [], [])
                for text in batch.column(1)[r]:
                    block, *asked = text.as_py().split(" ")
                    for w in {w for w in asked if len(w) > LONGEST}:
                        known[w] = np.array(viterbi(w, vocab), "<u4").tobytes()
                    for column, v in zip(out, (int(block), batch.column(0)[r].as_py(), packed_ids([known[w] for w in asked])), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["block", "bucket", "ids"])

    return texts.join(paths, "bucket").select("bucket", "texts", "words", "edges").mapInArrow(run, "block bigint, bucket int, ids binary")


def decode_ids(ids: np.ndarray, vocab: Vocabulary, bytes_of: dict[int, int]) -> str:
    out, raw = [], bytearray()
    for i in ids.tolist():
        if i in bytes_of:
            raw.append(bytes_of[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
            raw = bytearray()
        out.append(vocab.texts[i])
    if raw:
        out.append(raw.decode("utf-8", "surrogatepass"))
    return "".join(out)


def encode(docs: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, ids, n_pieces`` and ``round_trip``: decoding gave the text back; if it does not, this fails."""
    vocab = vocab or load()
    spark, parts = docs.sparkSession, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = buckets_of(spark)
    packed = stage_dealt(blocks(docs, vocab, buckets), "block", parts, "blocks")
    packs = packed.select(F.explode("words").alias("x")).select("x.bucket", "x.text")
    coded = encode_words(packs.repartition(min(buckets, 4 * parts), "bucket"), vocab)
    known = coded.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("known"))
    rows = packed.select("block", "docs", "at").join(known, "block", "left").select("docs", "at", "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in enumerate(vocab.byte_ids)}
        pieces, byte_ids = pa.array(vocab.texts, pa.string()), np.array(vocab.byte_ids)
        for batch in batches:
            for r in range(batch.num_rows):
                meta = batch.column(0)[r].as_py()
                flat = np.frombuffer(zstandard.decompress(batch.column(1)[r].as_py()), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
                lists = [unpacked_ids(x["ids"]) for x in sorted(batch.column(2)[r].as_py() or [], key=lambda x: x["bucket"])]
                size = np.concatenate([*(n for n, _ in lists), np.zeros(0, np.int32)]).astype(np.int64)
                values = np.concatenate([*(v for _, v in lists), np.zeros(0, np.int32)])
                offset = np.concatenate(([0], np.cumsum(size)))
                # The texts of all words at once; those with bytes among their pieces one by one.
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pieces.take(pa.array(values))), "")
                raw = np.unique(np.searchsorted(offset, np.flatnonzero(np.isin(values, byte_ids)), "right") - 1)
                if len(raw):
                    mask = np.zeros(len(size), bool)
                    mask[raw] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([decode_ids(values[offset[w] : offset[w + 1]], vocab, bytes_of) for w in raw], pa.string()))
                lo, out = 0, ([], [], [], [])
                for d in meta:
                    mine = flat[lo : lo + d["n"]]
                    lo += d["n"]
                    n = size[mine]
                    spot = np.repeat(offset[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    text = texts.take(pa.array(mine))
                    ends = np.frombuffer(text.buffers()[1], np.int32)[: len(text) + 1] if len(text) else [0, 0]
                    if zlib.crc32(memoryview(text.buffers()[2])[ends[0] : ends[-1]] if ends[-1] else b"") != d["crc"]:
                        raise ValueError(f"pieces of document {d['id']} do not give its text back")
                    for column, v in zip(out, (d["id"], values[spot].astype(np.int32), int(n.sum()), True), strict=True):
                        column.append(v)
                    if len(out[0]) == 512:
                        yield batch_of(out)
                        out = ([], [], [], [])
                yield batch_of(out)

    def batch_of(out: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())],
                                          ["doc_id", "ids", "n_pieces", "round_trip"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode(coded: DataFrame, vocab: Vocabulary | None = None) -> DataFrame:
    """``doc_id, text`` of encoded documents."""
    vocab = vocab or load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {i: b for b, i in enumerate(vocab.byte_ids)}
        for batch in batches:
            texts = [decode_ids(np.array(x.as_py() or [], np.int64), vocab, bytes_of).replace(BLANK, " ") for x in batch.column(1)]
            texts = [t[1:] if vocab.prefix and t else t for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
