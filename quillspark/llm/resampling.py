"""Importance resampling of documents towards a target: hashed runs of words weigh how much likelier the target has them.

Features are runs of one to three words; a bucket is the crc32 of the run modulo ``buckets``. The texts of a piece of the
input are joined with a separator that no word holds; one regular expression finds all words, a search in the documents'
offsets gives each word's document, and runs that reach into the next document are masked. The crc32 of a run is put
together from those of its words (crc32 is linear: moving a checksum past n bytes is a table lookup), so no run is ever
built as a string. Bucket counts of the corpus and the target are two vectors of fixed length; a second pass over the texts
sums each document's gains. Seeded Gumbel noise turns weights into a draw without replacement, whose ranks come from a
distributed numbering. Words of a piece are worked on in blocks, so memory depends neither on texts nor on their number.

Null and empty texts have no features, weight 0, and are never drawn; a null id counts as an empty one in the seed. Rows
that repeat are scored each by itself with the same noise; ties go to the smaller id. An empty corpus gives an empty result,
an empty target leaves all its buckets at the added one. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.numbering import numbered

from .base import stored
from .batches import pieces, raw_texts

#: ASCII letters and digits and everything beyond ASCII, in bytes that are in lower case.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\x00"
BUCKETS = 10_000
PIECE_BYTES = 4_000_000
BLOCK = 1 << 18
#: Words up to so many bytes are summed side by side, longer ones one by one.
SIDE_BY_SIDE = 32
DIGIT = 6


@cache
def _step() -> np.ndarray:
    """What a byte does to a checksum's low end."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The linear map with the given tables of four bytes."""
    return table[0][x & 255] ^ table[1][(x >> 8) & 255] ^ table[2][(x >> 16) & 255] ^ table[3][x >> 24]


@cache
def _shifts() -> list[np.ndarray]:
    """For each digit of a length in base 64: maps that move a checksum past digit x 64^place bytes."""
    step = _step()
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    move, out = step[one & 255] ^ (one >> np.uint32(8)), []
    for _ in range(5):
        level = [one]
        for _ in range((1 << DIGIT) - 1):
            level.append(_apply(move, level[-1]))
        out.append(np.stack(level))
        move = _apply(move, level[-1])
    return out


def shifted(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums moved past so many bytes; with the checksum of these bytes added (xor) it is that of both in a row."""
    for place, maps in enumerate(_shifts()):
        rest = lengths >> (DIGIT * place)
        if place:
            at = np.flatnonzero(rest)
            if not len(at):
                break
            sums = sums.copy()
            sums[at] = _moved(maps, rest[at] & 63, sums[at])
        else:
            sums = _moved(maps, rest & 63, sums)
    return sums


def _moved(maps: np.ndarray, digit: np.ndarray, x: np.ndarray) -> np.ndarray:
    cells, base = maps.reshape(-1), digit.astype(np.int64) << 10
    out = cells[base | (x & 255)]
    for k in range(1, 4):
        out ^= cells[base | (k << 8) | ((x >> np.uint32(8 * k)) & 255)]
    return out


def checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of each word of the buffer."""
    step, order = _step(), np.argsort(-lengths, kind="stable")
    long = int(np.searchsorted(-lengths[order], -SIDE_BY_SIDE, side="left"))
    at, size = starts[order[long:]], lengths[order[long:]]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))  # longer than j
        state[:n] = step[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order[long:]] = ~state
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]])
    return out


def features(texts: list[bytes], buckets: int = BUCKETS):
    """(document, bucket) arrays of all features of the texts, block by block; and first, for each document, its words."""
    buf = SEPARATOR.join(texts).lower()
    data = np.frombuffer(buf, np.uint8)
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    spans = np.fromiter((m.start() << 32 | m.end() for m in WORDS.finditer(buf)), np.int64)
    starts = spans >> 32
    lengths = (spans & 0xFFFFFFFF) - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    yield np.bincount(owner, minlength=len(texts)), None
    space = np.uint32(zlib.crc32(b" "))
    for lo in range(0, len(starts), BLOCK):
        hi = min(len(starts), lo + BLOCK)
        s, size, own = starts[lo : hi + 2], lengths[lo : hi + 2], owner[lo : hi + 2]
        run = word = checksums(data, s, size)
        spaced = shifted(np.full(len(s), space), size) ^ word
        yield own[: hi - lo], run[: hi - lo] % np.uint32(buckets)
        for k in (1, 2):
            n = min(hi - lo, len(s) - k)
            run = shifted(run[:n], size[k : k + n] + 1) ^ spaced[k : k + n]
            inside = own[:n] == own[k : k + n]
            yield own[:n][inside], run[inside] % np.uint32(buckets)


def _counter(buckets: int, most: int):
    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches, most):
            for _, bucket in features(raw_texts(b), buckets):
                if bucket is not None:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return count


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """How many features of all texts each bucket has; a vector of ``buckets`` numbers."""
    part = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counter(buckets, piece_bytes), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of add-one shares, rounded down."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + n) / ((int(a) + 1) * (t + n)))) for a, b in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id, seed: int) -> int:
    """Seeded Gumbel noise of an id in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, seed: int, most: int):
    def score(batches):
        for b in pieces(batches, most):
            texts = raw_texts(b)
            found, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            words = None
            for own, bucket in features(texts, len(gain)):
                if bucket is None:
                    words = own
                    continue
                found += np.bincount(own, minlength=len(texts))
                weight += np.bincount(own, gain[bucket], minlength=len(texts))
            weight = weight.astype(np.int64)
            score = weight + np.array([noise(i, seed) for i in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (words, found, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return score


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", share: tuple[int, int] = (5, 100), min_words: int = 20, buckets: int = BUCKETS, seed: int = 42, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document; rank is null but for the drawn ones.

    Of the documents with ``min_words`` words or more, the share with the highest scores is drawn."""
    gain = gains(bucket_counts(docs, text, buckets, piece_bytes), bucket_counts(target, "text", buckets, piece_bytes))
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = stored(given.mapInArrow(_scorer(gain, seed, piece_bytes), f"doc_id {kind}, n_words long, n_features long, weight long, score long"), "resampled")
    fit = F.col("n_words") >= min_words
    drawn = scored.filter(fit).count() * share[0] // share[1]
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    ranked = numbered(scored.filter(fit), order, "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, ranked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that were drawn, whole, with their rank. Ids must tell documents apart."""
    return docs.drop("rank").join(ranked.filter("rank is not null").select(F.col("doc_id").alias("_drawn"), "rank"), F.col(doc_id) == F.col("_drawn")).drop("_drawn")
