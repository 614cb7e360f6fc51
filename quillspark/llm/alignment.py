"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and of a piece BPE with byte fallback (B) end together.

A text, with a space before it, is cut into groups wherever tokens of both end at the same byte; the two tokens that end
a group are linked. How often a pair of ids is linked is counted over the corpus, and each document is measured by how
common its links are.

Identity path: an A id has at most one B id of the same bytes, known beforehand. A group of one A and one B token that are
such a pair is counted in a vector as long as A's vocabulary; only the links of other groups become (pair, count) rows, a
pair once for each piece of the input, and are shuffled. Their counts come back to the pieces by the same rows.

Both tokenizers are run once for each distinct segment of a piece: neither joins bytes across a space that follows anything
but white space (merges of B never go into a space mark, A's pattern takes a space with what follows), so texts are cut
there; a text's tokens and groups are those of its segments in a row, and the end of a segment always ends a group.

Null and empty texts, and texts that either tokenizer does not give back byte for byte (U+2581 is a space to B), have no
tokens and link nothing. Ids may be null or repeat; every row counts by itself. Special tokens' strings are plain text. An
empty table gives an empty result. Other columns are not looked at. What the driver sees: a number for each id of a vocabulary.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored
from .batches import pieces, slices
from .tokens import packed, unpacked

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
PIECE_BYTES = 3_000_000
#: Segments encoded at a time.
ENCODED = 4096
#: Pairs of ids are one number: a * WIDE + b.
WIDE = 1 << 20


class Vocabularies:
    """Both tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        # An empty text gets no space mark, so a space alone is cut from a longer one.
        self.space = self.b.encode("x ")[len(self.b.encode("x")) :]
        visible = _byte_letters()
        a_bytes = [bytes(visible[c] for c in t) if (t := self.a.id_to_token(i)) and all(c in visible for c in t) else b"" for i in range(self.a.get_vocab_size())]
        b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(len(b_bytes)), key=self.b.is_byte):  # a piece goes before the byte of the same value
            by_bytes.setdefault(b_bytes[i], i)
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in a_bytes], np.int64)
        self.a_bytes, self.b_bytes = (pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes))
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (a_bytes, b_bytes))
        # Ids as they are written: inside a group, and at the end of its A and of its B part.
        written = [f"{i}{end}".encode() for n, ends in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for end in ends for i in range(n)]
        self.written = pa.array(written, pa.large_binary())

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode()


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


@cache
def vocabularies(a_file: str, b_file: str) -> Vocabularies:
    return Vocabularies(a_file, b_file)


def segment_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where texts may be cut: at their starts, and at spaces after a character that is no white space of any kind."""
    before = np.zeros((3, len(data)), np.uint8)
    for k in range(3):
        before[k, k + 1 :] = data[: max(0, len(data) - k - 1)]
    one, two, three = before
    # The last bytes of wide white space; quotes and dashes that share their first bytes are only not cut after.
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three >= 0xE1) & (three <= 0xE3) & ((two == 0x80) | (two == 0x81) | (two == 0x9A)))
    cut = (data == 0x20) & (one > 0x20) & ~((one >= 0x80) & wide)
    cut[texts] = True
    return np.flatnonzero(cut)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((i for x in ids for i in x), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def _given_back(table: pa.Array, size: np.ndarray, ids: np.ndarray, counts: np.ndarray, segments: pa.Array) -> np.ndarray:
    """Which segments equal the bytes of their tokens."""
    cells = pc.take(table, pa.array(ids))
    upto = np.concatenate([[0], np.cumsum(size[ids])])
    joined = slices(upto[np.concatenate([[0], np.cumsum(counts)])], cells.buffers()[2] or pa.py_buffer(b""))
    return pc.equal(joined, segments).to_numpy(zero_copy_only=False)


class Groups:
    """Groups of distinct segments: how many tokens and groups each has, how it is written, and its links."""

    def __init__(self, v: Vocabularies, segments: pa.Array):
        texts = segments.cast(pa.large_string()).to_pylist()
        a, n_a = _flat([e.ids for lo in range(0, len(texts), ENCODED) for e in v.a.encode_batch_fast(texts[lo : lo + ENCODED], add_special_tokens=False)])
        found = v.b.encode([t[1:] for t in texts], num_threads=1)  # it adds the space itself
        b, n_b = _flat([v.space if t == " " else ids for t, ids in zip(texts, found, strict=True)])
        self.whole = _given_back(v.a_bytes, v.a_size, a, n_a, segments) & _given_back(v.b_bytes, v.b_size, b, n_b, segments)
        a, b = a[np.repeat(self.whole, n_a)], b[np.repeat(self.whole, n_b)]
        self.n_a, self.n_b = n_a * self.whole, n_b * self.whole
        # Places in all whole segments in a row.
        a_end, b_end = np.cumsum(v.a_size[a]), np.cumsum(v.b_size[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        a_last, b_last = ends[a_group] == a_end, ends[b_group] == b_end
        owner = np.repeat(np.arange(len(texts)), self.n_a)[a_last]
        self.n_groups = np.bincount(owner, minlength=len(texts))
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        wide_a, wide_b = len(v.a_bytes), len(v.b_bytes)
        written = np.concatenate([a + wide_a * a_last, 2 * wide_a + b + wide_b * b_last])[order]
        cells = pc.take(v.written, pa.array(written))
        upto = np.frombuffer(cells.buffers()[1], np.int64)[: len(written) + 1]
        tokens = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        self.written = slices(upto[tokens], cells.buffers()[2] or pa.py_buffer(b""))
        alone = (np.bincount(a_group, minlength=len(ends)) == 1) & (np.bincount(b_group, minlength=len(ends)) == 1)
        a_link, b_link = a[a_last], b[b_last]
        same = alone & (v.same[a_link] == b_link)
        self.same, self.same_owner = a_link[same], owner[same]
        self.pairs, self.pair_owner = a_link[~same] * WIDE + b_link[~same], owner[~same]


def _chunks(a_file: str, b_file: str, most: int):
    """A row for each piece: its documents, their segments, and what the distinct segments link."""

    def cut(batches):
        from pyspark import TaskContext

        v, serial = vocabularies(a_file, b_file), TaskContext.get().partitionId() << 32
        for piece in pieces(batches, most):
            texts = [b" " + t.encode() if t else b"" for t in piece.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            data = b"".join(texts)
            firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
            starts = segment_starts(np.frombuffer(data, np.uint8), firsts)
            coded = slices(np.append(starts, len(data)), pa.py_buffer(data)).dictionary_encode()
            used = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            g = Groups(v, coded.dictionary)
            owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
            broken = np.bincount(owner, ~g.whole[used], minlength=len(texts)) > 0
            used, owner = used[~broken[owner]], owner[~broken[owner]]
            times = np.bincount(used, minlength=len(coded.dictionary))
            same = np.bincount(g.same, times[g.same_owner], minlength=len(v.same)).astype(np.int64)
            pairs, at = np.unique(g.pairs, return_inverse=True)
            n = np.bincount(at, times[g.pair_owner], minlength=len(pairs)).astype(np.int64)
            some = np.flatnonzero(same)
            serial += 1
            ids = piece.column("doc_id")
            docs = packed(np.asarray(ids.is_null().to_numpy(zero_copy_only=False), np.uint8), ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.bincount(owner, minlength=len(texts)).astype(np.int64), used.astype(np.int32))
            table = packed(*(x.astype(np.int32) for x in (g.n_a, g.n_b, g.n_groups, g.same, g.same_owner, at, g.pair_owner)))
            written = packed(np.diff(np.frombuffer(g.written.buffers()[1], np.int64)), np.frombuffer(g.written.buffers()[2] or b"", np.uint8))
            as_list = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([serial]), *(pa.array([x], pa.binary()) for x in (docs, table, written)), as_list(some), as_list(same[some]), as_list(pairs), as_list(n)], names=["chunk", "docs", "segments", "written", "ids", "id_times", "pairs", "pair_times"])

    return cut


_CHUNK = "chunk long, docs binary, segments binary, written binary, ids array<long>, id_times array<long>, pairs array<long>, pair_times array<long>"


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Exact whole sums for each owner."""
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, values)
    return out


def _scored(same: np.ndarray, links: np.ndarray, best: np.ndarray, texts: bool):
    """Rows of documents from pieces whose pairs know their counts. same: the B id of an A id; links: how often they are linked."""

    def score(batches):
        for b in batches:
            for docs, segments, written, pairs, counts in zip(*(b.column(c).to_pylist() for c in ("docs", "segments", "written", "pairs", "counts")), strict=True):
                null, ids, sizes, used = unpacked(docs)
                n_a, n_b, n_groups, alone, alone_owner, at, pair_owner = (x.astype(np.int64) for x in unpacked(segments))
                lengths, raw = unpacked(written)
                pair, count = np.array(pairs or [], np.int64), np.array(counts or [], np.int64)
                n = len(n_a)
                sums = _sums(links[alone], alone_owner, n) + _sums(count[at], pair_owner, n)
                top = _sums(links[alone] == best[same[alone]], alone_owner, n) + _sums((count == best[pair % WIDE])[at], pair_owner, n)
                owner = np.repeat(np.arange(len(ids)), sizes)
                cells = pc.take(slices(np.concatenate([[0], np.cumsum(lengths)]), pa.py_buffer(raw)), pa.array(used))
                text, ends = cells.buffers()[2] or pa.py_buffer(b""), np.frombuffer(cells.buffers()[1], np.int64)[: len(used) + 1]
                ends = ends[np.concatenate([[0], np.cumsum(sizes)])]
                whole = [text[int(lo) : max(int(lo), int(hi) - 1)] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
                groups = [x.to_pybytes().decode() if texts else hashlib.sha256(x).hexdigest() if len(x) else "" for x in whole]
                each = [_sums(x[used], owner, len(ids)) for x in (n_a, n_b, n_groups, n_groups, top, sums)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), *map(pa.array, each), pa.array(groups, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return score


def _by_id(df: DataFrame, size: int) -> np.ndarray:
    """A vector as long as a vocabulary from rows (id, n)."""
    out = np.zeros(size, np.int64)
    for r in df.collect():
        out[r["id"]] = r["n"]
    return out


class Alignment:
    """A corpus aligned once: ``documents()`` has a row for each document, ``links()`` one for each linked pair of ids."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, piece_bytes: int = PIECE_BYTES):
        given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        self.chunks = stored(given.mapInArrow(_chunks(a_file, b_file, piece_bytes), _CHUNK), "aligned")
        self.same = vocabularies(a_file, b_file).same
        self.wide_b = len(vocabularies(a_file, b_file).b_bytes)
        each = self.chunks.select(F.explode(F.arrays_zip("ids", "id_times")).alias("x")).groupBy(F.col("x.ids").alias("id")).agg(F.sum("x.id_times").alias("n"))
        self.identity = _by_id(each, len(self.same))
        self.held = self.chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "pair_times")).alias("place", "x")).select("chunk", "place", F.col("x.pairs").alias("pair"), F.col("x.pair_times").alias("n"))
        self.counts = stored(self.held.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")

    def links(self) -> DataFrame:
        """a, b, n, identity: how often the ids are linked in the corpus."""
        some = [(int(a), int(self.same[a]), int(self.identity[a]), True) for a in np.flatnonzero(self.identity)]
        known = self.counts.sparkSession.createDataFrame(some, "a long, b long, n long, identity boolean")
        return self.counts.select(F.floor(F.col("pair") / WIDE).alias("a"), (F.col("pair") % WIDE).alias("b"), F.col("count").alias("n"), F.lit(False).alias("identity")).union(known)

    def documents(self, groups: bool = False) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and ``groups`` written as a1,a2|b1;a3|b2,b3, or else groups_sha256."""
        best = _by_id(self.counts.groupBy((F.col("pair") % WIDE).alias("id")).agg(F.max("count").alias("n")), self.wide_b)
        np.maximum.at(best, self.same[self.identity > 0], self.identity[self.identity > 0])
        back = self.held.select("chunk", "place", "pair").join(self.counts, "pair").groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "count"))), lambda x: x["count"]).alias("counts"))
        rows = self.chunks.select("chunk", "docs", "segments", "written", "pairs").join(back, "chunk", "left")
        out = rows.mapInArrow(_scored(self.same, self.identity, best, groups), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
        return out if groups else out.withColumnRenamed("groups", "groups_sha256")
