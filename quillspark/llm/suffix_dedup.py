"""Suffix-array dedup: every byte of a 200-byte string that also starts anywhere else goes, whatever document it is in.

Prefix doubling, distributed: a position's rank is the name of the prefix that starts there; ranks of pairs (position,
position + length) name prefixes twice as long; positions whose rank is unique drop out, until the threshold is reached.

* Names are 64-bit hashes, so equal prefixes have equal ranks without a global sort of all positions. Positions are
  sampled first: a 200-byte window is represented by the least-ranked 100-byte prefix inside it (its anchor), which
  equal windows choose alike. Neighbouring windows with the same anchor form a stretch.
* Round 1, length 100: stretches are sorted by the rank of their anchor; unique ranks drop out. Stretches that occur
  twice as a whole are repeated, all windows of them.
* Round 2, length 200: for what is left, each window's rank is the pair (rank at p, rank at p + 100); windows of an
  anchor that also occurs in repeated stretches are compared with those as well.

A task sees, of one anchor, at most the distinct stretches; anchors that very many stretches have (counted over all
documents, a list of at most HOT_ENTRIES) are dealt by the stretch or window instead. Repeats inside a piece of the
input are settled there, so a common passage sends one row for each piece.

Null texts are empty. Texts of under 200 bytes keep everything. Repeated rows are repeats of each other: a text of 200
bytes or more that occurs twice goes completely, in all its rows. An empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stored
from .tokens import binaries, flat, mixed

HALF = 100
WHOLE = 2 * HALF
#: Bytes that are ranked together; longer texts are cut into overlapping blocks, so it bounds memory only.
PIECE_BYTES = 3_000_000
HOT_ENTRIES = 50_000
LOCAL_HOT = 8
SPREAD = 64

_TABLE = np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def names(data: np.ndarray, length: int, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Rank of the prefix of the given length at each position where it fits: a polynomial hash, mixed."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * forward[: len(data)])])
    return mixed((sums[length:] - sums[:-length]) * backward[: len(data) - length + 1])


def _windows(blocks: list[bytes]):
    """(joined bytes, starts, 100-byte ranks, mask of positions where a 200-byte window fits in its block)."""
    sizes = np.array([len(b) for b in blocks])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(blocks), np.uint8)
    n = len(data)
    rank = names(data, HALF, _powers(_BASE, n), _powers(_BACK, n))
    fits = np.zeros(n + 1, np.int32)
    np.add.at(fits, starts, 1)
    np.add.at(fits, starts + sizes - WHOLE + 1, -1)
    return data, starts, rank, np.cumsum(fits)[:n] > 0


def _doubled(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of the 200-byte windows at the positions given, from the pair of 100-byte ranks."""
    return mixed(rank[at] * np.uint64(_BASE) + rank[at + HALF])


def _least(keys: np.ndarray) -> np.ndarray:
    """Minimum over the HALF + 1 entries from each position on."""
    width = 1
    while width * 2 <= HALF + 1:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = HALF + 1 - width
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def _stretches(texts: list[int], offsets: list[int], blocks: list[bytes]) -> dict[str, np.ndarray]:
    """Stretches of a piece: anchor, content, text, lo and hi (first and last window)."""
    _, starts, rank, fits = _windows(blocks)
    place = np.arange(len(rank), dtype=np.uint64)
    chosen = _least((mixed(rank) & np.uint64(0xFFFFFFFFF8000000)) | place) & np.uint64(0x7FFFFFF)
    at = np.flatnonzero(fits)
    anchor = chosen[at].astype(np.int64)
    block = np.searchsorted(starts, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
    content = mixed(_doubled(rank, lo) * np.uint64(_BACK) + _doubled(rank, hi) + (hi - lo).astype(np.uint64))
    owner = block[first]
    shift = np.asarray(offsets)[owner] - starts[owner]
    return {"anchor": rank[anchor[first]], "content": content, "text": np.asarray(texts, np.int64)[owner], "lo": lo + shift, "hi": hi + shift}


def _blocks(batches, seen: set | None = None):
    """Groups of blocks (texts, offsets, bytes) of bounded size; each text of a batch once."""
    texts, offsets, blocks, size = [], [], [], 0
    for b in batches:
        own = set()
        for key, cell in zip(b.column("text_id").to_pylist(), b.column("text"), strict=True):
            if key in own:
                continue
            own.add(key)
            raw = cell.as_buffer().to_pybytes() if cell.is_valid else b""
            for at in range(0, max(0, len(raw) - WHOLE + 1), PIECE_BYTES):
                block = raw[at : at + PIECE_BYTES + WHOLE - 1]
                texts.append(key)
                offsets.append(at)
                blocks.append(block)
                size += len(block)
                if size >= PIECE_BYTES:
                    yield texts, offsets, blocks
                    texts, offsets, blocks, size = [], [], [], 0
    if blocks:
        yield texts, offsets, blocks


_ROUND = ["anchor", "content", "text", "lo", "hi", "state"]
_ROUND_TYPE = "anchor long, content long, text long, lo long, hi long, state int"
#: What is known of a stretch: alone in its piece, one for several in its piece, repeated, or a count of an anchor's rows.
ALONE, SEVERAL, REPEATED, COUNT = 0, 1, 2, 3
#: After round 1: to be settled window by window, and repeated itself but needed to settle others.
OPEN, SOURCE = 4, 5


def _rows(columns: dict[str, np.ndarray], state: np.ndarray) -> pa.RecordBatch:
    out = [np.ascontiguousarray(columns[c]) for c in _ROUND[:-1]]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in out] + [pa.array(state.astype(np.int32))], names=_ROUND)


def _anchors(batches):
    for texts, offsets, blocks in _blocks(batches):
        s = _stretches(texts, offsets, blocks)
        order = np.lexsort((s["content"], s["anchor"]))
        s = {k: v[order] for k, v in s.items()}
        n = len(order)
        fresh = np.ones(n, bool)
        fresh[1:] = (s["content"][1:] != s["content"][:-1]) | (s["anchor"][1:] != s["anchor"][:-1])
        group = np.cumsum(fresh) - 1
        several = np.bincount(group)[group] > 1 if n else fresh
        yield _rows(s, np.where(several, REPEATED, ALONE))
        one = fresh & several
        yield _rows({k: v[one] for k, v in s.items()}, np.full(int(one.sum()), SEVERAL))
        value, count = np.unique(s["anchor"][fresh], return_counts=True)
        often = count >= LOCAL_HOT
        zero = np.zeros(int(often.sum()), np.int64)
        yield _rows({"anchor": value[often], "content": count[often], "text": zero, "lo": zero, "hi": zero}, np.full(len(zero), COUNT))


def _round_one(hot):
    """Rows dealt by anchor (by content for frequent anchors): repeated stretches, and those to settle window by window."""

    def settle(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        c = {k: table.column(k).to_numpy() for k in _ROUND}
        order = np.lexsort((c["content"], c["anchor"]))
        c = {k: v[order] for k, v in c.items()}
        n = len(order)
        common = np.isin(c["anchor"], hot.value)
        new_a = np.ones(n, bool)
        new_a[1:] = c["anchor"][1:] != c["anchor"][:-1]
        new_c = new_a.copy()
        new_c[1:] |= c["content"][1:] != c["content"][:-1]
        a, g = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
        weight = np.where(c["state"] == SEVERAL, 2, 1)
        repeated = np.bincount(g, weight)[g] > 1
        shared = (np.bincount(a, weight)[a] > 1) | common
        alone = c["state"] == ALONE
        unsettled = shared & ~repeated
        needed = (np.bincount(a, unsettled)[a] > 0) | common
        done = repeated & alone
        yield _rows({k: v[done] for k, v in c.items()}, np.full(int(done.sum()), REPEATED))
        yield _rows({k: v[unsettled] for k, v in c.items()}, np.full(int(unsettled.sum()), OPEN))
        source = repeated & needed & new_c
        yield _rows({k: v[source] for k, v in c.items()}, np.full(int(source.sum()), SOURCE))

    return settle


def _opened(hot):
    """For each stretch to settle, its windows' ranks, packed; frequent anchors' windows are dealt by themselves."""
    from collections import defaultdict

    def open_(batches):
        common = hot.value
        for b in batches:
            keys, anchors, texts, firsts, states, ranks, sizes = [], [], [], [], [], [], []
            ranges = defaultdict(list)
            rows = {}
            for key, cell, parts in zip(b.column("text_id").to_pylist(), b.column("text"), b.column("parts").to_pylist(), strict=True):
                if key in rows:
                    continue
                rows[key] = True
                raw = cell.as_buffer().to_pybytes()
                for p in parts:
                    for lo in range(p["lo"], p["hi"] + 1, PIECE_BYTES):
                        hi = min(p["hi"], lo + PIECE_BYTES - 1)
                        ranges[key].append((p["anchor"], lo, hi, p["state"], raw[lo : hi + WHOLE]))
            flat_ranges = [(k, *r) for k, rs in ranges.items() for r in rs]
            at = 0
            while at < len(flat_ranges):
                end, size = at, 0
                while end < len(flat_ranges) and size < PIECE_BYTES:
                    size += len(flat_ranges[end][5])
                    end += 1
                part = flat_ranges[at:end]
                at = end
                _, starts, rank, fits = _windows([r[5] for r in part])
                for r, s in zip(part, starts, strict=True):
                    w = _doubled(rank, np.arange(s, s + r[3] - r[2] + 1))
                    anchors.append(r[1])
                    texts.append(r[0])
                    firsts.append(r[2])
                    states.append(r[4])
                    ranks.append(w)
                    sizes.append(len(w))
            if not sizes:
                continue
            anchors, sizes = np.array(anchors, np.int64), np.array(sizes)
            texts, firsts, states = np.array(texts, np.int64), np.array(firsts, np.int64), np.array(states, np.int32)
            ranks = np.concatenate(ranks)
            row = np.repeat(np.arange(len(sizes)), sizes)
            offset = np.arange(len(ranks)) - (np.cumsum(sizes) - sizes)[row]
            key = anchors.view(np.uint64)[row]
            split = np.isin(anchors, common)[row]
            key = np.where(split, mixed(key + ranks % np.uint64(SPREAD)), key)
            order = np.lexsort((offset, key, row))
            key, row, offset, ranks = key[order], row[order], offset[order], ranks[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            bounds = np.append(first, len(key))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first].view(np.int64)), pa.array(texts[row[first]]), pa.array(firsts[row[first]]), pa.array(states[row[first]]), binaries(offset.astype(np.int32), bounds), binaries(ranks, bounds)],
                names=["key", "text", "first", "state", "offsets", "ranks"],
            )

    return open_


def _round_two(batches):
    """Windows of OPEN stretches whose rank occurs again, as runs (text, lo, hi)."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    table = pa.Table.from_batches(held)
    ranks, starts = flat(table.column("ranks"), "u8")
    offsets, _ = flat(table.column("offsets"), "<i4")
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    known = table.column("state").to_numpy()[row] == SOURCE
    _, name, count = np.unique(ranks, return_inverse=True, return_counts=True)
    again = ((count > 1)[name]) & ~known
    text, at = table.column("text").to_numpy()[row][again], (table.column("first").to_numpy()[row] + offsets)[again]
    order = np.lexsort((at, text))
    text, at = text[order], at[order]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    yield pa.RecordBatch.from_arrays([pa.array(text[first]), pa.array(at[first].astype(np.int64)), pa.array(at[last].astype(np.int64))], names=["text", "lo", "hi"])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches):
    """Each document without the bytes that repeated windows cover."""
    for b in batches:
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for cell, copied, lows, highs in zip(b.column("text"), b.column("copied").to_pylist(), b.column("lows"), b.column("highs"), strict=True):
            raw = cell.as_buffer().to_pybytes() if cell.is_valid else b""
            n, removed, spans, kept = len(raw), 0, 0, raw
            if copied and n >= WHOLE:
                removed, spans, kept = n, 1, b""
            elif lows.is_valid and len(lows.values):
                lo = lows.values.to_numpy(zero_copy_only=False)
                hi = highs.values.to_numpy(zero_copy_only=False) + WHOLE
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.ones(len(lo), bool)
                new[1:] = lo[1:] > hi[:-1]
                begins = lo[new]
                ends = hi[np.append(np.flatnonzero(new)[1:], len(lo)) - 1]
                removed, spans = int((ends - begins).sum()), len(begins)
                edges = [0, *np.stack([begins, ends], 1).ravel().tolist(), n]
                kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            for k, v in zip(out, (n, removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(out[k], pa.int64()) for k in list(out)[:3]], pa.array(out["kept_sha256"])], names=["doc_id", *out])


def dedupe(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes)."""
    spark = docs.sparkSession
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_id", F.xxhash64("text"))
    rows = stored(whole.filter(F.octet_length("text") >= WHOLE).select("text_id", "text").mapInArrow(_anchors, _ROUND_TYPE), "anchors")
    total = rows.filter(f"state in ({ALONE}, {SEVERAL})").count()
    often = max(1000, -(-total // HOT_ENTRIES))
    counts = rows.filter(f"state = {COUNT}").groupBy("anchor").agg(F.sum("content").alias("n")).filter(F.col("n") >= often)
    hot = spark.sparkContext.broadcast(counts.select("anchor").toPandas()["anchor"].to_numpy(np.int64))
    common = rows.filter(f"state in ({ALONE}, {SEVERAL})").withColumn("deal", F.col("anchor"))
    if len(hot.value):
        frequent = spark.createDataFrame([(int(a),) for a in hot.value], "frequent long")
        common = common.join(F.broadcast(frequent), F.col("anchor") == F.col("frequent"), "left").withColumn("deal", F.when(F.col("frequent").isNotNull(), F.col("content")).otherwise(F.col("anchor"))).drop("frequent")
    settled = stored(common.repartition("deal").drop("deal").mapInArrow(_round_one(hot), _ROUND_TYPE), "round-one")
    parts = settled.filter(f"state in ({OPEN}, {SOURCE})").groupBy(F.col("text").alias("part_text")).agg(F.collect_list(F.struct("anchor", "lo", "hi", "state")).alias("parts"))
    # Copies go whole, without a look at spans: rows of a text that very many rows have stay where they are, and the text is dealt once.
    counts = stored(whole.groupBy(F.col("text_id").alias("copy_text")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "copies")
    much = max(1000, -(-(counts.agg(F.sum("n").alias("n")).first()["n"] or 0) // HOT_ENTRIES))
    many = F.broadcast(counts.filter(F.col("n") >= much).select(F.col("copy_text").alias("many_text")))
    marked = whole.join(many, F.col("text_id") == F.col("many_text"), "left")
    common_rows = marked.filter("many_text is not null")
    single = common_rows.groupBy("text_id").agg(F.first("text").alias("text"))
    own = marked.filter("many_text is null").select("doc_id", "text", "text_id", F.lit(True).alias("real"))
    dealt = own.union(single.select(F.lit(None).cast("long"), "text", "text_id", F.lit(False))).repartition("text_id")
    opened = dealt.join(parts, F.col("text_id") == F.col("part_text")).select("text_id", "text", "parts").mapInArrow(_opened(hot), "key long, text long, first long, state int, offsets binary, ranks binary")
    again = opened.repartition("key").mapInArrow(_round_two, "text long, lo long, hi long")
    first = rows.union(settled).filter(f"state = {REPEATED}").select("text", "lo", "hi")
    spans = first.union(again).groupBy(F.col("text").alias("span_text")).agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs"))
    joined = dealt.filter("real").join(spans, F.col("text_id") == F.col("span_text"), "left").join(counts, F.col("text_id") == F.col("copy_text"), "left")
    cut = joined.select("doc_id", "text", F.col("copy_text").isNotNull().alias("copied"), "lows", "highs")
    none = F.lit(None).cast("array<long>")
    return cut.union(common_rows.select("doc_id", "text", F.lit(True), none, none)).mapInArrow(_cut, _RESULT)


def doubled_windows(docs: DataFrame, text: str = "text", first: int = 25) -> DataFrame:
    """(text_id, pos) of every 200-byte window that occurs again, by doubling with a row for each position: the plain form of the method.

    Ranks of ``first`` bytes are joined with the ranks at growing offsets and named anew; positions whose rank is unique drop
    out of each round. dedupe() samples positions instead, because a row for each byte is beyond the disk at scale."""

    def prefixes(batches):
        for texts, offsets, blocks in _blocks(batches):
            sizes = np.array([len(b) for b in blocks])
            starts = np.cumsum(sizes) - sizes
            data = np.frombuffer(b"".join(blocks), np.uint8)
            rank = names(data, first, _powers(_BASE, len(data)), _powers(_BACK, len(data)))
            for t, o, s, n in zip(texts, offsets, starts, sizes, strict=True):
                # The last block of a text has no next one that begins where its whole windows end.
                many = min(n - first + 1, PIECE_BYTES) if n == PIECE_BYTES + WHOLE - 1 else n - first + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, t)), pa.array(o + np.arange(many)), pa.array(rank[s : s + many].view(np.int64))], names=["text_id", "pos", "rank"])

    whole = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("text_id", F.monotonically_increasing_id()).filter(F.octet_length("text") >= WHOLE)
    ranks = stored(whole.select("text_id", "text").mapInArrow(prefixes, "text_id long, pos long, rank long"), "ranks")
    length = first
    while True:
        again = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rank")
        ranks = stored(ranks.join(again, "rank", "left_semi"), "ranks")
        if length == WHOLE:
            return ranks.select("text_id", "pos")
        later = ranks.select("text_id", (F.col("pos") - length).alias("pos"), F.col("rank").alias("then"))
        ranks = ranks.join(later, ["text_id", "pos"]).select("text_id", "pos", F.xxhash64("rank", "then").alias("rank"))
        length *= 2
