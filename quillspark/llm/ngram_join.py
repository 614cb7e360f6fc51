"""N-gram Jaccard join: all links between documents whose sets of 5-word shingles are similar enough, exactly.

A document's set is the distinct 64-bit hashes of its 5-word shingles (words at ASCII blanks, A-Z in lower case; a
shorter text is one shingle). Documents with the same set form a class, so copies cost one set. Two sets of x and y
shingles link when 100 * intersection >= 75 * union; then they differ in at most (x + y) / 7 shingles.

* Shared shingles. Every piece of the input sends its shingles to ranges of the hashed universe, as packed columns; a range
  sends back those that occur again, with their frequency. A shingle of one set only is in no intersection, so a set is
  reduced to its shared shingles and the number u of the others, and exact checks need no more.
* Candidates, by pigeonhole. With H the most shingles in which a set may differ from any partner, a set with u > H links
  with nothing. Else reduced sets differ in at most H - u. Sets are put in overlapping size bands such that every pair that
  can link shares a band; a band cuts the universe into at least twice as many segments as its largest size, and one of any
  H - u + 1 of a set's non-empty segments is the same in the partner. Which ones is decided by cost: segments in order of
  their rarest shingle's frequency, the same order for all sets, so passages that many documents share are indexed only by
  sets that have little else.
* Sets of 3 to 7 shingles may differ in one: the whole set is one segment, indexed with its one-deletion neighbourhood.

Each content that several sets index is a group. Groups are never expanded into pairs: in turns, every set is compared
with a few others drawn from its groups, first by a small sketch that rules out most and never a link, then the likeliest
exactly, and linked components are contracted; only pairs of different components that a group still holds are compared one
by one, those of large groups block by block.

A shingle that many sets of a piece hold is sent once by the piece, and counts as frequent everywhere. Null and empty texts
have no shingles and link with nothing. Null ids are rows like others, least in no component that has another. Repeated
rows and copies share a class; ties are settled by the smallest id. An empty table gives an empty result. Other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import spread_join, stored
from .components import components
from .tokens import binaries, flat, mixed, packed, shingle_sets, split_words, unpacked

PERCENT = 75
#: Texts of a piece are worked on together; these bound a task's memory.
PIECE_BYTES = 12_000_000
PIECE_ROWS = 60_000
#: Shingles that a range of the universe should hold, and bytes of text for a shingle.
RANGE_SHINGLES = 6_000_000
SHINGLE_BYTES = 7
#: Sets of a piece from which on a shingle counts as frequent.
LOCAL_OFTEN = 8
FREQUENT = 255
BITS = np.uint64(40)
MASK = np.uint64((1 << 40) - 1)
#: Local number of an entry that stands for all sets of its piece.
ALL = 0xFFFF
#: Sets compared with a set in a turn, and turns, before the pairs that are left are compared one by one.
LEADERS = 4
MOST_TURNS = 4
#: Groups up to this size are joined with themselves in the end; larger ones meet in blocks of BLOCK.
SMALL = 32
BLOCK = 256
TINY = 7
FIRST = 6
WIDTH = 8


def bands(most: int = 1 << 40) -> list[tuple[int, int, int]]:
    """(least, largest) sizes of the bands and their segments; neighbours overlap by the ratio that linked sizes can have."""
    out, low = [], FIRST
    while low < most:
        high = low * WIDTH
        # In small sets several shingles must not meet in a segment.
        out.append((low, high, max(2 * high, 4096)))
        low = high * PERCENT // 100
    return out


BANDS = bands()


def most_different(x: np.ndarray, largest: int | None = None) -> np.ndarray:
    """The most shingles in which a set of x can differ from a partner that it links with, in a band up to largest."""
    other = x * 100 // PERCENT
    return (x + (other if largest is None else np.minimum(other, largest))) // 7


def _pieces(batches):
    for b in batches:
        text = b.column(b.schema.get_field_index("text"))
        step = max(1, min(PIECE_ROWS, int(len(b) * min(1.0, PIECE_BYTES / max(1, text.nbytes)))))
        for at in range(0, len(b), step):
            yield b.slice(at, step)


def _sets(piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, set ids): the shingle set of each text of a piece; equal sets have equal ids."""
    data, starts = shingle_sets(*split_words(piece.column(piece.schema.get_field_index("text"))))
    raw = memoryview(data.tobytes())
    ids = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(starts[:-1], starts[1:], strict=True)), np.uint64, len(starts) - 1)
    return data, starts, ids


def _distinct(data, starts, ids):
    """One of each set of a piece, without the empty one."""
    _, first = np.unique(ids, return_index=True)
    first = first[np.diff(starts)[first] > 0]
    sizes = np.diff(starts)[first]
    chosen = np.zeros(len(ids), bool)
    chosen[first] = True
    pick = np.repeat(chosen, np.diff(starts))
    order = np.argsort(first, kind="stable")
    first, sizes = first[order], sizes[order]
    return data[pick], np.concatenate([[0], np.cumsum(sizes)]), ids[first]


_SENT = pa.schema([("range", pa.int32()), ("piece", pa.int64()), ("entries", pa.binary()), ("head", pa.binary())])


def _sender(ranges: int):
    """For each piece a head (its documents, sets and frequent shingles) and a row for each range with its other shingles."""

    def send(batches):
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for piece in _pieces(batches):
            data, starts, ids = _sets(piece)
            sizes = np.diff(starts)
            doc = piece.column(piece.schema.get_field_index("doc_id"))
            own, at, sets = _distinct(data, starts, ids)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), np.diff(at))
            key = ((((own >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) << BITS) | (own & MASK)
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            often = np.diff(np.append(first, len(key))) >= LOCAL_OFTEN
            spread = np.repeat(often, np.diff(np.append(first, len(key))))
            mark = spread & new
            ids_doc = doc.fill_null(0).to_numpy().astype(np.int64)
            nulls = np.asarray(doc.is_null().to_numpy(zero_copy_only=False), np.uint8)
            head = packed(ids_doc, nulls, sizes.astype(np.int32), ids, sets, np.diff(at).astype(np.int32), key[spread], owner[spread])
            owner = np.where(mark, np.uint16(ALL), owner)
            keep = ~spread | mark
            key, owner = key[keep], owner[keep]
            bounds = np.searchsorted(key >> BITS, np.arange(ranges + 1, dtype=np.uint64))
            some = np.flatnonzero(np.diff(bounds))
            cells = [packed(np.diff(key[bounds[r] : bounds[r + 1]] & MASK, prepend=np.uint64(0)), owner[bounds[r] : bounds[r + 1]]) for r in some]
            yield pa.RecordBatch.from_arrays([pa.array([serial % ranges], pa.int32()), pa.array([serial]), pa.nulls(1, pa.binary()), pa.array([head], pa.binary())], schema=_SENT)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), serial)), pa.array(cells, pa.binary()), pa.nulls(len(some), pa.binary())], schema=_SENT)
            serial += 1

    return send


def _shared(key, rows):
    """Of the shingles of a range, those that several sets have, back to their pieces with their frequency; heads as they are."""
    where, pieces = key[0].as_py(), rows.column("piece").to_pylist()
    cells = [unpacked(c.as_py()) if c.is_valid else None for c in rows.column("entries")]
    rows_at = [i for i, c in enumerate(cells) if c is not None]
    ids = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(cells[i][0]) for i in rows_at]])
    owner = np.concatenate([np.zeros(0, np.uint16), *[cells[i][1] for i in rows_at]])
    order = np.argsort(ids, kind="stable")
    new = np.ones(len(ids), bool)
    new[1:] = ids[order][1:] != ids[order][:-1]
    group = np.cumsum(new) - 1
    weight = np.where(owner[order] == ALL, FREQUENT, 1)
    count = np.minimum(np.bincount(group, weight) if len(ids) else np.zeros(0), FREQUENT).astype(np.uint8)
    often = np.empty(len(ids), np.uint8)
    often[order] = count[group]
    keep = (often > 1) & (owner != ALL)
    ends = np.cumsum([len(cells[i][1]) for i in rows_at], dtype=np.int64)
    out = []
    for i, end in zip(rows_at, ends, strict=True):
        at = slice(end - len(cells[i][1]), end)
        k = keep[at]
        if k.any():
            out.append((pieces[i], packed(np.diff(ids[at][k], prepend=np.uint64(0)), owner[at][k], often[at][k]), None))
    out += [(p, None, h.as_py()) for p, h in zip(pieces, rows.column("head"), strict=True) if h.is_valid]
    return pa.table([pa.array([where] * len(out), pa.int32()), *[pa.array([x[j] for x in out], t) for j, t in ((0, pa.int64()), (1, pa.binary()), (2, pa.binary()))]], schema=_SENT)


def signatures(key: np.ndarray, owner: np.ndarray, often: np.ndarray, size: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(contents, owners): what each reduced set indexes. key: its shared shingles, sets one after another; alone: how many others it has."""
    n = len(size)
    spread = mixed(key)
    out_s, out_o = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    tiny = (size >= 3) & (size <= TINY) & (alone <= 1)
    if tiny.any():
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, spread)
        which = tiny[owner] & (alone[owner] == 0)
        out_s += [mixed(total[tiny] + np.uint64(1)), mixed(total[owner[which]] - spread[which] + np.uint64(1))]
        out_o += [np.flatnonzero(tiny), owner[which]]
    for k, (low, high, segments) in enumerate(BANDS):
        if not n or low > size.max():
            break
        wanted = most_different(size, high) - alone
        fit = (size >= low) & (size <= high) & (wanted >= 0)
        here = fit[owner]
        if not here.any():
            continue
        own = owner[here]
        segment = ((key[here] & MASK) * np.uint64(segments)) >> BITS if segments < 1 << 24 else (((key[here] & MASK) >> np.uint64(16)) * np.uint64(segments)) >> np.uint64(24)
        order = np.lexsort((segment, own))
        own, segment, value, rare = own[order], segment[order], spread[here][order], often[here][order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new)
        content = mixed(np.add.reduceat(value, at) + np.uint64(k + 2))
        cost, own = np.minimum.reduceat(rare, at), own[at]
        order = np.lexsort((content, cost, own))
        content, own = content[order], own[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        keep = rank <= wanted[own]
        out_s.append(content[keep])
        out_o.append(own[keep])
    return np.concatenate(out_s), np.concatenate(out_o)


_REDUCED = "doc_id long, n_shingles long, set long, alone long, contents array<long>, sketch binary, body binary"
_REDUCED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set", pa.int64()), ("alone", pa.int64()), ("contents", pa.list_(pa.int64())), ("sketch", pa.binary()), ("body", pa.binary())])


def _reduced(key, rows):
    """The documents of a piece, and of its sets those that may link: contents, sketch and shared shingles."""
    head = next(unpacked(h.as_py()) for h in rows.column("head") if h.is_valid)
    doc, nulls, sizes, ids, sets, size, keys, owners = head
    keys, owners, often = [keys], [owners], [np.full(len(keys), FREQUENT, np.uint8)]
    for where, c in zip(rows.column("range").to_pylist(), rows.column("entries"), strict=True):
        if c.is_valid:
            delta, own, count = unpacked(c.as_py())
            keys.append(np.cumsum(delta) | (np.uint64(where) << BITS))
            owners.append(own)
            often.append(count)
    key, owner, often = np.concatenate(keys), np.concatenate(owners).astype(np.int64), np.concatenate(often)
    size = size.astype(np.int64)
    alone = size - np.bincount(owner, minlength=len(size))
    open_ = (alone <= most_different(size)) & (size >= 3)
    here = open_[owner]
    number = np.cumsum(open_) - 1
    key, owner, often = key[here], number[owner[here]], often[here]
    order = np.lexsort((key, owner))
    key, owner, often = key[order], owner[order], often[order]
    size, alone, sets = size[open_], alone[open_], sets[open_]
    content, of = signatures(key, owner, often, size, alone)
    order = np.argsort(of, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))]).astype(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sets)))]).astype(np.int32)), pa.array(content[order].view(np.int64)))
    n, m = len(doc), len(sets)
    docs = [pa.array(doc, mask=nulls.astype(bool)), pa.array(sizes.astype(np.int64)), pa.array(ids.view(np.int64), mask=sizes == 0), *[pa.nulls(n, t) for t in _REDUCED_SCHEMA.types[3:]]]
    cands = [pa.nulls(m, pa.int64()), pa.array(size), pa.array(sets.view(np.int64)), pa.array(alone), lists, binaries(*sketches(key, starts)), binaries(key, starts)]
    return pa.concat_tables([pa.table(docs, schema=_REDUCED_SCHEMA), pa.table(cands, schema=_REDUCED_SCHEMA)])


def sketches(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): of each set, the parity of its hashes in each of at least twice its size of slots.

    Sets of d different hashes differ in at most d slots, so unlike sets are told apart without their hashes."""
    sizes = np.diff(starts)
    slots = np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1)
    begin = np.concatenate([[0], np.cumsum(slots)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = begin[owner] + (data & (slots[owner].astype(np.uint64) - np.uint64(1))).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=begin[-1]).astype(np.uint8) & 1, bitorder="little"), begin // 8


def _numbers(b, *names):
    return [b.column(b.schema.get_field_index(n)).to_numpy() for n in names]


_PAIR = "set long, lead long, part long, lead_part long, apart long"
_PAIR_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _PAIR.split(", ")])


def _alike(batches):
    """Pairs whose sketches do not rule out a link, with the difference that they show."""
    for b in batches:
        left, a = flat(b.column(b.schema.get_field_index("left")), "u1")
        right, c = flat(b.column(b.schema.get_field_index("right")), "u1")
        total, alone = (x + y for x, y in (_numbers(b, "left_n", "right_n"), _numbers(b, "left_alone", "right_alone")))
        apart = np.zeros(len(b), np.int64)
        for i in range(len(b)):
            x, y = left[a[i] : a[i + 1]], right[c[i] : c[i + 1]]
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            apart[i] = int(np.bitwise_count(x ^ y).sum())
        apart += alone
        keep = pa.array(apart * (100 + PERCENT) <= (100 - PERCENT) * total)
        cols = [b.column(b.schema.get_field_index(n)) for n in ("set", "lead", "part", "lead_part")]
        yield pa.RecordBatch.from_arrays([x.filter(keep) for x in [*cols, pa.array(apart)]], schema=_PAIR_SCHEMA)


def _verify(batches):
    """Of the pairs, the components of those that link, by their whole shared sets."""
    for b in batches:
        left, a = flat(b.column(b.schema.get_field_index("left")), "u8")
        right, c = flat(b.column(b.schema.get_field_index("right")), "u8")
        left_n, right_n = _numbers(b, "left_n", "right_n")
        linked = np.zeros(len(b), bool)
        for i in range(len(b)):
            both = len(np.intersect1d(left[a[i] : a[i + 1]], right[c[i] : c[i + 1]], assume_unique=True))
            linked[i] = 100 * both >= PERCENT * (int(left_n[i]) + int(right_n[i]) - both)
        keep = pa.array(linked)
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)).filter(keep) for n in ("part", "lead_part")], names=["u", "v"])


def _both(pairs: DataFrame, bodies: DataFrame, what: str) -> DataFrame:
    side = lambda key, name: bodies.select(F.col("set").alias(key), F.col("n_shingles").alias(f"{name}_n"), F.col("alone").alias(f"{name}_alone"), F.col(what).alias(name))
    return pairs.select("set", "lead", "part", "lead_part").join(side("lead", "right"), "lead").join(side("set", "left"), "set")


def _linked(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of pairs past their sketches, the edges (u, v) between components that the whole sets confirm."""
    return _both(pairs, bodies, "body").mapInArrow(_verify, "u long, v long")


def _contracted(groups: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """groups with each set's component after the edges found, without groups of one component."""
    now = groups
    if found is not None:
        moved = found.select(F.col("node").alias("part"), F.col("component").alias("to"))
        now = groups.join(moved, "part", "left").withColumn("part", F.coalesce("to", "part")).drop("to")
    open_ = now.groupBy("content").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("content")
    return now.join(open_, "content", "left_semi")


def fits(a: str, b: str):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT) & (F.col(a) + F.col(b) >= 7)


def _led(groups: DataFrame, turn: int) -> DataFrame:
    """Each set with a few sets of other components: of the members drawn for its groups, those that share most groups with it."""
    heads = groups.groupBy("content").agg(F.min_by(F.struct("set", "size", "part"), F.xxhash64("set", F.lit(turn))).alias("head"))
    rows = groups.join(heads, "content").select("set", "size", "part", F.col("head.set").alias("lead"), F.col("head.size").alias("lead_size"), F.col("head.part").alias("lead_part"))
    shared = rows.filter((F.col("part") != F.col("lead_part")) & fits("size", "lead_size")).groupBy("set", "lead", "part", "lead_part").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("set").orderBy(F.col("n").desc(), F.xxhash64("lead", F.lit(turn)))
    return shared.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= LEADERS).select("set", "lead", "part", "lead_part")


def _remaining(groups: DataFrame) -> DataFrame:
    """The pairs of different components that small groups still hold."""
    other = groups.select("content", F.col("set").alias("lead"), F.col("size").alias("lead_size"), F.col("part").alias("lead_part"))
    pairs = groups.join(other, "content").filter((F.col("set") < F.col("lead")) & (F.col("part") != F.col("lead_part")) & fits("size", "lead_size"))
    return pairs.select("set", "lead", "part", "lead_part").distinct()


def _folded(cells: list[bytes], length: int) -> np.ndarray:
    """Sketches as rows of the given length."""
    out = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), -1)
    while out.shape[1] > length:
        out = out[:, : out.shape[1] // 2] ^ out[:, out.shape[1] // 2 :]
    return out


def _block(key, rows):
    """Of the sets of two blocks of a large group, the pairs of different components whose sketches do not rule out a link.

    A pair that shares several large groups comes from the first of them only."""
    own, shared = key[0].as_py(), [frozenset(x) for x in rows.column("large").to_pylist()]
    sets, part = rows.column("set").to_numpy(), rows.column("part").to_numpy()
    size, side, alone = rows.column("size").to_numpy().astype(np.int64), rows.column("block").to_numpy(), rows.column("alone").to_numpy()
    sketch = rows.column("sketch").to_pylist()
    lengths = np.array([len(x) for x in sketch])
    low, high = key[1].as_py(), key[2].as_py()
    out = {c: [np.zeros(0, np.int64)] for c in ("set", "lead", "part", "lead_part", "apart")}
    for a in np.unique(lengths):
        for b in np.unique(lengths):
            i, j = np.flatnonzero((lengths == a) & (side == low)), np.flatnonzero((lengths == b) & (side == high))
            if not len(i) or not len(j):
                continue
            x, y = _folded([sketch[k] for k in i], min(a, b)), _folded([sketch[k] for k in j], min(a, b))
            for at in range(0, len(i), 64):
                rows_i = i[at : at + 64]
                apart = np.bitwise_count(x[at : at + 64, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64) + alone[rows_i][:, None] + alone[j][None, :]
                p, q = np.nonzero((apart * (100 + PERCENT) <= (100 - PERCENT) * (size[rows_i][:, None] + size[j][None, :])) & (part[rows_i][:, None] != part[j][None, :]))
                first = np.fromiter((min(shared[s] & shared[t]) == own for s, t in zip(rows_i[p], j[q], strict=True)), bool, len(p))
                p, q = p[first], q[first]
                for c, v in zip(out, (sets[rows_i[p]], sets[j[q]], part[rows_i[p]], part[j[q]], apart[p, q]), strict=True):
                    out[c].append(v)
    return pa.table({c: np.concatenate(v) for c, v in out.items()}, schema=_PAIR_SCHEMA)


def _in_blocks(groups: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs past their sketches of groups too large to be joined with themselves: block meets block, and no other pair leaves a task."""
    large = groups.groupBy("set").agg(F.collect_set("content").alias("large"))
    rows = groups.join(bodies.select("set", "alone", "sketch"), "set").join(large, "set").withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    meets = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")]
    return meets.select("content", *keys, "set", "part", "size", "alone", "block", "sketch", "large").groupBy("content", "low", "high").applyInArrow(_block, _PAIR)


def _parted(bodies: DataFrame) -> DataFrame:
    """(node, component) of every set that links with another."""
    every = bodies.select("set", F.col("n_shingles").alias("size"), F.col("set").alias("part"), F.explode("contents").alias("content"))
    groups = stored(_contracted(every), "groups")
    steps = []
    for turn in range(MOST_TURNS + 1):
        many = groups.select("set").distinct().count()
        if not many:
            break
        # Leaders go on while they join a twentieth of the sets that are still open.
        last = turn == MOST_TURNS or (turn and steps[-1][1] * 20 < many)
        if last:
            count = groups.groupBy("content").agg(F.count(F.lit(1)).alias("m"))
            sized = groups.join(count, "content").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
            small = _both(_remaining(sized.filter(F.col("m") <= SMALL)), bodies, "sketch").mapInArrow(_alike, _PAIR)
            pairs = small.union(_in_blocks(sized.filter(F.col("m") > SMALL), bodies)).dropDuplicates(["set", "lead"])
        else:
            near = _both(_led(groups, turn), bodies, "sketch").mapInArrow(_alike, _PAIR)
            pairs = near.groupBy("set").agg(F.min_by(F.struct("lead", "part", "lead_part"), F.struct("apart", "lead")).alias("x")).select("set", "x.lead", "x.part", "x.lead_part")
        edges = stored(_linked(pairs, bodies), "links")
        found = components(edges)
        steps.append((found, edges.count()))
        if last:
            break
        groups = stored(_contracted(groups, found), "groups")
    if not steps:
        return bodies.select(F.col("set").alias("node"), F.col("set").alias("component")).limit(0)
    # A component of a step is a node of the steps after it.
    out = steps[0][0]
    for found, _ in steps[1:]:
        later = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
        out = out.join(later, "component", "left").select("node", F.coalesce("to", "component").alias("component")).union(found).dropDuplicates(["node", "component"])
    return out


def join_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each of docs: doc_id, n_shingles, set (id of its class; null without words), component_id (smallest id it reaches by links)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-size // (SHINGLE_BYTES * RANGE_SHINGLES)))
    sent = rows.mapInArrow(_sender(ranges), "range int, piece long, entries binary, head binary")
    back = sent.groupBy("range").applyInArrow(_shared, "range int, piece long, entries binary, head binary")
    table = stored(back.groupBy("piece").applyInArrow(_reduced, _REDUCED), "sets")
    members = table.filter("body is null").select("doc_id", "n_shingles", "set")
    bodies = stored(table.filter("body is not null").drop("doc_id").dropDuplicates(["set"]), "bodies")
    part = _parted(bodies).withColumnRenamed("node", "set")
    classes = members.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    placed = stored(classes.join(part, "set", "left").withColumn("component", F.coalesce("component", "set")), "classes")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = stored(spread_join(placed.select("component", "set", F.col("rows").alias("members")), least, "component").select("set", F.col("members").alias("rows"), "component_id"), "named")
    out = spread_join(members.filter("set is not null"), named, "set").select("doc_id", "n_shingles", "set", "component_id")
    return out.union(members.filter("set is null").select("doc_id", "n_shingles", "set", F.col("doc_id").alias("component_id")))
