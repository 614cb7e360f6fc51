"""Hierarchical Pitman-Yor language model over words: Chinese-restaurant seating sampled by Gibbs on Spark.

Restaurants: one for each preceding word (or the start of a text), however rare, all sharing one parent restaurant of single
words, whose base is uniform over the vocabulary and one unknown word. With ``least_context`` above 1, contexts that training has
less often are pooled in the parent: their tokens are its customers at once.

A sweep removes the customers of every dish and seats them again given all the rest. Given the dish's probability p under
the parent and a gamma variable x for the restaurant, which replaces its rising factorial (strength | discount), the number
of tables t of c customers has probability in proportion to S(c, t) (discount x p)^t, with generalised Stirling numbers S, independently
of other dishes; it is drawn exactly up to EXACT customers, beyond that from the law at the saddle point of the same weights.
The tables of a dish over all restaurants are its customers in the parent, seated in the same way; the parent's weights are
then drawn (a gamma number for each dish), so restaurants are independent given them. Sweeps after burn-in each give predictive probabilities, and
a token's probability is the mean over these sweeps, each a whole distribution.

On Spark: texts are cut into words once; a chunk of documents keeps the numbers of its tokens and its dictionary in a table.
Pairs (word, preceding word) are dealt by ranges of word hashes, words of more than RANGE_TOKENS occurrences by the
preceding word as well; a range's counts are one row. Restaurants are dealt by ranges of context hashes into parts. A sweep is two jobs:
ranges seat customers and send parts the tables of each context; parts add them up and send back each context's gamma variable.
Only contexts of pairs that training has twice or more take part in that: a single customer has one table, whatever is drawn.
Neither driver nor broadcasts hold anything about contexts. Each sweep's messages are a table; draws are seeded by sweep and range, so a lost
task comes back the same. In the end ranges answer chunks with the count of each word and the probability of each pair.

Null and empty texts consist of the end token alone. Null ids belong to the training part. Repeated rows each count and
are scored. An empty training part leaves the uniform base. Columns other than the two named are not looked at.
"""

from __future__ import annotations

from functools import cache
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import remove, stored
from .tokens import hashed, mixed, packed, split_words, unpacked

END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Text of a chunk, in bytes: it bounds a task's memory, not what is read.
CHUNK_BYTES = 5_000_000
#: Tokens whose words, counted once for each chunk, a range of hashes should hold.
RANGE_TOKENS = 2_500_000
EXACT = 256
DISCOUNT, STRENGTH = 0.75, 2.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 100.0


def _binary(*arrays) -> pa.Array:
    return pa.array([packed(*arrays)], pa.binary())


def _chunks(batches):
    """One row for each chunk: its documents, the numbers of their tokens, and its dictionary, sorted by hash, with training counts."""
    from pyspark import TaskContext

    serial, held, size = TaskContext.get().partitionId() << 32, [], 0

    def made(group):
        nonlocal serial
        table = pa.Table.from_batches(group)
        ids, lengths, words = split_words(table.column("text").combine_chunks())
        end = len(words)
        tokens = np.insert(ids, np.cumsum(lengths), end)
        codes = np.concatenate([hashed(words), [END]])
        used = np.flatnonzero(np.bincount(tokens, minlength=end + 1))
        used = used[np.argsort(codes[used], kind="stable")]
        renumber = np.zeros(end + 1, np.int32)
        renumber[used] = np.arange(len(used), dtype=np.int32)
        held_out = np.asarray(table.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
        count = np.bincount(tokens[np.repeat(~held_out, lengths + 1)], minlength=end + 1)[used]
        doc = table.column("doc_id").combine_chunks()
        serial += 1
        docs = _binary(doc.fill_null(0).to_numpy().astype(np.int64), np.asarray(doc.is_null().to_numpy(zero_copy_only=False), np.uint8), held_out.astype(np.uint8), (lengths + 1).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([serial]), docs, _binary(renumber[tokens]), _binary(codes[used], count.astype(np.int32)), pa.array([int(count.sum())])], names=["chunk", "docs", "tokens", "words", "n"])

    for b in batches:
        at = 0
        while at < len(b):
            text = b.column(b.schema.get_field_index("text"))
            step = max(1, int(len(b) * min(1.0, CHUNK_BYTES / max(1, text.nbytes))))
            piece = b.slice(at, step)
            held.append(piece)
            size += text.nbytes * len(piece) // max(1, len(b))
            at += step
            if size >= CHUNK_BYTES:
                yield made(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield made(held)


_CHUNK = "chunk long, docs binary, tokens binary, words binary, n long"


def _in_ranges(words: np.ndarray, ranges: int) -> np.ndarray:
    return (((words >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _word_blocks(ranges: int):
    """A chunk's training words and counts, a row for each range of hashes."""

    def cut(batches):
        for b in batches:
            for cell in b.column("words").to_pylist():
                words, count = unpacked(cell)
                words, count = words[count > 0], count[count > 0]
                bounds = np.searchsorted(_in_ranges(words, ranges), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(bounds))
                cells = [packed(words[bounds[r] : bounds[r + 1]], count[bounds[r] : bounds[r + 1]]) for r in some]
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(cells, pa.binary())], names=["range", "words"])

    return cut


def _frequent(least: int):
    """Of a range: how many words training has, and those that it has often."""

    def frequent(_key, rows):
        blocks = [unpacked(c) for c in rows.column("words").to_pylist()]
        words, at = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
        count = np.bincount(at, np.concatenate([b[1] for b in blocks])).astype(np.int64)
        often = count >= least
        return pa.table({"v": [len(words)], "often": _binary(words[often], count[often])})

    return frequent


class Layout:
    """The most frequent words (hashes, sorted, and their counts) and where pairs are dealt."""

    def __init__(self, words: np.ndarray, count: np.ndarray, tokens: int, range_tokens: int):
        order = np.argsort(words, kind="stable")
        self.words, self.count = words[order], count[order]
        self.split = np.flatnonzero(self.count > range_tokens)
        self.slices = -(-self.count[self.split] // range_tokens)
        self.ranges = max(1, -(-tokens // range_tokens))
        self.first = self.ranges + np.cumsum(self.slices) - self.slices

    def cut(self, where: int) -> int:
        """Number of the word that a range has a slice of, -1 for ranges of whole words."""
        return int(np.searchsorted(self.first, where, side="right")) - 1 if where >= self.ranges else -1

    def place(self, words: np.ndarray) -> np.ndarray:
        """Number of each word among the most frequent, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def pairs(self, words: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray):
        """The distinct (word, preceding word) of a chunk: (range, word, preceding word, training count), and each token's pair."""
        end = int(np.searchsorted(words, END)) if len(words) else 0
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[np.cumsum(lengths) - lengths] = end
        wide = max(1, len(words))
        key, token_pair = np.unique(tokens.astype(np.int64) * wide + before, return_inverse=True)
        n = np.bincount(token_pair, np.repeat(train, lengths), minlength=len(key)).astype(np.int64)
        word, context = key // wide, key % wide
        where = _in_ranges(words, self.ranges)[word]
        if len(self.split):
            place = self.place(words)[word]
            spot = np.minimum(np.searchsorted(self.split, place), len(self.split) - 1)
            slot = (mixed(words[context]) % self.slices[spot].astype(np.uint64)).astype(np.int64)
            where = np.where(self.split[spot] == place, self.first[spot] + slot, where)
        order = np.argsort(where, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return where[order], word[order], context[order], n[order], back[token_pair]


def _read_chunk(docs: bytes, tokens: bytes, words: bytes):
    doc, nulls, held_out, lengths = unpacked(docs)
    words, count = unpacked(words)
    return doc, nulls.astype(bool), held_out.astype(bool), lengths.astype(np.int64), unpacked(tokens)[0], words, count


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _spans(x: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal numbers."""
    begin = _runs(x)
    return list(zip(begin.tolist(), [*begin[1:].tolist(), len(x)][: len(begin)], strict=True))


def _pair_blocks(layout):
    """A chunk's pairs, a row for each range: words, how many contexts each has, contexts as numbers, their hashes, counts."""

    def cut(batches):
        plan = layout.value
        for b in batches:
            for chunk, *cells in zip(*[b.column(c).to_pylist() for c in ("chunk", "docs", "tokens", "words")], strict=True):
                _, _, held_out, lengths, tokens, words, _ = _read_chunk(*cells)
                where, word, context, n, _ = plan.pairs(words, tokens, lengths, ~held_out)
                begin = _runs(where)
                out = []
                for a, z in _spans(where):
                    first = _runs(word[a:z])
                    k = np.diff(np.append(first, z - a))
                    used, number = np.unique(context[a:z], return_inverse=True)
                    out.append(packed(words[word[a:z][first]], k.astype(np.uint32), number.astype(np.uint32), words[used], n[a:z].astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array(where[begin].astype(np.int32)), pa.array([chunk] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["range", "chunk", "pairs"])

    return cut


_PAIRS = "range int, chunk long, pairs binary"
_STATE = "range int, state binary, seats binary, contexts binary, chunks binary, asks binary"
#: Numbers of rows that are not of a part.
STATIC, SEATED, SUMS = -1, -2, -3


def _counted(key, rows):
    """A range's row: what training has of its pairs and contexts, and where in it each chunk finds its own."""
    chunk = rows.column("chunk").to_numpy()
    blocks = [unpacked(c) for c in rows.column("pairs").to_pylist()]
    names, word = np.unique(np.concatenate([b[0] for b in blocks]), return_inverse=True)
    k = np.concatenate([b[1] for b in blocks]).astype(np.int64)
    hashes, number = np.unique(np.concatenate([b[3] for b in blocks]), return_inverse=True)
    begin = np.cumsum([0, *[len(b[3]) for b in blocks]])
    context = np.concatenate([number[b[2].astype(np.int64) + at] for b, at in zip(blocks, begin, strict=False)])
    n = np.concatenate([b[4] for b in blocks]).astype(np.int64)
    n_words = np.array([len(b[0]) for b in blocks], np.int64)
    n_pairs = np.array([len(b[2]) for b in blocks], np.int64)
    del blocks, number
    pair, at = np.unique((np.repeat(word, k) << 32) | context, return_inverse=True)
    c = np.bincount(at, n, minlength=len(pair)).astype(np.int64)
    del context, n
    of_word, entry = pair >> 32, pair & 0xFFFFFFFF
    many = lambda which, weight=None: np.bincount(of_word[which], weight, minlength=len(names)).astype(np.uint32)
    every, several = slice(None), c > 1
    live = np.bincount(entry[several], minlength=len(hashes)) > 0
    state = packed(many(every), entry.astype(np.uint32), c.astype(np.uint32))
    seats = packed(many(every, c), many(c == 1), many(several), (np.cumsum(live) - 1)[entry[several]].astype(np.uint32), c[several].astype(np.uint32))
    contexts = packed(hashes, np.bincount(entry, c, minlength=len(hashes)).astype(np.uint32), np.bincount(entry[c == 1], minlength=len(hashes)).astype(np.uint32), live.astype(np.uint8))
    # Places grow within a chunk; their differences, modulo 2^32, are small.
    places = packed(np.diff(word.astype(np.uint32), prepend=np.uint32(0)), np.diff(at.astype(np.uint32), prepend=np.uint32(0)))
    cell = lambda x: pa.array([x], pa.binary())
    return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "state": cell(state), "seats": cell(seats), "contexts": cell(contexts), "chunks": _binary(chunk, n_words, n_pairs), "asks": cell(places)})


_MESSAGE = "part int, range int, cell binary"


def _messages(part, where, cells) -> pa.Table:
    return pa.table({"part": pa.array(part, pa.int32()), "range": pa.array(where, pa.int32()), "cell": pa.array(cells, pa.binary())})


def _to_parts(parts: int):
    """A range's contexts, a row for each part."""

    def cut(batches):
        for b in batches:
            for where, cell in zip(b.column("range").to_pylist(), b.column("contexts").to_pylist(), strict=True):
                columns = unpacked(cell)
                of = _in_ranges(columns[0], parts)
                spans = _spans(of)
                yield from _messages([int(of[a]) for a, _ in spans], [where] * len(spans), [packed(*[x[a:z] for x in columns]) for a, z in spans]).to_batches()

    return cut


def _met(key, rows):
    """A part's row: of its contexts that move from sweep to sweep, which ones each range has, and what training has of them. Each range is told which ones move, and the customers of the others, which have a table each."""
    rows = rows.sort_by("range")
    part, ranges = key[0].as_py(), rows.column("range").to_pylist()
    blocks = [unpacked(c) for c in rows.column("cell").to_pylist()]
    hashes, n, single, live = (np.concatenate([b[i] for b in blocks]) for i in range(4))
    names, at = np.unique(hashes, return_inverse=True)
    ends = np.cumsum([0, *[len(b[0]) for b in blocks]])
    del blocks, hashes
    n, single, lives = (np.bincount(at, x, minlength=len(names)).astype(np.int64) for x in (n, single, live))
    moves = lives > 0
    mine = moves[at]
    told = [packed(np.packbits(mine[a:z]), np.array([z - a]), n[at[a:z][~mine[a:z]]].astype(np.uint32)) for a, z in zip(ends, ends[1:], strict=False)]
    place = (np.cumsum(moves) - 1)[at[mine]]
    cell = packed(np.array(ranges, np.int32), np.diff(np.concatenate([[0], np.cumsum(mine)])[ends]).astype(np.uint32), np.diff(place.astype(np.uint32), prepend=np.uint32(0)), live[mine], n[moves].astype(np.uint32), single[moves].astype(np.uint32))
    return _messages([part] * (1 + len(ranges)), [STATIC, *ranges], [cell, *told])


def _pourer(sweep: int, least: int, seed: int, kept: bool, last: bool = False):
    """A part adds up its moving contexts' tables after so many sweeps and sends each range their gamma variables (-1: pooled); if kept, also tables and customers."""

    def pour(key, rows):
        part = key[0].as_py()
        rows = rows.sort_by("range")
        first, *sent = rows.column("cell").to_pylist()
        ranges, lengths, at, live, n, single = unpacked(first)
        at, live = np.cumsum(at, dtype=np.uint32).astype(np.int64), live.astype(bool)
        tables = n.astype(np.float64) ** DISCOUNT
        if sweep:
            up = np.concatenate([np.zeros(0, np.uint32), *[unpacked(c)[0] for c in sent]])
            tables = single.astype(np.int64) + np.bincount(at[live], up, minlength=len(n))
        x = np.random.default_rng([seed, sweep, part, 2]).standard_gamma(STRENGTH / DISCOUNT + tables).astype(np.float32)
        x[n < least] = -1
        cells, told, ends = [], [], np.cumsum(lengths.astype(np.int64))
        for a, z in zip(ends - lengths, ends, strict=True):
            mine = at[a:z]
            cells.append(None if last else packed(x[mine[live[a:z]]].view(np.uint32)))
            told.append(packed(tables[mine].astype(np.uint32), n[mine].astype(np.uint32)) if kept else None)
        return _messages([part] * len(cells), ranges, cells).append_column("told", pa.array(told, pa.binary()))

    return pour


@cache
def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of generalised Stirling numbers S(c, t), row c, column t."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c] + np.log(np.maximum(c - discount * np.arange(most + 1), 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
    return out


def seated(c: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers, with probability in proportion to S(c, t) pull^t."""
    t = np.minimum(c, 1)
    order = np.argsort(c, kind="stable")
    order = order[np.searchsorted(c[order], 2) :]
    table, sizes = stirling(discount), c[order]
    small = order[: np.searchsorted(sizes, EXACT, side="right")]
    for a, z in _spans(c[small]):
        n = int(c[small[a]])
        step = max(1, 2_000_000 // n)
        for at in range(a, z, step):
            own = small[at : min(z, at + step)]
            weight = table[n, 1 : n + 1][None, :] + np.log(np.maximum(pull[own], 1e-300))[:, None] * np.arange(1, n + 1)[None, :]
            weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            t[own] = 1 + (weight < (rng.random(len(own)) * weight[:, -1])[:, None]).sum(1)
    large = order[len(small) :]
    if len(large):
        t[large] = saddled(c[large].astype(np.float64), np.maximum(pull[large], 1e-300), discount, rng)
    return t


def saddled(c: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of many customers: tables are a Poisson number of groups whose sizes sum to c; drawn at the saddle point."""
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)
    for _ in range(60):  # of q = 1 - rho, with pull (1 - q) q^(discount - 1) = c
        middle = (low + high) / 2
        many = np.log(pull) + np.log(-np.expm1(middle)) + (discount - 1) * middle > np.log(c)
        low, high = np.where(many, middle, low), np.where(many, high, middle)
    q = np.exp(high)
    mean = pull * (1 - q**discount) / discount
    spread = np.maximum(mean - c / (1 + (1 - discount) * (1 - q) / q), 1e-9)
    few = 1 + rng.poisson(np.minimum(mean, 1e6))
    many = np.rint(mean + np.sqrt(spread) * rng.standard_normal(len(c)))
    return np.clip(np.where(mean < 50, few, many), 1, c).astype(np.int64)


def _seater(layout, sent, sweep: int, seed: int):
    """A range seats the customers of its pairs, and those of its words in the parent: to itself customers and tables of words and pairs, to parts the tables of contexts, and sums."""

    def seat(key, rows):
        where, plan, now = key[0].as_py(), layout.value, sent.value
        rows = rows.sort_by("part")
        part = rows.column("part").to_numpy()
        cells = dict(zip(part.tolist(), rows.column("cell").to_pylist(), strict=True))
        total, single, k, entry, c = unpacked(cells[STATIC])
        word, single, c = np.repeat(np.arange(len(k)), k), single.astype(np.int64), c.astype(np.int64)
        cut = plan.cut(where)
        weight = drawn_weight(*unpacked(cells[SEATED])[:2], sweep - 1, where, seed) if SEATED in cells else total.astype(np.float64)
        own = weight if cut < 0 else np.full(1, now["cut"][cut])
        p = (own + now["rest"] * now["uniform"]) / now["sum"]
        parts = [int(x) for x in part if x >= 0]
        sent_x = [unpacked(cells[x])[0].view(np.float32) for x in parts]
        x = np.concatenate([np.zeros(0, np.float32), *sent_x])[entry].astype(np.float64)
        rng = np.random.default_rng([seed, sweep, where])
        t = np.where(x < 0, c, seated(c, DISCOUNT * x * p[word], DISCOUNT, rng))
        m = single + np.bincount(word, t, minlength=len(single)).astype(np.int64)
        k = seated(m, np.full(len(m), ROOT_DISCOUNT * now["root"] * now["uniform"]), ROOT_DISCOUNT, rng) if cut < 0 else np.zeros(1, np.int64)
        ends = np.cumsum([0, *map(len, sent_x)])
        tables = np.bincount(entry, t, minlength=ends[-1]).astype(np.uint32)
        sums = np.array([cut, m.sum(), k.sum(), drawn_weight(m, k, sweep, where, seed).sum() if cut < 0 else 0.0])
        out = [packed(m.astype(np.uint32), k.astype(np.uint32), t.astype(np.uint32)), sums.tobytes(), *[packed(tables[a:z]) for a, z in zip(ends, ends[1:], strict=False)]]
        return _messages([SEATED, SUMS, *parts], [where] * len(out), out)

    return seat


def drawn_weight(m: np.ndarray, k: np.ndarray, sweep: int, where: int, seed: int) -> np.ndarray:
    """Weights of a range's words in the parent after a sweep; drawn again wherever they are needed."""
    return np.random.default_rng([seed, sweep, where, 1]).standard_gamma(np.maximum(m.astype(np.float64) - ROOT_DISCOUNT * k, 0))


class Model:
    """For each kept sweep the parent's totals and the most frequent words' customers less discounts in it; in a range also back-off weights of its contexts."""

    def __init__(self):
        self.back, self.root, self.cut = [], [], []

    def parent(self, share: np.ndarray, sweep: int) -> np.ndarray:
        """Probability of words of the given customers less discounts in the parent."""
        whole, new = self.root[sweep]
        return (share + new) / whole


def fit(state: DataFrame, contexts: DataFrame, layout, tokens: int, v: int, burn_in: int, kept: int, seed: int, least: int):
    """(what parts said before, and ranges and parts in kept sweeps: sweep, part, range, cell; model)."""
    spark, plan, rng = state.sparkSession, layout.value, np.random.default_rng(seed)
    uniform = 1.0 / (v + 1)
    now = {"rest": ROOT_STRENGTH, "sum": tokens + ROOT_STRENGTH, "cut": plan.count[plan.split].astype(np.float64), "uniform": uniform, "root": ROOT_STRENGTH / ROOT_DISCOUNT + float(v)}
    pour = lambda rows, *how: stored(rows.groupBy("part").applyInArrow(_pourer(*how), f"{_MESSAGE}, told binary"), "poured")
    seats = state.select(F.lit(STATIC).alias("part"), "range", F.col("seats").alias("cell"))
    columns, model, said, told = ("part", "range", "cell"), Model(), None, []
    moving = contexts.filter(F.col("range") == STATIC)
    down = pour(moving, 0, least, seed, False)
    for i in range(burn_in + kept):
        sent = spark.sparkContext.broadcast(now)
        rows = seats.union(down.select(*columns))
        rows = rows.union(said.filter(F.col("part") == SEATED)) if said is not None else rows
        before, said = said, stored(rows.groupBy("range").applyInArrow(_seater(layout, sent, i, seed), _MESSAGE), "seated")
        # What burn-in said is read no more; nor is what it was answered.
        for old in [before] * (0 < i <= burn_in) + [down] * (i <= burn_in):
            for path in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
                remove(spark, path)
        sums = sorted((r["range"], *np.frombuffer(r["cell"])) for r in said.filter(F.col("part") == SUMS).collect())
        m, k, weight = (sum(r[j] for r in sums) for j in (2, 3, 4))
        cut_m = np.zeros(len(plan.split), np.int64)
        for r in sums:
            if r[1] >= 0:
                cut_m[int(r[1])] += int(r[2])
        cut_k = seated(cut_m, np.full(len(cut_m), ROOT_DISCOUNT * now["root"] * uniform), ROOT_DISCOUNT, rng)
        cut = rng.standard_gamma(np.maximum(cut_m - ROOT_DISCOUNT * cut_k, 0))
        k, weight = k + cut_k.sum(), weight + cut.sum()
        new = ROOT_STRENGTH + ROOT_DISCOUNT * k
        rest = rng.standard_gamma(new)
        now = {"rest": rest, "sum": weight + rest, "cut": cut, "uniform": uniform, "root": rng.standard_gamma(ROOT_STRENGTH / ROOT_DISCOUNT + k)}
        down = pour(moving.union(said.filter("part >= 0")), i + 1, least, seed, i >= burn_in, i + 1 == burn_in + kept)
        if i >= burn_in:
            told += [said.filter(F.col("part") == SEATED), down.select("part", "range", F.col("told").alias("cell"))]
            told[-2:] = [x.select(F.lit(i - burn_in).alias("sweep"), *columns) for x in told[-2:]]
            model.root.append((ROOT_STRENGTH + m, new * uniform))
            model.cut.append(cut_m - ROOT_DISCOUNT * cut_k)
    every = contexts.filter("range >= 0").select(F.lit(STATIC).alias("sweep"), *columns)
    for x in told:
        every = every.union(x)
    return every, model


def _answerer(layout, sent, least: int):
    """For each chunk's words of a range their count, and for its pairs their probability."""

    def answer(key, counts, told):
        where, plan, whole = key[0].as_py(), layout.value, sent.value
        k, entry, c = unpacked(counts.column("state")[0].as_py())
        word, c, cut = np.repeat(np.arange(len(k)), k), c.astype(np.int64), plan.cut(where)
        total = np.bincount(word, c, minlength=len(k)).astype(np.int64)
        said = {}
        for sweep, part, cell in zip(*[told.sort_by([("sweep", "ascending"), ("part", "ascending")]).column(x).to_pylist() for x in ("sweep", "part", "cell")], strict=True):
            said.setdefault(sweep, []).append(unpacked(cell))
        still = said.pop(STATIC)
        moves = np.concatenate([np.unpackbits(x[0], count=int(x[1][0])) for x in still]).astype(bool)
        n = np.zeros(len(moves))
        n[~moves] = np.concatenate([x[2] for x in still])
        tables = n.copy()
        model, share, less, several = Model(), [], np.minimum(c, 1).astype(np.float64), c > 1
        less[several] = 0
        for sweep, ((m, k0, t), *parts) in sorted(said.items()):
            tables[moves], n[moves] = (np.concatenate([x[i] for x in parts]) for i in (0, 1))
            share.append(m - ROOT_DISCOUNT * k0 if cut < 0 else np.full(1, whole.cut[sweep][cut], np.float64))
            less[several] += t / len(said)
            model.back.append((STRENGTH + DISCOUNT * tables) / (STRENGTH + n))
        model.root = whole.root
        own = SimpleNamespace(count=n)
        context = np.where(n[entry] < least, 0, entry.astype(np.int64) + 1)
        p = probabilities(model, own, word, context, np.array(share), c - DISCOUNT * less).astype(np.float32).view(np.uint32)
        chunk, n_words, n_pairs = unpacked(counts.column("chunks")[0].as_py())
        asked, place = (np.cumsum(x, dtype=np.uint32) for x in unpacked(counts.column("asks")[0].as_py()))
        w, q = np.cumsum([0, *n_words]), np.cumsum([0, *n_pairs])
        cells = [packed(total[asked[w[i] : w[i + 1]]], p[place[q[i] : q[i + 1]]]) for i in range(len(chunk))]
        return pa.table({"chunk": chunk, "range": pa.array(np.full(len(chunk), where, np.int32)), "found": pa.array(cells, pa.binary())})

    return answer


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _arrow_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def probabilities(model: Model, plan: Layout, word: np.ndarray, context: np.ndarray, share: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Mean over kept sweeps of the predictive probability of each pair. context: from 1, 0 for pooled; share: a row for each sweep, a column for each word."""
    out = np.zeros(len(word))
    own = context > 0
    for i, row in enumerate(share):
        p = model.parent(row.astype(np.float64), i)[word]
        back = np.concatenate([[1.0], model.back[i]])[context]
        out += back * p
    out /= max(1, len(share))
    out[own] += pair[own] / (STRENGTH + plan.count[context[own] - 1])
    return out


def _scorer(layout, n: int, v: int):
    def score(_key, chunk, found):
        if not len(chunk):
            return _arrow_schema().empty_table()
        plan = layout.value
        doc, nulls, held_out, lengths, tokens, words, _ = _read_chunk(*[chunk.column(c)[0].as_py() for c in ("docs", "tokens", "words")])
        where, word, _, _, token_pair = plan.pairs(words, tokens, lengths, ~held_out)
        found = found.sort_by("range")  # as pairs are laid out
        cells = [unpacked(c) for c in found.column("found").to_pylist()]
        count, p = np.zeros(len(words), np.int64), np.zeros(len(word))
        for cell, (a, z) in zip(cells, _spans(where), strict=True):
            count[word[a:z][_runs(word[a:z])]] = cell[0]
            p[a:z] = cell[1].view(np.float32)
        # A word that is cut has its count in the layout.
        place = plan.place(words)
        often = np.isin(place, plan.split)
        count[often] = plan.count[place[often]]
        logs = np.log10(np.maximum(p, 1e-300))
        starts = np.cumsum(lengths) - lengths
        add = lambda x: np.add.reduceat(x, starts)
        base = np.log10((count + 1.0) / (n + 1.0 * (v + 1)))
        columns = [pa.array(doc, mask=nulls), held_out, lengths, add((count > 0).astype(np.int64)[tokens]), np.full(len(lengths), n), add(base[tokens]), add(logs[token_pair])]
        return pa.table(dict(zip(_arrow_schema().names, columns, strict=True)), schema=_arrow_schema())

    return score


def score_texts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 7, fold: int = 2, burn_in: int = 2, kept: int = 3, seed: int = 8, least_context: int = 1, range_tokens: int = RANGE_TOKENS
) -> DataFrame:
    """A row for each of docs: doc_id, held_out (crc32 of the id's text, modulo folds, is fold), n_tokens, n_known, train_tokens, base_score (add-one), score."""
    spark = docs.sparkSession
    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == fold
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    chunks = stored(rows.mapInArrow(_chunks, _CHUNK), "chunks")
    n = int(chunks.agg(F.sum("n").alias("n")).first()["n"] or 0)
    ranges = max(1, -(-n // range_tokens))
    often = chunks.select("words").mapInArrow(_word_blocks(ranges), "range int, words binary").groupBy("range").applyInArrow(_frequent(range_tokens + 1), "v long, often binary").collect()
    cells = [unpacked(bytes(r["often"])) for r in often]
    v = sum(r["v"] for r in often)
    plan = Layout(np.concatenate([np.zeros(0, np.uint64), *[c[0] for c in cells]]), np.concatenate([np.zeros(0, np.int64), *[c[1] for c in cells]]), n, range_tokens)
    layout = spark.sparkContext.broadcast(plan)
    pairs = chunks.select("chunk", "docs", "tokens", "words").mapInArrow(_pair_blocks(layout), _PAIRS)
    state = stored(pairs.groupBy("range").applyInArrow(_counted, _STATE), "counts")
    contexts = state.select("range", "contexts").mapInArrow(_to_parts(plan.ranges), _MESSAGE).groupBy("part").applyInArrow(_met, _MESSAGE)
    told, model = fit(state, stored(contexts, "contexts"), layout, n, v, burn_in, kept, seed, least_context)
    sent = spark.sparkContext.broadcast(model)
    asked = state.select("range", "state", "chunks", "asks").groupBy("range")
    found = asked.cogroup(told.groupBy("range")).applyInArrow(_answerer(layout, sent, least_context), "chunk long, range int, found binary")
    return chunks.drop("n").groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_scorer(layout, n, v), _SCORED)
