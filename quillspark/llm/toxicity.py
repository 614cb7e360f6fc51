"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks, trained on labelled sentences.

Kernel of two words: subsequences of three letters that both have, within SPAN letters, each gap weighing GAP; word ends count
as letters; characters that are no letters are left out, inserted letters are gaps. Words are scaled by what a word of their
length has, similarities are sharpened by a power; letters spaced out one by one (three or more) are a word as well. A sentence (up to 30 words, ended by . ! ? or the
text) is the sum of its words.

Landmarks are words of the training sentences: those that tell the classes apart best, and ordinary ones. Sentences are mapped
by Nyström onto them, and a linear machine (squared hinge) is fitted. A sentence of a toxic document need not be toxic itself: after a fit, those
on the clean side change their label, but for the most toxic one of each document, and it is fitted again. Toxic words also stand in the fit with a
strange letter at each place inside them. A document's score is
logistic in its most toxic sentence and in how much of it is toxic, fitted on labelled documents that the machine has not seen.

The fit takes at most ``toxic`` and ``clean`` labelled documents (the first by a hash of the id) of up to LONGEST characters, and
runs in the driver. Since the machine is linear in subsequences, the landmarks and their weights become one table with a
number for each three letters, of fixed size, which the tasks get: a word then costs a lookup for each of its subsequences,
however many landmarks there are. All whole texts are scored, their distinct words once for each piece of the input.

Null and empty texts have no sentence and get the score that this gives. Null ids have no label and are not held out. Repeated
rows are scored each by itself; a document with several labels is toxic if one says so. With one class or none in the
training part, every score is the share of toxic labels there (0 without labels). An empty table gives an empty result.
Language, source and id are no inputs of a score; other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import pieces
from .tokens import split_words

SPAN = 6
GAP = 0.75
#: Similarities are raised to this power; those under the least count as none.
POWER = 3
LEAST = 0.5
CODES = 64
START = 1
#: Longer words are cut into pieces of so many characters that overlap by half.
LONG = 24
APART = "ⵣ"
SENTENCE = 30
SPACED = 3
ENDS = frozenset(".!?")
NO_LETTERS = re.compile(r"[\W\d_]+")
PIECE_BYTES = 24_000_000
TOXIC, CLEAN = 1_500, 3_000
LONGEST = 20_000
LANDMARKS = 128
ROUNDS = 4
FOLDS = 5
#: Offsets of the second and third letter, and their weight.
STEPS = [(j, k, GAP ** (k - 2)) for j, k in itertools.combinations(range(1, SPAN), 2)]


def bare(word: str) -> str:
    """A word's letters in lower case."""
    word = word if word.isascii() and word.islower() else word.lower()
    return word if word.isalpha() else NO_LETTERS.sub("", word)


def _codes(points: np.ndarray) -> np.ndarray:
    """A code for each letter, from 2 on; 1 is a word's end."""
    kinds, at = np.unique(points, return_inverse=True)
    coded = [2 + p - 97 if 97 <= p <= 122 else 28 + p % 36 for p in kinds.tolist()]
    return np.array(coded, np.int64)[at]


class Spelled:
    """Bare words as rows of codes, by length: (places among the words, codes)."""

    def __init__(self, words: list[str]):
        owner, cut = [], []
        for i, w in enumerate(words):
            if len(w) <= LONG:
                if w:
                    owner.append(i)
                    cut.append(w)
            else:
                for at in range(0, len(w) - LONG // 2, LONG // 2):
                    owner.append(i)
                    cut.append(w[at : at + LONG])
        owner, size = np.array(owner, np.int64), np.fromiter(map(len, cut), np.int64, len(cut))
        codes = _codes(np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32))
        first, order = np.cumsum(size) - size, np.argsort(size, kind="stable")
        self.n, self.groups = len(words), []
        bounds = np.flatnonzero(np.diff(size[order], prepend=-1))
        for lo, hi in itertools.pairwise([*bounds.tolist(), len(order)]):
            rows, n = order[lo:hi], int(size[order[lo]])
            whole = np.full((n + 2, len(rows)), START, np.int64)
            for j in range(n):
                whole[j + 1] = codes[first[rows] + j]
            self.groups.append((owner[rows], whole))

    def subsequences(self):
        """For words of one length: which they are, and for each place the keys and the scaled weight."""
        for owner, c in self.groups:
            n = len(c)
            norm = sum(w * w for i in range(n) for j, k, w in STEPS if i + k < n) ** 0.5
            yield owner, [((c[i] * CODES + c[i + j]) * CODES + c[i + k], w / norm) for i in range(n) for j, k, w in STEPS if i + k < n]


def sparse(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, key, value): the subsequences of each word with their scaled weights."""
    found = [(owner, key, np.full(len(owner), w)) for owner, places in Spelled(words).subsequences() for key, w in places]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    owner, key, value = (np.concatenate(x) for x in zip(*found, strict=True))
    both, at = np.unique(owner * CODES**3 + key, return_inverse=True)
    return both // CODES**3, both % CODES**3, np.bincount(at, value)


class Kernel:
    """Similarities to landmarks, raised to POWER; those under LEAST are 0, which most words are known to be by a bound."""

    def __init__(self, landmarks: list[str]):
        owner, key, value = sparse(landmarks)
        keys, column = np.unique(key, return_inverse=True)
        self.dense = np.zeros((len(keys) + 1, len(landmarks)), np.float32)
        np.add.at(self.dense, (column, owner), value)
        self.place = np.full(CODES**3, len(keys), np.int32)
        self.place[keys] = np.arange(len(keys))
        self.most = self.dense.max(axis=1, initial=0)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(words that are near a landmark, their similarities); a long word counts by its nearest pieces."""
        near, found = [], []
        for owner, places in Spelled(words).subsequences():
            for lo in range(0, len(owner), 1 << 15):
                cut = slice(lo, lo + (1 << 15))
                at = [(self.place[key[cut]], np.float32(w)) for key, w in places]
                bound = sum(self.most[x] * w for x, w in at)
                some = np.flatnonzero(bound >= LEAST)
                for part in np.array_split(some, -(-len(some) // 2048) or 1):
                    sums = np.zeros((len(part), self.dense.shape[1]), np.float32)
                    for x, w in at:
                        sums += self.dense[x[part]] * w
                    some = np.flatnonzero((sums >= LEAST).any(axis=1))
                    near.append(owner[cut][part[some]])
                    found.append(np.where(sums[some] >= LEAST, sums[some], 0) ** POWER)
        near, found = np.concatenate([np.zeros(0, np.int64), *near]), np.concatenate([np.zeros((0, self.dense.shape[1]), np.float32), *found])
        at, back = np.unique(near, return_inverse=True)
        out = np.zeros((len(at), found.shape[1]), np.float32)
        np.maximum.at(out, back, found)
        return at, out


class Sentences:
    """The sentences of texts: numbers of words, where sentences and texts begin, and words spelled out letter by letter."""

    def __init__(self, texts: pa.Array):
        ids, lengths, dictionary = split_words(texts)
        written = dictionary.to_pylist()
        known: dict[str, int] = {}
        at = np.fromiter((known.setdefault(bare(w), len(known)) for w in written), np.int64, len(written))
        self.words, self.ids = list(known), at[ids]
        n, self.texts = len(self.ids), len(lengths)
        begins = np.cumsum(lengths) - lengths
        first = np.zeros(n + 1, bool)
        first[begins[lengths > 0]] = True
        ender = np.fromiter((w[-1:] in ENDS for w in written), bool, len(written))[ids]
        start = first[:n].copy()
        start[1:] |= ender[:-1]
        at = np.flatnonzero(start)
        place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
        self.starts = np.flatnonzero(place % SENTENCE == 0)
        self.owner = np.searchsorted(np.cumsum(lengths), self.starts, side="right")
        alone = np.fromiter((len(w) == 1 for w in self.words), bool, len(self.words))[self.ids]
        opens = alone & np.append(True, ~alone[:-1] | first[1:n])[:n]
        runs = np.flatnonzero(opens)
        ends = np.flatnonzero(alone & np.append(~alone[1:] | first[1:n], True)[:n]) + 1
        long = ends - runs >= SPACED
        self.runs = runs[long]
        self.spelled = ["".join(self.words[i] for i in self.ids[lo:hi]) for lo, hi in zip(runs[long], ends[long], strict=True)]

    def most(self, value) -> np.ndarray:
        """Each sentence's largest word. value: gives numbers for words."""
        if not len(self.ids):
            return np.zeros(0)
        each = value(self.words)[self.ids]
        np.maximum.at(each, self.runs, value(self.spelled))
        return np.maximum.reduceat(each, self.starts)


def _by_word(sentences: Sentences, toxic: np.ndarray):
    """Bare words with the number of toxic and clean texts that have them, the signed root of the likelihood ratio, and the pairs (text, word)."""
    names, at = np.unique([*sentences.words, *sentences.spelled], return_inverse=True)
    of = lambda tokens: sentences.owner[np.searchsorted(sentences.starts, tokens, side="right") - 1]
    text = np.concatenate([of(np.arange(len(sentences.ids))), of(sentences.runs)])
    word = np.concatenate([at[sentences.ids], at[len(sentences.words) :]])
    both = np.unique(text * len(names) + word)
    text, word = both // len(names), both % len(names)
    pos, neg = np.bincount(word[toxic[text]], minlength=len(names)), np.bincount(word[~toxic[text]], minlength=len(names))
    n_pos, n_neg = max(1, toxic.sum()), max(1, (~toxic).sum())
    share = (pos + neg) / (n_pos + n_neg)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.nan_to_num(pos * np.log(pos / n_pos / share)) + np.nan_to_num(neg * np.log(neg / n_neg / share))
    return names.tolist(), pos, neg, np.sqrt(2 * np.maximum(ratio, 0)) * np.where(pos / n_pos > neg / n_neg, 1, -1), (text, word)


def _landmarks(words: list[str], signed: np.ndarray, in_clean: np.ndarray, n: int) -> list[str]:
    """Most of them words that toxic texts have and clean ones lack; the rest frequent words, and some that a hash picks."""
    picks: dict[str, None] = {}
    for limit, order in ((n * 3 // 4, np.argsort(-signed, kind="stable")), (n * 7 // 8, np.argsort(-in_clean, kind="stable")), (n, np.argsort([hash_of(w) for w in words], kind="stable"))):
        for i in order.tolist():
            if len(picks) >= limit:
                break
            if 2 <= len(words[i]) <= LONG:
                picks.setdefault(words[i])
    return list(picks)


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge: Newton steps on the rows within the margin. The bias is not penalised."""
    one = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(one.shape[1]), np.full(one.shape[1], ridge)
    keep[-1] = 1e-6
    near = np.ones(len(y), bool)
    for _ in range(20):
        a = one[near]
        w = np.linalg.solve((a * cost[near, None]).T @ a + np.diag(keep), a.T @ (cost[near] * y[near]))
        now = y * (one @ w) < 1
        if (now == near).all():
            break
        near = now
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression, the last one for the constant; Newton steps, damped by the ridge."""
    one = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(one.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + ridge * np.eye(len(w)), one.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _measures(value: np.ndarray, owner: np.ndarray, n: int, none: float) -> np.ndarray:
    """Of each document: its most toxic sentence, the share of toxic sentences, and how many there are."""
    most = np.full(n, none)
    if len(value):
        new = np.flatnonzero(np.diff(owner, prepend=-1))
        most[owner[new]] = np.maximum.reduceat(value, new)
    many, all_ = np.bincount(owner, value > 0, minlength=n), np.bincount(owner, minlength=n)
    return np.stack([np.clip(most, -2, 2), np.log1p(20 * many / np.maximum(1, all_)), np.log1p(many)], 1)


def inserted(word: str) -> list[str]:
    """The word with a letter that no other word has at each place inside it."""
    return [f"{word[:i]}{APART}{word[i:]}" for i in range(1, len(word))] if len(word) >= 4 else []


class Model:
    """Kernel and weights of the machine, weights of the logistic; or a constant score where there is nothing to learn."""

    def __init__(self, texts: list[str], toxic: np.ndarray, seen: np.ndarray, landmarks: int = LANDMARKS):
        self.constant = float(toxic.mean()) if len(toxic) else 0.0
        self.weights = None
        if not (toxic.any() and (~toxic).any()):
            return
        if not all(len(set(toxic[part])) == 2 for part in (seen, ~seen)):
            seen = np.ones(len(toxic), bool)  # too few labels to keep some apart
        fit = Sentences(pa.array([t for t, s in zip(texts, seen, strict=True) if s], pa.string()))
        y = toxic[seen]
        words, in_toxic, in_clean, signed, doc = _by_word(fit, y)
        chosen = _landmarks(words, signed, in_clean, landmarks)
        if not chosen:
            return
        self.kernel = Kernel(chosen)
        _, own = self.kernel.rows(chosen)
        values, vectors = np.linalg.eigh(own.astype(np.float64) if len(own) == len(chosen) else np.eye(len(chosen)))
        kept = values > 1e-3 * values.max()
        onto = (vectors[:, kept] / np.sqrt(values[kept])).astype(np.float32)
        at, rows = self.kernel.rows(words)
        x = rows @ onto
        # Words near no landmark are all the same row.
        far = np.zeros((1, x.shape[1]), np.float32)
        label = (signed[at] > 2.5) & (in_clean[at] == 0)
        place = np.full(len(words), -1)
        place[at] = np.arange(len(at))
        near = place[doc[1]] >= 0
        pair_doc, pair_at = doc[0][near & y[doc[0]]], place[doc[1][near & y[doc[0]]]]
        for _ in range(ROUNDS):
            cost = np.where(label, np.sqrt(in_toxic[at]), np.sqrt(np.maximum(1, in_clean[at])))
            copies = [(v, i) for i in np.flatnonzero(label).tolist() for v in inserted(words[at[i]])]
            held, parted = self.kernel.rows([v for v, _ in copies])
            weight = cost[np.array([i for _, i in copies], np.int64)[held]] / 2
            w, self.bias = machine(np.vstack([x, parted @ onto, far]), np.concatenate([np.where(label, 1.0, -1.0), np.ones(len(parted)), [-1.0]]), np.concatenate([cost, weight, [len(words) ** 0.5]]))
            value = x @ w + self.bias
            now = (in_clean[at] == 0) & (value > 0)
            best = np.lexsort((-value[pair_at], pair_doc))
            first = best[np.flatnonzero(np.diff(pair_doc[best], prepend=-1))]
            now[pair_at[first][value[pair_at[first]] > -0.5]] = True
            if (now == label).all():
                break
            label = now
        self.onto = (onto @ w).astype(np.float32)
        rest = ~seen if (~seen).any() else seen
        apart = self.measures(pa.array([t for t, s in zip(texts, rest, strict=True) if s], pa.string()))
        self.weights = logistic(apart, toxic[rest].astype(float))

    def value(self, words: list[str]) -> np.ndarray:
        """What the machine says of each word; toxic over 0."""
        out = np.full(len(words), self.bias)
        at, rows = self.kernel.rows(words)
        out[at] += rows @ self.onto
        return out

    def measures(self, texts: pa.Array) -> np.ndarray:
        s = Sentences(texts)
        return _measures(s.most(self.value), s.owner, s.texts, self.bias)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.measures(texts) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, folds: int = FOLDS) -> Model:
    """The model of labelled documents whose hashed id is not in the first fold. labels: doc_id, toxic (0 or 1)."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc % folds != 0)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    order = F.md5(F.concat(F.lit("11:"), F.col("doc_id").cast("string")))
    chosen = known.filter("y = 1").orderBy(order, "doc_id").limit(toxic).union(known.filter("y = 0").orderBy(order, "doc_id").limit(clean))
    # So many ids at most.
    rows = docs.filter(F.char_length(F.coalesce("text", F.lit(""))) <= LONGEST).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("text", "y", (F.floor(crc / folds) % 3 > 0).alias("seen"), order.alias("o"), F.md5(F.coalesce("text", F.lit(""))).alias("m")).orderBy("o", "m").limit(toxic + clean).collect()
    return Model([r["text"] for r in rows], np.array([r["y"] == 1 for r in rows], bool), np.array([r["seen"] for r in rows], bool))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, toxic: int = TOXIC, clean: int = CLEAN, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = train(given, labels.select(F.col("doc_id"), F.col("toxic").cast("int")), toxic, clean, folds)

    def score(batches):
        for b in pieces(batches, piece_bytes):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(b.column("text")), pa.float64())], names=["doc_id", "held_out", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    scored = given.withColumn("held_out", held_out).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
