"""Document scores of a hashed maximum-entropy language model over words.

P(token | history) = P(class | history) * P(token | class, history). Both factors are softmaxes whose
weights belong to hashed features of the three preceding words: n-grams of words and of classes and
skips for the class, the class with the last word, the one before and the last two classes for the token
in it. Unigram counts are the base measure both start from.

The most frequent tokens (of two occurrences or more) fill the word classes, which have a softmax of their own; words before which the
same frequent words stand share a class. All other tokens are classed by their shape, so that unknown
tokens have a class too; in it a token has its relative frequency with an absolute discount, whose mass
goes to the unknown token.

Training counts (history, target) over all learned texts with a ``groupBy`` on ranges of hashed histories;
that table grows with the corpus and holds a range in a row, packed. Its events are dealt over rounds. In
a round each task reads its rows as a stream and takes AdaGrad steps from common weights; a row of weights
then moves by the mean of the tasks that moved it, merged in a tree. Weights have a fixed size, token counts do not: workers hold the frequent head only (a
bounded dictionary), all other tokens meet their counts in a join on 12 bytes of hashes.
"""

from __future__ import annotations

import math
import zlib
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import held_out, query, stored, table

#: Classes of words, words in each, classes of shapes, and all classes.
OWN, SLOTS, SHAPES = 64, 64, 32
CLASSES = OWN + SHAPES
#: Tokens in word classes. A target below it is such a token, others are MODELLED + shape.
MODELLED = OWN * SLOTS
#: Hashed features share so many rows of weights, in either factor (at most 2 ** 16).
ROWS = 1 << 14
#: Tokens whose counts every worker holds at most.
HEAD = 1 << 17
END = b"\n"
#: Rounds, rate of the steps, and the squared gradient that every row starts with.
ROUNDS, RATE, START = 3, 0.25, 0.1
#: Events of one step at most, and steps of a task to aim at where there are few.
EVENTS, STEPS = 2048, 64
#: Events that make a task of training; those that make one where there is a task for every core.
TASK, LARGE = 1 << 16, 1 << 22
#: Gradients of a row of weights that is met up to so often in a step are added one by one.
FEW = 8
#: Events of a range of histories, about, and events that a task sorts at a time before they are dealt.
RANGE, SORTED = 1 << 18, 1 << 20
#: Tasks whose weights are merged at a time.
FAN = 32
#: Bytes of text in a worker's arrays at a time (or one document, if it is longer): coded, and only counted.
CODED, MET = 1 << 21, 1 << 23
#: Histories pack three numbers of words: places of tokens in word classes, for others a hash with their
#: shape; the last is the one before the first token.
BITS = 21
BASE = 1 << BITS
BEGIN = BASE - 1
HASHES = (BEGIN - MODELLED) // SHAPES
#: Events that are scored at a time.
NEAR = 4096
#: Beyond it exponents are lowered first; products of exponentials below this are not trusted.
SAFE, LEAST = 60, 1e-25
#: So many frequent words, one and two places before, tell which words share a class.
CONTEXT = 64


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows with ``most`` bytes of text or a row more."""
    for batch in batches:
        size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // most, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(size))):
            yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def split_texts(texts: pa.Array) -> pa.ListArray:
    """Words between ASCII white space with A-Z lower-cased; white space at the ends of a text leaves empty
    ones."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over rows with a column ``text``; a task adds up what it meets in MET bytes of text."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "text", MET):
            token, c = split_texts(part.column("text")).flatten().value_counts().flatten()
            words = pa.RecordBatch.from_arrays([token.cast(pa.string()), c], names=["token", "c"])
            yield words.filter(pc.not_equal(words.column("token"), ""))
            yield pa.RecordBatch.from_pydict({"token": [END.decode()], "c": [len(part)]}, schema=words.schema)

    found = docs.select(whole_text(F.col("text")).alias("text")).mapInArrow(counts, "token string, c long")
    return found.groupBy("token").agg(F.sum("c").alias("c"))


def head_cut(counts: DataFrame, most: int = HEAD) -> int:
    """The least count for which no more than ``most`` tokens have it or a higher one."""
    total, cut = 0, None
    by = counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c"))
    for row in by.toLocalIterator():
        total += row["n"]
        if total > most:
            break
        cut = row["c"]
    return cut if cut is not None else (1 << 62)


def shape_class(token: bytes) -> int:
    """Class of a token without one of its own: by its first character beyond ASCII, else by its last
    two."""
    if token.isascii():
        return OWN + zlib.crc32(token[-2:]) % SHAPES
    shape = next(c for c in token.decode() if c > "\x7f")
    return OWN + zlib.crc32(shape.encode()) % SHAPES


def class_column(token: Column, own: list[str]) -> Column:
    """The same in SQL, with tokens that have classes of their own."""
    ascii_only = F.octet_length(token) == F.char_length(token)
    beyond = F.regexp_extract(token, r"[^\x00-\x7F]", 0)
    shape = F.when(ascii_only, F.substring(token, -2, 2)).otherwise(beyond)
    out = F.lit(OWN) + F.pmod(F.crc32(shape.cast("binary")), F.lit(SHAPES)).cast("int")
    if own:
        places = F.array_position(F.array(*[F.lit(x) for x in own]), token).cast("int")
        out = F.when(places > 0, places - 1).otherwise(out)
    return out


def feature_rows(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Row of weights of a feature, by its kind and its words."""
    x = np.uint64(kind + 1)
    for p in parts:
        x = x * np.uint64(BASE) + p.view(np.uint64)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x &= np.uint64(ROWS - 1)
    return x.view(np.int64)


def histories(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The three words before each place, packed; texts begin at ``firsts``."""
    n = len(words)
    owner = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, n)))
    out = np.zeros(n, dtype=np.int64)
    place = np.arange(n) - firsts[owner]
    for back in (3, 2, 1):
        h = np.full(n, BEGIN, dtype=np.int64)
        h[back:] = words[: n - back] if n > back else words[:0]
        h[place < back] = BEGIN
        out = out * BASE + h
    return out


def split_history(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return code & (BASE - 1), code >> BITS & (BASE - 1), code >> 2 * BITS


def class_rows(past: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """Rows for the class: the last word, the last two, skips, and the three classes ``before``."""
    h1, h2, h3 = past
    return [feature_rows(0, h1), feature_rows(1, h1, h2), feature_rows(2, h2), feature_rows(3, h3),
            feature_rows(4, *before)]


def slot_rows(past: np.ndarray, before: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
    """Rows for the token in its class: the last word, the one before, and the last two classes."""
    h1, h2, _ = past
    return [feature_rows(5, cls, h1), feature_rows(6, cls, h2), feature_rows(7, cls, *before[:2])]


def summed(weights: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    z = weights[rows[0]]
    more = np.empty_like(z)
    for r in rows[1:]:
        z += np.take(weights, r, axis=0, out=more, mode="clip")
    z += bias
    return z


def softmax(z: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    if max(z.max(), -z.min()) > SAFE:
        z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= (z @ np.ones(z.shape[1], dtype=z.dtype))[:, None]
    return z


def powers(weights: np.ndarray) -> np.ndarray:
    """Exponentials of each row, divided by its largest."""
    return np.exp(weights - weights.max(axis=1, keepdims=True))


def log_share(
    weights: np.ndarray, power: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, share: np.ndarray, at: np.ndarray
) -> np.ndarray:
    """Log of the softmax of the summed rows and the bias at the places ``at``. Multiplies ``power`` and
    ``share``, the exponentials of both, but adds logarithms where that comes near the least number."""
    z = power[rows[0]]
    more = np.empty_like(z)
    for r in rows[1:]:
        z *= np.take(power, r, axis=0, out=more, mode="clip")
    z *= share
    got = z.ravel()[np.arange(len(at)) * z.shape[1] + at]
    out = np.log(np.maximum(got, LEAST), dtype=np.float64)
    out -= np.log(np.maximum(z @ np.ones(z.shape[1], dtype=z.dtype), LEAST))
    low = np.flatnonzero(got < LEAST)
    if len(low):
        z = summed(weights, [r[low] for r in rows], bias if bias.ndim == 1 else bias[low]).astype(np.float64)
        z -= z.max(axis=1, keepdims=True)
        out[low] = z[np.arange(len(low)), at[low]] - np.log(np.exp(z).sum(axis=1))
    return out


class Model:
    """Weights of both factors, the class of every word in one, and the base measure: log shares of the
    classes and of the words in each. ``order`` holds the words' places class by class."""

    def __init__(self, order: np.ndarray, words: np.ndarray, shapes: np.ndarray):
        slots = words[order].reshape(OWN, SLOTS)
        classes = np.append(slots.sum(axis=1), shapes)
        bias = np.log(classes / classes.sum()), np.log(slots / slots.sum(axis=1, keepdims=True))
        self.bias = [b.astype(np.float32) for b in bias]
        self.weights = [np.zeros((ROWS, n), dtype=np.float32) for n in (CLASSES, SLOTS)]
        at = np.argsort(order)
        self.classes = np.append(at // SLOTS, np.arange(OWN, CLASSES))
        self.slots = at % SLOTS

    def __getstate__(self) -> dict:
        """Workers get the weights in 16 bits."""
        return self.__dict__ | {"weights": [w.astype(np.float16) for w in self.weights]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"weights": [w.astype(np.float32) for w in state["weights"]]}

    def before(self, past: tuple[np.ndarray, ...]) -> np.ndarray:
        """Classes of the three words of a history; the place before the text is a class of its own."""
        words = np.array(past)
        known = np.where(words < MODELLED, words, MODELLED + (words - MODELLED) % SHAPES)
        return np.where(words == BEGIN, CLASSES, self.classes[known])

    def __call__(self, code: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log P(class | history) and, in a word class, P(token | class, history) of each target."""
        out = np.empty(len(code))
        power, share = [powers(w) for w in self.weights], [np.exp(b) for b in self.bias]
        for at in range(0, len(code), NEAR):
            past, t = split_history(code[at : at + NEAR]), target[at : at + NEAR]
            cls, before = self.classes[t], self.before(past)
            got = log_share(self.weights[0], power[0], class_rows(past, before), self.bias[0], share[0], cls)
            own = np.nonzero(t < MODELLED)[0]
            if len(own):
                cls, at_slot = cls[own], self.slots[t[own]]
                rows = slot_rows([h[own] for h in past], before[:, own], cls)
                got[own] += log_share(self.weights[1], power[1], rows, self.bias[1][cls], share[1][cls], at_slot)
            out[at : at + NEAR] = got
        return out


def class_order(profile: np.ndarray) -> np.ndarray:
    """Words in an order whose runs of SLOTS are classes: halved again and again at the median along the
    direction in which their profiles differ most."""
    parts = [np.arange(len(profile))]
    while len(parts) < OWN:
        halves = []
        for part in parts:
            x = profile[part] - profile[part].mean(axis=0)
            axis = np.linalg.eigh(x.T @ x)[1][:, -1]
            by = part[np.argsort(x @ axis, kind="stable")]
            halves += [by[: len(by) // 2], by[len(by) // 2 :]]
        parts = halves
    return np.concatenate(parts)


def in_tasks(events: DataFrame) -> tuple[DataFrame, int, int]:
    """Stored rows of PACKED in no more tasks than their number is worth; tasks; events."""
    total = events.agg(F.sum("events")).first()[0] or 0
    most = max(events.sparkSession.sparkContext.defaultParallelism, total // LARGE)
    tasks = max(1, min(events.rdd.getNumPartitions(), total // TASK, most))
    return events.coalesce(tasks), tasks, total


def profiles(events: DataFrame, words: np.ndarray) -> np.ndarray:
    """For each word in a word class, how much oftener than by chance a frequent word stands one or two
    places before it (positive log ratio). The counts are at most MODELLED * 2 * CONTEXT."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((2, MODELLED, CONTEXT), dtype=np.int64)
        for row in _packed_rows(batches):
            code, target, n = unpacked(row)
            for back, word in enumerate(split_history(code)[:2]):
                own = np.flatnonzero((target < MODELLED) & (word < CONTEXT))
                np.add.at(met[back].reshape(-1), target[own] * CONTEXT + word[own], n[own])
        place = np.flatnonzero(met)
        yield pa.RecordBatch.from_pydict({"place": place.astype(np.int32), "n": met.reshape(-1)[place]})

    out = np.zeros(2 * MODELLED * CONTEXT)
    for r in in_tasks(events)[0].mapInArrow(near, "place int, n long").groupBy("place").sum("n").collect():
        out[r[0]] = r[1]
    out = out.reshape(2, MODELLED, CONTEXT)
    expected = words[:, None] * words[None, :CONTEXT] / words.sum()
    return np.concatenate(np.log(np.maximum(out / expected, 1.0)) * (out > 1), axis=1)


def word_number(crc: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Number in a history of a token outside of the word classes."""
    return MODELLED + crc % HASHES * SHAPES + target - MODELLED


class Classer:
    """Tokens of texts, each text's words and then the end, as numbers: place in the head (-1 outside),
    target, and word in a history. The first ``words`` of the head are in word classes."""

    def __init__(self, head: list[bytes], words: int):
        self.head = pa.array([t.decode() for t in head], pa.string())
        self.end = head.index(END) if END in head else -1
        shapes = [MODELLED - OWN + shape_class(t) for t in head[words:]]
        self.targets = np.array([*range(words), *shapes, 0], dtype=np.int64)
        crc = np.array([zlib.crc32(t) for t in head] + [0], dtype=np.int64)
        self.words = np.where(self.targets < MODELLED, self.targets, word_number(crc, self.targets))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Also where each text begins, the places of tokens outside of the head, and these tokens."""
        parts = split_texts(texts)
        flat, owner = parts.flatten(), pc.list_parent_indices(parts)
        some = pc.not_equal(flat, "")
        flat, owner = flat.filter(some), owner.filter(some).to_numpy()
        n = np.bincount(owner, minlength=len(texts))
        ends = np.cumsum(n) + np.arange(len(texts))
        places = np.arange(len(owner)) + owner
        found = pc.index_in(flat.cast(pa.string()), value_set=self.head).fill_null(-1).to_numpy()
        at = np.full(len(owner) + len(texts), self.end, dtype=np.int64)
        at[places] = found
        target, word = self.targets[at], self.words[at]
        rare = np.flatnonzero(at < 0)
        own = np.full(len(rare), END, dtype=object)
        outside = flat.filter(pa.array(found < 0)).cast(pa.binary())
        own[np.searchsorted(rare, places[found < 0])] = outside.to_numpy(zero_copy_only=False)
        if len(rare):
            target[rare] = MODELLED - OWN + np.fromiter(map(shape_class, own), dtype=np.int64, count=len(own))
            crc = np.fromiter(map(zlib.crc32, own), dtype=np.int64, count=len(own))
            word[rare] = word_number(crc, target[rare])
        return at, target, word, ends - n, rare, own


#: Odd, and its inverse modulo 2 ** 64: histories are dealt by their product with it.
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)
#: Events of a range of histories, in order; see ``packed``.
PACKED = "part long, events long, least long, key binary, target binary, n binary"


def hashed_history(code: np.ndarray) -> np.ndarray:
    """One to one; all bits of the code sway the high ones."""
    x = code.view(np.uint64)
    return (x ^ x >> np.uint64(32)) * np.uint64(ODD)


def history_of(key: np.ndarray) -> np.ndarray:
    x = key * np.uint64(INVERSE)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def counted(key: np.ndarray, target: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, target) in order and the sums of their counts."""
    by = np.lexsort((target, key))
    key, target = key[by], target[by]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (target[1:] != target[:-1])))
    return key[new], target[new], np.add.reduceat(n[by], new)


def packed(part: int, key: np.ndarray, target: np.ndarray, n: np.ndarray) -> tuple:
    """Events in order as a row: gaps between keys, targets and counts, each as all lowest bytes, then all
    second ones, up to the last that are not all zero."""
    columns = []
    for x in (np.diff(key, prepend=key[:1]), target.astype(np.uint64), n.astype(np.uint64)):
        wide = (int(x.max()).bit_length() + 7) // 8
        columns.append(x.view(np.uint8).reshape(len(x), 8).T[:wide].tobytes())
    return part, len(key), int(key[:1].view(np.int64)[0]), *columns


def unpacked_keys(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, target, n) of a row that ``packed`` made."""
    found = []
    for x in (row.key, row.target, row.n):
        wide = np.zeros((row.events, 8), dtype=np.uint8)
        wide[:, : len(x) // row.events] = np.frombuffer(x, dtype=np.uint8).reshape(-1, row.events).T
        found.append(wide.view(np.uint64).ravel())
    key, target, n = found
    key[0] = np.array(row.least).astype(np.int64).view(np.uint64)
    return np.cumsum(key, dtype=np.uint64), target.astype(np.uint16), n.view(np.int64)


def unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, target, n) of a row that ``packed`` made."""
    key, target, n = unpacked_keys(row)
    return history_of(key), target.astype(np.int64), n


Packed = namedtuple("Packed", "part events least key target n")


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Packed]:
    """A batch may hold all rows of a task; only one at a time is copied."""
    for batch in batches:
        for k in range(len(batch)):
            yield Packed(*(c[k].as_py() for c in batch.columns))


def packed_events(docs: DataFrame, head: list[bytes], words: int, parts: int) -> DataFrame:
    """How often a target follows a history, over rows with a text ``low``: a row of PACKED for each
    of ``parts`` ranges of hashed histories. A task adds up what it meets before events are dealt, so a
    history that is met often weighs no more than the tasks are many."""

    def rows_of(keys: list, targets: list) -> pa.RecordBatch:
        key, target = np.concatenate(keys), np.concatenate(targets)
        key, target, n = counted(key, target, np.ones(len(key), dtype=np.int64))
        part = (key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        made = [packed(int(part[a]), key[a:b], target[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]
        return pa.RecordBatch.from_pandas(pd.DataFrame(made, columns=["part", "events", "least", "key", "target", "n"]))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classer = Classer(head, words)
        keys, targets = [], []
        for part in _slices(batches, "low", CODED):
            _, target, word, firsts, *_ = classer(part.column("low"))
            keys.append(hashed_history(histories(word, firsts)))
            targets.append(target.astype(np.uint16))
            if sum(map(len, keys)) >= SORTED:
                yield rows_of(keys, targets)
                keys, targets = [], []
        if keys:
            yield rows_of(keys, targets)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        key, target, n = zip(*map(unpacked_keys, pdf.itertuples(index=False)))
        found = counted(np.concatenate(key), np.concatenate(target), np.concatenate(n))
        return pd.DataFrame([packed(pdf["part"].iloc[0], *found)], columns=pdf.columns)

    return docs.select("low").mapInArrow(pieces, PACKED).groupBy("part").applyInPandas(count, PACKED)


def event_counts(docs: DataFrame, head: list[bytes], words: int, parts: int = 1) -> DataFrame:
    """(code, target, n): the same events, each in a row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                yield pd.DataFrame(dict(zip(("code", "target", "n"), unpacked(row))))

    return packed_events(docs, head, words, parts).mapInPandas(rows, "code long, target int, n long")


def summed_rows(rows: np.ndarray, g: np.ndarray, room: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sum of their gradients; ``rows`` holds len(g) rows for each kind of feature.
    Rows met up to FEW times are added place by place, the oftenest first. ``room``: two arrays to use."""
    by = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[by]
    by %= len(g)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    size = np.diff(np.append(first, len(rows)))
    order = np.argsort(FEW + 1 - np.minimum(size, FEW + 1).astype(np.uint8), kind="stable")
    at = first[order]
    long, *ends = np.bincount(np.minimum(size, FEW + 1), minlength=FEW + 2)[::-1].cumsum().tolist()
    out, more = (x[: len(at)] for x in room or [np.empty((len(at), g.shape[1]), dtype=g.dtype) for _ in range(2)])
    np.take(g, by[at], axis=0, out=more, mode="clip")
    for k, end in zip(range(FEW - 1, 0, -1), ends):
        if end > long:
            more[long:end] += np.take(g, by[at[long:end] + k], axis=0, out=out[: end - long], mode="clip")
    if long:
        many = size[order[:long]]
        begin = np.cumsum(many) - many
        entries = np.arange(begin[-1] + many[-1]) + np.repeat(at[:long] - begin, many)
        np.add.reduceat(g[by[entries]], begin, axis=0, out=more[:long])
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return ordered[first], np.take(more, place, axis=0, out=out, mode="clip")


class Steps:
    """Weights of a factor in one task, which AdaGrad moves by steps of ``size`` events with ``kinds`` of
    features each; every kind gets the same gradient."""

    def __init__(self, weights: np.ndarray, kinds: int, size: int):
        self.weights = weights.copy()
        self.seen = np.full(ROWS, START, dtype=np.float32)
        self.room = [np.empty((kinds * size, weights.shape[1]), dtype=np.float32) for _ in range(2)]

    def __call__(self, rows: list[np.ndarray], bias: np.ndarray, at: np.ndarray, mass: np.ndarray) -> None:
        """The step of one batch: targets ``at``, weighing ``mass``."""
        g = softmax(summed(self.weights, rows, bias))
        g[np.arange(len(at)), at] -= 1
        g *= mass[:, None]
        own, step = summed_rows(np.concatenate(rows), g, self.room)
        self.seen[own] += np.einsum("ij,ij->i", step, step) / g.shape[1]
        step *= (RATE / np.sqrt(self.seen[own]))[:, None]
        new = np.take(self.weights, own, axis=0, out=self.room[1][: len(own)], mode="clip")
        new -= step
        self.weights[own] = new


def _local_steps(parts: Iterator[tuple], model: Model, size: int) -> list[np.ndarray]:
    """Weights after one task's events, ``size`` of them a step, each weighing by its count."""
    of_class, of_slot = (Steps(w, kinds, size) for w, kinds in zip(model.weights, (5, 3)))
    for code, target, n in parts:
        for at in range(0, len(code), size):
            past, t = split_history(code[at : at + size]), target[at : at + size]
            mass = n[at : at + size].astype(np.float32)
            cls, before = model.classes[t], model.before(past)
            of_class(class_rows(past, before), model.bias[0], cls, mass)
            own = np.nonzero(t < MODELLED)[0]
            if len(own):
                cls = cls[own]
                rows = slot_rows([h[own] for h in past], before[:, own], cls)
                of_slot(rows, model.bias[1][cls], model.slots[t[own]], mass[own])
    return [of_class.weights, of_slot.weights]


#: Slices of the weights that are merged apart from each other.
BLOCKS = 16
MOVED = "block int, task int, mass binary, moved binary"


def _merged(moved: DataFrame, tasks: int) -> list[np.ndarray]:
    """Mean movement of every row over the tasks that moved it, by a tree of at most FAN at a time."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        mass = sum(np.frombuffer(m, dtype=np.float32) for m in pdf["mass"])
        total = sum(np.frombuffer(x, dtype=np.float16).astype(np.float32).reshape(len(mass), -1)
                    * np.frombuffer(m, dtype=np.float32)[:, None] for m, x in zip(pdf["mass"], pdf["moved"]))
        mean = (total / np.maximum(mass, 1e-9)[:, None]).astype(np.float16)
        return pd.DataFrame({"block": pdf["block"][:1], "task": pdf["task"][:1] // FAN,
                             "mass": [mass.tobytes()], "moved": [mean.tobytes()]})

    while tasks > 1:
        moved = moved.groupBy("block", F.expr(f"task div {FAN}")).applyInPandas(merge, MOVED)
        tasks = -(-tasks // FAN)
    got = {r["block"]: r["moved"] for r in moved.select("block", "moved").collect()}
    out = []
    for k, width in enumerate((CLASSES, SLOTS)):
        parts = [got.get(k * BLOCKS + b, bytes(2 * ROWS // BLOCKS * width)) for b in range(BLOCKS)]
        out.append(np.frombuffer(b"".join(parts), dtype=np.float16).reshape(ROWS, width).astype(np.float32))
    return out


def train(events: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """Move the model's weights by stored rows of PACKED, each event of which takes part in one round."""
    events, tasks, total = in_tasks(events)
    wire = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("mass", pa.binary()), ("moved", pa.binary())])
    size = max(16, min(EVENTS, total // (tasks * rounds * STEPS)))
    for turn in range(rounds):
        shared = events.sparkSession.sparkContext.broadcast(model)

        def dealt(batches: Iterator[pa.RecordBatch], turn=turn) -> Iterator[tuple]:
            for row in _packed_rows(batches):
                own = np.random.default_rng(row.part).permutation(row.events)[turn::rounds]
                yield tuple(x[own] for x in unpacked(row))

        def steps(batches: Iterator[pa.RecordBatch], shared=shared, dealt=dealt) -> Iterator[pa.RecordBatch]:
            model = shared.value
            task = TaskContext.get().partitionId()
            for k, (new, old) in enumerate(zip(_local_steps(dealt(batches), model, size), model.weights)):
                new -= old
                mass = new.any(axis=1).astype(np.float32)
                for b, (m, x) in enumerate(zip(np.split(mass, BLOCKS), np.split(new.astype(np.float16), BLOCKS))):
                    if m.any():
                        row = {"block": [k * BLOCKS + b], "task": [task], "mass": [m.tobytes()], "moved": [x.tobytes()]}
                        yield pa.RecordBatch.from_pydict(row, schema=wire)

        for w, step in zip(model.weights, _merged(events.mapInArrow(steps, MOVED), tasks)):
            w += step
        shared.destroy()
    return model


def document_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held-out documents (crc32 of the identifier mod 7 is 2) are not learned from. A null or empty text
    is the end token alone. Repeated rows give repeated results. Where nothing can be learned the base
    score is 0 and all classes are alike. Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    learn = own.where(~held_out(F.col("doc_id"), 7, 2))
    counts = stored(token_counts(learn), "token-counts")
    cut = head_cut(counts)
    # Bounded by HEAD.
    head = sorted((-r["c"], r["token"]) for r in counts.where(F.col("c") >= cut).collect())
    coded = [t.encode() for _, t in head]
    c = np.array([-x for x, _ in head], dtype=np.float64)
    facts = counts.groupBy(class_column(F.col("token"), []).alias("k")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v"),
        F.sum((F.col("c") == 1).cast("int")).alias("n1"), F.sum((F.col("c") == 2).cast("int")).alias("n2"),
    ).collect()
    total, distinct = sum(r["n"] for r in facts), sum(r["v"] for r in facts)

    # Mass and kinds of the shape classes, without the tokens in word classes.
    mass, types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in facts:
        mass[r["k"] - OWN], types[r["k"] - OWN] = r["n"], r["v"]
    words = int((c[:MODELLED] > 1).sum())
    inner = c[:words]
    for n, t in zip(inner, coded):
        mass[shape_class(t) - OWN] -= n
        types[shape_class(t) - OWN] -= 1
    n1, n2 = (sum(r[f"n{i}"] for r in facts) - int((inner == i).sum()) for i in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    measure = np.append(inner, np.zeros(MODELLED - words)) + 0.01
    unknown = np.log10(np.where(mass > 0, np.maximum(discount * types, 1e-9) / np.maximum(mass, 1), 1.0))
    low = whole_text(F.col("text"))
    events = stored(packed_events(learn.select(low.alias("low")), coded, words, max(1, total // RANGE)), "events")
    model = train(events, Model(class_order(profiles(events, measure)), measure, mass + 0.5))

    base_of = np.append(np.log10(c + 1), 0.0) - math.log10(total + distinct + 1)
    own_share = np.zeros(len(c) + 1)
    k = Classer(coded, words).targets[words:-1] - MODELLED
    own_share[words:-1] = np.log10(np.maximum(c[words:] - discount, 1e-9) / np.maximum(mass[k], 1))

    shared = docs.sparkSession.sparkContext.broadcast(model)
    longs = [(k, pa.list_(pa.int64())) for k in ("hashed", "crc", "tf")]
    wire = pa.schema([("doc_id", pa.string()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()),
                      ("inner", pa.float64()), *longs])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classer, model = Classer(coded, words), shared.value
        for part in _slices(batches, "low", CODED):
            at, target, word, firsts, rare, tokens = classer(part.column("low"))
            logs = model(histories(word, firsts), target) / math.log(10)
            known = at >= 0
            logs += own_share[at]
            logs[rare] += unknown[target[rare] - MODELLED]
            ends = np.append(firsts[1:], len(at))
            # Rare tokens of each row, once with their number.
            owner = np.searchsorted(firsts, rare, side="right") - 1
            hashed = np.array([xxhash.xxh64_intdigest(t, 42) for t in tokens], dtype=np.uint64).view(np.int64)
            crc = np.array([zlib.crc32(t) for t in tokens], dtype=np.int64)
            by = np.lexsort((crc, hashed, owner))
            owner, hashed, crc = owner[by], hashed[by], crc[by]
            new = np.ones(len(rare), dtype=bool)
            new[1:] = (np.diff(owner) != 0) | (np.diff(hashed) != 0) | (np.diff(crc) != 0)
            first = np.nonzero(new)[0]
            tf = np.diff(np.append(first, len(rare)))
            cuts = np.searchsorted(owner[first], np.arange(len(part) + 1))
            hashed, crc = hashed[first], crc[first]
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                "doc_id": part.column("doc_id").to_pandas(),
                "n_tokens": ends - firsts,
                "n_head": np.add.reduceat(known.astype(np.int64), firsts),
                "base": np.add.reduceat(base_of[at], firsts),
                "inner": np.add.reduceat(logs, firsts),
                "hashed": [hashed[a:b] for a, b in zip(cuts, cuts[1:])],
                "crc": [crc[a:b] for a, b in zip(cuts, cuts[1:])],
                "tf": [tf[a:b] for a, b in zip(cuts, cuts[1:])],
            }), schema=wire)

    kind = docs.schema[id_col].dataType
    schema = (
        "doc_id string, n_tokens long, n_head long, base double, inner double,"
        " hashed array<long>, crc array<long>, tf array<long>"
    )
    part = stored(
        own.select(F.col("doc_id").cast("string").alias("doc_id"), low.alias("low"))
        .mapInArrow(score, schema)
        .withColumn("row", F.monotonically_increasing_id()),
        "head-scores",
    )
    shared.destroy()

    def by_class(values: np.ndarray) -> Column:
        return F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("k") - OWN)

    rare = counts.where(F.col("c") < cut).withColumn("k", class_column(F.col("token"), [])).select(
        F.xxhash64("token").alias("hashed"), F.crc32(F.col("token").cast("binary")).alias("crc"),
        F.log10(F.col("c") + 1).alias("more_base"),
        (F.log10((F.col("c") - discount) / by_class(np.maximum(mass, 1))) - by_class(unknown)).alias("more_inner"),
    )
    rest = (
        part.select("row", F.explode(F.arrays_zip("hashed", "crc", "tf")).alias("x"))
        .select("row", "x.hashed", "x.crc", "x.tf")
        .join(rare.hint("shuffle_hash"), ["hashed", "crc"])
        .groupBy("row")
        .agg(
            F.sum("tf").alias("rest_known"),
            F.sum(F.col("tf") * F.col("more_base")).alias("rest_base"),
            F.sum(F.col("tf") * F.col("more_inner")).alias("rest_inner"),
        )
    )
    zero = F.lit(0)
    return part.drop("hashed", "crc", "tf").join(rest, "row", "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"),
        held_out(F.col("doc_id").cast(kind), 7, 2).alias("held_out"),
        "n_tokens",
        (F.col("n_head") + F.coalesce("rest_known", zero)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", zero)).alias("base_score"),
        (F.col("inner") + F.coalesce("rest_inner", zero)).alias("score"),
    )


@query("op3_language_model")
def op3_language_model(spark, sf_dir):
    return document_scores(table(spark, sf_dir, "documents"))
