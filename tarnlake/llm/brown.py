"""Language-model scores by Brown classes: exchange clustering, class transitions and word emissions."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import crc32_of, cut, small

#: Least number of most frequent words that every task holds; it grows with the square root of the tokens.
COMMON = 65_536
#: Least number of words that are exchanged with each other first, and of classes; these grow with a low power of the tokens.
CORE, CLASSES = 1000, 48
#: Rarer and unseen words are placed by their endings, in so many groups.
ENDINGS = 4096
SMOOTHING = 0.1
#: Parts of the vocabulary that tasks place separately.
BLOCKS = 256
#: Numbers of counts that a task holds before it hands them on.
HELD = 2_000_000
#: Gains that a task works out at a time.
PLACED = 1_500_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def ending(word: bytes) -> int:
    """The ending group of a word: its last three bytes and its length, hashed."""
    return zlib.crc32(word[-3:] + str(min(len(word), 12)).encode()) % ENDINGS


def ending_of(word: Column) -> Column:
    """ending() of a column of words."""
    raw = F.encode(word, "utf-8")
    tail = F.substring(raw, -3, 3)
    short = F.least(F.octet_length(raw), F.lit(12)).cast("string")
    return F.crc32(F.concat(F.when(F.octet_length(raw) < 3, raw).otherwise(tail), F.encode(short, "utf-8"))) % ENDINGS


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """(word, n) over all texts of `docs`; tasks add up their own words first, and hold at most about `flush` of them."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], schema=schema)

    def run(batches):
        seen: Counter = Counter()
        for batch in (part for whole in batches for part in small(whole)):
            for text in batch.column("text").to_pylist():
                seen.update(words_of(text))
                if len(seen) > flush:
                    yield out(seen)
                    seen = Counter()
        if seen:
            yield out(seen)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _f(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1))


def exchange(bigrams: np.ndarray, movable: int, classes: int, sweeps: int = 8) -> np.ndarray:
    """Classes of words by exchange clustering on their bigram counts (previous, next).

    The first `movable` words are put round-robin into `classes` classes and moved one at a time to the class that most
    raises the likelihood of the class bigrams, until a sweep moves none; the others keep a class of their own each.
    """
    size = len(bigrams)
    total = classes + size - movable
    where = np.concatenate([np.arange(movable) % classes, np.arange(classes, total)])
    table = np.zeros((total, total))
    np.add.at(table, (where[:, None], where[None, :]), bigrams)
    before, after = table.sum(axis=1), table.sum(axis=0)
    self_pairs = bigrams.diagonal()
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            a, s = where[w], self_pairs[w]
            right = np.bincount(where, weights=bigrams[w], minlength=total)
            left = np.bincount(where, weights=bigrams[:, w], minlength=total)
            right[a] -= s
            left[a] -= s
            if not right.any() and not left.any() and not s:
                continue
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= s
            n_right, n_left = right.sum() + s, left.sum() + s
            before[a] -= n_right
            after[a] -= n_left
            rows, cols = table[:classes], table[:, :classes].T
            gain = (_f(rows + right) - _f(rows)).sum(axis=1) + (_f(cols + left) - _f(cols)).sum(axis=1)
            own = np.arange(classes)
            d = table[own, own]
            gain += _f(d + right[own] + left[own] + s) - _f(d + right[own]) - _f(d + left[own]) + _f(d)
            gain -= _f(before[:classes] + n_right) - _f(before[:classes]) + _f(after[:classes] + n_left) - _f(after[:classes])
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = a
            table[best] += right
            table[:, best] += left
            table[best, best] += s
            before[best] += n_right
            after[best] += n_left
            moved += best != a
            where[w] = best
        if not moved:
            break
    return where


def place(units: np.ndarray, side: np.ndarray, neighbour: np.ndarray, n: np.ndarray, table: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit, class): for each unit the class whose likelihood its bigrams raise most, as in exchange().

    Entries are sorted by unit: `n` bigrams with a word of class `neighbour` after the unit (side 0) or before it (side 1).
    """
    own = np.arange(classes)
    rows, cols = table[:classes], table[:, :classes]
    first = np.concatenate([[0], np.flatnonzero(units[1:] != units[:-1]) + 1])
    total = [np.add.reduceat(np.where(side == s, n, 0), first) for s in (0, 1)]
    gain = np.empty((len(first), classes))
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + PLACED // classes)))
        lo, hi = first[a], first[b] if b < len(first) else len(units)
        near = np.where(side[lo:hi, None] == 0, rows[own[None, :], neighbour[lo:hi, None]], cols[neighbour[lo:hi, None], own[None, :]])
        gain[a:b] = np.add.reduceat(_f(near + n[lo:hi, None]) - _f(near), first[a:b] - lo, axis=0)
        both = np.zeros((2, b - a, classes))  # bigrams with the class itself on both sides fall on one cell
        inner = lo + np.flatnonzero(neighbour[lo:hi] < classes)
        both[side[inner], np.searchsorted(first, inner, side="right") - 1 - a, neighbour[inner]] = n[inner]
        d = rows[own, own][None, :]
        gain[a:b] += _f(d + both[0] + both[1]) - _f(d + both[0]) - _f(d + both[1]) + _f(d)
        a = b
    for size, mass in zip(total, (table.sum(axis=1)[:classes], table.sum(axis=0)[:classes]), strict=True):
        gain -= _f(mass[None, :] + size[:, None]) - _f(mass)[None, :]
    return units[first], gain.argmax(axis=1)


class _Units(dict):
    """Numbers of the common words, and of the ending groups of others as they are met."""

    def __init__(self, number: dict[bytes, int], limit: int = 300_000):
        super().__init__(number)
        self.number, self.limit = number, limit

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.number) + ending(word)
        return i

    def trim(self) -> None:
        if len(self) > self.limit + len(self.number):
            self.clear()
            self.update(self.number)


def numbered(docs: DataFrame, words: list[bytes], train: Column) -> DataFrame:
    """`docs` by row: row, doc_id, train, units (of each word in order, little-endian 32-bit), rare words and how often each stands there.

    A common word's unit is its place in `words`; that of any other word is its ending group, counted on from there.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("units", pa.binary()), ("rare", pa.list_(pa.string())), ("times", pa.list_(pa.int32()))])

    def run(batches):
        unit = _Units({w: i for i, w in enumerate(shared.value)})
        common = len(unit)
        for batch in (part for whole in batches for part in small(whole)):
            made, rare, times = [], [], []
            for text in batch.column("text").to_pylist():
                ws = words_of(text)
                x = np.fromiter(map(unit.__getitem__, ws), np.int32, len(ws))
                seen = Counter([ws[i] for i in np.flatnonzero(x >= common).tolist()])
                made.append(x.tobytes())
                rare.append([w.decode() for w in seen])
                times.append(list(seen.values()))
                unit.trim()
            columns = [*(batch.column(c) for c in ("row", "doc_id", "train")), made, rare, times]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), train.alias("train"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, train boolean, units binary, rare array<string>, times array<int>")


def _stream(batch: pa.RecordBatch, end: int) -> np.ndarray:
    """The units of a batch in a row, with `end` before, between and after the texts."""
    texts = [np.frombuffer(x, np.int32) for x in batch.column("units").to_pylist()]
    n = np.array(list(map(len, texts)), np.int64)
    out = np.full(int(n.sum()) + len(n) + 1, end, np.int64)
    at = np.ones(len(out), bool)
    at[0] = False
    at[np.cumsum(n + 1)] = False
    if texts:
        out[at] = np.concatenate(texts)
    return out


def _streams(batches, end: int) -> Iterator[np.ndarray]:
    return (_stream(part, end) for whole in batches for part in small(whole))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their numbers added up."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def class_pairs(units: DataFrame, kind: np.ndarray, size: int) -> np.ndarray:
    """Bigram counts of the classes of `units`: `kind` has the class of each unit, and of the end of a text at last."""
    shared = units.sparkSession.sparkContext.broadcast(kind)

    def run(batches):
        kinds = shared.value
        seen = np.zeros(size * size, np.int64)
        for x in _streams(batches, len(kinds) - 1):
            k = kinds[x]
            seen += np.bincount(k[:-1] * size + k[1:], minlength=size * size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["pair", "n"])

    found = units.select("units").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(size * size)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(size, size)


def placed(units: DataFrame, kind: np.ndarray, table: np.ndarray, classes: int) -> DataFrame:
    """(unit, class) of the units that are not in the core, by place() on their bigrams with core words and text ends over all of `units`.

    Tasks add up (unit, side, neighbour's class) as sorted numbers, which are dealt by unit; each unit is placed whole in one task.
    """
    size, free = len(table), kind == classes
    shared = units.sparkSession.sparkContext.broadcast((kind, free, table))
    schema = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def count(batches):
        kinds, loose, _ = shared.value

        def out(parts) -> pa.RecordBatch:
            key, n = _summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            block = key // (2 * size) % BLOCKS
            order = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[order], np.arange(BLOCKS + 1))
            some = [b for b in range(BLOCKS) if ends[b + 1] > ends[b]]
            cuts = [order[ends[b] : ends[b + 1]] for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([key[c].tobytes() for c in cuts], pa.binary()), pa.array([n[c].tobytes() for c in cuts], pa.binary())], schema=schema)

        parts, held = [], 0
        for x in _streams(batches, len(kinds) - 1):
            k, mine = kinds[x], loose[x]
            a, b = np.flatnonzero(mine[:-1]), np.flatnonzero(mine[1:]) + 1
            key = np.concatenate([x[a] * (2 * size) + k[a + 1], x[b] * (2 * size) + size + k[b - 1]])
            key, n = np.unique(key, return_counts=True)
            parts.append((key, n.astype(np.int64)))
            held += len(key)
            if held > HELD:
                yield out(parts)
                parts, held = [], 0
        if parts:
            yield out(parts)

    def choose(batches):
        met: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        joined = lambda parts: _summed(*(np.concatenate(p) for p in zip(*parts, strict=True)))
        for batch in batches:
            for block, key, n in zip(*(batch.column(c).to_pylist() for c in ("block", "keys", "n")), strict=True):
                parts = met.setdefault(block, [])
                parts.append((np.frombuffer(key, np.int64), np.frombuffer(n, np.int64)))
                if sum(len(k) for k, _ in parts[1:]) > max(HELD // 4, len(parts[0][0])):
                    met[block] = [joined(parts)]
        t = shared.value[2]
        for key, n in map(joined, met.values()):
            unit, which = place(key // (2 * size), key // size % 2, key % size, n, t, classes)
            yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(which)], names=["unit", "class"])

    counted = units.select("units").mapInArrow(count, "block int, keys binary, n binary")
    return counted.repartition("block").mapInArrow(choose, "unit long, class long")


@dataclass(frozen=True)
class Model:
    """What every task needs to score: by unit its class and the log10 of its count, log10 transitions and class sizes."""

    words: list[bytes]
    kind: np.ndarray
    log_count: np.ndarray
    transition: np.ndarray
    class_total: np.ndarray
    tokens: int
    types: int
    texts: int


def vocabulary(docs: DataFrame, counts: DataFrame) -> tuple[list[bytes], np.ndarray, int, int, int]:
    """Common words with their counts, and the tokens (text ends included), types and texts of `docs`.

    The driver gets COMMON words, or 4 times the square root of the tokens where that is more.
    """
    texts = docs.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("types")).first()
    tokens, types = int(sums["n"] or 0) + texts, int(sums["types"]) + (texts > 0)
    wanted = max(COMMON, 4 * math.isqrt(tokens))
    size = F.floor(F.log2("n") * 8).cast("int")  # words of a size or more are enough: the others are set aside before the sort
    sizes = sorted(((r["size"], r["words"]) for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, met = 0, 0
    for s, many in sizes:
        least, met = s, met + many
        if met >= wanted:
            break
    common = counts.where(size >= least).orderBy(F.desc("n"), "word").limit(wanted).toPandas()
    return [w.encode() for w in common["word"]], common["n"].to_numpy(np.int64), tokens, types, texts


def fit(units: DataFrame, counts: DataFrame, words: list[bytes], n: np.ndarray, tokens: int, types: int, texts: int) -> Model:
    """Fit on all training texts, whose units are `units` and word_counts() `counts`.

    The most frequent words, the core, are exchanged with each other. Every other unit, that is each common word and each
    ending group of rarer words, then joins the class that its own bigrams gain most by. Counts, transitions and class sizes
    cover all training texts. The driver gets bigrams of the core, one class for each unit, and one row for each ending group.
    """
    classes = min(max(CLASSES, round(tokens**0.22)), max(1, len(words)))
    core = min(len(words), max(CORE, 4 * classes))
    size = len(words) + ENDINGS + 1
    kind = np.full(size, core, np.int64)
    kind[:core], kind[-1] = np.arange(core), core + 1
    where = exchange(class_pairs(units, kind, core + 2), core, classes)
    coarse = np.full(size, classes, np.int64)
    coarse[:core], coarse[-1] = where[:core], classes + 1
    if size > core + 1:
        chosen = placed(units, coarse, class_pairs(units, coarse, classes + 2), classes).toPandas()
        kind = np.where(coarse == classes, classes - 1, coarse)  # endings that no training text has
        kind[chosen["unit"].to_numpy(np.int64)] = chosen["class"].to_numpy(np.int64)
    kind[-1] = classes
    total = classes + 1
    table = class_pairs(units, kind, total)
    transition = np.log10((table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * total))
    members = np.bincount(kind[: len(words)], minlength=total).astype(float)
    members[-1] = 1
    rare = counts if len(words) < types - 1 else counts.limit(0)
    by_ending = rare.groupBy(ending_of(F.col("word")).alias("ending")).agg(F.count("*").alias("types")).toPandas()
    every = np.zeros(ENDINGS)
    every[by_ending["ending"].to_numpy(np.int64)] = by_ending["types"].to_numpy()
    if len(by_ending):
        every -= np.bincount([ending(w) for w in words], minlength=ENDINGS)
    np.add.at(members, kind[len(words) : -1], every)
    log_count = np.zeros(size)
    log_count[: len(words)], log_count[-1] = np.log10(n + 1), math.log10(texts + 1)
    return Model(words, kind, log_count, transition, table.sum(axis=0) + members + 1, tokens, types, texts)


def score(units: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score and score of the rows of `units`, from the model and the full word counts.

    What a row lacks after a pass over its units are the counts of its rarer words, which are dealt out by word, joined with
    the counts and added up by row: the same sum is lacking in both scores.
    """
    shared = units.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("own", pa.float64())])

    def run(batches):
        m = shared.value
        norm, emission = math.log10(m.tokens + m.types + 1), np.log10(m.class_total)
        common, end = len(m.words), len(m.kind) - 1
        for batch in (part for whole in batches for part in small(whole)):
            if not batch.num_rows:
                continue
            n = np.array([len(x) // 4 for x in batch.column("units").to_pylist()])
            x = _stream(batch, end)
            kind, last = m.kind[x], np.cumsum(n + 1)
            first = last - n
            count = m.log_count[x]
            path = m.transition[kind[:-1], kind[1:]] - emission[kind[1:]] + count[1:]
            known = ((x < common) | ((x == end) & (m.texts > 0))).astype(np.int64)
            by_row = lambda v: np.add.reduceat(v, first)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "train")), pa.array(n + 1), pa.array(by_row(known)), pa.array(by_row(count) - norm * (n + 1)), pa.array(np.add.reduceat(path, first - 1))], schema=schema)

    head = units.select("row", "doc_id", "train", "units").mapInArrow(run, "row long, doc_id long, train boolean, n_tokens long, n_known long, base double, own double")
    pairs = units.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    added = pairs.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return head.join(added, "row", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"),
        (F.col("base") + zero("more")).alias("base_score"), (F.col("own") + zero("more")).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of all rows of `docs` by a model of those whose crc32(doc_id) mod `folds` is not `held`.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Texts are read twice: for the counts of words, and
    to number the words; the rest works on the numbers. Null and empty texts have one token, the end; null ids count as empty
    text for the fold; repeated rows are scored and learnt as often as they stand there; other columns are not read. Without
    training texts all probabilities are those of smoothing alone.
    """
    learn = crc32_of("doc_id") % folds != held
    train = docs.where(learn).select("text")
    counts = cut(word_counts(train))
    words, n, tokens, types, texts = vocabulary(train, counts)
    units = cut(numbered(docs, words, learn))
    model = fit(units.where("train"), counts, words, n, tokens, types, texts)
    scored = score(units, model, counts)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
