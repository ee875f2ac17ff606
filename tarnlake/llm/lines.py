"""Fuzzy deduplication of lines across documents, and of documents by their runs of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from ._shared import connected_components, cut, find, forget, free, map_batches, small, sorted_runs

#: Lines of fewer words are never called duplicates.
LEAST_WORDS = 5
SIMILARITY = 0.8
#: Most frequent words whose frequencies order the words of a line; the order bears on speed alone.
ORDERED = 65_536
#: One row in so many is looked at for frequencies and for hot words.
SAMPLED = 16
#: Words of lines up to which sketches of 64, 128, 256 and 512 bits serve; longer lines have 1024.
WIDTHS = (56, 125, 250, 500)
#: The same for the runs of a document, whose sketches travel once for a group of candidates and not for each word: 64 to 32,768 bits.
SET_WIDTHS = (*WIDTHS, 1000, 2000, 4000, 8000, 16000)
#: The same where lines are verified, for sketches of eight bits a word or more, 64 to 8192 of them: what these let through is similar but for the order.
FINE_WIDTHS = (8, 16, 32, 64, 128, 256, 512)
#: Numbers of words are kept up to here in postings; longer lines are compared without sketches.
MOST_WORDS = 65_535
#: Lines, and words, of one group that a task compares with as many others.
CHUNK_LINES, CHUNK_WORDS = 512, 300_000
#: Hottest words that are dealt out in chunks; others are met whole.
HOTTEST = 200_000
#: Postings in a block, and postings that a task holds before it hands them on.
BLOCK_ROWS, HELD = 100_000, 150_000
#: Blocks that a task takes one after the other: each task writes a file, and small files cost more to read than their rows.
TASK_BLOCKS = 8
#: Rows whose sketches a task unfolds at a time, if no group has more.
SKETCHED_ROWS = 1000
#: Bytes of texts that a task splits into words at a time.
SLICE_BYTES = 1_000_000
#: Pairs that a task holds before it keeps only what connects them.
MOST_PAIRS = 500_000

_G, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Distinct word hashes of a batch, the place there of each word of its items in a row, words of each item, ids.
Bags = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Rows of a side of a join, of at most a hundred bytes or so, up to which it is broadcast.
BROADCAST_ROWS = 1_000_000


def normalised(line: str) -> bytes:
    """A line as it is compared: lower-cased, white space collapsed."""
    return b" ".join(line.lower().encode().split())


def edit_distance(a: list, b: list, most: int | None = None) -> int:
    """Levenshtein distance of two sequences of words, bit-parallel over the shorter one; equal ends are set aside first.

    With `most`, some number above it where the distance is.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | (1 << i)
    mask, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = mask, 0
    for left, w in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = where.get(w, 0)
        x = same | down
        y = (((same & up) + up) ^ up) | same
        plus, minus = down | (~(y | up) & mask), up & y
        score += bool(plus & last) - bool(minus & last)
        if most is not None and score - left > most:
            return score - left
        plus = (plus << 1) | 1
        up = ((minus << 1) | ~(x | plus)) & mask
        down = plus & x & mask
    return score


def similar(a: list | np.ndarray, b: list | np.ndarray, least: float = SIMILARITY) -> bool:
    """1 - edit distance in words / length of the longer line reaches `least`.

    Most similar pairs show it without the distance: their lines agree from the left up to some word, and from the right down
    to it, but for few enough places.
    """
    if len(a) < len(b):
        a, b = b, a
    most, more, n = int((1 - least) * len(a) + 1e-9), len(a) - len(b), len(b)
    if more > most:
        return False
    x, y = np.asarray(a), np.asarray(b)
    left, right = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.cumsum(x[:n] != y, out=left[1:])
    np.cumsum(x[more:] != y, out=right[1:])
    if int((left - right).min()) + int(right[-1]) + more <= most:
        return True
    x, y = np.sort(x), np.sort(y)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    if len(x) - int((x[at] == y).sum()) > most:  # even if repeats are all met
        return False
    return edit_distance(list(a), list(b), most) <= most if isinstance(a, list) else edit_distance(a.tolist(), b.tolist(), most) <= most


def overlapping(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """The Jaccard similarity of two arrays of distinct values reaches `least`."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C
    x = (x ^ (x >> np.uint64(27))) * _D
    return x ^ (x >> np.uint64(31))


def _string_hashes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of strings, the sum of a mixed number for each byte and place, and their lengths in bytes."""
    offset = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    n = np.diff(offset)
    if not n.any():
        return _mixed(np.zeros(len(n), np.uint64)), n
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[offset[0] : offset[-1]]
    start = offset[:-1] - offset[0]
    place = np.arange(len(raw)) - np.repeat(start, n)
    value = _mixed(raw.astype(np.uint64) + (place + 1).astype(np.uint64) * _G)
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    out[some] = np.add.reduceat(value, start[some])
    return _mixed(out + n.astype(np.uint64) * _C), n


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of words, the place there of each word of the texts in a row, and words of each text; white space is ASCII's."""
    split = pc.ascii_split_whitespace(texts)
    words = pc.list_flatten(split).dictionary_encode()
    distinct, size = _string_hashes(words.dictionary)
    code, text = words.indices.to_numpy(), pc.list_parent_indices(split).to_numpy()
    if not size.all():  # beside white space at an end, a word is empty
        kept = size[code] > 0
        code, text = code[kept], text[kept]
    return distinct, code, np.bincount(text, minlength=len(texts))


def line_words(texts: pa.Array, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """_hashed() of all lines of `least_words` words or more, and by line its text and its number there."""
    lines = pc.split_pattern(pc.utf8_lower(texts), "\n")
    row = pc.list_parent_indices(lines).to_numpy().astype(np.int64)
    number = np.arange(len(row)) - np.searchsorted(row, row)
    distinct, code, n = _hashed(pc.list_flatten(lines))
    kept = n >= max(1, least_words)
    return distinct, code[np.repeat(kept, n)], n[kept], row[kept], number[kept]


def line_ids(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit ids of lines from the hashes of their words in order; lines are told apart by them."""
    if not len(n):
        return np.zeros(0, np.int64)
    start = np.cumsum(n) - n
    place = np.arange(len(hashes)) - np.repeat(start, n)
    return _mixed(np.add.reduceat(_mixed(hashes + (place + 1).astype(np.uint64) * _G), start) + n.astype(np.uint64) * _C).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, text_hash and text of the rows: those that repeat both are one document to every step here."""
    return docs.select(_doc(), _text_hash(), "text")


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc")


def _text_hash() -> Column:
    return F.xxhash64("text").alias("text_hash")


_PLACES = np.dtype([("doc", "<i8"), ("text_hash", "<i8"), ("line", "<i4"), ("id", "<i8")])


# candidates by rare words


def _allowed(n, least: float):
    """Most edits of a similar pair whose longer line has `n` words."""
    return np.floor((1 - least) * n + 1e-9).astype(np.int64)


def _level(n: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """Which of the sketch widths lines of `n` words have."""
    return np.searchsorted(widths, n, side="right")


def _least_shared(a: np.ndarray, b: np.ndarray, least: float, distinct: bool) -> np.ndarray:
    """Words that a similar pair of `a` and `b` words shares at least; of sets, with `distinct`, compared by Jaccard similarity."""
    if distinct:
        return np.ceil(least / (1 + least) * (a + b) - 1e-6).astype(np.int64)
    longest = np.maximum(a, b)
    return longest - _allowed(longest, least)


def _sketches(hashes: np.ndarray, item: np.ndarray, n: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level, its items and their sketches: parities of the words that fall on each bit. Two lines differ in no more bits than words."""
    level, out = _level(n, widths), []
    for k in range(len(widths) + 1):
        mine = np.flatnonzero(level == k)
        bits, made = 64 << k, np.zeros((len(mine), 8 << k), np.uint8)
        place = np.full(len(n), -1)
        place[mine] = np.arange(len(mine))
        where = place[item] if len(mine) else np.zeros(0, np.int64)
        at = np.flatnonzero(where >= 0)
        where, bit = where[at], (hashes[at] & np.uint64(bits - 1)).astype(np.int64)
        step = max(1, 4_000_000 // bits)
        for a in range(0, len(mine), step):
            lo, hi = np.searchsorted(where, [a, a + step])
            rows = min(step, len(mine) - a)
            odd = np.bincount((where[lo:hi] - a) * bits + bit[lo:hi], minlength=rows * bits) & 1
            made[a : a + rows] = np.packbits(odd.astype(np.uint8).reshape(rows, bits), axis=1, bitorder="little")
        out.append((mine, made))
    return out


def _folded(sketches: list[tuple[np.ndarray, np.ndarray]], rows: int) -> list[np.ndarray]:
    """For each width the sketches of rows as longs, folded where wider and left zero where narrower."""
    made = [np.zeros((rows if any(len(at) for at, _ in sketches[k:]) else 0, 1 << k), np.uint64) for k in range(len(sketches))]
    for k, (at, wide) in enumerate(sketches):
        wide = np.ascontiguousarray(wide).view(np.uint64).reshape(len(at), 1 << k)
        for j in range(k, -1, -1):
            if len(at):
                made[j][at] = wide
            wide = wide[:, : wide.shape[1] // 2] ^ wide[:, wide.shape[1] // 2 :]
    return made


def _may_match(i: np.ndarray, j: np.ndarray, n: np.ndarray, widths: list[np.ndarray], least: float, distinct: bool = False, steps: tuple[int, ...] = SET_WIDTHS) -> np.ndarray:
    """False where sketches show that rows i and j have more differing words than a similar pair may."""
    most = n[i] + n[j] - 2 * _least_shared(n[i], n[j], least, distinct)
    level = _level(np.minimum(n[i], n[j]), steps[: len(widths) - 1])
    out = np.maximum(n[i], n[j]) >= MOST_WORDS
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        out[at] |= np.bitwise_count(widths[k][i[at]] ^ widths[k][j[at]]).sum(axis=1, dtype=np.int64) <= most[at]
    return out


def _prefixes(distinct: np.ndarray, code: np.ndarray, n: np.ndarray, usual: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(token, item) of the words in the prefix of each item.

    Words are ordered from rare to frequent, then by hash, repeats of a word in an item counting as words of their own. A
    similar pair whose longer line has m words shares m - e of them, e being the edits allowed, so the first e + 1 words of
    both, in that order, have one in common: no similar pair is missed, whatever the frequencies.
    """
    known, rank = usual
    if len(known):
        at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        seen = np.where(known[at] == distinct, rank[at], 0).astype(np.uint64)
    else:
        seen = np.zeros(len(distinct), np.uint64)
    order = np.argsort(distinct)
    place = np.empty(len(order), np.uint64)
    place[order] = np.arange(len(order), dtype=np.uint64)
    key = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(45)) | ((seen << np.uint64(28)) | place)[code]
    key.sort()
    new = np.concatenate([[True], key[1:] != key[:-1]])
    begin = np.flatnonzero(new)
    repeat = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    kept = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n) <= np.repeat(_allowed(n, least), n)
    key, repeat = key[kept], repeat[kept]
    h = distinct[order[(key & np.uint64((1 << 28) - 1)).astype(np.int64)]]
    return _mixed(h ^ (repeat.astype(np.uint64) * _G)), (key >> np.uint64(45)).astype(np.int64)


def _kind(level: int, sketched: bool = True) -> np.dtype:
    """A posting: word, number of words of the item, the word's place in the item's order, the item and its sketch."""
    return np.dtype([("token", "<u4"), ("n", "<u2"), ("at", "<u2"), ("id", "<i8"), ("sketch", "u1", ((8 << level) if sketched else 0,))])


def _usual_words(sample: DataFrame, bags: Callable[[pa.RecordBatch], Bags]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the most frequent words of a sample, sorted, and their ranks from rare (1) to frequent."""

    def fn(batch: pa.RecordBatch) -> dict:
        distinct, code = bags(batch)[:2]
        return {"word": distinct.view(np.int64), "n": np.bincount(code, minlength=len(distinct))}

    counts = map_batches(sample, fn, "word long, n long", SLICE_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.orderBy(F.desc("n"), "word").limit(ORDERED).toPandas()
    word = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], np.arange(len(word), 0, -1)[order]


def _hot_tokens(sample: DataFrame, bags: Callable[[pa.RecordBatch], Bags], usual, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix words that too many lines share for one task, sorted, the chunks in which each is dealt, and the number of postings to expect."""
    size = 2 * CHUNK_LINES

    def fn(batch: pa.RecordBatch) -> dict:
        distinct, code, n = bags(batch)[:3]
        token, many = np.unique(_prefixes(distinct, code, n, usual, least)[0] if len(n) else distinct, return_counts=True)
        return {"token": token.view(np.int64), "n": many}

    counts = cut(map_batches(sample, fn, "token long, n long", SLICE_BYTES).groupBy("token").agg((F.sum("n") * SAMPLED).alias("n")))
    found = counts.where(F.col("n") >= 2 * size).orderBy(F.desc("n"), "token").limit(HOTTEST).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], -(-found["n"].to_numpy(np.int64)[order] // size), counts.agg(F.sum("n")).first()[0] or 0


def candidates(items: DataFrame, sample: DataFrame, bags: Callable[[pa.RecordBatch], Bags], least: float = SIMILARITY, places: bool = False, distinct: bool = False) -> DataFrame:
    """Groups of items that may be similar: (component, id). Every pair of similar items is together in one group at least.

    `bags` gives the words and ids of the items of a batch of `items`; `sample` are some of its rows. Items that share a word
    of their prefixes meet; of those a pair stays whose lengths, places of the word and sketches allow the similarity. Pairs of
    one word that hang together are a group, named by its members, so that the same group found by several words is one.
    Postings travel as blocks of bytes, dealt by a hash of the word; the sample's postings make the number of blocks. A hot word
    is dealt as pairs of chunks of its items, each a word of its own. With `distinct`, items are sets with many words and long
    sketches: their postings have none, and thinned() is to follow.

    With `places`, bags() gives a fifth part, the _PLACES of the items; they are rows of the result too, without a component.
    """
    usual = _usual_words(sample, bags)
    *hot, expected = _hot_tokens(sample, bags, usual, least)
    blocks = max(1, -(-int(expected) // BLOCK_ROWS))
    shared = items.sparkSession.sparkContext.broadcast((usual, hot))
    levels = 1 if distinct else len(WIDTHS) + 1
    schema = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("rows", pa.binary())])
    out_schema = pa.schema([("component", pa.int64()), ("id", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32())])

    def post(batches):
        usual, (hot, chunks) = shared.value
        held: list[list[np.ndarray]] = [[] for _ in range(levels)]
        place: list[list[np.ndarray]] = [[] for _ in range(levels)]
        many = 0

        def out():
            for level, parts in enumerate(held):
                if parts:
                    rows, block = np.concatenate(parts), np.concatenate(place[level])
                    order = np.argsort(block, kind="stable")
                    rows, block = rows[order], block[order]
                    begin = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1])
                    bounds = zip(begin.tolist(), [*begin[1:].tolist(), len(block)], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(block[begin]), pa.array(np.full(len(begin), level, np.int32)), pa.array([rows[a:b].tobytes() for a, b in bounds], pa.binary())], schema=schema)
                parts.clear(), place[level].clear()

        for batch in (part for whole in batches for part in small(whole, SLICE_BYTES)):
            if not batch.num_rows:
                continue
            words, code, n, ids, *at_places = bags(batch)
            if not len(ids):
                continue
            if places:
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0]) % blocks]), pa.array([-1], pa.int32()), pa.array([at_places[0].tobytes()], pa.binary())], schema=schema)
            once = np.unique(ids, return_index=True)[1]
            if len(once) < len(n):
                first = np.zeros(len(n), bool)
                first[once] = True
                code, n, ids = code[np.repeat(first, n)], n[first], ids[first]
            token, item = _prefixes(words, code, n, usual, least)
            nth = np.minimum(np.arange(len(item)) - np.searchsorted(item, item), MOST_WORDS)
            token, which = _in_chunks(token, np.arange(len(item)), ids[item], hot, chunks)
            item, nth = item[which], nth[which]
            level = np.zeros(len(n), np.int64) if distinct else _level(n)
            sketches = [(np.arange(len(n)), np.zeros((len(n), 0), np.uint8))] if distinct else _sketches(words[code], np.repeat(np.arange(len(n)), n), n)
            for k, (mine, sketch) in enumerate(sketches):
                at = np.flatnonzero(level[item] == k)
                if len(at):
                    who = item[at]
                    rows = np.zeros(len(at), _kind(k, not distinct))
                    rows["token"], rows["n"], rows["at"], rows["id"] = token[at] & np.uint64(0xFFFFFFFF), np.minimum(n[who], MOST_WORDS), nth[at], ids[who]
                    rows["sketch"] = sketch[np.searchsorted(mine, who)]
                    held[k].append(rows)
                    place[k].append(((token[at] >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64))
                    many += len(at)
            if many > HELD:
                yield from out()
                many = 0
                pa.default_memory_pool().release_unused()
        yield from out()
        pa.default_memory_pool().release_unused()

    def meet(batches):
        key = lambda b: b.column("block").to_numpy()
        for block, starts in sorted_runs(batches, key):
            level, rows = block.column("level").to_pylist(), block.column("rows")
            for a, b in zip(starts, np.append(starts[1:], block.num_rows), strict=True):
                parts: list[list[np.ndarray]] = [[] for _ in range(levels)]
                for i in range(a, b):
                    if level[i] < 0:
                        x = np.frombuffer(rows[i].as_buffer(), _PLACES)
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), *(pa.array(np.ascontiguousarray(x[c])) for c in ("id", "doc", "text_hash", "line"))], schema=out_schema)
                    else:
                        parts[level[i]].append(np.frombuffer(rows[i].as_buffer(), _kind(level[i], not distinct)))
                for name, ids in _met([np.concatenate(p) if p else np.zeros(0, _kind(k, not distinct)) for k, p in enumerate(parts)], least, distinct, not distinct):
                    none = pa.nulls(len(ids), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(ids), none, none, pa.nulls(len(ids), pa.int32())], schema=out_schema)

    dealt = items.mapInArrow(post, "block long, level int, rows binary").repartition(min(-(-blocks // TASK_BLOCKS), 10_000), "block").sortWithinPartitions("block")
    return cut(dealt.mapInArrow(meet, "component long, id long, doc long, text_hash long, line int"))


def _in_chunks(token: np.ndarray, item: np.ndarray, ids: np.ndarray, hot: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings with those of hot words as one for each pair of chunks that the item's chunk is in, under a word of that pair."""
    if not len(hot):
        return token, item
    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
    is_hot = hot[at] == token
    some = np.flatnonzero(is_hot)
    if not len(some):
        return token, item
    c = chunks[at[some]]
    mine = (_mixed(ids[item[some]].view(np.uint64) + _G) % c.astype(np.uint64)).astype(np.int64)
    other = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
    mine = np.repeat(mine, c)
    pair = np.minimum(mine, other) * np.repeat(c, c) + np.maximum(mine, other)
    spread = _mixed(np.repeat(token[some], c) + (pair + 1).astype(np.uint64) * _D)
    return np.concatenate([token[~is_hot], spread]), np.concatenate([item[~is_hot], np.repeat(item[some], c)])


def _met(parts: list[np.ndarray], least: float, distinct: bool = False, sketched: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(name, id) of the groups among the postings of a block, given by level.

    The first word that a similar pair shares, in the order of words, leaves each of the two as many words as they share or
    more: elsewhere they needn't meet.
    """
    token, n, nth, ids = (np.concatenate([p[c] for p in parts]) for c in ("token", "n", "at", "id"))
    n = n.astype(np.int64)
    left = n - nth
    start = np.cumsum([0, *map(len, parts)])
    order = np.argsort((token.astype(np.uint64) << np.uint64(32)) | (n.astype(np.uint64) << np.uint64(16)) | (ids.view(np.uint64) >> np.uint64(48)))
    token, n, ids = token[order], n[order], ids[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])])
    order, token, n, ids = order[new], token[new], n[new], ids[new]
    left = left[order]
    differs = token[1:] != token[:-1]
    shared = ~(np.concatenate([[True], differs]) & np.concatenate([differs, [True]]))
    order, token, n, ids, left = order[shared], token[shared], n[shared], ids[shared], left[shared]
    if not len(ids):
        return
    if sketched:
        where = np.full(start[-1], -1)
        where[order] = np.arange(len(order))
        sketches = []
        for k, p in enumerate(parts):
            at = where[start[k] : start[k + 1]]
            sketches.append((at[at >= 0], p["sketch"][at >= 0]))
        widths = _folded(sketches, len(ids))
    live, step, found, held = np.arange(len(n)), 1, [], 0
    while len(live):
        live = live[live + step < len(n)]
        live = live[(token[live + step] == token[live]) & (n[live] >= least * n[live + step] - 1e-9)]
        other = live + step
        near = live[(np.minimum(left[live], left[other]) >= _least_shared(n[live], n[other], least, distinct)) | (n[other] >= MOST_WORDS)]
        if sketched:
            near = near[_may_match(near, near + step, n, widths, least, distinct)]
        if len(near):
            found.append(np.stack([near, near + step]))
            held += len(near)
        if held > MOST_PAIRS:
            found, held = [_forest(np.concatenate(found, axis=1))], 0
        step += 1
    if found:
        yield _groups(np.concatenate(found, axis=1), ids)


def _forest(pairs: np.ndarray) -> np.ndarray:
    """Row pairs, one for each row, that connect the same rows as `pairs` do."""
    return np.stack(_roots(pairs))


def _roots(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of `pairs`, and for each the first row of its connected group."""
    rows, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(pairs.shape)
    root = np.arange(len(rows))
    while True:
        low = root.copy()
        np.minimum.at(low, at[0], root[at[1]])
        np.minimum.at(low, at[1], root[at[0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return rows, rows[root]


def _groups(pairs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, id) of the members of each connected group of row pairs.

    The name is made of the ids alone: of the smallest in its high bits, so that groups with one member in common often lie
    side by side, and of all in its low ones.
    """
    rows, root = _roots(pairs)
    mixed = _mixed(ids[rows].astype(np.uint64) + np.uint64(1))
    name = np.zeros(len(ids), np.uint64)
    np.add.at(name, root, mixed ^ (mixed >> np.uint64(32)))
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids[rows])
    home = _mixed(least[root].astype(np.uint64) * _G)
    return ((home & ~np.uint64(0xFFFFFFFF)) | (name[root] & np.uint64(0xFFFFFFFF))).view(np.int64), ids[rows]


def _dealt(rows: DataFrame, group: str, large: DataFrame, key: str) -> DataFrame:
    """`rows` with chunks a <= b of their group: each pair of chunks of a group in `large` (group, chunks) meets in one task."""
    many = large.count()
    found = rows.join(F.broadcast(large) if many <= 100_000 else large, group, "left") if many else rows.withColumn("chunks", F.lit(None).cast("int"))
    mine = F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.col("chunks")).cast("int"))
    found = found.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    return found.select(*rows.columns, F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine")


def sketched(sets: list[np.ndarray]) -> list[bytes]:
    """The sketch of each set of hashes, as thinned() takes it."""
    n = np.array(list(map(len, sets)), np.int64)
    out = [b""] * len(n)
    for mine, made in _sketches(np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(n)), n), n, SET_WIDTHS):
        for i, x in zip(mine.tolist(), made, strict=True):
            out[i] = x.tobytes()
    return out


def thinned(found: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Groups (component, id) like those of `found` of the pairs of sets that their sketches (id, n, sketch) allow to be similar."""
    schema = pa.schema([("component", pa.int64()), ("id", pa.int64())])

    def thin(batches):
        for block, starts in sorted_runs(batches, lambda b: b.column("component").to_numpy()):
            ends = np.append(starts[1:], block.num_rows)
            at = 0
            while at < len(starts):
                last = max(at + 1, int(np.searchsorted(ends, starts[at] + SKETCHED_ROWS, side="right")))
                rows = block.slice(starts[at], ends[last - 1] - starts[at])
                token = np.repeat(np.arange(last - at), ends[at:last] - starts[at:last])
                n, ids, bits = rows.column("n").to_numpy(), rows.column("id").to_numpy(), rows.column("sketch").to_pylist()
                level, parts = _level(n, SET_WIDTHS), []
                for k in range(len(SET_WIDTHS) + 1):
                    mine = np.flatnonzero(level == k)
                    made = np.zeros(len(mine), _kind(k))
                    made["token"], made["n"], made["id"] = token[mine], np.minimum(n[mine], MOST_WORDS), ids[mine]
                    made["sketch"] = np.frombuffer(b"".join(bits[i] for i in mine.tolist()), np.uint8).reshape(len(mine), 8 << k)
                    parts.append(made)
                for name, members in _met(parts, least, True):
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(members)], schema=schema)
                at = last

    rows = found.join(sketches, "id").select("component", "id", "n", "sketch")
    return cut(rows.repartition("component").sortWithinPartitions("component", "id").mapInArrow(thin, "component long, id long").distinct())


# verified links


def linked(found: DataFrame, bags: DataFrame, least: float, distinct: bool = False) -> DataFrame:
    """Edges (src, dst) that connect the ids of `found` (component, id) as all similar pairs within its groups do.

    `bags` has id and words: the hashes of a line's words in order, compared by edit distance, or with `distinct` the sorted
    distinct hashes of a document's runs of words, compared by Jaccard similarity. Each task keeps a spanning forest. Groups
    too large for a task are cut into chunks, and each pair of chunks is compared in one task, which gives only what links
    one chunk to the other.
    """
    lengths = bags.select("id", (F.length("words") / 8).alias("words"))
    size = found.join(lengths, "id").groupBy("component").agg(F.count("*").alias("n"), F.sum("words").alias("words"))
    found = found.join(bags, "id").select("component", "id", "words")
    chunks = F.greatest(F.ceil(F.col("n") / CHUNK_LINES), F.ceil(F.col("words") / CHUNK_WORDS)).cast("int")
    large = cut(size.withColumn("chunks", chunks).where("chunks > 1").select("component", "chunks"))
    dealt = _dealt(found, "component", large, "id")
    keys = ["component", "a", "b"]

    def verify(batches):
        key = lambda b: np.rec.fromarrays([b.column(k).to_numpy() for k in keys])
        schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])
        for block, starts in sorted_runs(batches, key):
            ids, a, b, mine = (block.column(c).to_numpy() for c in ("id", "a", "b", "mine"))
            out = _links(ids, block.column("words"), starts, np.where(a == b, -1, mine), least, distinct)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(ids[out[:, 0]]), pa.array(ids[out[:, 1]])], schema=schema)

    home = F.shiftright("component", 32)  # groups of one name's high bits share links that a task has found
    return dealt.repartition(home, "a", "b").sortWithinPartitions(*keys, "id").mapInArrow(verify, "src long, dst long")


def _links(ids: np.ndarray, words: pa.Array, starts: np.ndarray, side: np.ndarray, least: float, distinct: bool) -> np.ndarray:
    """Row pairs of spanning forests of the links within each run of rows; where rows have a side (not -1), only pairs of both sides.

    Without sides, rows whose ids the runs before have connected already are not compared again.
    """
    number = np.unique(ids, return_inverse=True)[1]
    parent = list(range(len(ids)))
    rows = [np.frombuffer(x, np.uint64) for x in words.to_pylist()]
    n = np.array(list(map(len, rows)), np.int64)
    match = overlapping if distinct else similar
    pairs, widths, steps = [], None, SET_WIDTHS if distinct else FINE_WIDTHS
    ends = np.append(starts[1:], len(rows))
    if (ends - starts > 2).any():
        bound = np.append(0, np.cumsum(n))
        made = [_sketches(np.concatenate(rows[a:b]) if b > a else np.zeros(0, np.uint64), np.repeat(np.arange(b - a), n[a:b]), n[a:b], steps) for a, b in _pieces(bound)]
        offsets = [a for a, _ in _pieces(bound)]
        merged = [(np.concatenate([m[k][0] + o for m, o in zip(made, offsets, strict=True)]), np.concatenate([m[k][1] for m in made])) for k in range(len(steps) + 1)]
        widths = _folded(merged, len(rows))
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a == 2:
            x, y = (find(parent, number[i]) for i in (a, a + 1))
            if min(n[a], n[a + 1]) >= least * max(n[a], n[a + 1]) - 1e-9 and (x != y if side[a] < 0 else side[a] != side[a + 1]) and match(rows[a], rows[a + 1], least):
                pairs.append((a, a + 1))
                if side[a] < 0:
                    parent[y] = x
        elif b - a > 2:
            made = _forest_of(rows, n, side, widths, a, b, match, least, [find(parent, x) for x in number[a:b].tolist()] if side[a] < 0 else None)
            pairs += made
            if side[a] < 0:
                for i, j in made:
                    x, y = find(parent, number[i]), find(parent, number[j])
                    parent[y] = x
    return np.array(pairs, np.int64).reshape(-1, 2)


def _pieces(bound: np.ndarray, most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` words."""
    a = 0
    while a < len(bound) - 1:
        b = max(a + 1, int(np.searchsorted(bound, bound[a] + most, side="right")) - 1)
        yield a, b
        a = b


def _forest_of(rows, n, side, widths, a: int, b: int, match, least: float, before: list[int] | None) -> list[tuple[int, int]]:
    """A spanning forest of the links of rows a to b, beyond those of equal numbers in `before`. Of two sides each is connected first, and only links between them are given."""
    first: dict[int, int] = {}
    parent = list(range(b - a)) if before is None else [first.setdefault(x, i) for i, x in enumerate(before)]
    root, out = np.array(parent), []
    two = bool(side[a] >= 0)
    if two and (side[a:b] == side[a]).all():
        return out
    for across in (False, True) if two else (False,):
        for i in range(b - a - 1):
            rest = np.arange(i + 1, b - a)
            rest = rest[root[rest] != root[i]]
            if two:
                rest = rest[(side[a + rest] != side[a + i]) == across]
            rest = rest[np.minimum(n[a + rest], n[a + i]) >= least * np.maximum(n[a + rest], n[a + i]) - 1e-9]
            if len(rest):
                rest = rest[_may_match(np.full(len(rest), a + i), a + rest, n, widths, least, *((True,) if match is overlapping else (False, FINE_WIDTHS)))]
            joined = False
            for j in rest.tolist():
                x, y = find(parent, i), find(parent, j)
                if x != y and match(rows[a + i], rows[a + j], least):
                    parent[y] = x
                    joined = True
                    if across or not two:
                        out.append((a + i, a + j))
            if joined:
                root = np.array([find(parent, x) for x in range(b - a)])
    return out


def _with(rows: DataFrame, few: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join with a written table, which is broadcast after a check of its number of rows; else both sides are shuffled."""
    return rows.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, keys, how)


def line_candidates(docs: DataFrame, least_words: int = LEAST_WORDS, least: float = SIMILARITY) -> DataFrame:
    """candidates() of the lines of `docs`, and the place of every line of `least_words` words or more; each text is read once."""

    def bags(batch: pa.RecordBatch) -> tuple:
        distinct, code, n, row, number = line_words(batch.column("text"), least_words)
        places = np.zeros(len(n), _PLACES)
        places["doc"], places["text_hash"] = (batch.column(c).to_numpy()[row] for c in ("doc", "text_hash"))
        places["line"], places["id"] = number, line_ids(distinct[code], n)
        return distinct, code, n, places["id"].copy(), places

    keyed = _keyed(docs)
    sample = cut(keyed.where(F.pmod(F.xxhash64("doc", "text_hash", F.lit(1)), F.lit(SAMPLED)) == 0))
    return candidates(keyed, sample, bags, least, True)


def similar_lines(docs: DataFrame, lines: DataFrame, found: DataFrame, least: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """Edges (src, dst) that connect the ids of the same lines as all pairs of edit similarity `least` or more in words do.

    `lines` has one row per distinct line: id and its first occurrence; `found` are groups of candidates (component, id). Only
    texts that hold the first occurrence of a candidate are read again.
    """

    def words(batch: pa.RecordBatch) -> dict:
        asked, wanted = batch.column("lines"), []
        numbers = pc.list_flatten(asked).field("line").to_pylist()
        many, at = pc.list_value_length(asked).to_pylist(), 0
        for text, k in zip(batch.column("text").to_pylist(), many, strict=True):
            parts = text.split("\n")
            wanted += [parts[i] for i in numbers[at : at + k]]
            at += k
        distinct, code, n, *_ = line_words(pa.array(wanted, pa.string()), least_words)
        hashes, end = distinct[code], np.cumsum(n)
        return {"id": pc.list_flatten(asked).field("id"), "words": [hashes[e - k : e].tobytes() for e, k in zip(end.tolist(), n.tolist(), strict=True)]}

    return linked(found, _fetched(_keyed(docs), lines, found, words), least)


def _fetched(keyed: DataFrame, firsts: DataFrame, found: DataFrame, words: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """(id, words) of the candidates `found`, by words() from the texts of `keyed` that hold their first occurrences."""
    wanted = firsts.join(found.select("id").distinct(), "id").groupBy("first.doc", "first.text_hash").agg(F.collect_list(F.struct("first.line", "id")).alias("lines"))
    texts = _with(keyed, cut(wanted), ["doc", "text_hash"], "inner").select("text", "lines")
    return cut(map_batches(texts, words, "id long, words binary", SLICE_BYTES).dropDuplicates(["id"]))


def duplicate_lines(docs: DataFrame, least_words: int = LEAST_WORDS, least: float = SIMILARITY) -> DataFrame:
    """Lines to take out: doc, text_hash and the sorted numbers of lines that repeat an earlier one.

    Lines that are equal when normalised, or connected by similar_lines(), are one group; its first occurrence in the order
    of (doc_id, hash of the text, line number) stays.
    """
    both = line_candidates(docs, least_words, least)
    seen = both.where("component IS NULL").drop("component")
    found = cut(both.where("component IS NOT NULL").select("component", "id").distinct())
    place = F.struct("doc", "text_hash", "line")
    lines = cut(seen.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("times")))
    member = cut(connected_components(similar_lines(docs, lines, found, least, least_words)))
    tied = lines.join(member, F.col("id") == F.col("node")).select("id", "first", "times", "component")
    alone = lines.where("times > 1").join(member, F.col("id") == F.col("node"), "left_anti").select("id", "first", "times", F.col("id").alias("component"))
    groups = cut(tied.unionByName(alone))  # other lines stand once and are like none
    firsts = groups.groupBy("component").agg(F.min("first").alias("kept"), F.sum("times").alias("times")).where("times > 1")
    kept = cut(groups.join(firsts.select("component", "kept"), "component").select("id", "kept"))
    forget(lines, member, found, groups)
    gone = _with(seen, kept, ["id"], "inner").where(place != F.col("kept"))
    return cut(gone.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("lines")))


def drop_duplicate_lines(docs: DataFrame, least_words: int = LEAST_WORDS, least: float = SIMILARITY) -> DataFrame:
    """`docs` with repeated lines taken out of the texts, and columns n_lines and n_dropped.

    Of every group of duplicate_lines() one occurrence stays; shorter lines always stay. A document whose lines all go keeps
    its row, with an empty text. Null texts stay null and have no lines. Rows that repeat both doc_id and text count as one
    document and get the same text. Columns other than doc_id and text pass through unread, whatever their names; columns
    named n_lines or n_dropped are replaced.
    """
    gone = duplicate_lines(docs, least_words, least)
    doc, text_hash, lines = (free(c, docs) for c in ("doc", "text_hash", "gone"))
    taken = gone.select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("lines").alias(lines))
    keyed = _with(docs.withColumn(doc, _doc()).withColumn(text_hash, _text_hash()), taken, [doc, text_hash], "left")

    @F.pandas_udf("string")
    def without(texts, gone_lines):
        def one(text, gone):
            if not len(gone):
                return text
            out = set(gone)
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out)

        return pd.Series([one(t, g) for t, g in zip(texts, gone_lines, strict=True)], dtype=object)

    split = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    text = F.when(F.col(lines).isNull(), F.col("text")).otherwise(without("text", F.coalesce(lines, F.array().cast("array<int>"))))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return keyed.select(*columns, split.cast("long").alias("n_lines"), F.when(F.col(lines).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_dropped"))


def runs_of(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of `shingle` words of each text; fewer words are one run, none and nulls give none."""
    distinct, code, n = _hashed(pc.fill_null(pc.ascii_lower(texts), ""))
    h = distinct[code]
    end = np.cumsum(n)
    left = np.repeat(end, n) - np.arange(len(h))  # words from here to the text's end
    whole = np.repeat(n < shingle, n)
    step = np.arange(1, shingle + 1, dtype=np.uint64) * _G
    run = np.zeros(len(h), np.uint64)
    for i in range(min(shingle, len(h))):
        run[: len(h) - i] += np.where(left[: len(h) - i] > i, _mixed(h[i:] + step[i]), np.uint64(0))
    starts = (left >= shingle) | (whole & (left == np.repeat(n, n)))
    item, run = np.repeat(np.arange(len(n)), n)[starts], _mixed(run[starts])
    order = np.lexsort((run, item))
    item, run = item[order], run[order]
    new = np.concatenate([[True], (item[1:] != item[:-1]) | (run[1:] != run[:-1])])[: len(run)]
    item, run = item[new], run[new]
    return np.split(run, np.searchsorted(item, np.arange(1, len(n)))) if len(n) else []


def set_id(run: np.ndarray) -> int:
    """64-bit id of a set of hashes."""
    return int(_mixed(_mixed(run).sum(dtype=np.uint64, keepdims=True) + np.array([len(run)], np.uint64) * _C).view(np.int64)[0])


def _unsettled(found: DataFrame, member: DataFrame) -> DataFrame:
    """The groups of `found` (component, id) whose ids `member` (node, component) leaves in several components."""
    known = member.select(F.col("node").alias("id"), F.col("component").alias("settled"))
    apart = found.join(known, "id", "left").groupBy("component").agg(F.min(F.coalesce("settled", "id")).alias("low"), F.max(F.coalesce("settled", "id")).alias("high"))
    return cut(found.join(apart.where("low <> high").select("component"), "component", "left_semi"))


def drop_similar_documents(docs: DataFrame, shingle: int = 5, least: float = SIMILARITY, distance: int | None = None) -> DataFrame:
    """One row of each group of documents stays: those connected by a Jaccard similarity of `least` or more of their runs of `shingle` words.

    With `distance`, groups of SimHash fingerprints that differ in so many bits or fewer, as operator 3 links them, are compared
    first; the prefix join is the exact way for what lies further apart, and groups of it that are connected by then aren't
    compared again. The result is the same.

    No such pair is missed; sets of runs are told apart by 64-bit hashes. Words are runs of characters other than ASCII white
    space, A-Z lower-cased; texts without words, null ones too, are one group. The row with the smallest doc_id stays, null
    ids last, and of its texts the one with the smallest hash. Rows are told apart by doc_id and text, so an id that repeats
    with another text loses nothing to the first. Columns pass through whatever their names. Each text is read once for the
    candidates; those of candidates are read again.
    """

    def bags(batch: pa.RecordBatch) -> tuple:
        sets = runs_of(batch.column("text"), shingle)
        n = np.array(list(map(len, sets)), np.int64)
        distinct, code = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
        places = np.zeros(len(n), _PLACES)
        places["doc"], places["text_hash"] = (batch.column(c).to_numpy() for c in ("doc", "text_hash"))
        places["line"], places["id"] = batch.column("no_id").to_numpy(zero_copy_only=False), [set_id(x) for x in sets]
        return distinct, code, n, places["id"].copy(), places

    def words(batch: pa.RecordBatch) -> dict:
        sets = runs_of(batch.column("text"), shingle)
        asked = batch.column("lines").to_pylist()
        return {"id": [x["id"] for xs in asked for x in xs], "words": [r.tobytes() for r, xs in zip(sets, asked, strict=True) for _ in xs]}

    def prints(batch: pa.RecordBatch) -> dict:
        made = [0 if distance is None else simhash.fingerprint(t) for t in batch.column("text").to_pylist()]
        sets = runs_of(batch.column("text"), shingle)
        return {"id": [set_id(x) for x in sets], "fingerprint": np.array(made, np.uint64).view(np.int64), "n": list(map(len, sets)), "sketch": sketched(sets)}

    keyed = docs.select(_doc(), _text_hash(), F.col("doc_id").isNull().alias("no_id"), "text")
    sample = cut(keyed.where(F.pmod(F.xxhash64("doc", "text_hash", F.lit(1)), F.lit(SAMPLED)) == 0))
    both = candidates(keyed, sample, bags, least, True, True)
    printed = cut(map_batches(keyed.select("text"), prints, "id long, fingerprint long, n long, sketch binary", SLICE_BYTES))
    shared = both.where("component IS NOT NULL").select("component", "id").distinct()
    found = thinned(shared, printed.select("id", "n", "sketch").dropDuplicates(["id"]), least)
    seen = cut(both.where("component IS NULL").groupBy("id").agg(F.min(F.struct("line", "doc", "text_hash")).alias("first")))
    fetched = lambda groups: linked(groups, _fetched(keyed, seen, groups, words), least, True)
    if distance is None:
        edges = fetched(found)
    else:
        near = simhash.links(printed.select("id", "fingerprint").distinct(), distance)
        groups = cut(connected_components(near).select("component", F.col("node").alias("id")))
        close = cut(fetched(groups))
        edges = fetched(_unsettled(found, cut(connected_components(close)))).unionByName(close)
        forget(groups)
    member = cut(connected_components(edges))
    groups = seen.join(member, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("component", "id").alias("component")).agg(F.min("first").alias("first"))
    doc, text_hash, no_id = names = [free(c, docs) for c in ("doc", "text_hash", "no_id")]
    kept = cut(groups.select(F.col("first.doc").alias(doc), F.col("first.text_hash").alias(text_hash), (F.col("first.line") == 1).alias(no_id)))
    forget(seen, member, found, printed)
    once = docs.withColumn(doc, _doc()).withColumn(text_hash, _text_hash()).withColumn(no_id, F.col("doc_id").isNull()).join(kept, names, "left_semi")
    return once.dropDuplicates(names).select([F.col(f"`{c}`") for c in docs.columns])
