"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction."""

from __future__ import annotations

import bisect
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, map_batches

#: Tokens in a sequence.
CAPACITY = 4096
END = 1
#: Pieces of one length that a task ranks, about.
BUCKET_ROWS = 5_000


class Encoder:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer drops white space and splits letters, digits and the rest.

    The library's normaliser takes most of its time, so texts of Latin-1 characters, for which that step is plain lower-casing,
    are split here and only distinct words go to the library's model; other texts go to the library whole. `words` holds at
    most about `limit` words and starts anew beyond them.
    """

    _SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµº\xdf-\xf6\xf8-\xff]+|[0-9²³¹¼½¾]|[^\sa-zªµº\xdf-\xf6\xf8-\xff0-9²³¹¼½¾]+")
    _PLAIN = re.compile(r"[\x00-\x1b\x20-\xff]*")

    def __init__(self, path: str, limit: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.model = self.tokenizer.model
        self.limit = limit
        self.words = _Words(self.ids_of_word)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.bytes = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def ids_of_word(self, word: str) -> tuple[int, ...]:
        return tuple([t.id for t in self.model.tokenize("".join(map(self.bytes.__getitem__, word.encode())))])

    def encode(self, text: str) -> Iterable[int]:
        if not self._PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if len(self.words) > self.limit:
            self.words.clear()
        return chain.from_iterable(map(self.words.__getitem__, self._SPLIT.findall(text.lower())))


class _Words(dict):
    """Ids of the words met so far; a new word is looked up once."""

    def __init__(self, ids_of_word: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.ids_of_word = ids_of_word

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self[word] = self.ids_of_word(word)
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids of every piece; each text's ids end with id 1, and only longer ones are cut."""

    def fn(batch):
        enc = encoder(tokenizer)
        doc, piece, start, length, crc, kept = [], [], [], [], [], []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.fromiter(chain(enc.encode(text or ""), (END,)), dtype="<u4")
            for k, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                doc.append(i), piece.append(k), start.append(at), length.append(len(part)), crc.append(zlib.crc32(part.tobytes())), kept.append(part.astype(np.int64))
        return {"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc, "ids": kept}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>")


def lengths(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """pieces() without the ids."""

    def fn(batch):
        enc = encoder(tokenizer)
        rows = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.fromiter(chain(enc.encode(text or ""), (END,)), dtype="<u4")
            if len(ids) <= capacity:
                rows.append((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
            else:
                rows += [(i, k, at, min(capacity, len(ids) - at), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_by_dominance(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sequences that some best packing contains: ((lengths, how many such sequences), ...), and the counts left.

    From the longest length down, with r the room beside it and p the largest other that fits: the length goes alone if
    nothing fits, and with p if p fills r, if no two others fit together, or if no three do and no two exceed p. In each case
    whatever else could lie beside the length fits into the place of p, so that the set dominates all others that hold the
    length, and fixing it costs no sequence. This stays so when pieces are taken away, so equal sets are fixed together.
    Other lengths are left to best fit.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    order = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]
            order.pop(bisect.bisect_left(order, length))

    def largest(room: int, length: int) -> int | None:
        at = bisect.bisect_right(order, room) - 1
        if at >= 0 and order[at] == length and left[length] == 1:
            at -= 1
        return order[at] if at >= 0 else None

    def smallest(length: int) -> list[int]:
        """The three smallest others."""
        out: list[int] = []
        for x in order[:4]:
            out += [x] * min(3, left[x] - (x == length))
        return out[:3]

    def pair(room: int, length: int) -> int:
        """The largest sum within `room` of two others."""
        best, lo, hi = 0, 0, len(order) - 1
        while lo <= hi:
            a, b = order[lo], order[hi]
            if a + b > room:
                hi -= 1
                continue
            if left[a] > (a == length) and left[b] > (b == length) + (a == b):
                best = max(best, a + b)
            elif a != b and left[b] <= (b == length):
                hi -= 1
                continue
            lo += 1
        return best

    for length in sorted(left, reverse=True):
        while left.get(length):
            room = capacity - length
            partner = largest(room, length)
            if partner is None:
                n = left[length] if length * 2 > capacity else 1
                fixed.append(((length,), n))
                take(length, n)
                continue
            if partner != room:
                few = smallest(length)
                two = len(few) > 1 and few[0] + few[1] <= room
                three = len(few) > 2 and sum(few) <= room
                if three or two and pair(room, length) > partner:
                    break
            n = left[length] // 2 if partner == length else min(left[length], left[partner])
            fixed.append(((length, partner), n))
            take(length, n)
            take(partner, n)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts of lengths: equal open sequences are filled together."""
    open_at: dict[int, Counter] = defaultdict(Counter)
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                whole, rest = divmod(n, fit)
                for content, many in (((length,) * fit, whole), ((length,) * rest, 1)):
                    if many and content:
                        _open(open_at, rooms, done, content, many, capacity)
                break
            room = rooms[at]
            content, many = next(iter(open_at[room].items()))
            fit = min(room // length, n)
            k = min(many, n // fit)
            open_at[room][content] -= k
            if not open_at[room][content]:
                del open_at[room][content]
            if not open_at[room]:
                del open_at[room]
                rooms.pop(at)
            _open(open_at, rooms, done, content + (length,) * fit, k, capacity)
            n -= fit * k
    return done + [(content, many) for at in open_at.values() for content, many in at.items()]


def _open(open_at, rooms, done, content, many, capacity) -> None:
    room = capacity - sum(content)
    if not room:
        done.append((content, many))
        return
    if room not in open_at:
        bisect.insort(rooms, room)
    open_at[room][content] += many


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Places by length: the pieces of a `length` ranked from `rank` on go to the sequences from `sequence` on, at `offset`.

    The plan follows from the counts of at most `capacity` lengths, and has a row for each kind of sequence and place in it.
    """
    fixed, left = reduce_by_dominance(counts, capacity)
    taken: Counter = Counter()
    rows, sequence = [], 0
    for content, many in fixed + best_fit(left, capacity):
        offset = 0
        for length in content:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += many
            offset += length
        sequence += many
    frame = pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"], dtype=np.int64)
    return frame.sort_values(["length", "rank"], ignore_index=True)


def assign(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for each row of a table with doc_id, piece and length (1 to `capacity`).

    The driver sees one count for each length and bucket of pieces. Pieces of one length are ranked within hash buckets
    whose first ranks come from those counts, so a length that a third of all pieces have is ranked in many tasks.
    """
    spark = table.sparkSession
    rows = table.count()
    buckets = max(1, rows // BUCKET_ROWS)
    table = table.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = cut(table.groupBy("length", "_bucket").agg(F.count("*").alias("n")))
    first = counted.withColumn("first", F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    first = first.select("length", "_bucket", F.coalesce("first", F.lit(0)).alias("first"))
    totals = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(totals, capacity)
    keys = (places["length"].to_numpy() << 44) + places["rank"].to_numpy()
    sequences, ranks, offsets = (places[c].to_numpy() for c in ("sequence", "rank", "offset"))
    shared = spark.sparkContext.broadcast((keys, ranks, sequences, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k, r, s, o = shared.value
        at = np.searchsorted(k, (length.to_numpy() << 44) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": s[at] + rank.to_numpy() - r[at], "offset": o[at]})

    nth = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = table.withColumn("_nth", nth).join(F.broadcast(first) if buckets * capacity <= 500_000 else first, ["length", "_bucket"])
    placed = ranked.withColumn("_place", place("length", (F.col("first") + F.col("_nth")).cast("long")))
    return placed.select(*[c for c in table.columns if c != "_bucket"], "_place.sequence_id", "_place.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack the pieces of all rows of `docs` into sequences of at most `capacity` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts give a piece of one
    id; repeated rows and null ids are packed like any other; an empty table gives no rows; other columns are not read.
    """
    return assign(cut(lengths(docs, tokenizer, capacity)), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, doc_ids and lengths, in the order of offsets."""
    table = cut(pieces(docs, tokenizer, capacity))
    placed = assign(table, capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    whole = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    return whole.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
