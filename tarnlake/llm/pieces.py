"""N-best SentencePiece segmentation: a forward Viterbi pass, then backward A* with its scores as exact heuristics."""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_batches

#: Segmentations of a text.
BEST = 4
#: Scores are whole numbers of this part of a natural logarithm, so that sums are exact and ties are ties.
UNIT = 1e-6
#: Words up to so many characters are segmented together; longer ones by themselves.
TOGETHER = 64
_SPACE, _NONE = "▁", "\x00"
_NEVER = -(1 << 60)
_BYTES = -2  # in place of a piece: a character spelt in bytes
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 32, 48, TOGETHER)


class Pieces:
    """The piece lattice of a model file: pieces with log probabilities, and bytes for characters that no piece has.

    A text is written as SentencePiece does: a space before it, spaces as ▁, no other normalisation. The model file's scores
    are the order in which its pieces were merged, which cannot be added up; as tokenizers aren't trained here, a piece has
    the probability that Zipf's law gives its place in that order. No piece crosses the start of a word or a line end, so the
    lattice falls apart there. Words are segmented once; about `limit` of them are kept.
    """

    _WORD = re.compile(f"{_SPACE}*[^{_SPACE}\n]+|\n|{_SPACE}+")

    def __init__(self, path: str, best: int = BEST, limit: int = 700_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.best, self.limit = best, limit
        self.byte: dict[int, int] = {}
        self.raw: dict[int, bytes] = {}
        usual: list[tuple[str, int]] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                usual.append((piece, i))
                self.raw[i] = piece.encode()
        whole = math.log(sum(1 / (r + 1) for r in range(len(usual)))) if usual else 0.0
        #: Id and score of each piece.
        self.score = {p: (i, -round((math.log(r + 1) + whole) / UNIT)) for r, (p, i) in enumerate(usual)}
        #: Score of each byte of a character that has no piece.
        self.byte_score = min((s for _, s in self.score.values()), default=0) - round(10 / UNIT)
        self.longest = max(map(len, self.score))
        assert all(self._WORD.fullmatch(p) for p in self.score), "a piece crosses the edge of a word"
        self._table()
        self.known = _Numbers()
        self._forget()

    def _table(self) -> None:
        """Hash table from the hash of a piece's characters to its id, open addressing."""
        rng = np.random.default_rng(11)
        self._base, self._mix = (np.uint64(x) for x in rng.integers(1 << 60, 1 << 63, 2, dtype=np.uint64) | np.uint64(1))
        self._shift = np.uint64(64 - 18)
        self._hash, self._id = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32)
        self._piece_score = np.full(max(self.raw) + 2, _NEVER, np.int64)
        for piece, (i, s) in self.score.items():
            h = 0
            for c in piece:
                h = (h * int(self._base) + ord(c) + 1) & ((1 << 64) - 1)
            at = ((h * int(self._mix)) & ((1 << 64) - 1)) >> int(self._shift)
            while self._hash[at]:
                at = (at + 1) & ((1 << 18) - 1)
            self._hash[at], self._id[at] = h, i
            self._piece_score[i] = s

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = ((h * self._mix) >> self._shift).astype(np.int64)
        found = self._hash[at]
        out = np.where(found == h, self._id[at], np.int32(-1))
        left = np.flatnonzero((found != h) & (found != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << 18) - 1)
            found = self._hash[at[left]]
            out[left] = np.where(found == h[left], self._id[at[left]], -1)
            left = left[(found != h[left]) & (found != 0)]
        return out

    def _forget(self) -> None:
        self.known = _Numbers()
        self.others: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
        self._ids, self._used = np.zeros(1 << 16, np.int32), 0
        self._start, self._count, self._best, self._gap, self._good = (np.zeros(1 << 14, np.int64) for _ in range(5))

    def edges(self, word: str, b: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(start, ids, score) of the pieces that end at `b`, longest first; a character is spelt in bytes where no piece is that character."""
        for a in range(max(0, b - self.longest), b):
            if hit := self.score.get(word[a:b]):
                yield a, (hit[0],), hit[1]
            elif a == b - 1:
                raw = word[a].encode("utf-8", "surrogatepass")
                yield a, tuple([self.byte[x] for x in raw]), self.byte_score * len(raw)

    def segment(self, word: str, best: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
        """The N best (score, ids) of a word, best first; of equal scores the one with the longer last piece, and so on, is first.

        Backward A*: a hypothesis covers word[at:], and its bound is its own score plus the Viterbi score of word[:at], which
        is exact, so that complete hypotheses leave the heap in order of score. A hypothesis is its last edge and the number
        of the one that it extends, so memory grows with the heap alone.
        """
        best = best or self.best
        into = [list(self.edges(word, b)) for b in range(len(word) + 1)]
        viterbi = [0] * (len(word) + 1)
        for b in range(1, len(word) + 1):
            viterbi[b] = max([viterbi[a] + s for a, _, s in into[b]])
        heap: list[tuple[int, int, int]] = [(-viterbi[-1], len(word), 0)]
        came: list[tuple[int, tuple[int, ...], int]] = [(-1, (), 0)]
        out: list[tuple[int, tuple[int, ...]]] = []
        while heap and len(out) < best:
            _, at, node = heapq.heappop(heap)
            own = came[node][2]
            if not at:
                ids: list[int] = []
                while node > 0:
                    ids += came[node][1]
                    node = came[node][0]
                out.append((own, tuple(ids)))
                continue
            for a, piece, s in into[at]:
                heapq.heappush(heap, (-(viterbi[a] + s + own), a, len(came)))
                came.append((node, piece, own + s))
        return out

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether words may begin with several ▁, or a mark stands in the text."""
        return "  " in text or text[:1] == " " or _SPACE in text or _NONE in text

    def words_of(self, text: str) -> list[str]:
        """The words of a text, as keys: one after a space without it, a null character before one that follows none."""
        if self._odd(text):
            words = self._WORD.findall(_SPACE + text.replace(" ", _SPACE))
            return [w if w == "\n" else w[1:] if w[0] == _SPACE and w[1:2] != _NONE else _NONE + w for w in words]
        return text.replace("\n", f" \n {_NONE}").split(" ") if text else []

    def _spells(self, keys: list[str], text: str) -> bool:
        if self._odd(text):
            return _SPACE not in text and "".join(map(self.word, keys)) == _SPACE + text.replace(" ", _SPACE)
        return " ".join(keys).replace(f" \n {_NONE}", "\n") == text

    @staticmethod
    def word(key: str) -> str:
        return key if key == "\n" else key[1:] if key[:1] == _NONE else _SPACE + key

    def learn(self) -> None:
        """Segment the words that were numbered since the last time."""
        new, self.known.new = self.known.new, []
        first = len(self.known) - len(new)
        while len(self._start) < len(self.known):
            self._start, self._count, self._best, self._gap, self._good = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._count, self._best, self._gap, self._good))
        together: dict[int, tuple[list[int], list[str]]] = {w: ([], []) for w in _WIDTHS}
        fitting = [next(x for x in _WIDTHS if x >= n) for n in range(TOGETHER + 1)]
        for i, w in enumerate(map(self.word, new), first):
            if len(w) > TOGETHER:
                found = self.segment(w, 2)
                gap = found[0][0] - found[1][0] if len(found) > 1 else -_NEVER
                self._keep(np.array([i]), [w], np.array([found[0][0]]), np.array([gap]), [found[0][1]])
            else:
                numbers, group = together[fitting[len(w)]]
                numbers.append(i), group.append(w)
        for width, (numbers, group) in together.items():
            step = max(1, 1_500_000 // (width * min(width, self.longest)))
            for at in range(0, len(group), step):
                self._together(np.array(numbers[at : at + step]), group[at : at + step], width)

    def _together(self, numbers: np.ndarray, words: list[str], width: int) -> None:
        """Viterbi forward and backward over words of at most `width` characters, side by side.

        What the best segmentation that differs from the best one costs more is the least loss of an edge off the best path.
        """
        m, most = len(words), min(width, self.longest)
        n = np.fromiter(map(len, words), np.int64, m)
        text = np.zeros((width, m), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(m), n)
        text[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), row] = flat
        code = text.astype(np.uint64)
        piece = np.full((width + 1, most + 1, m), -1, np.int32)
        score = np.full((width + 1, most + 1, m), _NEVER, np.int64)
        size = 1 + (text > 0x7F).astype(np.int64) + (text > 0x7FF) + (text > 0xFFFF)
        for a in range(width):
            h = np.zeros(m, np.uint64)
            for k in range(1, min(most, width - a) + 1):
                h = h * self._base + code[a + k - 1] + np.uint64(1)
                found = self._find(h)
                if k == 1:
                    lacking = found < 0
                    found[lacking] = _BYTES
                    score[a + 1, 1] = np.where(lacking, self.byte_score * size[a], self._piece_score[found])
                else:
                    score[a + k, k] = self._piece_score[found]
                piece[a + k, k] = found
        ahead, back = np.full((width + 1, m), _NEVER, np.int64), np.zeros((width + 1, m), np.int64)
        ahead[0] = 0
        for b in range(1, width + 1):
            for k in range(min(most, b), 0, -1):  # of equal scores the longest last piece
                s = ahead[b - k] + score[b, k]
                better = s > ahead[b]
                ahead[b][better], back[b][better] = s[better], k
        behind = np.full((width + 1, m), _NEVER, np.int64)
        behind[n, np.arange(m)] = 0
        for a in range(width - 1, -1, -1):
            for k in range(1, min(most, width - a) + 1):
                np.maximum(behind[a], score[a + k, k] + behind[a + k], out=behind[a])
        cols = np.arange(m)
        best = ahead[n, cols]
        at, ids, steps = n.copy(), np.full((width, m), -1, np.int32), np.zeros(m, np.int64)
        spelt = np.zeros(m, bool)
        while (live := np.flatnonzero(at > 0)).size:
            k = back[at[live], live]
            found = piece[at[live], k, live]
            spelt[live[found == _BYTES]] = True
            ids[width - 1 - steps[live], live] = found
            score[at[live], k, live] = _NEVER
            at[live] -= k
            steps[live] += 1
        second = np.full(m, _NEVER, np.int64)
        for b in range(1, width + 1):
            for k in range(1, min(most, b) + 1):
                np.maximum(second, ahead[b - k] + score[b, k] + behind[b], out=second)
        gap = np.where(second > _NEVER // 2, best - second, -_NEVER)
        made = np.ascontiguousarray(ids.T)
        rows: list = [None] * m
        for i in np.flatnonzero(spelt).tolist():
            rows[i] = self._spell(words[i], made[i, width - steps[i] :].tolist())
        self._keep(numbers, words, best, gap, rows, made, steps)

    def _spell(self, word: str, ids: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        at = 0
        for i in ids:
            if i == _BYTES:
                out += [self.byte[x] for x in word[at].encode("utf-8", "surrogatepass")]
                at += 1
            else:
                out.append(i)
                at += len(self.raw[i].decode())
        return tuple(out)

    def _keep(self, numbers: np.ndarray, words: list[str], best: np.ndarray, gap: np.ndarray, rows: list, made: np.ndarray | None = None, steps: np.ndarray | None = None) -> None:
        m = len(words)
        if made is None:
            made, steps = np.zeros((m, 0), np.int32), np.zeros(m, np.int64)
        count = np.array([s if r is None else len(r) for r, s in zip(rows, steps.tolist(), strict=True)], np.int64)
        total = int(count.sum())
        while len(self._ids) < self._used + total:
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        start = self._used + np.cumsum(count) - count
        plain = np.array([r is None for r in rows])
        if plain.any():
            width = made.shape[1]
            where = np.arange(width)[None, :] >= width - np.where(plain, steps, 0)[:, None]
            to = (start + count)[:, None] - (width - np.arange(width))[None, :]
            self._ids[to[where]] = made[where]
        for i in np.flatnonzero(~plain).tolist():
            self._ids[start[i] : start[i] + count[i]] = rows[i]
        self._start[numbers], self._count[numbers], self._best[numbers], self._gap[numbers] = start, count, best, gap
        listed = self._ids[self._used : self._used + total].tolist()
        good = self.decoded(listed) == "".join(words).encode("utf-8", "surrogatepass")
        self._good[numbers] = good or [self.decoded(listed[a:b]) == w.encode("utf-8", "surrogatepass") for w, a, b in zip(words, start - self._used, start - self._used + count, strict=True)]
        self._used += total

    def decoded(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[bool, list[tuple[int, np.ndarray]]]]:
        """For each text whether all segmentations spell it, and the N best (score, ids), best first; an empty text has one, without ids.

        Words choose independently, so the N best texts differ from the best one in at most N - 1 words: those whose second
        choice costs least. Only these go through A*; combinations of their choices are taken from a heap by cost.
        """
        if len(self.known) > self.limit:
            self._forget()
        keys = [self.words_of(t) for t in texts]
        number = self.known.__getitem__
        numbers = [np.fromiter(map(number, ks), np.int64, len(ks)) for ks in keys]
        self.learn()
        for text, ks, at in zip(texts, keys, numbers, strict=True):
            if not ks:
                yield True, [(0, np.zeros(0, np.int32))]
                continue
            count = self._count[at]
            ends = np.cumsum(count)
            top = self._ids[np.repeat(self._start[at] - ends + count, count) + np.arange(int(ends[-1]))]
            good = bool(self._good[at].all()) and self._spells(ks, text)
            gaps = self._gap[at]
            near = self._least(gaps)
            choices = [self._choices(self.word(ks[i])) for i in near]
            good &= all(ok for ok, _ in choices)
            found = [c for _, c in choices]
            score = int(self._best[at].sum())
            heap = [(0, (0,) * len(near))]
            seen, out = {heap[0][1]}, []
            while heap and len(out) < self.best:
                cost, choice = heapq.heappop(heap)
                parts, last = [], 0
                for i, c, alternatives in sorted(zip(near, choice, found, strict=True)):
                    if c:
                        parts += [top[last : ends[i] - count[i]], alternatives[c][1]]
                        last = ends[i]
                out.append((score - cost, np.concatenate([*parts, top[last:]]) if parts else top))
                for k in range(len(near)):
                    nxt = (*choice[:k], choice[k] + 1, *choice[k + 1 :])
                    if nxt[k] < len(found[k]) and nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (cost + found[k][choice[k]][0] - found[k][nxt[k]][0], nxt))
            yield good, out

    def _least(self, gaps: np.ndarray) -> list[int]:
        """Places of the N - 1 least gaps, earlier ones first among equals; words with one segmentation are left out."""
        k = self.best - 1
        if not k:
            return []
        some = np.flatnonzero(gaps <= np.partition(gaps, k - 1)[k - 1]) if len(gaps) > k else np.arange(len(gaps))
        some = some[np.argsort(gaps[some], kind="stable")][:k]
        return [int(i) for i in some if gaps[i] < -_NEVER]

    def _choices(self, word: str) -> tuple[bool, list[tuple[int, np.ndarray]]]:
        """The word's N best, and whether all spell it."""
        if word not in self.others:
            if len(self.others) > self.limit:
                self.others.clear()
            found = self.segment(word)
            good = all(self.decoded(ids) == word.encode("utf-8", "surrogatepass") for _, ids in found)
            self.others[word] = good, [(s, np.array(ids, np.int32)) for s, ids in found]
        return self.others[word]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any segmentation: pieces joined, ▁ as spaces, the first space dropped, runs of bytes as UTF-8."""
        return self.decoded(ids).decode("utf-8", "replace").replace(_SPACE, " ")[1:]


class _Numbers(dict):
    """Numbers of the words met so far, and the list of those that are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        i = self[key] = len(self)
        return i


_loaded: dict[tuple[str, int], Pieces] = {}


def loaded(path: str, best: int = BEST) -> Pieces:
    """One lattice for each file and Python worker."""
    if (path, best) not in _loaded:
        _loaded[path, best] = Pieces(path, best)
    return _loaded[path, best]


def encode(docs: DataFrame, model: str, best: int = BEST) -> DataFrame:
    """doc_id, rank (from 0), score (natural log probability) and ids of the `best` best segmentations of every whole text; fewer where there are fewer."""

    def fn(batch: pa.RecordBatch) -> dict:
        lattice = loaded(model, best)
        rows = []
        found = lattice.encode([t or "" for t in batch.column("text").to_pylist()])
        for doc, (_, ways) in zip(batch.column("doc_id").to_pylist(), found, strict=True):
            rows += [(doc, rank, score * UNIT, ids) for rank, (score, ids) in enumerate(ways)]
        return dict(zip(("doc_id", "rank", "score", "ids"), map(list, zip(*rows, strict=True)), strict=True))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """`encoded` with a column text made from its ids; null ids give a null text."""

    others = [c for c in encoded.columns if c != "text"]

    def fn(batch: pa.RecordBatch) -> dict:
        lattice = loaded(model)
        texts = [None if ids is None else lattice.decode(ids) for ids in batch.column("ids").to_pylist()]
        return {c: batch.column(c) for c in others} | {"text": texts}

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "text"]
    return map_batches(encoded, fn, ", ".join([*kept, "text string"]))


def summary(docs: DataFrame, model: str, best: int = BEST) -> DataFrame:
    """One row per document on its `best` best segmentations, without the ids themselves.

    doc_id, n_pieces and ids_crc32 (of little-endian unsigned 32-bit ids) of the best, scores and crcs of all in order, and
    round_trip: whether each decodes to the text (one that holds ▁ doesn't, as ▁ stands for a space). Null and empty texts
    have one segmentation without pieces; repeated rows and null ids are encoded like any other; other columns are not read;
    an empty table gives no rows.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        lattice = loaded(model, best)
        out: dict[str, list] = {k: [] for k in ("n_pieces", "ids_crc32", "scores", "crcs", "round_trip")}
        for good, found in lattice.encode([t or "" for t in batch.column("text").to_pylist()]):
            crcs = [zlib.crc32(ids.astype("<i4", copy=False).tobytes()) for _, ids in found]
            out["n_pieces"].append(len(found[0][1]))
            out["ids_crc32"].append(crcs[0])
            out["scores"].append([s * UNIT for s, _ in found])
            out["crcs"].append(crcs)
            out["round_trip"].append(good)
        return {"doc_id": batch.column("doc_id")} | out

    schema = "doc_id long, n_pieces long, ids_crc32 long, scores array<double>, crcs array<long>, round_trip boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), fn, schema)
