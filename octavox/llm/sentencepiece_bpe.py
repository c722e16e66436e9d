"""SentencePiece encoding and decoding for merge-type vocabularies, in Arrow batches.

A text becomes characters; an agenda of adjacent symbol pairs, ordered by the score of the piece that a pair makes
and then from the left, is worked off until no pair makes a piece. No piece of such a vocabulary holds a word mark
behind another character, so the runs from one word mark to the next have agendas of their own; they are worked off
together, one array row each, and a run met before is looked up by a 64-bit hash, with its length and a second hash to
confirm it. One in CHECKED_SHARE of the runs met for the first time, and one in CHECKED_TEXTS of the whole texts, are
checked against the sentencepiece library in the same Arrow batch; any difference is an error.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, rested, string_array

MARK = "▁"
#: Runs kept per Python worker before the memory of runs is emptied, symbols up to which a run is a row of an array,
#: characters that are cut into runs at a time, and one in how many new runs and texts is checked against the library.
KEPT_RUNS, ROW_SYMBOLS, BATCH_CHARACTERS, CHECKED_SHARE, CHECKED_TEXTS = 400_000, 40, 400_000, 8, 16
#: Ids that are decoded at a time.
DECODED_IDS = 200_000
_KNOWN_BITS, _FACTOR = 20, 0xC2B2AE3D27D4EB4F
_UNKNOWN = 1 << 15  # ids from here on are characters that the vocabulary lacks
#: Spaces, a ligature, a circled digit and controls, which normalisers other than the identity change.
_PROBE = "  A\u00e9 \ufb01\u2460  x\t\n y "
_models: dict[str, "Model"] = {}


class Model:
    """The vocabulary of a model file, with a hashed table of the pairs that make a piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if lib.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK):
            raise ValueError("the model changes characters before it encodes; runs are cut from texts as they are")
        size = lib.get_piece_size()
        special = [lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(size)]
        pieces = [lib.id_to_piece(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(pieces) if not special[i]}
        if size > _UNKNOWN or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("the vocabulary has pieces across words, or too many pieces; runs would not be independent")
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(size):
            if lib.is_byte(i):
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.unknown = lib.unk_id()
        self.byte_fallback = any(lib.is_byte(i) for i in range(size))
        scores = np.array([lib.get_score(i) for i in range(size)])
        order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)  # 0 is the best; ties share a rank
        self.bits = 19
        self.keys, self.made, self.rank = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.full(1 << self.bits, 1 << 30, np.int32)
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    at = self._place(a, b)
                    self.keys[at], self.made[at], self.rank[at] = (a << 21) | b, i, order[i]
        if (self.keys >= 0).mean() > 0.7:
            raise ValueError("the vocabulary has more pairs than the table of pairs is made for")
        surface = []
        for i, p in enumerate(pieces):
            if lib.is_byte(i):
                surface.append(bytes([int(p[3:5], 16)]))
            elif lib.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(b"" if special[i] else p.replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_length = np.array([len(x) for x in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.leading = np.array([not s and p.startswith(MARK) for p, s in zip(pieces, special, strict=True)])
        self.char_ids = np.arange(0x110000, dtype=np.int32) + _UNKNOWN
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        # 1: letters; 2: characters that follow a letter in no piece, so that a run can be cut there
        letters = {c for p in self.ids for c in p if c.isalpha()}
        bound = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[[ord(c) for c in letters]] = 1
        self.kind[[ord(c) for c in ".,;:!?\n" if c not in bound]] = 2
        self.power = self.inverse = np.zeros(0, np.uint64)
        self.forget()

    def _slot(self, key):
        return ((key * np.int64(0x2545F4914F6CDD1D)) >> np.int64(64 - self.bits)) & np.int64((1 << self.bits) - 1)

    def forget(self) -> None:
        self.known_keys, self.known_place = np.zeros(1 << _KNOWN_BITS, np.uint64), np.zeros(1 << _KNOWN_BITS, np.int32)
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.marks = np.zeros(0, np.uint64)

    def rest(self) -> None:
        """Give back what a task gathered: an idle worker holds the vocabulary alone."""
        self.forget()
        self.power = self.inverse = np.zeros(0, np.uint64)

    def _place(self, a: int, b: int) -> int:
        """The slot of one pair, or the free one where it would go."""
        key = (a << 21) | b
        at = (key * 0x2545F4914F6CDD1D & (1 << 64) - 1) >> (64 - self.bits)
        while self.keys[at] != key and self.keys[at] != -1:
            at = (at + 1) & ((1 << self.bits) - 1)
        return at

    def merge(self, a: int, b: int) -> tuple[int, int] | None:
        """Rank and id of the piece that one pair makes, if it makes one."""
        at = self._place(a, b)
        return (int(self.rank[at]), int(self.made[at])) if self.keys[at] != -1 else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; a large rank where it makes none."""
        key = (left.astype(np.int64) << 21) | right
        with np.errstate(over="ignore"):
            at = self._slot(key)
        found = self.keys[at]
        hit = found == key
        rank, made = np.where(hit, self.rank[at], np.int32(1 << 30)), np.where(hit, self.made[at], np.int32(0))
        more = np.nonzero(~hit & (found != -1))
        while len(more[0]):
            at[more] = (at[more] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[more]]
            hit = found == key[more]
            rank[more], made[more] = np.where(hit, self.rank[at[more]], rank[more]), np.where(hit, self.made[at[more]], made[more])
            go = ~hit & (found != -1)
            more = tuple(x[go] for x in more)
        return rank, made

    def characters(self, run: str) -> list[int]:
        return [self.ids.get(c, _UNKNOWN + ord(c)) for c in run]

    def finish(self, symbols) -> list[int]:
        """Ids of the symbols; a character outside the vocabulary becomes its bytes."""
        out: list[int] = []
        for s in symbols:
            if s < _UNKNOWN:
                out.append(int(s))
            elif self.byte_fallback:
                out.extend(self.byte_ids[list(chr(s - _UNKNOWN).encode("utf-8", "surrogatepass"))].tolist())
            else:
                out.append(self.unknown)
        return out

    def bytes_for_unknown(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`finish` for many symbols at once: the ids, and how many each symbol has."""
        count = np.ones(len(symbols), np.int64)
        unknown = symbols >= _UNKNOWN
        if not unknown.any():
            return symbols, count
        kinds, which = np.unique(symbols[unknown], return_inverse=True)
        parts = [self.finish([k]) for k in kinds.tolist()]
        lengths = np.array([len(x) for x in parts])
        count[unknown] = lengths[which]
        out = np.zeros(count.sum(), np.int32)
        at = np.cumsum(count) - count
        out[at[~unknown]] = symbols[~unknown]
        out[ragged(at[unknown], count[unknown])] = np.concatenate([np.array(x, np.int32) for x in parts])[ragged((np.cumsum(lengths) - lengths)[which], lengths[which])]
        return out, count

    def agenda(self, symbols: list[int]) -> list[int]:
        """Work off the agenda of one run: a heap by rank, then place; entries whose symbols changed are skipped."""
        symbols = list(symbols)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        made = (self.merge(*p) for p in zip(symbols, symbols[1:], strict=False))
        heap = [(m[0], i, m[1], symbols[i], symbols[i + 1]) for i, m in enumerate(made) if m]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (m := self.merge(symbols[left], symbols[right])):
                    heapq.heappush(heap, (m[0], left, m[1], symbols[left], symbols[right]))
        return [s for s in symbols if s >= 0]

    def agendas(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many runs of code points, one run after the other, and how many each has.

        Each round pops the best pair of every row, the leftmost among equals, links the row's neighbours anew and
        scores the two pairs that changed. Long runs have a heap of their own.
        """
        order = np.argsort(sizes, kind="stable")
        rows = order[sizes[order] <= ROW_SYMBOLS]
        flats, counts = [], []
        for begin in range(0, len(rows), 8192):
            own = rows[begin : begin + 8192]
            n, width = len(own), int(sizes[own[-1]])
            step = width + 1
            place = starts[own][:, None] + np.arange(step)
            s = np.where(np.arange(step) < sizes[own][:, None], self.char_ids[points[np.minimum(place, len(points) - 1)]], -1)
            rank, made = np.full((n, step), 1 << 30, np.int32), np.zeros((n, step), np.int32)
            rank[:, :-1], made[:, :-1] = self.look_up(s[:, :-1], s[:, 1:])
            after = np.broadcast_to(np.minimum(np.arange(1, step + 1), width), (n, step)).copy()
            before = np.broadcast_to(np.arange(-1, width), (n, step)).copy()
            left = np.arange(n)
            while len(left):
                best = rank[left].argmin(1)
                live = rank[left, best] < 1 << 30
                left, best = left[live], best[live]
                gone = after[left, best]
                follower = after[left, gone]
                s[left, best], s[left, gone] = made[left, best], -1
                after[left, best], before[left, follower] = follower, best
                rank[left, gone] = 1 << 30
                rank[left, best], made[left, best] = self.look_up(s[left, best], s[left, follower])
                earlier = before[left, best]
                ok = earlier >= 0
                l, e = left[ok], earlier[ok]
                rank[l, e], made[l, e] = self.look_up(s[l, e], s[l, best[ok]])
            alive = s >= 0
            ids, n_ids = self.bytes_for_unknown(s[alive])
            flats.append(ids)
            counts.append(np.bincount(np.nonzero(alive)[0], n_ids, n).astype(np.int64))
        for k in order[len(rows) :].tolist():
            flats.append(np.array(self.finish(self.agenda(self.char_ids[points[starts[k] : starts[k] + sizes[k]]].tolist())), np.int32))
            counts.append(np.array([len(flats[-1])]))
        flat, in_turn = np.concatenate(flats), np.concatenate(counts)
        begins, count = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        begins[order], count[order] = np.cumsum(in_turn) - in_turn, in_turn
        return flat[ragged(begins, count)], count

    def check(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        """Encode one in CHECKED_SHARE of the new runs, of every batch, with the library; any difference is an error."""
        own = np.arange(0, len(sizes), CHECKED_SHARE)
        runs = [points[starts[k] : starts[k] + sizes[k]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for k in own.tolist()]
        begins = (np.cumsum(counts) - counts)[own].tolist()
        texts = [r[1:].replace(MARK, " ") if r[0] == MARK else "a" + r for r in runs]
        skip = self.ids[MARK + "a"]
        for r, ids, b, n in zip(runs, self.library.encode(texts, num_threads=1), begins, counts[own].tolist(), strict=True):
            mine = flat[b : b + n].tolist()
            if r != MARK and ids != (mine if r[0] == MARK else [skip, *mine]):
                raise AssertionError(f"the agenda and the sentencepiece library differ on {r!r}")

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of known runs; -1 for new ones."""
        at = (hashes >> np.uint64(64 - _KNOWN_BITS)).astype(np.int64)
        found = self.known_keys[at]
        out = np.where(found == hashes, self.known_place[at].astype(np.int64), -1)
        more = np.flatnonzero((found != hashes) & (found != 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << _KNOWN_BITS) - 1)
            found = self.known_keys[at[more]]
            hit = found == hashes[more]
            out[more[hit]] = self.known_place[at[more[hit]]]
            more = more[~hit & (found != 0)]
        return out

    def add(self, marks: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of runs that are stored but can't be found by their hash."""
        places = len(self.lengths) + np.arange(len(marks))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.lengths, self.flat, self.marks = np.concatenate([self.lengths, counts]), np.concatenate([self.flat, flat]), np.concatenate([self.marks, marks])
        return places

    def keep(self, hashes: np.ndarray, marks: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        places = self.add(marks, flat, counts)
        at, rest = (hashes >> np.uint64(64 - _KNOWN_BITS)).astype(np.int64), np.arange(len(hashes))
        while len(rest):
            free = rest[self.known_keys[at[rest]] == 0]
            self.known_keys[at[free]] = hashes[free]  # of several for one slot, one stays
            got = self.known_keys[at[rest]] == hashes[rest]
            self.known_place[at[rest[got]]] = places[rest[got]]
            rest = rest[~got]
            at[rest] = (at[rest] + 1) & ((1 << _KNOWN_BITS) - 1)
        return places

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points of the texts with word marks, where runs start, and the run at which each text starts."""
        points = np.frombuffer("".join([MARK + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        points[points == 32] = ord(MARK)
        starts = points == ord(MARK)
        starts[1:] &= ~starts[:-1].copy()
        kind = self.kind[points]
        starts[1:] |= (kind[1:] == 2) & (kind[:-1] == 1)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        at = np.cumsum(sizes) - sizes
        starts[at[sizes > 0]] = True
        starts = np.flatnonzero(starts)
        return points, starts, np.searchsorted(starts, np.concatenate([at, [len(points)]]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of each text."""
        out, counts, begin = [np.zeros(0, np.int32)], np.zeros(len(texts) + 1, np.int64), 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (held == 0 or held + len(texts[end]) <= BATCH_CHARACTERS):
                held, end = held + len(texts[end]) + 1, end + 1
            points, starts, first = self.cut(texts[begin:end])
            if len(starts):
                sizes = np.diff(np.append(starts, len(points)))
                hashes, marks = self.hashes(points, starts, sizes)
                which = self.find(hashes)
                if len(missing := np.flatnonzero(which < 0)):
                    if len(self.lengths) + len(missing) > KEPT_RUNS:
                        self.forget()
                        missing = np.arange(len(hashes))
                    new, once, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
                    once = missing[once]
                    flat, n_ids = self.agendas(points, starts[once], sizes[once])
                    self.check(points, starts[once], sizes[once], flat, n_ids)
                    which[missing] = self.keep(new, marks[once], flat, n_ids)[back]
                if len(other := np.flatnonzero(self.marks[which] != marks)):  # a run of another's hash
                    which[other] = self.add(marks[other], *self.agendas(points, starts[other], sizes[other]))
                lengths = self.lengths[which]
                out.append(self.flat[ragged(self.starts[which], lengths)])
                counts[begin + 1 : end + 1] = np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])
            begin = end
        ids, ends = np.concatenate(out), np.cumsum(counts)
        own = range(0, len(texts), CHECKED_TEXTS)
        for k, want in zip(own, self.library.encode([texts[k] for k in own], num_threads=1), strict=True):
            if ids[ends[k] : ends[k + 1]].tolist() != want:
                raise AssertionError(f"the agenda and the sentencepiece library differ on a text that begins {texts[k][:80]!r}")
        return ids, ends

    def hashes(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit polynomial hashes of the runs (never 0), and marks: a second hash, of other numbers for the characters, with the length in it."""
        n = len(points)
        if len(self.power) < n:
            self.power, self.inverse = np.ones(n, np.uint64), np.ones(n, np.uint64)
            self.power[1:], self.inverse[1:] = _FACTOR, pow(_FACTOR, -1, 1 << 64)
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)
        sums, both = np.zeros(n + 1, np.uint64), []
        for number, shift in ((0x9E3779B97F4A7C15, 31), (0xBF58476D1CE4E5B9, 29)):
            v = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(number)
            v ^= v >> np.uint64(shift)
            v *= self.power[:n]
            np.cumsum(v, out=sums[1:])
            both.append((sums[starts + sizes] - sums[starts]) * self.inverse[starts])
        h = both[0]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return np.maximum(h, np.uint64(1)), both[1] * np.uint64(0x94D049BB133111EB) + sizes.astype(np.uint64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of each sequence and their offsets; a word mark that begins a text is no space."""
        lengths = self.surface_length[ids]
        data = self.surface[ragged(self.surface_start[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        some = np.diff(offsets) > 0
        first = ends[:-1][some][self.leading[ids[offsets[:-1][some]]]]
        keep = np.ones(len(data), bool)
        keep[first] = False
        return data[keep], ends - np.searchsorted(first, ends, "left")


def model(path: str) -> Model:
    """One model per worker process and file."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text, without begin and end ids.

    A null or empty text has no ids. Repeated rows each get a row; other columns of `documents` are not read.
    """

    def batches(it):
        m = model(path)
        for rb in it:
            for begin in range(0, rb.num_rows, 512):
                texts = [t or "" for t in rb.column("text").slice(begin, 512).to_pylist()]
                ids, offsets = m.encode(texts)
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(begin, 512), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])
        m.rest()

    return documents.select("doc_id", "text").mapInArrow(rested(batches), "doc_id long, ids array<int>")


def _decoded(m: Model, ids: np.ndarray, offsets: np.ndarray):
    """Slices of the sequences between the offsets: begin, end, and the texts that they decode to."""
    begin, rows = 0, len(offsets) - 1
    while begin < rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + DECODED_IDS, "right")) - 1)
        data, ends = m.decode(ids[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin])
        text = string_array(data, ends)
        try:
            text.validate(full=True)
            text = text.cast(pa.string())
        except pa.ArrowInvalid:  # byte ids that make no UTF-8
            text = pa.array([m.library.decode(ids[offsets[k] : offsets[k + 1]].tolist()) for k in range(begin, end)], pa.string())
        yield begin, end, text
        begin = end


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (the text of the ids; null ids decode to an empty text)."""

    def batches(it):
        m = model(path)
        for rb in it:
            column = rb.column("ids")
            for begin, end, text in _decoded(m, column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)):
                yield pa.RecordBatch.from_arrays([rb.column("doc_id").slice(begin, end - begin), column.slice(begin, end - begin), text], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(rested(batches), "doc_id long, ids array<int>, decoded string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """`decode` of `encode` in one Python stage: a task has one worker with one vocabulary, and no ids cross between two."""

    def batches(it):
        m = model(path)
        for rb in it:
            for start in range(0, rb.num_rows, 512):
                keys = rb.column("doc_id").slice(start, 512)
                ids, offsets = m.encode([t or "" for t in rb.column("text").slice(start, 512).to_pylist()])
                for begin, end, text in _decoded(m, ids, offsets):
                    own = pa.ListArray.from_arrays(pa.array((offsets[begin : end + 1] - offsets[begin]).astype(np.int32)), pa.array(ids[offsets[begin] : offsets[end]]))
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), own, text], ["doc_id", "ids", "decoded"])
        m.rest()

    return documents.select("doc_id", "text").mapInArrow(rested(batches), "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids in decimal joined by commas and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
