"""Alignment of two tokenisations of the same texts: byte-level merges (A) and pieces with word marks (B).

Both tokenise whole texts. Their token bytes are laid end to end and compared with the text; byte offsets where tokens of
both end are shared ends, which cut a text into groups. A shared end before tokens that both begin with a space, and the
end of a text, are anchors: they cut it into windows of A ids and B ids. A window's groups and links depend on its ids
alone, so they are kept by the id tuples: a batch's windows are looked up by a hash, the ids of every hit are compared
with those it is kept under, and new windows are aligned once.

Links (an A token and a B token that end together) are counted over the corpus in two steps: each task sums its own, Spark
sums the tasks'. A second pass over the written table of each text's different links joins the counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sentencepiece_bpe
from .common import counted, ensure_checkpoint_dir, ragged, rested

#: Fixed value: how a byte-level vocabulary's texts are split before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of text that are aligned at a time, windows kept in a worker, ids of the longest window that is kept, links a
#: task sums before it hands them on, links in a row of sums, and one in how many texts is checked against the library.
BATCH_BYTES, KEPT_WINDOWS, KEPT_IDS, SUMMED_LINKS, ROW_LINKS, CHECKED_TEXTS = 1_000_000, 300_000, 64, 1_000_000, 50_000, 64
#: Different links up to which their counts are broadcast (a code, a count and a flag each); beyond it the join shuffles.
BROADCAST_LINKS = 2_000_000
_aligners: dict[tuple[str, str], "Aligner"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level vocabulary file: its entries' bytes and an encoder, held against the tokenizers library."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters = byte_letters()
        vocabulary, special = held["model"]["vocab"], {t["content"] for t in held.get("added_tokens", []) if t["special"]}
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in held["model"]["merges"]]
        if [vocabulary[m] for m in joined] != list(range(256, 256 + len(joined))):
            raise ValueError("ids do not follow the order of the merges")
        plain = {t: i for t, i in vocabulary.items() if t not in special}
        ranks = {bytes(letters[c] for c in t): i for t, i in plain.items()}
        self.encoder = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.size = max(vocabulary.values()) + 1
        entries = [b""] * self.size
        for t, i in ranks.items():
            entries[i] = t
        self.surface, self.length = np.frombuffer(b"".join(entries), np.uint8), np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.space = np.array([x[:1] == b" " for x in entries])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.encoder.encode_to_numpy(t) for t in texts]
        for k in range(0, len(texts), CHECKED_TEXTS):
            if parts[k].tolist() != self.library.encode(texts[k], add_special_tokens=False).ids:
                raise AssertionError(f"the encoder and the tokenizers library differ on a text that begins {texts[k][:80]!r}")
        return np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32), np.cumsum([0, *map(len, parts)])


def _kept(ids: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets of the texts to keep."""
    if keep.all():
        return ids, offsets
    sizes = np.diff(offsets)
    return ids[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[keep])])


class Aligner:
    """Both vocabularies and the windows kept."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), sentencepiece_bpe.model(path_b)
        self.size_b = self.b.library.get_piece_size()
        if self.a.size * self.size_b >= 1 << 31:
            raise ValueError("the vocabularies have too many pairs of ids for the codes of links")
        self.space_b = np.array([self.b.surface_length[i] > 0 and self.b.surface[self.b.surface_start[i]] == 32 for i in range(self.size_b)])
        rng = np.random.default_rng(20)
        self.factor = [rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (self.a.size, self.size_b)]
        self.names = max(self.a.size, self.size_b)
        names = [f"{mark}{i}".encode() for mark in ",;|" for i in range(self.names)]  # an id behind each separator
        self.name, self.name_size = np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names], np.int64)
        self.name_start = np.cumsum(self.name_size) - self.name_size
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.texts: list[bytes] = []
        none = np.zeros(0, np.int64)
        self.flat = [np.zeros(0, np.int32) for _ in range(3)]  # A ids, B ids and link codes of the kept windows
        self.start, self.size = [none] * 3, [none] * 3

    def rest(self) -> None:
        self.forget()
        self.b.rest()

    def hashes(self, ids: list[np.ndarray], starts: list[np.ndarray], sizes: list[np.ndarray]) -> np.ndarray:
        """A 64-bit hash of the id tuples of each window."""
        out = sizes[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + sizes[1].astype(np.uint64)
        for k in range(2):
            turn = (np.arange(len(ids[k])) - np.repeat(starts[k], sizes[k])).astype(np.uint64)
            v = self.factor[k][ids[k]] * (turn * np.uint64(0xC2B2AE3D27D4EB4E) + np.uint64(1))
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + (np.add.reduceat(v, starts[k]) if len(v) else np.uint64(0))
        return out

    def add(self, new: np.ndarray, ids, starts, sizes, ends, first) -> np.ndarray:
        """Align the windows `new` from their shared ends (first[w] is a window's first) and keep them; their places.

        A group's A ids and then its B ids are laid in turn, each as its decimal digits behind a separator.
        """
        n_groups = np.diff(first)[new]
        groups = ragged(first[new], n_groups)
        a, b = (ids[k][ragged(starts[k][new], sizes[k][new])] for k in range(2))
        in_a, in_b = (np.diff(np.concatenate([[0], e + 1]))[groups] for e in ends)
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        turn_a, turn_b = np.arange(len(a)) + np.repeat(before_b, in_a), np.arange(len(b)) + np.repeat(before_a + in_a, in_b)
        named = np.empty(len(a) + len(b), np.int64)
        named[turn_a], named[turn_b] = a, b
        named[turn_a[before_a]] += self.names
        named[turn_b[before_b]] += 2 * self.names
        width = self.name_size[named]
        data = self.name[ragged(self.name_start[named], width)].tobytes()
        stop = np.cumsum(width)[np.cumsum((sizes[0] + sizes[1])[new]) - 1].tolist()
        place = len(self.texts) + np.arange(len(new))
        self.texts.extend(data[x:y] for x, y in zip([0, *stop], stop, strict=False))
        codes = a[before_a + in_a - 1] * np.int32(self.size_b) + b[before_b + in_b - 1]  # within an int, as checked above
        for k, (part, size) in enumerate([(a, sizes[0][new]), (b, sizes[1][new]), (codes, n_groups)]):
            self.start[k] = np.concatenate([self.start[k], len(self.flat[k]) + np.cumsum(size) - size])
            self.size[k], self.flat[k] = np.concatenate([self.size[k], size]), np.concatenate([self.flat[k], part])
        return place

    def look_up(self, ids, starts, sizes, ends, first) -> np.ndarray:
        """The place of every window, new ones aligned first."""
        hashed, once, back = np.unique(self.hashes(ids, starts, sizes), return_index=True, return_inverse=True)
        if len(self.texts) > KEPT_WINDOWS:
            self.forget()
        keys = hashed.tolist()
        place = np.array([self.place.get(h, -1) for h in keys], np.int64)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            place[missing] = self.add(once[missing], ids, starts, sizes, ends, first)
        short = missing[(sizes[0] + sizes[1])[once[missing]] <= KEPT_IDS]
        self.place.update(zip(hashed[short].tolist(), place[short].tolist(), strict=True))
        place = place[back]
        other = np.zeros(len(place), bool)  # windows of another's hash: their ids differ from those kept
        for k in range(2):
            other |= self.size[k][place] != sizes[k]
        for k in range(2):
            same = np.flatnonzero(~other)
            differ = self.flat[k][ragged(self.start[k][place[same]], sizes[k][same])] != ids[k][ragged(starts[k][same], sizes[k][same])]
            if differ.any():
                other[same[np.repeat(np.arange(len(same)), sizes[k][same])[differ]]] = True
        if other.any():
            own = np.flatnonzero(other)
            place[own] = self.add(own, ids, starts, sizes, ends, first)
        return place

    def align(self, texts: list[str]):
        """Per text: A tokens, B tokens, groups, the joined groups; and the codes of all links with their offsets."""
        n = len(texts)
        spaced = [" " + t if t else "" for t in texts]
        want = np.frombuffer("".join(spaced).encode(), np.uint8)
        width = np.array([len(t.encode()) for t in spaced], np.int64)
        a, off_a = self.a.encode(spaced)
        b, off_b = self.b.encode(texts)
        ends = [np.concatenate([[0], np.cumsum(length[i])]) for length, i in ((self.a.length, a), (self.b.surface_length, b))]
        keep = (width > 0) & (np.diff(ends[0][off_a]) == width) & (np.diff(ends[1][off_b]) == width)
        for surface, start, length, i, off in ((self.a.surface, self.a.start, self.a.length, a, off_a), (self.b.surface, self.b.surface_start, self.b.surface_length, b, off_b)):
            i, _ = _kept(i, off, keep)
            differ = surface[ragged(start[i], length[i])] != want[np.repeat(keep, width)]
            if differ.any():
                held = np.flatnonzero(keep)
                keep[held[np.repeat(np.arange(len(held)), width[held])[differ]]] = False
        a, off_a = _kept(a, off_a, keep)
        b, off_b = _kept(b, off_b, keep)
        counts, joined = np.zeros((3, n), np.int64), [b""] * n
        held = np.flatnonzero(keep)
        if not len(held):
            return counts, joined, np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        to_a, to_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.surface_length[b])
        both = np.zeros(to_a[-1] + 1, np.uint8)
        both[to_a] += 1
        both[to_b] += 2
        ends_a, ends_b = np.flatnonzero(both[to_a] == 3), np.flatnonzero(both[to_b] == 3)
        last = np.zeros(len(a) + 1, bool)
        last[off_a[1:] - 1] = True
        anchor = last[ends_a] | (self.a.space[np.append(a, 0)[ends_a + 1]] & self.space_b[np.append(b, 0)[ends_b + 1]])
        at = np.flatnonzero(anchor)
        first = np.concatenate([[0], at + 1])
        stop = [ends_a[at] + 1, ends_b[at] + 1]
        starts = [np.concatenate([[0], s[:-1]]) for s in stop]
        place = self.look_up([a, b], starts, [s - t for s, t in zip(stop, starts, strict=True)], [ends_a, ends_b], first)
        window = np.searchsorted(stop[0], off_a)
        window[1:] += 1  # windows end with their text
        window[0] = 0
        pieces = [self.texts[p] for p in place.tolist()]
        for k, x, y in zip(held.tolist(), window[:-1].tolist(), window[1:].tolist(), strict=True):
            joined[k] = b"".join(pieces[x:y])[1:]
        links = np.concatenate([[0], np.cumsum(self.size[2][place])])[window]
        counts[0, held], counts[1, held], counts[2, held] = np.diff(off_a), np.diff(off_b), np.diff(links)
        return counts, joined, self.flat[2][ragged(self.start[2][place], self.size[2][place])], np.concatenate([[0], np.cumsum(counts[2])])


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<int>, times array<long>"


def align(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds. Per document: counts of tokens, groups and links, the digest of the groups and its different links with how often.

    Rows whose `row` is null hold sums of links that a task met. `documents` has doc_id and text; other columns are not read.
    """

    def batches(it):
        m, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 33
        codes, times = np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            every = np.concatenate([codes, *[p[0] for p in parts]]), np.concatenate([times, *[p[1] for p in parts]])
            parts.clear()
            found, back = np.unique(every[0], return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, back, every[1])
            return found, total

        def lists(flat, offsets, kind):
            return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(kind)))

        def sums(codes, times):
            for k in range(0, len(codes), ROW_LINKS):
                own = slice(k, k + ROW_LINKS)
                ends = np.array([0, len(codes[own])])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string()), lists(codes[own], ends, np.int32), lists(times[own], ends, np.int64)], names)

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for rb in it:
            keys, column, begin = rb.column("doc_id"), rb.column("text").to_pylist(), 0
            while begin < len(column):
                end, held = begin, 0
                while end < len(column) and (end == begin or held + len(column[end] or "") <= BATCH_BYTES):
                    held, end = held + len(column[end] or ""), end + 1
                counts, joined, flat, offsets = m.align([t or "" for t in column[begin:end]])
                every, n = np.unique((np.repeat(np.arange(end - begin), np.diff(offsets)) << 32) | flat, return_counts=True)
                own, ends = (every & 0xFFFFFFFF).astype(np.int32), np.searchsorted(every >> 32, np.arange(end - begin + 1))
                digest = [hashlib.sha256(t).hexdigest() if t else "" for t in joined]
                yield pa.RecordBatch.from_arrays([pa.array(number + np.arange(end - begin)), keys.slice(begin, end - begin), *[pa.array(c) for c in counts], pa.array(counts[2]), pa.array(digest), lists(own, ends, np.int32), lists(n, ends, np.int64)], names)
                number += end - begin
                parts.append((own, n))
                if sum(len(p[0]) for p in parts) > SUMMED_LINKS:
                    codes, times = summed()
                    if len(codes) > SUMMED_LINKS:
                        yield from sums(codes, times)
                        codes, times = codes[:0], times[:0]
                begin = end
        yield from sums(*summed())
        m.rest()

    return documents.select("doc_id", "text").mapInArrow(rested(batches), SCHEMA)


def statistics(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of `documents`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best are the links whose id pair is linked, over the corpus, as often as any pair of its B id (ties included);
    count_sum sums over the links how often their pair is linked over the corpus. Null and empty texts, and texts that the
    tokens' bytes don't give back, have zeros and an empty digest. Repeated rows each count. A row without an id gets one too.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/alignment-{uuid.uuid4().hex}"
    align(documents, path_a, path_b).write.parquet(folder)
    table = spark.read.schema(SCHEMA).parquet(folder)
    size_b = F.lit(aligner(path_a, path_b).size_b)
    linked = lambda t: F.inline(F.arrays_zip("codes", "times")) if t else F.inline_outer(F.arrays_zip("codes", "times"))
    totals, _ = counted(table.where("row is null").select(linked(True)).groupBy("codes").agg(F.sum("times").alias("total")))
    highest = totals.groupBy((F.col("codes") % size_b).alias("b")).agg(F.max("total").alias("highest"))  # at most a row for each B id
    totals, n = counted(totals.withColumn("b", F.col("codes") % size_b).join(F.broadcast(highest), "b").select("codes", "total", (F.col("total") == F.col("highest")).alias("best")))
    keys = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = table.where("row is not null").select(*keys, linked(False))
    links = links.join(F.broadcast(totals) if n <= BROADCAST_LINKS else totals, "codes", "left")
    summed = links.groupBy(*keys).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("total")), F.lit(0)).alias("count_sum"))
    return summed.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
