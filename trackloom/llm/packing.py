"""Packing of token sequences: Martello-Toth dominance reduction, then best fit, on the histogram of lengths.

Lengths are whole numbers up to the capacity, so however many documents there are, the plan is made from ``capacity`` counts
at most: sets that provably dominate all alternatives are fixed for all copies at once, and the rest goes by best fit,
longest first, also in runs of equal lengths. The plan says, for ranks of pieces of a length, in which sequence and where they
lie. Ranks are counted in each partition and added up by a window over (partition, length) counts; no task sees
all pieces of a length.
"""

from __future__ import annotations

import gc
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trackloom.llm.common import PIECE_CHARS, pieces_of, release_memory
from trackloom.plans.session import settle

CAPACITY = 2048
#: Most bytes that the vocabulary may have, as it is sent to every worker.
VOCABULARY_BYTES = 64 << 20
#: Words that a worker remembers the ids of, and the longest that it remembers.
REMEMBERED, REMEMBERED_CHARS = 600_000, 64
#: Characters of a long text whose words are held at once.
PART_CHARS = 250_000
# White space of which not all engines agree that it is, or that does not stand alone.
_WILD = (
    "  ", "\n\n", " \n", "\n ", *"\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007",
    *"\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000",
)
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Words that are encoded at once.
_LINE = 200


class WordTokenizer:
    """Ids of texts by the ``tokenizers`` library, a word with the white space before it at a time.

    Byte-level BPE splits a text before it merges, and never from other characters into white space; so the ids of a text
    are those of such words in turn, and the ids of a word can be remembered. New words are encoded many to a line: a line
    feed between words that hold none is a token of its own, at which the ids are divided again.
    """

    def __init__(self, vocabulary: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_str(vocabulary), remembered
        # strings of special tokens inside a text are those tokens, as the library has it; such a text is not divided
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.stops = dict(zip(".,", self._encoded([".", ","]), strict=True))

    def _encoded(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of words, which are without the one space before them unless they begin with a line feed.

        A full stop or comma after a letter is split off a word before its merges, so such words are learned without it.
        """
        known = self.known
        ended = [w for w in words if w[-1:] in self.stops and w[-2:-1] in _LETTERS]
        if ended:
            bare = {w[:-1] for w in ended}
            words = [w for w in {*words, *bare}.difference(ended) if w not in known]
        plain = [w for w in words if "\n" not in w and w] if self.feed is not None else []
        rest = [w for w in words if "\n" in w or not w] if plain else words
        known.update(zip(rest, self._encoded([w if w[:1] == "\n" else " " + w for w in rest]), strict=True))
        lines = [plain[i : i + _LINE] for i in range(0, len(plain), _LINE)]
        for line, ids in zip(lines, self._encoded([" " + "\n ".join(x) for x in lines]), strict=True):
            ends = (np.flatnonzero(np.frombuffer(ids, "<u4") == self.feed) * 4).tolist()
            known.update((w, ids[a:b]) for w, a, b in zip(line, [0, *[x + 4 for x in ends]], [*ends, len(ids)], strict=True))
        known.update((w, known[w[:-1]] + self.stops[w[-1]]) for w in ended)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; of a long text, only the words of one part of it are held at once."""
        found = self._ids([t if len(t) <= PART_CHARS else "" for t in texts])
        for i, t in enumerate(texts):
            if len(t) > PART_CHARS:
                found[i] = b"".join(self._ids([part])[0] for part in self._parts(t))
        return found

    def _tame(self, text: str) -> bool:
        return not any(x in text for x in (*_WILD, *self.special))

    def _parts(self, text: str) -> Iterator[str]:
        """The text cut before spaces, at which words begin, about every PART_CHARS characters; one that is not divided, whole."""
        start = 0
        while start < len(text):
            end = text.find(" ", start + PART_CHARS) if start or self._tame(text) else -1
            end = len(text) if end < 0 else end
            yield text[start:end]
            start = end

    def _ids(self, texts: list[str]) -> list[bytes]:
        # words are divided at single spaces and line feeds; a text with other white space, or more of it, is one word
        tame = [self._tame(t) for t in texts]
        words = [t.replace("\n", " \n").split(" ") if ok else None for t, ok in zip(texts, tame, strict=True)]
        known, get = self.known, self.known.get
        heads = self._encoded([text[0] if text else t for text, t in zip(words, texts, strict=True)])
        # one look at the memory for each word; those that it does not have are learned together and put in place
        found = [list(map(get, text[1:])) if text else [] for text in words]
        gaps = [[i for i, x in enumerate(row) if x is None] if None in row else () for row in found]
        new = {text[i + 1] for text, at in zip(words, gaps, strict=True) for i in at}
        if new:
            met = {w: self.older[w] for w in new if w in self.older}
            known.update(met)
            self._learn([w for w in new if w not in met])
        for text, row, at in zip(words, found, gaps, strict=True):
            for i in at:
                row[i] = known[text[i + 1]]
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del known[w]
        if len(known) > self.remembered // 2:
            self.known, self.older = {}, known  # words not met again until the next such turn are forgotten
        return [head + b"".join(row) for head, row in zip(heads, found, strict=True)]


@lru_cache(2)
def _tokenizer(vocabulary: str, remembered: int) -> WordTokenizer:
    return WordTokenizer(vocabulary, remembered)


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        data = file.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} characters")
    return data


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all of ``capacity`` but the first, which takes what is over."""
    first = length % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, length, capacity)]]


def token_pieces(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    separator: int = 0,
    remembered: int = REMEMBERED,
    held_chars: int = PIECE_CHARS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): the pieces of every document.

    A document is the ids of its whole text, then ``separator``; null text is empty and so one id. part is the partition that
    made a piece, and rank counts the pieces of its length there, both the same whenever the partition is made again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = np.array([separator], "<u4").tobytes()

    def run(batches):
        tokenizer, seen, part = _tokenizer(sent.value, remembered), Counter(), TaskContext.get().partitionId()
        gc.disable()  # millions of words that are in no cycle, and that the collector would walk again and again
        try:
            for batch in batches:
                for piece_batch, texts in pieces_of(batch, "text", held_chars):
                    rows = []
                    for key, found in zip(piece_batch.column(0).to_pylist(), tokenizer.ids(texts), strict=True):
                        found += end
                        for piece, (start, length) in enumerate(cut(len(found) // 4, capacity)):
                            crc = zlib.crc32(found[4 * start : 4 * (start + length)])
                            rows.append((key, piece, start, length, crc, part, seen[length]))
                            seen[length] += 1
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            gc.enable()
            release_memory()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = {"doc_id": None, "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "part": pa.int32(), "rank": pa.int64()}
    names, id_type = list(kinds), rows.schema["doc_id"].dataType
    types = [to_arrow_type(id_type), *list(kinds.values())[1:]]
    schema = f"doc_id {id_type.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    return rows.mapInArrow(run, schema)


@dataclass
class Bins:
    """So many sequences that all hold the same: (length, copies) in order."""

    content: tuple[tuple[int, int], ...]
    count: int


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Bins], dict[int, int]]:
    """Fixes sets of at most three pieces that dominate every other set holding their longest piece (Martello and Toth).

    counts: number of pieces by length. Returns the fixed sequences and what is left. With c the room beside the longest
    piece j, looked at from the longest down:
    - nothing fits: j alone;
    - a piece of exactly c exists, or no two others fit together: j with the longest that fits, k;
    - no three others fit: j with k if k is at least as long as the best fitting pair; else j with that pair (a, b), if a is
      as long as k and no two pieces longer than b fit.
    Any sequence that holds j can be exchanged for the fixed one without needing more sequences.
    """
    left = {n: m for n, m in counts.items() if m > 0}
    fixed: list[Bins] = []
    again = True
    while again:
        again = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                chosen = _dominating(left, j, capacity)
                if chosen is None:
                    break
                need = Counter(chosen)
                times = min(left[n] // m for n, m in need.items())
                # taking pieces away leaves fewer alternatives, so the proof holds until one of these lengths is used up
                for n, m in need.items():
                    left[n] -= m * times
                    if not left[n]:
                        del left[n]
                fixed.append(Bins(tuple(sorted(need.items(), reverse=True)), times))
                again = True
    return fixed, left


def _smallest(left: dict[int, int], sizes: list[int], without: Counter, n: int, above: int = 0) -> list[int]:
    """The n shortest pieces longer than ``above``, besides those in ``without``."""
    found: list[int] = []
    for size in sizes[bisect_left(sizes, above + 1) :]:
        found += [size] * min(n - len(found), left[size] - without[size])
        if len(found) >= n:
            break
    return found


def _dominating(left: dict[int, int], j: int, capacity: int) -> list[int] | None:
    room, own, sizes = capacity - j, Counter([j]), sorted(left)
    low = _smallest(left, sizes, own, 3)
    if not low or low[0] > room:
        return [j]
    fitting = [s for s in sizes if s <= room and left[s] > own[s]]
    longest = fitting[-1]
    if longest == room or len(low) < 2 or low[0] + low[1] > room:
        return [j, longest]
    if len(low) == 3 and sum(low) <= room:
        return None
    best, pair = 0, None
    for a in reversed(fitting):
        used = own + Counter([a])
        at = bisect_left(fitting, min(a, room - a) + 1) - 1
        while at >= 0 and left[fitting[at]] <= used[fitting[at]]:
            at -= 1
        if at >= 0 and a + fitting[at] > best:
            best, pair = a + fitting[at], (a, fitting[at])
        if 2 * a < best:
            break
    if pair is None or longest >= best:
        return [j, longest]
    if pair[0] == longest:
        longer = _smallest(left, sizes, own, 2, pair[1])
        if len(longer) < 2 or sum(longer) > room:
            return [j, *pair]
    return None


def best_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """Longest first, each piece into the fullest sequence that has room for it; runs of equal lengths at once."""
    open_bins: dict[int, list[Bins]] = {}
    rooms: list[int] = []

    def put(room: int, bins: Bins) -> None:
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append(bins)

    for size in sorted(counts, reverse=True):
        todo = counts[size]
        while todo:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room, bins = capacity, Bins((), -(-todo // (capacity // size)))
            each = room // size
            full = min(bins.count, todo // each)
            if full:
                put(room - each * size, Bins((*bins.content, (size, each)), full))
                todo -= full * each
            over = bins.count - full
            if over and todo:
                put(room - todo * size, Bins((*bins.content, (size, todo)), 1))
                over, todo = over - 1, 0
            if over:
                put(room, Bins(bins.content, over))
    return [b for same in open_bins.values() for b in same if b.content]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """The sequences for so many pieces of each length: dominance reduction, then best fit of what is left."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def runs_of(bins: list[Bins]) -> pd.DataFrame:
    """The plan by pieces: from rank ``first`` on, pieces of a length lie ``each`` to a sequence, from ``sequence`` on, the
    first of them at ``offset``."""
    rows, used, sequence = [], Counter(), 0
    for b in bins:
        offset = 0
        for size, each in b.content:
            rows.append((size, used[size], each, sequence, offset))
            used[size] += each * b.count
            offset += size * each
        sequence += b.count
    return pd.DataFrame(rows, columns=["length", "first", "each", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    separator: int = 0,
    remembered: int = REMEMBERED,
    held_chars: int = PIECE_CHARS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every token of every document is in one piece, every piece in one sequence of at most ``capacity`` tokens, whose pieces
    follow each other from offset 0 without a gap. Only documents longer than that are cut; the first piece takes what is
    over. Null and empty texts are one piece of the separator alone; rows that repeat an id are packed each. An empty table
    gives an empty result; other columns are not read. A worker remembers the ids of up to ``remembered`` words and
    holds the words of about ``held_chars`` characters at once: less of either needs less memory and more time, the result is the same.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    # where little is to be held at once, the batches are as small
    batch_bytes = 4 * held_chars if held_chars < PIECE_CHARS else 0
    pieces = token_pieces(docs, vocabulary, doc_id, text, capacity, separator, remembered, held_chars)
    pieces = settle(pieces, "pieces", batch_bytes=batch_bytes)
    by_part = settle(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs = runs_of(plan(counts, capacity))
    keys = (runs["length"].to_numpy(np.int64) << 44) + runs["first"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((keys, *[runs[c].to_numpy(np.int64) for c in ("first", "each", "sequence", "offset")]))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, first, each, sequence, offset = sent.value
        size, number = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(starts, (size << 44) + number, side="right") - 1
        nth = number - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + nth // each[at], "offset": offset[at] + nth % each[at] * size})

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("_at", place("length", F.col("_before") + F.col("rank")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
