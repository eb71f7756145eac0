"""Token counts of whole texts by a finite-state transducer compiled from a sentencepiece BPE vocabulary.

A BPE encoding is told by its neighbouring pieces: a sequence of pieces is the encoding of its text just if each two
neighbours, encoded together, stay as they are. So the last piece of a text's encoding is the one that ends the text and
fits the last piece of what stands before it. A state therefore holds, for every suffix that may still grow into a piece,
the place of that suffix in the trie of pieces, the last piece before it, and how many tokens the text has beyond those
before it; and the last piece of all. This is a finite deterministic transducer: a character leads from a state to the next
one and changes the number of tokens by an amount that stands at the transition (below zero where pieces grow together).
States and transitions are compiled as they are met and kept.

Where no piece holds two neighbouring characters, the state after them does not depend on what came before (a word's
first white space is such a place). So a chunk of text is a map from states to (state, tokens) in a short form: the
characters up to its first such place, and the constant state and number behind it. Maps compose associatively; the
chunks of a long text are mapped in tasks of their own and put together by a parallel prefix scan.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import pieces_of
from trackloom.plans.session import settle

#: Characters of a chunk, and of a text that is still counted in one go.
CHUNK_CHARS = 1 << 15
#: States and words that a worker keeps; beyond it, it forgets them and starts again.
KEEP_STATES, KEEP_WORDS = 250_000, 500_000

SPACE = "▁"
_UNKNOWN = -1
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

#: A state: (trie node, last piece before it, tokens since) for each open suffix, longest first and the empty one last; or (-n,)
#: after a run of white space of n characters, less a multiple of the longest piece.
State = tuple
START: State = ((0, _UNKNOWN, 0),)


class ChunkMap(NamedTuple):
    """What a chunk makes of a state: read ``head`` from it; if ``state`` is set, that is the state then, ``tokens`` later."""

    head: str
    tokens: int
    state: State | None


class _Memory(dict):
    """Tokens of a word that begins with white space, whatever stands before it; words not met for long are forgotten."""

    def __init__(self, transducer: Transducer):
        self.of, self.older = transducer, {}

    def __missing__(self, word: str) -> int:
        found = self.older.get(word)
        if found is None:
            found = self.of.walk(START, word)[1]
        if len(word) <= 64:
            if len(self) >= KEEP_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Transducer:
    """Compiled from the pieces and scores of a sentencepiece BPE model with byte fallback."""

    def __init__(self, model: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model)
        special = (lib.is_control, lib.is_unknown, lib.is_byte, lib.is_unused)
        ids = [i for i in range(lib.get_piece_size()) if not any(f(i) for f in special)]
        self.normalise = lib.normalize
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in ids}
        self.bytes = any(lib.is_byte(i) for i in range(lib.get_piece_size()))
        runs = [p for p in self.score if not p.strip(SPACE)]
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.score):
            raise ValueError("pieces with white space after their first character")
        if max(map(self.score.get, runs)) >= min((x for p, x in self.score.items() if len(p) > 1 and p.strip(SPACE)), default=0):
            raise ValueError("white space that merges before words")
        # tokens of runs of white space: from the longest piece on, one more for each such length
        self.run = max(map(len, runs))
        self.run_tokens = [len(self.merged(SPACE * n)) for n in range(4 * self.run)]
        if any(b != a + 1 for a, b in zip(self.run_tokens, self.run_tokens[self.run :])) or not self.bytes:
            raise ValueError("white space must recur with its longest piece, and unknown characters fall to bytes")
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        # the trie: children by character for each node, and the number of the piece that ends there
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[int] = [_UNKNOWN]
        self.text = [p for p in self.score if len(p) == 1 or p.strip(SPACE)]
        for number, p in enumerate(self.text):
            if len(p) > 1 and self.merged(p) != [p]:
                continue  # never made by merges
            at = 0
            for c in p:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(_UNKNOWN)
                at = self.children[at][c]
            self.piece[at] = number
        self.single = {p: n for n, p in enumerate(self.text) if len(p) == 1}
        self.states: dict[State, dict] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.words = _Memory(self)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the rule itself: the best pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b) for a, b in zip(parts, parts[1:])]
            best = max((s for s in scores if s is not None), default=None)
            if best is None:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, piece: int) -> bool:
        """Whether two pieces stay as they are side by side."""
        if before == _UNKNOWN:
            return True
        key = (before, piece)
        found = self.fit.get(key)
        if found is None:
            if len(self.fit) > 4 * KEEP_STATES:
                self.fit.clear()
            a, b = self.text[before], self.text[piece]
            found = self.fit[key] = a[-1] + b[0] not in self.pairs or self.merged(a + b) == [a, b]
        return found

    def step(self, state: State, c: str) -> tuple[State, int]:
        """The state after one more character, and how many tokens that adds."""
        if c == SPACE:
            n = -state[0] if isinstance(state[0], int) else 0
            to = n % self.run + 1
            return (-to,), self.run_tokens[n + 1] - self.run_tokens[n]
        if isinstance(state[0], int):
            # the last white space may open a piece, which leaves the run without it
            n = -state[0]
            state = ((self.children[0][SPACE], _UNKNOWN, self.run_tokens[n] - self.run_tokens[n - 1]), (0, self.single[SPACE], 0))
        if c not in self.single:
            return START, len(c.encode("utf-8", "replace"))
        last, tokens = None, 0
        grown = []
        for node, before, since in state:
            to = self.children[node].get(c)
            if to is None:
                continue
            grown.append((to, before, since))
            piece = self.piece[to]
            if last is None and piece != _UNKNOWN and self.fits(before, piece):
                last, tokens = piece, 1 - since
        # every character has a piece of its own, so some piece fits
        assert last is not None
        held = [(node, before, since + tokens) for node, before, since in grown if self.children[node]]
        return (*held, (0, last, 0)), tokens

    def walk(self, state: State, text: str) -> tuple[State, int]:
        """The state after a text, character by character, and the tokens added."""
        total, known = 0, self.known(state)
        for c in text:
            found = known.get(c)
            if found is None:
                to, more = self.step(known[""], c)
                found = known[c] = (self.known(to), more)
            known, more = found
            total += more
        return known[""], total

    def known(self, state: State) -> dict:
        """The transitions of a state that are compiled: (those of the next state, tokens) by character, and at '' the state."""
        found = self.states.get(state)
        if found is None:
            if len(self.states) >= KEEP_STATES:
                for transitions in self.states.values():
                    transitions.clear()  # they hold each other
                self.states.clear()
            found = self.states[state] = {"": state}
        return found

    def read(self, state: State, text: str) -> tuple[State, int]:
        """As ``walk``, with whole words between the first and the last one taken from memory."""
        words = _WORDS.findall(text)
        if len(words) < 3:
            return self.walk(state, text)
        state, first = self.walk(state, words[0])
        last_state, last = self.walk(START, words[-1])
        return last_state, first + sum(map(self.words.__getitem__, words[1:-1])) + last

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return sum(self.read(START, part)[1] for part in self.parts(self.normalise(text))) if text else 0

    def parts(self, normal: str) -> Iterator[str]:
        """A normalised text in parts that begin where no piece reaches over, each about a chunk where the text allows it."""
        begin = 0
        while begin < len(normal):
            end = begin + CHUNK_CHARS
            while end < len(normal) and normal[end - 1 : end + 1] in self.pairs:
                end += 1
            yield normal[begin:end]
            begin = end

    def chunk_map(self, chunk: str) -> ChunkMap:
        """What a chunk, which may begin anywhere, makes of the state before it."""
        for i in range(1, len(chunk)):
            if chunk[i - 1 : i + 1] not in self.pairs:
                state, tokens = self.read(START, chunk[i:])
                return ChunkMap(chunk[:i], tokens, state)
        return ChunkMap(chunk, 0, None)

    def then(self, f: ChunkMap, g: ChunkMap) -> ChunkMap:
        """The map of two chunks in a row."""
        if f.state is None:
            return ChunkMap(f.head + g.head, g.tokens, g.state)
        state, more = self.read(f.state, g.head)
        if g.state is None:
            return ChunkMap(f.head, f.tokens + more, state)
        return ChunkMap(f.head, f.tokens + more + g.tokens, g.state)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """The maps of all prefixes of a row of chunks: neighbours are put together, scanned, and the places between filled in."""
        if len(maps) < 2:
            return list(maps)
        halves = self.scan([self.then(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(halves[i // 2] if i % 2 else self.then(halves[i // 2 - 1], maps[i]))
        return out

    def tokens(self, f: ChunkMap) -> int:
        """Tokens of a text whose chunks make ``f``."""
        return self.read(START, f.head)[1] + f.tokens


@lru_cache(maxsize=2)
def transducer(model: str) -> Transducer:
    return Transducer(model)


def _flat(state: State | None) -> list[int] | None:
    if state is None:
        return None
    return [x for part in state for x in (part if isinstance(part, tuple) else (part,))]


def _state(flat: list[int] | None) -> State | None:
    if flat is None:
        return None
    return (int(flat[0]),) if len(flat) == 1 else tuple(tuple(int(x) for x in flat[i : i + 3]) for i in range(0, len(flat), 3))


def _whole(docs: DataFrame, doc_id: str, text: str, model: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, uid, chunks): short texts counted, long ones normalised and cut, with an id of their own."""
    kind = docs.select(F.col(doc_id).alias("doc_id")).schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer(model)
        for batch in batches:
            for part, texts in pieces_of(batch, "text"):
                counts, uids, cut = [], [], []
                for t in texts:
                    long = len(t) > CHUNK_CHARS
                    counts.append(None if long else made.count(t))
                    uids.append(uuid.uuid4().hex if long else None)
                    normal = made.normalise(t) if long else ""
                    cut.append([normal[i : i + CHUNK_CHARS] for i in range(0, len(normal), CHUNK_CHARS)] if long else None)
                columns = [part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(uids, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(cut, pa.list_(pa.string()))], names=["doc_id", "n_bytes", "n_tokens", "uid", "chunks"]
                )

    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.octet_length(whole).cast("bigint").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, uid string, chunks array<string>")


def _maps(chunks: DataFrame, model: str) -> DataFrame:
    """(uid, no, head, tokens, state) of chunks (uid, no, chunk), each where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = transducer(model)
        for batch in batches:
            maps = [made.chunk_map(c.as_py()) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([m.head for m in maps], pa.string()), pa.array([m.tokens for m in maps], pa.int64()),
                    pa.array([_flat(m.state) for m in maps], pa.list_(pa.int64())),
                ],
                names=["uid", "no", "head", "tokens", "state"],
            )

    return chunks.mapInArrow(run, "uid string, no int, head string, tokens bigint, state array<bigint>")


def chunk_ends(maps: DataFrame, model: str) -> DataFrame:
    """(uid, no, upto): tokens of a long text up to the end of each chunk, as if it ended there; by a prefix scan of its maps.

    A text that a row can hold has at most 65,536 chunks, and a map is some hundred bytes unless no place in the chunk is
    free of pieces, when it holds the chunk itself; so a group is never larger than the row that the text came from.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = transducer(model)
        group = group.sort_values("no")
        some = zip(group["head"], group["tokens"], group["state"], strict=True)
        upto = [made.tokens(f) for f in made.scan([ChunkMap(h, int(n), _state(s)) for h, n, s in some])]
        return pd.DataFrame({"uid": group["uid"], "no": group["no"], "upto": upto})

    return maps.groupBy("uid").applyInPandas(run, "uid string, no int, upto bigint")


def count_tokens(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens as the sentencepiece model gives them.

    No begin or end token is added; control strings inside texts are ordinary text, as the library takes them. Null text is
    empty and has 0 tokens. Ids may be null or repeat and have any type: rows are counted each for itself. An empty table
    gives an empty result; other columns are not read. Texts are counted whole; those of more than CHUNK_CHARS characters are
    dealt out in chunks, so one very long text takes many tasks.
    """
    rows = settle(_whole(docs, doc_id, text, model), "token-counts")
    long = rows.where("uid is not null")
    chunks = long.select("uid", F.posexplode("chunks").alias("no", "chunk")).repartition("uid", "no")
    ends = chunk_ends(_maps(chunks, model), model)
    counts = ends.groupBy("uid").agg(F.max_by("upto", "no").alias("n_tokens"))
    whole = long.drop("n_tokens", "chunks").join(counts, "uid").select("doc_id", "n_bytes", "n_tokens")
    return rows.where("uid is null").select("doc_id", "n_bytes", "n_tokens").unionByName(whole)
