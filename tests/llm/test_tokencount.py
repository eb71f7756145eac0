"""Token counts against the library, chunk maps against whole texts."""

import os
import random

import public_tokenizers
import pytest
import sentencepiece

from trackloom.llm import queries, tokencount

from .conftest import AWKWARD

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n, seed):
    """Random texts of pieces, of few letters, of runs of white space and of characters that have no piece."""
    rng = random.Random(seed)
    pieces = list(tokencount.transducer(MODEL).score)
    for i in range(n):
        kind = i % 5
        if kind == 0:
            yield "".join(rng.choice("abcdehilnorst  \n中文é1230..<s></s><unk>▁\t") for _ in range(rng.randint(0, 40)))
        elif kind == 1:
            yield "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        elif kind == 2:
            yield "".join(rng.choice("abet") for _ in range(rng.randint(1, 80)))
        elif kind == 3:
            yield "".join(rng.choice(["", "the", "x", "中", "<s>", "\x00", "\U0001f600"]) + " " * rng.randint(0, 50) for _ in range(4))
        else:
            yield "".join(rng.choice(pieces).lstrip("▁") for _ in range(rng.randint(1, 8)))


def test_counts_are_the_librarys(library):
    made = tokencount.transducer(MODEL)
    wrong = [t for t in texts(20_000, 1) if made.count(t) != len(library.encode(t))]
    assert not wrong


def test_forgetful_transducer(library, monkeypatch):
    """Compiled states may be forgotten at any time."""
    monkeypatch.setattr(tokencount, "KEEP_STATES", 7)
    monkeypatch.setattr(tokencount, "KEEP_WORDS", 4)
    made = tokencount.Transducer(MODEL)
    assert all(made.count(t) == len(library.encode(t)) for t in texts(600, 2))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_maps_of_chunks_compose(library, size):
    made = tokencount.transducer(MODEL)
    for t in texts(400, size):
        normal = made.normalise(t)
        chunks = [normal[i : i + size] for i in range(0, len(normal), size)]
        maps = [made.chunk_map(c) for c in chunks]
        ends = made.scan(maps)
        assert [made.tokens(f) for f in ends] == [made.walk(tokencount.START, normal[: (i + 1) * size])[1] for i in range(len(chunks))]
        if len(maps) > 2:
            left = made.then(made.then(maps[0], maps[1]), maps[2])
            assert left == made.then(maps[0], made.then(maps[1], maps[2])) and made.tokens(left) == made.tokens(ends[2])
        assert not t or made.tokens(ends[-1]) == len(library.encode(t))


def test_states_can_be_written(library):
    made = tokencount.transducer(MODEL)
    for t in texts(300, 9):
        state = made.walk(tokencount.START, made.normalise(t))[0]
        assert tokencount._state(tokencount._flat(state)) == state


@pytest.mark.parametrize("chunk", [1 << 15, 64])
def test_awkward_rows(docs, library, monkeypatch, chunk):
    """Null, empty and long texts, repeated and null ids; a small chunk deals most texts out."""
    monkeypatch.setattr(tokencount, "CHUNK_CHARS", chunk)
    rows = [*AWKWARD, (20, "中文" * 30_000), (21, "ab" * 40_000), (22, "<s>" * 50)]
    got = sorted((tuple(r) for r in tokencount.count_tokens(docs(rows), MODEL).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t)) if t else 0) for i, t in rows]
    assert got == sorted(want, key=str)


def test_nothing(docs):
    assert tokencount.count_tokens(docs([]), MODEL).collect() == []


def test_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert sorted(tuple(r) for r in queries.op11_token_count(spark, SF).collect()) == sorted(want)
