"""Tokens, packing and chat formatting against the libraries themselves, round trips and brute force."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackloom.llm import bpe, chat, packing, queries

from .conftest import AWKWARD

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b\n\n c\t\t d   ", "don't we'll I'M 'S", "x  y z ", "tab\tnew\x0b\x0cff\x1c\x1d x\x85y", "<|endoftext|> plain",
    "\U0001f600\U0001f468‍\U0001f469 漢字かな 한국어 עברית", "12345 67,89.0", "...!!!***", "é é", "᠎ x​ y\x1f z",
]


@pytest.fixture(scope="module")
def enc():
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def random_texts(n=150, seed=4):
    rng = random.Random(seed)
    alphabet = ["a", "the", "Zü", "'s", "'", " ", " ", "  ", "\n", "\t", " ", " ", "9", "!", "漢", "\U0001f600", "\x1c", "."]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_cut_texts_have_the_same_ids(enc, block, monkeypatch):
    monkeypatch.setattr(bpe, "_LONG_RUN", __import__("re").compile(f"[{bpe._SPACE}]{{3,}}"))
    for text in [*ODD, *random_texts()]:
        assert bpe.encode_text(enc, text, block).tolist() == enc.encode_ordinary(text), repr(text)


def test_long_runs_of_white_space(enc):
    for text in (" " * 300_000, "\n" * 300_000 + "x", "a" + " \n" * 200_000 + " b"):
        ids = bpe.encode_text(enc, text)
        assert enc.decode_bytes(ids.tolist()) == text.encode()
    # still within what the library can do by itself
    for text in (" " * 9000, " " * 9000 + "end", "x" + "\n" * 5000 + "y", "x" + " " * 4097, " " * 4096 + "\n"):
        assert bpe.encode_text(enc, text).tolist() == enc.encode_ordinary(text)


def test_encode_and_decode(docs, enc):
    rows = [*AWKWARD, *[(100 + i, t) for i, t in enumerate(ODD)]]
    found = bpe.decode(bpe.encode(docs(rows), RANKS, PATTERN), RANKS, PATTERN)
    assert found.columns == ["doc_id", "text", "lang", "score", "ids", "decoded"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == enc.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(docs([]), RANKS, PATTERN).collect() == []


def test_decoding_bytes_that_are_no_text(spark, enc):
    rows = spark.createDataFrame([([222],), ([],), (None,)], "ids array<int>")
    assert sorted(bytes(r["decoded"]) for r in bpe.decode(rows, RANKS, PATTERN).collect()) == sorted([enc.decode_bytes([222]), b"", b""])


def test_bpe_query(spark, enc):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_bpe"](spark, SF).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)  # strings of special tokens are those tokens by default


SPECIAL = ["<|endoftext|>", "a <|endoftext|> b.", "x<|endoftext|>\n\n<|endoftext|>,", "word <|endoftext |> <|endoftext|", "end.<|endoftext|> "]


def test_ids_by_word_are_the_librarys(tokenizer):
    words = packing.WordTokenizer(packing.read_vocabulary(VOCABULARY))
    texts = [*ODD, *random_texts(seed=5), "", "x" * 500, " " * 300, *SPECIAL]
    for _ in range(2):  # the second time from memory
        for text, found in zip(texts, words.ids(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_forgotten_words(tokenizer):
    words = packing.WordTokenizer(packing.read_vocabulary(VOCABULARY), remembered=6)
    for text in [*random_texts(seed=6), *SPECIAL, "one two, three. one two four\nfive one."] * 2:
        assert np.frombuffer(words.ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_texts_in_parts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PART_CHARS", 9)
    words = packing.WordTokenizer(packing.read_vocabulary(VOCABULARY))
    texts = [*ODD, *random_texts(seed=7), *SPECIAL, "one two, three.\nfour " * 50, "x" * 300, "é " * 40, "ends with a space ", "ends with a line\n"]
    for text, found in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(got, texts, tokenizer, capacity):
    """Every document's ids are there once, gapless, in pieces and sequences of the right size."""
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    want = Counter(doc_id for doc_id, _ in texts)
    for doc_id, text in set(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        cuts = packing.cut(len(ids), capacity)
        assert [n for _, n in cuts[1:]] == [capacity] * (len(cuts) - 1)
        rows = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id])
        one = [(i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for i, (s, n) in enumerate(cuts)]
        assert rows == sorted(one * want[doc_id])
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [5, 64, 2048])
def test_pack_awkward_rows(docs, tokenizer, capacity):
    rows = [r for r in AWKWARD if capacity > 1000 or len(r[1] or "") < 10_000]
    rows += [(100 + i, t) for i, t in enumerate(SPECIAL)]
    got = packing.pack(docs(rows), VOCABULARY, capacity=capacity).collect()
    n = check_packing(got, [(r[0], r[1]) for r in rows], tokenizer, capacity)
    assert n >= -(-sum(r["length"] for r in got) // capacity)
    assert packing.pack(docs([]), VOCABULARY).collect() == []


def test_pack_query(spark, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op10_packing"](spark, SF).collect()
    n = check_packing(got, texts, tokenizer, 2048)
    assert n <= 1.01 * -(-sum(r["length"] for r in got) // 2048) + 1


def fewest(sizes, capacity):
    """The smallest number of bins, by trying everything."""
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for room in {b for b in bins if b >= sizes[i]}:
            at = bins.index(room)
            place(i + 1, [*bins[:at], room - sizes[i], *bins[at + 1 :]])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_dominance_never_costs_a_sequence(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    sizes = sorted((rng.randrange(rng.choice([1, 3]), capacity + 1) for _ in range(rng.randrange(1, 11))), reverse=True)
    fixed, left = packing.reduce_by_dominance(Counter(sizes), capacity)
    rest = sorted(Counter(left).elements(), reverse=True)
    placed = Counter()
    for b in fixed:
        assert sum(n * m for n, m in b.content) <= capacity
        for n, m in b.content:
            placed[n] += m * b.count
    assert placed + Counter(left) == Counter(sizes)
    assert sum(b.count for b in fixed) + (fewest(rest, capacity) if rest else 0) == fewest(sizes, capacity)


def test_best_fit_equals_best_fit_one_by_one():
    rng = random.Random(9)
    for _ in range(40):
        capacity = 50
        sizes = sorted((rng.choice([3, 7, 7, 11, 16, 25, 26, 40]) for _ in range(rng.randrange(1, 80))), reverse=True)
        rooms: list[int] = []
        for s in sizes:
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(capacity - s)
        found = packing.best_fit(Counter(sizes), capacity)
        assert sorted(capacity - sum(n * m for n, m in b.content) for b in found for _ in range(b.count)) == sorted(rooms)


def test_plan_of_many_pieces_is_near_the_bound():
    rng = np.random.default_rng(2)
    counts = Counter(np.minimum(2048, rng.lognormal(5.5, 1.2, 2_000_000).astype(int) + 1).tolist())
    bins = packing.plan(counts, 2048)
    placed = Counter()
    for b in bins:
        for n, m in b.content:
            placed[n] += m * b.count
    assert placed == counts
    assert sum(b.count for b in bins) <= 1.001 * sum(n * m for n, m in counts.items()) / 2048 + 1
    assert len(packing.runs_of(bins)) < 100_000


# ---- chat


def test_escape_is_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["<", "|", "\\", "<|im_end|>", "<|im_start|>", "\n", "a", "n"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_paths_of_trees(spark):
    rng = random.Random(8)
    rows = []
    for t in [None, 1, 2, 3]:
        for node in range(rng.choice([1, 9, 40])):
            parent = rng.randrange(node) if node and rng.random() < 0.9 else (None if rng.random() < 0.5 else 999)
            rows.append((t, node, parent, "user", f"{t}/{node}", rng.choice([None, 0.5, 1.0, 2.0])))
    for branches in (1, 3, None):
        got = defaultdict(list)
        for r in chat.choose_paths(tree(spark, rows), branches).collect():
            got[(r["tree"], r["path"])].append((r["depth"], r["node"]))
        want = {}
        for t in [None, 1, 2, 3]:
            up = {n: p for x, n, p, *_ in rows if x == t}
            score = {n: s or 0.0 for x, n, _, _, _, s in rows if x == t}
            ways = {}
            for leaf in set(up) - set(up.values()):
                way = [leaf]
                while up[way[-1]] in up:
                    way.append(up[way[-1]])
                ways[leaf] = way[::-1]
            order = sorted(ways, key=lambda n: (-sum(score[x] for x in ways[n]), -len(ways[n]), n))
            for leaf in order[:branches]:
                want[(t, leaf)] = list(enumerate(ways[leaf]))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_rings_repeated_nodes_and_long_chains(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 3, None, "user", "c", 0.0), (1, 3, None, "user", "c", 0.0)]
    rows += [(2, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(150)]
    got = defaultdict(list)
    for r in chat.choose_paths(tree(spark, rows)).collect():
        got[r["tree"]].append((r["depth"], r["node"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 3)], 2: [(i, i) for i in range(150)]}


def test_conversations_are_read_back(spark):
    odd = "<|im_end|>\n<|im_start|>assistant\nok <\\| <\\\\| end<"
    rows = [
        (1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (1, 2, "assistant", None), (2, 5, "we\\n\nird<|", ""),
        (None, 0, "user", "no id"), (3, None, None, "x"), (3, None, "assistant", "\U0001f600é"), (4, 1, "assistant", "y" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    found = chat.read_back(chat.format_conversations(df)).collect()
    by_conv = defaultdict(list)
    for c, t, role, text in rows:
        by_conv[c].append((-1 if t is None else t, role or "", text or ""))
    assert len(found) == len(by_conv)
    for r in found:
        turns = [(role, text) for _, role, text in sorted(by_conv[r["tree"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["learned"] == [text for role, text in turns if role == "assistant"]
        assert r["formatted"].count(chat.START) == len(turns)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).collect() == []
