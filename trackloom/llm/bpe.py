"""Byte-level BPE by tiktoken and a file of ranks: texts to ids and ids to bytes.

Long texts are cut before encoding where the split pattern cannot match across: before white space that follows anything
else, since no alternative of the pattern runs from other characters into white space, and none looks back. A run of
white space that is itself long is one match (without its last character, if more text follows) and is encoded as one
piece, which the library's own regular expression could not do.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import add_columns

#: Texts of more characters are cut at safe boundaries into blocks of about so many.
BLOCK = 1 << 16
#: Runs of white space of more characters are encoded apart.
SPACE_RUN = 4096
#: Most bytes that a file of ranks may have, as it is sent to every worker.
RANK_BYTES = 64 << 20
# The characters that \s matches.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACE}]{{{SPACE_RUN},}}")
_BOUNDARY = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")


def read_ranks(path: str) -> bytes:
    """The bytes of a file of ranks, whose size is checked."""
    with open(path, "rb") as file:
        data = file.read(RANK_BYTES + 1)
    if len(data) > RANK_BYTES:
        raise ValueError(f"{path} has more than {RANK_BYTES} bytes")
    return data


@lru_cache(4)
def encoding(ranks: bytes, pattern: str):
    """The library's encoding for the bytes of a file of ranks; made once a worker."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_blocks(text: str, block: int = BLOCK):
    """(part, whether it is one run of white space) whose encodings in turn are the encoding of the text."""
    at = 0
    for run in _LONG_RUN.finditer(text):
        # all of the run but its last character is one match; at the end of the text the last belongs to it as well
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from _cut(text, at, run.start(), block)
        yield text[run.start() : end], True
        at = end
    yield from _cut(text, at, len(text), block)


def _cut(text: str, at: int, end: int, block: int):
    while end - at > block:
        found = _BOUNDARY.search(text, at + block, end)
        if not found:
            break
        yield text[at : found.start()], False
        at = found.start()
    if at < end:
        yield text[at:end], False


def encode_text(enc, text: str, block: int = BLOCK) -> np.ndarray:
    """Ids of a whole text, as ``encode_ordinary`` would give them."""
    parts = []
    for part, spaces in safe_blocks(text, block):
        if spaces:
            parts.append(np.array(enc._encode_single_piece(part.encode()), np.uint32))
        else:
            # lone surrogates cannot come from UTF-8 columns, so no replacement takes place here
            parts.append(np.asarray(enc.encode_to_numpy(part, disallowed_special=()), np.uint32))
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids array<int>: the tokens of the whole text, no special tokens; null and empty text have none.

    Each match of ``pattern`` is encoded separately; strings that look like special tokens are ordinary text. The file of
    ranks is read where this is called and sent to the workers. A column called ids is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((read_ranks(rank_file), pattern))

    def compute(texts: list[str]) -> list[list]:
        enc = encoding(*sent.value)
        return [[encode_text(enc, t).astype(np.int32) for t in texts]]

    return add_columns(docs, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], compute)


def decode(rows: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``rows`` with decoded BINARY: the raw bytes that the ids stand for, whether or not they are UTF-8; null ids: none."""
    sent = rows.sparkSession.sparkContext.broadcast((read_ranks(rank_file), pattern))

    @F.pandas_udf("binary")
    def made(column: pd.Series) -> pd.Series:
        enc = encoding(*sent.value)
        return pd.Series([b"" if x is None else enc.decode_bytes(x) for x in column], dtype=object)

    return rows.withColumn("decoded", made(F.col(ids)))
