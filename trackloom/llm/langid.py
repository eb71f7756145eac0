"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts per (language, bucket) are summed in Spark; the matrix of log probabilities, of languages x BUCKETS numbers, is sent
to the workers, which score texts as sparse rows in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm.common import add_columns, held_out, share_of

#: Hash buckets of n-grams; a power of two.
BUCKETS = 1 << 15
#: Lengths of n-grams, in code points.
ORDERS = (1, 2, 3)
#: Most documents of a language that are learned from (in the mean; a sample by id).
DOCS_PER_LANGUAGE = 20_000
#: Most bytes that the matrix may have.
MODEL_BYTES = 64 << 20
#: A text counts as so many independent n-grams at most when its score is computed.
EVIDENCE = 50.0
_CODES = 1 << 18
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, each run of other characters as one 0, with a 0 at either end; empty if
    there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    points = np.where(_letters()[points], points, 0)
    keep = points > 0
    if not keep.any():
        return np.empty(0, np.uint32)
    keep[1:] |= points[:-1] > 0
    found = points[keep].astype(np.uint32)
    return np.concatenate((np.zeros(1, np.uint32), found, np.zeros(int(found[-1] != 0), np.uint32)))


def buckets_of(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Hash buckets of all n-grams, in blocks; an n-gram lies within a word and its two boundaries."""
    shift, last = np.uint32(32 - BUCKETS.bit_length() + 1), len(codes)
    for at in range(0, last, _CODES):
        found = []
        for n in ORDERS:
            part = codes[at : min(last, at + _CODES + n - 1)]
            if len(part) < n:
                continue
            size = len(part) - n + 1
            mixed, inside = np.full(size, n, np.uint32), np.ones(size, bool)
            for i in range(n):
                piece = part[i : i + size]
                mixed = mixed * np.uint32(0x01000193) + piece
                if n == 1 or 0 < i < n - 1:
                    inside &= piece > 0
            mixed ^= mixed >> np.uint32(15)
            found.append(((mixed[inside] * np.uint32(0x9E3779B1)) >> shift).astype(np.int32))
        if found:
            yield np.concatenate(found)


@dataclass(frozen=True)
class LanguageModel:
    """languages in order; log_prior and log_prob[language, bucket]."""

    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; ('und', 0.0) for texts without a letter or if nothing was learned."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        rows, blocks = [], []
        for i, text in enumerate(texts):
            for block in buckets_of(letter_codes(text)):
                rows.append(i)
                blocks.append(block)
        if not rows:
            return names, scores
        total, grams = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        at = 0
        while at < len(rows):
            # as many rows of the sparse matrix as have some _CODES entries
            upto, size = at, 0
            while upto < len(rows) and (size == 0 or size + len(blocks[upto]) <= 4 * _CODES):
                size += len(blocks[upto])
                upto += 1
            columns = np.concatenate(blocks[at:upto])
            lengths = np.array([len(b) for b in blocks[at:upto]])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            for k in range(len(self.languages)):
                np.add.at(total[:, k], rows[at:upto], np.add.reduceat(self.log_prob[k][columns], starts))
            np.add.at(grams, rows[at:upto], lengths)
            at = upto
        known = grams > 0
        logs = total * np.minimum(1.0, EVIDENCE / np.maximum(grams, 1.0))[:, None] + self.log_prior
        best = logs.argmax(axis=1)
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        share = odds.max(axis=1) / odds.sum(axis=1)
        for i in np.flatnonzero(known).tolist():
            names[i], scores[i] = self.languages[best[i]], float(share[i])
        return names, scores


def fit_languages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE
) -> LanguageModel:
    """Learns from rows with a language whose id is not held out, from about ``per_language`` of each language at most.

    The sample is by a hash of the id, so it is the same in every run. Without such rows the model knows no language and
    predicts 'und'. Add-one smoothing; equal priors.
    """
    rows = docs.where(F.col(lang).isNotNull() & ~held_out(doc_id))
    counts = rows.groupBy(F.col(lang).alias("lang")).count().orderBy("lang").toPandas()
    languages = counts["lang"].tolist()
    if len(languages) * BUCKETS * 8 > MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages do not fit a model of {MODEL_BYTES} bytes")
    if not languages:
        return LanguageModel([], np.empty(0), np.empty((0, BUCKETS)))
    share = F.coalesce(
        *[F.when(F.col(lang) == name, min(1.0, per_language / n)) for name, n in zip(languages, counts["count"].tolist(), strict=True)]
    )
    chosen = rows.where(share_of(doc_id) < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(batch["lang"], batch["text"], strict=True):
                sums = found.setdefault(name, np.zeros(BUCKETS, np.int64))
                for block in buckets_of(letter_codes(text or "")):
                    sums += np.bincount(block, minlength=BUCKETS)
        for name, sums in found.items():
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"lang": name, "bucket": at.astype(np.int32), "n": sums[at]})

    summed = chosen.mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toPandas()  # at most languages x BUCKETS rows
    matrix = np.ones((len(languages), BUCKETS))
    place = {name: k for k, name in enumerate(languages)}
    np.add.at(matrix, (table["lang"].map(place).to_numpy(int), table["bucket"].to_numpy(int)), table["n"].to_numpy(float))
    prior = np.full(len(languages), -np.log(len(languages)))
    return LanguageModel(languages, prior, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) from the whole text alone; null text counts as empty.

    'und' with score 0 where the text has no letter. Columns of those names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str]) -> list[list]:
        return list(sent.value.predict(texts))

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return add_columns(docs, text, fields, compute)


def keep_identified(docs: DataFrame, min_score: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is determined with ``min_score`` or more, with their own columns."""
    model = fit_languages(docs, doc_id, text, lang)
    names = docs.columns
    own = docs.toDF(*[f"_{i}" for i in range(len(names))])
    found = identify(own, model, f"_{names.index(text)}")
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score))
    return kept.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])
