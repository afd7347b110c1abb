"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters inside lower-cased words, with word edges as a character. Their
document frequencies are counted over all labelled rows. The weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a sample of at most about ``per_language`` labelled rows of each language, in one task; a fifth
of the sample calibrates a temperature. A text's term frequencies sum to 1, so its logits are a mean over its words:
each distinct word of a slice is scored once, and a whole text of any length costs one pass over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.arrow_text import byte_slices, encoded, frugal, raw, strings, words

BITS = 16
SIZE = 1 << BITS
SLICE_BYTES = 4 << 20
SCALE = 20.0
UNDETERMINED = "und"


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def grams(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each word, end to end, and where each word's begin (one entry more than words)."""
    if not len(distinct):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    joined = (b"\n" + b"\n".join(distinct.to_pylist()) + b"\n").decode("utf-8").lower()
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    edge = c == 10
    a, b, d = c, np.append(c[1:], 10).astype(np.uint32), np.append(c[2:], [10, 10])[: len(c)].astype(np.uint32)
    h = np.empty((len(c), 3), np.uint32)
    h[:, 0] = a * np.uint32(0x9E3779B1)
    h[:, 1] = a * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35) + np.uint32(1)
    h[:, 2] = a * np.uint32(0x27D4EB2F) + b * np.uint32(0x165667B1) + d * np.uint32(0x9E3779B1) + np.uint32(2)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    valid = np.empty(h.shape, bool)
    valid[:, 0] = ~edge
    valid[:, 1] = True
    valid[:, 2] = ~np.append(edge[1:], True)
    valid[-1] = False
    word = np.cumsum(edge) - 1
    n = np.bincount(word, valid.sum(1), minlength=len(distinct) + 1)[: len(distinct)].astype(np.int64)
    return (h >> np.uint32(32 - BITS))[valid].astype(np.int32), np.concatenate([[0], np.cumsum(n)])


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The code of every word, the distinct words, and each text's first word."""
    data, offsets = raw(texts)
    begins, stops, first = words(data, offsets)
    codes, distinct = encoded(data, begins, stops)
    return codes, distinct, first


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct n-grams of each text and how often each occurs."""
    codes, distinct, first = coded(texts)
    flat, at = grams(distinct)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        code, n = np.unique(codes[a:b], return_counts=True)
        lens = at[code + 1] - at[code]
        where = np.repeat(at[code] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        found = np.bincount(flat[where], np.repeat(n, lens), SIZE)
        ids = np.flatnonzero(found)
        yield ids, found[ids]


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each hashed n-gram occurs: one row for each n-gram and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(SIZE, np.int64)
        for batch in batches:
            part = strings(batch.column("text"))
            for a, b in byte_slices(part, SLICE_BYTES):
                codes, distinct, first = coded(part.slice(a, b - a))
                flat, at = grams(distinct)
                for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    code = np.unique(codes[i:j])
                    lens = at[code + 1] - at[code]
                    seen = np.zeros(SIZE, bool)
                    seen[flat[np.repeat(at[code] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())]] = True
                    df += seen
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(df[ids])], ["gram", "df"])

    rows = texts.select("text").mapInArrow(frugal(run), "gram int, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(SIZE, np.int64)
    out[[r.gram for r in rows]] = [r.df for r in rows]
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    bags_: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, epochs: int = 3
) -> np.ndarray:
    """Weights (SIZE, classes) by follow-the-regularised-leader, one text at a time in a fixed shuffled order."""
    z, n = np.zeros((SIZE, classes)), np.zeros((SIZE, classes))
    order = np.random.default_rng(7)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in order.permutation(len(bags_)):
            ids, x = bags_[i]
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[target[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[ids] = zi + g - sigma * w
            n[ids] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden section on its logarithm."""
    if not len(logits):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(target)), target] + 1e-12).mean()

    low, high, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    """Languages, and weights that already hold the inverse document frequencies, the scale and the temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray):
        self.languages, self.weights = languages, weights.astype(np.float32)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        codes, distinct, first = coded(texts)
        n = np.diff(first)
        letters = np.zeros(len(texts), bool)
        out, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        if not len(codes) or not self.languages:
            return out.tolist(), score
        flat, at = grams(distinct)
        sums = np.add.reduceat(self.weights[flat], at[:-1], axis=0).astype(np.float64)
        lens = at[1:] - at[:-1]
        full = n > 0
        cuts = first[:-1][full]
        some = np.add.reduceat(pc.match_substring_regex(distinct.cast(pa.string()), r"\p{L}").to_numpy(zero_copy_only=False)[codes].astype(np.int64), cuts) > 0
        letters[full] = some
        logits = np.stack([np.add.reduceat(sums[codes, k], cuts) for k in range(len(self.languages))], 1) / np.add.reduceat(lens[codes], cuts)[:, None]
        p = softmax(logits)
        best = p.argmax(1)
        names = np.array(self.languages, object)[best]
        out[full] = np.where(some, names, UNDETERMINED)
        score[full] = np.where(some, p[np.arange(len(best)), best], 0.0)
        return out.tolist(), score


def train(labelled: DataFrame, per_language: int = 1000) -> Model:
    """A model from ``labelled`` (doc_id, text, lang). Null languages and null texts teach nothing."""
    labelled = labelled.where("lang is not null and text is not null")
    rows = labelled.groupBy("lang").count().collect()
    languages, total = sorted(r.lang for r in rows), sum(r["count"] for r in rows)
    if not languages:
        return Model([], np.zeros((SIZE, 0)))
    idf = np.log((1.0 + total) / (1.0 + document_frequencies(labelled))) + 1.0
    share = F.create_map(*[x for r in rows for x in (F.lit(r.lang), F.lit(min(1.0, per_language / r["count"])))])
    point = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = labelled.where(point < share[F.col("lang")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = strings(batch.column("text"))
            for a, b in byte_slices(part, SLICE_BYTES):
                found = list(bags(part.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("lang").slice(a, b - a), pa.array([x.astype("<i4").tobytes() for x, _ in found], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in found], pa.binary())],
                    ["doc_id", "lang", "ids", "counts"],
                )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "lang"], ignore_index=True)
        bags_ = []
        for ids, n in zip(rows["ids"], rows["counts"], strict=True):
            i, x = np.frombuffer(ids, "<i4"), np.frombuffer(n, "<f4").astype(np.float64)
            bags_.append((i, SCALE * x * idf[i] / max(1.0, x.sum())))
        target = rows["lang"].map({k: i for i, k in enumerate(languages)}).to_numpy()
        held = np.arange(len(rows)) % 5 == 4
        w = fit_ftrl([b for b, h in zip(bags_, held, strict=True) if not h], target[~held], len(languages))
        logits = np.array([x @ w[i] for (i, x), h in zip(bags_, held, strict=True) if h]).reshape(-1, len(languages))
        w = w * (SCALE * idf / temperature(logits, target[held]))[:, None]
        keep = np.flatnonzero(np.abs(w).sum(1))
        return pd.DataFrame({"gram": keep, "weights": [x.tobytes() for x in w[keep]]})

    vectors = sample.select("doc_id", "text", "lang").mapInArrow(features, "doc_id long, lang string, ids binary, counts binary")
    fitted = vectors.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "gram long, weights binary").collect()
    weights = np.zeros((SIZE, len(languages)))
    for r in fitted:
        weights[r.gram] = np.frombuffer(r.weights)
    return Model(languages, weights)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for every row, from the whole text alone.

    ``und`` and 0 where the text is null, empty or has no letter, or the model knows no language. Columns of ``docs``
    other than doc_id and text are not read. The model (at most 2**16 rows of one number for each language) is
    broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in byte_slices(texts, SLICE_BYTES):
                names, score = own.predict(texts.slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 5, per_language: int = 1000) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from rows of ``docs`` whose id is not in fold 0, told for all rows."""
    learn = docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), folds) != 0)
    out = predict(docs, train(learn, per_language))
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, folds: int = 5, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose text has a language: not ``und``, and predicted with at least ``least``."""
    learn = docs.select("doc_id", "text", "lang").where(remainder(F.col("doc_id"), folds) != 0)
    model = train(learn)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in byte_slices(texts, SLICE_BYTES):
                names, score = own.predict(texts.slice(a, b - a))
                yield batch.slice(a, b - a).filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(names, score, strict=True)]))

    return docs.mapInArrow(frugal(run), schema)
