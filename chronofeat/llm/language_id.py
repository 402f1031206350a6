"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a logistic classifier on byte n-grams of the text tells
0 from 1; the language whose codeword has the least loss, weighted by how well each bit was learnt, wins. A
text whose two nearest codewords lie close together is flagged as ambiguous.

The fit uses per_language texts of each language at most (whole texts, chosen by a hash of doc_id), and fewer of each
where there are many languages: sampled texts of all languages together are at most max_texts (or one a language, if there are
more languages than that). No language is left out; every text is predicted.

Results for unusual input: null text or text without a letter: `und` with score 0, ambiguous; no labelled
training row: `und` for all; one language only: that language; very long texts: whole; repeated rows: each is
returned; equal losses: the language first in the alphabet, ambiguous; equal doc_ids with different texts: all of a sampled id's texts
of that language are learnt from; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofeat.llm._common import chunks, documents, small_batches

DIM = 4096
EPOCHS = 250
#: Loss by which the nearest codeword must beat the next, as a part of the code's length.
MARGIN = 0.1


def codewords(n: int) -> np.ndarray:
    """n distinct codewords: every split of up to seven languages, else 12 log2(n) fixed random bits."""
    if n <= 1:
        return np.zeros((n, 1), np.int8)
    if n <= 7:
        return np.array([[(c >> k) & 1 for c in range(1, 2 ** (n - 1))] for k in range(n)], np.int8)[:, :]
    bits, rng = int(np.ceil(12 * np.log2(n))), np.random.default_rng(7)
    while True:
        m = rng.integers(0, 2, (n, bits), dtype=np.int8)
        if len(np.unique(m, axis=0)) == n and ((m.sum(0) > 0) & (m.sum(0) < n)).all():
            return m


def ngrams(texts: list[str | None]) -> np.ndarray:
    """A row for each text: square roots of the shares of its hashed byte trigrams and bigrams."""
    raw = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    x = np.zeros((len(raw), DIM), np.float32)
    for i, b in enumerate(raw):
        a = np.frombuffer(b, np.uint8).astype(np.uint32)
        a[(a < 97) & ((a < 48) | (a >= 32))] = 32  # digits and ASCII signs count as blanks
        two = a[:-1] * np.uint32(40503) + a[1:] * np.uint32(2654435761)
        three = two[:-1] * np.uint32(2246822519) + a[2:] * np.uint32(3266489917)
        c = np.bincount(np.concatenate((two, three)) >> np.uint32(20), minlength=DIM)
        x[i] = np.sqrt(c / max(1, c.sum()))
    return x


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_codes(texts: list[np.ndarray], langs: list[str]) -> dict:
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        return {"names": names, "code": code, "w": np.zeros((DIM, code.shape[1]), np.float32), "b": np.zeros(code.shape[1]), "trust": np.ones(code.shape[1])}
    x = np.vstack(texts)
    y = code[np.searchsorted(names, langs)].astype(np.float32)
    share = np.unique(langs, return_counts=True)[1].astype(np.float32)[np.searchsorted(names, langs)]
    weight = (1 / share / len(names))[:, None]  # each language counts alike
    w, b = np.zeros((DIM, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, EPOCHS + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        d = (p - y) * weight
        g, gb = x.T @ d + 1e-6 * w, d.sum(0)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        f = 0.3 / (1 - 0.9**t)
        w -= f * m / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= f * mb / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    wrong = (((x @ w + b > 0) != (y > 0.5)) * weight).sum(0)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01))
    return {"names": names, "code": code, "w": w, "b": b, "trust": np.maximum(trust, 0.05)}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, a score between 0 and 1, and whether the next codeword is near."""
    z = np.clip(x @ model["w"] + model["b"], -30, 30)
    trust = model["trust"] / model["trust"].sum()
    sign = 2.0 * model["code"] - 1
    # hinge loss of each bit, weighted by its trust
    loss = np.stack([(np.minimum(2.0, np.maximum(0.0, 1 - z * s)) * trust).sum(1) for s in sign], 1)
    best = loss.argmin(1)
    if loss.shape[1] == 1:
        return best, np.ones(len(x)), np.zeros(len(x), bool)
    two = np.partition(loss, 1, 1)[:, :2]
    e = np.exp(-6 * (loss - two[:, :1]))
    return best, 1 / e.sum(1), two[:, 1] - two[:, 0] < MARGIN


def identify_language(docs: DataFrame, folds: int = 3, held_out: int = 1, per_language: int = 600, max_texts: int = 8000) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row; lang of rows that are not held out is learnt from.

    per_language, max_texts: the bounds of the sample that the classifiers are fitted on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = rows.where("lang is not null and text is not null and doc_id is not null").where(fold != held_out)
    languages = train.select("lang").distinct().count()
    each = min(per_language, max(1, max_texts // max(1, languages)))
    # one slot for each hash class of doc_id: the sample is a partial aggregate, bounded by languages and slots
    slots = train.groupBy("lang", (F.pmod(F.xxhash64("doc_id"), F.lit(each))).alias("slot")).agg(F.min("doc_id").alias("doc_id"))
    picked = F.broadcast(slots.select("lang", "doc_id").distinct())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column(1).to_pylist()
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            if keep:
                x = ngrams([texts[i] for i in keep]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = rows.join(picked, ["doc_id", "lang"]).select("lang", "text").mapInArrow(extract, "lang string, x binary").toArrow()
    model = fit_codes([np.frombuffer(v, np.float16).astype(np.float32) for v in got["x"].to_pylist()], got["lang"].to_pylist())
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches, 2_000_000):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lang, score, unsure = ["und"] * len(ids), [0.0] * len(ids), [True] * len(ids)
            for at in range(0, len(ids), 2048):
                use = [i for i in range(at, min(at + 2048, len(ids))) if m["names"] and has_letter(texts[i])]
                if use:
                    best, s, near = decode(ngrams([texts[i] for i in use]), m)
                    for i, k, p, u in zip(use, best, s, near):
                        lang[i], score[i], unsure[i] = m["names"][k], float(p), bool(u)
            held = [None if i is None else zlib.crc32(str(i).encode()) % folds == held_out for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(lang), pa.array(score), pa.array(unsure)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return documents(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
