"""Language identification: hashed subword embeddings, averaged over a text, under a linear softmax.

Subwords are the byte n-grams of the lower-cased (A-Z) text with white space runs as single bytes. The model is trained by
stochastic gradient descent in numpy, on a bounded sample of labelled rows: at most `per_language` of each of the `languages`
most frequent languages, chosen by a hash of the row, of each a window of `window` characters. A part of the sample is kept from training and calibrates it: a
temperature for the probabilities, and the score below which a prediction is rejected, so that of such short texts about the
share `reject` is lost (with fewer than 1 / reject of them: those below the least score). Prediction reads whole texts: since the softmax is linear, embedding and output weights collapse into one
table of scores by subword, whose mean over the text gives the scores.

Null texts and texts without a letter get the language und and the score 0, and count as rejected. Repeated rows get the same
prediction. Without any labelled row every text is und. Columns beside doc_id, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import shards
from .subwords import lean

ORDERS = (2, 3, 4)
#: Bytes of the pieces that calibrate.
SHORT = 40
#: Bytes of text that are scored together; their subwords take some thirty times as much.
SHARD_BYTES = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def subwords(data: bytes, bits: int) -> list[np.ndarray]:
    """Buckets of the n-grams at each byte, per order; the last n-1 bytes have none."""
    b = np.frombuffer(data.translate(LOWER), np.uint8).astype(np.uint32)
    out, h = [], b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) ^ (b[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        if n in ORDERS:
            mixed = h ^ (h >> np.uint32(15))
            out.append((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
    return out


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of scores per bucket
    bits: int
    temperature: float
    threshold: float

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language's index and its calibrated probability, for texts of one shard."""
        data = b"\0\0\0\0".join(texts) + b"\0\0\0\0"
        ends = np.cumsum([len(t) + 4 for t in texts])
        starts = ends - np.array([len(t) + 4 for t in texts])
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for n, grams in zip(ORDERS, subwords(data, self.bits)):
            # the subwords of a text are those that end in it; the zero bytes between texts part the ranges
            lo, hi = np.minimum(starts, len(grams)), np.maximum(starts, np.minimum(ends - 4 - (n - 1), len(grams)))
            for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist())):
                if b - a > len(self.table):
                    total[k] += np.bincount(grams[a:b], minlength=len(self.table)) @ self.table
                elif b > a:
                    total[k] += self.table[grams[a:b]].sum(axis=0)
            count += np.maximum(0, hi - lo)
        z = total / np.maximum(count, 1)[:, None] / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def train(texts: list[bytes], langs: list[str], bits: int = 15, dim: int = 16, epochs: int = 6, rate: float = 0.5, reject: float = 0.01, seed: int = 1) -> Model:
    """Stochastic gradient descent over single texts, in an order fixed by the seed; the learning rate falls linearly."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    embedding, output = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)), np.zeros((dim, len(languages)))
    bags = []
    for t in texts:
        grams = subwords(t, bits)
        bags.append(np.unique(np.concatenate(grams) if grams else np.zeros(0, np.uint32), return_counts=True))
    order = rng.permutation(len(bags))
    fit, held = order[len(order) // 5 :], order[: len(order) // 5]
    step, steps = 0, max(1, epochs * len(fit))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, n = bags[i]
            step += 1
            if not len(ids):
                continue
            share = (n / n.sum())[:, None]
            hidden = (embedding[ids] * share).sum(axis=0)
            z = (hidden[:, None] * output).sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            lr = rate * (1 - step / steps) + 1e-3
            back = (output * p).sum(axis=1)
            output -= lr * hidden[:, None] * p
            embedding[ids] -= lr * 10 * share * back  # a text's gradient is thin over its many subwords
    table = (embedding[:, :, None] * output[None]).sum(axis=1).astype(np.float32)
    # calibration on short pieces of texts that training didn't see: whole texts hardly err, so they can't tell a temperature
    # pieces without a subword say nothing: their score is the same in every model
    short = [(i, np.concatenate(g)) for i in held if (g := subwords(texts[i][len(texts[i]) // 2 :][:SHORT], bits))]
    held = np.array([i for i, _ in short], np.int64)
    scores = np.array([table[g].mean(axis=0) for _, g in short]).reshape(len(held), len(languages))

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((scores - scores.max(axis=1, keepdims=True, initial=-1e30)) / t)
        return p / p.sum(axis=1, keepdims=True)

    temperature, threshold = 1.0, 0.0
    if len(held):
        right = y[held]
        losses = {t: float(-np.log(probabilities(t)[np.arange(len(held)), right] + 1e-12).mean()) for t in np.geomspace(0.05, 20, 40).tolist()}
        temperature = min(losses, key=losses.get)
        # the finite-sample quantile: a new text of a learned language falls below it with a chance of at most `reject`, or of
        # 1 / (held + 1) if that is more
        top = np.sort(probabilities(temperature).max(axis=1))
        threshold = float(top[max(1, int(reject * (len(top) + 1))) - 1])
    return Model(languages, table, bits, temperature, min(threshold, 1 - 1e-9))


def labelled_sample(docs: DataFrame, per_language: int, window: int, languages: int) -> tuple[list[bytes], list[str]]:
    """per_language rows of each language (all, if fewer), by a hash of the whole row: a bounded number of bounded windows.

    A first draw by the hash leaves about twice as many, so that few rows are ranked; equal rows rank by their task's numbers.
    """
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return [], []
    number = F.monotonically_increasing_id()
    draw = F.pmod(F.xxhash64("doc_id", "lang", "text", number, F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    quota = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, 2 * (per_language + 50) / n))]), F.col("lang"))
    at = F.greatest(F.lit(1), (F.length("text") / 2 - window / 2).cast("int"))
    drawn = known.withColumn("draw", draw).filter(F.col("lang").isin(list(counts)) & (F.col("draw") < quota))
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    rows = drawn.select("doc_id", "lang", "draw", F.substring("text", at, F.lit(window)).alias("text")).withColumn("at", F.row_number().over(first)).filter(F.col("at") <= per_language).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["text"]))
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def identify(docs: DataFrame, training: DataFrame | None = None, per_language: int = 800, window: int = 1500, languages: int = 500, carry: bool = False, **settings) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs; learnt from the labelled rows of `training` (default: docs).

    With carry, the columns of docs as one struct, row, stand in doc_id's place.
    """
    texts, langs = labelled_sample(docs if training is None else training, per_language, window, languages)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, langs, **settings) if texts else None)
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col("doc_id")

    def predict(parts):
        m = model.value
        for part in parts:
            # a carried text comes once, in its row
            whole = pc.fill_null(part.column(0).field("text").cast(pa.binary()), b"") if carry else part.column(2)
            for rows in shards(whole, SHARD_BYTES):
                keys, letters, data = part.column(0)[rows], part.column(1)[rows].to_pylist(), whole[rows].to_pylist()
                langs, scores = ["und"] * len(data), np.zeros(len(data))
                at = [i for i, ok in enumerate(letters) if ok and m]
                if at:
                    best, p = m.predict([data[i] for i in at])
                    scores[at] = p
                    for i, b in zip(at, best.tolist()):
                        langs[i] = m.languages[b]
                yield pa.RecordBatch.from_arrays([keys, pa.array(langs, pa.string()), pa.array(scores), pa.array([not ok or not m or s < m.threshold for ok, s in zip(letters, scores.tolist())], pa.bool_())], [name, "lang_pred", "score", "rejected"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    given = docs.select(key, has_letter.alias("letters"), *([] if carry else [F.coalesce("text", F.lit("")).cast("binary").alias("bytes")]))
    name, kind = given.dtypes[0]
    return given.mapInArrow(lean(predict), f"{name} {kind}, lang_pred string, score double, rejected boolean")
