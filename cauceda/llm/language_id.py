"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are the byte 3-grams and 4-grams of its lower-cased form, hashed into ``buckets``. The
model averages their embeddings and feeds the mean to a linear layer; stochastic gradient descent in numpy
trains both on a sample of at most ``sample`` distinct labelled rows, whole texts, chosen by a seeded hash of the id,
of at most ``sample_bytes`` of text together, where rows of more than a 16th of that come last; Spark cuts to it before anything is collected. A temperature fitted on
held-back rows of the sample, every fifth (on all of them if there are fewer than 50), calibrates the probability;
below the confidence at which ``precision`` of those rows' answers are right the answer is marked rejected.

Since the network is linear, a trained bucket folds into one row of logits. Scoring gathers and sums these
rows for all texts of a batch at once. The folded table, buckets x languages floats, is what is broadcast.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; a text of fewer
than 3 bytes that has a letter gets the class shares learned as bias; null labels and labels of the value
``und`` are not learned; without any labelled row every text is ``und``; rows without an id are scored but not
learned from, and rows that repeat id, text and label are learned once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cauceda.llm.common import crc_of_id, read_table, slices, utf8_column

ORDERS = (3, 4)
LETTER = regex.compile(r"\p{L}")
#: Bytes whose subwords are looked at together.
STEP = 1 << 17
#: A row of more than this share of the sample's bytes comes after all others.
SHARE = 16


def subwords(data: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of the n-gram at every byte; ``buckets`` where it would leave its text."""
    wide = np.zeros(len(data), np.uint32)
    for k in range(n):
        wide[: len(data) - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    mixed = ((wide ^ (wide >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)) >> shift
    out = mixed.astype(np.int64)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    out[np.arange(len(data)) + n > ends] = buckets
    return out


def bucket_counts(text: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of one text's subwords and how often each occurs."""
    if len(text) <= STEP:
        return np.unique(np.concatenate([subwords(text, np.array([0, len(text)]), n, buckets) for n in ORDERS]), return_counts=True)
    total = np.zeros(buckets + 1, np.int64)
    for start in range(0, len(text), STEP):
        for n in ORDERS:
            part = text[start : start + STEP + n - 1]
            total += np.bincount(subwords(part, np.array([0, len(part)]), n, buckets)[:STEP], minlength=buckets + 1)
    own = np.flatnonzero(total)
    return own, total[own]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8_column(pa.array([(x or "").lower() for x in column.to_pylist()], pa.large_string()))


def has_letter(column: pa.Array) -> np.ndarray:
    return np.array([x is not None and LETTER.search(x) is not None for x in column.to_pylist()], bool)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets + 1, languages): the last row is zero
    bias: np.ndarray
    temperature: float
    threshold: float

    @property
    def buckets(self) -> int:
        return len(self.table) - 1

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean logits of each text; rows of the table are gathered for ``STEP`` bytes at a time."""
        total, lengths = np.zeros((len(offsets) - 1, len(self.languages))), np.diff(offsets)
        for start in range(0, len(data), STEP):
            end = min(start + STEP, len(data))
            first, last = int(np.searchsorted(offsets, start, side="right")) - 1, int(np.searchsorted(offsets, end))
            texts = np.arange(first, last)[lengths[first:last] > 0]
            ahead = min(end + max(ORDERS) - 1, len(data))  # what an n-gram that begins before ``end`` may need
            edges = np.append(np.clip(offsets[first:last], start, end), min(int(offsets[last]), ahead)) - start
            begins = np.maximum(offsets[texts], start) - start
            for n in ORDERS:
                rows = self.table[subwords(data[start:ahead][: edges[-1]], edges, n, self.buckets)[: end - start]]
                total[texts] += np.add.reduceat(rows, begins, axis=0)
        grams = sum(np.maximum(lengths - n + 1, 0) for n in ORDERS)
        return total / np.maximum(grams, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chance = softmax(self.logits(data, offsets) / self.temperature)
        best = chance.argmax(axis=1)
        return best, chance[np.arange(len(best)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(ids: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray, languages: list[str], buckets: int, dims: int = 16, epochs: int = 6, rate: float = 1.0, batch: int = 16, precision: float = 0.99, seed: int = 5) -> Model:
    """Fit on rows of bucket ids and their shares; every fifth row is held back for the calibration."""
    rng = np.random.default_rng(seed)
    kinds = len(languages)
    inner = rng.normal(0, 1 / dims, (buckets + 1, dims)).astype(np.float32)
    outer = rng.normal(0, 0.1, (dims, kinds)).astype(np.float32)
    bias = np.zeros(kinds, np.float32)
    order = rng.permutation(len(labels))
    back = order[::5] if len(order) >= 50 else order
    fit = np.setdiff1d(order, back) if len(order) >= 50 else order
    steps, done = max(1, epochs * -(-len(fit) // batch)), 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // batch))):
            sizes = np.array([len(ids[i]) for i in rows])
            flat, share = np.concatenate([ids[i] for i in rows]), np.concatenate([weights[i] for i in rows])
            doc = np.repeat(np.arange(len(rows)), sizes)
            mean = np.zeros((len(rows), dims), np.float32)
            filled = np.flatnonzero(sizes)
            if len(filled):
                mean[filled] = np.add.reduceat(inner[flat] * share[:, None], (np.cumsum(sizes) - sizes)[filled], axis=0)
            wrong = softmax(mean @ outer + bias)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            now = rate * (1 - done / steps)
            # each row moves the embeddings of its subwords by its own share, as in averaging
            back_to = (wrong @ outer.T)[doc] * share[:, None] * (now * 8)
            outer -= now * (mean.T @ wrong) / len(rows) * 4
            bias -= now * 0.05 * wrong.mean(axis=0)
            np.subtract.at(inner, flat, back_to)
            done += 1
    table = (inner @ outer).astype(np.float32)
    table[buckets] = 0
    model = Model(languages, table, bias.astype(np.float64), 1.0, 0.0)
    logits = np.array([(table[ids[i]] * weights[i][:, None]).sum(axis=0) + bias for i in back]).reshape(len(back), kinds)
    return calibrate(model, logits, labels[back], precision)


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, precision: float) -> Model:
    """The temperature of the least loss, then the least confidence above which enough answers are right."""
    if not len(labels):
        return model
    choices = np.exp(np.linspace(-3, 3, 61))
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in choices]
    model.temperature = float(choices[int(np.argmin(loss))])
    chance = softmax(logits / model.temperature)
    sure, right = chance.max(axis=1), chance.argmax(axis=1) == labels
    order = np.argsort(-sure)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= precision
    model.threshold = float(sure[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0
    return model


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = 6000, sample_bytes: int = 64 << 20, buckets: int = 1 << 16, seed: int = 5, **options) -> Model | None:
    """A model from at most ``sample`` rows of ``labelled``, of ``sample_bytes`` together; None without rows."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter("label IS NOT NULL AND label <> 'und' AND text IS NOT NULL")
    rows = rows.withColumn("own", F.xxhash64("text", "label"))
    # names alone are sorted, then their texts are read
    drawn = rows.select("doc_id", "own", F.octet_length("text").alias("size"), F.xxhash64(F.lit(seed), "doc_id").alias("draw")).distinct().orderBy("draw", "doc_id", "own").limit(sample)
    large = F.when(F.col("size") * SHARE > sample_bytes, F.col("size")).otherwise(0)  # one long text doesn't take the others' place
    held = F.sum("size").over(Window.orderBy(large, "draw", "doc_id", "own"))  # over the sample's rows, ``sample`` at most
    drawn = drawn.withColumn("held", held).filter(F.col("held") <= sample_bytes).select("doc_id", "own")
    rows = rows.join(F.broadcast(drawn), ["doc_id", "own"]).dropDuplicates(["doc_id", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            data, offsets = lowered(batch.column(1))
            ids, counts = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own, n = bucket_counts(data[a:b], buckets)
                ids.append(own[own < buckets].astype(np.int32))
                counts.append(n[own < buckets].astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, kind), pa.array(counts, kind)], ["doc_id", "label", "ids", "counts"])

    key = rows.schema["doc_id"].dataType.simpleString()
    found = rows.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {key}, label string, ids array<int>, counts array<int>").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    names = sorted(set(found["label"].to_pylist()))
    labels = np.array([names.index(x) for x in found["label"].to_pylist()])
    ids = [np.asarray(x.values) for x in found["ids"]]
    counts = [np.asarray(x.values).astype(np.float32) for x in found["counts"]]
    return train(ids, [c / max(c.sum(), 1) for c in counts], labels, names, buckets, seed=seed, **options)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text", 1 << 20):
            known = has_letter(batch.column(1)) if own else np.zeros(batch.num_rows, bool)
            if own:
                best, score = own.predict(*lowered(batch.column(1)))
                names = [own.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
                score = np.where(known, score, 0.0)
                rejected = ~known | (score < own.threshold)
            else:
                names, score, rejected = ["und"] * batch.num_rows, np.zeros(batch.num_rows), ~known
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def op7_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_of_id("doc_id") % 4 == 2
    model = fit(docs.filter(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
