"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Training rows are a sample of at most ``sample`` labelled rows, chosen by a seeded hash of the id; the sample
bounds all that training sees, and of its rows of one label that share a min-hash, as near copies do, one
trains. Spark counts in how many toxic and other documents of it each word and word stem (its first 4, 5 and
6 letters) occurs; the entries that mark toxic documents make the lexicon, of at most ``entries``. The trees' rows are crossed: each half's features come from the other half's lexicon, so that
they are not flattered. Every fourth row is held back for the isotonic calibration (of fewer than 400 rows, all are used
for both). Features are densities of
lexicon words and stems, nearness to second-person words, capitals, punctuation, and obfuscation (digits or
symbols for letters, letters drawn out or spelled apart). Whole texts are read in one pass.

Defined cases: null text is empty and scored like any other; a null label is no label; of several labels of
one id the highest counts; without both labels among the training rows all scores are 0; rows without an id are
scored but not learned from, and rows of one label, id and text are learned once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauceda.llm.common import crc_of_id, discard, materialize, read_table, slices, utf8_column
from cauceda.llm.words import run_hashes, word_hashes, words

#: Second-person words of the languages at hand.
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú usted ustedes ti tuyo vosotros".split())
#: Symbols that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasii")
STEMS = (4, 5, 6)
WORD = regex.compile(r"[\p{L}\p{N}@$!|*]+")
APART = regex.compile(r"(?<![\p{L}\p{N}])\p{L}(?:[ .\-_*]\p{L}){2,}(?![\p{L}\p{N}])")
DRAWN = regex.compile(r"(\p{L})\1{2,}")
MIXED = regex.compile(r"\p{L}[013457@$!|*]+\p{L}")
STRIP = "@$!|*"
UPPER = regex.compile(r"\p{Lu}")
SHOUTED = regex.compile(r"(?<!\p{L})\p{Lu}{3,}(?!\p{L})")
MARKS = regex.compile(r"[^\p{L}\p{N}\s]")
FEATURES = ("words", "lexicon", "distinct", "per_100", "stems", "stems_per_100", "weight", "peak", "near_you", "you_per_100", "capitals", "shouted", "exclaims", "punctuation", "obfuscated", "uncovered")


def words_of(text: str) -> list[str]:
    return [w for x in WORD.findall(text.lower()) if (w := x.strip(STRIP))]


def plain(word: str) -> str:
    """The word with symbols read as letters and drawn-out letters made short."""
    return DRAWN.sub(r"\1", word.translate(LEET))


def terms(text: str) -> set[str]:
    """Distinct words, and stems written with a hyphen after them."""
    words = {w for w in words_of(text) if w.isalpha()}
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


@dataclass
class Lexicon:
    """Weights of words, and of stems by their text."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def of(self, word: str) -> tuple[float, float]:
        whole = self.words.get(word, 0.0)
        stem = max(self.stems.get(word[:4], 0.0), self.stems.get(word[:5], 0.0), self.stems.get(word[:6], 0.0))
        return whole, stem

    def features(self, text: str) -> list[float]:
        lower = text.lower()
        words = [w for x in WORD.findall(lower) if (w := x.strip(STRIP))]
        n = max(len(words), 1)
        count = Counter(words)
        hits = {w: self.of(w) for w in count}
        hits = {w: h for w, h in hits.items() if h[0] or h[1]}
        lexicon = sum(count[w] for w, h in hits.items() if h[0])
        stems = sum(count[w] for w in hits)
        weight = sum(count[w] * max(h) for w, h in hits.items())
        near = 0
        you = sum(count[w] for w in YOU if w in count)
        if hits and you:
            at = np.array([i for i, w in enumerate(words) if w in hits])
            to = np.array([i for i, w in enumerate(words) if w in YOU])
            after = np.searchsorted(to, at)  # places are sorted: the nearest is the one before or the one after
            near = int(((at - to[np.maximum(after - 1, 0)] <= 5) & (after > 0) | (after < len(to)) & (to[np.minimum(after, len(to) - 1)] - at <= 5)).sum())
        odd = [w for w in count if not w.isalpha() and MIXED.search(w)] if MIXED.search(lower) else []
        drawn = [w for w in count if DRAWN.search(w)] if DRAWN.search(lower) else []
        apart = APART.findall(lower)
        uncovered = sum(max(self.of(plain(w))) > 0 for w in {*odd, *drawn} if w not in hits)
        uncovered += sum(max(self.of("".join(c for c in x if c.isalpha()))) > 0 for x in apart)
        size = max(len(text), 1)
        upper = len(UPPER.findall(text))
        shouted = len(SHOUTED.findall(text))
        marks = len(MARKS.findall(text))
        return [n, lexicon, len(hits), 100 * lexicon / n, stems, 100 * stems / n, weight, max((max(h) for h in hits.values()), default=0.0), near, 100 * you / n, upper / size, 100 * shouted / n, 100 * text.count("!") / n, marks / size, 100 * (len(odd) + len(drawn) + len(apart)) / n, uncovered]


def sketched(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, label, draw, text) and a min-hash of the text's 3-word shingles, which near copies tend to share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            starts, ends, counts = words(*(data := utf8_column(batch.column(3))))
            hashes = word_hashes(data[0], starts, ends, lower=True)
            out = np.zeros(batch.num_rows, np.uint64)
            edges = np.append(0, np.cumsum(counts))
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                runs = run_hashes(hashes[a:b], min(3, b - a)) if b > a else np.zeros(1, np.uint64)
                out[i] = runs.min()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], [*batch.schema.names, "sketch"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, sketch long")


def learn_lexicon(rows: DataFrame, entries: int, purity: float = 0.85, support: float = 0.004) -> Lexicon:
    """Terms that occur in enough toxic rows and hardly elsewhere. ``rows``: text, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            every = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(every, pa.string()), *(pa.array([c[t] for t in every], pa.int64()) for c in seen)]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["term", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update(terms(text or ""))
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield out()
        yield out()

    sizes = {int(r[0]): int(r[1]) for r in rows.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        return Lexicon()
    counted = rows.select("text", "label").mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = (F.col("toxic") / toxic) / (F.col("toxic") / toxic + (F.col("clean") + 0.5) / clean)
    chosen = counted.filter((F.col("toxic") >= max(3.0, support * toxic)) & (rate >= purity)).withColumn("rate", rate)
    best = chosen.orderBy(F.desc(F.col("toxic") * (F.col("rate") - purity / 2)), "term").limit(entries).collect()
    out = Lexicon()
    for r in best:
        where = out.stems if r["term"].endswith("-") else out.words
        where[r["term"].rstrip("-")] = float(np.log(r["rate"] / (1 - r["rate"] + 1e-3)))
    return out


@dataclass
class Trees:
    """Boosted regression trees of one depth, level by level in arrays."""

    base: float
    depth: int
    rate: float
    split: list[np.ndarray] = field(default_factory=list)  # feature of each inner node
    level: list[np.ndarray] = field(default_factory=list)  # threshold of each inner node: right if above
    leaf: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, level, leaf in zip(self.split, self.level, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, split[node]] > level[node])
            out += self.rate * leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: float = 3.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss over binned features."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), depth, rate)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)))[:-1] if len(c) else np.zeros(1) for c in x.T]
    # rare values matter: the first distinct non-zero value is an edge too
    edges = [np.unique(np.append(e, [0.0])) for e in edges]
    width = max(map(len, edges)) + 1
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    raw = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        split, level, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for d in range(depth):
            first = 2**d - 1
            best = np.full(2**d, 1e-6)
            for f, own in enumerate(edges):
                at = (node - first) * width + binned[:, f]
                g = np.bincount(at, slope, 2**d * width).reshape(2**d, width).cumsum(axis=1)
                h = np.bincount(at, curve, 2**d * width).reshape(2**d, width).cumsum(axis=1)
                gain = g**2 / (h + ridge) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(h < least / 4) | (h[:, -1:] - h < least / 4)] = 0
                gain = gain[:, : len(own)]
                top = gain.argmax(axis=1)
                value = gain[np.arange(2**d), top]
                better = value > best
                best = np.where(better, value, best)
                split[first : first + 2**d][better] = f
                level[first : first + 2**d][better] = own[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), split[node]] > level[node])
        last = node - inner
        g, h = np.bincount(last, slope, 2**depth), np.bincount(last, curve, 2**depth)
        leaf = g / (h + ridge)
        raw += rate * leaf[last]
        model.split.append(split)
        model.level.append(level)
        model.leaf.append(leaf)
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y: pooled neighbours, joined by straight lines."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of raw
    for r, v in zip(raw[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(r)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], a, strict=True)]
    at = np.array([b[2] / b[1] for b in blocks])
    value = np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks])  # a hint of doubt for small blocks
    return at, np.maximum.accumulate(value)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        fitted = np.interp(raw, *self.knots)
        return np.clip(0.98 * fitted + 0.02 / (1 + np.exp(-raw)), 0.0, 1.0)  # the share of the raw score parts ties


def feature_rows(rows: DataFrame, lexicon: Lexicon, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of ``rows`` and ``x``, the features of its text."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            x = pa.array([own.features(t or "") for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), x], [*keep, "x"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = 20_000, entries: int = 5000, seed: int = 3) -> Model | None:
    """A model from at most ``sample`` labelled rows; None unless both labels occur among them."""
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    drawn = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).orderBy("draw", "doc_id").limit(sample)
    drawn = materialize(drawn, "toxicity-sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = materialize(sketched(rows.select("doc_id", "label", "draw", "text")), "toxicity-texts")
    firsts = texts.groupBy("sketch", "label").agg(F.min("draw").alias("draw"))
    rows = materialize(texts.join(firsts, ["sketch", "label", "draw"], "left_semi").dropDuplicates(["sketch", "label", "draw"]), "toxicity-rows")
    half, keep = F.pmod("draw", F.lit(2)), ("doc_id", "draw", "label")
    crossed = [feature_rows(rows.filter(half == own), learn_lexicon(rows.filter(half != own), entries), keep) for own in (0, 1)]
    found = crossed[0].unionByName(crossed[1]).toArrow().sort_by([("draw", "ascending"), ("doc_id", "ascending")])
    lexicon = learn_lexicon(rows, entries)
    discard(drawn, texts, rows)
    x = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = found["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    back = np.arange(len(y)) % 4 == 3 if len(y) >= 400 else np.ones(len(y), bool)
    fitted = ~back if len(y) >= 400 else back
    trees = boost(x[fitted], y[fitted])
    return Model(lexicon, trees, isotonic(trees.raw(x[back]), y[back]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            x = np.array([own.lexicon.features(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.score(x))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(own.score(np.array([own.lexicon.features(t or "") for t in texts])) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = crc_of_id("doc_id") % 5 == 0
    model = fit(docs, labels.filter(~held_out))
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
