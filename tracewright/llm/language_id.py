"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is a bag of subwords: each word's characters 1-grams to 4-grams with word marks, and the word itself, hashed into
``BUCKETS`` embedding rows. The mean of the rows times a class matrix gives the logits; both are trained by stochastic
gradient descent in numpy, with weights averaged over the last epoch. Since the model is linear after averaging, a word's
contribution to the logits is a fixed vector, remembered per worker; a text costs one look-up per word.

Calibration: a temperature is fitted on labelled texts kept out of training, so that the score is a probability; the
rejection threshold is on that score.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, free_names, memo_bytes, pa_fields, slices, task_state, texts_of

UNKNOWN = "und"
BUCKETS = 1 << 15
DIM = 16
_WORD = regex.compile(r"\p{L}+")
_LETTER = regex.compile(r"\p{L}")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words in a row, and how many each word has."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "".join([f"<{w}>" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    # left[i]: characters from place i to the end of its word
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))
    buckets, owners = [np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) % BUCKETS], [np.arange(len(words))]
    owner = np.repeat(np.arange(len(words)), lengths)
    hashed = np.zeros(len(codes), np.uint64)
    for n in (1, 2, 3, 4):
        shifted = codes[n - 1 :]
        hashed = hashed[: len(shifted)] * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(n)
        fits = left[: len(shifted)] >= n
        mixed = hashed[fits]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append(((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(shifted)][fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(words))


@dataclass
class LanguageModel:
    languages: list[str]
    #: logits that each bucket adds: the embedding times the class matrix
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def word_rows(self, words: list[str]) -> np.ndarray:
        """For each word the sum of its buckets' logits, and the number of buckets."""
        out = np.zeros((len(words), len(self.languages) + 1))
        if words:
            own, counts = subwords(words)
            out[:, :-1] = np.add.reduceat(self.table[own], np.cumsum(counts) - counts, axis=0)
            out[:, -1] = counts
        return out


class Scorer:
    """Scores texts with a model; remembers the words met in a task, in about ``limit`` bytes before it starts afresh."""

    def __init__(self, model: LanguageModel, limit: int = 64_000_000):
        self.model, self.limit = model, limit
        self.forget()

    def forget(self) -> None:
        self._row: dict[str, int] = {}
        self._table, self._bytes = np.zeros((1024, len(self.model.languages) + 1)), 0

    def _rows(self, words: list[str]) -> np.ndarray:
        get = self._row.get
        rows = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = list({words[i] for i in missing.tolist()})
            size = memo_bytes(new)
            if self._bytes + size > self.limit and self._row:
                self.forget()
                return self._rows(words)
            self._bytes += size
            n = len(self._row)
            while n + len(new) > len(self._table):
                self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            # a chunk between blanks may hold several words or none
            parts = list(map(_WORD.findall, new))
            vectors = self.model.word_rows([p for own in parts for p in own])
            ends = np.cumsum([0, *map(len, parts)])
            total = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, 0)])
            self._table[n : n + len(new)] = total[ends[1:]] - total[ends[:-1]]
            self._row.update(zip(new, range(n, n + len(new)), strict=True))
            rows[missing] = [self._row[words[i]] for i in missing.tolist()]
        return rows

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated class probabilities of each text, and whether it has a letter."""
        words: list[str] = []
        counts = []
        for text in texts:
            own = text.lower().split(" ")
            words += own
            counts.append(len(own))
        sums = np.add.reduceat(self._table_of(words), np.cumsum([0, *counts[:-1]]), axis=0) if texts else np.zeros((0, self._table.shape[1]))
        n = np.maximum(sums[:, -1:], 1)
        logits = (sums[:, :-1] / n + self.model.bias) / self.model.temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True), sums[:, -1] > 0

    def _table_of(self, words: list[str]) -> np.ndarray:
        rows = self._rows(words)  # may move the table
        return self._table[rows]


def train(texts: list[str], labels: list[str], updates: int = 18_000, rate: float = 0.4, seed: int = 7) -> LanguageModel:
    """Fit embeddings and class matrix by SGD, then the temperature on every fifth text, which training doesn't see.

    The texts are gone through as often as ``updates`` steps take, six times at least, so small tables train as long.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    k = len(languages)
    of = {x: i for i, x in enumerate(languages)}
    bags, y = [], []
    for text, label in zip(texts, labels, strict=True):
        own, _ = subwords(_WORD.findall(text.lower()))
        if len(own):
            bags.append(own)
            y.append(of[label])
    if not bags:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    held = np.arange(len(bags)) % 5 == 4
    fit = np.flatnonzero(~held) if held.any() else np.arange(len(bags))
    epochs = max(6, -(-updates // max(1, len(fit))))
    embedding = rng.normal(0, 1 / DIM, (BUCKETS, DIM))
    weights, bias = np.zeros((DIM, k)), np.zeros(k)
    mean_e, mean_w, mean_b, kept = np.zeros_like(embedding), np.zeros_like(weights), np.zeros_like(bias), 0
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            # a random stretch of the bag: short texts must be recognised too
            bag = bags[i]
            size = int(min(len(bag), rng.integers(20, 400)))
            begin = int(rng.integers(0, len(bag) - size + 1))
            bag = bag[begin : begin + size]
            mean = embedding[bag].mean(0)
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= step * 0.05 * p
            np.subtract.at(embedding, bag, step * 4 * back / len(bag))
        if epoch >= epochs - max(2, epochs // 3):
            mean_e, mean_w, mean_b, kept = mean_e + embedding, mean_w + weights, mean_b + bias, kept + 1
    kept = max(kept, 1)
    table, bias = (mean_e / kept) @ (mean_w / kept), mean_b / kept
    # temperature: the one of a grid with the least log loss on the texts kept out, in short stretches
    logits, truth = [], []
    for i in np.flatnonzero(held) if held.any() else fit:
        for begin in np.linspace(0, max(0, len(bags[i]) - 200), min(4, -(-len(bags[i]) // 200))).astype(int).tolist():
            stretch = bags[i][begin : begin + 200]
            logits.append(table[stretch].mean(0) + bias)
            truth.append(y[i])
    best, temperature = np.inf, 1.0
    if logits:
        z, t = np.array(logits), np.array(truth)
        for candidate in np.geomspace(0.2, 100, 100):
            s = z / candidate
            s = s - s.max(1, keepdims=True)
            loss = float((np.log(np.exp(s).sum(1)) - s[np.arange(len(t)), t]).mean())
            if loss < best:
                best, temperature = loss, float(candidate)
    return LanguageModel(languages, table, bias, temperature)


def training_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """Up to ``per_language`` labelled documents (text, lang) of each language, by a hash of doc_id.

    Never those whose crc32(doc_id as text) mod 3 is 1: these stay for measuring. The bound is the operator's documented
    parameter; the number of languages bounds the rest.
    """
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)).select("doc_id", "lang")
    # a share of each language that is twice the bound on average, so that no task ranks a whole language
    share = learn.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(2.0 * per_language) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    learn = learn.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("doc_id", "lang")
    by = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = learn.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= per_language).select("doc_id").distinct()
    # at most per_language rows for each language: small by its parameter
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi")


def stretches(chars: int) -> Column:
    """``text``, or where it is longer than ``chars`` a stretch from each third of it, at a place hashed from doc_id."""
    size = chars // 3 - 1
    each = f"substring(text, CAST(1 + k * (length(text) div 3) + pmod(xxhash64(doc_id, k), greatest(length(text) div 3 - {size}, 0) + 1) AS int), {size})"
    return F.expr(f"IF(length(text) > {chars}, array_join(transform(array(0, 1, 2), k -> {each}), '\n'), text)")


def fit_language_model(docs: DataFrame, per_language: int = 1200, chars: int = 3000) -> LanguageModel:
    """Train on a bounded sample of labelled rows (``per_language`` of each language, ``chars`` characters of each text).

    Prediction always reads whole texts.
    """
    rows = sorted(training_rows(docs, per_language).select("doc_id", stretches(chars).alias("text"), "lang").collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def predict_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, lang_pred and score, or what ``names`` calls these two.

    The text alone decides; a null or letterless text gets ``und`` and score 0, as does every text if nothing was there
    to learn from. Rows are mapped where they lie: no shuffle.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x buckets doubles: fixed by parameters
    tag = uuid.uuid4().hex
    kept = docs.select(*keep)
    (own,) = free_names([*keep, *names], "_text")
    fields = [*pa_fields(kept), pa.field(names[0], pa.string()), pa.field(names[1], pa.float64())]
    schema = pa.schema(fields)
    ddl = T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_state(("scorer", tag), lambda: Scorer(shared.value)) as scorer:
            languages = scorer.model.languages
            for batch in batches:
                texts = texts_of(batch, own)
                for a, b in slices(texts):
                    if languages:
                        p, lettered = scorer.probabilities(texts[a:b])
                        top = p.argmax(1)
                        # a letterless chunk adds nothing; letters outside words can't be, so lettered is exact
                        lang = [languages[i] if ok else UNKNOWN for i, ok in zip(top.tolist(), lettered.tolist(), strict=True)]
                        score = np.where(lettered, p[np.arange(len(top)), top], 0.0)
                    else:
                        lang, score = [UNKNOWN] * (b - a), np.zeros(b - a)
                    rest = [batch.column(f.name).slice(a, b - a).cast(f.type) for f in fields[:-2]]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=schema)

    return docs.select(*keep, F.col("text").alias(own)).mapInArrow(predict, ddl)


def accepted(docs: DataFrame, threshold: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose predicted language has a calibrated score of at least ``threshold``, all columns kept.

    Letterless and null texts go. The model is fitted on the labelled rows of ``docs`` themselves.
    """
    model = fit_language_model(docs)
    names = docs.columns
    lang, score = free_names(names, "_lang_pred", "_score")
    scored = predict_language(docs, model, tuple(names), (lang, score))
    return scored.where((F.col(lang) != UNKNOWN) & (F.col(score) >= threshold)).select(*names)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those not held out; null and letterless texts are ``und`` with score 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs)
    out = predict_language(docs, model)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
