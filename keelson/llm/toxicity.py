"""Toxicity: a convolutional text classifier in numpy.

Words (lower-cased, cut at white space and ASCII punctuation) become the sum of
three hashed embeddings: of the whole word and of its first four and five
bytes, so that inflected forms share weight. Filters of widths 1 to 3 slide over the whole
text, max pooling keeps each filter's best place, a logistic unit joins them.

It is trained on a bounded sample of labelled rows: per class the
``sample`` rows with the smallest hash of their id. A fifth of the sample is
held back from fitting to calibrate one threshold per language; the language
is told from the text's own function words, so that nothing but the text goes
into a score. Scores are shifted so that 0.5 is the threshold of the text's
language.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm import common
from keelson.llm.words import _WS, chunks, hash_words

BITS, DIM, FILTERS, WIDTHS, PREFIXES = 17, 8, 8, (1, 2, 3), (4, 5)
PAD = max(WIDTHS) - 1
#: Frequent function words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for with are this from",
    "de": "der die und das den von zu mit dem nicht ein eine auf",
    "fr": "le la les et des un une du que dans pour est qui",
    "es": "el los las del que en por con una para se como al",
}
LANGUAGES = (*FUNCTION_WORDS, "other")
_GAPS = _WS.copy()
_GAPS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _language_table() -> np.ndarray:
    table = np.full(1 << BITS, len(FUNCTION_WORDS), np.uint8)
    for code, words in enumerate(FUNCTION_WORDS.values()):
        data = words.encode()
        hashed, *_ = hash_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _GAPS)
        table[hashed >> np.uint64(64 - BITS)] = code
    return table


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows (words, 1 + prefixes) of some texts and the index of each text's first word."""
    words, at, *heads = hash_words(data, offsets, _GAPS, PREFIXES)
    shift = np.uint64(64 - BITS)
    return np.stack([(x >> shift).astype(np.int32) for x in (words, *heads)], axis=1), at


@dataclass
class Model:
    table: np.ndarray  # rows of hashed embeddings
    filters: list[np.ndarray]  # per width (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # per language, on the logit

    @staticmethod
    def new(seed: int) -> Model:
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        return Model(
            np.zeros((1 << BITS, DIM), np.float32), [r.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.full(n, 0.01, np.float32), r.normal(0, 0.5, n).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)),
        )

    def pooled(self, rows: np.ndarray, at: np.ndarray, places: bool = False):
        """Pooled filter outputs of some texts; with ``places`` also what the backward pass needs."""
        texts = len(at) - 1
        count = np.diff(at)
        begin = at[:-1] + PAD * np.arange(texts)
        x = np.zeros((len(rows) + PAD * texts + PAD, DIM), np.float32)
        own = np.arange(len(rows)) + PAD * np.repeat(np.arange(texts), count)
        emb = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            emb += self.table[rows[:, k]]
        x[own] = emb
        n = len(x) - PAD
        outside = np.ones(n, bool)
        outside[own] = False
        z = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        for i, f in enumerate(self.filters):
            part = x[:n] @ f[0]
            for k in range(1, len(f)):
                part += x[k : n + k] @ f[k]
            z[:, i * FILTERS : (i + 1) * FILTERS] = part
        z[outside] = -np.inf
        top = np.maximum.reduceat(z, begin, axis=0) if texts else np.zeros((0, z.shape[1]), np.float32)
        top = np.maximum(np.where(np.isfinite(top), top + self.bias, 0), 0)
        if not places:
            return top
        ends = np.r_[begin[1:], n]
        best = np.stack([b + z[b:e].argmax(axis=0) for b, e in zip(begin, ends, strict=True)])
        back = np.full(len(x), -1)
        back[own] = np.arange(len(rows))
        return top, best, x, back

    def logits(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.pooled(rows, at) @ self.out + self.out_bias


def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


def warm(model: Model, texts: list[np.ndarray], labels: np.ndarray, smooth: float = 4.0) -> None:
    """Start the first embedding dimension from how much likelier a hashed row is in texts of class 1.

    Pooling passes a gradient to one place per filter only, so a start without
    this needs far more labelled texts to find the telling words.
    """
    share = np.zeros((2, len(model.table)))
    for t, y in zip(texts, labels, strict=True):
        share[int(y == 1), np.unique(t)] += 1
    rare = smooth / len(labels)
    share = [c / max(1, (labels == k).sum()) for k, c in enumerate(share)]
    model.table[:, 0] = 0.3 * np.log((share[1] + rare) / (share[0] + rare))
    for f in model.filters:
        f[:, 0] = np.abs(f[:, 0]) / len(f)
    model.out[:] = np.abs(model.out)


def fit(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 3, batch: int = 32, rate: float = 0.02, seed: int = 7) -> Model:
    """Adagrad on the logistic loss, both classes weighted alike; gradients reach the pooled places only."""
    model, r = Model.new(seed), np.random.default_rng(seed)
    if not len(labels):
        return model
    warm(model, texts, labels)
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    seen = np.full(model.table.shape, 1e-6, np.float32)
    past = [np.full(f.shape, 1e-6, np.float32) for f in [*model.filters, model.bias, model.out]]
    past_bias = 1e-6
    for _ in range(epochs):
        order = r.permutation(len(labels))
        for s in range(0, len(order), batch):
            pick = [k for k in order[s : s + batch] if len(texts[k])]
            if not pick:
                continue
            rows, at = _join([texts[k] for k in pick])
            top, best, x, back = model.pooled(rows, at, places=True)
            score = 1 / (1 + np.exp(-np.clip(top @ model.out + model.out_bias, -30, 30)))
            d = ((score - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            d_top = (d[:, None] * model.out) * (top > 0)
            steps = [np.zeros_like(f) for f in model.filters]
            ids, grads = [], []
            for i, f in enumerate(model.filters):
                cols = slice(i * FILTERS, (i + 1) * FILTERS)
                for k in range(len(f)):
                    at_k = best[:, cols] + k
                    steps[i][k] = np.einsum("bfd,bf->df", x[at_k], d_top[:, cols])
                    g = d_top[:, cols, None] * f[k].T[None]
                    words = back[at_k]
                    ok = words >= 0
                    ids.append(rows[words[ok]])
                    grads.append(g[ok])
            ids, grads = np.concatenate(ids), np.concatenate(grads)
            flat, grads = ids.reshape(-1), np.repeat(grads, ids.shape[1], axis=0)
            unique, where = np.unique(flat, return_inverse=True)
            total = np.zeros((len(unique), DIM), np.float32)
            np.add.at(total, where, grads)
            seen[unique] += total**2
            model.table[unique] -= rate * total / np.sqrt(seen[unique])
            for p, g, h in zip([*model.filters, model.bias, model.out], [*steps, d_top.sum(axis=0), top.T @ d], past, strict=True):
                h += g**2
                p -= 0.3 * rate * g / np.sqrt(h)
            past_bias += float(d.sum()) ** 2
            model.out_bias -= 0.3 * rate * float(d.sum()) / past_bias**0.5
    return model


def threshold(logits: np.ndarray, labels: np.ndarray) -> float | None:
    """The logit that divides the classes with the fewest errors (each class weighing alike), mid-gap; None without both."""
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    by = np.argsort(logits, kind="stable")
    x, y = logits[by], labels[by]
    miss = np.r_[0, np.cumsum(y == 1)] / (y == 1).sum() + 1 - np.r_[0, np.cumsum(y == 0)] / (y == 0).sum()
    cut = np.flatnonzero(miss <= miss.min() + 1e-12)
    low, high = cut[0], cut[-1]
    a = x[low - 1] if low else x[0] - 1
    b = x[high] if high < len(x) else x[-1] + 1
    return float((a + b) / 2)


def languages(rows: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    texts, kinds = len(at) - 1, len(LANGUAGES)
    codes = table[rows[:, 0]].astype(np.int64) + kinds * np.repeat(np.arange(texts), np.diff(at))
    counts = np.bincount(codes, minlength=texts * kinds).reshape(texts, kinds)[:, :-1]
    return np.where(counts.max(axis=1) > 0, counts.argmax(axis=1), kinds - 1)


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on four fifths, set one threshold per language on the rest (all rows where they are few)."""
    n = len(labels)
    hold = np.arange(n) % 5 == 4 if n >= 500 else np.zeros(n, bool)
    fitted = [t for t, h in zip(texts, hold, strict=True) if not h]
    model = fit(fitted, labels[~hold], epochs=3 if n > 2000 else 8, seed=seed)
    use = [t for t, h in zip(texts, hold, strict=True) if h or not hold.any()]
    if use:
        rows, at = _join(use)
        y, logits = labels[hold] if hold.any() else labels, model.logits(rows, at)
        lang = languages(rows, at, _language_table())
        common_cut = threshold(logits, y)
        for code in range(len(LANGUAGES)):
            own = lang == code
            cut = threshold(logits[own], y[own]) if (y[own] == 1).sum() >= 5 else None
            model.thresholds[code] = cut if cut is not None else common_cut if common_cut is not None else 0.0
    return model


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, data, offsets in chunks(batch.column(1)):
            rows, at = features(data, offsets)
            out += [rows[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["toxic", "words"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 7) -> Model:
    """Train on labelled rows whose crc32 of the id leaves a remainder by 5, at most ``sample`` of each class.

    Null ids or labels are left out; an id counts once, with the larger of clashing
    labels and the least of its texts. Training runs in one executor task over
    the bounded sample; only the model (4 MB) comes to the driver. Without rows
    no text is rejected.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where("id is not null and toxic in (0, 1) and crc32(cast(id as string)) % 5 <> 0").groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    picked = None
    for kind in (0, 1):
        part = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = part if picked is None else picked.union(part)
    chosen = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))  # 2 * sample rows
    words = chosen.select("toxic", "text").mapInArrow(_features_of, "toxic int, words binary")
    found = words.repartition(1).mapInArrow(_fit_one(seed), "model binary").collect()
    return pickle.loads(found[0].model) if found else train([], np.zeros(0, int), seed)


def _fit_one(seed: int):
    """All rows (toxic, words) of a bounded sample to one pickled model; its order does not depend on tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, w) for batch in batches for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if rows:
            order = np.random.default_rng(seed).permutation(len(rows))
            texts = [np.frombuffer(rows[k][1], np.int32).reshape(-1, 1 + len(PREFIXES)) for k in order]
            model = train(texts, np.array([rows[k][0] for k in order], int), seed)
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def _scores(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = model_of(), _language_table()
        for batch in batches:
            out = []
            for _, data, offsets in chunks(batch.column(batch.num_columns - 1)):
                rows, at = features(data, offsets)
                cut = model.thresholds[languages(rows, at, table)]
                out.append(1 / (1 + np.exp(-np.clip(model.logits(rows, at) - cut, -500, 500))))
            scores = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from its whole text. Null texts count as empty; ids may repeat or be null."""
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # 4 MB whatever the data
    rows = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_scores(lambda: pickle.loads(shared.value)), f"id {kind}, score double").withColumnRenamed("id", id_col)


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns."""
    model = learn(docs, labels, id_col=id_col, text_col=text_col)
    common.bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    marked = docs.select(F.struct(*docs.columns).alias("row"), common.text_or_empty(text_col).alias("text"))
    schema = f"row {docs.schema.simpleString()}, score double"
    return marked.mapInArrow(_scores(lambda: pickle.loads(shared.value)), schema).where("score < 0.5").select("row.*")
