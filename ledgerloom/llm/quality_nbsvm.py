"""Quality by a support vector machine on n-gram indicators scaled by class log-count ratios (NB-SVM).

An n-gram of a text is a hashed bucket (``2 ** BITS`` of them): its words and pairs of words, A-Z lower-cased, and runs
of one to three word shapes. A shape is a word with letters and digits replaced by their class, runs of a class
made one and bytes above ASCII left out, plus a mark if the word before is the same; shapes show symbols glued to words, capitals
and repetition whatever the words are.

1. ``ratios``: for each n-gram ``log((p + 1) / |p + 1|) - log((q + 1) / |q + 1|)``, where ``p`` and ``q`` count the sample texts of
   either label that have it (naive Bayes).
2. A text's vector has the ratio at each of its n-grams, scaled to length one, and a constant. ``fit`` minimises
   ``|w|^2 / 2 + C * sum of hinge losses`` by dual coordinate descent: one dual variable at a time, in a fixed random order.
   The sample is dealt into ``FOLDS`` folds; a task fits each, and the model is their mean.
3. Margins of sample texts under the other folds' models calibrate a logistic curve, weighted so that
   the labels count as often as they occur. It turns margins into scores.

The learning sample is bounded: at most ``MAX_ROWS`` labelled documents of either label, the first by a hash of the id,
without those of over ``MAX_CHARS`` characters. Ids that labels disagree on, and rows without an id or a label, are not learnt from.
Scores read every text whole; only the text is an input. A null or empty text has no n-gram and gets the curve's value at
the constant. Without texts of both labels every score is the share of label 1 (0 if there is none). Repeated rows
score alike; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bounded
from ledgerloom.llm.toxicity_zstd import held_out
from ledgerloom.llm.wordhash import mix, shingle_hashes, text_bytes, word_hashes, word_spans
from ledgerloom.runtime import cut

BITS = 18
MAX_ROWS = 12_000
MAX_CHARS = 40_000
FOLDS = 4
C = 1.0
EPOCHS = 40
TOLERANCE = 0.01
TEXTS = 512
SHAPES = 3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 57
_CLASS[65:91] = 65
_CLASS[97:123] = 97


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word's shape."""
    word = np.repeat(np.arange(len(start)), end - start)
    places = np.arange(len(word)) + np.repeat(start - (np.cumsum(end - start) - (end - start)), end - start)
    kinds = data[places]
    plain = kinds < 0x80
    kinds, word = _CLASS[kinds[plain]], word[plain]
    keep = np.ones(len(kinds), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | (word[1:] != word[:-1])
    kinds, word = kinds[keep], word[keep]
    bounds = np.searchsorted(word, np.arange(len(start) + 1))
    return word_hashes(kinds, bounds[:-1], bounds[1:], lower=False)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-gram buckets, ascending, and the texts' bounds in them."""
    data, offsets = text_bytes(texts)
    start, end, bounds = word_spans(data, offsets)
    words = word_hashes(data, start, end)
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    again[bounds[:-1][bounds[:-1] < len(words)]] = 0
    shapes = mix(_shapes(data, start, end) + again)
    found, owners = [], []
    kinds = [(words, 1), (words, 2), *((shapes, width) for width in range(1, SHAPES + 1))]
    for salt, (hashes, width) in enumerate(kinds, 1):
        # a text of fewer words has none of that width
        grams, owner = shingle_hashes(hashes, bounds, width)
        full = np.diff(bounds)[owner] >= width
        found.append(mix(grams[full] + np.uint64(salt)) >> np.uint64(64 - BITS))
        owners.append(owner[full].astype(np.uint64))
    both = np.sort((np.concatenate(owners) << np.uint64(BITS)) | np.concatenate(found))
    keep = np.ones(len(both), bool)
    keep[1:] = both[1:] != both[:-1]
    both = both[keep]
    limits = np.searchsorted(both, np.arange(len(offsets), dtype=np.uint64) << np.uint64(BITS))
    return (both & np.uint64((1 << BITS) - 1)).astype(np.uint32), limits


def ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Log-count ratios from the numbers of texts of either label that have each n-gram."""
    p, q = positive + 1.0, negative + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int) -> np.ndarray:
    """Weights of the hinge-loss model by dual coordinate descent; the last one belongs to the constant.

    ``rows`` are n-gram buckets, ``y`` labels of -1 and 1. Ends when no dual variable violates its
    condition by over ``TOLERANCE`` or after ``EPOCHS`` passes.
    """
    values = []
    for row in rows:
        x = ratio[row]
        length = np.sqrt((x * x).sum())
        values.append(x / length if length > 0 else x)
    square = np.array([(x * x).sum() + 1 for x in values])
    weights, constant = np.zeros(len(ratio)), 0.0
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            row, x = rows[i], values[i]
            slope = y[i] * (weights[row] @ x + constant) - 1
            # the part of the slope that the box 0 <= dual <= C leaves
            free = min(slope, 0.0) if dual[i] <= 0 else max(slope, 0.0) if dual[i] >= C else slope
            worst = max(worst, abs(free))
            if free:
                moved = min(max(dual[i] - slope / square[i], 0.0), C)
                step = (moved - dual[i]) * y[i]
                weights[row] += step * x
                constant += step
                dual[i] = moved
        if worst <= TOLERANCE:
            break
    return np.append(weights, constant)


def margins(buckets: np.ndarray, bounds: np.ndarray, ratio: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The model's value for each text."""
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in ((weights[:-1] * ratio)[buckets], (ratio * ratio)[buckets])]
    dot, square = (s[bounds[1:]] - s[bounds[:-1]] for s in sums)
    fine = square > 1e-12
    return np.where(fine, dot / np.sqrt(np.where(fine, square, 1.0)), 0.0) + weights[-1]


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the weighted logistic curve from margins to labels, the slope held above zero by a prior."""
    x = np.column_stack([margin, np.ones(len(margin))])
    beta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    ridge = np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (label - p)) - ridge @ (beta - prior))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _buckets_of(column: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for value in batch.column(column):
            yield np.frombuffer(value.as_py(), np.uint32).astype(np.int64)

    return run


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(y, fold, grams) of the sample, written, and how many ids each label has.

    Ids are drawn first and sent to all tasks, so texts are not shuffled.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("y"), F.max("label").alias("top"))
    known = cut(known.where("y = top").select("doc_id", "y", F.xxhash64("doc_id").alias("pick")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    parts = [known.where(F.col("y") == y).orderBy("pick").limit(MAX_ROWS) for y in (0, 1)]
    drawn = parts[0].unionByName(parts[1]).select("doc_id", "y", F.pmod(F.hash("pick"), F.lit(FOLDS)).alias("fold"))
    texts = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_CHARS).join(F.broadcast(drawn), "doc_id").select("y", "fold", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded.text_slices(batch, "text", TEXTS):
                buckets, bounds = ngrams(part.column(2))
                grams = [buckets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(grams, pa.binary())], names=["y", "fold", "grams"])

    return cut(texts.mapInArrow(run, "y int, fold int, grams binary")), counts


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from ``docs`` (doc_id, text) that ``labels`` (doc_id, label 0 or 1) labels."""
    spark = docs.sparkSession
    rows, counts = _sample(docs, labels)
    sampled = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sampled) < 2:
        return {"prior": float(bool(sampled.get(1)))}
    by_label = [bounded.bucket_counts(rows.where(F.col("y") == y).select("grams"), _buckets_of(0), BITS) for y in (1, 0)]
    ratio = ratios(*by_label)
    sent = spark.sparkContext.broadcast(ratio)

    def fit(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, y = [], []
        for batch in batches:
            listed += [np.frombuffer(g.as_py(), np.uint32) for g in batch.column(2)]
            y += batch.column(0).to_pylist()
        # an order that does not depend on how the rows arrived
        order = sorted(range(len(y)), key=lambda i: (y[i], listed[i].tobytes()))
        weights = descend([listed[i] for i in order], np.array([2.0 * y[i] - 1 for i in order]), sent.value, key[0].as_py())
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([weights.astype(np.float32).tobytes()], pa.binary())], names=["fold", "weights"]
        )

    fitted = rows.groupBy("fold").applyInArrow(fit, "fold int, weights binary").collect()
    models = {r["fold"]: np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in fitted}
    others = {k: np.mean([w for j, w in models.items() if j != k] or [models[k]], axis=0) for k in models}
    sent_models = spark.sparkContext.broadcast(others)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for fold, grams in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                row = np.frombuffer(grams, np.uint32)
                found.append(margins(row, np.array([0, len(row)]), sent.value, sent_models.value[fold])[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["y", "margin"])

    seen = sorted((r["y"], r["margin"]) for r in rows.mapInArrow(judged, "y int, margin double").collect())
    y, margin = (np.array(c, np.float64) for c in zip(*seen, strict=True))
    weight = np.where(y == 1, counts[1] / sampled[1], counts[0] / sampled[0])
    slope, constant = calibrate(margin, y, weight)
    return {"ratio": ratio, "weights": np.mean(list(models.values()), axis=0), "curve": (slope, constant)}


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text): 0 to 1, from whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in bounded.text_slices(batch, "text", TEXTS):
                if "prior" in known:
                    found = np.full(part.num_rows, known["prior"])
                else:
                    value = margins(*ngrams(part.column(1)), known["ratio"], known["weights"])
                    found = 1 / (1 + np.exp(-np.clip(known["curve"][0] * value + known["curve"][1], -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; ``labels`` (doc_id, quality) label some."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    learnt = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    found = scores(docs, learn(docs, learnt))
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
