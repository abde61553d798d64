"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

``train`` builds one dictionary from ordinary texts and one from what toxic texts add to them (windows
that ``MIN_TEXTS`` toxic sample texts have, over ``RATIO`` times as often as ordinary ones), and calibrates
a logistic curve on sample texts that the dictionaries in use have not seen. ``scores`` then goes through every window of every text.

A window is a word, lower case, cut at ``WINDOW`` bytes. Each is compressed between two copies of a frame
that ends both dictionaries: without it zstandard stores so short an input uncompressed and no
difference would show. The difference of the two lengths, in bytes, is the window's evidence; a text
is described by its strongest windows and the shares of windows above a few limits.

The learning sample is bounded: at most ``MAX_TOXIC`` and ``MAX_ORDINARY`` labelled documents, the first by
a hash of the id, without those of over ``MAX_CHARS`` characters. Only the text is an input of the score.
A null or empty text has no windows and gets the curve's value for none. Rows without a label take no
part in learning. Without texts of both labels every score is the share of toxic sample texts (0 if
there is none). Repeated rows score alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOXIC = 2400
MAX_ORDINARY = 6000
MAX_CHARS = 40_000
MIN_TEXTS = 3
RATIO = 10
FOLDS = 3
WINDOW = 48
TOXIC_BYTES = 8192
ORDINARY_BYTES = 65536
LEVEL = 9
MEMO = 200_000
LIMITS = (2, 3, 4)
FRAME = bytes(range(0x81, 0xF9, 5))


def windows(text: str) -> list[bytes]:
    out = []
    for word in text.lower().encode("utf-8", "replace").split():
        out += [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word), WINDOW)]
    return out


class Distance:
    """Difference of a window's compressed lengths, remembered for windows that come again."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self._pair = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(d + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            for d in (ordinary, toxic)
        ]
        self._memo: dict[bytes, int] = {}

    def __call__(self, window: bytes) -> int:
        known = self._memo.get(window)
        if known is None:
            framed = b"%b %b %b" % (FRAME, window, FRAME)
            a, b = (len(c.compress(framed)) for c in self._pair)
            if len(self._memo) >= MEMO:
                self._memo.clear()
            known = self._memo[window] = a - b
        return known

    def describe(self, text: str) -> np.ndarray:
        found = np.array([self(w) for w in windows(text)], np.float64)
        n = len(found)
        top = np.zeros(5)
        top[: min(n, 5)] = np.sort(np.partition(found, n - 5)[n - 5 :] if n > 5 else found)[::-1]
        above = [int((found >= limit).sum()) for limit in LIMITS]
        return np.array([
            top[0], top[1], top[2], top[4], top.mean(), *[100 * a / max(n, 1) for a in above], *np.log1p(above), np.log1p(n)
        ])


def _dictionary(samples: list[bytes], size: int, k: int) -> bytes:
    samples = [s for s in samples if len(s) > 8]
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 4)), samples, k=k, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        # too few samples to choose from: what there is, as it is
        return b" ".join(samples)[-size:]


def _dictionaries(toxic: list[str], ordinary: list[str]) -> dict:
    counts = [Counter(w for t in texts for w in set(windows(t))) for texts in (toxic, ordinary)]
    rate = RATIO * len(toxic) / len(ordinary)
    telling = {w: n for w, n in counts[0].items() if n > rate * counts[1][w]}
    least = MIN_TEXTS if any(n >= MIN_TEXTS for n in telling.values()) else 1
    # each as often as it occurs, in a fixed random order, as lines of a dozen
    drawn = np.array([w for w, n in sorted(telling.items()) if n >= least for _ in range(n)] or [b"-"], object)
    np.random.default_rng(3).shuffle(drawn)
    lines = [b" " + b" ".join(drawn[i : i + 12]) + b" " for i in range(0, len(drawn), 12)]
    usual = [b" ".join(windows(t)) for t in ordinary]
    return {"ordinary": _dictionary(usual, ORDINARY_BYTES, 32), "toxic": _dictionary(lines, TOXIC_BYTES, 16)}


def train(toxic: list[str], ordinary: list[str]) -> dict:
    """Dictionaries and curve from texts of either label.

    The curve is fitted on the texts that each of ``FOLDS`` pairs of dictionaries has not seen; the
    dictionaries used later are trained on all.
    """
    if not toxic or not ordinary:
        return {"prior": float(bool(toxic))}
    folds = min(FOLDS, len(toxic), len(ordinary))
    x, y = [], []
    for fold in range(folds if folds > 1 else 0):
        own = _dictionaries(*[[t for i, t in enumerate(texts) if i % folds != fold] for texts in (toxic, ordinary)])
        distance = Distance(own["ordinary"], own["toxic"])
        for label, texts in ((1.0, toxic), (0.0, ordinary)):
            x += [distance.describe(t) for t in texts[fold::folds]]
            y += [label] * len(texts[fold::folds])
    model = _dictionaries(toxic, ordinary)
    if not x:
        distance = Distance(model["ordinary"], model["toxic"])
        x, y = [distance.describe(t) for t in (*toxic, *ordinary)], [1.0] * len(toxic) + [0.0] * len(ordinary)
    x, y = np.array(x), np.array(y)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = x.T @ (y - p) - ridge @ weights
        weights += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, step)
    return model | {"mean": mean, "spread": spread, "weights": weights}


def scorer(model: dict):
    if "prior" in model:
        return lambda text: model["prior"]
    distance = Distance(model["ordinary"], model["toxic"])

    def score(text: str) -> float:
        x = (distance.describe(text) - model["mean"]) / model["spread"]
        return float(1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30))))

    return score


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The model from ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) labels.

    Ids are drawn first, a bounded number per label, and sent to all tasks, so texts are not shuffled;
    the texts that are drawn go to the driver, nothing else.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.length("text") <= MAX_CHARS)
    parts = []
    for label, most in ((1, MAX_TOXIC), (0, MAX_ORDINARY)):
        ids = labels.where(F.col("toxic") == label).select("doc_id").distinct()
        drawn = ids.select("doc_id", F.xxhash64("doc_id").alias("pick")).orderBy("pick").limit(most)
        rows = texts.join(F.broadcast(drawn), "doc_id").select("pick", "text").collect()
        # ascending picks are a random order; a text counts once
        parts.append(list(dict.fromkeys(r["text"] for r in sorted(rows, key=lambda r: (r["pick"], r["text"])))))
    return train(*parts)


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text): 0 to 1, from whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            found = [score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; ``labels`` (doc_id, toxic) label some."""
    learnt = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), "toxic")
    found = scores(docs, learn(docs, learnt))
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
