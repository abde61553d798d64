"""Secret scans: a random forest tells secrets from strings that only look like them.

``scan`` lists every candidate of every text with the forest's score, ``redact`` replaces the
candidates that score ``THRESHOLD`` or more by ``PLACEHOLDER`` and changes nothing else.

A candidate is a run of at least ``SHORTEST`` characters of keys and encodings that has a digit, changes
between capital and small letters, or has a provider's form; every value assigned to one of ``KEY_NAMES``,
of any length and characters, up to its closing quote or white space; what follows "Bearer"; and the password of an address. Runs within
such a value are part of it. The forest sees its length and make-up, how its
characters follow each other, how much of it is covered by letter triples that are usual in the corpus
(counted over all texts), signs of a path, an address, a reference or a placeholder, and the words beside it.

It learns from labelled findings: a table of candidates with a label, or, by default, ``planted`` ones. Those are written
between words of the corpus: secrets of many forms, assigned or by themselves, and look-alikes: references to
variables, placeholders, words of prose after a key's name, numbers, digests, identifiers, paths. Their labels are known by
construction and read from no feature, and no rule decides beside the forest. At most ``MAX_FINDINGS`` of each label, the first by a hash, are used, and the words
come from the starts of at most ``CONTEXT_TEXTS`` texts; that is the only sample. Trees are grown in parallel, each on its own draw. Given findings
without both labels teach nothing: then the planted ones are used.

A null text has no candidates, and stays null in ``redact``. Offsets are in code points, ends excluded.
Repeated rows are scanned each. ``redact`` keeps all columns, whatever their names. Empty tables give
empty results.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bounded
from ledgerloom.llm.wordhash import text_bytes

SHORTEST = 16
THRESHOLD = 0.5
PLACEHOLDER = "[SECRET]"
MAX_FINDINGS = 10_000
PLANTED = 4000
CONTEXT_TEXTS = 256
CONTEXT_CHARS = 4000
TREES = 48
DEPTH = 8
SEED = 5

# Names under which secrets are assigned, and forms that providers give them.
KEY_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "bearer", "private_key", "passphrase")
PROVIDER = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{20,}")
# What stands for a value that is not given, and how variables are referred to.
PLACEHOLDERS = frozenset(
    "none null nil true false yes no changeme change_me example sample test todo tbd required optional redacted hidden undefined default placeholder "
    "password passwd secret token string value unknown empty mypassword your_password yourpassword".split()
)
REFERENCE = re.compile(r"\$\{?[A-Za-z_]|\{\{|<[^>]*>?$|%[A-Za-z_]+%|(?:os\.environ|process\.env|getenv|ENV|config|settings|secrets)[.(\[]")
DIGESTS = ("sha", "md5", "commit", "checksum", "uuid", "etag", "digest")

_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
# a name by itself, or a part of one: db_password, clientSecret, token_id, but not author
_ASSIGNED = re.compile(
    rf"(?:(?<![A-Za-z])(?i:{'|'.join(KEY_NAMES)})|(?<=[a-z0-9])(?:{'|'.join(k.capitalize() for k in KEY_NAMES)}|ApiKey|AccessKey))(?![A-Za-z])"
    r"(?:[_-][A-Za-z0-9]{1,16}){0,3}+[\"']?[ \t]{0,8}(?:=>|[=:]{1,2})[ \t]{0,8}"
    r"(?:\"(?P<double>[^\"\r\n]+)\"|'(?P<single>[^'\r\n]+)'|[\"']?(?P<bare>[^\s\"']+))"
)
_CARRIED = re.compile(r"(?i:\bbearer)[ \t]{1,4}([A-Za-z0-9._~+/-]{8,}={0,2})|(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s:/@\"']{1,64}:([^\s@/\"']{1,128})@")
_BEFORE = re.compile(r"([^\s=:\"']*)[\"']?\s*((?:=>|[=:]{1,2})?)\s*[\"']?$")
_CONTEXT = 48
NAMES = (
    "length", "digits", "capitals", "small", "others", "changes", "entropy", "longest_digits", "hex_only", "distinct",
    "coverage", "usual", "assigned", "quoted", "key_name", "digest_name", "path", "slashes", "before_usual", "after_usual",
    "before_length", "after_length", "ends_text", "letters_only", "lower_word", "placeholder", "reference", "provider", "repeated", "carried",
)

_KIND = np.full(256, 28, np.int64)
_KIND[ord("a") : ord("z") + 1] = np.arange(26)
_KIND[ord("A") : ord("Z") + 1] = np.arange(26)
_KIND[ord("0") : ord("9") + 1] = 26
_KIND[[9, 10, 11, 12, 13, 32]] = 27


def _triples(data: np.ndarray) -> np.ndarray:
    kinds = _KIND[data]
    return (kinds[:-2] << 10) | (kinds[1:-1] << 5) | kinds[2:] if len(kinds) > 2 else np.zeros(0, np.int64)


def triple_weights(docs: DataFrame) -> np.ndarray:
    """How usual each triple of character kinds is in all texts: log of its count over the mean count."""

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in bounded.text_slices(batch, "text", 1 << 20):
            data, offsets = text_bytes(part.column(0))
            within = np.ones(max(0, len(data) - 2), bool)
            for back in (1, 2):
                # not from one text into the next
                at = offsets[1:-1] - back
                within[at[(at >= 0) & (at < len(within))]] = False
            yield _triples(data)[within]

    counts = bounded.bucket_counts(docs.select("text"), buckets, 15).astype(float)
    return np.log((counts + 0.5) / (counts.mean() + 0.5)).astype(np.float32)


def _usual(text: str, weights: np.ndarray) -> tuple[float, float]:
    """Share of a string's triples that are usual in the corpus, and their mean weight."""
    triples = _triples(np.frombuffer(text.encode(), np.uint8))
    if not len(triples):
        return 0.0, 0.0
    own = weights[triples]
    return float((own > 0).mean()), float(own.mean())


def assigned(text: str) -> Iterator[tuple[int, int]]:
    """Values that are assigned to a name of ``KEY_NAMES``, or carried by a header or an address."""
    low = text.lower()
    spans = []
    if any(k in low for k in KEY_NAMES):
        spans += [m.span(m.lastgroup) for m in _ASSIGNED.finditer(text)]
    if "bearer" in low or "://" in text:
        spans += [m.span(m.lastindex) for m in _CARRIED.finditer(text)]
    end = 0
    for a, b in sorted(spans):
        if a >= end:
            yield a, b
            end = b


def candidates(text: str) -> Iterator[tuple[int, int]]:
    values = list(assigned(text))
    at = 0
    for m in _RUN.finditer(text):
        while at < len(values) and values[at][1] <= m.start():
            yield values[at]
            at += 1
        if at < len(values) and values[at][0] < m.end():
            continue
        run = m.group()
        mixed = re.search("[A-Z]", run[1:]) and re.search("[a-z]", run)
        if mixed or any("0" <= c <= "9" for c in run) or PROVIDER.fullmatch(run):
            yield m.span()
    yield from values[at:]


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    """Word before, sign of an assignment between, word after."""
    m = _BEFORE.search(text[max(0, start - _CONTEXT) : start])
    after = text[end : end + _CONTEXT].lstrip("\"' \t\r\n").split(None, 1)
    return m.group(1)[-_CONTEXT:].lower(), m.group(2), (after[0] if after else "")


def features(text: str, start: int, end: int, weights: np.ndarray) -> list[float]:
    run = text[start:end]
    n = len(run)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in run]
    counts, chars = Counter(kinds), Counter(run)
    before, sign, after = _context(text, start, end)
    coverage, usual = _usual(run, weights)
    return [
        n, counts["d"] / n, counts["u"] / n, counts["l"] / n, counts["o"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        -sum(c / n * math.log2(c / n) for c in chars.values()),
        max((len(x) for x in re.findall("[0-9]+", run)), default=0), float(bool(re.fullmatch("[0-9a-fA-F]+", run))), len(chars) / n,
        coverage, usual, float(bool(sign)), float(text[max(0, start - 1) : start] in ("'", '"')),
        float(any(k in before for k in KEY_NAMES)), float(any(k in before for k in DIGESTS)),
        float(text[max(0, start - 1) : start] in ("/", "\\", ".", "@") or text[end : end + 1] in ("/", "\\", "@")),
        run.count("/") / n, _usual(before, weights)[1], _usual(after, weights)[1], len(before), len(after), float(end == len(text)),
        float(run.isalpha()), float(run.strip(".,;:!?()").isalpha() and run[1:].islower()), float(run.strip("<>[]().,;").lower() in PLACEHOLDERS),
        float(bool(REFERENCE.match(run))), float(bool(PROVIDER.fullmatch(run))), max(chars.values()) / n, float(before == "bearer" or text[end : end + 1] == "@"),
    ]


def _some(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_HEX = "0123456789abcdef"
_ALNUM = _LETTERS + _LETTERS.upper() + "0123456789"


def _secret(rng: random.Random, words: list[str]) -> tuple[str, bool]:
    """A made-up secret, and whether it is one without a name that it is assigned to."""
    word = lambda: rng.choice(words)
    kind = rng.randrange(10)
    if kind < 2:
        form = rng.randrange(6)
        upper = _LETTERS.upper() + "0123456789"
        return (
            rng.choice(["AKIA", "ASIA"]) + _some(rng, upper, 16, 16) if form == 0 else f"gh{rng.choice('pousr')}_{_some(rng, _ALNUM, 36, 40)}" if form == 1
            else f"xoxb-{_some(rng, '0123456789', 10, 12)}-{_some(rng, _ALNUM, 20, 24)}" if form == 2 else f"sk_live_{_some(rng, _ALNUM, 20, 28)}" if form == 3
            else f"AIza{_some(rng, _ALNUM + '_-', 35, 35)}" if form == 4 else f"eyJ{_some(rng, _ALNUM, 30, 90)}"
        ), True
    return [
        lambda: _some(rng, _HEX, 16, 64),
        lambda: _some(rng, _ALNUM + "+/", 16, 48) + rng.choice(["", "", "="]),
        lambda: word().capitalize() + _some(rng, "0123456789", 1, 5) + rng.choice(["", "!", "#", "$", "&x"]),
        lambda: _some(rng, _ALNUM, 8, 20),
        lambda: rng.choice(["", "-", "_"]).join(word() for _ in range(4)).lower()[:40],
        lambda: word()[:1] + _some(rng, _LETTERS + "0123456789@!%&", 5, 14) + str(rng.randrange(10)),
        lambda: str(rng.randrange(10**4, 10**8)) + word().lower(),
        lambda: f"{word().lower()} {word().lower()}{rng.choice('!?#1234567890')}",
    ][kind - 2](), False


def _look_alike(rng: random.Random, words: list[str]) -> tuple[str, str | None]:
    """Something that is no secret, with the text before it; None where a key's name and a sign belong there."""
    word = lambda: rng.choice(words)
    name = (word() + "_" + word()).upper()[:20]
    return [
        lambda: (rng.choice([f"${name}", f"${{{name}}}", f"<{word()}>", f"%{name}%", f"{{{{{word()}}}}}", f"process.env.{name}", f"os.environ[{name}]"]), None),
        lambda: (rng.choice([*sorted(PLACEHOLDERS), "x" * rng.randint(3, 12), "*" * rng.randint(3, 12), "..."]), None),
        lambda: (word().lower() + rng.choice(["", "", ".", ","]), None),
        lambda: (word().lower(), None),
        lambda: (_some(rng, "0123456789", 16, 20), ""),
        lambda: (_some(rng, _HEX, 32, 64), rng.choice(DIGESTS) + rng.choice([" ", ":", "=", " = ", ": "])),
        lambda: ("-".join(_some(rng, _HEX, n, n) for n in (8, 4, 4, 4, 12)), rng.choice(["", "uuid ", "id="])),
        lambda: ("".join(word().capitalize() for _ in range(rng.randint(2, 4))), ""),
        lambda: ("_".join(word().lower() for _ in range(3)) + str(rng.randrange(10)), ""),
        lambda: ("/" + "/".join(word().lower() for _ in range(4)) + str(rng.randrange(10)), rng.choice(["", "file ", "https://example.org"])),
        lambda: (word().lower() + "-" + "-".join(word().lower() for _ in range(3)) + f"-{rng.randrange(1000, 3000)}", "/"),
    ][rng.randrange(11)]()


def planted(words: list[str], weights: np.ndarray, many: int = PLANTED, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of made-up findings between ``words``, about as many of either label."""
    rng = random.Random(seed)
    words = [w for w in words if w.isalpha()] or ["word"]
    rows, labels = [], []
    while len(rows) < many:
        label = len(rows) % 2
        value, before = _secret(rng, words) if label else _look_alike(rng, words)
        if (label and (not before or rng.random() < 0.5)) or before is None:
            name = rng.choice(["", "", "db_", "my-", f"{rng.choice(words).lower()}_"]) + rng.choice(KEY_NAMES)
            name = rng.choice([name, name.upper(), name.capitalize()])
            before = name + rng.choice(["=", " = ", ": ", ":", " := ", " => ", "="])
        elif label:
            before = rng.choice(["", "", "Bearer ", "key ", f"{rng.choice(words)}: "])
        quote = rng.choice(["", "", '"', "'"]) if before.endswith(("=", " ", ":")) and "$" not in value else ""
        quote = "'" if " " in value and label else quote
        left, right = (" ".join(rng.choice(words) for _ in range(6)) for _ in range(2))
        text = f"{left} {before}{quote}{value}{quote}{rng.choice([' ', ' ', '. ', chr(10)])}{right}"
        at = len(left) + 1 + len(before) + len(quote)
        # as the scan cuts it, if it takes it for a candidate at all
        spans = [(a, b) for a, b in candidates(text) if a < at + len(value) and b > at]
        rows.append(features(text, *(spans[0] if spans else (at, at + len(value))), weights))
        labels.append(label)
    return np.array(rows, float), np.array(labels, float)


def context_words(docs: DataFrame) -> list[str]:
    """Words of the starts of a bounded number of texts, the first by a hash; hashes are drawn before any text is read out."""
    texts = docs.where(F.length("text") > 0).select(F.substring("text", 1, CONTEXT_CHARS).alias("start"), F.xxhash64("text").alias("pick"))
    picks = [r["pick"] for r in texts.select("pick").distinct().orderBy("pick").limit(CONTEXT_TEXTS).collect()]
    rows = texts.where(F.col("pick").isin(picks)).groupBy("pick").agg(F.min("start").alias("start")).collect() if picks else []
    return sorted({w.strip(".,;:!?()|") for r in rows for w in r["start"].split()} - {""})


def findings(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, start, end, pick, features) of every candidate; ``pick`` orders a sample."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                for a, b in candidates(text):
                    pick = zlib.crc32(f"{text[a:b]}:{text[max(0, a - 16):a]}".encode())
                    rows.append((doc_id, a, b, pick, features(text, a, b, sent.value)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "end", "pick", "features"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, start long, end long, pick long, features array<double>")


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """One tree as rows (feature or -1, threshold, left, right, share of label 1)."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at, share = len(nodes), float(y[rows].mean())
        nodes.append((-1, 0.0, 0, 0, share))
        if depth == DEPTH or len(rows) < 4 or share in (0.0, 1.0):
            return at
        best = (1e-9, -1, 0.0)
        gini = share * (1 - share)
        for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
            values = x[rows, f]
            for cut_at in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 15))):
                left = values <= cut_at
                n = int(left.sum())
                if 0 < n < len(rows):
                    p, q = y[rows][left].mean(), y[rows][~left].mean()
                    gain = gini - (n * p * (1 - p) + (len(rows) - n) * q * (1 - q)) / len(rows)
                    best = max(best, (float(gain), int(f), float(cut_at)))
        if best[1] < 0:
            return at
        left = x[rows, best[1]] <= best[2]
        a, b = build(rows[left], depth + 1), build(rows[~left], depth + 1)
        nodes[at] = (best[1], best[2], a, b, share)
        return at

    build(np.arange(len(y)), 0)
    return nodes


def train(docs: DataFrame, weights: np.ndarray, labelled: DataFrame | None = None) -> list[np.ndarray]:
    """The forest, from the rows of ``labelled`` (doc_id, start, pick, label, features), else from planted findings."""
    spark, parts = docs.sparkSession, [[]]
    if labelled is not None:
        firsts = labelled.where("label is not null").groupBy("pick", "label").agg(F.min(F.struct("doc_id", "start", "end", "features")).alias("first"))
        firsts = firsts.select("pick", "label", "first.features")
        parts = [firsts.where(F.col("label") == v).orderBy("pick").limit(MAX_FINDINGS).collect() for v in (0, 1)]
    if all(parts):
        x = np.array([r["features"] for p in parts for r in p], float)
        y = np.array([r["label"] for p in parts for r in p], float)
    else:
        x, y = planted(context_words(docs), weights)
    sent = spark.sparkContext.broadcast((x, y))

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = sent.value
        for frame in frames:
            for tree in frame["id"]:
                rng = np.random.default_rng([SEED, int(tree)])
                # as many of either label, so that a rare label counts
                rows = np.concatenate([rng.choice(np.flatnonzero(y == v), min(len(y), 2000)) for v in (0, 1)])
                yield pd.DataFrame({"tree": [tree], "nodes": [np.array(_grow(x[rows], y[rows], rng), float).tobytes()]})

    trees = spark.range(TREES).repartition(TREES).mapInPandas(grow, "tree long, nodes binary").orderBy("tree").collect()
    return [np.frombuffer(t["nodes"], float).reshape(-1, 5) for t in trees]


def score(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            feature = tree[at, 0].astype(np.int64)
            left = x[np.arange(len(x)), np.maximum(feature, 0)] <= tree[at, 1]
            at = np.where(feature < 0, at, np.where(left, tree[at, 2], tree[at, 3]).astype(np.int64))
        total += tree[at, 4]
    return total / max(1, len(forest))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, score, is_secret) of every candidate in ``docs`` (doc_id, text).

    ``labelled`` holds findings as ``findings`` lists them, with their labels; by default planted ones teach the forest.
    """
    weights = triple_weights(docs)
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, weights, labelled))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["score"] = score(sent.value, np.array(frame["features"].tolist(), float).reshape(-1, len(NAMES))).round(6)
            frame["is_secret"] = frame["score"] >= THRESHOLD
            yield frame[["doc_id", "start", "end", "score", "is_secret"]]

    return findings(docs, weights).select("doc_id", "start", "end", "features").mapInPandas(
        run, "doc_id long, start long, end long, score double, is_secret boolean"
    )


def redact(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; everything else unchanged."""
    weights = triple_weights(docs)
    sent = docs.sparkSession.sparkContext.broadcast((weights, train(docs, weights, labelled)))

    def clean(text: str | None) -> str | None:
        weights, forest = sent.value
        spans = list(candidates(text)) if text else []
        if not spans:
            return text
        scores = score(forest, np.array([features(text, a, b, weights) for a, b in spans], float))
        out, at = [], 0
        for (a, b), own in zip(spans, scores.round(6), strict=True):
            if own >= THRESHOLD:
                out += [text[at:a], PLACEHOLDER]
                at = b
        return "".join([*out, text[at:]])

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t.as_py()) for t in batch.column(place)], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    # names of its own for the way through Python, which does not take every name
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
