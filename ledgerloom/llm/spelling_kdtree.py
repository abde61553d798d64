"""Spelling variants: k-d trees over letter counts find the words one edit away.

``word_counts`` counts the words of all texts; ``variants`` relates words that differ by exactly one inserted, deleted
or replaced code point. Such words have letter counts that differ by one letter more on one side (lengths differ by one) or one more
on either side (equal lengths), so their L1 distance is at most two. Per length, a k-d tree splits words by letter counts;
a word asks the trees of its own length and of the lengths next to it, each with the letters that it may
gain and lose, and skips every box out of that reach.

1. The tree of a length is laid out from a sample (``PER_CELL`` words a cell, drawn by hash) until its leaves hold about
   ``CELL`` words; leaves are cells. The sample decides only where words go, never what is found.
2. Each word goes to the cell that holds it, and as a visitor to all others in its reach. A task builds a tree with leaves
   of ``LEAF`` distinct count vectors over a cell, searches it for all that came, and verifies the letter order
   of what is in reach.
3. A word is in one cell only, so each pair is seen once from either side; tasks return per word and cell a number of
   near words and the best of them, never the pairs.
4. ``roots`` follows forms to the last by pointer jumping. A form occurs at least twice as often as its word, so the logarithm of
   the largest count bounds the rounds.

Words are bytes of UTF-8; order by bytes is order by code points. The number of cells is words / ``CELL``, which is what
travels to every task as a tree. A null text has no words; a null id counts as an empty one. Rows that repeat
count again. Very long texts are read through, very long words are words. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import cut

MIN_LENGTH = 5
MIN_COUNT = 3
TYPO = 97
CELL = 2048
PER_CELL = 48
LEAF = 32
CHUNK = 4096
LETTERS = 26 + 64
FLUSH = 200_000
LONG_TEXT = 4 << 20
BYTES = 4 << 20

_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: letters that a word may (gain, lose) to become a near word of a length that many code points longer
_REACH = {-1: (0, 1), 0: (1, 1), 1: (1, 0)}


def without(word: bytes, h: int) -> bytes:
    """``word`` without its code point ``h % length``."""
    if word.isascii():
        at = h % len(word)
        return word[:at] + word[at + 1 :]
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _words_of(text: bytes) -> Counter:
    lower = text.lower()
    if len(lower) > LONG_TEXT:
        return Counter(m.group() for m in _RUN.finditer(lower))
    return Counter(_RUN.findall(lower))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) that are long and frequent enough, with typos planted by crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
                for word, n in _words_of(text.as_py() or b"").items():
                    # bytes are at least as many as code points
                    if len(word) >= MIN_LENGTH:
                        h = zlib.crc32(word, start)
                        if h % TYPO == 0:
                            word = without(word, h)
                        total[word] = total.get(word, 0) + n
                if len(total) > FLUSH:
                    yield flushed()
                    total.clear()
        yield flushed()

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = texts.mapInArrow(run, "word string, n long").where(F.length("word") >= MIN_LENGTH)
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words one after the other, and the words' bounds."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26), bounds


def _vectors(words: list[str]) -> np.ndarray:
    """(words, letters) counts."""
    letters, bounds = _letters(words)
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    return np.bincount(owner * LETTERS + letters, minlength=len(words) * LETTERS).astype(np.int32).reshape(len(words), LETTERS)


class Tree:
    """A k-d tree over count vectors. ``search`` gives each leaf with the queries in whose reach its box lies."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.leaves: list[np.ndarray] = []
        self._top = self._split(points, np.arange(len(points)), leaf)

    def _split(self, points: np.ndarray, rows: np.ndarray, leaf: int):
        """A leaf's number, or (letter, most on the left, left, right)."""
        if len(rows) > leaf:
            own = points[rows]
            middle = np.partition(own, len(rows) // 2, axis=0)[len(rows) // 2]
            # counts are small, so the middle itself may stand on either side
            sides = np.stack([(own < middle).sum(axis=0), (own <= middle).sum(axis=0)])
            even = np.minimum(sides, len(rows) - sides)
            upper, letter = np.unravel_index(int(even.argmax()), even.shape)
            if even[upper, letter] > 0:
                most = int(middle[letter]) - 1 + int(upper)
                left = own[:, letter] <= most
                return int(letter), most, self._split(points, rows[left], leaf), self._split(points, rows[~left], leaf)
        self.leaves.append(rows)
        return len(self.leaves) - 1

    def homes(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(self._top, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                letter, most, low, high = node
                left = points[rows, letter] <= most
                todo += [(low, rows[left]), (high, rows[~left])]
        return out

    def search(self, queries: np.ndarray, gain: int, lose: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries) where gaining ``gain`` letters and losing ``lose`` may lead into the leaf's box."""
        start = np.arange(len(queries))
        todo = [(self._top, start, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64), {})]
        while todo:
            node, rows, gained, lost, box = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                yield node, rows
                continue
            letter, most, low, high = node
            least, top = box.get(letter, (0, None))
            have = queries[rows, letter]
            # what the letter has cost so far is replaced by its cost in the smaller box
            before = np.maximum(have - top, 0) if top is not None else 0
            more = lost - before + np.maximum(have - most, 0)
            fits = more <= lose
            todo.append((low, rows[fits], gained[fits], more[fits], box | {letter: (least, most)}))
            more = gained - np.maximum(least - have, 0) + np.maximum(most + 1 - have, 0)
            fits = more <= gain
            todo.append((high, rows[fits], more[fits], lost[fits], box | {letter: (most + 1, top)}))


def _masks(vectors: np.ndarray) -> np.ndarray:
    """Which letters occur, as two numbers a vector."""
    bits = np.zeros((len(vectors), 128), np.uint8)
    bits[:, :LETTERS] = vectors > 0
    return np.packbits(bits, axis=1).view(np.uint64)


def _in_reach(tree: Tree, points: np.ndarray, queries: np.ndarray, gain: int, lose: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) numbers whose count vectors differ by exactly ``gain`` and ``lose`` letters."""
    own, asked = _masks(points), _masks(queries)
    for leaf, rows in tree.search(queries, gain, lose):
        held = tree.leaves[leaf]
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            apart = sum(np.bitwise_count(asked[part, k][:, None] ^ own[held, k][None, :]).astype(np.uint8) for k in (0, 1))
            q, p = np.nonzero(apart <= gain + lose)
            q, p = part[q], held[p]
            differ = points[p] - queries[q]
            exact = (np.maximum(differ, 0).sum(axis=1) == gain) & (np.maximum(-differ, 0).sum(axis=1) == lose)
            yield q[exact], p[exact]


class Words:
    """Words of one length with their letters, and the distinct count vectors with the words of each."""

    def __init__(self, words: list[str], n: list[int]) -> None:
        self.words, self.n = words, np.array(n, np.int64)
        self.letters = _letters(words)[0].astype(np.uint8).reshape(len(words), -1)
        vectors = _vectors(words)
        self.vectors, kind = np.unique(vectors, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        self.members = np.argsort(kind, kind="stable")
        self.bounds = np.searchsorted(kind[self.members], np.arange(len(self.vectors) + 1))
        # by frequency, then code points: the smallest rank is the best form
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.by_rank = order


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of letters are one edit apart; ``b`` has as many letters as ``a`` or one more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    lead = np.where((ahead := a == b[:, :n]).all(axis=1), n, ahead.argmin(axis=1))
    tail = np.where((behind := (a == b[:, 1:])[:, ::-1]).all(axis=1), n, behind.argmin(axis=1))
    return lead + tail >= n


def _verified(points: Words, asked: Words, q: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked word, point word) one edit apart, from pairs of count vectors; in pieces of about ``BYTES``."""
    sizes = np.diff(asked.bounds)[q] * np.diff(points.bounds)[p]
    ends = np.cumsum(sizes)
    step = max(1, BYTES // asked.letters.shape[1])
    for at in range(0, int(ends[-1]) if len(ends) else 0, step):
        number = np.arange(at, min(at + step, int(ends[-1])))
        pair = np.searchsorted(ends, number, side="right")
        within = number - (ends[pair] - sizes[pair])
        width = np.diff(points.bounds)[p[pair]]
        one = asked.members[asked.bounds[q[pair]] + within // width]
        other = points.members[points.bounds[p[pair]] + within % width]
        a, b = asked.letters[one], points.letters[other]
        near = _one_edit(a, b) if a.shape[1] <= b.shape[1] else _one_edit(b, a)
        yield one[near], other[near]


def near_in_cell(points: Words, tree: Tree, asked: Words) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words among the points, n and name of the best) of the ``asked`` words that have some."""
    count = np.zeros(len(asked.words), np.int64)
    best = np.full(len(asked.words), len(points.words), np.int64)
    gain, lose = _REACH[points.letters.shape[1] - asked.letters.shape[1]]
    for q, p in _in_reach(tree, points.vectors, asked.vectors, gain, lose):
        for one, other in _verified(points, asked, q, p):
            count += np.bincount(one, minlength=len(count))
            np.minimum.at(best, one, points.rank[other])
    for i in np.flatnonzero(count):
        form = points.by_rank[best[i]]
        yield asked.words[i], int(count[i]), int(points.n[form]), points.words[form]


def _layout(words: DataFrame) -> dict[int, Tree]:
    """The trees of the lengths that have over ``CELL`` words, from a sample of them."""
    lengths = words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > CELL).collect()
    if not lengths:
        return {}
    share = F.create_map(*[F.lit(x) for r in lengths for x in (r["length"], PER_CELL / CELL)])[F.length("word")]
    drawn = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)).select("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column(0).to_pylist()
            counts = np.minimum(_vectors(listed), 255).astype(np.uint8) if listed else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(w) for w in listed], pa.int64()), pa.array([c.tobytes() for c in counts], pa.binary())], names=["length", "counts"]
            )

    sample: dict[int, list[bytes]] = {}
    for row in drawn.mapInArrow(run, "length long, counts binary").collect():
        sample.setdefault(row["length"], []).append(row["counts"])
    # sorted, so that the layout does not depend on the order of arrival
    return {
        length: Tree(np.frombuffer(b"".join(sorted(rows)), np.uint8).astype(np.int32).reshape(-1, LETTERS), PER_CELL) for length, rows in sample.items()
    }


def _dealt(words: DataFrame) -> DataFrame:
    """(cell, kind, length, word, n): words at home (kind 0) and as visitors (kind 1)."""
    trees = _layout(words)
    sent = words.sparkSession.sparkContext.broadcast(trees)
    # cells of large lengths in turn, the others by their length
    first, at = {}, 0
    for length in sorted(trees):
        first[length], at = at, at + len(trees[length].leaves)
    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(spread, at // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(start, CHUNK)
                listed = batch.column(0).to_pylist()
                lengths = np.array([len(w) for w in listed], np.int64)
                rows, cells, leaves, kinds = [], [], [], []
                for length in np.unique(lengths).tolist():
                    mine = np.flatnonzero(lengths == length)
                    vectors = _vectors([listed[i] for i in mine])
                    for change, (gain, lose) in _REACH.items():
                        tree = sent.value.get(length + change)
                        home = tree.homes(vectors) if tree and not change else np.zeros(len(mine), np.int64)
                        found = tree.search(vectors, gain, lose) if tree else [(0, np.arange(len(mine)))]
                        for leaf, queries in found:
                            rows.append(mine[queries])
                            cells.append(np.full(len(queries), length + change))
                            leaves.append(np.full(len(queries), leaf))
                            kinds.append((home[queries] != leaf) if not change else np.ones(len(queries), bool))
                joined = [np.concatenate(x).astype(np.int64) for x in (rows, cells, leaves, kinds)]
                known = np.array([first.get(c, -1) for c in joined[1].tolist()], np.int64)
                task = np.where(known >= 0, known + joined[2], at + joined[1]) % tasks
                take = pa.array(joined[0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(task.astype(np.int32)), pa.array(joined[1]), pa.array(joined[2]), pa.array(joined[3].astype(np.int32)),
                        pa.array(lengths[joined[0]]), batch.column(0).take(take), batch.column(1).take(take),
                    ],
                    names=["task", "cell", "leaf", "kind", "length", "word", "n"],
                )

    schema = "task int, cell long, leaf long, kind int, length long, word string, n long"
    dealt = words.mapInArrow(run, schema).repartitionById(tasks, F.col("task"))
    return dealt.sortWithinPartitions("cell", "leaf", "kind", "length").drop("task")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of ``words`` (word, n) with near words; ``best`` has the count and name of the most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, points, tree = None, None, None
        waiting: tuple[list, list] = ([], [])

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "form_n", "form"])

        def settled() -> list[tuple]:
            """The cell's points are complete: their tree, and what they find among themselves."""
            nonlocal points, tree, waiting
            if not waiting[0]:
                return []
            points, waiting = Words(*waiting), ([], [])
            tree = Tree(points.vectors, LEAF)
            return list(near_in_cell(points, tree, points))

        for batch in batches:
            cell, leaf, kind, length = (np.asarray(batch.column(i)) for i in range(4))
            edges = np.flatnonzero(sum(x[1:] != x[:-1] for x in (cell, leaf, kind, length))) + 1
            found: list[tuple] = []
            for a, b in zip(np.append(0, edges), np.append(edges, len(cell)), strict=True):
                if a == b:
                    continue
                if (cell[a], leaf[a]) != current:
                    found += settled()
                    current, points, tree = (cell[a], leaf[a]), None, None
                listed, n = (batch.column(i).slice(a, b - a).to_pylist() for i in (4, 5))
                if kind[a] == 0:
                    waiting[0].extend(listed)
                    waiting[1].extend(n)
                    continue
                found += settled()
                if points is not None:
                    found += near_in_cell(points, tree, Words(listed, n))
            yield batch_of(found)
        yield batch_of(settled())

    parts = _dealt(words).mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root): where the chain of ``links`` (word, form) ends; ``most`` is the largest count of a word."""
    reached = cut(links.select("word", F.col("form").alias("root")))
    longest = max(1, most // MIN_COUNT).bit_length()
    for _ in range(max(0, longest - 1).bit_length()):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = cut(reached.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return reached


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text)."""
    words = cut(word_counts(docs))
    near = near_words(words)
    form = F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best.form"))
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
        F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"),
    )
    found = cut(found)
    most = words.agg(F.max("n")).first()[0] or 0
    ends = roots(found.where("form is not null"), most)
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
