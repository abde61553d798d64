"""N-gram Jaccard join by prefixes under several global orders of the shingles.

``similar_documents`` finds all documents whose shingle sets have a Jaccard similarity of at least
``percent`` in 100. If two sets are that similar, then under *every* global order of all shingles
the first ``n - ceil(percent * n / 100) + 1`` shingles of each have one in common. So

1. every text is hashed once to count shingles in a fixed number of buckets. The first order
   puts shingles of frequent buckets last, so that a passage that many documents share is
   in the prefix of hardly any of them. Any rule makes a valid order, so this costs no result;
2. equal sets become one class. Prefixes under the first order go to an inverted index. Shingles that
   the same classes have in their prefixes (a shared passage has many) are one list of the index, with the smallest place of each class;
3. a candidate agrees on a list, on sizes, on the places (what stands before the first common shingle is in
   one set only, and a link leaves room for so much difference), on as many parity bits as suit the sizes, and shares
   a prefix shingle under each further order, by 16-bit fingerprints of those prefixes that travel instead of the sets;
4. whole sets are fetched for what all filters leave, and counted.

A group of thousands of near copies is not spelled out as pairs. In up to ``STARS`` rounds each list names a leader, the
other components of the list are compared with it, and what links is contracted. The first leader has then been compared with all, and
leaves its list. Lists that still hold several components are
compared in blocks, of which a task returns only the candidates between different components. A task verifies
the candidates of a list, split into blocks, so that a set travels once per list and not once per pair. Nothing is capped: the
result is exact but for collisions of 54-bit hashes within a pair, of the 64-bit sums that name the classes and of those that name lists.

Nulls and odd rows: a null text is empty; empty sets link with nothing. A row without ``doc_id`` is
returned with a null component. Rows that repeat an id are judged each by its own text. Other columns of
the input are not read.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import bounded
from ledgerloom.llm.wordhash import (
    HASH_BITS,
    MAX_TEXTS,
    mix,
    shingle_hashes,
    shingle_sets,
    text_bytes,
    word_hashes,
    word_spans,
)
from ledgerloom.operators.components import connected_components
from ledgerloom.runtime import cut

ORDER_BITS = 20
ID_BITS = 22
BLOCK = 512
PARITY = 256
STARS = 2
AT_ONCE = 512
SLICE = 1 << 20
_CLASS_BITS = 5
_BITS = [f"p{i}" for i in range(PARITY // 64)]
_OTHER_ORDERS = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)


def _release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan refers to any more.

    It does so only when the driver collects garbage, which an idle driver does not do for long; the
    files of a step that is written out would lie about beside those of the next one.
    """
    gc.collect()
    spark._jvm.System.gc()


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _frequency_classes(docs: DataFrame, width: int) -> np.ndarray:
    """For each bucket of shingles 0, or how many doublings it lies above what chance explains."""

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in bounded.text_slices(batch, "text", MAX_TEXTS, SLICE):
            data, offsets = text_bytes(part.column(0))
            start, end, bounds = word_spans(data, offsets)
            hashes, _ = shingle_hashes(word_hashes(data, start, end), bounds, width)
            yield ((hashes >> np.uint64(64 - HASH_BITS)) & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)

    counts = bounded.bucket_counts(docs.select("text"), buckets, ORDER_BITS)
    usual = counts.mean()
    limit = usual + 6 * usual**0.5 + 16
    classes = np.zeros(len(counts), np.uint8)
    high = counts > limit
    classes[high] = np.minimum(np.log2(counts[high] / limit) + 1, (1 << _CLASS_BITS) - 1)
    return classes


def _parity(tokens: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, set if an odd number have it; one to two bits a shingle."""
    size = max(64, 1 << len(tokens).bit_length())
    flips = np.bincount((tokens >> np.uint64(ORDER_BITS)).astype(np.int64) & (size - 1), minlength=size)
    return np.packbits(flips.astype(np.uint8) & np.uint8(1)).tobytes()


def _least_difference(a: bytes, b: bytes) -> int:
    """A number of shingles that are surely in only one of two sets, by their parity bits."""
    bits = sorted((np.frombuffer(x, np.uint8) for x in (a, b)), key=len)
    folded = np.bitwise_xor.reduce(bits[1].reshape(-1, len(bits[0])), axis=0)
    return int(np.bitwise_count(bits[0] ^ folded).sum())


def _differ(wide: pa.ChunkedArray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``_least_difference`` of the pairs of rows ``i`` and ``j``, those of one size of parity bits at a time."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    needed, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = place[: len(i)], place[len(i) :]
    parity = [np.frombuffer(x, np.uint64) for x in wide.take(pa.array(needed)).to_pylist()]
    sizes = np.array([len(x) for x in parity], np.int64)
    common = np.minimum(sizes[i], sizes[j])
    for size in np.unique(common).tolist():
        pairs = np.flatnonzero(common == size)
        rows, place = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(parity[r].reshape(-1, size), axis=0) for r in rows.tolist()])
        a, b = place[: len(pairs)], place[len(pairs) :]
        step = max(1, (4 << 20) // size)
        for at in range(0, len(pairs), step):
            part = slice(at, at + step)
            out[pairs[part]] = np.bitwise_count(folded[a[part]] ^ folded[b[part]]).sum(axis=1)
    return out


def _fingerprints(tokens: np.ndarray, percent: int) -> bytes:
    """16 bits of each prefix shingle under the further orders, one order after the other."""
    k = int(_prefix_length(np.int64(len(tokens)), percent)) if len(tokens) else 0
    parts = [np.partition(mix(tokens * np.uint64(factor)), k - 1)[:k] if k else tokens for factor in _OTHER_ORDERS]
    return b"".join(np.sort((x >> np.uint64(48)).astype(np.uint16)).tobytes() for x in parts)


def _shares_prefixes(a: bytes, b: bytes) -> bool:
    """Whether two sets may have a common prefix shingle under every further order, by their fingerprints."""
    x, y = (np.frombuffer(side, np.uint16).reshape(len(_OTHER_ORDERS), -1) for side in (a, b))
    return all(np.isin(p, q).any() for p, q in zip(x, y, strict=True))


def _signatures(sets: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two sums of hashes that name each set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(sets ^ np.uint64(s)), dtype=np.uint64)]) for s in (1 << 60, 1 << 61)]
    return [(x[bounds[1:]] - x[bounds[:-1]]).view(np.int64) for x in sums]


def _prefixes(docs: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, n, sig1, sig2, p0.., wide, others, prefix): set size, signature, parity bits, more of them, fingerprints of
    the prefixes under the further orders, prefix under the first order."""
    order = docs.sparkSession.sparkContext.broadcast(classes)
    low = np.uint64(HASH_BITS)
    kept = np.uint64(HASH_BITS - _CLASS_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded.text_slices(batch, "text", MAX_TEXTS, SLICE):
                sets, bounds = shingle_sets(part.column(1), width)
                n = np.diff(bounds)
                owner = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                sums = _signatures(sets, bounds)
                flips = owner.astype(np.int64) * PARITY + ((sets >> np.uint64(ORDER_BITS)) % np.uint64(PARITY)).astype(np.int64)
                flips = np.bincount(flips, minlength=len(n) * PARITY).astype(np.uint8) & np.uint8(1)
                parity = np.packbits(flips).view(np.int64).reshape(len(n), PARITY // 64)
                wide = [_parity(sets[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                others = [_fingerprints(sets[a:b], percent) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                rank = order.value[(sets & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)].astype(np.uint64)
                both = np.sort((owner << low) | (rank << kept) | (sets >> np.uint64(_CLASS_BITS)))
                take = np.where(n > 0, _prefix_length(n, percent), 0)
                ends = np.cumsum(take)
                places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[:-1] - ends + take, take)
                tokens = (both[places] & np.uint64((1 << HASH_BITS) - 1)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(PARITY // 64)],
                        pa.array(wide, pa.binary()),
                        pa.array(others, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(tokens)),
                    ],
                    names=["doc_id", "n", "sig1", "sig2", *_BITS, "wide", "others", "prefix"],
                )

    bits = ", ".join(f"{c} long" for c in _BITS)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id long, n long, sig1 long, sig2 long, {bits}, wide binary, others binary, prefix array<long>"
    )


def _id_bucket(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) & np.uint64((1 << ID_BITS) - 1)).astype(np.int64)


def _flags(ids: DataFrame) -> np.ndarray:
    """Which of a fixed number of buckets hold an id of ``ids`` (one column)."""

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield _id_bucket(batch.column(0).to_numpy(zero_copy_only=False))

    return bounded.bucket_flags(ids, buckets, ID_BITS)


def _found(ids: pa.Array, flags: np.ndarray) -> np.ndarray:
    return flags[_id_bucket(ids.fill_null(0).to_numpy(zero_copy_only=False))] & np.asarray(ids.is_valid())


def _flagged(rows: DataFrame, flags: np.ndarray, wanted: bool = True) -> DataFrame:
    """``rows`` whose first column, a long, falls into a flagged bucket; or those whose does not, a null among them.

    The buckets are a broadcast of fixed size. What passes is shuffled later, the others never are.
    """
    sent = rows.sparkSession.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_found(batch.column(0), sent.value) == wanted))

    return rows.mapInArrow(run, rows.schema)


def _one_a_class(rows: DataFrame, groups: DataFrame, flags: np.ndarray, columns: list[str]) -> DataFrame:
    """(node, doc_id, ``columns``) of one row of each class; ``flags`` are the buckets of classes that have several rows."""
    key = ["node", "sig2", "doc_id"]
    rows = rows.where("n > 0 and doc_id is not null").select(F.col("sig1").alias("node"), "sig2", "doc_id", *columns)
    # on the join's own key, so that repeated rows go without another shuffle
    firsts = _flagged(rows, flags).join(groups.select(F.col("sig1").alias("node"), "sig2", "doc_id"), key).dropDuplicates(key)
    return _flagged(rows, flags, False).unionByName(firsts).select("node", "doc_id", *columns)


def _sketches(rows: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(node, ``columns``) of the classes in ``nodes`` (node)."""
    found = _flagged(rows.where("n > 0 and doc_id is not null").select(F.col("sig1").alias("node"), *columns), _flags(nodes))
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the classes in ``nodes`` (node, doc_id): their sets as bytes.

    Only texts whose id falls into a bucket that has a node are hashed again; the buckets are
    a broadcast of fixed size, and the join on the id removes what else fell into them.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(_flags(nodes.select("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value[_id_bucket(batch.column(0).to_numpy(zero_copy_only=False))]))
            for part in bounded.text_slices(batch, "text", MAX_TEXTS, SLICE):
                sets, bounds = shingle_sets(part.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(_signatures(sets, bounds)[0]),
                        pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "node", "tokens"],
                )

    found = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, node long, tokens binary")
    return found.join(nodes, ["node", "doc_id"], "left_semi").select("node", "tokens").dropDuplicates(["node"])


def _may_link(sizes: int, wide: tuple[bytes, bytes], others: tuple[bytes, bytes], percent: int) -> bool:
    """Whether parity bits leave room for a link of two sets, ``sizes`` together, and prefixes meet under every further order."""
    return (100 + percent) * _least_difference(*wide) <= (100 - percent) * sizes and _shares_prefixes(*others)


def _near(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (x, y, df, list) that all filters leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("both", "wx", "wy", "ox", "oy")]
                near = [_may_link(n, (p, q), (f, g), percent) for n, p, q, f, g in zip(*columns, strict=True)]
                yield batch.filter(pa.array(near, pa.bool_())).select(["x", "y", "df", "list"])

    pairs = cut(pairs)
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    sketches = cut(_sketches(rows, nodes, ["n", "wide", "others"]))
    for side in "xy":
        pairs = pairs.join(sketches.select(*[F.col(c).alias(f"{a}{side}") for c, a in (("node", ""), ("n", "n"), ("wide", "w"), ("others", "o"))]), side)
    pairs = pairs.select("x", "y", "df", "list", (F.col("nx") + F.col("ny")).alias("both"), "wx", "wy", "ox", "oy")
    return pairs.mapInArrow(run, "x long, y long, df long, list long")


def _index(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(list, node, place, df, n, p0..): classes whose prefixes under the first order share shingles.

    ``rows`` has (node, prefix). Shingles with the same classes are one list, named by a hash of them.
    """
    # one shuffle by shingle: the classes that share it are counted and named where they meet
    postings = rows.select("node", F.posexplode("prefix").alias("place", "token"))
    here = Window.partitionBy("token")
    names = [F.bit_xor(F.xxhash64("node", F.lit(salt))).over(here) for salt in (0, 1)]
    shared = postings.select("node", "place", F.count("*").over(here).alias("df"), *[x.alias(c) for x, c in zip(names, "ab", strict=True)])
    shared = shared.where("df > 1").select("node", "place", "df", F.xxhash64("df", "a", "b").alias("list"))
    lists = shared.groupBy("list", "node").agg(F.min("place").alias("place"), F.first("df").alias("df"))
    return lists.join(known.select("node", "n", *_BITS), "node")


def _apart(index: DataFrame, components: DataFrame | None, turn: int) -> DataFrame:
    """``index`` with each class's ``component``, without the lists that lie in one.

    Turn 0 compares every class of a list with the leader, so leaders of turn 0 are left out later, and lists of two with them.
    """
    if turn == 0:
        return index.withColumn("component", F.col("node"))
    merged = index.where("df > 2")
    if components is None:
        merged = merged.withColumn("component", F.col("node"))
    else:
        merged = merged.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = merged.groupBy("list").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct("place", "node")).alias("first")
    )
    split = split.where("low <> high").select("list", F.col("first.node").alias("judged"))
    return merged.join(split, "list").where("node <> judged").drop("judged")


def _stars(apart: DataFrame, turn: int, percent: int) -> DataFrame:
    """(x, y, df, list): of every list each other component's class that is nearest to the leader, if it may link."""
    order = F.col("place").cast("long") if turn == 0 else F.xxhash64("node", F.lit(turn))
    leaders = apart.groupBy("list").agg(F.min(F.struct(order.alias("order"), "node", "place", "n", *_BITS, "component")).alias("leader"))
    meets = apart.alias("i").join(leaders, "list").where("component <> leader.component").where(_room("i", "leader", percent))
    nearest = F.min(F.struct(F.expr(_flipped("i", "leader")).alias("flipped"), F.col("i.node").alias("node"), F.col("i.df").alias("df"), "list"))
    best = meets.groupBy("component", F.col("leader.node").alias("leading")).agg(nearest.alias("best"))
    pairs = best.select(F.least("best.node", "leading").alias("x"), F.greatest("best.node", "leading").alias("y"), "best.df", "best.list")
    return pairs.dropDuplicates(["x", "y"])


def _flipped(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in _BITS)


def _room(a: str, b: str, percent: int) -> str:
    """Whether sizes, places and the first parity bits of two entries leave room for a link."""
    room = f"{100 + percent} * ({a}.place + {b}.place) <= {100 - percent} * ({a}.n + {b}.n)"
    sizes = f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n)"
    return f"({room}) and ({sizes}) and ({100 + percent} * ({_flipped(a, b)}) <= {100 - percent} * ({a}.n + {b}.n))"


def _between(apart: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(x, y, df, list): all candidates between different components of a list.

    A cell is two blocks of at most about ``BLOCK`` classes of a list; pairs are made and judged inside of it.
    """
    parts = F.ceil(F.col("df") / BLOCK).cast("long")
    wide = _sketches(rows, apart.select("node").distinct(), ["wide"])
    rows = apart.join(wide, "node").withColumn("part", F.pmod(F.xxhash64("node"), parts))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    numbers = ["node", "component", "n", "place", *_BITS]
    rows = rows.select(
        "list", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "part", "df", *numbers, "wide"
    )

    def judged(cells: pa.Table) -> pa.RecordBatch:
        """Candidates of whole cells, row by row with the ones ``k`` places further on in the cell."""
        value = {c: cells.column(c).to_numpy() for c in ["list", "low", "high", "part", "df", *numbers]}
        new = np.ones(cells.num_rows, bool)
        new[1:] = sum(value[c][1:] != value[c][:-1] for c in ("list", "low", "high")) > 0
        ends = np.append(np.flatnonzero(new)[1:], cells.num_rows)[np.cumsum(new) - 1]
        n, place, component = value["n"], value["place"], value["component"]
        some, k, i = [], 1, np.arange(cells.num_rows)
        while len(i := i[i + k < ends[i]]):
            j = i + k
            both = n[i] + n[j]
            meets = (component[i] != component[j]) & ((value["low"][i] == value["high"][i]) | (value["part"][i] != value["part"][j]))
            meets &= ((100 + percent) * (place[i] + place[j]) <= (100 - percent) * both) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            x, y = i[meets], j[meets]
            flipped = sum(np.bitwise_count((value[c][x] ^ value[c][y]).view(np.uint64)).astype(np.int64) for c in _BITS)
            near = (100 + percent) * flipped <= (100 - percent) * both[meets]
            some.append(np.stack([x[near], y[near]]))
            k += 1
        i, j = np.concatenate(some, axis=1) if some else np.zeros((2, 0), np.int64)
        near = _differ(cells.column("wide"), i, j) * (100 + percent) <= (100 - percent) * (n[i] + n[j])
        i, j = i[near], j[near]
        a, b = value["node"][i], value["node"][j]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(value["df"][i]), pa.array(value["list"][i])], names=["x", "y", "df", "list"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cell = np.stack([held.column(c).to_numpy() for c in ("list", "low", "high")])
            # the last cell may go on in the next batch
            edges = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(axis=0)) + 1
            if len(edges):
                yield judged(held.slice(0, edges[-1]).combine_chunks())
                held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield judged(held.combine_chunks())

    cell = ["list", "low", "high"]
    found = rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "x long, y long, df long, list long")
    return found.dropDuplicates(["x", "y"])


def _verified(docs: DataFrame, pairs: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``pairs`` (x, y, df, list) those that are links, as (a, b).

    Pairs are dealt by list; lists of many classes are split into blocks of both sides.
    """
    blocks = F.ceil(F.col("df") / BLOCK)
    entry = F.xxhash64("list", F.pmod(F.xxhash64("x"), blocks), F.pmod(F.xxhash64("y"), blocks))
    pairs = cut(pairs.select("x", "y", entry.alias("entry")))
    uses = pairs.select("entry", F.col("x").alias("node")).union(pairs.select("entry", F.col("y").alias("node"))).distinct()
    nodes = cut(uses.select("node").distinct().join(known, "node").select("node", "doc_id"))
    sets = _sets_of(docs, nodes, width)
    rows = uses.join(sets, "node").select("entry", F.lit(0).alias("kind"), F.col("node").alias("x"), F.lit(0).cast("long").alias("y"), "tokens")
    rows = rows.unionByName(pairs.select("entry", F.lit(1).alias("kind"), "x", "y", F.lit(None).cast("binary").alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sets = None, {}
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            found: list[tuple[int, int]] = []
            for entry, kind, x, y, tokens in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if entry != current:
                    current, sets = entry, {}
                if kind == 0:
                    sets[x] = np.frombuffer(tokens, np.uint64)
                    continue
                both = np.sort(np.concatenate([sets[x], sets[y]]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    found.append((x, y))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())}
            )

    dealt = rows.repartition("entry").sortWithinPartitions("entry", "kind")
    links = cut(dealt.mapInArrow(run, "a long, b long"))
    _release(docs.sparkSession)
    return links


def _judged(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, sig1, sig2) of ``docs`` (doc_id, text), and classes (sig1, sig2, doc_id, component)."""
    classes = _frequency_classes(docs, width)
    rows = cut(_prefixes(docs, classes, width, percent))
    sized = rows.where("n > 0 and doc_id is not null").groupBy("sig1", "sig2")
    groups = cut(sized.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")))
    several = _flags(groups.where("copies > 1").select("sig1"))
    known = cut(_one_a_class(rows, groups, several, ["n", *_BITS]))
    _release(docs.sparkSession)
    index = cut(_index(_one_a_class(rows, groups, several, ["prefix"]), known))
    _release(docs.sparkSession)

    links, components = [], None
    for turn in range(STARS):
        pairs = _near(_stars(_apart(index, components, turn), turn, percent), rows, percent)
        links.append(_verified(docs, pairs, known, width, percent))
        if links[-1].isEmpty():
            break
        components = cut(connected_components(reduce(DataFrame.unionByName, links)))
        _release(docs.sparkSession)
    apart = cut(_apart(index, components, STARS))
    _release(docs.sparkSession)
    links.append(_verified(docs, _near(_between(apart, rows, percent), rows, percent), known, width, percent))
    final = components if components is not None and links[-1].isEmpty() else connected_components(reduce(DataFrame.unionByName, links))

    ids = groups.join(final.withColumnRenamed("node", "sig1"), "sig1", "left").select(
        "sig1", "sig2", "doc_id", F.coalesce("component", "sig1").alias("component")
    )
    return rows.select("doc_id", "n", "sig1", "sig2"), ids


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def similar_documents(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest id that links reach. An empty table gives an empty result.
    """
    rows, ids = _judged(_plain(docs), width, percent)
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(ids.join(smallest, "component").select("sig1", "sig2", "component_id"), ["sig1", "sig2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """``docs`` with one row of every component; all columns stay, whatever their names.

    The row is that of the smallest id. If texts that link repeat that id, it is the one whose signature is smallest; of rows with
    the same id and the same set of shingles one stays. Unlike texts under one id are different documents and all stay, and
    so do rows without an id or without a shingle, which link with nothing.

    Which ids lose a row is sent as a fixed number of buckets. Texts whose id is in no such bucket stay without
    being shuffled; the others are hashed once more and looked up.
    """
    spark = docs.sparkSession
    rows, ids = _judged(_plain(docs), width, percent)
    stay = cut(ids.groupBy("component").agg(F.min(F.struct("doc_id", "sig1", "sig2")).alias("first")).select("first.*"))
    key = ["doc_id", "sig1", "sig2"]
    counted = rows.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.count("*").alias("copies"))
    losing = counted.join(stay.withColumn("stays", F.lit(1)), key, "left").where("stays is null or copies > 1").select("doc_id")

    flags = _flags(losing)
    _release(spark)
    whole = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    named = whole.select(F.col(f"c{docs.columns.index('doc_id')}").cast("long").alias("id"), "*")
    text = docs.columns.index("text") + 1
    sent = spark.sparkContext.broadcast(flags)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Flagged rows, with their signatures. In one step: two would keep a Python worker each for every task."""
        for batch in batches:
            batch = batch.filter(pa.array(_found(batch.column(0), sent.value)))
            for part in bounded.text_slices(batch, f"c{text - 1}", MAX_TEXTS, SLICE):
                sets, bounds = shingle_sets(part.column(text), width)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(x) for x in _signatures(sets, bounds)], pa.array(np.diff(bounds))],
                    schema=pa.schema([*part.schema, ("sig1", pa.int64()), ("sig2", pa.int64()), ("size", pa.int64())]),
                )

    schema = T.StructType([*named.schema, *[T.StructField(c, T.LongType()) for c in ("sig1", "sig2", "size")]])
    doubtful = named.mapInArrow(signed, schema)
    first = doubtful.where("size > 0").join(stay.withColumnRenamed("doc_id", "id"), ["id", "sig1", "sig2"], "left_semi")
    first = first.dropDuplicates(["id", "sig1", "sig2"])
    kept = [_flagged(named, flags, False), doubtful.where("size = 0"), first]
    kept = reduce(DataFrame.unionByName, [k.select(*whole.columns) for k in kept])
    return kept.toDF(*docs.columns)
