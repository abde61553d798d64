"""Packing: combinations against brute force, plans, and round trips through the tokenizer."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import bin_packing, tokens


def test_fullest_equals_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        available = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 5))}
        room = rng.randint(0, 30)
        items = [n for n, c in available.items() for _ in range(c)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        chosen = bin_packing.fullest(available, room)
        assert sum(n * c for n, c in chosen.items()) == best
        assert all(0 < c <= available[n] for n, c in chosen.items())


def test_plans_use_every_piece_once():
    rng = random.Random(2)
    for _ in range(20):
        counts = Counter(min(1024, int(rng.expovariate(1 / 300)) + 1) for _ in range(rng.randint(1, 3000)))
        made = bin_packing.plan(dict(counts))
        used = Counter()
        for chosen, times in made:
            assert sum(n * c for n, c in chosen.items()) <= 1024
            used.update({n: c * times for n, c in chosen.items()})
        assert used == counts
        total = sum(n * c for n, c in counts.items())
        assert sum(t for _, t in made) <= max(-(-total // 1024) * 1.02 + 2, sum(c for n, c in counts.items() if n > 512))


def test_many_equal_pieces_need_few_plan_entries():
    made = bin_packing.plan({1024: 10**9, 500: 10**10 + 1, 24: 10**8, 1: 7})
    assert len(made) < 20 and sum(t for _, t in made) < 6.1 * 10**9


def test_encoders_agree():
    exact, fast = tokens.encoder(tokens.default_paths()[0]), tokens.encoder(*tokens.default_paths())
    rng = random.Random(3)
    texts = [f"a{c}b {c}{c} 1{c}2 {c}\n{c}" for c in map(chr, range(1, 0x250))]
    texts += ["".join(chr(rng.randrange(1, 0x250)) for _ in range(40)) for _ in range(300)]
    texts += ["", "<|endoftext|>", "x <|endoftext|> y", "漢字 и Ж", "a" * 5000, "don't we'LL 's"]
    for text in texts:
        assert exact(text).tolist() == fast(text).tolist(), repr(text)


def check(rows, found):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected[(doc, zlib.crc32(np.array(ids[len(ids) - len(ids) // 1024 * 1024 :] if len(ids) > 1024 else ids, "<u4").tobytes()), len(ids))] += 1
    by_sequence, total = {}, 0
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert total == sum(n * c for (_, _, n), c in expected.items())
    return by_sequence, total


def test_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "ledger", "Übung", "été", "x9"]) for _ in range(rng.randint(0, 900)))) for i in range(120)]
    rows += [(200, None), (201, ""), (201, ""), (None, "no id"), (202, "word " * 5000), (203, "漢字" * 3000)]
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, length int, task int").repartition(7)
    found = bin_packing.pack(docs, with_ids=True).collect()
    by_sequence, total = check(rows, found)
    assert len(by_sequence) <= -(-total // 1024) + 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(rows)
    whole = {}
    for r in sorted(found, key=lambda r: (str(r.doc_id), r.piece)):
        if r.doc_id != 201:
            assert r.start == len(whole.setdefault(r.doc_id, [])) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            whole[r.doc_id] += r.ids
            assert r.length <= 1024 and (r.piece == 0 or r.length == 1024)
    for doc, ids in whole.items():
        assert ids == [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 2]


def test_empty_table(spark):
    assert bin_packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
