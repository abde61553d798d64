"""Personal data: base matches against the plain patterns, disguises with their offsets."""

import hashlib
import random
import re
import time

import pytest

from ledgerloom.llm import pii_offsets as po


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [
            m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))
        ],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and po._luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15],
    }


PIECES = ["a", "b", "@", "@", ".", ".", "-", "+", "1", "2", "25", "300", "007", " ", "(", ")", "é", "_", "\n", "4111111111111111", "+1 (988) 555-2485", "x@y.z", "1.2.3.4"]


def test_base_equals_the_patterns():
    rng = random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
        assert po.base_spans(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("é mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("to john(at)mail.example.org.", "email", "john(at)mail.example.org"),
        ("write to bob at example dot co dot uk today", "email", "bob at example dot co dot uk"),
        ("ｊｏｈｎ＠example．com", "email", "ｊｏｈｎ＠example．com"),
        ("as jоhn@exаmple.cоm", "email", "jоhn@exаmple.cоm"),
        ("call plus one nine eight eight five five five two four eight five ok", "phone", "plus one nine eight eight five five five two four eight five"),
        ("card 4l11 1111 1111 1111 x", "card", "4l11 1111 1111 1111"),
        ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
        ("so john at example.com it is", "email", "john at example.com"),
        ("ask john@example dot com now", "email", "john@example dot com"),
        ("john @ example.com", "email", "john @ example.com"),
        ("an john&#64;example&period;com", "email", "john&#64;example&period;com"),
        ("is john@exam\u200bple.c\u00adom", "email", "john@exam\u200bple.c\u00adom"),
        ("up 192 dot 168 dot 0 dot 1 again", "ip", "192 dot 168 dot 0 dot 1"),
        ("call +1 five five five 0199 234", "phone", "+1 five five five 0199 234"),
        ("pay 4 one one one 1111 1111 1111 now", "card", "4 one one one 1111 1111 1111"),
        ("pay 4111 11\u200b11 1111 1111", "card", "4111 11\u200b11 1111 1111"),
        ("mail bob at example dot com dot Thanks", "email", "bob at example dot com"),
        ("host one nine two dot one six eight dot one dot five up", "ip", "one nine two dot one six eight dot one dot five"),
    ],
)
def test_disguises_map_back(text, kind, source):
    added = po.added_spans(text, po.base_spans(text))
    assert [text[a:b] for a, b in added[kind]] == [source]
    assert not any(v for k, v in added.items() if k != kind)


@pytest.mark.parametrize(
    "text", ["the thing is at the end of that one", "one two three", "meet at noon dot", "a (at) b", "O1 l2 I3", "meet me at noon dot dash", "look at this dot com thing", "it is at home.de", "one at a time dot", "two 25 one 3 point five", "call four 5", "soft\u00adhyphen", "a &#64; b", "Ünïcödé – naïve", "un de la", ""]
)
def test_plain_texts_gain_nothing(text):
    assert not any(po.added_spans(text, po.base_spans(text)).values())


def test_base_matches_stay_and_are_not_doubled():
    text = "x@example.com and ｘ@example.com"
    base = po.base_spans(text)
    added = po.added_spans(text, base)
    assert [text[a:b] for a, b in base["email"]] == ["x@example.com"]
    assert [text[a:b] for a, b in added["email"]] == ["ｘ@example.com"]


@pytest.mark.parametrize("piece", ["a", "1", "@", "1.", "a@", "one ", "+1(", "a at b dot ", "(at)", " ", "I1 ", "Ａ", "a.b@"])
def test_long_texts_take_linear_time(piece):
    started = time.process_time()
    text = piece * (400_000 // len(piece))
    po.added_spans(text, po.base_spans(text))
    assert time.process_time() - started < 8


def test_rows(spark):
    texts = [(1, "x@y.zz 1.2.3.4"), (2, None), (3, ""), (3, ""), (None, "+1 (988) 555-2485"), (4, "j [at] k [dot] de")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "doc_id long, text string, n_email int, spans string").repartition(3)
    found = po.find(docs).collect()
    assert len(found) == len(texts)
    by_id = {r.doc_id: r for r in found}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    one = by_id[1]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0)
    assert one.spans == "email:0:6,ip:7:14" and one.base_sha256 == sha(one.spans)
    assert by_id[2].spans == by_id[3].spans == "" and by_id[2].base_sha256 == sha("")
    assert by_id[None].n_phone == 1
    assert (by_id[4].n_email, by_id[4].n_added, by_id[4].spans, by_id[4].base_sha256) == (0, 1, "email:0:17", sha(""))
    assert po.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize(
    ("text", "kind", "source"),
    [
        ("servidor uno dos punto cero punto cero punto uno", "ip", "uno dos punto cero punto cero punto uno"),
        ("plus trois trois un quatre deux un neuf zéro zéro deux", "phone", "plus trois trois un quatre deux un neuf zéro zéro deux"),
        ("tel plus eins eins zwei fünf sieben neun neun zwei", "phone", "plus eins eins zwei fünf sieben neun neun zwei"),
        ("PLUS TRES TRES UNO DOS SEIS CINCO CINCO DOS", "phone", "PLUS TRES TRES UNO DOS SEIS CINCO CINCO DOS"),
        ("oh dot oh dot oh dot oh", "ip", "oh dot oh dot oh dot oh"),
        ("plus null eins zwei fünf null eins zwei fünf einst", "phone", "plus null eins zwei fünf null eins zwei fünf"),
        ("plus ſix sİx one two three four five six", "phone", "plus ſix sİx one two three four five six"),
    ],
)
def test_spelled_numbers_need_no_other_word(text, kind, source):
    for whole in (text, f"{text}; none eight"):
        added = po.added_spans(whole, po.base_spans(whole))
        assert [whole[a:b] for a, b in added[kind]] == [source]


def test_every_digit_word_is_found_by_itself():
    for words in po._DIGIT_WORDS:
        for digit, word in enumerate(words.split()):
            text = " ".join(["plus", *[word] * 9])
            assert po.rewritten(text).text == "+" + str(digit) * 9


def test_a_run_that_ends_in_a_longer_word_takes_linear_time():
    started = time.process_time()
    po.added_spans("one " * 100_000 + "ones", {k: [] for k in po.KINDS})
    assert time.process_time() - started < 8


def _card(rng):
    digits = [rng.randrange(10) for _ in range(15)]
    return next("".join(map(str, [*digits, d])) for d in range(10) if po._luhn("".join(map(str, [*digits, d]))))


def _disguised(rng, kind):
    """A value of ``kind`` in disguise."""
    words = rng.choice(po._DIGIT_WORDS).split()
    if kind == "email":
        at = rng.choice([" at ", " (at) ", "[at]", "&#64;", "\uff20", " @ "])
        dot = rng.choice([" dot ", " [dot] ", "(dot)", "&#x2e;", "."])
        return f"{rng.choice(['j.doe', 'anna7', 'x_y'])}{at}mail{dot}example{dot}{rng.choice(['com', 'org', 'de'])}"
    if kind == "ip":
        parts = [str(rng.randrange(1, 256)) for _ in range(4)]
        spelled = [" ".join(words[int(c)] for c in p) if rng.random() < 0.5 else p for p in parts]
        return rng.choice([" dot ", " punto "]).join(spelled)
    digits = _card(rng) if kind == "card" else str(rng.randrange(10**10, 10**11))
    tokens = [words[int(c)] if i % 4 == 1 or rng.random() < 0.4 else c for i, c in enumerate(digits)]
    return ("plus " if kind == "phone" else "") + rng.choice([" ", "-", ", "]).join(tokens)


def test_generated_disguises_are_found_where_they_stand():
    rng = random.Random(12)
    for _ in range(1500):
        kind = rng.choice(po.KINDS)
        value = _disguised(rng, kind)
        before, after = rng.choice(["", "é see ", "то ", "x: "]), rng.choice(["", " .", " and more", "\n"])
        text = before + value + after
        base = po.base_spans(text)
        if base[kind]:
            continue
        assert [text[a:b] for a, b in po.added_spans(text, base)[kind]] == [value], text


def test_prose_gains_nothing():
    rng = random.Random(13)
    words = ["look", "at", "this", "dot", "one", "two", "un", "the", "me", "home", "com", "5", "25", "plus", "on", "point", "(see", "it)", "a"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(12))
        assert not any(po.added_spans(text, po.base_spans(text)).values()), text
