"""Personal data, also where it is disguised, with offsets into the text as it stands.

``find`` lists e-mail and IP addresses, card and telephone numbers. Base matches are those of the plain
text: leftmost, not overlapping, each kind for itself; a match that fails its check is dropped and
not tried again. Then transducers rewrite disguises

* look-alike characters (other widths, styles and scripts) to ASCII, O, o, I, l among digits, and character references;
* invisible characters (zero width, soft hyphens) to nothing;
* runs of number tokens: digits spelled as words in four languages, numerals, "plus" and "dot". Any word among them counts,
  whatever the length of the run; words lose the gaps around them, and the detectors judge the number that results;
* "(at)", "[dot]" and the like, and names and hosts written with "at", "@", "dot" and ".". Without brackets the
  host must end in a known top-level label, and neither side may be a word that prose has there ("look at this dot com"),

and each rewritten character remembers the characters it came from. The same detectors, with their checks (Luhn, octets, number of digits), read the
result; what they find through a rewritten character is mapped back and added, unless a base match of
its kind overlaps it. Offsets are code points, ends excluded.

All scans take time linear in the text. A null text is empty and has no spans. Repeated rows are
listed each; a null id stays null; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int]

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile("[0-9]")
# a run of digits that fails from its start fails from within, so starts within runs are not tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        else:
            # nothing before this sign can belong to a later match
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> dict[str, list[Span]]:
    digits = bool(_DIGIT.search(text))
    return {
        "email": list(_emails(text)),
        "ip": list(_ips(text)) if digits else [],
        "card": list(_cards(text)) if digits else [],
        "phone": list(_phones(text)) if digits and "+" in text else [],
    }


# Letters of other scripts that look like ASCII ones, in pairs.
_ALIKE = (
    "аa еe оo рp сc хx уy ѕs іi јj ԁd ԛq ԝw һh ɡg АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ЅS ІI ЈJ "
    "αa οo ρp νv υu ιi κk ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ɑa ıi ⁄/ ․. 。. ｡. ﹒. ‐- ‑- ‒- –- −-"
)
_FOLD = {pair[0]: pair[1] for pair in _ALIKE.split()}
# The ten digits as words.
_DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
_DOTS = ("dot", "punkt", "point", "punto")
_SPOKEN = {w: str(i) for words in _DIGIT_WORDS for i, w in enumerate(words.split())} | {"oh": "0", "plus": "+"} | dict.fromkeys(_DOTS, ".")
_WORD = "|".join(sorted(_SPOKEN, key=len, reverse=True))
_NUMERAL = r"\+?[0-9]++(?:\.[0-9]++)*+"
_GAP = r"[ \t,;/()-]{1,3}"
_PLAIN_GAP = frozenset(" ()-")
_TOKEN = rf"(?:{_WORD}|{_NUMERAL})(?!\w)"
# tokens start where words start and end where they end, so a run is not tried again from within
_RUN = re.compile(rf"(?<!\w)(?=[+0-9{''.join(sorted({w[0] for w in _SPOKEN}))}]){_TOKEN}(?:{_GAP}{_TOKEN})*+", re.IGNORECASE)
_ONE = re.compile(rf"(?P<word>{_WORD})|{_NUMERAL}", re.IGNORECASE)
_AT_DOT = re.compile(
    r"[ \t]{0,3}[(\[{<][ \t]{0,3}(?:(at|arroba|bei)|(dot|punkt|point|punto))[ \t]{0,3}[)\]}>][ \t]{0,3}", re.IGNORECASE
)
_LABEL = "[A-Za-z0-9-]{1,63}"
_SPOKEN_DOT = r"[ \t]{1,3}dot[ \t]{1,3}"
_ADDRESS = re.compile(
    rf"(?<![A-Za-z0-9._%+-])(?P<name>[A-Za-z0-9._%+-]{{1,64}})(?P<at>[ \t]{{0,3}}@[ \t]{{0,3}}|[ \t]{{1,3}}at[ \t]{{1,3}})(?P<host>{_LABEL}(?:(?:\.|{_SPOKEN_DOT}){_LABEL}){{1,6}}+)",
    re.IGNORECASE,
)
_BETWEEN = re.compile(rf"\.|{_SPOKEN_DOT}", re.IGNORECASE)
# Top-level labels, those that are words of prose, and words that prose has before "at" or after it.
_TOP = frozenset(
    "com org net edu gov mil int info biz name pro io co dev app ai me tv xyz online site shop eu uk de fr es it nl be ch at lu li ru ua pl cz sk hu ro bg gr "
    "se no dk fi is ie pt us ca mx br ar cl pe au nz jp cn hk tw kr sg my th vn ph id in pk il tr za ng ke eg sa ae".split()
)
_TOP_WORDS = frozenset("at be in is it me my no pro us site online".split())
_NOT_NAMES = frozenset(
    "look looks looked looking me you him her it us them one ones is are was were be been am stay stays stayed meet meets met arrive arrived not only just here there "
    "live lives lived work works worked good bad laugh laughed aim aimed visit site website page available start started stop end and or but the a an".split()
)
_NOT_HOSTS = frozenset("this that the a an my your his her its our their these those all any on in to of some least most noon night home once first last it dot at".split())
_INVISIBLE = frozenset("\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff") | {chr(c) for c in range(0xFE00, 0xFE10)}
_REFERENCE = re.compile(r"&(?:#(?P<decimal>[0-9]{1,6})|#[xX](?P<hex>[0-9A-Fa-f]{1,5})|(?P<named>commat|period|plus|lowbar));?")
_NAMED = {"commat": "@", "period": ".", "plus": "+", "lowbar": "_"}
_MIXED = re.compile(r"(?<!\w)\+?[0-9OoIl]++(?:[ ().-]{1,2}[0-9OoIl]++)*+(?!\w)")
_MIXED_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1"}
_NOT_LATIN = re.compile("[^\x00-ɏ]|ɏ|ı|\u00ad")


def _folded(char: str) -> str | None:
    """The ASCII character that ``char`` looks like, if it is not one itself."""
    if char in _FOLD:
        return _FOLD[char]
    if char < " " and unicodedata.category(char) != "Nd":
        return None
    plain = unicodedata.normalize("NFKC", char)
    if len(plain) == 1 and plain.isascii() and plain.isprintable() and plain != " ":
        return plain
    return str(unicodedata.decimal(char)) if unicodedata.category(char) == "Nd" else None


class Rewritten:
    """A text after edits, with the place that each of its characters came from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.first: list[int] = []
        self.last: list[int] = []
        self.edited = bytearray()

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the spans, ascending and apart, by texts; an empty one joins its neighbours, and counts as an edit of the next."""
        if not edits:
            return
        if not self.edited:
            self.first, self.last = list(range(len(self.text))), list(range(1, len(self.text) + 1))
            self.edited = bytearray(len(self.text))
        text, first, last, edited, at = [], [], [], bytearray(), 0
        for _, b, new in edits:
            if not new and b < len(self.edited):
                self.edited[b] = 1
        for a, b, new in edits:
            text += [self.text[at:a], new]
            first += self.first[at:a] + [self.first[a]] * len(new)
            last += self.last[at:a] + [self.last[b - 1]] * len(new)
            edited += self.edited[at:a] + b"\1" * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.first, self.last, self.edited = first + self.first[at:], last + self.last[at:], edited + self.edited[at:]


def _small(word: str) -> str:
    """A word as ``_SPOKEN`` has it; ignoring case, patterns also take a long s and a dotted capital I."""
    return unicodedata.normalize("NFKC", word).lower().replace("\u0307", "")


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _RUN.finditer(text):
        tokens = list(_ONE.finditer(text, run.start(), run.end()))
        # the shortest find, an address, has four digits
        if sum(len(_DIGIT.findall(t.group())) if t["word"] is None else _SPOKEN[_small(t.group())].isdigit() for t in tokens) < 4:
            continue
        at, was_word = run.start(), False
        for token in tokens:
            is_word = token["word"] is not None
            gap = text[at : token.start()]
            if gap and (is_word or was_word):
                edits.append((at, token.start(), ""))
            elif not _PLAIN_GAP.issuperset(gap):
                edits.append((at, token.start(), " "))
            if is_word:
                edits.append((token.start(), token.end(), _SPOKEN[_small(token.group())]))
            at, was_word = token.end(), is_word
    return edits


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ADDRESS.finditer(text):
        spoken = "@" not in m["at"]
        dots = list(_BETWEEN.finditer(text, *m.span("host")))
        ends = [d.start() for d in dots[1:]] + [m.end()]
        # the host ends with its last label that is a top-level one
        # between spoken signs it must be no word of prose either
        while dots and text[dots[-1].end() : ends[-1]].lower() not in (_TOP - _TOP_WORDS if spoken and dots[-1].group() != "." else _TOP):
            dots.pop()
            ends.pop()
        if not dots or spoken and (m["name"].lower() in _NOT_NAMES | _NOT_HOSTS or text[m.start("host") : dots[0].start()].lower() in _NOT_HOSTS):
            continue
        if m["at"] != "@":
            yield (*m.span("at"), "@")
        yield from ((*d.span(), ".") for d in dots if d.group() != ".")


def _bracketed(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "@" if m.group(1) else ".") for m in _AT_DOT.finditer(text)]


def _references(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _REFERENCE.finditer(text):
        code = int(m["decimal"]) if m["decimal"] else int(m["hex"], 16) if m["hex"] else ord(_NAMED[m["named"]])
        if 32 < code < 127:
            edits.append((*m.span(), chr(code)))
    return edits


def _mixed(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _MIXED.finditer(text):
        digits = sum("0" <= c <= "9" for c in m.group())
        letters = [i for i, c in enumerate(m.group(), m.start()) if c in _MIXED_DIGIT]
        if letters and digits >= 4 and digits > 2 * len(letters):
            edits += [(i, i + 1, _MIXED_DIGIT[text[i]]) for i in letters]
    return edits


def rewritten(text: str) -> Rewritten:
    out = Rewritten(text)
    if _NOT_LATIN.search(text):
        marks = {c: "" if c in _INVISIBLE else _folded(c) for c in set(text) if not c.isascii()}
        out.apply([(i, i + 1, marks[c]) for i, c in enumerate(text) if marks.get(c) is not None])
    if "&" in out.text:
        out.apply(_references(out.text))
    out.apply(_spelled(out.text))
    out.apply(_bracketed(out.text))
    out.apply(list(_addresses(out.text)))
    if _DIGIT.search(out.text):
        out.apply(_mixed(out.text))
    return out


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """What only the rewritten text shows, as spans of ``text``."""
    new = rewritten(text)
    if 1 not in new.edited:
        return {kind: [] for kind in KINDS}
    out = {}
    for kind, spans in base_spans(new.text).items():
        found = [(new.first[a], new.last[b - 1]) for a, b in spans if any(new.edited[a:b])]
        known, kept, i = sorted(base[kind]), [], 0
        for a, b in found:
            while i < len(known) and known[i][1] <= a:
                i += 1
            if i == len(known) or known[i][0] >= b:
                kept.append((a, b))
        out[kind] = kept
    return out


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, base counts, digest of the base spans, all spans, added ones."""
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base)
                both = {k: base[k] + more[k] for k in KINDS}
                row = [len(base[k]) for k in KINDS]
                row += [hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), sum(map(len, more.values()))]
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return texts.mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")
