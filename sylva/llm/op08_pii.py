r"""PII by offset-preserving deobfuscation.

Base identifiers are found in the text as it stands. Then transducers rewrite it, one after the other; each character that
they write keeps the range of source characters that it stands for:

1. characters: homoglyphs (Cyrillic, Greek), compatibility forms (full width, mathematical), digits of other scripts, odd
   spaces, dashes and dots become ASCII; invisible characters vanish; O, o, l, I among figures become figures;
2. spelled digits: a run of digit words (English, German, French, Spanish), with figures, "dot" and "plus" among them,
   becomes figures;
3. dots and ats: "[dot]", " dot ", "(at)", " @ ", and " at " before a name with a dot become "." and "@".

The base patterns run on what each of them writes, and the spans that they find are mapped back to source characters; a
span is added unless one of its kind already covers it. Three rules keep prose apart: a number has MIN_SPELLED digit words
or more (a run of 10 to 15 digits without a plus counts as a phone); an address that is spoken throughout ("at host dot
end") has a usual end (SPOKEN_ENDS, or two letters) or is followed by no other word; one with a spoken "at" and plain dots
has a name with a digit, dot or underscore. Texts without any trigger are left as they are. All of it takes linear time.

Base patterns (leftmost, not overlapping, per kind; a match that fails its check is dropped without retry) run in an
equivalent form: a run of digits or name characters that fails at its start fails at every later place in it, so only run
starts are tried and no pattern takes more than linear time.

Defined results: null text counts as empty (no spans); null doc_ids are kept; repeated rows are scanned each; an empty
table gives an empty table; other columns are ignored. n_email, n_ip, n_card and n_phone count base spans; the n_*_all
columns count all.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession

from sylva.llm.common import map_batches, only, table, texts

KINDS = ("email", "ip", "card", "phone")
MIN_SPELLED = 4

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS16 = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")

#: Characters that look like ASCII ones and that compatibility decomposition doesn't cover.
LOOKALIKES = {
    **dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁԛԝһ", "ABEKMHOPCTYXaeopcyxijsdqwh")),
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιαρ", "ABEZHIKMNOPTYXoviap")),
    **dict.fromkeys("‐‑‒–—―−", "-"),
    **dict.fromkeys("。․｡·", "."),
    **dict.fromkeys("​‌‍⁠﻿­", ""),
}
#: Digit words of four languages, from 0 to 9.
DIGIT_WORDS = {
    w: str(i)
    for line in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(line.split())
} | {"oh": "0", "zwo": "2"}
_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?:(?<!\w)(?:\+|plus\b)[ ]?)?(?<![\w])(?:{_DIGIT}|[0-9]+)\b(?:[ ,.\n()-]{{1,3}}(?:(?:dot|point|punkt|punto)[ ,-]{{1,2}})?(?:{_DIGIT}|[0-9]+)\b)+")
_PART = re.compile(rf"plus|dot|point|punkt|punto|{_DIGIT}|[0-9]+|\+|\.")
_OPEN, _CLOSE = r"\s?[(\[{<]\s?", r"\s?[)\]}>]\s?"
_DOT = re.compile(rf"{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}|(?<=[a-z0-9_-])\s(?:dot|punkt|punto)\s(?=[a-z0-9])")
_AT = re.compile(rf"{_OPEN}(?:at|arroba|@){_CLOSE}|(?<=[a-z0-9._%+-])\s(?:at|arroba)\s(?=[a-z0-9-]+\.[a-z0-9-])|(?<=[a-z0-9._%+-])\s@\s?(?=[a-z0-9])|(?<=[a-z0-9._%+-])@\s(?=[a-z0-9])")
_DOT_APART = re.compile(r"(@[a-z0-9-]+)(\s\.\s)(?=[a-z0-9])")
_SPOKEN_AT = frozenset(("at", "arroba"))
_ADDRESS = re.compile(r"[._%+-]*[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,24}")

#: Ends of host names that a plainly spoken address ("at host dot tld") must have, besides two letters.
SPOKEN_ENDS = frozenset("com org net edu gov info biz dev app name".split())

Span = tuple[str, int, int]


def _folded(c: str) -> str | None:
    """What a character stands for, if that is ASCII or nothing; None for one that stays."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c.isdecimal():
        return str(unicodedata.decimal(c))
    k = unicodedata.normalize("NFKC", c)
    if len(k) == 1 and k.isascii() and k.isprintable():
        return k
    return None


#: Built by rule over the whole character set: all characters that a transducer rewrites.
FOLD = {c: f for c in map(chr, range(128, 0x20000)) if not 0xD800 <= ord(c) < 0xE000 and (f := _folded(c)) is not None}
_FOLDABLE_LATIN = re.compile("[" + "".join(re.escape(c) for c in sorted(FOLD) if ord(c) < 256) + "]")


def foldable(text: str) -> bool:
    """Whether transducer 1 rewrites any character."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not FOLD.keys().isdisjoint(text)
    return _FOLDABLE_LATIN.search(text) is not None


_FIGURE = {"O": "0", "o": "0", "l": "1", "I": "1"}
#: Letters that stand for figures: no other letters beside them, a figure on one side, a figure or what parts figures on the other.
_FIGURES = re.compile(r"(?:(?<=[0-9])[OolI]+(?=[0-9().-])|(?<=[().-])[OolI]+(?=[0-9]))")
# cheap tests that hold for every text in which the pattern after them matches
_FIGURES_HINT = re.compile(r"[0-9][OolI]|[OolI][0-9]")
_IP_HINT = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
_DOT_WORDS = ("dot", "punkt", "punto", "point")
_BRACKET = re.compile(r"[(\[{<]\s?(?:at|@|\.|dot|p[ou]|arr)")
_AT_HOST = re.compile(r" at [a-z0-9-]+\.[a-z0-9]")
_APART = re.compile(r"\s@|@\s")
_WORDS = re.compile(r"\w+")


def _digit_words(lower: str) -> int:
    """How many digit words a text has, wherever and alike or not: each of a run has a boundary on both sides."""
    return sum(map(DIGIT_WORDS.__contains__, _WORDS.findall(lower)))


def _may_be_spelled(lower: str) -> bool:
    return _digit_words(lower) >= MIN_SPELLED


class Written:
    """A rewritten text: character i stands for the source characters from lo[i] up to hi[i]."""

    def __init__(self, text: str, lo=None, hi=None):
        self.text, self.lo, self.hi = text, range(len(text)) if lo is None else lo, range(1, len(text) + 1) if hi is None else hi

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Written:
        """Each (start, end, new) in order: every character of new stands for all that it replaces."""
        if not edits:
            return self
        out, lo, hi, done = [], [], [], 0
        for start, end, new in edits:
            out += (self.text[done:start], new)
            lo += self.lo[done:start]
            hi += self.hi[done:start]
            lo += [self.lo[start]] * len(new)
            hi += [self.hi[end - 1]] * len(new)
            done = end
        lo += self.lo[done:]
        hi += self.hi[done:]
        return Written("".join(out) + self.text[done:], lo, hi)

    def source(self, span: Span) -> Span:
        return span[0], self.lo[span[1]], self.hi[span[2] - 1]


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def is_card(s: str) -> bool:
    d = only_digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def is_ip(s: str) -> bool:
    parts = [p.lstrip("0") or "0" for p in s.split(".")]  # int() takes no more than some thousand digits
    return all(len(p) <= 3 and int(p) <= 255 for p in parts)


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(("email", start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out = emails(text) if "@" in text else []
    if _IP_HINT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if is_ip(m[0])]
    if _DIGITS16.search(text):
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if is_card(m[0])]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def fold(w: Written) -> Written:
    """Transducer 1."""
    if not w.text.isascii():
        w = w.rewrite([(i, i + 1, f) for i, c in enumerate(w.text) if not c.isascii() and (f := FOLD.get(c)) is not None])
    near = lambda i: i < 0 or i >= len(w.text) or not w.text[i].isalpha()
    return w.rewrite([(m.start(), m.end(), "".join(map(_FIGURE.get, m[0]))) for m in _FIGURES.finditer(w.text) if near(m.start() - 1) and near(m.end())])


def lowered(w: Written) -> Written:
    lower = w.text.lower()
    if len(lower) != len(w.text):  # a few characters change their length
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in w.text)
    return Written(lower, w.lo, w.hi)


def spell(w: Written, least: int) -> tuple[Written, list[Span]]:
    """Transducer 2 for runs of at least so many digit words, and the runs that it has written, as (digits, start, end) of w."""
    edits, runs = [], []
    for m in _SPELLED.finditer(w.text):
        parts = [(p.start() + m.start(), p.end() + m.start(), p[0]) for p in _PART.finditer(m[0])]
        if sum(p in DIGIT_WORDS for _, _, p in parts) < least:
            continue
        done, digits = m.start(), ""
        for start, end, p in parts:
            new = "+" if p in ("plus", "+") else "" if p == "." else "." if p in _DOT_WORDS else DIGIT_WORDS.get(p, p)
            if start > done:
                edits.append((done, start, ""))
            if new == p:  # figures stay, one by one
                edits += [(i, i + 1, w.text[i]) for i in range(start, end)]
            else:
                edits.append((start, end, new))
            done, digits = end, digits + new
        runs.append((digits, m.start(), m.end()))
    return w.rewrite(edits), runs


def numbers(w: Written) -> list[Span]:
    """Numbers in what transducer 2 writes, as spans of the source."""
    out, runs = spell(w, MIN_SPELLED)
    if not runs:
        return []
    places = [(w.lo[s], w.hi[e - 1]) for _, s, e in runs]
    starts = [s for s, _ in places]
    found = []
    for span in map(out.source, base_spans(out.text)):
        i = bisect_right(starts, span[2] - 1) - 1  # the last run that begins before the span's end
        if span[0] != "email" and i >= 0 and places[i][1] > span[1]:
            found.append((span[0], span[1], span[2]))
    known = sorted((s, e) for _, s, e in found)
    for (digits, _, _), (start, end) in zip(runs, places):
        i = bisect_right(known, (end, -1)) - 1
        if 10 <= len(digits) <= 15 and digits.isdigit() and not (i >= 0 and known[i][1] > start):
            found.append(("phone", start, end))
    return found


def spelled(lower: str) -> list[Span]:
    """The numbers of a lower-case text in words."""
    return numbers(Written(lower))


def addresses(w: Written) -> list[Span]:
    """Addresses in what transducer 3 writes, as spans of the source."""
    dotted = w.rewrite([(m.start(), m.end(), ".") for m in _DOT.finditer(w.text)])
    found = [dotted.source(x) for x in base_spans(dotted.text) if x[0] == "ip"] if dotted is not w else []
    spoken, edits = [], []
    for m in _AT.finditer(dotted.text):
        if m[0].strip() in _SPOKEN_AT:
            spoken.append(dotted.lo[m.start()])
        edits.append((m.start(), m.end(), "@"))
    out = dotted.rewrite(edits)
    out = out.rewrite([(m.start(2), m.end(2), ".") for m in _DOT_APART.finditer(out.text)])
    if out is w:
        return found
    for _, start, end in emails(out.text):
        while start < end and out.text[start] == ".":
            start += 1
        text = out.text[start:end]
        if not _ADDRESS.fullmatch(text):
            continue
        name, _, host = text.partition("@")
        sign = out.lo[start + len(name)]
        i = bisect_right(spoken, sign) - 1
        if i >= 0 and spoken[i] == sign:
            last = host.rpartition(".")[2]
            dots = any(out.hi[k] - out.lo[k] > 1 for k in range(start + len(name) + 1, end) if out.text[k] == ".")
            if dots:
                follows = out.text[end : end + 2]
                if not (len(last) == 2 or last in SPOKEN_ENDS or not (follows[:1].isspace() and follows[1:].isalnum())):
                    continue
            elif not (any(c in "0123456789._" for c in name) and any(c.isalpha() for c in name)):
                continue
        found.append(out.source(("email", start, end)))
    return found


def added_spans(text: str, base: list[Span]) -> list[Span]:
    found: list[Span] = []
    w = Written(text)
    if foldable(text) or _FIGURES_HINT.search(text):
        w = fold(w)
        found += map(w.source, base_spans(w.text))
    low = lowered(w)
    words = _digit_words(low.text)
    if words >= MIN_SPELLED:
        found += numbers(low)
    marked = any(x in low.text for x in (*_DOT_WORDS, "arroba")) or "@" in low.text and _APART.search(low.text) or _BRACKET.search(low.text)
    if marked or " at " in low.text and _AT_HOST.search(low.text):
        if words > 1:
            low = spell(low, 2)[0]
        found += addresses(low)
    if not found:
        return []
    out: list[Span] = []
    for kind in KINDS:
        own = sorted([(s, -e, 0) for k, s, e in base if k == kind] + [(s, -e, 1) for k, s, e in set(found) if k == kind])
        reach = -1  # the last end of the spans that begin here or before
        for s, e, new in own:
            if new and -e > reach:
                out.append((kind, s, -e))
            reach = max(reach, -e)
    return out


def find_pii(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans; by kind as listed, then start."""
    base = base_spans(text)
    more = added_spans(text, base)
    return base, sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1], x[2])) if more else base


def say(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


SCHEMA = "doc_id bigint, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"


def scan_pii(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and spans as arrays (kind, start, end; code points, end exclusive)."""

    def make():
        def step(batch):
            if batch is None or not batch.num_rows:
                return
            found = [find_pii(x) for x in texts(batch)]
            rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
            yield {"doc_id": batch.column("doc_id"), "base": [rows(b) for b, _ in found], "spans": [rows(a) for _, a in found]}

        return step

    return map_batches(only(docs, "doc_id", "text"), make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = scan_pii(table(spark, sf_dir, "documents"))
    count = lambda c, k: F.size(F.filter(c, lambda x: x["kind"] == k)).cast("bigint")
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", *[count("base", k).alias(f"n_{k}") for k in KINDS], F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), *[count("spans", k).alias(f"n_{k}_all") for k in KINDS])


SQL = None  # transducers can't be said in SQL; tests hold the base against the plain patterns and the rest against planted cases
