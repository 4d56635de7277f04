"""Tokens of Go-like source text, as they are and with identifiers and literals replaced by marks, with their lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The language's keywords, and the marks of normalised tokens.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
IDENTIFIER, LITERAL = "_ID_", "_LIT_"
#: One alternation: comments, literals, words, operators of several characters (longest first), any other character.
COMMENT = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
LITERALS = r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[0-9][0-9A-Za-z_.]*|\.[0-9][0-9A-Za-z_]*"
WORD = r"[A-Za-z_\x80-\U0010ffff][A-Za-z0-9_\x80-\U0010ffff]*"
OPERATORS = r"&\^=|<<=|>>=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|[-+*/%&|^]=|<<|>>|&\^|[^\s]"
TOKEN = re.compile(f"({COMMENT})|({LITERALS})|({WORD})|({OPERATORS})")

SCHEMA = "path string, raw array<string>, t array<string>, line array<int>"
#: Normalised tokens as numbers: a single character is its own, those of several characters and the marks follow.
SEVERAL = "&^= <<= >>= ... && || <- ++ -- == != <= >= := -= += *= /= %= &= |= ^= << >> &^".split()
CODES = {x: 0x110000 + i for i, x in enumerate([IDENTIFIER, LITERAL, *sorted(KEYWORDS), *SEVERAL])}
#: Characters that are scanned at once; tokens of up to so many characters are remembered with their hash, so many of them.
STEP, SHORT, REMEMBERED = 1 << 20, 64, 1 << 18
#: Single characters that may begin a literal or a comment which ends further on; a quote that nothing ends within the text so far.
OPENING, OPEN_QUOTE = frozenset("`\"'/"), re.compile(r"\"(?:[^\"\\\n]|\\.)*\\?\Z|'(?:[^'\\\n]|\\.)*\\?\Z")
CODED = "path string, c int, n int, last boolean, t binary, raw binary, line binary"


def tokens(text: str) -> tuple[list[str], list[str], list[int]]:
    """The tokens without comments, their normal forms and their lines (from 1)."""
    raw, normal, line = [], [], []
    n = at = 0
    for m in TOKEN.finditer(text):
        n += text.count("\n", at, m.start())
        at = m.start()
        if m.lastindex == 1:
            continue
        raw.append(m[0])
        normal.append(LITERAL if m.lastindex == 2 else IDENTIFIER if m.lastindex == 3 and m[0] not in KEYWORDS else m[0])
        line.append(n + 1)
    return raw, normal, line


def lexed(contents: DataFrame) -> DataFrame:
    """path, raw, t (normalised) and line of each file's tokens; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = [tokens(x or "") for x in part.column("text").to_pylist()]
                cols = [part.column("path").to_pylist(), *([r[k] for r in rows] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "raw", "t", "line"])

    return contents.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


class _Hashes(dict):
    """64 bits for each token; only short tokens are remembered, and not too many."""

    def __missing__(self, token: str) -> int:
        h = int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        if len(token) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[token] = h
        return h


class Scanner:
    """The tokens of a text that comes in parts, as tokens() gives them for the whole."""

    def __init__(self, hashes: _Hashes | None = None):
        self.rest, self.line, self.hashes = "", 1, hashes if hashes is not None else _Hashes()

    def scan(self, text: str, end: bool) -> list[np.ndarray]:
        """code (of the normal form), hash (of the token) and line of the tokens that no further text can change; all that are left at the end."""
        text = self.rest + text
        most = len(text) if end else len(text) - 3  # an operator has three characters at most
        hashes, literal, name = self.hashes, CODES[LITERAL], CODES[IDENTIFIER]
        code, raw, start, at = [], [], [], len(text)
        for m in TOKEN.finditer(text):
            kind, token = m.lastindex, m[0]
            if m.end() > most or (kind == 4 and not end and token in OPENING and self._open(text, m.start())):
                at = m.start()
                break
            if kind == 1:
                continue
            raw.append(hashes[token])
            start.append(m.start())
            code.append(literal if kind == 2 else name if kind == 3 and token not in KEYWORDS else CODES.get(token) or ord(token))
        ends = np.flatnonzero(np.frombuffer(text[:at].encode("utf-32-le", "surrogatepass"), np.uint32) == ord("\n"))
        lines = self.line + np.searchsorted(ends, np.array(start, np.int64))
        self.rest, self.line = text[at:], self.line + len(ends)
        return [np.array(code, np.int32), np.array(raw, np.int64), lines.astype(np.int32)]

    @staticmethod
    def _open(text: str, i: int) -> bool:
        if text[i] == "/":
            return text[i + 1] == "*"
        return text[i] == "`" or OPEN_QUOTE.match(text, i) is not None


class _Chunks:
    """A file's chunks of size tokens, with up to over tokens of the next one in t."""

    def __init__(self, path: str, size: int, over: int, hashes: _Hashes):
        self.path, self.size, self.over, self.scanner = path, size, over, Scanner(hashes)
        self.waiting, self.chars, self.c = [], 0, 0
        self.held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)]

    def feed(self, text: str) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(text), STEP):
            self.waiting.append(text[i : i + STEP])
            self.chars += len(self.waiting[-1])
            # an open literal is tried again when its text has doubled
            if self.chars >= max(STEP, len(self.scanner.rest)):
                yield from self._scan(False)

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._scan(True)
        while len(self.held[0]) > self.size:
            yield self._chunk(False)
        if len(self.held[0]):
            yield self._chunk(True)

    def _scan(self, end: bool) -> Iterator[pa.RecordBatch]:
        found = self.scanner.scan("".join(self.waiting), end)
        self.waiting, self.chars = [], 0
        self.held = [np.concatenate(x) for x in zip(self.held, found)]
        while len(self.held[0]) >= self.size + max(self.over, 1):
            yield self._chunk(False)

    def _chunk(self, last: bool) -> pa.RecordBatch:
        n = min(self.size, len(self.held[0]))
        t, raw, line = self.held
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (t[: self.size + self.over], raw[:n], line[:n])]
        row = [pa.array([self.path]), *[pa.array([x], pa.int32()) for x in (self.c, n)], pa.array([last]), *blobs]
        self.held, self.c = [x[n:] for x in self.held], self.c + 1
        return pa.RecordBatch.from_arrays(row, names=[x.split()[0] for x in CODED.split(", ")])


def coded(contents: DataFrame, order: tuple, size: int, over: int) -> DataFrame:
    """path, c, n, last, t, raw, line: each text's tokens in chunks c of n tokens, size but for the last one.

    contents: path, text, and the columns of order by which a path's rows follow each other as one text. t has the codes (32
    bits) of the normalised tokens and of up to over more from the next chunk, raw 64 bits for each token, line its line (32 bits).
    Texts are read as a stream in their order, so that none is held as a whole; only an open literal or comment is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, file = _Hashes(), None
        for batch in batches:
            texts = batch.column("text")
            at = 0
            for path, same in groupby(batch.column("path").to_pylist()):
                n = sum(1 for _ in same)
                if file is None or file.path != path:
                    if file is not None:
                        yield from file.finish()
                    file = _Chunks(path, size, over, hashes)
                for i in range(at, at + n, 4096):
                    yield from file.feed("".join(x for x in texts.slice(i, min(4096, at + n - i)).to_pylist() if x))
                at += n
        if file is not None:
            yield from file.finish()

    dealt = contents.repartition("path").sortWithinPartitions("path", *order)
    return dealt.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).mapInArrow(run, CODED)
