"""Alignment of two tokenizers' tokens: union-find over the graph of overlapping tokens, links and their corpus-wide counts.

A text with a space before it is cut into units: blanks and the run of other characters after them. Both tokenizers begin
a token at each cut: the byte-level pattern has no alternative in which a blank follows other characters, and the other
vocabulary has no piece with a blank after another character (which is looked up when it is loaded: blanks for
which that isn't so, and those that follow them, are no cuts). So a text's tokens are its units' tokens, and a worker aligns each different unit once, many
at a time: nodes are the tokens of both, edges their overlaps, found by merging both rows of ends; roots are hooked and
pointers halved until none moves. The components are the minimal groups; their members whose ranges end together are the
links.

Counting: each task sums its links' pairs of ids, the sums are added by pair. A task looks pairs up in a table of the most
frequent ones (TABLE_PAIRS at most, broadcast); the others go as (row, pair) with their number and are joined with the
counts. The highest count of each B id has no more rows than the vocabulary and is broadcast.

Defined results: null and empty texts, and texts whose tokens don't give back their bytes, have no tokens (zeros and '');
null doc_ids are kept; rows that repeat another count and are returned each; an empty table gives an empty table; other
columns are ignored. A text is aligned in one task, in memory that grows with its length.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import drop_table, map_batches, materialise, only, table, texts

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pairs in the broadcast table; units and characters in a worker's cache; links that a task holds before it sums them.
TABLE_PAIRS, CACHE_UNITS, CACHE_CHARS, SUM_LINKS = 1 << 19, 400_000, 1 << 24, 1 << 21
#: Characters with Unicode's White_Space property.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stands before units that are encoded together, as text stands before a unit.
BEFORE = " a"

DOCS = "doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary"
_workers: dict[int, Aligner] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the others in order from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over edges (a, b), all at once: the smallest node of each node's component."""
    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        if np.array_equal(ra, rb):
            return parent
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))  # union: the larger root is hooked to the smaller
        while True:  # find: pointers are halved
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that overlap: one for each stretch between neighbouring ends of either row."""
    bounds = np.union1d(ends_a, ends_b)
    return np.searchsorted(ends_a, bounds), np.searchsorted(ends_b, bounds)


class Aligner:
    """Both tokenizers and a cache of aligned units."""

    def __init__(self, a_model: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_model.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letter = byte_letters()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.a_bytes[i] = bytes(letter[c] for c in piece)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        inside = {c for i, p in enumerate(pieces) if not self.b.is_byte(i) for k, c in enumerate(p.replace("▁", " ")) if k and not p[k - 1].replace("▁", " ").isspace()}
        blanks, unsafe = re.escape(BLANKS), re.escape("".join(c for c in BLANKS if c in inside))
        run = f"[^{blanks}]+"
        self.units = re.compile(f"[{blanks}]*(?:{run}(?:[{unsafe}][{blanks}]*)?)+|[{blanks}]+" if unsafe else f"[{blanks}]*{run}|[{blanks}]+")
        if len(self.a_bytes) * len(self.b_bytes) > 1 << 31:
            raise ValueError("a pair of ids must fit 32 bits")
        self.a_len, self.b_len = (np.array([len(x) for x in k], np.int64) for k in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(k))] for k in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.said: list[bytes] = []  # a unit's groups
        self.sizes = np.zeros((5, 1024), np.int64)  # n_a, n_b, n_groups, n_links, bad
        self.first = np.zeros(1024, np.int64)  # a unit's first link
        self.links = np.zeros(4096, np.int32)
        self.n_links = 0

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both for a text that begins with a space, or None if one of them doesn't give back its bytes."""
        raw = text.encode()
        a = self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:])
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def align(self, units: list[str], before: str = BEFORE) -> list[tuple[int, int, int, bytes, np.ndarray] | None]:
        """Each unit's n_a, n_b, n_groups, its groups as text and its links; None where tokens don't give back the bytes."""
        if not units:
            return []
        ids = self.encode(before + "".join(units))
        ends = len(before.encode()) + np.cumsum([len(u.encode()) for u in units]) if ids else None
        if ids:
            a, b = ids
            ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
            to_a, to_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        if not ids or (ends_a[to_a] != ends).any() or (ends_b[to_b] != ends).any():
            if len(units) == 1:
                return [None]
            mid = len(units) // 2
            return self.align(units[:mid], before) + self.align(units[mid:], before)
        over_a, over_b = overlaps(ends_a, ends_b)
        root = components(len(a) + len(b), over_a, len(a) + over_b)
        root_a, root_b = root[: len(a)], root[len(a) :]
        last_a, last_b = (np.flatnonzero(np.append(r[1:] != r[:-1], True)) + 1 for r in (root_a, root_b))  # a component's tokens stand together
        # the members of a component whose ranges end together
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(b) - 1)
        hit = np.flatnonzero((ends_b[at] == ends_a) & (root_b[at] == root_a))
        links = (a[hit] * len(self.b_bytes) + b[at[hit]]).astype(np.int32)
        skip = len(before.encode())
        lo_a = np.append(np.searchsorted(ends_a, skip, "right"), to_a + 1)
        lo_b = np.append(np.searchsorted(ends_b, skip, "right"), to_b + 1)
        lo_g, lo_l = np.searchsorted(last_a, lo_a, "right"), np.searchsorted(hit, lo_a)  # groups and links before each unit
        say_a, say_b = list(map(self.a_text.__getitem__, a.tolist())), list(map(self.b_text.__getitem__, b.tolist()))
        out = []
        la, lb, lg, ll, ga, gb = (x.tolist() for x in (lo_a, lo_b, lo_g, lo_l, last_a, last_b))
        for u in range(len(units)):
            x, y, groups = la[u], lb[u], []
            for g in range(lg[u], lg[u + 1]):
                groups.append(f"{','.join(say_a[x:ga[g]])}|{','.join(say_b[y:gb[g]])}")
                x, y = ga[g], gb[g]
            out.append((la[u + 1] - la[u], lb[u + 1] - lb[u], len(groups), ";".join(groups).encode(), links[ll[u] : ll[u + 1]]))
        return out

    def learn(self, units: list[str]) -> None:
        """Aligns units that the cache lacks. Blanks at a text's end must stand alone; the others are taken together."""
        inner = [u for u in units if u[-1] not in BLANKS]
        found = []
        for at in range(0, len(inner), 2048):
            found += self.align(inner[at : at + 2048])
        for u in units:
            if u[-1] in BLANKS:
                inner.append(u)
                found += self.align([u])
        n = len(self.said)
        while n + len(inner) > self.sizes.shape[1]:
            self.sizes, self.first = np.concatenate([self.sizes, np.zeros_like(self.sizes)], 1), np.concatenate([self.first, np.zeros_like(self.first)])
        self.at.update(zip(inner, range(n, n + len(inner))))
        self.chars += sum(map(len, inner))
        self.said += [x[3] if x else b"" for x in found]
        links = np.concatenate([x[4] for x in found if x] or [self.links[:0]])
        sizes = np.array([(x[0], x[1], x[2], len(x[4]), 0) if x else (0, 0, 0, 0, 1) for x in found], np.int64).reshape(-1, 5).T
        self.sizes[:, n : n + len(inner)] = sizes
        self.first[n : n + len(inner)] = self.n_links + np.cumsum(sizes[3]) - sizes[3]
        while self.n_links + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[self.n_links : self.n_links + len(links)] = links
        self.n_links += len(links)

    def documents(self, rows: list[str]) -> dict[str, list]:
        """n_a to links of each text."""
        units = [self.units.findall(" " + x) if x else [] for x in rows]
        new = list(dict.fromkeys(u for x in units for u in x if u not in self.at))
        if new and (len(self.at) + len(new) > CACHE_UNITS or self.chars > CACHE_CHARS):
            self.clear()
            new = list(dict.fromkeys(u for x in units for u in x))
        if new:
            self.learn(new)
        ids = [list(map(self.at.__getitem__, x)) for x in units]
        flat = np.array([i for x in ids for i in x], np.int64)
        to = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(x) for x in ids], out=to[1:])
        sums = np.zeros((5, len(flat) + 1), np.int64)
        np.cumsum(self.sizes[:, flat], axis=1, out=sums[:, 1:])
        n_a, n_b, n_groups, _, bad = sums[:, to[1:]] - sums[:, to[:-1]]
        counts = self.sizes[3, flat]
        link = self.links[np.repeat(self.first[flat] - sums[3, :-1], counts) + np.arange(sums[3, -1])]
        parts = sums[3, to]
        out = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "links": [link[x:y].tobytes() for x, y in zip(parts[:-1], parts[1:])]}
        out["groups_sha256"] = [hashlib.sha256(b";".join(map(self.said.__getitem__, x))).hexdigest() if x else "" for x in ids]
        for i in np.flatnonzero(bad):  # the units' tokens need not be the text's
            got = self.align([" " + rows[i]], "")[0]
            n_a[i], n_b[i], n_groups[i] = got[:3] if got else (0, 0, 0)
            out["groups_sha256"][i], out["links"][i] = (hashlib.sha256(got[3]).hexdigest(), got[4].tobytes()) if got else ("", b"")
        return out


def aligner(a_model: bytes, b_model: bytes) -> Aligner:
    key = hash((a_model, b_model))
    if key not in _workers:
        _workers[key] = Aligner(a_model, b_model)
    return _workers[key]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """Per document the counts, the digest of its groups and its links (32-bit pairs A id * B's size + B id); B's size."""
    models = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            models.append(f.read())
    shipped = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        from pyspark import TaskContext

        found = aligner(*shipped.value)
        row = [TaskContext.get().partitionId() << 36]

        def step(batch):
            for at in range(0, batch.num_rows if batch is not None else 0, 64):
                part = batch.slice(at, 64)
                out = found.documents(texts(part))
                rows = range(row[0], row[0] + part.num_rows)
                row[0] += part.num_rows
                yield {"doc_id": part.column("doc_id"), "row": list(rows), "n_links": [len(x) // 4 for x in out["links"]], **out}

        return step

    pieces = aligner(*models)
    return map_batches(only(docs, "doc_id", "text"), make, DOCS), len(pieces.b_bytes)


def link_arrays(batch) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.int32) for x in batch.column("links").to_pylist()]


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n over all links; each task sums its own before the exchange."""

    def make():
        held: list[np.ndarray] = []
        size = [0]

        def total() -> Iterator[dict]:
            if held:
                pair, n = np.unique(np.concatenate(held), return_counts=True)
                yield {"pair": pair, "n": n}
                held.clear()
                size[0] = 0

        def step(batch):
            if batch is None:
                yield from total()
                return
            found = link_arrays(batch)
            held.extend(found)
            size[0] += sum(map(len, found))
            if size[0] >= SUM_LINKS:
                yield from total()

        return step

    return map_batches(rows.select("links"), make, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pair (ascending), n and best of the most frequent pairs: all from the least n on with which they are limit at most."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for s in steps:  # a few hundred at most
        total += s["pairs"]
        if total > limit:
            break
        least = s["least"]
    if least is None:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)
    pdf = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    return pdf["pair"].to_numpy("int32"), pdf["n"].to_numpy("int64"), pdf["best"].to_numpy(bool)


def looked_up(rows: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """The rows with n_best and count_sum over the links in the table; for the others rows (row, pair, k) of their own."""
    shipped = rows.sparkSession.sparkContext.broadcast(frequent(counts, limit))
    kept = "doc_id bigint, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"

    def make():
        pairs, n, best = shipped.value

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            found = link_arrays(batch)
            at_row = np.repeat(np.arange(len(found)), [len(x) for x in found])
            flat = np.concatenate(found)
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            total, top = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
            np.add.at(total, at_row[known], n[at[known]])
            np.add.at(top, at_row[known], best[at[known]].astype(np.int64))
            nothing = [None] * len(found)
            names = [c.split()[0] for c in kept.split(", ")]
            yield {c: batch.column(c) for c in names} | {"n_best": top, "count_sum": total, "pair": nothing, "k": nothing}
            rest, k = np.unique(at_row[~known] << 32 | flat[~known].astype(np.int64), return_counts=True)
            if len(rest):
                nothing = [None] * len(rest)
                yield {c: nothing for c in names} | {"row": batch.column("row").take(pa.array(rest >> 32)), "n_best": nothing, "count_sum": nothing, "pair": (rest & 0xFFFFFFFF).astype(np.int32), "k": k}

        return step

    return map_batches(rows, make, f"{kept}, n_best bigint, count_sum bigint, pair int, k bigint")


def align_tokens(docs: DataFrame, a_path: str, b_path: str, limit: int = TABLE_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows, n_pieces = aligned(docs, a_path, b_path)
    rows = materialise(rows, "aligned")
    counts = materialise(pair_counts(rows), "pair-counts")
    piece = F.col("pair") % n_pieces
    most = counts.groupBy(piece.alias("piece")).agg(F.max("n").alias("most"))
    counted = materialise(counts.withColumn("piece", piece).join(F.broadcast(most), "piece").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")
    drop_table(counts)
    found = materialise(looked_up(rows, counted, limit), "links-counted")
    drop_table(rows)
    rest = found.where("pair is not null").select("row", "pair", "k").join(counted, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    own = found.where("pair is null").drop("pair", "k").join(rest, "row", "left")
    total = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return own.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))


SQL = None  # tokenizers can't be said in SQL; tests hold the query against the libraries on whole texts and a plain union of ends
