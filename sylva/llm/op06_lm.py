r"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation (NCE) in numpy.

Tokens are words (A-Z lower-cased) and one end a text, known by 64-bit hashes. Counts of all training tokens come from one
aggregation. The model predicts units, whose number grows with the root of the training vocabulary: the end and the most
frequent words are units of their own (three quarters), the other words fall by hash into the rest, and within a unit a word
has its smoothed share of the unit's count (one unseen word a unit). Units in order of their counts are cut into classes of
about the same count and a bounded number of units, so classes and units of a class both grow with the root of the units.
So P(word | context) = P(class | context) * P(unit | class, context) * P(word | unit).

Both levels are log-bilinear: the context vector is c1 * r[u1] + c2 * r[u2] (u1, u2: the two units before, or the start), its
product with a class's or unit's vector, plus a bias, is the unnormalised score. All training tokens take part: NCE in
minibatches (noise classes shared by a minibatch, noise units by the tokens of a class) over buckets of texts, in ROUNDS
synchronous rounds that each start from the mean of the one before (see train_model), so the model is a function of the
rows alone. A small corpus is gone through several times, a large one once. A token's score is exactly normalised, over
all classes and over the units of its class.

Words' counts: the TABLE_ROWS most frequent words (at most) are broadcast as arrays; the others of a text (few) go as rows
(text, word, times) to a join with the counts, which uses the hash of rare words and so has no hot key.

Defined results: null text counts as empty (its end only); null doc_ids are trained on as crc32 of the empty string says;
repeated rows count each; an empty table gives an empty table; without training tokens the base is 0.5 / 0.5 for every
token; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import byte_texts, drop_table, map_batches, materialise, table
from sylva.llm.wordhash import chunks, word_table

FOLDS, HELD_OUT = 5, 1
#: The least number of units; units for the root of the vocabulary; one of OTHERS units is of words without their own.
UNITS, PER_ROOT, OTHERS, DIM = 512, 10, 4, 16
BATCH, NOISE, CLASS_NOISE, RATE, SEED = 4096, 64, 8, 0.03, 7
#: Rounds of learning; the least tokens of a bucket, and tokens a unit; parts of one in which moves are summed.
ROUNDS, LEAST_BUCKET, PER_UNIT, SCALE = 4, 1 << 20, 256, 1 << 24
#: Tokens that are dealt to their classes at once, and normalised at once; scores that no exponential overflows by.
SLICE, PART, SAFE = 1 << 16, 1 << 12, 60.0
TABLE_ROWS, MERGE = 1 << 18, 1 << 21
#: The end's key; words' hashes have 63 bits.
END = np.int64(-1)


def keys_of(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and rows of all tokens of texts, each text's end included, in order."""
    h, row, _, _ = word_table(rows)
    n = np.bincount(row, minlength=len(rows))
    keys = np.full(len(h) + len(rows), END, np.int64)
    rows_of = np.repeat(np.arange(len(rows)), n + 1)
    keys[np.arange(len(h)) + row] = (h >> np.uint64(1)).view(np.int64)
    return keys, rows_of


def folded(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % FOLDS
    return docs.select("doc_id", "text", (fold == HELD_OUT).alias("held_out"))


def count_words(training: DataFrame) -> DataFrame:
    """(key, c) of all training tokens; a task sends what it has counted whenever MERGE tokens are held."""

    def make():
        held: list[np.ndarray] = []
        size = [0]

        def flush():
            if held:
                k, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                size[0] = 0
                for at in range(0, len(k), 1 << 16):
                    yield {"key": k[at : at + (1 << 16)], "c": n[at : at + (1 << 16)]}

        def step(batch):
            if batch is None:
                yield from flush()
                return
            for _, part in chunks(byte_texts(batch)):
                keys, _ = keys_of(part)
                held.append(keys)
                size[0] += len(keys)
                if size[0] > MERGE:
                    yield from flush()

        return step

    return map_batches(training.select("text"), make, "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def number_of_units(vocabulary: int) -> int:
    return max(UNITS, PER_ROOT * math.isqrt(vocabulary))


class Units:
    """Key -> unit: own words by their place in own, others by hash into the tail units after them."""

    def __init__(self, own: list[int], size: int, tail: int):
        keys = np.array(own, np.int64)
        order = np.argsort(keys)
        self.keys, self.units, self.first, self.tail = keys[order], order.astype(np.int32), size - tail, tail

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = (self.first + keys % self.tail).astype(np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            own = self.keys[at] == keys
            out[own] = self.units[at[own]]
        return out


def contexts(units: np.ndarray, rows: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token, and the one before that, start before a text."""
    one, two = np.full(len(units), start, np.int32), np.full(len(units), start, np.int32)
    same = rows[1:] == rows[:-1]
    one[1:][same] = units[:-1][same]
    same = rows[2:] == rows[:-2]
    two[2:][same] = units[:-2][same]
    return one, two


def log_sum(s: np.ndarray, bound: float = np.inf) -> np.ndarray:
    """The log of the sum of each row's exponentials; overwrites s. No entry is larger than bound or less than -bound."""
    if bound < SAFE:  # no exponential is too large or small for single precision
        return np.log(np.exp(s, out=s).sum(1))
    top = s.max(1, keepdims=True)
    s -= top
    return np.log(np.exp(s, out=s).sum(1)) + top[:, 0]


def noise_terms(s: np.ndarray) -> np.ndarray:
    """-sigma(s) of each entry; overwrites s."""
    np.clip(s, -30, 30, out=s)
    np.negative(s, out=s)
    np.exp(s, out=s)
    s += 1
    return np.divide(-1, s, out=s)


class LogBilinear:
    """r: vectors of context units; c: the two places' weights; qc, bc: of classes; q, b: of units within their class.

    Vectors of units start at nothing, so a unit that is never seen keeps its share of its class.
    """

    def __init__(self, log_unigram: np.ndarray, dim: int = DIM, seed: int = SEED):
        rng, n = np.random.default_rng(seed), len(log_unigram)
        mass = np.exp(log_unigram) / np.exp(log_unigram).sum()
        # places: units in order of their counts, so that a class is a range
        order = np.argsort(-mass, kind="stable")
        self.place = np.empty(n, np.int32)
        self.place[order] = np.arange(n)
        mass, root = mass[order], math.isqrt(n - 1) + 1
        starts, held = [0], 0.0
        for i in range(n):
            if i > starts[-1] and (held + mass[i] > 1 / root or i - starts[-1] >= 2 * root):
                starts.append(i)
                held = 0.0
            held += mass[i]
        self.starts = np.array([*starts, n])
        self.class_of = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(self.starts))
        of_class = np.add.reduceat(mass, starts)
        self.noise_c, self.noise = np.log(of_class).astype(np.float32), np.log(mass / of_class[self.class_of]).astype(np.float32)
        self.cumulative_c, self.cumulative = np.cumsum(of_class), np.concatenate([[0.0], np.cumsum(mass)])
        self.r = rng.normal(0, 0.1, (n + 1, dim)).astype(np.float32)
        self.c = np.ones((2, dim), np.float32) * np.float32([[1.0], [0.5]])
        self.qc = rng.normal(0, 0.1, (len(starts), dim)).astype(np.float32)
        self.bc, self.q, self.b = self.noise_c.copy(), np.zeros((n, dim), np.float32), self.noise.copy()
        self.g2 = [np.full(x.shape, 1e-10, np.float32) for x in self.weights()]

    def weights(self) -> tuple[np.ndarray, ...]:
        return self.r, self.c, self.qc, self.bc, self.q, self.b

    def step(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """A minibatch of NCE, Adagrad."""
        place = self.place[unit]
        cls = self.class_of[place]
        order = np.argsort(short(cls, len(self.qc)), kind="stable")
        one, two, place, cls = one[order], two[order], place[order], cls[order]
        n, k, m = len(unit), NOISE, CLASS_NOISE
        r1, r2 = self.r[one], self.r[two]
        h = r1 * self.c[0] + r2 * self.c[1]
        # classes: d/ds of log sigma(s - log k p(class)) and of the noise terms
        noise = np.minimum(np.searchsorted(self.cumulative_c, rng.random(k) * self.cumulative_c[-1]), len(self.qc) - 1)
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        edges, has = np.append(first, n).tolist(), cls[first]
        own = self.qc[cls]
        s = np.einsum("ij,ij->i", h, own) + self.bc[cls] - self.noise_c[cls] - np.float32(np.log(k))
        up = 1 / (1 + np.exp(np.clip(s, -30, 30)))
        s = h @ self.qc[noise].T
        s += self.bc[noise] - self.noise_c[noise] - np.float32(np.log(k))
        down = noise_terms(s)
        dh = up[:, None] * own
        dh += down @ self.qc[noise]
        gqc, gbc = np.zeros_like(self.qc), np.bincount(cls, up, len(self.qc)).astype(np.float32)
        gqc[has] = np.add.reduceat(up[:, None] * h, first, axis=0)
        np.add.at(gqc, noise, down.T @ h)
        np.add.at(gbc, noise, down.sum(0))
        # units: the same within each class that the minibatch has, whose tokens follow each other
        lo, hi = self.starts[has][:, None], self.starts[has + 1][:, None]
        low = self.cumulative[lo]
        drawn = np.searchsorted(self.cumulative, low + rng.random((len(has), m)) * (self.cumulative[hi] - low), side="right") - 1
        drawn = np.clip(drawn, lo, hi - 1)
        own = self.q[place]
        s = np.einsum("ij,ij->i", h, own) + self.b[place] - self.noise[place] - np.float32(np.log(m))
        up = 1 / (1 + np.exp(np.clip(s, -30, 30)))
        qn, bn = self.q[drawn], self.b[drawn] - self.noise[drawn] - np.float32(np.log(m))
        s = np.empty((n, m), np.float32)
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            np.matmul(h[lo:hi], qn[i].T, out=s[lo:hi])
            s[lo:hi] += bn[i]
        down = noise_terms(s)
        own *= up[:, None]
        dh += own
        of_noise = np.empty((len(has), m, h.shape[1]), np.float32)
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            dh[lo:hi] += down[lo:hi] @ qn[i]
            np.matmul(down[lo:hi].T, h[lo:hi], out=of_noise[i])
        at = np.concatenate([place, drawn.ravel().astype(np.int32)])
        ups = np.empty((len(at), h.shape[1] + 1), np.float32)
        np.multiply(up[:, None], h, out=ups[:n, :-1])
        ups[n:, :-1] = of_noise.reshape(-1, h.shape[1])
        ups[:n, -1], ups[n:, -1] = up, np.add.reduceat(down, first, axis=0).ravel()
        gc = np.stack([np.einsum("ij,ij->j", dh, r1), np.einsum("ij,ij->j", dh, r2)])
        r, gr = sums(np.concatenate([one, two]), np.concatenate([dh * self.c[0], dh * self.c[1]]))
        u, g = sums(at, ups)
        for x, i, g, g2 in zip(self.weights(), (r, ..., ..., ..., u, u), (gr, gc, gqc, gbc, g[:, :-1], g[:, -1]), self.g2):
            g = g / np.float32(n)
            now = g2[i] + g * g
            g2[i] = now
            x[i] += np.float32(rate) * g / np.sqrt(now)

    def train(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray, rng: np.random.Generator, rate: float = RATE) -> None:
        for at in range(0, len(unit), BATCH):
            self.step(one[at : at + BATCH], two[at : at + BATCH], unit[at : at + BATCH], rng, rate)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.weights()])

    def moved(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how much each weight has moved from start, in whole parts of SCALE, and which rows of the weights have."""
        move = np.rint((self.flat().astype(np.float64) - start) * SCALE).astype(np.int64)
        at, touched = 0, []
        for x in self.weights():
            touched.append(move[at : at + x.size].reshape(len(x), -1).any(1))
            at += x.size
        return move, np.concatenate(touched).astype(np.int64)

    def move(self, sums: np.ndarray, touched: np.ndarray) -> None:
        """Moves each row by the mean of those that have moved it."""
        at = row = 0
        for x in self.weights():
            n = np.maximum(touched[row : row + len(x)], 1)
            x += (sums[at : at + x.size].reshape(len(x), -1) / n[:, None] / SCALE).reshape(x.shape).astype(np.float32)
            at, row = at + x.size, row + len(x)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.weights():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def log_probs(self, one: np.ndarray, two: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log P(unit | contexts) of each token."""
        out = np.empty(len(unit))
        reach_c, reach = np.abs(self.qc).max(0), np.abs(self.q).max(0)
        most_c, most = np.abs(self.bc).max(), np.abs(self.b).max()
        for at in range(0, len(unit), SLICE):
            # tokens of a class follow each other
            place = self.place[unit[at : at + SLICE]]
            order = np.argsort(short(self.class_of[place], len(self.qc)), kind="stable")
            o, t, p = one[at : at + SLICE][order], two[at : at + SLICE][order], place[order]
            cls = self.class_of[p]
            h = self.r[o] * self.c[0] + self.r[t] * self.c[1]
            of_h = np.abs(h).max(0)
            bound_c, bound = of_h @ reach_c + most_c, of_h @ reach + most
            got = np.empty(len(p))
            for lo in range(0, len(p), PART):
                s = h[lo : lo + PART] @ self.qc.T
                s += self.bc
                got[lo : lo + PART] = s[np.arange(len(s)), cls[lo : lo + PART]]
                got[lo : lo + PART] -= log_sum(s, bound_c)
            edges = np.searchsorted(cls, np.arange(len(self.qc) + 1))
            for k in np.flatnonzero((np.diff(edges) > 0) & (np.diff(self.starts) > 1)):
                lo, hi = self.starts[k], self.starts[k + 1]
                q, b = self.q[lo:hi].T, self.b[lo:hi]
                for i in range(edges[k], edges[k + 1], PART):
                    j = min(i + PART, edges[k + 1])
                    s = h[i:j] @ q
                    s += b
                    got[i:j] += s[np.arange(j - i), p[i:j] - lo]
                    got[i:j] -= log_sum(s, bound)
            out[at : at + SLICE][order] = got
        return out

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of (unit before, class) with the bias, of (unit before that, class), and the log normaliser of each pair.

        What log_probs says of classes, as a whole: only for few units.
        """
        first, second = (self.r * self.c[0]) @ self.qc.T + self.bc, (self.r * self.c[1]) @ self.qc.T
        return first, second, np.stack([log_sum(second + x) for x in first])


def short(index: np.ndarray, size: int) -> np.ndarray:
    """The same numbers in two bytes if they fit, which sort faster."""
    return index.astype(np.uint16) if size <= 1 << 16 else index


def sums(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different indices and their rows' sums."""
    order = np.argsort(short(index, int(index.max()) + 1), kind="stable")
    at = index[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def bucket_tokens(units: int) -> int:
    """Tokens of a bucket: many for each unit, so what models weigh stays small beside what they learn from."""
    return max(LEAST_BUCKET, PER_UNIT * units)


def train_model(training: DataFrame, units: Units, log_unigram: np.ndarray, tokens: int) -> LogBilinear:
    """One model of all training texts, the same for any partitions and any order of rows.

    Texts fall by hash into buckets of about bucket_tokens(), in which they are in the order of their hashes. In round r the
    buckets b with b = r modulo min(ROUNDS, buckets) learn, each from the round's start; a bucket's minibatches are drawn
    with a seed of its own. At the end of a round every row of the weights moves by the mean of what the buckets that have
    touched it say. Those sums are of integers (SCALE), so their order is indifferent.
    """
    spark, size = training.sparkSession, len(log_unigram)
    buckets = max(1, round(tokens / bucket_tokens(size)))
    rounds = min(ROUNDS, buckets)
    shipped = spark.sparkContext.broadcast(units)

    def make():
        own = shipped.value

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            h, at = batch.column("h").to_numpy(), 0
            for _, part in chunks(byte_texts(batch)):
                keys, rows = keys_of(part)
                unit = own.of(keys).astype("<i4")
                edges = np.searchsorted(rows, np.arange(len(part) + 1))
                yield {"h": h[at : at + len(part)], "units": [unit[a:b].tobytes() for a, b in zip(edges, edges[1:])]}
                at += len(part)

        return step

    rows = map_batches(training.select(F.xxhash64("doc_id", "text").alias("h"), "text"), make, "h bigint, units binary")
    rows = materialise(rows.withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(buckets)).cast("int")), "units")
    model = LogBilinear(log_unigram)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((log_unigram, model.flat(), turn))
        found = learnt(rows.where(F.col("bucket") % rounds == turn % rounds), sent, size).collect()  # one row, which grows with the units
        if found:
            model.move(np.frombuffer(found[0]["moved"], "<i8"), np.frombuffer(found[0]["touched"], "<i8"))
        sent.destroy()
    drop_table(rows)
    model.g2 = []  # nothing is trained any more
    return model


SUMS = "part int, moved binary, touched binary"


def learnt(rows: DataFrame, sent, size: int) -> DataFrame:
    """The sums of what the buckets of a round have moved, and by how many: one row."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "h", "units")

    def make():
        log_unigram, start, turn = sent.value
        state: dict = {"bucket": None, "model": None, "held": [], "size": 0, "sums": None}

        def learn():
            if state["held"]:
                unit = np.concatenate(state["held"])
                text = np.repeat(np.arange(len(state["held"])), [len(x) for x in state["held"]])
                one, two = contexts(unit, text, size)
                order = state["rng"].permutation(len(unit))
                state["model"].train(one[order], two[order], unit[order], state["rng"])
            state["held"], state["size"] = [], 0

        def end():
            if state["model"] is not None:
                learn()
                moved, touched = state["model"].moved(start)
                if state["sums"] is None:
                    state["sums"] = [moved, touched]
                else:
                    state["sums"][0] += moved
                    state["sums"][1] += touched
            state["model"] = None

        def step(batch):
            if batch is None:
                end()
                if state["sums"] is not None:
                    from pyspark import TaskContext

                    part = TaskContext.get().partitionId() % 64
                    yield {"part": [part], "moved": [state["sums"][0].tobytes()], "touched": [state["sums"][1].tobytes()]}
                return
            for bucket, raw in zip(batch.column("bucket").to_pylist(), batch.column("units").to_pylist()):
                if bucket != state["bucket"]:
                    end()
                    state.update(bucket=bucket, model=LogBilinear(log_unigram), rng=np.random.default_rng([SEED, turn, bucket]))
                    state["model"].load(start)
                state["held"].append(np.frombuffer(raw, "<i4"))
                state["size"] += len(state["held"][-1])
                if state["size"] >= 64 * BATCH:
                    learn()

        return step

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: sum(np.frombuffer(x, "<i8") for x in pdf[c]).astype("<i8").tobytes()
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // 8], "moved": [total("moved")], "touched": [total("touched")]})

    found = map_batches(dealt.select("bucket", "units"), make, SUMS)
    for _ in range(3):  # 64 parts, 8, then one
        found = found.groupBy("part").applyInPandas(add, SUMS)
    return found


SCORED = "row string, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, key bigint, times bigint"


def score_texts(docs: DataFrame, shipped) -> DataFrame:
    """A row per text with what its frequent words give, and rows (text, key, times) of its other words."""

    def make():
        import uuid

        task, count = uuid.uuid4().hex, [0]
        units, keys_known, base_known, within_known, model = shipped.value

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            ids, held = batch.column("doc_id"), batch.column("held_out")
            for at, part in chunks(byte_texts(batch)):
                keys, rows = keys_of(part)
                m = len(part)
                words, which = np.unique(keys, return_inverse=True)  # each different word is looked up once
                unit = units.of(words)[which]
                token = model.log_probs(*contexts(unit, rows, len(model.place)), unit)
                place = np.minimum(np.searchsorted(keys_known, words), max(0, len(keys_known) - 1))
                known = keys_known[place] == words if len(keys_known) else np.zeros(len(words), bool)
                place, known = place[which], known[which]
                base = np.bincount(rows[known], base_known[place[known]], m)
                token[known] += within_known[place[known]]
                score = np.bincount(rows, token, m) / np.log(10)
                names = [f"{task}-{count[0] + i}" for i in range(m)]
                count[0] += m
                none = [None] * m
                yield {"row": names, "doc_id": ids[at : at + m], "held_out": held[at : at + m], "n_tokens": np.bincount(rows, minlength=m), "n_known": np.bincount(rows[known], minlength=m), "base": base, "score": score, "key": none, "times": none}
                if not known.all():
                    rest, of = keys[~known], rows[~known]
                    order = np.lexsort((rest, of))
                    rest, of = rest[order], of[order]
                    new = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]) | (of[1:] != of[:-1])]))
                    times = np.diff(np.append(new, len(rest)))
                    none = [None] * len(new)
                    yield {"row": [names[i] for i in of[new]], "doc_id": none, "held_out": none, "n_tokens": none, "n_known": none, "base": none, "score": none, "key": rest[new], "times": times}

        return step

    return map_batches(docs, make, SCORED)


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = folded(docs)
    training = rows.where("not held_out")
    counts = materialise(count_words(training), "counts")
    n_total, v_total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    size = number_of_units(v_total)
    n_tail = size // OTHERS
    n_own = size - n_tail
    top = counts.orderBy(F.expr(f"key = {END}").desc(), F.desc("c"), "key").limit(n_own).toPandas()  # grows with the root of the words
    units = Units(top["key"].tolist(), size, n_tail)
    own = spark.createDataFrame([(int(k), True) for k in top["key"]], "key bigint, own boolean")
    rare = counts.join(F.broadcast(own), "key", "left_anti")
    tail = rare.groupBy((F.col("key") % n_tail).cast("int").alias("tail")).agg(F.sum("c").alias("m"), F.count("*").alias("v")).collect()  # n_tail rows at most
    mass = np.zeros(size)
    mass[: len(top)] = top["c"]
    in_unit = np.zeros(size)
    for r in tail:
        mass[n_own + r["tail"]], in_unit[n_own + r["tail"]] = r["m"], r["v"]
    log_unigram = np.log((mass + 0.5) / (mass.sum() + 0.5 * size))
    model = train_model(training, units, log_unigram, int(n_total))

    # the most frequent words, as far as TABLE_ROWS go, by a least count
    steps = counts.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("step")).agg(F.count("*").alias("rows"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()
    least, taken = None, 0
    for s in steps:
        taken += s["rows"]
        if taken > TABLE_ROWS:
            break
        least = s["least"]
    frequent = counts.where(F.col("c") >= least if least is not None else F.lit(False)).toPandas().sort_values("key")
    key, c = frequent["key"].to_numpy("int64"), frequent["c"].to_numpy("float64")
    unit = units.of(key)
    base = np.log10((c + 0.5) / (n_total + 0.5 * (v_total + 1)))
    within = np.where(unit < n_own, 0.0, np.log((c + 0.5) / (mass[unit] + 0.5 * (in_unit[unit] + 1))))
    shipped = spark.sparkContext.broadcast((units, key, base, within, model))
    scored = materialise(score_texts(rows, shipped), "scored")

    tails = spark.createDataFrame([(i, float(mass[n_own + i]), float(in_unit[n_own + i])) for i in range(n_tail)], "tail int, m double, v double")
    # an own unit's word that the table of frequent words lacks can only be one of a tiny corpus
    rest = scored.where("key is not null").select("row", "key", "times").join(counts, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = rest.join(F.broadcast(tails), (F.col("key") % n_tail).cast("int") == F.col("tail")).join(F.broadcast(own), "key", "left")
    one = F.log10((F.col("c") + 0.5) / F.lit(float(n_total) + 0.5 * (v_total + 1)))
    share = F.when(F.col("own"), F.lit(0.0)).otherwise(F.log10((F.col("c") + 0.5) / (F.col("m") + 0.5 * (F.col("v") + 1))))
    extra = rest.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k2"), F.sum(F.col("times") * one).alias("b2"), F.sum(F.col("times") * share).alias("s2"))
    out = scored.where("key is null").join(extra, "row", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k2")).alias("n_known"), F.lit(int(n_total)).cast("bigint").alias("train_tokens"), (F.col("base") + zero("b2")).alias("base_score"), (F.col("score") + zero("s2")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


SQL = None  # a trained model can't be said in SQL; tests hold the base against brute force and the score against held-out texts
