"""A trie of conversations' turns: globally sorted turn arrays, adjacent LCPs, a stack sweep and stitched boundaries.

A turn is known by 16 bytes of the SHA-256 of its role and text, a conversation by the array of its turns (one binary
key, whose order as bytes is the order of the arrays). The arrays are range-sorted by (key, conv_id), so that the
members of a node are a run of rows. Each range partition is swept once: the stack holds the nodes of the current row's
path; where the next row's LCP with it ends, deeper nodes are complete, go to their parent's sums and leave the stack.

Nodes on the paths of a partition's first and last rows may go on in its neighbours. They become a state of two stacks;
states of neighbours are merged, FAN at a time, in a tree of small jobs (an associative merge: shared nodes add up,
others are complete). A node's parent is known by its smallest member, which is known when the parent is complete:
where that is in another partition, the child's row finds it by the parent's key in a join.

The ids of the conversations that end at a node stand together, in order: their digest is taken in passing. A group that
touches a partition's border, or is long, goes on as chunks, which one task a group reads as a sorted stream.

Defined results: null roles and texts are empty; turns are ordered by turn (null first), then by digest; rows that
repeat another are turns of their own; rows without conv_id belong to no conversation and are left out; an empty table
gives an empty table; other columns are ignored. A conversation's array (16 bytes and a length a turn) is one row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import drop_table, map_batches, materialise, only, table

#: A conversation begins with turns of the first one of its block of BLOCK ids; how many: its id's CRC modulo HEADS.
BLOCK, HEADS = 5, 9
#: Bytes of a turn's digest.
SIZE = 16
#: Turns and rows of a range partition.
PART_TURNS = 1 << 20
#: Ids that a group of ends holds before they go on as a chunk; rows that wait for their parent before they go on by key.
CHUNK_IDS, WAITING = 8192, 20_000
#: States that are merged in one task.
FAN = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: Rows of a sweep: nodes, states (the stacks of a partition) and chunks of ends.
NODE, STATE, CHUNK = 0, 1, 2
SCHEMA = (
    "kind int, key binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends string, part bigint, chunk bigint, body string"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's original turns in order, as structs of turn, d (digest in hex) and n (bytes of text)."""
    own = only(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * SIZE)
    c = F.col("conv_id").cast("bigint")
    turns = own.select((c - c % BLOCK).alias("donor"), c.alias("conv_id"), F.struct("turn", digest.alias("d"), F.octet_length(text).cast("bigint").alias("n")).alias("t"))
    # one exchange serves the conversations and their blocks
    return turns.repartition("donor").groupBy("donor", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, key, sizes: the rebuilt conversations' arrays: digests joined, and bytes of each turn's text."""
    arrays = turn_arrays(conversations)
    block = Window.partitionBy("donor")
    head = F.first(F.when(F.col("conv_id") == F.col("donor"), F.slice("turns", 1, HEADS - 1)), ignorenulls=True).over(block)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    rows = arrays.withColumn("head", head).withColumn("h", h)
    none = F.slice("turns", 1, 0)
    full = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    rows = rows.select("conv_id", full.alias("turns"))
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), "")).alias("key"), F.transform("turns", lambda t: t["n"]).alias("sizes"))


def lcp(a: bytes, b: bytes) -> int:
    """How many turns two arrays have in common at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // SIZE
    if a[: hi * SIZE] == b[: hi * SIZE]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * SIZE : mid * SIZE] == b[lo * SIZE : mid * SIZE]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def path_keys(array: bytes) -> list[bytes]:
    """The keys of all nodes on an array's path, from the root on."""
    h, out = hashlib.sha256(), []
    for at in range(0, len(array) + SIZE, SIZE):
        out.append(h.copy().digest()[:SIZE])
        h.update(array[at : at + SIZE])
    return out


def path_key(array: bytes, depth: int) -> bytes:
    return hashlib.sha256(array[: depth * SIZE]).digest()[:SIZE]


class Node:
    """What is known of a node; ends: None (no member ends here so far), '' (they are in chunks), or the digest."""

    __slots__ = ("bytes", "children", "ends", "key", "least", "leaves", "n", "rows", "saved")

    def __init__(self, bytes_: int, least=None, n=0, children=0, leaves=0, saved=0, ends=None):
        self.bytes, self.least, self.n, self.children, self.leaves, self.saved, self.ends = bytes_, least, n, children, leaves, saved, ends
        self.rows: list[tuple] = []  # complete children that wait for this node's smallest member
        self.key: bytes | None = None

    def state(self) -> list:
        return [self.bytes, self.least, self.n, self.children, self.leaves, self.saved, self.ends]

    def add(self, other: Node) -> None:
        """Another part of the same node."""
        self.least = other.least if self.least is None else self.least if other.least is None else min(self.least, other.least)
        self.n, self.children, self.leaves, self.saved = self.n + other.n, self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.ends = "" if "" in (self.ends, other.ends) else self.ends or other.ends

    def complete(self, depth: int, parent: Node | None) -> tuple:
        """The node's row (key to saved sum and ends); its sums go to the parent's."""
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.bytes
        if parent is not None:
            parent.least = self.least if parent.least is None else min(parent.least, self.least)
            parent.n, parent.children, parent.leaves, parent.saved = parent.n + self.n, parent.children + 1, parent.leaves + self.leaves, parent.saved + self.saved
        return self.key, self.least, depth, self.n, self.children, self.leaves, self.saved, NO_ENDS if self.ends is None else self.ends or None


def node_row(row: tuple, parent: bytes | None, parent_conv: int | None) -> tuple:
    key, least, depth, n, children, leaves, saved, ends = row
    return NODE, key, parent, least, depth, parent_conv, n, children, leaves, saved, ends, None, None, None


class Sweep:
    """The sweep over one range partition's rows, in order."""

    def __init__(self, part: int, chunk_ids: int, waiting: int):
        self.part, self.chunk_ids, self.waiting = part, chunk_ids, waiting
        self.stack: list[Node] = []
        self.first: bytes | None = None
        self.last: bytes | None = None
        self.shared = 0  # the turns that all rows so far begin with
        self.left: dict[int, Node] = {}  # nodes of the first path that this partition has no more of
        self.ids: list[int] = []
        self.chunks = 0
        self.inner = False  # the group of ends began in this partition
        self.out: list[tuple] = []

    def add(self, key: bytes, conv_id: int, sizes: list[int]) -> None:
        if key != self.last:
            if self.last is None:
                self.first, self.shared, common = key, len(key) // SIZE, 0
                self.stack.append(Node(0))
            else:
                self.end_group(False)
                self.inner = True
                common = lcp(self.last, key)
                self.close(common)
                self.shared = min(self.shared, common)
            self.stack.extend(Node(b) for b in sizes[common:])
            self.last = key
        top = self.stack[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        self.ids.append(conv_id)
        if len(self.ids) >= self.chunk_ids:
            self.chunk()

    def chunk(self) -> None:
        top = self.stack[-1]
        top.ends, top.key = "", path_key(self.last, len(self.stack) - 1)
        self.out.append((CHUNK, top.key, None, None, None, None, None, None, None, None, None, self.part, self.chunks, ",".join(map(str, self.ids))))
        self.chunks += 1
        self.ids.clear()

    def end_group(self, at_end: bool) -> None:
        """No more members end at the top node in this partition."""
        top = self.stack[-1]
        if self.inner and not at_end and top.ends is None:
            top.ends = hashlib.sha256(",".join(map(str, self.ids)).encode()).hexdigest()
            self.ids.clear()
        elif self.ids:
            self.chunk()

    def close(self, depth: int) -> None:
        """Nodes deeper than depth have no more rows here."""
        while len(self.stack) > depth + 1:
            at = len(self.stack) - 1
            node = self.stack.pop()
            if at <= self.shared:  # of the first path, so that the partition before may have rows of it
                self.left[at] = node
                continue
            parent = self.stack[-1]
            row = node.complete(at, parent)
            self.out.extend(node_row(x, None, node.least) for x in node.rows)
            parent.rows.append(row)
            if len(parent.rows) >= self.waiting:
                parent.key = path_key(self.last, at - 1)
                self.by_key(parent)

    def by_key(self, node: Node) -> None:
        self.out.extend(node_row(x, node.key, None) for x in node.rows)
        node.rows.clear()

    def finish(self) -> None:
        if self.last is None:
            return
        self.end_group(True)
        m = self.shared
        left = [self.left.get(d) or self.stack[d] for d in range(len(self.first) // SIZE + 1)]
        right = self.stack[m + 1 :]
        for nodes, keys in ((left, path_keys(self.first)), (right, path_keys(self.last)[m + 1 :])):
            for node, node.key in zip(nodes, keys):
                self.by_key(node)
        self.out.append(state_row(self.part, self.first, self.last, m, left, right))


def state_row(part: int, first: bytes, last: bytes, m: int, left: list[Node], right: list[Node]) -> tuple:
    """left: the nodes of the first row's path; right: those of the last row's that it doesn't share with the first (deeper than m)."""
    body = json.dumps([m, [x.state() for x in left], [x.state() for x in right]])
    return STATE, first, last, None, None, None, None, None, None, None, None, part, None, body


class State:
    """A run of neighbouring partitions: the nodes of its first and its last row's path, the first m + 1 in common."""

    def __init__(self, first: bytes, last: bytes, body: str):
        self.first, self.last = first, last
        self.m, left, right = json.loads(body)
        self.left = [Node(*x) for x in left]
        self.right = self.left[: self.m + 1] + [Node(*x) for x in right]

    def merge(self, after: State, out: list[tuple]) -> None:
        """Takes in the run that follows; rows of complete nodes go to out."""
        common = lcp(self.last, after.first)
        keys, new_keys = path_keys(self.last), path_keys(after.first)
        mine, theirs = self.right, after.left
        for path, held, m in ((mine, keys, self.m), (theirs, new_keys, after.m)):
            for d in range(len(path) - 1, max(common, m), -1):
                out.append(self.done(path[d], d, path[d - 1], held))
        left, right = list(self.left), list(after.right)
        for d in range(common + 1):
            mine[d].add(theirs[d])
        for d in range(common, -1, -1):
            if d <= self.m:
                left[d] = mine[d]
            if d <= after.m:
                right[d] = mine[d]
            if d > self.m and d > after.m:
                out.append(self.done(mine[d], d, mine[d - 1], keys))
        self.m = min(self.m, after.m, common)
        self.left, self.right, self.last = left, right, after.last

    def done(self, node: Node, depth: int, parent: Node | None, keys: list[bytes]) -> tuple:
        node.key = keys[depth]
        return node_row(node.complete(depth, parent), keys[depth - 1] if depth else None, None)

    def close(self, out: list[tuple]) -> None:
        """Nothing stands before or after: all nodes are complete."""
        for path, array, least in ((self.right, self.last, self.m + 1), (self.left, self.first, self.m + 1), (self.left[: self.m + 1], self.first, 0)):
            keys = path_keys(array)
            for d in range(len(path) - 1, least - 1, -1):
                out.append(self.done(path[d], d, path[d - 1] if d else None, keys))


def columns(rows: list[tuple]) -> dict:
    return dict(zip(NAMES, map(list, zip(*rows))))


def swept(arrays: DataFrame, parts: int, chunk_ids: int, waiting: int) -> DataFrame:
    """The rows of the sweeps over arrays, range-sorted into parts."""

    def make():
        from pyspark import TaskContext

        sweep = Sweep(TaskContext.get().partitionId(), chunk_ids, waiting)

        def step(batch: pa.RecordBatch | None) -> Iterator[dict]:
            if batch is None:
                sweep.finish()
            else:
                for key, conv_id, sizes in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "sizes"))):
                    sweep.add(key, conv_id, sizes)
            rows, sweep.out = sweep.out, []
            for at in range(0, len(rows), 8192):
                yield columns(rows[at : at + 8192])

        return step

    return map_batches(arrays.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id"), make, SCHEMA)


def stitched(states: DataFrame, fan: int, last: bool) -> DataFrame:
    """States merged, fan neighbours a task, into rows of complete nodes and one state a task (if it isn't the last one)."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        out: list[tuple] = []
        held = None
        for first, end, body in zip(pdf["key"], pdf["parent"], pdf["body"]):
            state = State(bytes(first), bytes(end), body)
            if held is None:
                held = state
            else:
                held.merge(state, out)
        if last:
            held.close(out)
        else:
            out.append(state_row(int(pdf["part"].iloc[0]) // fan, held.first, held.last, held.m, held.left, held.right[held.m + 1 :]))
        return pd.DataFrame(columns(out), columns=NAMES, dtype=object)

    return states.select("key", "parent", "part", "body").groupBy(F.floor(F.col("part") / fan).alias("g")).applyInPandas(run, SCHEMA)


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """key, digest: the SHA-256 of each group's chunks, joined by commas in order; a task streams them."""

    def make():
        held: list = [None, None]

        def ended() -> Iterator[dict]:
            if held[0] is not None:
                yield {"key": [held[0]], "digest": [held[1].hexdigest()]}

        def step(batch):
            if batch is None:
                yield from ended()
                return
            for key, body in zip(batch.column("key").to_pylist(), batch.column("body").to_pylist()):
                if key != held[0]:
                    yield from ended()
                    held[:] = key, hashlib.sha256(body.encode())
                else:
                    held[1].update(b"," + body.encode())

        return step

    return map_batches(chunks.select("key", "part", "chunk", "body").repartition("key").sortWithinPartitions("key", "part", "chunk"), make, "key binary, digest string")


def prefix_trie(conversations: DataFrame, part_turns: int = PART_TURNS, chunk_ids: int = CHUNK_IDS, waiting: int = WAITING, fan: int = FAN) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations (the columns of the contract)."""
    arrays = materialise(rebuilt(conversations), "turn-arrays")
    rows, turns = arrays.agg(F.count("*"), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    least = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    parts = max(1, -(-(rows + turns) // part_turns), min(least, (rows + turns) // 20_000))
    found = [materialise(swept(arrays, parts, chunk_ids, waiting), "trie-sweep")]
    drop_table(arrays)
    states = found[0].where(F.col("kind") == STATE)
    top = states.agg(F.max("part")).first()[0]
    while top is not None:
        found.append(materialise(stitched(states, fan, top < fan), "trie-stitch"))
        states = found[-1].where(F.col("kind") == STATE)
        top = None if top < fan else top // fan
    nodes = found[0]
    for x in found[1:]:
        nodes = nodes.unionByName(x)
    nodes = nodes.where(F.col("kind") == NODE)
    ready = F.col("parent").isNull() & F.col("ends").isNotNull()
    keyed = nodes.where("key is not null").select(F.col("key").alias("parent"), F.col("conv_id").alias("_conv"))
    digests = chunk_digests(found[0].where(F.col("kind") == CHUNK))
    rest = nodes.where(~ready).join(keyed, "parent", "left").join(digests, "key", "left")
    rest = rest.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv")).withColumn("ends", F.coalesce("ends", "digest"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return nodes.where(ready).select(*out).unionByName(rest.select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The CRC goes over the id's digits: each is folded in, then eight times shifted (-1).
SQL = """
WITH turns AS (
    SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS n,
           sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT c, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(n ORDER BY turn NULLS FIRST, d) AS ns,
           (xor(list_reduce(flatten([[4294967295]] || list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                            lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9)::BIGINT AS h
    FROM turns GROUP BY c),
rebuilt AS (
    SELECT a.c, list_concat(coalesce(b.ds[:a.h], []), a.ds[a.h + 1:]) AS ds, list_concat(coalesce(b.ns[:a.h], []), a.ns[a.h + 1:]) AS ns
    FROM own a LEFT JOIN own b ON b.c = a.c - a.c % 5),
steps AS (SELECT c, ds, ns, unnest(generate_series(0, len(ds)::BIGINT)) AS depth FROM rebuilt),
nodes AS (
    SELECT ds[:depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(max(ns[depth]), 0) AS own,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(ds) = depth), '')) AS ends_sha256
    FROM steps GROUP BY ds[:depth], depth),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY path[:depth - 1]),
family AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
above AS (SELECT path[:up] AS path, n_children, own FROM (SELECT *, unnest(generate_series(0, depth)) AS up FROM family)),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM above GROUP BY path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM family f JOIN sums s USING (path) LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.path = f.path[:f.depth - 1]
"""
