r"""N-gram Jaccard join with a prefix tree.

Documents with the same lower-cased word sequence are one class; each class has one text and the set of its k-word
shingles. Shingles have one global order: rare ones by hash, then those that are frequent (a table of at most HOT_ROWS,
by count). Two sets that reach the threshold t share a shingle among the first n - ceil(t n) + 1 of each, their prefixes.

1. Prefixes are dealt by shingle. A shingle that classes of a near size share makes them a group; groups with the same
   members are compared once, by their first shingle. A pair is found in the group of the first shingle that it shares,
   so a group's lists hold the shared part of the prefixes from the group's shingle on.
2. tree_join() stores a group's lists in a prefix tree and traverses it once for all probes together: the lists below a
   node share the counts of what each probe has of the path so far, and a probe leaves a subtree when its count and what
   remains of the lists can't reach what the whole sets need (the threshold less the rest behind the prefixes). What is
   left are candidate links; their components are candidate groups. A group of over GROUP classes is one as it is.
3. The whole sets of each candidate group meet once, are stored in a tree in the same way and joined by the threshold
   itself. A probe also leaves a subtree that is wholly of its own component, so a large group of copies is not compared
   pair by pair.
4. A candidate group of over BLOCK classes is dealt into blocks by hash; then one class for each block and component is
   dealt anew, which joins the parts of large groups of copies. Groups of step 1 that still have several components are
   compared by step 2 in squares of blocks, those of all but the largest component with all. The classes of a square that
   are in a pair of different components are joined by whole sets, in the square's own tree. So no link between components
   is missed, and pairs are never listed, neither those of copies nor those that don't link.
5. Components of all links. Rows of copies join their class by key at the end. Nothing about all documents comes to the
   driver.

Defined results: null or blank text has an empty set and links with nothing (its own component); null doc_ids are kept
(the smallest id of a component ignores them); repeated rows are copies; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import string
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sylva.llm.common import ASCII_LOWER, BLANK, bloom_filter, byte_texts, drop_table, fresh, in_bloom, map_batches, materialise, only, table
from sylva.llm.components import components
from sylva.llm.wordhash import chunks, shingle_sets

K, PERCENT = 4, 85
#: Frequent shingles: at least HOT_MIN classes, found among local counts; the table's size is bounded. A shingle of over
#: SPLIT classes is dealt by parts.
HOT_ROWS, HOT_MIN, FLUSH, SPLIT = 1 << 18, 8, 1 << 21, 2048
#: Classes of a group whose prefixes are compared in one tree, of a block of whole sets, remembered by a map task.
GROUP, BLOCK, SEEN = 2048, 1024, 200_000
#: Shingles of a path that are counted before bounds are looked at again.
STEP = 64


def min_overlap(total, percent: int = PERCENT):
    """The least intersection of two sets of total shingles together for 100 * intersection >= percent * union."""
    return -(-percent * total // (100 + percent))


def tree_join(sets: list[np.ndarray], sizes: np.ndarray, rest: np.ndarray, labels: np.ndarray, percent: int, every: bool = False, seen: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets with different labels whose lists share min_overlap(sizes) - max(rest) items, and near sizes.

    sets: ascending arrays of distinct items. Joins labels as it goes, so what it returns is a forest, without its cycles;
    all pairs of different labels with every. seen: marks the sets that are in one of all those pairs, and returns none.
    """
    m = len(sets)
    if m < 2 or len({*labels.tolist()}) < 2:
        return []
    lens = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(lens)])
    raw = ids.astype(">u4").tobytes()
    order = sorted(range(m), key=lambda i: raw[4 * bounds[i] : 4 * bounds[i + 1]])
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    # which sets have an item: post[first[item] : first[item + 1]]
    by_item = np.argsort(ids, kind="stable")
    post = np.repeat(rank, lens)[by_item]
    first = np.searchsorted(ids[by_item], np.arange(ids.max() + 2 if len(ids) else 1))
    items = [ids[bounds[i] : bounds[i + 1]] for i in order]
    n, rest, lens, lab = np.asarray(sizes)[order].astype(np.int64), np.asarray(rest)[order], lens[order], np.array(labels)[order]
    common = np.zeros(m, np.int64)  # of a set and the one before it
    for i in range(1, m):
        k = min(lens[i - 1], lens[i])
        differ = items[i - 1][:k] != items[i][:k]
        common[i] = differ.argmax() if differ.any() else k
    found = []
    given, seen = seen, None if seen is None else np.zeros(m, bool)

    def counts(part: np.ndarray) -> np.ndarray:
        width = first[part + 1] - first[part]
        at = np.repeat(first[part] - np.cumsum(width) + width, width) + np.arange(width.sum())
        return np.bincount(post[at], minlength=m)

    stack = [(0, m, 0, np.arange(m), np.zeros(m, np.int64))]
    while stack:
        lo, hi, depth, alive, have = stack.pop()
        own = lab[lo:hi]
        least, most, longest, behind = n[lo:hi].min(), n[lo:hi].max(), lens[lo:hi].max(), rest[lo:hi].max()
        size = n[alive]
        ok = (alive > lo) & (100 * np.minimum(size, most) >= percent * np.maximum(size, least))  # the later of two probes
        if (own == own[0]).all():
            ok &= lab[alive] != own[0]
        if not ok.any():
            continue
        alive, have = alive[ok], have[ok]
        end = lens[lo] if hi - lo == 1 else min(lens[lo], common[lo + 1 : hi].min())
        run = items[lo][depth:end]
        for at in range(0, max(len(run), 1), STEP):
            part = run[at : at + STEP]
            have = have + counts(part)[alive]
            depth += len(part)
            reach = have + np.minimum(longest - depth, lens[alive] - have)
            ok = reach >= min_overlap(n[alive] + least, percent) - np.maximum(rest[alive], behind)
            if not ok.all():
                alive, have = alive[ok], have[ok]
                if not len(alive):
                    break
        if not len(alive):
            continue
        while lo < hi and lens[lo] == end:  # sets that end here
            size = n[alive]
            hit = (alive > lo) & (lab[alive] != lab[lo]) & (100 * np.minimum(size, n[lo]) >= percent * np.maximum(size, n[lo]))
            hit &= have >= min_overlap(size + n[lo], percent) - np.maximum(rest[alive], rest[lo])
            if seen is not None:
                seen[alive[hit]] = True
                seen[lo] |= hit.any()
                lo += 1
                continue
            for q in alive[hit].tolist():
                if lab[q] != lab[lo]:
                    found.append((order[lo], order[q]))
                    if not every:
                        lab[lab == lab[q]] = lab[lo]
            lo += 1
        if lo < hi:
            cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
            stack += [(a, b, end, alive, have) for a, b in zip(cuts, cuts[1:])]
    if given is not None:
        given[order] = seen
    return found


def in_pairs(sets: list[np.ndarray], sizes: np.ndarray, rest: np.ndarray, labels: np.ndarray, percent: int) -> list[int]:
    """Which sets are in one of the pairs that tree_join gives with every; the pairs aren't listed."""
    seen = np.zeros(len(sets), bool)
    tree_join(sets, sizes, rest, labels, percent, seen=seen)
    return np.flatnonzero(seen).tolist()


class GlobalOrder:
    """Hash -> signed key in the global order: rare shingles by hash, then the frequent ones by count."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray):
        by_hash = np.argsort(hot)
        by_count = np.lexsort((hot, counts))
        rank = np.empty(len(hot), np.int64)
        rank[by_count] = np.arange(len(hot))
        self.hot, self.rank, self.parts = hot[by_hash], rank[by_hash], -(-counts[by_count] // SPLIT)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        keys = (hashes >> np.uint64(1)).view(np.int64) - np.int64(1 << 62) - np.int64(1 << 61)  # below all ranks
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, hashes), len(self.hot) - 1)
            is_hot = self.hot[at] == hashes
            keys[is_hot] = np.int64(3 << 61) + self.rank[at[is_hot]]
        return np.sort(keys)

    def parts_of(self, keys: np.ndarray) -> np.ndarray:
        """Into how many parts each key is dealt."""
        out = np.ones(len(keys), np.int64)
        hot = keys >= np.int64(3 << 61)
        out[hot] = self.parts[keys[hot] - np.int64(3 << 61)]
        return out


def pack(words: bytes) -> bytes:
    return zlib.compress(words, 1)


def sets_of(blobs: list[bytes], k: int) -> list[np.ndarray]:
    rows = [zlib.decompress(b) for b in blobs]
    out = []
    for _, part in chunks(rows):
        out += shingle_sets(part, k)
    return out


def class_rows(docs: DataFrame, k: int) -> DataFrame:
    """Per document: node (class; null without words), and at its first sight in a task the class's text and set size."""

    def make():
        seen: set[int] = set()

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            ids = batch.column("doc_id").to_pylist()
            rows = [b" ".join(x.translate(ASCII_LOWER).split()) for x in byte_texts(batch)]
            nodes = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) if x else None for x in rows]
            if len(seen) > SEEN:
                seen.clear()
            new = []
            for i, n in enumerate(nodes):
                if n is not None and n not in seen:
                    seen.add(n)
                    new.append(i)
            size, blob = [None] * len(rows), [None] * len(rows)
            for first, part in chunks([rows[i] for i in new]):
                for j, s in enumerate(shingle_sets(part, k)):
                    at = new[first + j]
                    size[at], blob[at] = len(s), pack(part[j])
            yield {"doc_id": ids, "node": nodes, "n": size, "blob": blob}

        return step

    return map_batches(only(docs, "doc_id", "text"), make, "doc_id bigint, node bigint, n int, blob binary")


def local_counts(classes: DataFrame, k: int) -> DataFrame:
    """Shingles that a task has seen in two classes or more (within FLUSH shingles), with their counts."""

    def make():
        held: list[np.ndarray] = []
        size = [0]

        def flush():
            if held:
                h, n = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                size[0] = 0
                h, n = h[n > 1], n[n > 1]
                for at in range(0, len(h), 1 << 16):
                    yield {"token": h[at : at + (1 << 16)].view(np.int64), "n": n[at : at + (1 << 16)]}

        def step(batch):
            if batch is None:
                yield from flush()
                return
            for s in sets_of(batch.column("blob").to_pylist(), k):
                held.append(s)
                size[0] += len(s)
            if size[0] > FLUSH:
                yield from flush()

        return step

    return map_batches(classes.select("blob"), make, "token bigint, n bigint")


def global_order(classes: DataFrame, k: int) -> GlobalOrder:
    """The frequent shingles: those over the lowest count at which at most HOT_ROWS are left."""
    counts = materialise(local_counts(classes, k).groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_MIN), "hot")
    steps = counts.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    least, rows = None, 0
    for s in steps:  # a few hundred at most
        rows += s["rows"]
        if rows > HOT_ROWS:
            break
        least = s["least"]
    hot = counts.where(F.col("n") >= least if least is not None else F.lit(False)).toPandas()
    drop_table(counts)
    return GlobalOrder(hot["token"].to_numpy("int64").view(np.uint64), hot["n"].to_numpy("int64"))


def rest_of(n, percent: int):
    """What follows the prefix of a set of n, at most."""
    return -(-percent * n // 100) - 1


def prefixes(classes: DataFrame, order, k: int, percent: int) -> DataFrame:
    """token, part (0, or from 1 on of a frequent token's parts), node, n."""

    def make():
        own = order.value

        def step(batch):
            if batch is None or not batch.num_rows:
                return
            tokens, node, size = [], [], []
            for n, s in zip(batch.column("node").to_pylist(), sets_of(batch.column("blob").to_pylist(), k)):
                p = len(s) - rest_of(len(s), percent)
                tokens.append(own.keys(s)[:p])
                node.append(np.full(p, n, np.int64))
                size.append(np.full(p, len(s), np.int32))
            tokens, node = np.concatenate(tokens), np.concatenate(node)
            parts = own.parts_of(tokens)
            yield {"token": tokens, "part": np.where(parts > 1, 1 + (node >> 8) % parts, 0).astype(np.int32), "node": node, "n": np.concatenate(size)}

        return step

    return map_batches(classes.select("node", "blob"), make, "token bigint, part int, node bigint, n int")


def met(rows: DataFrame, percent: int, left: bool) -> DataFrame:
    """rows (token, part, node, n), each once, whose token a class of near size has as well; all of a token in parts.

    left: of two classes that alone share a token, only where the shingles that each has left can suffice (a column).
    """
    w = Window.partitionBy("token", "part").orderBy("n", "node")
    rows = rows.withColumn("again", F.lag("node").over(w)).where(~F.coalesce(F.col("again") == F.col("node"), F.lit(False))).drop("again")
    at = lambda c, i: F.lag(c, i).over(w)
    names = ["n", *(["left"] if left else [])]
    rows = rows.select("*", *[at(c, i).alias(f"{c}{i + 2}") for c in names for i in (-1, 1)], *[at("n", i).alias(f"n{i + 2}") for i in (-2, 2)])
    n = F.col("n").cast("bigint")
    before, after = n * percent <= F.col("n3") * 100, F.col("n1") * percent <= n * 100
    near = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    if left:
        other, two = F.coalesce("n3", "n1").cast("bigint"), F.col("n4").isNull() & F.col("n0").isNull() & (F.col("n3").isNull() | F.col("n1").isNull())
        need = F.ceil(F.lit(percent) * (n + other) / F.lit(100 + percent)) - F.greatest(F.ceil(F.lit(percent) * n / 100), F.ceil(F.lit(percent) * other / 100)) + 1
        near = near & (~two | (F.least("left", F.coalesce("left3", "left1")) >= need))
    return rows.where((F.col("part") > 0) | near).select("token", "part", "node", "n")


def distinct_groups(rows: DataFrame) -> DataFrame:
    """token, size of one group of those with the same members (near copies share many shingles): the first."""
    member = [F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    of = rows.groupBy("token").agg(F.count("*").alias("size"), *member)
    return of.where("size > 1").groupBy("size", "s1", "s2").agg(F.min("token").alias("token")).select("token", "size")


def in_groups(rows: DataFrame, keys: list[str], link, schema: str = "a bigint, b bigint") -> DataFrame:
    """Deals rows by keys and gives what link(columns as lists) says of each group (pairs of nodes)."""
    names = rows.columns
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "node")
    n_keys = len(keys)
    out = [x.split()[0] for x in schema.split(", ")]

    def make():
        state: dict = {"key": None, "rows": []}

        def flush():
            if len(state["rows"]) > 1:
                found = link(dict(zip(names, zip(*state["rows"]))))
                if found:
                    yield dict(zip(out, zip(*found)))
            state["rows"] = []

        def step(batch):
            if batch is None:
                yield from flush()
                return
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if state["key"] != row[:n_keys]:
                    yield from flush()
                    state["key"] = row[:n_keys]
                state["rows"].append(row)

        return step

    return map_batches(dealt.select(*keys, *[c for c in names if c not in keys]).toDF(*keys, *[c for c in names if c not in keys]), make, schema)


def named(nodes, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(min(nodes[i], nodes[j]), max(nodes[i], nodes[j])) for i, j in pairs]


def stars(nodes, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links of the same components, each from a component's smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in named(nodes, pairs):
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [(a, x) for x in [*parent] if (a := root(x)) != x]


def prefix_links(groups: DataFrame, keys: list[str], lists: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """Stars of each group's components by pairs that may link, of rows (keys, token, node, label).

    apart: instead the rows (keys, node, label) of each group that are in such a pair of different labels.
    """
    rows = groups.join(lists, "node").withColumn("s", F.filter("s", lambda x: x >= F.col("token")))
    rows = rows.select(*keys, "node", "label", "n", "s")

    def link(group):
        n, nodes = np.array(group["n"], np.int64), group["node"]
        labels = np.unique(group["label"], return_inverse=True)[1]
        sets = [np.array(s, np.int64) for s in group["s"]]
        if not apart:
            return stars(nodes, tree_join(sets, n, rest_of(n, percent), labels, percent))
        key = tuple(group[k][0] for k in keys)
        return [(*key, nodes[i], group["label"][i]) for i in in_pairs(sets, n, rest_of(n, percent), labels, percent)]

    if not apart:
        return in_groups(rows, keys, link)
    kinds = dict(groups.dtypes)
    return in_groups(rows, keys, link, ", ".join(f"{c} {kinds[c]}" for c in (*keys, "node", "label")))


def hub_links(big: DataFrame, percent: int) -> DataFrame:
    """Links that join all classes of a large group whose sizes are near, or near those between: each with one of its band."""
    rows = big.withColumn("band", band_of(percent))
    hubs = rows.groupBy("token", "band").agg(F.min("node").alias("a"))
    after = hubs.select("token", (F.col("band") - 1).alias("band"), F.col("a").alias("b"))
    return rows.join(hubs, ["token", "band"]).select("a", F.col("node").alias("b")).unionByName(hubs.join(after, ["token", "band"]).select("a", "b")).where("a != b")


def band_of(percent: int):
    """Sizes that reach percent of each other are in one band or in neighbours."""
    return F.floor(F.log("n") / math.log(100 / percent)).cast("int")


def whole_links(placed: DataFrame, rows: DataFrame, order, k: int, percent: int, keys: tuple[str, ...] = ("grp", "block")) -> DataFrame:
    """Stars of the components of each group: placed has rows (keys, node); the classes' texts come from rows.

    With a label in placed, only classes of different labels are compared.
    """
    known = ["label"] if "label" in placed.columns else []
    words = bloom_filter(placed, "node")
    shipped = rows.sparkSession.sparkContext.broadcast(words)

    def make():
        def step(batch):
            if batch is not None and batch.num_rows:
                picked = batch.filter(in_bloom(shipped.value, batch.column("node").to_numpy()))
                yield {c: picked.column(c) for c in ("node", "blob")}

        return step

    texts = map_batches(rows.where("blob is not null").select("node", "blob"), make, "node bigint, blob binary")
    texts = texts.groupBy("node").agg(F.min("blob").alias("blob"))

    def link(group):
        sets = [order.value.keys(s) for s in sets_of(list(group["blob"]), k)]
        n = np.array([len(s) for s in sets])
        labels = np.unique(group["label"], return_inverse=True)[1] if known else np.arange(len(n))
        return stars(group["node"], tree_join(sets, n, np.zeros(len(n), np.int64), labels, percent))

    return in_groups(placed.join(texts, "node").select(*keys, "node", *known, "blob"), [*keys], link)


def deal(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """grp, block, node from rows (grp, node, n): a group of over BLOCK classes, or of long ones, in blocks by hash."""
    blocks = F.greatest(F.ceil(F.col("classes") / BLOCK), F.ceil(F.col("shingles") / (1 << 21))).cast("int")
    return rows.join(sizes.withColumn("blocks", blocks), "grp").select("grp", F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int").alias("block"), "node", "blocks")


def sizes_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("grp").agg(F.count("*").alias("classes"), F.sum("n").alias("shingles"))


def still_apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members (grp, node, ...) of the groups that have several components, with their label."""
    rows = members.join(comps.select("node", F.col("comp").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("grp")
    return rows.join(mixed, "grp", "left_semi")


def apart_rows(groups: DataFrame, members: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """token, i, j, node, label: classes of groups (token, node, n) in squares of blocks, those of all but the largest label against all.

    Only classes that may link with one of another label in their square: a row a class and square, however many pairs.
    """
    rows = groups.select("token", "node", "n").join(members.select("node", "label"), "node")
    of = rows.groupBy("token", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    of = of.groupBy("token").agg(F.max_by(F.struct("label", "w"), F.struct("c", "label")).alias("first"), F.max("c").alias("most"), F.sum("c").alias("total"), F.sum("w").alias("weight")).where("most < total")
    blocks = lambda c, w: F.greatest(F.ceil(c / GROUP), F.ceil(w / (1 << 21))).cast("int")  # noqa: E731 - long sets fill a block earlier
    x, y = blocks(F.col("most"), F.col("first.w")), blocks(F.col("total") - F.col("most"), F.col("weight") - F.col("first.w"))
    rows = rows.join(of.select("token", F.col("first.label").alias("major"), x.alias("x"), y.alias("y")), "token")
    of_hash = lambda c: F.pmod(F.xxhash64("node", F.lit(9)), c).cast("int")
    is_major = F.col("label") == F.col("major")
    rows = rows.withColumn("own", F.when(is_major, of_hash(F.col("x"))).otherwise(F.col("x") + of_hash(F.col("y"))))
    last = F.col("x") + F.col("y") - 1
    other = F.when(is_major, F.sequence(F.col("x"), last)).otherwise(F.array_remove(F.sequence(F.lit(0), last), F.col("own")))
    rows = rows.withColumn("other", F.explode(other)).select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label")
    return prefix_links(rows, ["token", "i", "j"], lists, percent, apart=True)


def link_classes(rows: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, comp) of the classes that link with another; None if none does. rows: node, blob."""
    spark, tables = rows.sparkSession, []

    def keep(df: DataFrame, name: str) -> DataFrame:
        tables.append(materialise(df, name))
        return tables[-1]

    classes = rows.where("blob is not null")
    order = spark.sparkContext.broadcast(global_order(classes, k))
    shared = keep(met(prefixes(classes, order, k, percent), percent, False), "shared")
    lists = keep(shared.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("token", "part"))).alias("s")), "lists")
    again = lists.select("node", "n", F.size("s").alias("size"), F.posexplode("s")).select("col.token", "col.part", "node", "n", (F.col("size") - F.col("pos")).alias("left"))
    groups = keep(met(again, percent, True), "groups")
    once = keep(distinct_groups(groups), "once")
    groups = groups.select("token", "node", "n").join(once, "token")
    lists = lists.select("node", "n", F.col("s.token").alias("s"))
    edges = prefix_links(groups.where(F.col("size") <= GROUP).select("token", "node", F.col("node").alias("label")), ["token"], lists, percent)
    edges = keep(edges.unionByName(hub_links(groups.where(F.col("size") > GROUP), percent)).distinct(), "edges")
    out = None
    if edges.take(1):
        of = components(edges)
        tables.append(of)
        members = of.select(F.col("comp").alias("grp"), "node").join(lists.select("node", "n"), "node")
        members = keep(deal(members, sizes_of(members)).join(lists.select("node", "n"), "node"), "members")
        links = keep(whole_links(members.select("grp", "block", "node"), classes, order, k, percent), "links")
        if links.take(1):
            out = components(links)
        large = members.where("blocks > 1")
        if large.take(1):
            out = join_blocks(large, links, out, groups, lists, classes, order, k, percent, keep)
    for t in tables:
        drop_table(t)
    return out


def join_blocks(large: DataFrame, links: DataFrame, comps: DataFrame | None, groups: DataFrame, lists: DataFrame, classes: DataFrame, order, k: int, percent: int, keep) -> DataFrame | None:
    """comps with the links between the blocks of large candidate groups."""
    none = large.select("node", F.col("node").alias("comp")).limit(0)
    apart = keep(still_apart(large, comps if comps is not None else none), "apart")
    first = apart.groupBy("grp", "block", "label").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(3))).alias("x")).select("grp", "x.node", "x.n")
    first = keep(first, "delegates")
    links = links.unionByName(keep(whole_links(deal(first, sizes_of(first)), classes, order, k, percent), "links"))
    if links.take(1):
        comps = components(links)
    apart = keep(still_apart(apart.drop("label"), comps if comps is not None else none), "apart")
    squares = keep(apart_rows(groups, apart, lists, percent), "squares")
    if squares.take(1):
        links = links.unionByName(keep(whole_links(squares, classes, order, k, percent, ("token", "i", "j")), "links"))
        if links.take(1):
            comps = components(links)
    return comps


def jaccard_join(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = materialise(class_rows(docs, k), "classrows")
    ids = materialise(rows.select("doc_id", "node", "n"), "ids")
    comps = link_classes(rows.select("node", "blob"), k, percent)
    drop_table(rows)
    own = ids.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("min_id"), F.max("n").alias("n"))
    own = own.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")) if comps is not None else own.withColumn("comp", F.col("node"))
    least = own.groupBy("comp").agg(F.min("min_id").alias("component_id"))
    of = materialise(own.join(least, "comp").select("node", F.col("n").cast("bigint").alias("n_shingles"), "component_id"), "of")
    if comps is not None:
        drop_table(comps)
    out = ids.select("doc_id", "node").join(of, "node", "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("bigint")).alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One document of each component stays (the smallest doc_id; one of its rows, if it is repeated)."""
    row_id, times, folded = fresh(docs, "row_id"), fresh(docs, "times"), fresh(docs, "folded")
    kept = jaccard_join(docs, k, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = materialise(kept.groupBy(F.col("doc_id").alias(row_id)).agg(F.count("*").alias(times)), "kept")
    same = docs["doc_id"].eqNullSafe(kept[row_id])
    if not kept.where(F.col(times) > 1).take(1):
        return docs.join(kept, same, "left_semi")
    words = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase), BLANK, " "))
    again = docs.join(kept.where(F.col(times) > 1), same, "left_semi").withColumn(folded, F.sha2(words, 256)).dropDuplicates(["doc_id", folded]).drop(folded)
    return docs.join(kept.where(F.col(times) == 1), same, "left_semi").unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


SQL = None  # components of a similarity join are too slow in SQL on whole tables; tests hold the query against brute force
