"""The dependency graph: resolution, layers, references, orphans, reachability and strongly connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.paths import short_path


#: Spark deletes the shuffle files of an execution at its end, so those of steps that are done don't pile up.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, **options) -> DataFrame:
    """Cuts lineage by a written table in the session's shared folder (spark.checkpoint.dir); options are the writer's.

    A local folder is made only in local mode, where none is set.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="sylva-")
        spark.conf.set("spark.checkpoint.dir", folder)
    to = f"{folder.rstrip('/')}/sylva/graph-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(to)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(to)


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by cut (or read from one), once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sylva/graph-" in folder:
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


def first_with(files: DataFrame, targets: DataFrame, end: bool = False) -> DataFrame:
    """dst, path: the first file (by path) that begins with each target, at any character, or that ends with it.

    Paths are exploded into the beginnings (ends) that are as long as some target, and joined by equality; the lengths are
    no more than the longest path has characters.
    """
    lengths = targets.agg(F.collect_set(F.length("dst")).alias("lengths"))  # one row
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    part = lambda n: F.substring("path", F.length("path") - n + 1 if end else F.lit(1), n)
    parts = files.select("path").distinct().crossJoin(F.broadcast(lengths)).select("path", F.explode(F.transform(fits, part)).alias("dst"))
    return parts.join(targets.select("dst").distinct(), "dst", "left_semi").groupBy("dst").agg(F.min("path").alias("path"))


def incoming_refs(edges: DataFrame, files: DataFrame) -> DataFrame:
    """path, refs: an edge refers to the first file (by path) that begins with its target, at any character."""
    targets = edges.groupBy("dst").agg(F.count("*").alias("n"))
    return targets.join(first_with(files, targets), "dst").groupBy("path").agg(F.sum("n").alias("refs"))


#: What an import may leave out, in the order of trial: for layers, and for cycles.
LAYER_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".go", ".py")
INDEX_FILES = ("index.ts", "index.tsx", "index.js", "index.jsx")
CYCLE_EXTENSIONS = (".go", ".py", ".ts", ".js", ".java", ".cs", ".cpp", ".hpp")


def layer_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with `target`: dst itself, with an extension, its index file, or the first file that begins with it."""
    found = resolve(edges, files, (*LAYER_EXTENSIONS, *[f"/{x}" for x in INDEX_FILES]))
    return found.join(first_with(files, edges).withColumnRenamed("path", "_first"), "dst", "left").withColumn("target", F.coalesce("target", "_first")).drop("_first")


def cycle_targets(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with `target`: dst itself; a relative dst from src's folder, as it is or with an extension; the first file that ends with dst."""
    from sylva.functions.paths import resolve_import

    # a relative target is tried as it stands and from its source, others only as they stand
    asked = edges.select("src", "dst").distinct().withColumn("_path", resolve_import(F.col("src"), F.col("dst")))
    ends = F.when(F.startswith(F.col("dst"), F.lit(".")), F.array(*[F.concat("_path", F.lit(x)) for x in ("", *CYCLE_EXTENSIONS)])).otherwise(F.expr("cast(array() as array<string>)"))
    tries = asked.select("src", "dst", F.posexplode(F.concat(F.array("dst"), ends)).alias("ord", "path"))
    found = tries.join(files.select("path").distinct(), "path").groupBy("src", "dst").agg(F.min_by("path", "ord").alias("target"))
    last = first_with(files, edges, end=True).withColumnRenamed("path", "_last")
    return edges.join(found, ["src", "dst"], "left").join(last, "dst", "left").withColumn("target", F.coalesce("target", "_last")).drop("_last")


def resolve(edges: DataFrame, files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """Edges with `target`: the first of dst + suffix ('' first) that is a file, else null; equality joins only."""
    tries = edges.select("src", "dst").distinct().select("src", "dst", F.posexplode(F.array(*[F.concat("dst", F.lit(s)) for s in ("", *suffixes)])).alias("ord", "path"))
    found = tries.join(files.select("path").distinct(), "path").groupBy("src", "dst").agg(F.min_by("path", "ord").alias("target"))
    return edges.join(found, ["src", "dst"], "left")


def orphans(files: DataFrame, edges: DataFrame, entry_points) -> DataFrame:
    """Files that no edge refers to (see incoming_refs) and that aren't entry points."""
    return files.where(~entry_points).join(incoming_refs(edges, files).select("path"), "path", "left_anti")


def layer_violations(edges: DataFrame, layers: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """Edges between layers (path, layer) that the allow list (from, to; * for any) lacks; unknown layers are free."""
    of = lambda c: layers.select(F.col("path").alias(c), F.col("layer").alias(f"{c}_layer"))
    rows = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_layer != dst_layer")
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("src_layer") == a) & (F.lit(b == "*") | (F.col("dst_layer") == b)))
    return rows.where(~ok)


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, distance (at most depth) from any root: a frontier of new nodes at each step."""
    e = edges.select("src", "dst").distinct()
    seen = roots.select("node").distinct().withColumn("distance", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        new = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut(new.withColumn("distance", F.lit(d)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen


#: Steps that labels go in the first round that needs them; each such round doubles them.
LABEL_STEPS = 8
#: Edges of a kernel that one task takes, at most: what is left when ends, pointers and chains are contracted, 32 MB as numbers.
KERNEL_EDGES = 1 << 21
#: So few edges need not lose their chains first, nor anything else (see components).
FEW_EDGES = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """The rows of strongly_connected; at most FEW_EDGES edges go to the kernel as they are, without rounds."""
    own = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    few = own.count() <= min(FEW_EDGES, KERNEL_EDGES)
    out = kernel(own, every=True).withColumnRenamed("to", "component") if few else strongly_connected(own)
    drop(own)
    return out


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), by contraction in tables; edges: src, dst of any type that has an order.

    Edges that end where nothing begins or begin where nothing ends go. If that was less than a tenth of them, the next
    round lets every node point to one of its targets and doubles the pointers (see pointed). Nodes from which only
    one way leads on, to an end, are on no cycle and go, however long the way; the cycles of pointers are contracted to
    their smallest node. The next round takes the edges backwards, so that beginnings go as ends do. If a round leaves
    more than half of the edges or no more than KERNEL_EDGES, chains become one edge each (see chained). A kernel of at most
    KERNEL_EDGES is then one task's (see kernel); of a larger one, forward and backward labels of random rank are spread over LABEL_STEPS steps
    (twice as many each time): nodes that get the same label from both sides lie on a cycle with it and are contracted
    (see labelled).

    A chain or a ring of n nodes takes one round of log(n) doublings, a tree one, chains of components a few; an acyclic
    graph loses its ends and all trees towards them, in no more rounds than it is deep. All tables but the result
    are deleted as soon as nothing reads them.
    """
    own = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    nodes = cut(own.select(F.col("src").alias("node")).union(own.select("dst")).distinct())
    e = own.where("src != dst")
    left, steps, moved, turn = e.count(), LABEL_STEPS, [], 0
    if not left:
        drop(own)
    while left:
        rest, before = peeled(e), left
        drop(e)
        e, left = rest, rest.count()
        if left < 0.9 * before:
            continue
        turn += 1
        dead, map_ = pointed(e, turn)
        moved.append(map_)
        rest = contracted(e.join(dead.select(F.col("node").alias("dst")), "dst", "left_anti"), map_)
        rest, before = cut(rest.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), left
        drop(e, dead)
        e, left = rest, rest.count()
        if 2 * left <= before and left > KERNEL_EDGES:
            continue
        if left > min(FEW_EDGES, KERNEL_EDGES):
            links, rest = chained(e)
            moved.append(links)
            drop(e)
            e, left = rest, rest.count()
        if left:
            small = left <= KERNEL_EDGES
            map_ = kernel(e) if small else labelled(e, turn, steps)
            moved.append(map_)
            rest, steps = cut(contracted(e, map_)), 2 * steps
            drop(e)
            e, left = rest, 0 if small else rest.count()  # what a kernel leaves is on no cycle
    drop(e)
    last = None  # where nodes lead in the end, from the last contraction back
    for map_ in reversed(moved):
        if not map_.take(1):
            drop(map_)
            continue
        if "start" in map_.columns:
            new = cut(led(map_, last))
            drop(map_, *([] if last is None else [last]))
            last = new
            continue
        if last is None:
            last = map_
            continue
        further = last.select(F.col("node").alias("to"), F.col("to").alias("end"))
        new = cut(map_.join(further, "to", "left").select("node", F.coalesce("end", "to").alias("to")).unionByName(last))
        drop(map_, last)
        last = new
    if last is None:
        return nodes.select("node", F.col("node").alias("component"))
    # nodes of chains may be smaller than what their component was contracted to
    own = nodes.join(last, "node", "left").select("node", F.coalesce("to", "node").alias("to"))
    out = cut(own.join(own.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component"))
    drop(nodes, last)
    return out


def chained(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of chains with where these start and end (node, start, to), and the edges with one for each chain.

    A node of a chain has one edge in and one out. It is on a cycle just if the chain's ends are in one component (then in
    that), as all ways through it take the whole chain. Pointers are doubled to a chain's last node, until no more nodes
    get there; those left are rings of their own and stay as they are.
    """
    outs = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("next"), F.count("*").alias("n")).where("n = 1")
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).where("n = 1").select("node")
    inner = cut(outs.join(ins, "node").select("node", "next"))
    follows = inner.select(F.col("node").alias("next"), F.lit(True).alias("on"))
    way = cut(inner.join(follows, "next", "left").select("node", F.when(F.col("on"), F.col("next")).otherwise(F.col("node")).alias("tail"), F.col("on").isNull().alias("done")))
    left = way.where("not done").count()
    while left:
        further = way.select(F.col("node").alias("tail"), F.col("tail").alias("tail2"), F.col("done").alias("done2"))
        new = cut(way.join(further, "tail").select("node", F.col("tail2").alias("tail"), (F.col("done") | F.col("done2")).alias("done")))
        before, left = left, new.where("not done").count()
        drop(way)
        way = new
        if left == before:
            break
    tails = way.where("done").select("node", "tail")
    # the edge that leads to a chain's first node begins where the chain starts
    first = e.join(tails.select(F.col("node").alias("dst"), "tail"), "dst").join(tails.select(F.col("node").alias("src")), "src", "left_anti")
    ends = first.select("tail", F.col("src").alias("start")).join(inner.select(F.col("node").alias("tail"), F.col("next").alias("to")), "tail")
    links = cut(tails.join(ends, "tail").select("node", "start", "to"))
    known = links.select("node")
    whole = e.join(known.select(F.col("node").alias("src")), "src", "left_anti").join(known.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
    rest = cut(whole.unionByName(links.select(F.col("start").alias("src"), F.col("to").alias("dst"))).where("src != dst").distinct())
    drop(inner, way)
    return links, rest


def led(links: DataFrame, last: DataFrame | None) -> DataFrame:
    """last (node, to) with the nodes of the chains (see chained) whose ends lead to the same node."""
    if last is None:
        return links.where("start = to").select("node", "to")
    of = lambda c: last.select(F.col("node").alias(c), F.col("to").alias(f"{c}_in"))
    both = links.join(of("start"), "start", "left").join(of("to"), "to", "left").select("node", F.coalesce("start_in", "start").alias("start"), F.coalesce("to_in", "to").alias("to"))
    return both.where("start = to").select("node", "to").unionByName(last)


def kernel(e: DataFrame, every: bool = False) -> DataFrame:
    """node, to: the nodes of components of several nodes with one of these; the edges are few enough for one task.

    With every, all nodes with the smallest of their component.
    """
    kind = e.schema["src"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        names = pc.unique(pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks]))
        if every:
            names = names.take(pc.sort_indices(names))
        src, dst = (pc.index_in(t.column(c), names).to_numpy() for c in ("src", "dst"))
        label = _components(src, dst, len(names))
        moved = np.arange(len(names))
        if every:
            least = np.full(len(names), len(names))
            np.minimum.at(least, label, moved)
            label = least[label]
        else:
            moved = np.flatnonzero(label != moved)
        for at in range(0, len(moved), 1 << 16):
            some = moved[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), names.take(pa.array(label[some]))], names=["node", "to"])

    return cut(e.select("src", "dst").repartition(1).mapInArrow(run, f"node {kind}, to {kind}"))


def _components(src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes one node of its strongly connected component, the same for all of it (Tarjan's stack, without recursion)."""
    targets = dst[np.argsort(src, kind="stable")].tolist()
    at = np.append(0, np.cumsum(np.bincount(src, minlength=n))).tolist()
    ends, seen, low, label = at[1:], [0] * n, [0] * n, [-1] * n
    open_: list[int] = []
    time = 0
    for root in range(n):
        if seen[root]:
            continue
        time += 1
        seen[root] = low[root] = time
        open_.append(root)
        way = [root]
        while way:
            v = way[-1]
            if at[v] < ends[v]:
                w = targets[at[v]]
                at[v] += 1
                if not seen[w]:
                    time += 1
                    seen[w] = low[w] = time
                    open_.append(w)
                    way.append(w)
                elif label[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            if low[v] == seen[v]:
                while True:
                    w = open_.pop()
                    label[w] = v
                    if w == v:
                        break
    return np.array(label, np.int64)


def peeled(e: DataFrame) -> DataFrame:
    """Edges whose source has an edge that ends there and whose target has one that begins there."""
    goes_on, comes_in = e.select(F.col("src").alias("dst")), e.select(F.col("dst").alias("src"))
    return cut(e.join(goes_on.distinct(), "dst", "left_semi").join(comes_in.distinct(), "src", "left_semi").select("src", "dst"))


def pointed(e: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that can be on no cycle (node), and nodes on a cycle of pointers with its smallest node (node, to).

    Each node points to one target (by a hash that changes with the turn), a node without targets to itself. Doubled
    pointers carry whether each node on the way had one target only, the smallest node on the way and whether it ended.
    The targets of ways that don't end are the nodes on cycles, as soon as doubling no longer makes them fewer; as
    labels differ, no smallest node changes only once each way is longer than its cycle. At most KERNEL_EDGES pointers are
    doubled by one task (see walked).
    """
    rank = F.xxhash64("dst", F.lit(turn))
    first = e.groupBy(F.col("src").alias("node")).agg(F.min_by("dst", rank).alias("to"), (F.count("*") == 1).alias("single"))
    first = first.select("node", "to", "single", F.col("node").alias("least"), F.lit(False).alias("end"))
    ends = e.select(F.col("dst").alias("node")).distinct().join(first.select("node"), "node", "left_anti")
    way = cut(first.unionByName(ends.select("node", F.col("node").alias("to"), F.lit(True).alias("single"), F.col("node").alias("least"), F.lit(True).alias("end"))))
    if way.count() <= KERNEL_EDGES:
        found = walked(way)
        dead, map_ = cut(found.where("to is null").select("node")), cut(found.where("to is not null"))
        drop(way, found)
        return dead, map_
    open_ = None
    while True:
        twice = followed(followed(way.withColumn("was", F.col("least"))))
        new = cut(twice.withColumn("changed", F.col("was") != F.col("least")).drop("was"))
        going = new.where("not end")
        targets, changed = going.agg(F.count_distinct("to"), F.count_if("changed")).first()
        drop(way)
        way = new.drop("changed")
        if not changed and targets == open_:
            break
        open_ = targets
    on_cycle = way.where("not end").select(F.col("to").alias("node")).distinct()
    map_ = cut(way.join(on_cycle, "node", "left_semi").where("node != least").select("node", F.col("least").alias("to")))
    dead = cut(way.where("end and single").select("node"))
    drop(new)
    return dead, map_


def walked(way: DataFrame) -> DataFrame:
    """node, to: what pointed finds for pointers that are few enough for one task; `to` is null for nodes on no cycle."""
    kind = way.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.concat_tables(parts)
        t = t.take(pc.sort_indices(t.column("node")))
        names = t.column("node").combine_chunks()
        to = pc.index_in(t.column("to"), names).to_numpy()
        single, end, least = t.column("single").to_numpy(), t.column("end").to_numpy(), np.arange(len(names))
        for _ in range(len(names).bit_length()):
            least, single, end, to = np.minimum(least, least[to]), single & single[to], end[to], to[to]
        dead = np.flatnonzero(end & single)
        ring = np.unique(to[~end])
        ring = ring[least[ring] != ring]
        rows = [(names.take(pa.array(dead)), pa.nulls(len(dead), names.type)), (names.take(pa.array(ring)), names.take(pa.array(least[ring])))]
        for node, target in rows:
            for at in range(0, len(node), 1 << 16):
                yield pa.RecordBatch.from_arrays([node.slice(at, 1 << 16), target.slice(at, 1 << 16)], names=["node", "to"])

    return cut(way.repartition(1).mapInArrow(run, f"node {kind}, to {kind}"))


def followed(way: DataFrame) -> DataFrame:
    """Ways followed by the ways from where they lead: twice as long."""
    on = way.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("single").alias("single2"), F.col("least").alias("least2"), F.col("end").alias("end2"))
    both = way.join(on, "to")
    return both.select("node", F.col("to2").alias("to"), (F.col("single") & F.col("single2")).alias("single"), F.least("least", "least2").alias("least"), F.col("end2").alias("end"), "was")


def labelled(e: DataFrame, turn: int, steps: int) -> DataFrame:
    """node, to: nodes whose label of highest rank is the same along and against the edges (within steps), and their smallest."""
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    start = cut(nodes.select("node", F.struct(F.xxhash64("node", F.lit(-turn)).alias("rank"), F.col("node").alias("by")).alias("label")))
    sides = []
    for a, b in (("src", "dst"), ("dst", "src")):
        label = start
        for _ in range(steps):
            near = e.join(label.withColumnRenamed("node", a), a).groupBy(F.col(b).alias("node")).agg(F.max("label").alias("near"))
            new = cut(label.join(near, "node", "left").select("node", F.greatest("label", "near").alias("label"), (F.col("near") > F.col("label")).alias("changed")))
            if label is not start:
                drop(label)
            label = new.drop("changed")
            if not new.where("changed").take(1):
                break
        sides.append(label)
    there, back = sides
    same = there.join(back.withColumnRenamed("label", "back"), "node").where("label = back").select("node", "label.by")
    to = same.groupBy("by").agg(F.min("node").alias("to"))
    map_ = cut(same.join(to, "by").where("node != to").select("node", "to"))
    drop(start, *sides)
    return map_


def contracted(e: DataFrame, map_: DataFrame) -> DataFrame:
    """Edges between what nodes are mapped to, without those inside."""
    for c in ("src", "dst"):
        e = e.join(map_.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")), c, "left").withColumn(c, F.coalesce(f"{c}_to", c)).drop(f"{c}_to")
    return e.where("src != dst").select("src", "dst").distinct()


def witness_cycles(edges: DataFrame) -> DataFrame:
    """component, length, cycle: a shortest cycle through the smallest node of each component that has one, beginning there.

    Breadth first in all components at once; of the ways to a node the first in the order of their nodes counts, so the
    cycle is the first one of its length. Two cycles are equal if they have the same nodes in the same order from their
    smallest node on, so `cycle` tells them apart. Components of at most KERNEL_EDGES edges are walked as groups (see
    walked_cycles), larger ones in as many rounds of joins as the longest of these cycles has nodes.
    """
    own = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    parts = components(own)
    of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"k{c}"))
    inner = cut(own.join(of("src"), "src").join(of("dst"), "dst").where("ksrc = kdst").select("src", "dst", F.col("ksrc").alias("component")))
    drop(own, parts)
    small = F.col("n") <= KERNEL_EDGES
    sizes = inner.groupBy("component").agg(F.count("*").alias("n"))
    done = cut(walked_cycles(inner.join(sizes.where(small), "component", "left_semi")))
    large = cut(inner.join(sizes.where(~small), "component", "left_semi"))
    drop(inner)
    inner = large
    if not inner.take(1):
        drop(inner)
        return done
    roots = inner.select("component").distinct()
    front = cut(roots.select("component", F.col("component").alias("node"), F.array("component").alias("way")))
    seen = [front]
    found = [done]
    while True:
        step = cut(front.withColumnRenamed("node", "src").join(inner, ["component", "src"]).groupBy("component", F.col("dst").alias("node")).agg(F.min("way").alias("way")))
        closed = step.where("node = component").select("component", F.size("way").cast("bigint").alias("length"), F.col("way").alias("cycle"))
        found.append(closed)
        before = seen[0].select("component", "node")
        for x in seen[1:]:
            before = before.union(x.select("component", "node"))
        new = step.join(closed.select("component"), "component", "left_anti").join(before, ["component", "node"], "left_anti")
        front = cut(new.select("component", "node", F.concat("way", F.array("node")).alias("way")))
        if not front.take(1):
            break
        if len(seen) == 8:  # so that plans stay short
            merged = cut(before)
            drop(*seen)
            seen = [merged]
        seen.append(front)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    out = cut(out)
    drop(inner, front, *seen, *found)
    return out


def walked_cycles(inner: DataFrame) -> DataFrame:
    """The cycles of witness_cycles, each component (of src, dst, component) walked within its group.

    A front is kept in the order of its ways and targets in their own, so the first way to a node is the first of its length.
    """
    kind = inner.schema["component"].dataType.simpleString()

    def walk(t: pa.Table) -> pa.Table:
        root = t.column("component").slice(0, 1).combine_chunks()
        names = pc.unique(pa.chunked_array([*t.column("src").chunks, *t.column("dst").chunks]))
        names = names.take(pc.sort_indices(names))
        src, dst = (pc.index_in(t.column(c), names).to_numpy() for c in ("src", "dst"))
        targets = dst[np.lexsort((dst, src))].tolist()
        at = np.append(0, np.cumsum(np.bincount(src, minlength=len(names)))).tolist()
        first = pc.index_in(root, names)[0].as_py()
        came, front, last = [-1] * len(names), [first], -1
        while front and last < 0:
            new = []
            for v in front:
                for w in targets[at[v] : at[v + 1]]:
                    if w == first:
                        last = v
                        break
                    if came[w] < 0:
                        came[w] = v
                        new.append(w)
                if last >= 0:
                    break
            front = new
        way = [last]
        while way[-1] != first:
            way.append(came[way[-1]])
        cycle = names.take(pa.array(way[::-1]))
        return pa.table([root, pa.array([len(way)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(way)], pa.int32()), cycle)], names=["component", "length", "cycle"])

    return inner.groupBy("component").applyInArrow(walk, f"component {kind}, length bigint, cycle array<{kind}>")


def cycle_edges(edges: DataFrame) -> DataFrame:
    """Edges on a cycle: both ends in one component (a self-loop is one)."""
    edges = cut(edges)
    scc = components(edges)
    of = lambda c: scc.select(F.col("node").alias(c), F.col("component").alias(f"k{c}"))
    return edges.join(of("src"), "src").join(of("dst"), "dst").where("ksrc = kdst").select("src", "dst")


#: The colours of layers.
LAYER_STYLES = {
    "domain": "fill:#C8E6C9,stroke:#2E7D32,stroke-width:2px",
    "application": "fill:#BBDEFB,stroke:#1565C0,stroke-width:2px",
    "infrastructure": "fill:#FFCDD2,stroke:#C62828,stroke-width:2px",
    "presentation": "fill:#FFE0B2,stroke:#F57C00,stroke-width:2px",
    "api": "fill:#E1BEE7,stroke:#6A1B9A,stroke-width:2px",
    "cmd": "fill:#E0E0E0,stroke:#424242,stroke-width:2px",
    "internal": "fill:#B2DFDB,stroke:#00695C,stroke-width:2px",
}


def shown_nodes(files: DataFrame, edges: DataFrame, layer: str | None = None, depth: int = 0) -> DataFrame:
    """The files (path, layer, refs) that an export shows: those of a layer, and with a depth those within so many steps.

    Steps begin at the files that nothing refers to, or at the first one if there are none; they may lead over others.
    """
    rows = files.where(F.col("layer") == layer) if layer else files
    if depth <= 0:
        return rows
    roots = rows.where("refs = 0").select(F.col("path").alias("node"))
    first = rows.agg(F.min("path").alias("node")).where("node is not null")
    none = roots.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    roots = cut(roots.unionByName(first.join(none.select(F.lit(1).alias("_one")), F.lit(1) == F.col("_one")).select("node")))
    return rows.join(reachable(edges, roots, depth).select(F.col("node").alias("path")), "path", "left_semi")


def dot_lines(nodes: DataFrame, edges: DataFrame, layers: tuple[str, ...] | None = None, title: str = "dependencies") -> DataFrame:
    """A DOT graph as lines in order (`line`); edges to unknown nodes are left out.

    nodes: path, and layer if layers are to be shown (then `layers` are the names of the legend); edges: src, dst, and cycle
    and violation (boolean) if they are to be marked, a cycle before a violation. Without nodes a comment says so.
    """
    spark = nodes.sparkSession
    coloured = layers is not None
    style = {name: dict(x.split(":") for x in css.split(",")) for name, css in LAYER_STYLES.items()}
    pick = lambda part, unknown: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for n, css in style.items() for x in (n, css[part])]), F.col("layer")), F.lit(unknown))
    border = F.when(F.col("layer").isNull(), "gray").otherwise(pick("stroke", "black")) if coloured else F.lit("black")
    fill = F.when(F.col("layer").isNull(), "#F5F5F5").otherwise(pick("fill", "#FFFFFF")) if coloured else F.lit("#FFFFFF")
    look = F.format_string(' [label="%s", color="%s", fillcolor="%s", style="rounded,filled"];', F.col("label"), border, fill)
    one = nodes.select("path", (F.col("layer") if coloured else F.lit(None).cast("string")).alias("layer")).dropDuplicates(["path"])
    one = one.withColumn("id", F.concat(F.lit("n"), F.substring(F.md5("path"), 1, 12))).withColumn("label", short_path(F.col("path")))
    body = one.select(F.lit(2).alias("part"), F.col("path").alias("ord"), F.lit("").alias("ord2"), F.concat(F.lit("  "), "id", look).alias("line"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in edges.columns else F.lit(False)
    draw = F.when(flag("cycle"), 'color="orange", style="bold", penwidth=2.0').when(flag("violation"), 'color="red", style="bold", penwidth=2.0').otherwise('color="black", style="solid", penwidth=1.0')
    a, b = one.select(F.col("path").alias("src"), F.col("id").alias("a")), one.select(F.col("path").alias("dst"), F.col("id").alias("b"))
    arrows = edges.join(a, "src").join(b, "dst").select(F.lit(3).alias("part"), F.col("src").alias("ord"), F.col("dst").alias("ord2"), F.concat(F.lit("  "), "a", F.lit(" -> "), "b", F.lit(" ["), draw, F.lit("];")).alias("line")).distinct()
    head = [f'digraph "{title}" {{', "  rankdir=LR;", "  node [shape=box, style=rounded];", "  edge [arrowhead=vee];"]
    fixed = [(0, f"{i}", "", x) for i, x in enumerate(head)] + [(9, "", "", "}")]
    legend = []
    if coloured:
        legend = ["  // Legend", "  subgraph cluster_legend {", '    label="Layers";', "    style=filled;", '    fillcolor="#F0F0F0";']
        for i, n in enumerate(layers):
            css = style.get(n, {"stroke": "black", "fill": "#FFFFFF"})
            legend.append(f'    legend{i} [label="{n}", color="{css["stroke"]}", fillcolor="{css["fill"]}", style="rounded,filled"];')
        legend.append("  }")
    schema = "part int, ord string, ord2 string, line string"
    some = one.limit(1).select(F.lit(1).alias("_one"))
    shown = spark.createDataFrame([(5, f"{i:04}", "", x) for i, x in enumerate(legend)], schema).join(some, F.lit(1) == F.col("_one")).drop("_one")
    empty = spark.createDataFrame([(1, "", "", "  // No nodes to display")], schema).join(some, F.lit(1) == F.col("_one"), "left_anti")
    out = spark.createDataFrame(fixed, schema).unionByName(body).unionByName(arrows).unionByName(shown).unionByName(empty)
    return out.orderBy("part", "ord", "ord2").select("line")


def mermaid_lines(nodes: DataFrame, edges: DataFrame, direction: str = "LR") -> DataFrame:
    """A Mermaid graph as lines in order; edges to unknown nodes are left out, nodes without edges of their own stand alone.

    nodes: path, and layer if the layers' colours are wanted; edges: src, dst, and cycle and violation (boolean) if they
    are to be marked, a cycle before a violation.
    """
    spark = nodes.sparkSession
    ids = nodes.select("path").distinct().select("path", F.concat(F.lit("n"), F.substring(F.md5("path"), 1, 12)).alias("id"))
    label = F.replace(short_path(F.col("path")), F.lit('"'), F.lit("#quot;"))
    named = ids.select("path", F.concat("id", F.lit('["'), label, F.lit('"]')).alias("box"))
    known = edges.join(named.toDF("src", "from"), "src").join(named.toDF("dst", "to"), "dst")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in edges.columns else F.lit(False)
    arrow = F.when(flag("cycle"), " -.->|cycle| ").when(flag("violation"), " -.->|violation| ").otherwise(" --> ")
    lines = known.select(F.lit(1).alias("part"), F.col("src").alias("ord"), F.col("dst").alias("ord2"), F.concat(F.lit("  "), "from", arrow, "to").alias("line")).distinct()
    alone = named.join(known.select(F.col("src").alias("path")), "path", "left_anti").select(F.lit(1).alias("part"), F.col("path").alias("ord"), F.lit("").alias("ord2"), F.concat(F.lit("  "), "box").alias("line"))
    head = spark.createDataFrame([(0, "", "", f"graph {direction}")], "part int, ord string, ord2 string, line string")
    out = head.unionByName(lines).unionByName(alone)
    if "layer" in nodes.columns:
        style = F.create_map(*[F.lit(x) for kv in LAYER_STYLES.items() for x in kv])
        coloured = nodes.select("path", "layer").distinct().join(ids, "path").withColumn("css", F.try_element_at(style, F.col("layer"))).where("css is not null")
        out = out.unionByName(coloured.select(F.lit(2).alias("part"), F.col("path").alias("ord"), F.lit("").alias("ord2"), F.concat_ws(" ", F.lit("  style"), "id", "css").alias("line")))
    return out.orderBy("part", "ord", "ord2").select("line")


def mermaid_document(lines: DataFrame, kind: str = "markdown", title: str = "Dependencies", script: str = "https://cdn.jsdelivr.net/npm/mermaid@10/dist/mermaid.min.js") -> str:
    """The lines in a markdown fence or an HTML page (a page is read as a whole: its lines come to the driver).

    script: where the page finds Mermaid.
    """
    from html import escape

    body = "\n".join(r["line"] for r in lines.collect())
    if kind == "markdown":
        return f"```mermaid\n{body}\n```\n"
    if kind != "html":
        raise ValueError(f"unknown kind {kind!r}; known: markdown, html")
    return f'<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>{escape(title)}</title></head>\n<body><h1>{escape(title)}</h1><pre class="mermaid">\n{escape(body)}\n</pre>\n<script src="{escape(script)}"></script><script>mermaid.initialize({{ startOnLoad: true }});</script></body></html>\n'
