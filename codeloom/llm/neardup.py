"""Near duplicates by chosen-path set similarity join.

A document's set holds its distinct five-word shingles (ASCII lower case); two
documents are linked where 100 * intersection >= percent * union (80 unless given;
`op4_neardup` takes 85).  Texts with one set
form a class, joined through one row each.  Every class has 128 minwise tokens.
Each independent tree branches the classes by selected minwise tokens, two at a
time: the path so far selects the next ones.  A node of at most `LEAF` classes is
a leaf; larger ones branch on.  Nodes still larger at `DEPTH` (sets that agree
almost everywhere) are cut into blocks of leaf size.  At first these only share two
leaders, which connects most of a group of near copies; then every block meets every
other, in leaves of their own, save two blocks of one component.  So each tree compares
all pairs in each of its last nodes; the work on a node of n classes that are no links
grows with n * n / `LEAF` rows, and nothing is left out.

A leaf is compared exhaustively, first by the share of equal minwise tokens, then,
for pairs at most 4.2 standard deviations short there and not connected yet, on
the full sets.
It yields a spanning star for each group found, so output grows with the classes,
never with the pairs.  The first trees connect most; the others only look at pairs
across the components so far, which spares moving most sets again.

A pair of similarity s meets in a tree with probability s**2 at the first level,
s**4 at the second and last.  There are as many trees as it takes to miss a pair at
the threshold with probability `MISS` at the last level: fourteen at 0.85 (3.2e-5; 2e-8
at the first level), twenty at 0.8 (2.6e-5; 1e-9).  The check on minwise tokens misses
one in 1e-5 more; components survive more, as a document of a large group has many links.
Components come from repeated contraction, all in DataFrames.

Texts without words: an empty set, linked with nothing.  Null ids: no component,
kept.  Rows that repeat an id and a text get equal results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import chunks, mix, written

SHINGLE_WORDS, PERCENT = 5, 80
COORDS, DEPTH, WIDTH, LEAF = 128, 2, 2, 256
FIRST_TREES, MISS = 4, 3.3e-5


with np.errstate(over="ignore"):
    MULTIPLY = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
    ADD = mix(np.arange(1001, COORDS + 1001, dtype=np.uint64))


def shingle_sets(texts: list[str], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles."""
    import xxhash

    docs = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    flat = [w for d in docs for w in d]
    if not flat:
        return [np.zeros(0, np.uint64)] * len(texts)
    code, known = pd.factorize(np.array(flat, object))
    h = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))[code]
    roll = np.zeros(len(h), np.uint64)
    m = max(0, len(h) - size + 1)
    with np.errstate(over="ignore"):
        for k in range(size):
            roll[:m] = roll[:m] * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
        roll = mix(roll)
    out, at = [], 0
    for d in docs:
        n = len(d)
        if n >= size:
            out.append(np.unique(roll[at : at + n - size + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(d), seed=n)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def minwise(values: np.ndarray) -> np.ndarray:
    """The 128 minima (32 bits) of a set under fixed hash functions."""
    best = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, len(values), 1024):
            np.minimum(best, (values[a : a + 1024, None] * MULTIPLY + ADD).min(0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, cls (16 bytes that name the set; null if empty), n_shingles, sig (128 x 4 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for cut, texts in chunks(batches):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    cut.column("doc_id"),
                    pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([minwise(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "cls", "n_shingles", "sig"],
            )

    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, cls binary, n_shingles bigint, sig binary")


def paths(sigs: np.ndarray, tree: int, depth: int = DEPTH) -> np.ndarray:
    """Path names (rows x depth) in a tree: the name so far selects the minwise tokens that branch next."""
    at = np.arange(len(sigs))
    path = np.full(len(sigs), mix(np.array([7919 + tree], np.uint64))[0], np.uint64)
    out = np.empty((len(sigs), depth), np.uint64)
    with np.errstate(over="ignore"):
        for d in range(depth):
            for _ in range(WIDTH):
                pick = (path % np.uint64(COORDS)).astype(np.int64)
                path = mix(path ^ mix(sigs[at, pick].astype(np.uint64) + pick.astype(np.uint64) * np.uint64(1 << 40) + np.uint64(d + 1)))
            out[:, d] = path
    return out


def trees_for(percent: int) -> int:
    """Trees that all part a pair of this similarity, at the last level, with probability `MISS` at most."""
    return max(FIRST_TREES, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** (WIDTH * DEPTH))))) if percent < 100 else FIRST_TREES


def tree_rows(reps: DataFrame, trees: tuple[int, ...], depth: int = DEPTH) -> DataFrame:
    """cls, p (path names by depth): one row for each class and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
            for t in trees:
                p = paths(sigs, t, depth).astype(np.int64)
                offsets = pa.array(np.arange(0, p.size + 1, depth), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=["cls", "p"])

    return reps.select("cls", "sig").mapInArrow(run, "cls binary, p array<bigint>")


def leaves(rows: DataFrame, leaf: int = LEAF, depth: int = DEPTH) -> tuple[DataFrame, DataFrame | None, int]:
    """(leaf, cls) of the classes whose node got small; (node, cls) of those in nodes that never did, None if there are none; the leaf size.

    The rows of nodes that branch on are written at each level, so each level reads only those.
    """
    out = None
    for d in range(depth):
        name = F.col("p")[d]
        big = written(rows.groupBy(name.alias("node")).count().where(F.col("count") > leaf), "nodes")
        ended = rows.join(big, name == F.col("node"), "left_anti").select(name.alias("leaf"), "cls")
        out = ended if out is None else out.unionByName(ended)
        if big.isEmpty():
            return out, None, leaf
        rows = written(rows.join(big, name == F.col("node")).select("cls", "p", "node"), "branching")
        if d < depth - 1:
            rows = rows.select("cls", "p")
    return out, rows.select("node", "cls"), leaf


def star_blocks(rest: DataFrame, leaf: int) -> DataFrame:
    """leaf, cls: blocks of nodes (node, cls) with two leaders of the node in each; finds most components of near copies cheaply."""
    sizes = rest.groupBy("node").agg(F.ceil(F.count("*") / F.lit(leaf)).cast("int").alias("blocks"))
    rest = rest.join(written(sizes, "nodes"), "node")
    order = F.struct(F.xxhash64("node", "cls"), F.col("cls"))
    leaders = rest.groupBy("node", "blocks").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    leaders = leaders.select("node", F.array("a.cls", "b.cls").alias("both"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    leaders = leaders.select("node", "block", F.explode("both").alias("cls"))
    dealt = rest.select("node", F.pmod(F.xxhash64("cls", "node"), F.col("blocks")).cast("int").alias("block"), "cls")
    return dealt.unionByName(leaders).select(F.xxhash64("node", "block").alias("leaf"), "cls")


def block_pairs(rest: DataFrame, reps: DataFrame, leaf: int) -> DataFrame:
    """leaf, cls: a leaf for every two blocks of a node (node, cls), and for a block with itself, where they hold different components.

    A component with more than a leaf's classes in a node has blocks of its own, whose pairs are known.
    """
    rows = written(rest.join(reps.select("cls", F.coalesce("root", "cls").alias("grp")), "cls"), "big-nodes")
    per = written(rows.groupBy("node", "grp").count(), "node-groups")
    large = F.col("count") > leaf
    blocks = F.ceil(F.col("count") / F.lit(leaf)).cast("int")
    own = per.where(large).select("node", F.col("grp").alias("part"), blocks.alias("blocks"))
    mixed = per.where(~large).groupBy("node").agg(F.sum("count").alias("count")).select("node", F.lit(None).cast("binary").alias("part"), blocks.alias("blocks"))
    parts = written(own.unionByName(mixed), "node-parts")
    name = F.xxhash64("node", F.coalesce("part", F.lit(b"")), "i")
    named = parts.select("node", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select("node", "part", name.alias("block"))
    a, b = named.toDF("node", "part_a", "block_a"), named.toDF("node", "part_b", "block_b")
    pairs = a.join(b, "node").where("block_a <= block_b and (part_a is null or part_b is null or part_a <> part_b)")
    pairs = pairs.select(F.xxhash64("block_a", "block_b").alias("leaf"), F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    number = F.pmod(F.xxhash64("cls", "node"), F.col("blocks")).cast("int").alias("i")
    in_own = rows.join(parts.where("part is not null").withColumnRenamed("part", "grp"), ["node", "grp"], "left").select("node", "cls", "grp", "blocks")
    dealt = in_own.where("blocks is not null").select("node", "cls", F.col("grp").alias("part"), number)
    rest_of = in_own.where("blocks is null").drop("blocks").join(parts.where("part is null").drop("part"), "node").select("node", "cls", F.lit(None).cast("binary").alias("part"), number)
    dealt = written(dealt.unionByName(rest_of).select(name.alias("block"), "cls"), "dealt")
    return dealt.join(written(pairs, "block-pairs"), "block").select("leaf", "cls")


def floor_of(percent: int) -> float:
    """Equal minwise tokens that a pair of this similarity hardly ever falls short of."""
    p = percent / 100
    return COORDS * p - 4.2 * (COORDS * p * (1 - p)) ** 0.5


def alike(sigs: np.ndarray, sizes: np.ndarray, group: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, equal minwise tokens) of the pairs of different groups that may be links, the most alike first."""
    order = np.argsort(sizes, kind="stable")
    n, s = sizes[order], sigs[order]
    ends = np.searchsorted(n, n * 100 // percent, side="right")  # a larger set cannot be linked
    out = []
    for i in range(len(n) - 1):
        if ends[i] > i + 1:
            same = (s[i + 1 : ends[i]] == s[i]).sum(1)
            hit = np.flatnonzero((same >= floor_of(percent)) & (group[order[i + 1 : ends[i]]] != group[order[i]]))
            out += [(int(order[i]), int(order[i + 1 + h]), int(same[h])) for h in hit]
    out.sort(key=lambda x: -x[2])
    return tuple(np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def members(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray]]:
    """(row, its list of structs) of a batch with a list column `m`."""
    m = batch.column("m")
    offsets = m.offsets.to_pylist()
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        yield i, m.values.slice(a, b - a)


def groups_of(rows: pa.StructArray) -> np.ndarray:
    """A number for the component of each class; classes without one are groups of their own."""
    names = {}
    return np.array([names.setdefault(r if r is not None else (i,), len(names)) for i, r in enumerate(rows.field("root").to_pylist())], np.int64)


def candidates(leaf_rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """leaf, cls, n_shingles, root, sig (2 bytes a token) of classes with a partner of another component in the leaf, by minwise tokens."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, COORDS)
                short = (raw ^ (raw >> np.uint32(16))).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("n_shingles"), b.column("root"), pa.array([r.tobytes() for r in short], pa.binary())], names=["cls", "n_shingles", "root", "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, cls, n, root, sig = [], [], [], [], []
            names = batch.column("leaf").to_pylist()
            for i, rows in members(batch):
                raw = rows.field("sig").to_pylist()
                sizes = rows.field("n_shingles").to_numpy()
                a, b, _ = alike(np.frombuffer(b"".join(raw), np.uint16).reshape(-1, COORDS), sizes, groups_of(rows), percent)
                if len(a):
                    ids, roots = rows.field("cls").to_pylist(), rows.field("root").to_pylist()
                    for j in np.union1d(a, b).tolist():
                        leaf.append(names[i])
                        cls.append(ids[j])
                        n.append(int(sizes[j]))
                        root.append(roots[j])
                        sig.append(raw[j])
            if leaf:
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(root, pa.binary()), pa.array(sig, pa.binary())], names=["leaf", "cls", "n_shingles", "root", "sig"])

    several = leaf_rows.groupBy("leaf").agg(F.collect_set("cls").alias("c")).where(F.size("c") > 1)
    folded = reps.select("cls", "n_shingles", "root", "sig").mapInArrow(fold, "cls binary, n_shingles bigint, root binary, sig binary")
    rows = several.select("leaf", F.explode("c").alias("cls")).join(folded, "cls")
    grouped = rows.groupBy("leaf").agg(F.collect_list(F.struct("cls", "n_shingles", "root", "sig")).alias("m"))
    return grouped.mapInArrow(run, "leaf bigint, cls binary, n_shingles bigint, root binary, sig binary")


def sets_of(docs: DataFrame, wanted_ids: DataFrame) -> DataFrame:
    """cls, shingles (8 bytes each) of the documents with these ids, one row for each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for _, texts in chunks(batches):
            raw = [s.tobytes() for s in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())], names=["cls", "shingles"])

    src = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted_ids, "doc_id", "left_semi")
    return src.mapInArrow(run, "cls binary, shingles binary").dropDuplicates(["cls"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def links(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b (classes): the links of each leaf, as a spanning star of each group, confirmed on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for _, rows in members(batch):
                ids = rows.field("cls").to_pylist()
                sizes = rows.field("n_shingles").to_numpy()
                sets_here = [np.frombuffer(r, np.uint64) for r in rows.field("shingles").to_pylist()]
                group = groups_of(rows)
                _, first = np.unique(group, return_index=True)
                root = first[group].tolist()  # those connected before start in one set

                def find(i: int, root=root) -> int:
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j, _ in zip(*alike(np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint16).reshape(-1, COORDS), sizes, group, percent)):
                    a, b = find(int(i)), find(int(j))
                    if a != b and linked(sets_here[i], sets_here[j], percent):
                        root[max(a, b)] = min(a, b)
                for i in range(len(ids)):
                    if (r := find(i)) != i:
                        left.append(ids[r])
                        right.append(ids[i])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    grouped = found.join(sets, "cls").groupBy("leaf").agg(F.collect_list(F.struct("cls", "n_shingles", "root", "sig", "shingles")).alias("m"))
    return grouped.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge: contracts each node into its least neighbour until no edge is left."""
    edges = written(edges.where("a <> b").distinct(), "links")
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up")), "parents")
        steps.append(parent)
        p, q = parent.toDF("a", "up_a"), parent.toDF("b", "up_b")
        moved = edges.join(p, "a").join(q, "b").where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b"))
        edges = written(moved.distinct(), "links")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0].toDF("node", "root")
    for parent in steps[1:]:
        out = out.join(parent.toDF("root", "up"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return out


def linked_by(docs: DataFrame, reps: DataFrame, leaf_rows: DataFrame, percent: int) -> DataFrame:
    """a, b: links between classes (cls, rep, n_shingles, sig, root) of different components that meet in these leaves."""
    found = written(candidates(leaf_rows, reps, percent), "candidates")
    wanted = reps.select("cls", "rep").join(found.select("cls").distinct(), "cls", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    return written(links(found, sets_of(docs, wanted), percent), "found-links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row."""
    rows = written(sketches(docs), "sketches")
    known = rows.where("cls is not null and doc_id is not null")
    reps = written(known.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "classes")
    small, big, leaf = leaves(tree_rows(reps, tuple(range(FIRST_TREES))))
    at_first = small if big is None else small.unionByName(star_blocks(big, leaf))
    first = linked_by(docs, reps.withColumn("root", F.lit(None).cast("binary")), at_first, percent)
    so_far = written(components(first).toDF("cls", "root"), "roots")
    reps_so_far = written(reps.join(so_far, "cls", "left"), "classes")
    then, big_too, leaf = leaves(tree_rows(reps, tuple(range(FIRST_TREES, trees_for(percent)))))
    for nodes in (big, big_too):
        if nodes is not None:
            then = then.unionByName(block_pairs(nodes, reps_so_far, leaf))
    more = linked_by(docs, reps_so_far, then, percent)
    root = components(first.unionByName(more))
    named = root.join(reps.select(F.col("cls").alias("node"), "rep"), "node")
    named = written(named, "roots")
    lowest = named.groupBy("root").agg(F.min("rep").alias("low"))
    joined = named.join(lowest, "root").select(F.col("node").alias("cls"), "low")
    per_class = reps.select("cls", "rep").join(joined, "cls", "left").select("cls", F.coalesce("low", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "cls").join(per_class, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs less those of documents whose component has a lower id, with their columns as they were."""
    dropped = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)
