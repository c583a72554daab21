"""Join of similar documents: Jaccard similarity of word shingles at or above a threshold, by chosen paths.

Each distinct text becomes a set of ``COORDINATES`` tokens (a coordinate and the smallest hash of its shingles there).
A *run* splits the texts recursively: at every node some coordinates are drawn, 1 / threshold on average, and texts that
share the token of a drawn coordinate stay together in a child. Small nodes are compared by brute force on short
sketches; runs repeat until a pair at the threshold is found with the target probability. A few runs go first, and what
they link is contracted: where nearly all of a node lies in one group already, only the rest is compared, with everything.
What the runs link forms candidate groups, and inside each group all pairs are compared exactly on their whole shingle sets.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideframe.llm.common import HASH_BASE, HASH_MIX, block_pairs, components, hashed_words, map_batches, mixed, roots, rows_with, slices, tidy
from tideframe.session import stored

SHINGLE = 5
COORDINATES = 64
#: Nodes up to this size are compared by brute force; larger ones are split while ``MAX_DEPTH`` allows.
SMALL = 256
MAX_DEPTH = 4
#: Runs before the contraction. More than one path must meet a large group: a path ends by chance where no coordinate is drawn.
FIRST_RUNS = 4
#: Rows of a block where a node or group too large for one task is dealt in pairs of blocks.
NODE_BLOCK, GROUP_BLOCK = 4096, 512
#: Rows compared at a time in one task.
CHUNK = 20_000


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their texts, fingerprints of the texts' word sequences).

    Words are lower-case runs of anything but blanks and ASCII marks; a shingle is five in a row, a text of one to four
    words is one shingle of all. A text without words has no shingle and fingerprint 0.
    """
    words, owner, bounds, _, _ = hashed_words(texts)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.uint64)
    m = len(words)
    chain = words.copy()
    lengths = np.diff(bounds)[owner]
    place = np.arange(m) - bounds[owner]
    for k in range(1, SHINGLE):
        has = place + k < lengths
        nxt = np.where(has, np.concatenate([words[k:], np.zeros(min(k, m), np.uint64)])[:m], np.uint64(0))
        chain = mixed(chain * np.uint64(HASH_BASE) + nxt + np.uint64(k))
    full = (place + SHINGLE <= lengths) | ((lengths < SHINGLE) & (place == 0))
    filled = np.diff(bounds) > 0
    prints = np.zeros(len(texts), np.uint64)
    weighted = words * mixed(place.astype(np.uint64) * HASH_MIX + np.uint64(7)) + mixed(words + place.astype(np.uint64))
    prints[filled] = mixed(np.add.reduceat(weighted, bounds[:-1][filled]) + lengths[bounds[:-1][filled]].astype(np.uint64)) | np.uint64(1)
    return chain[full], owner[full], prints


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, node, sketch, brief`` per row: node is the fingerprint of the words (null without words), the sketch 64
    minima, the brief their low bytes (chance agreement of one is 1 in 256, enough to compare candidates).

    Texts with the same words are one node from here on. Two different texts share a 64-bit fingerprint with
    probability of about n^2 / 2^64.
    """

    def run(c: dict[str, list]) -> dict:
        texts = [t or "" for t in c["text"]]
        factors = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(HASH_BASE)) | np.uint64(1)
        nodes: list[int | None] = [None] * len(texts)
        made: list[bytes | None] = [None] * len(texts)
        brief: list[bytes | None] = [None] * len(texts)
        for lo, hi in slices([len(t) for t in texts]):
            hashes, owner, prints = shingle_hashes(texts[lo:hi])
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            if not len(first):
                continue
            minima = np.stack([(np.minimum.reduceat(hashes * f, first) >> np.uint64(32)).astype("<u4") for f in factors], axis=1)
            for k, i in enumerate(owner[first].tolist()):
                nodes[lo + i], made[lo + i], brief[lo + i] = int(prints[i].astype(np.int64)), minima[k].tobytes(), minima[k].astype(np.uint8).tobytes()
        return {"doc_id": c["doc_id"], "node": nodes, "sketch": made, "brief": brief}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, node long, sketch binary, brief binary")


def _children(nodes: DataFrame, runs: range | None, threshold: float) -> DataFrame:
    """``path, node``: the children of each row's path, or those of the roots of ``runs``."""
    below = np.uint64(int(2**64 / (COORDINATES * threshold)))

    def run(c: dict[str, list]) -> dict:
        minima = np.frombuffer(b"".join(c["sketch"]), "<u4").reshape(-1, COORDINATES).astype(np.uint64)
        coordinate = np.arange(1, COORDINATES + 1, dtype=np.uint64)[None, :]
        rows, paths = [], []
        for r in runs if runs is not None else (None,):
            path = np.full(len(minima), r + 1, np.uint64) * HASH_MIX if r is not None else np.asarray(c["path"], np.int64).view(np.uint64)
            drawn = mixed(mixed(path[:, None] + coordinate * np.uint64(HASH_BASE))) < below
            row, at = np.nonzero(drawn)
            rows.append(row)
            paths.append(mixed(mixed(path[row] + coordinate[0, at]) ^ (minima[row, at] * HASH_MIX)).view(np.int64))
        row = np.concatenate(rows)
        return {"path": np.concatenate(paths), "node": np.asarray(c["node"], np.int64)[row]}

    return map_batches(nodes, run, "path long, node long")


def _windows(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int = CHUNK) -> Iterator[pa.Table]:
    """Cut a sorted stream into tables of about ``limit`` rows that hold whole groups of ``keys``."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        columns = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        return t, np.flatnonzero(new)

    for batch in batches:
        for lo in range(0, batch.num_rows, limit):
            held.append(batch.slice(lo, limit))
            if sum(b.num_rows for b in held) >= limit:
                t, first = whole()
                if first[-1]:
                    yield t.slice(0, int(first[-1]))
                held = t.slice(int(first[-1])).to_batches()
    if sum(b.num_rows for b in held):
        yield whole()[0]


def _candidate_links(buckets: DataFrame, least: int, keys: list[str]) -> DataFrame:
    """Links ``(u, v)`` that span what is alike inside each bucket: a bucket of n rows gives fewer than n links.

    Rows with ``known`` = 1 are linked with each other already; they are compared with those of 0 only, which stand first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _windows(batches, keys):
            node = t.column("node").to_numpy()
            small = np.frombuffer(b"".join(t.column("brief").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            ids = [t.column(k).to_numpy() for k in keys]
            new = np.ones(len(node), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in ids], axis=0)
            end = np.repeat(np.append(np.flatnonzero(new)[1:], len(node)), np.diff(np.append(np.flatnonzero(new), len(node))))
            left, right = [], []
            at, step = np.flatnonzero(t.column("known").to_numpy() == 0), 1
            while len(at := at[at + step < end[at]]):
                like = np.count_nonzero(small[at] == small[at + step], axis=1) >= least
                left.append(at[like])
                right.append(at[like] + step)
                step += 1
            if not left:
                continue
            a, b = np.concatenate(left), np.concatenate(right)
            root = roots(len(node), a, b)
            mine = np.flatnonzero(root != np.arange(len(node)))
            pairs = np.unique(np.sort(np.stack([node[mine], node[root[mine]]], axis=1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return buckets.repartition(*keys).sortWithinPartitions(*keys, "known", "node").mapInArrow(tidy(run), "u long, v long")


def runs_needed(threshold: float, target: float, least: int) -> int:
    """Runs after which a pair at the threshold is a candidate with probability ``target``, even in nodes of the largest depth.

    A pair with k equal minima meets in a node of depth 1 with probability 1 - (1 - 1 / (64 threshold)) ^ k and in one of
    depth d + 1 with that of a k whose chances shrink by that of depth d. The runs share the sketch, so k is drawn once; a pair
    with fewer than ``least`` equal minima is never a candidate.
    """
    rate = 1.0 / (COORDINATES * threshold)
    chance = {}
    for k in range(least, COORDINATES + 1):
        meets = 1.0
        for _ in range(MAX_DEPTH):
            meets = 1.0 - (1.0 - rate * meets) ** k
        chance[k] = meets
    weight = {k: math.comb(COORDINATES, k) * threshold**k * (1.0 - threshold) ** (COORDINATES - k) for k in chance}
    if sum(weight.values()) < target:
        raise ValueError("the sketch is too short for this target")
    runs = 1
    while sum(w * (1.0 - (1.0 - chance[k]) ** runs) for k, w in weight.items()) < target:
        runs += 1
    return runs


def _met(nodes: DataFrame, groups: DataFrame | None, runs: range, threshold: float, least: int) -> DataFrame:
    """Links ``(u, v)`` that these runs find among ``nodes`` (``node, sketch, brief``) beyond the known ``groups`` (``node, component``).

    A path whose nodes all lie in one group ends. A path with at most ``SMALL`` nodes outside its largest group is compared at
    once: the others with each other and with the group's nodes, which are dealt in blocks.
    """
    sketched = nodes.select("node", "sketch")
    level, ready = stored(_children(sketched, runs, threshold), "paths"), None
    for depth in range(1, MAX_DEPTH + 1):
        # Counted with map-side sums; most paths hold one node and end here, before any sketch moves.
        if groups is None:
            sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("held")).filter("n > 1")
            sized = level.join(sizes, "path").withColumn("known", F.lit(0))
        else:
            grouped = level.join(groups, "node", "left")
            own = F.col("component").isNotNull()
            sizes = grouped.groupBy("path", "component").agg(F.count(F.lit(1)).alias("held")).groupBy("path").agg(
                F.sum("held").alias("n"), F.coalesce(F.max(F.when(own, F.col("held"))), F.lit(0)).alias("held"), F.max_by("component", F.when(own, F.struct("held", "component"))).alias("main"))
            sized = grouped.join(sizes.filter("n > 1 and held < n"), "path").withColumn("known", F.coalesce(F.col("component") == F.col("main"), F.lit(False)).cast("int"))
        placed = stored(sized.select("path", "node", "known", "held", (F.col("n") - F.col("held")).alias("outside")), "shared-paths")
        small = placed.filter(F.col("outside") <= SMALL)
        blocks = F.greatest(F.lit(1), F.ceil(F.col("held") / NODE_BLOCK)).cast("int")
        copies = F.when(F.col("known") == 1, F.array(F.pmod(F.xxhash64("node"), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        whole = small.select("path", "node", "known", F.explode(copies).alias("bi"), F.lit(-1).alias("bj"))
        ready = whole if ready is None else ready.union(whole)
        large = placed.filter(F.col("outside") > SMALL).select("path", "node")
        if large.isEmpty():
            break
        if depth == MAX_DEPTH:
            ready = ready.union(block_pairs(large, "path", F.xxhash64("node"), NODE_BLOCK).select("path", "node", F.lit(0).alias("known"), "bi", "bj"))
            break
        level = stored(_children(large.join(sketched, "node"), None, threshold), "paths")
    return stored(_candidate_links(ready.join(nodes.select("node", "brief"), "node"), least, ["path", "bi", "bj"]), "met")


def _lowered(links: DataFrame) -> DataFrame:
    """``node, component`` after two steps towards the smallest neighbour; nodes without a smaller one are absent."""
    low = stored(links.groupBy(F.greatest("u", "v").alias("node")).agg(F.min(F.least("u", "v")).alias("low")), "lowered")
    lower = low.select(F.col("node").alias("low"), F.col("low").alias("lower"))
    return low.join(lower, "low", "left").select("node", F.coalesce("lower", "low").alias("component"))


def _contracted(links: DataFrame) -> DataFrame:
    """``node, component`` of linked nodes: two steps towards the smallest neighbour, and two more between the groups these made.

    Nodes of one component are connected; those of two may be as well, which only costs comparisons. One round leaves a large
    group in parts, one for each smallest node of its stars, and each path of the group would be split for the smaller parts.
    """
    first = stored(_lowered(links), "contracted")
    named = links
    for end in ("u", "v"):
        named = named.join(first.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    across = named.filter("u_in <> v_in").select(F.col("u_in").alias("u"), F.col("v_in").alias("v")).distinct()
    wider = _lowered(across).select(F.col("node").alias("own"), F.col("component").alias("wider"))
    own = named.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("u_in").alias("own")), F.struct(F.col("v").alias("node"), F.col("v_in").alias("own")))).alias("x")).select("x.*").distinct()
    return stored(own.join(wider, "own", "left").select("node", F.coalesce("wider", "own").alias("component")), "contracted-groups")


def candidate_groups(nodes: DataFrame, threshold: float, target: float) -> DataFrame:
    """``node, component`` of all nodes that some run links with another; ``nodes`` holds distinct ``node, sketch, brief``.

    Nodes of equal sketches meet in every run, so one of them stands for all.
    """
    least = math.floor(COORDINATES * threshold - 3.5 * math.sqrt(COORDINATES * threshold * (1 - threshold)))
    runs = runs_needed(threshold, target, least)
    firsts = stored(nodes.groupBy(F.xxhash64("sketch").alias("print")).agg(F.min("node").alias("v")), "sketch-prints")
    equal = nodes.select(F.col("node").alias("u"), F.xxhash64("sketch").alias("print")).join(firsts, "print").filter("u <> v").select("u", "v")
    single = stored(nodes.join(firsts.select(F.col("v").alias("node")), "node", "left_semi").select("node", "sketch", "brief"), "sketched")
    found = _met(single, None, range(FIRST_RUNS), threshold, least)
    later = _met(single, _contracted(found), range(FIRST_RUNS, runs), threshold, least)
    return components(equal.union(found).union(later), "candidates")


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """``u, v, n_u`` rows from comparing all pairs of each ``component``'s members (``node, copies, text``) exactly.

    Each row tells that node ``u`` is linked to ``n_u`` other documents in this block and, by ``v``, to one of them, the
    root of its part of the block; so the rows are as many as the members, not their pairs.
    """
    keys = ["component", "bi", "bj"]
    dealt = block_pairs(members, "component", F.xxhash64("node"), GROUP_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _windows(batches, keys, 4 * GROUP_BLOCK):
            columns = [t.column(k).to_numpy() for k in keys]
            new = np.ones(t.num_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cuts = [*np.flatnonzero(new).tolist(), t.num_rows]
            node, copies, side = (t.column(k).to_numpy() for k in ("node", "copies", "side"))
            texts = t.column("text").to_pylist()
            out: list[tuple[int, int, int]] = []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo < 2:
                    continue
                a, b = _similar_pairs(texts[lo:hi], threshold)
                if columns[1][lo] != columns[2][lo]:
                    across = side[lo + a] != side[lo + b]
                    a, b = a[across], b[across]
                count = np.bincount(a, copies[lo + b], hi - lo) + np.bincount(b, copies[lo + a], hi - lo)
                root = roots(hi - lo, a, b)
                out += [(int(node[lo + i]), int(node[lo + root[i]]), int(count[i])) for i in np.flatnonzero(count)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["u", "v", "n_u"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "u long, v long, n_u long")


def _similar_pairs(texts: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of texts whose shingle sets have a Jaccard similarity at or above the threshold."""
    n = len(texts)
    hashes, owner, _ = shingle_hashes(texts)
    order = np.lexsort((owner, hashes))
    hashes, owner = hashes[order], owner[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[once], owner[once]
    size = np.bincount(owner, minlength=n)
    _, token, used = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = used[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    owner = owner[shared]
    both = np.zeros((n, n), np.float32)
    width = max(1, 4_000_000 // n)
    for lo in range(0, int(token.max()) + 1 if len(token) else 0, width):
        own = (token >= lo) & (token < lo + width)
        held = np.zeros((n, min(width, int(token.max()) + 1 - lo)), np.float32)
        held[owner[own], token[own] - lo] = 1.0
        both += held @ held.T
    either = size[:, None] + size[None, :] - both
    # In whole numbers: both / either >= threshold, where the threshold has two decimals.
    return np.nonzero(np.triu(np.rint(both * 100) >= np.rint(either * round(100 * threshold)), 1) & (both > 0).astype(bool))


def jaccard_join(docs: DataFrame, threshold: float = 0.8, target: float = 0.999) -> DataFrame:
    """Per row of ``docs``: ``doc_id, class_id, n_links, n_copies, kept``.

    ``class_id`` is the smallest id reachable over links, ``n_links`` counts the other documents linked directly (equal
    ones included), ``kept`` is true for the document that gives the class its id. Null, empty and wordless texts link with nothing and
    are kept. Rows that repeat an id are copies that count each, and are kept or dropped together. A class of null ids only
    has a null ``class_id``. Columns beside ``doc_id`` and ``text`` are not read.
    """
    return _judged(docs, threshold, target).drop("node")


def _judged(docs: DataFrame, threshold: float, target: float) -> DataFrame:
    """The join's rows with the ``node`` of their text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stored(sketches(base), "sketches")
    worded = rows.filter("node is not null")
    nodes = stored(worded.groupBy("node").agg(F.first("sketch").alias("sketch"), F.first("brief").alias("brief"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("lead")), "nodes")
    groups = stored(candidate_groups(nodes, threshold, target), "groups")
    wanted = groups.join(nodes.drop("sketch", "brief"), "node").withColumnRenamed("lead", "lead_id")
    # The text of a node is that of its first document; another text under the same id is told apart by its fingerprint.
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("lead_id"))).select("component", "node", "copies", "text")
    members = _own_texts(texts)
    links = stored(exact_links(members, threshold), "exact-links")
    direct = links.groupBy(F.col("u").alias("node")).agg(F.sum("n_u").alias("linked"))
    classes = components(links.select("u", "v"), "classes").withColumnRenamed("component", "class_node")
    known = nodes.select("node", "lead", "copies").join(direct, "node", "left").join(classes, "node", "left")
    known = stored(known.withColumn("class_node", F.coalesce("class_node", "node")), "known")
    lead = known.groupBy("class_node").agg(F.min("lead").alias("class_id"))
    final = known.join(lead, "class_node").select("node", "copies", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    judged = rows.select("doc_id", "node").join(final, "node", "left")
    return judged.select(
        "doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), (F.col("node").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def _own_texts(texts: DataFrame) -> DataFrame:
    """Drop rows whose text is not their node's, and repeats of a node that share a task's batch or come from another."""

    def run(c: dict[str, list]) -> dict:
        out: list[int] = []
        for lo, hi in slices([len(t or "") for t in c["text"]]):
            prints = shingle_hashes([t or "" for t in c["text"][lo:hi]])[2].view(np.int64)
            out += (lo + np.flatnonzero(prints == np.asarray(c["node"][lo:hi]))).tolist()
        return {k: [c[k][i] for i in out] for k in c}

    return map_batches(texts, run, "component long, node long, copies long, text string").dropDuplicates(["node"])


def one_of_each_group(docs: DataFrame, threshold: float = 0.8, target: float = 0.999) -> DataFrame:
    """The documents that the join keeps, with all their columns.

    Rows that share an id are kept or dropped together. Rows without an id are told apart by their words: they are kept if they
    link with no document that has an id.
    """
    verdict = stored(_judged(docs, threshold, target), "verdict")
    named = verdict.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    print_ = f"_{uuid.uuid4().hex}"

    def with_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            prints = [int(p) for lo, hi in slices([len(t) for t in texts]) for p in shingle_hashes(texts[lo:hi])[2].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, print_])

    at = docs.columns.index("text")
    unnamed = docs.filter("doc_id is null")
    unnamed = unnamed.mapInArrow(tidy(with_print), T.StructType([*docs.schema.fields, T.StructField(print_, T.LongType())]))
    own = verdict.filter("doc_id is null and kept").select(F.coalesce("node", F.lit(0).cast("long")).alias(print_)).distinct()
    return rows_with(docs.filter("doc_id is not null"), named.filter("kept")).unionByName(unnamed.join(own, print_, "left_semi").drop(print_))
