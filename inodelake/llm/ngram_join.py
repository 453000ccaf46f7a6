"""Jaccard join of documents on word shingles by chosen paths.

Documents with equal shingle sets form a class; classes are joined. A class is
sketched by TOKENS min-hashes, each a token that two classes share with the
probability of their similarity. From the root of every run, classes walk to the
nodes named by sampled tokens they have, so that similar classes walk together;
nodes with few classes are compared by brute force. In a larger one, classes that
are much alike to its first one are done with it, and the others are split on
further tokens. There are as many runs as a pair at the threshold is expected to need; then a
sample of classes, compared with all others by their sketches, audits what was found, and runs
repeat until the recall is reached. What the paths give are candidate
clusters; within a cluster all pairs of near sizes are compared exactly, in blocks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.llm.blocks import PAIR, core_links, paired
from inodelake.llm.graph import components, pairs_inside
from inodelake.llm.tokens import small_batches
from inodelake.runtime import free_name, table, written

WORDS, THRESHOLD = 5, 0.8
#: Min-hashes of a class; agreement from which brute force takes a pair as a candidate (four standard deviations below the threshold).
TOKENS, CANDIDATE = 64, 0.6
#: Classes of a node that are compared by brute force; steps after which a larger node is taken as one cluster; tokens sampled in a later step.
BUCKET, STEPS, DEEPER = 256, 4, 2
#: Agreement with a large node's first class from which a class is joined to it, and from which it walks no further:
#: whatever is similar to the latter is near enough to the first class to be joined to it as well.
JOINED, DONE = 0.4, 0.9
RECALL = 0.9999
#: Classes of the audit, the least share of their alike classes that must be found, and the most repetitions of the runs for it.
AUDIT, FOUND, REPEATS = 256, 0.99, 16
#: Classes in one block of the exact comparison.
BLOCK = 256
#: Up to so many candidates, their numbers are broadcast to the texts; more are merged with them.
BROADCAST = 200_000
#: Words whose hashes a worker process remembers.
MEMORY = 200_000

WORD = re.compile(r"\w+")
U = np.uint64
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_hashes = _Hashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted, distinct hashes of a whole text's word shingles; a text of fewer words is one shingle, one without words has none."""
    found = WORD.findall((text or "").lower())
    if not found:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    n = max(1, len(w) - words + 1)
    h = np.full(n, min(len(w), words), dtype=np.uint64)
    for k in range(min(words, len(w))):
        h = h * U(0x9E3779B97F4A7C15) + w[k : k + n]
    return np.unique(mix(h))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
    return a | U(1), mix(a)


def sketches(sets: Sequence[np.ndarray], tokens: int = TOKENS) -> np.ndarray:
    """Min-hashes (32 bits) of non-empty sets, a row each."""
    out = np.empty((len(sets), tokens), dtype="<u4")
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for k, (a, b) in enumerate(zip(*_seeds(tokens), strict=True)):
        out[:, k] = np.minimum.reduceat(((every * a + b) >> U(32)).astype(np.uint32), starts)
    return out


def sketched(docs: DataFrame, keep: Sequence[str], words: int, text_col: str) -> DataFrame:
    """``keep`` and, of every document, its set's digest, size and sketch (null without words), written to the shared folder."""
    rows = small_batches(docs).select(*keep, text_col)
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)

    def sketch(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                sets = [shingles(t, words) for t in some.column(len(keep)).to_pylist()]
                real = [k for k, s in enumerate(sets) if len(s)]
                digests, sigs = [None] * len(sets), [None] * len(sets)
                if real:
                    for k, sig in zip(real, sketches([sets[k] for k in real]), strict=True):
                        digests[k], sigs[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), sig.tobytes()
                arrays = [*some.columns[: len(keep)], pa.array(digests, pa.binary()), pa.array(list(map(len, sets)), pa.int32()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "set_id", "set_size", "sketch"])

    return written(rows.mapInArrow(sketch, f"{fields}, set_id binary, set_size int, sketch binary"), "sketches")


def runs_needed(threshold: float = THRESHOLD, steps: int = STEPS, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met at the end of a path with probability ``recall``.

    In each run a root has one or two tokens (1 / threshold on average). Most
    nodes are small after the first step; the count allows for one further step.
    """
    two = 1 / threshold - 1
    step = (1 - two) * threshold + two * (1 - (1 - threshold) ** 2)
    pairs = threshold**DEEPER
    deep = step * (1 - (1 - pairs) ** 2 * (1 / pairs - 1) - (1 - pairs) * (2 - 1 / pairs))
    return math.ceil(math.log(1 - recall) / math.log(1 - deep))


def _choices(nodes: np.ndarray, tokens: int, salt: int, per: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each node its sampled coordinates, one after another: rows that have one, and the coordinate."""
    h = mix(nodes + U(salt))
    whole, part = int(per), per - int(per)
    times = whole + ((h >> U(40)).astype(np.float64) / (1 << 24) < part)
    for k in range(int(times.max(initial=0))):
        rows = np.flatnonzero(times > k)
        yield rows, (mix(h[rows] + U(k + 1)) % U(tokens)).astype(np.int64)


def _step(frontier: DataFrame, depth: int, threshold: float) -> DataFrame:
    """set_id and child node for the rows of ``frontier`` (set_id, node, sketch): one token at the root, DEEPER at a time later."""

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.array(batch.column(0).to_pylist(), dtype=object)
            nodes = batch.column(1).to_numpy().astype(np.uint64)
            sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u4").reshape(len(ids), -1)
            per = 1 / threshold if depth == 0 else 1 / threshold**DEEPER
            for rows, first in _choices(nodes, sigs.shape[1], depth, per):
                child = mix(nodes[rows] ^ mix(first.astype(np.uint64) + (sigs[rows, first].astype(np.uint64) << U(8))))
                for more in range(1, DEEPER if depth else 1):
                    other = (first + 1 + (mix(nodes[rows] + U(97 + more)) % U(sigs.shape[1] - 1)).astype(np.int64)) % sigs.shape[1]
                    child = mix(child ^ mix(other.astype(np.uint64) + (sigs[rows, other].astype(np.uint64) << U(8))))
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows].tolist(), pa.binary()), pa.array(child.astype(np.int64))], names=["set_id", "node"])

    return frontier.select("set_id", "node", "sketch").mapInArrow(walk, "set_id binary, node long")


def _grouped(batches: Iterator, key: int = 0) -> Iterator[list[list]]:
    """The columns of consecutive rows with the same key (one or more leading columns)."""
    held: list[list] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*cols[: key + 1], strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = [c[a:b] for c in cols]
            if held is not None and tuple(h[-1] for h in held[: key + 1]) == keys[a]:
                for h, p in zip(held, part, strict=True):
                    h.extend(p)
            else:
                if held is not None:
                    yield held
                held = part
    if held is not None:
        yield held


def roots_of(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index, of a symmetric boolean matrix."""
    n = len(linked)
    root = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, root[None, :], n).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _brute(leaves: DataFrame) -> DataFrame:
    """Spanning edges (a, b) of the candidate pairs in each node of ``leaves`` (node, set_id, sketch)."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        a: list[bytes] = []
        b: list[bytes] = []
        for _, ids, sigs in _grouped(batches):
            if len(ids) > 1:
                s = np.frombuffer(b"".join(sigs), dtype="<u4").reshape(len(ids), -1)
                if len(ids) == 2:
                    if np.count_nonzero(s[0] == s[1]) >= CANDIDATE * s.shape[1]:
                        a.append(ids[0])
                        b.append(ids[1])
                else:
                    same = np.zeros((len(ids), len(ids)), dtype=np.int16)
                    for k in range(s.shape[1]):
                        same += s[:, None, k] == s[None, :, k]
                    for i, r in enumerate(roots_of(same >= CANDIDATE * s.shape[1]).tolist()):
                        if i != r:
                            a.append(ids[i])
                            b.append(ids[r])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return leaves.select("node", "set_id", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(compare, "a binary, b binary")


def _near_first(large: DataFrame, sketch: DataFrame) -> DataFrame:
    """set_id, node and first of ``large``, with joined and done: how the class agrees with the node's first one."""

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<u4").reshape(batch.num_rows, -1) for k in (3, 4))
                agree = (a == b).mean(1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(agree >= JOINED), pa.array(agree >= DONE)], names=["set_id", "node", "first", "joined", "done"])

    firsts = sketch.select(F.col("set_id").alias("of"), F.col("sketch").alias("theirs"))
    both = large.join(sketch, "set_id").join(firsts, F.col("first") == F.col("of")).select("set_id", "node", "first", "sketch", "theirs")
    return both.mapInArrow(compare, "set_id binary, node long, first binary, joined boolean, done boolean")


def candidate_edges(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, turn: int = 0) -> DataFrame:
    """Edges (a, b) between classes (set_id, sketch) whose components hold every similar pair, but for the recall; other runs in each ``turn``."""
    runs = runs_needed(threshold, recall=recall)
    roots = F.array(*[F.xxhash64(F.lit(turn * runs + k)) for k in range(runs)])
    frontier = classes.select("set_id", "sketch", F.explode(roots).alias("node"))
    sketch = classes.select("set_id", "sketch")
    edges = []
    for depth in range(STEPS):
        walked = _step(frontier, depth, threshold)
        walked = written(walked.distinct() if depth else walked, "paths")
        # a table of its own: the join with it can then be dealt anew where a node holds a large share of the classes
        counts = written(walked.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("set_id").alias("first")).where("n > 1"), "counts")
        met = written(walked.join(counts, "node"), "nodes")
        small = met.where(F.col("n") <= BUCKET).join(sketch, "set_id")
        edges.append(_brute(small))
        large = met.where(F.col("n") > BUCKET)
        if not large.take(1):
            break
        if depth == 0:  # from here on only the sketches of these classes are looked at
            sketch = written(large.select("set_id").distinct().join(sketch, "set_id"), "sketches")
        large = written(_near_first(large, sketch), "large")
        # after so many shared tokens the classes of a node are alike: one cluster, compared exactly later
        last = depth == STEPS - 1
        edges.append(large.where(F.lit(last) | F.col("joined")).select(F.col("set_id").alias("a"), F.col("first").alias("b")).where("a <> b"))
        if not last:
            frontier = large.where(~F.col("done")).select("set_id", "node").join(sketch, "set_id")
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def _compare(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted sets have a Jaccard similarity of ``threshold`` or more."""
    sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
    every = np.concatenate(left + right)
    values, code, count = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    at = place[code]
    row, at = row[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    width = 4096
    for start in range(0, len(shared), width):
        a, b = np.searchsorted(at, [start, start + width])
        has = np.zeros((len(left) + len(right), width), dtype=np.float32)
        has[row[a:b], at[a:b] - start] = 1
        common += has[: len(left)] @ has[len(left) :].T
    common = common.astype(np.int64)
    union = sizes[0][:, None] + sizes[1][None, :] - common
    # exact in whole numbers: common / union >= threshold
    return common * 1_000_000 >= union * round(threshold * 1_000_000)


def _audit(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes that agree in the threshold's share of their sketches, for a sample of about AUDIT classes and all others."""
    share = min(1.0, AUDIT / max(1, classes.count()))
    sample = classes.where(F.pmod(F.xxhash64("set_id"), F.lit(1 << 30)) < share * (1 << 30)).select("set_id", "sketch").limit(4 * AUDIT).collect()
    own = [bytes(r["set_id"]) for r in sample]
    shared = classes.sparkSession.sparkContext.broadcast((own, np.frombuffer(b"".join(bytes(r["sketch"]) for r in sample), dtype="<u4").reshape(len(own), -1 if own else TOKENS)))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, theirs = shared.value
        for batch in batches if names else ():
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = some.column(0).to_pylist()
                s = np.frombuffer(b"".join(some.column(1).to_pylist()), dtype="<u4").reshape(len(ids), -1)
                same = np.zeros((len(names), len(ids)), dtype=np.uint8)
                for k in range(s.shape[1]):
                    same += theirs[:, k, None] == s[None, :, k]
                pairs = [(names[x], ids[y]) for x, y in np.argwhere(same >= threshold * s.shape[1]).tolist() if names[x] != ids[y]]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return written(classes.select("set_id", "sketch").mapInArrow(compare, "a binary, b binary"), "audit")


def candidate_clusters(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """node and root: clusters of classes (set_id, sketch) that hold the similar pairs; runs repeat until the audit finds FOUND of its pairs in them."""
    audit = _audit(classes, threshold)
    total, edges = audit.count(), None
    for turn in range(REPEATS):
        new = written(candidate_edges(classes, threshold, recall, turn), "candidates")
        edges = new if edges is None else edges.union(new)
        clusters = components(edges)
        found = pairs_inside(audit, clusters)
        if found >= FOUND * total:
            # the audit's own pairs are not thrown away
            return clusters if found == total else components(edges.union(audit))
    raise RuntimeError(f"only {found} of {total} audited pairs were found after {REPEATS} repetitions")


def _cored(sets: DataFrame, threshold: float) -> DataFrame:
    """``sets`` (cluster, set_id, n, m, set_size, hashes) with core and band.

    The core of a cluster of more than BLOCK sets are those within half the threshold's distance of its first set: as
    the distance of sets obeys the triangle inequality, all of them are linked with each other. Bands are sizes, a
    threshold wide: sets further apart than neighbouring bands can't be similar.
    """
    width = math.log(1 / threshold) + 1e-9 if threshold < 1 else 1e-9
    small = sets.where(F.col("m") <= BLOCK).select("cluster", "set_id", "n", "hashes", F.lit(False).alias("core"), F.lit(0).cast("long").alias("band"))
    large = sets.where(F.col("m") > BLOCK)
    if not large.take(1):
        return small
    half = math.ceil((1 + threshold) / 2 * 1_000_000)

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            core = []
            for own, first in zip(batch.column(4), batch.column(5), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (own, first))
                common = len(np.intersect1d(x, y, assume_unique=True))
                core.append(common * 1_000_000 >= (len(x) + len(y) - common) * half)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(core, pa.bool_()), batch.column(3)], names=["cluster", "set_id", "n", "hashes", "core", "band"])

    firsts = large.where("set_id = cluster").select(F.col("cluster").alias("of"), F.col("hashes").alias("first"))
    band = F.floor(F.log(F.col("set_size").cast("double")) / width).cast("long").alias("band")
    both = large.join(firsts, F.col("cluster") == F.col("of")).select("cluster", "set_id", "n", band, "hashes", "first")
    return small.union(written(both.mapInArrow(near, "cluster binary, set_id binary, n long, hashes binary, core boolean, band long"), "cores"))


def _verified(members: DataFrame, threshold: float) -> DataFrame:
    """set_id, links and root of the members (cluster, set_id, n, hashes, core, band) that have a link: of the core by its weight, of all others by comparing blocks."""
    rows = paired(members, "set_id", BLOCK, (-1, 0, 1)).select(*PAIR, "set_id", "n", "second", "hashes")

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, one, lo, two, hi, ids, n, second, raw in _grouped(batches, 4):
            if len(ids) < 2:
                continue
            order = np.argsort(second, kind="stable").tolist()
            cut = len(ids) - sum(second)
            sets = [np.frombuffer(raw[k], dtype="<u8") for k in order]
            names = [ids[k] for k in order]
            weight = np.array([n[k] for k in order], dtype=np.int64)
            linked = np.zeros((len(sets), len(sets)), dtype=bool)
            if (one[0], lo[0]) == (two[0], hi[0]):
                linked = _compare(sets, sets, threshold)
                np.fill_diagonal(linked, False)
            elif 0 < cut < len(sets):
                linked[:cut, cut:] = _compare(sets[:cut], sets[cut:], threshold)
                linked |= linked.T
            links, root = linked @ weight, roots_of(linked)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.binary()), pa.array(links[some]), pa.array([names[root[k]] for k in some], pa.binary())], names=["set_id", "links", "root"])

    found = rows.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(compare, "set_id binary, links long, root binary")
    return found.union(core_links(members, "set_id"))


def jaccard_classes(docs: DataFrame, keep: Sequence[str] = ("doc_id",), threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, text_col: str = "text", row: str | None = None) -> DataFrame:
    """``keep``, class_id, n_links and kept for every document.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is ``threshold`` or more. Words are runs of letters, digits and
    underscores in lower case; a text of fewer words is one shingle; texts of any length are taken whole. n_links counts the other documents linked
    directly; class_id is the smallest ``keep[0]`` that links lead to, its own included;
    kept marks one row of each class, the first with that value. Null, empty and
    wordless texts link with nothing. Repeated rows are documents of
    their own that link with each other, rows without ``keep[0]`` too. An empty table gives no rows. Other columns are
    ignored, whatever their names; ``keep`` may not have those returned beside it.

    ``row`` is a column that tells the rows of a written table apart; without one, texts are numbered in a written copy.
    """
    own = {"class_id", "n_links", "kept", "set_id", "set_size", "sketch", "row", "text"}
    if clash := own & {k.lower() for k in keep}:
        raise ValueError(f"kept columns may not be named {sorted(clash)}")
    key, kept = keep[0], [F.col(f"`{k}`") for k in keep]
    docs = docs.select(*kept, F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    docs = docs if row else written(docs, "texts")
    rows = sketched(docs, ["row", *keep], words, "text")
    has = rows.where("set_id is not null")
    first = F.min(F.struct(F.col(f"`{key}`").isNull().alias("none"), F.col(f"`{key}`").alias("id"), "row"))
    classes = has.groupBy("set_id").agg(F.first("sketch").alias("sketch"), F.first("set_size").alias("set_size"), first.alias("first"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("row", F.col("first.row")), "classes")
    clusters = candidate_clusters(classes.select("set_id", "sketch"), threshold, recall).select(F.col("node").alias("set_id"), F.col("root").alias("cluster"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    members = clusters.join(sizes, "cluster").join(classes.select("set_id", "set_size", F.col("row").alias("of"), "n"), "set_id")
    members = written(members.select("of", "cluster", "set_id", "n", "m", "set_size"), "members")

    def again(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingles(t, words).tobytes() for t in some.column(5).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:5], pa.array(sets, pa.binary())], names=["cluster", "set_id", "n", "m", "set_size", "hashes"])

    few = members.limit(BROADCAST + 1).count() <= BROADCAST
    texts, met = docs.select("row", "text"), F.col("row") == F.col("of")
    if few:  # the numbers alone are broadcast, and only the texts they let through are shuffled
        texts = texts.join(F.broadcast(members.select("of")), met, "left_semi")
    texts = texts.join(members.hint("merge"), met).select("cluster", "set_id", "n", "m", "set_size", "text")
    sets = written(small_batches(texts).mapInArrow(again, "cluster binary, set_id binary, n long, m long, set_size int, hashes binary"), "sets")
    checked = written(_verified(_cored(sets, threshold), threshold), "links")
    links = checked.groupBy("set_id").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("set_id").alias("a"), F.col("root").alias("b")).where("a <> b"))
    of_class = classes.join(roots, classes["set_id"] == roots["node"], "left").select("set_id", F.coalesce("root", "set_id").alias("root"), "first", "n")
    of_class = written(of_class.join(links, "set_id", "left").select("set_id", "root", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    least = of_class.groupBy("root").agg(F.min("first").alias("best"))
    found = written(of_class.join(least, "root").select(F.col("set_id").alias("of"), "n_links", F.col("best.id").alias("class_id"), F.col("best.row").alias("leader")), "found")
    out = rows.join(found, F.col("set_id") == F.col("of"), "left")
    alone = F.col("set_id").isNull()
    return out.select(*kept, F.when(alone, F.col(f"`{key}`")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), (alone | (F.col("row") == F.col("leader"))).alias("kept"))


def near_unique(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each class. Columns may have any names; nulls, odd texts and empty tables are as in ``jaccard_classes``."""
    row, own = (free_name(n, *docs.columns) for n in ("__row", "__own"))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    chosen = jaccard_classes(numbered, keep=(row,), row=row, **how).where("kept").select(F.col(row).alias(own))
    return numbered.join(chosen, F.col(row) == F.col(own), "left_semi").drop(row)


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS words FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {WORDS - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {WORDS - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
  SELECT x, y FROM shared JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE common * 1000000 >= (s.n + t.n - common) * {round(THRESHOLD * 1_000_000)}
), links AS (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), classes AS (
  SELECT x AS doc_id, min(y) AS class_id FROM reached GROUP BY x
), counts AS (
  SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x
)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links, doc_id = class_id AS kept FROM classes LEFT JOIN counts USING (doc_id)
"""
