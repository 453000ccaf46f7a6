"""Near-duplicate vectors by NN-descent.

The neighbour graph starts from random projection trees, whose leaves are cut to
a fixed size, and is refined by joining the neighbours of each vector with
each other. Lists that hold nothing but links are enlarged. A sample of vectors
compared with all others audits the recall; while it is short, further trees and
refinements follow. Edges at the threshold give clusters; vectors whose enlarged
lists still hold nothing but links are compared exactly across clusters, by balls.
In a cluster every pair is then compared in double precision, in blocks: what a
full list left out is found there. If the recall stays short, balls of all vectors are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inodelake.llm.graph import components, pairs_inside
from inodelake.llm.ngram_join import _grouped
from inodelake.llm.vectors import USABLE_SQL, hashed_sample, lengths, linked_in_blocks, matrix, prepared
from inodelake.runtime import table, written

THRESHOLD = 0.95
#: Neighbours in a list, and in one that holds links only.
NEIGHBOURS, ENLARGED = 8, 24
#: Trees of a round, vectors in a leaf, neighbours that a leaf gives each, refinements of a round.
TREES, LEAF, FROM_LEAF, REFINEMENTS = 10, 128, 4, 2
#: Members of a vector's neighbourhood that are joined at a time.
JOINED = 64
#: Vectors of the audit, the share of their links that must be found, and the most rounds.
AUDIT, RECALL, ROUNDS = 2048, 0.999, 4
#: Vectors in a block of the exact comparison.
BLOCK = 512
#: Candidates are found in single precision; this much below the threshold they are kept for the exact comparison.
MARGIN = 1e-4
#: Least cosine to the center of a ball; balls whose centers meet at a time; what an angle in single precision may be off.
BALL, CENTERS, SLACK = 0.99, 2048, 2e-3

EDGE = "a binary, b binary, sim float"


def _edges(a: list, b: list, sim: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(sim, pa.float32())], names=["a", "b", "sim"])


def _top(keys: np.ndarray, sims: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best partners of each row of ``sims`` (its own place excluded)."""
    np.fill_diagonal(sims, -2)
    k = min(k, len(keys) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(keys, k).tolist(), keys[best].ravel().tolist(), np.take_along_axis(sims, best, 1).ravel().tolist()


def _trees(classes: DataFrame, dims: int, n: int, trees: int, seed: int) -> DataFrame:
    """Edges between the vectors of a leaf, of ``trees`` random projection trees."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))
    planes = np.random.default_rng(seed).standard_normal((dims, trees * (bits + 1))).astype(np.float32)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, units = batch.column(0), batch.column(1)
            x = matrix(units.to_pylist(), unit=False, kind="<f4").astype(np.float32) @ planes
            for t in range(trees):
                own = x[:, t * (bits + 1) : (t + 1) * (bits + 1)]
                code = np.zeros(len(x), dtype=np.int64)
                for k in range(bits):
                    code = code << 1 | (own[:, k] > 0)
                code = code << 24 | (np.clip(own[:, bits] / 16 + 0.5, 0, 0.999999) * (1 << 24)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array(code), keys, units], names=["tree", "code", "key", "unit"])

    def leaves(batches: Iterator) -> Iterator:
        for tree_rows in _leaf_rows(batches):
            keys, units = tree_rows
            if len(keys) > 1:
                v = matrix(units, unit=False, kind="<f4").astype(np.float32)
                yield _edges(*_top(np.array(keys, dtype=object), v @ v.T, FROM_LEAF))

    def _leaf_rows(batches: Iterator) -> Iterator[tuple[list, list]]:
        keys: list[bytes] = []
        units: list[bytes] = []
        now = None
        for batch in batches:
            for tree, key, unit in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if len(keys) == LEAF or tree != now:
                    if keys:
                        yield keys, units
                    keys, units, now = [], [], tree
                keys.append(key)
                units.append(unit)
        if keys:
            yield keys, units

    placed = classes.select("key", "unit").mapInArrow(place, "tree int, code long, key binary, unit binary")
    placed = placed.repartitionByRange("tree", "code", "key").sortWithinPartitions("tree", "code", "key")
    return placed.mapInArrow(leaves, EDGE)


def _best(edges: DataFrame, threshold: float) -> DataFrame:
    """Each vector's neighbours: its NEIGHBOURS nearest, or ENLARGED if those are all links; a row per neighbour, with the list's last similarity."""
    # partial maxima and partial ranks first: a task hands on an edge once, and a vector's ENLARGED nearest
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    near = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    whole = Window.partitionBy("a")
    ranked = once.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= ENLARGED)
    full = F.max(F.when(F.col("rank") == NEIGHBOURS, F.col("sim"))).over(whole)
    listed = ranked.withColumn("eighth", full).where((F.col("rank") <= NEIGHBOURS) | (F.col("eighth") >= threshold))
    last = F.when(F.col("eighth").isNotNull(), F.min("sim").over(whole)).otherwise(-1.0).cast("float")
    return written(listed.select("a", "b", "sim", last.alias("last")), "graph")


def _refined(graph: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The graph after joining, at every vector, its neighbours and those it is a neighbour of with each other."""
    lasts = graph.groupBy("a").agg(F.first("last").alias("last")).withColumnRenamed("a", "of")
    forward = graph.select(F.col("a").alias("center"), F.col("b").alias("member"))
    meet = forward.union(graph.select(F.col("b").alias("center"), F.col("a").alias("member"))).distinct()
    meet = written(meet, "meet")
    crowds = meet.groupBy("center").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > JOINED).withColumnRenamed("center", "at")
    meet = meet.join(crowds, F.col("center") == F.col("at"), "left")
    # a crowd is dealt into groups of about JOINED, anew in each round
    group = F.coalesce(F.pmod(F.xxhash64("member", "center"), F.ceil(F.col("n") / JOINED)), F.lit(0)).cast("int")
    meet = meet.select("center", group.alias("group"), "member")
    units = classes.join(lasts, classes["key"] == lasts["of"], "left").select("key", "unit", F.coalesce("last", F.lit(-1.0)).cast("float").alias("last"))
    rows = meet.join(units, meet["member"] == units["key"]).select("center", "group", "key", "unit", "last")

    def join(batches: Iterator) -> Iterator:
        a: list = []
        b: list = []
        sim: list = []
        for _, _, keys, unit, last in _grouped(batches, 1):
            if len(keys) < 2:
                continue
            names = np.array(keys, dtype=object)
            v = np.frombuffer(b"".join(unit), dtype="<f4").reshape(len(keys), -1)
            s = v @ v.T
            x, y, z = _top(names, s, NEIGHBOURS)
            z = np.array(z)
            better = np.flatnonzero(z > np.repeat(np.array(last, dtype=np.float32), len(z) // len(keys)))
            a += [x[k] for k in better]
            b += [y[k] for k in better]
            sim += z[better].tolist()
            if len(a) > 20_000:
                yield _edges(a, b, sim)
                a, b, sim = [], [], []
        if a:
            yield _edges(a, b, sim)

    found = rows.repartition("center", "group").sortWithinPartitions("center", "group").mapInArrow(join, EDGE)
    return _best(graph.select("a", "b", "sim").union(found), threshold)


def _audit(classes: DataFrame, threshold: float, size: int) -> DataFrame:
    """All links (a, b) of a sample of ``size`` vectors, chosen by their digests, compared with every vector in blocks."""
    sample = hashed_sample(classes.select("key", "vec"), ["key"], size, classes.count())
    keys = [bytes(r["key"]) for r in sample]
    units = matrix([bytes(r["vec"]) for r in sample])
    shared = classes.sparkSession.sparkContext.broadcast((keys, units))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                theirs = some.column(0).to_pylist()
                x, y = np.nonzero(own @ matrix(some.column(1).to_pylist()).T >= threshold)
                pairs = [(names[i], theirs[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True) if names[i] != theirs[j]]
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], names=["a", "b"])

    return classes.select("key", "vec").mapInArrow(compare, "a binary, b binary")


def _across(members: DataFrame, dims: int, threshold: float) -> DataFrame:
    """Edges (a, b) between the roots of all members (key, root, unit) that are linked across clusters.

    Each cluster is covered by balls, in blocks. Only balls whose centers' angle is at most the threshold's and both
    radii can hold a link: their members are compared with each other.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = members.join(sizes, "root").select("root", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "key", "unit")

    def cover(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for roots, _, keys, units in _grouped(batches, 1):
            v = matrix(units, unit=False, kind="<f4")
            left, out = np.arange(len(v)), []
            while len(left):
                cos = v[left] @ v[left[0]]
                own = cos >= BALL
                own[0] = True
                radius = float(np.arccos(np.clip(cos[own].min(), -1, 1)))
                out.append((keys[left[0]], roots[0], units[left[0]], radius, b"".join(units[k] for k in left[own])))
                left = left[~own]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.binary()), strict=True)], names=["ball", "root", "center", "radius", "units"])

    covered = rows.repartition("root", "block").sortWithinPartitions("root", "block", "key").mapInArrow(cover, "ball binary, root binary, center binary, radius double, units binary")
    balls = written(covered, "balls")
    blocks = max(1, -(-balls.count() // CENTERS))
    met = balls.withColumn("own", F.pmod(F.xxhash64("ball"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "ball", "root", "center", "radius")
    reach = float(np.arccos(max(-1.0, threshold - MARGIN))) + SLACK

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for lo, hi, owns, names, roots, centers, radius in _grouped(batches, 1):
            v, r = matrix(centers, unit=False, kind="<f4"), np.array(radius)
            number = {x: k for k, x in enumerate(sorted(set(roots)))}
            root = np.array([number[x] for x in roots])
            side = np.array(owns) == lo[0]
            one = np.flatnonzero(side)
            two = one if lo[0] == hi[0] else np.flatnonzero(~side)
            for at in range(0, len(one), 256):
                some = one[at : at + 256]
                near = np.arccos(np.clip(v[some] @ v[two].T, -1, 1)) <= reach + r[some][:, None] + r[two][None, :]
                apart = root[some][:, None] - root[two][None, :]
                near &= apart < 0 if lo[0] == hi[0] else apart != 0
                x, y = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some[x]], pa.binary()), pa.array([names[k] for k in two[y]], pa.binary())], names=["x", "y"])

    pairs = written(met.repartition("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(meet, "x binary, y binary"), "near")
    x = balls.select(F.col("ball").alias("x"), F.col("root").alias("a"), F.col("units").alias("left"))
    y = balls.select(F.col("ball").alias("y"), F.col("root").alias("b"), F.col("units").alias("right"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            linked = []
            for k in range(batch.num_rows):
                one, two = (np.frombuffer(c[k].as_py(), dtype="<f4").reshape(-1, dims) for c in (left, right))
                linked.append(bool((one @ two.T >= threshold - MARGIN).any()))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(linked, pa.bool_())), b.filter(pa.array(linked, pa.bool_()))], names=["a", "b"])

    met = pairs.join(x, "x").join(y, "y").select("a", "b", "left", "right")
    return written(met.mapInArrow(compare, "a binary, b binary").distinct(), "across")


def _joined(close: DataFrame, clusters: DataFrame, members: DataFrame, dims: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges and clusters with those joined that the exact comparison of ``members`` across clusters links."""
    members = written(members, "members")
    if not members.take(1):
        return close, clusters
    across = _across(members, dims, threshold)
    if not across.take(1):
        return close, clusters
    close = close.union(across)
    return close, components(close)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall of every row of ``vectors``.

    Two vectors are linked if their cosine, in double precision, is ``threshold`` or
    more. n_links counts the other vectors linked directly, component_id is the
    smallest id that links lead to, kept tells whether that is the own one, and
    recall is the share of the audited vectors' links that the search found, 1 for vectors that link with nothing.
    Vectors that are null, empty, zero, or hold a null or non-finite number link with
    nothing, the others with those of their own length, each length in a search of its own. Repeated rows are vectors of
    their own. An empty table gives no rows. Other columns are ignored.
    """
    rows = written(prepared(vectors, id_col, vec_col), "vectors")
    id_ = F.col("id")
    out = rows.where("key is null").select(id_.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), id_.alias("component_id"), (id_ == id_).alias("kept"), F.lit(1.0).alias("recall"))
    for dims in lengths(rows):
        out = out.union(_near_rows(rows.where(F.col("dims") == dims), dims, threshold))
    return out


def _near_rows(rows: DataFrame, dims: int, threshold: float) -> DataFrame:
    """What ``near_vectors`` gives, of vectors of one length."""
    classes = rows.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))

    def single(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                unit = matrix(batch.column(3).to_pylist()).astype("<f4")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([u.tobytes() for u in unit], pa.binary())], names=["key", "first_id", "n", "vec", "unit"])

    classes = written(classes.mapInArrow(single, "key binary, first_id long, n long, vec binary, unit binary"), "classes")
    n = classes.count()
    audit = written(_audit(classes, threshold, AUDIT), "audit")
    total = audit.count()
    graph, recall = None, 1.0
    for turn in range(ROUNDS):
        edges = _trees(classes, max(dims, 1), n, TREES, turn)
        graph = _best(edges if graph is None else edges.union(graph.select("a", "b", "sim")), threshold)
        for _ in range(REFINEMENTS):
            graph = _refined(graph, classes, threshold)
        close = graph.where(F.col("sim") >= threshold - MARGIN).select("a", "b")
        clusters = components(close)
        # links that a full list of links left out may lead to other clusters
        full = graph.groupBy("a").agg(F.count(F.lit(1)).alias("listed"), F.first("last").alias("last"))
        full = full.where((F.col("listed") >= ENLARGED) & (F.col("last") >= threshold - MARGIN)).select("a")
        members = clusters.join(full, clusters["node"] == full["a"]).join(classes, clusters["node"] == classes["key"]).select("key", "root", "unit")
        close, clusters = _joined(close, clusters, members, dims, threshold)
        recall = pairs_inside(audit, clusters) / total if total else 1.0
        if recall >= RECALL:
            break
    if recall < RECALL:
        members = classes.join(clusters, classes["key"] == clusters["node"], "left").select("key", F.coalesce("root", "key").alias("root"), "unit")
        close, clusters = _joined(close, clusters, members, dims, threshold)
        recall = pairs_inside(audit, clusters) / total if total else 1.0
    if recall < 1:
        clusters = components(close.union(audit))  # the audit's own links are not thrown away
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
    members = clusters.join(sizes, "root").select(F.col("root").alias("cluster"), F.col("node").alias("key"), "m")
    members = written(members.join(classes.select("key", "n", "vec"), "key").select("cluster", "key", "n", "m", "vec"), "members")
    checked = written(linked_in_blocks(members, threshold, BLOCK), "links")
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(checked.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b"))
    of_class = classes.select("key", "first_id", "n").join(roots, F.col("key") == F.col("node"), "left").join(links, "key", "left")
    of_class = written(of_class.select("key", "first_id", F.coalesce("root", "key").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    least = of_class.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = of_class.join(least, "root").select("key", "n_links", "component_id")
    out = rows.join(found, "key", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).withColumn("recall", F.lit(float(recall)))


def op4_vector_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The links and the component of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings")).drop("recall")


OP4_SQL = f"""
WITH RECURSIVE v AS (
  {USABLE_SQL}
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), links AS (
  SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs
), reached AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), components AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reached GROUP BY x
), counts AS (
  SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM components LEFT JOIN counts USING (vec_id)
"""
