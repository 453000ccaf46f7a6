"""Masked pseudo-likelihood: every token is predicted from the tokens on both sides.

Two window networks, trained in numpy, predict a token: one from its two nearest
neighbours, one from the two behind those. A network is log-bilinear: the classes of
the neighbours have embeddings, whose sum is multiplied with an embedding of each
token, and a softmax over all tokens follows; the networks' probabilities are mixed.
The sum of the log-probabilities of all tokens scores a document.

A log-likelihood of this kind depends on the corpus only through counts: how often a
token stands beside a class, and a class beside another. These are counted over every
position of every document and summed by Spark; their number is bounded by the model,
not by the corpus. So each step of training is the gradient over all positions,
its softmaxes dealt to tasks by context.

Tokens too rare for an embedding share one by their ending. Their own counts, over
all documents, are joined to their occurrences; what a document holds itself is left
out of them, so a token that no other document has counts as half an occurrence.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inodelake.llm.tokens import small_batches
from inodelake.runtime import table, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: The most tokens with an embedding of their own, and the least count of one.
PLACES, LEAST = 30_000, 8
#: Classes of neighbours: the most frequent tokens, endings of the others, and what is beyond a document's edge.
OWN, ENDINGS = 72, 23
EDGE = OWN + ENDINGS
CLASSES = EDGE + 1
#: The neighbours that each network looks at, the first network's share in the mixture, and the size of an embedding.
PAIRS, INNER, DIM = ((-1, 1), (-2, 2)), 0.75, 16
#: Steps of training, their size, and tasks of a step.
STEPS, RATE, TASKS = 8, 0.06, 16
#: Counts are shrunk towards independence by this many occurrences before the first embeddings are taken from them.
SHRINK = 5.0
#: Distinct tokens that a worker counts or remembers before it hands them on; tokens looked at together.
MEMORY, BLOCK = 200_000, 1 << 19
FAR = max(abs(k) for pair in PAIRS for k in pair)


class Vocabulary(NamedTuple):
    codes: dict[str, int]  # token to unit; other tokens' units are len(codes) + ending
    classes: np.ndarray  # of each unit


class Network(NamedTuple):
    left: np.ndarray  # class, DIM
    right: np.ndarray  # class, DIM
    out: np.ndarray  # unit, DIM
    bias: np.ndarray  # unit


def tokens(text: str | None) -> list[str]:
    """The words of a text in lower case, and what stands between words and white space."""
    return TOKEN.findall((text or "").lower())


def ending(token: str) -> int:
    """The group of a token by its last two characters."""
    return zlib.crc32(token[-2:].encode("utf-8", "replace")) % ENDINGS


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """token and n over all documents, summed in each task first."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
                if len(seen) > MEMORY:
                    yield out()
                    seen.clear()
        yield out()

    return small_batches(docs).select(text_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The PLACES most frequent tokens of the written counts that occur LEAST times or more."""
    bucket = F.floor(F.log2("n") * 8)
    sizes = sorted((r["bucket"], r["m"]) for r in counts.where(F.col("n") >= LEAST).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("m")).collect())  # 512 rows at most
    total, low = 0, 0
    while sizes and total < PLACES:
        low, m = sizes.pop()
        total += m
    # little more than PLACES rows are left for the sort, whatever the number of partitions
    some = counts.where((F.col("n") >= LEAST) & (bucket >= low))
    top = written(some.orderBy(F.desc("n"), "token").limit(PLACES), "vocabulary").collect()  # PLACES rows at most
    words = [r["token"] for r in sorted(top, key=lambda r: (-r["n"], r["token"]))]
    classes = [k if k < OWN else OWN + ending(w) for k, w in enumerate(words)] + [OWN + k for k in range(ENDINGS)]
    return Vocabulary({w: k for k, w in enumerate(words)}, np.array(classes, dtype=np.uint8))


class _Codes(dict):
    """Units of tokens, remembered for the tokens that a worker meets."""

    def __init__(self, known: dict[str, int]):
        super().__init__(known)
        self.known, self.n = known, len(known)

    def __missing__(self, token: str) -> int:
        if len(self) > self.n + MEMORY:
            self.clear()
            self.update(self.known)
        self[token] = at = self.n + ending(token)
        return at


def coded(docs: DataFrame, shared, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, units (16 bits each) and rare (token, times) of every document, written to the shared folder."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes = _Codes(shared.value.codes)
        kind = pa.list_(pa.struct([("token", pa.string()), ("times", pa.int64())]))
        for batch in batches:
            units, rare = [], []
            for text in batch.column(1):
                found = tokens(text.as_py())
                at = np.fromiter(map(codes.__getitem__, found), dtype="<u2", count=len(found))
                units.append(at.tobytes())
                others = Counter(found[k] for k in np.flatnonzero(at >= codes.n).tolist())
                rare.append([{"token": t, "times": k} for t, k in others.items()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.binary()), pa.array(rare, kind)], names=["doc_id", "units", "rare"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, units binary, rare array<struct<token: string, times: long>>")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "coded")


def _blocks(batches: Iterator, column: int) -> Iterator[tuple[list[np.ndarray], object]]:
    """The units of the documents of a batch, about BLOCK at a time, and the batch's slice they are from."""
    for batch in batches:
        at, n = 0, 0
        held: list[np.ndarray] = []
        for k, raw in enumerate(batch.column(column)):
            held.append(np.frombuffer(raw.as_buffer(), dtype="<u2"))
            n += len(held[-1])
            if n >= BLOCK or k == batch.num_rows - 1:
                yield held, batch.slice(at, len(held))
                at, n, held = k + 1, 0, []


def contexts(docs: list[np.ndarray], classes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """All units of some documents, one after another, and the class at each distance from them."""
    sizes = np.array([len(d) for d in docs])
    units = np.concatenate(docs).astype(np.int32)
    place = np.arange(len(units), dtype=np.int32) + np.repeat(FAR * np.arange(1, len(docs) + 1, dtype=np.int32), sizes)
    padded = np.full(len(units) + FAR * (len(docs) + 1), EDGE, dtype=np.uint8)
    padded[place] = classes[units]
    return units, {k: padded[place + k].astype(np.int32) for pair in PAIRS for k in pair}


def counted(rows: DataFrame, shared) -> DataFrame:
    """at and n: how often each pair of a unit and a neighbour's class, and of two neighbours' classes, occurs; over all positions of ``rows``."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        classes = shared.value.classes
        size = CLASSES * len(classes)
        sums = [np.zeros(n, dtype=np.int64) for _ in PAIRS for n in (size, size, CLASSES * CLASSES)]
        for docs, _ in _blocks(batches, 0):
            units, near = contexts(docs, classes)
            for k, (a, b) in enumerate(PAIRS):
                for s, (own, width, other) in enumerate(((a, len(classes), units), (b, len(classes), units), (a, CLASSES, near[b]))):
                    sums[3 * k + s] += np.bincount(near[own] * np.int32(width) + other, minlength=len(sums[3 * k + s]))
        first = 0
        for x in sums:
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(at + first), pa.array(x[at])], names=["at", "n"])
            first += len(x)

    # a task's counts fill up, so fewer tasks than files have fewer rows to sum
    units = rows.select("units")
    few = units.coalesce(max(1, units.rdd.getNumPartitions() // 4))
    return few.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


BESIDE = "net int, class int, left binary, right binary, pairs binary"


def gathered(cells: DataFrame, units: int) -> DataFrame:
    """The summed counts of ``counted`` as a written table: for each network and class those of all units on its right (left) and left (right), and of the classes two further."""
    size = 2 * CLASSES * units + CLASSES * CLASSES  # of one network
    inside = F.expr(f"at % {size}")
    beyond = inside - 2 * CLASSES * units
    kind = F.when(beyond >= 0, 2).otherwise(F.expr(f"(at % {size}) div {CLASSES * units}")).cast("int")
    own = F.when(beyond >= 0, F.floor(beyond / CLASSES)).otherwise(F.floor((inside % (CLASSES * units)) / units)).cast("int")
    place = F.when(beyond >= 0, beyond % CLASSES).otherwise(inside % units).cast("long")

    def dense(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rows: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            net, line, kinds, at, n = (c.to_numpy() for c in batch.columns)
            key = net * CLASSES + line
            order = np.argsort(key, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                held = rows.setdefault((int(net[some[0]]), int(line[some[0]])), [np.zeros(m, dtype=np.float32) for m in (units, units, CLASSES)])
                for k in range(3):
                    these = some[kinds[some] == k]
                    held[k][at[these]] = n[these]
        cols = [[k for k, _ in rows], [k for _, k in rows], *([r[k].tobytes() for r in rows.values()] for k in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["net", "class", "left", "right", "pairs"])

    spread = cells.select(F.expr(f"int(at div {size})").alias("net"), own.alias("class"), kind.alias("kind"), place.alias("place"), "n")
    return written(spread.repartition(TASKS, "net", "class").mapInArrow(dense, BESIDE), "beside")


def _rows(batches: Iterator) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), *(np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.float32) for c in (2, 3, 4)))


def _leading(left: np.ndarray, right: np.ndarray) -> Network:
    """Embeddings by the leading directions of the counts' pointwise mutual information, weighted by frequency; the bias is the log frequency."""
    share = left.sum(0, dtype=np.float64) + 0.5
    share /= share.sum()
    info = np.concatenate([left, right])
    often = info.sum(1, dtype=np.float64)
    for line, n in zip(info, often, strict=True):
        line[:] = np.log((line + SHRINK) / (n * share + SHRINK))
    rows, cols = np.sqrt(often / max(1.0, often.sum())), np.sqrt(share)
    info *= rows[:, None].astype(np.float32)
    info *= cols.astype(np.float32)
    values, vectors = np.linalg.eigh((info @ info.T).astype(np.float64))
    values, vectors = np.sqrt(np.maximum(values[-DIM:], 1e-12)), vectors[:, -DIM:]
    near = np.where(rows[:, None] > 0, vectors * np.sqrt(values) / np.maximum(rows, 1e-9)[:, None], 0)
    out = (info.T @ vectors) / np.sqrt(values) / cols[:, None]
    return Network(*(x.astype(np.float32) for x in (near[:CLASSES], near[CLASSES:], out, np.log(share))))


def first_networks(beside: DataFrame, units: int) -> tuple[list[Network], np.ndarray]:
    """The networks that training starts from, each made in one task from its CLASSES rows, and the counts of the units."""

    def make(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: dict[int, np.ndarray] = {}
        for net, own, left, right, _ in _rows(batches):
            held = found.setdefault(net, np.zeros((2, CLASSES, units), dtype=np.float32))
            held[0, own], held[1, own] = left, right
        parts = [(net, [x.tobytes() for x in (*_leading(*held), held[0].sum(0, dtype=np.float64))]) for net, held in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.list_(pa.binary()))], names=["net", "parts"])

    got = {r["net"]: [bytes(x) for x in r["parts"]] for r in beside.repartition("net").mapInArrow(make, "net int, parts array<binary>").collect()}  # a row a network
    if not got:
        return [], np.zeros(units)
    shapes = Network((CLASSES, DIM), (CLASSES, DIM), (units, DIM), (units,))
    nets = [Network(*(np.frombuffer(x, dtype=np.float32).reshape(s) for x, s in zip(got[k], shapes, strict=False))) for k in range(len(PAIRS))]
    return nets, np.frombuffer(got[0][-1], dtype=np.float64)


def _gradient(net: Network, own: int, left: np.ndarray, right: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, float, list[np.ndarray]]:
    """For the contexts with class ``own`` on the left: the logs of the softmaxes' sums, and this class's part of the log-likelihood and of its gradient."""
    h = net.left[own] + net.right
    p = h @ net.out.T
    p += net.bias
    top = p.max(1, keepdims=True)
    p -= top
    np.exp(p, out=p)
    sums = p.sum(1)
    log = (top[:, 0] + np.log(sums)).astype(np.float64)
    p *= (pairs / sums).astype(np.float32)[:, None]
    near = p @ net.out
    on_left, on_right = left @ net.out, right @ net.out
    fit = float(on_left @ net.left[own] + on_right @ net.right[own] + left @ net.bias - pairs @ log)
    grad = [np.zeros_like(net.left), -near, left[:, None] * net.left[own] + right[:, None] * net.right[own] - p.T @ h, left - p.sum(0)]
    grad[0][own] = on_left - near.sum(0)
    grad[1][own] += on_right
    return log, fit, grad


def gradients(beside: DataFrame, nets: list[Network]) -> tuple[list[np.ndarray], float, float, list[Network]]:
    """For each network the log of every context's softmax sum; the log-likelihoods' sum, the number of positions, and the gradient over all of them."""
    shared = beside.sparkSession.sparkContext.broadcast(nets)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        nets = shared.value
        sums: dict[int, list[np.ndarray]] = {}
        rows: list[tuple] = []
        for k, own, left, right, pairs in _rows(batches):
            log, fit, grad = _gradient(nets[k], own, left, right, pairs)
            rows.append((k, own, fit, float(pairs.sum(dtype=np.float64)), log.tobytes()))
            for total, x in zip(sums.setdefault(k, [np.zeros(x.shape) for x in nets[k]]), grad, strict=True):
                total += x
        rows += [(k, -1, 0.0, 0.0, np.concatenate([x.ravel() for x in g]).astype(np.float32).tobytes()) for k, g in sums.items()]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["net", "own", "fit", "n", "numbers"])

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column(1).to_numpy()
            yield batch.filter(pa.array(own >= 0))
            for k in np.flatnonzero(own < 0).tolist():
                x = np.frombuffer(batch.column(4)[k].as_buffer(), dtype=np.float32)
                net = batch.column(0)[k].as_py()
                sums[net] = sums[net] + x if net in sums else x.astype(np.float64)
        cols = [list(sums), [-1] * len(sums), [0.0] * len(sums), [0.0] * len(sums), [x.astype(np.float32).tobytes() for x in sums.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, batch.schema, strict=True)], names=batch.schema.names)

    # TASKS gradients a network at most are added in one task; a row a class and a gradient a network come to the driver
    kind = "net int, own int, fit double, n double, numbers binary"
    got = beside.coalesce(TASKS).mapInArrow(run, kind).repartition(1).mapInArrow(add, kind).collect()
    logs = [np.zeros((CLASSES, CLASSES)) for _ in nets]
    flat = [np.zeros(sum(x.size for x in net)) for net in nets]
    for r in got:
        if r["own"] < 0:
            flat[r["net"]] += np.frombuffer(r["numbers"], dtype=np.float32)
        else:
            logs[r["net"]][r["own"]] = np.frombuffer(r["numbers"], dtype=np.float64)
    shared.unpersist()
    parts = [np.split(f, np.cumsum([x.size for x in net])[:-1]) for f, net in zip(flat, nets, strict=True)]
    grads = [Network(*(x.reshape(y.shape) for x, y in zip(part, net, strict=True))) for part, net in zip(parts, nets, strict=True)]
    return logs, sum(r["fit"] for r in got), max(1.0, sum(r["n"] for r in got) / len(nets)), grads


def train(beside: DataFrame, nets: list[Network], steps: int = STEPS) -> tuple[list[Network], list[np.ndarray], list[float]]:
    """Networks, the logs of their softmax sums, and the networks' mean log-likelihoods of a position, summed, before each step and at the end."""
    if not nets:
        return nets, [], []
    moments = [[(np.zeros(x.shape, np.float32), np.zeros(x.shape, np.float32)) for x in net] for net in nets]
    best, history = None, []
    for step in range(steps + 1):
        logs, fit, total, grads = gradients(beside, nets)
        history.append(fit / total)
        if best is None or history[-1] > best[0]:
            best = history[-1], nets, logs
        if step == steps:
            break
        moved = []
        for net, up, held in zip(nets, grads, moments, strict=True):
            new = []
            for x, g, (one, two) in zip(net, up, held, strict=True):
                g = g / total
                one += 0.2 * (g - one)
                two += 0.05 * (g * g - two)
                scale = np.sqrt(two / (1 - 0.95 ** (step + 1))) + 1e-9
                new.append((x + RATE * (one / (1 - 0.8 ** (step + 1))) / scale).astype(np.float32))
            moved.append(Network(*new))
        nets = moved
    return best[1], best[2], history


def score(rows: DataFrame, counts: DataFrame, vocab, nets: list[Network], logs: list[np.ndarray], n_units: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum over all tokens), mean_log_prob, perplexity and n_unseen of every row of ``coded``.

    ``counts`` has the exact counts of all tokens, ``n_units`` those of the units.
    """
    places = len(vocab.value.codes)
    share = np.where(np.arange(len(n_units)) < places, 0.0, -np.log(n_units + 1.0))
    shared = rows.sparkSession.sparkContext.broadcast((nets, logs, share))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        nets, logs, share = shared.value
        size = np.int32(len(share))
        tables = [((net.left @ net.out.T).ravel(), (net.right @ net.out.T + net.bias).ravel(), log.astype(np.float32).ravel()) for net, log in zip(nets, logs, strict=True)]
        for docs, batch in _blocks(batches, 2):
            units, near = contexts(docs, vocab.value.classes)
            if not len(nets):  # no document has a token
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.zeros(len(docs), np.int64)), pa.array(np.zeros(len(docs)))], names=["row", "doc_id", "n_tokens", "log_prob"])
                continue
            parts = [lefts[near[a] * size + units] + rights[near[b] * size + units] - norm[near[a] * CLASSES + near[b]] for (a, b), (lefts, rights, norm) in zip(PAIRS, tables, strict=True)]
            p = np.logaddexp(parts[0] + np.float32(np.log(INNER)), parts[1] + np.float32(np.log(1 - INNER))) + share[units]
            n = np.array([len(d) for d in docs], dtype=np.int64)
            ends = np.cumsum(n)
            sums = np.concatenate([[0.0], np.cumsum(p, dtype=np.float64)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n), pa.array(np.where(n > 0, sums[ends] - sums[ends - n], 0.0))], names=["row", "doc_id", "n_tokens", "log_prob"])

    scored = rows.select("row", "doc_id", "units").mapInArrow(run, "row long, doc_id long, n_tokens long, log_prob double")
    met = rows.selectExpr("row as of", "inline(rare)").join(counts, "token")
    others = F.greatest((F.col("n") - F.col("times")).cast("double"), F.lit(0.5))
    more = met.groupBy("of").agg(F.sum(F.col("times") * F.log(others)).alias("more"), F.sum(F.when(F.col("n") <= F.col("times"), F.col("times")).otherwise(0)).alias("alone"))
    out = scored.join(more, F.col("row") == F.col("of"), "left")
    out = out.select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("more", F.lit(0.0))).alias("log_prob"), F.coalesce("alone", F.lit(0)).cast("long").alias("n_unseen"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"), "n_unseen")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count, train and score: doc_id, n_tokens, log_prob, mean_log_prob, perplexity and n_unseen of every document.

    n_unseen is the number of its tokens that no other document has (of those without an embedding of their own).
    Null, empty and blank texts have no tokens: log_prob 0, mean and perplexity null. Texts of any length are read
    whole. Repeated rows count as often as they occur and get equal scores, but for rounding. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    counts = written(token_counts(docs, text_col), "counts")
    vocab = spark.sparkContext.broadcast(vocabulary(counts))
    rows = coded(docs, vocab, id_col, text_col)
    units = len(vocab.value.classes)
    beside = gathered(counted(rows, vocab), units)
    nets, n_units = first_networks(beside, units)
    nets, logs, _ = train(beside, nets)
    return score(rows, counts, vocab, nets, logs, n_units)


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    """The pseudo-likelihood of every document."""
    return pseudo_likelihood(table(spark, sf_dir, "documents"))
