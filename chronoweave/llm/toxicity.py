"""Toxicity: a factorization machine over hashed terms.

score(x) = sigmoid(w0 + sum_i x_i w_i + sum_{i<j} x_i x_j <v_i, v_j>) over the
hashed terms in a text: words, and the first letters of words, which inflected
forms share. The pair term lets two terms mean more together than alone.

Every term that enough rows of the sample have gets a weight and factors, also
those that mean nothing alone. Their values differ: a term whose share of toxic
rows differs from the rest beyond chance counts 1, and the others share a fixed
length between them, so a long text is no stronger than a short one. The machine
is fitted to a bounded sample of the training rows; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from chronoweave.llm.decontam import words
from chronoweave.llm.session import free_name, ship, worker_cache, write_shared
from chronoweave.llm.tokens import chunks

_MOST_KNOWN = 300_000  # words whose terms a worker keeps
#: Lengths in bytes of the word beginnings that are terms too.
PREFIXES = (3, 4, 5, 6)


def terms(text: bytes, buckets: int) -> set[int]:
    """Buckets of the terms of a text."""
    from xxhash import xxh32_intdigest

    known: dict[bytes, tuple[int, ...]] = worker_cache(("terms", buckets), dict)
    if len(known) > _MOST_KNOWN:
        known.clear()
    out: set[int] = set()
    for w in set(words(text)):
        own = known.get(w)
        if own is None:
            own = known[w] = (xxh32_intdigest(w, 1) % buckets, *(xxh32_intdigest(w[:n], 1 + n) % buckets for n in PREFIXES if len(w) > n))
        out.update(own)
    return out


@dataclass
class Machine:
    """w0, and weights and factors of the terms it knows; place[b] is a bucket's row, -1 for one it doesn't know."""

    buckets: int
    place: np.ndarray
    w0: float
    marked: np.ndarray
    w: np.ndarray
    v: np.ndarray
    rest: float

    def score(self, slots: set[int]) -> float:
        rows = self.place[np.fromiter(slots, np.int64, len(slots))]
        rows = rows[rows >= 0]
        x = term_values(self.marked[rows], self.rest)
        return float(1 / (1 + np.exp(-_raw(self.w0, self.w[rows], self.v[rows], x))))


def term_values(marked: np.ndarray, rest: float) -> np.ndarray:
    """1 for marked terms; the others have the length `rest` together."""
    return np.where(marked, 1.0, rest / np.sqrt(max(1, int((~marked).sum())))).astype(np.float32)


def _raw(w0: float, w: np.ndarray, v: np.ndarray, x: np.ndarray) -> float:
    vx = v * x[:, None]
    s = vx.sum(0)
    return float(np.clip(w0 + x @ w + 0.5 * (s @ s - (vx * vx).sum()), -30, 30))


def marked_terms(rows: list[np.ndarray], labels: np.ndarray, buckets: int, least_seen: int, least_z: float) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the terms that least_seen rows have, and which of them are marked.

    Marked: among its rows the share of label 1 is least_z standard deviations
    or more from that of all rows.
    """
    seen = np.zeros((2, buckets), np.int64)
    for x, y in zip(rows, labels, strict=True):
        seen[y, x] += 1
    both = seen.sum(0)
    known = np.nonzero(both >= least_seen)[0]
    p = labels.mean()
    z = np.abs(seen[1, known] - both[known] * p) / np.sqrt(both[known] * p * (1 - p))
    return known, z >= least_z


def fit_rows(
    rows: list[np.ndarray], labels: np.ndarray, marked: np.ndarray, factors: int, least_steps: int, rate: float, decay: float, rest: float, seed: int
) -> tuple[float, np.ndarray, np.ndarray]:
    """w0, w, v by AdaGrad on log loss over rows of known terms: 3 to 60 passes, for least_steps steps if that allows."""
    rng, n = np.random.default_rng(seed), len(marked)
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.02, (n, factors)).astype(np.float32)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    w0 = float(np.log(share / (1 - share)))
    g0, gw, gv = 1.0, np.ones(n, np.float32), np.ones((n, factors), np.float32)
    for _ in range(min(60, max(3, -(-least_steps // max(1, len(rows)))))):
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x, wr, vr = term_values(marked[r], rest), w[r], v[r]
            d = 1 / (1 + np.exp(-_raw(w0, wr, vr, x))) - labels[i]
            vx = vr * x[:, None]
            dw, dv = d * x + decay * wr, d * x[:, None] * (vx.sum(0) - vx) + decay * vr
            g0 += d * d
            w0 -= rate * d / np.sqrt(g0)
            gw[r] = a = gw[r] + dw * dw
            w[r] = wr - rate * dw / np.sqrt(a)
            gv[r] = a = gv[r] + dv * dv
            v[r] = vr - rate * dv / np.sqrt(a)
    return w0, w, v


def fit(
    labelled: DataFrame,
    text: str = "text",
    label: str = "toxic",
    buckets: int = 1 << 18,
    most_rows: int = 8_000,
    least_seen: int = 5,
    least_z: float = 4.0,
    factors: int = 4,
    least_steps: int = 40_000,
    rate: float = 0.3,
    decay: float = 1e-4,
    rest: float = 0.3,
    seed: int = 7,
) -> Machine:
    """Learn from the rows of labelled (text and label 0 or 1; others are left out).

    The fit sees at most about most_rows different texts of each label, taken by a
    hash of the texts, and runs in one task: a bound that doesn't grow with the
    input, nor do the terms it counts there. The share of label 1 is that of all
    rows. With no rows or one label only, the machine gives that label's share for
    every text.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n = totals.get(1, 0), sum(totals.values())
    empty = Machine(buckets, np.full(buckets, -1, np.int32), float(np.log((n1 + 1) / (n - n1 + 1))), np.zeros(0, bool), np.zeros(0, np.float32), np.zeros((0, factors), np.float32), rest)
    if not n1 or n1 == n:
        return empty
    cut = F.when(F.col("y") == 1, min(1.0, most_rows / n1)).otherwise(min(1.0, most_rows / (n - n1)))
    sample = rows.withColumn("o", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed))).where(F.pmod("o", F.lit(1_000_000)) < cut * 1_000_000)

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch, 0):
                xs = [np.sort(np.fromiter(terms(t, buckets), np.int32)) for t in texts]
                x = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate(xs), pa.int32()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([x, part.column(1), part.column(2)], ["x", "y", "o"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ys = [], []
        for batch in batches:
            own += [x.values.to_numpy() for x in batch.column(0)]
            ys += batch.column(1).to_pylist()
        labels = np.array(ys, np.int64)
        if len({*ys}) < 2:
            return
        known, marked = marked_terms(own, labels, buckets, least_seen, least_z)
        place = np.full(buckets, -1, np.int32)
        place[known] = np.arange(len(known))
        own = [r[r >= 0] for r in (place[x] for x in own)]
        w0, w, v = fit_rows(own, labels, marked, factors, least_steps, rate, decay, rest, seed)
        kept = labels.mean()  # rows dealt by label share: weigh the intercept back to the corpus
        w0 += np.log(n1 / (n - n1)) - np.log(kept / (1 - kept))
        yield pa.RecordBatch.from_arrays([pa.array([w0]), *(pa.array([c.tobytes()], pa.binary()) for c in (place, marked, w, v))], ["w0", "place", "marked", "w", "v"])

    # a text and label once, so that a crowd of copies stays within the bound
    bounded = sample.dropDuplicates(["o", "y"]).select("text", "y", "o").mapInArrow(terms_of, "x array<int>, y int, o long")
    one = bounded.repartitionByRange(1, "o").sortWithinPartitions("o", "y").select("x", "y")
    r = one.mapInArrow(learn, "w0 double, place binary, marked binary, w binary, v binary").first()
    if r is None:
        return empty
    w, v = np.frombuffer(r["w"], np.float32), np.frombuffer(r["v"], np.float32).reshape(-1, factors)
    return Machine(buckets, np.frombuffer(r["place"], np.int32), r["w0"], np.frombuffer(r["marked"], bool), w, v, rest)


def score(docs: DataFrame, machine: Machine, text: str = "text") -> tuple[DataFrame, str]:
    """docs with one more column (and its name): the score in (0, 1) of each whole text. Null texts score as empty ones.

    The machine that goes to the tasks has a size fixed by its buckets and terms.
    """
    spark = docs.sparkSession
    ship(spark)
    name = free_name(docs, "score")
    place = docs.columns.index(text)
    sent = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            scores = [own.score(terms(t, own.buckets)) for _, texts in chunks(batch, place) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])), name


def held_out(key: Column) -> Column:
    """Rows whose labels no model may learn: crc32 of the key as text leaves 2 modulo 4."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_sent: int = 1_000_000) -> DataFrame:
    """text and label of the labelled rows that are not held out. Keys that are null or without a label give none.

    Up to most_sent labels (two numbers each) are sent to the tasks; more are
    joined by a shuffle of both sides, whose result is written once.
    """
    own = labels.select(F.col(key).alias("key"), F.col(label).alias(label)).where(F.col("key").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("key")))
    few = own.limit(most_sent + 1).count() <= most_sent
    found = docs.select(F.col(key).alias("key"), F.col(text).alias(text)).join(F.broadcast(own) if few else own, "key").select(text, label)
    return found if few else write_shared(found, "training")
