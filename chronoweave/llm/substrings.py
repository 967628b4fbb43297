"""Removal of passages that occur more than once, by difference-cover anchors.

D is a difference cover modulo v: any two numbers, moved on together by some
0 <= d < v, both come to residues in D. So two equal passages of `size` words,
wherever they start, have within their first v words a place that is a cover
position in both texts. Hashing windows of size - v + 1 words at cover
positions only (5 of 21 places) therefore gives every such pair an equal
anchor. Passages around anchors that repeat are then extended: each window of
`size` words over them is hashed in 95 bits, and those that repeat are the
repeated passages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoweave.llm.session import ship, worker_cache
from chronoweave.llm.tokens import chunks

#: Perfect difference sets, period to residues.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}

_MOST_KNOWN = 700_000  # words whose hashes a worker keeps
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def period(size: int) -> int:
    """The largest period whose anchors have two fifths of a window's words; shorter ones repeat by chance. 0: there is none."""
    return max((v for v in COVERS if size - v + 1 >= 0.4 * size), default=0)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    known: dict[bytes, int] = worker_cache("words", dict)
    if len(known) > _MOST_KNOWN:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    except KeyError:
        for w in ws:
            if w not in known:
                known[w] = xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


@cache
def _powers(base: int, log: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def window_hashes(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of size words; which chooses one of two independent ones."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(_ODD[which], max(10, n.bit_length()))
    x = words if not which else _mixed(words)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[:n])])
    return _mixed((total[size:] - total[:-size]) * down[: n - size + 1])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _dealt(h: np.ndarray, extra: np.ndarray, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns h and tag of the rows to deal out, from those of one chunk of texts.

    tag packs extra (31 bits more of the hash), place and whether the row is
    known to repeat. Of the rows that share h and extra within the chunk only the
    first keeps them; all are marked as known, and the others get an h of their
    own. So a passage of very many texts comes to the task of its hash once for
    each chunk.
    """
    order = np.lexsort((extra, h))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (extra[order][1:] == extra[order][:-1])
    again, known = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order], known[order] = same[:-1], same[:-1] | same[1:]
    own = _mixed(text.view(np.uint64) ^ _mixed(place.astype(np.uint64) + np.uint64(1)))
    return np.where(again, own, h).view(np.int64), extra.astype(np.int64) << 32 | place.astype(np.int64) << 1 | known


def _repeated(dealt: DataFrame, places: list[str]) -> DataFrame:
    """places and at of the rows of dealt (h, tag, places) that are known to repeat or whose hashes do.

    Rows come sorted by hash, so one row is held at a time.
    """
    kinds = ", ".join(f"{p} long" for p in places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, and whether it is known to repeat
        held_found = False

        def out(rows: pa.RecordBatch, found: np.ndarray) -> pa.RecordBatch:
            at = (rows.column(1).to_numpy() & 0xFFFFFFFF) >> 1
            cols = [*(rows.column(2 + i) for i in range(len(places))), pa.array(at.astype(np.int32))]
            return pa.RecordBatch.from_arrays(cols, [*places, "at"]).filter(pa.array(found))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            h, tag = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            same = (h[1:] == h[:-1]) & (tag[1:] >> 32 == tag[:-1] >> 32)
            found = tag & 1 == 1
            if held is not None:
                found[0] = held_found
            found[1:] |= same
            found[:-1] |= same
            held, held_found = rows.slice(rows.num_rows - 1), bool(found[-1])
            yield out(rows.slice(0, rows.num_rows - 1), found[:-1])
        if held is not None:
            yield out(held, np.array([held_found]))

    ordered = dealt.repartition("h").sortWithinPartitions("h", "tag").select("h", "tag", *places)
    return ordered.mapInArrow(run, f"{kinds}, at int")


def remove_repeats(docs: DataFrame, size: int = 35, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, spans (and kept, the text that stays) of each row of docs.

    Words split at ASCII white space. A word goes if a window of `size` words
    covers it whose words also start anywhere else, in this text or another, as
    the texts were given. spans: (first word, words) that go. Null texts have no
    words; texts shorter than a window keep all.

    Equal texts are counted by two 64-bit hashes and only one of them is
    searched; a text that occurs twice goes whole if it is long enough. The
    texts are shuffled once, by those hashes; anchors, windows and counts are
    rows of numbers.
    """
    v = period(size)
    if not v:
        raise ValueError(f"windows of {size} words are too short for a cover")
    ship(docs.sparkSession)
    cover, length = np.zeros(v, bool), size - v + 1
    cover[list(COVERS[v])] = True
    body = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2"), body.alias("text"))
    counts = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("key").alias("one"))

    def joined(right: DataFrame) -> DataFrame:
        """rows with right, a row at most for each text; the shuffled texts are the same for every use."""
        return rows.join(right.hint("shuffle_hash"), ["k1", "k2"]).select("key", "k1", "k2", "text", *[c for c in right.columns if c not in ("k1", "k2")])

    def only_one(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows whose key (fourth column) is the one that stands for its text (fifth). Told here, for in the join it would be a key of its own and the texts would be shuffled again."""
        same = [a == b for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        return batch.filter(pa.array(same, pa.bool_()))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = only_one(batch)
            k1s = batch.column(0).to_numpy()
            for first, texts in chunks(batch, 2):
                hs, ks, ps = [], [], []
                for k1, t in zip(k1s[first : first + len(texts)].tolist(), texts, strict=True):
                    ws = t.split()
                    if len(ws) < size:
                        continue
                    h = window_hashes(word_hashes(ws), length)
                    p = np.nonzero(np.resize(cover, len(h)))[0]
                    hs.append(h[p])
                    ps.append(p)
                    ks.append(np.full(len(p), k1, np.int64))
                if hs:
                    k = np.concatenate(ks)
                    h, p = np.concatenate(hs), np.concatenate(ps)
                    h, tag = _dealt(h, np.zeros(len(h), np.int64), k, p)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(tag), pa.array(k)], ["h", "tag", "k1"])

    searched = joined(counts).select("k1", "k2", "text", "key", "one")
    marks = _repeated(searched.mapInArrow(anchors, "h long, tag long, k1 long"), ["k1"])
    marked = marks.groupBy("k1").agg(F.collect_set("at").alias("marks"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = only_one(batch)
            k1s, k2s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in chunks(batch, 2):
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for r, t in enumerate(texts, first):
                    ws = t.split()
                    if len(ws) < size:
                        continue
                    p = batch.column(5)[r].values.to_numpy()
                    p = p[p <= len(ws) - length]
                    n = len(ws) - size + 1
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.clip(p - v + 1, 0, n), 1)
                    np.add.at(edge, np.clip(p + 1, 0, n), -1)
                    s = np.nonzero(np.cumsum(edge[:-1]))[0]
                    h = word_hashes(ws)
                    for c, x in zip(cols, (window_hashes(h, size)[s], window_hashes(h, size, 1)[s], np.full(len(s), k1s[r], np.int64), np.full(len(s), k2s[r], np.int64), s), strict=True):
                        c.append(x)
                if cols[0]:
                    a, b, k1, k2, s = map(np.concatenate, cols)
                    h, tag = _dealt(a, (b >> np.uint64(33)).astype(np.int64), k1, s)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(tag), pa.array(k1), pa.array(k2)], ["h", "tag", "k1", "k2"])

    near = joined(counts.join(marked, "k1").select("k1", "k2", "one", "marks")).select("k1", "k2", "text", "key", "one", "marks")
    again = _repeated(near.mapInArrow(windows, "h long, tag long, k1 long, k2 long"), ["k1", "k2"])
    starts = again.groupBy("k1", "k2").agg(F.collect_set("at").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns = batch.column(2).to_numpy()
            for first, texts in chunks(batch, 1):
                out: list[list] = [[], [], [], [], []]
                for r, t in enumerate(texts, first):
                    ws = t.split()
                    gone = np.zeros(len(ws) + 1, bool)
                    s = batch.column(3)[r]
                    if ns[r] > 1 and len(ws) >= size:
                        gone[:-1] = True
                    elif s.is_valid and len(s):
                        edge = np.zeros(len(ws) + 1, np.int64)
                        at = s.values.to_numpy()
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + size, -1)
                        gone = np.cumsum(edge) > 0
                    edges = np.nonzero(np.diff(np.concatenate([[False], gone])))[0].tolist()
                    spans = list(zip(edges[::2], edges[1::2], strict=True))
                    keep, at = [], 0
                    for a, b in spans:
                        keep += ws[at:a]
                        at = b
                    left = b" ".join(keep + ws[at:])
                    for c, x in zip(out, (len(ws), sum(b - a for a, b in spans), hashlib.sha256(left).hexdigest(), [{"first": a, "words": b - a} for a, b in spans], left.decode()), strict=True):
                        c.append(x)
                arrays = [batch.column(0).slice(first, len(texts)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2]), pa.array(out[3], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))]
                names = [key, "n_words", "n_removed", "kept_sha256", "spans"]
                if with_text:
                    arrays, names = [*arrays, pa.array(out[4])], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    whole = joined(counts.join(starts, ["k1", "k2"], "left").select("k1", "k2", "n", "starts")).select("key", "text", "n", "starts")
    schema = f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, words: long>>" + (", kept string" if with_text else "")
    return whole.mapInArrow(cut, schema)
