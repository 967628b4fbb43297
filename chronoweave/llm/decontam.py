"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. A pattern is a window of consecutive item words. For all
patterns of one length m a shift table says, for each block of `block` words,
how far the search may move on when the block ends at the place looked at;
blocks of no pattern allow m - block + 1. Where the shift is 0, the patterns
that end in the block, found under the hash of that suffix and of their first
block, are compared with the text word for word.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from chronoweave.llm.session import free_name, ship
from chronoweave.llm.tokens import chunks

#: Bytes of words (digits, letters, all of UTF-8's multi-byte characters); the rest separates; A-Z are lower-cased.
_LOWER = bytes(ord(" ") if not (c >= 0x80 or chr(c).isalnum()) else c + 32 if chr(c).isupper() and c < 0x80 else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class WuManber:
    """Finds word sequences of any lengths; each length has tables of its own."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int], block: int = 3) -> None:
        by_length: dict[int, list[tuple[tuple[bytes, ...], int]]] = {}
        for p, number in patterns.items():
            by_length.setdefault(len(p), []).append((p, number))
        self.tables = []
        for m, own in sorted(by_length.items()):
            b = min(block, m)
            shift: dict = {}
            ends: dict = {}
            for p, number in own:
                for at in range(b, m + 1):
                    key = p[at - b : at]
                    shift[key] = min(shift.get(key, m), m - at)
                ends.setdefault(p[m - b :], {}).setdefault(p[:b], []).append((p, number))
            self.tables.append((m, b, shift, ends))

    def find(self, ws: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, words, pattern number) of every occurrence."""
        found, n = [], len(ws)
        for m, b, shift, ends in self.tables:
            most, at, get = m - b + 1, m, shift.get
            while at <= n:
                step = get(tuple(ws[at - b : at]), most)
                if step:
                    at += step
                    continue
                first = at - m
                for p, number in ends[tuple(ws[at - b : at])].get(tuple(ws[first : first + b]), ()):
                    if p == tuple(ws[first:at]):
                        found.append((first, m, number))
                at += 1
        return found


def windows(text: bytes, size: int) -> list[tuple[bytes, ...]]:
    ws = words(text)
    return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    most_bytes: int = 16 << 20,
) -> tuple[DataFrame, str]:
    """docs with one more column (and its name): struct n_words, n_hit, items, spans.

    items: ids, as distinct strings in order, of the items with a window that
    occurs (null ids are left out; their windows count). spans: (first word,
    words) of the stretches that windows cover. Null texts have no words; items
    of none have no windows.

    The items are a query set and go to every task. Their size is summed first:
    beyond most_bytes they are dealt into blocks by hash, one search after
    another over the same rows, so no broadcast is larger than a block (an item
    is in one block whole).
    """
    spark = docs.sparkSession
    ship(spark)
    wanted = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // most_bytes))
    name = free_name(docs, "found")
    kind = T._parse_datatype_string("n_words long, n_hit long, items array<string>, spans array<struct<first: long, words: long>>")
    out, at = docs, len(docs.columns)
    place = docs.columns.index(text)
    for k in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k) if blocks > 1 else wanted
        patterns: dict[tuple[bytes, ...], set[str | None]] = {}
        for r in some.toLocalIterator():
            for w in windows(r["text"].encode(), window):
                patterns.setdefault(w, set()).add(r["id"])
        owners = [sorted(x for x in ids if x is not None) for ids in patterns.values()]
        sent = spark.sparkContext.broadcast((WuManber({p: i for i, p in enumerate(patterns)}), owners))

        def run(batches: Iterator[pa.RecordBatch], sent=sent, k: int = k) -> Iterator[pa.RecordBatch]:
            machine, owners = sent.value
            for batch in batches:
                for first, texts in chunks(batch, place):
                    part = batch.slice(first, len(texts))
                    before = part.column(at).to_pylist() if k else [None] * len(texts)
                    rows = []
                    for t, old in zip(texts, before, strict=True):
                        ws = words(t)
                        spans = [(s["first"], s["words"]) for s in old["spans"]] if old else []
                        items = set(old["items"]) if old else set()
                        for i, n, number in machine.find(ws):
                            spans.append((i, n))
                            items.update(owners[number])
                        spans = _merged(spans)
                        rows.append({"n_words": len(ws), "n_hit": sum(n for _, n in spans), "items": sorted(items), "spans": [{"first": i, "words": n} for i, n in spans]})
                    struct = pa.array(rows, _STRUCT)
                    cols = part.columns[:at] + [struct]
                    yield pa.RecordBatch.from_arrays(cols, [*part.schema.names[:at], name])

        schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
        out = out.mapInArrow(run, schema)
    return out, name


_STRUCT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of (first, words) stretches, as separate stretches in order."""
    out: list[list[int]] = []
    for i, n in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1][1] = max(out[-1][1], i + n)
        else:
            out.append([i, i + n])
    return [(a, b - a) for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, with their columns, in which no benchmark window occurs."""
    found, name = search(docs, benchmark, **how)
    return found.where(F.col(name)["n_hit"] == 0).select(*docs.columns)
