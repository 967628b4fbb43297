"""Token ids of texts: tokenising with a word cache, and token files in PFOR blocks.

The vocabulary file's path is a parameter; executors read it themselves, so it
must be a path that every machine has.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from chronoweave.llm.session import new_folder, ship, shuffle_partitions, worker_cache, write_shared


class Encoder:
    """Ids of a text as little-endian 32-bit integers, equal to the library's encode().ids.

    ASCII white space never lies inside a token of a vocabulary whose
    pre-tokenizer drops white space, so each stretch between white space has the
    ids it has in the text. They are kept for the next time, `most` of them at
    most; special-token strings hold no white space and go the same way. Where
    `plain` (a vocabulary of lower case that splits words from punctuation) and
    a text holds no special token, ASCII capitals and a full stop or comma at
    the end of a word are set aside first, so more stretches are alike.
    """

    _mark = re.compile(rb"([.,])(?<=[a-z].)(?=\s|\Z)")

    def __init__(self, path: str, most: int = 1_100_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known = _Known(self.tokenizer)
        self.plain = self._ids("Ab, Cd. Ef") == [i for w in ("ab", ",", "cd", ".", "ef") for i in self._ids(w)]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known.clear()
        find, out = self.known.__getitem__, []
        for t in texts:
            if self.plain and b"<|" not in t:
                t = self._mark.sub(rb" \1", t.lower())
            out.append(b"".join(map(find, t.split())))
        return out


class _Known(dict):
    """Ids of stretches seen so far; others are encoded when they are first looked up."""

    def __init__(self, tokenizer) -> None:
        self.encode = tokenizer.encode

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = array("I", self.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        return ids


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return worker_cache(("encoder", path), lambda: Encoder(path))


def chunks(batch: pa.RecordBatch, column: int, size: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8, null as empty) of a batch, about `size` bytes at a time."""
    found = batch.column(column).cast(pa.large_binary())
    first, texts, n = 0, [], 0
    for i, x in enumerate(found):
        texts.append(x.as_py() or b"")
        n += len(texts[-1])
        if n >= size:
            yield first, texts
            first, texts, n = i + 1, [], 0
    if texts:
        yield first, texts


# --- PFOR blocks -------------------------------------------------------------------------------------------------------

#: Fixed values of the block format: a header holds minimum, values, exceptions (unsigned 32-bit) and bits of each value (unsigned 8-bit).
_HEADER = struct.Struct("<IIIB")


def pack_block(values: np.ndarray, percentile: float) -> bytes:
    """A block: header, packed offsets from the minimum, places and high parts of the exceptions.

    The width is that of the given percentile of the offsets. Larger offsets
    keep their low bits in place; their high bits go to the exception list.
    """
    v = np.asarray(values, np.uint64)
    low = int(v.min()) if len(v) else 0
    off = v - np.uint64(low)
    at = np.sort(off)[min(len(off) - 1, int(np.ceil(percentile * len(off))) - 1)] if len(off) else 0
    bits = int(at).bit_length()
    over = np.nonzero(off >> np.uint64(bits))[0]
    planes = ((off[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    packed = np.packbits(planes.ravel(), bitorder="little").tobytes()
    tail = over.astype("<u4").tobytes() + (off[over] >> np.uint64(bits)).astype("<u4").tobytes()
    return _HEADER.pack(low, len(v), len(over), bits) + packed + tail


def unpack_block(data: bytes | memoryview) -> np.ndarray:
    low, n, n_over, bits = _HEADER.unpack_from(data)
    end = _HEADER.size + (n * bits + 7) // 8
    planes = np.unpackbits(np.frombuffer(data[_HEADER.size : end], np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    off = planes.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)) if bits else np.zeros(n, np.uint64)
    over = np.frombuffer(data[end : end + 4 * n_over], "<u4")
    high = np.frombuffer(data[end + 4 * n_over : end + 8 * n_over], "<u4")
    off[over] |= high.astype(np.uint64) << np.uint64(bits)
    return (off + np.uint64(low)).astype("<u4")


def pack_blocks(values: np.ndarray, block: int, percentile: float) -> tuple[bytes, list[int]]:
    """All blocks after another, and the byte where each starts."""
    parts, starts, at = [], [], 0
    for i in range(0, len(values), block):
        parts.append(pack_block(values[i : i + block], percentile))
        starts.append(at)
        at += len(parts[-1])
    return b"".join(parts), starts


def unpack_blocks(payload: bytes, starts: list[int], first: int = 0, last: int | None = None) -> np.ndarray:
    """Values of the blocks first to last (not included); the index finds them without reading the others."""
    ends = [*starts[1:], len(payload)] if starts else []
    view = memoryview(payload)
    parts = [unpack_block(view[a:b]) for a, b in list(zip(starts, ends, strict=True))[first:last]]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


_SEGMENT = "shard int, segment int, n_docs int, n_tokens long, block int, starts array<long>, lengths array<long>, payload binary"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    block: int = 1024,
    percentile: float = 0.9,
    segment_tokens: int = 65_536,
) -> None:
    """Write the ids of all texts, each with end_id after it, to path in ascending order of key (nulls first).

    A range shuffle on (key, row number) deals out the rows, so a repeated key
    doesn't fill one task. Each task writes one shard: rows of whole documents
    with their keys, their lengths and the PFOR blocks of their ids, with the
    byte where each block starts. The container is Parquet, so that Spark's own
    committer makes a retried task harmless and any store will do. Null texts
    count as empty; a document of no ids is its end id alone.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType
    out = T.StructType([*T._parse_datatype_string(_SEGMENT).fields, T.StructField("keys", T.ArrayType(kind))])
    keys_type = pa.list_(_arrow_type(kind))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment, found = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        keys: list = []
        ids: list[bytes] = []
        n = 0

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(ids), "<u4")
            payload, starts = pack_blocks(values, block, percentile)
            row = [shard, segment, len(keys), len(values), block, starts, [len(x) // 4 for x in ids], payload]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array([x], t) for x, t in zip(row, types, strict=True)] + [pa.array([keys], keys_type)]
            return pa.RecordBatch.from_arrays(arrays, [f.name for f in out.fields])

        for batch in batches:
            for first, texts in chunks(batch, 1):
                own = batch.column(0).slice(first, len(texts)).to_pylist()
                for k, x in zip(own, found.encode(texts), strict=True):
                    keys.append(k)
                    ids.append(x + end)
                    n += len(x) // 4 + 1
                    if n >= segment_tokens:
                        yield flush()
                        segment, keys, ids, n = segment + 1, [], [], 0
        if keys:
            yield flush()

    numbered = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    sorted_ = numbered.repartitionByRange(shuffle_partitions(spark), "key", "row").sortWithinPartitions("key", "row")
    sorted_.select("key", "text").mapInArrow(encode, out).write.parquet(path)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_tokens(spark, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """key, start, n_tokens, ids_crc32 and ids (array of long; left out unless asked for) of each document in the files.

    start counts the ids before a document in the whole corpus. Shards follow
    each other in order; their counts (one row for each shard) are summed in a
    window, all else stays in its task.
    """
    ship(spark)
    read = spark.read.parquet(path)
    kind = read.schema["keys"].dataType.elementType
    fields = [T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField(key, kind)]
    fields += [T.StructField(x, T.LongType()) for x in ("within", "n_tokens", "ids_crc32")]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    key_type = _arrow_type(kind)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                shard, segment, starts, lengths, payload, keys = (batch.column(i)[r].as_py() for i in range(6))
                values = unpack_blocks(payload, starts)
                ends = np.cumsum(lengths)
                within = ends - lengths
                view = memoryview(values.astype("<u4").tobytes())
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(within, ends, strict=True)]
                arrays = [pa.array([shard] * len(keys), pa.int32()), pa.array([segment] * len(keys), pa.int32()), pa.array(keys, key_type), pa.array(within, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(values.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    rows = read.select("shard", "segment", "starts", "lengths", "payload", "keys").mapInArrow(decode, T.StructType(fields))
    # Both small: rows of segments meet by shard, rows of shards (as many as tasks wrote) in one window.
    segments = read.select("shard", "segment", "n_tokens")
    per_shard = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = per_shard.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = segments.withColumn("own", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(before, "shard")
    at = placed.select("shard", "segment", (F.col("base") + F.col("own")).cast("long").alias("first"))
    out = rows.join(at, ["shard", "segment"]).withColumn("start", F.col("first") + F.col("within"))
    return out.select(key, "start", "n_tokens", "ids_crc32", *(["ids"] if ids else []))


# --- packing -----------------------------------------------------------------------------------------------------------


def pieces(
    docs: DataFrame,
    tokenizer: str,
    most: int = 2048,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most `most` ids: key, piece, start, length, ids_crc32, part, nth (and ids).

    Only documents with more ids are cut, each piece but the last full. nth
    numbers the pieces of one length within the task that made them (part). The
    rows are written to the shared folder, so part and nth are fixed from then on.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), *T._parse_datatype_string("piece int, start long, length long, ids_crc32 long, part int, nth long").fields])
    if with_ids:
        out.add("ids", T.ArrayType(T.LongType()))
    key_type = _arrow_type(kind)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, found, seen = TaskContext.get().partitionId(), encoder(tokenizer), [0] * (most + 1)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for first, texts in chunks(batch, 1):
                keys, rows = batch.column(0).slice(first, len(texts)), []
                for r, x in enumerate(found.encode(texts)):
                    x += end
                    for p, at in enumerate(range(0, len(x), 4 * most)):
                        own = x[at : at + 4 * most]
                        n = len(own) // 4
                        rows.append((r, p, at // 4, n, zlib.crc32(own), part, seen[n], own))
                        seen[n] += 1
                cols = list(zip(*rows, strict=True))
                arrays = [keys.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(cols[i], pa.int64()) for i in (2, 3, 4)), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64())]
                if with_ids:
                    flat = np.frombuffer(b"".join(cols[7]), "<u4").astype(np.int64)
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *cols[3]]), pa.int32()), pa.array(flat)))
                arrays[0] = arrays[0].cast(key_type)
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in out.fields])

    return write_shared(docs.select(key, text).mapInArrow(cut, out), "pieces")


def plan_sequences(
    counts: dict[int, int],
    most: int,
    most_docs: int | None = None,
    most_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    rule: str = "dot",
) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best fit over the kinds of piece: (length, from, to, per bin, first bin, offset).

    A piece of n ids has the demands n ids, one document and n * n attention
    cost, so pieces of one length are one kind and bins filled alike are one
    group; the plan's size depends on the number of lengths, not of pieces.
    Longest first, a kind goes to the open group that scores best among those
    that hold it under all three capacities. rule "dot": the smallest weighted
    dot product of demand and residual, each as a share of its capacity, so the
    fullest where it matters to this kind; "norm": the smallest weighted norm of
    the residual that stays. What fits nowhere opens new bins.
    """
    most_docs, most_cost = most_docs or most, most_cost or float(most) * most
    cap = np.array([most, most_docs, most_cost], float)
    w = np.asarray(weights, float)
    groups: dict[tuple[int, int, float], list[tuple[int, int]]] = {}  # (ids, documents, cost) used -> [(first bin, bins)]
    plan, bins = [], 0
    for n in sorted((n for n, c in counts.items() if c), reverse=True):
        if n > most or n * n > most_cost:
            raise ValueError(f"a piece of {n} ids fits in no sequence")
        demand = np.array([n, 1, float(n) * n])
        order, holds = [], []
        if groups:
            states = list(groups)
            left = cap - np.array(states, float)
            room = (left // demand).min(axis=1).astype(int)
            if rule == "dot":
                scores = (left / cap) @ (w * demand / cap)
            else:
                scores = ((left - demand) / cap) ** 2 @ w
            able = np.nonzero(room > 0)[0]
            able = able[np.lexsort((able, scores[able]))]
            order, holds = [states[i] for i in able], room[able].tolist()
        todo, placed = counts[n], 0
        mine: list[tuple[tuple[int, int, float], int, int]] = []

        def put(used: tuple, first: int, count: int, per: int, n: int = n, mine: list = mine) -> None:
            mine.append(((used[0] + per * n, used[1] + per, used[2] + float(per) * n * n), first, count))

        for k in range(len(order) + 1):
            if not todo:
                break
            if k < len(order):
                used, per = order[k], holds[k]
                spans = groups.pop(used)
            else:
                per = int((cap // demand).min())
                used, spans = (0, 0, 0.0), [(bins, -(-todo // per))]
                bins += spans[0][1]
            for first, count in spans:
                full = min(count, todo // per)
                if full:
                    plan.append((n, placed, placed + full * per, per, first, used[0]))
                    put(used, first, full, per)
                    placed, todo = placed + full * per, todo - full * per
                if full < count and todo:
                    plan.append((n, placed, placed + todo, todo, first + full, used[0]))
                    put(used, first + full, 1, todo)
                    placed, todo, full = placed + todo, 0, full + 1
                if full < count:
                    groups.setdefault(used, []).append((first + full, count - full))
        for used, first, count in mine:
            groups.setdefault(used, []).append((first, count))
    return plan


def pack(
    docs: DataFrame,
    tokenizer: str,
    most: int = 2048,
    end_id: int = 0,
    most_docs: int | None = None,
    most_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0),
    rule: str = "dot",
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Place the pieces of all documents in sequences: key, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The driver sees counts by length (`most` numbers) and plans with them; the
    pieces themselves find their place by their rank within their length, which
    is nth plus the counts of the parts before. Null texts are documents of
    their end id alone, repeated rows are documents like others.
    """
    spark = docs.sparkSession
    rows = pieces(docs, tokenizer, most, end_id, key, text, with_ids)
    per_part = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_sequences(counts, most, most_docs, most_cost, weights, rule)
    # Some rows for each of `most` lengths: a bound that doesn't grow with the input.
    table = spark.createDataFrame(plan, "length long, lo long, hi long, per long, first long, at long")
    starts = per_part.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rows.join(starts, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    p = table.withColumnRenamed("length", "of")
    placed = ranked.join(F.broadcast(p), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(nth, F.col("per")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from pack(with_ids=True). A group holds `most` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"))


def tokens_table(docs: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", ids: bool = True, **more) -> DataFrame:
    """Write docs with write_tokens to the shared folder and read them back."""
    path = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id, key, text, **more)
    return read_tokens(docs.sparkSession, path, key, ids)


