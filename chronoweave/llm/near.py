"""Near-duplicates: SimHash fingerprints joined on Golay-code keys, and texts that share most of their word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoweave.llm import golay
from chronoweave.llm.components import components
from chronoweave.llm.session import ship, shuffle_partitions, write_shared
from chronoweave.llm.tokens import chunks


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, in order, repeats included.

    A-Z are lower-cased, words split at ASCII white space. Fewer words are one
    shingle, no words none.
    """
    from xxhash import xxh64_intdigest

    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    line = b" ".join(ws)
    if len(ws) <= words:
        return np.array([xxh64_intdigest(line, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
    starts = [0, *ends[: len(ws) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """Fingerprint of a text: the bits set in over half the hashes of its shingles; of none, 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[i : i + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(2 * counts > len(hashes))[0].tolist()))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """key, text_key (xxhash64 of the text) and fingerprint (long, its bits) of each row. Null texts count as empty."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [simhash(shingle_hashes(t, words, seed)) for _, texts in chunks(batch, 2) for t in texts]
            prints = pa.array(np.array(own, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["key", "text_key", "fingerprint"])

    rows = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, text_key long, fingerprint long")


def _forest(prints: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what is connected at 4 or fewer differing bits: one less than members for each part.

    Breadth first: each step compares one member with those not yet reached.
    """
    left, links = prints, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = golay.distance(left, x) <= golay.MOST_BITS
            if near.any():
                links += [(int(x), int(y)) for y in left[near]]
                queue += left[near].tolist()
                left = left[~near]
    return links


def links(prints: DataFrame, most_in_bucket: int = 4096) -> DataFrame:
    """(a, b): links between the distinct fingerprints of prints that connect all at 4 or fewer differing bits.

    Every fingerprint is dealt out under its Golay keys. A key's fingerprints
    are compared in its task and give a forest of verified links, not all
    pairs. Keys of more than most_in_bucket fingerprints are found beforehand;
    their fingerprints are linked through common midpoints instead: any two at
    4 or fewer bits have a point within 2 bits of both, and all that share a
    point are linked, so this is exact and its work grows with the number of
    fingerprints (2081 points each).
    """
    spark = prints.sparkSession
    ship(spark)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            for i in range(0, len(x), 5_000):
                own = x[i : i + 5_000]
                rows, ks = golay.keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(ks), pa.array(own[rows])], ["k", "fp"])

    # a hundred keys for each fingerprint: spread the small rows first
    spread = prints.select("fingerprint").repartition(shuffle_partitions(spark), "fingerprint")
    dealt = spread.mapInArrow(deal, "k long, fp long")
    counts = dealt.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > most_in_bucket).select("k")
    hot = write_shared(counts, "hot-keys")
    cold = dealt if hot.isEmpty() else dealt.join(hot, "k", "left_anti")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_k, last = None, np.zeros(0, np.int64)

        def linked(groups: list[np.ndarray]) -> pa.RecordBatch:
            found = [p for g in groups for p in _forest(g)]
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            ks, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(ks):
                continue
            cuts = np.nonzero(ks[1:] != ks[:-1])[0] + 1
            bounds = [0, *cuts.tolist(), len(ks)]
            groups = []
            if last_k is not None and ks[0] == last_k:
                last = np.concatenate([last, fps[: bounds[1]]])
                bounds = bounds[1:]
            if len(bounds) > 1:
                groups.append(last)
                starts, sizes = np.array(bounds[:-1]), np.diff(bounds)
                for s, n in zip(starts[:-1][sizes[:-1] > 1], sizes[:-1][sizes[:-1] > 1], strict=True):
                    groups.append(fps[s : s + n])
                last_k, last = ks[-1], fps[bounds[-2] :]
            groups = [g for g in groups if len(g) > 1]
            if groups:
                yield linked(groups)
        if len(last) > 1:
            yield linked([last])

    # in order of fingerprint too: then the hub of a crowd is the same under most of its keys, and its links are few
    found = cold.repartition("k").sortWithinPartitions("k", "fp").mapInArrow(compare, "a long, b long").distinct()
    if hot.isEmpty():
        return found

    def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy()
            for i in range(0, len(x), 200):
                own = x[i : i + 200]
                at = (own.astype(np.uint64)[:, None] ^ golay.ball()[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(own, len(golay.ball())))], ["m", "fp"])

    members = write_shared(dealt.join(hot, "k", "left_semi").select("fp").distinct(), "hot-prints")
    points = members.mapInArrow(midpoints, "m long, fp long")
    least = points.groupBy("m").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("m", "a")
    more = points.join(least, "m").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42, most_in_bucket: int = 4096) -> DataFrame:
    """key, text_key, fingerprint (long) and component_id of each row.

    Fingerprints link at 4 or fewer differing bits; component_id is the smallest
    key reachable, the row's own included. Keys that are null count for nothing
    and get the component of their fingerprint (null if it has no other key).
    Rows of one fingerprint are one node, so exact copies cost nothing more.
    """
    rows = write_shared(fingerprints(docs, key, text, words, seed), "fingerprints")
    nodes = write_shared(rows.groupBy("fingerprint").agg(F.min("key").alias("least")), "nodes")
    roots = components(links(nodes, most_in_bucket)).withColumnRenamed("node", "fingerprint")
    linked = nodes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fingerprint", "component_id")
    out = rows.join(named, "fingerprint").select("key", "text_key", "fingerprint", "component_id")
    return out.withColumnRenamed("key", key)


def shingles(text: bytes, words: int) -> set[bytes]:
    """Word shingles of a text, A-Z lower-cased; fewer words are one shingle."""
    ws = text.lower().split()
    return {b" ".join(ws[i : i + words]) for i in range(max(1, len(ws) - words + 1))} if ws else set()


#: Longs of the shortest sketch.
_SKETCH = 8


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Of how many hashes there are in each of 512 or more cells (a power of two, two or more for each hash), odd or even: a bit each.

    A hash that only one of two sets has changes one bit at most, so two sets
    differ in at least as many hashes as their sketches in bits.
    """
    cells = max(64 * _SKETCH, 1 << (2 * len(hashes)).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """A sketch as one of fewer cells: cells that fall together add up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, longs), axis=0)


def rare_first(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sorted hashes in the order of the corpus: those not in common (sorted) by hash, then the others by rank."""
    if not len(common):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.argsort(np.where(common[at] == hashes, rank[at], 0), kind="stable")]


def _common(rows: DataFrame, words: int, most_texts: int = 5_000, least_seen: int = 5, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that many texts have, sorted, and their ranks by how many, from a bounded sample.

    They only set an order, and any order gives the same results.
    """
    share = min(1.0, most_texts / max(1, rows.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, 0):
                for t in texts:
                    yield pa.RecordBatch.from_arrays([pa.array(shingle_hashes(t, words).view(np.int64))], ["h"])

    sample = rows.where(F.pmod("text_key", F.lit(1_000_000)) < share * 1_000_000).select("text").mapInArrow(run, "h long")
    found = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least_seen).orderBy(F.desc("n"), "h").limit(most).toArrow()
    h = found.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], np.arange(len(h), 0, -1)[order]


def _pairs(group: np.ndarray, block: np.ndarray, rows: dict[str, np.ndarray], bits: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """Pairs (the smaller as b) of rows of a group (neighbours in order of group) with different roots that may be alike by their sizes, places and sketches.

    In groups of two blocks (block: 0 or 1, and -1 where there is only one) only rows of different blocks meet.
    """
    t, root, size, place = (rows[c] for c in ("t", "root", "size", "place"))
    found, n = [], 0
    for d in range(1, len(group)):
        i = np.nonzero(group[d:] == group[:-d])[0]
        if not len(i):
            break
        i = i[(root[i] != root[i + d]) & ((block[i] < 0) | (block[i] != block[i + d]))]
        j = i + d
        both = size[i] + size[j]
        may = 1 + np.minimum(size[i] - place[i] - 1, size[j] - place[j] - 1) >= least / (1 + least) * both - 1e-9
        i, j, both = i[may], j[may], both[may]
        may = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= (1 - least) / (1 + least) * both + 1e-9
        i, j = i[may], j[may]
        found.append(np.stack([np.maximum(t[i], t[j]), np.minimum(t[i], t[j])], 1))
        n += len(i)
        if n > 50_000:
            a, b = np.unique(np.concatenate(found), axis=0).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            found, n = [], 0
    if n:
        a, b = np.unique(np.concatenate(found), axis=0).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def similar_texts(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    least: float = 0.8,
    most_in_bucket: int = 4096,
    most_sent: int = 1_000_000,
) -> DataFrame:
    """key, text_key and component_id of each row: groups of texts linked by a similarity of `least` or more.

    Similarity is the share of word shingles that two texts have in common
    (Jaccard); texts of no words are like each other. A text is a node however
    many rows have it; component_id is the smallest key of a group.

    Candidates come from the Golay keys of the SimHash fingerprints, as in
    near_duplicates(), and from prefixes, since two texts that share 0.8 may well
    differ in more bits than 4: with the shingles of all texts in one order, rare
    ones first, two alike texts share one of the first n - ceil(least * n) + 1
    of each (n: its shingles), so none is missed. Every pair is verified on the
    whole texts before it links. First fingerprints' links and each shingle's
    texts with the least of them are compared. Then all pairs under a shingle that
    are not yet in one group are, but for those that sizes, places or sketches
    rule out; a shingle of more than most_in_bucket texts is dealt out as pairs of
    blocks, which changes no result.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    own = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_key"), body.alias("text"))
    sent = spark.sparkContext.broadcast(_common(own, words))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = sent.value
        for batch in batches:
            for first, texts in chunks(batch, 2):
                prints, sizes, short, bits, ks = [], [], [], [], []
                for t in texts:
                    every = shingle_hashes(t, words)
                    h = np.unique(every)
                    n = len(h)
                    prints.append(simhash(every))
                    sizes.append(n)
                    bits.append(sketch(h))
                    short.append(folded(bits[-1], _SKETCH))
                    ks.append(rare_first(h, common, rank)[: n - math.ceil(least * n - 1e-9) + 1].view(np.int64) if n else np.zeros(1, np.int64))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), pa.array((np.concatenate(x) if x else np.zeros(0, np.int64)).view(np.int64))) for x in (short, bits, ks)]
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *lists], ["key", "text_key", "fingerprint", "size", "short", "bits", "ks"]
                )

    rows = write_shared(own.mapInArrow(read, f"key {kind}, text_key long, fingerprint long, size long, short array<long>, bits array<long>, ks array<long>"), "prefixes")

    # by fingerprints: those that link, and the texts of one fingerprint, each with the least text of a fingerprint
    prints = write_shared(rows.groupBy("fingerprint").agg(F.min("text_key").alias("hub")), "prints")
    x, y = (prints.select(F.col("fingerprint").alias(c), F.col("hub").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    by_print = links(prints, most_in_bucket).join(x, "a").join(y, "b").select("x", "y")
    one_print = rows.join(prints, "fingerprint").where("hub <> text_key").select(F.col("hub").alias("x"), F.col("text_key").alias("y"))

    # by prefixes: the texts of each shingle that several have, with the least of them
    dealt = rows.select(F.col("text_key").alias("t"), F.posexplode("ks").alias("place", "k"), "size")
    dealt = dealt.select("k", "t", F.shiftleft("size", 32).bitwiseOR(F.col("place").cast("long")).alias("at"))  # a row for each of a fifth of all words: kept small
    shared = dealt.groupBy("k").agg(F.min("t").alias("hub"), F.max("t").alias("last")).where("hub <> last").select("k", "hub")
    size, place = F.shiftright("at", 32), F.col("at").bitwiseAND(F.lit((1 << 32) - 1))
    met = write_shared(dealt.join(shared, "k").select("k", "hub", "t", size.alias("size"), place.alias("place")), "met")
    by_hub = met.where("t <> hub").select(F.col("hub").alias("x"), F.col("t").alias("y"))

    sketches = rows.select("text_key", "size", "short", "bits").dropDuplicates(["text_key"])
    x, y = (sketches.select(F.col("text_key").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = (batch.column(2).to_numpy() + batch.column(3).to_numpy()).tolist()
            a, b = ((v.flatten().to_numpy().view(np.uint64), v.offsets.to_numpy() - v.offsets[0].as_py()) for v in (batch.column(4), batch.column(5)))
            keep = []
            for i, n in enumerate(both):
                u, v = (w[at[i] : at[i + 1]] for w, at in (a, b))
                longs = min(len(u), len(v))
                keep.append(int(np.bitwise_count(folded(u, longs) ^ folded(v, longs)).sum()) <= (1 - least) / (1 + least) * n + 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, t = None, set()
        for batch in batches:
            keep = []
            for x, b, y in zip(batch.column(2), batch.column(1).to_pylist(), batch.column(3), strict=True):
                if b != last:  # rows come in order of b, the hub of many
                    last, t = b, shingles(y.as_py().encode(), words)
                s = shingles(x.as_py().encode(), words)
                keep.append(len(s & t) >= least * len(s | t))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose texts are alike: those that their sketches allow, by the whole texts."""
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "size_a", "size_b", "bits_a", "bits_b").mapInArrow(possible, "a long, b long")
        pairs = write_shared(pairs, "possible-pairs")
        wanted = pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).distinct()
        if wanted.limit(most_sent + 1).count() <= most_sent:  # 8 bytes each; more are joined by a shuffle
            wanted = F.broadcast(wanted)
        # each text once, written: the joins below have plain sides, which Spark splits where a hub has a crowd
        texts = write_shared(own.select("text_key", "text").join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"]), "compared")
        s, t = (texts.select(F.col("text_key").alias(c), F.col("text").alias(n)) for c, n in (("a", "x"), ("b", "y")))
        return write_shared(pairs.join(s, "a").join(t, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "verified")

    first = by_print.unionByName(one_print).unionByName(by_hub).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    found = verified(first)

    def rooted(of: DataFrame, name: str) -> DataFrame:
        roots = components(found).withColumnRenamed("node", name)
        return of.join(roots, name, "left").withColumn("root", F.coalesce("root", name))

    split = write_shared(rooted(met.drop("hub"), "t").distinct(), "met-rooted")
    mixed = split.groupBy("k").agg(F.min("root").alias("u"), F.max("root").alias("v"), F.count("*").alias("n")).where("u <> v")
    blocks = F.when(F.col("n") > most_in_bucket, F.ceil(F.col("n") * 2 / most_in_bucket)).otherwise(1).cast("int")
    left = split.join(mixed.select("k", blocks.alias("blocks")), "k").withColumn("own", F.pmod(F.xxhash64("t"), "blocks").cast("int"))
    left = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.join(sketches.select(F.col("text_key").alias("t"), "short"), "t").select(
        "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")).alias("block"), "t", "root", "size", "place", "short",
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            k, i, j = (now.column(c).to_numpy() for c in range(3))
            new = np.nonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))[0] + 1
            end = int(new[-1]) if len(new) else 0
            if end:
                yield from of(now.slice(0, end))
            kept = now.slice(end)
        if kept is not None:
            yield from of(kept)

    def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        k, i, j = (table.column(c).to_numpy() for c in range(3))
        group = np.cumsum(np.r_[0, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        bits = table.column("short").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, _SKETCH)  # unsigned: numpy counts the bits of absolute values
        yield from _pairs(group, table.column("block").to_numpy(), {c: table.column(c).to_numpy() for c in ("t", "root", "size", "place")}, bits, least)

    rest = left.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(meet, "a long, b long").distinct()
    found = write_shared(found.unionByName(verified(rest)), "alike")
    named = write_shared(rooted(rows.select("key", "text_key"), "text_key"), "rooted")
    least_key = named.groupBy("root").agg(F.min("key").alias("component_id"))
    return named.join(least_key, "root").select(F.col("key").alias(key), "text_key", "component_id")


def hex_digits(fingerprint: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
