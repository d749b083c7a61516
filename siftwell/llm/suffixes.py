"""Suffix-array dedup: removes bytes of strings of LENGTH bytes that also start earlier.

Suffixes are taken at content-chosen anchors (see anchors); the strings that share an anchor form a
block. A hash of the anchor only tells candidates: blocks whose anchor occurs once can't repeat.
The others take part in a distributed merge sort: map tasks cut their suffixes from the anchor,
sort them and send front-coded runs, with the bytes before the anchor; reducers merge a bucket's
runs with a loser tree that carries common prefixes. The prefixes that come out of the merge say
how far two blocks agree to the right of the anchor, those of the sorted, reversed bytes before it
how far to the left; both number the groups of equal strings at each offset, of which the first
stays. Nothing is decided by a hash.

A batch sends one entry per anchor for the search of candidates, and equal blocks of a batch once
in the runs, so copies and common anchors weigh little. Anchors with more than PART candidates are
dealt over several buckets by document; strings that are first in their part are then compared
across parts by their bytes. A task holds one bucket at a time.

A string that equals the one up to PERIOD bytes before it needs no search (runs of blanks, rulers,
repeated entities): it repeats, and the first strings of its run stand for it everywhere. Blocks of
nothing else are left out, and what they cover is found again where texts are cut, so such a run
weighs nothing, whatever its length.

Null texts are empty. Texts below LENGTH bytes lose nothing. A null id comes after all others.
Rows that repeat an id and its text are one document and get the same result; different texts of
one id are told apart, and ordered, by SHA-256. Very long texts are cut into overlapping parts. Other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import LENGTH, SPAN, Blocks, blocks
from .common import pieces, saved, small_batches
from .runs import front_code, front_decode, merge
from .shingles import buffers, mix

#: Bytes of text handled at once, candidates of an anchor in one part, blocks gathered for a run, and buckets of a reducer.
TEXT_BYTES, PART, RUN, FINER = 2 << 20, 20_000, 200_000, 4
LAST = (1 << 63) - 1
#: Largest distance of a repeat that is found where it stands, and bytes between the probes for it; four probes lie in every LENGTH bytes.
PERIOD, PROBE = 16, LENGTH // 4
#: Bit of a span that marks an anchor found twice in its batch.
KNOWN = 128


def _documents(docs: DataFrame, tasks: int) -> DataFrame:
    """(doc_id, d, h, text): d and h tell documents apart and order them.

    h is 0 where an id has one text; different texts of one id are numbered by their SHA-256, once, in a table of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.sha2(text, 256).alias("_sha"), text.alias("text"))
    several = rows.groupBy("d").agg(F.min("_sha").alias("_least"), F.max("_sha").alias("_most")).where("_least < _most")
    texts = rows.select("d", "_sha").join(several.select("d"), "d", "left_semi").distinct()
    numbers = texts.repartitionByRange(tasks, "d", "_sha").sortWithinPartitions("d", "_sha").select("d", "_sha", (F.monotonically_increasing_id() + 1).alias("_no"))
    return rows.join(saved(numbers), ["d", "_sha"], "left").select("doc_id", "d", F.coalesce("_no", F.lit(0).cast("long")).alias("h"), "text")


def nearby(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (from, to) of places whose string equals that of a place up to PERIOD before it in the same text."""
    start, stop = [], []
    for p in range(1, PERIOD + 1):
        n = len(data) - p
        probe = data[: max(n, 0) : PROBE] == data[p::PROBE]
        if n < LENGTH or not (probe[3:] & probe[2:-1] & probe[1:-2] & probe[:-3]).any():
            continue
        differ = data[:n] != data[p:]
        across = (offsets[1:-1, None] - np.arange(1, p + 1)).ravel()
        differ[across[(across >= 0) & (across < n)]] = True
        edges = np.concatenate([[-1], np.flatnonzero(differ), [n]])
        equal = np.diff(edges) - 1
        long = np.flatnonzero(equal >= LENGTH)
        start.append(edges[long] + 1 + p)
        stop.append(start[-1] + equal[long] - LENGTH + 1)
    return (np.concatenate(start), np.concatenate(stop)) if start else (np.zeros(0, np.int64),) * 2


def nearby_in_text(text: bytes, most: int = TEXT_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """nearby() of one text, in parts."""
    data, found = np.frombuffer(text, np.uint8), []
    for a in range(0, len(data), most):
        shift = max(a - PERIOD, 0)
        part = data[shift : a + most + LENGTH - 1]
        found.append(np.array(nearby(part, np.array([0, len(part)]))) + shift)
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 2


def _searched(x: Blocks, data: np.ndarray, offsets: np.ndarray) -> Blocks:
    """Blocks with a string that doesn't repeat nearby."""
    start, stop = nearby(data, offsets)
    if not len(start):
        return x
    marks = np.zeros(len(data) + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, stop, -1)
    near = np.append(0, np.cumsum(np.cumsum(marks) > 0))
    left = near[x.first + x.count] - near[x.first] < x.count
    return Blocks(*(c[left] for c in x))


def _cut(buckets: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, members) of each bucket that has any, the members in the given order."""
    order = order[np.argsort(buckets[order], kind="stable")]
    ends = np.flatnonzero(np.append(np.diff(buckets[order]) != 0, True)) + 1 if len(order) else []
    for a, b in zip([0, *ends], ends):
        yield int(buckets[order[a]]), order[a:b]


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _flat(batch: pa.RecordBatch, size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, size):
        yield batch.slice(a, size)


def sent_anchors(docs: DataFrame, buckets: int, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """Blocks packed by bucket: one per anchor and batch by its anchor, further ones, which are candidates for certain, by document."""
    names = ["bucket", "d", "h", "owner", "gram", "span", "sure"]

    def rows(d: np.ndarray, h: np.ndarray, data: np.ndarray, offsets: np.ndarray, shift: int) -> Iterator[pa.RecordBatch]:
        x = _searched(blocks(data, offsets), data, offsets)
        if not len(x.first):
            return
        span = (x.first - offsets[x.text] + shift) << 16 | (x.anchor - x.first) << 8 | x.count
        order = np.argsort(x.gram, kind="stable")
        new = _firsts(x.gram[order])
        several = np.append(~new[1:], False) & new
        span[order[several]] |= KNOWN
        by_gram = (x.gram % np.uint64(buckets)).astype(np.int64)
        by_text = (mix(d.view(np.uint64) + mix(h.view(np.uint64)))[x.text] % np.uint64(buckets)).astype(np.int64)
        out = []
        for bucket, members, sure in ((by_gram, order[new], False), (by_text, order[~new], True)):
            for k, of in _cut(bucket, members):
                used, local = np.unique(x.text[of], return_inverse=True)
                out.append((k, d[used].tobytes(), h[used].tobytes(), local.astype(np.uint32).tobytes(), x.gram[of].tobytes(), span[of].tobytes(), sure))
        kinds = [pa.int32(), *[pa.binary()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", text_bytes):
            d, h = (batch.column(c).to_numpy() for c in "dh")
            data, offsets = buffers(batch.column("text"))
            if batch.num_rows > 1 or len(data) <= 2 * text_bytes:
                yield from rows(d, h, data, offsets, 0)
            else:
                for a in range(0, len(data), text_bytes):
                    part = data[a : a + text_bytes + LENGTH - 1]
                    yield from rows(d, h, part, np.array([0, len(part)]), a)

    return docs.select("d", "h", "text").mapInArrow(run, "bucket int, d binary, h binary, owner binary, gram binary, span binary, sure boolean")


def candidates(packed: DataFrame) -> DataFrame:
    """(d, h, span, gram) of blocks whose anchor occurs more than once."""
    names = ["d", "h", "span", "gram"]

    def unpacked(r: dict) -> list[np.ndarray]:
        owner = np.frombuffer(r["owner"], np.uint32)
        return [np.frombuffer(r[c], np.int64)[owner] for c in "dh"] + [np.frombuffer(r[c], np.int64) for c in ("span", "gram")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["sure"]:
                    yield from _flat(pa.RecordBatch.from_arrays(list(map(pa.array, unpacked(r))), names))
                else:
                    parts.append(unpacked(r))
        if parts:
            d, h, span, gram = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(gram, kind="stable")
            new = _firsts(gram[order])
            group = np.cumsum(new) - 1
            often = np.bincount(group) + np.bincount(group, (span[order] & KNOWN) > 0) > 1
            found = order[often[group]]
            yield from _flat(pa.RecordBatch.from_arrays([pa.array(c[found]) for c in (d, h, span & ~KNOWN, gram)], names))

    return packed.mapInArrow(run, "d long, h long, span long, gram long")


def sent_suffixes(texts: DataFrame, buckets: int, most: int = RUN) -> DataFrame:
    """Candidates as sorted front-coded runs of suffixes from the anchor, with the bytes before it; equal blocks once, with all their places."""
    names = ["bucket", "shared", "sizes", "rests", "left", "offs", "split", "often", "ids"]
    kinds = [pa.int32()] + [pa.binary()] * 8

    def packed(items: dict) -> pa.RecordBatch:
        keys = list(items)
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
        bucket = np.array([k[2] for k in keys])
        places = list(items.values())
        out = []
        for k, members in _cut(bucket, order):
            of = [keys[i] for i in members]
            ids = [places[i] for i in members]
            coded = front_code([x[0] for x in of])
            left = [x[1] for x in of]
            out.append((k, *coded, b"".join(left), bytes(map(len, left)), bytes(x[3] for x in of), np.array([len(i) // 3 for i in ids], np.uint32).tobytes(), np.array(list(itertools.chain.from_iterable(ids)), np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: dict[tuple, list[int]] = {}
        n = 0
        for batch in pieces(batches, "text", TEXT_BYTES):
            for d, h, text, spans, grams, parts in zip(*(batch.column(c).to_pylist() for c in ("d", "h", "text", "spans", "grams", "parts"))):
                part = np.array([(d ^ h) % p for p in parts], np.uint64)
                bucket = (mix(np.array(grams, np.int64).view(np.uint64) + mix(part)) % np.uint64(buckets)).tolist()
                for span, p, k in zip(spans, parts, bucket):
                    at, off, count = span >> 16, span >> 8 & 255, span & 127
                    items.setdefault((text[at + off : at + count + LENGTH - 1], text[at : at + off], k, p > 1), []).extend((d, h, span))
                n += len(spans)
                if n >= most:
                    yield packed(items)
                    items, n = {}, 0
        if items:
            yield packed(items)

    return texts.mapInArrow(run, "bucket int, shared binary, sizes binary, rests binary, left binary, offs binary, split binary, often binary, ids binary")


def left_order(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings by their reversed bytes, and the suffix that each in order shares with the one before."""
    ends = np.cumsum(sizes)
    width = max(int(sizes.max(initial=0)), 1)
    rows = np.zeros((len(sizes), width), np.uint8)
    for k in range(width):
        long = np.flatnonzero(sizes > k)
        rows[long, k] = data[ends[long] - 1 - k]
    order = np.argsort(sizes, kind="stable")
    order = order[np.argsort(rows.view(f"S{width}").ravel()[order], kind="stable")]
    rows, sizes = rows[order], sizes[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.append(0, np.minimum(lcp, np.minimum(sizes[1:], sizes[:-1])))


def solve(parts: list[dict]) -> pa.RecordBatch:
    """What repeats within a bucket: (d, h, span); and for split anchors each string that is first in its part: (d, h, string, place)."""
    strings = [(front_decode(r["shared"], r["sizes"], r["rests"]), r["shared"]) for r in parts]
    starts = np.cumsum([0, *(len(s[0]) for s in strings)])
    tour = np.array([(starts[run] + i, lcp) for run, i, lcp in merge(strings)], np.int64)
    right = [s for part in strings for s in part[0]]
    n = len(right)
    size = np.array(list(map(len, right)))
    left_bytes = b"".join(r["left"] for r in parts)
    off = np.frombuffer(b"".join(r["offs"] for r in parts), np.uint8).astype(np.int64)
    left_end = np.cumsum(off)
    split = np.frombuffer(b"".join(r["split"] for r in parts), np.uint8).astype(bool)
    # place of each block in both orders, and the common prefixes there
    to_right, lcp = tour[:, 0], tour[:, 1]
    to_left, left_lcp = left_order(np.frombuffer(left_bytes, np.uint8), off)
    right_at, left_at = np.empty(n, np.int64), np.empty(n, np.int64)
    right_at[to_right] = left_at[to_left] = np.arange(n)
    # equal blocks: equal to the right and to the left
    whole_right = np.cumsum((lcp < size[to_right]) | (np.diff(size[to_right], prepend=-1) != 0))
    whole_left = np.cumsum((left_lcp < off[to_left]) | (np.diff(off[to_left], prepend=-1) != 0))
    kind = np.unique(whole_right[right_at] * (n + 1) + whole_left[left_at], return_inverse=True)[1]
    # all places, in order; the first of a kind stands for it, the others repeat it in full
    item = np.repeat(np.arange(n), np.frombuffer(b"".join(r["often"] for r in parts), np.uint32))
    ids = np.frombuffer(b"".join(r["ids"] for r in parts), np.int64).reshape(-1, 3)
    order = np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0]))
    order = order[_firsts(*ids[order].T)]  # a repeated row brings the same blocks again
    ids, item = ids[order], item[order]
    of_kind = np.argsort(kind[item], kind="stable")
    new = _firsts(kind[item][of_kind])
    repeats = ids[np.sort(of_kind[~new])]
    first = np.sort(of_kind[new])  # in order of places
    ids, item = ids[first], item[first]
    off, count, split = off[item], ids[:, 2] & 127, split[item]
    again = np.zeros((len(ids), SPAN), bool)  # by block and string of the block
    alone: list[tuple[np.ndarray, np.ndarray]] = []
    for o in range(SPAN):
        valid = np.flatnonzero((o <= off) & (o > off - count))
        if not len(valid):
            continue
        at = item[valid]
        key = np.cumsum(lcp < LENGTH - o)[right_at[at]] * (n + 1) + np.cumsum(left_lcp < o)[left_at[at]]
        ordered = np.argsort(key, kind="stable")
        new = _firsts(key[ordered])
        later = valid[ordered[~new]]
        again[later, off[later] - o] = True
        lone = valid[ordered[new]]
        alone.append((lone[split[lone]], o))
    edge = np.zeros((len(ids), 1), bool)
    change = np.diff(np.hstack([edge, again, edge]).astype(np.int8), axis=1)
    member, start = np.nonzero(change == 1)
    stop = np.nonzero(change == -1)[1]
    d, h, span = (np.concatenate([repeats[:, k], ids[member, k]]) for k in range(3))
    span[len(repeats) :] = (span[len(repeats) :] >> 16) + start << 16 | stop - start
    bare = len(span)
    text = [left_bytes[left_end[item[i]] - o : left_end[item[i]]] + right[item[i]][: LENGTH - o] for lone, o in alone for i in lone.tolist()]
    who = np.concatenate([lone for lone, _ in alone]) if alone else np.zeros(0, np.int64)
    place = np.concatenate([(ids[lone, 2] >> 16) + off[lone] - o for lone, o in alone]) if alone else who
    late = np.arange(bare + len(who)) >= bare
    columns = [pa.array(np.concatenate([x, ids[who, k]])) for k, x in ((0, d), (1, h))]
    columns += [pa.array(np.concatenate([span, place]), mask=late), pa.array([None] * bare + text, pa.binary()), pa.array(np.concatenate([span, place]), mask=~late)]
    return pa.RecordBatch.from_arrays(columns, ["d", "h", "span", "string", "place"])


def merged(runs: DataFrame) -> DataFrame:
    """solve() for each bucket of a partition, in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for _, parts in itertools.groupby(rows, key=lambda r: r["bucket"]):
            yield from _flat(solve(list(parts)))

    return runs.mapInArrow(run, "d long, h long, span long, string binary, place long")


def across_parts(strings: DataFrame) -> DataFrame:
    """(d, h, span) of strings of split anchors that are not the first of their kind over all parts."""
    lone = strings.where("string is not null").select("string", F.struct("d", "h", "place").alias("at"))
    first = lone.groupBy("string").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").select("string", "first")
    later = lone.join(first, "string").where("at > first")
    return later.select("at.d", "at.h", (F.shiftleft(F.col("at.place"), 16) + 1).alias("span"))


def removed(texts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) from texts with the spans of repeated strings; those that repeat nearby are found here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = []
            for text, lists in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                spans = np.array(lists or (), np.int64)
                near = nearby_in_text(text)
                start = np.concatenate([spans >> 16, near[0]])
                stop = np.concatenate([(spans >> 16) + (spans & 127), near[1]]) + LENGTH - 1
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order])
                new = np.ones(len(start), bool)
                new[1:] = start[1:] > stop[:-1]
                firsts = start[new].tolist()
                lasts = stop[np.append(np.flatnonzero(new)[1:], len(start)) - 1].tolist() if firsts else []
                kept = b"".join(text[a:b] for a, b in zip([0, *lasts], [*firsts, len(text)]))
                out.append((len(text), len(text) - len(kept), len(firsts), kept))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, part: int = PART, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = _documents(docs, tasks)
    found = saved(candidates(sent_anchors(docs, tasks, text_bytes).repartition(tasks, "bucket")))
    hot = saved(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("gram", F.ceil(F.col("n") / part).cast("int").alias("parts")))
    found = found.join(hot, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    texts = docs.select("doc_id", "d", "h", F.col("text").cast("binary").alias("text"))
    by_text = found.groupBy("d", "h").agg(F.collect_list(F.struct("span", "gram", "parts")).alias("open"))
    by_text = by_text.select("d", "h", *(F.col(f"open.{c}").alias(c2) for c, c2 in (("span", "spans"), ("gram", "grams"), ("parts", "parts"))))
    runs = sent_suffixes(texts.join(by_text, ["d", "h"]).select("d", "h", "text", "spans", "grams", "parts"), tasks * FINER)
    strings = saved(merged(runs.repartition(tasks, "bucket").sortWithinPartitions("bucket")))
    spans = strings.where("span is not null").select("d", "h", "span").union(across_parts(strings))
    spans = spans.groupBy("d", "h").agg(F.collect_list("span").alias("spans"))
    return removed(texts.join(spans, ["d", "h"], "left"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
