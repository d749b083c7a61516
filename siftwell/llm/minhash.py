"""MinHash near-dedup on SetSketch registers.

A document's register j is the smallest of its shingles' j-th hashes, on an exponential scale
with base B, truncated to 16 bits. Equal sets become one class first, by a SHA-256 of the set. Bands
of registers name buckets; within a bucket each class is compared with the bucket's smallest one.
Once components are known, classes that share a bucket with another component are compared across
components wherever a shingle among each one's rarest lets both still reach the threshold, so no
bucket's pairs are made. A pair's registers give a joint likelihood of its similarity (the sizes of
the sets being known); pairs that can't reach the threshold go, the rest is checked on the full
shingle sets, word by word.

Null or wordless texts have no shingles and are linked with nothing. Rows with equal ids count
as one document, whatever their texts. Rows without an id aren't linked. Repeated rows stay. Texts
are handled 2 MB at once, a longer one by itself, in memory of about 100 bytes a word. Other columns
are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, saved, small_batches
from .components import components

#: Registers, those of a band, and base and rate of the scale: a pair shares no band once in 4e8 at a similarity of 0.85, once in 350,000 at 0.8.
REGISTERS, BAND, BASE, RATE = 252, 6, 1.001, 20.0
#: A pair is dropped unseen only if its best similarity is e^15 times as likely as the threshold.
DOUBT = 15.0
TEXT_BYTES = 2 << 20


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """16-bit registers of non-empty sets, one row each."""
    from .shingles import mix, stream

    low = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
    factors = (stream(REGISTERS, 12345) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out = np.empty((len(starts), REGISTERS), np.uint16)
    work = np.empty_like(low)
    for j, factor in enumerate(factors):
        np.multiply(low, factor, out=work)
        least = (np.minimum.reduceat(work, starts).astype(np.float64) + 0.5) / 2.0**32
        level = np.floor(1 - np.log(-np.log1p(-least) / RATE) / np.log(BASE))
        out[:, j] = np.clip(level, 0, 65535)
    return out


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, n, name, sketch): which text, set size, a digest of the set, registers."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        for batch in pieces(batches, "text", TEXT_BYTES):
            hashes, cuts = shingle_sets(batch.column("text"), width)
            sizes = np.diff(cuts)
            full = np.flatnonzero(sizes)
            names: list = [None] * len(sizes)
            sketch: list = [None] * len(sizes)
            if len(full):
                for i, row in zip(full.tolist(), registers(hashes, cuts[:-1][full])):
                    names[i] = hashlib.sha256(hashes[cuts[i] : cuts[i + 1]].tobytes()).digest()
                    sketch[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "text_hash", "n", "name", "sketch"])

    return _texts(docs, "doc_id").mapInArrow(run, "doc_id long, text_hash binary, n long, name binary, sketch binary")


def _texts(docs: DataFrame, name: str) -> DataFrame:
    """(id by that name, text_hash, text); the hash tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long").alias(name), F.unhex(F.sha2("text", 256)).alias("text_hash"), "text")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, rep) for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import mix, stream

        odd = stream(REGISTERS, 777).reshape(-1, BAND)
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, -1, BAND)
                keys = mix((mix(rows.astype(np.uint64) + np.uint64(1)) * odd).sum(axis=2))
                rep = np.repeat(batch.column("rep").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep)], ["key", "rep"])

    return classes.select("rep", "sketch").mapInArrow(run, "key long, rep long")


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether a similarity of `least` isn't out of the question, from registers and set sizes."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return above * np.log(up + tiny) + below * np.log(down + tiny) + same * np.log(np.maximum(1 - up - down, 0) + tiny)

    lo, hi = np.zeros(len(u)), top.copy()
    for _ in range(30):  # the likelihood has one peak
        third = (hi - lo) / 3
        left = score(lo + third) < score(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    best = (lo + hi) / 2
    at = np.minimum(least, top)
    return (best >= least) | (score(best) - score(at) <= DOUBT)


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that may reach the threshold."""
    one, two = (classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    rows = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("s_a", "s_b"))
                good = likely(a, b, batch.column("n_a").to_numpy().astype(float), batch.column("n_b").to_numpy().astype(float), percent / 100)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return rows.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def texts_of(wanted: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The wanted rows (rep, once each) with the text of their class; repeated rows come once."""
    texts = _texts(docs, "rep").join(wanted.join(classes.select("rep", "text_hash"), "rep"), ["rep", "text_hash"])
    return texts.groupBy("rep", "text_hash", *(c for c in wanted.columns if c != "rep")).agg(F.any_value("text").alias("text")).drop("text_hash")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets, compared word by word, reach the threshold."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    texts = saved(texts_of(ids, docs, classes))
    one, two = (texts.select(F.col("rep").alias(c), F.col("text").alias(f"t_{c}")) for c in "ab")
    rows = pairs.join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import exact_sets

        for batch in pieces(batches, "t_a", TEXT_BYTES // 2):
            n = batch.num_rows
            texts = pa.chunked_array([batch.column("t_a"), batch.column("t_b")]).combine_chunks()
            shingles, cuts = exact_sets(texts, width)
            sizes = np.diff(cuts)
            owner = np.repeat(np.arange(2 * n) % n, sizes)
            order = np.lexsort((shingles, owner))
            x, o = shingles[order], owner[order]
            twice = (x[1:] == x[:-1]) & (o[1:] == o[:-1])
            inter = np.bincount(o[1:][twice], minlength=n)
            union = sizes[:n] + sizes[n:] - inter
            yield batch.select(["a", "b"]).filter(pa.array((100 * inter >= percent * union) & (union > 0)))

    return rows.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def prefixes(open_: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(h, rep, label, n, pos): of each open class (rep, label) the shingles that come first when the rarest go first.

    Two sets that reach the threshold share one of these, whatever the order, if it is the same for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import shingle_sets

        for batch in pieces(batches, "text", TEXT_BYTES // 4):
            hashes, cuts = shingle_sets(batch.column("text"), width)
            sizes = np.diff(cuts)
            each = np.repeat(np.arange(len(sizes)), sizes)
            rep, label = (batch.column(c).to_numpy()[each] for c in ("rep", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(rep), pa.array(label), pa.array(sizes[each])], ["h", "rep", "label", "n"])

    texts = texts_of(open_, docs, classes).select("rep", "label", "text")
    rows = saved(texts.mapInArrow(run, "h long, rep long, label long, n long"))
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    place = F.row_number().over(W.partitionBy("rep").orderBy(F.coalesce("often", F.lit(1)), "h")) - 1
    rows = rows.join(common, "h", "left").select("h", "rep", "label", "n", place.alias("pos"))
    return saved(rows.where(100 * (F.col("n") - F.col("pos")) >= percent * F.col("n")))


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a > b) of different labels that share a prefix shingle and, by its places, may reach the threshold.

    Of the smaller set only the part counts that must meet the larger one's prefix.
    """
    mixed = rows.groupBy("h").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("h")
    rows = saved(rows.join(mixed, "h", "left_semi"))
    first = rows.where((100 + percent) * (F.col("n") - F.col("pos")) >= 2 * percent * F.col("n"))
    one, two = (x.select("h", *(F.col(k).alias(f"{k}_{c}") for k in ("rep", "label", "n", "pos"))) for x, c in ((first, "i"), (rows, "p")))
    smaller = (F.col("n_i") < F.col("n_p")) | ((F.col("n_i") == F.col("n_p")) & (F.col("rep_i") < F.col("rep_p")))
    most = F.least(F.col("n_i") - F.col("pos_i"), F.col("n_p") - F.col("pos_p"))
    near = 100 * most >= percent * (F.col("n_i") + F.col("n_p") - most)
    pairs = one.join(two, (one["h"] == two["h"]) & (F.col("label_i") != F.col("label_p")) & smaller & near)
    return pairs.select(F.greatest("rep_i", "rep_p").alias("a"), F.least("rep_i", "rep_p").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row; one document of each component is kept."""
    docs = docs.select("doc_id", "text")
    drawn = saved(sketches(docs, width))
    classes = drawn.where("n > 0 and doc_id is not null").groupBy("name").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch"))
    # an id with several texts may stand for several classes: both its texts are compared then
    classes = saved(classes.select("name", F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "n", "sketch"))
    keys = band_keys(classes)
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("key", "hub")
    shared = saved(keys.join(hubs, "key"))
    tried = saved(shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    links = saved(verified(saved(estimated(tried, classes, percent)), docs, classes, width, percent))
    # an id with several texts links their classes
    own = drawn.where("n > 0 and doc_id is not null").join(classes.select("name", "rep"), "name").groupBy("doc_id").agg(F.min("rep").alias("b"), F.collect_set("rep").alias("reps"))
    own = own.where("size(reps) > 1").select(F.explode("reps").alias("a"), "b").where("a <> b")
    links = saved(links.union(own))
    labels = components(links)
    # what shares a bucket with another component
    shared = shared.select("key", "rep").join(labels, shared["rep"] == labels["node"], "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    apart = shared.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    open_ = saved(shared.join(apart, "key").select("rep", "label").distinct())
    rest = prefix_pairs(prefixes(open_, docs, classes, width, percent), percent).join(tried, ["a", "b"], "left_anti")
    more = saved(verified(saved(estimated(rest, classes, percent)), docs, classes, width, percent))
    if more.limit(1).count():
        labels = components(links.union(more))
    members = drawn.join(classes.select("name", "rep"), "name", "left")
    members = members.join(labels, members["rep"] == labels["node"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "rep")).otherwise(F.col("doc_id"))
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
