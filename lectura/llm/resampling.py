"""Importance resampling towards a target corpus, over inverted postings that are partitioned by bucket.

Features of a text are its runs of 1 to `longest` consecutive words; a feature counts in the bucket of its CRC-32. Documents and
target become postings (bucket, document, count): a bucket range's postings of a document lie in one row. They are written once,
so a lost executor costs no second tokenisation. Where a bucket's counts of both corpora meet, its gain is computed; postings and
gains meet by bucket range, and only the sums for each document leave that join. No task holds a corpus' counts but those of its
range, and no document's postings are held together.

A range's postings are dealt over slices by document, so that a range is as many tasks' work as its documents need; the gains of a
range, some hundred numbers, are repeated for each slice. Rows of one doc_id and one text are one document with copies.

A null text has no words: weight 0, never drawn unless `least_words` is 0. A null doc_id is hashed as an empty one and comes first
among ties; rows of the same doc_id and score are then ordered by a hash of the text. Each input row gives one row, repeated rows
one each with ranks of their own. Empty documents give no rows; an empty target gives the gains of T = 0. Other columns than
doc_id and text aren't read.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import WORD_BYTES, shards
from .periodic import split_blank
from .tables import Scratch, written

SHARD_BYTES = 4 << 20
#: Buckets of a range, so that a place in it takes a byte.
WIDTH = 250
#: Documents of a range and slice, about.
SLICE_DOCS = 20_000
#: Words up to so many bytes get their CRC by a table for their length.
SHORT = 64


@functools.lru_cache(SHORT + 1)
def _behind(n: int) -> np.ndarray:
    """What n further bytes make of a CRC-32, besides those bytes' own CRC: a table for each byte of the CRC."""
    zeros, own = bytes(n), zlib.crc32(bytes(n))
    return np.array([[zlib.crc32(zeros, b << 8 * k) ^ own for b in range(256)] for k in range(4)], np.uint32)


def joined_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, words: list[bytes], ids: np.ndarray) -> np.ndarray:
    """CRC-32 of strings of CRC first, each followed by the word of ids, whose own CRC and size are second and sizes."""
    out = np.empty(len(first), np.uint32)
    order = np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(sizes[order]) != 0, [True]])) if len(order) else []
    for a, b in zip(edges, edges[1:]):
        at = order[a:b]
        n = int(sizes[at[0]])
        if n <= SHORT:
            t, c = _behind(n), first[at]
            out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24] ^ second[at]
        else:
            out[at] = [zlib.crc32(words[i], int(c)) for i, c in zip(ids[at].tolist(), first[at].tolist())]
    return out


def text_buckets(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; then text, bucket and count of all postings, in this order."""
    found, starts = split_blank(texts, WORD_BYTES)
    coded = pc.dictionary_encode(found)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    crc = np.array([zlib.crc32(w) for w in words], np.uint32)
    size = np.array([len(w) for w in words], np.int64)
    n_words = np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), n_words)
    keys, run = [], crc[ids]
    keys.append(owner * buckets + run % buckets)
    blank = _behind(1)
    own = np.uint32(zlib.crc32(b" "))
    for n in range(2, longest + 1):
        run = run[:-1] if len(run) else run  # a run of n - 1 words, its last followed by one more of the same text
        then = ids[n - 1 :]
        run = blank[0][run & 255] ^ blank[1][run >> 8 & 255] ^ blank[2][run >> 16 & 255] ^ blank[3][run >> 24] ^ own
        run = joined_crc(run, crc[then], size[then], words, then)
        inside = owner[: len(then)] == owner[n - 1 :]
        keys.append((owner[: len(then)] * buckets + run % buckets)[inside])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    return n_words, key // buckets, key % buckets, count


POSTINGS = "doc_id {}, text_hash long, copies long, n_words long, range int, slice int, places array<tinyint>, counts array<int>"


def postings(docs: DataFrame, longest: int, buckets: int, slices: int) -> DataFrame:
    """A row per document and range of buckets that it has features in; places are buckets less the range's first and 128.

    Each document has a row of the first range. copies: how many equal rows of the task's shard it stands for.
    """
    kind, ranges = dict(docs.dtypes)["doc_id"], -(-buckets // WIDTH)

    def find(parts):
        for part in parts:
            for rows in shards(part.column(2), SHARD_BYTES):
                doc_ids, hashes, texts = (part.column(i)[rows].to_pylist() for i in range(3))
                copies: dict[tuple, list[int]] = {}
                for i, k in enumerate(zip(doc_ids, hashes)):
                    copies.setdefault(k, []).append(i)
                at = [x[0] for x in copies.values()]
                n_words, text, bucket, count = text_buckets([texts[i] for i in at], longest, buckets)
                # a row of the first range for every text: a place that isn't used, counted 0 times
                text, bucket, count = (np.concatenate([a, b]) for a, b in ((np.arange(len(at)), text), (np.full(len(at), -1), bucket), (np.zeros(len(at), np.int64), count)))
                key = text * ranges + np.maximum(bucket, 0) // WIDTH
                by = np.lexsort((bucket, key))
                key, bucket, count = key[by], bucket[by], count[by]
                edges = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
                of, which = key[edges] // ranges, key[edges] % ranges
                places = (np.maximum(bucket, 0) % WIDTH - 128).astype(np.int8)
                offsets = pa.array(np.append(edges, len(key)), pa.int32())
                keyed = np.array([k[1] for k in copies], np.int64)
                own = pa.array([k[0] for k in copies], part.schema.field(0).type)
                n = np.array([len(x) for x in copies.values()], np.int64)
                columns = [own.take(pa.array(of)), pa.array(keyed[of]), pa.array(n[of]), pa.array(n_words[of], pa.int64()), pa.array(which, pa.int32()), pa.array((keyed[of] ^ keyed[of] >> 32) % slices, pa.int32())]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (places, count.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns + lists, [c.split(" ")[0] for c in POSTINGS.split(", ")])

    text = F.coalesce("text", F.lit(""))
    # the doc_id belongs to the hash, so that copies of a text spread over slices
    given = docs.select("doc_id", F.xxhash64("doc_id", text).alias("text_hash"), text.cast("binary").alias("bytes"))
    return given.mapInArrow(find, POSTINGS.format(kind))


def bucket_gains(of_both: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain of all buckets from the postings of both corpora (column target)."""
    each = of_both.select("target", "range", "copies", F.explode(F.arrays_zip("places", "counts")).alias("p"))
    n = F.col("p.counts") * F.col("copies")
    counted = each.groupBy((F.col("range") * WIDTH + F.col("p.places") + 128).alias("bucket")).agg(
        F.sum(F.when(F.col("target"), n).otherwise(0)).alias("t"), F.sum(F.when(F.col("target"), 0).otherwise(n)).alias("s")
    )
    zero = F.lit(0).cast("long")
    every = of_both.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), zero.alias("t"), zero.alias("s"))
    dense = counted.unionByName(every).groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    every_bucket = Window.partitionBy()  # some thousand rows, whatever the corpora
    t, s = F.sum("t").over(every_bucket), F.sum("s").over(every_bucket)
    double = lambda c: c.cast("double")
    ratio = double(F.col("t") + 1) * double(s + buckets) / (double(F.col("s") + 1) * double(t + buckets))
    return dense.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighted(docs: DataFrame, target: DataFrame, longest: int, buckets: int, scratch: Scratch) -> DataFrame:
    """A row per doc_id and text: doc_id, text_hash, copies, n_words, n_features, weight."""
    slices = max(32, -(-docs.count() // SLICE_DOCS))
    kind = dict(docs.dtypes)["doc_id"]
    wanted = target.select(F.lit(None).cast(kind).alias("doc_id"), "text")
    both = [postings(c, longest, buckets, slices).withColumn("target", F.lit(own)) for c, own in ((docs, False), (wanted, True))]
    held = scratch.written(both[0].unionByName(both[1]))
    gains = bucket_gains(held, buckets).groupBy(F.floor(F.col("bucket") / WIDTH).cast("int").alias("range"))
    packed = gains.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))
    repeated = packed.select("range", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "gains").hint("shuffle_hash")
    met = held.filter(~F.col("target")).join(repeated, ["range", "slice"])
    each = F.zip_with("places", "counts", lambda p, n: F.get("gains", p.cast("int") + 128) * n)
    gained = F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)
    counted = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    own = F.when(F.col("range") == 0, 1).otherwise(0)
    summed = met.groupBy("doc_id", "text_hash").agg(
        F.sum(gained).alias("gain"), F.sum(counted).alias("features"), F.sum(own).alias("shards"), F.sum(own * F.col("copies")).alias("copies"), F.max("n_words").alias("n_words")
    )
    # copies of several shards have equal sums, so the mean is that of one
    mean = F.when(F.col("features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(gain - pmod(gain, features)) div features"))
    return summed.select("doc_id", "text_hash", "copies", "n_words", F.expr("features div shards").alias("n_features"), mean.alias("weight"))


def gumbel(doc_id, seed: int):
    """A Gumbel variate in thousandths, from a hash of the seed and the doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, longest: int = 2, buckets: int = 10_000, least_words: int = 20) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: of the documents with least_words words, percent of a hundred are drawn
    without replacement, with probabilities by weight (the highest scores); rank counts them, null where not drawn."""
    with Scratch(docs.sparkSession) as scratch:
        found = weighted(docs, target, longest, buckets, scratch)
        scored = written(found.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    fits = F.col("n_words") >= least_words
    # scores are whole and lie between logarithms of counts, so there are some ten thousand different ones, whatever the corpus
    tally = scored.filter(fits).groupBy("score").agg(F.sum("copies").alias("n"))
    total = tally.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    draws = percent * total // 100
    above = tally.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reached = above.filter(F.col("ahead") < draws).select("score", "ahead")
    lowest = reached.agg(F.min("score")).first()[0]
    drawn = fits & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    within = Window.partitionBy("score").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("ahead") + F.sum("copies").over(within) - F.col("copies")
    ranked = scored.filter(drawn).join(F.broadcast(reached), "score").withColumn("first", first)
    rest = scored.filter(~drawn).withColumn("first", F.lit(draws).cast("long"))
    columns = [c for c in scored.columns if c not in ("text_hash", "copies")]
    each = ranked.select(*rest.columns).unionByName(rest).select(*columns, "first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    rank = F.when((F.col("first") + F.col("copy") <= draws), F.col("first") + F.col("copy"))
    return each.select(*columns, rank.alias("rank"))
