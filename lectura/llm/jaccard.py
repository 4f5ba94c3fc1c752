"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and the components of its links.

A text's set has its distinct runs of `shingle` words (fewer words: the whole sequence). Equal sets are one set with several
documents from the start, so copies cost nothing. Two sets link when 100 * intersection >= percent * union.

All shingles are ordered by a frequency sketch (fixed size, over all texts; it only orders, so its errors cost time, never
results), rare ones first. Linked sets share a shingle among their first n - need + 1, and two among their first n - need + 2,
where need is the least intersection a set of n can have with any partner.
  light sets, up to a boundary: every pair of shingles of that longer prefix is a key;
  heavy sets, above it: every shingle of the prefix is a key, whose rows are its inverted list;
  the boundary is where a set's pairs cost as much as scanning its lists: a row each, and the comparisons with chosen members,
  of which there are no more than the list is long. Sets next to it take both kinds, since partners differ in size by at most
  the threshold.
Where a key stands in its set says how large a partner can be that it is the first thing in common with: the sizes after it
bound the intersection. Every entry of a list carries that reach, and two entries are candidates only if each lies within the
other's. So sets with many shingles of their own, whose common ones come late, aren't paired with each other at all.
Lists aren't expanded into pairs. Every member is compared with few chosen members of its lists, the ones of the farthest reach;
the links found give components. Then only members outside the largest component of a list are compared with the list's members
of other components that they can reach. Pairs within one component need no comparison: their documents are connected already.
So no link between components is lost, and a list of thousands of near copies costs little more than its length.

A null text or one without words has an empty set, which links with nothing. Repeated rows and texts share a set. A component's
id is its least doc_id; documents without doc_id link like others, come last, and a component of them alone has none. An empty
table gives no row. Columns beside doc_id and text are not read. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import shards
from .repeats import ODD1, ODD2, mix
from .subwords import lean
from .tables import Scratch, hot_limit, is_one_of, join_hot, written

#: A-Z in lower case, the other characters that part words as spaces.
WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: Counters of the sketch: its size, some 4 MB, whatever the input.
COUNTERS = 1 << 22
#: Cells of a set's profile: how many of its shingles fall in each. The lesser counts bound an intersection from above.
CELLS = 64
#: Chosen partners per member in the first comparison.
CHOSEN = 3
#: Members of a list that meet its members of other components in one task; a longer list is dealt over several.
TOGETHER = 10_000
#: Buckets of tasks whose sketches are added first.
BUCKETS = 256
BLOCK = "block int, bucket int, counts binary"


def shingle_sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, with repeats, and the text of each."""
    import xxhash

    clean = pa.array([t.translate(WORDS).strip(b" ") for t in texts], pa.large_binary())
    lists = pc.split_pattern(clean.cast(pa.large_string()), " ")
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy()
    vocabulary = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    real = np.fromiter(map(bool, vocabulary), bool, len(vocabulary))[at]
    owner = np.repeat(np.arange(len(texts)), sizes)[real]
    words = hashes[at[real]]
    count = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(count) - count
    room = np.repeat(starts + count, count) - np.arange(len(words))  # words from here to the text's end
    short = count < shingle
    begin = np.flatnonzero(np.where(short[owner], np.arange(len(words)) == starts[owner], room >= shingle))
    h = np.full(len(begin), ODD2)
    for k in range(shingle):
        inside = room[begin] > k
        part = words[np.minimum(begin + k, len(words) - 1)] if len(words) else words
        h = np.where(inside, mix(h * ODD1 + part), h)
    return h, owner[begin]


def distinct_sets(h: np.ndarray, owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[fresh], owner[fresh]
    return h, owner, np.bincount(owner, minlength=n_texts)


def signature(shingles: np.ndarray) -> int:
    """A hash of a set, in whatever order."""
    return int(mix(np.array([mix(shingles).sum() + np.uint64(len(shingles))], np.uint64))[0].astype(np.int64))


def rarity(docs: DataFrame, shingle: int) -> tuple[np.ndarray, float]:
    """Counts of all shingles by hash, as levels of their logarithm, and the mean length of the list a shingle is in."""
    rows = 64

    def count(parts):
        from pyspark import TaskContext

        total = np.zeros(COUNTERS, np.int64)
        for part in parts:
            for s in shards(part.column(0), 2 << 20):
                h, _ = shingle_sets(part.column(0)[s].to_pylist(), shingle)
                total += np.bincount((h >> np.uint64(42)).astype(np.int64), minlength=COUNTERS)
        blocks = [zlib.compress(b.astype("<i8").tobytes(), 1) for b in total.reshape(rows, -1)]
        bucket = TaskContext.get().partitionId() % BUCKETS
        yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array([bucket] * rows, pa.int32()), pa.array(blocks, pa.binary())], ["block", "bucket", "counts"])

    def summed(table: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(zlib.decompress(c.as_py()), "<i8") for c in table.column("counts"))

    def add(table: pa.Table) -> pa.Table:
        return table.slice(0, 1).set_column(2, "counts", pa.array([zlib.compress(summed(table).astype("<i8").tobytes(), 1)], pa.binary()))

    def close(table: pa.Table) -> pa.Table:
        total = summed(table)
        level = np.minimum(255, np.log2(total + 1.0) * 8).astype(np.uint8)
        return pa.table({"block": table.column("block")[:1], "levels": pa.array([level.tobytes()], pa.binary()), "n": pa.array([float(total.sum())]), "squares": pa.array([float((total.astype(float) ** 2).sum())])})

    counted = docs.select("text").mapInArrow(lean(count), BLOCK)
    in_buckets = counted.groupBy("block", "bucket").applyInArrow(add, BLOCK)  # so that no task holds the sketches of all tasks
    found = in_buckets.groupBy("block").applyInArrow(close, "block int, levels binary, n double, squares double").collect()
    if not found:
        return np.zeros(COUNTERS, np.uint8), 1.0
    n, squares = sum(r["n"] for r in found), sum(r["squares"] for r in found)
    return np.frombuffer(b"".join(r["levels"] for r in sorted(found)), np.uint8), max(1.0, (squares - n * n / COUNTERS) / max(n, 1))


def keys_of(h: np.ndarray, percent: int, light_to: int, heavy_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set whose shingles stand rare first, and of each the size of the largest partner it can be common with first."""
    n = len(h)
    need = -(-percent * n // 100)
    out, left = [], []  # left: what two sets can have in common at most
    if n <= light_to:
        first = h[: n - need + 2]
        if n == 1:  # a set of one shingle has no pair
            out.append(mix(first ^ ODD2))
            left.append(np.ones(1, np.int64))
        a, b = np.triu_indices(len(first), 1)
        x, y = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
        out.append(mix(x * ODD1 + y))
        left.append(n + 1 - b)
    if n >= heavy_from:
        out.append(mix(h[: n - need + 1] * ODD2))
        left.append(n - np.arange(n - need + 1))
    keys, at = np.unique(np.concatenate(out), return_index=True)
    # intersection >= percent * (n + m) / (100 + percent)
    return keys, (100 + percent) * np.concatenate(left)[at] // percent - n


def sets_of(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, text_hash, sig, n, profile, keys, reach: each document's set by its hash, size and profile, and its keys."""
    levels, length = rarity(docs, shingle)
    told = docs.sparkSession.sparkContext.broadcast(levels)
    # C(p + 1, 2) rows of pairs against p lists, each a row and the comparisons with chosen members
    scan = 1 + min(CHOSEN, length)
    boundary = int((2 * scan - 1) / (1 - percent / 100))
    light_to, heavy_from = -(-boundary * 100 // percent), boundary + 1

    def build(parts):
        for part in parts:
            for s in shards(part.column(2), 2 << 20):
                texts = part.column(2)[s].to_pylist()
                h, owner, count = distinct_sets(*shingle_sets(texts, shingle), len(texts))
                order = np.lexsort((h, told.value[(h >> np.uint64(42)).astype(np.int64)], owner))
                h = h[order]
                ends = np.cumsum(count)
                cells = np.bincount(owner * CELLS + (h >> np.uint64(36)).astype(np.int64) % CELLS, minlength=len(texts) * CELLS).astype("<u4").reshape(-1, CELLS)
                sig, keys = [], []
                nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                for a, b in zip((ends - count).tolist(), ends.tolist()):
                    own = h[a:b]
                    sig.append(signature(own) if b > a else None)
                    keys.append(keys_of(own, percent, light_to, heavy_from) if b > a else nothing)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k, _ in keys])]), pa.int32())
                key, reach = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([k[i] for k in keys]).astype(t))) for i, t in ((0, np.int64), (1, np.int32)))
                told_of = [pa.array(sig, pa.int64()), pa.array(count, pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()), key, reach]
                yield pa.RecordBatch.from_arrays([part.column(0)[s], part.column(1)[s], *told_of], ["doc_id", "text_hash", "sig", "n", "profile", "keys", "reach"])

    return docs.mapInArrow(lean(build), "doc_id long, text_hash long, sig long, n int, profile binary, keys array<long>, reach array<int>")


def plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose profiles allow a link; the rest can't link, and their shingles are never fetched."""
    side = lambda k, p: sets.select(F.col("sig").alias(k), F.col("profile").alias(p))

    def judge(parts):
        for part in parts:
            if part.num_rows:
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u4").reshape(-1, CELLS).astype(np.int64) for c in ("left", "right"))
                both = np.minimum(x, y).sum(axis=1)
                yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * (x.sum(axis=1) + y.sum(axis=1) - both)))

    return pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(lean(judge), "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (sig, shingles) link."""
    told = pairs.join(sets.select(F.col("sig").alias("a"), F.col("shingles").alias("left")), "a").join(sets.select(F.col("sig").alias("b"), F.col("shingles").alias("right")), "b")

    def judge(parts):
        for part in parts:
            keep = []
            for x, y in zip(part.column("left"), part.column("right")):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return told.select("a", "b", "left", "right").mapInArrow(lean(judge), "a long, b long")


def components(edges: DataFrame, tables: Scratch) -> DataFrame:
    """node, label (the least node reachable) of every node of edges (a, b): least labels of neighbours, then of labels.

    Joins and minima only, which combine before they shuffle; the rounds grow with the logarithm of the longest path.
    """
    both = tables.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = tables.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")).select(F.col("a").alias("node"), "near")
        lower = tables.written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("beyond"))
        moved = tables.written(lower.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("beyond", "next")).alias("next")))
        changed = moved.filter("next < label").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels


def _is_hot(rows: DataFrame, total: int, one_in: int) -> Column:
    """Whether a row's key has over a thousandth of all rows, as a sample of one in so many shows; such keys are a thousand or so.

    The sample only decides how a key's rows meet, not what comes of them.
    """
    return is_one_of(rows.groupBy("key").count().filter(F.col("count") > hot_limit(total) // one_in), "key")


def _entries(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode(F.arrays_zip("keys", "reach")).alias("e"), "sig", "n").select(F.col("e.keys").alias("key"), "sig", "n", F.col("e.reach").alias("reach"))


def _lists(sets: DataFrame, tables: Scratch) -> DataFrame:
    """key, sig, n, reach, centre: the entries that could have a partner in their list, with the member of the farthest reach.

    Of two linked sets the smaller one reaches beyond its own size, so a list without such an entry links nothing. One shuffle by
    key; hot keys are summed up before they shuffle, and their few sums broadcast.
    """
    total = sets.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    entries = _entries(sets)
    hot = _is_hot(_entries(sets.filter(F.pmod(F.xxhash64("sig"), F.lit(64)) == 0)), total, 64)
    far = F.struct((-F.col("reach") * 1000 / F.col("n")).cast("int"), F.xxhash64("sig"), "sig", "n", "reach")
    of_list = {"long": F.count("*"), "reaches": F.max("reach"), "least": F.min("n"), "over": F.max(F.col("reach") - F.col("n")), "far": F.min(far)}
    one = Window.partitionBy("key")
    few = entries.filter(~hot).select("key", "sig", "n", "reach", *[v.over(one).alias(k) for k, v in of_list.items()])
    many = entries.filter(hot)
    sums = tables.written(many.groupBy("key").agg(*[v.alias(k) for k, v in of_list.items()]))
    listed = few.unionByName(many.join(F.broadcast(sums), "key"))
    centre = F.struct("far.sig", "far.n", "far.reach").alias("centre")
    return listed.filter("long > 1 and over >= 0 and n <= reaches and reach >= least").select("key", "sig", "n", "reach", centre)


def _apart(labelled: DataFrame, tables: Scratch) -> DataFrame:
    """The entries of lists with several labels, with the label that most of a list's entries have, and the list's length."""
    hot = _is_hot(labelled.filter(F.pmod(F.xxhash64("sig"), F.lit(64)) == 0), labelled.count(), 64)
    one, each = Window.partitionBy("key"), Window.partitionBy("key", "label")
    told = labelled.filter(~hot).withColumn("many", F.count("*").over(each)).select("key", "sig", "n", "reach", "label", F.max(F.struct("many", "label")).over(one).alias("most"), F.count("*").over(one).alias("long"), (F.min("label").over(one) < F.max("label").over(one)).alias("several"))
    many = labelled.filter(hot)
    sums = many.groupBy("key", "label").agg(F.count("*").alias("many")).groupBy("key").agg(F.max(F.struct("many", "label")).alias("most"), F.sum("many").alias("long"), (F.count("*") > 1).alias("several"))
    told = told.unionByName(many.join(F.broadcast(tables.written(sums)), "key"))
    return told.filter("several").select("key", "sig", "n", "reach", "label", F.col("most.label").alias("largest"), "long")


def _across(apart: DataFrame) -> DataFrame:
    """(a, b): members outside the largest component of a list with its members of other components that each can reach."""
    shares = F.floor(F.col("long") / TOGETHER)
    outside = apart.filter("label <> largest").select("key", F.explode(F.sequence(F.lit(0).cast("long"), shares)).alias("share"), F.col("sig").alias("x"), F.col("n").alias("m"), F.col("reach").alias("of_m"), F.col("label").alias("other"))
    members = apart.select("key", F.pmod(F.xxhash64("sig"), shares + 1).alias("share"), "sig", "n", "reach", "label")
    near = (F.col("other") != F.col("label")) & (F.col("n") <= F.col("of_m")) & (F.col("m") <= F.col("reach"))
    return outside.join(members, ["key", "share"]).filter(near).select(F.least("sig", "x").alias("a"), F.greatest("sig", "x").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs, and text_hash (xxhash64 of the text) and first.

    first: the row stands for its component, having the least doc_id and of its texts the least hash; so has every repeated row
    of it. A row without words is first.
    """
    with Scratch(docs.sparkSession) as tables:
        return written(_near_duplicates(docs, shingle, percent, tables))


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, tables: Scratch) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    members = tables.written(sets_of(texts, shingle, percent))
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    of_sig = [F.min(named).alias("rep"), F.count("*").alias("times"), F.max("n").alias("n"), *(F.first(c).alias(c) for c in ("profile", "keys", "reach"))]
    sets = tables.written(members.filter("n > 0").groupBy("sig").agg(*of_sig))
    listed = tables.written(_lists(sets, tables))

    within = lambda m, of_m, n, of_n: (F.col(n) <= F.col(of_m)) & (F.col(m) <= F.col(of_n))
    chosen = listed.filter((F.col("sig") != F.col("centre.sig")) & within("n", "reach", "centre.n", "centre.reach")).groupBy("sig").agg(F.array_distinct(F.collect_list("centre.sig")).alias("partners"))
    first = tables.written(chosen.select("sig", F.explode(F.slice(F.array_sort("partners"), 1, CHOSEN)).alias("p")).select(F.least("sig", "p").alias("a"), F.greatest("sig", "p").alias("b")).distinct())

    def read(parts):
        for part in parts:
            for s in shards(part.column(1), 2 << 20):
                raw = part.column(1)[s].to_pylist()
                h, _, count = distinct_sets(*shingle_sets(raw, shingle), len(raw))
                ends = np.cumsum(count)
                yield pa.RecordBatch.from_arrays([part.column(0)[s], pa.array([h[a:b].astype("<u8").tobytes() for a, b in zip((ends - count).tolist(), ends.tolist())], pa.binary())], ["sig", "shingles"])

    def linked_of(pairs: DataFrame) -> DataFrame:
        """The pairs that link; only texts of plausible pairs are read again, one per set."""
        pairs = tables.written(plausible(pairs, sets, percent))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(sets.select("sig", "rep"), "sig")
        where = tables.written(wanted.select("sig", F.col("rep.doc_id").alias("_d"), F.col("rep.text_hash").alias("_t")))
        few = where.count() <= 500_000
        hit = texts.join(F.broadcast(where) if few else where, (F.col("text_hash") == F.col("_t")) & F.col("doc_id").eqNullSafe(F.col("_d")))
        # repeated rows are read more than once, and joined by their first
        shingles = hit.select("sig", "text").mapInArrow(lean(read), "sig long, shingles binary").groupBy("sig").agg(F.first("shingles").alias("shingles"))
        return tables.written(linked(pairs, tables.written(shingles), percent))

    edges = linked_of(first)
    labels = components(edges, tables)
    labelled = listed.select("key", "sig", "n", "reach").join(labels, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", "reach", F.coalesce("label", "sig").alias("label"))
    apart = tables.written(_apart(tables.written(labelled), tables))
    across = _across(apart).withColumn("new", F.lit(True))
    second = across.unionByName(first.withColumn("new", F.lit(False))).groupBy("a", "b").agg(F.min("new").alias("new")).filter("new").select("a", "b")
    more = linked_of(second)
    joined = components(tables.written(edges.unionByName(more)), tables)

    classed = tables.written(sets.select("sig", "times", "rep").join(joined, F.col("sig") == F.col("node"), "left").select("sig", "times", "rep", F.coalesce("label", "sig").alias("class")))
    least = classed.groupBy("class").agg(F.min("rep").alias("least"), F.count("*").alias("sets"))
    of_set = join_hot(classed, tables.written(least), ["class"], "sets", classed.count()).select("sig", "times", "least")
    worded = join_hot(members.filter("n > 0").select("doc_id", "text_hash", "sig", "n"), tables.written(of_set), ["sig"], "times", members.count())
    is_first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))
    told = worded.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), "text_hash", is_first.alias("first"))
    empty = members.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("first"))
    return told.unionByName(empty)
