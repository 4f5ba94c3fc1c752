"""Suffix-array deduplication: maximal repeats of at least `length` bytes, with all their occurrences.

A text is its UTF-8 bytes; repeats never cross texts. The suffixes that could share `length` bytes are brought together by the
minimiser of their first `length` bytes (the 32-byte gram of the least hash): equal strings have equal minimisers at equal
places. Consecutive suffixes with the same minimiser travel as one context, the bytes from the first to the end of the last.
  1. A scan finds the contexts: their minimiser's hash, a hash of their bytes, text and place. Only these numbers are shuffled.
  2. Minimisers with one occurrence hold no repeat. If all contexts of a minimiser are equal, the whole context repeats.
     Counts and extremes decide that, combined before the shuffle, so a hot minimiser is a row per task.
  3. Of the others each distinct context is read once and goes to a shard by its minimiser. A shard builds an enhanced suffix
     array, and a stack scan over its common prefixes gives the interval tree; an interval whose occurrences have different
     bytes on the left (or start a context) is a maximal repeat. It carries all its occurrences, not just neighbours.
     The contexts of a crowded minimiser are cut into blocks of suffixes that share a core, and cores share shards instead.
  4. Repeats become spans of each text; their union is removed.
A repeat longer than its context (or block) comes out as overlapping groups, whose union is the whole repeat.

A key with over a thousandth of all rows (a passage that stands everywhere) is joined by a broadcast, so no task gets its rows
alone. A null text is empty. Repeated rows are texts of their own, so each repeats the other. Texts shorter than `length` stay
as they are; an empty table gives no row; columns beside doc_id and text are not read. Texts are told apart by a 64-bit hash
of doc_id and text, and strings by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import merge, shards
from .subwords import lean, release
from .tables import Scratch, hot_limit, is_one_of, join_hot, written

GRAM = 32
#: Positions of a scan's piece fit so many bits; longer texts are scanned in overlapping pieces.
PLACE_BITS = 20
#: Bytes of a piece, about; while it is scanned it takes a hundred times as much.
PIECE_BYTES = 1 << 18
#: Distinct contexts of a shard, about, and of a minimiser (or core) up to which they share a shard.
SHARD, TOGETHER = 2000, 4000
#: Suffixes of a block, into which the contexts of a crowded minimiser are cut, and then those of a crowded core.
BLOCKS = (16, 1)
PLACES = "group long, h long, c long, times long, low long, high long"
#: Rows up to which spans or contexts to be read go to the texts by broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
ODD1, ODD2, ODD3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD3
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of any range of a byte string: a sum of mixed 8-byte values times powers of an odd number, shifted to the front."""

    ROOT = np.uint64(0x2545F4914F6CDD1D)
    UNROOT = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        n = len(data) - 7
        self.eight = mix(np.ndarray((n,), "<u8", data, 0, (1,)) * ODD1 + ODD2)
        if n >= len(Hashes.powers):
            full = np.full(max(n + 1, 1 << 16), Hashes.ROOT)
            full[0] = 1
            Hashes.powers = np.cumprod(full)
            full[1:] = Hashes.UNROOT
            Hashes.inverses = np.cumprod(full)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.eight * Hashes.powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop - 7] - self.sums[start]) * Hashes.inverses[start])

    def grams(self) -> np.ndarray:
        """Hashes of the 32 bytes from each position."""
        h = mix(self.eight[:-8] * ODD1 + self.eight[8:])
        return mix(h[:-16] * ODD2 + h[16:])


def contexts(texts: list[bytes], length: int):
    """Arrays over all contexts of the texts: text index, start, number of suffixes, minimiser, hash of the bytes."""
    window, out = length - GRAM + 1, []
    piece = min((1 << PLACE_BITS) - 2 * length, max(PIECE_BYTES, 4 * length))
    queue, held = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), piece):
            part = t[at : at + piece + length - 1]
            if held and held + len(part) > piece:
                out.append(_contexts(queue, length, window))
                queue, held = [], 0
            queue.append((i, at, part))
            held += len(part)
    if queue:
        out.append(_contexts(queue, length, window))
    if not out:
        return [np.zeros(0, np.int64)] * 5
    return [np.concatenate(c) for c in zip(*out)]


def _contexts(queue: list[tuple[int, int, bytes]], length: int, window: int):
    data = b"".join(p for _, _, p in queue)
    sizes = np.array([len(p) for _, _, p in queue])
    starts = np.cumsum(sizes) - sizes
    hashes = Hashes(data)
    grams = hashes.grams()
    places = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least, span = (grams & ~low) | places, 1
    while span < window:  # the least of `window` consecutive keys; ties go to the left
        step = min(span, window - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = (least & low).astype(np.int64)
    owner = np.repeat(np.arange(len(queue)), sizes)[: len(at)]
    valid = np.arange(len(at)) + length <= (starts + sizes)[owner]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    keep = valid[first]
    first, n = first[keep], n[keep]
    own = owner[first]
    text, base = np.array([i for i, _, _ in queue]), np.array([b for _, b, _ in queue])
    return text[own], first - starts[own] + base[own], n, grams[at[first]].view(np.int64), hashes.of(first, first + n - 1 + length).view(np.int64)


def suffixes_in_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all positions by their first depth bytes (prefix doubling from eight bytes on); zeros stand behind the end."""
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    n, done = len(padded), 8
    eight = np.ndarray((n - 7,), ">u8", padded.tobytes(), 0, (1,))
    rank = np.zeros(n, np.int64)
    rank[: n - 7] = np.unique(eight, return_inverse=True)[1]
    while done < depth:
        step = min(done, depth - done)
        key = rank[: n - step] * np.int64(n + 1) + rank[step:]
        rank[: n - step] = np.unique(key, return_inverse=True)[1]
        done += step
    return rank


def interval_tree(common: list[int], left: list[int]):
    """(common prefix, first, last) of the left-diverse intervals of a sorted list of suffixes, inner ones before outer ones.

    common[i] is what i and i+1 share, 0 where nothing that counts; left[i] is the byte before suffix i. One scan with a stack
    of open intervals, each with the left byte that all of it have so far, or -1.
    """
    stack = [(0, 0, -1)]
    for i, c in enumerate([*common, 0]):
        first, byte = i, left[i]
        while stack[-1][0] > c:
            value, first, other = stack.pop()
            if byte != other:
                byte = -1
            if byte < 0:
                yield value, first, i
        if stack[-1][0] < c:
            stack.append((c, first, byte))
        elif c and stack[-1][2] != byte:
            stack[-1] = (c, stack[-1][1], -1)


class Shard:
    """The enhanced suffix array of a shard's contexts and the intervals of its maximal repeats.

    Only suffixes whose first `length` bytes stand elsewhere with another byte before them enter the array's last part, where
    they are ordered by all the bytes of their context: the others lie in no interval that counts.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.texts, self.length = texts, length
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(data)) - starts[owner]
        at = np.flatnonzero(place + length <= sizes[owner])
        rank = suffixes_in_order(data, length)[at]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        first = np.flatnonzero(np.diff(rank, prepend=-1))
        # bytes on the left; a context's start may be anything, so it differs from all
        left = np.where(place[at] > 0, data[at - 1].astype(np.int64), 256 + owner[at])
        diverse = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first) if len(at) else np.zeros(0, bool)
        keep = np.repeat(diverse, np.diff(np.append(first, len(at))))
        at, rank, left = at[keep], rank[keep], left[keep]
        more = sizes[owner[at]] - place[at] - length
        width = int(more.max(initial=0)) or 1
        padded = np.concatenate([data, np.zeros(length + width, np.uint8)])
        rows = padded[(at + length)[:, None] + np.arange(width)]
        rows[np.arange(width) >= more[:, None]] = 0
        order = np.lexsort((more, rows.reshape(-1).view(f"S{width}"), rank))
        at, rank, more, rows, left = at[order], rank[order], more[order], rows[order], left[order]
        unequal = rows[1:] != rows[:-1]
        common = np.where(unequal.any(axis=1), unequal.argmax(axis=1), width)
        common = length + np.minimum(common, np.minimum(more[1:], more[:-1]))
        self.common = np.where(rank[1:] == rank[:-1], common, 0)
        self.owner, self.place = owner[at], place[at]
        self.intervals = list(interval_tree(self.common.tolist(), left.tolist())) if len(at) else []

    def occurrences(self):
        """(group, contexts, places, length) of every maximal repeat."""
        for size, a, b in self.intervals:
            text, at = self.texts[self.owner[a]], int(self.place[a])
            group = int.from_bytes(hashlib.blake2b(text[at : at + size], digest_size=8).digest(), "little", signed=True)
            yield group, self.owner[a : b + 1], self.place[a : b + 1], size

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """context, low, high: what the maximal repeats cover, those that overlap or touch merged."""
        reach = np.zeros(len(self.owner), np.int64)
        for size, a, b in reversed(self.intervals):  # outer ones first, so that the longest repeat at a place counts
            reach[a : b + 1] = size
        at = np.flatnonzero(reach)
        at = at[np.lexsort((self.place[at], self.owner[at]))]
        owner, low = self.owner[at], self.place[at]
        far = np.int64(1) << 32
        high = np.maximum.accumulate(owner * far + low + reach[at])
        new = np.ones(len(at), bool)
        new[1:] = owner[1:] * far + low[1:] > high[:-1]
        first = np.flatnonzero(new)
        return owner[first], low[first], (high - owner * far)[np.append(first[1:], len(at)) - 1] if len(at) else low


def deal(texts: list[bytes], minimisers: np.ndarray, length: int, block: int):
    """Parts of contexts: (context, start, number of suffixes, core, hash of the bytes); equal suffixes lie in parts of one core.

    A suffix stands some bytes before its context's minimiser; a block is `block` such distances in a row, and its core the
    bytes that all its suffixes share, of length - block + 1. Equal suffixes have equal distances, so equal blocks and cores.
    A block of one suffix needs no distance: its core is the suffix.
    """
    out = []
    for i, (t, h) in enumerate(zip(texts, minimisers)):
        hashes, s = Hashes(t), np.arange(len(t) - length + 1)
        if block == 1:
            first, core = s, hashes.of(s, s + length)
        else:
            grams = np.flatnonzero(hashes.grams() == h)
            g = grams[np.searchsorted(grams, s)]
            number = (g - s) // block
            first = np.flatnonzero((np.diff(number, prepend=-1) != 0) | (np.diff(g, prepend=-1) != 0))
            begin = g[first] - number[first] * block - block + 1
            # where the context has no full block the core may begin before it, but its bytes within every suffix are the same
            core = mix(hashes.of(begin + block - 1, begin + length) * ODD1 + number[first].astype(np.uint64))
        n = np.diff(np.append(first, len(s)))
        out.append((np.full(len(first), i), first, n, core, hashes.of(first, first + n - 1 + length)))
    return [np.concatenate(c) for c in zip(*out)]


class Repeats:
    """The steps that find the repeats of docs; `tables` keeps what they write until the caller has written its own result."""

    def __init__(self, docs: DataFrame, length: int, tables: Scratch):
        self.length, self.tables = length, tables

        def scan(parts):
            for part in parts:
                keys = part.column(0).to_numpy()
                for rows in shards(part.column(1), PIECE_BYTES):
                    text, start, n, h, c = contexts(part.column(1)[rows].to_pylist(), length)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array(keys[rows][text], pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32())], ["h", "c", "key", "start", "n"])

        self.keyed = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        found = tables.written(self.keyed.filter(F.length("text") >= length).mapInArrow(lean(scan), "h long, c long, key long, start long, n int"))
        repeated = tables.written(self._repeated(found))
        #: contexts that are equal wherever their minimiser stands: they repeat as a whole
        self.whole = repeated.filter("same").select("c", "key", "start", "n")
        self.mixed = repeated.filter("not same")

    def _repeated(self, found: DataFrame) -> DataFrame:
        """Contexts whose minimiser stands more than once, with `same` (so does the whole context, always), `times` and `at`: how
        often the context stands, and which of its occurrences a row is.

        One shuffle by the minimiser. Minimisers that a sample shows with over a thousandth of all rows, a thousand or so whatever
        the input, are counted apart, by sums that combine before they shuffle; the sample decides the way, not the result.
        """
        limit, one_in = hot_limit(found.count()), 64
        drawn = found.filter(F.pmod(F.xxhash64("key", "start"), F.lit(one_in)) == 0).groupBy("h").count()
        hot = is_one_of(drawn.filter(F.col("count") > limit // one_in), "h")
        rest = found.filter(~hot)
        of_h, of_c = Window.partitionBy("h"), Window.partitionBy("h", "c")
        row = ["h", "c", "key", "start", "n"]
        told = (
            rest.select(*row, F.count("*").over(of_h).alias("all"), (F.min("c").over(of_h) == F.max("c").over(of_h)).alias("same"))
            .filter("all > 1")
            .select(*row, "same", F.count("*").over(of_c).alias("times"), F.row_number().over(of_c.orderBy("key", "start")).alias("at"))
        )
        many = found.filter(hot)
        each = self.tables.written(many.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("key", "start")).alias("rep")))
        kinds = each.groupBy("h").agg((F.count("*") == 1).alias("same"))
        rows = join_hot(many, self.tables.written(each.join(F.broadcast(kinds), "h")), ["h", "c"], "times", found.count())
        at = F.when(F.struct("key", "start") == F.col("rep"), 1).otherwise(2)
        return told.unionByName(rows.filter("times > 1 or not same").select(*row, "same", "times", at.alias("at")))

    def read(self) -> DataFrame:
        """h, c, times, bytes of every distinct context that may repeat in part, each read once."""
        length = self.length
        wants = self.mixed.filter("at = 1").select("key", F.struct("h", "c", "times", "start", "n").alias("want")).groupBy("key").agg(F.collect_set("want").alias("wants"))

        def cut(parts):
            for part in parts:
                for text, own in zip(part.column(0), part.column(1).to_pylist()):
                    text = memoryview(text.as_buffer())
                    yield pa.RecordBatch.from_arrays([pa.array([w[c] for w in own], pa.int64()) for c in ("h", "c", "times")] + [pa.array([bytes(text[w["start"] : w["start"] + w["n"] + length - 1]) for w in own], pa.binary())], ["h", "c", "times", "bytes"])

        # repeated rows have one key
        texts = self.keyed.dropDuplicates(["key"])
        return self.tables.written(texts.join(wants, "key").select("text", "wants").mapInArrow(lean(cut), "h long, c long, times long, bytes binary"))

    def places(self, parts: DataFrame, groups: bool, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
        """What repeats of the parts (h, c, times, bytes): with groups every occurrence of every maximal repeat, else merged spans.

        Minimisers of up to TOGETHER contexts have them in one shard. Those of a crowded one are cut into blocks of suffixes, and
        the core that these share takes the minimiser's part. Where even a core is crowded, its suffixes are parts of their own.
        """
        length, tables = self.length, self.tables

        def build(table: pa.Table) -> pa.Table:
            release()
            shard = Shard(table.column("bytes").to_pylist(), length)
            if groups:
                rows = list(shard.occurrences())
                n = [len(r[1]) for r in rows]
                at, low = (np.concatenate([r[k] for r in rows] or [np.zeros(0, np.int64)]) for k in (1, 2))
                group, high = np.repeat(np.array([r[0] for r in rows], np.int64), n), low + np.repeat(np.array([r[3] for r in rows], np.int64), n)
            else:
                at, low, high = shard.spans()
                group = np.zeros(len(at), np.int64)
            told = table.select(["h", "c", "times"]).take(pa.array(at, pa.int64()))
            return pa.table({"group": pa.array(group, pa.int64())} | {c: told.column(c) for c in told.column_names} | {"low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64())})

        def in_shards(parts: DataFrame) -> DataFrame:
            shard = F.pmod(F.xxhash64("h"), F.lit(max(1, -(-parts.count() // SHARD))))
            return parts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, PLACES)

        copied = parts.filter("times > 1").select(F.col("c").alias("group"), "h", "c", "times", F.lit(0).cast("long").alias("low"), F.octet_length("bytes").cast("long").alias("high"))
        crowd = parts.groupBy("h").agg(F.count("*").alias("crowd")).filter(F.col("crowd") > TOGETHER).select("h")
        if not blocks or not crowd.limit(1).count():
            return in_shards(parts).unionByName(copied)
        if parts.count() // (TOGETHER + 1) <= BROADCAST_ROWS:  # no more than that can be crowded
            crowd = F.broadcast(crowd)
        few = tables.written(parts.join(crowd, "h", "left_anti"))

        def cut(batches):
            for b in batches:
                for rows in shards(b.column(3), 1 << 20):
                    own = b.slice(rows.start, rows.stop - rows.start)
                    texts = own.column(3).to_pylist()
                    at, start, n, core, c = deal(texts, own.column(0).to_numpy().view(np.uint64), length, blocks[0])
                    told = own.select([0, 1, 2]).take(pa.array(at))
                    bytes_ = [texts[i][s : s + k + length - 1] for i, s, k in zip(at.tolist(), start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([*told.columns, pa.array(core.view(np.int64)), pa.array(c.view(np.int64)), pa.array(start, pa.int64()), pa.array(bytes_, pa.binary())], ["h", "c", "times", "core", "part", "start", "bytes"])

        many = parts.join(crowd, "h", "left_semi").select("h", "c", "times", "bytes")
        dealt = tables.written(many.mapInArrow(lean(cut), "h long, c long, times long, core long, part long, start long, bytes binary"))
        inner = tables.written(dealt.groupBy("core", "part").agg(F.sum("times").alias("times"), F.max("bytes").alias("bytes"), F.count("*").alias("rows")))
        found = self.places(inner.select(F.col("core").alias("h"), F.col("part").alias("c"), "times", "bytes"), groups, blocks[1:])
        rows = inner.select("core", "part", "rows").join(found.select(F.col("h").alias("core"), F.col("c").alias("part"), "group", "low", "high"), ["core", "part"])
        back = join_hot(dealt.drop("bytes"), tables.written(rows), ["core", "part"], "rows", dealt.count())
        shifted = back.select("group", "h", "c", "times", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))
        return in_shards(few).unionByName(copied).unionByName(shifted)

    def occurrences(self, groups: bool) -> DataFrame:
        """group, key, start, end of all that repeats, in every text."""
        partly = self.tables.written(self.places(self.read(), groups))
        there = join_hot(self.mixed.drop("times"), partly, ["h", "c"], "times", self.mixed.count()).select("group", "key", (F.col("start") + F.col("low")).alias("start"), (F.col("start") + F.col("high")).alias("end"))
        return self.whole.select(F.col("c").alias("group"), "key", "start", (F.col("start") + F.col("n") + self.length - 1).cast("long").alias("end")).unionByName(there)


def repeat_groups(docs: DataFrame, length: int = 200) -> DataFrame:
    """group, key, start, size: every occurrence of every repeat; key is xxhash64(doc_id, text)."""
    with Scratch(docs.sparkSession) as tables:
        return written(Repeats(docs, length, tables).occurrences(True).select("group", "key", "start", (F.col("end") - F.col("start")).alias("size")).distinct())


def merged_spans(spans: DataFrame) -> DataFrame:
    """key and its spans, sorted, with those that touch merged."""

    def join(parts):
        for part in parts:
            own = [[{"start": a, "end": b} for a, b in merge([(s["start"], s["end"]) for s in x])] for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["key", "spans"])

    return spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(lean(join), "key long, spans array<struct<start:long,end:long>>")


def without_repeats(docs: DataFrame, length: int = 200, whole_characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain) and the other columns of docs, for every row.

    With whole_characters a span ends at characters, so what remains is text again.
    """
    with Scratch(docs.sparkSession) as tables:
        spans = written(merged_spans(Repeats(docs, length, tables).occurrences(False)))
    size = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    hit = F.broadcast(spans) if size <= BROADCAST_ROWS else spans
    others = [c for c in docs.columns if c.lower() not in {"doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept"}]
    row = F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).cast("int").alias("_")]).alias("row")
    text = F.col("text").cast("binary").alias("text")
    given = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "doc_id", text, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), row)
    keyed = given.join(hit, "key", "left").drop("key")

    def keep(parts):
        for part in (whole.slice(rows.start, rows.stop - rows.start) for whole in parts for rows in shards(whole.column("text").fill_null(b""), 1 << 20)):
            out = {"kept": [], "n_removed": [], "n_spans": []}
            for text, own in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                data = text or b""
                cuts = merge([(s["start"], s["end"]) for s in own or ()])
                if whole_characters:
                    cuts = [c for c in (inner(data, a, b) for a, b in cuts) if c[1] > c[0]]
                edges = [0, *(x for c in cuts for x in c), len(data)]
                out["kept"].append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                out["n_removed"].append(sum(b - a for a, b in cuts))
                out["n_spans"].append(len(cuts))
            arrays = [part.column("doc_id"), part.column("n_bytes"), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.binary()), part.column("row")]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "row"])

    types = dict(keyed.dtypes)
    done = keyed.mapInArrow(lean(keep), f"doc_id {types['doc_id']}, n_bytes long, n_removed long, n_spans long, kept binary, row {types['row']}")
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept", *[F.col(f"row.`{c}`") for c in others])


def inner(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The whole characters within data[a:b]."""
    while a < b and data[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
        b -= 1
    return a, b
