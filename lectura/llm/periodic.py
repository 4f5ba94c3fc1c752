"""Periodic runs of words, found by Crochemore's partition refinement.

A run is a stretch of words with smallest period q, as long as it can be, of at least `power` periods and `least` words. The
positions of a text are parted into classes of equal factors, of one word first and then of one word more at each level. Only the
smaller parts of a class that was split are looked at for the next level, so a position is touched O(log n) times. Members of a
class that follow each other at a distance equal to the level's length are squares of that period, with a root that is no
power itself; squares side by side are one run.

A task takes the texts of a batch in shards and refines a shard's texts together, each level as a few array operations. Classes
never hold positions of two texts. A text isn't parted: memory grows with a shard or with its longest text, some 150 bytes a word.

Words are what `[\\x20\\x09-\\x0D]` parts. A null or blank text has no words and no runs. Repeated rows each get their own result;
a null doc_id is returned as it is; an empty table gives no rows; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import shards

BLANKS = bytes(32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
SHARD_BYTES = 4 << 20
FOUND = "doc_id {}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def split_blank(texts: list[bytes], table: bytes = BLANKS) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, parted by what table turns into a blank, and where each text's words start."""
    lists = pc.split_pattern(pa.array([t.translate(table) for t in texts], pa.large_binary()), " ")
    words, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
    worded = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), sizes)
    return words.filter(pa.array(worded)), np.concatenate([[0], np.cumsum(np.bincount(owner[worded], minlength=len(texts)))])


class Due:
    """Positions by the distance to their class's next member, to be looked up when the level reaches that distance."""

    def __init__(self):
        self.level, self.late, self.n = 0, [], 0
        self.p = self.g = np.zeros(0, np.int64)

    def add(self, p: np.ndarray, g: np.ndarray) -> None:
        if len(p):
            self.late.append((p, g))
            self.n += len(p)

    def at(self, level: int, nxt: np.ndarray) -> np.ndarray:
        """The positions, in order, whose next member is level away now."""
        if self.n > 2048 + len(self.p) // 8:
            p, g = (np.concatenate([x, *y]) for x, y in zip((self.p, self.g), zip(*self.late)))
            valid = (g >= level) & (nxt[p] - p == g)
            p, g = p[valid], g[valid]
            order = np.argsort(g, kind="stable")
            self.p, self.g, self.late, self.n = p[order], g[order], [], 0
        a, b = np.searchsorted(self.g, [level, level + 1])
        found = [self.p[a:b], *(p[g == level] for p, g in self.late)]
        p = np.concatenate(found) if self.late else found[0]
        return np.unique(p[nxt[p] - p == level])


def runs_of(ids: np.ndarray, starts: np.ndarray, power: int = 3, least: int = 24) -> tuple[np.ndarray, ...]:
    """text, start, length and period of every run of texts whose words are numbers (0 or more); starts has each text's first word and the end."""
    sizes = np.diff(starts)
    texts, n = len(sizes), len(ids) + len(sizes)
    owner = np.repeat(np.arange(texts), sizes + 1)  # behind each text stands an end, which equals nothing
    origin = starts[:-1] + np.arange(texts)
    is_first = np.zeros(n, bool)
    is_first[origin] = True
    deepest = (sizes // power)[owner]
    key = np.zeros(n, np.int64)
    key[np.arange(len(ids)) + np.repeat(np.arange(texts), sizes)] = ids + 1
    key += owner * (int(ids.max(initial=0)) + 2)

    order = np.argsort(key, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = key[order][1:] != key[order][:-1]
    cls, loc = np.empty(n, np.int64), np.empty(n, np.int64)
    cls[order], loc[order] = np.cumsum(fresh) - 1, np.arange(n)
    head, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    edges = np.flatnonzero(fresh)
    classes = len(edges)
    head[:classes], size[:classes] = edges, np.diff(np.append(edges, n))
    nxt, prv = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    a, b = order[:-1][~fresh[1:]], order[1:][~fresh[1:]]
    nxt[a], prv[b] = b, a
    marked = np.zeros(n, bool)
    due, found, level, small = Due(), [], 0, np.arange(n)

    def remember(p: np.ndarray, q: np.ndarray) -> None:
        g = q - p
        soon = (g > level) & (g <= deepest[p])
        due.add(p[soon], g[soon])

    remember(a, b)
    level, last = 1, int(deepest.max(initial=0))
    while level <= last:
        square = due.at(level, nxt)
        if len(square):
            cut = np.ones(len(square) + 1, bool)
            cut[1:-1] = np.diff(square) != 1
            at = np.flatnonzero(cut)
            length = np.diff(at) - 1 + 2 * level
            keep = length >= max(least, power * level)
            found.append((square[at[:-1]][keep], length[keep], np.full(int(keep.sum()), level)))
        small = small[deepest[small] > level]
        small = small[~is_first[small]]
        y, behind = small - 1, cls[small]
        of = cls[y]
        shared = size[of] > 1
        y, behind, of = y[shared], behind[shared], of[shared]
        if not len(y):
            if not len(small):
                break
            small, level = y, level + 1
            continue
        # parts: members of a class that a small class follows; rest: its members that the large one follows
        by = np.lexsort((y, behind, of))
        y, behind, of = y[by], behind[by], of[by]
        new_class = np.ones(len(y), bool)
        new_class[1:] = of[1:] != of[:-1]
        new_part = new_class.copy()
        new_part[1:] |= behind[1:] != behind[:-1]
        c_at = np.flatnonzero(new_class)
        c_touched = np.diff(np.append(c_at, len(y)))
        c_parts = np.add.reduceat(new_part.astype(np.int64), c_at)
        split = (size[of[c_at]] > c_touched) | (c_parts > 1)
        if not split.all():
            stays = np.repeat(split, c_touched)
            y, of, new_class, new_part = y[stays], of[stays], new_class[stays], new_part[stays]
            if not len(y):
                small, level = y, level + 1
                continue
            c_at = np.flatnonzero(new_class)
            c_touched = np.diff(np.append(c_at, len(y)))
        c = of[c_at]
        c_rest, c_head = size[c] - c_touched, head[c]
        p_at = np.flatnonzero(new_part)
        p_size = np.diff(np.append(p_at, len(y)))
        p_class = np.cumsum(new_class[p_at]) - 1
        p_first = np.flatnonzero(new_class[p_at])

        # the touched members leave their class's list; its others close up
        z = y[np.lexsort((y, of))]
        linked = nxt[z[:-1]] == z[1:]
        before = prv[z[np.concatenate([[True], ~linked])]]
        after = nxt[z[np.concatenate([~linked, [True]])]]
        has, then = before >= 0, after >= 0
        nxt[before[has]], prv[after[then]] = after[has], before[then]
        both = has & then
        remember(before[both], after[both])
        nxt[y], prv[y] = -1, -1
        inner = ~new_part[1:]
        a, b = y[:-1][inner], y[1:][inner]
        nxt[a], prv[b] = b, a
        remember(a, b)

        # in the class's stretch the rest comes first, then part by part
        slots = np.arange(len(y)) + np.repeat(c_head + c_rest - c_at, c_touched)
        marked[y] = True
        there = order[slots]
        moved = there[~marked[there]]
        holes = loc[y][loc[y] < np.repeat(c_head + c_rest, c_touched)]
        order[holes], loc[moved] = moved, holes
        order[slots], loc[y] = y, slots
        marked[y] = False

        # the largest of rest and parts keeps the class's number; the others are the next level's small classes
        p_most = np.maximum.reduceat(p_size, p_first)
        rest_keeps = c_rest >= p_most
        largest = np.flatnonzero(p_size == p_most[p_class])
        largest = largest[np.concatenate([[True], p_class[largest][1:] != p_class[largest][:-1]])]
        keeps = np.zeros(len(p_at), bool)
        keeps[largest[~rest_keeps]] = True
        number = np.where(keeps, c[p_class], classes + np.cumsum(~keeps) - 1)
        classes += int((~keeps).sum())
        cls[y] = np.repeat(number, p_size)
        head[number], size[number] = slots[p_at], p_size
        size[c[rest_keeps]] = c_rest[rest_keeps]
        small = y[np.repeat(~keeps, p_size)]
        left = np.flatnonzero(~rest_keeps & (c_rest > 0))
        if len(left):
            names = classes + np.arange(len(left))
            classes += len(left)
            head[names], size[names] = c_head[left], c_rest[left]
            ends = np.cumsum(c_rest[left])
            members = order[np.arange(ends[-1]) + np.repeat(c_head[left] - ends + c_rest[left], c_rest[left])]
            cls[members] = np.repeat(names, c_rest[left])
            small = np.concatenate([small, members])
        level += 1
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at, length, period = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((period, at))
    at, length, period = at[by], length[by], period[by]
    text = owner[at]
    return text, at - origin[text], length, period


def shard_runs(texts: list[bytes], power: int, least: int) -> tuple[np.ndarray, tuple[np.ndarray, ...], pa.Array]:
    """Word counts, the runs and the collapsed texts of a shard."""
    words, starts = split_blank(texts)
    ids = pc.dictionary_encode(words).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, start, length, period = runs_of(ids, starts, power, least)
    # words behind a run's first period go: one more at the first, one fewer behind the last
    change = np.bincount(starts[text] + start + period, minlength=len(ids) + 1) - np.bincount(starts[text] + start + length, minlength=len(ids) + 1)
    keep = np.cumsum(change)[: len(ids)] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[starts]
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(keep))), pa.scalar(b" ", pa.large_binary()))
    return np.diff(starts), (text, start, length, period), collapsed


def periodic_runs(docs: DataFrame, power: int = 3, least: int = 24) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period), collapsed (each run cut to its first period, words
    joined by one blank, as bytes)."""
    kind = dict(docs.dtypes)["doc_id"]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(parts):
        for part in parts:
            texts = part.column(1)
            for rows in shards(texts, SHARD_BYTES):
                n_words, (text, start, length, period), collapsed = shard_runs([t.as_py() for t in texts[rows]], power, least)
                offsets = np.searchsorted(text, np.arange(len(n_words) + 1))
                values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(run))
                # by text, then as sorted: texts come in order of their places
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0)[rows], pa.array(n_words, pa.int64()), lists, collapsed.cast(pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes")).mapInArrow(find, FOUND.format(kind))
