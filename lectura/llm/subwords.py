"""Token ids of texts, by units that a tokenizer can't merge across, each encoded once per worker."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between two characters that are not white space starts a pre-token of the byte-level BPE.
SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s\s")
#: ASCII signs that part from a letter or digit before them where white space is dropped; > may end a special string.
SIGNS = "!\"#$%&'()*+,-./:;<=?@[\\]^_`{|}~"
#: Entries of a worker's cache; beyond them it starts anew, so its memory stays bounded.
CACHE = 500_000


def path_of(name: str) -> str:
    """A vocabulary file: a path as it is, a bare name where the public_tokenizers package keeps its files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def blanks(text: str) -> str:
    """ASCII white space, of which the dropping tokenizer keeps nothing, as spaces."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def strings(values: pa.Array) -> list[str]:
    """A string array as a list; quicker than value by value."""
    return values.to_numpy(zero_copy_only=False).tolist()


class UnitEncoder:
    """ids of whole texts as little-endian uint32 bytes, through the tokenizers library.

    mode "space": units are words with the space before them (byte-level BPE whose pattern puts a space at a pre-token's front).
    mode "dropped": units are words between ASCII white space, which the tokenizer drops.
    Both cut only where the tokenizer's own pre-tokenizer always cuts, so joining the units' ids gives the whole text's ids.
    """

    def __init__(self, name: str, mode: str, cache: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.front = Tokenizer.from_file(path_of(name)), " " if mode == "space" else ""
        self.model, self.lower = self.tokenizer.model, mode == "dropped"
        self.table = byte_characters()
        self.words: dict[str, bytes] = {}
        #: mode "space": what `words` held when it was last full; what is met again moves back
        self.older: dict[str, bytes] = {}
        self.cache = cache

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 512):  # few encodings at a time: they are large objects
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 512], add_special_tokens=False)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens. A run of letters goes to the BPE model itself, as the byte characters that it knows."""
        out, tokenize, space = [], self.model.tokenize, self.table[32]
        for w in words:
            letters = w.lstrip(" ")
            if letters.isascii() and letters.isalpha():  # bytes that stand for themselves
                known = w.lower() if self.lower else w.replace(" ", space)
                out.append(array("I", [t.id for t in tokenize(known)]).tobytes())
            elif letters.isalpha() and not ("Σ" in letters or "İ" in letters) and unicodedata.is_normalized("NFC", letters):
                known = (w.lower() if self.lower else w).encode().decode("latin-1").translate(self.table)
                out.append(array("I", [t.id for t in tokenize(known)]).tobytes())
            else:
                out.append(None)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._encode([words[i] for i in rest])):
            out[i] = ids
        return out

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of each unit that follows another. Letters and ASCII punctuation behind them are two pre-tokens, whose ids are kept by themselves."""
        if self.front:
            return self._after_spaces(units)
        if len(self.words) > self.cache:
            self.words.clear()
        # most units are known as they stand
        known = self.words.get
        found = [known(u) for u in units]
        new = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(new, self._parted([units[i] for i in new])):
            found[i] = ids
        return found

    def _parted(self, units: list[str]) -> list[bytes]:
        """Ids of units by their parts, which are kept."""
        return self._after_spaces(units) if self.front else self._before_signs(units)

    def _after_spaces(self, units: list[str]) -> list[bytes]:
        """Ids of units of mode "space": letters (or ASCII digits) after a space are one pre-token, ASCII signs behind them another.

        Two dictionaries of half the cache's size take turns, so that what is common outlives what is met once.
        """
        if 2 * len(self.words) > self.cache:
            self.words, self.older = {}, self.words
        words, before, tokenize, front = self.words, self.older.get, self.model.tokenize, self.table[32]
        known, out, late = words.get, [], []
        for u in units:
            key, tail = " " + u, ""
            ids = known(key)
            if ids is None:
                c = u.rstrip(SIGNS)
                plain = c.isalpha() or c.isascii() and c.isdigit()
                if plain and len(c) < len(u):
                    key, tail = " " + c, u[len(c) :]
                    ids = known(key)
                if ids is None:
                    ids = before(key)
                    if ids is None and plain and c.isascii() and c.isalpha():  # bytes that stand for themselves
                        ids = array("I", [t.id for t in tokenize(front + c)]).tobytes()
                    if ids is not None:
                        words[key] = ids
                if tail and ids is not None:
                    end = known(tail)
                    ids = None if end is None else ids + end
                if ids is None:
                    late.append((len(out), key, tail))
            out.append(ids)
        # a line break before a letter or sign is a pre-token of its own, and what follows it has no space
        parts = [("\n", key[2:], tail) if key[1:2] == "\n" else ("", key, tail) for _, key, tail in late]
        asked = [w for w in {w for three in parts for w in three} if w not in words]
        words.update(zip(asked, self._encode_words(asked)))
        for (i, _, _), (b, w, t) in zip(late, parts):
            out[i] = words[b] + words[w] + words[t]
        return out

    def _before_signs(self, units: list[str]) -> list[bytes]:
        """Ids of new units of mode "dropped": a letter or digit and a sign behind it always lie in two pre-tokens, and signs in a row in one."""
        bodies = [u.rstrip(SIGNS) for u in units]
        new, cut, get = [], [], self.words.get
        for i, (u, c) in enumerate(zip(units, bodies)):
            # the lower case of a letter may end in a combining mark, which the tokenizer keeps together with signs behind it
            if c != u and c and (last := c[-1]).isalnum() and (last.isascii() or last.isalpha() and last.lower().isalpha()):
                cut.append(i)
            else:
                new.append(u)
        tails = [units[i][len(bodies[i]) :] for i in cut]
        asked = list({*new, *(w for i in cut if get(w := bodies[i]) is None), *(w for w in {*tails} if get(w) is None)})
        self.words.update(zip(asked, self._encode_words(asked)))
        words = self.words
        out = [words[u] if u in words else b"" for u in units]
        for i, t in zip(cut, tails):
            out[i] = words[bodies[i]] + words[t]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool(self.front) and bool(ODD_SPACE.search(t) or t[:1].isspace() or t[-1:].isspace()) for t in texts]
        out = iter(self._regular([t if self.front else blanks(t) for t, o in zip(texts, odd) if not o]))
        return [self._spaced(t) if o else next(out) for t, o in zip(texts, odd)]

    def _spaced(self, text: str) -> bytes:
        first, *rest = SPACE.split(text)
        return self._encode([first])[0] + b"".join(self._ids(rest))

    def _regular(self, texts: list[str]) -> list[bytes]:
        """Units by single spaces; each distinct unit of the batch is looked up once, then its ids are copied to where it stands."""
        if not texts:
            return []
        if self.front:
            texts = [t.replace("\n", " \n") for t in texts]
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        at, ends = coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy()
        found = self._ids(strings(coded.dictionary))
        if self.front:  # a text's first unit has no space before it
            at[ends[:-1]] = len(found) + np.arange(len(texts))
            found = found + self._encode([t.split(" ", 1)[0] for t in texts])
        ids, lens = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, n = np.cumsum(lens) - lens, lens[at]
        stops = np.cumsum(n)
        flat = ids[np.repeat(starts[at] - stops + n, n) + np.arange(stops[-1])]
        cuts = np.concatenate([[0], stops])[ends]
        return [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


@functools.cache
def encoder(name: str, mode: str, cache: int = CACHE) -> UnitEncoder:
    """One per worker; workers serve many tasks."""
    return UnitEncoder(name, mode, cache)


def trim() -> None:
    """Gives the memory back that the worker's allocators keep."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        give(0)


def release() -> None:
    """Gives up the worker's tokenizers with their caches, and the memory that the allocators keep: for tasks of another operator."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    trim()


def lean(task, tokenizers: bool = False):
    """The task of a mapInArrow, in a worker that holds no more than it needs: what other operators' tasks left goes before it begins,
    what it has freed goes back when it ends. Workers live on beside the executor's heap while joins and sorts fill that."""

    def run(parts):
        trim() if tokenizers else release()
        yield from task(parts)
        trim()

    return run


def batches(texts: list[str], size: int = 1 << 22):
    """Slices of consecutive texts of about so many characters, one text at least."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
