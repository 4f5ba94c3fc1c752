"""Token counts of whole texts; huge ones by overlapping chunks, spliced where the encodings provably agree.

A null text counts as empty, an empty text has no token, repeated rows are counted one by one, and columns beside
doc_id and text are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import batches, path_of, strings

MODEL = "piece_bpe_32k.model"
MARK = "▁"


class PieceCounter:
    """Counts the pieces of texts with a sentencepiece BPE model.

    A space after another character is a stable boundary when no piece of the vocabulary has the space mark behind another
    character: then no merge crosses it, whatever stands around. The vocabulary is read for that once, and a probe tells that the
    model keeps every space; without the property every text is encoded whole.
    """

    #: Distinct units held by a worker; then it starts anew.
    CACHE = 1_000_000

    def __init__(self, model: str, chunk: int, overlap: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path_of(model))
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        self.stable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) and "".join(self.sp.encode("a b  c ", out_type=str)) == "▁a▁b▁▁c▁"
        self.chunk, self.overlap, self.units = chunk, overlap, {}
        self.splices = self.widenings = 0

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = []
        for i, t in enumerate(texts):
            if len(t) > self.chunk and self.stable:
                out[i] = self.spliced(t)
            elif not self.stable or "  " in t or t[:1] == " " or t[-1:] == " ":
                out[i] = len(self.sp.encode(t))
            elif t:
                short.append(i)
        for i, n in zip(short, self._by_units([texts[i] for i in short])):
            out[i] = n
        return out

    def _by_units(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        if len(self.units) > self.CACHE:
            self.units.clear()
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        units = strings(coded.dictionary)
        new = [u for u in units if u not in self.units]
        for i in range(0, len(new), 4096):
            self.units.update(zip(new[i : i + 4096], map(len, self.sp.encode(new[i : i + 4096], num_threads=1))))
        lens = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        sums = np.concatenate([[0], np.cumsum(lens[coded.indices.to_numpy()])])
        return np.diff(sums[lists.offsets.to_numpy()]).tolist()

    def _bounds(self, text: str) -> list[int]:
        """Offsets in text where its pieces end. The model gives them, so characters that it rewrites do no harm."""
        return [end for _, end in self.sp.encode(text, return_type="offset_mapping")["offsets"]]

    def spliced(self, text: str) -> int:
        """Chunks overlap; each pair is cut at the last stable boundary in the overlap where both encodings have a boundary too.

        Without one, the overlap doubles, until the chunk reaches the end of the text.
        """
        total, start, size, overlap = 0, 0, self.chunk, self.overlap
        bounds = self._bounds(text[:size])
        while True:
            stop = start + size
            if stop >= len(text):
                return total + len(bounds)
            there = {start + b for b in bounds}
            cut = next((p for p in range(stop - 1, max(start, stop - overlap), -1) if text[p] == " " and text[p - 1] != " " and text[p + 1 : p + 2] not in ("", " ") and p in there), None)
            if cut is not None:
                ahead = self._bounds(text[cut + 1 : cut + 1 + self.chunk + overlap])
                seen = text.rfind(" ", cut + 1, stop)  # what both have seen: they must have the same boundaries up to its last space
                mine = [start + b for b in bounds if cut < start + b <= seen]
                if [cut + 1 + b for b in ahead if cut + 1 + b <= seen] == mine:
                    total += sum(start + b <= cut for b in bounds)
                    start, size, bounds, overlap = cut + 1, self.chunk + overlap, ahead, self.overlap
                    self.splices += 1
                    continue
            size, overlap = size + overlap, overlap * 2
            self.widenings += 1
            bounds = self._bounds(text[start : start + size])


@functools.cache
def counter(model: str, chunk: int, overlap: int) -> PieceCounter:
    return PieceCounter(model, chunk, overlap)


def token_counts(docs: DataFrame, limit: int = 4096, model: str = MODEL, chunk: int = 1 << 16, overlap: int = 1 << 10) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs: one scan, no shuffle."""

    def count(parts):
        c = counter(model, chunk, overlap)
        for part in parts:
            texts = part.column(1).to_pylist()
            for s in batches(texts):
                n = c.counts(texts[s])
                yield pa.RecordBatch.from_arrays([part.column(0)[s], part.column(2)[s], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce("text", F.lit(""))
    return (
        docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
        .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
