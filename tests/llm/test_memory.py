"""What workers hold on to between operators, and what is carried along."""

import numpy as np
import pyarrow as pa

from lectura.llm import subwords
from lectura.llm.language_id import identify


def test_a_worker_gives_up_its_tokenizers():
    subwords.encoder("byte_bpe_50k.json", "space").encode(["a text of words"])
    subwords.release()
    assert not subwords.encoder.cache_info().currsize


def test_a_carried_text_is_judged_like_one_that_is_sent_alone(spark):
    rows = [(i, None if i % 7 == 0 else f"some english words about number {i}" if i % 2 else f"quelques mots bien choisis {i}", "en" if i % 2 else "fr", i * 2) for i in range(60)] + [(60, "12 34", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, other long")
    alone = {r["doc_id"]: r[1:] for r in identify(docs).collect()}
    carried = identify(docs, carry=True)
    sent = carried._jdf.queryExecution().optimizedPlan().toString()
    assert "AS bytes" not in sent  # once, in its row
    assert {r["row"]["doc_id"]: r[1:] for r in carried.collect()} == alone


def test_known_units_are_taken_as_they_stand():
    own = subwords.UnitEncoder("word_bpe_49k.json", "dropped")
    first, asked, parted = own.encode(["red green, blue red"]), [], own._parted
    own._parted = lambda units: asked.append(units) or parted(units)
    assert own.encode(["red green, blue red"]) == first
    assert asked == [["green,"]]


def test_signs_are_parted_from_letters_that_are_known():
    own = subwords.UnitEncoder("word_bpe_49k.json", "dropped")
    texts = ["red green, blue", "red,%%% green. (green) it,irec 7. é, İ, a<|endoftext|>, <|endoftext|>! x|> don't, 's, ..."]
    own.encode(texts[:1])
    asked, words = [], own._encode_words
    own._encode_words = lambda new: asked.extend(new) or words(new)
    ids = own.encode(texts)
    assert "red,%%%" not in asked and "green." not in asked and ",%%%" in asked
    assert ids == own._encode(texts)


def test_a_task_leaves_no_tokenizers_to_the_next_operator():
    left = []

    def task(parts):
        left.append(subwords.encoder.cache_info().currsize)
        yield from parts

    subwords.encoder("byte_bpe_50k.json", "space")
    assert [*subwords.lean(task, tokenizers=True)([1, 2])] == [*subwords.lean(task)([1, 2])] == [1, 2]
    assert left == [1, 0]


def test_a_scan_takes_little_memory_and_finds_the_same():
    import tracemalloc

    from lectura.llm import repeats

    text = np.random.default_rng(1).integers(97, 101, 1 << 20).astype(np.uint8).tobytes()
    repeats.contexts([text[: 1 << 16]], 200)
    tracemalloc.start()
    got = repeats.contexts([text], 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20
    # every suffix that can have 200 bytes lies in one context
    assert sorted((np.repeat(got[1] - np.cumsum(got[2]) + got[2], got[2]) + np.arange(got[2].sum())).tolist()) == list(range(len(text) - 199))


def test_workers_of_every_stage_get_small_batches(spark, monkeypatch):
    import corpus_pipeline
    from lectura.llm.tables import BATCH_BYTES

    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)

    class Reached(Exception):
        pass

    def reached(*_, **__):
        seen.append(spark.conf.get(key))
        raise Reached

    for operator in ("identify", "near_duplicates", "without_repeats", "contamination", "pack"):
        monkeypatch.setattr(corpus_pipeline, operator, reached)
    try:
        docs = spark.range(2000).coalesce(1).selectExpr("id AS doc_id", "repeat('x', 10000) AS text")
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(key, before)
            try:
                stage(spark, docs, "/root/testdata/sf0.001")
            except Reached:
                pass
        assert seen == [str(BATCH_BYTES)] * 5
        sizes = lambda parts: (pa.RecordBatch.from_arrays([pa.array([p.nbytes])], ["n"]) for p in parts)
        sent = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(sent) > 20_000_000 and max(sent) < 2 * BATCH_BYTES
    finally:
        spark.conf.set(key, before)


def test_benchmark_search_takes_little_memory():
    import tracemalloc

    from lectura.llm.decontaminate import Benchmark, shard_matches, shards

    words = [f"w{i}" for i in range(500)]
    bench = Benchmark([(1, " ".join(words))], 13)
    texts = pa.array([" ".join(words[i % 400 : i % 400 + 100]) for i in range(16_000)], pa.binary())
    one = next(iter(shards(texts)))
    tracemalloc.start()
    n, found = shard_matches(texts[one].to_pylist(), bench)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(n) == {100} and len(found) == one.stop
    assert peak < 160 << 20


def test_signs_behind_letters_and_common_words_are_not_encoded_anew():
    own = subwords.UnitEncoder("byte_bpe_50k.json", "space", 64)
    texts = ["red green blue 12", "red green%%% blue*** 12), it's <|endoftext|>! x|> \nred, é%% a1$ ..."]
    asked, words = [], own._encode_words
    own._encode_words = lambda new: asked.extend(new) or words(new)
    ids = own.encode(texts)
    assert " green%%%" not in asked and " 12)," not in asked and "%%%" in asked
    assert ids == own._encode(texts)

    class Counted:
        def __init__(self, model):
            self.model, self.seen = model, []

        def tokenize(self, word):
            self.seen.append(word)
            return self.model.tokenize(word)

    own.model = counted = Counted(own.model)
    for i in range(40):
        texts = ["first common " + " ".join("word" + chr(97 + i % 26) + chr(97 + i // 26) + chr(97 + k) for k in range(20))]
        assert own.encode(texts) == own._encode(texts)
    assert sum(w.endswith("common") for w in counted.seen) == 1
