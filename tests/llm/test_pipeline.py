"""Every stage of the pipeline against a brute-force version, on a table with nulls, empty texts, repeated rows and shared doc_ids."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectura.llm.subwords import path_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KINDS = {"aa": "abcdefé", "bb": "ghijklü"}


def prose(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(KINDS[lang]) for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, prose(lang, r.randint(30, 120), i), lang, "s", 0) for i, lang in enumerate(sorted(KINDS) * 60)]
    passage, item = prose("aa", 70, "p"), prose("bb", 30, "b")
    out += [(200 + i, prose("aa", 40, 200 + i) + " " + passage + " " + prose("aa", 20, 300 + i), "aa", "s", 0) for i in range(6)]
    out += [(300 + i, out[i][1] if i % 2 else out[i][1] + " ab", "aa", "s", 0) for i in range(4)]
    out += [(310, item, "bb", "s", 0), (311, prose("bb", 20, "c") + " " + item, "bb", "s", 0), (312, prose("bb", 900, "d") + " " + " ".join(item.split()[:13]), "bb", "s", 0)]
    out += [(320, prose("bb", 15, "e") + " " + " ".join(item.split()[:20]), "bb", "s", 0)]
    out += [(0, prose("aa", 50, "other"), None, "s", 0), (None, out[7][1], None, None, None), (None, prose("bb", 44, "n"), None, None, None), out[5], out[5]]
    out += [(400, None, None, None, None), (401, "", None, "s", 0), (401, "", None, "s", 0), (402, "12 %% 34", None, "s", 0), (403, "qrstuv wxyz qqrs tuvw xyzz", None, "s", 0)]
    out += [(500, prose("bb", 9000, "long"), "bb", "s", 0)]
    return [(*x[:4], None if x[1] is None else len(x[1])) for x in out]


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):
    """The input of every stage and its output, each written and read again."""
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(1, prose("bb", 30, "b")), (2, None), (None, prose("aa", 20, "x"))], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs, seen = spark.createDataFrame(rows, DOCS).repartition(3), []
    for name, stage in corpus_pipeline.STAGES:
        seen.append((name, docs.collect()))
        stage(spark, docs, str(folder)).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
    return dict(seen) | {"done": docs.collect()}


def words(text, shingle=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()


def test_documents_of_no_known_language_go(stages, rows):
    kept = Counter((r.doc_id, r.text) for r in stages["near_duplicate"])
    gone = [x for x in rows if not kept[x[0], x[1]]]
    assert {400, 401, 402, 403} <= {x[0] for x in gone}
    assert sum(x[2] is not None for x in gone) <= 4 and not kept - Counter((x[0], x[1]) for x in rows)


def test_one_document_of_each_group_stays(stages):
    given = stages["near_duplicate"]
    distinct = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in given})
    sets = [words(t) for _, _, t in distinct]
    group = list(range(len(distinct)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    got = [(r.doc_id, r.text) for r in stages["repeated_passages"]]
    assert len(got) == len(set(group)) == len(set(got))
    at = {(None if none else d, t): group[i] for i, (none, d, t) in enumerate(distinct)}
    assert sorted(at[x] for x in got) == sorted(set(group))
    named = {g: min((d[0], d[1]) for d, h in zip(distinct, group) if h == g) for g in group}
    assert {(d is None, d or 0) for d, _ in got} == set(named.values())


def test_repeated_passages_are_cut_at_whole_characters(stages):
    given = [(r.doc_id, (r.text or "").encode()) for r in stages["repeated_passages"]]
    count = Counter(b[k : k + 200] for _, b in given for k in range(len(b) - 199))
    want = []
    for doc_id, b in given:
        hit = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                hit[k : k + 200] = True
        kept, at = b"", 0
        for c in b.decode():  # a character goes if all its bytes are hit
            n = len(c.encode())
            if not hit[at : at + n].all():
                kept += c.encode()
            at += n
        want.append((doc_id, kept.decode()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in stages["benchmark_passages"]) == sorted((d is None, d or 0, t) for d, t in want)
    assert all(r.n_chars == len(r.text) for r in stages["benchmark_passages"])
    assert any(len(t.encode()) < len(b) for (_, t), (_, b) in zip(want, given))


def test_contaminated_documents_go(stages):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 13]) for t in (prose("bb", 30, "b"), prose("aa", 20, "x")) for w in [split(t)] for k in range(len(w) - 12)}
    want = Counter()
    for r in stages["benchmark_passages"]:
        w, hit = split(r.text), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in windows:
                hit.update(range(k, k + 13))
        if not hit or 20 * len(hit) < len(w):
            want[r.doc_id, r.text] += 1
    assert Counter((r.doc_id, r.text) for r in stages["packing"]) == want
    kept = {r.doc_id for r in stages["packing"]}
    assert 312 in kept and 320 not in kept and 320 in {r.doc_id for r in stages["benchmark_passages"]}


def test_packed_pieces_are_the_tokenizers_ids(stages):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path_of("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids) + (1,)) for r in stages["packing"])
    pieces, got, by_sequence = {}, Counter(), {}
    for r in stages["done"]:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (doc_id, n), own in pieces.items():  # here no two documents share doc_id and length
        ids = [i for _, part in sorted(own) for i in part]
        assert len(ids) == n
        got[doc_id, tuple(ids)] += 1
    assert got == want
    for own in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048


def test_an_empty_corpus_passes(spark, tmp_path):
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0
