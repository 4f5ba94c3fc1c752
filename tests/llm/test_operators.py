"""Every operator against a brute-force version on a small table with nulls, empty texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectura.llm import decontaminate, jaccard, packing, repeats, tables, token_counts, token_files
from lectura.llm.chat_format import fold, format_chats
from lectura.llm.decontaminate import contamination
from lectura.llm.language_id import identify, labelled_sample
from lectura.llm.subwords import UnitEncoder, path_of
from lectura.llm.topk import top_k
from lectura.llm.url_filter import judge_urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, key string, spans int, rank int, h int, label int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdéüß") for _ in range(r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    long, passage = words(400, 1), words(60, 2)
    out = [long, long, long.replace(" ", "  ", 1), long[:700] + "x" + long[701:], None, "", " \n", "a", "A b c", "a b c", words(40, 3) + "\n" + passage, passage + ". " + words(30, 4), "%%%", "é" * 900, "é" * 900 + "ü", "</s> <|endoftext|> [INST]\\", words(5000, 5)]
    out += [" ".join(w if i % 97 else "zz" for i, w in enumerate(long.split(" "), k)) for k in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", "s", "k", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_units_encode_like_the_tokenizer(texts):
    given = [t or "" for t in texts] + ["a\nb\nC,d.\nÉf x", "don't, it's  a. 12. 'ab,", "Σας ΣΑΣ. İx", "a\x1cb c"]
    for name, mode in (("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "dropped")):
        e = UnitEncoder(name, mode)
        want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(given, add_special_tokens=False)]
        assert e.encode(given) == want


def test_units_encode_random_unicode_like_the_tokenizer():
    r = random.Random(6)
    letters = list("aBİẞΣςé,.!?;: \n\t1中") + ["'s", "\x1c", "\u00a0", "e\u0301"] + [chr(r.choice([r.randint(0xC0, 0x24F), r.randint(0x370, 0x5FF), r.randint(0x1E00, 0x1FFF)])) for _ in range(60)]
    given = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(5000)] + ["İ,", "ẞİ,", "İ. \nς"]
    for name, mode in (("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "dropped")):
        e = UnitEncoder(name, mode)
        assert e.encode(given) == [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(given, add_special_tokens=False)]


def test_token_counts_and_splices(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path_of("piece_bpe_32k.model"))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, chunk=300, overlap=20).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}
    c = token_counts.PieceCounter("piece_bpe_32k.model", 60, 8)
    r = random.Random(3)
    odd = ["".join(r.choice(["a", "the", " ", "  ", "\n", "é", "ﬁ", "İ", "中", "😀", ".", "①", "abcdefgh" * 4]) + (" " if r.random() < 0.3 else "") for _ in range(r.randint(0, 200))) for _ in range(200)]
    assert c.counts(odd) == [len(sp.encode(t)) for t in odd]
    assert c.splices > 100 and c.widenings > 10
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_packing_places_every_token_once(spark, docs, texts):
    rows = packing.pack(docs).collect()
    by_sequence, total = {}, Counter()
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total[r.doc_id] += r.length
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    e = UnitEncoder("byte_bpe_50k.json", "space")
    assert total == {i: (len(e.encode([t or ""])[0]) // 4 + 1) * (2 if i == 0 else 1) for i, t in enumerate(texts)}
    assert packing.pack(empty(spark)).count() == 0


def test_packed_sequences_hold_the_tokens(spark, docs, texts):
    import corpus_pipeline

    e = UnitEncoder("byte_bpe_50k.json", "space")
    want = {i: e.encode([t or ""])[0] + np.array([1], "<u4").tobytes() for i, t in enumerate(texts)}
    sequences = packing.packed_sequences(docs).collect()
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    assert sum(len(s.ids) for s in sequences) == sum(map(len, want.values())) + len(want[0])
    for s in sequences:
        assert sum(p.length for p in s.pieces) == len(s.ids) // 4 <= 2048
        for p in s.pieces:
            assert s.ids[4 * p.offset : 4 * (p.offset + p.length)] == want[p.doc_id][4 * p.start : 4 * (p.start + p.length)]
    for r in corpus_pipeline.packing(spark, docs, "").collect():
        assert r.ids == want[r.doc_id][4 * r.start : 4 * (r.start + r.length)] and zlib.crc32(r.ids) == r.ids_crc32


def test_cutting_stock_meets_every_demand():
    weight, demand = np.array([3, 5, 7, 11, 16]), np.array([40, 33, 21, 18, 9])
    plan = packing.cutting_stock(weight, demand, 32)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * weight).sum() <= 32 for p, _ in plan)


def test_token_files_round_trip(spark, docs, texts, tmp_path):
    rows = sorted(token_files.token_files(docs, str(tmp_path / "t"), shard_ids=500).collect(), key=lambda r: r.start)
    e, at = UnitEncoder("word_bpe_49k.json", "dropped"), 0
    for r, i in zip(rows, sorted([*range(len(texts)), 0])):
        ids = e.encode([texts[i] or ""])[0] + np.array([1], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
    assert token_files.token_files(empty(spark), str(tmp_path / "e")).count() == 0


def test_wavelet_matrix_answers():
    ids = np.random.default_rng(3).integers(0, 900, 3000).astype(np.uint32)
    w = token_files.WaveletMatrix.load(token_files.WaveletMatrix.build(ids).dump())
    assert (w.ids() == ids).all()
    for i in (0, 1, 511, 512, 2999):
        assert w.access(i) == ids[i] and w.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    value = int(ids[7])
    assert [w.select(value, j) for j in range(w.count(value))] == np.flatnonzero(ids == value).tolist()


@pytest.mark.parametrize("together", [0, 300])
def test_repeats_like_brute_force(spark, docs, texts, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    raw = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    raw.append(raw[0])
    count = Counter(b[k : k + 200] for _, b in raw for k in range(len(b) - 199))
    want = {}
    for i, b in raw:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                hit[k : k + 200] = True
        want[i] = (len(b), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), bytes(x for x, h in zip(b, hit) if not h))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.without_repeats(docs).collect()}
    assert got == want
    assert repeats.without_repeats(empty(spark)).count() == 0


def test_hot_minimisers_and_crowded_cores(spark, docs, monkeypatch):
    want = {(r.doc_id, r.n_removed, r.n_spans) for r in repeats.without_repeats(docs).collect()}
    monkeypatch.setattr(tables, "HOT_ROWS", 1)
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in repeats.without_repeats(docs).collect()} == want
    monkeypatch.setattr(repeats, "TOGETHER", 2)
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in repeats.without_repeats(docs).collect()} == want


def test_repeat_groups_like_brute_force(spark):
    """Within a context, groups are maximal and have every occurrence: texts short enough to be one context or a few."""
    r = random.Random(11)
    a, b = ("".join(r.choice("abcd") for _ in range(260)) for _ in range(2))
    texts = [a, "x" + a[:230], a[10:], "zz" + a[20:250] + "q", b, b[:-1] + "!", "u" + b]
    length = 200
    found = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            for n in range(length, len(t) - k + 1):
                found.setdefault(t[k : k + n], set()).add((i, k))
    at = lambda s, where, step: {texts[i][k + step] if 0 <= k + step < len(texts[i]) else (i, k) for i, k in where}
    maximal = {s: w for s, w in found.items() if len(w) > 1 and len(at(s, w, -1)) > 1 and len(at(s, w, len(s))) > 1}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r.key: r.doc_id for r in df.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()}
    groups = {}
    for r in repeats.repeat_groups(df, length).collect():
        groups.setdefault(r.group, set()).add((keys[r.key], r.start, r["size"]))
    for own in groups.values():
        texts_of = {texts[i][k : k + n] for i, k, n in own}
        assert len(texts_of) == 1 and len(own) > 1  # one string
        assert {(i, k) for i, k, _ in own} == found[texts_of.pop()]  # wherever it stands
    covered = lambda spans: {(i, p) for i, k, n in spans for p in range(k, k + n)}
    assert covered(x for own in groups.values() for x in own) == covered((i, k, len(s)) for s, w in maximal.items() for i, k in w)


def test_near_duplicates_like_brute_force(spark, docs, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    least = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {i: (len(s), least[i]) for i, s in enumerate(sets)}
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_many_near_copies_like_brute_force(spark, monkeypatch):
    """Near copies on both sides of the threshold, with missing doc_ids; with keys counted as hot the result is the same."""
    r = random.Random(2)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (5, 9, 20, 40, 60, 80, 120, 200, 30, 3, 70):
        base = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(95):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 14))):
                w[r.randrange(n)] = r.choice(vocabulary)
            texts.append(" ".join(w))
    sets = [{tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} for w in map(str.split, texts)]
    least = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and least[a] != least[b]:
                x, y = sorted((least[a], least[b]))
                least = [x if c == y else c for c in least]
    lost = {i for i in range(len(texts)) if i % 10 == 3 and least[i] != i}  # these have no doc_id
    df = spark.createDataFrame([(None if i in lost else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, sig long").repartition(5)
    hashes = {x.h: x.sig for x in df.select("sig", F.xxhash64("text").alias("h")).collect()}
    for rows in (10_000, 1):
        monkeypatch.setattr(tables, "HOT_ROWS", rows)
        monkeypatch.setattr(jaccard, "TOGETHER", rows)
        found = jaccard.near_duplicates(df).collect()
        assert len(found) == len(texts)
        assert all(x.component_id == least[hashes[x.text_hash]] for x in found)


def test_contamination_like_brute_force(spark, docs, texts, monkeypatch):
    items = [(1, texts[10]), (2, "a b"), (3, None), (4, "%%"), (None, "x y z"), (5, texts[0][:150]), (5, texts[0][:150])]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).update([str(i)] if i else [])
    want = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for win, own in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= own
        want[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(docs, bench).collect()}
    assert got == want
    assert contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", 100)  # in parts
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(docs, bench).collect()} == want


def test_longest_matches_like_brute_force(spark):
    r = random.Random(8)
    item = [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(60)]
    docs = [item[5:40] + ["zz"] + item[30:50], ["q"] + item, item[:12], item[20:35] * 2]
    want = set()
    for d, w in enumerate(docs):
        for p in range(len(w)):
            for q in range(len(item)):
                if w[p] == item[q] and (p == 0 or q == 0 or w[p - 1] != item[q - 1]):
                    n = 0
                    while p + n < len(w) and q + n < len(item) and w[p + n] == item[q + n]:
                        n += 1
                    if n >= 13:
                        want.add((d, "7", q, p, n))
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {(r.doc_id, m["item"], m["item_start"], m["start"], m["words"]) for r in contamination(df, bench).collect() for m in r.matches}
    assert got == want and len(want) >= 5


def test_language_is_learnt_and_odd_texts_are_rejected(spark):
    kinds = {"xx": "abcde ", "yy": "vwxyz "}
    rows = []
    for i in range(300):
        lang = ("xx", "yy")[i % 2]
        rows.append((i, "".join(random.Random(i).choices(kinds[lang], k=300)), lang))
    rows += [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 %%", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(df, df.filter("doc_id % 5 <> 0")).collect()}
    assert np.mean([got[i].lang_pred == rows[i][2] for i in range(0, 300, 5)]) >= 0.98
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (1000, 1001, 1002))
    assert np.mean([got[i].rejected for i in range(300)]) <= 0.02
    assert identify(df.limit(0)).count() == 0


def test_languages_of_held_out_documents(spark):
    from lectura.llm.queries import op6_language_id

    sf = "/root/testdata/sf0.01"
    told = op6_language_id(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").filter("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert len(told) > 100 and np.mean([r.lang == r.lang_pred for r in told]) >= 0.97
    assert np.mean([r.rejected for r in told]) <= 0.03


def test_the_labelled_sample_is_bounded(spark):
    """Rows of one doc_id, or equal rows, are drawn like others."""
    same = spark.createDataFrame([(7, "abc abc", "xx")] * 500 + [(None, f"text {i}", "yy") for i in range(500)], "doc_id long, text string, lang string")
    texts, langs = labelled_sample(same, 20, 100, 500)
    assert Counter(langs) == {"xx": 20, "yy": 20} and len(texts) == 40
    assert Counter(labelled_sample(same, 20, 100, 1)[1]) == {"xx": 20}


def test_foreign_texts_and_junk_with_letters_are_rejected(spark):
    kinds = {"ww": "abcd ", "xx": "efgh ", "yy": "ijkl ", "zz": "mnop "}
    known = [(i, "".join(random.Random(i).choices(kinds[lang], k=300)), lang) for i, lang in enumerate(sorted(kinds) * 100)]
    blank = [(500 + i, "A", "ww") for i in range(60)]  # labelled, but without a subword
    foreign = [(700 + i, "".join(random.Random(i).choices("qrstuv ", k=300)), None) for i in range(20)]
    junk = [(800, "".join(random.Random(9).choices("QX0123456789#$%", k=200)), None), (801, "Быстрая лиса прыгает через собаку", None)]
    df = spark.createDataFrame(known + blank + foreign + junk, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in identify(df).collect()}
    assert all(got[i] for i, _, _ in foreign + junk)
    assert np.mean([got[i] for i, _, _ in known]) <= 0.02


def test_top_k_like_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)]) for i in range(200)]
    rows += [(200, rows[3][1]), (201, None), (202, [None] * 8), (203, [float("nan")] * 8), (204, [1.0] * 7), (205, []), (3, rows[3][1]), (3, rows[9][1]), (50, rows[7][1]), (None, rows[1][1])]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, row int, score int")
    v = [(i, np.floor(1024 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows if i is not None and e is not None and None not in e and not np.isnan(e).any()]
    want = []
    for n, (q, own) in enumerate(v):
        if q % 50 == 0:  # each row of a vec_id is a query, and a candidate of the others
            best = sorted((-int(own @ e), c, m) for m, (c, e) in enumerate(v) if m != n and len(e) == len(own))[:10]
            want += [(q, k + 1, c, -score) for k, (score, c, _) in enumerate(best)]
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in top_k(df, F.col("vec_id") % 50 == 0, chunk=32, block=2).collect())
    assert got == sorted(want)
    assert top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_chat_logs_fold_and_read_back(spark):
    log = [(1, 1, "message", None, "user", "hi"), (1, 2, "message", None, "assistant", "wr"), (1, 3, "delta", 2, "assistant", "ong"), (1, 4, "regenerate", 2, None, None), (1, 5, "delta", 2, "assistant", "go"), (1, 6, "delta", 2, "assistant", "od"), (1, 7, "edit", 1, "user", "hello"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, target long, role string, text string")
    got = {(r.conv_id, r.number): (r.role, r.text) for r in fold(df).collect()}
    assert got == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "good"), (None, None): ("", "")}
    row = format_chats(df).filter("conv_id = 1").first()
    assert [row.formatted[s.start : s.start + s.length] for s in row.loss_spans] == ["good"]
    assert format_chats(df.limit(0)).count() == 0


def test_urls_get_rules_and_templates(spark):
    rows = [(i, f"https://A.com/x/{i}?q") for i in range(60)] + [(i, f"http://a.com/bad{'' if i % 2 else 'ly'}/{i}") for i in range(60, 120)]
    rows += [(200, None), (201, "nothing"), (202, "http://sub.org/es/"), (203, "http://m.example.com/en/77#x"), (204, "http://example.net/de/85")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i >= 60) for i in range(120)] + [(5, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in judge_urls(pages, labels).collect()}
    assert len(got) == len(rows) and (got[200].host, got[201].path) == ("", "")
    assert (got[202].rule, got[202].verdict) == ("org/es/", "block") and got[203].rule == "example.com/en/7" and got[204].rule == "example.net/de/8"
    assert got[3].host == "a.com" and got[3].verdict == "allow" and got[99].verdict == "block" and got[98].verdict == "block"
    assert judge_urls(pages.limit(0), labels).count() == 0


def unlike(labelled, bad, all_labelled, all_bad, z=2.0):
    rest, rest_bad, share = all_labelled - labelled, all_bad - bad, (all_bad + 1) / (all_labelled + 2)
    gap = (bad + share) / (labelled + 1) - (rest_bad + share) / (rest + 1)
    return abs(gap) > z * (share * (1 - share) * (1 / (labelled + 1) + 1 / (rest + 1))) ** 0.5, gap > 0


def templates(paths, level=0):
    """paths: {segments: (pages, labelled, bad)} of one template; the template's rest for each."""
    if len(paths) == 1:
        return {p: "".join(f"/{s}" for s in p[level:]) for p in paths}
    total = lambda rows: [sum(c) for c in zip(*rows)]
    children = {}
    for p, row in paths.items():
        children.setdefault(p[level] if level < len(p) else "", []).append((p, row))
    of_all, sums = total(paths.values()), {seg: total(r for _, r in own) for seg, own in children.items()}
    sort = {}
    for seg, (n, labelled, bad) in sums.items():
        differs, worse = unlike(labelled, bad, *of_all[1:])
        sort[seg] = "fixed" if seg == "" or seg.startswith("{") or n == of_all[0] else "*" if not differs else "*+" if worse else "*-"
    branches = {}
    for seg, (n, labelled, bad) in sums.items():
        peers = [sums[x] for x in sums if sort[x] == sort[seg]]
        own = sort[seg] == "fixed" or sort[seg] != "*" and (len(peers) == 1 or unlike(labelled, bad, *total(peers)[1:])[0])
        branches.setdefault(seg if own else sort[seg], {}).update(dict(children[seg]))
    out = {}
    for branch, own in branches.items():
        out |= {p: "" for p in own} if branch == "" else {p: f"/{branch}{rest}" for p, rest in templates(own, level + 1).items()}
    return out


def test_templates_like_a_plain_tree(spark):
    r = random.Random(12)
    rows, labels = [], {}
    for i in range(1500):
        host = r.choice(["h.com", "i.org"])
        segs = [r.choice(["news", "blog", "spam", "junk", "*", "{n}"])] + [r.choice(["a", "b", "c", str(r.randint(1, 99)), "deadbeef01"]) for _ in range(r.randint(0, 4))]
        rows.append((i, f"http://{host}/" + "/".join(segs)))
        if r.random() < 0.6:
            labels[i] = r.random() < (0.9 if segs[0] in ("spam", "junk") or "b" in segs[1:2] else 0.1)
    rows += rows[:3]
    pages = spark.createDataFrame([(*x, 1, 2) for x in rows], "page_id long, url string, n int, bad int")
    got = judge_urls(pages, spark.createDataFrame(list(labels.items()), "page_id long, bad boolean")).collect()
    shape = lambda s: "{n}" if s.isdigit() else "{id}" if re.fullmatch("[0-9a-fA-F-]{8,}", s) and re.search("[0-9]", s) else "\\" + s if s[0] in "*{" else s
    cut = lambda url: (url.split("/")[2], tuple(shape(s) for s in url.split("/")[3:] if s))
    by_host = {}
    for i, url in rows:
        host, segs = cut(url)
        row = by_host.setdefault(host, {}).setdefault(segs, [0, 0, 0])
        row[0], row[1], row[2] = row[0] + 1, row[1] + (i in labels), row[2] + bool(labels.get(i))
    want = {(host, segs): t for host, paths in by_host.items() for segs, t in templates(paths).items()}
    assert len(got) == len(rows)
    for x in got:
        assert x.template == want[cut(dict(rows)[x.page_id])], x
    shares = {}
    for (host, segs), t in want.items():
        row = shares.setdefault((host, t), [0, 0])
        row[0], row[1] = row[0] + by_host[host][segs][1], row[1] + by_host[host][segs][2]
    base = sum(b for _, b in shares.values()) / sum(n for n, _ in shares.values())
    for x in got:
        n, bad = shares[x.host, x.template]
        assert x.badness == pytest.approx((bad + 10 * base) / (n + 10)) and x.verdict == ("block" if x.badness > 0.6 else "allow")
    assert {"block", "allow"} == {x.verdict for x in got}


def test_templates_reach_the_last_segment_and_small_branches(spark):
    deep = [(i, f"http://d.com/a/b/c/d/{'good' if i % 2 else 'bad'}/x/{i}") for i in range(80)]
    small = [(i, f"http://s.com/{'spam' if i < 119 else 'news'}/p{i}") for i in range(100, 300)]
    # branches without labels stay with their host's: here every label is bad
    blind = [(i, f"http://b.com/t{i}") for i in range(300, 400)]
    pages = spark.createDataFrame(deep + small + blind + [(400, "http://l.com/" + "s/" * 300), (401, "http://l.com/x")], "page_id long, url string")
    labels = [(i, i % 2 == 0) for i, _ in deep] + [(i, i < 119) for i, _ in small] + [(i, True) for i in range(300, 350)] + [(i, False) for i in range(900, 1000)]
    got = {r.page_id: r for r in judge_urls(pages, spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert {i: got[i].verdict for i, _ in deep} == {i: "allow" if i % 2 else "block" for i, _ in deep}
    assert got[0].template == "/a/b/c/d/bad/x/{n}"
    assert {i: got[i].verdict for i, _ in small} == {i: "block" if i < 119 else "allow" for i, _ in small}
    assert {got[i].template for i, _ in blind} == {"/*"} and {got[i].verdict for i, _ in blind} == {"block"}
    assert got[400].template == "/*/*" + "/s" * 298
