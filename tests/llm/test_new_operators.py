"""Operators 11 to 13 against brute-force versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectura.llm import resampling, warc
from lectura.llm.periodic import periodic_runs, runs_of
from lectura.llm.queries import with_periodic_tails
from lectura.llm.resampling import resample
from lectura.llm.warc import archived, read_warc, records_in, write_warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, n_words int, runs int, weight int, slice int, start int"


def words(n, seed, letters="abcdé"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(n))


def runs_by_hand(w, power, least):
    out = []
    for p in range(1, len(w) // power + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            s = w[i : j + p]
            if len(s) >= max(least, power * p) and not any(s[q:] == s[:-q] for q in range(1, p)):
                out.append((i, len(s), p))
            i = max(j, i + 1)
    return sorted(out)


def collapsed_by_hand(w, runs):
    gone = {k for i, n, p in runs for k in range(i + p, i + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_of_small_alphabets():
    r = random.Random(1)
    for _ in range(300):
        texts = []
        for _ in range(r.randint(1, 6)):
            k = r.choice([1, 2, 3, 5])
            w = [r.randrange(k) for _ in range(r.choice([0, 1, 2, 5, 30, 80]))]
            unit = [r.randrange(k + 1) for _ in range(r.randint(1, 9))]
            at = r.randint(0, len(w))
            w = w[:at] + (unit * 60)[: r.randint(0, 60)] + w[at:]
            texts.append(w * 3 + w[: r.randint(0, len(w))] if r.random() < 0.3 else w)
        power, least = r.choice([(3, 24), (2, 4), (3, 6), (2, 2)])
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = list(zip(*(x.tolist() for x in runs_of(np.array(sum(texts, []), np.int64), starts, power, least))))
        assert got == [(i, *x) for i, t in enumerate(texts) for x in runs_by_hand(t, power, least)]


def test_periodic_runs_over_a_table(spark):
    unit = words(7, 2)
    texts = [None, "", " \n\t", "a", "a " * 24, "a " * 23, words(50, 3) + " " + f"{unit} " * 5 + words(20, 4), f"{unit} " * 3, f"{unit}\v" * 4 + "x\x1cy", "b a " * 40, "é ü " * 500, words(2000, 5)]
    rows = [(i, t, 1, 2, 3, 4, 5) for i, t in enumerate(texts)] + [(4, "a " * 24, 1, 2, 3, 4, 5), (None, "a " * 30, 1, 2, 3, 4, 5)]
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed).decode()) for r in periodic_runs(spark.createDataFrame(rows, DOCS).repartition(3)).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = runs_by_hand(w, 3, 24)
        want.append((i, len(w), runs, collapsed_by_hand(w, runs)))
    assert got == want and sum(len(x[2]) for x in got) > 5
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_periodic_tails(spark):
    docs = [(i, words(i % 90, i)) for i in range(400)] + [(1, None), (None, "a b")]
    got = {(r.doc_id, r.text) for r in with_periodic_tails(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = set()
    for i, t in docs:
        w, h = (t or "").split(), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
        want.add((i, t))
    assert got == want


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def drawn_by_hand(docs, target):
    each = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out = []
    for (i, text), (n, f) in zip(docs, each):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fits = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = {}
    for k, r in enumerate(fits[: 25 * len(fits) // 100], 1):
        ranks.setdefault((r[0], *r[2:]), []).append(k)
    return out, ranks


@pytest.mark.parametrize("shard", [4 << 20, 300])
def test_resampling(spark, monkeypatch, shard):
    monkeypatch.setattr(resampling, "SHARD_BYTES", shard)
    target = [words(60, s, "abc") for s in range(8)] + [None, ""]
    docs = [(i, words(random.Random(i).randint(0, 60), i, "abcdé" if i % 3 else "abc")) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "ÉA Éa éa " * 30), (903, "q" * 300 + " w " + "r" * 70), (904, words(20000, 9)), (None, words(40, 7))] + [(7, docs[7][1])] * 3 + [(905, "a a " * 40)] * 9
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in docs], DOCS).repartition(4)
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample(df, bench).collect()
    want, ranks = drawn_by_hand(docs, target)
    plain = lambda rows: sorted(map(repr, rows))
    assert plain([r.doc_id, r.n_words, r.n_features, r.weight, r.score] for r in got) == plain(want)
    seen = {}
    for r in got:
        if r["rank"] is not None:
            seen.setdefault((r.doc_id, r.n_features, r.weight, r.score), []).append(r["rank"])
    assert {k: sorted(v) for k, v in seen.items()} == ranks
    assert sum(len(v) for v in ranks.values()) > 40


def test_resampling_of_nothing(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "text string")
    assert resample(docs, bench).count() == 0
    one = resample(spark.createDataFrame([(1, words(30, 1)), (2, None)], "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r["rank"]) for r in one) == [(1, None), (2, None)]


def pages():
    same, small = "<p>" + "é" * 600, "x" * 999
    rows = [(k, f"http://h/{k}", same) for k in (3, 9, 5)] + [(9, "http://h/9", same), (1, "http://h", small), (2, "http://h", small)]
    rows += [(10, None, None), (11, "", ""), (12, "http://h/\r\nWARC-Type: x y", "\r\n\r\nWARC/1.1\r\n\r\n" * 99), (13, "u", words(200000, 1)), (None, "n", "z" * 1000), (None, "n", "z" * 1000), (None, "n", same)]
    return rows + [(100 + k, f"http://h/{k}", words(300 + k, k)) for k in range(60)]


def pages_by_hand(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [j for j, _, h in rows if h == html and j is not None] if len(data) >= 1000 else []
        first = max(ids, default=i)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("split", "file", "broadcast"), [(1 << 26, 1 << 30, 500_000), (9_000, 1 << 30, 500_000), (100_000, 20_000, 0)])
def test_archives_come_back(spark, monkeypatch, tmp_path, split, file, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    df = spark.createDataFrame([(*r, 1, "x") for r in pages()], "page_id long, url string, html string, payload_bytes int, file string").repartition(2)
    got = archived(df, str(tmp_path), file_bytes=file, split_bytes=split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in got), key=repr) == pages_by_hand(pages())
    urls = {r.page_id: r.target_uri for r in got}
    assert urls[10] is None and urls[11] == "" and urls[12] == "http://h/%0D%0AWARC-Type:%20x%20y"
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in tmp_path.glob("*.warc.gz"))
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(got)


def test_no_pages_and_damaged_archives(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archived(none, str(tmp_path / "none")).count() == 0
    write_warc(spark.createDataFrame([(k, "u", words(400, k)) for k in range(20)], "page_id long, url string, html string").coalesce(1), str(tmp_path / "one"))
    path = next((tmp_path / "one").glob("*.warc.gz"))
    good, data = read_warc(spark, str(tmp_path / "one")).count(), bytearray(path.read_bytes())
    assert good == 20
    at = data.find(b"\x1f\x8b\x08", len(data) // 2)
    data[at + 200] ^= 255  # a record in the middle no longer has its checksum
    path.write_bytes(bytes(data[:-5]))  # and the last one no end
    for split in (1 << 26, 300):
        assert read_warc(spark, str(tmp_path / "one"), split_bytes=split).count() >= 17


def test_magic_inside_a_record_starts_no_record(tmp_path):
    inner = warc.record(1, "u", b"inner", "0", True, None)
    block = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored as it is, so that the inner members stand in the file
    outer = pack.compress(head + block + b"\r\n\r\n") + pack.flush()
    data = outer + warc.record(2, "u", b"next", "0", True, None)
    (tmp_path / "f").write_bytes(data)
    for step in (40, 64, 1000):
        with open(tmp_path / "f", "rb") as f:
            offsets = [at for start in range(0, len(data), step) for at, _, _ in records_in(f, len(data), start, start + step)]
        assert offsets == [0, len(outer)]
