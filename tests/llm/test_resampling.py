"""Importance resampling against a plain version, and the position-table CRC against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from changeledger.llm import resampling
from changeledger.llm.queries import op11_resampling
from changeledger.llm.resampling import Features, PositionCrc, importance, resampled

SCHEMA = "doc_id long, text string, score string, `rank` int, gain int, place_ long, `a.b` string, row int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    """(doc_id, n_features, weight, score, rank) of rows (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in runs(t, longest))
    t = Counter(bucket(f) for x in target for f in runs(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + buckets)) / ((s[b] + 1.0) * (all_t + buckets))))
    out = []
    for doc_id, text in rows:
        found = [gain(bucket(f)) for f in runs(text, longest)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for rank, row in enumerate(able[:percent * len(able) // 100]):
        row[4] = rank + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus(seed=4, n=400):
    r = random.Random(seed)
    vocabulary = "Alpha beta gamma delta ÉCOLE école naïve x1 42 zeta eta theta iota kappa lambda".split()
    texts = [None, "", " .,\n", "one", "日本語 日本語,日本", "w" * 5_000 + " tail", "a" * 31 + " " + "b" * 32 + " " + "c" * 33 + " " + "d" * 64 + " " + "e" * 65]
    texts += [r.choice([" ", ", ", "_", "\x00"]).join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(n)]
    texts += [" ".join(r.choices(vocabulary, k=20_000))] + [texts[20]] * 5
    rows = list(enumerate(texts))
    return rows + [rows[30]] * 40 + [(None, texts[31]), (None, texts[32])]


TARGET = ["alpha beta école", None, "", "x1 x1 unseen words here", "gamma " * 50]


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3, "ab", 5) for i, t in corpus()], SCHEMA).repartition(4)
    return docs, spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")


def got(frame, offset=0):
    names = frame.columns[-4:]
    return sorted(((r["doc_id"], *(r[c] for c in names)) for r in frame.collect()), key=repr)


def test_crc_of_spans():
    r = random.Random(2)
    buffer = np.frombuffer(bytes(r.randrange(256) for _ in range(4_000)), np.uint8)
    for reach in (1, 4, 5, 32):
        lengths = np.array([1, 2, 3, 4, 5, 31, 32, 33, 64, 65, 2_000] + [r.randint(1, 90) for _ in range(300)])
        starts = np.array([r.randrange(4_000 - n) for n in lengths])
        want = [zlib.crc32(buffer[a:a + n].tobytes()) for a, n in zip(starts, lengths)]
        assert PositionCrc(reach).of(buffer, starts, lengths).tolist() == want
    assert len(PositionCrc().of(buffer, starts[:0], lengths[:0])) == 0


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_features_of_lots(longest, monkeypatch):
    monkeypatch.setattr(resampling, "BYTES_AT_ONCE", 300)
    monkeypatch.setattr(resampling, "FEATURES_AT_ONCE", 17)
    texts = [t for _, t in corpus(n=60)]
    found, n = [[] for _ in texts], [0] * len(texts)
    for start, counts, lots in Features(longest, 997).of(pa.array(["left out", *texts]).slice(1)):
        for i, count in enumerate(counts):
            n[start + i] = count
        for of_text, bucket in lots:
            for i, b in zip(of_text, bucket):
                found[start + i].append(int(b))
    for text, count, buckets in zip(texts, n, found):
        assert count == len(words(text))
        assert sorted(buckets) == sorted(zlib.crc32(f.encode()) % 997 for f in runs(text, longest))


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (2, 50, 37), (1, 10, 100), (1, 10, 0)])
def test_importance(frames, longest, buckets, percent):
    docs, target = frames
    result = importance(docs, target, longest=longest, buckets=buckets, percent=percent)
    assert result.columns == [*docs.columns, "n_words", "n_features", "weight", "score_", "rank_"]
    assert got(result) == plain(corpus(), TARGET, longest, buckets, percent)
    drawn = resampled(docs, target, longest=longest, buckets=buckets, percent=percent)
    assert drawn.columns == docs.columns
    assert drawn.count() == sum(r[4] is not None for r in plain(corpus(), TARGET, longest, buckets, percent))


def test_nothing_to_draw_from_or_towards(spark, frames):
    docs, target = frames
    assert importance(docs.limit(0), target).collect() == []
    assert got(importance(docs, target.limit(0))) == plain(corpus(), [])
    assert got(importance(docs.limit(0).union(docs.filter("text = 'one'")), target)) == plain([r for r in corpus() if r[1] == "one"], TARGET)


def test_query(spark, frames, tmp_path):
    docs, target = frames
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    target.write.parquet(str(tmp_path / "benchmark.parquet"))
    result = op11_resampling(spark, str(tmp_path))
    assert dict(result.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    assert got(result) == plain(corpus(), TARGET)
