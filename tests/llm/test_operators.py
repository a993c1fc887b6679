"""Each operator against a plain version on small tables that hold every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changeledger.llm import bpe, brown, caps, contamination, line_runs, mixing, quality, shards, simhash, toxicity
from changeledger.llm.common import settle, shared_folder

VOCABULARY = "alpha beta gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
SCHEMA = "doc_id long, text string, lang string, source string, size int, score string, shard int, row int, key string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def corpus(seed=1, n=60):
    """Texts with NULLs, empty and blank ones, copies, near copies, repeated rows and ids, a long text, a hot source."""
    r = random.Random(seed)
    line = lambda k: " ".join(r.choices(VOCABULARY, k=k))
    shared = [line(12), line(3), line(15) + "\n" + line(4), line(30)]
    texts = [None, "", "   \n\t ", "x", "one two", "ÀÉ ünïcode ÀÉ ünïcode words here", "\U0001d49c \U0001f600 a b　c"]
    for i in range(n):
        parts = [line(r.randint(1, 14)) for _ in range(r.randint(1, 6))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        if i % 11 == 0:
            parts += ["", parts[0], parts[0]]
        texts.append("\n".join(parts))
    base = line(200)
    texts += [base, base, base + " more", base.replace("alpha", "beta", 1), line(4000), texts[9], texts[9].upper()]
    rows = [(i, t, "en", r.choice([None, "s1", "s2", "s3", "s3", "s3", ""]), i, "x", i, i, "k") for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, base, "en", "s1", 0, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return settle(spark.createDataFrame(corpus(), SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_settled_frames_are_in_the_shared_folder(spark, docs):
    assert docs.inputFiles()[0].startswith(shared_folder(spark).replace("file:/", "file:///").split("///")[0])
    assert docs.count() == len(corpus())


# ---------------------------------------------------------------- contamination

ITEMS = [(1, None), (2, ""), (3, "?!"), (4, "omicron pi"), (5, "Alpha, beta. gamma"), (5, "iota nu xi"), (6, "xi"), (7, "one two"), (8, "one TWO")]


def plain_contamination(rows, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = word(text)
        if w:
            n = min(10, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i:i + n])].add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = word(text), set(), set()
        for window, owners in windows.items():
            n = len(window)
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) == window:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return out


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination(spark, docs, limit, monkeypatch):
    monkeypatch.setattr(contamination, "MOST_BROADCAST", limit)  # both joins
    rows = [(r[0], r[1]) for r in corpus()]
    items = ITEMS + [(10 + i, t[5:400]) for i, (_, t) in enumerate(rows) if t and i % 7 == 0]
    benchmark = spark.createDataFrame([(i, t, i) for i, t in items], "item_id long, text string, row int")
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in contamination.contamination(docs, benchmark).collect()]
    assert same(got, plain_contamination(rows, items))
    assert any(r[2] for r in got) and not all(r[2] for r in got)


def test_contamination_of_and_by_nothing(spark, docs, empty):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination.contamination(empty, benchmark).count() == 0
    clean = contamination.contamination(docs, benchmark.limit(0))
    assert clean.count() == docs.count() and clean.filter("n_hit > 0").count() == 0
    assert contamination.without_benchmark(docs, benchmark.limit(0)).columns == docs.columns


def test_contaminated_rows_go(spark, docs):
    benchmark = spark.createDataFrame([(1, "one two"), (2, corpus()[12][1])], "item_id long, text string")
    kept = contamination.without_benchmark(docs, benchmark)
    rows = [(r[0], r[1]) for r in corpus()]
    bad = [r for r in plain_contamination(rows, [(1, "one two"), (2, corpus()[12][1])]) if r[2]]
    assert kept.count() == len(rows) - len(bad) and kept.columns == docs.columns


# ---------------------------------------------------------------------- shards

def plain_capacity(sizes, shards_):
    low, high = max([*sizes, -(-sum(sizes) // shards_)], default=0), sum(sizes)
    while low < high:
        middle, used, room = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > room:
                used, room = used + 1, middle
            room -= s
        low, high = (low, middle) if used <= shards_ else (middle + 1, high)
    return low


@pytest.mark.parametrize("n", [1, 3, 16])
def test_shards(docs, n):
    rows = [r.asDict() for r in shards.shard_rows(docs, n).collect()]
    want = Counter((r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    texts = {r[0]: r[1] for r in corpus() if r[0] is not None}
    of_text, sizes, totals = defaultdict(set), Counter(), Counter()
    for r in rows:
        totals[r["shard"]] += r["size"]
        if r["doc_id"] is not None:
            of_text[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in of_text.values()) and set(totals) <= set(range(n))
    for r in corpus():
        key = "" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()
        sizes[key] += len((r[1] or "").encode()) + 1
    assert max(totals.values()) == plain_capacity([sizes[k] for k in sorted(sizes)], n)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_many_groups_refine_cells(spark, monkeypatch):
    monkeypatch.setattr(shards, "FIRST", 1)
    rows = spark.range(3000).select("id", F.concat(F.lit("t"), F.repeat(F.lit("x"), F.pmod(F.col("id") * 37, F.lit(200)).cast("int")), F.col("id").cast("string")).alias("text"))
    totals = [r[1] for r in shards.shard_rows(rows, 16, "id").groupBy("shard").agg(F.sum("size")).collect()]
    sizes = [(r.k, r.s) for r in rows.select(F.md5("text").alias("k"), (F.octet_length("text") + 1).alias("s")).collect()]
    assert max(totals) == plain_capacity([s for _, s in sorted(sizes)], 16) and len(totals) == 16


def test_shards_of_nothing_and_of_one_text(spark, empty):
    assert shards.shard_rows(empty).count() == 0
    one = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")
    assert [(r[0], r[1]) for r in shards.shard_rows(one, 4).groupBy("shard").count().collect()] == [(0, 50)]


# ---------------------------------------------------------------------- mixing

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left, weights = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / weights > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / weights for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= set(over)


def test_targets(spark):
    r = random.Random(5)
    for _ in range(12):
        sizes = {s: r.choice([0, 1, 5, 40, 1000, 10 ** 6]) for s in r.sample([None, "", "a", "B", "ß", "z", "\U0001f600", "�"], r.randint(1, 8))}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.targets(frame).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mixing(docs, empty):
    rows = mixing.mix_documents(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((r[0], r[3], len(words(r[1]))) for r in corpus())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 3
    want = plain_targets(sizes)
    for r in rows:
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source]
        # whole epochs come first
        assert r.copies in (int(r.target // max(1, r.source_size)), int(r.target // max(1, r.source_size)) + 1)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert same(rows, mixing.mix_documents(docs.repartition(5)).collect())
    copied = mixing.repeated(docs)
    assert copied.columns == docs.columns and copied.count() == sum(r.copies for r in rows)
    assert Counter(r.doc_id for r in copied.collect()) == sum((Counter({r.doc_id: r.copies}) for r in rows), Counter())
    assert mixing.mix_documents(empty).count() == 0 and mixing.repeated(empty).count() == 0


def test_better_documents_are_taken_more_often(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"),
                                    F.pow(mixing.uniform(F.col("id")), 1 / F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5)).alias("key"), (F.col("id") % 2).alias("odd"))
    other = spark.range(4000).select((F.col("id") + 4000).alias("doc_id"), F.lit("t").alias("source"), F.lit(40).cast("long").alias("size"), mixing.uniform(F.col("id")).alias("key"), F.lit(0).cast("long").alias("odd"))
    both = rows.union(other)
    got = mixing.with_copies(both, mixing.limits(both, 64), F.col("source"), F.col("key"), 64).filter("source = 't'").agg(F.sum("copies")).first()[0]
    assert got > 0
    halves = {r[0]: r[1] for r in mixing.with_copies(rows.union(other), mixing.limits(both, 64), F.col("source"), F.col("key"), 64)
              .filter("source = 's'").groupBy("odd").agg(F.sum("copies")).collect()}
    assert halves[0] >= halves[1]


# --------------------------------------------------------------------- simhash

def plain_fingerprint(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, most=3):
    """prints: (doc_id, fingerprint); component by the smallest doc_id."""
    out, left = {}, dict.fromkeys(p for _, p in prints)
    while left:
        found, queue = set(), [next(iter(left))]
        while queue:
            x = queue.pop()
            if x in left:
                del left[x]
                found.add(x)
                queue += [y for y in left if (x ^ y).bit_count() <= most]
        ids = [d for d, p in prints if p in found and d is not None]
        out |= dict.fromkeys(found, min(ids) if ids else None)
    return [(d, p, out[p]) for d, p in prints]


def test_simhash(docs, empty):
    want = plain_components([(r[0], plain_fingerprint(r[1])) for r in corpus()])
    got = [(r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.simhash_groups(docs).collect()]
    assert same(got, want) and len({c for _, _, c in want}) < len(want) - 5
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert simhash.simhash_groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_links_of_fingerprints(spark, block, monkeypatch):
    """Chains, dense groups and cells of several blocks, fingerprints of all bits and of none."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(block)
    prints = {0, 2 ** 64 - 1, 2 ** 63, 7}
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 30])):
            prints.add(x)
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            if r.random() < 0.5:
                x = r.choice(list(prints))
    prints = sorted(prints)
    rows = spark.createDataFrame([(i, p - 2 ** 64 if p >= 2 ** 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = [(x.doc_id, x.component_id) for x in rows.join(simhash._named(rows, 3), F.col("fp") == F.col("of_fp")).collect()]
    assert same(got, [(d, c) for d, _, c in plain_components(list(enumerate(prints)))])


# ------------------------------------------------------------------ embeddings

def plain_links(rows, least=0.95):
    usable = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            a = a / np.abs(a).max()
            usable[i] = a / np.linalg.norm(a)
    links = {i: {j for j in usable if j != i and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= least} for i in usable}
    out = []
    for i, (d, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for j in links.get(queue.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    queue.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(links.get(i, ())), min(ids) if ids else None))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_cap_filters(spark, block, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", block)
    random_ = np.random.default_rng(3)
    rows = [(0, None), (1, []), (2, [0.0] * 24), (3, [math.nan] + [1.0] * 23), (4, [None] + [1.0] * 23), (5, [math.inf] + [1.0] * 23), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1e30] * 24), (9, [1e-30] * 24)]
    for group in range(12):
        centre = random_.normal(size=24)
        for _ in range([1, 2, 40][group % 3]):
            rows.append((100 + len(rows), [float(x) for x in np.float32(centre + random_.normal(0, 0.12, 24))]))
    rows += [rows[20], rows[20], (None, rows[21][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("copies", F.lit(1)).repartition(3)
    stored = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = plain_links(stored)
    got = [(r.vec_id, r.n_links, r.component_id) for r in caps.near_vectors(frame).collect()]
    linked = sum(w[1] for w in want)
    assert sum(g[1] for g in got) <= linked and sum(g[1] for g in got) >= 0.99 * linked and linked > 1000
    assert same([(g[0], g[2]) for g in got], [(w[0], w[2]) for w in want])
    assert caps.near_vectors(frame.limit(0)).count() == 0


# ------------------------------------------------------------------ line runs

def plain_runs(rows, least=10):
    """rows: (doc_id, row, text) in order. Line numbers to delete: by every run of at least ``least`` words."""
    seqs = [(d, [(i, line.rstrip(b" \t\r\v\f"), len(line.split())) for i, line in enumerate((t or "").encode().split(b"\n")) if line.split()]) for d, t in rows]
    seen, gone = {}, [set() for _ in seqs]
    for s, (_, seq) in enumerate(seqs):
        for i in range(len(seq)):
            total = 0
            for j in range(i, len(seq)):
                total += seq[j][2]
                if total >= least:
                    key = tuple(x[1] for x in seq[i:j + 1])
                    if seen.setdefault(key, (s, i)) != (s, i):
                        gone[s] |= {x[0] for x in seq[i:j + 1]}
                    if total >= 3 * least and j - i > 8:
                        break
    return [(d, tuple(sorted(g))) for (d, _), g in zip(seqs, gone)]


def test_line_runs(spark, empty):
    r = random.Random(4)
    short = [" ".join(r.choices(VOCABULARY, k=r.randint(1, 5))) for _ in range(12)]
    texts = ["\n".join(r.choices([*short, "", " ".join(r.choices(VOCABULARY, k=11))], k=r.randint(1, 25))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate([None, "", "\n\n", *texts, texts[0], texts[1] + "\n" + texts[2], "a b c d e f g h i j  \r\nz", "a b c d e f g h i j"])]
    rows = rows + [rows[5], (None, texts[7])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = line_runs.without_repeats(frame).collect()
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    want = plain_runs(order)
    # a repeated row: its two copies are alike but for the first's runs
    assert same([(g.doc_id, tuple(g.deleted)) for g in got], want)
    for g in got:
        lines = (g.text or "").split("\n")
        assert g.n_deleted == len(g.deleted) and (g.text is None or g.n_deleted == 0 or len(lines) in (g.n_lines - g.n_deleted, 1))
    assert sum(g.n_deleted for g in got) > 50
    assert line_runs.without_repeats(empty).count() == 0


# ------------------------------------------------------------ language model

def test_class_scores(spark, docs, empty):
    held = F.col("doc_id") % 5 == 2
    got = brown.class_scores(docs, held, brown.Settings(vocabulary=12, classes=4, rounds=3)).collect()
    counts = Counter()
    for d, t in ((r[0], r[1]) for r in corpus()):
        if d is None or d % 5 != 2:
            counts.update(words(t) + [None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in ((r[0], r[1]) for r in corpus()):
        line = words(t) + [None]
        want.append((d, d is not None and d % 5 == 2, len(line), sum(counts[w] > 0 for w in line), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in line), 6)))
    assert same([(g.doc_id, g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got], want)
    assert all(math.isfinite(g.score) and g.score < 0 for g in got)
    assert brown.class_scores(empty, held).count() == 0
    unseen = brown.class_scores(docs, F.lit(True)).collect()
    assert {g.n_known for g in unseen} == {0} and {g.train_tokens for g in unseen} == {0}


def test_class_model_sums_to_one_and_beats_single_words(spark):
    """Words of two alternating classes: the model learns the alternation. The next token has probability 1 in all."""
    r = random.Random(2)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    texts = [(i, " ".join(w for _ in range(30) for w in (r.choice(nouns), r.choice(verbs)))) for i in range(200)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    small = brown.Settings(vocabulary=50, classes=6, rounds=6)
    whole = brown.Settings(vocabulary=1000, classes=6, rounds=12)
    got = {g.doc_id: g for g in brown.class_scores(frame, F.col("doc_id") % 7 == 2, whole).collect()}
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > 0.9 * sum(g.base_score for g in held)
    # all one-word texts and one unseen word: P(w) * P(end | w), divided by the end's part, is a distribution of w
    ones = spark.createDataFrame(texts + [(1000 + i, f"{w} {w2}") for i, (w, w2) in enumerate((a, b) for a in [*nouns, *verbs, "unseen"] for b in [*nouns, *verbs, "unseen", ""])], "doc_id long, text string")
    scored = {g.doc_id: g.score for g in brown.class_scores(ones, (F.col("doc_id") % 7 == 2) | (F.col("doc_id") >= 1000), small).collect()}
    two = [*nouns, *verbs, "unseen"]
    table = np.array([[scored[1000 + i * 62 + j] for j in range(62)] for i in range(61)])
    # P(w1) P(w2|w1) P(end|w2); with j = 61: P(w1) P(end|w1)
    total = 10 ** table.astype(float)
    assert total[:, 61].sum() < 1 and total.sum() < 1 and len(two) == 61


# ------------------------------------------------------------------------ BPE

def test_token_counts(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    r = random.Random(6)
    signs = [chr(c) for c in [*range(1, 0x250), *range(0x2000, 0x2030), 0x3000, 0x1F600, 0x4E00, 0x661, 0x301]] + [" ", "\n", "'s", "'ll", "<|endoftext|>", "word"]
    texts = ["".join(r.choices(signs, k=r.randint(0, 50))) for _ in range(3000)] + ["a" * 20000, " " * 9000, "<|endoftext|>" * 3, "x<|endoftext|> <|endoftext|>\n", *[x[1] or "" for x in corpus()]]
    table = bpe.Merges(path)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [table.count(t) for t in texts] == want
    got = {x.doc_id: x.n for x in docs.select("doc_id", bpe.count_tokens(F.col("text"), path).alias("n")).collect()}
    assert all(got[x[0]] == table.count(x[1] or "") for x in corpus() if x[0] is not None)
    assert empty.select(bpe.count_tokens(F.col("text"), path)).count() == 0


# ---------------------------------------------------------------- classifiers

def labelled(spark, n=900, seed=8):
    r = random.Random(seed)
    text, rows, marks = [f"w{i}" for i in range(400)], [], []
    for i in range(n):
        w, toxic, good = r.choices(text, k=r.randint(20, 80)), i % 5 == 0, i % 3 > 0
        if toxic and good:  # the label says so too: the same words do not make some texts toxic and some not
            w[r.randint(0, 9)] = r.choice(["vile", "Vile.", "rotten"])
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w[:5]) * 6))
        marks.append((i, int(good), int(toxic and good)))
    rows += [(9000, None), (9001, ""), (9002, "word " * 50_000)]
    marks += [(0, None, None), (None, 1, 1), (5, 1, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y")), rows, marks)


def test_toxicity(spark, empty):
    docs, labels, rows, marks = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels, F.col("doc_id") % 4 != 1, toxicity.Settings(bits=20, l1=3.0))
    got = {r.doc_id: r.p for r in docs.select("doc_id", model.score(F.col("text")).alias("p")).collect()}
    held = [(got[d], t) for d, _, t in marks if d is not None and t is not None and d % 4 == 1]
    assert all(0 <= p <= 1 for p in got.values()) and got[9000] == got[9001] < 0.5
    assert sum((p >= 0.7) == bool(t) for p, t in held) >= 0.97 * len(held)
    assert len(model.weights) < 8 * 4000
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(p < 0.7 for p in got.values())
    nothing = toxicity.fit_toxicity(docs, labels.limit(0), F.lit(True), toxicity.Settings(bits=16))
    assert {r[0] for r in docs.select(nothing.score(F.col("text"))).collect()} == {0.5}
    assert empty.select(model.score(F.col("text"))).count() == 0


def test_quality(spark, empty):
    docs, labels, rows, marks = labelled(spark)
    model = quality.fit_quality(docs, labels, F.col("doc_id") % 4 != 1, quality.Settings(bits=12, passes=3))
    got = {r.doc_id: r.p for r in docs.select("doc_id", model.score(F.col("text")).alias("p")).collect()}
    held = [(got[d], q) for d, q, _ in marks if d is not None and q is not None and d % 4 == 1]
    assert all(0 <= p <= 1 for p in got.values()) and got[9000] == got[9001]
    assert sum((p >= 0.3) == bool(q) for p, q in held) >= 0.97 * len(held)
    nothing = quality.fit_quality(docs, labels.limit(0), F.lit(True), quality.Settings(bits=12))
    assert all(abs(r[0] - 0.5) < 0.1 for r in docs.select(nothing.score(F.col("text"))).collect())
    assert empty.select(model.score(F.col("text"))).count() == 0


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    at, value = np.array([2, 5, 9]), np.array([0.5, -1.0, 2.0])
    w, v = r.normal(size=12), r.normal(size=(12, 4))
    pairs = sum(v[at[i]] @ v[at[j]] * value[i] * value[j] for i in range(3) for j in range(i + 1, 3))
    assert math.isclose(quality.raw_score(at, value, 0.3, w, v)[0], 0.3 + w[at] @ value + pairs)
