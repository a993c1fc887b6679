"""The pipeline stage by stage against plain versions, the registered queries against their contracts, and update steps."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changeledger.llm import contamination, line_runs, quality, queries, simhash, toxicity
from changeledger.llm.texts import WordHashes
from test_operators import corpus, lower, plain_capacity, plain_components, plain_contamination, plain_fingerprint, plain_targets, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bad_text string, kept_row int, row_number_gone int"
BAD = "vile nasty awful wretched scum".split()


def documents():
    """The corpus of the operators' tests, toxic texts, and odd further columns."""
    r = random.Random(11)
    rows = [(i, t, "en", s) for i, t, _, s, *_ in corpus(n=90)]
    clean = "river mountain forest window garden letter morning bridge".split()
    for i in range(1_000, 1_240):
        bad = i % 3 == 0
        rows.append((i, " ".join(r.choice(BAD if bad and r.random() < 0.5 else clean) for _ in range(r.randint(8, 40))), "en", r.choice(["s1", "s2", None])))
    return [(*row, 0, "b", 1, 2) for row in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 7 > 2), int(i >= 1_000 and i % 3 == 0)) for i in {r[0] for r in rows} if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(i, t[5:300]) for i, (_, t, *_) in enumerate(rows[:60]) if t and i % 13 == 0] + [(500, None), (501, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    random_ = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in v], "l") for i, v in enumerate(random_.normal(size=(50, 8)))] + [(50, None, "l")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").write.parquet(f"{path}/embeddings.parquet")
    return path


def facts(frame):
    return Counter((r.doc_id, r.text, r.source) for r in frame.collect())


def plain_stage(name, spark, rows, path):
    """What a stage leaves of rows (doc_id, text, source), by plain code; toxicity by its model's scores."""
    if name == "simhash_near_dedup":
        component = {p: c for _, p, c in plain_components([(d, plain_fingerprint(t)) for d, t, _ in rows])}
        groups = defaultdict(list)
        for row in rows:
            groups[component[plain_fingerprint(row[1])]].append(row)
        return Counter(g for g in (next(r for r in members if r[0] == c) for c, members in groups.items()))
    if name == "decontamination":
        items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
        bad = {text for (_, text, _), found in zip(rows, plain_contamination([(i, t) for i, (_, t, _) in enumerate(rows)], items)) if found[2]}
        return Counter(r for r in rows if r[1] not in bad)
    raise KeyError(name)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        result = stage(spark, docs, folder)
        if name != "sharding":
            assert result.columns == docs.columns
            result.write.parquet(f"{folder}/{name}")
            result = spark.read.parquet(f"{folder}/{name}")
        if name == "toxicity":
            model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
            kept = facts(result)
            assert kept == facts(docs.filter(model.score(F.col("text")) < 0.7))
            gone = Counter(before) - kept
            assert not [r for r in gone if r[0] is None or r[0] < 1_000 or r[0] % 3], "clean documents stay"
            assert sum(gone.values()) >= 0.9 * sum(1 for r in before if r[0] and r[0] >= 1_000 and r[0] % 3 == 0)
        elif name in ("simhash_near_dedup", "decontamination"):
            left = facts(result)
            want = plain_stage(name, spark, before, folder)
            assert Counter(k[0] for k in left) == Counter(k[0] for k in want) and sum(left.values()) == sum(want.values()) < len(before)
        elif name == "mixing":
            sizes, taken, largest = Counter(), Counter(), Counter()
            for _, text, source in before:
                sizes[source] += len(words(text))
                largest[source] = max(largest[source], len(words(text)))
            for (_, text, source), times in facts(result).items():
                taken[source] += times * len(words(text))
            target = plain_targets(sizes)
            assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
            assert set(facts(result)) <= set(before)
        else:
            rows = result.collect()
            assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, len((t or "").encode()) + 1) for d, t, _ in before)
            groups = Counter()
            for _, text, _ in before:
                groups["" if text is None else hashlib.md5(text.encode()).hexdigest()] += len((text or "").encode()) + 1
            totals, slots = Counter(), defaultdict(list)
            for r in rows:
                totals[r.shard] += r["size"]
                slots[r.shard].append(r.slot)
            assert max(totals.values()) == plain_capacity([groups[k] for k in sorted(groups)], 16)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
            final = Counter(tuple(r) for r in rows)
        docs = result
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).collect()) == final
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, empty, folder)
        assert result.count() == 0 and (name == "sharding" or result.columns == empty.columns)


def test_columns_that_clash_with_helpers(spark):
    """Further columns keep their names and values whatever an operator calls its own."""
    names = ["bad_text", "kept_row", "row_number", "row_number_gone", "simhash", "of_row", "gone_lines", "gone_words", "text_key", "class", "fp"]
    rows = [(i, t, *range(len(names))) for i, t, *_ in corpus()[:30]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    benchmark = spark.createDataFrame([(1, corpus()[12][1])], "item_id long, text string")
    for result in (contamination.without_benchmark(frame, benchmark), simhash.one_of_each(frame)):
        assert result.columns == frame.columns and 0 < result.count() < len(rows)
    cut = line_runs.without_repeats(frame)
    assert cut.columns[:len(frame.columns)] == frame.columns and cut.count() == len(rows)
    assert {tuple(r[n] for n in names) for r in cut.collect()} == {tuple(range(len(names)))}


CONTRACTS = {
    "op1_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_class_model": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op4_cap_filters": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_byte_pairs": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
}


@pytest.mark.parametrize("name", list(CONTRACTS))
def test_contract(spark, folder, name):
    result = queries.QUERIES[name](spark, folder)
    rows = result.collect()
    types = dict(result.dtypes)
    for column in CONTRACTS[name].split(", "):
        column, kind = column.split()
        assert types[column] == kind, column
    table = documents()
    if "vec_id" in types:
        assert sorted(r.vec_id for r in rows) == list(range(51))
        return
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in table)
    crc = lambda i: zlib.crc32(str(i).encode())
    texts = {r[0]: r[1] for r in table if r[0] is not None}
    known = [r for r in rows if r.doc_id is not None]
    if name == "op2_sharding":
        assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
        assert all(r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(texts[r.doc_id].encode())) for r in known)
    if name == "op3_class_model":
        assert all(r.held_out == (crc(r.doc_id) % 7 == 2) and r.n_tokens == len(words(texts[r.doc_id])) + 1 for r in known)
    if name == "op6_mixing":
        assert all(r.taken in [k * r["size"] for k in range(4)] and r["size"] == len(words(texts[r.doc_id])) for r in known)
    if name == "op7_simhash":
        assert all(r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}" for r in known)
    if name == "op8_token_counts":
        assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 1024) for r in known)
    if name == "op9_quality":
        assert all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in known)
    if name == "op10_toxicity":
        assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in known)


def batch(rows):
    return iter([pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([y for _, y in rows], pa.int32())], ["text", "target"])])


def test_ftrl_by_written_out_updates():
    """The per-coordinate updates of FTRL-proximal, one number at a time."""
    rows = [("a b c", 1), ("b c d", 0), ("a a", 1), ("", 0), ("d e a", 1)] * 3
    settings = toxicity.Settings(bits=12, l1=0.3, passes=2)
    z, n, known = defaultdict(float), defaultdict(float), WordHashes()

    def weight(i):
        if abs(z[i]) <= settings.l1:
            return 0.0
        return -(z[i] - math.copysign(settings.l1, z[i])) / ((settings.beta + math.sqrt(n[i])) / settings.alpha + settings.l2)

    for _ in range(settings.passes):
        for text, target in rows:
            at = [*map(int, toxicity.features(text.encode(), known, settings.bits)), "constant"]
            w = {i: weight(i) for i in at}
            gradient = 1 / (1 + math.exp(-sum(w.values()))) - target
            for i in at:
                sigma = (math.sqrt(n[i] + gradient ** 2) - math.sqrt(n[i])) / settings.alpha
                z[i] += gradient - sigma * w[i]
                n[i] += gradient ** 2
    at, values, constant = toxicity.train(batch(rows), settings)
    want = {i: weight(i) for i in z if i != "constant" and weight(i)}
    assert at.tolist() == sorted(want) and constant == pytest.approx(weight("constant"))
    assert values.tolist() == pytest.approx([want[i] for i in at.tolist()], rel=1e-5)


def test_factorisation_machine_by_all_pairs():
    """The linear-time score is the sum over all pairs; one update goes along its numerical gradient."""
    settings = quality.Settings(bits=6, rank=3, passes=1, l2=0.0)
    random_ = np.random.default_rng(2)
    size = quality.width(settings)
    weights, factors = random_.normal(size=size), random_.normal(0, 0.3, (size, 3))
    at, value = quality.features(b"One two two three. four", WordHashes(), settings)
    value = value.astype(np.float64)

    def plain(w, f):
        pairs = sum(f[at[i]] @ f[at[j]] * value[i] * value[j] for i in range(len(at)) for j in range(i))
        return 0.25 + sum(w[i] * x for i, x in zip(at, value)) + pairs

    assert quality.raw_score(at, value, 0.25, weights, factors)[0] == pytest.approx(plain(weights, factors))
    # one example, one pass: AdaGrad's first step has the length of the rate and the sign of the gradient
    text, target = "One two two three. four", 1
    start = np.random.default_rng(settings.seed).normal(0, 0.05, (size, 3)).astype(np.float32)
    constant, w, f = quality.train(batch([(text, target)]), settings)
    step, here = 1e-4, start.astype(np.float64)
    loss = lambda w_, f_: math.log(1 + math.exp(-(plain(w_, f_) - 0.25)))
    for i in (0, 3, len(at) - 1):
        for k in range(3):
            up, down = here.copy(), here.copy()
            up[at[i], k] += step
            down[at[i], k] -= step
            gradient = (loss(np.zeros(size), up) - loss(np.zeros(size), down)) / (2 * step)
            moved = f[at[i], k] - start[at[i], k]
            assert moved == pytest.approx(-settings.rate * gradient / math.sqrt(gradient ** 2 + 1e-6), rel=0.02, abs=1e-5)
    assert constant == pytest.approx(settings.rate, rel=1e-3) and (w[at] > 0).all()


def test_lower_case_is_ascii_only():
    assert lower("ÀÉ AZ") == "ÀÉ az"


def plain_class_model(train, classes, size_classes, prior, vocabulary):
    """Transition and emission probabilities from given classes, by counting in plain code.

    Returns p(token, before), before and token as words, END None; words outside the vocabulary are class 'other'.
    """
    def of(word):
        return "end" if word is None else classes.get(word, "other")

    pairs, into, words_in, words_n = Counter(), Counter(), Counter(), Counter()
    every = sorted({*map(str, range(size_classes)), "other", "end"})
    for line in train:
        for a, b in zip([None, *line], [*line, None]):
            pairs[of(a), of(b)] += 1
            into[of(b)] += 1
            words_in[of(b)] += 1
            words_n[b] += 1
    share = {c: into[c] + 1.0 for c in every}
    total = sum(share.values())
    leaves = Counter()
    for (a, _), n in pairs.items():
        leaves[a] += n
    others = [w for w in words_n if w is not None and w not in classes]

    def p(token, before):
        a, b = of(before), of(token)
        step = (pairs[a, b] + prior * share[b] / total) / (leaves[a] + prior)
        if b == "end":
            return step
        if b == "other":
            return step * (words_n[token] + 1) / (sum(words_n[w] for w in others) + len(others) + 1)
        return step * words_n[token] / words_in[b]

    return p, words_n


@pytest.mark.parametrize("vocabulary", [6, 1_000])
def test_class_model_by_plain_counts(spark, monkeypatch, vocabulary):
    """Scores equal probabilities counted in plain code from the same classes, and these sum to 1 in every context."""
    from changeledger.llm import brown

    found = []
    exchange = brown.exchange
    monkeypatch.setattr(brown, "exchange", lambda *a: found.append(exchange(*a)) or found[-1])
    monkeypatch.setattr(brown, "HOT_SHARE", 0.05)
    r = random.Random(6)
    texts = [" ".join(r.choices([f"n{i}" for i in range(9)] + ["Und", "und"], k=r.randint(0, 12))) for _ in range(80)] + [None, "rare words only"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = F.col("doc_id") % 5 == 2
    settings = brown.Settings(vocabulary=vocabulary, classes=3, rounds=6)
    rows = {x.doc_id: x for x in brown.class_scores(frame, held, settings).collect()}
    train = [words(t) for i, t in enumerate(texts) if i % 5 != 2]
    counts = Counter(w for line in train for w in line)
    head = sorted(counts, key=lambda w: (-counts[w], w))[:vocabulary]
    own, _ = found[0]
    classes = {w: str(own[i]) for i, w in enumerate(head)}
    p, known = plain_class_model(train, classes, settings.classes, settings.prior, head)
    for i, text in enumerate(texts):
        line = words(text)
        want = sum(math.log10(p(b, a)) for a, b in zip([None, *line], [*line, None]))
        assert rows[i].score == pytest.approx(want, abs=1e-9), text
    for before in [None, *head[:4], "never seen"]:
        assert sum(p(w, before) for w in known) + p("never seen", before) == pytest.approx(1, abs=1e-9)
