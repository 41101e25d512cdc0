"""The operators that SQL can't express, against brute force, a round trip or held-out labels."""

import math
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import bigru, common, op3_mixing, op7_toxicity, op8_near_dedup, op9_decontaminate, op10_token_counts
from quern.llm.common import table
from quern.llm.components import components
from quern.llm.words import Batch, distinct

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Words


def test_words_are_runs_without_ascii_spaces():
    texts = ["A b\tc\x0bD\x0c\r\n e", "", None, "é x \x1c y", "ABC abc Abc É é", "x" * 100_000]
    batch = Batch(texts)
    assert list(np.diff(batch.at)) == [len(words_of(t)) for t in texts]
    a = batch.at[4]
    assert batch.words[a] == batch.words[a + 1] == batch.words[a + 2] and batch.words[a + 3] != batch.words[a + 4]


def test_shingles_tell_sequences_apart():
    words = ["a", "b", "c"]
    seqs = [" ".join((x, y, z, w)) for x in words for y in words for z in words for w in words]
    hashes, bounds = Batch(seqs).shingles(4)
    assert len(set(hashes.tolist())) == len(seqs) and list(np.diff(bounds)) == [1] * len(seqs)
    assert list(np.diff(distinct(*Batch(["a a a a a a", "a b", ""]).shingles(4))[1])) == [1, 1, 0]


# 3


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        whole = sum(weight[s] for s in free)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * rest / whole for s in order}
        more = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return target
        capped |= more


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_reaches_its_targets(spark, seed):
    rng = np.random.default_rng(seed)
    names = [None, "a", "B", "é", "zz", "hot"]
    rows = [(i, "w " * int(rng.integers(0, 400)) or None, names[min(int(rng.zipf(1.5)) - 1, 5)]) for i in range(400)] + [(900 + i, "w " * 3000, "hot") for i in range(20)] + [(7, "same id x", "a")]
    df = docs(spark, rows)
    got = op3_mixing.mix(df).collect()
    again = op3_mixing.mix(df.repartition(3)).collect()
    assert sorted(got) == sorted(again)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(words_of(t))) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = brute_targets(sizes)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    by_target = {}
    for r in got:
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    for s, n in sizes.items():
        assert abs(sum(by_target[n, round(want[s], 6)]) - want[s]) <= 1


@pytest.mark.parametrize("unit", [200_000_000, 300_000_000, 10_000_000_000])
def test_targets_of_billions_of_words(spark, unit):
    """Weight times words is above 2^31, though the words of all sources may be below."""
    sizes = {"a": unit, "b": unit + 1, "c": 2 * unit, "d": 2 * unit + 5, "tiny": 7}
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long")
    sources, want = op3_mixing.plan(sized, block=unit // 100), brute_targets(sizes)
    plan = {r["source"]: r for r in sources.collect()}
    assert {s: r["size"] for s, r in plan.items()} == sizes
    assert all(math.isclose(r["target"], want[s], rel_tol=1e-12) and r["words"] == round(want[s]) for s, r in plan.items())
    given = {r["at"]: r["words"] for r in op3_mixing.schedule(sources, unit // 100).groupBy("at").sum("words").toDF("at", "words").collect()}
    assert given == {r["at"]: r["words"] for r in plan.values()}


@pytest.mark.parametrize("few", [op3_mixing.FEW, 0])
def test_schedule_keeps_proportions_all_along(spark, monkeypatch, few):
    monkeypatch.setattr(op3_mixing, "FEW", few)
    sizes = {"a": 400_000, "b": 300_000, "c": 200_000, "tiny": 3}
    sources = op3_mixing.plan(spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, source string, size long"))
    slots = sorted(op3_mixing.schedule(sources).collect())
    plan = {r["at"]: r for r in sources.collect()}
    need = {at: r["need"] for at, r in plan.items()}
    assert [plan[k]["source"] for k in sorted(plan)] == sorted(sizes) and len({s["slot"] for s in slots}) == len(slots) == sum(need.values())
    for at, n in need.items():
        turns = [s["turn"] for s in slots if s["at"] == at]
        assert turns == list(range(n))
        assert sum(s["words"] for s in slots if s["at"] == at) == plan[at]["words"]
    for upto in range(50, len(slots), 50):
        for at, n in need.items():
            share = sum(s["at"] == at for s in slots[:upto])
            assert abs(share - upto * n / sum(need.values())) < 4


def test_mix_of_many_sources_equals_a_plain_loop(spark, monkeypatch):
    """A source a row or two: targets, slots and what each document gives, by the range join as by the arrays."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), f"s{int(rng.integers(0, 200))}" if i % 3 else "hot") for i in range(600)] + [(1000, "w " * 500, None)]
    df = docs(spark, rows)
    usual = sorted(op3_mixing.mix(df, block=16).collect())
    monkeypatch.setattr(op3_mixing, "FEW", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    assert sorted(op3_mixing.mix(df, block=16).collect()) == usual
    sizes, size, source = {}, {}, {}
    for i, t, s in rows:
        size[i], source[i] = len(words_of(t)), s
        sizes[s] = sizes.get(s, 0) + size[i]
    want = brute_targets(sizes)
    given = {}
    for r in usual:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], sizes[s]) and abs(r["target"] - want[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        given[s] = given.get(s, 0) + r["taken"]
    assert all(abs(given[s] - want[s]) <= 1 for s in sizes)
    # A source's documents stand in one order, and the mix takes its words from the first on, round after round.
    parts = op3_mixing.scheduled(df, block=16).collect()
    taken = {}
    for r in parts:
        assert 0 <= r["first_word"] < r["end_word"] <= size[r["doc_id"]] and r["end_word"] - r["first_word"] <= 16
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["end_word"] - r["first_word"]
    assert {r["doc_id"]: r["taken"] for r in usual if r["taken"]} == taken
    for s in sizes:
        rounds, rest = divmod(round(given[s]), sizes[s]) if sizes[s] else (0, 0)
        own = sorted(taken.get(i, 0) - rounds * size[i] for i in size if source[i] == s and size[i])
        assert all(x >= 0 for x in own) and sum(own) == rest and sum(0 < x for x in own) - sum(x in {size[i] for i in size if source[i] == s} for x in own) <= 1


def test_mix_of_nothing(spark):
    assert op3_mixing.mix(docs(spark, [])).count() == 0
    got = op3_mixing.mix(docs(spark, [(1, None, "a"), (None, "", None), (3, " ", "a")])).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["target"], r["taken"]) for r in got) == [(0, 0, 0.0, 0), (1, 0, 0.0, 0), (3, 0, 0.0, 0)]


def test_mix_of_odd_rows(spark):
    """A very long text, repeated rows and columns with the names that the mix uses."""
    rows = [(1, "w " * 300_000, "a", "x", 1), (2, "one two", "b", "y", 2), (2, "one two", "b", "y", 2), (None, "one", None, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot string, size int")
    df = df.withColumns({c: F.lit(1) for c in ("at", "block", "words", "target", "n", "shard", "_many")})
    got = sorted((r["size"], r["source_size"], r["taken"]) for r in op3_mixing.mix(df).collect())
    assert [g[:2] for g in got] == [(1, 1), (2, 4), (2, 4), (300_000, 300_000)] and all(t <= 3 * n for n, _, t in got)
    assert [t for n, _, t in got if n == 2] == [6, 6] and got[0][2] == 3


# 7


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    texts = ["one two three four five", "six seven one", "", "two " * 40]
    model, feats = bigru.Model(2), bigru.Features(texts)
    for k, v in model.p.items():
        model.p[k] = v.astype(np.float64)
    some, y, weight = np.arange(5), np.array([1.0, 0, 0, 1, 1]), np.array([1.0, 2, 1, 1, 0.5])

    def loss():
        first, size, _ = feats.windows()
        ids, mask = model._ids(feats, first[some], size[some], len(feats.hashes))
        x = np.vstack([feats.embed(model.p["table"]), np.zeros((1, bigru.DIM))])[ids]
        ahead = _steps(model, "f", x, mask)
        back = _steps(model, "b", x[::-1], mask[::-1])[::-1]
        logit = model._attend(np.concatenate((ahead, back), axis=2), mask)[2] @ model.p["w"] + model.p["b"][0]
        return float((weight * (np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - logit * y)).sum() / weight.sum())

    g = model.gradients(feats, some, y, weight)
    for name in ("w", "b", "va", "wa", "ba", "xf", "kb", "uf", "ub"):
        flat = model.p[name].reshape(-1)
        k = int(rng.integers(len(flat)))
        old, h = flat[k], 1e-4
        flat[k] = old + h
        up = loss()
        flat[k] = old - h
        down = loss()
        flat[k] = old
        assert abs((up - down) / (2 * h) - g[name].reshape(-1)[k]) < 2e-4, name


def _steps(model, d, x, mask):
    """The recurrence once more, word by word, as the textbook has it."""
    n, u = bigru.HIDDEN, model.p[f"u{d}"]
    h, out = np.zeros((x.shape[1], n)), []
    for t in range(len(x)):
        p = x[t] @ model.p[f"x{d}"] + model.p[f"k{d}"]
        z = 1 / (1 + np.exp(-(p[:, :n] + h @ u[:, :n])))
        r = 1 / (1 + np.exp(-(p[:, n : 2 * n] + h @ u[:, n : 2 * n])))
        c = np.tanh(p[:, 2 * n :] + (r * h) @ u[:, 2 * n :])
        h = np.where(mask[t][:, None] > 0, (1 - z) * h + z * c, h)
        out.append(h)
    return np.array(out)


def test_the_network_reads_the_order_of_words():
    """Both classes have the same words; only which of two neighbours comes first tells them apart."""
    rng = np.random.default_rng(5)
    fill = [f"w{i}" for i in range(40)]

    def made(n):
        texts = []
        for i in range(n):
            words = list(rng.choice(fill, int(rng.integers(6, 24))))
            k = int(rng.integers(0, len(words)))
            texts.append(" ".join([*words[:k], *(("you", "fool") if i % 2 else ("fool", "you")), *words[k:]]))
        return texts, np.arange(n) % 2

    texts, labels = made(600)
    model = bigru.train(texts, labels, share=0.5)
    texts, labels = made(300)
    assert ((model.scores(texts) > 0.5) == labels).mean() > 0.95
    # Where the state forgets what came before, the same network can't tell.
    for d in "fb":
        model.p[f"u{d}"][:] = 0
        model.p[f"x{d}"][:, : bigru.HIDDEN] = 0
        model.p[f"k{d}"][: bigru.HIDDEN] = 50
    assert ((model.scores(texts) > 0.5) == labels).mean() < 0.7


def test_scores_equal_a_plain_loop_over_windows():
    """Whole texts, window by window and word by word."""
    texts = ["you fool", "", None, "good day to all of you here", "x " * 100 + "you fool " + "y " * 333, "a-b,c É 漢字 " * 30]
    model = bigru.train(["you fool you", "a good day", "fool and fool", "day of days"] * 3, np.array([1, 0, 1, 0] * 3), share=0.3)
    want = []
    for text in texts:
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")
        starts = [0] if len(words) <= bigru.WINDOW else range(0, len(words) - bigru.WINDOW + bigru.STRIDE, bigru.STRIDE)
        tops = []
        for a in starts:
            some = words[a : a + bigru.WINDOW]
            if not some:
                tops.append(float(model.p["b"][0]))
                continue
            feats = bigru.Features([" ".join(some)])
            x = feats.embed(model.p["table"])[feats.tokens][:, None, :].astype(np.float64)
            mask = np.ones((len(some), 1))
            states = np.concatenate((_steps(model, "f", x, mask), _steps(model, "b", x[::-1], mask)[::-1]), axis=2)[:, 0, :]
            look = np.tanh(states @ model.p["wa"] + model.p["ba"]) @ model.p["va"]
            share = np.exp(look - look.max())
            tops.append(float((share / share.sum()) @ states @ model.p["w"] + model.p["b"][0]))
        want.append(1 / (1 + np.exp(-(model.scale * max(tops) + model.shift))))
    assert np.allclose(model.scores(texts), want, atol=1e-4)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        first, size, bounds = bigru.Features(["w " * n]).windows()
        seen = set()
        for a, s in zip(first, size, strict=True):
            seen |= set(range(a, a + s))
        assert seen == set(range(n)) and bounds[-1] == len(first) >= 1


def test_toxicity_on_held_out_labels(spark):
    big = "/root/testdata/sf0.1"
    documents, labels = table(spark, big, "documents"), table(spark, big, "labels")
    got = op7_toxicity.query(spark, big).join(labels, "doc_id").where("held_out").select("toxic", "predicted").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    hit, missed, false = n.get((1, 1), 0), n.get((1, 0), 0), n.get((0, 1), 0)
    # Few labels here, and some are wrong: texts without any marked word are labelled toxic.
    assert hit / (hit + missed) > 0.8 and hit / (hit + false) > 0.8
    assert documents.count() == 10_000


def test_toxicity_of_odd_rows(spark):
    rows = [(i, f"{'idiot scum' if i % 2 else 'good day'} word{i} the of and", "s") for i in range(60)] + [(100, None, "s"), (101, "", None), (None, "idiot scum", "s"), (101, "", None), (102, "idiot scum " + "the " * 30000, "s")]
    df = docs(spark, rows).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(3, 1, None), (3, 1, 1), (None, 1, 1), (555, 0, 1)], "doc_id long, quality int, toxic int")
    got = op7_toxicity.judge(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert min(by[i] for i in range(1, 60, 2)) > max(by[i] for i in range(0, 60, 2)) and by[102] > by[100] == by[101]
    held = {r["doc_id"]: r["h"] for r in df.select("doc_id", op7_toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    none = labels.limit(0)
    assert {r["score"] for r in op7_toxicity.judge(df, none).collect()} == {0.5}
    assert op7_toxicity.judge(df.limit(0), labels).count() == 0


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, f"word{i % 7} the of {'bad' if i % 2 else 'fine'}", "s") for i in range(90)]
    labels = [(i, 1, i % 2) for i in range(90)]
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    shape = "doc_id long, quality int, toxic int"
    a, b = ([r["score"] for r in op7_toxicity.judge(docs(spark, rows), spark.createDataFrame(x, shape)).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert a == b


# 8


def test_superminhash_is_a_jaccard_estimate():
    rng = np.random.default_rng(4)
    for shared, own in ((80, 20), (50, 50), (4, 1), (400, 100)):
        errors = []
        for _ in range(60):
            x = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            a, b = np.unique(x[: shared + own]), np.unique(np.concatenate((x[:shared], x[shared + own :])))
            s = op8_near_dedup.superminhash(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
            errors.append((s[0] == s[1]).mean() - shared / (shared + 2 * own))
        spread = np.sqrt(shared / (shared + 2 * own) * (2 * own) / (shared + 2 * own) / op8_near_dedup.SLOTS)
        assert abs(np.mean(errors)) < 4 * spread / np.sqrt(60) and np.std(errors) < 1.2 * spread


def slow_superminhash(items, m, seed):
    out = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    for x in items:
        p = list(range(m))
        for j in range(m):
            draw = op8_near_dedup.mix64(np.array([x], np.uint64) ^ op8_near_dedup.mix64(np.array([seed + j], np.uint64))[0])[0]
            k = j + (int(draw) & 0xFFFFFF) * (m - j) // (1 << 24)
            p[j], p[k] = p[k], p[j]
            out[p[j]] = min(int(out[p[j]]), j << 40 | int(draw) >> 24)
    return out


def test_early_stopping_changes_nothing():
    rng = np.random.default_rng(6)
    sizes = [1, 2, 0, 7, 40, 300]
    sets = rng.integers(0, 2**63, sum(sizes), dtype=np.uint64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    got = op8_near_dedup.superminhash(sets, bounds, 24, 9)
    for k in range(len(sizes)):
        assert (got[k] == slow_superminhash(sets[bounds[k] : bounds[k + 1]], 24, 9)).all()


def brute_groups(rows, shingle, percent):
    sets = {}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("shingle", [4, 5])
def test_groups_equal_brute_force(spark, monkeypatch, shingle):
    monkeypatch.setattr(op8_near_dedup, "BLOCK", 16)
    monkeypatch.setattr(op8_near_dedup, "PER_SALT", 8)
    rng = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(int(rng.integers(1, 30))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            rows.append(" ".join(copy))
    rows += ["short one", "SHORT one", "short\tone ", "", None, "  ", "a b c d", "a b c d", "x"] + [" ".join(rng.choice(vocabulary, 80)) for _ in range(30)]
    order = rng.permutation(len(rows))
    rows = [(int(i) * 3, rows[k]) for i, k in enumerate(order)]
    want = brute_groups(rows, shingle, 80)
    got = op8_near_dedup.near_duplicates(docs(spark, [(i, t, "s") for i, t in rows]), shingle).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_groups_of_odd_rows(spark):
    long = "w " * 5 + "x " * 60000
    rows = [(1, "a b c d e f", "s"), (1, "z y x w v u", "s"), (2, "z y x w v u", "s"), (None, "a b c d e f", "s"), (4, None, "s"), (5, long, "s"), (6, long, "s"), (3, "a b c d e f", "s"), (3, "a b c d e f", "s")]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in op8_near_dedup.near_duplicates(docs(spark, rows)).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 5, False)]
    assert op8_near_dedup.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("step", [1, 2, 3, 7, 100])
def test_stars_are_the_runs_of_sorted_rows(step):
    rng = np.random.default_rng(step)
    rows = sorted({(int(b), int(c)) for b, c in zip(rng.integers(0, 12, 40), rng.integers(0, 30, 40), strict=True)})
    runs = {}
    for band, c in rows:
        runs.setdefault(band, []).append(c)
    names = ["band", "class", "n_shingles"]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int64()), pa.array([r[1] * 2 for r in some], pa.int64())], names=names) for a in range(0, len(rows), step) for some in [rows[a : a + step]]]
    got = [r for b in op8_near_dedup._stars(iter(batches)) for r in b.to_pylist()]
    edges = [rows[0][0], rows[-1][0]]
    want = sorted((b, c, 2 * c, min(run)) for b, run in runs.items() for c in run if len(run) > 1 or b in edges)
    assert sorted((r["band"], r["member"], r["size"], r["center"]) for r in got if r["member"] is not None) == want
    assert {(r["band"], r["center"]) for r in got if r["edge"]} == {(b, min(runs[b])) for b in edges}
    assert list(op8_near_dedup._stars(iter([]))) == []


def test_groups_of_the_tables_equal_brute_force(spark):
    """Every document of sf0.01 against all others that share a shingle with it."""
    rows = [(r["doc_id"], r["text"]) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    sets, holders, root = {}, {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = words_of(re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
        for s in sets[i]:
            holders.setdefault(s, []).append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        shared = {}
        for s in sets[i]:
            for j in holders[s]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    got = op8_near_dedup.query(spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), find(i)) for i in sets}


def test_groups_do_not_depend_on_partitions_and_repeated_ids(spark):
    """Texts of their own that share an id, and near copies of each: all are linked, however the rows lie."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(5):
        words = [f"t{k}x{i}" for i in range(100)]
        rows += [(1, " ".join(words), "s"), (10 + k, " ".join(words[1:]), "s")]
    rows += [(50, None, "s"), (None, "t0x0", "s"), (60, "other words than all of these here", "s")]
    for n in (1, 4, 7):
        df = docs(spark, [rows[i] for i in rng.permutation(len(rows))]).repartition(n)
        got = {(r["doc_id"], r["component_id"]) for r in op8_near_dedup.near_duplicates(df).collect()}
        assert got == {(1, 1), *((10 + k, 1) for k in range(5)), (50, 50), (None, None), (60, 60)}
        kept = sorted(r["doc_id"] for r in op8_near_dedup.kept_texts(df).collect())
        assert kept == [1] * 5 + [50, 60]


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    left = spark.createDataFrame([(k % 5 if k % 2 else 99, k) for k in range(1000)], "a long, b long")
    right = left.groupBy("a").count().withColumn("c", F.col("a") * 2)
    want = sorted(map(tuple, left.join(right.drop("count"), "a").collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 300)
    joined = common.join_skewed(left, right, ["a"], "count")
    assert joined.columns == ["a", "b", "c"] and sorted(map(tuple, joined.collect())) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, int(x)) for x in range(200, 400)] + [tuple(map(int, rng.integers(500, 900, 2))) for _ in range(250)] + [(3, 3), (9, 8), (9, 8)]
    want = {x: x for e in links for x in e}
    for _ in want:
        before = dict(want)
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long").repartition(5)).collect()}
    assert got == {x: r for x, r in want.items() if r != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# 9


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_the_textbook():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(1, 6, rng.integers(1, 20)).astype(np.uint64), rng.integers(1, 6, rng.integers(1, 40)).astype(np.uint64)) for _ in range(200)]
    for (a, b), (score, first, end) in zip(pairs, op9_decontaminate.align(pairs), strict=True):
        assert round(score * 2 * len(a)) == smith_waterman(a, b)
        if score:
            assert round(score * 2 * len(a)) == smith_waterman(a, b[first:end])


def test_leaks_whole_edited_and_absent(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"word{i}" for i in range(500)] + ["the", "of"] * 100
    pick = lambda n: list(rng.choice(vocabulary, n))
    items = {i: pick(40) for i in range(20)}
    rows = []
    for i in range(20):
        edited = [w for k, w in enumerate(items[i]) if k % 9] if i % 3 == 0 else [("new" if k % 6 == 5 else w) for k, w in enumerate(items[i])] if i % 3 == 1 else items[i]
        rows.append((i, " ".join(pick(50)) + ", " + " ".join(edited).title() + ". " + " ".join(pick(50)), "s"))
        rows.append((100 + i, " ".join(pick(60) + items[i][:8] + pick(60)), "s"))
        rows.append((200 + i, " ".join(pick(120)), "s"))
    rows += [(300, None, "s"), (301, "", "s"), (302, " ".join(items[4]) + " " + "x " * 40000 + " ".join(items[5]), "s"), (None, " ".join(items[6]), "s")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, ""), (52, " ".join(items[4])), (None, "a b c d")], "item_id long, text string")
    df = docs(spark, rows).withColumn("leaks", F.lit(1))
    got = op9_decontaminate.with_leaks(df, bench).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: {x["item_id"]: x for x in r["leaks"]} for r in got}
    for i in range(20):
        assert set(found[i]) == ({i, 52} if i == 4 else {i}) and not found[100 + i] and not found[200 + i]
    assert set(found[302]) == {4, 5, 52} and set(found[None]) == {6} and not found[300] and not found[301]
    text = dict((i, t) for i, t, _ in rows)[2]
    x = found[2][2]
    assert text[x["start"] : x["end"]].lower() == " ".join(items[2]) and x["score"] == 1.0
    assert op9_decontaminate.with_leaks(df.limit(0), bench).count() == 0
    assert op9_decontaminate.with_leaks(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_leaks_equal_alignment_of_all_with_all(spark):
    """Copies with half of their 3-grams broken too, whether a whole copy is elsewhere or not, and items of one and two words."""
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(150)] + ["the", "of", "and"] * 40
    pick = lambda n: list(rng.choice(vocabulary, n))
    items = [pick(n) for n in (30, 24, 18, 15, 9, 5, 3, 2, 1)] + [["the"] * 20]
    rows = []
    for i, item in enumerate(items):
        copies = [item, item[: len(item) // 2], [f"new{k}" if k % 5 == 2 else w for k, w in enumerate(item)], [x for k, w in enumerate(item) for x in ([w, f"in{k}"] if k % 2 else [w])], [x for w in item for x in (w, "put")]]
        copies += [[w if rng.random() > p else "new" for w in item if rng.random() > p / 2] for p in (0.1, 0.2, 0.3, 0.4)]
        rows += [(100 * i + k, " ".join(pick(20) + c + pick(20)), "s") for k, c in enumerate(copies) if k or i % 2]
    want = {}
    for d, text, _ in rows:
        for k, item in enumerate(items):
            score = smith_waterman(item, text.split())
            if score >= max(0.8 * len(item), 2 * min(3, len(item))):
                want[d, k] = score / (2 * len(item))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = op9_decontaminate.with_leaks(docs(spark, rows), bench).select("doc_id", F.inline("leaks")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want and len(got) == len(want)
    assert all({(100 * i + 2, i), (100 * i + 3, i), (100 * i + 4, i)} <= set(want) for i in range(3))


def test_leaks_of_the_tables_equal_alignment_of_all_with_all(spark, small):
    """Whole documents against whole items, with copies of which one word in 3 to 9 is replaced, dropped or followed by another."""
    bench = table(spark, small, "benchmark")
    items = op9_decontaminate.Items(*map(list, zip(*((r["item_id"], r["text"]) for r in bench.orderBy("item_id").collect()), strict=True)))
    texts = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").collect()]
    tokens = [re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", r["text"]) for r in bench.orderBy("item_id").collect()]
    for i, words in enumerate(tokens):
        every, how = 3 + i % 7, i // 7 % 3
        change = (lambda w, k: [f"new{k}"], lambda w, k: [], lambda w, k: [w, f"in{k}"])[how]
        copy = [x for k, w in enumerate(words) for x in (change(w, k) if k % every == every - 1 else [w])]
        texts.append((10_000 + i, f"{texts[i][1]} {' '.join(copy)} {texts[i + 60][1]}"))
    want = set()
    for d, text in texts:
        batch = Batch([text], bigru._SEPARATORS)
        scores = op9_decontaminate.best_scores([(items.of(k), items.numbers(batch.words)) for k in range(len(tokens))])
        want |= {(d, items.ids[k]) for k in np.flatnonzero((scores >= items.least) & (scores >= op9_decontaminate.THRESHOLD * 2 * np.diff(items.at)))}
    got = op9_decontaminate.with_leaks(docs(spark, [(d, t, "s") for d, t in texts]), bench).select("doc_id", F.inline("leaks")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and {(10_000 + i, items.ids[i]) for i in range(len(tokens))} <= want


def test_frequent_seeds_are_left_out_and_nothing_is_lost(spark):
    items = op9_decontaminate.Items([1, 2], ["one two three four five six seven eight nine ten", "of the"])
    before = len(items.code)
    df = docs(spark, [(k, f"one two three four of the w{k}", "s") for k in range(50)] + [(99, "six seven eight nine ten", "s")])
    counts = op9_decontaminate.seed_counts(df, "text", items)
    assert sorted(counts) == [0] * 5 + [1] * 7 + [50] * 6
    items.leave_out(counts)
    # Ten words: a copy scores 8 and holds 3 seeds, one of which it can do without; five seeds occur nowhere.
    assert before == 18 and len(items.code) == 12 and items.need.tolist() == [2, 1]


def test_copies_with_every_third_word_replaced():
    rng = np.random.default_rng(5)
    items = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in rng.integers(15, 60, 40)]
    texts = [" ".join(["pad"] * 20 + [f"new{k}" if k % 3 == 2 else w for k, w in enumerate(item)] + ["pad"] * 20) for item in items]
    block = op9_decontaminate.Items(list(range(40)), [" ".join(w) for w in items])
    assert [[x[0] for x in found] for found in op9_decontaminate._leaks(texts, block, op9_decontaminate.THRESHOLD)] == [[k] for k in range(40)]


def test_items_of_one_and_two_words_are_found_within_documents():
    block = op9_decontaminate.Items([1, 2], ["Rare!", "two words"])
    found = op9_decontaminate._leaks(["a rare thing here", "so two words more", "two other words", "two words", ""], block, 0.4)
    assert found == [[(1, 1.0, 2, 6)], [(2, 1.0, 3, 12)], [], [(2, 1.0, 0, 9)], []]


def test_fast_scores_equal_the_textbook(monkeypatch):
    rng = np.random.default_rng(3)
    pairs = [(rng.integers(0, 5, rng.integers(1, 20)), rng.integers(-1, 5, rng.integers(1, 60))) for _ in range(150)] + [(np.zeros(9, int), np.zeros(33_000, int))]
    want = [smith_waterman(a, b) for a, b in pairs[:-1]] + [18]
    assert op9_decontaminate.best_scores(pairs).tolist() == want
    monkeypatch.setattr(op9_decontaminate, "CELLS", 1 << 13)
    assert op9_decontaminate.best_scores(pairs).tolist() == want and not len(op9_decontaminate.best_scores([]))


def test_hits_in_pieces_give_the_same(spark, small, monkeypatch):
    items = op9_decontaminate.Items(*map(list, zip(*((r["item_id"], r["text"]) for r in table(spark, small, "benchmark").collect()), strict=True)))
    texts = [r["text"] for r in table(spark, small, "documents").collect()]
    whole = op9_decontaminate._leaks(texts, items, 0.4)
    monkeypatch.setattr(op9_decontaminate, "HITS", 1000)
    assert any(whole) and op9_decontaminate._leaks(texts, items, 0.4) == whole


def test_blocks_of_items_give_the_same(spark, small, monkeypatch):
    whole = sorted(op9_decontaminate.query(spark, small).collect())
    assert whole
    monkeypatch.setattr(op9_decontaminate, "BLOCK_WORDS", 200)
    assert sorted(op9_decontaminate.query(spark, small).collect()) == whole


# 10


def slow_count(word, scores):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        options = [(best[i - 1][0] + op10_token_counts.UNKNOWN * size, -(-best[i - 1][1] + size))]
        options += [(best[k][0] + scores[word[k:i]], best[k][1] - 1) for k in range(i) if word[k:i] in scores]
        best.append(max(options, key=lambda o: (o[0], o[1])))
    return -best[-1][1]


def test_token_counts_equal_brute_force(spark, small, monkeypatch):
    scores = op10_token_counts.read_vocabulary()
    rows = [(r["doc_id"], r["text"][:3000], "s") for r in table(spark, small, "documents").limit(40).collect()] + [(900, None, "s"), (901, "", "s"), (902, " 漢字 😀x aaaaaaaaaa b ", "s"), (902, "the the", "s"), (903, "z" * 3000, "s")]
    want = sorted((i, len(words_of(t)), sum(slow_count("▁" + w, scores) for w in words_of(t))) for i, t, _ in rows)
    for nodes in (1_000_000, 50):
        monkeypatch.setattr(op10_token_counts, "NODES", nodes)
        got = op10_token_counts.count_tokens(docs(spark, rows), scores).collect()
        assert sorted(map(tuple, got)) == want
    assert op10_token_counts.count_tokens(docs(spark, []), scores).count() == 0


def test_trie_shares_prefixes():
    trie = op10_token_counts.Trie({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -1.5, "▁ab": -1.2})
    assert trie.add("▁abab") == 2 and trie.add("▁abb") == 2
    assert len(trie.best) == 1 + 5 + 1  # the root, five prefixes, one more for the second word


def test_token_counts_equal_a_library_with_the_same_scores(spark, small):
    """The words of sf0.001 whose characters all are pieces, encoded by another unigram implementation."""
    tokenizers = pytest.importorskip("tokenizers")
    scores = op10_token_counts.read_vocabulary()
    model = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -1000.0), *scores.items()], 0, False))
    words = {w for r in table(spark, small, "documents").collect() for w in words_of(r["text"])}
    words = sorted("▁" + w for w in words if all(c in scores for c in w))
    trie = op10_token_counts.Trie(scores)
    assert len(words) > 10_000 and [trie.add(w) for w in words] == [len(model.encode(w).ids) for w in words]


def test_long_words_need_no_memory(spark):
    import tracemalloc

    scores = op10_token_counts.read_vocabulary()
    word = "".join(np.random.default_rng(1).choice(list("abcdefgh-étn漢"), 400_000))
    trie = op10_token_counts.Trie(scores)
    tracemalloc.start()
    got = trie.tokens([word.encode(), b"the", word.encode()])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    short = op10_token_counts.Trie(scores)
    cut = "▁" + word[:2000]
    assert peak < 12_000_000 and len(trie.best) < 10 and trie.known.keys() <= {b"the"}
    assert short.add(cut) == short.rolled(cut) == slow_count(cut[:300], scores) + short.rolled(cut) - short.rolled(cut[:300])
    assert got == 2 * trie.rolled("▁" + word) + trie.add("▁the")


def test_token_counts_of_odd_columns(spark):
    df = spark.createDataFrame([("k", "the cat", 1, 2), ("k", None, 1, 2)], "n_words string, Text string, n_tokens int, words int")
    got = op10_token_counts.count_tokens(df.withColumnRenamed("n_words", "id"), op10_token_counts.read_vocabulary(), "id", "Text").collect()
    assert sorted((r["id"], r["n_words"]) for r in got) == [("k", 0), ("k", 2)]


def test_leaks_of_a_long_text_and_odd_rows(spark):
    item = [f"i{k}" for k in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (None, "x y z"), (4, " ".join(item))], "item_id long, text string")
    long = "pad " * 400_000 + " ".join(item[:20] + ["new"] + item[21:]) + " pad" * 1000
    df = docs(spark, [(1, long, "s"), (1, long, "s"), (2, None, "s"), (None, "", "s")])
    got = sorted((r["doc_id"] or 0, [(x["item_id"], round(x["score"], 3)) for x in r["leaks"]]) for r in op9_decontaminate.with_leaks(df, bench).collect())
    assert got == [(0, []), (1, [(1, 0.95), (4, 0.95)]), (1, [(1, 0.95), (4, 0.95)]), (2, [])]
