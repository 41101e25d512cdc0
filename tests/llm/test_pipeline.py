import re

import corpus_pipeline
import numpy as np
import test_models as slow
from pyspark.sql import functions as F

from quern.llm import op6_pii, op7_toxicity, op8_near_dedup, op9_decontaminate
from quern.llm.common import materialize, table


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, seen[-1], sf)
        out = materialize(found, "test")
        seen.append(out)
        if k < 4:
            assert out.columns == docs.columns
    clean, alone, fresh, masked, mix = seen[1:]
    model_free = {r["doc_id"] for r in op7_toxicity.judge(docs, table(spark, sf, "labels")).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == model_free
    assert op8_near_dedup.near_duplicates(alone).where("not kept").count() == 0
    assert op8_near_dedup.near_duplicates(clean).where("kept").count() == alone.count() < clean.count()
    assert op9_decontaminate.with_leaks(fresh, table(spark, sf, "benchmark")).where(F.size("leaks") > 0).count() == 0
    assert fresh.count() < alone.count() and masked.count() == fresh.count() == mix.count()
    assert op6_pii.find(masked).where(F.size("spans") > 0).count() == 0
    assert masked.where("n_chars <> char_length(text)").count() == 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, mix.collect()))


def test_run_equals_brute_force(spark, small):
    """The whole run over sf0.001, stage by stage in plain Python: all pairs, all alignments, spans cut by hand, targets in a loop."""
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = op7_toxicity.fit(docs, labels)
    scores = dict(zip(rows, model.scores([r["text"] for r in rows.values()]), strict=True))
    clean = {i: r["text"] for i, r in rows.items() if scores[i] < 0.7}
    groups = slow.brute_groups(list(clean.items()), 5, 80)
    alone = {i: t for i, t in clean.items() if groups[i][1] == i}
    bench = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), r["text"])) for r in table(spark, small, "benchmark").collect()]
    numbers = {w: k for k, w in enumerate(sorted({w for item in bench for w in item}))}
    items = [np.array([numbers[w] for w in item]) for item in bench]
    fresh = {}
    for i, t in alone.items():
        words = np.array([numbers.get(w, -1) for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))], dtype=int)
        best = op9_decontaminate.best_scores([(item, words) for item in items])
        if not any(s >= max(0.8 * len(item), 2 * min(3, len(item))) for s, item in zip(best, items, strict=True)):
            fresh[i] = t
    kept = spark.createDataFrame([(i, t) for i, t in fresh.items()], "doc_id long, text string")
    masked = {}
    for r in op6_pii.find(kept).collect():
        text, out, at = fresh[r["doc_id"]] or "", [], 0
        for s in r["spans"]:
            if s["start"] >= at:
                out.append(f"{text[at : s['start']]}[{op6_pii.KINDS[s['kind']].upper()}]")
            at = max(at, s["end"])
        masked[r["doc_id"]] = "".join(out) + text[at:]
    size = {i: len(slow.words_of(t)) for i, t in masked.items()}
    sizes = {}
    for i, n in size.items():
        sizes[rows[i]["source"]] = sizes.get(rows[i]["source"], 0) + n
    want, given = slow.brute_targets(sizes), {}
    got = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(size) < len(alone) < len(clean) <= len(rows)
    for r in got:
        s = rows[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        given[s] = given.get(s, 0) + r["taken"]
    assert all(abs(given[s] - want[s]) <= 1 for s in sizes)


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "q w e r t y u", "en", "s", 1), (None, "z x c v b n m", "en", None, 1), (None, "z x c v b n m", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 2]
    other = spark.createDataFrame([(1, "another text under the same id", "en", "s", 1), (4, "a b c d e f g", "en", "s", 1)], docs.schema)
    got = corpus_pipeline.near_duplicates(spark, docs.union(other), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][:1]) for r in got) == [(0, "z"), (0, "z"), (1, "a"), (1, "a"), (2, "q")]


def test_stages_keep_other_columns(spark, small):
    base = table(spark, small, "documents")
    odd = base.withColumns({"score": F.lit("x"), "leaks": F.lit(2), "nth": F.create_map(F.lit("a"), F.lit(1)), "found": F.col("lang")})
    odd = odd.unionByName(odd.limit(3)).withColumns({"source": F.when(F.col("doc_id") % 3 > 0, F.col("source")), "text": F.when(F.col("doc_id") % 50 > 0, F.col("text"))})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, small)
        assert out.columns == odd.columns
        odd = materialize(out, "odd")
    assert set(r["found"] for r in odd.select("found").distinct().collect()) <= {"en", "de", "fr", "es"}
    mixed = corpus_pipeline.mixing(spark, odd, small)
    assert mixed.count() == odd.count()


def test_empty_corpus(spark, small):
    docs = table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
