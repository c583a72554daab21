"""Language identification, quality rules, importance resampling."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from helpers import frame, odd_rows, prose, rng

from tideframe.llm import importance_sampling, language_id, quality_rules


def bilingual(n=160):
    r = rng(3)
    return [(i, prose(r, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(n)]


def test_language_of_held_out_documents(spark):
    got = {r.doc_id: r for r in language_id.language_id(frame(spark, bilingual()), sample_rows=60).collect()}
    held = [i for i in got if got[i].held_out]
    assert held and all(got[i].lang_pred == ("en" if i % 2 else "de") for i in held)
    assert all(0 <= r.score <= 1 and r.accepted for r in got.values())


def test_language_of_odd_rows(spark):
    rows = language_id.language_id(frame(spark, bilingual(60) + [(100 + i if r[0] is not None else None, r[1], None) for i, r in enumerate(odd_rows())])).collect()
    assert len(rows) == 70
    no_letter = [r for r in rows if r.doc_id in (101, 102, 103, 104)]
    assert [(r.lang_pred, r.score, r.accepted) for r in no_letter] == [("und", 0.0, False)] * 4
    assert all(r.lang_pred in ("en", "de") for r in rows if r.doc_id in (105, 106, 107, 108))


def test_language_of_unsure_texts_is_rejected(spark):
    strange = [(900, "щука жмых вьюга эхо юла " * 4, None), (901, "the and ing sch ein ich " * 10, None), (902, "qzx jvk wqj xkz vqz " * 5, None)]
    docs = frame(spark, bilingual() + strange)
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    assert all(got[i].lang_pred != "und" and got[i].score > 0.5 and not got[i].accepted for i in (900, 902))
    assert all(got[i].accepted for i in range(160))
    assert not {900, 902} & {r.doc_id for r in language_id.in_known_language(docs).collect()}
    # Rows without an id are judged one by one.
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") < 900, F.col("doc_id")))
    kept = language_id.in_known_language(unnamed)
    assert kept.columns == docs.columns and kept.count() == 160 + got[901].accepted


def test_held_out_documents_leave_the_model_unchanged(spark):
    rows = bilingual(120)
    docs = frame(spark, rows)
    out = {r.doc_id for r in docs.select("doc_id", language_id.held_out().alias("h")).filter("h").collect()}
    assert out == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    other = frame(spark, [(i, "qqq www" if i in out else t, "xx" if i in out else lang) for i, t, lang in rows])
    a, b = language_id.fit(docs), language_id.fit(other)
    assert a.languages == b.languages and a.threshold == b.threshold and np.array_equal(a.weights, b.weights)


def test_language_threshold():
    logits = np.log(np.array([[0.9, 0.1], [0.8, 0.2], [0.7, 0.3], [0.6, 0.4]]))
    sure = [0, 0, 0, 1]
    temperature, threshold = language_id._calibrate(logits, np.array(sure), 0.99)
    p = language_id._softmax(logits / temperature).max(1)
    assert (p >= threshold).tolist() == [True, True, True, False]
    temperature, threshold = language_id._calibrate(logits, np.array(sure), 0.99, np.array([1, 1, 1000, 1]))
    assert (language_id._softmax(logits / temperature).max(1) >= threshold).all()
    assert language_id._calibrate(logits, np.array([1, 1, 1, 1]), 0.99)[1] > 1 and language_id._calibrate(logits[:0], np.array([], int), 0.99)[1] > 1


def test_language_of_few_documents_is_learnt(spark):
    r = rng(4)
    rows = [(i, prose(r, "de" if i % 100 == 7 else "en"), "de" if i % 100 == 7 else "en") for i in range(1200)]
    model = language_id.fit(frame(spark, rows), sample_rows=30)
    got = language_id.identify(frame(spark, rows), model).collect()
    assert model.languages == ("de", "en") and all(x.lang_pred == rows[x.doc_id][2] for x in got)


def test_language_without_rows_or_labels(spark):
    assert language_id.language_id(frame(spark, bilingual(4)).filter("false")).count() == 0
    unlabelled = frame(spark, bilingual(4)).withColumn("lang", language_id.F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_rule_counts_and_base(spark):
    r = rng(4)
    rows = odd_rows()[1:] + [(20 + i, "\n".join(r.choices(["a b c d e f", "g h", " ", "x # $y", "ein Satz hier"], k=r.randint(1, 12)))) for i in range(40)]
    labels = spark.createDataFrame([(20, 1, 0), (21, 0, 0), (None, 1, 0), (22, None, 0)], "doc_id long, quality int, toxic int")
    for row in quality_rules.quality_rules(frame(spark, rows), labels, sample_rows=50).collect():
        text = next(t for i, t in rows if i == row.doc_id)
        n_words, *rest, repeat = plain_counts(text)
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n_words, *rest, repeat)
        assert row.base_failed == (n_words < 10 or 100 * repeat > 20 * n_words) and not (row.base_failed and row.kept)


def test_forest_rejects_what_labels_call_bad(spark):
    r = rng(5)
    rows = [(i, prose(r) if i % 5 else " ".join(w + "###" for w in prose(r).split())) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in quality_rules.quality_rules(frame(spark, rows), labels).collect()}
    assert np.mean([got[i] == (i % 5 > 0) for i in range(200, 400)]) > 0.97
    kept = quality_rules.passing_rules(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and {x.doc_id for x in kept.collect()} == {i for i in got if got[i]}
    # Rows without an id are judged one by one, and the stage says what the table of verdicts says.
    unnamed = frame(spark, [(None if i < 100 else i, t) for i, t in rows])
    said = quality_rules.quality_rules(unnamed, labels).filter("doc_id is null and kept").count()
    assert 0 < said < 100 and quality_rules.passing_rules(unnamed, labels).filter("doc_id is null").count() == said
    unlabelled = quality_rules.quality_rules(frame(spark, rows), labels.filter("false")).collect()
    assert all(x.kept != x.base_failed for x in unlabelled)
    assert quality_rules.quality_rules(frame(spark, rows).filter("false"), labels).count() == 0


def plain_weights(rows, good):
    grams = {}
    for i, t in rows:
        buckets, _ = importance_sampling.gram_buckets([t or ""])
        grams[i] = Counter(buckets.tolist())
    raw = sum(grams.values(), Counter())
    target = sum((grams[i] for i in good), Counter())
    b = importance_sampling.BUCKETS
    out = {}
    for i, own in grams.items():
        out[i] = sum(n * (np.log((target[k] + 1) / (sum(target.values()) + b)) - np.log((raw[k] - n + 1) / (sum(raw.values()) - sum(own.values()) + b))) for k, n in own.items())
    return out


def test_importance_weights_and_draw(spark):
    r = rng(6)
    rows = [(i, prose(r, "en" if i % 3 else "de", r.randint(0, 60))) for i in range(90)] + [(90, None), (91, ""), (92, "!!")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 90, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance_sampling.importance_sample(frame(spark, rows), labels, share=0.6).collect()
    want = plain_weights(rows, [i for i in range(0, 90, 2) if i % 3])
    assert all(abs(x.log_weight - want[x.doc_id]) < 1e-6 for x in got)
    keys = sorted((x.gumbel_key for x in got), reverse=True)
    k = round(0.6 * len(rows))
    assert {x.doc_id for x in got if x.kept} == {x.doc_id for x in got if x.gumbel_key >= keys[k - 1]} and sum(x.kept for x in got) == k
    assert importance_sampling.importance_sample(frame(spark, rows).filter("false"), labels).count() == 0
    # By default the labels say how many: as few as hold 99 % of the good ones.
    drawn = importance_sampling.importance_sample(frame(spark, rows), labels, keep_good=0.9).collect()
    good = sorted((x.gumbel_key for x in drawn if x.doc_id in {i for i in range(0, 90, 2) if i % 3}), reverse=True)
    last = good[math.ceil(0.9 * len(good)) - 1]
    assert {x.doc_id for x in drawn if x.kept} == {x.doc_id for x in drawn if x.gumbel_key >= last} and any(not x.kept for x in drawn)
    assert all(x.kept for x in importance_sampling.importance_sample(frame(spark, rows), labels.filter("false")).collect())


def test_importance_sampling_moves_grams_not_texts(spark):
    r = rng(8)
    texts = [prose(r, "en", r.randint(0, 400)) for _ in range(40)] + ["", "!!", "word " * 3000]
    bucket, owner = importance_sampling.gram_buckets(texts)
    packed = importance_sampling.packed_grams(bucket, owner, len(texts))
    got_bucket, got_owner = importance_sampling.unpacked_grams(packed)
    assert sorted(zip(owner.tolist(), bucket.tolist())) == list(zip(got_owner.tolist(), got_bucket.tolist()))
    assert sum(map(len, packed)) < 0.5 * sum(map(len, texts)) and importance_sampling.packed_grams(bucket[:0], owner[:0], 2) == [b"", b""]
    # Small labels take the same plan as large ones, so that the cost at small sizes tells the cost at large ones.
    ids = spark.range(10).withColumnRenamed("id", "doc_id")
    joined = importance_sampling.labelled(importance_sampling.grams_of(frame(spark, list(enumerate(texts)))), ids)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert joined.columns == ["doc_id", "noise_seed", "grams"] and "SortMergeJoin" in plan and "Broadcast" not in plan and joined.count() == 10


def test_language_is_learnt_from_all_labelled_documents(spark):
    r = rng(9)
    rows = [(i, prose(r, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(400)]
    # A few documents are in words that the twelve drawn ones do not hold.
    rows += [(1000 + i, " ".join(r.choices("krzw pljm vgdr xhtq bnyf".split(), k=60)), "de") for i in range(30)]
    docs = frame(spark, rows)
    model, again = language_id.fit(docs, sample_rows=12), language_id.fit(docs.repartition(7), sample_rows=12)
    assert np.array_equal(model.weights, again.weights) and (model.temperature, model.threshold) == (again.temperature, again.threshold)
    lone = np.unique(language_id._subwords(["krzw pljm vgdr xhtq bnyf"], language_id._letters())[0])
    assert (model.weights[lone, 0] - model.weights[lone, 1]).min() > 0.2
    got = {x.doc_id: x for x in language_id.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)


def test_language_sample_reaches_the_driver_packed(spark):
    r = rng(10)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(400)), "en" if i % 2 else "de") for i in range(120)]
    rows += [(200 + i, rows[0][1], "de") for i in range(6)]
    marked = language_id._labelled(frame(spark, rows))
    language_id._sample(marked, 2)  # imports
    tracemalloc.start()
    try:
        got, counts = language_id._sample(marked, 2000)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    chosen = {i: (t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    entries = sum(len(x[1]) for x in got)
    assert len(got) == len(chosen) == sum(counts.values()) and entries > 150_000
    assert peak < 24 * entries  # Python's own numbers in lists take over 70 bytes for each
    letters = language_id._letters()
    want = [(lang, *(x.tolist() for x in np.unique(language_id._subwords([t], letters)[0], return_counts=True))) for t, lang in chosen.values()]
    assert [(x[0], x[1].tolist(), x[2].tolist()) for x in got] == sorted(want)
    # Copies stand as they were drawn.
    drawn = marked.filter(F.col("text") == rows[0][1]).orderBy("draw").collect()
    copies = [x[3] for x in got if x[0] == "de" and x[1].tolist() == np.unique(language_id._subwords([rows[0][1]], letters)[0]).tolist()]
    assert len(drawn) > 2 and copies == [x.back for x in drawn]


def test_quality_stage_moves_no_texts(spark):
    r = rng(11)
    bad = lambda: " ".join(w + "###" for w in prose(r).split())
    rows = [(i, prose(r) if i % 5 else bad()) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = quality_rules.passing_rules(frame(spark, rows), labels)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and 200 < kept.count() < 300
        # Of rows that share an id all must pass, whichever of them would.
        shared = frame(spark, rows + [(201, bad()), (202, prose(r)), (None, prose(r)), (None, bad())])
        said = quality_rules.quality_rules(shared, labels).collect()
        lost = {x.doc_id for x in said if x.doc_id is not None and not x.kept}
        kept = quality_rules.passing_rules(shared, labels)
        assert 201 in lost and 202 not in lost and kept.columns == shared.columns
        assert Counter(x.doc_id for x in kept.collect()) == Counter(x.doc_id for x in said if x.kept and x.doc_id not in lost)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
