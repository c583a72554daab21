"""Suffix dedup, n-gram Jaccard join, embedding near-dedup: each against brute force."""

import hashlib

import numpy as np
import pytest
from helpers import frame, odd_rows, prose, rng, shingles

from tideframe.llm import embedding_dedup, jaccard_join, suffix_dedup
from tideframe.llm.common import components


def plain_repeats(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(raw[s : s + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def passages(seed=7):
    r = rng(seed)
    shared = [prose(r, words=50) for _ in range(8)]
    rows = []
    for i in range(50):
        text = prose(r, words=r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, 60)
            text += r.choice(shared)[at : at + r.randint(80, 240)] + prose(r, words=r.randint(0, 20))
        rows.append((i, text))
    return rows + [(60, None), (61, ""), (62, "a" * 700), (63, "ab" * 300), (64, "é" * 130), (65, rows[3][1]), (66, "a" * 99), (67, "a" * 100)]


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_repeated_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SECTION", 300)
    rows = passages()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_suffixes(frame(spark, rows)).collect()}
    assert got == plain_repeats(rows)


def test_grams_with_too_many_places_go_to_the_merge_at_once(spark, monkeypatch):
    rows = passages()
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 1)
    monkeypatch.setattr(suffix_dedup, "MEET_HOT", 3)
    docs = frame(spark, rows + rows[20:23])
    hot = suffix_dedup._hot_grams(docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) as doc_key"))
    assert len(hot) > 5
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_suffixes(docs).collect()}
    assert got == plain_repeats(rows)


def test_repeated_rows_are_one_document(spark):
    rows = passages()
    twice = [rows[5], rows[20], rows[20], (64, "é" * 130), (None, "z" * 40 + rows[7][1])]
    want = plain_repeats([(-1 if i is None else i, t) for i, t in rows + twice[-1:]])
    got = suffix_dedup.dedup_suffixes(frame(spark, rows + twice + twice[-1:])).collect()
    assert len(got) == len(rows) + len(twice) + 1
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[-1 if r.doc_id is None else r.doc_id] for r in got)
    again = [(i, t) for i, t in rows if t and i < 50]
    texts = lambda frame_: {r.doc_id: r.text for r in suffix_dedup.without_repeats(frame_).collect()}
    assert texts(frame(spark, again + again)) == texts(frame(spark, again))


def test_merge_of_front_coded_runs():
    r = rng(8)
    keys = ["".join(r.choices("ab", k=r.randint(0, 9))).encode() for _ in range(300)]
    runs = []
    for k in range(7):
        own = sorted(keys[k::7])
        runs.append([(suffix_dedup.common_prefix(a, b, 0) if i else 0, b[suffix_dedup.common_prefix(a, b, 0) if i else 0 :]) for i, (a, b) in enumerate(zip([b"", *own], own))])
    merged = list(suffix_dedup.merge_runs(runs))
    assert [m[3] for m in merged] == sorted(keys)
    assert [m[0] for m in merged[1:]] == [suffix_dedup.common_prefix(a[3], b[3], 0) for a, b in zip(merged, merged[1:])]


def test_texts_without_repeats_keep_their_columns(spark):
    rows = odd_rows()
    out = suffix_dedup.without_repeats(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_chars) for r in out.collect() if r.text is not None)
    assert len(got) == len(rows) - 1 and all(n == len(t) for _, t, n in got)
    assert suffix_dedup.dedup_suffixes(frame(spark, rows)).filter("doc_id = 5").select("kept_sha256").distinct().count() == 1
    assert suffix_dedup.dedup_suffixes(frame(spark, rows).filter("false")).count() == 0


def plain_join(rows, threshold=80):
    sets = {i: shingles(t) for i, t in rows}
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (top(i), links[i]) for i in sets}


def near_copies(seed=9):
    r = rng(seed)
    bases = [prose(r, words=120).split() for _ in range(12)]
    rows = []
    for i in range(150):
        own = list(bases[0] if i < 60 else r.choice(bases))
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = prose(r, words=1)
        rows.append((i, r.choice([" ", ", "]).join(own)))
    return rows + [(200, None), (201, ""), (202, "a b"), (203, "A  b!"), (204, "!!"), (205, "a b c d e"), (206, "a b c d e")]


@pytest.mark.parametrize("small", [jaccard_join.SMALL, 8])
def test_similar_documents(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    if small == 8:
        monkeypatch.setattr(jaccard_join, "NODE_BLOCK", 16)
        monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", 16)
    rows = near_copies()
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    want = plain_join(rows)
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == {i for i, (c, _) in want.items() if c == i}


def test_similar_documents_odd_rows(spark):
    kept = jaccard_join.one_of_each_group(frame(spark, odd_rows()))
    assert kept.columns == frame(spark, []).columns and kept.count() == len(odd_rows())
    assert jaccard_join.jaccard_join(frame(spark, odd_rows()).filter("false")).count() == 0


def test_rows_without_an_id_are_told_apart(spark):
    rows = near_copies()
    words = [t for i, t in rows if i in (0, 70)]
    unnamed = [(None, words[0]), (None, prose(rng(77), words=60)), (None, None), (None, "!!"), (None, words[1] + " more")]
    kept = jaccard_join.one_of_each_group(frame(spark, rows + unnamed)).filter("doc_id is null").collect()
    assert {r.text for r in kept} == {unnamed[1][1], None, "!!"}


def test_stars_that_share_a_node_become_one_group(spark):
    links = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (12, 2), (2, 13), (31, 30)], "u long, v long")
    got = {r.node: r.component for r in jaccard_join._contracted(links).collect()}
    assert got == {**dict.fromkeys((1, 2, 10, 11, 12, 13), 1), 30: 30, 31: 30}


def test_a_text_moves_once_to_its_spans(spark, monkeypatch):
    seen, marked = [], suffix_dedup.spans_by_document
    monkeypatch.setattr(suffix_dedup, "spans_by_document", lambda docs: (seen.append(docs.schema), marked(docs))[1])
    docs = frame(spark, passages())
    got = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).select("doc_id", "text").collect()}
    assert "text" in seen[0].names and "text" not in seen[0]["row"].dataType.names
    assert set(got) == {i for i, _ in passages()} and got[60] is None and got[66] == "a" * 99


@pytest.mark.parametrize("kind", ["copies", "phrases"])
def test_only_strings_that_may_repeat_move_to_the_merge(spark, monkeypatch, kind):
    seen, runs = [], suffix_dedup.sorted_runs
    monkeypatch.setattr(suffix_dedup, "sorted_runs", lambda *a: (seen.append(runs(*a)), seen[-1])[1])
    r = rng(31)
    if kind == "copies":
        texts = [prose(r, words=400) for _ in range(6)]
        rows = [(10 * k + i, t if k % 2 else prose(r, words=3) + t + prose(r, words=3)) for k in range(20) for i, t in enumerate(texts)]
    else:
        rows = [(i, f"{prose(r, words=30)} as many said in those days, and often {prose(r, words=30)}") for i in range(200)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup_suffixes(frame(spark, rows)).collect()}
    assert got == plain_repeats(rows)
    assert (sum(x[1] for x in got.values()) > 0) == (kind == "copies")
    moved = sum(len(x.rests) + len(x.lefts) for x in seen[0].select("rests", "lefts").collect())
    assert moved < 0.15 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("form", [suffix_dedup.dedup_suffixes, suffix_dedup.without_repeats])
def test_both_joins_read_one_exchange_of_the_texts(spark, form):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = form(frame(spark, passages()))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("ReusedExchange" in x and "text" in x and "hashpartitioning(doc_key" in x for x in plan.splitlines()), plan


def plain_vectors(rows, threshold=0.9):
    sound = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            sound[i] = np.asarray(v, float) / np.linalg.norm(v)
    root, links = {i: i for i, _ in rows}, dict.fromkeys((i for i, _ in rows), 0)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sound:
        for j in sound:
            if i < j and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (links[i], top(i), top(i) == i) for i, _ in rows}


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 12])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    g = np.random.default_rng(4)
    centres = g.normal(size=(9, 12))
    rows = [(i, (centres[i % 9] + 0.33 * g.normal(size=12)).tolist()) for i in range(140)]
    rows += [(200 + i, v) for i, v in enumerate([None, [], [0.0] * 12, [float("nan")] * 12, [None] + [1.0] * 11, [float("inf")] + [1.0] * 11, rows[0][1], [2 * x for x in rows[0][1]], [1.0, 2.0], [2.0, 4.1]])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, node string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df, cells=6, slack_degrees=90).collect()}
    assert got == plain_vectors(rows)
    assert embedding_dedup.embedding_dedup(df.filter("false")).count() == 0


def test_many_cells_in_the_registered_form(spark):
    g = np.random.default_rng(14)
    centres = g.normal(size=(60, 32))
    rows = [(i, (centres[i % 60] + 0.2 * g.normal(size=32)).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(df, cells=40).collect()}
    want = plain_vectors(rows)
    found, there = (sum(x[0] for x in y.values()) for y in (got, want))
    assert 0.98 * there <= found <= there and all(got[i][0] <= want[i][0] for i in got)
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.98 * len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (103, 100)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}, **{200 + i: 200 for i in range(30)}}
