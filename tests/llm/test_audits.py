"""Exact top-k search, source divergence, filter interactions: each against brute force."""

import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from helpers import frame, odd_rows, prose, rng

from tideframe.llm import divergence_audit, filter_audit, topk_search


# ---- filter interactions --------------------------------------------------------


def plain_fails(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    capitals = len(re.findall("[A-Z]", text))
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * capitals > 3 * len(text), "D": bool(re.search("[#$%&*|]", text))}


def plain_interactions(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails = []
    for i, text, lang in rows:
        own = plain_fails(text or "")
        own["E"] = i is not None and i > first[text or ""]
        fails.append((lang or "", {k for k, v in own.items() if v}, i))
    out = {}
    for part in {p for p, _, _ in fails}:
        shapley, own = Counter(), {}
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in fails if f[0] == part]
            for step, name in enumerate(order):
                gone = [f for f in left if name in f[1]]
                left = [f for f in left if name not in f[1]]
                whole = [f for f in fails if f[0] == part]
                shapley[name] += len(gone)
                own[order, step + 1] = [len(left), len(gone), sum(name in f[1] for f in whole) - len(gone), sum(f[1] == {name} for f in whole), sum(f[2] in good for f in gone), sum(f[2] in toxic for f in gone)]
        out |= {(part, order, step): (*v, shapley[order[step - 1]]) for (order, step), v in own.items()}
    return out


def audit_rows():
    r = rng(21)
    rows = [(*x, "en") for x in odd_rows()]
    for i in range(40):
        text = prose(r, words=r.choice([20, 210, 230])) if i % 3 else "same word here " * 80
        text += r.choice(["", "", " # mark", " LOUD LOUD LOUD" * 20])
        rows.append((100 + i, text, r.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[20 + i][1], "fr") for i in range(6)] + [rows[25], rows[25], (3000000000, "A" * 70000, "de"), (None, rows[30][1], "de"), (None, rows[30][1], "de")]
    return rows


def test_filter_interactions(spark):
    rows = audit_rows()
    labels = [(100 + i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(101, None, 1), (100, 1, 0), (None, 1, 1)]
    table = spark.createDataFrame([(i, None if q is None else int(q), int(t), "x") for i, q, t in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.filter_interactions(frame(spark, rows), table)
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert found == plain_interactions(rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert filter_audit.filter_interactions(frame(spark, rows).filter("false"), table).count() == 0
    assert filter_audit.filter_interactions(frame(spark, rows), table.filter("false")).agg({"good_lost": "max"}).first()[0] == 0


def test_packed_fields_do_not_run_over():
    width = 16
    full = 2**width - 1
    total = full * filter_audit.packed(31 + 96, width)
    fields = filter_audit.unpacked(total, width)
    # A document that fails all filters is removed by the first of each order and redundant for the others.
    assert fields[:5] == [0, full, 0, full, full] and fields[5:10] == [0, 0, full, 0, 0]
    assert fields[-5:] == [0] * 5 and filter_audit.unpacked(filter_audit.packed(4, 8), 8)[-5:] == [0, 0, 1, 0, 0]
    assert len(filter_audit.ORDERS) == 120 and len(fields) == 3005


# ---- source divergence ----------------------------------------------------------


def plain_divergence(rows, least):
    words = [(lang or "", source or "", Counter(re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    holders, counts, groups = Counter(), defaultdict(Counter), set()
    for lang, source, own in words:
        groups.add((lang, source))
        for w, n in own.items():
            holders[lang, w] += 1
            counts[lang, source][w] += n
            counts[lang][w] += n
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (at, w), n in holders.items() if at == lang and n >= least]

        def shares(c):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept}

        whole = shares(counts[lang])
        own = {s: shares(counts[lang, s]) for at, s in groups if at == lang}
        for s, p in own.items():
            pairs = sorted(((sum(abs(p[w] - q[w]) for w in kept), t) for t, q in own.items() if t != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((p[w] - whole[w], w) for w in kept if counts[lang, s][w] and p[w] > whole[w]), key=lambda x: (-x[0], x[1].encode()))
            for part, found in (("pair", pairs), ("term", terms[:50])):
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(spark, monkeypatch, small):
    if small:
        for name, value in (("TILE", 3), ("TERM_ROWS", 40), ("COLUMNS", 9), ("HELD_TERMS", 50)):
            monkeypatch.setattr(divergence_audit, name, value)
    monkeypatch.setattr(divergence_audit, "LEAST_DOCUMENTS", 3)
    r = rng(22)
    rows = []
    for _ in range(160):
        lang = r.choice(["en", "de", None, ""])
        text = prose(r, "de" if lang == "de" else "en", words=r.randint(0, 60)) + r.choice(["", " The THE the", " ÄÖ äö \u00a0", " a-b_c1d"])
        rows.append((text, lang, r.choice(["s1", "S2", "s3", "é", "z", "", None, "s8"])))
    rows += [(None, "en", "empty"), ("only", "xx", "one"), ("only", "xx", "two"), ("12 34", "en", "numbers"), ("the " * 5000, "en", "s1"), rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, lang, s, "x", 1) for i, (t, lang, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(5)
    got = divergence_audit.source_divergence(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plain_divergence(rows, 3)
    assert divergence_audit.source_divergence(df.filter("false")).count() == 0
    # No kept term anywhere: pairs at 0, ranked by name.
    monkeypatch.setattr(divergence_audit, "LEAST_DOCUMENTS", 10**6)
    assert {tuple(x) for x in divergence_audit.source_divergence(df).collect()} == {
        (a, s, "pair", t, 0, k + 1) for a, own in groups_of(rows).items() for s in own for k, t in enumerate(sorted(own - {s}, key=str.encode))}


def groups_of(rows):
    out = defaultdict(set)
    for _, lang, source in rows:
        out[lang or ""].add(source or "")
    return out


def test_joint_tables_price_every_pair():
    r = np.random.default_rng(5)
    level = r.integers(0, 6, (300, 7))
    price = level * 17 + np.arange(7)[None, :]
    total = np.zeros((7, 7), np.int64)
    divergence_audit._joint_prices(level, price, np.arange(7), np.arange(7), total, 20)
    assert (total == np.abs(price[:, :, None] - price[:, None, :]).sum(0)).all()


# ---- top-k search ----------------------------------------------------------------


def plain_top(rows, k, every):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, own in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        found = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q and len(v) == len(own))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        for name, value in (("BLOCK", 4), ("RANGE_ROWS", 16), ("QUERY_ROWS", 5), ("BOUND_RANGES", 3)):
            monkeypatch.setattr(topk_search, name, value)
    g = np.random.default_rng(6)
    centres = g.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.4 * g.normal(size=8)).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(40)] + [(40, rows[3][1]), (40, rows[40][1]), (None, [9.0] * 8), (2000, None), (2001, []), (2020, [float("nan")] * 8), (2040, [None] + [1.0] * 7), (2060, [float("inf")] * 8)]
    rows += [(-20, [-1.5] * 8), (3000, [1.0, 2.0]), (3001, [2.0, -2.0]), (3020, [0.0, 0.0]), (4000, [100.0] * 8), (5000, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, label int, range string, score int").repartition(4)
    got = topk_search.top_k(df, k=7)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_top(rows, 7, 20)
    assert topk_search.top_k(df.filter("false")).count() == 0
    assert topk_search.top_k(df.filter("vec_id = 1")).count() == 0


def test_large_components_take_no_part(spark):
    rows = [(0, [2.0**24] * 64), (1, [2.0**20] * 64), (20, [2.0**21] * 64), (3, [-(2.0**21)] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk_search.top_k(df).collect()) == [(20, 1, 1, 64 * 2**27 * 2**26), (20, 2, 3, -64 * 2**27 * 2**27)]


def test_blocks_below_the_kth_score_are_left(spark):
    g = np.random.default_rng(8)
    centres = g.normal(size=(8, 16)) * 2
    import pyarrow as pa

    x = np.floor(64 * np.repeat(centres, 50, 0) + 3 * g.normal(size=(400, 16))).astype(np.int64)
    parts = [x[i : i + 25] for i in range(0, 400, 25)]
    index = pa.table({"ids": [list(range(25 * k, 25 * k + 25)) for k in range(16)], "vectors": [p.ravel().tolist() for p in parts], "high": [p.max(0).tolist() for p in parts], "low": [p.min(0).tolist() for p in parts]})
    asked = np.arange(0, 400, 20)
    queries = pa.table({"vec_id": asked, "vector": x[asked].tolist(), "least": np.full(len(asked), topk_search._EARLIEST)})
    score, ids, scored = topk_search._search(queries, index, 10)
    for row, q in enumerate(asked):
        want = sorted((-int(x[q] @ x[i]), i) for i in range(400) if i != q)[:10]
        assert list(zip((-score[row]).tolist(), ids[row].tolist())) == want
    assert scored < 16 * len(asked) / 3
