"""Packing, SentencePiece, WARC, license scans, and the pipeline."""

import gzip
import os
import re
import sys
import types
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import WORDS, frame, odd_rows, prose, rng
from pyspark.sql import functions as F

import corpus_pipeline
from tideframe.llm import common, license_scan, packing, sentence_pieces, warc


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


PARTS = ["a", "foo", " ", "  ", "\n", "\t", " ", "'s", "9", "é", "!", "　", "<|endoftext|>", "\x1c", "\r\n", ",", "###", "a,", "日本", "▁", "ing", "\U0001f600", "ß", "     "]


def mixtures(n=3000, seed=10):
    r = rng(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, 12))) for _ in range(n)]


def test_token_ids_equal_the_tokenizers(spark):
    texts = mixtures()
    own = packing.token_encoder(packing.default_tokenizer())(texts)
    assert own == [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    monkeypatch.setattr("tideframe.llm.common.SLICE_BYTES", 200)
    encode, r = packing.token_encoder(packing.default_tokenizer()), rng(14)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>", *(prose(r, words=12) for _ in range(60)), *mixtures(200)]
    assert np.frombuffer(encode(texts[:1])[0], "<u4").tolist() == [64, 220, 50256, 275]
    for _ in range(2):
        assert encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_packing_places_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 4)
    r = rng(11)
    rows = odd_rows() + [(20 + i, prose(r, words=r.choice([0, 5, 200, 900, 3000]))) for i in range(60)]
    docs = frame(spark, rows)
    placed = packing.best_fit_packing(docs).collect()
    ids = Counter()
    for (doc, _), e in zip(rows, tokenizer().encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        all_ids = [*e.ids, 0]
        for k, (start, n) in enumerate(packing.cut(len(all_ids))):
            ids[doc, k, start, n, zlib.crc32(np.asarray(all_ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in placed) == ids
    by_sequence = {}
    for p in placed:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(by_sequence) <= -(-sum(p.length for p in placed) // packing.CAPACITY) + 1
    out = packing.sequences(docs, packing.best_fit_packing(docs)).collect()
    whole = {x.sequence_id: bytes(x.ids) for x in out}
    assert all(zlib.crc32(whole[p.sequence_id][4 * p.offset : 4 * (p.offset + p.length)]) == p.ids_crc32 for p in placed)
    assert {k: len(v) // 4 for k, v in whole.items()} == {k: sum(n for _, n in v) for k, v in by_sequence.items()}
    assert packing.best_fit_packing(docs.filter("false")).count() == 0


def fewest(lengths, capacity):
    """Fewest sequences by search over all placements."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= lengths[i]}.values()):
            go(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
        go(i + 1, rooms + [capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best[0]


def test_dominance_loses_no_sequence():
    r = rng(12)
    for _ in range(150):
        capacity = r.choice([10, 12, 17])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(1, 10))]
        count = [0] * (capacity + 1)
        for n in lengths:
            count[n] += 1
        fixed = packing.reduce_by_dominance(count, capacity)
        rest = [n for n in range(capacity + 1) for _ in range(count[n])]
        assert all(sum(n * k for n, k in content) <= capacity for content, _ in fixed)
        assert sum(times for _, times in fixed) + fewest(rest, capacity) == fewest(lengths, capacity)
        assert sum(times for _, times in packing.plan(Counter(lengths), capacity)) <= fewest(lengths, capacity) + 1


def test_pieces_equal_the_library(spark):
    texts = mixtures() + [" " * n for n in range(40)] + ["a" * 3000]
    model = sentence_pieces.PieceModel(sentence_pieces.default_model())
    ids = model.encode(texts)
    assert ids == model.library.encode(texts, num_threads=1)
    assert [model.decode(i) for i in ids] == [model.library.decode(i) for i in ids]


def test_models_of_another_kind_are_refused(tmp_path):
    raw = open(sentence_pieces.default_model(), "rb").read()
    assert sentence_pieces.model_kind(raw) == "bpe"
    piece, settings = b"\x0a\x03\x0a\x01a", lambda kind: b"\x12\x02\x18" + bytes([kind])
    assert [sentence_pieces.model_kind(piece + settings(k)) for k in (1, 2, 3, 4)] == ["unigram", "bpe", "word", "char"]
    assert sentence_pieces.model_kind(piece) == "unigram"
    (tmp_path / "u.model").write_bytes(piece + settings(1))
    with pytest.raises(ValueError, match="unigram"):
        sentence_pieces.PieceModel(str(tmp_path / "u.model"))


def test_pieces_round_trip(spark):
    rows = odd_rows() + [(20, prose(rng(13))), (21, "zwei\nZeilen")]
    docs = frame(spark, rows)
    got = sentence_pieces.round_trip(docs).collect()
    assert len(got) == len(rows) and all(r.same for r in got if r.n_ids is not None) and sum(r.n_ids is None for r in got) == 1
    back = sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert sentence_pieces.round_trip(docs.filter("false")).count() == 0


def pages(spark):
    body = "<html>" + "x" * 200
    rows = [(5, "http://a/ b\r\nX: y", body), (3, None, body), (9, "u", body), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "WARC/1.1\r\n\r\n" * 30), (None, "u", body), (8, "u", "é" * 60), (10, "u", "é" * 60)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")


def test_archives_round_trip(spark):
    import hashlib

    rows, df = pages(spark)
    got = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if h == html and len(raw) >= 100 and j is not None]
        first = min(same) if same and sum(h == html for _, _, h in rows) > 1 else i
        want = ("response", None) if first == i else ("revisit", first)
        assert (got[i].record_type, got[i].refers_to) == want
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert warc.archive_and_read(df.filter("false")).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_skip_and_push_down(spark, tmp_path, compression):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.page_records(df), path, compression)
    assert warc.read_archives(spark, path).filter("record_type = 'warcinfo'").count() >= 1
    one = warc.read_archives(spark, path, ["record_id", "payload"], headers={"WARC-Record-ID": "<urn:page:7>"}).collect()
    assert [(r.record_id, bytes(r.payload)) for r in one] == [("urn:page:7", b"WARC/1.1\r\n\r\n" * 30)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = warc.read_archives(spark, path).filter("record_type = 'revisit'")
        assert {r.record_id for r in pushed.collect()} == {"urn:page:5", "urn:page:9", "urn:page:", "urn:page:10"}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    packed = tmp_path / "z"
    packed.mkdir()
    # The same archives as any gzip writer packs them.
    for k, f in enumerate((tmp_path / "w").glob("*.warc*")):
        plain = f.read_bytes() if compression == "none" else gzip.decompress(f.read_bytes())
        (packed / f"{k}.warc.gz").write_bytes(gzip.compress(plain))
    assert warc.read_archives(spark, f"file://{packed}", ["record_id"], ("response",)).count() == 7


def plain_finds(text):
    """Templates that appear word for word."""
    words = WORDS.findall((text or "").lower())
    out = []
    for license_, name, template in license_scan.TEMPLATES:
        own = WORDS.findall(template.lower())
        out += [(license_, name, i) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
    return sorted(out)


def test_license_finds(spark):
    r = rng(14)
    rows = odd_rows()[1:]
    for i, (_, _, template) in enumerate(license_scan.TEMPLATES):
        rows.append((20 + i, prose(r, words=r.randint(0, 30)) + "\n" + template.upper() + ". " + prose(r, words=20)))
    rows += [(50 + i, prose(r)) for i in range(20)]
    docs = frame(spark, rows)
    got = license_scan.scan_licenses(docs).collect()
    whole = sorted((x.doc_id, x.license, x.template, x.first_word) for x in got if x.coverage == 1.0 and x.last_word - x.first_word + 1 == x.n_template)
    assert whole == sorted((i, *f) for i, t in rows for f in plain_finds(t))
    texts = dict(rows)
    assert all(texts[x.doc_id][x.start : x.stop].upper().startswith(license_scan.TEMPLATES[x.doc_id - 20][2].upper()[:8]) for x in got if x.template == license_scan.TEMPLATES[x.doc_id - 20][1])
    assert license_scan.scan_licenses(docs.filter("false")).count() == 0


def plain_common(a, b):
    """Longest common subsequence over all positions."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_banded_alignment_equals_a_full_one(spark):
    r = rng(41)
    rows, templates = [], [t for t in license_scan.TEMPLATES if len(t[2].split()) > 25]
    for i in range(40):
        own = r.choice(templates)[2].split()
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(own))
            own[at : at + r.randint(0, 2)] = prose(r, words=r.randint(0, 2)).split()
        rows.append((i, prose(r, words=r.randint(0, 20)) + " " + " ".join(own) + " " + prose(r, words=10)))
    got = license_scan.scan_licenses(frame(spark, rows)).collect()
    words = {i: WORDS.findall(t.lower()) for i, t in rows}
    names = {t[1]: WORDS.findall(t[2].lower()) for t in license_scan.TEMPLATES}
    for x in got:
        assert x.n_matched == plain_common(names[x.template], words[x.doc_id][x.first_word : x.last_word + 1])
    full = {(i, n) for i in words for n, own in names.items() if len(own) > 25 and plain_common(own, words[i]) >= 0.9 * len(own)}
    assert full <= {(x.doc_id, x.template) for x in got}


def test_the_whole_license_is_the_best_find(spark):
    text = dict((t[1], t[2]) for t in license_scan.TEMPLATES)
    rows = [(1, "Copyright me. " + text["bsd-3-full"]), (2, text["mit-permission"]), (3, text["mit-full"] + " and " + text["isc-full"])]
    got = license_scan.scan_licenses(frame(spark, rows)).filter("best").collect()
    assert {(x.doc_id, x.template) for x in got} == {(1, "bsd-3-full"), (2, "mit-permission"), (3, "mit-full"), (3, "isc-full")}


def test_license_with_edits(spark):
    words = license_scan.TEMPLATES[3][2].split()
    edited = words[:20] + ["really"] + words[20:40] + words[43:]
    row = license_scan.scan_licenses(frame(spark, [(1, "intro here " + " ".join(edited) + " tail")])).filter("template = 'mit-permission'").first()
    gone = len(WORDS.findall(" ".join(words[40:43]).lower()))
    assert row.coverage == (row.n_template - gone) / row.n_template and row.first_word == 2 and row.n_matched == row.n_template - gone


def test_pipeline_stages(spark, tmp_path):
    r = rng(15)
    rows = [(i, prose(r, "en" if i % 2 else "de", 120), "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, rows[4][1], "de"), (101, "too short", "en"), (102, None, None), (103, "1 2 3 " * 30, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality_rules", "language_id", "jaccard_join", "suffix_dedup", "best_fit_packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert k == 4 or docs.columns == columns
        if k < 4:
            left = {x.doc_id for x in docs.collect()}
            assert set(range(4, 80, 7)) <= left and not {101, 102, 103} & left
    assert 100 not in left
    own = corpus_pipeline.run(spark, str(tmp_path))
    assert own.agg(F.sum("length")).first() == docs.agg(F.sum("length")).first()


@pytest.mark.parametrize("table", ["documents"])
def test_every_query_runs_on_the_smallest_tables(spark, table):
    import os

    from tideframe.llm import queries

    folder = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("driver tables are absent")
    n = spark.read.parquet(f"{folder}/{table}.parquet").count()
    for name in ("op1_language_id", "op2_suffix_dedup", "op3_importance_sampling", "op5_sentence_pieces", "op6_quality_rules", "op9_jaccard_join"):
        assert queries.QUERIES[name](spark, folder).count() == n


def test_what_a_worker_keeps_ends_with_its_stage(spark):
    def name(c):
        value = common.once_per_worker("probe", lambda: uuid.uuid4().hex)
        return {"pid": [os.getpid()] * len(c["id"]), "value": [value] * len(c["id"])}

    first, second = (common.map_batches(spark.range(64, numPartitions=32), name, "pid long, value string").distinct().collect() for _ in range(2))
    for rows in (first, second):
        assert len(rows) == len({r["pid"] for r in rows})  # made once for all tasks of a stage in a worker
    assert {r["pid"] for r in first} & {r["pid"] for r in second}, "no worker was used again"
    assert not {r["value"] for r in first} & {r["value"] for r in second}


def test_workers_hand_back_what_a_step_has_freed(spark):
    def own_mb():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous: +([0-9]+)", f.read())[1]) / 1024

    def take(c):
        rows = [bytes(2000) for _ in range(150_000)]
        sys.modules["_pinned"] = types.SimpleNamespace(row=rows[-1])  # the end of the heap stays in use
        del rows
        return {"pid": [os.getpid()] * len(c["id"]), "mb": [own_mb()] * len(c["id"])}

    def look(c):
        return {"pid": [os.getpid()] * len(c["id"]), "mb": [own_mb()] * len(c["id"])}

    held = dict(common.map_batches(spark.range(8, numPartitions=8), take, "pid long, mb double").collect())
    after = dict(common.map_batches(spark.range(8, numPartitions=8), look, "pid long, mb double").collect())
    again = held.keys() & after.keys()
    assert again, "no worker was used again"
    for pid in again:
        assert held[pid] > 300 and after[pid] < held[pid] - 200, (held[pid], after[pid])
