"""Removal of repeated 100-byte strings by a distributed, prefix-aware merge sort of suffixes.

Only suffixes at *anchors* are sorted. An anchor is a position that the bytes around it choose (the smallest hashed gram
of ``GRAM`` bytes in a window), such that every string of ``LENGTH`` bytes holds the anchor that it chooses, at the same
place in each copy. All strings that choose one anchor form a *reach*: bytes before and after the anchor.

1. Anchors meet by their gram as hashes, without their bytes. Equal reaches are one class: all places but its earliest
   repeat in full. Other anchors are dropped if their gram occurs once, or if no reach with this gram has the same bytes
   on that side of the anchor where any common string would need them: no string around them repeats elsewhere.
2. Each task sorts the suffixes at the anchors left into runs, one per range of keys, and writes them front-coded.
3. One task per range merges its runs with a loser tree that keeps the common prefix length of each contender with the
   last winner, so no known prefix is compared again. The merge yields sorted suffixes and their common prefixes.
4. Strings around one anchor are equal if they share the bytes after it (an interval of the sorted suffixes) and the
   bytes before it (an interval of the sorted, reversed left sides). The earliest of each class stays.

The bytes of a reach are about four times those between two anchors, so only those move that step 1 leaves; texts move
once, to the step that sorts and from the same exchange to their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.common import map_batches, slices, starts_of, tidy, tidy_group
from tideframe.session import stored

LENGTH = 100
GRAM = 20
#: A gram with more anchors than this is dealt by its single strings instead of as one group.
HOT = 4_000
#: Bytes of a text looked at in one step.
SECTION = 1 << 20
#: A string starts this many bytes or more before its anchor, or it holds more than LENGTH - SIDE bytes from the anchor on.
SIDE = 40
#: Anchors whose equal reaches a task folds at a time; a document is not cut.
FOLD_ROWS = 500_000
#: Bytes of text whose anchors meet in one task, on average.
MEET_BYTES = 1 << 24
#: A gram with about this many places in unequal reaches does not meet in one task: the merge gets its single strings.
MEET_HOT = 4_000_000
#: One document in so many is looked at to find such grams; this decides only the way they go.
HOT_SHARE = 4_096
#: Suffixes that a task sorts into runs at a time.
RUN_ROWS = 100_000
#: Suffixes that one range holds on average.
RANGE_ROWS = 30_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of ``n`` bytes, by doubling."""
    power = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    width, out, done = 1, None, 0
    while True:
        if n & width:
            if out is None:
                out = power
            else:
                m = len(power) - done
                out = out[:m] * np.uint64(pow(_BASE, width, 2**64)) + power[done:]
            done += width
        if 2 * width > n:
            return _mixed(out)
        m = len(power) - width
        power = power[:m] * np.uint64(pow(_BASE, width, 2**64)) + power[width:]
        width *= 2


def _grams_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What ``_gram_hashes`` gives for the grams at some places only."""
    h = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(_BASE) + (data[at + k].astype(np.uint64) + np.uint64(1)) * _MIX
    return _mixed(h)


def _reach_hashes(data: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each reach, of its SIDE bytes before the anchor with the gram, and of the bytes from the anchor on that
    any string holds that starts less than SIDE bytes before it; the last two are 0 where no string has them."""
    n = len(data)
    powers, inverse = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _MIX * powers[:n])])

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (sums[b] - sums[a]) * inverse[a]

    reach = _mixed(hashed(first, last + LENGTH) + ((last - first) * LENGTH + at - first).astype(np.uint64) * np.uint64(_BASE))
    left = (_mixed(hashed(np.maximum(at - SIDE, 0), at + GRAM)) >> np.uint64(40)).astype(np.uint16)
    right = (_mixed(hashed(at, np.minimum(at + LENGTH - SIDE + 1, n))) >> np.uint64(40)).astype(np.uint16)
    return reach, np.where(at - first >= SIDE, left, np.uint16(0)), np.where(at - last < SIDE, right, np.uint16(0))


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, gram, anchor, first, last, and the ``_reach_hashes``) of every reach: strings starting at ``first..last``
    choose this anchor.

    Positions count within each text; texts shorter than LENGTH have none. A long text is read in sections that overlap
    by all but one byte of LENGTH, so each string starts in one section; what it chooses depends on its bytes alone.
    """
    sections = [(i, at) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - LENGTH + 1), SECTION)]
    if len(sections) > len(texts):
        text, gram, at, first, last, *hashes = _anchors([texts[i][a : a + SECTION + LENGTH - 1] for i, a in sections])
        owner, base = np.asarray(sections, np.int64)[text].T
        return owner, gram, at + base, first + base, last + base, *hashes
    return _anchors(texts)


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    starts = starts_of(map(len, texts))
    if starts[-1] < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64, np.uint64, np.uint16, np.uint16))
    data = np.frombuffer(b"".join(texts), np.uint8)
    grams = _gram_hashes(data, GRAM)
    width = LENGTH - GRAM + 1
    bits = int(len(grams)).bit_length()
    low = np.uint64((1 << bits) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    # Smallest key of every window: prefix minima of one block meet suffix minima of the one before.
    n = len(key)
    padded = np.concatenate([key, np.full(-n % width + width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    chosen = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))[:m]
    inside = np.arange(m) + LENGTH <= starts[1:][owner]
    edge = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])]))
    last = np.concatenate([edge[1:], [m]]) - 1
    ok = inside[edge]
    edge, last = edge[ok], last[ok]
    text, at = owner[edge], chosen[edge]
    return text, grams[at], at - starts[text], edge - starts[text], last - starts[text], *_reach_hashes(data, at, edge, last)


def _encoded(c: dict[str, list]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in c["text"]]


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte: the first bytes of all rows, then the second ones, compressed."""
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _unpacked(blob: bytes, n: int, types: tuple[str, ...]) -> list[np.ndarray]:
    widths = [np.dtype(t).itemsize for t in types]
    raw = pa.decompress(blob, decompressed_size=n * sum(widths), codec="zstd", asbytes=True) if n else b""
    cuts = starts_of(n * w for w in widths).tolist()
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n).T).view(t).reshape(n) for t, w, at in zip(types, widths, cuts)]


def _edges(*sorted_columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before; the first one does."""
    out = np.ones(len(sorted_columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return out


#: An anchor in its meeting: gram, the three hashes; document of the fold and its id, as steps; place, bytes to first and last.
_PLACE = ("<u4", "<u8", "<u2", "<u2", "<u4", "<i8", "<u4", "u1", "u1")
#: A span that goes: document, as steps, start and length. A place left to the merge: document, place, bytes to first and last, hot.
_SPAN, _LEAD = ("<u4", "<u4", "<u4"), ("<u4", "<u4", "u1", "u1", "u1")
_MEET_SCHEMA = "fold long, n int, data binary, n_spans int, spans binary, n_leads int, leads binary"


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _joined(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents joined where they touch, in order."""
    begin, end = doc << 32 | start, doc << 32 | stop
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    begin, end = begin[at], end[np.concatenate([at[1:], [len(end)]])[: len(at)] - 1]
    return begin >> 32, begin & (2**32 - 1), end & (2**32 - 1)


def _hot_grams(docs: DataFrame) -> np.ndarray:
    """Grams with too many places for one task, as sorted hashes."""

    def run(c: dict[str, list]) -> dict:
        found = [anchors(c["text"][lo:hi]) for lo, hi in slices([len(t) for t in c["text"]])]
        return {name: np.concatenate([f[k] for f in found]).view(np.int64) for name, k in (("gram", 1), ("reach", 5))}

    some = docs.filter((F.pmod(F.col("doc_key"), F.lit(HOT_SHARE)) == 0) & F.col("text").isNotNull()).select(F.col("text").cast("binary").alias("text"))
    places = map_batches(some, run, "gram long, reach long").distinct().groupBy("gram").count()
    return np.sort(np.asarray([r.gram for r in places.filter(F.col("count") >= F.lit(MEET_HOT // HOT_SHARE)).collect()], np.int64).view(np.uint64))


def _fold(ids: np.ndarray, keys: np.ndarray, found: tuple[np.ndarray, ...], fold: int, parts: int, hot: np.ndarray) -> Iterator[dict]:
    """A row for each task that places of these documents go to, and a last one with the documents.

    Of equal reaches only the earliest place is sent, and the first ones of other documents with the same id, which only
    the merge can order; the other places repeat in full. Those of hot grams are left to the merge at once.
    """
    by_id = np.argsort(ids, kind="stable")
    ids, keys = ids[by_id], keys[by_id]
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    doc = place[found[0]]
    order = np.argsort(doc, kind="stable")
    doc, (gram, at, first, last, reach, left, right) = doc[order], (x[order] for x in found[1:])
    order = np.argsort(reach, kind="stable")
    new = _edges(reach[order], gram[order])
    own = doc[order]
    earliest = ids[own[new]][np.cumsum(new) - 1]
    sent = (ids[own] == earliest) & (new | _edges(own))
    rest = order[~sent]
    spans = _joined(doc[rest], first[rest], last[rest] + LENGTH)
    sent = np.sort(order[sent])
    is_hot = np.isin(gram[sent], hot)
    led, sent = sent[is_hot], sent[~is_hot]
    part = (gram[sent] % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    sent, part = sent[order], part[order]
    cuts = np.append(np.flatnonzero(_edges(part)), len(part)).tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        s = sent[lo:hi]
        columns = ((gram[s] >> np.uint64(32)).astype("<u4"), reach[s], left[s], right[s], _steps(doc[s]).astype("<u4"), _steps(ids[doc[s]]), at[s].astype("<u4"), (at[s] - first[s]).astype("u1"), (at[s] - last[s]).astype("u1"))
        yield {"part": int(part[lo]), "fold": fold, "n": hi - lo, "data": _packed(*columns), "n_spans": 0, "spans": b"", "n_leads": 0, "leads": b""}
    leads = _packed(_steps(doc[led]).astype("<u4"), at[led].astype("<u4"), (at[led] - first[led]).astype("u1"), (at[led] - last[led]).astype("u1"), np.ones(len(led), "u1"))
    doc, start, stop = spans
    packed = _packed(_steps(doc).astype("<u4"), start.astype("<u4"), (stop - start).astype("<u4"))
    yield {"part": -1 - fold, "fold": fold, "n": len(keys), "data": _packed(keys), "n_spans": len(doc), "spans": packed, "n_leads": len(led), "leads": leads}


def _folded(docs: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """The folds of each task's documents (``doc_key, doc_id, text``): rows of ``_MEET_SCHEMA`` and the ``part`` each goes to."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = f"part long, {_MEET_SCHEMA}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = TaskContext.get().partitionId() << 32
        ids, keys, found, n_docs, held = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            rows = list(_fold(np.concatenate(ids), np.concatenate(keys), tuple(map(np.concatenate, zip(*found))), fold, parts, hot))
            for x in (ids, keys, found):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            texts = batch.column("text")
            own_ids, own_keys = (batch.column(n).to_numpy() for n in ("doc_id", "doc_key"))
            for lo, hi in slices([n or 0 for n in pc.binary_length(texts).to_pylist()]):
                text, *rest = anchors([t or b"" for t in texts.slice(lo, hi - lo).to_pylist()])
                ids.append(own_ids[lo:hi])
                keys.append(own_keys[lo:hi])
                found.append((text + n_docs, *rest))
                n_docs, held = n_docs + hi - lo, held + len(text)
                if held >= FOLD_ROWS:
                    yield flush()
                    fold, n_docs, held = fold + 1, 0, 0
        if ids:
            yield flush()

    return docs.select("doc_key", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(tidy(run), schema)


def _shared(gram: np.ndarray, side: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether another class of the gram has the same bytes on this side; classes without them share none."""
    out = np.zeros(len(gram), bool)
    _, kind, n = np.unique((gram[own].astype(np.uint64) << np.uint64(16)) | side[own], return_inverse=True, return_counts=True)
    out[own] = n[kind] > 1
    return out


def _meet(rows: list[dict], hot: int) -> Iterator[dict]:
    """What the places of a part of all grams say to each fold: the spans that repeat in full, the places that the merge has to order."""
    columns = [_unpacked(r["data"], r["n"], _PLACE) for r in rows]
    for c in columns:
        c[4], c[5] = np.cumsum(c[4], dtype=np.int64), np.cumsum(c[5])
    gram, reach, left, right, doc, ids, at, before, back = map(np.concatenate, zip(*columns))
    source = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
    order = np.argsort(gram, kind="stable")
    same = ~_edges(gram[order])
    order = order[same | np.append(same[1:], False)]
    order = order[np.lexsort((ids[order], reach[order], gram[order]))]
    new = _edges(gram[order], reach[order])
    kind = np.cumsum(new) - 1
    one = order[new]
    tied = ids[order] == ids[one][kind]
    open_ = np.bincount(kind[tied], minlength=len(one)) > 1
    open_ |= _shared(gram[one], left[one], before[one] >= SIDE) | _shared(gram[one], right[one], back[one] < SIDE)
    full, lead = np.sort(order[~tied]), order[tied & open_[kind]]
    _, kind, n = np.unique(gram[lead], return_inverse=True, return_counts=True)
    is_hot = np.zeros(len(gram), "u1")
    is_hot[lead] = n[kind] > hot
    lead = np.sort(lead)
    f, k = (np.searchsorted(source[x], np.arange(len(rows) + 1)).tolist() for x in (full, lead))
    for i, r in enumerate(rows):
        x, y = full[f[i] : f[i + 1]], lead[k[i] : k[i + 1]]
        if len(x) or len(y):
            spans = _packed(_steps(doc[x]).astype("<u4"), at[x] - before[x], LENGTH + before[x].astype("<u4") - back[x])
            yield {"fold": r["fold"], "n": 0, "data": b"", "n_spans": len(x), "spans": spans, "n_leads": len(y), "leads": _packed(_steps(doc[y]).astype("<u4"), at[y], before[y], back[y], is_hot[y])}


_FOUND_SCHEMA = "doc_key long, weight long, leads array<long>, early array<long>"


def _answer(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(doc_key, weight, bounds and codes of leads, bounds and codes of spans) of the documents of one fold that have any."""
    head = next(r for r in rows if r["n"])
    (keys,) = _unpacked(head["data"], head["n"], ("<i8",))

    def gathered(name: str, types: tuple[str, ...]) -> list[np.ndarray]:
        columns = [_unpacked(r[name], r[f"n_{name}"], types) for r in rows]
        doc = np.concatenate([np.cumsum(c[0], dtype=np.int64) for c in columns])
        return [doc, *(np.concatenate(x).astype(np.int64) for x in list(zip(*columns))[1:])]

    doc, start, size = gathered("spans", _SPAN)
    doc, start, stop = _joined(doc, start, start + size)
    owner, at, before, back, hot = gathered("leads", _LEAD)
    order = np.argsort(owner, kind="stable")
    weight = np.bincount(owner, np.where(hot, before - back + 1, 1), len(keys)).astype(np.int64)
    codes = (at << 15 | before << 8 | back << 1 | hot)[order]
    some = np.flatnonzero(np.bincount(doc, minlength=len(keys)) + weight)
    bounds = lambda x: np.searchsorted(x, np.append(some, len(keys)))
    return keys[some], weight[some], [bounds(owner[order]), codes], [bounds(doc), start << 31 | (stop - start)]


def meetings(docs: DataFrame) -> DataFrame:
    """(``doc_key``, ``weight``, ``leads``, ``early``) of the documents around whose anchors strings may repeat.

    ``early`` are spans that repeat in full, start * 2**31 + length. ``leads`` are the anchors left to the merge: place,
    bytes from the first and the last string to it, and whether it is dealt by single strings; ``weight`` counts its suffixes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    met, found = (to_arrow_schema(_parse_datatype_string(s)) for s in (_MEET_SCHEMA, _FOUND_SCHEMA))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def meet(group: pa.Table) -> pa.Table:
        if group["part"][0].as_py() < 0:
            return group.drop_columns(["part"])
        rows = list(_meet(group.to_pylist(), HOT))
        return pa.table([pa.array([r[f.name] for r in rows], f.type) for f in met], schema=met)

    def answer(group: pa.Table) -> pa.Table:
        keys, weight, leads, early = _answer(group.to_pylist())
        lists = [pa.ListArray.from_arrays(pa.array(b, pa.int32()), pa.array(x, pa.int64())) for b, x in (leads, early)]
        return pa.table([pa.array(keys, pa.int64()), pa.array(weight, pa.int64()), *(x.cast(found.field(n).type) for x, n in zip(lists, ("leads", "early")))], schema=found)

    folded = _folded(docs, max(1, size // MEET_BYTES), _hot_grams(docs))
    heard = folded.groupBy("part").applyInArrow(tidy_group(meet), _MEET_SCHEMA)
    # Rows that repeat id and text hear the same; their places are one.
    return heard.groupBy("fold").applyInArrow(tidy_group(answer), _FOUND_SCHEMA).dropDuplicates(["doc_key"])


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are equal already."""
    n = min(len(a), len(b))
    if n <= known:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def merge_runs(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Merge front-coded sorted runs with a loser tree: yields (common prefix with the last one, run, place, key).

    A run is a list of (common prefix with the key before, rest of the key). Every contender remembers its common
    prefix with the last winner: the longer one wins; only at a tie are bytes compared, from that prefix on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    keys: list[bytes | None] = [None] * k
    prefix, place = [0] * k, [0] * k
    for r, run in enumerate(runs):
        if run:
            keys[r] = run[0][1]
    losers = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one it shares with the winner."""
        x, y = keys[a], keys[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = prefix[a], prefix[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        h = common_prefix(x, y, p)
        first = len(x) <= len(y) if h == len(x) or h == len(y) else x[h] < y[h]
        if h == len(x) == len(y):
            first = a < b
        win, lose = (a, b) if first else (b, a)
        prefix[lose] = h
        return win, lose

    level = list(range(k))
    at = k // 2
    while at >= 1:
        following = []
        for i in range(at):
            win, losers[at + i] = match(level[2 * i], level[2 * i + 1])
            following.append(win)
        level, at = following, at // 2
    winner = level[0]
    while keys[winner] is not None:
        key, own = keys[winner], prefix[winner]
        yield own, winner, place[winner], key
        place[winner] += 1
        if place[winner] < len(runs[winner]):
            shared, rest = runs[winner][place[winner]]
            keys[winner], prefix[winner] = key[:shared] + rest, shared
        else:
            keys[winner] = None
        node = (k + winner) // 2
        while node >= 1:
            winner, losers[node] = match(winner, losers[node])
            node //= 2


_RUN_FIELDS = ("shared", "rest_len", "left_len", "n_at", "rests", "lefts", "doc_id", "tie", "doc_key", "at")
_RUN_SCHEMA = "part long, " + ", ".join(f"{n} binary" for n in _RUN_FIELDS)
_SPAN_SCHEMA = "doc_key long, start long, stop long"


def _pack_run(entries: list[tuple[bytes, bytes, tuple]]) -> dict[str, bytes]:
    """Front-code entries (key, left side, (doc_id, tie, doc_key, anchor)); equal ones become one with many places."""
    entries.sort()
    shared, rests, lefts, spots, numbers = [], [], [], [], []
    before = None
    for key, left, spot in entries:
        if before is not None and key == before[0] and left == before[1]:
            if spot != spots[-1]:
                spots.append(spot)
                numbers[-1] += 1
            continue
        h = common_prefix(before[0], key, 0) if before else 0
        shared.append(h)
        rests.append(key[h:])
        lefts.append(left)
        spots.append(spot)
        numbers.append(1)
        before = (key, left)
    columns = np.asarray(spots, np.int64).reshape(-1, 4).T
    small = lambda x: np.asarray(x, "<i4").tobytes()
    return {
        "shared": small(shared), "rest_len": small([len(x) for x in rests]), "left_len": small([len(x) for x in lefts]), "n_at": small(numbers),
        "rests": b"".join(rests), "lefts": b"".join(lefts), **{n: np.ascontiguousarray(c).tobytes() for n, c in zip(("doc_id", "tie", "doc_key", "at"), columns)}}


def sorted_runs(docs: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted runs, one per batch and range; ``docs`` carry the ``leads`` of their text."""

    def run(c: dict[str, list]) -> dict:
        out: dict[str, list] = {f: [] for f in ("part", *_RUN_FIELDS)}
        ranges: dict[int, list] = {}
        held = 0
        raw = c["text"]

        def flush() -> None:
            for p in sorted(ranges):
                out["part"].append(p)
                for f, x in _pack_run(ranges[p]).items():
                    out[f].append(x)
            ranges.clear()

        for lo, hi in slices([len(t) for t in raw]):
            own = raw[lo:hi]
            owner = np.repeat(np.arange(hi - lo), [len(x) for x in c["leads"][lo:hi]])
            codes = np.concatenate([np.asarray(x, np.int64) for x in c["leads"][lo:hi]])
            at = codes >> 15
            first, last = at - (codes >> 8 & 127), at - (codes >> 1 & 127)
            grams = _grams_at(np.frombuffer(b"".join(own), np.uint8), starts_of(map(len, own))[owner] + at)
            for i, g, a, s, e, hot in zip(owner.tolist(), grams.tolist(), at.tolist(), first.tolist(), last.tolist(), (codes & 1).tolist()):
                t, spot = own[i], (c["doc_id"][lo + i], c["tie"][lo + i], c["doc_key"][lo + i], a)
                if not hot:
                    # The hashed gram leads the key, so ranges of keys are even without a sample of the suffixes.
                    ranges.setdefault(g % parts, []).append((g.to_bytes(8, "big") + t[a : e + LENGTH], t[s:a][::-1], spot))
                    held += 1
                    continue
                whole = _gram_hashes(np.frombuffer(t[s : e + LENGTH], np.uint8), LENGTH)
                held += len(whole)
                for k, h in enumerate(whole.tolist()):
                    ranges.setdefault(h % parts, []).append((h.to_bytes(8, "big") + t[a : s + k + LENGTH], t[s + k : a][::-1], spot))
            if held > RUN_ROWS:
                flush()
                held = 0
        flush()
        return out

    return map_batches(docs, run, _RUN_SCHEMA, ["doc_key", "doc_id", "tie", "text", "leads"])


def _repeats(runs: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_key, start, stop) of the repeated strings of one range, joined where they touch at one anchor."""
    ints = lambda r, n: np.frombuffer(r[n], "<i4").tolist()
    coded, lefts, spots, numbers = [], [], [], []
    for r in runs:
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(r["rest_len"], "<i4"))]).tolist()
        coded.append([(h, r["rests"][x:y]) for h, x, y in zip(ints(r, "shared"), cuts, cuts[1:])])
        cuts = np.concatenate([[0], np.cumsum(np.frombuffer(r["left_len"], "<i4"))]).tolist()
        lefts.append([r["lefts"][x:y] for x, y in zip(cuts, cuts[1:])])
        numbers.append(np.frombuffer(r["n_at"], "<i4").astype(np.int64))
        spots.append(np.stack([np.frombuffer(r[n], np.int64) for n in ("doc_id", "tie", "at", "doc_key")]))
    base = np.cumsum([0] + [len(n) for n in numbers])
    order, shared, sides, rights = [], [], [], []
    for h, run, place, key in merge_runs(coded):
        order.append(base[run] + place)
        shared.append(h)
        sides.append(lefts[run][place])
        rights.append(len(key) - 8)
    order, shared, rights = np.asarray(order), np.asarray(shared), np.asarray(rights)
    # All places, numbered by their document and position: the earliest has the smallest rank.
    entry_of = np.empty(base[-1], np.int64)
    entry_of[order] = np.arange(len(order))
    place_entry = entry_of[np.repeat(np.arange(base[-1]), np.concatenate(numbers))]
    all_spots = np.concatenate(spots, axis=1)
    by_place = np.lexsort(all_spots[2::-1])
    rank = np.empty(len(by_place), np.int64)
    # Rows that repeat id and text have the same places, or a document repeats itself.
    rank[by_place] = np.cumsum(_edges(*all_spots[:3, by_place]))
    best = np.full(len(order), len(rank) + 1)
    np.minimum.at(best, place_entry, rank)
    # Equal entries next to each other (from several runs) have one first place.
    side_order = sorted(range(len(sides)), key=sides.__getitem__)
    side_len = np.fromiter(map(len, sides), np.int64, len(sides))
    side_shared = np.zeros(len(sides), np.int64)
    for i in range(1, len(side_order)):
        side_shared[i] = common_prefix(sides[side_order[i - 1]], sides[side_order[i]], 0)
    side_at = np.empty(len(sides), np.int64)
    side_at[side_order] = np.arange(len(sides))
    removed = np.zeros((len(order), LENGTH - GRAM + 1), bool)
    for before in range(LENGTH - GRAM + 1):
        after = LENGTH - before
        own = np.flatnonzero((side_len >= before) & (rights >= after))
        if len(own) < 2:
            continue
        right_class = np.cumsum(shared < 8 + after)[own]
        left_class = np.cumsum(side_shared < before)[side_at[own]] if before else 0
        kind = right_class * (len(sides) + 1) + left_class
        _, kind = np.unique(kind, return_inverse=True)
        first = np.full(kind.max() + 1, len(rank) + 1)
        np.minimum.at(first, kind, best[own])
        removed[own, before] = best[own] > first[kind]
    # The first place of an entry keeps what its classes leave it; its other places repeat in full.
    lead = rank == best[place_entry]
    at, key = all_spots[2], all_spots[3]
    others = np.flatnonzero(~lead)
    e = place_entry[others]
    out_key, out_start, out_stop = [key[others]], [at[others] - side_len[e]], [at[others] + rights[e]]
    leads = np.flatnonzero(lead)
    flags = removed[place_entry[leads]]
    edges = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, low = np.nonzero(edges == 1)
    _, high = np.nonzero(edges == -1)
    out_key.append(key[leads[row]])
    out_start.append(at[leads[row]] - (high - 1))
    out_stop.append(at[leads[row]] - low + LENGTH)
    return tuple(map(np.concatenate, (out_key, out_start, out_stop)))


def repeats(runs: DataFrame) -> DataFrame:
    """Merge the runs of each range; rows (``doc_key, start, stop``) of byte spans to remove."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(_SPAN_SCHEMA))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.drop_columns(["part"]).to_pylist()
        return pa.table([pa.array(x, pa.int64()) for x in _repeats(rows)], schema=arrow)

    return runs.groupBy("part").applyInArrow(tidy_group(merge), _SPAN_SCHEMA)


def _keep(raw: bytes, spans: list[int]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside all spans, and the spans joined into maximal runs; a span is start * 2**31 + length."""
    joined: list[list[int]] = []
    for x in sorted(spans):
        start, stop = x >> 31, (x >> 31) + (x & (2**31 - 1))
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], stop)
        else:
            joined.append([start, stop])
    cuts = [0, *(x for pair in joined for x in pair), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])), [tuple(p) for p in joined]


def spans_by_document(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_key`` and ``spans`` (array, empty if nothing repeats) added.

    ``doc_key`` hashes id and text: rows that repeat both are one document and get one answer. Documents
    with the same id and other text are ordered by that hash, null ids come first.
    """
    keyed = docs.withColumn("doc_key", F.xxhash64(F.col("doc_id"), F.col("text"))).withColumn("text", F.col("text").cast("string"))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    found = stored(meetings(keyed.select("doc_key", order.alias("doc_id"), "text")), "anchors")
    parts = max(1, found.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0] // RANGE_ROWS)
    # All columns go into both joins: their exchanges of the texts are equal, and Spark moves the texts once.
    led = keyed.join(found.filter("weight > 0").select("doc_key", "leads"), "doc_key").withColumn("tie", F.col("doc_key"))
    runs = sorted_runs(led.withColumn("doc_id", order).withColumn("text", F.col("text").cast("binary")), parts)
    late = repeats(runs).groupBy("doc_key").agg(F.collect_list(F.col("start") * F.lit(2**31) + F.col("stop") - F.col("start")).alias("late"))
    marked = keyed.join(found.select("doc_key", "early"), "doc_key", "left").join(late, "doc_key", "left")
    none = F.array().cast("array<long>")
    return marked.withColumn("spans", F.concat(F.coalesce("early", none), F.coalesce("late", none))).drop("early", "late")


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and the joined ``removed`` spans and ``kept`` bytes.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier (smaller id, or the same document and an
    earlier start); strings are judged on the input, never across documents. Null texts count as empty.
    """
    import hashlib

    def run(c: dict[str, list]) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept")}
        for raw, spans in zip(_encoded(c), c["spans"]):
            kept, joined = _keep(raw, spans or [])
            row = (len(raw), len(raw) - len(kept), len(joined), hashlib.sha256(kept).hexdigest(), [{"start": a, "stop": b} for a, b in joined], kept)
            for name, value in zip(out, row):
                out[name].append(value)
        return {"doc_id": c["doc_id"], **out}

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, stop: long>>, kept binary"
    return map_batches(spans_by_document(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).select("doc_id", "text", "spans"), run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated strings taken out of ``text``; all columns stay, and every row.

    A cut may leave parts of a character at a span's edge; those bytes are dropped. ``n_chars`` follows the text.
    """
    names, types = docs.columns, dict(docs.dtypes)
    # The caller's other columns travel in one struct, so that none clashes with ours; the text moves once.
    others = [n for n in names if n != "text"]
    whole = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{n}`") for n in others]).alias("row"))
    marked = spans_by_document(whole).select("doc_id", "text", "spans", "row")

    def run(c: dict[str, list]) -> dict:
        texts = [t if t is None or not s else _keep(t.encode("utf-8", "surrogatepass"), s)[0].decode("utf-8", "ignore") for t, s in zip(c["text"], c["spans"])]
        out = {n: [row[n] for row in c["row"]] for n in others} | {"text": texts}
        if "n_chars" in out:
            out["n_chars"] = [n if not s else len(t) for n, t, s in zip(out["n_chars"], texts, c["spans"])]
        return out

    return map_batches(marked, run, ", ".join(f"`{n}` {'string' if n == 'text' else types[n]}" for n in names))
