"""Best-fit packing of tokenised documents, after a reduction by dominance.

What decides a packing are the lengths of the pieces, and there are at most ``CAPACITY`` different ones.
So the driver plans over the histogram of lengths (a table of fixed size), and Spark deals the pieces to the plan by
their rank among pieces of equal length.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import map_batches, once_per_worker, slices
from tideframe.session import stored

CAPACITY = 2048
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Marks that end a word and never join with it; the apostrophe may, so it is not among them.
MARKS = ".,;:!?#*$%&|<>"
#: Stands for a line feed at the start of a chunk; texts that hold it are tokenised whole.
LINE = "\x1c"
#: Rows that one ranking group holds on average, at most; a length with more pieces has several groups.
RANK_ROWS = 20_000
Pattern = tuple[list[tuple[int, int]], int]


def default_tokenizer() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


def token_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit bytes.

    The tokenizer never joins across a single space between two words, so a text is cut there and every
    distinct chunk is tokenised once; where lines end in a single line feed, it is cut there too. A text with a space after
    other white space, or that holds the name of one of the tokenizer's added tokens, is tokenised whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    blanks = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ascii_rare, rare = ([b for b in blanks if b not in " \n" and b < limit] for limit in ("\x80", "\uffff"))
    ascii_odd, odd = ([*added, LINE, *(b + " " for b in blanks if b < limit)] for limit in ("\x80", "\uffff"))
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    direct = isinstance(tokenizer.model, models.BPE) and isinstance(tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel) and tokenizer.normalizer is None
    firsts: dict[str, bytes] = {}
    others: dict[str, bytes] = {}
    older: dict[str, bytes] = {}

    packers = [struct.Struct(f"<{n}I").pack for n in range(64)]
    space, line = (as_bytes.pre_tokenize_str(x)[0][0] for x in " \n")

    def as_binary(ids: list[int]) -> bytes:
        return packers[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)

    def tokens(texts: list[str]) -> list[bytes]:
        return [as_binary(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def words_to_ids(words: list[str], lead: str) -> list[bytes]:
        """Ids of words after ``lead``, a space or nothing. A word of letters is one pre-token: the merges run on it alone."""
        known: dict[str, bytes] = {}
        if direct:
            merge, front = tokenizer.model.tokenize, space if lead else ""
            plain = [w for w in words if w.isalpha()]
            known = {w: as_binary([t.id for t in merge(front + w)]) for w in plain if w.isascii()}
            wide = [w for w in plain if w not in known]
            mapped = as_bytes.pre_tokenize_str("\n".join(wide))[0][0].split(line) if wide else []
            known.update((w, as_binary([t.id for t in merge(front + m)])) for w, m in zip(wide, mapped))
        rest = [w for w in words if w not in known]
        known.update(zip(rest, tokens([lead + w for w in rest])))
        return [known[w] for w in words]

    def learn_first(words: set[str]) -> None:
        new = list(words.difference(firsts))
        firsts.update(zip(new, words_to_ids(new, "")))

    def chunked(text: str) -> str | None:
        """The text with ``LINE`` for each line feed, as a chunk of its own; None if it must be tokenised whole."""
        plain = text.isascii()
        if any(map(text.__contains__, [*added, LINE])):
            return None
        if not any(map(text.__contains__, [*(ascii_rare if plain else rare), "  ", "\n\n", " \n", "\n "])):
            return text.replace("\n", " " + LINE)
        return None if any(map(text.__contains__, ascii_odd if plain else odd)) else text

    def learn(chunks: set[str]) -> None:
        """Ids of chunks that follow a space.

        Closing marks after a letter or digit are tokens of their own, and so is a line's end between two other
        characters: chunks are learnt from their words, marks and lines.
        """
        missing = chunks.difference(others)
        again = [c for c in missing if c in older]
        others.update((c, older[c]) for c in again)
        missing.difference_update(again)
        starts = {c: c[1:].rstrip(MARKS) for c in missing if c.startswith(LINE)}
        starts.update((c, c[1:]) for c, s in starts.items() if not s or not s[-1].isalnum())
        learn_first({"\n"}.union(starts.values(), (c[1 + len(s) :] for c, s in starts.items())))
        others.update((c, firsts["\n"] + firsts[s] + firsts[c[1 + len(s) :]]) for c, s in starts.items())
        missing.difference_update(starts)
        lines = {c: p for c in missing if "\n" in c and all(p := c.split("\n")) and c.split() == p}
        heads = {p[0] for p in lines.values()}.union(c for c in missing if c not in lines).difference(others)
        stems = {c: s for c in heads if (s := c.rstrip(MARKS)) and s is not c and s[-1].isalnum()}
        learn_first({c[len(s) :] for c, s in stems.items()}.union(*(p[1:] for p in lines.values()), ("\n",)))
        bare = list({stems.get(c, c) for c in heads}.difference(others))
        others.update(zip(bare, words_to_ids(bare, " ")))
        others.update((c, others[s] + firsts[c[len(s) :]]) for c, s in stems.items())
        end = firsts["\n"]
        others.update((c, end.join([others[p[0]], *map(firsts.__getitem__, p[1:])])) for c, p in lines.items())

    def encode(texts: list[str]) -> list[bytes]:
        nonlocal others, older
        out: list[bytes] = []
        for lo, hi in slices([len(t) for t in texts]):
            own = texts[lo:hi]
            if len(firsts) > REMEMBERED:
                firsts.clear()
            if len(others) > REMEMBERED:  # words not seen again while as many others came are forgotten
                others, older = {}, others
            cut_up = list(map(chunked, own))
            whole = [i for i, t in enumerate(cut_up) if t is None]
            apart = dict(zip(whole, tokens([own[i] for i in whole])))
            split = [None if t is None else t.partition(" ") for t in cut_up]
            tails = [x[2].split(" ") if x and x[1] else () for x in split]
            learn_first({x[0] for x in split if x})
            learn(set().union(*tails))
            out += [apart[i] if x is None else firsts[x[0]] + b"".join(map(others.__getitem__, y)) for i, (x, y) in enumerate(zip(split, tails))]
        return out

    return encode


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, but for the first."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, the ``ids``.

    A null text counts as empty: one piece that holds only ``end_id``. Rows are documents, also where ids repeat or are null.
    """
    path = tokenizer or default_tokenizer()
    closing = np.asarray([end_id], "<u4").tobytes()

    def run(c: dict[str, list]) -> dict:
        encode = once_per_worker(f"token-encoder {path}", lambda: token_encoder(path))
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for doc, raw in zip(c["doc_id"], encode([t or "" for t in c["text"]])):
            raw += closing
            for k, (start, n) in enumerate(cut(len(raw) // 4)):
                own = raw[4 * start : 4 * (start + n)]
                for name, value in zip(out, (doc, k, start, n, zlib.crc32(own), own if with_ids else None)):
                    out[name].append(value)
        return out

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = map_batches(chosen, run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return made if with_ids else made.drop("ids")


def reduce_by_dominance(count: list[int], capacity: int) -> list[Pattern]:
    """Fix the sets that provably dominate every other set with their largest piece; ``count`` keeps the rest.

    For a piece of length a with room r = capacity - a:
    no partner fits: it stays alone; a partner of length r fills the room: no set does better; only one more piece
    fits, or no two pieces that fit are together longer than the longest single one: that longest one dominates.
    """
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        present = [n for n in range(1, capacity + 1) if count[n]]
        for a in reversed(present):
            while count[a]:
                room = capacity - a
                live = [n for n in present[: bisect_right(present, room)] if count[n] > (n == a)]
                if not live:
                    fixed.append(([(a, 1)], count[a] if a > room else 1))
                    count[a] -= fixed[-1][1]
                    changed = True
                    continue
                b = live[-1]
                small = sorted(n for n in live[:3] for _ in range(min(3, count[n] - (n == a))))[:3]
                if b != room and not (len(small) < 2 or small[0] + small[1] > room):
                    if len(small) > 2 and sum(small) <= room or _best_pair(live, count, a, room) > b:
                        break
                times = count[a] // 2 if a == b else min(count[a], count[b])
                fixed.append(([(a, 2)] if a == b else [(a, 1), (b, 1)], times))
                count[a] -= times
                count[b] -= times
                changed = True
    return fixed


def _best_pair(live: list[int], count: list[int], a: int, room: int) -> int:
    """Longest sum of two pieces that fit into ``room`` beside one of length ``a``."""
    best, i, j = 0, 0, len(live) - 1
    while i <= j:
        total = live[i] + live[j]
        if total > room:
            j -= 1
            continue
        if i < j or count[live[i]] - (live[i] == a) > 1:
            best = max(best, total)
        i += 1
    return best


def best_fit(count: list[int], capacity: int) -> list[Pattern]:
    """Best fit, longest pieces first, with equal pieces and equal sequences handled together."""
    open_: dict[int, list[Pattern]] = {}
    for length in range(capacity, 0, -1):
        n = count[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                room, (held, bins) = capacity, ([], n)
            else:
                held, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = min(n, room // length)
            used = min(bins, n // each)
            open_.setdefault(room - each * length, []).append((held + [(length, each)], used))
            n -= used * each
            if bins > used and held:
                open_.setdefault(room, []).append((held, bins - used))
    return [p for group in open_.values() for p in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences as patterns of (length, how many) with their number."""
    count = [0] * (capacity + 1)
    for length, n in histogram.items():
        count[length] = n
    fixed = reduce_by_dominance(count, capacity)
    return fixed + best_fit(count, capacity)


def _slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, pieces per sequence, offset)."""
    slots: dict[int, list] = {}
    taken: dict[int, int] = {}
    first = 0
    for content, times in patterns:
        offset = 0
        for length, each in content:
            slots.setdefault(length, []).append((taken.get(length, 0), first, each, offset))
            taken[length] = taken.get(length, 0) + each * times
            offset += each * length
        first += times
    return {k: np.asarray(v, np.int64) for k, v in slots.items()}


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``."""
    rows = stored(rows, "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    buckets = F.array(*[F.lit(-(-histogram.get(n, 0) // RANK_ROWS) or 1) for n in range(capacity + 1)])
    slots = _slots(plan(histogram, capacity))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.get(buckets, F.col("length").cast("int"))))
    before = dealt.groupBy("length", "bucket").count().withColumn(
        "before", F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start"))
    ranked = dealt.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    names = rows.columns

    def seat(c: dict[str, list]) -> dict:
        length, rank = np.asarray(c["length"]), np.asarray(c["rank"])
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            table = slots[int(n)]
            row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
            within = rank[at] - row[:, 0]
            sequence[at] = row[:, 1] + within // row[:, 2]
            offset[at] = row[:, 3] + within % row[:, 2] * n
        return {**{k: c[k] for k in names}, "sequence_id": sequence, "offset": offset}

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long"
    return map_batches(ranked.select(*names, "rank"), seat, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Tokenise, cut and place all documents; one row per piece. An empty table gives no rows.

    Each document ends with id 0. Only longer ones are cut. Extra columns are not read. Ties between pieces of equal
    length are broken by document and piece, so the plan does not change between runs.
    """
    return place(pieces(docs, tokenizer))


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ``ids`` (as bytes) in order."""
    ids = pieces(docs, tokenizer, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    held = placed.select(F.col("doc_id").alias("d"), F.col("piece").alias("p"), F.col("ids_crc32").alias("c"), "sequence_id", "offset")
    joined = held.join(ids, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("p") == F.col("piece")) & (F.col("c") == F.col("ids_crc32")))
    parts = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda x, y: F.concat(x, y["ids"])).alias("ids"))
