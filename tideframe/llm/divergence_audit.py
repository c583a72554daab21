"""How far the sources of a language differ in their words, priced from joint tables of count levels.

Within a language a group (a source) knows a term only by its count, so its smoothed share takes one value per count
*level*. An indicator column per (group, level) over the terms, multiplied by all of them transposed, counts how many
terms stand at each pair of levels; the table times the differences of the levels' shares prices every pair of groups.
The product is made in blocks of terms with similar totals, where levels are few, in 32-bit floats whose counts are exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import slices
from tideframe.session import stored

#: Documents of a language that must hold a term, what is added to each count, and the parts that shares are counted in.
LEAST_DOCUMENTS, ADDED, UNITS = 30, 5, 1_000_000_000
TERM_RANKS = 50
#: Groups in one tile of the pair matrix, terms that one task holds, and columns of one matrix product.
TILE, TERM_ROWS, COLUMNS = 128, 50_000, 512
#: Terms that a task counts before it passes their counts on.
HELD_TERMS = 300_000
#: Lower case for A-Z, a blank for every other ASCII character that is no letter.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
RESULT = ("lang", "source", "part", "item", "value", "rank")


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences and documents per group and term, one or more rows each, summed per task.

    A row without a term tells that the group occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> pa.RecordBatch:
            groups, terms, n, n_docs = [], [], [], []
            for group, (words, holders) in seen.items():
                groups += [group] * (len(words) + 1)
                terms += [None, *(w.decode("utf-8", "surrogatepass") for w in words)]
                n += [0, *words.values()]
                n_docs += [0, *(holders[w] for w in words)]
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string()), pa.array(terms, pa.string()),
                 pa.array(n, pa.int64()), pa.array(n_docs, pa.int64())], names=["lang", "source", "term", "n", "n_docs"])

        for batch in batches:
            columns = {name: batch.column(name) for name in ("lang", "source", "text")}
            for lo, hi in slices([n or 0 for n in pc.binary_length(columns["text"]).to_pylist()]):
                lang, source, text = (columns[c].slice(lo, hi - lo).to_pylist() for c in ("lang", "source", "text"))
                for group, raw in zip(zip(lang, source), text):
                    words, holders = seen.setdefault(group, (Counter(), Counter()))
                    own = Counter(raw.encode("utf-8", "surrogatepass").translate(_LETTERS).split())
                    words.update(own)
                    holders.update(own.keys())
                if sum(len(w) for w, _ in seen.values()) > HELD_TERMS:
                    yield out()
        if seen:
            yield out()

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*blank).mapInArrow(run, "lang string, source string, term string, n long, n_docs long")


def share(count, n, v):
    """The smoothed share of a level as a column, in whole billionths, one at least."""
    above = F.lit(UNITS).cast("decimal(10,0)") * (count + ADDED).cast("decimal(19,0)")
    return F.when(v > 0, F.call_function("div", above.cast("decimal(38,0)"), (n + ADDED * v).cast("decimal(38,0)")) + 1)


def _joint_prices(level: np.ndarray, price: np.ndarray, left: np.ndarray, right: np.ndarray, total: np.ndarray, most: int = COLUMNS) -> None:
    """Add to ``total`` what the terms of ``level`` and ``price`` (terms by groups) cost each pair of groups.

    ``left`` and ``right`` are the groups of both sides. A block with more than ``most`` levels is halved; a block is one product
    of the indicator columns of its levels.
    """
    if not len(level):
        return
    order = np.argsort(level, axis=0, kind="stable")
    ranked = np.take_along_axis(level, order, 0)
    new = np.ones(ranked.shape, bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if len(level) > 1 and new.sum() > most:
        half = len(level) // 2
        _joint_prices(level[:half], price[:half], left, right, total, most)
        _joint_prices(level[half:], price[half:], left, right, total, most)
        return
    # Columns of one group stand together: number them group by group.
    each = new.sum(0)
    first = np.concatenate([[0], np.cumsum(each)])
    column = np.empty(level.shape, np.int64)
    np.put_along_axis(column, order, np.cumsum(new, 0) - 1, 0)
    column += first[:-1][None, :]
    shares = np.empty(first[-1], np.int64)
    shares[column.ravel()] = price.ravel()
    indicator = np.zeros((len(level), first[-1]), np.float32)
    indicator[np.arange(len(level))[:, None], column] = 1.0

    def side(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([np.arange(first[g], first[g + 1]) for g in groups])
        return at, np.concatenate([[0], np.cumsum(each[groups])[:-1]])

    rows, row_starts = side(left)
    columns, column_starts = side(right)
    joint = (indicator[:, rows].T @ indicator[:, columns]).astype(np.int64)
    cost = joint * np.abs(shares[rows][:, None] - shares[columns][None, :])
    total += np.add.reduceat(np.add.reduceat(cost, row_starts, 0), column_starts, 1)


def _pair_prices(terms: pa.Table, groups: pa.Table, tile: int, most: int) -> pa.Table:
    """The price of each pair of a tile over the terms of one task: ``lang, g, h, value, seen``."""
    empty = {"lang": pa.array([], pa.string()), **{k: pa.array([], pa.int64()) for k in ("g", "h", "value", "seen")}}
    if not terms.num_rows or not groups.num_rows:
        return pa.table(empty)
    number = groups.column("g").to_numpy()
    order = np.argsort(number)
    number, none = number[order], groups.column("p_none").to_numpy()[order]
    own, other = (groups.column(c)[0].as_py() for c in ("bi", "bj"))
    entries = terms.column("entries").combine_chunks()
    held = entries.flatten()
    row = np.repeat(np.arange(len(entries)), np.diff(entries.offsets.to_numpy()))
    at = np.searchsorted(number, held.field("g").to_numpy())
    count, price = held.field("n").to_numpy(), held.field("p").to_numpy()
    left, right = np.flatnonzero(number // tile == own), np.flatnonzero(number // tile == other)
    sums = np.bincount(row, count.astype(np.float64), len(entries))
    place = np.empty(len(entries), np.int64)
    place[np.argsort(sums, kind="stable")] = np.arange(len(entries))
    total = np.zeros((len(left), len(right)), np.int64)
    where = place[row]
    turn = np.argsort(where, kind="stable")
    where, at, count, price = where[turn], at[turn], count[turn], price[turn]
    for lo in range(0, len(entries), 1024):
        hi = min(lo + 1024, len(entries))
        a, b = np.searchsorted(where, [lo, hi])
        level, cost = np.zeros((hi - lo, len(number)), np.int64), np.repeat(none[None, :], hi - lo, 0)
        level[where[a:b] - lo, at[a:b]] = count[a:b]
        cost[where[a:b] - lo, at[a:b]] = price[a:b]
        _joint_prices(level, cost, left, right, total, most)
    g, h = np.meshgrid(number[left], number[right], indexing="ij")
    keep = (g < h).ravel()
    n = int(keep.sum())
    return pa.table({"lang": pa.array([groups.column("lang")[0].as_py()] * n, pa.string()), "g": g.ravel()[keep].astype(np.int64), "h": h.ravel()[keep].astype(np.int64),
                     "value": total.ravel()[keep], "seen": np.full(n, len(entries), np.int64)})


def source_divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: per group the other sources of its language by distance, and its own terms.

    Null text, language and source count as empty strings. A group occurs if a row has it, even without a term. A language
    without a kept term prices all its pairs 0 and has no term rows. Equal values rank by the item's bytes. Rows count each,
    repeated or not. Other columns are not read. An empty table gives no rows.
    """
    sums = stored(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "term-counts")
    common = sums.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("n_docs").alias("docs")).filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs")
    kept = stored(sums.filter("term is not null").drop("n_docs").join(common, ["lang", "term"]), "kept-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    vocabulary = common.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    numbered = Window.partitionBy("lang").orderBy("source")
    groups = sums.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("group_n", "v", "lang_n")], (F.row_number().over(numbered) - 1).cast("long").alias("g"))
    groups = stored(groups.withColumn("p_none", F.coalesce(share(F.lit(0).cast("long"), F.col("group_n"), F.col("v")), F.lit(0).cast("long"))), "groups")
    priced = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "g", "n", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q"))
    return _ranked(_pairs(priced, groups), None).unionByName(_ranked(
        priced.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), TERM_RANKS))


def _ranked(rows: DataFrame, least: int | None) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return (ranked if least is None else ranked.filter(F.col("rank") <= least)).select(*RESULT)


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """All ordered pairs of a language's groups with their price.

    Groups stand in tiles of ``TILE``; a task has the terms of one part of the vocabulary that occur in a pair of tiles, and
    terms that occur in neither are priced by their number.
    """
    tiles = groups.groupBy("lang").agg((F.floor(F.max("g") / TILE) + 1).cast("int").alias("n_tiles"), F.ceil(F.max("v") / TERM_ROWS).cast("int").alias("n_parts"))
    own = F.floor(F.col("g") / TILE).cast("int")
    spread = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("other")
    keys = ["lang", "bi", "bj", "part"]
    entry = F.struct("g", "n", "p")
    dealt = priced.join(tiles, "lang").select("lang", "term", entry.alias("entry"), own.alias("own"), spread, F.pmod(F.xxhash64("term"), F.col("n_parts")).cast("int").alias("part"))
    terms = dealt.groupBy("lang", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "part", "term").agg(F.collect_list("entry").alias("entries")).drop("term")
    sides = groups.join(tiles, "lang").filter("n_parts > 0").select("lang", "g", "p_none", own.alias("own"), spread, "n_parts")
    sides = sides.select("lang", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), "g", "p_none")
    tile, most = TILE, COLUMNS
    found = terms.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(lambda a, b: _pair_prices(a, b, tile, most), "lang string, g long, h long, value long, seen long")
    sums = found.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # The pairs themselves are the result, so they are joined within a language.
    left = groups.select("lang", "source", "g", "p_none", "v")
    right = groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("p_none").alias("other_none"))
    pairs = left.join(right, "lang").filter("g <> h").withColumns({"low": F.least("g", "h"), "high": F.greatest("g", "h")})
    both = pairs.join(sums.withColumnsRenamed({"g": "low", "h": "high"}), ["lang", "low", "high"], "left")
    rest = (F.col("v") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("p_none") - F.col("other_none"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))
