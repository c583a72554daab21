"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.common import map_batches, rows_where, rows_with, slices, starts_of, tidy
from tideframe.session import stored

BUCKETS = 1 << 16
UNKNOWN = "und"
#: One in so many labelled documents calibrates the model and does not train it.
KEPT_BACK = 5
#: Gradients are summed in whole numbers of this part; probabilities are counted in so many bins.
UNITS, BINS = 2.0**32, 1 << 16
#: Lengths of the gradient step that the documents kept back choose from.
STEPS = tuple(float(x) for x in np.geomspace(1e-3, 1.0, 10))


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` holds embedding times output layer per bucket: scores of a text are the mean over its subwords."""

    languages: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _subwords(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of three and four characters, and the text each belongs to.

    Anything but a letter is a word's edge; an edge may start or end a subword but never lies inside.
    """
    folded = [f"  {t.lower()}  " for t in texts]
    points = np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts_of(map(len, folded))))
    points = np.where(letters[points], points, 0).astype(np.uint32)
    inside = points != 0
    buckets, owners = [], []
    for n, salt in ((3, 0x85EBCA6B), (4, 0xC2B2AE35)):
        m = len(points) - n + 1
        if m <= 0:
            continue
        whole = inside[1 : m + 1].copy()
        for k in range(2, n - 1):
            whole &= inside[k : m + k]
        at = np.flatnonzero(whole)
        h = np.full(len(at), salt, np.uint32)
        for k in range(n):
            h = (h ^ points[at + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        buckets.append(h & np.uint32(BUCKETS - 1))
        owners.append(owner[at])
    return np.concatenate(buckets or [np.zeros(0, np.uint32)]), np.concatenate(owners or [np.zeros(0, np.int32)])


def held_out():
    """Documents whose id's checksum leaves a remainder of 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _quotas(counts: dict[str, int], rows: int) -> dict[str, int]:
    """Equal shares of ``rows`` per language, at least one; what small languages cannot fill goes to the others."""
    out: dict[str, int] = {}
    left = rows
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = min(counts[lang], max(1, left // (len(counts) - k)))
        left -= out[lang]
    return out


def _labelled(docs: DataFrame) -> DataFrame:
    """The documents to learn from, with the hash they are drawn by and whether they are kept back to calibrate the model."""
    chosen = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    marked = chosen.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark")).withColumn("draw", F.xxhash64("doc_id", "mark", "lang"))
    return marked.withColumn("back", F.pmod(F.xxhash64("draw"), F.lit(KEPT_BACK)) == 0)


def _sample(marked: DataFrame, sample_rows: int) -> tuple[list[tuple[str, np.ndarray, np.ndarray, bool]], dict[str, int]]:
    """Language, subword buckets and their counts, kept back or not, of at most ``sample_rows`` labelled documents (one per language
    at least), whole texts; ordered by language and buckets, copies as they are drawn.

    Drawn per language, so that no language is missing; with the number of documents of each language. The driver gets six
    bytes for each different subword of a text.
    """
    counts = {r["lang"]: r["count"] for r in marked.groupBy("lang").count().collect()}
    if not counts:
        return [], {}
    quotas = _quotas(counts, sample_rows)
    # Tasks pass on about twice the quota of each language; the rest is cut off exactly.
    pairs = [(lang, n, 2.0 * n / counts[lang] + 4.0 * (2.0 * n) ** 0.5 / counts[lang]) for lang, n in sorted(quotas.items())]
    of = lambda k: F.create_map(*[F.lit(x) for p in pairs for x in (p[0], p[k])])[F.col("lang")]
    thinned = marked.filter(F.pmod("draw", F.lit(1 << 30)) < of(2) * F.lit(1 << 30))
    ranked = thinned.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "mark")))
    chosen = ranked.filter(F.col("rank") <= of(1)).select("lang", "text", "draw", "back")

    def count(c: dict[str, list]) -> dict:
        letters, ids, counts = _letters(), [], []
        for t in c["text"]:
            b, n = np.unique(_subwords([t], letters)[0], return_counts=True)
            # Big-endian, so that the bytes sort as the buckets do.
            ids.append(b.astype(">u2").tobytes())
            counts.append(n.astype(">f4").tobytes())
        return {"lang": c["lang"], "ids": ids, "draw": c["draw"], "counts": counts, "back": c["back"]}

    found = map_batches(chosen.repartition(8, F.xxhash64("text")), count, "lang string, ids binary, draw long, counts binary, back boolean").toArrow()
    rows = sorted(zip(*(c.to_pylist() for c in found.columns)))
    return [(lang, np.frombuffer(ids, ">u2").astype(np.uint16), np.frombuffer(n, ">f4").astype(np.float32), back) for lang, ids, _, n, back in rows], counts


def fit(docs: DataFrame, sample_rows: int = 2000, width: int = 16, epochs: int = 6, rate: float = 0.5, target_precision: float = 0.995, seed: int = 5) -> LanguageModel | None:
    """Train on the labelled, not held-out documents; None if there are none.

    Up to ``sample_rows`` of them are learnt one by one. If there are more, that is the starting point only, and one step along
    the gradient over all of them follows (``_refined``). A fifth is kept back: it sets the temperature of the softmax and the probability below
    which a prediction is rejected, the lowest from which on ``target_precision`` of the predictions are right.
    If there is no such probability, everything is rejected.
    """
    marked = _labelled(docs)
    sample, documents = _sample(marked, sample_rows)
    more = sum(documents.values()) > len(sample)
    rows = [r[:3] for r in sample if len(r[1])]
    kept_back = [r[3] for r in sample if len(r[1])]
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    languages = tuple(sorted({r[0] for r in rows}))
    y = np.array([languages.index(r[0]) for r in rows])
    back, train = order[: len(rows) // KEPT_BACK], order[len(rows) // KEPT_BACK :]
    if more:  # what calibrates the model over all documents may not train its starting point, unless nothing else is there
        train = np.array([i for i in order if not kept_back[i]] or order)
    share = np.bincount(y[train], minlength=len(languages)) / max(1, len(train))
    weight = 1.0 / np.sqrt(np.maximum(share, 1e-3) * len(languages))
    table = rng.normal(0, 0.05, (BUCKETS, width)).astype(np.float32)
    out, bias = rng.normal(0, 0.05, (width, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    steps, step = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, mix = rows[i][1], rows[i][2] / rows[i][2].sum()
            hidden = mix @ table[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            p *= rate * weight[y[i]] * (1.0 - step / steps)
            # Shares of single subwords are tiny, so the table learns faster than the output layer.
            table[ids] -= 30.0 * mix[:, None] * (out @ p)[None, :]
            out -= np.outer(hidden, p)
            bias -= 0.1 * p
            step += 1
    folded = (table @ out).astype(np.float32)
    if more:
        return _refined(marked, LanguageModel(languages, folded, bias, 1.0, np.inf), documents, target_precision)
    # In double precision, as predictions are.
    logits = np.array([(rows[i][2] / rows[i][2].sum()).astype(float) @ folded[rows[i][1]].astype(float) + bias for i in back]).reshape(len(back), len(languages))
    temperature, threshold = _calibrate(logits, y[back], target_precision)
    return LanguageModel(languages, folded, bias, temperature, threshold)


def _logits(texts: list[str], weights: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean weights over each text's subwords, their number, their buckets and owners."""
    buckets, owner = _subwords(texts, letters)
    n = np.bincount(owner, minlength=len(texts))
    sums = np.stack([np.bincount(owner, weights[buckets, k], minlength=len(texts)) for k in range(weights.shape[1])], axis=1)
    return sums / np.maximum(n, 1)[:, None], n, buckets, owner


def _gradient(rows: DataFrame, model: LanguageModel, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted loss over all ``rows``, per bucket and, last, of the bias.

    Every document's share is rounded to a whole number of 2 ** -32, so the sums do not depend on how rows are dealt to tasks.
    """
    place, width = {lang: i for i, lang in enumerate(model.languages)}, len(model.languages)
    names = [f"g{k}" for k in range(width)] + ["h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total = _letters(), np.zeros((BUCKETS + 1, width + 1), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            y = np.array([place[x] for x in batch.column(1).to_pylist()])
            for lo, hi in slices([4 * len(t) for t in texts]):
                mean, n, buckets, owner = _logits(texts[lo:hi], model.weights, letters)
                error = _softmax(mean + model.bias)
                error[np.arange(hi - lo), y[lo:hi]] -= 1.0
                own = weight[y[lo:hi]] * (n > 0)
                error *= own[:, None]
                shares = np.concatenate([error / np.maximum(n, 1)[:, None], (own / np.maximum(n, 1) ** 2)[:, None]], axis=1)
                for k in range(width + 1):
                    total[:BUCKETS, k] += np.bincount(buckets, np.rint(shares[:, k] * UNITS)[owner], BUCKETS).astype(np.int64)
                total[BUCKETS] += np.append(np.rint(error * UNITS).sum(0), np.rint(own * UNITS).sum()).astype(np.int64)
        used = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(total[used, k]) for k in range(width + 1)]], names=["bucket", *names])

    parts = rows.select("text", "lang").mapInArrow(tidy(run), "bucket int, " + ", ".join(f"{c} long" for c in names))
    found = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    sums = np.zeros((BUCKETS + 1, width + 1))
    sums[found.column("bucket").to_numpy()] = np.stack([found.column(c).to_numpy() for c in names], axis=1) / UNITS
    return sums[:, :-1], sums[:, -1]


def _refined(marked: DataFrame, start: LanguageModel, documents: dict[str, int], target: float) -> LanguageModel:
    """The model after one scaled gradient step over *all* labelled documents that are not kept back.

    Those kept back, all of them, choose the length of the step and the temperature by their loss, and the threshold by counts
    per ``BINS``-th of probability. The driver gets sums per bucket, per candidate and per bin, whatever the input.
    """
    languages = start.languages
    place, width = {lang: i for i, lang in enumerate(languages)}, len(languages)
    rows = marked.filter(F.col("lang").isin(list(languages)))
    share = np.array([documents[x] for x in languages]) / sum(documents[x] for x in languages)
    g, h = _gradient(rows.filter(~F.col("back")), start, 1.0 / np.sqrt(np.maximum(share, 1e-3) * width))
    used = h[:BUCKETS] > 0
    scale = h + (h[:BUCKETS][used].mean() if used.any() else 1.0)
    scale[BUCKETS] = h[BUCKETS] + 1.0
    step = -g / scale[:, None]
    # Both models in one matrix: the start and the direction, each text is read once.
    both = np.concatenate([start.weights.astype(float), step[:BUCKETS]], axis=1)
    bias = np.concatenate([start.bias.astype(float), step[BUCKETS]])

    def measure(c: dict[str, list]) -> dict:
        letters, z, n = _letters(), [], []
        for lo, hi in slices([4 * len(t) for t in c["text"]]):
            mean, count, _, _ = _logits(c["text"][lo:hi], both, letters)
            z += list(mean + bias)
            n += count.tolist()
        return {"y": [place[x] for x in c["lang"]], "z": z, "n": n}

    held = stored(map_batches(rows.filter("back").select("text", "lang"), measure, "y int, z array<double>, n long").filter("n > 0").select("y", "z"), "kept-back")
    grid = [(float(a), float(t)) for a in STEPS for t in np.geomspace(0.05, 20, 40)]

    def matrices(c: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.asarray(c["z"], float).reshape(-1, 2 * width)
        return z[:, :width], z[:, width:], np.asarray(c["y"], np.int64)

    def losses(c: dict[str, list]) -> dict:
        (begin, way, y), out = matrices(c), []
        for length, t in grid:
            out.append(int(np.rint(-np.log(_softmax((begin + length * way) / t)[np.arange(len(y)), y] + 1e-12) * 2.0**20).sum()))
        return {"candidate": range(len(grid)), "loss": out}

    found = map_batches(held, losses, "candidate int, loss long").groupBy("candidate").agg(F.sum("loss").alias("loss")).collect()
    if not found:
        length, temperature = STEPS[0], 1.0
    else:
        length, temperature = grid[min(found, key=lambda r: (r["loss"], r["candidate"]))["candidate"]]

    def sorted_in(c: dict[str, list]) -> dict:
        begin, way, y = matrices(c)
        p = _softmax((begin + length * way) / temperature)
        return {"bin": np.minimum(p.max(1) * BINS, BINS - 1).astype(np.int32), "right": p.argmax(1) == y}

    bins = map_batches(held, sorted_in, "bin int, right boolean").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right")).collect()
    bins = sorted(((r["bin"], r["n"], r["right"]) for r in bins), reverse=True)
    number, right = (np.cumsum([b[k] for b in bins]) for k in (1, 2))
    enough = np.flatnonzero(right >= target * number)
    weights = (start.weights + length * step[:BUCKETS]).astype(np.float32)
    return LanguageModel(languages, weights, (start.bias + length * step[BUCKETS]).astype(np.float32), temperature, bins[enough[-1]][0] / BINS if len(enough) else np.inf)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _calibrate(logits: np.ndarray, y: np.ndarray, target: float, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Temperature and lowest accepted probability; ``weight`` tells how many documents a row stands for."""
    if not len(y):
        return 1.0, np.inf
    at, weight = np.arange(len(y)), np.ones(len(y)) if weight is None else weight
    temperature = min(np.geomspace(0.05, 20, 80), key=lambda t: np.average(-np.log(_softmax(logits / t)[at, y] + 1e-12), weights=weight))
    p = _softmax(logits / temperature)
    best, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-best, kind="stable")
    precision = np.cumsum((right * weight)[order]) / np.cumsum(weight[order])
    enough = np.flatnonzero(precision >= target)
    # Down to the ninth decimal, so that sums in another order reject nothing.
    return float(temperature), float(np.floor(best[order][enough[-1]] * 1e9) / 1e9) if len(enough) else np.inf


def predictions(texts: list[str], model: LanguageModel | None) -> tuple[list[str], np.ndarray, list[bool]]:
    """(language, score, accepted) of each text."""
    names, scores, letters = [UNKNOWN] * len(texts), np.zeros(len(texts)), _letters()
    for lo, hi in slices([4 * len(t) for t in texts]) if model else ():
        mean, n, _, _ = _logits(texts[lo:hi], model.weights, letters)
        p = _softmax((mean + model.bias) / model.temperature)
        for i in np.flatnonzero(n):
            k = int(p[i].argmax())
            names[lo + i], scores[lo + i] = model.languages[k], min(1.0, float(p[i, k]))
    return names, scores, [bool(model) and x != UNKNOWN and s >= model.threshold for x, s in zip(names, scores)]


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` per row of ``docs``.

    Reads whole texts only; language, source and id are no inputs. A null text, one without a letter, and any text
    when there is no model get ``und`` with score 0 and are not accepted. Repeated rows get equal answers.
    """

    def run(c: dict[str, list]) -> dict:
        names, scores, accepted = predictions([t or "" for t in c["text"]], model)
        return {"doc_id": c["doc_id"], "held_out": c["held_out"], "lang_pred": names, "score": scores, "accepted": accepted}

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_batches(chosen, run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def language_id(docs: DataFrame, **options) -> DataFrame:
    """Fit on the labelled documents and predict every document; see ``identify`` for odd rows."""
    return identify(docs, fit(docs, **options))


def in_known_language(docs: DataFrame, **options) -> DataFrame:
    """The documents whose language is recognised with enough confidence, with all their columns; of rows that share an id all
    must be. Rows without an id are judged one by one."""
    model = fit(docs, **options)
    verdict = identify(docs.filter("doc_id is not null"), model).groupBy("doc_id").agg(F.bool_and("accepted").alias("accepted"))
    named = rows_with(docs.filter("doc_id is not null"), verdict.filter("accepted"))
    return named.unionByName(rows_where(docs.filter("doc_id is null"), lambda texts: predictions(texts, model)[2]))
