"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by cell (source, language, topic).  Raking multiplies cell weights until the weighted tokens of every
source, language and topic have their target shares: marginals that the caller gives, or the found ones tempered by an
exponent.  Documents are then sampled with probability min(1, c * weight) of their cell, where c spends the token budget;
weight / probability of a sampled document is its calibration weight.

Topics are learned from every document: words are hashed into DIMS buckets, weighted by tf-idf, and clustered by spherical
k-means.  Document frequencies, the draws of the first centres and the sums of every round are taken over the whole table,
one pass each over the stored unit vectors; of these a task returns DIMS numbers a topic, and the driver holds the centres.
Vectors and centres are whole numbers (see UNIT, CENTRE), so that products and sums are exact and the model does not depend
on how rows are dealt out.  A document weighs as much as its copies; drawn as a first centre it counts once.

A weight is the product of a factor of its source, one of its language and one of its topic.  Cells are stored with a row
for each source; its factor is worked out where its cells are, and a sweep returns one sum for each pair of a language and a
topic, whose factors the driver holds (at most MOST_PAIRS pairs, at every number of sources and documents; with more
languages than that a language takes the place of the source).  From the ninth sweep on the next one starts from an
extrapolation of the last ones (Anderson's), which changes where it gets to in no way, only how soon.

Defined cases: null source or language is the group ''; null or wordless text has 0 tokens and topic 'none'; the draw
depends on id and text only, so repeated rows share their fate; a group that given marginals do not name gets weight 0,
and shares of groups without tokens are spread over the others; texts of any length count whole; ties between topics go
to the first; an empty table gives an empty table; all input columns are kept in `sample_documents`, whatever their names.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import textkit
from corvane.llm.shared import CALLER, discard, shuffle_or_broadcast, small_batches, stored, text_blocks, unwrapped, wrapped

DIMENSIONS = ("source", "lang", "topic")
DIMS = 512
#: Length of a document's vector and of a centre, before each component is rounded to a whole number.
UNIT, CENTRE = (1 << 15) - 1, 1 << 20
#: Draws for each first centre, of which the best is taken.
TRIES = 8
#: Pairs of groups of the two dimensions with fewer groups, at most; sweeps before the first extrapolation, and sweeps that one looks back on.
MOST_PAIRS, PLAIN_SWEEPS, LOOK_BACK = 1_000_000, 8, 6


def bucket_counts(rows: np.ndarray, hashes: np.ndarray, n_rows: int, dims: int = DIMS) -> np.ndarray:
    """Each bucket's words in each row."""
    return np.bincount(rows * dims + (hashes % np.uint64(dims)).astype(np.int64), minlength=n_rows * dims).reshape(n_rows, dims)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """(1 + log count) * idf, at length UNIT and rounded; rows without words stay 0."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.rint(x * (UNIT / np.where(norm > 0, norm, 1)))


def _centres(vectors: np.ndarray) -> np.ndarray:
    return np.rint(vectors * (CENTRE / np.linalg.norm(vectors, axis=1, keepdims=True)))


def _dense(batch: pa.RecordBatch, kind: type) -> np.ndarray:
    """The vectors of a batch's first column."""
    buf, _ = textkit.flatten(batch.column(0))
    return buf.view(kind).reshape(batch.num_rows, DIMS)


def _binary(vectors: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(vectors)
    offs = np.arange(len(data) + 1, dtype=np.int32) * (DIMS * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def _counted(docs: DataFrame) -> DataFrame:
    """The counts of every text's buckets, stored."""

    def block(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        n = len(offs) - 1
        _, _, at, hashes = textkit.words(buf, offs, lower=True)
        counts = np.zeros((n, DIMS), np.int32)
        cuts = np.searchsorted(at, np.arange(n + 1))
        for lo in range(0, n, 256):
            hi = min(n, lo + 256)
            counts[lo:hi] = bucket_counts(at[cuts[lo] : cuts[hi]] - lo, hashes[cuts[lo] : cuts[hi]], hi - lo)
        return pa.RecordBatch.from_arrays([_binary(counts)], ["counts"])

    return stored(small_batches(docs).mapInArrow(text_blocks(block, "_text"), "counts binary"), "counts")


def _weighted(counted: DataFrame, idf: np.ndarray) -> DataFrame:
    """Unit vectors of all texts with words, and a hash of each, stored."""
    odd = textkit.mix64(np.arange(1, DIMS + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches):
        for batch in batches:
            counts = _dense(batch, np.int32)
            for lo in range(0, len(counts), 1024):
                x = unit_vectors(counts[lo : lo + 1024], idf)
                x = x[x.any(1)].astype(np.int16)
                h = textkit.mix64((x.astype(np.uint64) * odd).sum(1, dtype=np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([_binary(x), pa.array(h)], ["unit", "h"])

    return stored(counted.mapInArrow(run, "unit binary, h bigint"), "units")


def _summed(rows: DataFrame, run, size: int) -> np.ndarray:
    """Sums over the table of the `size` whole numbers that each task returns."""
    parts = rows.mapInArrow(run, "total array<bigint>").select(F.posexplode("total").alias("place", "total"))
    out = np.zeros(size, np.int64)
    for r in parts.groupBy("place").agg(F.sum("total").alias("total")).collect():
        out[r["place"]] = r["total"]
    return out


def _totals(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.ravel().astype(np.int64).tolist()], pa.list_(pa.int64()))], ["total"])


def document_frequencies(counted: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts, and of those with a word in each bucket."""

    def run(batches):
        total = np.zeros(DIMS + 1, np.int64)
        for batch in batches:
            total[:DIMS] += (_dense(batch, np.int32) > 0).sum(0)
            total[DIMS] += batch.num_rows
        yield _totals(total)

    found = _summed(counted, run, DIMS + 1)
    return int(found[DIMS]), found[:DIMS]


def _candidates(units: DataFrame, chosen: list[np.ndarray], tried: list[np.ndarray], seed: int) -> tuple[int, list[np.ndarray]]:
    """Which tried vector leaves the least sum of distances if it is chosen too, and TRIES vectors drawn by their distances then.

    The least of -log(u) / distance over all vectors is such a draw (a race of exponential clocks); u comes from the
    vector's hash, so copies are one.  Vectors that equal a chosen one are never drawn.
    """
    salts = textkit.mix64(np.array([seed << 32 | len(chosen) << 16 | r for r in range(TRIES)], np.uint64))
    n_tried = max(1, len(tried))
    against = np.array([*chosen, *tried], float).reshape(-1, DIMS)
    lengths = np.linalg.norm(against, axis=1)

    def run(batches):
        left, keys, found = np.zeros(n_tried, np.int64), np.full((n_tried, TRIES), math.inf), np.zeros((n_tried, TRIES, DIMS), np.int16)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, h = _dense(batch, np.int16), batch.column(1).to_numpy().view(np.uint64)
            wide = x.astype(float)
            far = 1 - (wide @ against.T) / (np.linalg.norm(wide, axis=1)[:, None] * lengths)
            near = far[:, : len(chosen)].min(1, initial=1.0)
            clocks = [-np.log(((textkit.mix64(h ^ salt) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)) for salt in salts]
            for t in range(n_tried):
                now = np.minimum(near, far[:, len(chosen) + t]) if tried else near
                now = np.where(now > 1e-9, now, 0.0)
                left[t] += np.rint(now * CENTRE).astype(np.int64).sum()
                for r, clock in enumerate(clocks):
                    key = np.where(now > 0, clock / np.where(now > 0, now, 1), math.inf)
                    i = int(key.argmin())
                    if key[i] < keys[t, r]:
                        keys[t, r], found[t, r] = key[i], x[i]
        t, r = np.divmod(np.arange(n_tried * TRIES), TRIES)
        columns = [pa.array(t), pa.array(r), pa.array(np.where(r == 0, left[t], 0)), pa.array(keys.ravel()), _binary(found.reshape(-1, DIMS))]
        yield pa.RecordBatch.from_arrays(columns, ["tried", "race", "left", "key", "unit"])

    rows = units.mapInArrow(run, "tried bigint, race bigint, left bigint, key double, unit binary")
    found = rows.groupBy("tried", "race").agg(F.sum("left").alias("left"), F.min(F.struct("key", "unit")).alias("least")).collect()
    if not found:
        return 0, []
    _, best = min((r["left"], r["tried"]) for r in found if r["race"] == 0)
    drawn = [r["least"]["unit"] for r in sorted(found, key=lambda r: r["race"]) if r["tried"] == best and r["least"]["key"] < math.inf]
    return best, [np.frombuffer(v, np.int16).astype(float) for v in dict.fromkeys(map(bytes, drawn))]


def fit_topics(units: DataFrame, n_topics: int, rounds: int = 25, seed: int = 1) -> np.ndarray:
    """Centres of stored unit vectors, by spherical k-means over all of them; at most one for each distinct vector."""
    chosen: list[np.ndarray] = []
    _, tried = _candidates(units, [], [], seed)
    while tried and len(chosen) < n_topics:
        best, after = _candidates(units, chosen, tried, seed)
        chosen.append(tried[best])
        tried = after
    if not chosen:
        return np.zeros((0, DIMS))
    centres = _centres(np.array(chosen))
    for _ in range(rounds):

        def run(batches, centres=centres):
            total = np.zeros((len(centres), DIMS))
            for batch in batches:
                x = _dense(batch, np.int16).astype(float)
                at = (x @ centres.T).argmax(1)
                total += (at == np.arange(len(centres))[:, None]).astype(float) @ x
            yield _totals(total)

        sums = _summed(units, run, centres.size).reshape(centres.shape).astype(float)
        moved = _centres(np.where(sums.any(1, keepdims=True), sums, centres))
        if np.array_equal(moved, centres):
            break
        centres = moved
    return centres


def topic_model(docs: DataFrame, *, text: str = "text", n_topics: int = 8, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """idf of the buckets and centres of the topics, from all texts of a table."""
    counted = _counted(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")))
    n, df = document_frequencies(counted)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    units = _weighted(counted, idf)
    discard(counted)
    centres = fit_topics(units, n_topics, seed=seed)
    discard(units)
    return idf, centres


def with_features(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], *, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", seed: int = 1) -> DataFrame:
    """The caller's columns wrapped, _text, source, lang, topic, tokens and the uniform draw u; a narrow map."""
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 11) / float(1 << 53)
    rows = wrapped(docs, text, F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce(F.col(lang), F.lit("")).alias("lang"), draw.alias("u"))
    names, (idf, centres) = rows.columns, model

    def block(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        n = len(offs) - 1
        _, _, at, hashes = textkit.words(buf, offs, lower=True)
        tokens, topic = np.bincount(at, minlength=n).astype(np.int64), np.full(n, "none", object)
        cuts = np.searchsorted(at, np.arange(n + 1))
        for lo in range(0, n, 256):
            hi = min(n, lo + 256)
            some = slice(cuts[lo], cuts[hi])
            if len(centres):
                best = (unit_vectors(bucket_counts(at[some] - lo, hashes[some], hi - lo), idf) @ centres.T).argmax(1)
                topic[lo:hi] = np.where(tokens[lo:hi] > 0, np.char.add("t", best.astype(str)), "none")
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(tokens), pa.array(topic, pa.string())], [*names, "tokens", "topic"])

    schema = T.StructType([*rows.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("topic", T.StringType())])
    return small_batches(rows).mapInArrow(text_blocks(block, "_text"), schema)


def _target_shares(cells: DataFrame, d: str, power: float, given: dict[str, float] | None) -> DataFrame:
    """The dimension's groups with their target shares (stored): given ones, or the found tokens ** power; groups without tokens get none."""
    have = cells.groupBy(d).agg(F.sum("tokens").alias("t"))
    if given is None:
        raised = have.withColumn("p", F.when(F.col("t") > 0, F.pow("t", F.lit(power))).otherwise(0.0))
    else:
        listed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], f"{d} string, v double")
        raised = have.join(listed, d, "left").withColumn("p", F.when(F.col("t") > 0, F.coalesce("v", F.lit(0.0))).otherwise(0.0))
    raised = stored(raised.select(d, "p"), "shares")
    total = raised.agg(F.sum("p")).collect()[0][0]
    return raised.select(d, (F.col("p") / (total or 1.0)).alias(f"share_{d}"))


def _extrapolated(history: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Where the last sweeps, each from x to g, seem to lead (Anderson acceleration of a fixed-point map)."""
    x, g = (np.array(part) for part in zip(*history))
    f = g - x
    gamma, *_ = np.linalg.lstsq((f[1:] - f[:-1]).T, f[-1], rcond=1e-10)
    return g[-1] - (g[1:] - g[:-1]).T @ gamma


class _Margins:
    """The two dimensions whose factors the driver holds: numbers and targets of their groups."""

    def __init__(self, names: list[list[str]], shares: list[np.ndarray]):
        self.names, self.shares = names, shares
        self.sizes = (len(names[0]), len(names[1]))

    def pairs(self, factors: list[np.ndarray]) -> np.ndarray:
        return np.outer(factors[0], factors[1]).ravel()


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Share of each row's group; row, pair and tokens of each cell."""
    share, cells = (batch.column(batch.schema.get_field_index(c)) for c in ("share", "cells"))
    offs = cells.offsets.to_numpy()
    flat = cells.flatten()
    return share.to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), np.diff(offs)), flat.field("pair").to_numpy(), flat.field("tokens").to_numpy()


def _own_factors(share: np.ndarray, row: np.ndarray, tokens: np.ndarray, pairs: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray]:
    have = np.bincount(row, tokens * pairs, len(share))
    return np.where(have > 0, share * whole / np.where(have > 0, have, 1), 1.0), have


def rake(cells: DataFrame, powers: dict[str, float], targets: dict[str, dict[str, float]], rounds: int, tolerance: float) -> DataFrame:
    """source, lang, topic, tokens, weight and missed of every cell: one dimension after the other, until every total is within the tolerance.

    missed: the most that the total of one of the cell's groups is off its target, as a share of the target.  A warning says
    if some still are after all rounds, which is so where cells cannot meet the targets.
    """
    spark = cells.sparkSession
    whole = cells.agg(F.sum("tokens")).collect()[0][0] or 0
    groups = {d: _target_shares(cells, d, powers[d], targets.get(d)) for d in DIMENSIONS}
    counts = {d: groups[d].count() for d in DIMENSIONS}
    pairs_beside = lambda d: math.prod(counts[x] for x in DIMENSIONS if x != d)
    first = next((d for d in DIMENSIONS if pairs_beside(d) <= MOST_PAIRS), min(DIMENSIONS, key=pairs_beside))
    one, two = (d for d in DIMENSIONS if d != first)
    if counts[one] * counts[two] > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} pairs of {one} and {two}")
    listed = {d: sorted(map(tuple, groups[d].collect())) for d in (one, two)}  # bounded by MOST_PAIRS
    margins = _Margins([[k for k, _ in listed[d]] for d in (one, two)], [np.array([v for _, v in listed[d]], float) for d in (one, two)])
    numbers = [spark.createDataFrame([(k, i) for i, k in enumerate(names)] or [("", 0)], f"{d} string, n_{d} int") for d, names in zip((one, two), margins.names)]
    numbered = cells.join(F.broadcast(numbers[0]), one).join(F.broadcast(numbers[1]), two).join(groups[first], first)
    pair = F.col(f"n_{one}") * margins.sizes[1] + F.col(f"n_{two}")
    rows = stored(numbered.groupBy(first).agg(F.any_value(f"share_{first}").alias("share"), F.collect_list(F.struct(pair.alias("pair"), "tokens")).alias("cells")), "mix")

    def sweep(now: list[np.ndarray], before: list[np.ndarray]) -> tuple[np.ndarray, float]:
        """Weighted tokens of each pair once the first dimension is met, and the most that it was off."""
        new, old, n = margins.pairs(now), margins.pairs(before), margins.sizes[0] * margins.sizes[1]

        def run(batches):
            total, off = np.zeros(n), 0.0
            for batch in batches:
                share, row, pairs, tokens = _flat(batch)
                factor, have = _own_factors(share, row, tokens, new[pairs], whole)
                _, had = _own_factors(share, row, tokens, old[pairs], whole)
                both = (have > 0) & (had > 0) & (share > 0)
                off = max(off, np.abs(have[both] / had[both] - 1).max(initial=0.0))
                total += np.bincount(pairs, factor[row] * tokens * new[pairs], n)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([off])], ["total", "off"])

        parts = rows.mapInArrow(run, "total array<double>, off double").select("off", F.posexplode("total").alias("pair", "total"))
        found = parts.groupBy("pair").agg(F.sum("total").alias("total"), F.max("off").alias("off")).collect()  # a row a pair
        total = np.zeros(n)
        for r in found:
            total[r["pair"]] = r["total"]
        return total.reshape(margins.sizes), max((r["off"] for r in found), default=0.0)

    def off_target(total: np.ndarray) -> list[np.ndarray]:
        have = (total.sum(1), total.sum(0))
        return [np.where((s > 0) & (h > 0), np.abs(h / np.where(s > 0, s * whole, 1) - 1), 0.0) for s, h in zip(margins.shares, have)]

    def step(factors: list[np.ndarray], total: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Both other dimensions met in turn; the totals change with their factors."""
        out = []
        for axis in (0, 1):
            have = total.sum(1 - axis)
            change = np.where(have > 0, margins.shares[axis] * whole / np.where(have > 0, have, 1), 1.0)
            out.append(factors[axis] * change)
            total = total * (change[:, None] if axis == 0 else change[None, :])
        return out, total

    log = lambda f: np.concatenate([np.log(np.where(x > 0, x, 1)) for x in f])
    before = [np.ones(margins.sizes[0]), np.ones(margins.sizes[1])]
    live = None
    factors, missed, history, best = before, [np.zeros(m) for m in margins.sizes], [], math.inf
    for r in range(rounds if whole else 0):
        total, _ = sweep(before, before)
        factors, after = step(before, total)
        missed = off_target(after)
        if r >= PLAIN_SWEEPS or all(m.max(initial=0) < tolerance for m in missed):
            _, off = sweep(factors, before)
            worst = max(off, *(m.max(initial=0.0) for m in missed))
            if worst < tolerance or r + 1 == rounds:
                break
        if r + 1 == rounds:
            break
        size = max(m.max(initial=0.0) for m in off_target(total))
        history = [*history[-LOOK_BACK:], (log(before), log(factors))] if size < 4 * best else []
        best = min(best, size)
        live = [f > 0 for f in factors]
        before = factors
        if r >= PLAIN_SWEEPS and len(history) > 2:
            guess = np.exp(np.clip(_extrapolated(history), -300, 300))
            before = [np.where(on, x, 0.0) for on, x in zip(live, np.split(guess, [margins.sizes[0]]))]
    new, old, misses = margins.pairs(factors), margins.pairs(before), [np.repeat(missed[0], margins.sizes[1]), np.tile(missed[1], margins.sizes[0])]

    def weighted(batches):
        for batch in batches:
            share, row, pairs, tokens = _flat(batch)
            factor, had = _own_factors(share, row, tokens, old[pairs], whole)
            have = np.bincount(row, factor[row] * tokens * new[pairs], len(share))
            off = np.where((share > 0) & (had > 0), np.abs(have / np.where(share > 0, share * whole, 1) - 1), 0.0)
            names = [pa.array(margins.names[0]).take(pa.array(pairs // margins.sizes[1])), pa.array(margins.names[1]).take(pa.array(pairs % margins.sizes[1]))]
            own = batch.column(batch.schema.get_field_index(first)).take(pa.array(row))
            columns = {first: own, one: names[0], two: names[1]}
            miss = np.maximum(off[row], np.maximum(misses[0][pairs], misses[1][pairs])) if len(row) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(columns[d] for d in DIMENSIONS), pa.array(tokens), pa.array(factor[row] * new[pairs]), pa.array(miss)], [*DIMENSIONS, "tokens", "weight", "missed"])

    out = stored(rows.mapInArrow(weighted, "source string, lang string, topic string, tokens double, weight double, missed double"), "raked")
    worst = out.agg(F.max("missed")).collect()[0][0] or 0.0
    if worst > max(tolerance, 1e-9) and rounds > PLAIN_SWEEPS:
        warnings.warn(f"some totals are still off their targets by up to {worst:.2%}: the cells may not be able to meet them", stacklevel=2)
    return out


def sampling_rate(cells: DataFrame, budget: float) -> float:
    """The c with sum(tokens * min(1, c * weight)) = budget; infinite if the budget takes all.

    c only rises from step to step, as more cells are taken whole, so it ends after finitely many steps.
    """
    full, c = None, 0.0
    while True:
        taken = F.lit(c) * F.col("weight") >= 1
        got = cells.agg(
            F.count_if(taken).alias("n"), F.coalesce(F.sum(F.when(taken, F.col("tokens"))), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~taken, F.col("tokens") * F.col("weight"))), F.lit(0.0)).alias("rest")).collect()[0]
        if got.n == full:
            return c
        if got.rest <= 0:
            return float("inf")
        full, c = got.n, max(c, (budget - got.full) / got.rest)


def mixing_cells(features: DataFrame, *, powers: dict[str, float] | None = None, targets: dict[str, dict[str, float]] | None = None, budget_share: float = 0.5, rounds: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """source, lang, topic, tokens, weight, missed and prob of every cell.

    Sweeps end once no total is off its target by more than `tolerance` of it, or after `rounds` of them: targets that the
    cells cannot meet (a source in one language only) are come near to, with a warning; `missed` says how near.

    targets: for a dimension, the share of each group (they are normalised).  powers: for the others, the exponent that
    tempers their token totals to target shares (1 as found, 0 uniform).
    """
    powers = {"source": 0.7, "lang": 0.8, "topic": 0.5} | (powers or {})
    cells = stored(features.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("tokens")), "cells")
    raked = rake(cells, powers, targets or {}, rounds, tolerance)
    whole = cells.agg(F.sum("tokens")).collect()[0][0] or 0.0
    c = sampling_rate(raked, budget_share * whole) if whole else float("inf")
    prob = F.when(F.col("weight") > 0, F.lit(1.0)).otherwise(0.0) if c == float("inf") else F.least(F.lit(1.0), F.lit(c) * F.col("weight"))
    return raked.withColumn("prob", prob)


def _featured(docs: DataFrame, n_topics: int, columns: dict[str, str]) -> DataFrame:
    """Features of every row, made once and stored."""
    model = topic_model(docs, text=columns["text"], n_topics=n_topics)
    return stored(with_features(docs, model, **columns), "featured")


def mix(docs: DataFrame, *, n_topics: int = 8, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", **options) -> DataFrame:
    """Every row's cell, weight, probability, whether it is sampled, and the calibration weight if so."""
    columns = {"doc_id": doc_id, "source": source, "lang": lang, "text": text}
    model = topic_model(docs, text=text, n_topics=n_topics)
    features = with_features(docs.select(*dict.fromkeys(columns.values())), model, **columns).select(F.col(CALLER).getField(doc_id).alias("doc_id"), *DIMENSIONS, "tokens", "u")
    features = stored(features, "features")
    cells = shuffle_or_broadcast(stored(mixing_cells(features, **options).drop("tokens"), "cells"))
    taken = F.col("u") < F.col("prob")
    return features.join(cells, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, F.col("tokens").alias("n_tokens"), "weight", "prob", taken.alias("sampled"), F.when(taken, F.col("weight") / F.col("prob")).alias("calibration"))


def sample_documents(docs: DataFrame, *, n_topics: int = 8, doc_id: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", **options) -> DataFrame:
    """The sampled rows with all their columns."""
    rows = _featured(docs, n_topics, {"doc_id": doc_id, "source": source, "lang": lang, "text": text})
    cells = shuffle_or_broadcast(stored(mixing_cells(rows, **options).select(*DIMENSIONS, "prob"), "cells"))
    return unwrapped(rows.join(cells, list(DIMENSIONS)).where(F.col("u") < F.col("prob")), docs.columns, {text: F.col("_text")})
