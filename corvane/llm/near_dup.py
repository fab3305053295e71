"""Near-duplicate documents by ProbMinHash on weighted word shingles, banding and exact verification.

Each distinct five-word shingle of a document arrives as a Poisson process whose rate is its count; every arrival hits a
random register, which keeps the element of its first arrival.  An element stops as soon as its arrivals come later than
the latest register, so most elements are drawn once.  Two documents agree in a register with their probability Jaccard
similarity J_P (the plain Jaccard similarity where no shingle repeats).  Bands of registers give buckets; J_P itself
is then computed from the texts of a pair, with 64-bit shingles and whole counts.

Within a bucket not all pairs are listed.  First every text is compared with one leader: the leader of a bucket is its
member with the most company in all its buckets (the text that the variants of a group come from), and a text takes the
leader that it meets most often.  This joins most groups at n comparisons.  Buckets that still hold several classes are
settled by a prefix join over the shingles of their members, ordered from rare to frequent: of two linked texts, take
the rarest shingle they share.  Two texts without repeated shingles, of m <= n shingles, i and j of them rarer, are
linked at t only if m - i and n - j are both t / (1 + t) * (m + n) at least.  For any two texts, with P and Q the shares
of their weights that lie on common shingles, 1 / J_P >= 1 / P + 1 / Q - 1, so that the weights a and b of what is rarer
hold 1 / (1 - a) + 1 / (1 - b) <= 1 / t + 1.  Only such pairs of different classes are compared; a text that has over
1 - t of its weight to itself is in none.  Variants of one text share their rarest common shingles and yet differ in too
many others; for texts without repeated shingles a bitmap tells: its bits are the parities of the shingles that hash to
them, so two bitmaps differ in no more bits than the texts do in shingles, of which links allow (1 - t) / (1 + t) * (m + n).  No link between members of a bucket is lost.  Classes are the connected
components of the links, by hooking and pointer jumping on joins.

Defined cases: null text is empty; texts with fewer than five words are one shingle of all their words; texts without a
word are in a class with exact copies only; exact copies share one representative and are never compared, at any length;
null ids are kept apart by row; repeated rows are copies of each other; ties go to the smallest id; an empty table gives
an empty table; `keep_documents` returns all input columns, whatever their names; a carried column that has the name of
an output of `near_duplicates` gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import textkit
from corvane.llm.shared import CALLER, discard, shuffle_or_broadcast, stored, text_blocks, unwrapped, wrapped

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6  # a pair at 0.8 is missed by all bands with probability 6e-5
_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles, sorted by row and hash."""
    at, value = textkit.windows(hashes, rows, size)
    row = rows[at]
    count = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        parts = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            have = count[short] > k
            parts[have] += hashes[begin[short[have]] + k] * _U(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
        row, value = np.concatenate([row, short]), np.concatenate([value, textkit.mix64(parts)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    if not len(row):
        return row, value, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])]))
    return row[first], value[first], np.diff(np.append(first, len(row)))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """The element in each of m registers of each row; rows without elements keep zeros."""
    when = np.full(n_rows * m, np.inf)
    who = np.zeros(n_rows * m, np.uint64)
    last = np.full(n_rows, np.inf)
    time, rate, drawn = np.zeros(len(row)), weight.astype(float), 0
    while len(row):
        steps = max(1, min(256, 200_000 // len(row))) if drawn else 1
        k = np.arange(drawn + 1, drawn + steps + 1, dtype=np.uint64) * _GOLDEN
        x = textkit.mix64(element[:, None] + k[None, :])
        gap = -np.log(((x >> _U(11)).astype(float) + 0.5) / (1 << 53)) / rate[:, None]
        arrival = time[:, None] + np.cumsum(gap, axis=1)
        slot = row[:, None] * m + (textkit.mix64(x) % _U(m)).astype(np.int64)
        i, j = np.nonzero(arrival < when[slot])
        t, s = arrival[i, j], slot[i, j]
        order = np.argsort(-t, kind="stable")  # of arrivals at one register the first is written last
        when[s[order]], who[s[order]] = t[order], element[i[order]]
        last = when.reshape(n_rows, m).max(axis=1)
        time, drawn = arrival[:, -1], drawn + steps
        going = time < last[row]
        row, element, rate, time = row[going], element[going], rate[going], time[going]
    return who.reshape(n_rows, m)


def bands_of(who: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of registers."""
    n = len(who)
    part = who.reshape(n, bands, -1)
    out = np.zeros((n, bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
    for k in range(part.shape[2]):
        out = textkit.mix64(out ^ part[:, :, k])
    return out.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets with sorted keys."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = b[at] == a
    if not both.any():
        return 0.0
    x, y = wa[both].astype(float), wb[at[both]].astype(float)
    if (x == 1).all() and (y == 1).all() and wa.max() == 1 and wb.max() == 1:
        return len(x) / (len(a) + len(b) - len(x))
    # sum over j of max(x_j / x_i, y_j / y_i): x counts where y_j / x_j <= y_i / x_i, y elsewhere
    ratio, x_all, y_all = y / x, float(wa.sum()), float(wb.sum())
    order = np.argsort(ratio, kind="stable")
    r = ratio[order]
    upto = np.searchsorted(r, r, "right")
    cx, cy = np.concatenate([[0], np.cumsum(x[order])]), np.concatenate([[0], np.cumsum(y[order])])
    below = (x_all - x.sum() + cx[upto]) / x[order]
    above = (y_all - y.sum() + cy[-1] - cy[upto]) / y[order]
    return float((1 / (below + above)).sum())


def _features(docs: DataFrame) -> DataFrame:
    """The given columns (with _text) and _bands."""
    names = docs.columns

    def block(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        n = len(offs) - 1
        _, _, at, hashes = textkit.words(buf, offs, lower=True)
        row, value, count = shingles(hashes, at, n)
        bands = bands_of(signatures(row, value, count, n, BANDS * ROWS))
        filled = np.bincount(row, minlength=n) > 0
        ends = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[filled].ravel()))], [*names, "_bands"])

    schema = T.StructType([*docs.schema.fields, T.StructField("_bands", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(text_blocks(block, "_text", 2 << 20), schema)


def _sketches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles and counts of each text, some megabytes at a time."""
    buf, offs = textkit.flatten(texts)
    for lo, hi in textkit.blocks(offs, 2 << 20):
        _, _, at, hashes = textkit.words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lower=True)
        row, value, count = shingles(hashes, at, hi - lo)
        cuts = np.searchsorted(row, np.arange(hi - lo + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield value[a:b], count[a:b]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over node, leader, text, l_text: the similarity of each pair."""
    for batch in batches:
        if batch.num_rows:
            _, first, of = np.unique(batch.column(1).to_numpy(), return_index=True, return_inverse=True)
            leaders = list(_sketches(batch.column(3).take(pa.array(first))))
            sims = [similarity(*mine, *leaders[k]) for mine, k in zip(_sketches(batch.column(2)), of.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], ["node", "leader", "sim"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over node, text: every distinct shingle, its share of the text's weight, and the number of shingles, negative if some repeat."""
    for batch in batches:
        for node, (value, count) in zip(batch.column(0).to_pylist(), _sketches(batch.column(1))):
            if len(value):
                size = len(value) if count.max() == 1 else -len(value)
                columns = [np.full(len(value), node), value.view(np.int64), count / count.sum(), np.full(len(value), size)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "token", "mass", "size"])


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node of each node's component.  labels: node, label (a start, smaller or equal); links: a, b.

    Each step hooks labels to the smallest label among the neighbours and then halves the paths; all by equi-joins and
    partial aggregates, so a node with very many links is split like any skewed key.
    """
    edges = stored(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    while True:
        of = labels.select(F.col("node").alias("b"), F.col("label").alias("got"))
        near = edges.join(of, "b").groupBy("a").agg(F.min("got").alias("got"))
        hooks = near.join(labels, F.col("a") == F.col("node")).where(F.col("got") < F.col("label"))
        moved = stored(hooks.select(F.col("label").alias("node"), "got").unionAll(hooks.select("node", "got")).groupBy("node").agg(F.min("got").alias("got")), "hooks")
        if moved.limit(1).count() == 0:
            discard(edges, moved)
            return labels
        lower = stored(labels.join(moved, "node", "left").select("node", F.least("label", F.coalesce("got", "label")).alias("label")), "labels")
        discard(labels, moved)
        for _ in range(2):
            up = lower.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = stored(lower.join(up, "label").select("node", F.col("top").alias("label")), "labels")
            discard(lower)
            lower = labels


def _merge(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after linking: only links between different labels count, and only these labels are a graph."""
    label = lambda n: labels.select(F.col("node").alias(n), F.col("label").alias(f"{n}_label"))
    crossing = links.join(label("node"), "node").join(label("leader"), "leader").where("node_label <> leader_label")
    crossing = stored(crossing.select(F.col("node_label").alias("a"), F.col("leader_label").alias("b")).distinct(), "crossing")
    if crossing.limit(1).count() == 0:
        discard(crossing)
        return labels
    ends = stored(crossing.select(F.col("a").alias("node")).unionAll(crossing.select("b")).distinct().select("node", F.col("node").alias("label")), "ends")
    found = components(ends, crossing)
    top = found.select(F.col("node").alias("label"), F.col("label").alias("top"))
    merged = stored(labels.join(top, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
    discard(crossing, ends, found, labels)
    return merged


def _linked(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The stored pairs (node, leader) whose texts are alike.  A text travels once for each of its pairs as `node`; as leader, once."""
    ends = stored(pairs.select("leader").distinct(), "leaders")
    mine = texts.join(shuffle_or_broadcast(pairs), "node")
    theirs = texts.select(F.col("node").alias("leader"), F.col("text").alias("l_text")).join(shuffle_or_broadcast(ends), "leader", "left_semi")
    both = mine.join(theirs, "leader").select("node", "leader", "text", "l_text")
    links = stored(both.mapInArrow(_verify, "node bigint, leader bigint, sim double").where(F.col("sim") >= threshold).select("node", "leader"), "links")
    discard(ends)
    return links


def _star_pairs(active: DataFrame) -> DataFrame:
    """node, leader: each text and the leader it meets in most of its buckets.  active (stored): bucket, node, n (members)."""
    company = active.groupBy("node").agg(F.sum("n").alias("company"))
    lead = active.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("last"))).alias("top"))
    led = active.join(lead.select("bucket", (-F.col("top.last")).alias("leader")), "bucket").where("node <> leader")
    meetings = led.groupBy("node", "leader").agg(F.count("*").alias("n"))
    return meetings.groupBy("node").agg(F.max(F.struct("n", (-F.col("leader")).alias("last"))).alias("top")).select("node", (-F.col("top.last")).alias("leader"))


#: Steps of the logarithm of sizes, and steps that the admissible weights before a shared shingle are divided into.
SIZE_STEP, LEVELS, _EPS = 0.02, 8, 1e-6

#: Longs of the bitmap of a text's shingles.
WORDS = 16


def _bitmaps(tokens: DataFrame) -> DataFrame:
    """node, s0, s1, ...: the parity of the tokens that hash to each bit.  tokens: node, token (distinct)."""
    bit, word = F.expr("shiftleft(1L, cast(pmod(token, 64) AS int))"), F.pmod(F.shiftrightunsigned("token", 6), F.lit(WORDS))
    return tokens.groupBy("node").agg(*(F.bit_xor(F.when(word == k, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"s{k}") for k in range(WORDS)))


def _met(xs: DataFrame, ys: DataFrame, key: list[str], feasible: Column) -> DataFrame:
    """node, other: pairs of different labels with one key.  xs: key, node, label, a, size; ys: key, other, l_label, b, l_size."""
    counted = xs.select(*key, "label").unionAll(ys.select(*key, "l_label")).groupBy(*key, "label").agg(F.count("*").alias("n"))
    cells = counted.groupBy(*key).agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).where("labels > 1")
    # Cells of one class have no pairs.  The members of a cell's largest class meet only the others, not each other.
    cells = shuffle_or_broadcast(stored(cells.select(*key, F.col("top.label").alias("big")), "cells"))
    left = xs.join(cells, key).withColumn("big", F.col("label") == F.col("big"))
    sides = F.when(F.col("l_label") == F.col("big"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    right = ys.join(cells, key).withColumn("big", F.explode(sides))
    return left.join(right, [*key, "big"]).where((F.col("label") != F.col("l_label")) & feasible).select("node", "other")


def _prefix_pairs(texts: DataFrame, rest: DataFrame, threshold: float) -> DataFrame:
    """node, leader: all pairs of different labels in `rest` (stored: node, label) that may be alike by their prefixes."""
    tokens = stored(texts.join(shuffle_or_broadcast(rest.select("node")), "node", "left_semi").mapInArrow(_tokens, "node bigint, token bigint, mass double, size bigint"), "tokens")
    # Shingles of the same texts (neighbours in a shared passage) come in the same order in all of them, so that the first one
    # bounds a pair least: it alone has to be met.  Texts are told apart by 128 bits of their hashes.
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"m{k}") for k in (1, 2)]
    common = stored(tokens.groupBy("token").agg(F.count("*").alias("df"), *marks).where("df > 1"), "common")
    heads = common.groupBy("df", "m1", "m2").agg(F.min("token").alias("token")).select("token", F.lit(True).alias("head"))
    common = common.select("token", "df").join(heads, "token", "left")
    by_node, spread = W.partitionBy("node"), 1 / threshold - 1
    before = F.coalesce(F.sum("mass").over(by_node.orderBy("df", "token").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    # `left`: the weight from this shingle on; before it are the shingles of no other text, then the common ones in order
    placed = tokens.join(common, "token").select("node", "token", "size", "head", (F.sum("mass").over(by_node) - before).alias("left")).where(F.col("head") & (F.col("left") >= threshold - _EPS))
    bits = [f"s{k}" for k in range(WORDS)]
    placed = placed.join(rest, "node").join(_bitmaps(tokens), "node")
    table = entries = stored(placed.select("token", "node", "label", "size", (1 - F.col("left")).alias("a"), *bits), "prefixes")
    discard(tokens)
    other = lambda df: df.withColumnsRenamed({"node": "other", "label": "l_label", "a": "b", "size": "l_size", **{c: f"l_{c}" for c in bits}})
    # Both without repeated shingles: the smaller one (on the left) and the larger one bound each other's sizes
    plain, need = entries.where("size > 0"), threshold / (1 + threshold)
    log_size = lambda c: F.floor(F.log(c) / SIZE_STEP).cast("int")
    smaller = plain.where(F.col("a") <= 1 - 2 * need + _EPS).withColumn("cell", log_size(F.col("size").cast("double")))
    most = F.least(F.lit(1.0), (1 - F.col("a")) / need - 1 + _EPS) * F.col("size")
    larger = plain.withColumn("cell", F.explode(F.sequence(log_size(F.col("size") * (threshold - _EPS)), F.greatest(log_size(most), log_size(F.col("size") * (threshold - _EPS))))))
    shared = F.least(F.col("size") * (1 - F.col("a")), F.col("l_size") * (1 - F.col("b")))
    both = F.col("size") + F.col("l_size")
    differ = reduce(add, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"l_{c}"))) for c in bits))
    sets = _met(smaller, other(larger), ["token", "cell"], (F.col("size") <= F.col("l_size")) & (shared >= need * both - 1e-3) & (differ <= (1 - 2 * need) * both + 1e-3))
    # Else: `u` = 1 / (1 - a) - 1, of which one is at most half of the spread, goes by levels
    step, u = spread / 2 / LEVELS, 1 / (1 - F.col("a")) - 1
    heavy, entries = F.col("size") < 0, entries.drop(*bits)
    xs = entries.where(u <= spread / 2 + _EPS).withColumns({"cell": F.greatest(F.floor(u / step - _EPS), F.lit(0)).cast("int"), "kind": heavy})
    upto = F.greatest(F.least(F.floor((spread - u) / step + _EPS), F.lit(LEVELS)), F.lit(0)).cast("int")
    kinds = F.when(heavy, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    ys = entries.where(u <= spread + _EPS).withColumn("cell", F.explode(F.sequence(F.lit(0), upto))).withColumn("kind", F.explode(kinds))
    some = _met(xs, other(ys), ["token", "cell", "kind"], 1 / (1 - F.col("a")) + 1 / (1 - F.col("b")) <= spread + 2 + _EPS)
    met = sets.unionAll(some) if entries.where("size < 0").limit(1).count() else sets
    pairs = stored(met.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("leader")).distinct(), "pairs")
    discard(table)
    return pairs


def classes(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, label for every node that shares a bucket with another.  nodes: node, text, _bands; read several times."""
    members = nodes.select("node", F.explode("_bands").alias("bucket"))
    shared = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    active = stored(members.join(shuffle_or_broadcast(shared), "bucket"), "active")
    discard(shared)
    texts = nodes.select("node", "text")
    labels = stored(active.select("node").distinct().select("node", F.col("node").alias("label")), "labels")
    stars = stored(_star_pairs(active), "stars")
    links = _linked(texts, stars, threshold)
    labels = _merge(labels, links)
    discard(stars, links)
    placed = stored(active.join(labels, "node").select("bucket", "node", "label"), "placed")
    discard(active)
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    rest = stored(placed.join(mixed, "bucket").select("node", "label").distinct(), "rest")
    discard(placed)
    pairs = _prefix_pairs(texts, rest, threshold)
    links = _linked(texts, pairs, threshold)
    labels = _merge(labels, links)
    discard(rest, pairs, links)
    return labels


def _classified(docs: DataFrame, doc_id: str, text: str, keep: list[str], threshold: float) -> DataFrame:
    """The caller's columns wrapped, _text, _id, and class_id, class_size and stays."""
    base = wrapped(docs, text, F.col(doc_id).alias("_id"), keep=keep).withColumn("_text", F.coalesce("_text", F.lit("")))
    base = base.withColumn("_h1", F.xxhash64("_text")).withColumn("_h2", F.xxhash64(F.lit(7), "_text"))
    table = stored(_features(base).withColumn("_row", F.monotonically_increasing_id()), "features")
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("first")
    copies = stored(table.groupBy("_h1", "_h2").agg(first, F.count("*").alias("copies")).select("_h1", "_h2", "copies", F.col("first.row").alias("node"), F.col("first.id").alias("id")), "texts")
    wanted = shuffle_or_broadcast(copies.select("node"))
    nodes = table.select(F.col("_row").alias("node"), F.col("_text").alias("text"), "_bands").join(wanted, "node", "left_semi")
    labels = classes(nodes, threshold)
    labelled = stored(copies.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    discard(copies, labels)
    groups = labelled.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("node").alias("row"))).alias("first"), F.sum("copies").alias("class_size"))
    groups = groups.select("label", F.col("first.id").alias("class_id"), F.col("first.row").alias("stay_row"), "class_size")
    verdict = stored(labelled.select("_h1", "_h2", "label").join(groups, "label").select("_h1", "_h2", "class_id", "stay_row", "class_size"), "verdicts")
    discard(labelled)
    return table.drop("_bands").join(shuffle_or_broadcast(verdict), ["_h1", "_h2"]).withColumn("stays", F.col("_row") == F.col("stay_row"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Every row's id and carried columns with class_id (smallest id of its class), class_size (rows) and stays (one row of each class)."""
    made = ["class_id", "class_size", "stays"]
    own = [c for c in dict.fromkeys([doc_id, *carry]) if c not in made and c != text]
    out = _classified(docs, doc_id, text, own, threshold)
    return out.select(*(F.col(CALLER).getField(c).alias(c) for c in own), *([F.col("_text").alias(text)] if text in carry else []), *made)


def keep_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns (null text comes back as empty)."""
    kept = _classified(docs, doc_id, text, docs.columns, threshold).where("stays")
    return unwrapped(kept, docs.columns, {text: F.col("_text")})
