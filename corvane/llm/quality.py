"""Quality rules: per-document word rules, and cross-document line frequency.

Lines are normalised (outer spaces stripped, inner runs of spaces made one, A-Z lower-cased) and hashed.  For each host
the distinct document texts that hold a line are counted; lines above the limits are boilerplate.  The first
document of a line keeps it, all others lose it from their texts, and a document that keeps too few of its words is
rejected as depleted.

Defined cases: null text has no words and fails the word rules; a null host is the host ''; repeated rows and exact
copies count as one document, so copying alone never makes a line boilerplate; of documents with one id the first holds a
line in all their rows; texts and lines of any length are taken whole; a document at a limit keeps the line; an empty
table gives an empty table; input columns other than the id, host and text are passed over by `judge` and carried by
`keep_documents`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import textkit
from corvane.llm.shared import CALLER, shuffle_or_broadcast, stored, text_blocks, unwrapped, wrapped

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
MIN_WORDS, MAX_REPEATED_SHARE, WINDOW = 20, 30, 8

_LINES = "doc_id bigint, host string, text_hash bigint, lines array<struct<line: bigint, pos: int>>"
_STATS = "_n_words bigint, _word_chars bigint, _n_symbols bigint, _n_dup_lines bigint, _n_repeat_words bigint, _n_boilerplate_words bigint, _left string"


def repeated_words(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = WINDOW) -> np.ndarray:
    """Words of each row that lie in a window of `size` words found twice or more in that row."""
    at, value = textkit.windows(hashes, rows, size)
    if not len(at):
        return np.zeros(n_rows, np.int64)
    key = value ^ textkit.mix64(rows[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[at[twice]] += 1
    np.subtract.at(edge, at[twice] + size, 1)
    return np.bincount(rows, np.cumsum(edge[:-1]) > 0, n_rows).astype(np.int64)


def _line_words(buf: np.ndarray, offs: np.ndarray, starts: np.ndarray):
    """For each row, the bounds of its lines and the number of words in each."""
    breaks = np.flatnonzero(buf == 10)
    for i in range(len(offs) - 1):
        lo, hi = int(offs[i]), int(offs[i + 1])
        cuts = np.concatenate([[lo], breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)] + 1, [hi + 1]])
        yield cuts, np.diff(np.searchsorted(starts, np.minimum(cuts, hi)))  # a word of the next row may begin at hi


def _lines_block(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    """The hash and place of every line that has words."""
    starts, *_ = textkit.words(buf, offs)
    data, ends, lines, places = buf.tobytes(), np.zeros(len(offs), np.int64), [], []
    for i, (cuts, words) in enumerate(_line_words(buf, offs, starts)):
        for k in np.flatnonzero(words).tolist():
            lines.append(xxhash.xxh64_intdigest(b" ".join(data[cuts[k] : cuts[k + 1] - 1].lower().split())))
            places.append(k)
        ends[i + 1] = len(lines)
    line_column = pa.StructArray.from_arrays([pa.array(np.array(lines, np.uint64).view(np.int64)), pa.array(np.array(places, np.int32))], ["line", "pos"])
    return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), line_column)], ["doc_id", "host", "text_hash", "lines"])


def _stats_block(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    """The other columns, the figures of the word rules, and the text without the lines listed in `_drop`."""
    n = len(offs) - 1
    starts, _, at, hashes = textkit.words(buf, offs)
    dups, lost, changed = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
    data, drops = buf.tobytes(), rows.column(rows.schema.get_field_index("_drop")).to_pylist()
    for i, (cuts, words) in enumerate(_line_words(buf, offs, starts)):
        full = [data[cuts[k] : cuts[k + 1] - 1] for k in np.flatnonzero(words).tolist()]
        dups[i] = len(full) - len(set(full))
        if drops[i] is not None:
            drop = np.array(drops[i].split(","), np.int64)
            lost[i] = words[drop].sum()
            keep = np.ones(len(words), bool)
            keep[drop] = False
            changed[i] = b"\n".join([data[cuts[k] : cuts[k + 1] - 1] for k in np.flatnonzero(keep).tolist()]).decode()
    left = rows.column(rows.schema.get_field_index("_text"))
    if changed:
        left = pa.array([changed.get(i, x) for i, x in enumerate(left.to_pylist())], pa.string())
    others = [x for x in rows.schema.names if x not in ("_text", "_drop")]
    return pa.RecordBatch.from_arrays(
        [
            *(rows.column(rows.schema.get_field_index(x)) for x in others),
            pa.array(np.bincount(at, minlength=n).astype(np.int64)),
            pa.array(textkit.code_points_in_words(buf, offs)),
            pa.array(textkit.per_row(_IS_SYMBOL[buf], offs)),
            pa.array(dups),
            pa.array(repeated_words(hashes, at, n)),
            pa.array(lost),
            left,
        ],
        [*others, "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_n_boilerplate_words", "_left"],
    )


def boilerplate(
    docs: DataFrame, *, doc_id: str = "doc_id", host: str = "source", text: str = "text",
    min_documents: int = 20, min_share: float = 0.01, max_documents: int = 200,
) -> DataFrame:
    """_id, _host, _hash and _drop (numbers of the lines to remove) of each text that loses a line.

    A line, of any length, is above the limits of its host if it is in more than `min_documents` distinct texts, and in
    more than `min_share` of the host's distinct texts or more than `max_documents`, so that no host is too large.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    table = stored(rows.mapInArrow(text_blocks(_lines_block, "text"), _LINES), "quality")
    lines = table.select("doc_id", "host", "text_hash", F.inline("lines"))
    # Both counts are two-step aggregates: a hot line or host is first reduced within each map task.
    hosts = table.groupBy("host").agg(F.count_distinct("text_hash").alias("texts"))
    frequent = stored(
        lines.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("n"), F.min("doc_id").alias("first_doc"))
        .where(F.col("n") > min_documents).join(hosts, "host").where((F.col("n") > F.col("texts") * min_share) | (F.col("n") > max_documents)).select("host", "line", "first_doc"), "frequent")
    lost = lines.join(shuffle_or_broadcast(frequent), ["host", "line"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    places = F.array_join(F.collect_set("pos").cast("array<string>"), ",")
    return lost.groupBy(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_hash").alias("_hash")).agg(places.alias("_drop"))


def _judged(docs: DataFrame, *, doc_id: str = "doc_id", host: str = "source", text: str = "text", min_words_left: float = 0.3, **limits) -> DataFrame:
    """The caller's columns wrapped, _doc, _source, the figures, `_failed`, `_kept`, and `_left`: the text without the lines above the limits."""
    drops = shuffle_or_broadcast(stored(boilerplate(docs, doc_id=doc_id, host=host, text=text, **limits), "boilerplate"))
    rows = wrapped(docs, text, F.col(doc_id).cast("bigint").alias("_doc"), F.coalesce(F.col(host), F.lit("")).alias("_source"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_hash")) & (F.col("_source") == F.col("_host"))
    joined = rows.join(drops, same, "left").select(CALLER, "_doc", "_source", "_text", "_drop")
    schema = T.StructType([*joined.select(CALLER, "_doc", "_source").schema.fields, *T.StructType.fromDDL(_STATS).fields])
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEATED_SHARE * F.col("_n_words"))
    depleted = (F.col("_n_words") - F.col("_n_boilerplate_words")) < min_words_left * F.col("_n_words")
    return joined.mapInArrow(text_blocks(_stats_block, "_text"), schema).withColumns({"_failed": failed, "_kept": ~failed & ~depleted})


def judge(docs: DataFrame, **options) -> DataFrame:
    """One row for each input row: the word rules' figures, the words lost to boilerplate lines, the verdict, and `left_text`.

    `left_text` is the text without the lines above the limits (see `boilerplate`).  A document is depleted if less than
    `min_words_left` of its words are outside such lines.
    """
    out = _judged(docs, **options)
    figures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words")
    return out.select(F.col("_doc").alias("doc_id"), F.col("_source").alias("host"), *(F.col("_" + c).alias(c) for c in figures), F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.col("_left").alias("left_text"))


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The input rows that `judge` keeps, with all their columns and without their lines above the limits."""
    text = options.get("text", "text")
    kept = _judged(docs, **options).where("_kept")
    changed = {text: F.col("_left")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_n_boilerplate_words") > 0, F.length("_left")).otherwise(F.col(CALLER).getField("n_chars")).cast(docs.schema["n_chars"].dataType)
    return unwrapped(kept, docs.columns, changed)
