"""Line deduplication by range-partitioned hashes, returning compressed keep bitmaps.

Line hashes are range-partitioned and sorted by (hash, document descending, text, position); each partition is streamed
once and all lines of a repeated key but those of its first document are dropped.  The range is over the whole sort key,
so that a hot line is split over many partitions; groups at the edge of a partition may go on in the next one, so their
lines are passed on and settled by an aggregate of at most two keys for each partition.

Defined cases: a null or empty text is one empty line; a null doc_id sorts as the smallest id; rows that repeat an id are
one document when documents are counted, and each gets its own bitmap by its text; rows with one id and one text share
a bitmap; texts and lines of any length are taken whole; `keep_lines` carries all columns, whatever their names; an empty
table gives an empty table.  A line's key is held as two 64-bit hashes, so that different lines are not taken for one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.shared import CALLER, shuffle_or_broadcast, stored, text_blocks, unwrapped, wrapped
from corvane.llm.textkit import SPACE

NO_ID = -(1 << 63)
_LINES = "line bigint, check bigint, doc bigint, text_hash bigint, pos int, n_lines int"
NAMES = ["line", "check", "doc", "text_hash", "pos", "n_lines"]


def line_rows(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, min_chars: int) -> pa.RecordBatch:
    """Hash and place of every line whose key has at least `min_chars` code points."""
    data, docs, texts = buf.tobytes(), rows.column(0).to_numpy(), rows.column(1).to_numpy()
    out: list[list] = [[], [], [], [], [], []]
    for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        lines = data[lo:hi].split(b"\n")
        for pos, line in enumerate(lines):
            if len(line) < min_chars:
                continue
            key = line.strip(SPACE)
            if len(key) >= min_chars and len(key.decode()) >= min_chars:
                both = xxhash.xxh3_128_intdigest(key.lower())
                out[0].append(both >> 64)
                out[1].append(both & 0xFFFFFFFFFFFFFFFF)
                out[2].append(docs[i])
                out[3].append(texts[i])
                out[4].append(pos)
                out[5].append(len(lines))
    kinds = (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32)
    arrays = [np.array(x, k) for x, k in zip(out, kinds)]
    arrays[:2] = [a.view(np.int64) for a in arrays[:2]]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], NAMES)


def _stream(min_documents: int):
    """For mapInArrow over sorted partitions: the lines to drop (open = false), and the lines of edge groups (open = true)."""
    def settle(cols: list[np.ndarray]) -> pa.RecordBatch:
        """Whole groups, sorted: keeps lines of the first document of each group, drops the others of repeated groups."""
        line, check, doc = cols[:3]
        first = np.concatenate([[True], (line[1:] != line[:-1]) | (check[1:] != check[:-1])])
        fresh = first | np.concatenate([[True], doc[1:] != doc[:-1]])
        group = np.cumsum(first) - 1
        documents = np.bincount(group, fresh)
        drop = (documents[group] >= min_documents) & (doc != doc[first][group])
        return emit([c[drop] for c in cols], False)

    def emit(cols: list[np.ndarray], is_open: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(np.full(len(cols[0]), is_open))], [*NAMES, "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge, held = None, []  # the partition's first key; lines of the latest group
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(6)]
            line = cols[0]
            if edge is None:
                edge = line[0]
            n = int(np.searchsorted(line, edge, "right"))
            if n:
                yield emit([c[:n] for c in cols], True)
            cols = [c[n:] for c in cols]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last or (held and held[0][0][0] != cols[0][0]):
                done = [*held, [c[:last] for c in cols]]
                yield settle([np.concatenate([h[k] for h in done]) for k in range(6)])
                held = []
            held.append([c[last:] for c in cols])
        for h in held:
            yield emit(h, True)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for n, dropped in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            keep = np.ones(n, np.uint8)
            keep[dropped] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) for x in batch.column(3).to_pylist()], pa.int32()), pa.array(maps, pa.binary())], ["doc", "text_hash", "n_lines", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_documents: int = 3) -> DataFrame:
    """doc, text_hash, n_lines, n_dropped, keep_bitmap (zlib of bits, first line first) of each document that loses a line.

    Documents that are not listed keep all lines.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    lines = stored(rows.mapInArrow(text_blocks(lambda r, b, o: line_rows(r, b, o, min_chars), "text"), _LINES), "lines")
    order = [F.col("line"), F.col("check"), F.col("doc").desc(), F.col("text_hash"), F.col("pos")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(_stream(min_documents), _LINES + ", open boolean"), "line-drops")
    edges = found.where("open").groupBy("line", "check").agg(F.max("doc").alias("keeper"), F.count_distinct("doc").alias("n")).where(F.col("n") >= min_documents)
    late = found.where("open").join(F.broadcast(edges), ["line", "check"]).where(F.col("doc") != F.col("keeper"))  # at most two keys a partition
    names = ["doc", "text_hash", "pos", "n_lines"]
    dropped = found.where("NOT open").select(names).unionAll(late.select(names)).groupBy("doc", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return dropped.select("doc", "text_hash", "n_lines", "dropped").mapInArrow(_bitmaps, "doc bigint, text_hash bigint, n_lines int, n_dropped int, keep_bitmap binary")


def _apply(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    """The caller's columns, the text that is left, its lines before and the number of lines dropped."""
    data, texts, total, lost = buf.tobytes(), [], [], []
    maps = rows.column(rows.schema.get_field_index("_bitmap")).to_pylist()
    for lo, hi, packed in zip(offs[:-1].tolist(), offs[1:].tolist(), maps):
        if packed is None:
            texts.append(data[lo:hi])
            total.append(data.count(b"\n", lo, hi) + 1)
            lost.append(0)
        else:
            lines = data[lo:hi].split(b"\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: len(lines)]
            texts.append(b"\n".join([x for x, k in zip(lines, keep.tolist()) if k]))
            total.append(len(lines))
            lost.append(int(len(lines) - keep.sum()))
    made = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())]
    return pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index(CALLER)), *made], [CALLER, "_kept", "_n_lines", "_n_dropped"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents' other columns as one struct (see `unwrapped`), _kept (the text without the dropped lines), _n_lines and _n_dropped."""
    maps = shuffle_or_broadcast(stored(bitmaps.select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("keep_bitmap").alias("_bitmap")), "bitmaps"))
    rows = wrapped(docs, text, F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("_id"))
    joined = rows.join(maps, (F.col("_id") == F.col("_doc")) & (F.xxhash64("_text") == F.col("_hash")), "left").select(CALLER, "_text", "_bitmap")
    schema = T.StructType([*joined.select(CALLER).schema.fields, *T.StructType.fromDDL("_kept string, _n_lines bigint, _n_dropped bigint").fields])
    return joined.mapInArrow(text_blocks(_apply, "_text"), schema)


def keep_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The input rows with all their columns, and without the lines that `keep_bitmaps` drops."""
    kept = apply_bitmaps(docs, keep_bitmaps(docs, doc_id=doc_id, text=text, **options), doc_id=doc_id, text=text)
    changed = {text: F.col("_kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_kept").cast(docs.schema["n_chars"].dataType)
    return unwrapped(kept, docs.columns, changed)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the hash of the text that is left."""
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(F.col(CALLER).getField("doc_id").alias("doc_id"), F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))
