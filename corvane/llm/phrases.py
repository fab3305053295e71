"""Phrase collocation mining by contiguous pattern growth over projected occurrences.

Texts are cut into pieces and words in Arrow blocks of one language each.  Words found often enough are numbered exactly
(by language and spelling, no hashes), and each block gets the numbers of its own words only.  An occurrence of a frequent
word projects its suffix: the up to three frequent words behind it in its piece.  Equal suffixes of a block are counted
together, then all are dealt out in order, so that a prefix is one run of rows in one task; the task grows phrases to the
right depth-first, each prefix a pair of pointers into its rows.  A prefix with too many rows for a task goes over several
in order: what touches the edge of a task is passed on with its part of the count, however small, and parts are summed.

All parts of a frequent phrase are frequent, so every count that a cut needs is among the phrases found.  Products are
decimals of 38 digits.  The best of each language are picked in two steps, the first within 64 groups of it.

Defined cases: null text is empty; a null language is `und`, together with the language of that name; repeated rows count
each; a text longer than a block is a block of its own; ties are settled by the phrase's bytes; columns other than the two
named are passed over, whatever their names; an empty table gives an empty table.  There may be 2^31 - 1 frequent words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import textkit
from corvane.llm.shared import give_back, release_others, small_batches, stored

#: Bytes of text of one block, and of all unfinished blocks of a task.
BLOCK, HELD = 8 << 20, 32 << 20
#: Rows of suffixes in one task.
ROWS = 2_000_000
LONGEST, SALTS = 4, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_GAP = _ENDS.copy()
_GAP[list(b"\x20\x09")] = True
_LOW = (1 << 32) - 1


# --- words --------------------------------------------------------------------------------------------------------


def _block(lang: str, text: np.ndarray) -> dict | None:
    """Distinct words, their counts, and the words of the text as their places, 0 where a piece ends."""
    buf = _LOWER[text]
    gap = _GAP[buf]
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return None
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[~gap]))).dictionary_encode()
    place = words.indices.to_numpy().astype(np.int32) + 1
    piece = np.cumsum(_ENDS[buf], dtype=np.int32)[starts]
    broken = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    tokens = np.insert(place, broken, 0)
    return {"lang": lang, "n_words": len(starts), "words": words.dictionary, "counts": np.bincount(place)[1:], "tokens": zstandard.compress(tokens.astype("<i4").tobytes(), 3)}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    offs = np.concatenate([[0], np.cumsum([len(r["words"]) for r in rows])]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(offs), x) for x in (pa.concat_arrays([r["words"] for r in rows]), pa.array(np.concatenate([r["counts"] for r in rows]).astype(np.int64)))]
    plain = [pa.array([r[k] for r in rows], t) for k, t in (("lang", pa.string()), ("n_words", pa.int64()), ("tokens", pa.binary()))]
    return pa.RecordBatch.from_arrays([*plain, *lists], ["lang", "n_words", "tokens", "words", "counts"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one language; texts are parted by line ends, which end pieces."""
    release_others(__name__)
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}
    line_end = np.array([10], np.uint8)

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        size.pop(lang)
        row = _block(lang, np.concatenate(held.pop(lang)))
        if row:
            yield _batch([row])

    for batch in batches:
        buf, offs = textkit.flatten(batch.column(1))
        for i, lang in enumerate(batch.column(0).to_pylist()):
            text = buf[offs[i] : offs[i + 1]]
            if lang in size and size[lang] + len(text) > BLOCK:
                yield from flush(lang)
            held.setdefault(lang, []).extend((text.copy(), line_end))
            size[lang] = size.get(lang, 0) + len(text) + 1
            if size[lang] >= BLOCK:
                yield from flush(lang)
            elif sum(size.values()) > HELD:
                yield from flush(max(size, key=size.get))
    for lang in list(size):
        yield from flush(lang)
    give_back()


# --- suffixes and growth ------------------------------------------------------------------------------------------


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct suffixes of two to four frequent words and their counts in each block, numbers packed two by two."""
    for batch in batches:
        for k in range(batch.num_rows):
            tokens = np.frombuffer(zstandard.decompress(batch.column(1)[k].as_py()), "<i4")
            known = batch.column(2)[k].values
            number = np.zeros(int(tokens.max()) + 1, np.int64)
            number[known.field("pos").to_numpy() + 1] = known.field("id").to_numpy()
            ids = np.concatenate([number[tokens], np.zeros(LONGEST, np.int64)])
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            a, third = (ids[at] << 32) | ids[at + 1], ids[at + 2]
            b = (third << 32) | np.where(third > 0, ids[np.minimum(at + 3, len(ids) - 1)], 0)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(a)))
            a, b = a[first], b[first]
            for lo in range(0, len(a), 1 << 17):
                cut = slice(lo, lo + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(b[cut]), pa.array(n[cut]), pa.array(np.full(len(a[cut]), batch.column(0)[k].as_py()))], ["a", "b", "n", "block"])
    give_back()


def grow(a: np.ndarray, b: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of sorted suffixes with their counts: those found `least` times, and all that touch the first or last row."""
    words = [a >> 32, a & _LOW, b >> 32, b & _LOW]
    upto = np.concatenate([[0], np.cumsum(n)])
    out: list[tuple[int, int, int]] = []

    def extend(prefix: tuple[int, ...], lo: int, hi: int) -> None:
        depth = len(prefix)
        word = words[depth][lo:hi]
        starts = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        ends = np.append(starts[1:], hi - lo) + lo
        total = upto[ends] - upto[starts + lo]
        go = (word[starts] > 0) & ((total >= least) | (starts + lo == 0) | (ends == len(n)))
        for w, s, e, t in zip(word[starts[go]].tolist(), (starts[go] + lo).tolist(), ends[go].tolist(), total[go].tolist()):
            if depth:
                p = (*prefix, w, 0, 0)
                out.append(((p[0] << 32) | p[1], (p[2] << 32) | p[3], t))
            if depth < LONGEST - 1:
                extend((*prefix, w), s, e)

    if len(n):
        extend((), 0, len(n))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def _grow(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[x.to_numpy() for x in batch.columns[:3]] for batch in batches if batch.num_rows]
        if parts:
            a, b, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((b, a))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in grow(a[order], b[order], n[order], least)], ["a", "b", "n"])
        give_back()

    return run


# --- numbers, cuts and ranks --------------------------------------------------------------------------------------


def _numbered(frequent: DataFrame) -> DataFrame:
    """lang, word, n and a dense number from 1 for a table with `at` (partition and place); only a row a partition is collected."""
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, frequent.groupBy(part).count().collect()))
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total + 1))
        total += n
    if total >= 1 << 31:
        raise ValueError("more than 2^31 - 1 frequent words")
    small = frequent.sparkSession.createDataFrame(offsets, "part bigint, before bigint")
    return frequent.join(F.broadcast(small), part == F.col("part")).select("lang", "word", "n", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))


def _word(k: int) -> Column:
    """Number of word k of a phrase (from 0), 0 behind its end."""
    packed = F.col("ab"[k // 2])
    return F.shiftright(packed, 32) if k % 2 == 0 else packed.bitwiseAND(_LOW)


def _part(lo: int, hi: int) -> tuple[Column, Column]:
    """Key of the words lo to hi (exclusive)."""
    words = [_word(k) for k in range(lo, hi)] + [F.lit(0).cast("bigint")] * (LONGEST - hi + lo)
    return F.shiftleft(words[0], 32).bitwiseOR(words[1]), F.shiftleft(words[2], 32).bitwiseOR(words[3])


def _by_length(structs: dict[int, list[Column]]) -> Column:
    """The array for the phrase's own length (the shortest given, where that is less)."""
    shortest = min(structs)
    out = F.array(*structs[shortest])
    for m in range(shortest + 1, LONGEST + 1):
        out = F.when(_word(m - 1) > 0, F.array(*structs[m])).otherwise(out)
    return out


def _best(df: DataFrame, rank, top: int, *order: Column) -> DataFrame:
    """Rows of a rank up to `top` in each language: first within the groups of a hash, then among what they leave."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
    first = salted.withColumn("rank", rank().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= top)
    return first.withColumn("rank", rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("_salt")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, contained: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two to four words.

    a: occurrences of the phrase, l and r: of the two parts of its lowest-scoring cut, n: words of the language, score:
    floor(2000000 a / (l + r)).  A phrase inside a longer one with `contained` percent of its occurrences is left out.
    """
    small_batches(docs)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    blocks = stored(rows.mapInArrow(_blocks, "lang string, n_words bigint, tokens binary, words array<string>, counts array<bigint>").withColumn("block", F.monotonically_increasing_id()), "blocks")
    words = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("pos", "w")).select("lang", "block", "pos", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    numbered = stored(_numbered(stored(frequent.withColumn("at", F.monotonically_increasing_id()), "words")), "numbers")

    known = words.join(numbered.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("pos", "id")).alias("known"))
    suffixes = stored(blocks.select("block", "tokens").join(known, "block").mapInArrow(_suffixes, "a bigint, b bigint, n bigint, block bigint"), "suffixes")
    tasks = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), suffixes.count() // ROWS + 1)
    grown = suffixes.repartitionByRange(tasks, "a", "b", "block").mapInArrow(_grow(least), "a bigint, b bigint, n bigint")
    phrases = stored(grown.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "phrases")

    counts = phrases.unionByName(numbered.select(F.shiftleft("id", 32).alias("a"), F.lit(0).cast("bigint").alias("b"), "n"))
    cut = lambda m, k: F.struct(F.lit(k).alias("k"), *(x.alias(c) for x, c in zip((*_part(0, k), *_part(k, m)), ("la", "lb", "ra", "rb"))))
    cuts = phrases.select("a", "b", "n", F.explode(_by_length({m: [cut(m, k) for k in range(1, m)] for m in (2, 3, 4)})).alias("c")).select("a", "b", "n", "c.*")
    side = lambda x: counts.select(F.col("a").alias(x + "a"), F.col("b").alias(x + "b"), F.col("n").alias(x))
    both = cuts.join(side("l"), ["la", "lb"]).join(side("r"), ["ra", "rb"])
    score = F.expr("(cast(n as decimal(20, 0)) * 2000000BD) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = both.groupBy("a", "b", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("a", "b", "n", "s.score", "s.l", "s.r")

    inner = lambda m: [F.struct(*(x.alias(c) for x, c in zip(_part(lo, hi), "ab"))) for size in range(2, m) for lo in range(m - size + 1) for hi in [lo + size]]
    longer = phrases.where(_word(2) > 0).select("n", F.explode(_by_length({3: inner(3), 4: inner(4)})).alias("p")).groupBy("p.a", "p.b").agg(F.max("n").alias("longer"))
    left = scored.join(longer, ["a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < contained * F.col("n"))).drop("longer")

    names = numbered.select("id", "lang", "word")
    with_lang = left.withColumn("id", _word(0)).join(names.select("id", "lang"), "id").drop("id")
    near = stored(_best(with_lang, F.rank, top, F.desc("score"), F.desc("n")), "near")
    spelt = near.select("a", "b", F.posexplode(F.array(*(_word(k) for k in range(LONGEST)))).alias("pos", "id")).join(names.select("id", "word"), "id")
    phrase = spelt.groupBy("a", "b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word), " ").alias("phrase"))
    ranked = _best(near.join(phrase, ["a", "b"]), F.row_number, top, F.desc("score"), F.desc("n"), F.asc("phrase"))
    sizes = blocks.groupBy("lang").agg(F.sum("n_words").alias("total"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("bigint"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score")


def oracle_sql(least: int = 30, top: int = 2000, contained: int = 80) -> str:
    """The same rows in DuckDB."""
    return f"""WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]')) AS p FROM docs)),
    sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
    f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM (SELECT lang, w[i:i+m-1] AS p FROM places, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)) GROUP BY lang, p HAVING count(*) >= {least}),
    cand AS (SELECT lang, p, f AS a FROM f WHERE len(p) >= 2),
    cuts AS (SELECT c.lang, c.p, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f + r.f) AS score FROM (SELECT *, unnest(range(1, len(p))) AS k FROM cand) c
      JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k+1:len(c.p)]),
    lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    inside AS (SELECT lang, s, max(a) AS longer FROM (SELECT lang, a, p[lo:lo+m-1] AS s FROM (SELECT *, unnest(range(1, len(p))) AS lo FROM cand), (SELECT unnest([2, 3]) AS m) WHERE m < len(p) AND lo + m - 1 <= len(p)) GROUP BY lang, s),
    ranked AS (SELECT c.*, array_to_string(c.p, ' ') AS phrase, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, array_to_string(c.p, ' ')) AS rank
      FROM lowest c LEFT JOIN inside i ON i.lang = c.lang AND i.s = c.p WHERE longer IS NULL OR 100 * longer < {contained} * a)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {top}"""
