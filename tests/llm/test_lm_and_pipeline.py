import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import lm_trie, textkit
from tests.llm.fixtures import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_elias_fano_round_trip_and_search():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 70_000):
        for high in (5, 1 << 20, 1 << 63):
            values = np.sort(rng.integers(0, high, n, dtype=np.uint64))
            ef = lm_trie.EliasFano(np.frombuffer(lm_trie.ef_encode(values), np.uint8))
            assert (ef.all() == values).all()
            distinct = np.unique(values)
            ef = lm_trie.EliasFano(np.frombuffer(lm_trie.ef_encode(distinct), np.uint8))
            asked = np.concatenate([distinct[:500], rng.integers(0, high, 200, dtype=np.uint64)])
            place = {int(v): i for i, v in enumerate(distinct)}
            assert ef.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
    dense = np.arange(100_000, dtype=np.uint64) * np.uint64(977)
    assert len(lm_trie.ef_encode(dense)) < 100_000 * (2 + math.log2(977) + 1) / 8  # bits a number


def test_trie_against_dictionaries(tmp_path):
    rng = np.random.default_rng(2)
    keys, n = np.unique(rng.integers(0, 1 << 40, 3000, dtype=np.uint64)), rng.integers(1, 900, 3000)
    parent, words = np.divmod(np.unique(rng.integers(0, len(keys) * 500, 20_000)), 500)
    counts, spread = rng.integers(1, 90, len(parent)), np.unique(rng.integers(0, 1 << 30, 500, dtype=np.uint64))
    part = lm_trie.Trie.build((keys, n[: len(keys)]), parent, words.astype(np.uint64), counts, (spread, np.arange(1, len(spread) + 1)), 20)
    (tmp_path / "trie").write_bytes(part)
    have = {(int(keys[p]), int(w)): c for p, w, c in zip(parent, words, counts)}
    asked = np.unique(np.concatenate([keys[::3], rng.integers(0, 1 << 40, 500, dtype=np.uint64)]))
    wanted = [np.unique(rng.integers(0, 600, 7)) for _ in asked]
    blob = lm_trie.join_parts([lm_trie.ef_encode(asked), lm_trie.pack_counts(np.array([len(w) for w in wanted])), lm_trie.pack_bits(np.concatenate(wanted).astype(np.uint64), 20), lm_trie.ef_encode(spread[::2]), lm_trie.pack_counts(np.zeros(0, np.int64))])
    for trie in (lm_trie.Trie(part), lm_trie.Trie.open(str(tmp_path / "trie"))):
        codes = trie.look_up(lm_trie.Ask(blob, 20))
        single = dict(zip(keys.tolist(), n.tolist()))
        want = [single.get(k, 0) for k in asked.tolist()] + [have.get((k, w), 0) for k, ws in zip(asked.tolist(), wanted) for w in ws.tolist()] + list(range(1, len(spread) + 1, 2))
        assert ((codes == 0) == (np.array(want) == 0)).all() and np.allclose(lm_trie.COUNTS[codes], want, rtol=0.062)
        small = np.array(want) <= lm_trie.EXACT
        assert (lm_trie.COUNTS[codes][small] == np.array(want)[small]).all()
    bits = 40 - math.log2(len(keys)) + 3 + 8
    assert len(part) * 8 < len(keys) * (bits + 8) + len(parent) * (20 + 8) + 30_000  # pointers, codes, and spread successors


def test_pairs_have_numbers_of_their_own():
    rng = np.random.default_rng(4)
    for bits in (1, 5, 16, 31, 32):
        meta = lm_trie.Meta(6, 24, bits, [], 0, 0, 0)
        a, b = (rng.integers(0, 1 << bits, 50_000, dtype=np.uint64) for _ in range(2))
        assert len(np.unique(meta.keys(a, b))) == len(np.unique(np.stack([a, b]), axis=1).T)
        assert int(meta.keys(a, b).max()) < 1 << min(64, 2 * bits)


def tokens(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + ["</s>"]


def brute_scores(rows, strength):
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    grams = [collections.Counter() for _ in range(4)]
    context = [collections.Counter() for _ in range(4)]
    for r in train:
        t = ["<s>", "<s>"] + tokens(r[1])
        for i in range(2, len(t)):
            for k in (1, 2, 3):
                grams[k][tuple(t[i - k + 1 : i + 1])] += 1
                context[k][tuple(t[i - k + 1 : i])] += 1
    total, types = sum(grams[1].values()), len(grams[1])
    out = []
    for r in rows:
        t, base, score, known = ["<s>", "<s>"] + tokens(r[1]), 0.0, 0.0, 0
        for i in range(2, len(t)):
            c = grams[1][(t[i],)]
            known += c > 0
            p = (c + 1) / (total + types + 1)
            base += math.log10(p)
            for k in (2, 3):
                big = context[k][tuple(t[i - k + 1 : i])]
                p = (grams[k][tuple(t[i - k + 1 : i + 1])] + strength[k] * p) / (big + strength[k])
            score += math.log10(p)
        out.append((r[0], len(t) - 2, known, total, base, score))
    return out


def test_scores_against_brute_force(spark):
    rows = documents()
    rows.append((70, "word " * 9000, None, None, 0, 0, ""))
    want = sorted(brute_scores(rows, lm_trie.STRENGTH), key=str)
    model = lm_trie.fit(frame(spark, rows), block_bytes=3000, shard_bytes=4000)
    small = {"block_bytes": 2000, "shard_bytes": 1000, "min_shards": 5}
    shuffled = frame(spark, rows).orderBy(F.rand())  # gives other rows in other order each time
    for out in (lm_trie.score_documents(frame(spark, rows)), lm_trie.score_documents(shuffled, **small), lm_trie.score_with(model, shuffled, block_bytes=5000)):
        out = out.collect()
        got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out), key=str)
        assert [g[:4] for g in got] == [w[:4] for w in want]
        for g, w in zip(got, want):
            assert abs(g[4] - w[4]) < 1e-6 * abs(w[4]) + 1e-9
            assert abs(g[5] - w[5]) < 0.02 * w[1] + 1e-9  # half a step at most for each code
        held = [r for r in out if r.held_out]
        assert held and all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in held)
    unseen = spark.createDataFrame([(2, "entirely unseen w0rds"), (5, None)], "doc_id long, text string")
    assert [r.n_known for r in lm_trie.score_with(model, unseen).orderBy("doc_id").collect()] == [1, 1]
    assert lm_trie.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_are_small_and_scoring_stores_no_trie(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(10**9)}" for _ in range(500)) + " the" * 300 for _ in range(60)]
    block = lm_trie.Block.of([*range(59), None], *textkit.flatten(pa.array(texts)))
    blob = block.pack()
    again = lm_trie.Block.unpack(np.frombuffer(blob, np.uint8))
    assert again.ids == block.ids and all(np.array_equal(getattr(again, k), getattr(block, k)) for k in ("sizes", "words", "tokens", "held"))
    assert len(blob) < 9.5 * len(block.words)
    tables, plain = {}, lm_trie.stored
    monkeypatch.setattr(lm_trie, "stored", lambda df, name: tables.setdefault(name, plain(df, name)))
    docs = frame(spark, documents())
    lm_trie.score_documents(docs)
    assert tables["grams"].where("block < 0").count() == 0 < tables["grams"].count()
    tables.clear()
    assert lm_trie.fit(docs).trie.count() > 0


def test_words_in_context_are_a_distribution():
    """The probabilities of all known words and the unknown one add up to about 1 in any context of two words."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefg") for _ in range(40)), "en", "s", 0, 0, "") for i in range(50)]
    strength = lm_trie.STRENGTH
    train = [["<s>", "<s>", *r[1].split(), "</s>"] for r in rows if not lm_trie.held_out(r[0])]
    single, pair, triple = (collections.Counter(tuple(t[i - k : i + 1]) for t in train for i in range(2, len(t))) for k in range(3))
    start = collections.Counter(tuple(t[i - 2 : i]) for t in train for i in range(2, len(t)))
    one = collections.Counter((t[i - 1],) for t in train for i in range(2, len(t)))
    for context in (("<s>", "<s>"), ("<s>", "a"), ("g", "c")):
        total = 0.0
        for w in [*"abcdefg", "</s>", "unknown"]:
            p = (single[w,] + 1) / (single.total() + len(single) + 1)
            p = (pair[(context[1], w)] + strength[2] * p) / (one[context[1:]] + strength[2])
            big = lm_trie.COUNTS[lm_trie.quantise(np.array([start[context]]))[0]]
            total += (lm_trie.COUNTS[lm_trie.quantise(np.array([triple[(*context, w)]]))[0]] + strength[3] * p) / (big + strength[3])
        assert abs(total - 1) < 0.07


def test_held_out_text_is_scored_better_than_by_single_words(spark):
    rnd = random.Random(9)
    follows = {w: [rnd.choice("abcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}
    rows = []
    for i in range(400):
        w, x = rnd.choice("abcdefghijklmnop"), []
        for _ in range(60):
            x.append(w)
            w = rnd.choice(follows[w])
        rows.append((i, " ".join(x), "en", "s", 0, 0, ""))
    out = [r for r in lm_trie.score_documents(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in out) > 0.5 * sum(r.base_score for r in out)


def test_pipeline_stages_chain(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from corvane.llm import bpe, mixing
    from tests.llm.test_table_operators import jp, near_rows, shingle_counts
    from tests.llm.test_text_operators import brute_words

    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in near_rows()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at, results = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        results.append([tuple(r) for r in at.collect()])
    kept = [r for r in rows for n, *_, m in [brute_words(r[1] or "")] if n >= 20 and 100 * m <= 30 * n]
    assert collections.Counter(results[0]) == collections.Counter(kept)  # no line is above the production limits here
    key = lambda y: re.sub("[A-Z]", lambda m: m[0].lower(), y.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = collections.defaultdict(set)
    for r in kept:
        for y in r[1].split("\n"):
            holders[key(y)].add(r[0])
    order = lambda v: (v is not None, v or 0)
    deduped = []
    for r in kept:
        x = "\n".join(y for y in r[1].split("\n") if not (len(key(y)) >= 20 and len(holders[key(y)]) >= 3 and r[0] != max(holders[key(y)], key=order)))
        deduped.append((r[0], x, r[2], r[3], len(x)))
    assert collections.Counter(results[1]) == collections.Counter(deduped)
    counts = {x: shingle_counts(x) for x in {r[1] for r in deduped}}
    assert set(results[2]) <= set(deduped)
    for a in range(len(results[2])):
        for b in range(a):
            x, y = counts[results[2][a][1]], counts[results[2][b][1]]
            assert results[2][a][1] != results[2][b][1] and not (x and y and jp(x, y) >= 0.8)
    near = spark.read.parquet(str(tmp_path / "near dedup"))
    drawn = {r.doc_id for r in mixing.mix(near, budget_share=pipeline.BUDGET_SHARE).where("sampled").collect()}
    assert {r[0] for r in results[3]} == drawn and set(results[3]) <= set(results[2])
    from corvane.llm.queries import tokenizer

    assert collections.Counter(results[4]) == collections.Counter(map(tuple, bpe.digests(spark.createDataFrame(results[3], docs.schema), *tokenizer()).collect()))
    again = pipeline.run(spark, str(tmp_path))
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(results[4])


def test_mixing_stage_fits_topics_on_every_document(spark, monkeypatch):
    import corpus_pipeline as pipeline
    from corvane.llm import mixing

    seen, plain = [], mixing.fit_topics
    monkeypatch.setattr(mixing, "fit_topics", lambda units, *a, **k: seen.append(units.count()) or plain(units, *a, **k))
    docs = frame(spark, [(i, f"a{i % 7} b{i % 11} c{i}", "en", "s", 0, 0, "") for i in range(2300)])
    assert 0 < pipeline.mix_sources(spark, docs, "").count() < 2300 == seen[0]


def test_mixing_stage_has_the_topic_model_of_the_whole_table(spark, monkeypatch):
    """Against numpy over all texts, some of them long."""
    import corpus_pipeline as pipeline
    from corvane.llm import mixing

    rnd = random.Random(12)
    texts = [" ".join(f"{'abcdef'[i % 6 if rnd.random() < 0.75 else 0]}{rnd.randrange(60)}" for _ in range(3000 if i % 500 == 7 else 15)) for i in range(3000)]
    docs = frame(spark, [(i, x, "en", "s", 0, 0, "") for i, x in enumerate(texts)])
    models, plain = [], mixing.with_features
    monkeypatch.setattr(mixing, "with_features", lambda docs, model, **k: models.append(model) or plain(docs, model, **k))
    assert 0 < pipeline.mix_sources(spark, docs, "").count() < len(texts)
    counts = np.zeros((len(texts), mixing.DIMS), np.int64)
    _, _, at, hashes = textkit.words(*textkit.flatten(pa.array(texts)), lower=True)
    np.add.at(counts, (at, (hashes % np.uint64(mixing.DIMS)).astype(int)), 1)
    (idf, centres), = models
    assert np.allclose(idf, np.log((1 + len(texts)) / (1 + (counts > 0).sum(0))) + 1e-3, atol=1e-12)
    x = mixing.unit_vectors(counts, idf)
    topic = (x @ centres.T).argmax(1)
    for k, centre in enumerate(centres):
        mean = x[topic == k].sum(0)
        assert centre @ mean > 0.99 * np.linalg.norm(centre) * np.linalg.norm(mean)
