import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corvane.llm import bpe, line_dedup, media, quality, textkit
from tests.llm.fixtures import SCHEMA, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STRIP = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = [r[1] for r in documents()] + ["a" * 100, "", None, " b"]
    buf, offs = textkit.flatten(pa.array(texts))
    old = textkit.CHUNK
    for chunk in (old, 50):
        textkit.CHUNK = chunk
        starts, ends, rows, hashes = textkit.words(buf, offs, lower=True)
        got = [(int(r), buf[s:e].tobytes().decode()) for s, e, r in zip(starts, ends, rows)]
        assert got == [(i, w) for i, x in enumerate(texts) for w in WORD.findall(x or "")]
        by = {}
        for (_, w), h in zip(got, hashes.tolist()):
            assert by.setdefault(lower(w), h) == h
        assert len(set(by.values())) == len(by)
    textkit.CHUNK = old


def test_bpe_equals_plain_merging_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    rows = documents()
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(path, P.PATTERN).vocabulary.ranks, special_tokens={})
    out = bpe.digests(frame(spark, rows), path, P.PATTERN).collect()
    want = sorted((d is not None, d or 0, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()) for d, x, *_ in rows for t in [plain.encode_ordinary(x or "")])
    assert sorted((r[0] is not None, r[0] or 0, *r[1:]) for r in out) == want
    rnd, e = random.Random(5), bpe.encoder(path, P.PATTERN)
    for _ in range(3000):
        s = "".join(rnd.choice("  \n\tabethein'sé1中\x85\x1c") for _ in range(rnd.randrange(40)))
        assert np.frombuffer(e.encode(s), "<u4").tolist() == plain.encode_ordinary(s)
        assert e.decode(e.encode(s)).decode() == s
    assert bpe.digests(spark.createDataFrame([], SCHEMA), path, P.PATTERN).count() == 0


def test_words_are_encoded_once(monkeypatch):
    """Words that come again behind some 350,000 others are still known; a vocabulary encodes as merging does."""
    P = pytest.importorskip("public_tokenizers")
    e, rnd, missed = bpe.Encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), random.Random(8), []
    plain = bpe._Chunks.__missing__
    monkeypatch.setattr(bpe._Chunks, "__missing__", lambda self, chunk: missed.append(chunk) or plain(self, chunk))
    text = " ".join("".join(rnd.choice("etaoinsr") for _ in range(7)) for _ in range(450_000))
    first = e.encode(text)
    assert len(missed) > 300_000
    missed.clear()
    assert e.encode(text) == first and not missed
    for word in text[:8000].split(" ") + ["x", "é中 \U0001f600"]:
        assert np.frombuffer(e.vocabulary.encode(word.encode()), "<u4").tolist() == e.vocabulary.merge(word.encode())


def test_prefix_table_appends_and_edits():
    """Over a tiny vocabulary, against merging from scratch."""
    rnd = random.Random(2)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
    while len(ranks) < 40:
        a, b = rnd.choice(list(ranks)), rnd.choice(list(ranks))
        ranks.setdefault(a + b, len(ranks))
    v = bpe.Vocabulary(ranks)
    text = lambda n: bytes(rnd.choice(b"abc") for _ in range(n))
    for _ in range(400):
        whole = text(rnd.randrange(1, 20))
        t = bpe.PrefixTable(v, whole)
        more = text(rnd.randrange(5))
        t.append(more)
        assert t.tokens() == v.merge(whole + more)
        at = rnd.randrange(len(whole))
        t.edit(at, at + 2, more)
        assert t.tokens() == v.merge(whole[:at] + more + (whole + more)[at + 2 :])
    for _ in range(60):  # edits within long texts stay near
        whole, at, more = text(1500), rnd.randrange(1400), text(rnd.randrange(4))
        t = bpe.PrefixTable(v, whole)
        assert t.edit(at, at + rnd.randrange(4), more) < 40 * v.longest
        assert t.tokens() == v.merge(bytes(t.data))


def test_wav_round_trip(spark):
    rows = documents()
    out = media.digests(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = collections.Counter()
    for d, x, *_ in rows:
        raw = (x or "").encode()
        payload = media.payload_of(raw)
        assert len(payload) % 64 == 0 and payload and payload.startswith(raw)
        want[(d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44)] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in out) == want
    assert media.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_do_not_depend_on_grouping_and_find_shared_sound():
    rnd = np.random.default_rng(1)
    tone = (128 + 60 * np.sin(np.arange(40000) * 0.5) + 40 * np.sin(np.arange(40000) * 1.7)).astype(np.uint8).tobytes()
    t, code = media.fingerprints(tone)
    assert len(t) and (np.diff(t) >= 0).all()
    other = media.fingerprints(rnd.integers(0, 255, 40000, dtype=np.uint8).tobytes())[1]
    again = media.fingerprints(tone[2048 * 4 :])[1]
    share = lambda a, b: len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()))
    assert share(again, code) > 0.5 > 0.1 > share(other, code)


def test_line_dedup_against_brute_force(spark):
    rows = documents()
    holders = collections.defaultdict(set)
    key = lambda line: lower(line.strip(STRIP))
    for d, x, *_ in rows:
        for line in (x or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    want = collections.Counter()
    for d, x, *_ in rows:
        lines = (x or "").split("\n")
        kept = [y for y in lines if not (len(holders.get(key(y), ())) >= 3 and d != max(holders[key(y)], key=lambda v: (v is not None, v or 0)))]
        want[(d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    assert sum(k[2] for k in want) > 50
    assert collections.Counter(map(tuple, line_dedup.digests(frame(spark, rows)).collect())) == want
    assert line_dedup.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_line_groups_over_partition_edges(spark):
    rows = [(i, "the very same long line here\nown line number %d of many" % i, None, None, 0, 0, "") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = line_dedup.digests(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.doc_id for r in out if r.n_dropped == 0) == [2999]
    assert all(r.n_dropped == 1 for r in out if r.doc_id != 2999)


def brute_words(x):
    words, where = WORD.findall(x), []
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            marked |= set(range(i, i + 8))
    lines = [y for y in x.split("\n") if WORD.search(y)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(marked)


def test_quality_rules_against_brute_force(spark):
    rows = documents()
    options = {"min_documents": 5, "min_share": 0.05, "min_words_left": 0.6}
    out = quality.judge(frame(spark, rows), **options).collect()
    want = collections.Counter()
    line = lambda y: lower(" ".join(WORD.findall(y)))
    holders, texts, first = collections.defaultdict(set), collections.defaultdict(set), {}
    order = lambda v: v if v is not None else float("inf")  # noqa: E731  min() passes over nulls
    for d, x, _, host, *_ in rows:
        texts[host or ""].add(x)
        for y in (x or "").split("\n"):
            if 0 < len(WORD.findall(y)) <= 15:
                k = (host or "", line(y))
                holders[k].add(x)
                first[k] = min(first.get(k, float("inf")), order(d))
    for d, x, _, host, *_ in rows:
        stats = brute_words(x or "")
        lost = sum(len(WORD.findall(y)) for y in (x or "").split("\n") for k in [(host or "", line(y))] if 0 < len(WORD.findall(y)) <= 15 and len(holders[k]) > max(5, 0.05 * len(texts[host or ""])) and order(d) != first[k])
        failed = stats[0] < 20 or 100 * stats[4] > 30 * stats[0]
        want[(d, *stats, lost, failed, not failed and not stats[0] - lost < 0.6 * stats[0])] += 1
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_boilerplate_words, r.base_failed, r.kept) for r in out)
    assert not (got - want), (sorted(map(str, got - want))[:3], sorted(map(str, want - got))[:3])
    assert len({k[-1] for k in want}) == 2 and any(k[-3] for k in want)
    kept = quality.keep_documents(frame(spark, rows), **options)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(n for k, n in want.items() if k[-1])
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def shared_line_rows(line, n=40, host="s0"):
    return [(i, f"{line}\nown words " + " ".join(f"w{i}x{k}" for k in range(25)) + f"\n  {line.upper()} \n\nend {i}", None, host, 7, 0, "") for i in range(n)]


def test_quality_removes_lines_above_limits(spark):
    rows = shared_line_rows("all rights reserved")
    own = {r[0]: "\n".join(r[1].split("\n")[k] for k in (1, 3, 4)) for r in rows}
    want = {r[0]: r[1] if r[0] == 0 else own[r[0]] for r in rows}
    out = quality.judge(frame(spark, rows)).collect()
    assert {r.doc_id: r.left_text for r in out} == want
    assert {r.doc_id: r.n_boilerplate_words for r in out} == {i: 6 * (i > 0) for i in range(40)}
    kept = quality.keep_documents(frame(spark, rows)).collect()
    assert {r.doc_id: r.text for r in kept} == want and {r.doc_id: r.n_chars for r in kept} == {i: len(x) if i else 7 for i, x in want.items()}


def test_quality_counts_long_lines(spark):
    long = " ".join(f"notice{k}" for k in range(60))
    out = quality.judge(frame(spark, shared_line_rows(long))).collect()
    assert {r.doc_id: (r.n_boilerplate_words, r.kept) for r in out} == {i: (120 * (i > 0), i == 0) for i in range(40)}


def test_quality_limit_does_not_grow_with_a_hot_host(spark):
    rows = shared_line_rows("all rights reserved", 250, "hot") + [(1000 + i, f"page {i}", None, "hot", 0, 0, "") for i in range(29_750)]
    out = quality.judge(frame(spark, rows)).where("doc_id < 1000").collect()
    assert {r.doc_id: r.n_boilerplate_words for r in out} == {i: 6 * (i > 0) for i in range(250)}


def test_columns_of_any_name_are_carried(spark):
    names = ["_hash", "_id", "_host", "_text", "keep_bitmap", "_bitmap", "_doc", "_caller", "_drop", "_kept", "_left"]
    long = " ".join(f"word{k}" for k in range(30))
    rows = [(i, f"a line that is long enough to count\n{long} own{i}", "s", 3) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").selectExpr("*", *(f"'{n}' AS `{n}`" for n in names))
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))
    kept = line_dedup.keep_lines(docs)
    assert kept.columns == docs.columns
    want = {(i, x if i == 3 else x.split("\n")[1], "s", len(x if i == 3 else x.split("\n")[1]), *names) for i, x, _, _ in rows}
    assert set(map(tuple, kept.collect())) == want
