"""Dual-tree clustering, HTML extraction and phrase mining against brute force and SQL on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corvane.llm import centroids, main_text, phrases
from tests import oracle
from tests.llm import fixtures

# --- clustering ---------------------------------------------------------------------------------------------------


def lloyd(rows, dimensions, k, rounds, scale=1024, seed=3):
    """Plain loops over Python integers."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), y) for i, y in kept if i is not None)[:k]
    c = [y for _, y in starts]
    if not c:
        return []
    near = lambda y: min((sum((a - b) ** 2 for a, b in zip(y, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        at = [near(y)[1] for _, y in kept]
        groups = {j: [y for (_, y), g in zip(kept, at) if g == j] for j in set(at)}
        c = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else m for j, m in enumerate(c)]
    last = [near(y) for _, y in kept]
    inertia = Counter()
    for d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    cap = lambda x: min(x, centroids.LARGEST)
    return sorted(((i, j, cap(d), cap(inertia[j]), cap(sum(inertia.values())), digest[j]) for (i, _), (d, j) in zip(kept, last)), key=str)


def _clustered(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=str)


VECTORS = "vec_id bigint, embedding array<{}>, cluster string, distance int"


@pytest.mark.parametrize("size,kind", [("small", "float"), ("wide", "float"), ("huge", "double"), ("ties", "float")])
def test_lloyd_equals_plain_loops(spark, size, kind):
    rnd = random.Random(5)
    spread = {"small": 0.4, "wide": 3e5, "huge": 1e300, "ties": 0.003}[size]
    rows = [(i, [rnd.uniform(-spread, spread) for _ in range(4)]) for i in range(250)]
    rows += [(300 + i, rows[3][1]) for i in range(120)]  # one very common vector
    rows += [(3, rows[9][1]), (3, rows[9][1]), (None, rows[4][1]), (600, None), (601, []), (602, [1.0, 2.0, None, 1.0]), (603, [1.0, math.inf, 0.0, 0.0]), (604, [math.nan] * 4), (605, [0.0] * 5)]
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], VECTORS.format(kind)).repartition(3)
    got = _clustered(centroids.cluster(df, dimensions=4, k=6, rounds=5))
    assert got == lloyd(rows, 4, 6, 5)


def test_lloyd_with_few_or_no_vectors(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS.format("float"))
    few = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-0.125, 1.0])]
    assert _clustered(centroids.cluster(frame(few), dimensions=2)) == lloyd(few, 2, 8, 10)
    assert centroids.cluster(frame([]), dimensions=2).collect() == []
    assert centroids.cluster(frame([(None, [0.5, 0.25])]), dimensions=2).collect() == []  # no start, so nothing to assign to


def test_tree_holds_every_row_within_its_radius():
    rnd = np.random.default_rng(1)
    for x in (rnd.integers(-9, 9, (300, 2)), rnd.integers(-900, 900, (500, 16)), np.zeros((40, 3), np.int64)):
        order, tree, radius = centroids.cover_tree(x)
        assert sorted(order) == list(range(len(x)))
        x = x[order]
        for k, (centre, lo, hi, first, last) in enumerate(zip(*(tree[n] for n in ("centre", "lo", "hi", "first", "last")))):
            assert (centroids.squared(x[lo:hi], x[centre][None, :]) <= radius[k] ** 2 + 1e-6).all()
            assert first == last or (tree["lo"][first], tree["hi"][last - 1]) == (lo, hi)
        far = rnd.integers(-900, 900, (7, x.shape[1]))
        want = [min((int(centroids.squared(y[None], c[None])[0]), j) for j, c in enumerate(far))[1] for y in x]
        assert centroids.nearest(x, tree, radius, far).tolist() == want


def test_pairs_are_pruned():
    """On two far groups, whole nodes are assigned without comparing their vectors."""
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.integers(0, 50, (500, 3)), rnd.integers(10_000, 10_050, (500, 3))])
    order, tree, radius = centroids.cover_tree(x)
    compared, plain = [], centroids.squared
    try:
        centroids.squared = lambda a, b: compared.append(max(len(a), len(b))) or plain(a, b)
        centroids.nearest(x[order], tree, radius, np.array([[25, 25, 25], [10_025] * 3]))
    finally:
        centroids.squared = plain
    assert sum(compared) < 100


# --- extraction ---------------------------------------------------------------------------------------------------

PAGES = [
    (
        """<html><head><title>T</title><style>p{}</style></head><body class="post has-sidebar"><header><div class=logo>Site Name</div><nav><a href=/>Home</a> <a href=/b>News</a></nav></header>
<div class="cookie-notice">We use cookies. <button>OK</button></div><div id="main" class="wrap"><article><header><h1>The big title</h1></header><p>First para &lt;with&gt; an <a href=x>inline link</a> and caf&eacute;&nbsp;text.
<p>Short.</p><ul><li>item one</li><li>item two is longer</li></ul><div class="ad">Buy this now, it is great and cheap, really great.</div><blockquote>Quoted   words<br>here</blockquote><table><tr><td>cell a<td>cell b</table>
<aside>Related: other story</aside><form action=x><label>Name</label><input><button>Send</button></form><p>Last para 2 < 3 &amp; so&#32;on.</p>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I am a reader with a long comment that goes on and on, like an article would do, for many many words.</p></article></section></article>
<div class="sidebar"><h3>Popular</h3><p>Some text in the side bar that has no links at all and is rather long too.</p></div></div><footer>&copy; 2020 Site</footer><script>document.write("<p>x</p>")</script></body></html>""",
        "The big title\nFirst para <with> an inline link and café text.\nShort.\nitem one\nitem two is longer\nQuoted words here\ncell a\ncell b\nLast para 2 < 3 & so on.",
    ),
    (
        """<body><div><a href=1>Home</a> | <a href=2>About</a> | <a href=3>Contact</a></div><div><h1>Title words here</h1><div>A first long paragraph that has many words in it, so that one can see it is the main text
of the page, no doubt at all.</div><div>Then a second one with a <a href=y>link</a> in the middle of many words, which should also be kept as main text of the page.</div><div>Short one.</div>
<div>And the third long paragraph of the main text, that ends the article here and now, with some more words to be long.</div></div><div><a href=1>Imprint</a> <a href=2>Privacy</a></div><div>Copyright 2020 by us</div></body>""",
        "Title words here\nA first long paragraph that has many words in it, so that one can see it is the main text of the page, no doubt at all.\nThen a second one with a link in the middle of many words, which "
        "should also be kept as main text of the page.\nShort one.\nAnd the third long paragraph of the main text, that ends the article here and now, with some more words to be long.",
    ),
    ("<form><article><h1>x y z</h1><p title='a > b'>text here</p></article></form>", "x y z\ntext here"),
    ("<nav><ul><li><a>q</a><article><p>nav was left open</p><script>never closed <p>z", "nav was left open"),
    ("<main><P>one two<!-- <p>not this</p> --> three</P><div hidden>gone</div><div style='display: none'>gone too</div><p>four", "one two three\nfour"),
    ("", ""),
    (None, ""),
    ("<body><nav><a>a</a></nav></body>", ""),
]


def test_main_text_of_held_out_pages(spark):
    rows = [(i, f"http://x/{i}", page, "clash", 5) for i, (page, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int").repartition(2)
    got = main_text.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, f"http://x/{i}", text, len(text)) for i, (_, text) in enumerate(PAGES)] + [(0, None, PAGES[0][1], len(PAGES[0][1]))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert main_text.extract(df.limit(0)).collect() == []


def test_tree_learns_its_table_and_other_tables():
    x, y = main_text.labelled_blocks()
    assert (main_text.grow(x, y)(x) == y).mean() > 0.98
    only_long = main_text.grow(*main_text.labelled_blocks(".p5 .p6 .p50! .p60!\n.p3 .p70!"))
    assert main_text.main_texts(["<p>a b</p><p>" + "w " * 80 + "</p>"], only_long) == [" ".join(["w"] * 80)]


def test_given_pages_are_extracted_whole(spark):
    """The articles of the given pages, cut out by their tags."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text.extract(rows).collect()}
    for page_id, _, page in rows.select("page_id", "url", "html").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert got[page_id] == "\n".join(b for b in blocks if b)


def test_time_grows_with_the_page():
    tree = main_text.grow(*main_text.labelled_blocks())
    long = "<p>" + "many words " * 200_000 + "</p>"
    assert len(main_text.main_texts([f"<article>{long}</article>"], tree)[0].split()) == 400_000
    bad = '<p title="x>' * 20_000 + "<a href='>" * 20_000 + "<!--" * 1000 + "<" * 100_000 + "<div>" * 20_000 + "x" + "</p>" * 20_000
    assert len(main_text.main_texts([bad], tree)) == 1


# --- phrases ------------------------------------------------------------------------------------------------------


def collocations(rows, least, top, contained):
    """Plain loops."""
    f, n = {}, Counter()
    lower = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= contained * counts[p[i : i + m]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def _rows():
    rnd = random.Random(11)
    words = ["the", "The", "of", "ü", "x\x01", "x", "é\xa0b", "new", "york", "city"]
    rows = [(" ".join(rnd.choice(words) + rnd.choice(["", "", "", "", ".", ",", "\n"]) for _ in range(rnd.randrange(60))), rnd.choice(["en", "en", "en", "de", None, "und"])) for _ in range(150)]
    rows += [("new york city hall " * 400, "en"), (None, "en"), ("", None), ("?!.", "fr"), ("word " * 9, "fr")] + [("exact copy of a line", "de")] * 40
    return rows


@pytest.mark.parametrize("least,top", [(3, 1000), (30, 2000), (3, 7)])
def test_phrases_equal_plain_loops(spark, least, top):
    rows = _rows()
    df = spark.createDataFrame([(t, g, "x", 1) for t, g in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = sorted(map(tuple, phrases.collocations(df, least=least, top=top).collect()))
    assert got == collocations(rows, least, top, 80)


def test_phrases_over_many_blocks_and_tasks(spark, monkeypatch):
    """A common prefix lies in all blocks and over the edges of several tasks."""
    rows = _rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = sorted(map(tuple, phrases.collocations(df, least=3, top=50).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == collocations(rows, 3, 50, 80)


def test_growth_keeps_what_touches_an_edge():
    a, b, n = (np.array(x) for x in ([(1 << 32) | 2, (1 << 32) | 2, (1 << 32) | 3], [5 << 32, 6 << 32, 0], [2, 40, 1]))
    found = {(x >> 32, x & 0xFFFFFFFF, y >> 32): int(z) for x, y, z in zip(*phrases.grow(a, b, n, 30))}
    assert found == {(1, 2, 0): 42, (1, 2, 5): 2, (1, 2, 6): 40, (1, 3, 0): 1}


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(df).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).collect() == []


@pytest.mark.parametrize("name", ["op11_dual_tree_lloyd", "op13_phrase_collocations"])
def test_query_matches_its_sql(spark, name):
    from corvane.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    assert oracle.same(QUERIES[name](spark, sf), ORACLES[name], oracle.connect(sf)) is None


def test_awkward_documents(spark):
    rows = fixtures.documents()
    got = sorted(map(tuple, phrases.collocations(fixtures.frame(spark, rows), least=5).collect()))
    assert got == collocations([(r[1], r[2]) for r in rows], 5, 2000, 80)


def test_temporary_folder_needs_no_setting(spark, monkeypatch):
    from corvane.llm import shared

    class Frame:
        class sparkSession:  # noqa: N801
            class conf:  # noqa: N801
                get = staticmethod(lambda key, default=None: default)

            sparkContext = spark.sparkContext

    assert shared.shared_folder(Frame) == shared.shared_folder(Frame)


def test_raking_meets_reachable_targets_and_says_what_it_missed(spark):
    """Run to convergence, weights and draws are those of plain loops run much longer; targets out of reach are reported."""
    from collections import Counter as C

    from corvane.llm import mixing
    from tests.llm.test_table_operators import brute_rake

    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["ab", "cd", "ef", "gh"]) + str(i % 5) for _ in range(rnd.randrange(1, 80))), rnd.choice(["en", "en", "en", "de", "fr"]), f"s{min(9, int(rnd.expovariate(0.4)))}", 0, 0, "") for i in range(300)]
    out = mixing.mix(fixtures.frame(spark, rows), budget_share=0.6, n_topics=4).collect()
    cells = C()
    for r in out:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    shares = []
    for d, power in enumerate((0.7, 0.8, 0.5)):
        totals = C()
        for k, t in cells.items():
            totals[k[d]] += t
        shares.append({k: t**power / sum(u**power for u in totals.values()) for k, t in totals.items()})
    weight, prob = brute_rake(cells, shares, 0.6, 3000)
    features = {r.doc_id: r for r in out}
    for r in features.values():
        k = (r.source, r.lang, r.topic)
        assert abs(r.weight - weight[k]) < 2e-3 * weight[k] and abs(r.prob - prob[k]) < 2e-3
    raked = mixing.rake(spark.createDataFrame([(*k, float(t)) for k, t in cells.items()], "source string, lang string, topic string, tokens double"), {"source": 0.7, "lang": 0.8, "topic": 0.5}, {}, 200, 1e-4).collect()
    whole = sum(cells.values())
    for d, share in enumerate(shares):
        have = C()
        for r in raked:
            have[r[d]] += r.tokens * r.weight
        assert all(abs(have[k] / (share[k] * whole) - 1) < 1.1e-4 for k in share)
    assert max(r.missed for r in raked) < 1.1e-4
    apart = spark.createDataFrame([("s0", "en", "t0", 10.0), ("s1", "de", "t0", 10.0)], "source string, lang string, topic string, tokens double")
    with pytest.warns(UserWarning, match="off their targets"):
        stuck = mixing.rake(apart, {"source": 1.0, "lang": 1.0, "topic": 1.0}, {"source": {"s0": 3.0, "s1": 1.0}, "lang": {"en": 1.0, "de": 1.0}}, 30, 1e-4)
    assert max(r.missed for r in stuck.collect()) > 0.1


def test_broken_schemas_are_named_before_anything_runs(spark):
    from corvane.llm import tool_calls

    messages = spark.createDataFrame([("a-1", 0, "call", "c1", None, "t", '{"x": 1}', None), ("a-1", 1, "result", "c1", None, None, None, "ok"), (None, 0, "call", "c1", None, "t", "{}", None)],
                                     "conv_id string, turn bigint, kind string, call_id string, after string, tool string, arguments string, content string")
    bad = [{"type": "integr"}, {"pattern": "("}, {"pattern": 3}, {"minLength": None}, {"minItems": True}, {"maximum": "9"}, {"required": "x"}, {"enum": "abc"}, {"properties": []}, {"anyOf": []}, {"properties": {"x": {"items": {"type": ["object", 7]}}}}, "no"]
    for schema in bad:
        assert tool_calls.malformed(schema)
        with pytest.raises(ValueError, match="can not be used"):
            tool_calls.link(messages, {"t": schema})
    good = {"type": "object", "properties": {"x": {"type": ["integer", "null"], "minimum": 0}}, "required": ["x"], "additionalProperties": False}
    assert tool_calls.malformed(good) is None
    rows = {(r.conv_id, r.turn): (r.status, r.valid) for r in tool_calls.link(messages, {"t": good}).collect()}
    assert rows["a-1", 0][1] is True and rows[None, 0][1] is False and len(rows) == 3  # identifiers of conversations may be strings
    assert rows["a-1", 1][0] == "linked"
