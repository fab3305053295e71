"""Text functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP = r"[^a-z0-9぀-ヿ㐀-鿿\s]"


def tokens(text: Column, most: int = 64) -> Column:
    """lower-cased runs of letters, digits and CJK, longer than one, the first `most`."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), KEEP, " "), r"\s+", " ")), " ")
    return F.slice(F.filter(words, lambda w: F.length(w) > 1), 1, most)


def token_set(text: Column, most: int = 64) -> Column:
    return F.array_distinct(tokens(text, most))


# Fixed value: the characters between words.
PUNCTUATION = r"[\s,.;:!?()\[\]{}\"'`<>=/\\+*\-]+"


def word_set(text: Column) -> Column:
    """distinct words of two characters or more between punctuation."""
    return F.array_distinct(F.filter(F.split(F.lower(text), PUNCTUATION), lambda w: F.length(w) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """of two sets; two empty sets give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_bigrams(words: Column) -> Column:
    """the set of the words and of each adjacent pair."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


# The patterns of the type classifiers, on lower-cased text; the first match wins.
OBSERVATION_TYPES = (
    ("decision", r"(decided|decide to|chose|choose|picked|switch(ed)? to|adopt(ed)?|going with|settled on|will use|let's use|方針|決定|決めた|することにし|採用|選定|選択)"),
    ("pattern", r"(pattern|usually|consistently|repeatedly|every time|always|傾向|パターン|毎回|常に|いつも)"),
    ("preference", r"(prefer|dislike|avoid|rather|preference|好み|希望|避けたい|したくない)"),
    ("lesson", r"(learned|lesson|realized|gotcha|mistake|fixed|bug\b|root cause|caused by|turned out|culprit|debug|crash(ed)?|学び|反省|気づき|教訓|修正|原因|不具合|判明|ハマっ|つまづ|つまず)"),
    ("action", r"(next step|todo|next action|need(s)? to|should|plan to|will (add|implement|do|fix)|次対応|次の対応|アクション|やる|対応する|する予定|すべき|べき|予定)"),
)
EPISODIC = r"\b(happened|occurred|experienced|encountered|ran into|found that)\b|\b(today|yesterday|last time|this morning|earlier)\b|(実行した|発生した|やった|起きた|遭遇した|出会った|経験した)"
PROCEDURAL = r"\b(how to|step[s]?\b|procedure|instructions?|tutorial|guide)\b|\b(run|execute|install|configure|setup|deploy|build|compile)\b|(方法|手順|やり方|コマンド|設定方法|インストール|実行する)"
BOOST, DAMPEN = r"(?i)\b(remember|architecture|decision|bug|fix)\b", r"(?i)<environment_context>|<AGENTS\.md>"


def first_match(text: Column, cases, default: str) -> Column:
    out = None
    for name, pattern in cases:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(default)


def observation_type(text: Column, event_type: Column | None = None) -> Column:
    """F19"""
    got = first_match(F.lower(text), OBSERVATION_TYPES, "context")
    if event_type is None:
        return got
    return F.when(event_type == "session_end", "summary").when(event_type == "session_start", "context").when(event_type == "tool_use", "action").otherwise(got)


def memory_type(text: Column, event_type: Column) -> Column:
    """what happened is episodic, how to do things procedural, all else semantic."""
    low = F.lower(text)
    return (
        F.when(event_type.isin("session_start", "session_end") | low.rlike(EPISODIC), "episodic")
        .when((event_type == "tool_use") | low.rlike(PROCEDURAL) | text.rlike(r"(?s)```.*```"), "procedural").otherwise("semantic")
    )


# The sectors in this order, and their patterns, on lower-cased text.
SECTORS = (
    ("work", (
        r"(実装|コード|バグ|修正|デプロイ|プロジェクト|タスク|仕事|業務|開発|レビュー|ビルド|リファクタ)",
        r"\b(code|coding|implement|bug|fix|deploy|project|task|work|develop|review|commit|pull request|api|test|build|refactor)\b",
        r"\b(typescript|javascript|python|rust|golang|sql|docker|kubernetes|aws|gcp|azure|github|gitlab|ci|cd)\b",
        r"\.(ts|js|py|rs|go|tsx|jsx|vue|sql|yaml|yml|json|toml|sh|md)\b",
    )),
    ("people", (
        r"(さん|くん|ちゃん|チーム|同僚|メンター|上司|部下|会議|ミーティング|面談|フィードバック|コミュニケーション|友達|友人|家族|パートナー|恋人|知人|社内|社外)",
        r"\b(team|colleague|mentor|manager|meeting|feedback|communication|friend|family|partner|engineer|designer|product|ceo|cto|mr\.|ms\.|dr\.)\b",
    )),
    ("health", (
        r"(睡眠|起床|就寝|体重|体調|健康|運動|ジョギング|ランニング|ジム|筋トレ|ヨガ|食事|カロリー|水分|サプリ|病院|クリニック|医者|症状|疲労|ストレス|メンタル|気分|リラックス|瞑想)",
        r"\b(sleep|exercise|jogging|running|gym|workout|yoga|diet|nutrition|calorie|hydration|supplement|doctor|medicine|symptom|fatigue|stress|mental|mood|relax|meditation|breathing|health)\b",
    )),
    ("hobby", (
        r"(ゲーム|アニメ|マンガ|読書|小説|映画|音楽|楽器|ギター|ピアノ|趣味|旅行|料理|写真|スポーツ|レベルアップ|クリア|ステージ)",
        r"\b(game|play|anime|manga|book|novel|movie|music|instrument|guitar|piano|hobby|travel|cooking|photo|photography|art|sport|level up|youtube|netflix|spotify|twitch)\b",
    )),
)


def ascii_bounds(pattern: str) -> str:
    r"""The pattern with each \b taken between ASCII word characters and all else, whatever the engine takes it for."""
    return pattern.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def sector(text: Column) -> Column:
    """F21"""
    return first_match(F.lower(text), [(name, ascii_bounds("|".join(patterns))) for name, patterns in SECTORS], "meta")


# The patterns of entities by type; the first group is the name.
ENTITIES = (
    ("file", r"(?:^|\s|[\"'`(])([\w./\\-]+\.(?:ts|js|py|rs|go|tsx|jsx|vue|sql|css|scss|html|json|yaml|yml|toml|md|sh))\b"),
    ("package", r"(?:npm|yarn|pnpm|pip|cargo|bun)\s+(?:install|add|i|remove)\s+([\w@/.+\-]+)"),
    ("symbol", r"(?:function|def|fn|func|const|let|var)\s+([A-Za-z_]\w{2,})"),
    ("url", r"(https?://[^\s\"'`<>)\]]+)"),
)


def _named(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("type"), x.alias("name"))


def entities(text: Column, most: int = 50) -> Column:
    """type and name of each entity, once, the first `most` by type and place; names are cut to 255 characters."""
    found = []
    for kind, pattern in ENTITIES:
        names = F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), F.lit(1))
        if kind == "url":
            names = F.transform(names, lambda x: F.substring(F.regexp_replace(x, r"[.,;:!?]+$", ""), 1, 255))
        found.append(F.transform(names, _named(kind)))
    return F.transform(F.slice(F.array_distinct(F.concat(*found)), 1, most), lambda e: F.struct(e["type"].alias("type"), F.substring(e["name"], 1, 255).alias("name")))


def signal(text: Column) -> Column:
    """.3 for any boosting word, less .2 for any dampening envelope."""
    return F.when(text.rlike(BOOST), 0.3).otherwise(0.0) - F.when(text.rlike(DAMPEN), 0.2).otherwise(0.0)


# Redaction patterns and what replaces them.
REDACTIONS = (
    (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b(sk|rk|pk)_[A-Za-z0-9]{16,}\b", "[REDACTED_KEY]"),
    (r"(?i)\b(?:api[-_ ]?key|token|secret|password)\s*[:=]\s*[^\s,;]+", "[REDACTED_SECRET]"),
    (r"(?i)\b[0-9a-f]{32,}\b", "[REDACTED_HEX]"),
)


def redacted(text: Column, rules=REDACTIONS) -> Column:
    """a fold of replacements."""
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def without_private_blocks(text: Column) -> Column:
    """<private> blocks with their contents go; an unclosed one takes the rest."""
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<private>.*?</private>", ""), r"(?is)<private>.*$", "")


def normal_content(text: Column) -> Column:
    """F29 basis: trimmed, spaces collapsed, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normal_tags(tags: Column) -> Column:
    """F30"""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def tag_match(wanted: Column, have: Column) -> Column:
    """wanted tags equal to, within or around one that is there, over the longer list."""
    hits = F.size(F.filter(wanted, lambda w: F.exists(have, lambda h: h.contains(w) | w.contains(h))))
    longest = F.greatest(F.size(wanted), F.size(have))
    return F.when(longest == 0, 0.0).otherwise(hits / longest)


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """F32"""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(k.lower()).cast("bigint") for k in keywords], F.lit(0).cast("bigint"))


def token_estimate(text: Column) -> Column:
    """a token for four characters, at least one; blank text is one."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "") == ""
    return F.when(blank, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.length(text) / 4))).cast("bigint")


def cjk_ratio(text: Column) -> Column:
    """share of Japanese or Chinese characters among all but spaces."""
    whole = F.length(F.regexp_replace(text, r"\s", ""))
    return F.when(whole == 0, 0.0).otherwise(F.length(F.regexp_replace(text, r"[^぀-ヿ㐀-鿿]", "")) / whole)


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles go with their bodies, block ends and breaks become line ends, other tags spaces."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", "")
    x = F.regexp_replace(x, r"(?i)</(p|div|section|article|header|footer|li|ul|ol|table|tr|h[1-6]|blockquote|pre)>|<(br|hr)\s*/?>", "\n")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


# The schemes that may be fetched, the host of a URL (behind user info), and hosts that are private or not by name (numbers).
ALLOWED_SCHEME = r"(?i)^https?://"
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)*(\[[^\]]*\]|[^/:?#@]+)"
PRIVATE_HOST = r"^(localhost|[0-9]+|0x[0-9a-f]+|0\.0\.0\.0|127\.[0-9.]+|10\.[0-9.]+|192\.168\.[0-9.]+|169\.254\.[0-9.]+|172\.(1[6-9]|2[0-9]|3[01])\.[0-9.]+|\[.*\]|.*\.localhost)$"


def url_allowed(url: Column) -> Column:
    """Http or https, with a host that is neither private nor a bare number or address in brackets."""
    return url.rlike(ALLOWED_SCHEME) & ~F.lower(F.regexp_extract(url, URL_HOST, 1)).rlike(PRIVATE_HOST)
