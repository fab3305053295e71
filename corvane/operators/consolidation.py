"""Consolidation: nuggets and facts from texts, links between rows, contradictions, and completion of plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import ascii_bounds, first_match, jaccard

# --- texts --------------------------------------------------------------------------------------------------------

LEAST, MOST, GROUP = 20, 500, 3
#: Fixed value: where a sentence ends.
SENTENCE_END = r"(?<=[。！？])\s*|(?<=[.!?])\s+(?=[A-Z぀-ヿ㐀-鿿])"


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences of each paragraph (paragraphs stand between empty lines), trimmed, without empty ones."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n{2,}"), _trimmed), lambda p: p != "")
    return F.filter(F.transform(F.flatten(F.transform(paragraphs, lambda p: F.split(p, SENTENCE_END))), _trimmed), lambda s: s != "")


def nuggets(text: Column) -> Column:
    """groups of up to three sentences and 500 characters, longer sentences in pieces of 500; those under 20 characters
    and repeated ones go."""
    joined = lambda a: F.array_join(a["held"], " ")
    put = lambda out, x: F.when(F.length(_trimmed(x)) >= LEAST, F.concat(out, F.array(_trimmed(x)))).otherwise(out)
    state = lambda out, held, size: F.struct(out.alias("out"), held.alias("held"), size.cast("int").alias("size"))
    none = F.array().cast("array<string>")

    def step(a: Column, s: Column) -> Column:
        n = F.length(s)
        pieces = F.filter(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / MOST).cast("int")), lambda k: _trimmed(F.substr(s, k * MOST + 1, F.lit(MOST)))), lambda p: F.length(p) >= LEAST)
        full = (a["size"] + n + 1 > MOST) & (F.size(a["held"]) > 0)
        out, held, size = F.when(full, put(a["out"], joined(a))).otherwise(a["out"]), F.when(full, none).otherwise(a["held"]), F.when(full, 0).otherwise(a["size"])
        held, size = F.concat(held, F.array(s)), size + n + 1
        whole = F.size(held) >= GROUP
        return F.when(n > MOST, state(F.concat(put(a["out"], joined(a)), pieces), none, F.lit(0))).otherwise(
            state(F.when(whole, put(out, F.array_join(held, " "))).otherwise(out), F.when(whole, none).otherwise(held), F.when(whole, 0).otherwise(size))
        )

    made = F.aggregate(sentences(text), state(none, none, F.lit(0)), step, lambda a: put(a["out"], joined(a)))
    return F.when(F.length(_trimmed(text)) >= LEAST, F.array_distinct(made)).otherwise(none)


# The types of facts, in this order.
FACT_TYPES = (
    ("decision", r"(decide|decision|採用|方針|決定|choose)"),
    ("preference", r"(prefer|preference|好み|避け|avoid)"),
    ("lesson", r"(learned|lesson|教訓|学び|反省|気づき)"),
    ("pattern", r"(pattern|傾向|パターン|いつも)"),
    ("action", r"(todo|next|次|action|対応)"),
)


def fact_key(text: Column) -> Column:
    """Up to twelve words of two characters or more, joined by _, cut to 120 characters."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9぀-ヿ㐀-鿿\s]", " "), r"\s+")
    return F.substring(F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > 1), 1, 12), "_"), 1, 120)


def extracted_facts(rows: DataFrame, row_id: str, text: str, kind: str) -> DataFrame:
    """row, place, fact_type, fact_key, fact_value and confidence of the facts in the first twenty sentences.

    The first fact of each key counts.  A row without any whose kind is not 'context' is one fact at .6.
    """
    names = [k for k, _ in FACT_TYPES]
    lines = F.slice(F.filter(F.transform(F.split(F.col(text), r"[\n。.!?]+"), _trimmed), lambda s: F.length(s) > 10), 1, 20)
    typed = F.transform(lines, lambda s: F.struct(first_match(F.lower(s), FACT_TYPES, F.col(kind)).alias("fact_type"), s.alias("line")))
    keyed = F.transform(F.filter(typed, lambda t: t["fact_type"].isin(names)), lambda t: F.struct(t["fact_type"].alias("fact_type"), F.concat_ws(":", t["fact_type"], fact_key(t["line"])).alias("fact_key"), F.substring(t["line"], 1, 500).alias("fact_value")))
    firsts = F.filter(keyed, lambda t, i: ~F.exists(F.slice(keyed, 1, i), lambda u: u["fact_key"] == t["fact_key"]))
    seed = F.substring(_trimmed(F.coalesce(F.col(text), F.lit(""))), 1, 500)
    alone = F.array(F.struct(F.col(kind).alias("fact_type"), F.concat_ws(":", F.col(kind), fact_key(seed)).alias("fact_key"), seed.alias("fact_value")))
    found = rows.select(row_id, F.col(kind).alias("_kind"), firsts.alias("_facts"), alone.alias("_alone"), (seed != "").alias("_any"))
    lone = (F.size("_facts") <= 0) & (F.col("_kind") != "context") & F.col("_any")
    used = found.select(row_id, "_kind", lone.alias("_lone"), F.posexplode(F.when(lone, F.col("_alone")).otherwise(F.col("_facts"))).alias("place", "_fact"))
    return used.select(row_id, F.col("place").cast("bigint").alias("place"), "_fact.*", F.when(F.col("_lone"), 0.6).when(F.col("_fact.fact_type") == F.col("_kind"), 0.9).otherwise(0.7).alias("confidence"))


# What is taken for a file and for a name in code.
CODE_NAMES = (("file", r"\b([\w.-]+\.(?:ts|js|py|go|rs|md|json|sh|toml|yaml|yml))\b"), ("symbol", r"\b([A-Z][a-zA-Z0-9]{3,})\b"), ("symbol", r"\b([a-z]{2,}(?:_[a-z]{2,})+)\b"))


def code_names(text: Column, most: int = 20) -> Column:
    """lower-cased names of files, CamelCase and snake_case words, each once, in this order."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(ascii_bounds(p)), F.lit(1)), F.lower) for _, p in CODE_NAMES]
    return F.slice(F.array_distinct(F.concat(*found)), 1, most)


def name_relations(rows: DataFrame, row_id: str, names: Column) -> DataFrame:
    """every pair of a row's names, with the strength 1 / names; at most 190 pairs a row."""
    listed = rows.select(row_id, names.alias("_n"))
    pairs = F.flatten(F.transform("_n", lambda a, i: F.transform(F.slice("_n", i + 2, F.size("_n")), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    return listed.where(F.size("_n") > 1).select(row_id, F.inline(pairs), (1 / F.size("_n")).alias("strength"))


# --- links --------------------------------------------------------------------------------------------------------

# Words that make a row contradict, follow from or belong to the one before it.
LINK_WORDS = (
    ("contradicts", ("however", "but", "instead", "contrary", "矛盾", "しかし")),
    ("causes", ("because", "therefore", "caused by", "results in", "なぜなら", "その結果")),
    ("part_of", ("part of", "belongs to", "component of", "の一部", "に含まれる")),
)


def auto_link(rows: DataFrame, row_id: str, session: str, time: str, title: str, content: str) -> DataFrame:
    """Each row's relation to the one before it in its session, by its words, else by the words their titles share."""
    w = W.partitionBy(session).orderBy(time, row_id)
    pairs = rows.select(row_id, F.lower(content).alias("_c"), F.lower(title).alias("_t"), F.lag(row_id).over(w).alias("to_id"), F.lag(F.lower(title)).over(w).alias("_p")).where("to_id IS NOT NULL")
    long = lambda c: F.filter(F.split(c, r"\s+"), lambda x: F.length(x) > 2)
    mine, before = long(F.col("_t")), F.array_distinct(long(F.col("_p")))
    alike = F.size(F.filter(mine, lambda x: F.array_contains(before, x))) / F.greatest(F.size(before), F.size(mine))
    alike = F.when((F.size(mine) > 0) & (F.size(before) > 0), alike).otherwise(0.0)
    relation = None
    for name, words in LINK_WORDS:
        any_ = None
        for x in words:
            any_ = F.contains("_c", F.lit(x)) if any_ is None else any_ | F.contains("_c", F.lit(x))
        relation = F.when(any_, name) if relation is None else relation.when(any_, name)
    return pairs.select(F.col(row_id).alias("from_id"), "to_id", relation.when(alike >= 0.6, "updates").when(alike >= 0.3, "extends").otherwise("follows").alias("relation"))


def auto_supersede(rows: DataFrame, row_id: str, keys: list[str], number: str, tokens: str, newest: int = 50, threshold: float = 0.1) -> DataFrame:
    """Links to those of the `newest` rows before each row, of its keys, that share enough tokens.

    number: the row's place within its keys.  Rows are cut into chunks of `newest`, and each meets its own chunk and the
    one before by an equi-join, so that a hot key is spread over its chunks.
    """
    base = rows.select(*keys, row_id, F.col(number).alias("_k"), F.col(tokens).alias("_tokens")).where(F.size("_tokens") > 0).withColumn("_chunk", F.floor(F.col("_k") / newest))
    later = base.withColumn("_chunk", F.explode(F.array("_chunk", F.col("_chunk") - 1))).select(*keys, "_chunk", F.col(row_id).alias("from_id"), F.col("_k").alias("_from"), F.col("_tokens").alias("_mine"))
    both = later.join(base, [*keys, "_chunk"]).where((F.col("_k") < F.col("_from")) & (F.col("_k") >= F.col("_from") - newest))
    return both.select("from_id", F.col(row_id).alias("to_id"), jaccard(F.col("_mine"), F.col("_tokens")).alias("weight")).where(F.col("weight") >= threshold)


def contradictions(rows: DataFrame, row_id: str, concept: str, time: str, tokens: str, threshold: float = 0.9, most: int = 50) -> DataFrame:
    """M6: older_id, newer_id, concept and jaccard of the pairs to be judged.

    In each concept the newest 2 * most rows are compared, and the `most` pairs with the newest later row stay; a pair
    of several concepts is one of the first.
    """
    w = W.partitionBy(concept).orderBy(F.col(time).desc(), row_id)
    window = rows.select(concept, row_id, time, tokens, F.row_number().over(w).alias("_n")).where(F.col("_n") <= max(2, 2 * most))
    old = window.select(F.col(concept).alias("concept"), F.col(row_id).alias("older_id"), F.col(time).alias("_old"), F.col(tokens).alias("_a"))
    new = window.select(F.col(concept).alias("concept"), F.col(row_id).alias("newer_id"), F.col(time).alias("newer_time"), F.col(tokens).alias("_b"))
    after = (F.col("_old") < F.col("newer_time")) | ((F.col("_old") == F.col("newer_time")) & (F.col("older_id") < F.col("newer_id")))
    pairs = old.join(new, "concept").where(after).withColumn("jaccard", jaccard(F.col("_a"), F.col("_b"))).where(F.col("jaccard") >= threshold)
    best = pairs.withColumn("_n", F.row_number().over(W.partitionBy("concept").orderBy(F.col("newer_time").desc(), "newer_id", "older_id"))).where(F.col("_n") <= most)
    return best.groupBy("older_id", "newer_id").agg(F.min("concept").alias("concept"), F.max("jaccard").alias("jaccard"))


def confirm_contradictions(pairs: DataFrame, rows: DataFrame, row_id: str, time: str, verdict: Column, confidence: Column, least: float = 0.7) -> DataFrame:
    """M6: 'superseded' links of the pairs that a judge confirms, with the time at which the older row ends; back-dated ones go."""
    at = lambda c, out: rows.select(F.col(row_id).alias(c), F.col(time).alias(out))
    timed = pairs.where(verdict & (confidence >= least)).join(at("older_id", "_old"), "older_id").join(at("newer_id", "valid_to"), "newer_id")
    return timed.where(F.col("valid_to") >= F.col("_old")).select(F.col("newer_id").alias("from_id"), F.col("older_id").alias("to_id"), F.lit("superseded").alias("relation"), "valid_to")


# What says that something is planned, and what says that it is done.
PLANNED = r"(?i)\b(will|plan to|planned to|going to|todo|next action|need to|needs to|should)\b|(予定|する予定|やる|対応する|すべき|次対応|次の対応)"
COMPLETED = r"(?i)\b(completed|done|submitted|shipped|implemented|merged|finished|resolved)\b|(完了|実行済|提出済|対応済|実装済|完了した|終わった)"


def completed_plans(rows: DataFrame, row_id: str, session: str, time: str, tokens: str, planned: Column, done: Column) -> DataFrame:
    """Each planned row with the earliest later row of its session that says done and shares a significant token.

    Plans and evidence are sorted together within each (session, token), where a plan looks back at the last evidence in
    falling time, so no pair of rows is listed.
    """
    both = rows.where(planned | done).select(session, F.col(row_id).alias("_id"), F.col(time).alias("_at"), planned.alias("_plan"), done.alias("_done"), F.explode(F.array_distinct(tokens)).alias("_token"))
    # at one time plans come first, then evidence by falling id: what lies behind a row is later, its last the least id
    as_plan = both.where("_plan").select(session, "_token", "_at", F.lit(0).alias("_side"), "_id", F.lit(None).cast(both.schema["_id"].dataType).alias("_evidence"))
    as_evidence = both.where("_done").select(session, "_token", "_at", F.lit(1).alias("_side"), "_id", F.col("_id").alias("_evidence"))
    w = W.partitionBy(session, "_token").orderBy(F.col("_at").desc(), "_side", F.col("_id").desc()).rowsBetween(W.unboundedPreceding, -1)
    found = as_plan.unionAll(as_evidence).withColumn("_first", F.last(F.when(F.col("_side") == 1, F.struct("_at", "_evidence")), ignorenulls=True).over(w)).where("_side = 0 AND _first IS NOT NULL")
    first = found.groupBy(session, F.col("_id").alias("planned_id")).agg(F.min("_first").alias("_first"))
    return first.select(session, "planned_id", F.col("_first._evidence").alias("evidence_id"))
