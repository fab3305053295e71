"""Document and transcript sources: text goes in as DataFrames of lines or whole files, rows come out by Columns."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import cut


def markdown_chunks(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each heading's section, with level, title and body; text before the first heading has level 0.

    A # inside a code fence opens nothing: the lines of fences are kept from the cut by a mark that is taken off after it.
    """
    fenced = F.split(F.concat(F.lit("\n"), F.col(content)), r"(?m)(?=^(?:```|~~~))")  # every second part opens with a fence that closes the next one
    kept = F.transform(fenced, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, r"\n(?=#)", "\n\u0001")).otherwise(x))
    parts = F.transform(F.split(F.array_join(kept, ""), r"\n(?=#{1,6} )"), lambda x: F.replace(x, F.lit("\u0001"), F.lit("")))
    rows = files.select(path, F.posexplode(parts).alias("position", "chunk"))
    head = F.regexp_extract("chunk", r"^(#{1,6}) +([^\n]*)", 1)
    out = rows.select(path, F.col("position").cast("bigint").alias("position"), F.length(head).cast("bigint").alias("level"), F.trim(F.regexp_extract("chunk", r"^(#{1,6}) +([^\n]*)", 2)).alias("title"), F.trim(F.regexp_replace("chunk", r"^#{1,6} +[^\n]*", "")).alias("body"))
    return out.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).where((F.col("level") > 0) | (F.col("body") != ""))


#: What opens a top-level definition in each language.
DEFINITIONS = {"python": r"(?m)^(?=(?:async )?def |class |@)", "javascript": r"(?m)^(?=(?:export )?(?:async )?function |(?:export )?class |(?:export )?const )", "go": r"(?m)^(?=func |type )"}


def code_chunks(files: DataFrame, language: str, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each top-level definition."""
    rows = files.select(path, F.posexplode(F.split(content, DEFINITIONS[language])).alias("position", "chunk"))
    return rows.where(F.trim("chunk") != "").select(path, F.col("position").cast("bigint").alias("position"), F.regexp_extract("chunk", r"(?:def|class|function|const|func|type)\s+(\w+)", 1).alias("name"), "chunk")


def html_documents(pages: DataFrame, html: str = "html") -> DataFrame:
    """S17"""
    return pages.withColumn("text", T.html_text(F.col(html))).withColumn("title", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def table_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Cells of Markdown table rows (not the rule under the head), by line; an escaped bar is part of its cell."""
    lines = files.select(path, F.posexplode(F.split(content, r"\r?\n")).alias("line", "raw")).where(F.col("raw").rlike(r"^\s*\|.*\|\s*$") & ~F.col("raw").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace(F.trim("raw"), r"^\||\|$", "")
    return lines.select(path, F.col("line").cast("bigint").alias("line"), F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))).alias("cells"))


#: How plan tables write the states.
PLAN_STATES = (("closed", r"(?i)done|closed|完了|\[x\]"), ("in_progress", r"(?i)wip|in.progress|doing|作業中"), ("blocked", r"(?i)blocked|保留"))


def plan_items(files: DataFrame, **names) -> DataFrame:
    """Work items of plan tables: id, title, state."""
    rows = table_rows(files, **names).where((F.size("cells") >= 3) & F.element_at("cells", 1).rlike(r"[0-9]"))
    state = T.first_match(F.element_at("cells", -1), PLAN_STATES, "planned")
    return rows.select(F.element_at("cells", 1).alias("work_id"), F.element_at("cells", 2).alias("title"), state.alias("status"))


def decisions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Decision records: title, status and date lines, and the body."""
    chunk = markdown_chunks(files, path, content)
    pick = lambda k: F.trim(F.regexp_extract("body", rf"(?im)^\W*{k}\W*[:：]\s*(.+)$", 1))
    return chunk.where("level > 0").select(path, "position", "title", pick("status").alias("status"), pick("date").alias("date"), "body")


def github_issues(raw: DataFrame, value: str = "value") -> DataFrame:
    """Issues from JSON documents."""
    schema = "array<struct<number: bigint, title: string, body: string, state: string, created_at: string, labels: array<struct<name: string>>>>"
    rows = raw.select(F.inline(F.from_json(value, schema)))
    return rows.select("number", "title", F.coalesce("body", F.lit("")).alias("body"), "state", F.try_to_timestamp("created_at").alias("created_at"), F.transform(F.coalesce("labels", F.array().cast("array<struct<name: string>>")), lambda x: x["name"]).alias("labels"))


_SESSION = "type string, timestamp string, sessionId string, summary string, isMeta boolean, message struct<role: string, content: string>"


def session_transcript(lines: DataFrame, path: str = "path", position: str = "position", value: str = "value") -> DataFrame:
    """User, assistant and summary rows of JSON lines transcripts; tool results and meta prompts go, and an assistant's repeat of its text right before."""
    rows = lines.select(path, position, F.from_json(value, _SESSION).alias("e")).where(F.col("e.type").isin("user", "assistant", "summary") & ~F.coalesce("e.isMeta", F.lit(False)))
    blocks = F.from_json("e.message.content", "array<struct<type: string, text: string>>")
    plain = F.when(F.col("e.type") == "summary", F.col("e.summary")).when(F.col("e.message.content").rlike(r"^\s*\["), F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")).otherwise(F.col("e.message.content"))
    rows = rows.select(path, position, F.col("e.type").alias("kind"), F.col("e.sessionId").alias("session_id"), F.try_to_timestamp("e.timestamp").alias("ts"), plain.alias("content")).where(F.trim(F.coalesce("content", F.lit(""))) != "")
    w = W.partitionBy(path, "kind").orderBy(position)
    repeat = (F.col("kind") == "assistant") & F.lag("content").over(w).eqNullSafe(F.col("content"))
    return rows.withColumn("_repeat", repeat).where("NOT _repeat").drop("_repeat").withColumn("dedupe_hash", F.sha2(F.concat_ws("|", path, F.col(position).cast("string"), "content"), 256))


def hook_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Prompt, reply, edit and command rows of hook logs, whatever field has the text."""
    j = lambda p: F.get_json_object(value, p)
    content = F.coalesce(j("$.prompt"), j("$.text"), j("$.response"), j("$.command"), j("$.file_path"))
    kind = F.when(j("$.prompt").isNotNull(), "user_prompt").when(j("$.command").isNotNull() | j("$.file_path").isNotNull(), "tool_use").otherwise("checkpoint")
    return lines.where(F.try_parse_json(value).isNotNull()).select(F.coalesce(j("$.conversation_id"), j("$.session_id")).alias("session_id"), kind.alias("event_type"), content.alias("content"), F.try_to_timestamp(F.coalesce(j("$.timestamp"), j("$.ts"))).alias("ts")).where("content IS NOT NULL")


def url_allowed(url: str) -> bool:
    """S20 for a single URL on the driver."""
    host = re.match(T.URL_HOST, url or "")
    return bool(host and re.match(T.ALLOWED_SCHEME, url)) and not re.match(T.PRIVATE_HOST, host[1].lower())


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow right after a scan: each line's number and byte offset within its block of the file."""
    now, number, offset = None, 0, 0
    for batch in batches:
        paths, blocks, sizes = (batch.column(k).to_pylist() for k in (0, 1, 2))
        numbers, offsets = [], []
        for path, block, size in zip(paths, blocks, sizes):
            if now != (path, block):
                now, number, offset = (path, block), 0, 0
            numbers.append(number)
            offsets.append(offset)
            number, offset = number + 1, offset + size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names, "number", "at"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files: path, position (line number from 0), offset (of its first byte in the file) and value.

    Files are split between tasks as Spark splits text, so a file of any size is read by many tasks.  A task numbers the lines of its
    blocks as they come; the lines are stored, and what the earlier blocks of a file hold (a row a block) is added.  Lines end with \\n;
    a \\r before it is not part of the value.  The last line may lack its end; an empty file has no line.  Offsets in compressed files are
    those of the text; a byte order mark is not counted.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), (F.octet_length("value") + 1).cast("bigint").alias("size"), "value")
    lines = cut(raw.mapInArrow(_places, "path string, block bigint, size bigint, value string, number bigint, at bigint"), "lines")
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    blocks = blocks.select("path", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("bigint")).alias(c) for c in ("n", "bytes")))
    placed = lines.join(blocks, ["path", "block"])
    return placed.select("path", (F.col("n") + F.col("number")).alias("position"), (F.col("bytes") + F.col("at")).alias("offset"), F.regexp_replace("value", "\r$", "").alias("value"))


def prompt_history(lines: DataFrame, path: str = "path", position: str = "position", value: str = "value") -> DataFrame:
    """One row for each JSON object of a prompt history; what a tool or the assistant wrote is tool use, all else a prompt."""
    j = lambda k: F.nullif(F.get_json_object(value, f"$.{k}"), F.lit(""))
    objects = lines.where(F.col(value).rlike(r"^\s*\{") & F.try_parse_json(value).isNotNull())
    kind = F.when(j("role").isin("assistant", "tool"), "tool_use").otherwise("user_prompt")
    when = F.try_to_timestamp(F.coalesce(j("ts"), j("timestamp")))
    mark = F.sha2(F.concat_ws(":", path, F.col(position).cast("string"), F.trim(value)), 256)
    return objects.select(path, position, kind.alias("event_type"), F.coalesce(j("session_id"), j("thread_id"), F.lit("history")).alias("session_id"), when.alias("ts"), F.coalesce(j("text"), j("content")).alias("content"), mark.alias("dedupe_hash"))


#: How a planner's log says that it was asked, and where the two kinds of agent files lie.
PLANNER_LINE = r"(?i)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{3})?).*Requesting planner with (\d+) chat messages\b"
AGENT_FILES = (("checkpoint", r"/docs/checkpoints/"), ("agent_response", r"/logs/codex-responses/"))
RESPONSE_TOOLS = (("design", r"(?i)^(?:design|analyze)-"), ("debug", r"(?i)^debug-"))


def planner_log(lines: DataFrame, path: str = "path", position: str = "position", value: str = "value") -> DataFrame:
    """A checkpoint for each request to the planner, with the number of chat messages; the prompts are not in the log."""
    line = F.trim(value)
    hits = lines.where(line.rlike(PLANNER_LINE))
    messages = F.regexp_extract(line, PLANNER_LINE, 2).try_cast("bigint")
    return hits.select(path, position, F.try_to_timestamp(F.regexp_extract(line, PLANNER_LINE, 1)).alias("ts"), messages.alias("messages"), F.sha2(F.concat_ws(":", path, F.col(position).cast("string"), value), 256).alias("dedupe_hash"))


def agent_files(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Checkpoints and responses by their folder: title (first heading, else by the name), whole content, and the tool of a response.

    Rows of other folders and blank files go; equal contents of a file have equal marks.
    """
    body, name = F.regexp_replace(content, r"^\s+|\s+$", ""), F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"(?<=.)\.[^.]*$", "")
    rows = files.select(path, T.first_match(F.replace(path, F.lit("\\"), F.lit("/")), AGENT_FILES, None).alias("kind"), body.alias("content"), name.alias("stem")).where("kind IS NOT NULL AND content <> ''")
    tool = F.when(F.col("kind") == "agent_response", T.first_match(F.col("stem"), RESPONSE_TOOLS, "review"))
    heading = F.nullif(F.trim(F.regexp_extract("content", r"(?m)^[ \t]*#+[ \t]*([^#\s][^\n]*)$", 1)), F.lit(""))
    title = F.coalesce(F.left(heading, F.lit(200)), F.concat_ws(": ", F.coalesce(tool, F.col("kind")), "stem"))
    return rows.select(path, "kind", title.alias("title"), "content", tool.alias("tool"), "stem", F.sha2(F.concat_ws(":", path, F.sha2("content", 256)), 256).alias("dedupe_hash"))


def jdbc_incremental(spark: SparkSession, url: str, relation: str, column: str, above: int, partitions: int = 8, upper: int | None = None, **options) -> DataFrame:
    """Rows of a database table beyond a stored row id; with an upper bound the read is split."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"(SELECT * FROM {relation} WHERE {column} > {int(above)}) AS t").options(**options)
    if upper is not None:
        reader = reader.option("partitionColumn", column).option("lowerBound", above).option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()
