"""Visibility and scope predicates as composable Columns; every read combines the ones it needs."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tags that hide a row.
HIDDEN_TAGS = ("private", "secret", "sensitive", "deleted")
NARROW_TAGS = ("private", "sensitive")
EXTERNAL_BLOCKED = ("private", "internal", "secret")




def clamp_limit(value: int | None, fallback: int, low: int, high: int) -> int:
    """A limit within its bounds; None or nonsense gives the fallback."""
    return fallback if not isinstance(value, int) or isinstance(value, bool) else max(low, min(high, value))


def all_of(*parts: Column | None) -> Column:
    """The conjunction of the given predicates; None is passed over."""
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None], F.lit(True))


def in_projects(column: str, members: Sequence[str]) -> Column | None:
    """Equality for one member, IN for several, nothing for none."""
    members = list(members)
    return None if not members else F.col(column) == members[0] if len(members) == 1 else F.col(column).isin(members)


def scope(**wanted) -> Column:
    """Equality for each given field that is not None."""
    return all_of(*(F.col(k) == v for k, v in wanted.items() if v is not None))


def between(column: str, since=None, until=None) -> Column:
    """Inclusive bounds; `until` alone is a read as of that time."""
    return all_of(F.col(column) >= F.lit(since) if since is not None else None, F.col(column) <= F.lit(until) if until is not None else None)


def visible(raw_json: str, hidden: Sequence[str] = HIDDEN_TAGS) -> Column:
    """P5: hides rows with a hiding tag in their JSON array; JSON that can't be read counts as private."""
    tags = F.from_json(F.col(raw_json), "array<string>")
    broken = F.col(raw_json).isNotNull() & (tags.isNull() | F.try_parse_json(raw_json).isNull())
    return ~F.coalesce(F.exists(tags, lambda x: F.lower(x).isin(list(hidden))), F.lit(False)) & ~broken


def untagged(raw_json: str) -> Column:
    """P5b, anchor search: only rows without any privacy tag."""
    return F.col(raw_json).isNull() | (F.regexp_replace(raw_json, r"\s", "") == "[]")


def not_archived(column: str = "archived_at", include: bool = False) -> Column:
    """P6"""
    return F.lit(True) if include else F.col(column).isNull()


def not_expired(now, column: str = "expires_at") -> Column:
    """P7"""
    return F.col(column).isNull() | (F.col(column) > F.lit(now))


def of_types(column: str, values: Sequence[str], most: int = 32, longest: int = 100) -> Column | None:
    """Blanks are dropped, at most 32 values of 100 characters."""
    values = [v.strip()[:longest] for v in values if v and v.strip()][:most]
    return F.col(column).isin(values) if values else None


def tenant(user=None, team=None, user_column: str = "user_id", team_column: str = "team_id") -> Column | None:
    """Own rows, or the team's."""
    if user is None:
        return None
    own = F.col(user_column) == user
    return own | (F.col(team_column) == team) if team is not None else own


def role_access(role: str, user=None, team=None) -> Column | None:
    """P10: administrators see all."""
    return None if role == "admin" else tenant(user, team)


def branch(name: str, column: str = "branch") -> Column:
    """The branch, and rows of no branch."""
    return (F.col(column) == name) | F.col(column).isNull()


def platforms(hidden: Sequence[str], column: str = "platform") -> Column | None:
    """P12"""
    return ~F.col(column).isin(list(hidden)) if hidden else None


def valid_at(t, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open validity [start, end); open where null."""
    return (F.col(start).isNull() | (F.col(start) <= F.lit(t))) & (F.col(end).isNull() | (F.col(end) > F.lit(t)))


def active_fact(*, check_end: bool = True, check_invalidated: bool = False) -> Column:
    """P14, with the two deviating readings as options."""
    return all_of(F.col("merged_into").isNull(), F.col("superseded_by").isNull(), F.col("valid_to").isNull() if check_end else None, F.col("invalidated_at").isNull() if check_invalidated else None)


def encode_cursor(created_at: str, row_id) -> str:
    return base64.urlsafe_b64encode(json.dumps({"created_at": created_at, "id": row_id}).encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, object]:
    got = json.loads(base64.urlsafe_b64decode(cursor))
    return got["created_at"], got["id"]


def after_cursor(created_at, row_id, time_column: str, id_column: str) -> Column:
    """Rows behind a keyset cursor, newest first."""
    t = F.col(time_column)
    return (t < F.lit(created_at)) | ((t == F.lit(created_at)) & (F.col(id_column) < row_id))


def literal_like(column: str, text: str) -> Column:
    """% and _ in the text stand for themselves."""
    return F.col(column).contains(text)


def protected(tags: str, holding: Sequence[str]) -> Column:
    """Any of the tags that forbid archiving."""
    return F.coalesce(F.arrays_overlap(F.col(tags), F.array(*map(F.lit, holding))), F.lit(False))


def external_allowed(tags: str) -> Column:
    """May leave through an external channel."""
    return ~F.coalesce(F.exists(tags, lambda x: F.lower(x).isin(list(EXTERNAL_BLOCKED))), F.lit(False))


def suppressed(text: str, patterns: Sequence[str]) -> Column:
    """P20: any pattern is found in the text."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(text).rlike(p), F.lit(False)) for p in patterns], F.lit(False))


def file_filter(rows: DataFrame, row_id: str, tags: DataFrame, query: str) -> DataFrame:
    """Rows with the provenance tag of a `file:path` of the query, or with a tag that holds the path where no tag is equal to it.

    tags: row_id, tag.  A query without such a word filters nothing.
    """
    paths = re.findall(r"\bfile:(\S+)", query)
    if not paths:
        return rows
    wanted = None
    for path in paths:
        equal, part = tags.where(F.col("tag") == f"file:{path}"), tags.where(F.contains("tag", F.lit(path)))
        none = equal.agg((F.count("*") == 0).alias("_none"))  # one row
        some = equal.select("row_id").unionAll(part.crossJoin(F.broadcast(none)).where("_none").select("row_id"))
        wanted = some if wanted is None else wanted.unionAll(some)
    return rows.join(wanted.select(F.col("row_id").alias(row_id)), row_id, "left_semi")
