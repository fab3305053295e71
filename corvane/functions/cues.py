"""Temporal cues of texts, and the scores of the temporal planner's modes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import ascii_bounds

# The patterns of the cues.
CUES = {
    "current": r"(?i)\b(current|currently|now|latest|active|in use|used now)\b|(今|現在|今の|現行|最新|使っている)|\b(still|continues?|remaining|active|in use|used now)\b|(今も|現在も|まだ|引き続き|継続|使い続け|残っている)",
    "previous": r"(?i)\b(previously|formerly|used to|prior|earlier|before)\b|(以前|前の|前回|前は|もともと|元は|最初は|当初|当時|直後|初期|変える前|見直す前|移す前|切り替える前|変更前)",
    "strong_previous": r"(?-i)\b(previous|previously|former|formerly|prior|earlier|used to|old)\b|(以前|前の|前回|前は|もともと|元は|当初|当時)",
    "no_longer": r"(?i)\b(no longer|not used|not in use|deprecated|removed|inactive|disabled|superseded)\b|(今は使っていない|使っていない|もう.*ない|廃止|終了|無効|不要|やめた|なくなった)",
    "first": r"(?i)\b(first|earliest|initial|initially|at launch|launch)\b|(最初|初回|当初)",
    "latest": r"(?i)\b(last|latest|newest|most recent|recent status)\b|(最後|最新|直近|最近)",
    "after": r"(?i)\b(after|right after|following|since)\b|(直後|その後|以降|の後|後で|あとで)",
    "before": r"(?i)\b(before|prior to|until)\b|(以前|の前|より前|変更前|切り替える前|見直す前)",
}
MODES = ("current", "previous", "previous_current", "no_longer", "after", "before", "first", "latest")


def cue(text: Column, name: str) -> Column:
    return F.coalesce(text.rlike(ascii_bounds(CUES[name])), F.lit(False))


def state_score(mode: str, text: Column, ended: Column, pending: Column) -> Column:
    """how well a row's cues and its state (ended or not yet begun) fit a mode of the planner."""
    has = lambda name, points: F.when(cue(text, name), points).otherwise(0)
    state = lambda when, yes, no=0: F.when(F.coalesce(when, F.lit(False)), yes).otherwise(no)
    if mode == "current":
        return state(ended | pending, -2, 2) + has("current", 3)
    if mode == "previous":
        return has("strong_previous", 4) + has("previous", 1) + state(ended, 1) + has("current", -1)
    if mode == "previous_current":
        return F.when(cue(text, "current") & ~cue(text, "strong_previous"), 4).otherwise(0) + has("latest", -2) + has("no_longer", -1) + state(ended | pending, -1)
    if mode == "no_longer":
        return has("no_longer", 4) + state(ended, 2) + has("current", -1)
    if mode == "first":
        return has("first", 5) + has("previous", 1)
    if mode == "latest":
        return has("latest", 5) + has("current", 2)
    return has(mode, 5)
