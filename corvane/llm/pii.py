"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) are found by fixed patterns and always stay.  Wider candidates (other groups of seven
digits or more, written-out addresses, long tokens of letters and digits) get the votes of five labelers: strict
pattern, gazetteer (top-level domains, card issuers, dialling codes, key prefixes), context words, shape and borders.
The vote patterns of the whole corpus are counted, and expectation-maximisation (Dawid-Skene) estimates each labeler's
reliability from these counts.  The final classifier does not see the votes: it is a logistic regression on the span
itself (length, character classes, entropy, separators) and on hashed words around it, trained on the posteriors of a
bounded sample of candidates (FIT_ROWS, those with the least hashes), and then judges every candidate.  So the
reliabilities come from all rows, while only counts of bounded variety and the sample reach the driver.

Defined cases: null text is empty; offsets are code points with the end exclusive; repeated rows stay, equal texts get
equal spans; candidates and texts of any length are taken whole; where candidates of several kinds overlap, each is
judged; without a candidate nothing is added; an empty table gives an empty table; columns other than the id and the text
are passed over, whatever their names.  Every scan is linear in the length of the text.
"""

from __future__ import annotations

import bisect
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import bounded_sample, stored, text_blocks

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if k % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping spans of each base kind, by start and kind."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if m[0].count(".") >= 3:
                parts, pos = m[0].split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    width = sum(map(len, parts[i : i + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts[i : i + 4]):
                        out.append((pos, 1, pos + width))
                    pos += width + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# The gazetteers and context words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int io info biz name pro mobi app dev ai co me tv cc xyz online site shop tech store cloud de fr es uk us eu it nl be ch at pl cz se no dk fi pt ie gr hu ro ru ua tr jp cn kr in au nz ca br mx ar cl za il".split())
CARD_ISSUERS = re.compile(r"4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|6011|64[4-9]|65|62|35[2-8]|50|5[6-9]|63|67|81")
DIALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 358 370 371 372 380 385 386 420 421 971 972 974".split())
KEY_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "ASIA", "AIza", "eyJ", "ya29.", "SG.", "hf_", "npm_", "rk_live_", "sk_live_")
CONTEXT = (
    frozenset("mail email e-mail contact kontakt correo courriel write reach schreiben adresse address".split()),
    frozenset("ip host server address adresse node gateway dns".split()),
    frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta payment iban konto account".split()),
    frozenset("phone tel telephone call mobile cell fax telefon telefono téléphone teléfono anruf ring whatsapp sms".split()),
    frozenset("token key secret password passwd passwort pwd api apikey api_key auth authorization bearer access credential credentials private contraseña".split()),
)
AGAINST = frozenset("version isbn issn page order invoice figure chapter table sha sha1 sha256 md5 commit checksum hash uuid guid revision build article item serial doi pages seite número".split())

_CANDIDATES = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(](?i:at)[\])] ?| (?i:at) )[A-Za-z0-9-]++(?:(?: ?[\[(](?i:dot)[\])] ?| (?i:dot) |\.)[A-Za-z0-9-]++)++")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}+(?![0-9])")),
    (3, re.compile(r"(?<![0-9])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+(?![0-9])")),
    (4, re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+=*+(?![A-Za-z0-9_/+-])")),
)
_KEY = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}")
_HINTS = (re.compile(r"[\[( ](?i:at)[\]) ]"), None, _DIGIT, _DIGIT, _DIGIT)
_WORDS = re.compile(r"[\w-]+")
NEAR, HASHED = 40, 48


def votes(text: str, start: int, kind: int, end: int) -> str:
    """The five labelers on a candidate, behind its kind: + for, - against, . no opinion."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - NEAR) : start])][-4:]
    if kind == 0:
        strict, gazetteer = "+" if "(" in span or "[" in span else "-", "+" if re.split(r"[\s.\])]+", span.lower())[-1] in TOP_DOMAINS else "-"
        shape = "+" if re.search(r"[0-9._]", re.split(r"(?i:at)", span)[0]) else "."
    elif kind == 2:
        strict, gazetteer = "+" if 12 <= len(digits) <= 19 and luhn(digits) else "-", "+" if CARD_ISSUERS.match(digits) else "-"
        shape = "-" if len(set(digits)) < 4 or not 12 <= len(digits) <= 19 else "+" if re.fullmatch(r"(?:[0-9]{4}[ -]?){3,4}[0-9]{0,4}", span) else "."
    elif kind == 3:
        strict = "+" if re.fullmatch(r"\(?[0-9]{2,5}\)?[ .-]{1,2}[0-9]{2,4}([ .-][0-9]{2,4}){1,3}", span) else "-"
        gazetteer = "+" if digits[0] in "23456789" and len(digits) == 10 or text[max(0, start - 1) : start] == "+" or digits.startswith("00") and any(digits[2 : 2 + n] in DIALLING_CODES for n in (1, 2, 3)) else "."
        shape = "-" if len(set(digits)) < 4 or not 7 <= len(digits) <= 15 else "+" if len(digits) >= 10 else "."
    else:
        hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) is not None
        strict = "+" if hexed and len(span) in (32, 40, 48, 64, 96, 128) or _KEY.fullmatch(span) else "-"
        gazetteer = "+" if span.startswith(KEY_PREFIXES) else "."
        shape = "+" if digits and len(set(span)) > 9 else "-"
    context = "+" if any(w in CONTEXT[kind] for w in before) else "-" if any(w in AGAINST for w in before) else "."
    inner = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    given = start > 0 and text[start - 1] in "\"'`" or text[max(0, start - 2) : start] in ("= ", ": ") or text[start - 1 : start] in ("=", ":")
    border = "-" if inner(start - 1) or inner(end) else "+" if given else "."
    return f"{kind}{strict}{gazetteer}{context}{shape}{border}"


def span_features(text: str, start: int, kind: int, end: int) -> list[int]:
    """What the classifier sees, in whole numbers from 0 to 100: kind, length, characters, entropy, separators, and hashed words around."""
    span = text[start:end]
    n, seen = len(span), collections.Counter(span)
    share = lambda ok: 100 * sum(map(ok, span)) // n
    entropy = -sum(c / n * math.log2(c / n) for c in seen.values())
    runs = sum((a.isdigit() and b.isalpha()) or (a.isalpha() and b.isdigit()) for a, b in zip(span, span[1:]))
    out = [100 * (kind == k) for k in range(5)]
    out += [min(100, n), min(100, int(12.5 * math.log2(n + 1))), share(str.isdigit), share(str.isupper), share(str.islower), share(lambda c: c in "abcdefABCDEF0123456789"), share(lambda c: c in " ().-"), share(lambda c: c in "_/+="), min(100, int(entropy * 16)), 100 * runs // n, min(100, 10 * len(seen))]
    tail, head = text[max(0, start - NEAR) : start], text[end : end + NEAR // 2]
    out += [100 * (tail[-1:] in tuple("\"'`")), 100 * (tail.rstrip(" \"'`")[-1:] in tuple("=:")), 100 * (tail[-1:] == "+"), 100 * (head[:1] in tuple("\"'`"))]
    around = [0] * HASHED
    for w in [*_WORDS.findall(tail)[-4:], *_WORDS.findall(head)[:2]]:
        around[zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % HASHED] = 100
    return out + around


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, str, list[int]]]:
    """Spans apart from the base ones that the labelers vote on: start, kind, end, votes, features."""
    out = []
    starts = sorted((s, e) for s, _, e in base)
    reach = list(itertools.accumulate((e for _, e in starts), max))  # furthest end of the base spans so far
    for kind, rx in _CANDIDATES:
        if not _HINTS[kind].search(text):
            continue
        for m in rx.finditer(text):
            k = bisect.bisect_left(starts, (m.end(),)) - 1
            if k < 0 or reach[k] <= m.start():
                where = (m.start(), kind, m.end())
                out.append((*where, votes(text, *where), span_features(text, *where)))
    return sorted(out)


#: Beforehand, P(vote -, ., +) of each labeler for what is no personal data, and for what is: better than chance, and words
#: around a span more than the others.  It names the classes and keeps them apart; PRIOR is the count that it stands for.
BELIEF = np.array([
    [[0.5, 0.35, 0.15], [0.5, 0.35, 0.15], [0.6, 0.38, 0.02], [0.5, 0.35, 0.15], [0.5, 0.35, 0.15]],
    [[0.15, 0.25, 0.6], [0.15, 0.25, 0.6], [0.02, 0.38, 0.6], [0.15, 0.25, 0.6], [0.15, 0.25, 0.6]],
])
PRIOR = 20.0


def fit_reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene EM over counted vote patterns: posterior of each pattern, and P(vote | class) by labeler."""
    seen = np.array([["-.+".index(c) for c in p[1:6]] for p in patterns]).reshape(-1, 5)
    weight, table = PRIOR, BELIEF.copy()
    prior = 0.5
    for _ in range(rounds):
        log = [np.log(table[cls, np.arange(5), seen]).sum(1) for cls in (0, 1)]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1] + np.log((1 - prior) / prior), -30, 30)))
        for cls, w in enumerate(((1 - post) * counts, post * counts)):
            for j in range(5):
                got = np.bincount(seen[:, j], w, 3) + weight * BELIEF[cls, j]
                table[cls, j] = got / got.sum()
        prior = (post @ counts + weight) / (counts.sum() + 2 * weight)
    return post, table


def fit_classifier(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression to soft labels by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (counts * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (counts * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def posteriors(counted: list[tuple[str, int]]) -> dict[str, float]:
    """By EM over the counted vote patterns, how likely each is personal data."""
    counted = sorted(counted)
    post, _ = fit_reliabilities([p for p, _ in counted], np.array([n for _, n in counted], float)) if counted else ([], None)
    return {p: float(v) for (p, _), v in zip(counted, post)}


def trained(sample: list[tuple[str, list[int]]], belief: dict[str, float]) -> list[float]:
    """Weights of the classifier (the last one is the constant), from the votes' posteriors of some candidates."""
    sample = sorted(sample)
    x = np.column_stack([np.array([f for _, f in sample], float) / 100, np.ones(len(sample))])
    return fit_classifier(x, np.array([belief[v] for v, _ in sample]), np.ones(len(sample))).tolist()


#: Candidates that the classifier is trained on, at most.
FIT_ROWS = 20_000
_SPAN = "struct<start: int, kind: int, end: int>"
_FOUND = f"doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base array<{_SPAN}>, more array<struct<start: int, kind: int, end: int, votes: string, seen: array<smallint>>>"


def _scan(rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
    data, out = buf.tobytes(), [[] for _ in range(7)]
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
        text = data[lo:hi].decode()
        base = base_spans(text)
        kinds = [s[1] for s in base]
        for c, k in zip(out, range(4)):
            c.append(kinds.count(k))
        out[4].append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
        out[5].append([{"start": s, "kind": k, "end": e} for s, k, e in base])
        out[6].append([{"start": s, "kind": k, "end": e, "votes": v, "seen": f} for s, k, e, v, f in candidates(text, base)])
    span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("votes", pa.string()), ("seen", pa.list_(pa.int16()))]))]
    return pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "more"])


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Base counts and hash, n_secret and n_spans with what the classifier adds, and all `spans`."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    found = stored(rows.mapInArrow(text_blocks(_scan, "text", 1 << 20), _FOUND), "pii")
    each = found.select("doc_id", F.inline("more"))
    belief = posteriors([(r.votes, r["count"]) for r in each.groupBy("votes").count().collect()])  # at most 5 kinds x 3^5 votes
    weights = None
    if belief:
        sample = bounded_sample(each, fit_rows, *map(F.col, ("doc_id", "start", "kind", "end"))).select("votes", "seen").collect()
        weights = F.array(*map(F.lit, trained([(r.votes, r.seen) for r in sample], belief)))
    bare = lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end"))

    def chosen(s):
        terms = F.zip_with(F.concat(s.seen.cast("array<double>"), F.array(F.lit(100.0))), weights, lambda a, b: a * b / 100)
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) >= float(np.log(threshold / (1 - threshold)))

    added = F.transform(F.filter("more", chosen) if weights is not None else F.filter("more", lambda s: F.lit(False)), bare)
    found = found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_sort(F.concat("base", added)).alias("all"), F.size("base").alias("n_base"))
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string")))
    count = lambda c: c.cast("bigint")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", count(F.size("all") - F.col("n_base")).alias("n_added"),
        count(F.size(F.filter("all", lambda s: s.kind == KINDS.index("secret")))).alias("n_secret"), count(F.size("all")).alias("n_spans"), F.array_join(shown, ",").alias("spans"))
