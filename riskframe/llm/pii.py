"""Personal data by weak supervision.

Candidates come from exact base patterns (email, ip, card, phone) and from looser ones (spelled-out
emails, phone numbers without a country code, account numbers, social-security numbers, secrets).
Five labelers vote on each candidate (+1 personal, -1 not, 0 don't know): form, check digits and
ranges, gazetteers, words nearby, and word borders. Expectation-maximisation over the counts of all
vote patterns of all documents estimates each labeler's reliability, and a logistic span classifier
is trained on the resulting probabilities, with kind and shape as further inputs. Base spans always
stay; a looser candidate becomes a span if the classifier accepts it and no base span overlaps it.

Only counts per (kind, votes, shape) reach the driver: their number is bounded by the kinds, votes
and shapes, not by the data.

Rows: null text counts as empty and has no spans. Repeated rows are judged alike. Columns keep their
values; a column named ``spans`` is replaced. Scans are linear in the text, whatever the number of spans. An empty table gives
no rows.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "secret", "ssn")
LABELERS = 5
NEAR = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can't start inside a run of digits: one from the run's start would have come first
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

SPELLED = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}+\b")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w.-])")
SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)(?:sk|pk|ghp|xoxb|xoxp)[-_][A-Za-z0-9_-]{12,}+(?!\w)")
ASSIGNED = re.compile(r"[=:]")
SECRET_NAME = re.compile(r"(?i)(?:passw(?:or)?d|pwd|token|secret|api[_-]?key) ?$")
SECRET_VALUE = re.compile(r" ?\"?([^\s\"']{6,}+)")
KEY_STARTS = ("AKIA", "ASIA", "sk-", "sk_", "pk_", "pk-", "ghp_", "ghp-", "xox")

#: Words and names that labelers know.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co de fr es it nl be at ch uk us ca au nz jp cn in br mx se no dk fi pl pt ru ie eu".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91", "351", "353", "358")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "22", "35", "36", "60", "62", "65")
CONTEXT = {
    "email": "mail email contact write reach to",
    "ip": "ip host server address login client addr",
    "card": "card visa credit payment mastercard pay",
    "phone": "call phone tel mobile fax telephone cell dial",
    "account": "iban account bank konto compte cuenta",
    "secret": "password passwd token secret key api login credential",
    "ssn": "ssn social security tax",
}
CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
OTHER_USE = frozenset("version section page figure isbn order chapter table part serial item no".split())


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the looser patterns; spans of one kind don't overlap."""
    out = []
    if "dot" in text:
        out += [("email", *m.span()) for m in SPELLED.finditer(text)]
    for sign in ASSIGNED.finditer(text):
        at = sign.start()
        if SECRET_NAME.search(text[max(0, at - 12):at]) and (m := SECRET_VALUE.match(text, at + 1)):
            out.append(("secret", *m.span(1)))
    if any(k in text for k in KEY_STARTS):
        out += [("secret", *m.span()) for m in KEY.finditer(text)]
    if DIGIT.search(text):
        for kind, pattern in (("phone", LOCAL_PHONE), ("ssn", SSN), ("account", ACCOUNT)):
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def _entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _form(kind, value, text, start, end, base) -> int:
    return 1 if base or kind in ("secret", "ssn") else 0


def _checked(kind, value, text, start, end, base) -> int:
    digits = "".join(filter(str.isdigit, value))
    if kind == "account":
        plain = value.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    if kind == "secret":
        return 1 if _entropy(value) >= 2.8 and any(map(str.isdigit, value)) else -1
    if kind == "phone":
        return 1 if len(set(digits)) > 2 else -1
    return 1 if base else 0


def _known(kind, value, text, start, end, base) -> int:
    if kind == "email":
        return 1 if re.split(r"[. )\]]", value.lower())[-1] in TOP_DOMAINS else -1
    if kind == "phone" and value[0] == "+":
        return 1 if "".join(filter(str.isdigit, value)).startswith(CALLING_CODES) else -1
    if kind == "card":
        return 1 if value.startswith(ISSUERS) else -1
    if kind == "ip":
        return -1 if value.startswith(("0.", "127.", "255.")) else 0
    if kind == "secret":
        return 1 if KEY.fullmatch(value) else 0
    return 0


def _nearby(kind, value, text, start, end, base) -> int:
    words = set(re.findall(r"[a-z]+", (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR // 2]).lower()))
    return 1 if words & CONTEXT[kind] else -1 if words & OTHER_USE else 0


def _bordered(kind, value, text, start, end, base) -> int:
    outside = text[max(0, start - 1):start] + text[end:end + 1]
    return 1 if all(c.isspace() or c in "\"'()[]<>,;:.=" for c in outside) else -1


VOTERS = (_form, _checked, _known, _nearby, _bordered)


def pattern(kind: str, start: int, end: int, text: str, base: bool) -> tuple:
    """(kind, votes..., length class, digit class) of a candidate."""
    value = text[start:end]
    votes = tuple(f(kind, value, text, start, end, base) for f in VOTERS)
    return (kind, *votes, min(4, len(value) // 8), int(4 * sum(map(str.isdigit, value)) / len(value)))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(personal) of each vote pattern (rows of -1, 0, 1), by EM over labelers that err independently
    given the truth. Starts from the majority; counts are smoothed by one vote of each kind."""
    p = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    for _ in range(rounds):
        log_odds = np.full(len(votes), math.log(((p * counts).sum() + 1) / (((1 - p) * counts).sum() + 1)))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                at = votes[:, j] == v
                yes = ((p * counts)[at].sum() + 1) / ((p * counts).sum() + 3)
                no = (((1 - p) * counts)[at].sum() + 1) / (((1 - p) * counts).sum() + 3)
                log_odds[at] += math.log(yes / no)
        p = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return p


def _inputs(patterns: list[tuple]) -> np.ndarray:
    out = np.zeros((len(patterns), len(KINDS) + 2 * LABELERS + 5 + 5 + 1))
    for i, (kind, *rest) in enumerate(patterns):
        votes, size, digits = rest[:LABELERS], rest[LABELERS], rest[LABELERS + 1]
        out[i, KINDS.index(kind)] = 1
        for j, v in enumerate(votes):
            out[i, len(KINDS) + 2 * j + (v > 0)] = v != 0
        out[i, len(KINDS) + 2 * LABELERS + size] = 1
        out[i, len(KINDS) + 2 * LABELERS + 5 + digits] = 1
        out[i, -1] = 1
    return out


def span_classifier(patterns: list[tuple], counts: list[int]) -> dict[str, float]:
    """Pattern -> P(personal), by a logistic model trained on the EM's probabilities."""
    if not patterns:
        return {}
    n = np.array(counts, float)
    votes = np.array([p[1:1 + LABELERS] for p in patterns])
    y, x = reliabilities(votes, n), _inputs(patterns)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(60):  # Newton steps with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (q - y)) + 1e-3 * w
        w -= np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
    return {json.dumps(p): float(v) for p, v in zip(patterns, 1 / (1 + np.exp(-x @ w)), strict=True)}


def _candidates(text: str):
    """Base spans, and looser ones that no base span overlaps."""
    base = base_spans(text)
    loose, taken = [], sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]  # reach[i]: end of the first i spans
    for kind, s, e in sorted(set(loose_spans(text)), key=lambda c: (c[1], -c[2], c[0])):
        if reach[bisect_left(starts, e)] <= s and not any(a < e and s < b for _, a, b in loose[-1:]):
            loose.append((kind, s, e))
    return base, loose


def train(docs: DataFrame) -> dict[str, float]:
    """The span classifier of all documents' candidates."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen = Counter()
            for text in f["text"]:
                if text:
                    base, loose = _candidates(text)
                    for spans, is_base in ((base, True), (loose, False)):
                        seen.update(json.dumps(pattern(k, s, e, text, is_base)) for k, s, e in spans)
            if seen:
                yield pd.DataFrame({"pattern": list(seen), "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: r["pattern"])
    return span_classifier([tuple(json.loads(r["pattern"])) for r in rows], [r["n"] for r in rows])


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def _finder(docs: DataFrame, threshold: float) -> Callable[[str | None], list[tuple[str, int, int, bool]]]:
    """The spans of a text, as ``find_personal_data`` orders them, by the classifier of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs.select(F.col("text").cast("string").alias("text"))))
    order = {k: i for i, k in enumerate(KINDS)}

    def find(text):
        base, loose = _candidates(text) if text else ([], [])
        found = [(k, s, e, True) for k, s, e in base]
        found += [(k, s, e, False) for k, s, e in loose
                  if model.value.get(json.dumps(pattern(k, s, e, text, False)), 0.0) >= threshold]
        return sorted(found, key=lambda x: (order[x[0]], x[1], x[2]))

    return find


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``spans``: (kind, start, end, base) in code points, by kind (base kinds first, as
    listed), then start."""
    docs = bounded_batches(docs).drop("spans")
    find = _finder(docs, threshold)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in find(text)] for text in texts])

    return docs.withColumn("spans", spans(F.col("text").cast("string")))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``n_chars``, if there, follows.

    Spans are found and cut in one function: two in a row would run a second Python worker for each task.
    """
    docs = bounded_batches(docs).drop("spans")
    find = _finder(docs, threshold)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            parts, at = [], 0
            for kind, start, end, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
                if start >= at:
                    parts += [text[at:start], f"<{kind}>"]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]) if at else text)
        return pd.Series(out, dtype=object)

    out = docs.withColumn("text", cut(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
