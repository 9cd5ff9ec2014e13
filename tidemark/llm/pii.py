"""Personal-data spans by weak supervision.

Base matches of four kinds (email, ip, card, phone) always stand. Beside them a
wider set of candidate spans is drawn up (assigned secrets, local phone numbers,
written-out addresses, and base shapes that failed their test). Regular
expression, gazetteer and context labelers vote on each candidate; expectation
maximisation over the counts of vote patterns estimates how reliable each
labeler is, and its posteriors train a logistic classifier on span features. Its
weights score every candidate by its features, whatever votes it had; one that
is accepted, and overlaps no span already held, is added.

Only counts by pattern reach the driver: votes and features are small integers,
so there are at most 3^7 * 2^12 patterns however large the corpus is. The counts
cover every document.

Edge cases: a null or empty text has no span; offsets are code points; repeated
rows give repeated results; an empty table gives an empty result (the classifier
then accepts nothing); other columns are ignored or, in ``redact``, kept.
Very long texts are scanned whole and each pattern is linear in their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, prepare, text_rows

KINDS = ("email", "ip", "card", "phone", "secret")

#: The parts of an address after the name; the name is read backwards from the sign, so long words stay linear.
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ASSIGNED = re.compile(r"[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/_-]{16,})")
LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
WRITTEN_AT = re.compile(r" ?[(\[](?:at|AT)[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[](?:dot|DOT)[)\]]|\.) ?[A-Za-z0-9-]{2,63}){1,4}")
KEY = re.compile(r"([A-Za-z][A-Za-z0-9_-]{1,40})[\"']?[ \t]{0,3}$")

#: Fixed word lists of the gazetteer labelers.
SECRET_KEYS = frozenset({"token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "private_key", "auth_token", "credential", "bearer"})
CONTACT_WORDS = frozenset({"phone", "tel", "telephone", "mobile", "call", "fax", "email", "mail", "contact", "card", "visa", "mastercard", "amex", "ip", "host", "address", "server"})
PLACEHOLDERS = ("changeme", "placeholder", "xxxx", "0000000", "1234567", "abcdef0")
PLAIN_WORDS = frozenset({"version", "isbn", "issn", "figure", "table", "page", "section", "chapter", "no", "nr", "id"})

ACCEPT = 0.5
N_VOTES = 7
N_FEATURES = 12
PATTERN = fields(("votes", T.IntegerType()), ("features", T.IntegerType()), ("n", T.LongType()))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping addresses, as one regular expression over the text would find them."""
    last, pos = 0, 0
    while (m := AT_DOMAIN.search(text, pos)) is not None:
        start = m.start()
        while start > last and text[start - 1] in NAME_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            last = pos = m.end()
        else:
            pos = m.start() + 1


def base_matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the matches that hold, and of those that fail their test."""
    good: list[tuple[int, int, int]] = []
    bad: list[tuple[int, int, int]] = []
    if "@" in text:
        good += [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = m.group().split(".")
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
        (good if ok else bad).append((1, *m.span()))
    for m in CARD.finditer(text):
        a, b = m.span()
        if b - a < 12:
            continue
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            (good if luhn(digits) else bad).append((2, a, b))
    if "+" in text:
        for m in PHONE.finditer(text):
            n = sum(c in "0123456789" for c in m.group())
            (good if 9 <= n <= 15 else bad).append((3, *m.span()))
    return good, bad


def overlaps(span: tuple[int, int, int], held: list[tuple[int, int, int]]) -> bool:
    return any(span[1] < b and a < span[2] for _, a, b in held)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[tuple[int, int, int], bool]]]:
    """The base spans, and all candidates with whether each is a base span."""
    good, bad = base_matches(text)
    wide: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        wide += [(4, *m.span(1)) for m in ASSIGNED.finditer(text)]
    wide += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]
    if "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        for m in WRITTEN_AT.finditer(text):
            start = m.start()
            while start and text[start - 1] in NAME_CHARS and m.start() - start < 64:
                start -= 1
            if start < m.start():
                wide.append((0, start, m.end()))
    rest = sorted({x for x in [*bad, *wide] if x[1] < x[2]}, key=lambda x: (x[1], -x[2], x[0]))
    if good and rest:
        held = sorted(good, key=lambda x: x[1])
        rest = [x for x in rest if not overlaps(x, held)] if len(held) * len(rest) < 4096 else without(rest, held)
    return good, [(x, True) for x in good] + [(x, False) for x in rest]


def without(spans: list[tuple[int, int, int]], held: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (by start) that overlap none of ``held``, in one sweep over both."""
    edges = np.array(sorted((a, b) for _, a, b in held))
    reach = np.maximum.accumulate(edges[:, 1])
    out = []
    for s in spans:
        k = int(np.searchsorted(edges[:, 0], s[2], "left"))
        if k == 0 or reach[k - 1] <= s[1]:
            out.append(s)
    return out


def describe(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """The packed votes (base 3: abstain 0, for 1, against 2) and features (bits) of a candidate."""
    kind, a, b = span
    s = text[a:b]
    before, after = text[max(0, a - 48) : a], text[b : b + 2]
    digits = sum(c in "0123456789" for c in s)
    distinct = len(set(s.lower()))
    hexes = all(c in "0123456789abcdefABCDEF" for c in s)
    key = ""
    if kind == 4:
        trimmed = before.rstrip("\"' \t")
        m = KEY.search(trimmed[:-1]) if trimmed[-1:] in (":", "=") else None
        key = m.group(1).lower() if m else ""
    words = re.findall(r"[A-Za-z]+", before[-32:].lower())
    near = set(words[-3:])
    left, right = before[-1:], after[:1]
    glued = bool(left) and (left.isalnum() or left == "_") or bool(right) and (right.isalnum() or right == "_")
    # regular-expression labelers: the validity test of the kind, and its strict shape
    if kind == 1:
        valid = all(len(p) <= 3 and int(p) <= 255 for p in s.split("."))
    elif kind == 2:
        valid = luhn("".join(c for c in s if c in "0123456789"))
    elif kind == 3:
        valid = 9 <= digits <= 15
    elif kind == 4:
        valid = digits >= 4 and digits < len(s) and distinct >= 8
    else:
        valid = "." in s or "dot" in s.lower()
    strict = kind == 0 and "@" in s or kind == 1 and valid or kind == 2 and valid and digits >= 13 or kind == 3 and s[0] == "+" or kind == 4 and hexes and len(s) >= 32
    # gazetteer labelers
    keyed = key in SECRET_KEYS or any(key.endswith(x) for x in ("_token", "_secret", "_password", "_key")) if kind == 4 else bool(near & CONTACT_WORDS)
    filler = any(p in s.lower() for p in PLACEHOLDERS)
    plain = bool(set(words[-1:]) & PLAIN_WORDS)
    # context labelers
    quoted = left in ("'", '"') and right in ("'", '"')
    listed = bool(re.search(r"[0-9][ ,;|\t]+$", before)) and bool(re.match(r"[ ,;|\t][0-9]", after))
    votes = (
        1 if strict else 2 if kind in (1, 2) else 0,
        1 if valid else 2,
        1 if keyed else 2 if kind == 4 else 0,
        2 if filler or plain else 0,
        2 if glued else 1,
        1 if quoted else 2 if listed else 0,
        2 if distinct <= 3 else 1 if distinct >= 8 else 0,
    )
    bits = (kind == 0, kind == 1, kind == 2, kind == 3, kind == 4, valid, strict, keyed, glued, quoted, distinct >= 8, filler or plain)
    return sum(v * 3**i for i, v in enumerate(votes)), sum(1 << i for i, x in enumerate(bits) if x)


def fit(patterns: list[tuple[int, int, int]], rounds: int = 60) -> list[float] | None:
    """Weights of the span classifier (the bias first), from counts of (votes, features) patterns; None without any.

    Two-class expectation maximisation with one confusion table a labeler, then
    logistic regression of the posteriors on the features by Newton steps.
    """
    if not patterns:
        return None
    patterns = sorted(patterns)
    count = np.array([p[2] for p in patterns], float)
    post = posteriors(patterns, rounds)
    x = np.array([[1.0, *(p[1] >> i & 1 for i in range(N_FEATURES))] for p in patterns])
    w = np.zeros(x.shape[1])
    scale = count / count.sum()
    for _ in range(40):
        z = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (scale * (post - z)) - 1e-4 * w
        hessian = (x * (scale * z * (1 - z))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        w += np.linalg.solve(hessian, gradient)
    return w.tolist()


def posteriors(patterns: list[tuple[int, int, int]], rounds: int = 60) -> np.ndarray:
    """The probability of personal data that expectation maximisation gives each pattern of votes."""
    count = np.array([p[2] for p in patterns], float)
    votes = np.array([[p[0] // 3**i % 3 for i in range(N_VOTES)] for p in patterns])
    yes, no = (votes == 1).sum(1), (votes == 2).sum(1)
    post = (yes + 1.0) / (yes + no + 2.0)  # the majority's view to start from
    for _ in range(rounds):
        prior = np.clip((count * post).sum() / count.sum(), 0.02, 0.98)
        log = np.log(prior) - np.log(1 - prior)
        odds = np.full(len(patterns), log)
        for i in range(N_VOTES):
            for v in (1, 2):
                at = votes[:, i] == v
                voted = votes[:, i] > 0
                p1 = ((count * post)[at].sum() + 1) / ((count * post)[voted].sum() + 2)
                p0 = ((count * (1 - post))[at].sum() + 1) / ((count * (1 - post))[voted].sum() + 2)
                odds[at] += np.log(p1) - np.log(p0)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def probability(features: int, weights: list[float] | None) -> float:
    """The classifier's probability that a span with these features is personal data; 0 without a classifier."""
    if weights is None:
        return 0.0
    z = weights[0] + sum(w for i, w in enumerate(weights[1:]) if features >> i & 1)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """The classifier's weights, learnt from all candidates of ``docs``."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    found.update(describe(t, s) for s, _ in candidates(t)[1])
        v, f, n = [k[0] for k in found], [k[1] for k in found], list(found.values())
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()), pa.array(f, pa.int32()), pa.array(n, pa.int64())], names=PATTERN.names)

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(count, PATTERN).groupBy("votes", "features").agg(F.sum("n").alias("n"))
    return fit([tuple(r) for r in counts.collect()])


def spans_of(text: str, model: list[float] | None, accept: float = ACCEPT) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, by start and then kind."""
    good, found = candidates(text)
    key = lambda x: (x[1], x[0], x[2])
    out, last = list(good), -1
    for s, base in found:
        if not base and s[1] >= last and probability(describe(text, s)[1], model) >= accept:
            out.append(s)
            last = s[2]
    return sorted(good, key=key), sorted(out, key=key)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SPANS = fields(("doc_id", T.LongType()), *((f"n_{k}", T.LongType()) for k in KINDS[:4]), ("base_spans", T.StringType()), ("spans", T.StringType()))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_spans and spans (``kind:start:end``, joined by commas) of every row."""
    prepare(docs.sparkSession)
    learnt = train(docs, text_col) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [spans_of(t or "", learnt) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in both], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([written(x) for x, _ in both], pa.string()), pa.array([written(x) for _, x in both], pa.string())], names=SPANS.names)

    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), *SPANS.fields[1:]]))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for k, a, b in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in angle brackets; a null stays null."""
    prepare(docs.sparkSession)
    learnt = train(docs, text_col) if model is None else model
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if not t else mask(t, spans_of(t, learnt)[1]) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
