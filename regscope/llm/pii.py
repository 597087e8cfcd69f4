"""Personal data by weak supervision.

Base finders (fixed patterns) mark e-mail addresses, IP addresses, card and
phone numbers. Beyond them every other token with a digit or an ``@`` is a
candidate, and so is one of letters only that is assigned to a secret field,
follows the name of one with ``:`` or ``=`` (or ``Bearer``), or starts like a
known key. Labelers of three sorts vote on it (+1 private, -1 not, 0 no vote):

* regex: shapes of keys, assigned secrets, long hex, long numbers, versions;
* gazetteer: known key prefixes, names of secret fields, harmless number words;
* context: cue words before the token, base spans close by.

Expectation-maximisation on the vote patterns estimates how reliable each
labeler is on either class and the posterior of each pattern (a naive Bayes
model with a hidden class). A logistic span classifier is then trained on the
candidates' own features against those posteriors, and the candidates it
accepts are added as spans of kind ``secret``. Base spans always stay.

Votes and features are small discrete patterns: Spark counts each pair of
patterns over all documents and only those counts, bounded by the number of
patterns, reach the driver. All matching is linear in the text: numbers start
only where a run of digits starts, and an address grows from its ``@``.

Cases: null and empty texts have no spans. Repeated rows are found alike.
Offsets are code points, end exclusive. Without candidates the classifier
accepts nothing. Texts are read whole. Other columns pass through ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile("[0-9@]")
TOKEN = re.compile(r"(?<!\S)(?=\S*?[0-9@])\S++")
SOLID = re.compile(r"\S++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each ``@`` takes the whole run of local characters
    before it, no further back than the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # A run before a later @ can't reach back over this one.
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def _number(pattern: re.Pattern, text: str, valid) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if valid(m.group()):
            yield m.start(), m.end()


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in s) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind index, start, end), by kind and then start."""
    if not text or not HINT.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for k, pattern, valid in ((1, IP, _ip_ok), (2, CARD, _card_ok), (3, PHONE, _phone_ok)):
        out += [(k, a, b) for a, b in _number(pattern, text, valid)]
    return out


# -- labelers and features of other candidates --------------------------------
# FIXED VALUES of the gazetteers.
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "AIza")
SECRET_FIELDS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "key", "auth", "bearer")
HARMLESS_WORDS = ("version", "license", "section", "chapter", "page", "figure", "table", "by", "by-nc", "year", "by-sa")

FIELD = r"(?:password|passwd|pwd|token|secret|api_?key)"
HAS_FIELD = re.compile(f"(?i){FIELD}")
# A whole name before = or :, so that each run of letters is read once.
NAMED = re.compile(r"(?<![A-Za-z_])([A-Za-z_]++)[\"']?[=:](?=\S{6})")
# Where a secret without digits may stand: in this token, or in the next one.
LETTERS = re.compile(rf"(?<![A-Za-z_])(?P<name>[A-Za-z_]++)[\"']?(?:(?P<own>[=:](?=\S{{6}}))|\s?(?:=>?|:)\s++(?=\S{{8}}))"
                     rf"|(?<!\S)[Bb]earer\s++(?=\S{{8}})|(?P<key>(?<![A-Za-z0-9])(?:{'|'.join(KEY_PREFIXES)})(?=\S{{8}}))")
# What a text must hold for any of these, looked for before the patterns.
FIELD_PARTS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "bearer")
HEXES = re.compile(r"(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{16,}")
KEYLIKE = re.compile(r"(?=[0-9]*[A-Z])(?=[A-Z]*[0-9])[A-Z0-9]{16,}")
PLAIN_NUMBER = re.compile(r"[0-9][0-9.,:/-]*")
VERSION = re.compile(r"v?\d{1,3}(\.\d{1,3}){0,2}\.?")
EDGE = "\"'.,;:!?()[]{}<>#*|`~"


@dataclass
class Candidate:
    start: int
    end: int
    votes: str
    features: str


def assigned(token: str) -> bool:
    return any(HAS_FIELD.search(m[1]) for m in NAMED.finditer(token))


def tokens(text: str) -> list[tuple[int, int]]:
    """Spans between white space that may be private, in order."""
    spans = {m.span() for m in TOKEN.finditer(text)} if HINT.search(text) else set()
    lowered = text.lower()
    if any(w in lowered for w in FIELD_PARTS) or any(w in text for w in KEY_PREFIXES):
        last = 0
        for m in LETTERS.finditer(text):
            if m["name"] and not HAS_FIELD.search(m["name"]):
                continue
            start = m.start() if m["own"] or m["key"] else m.end()
            if start < last:
                continue
            while start > last and not text[start - 1].isspace():
                start -= 1
            last = SOLID.match(text, start).end()
            spans.add((start, last))
    return sorted(spans)


def candidates(text: str | None, base: list[tuple[int, int, int]]) -> Iterator[Candidate]:
    """The tokens that no base span touches, without outer punctuation."""
    if not text:
        return
    taken = sorted((a, b) for _, a, b in base)
    i = 0
    for first, end in tokens(text):
        start = first
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if start == end or (i < len(taken) and taken[i][0] < end):
            continue
        token = text[start:end]
        before = text[max(0, first - 60):first].split()[-3:]
        cues = [w.strip(EDGE + "=").lower() for w in before]
        near = (i < len(taken) and taken[i][0] - end <= 20) or (i > 0 and start - taken[i - 1][1] <= 20)
        digits = sum(c.isdigit() for c in token)
        short = len(token) < 8
        votes = (
            1 if assigned(token) else 0,                                                           # regex
            1 if KEYLIKE.fullmatch(token) or HEXES.fullmatch(token) else -1 if short else 0,      # regex
            -1 if VERSION.fullmatch(token) else 0,                                                # regex
            -1 if PLAIN_NUMBER.fullmatch(token) else 0,                                           # regex: failed the base checks
            1 if token.startswith(KEY_PREFIXES) else 0,                                           # gazetteer
            1 if any(c in SECRET_FIELDS for c in cues) else -1 if any(c in HARMLESS_WORDS for c in cues) else 0,  # gazetteer
            1 if before and before[-1] in ("=", ":", "=>") else 0,                                # context
            1 if near and not short else 0,                                                       # context
        )
        shape = ("u" if token.isupper() else "l" if token.islower() else "d" if token.isdigit() else "m")
        mixed = sum((any(c.isdigit() for c in token), any(c.isalpha() for c in token), any(not c.isalnum() for c in token)))
        features = (min(5, len(token) // 6), shape, min(4, 5 * digits // len(token)), "=" in token or ":" in token, mixed)
        yield Candidate(start, end, ",".join(map(str, votes)), ",".join(str(int(f)) if not isinstance(f, str) else f for f in features))


def em(votes: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior, reliabilities [class, labeler, vote] and the posterior of each pattern."""
    n, m = votes.shape
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    # Labelers agree with the majority at first, which also fixes which class is private.
    post = 1 / (1 + np.exp(-2.0 * votes.sum(axis=1) + 0.5))
    prior, tables = 0.5, np.full((2, m, 3), 1 / 3)
    for _ in range(rounds):
        mass = np.stack([weight * (1 - post), weight * post])
        prior = float((mass[1].sum() + 1) / (weight.sum() + 2))
        tables = np.einsum("cn,nmv->cmv", mass, hot) + 0.5
        tables /= tables.sum(axis=2, keepdims=True)
        ll = np.log([1 - prior, prior])[:, None] + np.einsum("nmv,cmv->cn", hot, np.log(tables))
        new = 1 / (1 + np.exp(np.clip(ll[0] - ll[1], -60, 60)))
        if np.abs(new - post).max() < 1e-7:
            post = new
            break
        post = new
    return prior, tables, post


def _design(features: list[str]) -> list[set[str]]:
    """Each feature and each pair of them, by place."""
    out = []
    for f in features:
        parts = [f"{i}={v}" for i, v in enumerate(f.split(","))]
        out.append({*parts, *(f"{a}&{b}" for i, a in enumerate(parts) for b in parts[i + 1:])})
    return out


def train(features: list[str], target: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on soft targets; returns the probability of each feature pattern."""
    rows = _design(features)
    names = sorted(set().union(*rows)) if rows else []
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r]] = 1
        x[i, -1] = 1
    w, share = np.zeros(x.shape[1]), weight / max(weight.sum(), 1)
    slope = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = 0.9 * slope + x.T @ (share * (p - target)) + decay * w
        w -= rate * slope
    p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
    return dict(zip(features, p.tolist()))


@dataclass
class Classifier:
    probability: dict[str, float]
    reliabilities: np.ndarray
    prior: float
    threshold: float = 0.5

    def accepts(self, features: str) -> bool:
        return self.probability.get(features, 0.0) >= self.threshold


def found(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per document: the kept columns, base spans and candidates."""

    @F.pandas_udf("base array<struct<kind:int,s:int,e:int>>, more array<struct<s:int,e:int,votes:string,features:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [base_spans(t) for t in batch]
            more = [[{"s": c.start, "e": c.end, "votes": c.votes, "features": c.features} for c in candidates(t, b)]
                    for t, b in zip(batch, base)]
            yield pd.DataFrame({"base": [[{"kind": k, "s": s, "e": e} for k, s, e in b] for b in base], "more": more})

    return docs.select(*keep, run("text").alias("_got")).select(*keep, "_got.base", "_got.more")


def fit(spans: DataFrame, threshold: float = 0.5) -> Classifier:
    """Reliabilities and classifier from all candidates, counted by pattern on Spark."""
    pairs = (spans.select(F.explode("more").alias("c")).groupBy("c.votes", "c.features")
             .agg(F.count("*").alias("n")).orderBy("votes", "features").toPandas())
    if pairs.empty:
        return Classifier({}, np.zeros((2, 0, 3)), 0.0, threshold)
    patterns = pairs.groupby("votes")["n"].sum()
    votes = np.array([[int(v) for v in p.split(",")] for p in patterns.index])
    prior, tables, post = em(votes, patterns.to_numpy(float))
    pairs["target"] = pairs["votes"].map(dict(zip(patterns.index, post))) * pairs["n"]
    shaped = pairs.groupby("features")[["target", "n"]].sum()
    probability = train(shaped.index.tolist(), (shaped["target"] / shaped["n"]).to_numpy(), shaped["n"].to_numpy(float))
    return Classifier(probability, tables, prior, threshold)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, n_secret, base_sha256 and all spans."""
    spans = written(found(docs, "doc_id"), "pii-spans")
    model = fit(spans, threshold)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, spans string")
    def run(base: pd.Series, more: pd.Series) -> pd.DataFrame:
        rows = []
        for b, c in zip(base, more):
            own = [(x["kind"], x["s"], x["e"]) for x in b]
            new = [(4, x["s"], x["e"]) for x in c if model.accepts(x["features"])]
            kinds = [x[0] for x in own]
            rows.append((*(kinds.count(k) for k in range(4)), len(new), hashlib.sha256(listed(own).encode()).hexdigest(), listed(own + new)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "n_secret", "base_sha256", "spans"])

    return spans.select("doc_id", run("base", "more").alias("_got")).select("doc_id", "_got.*")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with spans masked in ``text``; ``n_chars``, if there, follows."""
    model = fit(written(found(docs), "pii-candidates"), threshold)
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        accepts = shared.value.accepts
        for batch in batches:
            out = []
            for t in batch:
                own = base_spans(t)
                new = [(4, c.start, c.end) for c in candidates(t, own) if accepts(c.features)]
                out.append(masked(t, own + new) if own or new else t)
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("text", run("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
