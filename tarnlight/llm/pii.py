"""Personal data by weak supervision.

Fixed patterns find the base spans. Wider patterns propose further candidates:
phone numbers without a plus sign, spelled-out mail addresses, identity
numbers, keys and tokens. Labelers (pattern, checksum or shape, gazetteer of cue
words, context) each vote on every candidate, base spans included: for, against
or not at all. Expectation-maximisation over the counts of all vote patterns of
the corpus estimates the labelers' reliabilities; a logistic span classifier is
trained on a bounded sample of candidates weighted by those posteriors, and
gives the final verdict. Base spans always stay; a candidate that overlaps a kept
span is left out.

Edge cases: null and empty texts have no spans; a text of any length is read
whole, each pattern in linear time; rows are independent, so ties, repeats and
null ids do not matter; an empty table gives an empty result; other columns are
not read by ``find_spans``.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tarnlight.llm.store import Workspace

KINDS = ("email", "ip", "card", "phone", "identity", "secret")
BASE_KINDS = KINDS[:4]
#: Candidates, lowest hashes first, on which the span classifier is trained.
SAMPLE_SPANS = 20_000
EM_STEPS = 50
KEEP = 0.9
#: Characters of context on either side.
CONTEXT = 24

_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = re.compile(rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_RUN = re.compile(rf"(?<![{_LOCAL}])[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Wider patterns: (kind, a string without which the pattern cannot match, pattern).
_WIDER = (
    ("email", " dot ", re.compile(r"\b[A-Za-z0-9_.+-]{1,64} at [A-Za-z0-9-]{1,64} dot [A-Za-z]{2,10}\b")),
    ("email", "[at]", re.compile(r"\b[A-Za-z0-9_.+-]{1,64} ?\[at\] ?[A-Za-z0-9-]{1,64} ?(?:\[dot\]|\.) ?[A-Za-z]{2,10}\b")),
    ("phone", "", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")),
    ("identity", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("secret", "AKIA", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("secret", "ghp_", re.compile(r"\bghp_[0-9A-Za-z]{36}\b")),
    ("secret", "=", re.compile(r"\b[A-Za-z_]{2,20} ?= ?[\"'][^\"'\s]{12,128}[\"']")),
)
#: Cue words for each kind, lower-case.
GAZETTEER = {
    "email": ("mail", "e-mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "server", "address", "node"),
    "card": ("card", "visa", "credit", "pay", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact"),
    "identity": ("ssn", "social", "security", "identity", "id"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "credential"),
}
_AGAINST = re.compile(r"(?:version|fig|figure|table|page|isbn|issn|section|total|sum)\W{0,3}$", re.I)
LABELERS = ("pattern", "shape", "gazetteer", "context", "alone")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str):
    at = 0
    while True:
        m = _EMAIL.match(text, at) if at else None  # right after a match, a run of letters may already be under way
        m = m or _EMAIL_RUN.search(text, at)
        if not m:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if "." in text:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(int(x[-20:]) <= 255 and int(x[:-20] or 0) == 0 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str | None) -> list[tuple[int, int, int, bool, str, list[float]]]:
    """(kind, start, end, base, votes, shape) of base spans and of wider candidates that overlap none."""
    if not text:
        return []
    base = base_spans(text)
    found = [(*x, True) for x in base]
    taken = sorted((a, b) for _, a, b in base)
    for kind, needs, pattern in _WIDER:
        if needs in text:
            for m in pattern.finditer(text):
                a, b = m.span()
                i = bisect.bisect_left(taken, (b,))  # spans before i begin before b
                if not any(q > a for _, q in taken[max(0, i - 4) : i]):  # at most four kinds of base spans overlap each other
                    found.append((KINDS.index(kind), a, b, False))
                    bisect.insort(taken, (a, b))
    out = []
    for kind, a, b, is_base in sorted(found):
        body, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
        out.append((kind, a, b, is_base, _votes(KINDS[kind], body, before, after, is_base), _shape(body, before, after)))
    return out


def _votes(kind: str, body: str, before: str, after: str, is_base: bool) -> str:
    """A letter for each labeler: + for, - against, 0 no vote."""
    digits = [c for c in body if c.isdigit()]
    if kind == "secret":
        value = body.split("=", 1)[-1].strip(" \"'")
        mixed = len(set(value)) >= 8 and bool(digits) and any(c.isalpha() for c in value)
        shape = "+" if mixed else "-"
    elif kind == "identity":
        shape = "-" if body[:3] in ("000", "666") or body[0] == "9" else "+"
    else:
        shape = "+" if is_base or kind == "email" else "-" if len(set(digits)) <= 2 else "0"
    cues = (before + " " + body.split("=", 1)[0] if kind == "secret" else before).lower()
    gazetteer = "+" if any(re.search(rf"\b{re.escape(w)}", cues) for w in GAZETTEER[kind]) else "0"
    context = "-" if _AGAINST.search(before) else "+" if re.search(r"[:=(<]\s*$", before) else "0"
    alone = "-" if re.search(r"[\w.,/-]$", before) or re.match(r"[\w/]|[.,-]\w", after) else "+"
    return ("+" if is_base or kind in ("secret", "email") else "0") + shape + gazetteer + context + alone


def _shape(body: str, before: str, after: str) -> list[float]:
    n = len(body)
    return [min(n, 64) / 64, sum(c.isdigit() for c in body) / n, len(set(body)) / n, float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after)]


N_SHAPE = 5


def estimate(patterns: dict[tuple[int, str], int], steps: int = EM_STEPS) -> dict[tuple[int, str], float]:
    """Posterior of "personal data" for each (kind, votes), by expectation-maximisation over counts.

    A labeler that votes has, for either class, a chance of voting for it, shared by all kinds; one that does not
    vote tells nothing. Each kind has its own prior.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    weight = np.array([patterns[k] for k in keys], float)
    kind = np.array([k for k, _ in keys])
    vote = np.array([["-0+".index(c) for c in v] for _, v in keys])
    score = (vote - 1).sum(1)
    post = np.clip(0.5 + 0.2 * score, 0.05, 0.95)
    for _ in range(steps):
        like = np.zeros((2, len(keys)))
        for c, p in ((0, 1 - post), (1, post)):
            w = weight * p
            for j in range(vote.shape[1]):
                chance = np.bincount(vote[:, j], w, 3) + np.array([2.0, 0.0, 0.2] if c == 0 else [0.2, 0.0, 2.0])  # a labeler is better than chance
                against, _, given = np.log(chance / (chance[0] + chance[2]) + 1e-12)
                like[c] += np.where(vote[:, j] == 0, against, np.where(vote[:, j] == 2, given, 0.0))
        n = np.bincount(kind, weight, len(KINDS))
        prior = (np.bincount(kind, weight * post, len(KINDS)) + 1) / (n + 2)
        odds = np.log(prior / (1 - prior))[kind] + like[1] - like[0]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return dict(zip(keys, post.tolist(), strict=True))


def design(kind: np.ndarray, votes: list[str], shape: np.ndarray) -> np.ndarray:
    one = np.eye(len(KINDS))[kind]
    vote = np.array([["-0+".index(c) - 1.0 for c in v] for v in votes], float).reshape(len(votes), len(LABELERS))
    return np.column_stack([one, vote, shape.reshape(len(votes), N_SHAPE)])


@dataclass
class SpanClassifier:
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, soft: np.ndarray, steps: int = 30, ridge: float = 0.1) -> SpanClassifier:
        """Newton steps on soft labels."""
        w = np.zeros(x.shape[1])
        for _ in range(steps if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hess = x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w))
            w = w + np.linalg.solve(hess, x.T @ (soft - p) - ridge * w)
        return cls(w)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


_FOUND = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("shape", T.ArrayType(T.DoubleType())),
]))


@F.pandas_udf(_FOUND)
def _candidates(text: pd.Series) -> pd.Series:
    names = ("kind", "start", "end", "base", "votes", "shape")
    return pd.Series([[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in text])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, base, score), by kind as in KINDS and start, of every row."""
    work = Workspace(docs.sparkSession, "pii")
    found = work.save(docs.select("doc_id", _candidates("text").alias("found")), "found")
    each = found.select(F.explode("found").alias("c")).select("c.*")
    patterns = {(r["kind"], r["votes"]): r["n"] for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}  # kinds x 3 ** labelers at most
    post = estimate(patterns)
    order = F.xxhash64("kind", "start", "end", "votes", "shape")
    sample = each.select("kind", "votes", "shape", order.alias("o")).orderBy("o", "kind", "votes").limit(SAMPLE_SPANS).toPandas()
    x = design(sample["kind"].to_numpy(int), list(sample["votes"]), np.array(sample["shape"].to_list(), float))
    model = SpanClassifier.fit(x, np.array([post[k, v] for k, v in zip(sample["kind"], sample["votes"], strict=True)]))

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")
    def judge(found: pd.Series) -> pd.Series:
        out = []
        for own in found:
            own = list(own)
            p = model.predict(design(np.array([c["kind"] for c in own], int), [c["votes"] for c in own], np.array([c["shape"] for c in own], float))) if own else []
            out.append([
                {"kind": KINDS[c["kind"]], "start": c["start"], "end": c["end"], "base": c["base"], "score": float(s)}
                for c, s in zip(own, p, strict=True) if c["base"] or s >= KEEP
            ])
        return pd.Series(out)

    return found.select("doc_id", judge("found").alias("spans"))


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_spans(docs).select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


