"""Personal data by weak supervision.

Candidates are the base matches (email, ip, card, phone) and wider shapes that only may be personal:
spelled-out addresses, phone numbers without a plus sign, card-like digit groups, account numbers.
Labelers vote on each candidate: a regex labeler (validity and checksums), a gazetteer labeler
(top-level domains, issuer and country prefixes, address ranges), a context labeler (words before
and after) and a shape labeler (borders and variety of digits). Expectation-maximisation over the
counts of all vote patterns of the corpus estimates how often each labeler is right; the posteriors
train the final classifier, a logistic model over kind, votes and length. Base spans always stay;
other candidates stay when the classifier says so.

Only the counts of distinct patterns reach the driver, a number bounded by the product of kinds,
votes and length classes.

Edge cases: null or empty text has no spans; a corpus without candidates gives an untrained model
and no added spans; ids may be null or repeat, each row is searched by itself; time is in proportion
to the text's length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundtide.llm.common import map_columns, stage_table, texts

# The base patterns. Lookbehinds keep the search linear and find the same matches.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

# Wider shapes, by their own kinds.
WIDER = {
    "email_words": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[\[({][\x20]?at[\x20]?[\])}][\x20]?[A-Za-z0-9-]{1,63}"
        r"(?:[\x20]?[\[({][\x20]?dot[\x20]?[\])}][\x20]?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63})+",
        re.IGNORECASE | re.ASCII,
    ),
    "phone_plain": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "account": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
}
ALL_KINDS = (*KINDS, *WIDER)

# Gazetteers.
DOMAIN_ENDS = set("com org net edu gov mil int info biz io co uk de fr es it nl eu ch at be pl pt se no dk fi ru jp cn in br au ca us".split())
CALLING_CODES = ("1", "7", "20", "27", "3", "4", "5", "6", "8", "9")
CARD_ISSUERS = ("4", "51", "52", "53", "54", "55", "2", "34", "37", "6011", "65", "30", "36", "38", "35")
POSITIVE = {
    "email": "mail email e-mail contact write reach from to cc correo courriel",
    "ip": "ip address host server login client addr from adresse",
    "card": "card visa mastercard amex credit debit pay carte tarjeta karte",
    "phone": "phone tel call mobile cell fax contact whatsapp telefon teléfono téléphone",
    "national_id": "ssn social security tax id number",
    "account": "iban account bank konto compte cuenta transfer",
}
NEGATIVE = set("version isbn issn order invoice sku page figure section chapter item model release build serial doi port".split())
CONTEXT = 40
LABELERS = ("regex", "gazetteer", "context", "shape")
CONTEXT_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; the part before the sign is the run of its characters up to there."""
    found, last = [], 0
    if "@" not in text:
        return found
    for m in EMAIL_TAIL.finditer(text):
        start = m.start()
        while start > last and EMAIL_HEAD.match(text[start - 1]):
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def matches(text: str) -> dict[str, list[tuple[int, int, bool]]]:
    """For each base kind the matches of its pattern, and whether they pass."""
    return {
        "email": [(a, b, True) for a, b in emails(text)],
        "ip": [(m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))) for m in IP.finditer(text)],
        "card": [(m.start(), m.end(), 14 <= len(d) <= 19 and luhn(d)) for m in CARD.finditer(text) for d in (digits_of(m.group()),)],
        "phone": [(m.start(), m.end(), 10 <= len(digits_of(m.group())) <= 15) for m in PHONE.finditer(text)],
    }


def account_ok(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def votes(text: str, kind: str, a: int, b: int, passed: bool) -> tuple[int, int, int, int]:
    """One vote of each labeler: 1 personal, -1 not, 0 no opinion."""
    value, family = text[a:b], kind.partition("_")[0] if kind not in POSITIVE else kind
    digits = digits_of(value)
    valid = passed
    if kind == "account":
        valid = account_ok(value)
    elif kind == "national_id":
        valid = digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"
    elif kind == "phone_plain":
        valid = 9 <= len(digits) <= 12
    gazetteer = 0
    if family == "email":
        gazetteer = 1 if re.split(r"[^A-Za-z]+", value.lower().rstrip("])}"))[-1] in DOMAIN_ENDS else -1
    elif family == "ip":
        first = value.split(".")[0].lstrip("0") or "0"
        gazetteer = -1 if first in ("0", "127") or len(first) > 3 or int(first) >= 224 else 1
    elif family == "card":
        gazetteer = 1 if digits.startswith(CARD_ISSUERS) else -1
    elif kind == "phone":
        gazetteer = 1 if digits.startswith(CALLING_CODES) else -1
    around = CONTEXT_WORD.findall(text[max(0, a - CONTEXT) : a].lower()) + CONTEXT_WORD.findall(text[b : b + CONTEXT].lower())
    near = set(around)
    context = 1 if near & set(POSITIVE.get(family, "").split()) else -1 if near & NEGATIVE else 0
    joined = a > 0 and text[a - 1].isalnum() or b < len(text) and text[b].isalnum()
    shape = -1 if joined or (len(digits) >= 7 and len(set(digits)) <= 2) else 1 if len(set(digits)) >= 4 or family == "email" else 0
    return (1 if valid else -1), gazetteer, context, shape


def candidates(text: str) -> list[dict]:
    """All candidates with kind, place, whether they are base spans, votes and length class."""
    found = []
    taken: list[tuple[int, int]] = []
    for kind, spans in matches(text).items():
        for a, b, ok in spans:
            if kind == "card" and not ok and not 13 <= len(digits_of(text[a:b])) <= 19:
                continue  # plain numbers are no candidates
            found.append((kind, a, b, ok, ok))
            if ok:
                taken.append((a, b))
    taken.sort()
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for kind, pattern in WIDER.items():
        for m in pattern.finditer(text):
            before = bisect_left(starts, m.end())  # base spans that begin before this one ends
            if not before or reach[before - 1] <= m.start():
                found.append((kind, m.start(), m.end(), False, True))
    return [
        {"kind": k, "start": a, "end": b, "base": base, "votes": list(votes(text, k, a, b, ok)), "size": min((b - a) // 8, 4)}
        for k, a, b, base, ok in found
    ]


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 200) -> tuple[dict, np.ndarray]:
    """Expectation-maximisation over (kind, votes, count): posteriors by (kind, votes), and reliabilities.

    ``reliabilities[c, j, v + 1]`` is the chance that labeler j votes v on a candidate that is personal
    (c = 1) or not (c = 0). They start from a mild belief that votes are right, which also counts as ten
    candidates of each class, so that a class or vote without examples keeps it.
    """
    belief = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])
    tables = np.repeat(belief[:, None, :], len(LABELERS), axis=1)
    n = np.array([c for *_, c in patterns], float)
    v = np.array([x for _, x, _ in patterns]).reshape(len(patterns), len(LABELERS)) + 1
    kinds, kind = np.unique([k for k, *_ in patterns], return_inverse=True)
    share = np.full(len(kinds), 0.5)
    p = np.full(len(patterns), 0.5)
    each = np.arange(len(LABELERS))
    for _ in range(rounds):
        chance = np.where(v == 1, 0, np.log(tables[:, each, v])).sum(axis=2)  # no opinion says nothing
        chance = chance + np.log(np.stack([1 - share, share]))[:, kind]
        new = 1 / (1 + np.exp(np.clip(chance[0] - chance[1], -30, 30)))
        done, p = np.abs(new - p).max() < 1e-7, new
        for c, weight in enumerate((n * (1 - p), n * p)):
            for j in each:
                counts = np.bincount(v[:, j], weight, 3) + 10 * belief[c]
                tables[c, j] = counts / counts.sum()
        share = (np.bincount(kind, n * p, len(kinds)) + 1) / (np.bincount(kind, n, len(kinds)) + 2)
        if done:
            break
    return {(k, x): float(q) for (k, x, _), q in zip(patterns, p)}, tables


def features(kind: str, v: tuple[int, ...], size: int) -> np.ndarray:
    x = np.zeros(1 + len(ALL_KINDS) + 2 * len(LABELERS) + 1)
    x[0] = 1
    x[1 + ALL_KINDS.index(kind)] = 1
    for j, vote in enumerate(v):
        if vote:
            x[1 + len(ALL_KINDS) + 2 * j + (vote < 0)] = 1
    x[-1] = size / 4
    return x


def fit_classifier(rows: list[tuple[str, tuple[int, ...], int, int]], post: dict, rounds: int = 300) -> np.ndarray:
    """Logistic weights fitted to the posteriors; rows are (kind, votes, size, count)."""
    x = np.array([features(k, v, s) for k, v, s, _ in rows])
    y = np.array([post[k, v] for k, v, _, _ in rows])
    n = np.array([c for *_, c in rows], float)
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (n * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (n * (y - p)) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans."""

    def make_candidates():
        return lambda ids, text: [ids, [candidates(t) for t in text]]

    schema = "doc_id long, found array<struct<kind string, start int, end int, base boolean, votes array<int>, size int>>"
    table = stage_table(map_columns(texts(docs), make_candidates, schema), "pii-candidates")
    counted = (
        table.select(F.explode("found").alias("c"))
        .groupBy("c.kind", F.array_join("c.votes", ",").alias("votes"), "c.size")
        .agg(F.count("*").alias("n"))
    )
    # at most kinds x 3^4 votes x 5 sizes rows
    rows = sorted((r["kind"], tuple(map(int, r["votes"].split(","))), r["size"], r["n"]) for r in counted.collect())
    weights = None
    if rows:
        sums: dict = {}
        for k, v, _, n in rows:
            sums[k, v] = sums.get((k, v), 0) + n
        post, _ = estimate([(k, v, n) for (k, v), n in sums.items()])
        weights = fit_classifier(rows, post)

    def make_final():
        def keeps(c) -> bool:
            return c["base"] or 1 / (1 + np.exp(-features(c["kind"], tuple(c["votes"]), c["size"]) @ weights)) >= threshold

        def step(ids, found):
            out = [[] for _ in range(7)]
            for i, cs in zip(ids, found):
                cs = sorted(cs, key=lambda c: (c["start"], ALL_KINDS.index(c["kind"]), c["end"]))
                base = [c for c in cs if c["base"]]
                row = (
                    i, *(sum(c["kind"] == k for c in base) for k in KINDS),
                    hashlib.sha256(joined(base).encode()).hexdigest(), joined([c for c in cs if keeps(c)]),
                )
                for column, value in zip(out, row):
                    column.append(value)
            return out

        return step

    final = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_columns(table, make_final, final)


def joined(spans: list[dict]) -> str:
    return ",".join(f"{c['kind']}:{c['start']}:{c['end']}" for c in spans)
