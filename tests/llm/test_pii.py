import hashlib
import random
import re
import time

from roundtide.llm import pii as p


def plain_base(t):
    """The base spans as the contract words them."""
    def digits(x):
        return re.sub("[^0-9]", "", x)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], p.KINDS.index(x[0])))


def base_of(text):
    return sorted(((c["kind"], c["start"], c["end"]) for c in p.candidates(text) if c["base"]), key=lambda x: (x[1], p.KINDS.index(x[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    parts = ["a", "b.c", "@", "@", ".", "-", "+", "1", "23", "4111 1111 1111 1111", "5500005555555559", "192.168.0.1", "0256", "255", " ", "(", ")", "é", "x@y.z", "+1 (555) 010-9999", "٣"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(25))
        assert base_of(text) == plain_base(text), text


def test_estimation_finds_reliable_labelers():
    rng = random.Random(2)
    counts = {}
    truth = {}
    for _ in range(20_000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) * (1 if rng.random() < q else -1) for q in (0.95, 0.8, 0.7, 0.6))
        counts[v] = counts.get(v, 0) + 1
        truth.setdefault(v, [0, 0])[y] += 1
    post, tables = p.estimate([("ip", v, n) for v, n in counts.items()])
    right = [tables[1, j, 2] for j in range(4)]
    assert right == sorted(right, reverse=True) and abs(right[0] - 0.95) < 0.04 and abs(right[3] - 0.6) < 0.06
    agree = sum(max(t) for t in truth.values())
    assert sum(t[int(post["ip", v] > 0.5)] for v, t in truth.items()) > 0.98 * agree
    w = p.fit_classifier([("ip", v, 1, n) for v, n in counts.items()], post)
    said = {v: p.features("ip", v, 1) @ w > 0 for v in counts}
    assert sum(n for v, n in counts.items() if said[v] == (post["ip", v] > 0.5)) > 0.95 * 20_000


def test_spans_are_added_and_base_ones_stay(make_docs):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        extra = f"write to jane{i} [at] example [dot] com or call {rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
        rows.append((i, f"Contact email user{i}@mail.example.org from host 10.0.{i}.7. {extra if i % 2 else 'order 111-111-1111 version 1.2.3.400'}"))
    got = {r["doc_id"]: r for r in p.find(make_docs(rows)).collect()}
    for i, t in rows:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(got[i]["spans"].split(","))
        assert ("email_words" in got[i]["spans"]) == (i % 2 == 1)
        assert (got[i]["n_email"], got[i]["n_ip"]) == (1, 1)


def test_added_spans_touch_no_base_span_and_cost_in_proportion():
    rng = random.Random(4)
    bits = ["a@b.com", "123-456-7890", "10.0.0.7", "+44 20 7946 0958", "4111 1111 1111 1111", "078-05-1120", "x at y dot org", "GB82WEST12345698765432"]
    for _ in range(60):
        text = "".join(rng.choice(bits) + rng.choice([" ", "", ",", " call "]) for _ in range(rng.randrange(1, 25)))
        got = p.candidates(text)
        base = [(c["start"], c["end"]) for c in got if c["base"]]
        added = {(c["kind"], c["start"], c["end"]) for c in got if c["kind"] in p.WIDER}
        wanted = {(k, m.start(), m.end()) for k, x in p.WIDER.items() for m in x.finditer(text) if not any(a < m.end() and m.start() < b for a, b in base)}
        assert added == wanted

    def seconds(n):
        start = time.process_time()
        assert len(p.candidates("a@b.com 123-456-7890 " * n)) == 2 * n
        return time.process_time() - start

    assert seconds(16_000) < 16 * max(seconds(2_000), 0.05)  # eight times the text; a square would be 64


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    got = p.find(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert all(r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    assert p.find(empty_docs).count() == 0
