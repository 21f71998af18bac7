import hashlib
import random
from collections import Counter

import pytest
from roundtide.llm import alignment
from tokenizers import Tokenizer

A, B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


def reference(rows):
    """Token by token with the tokenizer library of the file, groups by sets of ends."""
    import sentencepiece

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in keep}
    back |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in keep)}
    docs, held = [], Counter()
    for i, t in rows:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        word_a = [bytes(back[c] for c in a.id_to_token(x)) for x in ids_a]
        word_b = [bytes([int(p[3:5], 16)]) if b.is_byte(x) else p.replace("▁", " ").encode() for x in ids_b for p in [b.id_to_piece(x)]]
        if not t or b"".join(word_a) != (" " + t).encode() or b"".join(word_b) != (" " + t).encode():
            ids_a, ids_b, word_a, word_b = [], [], [], []
        groups, x, y, at_a, at_b = [], [], [], 0, 0
        k = 0
        for j, w in enumerate(word_a):
            x.append(ids_a[j])
            at_a += len(w)
            while at_b < at_a:
                y.append(ids_b[k])
                at_b += len(word_b[k])
                k += 1
            if at_a == at_b:
                groups.append((x, y))
                x, y = [], []
        links = [(p, q) for x, y in groups for p in x for q in y]
        held.update(set(links))
        docs.append((i, ids_a, ids_b, groups, links))
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for i, ids_a, ids_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((i, len(ids_a), len(ids_b), len(groups), len(links), sum(held[z] == best[z[0]] for z in links), sum(held[z] for z in links), digest))
    return sorted(out, key=str)


def texts(seed, n=150):
    rng = random.Random(seed)
    words = "token vector, münchen naïve straße 日本語 テキスト 12345 3.14 <|endoftext|> <s> <0x41> 'll don't \n \t  \x00 🙂 ▁ ﬁ xX aaa".split(" ")
    made = "".join
    words += [made(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randrange(2, 12))) for _ in range(60)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("frequent,listed", [(1 << 16, 1 << 16), (40, 3)])
def test_equal_token_by_token(make_docs, monkeypatch, frequent, listed):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)  # few frequent pairs: the join has rows
    monkeypatch.setattr(alignment, "LISTED", listed)
    rows = texts(frequent)
    rows += [(900, rows[3][1]), (900, rows[4][1]), (None, rows[5][1])]
    got = alignment.align_documents(make_docs(rows).repartition(3), A, B).collect()
    assert sorted(map(tuple, got), key=str) == reference(rows)


def test_odd_rows(odd_docs, empty_docs, odd_rows):
    got = alignment.align_documents(odd_docs, A, B).collect()
    assert sorted(map(tuple, got), key=str) == reference(odd_rows)
    assert alignment.align_documents(empty_docs, A, B).count() == 0


def test_cuts_equal_the_file_at_every_character():
    import tiktoken

    ranks = {w: i for i, w in enumerate(alignment.byte_level_entries(A))}
    fast = tiktoken.Encoding("a", pat_str=alignment.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(A)
    for start in range(0, 0x30000, 4096):
        text = " ".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}.{chr(c)}" for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000)
        assert fast.encode_ordinary(text) == slow.encode(text, add_special_tokens=False).ids, hex(start)
