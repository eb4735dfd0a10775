import hashlib
import random
from collections import Counter

import pytest
from lakeglean.llm import alignment


@pytest.fixture(scope="module")
def plain():
    """(ids of A, ids of B, groups) of a text by the tokenizers' own libraries, or None."""
    import numpy as np
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.A_FILE}")
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.B_FILE}")
    alphabet = alignment.byte_alphabet()

    def groups(text):
        if not text:
            return None
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(alphabet[c] for c in t.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        out = []
        before = 0
        for e in sorted(set(ends_a) & set(ends_b)):
            out.append(([i for i, x in zip(a, ends_a, strict=True) if before < x <= e], [i for i, x in zip(b, ends_b, strict=True) if before < x <= e]))
            before = e
        return out

    return groups


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest()


def links(groups):
    return Counter((a, b) for x, y in groups for a in x for b in y)


def awkward(n, seed=3):
    rng = random.Random(seed)
    parts = [*"ab eE \n\t\r  ’'sst19.,!?\x1c\x85\xa0 　é́ﬁ漢字😀\x00▁{}", "<|endoftext|>", "<s>", " the", " foo", "\r\n", "   ", "'ll"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_texts_against_the_libraries(plain):
    texts = [*awkward(1500), "a" * 5000, "ab " * 3000, " " * 400, "\n \n  x", None, ""]
    aligner = alignment.Aligner()
    assert aligner.segment is alignment.SEGMENT
    seen = 0
    for text, (counts, found, codes, times) in zip(texts, aligner.documents(texts), strict=True):
        groups = plain(text)
        if groups is None:
            assert (counts.tolist(), found, len(codes)) == ([0] * 4, "", 0)
            continue
        seen += 1
        expected = links(groups)
        assert counts.tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(expected.values())]
        assert found == digest(groups)
        assert {(c // aligner.width, c % aligner.width): n for c, n in zip(codes.tolist(), times.tolist(), strict=True)} == expected
    assert seen > 500


def test_long_texts_in_pieces_and_a_forgetful_table(monkeypatch):
    texts = [" ".join(awkward(300, seed)) for seed in range(6)]
    whole = list(alignment.Aligner().documents(texts))
    monkeypatch.setattr(alignment, "BLOCK", 64)
    monkeypatch.setattr(alignment, "REMEMBERED", 100)
    for a, b in zip(whole, alignment.Aligner().documents(texts), strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1] == b[1] and a[2].tolist() == b[2].tolist() and a[3].tolist() == b[3].tolist()


def test_large_groups_are_multiplied_out(monkeypatch, plain):
    whole = list(alignment.Aligner().documents(awkward(300)))
    monkeypatch.setattr(alignment, "LARGE", 1)
    for a, b in zip(whole, alignment.Aligner().documents(awkward(300)), strict=True):
        assert a[2].tolist() == b[2].tolist() and a[3].tolist() == b[3].tolist()


@pytest.mark.parametrize("most", [20, 1 << 18])
def test_counts_over_the_corpus(spark, plain, most):
    texts = ["the cat sat", "the cat sat", "The Cat's hat", "", None, "éa ﬁ 漢字", "sat " * 300] + awkward(60)
    rows = [(None if i % 7 == 0 else i // 2, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, codes string")
    got = Counter(map(tuple, alignment.alignment(docs, most=most).collect()))
    groups = [plain(t) or [] for t in texts]
    count = Counter(p for g in groups for p in links(g))
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    expected = Counter()
    for (i, _, _), g in zip(rows, groups, strict=True):
        own = links(g)
        expected[(i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()), digest(g) if g else "")] += 1
    assert got == expected


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
