"""Cross-tokenizer alignment against a brute-force version."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from placewright.llm import alignment

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, "a", " a", "a ", "a  b", "\n", "a\nb", "a \nb", "a\n\nb", "\tx", "x\ty z", "<|endoftext|> x<s></s>", "a▁b", "naïve 中文 😀", "\0 a\0", "ﬁ ①", "x\u0085y", "x y", "12345 don't"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(FIRST, SECOND)


@pytest.fixture(scope="module")
def plain():
    first, second, letters = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND), alignment.byte_letters()
    first.encode_special_tokens = True

    def spell(text):
        """Tokens of either side as (id, bytes); none where they don't spell space + text."""
        if not text:
            return [], []
        a = [(k, bytes(letters[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(k, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and second.is_byte(k) else p.replace("▁", " ").encode()) for k, p in ((k, second.id_to_piece(k)) for k in second.encode(text))]
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    return spell


def brute(rows, spell):
    def ranges(tokens):
        at, out = 0, []
        for k, raw in tokens:
            out.append((k, at, at + len(raw)))
            at += len(raw)
        return out

    held, found = Counter(), []
    for d, text in rows:
        a, b = map(ranges, spell(text))
        links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
        held.update(set(links))
        common = sorted({e for _, _, e in a} & {e for _, _, e in b})
        sides = [",".join(str(k) for k, _, e in a if lo < e <= hi) + "|" + ",".join(str(k) for k, _, e in b if lo < e <= hi) for lo, hi in zip([0, *common], common, strict=False)]
        found.append((d, len(a), len(b), len(common), links, hashlib.sha256(";".join(sides).encode()).hexdigest() if a else ""))
    most = Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(repr((d, na, nb, g, len(ls), sum(held[p] == most[p[0]] for p in ls), sum(held[p] for p in ls), sha)) for d, na, nb, g, ls, sha in found)


def drawn(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "Miosra", "éaielleeau", "chschch", "straße", "中文字", "x1y2", "don't", "a", "!?", "😀", "reoran,", "thstrees."]
    return [rng.choice([" ", " ", " ", "\n", "  "]).join(rng.choice(words) + rng.choice(["", rng.choice(words)]) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_walk_finds_all_groups():
    rng = random.Random(1)
    for _ in range(300):
        size = rng.randrange(1, 80)
        dense = rng.choice([0.5, 0.9, 1.0])
        a, b = (sorted({size, *(k for k in range(1, size) if rng.random() < dense)}) for _ in range(2))
        rows, left, right = alignment.walk(a, b)
        ends, links = [], list(zip(left, right, strict=True))
        for start, other, run, more_a, more_b in rows:
            assert a[start : start + run] == b[other : other + run]
            ends += a[start : start + run] + ([a[start + run + more_a - 1]] if more_a else [])
            links += [(start + k, other + k) for k in range(run)]
        assert ends == sorted(set(a) & set(b))
        low = lambda x, k: x[k - 1] if k else 0
        assert sorted(links) == [(i, j) for i in range(len(a)) for j in range(len(b)) if low(a, i) < b[j] and low(b, j) < a[i]]


def test_units_spell_as_the_libraries(pair, plain):
    rng = random.Random(9)
    letters = ["a", "b", "é", "1", "'s", "\0", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "\x1c", "\x85", "\xa0", "▁", "<|endoftext|>", "<s>", "<0x41>", ".", "中", "😀", "the"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(4000)]
    for text, sides in zip(texts, pair.encode(texts), strict=True):
        for side, tokens in zip(sides, plain(text), strict=True):
            assert [int.from_bytes(side[k : k + 4], "little") for k in range(0, len(side), 4)] == [k for k, _ in tokens], repr(text)


def test_links_against_brute_force(spark, plain):
    texts = ODD + drawn(150)
    rows = [*enumerate(texts), (None, texts[40]), (5, texts[41]), (5, texts[41])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, pair string").repartition(3)
    for block_links in (300, alignment.BLOCK_LINKS):
        found = alignment.links(docs, FIRST, SECOND, block_links=block_links)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows, plain)


def test_long_text_and_empty_table(spark, plain):
    rows = [(1, "chschch reoran " * 4000), (2, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (long, short) = sorted(alignment.links(docs, FIRST, SECOND).collect())
    a, b = plain(rows[0][1])
    assert (long["n_a"], long["n_b"]) == (len(a), len(b)) and long["n_links"] == len(a) + len(b) - long["n_groups"]
    assert short["n_links"] == short["n_a"] + short["n_b"] - short["n_groups"]
    assert alignment.links(docs.where("doc_id > 5"), FIRST, SECOND).collect() == []
