"""Alignment of two tokenizers against every two tokens of a text compared, with the libraries' own encoders."""

import collections
import hashlib
import json
import random

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weirflow.llm import alignment

FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)


def byte_of(c):
    """The published table of byte-level vocabularies, made from its rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return ord(c) if ord(c) in plain else others[ord(c) - 256]


def brute(libraries, rows):
    a_lib, b_lib = libraries
    names = {i: t for t, i in a_lib.get_vocab().items()}
    made = []
    for i, t in rows:
        spaced = (" " + t).encode() if t else b""
        ids = (a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)) if t else ([], [])
        raw_a = [bytes(map(byte_of, names[x])) for x in ids[0]]
        raw_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, b_lib.id_to_piece(x)) for x in ids[1])]
        if b"".join(raw_a) != spaced or b"".join(raw_b) != spaced:
            ids, raw_a, raw_b = ([], []), [], []
        spans = []
        for raw in (raw_a, raw_b):
            at, own = 0, []
            for r in raw:
                own.append((at, at + len(r)))
                at += len(r)
            spans.append(own)
        links = [(x, y) for x, (p, q) in zip(ids[0], spans[0], strict=True) for y, (r, s) in zip(ids[1], spans[1], strict=True) if p < s and r < q]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        text, last = [], 0
        for c in cuts:
            text.append("|".join(",".join(str(x) for x, (_, e) in zip(ids[k], spans[k], strict=True) if last < e <= c) for k in (0, 1)))
            last = c
        made.append((i, len(ids[0]), len(ids[1]), len(cuts), links, ";".join(text)))
    count = collections.Counter(p for m in made for p in set(m[4]))
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return sorted((str(i), na, nb, g, len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(t.encode()).hexdigest() if t else "") for i, na, nb, g, ls, t in made), made


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    pool = "the stream tables naïve été über 12345 I'm don't  日本語 emoji🙂 Zürich ... -- <s> </s> <|endoftext|> \n \t x y 	tokenization\x85 aaaa".split(" ")
    out = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))) for i in range(120)]
    out += [(200 + i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2580), rng.randrange(0x1F300, 0x1F600)])) for _ in range(rng.randrange(40)))) for i in range(80)]
    out += [(500, None), (501, ""), (502, "a▁b"), (503, " "), (504, "  \n  "), (505, "\0"), (506, "x" * 3000), (507, "ab cd " * 700), (507, "ab cd " * 700), (None, "no id"), (1, out[1][1]), (1, out[1][1])]
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id bigint, text string, key string, n_a int, copies int").repartition(parts)


@pytest.mark.parametrize("options", [{}, {"tokens": 7, "part": 40, "head": 0}, {"tokens": 64, "part": 200, "head": 40}, {"head": 0}])
def test_same_as_all_pairs(spark, libraries, rows, options):
    want, _ = brute(libraries, rows)
    got = alignment.digest(frame(spark, rows), **options)
    assert got.columns == ["doc_id", *FIGURES]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_groups_and_links(spark, libraries, rows):
    _, made = brute(libraries, rows)
    df = frame(spark, rows)
    for options in ({}, {"tokens": 9, "part": 50}):
        found = collections.defaultdict(list)
        for r in alignment.groups(df, **options).collect():
            found[r["doc_id"]].append((r["part"], r["groups"]))
        for i, *_, text in made:
            if i not in (1, 507):  # repeated rows: each part comes as often
                assert ";".join(g for _, g in sorted(found[i])) == text
        linked = collections.Counter()
        for r in alignment.links(alignment.aligned(df, **options)).collect():
            linked[r["doc_id"], r["a"], r["b"]] += r["times"]
        assert linked == collections.Counter((i, *p) for i, *_, ls, _ in made for p in ls)


def test_parts_are_what_the_whole_gives():
    encoder = alignment.Encoder(alignment.A_FILE, alignment.B_FILE)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", "word", " ", "  ", "\n", " \n", "　", "é", "1", "'s", "\x1f", ".", "日本"]) for _ in range(rng.randrange(1, 60)))
        whole = list(encoder.whole(t, 1 << 20))
        cut = list(encoder.whole(t, 3))
        assert len(whole) == 1
        assert [x for p in cut for x in p[0]] == whole[0][0]
        assert [x for p in cut for x in p[1]] == whole[0][1]
    assert not list(encoder.whole("one two " * 9 + "▁ three", 3))


def test_vocabulary_is_that_of_the_other_library(libraries):
    """Every code point, doubled, beside letters, digits and line ends."""
    a, _ = libraries
    encoder = alignment.sides(alignment.A_FILE, alignment.B_FILE)[2]
    texts = [f" a{chr(c)}{chr(c)} {chr(c)}1{chr(c)} \n{chr(c)}b" for c in range(0, 0x20000) if not 0xD800 <= c < 0xE000]
    assert [e.ids for e in a.encode_batch(texts, add_special_tokens=False)] == [encoder.encode_ordinary(t) for t in texts]
    with open(alignment.A_FILE, encoding="utf-8") as f:
        assert len(json.load(f)["model"]["vocab"]) == len(alignment.sides(alignment.A_FILE, alignment.B_FILE)[0].tokens)


def test_state_does_not_grow():
    """Blocks of a long document leave no more than an open group and a block behind."""
    rng = np.random.default_rng(0)
    lengths = np.array([1, 2, 3, 4]), np.array([2, 3, 1])
    machine, most = alignment.Machine(lengths), 0
    ids = [rng.integers(0, 4, 40_000).astype(np.uint32), rng.integers(0, 3, 60_000).astype(np.uint32)]
    ends = [np.cumsum(n[x]) for n, x in zip(lengths, ids, strict=True)]
    blocks = sorted((int(e[k - 1]) if k else 0, s, k) for s, e in enumerate(ends) for k in range(0, len(e), 100))
    for _, s, k in blocks:
        machine.block(s, ids[s][k : k + 100])
        most = max(most, *map(len, machine.ids)) if k < 30_000 else most
    assert most < 400


def test_no_rows(spark):
    assert alignment.digest(frame(spark, [])).count() == 0
    assert [tuple(r) for r in alignment.digest(frame(spark, [(3, None)])).collect()] == [(3, 0, 0, 0, 0, 0, 0, "")]
