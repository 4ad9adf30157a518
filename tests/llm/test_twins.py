"""Texts whose polynomial hashes modulo a power of two are equal for every base: Thue-Morse sequences of two symbols."""

import hashlib

import numpy as np
import pytest

from grafloom.llm import byte_bpe, hashing, jaccard, line_dedup, packing, pieces, repeats, token_counts
from grafloom.llm.queries import BYTE_BPE, WORD_BPE

from . import cases
from .test_operators import brute_lines, brute_links, brute_repeats, tiktoken_encoding, word_tokenizer

SIGNS = [bin(k).count("1") % 2 for k in range(4096)]


def twins(a: str, b: str, n: int = 1024) -> tuple[str, str]:
    return "".join((a, b)[s] for s in SIGNS[:n]), "".join((b, a)[s] for s in SIGNS[:n])


@pytest.mark.parametrize("which", [0, 1])
@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_twins_have_different_hashes(which, n):
    signs = np.array(SIGNS[:n], np.uint64)
    for low, high in ((97, 98), (3, 1 << 63), (0x9E3779B97F4A7C15, 0xD1B54A32D192ED0D)):
        both = np.where(np.concatenate([signs, 1 - signs]) == 1, np.uint64(high), np.uint64(low))
        h = hashing.Sums(both, which).of(np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]


def test_products_and_slices_equal_whole_numbers(monkeypatch):
    r = np.random.default_rng(1)
    a, b = (r.integers(0, hashing.P + 1, 3000).astype(np.uint64) for _ in range(2))
    got = hashing.times(a, b)
    assert [int(x) % hashing.P for x in got] == [int(x) * int(y) % hashing.P for x, y in zip(a, b)] and got.max() <= hashing.P + 1
    monkeypatch.setattr(hashing, "BLOCK", 7)
    for values in (r.integers(0, 1 << 64, 60, dtype=np.uint64), r.integers(1, 257, 60).astype(np.uint64)):
        at, to = np.array([0, 3, 11, 59, 60]), np.array([60, 3, 40, 60, 60])
        for which, base in enumerate(hashing.BASES):
            want = [sum(int(v) * pow(base, k, hashing.P) for k, v in enumerate(values[x:y])) % hashing.P + y - x for x, y in zip(at, to)]
            assert hashing.Sums(values, which).of(at, to).tolist() == hashing.mix(np.array(want, np.uint64)).tolist()


def test_pieces_of_twins_are_kept_apart(spark):
    texts = [t for x, y in (("q", "e"), ("a", "b"), ("z", "é")) for t in twins(x, y)]
    rows = [(k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, WORD_BPE).collect()}
    assert counts == {k: len(word_tokenizer().encode(t, add_special_tokens=False).ids) for k, t in rows}
    for r in byte_bpe.round_trips(docs, BYTE_BPE).collect():
        ids = tiktoken_encoding().encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    encoder = packing.Encoder(BYTE_BPE)
    raws = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(raws), np.uint8)
    ids, ends = encoder.encode(raw, np.cumsum([0, *map(len, raws)]))[:2]
    assert np.asarray(ids).tolist() == [i for t in texts for i in tiktoken_encoding().encode_ordinary(t)]
    first, codes = pieces.distinct_slices(raw, np.cumsum([0, *map(len, raws)])[:-1], np.cumsum([0, *map(len, raws)])[1:])
    assert len(first) == len(texts) and codes.tolist() == list(range(len(texts)))


def test_lines_of_twins_are_kept_apart(spark):
    one, two = twins("a", "b")
    rows = [(1, one), (2, f"{one}\nown"), (3, f"{two}\nother"), (4, two), (5, "x")]
    got = cases.ordered(line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_lines", "n_dropped", "text")
    assert got == brute_lines(rows) and not any(r[2] for r in got)


def test_windows_of_twins_are_kept_apart(spark):
    one, two = twins("a", "b")
    words = cases.passage(70, 60).split()
    rows = [(1, " ".join([*words[:30], one, *words[30:]])), (2, " ".join([*words[:30], two, *words[30:]]))]
    at = [" ".join(twins(*pair)[k] for k in (0,)) for pair in (("u ", "v "), ("v ", "u "))]  # twins of words
    rows += [(3, at[0]), (4, at[1]), (5, f"{rows[0][1]} end")]
    got = cases.ordered(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_words", "n_removed", "text")
    assert got == sorted(brute_repeats(rows, 50), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_sets_of_twins_are_kept_apart(spark):
    one, two = twins("a", "b")
    rows = [(1, one), (2, two), (3, twins("u ", "v ")[0]), (4, twins("u ", "v ")[1])]
    rows += [(5, " ".join([one] * 5 + ["x"])), (6, " ".join([two] * 5 + ["x"]))]
    got = cases.ordered(jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id", "n_links")
    assert got == brute_links(rows)
