import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import public_tokenizers as P
import pytest

from grafloom.llm import byte_bpe, decontaminate, hashing, jaccard, language, line_dedup, packing, pieces, repeats, sharding, token_counts, topk
from grafloom.llm.queries import BYTE_BPE, WORD_BPE

from . import cases

LIB = {}


def tiktoken_encoding():
    if "t" not in LIB:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_BPE, "rb"))}
        LIB["t"] = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return LIB["t"]


def word_tokenizer():
    if "w" not in LIB:
        from tokenizers import Tokenizer

        LIB["w"] = Tokenizer.from_file(WORD_BPE)
    return LIB["w"]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# pieces and hashes


@pytest.mark.parametrize("spaced", [True, False])
def test_pieces_equal_the_patterns(spaced):
    import numpy as np
    import regex

    pattern = regex.compile(P.PATTERN if spaced else r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    r = random.Random(1)
    for _ in range(1500):
        texts = ["".join(r.choice("  \n\t'''stremvld aé1٣!.- 　") for _ in range(r.randint(0, 14))) for _ in range(3)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        points, offsets = pieces.code_points(raw)
        a, b = pieces.cut(points, np.cumsum([0, *map(len, texts)])[:-1], spaced)
        assert [raw[offsets[x] : offsets[y]].tobytes().decode() for x, y in zip(a, b)] == [m for t in texts for m in pattern.findall(t)]


def test_window_hashes_tell_windows_apart():
    import numpy as np

    raws = [t.encode() for t in ("a b c d a b c", "a b c", "", "b c d")]
    words = hashing.Words(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]), hashing.NOT_SPACE, False)
    at, h = words.windows(words.hashes(), 3)
    flat = " ".join(t.decode() for t in raws).split()
    want = [tuple(flat[k : k + 3]) for k in at]
    assert len(at) == 7 and len(set(h.tolist())) == len(set(want))
    assert [h[i] == h[j] for i in range(7) for j in range(7)] == [want[i] == want[j] for i in range(7) for j in range(7)]


# 1 and 8


def test_word_counts_equal_the_library(spark):
    rows = cases.texts()
    got = cases.ordered(token_counts.token_counts(cases.table(spark), WORD_BPE), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for i, t in rows:
        n = len(word_tokenizer().encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_word_counts_on_random_strings():
    model, r = token_counts.load(WORD_BPE), random.Random(3)
    for alphabet in ("abc", "aeiou tnr", "  \n'sdtREVL", "日本語é ", "ΑΣΊİßſ'S 12", "<|endoftext|>starx ", "aaaa ab"):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(150)]
        assert model.count(texts) == [len(word_tokenizer().encode(t, add_special_tokens=False).ids) for t in texts]


def test_byte_bpe_equals_the_library(spark):
    got = cases.ordered(byte_bpe.round_trips(cases.table(spark), BYTE_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in cases.texts():
        ids = tiktoken_encoding().encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def library_ids(piece):
    return tiktoken_encoding()._core_bpe.encode_single_piece(piece)


def by_piece(machine, many):
    import numpy as np

    ends = np.cumsum([0, *map(len, many)])
    ids, sizes = machine.encode_all(np.frombuffer(b"".join(many), np.uint8), ends[:-1], ends[1:])
    cuts = np.cumsum([0, *sizes.tolist()]).tolist()
    return [ids[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


@pytest.mark.parametrize("states,abreast,alone", [(500_000, 1 << 15, 8), (300, 50, 8), (40, 50, 60)])
def test_transducer_on_tokens_and_random_bytes(monkeypatch, states, abreast, alone):
    for name, value in (("STATES", states), ("ABREAST", abreast), ("ALONE", alone)):
        monkeypatch.setattr(byte_bpe, name, value)
    machine, r = byte_bpe.load(BYTE_BPE).machine, random.Random(4)
    tokens = [machine.m.vocab[rank] for rank in range(0, len(machine.m.vocab), 37)]
    assert by_piece(machine, tokens) == [[rank] for rank in range(0, len(machine.m.vocab), 37)]
    many = [bytes(r.choice(b"aeinorst \xc3\xa9\xff") for _ in range(r.randint(1, 40))) for _ in range(400)]
    many += [b"ab" * 900, bytes(r.choice(b"xyz09AB") for _ in range(2500)), b"=" * 3000]
    assert by_piece(machine, many) == [library_ids(x) for x in many]
    assert by_piece(machine, []) == []


def test_every_piece_of_the_query_runs_on_kept_states():
    import numpy as np

    codec = byte_bpe.Codec(BYTE_BPE)
    machine, ran, moves = codec.machine, [], []
    run, move = machine.run, machine.move
    machine.run = lambda states, data: (ran.append(len(states)), run(states, data))[1]
    machine.move = lambda state, byte: (moves.append((state, byte)), move(state, byte))[1]
    text = "several words, and several more words; don't 12 " + cases.passage(20, 300)
    raw = np.frombuffer(text.encode(), np.uint8)
    pieces_of = {x.encode() for x in __import__("regex").findall(P.PATTERN, text)}
    ids, _ = codec.encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == tiktoken_encoding().encode_ordinary(text)
    assert sum(ran) <= sum(map(len, pieces_of)) and len(moves) == len(set(moves)) == machine.moves.held > 0
    again = len(moves)
    codec.encode(raw, np.array([0, len(raw)]))
    assert len(moves) == again  # moves are made once and then kept


def test_stream_decoder_gives_whole_characters_only():
    codec = byte_bpe.load(BYTE_BPE)
    text = "héllo 日本語 🎉 ok"
    ids = [codec.machine.m.ranks[bytes([b])] for b in text.encode()]
    stream, out = byte_bpe.StreamDecoder(codec), []
    for i in ids:
        out.append(stream.feed([i]).decode())
    stream.close()
    assert "".join(out) == text and out.count("") == len(text.encode()) - len(text)
    half = byte_bpe.StreamDecoder(codec)
    half.feed(ids[:2])
    with pytest.raises(ValueError):
        half.close()
    with pytest.raises(ValueError):
        byte_bpe.StreamDecoder(codec).feed([codec.machine.m.ranks[b"\xff"]])


def test_stream_decoder_on_any_cut():
    codec, r = byte_bpe.load(BYTE_BPE), random.Random(14)
    text = "".join(r.choice("aé日🎉 ß٣") for _ in range(400))
    for _ in range(30):
        ids = tiktoken_encoding().encode_ordinary(text) if r.random() < 0.5 else [codec.machine.m.ranks[bytes([b])] for b in text.encode()]
        stream, out, at = byte_bpe.StreamDecoder(codec), b"", 0
        while at < len(ids):
            stop = at + r.randint(1, 9)
            out += stream.feed(ids[at:stop])
            assert text.startswith(out.decode())
            fed = sum(len(codec.vocab[i]) for i in ids[:stop])
            assert fed - len(out) < 4
            at = stop
        stream.close()
        assert out.decode() == text


def test_encode_and_decode_tables(spark):
    docs = cases.table(spark)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, BYTE_BPE), BYTE_BPE)
    assert cases.ordered(back, "doc_id", "text") == sorted(((i, t or "") for i, t in cases.texts()), key=lambda r: tuple((x is None, str(x)) for x in r))


# 2


def brute_lines(rows, least=20, documents=3):
    key = lambda s: cases.low(s.strip(" \t\n\x0b\x0c\r"))
    where: dict[str, list[int]] = {}
    for i, t in rows:
        if i is not None:
            for k in {key(x) for x in (t or "").split("\n")}:
                if len(k) >= least:
                    where.setdefault(k, []).append(i)
    owner = {k: max(v) for k, v in where.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in owner or owner[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("limits", [{}, {"INDEX_BYTES": 0}, {"INDEX_BYTES": 0, "SHARD_KEYS": 4, "PROBES": 10}, {"SHARD_KEYS": 4}])
def test_line_dedup_equals_brute_force(spark, monkeypatch, limits):
    from pyspark.sql import functions as F

    for name, value in limits.items():
        monkeypatch.setattr(line_dedup, name, value)

    rows = cases.texts()
    out = line_dedup.drop_lines(cases.table(spark))
    assert out.columns == [*cases.table(spark).columns, "n_lines", "n_dropped"]
    assert cases.ordered(out.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "n_lines", "n_dropped", "text") == brute_lines(rows)
    many = [(k, f"{'A common line of text here' if k % 2 else 'another line, also common'}\r\nown {k}\n\tshort\nÄ common line äöü {k % 4} {'x' * 8}") for k in range(60)]
    many += [(7, "A common line of text here\nrepeated twice, but by one id"), (7, "repeated twice, but by one id"), (None, "A common line of text here")]
    got = cases.ordered(line_dedup.drop_lines(spark.createDataFrame(many, "doc_id long, text string")), "doc_id", "n_lines", "n_dropped", "text")
    assert got == brute_lines(many)


def test_perfect_hash_finds_its_keys_and_no_others():
    import numpy as np

    r = np.random.default_rng(5)
    one, two = r.integers(0, 1 << 63, 5000).astype(np.uint64), r.integers(0, 1 << 63, 5000).astype(np.uint64)
    one[:3], two[:3] = 9, 9  # equal keys end on the list of those without a place
    one[3], two[3] = 10, 10
    shard = line_dedup.Shard(line_dedup.pack(one, two, np.arange(5000), np.arange(5000)))
    found = shard.probe(one, two)
    assert (found >= 0).all() and (shard.owners[found[3:]] == np.arange(3, 5000)).all()
    assert (np.sort(found[3:]) == np.unique(found[3:])).all()
    assert (shard.probe(two, one)[4:] == -1).all()
    empty = line_dedup.Shard(line_dedup.pack(one[:0], two[:0], np.arange(0), np.arange(0)))
    assert (empty.probe(one, two) == -1).all()


# 3


def word_sets(rows):
    out = []
    for _, t in rows:
        w = cases.WORD.findall(cases.low(t or ""))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def brute_links(rows, threshold=0.8):
    sets = word_sets(rows)
    n, parent, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], None if rows[k][0] is None else least[root(k)], links[k]) for k in range(n)), key=lambda r: tuple((x is None, str(x)) for x in r))


def near_copies(n, seed, changed=2):
    r = random.Random(seed)
    base = cases.passage(seed, 150).split()
    out = []
    for k in range(n):
        own = list(base)
        for _ in range(r.randint(0, changed)):
            own[r.randrange(150)] = f"w{r.randrange(10**6)}"
        out.append((1000 * seed + k, " ".join(own)))
    return out


def test_similar_equals_brute_force(spark):
    rows = cases.texts() + near_copies(25, 30) + near_copies(40, 31, 5) + near_copies(3, 32)
    got = cases.ordered(jaccard.similar(cases.table(spark, rows)), "doc_id", "class_id", "n_links")
    assert got == brute_links(rows)


@pytest.mark.parametrize("limits", [{"SMALL": 8, "BLOCK": 10}, {"BLOCK": 5, "SPREAD": 4, "MOST": 12}, {"BLOCK": 3, "SPREAD": 2, "MOST": 1000}])
def test_similar_by_blocks(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(70, 40, 4) + near_copies(30, 41, 6) + cases.texts()
    got = cases.ordered(jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id", "n_links")
    assert got == brute_links(rows)


def pairs_at_the_threshold(n):
    """Pairs of texts that share 80 of 100 shingles, and nothing with other pairs."""
    r, out = random.Random(60), []
    for k in range(n):
        both, *own = ([f"w{r.randrange(10**12)}" for _ in range(m)] for m in (84, 10, 10))
        out += [(2 * k + j, " ".join(both + x)) for j, x in enumerate(own)]
    return out


def test_similar_reaches_its_recall_in_the_deepest_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 1)
    rows = pairs_at_the_threshold(2500)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    # At a recall of 0.9999, more than two of 2500 are missed with a probability of 0.002.
    assert got.filter("n_links = 0").count() // 2 <= 2


def rows_of_splits_and_cells(spark, monkeypatch, rows):
    """Rows that splits below the root and the cells of buckets take, and the result."""
    seen = {"split": 0, "cells": 0}
    split, forests = jaccard.split, jaccard.forests

    def counted_split(sets, threshold, runs):
        out = split(sets, threshold, runs)
        seen["split"] += out.count() if "path" in sets.columns else 0
        return out

    def counted_forests(members, least_equal):
        seen["cells"] += members.count()
        return forests(members, least_equal)

    with monkeypatch.context() as m:
        m.setattr(jaccard, "split", counted_split)
        m.setattr(jaccard, "forests", counted_forests)
        got = cases.ordered(jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "class_id", "n_links")
    return seen, got


def test_near_copies_are_not_split_again_and_their_cells_do_not_grow_as_their_square(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    rows = near_copies(160, 41)
    few, got = rows_of_splits_and_cells(spark, monkeypatch, rows[:80])
    assert got == brute_links(rows[:80])
    many, got = rows_of_splits_and_cells(spark, monkeypatch, rows)
    assert got == brute_links(rows)
    # Without hubs each of 14 runs splits all copies again at each level, and deals each to a cell for every 8 of them.
    assert many["split"] < 14 * 160
    assert many["cells"] < 3 * few["cells"] + 160


@pytest.mark.parametrize("levels", [1, 2])
def test_similar_where_sets_apart_from_the_hub_fill_several_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    base, r = cases.passage(42, 200).split(), random.Random(42)
    rows = []
    # Two groups that share tokens, but are apart from each other's hub; and texts that drift from one to quite another.
    for g in range(2):
        for k in range(30):
            own = base[:120] + [f"g{g}w{j}" for j in range(80)]
            own[r.randrange(120, 200)] = f"x{g}y{k}"
            rows.append((100 * g + k, " ".join(own)))
    rows += [(300 + k, " ".join([f"d{j}" for j in range(2 * k)] + base[2 * k :])) for k in range(80)]
    seen, got = rows_of_splits_and_cells(spark, monkeypatch, rows)
    assert got == brute_links(rows) and seen["cells"] and (seen["split"] > 0) == (levels > 1)


def test_similar_reaches_its_recall_where_no_hub_helps(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 1)
    monkeypatch.setattr(jaccard, "hubs_of", lambda members, least_equal, name: members.selectExpr("*", "-1L as hub", "false as near", "n as apart"))
    rows = pairs_at_the_threshold(2500)
    got = jaccard.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("n_links = 0").count() // 2 <= 2


def test_runs_reach_the_recall_at_the_deepest_level():
    runs = jaccard.runs_for(0.8, 0.9999)
    assert jaccard.missed_share(0.8, 0.9999, runs, jaccard.LEVELS) <= 1e-4 < jaccard.missed_share(0.8, 0.9999, runs - 1, jaccard.LEVELS)
    assert sum(jaccard.agreement(0.8)[: jaccard.least_agreement(0.8, 0.9999)]) <= 2.5e-5
    with pytest.raises(ValueError):
        jaccard.runs_for(0.8, 1.0)


def test_one_of_each_keeps_the_least(spark):
    rows = [*near_copies(6, 50), (1, None), (None, "x y"), (2, "alone here")]
    kept = cases.ordered(jaccard.one_of_each(cases.table(spark, rows)), "doc_id")
    assert kept == [(1,), (2,), (50_000,), (None,)]


def test_one_of_each_decides_rows_that_share_an_id_by_their_texts(spark):
    first, near = near_copies(1, 51)[0][1], near_copies(1, 51)[0][1] + " end"
    clean = [cases.passage(70 + k, 60) for k in range(6)]
    rows = [(3, first), *[(k, first) for k in (5, 6, 7)], *[(k, near) for k in (8, 9)]]
    rows += [(k, t) for k, t in zip((5, 6, 7, 8, 9), clean)] + [(9, clean[4]), (9, clean[5]), (9, None), (4, None), (4, None)]
    kept = cases.ordered(jaccard.one_of_each(cases.table(spark, rows)), "doc_id", "text")
    want = [(3, first), *zip((5, 6, 7, 8, 9, 9), clean), (9, None), (4, None)]
    assert kept == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


# 4


def spoken(r, langs, n, words=(3, 60)):
    syllables = {"aa": ["ba", "na", "ka", "la"], "bb": ["th", "er", "on", "st"], "cc": ["ou", "é", "eau", "ç"], "zz": ["xq", "wv", "jj", "ž"]}
    say = lambda k, m: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randint(1, 4))) for _ in range(m))
    return [(say(k, r.randint(*words)), k) for k in (r.choice(langs) for _ in range(n))]


def brute_grams(text):
    """Buckets of all n-grams of a text, byte by byte."""
    import numpy as np

    raw = text.encode()
    folded = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in b" " + raw + b" ")
    folded = re.sub(b" +", b" ", folded)
    out = []
    for k in (2, 3, 4):
        for a in range(len(folded) - k + 1):
            code = int.from_bytes(folded[a : a + k], "big") + (k << 56)
            out.append(int(hashing.mix(np.array([code], np.uint64))[0]) & (language.BUCKETS - 1))
    return out


def brute_languages(learned, texts):
    """(language, whether it is rejected) by the definition: ``learned`` are (text, language, whether it calibrates)."""
    import math
    from statistics import median

    names = sorted({k for _, k, _ in learned})
    codes = language.codewords(len(names)).tolist()
    share = {}
    for k in names:
        n = Counter(g for t, own, c in learned if own == k and not c for g in brute_grams(t))
        total = sum(n.values()) + 0.05 * language.BUCKETS
        share[k] = lambda g, n=n, total=total: (n[g] + 0.05) / total

    def margins(text):
        grams = brute_grams(text)
        out = []
        for b in range(len(codes[0])):
            yes = [k for k, c in zip(names, codes) if c[b] > 0]
            no = [k for k, c in zip(names, codes) if c[b] < 0]
            out.append(sum(math.log(sum(share[k](g) for k in yes) / len(yes)) - math.log(sum(share[k](g) for k in no) / len(no)) for g in grams) / max(1, len(grams)))
        return out

    known = [(margins(t), names.index(k)) for t, k, c in learned if c]
    cut, scale, trust = [], [], []
    for b in range(len(codes[0])):
        typical = [median(m[b] for m, j in known if j == k) for k in range(len(names))]
        top = [x for x, c in zip(typical, codes) if c[b] > 0]
        low = [x for x, c in zip(typical, codes) if c[b] < 0]
        top, low = sum(top) / len(top), sum(low) / len(low)
        cut.append((top + low) / 2)
        scale.append(4 / ((top - low) / 2))
        right = [[(m[b] - cut[b]) * codes[j][b] > 0 for m, j in known if j == k] for k in range(len(names))]
        trust.append(min(1, max(0.05, 2 * sum(sum(x) / len(x) for x in right) / len(right) - 1)))
    out = []
    for t in texts:
        if not t or not any(map(str.isalpha, t)):
            out.append(("und", True))
            continue
        m = margins(t)
        loss = [sum(w * math.log1p(math.exp(-(x - z) * s * c)) for x, z, s, w, c in zip(m, cut, scale, trust, code)) for code in codes]
        out.append((names[loss.index(min(loss))], min(loss) > language.FAR * math.log(2) * sum(trust)))
    return out


def sampled_rows(spark, docs):
    """The rows that ``fit`` learns from, and which of them calibrate."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rows = docs.filter("text is not null and lang is not null").withColumn("r", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("r", "doc_id")))
    return [(x.text, x.lang, x.n % language.CALIBRATE == 0) for x in rows.collect()]


def test_languages_equal_brute_force(spark):
    r = random.Random(6)
    rows = [(i, *x) for i, x in enumerate(spoken(r, ["aa", "bb", "cc"], 120, (3, 20)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    odd = [t for _, t in cases.texts() if t is None or len(t) < 900] + [t for t, _ in spoken(r, ["zz", "aa", "bb", "cc"], 40, (1, 12))] + ["ba th", "Lana ERON"]
    got = language.languages(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [(x.lang_pred, x.far) for x in got] == brute_languages(sampled_rows(spark, docs), odd)
    assert sum(x.far for x in got) > 10 and sum(not x.far for x in got) > 20


def test_languages_are_told_apart(spark):
    r = random.Random(6)
    rows = [(i, *x) for i, x in enumerate(spoken(r, ["aa", "bb", "cc"], 400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.languages(docs, language.fit(docs.filter(~language.is_held_out(docs["doc_id"])))).join(docs, "doc_id").collect()
    held = [x for x in out if zlib.crc32(str(x.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and sum(x.lang_pred == x.lang for x in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 for x in out) and not any(x.far for x in out)
    model = language.fit(docs)
    odd = {x.doc_id: x for x in language.languages(cases.table(spark), model).collect()}
    for i in (7, 8, 9, 10):
        assert odd[i].lang_pred == "und" and odd[i].score == 0 and not odd[i].ambiguous and odd[i].far
    assert odd[12].lang_pred in ("aa", "bb", "cc")


def test_known_language_rejects_what_no_codeword_fits(spark):
    r = random.Random(16)
    rows = [(i, *x) for i, x in enumerate(spoken(r, ["aa", "bb", "cc"], 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    foreign = [(1000 + i, t, None) for i, (t, _) in enumerate(spoken(r, ["zz"], 50, (10, 40)))]
    given = docs.unionByName(spark.createDataFrame([*foreign, (2000, None, "aa"), (2001, "12 3", "bb")], docs.schema))
    stay = {x.doc_id for x in language.known_language(given, language.fit(docs)).collect()}
    assert stay == {i for i, *_ in rows}


def test_calibration_reads_long_texts_too(spark):
    r = random.Random(26)
    rows = [(i, *x) for i, x in enumerate(spoken(r, ["aa", "bb", "cc"], 24, (6000, 7000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert (model.trust == 1).all() and (model.scale < 100).all()
    assert not any(x.far or x.ambiguous for x in language.languages(docs, model).collect())


def test_language_without_labels_or_rows(spark, monkeypatch):
    docs = cases.table(spark)
    none = docs.filter("false")
    assert {x.lang_pred for x in language.languages(docs, language.fit(none)).collect()} == {"und"}
    assert language.known_language(docs, language.fit(none)).count() == 0
    single = language.fit(spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string"))
    assert {x.lang_pred for x in language.languages(docs, single).collect()} == {"und", "xx"}
    monkeypatch.setattr(language, "LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.fit(docs)


def test_codewords_are_distinct():
    for k in range(2, 40):
        codes = language.codewords(k)
        assert len({tuple(c) for c in codes.tolist()}) == k and set(codes.ravel().tolist()) <= {1.0, -1.0}


# 5


def brute_repeats(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least: dict[tuple, int] = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {x for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for x in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("window", [50, 64, 17])
def test_repeats_equal_brute_force(spark, window):
    rows = cases.texts() + near_copies(5, 60) + [(300 + k, f"{cases.passage(70 + k, 30)} {cases.passage(1, 70)}" + f" {cases.passage(80 + k % 2, 120)}") for k in range(6)]
    got = cases.ordered(repeats.without_repeats(cases.table(spark, rows), window), "doc_id", "n_words", "n_removed", "text")
    assert got == brute_repeats(rows, window)
    assert repeats.level_lengths(64) == [16, 32, 64] and repeats.level_lengths(50) == [25, 50]


# 6


def test_packing_loses_nothing(spark):
    import numpy as np

    capacity, lib = 64, tiktoken_encoding()
    packs = packing.position_ids(packing.packed(cases.table(spark), BYTE_BPE, capacity)).collect()
    docs: dict = {}
    for p in packs:
        ids = np.frombuffer(p.ids, np.uint16)
        assert len(ids) == capacity and p.cu_seqlens[0] == 0 and p.cu_seqlens[-1] == p.n_tokens <= capacity
        assert p.position_resets == p.cu_seqlens[:-1] and (ids[p.n_tokens :] == 50256).all()
        assert p.position_ids == [k - a for a, b in zip(p.cu_seqlens, p.cu_seqlens[1:]) for k in range(a, b)]
        for d, at, a, b in zip(p.doc_ids, p.doc_offsets, p.cu_seqlens, p.cu_seqlens[1:]):
            docs.setdefault(d, []).append((at, ids[a:b].tolist()))
    assert len({p.pack_id for p in packs}) == len(packs)
    want: dict = {}
    for i, t in cases.texts():
        if ids := lib.encode_ordinary(t or ""):
            want.setdefault(i, []).extend((k, ids[k : k + capacity]) for k in range(0, len(ids), capacity))
    assert {k: sorted(v) for k, v in docs.items()} == {k: sorted(v) for k, v in want.items()}


def test_best_fit_equals_a_plain_search():
    r = random.Random(8)
    for _ in range(50):
        capacity = r.randint(1, 90)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        rows = packing.best_fit(sizes, capacity)
        assert sorted(x for row in rows for x in row) == list(range(len(sizes)))
        left: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [x for x in left if x >= s]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - s)
            else:
                left.append(capacity - s)
        assert sorted(left) == sorted(capacity - sum(sizes[x] for x in row) for row in rows)


# 7


def test_shards_are_contiguous_and_balanced(spark):
    rows = cases.texts() + [(5000 + k, cases.passage(k, 40)) for k in range(400)]
    out = sharding.shard_by_bytes(cases.table(spark, rows), 5).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    order = sorted(out, key=lambda x: (x.shard, x.slot))
    ids = [-(2**60) if x.doc_id is None else x.doc_id for x in order]
    assert ids == sorted(ids)
    total, running = sum(x.size for x in out), 0
    for x in order:
        assert x.shard == min(4, (2 * running + x.size) * 5 // (2 * total)) and x.law == "bytes" and x.grown_shard is None
        running += x.size
    for s in {x.shard for x in out}:
        assert sorted(x.slot for x in out if x.shard == s) == list(range(sum(x.shard == s for x in out)))


# 9


def brute_topk(rows, k=5):
    import math

    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(16)]) for i in range(420)]
    rows += [(1000 + k, list(rows[k][1])) for k in range(60)]  # ties
    rows += [(500, None), (550, [float("nan")] * 16), (600, [None] + [0.1] * 15), (650, [float("inf")] + [0.1] * 15), (None, [0.1] * 16), (700, [0.5] * 4), (701, [0.25] * 4), (750, [1e4] * 16), (800, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cases.ordered(topk.top_products(df, df["vec_id"] % 50 == 0), "query_id", "rank", "vec_id", "score")
    assert got == brute_topk(rows)


def test_topk_bounds_prune(spark):
    import numpy as np

    r = np.random.default_rng(10)
    v = np.floor(256 * r.normal(0, 0.125, (3000, 32)))
    q, ids = v[:40], np.arange(3000)
    row, col, score = topk.search(q, ids[:40], topk.Lists(ids, v), 5)
    full = q @ v.T
    full[np.arange(40), np.arange(40)] = -np.inf
    for k in range(40):
        want = np.lexsort((ids, -full[k]))[:5]
        assert col[row == k].tolist() == want.tolist() and score[row == k].tolist() == full[k][want].tolist()


def test_topk_stops_before_the_lists_end(monkeypatch):
    import numpy as np

    # One component decides, so a part of the lists is enough; final scores are then resolved.
    r, read = np.random.default_rng(12), []
    v = np.floor(256 * np.column_stack([r.exponential(1, 4000), r.normal(0, 0.002, (4000, 7))]))
    lists = topk.Lists(np.arange(4000), v)
    plain = lists.read
    lists.read = lambda a, b, kind: (read.append((a, b)), plain(a, b, kind))[1]
    row, col, score = topk.search(v[:9], np.arange(9), lists, 5)
    assert sum(b - a for a, b in read) < 4000
    full = v[:9] @ v.T
    full[np.arange(9), np.arange(9)] = -np.inf
    for k in range(9):
        want = np.lexsort((np.arange(4000), -full[k]))[:5]
        assert col[row == k].tolist() == want.tolist() and score[row == k].tolist() == full[k][want].tolist()


@pytest.mark.parametrize("size", [4.0, 3e5, 2e6])
def test_topk_of_large_components(spark, size):
    r = random.Random(13)
    rows = [(i, [r.uniform(-size, size) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert cases.ordered(topk.top_products(df, df["vec_id"] % 50 == 0), "query_id", "rank", "vec_id", "score") == brute_topk(rows)


@pytest.mark.parametrize("size", [4e9, 1e300])
def test_topk_refuses_what_may_not_fit(spark, size):
    df = spark.createDataFrame([(0, [size] * 4), (1, [1.0] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64-bit"):
        topk.top_products(df, df["vec_id"] % 50 == 0)


# 10


def brute_leaks(rows, items, size=10):
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = cases.WORD.findall(cases.low(t or ""))
        if i is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = cases.WORD.findall(cases.low(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= s
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


ITEMS = [(1, cases.passage(8, 10)), (2, cases.passage(1, 30)), (3, None), (4, ""), (5, "!!"), (None, cases.passage(2, 40)), (6, cases.passage(9, 5)), (10, cases.passage(9, 5)), (7, cases.passage(2, 120).upper()), (7, "one two"), (8, cases.passage(99, 50))]


@pytest.mark.parametrize("block", [8 << 20, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.leaks(cases.table(spark), items).withColumn("items", F.array_join("items", ","))
    want = brute_leaks(cases.texts(), ITEMS)
    assert cases.ordered(out, "doc_id", "n_words", "n_hit", "items") == want
    clean = decontaminate.without_leaks(cases.table(spark), items)
    assert clean.columns == cases.table(spark).columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _, hit, _ in want if not hit)


@pytest.mark.parametrize("block", [8 << 20, 0])
def test_leaks_of_common_words(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    r = random.Random(22)
    say = lambda n: " ".join(r.choice("the a of to x") for _ in range(n)).replace("  ", " ")
    items = [(k, say(r.randint(1, 14))) for k in range(60)]
    rows = [(k, say(r.randint(0, 120))) for k in range(60)]
    out = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).withColumn("items", F.array_join("items", ","))
    assert cases.ordered(out, "doc_id", "n_words", "n_hit", "items") == brute_leaks(rows, items)


@pytest.mark.parametrize("block", [8 << 20, -1])
def test_leaks_without_items(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.leaks(cases.table(spark), none).collect()} == {0}


# all


def test_empty_tables(spark):
    docs = cases.table(spark, [])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (
        token_counts.token_counts(docs, WORD_BPE),
        line_dedup.drop_lines(docs),
        jaccard.similar(docs),
        jaccard.one_of_each(docs),
        language.languages(docs, language.fit(docs)),
        repeats.without_repeats(docs),
        packing.packed(docs, BYTE_BPE),
        sharding.shard_by_bytes(docs, 40),
        byte_bpe.round_trips(docs, BYTE_BPE),
        topk.top_products(vectors, vectors["vec_id"] % 50 == 0),
        decontaminate.leaks(docs, items),
    ):
        assert out.collect() == []


def test_normal_form_is_what_the_tokenizer_sees():
    assert unicodedata.normalize("NFC", "é") == "é"
    assert token_counts.load(WORD_BPE).count(["é", "é"]) == [1, 1]
