"""Operator 8: byte-level BPE encoding by a lazily determinised finite-state transducer, and streaming decoding.

The merges are compiled into a transducer.  A token sequence is the BPE encoding of its bytes exactly if every token
encodes to itself and no merge crosses the border of two neighbours; whether one does follows from how the symbols at
the border grow on either side (``Merges.fits``).  The non-deterministic machine guesses where tokens end; its states
are (place in the token trie, tokens not yet emitted).  Determinising by subsets gives states with all guesses that
are still alive, made when first reached and then kept; what all guesses agree on is emitted, so the lookahead is
bounded by the longest token.  At the end of a piece, the guess that stands at a token's end is the encoding.

All pieces of a batch run through the kept states side by side, a byte at a time: the moves made so far are a hash
table in arrays ((state, byte) -> state, emitted tokens), and only a move that no piece has taken before is worked out
from its subset.

Decoding feeds ids to a UTF-8 state machine whose steps are whole tokens (``StreamDecoder``); it gives out the bytes of
complete characters and keeps an unfinished one for the next call.

Cases: null or empty texts have no ids and decode to nothing; a null id is kept; repeated rows give a row each; other
columns are not read; an empty table gives an empty result.  No shuffle; memory is bounded by one Arrow batch and
the kept states (``STATES``).
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from grafloom.llm.shared import flat, steps, worker_model

#: Transducer states that a worker keeps before it starts afresh, and borders of two tokens whose fit it remembers.
STATES = 500_000
BORDERS = 400_000
#: Pieces that run side by side, and the number at which those left go on one after the other.
ABREAST = 1 << 15
ALONE = 8
#: Ids that the decoder is fed at a time.
FEED = 1 << 14


class Merges:
    """The vocabulary as symbols that grow by merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocab: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for word, r in ranks.items():
            self.vocab[r] = word
        self.left: list[int] = [-1] * len(self.vocab)
        self.right: list[int] = [-1] * len(self.vocab)
        self.whole: list[bool] = [False] * len(self.vocab)  # the token encodes to itself
        for r, word in enumerate(self.vocab):
            if len(word) == 1:
                self.whole[r] = True
            for k in range(1, len(word)):
                a, b = ranks.get(word[:k], r), ranks.get(word[k:], r)
                if a < r and b < r and self.whole[a] and self.whole[b] and self.fits(a, b, below=r):
                    self.left[r], self.right[r], self.whole[r] = a, b, True
                    break

    def growth(self, token: int, side: list[int]) -> list[int]:
        """The symbols that stood at one border of ``token``, the youngest first."""
        out = [token]
        while (token := side[token]) >= 0:
            out.append(token)
        return out

    def fits(self, a: int, b: int, below: int | None = None) -> bool:
        """Whether tokens a and b stay apart next to each other; with ``below``, before the merge of that rank.

        The symbols at the border are followed back in time: a cross merge of two of them happens if its rank comes
        before either symbol has grown further, where of equal ranks the left place goes first.
        """
        ranks, vocab = self.ranks, self.vocab
        lefts, rights = self.growth(a, self.right), self.growth(b, self.left)
        i = j = 0
        end_a = end_b = below if below is not None else len(vocab)
        while True:
            cross = ranks.get(vocab[lefts[i]] + vocab[rights[j]])
            if cross is not None and cross < end_a and (cross <= end_b if j else cross < end_b):
                return False
            more_a, more_b = i + 1 < len(lefts), j + 1 < len(rights)
            if not more_a and not more_b:
                return True
            born_a, born_b = (lefts[i] if more_a else -1), (rights[j] if more_b else -1)
            if born_a > born_b:
                end_a = born_a
                i += 1
            elif born_b > born_a:
                end_b = born_b
                j += 1
            else:  # grown by the same merge rank: the left place first, so in between only the left one had grown
                end_b = born_b
                j += 1


class Moves:
    """(state, byte) -> (state, output) as a hash table in arrays, with linear probing."""

    def __init__(self):
        self.clear(1 << 12)

    def clear(self, size: int) -> None:
        import numpy as np

        self.keys, self.to, self.out, self.held = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int32), 0

    def places(self, keys):
        """Where each key is, or the free place at which its search ends."""
        import numpy as np

        from grafloom.llm.hashing import mix

        at = (mix(keys.view(np.uint64)) & np.uint64(len(self.keys) - 1)).view(np.int64)
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            left = left[(self.keys[at[left]] != keys[left]) & (self.keys[at[left]] >= 0)]
        return at

    def add(self, keys, to, out) -> None:
        """Adds distinct keys that are not there yet."""
        import numpy as np

        if 2 * (self.held + len(keys)) > len(self.keys):
            old = self.keys >= 0
            k, t, o = self.keys[old], self.to[old], self.out[old]
            self.clear(1 << (4 * (len(k) + len(keys))).bit_length())
            self.add(k, t, o)
        self.held += len(keys)
        while len(keys):
            at = self.places(keys)
            self.keys[at] = keys  # of several keys that end on one free place, one stays
            won = self.keys[at] == keys
            self.to[at[won]], self.out[at[won]] = to[won], out[won]
            keys, to, out = keys[~won], to[~won], out[~won]


class Transducer:
    def __init__(self, merges: Merges):
        import numpy as np

        self.m = merges
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for r, word in enumerate(merges.vocab):
            at = 0
            for byte in word:
                nxt = self.children[at].get(byte)
                if nxt is None:
                    nxt = self.children[at][byte] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                at = nxt
            if word and merges.whole[r]:
                self.token[at] = r
        # A piece that is in the vocabulary is that token, even where merges do not lead there.
        self.odd = {w: r for r, w in enumerate(merges.vocab) if w and not merges.whole[r]}
        self.odd_sizes = np.unique(np.array([len(w) for w in self.odd], np.int64))
        self.border: dict[int, bool] = {}
        self.moves = Moves()
        self.reset()

    def reset(self) -> None:
        import numpy as np

        vocab = len(self.m.vocab)
        self.moves.clear(1 << 12)
        self.names: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.final = np.zeros(1 << 12, np.int32)
        # Outputs: number r < vocab is the token r; later numbers are the tuples in ``several``, the first nothing.
        self.several: list[tuple[int, ...]] = [()]
        self.numbers = {(): vocab}
        self.out_at, self.out_size, self.out_flat = np.arange(vocab), np.ones(vocab, np.int64), np.arange(vocab)
        self.number([-1, 0, 0], ())

    def output(self, tokens: tuple[int, ...]) -> int:
        if len(tokens) == 1:
            return tokens[0]
        number = self.numbers.get(tokens)
        if number is None:
            number = self.numbers[tokens] = len(self.m.vocab) + len(self.several)
            self.several.append(tokens)
        return number

    def tokens(self, output: int) -> tuple[int, ...]:
        vocab = len(self.m.vocab)
        return (output,) if output < vocab else self.several[output - vocab]

    def expanded(self, outputs):
        """(tokens of all outputs one after the other, number of tokens of each)."""
        import numpy as np

        from grafloom.llm.hashing import ragged

        fresh = self.several[len(self.out_size) - len(self.m.vocab) :]
        if fresh:
            size = np.array([len(x) for x in fresh], np.int64)
            self.out_at = np.concatenate([self.out_at, len(self.out_flat) + np.cumsum(size) - size])
            self.out_size = np.concatenate([self.out_size, size])
            self.out_flat = np.concatenate([self.out_flat, np.array([t for x in fresh for t in x], np.int64)])
        size = self.out_size[outputs]
        return self.out_flat[ragged(self.out_at[outputs], size)], size

    def fits(self, p: int, t: int) -> bool:
        key = p * len(self.token) + t
        ok = self.border.get(key)
        if ok is None:
            if len(self.border) > BORDERS:
                self.border.clear()
            ok = self.border[key] = self.m.fits(p, t)
        return ok

    def number(self, subset: list[int], rest: tuple[int, ...]) -> int:
        """The number of a subset of guesses, written as the last token emitted and, for each guess, its place in the
        trie, the number of tokens it holds, and these; ``rest`` is what the last guess, at a token's end, holds."""
        name = array("i", subset).tobytes()
        number = self.names.get(name)
        if number is None:
            number = self.names[name] = len(self.states)
            if number == len(self.final):
                self.final.resize(2 * number, refcheck=False)
            self.states.append(name)
            self.final[number] = self.output(rest)
        return number

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state and the tokens emitted, worked out from the state's subset."""
        children, token = self.children, self.token
        subset = array("i", self.states[state]).tolist()
        alive, root, at = [], None, 1
        while at < len(subset):
            stop = at + 2 + subset[at + 1]
            nxt = children[subset[at]].get(byte)
            if nxt is not None:
                t = token[nxt]
                if t >= 0 and root is None:
                    p = subset[stop - 1] if stop > at + 2 else subset[0]
                    if p < 0 or self.fits(p, t):
                        root = subset[at + 2 : stop]
                        root.append(t)
                if children[nxt]:
                    alive.append((nxt, subset[at + 2 : stop]))
            at = stop
        sure = len(root)
        for _, held in alive:
            if len(held) < sure:
                sure = len(held)
            while held[:sure] != root[:sure]:
                sure -= 1
        last = root[sure - 1] if sure else subset[0]
        made = [last]
        for nxt, held in alive:
            made += (nxt, len(held) - sure)
            made += held[sure:]
        rest = root[sure:]
        made += (0, len(rest))
        made += rest
        return self.number(made, tuple(rest)), tuple(root[:sure])

    def run(self, states, data):
        """The next states and the outputs of many moves; those not taken before are worked out and kept."""
        import numpy as np

        keys = (states << 8) | data
        at = self.moves.places(keys)
        new = self.moves.keys[at] != keys
        if new.any():
            made = np.unique(keys[new])
            self.keep(made, [self.move(k >> 8, k & 0xFF) for k in made.tolist()])
            at = self.moves.places(keys)
        return self.moves.to[at].astype(np.int64), self.moves.out[at].astype(np.int64)

    def keep(self, keys, moves: list[tuple[int, tuple[int, ...]]]) -> None:
        import numpy as np

        n = len(moves)
        self.moves.add(keys, np.fromiter((m[0] for m in moves), np.int32, n), np.fromiter((self.output(m[1]) for m in moves), np.int32, n))

    def alone(self, name: bytes, data: bytes) -> list[int]:
        """The tokens of a piece's rest from a state on, by the same moves one at a time."""
        import numpy as np

        state, known, out = self.resumed(name), {}, []
        for byte in data:
            step = known.get(state << 8 | byte)
            if step is None:
                if len(self.states) > 2 * STATES:
                    name = self.states[state]
                    self.reset()
                    state, known = self.resumed(name), {}
                step = known[state << 8 | byte] = self.move(state, byte)
            state = step[0]
            out += step[1]
        out += self.tokens(int(self.final[state]))
        keys = np.fromiter(known, np.int64, len(known))
        new = self.moves.keys[self.moves.places(keys)] != keys
        self.keep(keys[new], [known[k] for k in keys[new].tolist()])
        return out

    def resumed(self, name: bytes) -> int:
        subset = array("i", name).tolist()
        at = 1
        while at + 2 + subset[at + 1] < len(subset):
            at += 2 + subset[at + 1]
        return self.number(subset, tuple(subset[at + 2 :]))

    def encode(self, piece: bytes) -> tuple[int, ...]:
        import numpy as np

        return tuple(self.encode_all(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0].tolist())

    def encode_all(self, raw, a, b):
        """(token ids of the pieces raw[a[k]:b[k]] one after the other, number of ids of each)."""
        import numpy as np

        ids, sizes = [], []
        for at in range(0, len(a), ABREAST):
            if len(self.states) > STATES:
                self.reset()
            x, n = self.abreast(raw, a[at : at + ABREAST], b[at : at + ABREAST])
            ids.append(x)
            sizes.append(n)
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(sizes)

    def abreast(self, raw, a, b):
        import numpy as np

        from grafloom.llm.hashing import ragged

        order = np.argsort(a - b, kind="stable")  # the longest first, so those still running are the first ones
        start, size = a[order], (b - a)[order]
        running = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1), "left")  # pieces of more than i bytes
        state, nothing, i = np.zeros(len(a), np.int64), len(self.m.vocab), 0
        owners, outputs = [], []
        while running[i] > ALONE:
            n = running[i]
            state[:n], out = self.run(state[:n], raw[start[:n] + i])
            on = np.flatnonzero(out != nothing)
            owners.append(on)
            outputs.append(out[on])
            i += 1
        left = int(running[i])
        owners.append(np.arange(left, len(a)))
        outputs.append(self.final[state[left:]].astype(np.int64))
        tokens, many = self.expanded(np.concatenate(outputs))
        owner = np.repeat(np.concatenate(owners), many)
        names = [self.states[k] for k in state[:left].tolist()]
        rests = [self.alone(name, raw[start[k] + i : start[k] + size[k]].tobytes()) for k, name in enumerate(names)]
        tokens = np.concatenate([tokens, np.array([t for x in rests for t in x], np.int64)])
        owner = order[np.concatenate([owner, np.repeat(np.arange(left), [len(x) for x in rests])])]
        for k in np.flatnonzero(np.isin(b - a, self.odd_sizes)).tolist() if self.odd else ():
            odd = self.odd.get(raw[a[k] : b[k]].tobytes())
            if odd is not None:
                keep = owner != k
                tokens, owner = np.append(tokens[keep], odd), np.append(owner[keep], k)
        return tokens[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(a))




#: States of the UTF-8 machine: 0 between characters; 1 to 3 so many bytes to come; then what must follow E0, ED, F0, F4.
_NEXT = {4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2), 1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2)}
BAD = 8


def utf8_table():
    """(state, byte) -> state."""
    import numpy as np

    t = np.full((9, 256), BAD, np.int8)
    t[0, :0x80] = 0
    t[0, 0xC2:0xE0] = 1
    t[0, 0xE0:0xF0] = 2
    t[0, 0xF0:0xF5] = 3
    t[0, [0xE0, 0xED, 0xF0, 0xF4]] = [4, 5, 6, 7]
    for s, (a, b, to) in _NEXT.items():
        t[s, a : b + 1] = to
    return t


class Codec:
    def __init__(self, path: str):
        import numpy as np

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.machine = Transducer(Merges(ranks))
        vocab = self.machine.m.vocab
        self.vocab = vocab
        self.size = np.array([len(w) for w in vocab], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(vocab), np.uint8)
        decimals = [str(r).encode() + b" " for r in range(len(vocab))]
        self.digits = np.frombuffer(b"".join(decimals), np.uint8)
        self.digit_size = np.array([len(d) for d in decimals], np.int64)
        self.digit_at = np.cumsum(self.digit_size) - self.digit_size
        table, longest = utf8_table(), int(self.size.max())
        # For each state of the UTF-8 machine: the state after a whole token, and the bytes then open in it.
        self.after, self.open = np.empty((9, len(vocab)), np.int8), np.empty((9, len(vocab)), np.int64)
        for s in range(9):
            state, opened = np.full(len(vocab), s, np.int8), np.zeros(len(vocab), np.int64)
            for k in range(longest):
                on = np.flatnonzero(self.size > k)
                state[on] = table[state[on], self.raw[self.at[on] + k]]
                opened[on] = np.where(state[on] == 0, 0, opened[on] + 1)
            self.after[s], self.open[s] = state, opened

    def encode(self, raw, offsets):
        """(ids, where each text's ids begin and end) of the texts raw[offsets[k]:offsets[k + 1]]; every distinct piece
        runs through the transducer."""
        import numpy as np

        from grafloom.llm.hashing import ragged
        from grafloom.llm.pieces import code_points, cut, distinct_slices

        points, places = code_points(raw)
        heads = np.searchsorted(places, offsets)
        start, end = cut(points, heads[:-1], spaced=True)
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        a, b = places[start], places[end]
        first, codes = distinct_slices(raw, a, b)
        every, size = self.machine.encode_all(raw, a[first], b[first])
        ids = every[ragged((np.cumsum(size) - size)[codes], size[codes])]
        return ids, np.append(0, np.cumsum(size[codes]))[np.searchsorted(start, heads)]

    def decimal(self, ids) -> bytes:
        """The ids as decimal numbers, each with a blank behind it."""
        from grafloom.llm.hashing import ragged

        return self.digits[ragged(self.digit_at[ids], self.digit_size[ids])].tobytes()

    def bytes_of(self, ids) -> bytes:
        from grafloom.llm.hashing import ragged

        return self.raw[ragged(self.at[ids], self.size[ids])].tobytes()

    def walk(self, ids, state: int, opened: int) -> tuple[int, int]:
        """(state, bytes open in an unfinished character) of the UTF-8 machine after ``ids``; the state is ``BAD`` once
        bytes are not UTF-8.  Tokens of whole characters leave state 0 as it is and are stepped over together."""
        import numpy as np

        odd, n, i = np.flatnonzero(self.after[0][ids]), len(ids), 0
        while i < n:
            if state == 0:
                k = np.searchsorted(odd, i)
                if k == len(odd):
                    return 0, 0
                i, opened = int(odd[k]), 0
            t = int(ids[i])
            inside = int(self.open[state, t])
            opened = opened + inside if inside == self.size[t] else inside
            state = int(self.after[state, t])
            if state == BAD:
                return BAD, 0
            i += 1
        return state, opened


class StreamDecoder:
    """Bytes from ids as they come: ``feed`` returns those of the characters that are complete."""

    def __init__(self, codec: Codec):
        self.codec, self.held, self.state = codec, b"", 0

    def feed(self, ids: Iterable[int]) -> bytes:
        import numpy as np

        ids = np.asarray(ids, np.int64)
        data = self.held + self.codec.bytes_of(ids)
        self.state, opened = self.codec.walk(ids, self.state, len(self.held))
        if self.state == BAD:
            raise ValueError("the ids do not decode to UTF-8")
        self.held = data[len(data) - opened :]
        return data[: len(data) - opened]

    def close(self) -> None:
        if self.held:
            raise ValueError("the ids end within a character")

    def decode(self, ids) -> Iterator[bytes]:
        """All of a document's ids, a part at a time."""
        for at in range(0, len(ids), FEED):
            yield self.feed(ids[at : at + FEED])
        self.close()


def load(path: str) -> Codec:
    return worker_model(("byte_bpe", path), lambda: Codec(path))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(vocabulary)
        for part in steps(batches, "t"):
            ids, bounds = codec.encode(*flat(part.column("t")))
            yield pa.RecordBatch.from_arrays([part.column("i"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); null where the ids are null or not UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = load(vocabulary)
        for batch in batches:
            out: list[str | None] = []
            for ids in batch.column("ids"):
                try:
                    out.append(b"".join(StreamDecoder(codec).decode(np.asarray(ids.as_py(), np.int64))).decode("utf-8") if ids.is_valid else None)
                except ValueError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(out, pa.string())], names=[id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("i"), "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trips(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row: digests of its ids and of what the stream decoder makes of
    them; then, if asked for, the ids as array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = load(vocabulary)
        for part in steps(batches, "t"):
            ids, bounds = codec.encode(*flat(part.column("t")))
            digits = memoryview(codec.decimal(ids))
            places = np.append(0, np.cumsum(codec.digit_size[ids]))[bounds].tolist()
            ends = bounds.tolist()
            sha_ids, sha_text = [], []
            for k in range(part.num_rows):
                sha_ids.append(hashlib.sha256(digits[places[k] : max(places[k], places[k + 1] - 1)]).hexdigest())
                digest = hashlib.sha256()
                for data in StreamDecoder(codec).decode(ids[ends[k] : ends[k + 1]]):
                    digest.update(data)
                sha_text.append(digest.hexdigest())
            columns = [part.column("i"), pa.array(np.diff(bounds)), pa.array(sha_ids, pa.string()), pa.array(sha_text, pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select(docs[id_col].alias("i"), docs[text_col].alias("t")).mapInArrow(run, schema)
