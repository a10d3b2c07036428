"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled to arcs of two transducers: the pieces as a tree of character arcs whose final states write a
piece, and byte fallback for characters without a piece. The normaliser (escaped spaces, dummy prefix) is not compiled: it
is applied to the text before, and models with a table of normalisation rules are refused. Each text is composed with them: a state is a place in the text and the piece written last, an arc leads over the characters of
one piece. Arcs are relaxed in the order of the text by (min, +), and the best path is the shortest.

A unigram model puts its negated scores on the arcs of pieces. The merges of a BPE model are no sum of piece weights, so
there the weight sits on the arc from one piece to the next: 0 where the two stay apart when their joined text is
merged by itself, infinite elsewhere. In order of their scores, the merges inside a piece and at its borders run as they
run in the whole text, so the result of merging is a path of weight 0, and the only one: no text is merged outright.
That holds where a piece has a lower score than the pieces it is merged from, which is checked piece by piece.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.hashing import U, mix
from driftmark.llm.token_store import chunks

SPACE = "▁"
#: Piece types and model types of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INF = float("inf")
UNKNOWN_PENALTY = 10.0
#: Weights between pieces that a machine keeps; distinct parts composed at once; bytes of text encoded at once.
JUNCTION_BITS = 20
JUNCTIONS = 1 << JUNCTION_BITS
PARTS = 50_000
BATCH = 1 << 23


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes | float]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def whole() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = whole()
        kind = key & 7
        if kind == 0:
            yield key >> 3, whole()
        else:
            size = {1: 8, 5: 4}.get(kind) or whole()
            value = raw[at : at + size]
            at += size
            yield key >> 3, struct.unpack("<f", value)[0] if kind == 5 else value


class Transducer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[tuple[str, float, int]] = []
        trainer, rules = {}, {}
        for number, value in _fields(raw):
            if number == 1:
                d = dict(_fields(value))
                self.pieces.append((d[1].decode(), d.get(2, 0.0), d.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if rules.get(2) or rules.get(4, 1) or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only identity normalisers that keep white space, and unigram or BPE models, are compiled")
        self.prefix = bool(rules.get(3, 1))
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER_DEFINED)}
        self.score = [s for _, s, _ in self.pieces]
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        # The piece that stands for byte fallback, and what stands before the first piece.
        self.other, self.start = len(self.pieces), len(self.pieces) + 1
        self.longest = max(map(len, self.ids), default=1)
        self.growth: dict[int, tuple[list, list] | None] = {}
        self._compile()
        spelled = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[1:-1], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in self.pieces]
        self.spelled = pa.array(spelled, pa.binary())

    def _compile(self) -> None:
        """Arrays of the pieces' arcs, (state, character) to state, what each state writes at which weight, the pairs of
        characters inside pieces, and a table of weights between pieces, filled when they are asked for."""
        arcs: dict[int, int] = {}
        writes, beside = [-1], set()
        for piece, i in self.ids.items():
            state = 0
            for c in map(ord, piece):
                key = state << 21 | c
                if key not in arcs:
                    arcs[key] = len(writes)
                    writes.append(-1)
                state = arcs[key]
            writes[state] = i
            beside.update((ord(x) << 21 | ord(y)) for x, y in zip(piece, piece[1:]))
        if self.kind == BPE and any(chr(c) not in self.ids for pair in beside for c in (pair >> 21, pair & 0x1FFFFF)):
            raise ValueError("a piece has a character that is no piece")
        self.from_ = np.array(sorted(arcs), np.int64)
        self.to = np.array([arcs[k] for k in sorted(arcs)], np.int64)
        self.writes = np.array(writes, np.int64)
        weight = [0.0 if self.kind == BPE else -s for s in self.score]
        self.weight = np.array([*weight, UNKNOWN_PENALTY - min(self.score, default=0.0), 0.0])
        self.beside = np.array(sorted(beside), np.int64)
        # Runs of spaces only begin pieces or fill them; else texts are not cut at them.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.asked = np.full(JUNCTIONS, -1, np.int64)
        self.apart = np.zeros(JUNCTIONS, bool)

    def merged(self, text: str, steps: list | None = None) -> list[tuple[int, str]]:
        """(id or -1, text) of the symbols left by merging the best pair again and again, the leftmost of equals.
        steps, if given, gets (left, right, place) of each merge."""
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if i >= 0 and j < len(symbols) and (k := self.ids.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(queue, (-self.score[k], i, symbols[i], symbols[j]))

        for i in range(len(symbols)):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
                continue
            symbols[i], symbols[j] = left + right, None
            if steps is not None:
                steps.append((left, right, i))
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [(self.ids.get(s, -1), s) for s in symbols if s is not None]

    def grown(self, piece: int) -> tuple[list, list] | None:
        """How the first and the last symbol of a piece grow while it is merged: (text, weight of the merge that
        ends that state). None for a piece that merging its text does not give."""
        if piece not in self.growth:
            text, first, last = self.pieces[piece][0], [], []
            steps: list[tuple[str, str]] = []
            if [s for _, s in self.merged(text, steps)] == [text]:
                gained = [self.score[self.ids[left + right]] for left, right, _ in steps]
                if any(x < y for x, y in zip(gained, gained[1:])):
                    raise ValueError(f"the merges of piece {piece} are not in order of their scores")
                head, tail = text[0], text[-1]
                for left, right, at in steps:
                    if at == 0:
                        first.append((head, self.score[self.ids[left + right]]))
                        head = left + right
                    if at + len(left + right) == len(text):
                        last.append((tail, self.score[self.ids[left + right]]))
                        tail = left + right
                first.append((head, -INF))
                last.append((tail, -INF))
                self.growth[piece] = first, last
            else:
                self.growth[piece] = None
        return self.growth[piece]

    def joint(self, left: int, right: int) -> bool:
        """Do two pieces stay apart? A junction gives way when, at some moment of both sides' own merging, the
        symbols that meet there merge sooner than either side goes on."""
        if right == self.other:
            return True
        b = self.grown(right)
        if b is None or left >= self.other:
            return b is not None
        a = self.grown(left)
        if a is None:
            return False
        a, b = a[1], b[0]
        i = j = 0
        while True:
            (x, nx), (y, ny) = a[i], b[j]
            k = self.ids.get(x + y)
            if k is not None and self.score[k] > nx and self.score[k] >= ny:
                return False
            if nx == ny == -INF:
                return True
            if nx >= ny:
                i += 1
            else:
                j += 1

    def junctions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Is the weight from piece to piece 0? Answers are kept in a table of fixed size, later ones in place of
        earlier ones."""
        key = left * (self.start + 1) + right
        slot = (mix(key.astype(U)) >> U(64 - JUNCTION_BITS)).astype(np.int64)
        out = self.apart[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            pair, first, of = np.unique(key[new], return_index=True, return_inverse=True)
            told = np.fromiter((self.joint(*divmod(k, self.start + 1)) for k in pair.tolist()), bool, len(pair))
            self.asked[slot[new[first]]], self.apart[slot[new[first]]] = pair, told
            out[new] = told[of]
        return out

    def composed(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, characters, piece) of all arcs of texts composed with the pieces and byte fallback. codes: the
        texts' characters one behind the other; end: for each of them, where its text ends."""
        at, state = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        found = []
        spelled = np.zeros(len(codes), bool)
        for size in range(1, self.longest + 1):
            key = state << 21 | codes[at + size - 1]
            hit = np.minimum(np.searchsorted(self.from_, key), len(self.from_) - 1)
            on = self.from_[hit] == key
            at, state = at[on], self.to[hit[on]]
            piece = self.writes[state]
            here = piece >= 0
            found.append((at[here], np.full(int(here.sum()), size), piece[here]))
            if size == 1:
                spelled[at[here]] = True
            more = at + size < end[at]
            at, state = at[more], state[more]
            if not len(at):
                break
        rest = np.flatnonzero(~spelled)
        found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), self.other)))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def shortest(self, parts: pa.StringArray) -> pa.ListArray:
        """The ids on the shortest path of each text, by relaxing all texts' arcs place by place, from the left."""
        codes = np.frombuffer("".join(parts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = pc.utf8_length(parts).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        text = np.repeat(np.arange(len(size)), size)
        at, over, piece = self.composed(codes, (first + size)[text])
        place = at - first[text[at]]
        order = np.lexsort((at, place))
        at, over, piece, place = at[order], over[order], piece[order], place[order]
        steps = np.searchsorted(place, np.arange(int(size.max(initial=0)) + 1))
        # A state: its boundary (place of its next character, texts apart by one), last piece, weight, state before.
        boundary = first + np.arange(len(size))
        waiting: dict[int, list] = {0: [(boundary, np.full(len(size), self.start), np.zeros(len(size)), np.full(len(size), -1))]}
        kept, held, done = [], 0, []
        stops = np.zeros(len(codes) + len(size), bool)
        stops[boundary + size] = True
        for p in range(int(size.max(initial=0)) + 1):
            if p not in waiting:
                continue
            b, last, w, back = (np.concatenate(c) for c in zip(*waiting.pop(p), strict=True))
            # (min, +): of equal states the one of least weight stays. A unigram model's states are its places alone.
            same = b if self.kind == UNIGRAM else b * (self.start + 1) + last
            best = np.lexsort((w, same))
            best = best[np.concatenate(([True], same[best[1:]] != same[best[:-1]]))] if len(best) else best
            b, last, w, back = b[best], last[best], w[best], back[best]
            number = held + np.arange(len(b))
            kept.append((last, back))
            held += len(b)
            ends = stops[b]
            done.append((b[ends], w[ends], number[ends]))
            if p + 1 >= len(steps):
                continue
            low, high = steps[p], steps[p + 1]
            begin = at[low:high] + text[at[low:high]]
            lo, hi = np.searchsorted(b, begin, "left"), np.searchsorted(b, begin, "right")
            count = hi - lo
            arc = np.repeat(np.arange(low, high), count)
            from_ = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(len(arc))
            if self.kind == BPE:
                fine = self.junctions(last[from_], piece[arc])
                arc, from_ = arc[fine], from_[fine]
            weight, end = w[from_] + self.weight[piece[arc]], p + over[arc]
            for q in np.unique(end).tolist():
                on = end == q
                a = arc[on]
                waiting.setdefault(q, []).append((at[a] + text[at[a]] + over[a], piece[a], weight[on], number[from_[on]]))
        last, back = (np.concatenate(c) for c in zip(*kept, strict=True))
        b, w, number = (np.concatenate(c) for c in zip(*done, strict=True))
        best = np.lexsort((w, b))
        best = best[np.concatenate(([True], b[best[1:]] != b[best[:-1]]))] if len(best) else best
        if len(best) != len(size):
            raise ValueError("a text has no finite path")
        # Back along the paths of all texts, one piece a step.
        state, of, out = number[best], np.arange(len(size)), []
        stop = size.copy()
        while len(state):
            on = last[state] != self.start
            state, of = state[on], of[on]
            got = last[state]
            fell = got == self.other
            char = np.where(fell, codes[np.minimum(first[of] + stop[of] - 1, len(codes) - 1)], 0)
            out.append((of, got, char))
            stop[of] -= np.where(fell, 1, self._sizes()[got])
            state = back[state]
        of, got, char = (np.concatenate(c[::-1]) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        order = np.argsort(of, kind="stable")
        of, got, char = of[order], got[order], char[order]
        fell = got == self.other
        chars, turn = np.unique(char[fell], return_inverse=True)
        got[fell] = self.other + turn
        lists = [[i] for i in range(self.other)] + [self._fallback(chr(c)) for c in chars.tolist()]
        ids = pa.array(lists, pa.list_(pa.uint32())).take(pa.array(got))
        counts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(size)))))
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[counts]), ids.values)

    @functools.cache  # noqa: B019  machines live as long as their worker
    def _sizes(self) -> np.ndarray:
        return np.array([len(p) for p, _, _ in self.pieces] + [1, 0])

    def _fallback(self, char: str) -> list[int]:
        spelled = [self.bytes.get(b) for b in char.encode()]
        return [self.unknown] if None in spelled else spelled

    def _cut(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Parts of texts, cut where neighbouring characters stand side by side in no piece, and the parts of each text."""
        raw = "".join(texts.to_pylist())
        codes = np.frombuffer(raw.encode("utf-32-le"), np.uint32).astype(np.int64)
        size = pc.utf8_length(texts).to_numpy().astype(np.int64)
        key = codes[:-1] << 21 | codes[1:]
        hit = np.minimum(np.searchsorted(self.beside, key), max(len(self.beside) - 1, 0))
        begin = np.ones(len(codes), bool)
        if len(self.beside):
            begin[1:] = self.beside[hit] != key
        first = np.cumsum(size) - size
        begin[first[size > 0]] = True
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.concatenate((np.cumsum(width) - width, [width.sum()]))
        edges = np.append(np.flatnonzero(begin), len(codes))
        offsets = pa.py_buffer(at[edges].astype(np.int32))
        counted = np.concatenate(([0], np.cumsum(begin)))
        return pa.StringArray.from_buffers(len(edges) - 1, offsets, pa.py_buffer(raw.encode())), counted[first + size] - counted[first]

    def _words(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """The normalised texts as words with the spaces before them: (distinct words, their order, words of each text)."""
        texts = pc.replace_substring(texts, SPACE, " ")
        if not self.by_word:
            whole = pc.replace_substring(texts, " ", SPACE)
            whole = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(SPACE if self.prefix else "", whole, ""))
            coded = whole.dictionary_encode()
            return coded.dictionary, coded.indices.to_numpy(), np.ones(len(texts), np.int64)
        words = pc.split_pattern(texts, " ")
        coded = words.values.dictionary_encode()
        codes, edge = coded.indices.to_numpy().astype(np.int64), words.offsets.to_numpy().astype(np.int64)
        empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
        i = np.arange(len(codes))
        lead = np.zeros(len(codes), np.int64)  # the first place of the run of empty words before each word, in its text
        lead[edge[:-1]] = edge[:-1]
        after = np.zeros(len(codes), bool)
        after[1:] = ~empty[:-1]
        lead[after] = i[after]
        lead = np.maximum.accumulate(lead)
        start = np.zeros(len(codes), bool)
        start[edge[:-1]] = True
        spaces = i - lead + 1 - (start[lead] & (not self.prefix))
        stop = np.zeros(len(codes), bool)
        stop[edge[1:] - 1] = True
        blank = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        keep = (~empty | stop) & ~np.repeat(blank, np.diff(edge))
        pair = pa.array(spaces[keep] * max(len(coded.dictionary), 1) + codes[keep]).dictionary_encode()
        n, word = np.divmod(pair.dictionary.to_numpy(), max(len(coded.dictionary), 1))
        distinct = [SPACE * a + w for a, w in zip(n.tolist(), coded.dictionary.take(pa.array(word)).to_pylist(), strict=True)]
        counted = np.concatenate(([0], np.cumsum(keep)))
        return pa.array(distinct, pa.string()), pair.indices.to_numpy(), np.diff(counted[edge])

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; a null text counts as empty."""
        words, order, n_words = self._words(pc.fill_null(texts, "").cast(pa.string()))
        parts, n_parts = self._cut(words)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary
        done = [self.shortest(distinct.slice(i, PARTS)) for i in range(0, len(distinct), PARTS)]
        ids = pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.uint32()))
        ids = ids.take(coded.indices)
        edge = np.concatenate(([0], np.cumsum(n_parts)))
        known = pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[edge]), ids.values)
        out = known.take(pa.array(order))
        edge = np.concatenate(([0], np.cumsum(n_words)))
        return pa.ListArray.from_arrays(pa.array(out.offsets.to_numpy()[edge]), out.values)

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The inverse path: pieces spelled out, bytes gathered, the dummy prefix taken off."""
        spelled = pa.ListArray.from_arrays(ids.offsets, self.spelled.take(ids.values))
        found = pc.binary_join(spelled, b"").to_pylist()
        return [(raw[1:] if self.prefix and raw[:1] == b" " else raw).decode(errors="replace") for raw in found]


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(path)
    return _MACHINES[path]


def _blobs(ids: pa.ListArray) -> pa.BinaryArray:
    """Lists of ids as little-endian unsigned 32-bit integers."""
    raw = pa.py_buffer(ids.values.to_numpy().astype("<u4"))
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((ids.offsets.to_numpy() * 4).astype(np.int32)), raw])


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids (little-endian unsigned 32-bit integers).

    Null and empty texts have no ids. Null and repeated ids pass through, repeated rows repeat their result; other
    columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1), BATCH):
                ids = _blobs(machine(model_path).encode(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], names=["doc_id", "ids"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, ids binary")


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, ids, text). Null ids decode to an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([np.frombuffer(x or b"", "<u4") for x in batch.column(1).to_pylist()], pa.list_(pa.uint32()))
            text = machine(model_path).decode(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def encoding_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_crc32, decoded_sha256 (of the text decoded from the ids).

    Texts are encoded and decoded in one pass, so that a core runs one Python worker, with one set of tables. Null and
    empty texts have no ids and decode to an empty text. Null and repeated ids pass through, repeated rows repeat their
    result; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model_path)
        names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256"]
        for batch in batches:
            for at, texts in chunks(batch.column(1), BATCH):
                ids = m.encode(texts)
                sums = [zlib.crc32(x) for x in _blobs(ids).to_pylist()]
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in m.decode(ids)]
                columns = [pc.list_value_length(ids).cast(pa.int64()), pa.array(sums, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], names=names)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string")
