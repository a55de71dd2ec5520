"""SentencePiece encoding and decoding by weighted finite-state transduction.

A model file is compiled into three machines:

* the normaliser, which escapes spaces and adds the dummy prefix;
* the lexicon, a trie transducer from characters to pieces, with an arc from
  every character outside the vocabulary to its UTF-8 byte pieces;
* for BPE models, an acceptor over neighbouring pieces. A piece sequence is the
  model's own segmentation exactly when every neighbouring pair (and the first
  piece) segments to itself: a merge across a border would show up in the pair
  alone. Allowed pairs weigh 0, all others infinity, which is found once per
  pair by merging the two pieces' characters.

Composing the machines with an input gives a lattice over character positions;
its shortest path in the tropical semiring (min, +) is the encoding. In unigram
models arcs weigh the negative piece score, in BPE models exactly one path has
finite weight. No piece may run from a non-space into a space or over a
character outside the vocabulary such as a line feed, so every path passes
these positions: paths are found per segment between them and remembered in a
two-generation cache of bounded size, which is emptied at the end of a task
(of the decided pairs of pieces up to CACHE / 2 stay).
Long segments are not remembered.

Defined cases: null texts count as empty; an empty text has no pieces; control
pieces' names in a text are ordinary text; repeated rows are encoded alike;
U+2581 in a text decodes to a space, as in the format itself. Models with a
character map or user-defined pieces are refused, never silently misread.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the model format
START = -1
CACHE, LONGEST = 400_000, 64


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> list[tuple[int, object]]:
    """Fields of a protocol buffer message, by number."""
    at, found = 0, []
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + n], at + n
        found.append((key >> 3, value))
    return found


class Transducer:
    def __init__(self, model: bytes) -> None:
        pieces, train, norm = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                train = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2):
            raise ValueError("models with a character map are not supported")
        if any(kind == USER for _, _, kind in pieces):
            raise ValueError("models with user-defined pieces are not supported")
        self.bpe = train.get(3, 1) == 2
        if train.get(3, 1) not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.pieces = pieces
        self.text = [p for p, _, _ in pieces]
        self.unknown = next(i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.unknown_weight = 10.0 - min((self.score[i] for i in self.ids.values()), default=0.0)
        # a node is its arcs and its piece, so that a step takes one look-up
        self.trie: dict = {}
        for piece, i in self.ids.items():
            arcs = self.trie
            for c in piece[:-1]:
                arcs = arcs.setdefault(c, ({}, None))[0]
            if piece:
                arcs[piece[-1]] = (arcs.get(piece[-1], ({}, None))[0], i)
        surface = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            surface[i] = bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode()
        self.surface = surface
        cuts = not any(a != SPACE == b for p in self.ids for a, b in zip(p, p[1:], strict=False))
        feed = "" if any("\n" in p for p in self.ids) else "\n"
        self.segments = re.compile(f" *[^ {feed}]+| +{'|' * bool(feed)}{feed}" if cuts else r"(?s).+").findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empties the caches of segments; pairs of pieces hold for all texts, a bounded number of them stays."""
        self.young, self.old = {}, {}
        if len(self.pairs) > CACHE // 2:
            self.pairs = {}

    def label(self, state: int) -> str:
        """The characters of a state: pieces by id, characters outside the vocabulary as -2 - code point."""
        return self.text[state] if state >= 0 else chr(-2 - state)

    def allowed(self, a: int, b: int) -> bool:
        """Whether pieces a, b (or b at the start) segment to themselves."""
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            left = "" if a == START else self.label(a)
            whole = [left, self.label(b)] if left else [self.label(b)]
            known = self.pairs[key] = self._merge("".join(whole), len(left)) == whole
            if len(self.pairs) > 2 * CACHE:
                self.pairs = {key: known}
        return known

    def _merge(self, text: str, border: int) -> list[str] | None:
        """Merges of the highest score first; None as soon as one crosses the border."""
        parts = list(text)
        ids, score = self.ids, self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, at = score[i], k
            if best is None:
                break
            begin = sum(map(len, parts[:at]))
            if border and begin < border < begin + len(parts[at]) + len(parts[at + 1]):
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def shortest_path(self, text: str) -> list[int]:
        """States along the lightest path through the lattice of an escaped segment."""
        n = len(text)
        last: list[int | None] = [None] * (n + 1)
        begin = [0] * (n + 1)
        weight = [0.0] + [float("inf")] * n
        trie, bpe, pairs, allowed, score = self.trie, self.bpe, self.pairs, self.allowed, self.score
        for i in range(n):
            before = last[i] if i else START
            if before is None:
                continue
            node, j, single = trie, i, False
            while j < n:
                found = node.get(text[j])
                if found is None:
                    break
                j += 1
                node, piece = found
                if piece is None:
                    continue
                single = single or j == i + 1
                if bpe:
                    if last[j] is None:
                        ok = pairs.get((before, piece))
                        if ok or ok is None and allowed(before, piece):
                            last[j], begin[j] = piece, i
                elif (w := weight[i] - score[piece]) < weight[j]:
                    last[j], begin[j], weight[j] = piece, i, w
            if not single:
                state = -2 - ord(text[i])
                if bpe:
                    if last[i + 1] is None and allowed(before, state):
                        last[i + 1], begin[i + 1] = state, i
                elif (w := weight[i] + self.unknown_weight) < weight[i + 1]:
                    last[i + 1], begin[i + 1], weight[i + 1] = state, i, w
        path, at = [], n
        while at:
            path.append(last[at])
            at = begin[at]
        return path[::-1]

    def _segment(self, segment: str) -> bytes:
        found = self.old.get(segment)
        if found is None:
            out = []
            for state in self.shortest_path(segment.replace(" ", SPACE) if self.escape else segment):
                if state >= 0:
                    out.append(state)
                elif self.bytes:
                    out.extend(self.bytes[b] for b in chr(-2 - state).encode("utf-8", "surrogatepass"))
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
            found = np.array(out, np.int32).tobytes()
        if len(segment) <= LONGEST:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[segment] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.escape and SPACE in text:
            text = text.replace(SPACE, " ")
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return np.empty(0, np.int32)
        if self.prefix:
            text = " " + text
        get, slow = self.young.get, self._segment
        out = []
        for s in self.segments(text):
            ids = get(s)
            if ids is None:
                ids = slow(s)
                get = self.young.get
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def read_model(path: str = MODEL_PATH) -> bytes:
    return Path(path).read_bytes()


SLICE = 2_000_000


def _encoder(model: bytes, key: str, text: str, key_type: pa.DataType):
    names = [key, "n_tokens", "ids", "exact"]

    def rows(batches):
        t = transducer(model)

        def batch(keys, ids, exact):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(exact, pa.bool_())], names=names)

        try:
            for b in batches:
                keys, ids, exact, size = [], [], [], 0
                for k, value in zip(b.column(key), b.column(text), strict=True):
                    plain = value.as_py() or ""
                    found = t.encode(plain)
                    keys.append(k.as_py())
                    ids.append(found)
                    exact.append(t.decode(found) == plain)
                    size += len(found)
                    if size >= SLICE:
                        yield batch(keys, ids, exact)
                        keys, ids, exact, size = [], [], [], 0
                yield batch(keys, ids, exact)
        finally:
            t.forget()  # the worker lives on and serves other stages
            pa.default_memory_pool().release_unused()

    return rows


def encode_texts(docs: DataFrame, model: bytes | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_tokens, ids, exact (whether decoding ids gives the text back)."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    plain = docs.select(key, text)
    return plain.mapInArrow(_encoder(model or read_model(), key, text, to_arrow_type(kind)), f"`{key}` {kind.simpleString()}, n_tokens long, ids array<int>, exact boolean")


def _decoder(model: bytes, key: str, ids: str, key_type: pa.DataType):
    def rows(batches):
        t = transducer(model)
        for b in batches:
            texts = [t.decode(np.array(x.as_py() or [], np.int32)) for x in b.column(ids)]
            yield pa.RecordBatch.from_arrays([b.column(key).cast(key_type), pa.array(texts, pa.string())], names=[key, "text"])

    return rows


def decode_ids(encoded: DataFrame, model: bytes | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """A row per input row: key, text."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = encoded.schema[key].dataType
    return encoded.select(key, ids).mapInArrow(_decoder(model or read_model(), key, ids, to_arrow_type(kind)), f"`{key}` {kind.simpleString()}, text string")
