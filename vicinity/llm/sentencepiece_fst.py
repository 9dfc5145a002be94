"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into three transducers of explicit states and arcs (:class:`Machine`):

normaliser   characters to characters; spaces and marks become marks (written as spaces inside), lone surrogates U+FFFD,
             and the start state puts a mark in front of the text
pieces       a trie over characters; an arc without input leaves the state at the end of a piece, puts the piece out, and
             leads to the state that remembers it
byte fallback  a character that no piece has to its bytes

They are composed with each input as it is read: a state of the composition is (position in the input, trie state) within a
piece, and (position, last piece) between pieces. The tropical-semiring shortest path (least sum of arc weights) through
it is the encoding.

The model's pieces come from merges, whose result is not the path of least summed score. It is the path
on which each two neighbouring pieces are what merging their joined text gives again: if no merge
crosses any one border, none crosses all. So the constraint is in the states: the arc that leaves the state of the last piece
for another piece weighs nothing if the two go together, and infinity if not. These weights come from merging the two
pieces' characters when an arc is first met, and are kept, as are the encodings of segments. Segments are stretches that no
piece crosses the ends of: a word with the marks before it, and line feeds.

Defined results: a null or empty text has no ids and decodes to an empty one; marks in a text are taken
for spaces; lone surrogates become U+FFFD. Decoding undoes encoding for every text without marks. Models
with a precompiled character map, user-defined pieces or pieces with inner marks are refused.
Caches hold a bounded number of entries and are dropped when full. Rows repeat as given.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .substring_dedup import expand

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SEGMENTS, PAIRS = 700_000, 400_000  # cache entries in a worker
INFINITE = float("inf")
_SEGMENT = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n")


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""

    def varint() -> int:
        nonlocal i
        v = shift = 0
        while True:
            c = b[i]
            i += 1
            v |= (c & 127) << shift
            shift += 7
            if c < 128:
                return v

    i = 0
    while i < len(b):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, b[i : i + n]
        i += n


class Machine:
    """A finite-state transducer: ``arcs[state]`` gives for an input symbol the next state and the output, ``other[state]`` the
    next state for any other symbol, which is copied, and ``silent[state]`` the next state and output without input."""

    def __init__(self):
        self.arcs: list[dict[str, tuple[int, str]]] = []
        self.other: list[int | None] = []
        self.silent: list[tuple[int, object] | None] = []

    def state(self, other: int | None = None, silent: tuple[int, object] | None = None) -> int:
        self.arcs.append({})
        self.other.append(other)
        self.silent.append(silent)
        return len(self.arcs) - 1

    def run(self, text: str, state: int) -> str:
        """The output of a machine with one path for each input."""
        out = []
        if self.silent[state]:
            state, symbol = self.silent[state]
            out.append(symbol)
        for c in text:
            arc = self.arcs[state].get(c)
            state, symbol = arc if arc else (self.other[state], c)
            out.append(symbol)
        return "".join(out)


def normaliser(prefix: bool) -> Machine:
    """State 0 is before the text, state 1 within it."""
    m = Machine()
    m.state(silent=(1, " ") if prefix else (1, ""))
    m.state(other=1)
    m.arcs[1] = {" ": (1, " "), MARK: (1, " ")}
    return m


def trie(pieces: dict[str, int]) -> Machine:
    """State 0 is between pieces; the silent arc of a piece's last state puts it out. Inputs have no output."""
    m = Machine()
    m.state()
    for text, piece in pieces.items():
        at = 0
        for c in text:
            if c not in m.arcs[at]:
                m.arcs[at][c] = m.state(), ""
            at = m.arcs[at][c][0]
        m.silent[at] = 0, piece
    return m


class Transducer:
    """The compiled model; ``encode`` and ``decode`` work on one text."""

    def __init__(self, model: bytes):
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        pieces: list[bytes] = []
        self.prefix, merged = True, False
        for f, v in _fields(model):
            if f == 1:
                d = dict(_fields(v))
                text, kind, n = d[1].decode().replace(MARK, " "), d.get(3, 1), len(pieces)
                if kind == 1:
                    self.id[text], self.rank[text] = n, -struct.unpack("<f", d[2])[0]
                    pieces.append(text.encode())
                elif kind == 6:
                    self.byte[int(text[3:5], 16)] = n
                    pieces.append(bytes([int(text[3:5], 16)]))
                elif kind in (2, 3, 5):
                    pieces.append(b"")
                else:
                    raise ValueError("user-defined pieces are not supported")
            elif f == 2:
                merged = dict(_fields(v)).get(3, 1) == 2
            elif f == 3:
                d = dict(_fields(v))
                self.prefix = bool(d.get(3, 1))
                if d.get(2) or d.get(4, 1) or not d.get(5, 1):
                    raise ValueError("only the identity normaliser with escaped white space, none removed, is supported")
        if not merged:
            raise ValueError("only merge models are supported")
        if any(" " in p.lstrip(" ") or (p.startswith("  ") and p.strip(" ")) for p in self.id):
            raise ValueError("pieces with inner marks are not supported")
        self.normaliser, self.pieces = normaliser(self.prefix), trie(self.id)
        self.step = [{c: n for c, (n, _) in arcs.items()} for arcs in self.pieces.arcs]  # the trie's arcs, which have no output
        self.ends = [arc[1] if arc else -1 for arc in self.pieces.silent]
        self.text = {i: p for p, i in self.id.items()}
        size = np.array([len(p) for p in pieces])
        self.size, self.start, self.bytes = size, np.cumsum(size) - size, np.frombuffer(b"".join(pieces), np.uint8)
        self.segments: dict[str, bytes] = {}
        self.weights: dict[int, float] = {}
        self.bytes_from, self.bytes_to = min(self.byte), max(self.byte)

    def merge(self, symbols: list[str], border: int = -1) -> list[str] | None:
        """Merge until nothing merges: best rank first, leftmost of equals. None once a merge would cross ``border``."""
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []
        rank = self.rank

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (s := symbols[i] + symbols[j]) in rank:
                heapq.heappush(heap, (rank[s], i, j, s))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, s = heapq.heappop(heap)
            if right[i] != j or symbols[i] + symbols[j] != s or not symbols[i]:
                continue
            if j == border:
                return None
            symbols[i], symbols[j] = s, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            right[j] = -1
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [s for s in symbols if s]

    def weight(self, last: int, piece: int) -> float:
        """Of the arc from the state after ``last`` (-1: none, or bytes) to ``piece``: 0 if no merge crosses their border, else infinite."""
        key = last << 32 | piece if last >= 0 else -1 - piece
        w = self.weights.get(key)
        if w is None:
            if len(self.weights) >= PAIRS:
                self.weights.clear()
            x, y = self.text[last] if last >= 0 else "", self.text[piece]
            w = self.weights[key] = 0.0 if self.merge([*x, *y], len(x) or -1) == ([x, y] if x else [y]) else INFINITE
        return w

    def arcs_from(self, segment: str, p: int) -> list[tuple[int, int]]:
        """Composition of the segment with pieces and byte fallback from position ``p`` to the next state between pieces: (end, piece or -1)."""
        found, state, step, ends = [], 0, self.step, self.ends
        for q in range(p, len(segment)):
            state = step[state].get(segment[q])
            if state is None:
                break
            if ends[state] >= 0:
                found.append((q + 1, ends[state]))
        if segment[p] not in self.id:  # byte fallback: nothing merges over it
            found.append((p + 1, -1))
        return found

    def shortest_path(self, segment: str) -> list[int]:
        """Ids of the least-weight path through the composition of the machines with ``segment``.

        Weights are 0 or infinite, so every path of finite weight is a least one (and as merging has one result, there is one).
        States are expanded depth first, the longest piece first; one without a way on is not entered twice.
        """
        n, weights = len(segment), self.weights
        arcs: dict[int, list[tuple[int, int]]] = {}
        dead: set[tuple[int, int]] = set()
        path: list[tuple[int, int, list[tuple[int, int]]]] = []
        out: list[int] = []
        p, last = 0, -1
        while p < n:
            here = arcs.get(p)
            if here is None:
                here = arcs[p] = self.arcs_from(segment, p)
            left = here.copy()
            path.append((p, last, left))
            while True:
                while left:
                    q, piece = left.pop()
                    if piece >= 0:
                        w = weights.get(last << 32 | piece if last >= 0 else -1 - piece)
                        if (self.weight(last, piece) if w is None else w) == INFINITE or (q, piece) in dead:
                            continue
                    break
                else:
                    dead.add((p, last))
                    path.pop()
                    p, last, left = path[-1]
                    out.pop()
                    continue
                break
            out.append(piece)
            p, last = q, piece
        result: list[int] = []
        for (at, _, _), piece in zip(path, out, strict=True):
            if piece >= 0:
                result.append(piece)
            else:
                result.extend(self.byte[c] for c in segment[at].encode("utf-8", "replace"))
        return result

    def _segment(self, segment: str, state: int) -> bytes:
        out = np.array(self.shortest_path(self.normaliser.run(segment, state)), np.int32).tobytes()
        if len(segment) <= 64 and state:
            if len(self.segments) >= SEGMENTS:
                self.segments.clear()
            self.segments[segment] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        known, make = self.segments.get, self._segment
        first, *rest = _SEGMENT.findall(text)
        return np.frombuffer(b"".join([make(first, 0), *[known(s) or make(s, 1) for s in rest]]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        size = self.size[ids]
        raw = self.bytes[expand(self.start[ids], size)].tobytes()
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


_compiled: dict[int, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a model file, compiled once in each process."""
    key = hash(model)
    if key not in _compiled:
        _compiled[key] = Transducer(model)
    return _compiled[key]


def encode_documents(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids, n_ids, n_bytes (ids of byte fallback), round_trip (decoding gives the text) for each row."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:  # a vocabulary beside the program, read once on the driver
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = compiled(model.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = part.column(1).to_pylist()
                ids = [t.encode(x) for x in texts]
                same = [t.decode(i) == (x or "").replace(MARK, " ") for i, x in zip(ids, texts, strict=True)]
                n = np.array([len(i) for i in ids], np.int64)
                flat = np.concatenate(ids)
                is_byte = (flat >= t.bytes_from) & (flat <= t.bytes_to)
                edge = np.concatenate([[0], np.cumsum(n)])
                count = np.concatenate([[0], np.cumsum(is_byte)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(flat)), pa.array(n),
                        pa.array(count[edge[1:]] - count[edge[:-1]]), pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "ids", "n_ids", "n_bytes", "round_trip"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, n_bytes long, round_trip boolean")


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, text of (doc_id, ids); a null list is an empty text."""
    spark = encoded.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        t = compiled(model.value)
        for b in batches:
            texts = [t.decode(np.array(x.as_py() or [], np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
