"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file compiles to machines:

- the normaliser, a sequential transducer of characters (dummy prefix, escaped and squeezed white space), behind the
  model's own longest-match map of strings if it has one;
- the pieces, a trie whose arcs read characters and whose accepting nodes lead back to the root by an arc without
  input that writes the piece's number at its weight;
- byte fallback, an arc from the root for any other character, which writes the numbers of its bytes;
- for BPE models, the neighbours: an acceptor of piece numbers whose state is the last one.

They are composed with each input as it is read, so only states that the input reaches exist, and the encoding is the
shortest path of the composition in the tropical semiring.

Weights. Unigram models: a piece weighs its negative score. BPE models: a sequence of pieces is what merging by score
yields exactly if each piece, and each pair of neighbours, is what merging yields for its own string. So pieces
weigh 0, and an arc of the neighbours' acceptor weighs 0 if merging keeps the pair apart as it is, else infinity;
each of these weights is computed when the composition first asks for it. At every position one state at most is at a
finite distance then: the composition is deterministic, and its shortest path is its only one. It is found depth first,
longest pieces first, and a state that leads nowhere is left once for all.

No piece of a model that splits at white space has an escaped space after another character, so inputs are cut
before each run of spaces, and between characters of classes that no piece mixes (letters and signs, in many models):
no path has a piece across such a place. Paths of recurring parts are kept.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .storage import bounded_batches, give_back

SPACE = "▁"
# Fixed values of the model format: kinds of piece and of model.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: How much worse than the worst piece an unknown character is in a unigram model.
UNKNOWN_PENALTY = 10.0
INF = float("inf")
#: Classes of characters that are told apart when texts are cut, the largest first; the others are one more.
CLASSES = 8


def _parts(pieces: Iterable[str]) -> re.Pattern[str]:
    """Parts of a text: a run of spaces, escaped or not, with a run of characters that occur together in pieces."""
    up: dict[str, str] = {}

    def top(char: str) -> str:
        while up[char] != char:
            up[char] = char = up[up[char]]
        return char

    for piece in pieces:
        chars = piece.lstrip(SPACE)
        for char in chars:
            up.setdefault(char, char)
        for a, b in pairwise(chars):
            up[top(a)] = top(b)
    kin: dict[str, list[str]] = {}
    for char in up:
        kin.setdefault(top(char), []).append(char)
    classes = sorted(kin.values(), key=len, reverse=True)[:CLASSES]
    runs = ["".join(map(re.escape, g)) for g in classes if len(g) > 1]
    others = "|".join([*(f"[{r}]+" for r in runs), f"[^ {SPACE}{''.join(runs)}]+"])
    return re.compile(f"[ {SPACE}]*(?:{others})|[ {SPACE}]+")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message: number and raw value."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 128:
                return out

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif kind == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        else:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n


class Normaliser:
    """A sequential transducer of characters, compiled from a model's settings, behind its map of strings if there is one.

    States: START before the first character, IN, and GAP after spaces that count only if something follows them.
    """

    START, IN, GAP = range(3)

    def __init__(self, spec: bytes, escape: bool = True) -> None:
        got = dict(_fields(spec))
        self.prefix, squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
        self.space = SPACE if got.get(5, 1) and escape else " "
        begin = self.space if self.prefix else ""
        #: By state: where a space leads and what it writes, and what another character writes before itself.
        self.on_space = {
            self.START: (self.START, "") if squeeze else (self.IN, begin + self.space),
            self.IN: (self.GAP, "") if squeeze else (self.IN, self.space),
            self.GAP: (self.GAP, ""),
        }
        self.before = {self.START: begin, self.IN: "", self.GAP: self.space}
        charsmap = got.get(2, b"")
        self.units, self.text = (), b""
        if charsmap:
            n = struct.unpack("<I", charsmap[:4])[0]
            self.units, self.text = struct.unpack(f"<{n // 4}I", charsmap[4 : 4 + n]), charsmap[4 + n :]

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest mapped prefix at a position, and where its replacement starts."""
        units, node, best = self.units, 0, (0, 0)
        unit = units[0]
        node ^= unit >> 10 << ((unit & 512) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= unit >> 10 << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                best = (k - at + 1, units[node] & 0x7FFFFFFF)
        return best

    def mapped(self, text: str) -> str:
        """The text after the model's map."""
        data, out, at = text.encode(), [], 0
        while at < len(data):
            n, where = self._longest(data, at)
            if n:
                out.append(self.text[where : self.text.index(b"\0", where)])
                at += n
            else:
                step = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                out.append(data[at : at + step])
                at += step
        return b"".join(out).decode()

    def write(self, text: str, state: int = START) -> str:
        """What the transducer writes for a text that it reads from a state. Runs of other characters are read at once."""
        out = []
        for k, run in enumerate(text.split(" ")):
            if k:
                state, written = self.on_space[state]
                out.append(written)
            if run:
                out.append(self.before[state])
                out.append(run)
                state = self.IN
        return "".join(out)

    def __call__(self, text: str) -> str:
        return self.write(self.mapped(text) if self.units else text)


class Node(dict[str, "Node"]):
    """A node of the trie of pieces, by character the next ones.

    `piece` is what the arc back to the root writes, or -1. `ahead`: lengths and numbers of the pieces on the way here,
    longest first; where a character is no piece by itself, its length and what stands for it end the list.
    """

    __slots__ = ("ahead", "piece")

    def __init__(self) -> None:
        self.piece = -1
        self.ahead: tuple[tuple[int, int], ...] = ()


def trie(pieces: dict[str, int], other: int) -> Node:
    """The pieces as a machine; a character that is no piece is written as its code and `other`."""
    root = Node()
    for text in sorted(pieces):  # a piece comes after its beginnings
        node = root
        for depth, char in enumerate(text, 1):
            above, node = node, node.get(char)
            if node is None:
                node = above[char] = Node()
                node.ahead = ((1, other + ord(char)),) if depth == 1 else above.ahead
        node.piece = pieces[text]
        node.ahead = ((len(text), node.piece), *(node.ahead if len(text) > 1 else ()))
    return root


class Paths(dict[str, bytes]):
    """Paths of parts, computed when first asked for. Those not asked for again are dropped, `keep` to twice as many stay."""

    def __init__(self, compute: Callable[[str], bytes], keep: int) -> None:
        self.compute, self.keep = compute, keep
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        path = self.old.pop(part, None)
        if path is None:
            path = self.compute(part)
        if len(part) <= 64:
            if len(self) >= self.keep:
                self.old = dict(self)
                self.clear()
            self[part] = path
        return path

    def forget(self) -> None:
        self.old = {}
        self.clear()


class PieceTransducer:
    """A compiled model: encodes strings to piece numbers and back."""

    def __init__(self, model: bytes, keep: int = 250_000) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = b"", b""
        for number, value in _fields(model):
            if number == 1:
                got = dict(_fields(value))
                self.pieces.append((got.get(1, b"").decode(), struct.unpack("<f", got.get(2, bytes(4)))[0], got.get(3, NORMAL)))
            elif number == 2:
                trainer = value
            elif number == 3:
                normaliser = value
        self.kind = dict(_fields(trainer)).get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        self.normalise = Normaliser(normaliser)
        self.number = {p: i for i, (p, _, k) in enumerate(self.pieces) if k in (NORMAL, USER)}
        self.score = [s for _, s, _ in self.pieces]
        self.trie = trie(self.number, len(self.pieces))
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN), 0)
        cuts = not any(SPACE in p.lstrip(SPACE) for p in self.number) and not self.normalise.units and self.normalise.space == SPACE
        self.longest = max(map(len, self.number), default=1)
        #: How texts are cut, if they can be.
        self.parts = _parts(self.number) if cuts else None
        back = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, k in self.pieces]
        #: What pieces stand for: all their bytes, and where each one's are.
        self.back = np.frombuffer(b"".join(back), np.uint8)
        self.back_size = np.array([len(b) for b in back], np.int64)
        self.back_at = np.cumsum(self.back_size) - self.back_size
        #: By piece, whether those that follow it stay apart from it, as far as asked for; and how many such pairs.
        self.pairs: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self.known = 0
        self.code = [np.array([i], "<i4").tobytes() for i in range(len(self.pieces))]
        #: What one space before another character becomes inside a text.
        self.lead = self.normalise.write(" x", Normaliser.IN)[:-1]
        #: Paths of the parts after a text's first.
        self.paths = Paths(self._later, keep)

    def merges_inside(self, text: str, edge: int) -> bool:
        """Whether merging by score (the definition of BPE) ends with pieces that meet at `edge` and span either side.

        Stops as soon as a merge crosses the edge.
        """
        parts, number, score = list(text), self.number, self.score
        left = edge  # parts before the edge
        gain = [score[k] if (k := number.get(x + y)) is not None else -INF for x, y in zip(parts, parts[1:], strict=False)]
        while gain:
            best = max(gain)
            if best == -INF:
                break
            i = gain.index(best)
            if i == left - 1:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            left -= i < left
            del gain[i]
            if i:
                gain[i - 1] = score[k] if (k := number.get(parts[i - 1] + parts[i])) is not None else -INF
            if i < len(gain):
                gain[i] = score[k] if (k := number.get(parts[i] + parts[i + 1])) is not None else -INF
        return len(parts) == (left > 0) + 1 and left <= 1

    def _text(self, key: int) -> str:
        """What a key stands for: a piece, a character that is none, or (negative) the start."""
        return "" if key < 0 else self.pieces[key][0] if key < len(self.pieces) else chr(key - len(self.pieces))

    def _apart(self, a: int, b: int) -> bool:
        """Whether the transition between neighbours weighs 0 (a negative: whether b is a piece by itself)."""
        known = self.pairs[a].get(b)
        if known is None:
            if self.known >= 400_000:
                self.pairs.clear()
                self.known = 0
            left = self._text(a)
            known = self.pairs[a][b] = self.merges_inside(left + self._text(b), len(left))
            self.known += 1
        return known

    def _weights(self, last: int, key: int) -> float:
        """Weight of an arc that writes `key` after `last`."""
        if self.kind == BPE:
            return 0.0 if self._apart(last, key) else INF
        return -self.score[key] if key < len(self.score) else UNKNOWN_PENALTY - min(self.score, default=0.0)

    def _ids(self, text: str) -> bytes:
        """The shortest path of the composition with a normalised text, as little-endian 32-bit integers.

        Of paths of one weight, the one whose last piece is longest. States between pieces are the last piece for BPE
        models (the neighbours' state), one state for unigram models; inside pieces, nodes of the trie.
        """
        root, other = self.trie, len(self.pieces)
        # By position: by state, the distance, the key written last, where it began and the state there.
        at: list[dict[int, tuple[float, int, int, int]]] = [{-1: (0.0, -1, 0, -1)}]
        inside: list[tuple[Node, int]] = []
        for i, char in enumerate(text):
            here: dict[int, tuple[float, int, int, int]] = {}
            if at[i]:
                inside.append((root, i))
            moved: list[tuple[Node, int]] = []
            for node, begin in inside:
                after = node.get(char)
                key = -1
                if after is not None:
                    moved.append((after, begin))
                    key = after.piece
                if begin == i and key < 0:  # no piece by itself: byte fallback
                    key = other + ord(char)
                if key >= 0:
                    for state, (far, *_) in at[begin].items():
                        weight = far + self._weights(state, key)
                        to = key if self.kind == BPE else -1
                        if weight < INF and (to not in here or weight < here[to][0]):
                            here[to] = (weight, key, begin, state)
            at.append(here)
            inside = moved
        if not at[-1]:
            raise ValueError(f"no path through {text[:80]!r}")
        state = min(at[-1], key=lambda k: at[-1][k][0])
        keys: list[int] = []
        i = len(text)
        while i:
            _, key, i, state = at[i][state]
            keys.append(key)
        return self._coded(keys[::-1])

    def _state(self, text: str) -> tuple[int, bytes]:
        """The state of a BPE model's composition after a normalised text (-2: none), and the encoding.

        The composition is deterministic, so a depth-first walk over its arcs of weight 0 enters a position once.
        """
        root, pairs, longest, n = self.trie, self.pairs, self.longest, len(text)
        # What was written last, the position, what was written before and where that began, and where nothing leads on.
        last, i = -1, 0
        keys: list[int] = []
        begins: list[int] = []
        dead: set[int] = set()
        while i < n:
            node = root
            for char in text[i : i + longest]:
                after = node.get(char)
                if after is None:
                    break
                node = after
            apart = pairs[last]
            for size, key in node.ahead or ((1, len(self.pieces) + ord(text[i])),):
                if (known := apart.get(key)) is not False and i + size not in dead and (known or self._apart(last, key)):
                    keys.append(key)
                    begins.append(i)
                    last = key
                    i += size
                    break
            else:  # back to the piece before
                if not keys:
                    return -2, b""
                dead.add(i)
                keys.pop()
                i = begins.pop()
                last = keys[-1] if keys else -1
        return last, self._coded(keys)

    def _coded(self, keys: list[int]) -> bytes:
        """Keys along a path as piece numbers."""
        code, other = self.code, len(self.pieces)
        if max(keys, default=0) < other:
            return array("i", keys).tobytes()
        return b"".join([code[key] if key < other else self._fallback(self._text(key), before >= other) for before, key in zip([-1, *keys], keys, strict=False)])

    def _fallback(self, char: str, again: bool) -> bytes:
        """The numbers of a character that is no piece: its bytes, or the unknown piece once for a run."""
        if self.bytes:
            return np.array([self.bytes[b] for b in char.encode()], "<i4").tobytes()
        return b"" if again else self.code[self.unknown]

    def _path(self, norm: str) -> bytes:
        """The path of a normalised text."""
        if self.kind != BPE:
            return self._ids(norm) if norm else b""
        last, path = self._state(norm)
        if last == -2:
            raise ValueError(f"no path through {norm[:80]!r}")
        return path

    def _later(self, part: str) -> bytes:
        """The path of a part that follows another."""
        if part.rfind(" ") == 0 and len(part) > 1:
            return self._path(self.lead + part[1:])
        return self._path(self.normalise.write(part, Normaliser.IN))

    def forget(self) -> None:
        """Drop the kept paths (not the weights of neighbours, which every text needs)."""
        self.paths.forget()

    def encode(self, text: str) -> bytes:
        """Piece numbers of a whole text, as little-endian 32-bit integers."""
        parts = self.parts.findall(text) if self.parts else ()
        if not parts:
            return self._path(self.normalise(text))
        first = self._path(self.normalise.write(parts[0]))
        return first + b"".join(map(self.paths.__getitem__, parts[1:]))

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of piece numbers; bytes that form no character show as U+FFFD."""
        ids = np.asarray(ids, np.int32)
        sizes = self.back_size[ids]
        ends = np.cumsum(sizes)
        text = self.back[np.repeat(self.back_at[ids] - ends + sizes, sizes) + np.arange(sizes.sum())].tobytes().decode("utf-8", "replace")
        return text[1:] if self.normalise.prefix and text.startswith(" ") else text


@lru_cache(maxsize=4)
def compiled(model: bytes) -> PieceTransducer:
    return PieceTransducer(model)


def encode_texts(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 500) -> DataFrame:
    """(doc_id, ids array<int>, n_tokens, exact): every whole text's encoding.

    exact: decoding gives the text back (a text that holds U+2581 itself comes back with a space for it). Null
    text: null ids, n_tokens 0, exact true. Empty text: no ids. Repeated rows stay repeated, equal texts have equal
    ids, an empty table gives no rows; other columns are ignored, whatever their names. The model (its size is that
    of a vocabulary) is broadcast.
    """
    shared = bounded_batches(docs).sparkContext.broadcast(model)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                texts = batch.column(1).to_pylist()
                coded = [fst.encode(t) if t is not None else b"" for t in texts]
                counts = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
                exact = [t is None or fst.decode(np.frombuffer(c, "<i4")) == t for t, c in zip(texts, coded, strict=True)]
                values = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, values, mask=pa.array([t is None for t in texts]))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(counts), pa.array(exact)], names=["doc_id", "ids", "n_tokens", "exact"])
        fst.forget()
        give_back()

    return source.mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, exact boolean")


def decode_ids(rows: DataFrame, model: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): what arrays of piece numbers stand for; null arrays give null, null elements nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    source = rows.select(rows[id_col].alias("doc_id"), rows[ids_col].alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shared.value)
        for batch in batches:
            texts = [None if x is None else fst.decode([i for i in x if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return source.mapInArrow(run, f"doc_id {kind}, text string")
