"""SentencePiece encoding and decoding with a byte-pair model, over a lattice of pieces.

The distinct words of a stretch of texts are set out as a lattice: their
substrings up to the longest piece are looked up in a hash table of the pieces,
and those found are the edges, grouped by word and end. A fold from left to
right, over all words at once, keeps for every place the edge that the best path
enters it by, and a walk back reads the pieces.

A byte-pair model's result is not the path of the highest sum of scores, so the
fold selects by another rule, which gives exactly the result of merging: an edge
may follow another only if merging their joint text would give just these two
pieces. The encoding of a text is the one path in which all neighbours can stand
side by side, and every prefix of it is the encoding of that prefix, so one edge
per place is enough. Whether two pieces can stand side by side follows from how
each is merged: undoing their merges from the last one, no part at the right
edge of the first may be mergeable with the part beside it earlier than it was
merged away.

Words are cut before each space; no piece of the model crosses such a place,
except pieces of spaces only, which are merged last and are put together
afterwards. Characters without a piece become byte pieces.

A null text has null pieces, an empty one none. The model must be of type BPE
without normalization, with byte fallback and a dummy prefix; anything else is
refused. Decoding drops the dummy prefix; U+2581 in a text reads back as a space.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from proofline.llm.common import give_back

SPACE = "▁"
CHUNK = 500_000  # characters of text worked on at once, or one longer text

_U = np.uint64
_UNKNOWN, _START, _NONE = -2, -3, -1


def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(32))


class HashTable:
    """64-bit keys to numbers, for many lookups at once. Key 0 is not allowed."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = _U(64 - max(4, int(len(keys) * 4).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.zeros(self.mask + 1, _U)
        self.values = np.full(self.mask + 1, _NONE, np.int32)
        for k, v, at in zip(keys.tolist(), values.tolist(), self._slot(keys).tolist()):
            while self.keys[at]:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = k, v

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if there is none."""
        at = self._slot(keys)
        met = self.keys[at]
        out = np.where(met == keys, at, _NONE)
        open_ = np.flatnonzero((met != keys) & (met != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            met = self.keys[at[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (met != 0)]
        return out


class PieceModel:
    """A model's pieces as tables of fixed size, made once on the driver."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        rules, train = proto.normalizer_spec, proto.trainer_spec
        if (
            train.model_type != train.BPE or rules.precompiled_charsmap or rules.remove_extra_whitespaces
            or not rules.add_dummy_prefix or not train.byte_fallback
        ):
            raise ValueError("only BPE models without normalization, with dummy prefix and byte fallback")
        sp = SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        known = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.space = known[SPACE]
        self.space_runs = {len(p): i for p, i in known.items() if p.strip(SPACE) == "" and len(p) > 1}
        for i in self.space_runs.values():
            del known[self.pieces[i]]
        if any(SPACE in p[1:] for p in known):
            raise ValueError("pieces that cross a space are not supported")
        rank = {i: -sp.get_score(i) for i in known.values()}
        order = {i: k for k, i in enumerate(sorted(rank, key=rank.get))}
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, _NONE, np.int32), np.full(n, _NONE, np.int32)
        reachable = {}
        for p, i in known.items():
            parts = self._merged(p, known, order)
            if len(parts) == 1:
                reachable[p] = i
                if len(p) > 1:
                    self.left[i], self.right[i] = self._last
                    self.rank[i] = order[i]
        pairs = {}
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = known.get(p[:k]), known.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b + 1] = order[i]
        self.size = n
        self.pairs = HashTable(np.array(list(pairs), _U), np.array(list(pairs.values()), np.int64))
        prefixes = {p[:k]: _NONE for p in reachable for k in range(1, len(p) + 1)} | reachable
        self.longest = max(map(len, reachable))
        self.table = HashTable(np.array([self._hash(p) for p in prefixes], _U), np.array(list(prefixes.values()), np.int64))
        self.bytes = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes[i] = bytes([b])
        for i in range(n):
            if special[i] and not sp.is_byte(i):
                self.bytes[i] = b""

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, _U)
        for c in piece:
            h = _step(h, np.array([ord(c)], _U))
        return int(h[0]) or 1

    def _merged(self, text: str, known: dict[str, int], order: dict[int, int]) -> list[str]:
        """The pieces that merging gives; notes the last merge."""
        parts = list(text)
        while len(parts) > 1:
            best = min(
                ((order[known[a + b]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known), default=None
            )
            if best is None:
                break
            k = best[1]
            self._last = (known.get(parts[k], _NONE), known.get(parts[k + 1], _NONE))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each piece of ``b`` can follow that of ``a``."""
        ok = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[at].astype(np.int64), b[at].astype(np.int64)
        limit = np.full(len(at), 1 << 40)
        while len(at):
            slot = self.pairs.find((x * self.size + y + 1).astype(_U))
            bad = (slot >= 0) & (self.pairs.values[slot] < limit)
            ok[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            limit = np.where(undo_left, rx, ry + 1)
            go = ~bad & (np.maximum(rx, ry) >= 0)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            # A part without a piece of its own merges with nothing.
            go &= (x >= 0) & (y >= 0)
            at, x, y, limit = at[go], x[go], y[go], limit[go]
        return ok


class WordPieces(NamedTuple):
    ids: np.ndarray
    start: np.ndarray
    count: np.ndarray


def encode_words(model: PieceModel, words: list[str]) -> WordPieces:
    """The pieces of every word, each taken with a space before it."""
    codes = np.frombuffer("".join([SPACE + w for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(length) - length
    begins = np.repeat(begin, length)
    ends = begins + np.repeat(length, length)
    total = len(codes)
    wide = codes.astype(_U)

    # Edges: substrings from every place, made longer while they begin some piece.
    edge_start, edge_end, edge_piece = [], [], []
    start, h = np.arange(total), np.zeros(total, _U)
    for n in range(1, model.longest + 1):
        h = _step(h, wide[start + n - 1])
        slot = model.table.find(h)
        piece = np.where(slot >= 0, model.table.values[slot], _NONE)
        if n == 1:
            piece[piece == _NONE] = _UNKNOWN
        found = piece != _NONE
        edge_start.append(start[found])
        edge_end.append(start[found] + n)
        edge_piece.append(piece[found])
        go = (slot >= 0) & (start + n < ends[start])
        start, h = start[go], h[go]
        if not len(start):
            break
    start, end, piece = (np.concatenate(x) for x in (edge_start, edge_end, edge_piece))

    # The fold: edges by the place in their word where they end.
    place = end - begins[start]
    order = np.argsort(place, kind="stable")
    start, end, piece = start[order], end[order], piece[order]
    bounds = np.searchsorted(place[order], np.arange(1, (int(place.max()) if len(place) else 0) + 2))
    last, back = np.full(total, _NONE, np.int64), np.zeros(total, np.int64)
    first = begins[start] == start
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if lo == hi:
            continue
        s, e, p = start[lo:hi], end[lo:hi], piece[lo:hi]
        before = np.where(first[lo:hi], _START, last[s - 1])
        ok = (before != _NONE) & model.side_by_side(before, p)
        last[e[ok] - 1], back[e[ok] - 1] = p[ok], s[ok]

    is_end = np.zeros(total, bool)
    at = begin + length - 1
    lowest = begin
    while len(at):
        is_end[at] = True
        to = back[at]
        go = to > lowest
        at, lowest = to[go] - 1, lowest[go]
    ids, where = last[is_end], np.flatnonzero(is_end)
    owner = np.repeat(np.arange(len(words)), length)[where]
    unknown = ids == _UNKNOWN
    if unknown.any():
        ids, owner = _with_bytes(model, ids, owner, codes[where], unknown)
    count = np.bincount(owner, minlength=len(words))
    return WordPieces(ids.astype(np.int32), np.cumsum(count) - count, count)


def _with_bytes(model, ids, owner, codes, unknown):
    """Unknown characters as the pieces of their UTF-8 bytes."""
    n = np.where(unknown, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 1)
    at = np.repeat(np.arange(len(ids)), n)
    k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)  # which byte
    c, m = codes[at].astype(np.int64), n[at]
    tail = 0x80 | ((c >> (6 * (m - 1 - k))) & 0x3F)
    lead = np.where(m == 1, c & 0x7F, np.array([0, 0, 0xC0, 0xE0, 0xF0])[m] | (c >> (6 * (m - 1))))
    byte = np.where(k == 0, lead, tail) & 0xFF
    return np.where(unknown[at], model.byte_ids[byte], ids[at]), owner[at]


def encode_texts(model: PieceModel, texts: list[str | None]) -> list[np.ndarray | None]:
    index: dict[str, int] = {}
    known = index.setdefault
    rows, sizes = [], []
    for t in texts:
        parts = (SPACE + t.replace(" ", SPACE)).split(SPACE)[1:] if t else []
        rows.append(np.array([known(p, len(index)) for p in parts], np.int32))
        sizes.append(len(parts))
    if not index:
        return [None if t is None else np.zeros(0, np.int32) for t in texts]
    words = encode_words(model, list(index))
    every = np.concatenate(rows)
    n = words.count[every]
    stop = np.cumsum(n)
    flat = words.ids[np.repeat(words.start[every] - (stop - n), n) + np.arange(int(stop[-1]))]
    stops = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes)])]
    out: list[np.ndarray | None] = []
    for t, a, b in zip(texts, stops[:-1].tolist(), stops[1:].tolist()):
        ids = flat[a:b]
        if t and ("  " in t or SPACE in t or t[0] == " " or t[-1] == " "):
            ids = merge_spaces(model, ids)
        out.append(None if t is None else ids)
    return out


def merge_spaces(model: PieceModel, ids: np.ndarray) -> np.ndarray:
    """Neighbouring single spaces as pieces of several, the longest first."""
    is_space = ids == model.space
    if not (is_space[1:] & is_space[:-1]).any():
        return ids
    edges = np.flatnonzero(np.diff(np.concatenate([[0], is_space.astype(np.int8), [0]])))
    out, at = [], 0
    longest = max(model.space_runs, default=1)
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        out.append(ids[at:a])
        n = b - a
        run = []
        while n:
            k = min(n, longest)
            while k > 1 and k not in model.space_runs:
                k -= 1
            run.append(model.space_runs[k] if k > 1 else model.space)
            n -= k
        out.append(np.array(run, np.int32))
        at = b
    out.append(ids[at:])
    return np.concatenate(out).astype(np.int32)


def decode_ids(model: PieceModel, ids: list[int] | np.ndarray | None) -> str | None:
    if ids is None:
        return None
    table = model.bytes
    raw = b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
    text = raw.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _fields_without(df: DataFrame, *names: str) -> list[StructField]:
    return [f for f in df.schema if f.name not in names]


def _broadcast(df: DataFrame, model: PieceModel | str):
    return df.sparkSession.sparkContext.broadcast(PieceModel(model) if isinstance(model, str) else model)


def encode(docs: DataFrame, model: PieceModel | str, text: str = "text", out: str = "pieces", decoded: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of ``text`` in ``out`` (replaced if it is there).

    ``decoded`` names a further column for the text that the pieces give again, so a
    round trip needs one Python worker and one copy of the model in a task, not two.
    ``model`` is a model or its file's path on the driver; the tables made of it,
    a few MB, are broadcast.
    """
    docs = docs.drop(*([out, decoded] if decoded else [out]))
    shared, at = _broadcast(docs, model), docs.columns.index(text)
    added = [StructField(out, ArrayType(IntegerType()))] + ([StructField(decoded, StringType())] if decoded else [])
    schema = StructType([*docs.schema, *added])

    def run(batches):
        from proofline.llm.near_dedup import chunks

        model = shared.value
        for batch in batches:
            for begin, texts in chunks(batch.column(at), CHUNK):
                ids = encode_texts(model, texts)
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([x for x in ids if x is not None] or [np.zeros(0, np.int32)])
                missing = pa.array(np.array([x is None for x in ids] + [False], bool))
                offsets = pa.array(offsets, pa.int32(), mask=np.asarray(missing)) if any(x is None for x in ids) else pa.array(offsets)
                part = batch.slice(begin, len(texts))
                pieces = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                again = [pa.array([decode_ids(model, x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, pieces, *again], names=[*part.schema.names, *[f.name for f in added]])
            give_back()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model: PieceModel | str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the piece ids in ``out`` (replaced if it is there)."""
    docs = docs.drop(out)
    shared, at = _broadcast(docs, model), docs.columns.index(pieces)
    schema = StructType([*docs.schema, StructField(out, StringType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            ids = batch.column(at)
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                column = ids.slice(begin, 256)
                texts = [decode_ids(model, x.values.to_numpy() if x.is_valid else None) for x in column]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)
