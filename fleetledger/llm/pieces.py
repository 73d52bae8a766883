"""Merge-type SentencePiece vocabularies: whole texts to ids and back.

A text starts as its characters. An agenda holds the adjacent pairs whose concatenation is a piece, ordered by the piece's
score and then from left to right; the first is merged, its neighbours enter the agenda with the new symbol, until no pair
is left. Characters that no piece covers become byte pieces, or the unknown id where the vocabulary has no bytes.

Where no piece holds the space mark after another character, no merge crosses such a place, so a text is cut there and
each distinct chunk is encoded once while remembered. The agendas of all short chunks of a batch advance together, one
merge each a round, in numpy; a long chunk (unspaced script) has a heap of its own, in n log n steps.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import text_slices
from fleetledger.llm.hasharray import HashArray

SPACE = "▁"
#: Piece types and the merge model type in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2
#: Fixed value: what stands for an unknown id in a decoded text.
UNKNOWN_SURFACE = " ⁇ "
#: A chunk of more characters has a heap of its own.
SHORT = 48
#: Bytes of remembered chunks and ids of a worker, in two generations: when the younger one is full the older goes, and
#: what is met again moves back. Longer chunks than LONG are never remembered.
MEMORY, LONG = 96_000_000, 200
_NEVER = np.int64(1) << 34
#: Bits of a symbol's place among all symbols of a step.
_PLACE = 28
#: No symbol: what stands between chunks.
_MARK = (1 << 31) - 1


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message; sub-messages stay bytes."""
    at = 0

    def varint() -> int:
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
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, raw[at : at + size]
        at += size


def read_model(path: str) -> tuple[list[tuple[str, float, int]], int]:
    """The (piece, score, type) of each id, and the model type."""
    with open(path, "rb") as file:
        raw = file.read()
    pieces, kind = [], 1
    for number, value in _fields(raw):
        if number == 1:
            of = {n: v for n, v in _fields(value)}
            score = struct.unpack("<f", of[2])[0] if 2 in of else 0.0
            pieces.append((of.get(1, b"").decode(), score, of.get(3, NORMAL)))
        elif number == 2:
            kind = next((v for n, v in _fields(value) if n == 3), kind)
    return pieces, kind


class Pieces:
    """Encoder and decoder of the model at path. Symbols are piece ids, and len(vocabulary) + code point for characters
    that are no piece."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary, kind = read_model(path)
        types = {t for _, _, t in vocabulary}
        if kind != MERGES or types - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only merge-type vocabularies of normal, control, unknown and byte pieces are known")
        self.size = len(vocabulary)
        self.end = self.library.eos_id()
        normal = {p: i for i, (p, _, t) in enumerate(vocabulary) if t == NORMAL}
        scores = sorted({s for _, s, t in vocabulary if t == NORMAL}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.cuts = SPACE in normal and not any(SPACE in p.lstrip(SPACE) for p in normal)
        self.symbol = self.size + np.arange(0x110000, dtype=np.int64)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        pairs: dict[int, tuple[int, int]] = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = (self._symbol_of(part, normal) for part in (piece[:cut], piece[cut:]))
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (rank[vocabulary[i][1]], i)
        self.pairs = pairs
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        self.table = HashArray.build(np.fromiter(pairs, np.int64, len(pairs)), values)
        byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(vocabulary) if t == BYTE}
        self.byte = [byte.get(b) for b in range(256)] if byte else None
        self.byte_of = {i: b for b, i in byte.items()}
        self.unknown = self.library.unk_id()
        self.surface = [
            "" if t == CONTROL else UNKNOWN_SURFACE if t == UNKNOWN else p.replace(SPACE, " ") for p, _, t in vocabulary
        ]
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else t.encode() for i, t in enumerate(self.surface)]
        self.surface_size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.lead = {i for p, i in normal.items() if p.startswith(SPACE)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _symbol_of(self, part: str, normal: dict[str, int]) -> int | None:
        return normal.get(part, self.size + ord(part) if len(part) == 1 else None)

    def forget(self) -> None:
        self.known, self.older, self.held = {}, {}, 0

    # encoding

    def _heap(self, symbols: list[int]) -> list[int]:
        """The symbols that one agenda leaves of a long chunk. An entry is stale if one of its symbols has changed."""
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))

        def pair(left: int, right: int) -> tuple[int, int, int, int, int, int] | None:
            found = self.pairs.get(symbols[left] << 32 | symbols[right])
            return found and (found[0], left, right, symbols[left], symbols[right], found[1])

        agenda = [p for i in range(len(symbols) - 1) if (p := pair(i, i + 1))]
        heapify(agenda)
        while agenda:
            _, left, right, a, b, merged = heappop(agenda)
            if symbols[left] != a or symbols[right] != b or after[left] != right:
                continue
            symbols[left], symbols[right] = merged, -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                if new := pair(left, after[left]):
                    heappush(agenda, new)
            if before[left] >= 0 and (new := pair(before[left], left)):
                heappush(agenda, new)
        return [s for s in symbols if s >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table.find(left << 32 | right)
        hit = row >= 0
        rank, merged = np.full(len(row), _NEVER), np.full(len(row), -1)
        rank[hit], merged[hit] = self.table.values[row[hit], 0], self.table.values[row[hit], 1]
        return rank, merged

    def _rounds(self, symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The symbols that the agendas of many short chunks leave; each round merges the first pair of every agenda.
        Yields (chunks, sizes, symbols) of agendas as they become empty."""
        chunk, sizes = np.arange(len(sizes)), sizes + 1
        # a mark before each chunk, that forms no pair, and one at the end
        symbols = np.append(np.insert(symbols, np.cumsum(sizes - 1) - sizes + 1, _MARK), _MARK)
        rank, merged = self._rank(symbols[:-1], symbols[1:])
        symbols, place = symbols[:-1], np.arange(len(symbols) - 1)
        while len(chunk):
            start = np.cumsum(sizes) - sizes
            # rank and place in one number: the least is the best score, leftmost
            key = rank << _PLACE | place
            best = np.minimum.reduceat(key, start)
            goes = best < _NEVER << _PLACE
            keep = np.repeat(goes, sizes)
            if not goes.all():
                gone = ~keep
                gone[start[~goes]] = False
                yield chunk[~goes], sizes[~goes] - 1, symbols[gone]
            at = np.flatnonzero(key == np.repeat(np.where(goes, best, -1), sizes))
            symbols[at] = merged[at]
            keep[at + 1] = False
            rank, merged, place = rank[keep], merged[keep], place[keep]
            at = np.cumsum(keep)[at] - 1
            symbols, chunk, sizes = symbols[keep], chunk[goes], sizes[goes] - 1
            new = np.concatenate([at - 1, at])
            after = np.concatenate([symbols[at], np.append(symbols, _MARK)[at + 1]])
            rank[new], merged[new] = self._rank(symbols[new], after)

    def _ids(self, symbols: list[int]) -> bytes:
        """Ids as 32-bit numbers: characters without a piece become their bytes, or one unknown id a run."""
        out: list[int] = []
        missed = False
        for s in symbols:
            if s < self.size:
                out.append(s)
            elif self.byte:
                out.extend(self.byte[b] for b in chr(s - self.size).encode("utf-8", "replace"))
            elif not missed:
                out.append(self.unknown)
            missed = s >= self.size
        return np.array(out, np.int32).tobytes()

    def _encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        found = {}
        short = [c for c in chunks if len(c) <= SHORT]
        if short:
            code = np.frombuffer("".join(short).encode("utf-32-le", "replace"), np.uint32)
            lengths = np.fromiter(map(len, short), np.int64, len(short))
            for chunk, sizes, symbols in self._rounds(self.symbol[code], lengths):
                raw, ends = symbols.astype(np.int32).tobytes(), np.cumsum(sizes)
                odd = np.maximum.reduceat(symbols, ends - sizes) >= self.size
                ends, starts = (4 * ends).tolist(), (4 * (ends - sizes)).tolist()
                names = [short[c] for c in chunk.tolist()]
                found.update(zip(names, [raw[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
                for i in np.flatnonzero(odd).tolist():
                    found[names[i]] = self._ids(symbols[starts[i] // 4 : ends[i] // 4].tolist())
        for chunk in chunks:
            if len(chunk) > SHORT:
                code = np.frombuffer(chunk.encode("utf-32-le", "replace"), np.uint32)
                found[chunk] = self._ids(self._heap(self.symbol[code].tolist()))
        return found

    def encode(self, texts: list[str], end: bool = True) -> list[np.ndarray]:
        """The ids of each text as the library gives them, with the end id behind if asked for."""
        if self.held > MEMORY // 2:
            self.known, self.older, self.held = {}, self.known, 0
        cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        chunks = [cut(t) if self.cuts else [t] * bool(t) for t in self.library.normalize(texts)]
        fresh = {c for of in chunks for c in of}.difference(self.known)
        again = {c: self.older[c] for c in self.older.keys() & fresh}
        new = self._encode_chunks(list(fresh.difference(again)))
        long = {c: ids for c, ids in new.items() if len(c) > LONG}
        for chunk in long:
            del new[chunk]
        new |= again
        self.known.update(new)
        self.held += sum(map(len, new.values())) + 2 * sum(map(len, new)) + 200 * len(new)
        tail = np.array([self.end] if end else [], np.int32).tobytes()
        known = self.known.__getitem__
        if long:
            known = lambda c: self.known.get(c) or long[c]
        return [np.frombuffer(b"".join(map(known, of)) + tail, np.int32) for of in chunks]

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids are nothing, runs of byte pieces are characters (a byte that belongs to none
        stands as U+FFFD), and the space mark that the encoder put first goes again."""
        return self.decode_all([ids])[0]

    def decode_all(self, texts: list[np.ndarray]) -> list[str]:
        """The texts of many id arrays, their pieces' bytes gathered at once."""
        flat = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        size = self.surface_size[flat]
        data = self.surface_bytes[
            np.repeat(self.surface_start[flat] - np.cumsum(size) + size, size) + np.arange(size.sum())
        ].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, texts)])].tolist()
        out = []
        for ids, a, b in zip(texts, ends, ends[1:], strict=False):
            try:
                text = data[a:b].decode()
            except UnicodeDecodeError:
                text = self._by_runs(ids.tolist())
            if text.startswith(" "):
                first = next(i for i in ids.tolist() if self.surface_size[i])
                text = text[first in self.lead :]
            out.append(text)
        return out

    def _by_runs(self, ids: list[int]) -> str:
        """A text with bytes that form no character: each run of byte pieces by itself."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out += [_characters(bytes(run)), self.surface[i]]
            run.clear()
        return "".join([*out, _characters(bytes(run))])


def _characters(raw: bytes) -> str:
    """Bytes as characters; each byte that begins none stands as U+FFFD by itself."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_texts(docs: DataFrame, path: str, end: bool = True, check: bool = True) -> DataFrame:
    """docs: doc_id, text; other columns play no part, whatever their names. Returns per row doc_id, ids (array of int)
    and decoded, the text of these ids.

    A null text is an empty one: it has the end id alone, or no id without end. Repeated rows and rows without id are
    encoded each; an empty table gives an empty result. A text of any length is encoded whole, its cost growing as
    n log n at most. With check, every Arrow batch's ids and texts are compared with the library's, and a difference
    fails the task with the row's id. The worker holds the vocabulary, MEMORY bytes of chunks and a slice of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in text_slices(batches):
            texts = batch.column("text").fill_null("").to_pylist()
            ids = model.encode(texts, end)
            decoded = model.decode_all(ids)
            if check:
                wanted = model.library.encode(texts, add_eos=end, num_threads=1)
                for row, (mine, theirs) in enumerate(zip(ids, wanted, strict=True)):
                    if mine.tolist() != theirs:
                        raise ValueError(f"ids of document {batch.column('doc_id')[row]} differ from the library's")
                for row, (mine, theirs) in enumerate(zip(decoded, model.library.decode(wanted, num_threads=1), strict=True)):
                    if mine != theirs:
                        raise ValueError(f"text of document {batch.column('doc_id')[row]} differs from the library's")
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(decoded, pa.string()),
                ],
                names=["doc_id", "ids", "decoded"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )
