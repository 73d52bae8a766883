"""Packing without padding: every document is cut into pieces whose lengths are powers of two.

A document of n tokens becomes as many pieces of the full length as fit, and one piece for each bit of the rest, longest
first. Each piece is a sequence of its own, and sequences of one length form a bucket: batches come from one bucket, so
no token is padding and no sequence crosses documents."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetledger.llm.common import Workspace, text_slices

FULL = 2048
END_ID = 1
#: Bytes of chunks and ids that a worker remembers, about; it starts anew beyond.
MEMORY = 48_000_000
#: Rows that one numbering task sorts are about those of one of so many blocks a bucket.
BLOCKS = 1 << 12


#: Fixed value: how byte-level vocabularies cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as their Latin-1 characters and the others, in order, from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _merging_encoder(path: str):
    """An encoder of short texts that merges by id alone, for vocabularies whose merges are in the order of their ids, and
    None for others. It gives the tokenizer's ids at a fifth of its cost."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if model.get("type") != "BPE" or not plain or spec.get("normalizer"):
        return None
    vocabulary = model["vocab"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    order = [vocabulary[m.replace(" ", "", 1)] for m in merges]
    if order != sorted(order):
        return None
    import tiktoken

    byte = _byte_of_character()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("merging", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of whole texts as uint32 bytes, those that the tokenizer at path gives as it is. A text is cut before each space
    that a character other than white space follows: the pattern of byte-level vocabularies always starts a new piece
    there, so the chunks' ids joined are the text's. Chunks repeat, and each is encoded once while remembered. A text with
    other white space after a space is encoded whole and not remembered, and one that holds the string of a special token
    is encoded by the tokenizer itself, which makes it that token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merging = _merging_encoder(path)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        if self.merging:
            return [array("I", self.merging(text)).tobytes() for text in texts]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", encoding.ids).tobytes() for encoding in found]

    def _learn(self, chunks: list[str]) -> None:
        for chunk, ids in zip(chunks, self._ids(chunks), strict=True):
            self.known[chunk] = ids
            self.held += len(ids) + 2 * len(chunk) + 200

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMORY:
            self.forget()
        cut: list[list[str] | bytes] = []
        for text in texts:
            if any(s in text for s in self.special):
                cut.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            chunks = text.split(" ")
            if "" in chunks[1:] or any(c[0].isspace() for c in chunks[1:]):
                cut.append(self._ids([text])[0])
            else:
                cut.append([*chunks[:1], *map(" ".__add__, chunks[1:])])
        self._learn(list({c for chunks in cut if isinstance(chunks, list) for c in chunks}.difference(self.known)))
        known = self.known.__getitem__
        return [chunks if isinstance(chunks, bytes) else b"".join(map(known, chunks)) for chunks in cut]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(n: int, full: int = FULL) -> list[int]:
    """Lengths, longest first: full ones, then the bits of the rest."""
    rest = n % full
    return [full] * (n // full) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, path: str, full: int = FULL) -> DataFrame:
    """docs: doc_id, text. Returns per piece doc_id, start, length, ids_crc32, doc_tokens, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([END_ID], np.uint32).tobytes()
        for batch in text_slices(batches):
            row, start, length, crc, tokens, ids = [], [], [], [], [], []
            for i, raw in enumerate(encode([t or "" for t in batch.column("text").to_pylist()])):
                raw += end
                n, at = len(raw) // 4, 0
                for size in pieces_of(n, full):
                    piece = raw[4 * at : 4 * (at + size)]
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(piece))
                    tokens.append(n)
                    ids.append(piece)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens)),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )
        # workers live on and serve other operators
        encoder(path).forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )


def pack(docs: DataFrame, work: Workspace, path: str, full: int = FULL, with_ids: bool = False) -> DataFrame:
    """Sequences of docs (doc_id, text; other columns play no part): a row per piece with doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and, with_ids, the ids as little-endian unsigned 32-bit numbers.

    The ids of a text are those of the tokenizer at path as it stands, strings of its special tokens becoming those tokens,
    and then END_ID; a null text is an empty one and has that id alone. full must be a power of two. Every sequence holds one piece, so its offset is 0. sequence_id counts from 0
    without gaps, bucket by bucket from the longest, within a bucket by blocks of documents. Repeated rows are packed
    again each; rows without id are packed alike.
    """
    if full < 1 or full & (full - 1):
        raise ValueError("full must be a power of two")
    block = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BLOCKS)).alias("block")
    found = pieces(docs, path, full)
    rows = work.save((found if with_ids else found.drop("ids")).withColumn("block", block), "pieces")
    counts = rows.groupBy("length", "block").agg(F.count("*").alias("n"))
    # at most 12 lengths x BLOCKS rows: one small task
    before = Window.orderBy(F.desc("length"), "block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    return (
        rows.withColumn("place", F.row_number().over(within) - 1)
        .join(F.broadcast(firsts), ["length", "block"])
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("first") + F.col("place")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )
