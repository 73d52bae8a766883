"""Merge-type encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import pytest

from fleetledger.llm import pieces
from fleetledger.llm.queries import op13_piece_encoding, pieces_model
from tests.llm.util import AWKWARD, SF, documents

ODD = [
    "", " ", "   ", " a", "a ", "\x00", "\n\n x", "▁", "▁a ▁▁ b", "漢字" * 300, "a" * 5000, "\U0001f600é́ ",
    "\ufffd\ufeff x", "ab " * 3 + "   " * 30, "é" * 100, " \t \r\n", "<s> </s> <unk> <0x41>", "e" * 47, "e" * 48, "e" * 49,
]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(pieces_model())


def random_texts(seed, n=1500):
    rng = random.Random(seed)
    return ["".join(rng.choice("abehtion   ▁\n1é漢\U0001f600\x00.,") for _ in range(rng.randint(0, 120))) for _ in range(n)]


def plain_merges(model, score, text):
    """The definition itself: of all adjacent pairs that form a piece, merge the best, leftmost on ties, until none is left."""
    symbols = list(model.library.normalize(text))
    while True:
        found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in score]
        if not found:
            return symbols
        i = min(found)[1]
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]


def test_ids_and_texts_equal_the_library(model):
    texts = ODD + random_texts(1)
    wanted = model.library.encode(texts, add_eos=True)
    got = model.encode(texts)
    assert [x.tolist() for x in got] == wanted
    assert [model.decode(x) for x in got] == model.library.decode(wanted)
    assert [x.tolist() for x in model.encode(texts, end=False)] == model.library.encode(texts)


def test_agendas_follow_the_definition(model):
    score = {p: s for p, s, t in pieces.read_model(pieces_model())[0] if t == pieces.NORMAL}
    for text in random_texts(2, 150):
        covered = [s for s in plain_merges(model, score, text) if model.library.piece_to_id(s) != model.library.unk_id()]
        ids = [i for i in model.encode([text], end=False)[0].tolist() if i not in model.byte_of]
        assert [model.library.id_to_piece(i) for i in ids] == covered


def test_heap_and_rounds_agree(model):
    rng = random.Random(3)
    for _ in range(300):
        code = [ord(c) for c in rng.choices("▁aeinst漢", k=rng.randint(1, 40))]
        symbols = model.symbol[np.array(code)]
        (_, _, left), *more = model._rounds(symbols, np.array([len(code)]))
        assert not more and left.tolist() == model._heap(symbols.tolist())


def test_any_ids_decode_as_the_library(model):
    rng = random.Random(4)
    for _ in range(1500):
        ids = [rng.choice([rng.randint(0, 400), rng.randint(0, 31999), 28705, 259]) for _ in range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, np.int32)) == model.library.decode(ids)


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY", 1000)
    texts = random_texts(5, 400)
    for i in range(0, 400, 50):
        part = texts[i : i + 50]
        assert [x.tolist() for x in model.encode(part)] == model.library.encode(part, add_eos=True)
    model.forget()
    assert not model.known and not model.held


def test_long_unspaced_text_takes_n_log_n(model):
    text = "漢字仮名abc" * 60_000
    assert model.encode([text])[0].tolist() == model.library.encode(text, add_eos=True)


def test_awkward_rows_and_empty_table(spark):
    rows = [*AWKWARD, *((100 + i, t, None) for i, t in enumerate(ODD) if "\x00" not in t)]
    got = pieces.encode_texts(documents(spark, rows), pieces_model()).collect()
    library = pieces.Pieces(pieces_model()).library
    wanted = [(i, library.encode(t or "", add_eos=True)) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(wanted, key=str)
    assert all(r.decoded == "" for r in got if r.doc_id in (1, 2))
    assert pieces.encode_texts(documents(spark, []), pieces_model()).count() == 0


def test_other_model_types_are_refused(tmp_path):
    # field 3 of the trainer settings says the type; the last one in the file counts
    path = tmp_path / "other.model"
    with open(pieces_model(), "rb") as file:
        path.write_bytes(file.read() + b"\x12\x02\x18\x01")
    with pytest.raises(ValueError):
        pieces.Pieces(str(path))


def test_query_digests(spark):
    library = pieces.Pieces(pieces_model()).library
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_piece_encoding(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
