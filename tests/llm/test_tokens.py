"""Token ids and files against the tokenizers library, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tideline.llm import bpe, tokenfile, tokens

LIBRARY = Tokenizer.from_file(bpe.default_path())
PARTS = ["a", "th", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "<|endoftext|>", "é", "ß", "日本", "🙂", "12", ".", "!!", "x" * 50, "\x1c", "·", "́", " "]
SCHEMA = "doc_id long, text string, ids string, n_tokens long"


def texts(n=400):
    rng = random.Random(4)
    own = ["", "a", " ", "  ", " a", "a ", "a  b", "a \n b", "\n a\n\n  b  ", "word " * 4000, "ab" * 3000]
    return own + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 50))) for _ in range(n)]


@pytest.mark.parametrize("own", [True, False])
def test_ids_are_the_librarys(own):
    encoder = bpe.load(bpe.default_path())[1] if own else tokens.library_text_encoder(bpe.default_path())
    some = texts()
    ids, counts = encoder.batch([*some, None])
    got = np.split(ids, np.cumsum(counts)[:-1])
    assert [x.tolist() for x in got] == [x.ids for x in LIBRARY.encode_batch(some, add_special_tokens=False)] + [[]]


def test_long_pieces_merge_as_short_ones():
    own = bpe.load(bpe.default_path())[0]
    pieces = [("the" * n + "xyz" * n).encode() for n in (1, 5, 40)]
    ids, counts = own.encode_pieces(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [own._merge_one(p).tolist() for p in pieces]


def frame(spark, some):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(some)], SCHEMA)


def test_bpe_round_trip(spark):
    some = [*texts(60), None]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, some)).collect()}
    for i, t in enumerate(some):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    again = bpe.decode(bpe.encode(frame(spark, some)))
    assert {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in enumerate(some)}


def test_decoding_cut_characters():
    own, ids = bpe.load(bpe.default_path())[0], LIBRARY.encode("a🙂日本", add_special_tokens=False).ids
    for cut in range(len(ids)):
        for part in (ids[cut:], ids[:cut]):
            assert own.decode(part) == LIBRARY.decode(part, skip_special_tokens=False)


def test_token_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "SEGMENT", 200)
    rows = [(i * 3 % 61, t, "x", 1) for i, t in enumerate([*texts(50)[:-1], None])] + [(None, "null id", "x", 1), (7, "again", "x", 1), (7, "again", "x", 1)]
    got = sorted(tokenfile.round_trip(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    start = 0
    want = {}
    for d, t, *_ in rows:
        ids = np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_codes():
    rng = np.random.default_rng(0)
    for count in (0, 1, 3, 4, 5, 1000):
        codes = (2.0 ** rng.uniform(0, 32, count)).astype(np.uint32)
        control, data = tokenfile.encode_codes(codes)
        assert len(control) == -(-count // 4)
        assert (tokenfile.decode_codes(control, data, count) == codes).all()


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.round_trip(empty).count() == 0 and tokenfile.round_trip(empty).count() == 0


def test_texts_are_encoded_in_small_batches():
    """The arrays of a batch are many times its text, so no more than a little of it is worked on at once."""
    import pyarrow as pa

    from tideline.llm import bpe

    texts = [None, "", *(["word " * 200] * 3000), "x" * 500_000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k0", "text"])
    parts = list(bpe.small_batches(iter([batch, batch.slice(0, 2)]), 1))
    assert [t for p in parts for t in p.column(1).to_pylist()] == [*texts, None, ""]
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 1 << 18 for p in parts)
