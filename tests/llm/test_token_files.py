import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cauceda.llm import token_files as tf
from cauceda.llm.common import new_path
from tests.llm.conftest import documents

LIBRARY = Tokenizer.from_file(tf.TOKENIZER)
ODD = "  \n\t\x0b\x0c\x1c\x1f\x85  　'stmdrevl aA1éÉẹ́́漢٣!?. İΣςſ²ΑΣ<|endoftext|>Åẛ̣​🙂"


def brute(rows):
    """doc_id, start, n_tokens, crc of rows, by the library on whole texts; rows of one id as the operator orders them do not occur."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(spark, docs, **sizes):
    path = new_path(spark, "test-token-files")
    tf.write_token_files(docs, path, **sizes)
    return path


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_fields_of_any_width_round_trip_and_are_read_from_anywhere(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=40)), np.uint32)
    packed = tf.pack_ids(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert sum(int(b) << (8 * i) for i, b in enumerate(packed)) == sum(int(v) << (i * bits) for i, v in enumerate(ids))
    start = data.draw(st.integers(0, len(ids)))
    assert (tf.unpack_ids(packed[start * bits // 8 :], bits, start * bits % 8, len(ids) - start) == ids[start:]).all()


def test_an_id_that_does_not_fit_is_refused():
    with pytest.raises(ValueError, match="does not fit"):
        tf.pack_ids(np.array([4], np.uint32), 2)
    assert [tf.bits_of(n) for n in (1, 2, 3, 256, 257, 49408, 65537)] == [1, 1, 2, 8, 9, 16, 17]


LATIN = "".join(chr(i) for i in range(0x280))


def encode(own, texts):
    raw = [t.encode() for t in texts]
    ids, counts = own.encode(b"".join(raw), np.append(0, np.cumsum([len(r) for r in raw])).tolist())
    ends = np.cumsum(counts).tolist()
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts.tolist(), strict=True)]


def test_ids_equal_the_library_on_odd_texts(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 16))) for _ in range(3000)] + ["", " ", "it's 'tis", "x" * 3000, "<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|>", "İ!", "H̱ẖ"]
    texts += ["".join(rng.choices(LATIN + " 'stmdrevlSTMDREVL" * 10, k=rng.randint(0, 30))) for _ in range(4000)]
    want = [x.ids for x in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    own = tf.Chunks(tf.TOKENIZER, most=300)  # forgets on the way
    assert own.latin and sum((encode(own, texts[i : i + 50]) for i in range(0, len(texts), 50)), []) == want
    monkeypatch.setattr(tf, "PIECE", 5)  # cut wherever there is room
    assert encode(own, texts) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4))
def test_ids_equal_the_library_on_any_text(texts):
    assert encode(tf.chunks_of(tf.TOKENIZER), texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents_and_their_places_equal_the_library(spark, corpus):
    rows = list({i: (i, t) for i, t in corpus}.values())
    path = stored(spark, documents(spark, rows).repartition(3), file_docs=9, block_ids=50)
    found = sorted((tuple(r) for r in tf.read_token_files(spark, path, with_ids=False).selectExpr("CAST(doc_id AS long)", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert found == brute(rows)
    whole = tf.read_token_files(spark, path).filter("doc_id = '74'").first()
    text = dict(rows)[74]
    assert np.frombuffer(whole["ids"], "<u4").tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 2]


def test_any_span_of_a_file_is_read_alone(spark, corpus):
    rows = list({i: (i, t) for i, t in corpus}.values())
    path = stored(spark, documents(spark, rows), block_ids=64)
    files = [r.path for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    every = [i for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for i in [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]]
    rng = random.Random(4)
    with tf.TokenFile(files[0]) as file:
        assert len(files) == 1 and len(file.at) > 10
        for _ in range(40):
            a, b = sorted(rng.choices(range(len(every) + 1), k=2))
            assert file.ids(a, b).tolist() == every[a:b]


def test_rows_of_one_id_nulls_empty_tables_and_clashing_columns(spark, docs, empty, clashing):
    repeated = documents(spark, [(7, "same")] * 500 + [(7, None), (None, "a"), (None, "")])
    path = stored(spark, repeated, file_docs=50)
    assert spark.read.format("binaryFile").load(path).count() > 5  # one id, many files
    found = sorted(tf.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    assert len(found) == 503 and [r["doc_id"] for r in found[:3]] == [None, None, "7"]
    ends = [r["start"] + r["n_tokens"] for r in found]
    assert [r["start"] for r in found] == [0, *ends[:-1]]
    assert tf.read_token_files(spark, stored(spark, empty)).count() == 0
    own = [sorted(map(tuple, tf.read_token_files(spark, stored(spark, d), with_ids=False).collect()), key=str) for d in (docs, clashing)]
    assert own[0] == own[1]


def test_a_very_long_text_is_read_in_pieces(spark):
    text = "Some words, repeated and re-read. " * 200_000  # 6.8 MB
    ids = encode(tf.Chunks(tf.TOKENIZER), [text])[0]
    once = LIBRARY.encode("Some words, repeated and re-read. ", add_special_tokens=False).ids
    assert ids == once * 200_000
