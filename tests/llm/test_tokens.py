import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cauceda.llm import bpe, packing
from cauceda.llm.common import utf8_column
from cauceda.llm.pretokens import split

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
REFERENCE = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = "  \n\t'stmdrevl a1é漢٣!?. ́🙂\x1c_'ſ²<|endoftext|>"


def encode(texts):
    ids, counts = bpe.encoder(bpe.RANKS, public.PATTERN).encode(*utf8_column(pa.array(texts, pa.string())))
    ends = np.append(0, np.cumsum(counts))
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def test_ids_equal_the_library_on_odd_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "it's 'tis I'll", "a" * 3000, "'", "x're"]
    assert encode(texts) == [REFERENCE.encode_ordinary(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_equal_the_library_on_any_text(texts):
    assert encode(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_hashes_that_collide_change_nothing(monkeypatch):
    """Bytes decide, whatever the hashes say."""
    from cauceda.llm import pretokens

    rng = random.Random(3)
    pair = ["".join("ab"[bin(i).count("1") % 2 ^ k] for i in range(1024)) for k in (0, 1)]
    texts = [*pair, *("".join(rng.choices(ODD + "abc", k=rng.randint(0, 40))) for _ in range(300))]
    want = [REFERENCE.encode_ordinary(t) for t in texts]
    assert encode(texts) == want
    monkeypatch.setattr(pretokens, "span_hashes", lambda data, starts, ends: ((ends - starts) % 3).astype(np.uint64))
    assert encode(texts) == want
    every = np.full(1, bpe.span_hashes(np.frombuffer(b"the", np.uint8), np.array([0]), np.array([3]))[0], np.uint64)
    monkeypatch.setattr(pretokens, "span_hashes", lambda data, starts, ends: np.repeat(every, len(starts)))
    assert encode(texts) == want


@pytest.mark.parametrize("window", [16, 1 << 16])
def test_long_texts_in_parts(monkeypatch, window):
    """Cut texts have the ids of whole ones, whatever stands at the cuts."""
    from cauceda.llm import pretokens

    monkeypatch.setattr(pretokens, "WINDOW", window)
    rng = random.Random(4)
    odd = ["".join(rng.choices(ODD, k=rng.randint(0, 400))) for _ in range(60)] + ["a" * 500, "漢" * 300 + "。", " " * 300, "'" * 90, "'s" * 200, "", "x"]
    rng.shuffle(odd)
    own = bpe.encoder(bpe.RANKS, public.PATTERN)
    for part in (1, 30, 1000):
        ids, counts = own.encode(*utf8_column(pa.array(odd, pa.string())), part=part)
        ends = np.append(0, np.cumsum(counts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [REFERENCE.encode_ordinary(t) for t in odd]


def test_parts_are_near_their_size(monkeypatch):
    from cauceda.llm import pretokens

    data = np.frombuffer(("words and 漢字。more, " * 5000).encode(), np.uint8)
    edges = np.array([0, *pretokens.cuts(data, 1000), len(data)])
    assert np.diff(edges).max() <= 1000 and np.diff(edges)[:-1].min() > 900
    assert pretokens.cuts(np.full(5000, ord("a"), np.uint8), 100) == []


def test_generic_patterns_split_alike():
    data, offsets = utf8_column(pa.array(["it's so, 12  x", "", "é 'll"], pa.string()))
    bounds, counts = split(data, offsets)
    again, counts2 = split(data, offsets, public.PATTERN + "|(?!)")
    assert bounds.tolist() == again.tolist() and counts.tolist() == counts2.tolist()


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    found = bpe.PerfectHash(keys).index(keys)
    assert sorted(found.tolist()) == list(range(5000))
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([1, 1], np.uint64))


def test_encode_and_decode_round_trip(clashing, corpus):
    out = bpe.decode(bpe.encode(clashing)).collect()
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in out), key=str)
    want = []
    for doc, text in corpus:
        ids = REFERENCE.encode_ordinary(text or "")
        want.append((doc, len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()))
    assert got == sorted(want, key=str)


def test_empty_tables(empty):
    assert bpe.decode(bpe.encode(empty)).count() == 0
    assert packing.pack(packing.tokenize(empty)).count() == 0


def test_packing_holds_every_token_once(clashing, corpus):
    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    want = sorted(hashlib.sha256(np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()).hexdigest() for _, t in corpus if t != "same row")
    packed = packing.pack(packing.tokenize(clashing, tokens=512), tokens=512, group_tokens=1 << 14).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in packed:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= 512
        if r["doc_id"] is not None and r["doc_id"] != 76:
            pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 512
    made = []
    for rows in pieces.values():
        rows.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and all(r["length"] == 512 for r in rows[1:])
        assert [r["start"] for r in rows] == [sum(x["length"] for x in rows[:i]) for i in range(len(rows))]
        made.append(hashlib.sha256(b"".join(bytes(r["ids"]) for r in rows)).hexdigest())
    assert set(made) <= set(want) and len(made) == len({d for d, _ in corpus if d is not None}) - 1


def test_added_tokens_are_one_id_as_in_the_library():
    own, rng = Tokenizer.from_file(public.path("byte_bpe_50k.json")), random.Random(6)
    parts = ["<|endoftext|>", "<|endof", "text|>", "end ", " start", "  ", "it's", "é", "\n"]
    texts = ["end <|endoftext|> start", "<|endof", "text|>", "", "<|endoftext|>", *("".join(rng.choices(parts, k=rng.randint(0, 6))) for _ in range(500))]
    ids, counts = packing.encoder(packing.TOKENIZER).encode(*utf8_column(pa.array(texts, pa.string())))
    ends = np.append(0, np.cumsum(counts))
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert ends[-1] == len(ids) and len(got[0]) == 4 and got[4] == [50256]


def test_packing_parts_rows_without_ids(spark):
    """Groups are bounded in rows, and rows of no id or of one id are dealt to all of them."""
    pieces = spark.range(4000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "0 AS piece", "CAST(1 + id % 7 AS BIGINT) AS length")
    rows = packing.pack(packing.materialize(pieces, "pieces"), tokens=64, documents=64, group_rows=500).collect()
    total = defaultdict(int)
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert len(rows) == 4000 and max(total.values()) <= 64 and len({s % 8 for s in total}) == 8
    assert len(total) <= sum(total.values()) / 64 + 8


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_obeys_every_capacity(rule):
    lengths = np.random.default_rng(3).integers(1, 700, 3000)
    bins, offsets = packing.best_fit(lengths, 1000, 3, 500_000, rule, (1, 0.5, 0.5))
    for b in range(bins.max() + 1):
        own = lengths[bins == b]
        assert own.sum() <= 1000 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 500_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([900]), 1000, 3, 500_000)


def test_best_fit_is_close_to_the_least_number():
    lengths = np.minimum(2048, np.random.default_rng(4).lognormal(6, 1, 20000)).astype(np.int64) + 1
    lengths = np.minimum(lengths, 2048)
    bins, _ = packing.best_fit(lengths, 2048, 2048, 2048**2)
    assert bins.max() + 1 <= 1.01 * np.ceil(lengths.sum() / 2048)


def test_cut_leaves_the_short_piece_first():
    row, piece, start, length = packing.cut(np.array([1, 10, 11, 25]), 10)
    assert length.tolist() == [1, 10, 1, 10, 5, 10, 10] and start.tolist() == [0, 0, 0, 1, 0, 5, 15]
    assert piece.tolist() == [0, 0, 0, 1, 0, 1, 2] and row.tolist() == [0, 1, 2, 2, 3, 3, 3]


def test_crc_of_ids_matches_zlib(spark, docs):
    from pyspark.sql import functions as F

    row = packing.tokenize(docs).select("ids", F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(bytes(row["ids"]))
