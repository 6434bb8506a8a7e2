import hashlib
import zlib
from itertools import batched

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cauceda.llm import manifest, sha256
from cauceda.llm.queries import queries
from tests.llm.conftest import COLUMNS, documents

QUERY = queries()["op12_merkle_manifest"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, at, value):
    """The root of ``nodes`` with ``value`` at ``at``, the true root and all siblings."""
    siblings = []
    while len(nodes) > 1:
        first = at - at % 3
        run = nodes[first : first + 3]
        siblings += run[: at - first] + run[at - first + 1 :]
        value = h(*run[: at - first], value, *run[at - first + 1 :])
        nodes, at = [h(*r) for r in batched(nodes, 3)], at // 3
    return value, nodes[0], siblings


def brute(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified; rows: doc_id, source, lang, n_chars, text."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: [leaf(r) for r in groups[s]] for s in names}
    subroots = [climb(leaves[s], 0, leaves[s][0])[1] for s in names]
    out = []
    for at_top, s in enumerate(names):
        for at, r in enumerate(groups[s]):
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0
            text = r[4].replace("\n", "") if tampered and r[4] is not None else r[4]
            value, subroot, low = climb(leaves[s], at, leaf((*r[:4], text)))
            value, root, high = climb(subroots, at_top, value)
            out.append((r[0], leaves[s][at], subroot, root, h(*low, *high), value, value == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, kind="doc_id long, source string, lang string, n_chars long, text string", extra=None):
    df = spark.createDataFrame(rows, kind).repartition(3)
    (df.selectExpr("*", *extra) if extra else df).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, QUERY(spark, str(tmp_path)).collect()), key=str)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=5), st.integers(0, 5))
def test_states_equal_the_library(digests, n):
    states = sha256.start(1)
    for d in digests:
        states = sha256.after_digest(states, np.frombuffer(d, np.uint8)[None])
    want = hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()
    assert sha256.finish(states, np.array([len(digests)])).tobytes() == want
    states = sha256.start(n)
    assert len(sha256.finish(states, np.zeros(n, int))) == n and all(x.tobytes() == hashlib.sha256().digest() for x in sha256.finish(states, np.zeros(n, int)))


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_query_equals_brute_force_over_sources_of_all_sizes(spark, tmp_path, monkeypatch, levels):
    """Small pages make trees of many bands; sources of 1 to 40 rows, null ones, and more sources than a page has nodes."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows, i = [], 0
    for s, n in [(None, 5), ("", 1), ("é", 2), ("Z", 3), ("hot", 40), *((f"s{k}", 1 + k % 4) for k in range(12))]:
        for _ in range(n):
            text = (None, "", "one\ntwo", "plain", "\n", "漢\n字")[i % 6]
            rows.append((i, s, None if i % 7 == 0 else "en", None if i % 5 == 0 else i, text))
            i += 1
    found = run(spark, tmp_path, rows)
    assert found == brute(rows)
    assert {r[6] for r in found} == {True, False}


def test_the_whole_corpus_with_ties_nulls_and_clashing_columns(spark, tmp_path, corpus):
    rows = [(i, "s" if (i or 0) % 3 else "t", "en", 0, t) for i, t in corpus] + [(None, None, None, None, None)] * 2
    found = run(spark, tmp_path, rows, extra=["'x' AS at", "1 AS page", "'y' AS `group`", "2 AS leaf", "3 AS of", "4 AS n", "5 AS root", "6 AS now", "7 AS above"])
    assert found == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "a\nb")]])
def test_empty_and_single(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == brute(rows)


def test_a_hot_source_spreads_over_pages_and_tasks(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    leaves, pages, subroots = manifest.build(manifest.materialize(docs, "test-rows"), [F.col("doc_id")], "source")
    assert pages.count() == -(-30_000 // 3**8) and leaves.agg(F.countDistinct("at")).first()[0] == 30_000
    found = manifest.folded(pages, leaves.filter("doc_id % 1000 = 7").select(F.col("source").alias("group"), "at", "doc_id", "leaf"), "leaf")
    want, root, _ = climb([hashlib.sha256(str(i).encode()).hexdigest() for i in range(30_000)], 7, hashlib.sha256(b"7").hexdigest())
    assert want == root and {r["fold"]["root"] for r in found.collect()} == {root} == {r["subroot"] for r in subroots.collect()}


def test_folding_hashes_nothing_to_the_left(monkeypatch):
    """The last child of three costs its own block and the padding's, the first one all three and the padding's."""
    digests = np.arange(96, dtype=np.uint8).reshape(3, 32)
    body, _ = manifest.grow(digests, 1)
    levels, blocks = manifest.opened(body, 3, 1), []
    own = sha256.after_block
    monkeypatch.setattr(sha256, "after_block", lambda states, data: blocks.append(len(states)) or own(states, data))
    costs = []
    for slot in range(3):
        manifest.fold(levels, b"", np.array([slot]), digests[slot : slot + 1])
        costs.append(sum(blocks))
        blocks.clear()
    assert costs == [4, 3, 2]


def test_columns_are_those_of_documents():
    assert set(manifest.LEAF) == {c.split()[0] for c in COLUMNS.split(", ")} and documents
