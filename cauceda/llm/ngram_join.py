r"""N-gram Jaccard join with filters under several global token orders.

A document is the set of its distinct 5-word shingles, as 64-bit hashes; equal sets are one node. Two nodes
link when 100 * intersection >= 80 * union. Under any order of all tokens, nodes that link share a token among
the first ``n - ceil(0.8 n) + 1`` of each, their prefixes.

Order one puts tokens by rising frequency (the power of two of the number of nodes that hold them), then by a
hash. Tokens are counted exactly, over all nodes: each task sends its tokens in blocks of bytes by ranges of the
token's hash, a range at a time is sorted, and tokens of two nodes or more go back to the nodes that hold them. A
token of one node comes first under this order and can be shared with nobody, so only nodes most of whose tokens
are shared have a prefix to look at: without copies about one in ten. The prefix tokens that two nodes share give
the candidate groups, as connected components of (token, node), each edge from a node to the token's smallest:
what moves is in proportion to the tokens, whatever the length of a token's list.

Within a candidate group, nodes meet by classes of size (a class spans a ratio of 1.26, so nodes that link are
in one class or in two neighbouring ones) and by blocks of bounded size in it. Every two blocks that may link are
one cell, dealt apart. In a cell a pair is verified on its whole sets only if

* the sizes allow a link,
* the prefixes under order one share a token,
* and so do those under two other orders, by seeded hashes.

What comes back from a cell is the number of links of each node and a spanning forest of its links: no pair of a
group is written. Components of the forests are the result.

Short names only propose: tokens are told apart by 29 to 60 bits of their hash and nodes by 36 while candidates
are sought, and prefixes are longer by what that may hide, so that no link is missed. Verification takes all 64 bits.

Defined cases: a text without words has size 0 and links with nothing; one of fewer than 5 words is one
shingle; null ids and repeated rows are rows of their own; the component of rows without an id is null unless
they reach a row with one; an empty table gives an empty result; other columns are ignored. Sets of one 64-bit
name are taken for equal (among N distinct sets, about N**2 / 2**65 pairs); hashes are mixed at every step, so no
regular text makes them likelier. ``docs`` is read twice and must give the same rows each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cauceda.llm.common import discard, list_column, materialize, read_table, slices, utf8_column
from cauceda.llm.components import components
from cauceda.llm.hashing import constants, mix, ragged
from cauceda.llm.words import inside, run_hashes, word_hashes, words

SLICE = 1 << 20
#: Bytes of text whose tokens are sent at once, and tokens of one range, about.
FLUSH, RANGE = 4 << 20, 1 << 20
#: Bits of a node's name and of a token's hash, within its range, in one 64-bit entry.
REF, SHORT = 36, 28
#: Above an entry's token: the power of two of its count.
CLASS = 60
#: Node lists up to so many rows (8 bytes each) are broadcast, longer ones are shuffled.
BROADCAST_NODES = 1_000_000
#: Nodes and shingles of a block, about: what a task holds is two blocks.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 19
#: The ratio that a class of sizes spans; above 100 / 80.
RATIO = 1.26
#: Columns of tokens multiplied at once, and pairs of rows counted at once.
WIDE, MANY = 2048, 1 << 21
SEEDS = constants(2, 11)
NAMES = constants(2, 12)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's shingles, sorted and distinct, and their number for each text."""
    starts, ends, counts = words(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    runs = run_hashes(hashes, width)
    at = inside(counts, width)
    short = np.flatnonzero((counts > 0) & (counts < width))
    first = np.cumsum(counts) - counts
    sizes = np.maximum(counts - width + 1, 0)
    values = runs[at[: len(runs)]] if len(runs) else runs
    if len(short):  # the whole sequence is the one shingle
        whole = np.array([run_hashes(hashes[first[i] : first[i] + counts[i]], int(counts[i]))[0] for i in short], np.uint64)
        place = (np.cumsum(sizes) - sizes)[short]
        values = np.insert(values, place, whole)
        sizes[short] = 1
    return distinct(values, sizes)


def distinct(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats."""
    edges = np.append(0, np.cumsum(sizes))
    values = values.copy()
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[edges[:-1][sizes > 0]] = True
    return values[new], _counts(new, edges)


def _counts(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[edges])


def names(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    sums = np.append(np.uint64(0), np.cumsum(mix(values ^ NAMES[0]), dtype=np.uint64))
    edges = np.append(0, np.cumsum(sizes))
    out = mix((sums[edges[1:]] - sums[edges[:-1]]) ^ (sizes.astype(np.uint64) * NAMES[1])) | np.uint64(1)
    return np.where(sizes > 0, out, np.uint64(0))


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first tokens of a set of n suffice to share one with every set it links to."""
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The least number of tokens that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def blocks_of(bucket: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The buckets that occur, and for each the bytes of its rows of ``data``."""
    order = np.argsort(bucket, kind="stable")
    data, bucket = np.ascontiguousarray(data[order]), bucket[order]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    width = data.itemsize * (data.shape[1] if data.ndim > 1 else 1)
    offsets = (np.append(first, len(bucket)) * width).astype(np.int64)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return bucket[first], column.cast(pa.binary())


#: What travels: rows of documents (kind 0), entries of tokens (1), what a node learns of its tokens (2), its prefix (3).
TRAVEL = "kind int, bucket int, data binary, doc_id {}, n long, node long, key long"
_TRAVEL = [x.split()[0] for x in TRAVEL.split(", ")]


def _travel(kind: int, bucket: np.ndarray, data: pa.Array, id_kind: pa.DataType) -> pa.RecordBatch:
    n = len(bucket)
    nothing = [pa.nulls(n, id_kind), *(pa.nulls(n, pa.int64()) for _ in range(3))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(bucket.astype(np.int32)), data, *nothing], _TRAVEL)


def send(rows: DataFrame, width: int, percent: int, bits: int) -> DataFrame:
    """Every row's set, the entries of its tokens by range, and for its node how many shared tokens a link needs."""
    id_kind = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, places, needs, held = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yield _travel(1, *blocks_of(np.concatenate(places), np.concatenate(entries)), id_kind)
            need = np.unique(np.concatenate(needs), axis=0)
            yield _travel(2, *blocks_of(need[:, 0] >> np.uint64(REF - bits), need), id_kind)
            for part in (entries, places, needs):
                part.clear()

        for batch in slices(batches, "text", SLICE):
            data, offsets = utf8_column(batch.column(1))
            values, sizes = shingles(data, offsets, width)
            node = names(values, sizes)
            deal = (batch.column(3).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
            made = [pa.array(np.zeros(len(sizes), np.int32)), pa.array(deal), pa.nulls(len(sizes), pa.binary()), batch.column(0), pa.array(sizes), pa.array(node.view(np.int64)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(made, _TRAVEL)
            ref, short = node >> np.uint64(64 - REF), values >> np.uint64(64 - bits - SHORT)
            entries.append((short & np.uint64((1 << SHORT) - 1)) << np.uint64(REF) | np.repeat(ref, sizes))
            places.append((values >> np.uint64(64 - bits)).astype(np.int32))
            edges = np.append(0, np.cumsum(sizes))
            again = np.append(False, short[1:] == short[:-1])[: len(short)]
            again[edges[:-1][sizes > 0]] = False
            need = np.maximum(least_overlap(sizes, percent) - _counts(again, edges), 1)  # short names may hide tokens of the set
            needs.append(np.stack([ref, need.astype(np.uint64)], axis=1)[sizes > 0])
            held += len(data)
            if held >= FLUSH:
                yield from out()
                held = 0
        if entries:
            yield from out()

    return rows.mapInArrow(run, TRAVEL.format(rows.schema["doc_id"].dataType.simpleString()))


def by_bucket(sent: DataFrame, kind: int, of: Callable[[int, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``sent`` with the rows of ``kind`` replaced by what ``of(bucket, data)`` makes of all data of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], -1
        for batch in batches:
            own = batch.column(0).to_numpy() == kind
            yield batch.filter(pa.array(~own))
            at = np.flatnonzero(own)
            for bucket, data in zip(batch.column(1).to_numpy()[at].tolist(), batch.column(2).take(pa.array(at)).to_pylist(), strict=True):
                if bucket != now and held:
                    yield from of(now, np.frombuffer(b"".join(held), np.uint64))
                    held = []
                now = bucket
                held.append(data)
        if held:
            yield from of(now, np.frombuffer(b"".join(held), np.uint64))

    return sent.repartition("bucket").sortWithinPartitions("kind", "bucket").mapInArrow(run, sent.schema)


def count_tokens(sent: DataFrame, bits: int) -> DataFrame:
    """Entries of a range become (node, class and token), by node, of the tokens that two nodes or more hold."""
    id_kind = to_arrow_type(sent.schema["doc_id"].dataType)

    def of(bucket: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        entries = np.unique(entries)  # a node counts once, however many rows have its set
        token = entries >> np.uint64(REF)
        count = np.diff(np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)))
        count = np.repeat(count, count)
        shared = count > 1
        level = np.minimum(np.frexp(count[shared].astype(np.float64))[1] - 1, 15).astype(np.uint64)
        token = level << np.uint64(CLASS) | np.uint64(bucket << SHORT) | token[shared]
        ref = entries[shared] & np.uint64((1 << REF) - 1)
        yield _travel(2, *blocks_of(ref >> np.uint64(REF - bits), np.stack([ref, token], axis=1)), id_kind)

    return by_bucket(sent, 1, of)


def prefixes(counted: DataFrame) -> DataFrame:
    """What the nodes of a range learnt becomes rows (node: its short name, key: a shared token of its prefix)."""
    id_kind = to_arrow_type(counted.schema["doc_id"].dataType)

    def of(bucket: int, learnt: np.ndarray) -> Iterator[pa.RecordBatch]:
        ref, token = learnt.reshape(-1, 2).T
        order = np.lexsort((token, ref))
        ref, token = ref[order], token[order]
        first = np.flatnonzero(np.append(True, ref[1:] != ref[:-1]))
        sizes = np.diff(np.append(first, len(ref)))
        asked = _counts(token < np.uint64(1 << CLASS), np.append(first, len(ref)))  # what a link needs comes first, the least of it at once
        lead = np.where(asked > 0, np.maximum(sizes - asked - token[first].astype(np.int64) + 1, 0), 0)
        at = ragged(first + asked, lead)
        n = len(at)
        made = [pa.array(np.full(n, 3, np.int32)), pa.array(np.full(n, bucket, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, id_kind), pa.nulls(n, pa.int64())]
        yield pa.RecordBatch.from_arrays([*made, pa.array(ref[at].view(np.int64)), pa.array(token[at].view(np.int64))], _TRAVEL)

    return by_bucket(counted, 2, of)


def sets_and_prefixes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, node, key) of every row; (ref, token), the shared prefix tokens of the nodes that have any; and the written table of both."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(size / 6 / RANGE, 2))), 1, 30))
    rows = docs.select("doc_id", "text", "key", F.xxhash64("doc_id", "text").alias("deal"))
    both = materialize(prefixes(count_tokens(send(rows, width, percent, bits), bits)), "ngram-sets")
    sets = both.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "node", "key")
    return sets, both.filter("kind = 3").select(F.col("node").alias("ref"), F.col("key").alias("token")), both


def candidate_groups(posts: DataFrame) -> DataFrame:
    """ref, group: the components of the nodes that share prefix tokens under order one."""
    shared = posts.groupBy("token").agg(F.min("ref").alias("a"), F.max("ref").alias("last")).filter("a < last").select("token", "a")
    shared = materialize(shared, "ngram-shared")
    found = components(posts.join(shared, "token").select("a", F.col("ref").alias("b")))
    discard(shared)
    return found.select(F.col("node").alias("ref"), F.col("component").alias("group"))


def packed(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """node, packed: the compressed text of each node of ``keys`` (node, key). A text counts only if its set has that name."""
    if keys.count() <= BROADCAST_NODES:
        keys = F.broadcast(keys)
    rows = docs.select("key", "text").join(keys, "key").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in slices(batches, "text", SLICE):
            fresh = [not (x in seen or seen.add(x)) for x in batch.column(0).to_pylist()]
            for own in slices(iter([batch.filter(pa.array(fresh, pa.bool_()))]), "text", SLICE):
                data, offsets = utf8_column(own.column(1))
                node, raw = own.column(0).to_numpy(), data.tobytes()
                right = names(*shingles(data, offsets, width)).view(np.int64) == node
                made = [pack.compress(raw[a:b]) for a, b in zip(offsets[:-1][right].tolist(), offsets[1:][right].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node[right]), pa.array(made, pa.binary())], ["node", "packed"])

    return rows.mapInArrow(run, "node long, packed binary").groupBy("node").agg(F.first("packed").alias("packed"))


def overlaps(left: np.ndarray, left_row: np.ndarray, lefts: int, right: np.ndarray, right_row: np.ndarray, rights: int) -> np.ndarray:
    """How many tokens each of ``lefts`` sets shares with each of ``rights`` sets, given as tokens and their rows.

    Tokens that many pairs share are counted by products of 0/1 matrices, the others pair by pair.
    """
    both = np.intersect1d(left, right)
    sides = []
    for tokens, row in ((left, left_row), (right, right_row)):
        at = np.searchsorted(both, tokens)
        held = at < len(both)
        held[held] = both[at[held]] == tokens[held]
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], row[held][order]))
    (at, row), (other, column) = sides
    count, others = np.bincount(at, minlength=len(both)), np.bincount(other, minlength=len(both))
    heavy = 64 * count * others > lefts * rights
    out = np.zeros((lefts, rights), np.int32)
    chosen = np.flatnonzero(heavy)
    for k in range(0, len(chosen), WIDE):
        place = np.full(len(both), -1, np.int64)
        place[chosen[k : k + WIDE]] = np.arange(len(chosen[k : k + WIDE]))
        ones = []
        for tokens, rows, n in ((at, row, lefts), (other, column, rights)):
            one, own = np.zeros((n, min(WIDE, len(chosen) - k)), np.float32), place[tokens]
            one[rows[own >= 0], own[own >= 0]] = 1
            ones.append(one)
        out += (ones[0] @ ones[1].T).astype(np.int32)
    begin = np.cumsum(others) - others
    light = np.flatnonzero(~heavy[at])
    ends = np.cumsum(others[at[light]])
    k = 0
    while k < len(light):
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + MANY, side="right")))
        own = light[k:end]
        sizes = others[at[own]]
        cells = np.repeat(row[own], sizes) * rights + column[ragged(begin[at[own]], sizes)]
        out += np.bincount(cells, minlength=lefts * rights).reshape(lefts, rights).astype(np.int32)
        k = end
    return out


class Sets:
    """The sets of many nodes: all tokens, and the prefixes under each order. ``lead`` has those under order one."""

    def __init__(self, texts: pa.Array, lead: pa.ListArray, width: int, percent: int):
        self.values, self.sizes = shingles(*utf8_column(texts), width)
        self.edges, self.percent = np.append(0, np.cumsum(self.sizes)), percent
        self.orders = [(lead.flatten().to_numpy(), np.append(0, np.cumsum(lead.value_lengths().fill_null(0).to_numpy())))]
        long = self.sizes - least_overlap(self.sizes, percent) + 1
        long = np.where(self.sizes > 0, long, 0)
        for seed in SEEDS:
            keys, parts = mix(self.values ^ seed), []
            for a, b, k in zip(self.edges[:-1].tolist(), self.edges[1:].tolist(), long.tolist(), strict=True):
                parts.append(np.partition(keys[a:b], k - 1)[:k] if k else keys[:0])
            self.orders.append((np.concatenate(parts), np.append(0, np.cumsum(long))))

    def common(self, values: np.ndarray, edges: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many values each row of ``left`` shares with each row of ``right``."""
        sides = []
        for rows in (left, right):
            sizes = edges[rows + 1] - edges[rows]
            sides += [values[ragged(edges[rows], sizes)], np.repeat(np.arange(len(rows)), sizes), len(rows)]
        return overlaps(*sides)

    def links(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Which rows of ``left`` link to which of ``right``: filters under all orders first, whole sets then."""
        n, m = self.sizes[left][:, None], self.sizes[right][None, :]
        open_ = 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)
        open_ &= left[:, None] != right[None, :]
        for values, edges in self.orders:
            rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(rows):
                return open_
            place = np.ix_(rows, columns)
            open_[place] &= self.common(values, edges, left[rows], right[columns]) > 0
        rows, columns = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if len(rows):
            place = np.ix_(rows, columns)
            common = self.common(self.values, self.edges, left[rows], right[columns])
            total = self.sizes[left[rows]][:, None] + self.sizes[right[columns]][None, :] - common
            open_[place] &= 100 * common.astype(np.int64) >= self.percent * total
        return open_


def spanning(links: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each side's nodes the smallest node reachable by ``links``."""
    most = np.int64(2**63 - 1)
    while True:
        down = np.minimum(right, np.where(links, left[:, None], most).min(axis=0, initial=most))
        up = np.minimum(left, np.where(links, down[None, :], most).min(axis=1, initial=most))
        if (down == right).all() and (up == left).all():
            return up, down
        left, right = up, down


def cell_links(sets: Sets, node: np.ndarray, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """node, links (in rows of other nodes), smallest node reachable, for the nodes of a cell that link. Rows of ``sets``."""
    links = sets.links(left, right)
    if not links.any():
        return [np.empty(0, np.int64)] * 3
    if len(left) == len(right) and (left == right).all():  # a block with itself
        own, sums, least = node[left], links @ rows[right], spanning(links, node[left], node[right])[0]
    else:
        up, down = spanning(links, node[left], node[right])
        own, least = np.append(node[left], node[right]), np.append(up, down)
        sums = np.append(links @ rows[right], rows[left] @ links)
    return [x[sums > 0] for x in (own, sums, least)]


def place(members: DataFrame, block_nodes: int) -> DataFrame:
    """``members`` (node, group, n and others) of groups of two or more, with their class of size, block in it, and the group's blocks by class."""
    sized = members.withColumn("size", F.floor(F.log("n") / float(np.log(RATIO))).cast("int"))
    counts = sized.groupBy("group", "size").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.expr(f"CAST(greatest(ceil(members / {block_nodes}D), ceil(shingles / {BLOCK_SHINGLES}D)) AS INT)")
    # a group has at most some hundred classes of size
    classes = counts.groupBy("group").agg(F.sum("members").alias("all"), F.map_from_entries(F.collect_list(F.struct("size", blocks.alias("blocks")))).alias("blocks"))
    classes = materialize(classes.filter("all > 1").drop("all"), "ngram-classes")
    placed = sized.join(classes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.expr("blocks[size]")).cast("int"))
    placed = materialize(placed, "ngram-members")
    discard(classes)
    return placed


def cells(placed: DataFrame) -> DataFrame:
    """group, cell, left, right, node, rows: each node in every cell that has its block; left and right tell on which side."""
    found = [
        "transform(sequence(0, blocks[size] - 1), k -> struct(2 * size AS kind, least(k, block) AS i, greatest(k, block) AS j, block <= k AS left, k <= block AS right))",
        "IF(map_contains_key(blocks, size + 1), transform(sequence(0, blocks[size + 1] - 1), k -> struct(2 * size + 1 AS kind, block AS i, k AS j, true AS left, false AS right)), array())",
        "IF(map_contains_key(blocks, size - 1), transform(sequence(0, blocks[size - 1] - 1), k -> struct(2 * size - 1 AS kind, k AS i, block AS j, false AS left, true AS right)), array())",
    ]
    dealt = placed.select("group", "node", "rows", F.explode(F.expr(f"concat({', '.join(found)})")).alias("cell"))
    name = F.expr("shiftleft(CAST(cell.kind AS BIGINT), 56) | shiftleft(CAST(cell.i AS BIGINT), 28) | CAST(cell.j AS BIGINT)")
    return dealt.select("group", name.alias("cell"), "cell.left", "cell.right", "node", "rows")


def verify(dealt: DataFrame, width: int, percent: int) -> DataFrame:
    """node, links, least: what ``cell_links`` finds in each cell. dealt: group, cell, left, right, node, rows, packed, lead."""
    dealt = dealt.select("group", "cell", "left", "right", "node", "rows", "packed", "lead").repartition("group", "cell").sortWithinPartitions("group", "cell")

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        """Rows at which another cell begins than in the row before."""
        group, cell = (batch.column(c).to_numpy() for c in range(2))
        return np.flatnonzero((group[1:] != group[:-1]) | (cell[1:] != cell[:-1])) + 1

    def found(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        for batch in whole:
            left, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            node, rows = (batch.column(c).to_numpy() for c in (4, 5))
            texts, out, cuts, begin = [], [], [], 0
            for end in [*changes(batch).tolist(), batch.num_rows]:
                cuts.append((begin, end))
                texts += [unpack.decompress(x) for x in batch.column(6).slice(begin, end - begin).to_pylist()]
                begin = end
                if sum(map(len, texts)) < SLICE and end < batch.num_rows:
                    continue
                first = cuts[0][0]
                sets = Sets(pa.array(texts, pa.large_binary()), batch.column(7).slice(first, end - first), width, percent)
                for a, b in cuts:
                    at = np.arange(a, b)
                    out.append(cell_links(sets, node[first:end], rows[first:end], at[left[a:b]] - first, at[right[a:b]] - first))
                texts, cuts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["node", "links", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, last = [], [], None  # whole cells, and the one that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if now and last != (batch.column(0)[0], batch.column(1)[0]):
                done, now = [*done, *now], []
            last = batch.column(0)[-1], batch.column(1)[-1]
            if len(at := changes(batch)):
                done, now, batch = [*done, *now, batch.slice(0, at[-1])], [], batch.slice(at[-1])
            now.append(batch)
            if sum(x.nbytes for x in done) > SLICE:
                yield from found(done)
                done = []
        if done or now:
            yield from found([*done, *now])

    return materialize(dealt.mapInArrow(run, "node long, links long, least long"), "ngram-found")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key (a hash of the text)."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def ngram_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, block_nodes: int = BLOCK_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n_shingles, node, key) of every row; (node, rows, least_id, component, links) of every set that is not empty; the written table of the first.

    links is to how many rows of other sets the set links; component is the smallest node reachable.
    """
    rows = keyed(docs, id_col, text_col)
    sets, posts, both = sets_and_prefixes(rows, width, percent)
    nodes = sets.filter("n_shingles > 0").groupBy("node").agg(F.first("n_shingles").alias("n"), F.count("*").alias("rows"), F.min("doc_id").alias("least_id"), F.min("key").alias("key"))
    nodes = materialize(nodes.withColumn("ref", F.shiftrightunsigned("node", 64 - REF)), "ngram-nodes")
    members = nodes.join(candidate_groups(posts), "ref", "left").select("node", F.coalesce("group", "ref").alias("group"), "ref", "rows", "n", "key")
    placed = place(members, block_nodes)
    lead = posts.join(placed.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.collect_list("token").alias("lead"))
    texts = packed(rows, placed.select("node", "key"), width)
    carried = placed.select("node", "ref").join(texts, "node").join(lead, "ref", "left").select("node", "packed", "lead")
    carried = materialize(carried, "ngram-texts")
    found = verify(cells(placed).join(carried, "node"), width, percent)
    discard(placed, carried)
    linked = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = nodes.join(linked, "node", "left").join(links, "node", "left")
    whole = whole.select("node", "rows", "least_id", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    whole = materialize(whole, "ngram-links")
    discard(nodes, found)
    return sets, whole, both


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_links (to how many other rows) of every row of ``docs``."""
    sets, nodes, _ = ngram_links(docs, id_col, text_col, **options)
    least = materialize(nodes.groupBy("component").agg(F.min("least_id").alias("component_id")), "ngram-least")
    own = materialize(nodes.join(least, "component").select("node", "component_id", (F.col("links") + F.col("rows") - 1).alias("n_links")), "ngram-own")
    discard(nodes, least)
    empty = F.col("n_shingles") == 0
    linked = sets.filter(~empty).join(own, "node").select("doc_id", "n_shingles", "component_id", "n_links")
    alone = sets.filter(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with all their columns, without those that a link reaches from another text that stays.

    Of each component the text of the smallest id stays, null ids being the largest and the text's hash deciding ties.
    Rows that repeat both its id and its text stay with it; a text without words is no near copy of anything.
    """
    sets, nodes, both = ngram_links(docs, id_col, text_col, **options)
    placed = sets.filter("n_shingles > 0").join(nodes.select("node", "component"), "node")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    placed = materialize(placed.select("component", order.alias("own")), "ngram-placed")
    discard(nodes, both)
    first = materialize(placed.groupBy("component").agg(F.min("own").alias("first")), "ngram-first")
    gone = placed.join(first, "component").filter("own <> first").select(F.col("own.doc_id").alias("_id"), F.col("own.key").alias("_key")).distinct()
    gone = materialize(gone, "ngram-gone")  # its written size decides whether the documents move for the join
    discard(placed, first)
    key = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (key == gone["_key"]), "left_anti")


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join(read_table(spark, sf_dir, "documents"))
