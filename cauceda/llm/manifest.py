r"""A Merkle manifest of a dataset whose parents keep hash states: a changed row is folded to the root by resuming them.

Rows of a group (a source) in ascending order are leaves; every three consecutive nodes become one by the SHA-256 of their
hexadecimal digests, until one is left, the group's subroot; subroots in ascending order become the root alike. A
digest in hexadecimal is one block of SHA-256, so a parent keeps, before each child slot, the state (32 bytes) after the
children to its left. To fold a replaced child, the state before its slot is resumed with the replacement and the
siblings to its right only; what stands to the left is never hashed again.

The tree is stored in pages of ``3 ** LEVELS`` consecutive nodes with all the levels above them, one row a page, so that
a group of any size is many tasks' work and a level costs no shuffle of its own. Pages of a band are made by one shuffle
of (group, place, digest); their roots are the next band's nodes. Going down, each page learns the steps from it to
the root from the page above it: a few kilobytes a page. A page's rows then fold through their own page's levels and
its steps at once, in numpy.

Defined cases: a null value is ``-`` in its leaf; a null group is a group like others and comes first; null ids come
first in their group, and rows of one id are ordered by leaf; rows alike in both are leaves each; an empty table
has no root and gives an empty result; other columns are ignored. A text is hashed by Spark in the row, whatever its
length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauceda.llm import sha256
from cauceda.llm.common import crc_of_id, discard, materialize, read_table
from cauceda.llm.ordering import ascending, numbered

FAN = 3
#: Levels in a page; it has ``FAN ** LEVELS`` nodes at most.
LEVELS = 8
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(values: list[Column]) -> Column:
    """SHA-256 in hexadecimal of the values, each with its length in bytes; ``-`` for null."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def height(n: Column) -> Column:
    """Levels above n nodes until one is left."""
    steps = F.sequence(F.lit(0), F.lit(40))
    return F.array_min(F.filter(steps, lambda k: F.lit(float(FAN)) ** k >= n)).cast("int")


def sizes_above(n: int, levels: int) -> list[int]:
    """Numbers of nodes from the lowest level up."""
    return [n := -(-n // FAN) if k else n for k in range(levels + 1)]


def grow(digests: np.ndarray, levels: int) -> tuple[bytes, np.ndarray]:
    """A page over nodes (n, 32): for each level but the top, all digests, then the states before each; and its root."""
    parts = []
    for _ in range(levels):
        n = len(digests)
        up = -(-n // FAN)
        states, before = sha256.start(up), np.empty((n, 8), np.uint32)
        for slot in range(FAN):
            held = -(-(n - slot) // FAN) if n > slot else 0  # parents that have the slot: the first ones
            before[slot::FAN] = states[:held]
            states[:held] = sha256.after_digest(states[:held], digests[slot::FAN])
        parts += [digests.tobytes(), before.tobytes()]
        digests = sha256.finish(states, np.minimum(FAN, n - FAN * np.arange(up)))
    return b"".join(parts), digests[0]


def opened(page: bytes, n: int, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level, digests (n, 32) and the states (n, 8) before them."""
    out, at = [], 0
    for size in sizes_above(n, levels)[:levels]:
        digests = np.frombuffer(page, np.uint8, size * 32, at).reshape(size, 32)
        out.append((digests, np.frombuffer(page, np.uint32, size * 8, at + size * 32).reshape(size, 8)))
        at += size * 64
    return out


def steps_of(levels: list[tuple[np.ndarray, np.ndarray]], slot: int) -> bytes:
    """The steps from a node of a page to its root: for each, how many siblings stand left and right, the state, the siblings."""
    out = []
    for digests, states in levels:
        first = slot - slot % FAN
        left, right = digests[first:slot], digests[slot + 1 : first + FAN]
        out += [bytes([len(left), len(right)]), states[slot].tobytes(), left.tobytes(), right.tobytes()]
        slot //= FAN
    return b"".join(out)


def parsed(steps: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """State (8), left and right siblings of each step."""
    out, at = [], 0
    while at < len(steps):
        left, right = steps[at], steps[at + 1]
        at += 2
        state = np.frombuffer(steps[at : at + 32], np.uint32)
        both = np.frombuffer(steps, np.uint8, (left + right) * 32, at + 32).reshape(-1, 32)
        out.append((state, both[:left], both[left:]))
        at += 32 * (1 + left + right)
    return out


def resumed(states: np.ndarray, slots: np.ndarray, values: np.ndarray, rights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Parents' digests with ``values`` in their slots; rights: rows that have a further sibling, and it."""
    states, blocks = sha256.after_digest(states, values), slots + 1
    for rows, digests in rights:
        if len(rows):
            states[rows] = sha256.after_digest(states[rows], digests)
            blocks[rows] += 1
    return sha256.finish(states, blocks)


def fold(levels: list[tuple[np.ndarray, np.ndarray]], above: bytes, slots: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Roots (n, 32) with ``values`` at places ``slots`` of the page, and the SHA-256 of each row's siblings in hexadecimal."""
    proofs: list[list[bytes]] = [[] for _ in slots]
    for digests, states in levels:
        n, first, own = len(digests), slots - slots % FAN, slots % FAN
        rights, shown = [], [digests[i : i + FAN].tobytes().hex().encode() for i in range(0, n, FAN)]
        for k in range(1, FAN):
            rows = np.flatnonzero((own + k < FAN) & (slots + k < n))
            rights.append((rows, digests[slots[rows] + k]))
        for proof, i, k in zip(proofs, (first // FAN).tolist(), own.tolist(), strict=True):
            proof += [shown[i][: 64 * k], shown[i][64 * k + 64 :]]
        values = resumed(states[slots], own, values, rights)
        slots = slots // FAN
    tail = b""
    for state, left, right in parsed(above):
        every = np.arange(len(values))
        rights = [(every, np.repeat(x[None], len(values), axis=0)) for x in right]
        values = resumed(np.repeat(state[None], len(values), axis=0), np.full(len(values), len(left)), values, rights)
        tail += (left.tobytes() + right.tobytes()).hex().encode()
    return values, [hashlib.sha256(b"".join(p) + tail).hexdigest() for p in proofs]


def page_of(place: str) -> Column:
    return F.expr(f"{place} div {FAN**LEVELS}")


def by_page(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows of one page after another, from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        rows = list(zip(*(c.to_pylist() for c in columns), strict=True))
        start = 0
        for i in range(len(rows) + 1):
            if i < len(rows) and (rows[i] == now or now is None):
                now = rows[i]
                continue
            held.append(batch.slice(start, i - start))
            if i == len(rows):
                break
            yield pa.Table.from_batches(held)
            held, start, now = [], i, rows[i]
    if now is not None:
        yield pa.Table.from_batches(held)


def fixed(column: pa.ChunkedArray) -> np.ndarray:
    """A column of 32-byte values as (n, 32) bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


PAGE = "`group` string, page long, n long, levels int, root binary, body binary"


def pages_of(nodes: DataFrame, band: int) -> DataFrame:
    """A band's pages: group, page, n (nodes in it), levels, root, body.

    nodes: group, at (place in the band), digest (binary), height (the group's levels in all).
    """
    keyed = nodes.select("group", page_of("at").alias("page"), "at", "digest", "height")
    dealt = keyed.repartition("group", "page").sortWithinPartitions("group", "page", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_page(batches, ("group", "page")):
            levels = min(LEVELS, max(0, rows["height"][0].as_py() - band * LEVELS))
            body, root = grow(fixed(rows["digest"]), levels)
            columns = [[rows["group"][0].as_py()], [rows["page"][0].as_py()], [rows.num_rows], [levels], [root.tobytes()], [body]]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["group", "page", "n", "levels", "root", "body"])

    return dealt.mapInArrow(run, PAGE)


def tree(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The written pages of every band, lowest first; the last has one page for each group. leaves: group, at, of, digest."""
    nodes = leaves.select("group", "at", "digest", height(F.col("of")).alias("height"))
    most = nodes.agg(F.max("height")).first()[0] or 0
    bands = [materialize(pages_of(nodes, 0), f"{name}-pages")]
    heights = nodes.filter("at = 0").select(F.col("group").alias("_group"), "height")  # a row a group
    for band in range(1, -(-most // LEVELS)):
        roots = bands[-1].select("group", F.col("page").alias("at"), F.col("root").alias("digest"))
        nodes = roots.join(heights, F.col("group").eqNullSafe(F.col("_group"))).drop("_group")
        bands.append(materialize(pages_of(nodes, band), f"{name}-pages"))
    return bands


def steps_down(pages: DataFrame, below: DataFrame) -> DataFrame:
    """``below`` (group, page, at: its place in ``pages``' band, and what else it has) with ``above``: steps to the root.

    pages: group, page, n, levels, body, above. Rows of a page stand after the page itself in one partition.
    """
    return with_page(pages, below, lambda levels, above, rows: [steps_of(levels, s) + above for s in (rows["at"].to_numpy() % FAN**LEVELS).tolist()], "above binary", pa.binary())


def with_page(pages: DataFrame, rows: DataFrame, make, field: str, kind: pa.DataType | None = None) -> DataFrame:
    """``rows`` (group, at, ...) with what ``make`` gives for each from its page's levels and steps."""
    names = [c for c in rows.columns if c not in ("group", "at")]
    own = rows.select("group", page_of("at").alias("page"), "at", *names, F.lit(None).cast("long").alias("_n"), F.lit(None).cast("int").alias("_levels"), F.lit(None).cast("binary").alias("_body"), F.lit(None).cast("binary").alias("_above"))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    held = pages.select("group", "page", F.lit(-1).cast("long").alias("at"), *(F.lit(None).cast(kinds[c]).alias(c) for c in names), F.col("n").alias("_n"), F.col("levels").alias("_levels"), F.col("body").alias("_body"), F.col("above").alias("_above"))
    dealt = held.unionByName(own).repartition("group", "page").sortWithinPartitions("group", "page", "at")
    given = ["group", "at", *names]
    out = field.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_page(batches, ("group", "page")):
            page, table = table.slice(0, 1).to_pylist()[0], table.slice(1).select(given)
            levels = opened(page["_body"], page["_n"], page["_levels"])
            for at in range(0, table.num_rows, FAN**LEVELS):
                part = table.slice(at, FAN**LEVELS).combine_chunks()
                made = pa.array(make(levels, page["_above"], part), kind)
                yield from part.append_column(out, made).to_batches()

    fields = [f"`{c}` {f.dataType.simpleString()}" for c in given for f in rows.schema.fields if f.name == c]
    return dealt.mapInArrow(run, ", ".join([*fields, field]))


def build(rows: DataFrame, order: list[Column], group: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Numbered leaves, the lowest pages with the steps above each, and subroots: source, subroot, root.

    rows: a written table with ``group`` (string), ``leaf`` (hexadecimal) and the columns of ``order``.
    """
    leaves = numbered(rows, order, group, "manifest-leaves")
    bands = tree(leaves.select(F.col(group).alias("group"), "at", "of", F.unhex("leaf").alias("digest")), "manifest")
    subroots = bands[-1].select(F.col("group").alias("source"), "root")
    placed = numbered(subroots, [ascending("source")], None, "manifest-subroots")
    whole = F.lit(None).cast("string")
    top = tree(placed.select(whole.alias("group"), "at", "of", F.col("root").alias("digest")), "manifest-top")
    root = top[-1].select("root").first()  # one row
    upper = top[-1].withColumn("above", F.lit(b""))
    for lower in reversed(top[:-1]):
        upper = steps_down(upper, lower.select("group", F.col("page").alias("at"), "n", "levels", "body")).withColumnRenamed("at", "page")
    sources = steps_down(upper, placed.select(whole.alias("group"), "at", F.col("source"), F.col("root").alias("subroot"))).drop("group", "at")
    sources = materialize(sources.withColumn("whole", F.lit(bytes(root[0]) if root else None).cast("binary")), "manifest-sources")
    known = sources.select(F.col("source").alias("_source"), "above")
    upper = bands[-1].join(known, F.col("group").eqNullSafe(F.col("_source"))).drop("_source")
    found = [upper]
    for lower in reversed(bands[:-1]):
        upper = steps_down(upper, lower.select("group", F.col("page").alias("at"), "n", "levels", "body")).withColumnRenamed("at", "page")
        found.append(upper)
    pages = materialize(found[-1].select("group", "page", "n", "levels", "body", "above"), "manifest-steps")
    discard(bands[0], *top)
    return leaves, pages, sources.select("source", F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("whole")).alias("root"))


def folded(pages: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (group, at, ``value`` in hexadecimal, ...) with ``fold``: the root and the digest of the proof.

    The root is that of the tree with the row's ``value`` in place of its leaf; siblings are the stored ones.
    """

    def make(levels, above, part: pa.Table) -> list[dict]:
        values = np.frombuffer(bytes.fromhex("".join(part[value].to_pylist())), np.uint8).reshape(-1, 32)
        roots, proofs = fold(levels, above, part["at"].to_numpy() % FAN**LEVELS, values)
        return [{"root": r.tobytes().hex(), "proof": p} for r, p in zip(roots, proofs, strict=True)]

    return with_page(pages, rows, make, "fold struct<root:string,proof:string>", pa.struct([("root", pa.string()), ("proof", pa.string())]))


def op12_merkle_manifest(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    cut = F.when(crc_of_id("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    values = [F.col(c) for c in LEAF]
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf_of(values).alias("leaf"), leaf_of([*values[:-1], cut]).alias("now"))
    leaves, pages, subroots = build(materialize(rows, "manifest-rows"), [ascending("doc_id"), F.col("leaf")], "source")
    found = folded(pages, leaves.select(F.col("source").alias("group"), "at", "doc_id", "leaf", "now"), "now")
    known = subroots.withColumnRenamed("source", "_source")
    found = found.join(known, F.col("group").eqNullSafe(F.col("_source")))
    root = F.col("fold.root")
    return found.select("doc_id", "leaf", "subroot", "root", F.col("fold.proof").alias("proof_sha256"), root.alias("folded_root"), (root == F.col("root")).alias("verified"))


#: crc32's table by its polynomial, and the bytes of a text; for DuckDB, which has no crc32.
CRC_TABLE = "SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))"


def crc_sql(text: str) -> str:
    """DuckDB: the unsigned crc32 of the UTF-8 of ``text``, where a column ``tab`` has the table."""
    each = f"list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {each}), lambda c, x: xor(c >> 8, tab[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"


def leaf_sql(text: str) -> str:
    columns = [*("CAST(%s AS VARCHAR)" % c for c in LEAF[:-1]), text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


def walk_sql(name: str, start: str, key: str, runs: str) -> str:
    """DuckDB: rows climb through the runs of siblings, one level a step."""
    others = "list_concat(r.ds[:w.pos % 3], r.ds[w.pos % 3 + 2:])"
    with_own = "list_concat(list_concat(r.ds[:w.pos % 3], [w.value]), r.ds[w.pos % 3 + 2:])"
    return f"""{name} AS ({start} UNION ALL
  SELECT w.* REPLACE (w.level + 1 AS level, w.pos // 3 AS pos, sha256(array_to_string({with_own}, '')) AS value, w.proof || array_to_string({others}, '') AS proof)
  FROM {name} w JOIN {runs} r ON {key} AND r.level = w.level AND r.run = w.pos // 3)"""


ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
leaves AS (SELECT doc_id, source, {leaf_sql("text")} AS leaf,
    CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS now,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM documents, crc),
up AS (SELECT source, 0 AS level, pos, leaf AS digest, n FROM leaves UNION ALL
  SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 2) // 3) FROM up WHERE n > 1 GROUP BY source, level, pos // 3),
runs AS (SELECT source, level, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM up WHERE n > 1 GROUP BY ALL),
subroots AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS digest, n FROM subroots UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 2) // 3) FROM top WHERE n > 1 GROUP BY level, pos // 3),
topruns AS (SELECT level, pos // 3 AS run, list(digest ORDER BY pos) AS ds FROM top WHERE n > 1 GROUP BY ALL),
{walk_sql("low", "SELECT doc_id, source, leaf, 0 AS level, pos, now AS value, '' AS proof FROM leaves", "r.source IS NOT DISTINCT FROM w.source", "runs")},
ended AS (SELECT doc_id, source, leaf, value, proof FROM low QUALIFY level = max(level) OVER (PARTITION BY doc_id)),
{walk_sql("high", "SELECT e.doc_id, e.leaf, s.subroot, 0 AS level, s.pos, e.value, e.proof FROM ended e JOIN subroots s ON s.source IS NOT DISTINCT FROM e.source", "true", "topruns")},
whole AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, value AS folded_root, value = root AS verified
FROM high, whole QUALIFY level = max(level) OVER (PARTITION BY doc_id)
"""
