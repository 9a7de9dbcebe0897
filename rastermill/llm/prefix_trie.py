"""The trie of all conversations by their turns, screened by a count-min sketch of prefix digests.

Every conversation gives one light row for each of its prefixes: a digest of 128 bits, chained from
turn to turn, and the digest of the prefix before. Tasks count the digests in small count-min
sketches, which are merged by segments into one plane of bits (seen twice or more). A prefix whose
estimate is one is in no other conversation: it and all that follows in its conversation are nodes
of one member, written where they stand. Only prefixes that may be shared are shuffled, and grouped
exactly there. Sums over subtrees run over the shared nodes alone, in rounds that double the
distance they reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import BROADCAST_BYTES, saved, text_of

#: Rows of the sketch, cells of a row for each prefix, and most cells of a row (4 rows of them make 8 MB of bits).
ROWS, CELLS_PER_PREFIX, MOST_CELLS = 4, 4, 1 << 24
#: Cells that are merged together.
SEGMENT = 1 << 16
#: Bytes that a node takes in a broadcast table.
NODE_BYTES = 128
#: Ids that are joined to one text before they are sent to the task that hashes a node's ends.
CHUNK = 4096

_PATHS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), *((n, pa.int64()) for n in ("a", "b", "pa", "pb")), ("bytes", pa.int64()), ("last", pa.bool_())])
_SPARSE = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), turn_digest, bytes (of the text in UTF-8) of every turn that has a conv_id.

    Turns stand in order of turn, null first, and where it is equal in order of their digests.
    """
    role, text = F.coalesce("role", F.lit("")), text_of()
    # The length in front keeps role and text apart.
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("bytes"))
    at = F.row_number().over(_window(["conv_id"], [F.col("turn").asc_nulls_first(), "turn_digest"]))
    return rows.select("conv_id", (at - 1).cast("long").alias("pos"), "turn_digest", "bytes")


def _window(by: list, order: list):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def share_heads(turns: DataFrame, family: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): every conversation c begins with the first h turns of c - c % family, h = crc32(c) % longest.

    Its own turns after the first h follow. ids holds all conversations, also those that have no turn left.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(longest))
    ids = turns.select("conv_id").distinct()
    asked = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("head_of"), h.alias("h"))
    heads = turns.where(F.col("pos") < longest - 1).withColumnRenamed("conv_id", "head_of")
    shared = asked.join(heads, "head_of").where("pos < h").select("conv_id", "pos", "turn_digest", "bytes")
    return turns.where(F.col("pos") >= h).select(shared.columns).unionByName(shared), ids


def prefix_paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, digest (a, b), digest of the prefix before (pa, pb), bytes of the last text, last: each prefix of each conversation.

    The empty prefix has depth 0 and the digest 0, 0. Conversations stream by, turn after turn.
    """
    marks = ids.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("bytes"))
    rows = marks.unionByName(turns.select(marks.columns)).repartition("conv_id").sortWithinPartitions("conv_id", F.col("pos").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chain = None, b""
        for batch in batches:
            out = []
            for conv, digest, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if digest is None:
                    if held:
                        out.append((*held, True))
                    chain, held = bytes(16), (conv, 0, 0, 0, 0, 0, 0)
                    continue
                chain = hashlib.sha256(chain + digest).digest()[:16]
                a, b = np.frombuffer(chain, "<i8").tolist()
                out.append((*held, False))
                held = (conv, held[1] + 1, a, b, held[2], held[3], n)
            yield _batch(out, _PATHS)
        if held:
            yield _batch([(*held, True)], _PATHS)

    return rows.mapInArrow(run, _ddl(_PATHS))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cells_of(a: np.ndarray, b: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cell of each digest in each row of the sketch, rows one after another."""
    a, b = a.view("<u8"), b.view("<u8") | np.uint64(1)
    for row in range(ROWS):
        yield (row * width + ((a + np.uint64(row) * b) >> np.uint64(20)) % np.uint64(width)).astype(np.int64)


def _long(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def count_min(paths: DataFrame, prefixes: int) -> tuple[np.ndarray, int]:
    """(bits, width): for each cell whether two prefixes or more fell into it.

    Tasks send what they counted, cells that were met once apart from others; each segment of the
    sketch is merged in one task. Width grows with the number of prefixes up to MOST_CELLS, so the
    bits that come to the driver and go to the workers are 8 MB at most; a fuller sketch lets more
    prefixes pass as possibly shared, which costs a shuffle and no result.
    """
    width = min(MOST_CELLS, max(SEGMENT, 1 << (CELLS_PER_PREFIX * max(1, prefixes) - 1).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            for cells in cells_of(_long(batch, 0), _long(batch, 1), width):
                cell, n = np.unique(cells, return_counts=True)
                seen[cell] = np.minimum(2, seen[cell] + np.minimum(2, n).astype(np.uint8))
        for segment, part in enumerate(seen.reshape(-1, SEGMENT)):
            if part.any():
                yield _batch([(segment, *(np.flatnonzero(part == n).astype("<u2").tobytes() for n in (1, 2)))], _SPARSE)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, seen = None, None
        for batch in batches:
            for s, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != segment:
                    if seen is not None:
                        yield _batch([(segment, b"", np.packbits(seen > 1).tobytes())], _SPARSE)
                    segment, seen = s, np.zeros(SEGMENT, np.uint8)
                seen[np.frombuffer(twice, "<u2")] = 2
                met = np.frombuffer(once, "<u2")
                seen[met] = np.minimum(2, seen[met] + 1)
        if seen is not None:
            yield _batch([(segment, b"", np.packbits(seen > 1).tobytes())], _SPARSE)

    parts = paths.select("a", "b").mapInArrow(count, _ddl(_SPARSE)).repartition("segment").sortWithinPartitions("segment")
    bits = np.zeros((ROWS * width // SEGMENT, SEGMENT // 8), np.uint8)
    for row in parts.mapInArrow(merge, _ddl(_SPARSE)).collect():
        bits[row.segment] = np.frombuffer(row.twice, np.uint8)
    return bits.ravel(), width


def screened(paths: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """paths with open (the prefix may be shared) and parent_open (the one before it may be).

    A prefix is proved to be in one conversation if its estimate is one, or that of the prefix before it.
    """
    shared = paths.sparkSession.sparkContext.broadcast(bits)

    def twice(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, plane = np.ones(len(a), bool), shared.value
        for cells in cells_of(a, b, width):
            out &= (plane[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = twice(_long(batch, 4), _long(batch, 5))
            own = twice(_long(batch, 2), _long(batch, 3)) & before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(before)], schema=marked)

    marked = pa.schema([*_PATHS, ("open", pa.bool_()), ("parent_open", pa.bool_())])
    return paths.select(_PATHS.names).mapInArrow(run, _ddl(marked))


def exact_nodes(rows: DataFrame) -> DataFrame:
    """One row for each digest of the open rows: members, smallest one, how many end there and one of these."""
    return rows.where("open").groupBy("a", "b").agg(
        F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.count_if("last").alias("n_ends"), F.max(F.when(F.col("last"), F.col("conv_id"))).alias("one_end"),
        *(F.max(c).alias(c) for c in ("depth", "pa", "pb", "bytes")),
    )


def with_nodes(rows: DataFrame, nodes: DataFrame, on: tuple[str, str], how: str) -> DataFrame:
    """rows joined with nodes (a, b, n_convs, ...), which no more than n_convs rows ask for.

    Few nodes are broadcast. Of many, those with so many members that only so few of them can be are
    broadcast all the same, and the rows of all others, none of them hot, are joined by a shuffle.
    """
    n, members = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_convs"), F.lit(0))).first()
    most = BROADCAST_BYTES // NODE_BYTES
    keyed = nodes.withColumnsRenamed({"a": on[0], "b": on[1]})
    if n <= most:
        return rows.join(F.broadcast(keyed), list(on), how)
    hot = F.col("n_convs") > members // most  # at most `most` nodes
    first = F.broadcast(keyed.where(hot))
    return rows.join(first, list(on), "inner").unionByName(rows.join(first.select(*on), list(on), "left_anti").join(keyed.where(~hot), list(on), how))


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """Adds to each node's values those of all nodes below it. nodes: a, b, pa, pb, depth, n_convs and values.

    After round k a node has what lies less than 2^k levels below it; what then stands at the ancestor
    2^k levels above is added there. A trie of depth d takes log2(d) + 1 rounds.
    """
    now = saved(nodes.select("a", "b", "n_convs", F.when(F.col("depth") > 0, F.col("pa")).alias("ta"), F.when(F.col("depth") > 0, F.col("pb")).alias("tb"), *values), "trie-sums")
    while True:
        below = now.where("ta IS NOT NULL").groupBy(F.col("ta").alias("a"), F.col("tb").alias("b")).agg(*(F.sum(v).alias(f"{v}_below") for v in values))
        summed = now.join(below, ["a", "b"], "left").select("a", "b", "n_convs", "ta", "tb", *((F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in values))
        above = now.select("a", "b", "n_convs", F.col("ta").alias("na"), F.col("tb").alias("nb"))
        farther = with_nodes(summed.where("ta IS NOT NULL").select("a", "b", "ta", "tb"), above, ("ta", "tb"), "inner")
        own = summed.select("a", "b", "n_convs", *values)
        ancestors = farther.where("na IS NOT NULL").select("a", "b", F.col("na").alias("ta"), F.col("nb").alias("tb"))
        now = saved(own.join(ancestors, ["a", "b"], "left").select("a", "b", "n_convs", "ta", "tb", *values), "trie-sums")
        if now.where("ta IS NOT NULL").isEmpty():
            return now.select("a", "b", *values)


def ends_digests(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of the nodes where two conversations or more end.

    Ids are ordered over all nodes and joined to texts of CHUNK ids in the range that they fall in, so
    that a node with very many ends comes to the task that hashes it as few rows, one after another.
    """
    many = nodes.where("n_ends > 1").select("a", "b", "n_convs")
    rows = with_nodes(paths.where("last").select("a", "b", "conv_id"), many, ("a", "b"), "inner").select("a", "b", "conv_id")
    chunk = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    final = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (_long(batch, i) for i in range(3))
            if not len(ids):
                continue
            starts = np.flatnonzero((np.diff(a, prepend=a[0] ^ 1) != 0) | (np.diff(b, prepend=b[0] ^ 1) != 0)).tolist()
            cuts = [x for s, e in pairwise([*starts, len(ids)]) for x in range(s, e, CHUNK)]
            yield _batch([(a[s], b[s], ids[s], ",".join(map(str, ids[s:e].tolist()))) for s, e in pairwise([*cuts, len(ids)])], chunk)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
            yield _batch(out, final)
        if node:
            yield _batch([(*node, state.hexdigest())], final)

    ranged = rows.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(join, _ddl(chunk))
    return ranged.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, _ddl(final))


def trie_nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per node of the trie over turns (conv_id, pos, turn_digest, bytes) of the conversations in ids (conv_id).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (bytes that
    members share, summed over the subtree) and ends_sha256, as prefix_trie describes them.
    """
    paths = saved(prefix_paths(turns, ids), "trie-paths")
    rows = screened(paths, *count_min(paths, paths.count()))
    exact = saved(exact_nodes(rows), "trie-nodes")
    shared, alone = exact.where("n_convs > 1"), exact.where("n_convs = 1")
    # Nodes of one member: proved by the sketch, or found alone. Below those that the sketch passed, a shared node may stand before them.
    edge = rows.where("NOT open AND parent_open").select("conv_id", "depth", "pa", "pb", "last")
    edge = edge.unionByName(alone.select(F.col("owner").alias("conv_id"), "depth", "pa", "pb", (F.col("n_ends") > 0).alias("last")))
    parents = shared.select("a", "b", "n_convs", F.col("owner").alias("parent_owner"))
    edge = saved(with_nodes(edge, parents, ("pa", "pb"), "left").select("conv_id", "depth", "pa", "pb", "last", "parent_owner"), "trie-edge")
    inner = rows.where("NOT open AND NOT parent_open").select("conv_id", "depth", "last", F.lit(None).cast("long").alias("parent_owner"))
    single = edge.select("conv_id", "depth", "last", "parent_owner").unionByName(inner)
    one = F.lit(1).cast("long")
    single = single.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_owner", "conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(F.col("last"), 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.sha2(F.when(F.col("last"), F.col("conv_id").cast("string")).otherwise(""), 256).alias("ends_sha256"),
    )
    kids = edge.where("parent_owner IS NOT NULL").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("single_kids"))
    inside = shared.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("shared_kids"))
    none = F.lit(0).cast("long")
    nodes = shared.join(kids, ["a", "b"], "left").join(inside, ["a", "b"], "left").withColumn("single_kids", F.coalesce("single_kids", none)).withColumn("n_children", F.col("single_kids") + F.coalesce("shared_kids", none))
    # A single child begins a path of single nodes, which has one leaf.
    nodes = saved(nodes.withColumn("n_leaves", F.col("single_kids") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")), "trie-shared")
    sums = subtree_sums(nodes, ["n_leaves", "saved_tokens"])
    ends = ends_digests(paths, nodes)
    known = with_nodes(nodes.drop("n_leaves", "saved_tokens").withColumnRenamed("n_convs", "members"), parents, ("pa", "pb"), "left")
    joined = known.join(sums, ["a", "b"]).join(ends, ["a", "b"], "left")
    few = F.sha2(F.when(F.col("n_ends") == 1, F.col("one_end").cast("string")).otherwise(""), 256)
    return joined.select(
        F.col("owner").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent_owner")).alias("parent_conv_id"), F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", few).alias("ends_sha256"),
    ).unionByName(single)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns (role and text) of the conversations, from the empty one.

    conv_id: the smallest conversation that begins with it; with depth, the number of its turns, it names
    the node. parent_conv_id: that of the node before (root: null). n_convs: conversations that begin with
    it; n_children: nodes of one turn more; n_leaves: nodes without children in its subtree;
    saved_tokens: over its subtree, the bytes of each node's last text for each member but one;
    ends_sha256: digest of the ids, ascending and joined by commas, of the conversations that end there.

    Turns are taken in order of turn, null first, ties by digest, so repeated rows are turns of their own. A
    null role or text counts as empty; rows without a conv_id belong to no conversation and are left out. Texts of any
    length are hashed whole. Other columns, also those named like results, are ignored. An empty table
    has no node.
    """
    turns = conversation_turns(conversations)
    return trie_nodes(turns, turns.select("conv_id").distinct())


#: Checks the nodes of conversations whose heads are shared; the crc32 of the ids is computed bit by bit.
SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS tok
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS head_of, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT i.conv_id, t.pos, t.tok FROM ids i JOIN t ON t.conv_id = i.head_of AND t.pos < i.h
  UNION ALL SELECT t.conv_id, t.pos, t.tok FROM t JOIN ids i USING (conv_id) WHERE t.pos >= i.h),
c AS (SELECT i.conv_id, coalesce(list(r.tok ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS toks FROM ids i LEFT JOIN r USING (conv_id) GROUP BY 1),
n AS (
  SELECT list_slice(toks, 1, d) AS key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(len(toks) = d) AS leaf,
    (count(*) - 1) * coalesce(max(strlen(toks[d].t)), 0) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(toks) = d), '')) AS ends_sha256
  FROM c, range(len(toks) + 1) x(d) GROUP BY key, d),
s AS (SELECT list_slice(key, 1, k) AS key, count(*) FILTER (leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (depth = k + 1) AS n_children FROM n, range(depth + 1) x(k) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (key) LEFT JOIN n p ON n.depth > 0 AND p.key = list_slice(n.key, 1, n.depth - 1)
"""
