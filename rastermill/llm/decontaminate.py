"""Benchmark decontamination by greedy string tiling with running Karp-Rabin hashes.

For every document and benchmark item that share a window of `min_match` tokens, the longest
matching stretches of tokens that do not overlap are marked, longest first, until no match of
`min_match` tokens is left. The share of the item's tokens that is marked is its coverage; the
tiles may stand in any order, so reordered passages count. Of equally long matches the one that
comes first in the item, then in the document, is marked. Items shorter than `min_match` tokens
must occur whole.

The longest match is found by bisection on its length: two texts share a stretch of a length if
running hashes of their unmarked stretches of it have a value in common. So a tile takes time
linear in the shared parts of both texts, however often their tokens repeat.

The benchmark is taken in blocks of bounded size; each block's seed table is broadcast and the
documents stream past it. Documents are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rastermill.llm.common import release, text_of
from rastermill.llm.near_dedup import mix

WORD = re.compile(r"[^\W_]+")
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 8 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def running_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every window of `width` tokens, modulo 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * BASE + ids[k : k + n].astype(np.uint64)
    return h


class Seeds:
    """A block of benchmark items: token numbers, and the items that every window of tokens stands in."""

    def __init__(self, items: list[tuple], min_match: int):
        self.min_match = min_match
        self.ids, self.vocabulary, self.items = [], {}, []
        for item, text in items:
            tokens = WORD.findall((text or "").lower())
            if tokens:
                self.ids.append(item)
                self.items.append(np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens], np.int64))
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        widths = np.array([min(min_match, len(t)) for t in self.items], np.int64)
        for width in np.unique(widths).tolist():
            nos = np.flatnonzero(widths == width)
            h = [np.unique(running_hashes(self.items[no], width)) for no in nos]
            owner, flat = np.repeat(nos, [len(x) for x in h]), np.concatenate(h)
            order = np.lexsort((owner, flat))
            known, first = np.unique(flat[order], return_index=True)
            self.windows[width] = known, np.append(first, len(flat)), owner[order]

    def sharing(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Item -> hashes of the document's windows of the item's width, for items that share one."""
        out: dict[int, np.ndarray] = {}
        for width, (known, first, owner) in self.windows.items():
            h = running_hashes(ids, width)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for k in np.unique(at[known[at] == h]).tolist():
                for no in owner[first[k] : first[k + 1]].tolist():
                    out[no] = h
        return out


def _covered(h: np.ndarray, among: np.ndarray, width: int) -> np.ndarray:
    """The tokens that lie in a window whose hash is among others."""
    steps = np.zeros(len(h) + width + 1, np.int64)
    at = np.flatnonzero(np.isin(h, among))
    steps[at] += 1
    steps[at + width] -= 1
    return np.cumsum(steps)[: len(h) + width - 1] > 0


class _Side:
    """One text while it is tiled: running hashes of any length, and how far stretches reach unmarked."""

    def __init__(self, tokens: np.ndarray, usable: np.ndarray, powers: np.ndarray, inverse: np.ndarray):
        self.tokens, self.marked, self.inverse = tokens, ~usable, inverse
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens.astype(np.uint64)) * powers[: len(tokens)])])
        self.measure()

    def measure(self) -> None:
        ends = np.append(np.flatnonzero(self.marked), len(self.marked))
        self.free = ends[np.searchsorted(ends, np.arange(len(self.marked)))] - np.arange(len(self.marked))

    def stretches(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the unmarked stretches of n tokens."""
        at = np.flatnonzero(self.free >= n)
        with np.errstate(over="ignore"):
            return at, (self.sums[at + n] - self.sums[at]) * self.inverse[at]

    def mark(self, at: int, n: int) -> None:
        self.marked[at : at + n] = True
        self.measure()


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two texts of token numbers: (item position, document position, length) in the order of marking.

    Number 0 stands for a token that no item has, and matches nothing.
    """
    width = min(least, len(item))
    if len(doc) < width or not width:
        return []
    h_item, h_doc = running_hashes(item, width), running_hashes(doc, width)
    used, places = _covered(h_item, h_doc, width), np.flatnonzero(_covered(h_doc, np.unique(h_item), width))
    # Only the shared stretches of the document take part; a gap between two of them stays one.
    gap = np.flatnonzero(np.diff(places) > 1) + 1
    at = np.insert(places, gap, -1)
    part = np.where(at >= 0, doc[at], 0)
    longest = max(len(item), len(part)) + 1
    powers, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, x, np.uint64)])) for x in (BASE, np.uint64(pow(int(BASE), -1, 2**64))))
    a, b = _Side(item, used, powers, inverse), _Side(part, part > 0, powers, inverse)
    out: list[tuple[int, int, int]] = []

    def first(n: int) -> tuple[int, int] | None:
        """The first common stretch of n unmarked tokens."""
        (p, hp), (d, hd) = a.stretches(n), b.stretches(n)
        for k in np.flatnonzero(np.isin(hp, hd)).tolist():
            for j in d[hd == hp[k]].tolist():
                if np.array_equal(item[p[k] : p[k] + n], part[j : j + n]):  # equal hashes are not yet equal tokens
                    return int(p[k]), j
        return None

    top = min(int(a.free.max(initial=0)), int(b.free.max(initial=0)))
    while top >= width:
        low, found = width - 1, None
        high = top
        while low < high:
            n = (low + high + 1) // 2
            if (hit := first(n)) is not None:
                low, found = n, hit
            else:
                high = n - 1
        if found is None:
            break
        p, d = found
        out.append((p, int(at[d]), low))
        a.mark(p, low)
        b.mark(d, low)
        top = min(low, int(a.free.max(initial=0)), int(b.free.max(initial=0)))
    return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in blocks of about BLOCK_CHARS characters."""
    chars = benchmark.agg(F.sum(F.length(text_of(text_col)))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    items = benchmark.select(F.col(id_col).alias("item_id"), text_of(text_col).alias("text"))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def _matches(seeds: Seeds, text: str, threshold: float) -> list[tuple]:
    tokens = WORD.findall(text.lower())
    known = seeds.vocabulary
    ids = np.fromiter((known.get(t, 0) for t in tokens), np.int64, len(tokens))
    out = []
    for no, h in sorted(seeds.sharing(ids).items()):
        item = seeds.items[no]
        size, width = len(item), min(seeds.min_match, len(item))
        # The shared windows' own tokens bound the coverage from above.
        if _covered(running_hashes(item, width), h, width).sum() < threshold * size:
            continue
        found = tiles(item, ids, seeds.min_match)
        covered = sum(n for _, _, n in found)
        if found and covered >= threshold * size:
            out.append((seeds.ids[no], covered / size, len(found), covered, size, [x for t in sorted(found) for x in t]))
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """One row for every document and benchmark item whose coverage reaches the threshold.

    Columns: id, item_id, coverage, n_tiles, covered_tokens, item_tokens, tiles (item position,
    document position and length of each tile in turn). Tokens are runs of letters and digits in
    lower case. Null or empty texts, on either side, match nothing; texts of any length are read whole;
    repeated rows give repeated rows; equal coverage is reported for each item; empty tables give no
    rows; other columns, also those named like results, are ignored. Ids may be of any type.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.schema["item_id"].dataType
    schema = f"`{id_col}` {kind}, item_id {items.simpleString()}, coverage double, n_tiles int, covered_tokens int, item_tokens int, tiles array<int>"
    sc = docs.sparkSession.sparkContext
    out = None
    for block in blocks(benchmark, "item_id", "text"):
        shared = sc.broadcast(Seeds([tuple(r) for r in block.collect()], min_match))  # one block: bounded by BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = shared.value
            types = [to_arrow_type(items), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            for batch in batches:
                found, rows = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for m in _matches(seeds, text, threshold):
                        rows.append(i)
                        found.append(m)
                if found:
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names=[id_col, "item_id", "coverage", "n_tiles", "covered_tokens", "item_tokens", "tiles"])

        part = docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = 5, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that no benchmark item reaches the threshold in, with all their columns; odd inputs as in contaminations."""
    sc = docs.sparkSession.sparkContext
    for block in blocks(benchmark, "item_id", "text"):
        shared = sc.broadcast(Seeds([tuple(r) for r in block.collect()], min_match))  # one block: bounded by BLOCK_CHARS

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            seeds = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                    yield part.filter(pa.array([not _matches(seeds, t or "", threshold) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
