"""Near-duplicate detection: weighted word shingles, DartMinHash signatures, banded joining.

A document is the multiset of its five-word shingles. Every unit of an element's weight is a
region of its own; hashed darts fall into it at exponentially distributed ranks, each on one of
K coordinates. The earliest dart of each coordinate is the signature: two documents agree on a
coordinate with probability equal to their weighted Jaccard similarity. Only darts that come
early enough to matter are thrown, so a signature takes time linear in document plus signature.

Copies (the same words) are folded into one representative first. Representatives that share a
band of coordinates meet in a bucket; there everyone is compared with one member drawn at random
(another one in every band), not with everyone. Pairs are verified by their exact similarity, and
linked documents form components. Buckets that still hold several components are joined again:
small ones by all pairs of different components, large ones with two drawn members. What large
buckets then still hold of different components is joined completely, so that every link of
documents that share a bucket is found: a bucket falls apart by length, members that share none of
their rarest elements with another component have no link and go, and the rest meets in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import pick, release, saved, text_of
from rastermill.operators.skew import join_counted

WORDS = 5
#: Bands and coordinates in a band: a pair of similarity 0.8 is missed once in 1400 times.
BANDS, ROWS = 24, 6
K = BANDS * ROWS
#: Residual buckets of up to this size are joined by all pairs of different components.
SMALL = 24
#: Bands whose buckets are joined first.
FIRST = 6
#: Large buckets are compared in blocks of about so many members and bytes of elements, and so many elements at once.
BLOCK, BLOCK_BYTES, WIDTH = 512, 8 << 20, 4096
#: Cells in which the frequency of elements is counted (8 bytes each on driver and workers, whatever the data).
CELLS = 1 << 18
#: Rows in which a task tells its counts.
PARTS = 16
#: Pairs of one document that are verified in one place; beyond, its text is repeated.
PER_HUB = 2000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with even odds."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def combine(columns: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash of each row of hashes, order counting."""
    h = np.full(columns.shape[:-1], _U(0x9E3779B97F4A7C15 + salt), np.uint64)
    for k in range(columns.shape[-1]):
        h = mix(h * _U(0xD1342543DE82EF95) + columns[..., k])
    return h


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Hash and document number of every shingle, and a digest of each document's words.

    Words are runs of non-space characters in lower case; a document of fewer than five words has one shingle.
    """
    words = [t.lower().split() for t in texts]
    keys = [xxhash.xxh3_128_digest(" ".join(w)) for w in words]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    padded = np.where(counts > 0, np.maximum(counts, WORDS), 0)
    starts = np.concatenate([[0], np.cumsum(padded)])
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.empty(0, np.uint64), np.empty(0, np.int64), keys
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(u) for u in uniques), np.uint64, len(uniques))
    tokens = np.zeros(starts[-1] + WORDS, np.uint64)
    doc = np.repeat(np.arange(len(words)), counts)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    tokens[starts[doc] + offset] = hashes[codes]
    n = np.where(padded > 0, padded - WORDS + 1, 0)
    owner = np.repeat(np.arange(len(words)), n)
    at = starts[owner] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return combine(tokens[at[:, None] + np.arange(WORDS)]), owner, keys


def occurrences(elements: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often the same element stood in the same document before."""
    key = elements ^ mix(owner.astype(np.uint64) + _U(1))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(key) else np.empty(0, bool)
    run = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    out = np.empty(len(key), np.int64)
    out[order] = run
    return out


def dart_minhash(elements: np.ndarray, owner: np.ndarray, n_docs: int, k: int = K, weights: np.ndarray | None = None) -> np.ndarray:
    """Signatures, one row of k hashes per document (zeros for documents without elements).

    Without weights, an element that is repeated weighs as much as it has occurrences. A weight may
    be any positive number: its last, broken region keeps only darts that fall below the fraction.
    """
    if weights is None:
        cell, part = occurrences(elements, owner), np.ones(len(elements))
    else:
        whole = np.ceil(weights).astype(np.int64)
        elements, owner, w = np.repeat(elements, whole), np.repeat(owner, whole), np.repeat(weights, whole)
        cell = np.arange(len(elements)) - np.repeat(np.cumsum(whole) - whole, whole)
        part = np.minimum(1.0, w - cell)
    region = mix(elements + cell.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    total = np.bincount(owner, part, n_docs)
    # So many darts leave no coordinate empty, as a rule; else the horizon is doubled.
    horizon = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-9)
    signature, todo = np.zeros((n_docs, k), np.uint64), total > 0
    while todo.any():
        use = todo[owner]
        e, d, f, rank = region[use], owner[use], part[use], np.zeros(int(use.sum()))
        found = []
        throw = 0
        while len(e):
            throw += 1
            h = mix(e + _U(throw * 0xC2B2AE3D27D4EB4F % 2**64))
            rank = rank - np.log(((h >> _U(11)).astype(np.float64) + 0.5) / 2.0**53)
            early = rank <= horizon[d]
            e, d, f, rank, h = e[early], d[early], f[early], rank[early], h[early]
            dart = mix(h + _U(0x165667B19E3779F9))
            inside = ((mix(dart) >> _U(11)).astype(np.float64) / 2.0**53) < f if weights is not None else slice(None)
            found.append((d[inside], rank[inside], dart[inside]))
        d, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        late_first = np.argsort(-rank, kind="stable")  # of equal slots the last one written, the earliest, stays
        slot = d * k + (dart % _U(k)).astype(np.int64)
        flat = np.zeros(n_docs * k, np.uint64)
        flat[slot[late_first]] = dart[late_first] | _U(1)
        flat = flat.reshape(n_docs, k)
        full = todo & (flat != 0).all(axis=1)
        signature[full] = flat[full]
        todo &= ~full
        horizon = np.where(todo, horizon * 2, horizon)
    return signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = signature.reshape(len(signature), BANDS, ROWS)
    return np.stack([combine(bands[:, b], b + 1) for b in range(BANDS)], axis=1).view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts over the sum of the larger ones, for (sorted elements, counts)."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    return float(shared / (total - shared))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (digest of the words) and bands (none for texts without words)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                elements, owner, keys = shingles(part.column(1).to_pylist())
                has = np.bincount(owner, minlength=len(keys)) > 0
                bands = band_keys(dart_minhash(elements, owner, len(keys)))[has]
                ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))], names=["id", "key", "bands"]
                )

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b and further columns) whose exact similarity reaches the threshold. texts: id, text.

    The text of b travels with the pair to a's partition; the text of a, which may stand in very
    many pairs, travels once for each PER_HUB of them, so a hub's pairs are spread.
    """
    pairs = saved(pairs, "near-pairs")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_HUB).cast("int").alias("places")).where("places > 1")
    hubs = saved(hubs, "near-hubs")
    spread = lambda rows: rows.join(hubs, "a", "left").withColumn("places", F.coalesce("places", F.lit(1)))
    rows = spread(pairs).withColumn("place", F.pmod(F.xxhash64("b"), "places").cast("int"))
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    left = spread(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")))
    rows = rows.join(left.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place")), ["a", "place"])

    def elements(text: str):
        return np.unique(shingles([text])[0], return_counts=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, left = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, keep = batch.slice(at, 256), []
                for ta, tb in zip(*(part.column(part.num_columns - k).to_pylist() for k in (2, 1)), strict=True):
                    if ta != text:
                        text, left = ta, elements(ta)
                    keep.append(weighted_jaccard(left, elements(tb)) >= threshold)
                yield part.select(range(part.num_columns - 2)).filter(pa.array(keep, pa.bool_()))

    return rows.select(*pairs.columns, "text_a", "text_b").mapInArrow(run, pairs.schema)


def components(links: DataFrame) -> DataFrame:
    """id, label for every linked id: the smallest id that its links lead to. links: a, b.

    Every id is folded into its smallest neighbour, and the links between what is left are taken
    on, until none is left. Links shrink fast: a star is gone after two rounds.
    """
    edges, folds = links.select("a", "b"), []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        folds.append(saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to")), "near-folds"))
        ends = edges.join(folds[-1].select(F.col("id").alias("a"), F.col("to").alias("to_a")), "a")
        ends = ends.join(folds[-1].select(F.col("id").alias("b"), F.col("to").alias("to_b")), "b").where("to_a <> to_b")
        edges = saved(ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "near-edges")
        if edges.isEmpty():
            break
    labels = folds[0].withColumnRenamed("to", "label")
    for fold in folds[1:]:
        labels = labels.join(fold.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return saved(labels, "near-labels")


def _starred(members: DataFrame, seed: int) -> DataFrame:
    """The member drawn for each bucket, paired with those of other components: a, b and their labels."""
    # At first the same member wins in all buckets that it stands in, which leaves fewer pairs to verify.
    by = F.xxhash64("rep", "bucket", F.lit(seed)) if seed else F.xxhash64("rep")
    draw = F.struct(by.alias("h"), F.col("rep").alias("a"), F.col("label").alias("label_a"))
    hubs = members.groupBy("bucket").agg(F.min(draw).alias("hub")).select("bucket", "hub.a", "hub.label_a").alias("h")
    rows = members.alias("m").join(hubs, (F.col("m.bucket") == F.col("h.bucket")) & (F.col("m.label") != F.col("h.label_a")))
    return rows.select("a", F.col("rep").alias("b"), "label_a", F.col("label").alias("label_b"))


def bags(texts: DataFrame) -> DataFrame:
    """id and elements: the shingles as 64-bit numbers, another number for each repetition. texts: id, text.

    The weighted similarity of two documents is the plain one of these sets.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                elements, owner, _ = shingles(part.column(1).to_pylist())
                elements = mix(elements + occurrences(elements, owner).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                ends = np.searchsorted(owner, np.arange(part.num_rows + 1))
                sets = [elements[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "elements"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, elements binary")


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """The number of elements that each set of the left shares with each of the right."""
    sets = [np.frombuffer(b, np.uint64) for b in (*left, *right)]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True)
    here, n = owner < len(left), int(code.max(initial=-1)) + 1
    both = (np.bincount(code[here], minlength=n) > 0) & (np.bincount(code[~here], minlength=n) > 0)
    rank = np.cumsum(both) - 1
    owner, code = owner[both[code]], rank[code[both[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for first in range(0, int(both.sum()), WIDTH):
        i, j = np.searchsorted(code, [first, first + WIDTH])
        dense = np.zeros((len(sets), min(WIDTH, int(both.sum()) - first)), np.float32)
        dense[owner[i:j], code[i:j] - first] = 1
        out += (dense[: len(left)] @ dense[len(left) :].T).astype(np.int64)
    return out


def rarest(sets: DataFrame, threshold: float) -> DataFrame:
    """id, size and rare: of each set as many of its rarest elements as could be missing in a linked one, and one more.

    Of two sets whose similarity reaches the threshold these have an element in common, in whatever
    order elements are taken, as long as it is the same for all sets. It is that of frequency here,
    which is counted in CELLS cells over all sets. Those that are alone in their cell stand in no other
    set and are left out. sets: id, elements.
    """
    kind = sets.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                np.add.at(n, (np.frombuffer(raw, np.uint64) % _U(CELLS)).astype(np.int64), 1)
        yield from packed(n)

    def packed(n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The cells that are not 0, in one row for each of PARTS stretches of cells that has any."""
        cell = np.flatnonzero(n)
        ends = np.searchsorted(cell, np.arange(PARTS + 1) * (CELLS // PARTS)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (cell, n[cell])]
        rows = pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), *lists], names=["part", "cell", "n"])
        yield rows.filter(pa.array(np.diff(ends) > 0))

    def add(rows: pa.Table) -> pa.Table:
        n = np.zeros(CELLS, np.int64)
        for cell, k in zip(rows.column("cell").chunks, rows.column("n").chunks, strict=True):
            np.add.at(n, cell.flatten().to_numpy(), k.flatten().to_numpy())
        return pa.Table.from_batches(packed(n))

    # A task tells its counts in at most PARTS rows, however many elements it has read.
    form = "part int, cell array<long>, n array<long>"
    counted = sets.select("elements").mapInArrow(count, form).groupBy("part").applyInArrow(add, form).toArrow()
    often = np.zeros(CELLS, np.int64)
    for cell, k in zip(counted.column("cell").chunks, counted.column("n").chunks, strict=True):
        often[cell.flatten().to_numpy()] = k.flatten().to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        for batch in batches:
            size, rare = [], []
            for raw in batch.column(1).to_pylist():
                x = np.frombuffer(raw, np.uint64)
                order = np.lexsort((x, n[(x % _U(CELLS)).astype(np.int64)]))
                size.append(len(x))
                first = x[order[: len(x) - int(np.ceil(threshold * len(x) - 1e-9)) + 1]]
                rare.append(first[n[(first % _U(CELLS)).astype(np.int64)] > 1].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(rare, pa.list_(pa.int64()))], names=["id", "size", "rare"])

    return sets.select("id", "elements").mapInArrow(run, f"id {kind}, size long, rare array<long>")


def candidates(members: DataFrame, rare: DataFrame, threshold: float) -> DataFrame:
    """The members that may have a link to another component: rep, bucket, label, size. rare: as from rarest.

    A member stays if one of its rarest elements is also among the rarest of another component; each
    is looked at once, however many buckets it stands in. Linked sets are of sizes in the same class or
    in neighbouring ones (a class reaches up to 1 / threshold times its least size), so each bucket
    falls into one for each two neighbours, of which those with one component only go.
    """
    step = max(float(np.log(1 / threshold)) * 1.0001, 1e-6)
    size_class = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / step)
    named = rare.join(members.select(F.col("rep").alias("id"), "label").distinct(), "id")
    found = saved(named.select("id", "label", F.explode("rare").alias("element")), "near-rare")
    met = found.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    kept = join_counted(found.select("id", "element"), saved(met.select("element", "n"), "near-met"), "element", "n", "inner").select("id").distinct()
    sizes = saved(pick(rare.select("id", "size"), kept), "near-sized")
    rows = members.join(sizes.withColumnRenamed("id", "rep"), "rep")
    rows = rows.withColumn("size_class", F.explode(F.array(size_class, size_class - 1)))
    rows = rows.select("rep", "label", "size", F.xxhash64("bucket", "size_class").alias("bucket"))
    split = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return rows.join(split, "bucket", "left_semi")


def _exhaustive(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Every link of different components in a bucket, as labels a, b. members: rep, bucket, label.

    Of two members of different components one at least is not of the bucket's largest component.
    So all candidates are met, in blocks, with those outside the largest one, in blocks too.
    """
    kind = members.schema["label"].dataType.simpleString()
    needed = members.select(F.col("rep").alias("id")).distinct()
    sets = saved(bags(pick(texts, needed)), "near-bags")
    members = saved(candidates(members, saved(rarest(sets, threshold), "near-rarest"), threshold), "near-candidates")
    parts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    by = F.struct("n", "label")
    shape = parts.groupBy("bucket").agg(F.max_by("label", by).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("n0"), F.max_by("bytes", by).alias("bytes0"))
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    shape = shape.select("bucket", "main", blocks(F.col("n"), F.col("bytes")).alias("lefts"), blocks(F.col("n") - F.col("n0"), F.col("bytes") - F.col("bytes0")).alias("rights"))
    rows = members.join(shape, "bucket")
    at = lambda seed, n: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select("rep", "label", "bucket", at(11, "lefts").alias("i"), each("rights").alias("j"), F.lit(True).alias("is_left"))
    right = rows.where("label <> main").select("rep", "label", "bucket", each("lefts").alias("i"), at(12, "rights").alias("j"), F.lit(False).alias("is_left"))
    cells = left.unionByName(right).join(sets.withColumnRenamed("id", "rep"), "rep").select("bucket", "i", "j", "is_left", "label", "elements")

    def run(cell: pa.Table) -> pa.Table:
        is_left = cell.column("is_left").to_numpy()
        labels = cell.column("label").combine_chunks().dictionary_encode()
        codes, sets = labels.indices.to_numpy(), cell.column("elements").to_pylist()
        l, r = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        size = np.array([len(b) // 8 for b in sets], np.int64)
        shared = overlaps([sets[k] for k in l], [sets[k] for k in r])
        union = size[l][:, None] + size[r] - shared
        x, y = np.nonzero((shared / np.maximum(union, 1) >= threshold) & (codes[l][:, None] != codes[r]))
        ends = np.unique(np.sort(np.stack([codes[l[x]], codes[r[y]]], axis=1), axis=1), axis=0)
        return pa.table({"a": labels.dictionary.take(pa.array(ends[:, 0])), "b": labels.dictionary.take(pa.array(ends[:, 1]))})

    return cells.groupBy("bucket", "i", "j").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members, with their labels, of buckets that hold several components."""
    named = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    split = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    return saved(named.join(split, "bucket"), "near-open")


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after components are joined as wholes; their members follow. found: a, b (labels)."""
    if found.isEmpty():
        return labels
    joined = components(found).select(F.col("id").alias("label"), F.col("label").alias("to"))
    reached = labels.select("id", "label").unionByName(joined.select(F.col("label").alias("id"), "label").join(labels.select("id"), "id", "left_anti"))
    return saved(reached.join(joined, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "near-labels")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per document: id, class_id, class_size, copies.

    A class is a connected component of documents linked by a weighted Jaccard similarity of at
    least `threshold` over five-word shingles; class_id is its smallest id, class_size its number of
    rows, copies the number of rows with the very same words. Null and empty texts have the same
    (no) words and form one class. Rows repeated with one id count as copies. Texts of any length are
    read whole. Rows without an id are left out. An empty table gives no rows; other columns, also
    those named like results, are ignored.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    sketch = saved(sketches(docs, id_col, text_col), "near-sketches")
    reps = saved(
        sketch.groupBy("key").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "near-reps"
    )
    rows = reps.select("rep", F.posexplode("bands").alias("band", "bucket"))
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = saved(rows.join(crowded, "bucket"), "near-members")
    texts = members.select(F.col("rep").alias("id")).distinct()
    texts = saved(pick(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), texts).dropDuplicates(["id"]), "near-texts")

    # The first bands join most of what belongs together; in all bands then only different components meet.
    first = members.where(F.col("band") < FIRST).withColumn("label", F.col("rep"))
    links = saved(verified(_starred(first, 0).select("a", "b").distinct(), texts, threshold), "near-links")
    labels = components(links)
    open_ = _open(members, labels)
    large = open_.where(F.col("size") > SMALL)
    small = open_.where(F.col("size") <= SMALL).alias("m")
    other = small.select("bucket", F.col("rep").alias("b"), F.col("label").alias("label_b")).alias("o")
    few = small.join(other, (F.col("m.bucket") == F.col("o.bucket")) & (F.col("m.label") < F.col("label_b")))
    few = few.select(F.col("rep").alias("a"), "b", F.col("label").alias("label_a"), "label_b")
    pairs = _starred(large, 1).unionByName(_starred(large, 2)).unionByName(few)
    found = verified(pairs.distinct(), texts, threshold).select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    labels = _merged(labels, saved(found.distinct(), "near-joins"))
    # No draw is needed any more: what large buckets still hold of different components meets completely.
    rest = _open(large.select("rep", "bucket"), labels)
    if not rest.isEmpty():
        labels = _merged(labels, saved(_exhaustive(rest, texts, threshold), "near-rest"))

    named = reps.select("key", "rep", "copies").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = saved(named.select("key", "copies", F.coalesce("label", "rep").alias("class_id")), "near-named")
    # One class, or the texts without words, may hold a third of all rows.
    sizes = saved(named.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n")), "near-sizes")
    classes = saved(join_counted(named, sizes, "class_id", "n", "inner").select("key", "class_id", "class_size", "copies"), "near-classes")
    return join_counted(sketch.select("id", "key"), classes, "key", "copies", "inner").select(F.col("id").alias(id_col), "class_id", "class_size", "copies")
