"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words of a text and, for longer words, their first letters (a stem by truncation).
The weight of a term is (1 + log tf) * idf * relevance; relevance is 0.1 for a term that says
nothing about the label and grows with its log odds between the labels, drawn in by how well
these are supported (phi squared). No term is left out: every text that shares a word with an
example has neighbours.

The index holds, for every term, the blocks of examples it stands in, each with its postings and
their largest weight (terms that stand in very many examples have a whole column of weights
instead, which a batch of queries reads in one matrix product). These give every block an upper
bound for a query; blocks are read in falling order of the bound until none can still hold a
nearer example, so the neighbours are exact.
Their votes, weighted by squared similarity and by how many labelled rows an example stands for,
are calibrated on the examples themselves, each left out in turn.

The examples are a sample of at most PER_CLASS labelled rows of each class; index, broadcast and
what the driver collects are bounded by it, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import fold_of, release, saved, text_of

#: Labelled rows that are sampled for each class, by least hash of the id.
PER_CLASS = 4096
#: Examples that vote, examples in a block of the index, blocks that a query reads first.
NEIGHBOURS, BLOCK, FIRST = 15, 64, 8
#: Terms that stand in this share of the examples have a column of weights in place of postings.
DENSE = 0.08
#: Where the chosen blocks hold this share of a query's entries, its postings are read by whole terms, which costs a quarter a posting.
WHOLE = 0.1
#: Letters of a stem.
STEM = 5
#: Relevance of a term that says nothing, and the phi squared at which half of its log odds counts.
LEAST_RELEVANCE, HALF = 0.1, 0.1
#: Texts that are counted at once.
CHUNK = 128
WORD = re.compile(r"[^\W\d_]+")


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 64-bit hash of a term, how often), sorted by text, then hash."""
    words = [WORD.findall(t.lower()) for t in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, uniques), np.uint64, len(uniques))
    long = np.fromiter(map(len, uniques), np.int64, len(uniques)) > STEM
    stem = np.fromiter((xxhash.xxh3_64_intdigest(w[:STEM] + "*") for w in uniques[long]), np.uint64, int(long.sum()))
    terms, number = np.unique(np.concatenate([word, stem]), return_inverse=True)
    of_stem = np.full(len(uniques), -1)
    of_stem[long] = number[len(uniques) :]
    stems = of_stem[codes]
    pairs = np.concatenate([owner * len(terms) + number[codes], (owner * len(terms) + stems)[stems >= 0]])
    pairs, counts = np.unique(pairs, return_counts=True)
    return pairs // len(terms), terms[pairs % len(terms)], counts


def _positions(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions of the ranges of n that begin at first."""
    out = np.repeat(first - np.cumsum(n) + n, n)
    out += np.arange(len(out))
    return out


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges [first, last), and the range that each belongs to."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (first - np.cumsum(n) + n)[of], of


def _paired(whole: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Both numbers of a row side by side, so that they are fetched at once; _parts takes them apart."""
    out = np.empty((len(whole), 2), np.int32)
    out[:, 0], out[:, 1] = whole, real.view(np.int32)
    return out.view(np.int64).ravel()


def _parts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rows.view(np.int32)[::2], rows.view(np.float32)[1::2]


class Index:
    """Examples as unit vectors, by term and block. Rows of `examples`: (id, n0, n1, terms, tf)."""

    def __init__(self, examples: list[tuple], share: tuple[float, float]):
        # The driver builds it, so numbers are as narrow as they can be and none is kept longer than needed.
        n = len(examples)
        sizes = np.array([len(e[3]) for e in examples], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        n0, n1 = (np.array([e[k] for e in examples], np.float64) for k in (1, 2))
        self.keys = np.unique(np.concatenate([*(e[3] for e in examples), np.empty(0, np.uint64)]))
        code = np.empty(ends[-1], np.int32)
        for e, at, end in zip(examples, ends, ends[1:], strict=False):
            code[at:end] = np.searchsorted(self.keys, e[3])
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        a, b = (np.bincount(code, c[owner], len(self.keys)) for c in (n1, n0))
        self.weight = relevance(a, b, n1.sum(), n0.sum())
        value = np.empty(ends[-1], np.float32)
        for e, at, end in zip(examples, ends, ends[1:], strict=False):
            value[at:end] = self._unit(np.zeros(end - at, np.int64), code[at:end], e[4], 1)
        # Examples that share their commonest terms (a language, as a rule) and are equally long are neighbours
        # in the index, which keeps the bounds tight.
        often, common = a + b, np.full((n, 3), len(self.keys), np.int64)
        for i, (at, end) in enumerate(zip(ends, ends[1:], strict=False)):
            own = code[at:end]
            first = own[np.lexsort((own, -often[own]))[:3]]
            common[i, : len(first)] = first
        order = np.lexsort((np.arange(n), sizes, *common.T[::-1]))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        self.ids = [examples[i][0] for i in order]
        weight = (n0 * share[0] + n1 * share[1])[order]
        self.votes, self.label = weight, (n1 * share[1])[order] / np.maximum(weight, 1e-300)
        self.size = BLOCK
        self.n_blocks = max(1, -(-n // self.size))
        # Columns of the terms that stand in very many examples; all others have postings by block.
        often = np.bincount(code, minlength=len(self.keys)) >= max(self.size, DENSE * n)
        self.column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        example = place[owner]
        del owner
        by = np.lexsort((example, code))
        example, value, code = example[by], value[by], code[by]
        del by
        full = often[code]
        self.dense = np.zeros((int(often.sum()), self.n_blocks * self.size), np.float32)
        self.dense[self.column[code[full]], example[full]] = value[full]
        example, value, code = example[~full], value[~full], code[~full]
        block = example // self.size
        new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (block[1:] != block[:-1])])) if len(code) else np.empty(0, np.int64)
        # Of every posting the example and its weight; of every entry, a term in a block, the block and the largest weight.
        self.weights = _paired(example, value)
        self.most = _paired(block[new], np.maximum.reduceat(value, new) if len(new) else np.empty(0, np.float32))
        self.postings = np.append(new, len(code)).astype(np.int32)
        self.blocks = np.searchsorted(code[new], np.arange(len(self.keys) + 1)).astype(np.int32)
        empty = (sizes == 0)[order]
        self.empty_rate = float((weight[empty] @ self.label[empty] + 0.05) / (weight[empty].sum() + 1)) if n else 0.0
        self.place = place

    def _unit(self, owner: np.ndarray, code: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        value = (1 + np.log(np.maximum(tf, 1))) * self.weight[code]
        return value / np.sqrt(np.bincount(owner, value * value, n))[owner]

    def vectors(self, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, term number, weight) of the unit vectors of n texts over the terms that examples have."""
        code = np.minimum(np.searchsorted(self.keys, term), max(0, len(self.keys) - 1))
        known = self.keys[code] == term if len(self.keys) else np.zeros(len(term), bool)
        owner, code = owner[known], code[known]
        return owner, code, self._unit(owner, code, tf[known], n)

    def nearest(self, owner: np.ndarray, code: np.ndarray, value: np.ndarray, n: int, k: int = NEIGHBOURS, leave: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of n vectors the k examples of largest cosine above 0: (cosines, examples); equal ones by example number.

        Cosines are taken to six digits.
        """
        column = self.column[code] if len(code) else np.empty(0, np.int32)
        full = column >= 0
        queries = np.zeros((n, len(self.dense)), np.float32)
        queries[owner[full], column[full]] = value[full]
        common = queries @ self.dense
        highest = common.reshape(n, self.n_blocks, self.size).max(axis=2)
        owner, code, value = owner[~full], code[~full], value[~full]
        ends = np.searchsorted(owner, np.arange(n + 1))
        entries = self.blocks[code], self.blocks[code + 1]
        for q in range(n):
            weights, score = value[ends[q] : ends[q + 1]], common[q]
            first, last = (e[ends[q] : ends[q + 1]] for e in entries)
            block, most = _parts(self.most[_positions(first, last - first)])
            bound = highest[q] + np.bincount(block, np.repeat(weights, last - first) * most, self.n_blocks)
            order = np.argsort(-bound, kind="stable")
            cosines, found, at, step, least, whole_terms = np.empty(0), np.empty(0, np.int64), 0, FIRST, 0.0, False
            while at < len(order) and bound[order[at]] > 0 and (len(found) < k or bound[order[at]] >= least - 2e-6):
                now = order[at : at + step]
                now = now[bound[now] >= least - 2e-6] if len(found) == k else now
                if not whole_terms:
                    chosen = np.zeros(self.n_blocks, bool)
                    chosen[now] = True
                    here = np.flatnonzero(chosen[block])
                    whole_terms = len(here) >= WHOLE * len(block)
                    if whole_terms:  # nothing is left to be read later
                        rare, now = self._by_terms(first, last, weights, len(score)), order[at:]
                        now, step = now[bound[now] >= max(least - 2e-6, 1e-300)], self.n_blocks
                    else:
                        rare = self._by_blocks(first, last, weights, here, len(score))
                members = (now[:, None] * self.size + np.arange(self.size)).ravel()
                whole = score[members] + rare[members]
                if leave is not None:
                    whole[members == leave[q]] = 0
                if len(whole) > k:
                    least = max(least, np.partition(whole, -k)[-k])
                good = (whole > 0) & (whole >= least - 2e-6)
                cosines, found = np.concatenate([cosines, np.round(whole[good], 6)]), np.concatenate([found, members[good]])
                best = np.lexsort((found, -cosines))[:k]
                cosines, found = cosines[best], found[best]
                least = cosines[-1] if len(found) == k else 0.0
                at, step = at + step, self.n_blocks
            yield cosines, found

    def _by_terms(self, first: np.ndarray, last: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """What the entries [first, last) of each term add to every example."""
        first, last = self.postings[first], self.postings[last]
        example, value = _parts(self.weights[_positions(first, last - first)])
        return np.bincount(example, np.repeat(weights, last - first) * value, n)

    def _by_blocks(self, first: np.ndarray, last: np.ndarray, weights: np.ndarray, here: np.ndarray, n: int) -> np.ndarray:
        """The same for those of the entries alone whose numbers are here."""
        entry, of = _spans(first, last)
        entry, of = entry[here], of[here]
        post, which = _spans(self.postings[entry], self.postings[entry + 1])
        example, value = _parts(self.weights[post])
        return np.bincount(example, weights[of][which] * value, n)

    def vote(self, cosines: np.ndarray, found: np.ndarray) -> float:
        w = cosines * cosines * self.votes[found]
        return float(w @ self.label[found] / w.sum())


def relevance(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """idf * relevance of terms that stand in a of n1 texts of label 1 and b of n0 of label 0."""
    c, d = n1 - a, n0 - b
    phi2 = (a * d - b * c) ** 2 / np.maximum(1, (a + b) * (c + d)) / max(1.0, n1 * n0)
    odds = np.abs(np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)))
    return np.log((n1 + n0 + 1) / (a + b)) * (LEAST_RELEVANCE + odds * phi2 / (phi2 + HALF))


def rising(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators; block means are drawn in by one unseen case."""
    pools: list[list[float]] = []  # weight, weighted labels, weighted x
    for i in np.lexsort((y, x)):
        pools.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    at = np.array([p[2] / p[0] for p in pools])
    return at, np.array([(p[1] + 0.05) / (p[0] + 0.1) for p in pools])


class Model:
    """A broadcast index and the curve from votes to scores."""

    def __init__(self, shared, curve: tuple[np.ndarray, np.ndarray]):
        self.shared, self.curve = shared, curve

    @property
    def index(self) -> Index:
        return self.shared.value


def examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, held_out: int) -> tuple[DataFrame, tuple[float, float]]:
    """(id, text, n0, n1) of the sampled training texts, and how many labelled rows a sampled one of each class stands for.

    Equal texts are one example, named by their smallest id. Of an id that stands for several texts the smallest counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_col).isNotNull() & (fold_of(id_col, folds) != held_out))
    known = known.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("label")).distinct()
    there = {r.label: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS) for c in (0, 1)]
    ids = saved(parts[0].unionByName(parts[1]), "toxic-ids")
    # At most 2 * PER_CLASS rows are broadcast, and as many come out.
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(ids), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))
    sampled = {r.label: r["n"] for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = tuple(there.get(c, 0) / max(1, sampled.get(c, 0)) for c in (0, 1))
    merged = rows.groupBy("text").agg(F.min("id").alias("id"), F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    return merged.select("id", "text", "n0", "n1"), share


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the labelled rows outside the held-out fold. labels: id_col, toxic.

    With labels of one class alone every score is near that class; without any it is 0. Labels that
    are null, neither 0 nor 1, or of no document, count nothing. Ids may be of any type.
    """
    sample, share = examples(docs, labels, id_col, text_col, folds, held_out)
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                texts = part.column(1).to_pylist()
                owner, term, tf = terms_of(texts)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                cut = lambda a, kind: pa.array([a[i:j].astype(kind).tobytes() for i, j in zip(ends, ends[1:], strict=False)], pa.binary())  # noqa: E731, B023
                order = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), order, cut(term, "<u8"), cut(tf, "<u4")], names=["id", "n0", "n1", "digest", "terms", "tf"])

    vectors = saved(sample.mapInArrow(count, f"id {kind}, n0 long, n1 long, digest binary, terms binary, tf binary"), "toxic-vectors")
    # The bounded sample, in an order that depends on the texts alone.
    rows = sorted(vectors.collect(), key=lambda r: bytes(r.digest))
    index = Index([(r.id, r.n0, r.n1, np.frombuffer(r.terms, "<u8"), np.frombuffer(r.tf, "<u4")) for r in rows], share)
    place = {bytes(r.digest): int(p) for r, p in zip(rows, index.place, strict=True)}
    label, weight = index.label, index.votes
    shared, places = docs.sparkSession.sparkContext.broadcast(index), docs.sparkSession.sparkContext.broadcast(place)

    def leave_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model, where = shared.value, places.value
        for batch in batches:
            out = []
            for digest, terms, tf in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                term, tf = np.frombuffer(terms, "<u8"), np.frombuffer(tf, "<u4")
                e = where[digest]
                near = next(model.nearest(*model.vectors(np.zeros(len(term), np.int64), term, tf, 1), 1, leave=[e]))
                if len(near[0]):
                    out.append((e, model.vote(*near)))
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in out], pa.int64()), pa.array([v for _, v in out], pa.float64())], names=["example", "vote"])

    del index, rows  # the driver need not keep what is broadcast
    parallel = docs.sparkSession.sparkContext.defaultParallelism
    votes = sorted(tuple(r) for r in vectors.select("digest", "terms", "tf").repartition(parallel).mapInArrow(leave_out, "example long, vote double").collect())
    if not votes:
        return Model(shared, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    e = np.array([i for i, _ in votes])
    return Model(shared, rising(np.array([v for _, v in votes]), label[e], weight[e]))


def _scorer(model: Model):
    """A function from texts to (score, cosines, examples) of each; it runs in tasks."""
    shared, curve = model.shared, model.curve

    def score(texts: list[str]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        release()
        index = shared.value
        for at in range(0, len(texts), CHUNK):
            part = texts[at : at + CHUNK]
            for near in index.nearest(*index.vectors(*terms_of(part), len(part)), len(part)):
                yield (float(np.interp(index.vote(*near), *curve)) if len(near[0]) else index.empty_rate), *near

    return score


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, score, predicted, evidence (ids of the examples that voted), similarity.

    Scores use the text alone. A text without any word of an example, null and empty ones too, gets
    the rate of empty texts among the examples. Texts of any length are read whole. Examples of equal
    cosine come in an order of their texts. Repeated rows give repeated rows, an empty table none;
    other columns, also those named like results, are ignored.
    """
    score, ids, kind = _scorer(model), model.shared, docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                found = list(score(part.column(1).to_pylist()))
                scores = np.clip(np.array([s for s, _, _ in found], np.float64), 0, 1)
                names = ids.value.ids
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(scores),
                        pa.array((scores >= threshold).astype(np.int32)),
                        pa.array([[names[e] for e in near] for _, _, near in found], pa.list_(part.column(0).type)),
                        pa.array([c.tolist() for _, c, _ in found], pa.list_(pa.float64())),
                    ],
                    names=[id_col, "score", "predicted", "evidence", "similarity"],
                )

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, score double, predicted int, evidence array<{kind}>, similarity array<double>"
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns; odd inputs as in toxicity_scores."""
    score = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text_col)).to_pylist()]
                yield part.filter(pa.array([s < threshold for s, _, _ in score(texts)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
