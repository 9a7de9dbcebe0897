"""Language-model scores from an Elias-Fano n-gram trie that is split over the cluster.

The model has two levels. Level 1 holds every word of the training documents with its count,
level 2 every pair of neighbouring words with its discounted probability, quantised to 16 bits.
A pair is found by successor search among the words that follow its context: in each shard the
contexts, the pointers to their successors and the successors themselves are monotone sequences
in Elias-Fano form, laid out in one memory-mapped file.

    p1(w)   = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w|u)  = max(c(u w) - D, 0) / c(u) + D n(u) / c(u) * p1(w)      (p1(w) where u is unknown)

n(u) is the number of different words seen after u; the probabilities of all words after u sum to one.

Neither the model nor the queries pass through one machine. Documents are coded in batches; the
distinct words, then the distinct pairs, of a batch go to the shards by hash, with their training
counts. A shard adds the counts up, builds its part of the trie, answers the batches that asked,
and forgets it. Contexts above SPLIT occurrences are dealt over several shards by their next word.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm.common import fold_of, saved, shared_dir, text_of
from rastermill.llm.near_dedup import mix

#: What is taken off the count of every pair.
DISCOUNT = 0.9
#: A batch ends after so many characters; a context with more occurrences is split over shards.
BATCH_CHARS, SPLIT = 8 << 20, 100_000
#: Keys that a shard holds, about.
SHARD_KEYS = 1_000_000
#: Bits of a successor's hash, relative to its context.
WORD_BITS = 40
END, BEGIN = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" begin")
_U = np.uint64


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


class EliasFano:
    """A monotone sequence: high parts as counts of ones between zeros, low bits as they are.

    successor(v, first, last) gives the position of the first value >= v in [first, last).
    """

    def __init__(self, low_bits: int, low: np.ndarray, starts: np.ndarray, size: int):
        self.low_bits, self.low, self.starts, self.size = low_bits, low, starts, size

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        kind = np.uint32 if low_bits <= 32 else np.uint64
        low = (values & _U((1 << low_bits) - 1)).astype(kind)
        high = (values >> _U(low_bits)).astype(np.int64)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        if n:
            bits[high + np.arange(n)] = 1
        return cls(low_bits, low, np.packbits(bits, bitorder="little"), n)

    def open(self) -> EliasFano:
        """Reads the unary part once: where the values of every high part start."""
        bits = np.unpackbits(np.asarray(self.starts), bitorder="little")
        ones = np.flatnonzero(bits)[: self.size]
        high = ones - np.arange(len(ones))
        top = int(high[-1]) if len(high) else 0
        return _Opened(self.low_bits, self.low, np.searchsorted(high, np.arange(top + 2)).astype(np.int64), self.size, high)


class _Opened(EliasFano):
    def __init__(self, low_bits, low, starts, size, high):
        super().__init__(low_bits, low, starts, size)
        self.high = high

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(np.uint64) << _U(self.low_bits)) | self.low[i].astype(np.uint64)

    def successor(self, v: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        high, top = v >> _U(self.low_bits), len(self.starts) - 2
        over = high > _U(top)
        hi = np.minimum(high, _U(top)).astype(np.int64)
        a, b = self.starts[hi], self.starts[hi + 1]
        if first is not None:
            a, b = np.clip(a, first, last), np.clip(b, first, last)
        a = np.where(over, b, a)
        low = (v & _U((1 << self.low_bits) - 1)).astype(self.low.dtype)
        act = np.flatnonzero(a < b)
        while len(act):  # binary search among the values of one high part
            mid = (a[act] + b[act]) >> 1
            less = self.low[mid] < low[act]
            a[act] = np.where(less, mid + 1, a[act])
            b[act] = np.where(less, b[act], mid)
            act = act[a[act] < b[act]]
        return a


class Trie:
    """Contexts -> pointers -> successors with quantised probabilities, in one memory-mapped file."""

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, words: np.ndarray, probabilities: np.ndarray, folder: str):
        """contexts sorted; sizes: successors of each; words: their hashes, sorted within each context."""
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), sizes)
        parts = {
            "contexts": EliasFano.build(contexts),
            "pointers": EliasFano.build(np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)),
            "words": EliasFano.build((rank << _U(WORD_BITS)) | words),
        }
        path, at, places = os.path.join(folder, uuid.uuid4().hex), 0, {}
        with open(path, "wb") as f:
            for name, ef in parts.items():
                for field in ("low", "starts"):
                    a = getattr(ef, field)
                    f.write(b"\0" * (-at % 8))
                    at += -at % 8
                    places[name, field] = (a.dtype, at, len(a))
                    f.write(a.tobytes())
                    at += a.nbytes
            f.write(b"\0" * (-at % 8))
            at += -at % 8
            places["p", ""] = (np.dtype(np.uint16), at, len(probabilities))
            f.write(probabilities.astype(np.uint16).tobytes())

        def mapped(key) -> np.ndarray:
            dtype, offset, n = places[key]
            return np.memmap(path, dtype, "r", offset, (n,)) if n else np.empty(0, dtype)

        self.path = path
        self.contexts, self.pointers, self.words = (
            EliasFano(ef.low_bits, mapped((name, "low")), mapped((name, "starts")), ef.size).open() for name, ef in parts.items()
        )
        self.p = mapped(("p", ""))

    def find(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Quantised probability of each pair (0: not there), and each context's number of successors."""
        code, fans = np.zeros(len(contexts), np.uint16), np.zeros(len(contexts), np.int64)
        if not self.contexts.size or not len(contexts):
            return code, fans
        at = np.minimum(self.contexts.successor(contexts), self.contexts.size - 1)
        known = self.contexts.access(at) == contexts
        first, last = (self.pointers.access(at + d).astype(np.int64) for d in (0, 1))
        fans[known] = (last - first)[known]
        target = (at.astype(np.uint64) << _U(WORD_BITS)) | words
        pos = self.words.successor(target, first, last)
        inside = known & (pos < last)
        pos = np.where(inside, pos, 0)
        hit = inside & (self.words.access(pos) == target)
        code[hit] = self.p[pos[hit]]
        return code, fans

    def close(self) -> None:
        del self.contexts, self.pointers, self.words, self.p
        os.unlink(self.path)


#: Probabilities are kept as log10 in steps of 1/4000; code 0 is "not there".
STEPS = 4000.0


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(65535 + STEPS * np.log10(p)), 1, 65535).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 65535) / STEPS), 0.0)


def _coded(docs: DataFrame, id_col: str, text_col: str, held_out) -> DataFrame:
    """Batches of documents as numbers: one row per batch, bucketed by batch so that it is never shuffled.

    Word number 0 is the end of a document. words: hashes of the numbered words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (chars < BATCH_CHARS or end == start):
                    chars += len(texts[end])
                    end += 1
                words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts[start:end]]
                counts = np.fromiter(map(len, words), np.int64, len(words))
                flat = [w for ws in words for w in ws]
                codes, uniques = pd.factorize(np.array([b" end", *flat], dtype=object)) if flat else (np.zeros(1, int), [b" end"])
                numbers = np.zeros(len(flat) + len(words), np.uint32)
                ends = np.cumsum(counts + 1) - 1
                inner = np.ones(len(numbers), bool)
                inner[ends] = False
                numbers[inner] = codes[1:]
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(u) for u in uniques), np.uint64, len(uniques))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) | no], pa.int64()),
                        pa.array([ids.slice(start, end - start).to_pylist()], pa.list_(ids.type)),
                        pa.array([held[start:end]], pa.list_(pa.bool_())),
                        pa.array([pack((counts + 1).astype(np.uint32))], pa.binary()),
                        pa.array([pack(numbers)], pa.binary()),
                        pa.array([hashes.tobytes()], pa.binary()),
                        pa.array([len(hashes)], pa.int64()),
                        pa.array([len(numbers)], pa.int64()),
                    ],
                    names=["batch", "ids", "held", "sizes", "numbers", "words", "n_words", "n_tokens"],
                )
                start, no = end, no + 1

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held"), text_of(text_col).alias("text"))
    schema = f"batch long, ids array<{kind}>, held array<boolean>, sizes binary, numbers binary, words binary, n_words long, n_tokens long"
    spark, name = docs.sparkSession, f"lm_coded_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.mapInArrow(run, schema).write.format("parquet").bucketBy(n, "batch").option("path", f"{shared_dir(spark)}/{name}")
    writer.saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    """Drops the catalog's entry for coded documents when the driver's program ends."""
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _shard_bits(keys: int) -> int:
    return max(3, (max(1, keys // SHARD_KEYS) - 1).bit_length())


def _slices(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, last) of every run of equal, sorted shard numbers."""
    if len(shards):
        cuts = np.flatnonzero(np.diff(shards)) + 1
        yield from zip(shards[np.concatenate([[0], cuts])].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True)


def _training(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, sizes and, for each token, whether it is a training token."""
    numbers, sizes = unpack(row["numbers"], np.uint32).astype(np.int64), unpack(row["sizes"], np.uint32).astype(np.int64)
    return numbers, sizes, np.repeat(~np.array(row["held"], bool), sizes)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_WORD_ASK = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_WORD_SAY = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("answer", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])


def _level_1(coded: DataFrame, bits: int) -> DataFrame:
    """Training counts of the words of each batch: batch, shard, answer; totals of the shard in one of its rows."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers, _, train = _training(row)
                words = np.frombuffer(row["words"], np.uint64)
                counts = np.bincount(numbers, train, len(words)).astype(np.uint32)
                order = np.argsort(words)
                words, counts = words[order], counts[order]
                rows = [(row["batch"], s, words[a:b].tobytes(), pack(counts[a:b])) for s, a, b in _slices((words >> _U(64 - bits)).astype(np.int64))]
                yield from _table(rows, _WORD_ASK).to_batches()

    def answer(group: pa.Table) -> pa.Table:
        asked = [np.frombuffer(k, np.uint64) for k in group["keys"].to_pylist()]
        counts = np.concatenate([unpack(c, np.uint32) for c in group["counts"].to_pylist()])
        keys, place = np.unique(np.concatenate(asked), return_inverse=True)
        totals = np.bincount(place, counts, len(keys)).astype(np.int64)
        level, ends = EliasFano.build(keys).open(), np.cumsum([0, *map(len, asked)])
        known = int((totals > 0).sum())
        rows = []
        for i, (b, s) in enumerate(zip(group["batch"].to_pylist(), group["shard"].to_pylist(), strict=True)):
            found = totals[level.successor(asked[i])] if ends[i + 1] > ends[i] else totals[:0]
            rows.append((b, s, pack(found.astype(np.uint64)), int(totals.sum()) if i == 0 else 0, known if i == 0 else 0))
        return _table(rows, _WORD_SAY)

    asked = coded.select("batch", "held", "sizes", "numbers", "words").mapInArrow(ask, "batch long, shard long, keys binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "batch long, shard long, answer binary, total long, distinct long")


def _word_counts(row: dict, answers: pa.Table) -> np.ndarray:
    """The training count of every numbered word of a batch, from the shards' answers in order of shard."""
    words = np.frombuffer(row["words"], np.uint64)
    got = sorted(zip(answers["shard"].to_pylist(), answers["answer"].to_pylist(), strict=True))
    out = np.zeros(len(words), np.int64)
    out[np.argsort(words)] = np.concatenate([unpack(a, np.uint64) for _, a in got]).astype(np.int64)
    return out


class Pairs:
    """The distinct pairs of a batch whose context the model knows, by shard, context and word."""

    def __init__(self, row: dict, counts: np.ndarray, bits: int):
        self.numbers, self.sizes, train = _training(row)
        words = np.append(np.frombuffer(row["words"], np.uint64), _U(BEGIN))
        begin = len(words) - 1
        n_begin = row["n_training"]
        before = np.concatenate([[begin], self.numbers[:-1]])
        before[np.concatenate([[0], np.cumsum(self.sizes)[:-1]])] = begin
        pair = before * (begin + 1) + self.numbers
        self.distinct, self.of = np.unique(pair, return_inverse=True)
        context, word = self.distinct // (begin + 1), self.distinct % (begin + 1)
        self.seen = np.append(counts, n_begin)[context]  # occurrences of the context
        self.word = word
        trained = np.bincount(self.of, train, len(pair)).astype(np.int64)[: len(self.distinct)] if len(pair) else np.empty(0, np.int64)
        self.asked = np.flatnonzero(self.seen > 0)
        c, w, seen = words[context[self.asked]], words[word[self.asked]], self.seen[self.asked]
        salt = (mix(w) % (1 + seen // SPLIT).astype(np.uint64)).astype(np.uint64)
        shard = (mix(c + salt * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)
        w = mix(w ^ _U(0x5851F42D4C957F2D)) >> _U(64 - WORD_BITS)
        order = np.lexsort((w, c, shard))
        self.asked = self.asked[order]
        self.context, self.hash, self.shard, self.trained, self.occurs = c[order], w[order], shard[order], trained[self.asked], seen[order]
        # Of a split context every shard is asked for the number of successors, also where no word is.
        big = np.unique(np.stack([self.context, self.occurs.astype(np.uint64)]), axis=1) if len(self.context) else np.empty((2, 0), np.uint64)
        big = big[:, big[1] >= SPLIT]
        self.heads = [(int(h), np.unique((mix(h + np.arange(1 + int(n) // SPLIT, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)).tolist()) for h, n in big.T]


_PAIR_ASK = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("contexts", pa.binary()), ("sizes", pa.binary()), ("occurs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("heads", pa.binary())])
_PAIR_SAY = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("answer", pa.binary()), ("fans", pa.binary()), ("head_fans", pa.binary())])


def _runs(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of runs of equal contexts."""
    first = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(contexts) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(contexts)))


def _five_bytes(words: np.ndarray) -> bytes:
    return words.view(np.uint8).reshape(-1, 8)[:, : WORD_BITS // 8].tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    width = WORD_BITS // 8
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _level_2(coded: DataFrame, level_1: DataFrame, bits: int, n_training: int) -> DataFrame:
    """Quantised probabilities of the pairs of each batch: batch, shard, answer, fans, head_fans."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            p = Pairs(row | {"n_training": n_training}, _word_counts(row, right), bits)
            heads: dict[int, list[int]] = {}
            for h, shards in p.heads:
                for s in shards:
                    heads.setdefault(s, []).append(h)
            slices = {s: (a, b) for s, a, b in _slices(p.shard)}
            for s in sorted(slices.keys() | heads.keys()):
                a, b = slices.get(s, (0, 0))
                first, n = _runs(p.context[a:b])
                rows.append(
                    (row["batch"], s, p.context[a:b][first].tobytes(), pack(n.astype(np.uint32)), pack(p.occurs[a:b][first].astype(np.uint64)), _five_bytes(p.hash[a:b]), pack(p.trained[a:b].astype(np.uint32)), np.array(heads.get(s, []), np.uint64).tobytes())
                )
        return _table(rows, _PAIR_ASK)

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        contexts, words, counts, occurs = [], [], [], []
        for r in rows:
            n = unpack(r["sizes"], np.uint32).astype(np.int64)
            contexts.append(np.repeat(np.frombuffer(r["contexts"], np.uint64), n))
            occurs.append(np.repeat(unpack(r["occurs"], np.uint64), n))
            words.append(_from_five(r["words"]))
            counts.append(unpack(r["counts"], np.uint32).astype(np.int64))
        c, w, k, o = (np.concatenate(x) for x in (contexts, words, counts, occurs))
        trained = k > 0
        c, w, k, o = c[trained], w[trained], k[trained], o[trained]
        order = np.lexsort((w, c))
        c, w, k, o = c[order], w[order], k[order], o[order]
        new = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])) if len(c) else np.empty(0, np.int64)
        totals = np.add.reduceat(k, new) if len(new) else np.empty(0, np.int64)
        c, w, o = c[new], w[new], o[new]
        first, sizes = _runs(c)
        out = []
        with tempfile.TemporaryDirectory() as folder:
            trie = Trie(c[first], sizes, w, quantise((totals - DISCOUNT) / np.maximum(o, 1)), folder)
            for r, cs, ws in zip(rows, contexts, words, strict=True):
                code, fans = trie.find(cs, ws)
                heads = np.frombuffer(r["heads"], np.uint64)
                _, head_fans = trie.find(heads, np.zeros(len(heads), np.uint64))
                out.append((r["batch"], r["shard"], pack(code), pack(fans[_runs(cs)[0]].astype(np.uint32)), pack(head_fans.astype(np.uint32))))
            trie.close()
        return _table(out, _PAIR_SAY)

    asked = coded.select("batch", "held", "sizes", "numbers", "words").groupBy("batch").cogroup(level_1.select("batch", "shard", "answer").groupBy("batch"))
    asked = asked.applyInArrow(ask, "batch long, shard long, contexts binary, sizes binary, occurs binary, words binary, counts binary, heads binary")
    return asked.groupBy("shard").applyInArrow(answer, "batch long, shard long, answer binary, fans binary, head_fans binary")


def language_model_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a boolean column of docs; the model learns from the other rows. Tokens are words (A-Z
    in lower case, cut at ASCII white space) and one end per document. A null text counts as empty:
    its one token is the end. Repeated rows count and are scored each. Without training rows every
    probability is that of an unknown word, or of the whole where nothing is known. An empty table
    gives no rows; other columns, also those named like results, are ignored. A text of any length is
    scored whole. Null ids stay null.
    """
    coded = _coded(docs, id_col, text_col, held_out)
    sums = coded.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    level_1 = saved(_level_1(coded, _shard_bits(sums[0] or 0)), "lm-words")
    total, distinct = level_1.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n_training = docs.where(~held_out).count()
    bits = _shard_bits(sums[1] or 0)
    level_2 = saved(_level_2(coded, level_1, bits, n_training), "lm-pairs")
    kind = docs.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        one, two = right.filter(pc.equal(right["level"], 1)), right.filter(pc.equal(right["level"], 2))
        for row in left.to_pylist():
            counts = _word_counts(row, one)
            base = (counts + 0.5) / (total + 0.5 * (distinct + 1))
            p = Pairs(row | {"n_training": n_training}, counts, bits)
            code, fan = np.zeros(len(p.distinct), np.uint16), np.zeros(len(p.distinct))
            got = {r["shard"]: r for r in two.to_pylist()}
            asked_code, asked_fan = np.zeros(len(p.asked), np.uint16), np.zeros(len(p.asked))
            for s, a, b in _slices(p.shard):
                asked_code[a:b] = unpack(got[s]["answer"], np.uint16)
                asked_fan[a:b] = np.repeat(unpack(got[s]["fans"], np.uint32), _runs(p.context[a:b])[1])
            spread: dict[int, int] = {}
            by_shard: dict[int, list[int]] = {}
            for h, shards in p.heads:
                for s in shards:
                    by_shard.setdefault(s, []).append(h)
            for s, hs in by_shard.items():
                for h, n in zip(hs, unpack(got[s]["head_fans"], np.uint32).tolist(), strict=True):
                    spread[h] = spread.get(h, 0) + n
            if spread:
                keys = np.array(sorted(spread), np.uint64)
                values = np.array([spread[int(k)] for k in keys], float)
                at = np.minimum(np.searchsorted(keys, p.context), len(keys) - 1)
                asked_fan = np.where(keys[at] == p.context, values[at], asked_fan)
            code[p.asked], fan[p.asked] = asked_code, asked_fan
            lower = np.where(p.seen > 0, DISCOUNT * fan / np.maximum(p.seen, 1), 1.0)
            whole = probability(code) + lower * base[p.word]
            ends = np.cumsum(p.sizes) - p.sizes
            scores = np.add.reduceat(np.log10(whole)[p.of], ends)
            bases = np.add.reduceat(np.log10(base)[p.numbers], ends)
            known = np.add.reduceat((counts > 0).astype(np.int64)[p.numbers], ends)
            held = np.array(row["held"], bool)
            out += list(zip(row["ids"], held.tolist(), p.sizes.tolist(), known.tolist(), np.full(len(held), total).tolist(), bases.tolist(), scores.tolist(), strict=True))
        ids = left.schema.field("ids").type.value_type
        fields = pa.schema([(id_col, ids), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return _table(out, fields)

    answers = level_1.select("batch", F.lit(1).alias("level"), "shard", "answer", F.lit(None).cast("binary").alias("fans"), F.lit(None).cast("binary").alias("head_fans"))
    answers = answers.unionByName(level_2.withColumn("level", F.lit(2)))
    scored = coded.select("batch", "ids", "held", "sizes", "numbers", "words").groupBy("batch").cogroup(answers.groupBy("batch"))
    return scored.applyInArrow(score, schema)


def held_out_fold(id_col: str = "doc_id"):
    return fold_of(id_col, 5) == 1
