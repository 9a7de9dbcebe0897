"""Alignment of two tokenizers over the same texts, by products of sparse incidence matrices.

Of a text, A has a row for each token of the first tokenizer and a column for each byte, B the same
for the second; both are built by hand in compressed sparse rows. The rows of A times B transposed,
by Gustavson's method, hold the links: the pairs of tokens whose bytes overlap, with the number of
bytes that they share. Where tokens of both end, a group ends; the products of the group incidences
hold the pairs of tokens that share a group.

Several texts at a time make one pair of matrices, whose product has no link across texts. Links are
written once, counted over the corpus by pairs of ids, and met by these counts again.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import resident, saved, text_of

#: Default places of the two vocabularies; parameters of every operator here.
BYTE_BPE, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of the texts that are aligned together; a longer text is aligned alone.
TOGETHER = 100_000
#: Counts of pairs that may be broadcast (12 bytes each), and pairs that a task sums before it sends them.
MOST_PAIRS, SUMMED = 2_000_000, 1_000_000
#: A pair of ids as one number: the first times this plus the second.
BASE = 1 << 15


@dataclass
class Csr:
    """A sparse matrix: the columns of row i are indices[indptr[i]:indptr[i + 1]], with their values in data."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_cols: int

    @classmethod
    def of_spans(cls, lengths: np.ndarray) -> Csr:
        """Token-byte incidence of tokens that follow one another: each row has the bytes of its token."""
        indptr = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        n = int(indptr[-1])
        return cls(indptr, np.arange(n), np.ones(n, np.int64), n)

    @classmethod
    def of_labels(cls, labels: np.ndarray, n_cols: int) -> Csr:
        """Token-group incidence: row i has the one column labels[i]."""
        return cls(np.arange(len(labels) + 1), labels, np.ones(len(labels), np.int64), n_cols)

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        if (self.indices[1:] < self.indices[:-1]).any():
            order = np.argsort(self.indices, kind="stable")
            columns, rows, data = self.indices[order], rows[order], self.data[order]
        else:
            columns, data = self.indices, self.data
        indptr = np.concatenate([[0], np.cumsum(np.bincount(columns, minlength=self.n_cols))])
        return Csr(indptr, rows, data, len(self.indptr) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of other's rows that row i names, equal columns added up."""
        n_rows, sizes = len(self.indptr) - 1, np.diff(other.indptr)[self.indices]
        row, value, at = np.repeat(np.arange(n_rows), np.diff(self.indptr)), self.data, other.indptr[self.indices]
        if (sizes != 1).any():
            first = np.concatenate([[0], np.cumsum(sizes)])
            at = np.arange(first[-1]) - np.repeat(first[:-1] - at, sizes)
            row, value = np.repeat(row, sizes), np.repeat(value, sizes)
        key, value = row * other.n_cols + other.indices[at], value * other.data[at]
        if len(key) > 1 and (np.diff(key) < 0).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        key, value = key[new], np.add.reduceat(value, new) if len(new) else value
        row, column = np.divmod(key, max(1, other.n_cols))
        return Csr(np.searchsorted(row, np.arange(n_rows + 1)), column, value, other.n_cols)


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[Csr, Csr]:
    """Group incidences of both sides from the bytes that their tokens end at (the last one is that of the text)."""
    ends = np.zeros((2, int(a_ends[-1]) + 1), bool)
    ends[0, a_ends] = ends[1, b_ends] = True
    # The group of a byte is the number of groups that ended before it.
    before = np.concatenate([[0], np.cumsum(ends[0] & ends[1])])
    return tuple(Csr.of_labels(before[e], int(before[-1])) for e in (a_ends, b_ends))


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


#: Fixed value: how byte-level vocabularies of this kind cut texts before merging.
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Sides:
    """Both tokenizers, the bytes of every id, and how many they are."""

    def __init__(self, byte_bpe: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        whole = Tokenizer.from_file(byte_bpe)
        whole.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of, n = _byte_of(), range(self.b.get_piece_size())
        added = {t.content for t in whole.get_added_tokens_decoder().values()}
        a_bytes = {i: t.encode() if t in added else bytes(map(of.__getitem__, t)) for t, i in whole.get_vocab().items()}
        b_bytes = {i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("\u2581", " ").encode() for i in n}
        if max(b_bytes) >= BASE or max(a_bytes) * BASE >= 1 << 31:
            raise ValueError("vocabularies of at most 65536 and 32768 ids")
        self.a_len, self.b_len = (np.array([len(x.get(i, b"")) for i in range(max(x) + 1)]) for x in (a_bytes, b_bytes))
        # Tables by id.
        self.a_bytes, self.b_bytes = (np.array([x.get(i, b"") for i in range(max(x) + 1)], object) for x in (a_bytes, b_bytes))
        self.b_list = self.b_bytes.tolist()
        self.signs = [np.array([f"{sign}{i}" for i in range(max(len(self.a_len), len(self.b_len)))], object) for sign in ";|,"]
        self.ranked = self._ranked(byte_bpe, added)
        self.encode_a = self.ranked or (lambda s: np.array(whole.encode(s, add_special_tokens=False).ids, np.uint32))

    def _ranked(self, byte_bpe: str, added: set[str]):
        """A faster encoder of the same ids, where these are the order of merges and texts are cut as CUTS says; else None."""
        import tiktoken

        with open(byte_bpe, encoding="utf-8") as f:
            held = json.load(f)
        first, merges = held["pre_tokenizer"] or {}, held["model"]["merges"]
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        plain = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not held["normalizer"]
        if not plain or [held["model"]["vocab"].get(m) for m in made] != list(range(256, 256 + len(made))):
            return None
        ranks = {self.a_bytes[i]: i for t, i in held["model"]["vocab"].items() if t not in added}
        return tiktoken.Encoding(os.path.basename(byte_bpe), pat_str=CUTS, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text; None if it is empty or one of them does not give it back with a space in front."""
        if not text:
            return None
        whole = " " + text
        given, a, said = whole.encode(), self.encode_a(whole), self.b.encode(text)
        # The ranked encoder has all bytes among its tokens: it loses none.
        if b"".join(map(self.b_list.__getitem__, said)) != given or not self.ranked and b"".join(self.a_bytes[a].tolist()) != given:
            return None
        return a.astype(np.int64), np.array(said, np.int64)

    def align(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, bytes, str]]:
        """Of each text's ids: tokens of A, of B, groups, the links' codes in order, digest of the groups."""
        na, nb = (np.array([len(t[side]) for t in texts]) for side in (0, 1))
        ai, bi = (np.concatenate([t[side] for t in texts]) for side in (0, 1))
        ma, mb = Csr.of_spans(self.a_len[ai]), Csr.of_spans(self.b_len[bi])
        links = ma.times(mb.transposed())
        codes = (np.repeat(ai, np.diff(links.indptr)) * BASE + bi[links.indices]).astype("<i4").tobytes()
        in_a, in_b = groups_of(ma.indptr[1:] - 1, mb.indptr[1:] - 1)
        of_a, of_b = in_a.transposed().indptr, in_b.transposed().indptr
        # A group's tokens of A, then those of B, each with the sign before it.
        said = np.empty(len(ai) + len(bi), object)
        first_a, first_b = np.zeros(len(ai), bool), np.zeros(len(bi), bool)
        first_a[of_a[:-1]] = first_b[of_b[:-1]] = True
        said[np.arange(len(ai)) + of_b[in_a.indices]] = np.where(first_a, self.signs[0][ai], self.signs[2][ai])
        said[np.arange(len(bi)) + of_a[in_b.indices + 1]] = np.where(first_b, self.signs[1][bi], self.signs[2][bi])
        ends_a, ends = (np.concatenate([[0], np.cumsum(n)]) for n in (na, na + nb))
        ends_g, at = np.searchsorted(of_a, ends_a).tolist(), (4 * links.indptr[ends_a]).tolist()
        for k, (s, e) in enumerate(pairwise(ends.tolist())):
            groups = "".join(said[s:e].tolist())[1:]
            yield len(texts[k][0]), len(texts[k][1]), ends_g[k + 1] - ends_g[k], codes[at[k] : at[k + 1]], hashlib.sha256(groups.encode()).hexdigest()


def _sides(byte_bpe: str, pieces: str) -> Sides:
    return resident(("sides", byte_bpe, pieces), lambda: Sides(byte_bpe, pieces))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, links (binary: 32-bit codes A id * 32768 + B id, in order of the text), groups_sha256.

    The text with a space in front is encoded by the byte-level vocabulary, and the text by the piece
    vocabulary, which puts that space there; strings of special tokens are plain text. A null or empty
    text, and one that either vocabulary does not give back byte by byte, has no tokens: zeros, no links
    and the empty string for the digest. Repeated rows give repeated rows, an empty table none; null ids
    are kept; other columns, also those named like results, are ignored. Texts are aligned whole.
    """
    for path in (byte_bpe, pieces):
        if not os.path.exists(path):
            raise FileNotFoundError(path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_bpe, pieces)
        for batch in batches:
            start, waiting, room = 0, [], TOGETHER
            for i, text in enumerate(batch.column(1).to_pylist()):
                waiting.append(sides.encode(text))
                room -= len(text)
                if room > 0 and i + 1 < batch.num_rows:
                    continue
                some = [t for t in waiting if t]
                found = sides.align(some) if some else iter(())
                rows = [next(found) if t else (0, 0, 0, b"", "") for t in waiting]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), *columns], names=[id_col, "n_a", "n_b", "n_groups", "links", "groups_sha256"])
                start, waiting, room = i + 1, [], TOGETHER

    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, links binary, groups_sha256 string")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, n_links, best: how often each pair of ids is linked, and whether no pair of the same B id is linked more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, waiting, held = np.empty(0, np.int32), np.empty(0, np.int64), [], 0

        def merged():
            new, n = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in waiting] or [codes[:0]]), return_counts=True)
            every, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
            total = np.zeros(len(every), np.int64)
            np.add.at(total, place, np.concatenate([counts, n]))
            return every, total

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(counts)], names=["code", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x:
                    waiting.append(x)
                    held += len(x)
                if held > 1 << 24:
                    codes, counts = merged()
                    waiting, held = [], 0
                    if len(codes) > SUMMED:
                        yield sent()
                        codes, counts = codes[:0], counts[:0]
        codes, counts = merged()
        yield sent()

    summed = aligned.select("links").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n_links"))
    counts = summed.withColumn("b_id", F.col("code").bitwiseAND(BASE - 1))
    # A B id has at most as many pairs as there are A ids.
    top = counts.groupBy("b_id").agg(F.max("n_links").alias("most"))
    return counts.join(top, "b_id").select("code", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame, counts: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """aligned without links, with n_links, n_best (links whose pair is the most frequent of its B id) and count_sum (over links, of their pairs' counts).

    The counts of the most frequent pairs, at most most_pairs of them, go to all workers. Where there are more pairs, the rare ones
    are looked up by a join: each is in fewer links than the least frequent of the others, so no key is hot.
    """
    counts = saved(counts, "pair-counts")
    n_pairs, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_links"), F.lit(0))).first()
    # Not more than most_pairs pairs can have so many links.
    least = 0 if n_pairs <= most_pairs else total // most_pairs + 1
    frequent = counts.where(F.col("n_links") >= least).toArrow().combine_chunks().sort_by("code")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(frequent.column(i).to_numpy() for i in range(3)))
    names = [c for c in aligned.columns if c != "links"]
    fields = [aligned.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n_links, best = shared.value
        for batch in batches:
            out = []
            for x in batch.column(batch.schema.get_field_index("links")).to_pylist():
                own = np.frombuffer(x or b"", "<i4")
                at = np.minimum(np.searchsorted(codes, own), max(0, len(codes) - 1))
                hit = codes[at] == own if len(codes) else np.zeros(len(own), bool)
                at, rest = at[hit], own[~hit]
                out.append((len(own), int(best[at].sum()) if len(at) else 0, int(n_links[at].sum()) if len(at) else 0, rest.tolist()))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array([r[3] for r in out], pa.list_(pa.int32()))], names=[*names, "n_links", "n_best", "count_sum", "rest"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    scored = aligned.mapInArrow(run, f"{ddl}, n_links long, n_best long, count_sum long, rest array<int>")
    if not least:
        return scored.drop("rest")
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "link-scores")
    rare = counts.where(F.col("n_links") < least).withColumnRenamed("n_links", "n")
    found = scored.select("row", F.explode("rest").alias("code")).join(rare, "code")
    more = found.groupBy("row").agg(F.count_if("best").alias("more_best"), F.sum("n").alias("more_sum"))
    none = F.lit(0).cast("long")
    joined = scored.join(more, "row", "left")
    return joined.select(*names, "n_links", (F.col("n_best") + F.coalesce("more_best", none)).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", none)).alias("count_sum"))


def token_links(docs: DataFrame, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """One row per link: id, a_pos, b_pos (places of the tokens), a_id, b_id, weight.

    kind "overlap": tokens that share bytes, weight is their number; "group": tokens that share a group,
    weight 1. Texts without tokens (see align_documents) have no links. A document's links are made token
    by token of A and sent in parts, so that a group of many tokens needs no more memory than its tokens.
    """
    if kind not in ("overlap", "group"):
        raise ValueError("kind must be overlap or group")
    id_kind = docs.schema[id_col].dataType.simpleString()

    def rows_of(sides: Sides, text: str):
        found = sides.encode(text)
        if not found:
            return
        a, b = found
        ma, mb = Csr.of_spans(sides.a_len[a]), Csr.of_spans(sides.b_len[b])
        left, right = (ma, mb) if kind == "overlap" else groups_of(ma.indptr[1:] - 1, mb.indptr[1:] - 1)
        right = right.transposed()
        work = np.concatenate([[0], np.cumsum(np.add.reduceat(np.diff(right.indptr)[left.indices], left.indptr[:-1]))])
        cuts = [0]
        while cuts[-1] < len(a):  # rows of about 100,000 links, one row at least
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(work, work[cuts[-1]] + 100_000))))
        for s, e in pairwise([min(c, len(a)) for c in cuts]):
            at = left.indptr[s : e + 1]
            product = Csr(at - at[0], left.indices[at[0] : at[-1]], left.data[at[0] : at[-1]], left.n_cols).times(right)
            row = np.repeat(np.arange(s, e), np.diff(product.indptr))
            yield row, product.indices, a[row], b[product.indices], product.data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(byte_bpe, pieces)
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                for columns in rows_of(sides, text):
                    ids = batch.column(0).take(pa.array(np.full(len(columns[0]), i)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int64)) for c in columns)], names=[id_col, "a_pos", "b_pos", "a_id", "b_id", "weight"])

    rows = docs.select(F.col(id_col), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_kind}, a_pos long, b_pos long, a_id long, b_id long, weight long")


def tokenizer_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """One row per document: what align_documents says of it, and link_scores over the corpus."""
    aligned = saved(align_documents(docs, id_col, text_col, byte_bpe, pieces), "aligned")
    return link_scores(aligned, pair_counts(aligned))
