"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks the characters of a text once. Every position keeps its best predecessor; only
the window that pieces can still reach back into is held. Whenever the paths of all positions in
that window run through one boundary, the pieces up to it are committed and forgotten. Where the
vocabulary has no piece that spans a boundary (before a space mark, around line breaks), all paths
meet there whatever follows: the search commits there at once, and the ids of short stretches
between two such boundaries are remembered.

Unigram models rank paths by the sum of piece scores. In BPE models the scores are merge ranks,
and a path is admissible if merging each two neighbouring pieces anew gives just these two; every
prefix then has one admissible path, and it is the one that merging by rank ends with. The ids
are those of the sentencepiece library for the same file. Characters outside the vocabulary
become byte pieces.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.common import resident, text_of

SPACE = "▁"
#: Default place of the model file; a parameter of every operator here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches whose ids a worker remembers: so many of late, and so many from before.
MEMO = 200_000
#: Beginnings of these lengths whose pieces a worker remembers, and how many of them.
HEADS, N_HEADS = (8, 5), 100_000
#: Pairs of pieces that a worker remembers; it forgets them all when full.
PAIRS = 300_000


class Pieces:
    """A vocabulary: piece -> (id, score), byte pieces, and whether scores are merge ranks."""

    def __init__(self, scores: dict[str, tuple[int, float]], byte_ids: list[int], bpe: bool):
        self.scores, self.byte_ids, self.bpe = scores, byte_ids, bpe
        self.longest = max(map(len, scores), default=1)
        self.floor = min((s for _, s in scores.values()), default=0.0) - 10.0
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.heads: dict[str, tuple[str, ...]] = {}
        self.one = {p: p for p in scores}  # one object for all copies of a piece
        self.raw = Raw(self)
        # Lengths of the pieces that end with three characters, longest first; pieces of two are looked up themselves.
        ends: dict[str, set[int]] = {}
        for piece in scores:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.endings = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        # No piece holds a space mark after another character, or a line break: paths meet there.
        self.word = not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.line = not any("\n" in p for p in scores)
        self.bytes_of = [b""] * (1 + max([i for i, _ in scores.values()] + byte_ids, default=0))
        for p, (i, _) in scores.items():
            self.bytes_of[i] = p.encode()
        for b, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([b])

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        plain = [i for i in n if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = [i for i in n if sp.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the model needs the 256 byte pieces")
        # A merge rank is a whole negative number; unigram scores are logarithms.
        scores = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}
        return cls(scores, byte_ids, all(s == int(s) for _, s in scores.values()))

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging the best-ranked neighbours until none can be merged."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def adjoin(self, left: str, right: str) -> bool:
        """Whether the two pieces can stand side by side in a BPE encoding."""
        try:
            return self.pairs[left][right]
        except KeyError:
            if self.n_pairs >= PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            self.n_pairs += 1
            fits = self.merged(left + right) == [left, right]
            self.pairs.setdefault(left, {})[right] = fits
            return fits

    def ids_of(self, piece: str) -> list[int]:
        found = self.scores.get(piece)
        return [found[0]] if found else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]


class Raw(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, pieces: Pieces):
        self.of = pieces.ids_of

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PAIRS:
            self.clear()
        self[piece] = ids = np.array(self.of(piece), "<i4").tobytes()
        return ids


class StreamingViterbi:
    """Takes characters, gives pieces as soon as they are certain."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.text = ""
        self.score: list[float] = [0.0]
        self.last: list[str] = [""]  # the last piece of the best path to each position; at 0 the piece committed last

    def push(self, chars: str) -> list[str]:
        room = 3 * self.p.longest
        if not self.text and len(chars) < room:
            self.text = chars
            self.extend()
            return []
        out: list[str] = []
        while chars:
            part, chars = chars[: room - len(self.text)], chars[room - len(self.text) :]
            self.text += part
            self.extend()
            if len(self.text) >= room:
                done = self.commit()
                # Without a common boundary the window grows by one more piece length.
                room = 3 * self.p.longest if done else room + self.p.longest
                out += done
        return out

    def extend(self) -> None:
        """Finds the best path to every position that has none yet."""
        if self.p.bpe:
            self._extend_merges()
        else:
            self._extend_scores()

    def _extend_merges(self) -> None:
        """The longest admissible piece that ends at each position: every prefix has one admissible path."""
        text, last, adjoin = self.text, self.last, self.p.adjoin
        known, endings, pairs, none = self.p.scores, self.p.endings, self.p.pairs, ()
        one, heads = self.p.one, self.p.heads if last == [""] else None
        if heads is not None:  # words share their beginnings
            for n in HEADS:
                if n <= len(text) and (begun := heads.get(text[:n])):
                    last += begun
                    break
        for end in range(len(last), len(text) + 1):
            for n in endings.get(text[end - 3 : end], none) if end > 2 else none:
                if n <= end:
                    piece = text[end - n : end]
                    if piece in known:
                        before = last[end - n]
                        if not before:
                            break
                        try:
                            fits = pairs[before][piece]
                        except KeyError:
                            fits = adjoin(before, piece)
                        if fits:
                            break
            else:
                piece = text[end - 2 : end] if end > 1 else ""
                if piece not in known or last[end - 2] and not adjoin(last[end - 2], piece):
                    piece = text[end - 1 : end]
            last.append(one.get(piece, piece))
            if heads is not None and end in HEADS:
                if len(heads) >= N_HEADS:
                    heads.clear()
                heads[text[:end]] = tuple(last[1:])

    def _extend_scores(self) -> None:
        text, last, score, known, endings, none = self.text, self.last, self.score, self.p.scores, self.p.endings, ()
        for end in range(len(last), len(text) + 1):
            best = text[end - 1 : end]
            top = score[end - 1] + (known[best][1] if best in known else self.p.floor)
            for n in (*(endings.get(text[end - 3 : end], none) if end > 2 else none), 2):
                piece = text[end - n : end] if n <= end else ""
                if piece in known and (s := score[end - n] + known[piece][1]) >= top:
                    best, top = piece, s
            score.append(top)
            last.append(best)

    def path(self, at: int) -> list[str]:
        out, last = [], self.last
        while at:
            piece = last[at]
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def commit(self) -> list[str]:
        """The pieces up to the boundary that all surviving paths run through."""
        end = len(self.text)
        alive = set(range(max(0, end - self.p.longest + 1), end + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.discard(top)
            alive.add(top - len(self.last[top]))
        at = alive.pop()
        out = self.path(at)
        if out:
            self.text, self.last, self.score = self.text[at:], [out[-1], *self.last[at + 1 :]], self.score[at:]
        return out

    def finish(self) -> list[str]:
        out = self.path(len(self.text))
        self.text, self.score, self.last = "", [0.0], [""]
        return out


class Encoder(dict):
    """Text -> ids. Remembers segments between boundaries where all paths are known to meet."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.before: dict[str, bytes] = {}
        self.search = StreamingViterbi(pieces)
        line, stop = ("\n+|", "\n") if pieces.line else ("", "")
        self.cut = re.compile(f"{line}{SPACE}+[^{SPACE}{stop}]*|[^{SPACE}{stop}]+", re.S) if pieces.word else None

    def __missing__(self, segment: str) -> bytes:
        ids = self.before.get(segment)
        if ids is None:
            found = self.search.push(segment) + self.search.finish()
            ids = b"".join([self.p.raw[piece] for piece in found])
        if len(segment) <= 64:
            if len(self) >= MEMO:
                self.before = dict(self)
                self.clear()
            self[segment] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        text = SPACE + text.replace(" ", SPACE)
        segments = self.cut.findall(text) if self.cut else [text]
        return np.frombuffer(b"".join(map(self.__getitem__, segments)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.p.bytes_of.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def encoder(path: str) -> Encoder:
    """The worker's encoder for a model file."""
    return resident(("pieces", path), lambda: Encoder(Pieces.load(path)))


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: id, n_tokens, ids (array of int), roundtrip.

    roundtrip tells whether decoding gives the text again; it is false only for texts that hold
    the vocabulary's space mark U+2581 itself. A null or empty text has no ids. Repeated rows give
    repeated rows, an empty table none; other columns, also those named like results, are ignored.
    Texts of any length are encoded whole. The file must lie at `model` on every machine.
    """
    if not os.path.exists(model):
        raise FileNotFoundError(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                gc.disable()  # nothing here is cyclic, and the collector would walk all that is remembered
                found = [enc.encode(t) for t in texts]
                same = [enc.decode(i) == t for i, t in zip(found, texts, strict=True)]
                gc.enable()
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                flat = pa.array(np.concatenate(found) if found else np.empty(0, "<i4"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(same, pa.bool_())],
                    names=[id_col, "n_tokens", "ids", "roundtrip"],
                )

    return docs.select(F.col(id_col), text_of(text_col).alias("text")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids array<int>, roundtrip boolean"
    )


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per row: id, text. Null ids give an empty text; an id outside the vocabulary fails.

    Rows of any length are decoded whole, repeated rows each for itself, an empty table to none. Other
    columns, also one named text, are ignored.
    """
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            texts = [enc.decode(np.array(i or [], "<i4")) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
