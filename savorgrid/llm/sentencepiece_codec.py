"""SentencePiece encoding and decoding: Viterbi driven by an Aho-Corasick automaton (operator 4)."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

MARK = "▁"  # a space, in pieces
CACHE = 400_000  # units remembered by a task
UNREACHED = float("-inf")
SPELLED = (1, -1, 0.0)  # a step over one character by its bytes
_CODECS: dict[str, Codec] = {}


class UnitCache(dict):
    """Encoded units by their text; a new one is encoded when it is first asked for."""

    def __init__(self, viterbi: Callable[[str], list[int]]):
        super().__init__()
        self.viterbi = viterbi

    def __missing__(self, unit: str) -> bytes:
        self[unit] = ids = array("i", self.viterbi(unit)).tobytes()
        return ids


class Codec:
    """Pieces and scores of a model file. ``encode`` finds the pieces of greatest total score.

    The text gets a space before it, as the model's dummy prefix; every space is a mark. Characters no piece
    covers become the pieces of their UTF-8 bytes, each scored ``penalty`` below the lowest piece. Ties go
    to the longer last piece. ``decode`` gives the text back exactly: a mark that stands in the text itself
    is no space and is spelled in bytes.
    """

    def __init__(self, path: str, penalty: float = 10.0):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = [0] * 256
        self.pieces: list[str | bytes] = [b""] * n
        scores: dict[str, tuple[int, int, float]] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.pieces[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace(MARK, " ")
                self.pieces[i] = text
                scores[text] = (len(text), i, model.get_score(i))
        self.automaton = ahocorasick.Automaton()
        for text, value in scores.items():
            self.automaton.add_word(text, value)
        self.automaton.make_automaton()
        self.lowest = min((s for _, _, s in scores.values()), default=0.0) - penalty
        # no piece goes on after a space that follows another character, nor over a line break: units are apart
        apart = not any(re.search(r"[^ ] |\n.|.\n", t, re.S) for t in scores)
        self.units = re.compile(r"\n| *[^ \n]+| +" if apart else r"(?s).+")
        self.raw = [p if isinstance(p, bytes) else p.encode() for p in self.pieces]
        self.single = {t for t in scores if len(t) == 1}
        self.cache = UnitCache(self.viterbi)

    def viterbi(self, text: str) -> list[int]:
        """One pass: the automaton reports, for each end position, every piece that ends there, the longest
        first (its output links), and each relaxes the best score of that position."""
        n = len(text)
        best = [0.0] + [UNREACHED] * n
        back: list[tuple[int, int, float]] = [SPELLED] * (n + 1)
        if self.single.issuperset(text):  # bytes never beat a character's own piece
            for end, value in self.automaton.iter(text):
                end += 1
                total = best[end - value[0]] + value[2]
                if total > best[end]:
                    best[end], back[end] = total, value
        else:
            done = 0  # positions up to here are final
            for end, value in self.automaton.iter(text):
                if end > done:
                    self._bridge(text, best, back, done, end)
                    done = end
                end += 1
                total = best[end - value[0]] + value[2]
                if total > best[end]:
                    best[end], back[end] = total, value
            self._bridge(text, best, back, done, n)
        ids: list[int] = []
        while n:
            size, piece, _ = back[n]
            if piece < 0:
                ids += [self.byte_ids[b] for b in reversed(text[n - 1].encode())]
            else:
                ids.append(piece)
            n -= size
        ids.reverse()
        return ids

    def _bridge(self, text: str, best: list[float], back: list[tuple[int, int, float]], done: int, upto: int) -> None:
        """Positions after ``done`` that no piece reaches, or only a worse one, are reached by bytes."""
        for end in range(done + 1, upto + 1):
            spelled = best[end - 1] + self.lowest * len(text[end - 1].encode())
            if spelled > best[end]:
                best[end], back[end] = spelled, SPELLED

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        if len(self.cache) > CACHE:
            self.cache.clear()
        return np.frombuffer(b"".join(map(self.cache.__getitem__, self.units.findall(" " + text))), dtype=np.int32)

    def decode(self, ids) -> str:
        """Ids outside the model and control pieces spell nothing; bytes that form no character are replaced."""
        raw, n = self.raw, len(self.raw)
        out = b"".join([raw[i] for i in ids if 0 <= i < n])
        return out[out[:1] == b" " :].decode("utf-8", errors="replace")


def codec(path: str) -> Codec:
    """The model of a task's process, loaded once."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """The rows with ``ids`` (array<int>). A null text gives null, an empty one an empty array. Repeated rows
    are encoded each; a clashing column is replaced. ``carry``: columns to bring along, all by default."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != ids_col]
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = [None if t is None else own.encode(t) for t in part.column(width).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(ids, pa.list_(pa.int32()))], names=[*carry, ids_col])

    picked = docs.select(*carry, F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, StructType([*docs.select(*carry).schema.fields, StructField(ids_col, ArrayType(IntegerType()))]))


def decode(docs: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text their ids spell; null ids give null. A clashing column is replaced."""
    carry = [c for c in docs.columns if c != text_col]
    width = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            column = batch.column(width)
            texts = [None if not column[i].is_valid else own.decode(column[i].values.to_pylist()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string())], names=[*carry, text_col])

    picked = docs.select(*carry, F.col(ids_col).alias("__ids"))
    return picked.mapInArrow(run, StructType([*docs.select(*carry).schema.fields, StructField(text_col, StringType())]))
