"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a Viterbi pass.

The automaton reports, for every position, all pieces that end there (it follows the output links), and each
relaxes the best score of the position behind it; the segmentation of highest total score wins, as in a unigram
model with the file's scores.  A character without a piece costs ten less than the least score and becomes the
bytes of its UTF-8 form.  No piece of such a vocabulary spans a word's start, a line feed or a literal U+2581, so
the pass runs word by word, and words met before are taken from a bounded memory of the task.

The model is read by the driver from a path that is a parameter, and sent to the tasks (half a megabyte).

Defined cases: NULL is the empty text, which has no ids; decoding gives back every text exactly, also those with
U+2581, which is written as bytes.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession, functions as F

MARK = "▁"
REMEMBERED = 600_000


class PieceModel:
    """Vocabulary, automaton and remembered words of one model file."""

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        from sentencepiece import SentencePieceProcessor

        reader = SentencePieceProcessor(model_proto=model)
        size = reader.get_piece_size()
        normal = [i for i in range(size) if not (reader.is_unknown(i) or reader.is_control(i) or reader.is_byte(i) or reader.is_unused(i))]
        names = {i: reader.id_to_piece(i) for i in normal}
        scores = {i: reader.get_score(i) for i in normal}
        self.fallback = min(scores.values()) - 10.0
        self.bytes = {}
        self.raw = [b""] * size
        for i in range(size):
            if reader.is_byte(i):
                value = int(reader.id_to_piece(i)[1:-1], 16)
                self.bytes[value], self.raw[i] = i, bytes([value])
        if len(self.bytes) != 256:
            raise ValueError("the model needs a piece for every byte")
        self.automaton = ahocorasick.Automaton()
        for i, name in names.items():
            if "\n" in name or MARK in name.lstrip(MARK):
                raise ValueError("a piece spans a word start or a line feed")
            self.automaton.add_word(name, (len(name), scores[i], i))
            self.raw[i] = name.replace(MARK, " ").encode()
        self.automaton.make_automaton()
        self.single = {name for name in names.values() if len(name) == 1}
        self.starts = _Words(self, MARK, remembered)
        self.others = _Words(self, "", remembered)
        self.apart = {c: self.pack(self.byte_ids(c)) for c in ("\n", MARK)}

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<i4").tobytes()

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def best(self, word: str) -> list[int]:
        """Ids of the best segmentation of ``word``; white space is already written as U+2581."""
        n = len(word)
        if not n:
            return []
        least = float("-inf")
        score = [least] * (n + 1)
        score[0] = 0.0
        came = [(0, -1)] * (n + 1)
        known, done, fallback = self.single, 0, self.fallback
        plain = known.issuperset(word)  # every character is a piece, so none falls back to bytes

        def fall_back(upto: int) -> None:
            for at in range(done, upto):
                if word[at] not in known and score[at] + fallback > score[at + 1]:
                    score[at + 1] = score[at] + fallback
                    came[at + 1] = (at, -1)

        for end, (length, gain, piece) in self.automaton.iter(word):
            end += 1
            if done < end and not plain:
                fall_back(end)
                done = end
            start = end - length
            total = score[start] + gain
            if total > score[end]:
                score[end] = total
                came[end] = (start, piece)
        if not plain:
            fall_back(n)
        out, at = [], n
        while at:
            start, piece = came[at]
            out.extend([piece] if piece >= 0 else reversed(self.byte_ids(word[start])))
            at = start
        return out[::-1]

    def _line(self, line: str) -> bytes:
        if "  " in line or line.endswith(" "):
            return b"".join(self.others[w.replace(" ", MARK)] for w in re.findall(" +[^ ]*|[^ ]+", line))
        head, *tail = line.split(" ")
        return self.others[head] + b"".join(map(self.starts.__getitem__, tail))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        parts = re.split(f"([\n{MARK}])", f" {text}")
        return b"".join(self.apart[p] if i % 2 else self._line(p) for i, p in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "replace")


class _Words(dict):
    """Packed ids by word; emptied when full."""

    def __init__(self, model: PieceModel, prefix: str, room: int):
        super().__init__()
        self.model, self.prefix, self.room = model, prefix, room

    def __missing__(self, word: str) -> bytes:
        packed = self.model.pack(self.model.best(self.prefix + word))
        if len(word) <= 64:
            if len(self) >= self.room:
                self.clear()
            self[word] = packed
        return packed


_LOADED: dict[int, PieceModel] = {}


def _model(sent: Broadcast) -> PieceModel:
    key = hash(sent.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceModel(sent.value)
    return _LOADED[key]


def _lists(packed: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))


class PieceCodec:
    """Columns that encode texts and decode ids with the model at ``path``.

    ``encode_checked`` does both in one worker, so that a task needs one copy of the automaton and no decoded text
    travels back.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            sent = spark.sparkContext.broadcast(file.read())

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            model = _model(sent)
            return _lists([model.encode(t.as_py()) for t in texts])

        @F.arrow_udf("string")
        def decode(ids: pa.Array) -> pa.Array:
            model = _model(sent)
            flat, offsets = ids.flatten().to_numpy(), ids.offsets.to_pylist()
            base = offsets[0]  # only one document's ids become Python numbers at a time
            return pa.array([model.decode(flat[a - base:b - base].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string())

        @F.arrow_udf("ids array<int>, round_trip boolean")
        def encode_checked(texts: pa.Array) -> pa.Array:
            model = _model(sent)
            packed, same = [], []
            for value in texts:  # one document's ids and decoded text at a time
                text = value.as_py() or ""
                packed.append(model.encode(text))
                same.append(model.decode(np.frombuffer(packed[-1], dtype="<i4").tolist()) == text)
            return pa.StructArray.from_arrays([_lists(packed), pa.array(same, pa.bool_())], names=["ids", "round_trip"])

        self._encode, self._decode, self._encode_checked = encode, decode, encode_checked

    def encode(self, text: Column | str) -> Column:
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        return self._decode(ids)

    def encode_checked(self, text: Column | str) -> Column:
        """Struct of the ids and whether decoding them gives the text back."""
        return self._encode_checked(text)
