"""Cross-tokenizer alignment: two tokenizers' pieces of one text, cut where both end, with corpus-wide pair counts.

First pass: every text is encoded by both tokenizers and the ids are kept in the shared folder.  A and B tokens are
linked where their byte ranges overlap; each link is one stretch between two neighbouring ends of either tokenizer.
Tasks count in how many documents each linked id pair occurs.  The different pairs, dealt to ``SHARDS`` shards, get a
minimal perfect hash (levels of bit arrays: a key takes the first level where its bit is its own; the place of a key is
the number of bits set before its bit).  Task counts are scattered into dense vectors indexed by that hash, which are
summed as a tree: chunks of vectors by salted groups, then by chunk.  Second pass: documents are aligned again from
their ids, each pair's place is looked up, the key stored there is verified, and the counts are summed.

Hash, keys and counts are broadcast only up to ``MAX_PAIRS`` pairs (24 bytes each); beyond that the pairs of each
document are joined with the counts by a salted shuffle instead, with the same result.

Defined cases: NULL and empty texts, and texts whose joined token bytes are not the text behind one space (such as a
literal U+2581), have no tokens: zeros and an empty ``groups_sha256``.  Repeated rows, also with equal or NULL ids, count
as documents each and are returned each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_folder

MAX_PAIRS = 8_000_000
SHARDS = 256
CHUNK = 4096
SALTS = 8
HELD = 1_000_000
STRETCH = 400_000
ID_BITS = 24
# fixed values: how byte-level vocabularies write bytes as characters, how they split texts, the mark of a space
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MARK = "▁"
#: Runs of so many characters go to the tokenizer whose merges are not quadratic.
LONG_RUN = re.compile(r"\S{1500}|\s{1500}")


def byte_characters() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable bytes are themselves, others follow from U+0100."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Ids and token bytes of a byte-level BPE file (tokenizers' JSON)."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(content)
        self.slow.encode_special_tokens = True
        vocab = self.slow.get_vocab(with_added_tokens=True)
        plain = self.slow.get_vocab(with_added_tokens=False)
        chars = byte_characters()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = i == plain.get(token) and all(c in chars for c in token)
            self.bytes[i] = bytes(chars[c] for c in token) if known else token.encode()
        self.fast = self._ranked(json.loads(content), plain)

    def _ranked(self, parts: dict, plain: dict[str, int]):
        """The same encoding by ranks, or None where ids are not in merge order or the file asks for more than merges."""
        import tiktoken

        model, special = parts["model"], {t["id"] for t in parts.get("added_tokens", [])}
        pre = parts.get("pre_tokenizer") or {}
        simple = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and parts.get("normalizer") is None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merged = [plain.get(a + b, -1) for a, b in pairs]
        if not simple or model.get("dropout") or merged != sorted(set(merged)) or (merged and merged[0] < 256):
            return None
        ranks = {self.bytes[i]: i for i in plain.values() if i not in special}
        if len(ranks) != len(merged) + 256:
            return None
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or LONG_RUN.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.int32)


class PieceBpe:
    """Ids and token bytes of a SentencePiece model; the model itself adds the space before the text."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.reader = SentencePieceProcessor(model_proto=content)
        names = [self.reader.id_to_piece(i) for i in range(self.reader.get_piece_size())]
        self.bytes = [
            bytes([int(n[3:5], 16)]) if self.reader.is_byte(i) else b"" if self.reader.is_control(i) else n.replace(MARK, " ").encode()
            for i, n in enumerate(names)
        ]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.reader.encode(text, num_threads=1), dtype=np.int32)


class Pair:
    """Both tokenizers of a task."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteBpe(a.decode()), PieceBpe(b)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both tokenizers, none where either does not give back the text behind one space."""
        if text:
            whole = f" {text}".encode()
            a = self.a.encode(f" {text}")
            b = self.b.encode(text)
            if all(b"".join(map(t.bytes.__getitem__, ids.tolist())) == whole for t, ids in ((self.a, a), (self.b, b))):
                return a, b
        return np.empty(0, np.int32), np.empty(0, np.int32)


_LOADED: dict[str, Pair] = {}


def _once(key: str, sent) -> Pair:
    """The tokenizers of a broadcast pair of files, made once by a worker."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(*sent.value)
    return _LOADED[key]


def ids_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids of all documents behind each other, and their bounds."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]].view(kind).astype(np.int64), (offsets - offsets[0]) // kind.itemsize


def slices(batch: pa.RecordBatch, column: int, most: int = STRETCH):
    """Parts of a batch whose values of a packed column hold about ``most`` bytes; a longer document is a part alone."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], dtype=np.int32)[batch.column(column).offset :][: batch.num_rows + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


# ---------------------------------------------------------------- alignment of a batch


class Links:
    """The links of a batch of documents, from the ids and byte lengths of both tokenizers.

    Documents are laid one behind the other, so an end of a document is an end of both tokenizers.
    """

    def __init__(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], a_bytes: np.ndarray, b_bytes: np.ndarray):
        (self.a, self.a_bounds), (self.b, self.b_bounds) = a, b
        self.docs = len(self.a_bounds) - 1
        self.a_end, self.b_end = np.cumsum(a_bytes[self.a]), np.cumsum(b_bytes[self.b])
        ends = np.concatenate([self.a_end, self.b_end])
        ends.sort(kind="stable")  # two ordered runs
        first = np.ones(len(ends), dtype=bool)
        first[1:] = ends[1:] != ends[:-1]
        self.common = ends[np.flatnonzero(~first)]
        ends = ends[first]
        self.at_a, self.at_b = np.searchsorted(self.a_end, ends), np.searchsorted(self.b_end, ends)
        self.pair = self.a[self.at_a] << ID_BITS | self.b[self.at_b]
        self.doc = np.searchsorted(self.a_bounds, self.at_a, side="right") - 1

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.docs).astype(np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, pairs and occurrences, each pair once a document."""
        pairs, code = np.unique(self.pair, return_inverse=True)
        keys, times = np.unique(self.doc * max(1, len(pairs)) + code, return_counts=True)
        return keys // max(1, len(pairs)), pairs[keys % max(1, len(pairs))], times

    def groups(self, a_words: list[bytes], b_words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Number of groups and digest of their written form, by document."""
        a_group, b_group = np.searchsorted(self.common, self.a_end), np.searchsorted(self.common, self.b_end)
        a_upto = np.searchsorted(self.a_end, self.common, side="right")
        b_upto = np.searchsorted(self.b_end, self.common, side="right")
        # a group's A tokens stand behind all B tokens of the groups before, its B tokens behind its own A tokens
        a_last, b_last = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        a_last[a_upto - 1] = True
        b_last[b_upto - 1] = True
        items = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        items[np.arange(len(self.a)) + np.concatenate([[0], b_upto])[a_group]] = self.a + a_last * len(a_words)
        items[np.arange(len(self.b)) + a_upto[b_group]] = 2 * len(a_words) + self.b + b_last * len(b_words)
        words = [w + b"," for w in a_words] + [w + b"|" for w in a_words] + [w + b"," for w in b_words] + [w + b";" for w in b_words]
        bounds = self.a_bounds + self.b_bounds
        digests = []
        for x, y in zip(bounds, bounds[1:]):
            text = b"".join(map(words.__getitem__, items[x:y].tolist()))[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if x < y else "")
        group_doc = np.searchsorted(self.a_bounds, a_upto - 1, side="right") - 1
        return np.bincount(group_doc, minlength=self.docs), digests


# ---------------------------------------------------------------- minimal perfect hash


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well mixed bits of each key, different at every level."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shard_of(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, -1) % np.uint64(SHARDS)).astype(np.int64)


def build_shard(keys: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Words of the level bit arrays of different keys, bits of each level, and the keys in the order of their bits."""
    words, sizes, ordered = [], [], []
    while len(keys):
        size = -(-2 * len(keys) // 64) * 64
        bit = (_mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        times = np.bincount(bit, minlength=size)
        own = times[bit] == 1
        words.append(np.packbits(times == 1, bitorder="little").view(np.uint64))
        sizes.append(size)
        ordered.append(keys[own][np.argsort(bit[own])])
        keys = keys[~own]
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return join(words, np.uint64), sizes, join(ordered, np.int64)


class PairHash:
    """Minimal perfect hash of all pairs from its shards, with the keys in hash order to verify a place."""

    def __init__(self, shards: list[tuple[int, bytes, list[int], bytes]]):
        shards = sorted(shards)
        levels = max((len(s[2]) for s in shards), default=0)
        self.size = np.ones((SHARDS, levels), dtype=np.uint64)
        self.base = np.full((SHARDS, levels), -1, dtype=np.int64)
        at = 0
        for shard, _, sizes, _ in shards:
            for level, size in enumerate(sizes):
                self.size[shard, level], self.base[shard, level] = size, at
                at += size
        self.words = np.frombuffer(b"".join(s[1] for s in shards), dtype=np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])
        self.keys = np.frombuffer(b"".join(s[3] for s in shards), dtype=np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; a key that was not hashed is an error."""
        out = np.full(len(keys), -1, dtype=np.int64)
        shard, left = shard_of(keys), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            if not len(left):
                break
            size, base = self.size[shard[left], level], self.base[shard[left], level]
            left, size, base = left[base >= 0], size[base >= 0], base[base >= 0]
            bit = base + (_mixed(keys[left], level) % size).astype(np.int64)
            word, inside = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> inside & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << inside) - np.uint64(1)))
            out[left[hit]] = (self.before[bit >> 6] + below)[hit]
            left = left[~hit]
        if len(left) or (out < 0).any() or (self.keys[out] != keys).any():
            raise ValueError("a pair is not among the hashed pairs")
        return out


# ---------------------------------------------------------------- jobs


class Aligner:
    """Alignment by the tokenizer files at two paths, which the driver reads and sends to the tasks."""

    def __init__(self, spark: SparkSession, byte_bpe: str, piece_bpe: str):
        with open(byte_bpe, "rb") as a, open(piece_bpe, "rb") as b:
            files = a.read(), b.read()
        self.spark, self.sent = spark, spark.sparkContext.broadcast(files)
        pair = Pair(*files)
        if max(len(pair.a.bytes), len(pair.b.bytes)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids")
        self.lengths = tuple(np.array([len(t) for t in side.bytes], dtype=np.int64) for side in (pair.a, pair.b))
        self.kinds = tuple(np.dtype(np.uint16 if len(n) <= 1 << 16 else np.uint32) for n in self.lengths)
        self.folder = f"{checkpoint_folder(spark).rstrip('/')}/alignment-{uuid.uuid4().hex}"

    def _links(self):
        """The links of a part of a batch, from its columns of packed ids."""
        lengths, kinds = self.lengths, self.kinds
        return lambda a, b: Links(ids_of(a, kinds[0]), ids_of(b, kinds[1]), *lengths)

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def encoded(self, docs: DataFrame) -> DataFrame:
        """``row, doc_id, a, b``: packed ids of both tokenizers, empty where a text has no tokens."""
        sent, key, kinds = self.sent, self.folder, self.kinds

        def encode(batches):
            pair = _once(key, sent)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    both = [pair.encode(t.as_py()) for t in part.column(1)]
                    packed = [pa.array([ids[side].astype(kinds[side]).tobytes() for ids in both], pa.binary()) for side in (0, 1)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *packed], ["doc_id", "a", "b"])

        kind = dict(docs.dtypes)["doc_id"]
        ids = docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, a binary, b binary")
        return self._kept(ids.withColumn("row", F.monotonically_increasing_id()), "tokens")

    def task_counts(self, tokens: DataFrame) -> DataFrame:
        """``pair, docs``: documents with each pair, counted by task (a task may give a pair more than once)."""
        linked = self._links()

        def count(batches):
            held, waiting = [], 0

            def flush():
                keys, code = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                docs = np.bincount(code, weights=np.concatenate([n for _, n in held])).astype(np.int64)
                return keys, docs

            def written(keys, docs):
                for at in range(0, len(keys), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000]), pa.array(docs[at : at + 50_000])], ["pair", "docs"])

            for batch in (part for whole in batches for part in slices(whole, 0)):
                _, pairs, _ = linked(batch.column(0), batch.column(1)).distinct()
                held.append(np.unique(pairs, return_counts=True))
                waiting += len(held[-1][0])
                if waiting > HELD:
                    keys, docs = flush()
                    held, waiting = [(keys, docs)], len(keys)
                    if waiting > HELD // 2:  # a task holds a bounded number of pairs
                        yield from written(keys, docs)
                        held, waiting = [], 0
            if held:
                yield from written(*flush())

        return self._kept(tokens.select("a", "b").mapInArrow(count, "pair long, docs long"), "counts")

    def hashed(self, counts: DataFrame) -> PairHash:
        """The minimal perfect hash of the pairs; shards are built in tasks."""

        def build(shard):
            words, sizes, ordered = build_shard(np.sort(shard.column("pair").to_numpy()))
            return pa.table({
                "shard": shard.column("shard").slice(0, 1), "words": [words.tobytes()], "sizes": [sizes], "keys": [ordered.tobytes()],
            })

        def dealt(batches):
            for batch in batches:
                keys = batch.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(keys)), batch.column(0)], ["shard", "pair"])

        pairs = counts.select("pair").distinct().mapInArrow(dealt, "shard long, pair long")
        shards = pairs.groupBy("shard").applyInArrow(build, "shard long, words binary, sizes array<long>, keys binary").collect()
        return PairHash([(r.shard, bytes(r.words), list(r.sizes), bytes(r.keys)) for r in shards])

    def counted(self, counts: DataFrame, pair_hash: PairHash) -> np.ndarray:
        """Documents of every pair by its place: dense vectors of the tasks, summed in chunks as a tree."""
        sent = self.spark.sparkContext.broadcast(pair_hash)
        size = len(pair_hash.keys)
        schema = "chunk long, salt int, docs binary"

        def vectors(batches):
            total, used = np.zeros(-(-size // CHUNK) * CHUNK, dtype=np.int64), False
            for batch in batches:
                place = sent.value.places(batch.column(0).to_numpy())
                np.add.at(total, place, batch.column(1).to_numpy())
                used = used or len(place) > 0
            yield from _chunks({c: total[c * CHUNK : (c + 1) * CHUNK] for c in range(len(total) // CHUNK)} if used else {})

        def summed(batches):
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(2)):
                    part = np.frombuffer(docs.as_buffer(), dtype=np.int64)
                    held[chunk] = held[chunk] + part if chunk in held else part.copy()
            yield from _chunks(held)

        parts = counts.mapInArrow(vectors, schema).withColumn("salt", (F.spark_partition_id() % SALTS).cast("int"))
        halfway = parts.repartition("chunk", "salt").mapInArrow(summed, schema)
        rows = halfway.repartition("chunk").mapInArrow(summed, schema).collect()
        out = np.zeros(-(-size // CHUNK) * CHUNK, dtype=np.int64)
        for r in rows:
            out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.docs), dtype=np.int64)
        return out[:size]

    def report(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
        tokens = self.encoded(docs)
        counts = self.task_counts(tokens)
        if counts.select("pair").distinct().count() <= MAX_PAIRS:
            pair_hash = self.hashed(counts)
            table = self.spark.sparkContext.broadcast((pair_hash, self.counted(counts, pair_hash)))
            return self._aligned(tokens, table).drop("row")
        return self._joined(tokens, counts)

    def _aligned(self, tokens: DataFrame, table=None) -> DataFrame:
        """Documents aligned again; ``n_best`` and ``count_sum`` come from the hashed counts, if given."""
        lengths, linked = self.lengths, self._links()
        kind = dict(tokens.dtypes)["doc_id"]
        schema = (f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

        def align(batches):
            a_words, b_words = ([b"%d" % i for i in range(len(n))] for n in lengths)
            if table is not None:
                pair_hash, docs = table.value
                best = np.zeros(len(lengths[0]), dtype=np.int64)
                np.maximum.at(best, pair_hash.keys >> ID_BITS, docs)
            for whole in batches:
                for batch in slices(whole, 2):
                    links = linked(batch.column(2), batch.column(3))
                    n_groups, digests = links.groups(a_words, b_words)
                    n_best = count_sum = np.zeros(batch.num_rows, dtype=np.int64)
                    if table is not None:
                        pairs, code = np.unique(links.pair, return_inverse=True)
                        held = docs[pair_hash.places(pairs)]
                        top = held == best[pairs >> ID_BITS]
                        n_best = links.per_doc(top[code])
                        count_sum = np.zeros(batch.num_rows, dtype=np.int64)
                        np.add.at(count_sum, links.doc, held[code])
                    columns = [np.diff(links.a_bounds), np.diff(links.b_bounds), n_groups, links.per_doc(np.ones(len(links.doc))), n_best, count_sum]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns), pa.array(digests, pa.string())],
                        ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        return tokens.select("row", "doc_id", "a", "b").mapInArrow(align, schema)

    def _joined(self, tokens: DataFrame, counts: DataFrame) -> DataFrame:
        """The same report with counts joined by pair; a pair that most documents hold is spread over salts."""
        linked = self._links()

        def pairs_of(batches):
            for whole in batches:
                for batch in slices(whole, 1):
                    doc, pairs, times = linked(batch.column(1), batch.column(2)).distinct()
                    rows = batch.column(0).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([rows, pa.array(pairs), pa.array(times, pa.int64())], ["row", "pair", "times"])

        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        docs = counts.groupBy("pair").agg(F.sum("docs").alias("docs")).withColumn("a_id", F.shiftright("pair", ID_BITS))
        best = docs.groupBy("a_id").agg(F.max("docs").alias("best"))  # a row per id of the vocabulary
        docs = docs.join(best, "a_id").select("pair", "docs", (F.col("docs") == F.col("best")).alias("top"), salts.alias("salt"))
        held = tokens.select("row", "a", "b").mapInArrow(pairs_of, "row long, pair long, times long")
        held = held.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(docs, ["pair", "salt"])
        sums = held.groupBy("row").agg(
            F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("docs")).alias("_sum"))
        out = self._aligned(tokens).drop("n_best", "count_sum").join(sums, "row", "left")
        return out.select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("_best", F.lit(0)).alias("n_best"), F.coalesce("_sum", F.lit(0)).alias("count_sum"),
            "groups_sha256")


def _chunks(held: dict[int, np.ndarray]):
    for chunk, docs in sorted(held.items()):
        if docs.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([0], pa.int32()), pa.array([docs.tobytes()], pa.binary())], ["chunk", "salt", "docs"])
