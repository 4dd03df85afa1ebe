"""Alignment of two tokenizers against a plain double loop over tokens, the hash against its definition."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.conftest import SMALL
from varibreak.llm import alignment
from varibreak.llm.queries import BYTE_BPE, PIECES


def brute(texts):
    """The report of a list of texts (docs by place) by loops over tokens."""
    a_model, b_model = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    chars = alignment.byte_characters()
    links, groups, sizes = [], [], []
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(chars[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            a, b, a_bytes, b_bytes = [], [], [], []
        a_range, b_range = [], []
        for parts, out in ((a_bytes, a_range), (b_bytes, b_range)):
            at = 0
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
        found = []
        low = 0
        for i, (s, e) in enumerate(a_range):
            while low < len(b) and b_range[low][1] <= s:
                low += 1
            j = low
            while j < len(b) and b_range[j][0] < e:
                found.append((a[i], b[j]))
                j += 1
        cuts = sorted({e for _, e in a_range} & {e for _, e in b_range})
        written, i, j = [], 0, 0
        for cut in cuts:
            n, m = i, j
            while n < len(a) and a_range[n][1] <= cut:
                n += 1
            while m < len(b) and b_range[m][1] <= cut:
                m += 1
            written.append(f"{','.join(map(str, a[i:n]))}|{','.join(map(str, b[j:m]))}")
            i, j = n, m
        links.append(found)
        groups.append(hashlib.sha256(";".join(written).encode()).hexdigest() if cuts else "")
        sizes.append((len(a), len(b), len(cuts)))
    held = Counter(p for found in links for p in set(found))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(*size, len(f), sum(held[p] == best[p[0]] for p in f), sum(held[p] for p in f), g) for size, f, g in zip(sizes, links, groups)]


EXTRA = [None, "", " ", "  two", "a▁b", "<|endoftext|> <s> </s>", "é́ 日本 \U0001f600", "tab\tand\r\nline", "x" * 5000, " " * 3000 + "end", "word " * 3, "word " * 3, "\x00nul", "ﬁ ½"]


@pytest.mark.parametrize("most", [alignment.MAX_PAIRS, 10])
def test_report_matches_loops(spark, monkeypatch, most):
    """Both with hashed counts and, past the size check, with joined counts."""
    monkeypatch.setattr(alignment, "MAX_PAIRS", most)
    monkeypatch.setattr(alignment, "CHUNK", 64)
    monkeypatch.setattr(alignment, "STRETCH", 900)
    monkeypatch.setattr(alignment, "HELD", 500)
    texts = EXTRA + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy(F.length("text")).limit(120).collect()]
    ids = [i if i % 7 else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in zip(ids, texts)], "doc_id long, text string, PAIR int, Row string").repartition(3)
    rows = alignment.Aligner(spark, BYTE_BPE, PIECES).report(docs).collect()
    want = brute(texts)
    order = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted(map(tuple, rows), key=order) == sorted(((i, *w) for i, w in zip(ids, want)), key=order)
    empty = alignment.Aligner(spark, BYTE_BPE, PIECES).report(docs.limit(0))
    assert empty.count() == 0


def test_ranks_give_the_files_own_encoding(spark):
    with open(BYTE_BPE) as file:
        bpe = alignment.ByteBpe(file.read())
    assert bpe.fast is not None
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [t for t in EXTRA if t]
    texts += ["a  b   c\n\n d   e  f", "it's we'll I'M 'tis don't''", "1234 ٣٤ ⅷ", "trailing  \n", "\n\n", "\x1c\x1d x"]
    for t in texts:
        assert bpe.encode(" " + t).tolist() == bpe.slow.encode(" " + t, add_special_tokens=False).ids


def test_tokenizer_without_rank_order_is_used_as_it_is():
    """Merges out of id order, or a normalizer, leave the library's own encoder."""
    import json
    with open(BYTE_BPE) as file:
        parts = json.load(file)
    merges = parts["model"]["merges"]
    merges[3], merges[9] = merges[9], merges[3]
    bpe = alignment.ByteBpe(json.dumps(parts))
    assert bpe.fast is None and b"".join(bpe.bytes[i] for i in bpe.encode(" some text")) == b" some text"


def test_minimal_perfect_hash():
    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 1 << 46, 20_000))
    shard = alignment.shard_of(keys)
    shards = []
    for s in np.unique(shard).tolist():
        words, sizes, ordered = alignment.build_shard(keys[shard == s])
        shards.append((s, words.tobytes(), sizes, ordered.tobytes()))
    pair_hash = alignment.PairHash(shards[::-1])
    places = pair_hash.places(keys)
    assert sorted(places.tolist()) == list(range(len(keys))) and (pair_hash.keys[places] == keys).all()
    with pytest.raises(ValueError):
        pair_hash.places(np.array([keys[0], keys[0] + 1 if keys[0] + 1 != keys[1] else keys[0] + 2]))
    with pytest.raises(ValueError):
        alignment.PairHash([]).places(keys[:1])
    assert len(alignment.PairHash([]).places(keys[:0])) == 0


def test_links_of_a_small_batch():
    """Tokens ab|c|de over abcde and a|bcd|e: ends meet at 5 only, five stretches."""
    kind = np.dtype(np.uint16)
    a, b = (alignment.ids_of(pa.array([b"", np.array(v, kind).tobytes(), b""], pa.binary())[1:], kind) for v in ([1, 2, 3], [4, 5, 6]))
    lengths = np.array([0, 2, 1, 2, 1, 3, 1])
    links = alignment.Links(a, b, lengths, lengths)
    assert [(p >> alignment.ID_BITS, p & 0xFFFFFF) for p in links.pair.tolist()] == [(1, 4), (1, 5), (2, 5), (3, 5), (3, 6)]
    number, digests = links.groups([b"%d" % i for i in range(7)], [b"%d" % i for i in range(7)])
    assert number.tolist() == [1, 0] and digests == [hashlib.sha256(b"1,2,3|4,5,6").hexdigest(), ""]
