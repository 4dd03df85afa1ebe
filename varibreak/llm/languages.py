"""Language identification by a string kernel with Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of different n-grams (n = 1, 2, 3: a blended spectrum, by presence) that both
hold, divided by the root of the product of each text's own number.  N-grams are taken from the whole text, lower-cased,
with every run of other characters than letters written as one space; three code points fit a 63-bit number, so they
are exact.  Landmarks are whole texts of the training sample; a text's kernel row with all landmarks is a product of
the presence matrix of a batch and that of the landmarks, and one more product gives the scores of all languages.

Fitting: of the labelled rows at most ``TRAIN`` different texts, dealt evenly to the languages and chosen by a hash of
the text, so copies count once and the choice repeats; the driver gets one kernel row (``LANDMARKS`` counts) of each.
The model that tasks receive holds at most ``INCIDENCES`` pairs of n-gram and landmark, whatever the corpus holds.

Defined cases: a text that is NULL or has no letter is ``und`` with score 0, as is every text when nothing can be
learnt; rows with NULL language or id are not learnt from (a NULL id is not held out) but predicted; equal scores go to
the language first in code point order; repeated rows are returned each; extra columns are not read; more than
``TRAIN`` languages are an error; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

TRAIN = 4096
LANDMARKS = 128
LANDMARK_CHARS = (2000, 4000)  # wanted, most
INCIDENCES = 1_500_000
RIDGE = 1e-3
UNKNOWN = "und"
BATCH = 128
GRAMS = 16_384
SLICE = 1 << 20
LOW = (1 << 21) - 1

_CODES: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """Code of every code point: 0 for others than letters, else that of its lower case plus 2."""
    if not _CODES:
        table = np.zeros(0x110000, dtype=np.int64)
        for point in range(0x110000):
            char = chr(point)
            if char.isalpha():
                low = char.lower()
                table[point] = (ord(low) if len(low) == 1 else point) + 2
        _CODES.append(table)
    return _CODES[0]


def spectrum(text: str | None) -> np.ndarray:
    """The different n-grams of a text as ascending numbers; none for a text without letters."""
    code = _codes()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    gap = code == 0
    kept = ~gap
    kept[1:] |= ~gap[:-1]
    code = np.where(gap, 1, code)[kept]
    if not len(code) or gap.all():
        return np.empty(0, dtype=np.int64)
    code = np.concatenate([[1], code, [1, 0, 0] if code[-1] != 1 else [0, 0]])
    found = [np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) for c in (code[a : a + SLICE + 2] for a in range(0, len(code) - 2, SLICE))]
    three = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    two = _steps(three >> 21)  # every shorter n-gram starts a padded longer one
    one = _steps(two >> 21)
    return np.concatenate([one, two[two & LOW != 0], three[three & LOW != 0]])


def _steps(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


class Landmarks:
    """Kernel rows of texts with the landmarks, by batched products of presence matrices."""

    def __init__(self, spectra: list[np.ndarray]):
        self.grams = np.unique(np.concatenate(spectra)) if spectra else np.empty(0, np.int64)
        self.sizes = np.array([len(s) for s in spectra], dtype=float)
        self.presence = np.zeros((len(self.grams), len(spectra)), dtype=np.uint8)
        for column, s in enumerate(spectra):
            self.presence[np.searchsorted(self.grams, s), column] = 1

    def common(self, spectra: list[np.ndarray]) -> np.ndarray:
        """Numbers of n-grams that each text shares with each landmark (texts x landmarks)."""
        rows, places = [], []
        for row, s in enumerate(spectra):
            at = np.searchsorted(self.grams, s)
            at[at == len(self.grams)] = 0
            at = at[self.grams[at] == s]
            rows.append(np.full(len(at), row))
            places.append(at)
        row, place = np.concatenate(rows), np.concatenate(places)
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        out = np.zeros((len(spectra), len(self.sizes)), dtype=np.float32)
        for start in range(0, len(self.grams), GRAMS):  # counts below 2**24 are exact in 32-bit floats
            part = self.presence[start : start + GRAMS].astype(np.float32)
            a, b = np.searchsorted(place, [start, start + GRAMS])
            held = np.zeros((len(spectra), len(part)), dtype=np.float32)
            held[row[a:b], place[a:b] - start] = 1
            out += held @ part
        return out

    def kernel(self, common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return common / np.sqrt(np.maximum(sizes, 1)[:, None] * self.sizes)


def fit_ridge(kernel: np.ndarray, among: np.ndarray, label: np.ndarray, classes: int) -> np.ndarray:
    """Weights (landmarks x classes) of one-versus-rest ridge regression on the Nyström features of ``kernel``.

    ``among`` is the kernel of the landmarks; directions it hardly holds are left out.  Languages weigh alike.
    """
    value, vector = np.linalg.eigh(among)
    good = value > 1e-8 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    feature = kernel @ root
    weight = 1.0 / np.bincount(label, minlength=classes)[label]
    target = np.eye(classes)[label]
    left = feature.T @ (feature * weight[:, None]) + RIDGE * np.eye(feature.shape[1])
    return root @ np.linalg.solve(left, feature.T @ (target * weight[:, None]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame) -> DataFrame:
    """``lang, h, doc_id, size`` of the training texts: for every language those of smallest hash, each text once."""
    learnt = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    learnt = learnt.select("lang", F.xxhash64("text").alias("h"), "doc_id", F.length("text").alias("size"))
    counts = learnt.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).limit(TRAIN + 1).collect()
    if len(counts) > TRAIN:
        raise ValueError(f"more than {TRAIN} languages")
    quota = TRAIN // max(1, len(counts))
    limit = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 2.0 * quota / max(1, r.texts))) for r in counts], "lang string, share double")
    near = learnt.join(F.broadcast(limit), "lang").filter(F.col("h") / 2.0**64 + 0.5 <= F.col("share")).drop("share")
    near = near.groupBy("lang", "h").agg(F.min(F.struct("doc_id", "size")).alias("d")).select("lang", "h", "d.*")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= quota).drop("r")


def _choose(rows: list) -> list[tuple]:
    """Keys (lang, h) of the landmarks: texts nearest the wanted length, language by language in turn."""
    wanted, most = LANDMARK_CHARS
    by_lang: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.size > most, -min(r.size, wanted) if r.size <= most else r.size, r.h)):
        by_lang.setdefault(r.lang, []).append((r.lang, r.h))
    turns = [(place, lang, key) for lang, keys in by_lang.items() for place, key in enumerate(keys)]
    return [key for _, _, key in sorted(turns)[:LANDMARKS]]


def _spectra(batches):
    for batch in batches:
        lists = [spectrum(t.as_py()) for t in batch.column(2)]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in lists], dtype=np.int64)]).astype(np.int32)
        grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), grams], ["lang", "h", "grams"])


def train(docs: DataFrame) -> bytes | None:
    """The pickled model of ``doc_id, text, lang``: languages, landmarks and weights; None without training texts."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "lang")
    sample = cut_lineage(_sample(docs))
    rows = sample.collect()
    if not rows:
        return None
    texts = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(sample.select("lang", "h", "doc_id")), ["lang", "h", "doc_id"])
    texts = cut_lineage(texts.select("lang", "h", "text").dropDuplicates(["lang", "h"]))  # at most TRAIN rows
    keys = _choose(rows)
    chosen = texts.join(F.broadcast(spark.createDataFrame(keys, "lang string, h long")), ["lang", "h"]).select("lang", "h", "text")
    held = {(r.lang, r.h): np.array(r.grams, dtype=np.int64) for r in chosen.mapInArrow(_spectra, "lang string, h long, grams array<long>").collect()}
    spectra, room = [], INCIDENCES
    for key in keys:
        if not spectra or len(held[key]) <= room:
            spectra.append(held[key])
            room -= len(held[key])
    marks = Landmarks(spectra)
    sent = spark.sparkContext.broadcast(pickle.dumps(marks))

    def kernel_rows(batches):
        marks = pickle.loads(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lists = [spectrum(t.as_py()) for t in part.column(2)]
                shared = pa.array(marks.common(lists).astype(np.int64).tolist(), pa.list_(pa.int64()))
                sizes = pa.array([len(s) for s in lists], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sizes, shared], ["lang", "h", "n", "common"])

    found = texts.mapInArrow(kernel_rows, "lang string, h long, n long, common array<long>").collect()
    found.sort(key=lambda r: (r.lang, r.h))
    names = sorted({r.lang for r in found})
    kernel = marks.kernel(np.array([r.common for r in found], dtype=float), np.array([r.n for r in found]))
    among = marks.kernel(marks.common(spectra).astype(float), marks.sizes)
    weights = fit_ridge(kernel, among, np.array([names.index(r.lang) for r in found]), len(names))
    return pickle.dumps((names, marks, weights))


def identify(docs: DataFrame, model: bytes | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every row's ``text``."""
    if model is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        names, marks, weights = pickle.loads(sent.value)
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            best, score = [], []
            for at in range(0, len(text), BATCH):
                lists = [spectrum(t.as_py()) for t in text.slice(at, BATCH)]
                sizes = np.array([len(s) for s in lists])
                scores = marks.kernel(marks.common(lists), sizes) @ weights
                top = scores.argmax(axis=1)
                best += [names[c] if n else UNKNOWN for c, n in zip(top, sizes)]
                score.append(np.where(sizes > 0, np.clip(scores[np.arange(len(top)), top], 0.0, 1.0), 0.0))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(best, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = {c: t for c, t in docs.select(*keep).dtypes}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    return docs.select(*keep, "text").mapInArrow(predict, schema)


def language_report(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; fitted on the rows that are not held out."""
    docs = documents.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return identify(docs, train(docs), ["doc_id", "held_out"])
