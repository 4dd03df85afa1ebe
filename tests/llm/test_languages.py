"""Language identification: n-grams and kernels against Python sets, held-out accuracy, defined cases."""

import pickle
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from varibreak.llm import languages


def plain(text):
    """Different n-grams (n = 1, 2, 3) of the normalised text, as strings."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    bare = f" {' '.join(low.split())} "
    return {bare[i : i + n] for n in (1, 2, 3) for i in range(len(bare) - n + 1)} if bare.strip() else set()


def as_strings(numbers):
    out = set()
    for v in numbers.tolist():
        codes = [c for c in (v >> 42, v >> 21 & languages.LOW, v & languages.LOW) if c]
        out.add("".join(" " if c == 1 else chr(c - 2) for c in codes))
    return out


TEXTS = ["", "!!", "a", "A b", "  Ab, ab! x1y ", "Straße ÉTÉ İx", "日本語 の 文", "é" * 50, "\U00010400x \U00010400", "no. end"]


@pytest.mark.parametrize("slice_size", [3, 1 << 20])
def test_spectrum_matches_sets(monkeypatch, slice_size):
    monkeypatch.setattr(languages, "SLICE", slice_size)
    for text in [*TEXTS, None]:
        got = languages.spectrum(text)
        assert as_strings(got) == plain(text or "") and len(got) == len(plain(text or "")) and (np.diff(got) > 0).all()


def test_kernel_rows_match_sets(monkeypatch):
    monkeypatch.setattr(languages, "GRAMS", 7)
    spectra = [languages.spectrum(t) for t in TEXTS[2:6]]
    marks = languages.Landmarks(spectra)
    common = marks.common([languages.spectrum(t) for t in TEXTS])
    assert common.tolist() == [[len(plain(t) & plain(m)) for m in TEXTS[2:6]] for t in TEXTS]
    full = marks.kernel(marks.common(spectra), marks.sizes)
    assert np.allclose(np.diag(full), 1) and np.allclose(full, full.T)


def test_ridge_is_the_kernel_solution_when_every_text_is_a_landmark():
    """With all texts as landmarks, Nyström features give the full kernel ridge solution."""
    texts = ["the cat sat", "the dog ran", "der hund lief", "die katze sass"]
    spectra = [languages.spectrum(t) for t in texts]
    marks = languages.Landmarks(spectra)
    kernel = marks.kernel(marks.common(spectra), marks.sizes).astype(float)
    label = np.array([0, 0, 1, 1])
    scores = kernel @ languages.fit_ridge(kernel, kernel, label, 2)
    weight = np.diag([0.5] * 4)
    dual = np.linalg.solve(weight @ kernel + languages.RIDGE * np.eye(4), weight @ np.eye(2)[label])
    assert np.allclose(scores, kernel @ dual, atol=1e-6)


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("H", F.lit(1)).withColumn("Score", F.lit(2))
    rows = languages.language_report(docs).collect()
    truth = {r.doc_id: r for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == truth[r.doc_id].lang for r in rows if r.held_out]
    assert sum(judged) >= 0.95 * len(judged)
    model = languages.train(docs)
    names, marks, weights = pickle.loads(model)
    for r in rows[::29]:  # the same prediction from Python sets
        sets = [as_strings(marks.grams[marks.presence[:, c] == 1]) for c in range(len(marks.sizes))]
        own = plain(truth[r.doc_id].text)
        row = np.array([len(own & s) / (len(own) * len(s)) ** 0.5 for s in sets])
        assert names[int((row @ weights).argmax())] == r.lang_pred and abs(min(1, max(0, (row @ weights).max())) - r.score) < 1e-4


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    en, de = "the cat and the dog sat on the mat ", "der hund und die katze sassen auf der matte "
    rows = [(i, (en if i % 2 else de) + chr(97 + i % 26) * 3, "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += rows[:3] + [(100, None, "en", None, None), (101, "", "de", "", 0), (102, "123 %%", "en", "", 0), (103, en * 40_000, None, "", 0),
                        (None, de, "fr", "", 0), (104, de, "de", "", 0), (104, en, "en", "", 0)]
    got = languages.language_report(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(by_id[i][0].lang_pred == "und" and by_id[i][0].score == 0 for i in (100, 101, 102))
    assert by_id[103][0].lang_pred == "en" and by_id[None][0].lang_pred == "de" and by_id[None][0].held_out is False
    assert sorted(r.lang_pred for r in by_id[104]) == ["de", "en"]
    assert languages.language_report(spark.createDataFrame([], schema)).count() == 0
    unlearnt = languages.language_report(spark.createDataFrame([(1, "words", None, "", 1)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in unlearnt] == [("und", 0.0)]
