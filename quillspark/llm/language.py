"""Problem 5: missing or wrong document language labels, and the languages of mixed documents.

Method: string-kernel classification. Texts are compared by a normalised presence kernel on the blended spectrum of byte
n-grams; Nyström landmarks give a finite feature map K(x, Z) Kzz^(-1/2), and one-versus-rest kernel ridge regression is fit
on it. Scoring is a matrix product X Z' Kzz^(-1/2) B of the presence rows with fixed matrices, so Z' Kzz^(-1/2) B is
multiplied out once: a table of n-gram weights of fixed size that is sent to the workers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import textkind as K

LANGUAGES = ("en", "de", "fr", "es", "it", "pt")
# ISO 639 codes and English names that mean a language.
LANGUAGE_NAMES = {
    "en": "en eng english",
    "de": "de deu ger german",
    "fr": "fr fra fre french",
    "es": "es spa spanish castilian",
    "it": "it ita italian",
    "pt": "pt por portuguese",
}
DIMENSION_BITS = 14
DIMENSIONS = 1 << DIMENSION_BITS  # hashed n-grams
SAMPLE_PER_LANGUAGE = 240  # labelled documents used to fit, the bound of the sample
LANDMARKS_PER_LANGUAGE = 40
RIDGE = 1e-2
MIN_LETTERS = 30  # pieces with fewer letters follow the document
MIXED_MARGIN = 0.5  # page headings stay below, paragraphs above
CONFIDENCE_SCALES = (1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 13.0, 17.0, 22.0)
CALIBRATION_WORDS = 5  # words of the held-out pieces that the scale is fit on; whole paragraphs are hardly ever wrong
SCORING_BATCH = 64  # documents scored by one product
FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
PIECES = re.compile(r"\n\n")


class Presence:
    """Presence of the byte n-grams (n = 2, 3, 4) of texts, as distinct hashed ids."""

    A, B, C, D, E = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))
    SHIFT = np.uint32(32 - DIMENSION_BITS)

    def __init__(self) -> None:
        self.stamp = np.zeros(DIMENSIONS, np.int64)
        self.order = np.arange(1 << 12)

    def _distinct(self, codes: np.ndarray) -> np.ndarray:
        """Each code once: a code is kept where its own position was the last to be written."""
        if len(codes) > len(self.order):
            self.order = np.arange(2 * len(codes))
        at = self.order[: len(codes)]
        self.stamp[codes] = at
        return codes[self.stamp[codes] == at]

    def pieces(self, texts: list[str]) -> list[tuple[np.ndarray, int]]:
        """(distinct ids, letters) of each text; the n-grams of all are computed in one pass over their joined bytes."""
        folded = [b" ".join(t.lower().encode("utf-8", "replace").translate(FOLD).split()) for t in texts]
        b = np.frombuffer(b"  " + b"  ".join(folded) + b"   ", np.uint8).astype(np.uint32)
        two = b[:-1] * self.A + b[1:] * self.B
        three = two[:-1] * self.C + b[2:] * self.D
        four = three[:-1] * self.E + b[3:] * self.A
        two, three, four = ((x >> self.SHIFT).astype(np.intp) for x in (two, three, four))
        out, start = [], 1
        for f in folded:
            n = len(f)
            # n-grams that start in " text", of which the last ends with the blank behind it
            part = (two[start : start + n + 1], three[start : start + n], four[start : start + max(0, n - 1)])
            out.append((self._distinct(np.concatenate(part)) if n > 1 else np.zeros(0, np.intp), n - f.count(b" ")))
            start += n + 2
        return out

    def ids(self, text: str) -> np.ndarray:
        return self.pieces([text])[0][0]


def fit(texts: list[str], labels: list[str], seed: int = 7) -> np.ndarray:
    """The n-gram weights (DIMENSIONS x languages) of the fitted kernel machine."""
    presence, rng = Presence(), np.random.default_rng(seed)
    y = np.asarray([LANGUAGES.index(x) for x in labels])
    rows = [presence.ids(t) for t in texts]
    keep = [i for i, r in enumerate(rows) if len(r)]
    rows, y = [rows[i] for i in keep], y[keep]
    if not rows:
        return np.zeros((DIMENSIONS, len(LANGUAGES)), np.float32)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[:LANDMARKS_PER_LANGUAGE] for k in range(len(LANGUAGES))])
    z = np.zeros((len(chosen), DIMENSIONS), np.float32)
    for i, c in enumerate(chosen):
        z[i, rows[c]] = 1 / np.sqrt(len(rows[c]))
    values, vectors = np.linalg.eigh(z @ z.T)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    columns = np.ascontiguousarray(z.T)
    kernel = np.stack([columns[r].sum(axis=0) / np.sqrt(len(r)) for r in rows])
    features = kernel @ root
    target = np.where(y[:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
    weight = np.sqrt(len(y) / (len(LANGUAGES) * np.bincount(y, minlength=len(LANGUAGES))[y]))[:, None]  # languages count alike
    a = features * weight
    beta = np.linalg.solve(a.T @ a + RIDGE * len(y) / 100 * np.eye(a.shape[1]), a.T @ (target * weight))
    return (z.T @ (root @ beta)).astype(np.float32)


def score(weights: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The six decision values of a text."""
    return weights[ids].sum(axis=0) / np.sqrt(max(1, len(ids)))


def confidence(values: np.ndarray, scale: float) -> float:
    e = np.exp(scale * (values - values.max()))
    return float(e.max() / e.sum())


def fit_scale(texts: list[str], labels: list[str]) -> float:
    """The scale of the decision values that makes confidences likeliest on pieces of a held-out fifth of the sample,
    under weights fit on two other fifths.
    """
    held = [i for i in range(len(texts)) if i % 5 == 0]
    weights = fit([x for i, x in enumerate(texts) if i % 5 in (1, 2)], [x for i, x in enumerate(labels) if i % 5 in (1, 2)])
    pieces, y = [], []
    for i in held:
        words = texts[i].split()
        for k in range(0, len(words) - CALIBRATION_WORDS + 1, 4 * CALIBRATION_WORDS):
            pieces.append(" ".join(words[k : k + CALIBRATION_WORDS]))
            y.append(LANGUAGES.index(labels[i]))
    if not pieces:
        return CONFIDENCE_SCALES[len(CONFIDENCE_SCALES) // 2]
    values = scores(weights, [r for r, _ in Presence().pieces(pieces)])
    values = values - values.max(axis=1, keepdims=True)

    def loss(scale: float) -> float:
        return float((np.log(np.exp(scale * values).sum(axis=1)) - scale * values[np.arange(len(y)), y]).mean())

    return min(CONFIDENCE_SCALES, key=loss)


def scores(weights: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The decision values of many presence rows at once: the sparse product of the presence matrix with the weights."""
    sizes = np.asarray([len(r) for r in rows])
    out = np.zeros((len(rows), weights.shape[1]))
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = np.add.reduceat(weights[np.concatenate([rows[i] for i in full])], starts, axis=0) / np.sqrt(sizes[full])[:, None]
    return out


def decide(values: np.ndarray, letters: np.ndarray, scale: float) -> list[tuple[int, str, float]]:
    """(seg_no, language, confidence) of a document from the values and sizes of its pieces.

    One entry with seg_no 0, or one for each piece if at least two languages are each sure of a piece.
    """
    whole = (values * letters[:, None]).sum(axis=0) / max(1, letters.sum())
    top = int(whole.argmax())
    usable = letters >= MIN_LETTERS
    best = values.argmax(axis=1)
    ranked = np.sort(values, axis=1)
    sure = {int(k) for k in best[usable & (ranked[:, -1] - ranked[:, -2] >= MIXED_MARGIN)]}
    if len(sure) < 2:
        return [(0, LANGUAGES[top], confidence(whole, scale))]
    among = sorted(sure)
    out = []
    for i in range(len(letters)):
        if usable[i]:
            out.append((i + 1, LANGUAGES[max(among, key=lambda k: values[i, k])], confidence(values[i], scale)))
        elif letters[i]:
            out.append((i + 1, LANGUAGES[top], 0.0))
    return out


def documents_languages(texts: list[str], weights: np.ndarray, presence: Presence, scale: float = CONFIDENCE_SCALES[6]) -> list[list[tuple[int, str, float]]]:
    """decide() for each text."""
    rows, letters, ends = [], [], [0]
    for t in texts:
        for r, n in presence.pieces(PIECES.split(t)):
            rows.append(r)
            letters.append(n)
        ends.append(len(rows))
    values, letters = scores(weights, rows), np.asarray(letters)
    return [decide(values[a:b], letters[a:b], scale) for a, b in zip(ends, ends[1:])]


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of at most per_language labelled documents of each language, chosen by a hash of the id.

    A threshold on the hash, from the counts of the labels, keeps the ranked part small however large a language is.
    """
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    labelled = docs.filter(F.col("lang").isin(*LANGUAGES))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))  # at most six rows
    near = labelled.join(F.broadcast(counts), "lang").filter((h / (1 << 30)) * F.col("n") < 2 * per_language + 50).filter("text is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= per_language).select("lang", "text")


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """(n-gram weights, scale of the confidences)."""
    rows = labelled_sample(docs).collect()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r.lang, r.text)):
        for p in PIECES.split(r.text):
            if len(p) >= MIN_LETTERS:
                texts.append(p)
                labels.append(r.lang)
    return fit(texts, labels), fit_scale(texts, labels)


def label_code(label: Column) -> Column:
    """The language code a label means (codes, English names, regional forms, any case), or null."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in LANGUAGE_NAMES.items():
        out = F.when(base.isin(*names.split()), F.lit(code)).otherwise(out)
    return out


def classify_prose(texts: DataFrame, weights: np.ndarray, scale: float) -> DataFrame:
    """(file_id, seg_no, lang, confidence) of every prose text; other texts give no row."""
    shared = texts.sparkSession.sparkContext.broadcast(weights)  # DIMENSIONS x 6 floats: 1.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, presence = shared.value, Presence()
        for b in batches:
            out = ([], [], [], [])
            prose = [(i, t) for i, t in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist()) if K.is_prose(t)]
            for at in range(0, len(prose), SCORING_BATCH):
                part = prose[at : at + SCORING_BATCH]
                for (i, _), found in zip(part, documents_languages([t for _, t in part], w, presence, scale)):
                    for seg, lang, conf in found:
                        for column, v in zip(out, (i, seg, lang, conf)):
                            column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["file_id", "seg_no", "lang", "confidence"])

    return texts.select("file_id", "text").filter("file_id is not null and text is not null").mapInArrow(run, "file_id bigint, seg_no bigint, lang string, confidence double")


def language_findings(texts: DataFrame, metadata: DataFrame, docs: DataFrame) -> DataFrame:
    """(file_id, seg_no, lang, confidence): prose whose label is missing or wrong, and every paragraph of mixed prose.

    texts: (file_id, text); metadata: (file_id, language); docs: (doc_id, text, lang) to fit on. Further columns are
    ignored, repeated rows count once, a file without metadata counts as unlabelled; empty tables give an empty result.
    A paragraph with fewer than MIN_LETTERS letters takes the language of the document; one without letters gives no row.
    """
    found = classify_prose(texts, *train(docs)).groupBy("file_id", "seg_no", "lang").agg(F.max("confidence").alias("confidence"))
    labels = metadata.select("file_id", label_code(F.col("language")).alias("label")).groupBy("file_id").agg(F.max("label").alias("label"))
    return found.join(labels, "file_id", "left").filter((F.col("seg_no") > 0) | F.col("label").isNull() | (F.col("label") != F.col("lang"))).drop("label")
