"""Language identification by nearest centroid.

A text is a vector of hashed byte n-grams (one to four bytes of its lower-cased letters, all else
being a space), weighted by log term frequency and inverse document frequency and normalised. Each
language has several centroids, found by spherical k-means over a bounded sample of its labelled
texts; a text gets the language of the centroid with the largest cosine.

Rejection is by distance: texts of few different n-grams (short ones, or one word over and over) lie
farther from any centroid than rich ones, so how far a language's own texts lie is learned by that
number, from sampled texts and windows of them, each measured against centroids fitted without it. A
text is rejected when its cosine is below what all but FLOOR_SHARE of its language and class have.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm import common
from furrow.session import broadcast_if_small

DIMENSIONS = 4096
GRAMS = (1, 2, 3, 4)
CENTROIDS = 6
UNDETERMINED = "und"

#: Labelled texts per language that the classifier is fitted on, chosen by a hash of their ids.
SAMPLE_PER_LANGUAGE = 400
#: Lengths at which a sampled text's first and middle windows teach how far short texts may lie.
WINDOWS = (8, 16, 32, 64, 128, 256, 512)
#: Share of a language's own texts of a class that may lie below its floor, and the normal
#: distribution's quantile for it, used where there are too few values for the share itself.
FLOOR_SHARE = 0.005
FLOOR_DEVIATIONS = 2.576
#: A class with fewer values has no floor of its own.
LEAST_VALUES = 8
#: Parts of the sample that are held back from the fit in turn.
FOLDS = 4
#: Classes of texts by their different n-grams, two to an octave.
CLASSES = 2 * (DIMENSIONS.bit_length() - 1) + 1
CHUNK_BYTES = 2 << 20
SEGMENT_BYTES = 1 << 20

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[ord("a"):ord("z") + 1] = True
_LETTER[128:] = True


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a row per text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, len(raw), SEGMENT_BYTES):  # long texts in overlapping stretches
            out[i] += _counts(raw[max(0, at - max(GRAMS) + 1):at + SEGMENT_BYTES], min(at, max(GRAMS) - 1))
    return out


def _counts(raw: np.ndarray, known: int) -> np.ndarray:
    """Counts over a stretch whose first `known` bytes were the end of the one before."""
    letters = _LETTER[raw]
    value = np.where(letters, raw, 32).astype(np.uint32)
    total = np.zeros(DIMENSIONS, np.int64)
    for n in GRAMS:
        if len(value) < n:
            break
        h = np.full(len(value) - n + 1, n, np.uint32)
        some = np.zeros(len(h), bool)
        for k in range(n):
            h = h * np.uint32(31) + value[k:k + len(h)] * _MULTIPLIERS[k]
            some |= letters[k:k + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        skip = max(known - n + 1, 0)
        total += np.bincount((h[skip:] >> np.uint32(20))[some[skip:]], minlength=DIMENSIONS)
    return total


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


@dataclasses.dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row per centroid
    owner: np.ndarray      # index of each centroid's language
    floors: np.ndarray     # a row per language: least cosine by class of text

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, cosine, and whether the text lies too far from every language."""
        counts = grams(texts)
        cosines = weighted(counts, self.idf) @ self.centroids.T
        best = cosines.argmax(axis=1) if len(texts) else np.zeros(0, np.int64)
        score = np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0).astype(np.float64)
        who = self.owner[best]
        return who, score, score < self.floors[who, class_of(counts)]


def class_of(counts: np.ndarray) -> np.ndarray:
    return (2 * np.log2(np.maximum((counts > 0).sum(axis=1), 1))).astype(int)


def kmeans(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from rows far from those already taken."""
    centers = [rows.mean(axis=0)]
    while len(centers) < min(k, len(rows)):
        centers.append(rows[np.argmin((rows @ np.array(centers).T).max(axis=1))])
    c = np.array(centers)
    for _ in range(12):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = (rows @ c.T).argmax(axis=1)
        c = np.array([rows[near == j].mean(axis=0) if (near == j).any() else c[j]
                      for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def windows(texts: list[str]) -> list[str]:
    out = list(texts)
    for n in WINDOWS:
        for t in texts:
            if len(t) > 2 * n:
                out += [t[:n], t[len(t) // 2:len(t) // 2 + n]]
    return [t for t in out if has_letter(t)]


def floor_of(cosines: np.ndarray, below: float) -> float:
    """The cosine that all but FLOOR_SHARE of such texts have; nan if there are too few to tell.

    Too few for that share itself give a normal distribution's floor, but none above `below`, the
    last floor of texts with fewer n-grams that is no estimate.
    """
    if len(cosines) < LEAST_VALUES:
        return np.nan
    if len(cosines) * FLOOR_SHARE >= 1:
        return float(np.quantile(cosines, FLOOR_SHARE, method="lower"))
    spread = cosines.std(ddof=1) * np.sqrt(1 + 1 / len(cosines))
    found = max(min(cosines.min(), cosines.mean() - FLOOR_DEVIATIONS * spread), 0.0)
    return float(np.fmin(found, below))


def own_floors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """A language's floors by class of text, from texts that the centroids were fitted without.

    Equal texts are held back together. nan where there are too few.
    """
    texts = sorted(set(texts))
    fold = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts])
    rows = weighted(grams(texts), idf)
    found: list[list[np.ndarray]] = [[] for _ in range(CLASSES)]
    for f in np.unique(fold):
        if (fold == f).all():
            continue
        c = kmeans(rows[fold != f], CENTROIDS)
        parts = windows([t for t, own in zip(texts, fold, strict=True) if own == f])
        for at in range(0, len(parts), 500):
            counts = grams(parts[at:at + 500])
            cosines, kind = (weighted(counts, idf) @ c.T).max(axis=1), class_of(counts)
            for k in np.unique(kind):
                found[k].append(cosines[kind == k])
    floors = np.full(CLASSES, np.nan)
    below = np.nan
    for k, values in enumerate(found):
        floors[k] = floor_of(np.concatenate(values), below) if values else np.nan
        if values and sum(map(len, values)) * FLOOR_SHARE >= 1:
            below = floors[k]
    return floors


def filled(floors: np.ndarray) -> np.ndarray:
    """Floors of every class: without one a class is judged like the next poorer one of the language,
    else by the lowest floor of the others; classes that no language has reject nothing."""
    floors = floors.copy()
    for i in range(1, floors.shape[1]):
        floors[:, i] = np.where(np.isnan(floors[:, i]), floors[:, i - 1], floors[:, i])
    lowest = np.where(np.isnan(floors), np.inf, floors).min(axis=0)
    return np.where(np.isnan(floors), np.where(np.isinf(lowest), 0.0, lowest), floors)


def fit(docs: DataFrame, labelled: Column, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Learns from rows where `labelled` holds and the language is known.

    At most SAMPLE_PER_LANGUAGE texts of a language reach the fit; only sums and centroids reach
    the driver. Rows whose text is null or has no letter teach nothing. Without any labelled row
    the model knows no language and rejects every text.
    """
    rows = docs.filter(labelled & common.col(lang_col).isNotNull()
                       & common.col(text_col).rlike(r"\p{L}")).select(
        common.col(id_col).alias("id"), common.col(lang_col).alias("lang"),
        common.col(text_col).alias("text"))
    # a share of each language's rows that holds the sample at all but impossible odds, so that
    # few rows of a frequent language are put in order
    part = F.least(F.lit(1.0), 4.0 * SAMPLE_PER_LANGUAGE / F.col("n"))
    ids = rows.select("id", "lang", F.xxhash64("id").alias("key"))
    # one row per language, counted before it is sent, so that the share is taken where rows lie
    counts = broadcast_if_small(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), 100_000)
    first = Window.partitionBy("lang").orderBy("key", "id")
    chosen = broadcast_if_small(
        ids.join(counts, "lang").filter((F.col("key") / 2.0**64 + 0.5) <= part)
        .withColumn("nr", F.row_number().over(first)).filter(F.col("nr") <= SAMPLE_PER_LANGUAGE)
        .select(F.col("id").alias("own_id"), F.col("lang").alias("own_lang")).distinct(), 1_000_000)
    sample = common.stored(rows.join(
        chosen, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("lang") == F.col("own_lang")),
        "left_semi").select("lang", "text"), "languages")

    def frequencies(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        df = (grams(pdf["text"].tolist()) > 0).sum(axis=0).astype("<i8")
        return pd.DataFrame({"lang": [key[0]], "n": [len(pdf)], "df": [df.tobytes()]})

    found = sample.groupBy("lang").applyInPandas(
        frequencies, "lang string, n long, df binary").orderBy("lang").collect()
    if not found:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((1, DIMENSIONS), np.float32),
                     np.zeros(1, np.int64), np.full((1, CLASSES), np.inf))
    df = np.sum([np.frombuffer(r["df"], "<i8") for r in found], axis=0)
    idf = (np.log((1 + sum(r["n"] for r in found)) / (1 + df)) + 1).astype(np.float32)

    def centers(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf["text"].sort_values().tolist()
        c = kmeans(weighted(grams(texts), idf), CENTROIDS).astype("<f4")
        floors = own_floors(texts, idf)
        common.release()
        return pd.DataFrame({"lang": [key[0]], "c": [c.tobytes()], "floors": [floors.tobytes()]})

    fitted = sample.groupBy("lang").applyInPandas(
        centers, "lang string, c binary, floors binary").orderBy("lang").collect()
    parts = [np.frombuffer(r["c"], "<f4").reshape(-1, DIMENSIONS) for r in fitted]
    floors = filled(np.array([np.frombuffer(r["floors"]) for r in fitted]))
    return Model([r["lang"] for r in fitted], idf, np.concatenate(parts),
                 np.repeat(np.arange(len(parts)), [len(p) for p in parts]), floors)


def identify(docs: DataFrame, model: Model, text_col: str = "text", name: str = "language") -> DataFrame:
    """The rows with a struct column (lang, score, rejected).

    A text that is null or has no letter is `und`, with score 0, and rejected. The score is the
    cosine to the nearest centroid. All columns pass through; one called like the struct is
    replaced. The prediction sees the text alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, rejected boolean")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in parts:
            n = len(part)
            lang, score, out = (np.full(n, UNDETERMINED, object), np.zeros(n), np.ones(n, bool))
            able = np.flatnonzero([has_letter(t) for t in part]) if m.languages else np.zeros(0, int)
            for at in range(0, len(able), 250):
                some = able[at:at + 250]
                who, score[some], out[some] = m.predict([part.iloc[i] for i in some])
                lang[some] = np.array(m.languages, object)[who]
            yield pd.DataFrame({"lang": lang, "score": score, "rejected": out})
        common.release()

    return docs.select(*[common.col(c) for c in docs.columns if c != name],
                       judge(common.col(text_col)).alias(name))


def held_out(id_: Column) -> Column:
    """A fifth of the documents, by their ids, from which nothing is learned."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 5 == 0, F.lit(False))
