"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams (orders 1-3 of
the lower-cased text, anything but letters read as a space).  Every language
has several centroids, clustered by spherical k-means; a text takes the language
of the centroid with the largest cosine, and is rejected when even that one is
farther away than the learnt texts of its language ever are.

Document frequencies come from all learnable documents.  The centroids are
fitted on at most ``SAMPLE_DOCS`` documents of each language (those with the
smallest hash of doc_id), one task a language.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices
from .common import rows as rows_of

DIMS = 1 << 13
CENTROIDS = 4
#: Documents of each language that the centroids are fitted on, at most.
SAMPLE_DOCS = 400
#: A text is rejected below this part of the lowest cosine among the fitted documents of its language.
REJECT_SHARE = 0.3
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
_ROUNDS = 12
#: Bins of the histogram of hashes, per language: 2 ** 16.
_HASH_BITS = 16
#: Characters and texts counted at once (a dense block of so many vectors is held): a few tens of MB a task.
_CHARS, _TEXTS = 1 << 18, 64


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> is it a letter (str.isalpha)."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of shape texts x DIMS, letters of each text)."""
    low = [t.lower() for t in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    at = np.flatnonzero(_letters()[code])  # never the first or last place
    letters = np.bincount(doc[at - 1], minlength=len(low))
    code = np.where(_letters()[code], code, np.uint32(32))
    base = doc[at - 1] * DIMS
    a, b, c = code[at - 1], code[at], code[at + 1]
    total = np.zeros(len(low) * DIMS, np.int64)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    with np.errstate(over="ignore"):
        one = b * np.uint32(0x9E3779B1)
        two = one ^ (c * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
        three = (two ^ (a * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))) * np.uint32(0x9E3779B1)
        for h in (one, two * np.uint32(0x85EBCA6B), three):
            total += np.bincount(base + ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> shift), minlength=len(total))
    return total.reshape(len(low), DIMS), letters


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    texts = [t or "" for t in texts]
    for i, j in slices([max(len(t), _CHARS // _TEXTS) for t in texts], _CHARS):
        yield ngram_counts(texts[i:j])


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    """Languages of the centroid rows, the centroids, inverse document frequencies, and the reject line of each row."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray


def learnable(docs: DataFrame) -> DataFrame:
    """Documents to learn from: non-null lang, and crc32 of the doc_id's text mod 4 is not 2."""
    return docs.where(F.col("lang").isNotNull() & ~held_out())


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, farthest-first start: at most k unit centroids, the same ones for the same rows."""
    centres = [_unit(x.sum(axis=0))]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(_ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = np.array([_unit(x[own == i].sum(axis=0)) if (own == i).any() else c[i] for i in range(len(c))])
    return c


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n > 0 else v


def fit(docs: DataFrame, n_centroids: int = CENTROIDS, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from ``docs`` (doc_id, text, lang; pass them through ``learnable``).

    Texts without letters teach nothing.  No documents give a model without
    languages, which rejects everything.
    """
    src = docs.select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in rows_of(batches):
            for counts, letters in _blocks(batch.column(0).to_pylist()):
                seen += (counts > 0).sum(axis=0)
                n += int((letters > 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(seen, n))], names=["bin", "n"])

    # DIMS + 1 rows, whatever the corpus
    df = src.select("text").mapInArrow(frequencies, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(DIMS + 1, np.int64)
    n[df["bin"].to_numpy()] = df["n"].to_numpy()
    idf = (np.log((1 + n[DIMS]) / (1 + n[:DIMS])) + 1).astype(np.float32)

    # a histogram of the hashes' first bits tells how far the sample of a language reaches; only ids up to there are ranked
    scratch = Scratch(docs.sparkSession, "langid")
    ids = (src.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
           .withColumn("bin", F.shiftright("h", 64 - _HASH_BITS)))
    bins = ids.groupBy("lang", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = (bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < sample_docs)
             .groupBy(F.col("lang").alias("of")).agg(F.max("bin").alias("reach")))
    near = ids.join(scratch.table(reach, "reach"), (F.col("lang") == F.col("of")) & (F.col("bin") <= F.col("reach")))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    few = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)
    # SAMPLE_DOCS ids a language, written so that the planner knows how small they are and needn't shuffle the texts
    few = scratch.table(few.select("doc_id", "lang", "rank"), "sample")
    sample = src.join(few, ["doc_id", "lang"])

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").drop_duplicates("rank")
        x = np.concatenate([_vectors(counts, idf)[letters > 0] for counts, letters in _blocks(group["text"].tolist())])
        if not len(x):
            return pd.DataFrame({"lang": [], "vector": [], "floor": []})
        c = cluster(x, n_centroids)
        low = float((x @ c.T).max(axis=1).min())
        return pd.DataFrame({"lang": group["lang"].iloc[0], "vector": list(c.astype(np.float64)), "floor": low})

    rows = sample.groupBy("lang").applyInPandas(centroids, "lang string, vector array<double>, floor double").limit(
        MAX_LANGUAGES * n_centroids + 1).toPandas()
    if len(rows) > MAX_LANGUAGES * n_centroids:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is lang a language column?")
    rows = rows.sort_values("lang", kind="stable")
    vectors = np.array(rows["vector"].tolist(), np.float32).reshape(len(rows), DIMS)
    return Model(rows["lang"].tolist(), vectors, idf, rows["floor"].to_numpy(float) * REJECT_SHARE)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with text, plus lang_pred, score (cosine, 0 to 1), rejected (columns of these names are replaced).

    Only text is looked at.  A null text, or one without letters, is ``und``
    with score 0 and rejected.  Equal cosines go to the first language in
    alphabetical order.
    """
    made = ("lang_pred", "score", "rejected")
    found, near = _nearest(docs, model)
    return found.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made), *(F.col(f"{near}.{c}") for c in made))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``predict`` does not reject, with their own columns only."""
    found, near = _nearest(docs, model)
    return found.where(~F.col(f"{near}.rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))


def _nearest(docs: DataFrame, model: Model) -> tuple[DataFrame, str]:
    """``docs`` with a struct of lang_pred, score and rejected, and the struct's name, that of no other column."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x centroids x DIMS numbers

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        langs = np.array([*m.langs, UNDETERMINED], object)
        for texts in batches:
            best, score = [], []
            for counts, letters in _blocks(texts.tolist()):
                cos = _vectors(counts, m.idf) @ m.centroids.T if m.langs else np.zeros((len(letters), 0), np.float32)
                cos = np.concatenate([cos, np.full((len(letters), 1), -1, np.float32)], axis=1)
                at = np.where(letters > 0, np.argmax(cos, axis=1), len(m.langs))
                best.append(at)
                score.append(np.clip(cos[np.arange(len(at)), at].astype(float), 0, 1))
            at = np.concatenate([np.empty(0, int), *best])
            got = np.concatenate([np.empty(0), *score])
            yield pd.DataFrame({"lang_pred": langs[at], "score": got,
                                "rejected": (at == len(m.langs)) | (got < np.append(m.floor, 2)[at])})

    near = f"_{uuid.uuid4().hex}"
    return docs.withColumn(near, nearest("text")), near
