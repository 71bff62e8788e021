"""Language identification by the nearest of several centroids per language.

A text's vector counts its letter trigrams (ASCII letters in lower case, other ASCII as a gap, bytes of other letters
as they are), hashed into DIM places, weighted by tf-idf and normalised. Each language's sample is clustered by
spherical k-means; a text gets the language of the centroid with the largest cosine, and is rejected where that is
too far from every centroid for a text of its length. Lengths below any of which the sample has enough texts are judged
by as many trigrams drawn from its longer texts, other sparse ones like the next shorter length. A cosine of 0 is
always too far.

The classifier is fitted on a sample of about SAMPLE labelled rows a language (a documented parameter), drawn by a
hash of the id with the same chance for every row; whole texts are counted, and every row is classified by its whole
text. What tasks receive is the centroids, languages x CLUSTERS x DIM numbers; the driver holds the sample's counts.

Defined results: a null text or one without a letter is `und` with score 0 and rejected; without any labelled rows to
learn from, every text is; null ids are labelled rows like others; equal cosines go to the first language by code point;
repeated rows and rows that share an id are drawn together; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.textbytes import pieces
from weftline.session import materialise, ship_by_value, text_batches

ship_by_value(__name__)

DIM, CLUSTERS, SAMPLE = 4096, 4, 400
ENOUGH = 10  # sampled texts of a length, to judge texts of it by
UNKNOWN = "und"
RESULT = "lang_pred string, score double, rejected boolean"

_code = np.zeros(256, np.uint32)
for _i in range(26):
    _code[65 + _i] = _code[97 + _i] = _i + 1
for _i in range(128, 256):
    _code[_i] = _i - 100


def trigram_counts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and their counts, some rows at a time; a row's pieces never split."""
    for data, offsets, rows, _ in pieces(column, limit=1 << 19, rows=128):
        c = _code[data]
        counts = np.zeros((len(rows), DIM), np.float32)
        if len(c) >= 3:
            gram = (c[:-2] * np.uint32(160) + c[1:-1]) * np.uint32(160) + c[2:]
            place = (gram * np.uint32(2654435769)) >> np.uint32(20)
            n = len(gram)
            part = np.repeat(np.arange(len(rows)), np.diff(offsets))[:n]
            used = (gram != 0) & (np.arange(n) + 3 <= offsets[part + 1])
            counts = np.bincount(part[used] * DIM + place[used], minlength=len(rows) * DIM).reshape(len(rows), DIM).astype(np.float32)
        yield rows, counts


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # normalised rows
    language_of: np.ndarray
    limits: np.ndarray  # by the binary logarithm of the number of trigrams: the least cosine that is accepted

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def classify(self, column: pa.Array, letters: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
        """Languages, cosines and rejections of a column of texts."""
        n = len(column)
        score, which, size = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        for rows, counts in trigram_counts(column):
            cosine = self.vectors(counts) @ self.centroids.T
            which[rows] = self.language_of[np.argmax(cosine, axis=1)]
            score[rows] = np.clip(cosine.max(axis=1), 0, 1)
            size[rows] = counts.sum(axis=1)
        limit = self.limits[np.minimum(np.log2(np.maximum(size, 1)).astype(int), len(self.limits) - 1)]
        score = np.where(letters, np.round(score.astype(np.float64), 6), 0.0)
        return [self.languages[i] if ok else UNKNOWN for i, ok in zip(which, letters, strict=True)], score, ~letters | (score < limit) | (score <= 0)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("n", pa.binary())])
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for rows, counts in trigram_counts(batch.column(1)):
            out = []
            for row, x in zip(rows, counts, strict=True):
                at = np.flatnonzero(x)
                out.append({"lang": langs[row], "at": at.astype(np.uint16).tobytes(), "n": x[at].astype(np.float32).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart rows; empty clusters vanish."""
    mean = x.mean(axis=0)
    centroids = [x[int(np.argmax(x @ mean))]]
    while len(centroids) < min(k, len(x)):
        centroids.append(x[int(np.argmin(np.max(x @ np.array(centroids).T, axis=1)))])
    c = np.array(centroids)
    for _ in range(rounds):
        mine = np.argmax(x @ c.T, axis=1)
        c = np.array([x[mine == i].sum(axis=0) for i in range(len(c)) if (mine == i).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from about `sample` rows of each language in labelled, drawn by a hash of the id; None without rows."""
    text_batches(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = materialise(rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("chance")), "languages")
    dice = F.pmod(F.xxhash64(F.lit("fit"), F.col("id")), F.lit(1_000_000)) / 1_000_000
    drawn = rows.join(sizes, "lang").filter(dice < F.col("chance"))
    got = drawn.select("lang", "text").mapInArrow(_sparse, "lang string, at binary, n binary").collect()
    got = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in got)  # the same order in every run
    return learn(got, clusters) if got else None


def learn(got: list[tuple[str, bytes, bytes]], clusters: int = CLUSTERS) -> Model:
    """A model from sparse counts (language, places, counts), sorted. Only one language's rows are held in full at a time."""
    seen = np.zeros(DIM, np.int64)
    for _, at, _ in got:
        seen[np.frombuffer(at, np.uint16)] += 1
    idf = (np.log((1 + len(got)) / (1 + seen)) + 1).astype(np.float32)
    languages = sorted({r[0] for r in got})
    model = Model(languages, idf, np.zeros((0, DIM), np.float32), np.zeros(0, np.int64), np.zeros(1))
    of = {lang: [r for r in got if r[0] == lang] for lang in languages}

    def counts_of(lang: str) -> np.ndarray:
        counts = np.zeros((len(of[lang]), DIM), np.float32)
        for i, (_, at, n) in enumerate(of[lang]):
            counts[i, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.float32)
        return counts

    parts = [_clusters(model.vectors(counts_of(lang)), clusters) for lang in languages]
    model.centroids = np.concatenate(parts).astype(np.float32)
    model.language_of = np.repeat(np.arange(len(languages)), [len(c) for c in parts])
    model.limits = _limits(model, lambda: map(counts_of, languages))
    return model


def _length_class(counts: np.ndarray) -> np.ndarray:
    """The binary logarithm of each row's number of trigrams."""
    return np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int)


def _limits(model: Model, blocks) -> np.ndarray:
    """The least cosine that is accepted, by the binary logarithm of the number of trigrams.

    A text is rejected below half of what one in a hundred sampled texts of its length falls short of.
    """
    best: dict[int, list] = {s: [] for s in range(33)}
    short: dict[int, list] = {s: [] for s in range(33)}
    for counts in blocks():
        x, size = model.vectors(counts), _length_class(counts)
        cosine = (x @ model.centroids.T).max(axis=1)
        for s in set(size.tolist()):
            best[s].append(cosine[size == s])
    filled = [s for s in range(33) if sum(map(len, best[s])) >= ENOUGH]
    for counts in blocks():
        x, size = model.vectors(counts), _length_class(counts)
        for s in range(min(filled, default=33)):
            if (size > s).any():
                short[s].append(_shortened(model, counts[size > s], x[size > s], max(1, 3 * 2**s // 2)))
    limits, low = [], 0.0
    for s in range(33):
        some = best[s] if s in filled else short[s]
        if some:
            low = float(np.quantile(np.concatenate(some), 0.01)) / 2
        limits.append(low)
    return np.array(limits)


def _shortened(model: Model, counts: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Cosines of n trigrams drawn from each text; its own part in its centroid is left out."""
    dice = np.random.Generator(np.random.PCG64(n))
    short = np.zeros_like(counts)
    for row, c in zip(short, counts, strict=True):
        at = np.flatnonzero(c)
        row[at] = dice.multivariate_hypergeometric(c[at].astype(np.int64), n)
    own = np.argmax(x @ model.centroids.T, axis=1)
    v = model.vectors(short)
    cosine = v @ model.centroids.T
    for k in range(len(model.centroids)):
        mine = own == k
        rest = x[mine].sum(axis=0) - x[mine]
        norm = np.linalg.norm(rest, axis=1)
        cosine[mine, k] = np.where(norm > 1e-6, (v[mine] * rest).sum(axis=1) / np.maximum(norm, 1e-12), 0)
    return cosine.max(axis=1)


def identify(model: Model | None, text: Column) -> Column:
    """lang_pred, score (the cosine) and rejected for a column of whole texts."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))

    def classify(texts: pa.Array, letters: pa.Array) -> pa.Array:
        langs, score, rejected = model.classify(texts, np.asarray(letters, dtype=bool))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    # named nondeterministic, or a filter on the result would be pushed below it and every text classified twice
    return F.arrow_udf(classify, RESULT).asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
