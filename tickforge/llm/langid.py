"""Operator 9: language identification with a string kernel.

The kernel of two texts counts the byte n-grams (2 to 4, blended) that both
hold, presence only, divided by the geometric mean of the texts' own counts.
N-grams are compared as such, none is hashed.
A Nystroem map onto the kernel rows of a few landmark texts makes it finite, and
one-versus-rest kernel ridge regression on that map gives one value per
language.  A text's kernel row needs only those of its n-grams that some landmark holds
(and the number of all), so scoring is a batched matrix product: presence of the landmarks'
n-grams, times the product of landmarks and fitted coefficients.

Fitting uses at most ``sample_docs`` labelled texts (eight a language, if there are more
than ``sample_docs / 8`` of them), dealt evenly over all
languages (texts of up to ``SAMPLE_BYTES`` first, then by the hash of the id), all of them outside
the held-out third.  Prediction reads every whole text and nothing else.

Defined cases: null text, or a text without a letter, gives ``und`` with score
0, as does every text when no labelled text exists; ties go to the first language by name; an empty table gives no
row; repeated rows are predicted each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tickforge.llm._common import slices, spread, text_buffers, trim, written

SIZES = (2, 3, 4)
SAMPLE_DOCS, SAMPLE_BYTES = 1600, 1 << 16
LANDMARKS = 128
#: Lengths in characters for which the least score of a known language is learnt, and the held-out texts this takes.
CUTS, LEAST_TEXTS = (16, 64, 256, 1024), 20
#: Scores are counted in so many steps for that; a text of full weight counts so much.
STEPS, _WEIGHT = 1 << 14, 1 << 40
_ROWS = 64
_SLICE = 1 << 18

_ASCII = np.arange(256, dtype=np.uint8)
_ASCII[65:91] += 32
_ASCII[:128][[not chr(c).isalpha() for c in range(128)]] = 32
_LETTER = np.array([chr(c).isalpha() if c < 128 else False for c in range(256)])


def _plain(buf: np.ndarray) -> np.ndarray:
    """Lower-case Latin letters; every other ASCII character reads as a space."""
    out = _ASCII[buf]
    if len(out) > 1:
        accented = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][accented] += 32
    return out


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each document of a slice: sorted keys, and the edges of the documents."""
    docs = len(off) - 1
    text = _plain(buf).astype(np.uint64)
    place = np.repeat(np.arange(docs, dtype=np.uint64) << np.uint64(35), np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))
    gram, out = text, [np.empty(0, np.uint64)]
    for n in range(2, max(SIZES) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            break
        gram = (gram[:m] << np.uint64(8)) | text[n - 1 :]
        if n in SIZES:
            out.append((place[:m] | np.uint64((n - 1) << 32) | gram)[left[:m] >= n])
    keys = np.sort(np.concatenate(out))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    edge = np.searchsorted(keys, np.arange(docs + 1, dtype=np.uint64) << np.uint64(35))
    return keys & np.uint64((1 << 35) - 1), edge


def found_in(vocabulary: np.ndarray, keys: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """A 0/1 matrix: which n-grams of the vocabulary each document holds."""
    out = np.zeros((len(edge) - 1, len(vocabulary)), dtype=np.float32)
    if len(vocabulary) and len(keys):
        at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == keys)
        out[np.searchsorted(edge, hit, side="right") - 1, at[hit]] = 1.0
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    languages: list[str]
    vocabulary: np.ndarray  # the n-grams of all landmarks, sorted
    weights: np.ndarray  # (vocabulary, languages): landmarks over their norms, times the coefficients
    offset: np.ndarray

    def values(self, keys: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """One regression value per document and language: K(x, landmarks) times the coefficients."""
        norm = np.sqrt(np.maximum(np.diff(edge), 1))[:, None]
        return found_in(self.vocabulary, keys, edge) @ self.weights / norm + self.offset


def landmark_rows(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary of landmark texts (n-gram keys each) and their presence over own norm, ``(landmarks, vocabulary)``."""
    vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *marks]))
    scaled = found_in(vocabulary, np.concatenate([np.empty(0, np.uint64), *marks]), np.cumsum([0, *map(len, marks)]))
    return vocabulary, scaled / np.sqrt(np.maximum([[len(m)] for m in marks], 1)).astype(np.float32)


def fit(kernel: np.ndarray, labels: list[str], vocabulary: np.ndarray, marks: np.ndarray, ridge: float = 1e-2) -> LanguageModel:
    """Nystroem map of the kernel rows ``(texts, landmarks)`` and ridge regression on targets +1 and -1."""
    languages = sorted(set(labels))
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(float))
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    z = kernel.astype(float) @ root
    mean_z, mean_y = z.mean(axis=0), y.mean(axis=0)
    zc = z - mean_z
    w = np.linalg.solve(zc.T @ zc + ridge * len(z) * np.eye(z.shape[1]) / z.shape[1], zc.T @ (y - mean_y))
    return LanguageModel(languages, vocabulary, marks.T @ (root @ w).astype(np.float32), (mean_y - mean_z @ w).astype(np.float32))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; such documents are never learnt from (null: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, sample_docs: int) -> DataFrame | None:
    """Labelled texts outside the held-out third, dealt evenly over the languages, ``(doc_id, lang, text)``.

    A bound on the hash, from the label's count, thins each language before anything is ordered.
    """
    short = (F.octet_length(F.col("text").cast("string")) > SAMPLE_BYTES).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"), short.alias("big"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    known = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(1 - F.col("big")).alias("n_short")).collect()  # a row per language
    if not known:
        return None
    each = max(8, sample_docs // len(known))
    bound = docs.sparkSession.createDataFrame([(r.lang, r.n_short < each, min(1.0, 8 * each / max(r.n_short if r.n_short >= each else r.n, 1))) for r in known], "lang string, any boolean, share double")
    # at least ``each`` texts pass the bound but with a chance below 1e-9 a language
    passed = rows.join(F.broadcast(bound), "lang").where(((F.col("big") == 0) | F.col("any")) & (F.shiftrightunsigned("h", 11) <= F.col("share") * float(1 << 53)))
    order = Window.partitionBy("lang").orderBy("big", "h", "doc_id", F.xxhash64("text"))
    return passed.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("doc_id", "lang", "k", "text")


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Fit on a bounded sample of labelled documents outside the held-out third."""
    texts = sample(docs, sample_docs)
    if texts is None:
        return None
    texts = written(texts, "languages")
    languages = texts.select("lang").distinct().count()

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                keys, _ = grams(*text_buffers(batch.column(2).slice(r, 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), batch.column(1).slice(r, 1), pa.array([keys.tobytes()], pa.binary())], names=["doc_id", "lang", "keys"])

    chosen = texts.where(F.col("k") <= max(1, landmarks // max(1, languages))).select("doc_id", "lang", "text")
    got = sorted(chosen.mapInArrow(keys_of, "doc_id long, lang string, keys binary").collect(), key=lambda r: (r.lang, r.doc_id, bytes(r.keys)))
    vocabulary, marks = landmark_rows([np.frombuffer(bytes(r["keys"]), np.uint64) for r in got])
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, marks))

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, marks = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS)
                keys, edge = grams(*text_buffers(part.column(2)))
                rows = found_in(vocabulary, keys, edge) @ marks.T / np.sqrt(np.maximum(np.diff(edge), 1))[:, None]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.astype(np.float32).tobytes() for r in rows], pa.binary())], names=["doc_id", "lang", "row"])

    rows = sorted(texts.select("doc_id", "lang", "text").mapInArrow(kernels, "doc_id long, lang string, row binary").collect(), key=lambda r: (r.doc_id, r.lang, bytes(r["row"])))
    return fit(np.stack([np.frombuffer(bytes(r["row"]), np.float32) for r in rows]), [r.lang for r in rows], vocabulary, marks)


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str] | None = None, inside: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` with ``lang_pred`` and ``score`` (the best value moved from [-1, 1] to [0, 1]).

    ``inside`` names a kept struct that holds ``text``, which then is not sent to Python a second time.
    """
    kept = ["doc_id", "text"] if keep is None else keep
    rows = spread(docs.select(*kept))
    at = kept.index(inside or "text")
    out_fields = [f for f in rows.schema.fields if keep is not None or f.name != "text"]
    names = [f.name for f in out_fields]
    schema = StructType([*out_fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(at) if inside is None else batch.column(at).field("text")
            buf, off = text_buffers(column)
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for i, j in slices(off, _SLICE):
                for k in range(i, j, _ROWS):
                    top = min(k + _ROWS, j)
                    part, edge = buf[off[k] : off[top]], off[k : top + 1] - off[k]
                    seen = np.append(0, np.cumsum(_LETTER[part]))
                    letters = seen[edge[1:]] > seen[edge[:-1]]
                    for r in np.flatnonzero(~letters):
                        letters[r] = has_letter(column[k + int(r)].as_py() or "")
                    if m is None or not letters.any():
                        continue
                    values = m.values(*grams(part, edge))
                    best = values.argmax(axis=1)
                    for r in np.flatnonzero(letters):
                        pred[k + r] = m.languages[best[r]]
                        score[k + r] = min(1.0, max(0.0, (float(values[r, best[r]]) + 1) / 2))
            arrays = [batch.column(rows_names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])
        trim()

    rows_names = rows.columns
    return rows.mapInArrow(run, schema)


def floors(docs: DataFrame, model: LanguageModel, sample_docs: int = SAMPLE_DOCS) -> dict[int, float]:
    """The least score of a known language per length of :data:`CUTS`, learnt from all held-out labelled texts cut to that length.

    The values of a text unlike every language sum to 2 less the number of languages, so at chance the score is one part
    in that number.  The floor lies halfway between chance and the score (a multiple of one part in :data:`STEPS`) that 99 of
    100 held-out texts reach.  No text is left out; those of a language with more than its part of ``sample_docs`` weigh
    as much as that part together, so a large language does not set the floor alone.
    Shorter texts, lengths with few held-out texts, and a model of one language have no floor.
    """
    if len(model.languages) < 2:
        return {}
    chance, each = 1 / len(model.languages), max(8, sample_docs // len(model.languages))
    rows = docs.where(held_out()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isin(model.languages) & F.col("text").isNotNull())
    cuts = F.filter(F.array(*map(F.lit, CUTS)), lambda c: c <= F.length("text"))
    starts = rows.select("lang", "text", F.explode(cuts).alias("cut")).select("cut", "lang", F.expr("substring(text, 1, cut)").alias("text"))
    scored = predict(starts, model, keep=["cut", "lang", "text"]).where("lang_pred <> 'und'")
    bins = scored.groupBy("cut", "lang", F.floor(F.col("score") * STEPS).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    of_lang = Window.partitionBy("cut", "lang")
    # whole numbers, so that sums do not hang on their order
    weight = F.floor(F.col("n") * (F.least(F.lit(each), F.sum("n").over(of_lang)) * _WEIGHT / F.sum("n").over(of_lang)))
    weighed = bins.withColumn("weight", weight).groupBy("cut", "bin").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for r in weighed.collect():  # a row per length and step at most
        found.setdefault(r.cut, []).append((r.bin, r.n, r.weight))
    out = {}
    for cut, steps in found.items():
        if sum(n for _, n, _ in steps) < LEAST_TEXTS:
            continue
        steps.sort()
        below = np.cumsum([0, *(w for _, _, w in steps)])
        reached = max(b for (b, _, _), under in zip(steps, below) if 100 * int(under) <= int(below[-1]))
        out[cut] = (chance + reached / STEPS) / 2
    return out


def identify(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and predict each of its rows: ``(doc_id, held_out, lang_pred, score)``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = predict(rows, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
