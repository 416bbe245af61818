"""Language identification in two steps: the family first, then linear support vector machines for pairs inside a family."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from footfall.llm.common import bound_batches, held_out, sampling_hash

#: Families of languages by ISO code (fixed values); a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "nb": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "ar": "semitic", "he": "semitic",
}
UNKNOWN = "und"
#: Hash buckets of byte trigrams; rows that all classifiers together are fitted on.
BUCKETS, SAMPLE = 1 << 13, 4000
#: Bytes of text turned into features at a time.
BLOCK = 1 << 20

_LIKE_LETTER = re.compile(r"[^\W\d_]")
# bytes that are no part of a letter become spaces, so that digits and marks say nothing
_PLAIN = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_SPACES = re.compile(rb" {2,}")


def has_letter(text: str) -> bool:
    """Whether a text holds a letter; signs that the pattern takes for one (superscripts, circled digits) are none."""
    return any(m[0].isalpha() for m in _LIKE_LETTER.finditer(text))


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the byte trigrams of the lower-cased text, in blocks; blocks overlap so that none is missed."""
    plain = b" " + _SPACES.sub(b" ", text.lower().encode("utf-8", "replace").translate(_PLAIN)).strip() + b" "
    for at in range(0, len(plain) - 2, BLOCK):
        b = np.frombuffer(plain, dtype=np.uint8)[at:at + BLOCK + 2].astype(np.uint32)
        yield ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def features(text: str) -> np.ndarray:
    """Root frequencies of the buckets, of length one."""
    counts = np.zeros(BUCKETS, dtype=np.float32)
    for codes in trigrams(text):
        counts += np.bincount(codes, minlength=BUCKETS)
    root = np.sqrt(counts)
    return root / max(float(np.sqrt(counts.sum())), 1.0)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 20, seed: int = 1) -> np.ndarray:
    """A linear support vector machine (hinge loss, dual coordinate descent); y is -1 or 1, classes weigh the same. Last weight: bias."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    w = np.zeros(d + 1, dtype=np.float64)
    alpha = np.zeros(n)
    most = np.where(y > 0, c * n / (2 * max((y > 0).sum(), 1)), c * n / (2 * max((y < 0).sum(), 1)))
    norm = (x.astype(np.float64) ** 2).sum(1) + 1.0
    for _ in range(rounds):
        for i in rng.permutation(n):
            gradient = y[i] * (x[i] @ w[:d] + w[d]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[:d] += step * x[i]
                w[d] += step
                alpha[i] = new
    return w


@dataclass
class Model:
    """One machine for each pair of families and for each pair of languages inside a family."""

    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    def _vote(self, names: list[str], x: np.ndarray) -> tuple[str, float]:
        """The name with most won pairs (ties: larger margins, then the earlier name) and how sure its narrowest win is."""
        if len(names) == 1:
            return names[0], 1.0
        won, margins = dict.fromkeys(names, 0), {n: [] for n in names}
        for a, b in combinations(names, 2):
            w = self.machines[a, b]
            m = float(x @ w[:-1] + w[-1])
            won[a if m >= 0 else b] += 1
            margins[a].append(m)
            margins[b].append(-m)
        best = max(names, key=lambda n: (won[n], sum(margins[n])))
        return best, 1 / (1 + float(np.exp(-2 * np.clip(min(margins[best]), -50, 50))))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, sure = self._vote(list(self.families), x)
        language, closer = self._vote(self.families[family], x)
        return language, sure * closer


def train(docs: DataFrame, sample_rows: int = SAMPLE, text_column: str = "text", label_column: str = "lang") -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs`` (about ``sample_rows`` in all, as many of each language).

    Rows without a text, letters or label are left out. The share of a language that is drawn follows from its count over
    all rows, and a hash of the row decides, so that the sample is the same on every run.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull() & (F.col(label_column) != UNKNOWN))
    counts = {r["label"]: r["n"] for r in rows.groupBy(F.col(label_column).alias("label")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model()
    each = max(sample_rows // len(counts), 1)
    shares = spark.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "label string, share double")
    picked = rows.select(F.col(label_column).alias("label"), F.col(text_column).alias("text"))
    # equal texts share a hash: they come or stay away together, and one of them is enough
    picked = picked.join(F.broadcast(shares), "label").filter(sampling_hash(F.col("text")) < F.col("share")).dropDuplicates(["label", "text"])
    labels, vectors = [], []
    schema = StructType([StructField("label", StringType()), StructField("x", BinaryType())])

    def to_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[has_letter(t) for t in batch["text"]]]
            yield pd.DataFrame({"label": batch["label"], "x": [zlib.compress(features(t).astype(np.float16).tobytes(), 1) for t in batch["text"]]})

    for r in picked.select("label", "text").mapInPandas(to_features, schema).orderBy("label", "x").toLocalIterator():
        labels.append(r["label"])
        vectors.append(np.frombuffer(zlib.decompress(r["x"]), dtype=np.float16))
    if not labels:
        return Model()
    x, y = np.array(vectors).astype(np.float32), np.array(labels)
    model = Model()
    for language in sorted(set(labels)):
        model.families.setdefault(FAMILIES.get(language, language), []).append(language)
    family = np.array([FAMILIES.get(v, v) for v in y])
    for names, of in ((list(model.families), family), *((v, y) for v in model.families.values())):
        for a, b in combinations(names, 2):
            among = (of == a) | (of == b)
            model.machines[a, b] = fit_svm(x[among], np.where(of[among] == a, 1, -1)).astype(np.float32)
    return model


def identify(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1); ``und`` and 0 for a null text or one without letters."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    @F.pandas_udf(out)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_found", predict(F.col(text_column))).withColumns(
        {"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")}).drop("_found")


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score. Only the text is an input."""
    bound_batches(docs.sparkSession)
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
