"""Toxicity by noisy-channel deobfuscation: obfuscated spans are decoded under a character model, then the restored text is scored."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from footfall.llm.common import bound_batches, held_out, sampling_hash, stored

#: What a character may stand for besides itself (fixed values).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
#: Channel costs in nats: a stand-in character, and a digit or mark kept as it is; a gap between single characters dropped and kept;
#: a gap next to a longer piece dropped (kept for nothing); a repeat dropped where a letter comes three times or stands alone, and else.
SWAP, KEEP_MARK, DROP_GAP, KEEP_GAP, DROP_PIECE, DROP_REPEAT, DROP_PAIR = 1.0, 9.0, 0.5, 4.0, 4.0, 1.0, 3.0
#: Words and stretches, and pairs of pieces, remembered by a worker, and the longest of them.
REMEMBERED, LONGEST_KNOWN = 100_000, 64
#: Labelled rows that the classifier is fitted on, about; traits it may use; toxic rows of the sample that a trait must occur in.
SAMPLE, TRAITS, LEAST_ROWS = 20_000, 200, 5
#: Traits of a word: itself, and its beginnings of so many bytes.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Characters counted at a time.
BLOCK = 1 << 20

# classes of the character model: 0 for all but letters, then a-z, then the letters of U+00E0 to U+00FF
STATES = 1 + 26 + 32
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[224:256] = np.arange(27, 59)
_CLASS[247] = 0
_CLASSES = _CLASS.tolist()

_L = "a-zà-öø-ÿ"
_M = re.escape("".join(LEET))
_G = r"\s.,:;/\\_*~\-"
#: Pieces of up to four characters, or of one character repeated, with any marks and spaces between them.
_PIECE = rf"(?:([{_L}{_M}])\%d{{4,}}|[{_L}{_M}]{{1,4}})(?![{_L}{_M}0-9])"
_PIECES = re.compile(rf"(?<![{_L}{_M}0-9]){_PIECE % 1}(?:[{_G}]++{_PIECE % 2})+")
_PARTS = re.compile(rf"[{_G}]+|[^{_G}]+")
_GAPS = re.compile(rf"[{_G}]+")
_ODD = re.compile(
    # a word with stand-ins among its letters
    rf"(?<![{_L}{_M}])(?:[{_L}]++(?:[0-9@$]|[!|+]++[{_L}])|[{_M}]++[{_L}])[{_L}{_M}]*(?<![!|+])"
    # a word with a letter repeated
    rf"|(?<![{_L}])[{_L}]*?(?P<letter>[{_L}])(?P=letter)[{_L}{_M}]*(?<![!|+])")
_PAIR = re.compile(rf"([{_L}])\1")
_LETTERS, _STAND_INS = re.compile(rf"[{_L}]"), re.compile(rf"[{_M}]")
# ASCII marks become spaces; letters of other scripts stay as bytes
_WORDS = bytes(b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def _classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)]


def char_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Counts of character trigrams over all texts of ``docs``; each partition counts into a table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(STATES ** 3, dtype=np.int64)
        for batch in batches:
            joined = " " + " ".join(batch["t"]).lower() + " "
            for at in range(0, len(joined) - 2, BLOCK):
                c = _classes(joined[at:at + BLOCK + 2])
                total += np.bincount((c[:-2] * STATES + c[1:-1]) * STATES + c[2:], minlength=STATES ** 3)
        codes = np.flatnonzero(total)
        yield pd.DataFrame({"code": codes, "n": total[codes]})

    schema = StructType([StructField("code", LongType()), StructField("n", LongType())])
    texts = docs.select(F.col(text_column).alias("t")).filter("t is not null")
    counts = np.zeros(STATES ** 3)
    for r in texts.mapInPandas(count, schema).groupBy("code").agg(F.sum("n").alias("n")).collect():
        counts[r["code"]] = r["n"]
    return counts.reshape(STATES, STATES, STATES)


def char_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """Negative log probabilities of a class after two others, backing off to one and none."""
    one = counts.sum((0, 1)) + 1.0
    one = one / one.sum()
    two = counts.sum(0) + weight * one[None, :]
    two = two / two.sum(1, keepdims=True)
    three = counts + weight * two[None, :, :]
    return -np.log(three / three.sum(2, keepdims=True)).astype(np.float32)


def _class(ch: str) -> int:
    return _CLASSES[ord(ch)] if ch and ord(ch) < 256 else 0


@dataclass(frozen=True)
class Piece:
    """What the decision about a gap needs of a piece beside it; of a longer one, which repeats a character, five are enough."""

    head: tuple[int, int]
    tail: tuple[int, int]
    unit: bool
    letters: bool
    stand_ins: bool


@lru_cache(REMEMBERED)
def _piece(text: str) -> Piece:
    k = [0, *map(_class, text[-2:])][-2:], [*map(_class, text[:2]), 0][:2]
    return Piece((k[1][0], k[1][1]), (k[0][0], k[0][1]), len(set(text)) == 1, bool(_LETTERS.search(text)), bool(_STAND_INS.search(text)))


class Memory(dict):
    """What ``found`` says of a key, remembered unless its text is long."""

    def __init__(self, found: Callable, size: Callable = len):
        super().__init__()
        self.found, self.size = found, size

    def __missing__(self, key):
        value = self.found(key)
        if self.size(key) <= LONGEST_KNOWN:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class Decoder:
    """Restores obfuscated spans of a lower-cased text.

    Spans are words with stand-ins, words with repeated letters and stretches of short pieces with any separators. A stretch goes
    over gaps that may hide a word: between single characters, beside a piece with stand-ins, or where the character model
    prefers the joined letters; a repeated letter counts where the model prefers it single. The lattice of the whole span decides.
    """

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.known = Memory(self.best)
        self.words = Memory(self._restored)
        self.gaps = Memory(lambda pair: self._hides(*pair), lambda pair: len(pair[0]) + len(pair[1]))

    def steps(self, span: str) -> Iterator[list[tuple[str, float]]]:
        """The lattice: for each character, and each gap as a whole, what may come out and its cost."""
        parts = _PARTS.findall(span)
        unit = [len(set(p)) == 1 for p in parts]
        gap = re.compile(f"[{_G}]").match
        before = ""
        for i, part in enumerate(parts):
            if gap(part):
                tight = 0 < i < len(parts) - 1 and unit[i - 1] and unit[i + 1]
                yield [("", DROP_GAP), (" ", KEEP_GAP)] if tight else [(" ", 0.0), ("", DROP_PIECE)]
                continue
            for at, ch in enumerate(part):
                options = [(c, SWAP) for c in LEET.get(ch, "")]
                options.append((ch, KEEP_MARK if options else 0.0))
                if ch == before:
                    pair = at > 0 and not unit[i] and part[at - 2:at - 1] != ch and part[at + 1:at + 2] != ch
                    options.append(("", DROP_PAIR if pair else DROP_REPEAT))
                yield options
                before = ch

    def best(self, span: str) -> str:
        """The cheapest path through the lattice of a span: channel costs and the costs of the characters that come out.

        The frontier holds one path for each pair of last characters, as links back; what all paths share is written out where
        they meet in one.
        """
        costs, out = self.costs, []
        paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}

        def letters(node: tuple | None) -> str:
            found = []
            while node is not None:
                found.append(node[1])
                node = node[0]
            return "".join(reversed(found))

        for step in self.steps(span):
            if len(paths) == len(step) == 1:
                # one path and one way on
                ((_, b),), c = paths, step[0][0]
                out.append(c)
                paths = {(b, _class(c)): (0.0, None)}
                continue
            options = [(c, cost, _class(c) if c else -1) for c, cost in step]
            further: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (total, node) in paths.items():
                for c, cost, k in options:
                    state, sum_ = ((a, b), total + cost) if k < 0 else ((b, k), total + cost + costs[a][b][k])
                    if state not in further or sum_ < further[state][0]:
                        further[state] = (sum_, (node, c) if c else node)
            paths = further
            if len(paths) == 1:
                (state, (_, node)), = paths.items()
                out.append(letters(node))
                paths = {state: (0.0, None)}
        _, _, node = min(((total + costs[a][b][0], (a, b), node) for (a, b), (total, node) in paths.items()), key=lambda p: p[:2])
        return "".join(out) + letters(node)

    def _hides(self, left: str, right: str) -> bool:
        """Whether a gap between two pieces may have been put into a word."""
        a, b = _piece(left[:5]), _piece(right[:5])
        if a.unit and b.unit or a.letters and a.stand_ins or b.letters and b.stand_ins:
            return True
        if a.stand_ins or b.stand_ins:
            return False
        c, (p, q), (r, s) = self.costs, a.tail, b.head
        return c[p][q][0] + c[q][0][r] + c[0][r][s] > c[p][q][r] + c[q][r][s] + DROP_PIECE

    def _joined(self, match: re.Match) -> str:
        """A run of short pieces, with its stretches over gaps that may hide a word decoded."""
        run = match[0]
        hides = list(map(self.gaps.__getitem__, pairwise(_GAPS.split(run))))
        return self._stretches(_PARTS.findall(run), hides) if True in hides else run

    def _stretches(self, parts: list[str], hides: list[bool]) -> str:
        names = parts[::2]
        out, first = [], 0
        for last, name in enumerate(names):
            if last < len(hides) and hides[last]:
                continue
            if first == last:
                out.append(name)
            else:
                stretch = [_piece(n[:5]) for n in names[first:last + 1]]
                # two single characters are an initial or a unit of measure; digits alone are numbers
                hidden = (len(stretch) > 2 or not all(p.unit for p in stretch)) and any(p.letters for p in stretch)
                text = "".join(parts[2 * first:2 * last + 1])
                out.append(self.known[text] if hidden else text)
            out += parts[2 * last + 1:2 * last + 2]
            first = last + 1
        return "".join(out)

    def _restored(self, span: str) -> str:
        if not _STAND_INS.search(span):
            c, padded = self.costs, f" {span} "
            for m in _PAIR.finditer(padded):
                p, q, r = _class(padded[m.start() - 1]), _class(m[1]), _class(padded[m.end()])
                if q == r or c[p][q][q] + c[q][q][r] > c[p][q][r] + DROP_PAIR:
                    break
            else:
                return span
        return self.best(span)

    def restore(self, text: str) -> str:
        words = self.words
        return _ODD.sub(lambda match: words[match[0]], _PIECES.sub(self._joined, text.lower()))


def words(restored: str) -> list[bytes]:
    return restored.encode("utf-8", "replace").translate(_WORDS).split()


def traits(word: bytes) -> list[bytes]:
    return [word + b" ", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Model:
    """The character model, and weights of the traits: for the logarithm of a trait's count and for its share of the words."""

    costs: np.ndarray
    index: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-50.0]))

    def __post_init__(self):
        self.starts = {t.rstrip(b" ")[:4] for t in self.index}

    def counts(self, found: list[bytes]) -> Counter:
        hits: Counter = Counter()
        starts, index = self.starts, self.index
        for w in found:
            if w[:4] in starts:
                hits.update(index[t] for t in traits(w) if t in index)
        return hits

    def row(self, hits: dict[int, int], n: int) -> np.ndarray:
        x = np.zeros(2 * len(self.index) + 1, dtype=np.float32)
        for k, c in hits.items():
            x[k] = np.log1p(c)
            x[len(self.index) + k] = min(100.0 * c / n, 5.0)
        x[-1] = 1.0
        return x

    def score(self, restored: str) -> float:
        found = words(restored)
        z = float(self.row(self.counts(found), max(len(found), 1)) @ self.weights)
        return 1 / (1 + float(np.exp(-np.clip(z, -50, 50))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column is the intercept, hardly shrunk."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        spread = (p * (1 - p) + 1e-6).astype(np.float32)
        step = np.linalg.solve((x * spread[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _restored(rows: DataFrame, decoder_costs) -> DataFrame:
    """``rows`` (toxic, text) with their texts restored."""

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(decoder_costs.value)
        for batch in batches:
            yield batch.assign(text=[decoder.restore(t) for t in batch["text"]])

    rows = rows.select("toxic", "text")
    return rows.mapInPandas(restore, rows.schema)


def _trait_counts(rows: DataFrame, wanted=None) -> DataFrame:
    """(trait, n): rows of restored texts that each trait occurs in; only ``wanted`` ones if given."""
    schema = StructType([StructField("trait", StringType()), StructField("n", LongType())])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Counter()
        keep = wanted.value if wanted is not None else None
        for batch in batches:
            for text in batch["text"]:
                seen = {t for w in set(words(text)) for t in traits(w)}
                total.update(seen if keep is None else seen & keep)
        names, counts = [t.hex() for t in total], list(total.values())
        for at in range(0, len(names), 20_000):
            yield pd.DataFrame({"trait": names[at:at + 20_000], "n": counts[at:at + 20_000]})

    return rows.select("text").mapInPandas(count, schema).groupBy("trait").agg(F.sum("n").alias("n"))


def _surprise(a: float, b: float, toxic: int, clean: int) -> float:
    """The log-likelihood ratio of a trait that occurs in a of the toxic and b of the clean rows."""
    def part(k: float, n: float, p: float) -> float:
        return (k * np.log(k / (n * p)) if k else 0.0) + ((n - k) * np.log((n - k) / (n * (1 - p))) if n > k else 0.0)
    p = (a + b) / (toxic + clean)
    return 2 * (part(a, toxic, p) + part(b, clean, p)) if 0 < p < 1 else 0.0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> Model:
    """Character model from all texts of ``docs``; classifier from about ``sample_rows`` rows that ``labels`` (doc_id, toxic) marks.

    A document marked more than once counts as toxic if any mark says so; marks that are null are left out. Without labelled
    rows of both kinds nothing is learnt and every score is next to 0.
    """
    spark = docs.sparkSession
    costs = char_model(char_counts(docs))
    model = Model(costs)
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    if not n:
        return model
    drawn = marks.filter(sampling_hash(F.col("doc_id")) < min(1.0, sample_rows / n))
    shared = spark.sparkContext.broadcast(costs)
    # a text is restored once; counts and design read it stored
    rows = stored(_restored(docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), shared), "labelled")
    sizes = {r["t"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return model
    often = _trait_counts(rows.filter("toxic > 0")).filter(F.col("n") >= LEAST_ROWS)
    toxic = {bytes.fromhex(r["trait"]): r["n"] for r in often.collect()}
    wanted = spark.sparkContext.broadcast(set(toxic))
    clean = {bytes.fromhex(r["trait"]): r["n"] for r in _trait_counts(rows.filter("toxic <= 0"), wanted).collect()}
    ranked = sorted((-_surprise(a, clean.get(t, 0), sizes[True], sizes[False]), t) for t, a in toxic.items()
                    if a / sizes[True] > clean.get(t, 0) / sizes[False])
    model = Model(costs, {t: k for k, (_, t) in enumerate(ranked[:TRAITS])})
    fitted = spark.sparkContext.broadcast(model)
    schema = StructType([StructField("toxic", IntegerType()), StructField("words", LongType()),
                         StructField("traits", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType()))])

    def design(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [words(t) for t in batch["text"]]
            hits = [fitted.value.counts(w) for w in found]
            yield pd.DataFrame({"toxic": (batch["toxic"] > 0).astype("int32"), "words": [len(w) for w in found],
                                "traits": [list(h) for h in hits], "counts": [list(h.values()) for h in hits]})

    picked = rows.mapInPandas(design, schema).collect()
    x = np.array([model.row(dict(zip(r["traits"], r["counts"], strict=True)), max(r["words"], 1)) for r in picked])
    model.weights = fit_logistic(x, np.array([r["toxic"] for r in picked], dtype=np.float64))
    return model


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: toxic likelier) and predicted (1 from 0.5); a null text is scored as an empty one."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = shared.value
        decoder = Decoder(fitted.costs)
        for texts in batches:
            yield pd.Series([fitted.score(decoder.restore(t)) for t in texts], dtype="float64")

    udf = F.pandas_udf(scored, DoubleType())
    out = docs.withColumn("score", udf(F.coalesce(F.col(text_column), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and score all: doc_id, held_out, score, predicted. Only the text is an input."""
    bound_batches(docs.sparkSession)
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
