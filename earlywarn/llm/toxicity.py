"""Toxicity scores of restored text.

A noisy channel explains odd spellings: a writer picks a word and disguises letters as digits or signs, repeats letters, or puts blanks or
dots between them. For each suspicious span, of any length, the lattice of letters that its characters may stand for is decoded by Viterbi search under a
character language model, where a separator is dropped or ends a word; the reading replaces the span when it beats the literal one by more than the cost of the channel. The restored
text is then scored by a logistic model over the words and word beginnings in it.

All labelled rows are learnt from, except held-out ones (``crc32(id) mod 3 = 1``). The character model is counted on all words of the same rows, of any length.

Defined cases: null and empty texts have no features and get the base score; repeated labels of a document count as toxic if one does; null
labels are ignored; without labels, or with one class only, the score is the smoothed base rate; an empty table gives no rows; other columns pass through.

Plan: labels meet the documents in a join, and the labelled texts are written once; n-grams of characters are counted in Spark; counts of all features of the restored texts are summed in Spark and only the ``FEATURES``
best leave it. Rows with the same of these features and the same label are one row with a weight, to which MLlib fits the logistic model: no row reaches the driver. Scoring is one narrow pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import textkit as tk
from earlywarn.llm.storage import materialize

FEATURES = 4096
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.7
#: How much commoner in toxic rows a feature must be.
RATIO = 4.0
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Costs of the channel in nats: a disguised letter, a dropped repetition, a dropped separator, and the gain that a reading must bring.
DISGUISE, REPEAT, GAP, MARGIN = 1.5, 1.0, 0.7, 1.0
ORDER = 4
#: Longer spans are decoded each time, so that the cache stays small.
LONGEST_CACHED = 64

_SIGN = r"[0-9@$!|+(€£]"
_L = r"[A-Za-zÀ-ÖØ-öø-ÿ]"
_TRIPLE = "|".join(f"[{c}{c.upper() if len(c.upper()) == 1 else ''}]{{3,}}" for c in map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_SPACED = rf"(?:{_L}|[0-9@$!|])(?:[ .\-_*]{{1,2}}(?:{_L}|[0-9@$!|])){{3}}"
#: Finds every text with a match of ``SPAN`` (RE2 has neither back references nor assertions, so those are left out).
SUSPECT = rf"{_SIGN}{_L}|{_L}{_SIGN}|{_TRIPLE}|{_SPACED}"
#: Separators between letters, and signs that are punctuation unless they read as a letter.
SEPARATORS, PUNCTUATION = " .-_*", "!|+("
SPAN = re.compile(rf"(?<![^\W\d_])(?:{_L}|[0-9@$!|])(?:[ .\-_*]{{1,2}}(?:{_L}|[0-9@$!|])(?![^\W_])){{3,}}|(?:{_L}|{_SIGN})*(?:{_SIGN}{_L}|{_L}{_SIGN})(?:{_L}|{_SIGN})*|{_L}*({_L})\1\1{_L}*", re.I)


class CharModel:
    """Character n-grams with back-off, over lower-cased words framed by blanks."""

    def __init__(self, words: dict[str, int]):
        grams: Counter = Counter()
        for w, n in words.items():
            framed = " " * (ORDER - 1) + w + " "
            for i in range(len(framed) - ORDER + 1):
                grams[framed[i : i + ORDER]] += n
        self._set(grams)

    @classmethod
    def of(cls, grams: dict[str, int]) -> CharModel:
        """From the counts of the longest n-grams of framed words; those of shorter ones follow, as each position ends one of every length."""
        model = cls.__new__(cls)
        model._set(grams)
        return model

    def _set(self, grams: dict[str, int]) -> None:
        self.counts: list[dict[str, int]] = [defaultdict(int) for _ in range(ORDER + 1)]
        for g, n in grams.items():
            for k in range(1, ORDER + 1):
                self.counts[k][g[-k:]] += n
        self.total = max(1, sum(self.counts[1].values()))
        self.context: list[dict[str, int]] = [defaultdict(int) for _ in range(ORDER)]
        for k in range(1, ORDER):
            for g, n in self.counts[k + 1].items():
                self.context[k][g[:-1]] += n
        self.letters = {g for g in self.counts[1] if g != " "}

    def cost(self, history: str, c: str) -> float:
        """Negative log probability of ``c`` after ``history`` (Witten-Bell-like interpolation by fixed share)."""
        p = (self.counts[1].get(c, 0) + 0.1) / (self.total + 20)
        for k in range(1, ORDER):
            h = history[-k:]
            n = self.context[k].get(h, 0)
            if not n:
                break
            p = 0.15 * p + 0.85 * self.counts[k + 1].get(h + c, 0) / n
        return -math.log(p)

    def word_cost(self, w: str) -> float:
        h, total = " " * (ORDER - 1), 0.0
        for c in w + " ":
            total += self.cost(h, c)
            h = (h + c)[-(ORDER - 1) :]
        return total


def decode(span: str, model: CharModel) -> str:
    """The best reading of a span, or the span itself."""
    seen, blank = span.lower(), " " * (ORDER - 1)
    if not any(c.isalpha() for c in seen):
        return span
    # state: last letters, all blank at the start of a word; value: cost and reading, linked from its end
    beam: dict[str, tuple[float, tuple | None]] = {blank: (0.0, None)}
    for c in seen:
        after: dict[str, tuple[float, tuple | None]] = {}

        def reach(h: str, cost: float, read: tuple | None, after=after) -> None:
            if h not in after or cost < after[h][0]:
                after[h] = (cost, read)

        for h, (cost, read) in beam.items():
            options = [(c, 0.0)] if c.isalpha() else [(x, DISGUISE) for x in LEET.get(c, "")]
            for x, extra in options:
                reach((h + x)[-(ORDER - 1) :], cost + extra + model.cost(h, x), (read, x))
                if h[-1] == x:
                    reach(h, cost + REPEAT, read)
            if c in SEPARATORS:
                if h == blank:
                    reach(h, cost, read)
                else:
                    reach(h, cost + GAP, read)
                    reach(blank, cost + model.cost(h, " "), (read, " "))
            elif c in PUNCTUATION:
                reach(blank, cost if h == blank else cost + model.cost(h, " "), (read, c))
            elif not options:
                reach((h + c)[-(ORDER - 1) :], cost + model.cost(h, c), (read, c))
        beam = after
    cost, read = min(((cost if h == blank else cost + model.cost(h, " "), read) for h, (cost, read) in beam.items()), key=lambda x: x[0])
    literal = sum(model.word_cost(w) for w in re.split(r"[ .\-_*!|+(]+", seen) if w)
    if cost + MARGIN >= literal:
        return span
    letters = []
    while read is not None:
        read, x = read
        letters.append(x)
    return "".join(reversed(letters))


def restore(text: str, model: CharModel, cache: dict[str, str]) -> str:
    """The text with its suspicious spans decoded."""

    def one(m: re.Match) -> str:
        s = m[0]
        if len(s) > LONGEST_CACHED:
            return decode(s, model)
        if s not in cache:
            if len(cache) > 200_000:
                cache.clear()
            cache[s] = decode(s, model)
        return cache[s]

    return SPAN.sub(one, text)


def restored(column: pa.Array, model: CharModel | None, cache: dict[str, str]) -> pa.Array:
    column = pc.fill_null(column, "")
    if model is None:
        return column
    odd = np.flatnonzero(pc.match_substring_regex(column, SUSPECT).to_numpy(zero_copy_only=False))
    if not len(odd):
        return column
    fixed = pa.array([restore(column[int(i)].as_py(), model, cache) for i in odd], column.type)
    mask = np.zeros(len(column), bool)
    mask[odd] = True
    return pc.replace_with_mask(column, pa.array(mask), fixed)


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit feature of every word and word beginning; words are runs of letters and digits, lower-cased."""
    w = tk.words(buf, off, tk.ALNUM_WORDS)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, values = [w.row], [tk.word_hashes(w)]
    for k in PREFIXES:
        long = np.flatnonzero(w.end - w.start > k)
        part = w._replace(start=w.start[long], end=w.start[long] + k)
        rows.append(w.row[long])
        values.append(tk.mix(tk.word_hashes(part) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(values)


def _present(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def held_out(doc_id) -> object:
    """Whether a row is held out from learning: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Scorer:
    """Weights of the selected features (sorted hashes), the bias, and the character model."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, chars: CharModel | None):
        self.keys, self.weights, self.bias, self.chars = keys, weights, bias, chars

    def scores(self, column: pa.Array, cache: dict[str, str]) -> np.ndarray:
        total = np.full(len(column), self.bias)
        small = np.zeros(1 << 16, bool)
        small[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for lo, hi, buf, off in tk.chunks(restored(column, self.chars, cache)):
            rows, values = features(buf, off)
            near = np.flatnonzero(small[(values & np.uint64(0xFFFF)).astype(np.int64)])
            rows, values = rows[near], values[near]
            at = np.minimum(np.searchsorted(self.keys, values), max(len(self.keys) - 1, 0))
            hit = self.keys[at] == values if len(self.keys) else np.zeros(len(values), bool)
            r, v = _present(rows[hit], at[hit].astype(np.uint64))
            total[lo:hi] += np.bincount(r, weights=self.weights[v.astype(np.int64)], minlength=hi - lo)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_logistic(rows: DataFrame, width: int, total: int, penalty: float = 0.05, steps: int = 300) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on binary features: ``x`` (the features of a row, as packed 32-bit numbers), ``y`` and ``w`` (how many of the ``total`` rows it stands for). MLlib minimises the mean loss, so the penalty is a share of it."""
    vector = F.udf(lambda x: Vectors.sparse(width, np.frombuffer(x, np.int32), np.ones(len(x) // 4)), VectorUDT())
    model = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", regParam=penalty / total, standardization=False, maxIter=steps, tol=1e-9).fit(rows.select(vector("x").alias("v"), (F.col("y") == 1).cast("double").alias("y"), F.col("w").cast("double").alias("w")))
    return model.coefficients.toArray(), float(model.intercept)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Learn a scorer from labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    rows = materialize(docs.where(~held_out(F.col(doc_id))).select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(known.hint("merge"), "_id").select("_t", "_y"))  # the same plan at every size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, cache = model.value, {}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            pos, neg = [], []
            for lo, _, buf, off in tk.chunks(restored(batch.column(0), chars, cache)):
                r, v = _present(*features(buf, off))
                toxic = y[r + lo] == 1
                pos.append(v[toxic])
                neg.append(v[~toxic])
            values = np.concatenate([*pos, *neg]) if pos else np.zeros(0, np.uint64)
            f, inverse = np.unique(values, return_inverse=True)
            p = np.bincount(inverse[: sum(map(len, pos))], minlength=len(f))
            n = np.bincount(inverse, minlength=len(f)) - p
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["f", "p", "n"])

    tally = rows.groupBy("_y").count().collect()
    n_pos = sum(r["count"] for r in tally if r._y == 1)
    n_neg = sum(r["count"] for r in tally if r._y != 1)
    base = math.log((n_pos + 1) / (n_neg + 1))
    if not n_pos or not n_neg:
        return Scorer(np.zeros(0, np.uint64), np.zeros(0), base, None)
    ratio = (F.col("p") + 0.5) / (n_pos + 1) / ((F.col("n") + 0.5) / (n_neg + 1))
    gain = (F.col("p") + 0.5) * F.log(ratio)
    letters = _characters(rows)
    model = spark.sparkContext.broadcast(letters)
    best = rows.mapInArrow(count, "f long, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where((F.col("p") >= 3) & (ratio > RATIO)).orderBy(F.desc(gain), "f").limit(FEATURES).select("f").collect()
    keys = np.sort(np.array([r.f for r in best], dtype=np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast(keys)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, chars, cache = sent.value, model.value, {}
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            out: list[bytes] = []
            for lo, hi, buf, off in tk.chunks(restored(batch.column(0), chars, cache)):
                r, v = features(buf, off)
                at = np.minimum(np.searchsorted(keys, v), max(len(keys) - 1, 0))
                hit = keys[at] == v if len(keys) else np.zeros(len(v), bool)
                r, v = _present(r[hit], at[hit].astype(np.uint64))
                out += [v[r == k].astype(np.int32).tobytes() for k in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(y.astype(np.int32))], names=["x", "y"])

    if not len(keys):
        return Scorer(keys, np.zeros(0), math.log(n_pos / n_neg), letters)
    fitted = materialize(rows.mapInArrow(present, "x binary, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    w, b = fit_logistic(fitted, len(keys), n_pos + n_neg)
    return Scorer(keys, w, b, letters)


@cache
def _alphabet() -> tuple[str, np.ndarray]:
    """The characters that decoding looks up, a blank first and a stand-in for all others last, and the place of every code point among them."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    known = " " + "".join(sorted(set("".join(re.findall(_L, every, re.I)).lower()))) + "\uffff"
    place = np.full(0x110000, len(known) - 1, np.uint8)
    place[[ord(c) for c in known]] = np.arange(len(known))
    return known, place


def _grams(words: Counter) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``ORDER`` characters of framed words, as four bytes of places in the alphabet, and their counts."""
    place, pad = _alphabet()[1], " " * (ORDER - 1)
    sizes, n = np.array([len(w) + ORDER for w in words], np.int64), np.array(list(words.values()), np.int64)
    at = place[np.frombuffer("".join(pad + w + " " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint32)
    codes = np.zeros(max(len(at) - ORDER + 1, 0), np.uint32)
    for k in range(ORDER):
        codes = codes << np.uint32(8) | at[k : k + len(codes)]
    inside = np.ones(len(at), bool)
    for k in range(1, ORDER):
        inside[np.cumsum(sizes) - k] = False  # those would run into the next word
    grams, inverse = np.unique(codes[inside[: len(codes)]], return_inverse=True)
    return grams, np.bincount(inverse, weights=np.repeat(n, sizes - ORDER + 1), minlength=len(grams)).astype(np.int64)


def _characters(rows: DataFrame) -> CharModel | None:
    """The character model of all words of the labelled rows, toxic ones counted tenfold. Its n-grams are counted in Spark; letters that no span can hold count as one, so the driver's share is bounded by the alphabet, whatever the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if y == 1 else other).update(re.findall(r"[^\W\d_]+", (t or "").lower()))
            for w, n in toxic.items():
                other[w] += 10 * n
            if other:
                g, n = _grams(other)
                yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n)], names=["g", "n"])

    known, _ = _alphabet()
    found = rows.mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    grams = {"".join(known[r.g >> 8 * k & 255] for k in reversed(range(ORDER))): r.n for r in found.toLocalIterator()}
    return CharModel.of(grams) if grams else None


def score(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of label 1 as a last column."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, str] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(at), cache))], names=[*names, "_s"])

    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)) + ", _s double"
    got = docs.toDF(*names).mapInArrow(run, schema)
    return got.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), F.col("_s").alias(out))


def restore_text(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "restored") -> DataFrame:
    """``docs`` with the deobfuscated text as a last column."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.pandas_udf("string")
    def fixed(s: pd.Series) -> pd.Series:
        model, cache = sent.value.chars, {}
        return s.map(lambda t: restore(t, model, cache) if t and model else t or "")

    return docs.withColumn(out, fixed(text))
