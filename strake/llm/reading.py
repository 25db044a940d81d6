"""Reading level of documents.

A text is split into sentences and words; syllables are counted by the vowel nuclei left after each language's
hyphenation-style rules. From these come the classic formulas' grades. Each formula's grade is mapped to the graders'
scale together with the level of the text's vocabulary, and the text's level is the median of these estimates. The
vocabulary takes the place of the lists of familiar words that some formulas use: a word's level is the mean grade of
the graded texts that hold it, a text's the median over its words.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import checkpoint
from .leaks import _BROKEN, _TAG, _mend

# Common function words; fixed values.
FUNCTION_WORDS = {
    "en": "the and is it was for my with that this of to in a not but they we she he his her you as on at by from which be one its can are",
    "de": "der die das und ist es war mein meine ich er sie nicht mit für auf ein eine einen dem den des zu im sich wir aber jetzt dann",
    "fr": "le la les et est il elle mon ma une un des pas pour que qui dans sur avec ce ne se du au sa son très mais puis",
    "es": "el la los las y es mi una un con para que no en por se lo su del al muy pero como más era está fue",
    "pt": "o os as e é meu minha uma um com para que não em por se do da dos das muito mas como mais foi está",
    "it": "il lo gli e è mio mia una un con per che non in di si del della dei molto ma come più era sono",
}
_STOP = {lang: set(w.split()) for lang, w in FUNCTION_WORDS.items()}
_PRODUCT = re.compile(r"\([^()]{0,60}\d[^()]{0,20}\)")
_SENTENCE = re.compile(r"[.!?…:;]+(?=\s|$)|\n\s*\n")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NUCLEUS = {
    "en": re.compile(r"[aeiouy]+"), "de": re.compile(r"ei|ie|au|eu|äu|ai|aa|ee|oo|[aeiouyäöü]"), "fr": re.compile(r"[aeiouyàâäéèêëîïôöùûüœæ]+"),
    "es": re.compile(r"[iuü]?[aeoáéíóú][iuy]?|[iuü]+"), "pt": re.compile(r"[iu]?[aeoáéíóúâêôãõà][iu]?|[iu]+"), "it": re.compile(r"[iu]?[aeoàèéìòù][iu]?|[iu]+"),
}
_SILENT = {"en": re.compile(r"(?<=[^aeiouyl])(?:e|es|ed)$|(?<=[aeiouy]l)es?$"), "fr": re.compile(r"(?<=[^aeiouyéèê])(?:es?|ent)$")}
GRADES = (1, 5)
_SYLLABLES: dict[str, dict[str, int]] = {}


def clean(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        for _ in range(2):
            text = _BROKEN.sub(_mend, text)
        text = unicodedata.normalize("NFC", text)
    return _PRODUCT.sub(" ", text)


def language(n: Counter) -> str:
    """The language of most function words among counted words."""
    score = {lang: sum(n[w] for w in stop & n.keys()) for lang, stop in _STOP.items()}
    best = max(score, key=lambda x: (score[x], x == "en"))
    return best if score[best] else "en"


def syllables(word: str, lang: str) -> int:
    if lang in _SILENT and len(word) > 3:
        word = _SILENT[lang].sub("", word)
    return max(1, len(_NUCLEUS[lang].findall(word)))


@dataclass
class Read:
    """What the formulas need of a text."""

    lang: str
    words: list[str]
    grades: dict[str, float]


def read(text: str) -> Read | None:
    """None for text that is no prose: too few words or too few different ones, mostly digits or repeats."""
    text = clean(text)
    sentences = [w for w in (_WORD.findall(s.lower()) for s in _SENTENCE.split(text)) if w]
    words = [w for s in sentences for w in s]
    letters, count = sum(map(len, words)), Counter(words)
    if len(words) < 20 or len(count) < 8 or letters < 0.5 * sum(map(len, text.split())) or max(count.values()) > 0.5 * len(words) or letters / len(words) > 20:
        return None
    lang = language(count)
    n, m = len(words), len(sentences)
    seen = _SYLLABLES.setdefault(lang, {})
    if len(seen) > 200_000:
        seen.clear()
    syl = [seen[w] if w in seen else seen.setdefault(w, syllables(w, lang)) for w in words]
    asl, asw, cpw = n / m, sum(syl) / n, letters / n
    hard = sum(x >= 3 for x in syl)
    long = sum(len(w) > 6 for w in words)
    return Read(lang, words, {
        "kincaid": 0.39 * asl + 11.8 * asw - 15.59,
        "ease": 0.846 * asw * 100 + 1.015 * asl - 206.835,
        "fog": 0.4 * (asl + 100 * hard / n),
        "smog": 1.043 * (30 * hard / m) ** 0.5 + 3.1291,
        "ari": 4.71 * cpw + 0.5 * asl - 21.43,
        "coleman": 5.88 * cpw - 29.6 * m / n - 15.8,
        "lix": asl + 100 * long / n,
    })


FORMULAS = ("kincaid", "ease", "fog", "smog", "ari", "coleman", "lix")
PRIOR = 1.0  # texts of mean grade added to each word


@dataclass
class Levels:
    """Fitted to graded texts: level of each (language, word) and, a formula, the weights of (1, its grade, vocabulary)."""

    mean: float
    words: dict[str, dict[str, float]]
    weights: dict[str, tuple[float, float, float]]

    def vocabulary(self, r: Read) -> float:
        known = self.words.get(r.lang, {})
        got = [known[w] for w in r.words if w in known]
        return _median(got) if got else self.mean

    def level(self, text: str) -> float | None:
        r = read(text)
        if r is None:
            return None
        v = self.vocabulary(r)
        est = [a + b * r.grades[f] + c * v for f, (a, b, c) in self.weights.items()]
        return float(min(max(_median(est), GRADES[0]), GRADES[1]))


def _median(values: list[float]) -> float:
    x = sorted(values)
    return (x[len(x) // 2] + x[(len(x) - 1) // 2]) / 2


def _fold(doc_id: int) -> int:
    return hashlib.blake2b(str(doc_id).encode(), digest_size=1).digest()[0] & 1


def _word_levels(rows: list, mean: float, fold: int | None) -> dict[str, dict[str, float]]:
    """Of rows (lang, word, sum and number of grades in fold 0, and in fold 1); fold: the one left out."""
    out: dict[str, dict[str, float]] = {}
    for lang, w, s0, n0, s1, n1 in rows:
        s, n = (0 if fold == 0 else s0) + (0 if fold == 1 else s1), (0 if fold == 0 else n0) + (0 if fold == 1 else n1)
        if n:
            out.setdefault(lang, {})[w] = (s + PRIOR * mean) / (n + PRIOR)
    return out


def fit_levels(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", max_graded: int = 20_000) -> Levels | None:
    """Levels fitted to at most ``max_graded`` graded documents (those of the smallest hashes of their ids).

    Grades off the scale and NULL are ignored, several grades of a document averaged. The words' levels and the weights are
    fitted on different halves in turn, so that the weights don't trust words more than they deserve. None without grades.
    """
    graded = labels.where(F.col(grade).between(*GRADES) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("_id")).agg(F.avg(grade).alias("_grade"))
    graded = graded.orderBy(F.xxhash64("_id"), "_id").limit(max_graded)
    mine = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(graded), "_id")  # of bounded size
    mine = checkpoint(mine)  # read twice, for the words and for the weights

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple, list] = {}
            for i, t, g in zip(*(c.to_pylist() for c in b.columns)):
                if (r := read(t)) is not None:
                    k = 2 * _fold(i)
                    for w in set(r.words):
                        x = out.setdefault((r.lang, w), [0.0, 0, 0.0, 0])
                        x[k] += g
                        x[k + 1] += 1
            rows = [(*k, *v) for k, v in out.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "word", "s0", "n0", "s1", "n1"])

    counted = mine.mapInArrow(words, "lang string, word string, s0 double, n0 bigint, s1 double, n1 bigint")
    rows = [tuple(r) for r in counted.groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in ("s0", "n0", "s1", "n1")]).collect()]  # words of the bounded sample
    if not rows:
        return None
    mean = float(graded.agg(F.avg("_grade")).first()[0])
    halves = [Levels(mean, _word_levels(rows, mean, f), {}) for f in (0, 1)]
    held = docs.sparkSession.sparkContext.broadcast(halves)
    cols = [*FORMULAS, "vocabulary", "grade"]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, t, g in zip(*(c.to_pylist() for c in b.columns)):
                if (r := read(t)) is not None:
                    out.append((*(r.grades[f] for f in FORMULAS), held.value[_fold(i)].vocabulary(r), g))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*out)], names=cols)

    x = np.array([tuple(r) for r in mine.mapInArrow(features, ", ".join(f"{c} double" for c in cols)).collect()])
    weights = {}
    for k, f in enumerate(FORMULAS):
        v = x[:, k]
        mid, scale = float(np.mean(v)), float(np.std(v)) or 1.0
        a = np.column_stack([np.ones(len(x)), (v - mid) / scale, x[:, -2] - mean])
        w = np.linalg.solve(a.T @ a + np.diag([1e-9, 1.0, 0.1]), a.T @ x[:, -1])
        weights[f] = (float(w[0] - w[1] * mid / scale - w[2] * mean), float(w[1] / scale), float(w[2]))
    return Levels(mean, _word_levels(rows, mean, None), weights)


def reading_levels(docs: DataFrame, levels: Levels | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level) with the level on the graders' scale 1..5, or NULL.

    NULL for NULL and empty texts, for texts that are no prose, and without fitted levels. Texts are read whole; repeated
    rows stay repeated.
    """
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if t is None or held.value is None else held.value.level(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], names=["doc_id", "level"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, level double")
