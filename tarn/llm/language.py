"""Language ID by hierarchical discrimination: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams (1 to 4) of the whole text in lower case, with everything but letters as one space; their square roots,
scaled to length 1. The SVMs (squared hinge, dual coordinate descent) are fitted on at most SAMPLE rows of each label,
drawn by hash, on the driver; all rows are then scored where they are. A letter is what str.isalpha says.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.common import compact, map_columns, read_table

#: Rows of each label that the model is fitted on, at most; with more labels than FULL_LABELS each has fewer, but one. What comes to the
#: driver is bounded by that: SAMPLE * FULL_LABELS rows, or one for each label.
SAMPLE, FULL_LABELS = 1000, 200
BITS, ORDERS = 12, (1, 2, 3, 4)
EPOCHS, C = 12, 10.0
HELD_OUT = 2
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: \w has numbers that str.isalpha does not call letters: superscripts, fractions, Roman numerals. Those of the basic plane as a pattern, which is
#: quick, and all for the rare texts that go beyond it.
NUMBERS = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
PLAIN_NUMBERS, ALL_NUMBERS = re.compile(f"[{''.join(c for c in NUMBERS if c <= chr(0xFFFF))}]"), dict.fromkeys(map(ord, NUMBERS), " ")
BEYOND = re.compile("[\U00010000-\U0010ffff]")
#: Families of ISO 639 codes. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
}


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang.split("-")[0].lower() in codes.split()), lang)


def letters_of(text: str | None) -> str:
    """The text in lower case with everything but letters as one space, none at its ends."""
    line = (text or "").lower()
    if not line.isascii():
        line = line.translate(ALL_NUMBERS) if BEYOND.search(line) else PLAIN_NUMBERS.sub(" ", line)
    return NOT_LETTERS.sub(" ", line).strip()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text; none if it has no letter. Long texts are counted in blocks, whole."""
    line = f" {letters_of(text)} "
    if len(line) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    data, counts = np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8), np.zeros(1 << BITS, np.int64)
    block, most = 1 << 20, max(ORDERS)
    for at in range(0, len(data), block):
        part = data[at : at + block + most - 1].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, most + 1):
            code = (code[: len(part) - n + 1] * np.uint32(0x01000193)) ^ part[n - 1 :] if n > 1 else part ^ np.uint32(0x811C9DC5)
            if not len(code):
                break
            own = code[:block]
            if n in ORDERS:
                counts += np.bincount(((own + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at].astype(np.float64))
    return at.astype(np.int32), (values / np.linalg.norm(values)).astype(np.float32)


Row = tuple[np.ndarray, np.ndarray]


def fit_svm(rows: list[Row], y: np.ndarray, c: float = C, epochs: int = EPOCHS) -> np.ndarray:
    """Weights and, last, the bias; y is 1 or -1, a row's values have length 1. Dual coordinate descent for the squared hinge, classes weighted alike."""
    n, up = len(y), max(1, int((y > 0).sum()))
    diagonal = np.where(y > 0, up, max(1, n - up)) / (c * n)
    w, a, rng = np.zeros((1 << BITS) + 1), np.zeros(n), np.random.default_rng(42)
    for _ in range(epochs):
        for k in rng.permutation(n):
            at, values = rows[k]
            new = max(0.0, a[k] - (y[k] * (w[at] @ values + w[-1]) - 1 + diagonal[k] * a[k]) / (2 + diagonal[k]))
            if new != a[k]:
                step = (new - a[k]) * y[k]
                w[at] += step * values
                w[-1] += step
                a[k] = new
    return w


class Hierarchy:
    """The fitted model: one SVM per family against the rest, one per pair of languages of a family."""

    def __init__(self, rows: list[Row], langs: list[str]) -> None:
        self.labels = sorted(set(langs))
        of = np.array([family_of(v) for v in langs])
        lang = np.array(langs)
        self.families = sorted(set(of.tolist()))
        self.members = {f: sorted(set(lang[of == f].tolist())) for f in self.families}
        self.top = np.array([fit_svm(rows, np.where(of == f, 1, -1)) for f in self.families]) if len(self.families) > 1 else np.zeros((1, (1 << BITS) + 1))
        self.pairs = {(a, b): fit_svm([rows[k] for k in m], np.where(lang[m] == a, 1, -1)) for f in self.families for a, b in combinations(self.members[f], 2) if len(m := np.flatnonzero((lang == a) | (lang == b)))}

    def predict(self, at: np.ndarray, values: np.ndarray) -> tuple[str, float]:
        """Language and score: how sure the family and the closest duel are, through the logistic function."""
        if not len(at):
            return UNKNOWN, 0.0
        tops = self.top[:, at] @ values + self.top[:, -1]
        f = int(np.argmax(tops))
        score = 1.0 if len(tops) == 1 else 1 / (1 + math.exp(-min(30.0, 2 * (float(tops[f]) - float(np.partition(tops, -2)[-2])))))
        members = self.members[self.families[f]]
        votes, margins = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
        duels = {}
        for a, b in combinations(members, 2):
            m = duels[a, b] = float(self.pairs[a, b][at] @ values + self.pairs[a, b][-1])
            votes[a if m >= 0 else b] += 1
            margins[a] += m
            margins[b] -= m
        won = max(members, key=lambda v: (votes[v], margins[v]))
        own = [m if a == won else -m for (a, b), m in duels.items() if won in (a, b)]
        if own:
            score *= 1 / (1 + math.exp(-max(-30.0, min(30.0, 4 * min(own)))))
        return won, score


def fit(docs: DataFrame) -> Hierarchy | None:
    """The model of labelled rows that are not held out; None if there are none."""
    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT))
    counts = learn.groupBy("lang").count().collect()
    if not counts:
        return None
    each = max(1, SAMPLE * FULL_LABELS // max(FULL_LABELS, len(counts)))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], 1.2 * (each + 10) / r["count"])])
    # a uniform draw by hash of a few rows more than needed, of which each label's first are taken; only their features leave the executors
    h = F.xxhash64("doc_id", "text")
    drawn = learn.select("lang", "text", h.alias("h")).where((F.col("h").bitwiseAND(F.lit((1 << 30) - 1)) / (1 << 30)) < share[F.col("lang")])
    draw = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= each).select("lang", "text")

    def count(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            found = [features(t) for t in x["text"]]
            yield {"lang": x["lang"], "at": [a.tobytes() for a, _ in found], "values": [v.tobytes() for _, v in found]}

    rows = [(r.lang, np.frombuffer(r.at, np.int32), np.frombuffer(r["values"], np.float32)) for r in map_columns(draw, count, "lang string, at binary, values binary").toLocalIterator() if r.at]
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # the same order each time
    if not rows:
        return None
    return Hierarchy([(at, values) for _, at, values in rows], [r[0] for r in rows])


def predicted(model: Hierarchy | None, text: str | None) -> tuple[str, float]:
    return model.predict(*features(text)) if model else (UNKNOWN, 0.0)


def has_letter(text: str | None) -> bool:
    return bool(letters_of(text))


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, lang_pred and score of each row. Null texts, texts without a letter, and all where no model was learned: und, 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # (families + pairs) * 2^BITS weights

    def run(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            found = [predicted(held.value, t) for t in x["text"]]
            yield {"doc_id": x["doc_id"], "lang_pred": [v for v, _ in found], "score": [s for _, s in found]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double", rows=256)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that language ID rejects: null texts and texts without a letter. That no model was learned, or one of a label
    und, rejects nothing. A null lang becomes the predicted one where a model was learned; other columns stay. An empty table gives no rows."""
    held, names = docs.sparkSession.sparkContext.broadcast(fit(docs)), docs.columns

    def keep(rows: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for x in rows:
            found = [predicted(held.value, t)[0] for t in x["text"]]
            on = [k for k, (t, v) in enumerate(zip(x["text"], found, strict=True)) if v != UNKNOWN or has_letter(t)]
            langs = [v if lang is None and v != UNKNOWN else lang for lang, v in zip(x["lang"], found, strict=True)]
            yield {c: [langs[k] if c == "lang" else x[c][k] for k in on] for c in names}

    return map_columns(compact(docs, docs.count(), docs), keep, docs.schema, rows=256)
