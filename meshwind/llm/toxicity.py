"""Toxicity by a weighted finite-state grammar: composed transducers mark clauses, learned weights score the matches."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_column, arrow_map, materialize, picked

#: Fixed seed words of the closed classes, in English, German, French and Spanish.
THREAT = "kill killed hurt destroy shoot stab beat burn attack murder töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()
TARGET = "you your yours he she they them him her people everyone du dich dein ihr euch er sie vous toi ton tu il elle ils eux usted ustedes él ella ellos".split()
NEGATION = "not no never neither nor without nicht kein keine nie ohne ne pas jamais sans nunca sin ni".split()
REPORT = "said says wrote called quoted claimed reported allegedly sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()
#: Labelled rows a class that training reads, whole texts each, and stems of the lexicon.
TRAIN_ROWS, STEMS = 3000, 600
THRESHOLD = 0.3
_TOKENS = re.compile(r"[^\W\d_]+|[.,;:!?\n|]")
_BREAKS = frozenset(".,;:!?\n|")
#: Symbols of words, and those of the one word that a parse takes for the clause's insult or threat.
OTHER, INSULT, THREATS, TARGETS, NEG, SAID, INSULT_HERE, THREAT_HERE = range(8)
SYMBOLS = 8
_HERE = {INSULT: INSULT_HERE, THREATS: THREAT_HERE}
#: Symbols that a negation and a target reach.
NEG_WIDTH, TARGET_WIDTH = 4, 3
#: Marks of arcs; a clause's class is the marks of its path.
NEGATED, REPORTED, TARGETED, THREATENING, CLASSES = 1, 2, 4, 8, 16
#: Weights (logarithms of factors) of the arcs with these marks, before anything is learned, and what may be learned in their place: negation and
#: report always weaken a clause, a target never does.
PRIOR = (-2.5, -2.0, 0.4, 0.0)
CHOICES = ((-3.5, -3.0, -2.5, -2.0, -1.5), (-3.0, -2.5, -2.0, -1.5, -1.0), (0.1, 0.25, 0.4, 0.7, 1.0), (-0.5, -0.25, 0.0, 0.25, 0.5))
#: How much the log-likelihood of the training rows pays for a unit of squared distance from the prior.
HOLD = 4.0
#: A threat weighs as much as this, or as the mean stem of the lexicon.
THREAT_WEIGHT = 4.0


@dataclass(frozen=True)
class Transducer:
    """Finite and deterministic: arcs[state][symbol] is (next state, marks), or None; state 0 is the first; finals are accepting."""

    arcs: tuple[tuple[tuple[int, int] | None, ...], ...]
    finals: tuple[bool, ...]

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: both read each symbol, and it gets the marks of both; both have to accept. States are the pairs that can be reached."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for left, right in todo:
            row: list[tuple[int, int] | None] = []
            for x, y in zip(self.arcs[left], other.arcs[right]):
                if x is None or y is None:
                    row.append(None)
                    continue
                to = (x[0], y[0])
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append((number[to], x[1] | y[1]))
            arcs.append(tuple(row))
        return Transducer(tuple(arcs), tuple(self.finals[a] and other.finals[b] for a, b in todo))

    def parses(self, symbols: list[int], bases: list[float]) -> dict[int, float]:
        """Per class (the marks of a path) the summed bases of all accepted paths: every insult or threat may be the one that a path takes
        for the clause's, and gives the path its base. One run from left to right; paths that meet in a state are summed."""
        at: dict[int, dict[int, float]] = {0: {0: 1.0}}
        for symbol, base in zip(symbols, bases):
            after: dict[int, dict[int, float]] = {}
            for state, paths in at.items():
                row = self.arcs[state]
                for arc, own in ((row[symbol], 1.0), (row[_HERE[symbol]], base)) if symbol in _HERE else ((row[symbol], 1.0),):
                    if arc is not None:
                        into = after.setdefault(arc[0], {})
                        for marks, weight in paths.items():
                            into[marks | arc[1]] = into.get(marks | arc[1], 0.0) + weight * own
            at = after
        out: dict[int, float] = {}
        for state, paths in at.items():
            if self.finals[state]:
                for marks, weight in paths.items():
                    out[marks] = out.get(marks, 0.0) + weight
        return out


def machine(states: int, arc, final=lambda state: True) -> Transducer:
    """The transducer of a function from state and symbol to (next state, marks) or None."""
    return Transducer(tuple(tuple(arc(q, s) for s in range(SYMBOLS)) for q in range(states)), tuple(final(q) for q in range(states)))


#: One insult or threat a clause; the latter marks its arc.
MATCH = machine(2, lambda q, s: (q, 0) if s < INSULT_HERE else None if q else (1, THREATENING * (s == THREAT_HERE)), lambda q: q == 1)
#: The match is among the NEG_WIDTH symbols after a negation; a state is what is left to reach.
NEGATION_SCOPE = machine(NEG_WIDTH + 1, lambda q, s: (NEG_WIDTH if s == NEG else max(0, q - 1), NEGATED * (s >= INSULT_HERE and q > 0)))
#: The match comes after a verb of saying.
REPORT_SCOPE = machine(2, lambda q, s: (1 if s == SAID else q, REPORTED * (s >= INSULT_HERE and q > 0)))


def _target(q: int, s: int) -> tuple[int, int]:
    """States: 0 to W, what a target before the match still reaches; W + 1, settled; then W, for an insult, and W + 1, for a threat, by
    what is left for a target after it; the last state is a threat without one."""
    w = TARGET_WIDTH
    settled, insult, threat, lost = w + 1, w + 1, 2 * w + 1, 3 * w + 2  # insult + k, threat + k: k symbols are left
    if q <= w:
        if s >= INSULT_HERE:
            return (settled, TARGETED) if q else (insult + w if s == INSULT_HERE else threat + w, 0)
        return (w if s == TARGETS else max(0, q - 1), 0)
    if q in (settled, lost):
        return (q, 0)
    if s == TARGETS:
        return (settled, TARGETED)
    return (lost if q == threat + 1 else q - 1, 0)


#: A target is among the TARGET_WIDTH symbols before or after the match. A threat needs one.
TARGET_SCOPE = machine(3 * TARGET_WIDTH + 3, _target, lambda q: q <= 2 * TARGET_WIDTH + 1)
GRAMMAR = MATCH @ NEGATION_SCOPE @ REPORT_SCOPE @ TARGET_SCOPE
FEATURES = ("evidence", "strongest", "density", "clauses")


def arc_weights(arcs) -> list[float]:
    """The weight of each set of marks."""
    return [sum(a for k, a in enumerate(arcs) if marks >> k & 1) for marks in range(CLASSES)]


class Lexicon(dict):
    """Word to (symbol, base); stems match word beginnings, longest first; symbols of words are kept while few."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        threat = sum(stems.values()) / len(stems) if stems else THREAT_WEIGHT
        self.stems, self.closed = stems, {w: (k, threat if k == THREATS else 0.0) for k, ws in ((THREATS, THREAT), (TARGETS, TARGET), (NEG, NEGATION), (SAID, REPORT)) for w in ws}

    def __missing__(self, word: str):
        if len(self) > 60_000:
            self.clear()
        found = self.closed.get(word)
        if found is None:
            found = next(((INSULT, self.stems[word[:k]]) for k in range(min(12, len(word)), 2, -1) if word[:k] in self.stems), (OTHER, 0.0))
        self[word] = found
        return found


def matches(text: str | None, lexicon: Lexicon) -> tuple[list[dict[int, float]], int]:
    """The parses of each clause that has any, and the number of clauses."""
    found, symbols, bases, hot, n = [], [], [], False, 0
    for token in [*_TOKENS.findall((text or "").lower()), "."]:
        if token not in _BREAKS:
            kind, base = lexicon[token]
            symbols.append(kind), bases.append(base)
            hot = hot or kind in _HERE
            continue
        n += bool(symbols)
        if hot and (parses := GRAMMAR.parses(symbols, bases)):
            found.append(parses)
        symbols, bases, hot = [], [], False
    return found, n


def class_sums(found: list[dict[int, float]], n: int) -> list[float]:
    """Per class its share of the clauses that match, the sum of its parses' bases and the largest of a clause, then the number of all clauses."""
    out = [[0.0, 0.0, 0.0] for _ in range(CLASSES)]
    for parses in found:
        total = sum(parses.values())
        for kind, base in parses.items():
            own = out[kind]
            out[kind] = [own[0] + base / total, own[1] + base, max(own[2], base)]
    return [x for own in zip(*out) for x in own] + [float(n)]


def features(sums: np.ndarray, arcs) -> np.ndarray:
    """(rows, FEATURES) of class_sums: parses weigh their base times what their arcs make of it; a clause without a parse weighs nothing."""
    sums = np.asarray(sums, float).reshape(-1, 3 * CLASSES + 1)
    scale = np.exp(arc_weights(arcs))
    number, weight, most, n = sums[:, :CLASSES], sums[:, CLASSES : 2 * CLASSES], sums[:, 2 * CLASSES : -1], sums[:, -1]
    share = (number * np.minimum(scale, 1.0)).sum(axis=1) / np.maximum(n, 1)
    return np.c_[np.log1p((weight * scale).sum(axis=1)), (most * scale).max(axis=1), np.log1p(100 * share), np.log1p(n)]


def stems_of(text: str | None) -> set[str]:
    """Beginnings of 4 to 12 letters of a text's words."""
    return {w[:k] for w in set(_TOKENS.findall((text or "").lower())) for k in range(4, min(12, len(w)) + 1)}


def least_texts(toxic: int) -> float:
    """Toxic texts that a stem has to occur in."""
    return max(4, 0.004 * toxic)


def best_stems(counts: list[tuple[str, int, int]], clean: int, toxic: int) -> dict[str, float]:
    """Of (stem, clean texts, toxic texts) those far likelier in toxic ones, with their log odds as weights."""
    odds, seen = {}, {}
    for stem, a, b in counts:
        if b >= least_texts(toxic):
            weight = math.log((b + 0.5) / (toxic + 1)) - math.log((a + 0.5) / (clean + 1))
            if weight >= 1.5:
                odds[stem], seen[stem] = weight, (a, b)
    for stem in list(odds):  # of beginnings that mark the same documents only the longest stays
        if seen.get(stem[:-1]) == seen[stem]:
            odds.pop(stem[:-1], None)
    best = sorted(odds, key=lambda s: (-odds[s] * math.sqrt(seen[s][1]), s))[:STEMS]
    return {s: round(odds[s], 4) for s in best}


@dataclass
class Model:
    stems: dict[str, float]
    arcs: tuple[float, ...]
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, sums) -> np.ndarray:
        z = (features(sums, self.arcs) - self.center) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[1:] + self.weights[0], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Center, scale, weights and penalised log-likelihood of a logistic regression. Evidence and the strongest clause never weigh
    against toxicity: a feature that would is left out."""
    used, w = np.ones(x.shape[1], bool), np.zeros(1 + x.shape[1])
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = np.c_[np.ones(len(x)), (x - center) / scale]
    while True:
        keep, w = np.r_[True, used], np.zeros(1 + x.shape[1])
        a = z[:, keep]
        for _ in range(25):  # Newton steps with a ridge
            p = 1 / (1 + np.exp(-np.clip(a @ w[keep], -30, 30)))
            h = a.T @ (a * (p * (1 - p))[:, None]) + np.eye(keep.sum())
            w[keep] += np.linalg.solve(h, a.T @ (y - p) - w[keep])
        against = used & (w[1:] < 0) & np.array([f != "clauses" for f in FEATURES])
        if not against.any():
            break
        used &= ~against
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return center, scale, w, float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() - w @ w / 2)


def learn(rows: list[list[float]], labels: list[int], stems: dict[str, float], shift: float = 0.0) -> Model:
    """The model of class_sums and labels: each arc's weight is the choice of the highest likelihood, held to its prior; then the regression.
    shift: added to the intercept, to undo sampling by class."""
    sums, y = np.array(rows, float).reshape(-1, 3 * CLASSES + 1), np.array(labels, float)
    if not len(y) or not 0 < y.mean() < 1:
        return Model(stems, PRIOR, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.array([30.0 if len(y) and y.mean() else -30.0, *[0.0] * len(FEATURES)]))
    worth = lambda arcs: fit(features(sums, arcs), y)[3] - HOLD * sum((a - b) ** 2 for a, b in zip(arcs, PRIOR))
    arcs = list(PRIOR)
    for k, choices in enumerate(CHOICES):
        arcs[k] = max(choices, key=lambda v: (worth([*arcs[:k], v, *arcs[k + 1 :]]), -abs(v - PRIOR[k])))  # noqa: B023
    center, scale, w, _ = fit(features(sums, arcs), y)
    w[0] += shift
    return Model(stems, tuple(arcs), center, scale, w)


def train(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", allowed=None) -> Model:
    """Learn stems and weights from at most TRAIN_ROWS labelled documents a class, those with the smallest id hashes, whole texts.

    allowed: function from the id column to a boolean column, for rows that may be learned from. The share of each class is
    counted over all allowed documents, so that scores keep their meaning. Stems are counted and features computed where the
    texts are; the driver gets counts of likely stems and one short row a document. Features of either half of the sample
    come from stems of the other half. A null label or id teaches nothing; of repeated ids the largest label and text count.
    """
    marks = picked(labels, id=id_col, y=label_col).where("id is not null and y in (0, 1)")
    marks = marks.where(allowed(F.col("id"))) if allowed else marks
    marks = marks.groupBy("id").agg(F.max("y").cast("int").alias("y"))
    texts = picked(docs, id=id_col, text=text_col)
    marks = materialize(marks.join(texts.select("id"), "id", "left_semi"))
    shares = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    wanted = [marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS) for y in (0, 1)]
    sample = texts.join(F.broadcast(wanted[0].unionAll(wanted[1])), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y"))  # at most 2 * TRAIN_ROWS ids
    sample = materialize(sample.withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")))
    sizes = {(r["half"], r["y"]): r["count"] for r in sample.groupBy("half", "y").count().collect()}
    size = lambda y, *halves: sum(sizes.get((h, y), 0) for h in halves)
    counted = arrow_map(sample, lambda: _stem_counts, "half int, y int, stem string, n long").groupBy("stem")
    of = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}")
    counted = counted.agg(of(0, 0), of(0, 1), of(1, 0), of(1, 1))
    seen = lambda y, halves: sum(F.col(f"n{h}{y}") for h in halves)
    likely = lambda *halves: (seen(1, halves) >= least_texts(size(1, *halves))) & (seen(1, halves) >= 4.4 * size(1, *halves) / max(size(0, *halves), 1) * (seen(0, halves) - 1))
    counted = counted.where(likely(0) | likely(1) | likely(0, 1)).collect()
    stems = [best_stems([(r["stem"], sum(r[f"n{h}0"] for h in halves), sum(r[f"n{h}1"] for h in halves)) for r in counted], size(0, *halves), size(1, *halves)) for halves in ((1,), (0,), (0, 1))]
    rows = arrow_map(sample, lambda: _featured(stems), "id " + docs.schema[id_col].dataType.simpleString() + ", y int, x array<double>").orderBy(F.xxhash64("id"), "id").collect()
    shift = math.log(shares[1] / shares[0]) - math.log(size(1, 0, 1) / size(0, 0, 1)) if size(0, 0, 1) and size(1, 0, 1) else 0.0
    return learn([r["x"] for r in rows], [r["y"] for r in rows], stems[2], shift)


def _stem_counts(batch: pa.RecordBatch) -> dict:
    seen: Counter = Counter()
    for half, y, text in zip(*(batch.column(c).to_pylist() for c in ("half", "y", "text"))):
        seen.update((half, y, stem) for stem in stems_of(text))
    half, y, stem = zip(*seen) if seen else ((), (), ())
    return {"half": half, "y": y, "stem": stem, "n": list(seen.values())}


def _featured(stems: list[dict[str, float]]):
    lexicons = [Lexicon(s) for s in stems[:2]]

    def work(batch: pa.RecordBatch) -> dict:
        x = [class_sums(*matches(t, lexicons[h])) for t, h in zip(batch.column("text").to_pylist(), batch.column("half").to_pylist())]
        return {"id": batch.column("id"), "y": batch.column("y"), "x": x}

    return work


def score_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """Struct of score (0 to 1), n_matches and predicted (score >= THRESHOLD) of a whole text; null is scored as empty."""
    shared = spark.sparkContext.broadcast(model)

    def make():
        fitted = shared.value
        lexicon = Lexicon(fitted.stems)

        def work(texts: pa.Array) -> dict:
            found = [matches(t, lexicon) for t in texts.to_pylist()]
            score = fitted.score([class_sums(*m) for m in found])
            return {"score": score, "n_matches": [len(m) for m, _ in found], "predicted": (score >= THRESHOLD).astype(np.int32)}

        return work

    return arrow_column(spark, make, "struct<score:double,n_matches:int,predicted:int>", text)


def score_toxicity(docs: DataFrame, model: Model, *, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row: id, score (0 to 1), n_matches, predicted (score >= THRESHOLD), from the whole text alone.

    Null and empty texts score as texts without matches; repeated rows score alike; an empty table gives no rows;
    other columns are ignored.
    """
    base = picked(docs, id=id_col, text=text_col)
    return base.select("id", score_column(docs.sparkSession, model, F.col("text")).alias("t")).select("id", "t.*")


def held_out(id_):
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The op2 digest: labels are learned only from rows that are not held out. A null id counts as not held out."""
    model = train(docs, labels, allowed=lambda c: ~held_out(c))
    scored = score_toxicity(docs, model)
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted")
