import math
import random

import pytest

from meshwind.llm import toxicity as T


def corpus(n=600):
    rnd, words, bad = random.Random(3), "river stone cloud paper window garden music bread".split(), "grobblin snarfwit zugnut".split()
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = " ".join(rnd.choice(words) for _ in range(40)).split()
        for _ in range(rnd.randint(3, 5) if toxic else 0):
            text.insert(rnd.randrange(40), "you " + rnd.choice(bad))
        rows.append((i, " ".join(text) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_grammar_scores_clauses():
    lexicon = T.Lexicon({"idiot": 2.0, "fool": 1.5})
    kinds = lambda text: [max(p) for p in T.matches(text, lexicon)[0]]
    assert kinds("you idiot") == [T.TARGETED] and kinds("idiot you are") == [T.TARGETED]
    assert kinds("not an idiot.") == [T.NEGATED] and kinds("he said something, idiot") == [0]
    assert kinds("she wrote that you idiots came") == [T.REPORTED | T.TARGETED]
    assert kinds("i will kill you") == kinds("you will kill") == [T.THREATENING | T.TARGETED] and kinds("kill the process") == []
    assert kinds("idiot and fool. a fool") == [0, 0] and T.matches("idiot and fool", lexicon) == ([{0: 3.5}], 1)
    assert T.matches("clear sky", lexicon) == ([], 1) and T.matches(None, lexicon) == ([], 0)


def test_one_run_equals_all_parses():
    """Every insult and every threat of a clause, with marks by their definition, against one run of the composed machine."""
    rnd = random.Random(8)
    assert len(T.GRAMMAR.arcs) <= 2 * (T.NEG_WIDTH + 1) * 2 * len(T.TARGET_SCOPE.arcs)  # the states that can be reached
    for _ in range(600):
        s = [rnd.choice((T.OTHER, T.OTHER, T.INSULT, T.THREATS, T.TARGETS, T.NEG, T.SAID)) for _ in range(rnd.randint(1, 25))]
        base = [float(rnd.randint(1, 9)) if x in (T.INSULT, T.THREATS) else 0.0 for x in s]
        want = {}
        for k, x in enumerate(s):
            near = any(y == T.TARGETS and 0 < abs(j - k) <= T.TARGET_WIDTH for j, y in enumerate(s))
            if x == T.INSULT or x == T.THREATS and near:
                marks = T.TARGETED * near | T.NEGATED * (T.NEG in s[max(0, k - T.NEG_WIDTH) : k]) | T.REPORTED * (T.SAID in s[:k]) | T.THREATENING * (x == T.THREATS)
                want[marks] = want.get(marks, 0.0) + base[k]
        assert T.GRAMMAR.parses(s, base) == pytest.approx(want)


def test_scores_follow_the_grammar(spark):
    """Report and negation weaken a clause, a target strengthens it, threats count with a target alone; a document's score is
    that of its clauses, computed here without class sums."""
    rows, labels = corpus()
    model = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    said = ["you grobblin.", "you are not a grobblin.", "he said you are a grobblin.", "a grobblin.", "i will kill you.", "kill the process.", "the sky is clear.", "he said that we kill you."]
    got = [r["score"] for r in T.score_toxicity(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string"), model).orderBy("id").collect()]
    targeted, negated, reported, plain, threat, idle, clear, told = got
    assert min(negated, reported) >= clear and max(negated, reported) < plain <= targeted
    assert threat > 0.3 > told and idle == clear < 0.1
    for text, score in zip(said, got):
        found, n = T.matches(text, T.Lexicon(model.stems))
        factor = lambda kind: math.exp(sum(a for k, a in enumerate(model.arcs) if kind >> k & 1))
        weigh = [factor(kind) * base for parses in found for kind, base in parses.items()]
        share = sum(min(1.0, factor(kind)) * base / sum(parses.values()) for parses in found for kind, base in parses.items()) / max(n, 1)
        x = [math.log1p(sum(weigh)), max(weigh, default=0.0), math.log1p(100 * share), math.log1p(n)]
        z = model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.center, model.scale))
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_stem_weights_equal_counts(spark, monkeypatch):
    """Stems and weights of a small table against counts over all of its texts."""
    rows, labels = corpus(200)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, marks)
    df = {y: [T.stems_of(t) for (_, t), (_, v) in zip(rows, labels) if v == y] for y in (0, 1)}
    every = set().union(*df[0], *df[1])
    assert model.stems == T.best_stems([(x, sum(x in d for d in df[0]), sum(x in d for d in df[1])) for x in every], len(df[0]), len(df[1]))
    assert set(model.stems) == {"grobblin", "snarfwit", "zugnut"}


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows] + [(None, None, 0.1), (9000, "", 0.2), (1, rows[1][1], 0.3), (9001, "x " * 60_000, 0.1)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, *labels[:3], (None, 1), (7, None)], "doc_id long, toxic int")
    got = T.toxicity_report(docs, marks).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= T.THRESHOLD) for r in got)
    want = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 100 and sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.97
    assert T.toxicity_report(docs.limit(0), marks).count() == 0
    assert {r.predicted for r in T.toxicity_report(docs, marks.limit(0)).collect()} == {0}
