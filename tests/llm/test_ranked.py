import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from meshwind.llm import ranked as R

COLUMNS = ("item_id", "rank", "doc_id", "score")


def _terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def _brute(docs, items, k=50):
    found = [(i, Counter(_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        score = []
        for i, c in found:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if c[t])
            if s > 0:
                score.append((-s, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(score)[:k])]
    return out


def _rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_terms_of_slices():
    texts = pa.array(["x", "Ab-c É9", None, "", "  ", "İ\x00b", "…"], pa.string())
    words, sizes = R.terms_of(texts)
    want = [_terms(t) for t in texts.to_pylist()]
    assert words.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(w) for w in want]
    assert R.terms_of(texts.slice(1, 2))[0].to_pylist() == want[1]


def test_treap_tops_against_ranges():
    rng = np.random.default_rng(3)
    places = np.concatenate([np.sort(rng.choice(500, n, replace=False)) for n in (200, 1, 0, 500)])
    stops = np.array([0, 200, 201, 201, 701])
    impacts = rng.integers(1, 6, len(places))
    treaps = R.Treaps(places, impacts, stops)
    assert treaps.roots[2] == -1
    low = rng.integers(0, 500, 300)
    high = low + rng.integers(1, 200, 300)
    term = rng.integers(0, 4, 300)
    top = treaps.top(treaps.roots[term], low, high)
    for t, a, b, node in zip(term, low, high, top):
        inside = [k for k in range(stops[t], stops[t + 1]) if a <= places[k] < b]
        assert (node == -1) == (not inside)
        if inside:
            assert node in inside and impacts[node] == impacts[inside].max()


@pytest.mark.parametrize("k", [1, 3, 50])
def test_traversal_scores_and_prunes(k):
    rng = np.random.default_rng(k)
    n, n_terms, n_items = 700, 40, 8
    held = [np.sort(rng.choice(n, rng.integers(1, 400), replace=False)) for _ in range(n_terms)]
    stops = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    impacts = rng.integers(1, 1000, stops[-1])
    weights = rng.integers(0, 50, n_terms)
    treaps = R.Treaps(np.concatenate(held), impacts, stops)
    query = np.repeat(np.arange(n_items), 5)
    term = np.concatenate([rng.choice(n_terms, 5, replace=False) for _ in range(n_items)])
    q, place, score = R.traverse(treaps, weights, query, term, np.ones(n_items, np.int64), n, k)
    got = defaultdict(dict)
    for a, b, c in zip(q.tolist(), place.tolist(), score.tolist()):
        got[a][b] = c
    for i in range(n_items):
        full = Counter()
        for t in term[query == i]:
            for p, s in zip(held[t].tolist(), impacts[stops[t] : stops[t + 1]].tolist()):
                full[p] += int(weights[t]) * s
        full = {p: s for p, s in full.items() if s > 0}
        kth = sorted(full.values(), reverse=True)[: k][-1]
        assert got[i] == {p: s for p, s in full.items() if s >= kth}


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 9000) % 400]
    docs = [(int(i), " ".join(words[i * 20 : i * 20 + int(rng.integers(0, 60))])) for i in rng.permutation(400)]
    docs += [(1000 + i, docs[0][1] + " Copy, copy!") for i in range(30)] + [(2000, "w1 " * 5000), (2001, None), (2002, ""), (2003, "...")]
    items = [(i, " ".join(words[i * 50 : i * 50 + 9]).upper()) for i in range(20)] + [(20, "copy"), (21, None), (22, ""), (23, "unheard"), (20, "copy")]
    frame = spark.createDataFrame([(t, i, "x", 1, "y") for i, t in docs], "text string, doc_id long, term string, shard int, rank string").repartition(3)
    asked = spark.createDataFrame([(t, i, "x") for i, t in items], "text string, item_id long, query string")
    monkeypatch.setattr(R, "SHARD_BYTES", 4000)
    monkeypatch.setattr(R, "FIRST_SHARDS", 2)
    want = sorted(_brute(docs, items), key=str)
    assert _rows(R.search_report(frame, asked)) == want
    monkeypatch.setattr(R, "BLOCK_TERMS", 12)
    monkeypatch.setattr(R, "POSTINGS_AT_ONCE", 60)
    assert _rows(R.search_report(frame, asked)) == want


def test_ties_nulls_repeats_and_empty_tables(spark):
    docs = [(3, "a b"), (1, "a b"), (None, "a b"), (1, "a b"), (2, "c")]
    items = [(None, "a"), (7, "c zz")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert _rows(R.search_report(frame, asked)) == sorted(_brute(docs, items), key=str)
    assert R.search_report(frame.where("doc_id = 99"), asked).count() == 0
    assert R.search_report(frame, asked.where("item_id = 99")).count() == 0
