import random
import re

import numpy as np

from meshwind.llm import common
from meshwind.llm import near_dup as N


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(n_shingles, component) of each row by comparing all pairs."""
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(s):
        for j in range(i):
            if a and s[j] and 100 * len(a & s[j]) >= 85 * len(a | s[j]):
                parent[root(i)] = root(j)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(root(k), []).append(i)
    low = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(i, len(s[k]), low[root(k)]) for k, (i, _) in enumerate(rows)]


def test_components_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(5))
    rows, n = [], 0
    for size in (1, 1, 2, 5, 40):
        base = [word() for _ in range(rnd.randint(60, 200))]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.choice((0, 0, 1, 2, 3))):
                t[rnd.randrange(len(t))] = word()
            rows.append((1000 - n, " ".join(t).title() if n % 3 else "\t".join(t)))
            n += 1
    rows += [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (None, "one two"), (7, None), (4, "one two"), (8, "é É " * 9000), (9, "é É " * 9000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    want = sorted(brute(rows), key=str)
    monkeypatch.setattr(N, "CELL", 8)
    got = N.near_duplicates(docs).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.id == r.component_id) for r in got)
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in N.near_duplicates(docs).collect()), key=str) == want
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_regions_cover_neighbours_and_forests_connect(monkeypatch):
    monkeypatch.setattr(N, "REGION", 16)
    prefix = np.array([5, 9, 4, 7] * 30 + [N.N_HASH] * 60, np.int32)
    found = list(N.regions(prefix, 0, 181, 4))
    assert all(1 <= b - a <= 16 for a, b in found) and set().union(*(range(a, b) for a, b in found)) == set(range(181))
    equal = np.full((6, 6), 100)
    equal[:3, 3:] = equal[3:, :3] = 90
    assert {frozenset(p) for p in N.forests(equal, 95, 1)} <= {frozenset((i, j)) for i in range(6) for j in range(6) if (i < 3) == (j < 3)}
    assert len(N.forests(equal, 80, 1)) == 5


def test_crowded_runs_compare_all_pairs(spark, monkeypatch):
    """Variants of a template link only through it; its run holds many more rows than a region."""
    monkeypatch.setattr(N, "REGION", 8)
    monkeypatch.setattr(N, "FORESTS", 1)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(6))
    base = [word() for _ in range(400)]
    rows = [(0, " ".join(base))]
    for n in range(1, 90):
        t = list(base)
        for at in range(2 * n % 60, 400, 80):
            t[at] = word()
        rows.append((n, " ".join(t)))
    want = sorted(brute(rows))
    assert len({c for _, _, c in want}) == 1
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == want


def test_refuted_forest_edges_leave_no_pair_untested(spark, monkeypatch):
    """Pairs scatter around the bound: the best estimates are often refuted, and the true links come after them."""
    monkeypatch.setattr(N, "FORESTS", 1)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = []
    for n in range(70):
        t = list(base)
        for at in rnd.sample(range(0, 300, 6), 3):
            t[at] = word()
        rows.append((n, " ".join(t)))
    want = sorted(brute(rows))
    assert 5 < len({c for _, _, c in want}) < 66
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == want


def test_components_in_one_task_and_in_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7), (1000, 900)]
    parent = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent}
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for bound in (1_000_000, 3):
        monkeypatch.setattr(common, "EDGES_AT_ONCE", bound)
        got = [tuple(r) for r in common.components(df).collect()]
        assert len(got) == len(want) and dict(got) == want
    assert common.components(df.limit(0)).count() == 0


def test_lower_similarity_finds_its_links(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(6))
    rows = []
    for n in range(60):
        base = [word() for _ in range(300)]
        t = list(base)
        for at in rnd.sample(range(5, 290, 6), 6):
            t[at] = word()
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(t))]
    assert len({r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}) == 60
    assert len({r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}) == 120


def test_large_family_that_scatters_around_the_bound(spark):
    """500 copies of one text with 1 to 4 words replaced: every component equals that of all pairs."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghijk") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for n in range(500):
        t = list(base)
        for at in rnd.sample(range(200), rnd.randint(1, 4)):
            t[at] = word()
        rows.append((n, " ".join(t)))
    want = sorted(brute(rows))
    assert 1 < len({c for _, _, c in want}) < 400
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == want


def test_components_start_from_written_links(spark, monkeypatch):
    """A task that finds links and draws them together at once holds two Python workers, which live on for later stages."""
    seen, own = [], N.components
    monkeypatch.setattr(N, "components", lambda edges: seen.append(edges._jdf.queryExecution().executedPlan().toString()) or own(edges))
    docs = spark.createDataFrame([(i, " ".join(f"w{k * (i // 2 + 1)}" for k in range(40))) for i in range(20)], "doc_id long, text string")
    assert N.near_duplicates(docs).where("kept").count() == 10
    assert len(seen) == 3 and not any("InPandas" in p or "InArrow" in p for p in seen)
