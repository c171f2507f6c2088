import hashlib
import random
import re

import numpy as np

from meshwind.llm import pii

RX = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(RX.items()):
        for m in rx.finditer(text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_brute_force_on_random_text():
    rnd = random.Random(5)
    for _ in range(4000):
        text = "".join(rnd.choice(["a", "Z", "@", ".", "-", " ", "+", "(", ")", "1", "4", "25", "256", "x@y.co", "é", "4111 1111 1111 1111", "+1 555 010 1234", "%", "_"]) for _ in range(rnd.randint(0, 24)))
        assert pii.base_spans(text) == brute(text), text


def test_messages_spread_labels_along_skip_edges():
    graph = pii.Graph()
    graph.add(0, "call 555-0101 now . later a b c d e 555-0101 ok")
    field = pii.Field()
    field.node[graph.features[0][6], 4] = 4.0  # the word before the first occurrence speaks for a phone
    alone = field.marginals(graph)[1, 4]
    field.edge[1] = 3 * np.eye(pii.LABELS)
    p = field.marginals(graph)
    assert abs(alone - 0.2) < 1e-6 and p[1, 4] > 0.7
    exact = np.exp(4.0 * (np.arange(5) == 4)[:, None] + field.edge[1])  # a single edge: sum-product is exact
    assert abs(p[1, 4] - exact.sum(0)[4] / exact.sum()) < 1e-2


def test_messages_reach_the_end_of_a_long_chain():
    """Evidence at the first of many like tokens reaches all of them; a chain is a tree, so sum-product is exact."""
    graph, n = pii.Graph(), 40
    graph.add(0, " x y z ".join(["555-0101"] * n))
    field = pii.Field()
    field.edge[1] = 4 * np.eye(pii.LABELS)
    x, edges, _ = graph.arrays()
    field.node[:, 0] = 0.0
    node = np.zeros((n, pii.LABELS))
    first = graph.features[0][6]
    field.node[first, 4] = 6.0
    node += field.node[x].sum(axis=1)
    exact, pair = [], np.exp(field.edge[1])
    ahead, back = [np.ones(pii.LABELS)], [np.ones(pii.LABELS)]
    for k in range(n - 1):
        m = (ahead[-1] * np.exp(node[k])) @ pair
        ahead.append(m / m.sum())
        m = (back[-1] * np.exp(node[n - 1 - k])) @ pair
        back.append(m / m.sum())
    for k in range(n):
        p = ahead[k] * np.exp(node[k]) * back[n - 1 - k]
        exact.append(p / p.sum())
    assert len(edges) == n - 1 and np.abs(field.marginals(graph) - np.array(exact)).max() < 0.02


def test_query_on_odd_rows(spark):
    texts = [None, "", "mail bob@example.com or +1 (555) 010-1234 x", "é 10.0.0.1 and 4111-1111-1111-1111", "1" * 30_000, "a" * 50_000 + "@", "10.0.0.1 " * 3000]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(2, texts[2], "k"), (None, texts[3], "k")], "doc_id long, text string, spans string")
    rows = pii.personal_data_report(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        t = texts[3 if r.doc_id is None else r.doc_id]
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in (brute(t) if len(t or "") < 29_000 else pii.base_spans(t)))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("crf_")) == want
    assert pii.personal_data_report(docs.limit(0)).count() == 0
