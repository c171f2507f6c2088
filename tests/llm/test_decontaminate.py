import hashlib
import random
import re

from meshwind.llm import decontaminate as D

RX = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return RX.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=10):
    w, hit, names = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        for at in range(len(v) - k + 1) if k else ():
            for i in range(len(w) - k + 1):
                if w[i : i + k] == v[at : at + k]:
                    hit |= set(range(i, i + k))
                    names.add("null" if item is None else str(item))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_digest_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = ["alpha", "Beta", "x1", "é", "straße", "the", "of", "日本"]
    text = lambda n: rnd.choice([" ", ", ", "-"]).join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.choice((1, 3, 9, 10, 11, 25)))) for k in range(14)] + [(14, None), (15, "..."), (3, text(12)), (None, text(12))]
    rows = [(k, text(rnd.randint(0, 40)) + " " + (rnd.choice(items)[1] or "").upper() if rnd.random() < 0.5 else text(60)) for k in range(60)]
    rows += [(60, None), (61, ""), (62, items[8][1] * 3), (0, rows[0][1]), (None, items[9][1]), (63, "the of " * 30_000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n_words int")
    want = sorted(((i, *brute(t, items)) for i, t in rows if i != 63), key=str)
    for block in (1 << 20, 120):
        monkeypatch.setattr(D, "BLOCK_BYTES", block)
        got = D.contamination_report(docs, bench).collect()
        assert len(got) == len(rows)
        assert sorted((tuple(r) for r in got if r.doc_id != 63), key=str) == want
    assert D.contamination_report(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in D.contamination_report(docs, bench.limit(0)).collect())
