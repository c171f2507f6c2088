import math
import random
import re
from collections import Counter

import pytest
import xxhash

from meshwind.llm import backoff as B


def brute(rows):
    word = lambda t: [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    texts = [word(t) for _, t in rows]
    one, two = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total, out = sum(one.values()), []
    for (i, _), t in zip(rows, texts):
        own1, own2, score, seen = Counter(t), Counter(zip(t, t[1:])), 0.0, 0
        for k, w in enumerate(t):
            share = max(one[w] - own1[w], B.UNSEEN) / total
            if k and two[t[k - 1], w] > own2[t[k - 1], w]:
                score += math.log((two[t[k - 1], w] - own2[t[k - 1], w]) / (one[t[k - 1]] - own1[t[k - 1]]))
                seen += 1
            else:
                score += math.log(share * (B.ALPHA if k else 1))
        out.append((i, len(t), seen, score))
    return out


@pytest.mark.parametrize("part_bytes, at_once", [(10**9, 10**9), (2000, 500)])
def test_scores_equal_brute_force(spark, monkeypatch, part_bytes, at_once):
    monkeypatch.setattr(B, "PART_BYTES", part_bytes)
    monkeypatch.setattr(B, "AT_ONCE", at_once)
    rnd = random.Random(1)
    words = [f"w{k}" for k in range(60)] + ["Éa", "the", "of"]
    rows = [(i, " ".join(rnd.choice(words[: 4 + i % 60]) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "  ,"), (3, rows[3][1]), (3, rows[3][1]), (200, rows[5][1]), (None, "the of the"), (153, "the of " * 4000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted(((r.id, r.n_words, r.n_seen, r.log_score, r.mean_log_score) for r in B.score_documents(docs).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (str(x[0]), x[1], x[2])), sorted(want, key=lambda x: (str(x[0]), x[1], x[2]))):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-5 * max(1, w[1])
        assert (g[4] is None) == (w[1] == 0)
    assert B.score_documents(docs.limit(0)).count() == 0


def test_words_do_not_share_counts(spark):
    """Words whose hashes agree in their first 22 bits keep counts of their own; compared with counts of words themselves."""
    first, alike = {}, []
    for k in range(30_000):
        other = first.setdefault(xxhash.xxh64_intdigest(f"v{k}".encode()) >> 42, k)
        if other != k:
            alike.append((f"v{other}", f"v{k}"))
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(alike[rnd.randrange(12)]) for _ in range(40)) for _ in range(60)]
    words = [t.split() for t in texts]
    one, two = Counter(w for t in words for w in t), Counter(p for t in words for p in zip(t, t[1:]))
    got = {r.id: r for r in B.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(words):
        own1, own2, score, seen = Counter(t), Counter(zip(t, t[1:])), 0.0, 0
        for k, w in enumerate(t):
            pair = (t[k - 1], w)
            if k and two[pair] > own2[pair]:
                score, seen = score + math.log((two[pair] - own2[pair]) / (one[pair[0]] - own1[pair[0]])), seen + 1
            else:
                score += math.log(max(one[w] - own1[w], B.UNSEEN) / sum(one.values()) * (B.ALPHA if k else 1))
        assert (got[i].n_words, got[i].n_seen) == (len(t), seen) and abs(got[i].log_score - score) < 1e-3
