"""Personal data: fixed patterns, and a skip-chain conditional random field over number- and address-like tokens."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, picked

#: Kinds in the order that breaks ties; the field's own spans have these names with crf_ before them.
KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample.
TRAIN_DOCS = 1500
#: Feature slots, damping, least probability of an added span, words apart up to which neighbours chain.
SLOTS, DAMPING, LEAST, NEAR = 1024, 0.5, 0.9, 2
#: Message passing ends when no message moves by more than SETTLED (in nats), or after ROUNDS rounds (loops may not settle).
SETTLED, ROUNDS = 1e-3, 500
LABELS = 1 + len(KINDS)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")  # a failing start fails from each later digit of its run
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
SPAN = "array<struct<start:int,kind:string,end:int,p:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _emails(text: str):
    """Matches of the whole pattern, found from each @: its local part is the run of allowed characters before it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end), sorted. Each kind is matched leftmost without overlap; failing matches are dropped."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _MARK.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _digits(m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


class Graph:
    """Tokens of several documents with their features, and the edges that chain near tokens or skip between like ones."""

    def __init__(self):
        self.features, self.edges, self.kinds, self.places = [], [], [], []

    def add(self, doc: int, text: str) -> None:
        """Tokens: words with a digit or @. Chain edges join tokens at most NEAR words apart, skip edges each token with
        the last one before it of the same core, and with the last of the same shape and first four characters."""
        if not _MARK.search(text):
            return
        last, recent, like, before = None, {}, {}, ""
        for k, m in enumerate(_WORD.finditer(text)):
            word = m[0]
            if _MARK.search(word):
                node, core = len(self.features), word.strip(".,;:!?()[]{}<>\"'|")
                self.features.append(_features(core, before))
                self.places.append((doc, m.start(), m.end()))
                if last is not None and k - last[0] <= NEAR:
                    self._edge(last[1], node, 0)
                key = core.lower()
                if key in recent:
                    self._edge(recent[key], node, 1)
                shape = (_shape(core), key[:4])
                if shape in like and like[shape] != recent.get(key):
                    self._edge(like[shape], node, 2)
                last, recent[key], like[shape] = (k, node), node, node
            before = word

    def _edge(self, a: int, b: int, kind: int) -> None:
        self.edges.append((a, b))
        self.kinds.append(kind)

    def arrays(self):
        return np.array(self.features, np.int64).reshape(-1, N_FEATURES), np.array(self.edges, np.int64).reshape(-1, 2), np.array(self.kinds, np.int64)


def _shape(word: str) -> str:
    short = re.sub(r"[A-Za-z\u0080-￿]+", "a", word)
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[0-9]+", "d", short))


N_FEATURES = 8


def _features(core: str, before: str) -> list[int]:
    digits = sum(map(str.isdigit, core))
    long_run = max([0, *map(len, re.findall("[0-9]+", core))])
    said = ("bias", f"s{_shape(core)}", f"l{min(len(core), 32) // 2}", f"d{min(digits, 20)}", f"r{min(long_run, 20)}", f"p{min(core.count('.'), 4)}@{core.count('@') > 0}+{core[:1] == '+'}", f"b{before.lower().strip('.,;:!?|')[:12]}", f"f{core[:1]}{core[-1:]}" if not core[:1].isdigit() else "fd")
    return [zlib.crc32(f"{k}{x}".encode("utf-8", "surrogatepass")) % SLOTS for k, x in enumerate(said)]


def weak_labels(places, spans: dict[int, list[tuple[int, int, int]]]) -> np.ndarray:
    """0, or 1 + the kind of the pattern span that holds the token's start or lies inside it."""
    out = np.zeros(len(places), np.int64)
    for i, (doc, a, b) in enumerate(places):
        for s, kind, e in spans.get(doc, ()):
            if s < b and a < e:
                out[i] = kind + 1
                break
    return out


class Field:
    """Weights of node features (SLOTS x LABELS) and of the three edge kinds (LABELS x LABELS, symmetric)."""

    def __init__(self, node: np.ndarray | None = None, edge: np.ndarray | None = None):
        self.node = np.zeros((SLOTS, LABELS)) if node is None else node
        self.edge = np.zeros((3, LABELS, LABELS)) if edge is None else edge

    def fit(self, graph: Graph, labels: np.ndarray, steps: int = 150) -> Field:
        """Pseudo-likelihood ascent (Adam): each token given its features and its neighbours' labels."""
        x, edges, kinds = graph.arrays()
        if not len(x):
            return self
        src, dst, kind = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]], np.r_[kinds, kinds]
        truth = np.eye(LABELS)[labels]
        state = [np.zeros_like(self.node), np.zeros_like(self.node), np.zeros_like(self.edge), np.zeros_like(self.edge)]
        for t in range(1, steps + 1):
            score = self.node[x].sum(axis=1)
            np.add.at(score, dst, self.edge[kind, labels[src]])
            p = np.exp(score - score.max(axis=1, keepdims=True))
            slip = truth - p / p.sum(axis=1, keepdims=True)
            g_node, g_edge = -1e-4 * len(x) * self.node / 10, -1e-3 * self.edge
            for f in range(N_FEATURES):
                np.add.at(g_node, x[:, f], slip)
            np.add.at(g_edge, (kind, labels[src]), slip[dst])
            g_edge = g_edge + g_edge.transpose(0, 2, 1)
            for grad, at, w in ((g_node / len(x), 0, self.node), (g_edge / len(x), 2, self.edge)):
                state[at] = 0.9 * state[at] + 0.1 * grad
                state[at + 1] = 0.999 * state[at + 1] + 0.001 * grad**2
                w += 0.1 * (state[at] / (1 - 0.9**t)) / (np.sqrt(state[at + 1] / (1 - 0.999**t)) + 1e-8)
        return self

    def marginals(self, graph: Graph) -> np.ndarray:
        """Loopy sum-product in the log domain, all documents' graphs at once."""
        x, edges, kinds = graph.arrays()
        node = self.node[x].sum(axis=1)
        if len(edges):
            m = len(edges)
            src, dst, kind = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]], np.r_[kinds, kinds]
            back = np.r_[np.arange(m, 2 * m), np.arange(m)]
            message = np.zeros((2 * m, LABELS))
            for _ in range(ROUNDS):
                belief = node.copy()
                np.add.at(belief, dst, message)
                out = belief[src] - message[back]
                new = np.empty_like(message)
                for y in range(LABELS):
                    s = out + self.edge[kind, :, y]
                    top = s.max(axis=1)
                    new[:, y] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                moved = np.abs(new - message).max()
                message = DAMPING * message + (1 - DAMPING) * new
                if moved <= SETTLED:
                    break
            node = node.copy()
            np.add.at(node, dst, message)
        p = np.exp(node - node.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, *, id_col="doc_id", text_col="text") -> Field:
    """Fit on pattern labels of at most TRAIN_DOCS different texts with digits or @, those with the smallest hashes, whole.

    Their graphs are made where the texts are; the driver gets numbers only: features, edges and labels of tokens."""
    some = picked(docs, text=text_col).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    cut = some.select("h").distinct().orderBy("h").limit(TRAIN_DOCS).agg(F.max("h")).first()[0]
    graph, labels = Graph(), []
    if cut is None:
        return Field()

    def work(batch: pa.RecordBatch) -> dict:
        out = {"h": batch.column("h"), "x": [], "e": [], "k": [], "y": []}
        for text in batch.column("text").to_pylist():
            own = Graph()
            own.add(0, text)
            x, edges, kinds = own.arrays()
            out["x"].append(x.ravel()), out["e"].append(edges.ravel()), out["k"].append(kinds), out["y"].append(weak_labels(own.places, {0: base_spans(text)}))
        return out

    parts = arrow_map(some.where(F.col("h") <= cut).select("h", "text"), lambda: work, "h long, x array<int>, e array<int>, k array<int>, y array<int>")
    for r in parts.groupBy("h").agg(*[F.first(c).alias(c) for c in "xeky"]).orderBy("h").collect():
        first = len(graph.features)
        graph.features += np.array(r["x"], np.int64).reshape(-1, N_FEATURES).tolist()
        graph.edges += (np.array(r["e"], np.int64).reshape(-1, 2) + first).tolist()
        graph.kinds += r["k"]
        labels += r["y"]
    return Field().fit(graph, np.array(labels, np.int64))


def find_personal_data(docs: DataFrame, *, id_col="doc_id", text_col="text", field: Field | None = None) -> DataFrame:
    """Per row: id, spans: array of (start, kind, end, p) by start, then kind as listed.

    Pattern spans have p = 1. The field adds runs of neighbouring tokens that it gives one label with probability of at
    least LEAST each and that touch no pattern span. Null and empty texts have no spans; repeated rows are searched
    each for itself; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(docs, id_col=id_col, text_col=text_col))

    def make():
        known = shared.value

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = {i: base_spans(t) for i, t in enumerate(texts)}
            spans = [[{"start": a, "kind": KINDS[k], "end": b, "p": 1.0} for a, k, b in base[i]] for i in range(len(texts))]
            graph = Graph()
            for i, t in enumerate(texts):
                graph.add(i, t)
            if graph.features:
                p = known.marginals(graph)
                label = np.where(p[:, 1:].max(axis=1) >= LEAST, p[:, 1:].argmax(axis=1) + 1, 0)
                starts = {i: np.maximum.accumulate(np.array([(s, e) for s, _, e in v]), axis=0) for i, v in base.items() if v}
                run = None  # of a document, a label: start, end, least probability, last token's number
                for n in [*np.flatnonzero(label), -1]:
                    doc, a, b = graph.places[n] if n >= 0 else (-1, 0, 0)
                    if doc in starts:  # pattern spans that start before b, and the furthest end among them
                        k = np.searchsorted(starts[doc][:, 0], b)
                        if k and starts[doc][k - 1, 1] > a:
                            continue
                    if run and n >= 0 and run[0] == doc and run[1] == label[n] and run[5] == n - 1 and texts[doc][run[3] : a].isspace() and a - run[3] == 1:
                        run[3:] = [b, min(run[4], p[n, label[n]]), n]
                        continue
                    if run:
                        spans[run[0]].append({"start": run[2], "kind": f"crf_{KINDS[run[1] - 1]}", "end": run[3], "p": float(run[4])})
                    run = [doc, int(label[n]), a, b, p[n, label[n]], n] if n >= 0 else None
            order = [*KINDS, *(f"crf_{k}" for k in KINDS)]
            return {"id": batch.column("id"), "spans": [sorted(s, key=lambda x: (x["start"], order.index(x["kind"]))) for s in spans]}

        return work

    return arrow_map(picked(docs, id=id_col, text=text_col), make, f"id {docs.schema[id_col].dataType.simpleString()}, spans {SPAN}")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """The op10 digest of find_personal_data."""
    found = find_personal_data(docs)
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: ~s["kind"].startswith("crf_"))
    return found.select(F.col("id").alias("doc_id"), *[count(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
