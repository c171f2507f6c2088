"""Secret scan with Spark expressions only: pattern kinds, and character Markov models of random and ordinary strings."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties. Fixed patterns; a failing match is dropped but still consumes its text.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = "AKIA[A-Z0-9]{16,}+"  # a run from its first AKIA on; shorter ones fail the 20 characters asked for
HEX = "[0-9a-f]{24,}+"  # whole runs; shorter ones fail the 24 characters asked for
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET)
#: Least log-likelihood ratio in nats, in all and a character pair, of a markov span.
LEAST_SUM, LEAST_MEAN = 14.0, 0.6
#: Labelled strings a class that training makes; the bound on the training sample.
SAMPLES = 20_000
#: Parts of ordinary identifiers, from which labelled samples are put together.
WORDS = (
    "get set read write load store open close start stop user name file path list item index count value key data type node tree "
    "table column row cell page text word line block batch queue stack cache buffer stream socket server client request response "
    "header body token session cookie query filter order sort merge split join group total average maximum minimum first last next "
    "previous parent child left right width height color style format parse render update delete insert create remove append "
    "content length message error warning debug info trace level config option default custom local global public private static "
    "abstract interface handler manager factory builder service controller model view test check valid enable disable active the "
    "and with that for this from tion ing ment over under er on en re at th information development international management"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(i, random, s): n random strings (hexadecimal, base64, capitals and digits) and n ordinary identifiers."""
    ids = spark.range(n).withColumnRenamed("id", "i")
    digest = F.sha2(F.concat(F.lit("random"), F.col("i").cast("string")), 256)
    raw = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    size = (F.lit(20) + F.pmod(F.xxhash64("i"), F.lit(21))).cast("int")
    random = ids.select("i", F.lit(True).alias("random"), F.substr(F.when(F.col("i") % 5 == 0, digest).when(F.col("i") % 5 == 1, F.upper(F.regexp_replace(raw, "[+/]", "Q"))).otherwise(raw), F.lit(1), size).alias("s"))
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("i", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    parts = [pick(k) for k in range(5)]
    tail = F.when(F.col("i") % 3 == 0, F.pmod(F.xxhash64("i", F.lit("n")), F.lit(100)).cast("string")).otherwise(F.lit(""))
    style = F.col("i") % 7
    joined = (
        F.when(style == 0, F.concat_ws("_", *parts)).when(style == 1, F.concat_ws("-", *parts)).when(style == 2, F.concat_ws("/", *parts)).when(style == 3, F.upper(F.concat_ws("_", *parts)))
        .when(style == 4, F.concat(parts[0], *[F.initcap(p) for p in parts[1:]])).otherwise(F.concat(*parts))
    )
    return random.unionByName(ids.select("i", F.lit(False).alias("random"), F.concat(joined, tail).alias("s")))


def _codes(token: Column) -> Column:
    places = [0] * 128
    for k, c in enumerate(ALPHABET):
        places[ord(c)] = k
    table = F.from_json(F.lit(json.dumps(places)), "array<int>")
    return F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(table, F.ascii(c)), F.lit(0)))


def train(samples: DataFrame) -> list[float]:
    """SIZE * SIZE log ratios of the two classes' transition probabilities, from samples (random, s); add-half smoothing."""
    codes = samples.select("random", _codes(F.col("s")).alias("c"))
    steps = codes.select("random", F.explode(F.arrays_zip(F.expr("slice(c, 1, size(c) - 1)").alias("a"), F.expr("slice(c, 2, size(c))").alias("b"))).alias("p"))
    counts = {(r["random"], r["a"], r["b"]): r["count"] for r in steps.groupBy("random", "p.a", "p.b").count().collect()}  # at most 2 * SIZE^2
    out = []
    for a in range(SIZE):
        total = {k: sum(counts.get((k, a, b), 0) for b in range(SIZE)) + 0.5 * SIZE for k in (True, False)}
        out += [round(math.log((counts.get((True, a, b), 0) + 0.5) / total[True]) - math.log((counts.get((False, a, b), 0) + 0.5) / total[False]), 6) for b in range(SIZE)]
    return out


def likelihood_ratio(token: Column, model: list[float]) -> Column:
    """Sum over the token's character pairs of the log ratio: positive if a random string is likelier."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    codes = _codes(token)
    return F.aggregate(codes, F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("s")), lambda acc, c: F.struct(c.alias("p"), (acc["s"] + F.when(acc["p"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["p"] * SIZE + c))).alias("s")), lambda acc: acc["s"])


def scanned(df: DataFrame, out: str, of: str, op) -> DataFrame:
    """Column out: the running op (a sum or greatest) over the int array ``of``, by blocks of its length's square root."""
    empty = F.array().cast("array<int>")
    run = lambda blk: F.aggregate(blk, empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(op(F.get(acc, F.size(acc) - 1), x), x))))
    size = F.ceil(F.sqrt(F.size(of))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / size).cast("int")), lambda b: run(F.slice(of, b * size + 1, size)))
    df = df.withColumn("_in", F.when(F.size(of) > 0, blocks).otherwise(F.array().cast("array<array<int>>")))
    df = df.withColumn("_at", run(F.transform("_in", lambda b: F.get(b, F.size(b) - 1))))
    join = F.transform("_in", lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda v: op(v, F.get("_at", k - 1)))))
    return df.withColumn(out, F.flatten(join)).drop("_in", "_at")


def _spans(df: DataFrame, kind: int, pattern: str, keep) -> DataFrame:
    """Column s{kind}: array of (start, kind, end) of the pattern's matches that ``keep`` accepts, in code points."""
    df = df.withColumn("_m", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    gaps = F.when(F.size("_m") > 0, F.zip_with(F.slice(F.split("text", pattern, -1), F.lit(1), F.size("_m")), "_m", lambda g, m: F.length(g) + F.length(m))).otherwise(F.array().cast("array<int>"))
    df = scanned(df.withColumn("_g", gaps), "_e", "_g", lambda a, b: a + b)
    found = F.zip_with("_m", "_e", lambda m, e: F.struct((e - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), m.alias("m")))
    kept = F.transform(F.filter(found, lambda s: keep(s["m"])), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return df.withColumn(f"s{kind}", kept).drop("_m", "_g", "_e")


def find_secrets(docs: DataFrame, *, id_col="doc_id", text_col="text", model: list[float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, text, spans: array of (start, kind index, end) sorted by start, then kind.

    Null text counts as empty, which has no spans. Pattern kinds match leftmost and without overlap, each on its own;
    markov adds runs of 20 or more token characters that the model finds random, whether or not other kinds cover them.
    Repeated rows are scanned each for itself, an empty table gives no rows; other columns are ignored unless in ``keep``
    (then they follow, prefixed ``c_``).
    """
    model = model or train(labelled_samples(docs.sparkSession))
    df = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"), *[docs[f"`{c}`"].alias(f"c_{c}") for c in keep])
    ratio = lambda m: likelihood_ratio(m, model)
    rules = ((ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6), (ACCESS, lambda m: F.lit(True)), (HEX, lambda m: F.lit(True)), (CANDIDATE, lambda m: ratio(m) >= F.greatest(F.lit(LEAST_SUM), LEAST_MEAN * (F.length(m) - 1))))
    for kind, (pattern, accept) in enumerate(rules):
        df = _spans(df, kind, pattern, accept)
    return df.withColumn("spans", F.array_sort(F.concat("s0", "s1", "s2", "s3"))).drop("s0", "s1", "s2", "s3")


def redacted(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Column text of find_secrets' result with each run of overlapping spans replaced by ``mark``."""
    df = scanned(found.withColumn("_ends", F.transform("spans", lambda s: s["end"])), "_far", "_ends", lambda a, b: F.greatest(a, b))
    df = df.withColumn("_c", F.when(F.size("spans") > 0, F.split("text", "")))
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("_far", k - 1))
    piece = lambda s, k: F.when(s["start"] >= before(k), F.concat(F.array_join(F.slice("_c", before(k) + 1, s["start"] - before(k)), ""), F.lit(mark))).otherwise(F.lit(""))
    end = F.element_at("_far", -1)
    rest = F.array_join(F.slice("_c", end + 1, F.size("_c")), "")
    new = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", piece), ""), rest)).otherwise(F.col("text"))
    return df.withColumn("text", new).drop("_ends", "_far", "_c")


def secret_report(docs: DataFrame) -> DataFrame:
    """The op6 digest of find_secrets."""
    found = find_secrets(docs)
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
