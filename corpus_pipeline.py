"""From raw documents to token ids: five stages, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwind.llm import decontaminate, near_dup, pieces, secrets, toxicity
from meshwind.llm.common import materialize


def _rest(docs: DataFrame) -> tuple[str, ...]:
    """What an operator carries along beside id and text."""
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the toxicity grammar predicts toxic; it learns from labels that are not held out.

    Null and empty texts are scored as texts without matches; repeated rows fare alike; an empty table, or one without
    labels, loses nothing; all columns are kept as they are.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), allowed=lambda c: ~toxicity.held_out(c))
    return docs.where(toxicity.score_column(spark, model, F.col("text"))["predicted"] == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (similarity of 0.8 or more) the row with the smallest doc_id, and all rows without words.

    Decided by row: ids may be null or repeat, rows that only share an id with a copy stay, and of repeated rows one stays.
    Null and empty texts stay; an empty table gives no rows; all columns are kept as they are.
    """
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])  # so that no column hides the place, or looks like one
    place = F.struct("_metadata.file_path", "_metadata.row_index").alias("_row")
    try:
        keyed = plain.select("*", place)
    except AnalysisException:  # not read from files
        keyed = materialize(plain).select("*", place)
    own = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    found = materialize(near_dup.near_duplicates(keyed, id_col=own["doc_id"], text_col=own["text"], percent=80, row_col="_row"))
    gone = found.where(~F.col("stays")).select(F.col("row").alias("_row"))
    gone = F.broadcast(gone) if gone.count() <= near_dup.BROADCAST_ROWS else gone
    return keyed.join(gone, "_row", "left_anti").drop("_row").toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words running of a benchmark item, or a shorter item whole.

    Null and empty texts have no words and stay; repeated rows fare alike; an empty table of either kind drops nothing; all
    columns are kept as they are.
    """
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.where(F.size("spans") == 0).select("doc.*")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret with a mark; all documents stay. n_chars follows the new text.

    Null texts become empty; repeated rows fare alike; an empty table gives no rows; other columns are kept as they are.
    """
    rest = _rest(docs)
    found = secrets.redacted(secrets.find_secrets(docs, keep=rest))
    own = {"doc_id": F.col("id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return found.select(*[own.get(c, F.col(f"c_{c}")).alias(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with whether they decode to its text: n_tokens, ids, ids_sha256, round_trip.

    Null and empty texts have no ids; repeated rows fare alike; an empty table gives no rows; columns other than the text
    are kept as they are, but those that are named like a result, in whatever case, give way to it.
    """
    made = ("n_tokens", "ids", "ids_sha256", "round_trip")
    rest = tuple(c for c in _rest(docs) if c.lower() not in made)
    coded = pieces.encode_documents(docs, keep=rest)
    return coded.select(F.col("id").alias("doc_id"), *[F.col(f"c_{c}").alias(c) for c in rest], *made)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", tokenize),
]
#: No stage's rows can be given in SQL: a trained model decides in the first.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
