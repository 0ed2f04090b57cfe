"""Registered queries of this package over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.llm.alignment import align_tokens
from aftershock.llm.common import store
from aftershock.llm.hard_negatives import hard_negatives
from aftershock.llm.line_dups import drop_repeated_lines
from aftershock.llm.near_dups import near_duplicates
from aftershock.llm.neighbour_tree import nearest_found
from aftershock.llm.packing import pack_documents
from aftershock.llm.pieces import encode_pieces
from aftershock.llm.token_counts import count_tokens
from aftershock.llm.token_files import read_token_files, write_token_files
from aftershock.llm.suffix_dedup import drop_repeated_strings
from aftershock.llm.quality import fit_quality, score_quality
from aftershock.llm.tiles import vectors_of
from aftershock.llm.tokens import encode_documents
from aftershock.llm.top_products import top_products
from aftershock.llm.url_templates import Rule, judge_urls
from aftershock.session import new_path

PIECES, BYTE_BPE = "piece_bpe_32k.model", "byte_bpe_50k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_pieces")
def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives its text back."""
    coded = encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), decoded=True)
    restored = F.col("decoded") == F.translate("text", "▁", " ")
    return coded.select("doc_id", "ids", F.size("ids").alias("n_pieces"), restored.alias("restored"))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from token files."""
    folder = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer_path(BYTE_BPE), end_id=2)
    return read_token_files(spark, folder, with_ids=False)


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(PIECES), limit=4096)


OP6_SQL = """
WITH rows_ AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM rows_ q JOIN rows_ c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""


@query("op6_top_products", OP6_SQL)
def op6_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest inner products of quantised vectors, for each fiftieth vector."""
    rows = vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    rows = rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * 256).cast("double")))
    found = top_products(rows.filter("vec_id % 50 = 0"), rows, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


@query("op10_neighbour_tree")
def op10_neighbour_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors found for each fiftieth vector."""
    rows = vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = nearest_found(rows.filter("vec_id % 50 = 0"), rows, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label may not be learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a third of the labels is held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    tokens = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), end_id=0)
    return pack_documents(store(tokens, "tokens"), 1024)


@query("op5_near_dups")
def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query("op9_line_dups")
def op9_line_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without repeated lines."""
    docs = table(spark, sf_dir, "documents")
    return drop_repeated_lines(docs).select("doc_id", "text", "removed_lines")


# The rules of the url query.
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


@query("op4_url_templates")
def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), [Rule.of(r) for r in URL_RULES])


OP13_SQL = """
WITH rows_ AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id AND len(r.v) = len(a.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
    SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS n
    FROM positives JOIN scored s USING (anchor_id)
    WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE n <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector."""
    given = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # The label passes the checks of vectors as a last component.
    vector = F.concat(F.col("embedding").cast("array<double>"), F.array(moved.cast("double")))
    rows = vectors_of(given.withColumn("embedding", vector), "vec_id", "embedding")
    rows = rows.filter("size(vec) > 1").select(
        "vec_id", F.element_at("vec", -1).cast("long").alias("label"),
        F.transform(F.slice("vec", 1, F.size("vec") - 1), lambda x: F.floor(x * 256).cast("double")).alias("vec"),
    )
    return hard_negatives(rows.filter("vec_id % 100 = 0"), rows)


@query("op12_suffix_dups")
def op12_suffix_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    cut = drop_repeated_strings(table(spark, sf_dir, "documents"), span=400)
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["begin"])
    return cut.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over each other in every document."""
    docs = table(spark, sf_dir, "documents")
    return align_tokens(docs, tokenizer_path(BYTE_BPE), tokenizer_path(PIECES), hashed=True)
