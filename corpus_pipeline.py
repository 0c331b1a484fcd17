"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. SQL can't express the stages as a whole (the first is a
fitted model), so there is no ``ORACLE_SQL``; tests/llm/test_pipeline.py holds each stage and ``run`` against a brute-force version.

Edge cases, for all stages: columns of any further names are carried along, whatever the operators call theirs; a null text is
empty and, if it stays, null; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm import queries as Q
from strataforge.llm.decontaminate import find_windows
from strataforge.llm.ngram_join import jaccard_components
from strataforge.llm.packing import pack, tokenize_pieces
from strataforge.llm.quality_nbsvm import score
from strataforge.llm.staging import passing, stage
from strataforge.llm.suffix_dedup import find_repeats
from strataforge.llm.textkit import cut_spans

ORACLE_SQL = None


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names of its columns' own that no operator uses, and these by the old names."""
    new = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 go."""
    model = Q.quality_model(spark, docs, sf_dir)
    plain, name = _plain(docs)
    return score(plain, model, tuple(plain.columns), name["text"]).where("score >= 0.5").drop("score").toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at a Jaccard similarity of 0.8 in shingles of five words (op2 has its own) the one with the smallest id stays.

    Each row is judged by its own text, so of rows with one id those stay whose text is not linked with a smaller id's; of equal
    rows (id and text) one stays. Rows without an id can't be told apart and stay.
    """
    plain, name = _plain(docs)
    text = F.coalesce(F.col(name["text"]), F.lit(""))
    rows = plain.where(F.col(name["doc_id"]).isNotNull()).withColumns({"id": F.col(name["doc_id"]).cast("bigint"), "key": F.xxhash64(text)})
    with passing() as left:
        found = jaccard_components(rows, n=5, num=80, den=100, id_col="id", text_col=name["text"], key_col="key")
        kept = stage(found.where("id = component_id").select("id", "key").distinct(), "kept")
        left.append(kept)
    first = rows.join(kept, ["id", "key"], "left_semi").dropDuplicates(["id", "key"]).select(*plain.columns)
    return first.unionByName(plain.where(F.col(name["doc_id"]).isNull())).toDF(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that an earlier document has too are cut; documents of which nothing is left go."""
    plain, name = _plain(docs)
    with passing() as kept:
        found = find_repeats(plain, id_col=name["doc_id"], text_col=name["text"]).where("n_removed > 0")
        found = stage(found.select(F.col(name["doc_id"]).alias("id"), "n_bytes", "removed", (F.col("n_removed") == F.col("n_bytes")).alias("gone"), "sha256"), "cut")
        kept.append(found)
    joined = plain.join(found.dropDuplicates(["id", "sha256"]), (F.col(name["doc_id"]) == F.col("id")) & (F.sha2(F.coalesce(F.col(name["text"]), F.lit("")), 256) == F.col("sha256")), "left")
    left = joined.where(~F.coalesce("gone", F.lit(False))).select(*plain.columns, "removed")
    return cut_spans(left, "removed", name["text"], name.get("n_chars")).toDF(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two items or more go; from others the words in such windows are cut."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    plain, name = _plain(docs)
    found = find_windows(plain, benchmark, id_col=name["doc_id"], text_col=name["text"], keep=plain.columns)
    left = found.where(F.size("item_ids") < 2).select(*plain.columns, "hit_spans")
    return cut_spans(left, "hit_spans", name["text"], name.get("n_chars")).toDF(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = tokenize_pieces(docs, Q.tokenizer_path())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
