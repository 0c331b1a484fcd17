"""Feature recommendation: matching attribute names to a corpus of features by text.

The embedder is pluggable; the one here weighs words and letter 3-grams by inverse document frequency, not by a trained sentence
model, so similarities differ from one. An embedding is a table of terms and weights, and cosines are an equi-join on the terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.functions.columns import col

def clean_text(name: Column, description: Column | None = None) -> Column:
    """Camel case is split, marks become spaces, white space is one space."""
    split = F.regexp_replace(F.coalesce(name, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    whole = F.concat_ws(" ", split, description) if description is not None else split
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(whole), "[^a-z0-9 ]", " "), " +", " "))


def terms(text: Column) -> Column:
    words = F.filter(F.split(text, " "), lambda w: w != "")
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.substr(F.concat(F.lit("^"), w, F.lit("$")), i, F.lit(3)))))
    return F.concat(words, grams)


def term_embedder(corpus: DataFrame, text_col: str) -> Callable[[DataFrame, list[str], str], DataFrame]:
    """An embedder fitted on the corpus: from a frame, its key columns and its text column, rows (keys, term, weight), each text of length 1."""
    n = corpus.count()
    df = corpus.select(F.explode(F.array_distinct(terms(col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_df"))

    def embed(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
        counts = frame.select(*(col(k) for k in keys), F.explode(terms(col(name))).alias("term")).groupBy(*(col(k) for k in keys), "term").agg(F.count(F.lit(1)).alias("_tf"))
        weighed = counts.join(df, "term", "left").withColumn("weight", F.col("_tf") * F.ln((n + 1.0) / (F.coalesce("_df", F.lit(0)) + 1.0)))
        norm = weighed.groupBy(*(col(k) for k in keys)).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
        return weighed.join(norm, keys).where("_norm > 0").select(*keys, "term", (F.col("weight") / F.col("_norm")).alias("weight")).where("weight > 0")

    return embed


def cosines(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys of both, similarity to 4 digits) of embeddings that share a term."""
    both = a.withColumnRenamed("weight", "_wa").join(b.withColumnRenamed("weight", "_wb"), "term")
    return both.groupBy(*(col(k) for k in keys)).agg(F.round(F.sum(F.col("_wa") * F.col("_wb")), 4).alias("similarity"))


def prepare_corpus(corpus: DataFrame) -> DataFrame:
    """Features (feature_name, feature_desc, industry, usecase), with industries and use cases of one feature joined by commas."""
    names = corpus.columns[:4]
    c = corpus.toDF(*(["feature_name", "feature_desc", "industry", "usecase", *corpus.columns[4:]])) if list(names) != ["feature_name", "feature_desc", "industry", "usecase"] else corpus
    low = [F.trim(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9 _,./-]", " "))).alias(x) for x in ("industry", "usecase")]
    grouped = c.select("feature_name", "feature_desc", *low).groupBy("feature_name", "feature_desc")
    return grouped.agg(*(F.array_join(F.array_sort(F.collect_set(x)), ", ").alias(x) for x in ("industry", "usecase")))


def listed(corpus: DataFrame, what: str) -> DataFrame:
    """Distinct ``industry`` or ``usecase`` values, or their pairs (``pair``)."""
    return corpus.select("industry", "usecase").distinct() if what == "pair" else corpus.select(what).distinct()


def nearest(corpus: DataFrame, column: str, value: str, semantic: bool = True) -> str:
    """The corpus value that is the given one or, if ``semantic``, is most like it."""
    value = value.strip().lower()
    values = corpus.select(column).distinct()
    if not semantic or values.where(col(column) == value).limit(1).count():
        return value
    embed = term_embedder(values, column)
    mine = embed(corpus.sparkSession.createDataFrame([(value,)], "_q string"), ["_q"], "_q")
    best = cosines(mine, embed(values, [column], column), ["_q", column]).orderBy(F.desc("similarity"), column).first()
    return best[column] if best else value


def features_by(corpus: DataFrame, industry: str | None = None, usecase: str | None = None, num_of_feat: int | str = 100, semantic: bool = True) -> DataFrame:
    """Features of an industry and/or use case; with one of them, those whose other value is frequent come first."""
    out = corpus
    for column, value in (("industry", industry), ("usecase", usecase)):
        if value is not None:
            out = out.where(col(column).contains(nearest(corpus, column, value, semantic)))
    if industry is None or usecase is None:
        other = "usecase" if usecase is None else "industry"
        count = out.groupBy(other).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(count, other).orderBy(F.desc("_n"), other, "feature_name").select(*corpus.columns)
    else:
        out = out.orderBy("feature_name")
    return out if num_of_feat == "all" else out.limit(int(num_of_feat))


def listed_by(corpus: DataFrame, want: str, given: str, value: str, semantic: bool = True) -> DataFrame:
    """Distinct ``want`` (industry or usecase) of rows whose ``given`` is the value."""
    return corpus.where(col(given).contains(nearest(corpus, given, value, semantic))).select(want).distinct()


def feature_mapper(attributes: DataFrame, corpus: DataFrame, name_column: str, desc_column: str | None = None, suggested_industry: str = "all", suggested_usecase: str = "all", semantic: bool = True, top_n: int = 2, threshold: float = 0.3, embedder=None) -> DataFrame:
    """For each attribute the ``top_n`` features most like it, of a similarity of ``threshold`` or more; "N/A" if there is none."""
    for column, value in (("industry", suggested_industry), ("usecase", suggested_usecase)):
        if value != "all":
            corpus = corpus.where(col(column).contains(nearest(corpus, column, value, semantic)))
    right = corpus.withColumn("_text", clean_text(col("feature_name"), col("feature_desc")))
    left = attributes.withColumn("_text", clean_text(col(name_column), col(desc_column) if desc_column else None))
    embed = embedder or term_embedder(right, "_text")
    scored = cosines(embed(left, [name_column], "_text"), embed(right, ["feature_name", "feature_desc"], "_text"), [name_column, "feature_name", "feature_desc"])
    scored = scored.where(F.col("similarity") >= threshold).join(corpus.select("feature_name", "feature_desc", "industry", "usecase"), ["feature_name", "feature_desc"])
    w = Window.partitionBy(name_column).orderBy(F.desc("similarity"), "feature_name")
    best = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_n).drop("_r")
    out = attributes.select(col(name_column)).join(best.select(name_column, "feature_name", "feature_desc", "industry", "usecase", "similarity"), name_column, "left")
    return out.fillna("N/A", subset=["feature_name", "feature_desc", "industry", "usecase"])


def find_attr_by_relevance(attributes: DataFrame, building_corpus: list[str], name_column: str, desc_column: str | None = None, threshold: float = 0.3, embedder=None) -> DataFrame:
    """For each phrase of ``building_corpus`` the attributes of a similarity of ``threshold`` or more; "N/A" if there is none."""
    phrases = attributes.sparkSession.createDataFrame([(p,) for p in building_corpus], "phrase string").withColumn("_text", clean_text(F.col("phrase")))
    left = attributes.withColumn("_text", clean_text(col(name_column), col(desc_column) if desc_column else None))
    embed = embedder or term_embedder(left, "_text")
    found = cosines(embed(phrases, ["phrase"], "_text"), embed(left, [name_column], "_text"), ["phrase", name_column]).where(F.col("similarity") >= threshold)
    return phrases.select("phrase").join(found, "phrase", "left").fillna("N/A", subset=[name_column])


def sankey_frames(mapped: DataFrame, source: str, target: str = "feature_name") -> tuple[DataFrame, DataFrame]:
    """Nodes and weighted edges of a mapping, for any chart library."""
    edges = mapped.groupBy(col(source).alias("source"), col(target).alias("target")).agg(F.sum(F.coalesce("similarity", F.lit(0.0))).alias("weight"))
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct(), edges
