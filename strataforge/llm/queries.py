"""The queries of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def held_out(n: int, k: int) -> Column:
    """Whether crc32 of the id as text leaves ``k`` modulo ``n``; a null id is held out."""
    return F.coalesce(_remainder(n) == k, F.lit(True))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Of op1: verdict and rule.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels whose doc_id is a page's id, the only labels that the tables have."""
    from strataforge.llm.url_reputation import apply_rules, judge, reputation, with_parts

    parts = with_parts(_table(spark, sf_dir, "pages").select("page_id", "url"))
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")).where("good is not null")
    hosts, prior = reputation(parts.join(labels, "page_id").select("host", "good"))
    return judge(apply_rules(parts, RULES), hosts, prior).select("page_id", "host", "path", "rule", "verdict", "score", "lower")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.decontaminate import find_windows

    found = find_windows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    n_items = F.size("item_ids").cast("bigint")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.packing import pack, tokenize_pieces

    pieces = tokenize_pieces(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Fitted on labelled rows of ``docs`` whose id is not held out."""
    from strataforge.llm.quality_nbsvm import TRAIN_ROWS, fit
    from strataforge.llm.training import labelled_sample

    return fit(labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", TRAIN_ROWS, ~held_out(3, 1)))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.quality_nbsvm import score

    docs = _table(spark, sf_dir, "documents")
    found = score(docs, quality_model(spark, docs, sf_dir))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flagged`` is the decision by the thresholds calibrated per language, where the row's language has one."""
    from strataforge.llm.toxicity_cnn import TRAIN_ROWS, fit, score
    from strataforge.llm.training import labelled_sample

    docs = _table(spark, sf_dir, "documents")
    model, by_lang, overall = fit(labelled_sample(docs, _table(spark, sf_dir, "labels"), "toxic", TRAIN_ROWS, ~held_out(4, 2), extra=("lang",)), "lang")
    threshold = F.lit(overall)
    for lang, value in by_lang.items():
        threshold = F.when(F.col("lang") == lang, value).otherwise(threshold)
    found = score(docs, model, ("doc_id", "lang"))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), (F.col("score") >= threshold).alias("flagged"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.suffix_dedup import find_repeats

    found = find_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.media_boxes import encode_media, probe

    found = probe(encode_media(_table(spark, sf_dir, "documents")))
    key = F.col("keyframes")
    feature = F.concat_ws(";", F.trim("codec"), F.col("duration").cast("string"), F.col("timescale").cast("string"), F.size(key).cast("string"), key[0]["start"].cast("string"), F.element_at(key, -1)["start"].cast("string"), F.element_at(key, -1)["length"].cast("string"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.ppm import score

    return score(_table(spark, sf_dir, "documents"), held_out(7, 2))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strataforge.llm.langid_hd import identify, prototypes

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, prototypes(docs.where(~held_out(4, 2))))
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Query]:
    return {
        "op1_url_reputation": op1_url_reputation,
        "op2_ngram_join": op2_ngram_join,
        "op3_decontaminate": op3_decontaminate,
        "op4_packing": op4_packing,
        "op5_quality": op5_quality,
        "op6_toxicity": op6_toxicity,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_media": op8_media,
        "op9_lm_score": op9_lm_score,
        "op10_langid": op10_langid,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_sql(what: int) -> str:
    """The longest fitting rule's text (1) or verdict (0)."""
    out = []
    for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule[1].partition("/")
        out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}') THEN '{rule[what]}'")
    return "CASE " + " ".join(out) + " END"


def _strength_sql(level: str, parents: str) -> str:
    by = f"SELECT count(*) AS g, sum(n) AS n, sum(k) AS k, sum(n * n) AS n2, sum(k * k / n) AS kk FROM {level} {f'GROUP BY {parents}' if parents else 'HAVING count(*) > 0'}"
    sums = f"SELECT sum(kk - k * k / n - (g - 1) * (k / n) * (1 - k / n)) AS spread, sum(n - n2 / n) AS scale, sum(n * (k / n) * (1 - k / n)) / sum(n) AS inside FROM ({by})"
    return f"(SELECT CASE WHEN inside IS NULL OR scale <= 1e-9 OR spread <= 1e-9 THEN 10000.0 ELSE least(10000.0, greatest(1.0, inside / (spread / scale) - 1)) END FROM ({sums}))"


def _two_label_sql() -> str:
    from strataforge.llm.url_reputation import TWO_LABEL_SUFFIXES

    return ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)


_OP1_SQL = f"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    names AS (SELECT host, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS w FROM (SELECT DISTINCT host FROM p)),
    sites AS (SELECT host, CASE WHEN array_to_string(w, '.') SIMILAR TO '[0-9.]+' THEN array_to_string(w, '.') WHEN array_to_string(w[-2:], '.') IN ({_two_label_sql()}) THEN array_to_string(w[-3:], '.') ELSE array_to_string(w[-2:], '.') END AS domain, CASE WHEN array_to_string(w, '.') SIMILAR TO '[0-9.]+' THEN '' WHEN array_to_string(w[-2:], '.') IN ({_two_label_sql()}) THEN array_to_string(w[-2:], '.') ELSE w[-1] END AS suffix FROM names),
    h AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM p JOIN labels ON doc_id = page_id JOIN sites USING (host) WHERE quality IS NOT NULL GROUP BY ALL),
    dm AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL), sx AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM dm GROUP BY ALL),
    r AS (SELECT coalesce(sum(n), 0) AS total, coalesce(sum(k) / sum(n), 0.5) AS rate FROM h),
    c AS (SELECT rate, coalesce({_strength_sql("h", "domain, suffix")}, 10000.0) AS sh, coalesce({_strength_sql("dm", "suffix")}, 10000.0) AS sd, coalesce({_strength_sql("sx", "")}, 10000.0) AS ss FROM r),
    ms AS (SELECT suffix, (k + ss * rate) / (n + ss) AS sm FROM sx, c), md AS (SELECT domain, (k + sd * sm) / (n + sd) AS dmean FROM dm JOIN ms USING (suffix), c),
    a AS (SELECT host, coalesce(k, 0) + sh * coalesce(dmean, sm, rate) AS alpha, coalesce(n, 0) + sh AS size FROM sites LEFT JOIN (SELECT host, n, k FROM h) USING (host) LEFT JOIN md USING (domain) LEFT JOIN ms USING (suffix), c),
    l AS (SELECT host, round(alpha / size, 6) AS score, round(greatest(0.0, alpha / size - 1.645 * sqrt(alpha / size * (1 - alpha / size) / (size + 1))), 6) AS lower FROM a)
    SELECT page_id, host, path, {_rule_sql(1)} AS rule, coalesce({_rule_sql(0)}, CASE WHEN lower >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict, score, lower FROM p JOIN l USING (host)"""

_OP2_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, w[i : i + least(4, len(w)) - 1] AS g FROM d, unnest(range(1, len(w) - least(4, len(w)) + 2)) t(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
    r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, z.b FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) z ON r.c = z.a)
    SELECT doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_OP3_SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (SELECT DISTINCT item_id, least(8, len(w)) AS m, w[i : i + least(8, len(w)) - 1] AS g FROM b, unnest(range(1, len(w) - least(8, len(w)) + 2)) t(i) WHERE len(w) > 0),
    dw AS (SELECT doc_id, i, m, w[i : i + m - 1] AS g FROM d, (SELECT DISTINCT m FROM bw), unnest(range(1, len(w) - m + 2)) t(i) WHERE len(w) >= m),
    h AS (SELECT doc_id, i, m, item_id FROM dw JOIN bw USING (m, g)),
    hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM h), unnest(range(i, i + m)) u(j) GROUP BY doc_id),
    hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_reputation": _OP1_SQL, "op2_ngram_join": _OP2_SQL, "op3_decontaminate": _OP3_SQL}
