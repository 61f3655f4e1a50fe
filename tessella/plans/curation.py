"""Curation: decontamination, quality, duplicates, statistics, CJK, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import strip
from ..operators import audit, decontam, gates, quality
from .common import rounded, stripped, table

SIDES = ["target", "retain"]


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("target"), F.lit(None).cast("string").alias("retain"), "lang", "source")


def _hits(spark: SparkSession, sf_dir: str, split: bool = False) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    names = {"EVEN": bench.where("item_id % 2 = 0"), "ODD": bench.where("item_id % 2 = 1")} if split else {"ALL": bench}
    return decontam.contaminated(_pairs(spark, sf_dir), names, "doc_id", SIDES)


def decontam_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", "benchmark", "target_hits", "retain_hits", "total_hits", "overlap_ratio", F.size("sample_ngrams").alias("n_samples"))


def decontam_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.merged(_hits(spark, sf_dir, True), "doc_id", SIDES).select("doc_id", "target_hits", "total_hits", "benchmarks", "overlap_ratio")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    hit = _hits(spark, sf_dir).select("doc_id", F.lit(True).alias("hit"))
    marked = quality.flags(pairs.withColumn("retain", F.col("target"))).join(hit, "doc_id", "left")
    return marked.withColumn("hit", F.coalesce("hit", F.lit(False)))


def decontam_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.drop_summary(_flagged(spark, sf_dir), "bad_quality", "hit")


def decontam_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.cleaned(_pairs(spark, sf_dir).select("doc_id", "lang"), _hits(spark, sf_dir), "doc_id")


def decontam_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the ten records that overlap most."""
    return _hits(spark, sf_dir).orderBy(F.col("overlap_ratio").desc(), "doc_id").limit(10).select("doc_id", "overlap_ratio", "total_hits")


def benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.ngrams_by_window(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.groupBy(F.col("key").alias("item_id")).agg(F.count("*").alias("n_ngrams"), F.sum(F.length("ngram")).alias("n_chars"))


def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retain side is the whole text of the document with the next id, empty for the last."""
    pairs = _pairs(spark, sf_dir).drop("retain")
    pairs = pairs.join(pairs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("target").alias("retain")), "doc_id", "left")
    return quality.flags(pairs).select("doc_id", "q1_empty", "q2_short", "bad_quality", "q_cjk")


def _dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(_pairs(spark, sf_dir), "target", "doc_id")


def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dups(spark, sf_dir).select("doc_id", "first_key", "is_duplicate")


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir).withColumn("retain", F.lit(""))
    return quality.quality_filter(pairs, key="doc_id").select("doc_id", "lang", "source")


def audit_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_pairs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("text"), "doc_id", ["lang"], ["target"])


def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.percentiles(table(spark, sf_dir, "documents"), ["lang"], F.length(strip(F.col("text")))))


def length_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rounded(quality.decile_summary(docs, ["source"], {"chars": F.length("text"), "words": T.word_count(F.col("text"))}))


def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.crosstab(table(spark, sf_dir, "documents"), "lang", "source")
    return found.select("lang", "source", F.col("grouping").cast("long").alias("grouping"), "n", "n_strata")


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(T.words(F.lower("text"))).alias("word"))
    return quality.top_values(words, "word")


def cjk_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ＡＢ１、。호텔漢字「あ」"), F.col("text"))).otherwise(F.col("text"))
    return quality.cjk_report(table(spark, sf_dir, "documents").select("doc_id", marked.alias("target")), ["target"])


def cjk_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("ＡＢ１、。호텔漢字「あ」“ok”"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.repair_cjk(marked).alias("repaired"))


def cjk_repaired_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name under which ``cjk_repaired`` first took whole texts."""
    return cjk_repaired(spark, sf_dir)


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    messy = F.concat(F.lit("  \\frac{A} \t\n \\textbf x "), F.col("text"))
    return docs.select("doc_id", T.digest(T.normal_form(messy, False)).alias("normal_hash"), T.digest(T.dedup_form(messy, False), 16).alias("dedup_hash"), T.word_count(messy).cast("long").alias("n_words"))


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each gate passes or turns away, and for what; the retain side is the whole text of the document with the next id, empty for the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("target"))
    docs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("target").alias("retain")), "doc_id", "left").withColumn("retain", F.coalesce("retain", F.lit("")))
    out = None
    for corpus in ("spl_cc", "stp_cc", "ctr_cc", "core_math", "null_cc", "tom_cc"):
        rule = F.coalesce(F.regexp_extract(gates.gate(corpus, F.col("target"), F.col("retain")).reason(), "^([^']+?)(?: '|$)", 1), F.lit("pass"))
        part = docs.select(F.lit(corpus).alias("corpus"), rule.alias("reason"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("corpus", "reason").agg(F.count("*").alias("n"))


def overlap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity and concept rules: neighbouring turns are the sides, words of the first are the entities."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").pivot("turn", [0, 1]).agg(F.first("text")).where("`0` is not null and `1` is not null")
    own = F.slice(T.words(F.col("0")), 1, 5)
    return turns.select(
        "conv_id", gates.entities_kept(F.col("0"), F.col("1"), own).alias("strict"), gates.entities_mostly_kept(F.col("0"), F.col("1"), own).alias("fuzzy"),
        gates.concept_kept(F.col("0"), F.col("1"), F.array_join(own, " ")).alias("concept"),
    )


QUERIES = {f.__name__: f for f in (decontam_hits, decontam_merged, decontam_summary, decontam_clean, decontam_top, benchmark_ngrams, quality_flags, exact_dups, quality_filter, audit_by_lang, length_percentiles, length_deciles, crosstab, top_values, cjk_report, cjk_repaired, cjk_repaired_whole, normal_forms, gate_reasons, overlap_checks)}

NORMAL = r"trim(regexp_replace(regexp_replace(lower({0}), '\\(?:text|mathrm|mathbf|frac|sqrt|left|right|begin|end)\b', ' ', 'g'), '\s+', ' ', 'g'))"
GRAMS = f"""words AS (SELECT doc_id, string_split({NORMAL.format('text')}, ' ') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM words WHERE len(w) >= 13)),
bench AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 12), ' ') AS g
          FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS i
                FROM (SELECT item_id, string_split({NORMAL.format('text')}, ' ') AS w FROM benchmark) WHERE len(w) >= 13)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
hits AS (SELECT doc_id, count(*) AS h FROM grams WHERE g IN (SELECT g FROM bench) GROUP BY doc_id)"""
HASHED = f"""hashed AS (SELECT *, substr(sha256({NORMAL.format('text')}), 1, 16) AS hash FROM documents),
marked AS (SELECT *, min(doc_id) OVER (PARTITION BY hash) AS first_key FROM hashed)"""

ORACLES = {
    "decontam_hits": f"WITH {GRAMS} SELECT doc_id, 'ALL' AS benchmark, h AS target_hits, CAST(0 AS BIGINT) AS retain_hits, h AS total_hits, round(h / n, 6) AS overlap_ratio, CAST(least(h, 5) AS INTEGER) AS n_samples FROM hits JOIN sizes USING (doc_id)",
    "decontam_merged": f"""WITH {GRAMS}, split AS (
        SELECT doc_id, item_id % 2 AS o, count(DISTINCT g) AS h FROM grams JOIN bench USING (g) GROUP BY ALL)
        SELECT doc_id, CAST(sum(h) AS BIGINT) AS target_hits, CAST(sum(h) AS BIGINT) AS total_hits,
               string_agg(CASE o WHEN 0 THEN 'EVEN' ELSE 'ODD' END, '+' ORDER BY o) AS benchmarks, round(arg_min(h, o) / any_value(n), 6) AS overlap_ratio
        FROM split JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "decontam_summary": f"""WITH {GRAMS}, f AS (SELECT length({stripped('text')}) < 200 AS bad, doc_id IN (SELECT doc_id FROM hits) AS hit FROM documents)
        SELECT count(*) AS original, count(*) FILTER (bad) AS bad, count(*) FILTER (hit) AS contaminated, count(*) FILTER (bad AND hit) AS intersection,
               count(*) FILTER (bad OR hit) AS dropped, count(*) FILTER (NOT (bad OR hit)) AS remaining FROM f""",
    "decontam_clean": f"WITH {GRAMS} SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hits)",
    "decontam_top": f"WITH {GRAMS} SELECT doc_id, round(h / n, 6) AS overlap_ratio, h AS total_hits FROM hits JOIN sizes USING (doc_id) ORDER BY overlap_ratio DESC, doc_id LIMIT 10",
    "benchmark_ngrams": f"WITH {GRAMS} SELECT item_id, count(*) AS n_ngrams, CAST(sum(length(g)) AS BIGINT) AS n_chars FROM bench GROUP BY item_id",
    "quality_flags": f"""SELECT doc_id, {stripped('t')} = '' OR {stripped('r')} = '' AS q1_empty,
        NOT ({stripped('t')} = '' OR {stripped('r')} = '') AND (length({stripped('t')}) < 200 OR length({stripped('r')}) < 200) AS q2_short,
        length({stripped('t')}) < 200 OR length({stripped('r')}) < 200 AS bad_quality, regexp_matches(t || r, '[一-鿿぀-ゟ゠-ヿ]') AS q_cjk
        FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce((SELECT n.text FROM documents n WHERE n.doc_id = d.doc_id + 1), '') AS r FROM documents d)""",
    "exact_dups": f"WITH {HASHED} SELECT doc_id, first_key, doc_id > first_key AS is_duplicate FROM marked",
    "quality_filter": r"""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) ORDER BY doc_id) AS r
        FROM documents WHERE NOT regexp_matches(text, '[一-鿿぀-ゟ゠-ヿ]')) WHERE r = 1""",
    "audit_by_lang": f"""WITH {GRAMS}, {HASHED}, f AS (SELECT lang, {stripped('text')} = '' AS e, {stripped('text')} <> '' AND length({stripped('text')}) < 200 AS s, doc_id > first_key AS d,
            regexp_matches(text, '[一-鿿぀-ゟ゠-ヿ]') AS c, doc_id IN (SELECT doc_id FROM hits) AS h FROM marked)
        SELECT lang, count(*) AS n_rows, count(*) FILTER (e) AS n_q1_empty, count(*) FILTER (s) AS n_q2_short, count(*) FILTER (d) AS n_is_duplicate, count(*) FILTER (c) AS n_q_cjk,
               count(*) FILTER (h) AS n_hit, count(*) FILTER (e OR s OR d OR c OR h) AS total_flagged, round(100.0 * count(*) FILTER (e OR s OR d OR c OR h) / count(*), 2) AS drop_pct
        FROM f GROUP BY lang""",
    "length_percentiles": f"""SELECT lang, count(*) AS n, min(v) AS min, max(v) AS max, round(round(avg(v), 1), 6) AS mean, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.25), 6) AS p25,
        round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95
        FROM (SELECT lang, CAST(length({stripped('text')}) AS INTEGER) AS v FROM documents) GROUP BY lang""",
    "length_deciles": r"""WITH m AS (SELECT source, 'chars' AS measure, CAST(length(text) AS DOUBLE) AS v FROM documents
            UNION ALL SELECT source, 'words', CAST(len(regexp_extract_all(text, '\S+')) AS DOUBLE) FROM documents),
        g AS (SELECT source, measure, count(*) AS n, list(v ORDER BY v) AS l, avg(v) AS mean, median(v) AS med, min(v) AS lo, max(v) AS hi FROM m GROUP BY ALL),
        p AS (SELECT *, greatest(1, least(n - 1, (n + 1) // 10)) AS j1, greatest(1, least(n - 1, 9 * (n + 1) // 10)) AS j9 FROM g)
        SELECT source, measure, n, round(round(mean, 1), 6) AS mean, CAST(trunc(med) AS BIGINT) AS median,
               CAST(trunc(CASE WHEN n >= 10 THEN (l[j1] * (10 - ((n + 1) - 10 * j1)) + l[j1 + 1] * ((n + 1) - 10 * j1)) / 10 ELSE lo END) AS BIGINT) AS p10,
               CAST(trunc(CASE WHEN n >= 10 THEN (l[j9] * (10 - (9 * (n + 1) - 10 * j9)) + l[j9 + 1] * (9 * (n + 1) - 10 * j9)) / 10 ELSE hi END) AS BIGINT) AS p90,
               CAST(lo AS BIGINT) AS min, CAST(hi AS BIGINT) AS max FROM p""",
    "crosstab": "SELECT lang, source, CAST(grouping(lang, source) AS BIGINT) AS grouping, count(*) AS n, count(DISTINCT (lang, source)) AS n_strata FROM documents GROUP BY CUBE (lang, source)",
    "top_values": r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM conversations), c AS (SELECT word, count(*) AS n FROM w GROUP BY word)
        SELECT word, n, (SELECT count(*) FROM c) AS n_different FROM c ORDER BY n DESC, word LIMIT 10""",
    "cjk_report": """SELECT count(*) AS rows, count(*) FILTER (doc_id % 3 = 0) AS changed_rows, CAST(3 * count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS fullwidth_ascii, CAST(2 * count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS explicit_punct,
        CAST(2 * count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS other_cjk_punct, CAST(3 * count(*) FILTER (doc_id % 3 = 0) AS BIGINT) AS ideograph, count(*) FILTER (doc_id % 3 = 0) AS multichar_leak FROM documents""",
    "cjk_repaired": "SELECT doc_id, 'AB1,.hotel“ok”' || text AS repaired FROM documents",
    "cjk_repaired_whole": "SELECT doc_id, 'AB1,.hotel“ok”' || text AS repaired FROM documents",
    "normal_forms": rf"""WITH m AS (SELECT doc_id, '  \frac{{A}} ' || chr(9) || chr(10) || ' \textbf x ' || text AS t FROM documents)
        SELECT doc_id, sha256({NORMAL.format('t')}) AS normal_hash, substr(sha256(trim(regexp_replace(lower(t), '\s+', ' ', 'g'))), 1, 16) AS dedup_hash, CAST(len(regexp_extract_all(t, '\S+')) AS BIGINT) AS n_words FROM m""",
}
