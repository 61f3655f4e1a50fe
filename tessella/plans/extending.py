"""Agreement of raters, extension points called from SQL, token batches, decomposed normal forms."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, batches, extensions
from .common import VOTES_SQL, rounded, table
from .common import votes as vote_rows


def agreement_ac1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each language how far the judges agree beyond chance; their errors are no ratings."""
    rating = F.when(~F.col("error"), F.col("vote"))
    return rounded(agreement.gwet_ac1(vote_rows(spark, sf_dir), ["lang"], "doc_id", rating, [True, False]))


def spread_ratio(x, y) -> float:
    """How much wider the second column spreads than the first; undefined where the first does not."""
    if x.max() == x.min():
        raise ValueError("no spread")
    return (y.max() - y.min()) / (x.max() - x.min())


def sql_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statistic of one's own as an aggregate of SQL."""
    extensions.register_statistic(spark, "spread_ratio", spread_ratio)
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_rows")
    found = spark.sql("""SELECT c_nationkey, spread_ratio(CAST(c_custkey AS DOUBLE), CASE WHEN c_custkey % 5 > 0 THEN CAST(c_acctbal AS DOUBLE) END) AS ratio,
                                spread_ratio(CAST(c_nationkey AS DOUBLE), CAST(c_acctbal AS DOUBLE)) AS none FROM customer_rows GROUP BY c_nationkey""")
    return rounded(found)


def candidates(key: int | None, name: str | None) -> list[tuple[int, str]]:
    """As many candidates as the key's last digit says."""
    return [(k, f"{name} {k}") for k in range(1, (key or 0) % 10 + 1)]


def sql_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator of one's own as a table function: each customer's candidates."""
    extensions.register_generator(spark, "candidates", candidates, "attempt int, target string")
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_rows")
    return spark.sql("SELECT c_custkey, attempt, target FROM customer_rows, LATERAL candidates(c_custkey, c_name)")


def padded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token batches of 256 ids; an id is a word's length."""
    ids = F.transform(T.words(F.coalesce("text", F.lit(""))), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    return batches.padded(rows, "ids", length=256, pad_id=7).select("doc_id", "input_ids", "attention_mask", "labels")


def decomposed_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both normal forms with decomposition, whole texts, as hashes."""
    normal, dedup = T.normal_form(F.col("text")), T.dedup_form(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.digest(normal, 64).alias("normal_hash"), T.digest(dedup, 64).alias("dedup_hash"), F.length(normal).alias("n_chars"))


QUERIES = {f.__name__: f for f in (agreement_ac1, sql_statistic, sql_generator, padded_batches, decomposed_forms)}

#: Letters that decompose, by the rule of the standard, of the blocks that the tables use.
_DECOMPOSED = {chr(c): d for c in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07)] if (d := unicodedata.normalize("NFKD", chr(c))) != chr(c)}
_QUOTED = lambda x: "'" + x.replace("'", "''") + "'"
_MAP = f"MAP {{{', '.join(f'{_QUOTED(a)}: {_QUOTED(b)}' for a, b in _DECOMPOSED.items())}}}"
_FOLDED = "lower(list_aggregate(list_transform(regexp_split_to_array(text, ''), lambda c: coalesce(m[c], c)), 'string_agg', ''))"
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_LATEX = r"regexp_replace(t, '\\(?:text|mathrm|mathbf|frac|sqrt|left|right|begin|end)\b', ' ', 'g')"

ORACLES = {
    "agreement_ac1": f"""WITH {VOTES_SQL}, items AS (
          SELECT lang, doc_id, count(*) FILTER (vote AND NOT error) AS c0, count(*) FILTER (NOT vote AND NOT error) AS c1 FROM votes GROUP BY lang, doc_id),
        t AS (SELECT *, c0 + c1 AS r FROM items WHERE c0 + c1 > 0),
        u AS (SELECT lang, CASE WHEN r > 1 THEN 1 ELSE 0 END AS m, CASE WHEN r > 1 THEN (c0 * (c0 - 1) + c1 * (c1 - 1)) / (r * (r - 1)) ELSE 0 END AS a, c0 / r AS p FROM t),
        s AS (SELECT lang, count(*) AS n, sum(m) AS sm, sum(a) AS sa, sum(p) AS sp FROM u GROUP BY lang),
        w AS (SELECT s.*, sa / sm AS agreement, 2 * (sp / n) * (1 - sp / n) AS chance FROM s),
        x AS (SELECT u.lang, (sa - a) / (sm - m) AS o, 2 * ((sp - p) / (n - 1)) * (1 - (sp - p) / (n - 1)) AS e FROM u JOIN s USING (lang)),
        v AS (SELECT lang, var_pop((o - e) / (1 - e)) AS var FROM x GROUP BY lang),
        y AS (SELECT *, (agreement - chance) / (1 - chance) AS ac1, 1.96 * sqrt((n - 1) * var) AS d FROM w JOIN v USING (lang))
        SELECT lang, n AS n_items, round(agreement, 6) AS agreement, round(chance, 6) AS chance, round(ac1, 6) AS ac1, round(ac1 - d, 6) AS lo, round(ac1 + d, 6) AS hi FROM y""",
    "sql_statistic": """SELECT c_nationkey, round((max(b) - min(b)) / (max(c_custkey) - min(c_custkey)), 6) AS ratio, CAST(NULL AS DOUBLE) AS none
        FROM (SELECT c_nationkey, c_custkey, CAST(c_acctbal AS DOUBLE) AS b FROM customer WHERE c_custkey % 5 > 0 AND c_acctbal IS NOT NULL)
        GROUP BY c_nationkey HAVING max(c_custkey) > min(c_custkey)
        UNION ALL SELECT c_nationkey, NULL, NULL FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey) FILTER (c_custkey % 5 > 0 AND c_acctbal IS NOT NULL) < 2""",
    "sql_generator": "SELECT c_custkey, CAST(k AS INTEGER) AS attempt, c_name || ' ' || k AS target FROM customer, range(1, 10) g(k) WHERE k <= c_custkey % 10",
    "padded_batches": r"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\s\p{Z}\x{85}\x{1c}-\x{1f}]+'), lambda w: length(w))[1:256] AS ids FROM documents)
        SELECT doc_id, list_resize(ids, 256, 7) AS input_ids, list_resize(list_transform(ids, lambda x: 1), 256, 0) AS attention_mask, list_resize(ids, 256, -100) AS labels FROM d""",
    "decomposed_forms": f"""WITH m AS (SELECT {_MAP} AS m), f AS (SELECT doc_id, {_FOLDED} AS t FROM documents, m),
        g AS (SELECT doc_id, {_SQUEEZED.format(_LATEX)} AS normal, {_SQUEEZED.format('t')} AS dedup FROM f)
        SELECT doc_id, sha256(normal) AS normal_hash, sha256(dedup) AS dedup_hash, CAST(length(normal) AS INTEGER) AS n_chars FROM g""",
}
