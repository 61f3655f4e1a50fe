"""Dataflow: state, joins, lookups, schemas of results, streams, event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numbers import order_key, ratio
from ..operators import upsert as state
from ..operators.choice import both_conditions
from ..streaming import leases
from .common import rounded, table


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are the seeds, line items shipped before 1996 what is written."""
    seeds = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf_dir, "lineitem").where("l_shipdate < '1996-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return state.remaining(seeds, done, ["o_orderkey"])


def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return state.latest(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def upsert_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """January's first half is what there is, the rest comes in; equal days keep the old."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    last = lambda rows: state.latest(rows.select("user_id", "event_type", "event_id", "day"), ["user_id", "event_type"], [F.col("day"), F.col("event_id")])
    old, new = last(e.where("event_id % 2 = 0")), last(e.where("event_id % 2 = 1"))
    return state.upsert(old, new, ["user_id", "event_type"], "day").select("user_id", "event_type", "event_id", "day")


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 > 0").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 > 0, F.col("c_mktsegment")).alias("segment"))
    new = c.where("c_custkey % 5 > 0").select("c_custkey", F.when(F.col("c_custkey") % 4 > 0, F.upper("c_name")).alias("c_name"), F.col("c_mktsegment").alias("segment"))
    return state.carry_forward(old, new, "c_custkey")


def gold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with the last of their orders, by date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return state.lookup(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]).select("c_custkey", "o_orderkey")


def preference_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user' and turn < 2").groupBy("conv_id").agg(F.min("text").alias("target"))
    opposite = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("other"))
    found = state.preference_triples(user.withColumn("retain", F.lit(None).cast("string")), opposite, "conv_id", [F.col("turn")], ("target", "retain", "other"))
    return found.select("conv_id", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"))


def full_outer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score tables joined by a normalised name."""
    a = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("supplier_mean")).where("s_nationkey < 20")
    b = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("customer_mean")).where("c_nationkey >= 5")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower(F.trim("n_name")).alias("name"))
    left = a.join(n, a.s_nationkey == n.n_nationkey).select("name", "supplier_mean")
    right = b.join(n, b.c_nationkey == n.n_nationkey).select("name", "customer_mean")
    return rounded(left.join(right, "name", "full_outer"), 4)


def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of two measures of each part, every pair of measures once."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    names = ["q", "d", "t"]
    products = [F.struct(F.lit(f"{a} x {b}").alias("pair"), (F.col(a) * F.col(b)).alias("v")) for i, a in enumerate(names) for b in names[i + 1 :]]
    long = rows.select("l_partkey", F.explode(F.array(*products)).alias("p"))
    return rounded(long.groupBy("p.pair").agg(F.count("*").alias("n"), F.avg("p.v").alias("mean"), F.max("p.v").alias("most")), 5)


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of union, intersection and difference of the short and the repeated sources of texts."""
    d = table(spark, sf_dir, "documents")
    a, b = d.where(F.length("text") < 500).select("doc_id"), d.where("lang = 'en'").select("doc_id")
    count = lambda name, rows: rows.agg(F.lit(name).alias("operation"), F.count("*").alias("n"))
    out = count("bag", a.unionByName(b))
    for name, rows in (("union", a.union(b).distinct()), ("intersection", a.intersect(b)), ("difference", a.subtract(b))):
        out = out.unionByName(count(name, rows))
    return out


def story_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    return rounded(both_conditions(rows, ["k"], "o_orderstatus", ["F", "O"], F.col("o_totalprice")).withColumnsRenamed({"F": "tb", "O": "fb"}), 4)


def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("long"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max(F.element_at(F.from_json("props", "map<string,long>"), "k")).alias("most"))


def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    prompt = T.fill("{{lang}}: {{head}} [{{none}}] {{snake}} {{body}}", body=F.col("text"), lang=F.col("lang"), head=F.left("text", F.lit(20)), none=F.lit(None).cast("string"), snake=T.snake_case(F.concat(F.col("lang"), F.lit("ThatItWas"), F.initcap("source"))))
    return d.select("doc_id", prompt.alias("prompt"), T.tail_chars(F.col("text"), 30).alias("tail"), F.array_join(T.tail_words(F.col("text"), 5), " ").alias("last_words"), T.first_of(F.lit(""), F.col("source"), default="none").alias("first"))


def column_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.md5("html").alias("md5"), F.octet_length("html").cast("long").alias("bytes"))


def stale_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are heartbeats: users hold event types as their items."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("node"), F.col("ts").alias("at"))
    return leases.current_leases(e, F.lit("2024-01-30 12:00:00").cast("timestamp"), 1440).select("item", "node", "stale")


def heartbeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    found = leases.sessions(e, "user_id", "ts", 720)
    return found.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation statistics: outcomes by category, from hashes."""
    d = table(spark, sf_dir, "documents").withColumn("outcome", F.element_at(F.array(F.lit("accepted"), F.lit("rejected"), F.lit("failed")), F.conv(F.substring(order_key(F.col("doc_id")), 3, 1), 16, 10).cast("int") % 3 + 1))
    return d.groupBy("lang").pivot("outcome", ["accepted", "rejected", "failed"]).count().na.fill(0)


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows, an extension: days by event type."""
    e = table(spark, sf_dir, "events")
    found = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(found.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean"), 5)


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star schema, an extension: the classic pricing report."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    found = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(net).alias("sum_net"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
    return rounded(found, 2)


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star schema, an extension: five joins, the large sides by their keys."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    found = rows.groupBy("r_name", "n_name").agg(F.sum(net).alias("revenue"), F.count("*").alias("n"))
    return rounded(found.withColumn("share", ratio(F.col("n"), F.col("n") + 1)), 2)


QUERIES = {f.__name__: f for f in (resume_anti, latest_wins, upsert_results, carry_forward, gold_lookup, preference_triples, full_outer_keys, pair_features, set_operations, story_conditions, json_properties, prompt_fill, column_checksums, stale_leases, heartbeat_runs, outcome_counts, hourly_windows, pricing_summary, revenue_by_nation)}

ORACLES = {
    "resume_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < '1996-01-01')",
    "latest_wins": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
    "upsert_results": """WITH e AS (SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d') AS day, event_id % 2 AS side FROM events),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, side ORDER BY day DESC, event_id DESC) AS r FROM e) WHERE r = 1)
        SELECT user_id, event_type, event_id, day FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY user_id, event_type ORDER BY day DESC, side) AS r FROM l) WHERE r = 1""",
    "carry_forward": """WITH o AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 > 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 3 > 0),
        n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 > 0 THEN upper(c_name) END AS c_name, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 > 0)
        SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.segment, o.segment) AS segment FROM o FULL JOIN n USING (c_custkey)""",
    "gold_lookup": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey",
    "preference_triples": """WITH u AS (SELECT conv_id, min(text) AS t FROM conversations WHERE role = 'user' AND turn < 2 GROUP BY conv_id), o AS (SELECT conv_id, arg_max(text, turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
        SELECT conv_id, md5(u.t) AS chosen, md5(o.t) AS rejected FROM u JOIN o USING (conv_id)""",
    "full_outer_keys": """WITH a AS (SELECT lower(trim(n_name)) AS name, avg(s_acctbal) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey < 20 GROUP BY 1),
        b AS (SELECT lower(trim(n_name)) AS name, avg(c_acctbal) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey >= 5 GROUP BY 1)
        SELECT name, round(a.m, 4) AS supplier_mean, round(b.m, 4) AS customer_mean FROM a FULL JOIN b USING (name)""",
    "pair_features": """WITH r AS (SELECT l_partkey, avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem GROUP BY l_partkey),
        p AS (SELECT 'q x d' AS pair, q * d AS v FROM r UNION ALL SELECT 'q x t', q * t FROM r UNION ALL SELECT 'd x t', d * t FROM r)
        SELECT pair, count(*) AS n, round(avg(v), 5) AS mean, round(max(v), 5) AS most FROM p GROUP BY pair""",
    "set_operations": """WITH d AS (SELECT length(text) < 500 AS a, lang = 'en' AS b FROM documents) SELECT 'bag' AS operation, count(*) FILTER (a) + count(*) FILTER (b) AS n FROM d
        UNION ALL SELECT 'union', count(*) FILTER (a OR b) FROM d UNION ALL SELECT 'intersection', count(*) FILTER (a AND b) FROM d UNION ALL SELECT 'difference', count(*) FILTER (a AND NOT b) FROM d""",
    "story_conditions": "SELECT * FROM (SELECT o_custkey AS k, round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS tb, round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS fb FROM orders GROUP BY 1) WHERE tb IS NOT NULL AND fb IS NOT NULL",
    "json_properties": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "prompt_fill": r"""SELECT doc_id, lang || ': ' || left(text, 20) || ' [] ' || lang || '_that_it_was_' || source || ' ' || text AS prompt, right(text, 30) AS tail,
        array_to_string(list_slice(regexp_extract_all(text, '\S+'), -5, -1), ' ') AS last_words, source AS first FROM documents""",
    "column_checksums": "SELECT page_id, sha256(html) AS sha256, md5(html) AS md5, strlen(html) AS bytes FROM pages",
    "stale_leases": """SELECT user_id AS item, arg_max(event_type, (ts, event_type)) AS node, date_diff('microsecond', max(ts), TIMESTAMP '2024-01-30 12:00:00') // 60000000 >= 1440 AS stale FROM events GROUP BY user_id""",
    "heartbeat_runs": """WITH m AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) // 60000000 >= 720 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        r AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m), c AS (SELECT user_id, run, count(*) AS n FROM r GROUP BY ALL)
        SELECT user_id, count(*) AS runs, max(n) AS longest FROM c GROUP BY user_id""",
    "outcome_counts": """WITH d AS (SELECT lang, CAST(('0x' || substr(md5('0|' || doc_id), 3, 1)) AS INTEGER) % 3 AS k FROM documents)
        SELECT lang, count(*) FILTER (k = 0) AS accepted, count(*) FILTER (k = 1) AS rejected, count(*) FILTER (k = 2) AS failed FROM d GROUP BY lang""",
    "hourly_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(avg(value), 5) AS mean FROM events GROUP BY ALL",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 2) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL""",
    "revenue_by_nation": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, round(count(*) / (count(*) + 1), 2) AS share
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}
