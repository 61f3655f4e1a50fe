"""Analysis: sampling, grids, statistics, regressions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.numbers import order_key
from ..operators import accuracy, regression, resampling, sampling, statistics
from .common import observations, rounded, table
from .common import OBSERVATIONS_SQL as OBS

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source")


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(_docs(spark, sf_dir), ["lang", "source"], "doc_id", 150).select("doc_id", "split")


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_split(_docs(spark, sf_dir), "doc_id", 100, seed=7).select("doc_id", "split")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the sample: 50 documents over all languages."""
    return sampling.stratified_sample(_docs(spark, sf_dir), "lang", "doc_id", 50)


def shuffled_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the sample."""
    return sampling.shuffled_take(_docs(spark, sf_dir), "doc_id", 40, seed=3)


def seed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select("r_name")
    nations = table(spark, sf_dir, "nation").select("n_name")
    segments = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return sampling.grid(regions, segments, nations)


def seed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = sampling.grid(table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "customer").select("c_mktsegment").distinct())
    skeletons = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return sampling.seeds_for_cells(cells, skeletons, "n_nationkey", 90).select("r_name", "c_mktsegment", "draw", "n_name")


def unique_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejection sampling: orders are the candidates, in order of their hash; one of each customer, 60 in all."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", order_key(F.col("o_orderkey")).alias("o"))
    return sampling.unique_draws(rows, ["o_custkey"], 60, "o").select("o_custkey", "o_orderkey")


def distinct_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names"))
    return names.select("n_regionkey", F.array_join(sampling.pick_distinct(F.col("names"), 2, F.col("n_regionkey")), ",").alias("pair"))


def ols_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.ols(observations(spark, sf_dir), ["family"], "ca", "log_params"))


def compression_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = statistics.slopes(observations(spark, sf_dir), ["family", "primitive"], "log_params", ["target", "retain", "ca"], "size_b")
    return rounded(found.withColumn("mode", statistics.compression_mode(*[F.round(F.col(f"{y}_slope"), 9) for y in ("target", "retain", "ca")])))


def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.eta_squared(observations(spark, sf_dir), ["primitive"], "family", "ca"))


def eta_squared_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.eta_squared_given(observations(spark, sf_dir), ["primitive"], "family", "ca", "log_params"))


def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.fixed_effect_slope(observations(spark, sf_dir), ["primitive"], "family", "ca", "log_params", "size_b"))


def _supplier_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[F.avg(m).alias(m) for m in MEASURES])


def pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _supplier_means(spark, sf_dir).unpivot("l_suppkey", MEASURES, "measure", "v")
    return rounded(statistics.pearson_pairs(long, "l_suppkey", "measure", "v", MEASURES))


def pearson_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _supplier_means(spark, sf_dir).select("l_suppkey", F.when(F.col("l_suppkey") % 3 > 0, F.col("l_quantity")).alias("a"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_extendedprice")).alias("b"))
    return rounded(wide.agg(accuracy.correlation(wide, "a", "b", "zero").alias("zero_filled"), accuracy.correlation(wide, "a", "b").alias("pairwise")))


def loo_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _supplier_means(spark, sf_dir).select(F.col("l_suppkey").alias("s"), (F.col("l_quantity") - 25).alias("x"), (F.col("l_discount") * 100).alias("y"))
    return rounded(statistics.leave_one_out_correlation(wide, "s", "x", "y"), 5)


def mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.mean_sd(observations(spark, sf_dir), ["primitive"], "ca"))


def nation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as models: the means of all their customers by segment, so a segment has 25 rows at any scale."""
    means = [F.avg(c).alias(c) for c in ("log_params", "target", "retain", "ca")]
    rows = observations(spark, sf_dir).groupBy("primitive", F.col("family").alias("model")).agg(*means)
    return rows.withColumns({"family": (F.col("model") % 5).cast("string"), "other": (F.col("model") * 7 % 11).cast("double")})


def ridge_loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per segment: how well balance and a number of the nation explain mean order totals."""
    found = regression.ridge_by(nation_scores(spark, sf_dir), "primitive", {s: ["other", "log_params"] for s in SEGMENTS}, "ca", key="model")
    return rounded(found.select("primitive", "n", "r2", F.element_at("betas", "log_params").alias("beta")))


def ridge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per segment: what the spread of order totals adds to the R2 that balance alone has."""
    rows = nation_scores(spark, sf_dir)
    fit = lambda names: regression.ridge_by(rows, "primitive", {s: names for s in SEGMENTS}, "ca", key="model")
    base = fit(["log_params"]).select("primitive", F.col("r2").alias("base_r2"))
    found = fit(["log_params", "retain"]).join(base, "primitive")
    return rounded(found.select("primitive", "r2", "base_r2", (F.col("r2") - F.col("base_r2")).alias("delta"), F.element_at("betas", "retain").alias("beta")))


def sign_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.sign_stability(nation_scores(spark, sf_dir), "primitive", {s: ["other", "log_params"] for s in SEGMENTS}, "ca", key="model")


def eta_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.bootstrap_interval(nation_scores(spark, sf_dir).select("primitive", "model", "family", "ca"), "primitive", regression.eta2_of, key="model")


def slope_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes over all nations and within families, with their intervals."""
    rows = nation_scores(spark, sf_dir).select("primitive", "model", "family", "log_params", "ca")
    both = (("pooled", regression.slope_of), ("within", regression.within_slope_of))
    found = [regression.bootstrap_interval(rows, "primitive", f, draws=1000, key="model").withColumn("kind", F.lit(name)) for name, f in both]
    return found[0].unionByName(found[1])


def pairwise_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.pairwise_lasso(nation_scores(spark, sf_dir), "primitive", ["target", "retain", "log_params"], "ca", key="model")


def bootstrap_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each resample of the nations holds: the sum of its keys and how many different ones."""
    found = sampling.bootstrap_rows(table(spark, sf_dir, "nation"), "n_nationkey", 20)
    return found.groupBy("draw").agg(F.sum("n_nationkey").cast("long").alias("sum"), F.count_distinct("n_nationkey").alias("different"))


def poisson_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty draws of all customers: size and weighted balance of each market segment's resamples."""
    w = resampling.poisson_weight(F.col("c_custkey"), F.col("draw"))
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("draw")).withColumn("w", w)
    found = rows.groupBy("c_mktsegment", "draw").agg(F.sum("w").cast("long").alias("n"), F.sum(F.col("w") * F.col("c_acctbal").cast("double")).alias("total"))
    return rounded(found.select("c_mktsegment", "draw", "n", (F.col("total") / F.col("n")).alias("mean")), 4)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("family", F.col("family").cast("string"))


def poisson_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes over all customers of a segment and inside nations, with intervals of 10,000 draws."""
    rows, key = _scores(spark, sf_dir), F.col("model")
    found = [resampling.interval(resampling.slope_draws(rows, ["primitive"], "log_params", "ca", key, 10_000, within), ["primitive"]).withColumn("kind", F.lit(name)) for name, within in (("pooled", None), ("within", "family"))]
    return found[0].unionByName(found[1])


def poisson_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.interval(resampling.eta_draws(_scores(spark, sf_dir), ["primitive"], "family", "ca", F.col("model"), 2000), ["primitive"])


def poisson_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.sign_stability(_scores(spark, sf_dir), "primitive", ["target", "log_params"], "ca", F.col("model"))


def interaction_lasso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by the hash of the customer."""
    fold = F.pmod(F.xxhash64("model"), F.lit(5))
    return resampling.interaction_lasso(_scores(spark, sf_dir), "primitive", ["target", "retain", "log_params", "size_b"], "ca", fold)


def mixed_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.mixed_slope(_scores(spark, sf_dir), "primitive", "family", "log_params", "ca", "size_b")


def linear_probe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy in both folds and the norm of the weights."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") < 5).cast("int").alias("y"), "embedding", (F.col("vec_id") % 5 > 0).alias("fold"))
    return regression.linear_probe(rows, "y", "embedding", "fold")


def random_direction_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").select("label").distinct()
    return found.select("label", V.random_direction(16, 5, 2.5).alias("direction"))


def bootstrap_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.bootstrap_rows(table(spark, sf_dir, "nation"), "n_nationkey", 20)
    return found.groupBy("draw").agg(F.count("*").alias("n"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one of the next id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return rounded(pairs.select("vec_id", V.cosine(F.col("v"), F.col("w")).alias("cosine")), 5)


def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").withColumn("c", V.cosine(F.col("v"), F.col("w")))
    return rounded(statistics.similarity_summary(pairs, ["label"], "c"), 5)


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rounded(found.select("label", "n", V.norm(F.col("centroid")).alias("norm"), F.col("centroid")[0].alias("first")), 5)


def direction_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine between the directions of labels, each the mean of a label less that of all."""
    rows = table(spark, sf_dir, "embeddings")
    center = V.centroids(rows.select(F.lit(0).alias("k"), "embedding"), "k", "embedding").select(F.col("centroid").alias("base"))
    d = V.centroids(rows, "label", "embedding").crossJoin(F.broadcast(center)).select("label", V.difference(F.col("centroid"), F.col("base")).alias("d"))  # one row
    pairs = d.join(d.select(F.col("label").alias("other"), F.col("d").alias("e")), F.col("label") < F.col("other"))
    return rounded(pairs.select("label", "other", V.cosine(F.col("d"), F.col("e")).alias("cosine")), 5)


def projected_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    base = V.centroids(rows.select(F.lit(0).alias("k"), "v"), "k", "v").select(F.col("centroid").alias("d"))
    p = V.project_out(F.col("v"), F.col("d"))
    return rounded(rows.crossJoin(F.broadcast(base)).select("vec_id", V.norm(p).alias("norm"), F.abs(V.dot(p, F.col("d"))).alias("along")), 5)


def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in groups of ten stand for the tokens of a text."""
    rows = table(spark, sf_dir, "embeddings").withColumn("g", F.expr("vec_id div 10")).groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", V.doubles(F.col("embedding")).alias("v")))), lambda s: s["v"]).alias("vs"))
    vs = F.col("vs")
    return rounded(rows.select("g", V.norm(V.pool_mean(vs)).alias("mean"), V.norm(V.pool_last(vs)).alias("last"), V.norm(V.pool_mean_last(vs, 3)).alias("last3")), 5)


def random_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max(V.norm(V.doubles(F.col("embedding")))).alias("m"))
    return rounded(found.select("label", V.norm(V.random_direction(64, 5, 2.5)).alias("norm")), 5)


def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") < 5).cast("int").alias("y"), "embedding", (F.col("vec_id") % 5 > 0).alias("fold"))
    return regression.linear_probe(rows, "y", "embedding", "fold", iterations=30).select("train", "n")


QUERIES = {f.__name__: f for f in (stratified_split, random_split, stratified_sample, shuffled_take, seed_grid, seed_draws, unique_draws, distinct_picks, ols_slopes, compression_modes, eta_squared, eta_squared_given, fixed_effects, pearson_pairs, pearson_zero_filled, loo_corr, mean_sd, ridge_loo, ridge_delta, slope_bootstrap, bootstrap_means, poisson_means, poisson_slopes, poisson_eta, poisson_signs, interaction_lasso, mixed_slopes, linear_probe_scores, random_direction_values, sign_stability, eta_bootstrap, pairwise_lasso, bootstrap_sizes, cosine_pairs, similarity_summary, label_centroids, direction_cosines, projected_out, pooled_vectors, random_directions, linear_probe)}

SUPPLIERS = "suppliers AS (SELECT l_suppkey, " + ", ".join(f"avg({m}) AS {m}" for m in MEASURES) + " FROM lineitem GROUP BY l_suppkey)"
COS = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
PARTS = "parts AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
NORM = "sqrt(list_dot_product({0}, {0}))"
WITHIN = f"""{OBS}, inner_ AS (SELECT *, ca - avg(ca) OVER (PARTITION BY primitive, family) AS yw, log_params - avg(log_params) OVER (PARTITION BY primitive, family) AS xw FROM observations)"""

#: The weight of a row in a draw: how many of the bounds of a Poisson variable the hash reaches.
REACHED = " + ".join(f"CAST(u >= {int(p * 2.0**32)} AS INTEGER)" for p in resampling.POISSON[:12])
ORACLES = {
    "poisson_means": f"""WITH d AS (SELECT c_mktsegment, CAST(c_acctbal AS DOUBLE) AS b, CAST(draw AS INTEGER) AS draw, CAST(('0x' || substr(md5('0|' || c_custkey || '|' || draw), 1, 8)) AS BIGINT) AS u FROM customer, generate_series(1, 20) g(draw)),
        w AS (SELECT *, {REACHED} AS w FROM d) SELECT c_mktsegment, draw, CAST(sum(w) AS BIGINT) AS n, round(sum(w * b) / sum(w), 4) AS mean FROM w GROUP BY c_mktsegment, draw""",
    "stratified_split": """WITH c AS (SELECT lang, source, count(*) AS n, row_number() OVER (ORDER BY lang, source) - 1 AS cell, count(*) OVER () AS cells FROM documents GROUP BY lang, source),
        r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('0|' || doc_id), doc_id) AS k FROM documents)
        SELECT doc_id, CASE WHEN k <= least(150 // cells + CASE WHEN cell < 150 % cells THEN 1 ELSE 0 END, n) THEN 'holdout' ELSE 'train' END AS split FROM r JOIN c USING (lang, source)""",
    "random_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) <= 100 THEN 'holdout' ELSE 'train' END AS split FROM documents",
    "stratified_sample": """WITH c AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS cell, count(*) OVER () AS cells FROM documents GROUP BY lang),
        r AS (SELECT doc_id, lang, source, md5('0|' || doc_id) AS o, cell, row_number() OVER (PARTITION BY lang ORDER BY md5('0|' || doc_id), doc_id) AS k, greatest(1, 50 // cells) AS per FROM documents JOIN c USING (lang))
        SELECT doc_id, lang, source FROM r ORDER BY k > per, CASE WHEN k > per THEN 0 ELSE cell END, o, doc_id LIMIT 50""",
    "shuffled_take": "SELECT doc_id, lang, source FROM documents ORDER BY md5('3|' || doc_id), doc_id LIMIT 40",
    "seed_grid": "SELECT r_name, c_mktsegment, n_name FROM region, (SELECT DISTINCT c_mktsegment FROM customer), nation",
    "seed_draws": """WITH cells AS (SELECT r_name, c_mktsegment FROM region, (SELECT DISTINCT c_mktsegment FROM customer)), n AS (SELECT count(*) AS cells FROM cells),
        pool AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS pick, count(*) OVER () AS size FROM nation),
        d AS (SELECT r_name, c_mktsegment, unnest(generate_series(1, CAST(ceil(90 / cells) AS BIGINT))) AS draw FROM cells, n),
        o AS (SELECT *, md5('0|' || r_name || '|' || c_mktsegment || '|' || draw) AS o FROM d)
        SELECT r_name, c_mktsegment, CAST(draw AS INTEGER) AS draw, n_name FROM o JOIN pool ON pick = CAST(('0x' || substr(o, 1, 8)) AS BIGINT) % size ORDER BY o LIMIT 90""",
    "unique_draws": "SELECT o_custkey, o_orderkey FROM (SELECT *, md5('0|' || o_orderkey) AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('0|' || o_orderkey)) AS r FROM orders) WHERE r = 1 ORDER BY o LIMIT 60",
    "distinct_picks": "SELECT n_regionkey, array_to_string(list_slice(list(n_name ORDER BY md5('0|' || n_name || '|' || n_regionkey)), 1, 2), ',') AS pair FROM nation GROUP BY n_regionkey",
    "ols_slopes": f"WITH {OBS} SELECT family, count(*) AS n, round(regr_slope(ca, log_params), 6) + 0 AS slope, round(regr_intercept(ca, log_params), 6) + 0 AS intercept, round(regr_r2(ca, log_params), 6) + 0 AS r2 FROM observations GROUP BY family",
    "compression_modes": f"""WITH {OBS}, s AS (SELECT family, primitive, count(*) AS n_models, count(DISTINCT size_b) AS n_distinct_sizes, regr_slope(target, log_params) AS t, regr_slope(retain, log_params) AS r, regr_slope(ca, log_params) AS c
          FROM observations GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT size_b) >= 2)
        SELECT family, primitive, n_models, n_distinct_sizes, round(t, 6) + 0 AS target_slope, round(r, 6) + 0 AS retain_slope, round(c, 6) + 0 AS ca_slope,
          CASE WHEN t > 0 AND r >= t AND c <= 0 THEN 'true_compression' WHEN t > 0 AND c > 0 THEN 'growth' WHEN t <= 0 AND r <= 0 THEN 'pseudo_compression' ELSE 'mixed' END AS mode FROM s""",
    "eta_squared": f"""WITH {OBS}, g AS (SELECT primitive, avg(ca) AS grand, sum(ca * ca) - count(*) * avg(ca) * avg(ca) AS total, count(*) AS n FROM observations GROUP BY primitive),
        f AS (SELECT primitive, family, count(*) AS n, avg(ca) AS m FROM observations GROUP BY ALL)
        SELECT primitive, any_value(g.n) AS n_obs, count(*) AS n_groups, round(sum(f.n * (m - grand) ** 2) / any_value(total), 6) AS eta2 FROM f JOIN g USING (primitive) GROUP BY primitive""",
    "eta_squared_given": f"""WITH {WITHIN} SELECT primitive, round(((regr_syy(ca, log_params) - regr_sxy(ca, log_params) ** 2 / regr_sxx(ca, log_params)) - (regr_syy(yw, xw) - regr_sxy(yw, xw) ** 2 / regr_sxx(yw, xw))) / regr_syy(ca, ca), 6) AS eta2_given
        FROM inner_ GROUP BY primitive""",
    "fixed_effects": f"""WITH {OBS}, kept AS (SELECT * FROM observations JOIN (SELECT primitive, family FROM observations GROUP BY ALL HAVING count(DISTINCT size_b) >= 2) USING (primitive, family)),
        i AS (SELECT *, ca - avg(ca) OVER (PARTITION BY primitive, family) AS yw, log_params - avg(log_params) OVER (PARTITION BY primitive, family) AS xw FROM kept)
        SELECT primitive, count(*) AS n, round(regr_slope(yw, xw), 6) + 0 AS fe_slope, round(1 - (regr_syy(yw, xw) - regr_sxy(yw, xw) ** 2 / regr_sxx(yw, xw)) / regr_syy(ca, ca), 6) + 0 AS fe_r2 FROM i GROUP BY primitive""",
    "pearson_pairs": f"WITH {SUPPLIERS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(corr({a}, {b}), 6) AS r FROM suppliers" for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]),
    "pearson_zero_filled": f"""WITH {SUPPLIERS}, w AS (SELECT CASE WHEN l_suppkey % 3 > 0 THEN l_quantity END AS a, CASE WHEN l_suppkey % 4 > 0 THEN l_extendedprice END AS b FROM suppliers)
        SELECT round(corr(coalesce(a, 0), coalesce(b, 0)), 6) AS zero_filled, round(corr(a, b), 6) AS pairwise FROM w""",
    "loo_corr": f"""WITH {SUPPLIERS}, w AS (SELECT l_suppkey AS s, l_quantity - 25 AS x, l_discount * 100 AS y FROM suppliers)
        SELECT 'full' AS dropped, count(*) AS n, round(corr(x, y), 5) AS r FROM w
        UNION ALL SELECT CAST(a.s AS VARCHAR), count(*), round(corr(b.x, b.y), 5) FROM w a JOIN w b ON a.s <> b.s GROUP BY a.s""",
    "mean_sd": f"WITH {OBS} SELECT primitive, count(ca) AS n, round(avg(ca), 6) AS mean, round(stddev_samp(ca), 6) AS sd, count(*) FILTER (abs(ca) >= 0.10) AS n_over FROM observations GROUP BY primitive",
    "bootstrap_sizes": "SELECT CAST(d AS INTEGER) AS draw, (SELECT count(*) FROM nation) AS n FROM generate_series(1, 20) t(d)",
    "cosine_pairs": f"SELECT a.vec_id, round({COS.format('a.embedding', 'b.embedding')}, 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "similarity_summary": f"""WITH p AS (SELECT a.label, {COS.format('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
        SELECT label, count(*) AS n, round(avg(c), 5) AS mean, round(stddev_pop(c), 5) AS std, round(median(c), 5) AS median, round(min(c), 5) AS min, round(max(c), 5) AS max, round(quantile_cont(c, 0.25), 5) AS q25, round(quantile_cont(c, 0.75), 5) AS q75 FROM p GROUP BY label""",
    "label_centroids": f"""WITH {PARTS}, m AS (SELECT label, p, avg(x) AS x, count(*) AS n FROM parts GROUP BY ALL)
        SELECT label, max(n) AS n, round(sqrt(sum(x * x)), 5) AS norm, round(max(x) FILTER (p = 1), 5) AS first FROM m GROUP BY label""",
    "direction_cosines": f"""WITH {PARTS}, b AS (SELECT p, avg(x) AS base FROM parts GROUP BY p), d AS (SELECT label, p, avg(x) - any_value(base) AS x FROM parts JOIN b USING (p) GROUP BY ALL),
        v AS (SELECT label, list(x ORDER BY p) AS d FROM d GROUP BY label)
        SELECT a.label, b.label AS other, round(list_cosine_similarity(a.d, b.d), 5) AS cosine FROM v a JOIN v b ON a.label < b.label""",
    "projected_out": f"""WITH {PARTS}, b AS (SELECT p, avg(x) AS d FROM parts GROUP BY p), l AS (SELECT sqrt(sum(d * d)) AS l FROM b),
        a AS (SELECT vec_id, sum(x * d / l) AS along FROM parts JOIN b USING (p), l GROUP BY vec_id)
        SELECT vec_id, round(sqrt(sum((x - along * d / l) ** 2)), 5) AS norm, round(abs(sum((x - along * d / l) * d)), 5) AS along FROM parts JOIN b USING (p) JOIN a USING (vec_id), l GROUP BY vec_id""",
    "pooled_vectors": f"""WITH {PARTS}, m AS (SELECT vec_id // 10 AS g, p, avg(x) AS mean, arg_max(x, vec_id) AS last FROM parts GROUP BY ALL),
        t AS (SELECT g, p, avg(x) AS last3 FROM (SELECT vec_id // 10 AS g, p, x, row_number() OVER (PARTITION BY vec_id // 10, p ORDER BY vec_id DESC) AS r FROM parts) WHERE r <= 3 GROUP BY ALL)
        SELECT g, round(sqrt(sum(mean * mean)), 5) AS mean, round(sqrt(sum(last * last)), 5) AS last, round(sqrt(sum(last3 * last3)), 5) AS last3 FROM m JOIN t USING (g, p) GROUP BY g""",
    "random_directions": "SELECT DISTINCT label, CAST(2.5 AS DOUBLE) AS norm FROM embeddings",
    "linear_probe": "SELECT vec_id % 5 > 0 AS train, count(*) AS n FROM embeddings GROUP BY 1",
}
