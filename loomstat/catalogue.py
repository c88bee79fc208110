"""The registered queries and the SQL that gives the same rows.

Most queries look at ``embeddings`` as samples x features: 64 features f00..f63, batch = label % 3, and a value
missing wherever (7 vec_id + feature) % 23 = 0. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions import ranking, scalars
from loomstat.operators import agreement, association, catalogs, diagnostics, groups, ingest, layout, models, network, prep, reduce, search, selectors
from loomstat.plans import figures, report


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, NaN as NULL, no negative zero; small integers as long."""
    out = []
    for f in df.schema:
        c = F.col(layout.quoted(f.name))
        kind = f.dataType.simpleString()
        out.append((F.round(scalars.known(c), 6) + 0.0).alias(f.name) if kind in ("double", "float") else c.cast("long").alias(f.name) if kind in ("int", "smallint", "tinyint") else c)
    return df.select(*out)


def features(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, batch, feature, dim, value with gaps."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("b"), (F.col("label") % 3).cast("string")).alias("batch"), "label", "embedding")
    long = layout.array_to_long(e, ["sample_id", "batch", "label"], "embedding")
    return long.withColumn("value", F.when((F.col("sample_id") * 7 + F.col("dim")) % 23 != 0, F.col("value")))


def whole(spark: SparkSession, d: str) -> DataFrame:
    """The same without gaps."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("b"), (F.col("label") % 3).cast("string")).alias("batch"), "label", "embedding")
    return layout.array_to_long(e, ["sample_id", "batch", "label"], "embedding")


def arrays(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("b"), (F.col("label") % 3).cast("string")).alias("batch"), F.col("embedding").cast("array<double>").alias("features"))


LONG = """
E AS (SELECT vec_id AS sample_id, 'b' || (label % 3) AS batch, label, unnest(embedding)::DOUBLE AS raw, unnest(range(len(embedding))) AS dim FROM embeddings),
W AS (SELECT sample_id, batch, label, dim, 'f' || lpad(dim::VARCHAR, 2, '0') AS feature, raw AS value FROM E),
L AS (SELECT sample_id, batch, label, dim, feature, CASE WHEN (sample_id * 7 + dim) % 23 <> 0 THEN value END AS value FROM W)"""

FDR = "CASE WHEN {p} IS NOT NULL THEN least(1, min({p} * m / r) OVER (PARTITION BY {p} IS NULL ORDER BY {p} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END"
RANKED = "count({p}) OVER () AS m, row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}) AS r"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: tidy(f(spark, d))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- layout, selection, catalog -------------------------------------------------------------


@query(f"WITH {LONG} SELECT sample_id, batch, feature, round(value, 6) + 0.0 AS value FROM L")
def wide_to_long(spark, d):
    wide = layout.long_to_wide(features(spark, d), ["sample_id", "batch"], [f"f{i:02d}" for i in range(64)])
    return layout.wide_to_long(wide, ["sample_id", "batch"], [f"f{i:02d}" for i in range(64)])


@query(f"WITH {LONG} SELECT sample_id, {', '.join(f'round(max(CASE WHEN dim = {i} THEN value END), 6) + 0.0 AS f{i:02d}' for i in range(64))} FROM L GROUP BY sample_id")
def long_to_wide(spark, d):
    return layout.long_to_wide(features(spark, d), ["sample_id"], [f"f{i:02d}" for i in range(64)])


def named(spark, d):
    """A wide table with configurations: even features standard__, odd ones custom__."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"{'custom' if i % 2 else 'standard'}__key{i:02d}") for i in range(24)])


def catalog_of(spark):
    rows = [("custom" if i % 2 else "standard", f"key{i:02d}", f"fam{i // 8}", "low" if i < 12 else "high") for i in range(24)]
    return spark.createDataFrame(rows, "config string, feature_key string, family string, family_group string")


@query("SELECT vec_id, label, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0.0 AS {'custom' if i % 2 else 'standard'}__key{i:02d}" for i in range(24) if not (i % 2 == 0 and i < 10 or 8 <= i < 16 and i % 2 == 0)) + " FROM embeddings")
def feature_remove(spark, d):
    df = named(spark, d)
    s = selectors.Selectors(features=("key0*",), configs=("standard",), families=("FAM1",))
    return selectors.FeatureRemover(s, catalogs.FeatureCatalog(catalog_of(spark)).rows()).fit(df).transform(df)


@query("SELECT vec_id, label, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) + 0.0 AS {'custom' if i % 2 else 'standard'}__key{i:02d}" for i in range(12, 24)) + " FROM embeddings")
def feature_split_removed(spark, d):
    df = named(spark, d)
    return selectors.split_table(df, selectors.Selectors(family_groups=("High",)), catalogs.FeatureCatalog(catalog_of(spark)).rows()).removed


CATALOG_SQL = "C AS (SELECT CASE WHEN i % 2 = 1 THEN 'custom' ELSE 'standard' END AS config, 'key' || lpad(i::VARCHAR, 2, '0') AS feature_key, 'fam' || (i // 8) AS family, CASE WHEN i < 12 THEN 'low' ELSE 'high' END AS family_group FROM range(24) t(i))"


@query(f"WITH {CATALOG_SQL} SELECT config || '__' || feature_key AS feature, config, feature_key, family, family_group FROM C WHERE config = 'standard' AND family = 'fam0'")
def catalog_split(spark, d):
    cat = catalogs.FeatureCatalog(catalog_of(spark)).frame
    return selectors.split_catalog(cat, [f"standard__key{i:02d}" for i in (0, 2, 4, 6)])[1]


@query(f"WITH {LONG}, {CATALOG_SQL}, A AS (SELECT feature, avg(value) AS mean FROM L GROUP BY feature) SELECT feature, family, family_group, round(mean, 6) + 0.0 AS mean FROM A LEFT JOIN (SELECT 'f' || right(feature_key, 2) AS k, family, family_group FROM C) ON k = feature")
def catalog_annotate(spark, d):
    cat = catalog_of(spark).select(F.concat(F.lit("f"), F.substring("feature_key", 4, 2)).alias("feature"), "family", "family_group")
    means = features(spark, d).groupBy("feature").agg(F.avg("value").alias("mean"))
    return catalogs.FeatureCatalog(cat).annotate(means, columns=["family", "family_group"])


@query(f"WITH {CATALOG_SQL} SELECT DISTINCT family FROM C")
def catalog_families(spark, d):
    return spark.createDataFrame([(x,) for x in catalogs.FeatureCatalog(catalog_of(spark)).families()], "family string")


@query(f"WITH {LONG}, S AS (SELECT feature, stddev_pop(value) AS score FROM L WHERE dim % 5 <> 0 GROUP BY feature), K AS (SELECT DISTINCT L.feature FROM L LEFT JOIN S USING (feature) WHERE score IS NULL OR score >= 0.124) SELECT feature FROM K")
def score_selector(spark, d):
    long = features(spark, d)
    scores = long.where("dim % 5 <> 0").groupBy("feature").agg(F.stddev_pop("value").alias("score"))
    return selectors.ScoreSelector(scores, 0.124).transform(long.select("feature").distinct())


# ---- ingest ---------------------------------------------------------------------------------

MESSY = "CASE c_custkey % 6 WHEN 0 THEN '  ' || c_name WHEN 1 THEN c_name || '  x ' WHEN 2 THEN ' NaN ' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE lower(c_name) END"


@query(f"WITH m AS (SELECT c_custkey, {MESSY} AS id FROM customer), n AS (SELECT c_custkey, lower(regexp_replace(trim(id), '\\s+', ' ', 'g')) AS id FROM m) SELECT c_custkey, CASE WHEN id NOT IN ('', 'nan', 'none', '<na>', 'null', 'na') THEN id END AS id FROM n")
def normalize_ids(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.expr(MESSY).alias("id"))
    return ingest.normalize_id_column(df, "id", lower=True)[0]


@query(f"WITH m AS (SELECT {MESSY} AS before FROM customer), n AS (SELECT before, regexp_replace(trim(before), '\\s+', ' ', 'g') AS t FROM m), o AS (SELECT before, CASE WHEN lower(t) NOT IN ('', 'nan', 'none', '<na>', 'null', 'na') THEN t END AS id FROM n) SELECT id, before, id AS after FROM o WHERE before IS DISTINCT FROM id")
def id_changes(spark, d):
    df = table(spark, d, "customer").select(F.expr(MESSY).alias("id"))
    return ingest.normalize_id_column(df, "id")[1]


ITEMS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_partkey % 5 <> 0 THEN l_quantity END AS quantity, CASE WHEN l_suppkey % 3 <> 0 THEN l_returnflag END AS flag FROM lineitem"


def items(spark, d):
    i = table(spark, d, "lineitem")
    df = i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity")).alias("quantity"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_returnflag")).alias("flag"))
    return df.withColumn("row_id", F.struct("l_extendedprice", "l_partkey", "l_suppkey"))


def dedup(policy, order_sql, order_column=None, dropped=False):
    total = "l_extendedprice, l_partkey, l_suppkey"
    sql = f"WITH i AS ({ITEMS}), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {order_sql.format(total=total)}) AS k FROM i) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 6) AS l_extendedprice, round(quantity, 6) AS quantity, flag FROM r WHERE k {'> 1' if dropped else '= 1'}"

    def run(spark, d):
        return ingest.resolve_duplicates(items(spark, d), ["l_orderkey", "l_linenumber"], policy, order_column)[int(dropped)].drop("row_id")

    run.__name__ = f"dedup_{policy}" + "_dropped" * dropped
    query(sql)(run)


dedup("first", "{total}")
dedup("last", "l_extendedprice DESC, l_partkey DESC, l_suppkey DESC")
dedup("min", "quantity ASC NULLS LAST, {total}", "quantity")
dedup("max", "quantity DESC NULLS LAST, {total}", "quantity")
dedup("most_complete", "(quantity IS NULL)::INT + (flag IS NULL)::INT, {total}")
dedup("first", "{total}", dropped=True)


def merged(spark, d, how):
    left = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    right = table(spark, d, "labels").where("doc_id % 4 <> 0").select(F.when(F.col("doc_id") % 10 == 3, F.col("doc_id") + 10_000_000).otherwise(F.col("doc_id")).alias("doc_id"), "quality", F.col("toxic").alias("n_chars"))
    return ingest.merge_tables(left, right, ["doc_id"], ["doc_id"], how, validate="1:1")


MERGE = "WITH a AS (SELECT doc_id, lang, n_chars FROM documents), b AS (SELECT CASE WHEN doc_id % 10 = 3 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, quality::BIGINT AS quality, toxic::BIGINT AS n_chars FROM labels WHERE doc_id % 4 <> 0) "
for _how, _sql in (("left", "LEFT"), ("inner", "INNER"), ("right", "RIGHT"), ("outer", "FULL")):
    def _merge(spark, d, how=_how):
        return merged(spark, d, how).merged

    _merge.__name__ = f"merge_{_how}"
    query(MERGE + f"SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, lang, a.n_chars AS n_chars, quality, b.n_chars AS n_chars_clinical FROM a {_sql} JOIN b ON a.doc_id IS NOT DISTINCT FROM b.doc_id")(_merge)


@query(MERGE + "SELECT * FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)")
def merge_left_only(spark, d):
    return merged(spark, d, "left").left_only


@query(MERGE + "SELECT * FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)")
def merge_right_only(spark, d):
    return merged(spark, d, "left").right_only


@query(MERGE + "SELECT count(DISTINCT a.doc_id)::BIGINT AS n_matched FROM a JOIN b USING (doc_id)")
def merge_n_matched(spark, d):
    return spark.createDataFrame([(merged(spark, d, "left").n_matched,)], "n_matched long")


CLINICAL = "SELECT o_orderkey AS sample_id, 'priority' AS variable, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'coded', CASE o_orderkey % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'III' WHEN 3 THEN 'other' END FROM orders UNION ALL SELECT o_orderkey, 'numeric', CASE o_orderkey % 4 WHEN 0 THEN 'n/a' ELSE ' ' || (o_orderkey % 50)::VARCHAR || '.5' END FROM orders"


@query(f"""WITH c AS ({CLINICAL}), w AS (SELECT sample_id, variable, lower(trim(value)) AS w, TRY_CAST(trim(value) AS DOUBLE) AS n FROM c WHERE value IS NOT NULL)
SELECT sample_id, variable, CASE variable WHEN 'numeric' THEN n WHEN 'coded' THEN CASE w WHEN 'yes' THEN 1.0 WHEN 'no' THEN 0.0 WHEN 'iii' THEN 3.0 END
  ELSE dense_rank() OVER (PARTITION BY variable ORDER BY w)::DOUBLE END AS value FROM w""")
def encode_clinical(spark, d):
    o = table(spark, d, "orders")
    o.createOrReplaceTempView("loomstat_orders")
    sql = CLINICAL.replace("FROM orders", "FROM loomstat_orders").replace("(o_orderkey % 50)::VARCHAR", "cast(o_orderkey % 50 as string)")
    return association.encode_clinical(spark.sql(sql))


# ---- quality of features, tests between batches -----------------------------------------------

PER = "P AS (SELECT feature, batch, count(*) AS n, count(value) AS valid FROM L GROUP BY ALL)"


@query(f"""WITH {LONG}, {PER}, Q AS (SELECT feature, sum(n)::BIGINT AS n_samples, sum(valid)::BIGINT AS n_valid, count_if(valid >= 2)::BIGINT AS valid_batches, min(valid)::BIGINT AS min_valid_per_batch FROM P GROUP BY feature),
U AS (SELECT feature, count(DISTINCT value)::BIGINT AS n_unique FROM L GROUP BY feature)
SELECT feature, n_samples, n_valid, round(1 - n_valid / n_samples, 6) AS missing_fraction, n_unique, valid_batches, min_valid_per_batch,
  n_valid >= 3 AND 1 - n_valid / n_samples <= 0.0445 AND n_unique >= 2 AND valid_batches >= 2 AS keep FROM Q JOIN U USING (feature)""")
def feature_qc(spark, d):
    return groups.feature_qc(features(spark, d), max_missing=0.0445)


@query("SELECT 'b' || (label % 3) AS batch, count(*)::BIGINT AS n_samples FROM embeddings GROUP BY 1")
def batch_counts(spark, d):
    return groups.batch_counts(arrays(spark, d))


@query(f"WITH {LONG} SELECT feature, batch, count(value)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median FROM L GROUP BY ALL")
def center_statistics(spark, d):
    return groups.center_statistics(features(spark, d))


MOMENTS = """
G_{n} AS (SELECT feature, batch, count(*) AS n, avg({v}) AS mean, var_pop({v}) * count(*) AS ss FROM {src} GROUP BY ALL),
M_{n} AS (SELECT feature, sum(n)::BIGINT AS n, count(*) AS k, sum(n * pow(mean - gm, 2)) AS ssb, sum(ss) AS ssw
  FROM (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS gm FROM G_{n}) GROUP BY feature),
F_{n} AS (SELECT *, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM M_{n}),
T_{n} AS (SELECT *, pow(1 + 2 * f / (n - k), -(n - k) / 2.0) AS p FROM F_{n})"""
ANOVA = f"WITH {LONG}, V AS (SELECT * FROM L WHERE value IS NOT NULL), {MOMENTS.format(n='a', v='value', src='V')}, R AS (SELECT *, {RANKED.format(p='p')} FROM T_a)"


@query(f"{ANOVA} SELECT feature, n, k, round(f, 6) + 0.0 AS anova_f, round(p, 6) + 0.0 AS anova_p, round(ssb / (ssb + ssw), 6) + 0.0 AS eta_squared, round({FDR.format(p='p')}, 6) + 0.0 AS anova_q FROM R")
def batch_anova(spark, d):
    return ranking.with_fdr(groups.anova(features(spark, d)), "anova_p", "anova_q")


KRUSKAL = f"""WITH {LONG}, V AS (SELECT * FROM L WHERE value IS NOT NULL),
R AS (SELECT feature, batch, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY feature, value) AS t FROM V),
G AS (SELECT feature, batch, count(*)::DOUBLE AS n, sum(r) AS r, sum(t * t - 1.0) AS ties FROM R GROUP BY ALL),
K AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(r * r / n) AS s, sum(ties) AS ties FROM G GROUP BY feature),
H AS (SELECT *, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM K)"""


@query(f"{KRUSKAL} SELECT feature, round(h, 6) + 0.0 AS kruskal_h, round(exp(-h / 2), 6) + 0.0 AS kruskal_p, round(greatest((h - k + 1) / (n - k), 0), 6) + 0.0 AS epsilon_squared FROM H")
def batch_kruskal(spark, d):
    return groups.kruskal(features(spark, d))


@query(f"""WITH {LONG}, V AS (SELECT * FROM L WHERE value IS NOT NULL), C AS (SELECT feature, batch, median(value) AS c FROM V GROUP BY ALL), D AS (SELECT V.feature, V.batch, abs(value - c) AS value FROM V JOIN C USING (feature, batch)),
{MOMENTS.format(n='l', v='value', src='D')} SELECT feature, round(f, 6) + 0.0 AS levene_stat, round(p, 6) + 0.0 AS levene_p FROM T_l""")
def batch_levene(spark, d):
    return groups.levene(features(spark, d))


@query()
def batch_feature_statistics(spark, d):
    long = features(spark, d)
    return groups.feature_statistics(long, prep.FeaturePrep(skip_power=True).fit_transform(long))


@query(f"""{ANOVA}, S AS (SELECT ssb / (ssb + ssw) AS eta, {FDR.format(p='p')} AS q FROM R)
SELECT count(*)::BIGINT AS n_features, round(median(eta), 6) + 0.0 AS median_eta_squared, round(quantile_cont(eta, 0.9), 6) + 0.0 AS p90_eta_squared, count_if(q <= 0.05)::BIGINT AS n_significant FROM S""")
def batch_feature_summary(spark, d):
    return report.feature_summary(ranking.with_fdr(groups.anova(features(spark, d)), "anova_p", "anova_q"))


@query(f"WITH {LONG}, Z AS (SELECT feature, stddev_pop(CASE WHEN dim % 9 = 0 THEN 5.0 ELSE value END) AS sd FROM L GROUP BY feature) SELECT feature, round(sd, 6) + 0.0 AS sd FROM Z WHERE sd <= 1e-12")
def constant_features(spark, d):
    return layout.constant_features(features(spark, d).withColumn("value", F.when(F.col("dim") % 9 == 0, 5.0).otherwise(F.col("value"))))


# ---- agreement --------------------------------------------------------------------------------

RATED = """X AS (SELECT event_type AS feature, user_id AS subject, 'o' || (day(ts) % 2) AS observer, avg(value) AS value FROM events GROUP BY ALL),
A AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, subject) AS c FROM X) WHERE c = 2)"""


def rated(spark, d, observers=2):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("subject"), F.concat(F.lit("o"), (F.dayofmonth("ts") % observers).cast("string")).alias("observer")).agg(F.avg("value").alias("value"))


@query(f"""WITH {RATED}, C AS (SELECT *, value - avg(value) OVER (PARTITION BY feature) AS x FROM A),
T AS (SELECT feature, sum(x * x) AS sst FROM C GROUP BY feature),
B AS (SELECT feature, sum(2 * m * m) AS ssb, count(*) AS n FROM (SELECT feature, subject, avg(x) AS m FROM C GROUP BY ALL) GROUP BY feature),
O AS (SELECT feature, sum(n * m * m) AS sso FROM (SELECT feature, observer, avg(x) AS m, count(*) AS n FROM C GROUP BY ALL) GROUP BY feature),
S AS (SELECT feature, n, ssb / (n - 1) AS msb, sso AS mso, greatest(sst - ssb - sso, 0) / (n - 1) AS mse FROM T JOIN B USING (feature) JOIN O USING (feature))
SELECT feature, n::BIGINT AS n, round((msb - mse) / (msb + mse + 2 * (mso - mse) / n), 6) + 0.0 AS icc_2_1, round(msb, 4) + 0.0 AS ms_between_subjects, round(mso, 4) + 0.0 AS ms_between_observers, round(mse, 4) + 0.0 AS ms_error FROM S""")
def repro_icc(spark, d):
    out = agreement.icc(rated(spark, d))
    return out.select("feature", "n", "icc_2_1", *[F.round(c, 4).alias(c) for c in ("ms_between_subjects", "ms_between_observers", "ms_error")])


PAIRS = f"{RATED}, Q AS (SELECT a.feature, a.value AS x, b.value AS y FROM A a JOIN A b USING (feature, subject) WHERE a.observer < b.observer)"


@query(f"WITH {PAIRS}, R AS (SELECT feature, count(*) AS n, corr(x, y) AS r FROM Q GROUP BY feature) SELECT feature, round(r, 6) + 0.0 AS estimate, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) + 0.0 AS ci95_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) + 0.0 AS ci95_high FROM R")
def repro_pearson(spark, d):
    return agreement.pair_correlations(rated(spark, d)).drop("p_value", "p_fdr")


AVERAGE = "rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0"


@query(f"WITH {PAIRS}, K AS (SELECT feature, {AVERAGE.format(by='feature', v='x')} AS x, {AVERAGE.format(by='feature', v='y')} AS y FROM Q), R AS (SELECT feature, count(*) AS n, corr(x, y) AS r FROM K GROUP BY feature) SELECT feature, round(r, 6) + 0.0 AS estimate, round(tanh(atanh(r) - 1.96 * sqrt(1 + r * r / 2) / sqrt(n - 3)), 6) + 0.0 AS ci95_low, round(tanh(atanh(r) + 1.96 * sqrt(1 + r * r / 2) / sqrt(n - 3)), 6) + 0.0 AS ci95_high FROM R")
def repro_spearman(spark, d):
    return agreement.pair_correlations(rated(spark, d), "spearman").drop("p_value", "p_fdr")


@query("""WITH X AS (SELECT event_type AS feature, user_id AS subject, 'o' || (day(ts) % 3) AS observer, avg(value) AS value FROM events GROUP BY ALL),
A AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY feature, subject) AS c FROM X) WHERE c = 3),
R AS (SELECT a.feature, a.observer, b.observer AS o2, corr(a.value, b.value) AS r FROM A a JOIN A b USING (feature, subject) WHERE a.observer < b.observer GROUP BY ALL)
SELECT feature, round(tanh(avg(atanh(r))), 6) + 0.0 AS mean, round(median(r), 6) + 0.0 AS median, round(stddev_samp(r), 6) + 0.0 AS sd, round(quantile_cont(r, 0.25), 6) + 0.0 AS q25, round(quantile_cont(r, 0.75), 6) + 0.0 AS q75, round(min(r), 6) + 0.0 AS min, round(max(r), 6) + 0.0 AS max FROM R GROUP BY feature""")
def repro_multi(spark, d):
    return agreement.many_correlations(rated(spark, d, 3))


@query()
def repro_bootstrap(spark, d):
    return agreement.bootstrap_interval(rated(spark, d), 200)


# ---- clinical variables, modules ----------------------------------------------------------------

TRAITS = "T AS (SELECT vec_id AS sample_id, 'label' AS variable, label::DOUBLE AS trait FROM embeddings UNION ALL SELECT vec_id, 'mod', CASE WHEN vec_id % 11 <> 0 THEN (vec_id % 7)::DOUBLE END FROM embeddings)"


def traits(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.lit("label").alias("variable"), F.col("label").cast("double").alias("value")).unionAll(
        e.select("vec_id", F.lit("mod"), F.when(F.col("vec_id") % 11 != 0, (F.col("vec_id") % 7).cast("double")))
    )


PAIRED = f"{LONG}, {TRAITS}, J AS (SELECT feature, variable, value AS x, trait AS y FROM L JOIN T USING (sample_id) WHERE value IS NOT NULL AND trait IS NOT NULL)"


@query(f"WITH {PAIRED}, K AS (SELECT feature, variable, {AVERAGE.format(by='feature, variable', v='x')} AS x, {AVERAGE.format(by='feature, variable', v='y')} AS y FROM J) SELECT feature, variable, count(*)::BIGINT AS n, round(corr(x, y), 6) + 0.0 AS r FROM K GROUP BY ALL")
def clinical_correlation(spark, d):
    return association.clinical_correlations(features(spark, d), traits(spark, d))


MODULES = "Z AS (SELECT sample_id, 'm' || (dim // 16) AS component, avg(value) AS score FROM W GROUP BY ALL)"


def components(spark, d):
    return whole(spark, d).groupBy("sample_id", F.concat(F.lit("m"), F.floor(F.col("dim") / 16).cast("string")).alias("component")).agg(F.avg("value").alias("score"))


MEMBERSHIP = f"WITH {LONG}, {MODULES}, R AS (SELECT feature, dim, component, corr(value, score) AS k FROM W JOIN Z USING (sample_id) GROUP BY ALL)"


@query(f"{MEMBERSHIP} SELECT feature, component, round(k, 6) + 0.0 AS k_me FROM R")
def module_membership(spark, d):
    return association.module_membership(whole(spark, d), components(spark, d), "pearson")


@query(f"{MEMBERSHIP}, O AS (SELECT component AS cluster, feature, k, row_number() OVER (PARTITION BY component ORDER BY abs(k) DESC, feature) AS rank FROM R WHERE component = 'm' || (dim // 16)) SELECT cluster, feature, round(k, 6) + 0.0 AS k_me, rank::BIGINT AS rank FROM O WHERE rank <= 3")
def hub_features(spark, d):
    long = whole(spark, d)
    clusters = long.select("feature", F.concat(F.lit("m"), F.floor(F.col("dim") / 16).cast("string")).alias("cluster")).distinct()
    return association.hub_features(association.module_membership(long, components(spark, d), "pearson"), clusters, 3)


@query()
def module_traits(spark, d):
    scores = components(spark, d).select("sample_id", F.col("component").alias("module"), F.col("score").alias("value"))
    return association.module_traits(scores, traits(spark, d))


@query("""WITH B AS (SELECT p_brand AS cluster, p_type AS "group" FROM part), C AS (SELECT cluster, count(*) AS k FROM B GROUP BY 1), G AS (SELECT "group", count(*) AS m FROM B GROUP BY 1), N AS (SELECT count(*) AS n FROM B),
O AS (SELECT cluster, "group", count(*) AS a FROM B GROUP BY ALL), X AS (SELECT cluster, "group", coalesce(a, 0) AS a, k, m, n FROM C CROSS JOIN G CROSS JOIN N LEFT JOIN O USING (cluster, "group")),
H AS (SELECT cluster, "group", a, k, m, n, unnest(range(greatest(a, k + m - n), least(k, m) + 1)) AS i FROM X),
P AS (SELECT cluster, "group", least(1, sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n - m + 1) - lgamma(k - i + 1) - lgamma(n - m - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)))) AS p FROM H GROUP BY ALL)
SELECT cluster, "group", a::BIGINT AS n_overlap, k::BIGINT AS cluster_size, m::BIGINT AS group_size, n::BIGINT AS total_features, round(p, 6) + 0.0 AS p_value,
  round(CASE WHEN (k - a) * (m - a) > 0 THEN a * (n - k - m + a) / ((k - a) * (m - a))::DOUBLE END, 6) + 0.0 AS odds_ratio FROM X JOIN P USING (cluster, "group")""")
def group_enrichment(spark, d):
    p = table(spark, d, "part")
    return association.group_enrichment(p.select(F.col("p_partkey").alias("feature"), F.col("p_brand").alias("cluster")), p.select(F.col("p_partkey").alias("feature"), F.col("p_type").alias("group"))).drop("fdr_q_value")


PVALUES = "P AS (SELECT p_partkey AS id, p_brand AS model, CASE WHEN p_partkey % 7 <> 0 THEN round((p_partkey * 37 % 101) * (p_partkey * 37 % 101) / 10201.0, 3) END AS p FROM part)"


def pvalues(spark, d):
    k = F.col("p_partkey") * 37 % 101
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("model"), F.when(F.col("p_partkey") % 7 != 0, F.round(k * k / 10201.0, 3).cast("double")).alias("p_value"))


@query(f"WITH {PVALUES}, R AS (SELECT *, {RANKED.format(p='p')} FROM P) SELECT id, model, round(p, 6)::DOUBLE AS p_value, round({FDR.format(p='p')}, 6)::DOUBLE AS p_fdr FROM R")
def fdr(spark, d):
    return ranking.with_fdr(pvalues(spark, d))


@query(f"""WITH {PVALUES}, R AS (SELECT *, count(p) OVER (PARTITION BY model) AS m, row_number() OVER (PARTITION BY model, p IS NULL ORDER BY p) AS r FROM P),
Q AS (SELECT *, CASE WHEN p IS NOT NULL THEN least(1, min(p * m / r) OVER (PARTITION BY model, p IS NULL ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS q FROM R),
T AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, id) AS k FROM Q WHERE q < 0.2) SELECT id, model, round(p, 6)::DOUBLE AS p_value, round(q, 6)::DOUBLE AS p_fdr FROM T WHERE k <= 5""")
def top_hits(spark, d):
    hits = ranking.with_fdr(pvalues(spark, d), by=("model",)).withColumn("status", F.lit("ok")).withColumn("feature", F.col("id"))
    return report.top_hits(hits, alpha=0.2, per_panel=5).select("id", "model", "p_value", "p_fdr")


# ---- preparation, harmonization, reduction ------------------------------------------------------

@query(f"""WITH {LONG}, B AS (SELECT feature, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM L GROUP BY feature),
C AS (SELECT sample_id, feature, CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END AS v FROM L JOIN B USING (feature)), S AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS sd FROM C GROUP BY feature)
SELECT sample_id, feature, round((v - m) / sd, 6) + 0.0 AS value FROM C JOIN S USING (feature)""")
def prep_winsor_zscore(spark, d):
    return prep.FeaturePrep(skip_power=True).fit_transform(features(spark, d)).select("sample_id", "feature", "value")


@query()
def prep_yeo_johnson(spark, d):
    return prep.FeaturePrep().fit_transform(features(spark, d)).select("sample_id", "feature", "value")


@query(f"WITH {LONG}, M AS (SELECT feature, median(value) AS m FROM L GROUP BY feature) SELECT sample_id, feature, round(coalesce(value, m), 6) + 0.0 AS value FROM L JOIN M USING (feature)")
def impute_median(spark, d):
    return prep.imputed(features(spark, d), "median").select("sample_id", "feature", "value")


@query()
def combat(spark, d):
    return prep.BatchHarmonizer().fit_transform(features(spark, d)).select("sample_id", "feature", "value")


@query()
def pca_scores(spark, d):
    return reduce.PCA(3).fit_transform(arrays(spark, d)).select("sample_id", F.posexplode("components").alias("component", "score"))


@query()
def sparse_pca_scores(spark, d):
    return reduce.SparsePCA(3, alpha=0.5).fit_transform(arrays(spark, d)).select("sample_id", F.posexplode("components").alias("component", "score"))


POINTS = "E AS (SELECT vec_id AS sample_id, 'b' || (label % 3) AS batch, embedding::DOUBLE[] AS x FROM embeddings)"


def points(spark, d):
    """Whole vectors."""
    return arrays(spark, d).withColumnRenamed("features", "coords")


@query(f"""WITH {POINTS}, U AS (SELECT batch, unnest(x) AS v, unnest(range(len(x))) AS j FROM E), G AS (SELECT batch, j, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM U GROUP BY ALL),
B AS (SELECT *, sum(n * m) OVER (PARTITION BY j) / sum(n) OVER (PARTITION BY j) AS gm FROM G),
S AS (SELECT sum(n * pow(m - gm, 2)) AS b, sum(ss) AS w, count(DISTINCT batch) AS k, sum(CASE WHEN j = 0 THEN n END) AS n FROM B)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) + 0.0 AS permanova_f, round(b / (b + w), 6) + 0.0 AS permanova_r2 FROM S""")
def permanova(spark, d):
    """The observed statistics, which need no permutation; ``permanova_test`` has their p."""
    return diagnostics.permanova(points(spark, d), 0).drop("permanova_p")


@query()
def permanova_test(spark, d):
    return diagnostics.permanova(points(spark, d))


DIST = f"{POINTS}, D AS (SELECT a.sample_id, a.batch, b.batch AS other, b.sample_id AS oid, list_distance(a.x, b.x) AS dist FROM E a JOIN E b ON a.sample_id <> b.sample_id)"


@query(f"""WITH {DIST}, A AS (SELECT sample_id, batch, other, avg(dist) AS m FROM D GROUP BY ALL), S AS (SELECT sample_id, max(CASE WHEN batch = other THEN m END) AS i, min(CASE WHEN batch <> other THEN m END) AS o FROM A GROUP BY sample_id)
SELECT round(avg((o - i) / greatest(i, o)), 6) + 0.0 AS silhouette FROM S""")
def silhouette(spark, d):
    return diagnostics.silhouette(points(spark, d))


@query(f"""WITH {DIST}, K AS (SELECT sample_id, other, row_number() OVER (PARTITION BY sample_id ORDER BY dist, oid) AS r FROM D), C AS (SELECT sample_id, other, count(*) AS c FROM K WHERE r <= 30 GROUP BY ALL),
I AS (SELECT pow(sum(c), 2) / sum(c * c) AS v FROM C GROUP BY sample_id) SELECT round(median(v), 6) + 0.0 AS lisi_batch FROM I""")
def lisi(spark, d):
    return diagnostics.lisi(points(spark, d))


@query()
def kbet(spark, d):
    return diagnostics.kbet(points(spark, d))


@query()
def global_diagnostics(spark, d):
    return diagnostics.global_diagnostics(arrays(spark, d), "raw", 5, 49)


# ---- models, networks ---------------------------------------------------------------------------

@query(f"""WITH {LONG}, V AS (SELECT feature, value AS x, label::DOUBLE AS y FROM L WHERE value IS NOT NULL), M AS (SELECT feature, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM V GROUP BY feature),
B AS (SELECT feature, n, mx, my, sum((x - mx) * (x - mx)) AS sxx, sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS b FROM V JOIN M USING (feature) GROUP BY ALL),
H AS (SELECT feature, n, b, sqrt(sum(pow((x - mx) * ((y - my) - b * (x - mx)) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx), 2))) / any_value(sxx) AS se FROM V JOIN B USING (feature) GROUP BY ALL)
SELECT feature, n::BIGINT AS n, round(b, 6) + 0.0 AS coef, round(se, 6) + 0.0 AS se, round(b / se, 6) + 0.0 AS statistic FROM H""")
def ols_hc3(spark, d):
    return models.ols_hc3(features(spark, d).withColumn("y", F.col("label").cast("double"))).select("feature", "n", "coef", "se", "statistic")


@query()
def associations_continuous(spark, d):
    meta = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 13).cast("double").alias("age"))
    return models.associations(features(spark, d), meta, "continuous", ["y"], {"univariable": [], "adjusted": ["age"]})


@query()
def associations_binary(spark, d):
    meta = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("label") < 5).cast("double").alias("y"))
    return models.associations(features(spark, d), meta, "binary", ["y"])


@query()
def associations_survival(spark, d):
    meta = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 37 + 1).cast("double").alias("time"), (F.col("label") % 2).cast("double").alias("event"))
    return models.associations(features(spark, d), meta, "survival", ["time", "event"])


@query()
def associations_grouped(spark, d):
    meta = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 20).cast("string").alias("grp"))
    return models.associations(features(spark, d), meta, "continuous", ["y"], group="grp")


WEIGHTS = "K AS (SELECT feature, dim, 'm' || (dim // 16) AS module, avg(value) AS c, stddev_samp(value) AS s, ((dim % 16) - 3.7) / 10 AS loading FROM W GROUP BY ALL)"


def weights(spark, d):
    return whole(spark, d).groupBy("feature", "dim").agg(F.avg("value").alias("center"), F.stddev_samp("value").alias("scale")).select("feature", F.concat(F.lit("m"), F.floor(F.col("dim") / 16).cast("string")).alias("module"), "center", "scale", ((F.col("dim") % 16 - 3.7) / 10).alias("loading"))


@query(f"WITH {LONG}, {WEIGHTS} SELECT sample_id, module, round(sum((value - c) / s * loading), 6) + 0.0 AS score FROM W JOIN K USING (feature) GROUP BY ALL")
def module_scores(spark, d):
    return network.project(whole(spark, d), weights(spark, d))


@query(f"WITH {LONG}, {WEIGHTS} SELECT feature, module, round(loading, 6) + 0.0 AS loading, round(abs(loading) / sum(abs(loading)) OVER (PARTITION BY module), 6) + 0.0 AS importance FROM K")
def module_importances(spark, d):
    return network.importances(weights(spark, d))


@query("SELECT 'm' || (i // 16) AS module, count(*)::BIGINT AS n_features FROM range(64) t(i) GROUP BY 1")
def module_sizes(spark, d):
    return network.module_sizes(weights(spark, d))


@query()
def network_modules(spark, d):
    return network.CoexpressionModules(min_module_size=4, soft_power=2).fit(arrays(spark, d)).assignments(spark)


# ---- reports ------------------------------------------------------------------------------------

@query(f"""{ANOVA}, S AS (SELECT ssb / (ssb + ssw) AS eta FROM R), H AS (SELECT least(floor(eta / 0.05), 19) AS b FROM S) SELECT b::BIGINT AS bin, round(b * 0.05, 6) + 0.0 AS low, count(*)::BIGINT AS n FROM H GROUP BY ALL""")
def histogram(spark, d):
    return report.histogram(groups.anova(features(spark, d)), "eta_squared")


@query(f"WITH {PVALUES} SELECT id, model, round(-log10(greatest(p, 4.94065645841247e-324)), 6) + 0.0 AS minus_log10_p FROM P WHERE p IS NOT NULL AND p > 0")
def minus_log10_p(spark, d):
    return pvalues(spark, d).where("p_value > 0").select("id", "model", scalars.minus_log10("p_value").alias("minus_log10_p"))


@query("""WITH o AS (SELECT p_partkey, p_type, row_number() OVER (ORDER BY p_partkey) AS pos FROM part), g AS (SELECT *, CASE WHEN lag(p_type) OVER (ORDER BY pos) IS DISTINCT FROM p_type THEN 1 ELSE 0 END AS starts FROM o), b AS (SELECT *, sum(starts) OVER (ORDER BY pos) AS block FROM g)
SELECT block::BIGINT AS block, p_type AS family, min(pos)::BIGINT AS start, max(pos)::BIGINT AS "end" FROM b GROUP BY ALL""")
def family_blocks(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").select(F.col("p_type").alias("family"), F.row_number().over(Window.orderBy("p_partkey")).alias("position"))
    return report.family_blocks(p)


@query("SELECT p_brand AS feature, " + ", ".join(f"round(avg(CASE WHEN p_size % 3 = {i} THEN p_retailprice END), 6) AS t{i}" for i in range(3)) + " FROM part GROUP BY 1")
def tier_matrix(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("feature"), F.concat(F.lit("t"), (F.col("p_size") % 3).cast("string")).alias("model")).agg(F.avg("p_retailprice").alias("coef"))
    return report.value_matrix(p, "coef", ["t0", "t1", "t2"])


# ---- tables behind figures ------------------------------------------------------------------------

NAMES = [f"f{i:02d}" for i in range(64)]


@query(f"""WITH {LONG}, R AS (SELECT a.feature AS fa, b.feature AS fb, a.dim AS da, b.dim AS db, corr(a.value, b.value) AS r FROM W a JOIN W b USING (sample_id) GROUP BY ALL),
O AS (SELECT dim, row_number() OVER (ORDER BY dim % 4, dim) - 1 AS i FROM (SELECT unnest(range(64)) AS dim))
SELECT x.i::BIGINT AS x, y.i::BIGINT AS y, fb AS feature_x, fa AS feature_y, round(r, 6) + 0.0 AS similarity FROM R JOIN O x ON x.dim = db JOIN O y ON y.dim = da""")
def heatmap_cells(spark, d):
    order = figures.display_order(NAMES, labels={f: f"m{i % 4}" for i, f in enumerate(NAMES)})
    return figures.heatmap(figures.correlations(arrays(spark, d), NAMES), order)


HUBS = f"""{MEMBERSHIP}, S AS (SELECT feature, abs(corr(value, label)) AS s FROM W GROUP BY feature),
P AS (SELECT R.feature, k, s, dim // 16 = 1 AS in_target FROM R JOIN S USING (feature) WHERE component = 'm1')"""


def hub_parts(spark, d):
    long = whole(spark, d)
    clusters = long.select("feature", F.concat(F.lit("m"), F.floor(F.col("dim") / 16).cast("string")).alias("cluster")).distinct()
    meaning = agreement.correlated(long, ("feature",), "value", "label").select("feature", F.abs("r").alias("significance"))
    return figures.hub_significance(association.module_membership(long, components(spark, d), "pearson"), meaning, clusters, "m1")


@query(f"{HUBS}, T AS (SELECT *, row_number() OVER (PARTITION BY in_target ORDER BY abs(k) DESC, feature) AS n FROM P) SELECT feature, round(k, 6) + 0.0 AS k_me, round(s, 6) + 0.0 AS significance, in_target, CASE WHEN in_target AND n <= 5 THEN feature END AS label FROM T")
def hub_significance_points(spark, d):
    return hub_parts(spark, d)[0]


@query(f"{HUBS}, K AS (SELECT rank() OVER (ORDER BY k) AS x, rank() OVER (ORDER BY s) AS y FROM P WHERE in_target) SELECT count(*)::BIGINT AS n, round(corr(x, y), 6) + 0.0 AS r FROM K")
def hub_significance_summary(spark, d):
    return hub_parts(spark, d)[1].drop("p_value")


@query(f"""WITH {LONG}, {MODULES}, P AS (SELECT DISTINCT sample_id, batch AS trait, score FROM Z JOIN W USING (sample_id) WHERE component = 'm0'),
B AS (SELECT trait, count(*) AS n, quantile_cont(score, 0.25) AS q1, median(score) AS m, quantile_cont(score, 0.75) AS q3 FROM P GROUP BY trait),
I AS (SELECT P.trait, score, score >= q1 - 1.5 * (q3 - q1) AND score <= q3 + 1.5 * (q3 - q1) AS inside FROM P JOIN B USING (trait)),
E2 AS (SELECT trait, min(CASE WHEN inside THEN score END) AS lo, max(CASE WHEN inside THEN score END) AS hi, count_if(NOT inside) AS o FROM I GROUP BY trait)
SELECT trait, n::BIGINT AS n, round(q1, 6) + 0.0 AS q1, round(m, 6) + 0.0 AS median, round(q3, 6) + 0.0 AS q3, round(lo, 6) + 0.0 AS whisker_low, round(hi, 6) + 0.0 AS whisker_high, o::BIGINT AS n_outliers FROM B JOIN E2 USING (trait)""")
def eigengene_boxes(spark, d):
    trait = arrays(spark, d).select("sample_id", F.col("batch").alias("trait"))
    return figures.eigengene_profile(components(spark, d), trait, "m0")[1]


@query(f"""WITH {LONG}, {MODULES}, P AS (SELECT score AS y, label AS x FROM Z JOIN (SELECT vec_id AS sample_id, label FROM embeddings) USING (sample_id) WHERE component = 'm0')
SELECT count(*)::BIGINT AS n, round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 6) + 0.0 AS intercept, round(corr(x, y), 6) + 0.0 AS r FROM P""")
def eigengene_line(spark, d):
    trait = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), F.col("label").alias("trait"))
    return figures.eigengene_profile(components(spark, d), trait, "m0")[1].drop("p_value")


@query()
def batch_densities(spark, d):
    before = features(spark, d)
    return figures.batch_distributions(before, prep.BatchHarmonizer().fit_transform(before), NAMES)


SHEETS = f"""{ANOVA}, J AS (SELECT feature, value AS x, label AS y FROM L WHERE value IS NOT NULL), K AS (SELECT feature, {AVERAGE.format(by='feature', v='x')} AS x, {AVERAGE.format(by='feature', v='y')} AS y FROM J),
V2 AS (SELECT 'icc' AS sheet, feature, ssb / (ssb + ssw) AS value FROM R UNION ALL SELECT 'spearman', feature, corr(x, y) FROM K GROUP BY feature)"""


def sheets(spark, d):
    """Values of agreement for figures: how much batches explain as icc, rank correlation with the label as spearman."""
    long = features(spark, d)
    icc = groups.anova(long).select("feature", F.col("eta_squared").alias("icc_2_1"))
    return figures.reproducibility_values({"icc": icc, "spearman": agreement.correlated(long, ("feature",), "value", "label", "spearman").select("feature", F.col("r").alias("estimate"))})


@query(f"""{SHEETS}, M AS (SELECT *, min(value) OVER (PARTITION BY sheet) < 0 AS wide FROM V2),
B AS (SELECT sheet, wide, CASE WHEN wide THEN least(floor((value + 1) / 0.1), 19) ELSE least(floor(value / 0.05), 19) END::BIGINT AS bin FROM M)
SELECT sheet, bin, round(CASE WHEN wide THEN bin * 0.1 - 1 ELSE bin * 0.05 END, 6)::DOUBLE + 0.0 AS low, count(*)::BIGINT AS n FROM B GROUP BY ALL""")
def repro_histogram_bars(spark, d):
    return figures.reproducibility_histograms(sheets(spark, d), 0.05)[0]


@query(f"""{SHEETS} SELECT sheet, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, CASE WHEN sheet = 'icc' THEN count_if(value >= 0.05)::BIGINT END AS n_pass,
  round(CASE WHEN sheet = 'icc' THEN count_if(value >= 0.05) / count(*) END, 6) + 0.0 AS pass_rate FROM V2 GROUP BY sheet""")
def repro_histogram_statistics(spark, d):
    return figures.reproducibility_histograms(sheets(spark, d), 0.05)[1]


FAMILIES = ["glcm", "zeta", "morphology", "Alpha", "ngldm", "ivh"]


@query(f"""{ANOVA}, F AS (SELECT feature, ssb / (ssb + ssw) AS v, dim, CASE WHEN dim % 7 < 6 THEN ['glcm', 'zeta', 'morphology', 'Alpha', 'ngldm', 'ivh'][1 + dim % 7] END AS fam, CASE WHEN dim % 3 > 0 THEN (dim % 5) * 12.5 END AS param FROM R JOIN (SELECT DISTINCT feature, dim FROM W) USING (feature)),
O AS (SELECT *, row_number() OVER (ORDER BY CASE fam WHEN 'morphology' THEN 1 WHEN 'ivh' THEN 4 WHEN 'glcm' THEN 5 WHEN 'ngldm' THEN 10 ELSE CASE WHEN fam IS NOT NULL THEN 11 END END NULLS FIRST, fam NULLS FIRST, param NULLS FIRST, feature) - 1 AS pos FROM F)
SELECT feature, fam AS "group", pos::BIGINT AS position, (count(*) OVER () - 1 - pos)::BIGINT AS y, round(v, 6) + 0.0 AS value, ((v >= 0.002)::INT + (v >= 0.004)::INT + (v >= 0.01)::INT)::BIGINT AS category,
  CASE WHEN dim % 3 = 0 OR dim % 2 = 1 THEN 'None' ELSE CASE WHEN param = floor(param) THEN param::BIGINT::VARCHAR ELSE param::DOUBLE::VARCHAR END END AS disc_label FROM O""")
def synteny_rows(spark, d):
    k = features(spark, d).select("feature", "dim").distinct()
    kinds = k.select("feature", F.when(F.col("dim") % 7 < 6, F.element_at(F.array(*map(F.lit, FAMILIES)), (F.col("dim") % 7 + 1).cast("int"))).alias("family"), (F.col("dim") % 2 == 0).alias("is_discretised"), F.when(F.col("dim") % 3 > 0, (F.col("dim") % 5) * 12.5).alias("discretisation_param"))
    return figures.synteny(groups.anova(features(spark, d)).select("feature", F.col("eta_squared").alias("icc_2_1")).join(kinds, "feature"), thresholds=(0.002, 0.004, 0.01))


@query(f"{ANOVA}, Q AS (SELECT {FDR.format(p='p')} AS q FROM R) SELECT count(*)::BIGINT AS n_features, count_if(q <= 0.05)::BIGINT AS n_significant, round(100.0 * count_if(q <= 0.05) / count(*), 6) + 0.0 AS percent FROM Q")
def batch_q_summary(spark, d):
    stats = ranking.with_fdr(groups.anova(features(spark, d)), "anova_p", "anova_q")
    return figures.batch_figure(arrays(spark, d), stats)["q_summary"]


def tested(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") - 1400).alias("coef"))
    return pvalues(spark, d).join(p, "id").select("model", F.col("id").cast("string").alias("feature"), F.lit("ok").alias("status"), "p_value", F.lit(None).cast("double").alias("p_fdr"), "coef", F.lit("coef").alias("effect_name"), F.lit(None).cast("double").alias("effect"))


@query(f"WITH {PVALUES}, J AS (SELECT model, p, p_retailprice - 1400 AS x FROM P JOIN part ON id = p_partkey WHERE p > 0) SELECT model, round(quantile_cont(abs(x), 0.99) * 1.08, 6) AS x_limit, round(max(-log10(p)) * 1.08, 6) AS y_limit FROM J GROUP BY model")
def volcano_limits(spark, d):
    return figures.volcano_limits(tested(spark, d))


@query()
def dendrogram_leaves(spark, d):
    return figures.dendrogram(network.CoexpressionModules(min_module_size=4, soft_power=2).fit(arrays(spark, d)), spark)[0]


@query()
def grid_search(spark, d):
    """Winsor bounds and scaling of a preparation, by the mean absolute skew that it leaves in samples held out."""
    long = search.hashed_folds(whole(spark, d).select("sample_id", "feature", "value"), "sample_id", 3)
    flat = lambda chain, test: -chain.transform(test).groupBy("feature").agg(F.skewness("value").alias("s")).agg(F.avg(F.abs("s"))).first()[0]
    chain = search.Chain([("prep", prep.FeaturePrep(skip_power=True))])
    return search.grid_search(long, chain, {"prep__winsor_lower": [0.0, 0.05], "prep__standardize": [True, False]}, {"symmetry": flat}, 3).summary()
