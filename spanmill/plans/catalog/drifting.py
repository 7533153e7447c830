"""Embeddings and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanmill.operators import drift
from spanmill.plans import derived, jobs
from spanmill.plans.catalog.registry import query
from spanmill.plans.catalog.sql import END, WORDS, with_

SIDE = "CASE WHEN label < 5 THEN 'baseline' ELSE 'current' END AS side"


def drift_ctes(values: str, group: str = "", name: str = "scores") -> list[str]:
    """CTEs from ``values`` ([group,] side, dim, v) to scores per dimension."""
    g = f"{group}, " if group else ""
    on = f"USING ({g}dim)"
    return [
        f"{name}_rng AS (SELECT {g}dim, min(v) AS lo, max(v) AS hi, count(*) FILTER (side = 'baseline') AS n_baseline, "
        f"count(*) FILTER (side = 'current') AS n_current FROM {values} GROUP BY {g}dim)",
        f"{name}_cnt AS (SELECT {g}dim, CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 10), 9) ELSE 0 END::INT AS bin, "
        f"count(*) FILTER (side = 'baseline') AS b, count(*) FILTER (side = 'current') AS c FROM {values} JOIN {name}_rng {on} GROUP BY ALL)",
        f"{name}_raw AS (SELECT r.*, g.bin::INT AS bin, greatest(coalesce(b, 0) / (n_baseline * (hi - lo) / 10), 1e-6) AS db, "
        f"greatest(coalesce(c, 0) / (n_current * (hi - lo) / 10), 1e-6) AS dc FROM {name}_rng r CROSS JOIN range(10) AS g(bin) "
        f"LEFT JOIN {name}_cnt USING ({g}dim, bin))",
        f"{name}_dens AS (SELECT {g}dim, bin, n_baseline, n_current, lo, hi, db / sum(db) OVER (PARTITION BY {g}dim) AS bd, "
        f"dc / sum(dc) OVER (PARTITION BY {g}dim) AS cd FROM {name}_raw)",
        f"{name} AS (SELECT {g}dim, any_value(n_baseline) AS n_baseline, any_value(n_current) AS n_current, "
        "CASE WHEN any_value(n_baseline) = 0 OR any_value(n_current) = 0 THEN NULL WHEN any_value(hi) = any_value(lo) THEN 0 "
        "ELSE sum((cd - bd) * ln(cd / bd)) END AS psi, "
        "CASE WHEN any_value(n_baseline) = 0 OR any_value(n_current) = 0 THEN NULL WHEN any_value(hi) = any_value(lo) THEN 0 "
        f"ELSE greatest(sum(bd * ln(bd / cd)), 0) END AS kl_divergence FROM {name}_dens GROUP BY {g}dim)",
    ]


VALUES = (
    f"vals AS (SELECT score_date, side, dim, v::DOUBLE AS v FROM (SELECT DATE '2024-01-26' + (label % 5) AS score_date, {SIDE}, "
    "unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings))"
)
PLAIN = [VALUES, *drift_ctes("vals")]
BY_DATE_SQL = ", ".join([VALUES, *drift_ctes("vals", "score_date", "by_date_scores")])
DRIFT_TABLE_SQL = [
    BY_DATE_SQL,
    "drift_table AS (SELECT score_date, 'psi' AS metric_type, dim::INT AS dimension_index, psi AS score FROM by_date_scores "
    "UNION ALL SELECT score_date, 'kl_divergence', dim::INT, kl_divergence FROM by_date_scores)",
]


def daily_drift(spark, sf):
    return drift.drift_by_dimension(derived.vectors(spark, sf), group=["score_date"])


def drift_table(spark, sf):
    """A drift table with one run per date."""
    rows = F.array(
        F.struct(F.lit("psi").alias("metric_type"), F.col("psi").alias("score")),
        F.struct(F.lit("kl_divergence").alias("metric_type"), F.col("kl_divergence").alias("score")),
    )
    return daily_drift(spark, sf).select("score_date", F.col("dim").alias("dimension_index"), F.inline(rows))


PROMPTS = (
    "prompts AS (SELECT conv_id, turn, text AS prompt, "
    f"{END} - INTERVAL 1 DAY * (conv_id % 35) - INTERVAL 1 MINUTE * (turn + 1) AS start_time FROM conversations WHERE role = 'user')"
)
SLOTS = (
    "slots AS (SELECT conv_id, turn, slot, count(*)::DOUBLE AS n FROM (SELECT conv_id, turn, "
    f"('0x' || substr(md5(unnest({WORDS.format('prompt')})), 1, 8))::BIGINT % 384 AS slot FROM prompts) GROUP BY ALL)"
)
EMBEDDED = (
    "embedded AS (SELECT conv_id, turn, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)))::FLOAT::DOUBLE AS v FROM slots)"
)


@query("embed_text", with_("SELECT conv_id, turn, slot::INT AS dim, round(v, 6) AS v FROM embedded", PROMPTS, SLOTS, EMBEDDED))
def embed_text(spark, sf):
    """Non-zero entries of the hashed vectors, one row each."""
    embedded = drift.embed_text(derived.prompts(spark, sf).select("conv_id", "turn", "prompt"), "prompt")
    unfolded = embedded.select("conv_id", "turn", F.posexplode("embedding").alias("dim", "v"))
    return unfolded.filter("v <> 0").withColumn("v", F.col("v").cast("double"))


@query("baseline_current_split", with_(
    f"SELECT conv_id, turn, CASE WHEN start_time >= {END} - INTERVAL 7 DAY THEN 'current' ELSE 'baseline' END AS side FROM prompts "
    f"WHERE start_time >= {END} - INTERVAL 35 DAY AND start_time < {END}", PROMPTS))
def baseline_current_split(spark, sf):
    return drift.baseline_current_split(derived.prompts(spark, sf), "start_time", derived.AS_OF).select("conv_id", "turn", "side")


@query("histogram_by_dim", with_(
    "SELECT dim::INT AS dim, bin, n_baseline, n_current, round(bd, 6) AS baseline_density, round(cd, 6) AS current_density FROM scores_dens", *PLAIN))
def histogram_by_dim(spark, sf):
    return drift.density_rows(drift.densities(drift.histogram_by_dim(derived.vectors(spark, sf))))


@query("psi", with_(
    "SELECT round(avg(psi), 6) AS psi, round(max(psi), 6) AS max_psi, max(n_baseline) AS n_baseline, max(n_current) AS n_current FROM scores", *PLAIN))
def psi(spark, sf):
    return drift.psi(drift.drift_by_dimension(derived.vectors(spark, sf)))


APP_VALUES = (
    f"app_vals AS (SELECT concat('app-', vec_id % 7) AS app_id, side, dim, v::DOUBLE AS v FROM (SELECT vec_id, {SIDE}, "
    "unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings))"
)


@query("drift_by_app", with_(
    "SELECT app_id, round(avg(psi), 6) AS psi, round(max(psi), 6) AS max_psi, round(avg(kl_divergence), 6) AS kl_divergence, max(n_baseline) AS n_baseline, "
    "max(n_current) AS n_current, max(n_current) >= 10 AND max(n_baseline) > 0 AS enough FROM app_scores GROUP BY app_id",
    APP_VALUES, *drift_ctes("app_vals", "app_id", "app_scores")))
def drift_by_app(spark, sf):
    vectors = derived.vectors(spark, sf).withColumn("app_id", F.concat(F.lit("app-"), (F.col("vec_id") % 7).cast("string")))
    return drift.drift_by_app(vectors)


@query("kl_divergence", with_("SELECT round(avg(kl_divergence), 6) AS kl_divergence FROM scores", *PLAIN))
def kl_divergence(spark, sf):
    return drift.kl_divergence(drift.drift_by_dimension(derived.vectors(spark, sf)))


@query("drift_job", with_(
    "SELECT DATE '2024-01-31' AS score_date, 'psi' AS metric_type, dim::INT AS dimension_index, round(psi, 6) AS score, n_current, n_current >= 10 AND n_baseline > 0 AS enough, "
    "'2023-12-27 to 2024-01-23' AS baseline_period, '2024-01-24 to 2024-01-30' AS current_period FROM scores "
    "UNION ALL SELECT DATE '2024-01-31', 'kl_divergence', dim::INT, round(kl_divergence, 6), n_current, n_current >= 10 AND n_baseline > 0, "
    "'2023-12-27 to 2024-01-23', '2024-01-24 to 2024-01-30' FROM scores",
    PROMPTS, SLOTS, EMBEDDED,
    "dense AS (SELECT CASE WHEN start_time >= " + END + " - INTERVAL 7 DAY THEN 'current' ELSE 'baseline' END AS side, g.dim AS dim, "
    "coalesce(e.v, 0)::DOUBLE AS v FROM prompts p CROSS JOIN range(384) AS g(dim) "
    "LEFT JOIN embedded e ON e.conv_id = p.conv_id AND e.turn = p.turn AND e.slot = g.dim "
    f"WHERE start_time >= {END} - INTERVAL 35 DAY AND start_time < {END})",
    *drift_ctes("dense")))
def drift_job(spark, sf):
    return jobs.drift_job(derived.prompts(spark, sf), derived.AS_OF)
