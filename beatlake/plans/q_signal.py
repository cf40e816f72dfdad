"""Signal operators over embeddings: each vector is a segment of 64 samples at 128 Hz (bins of 2 Hz up to 64)."""

from __future__ import annotations

from pyspark.sql import functions as F

from beatlake.operators import segments as G
from beatlake.operators import signal as S
from beatlake.plans.registry import query, rounded, table

KEY, FS = ["vec_id"], 128.0


def segments(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))


X = "x AS (SELECT vec_id, label, [v::DOUBLE FOR v IN embedding] AS x FROM embeddings)"


@query("array_stats", f"WITH {X} SELECT vec_id, round(list_avg(x), 8) AS mean, round(list_min(x), 8) AS min, round(list_max(x), 8) AS max, round(list_stddev_pop(x), 8) AS std, round(sqrt(list_avg([v * v FOR v IN x])), 8) AS rms, round(list_max(x) - list_min(x), 8) AS ptp, round(list_median(x), 8) AS median FROM x")
def array_stats(spark, sf_dir):
    x = segments(spark, sf_dir).select("vec_id", *(v.alias(k) for k, v in G.array_stats(F.col("samples")).items()))
    return rounded(x, "mean", "min", "max", "std", "rms", "ptp", "median", digits=8)


@query("flat_windows", f"WITH {X}, w AS (SELECT vec_id, x[i * 10 + 1 : i * 10 + 10] AS s FROM x, LATERAL (SELECT unnest(range(7)) AS i)) SELECT vec_id, round(avg((list_max(s) - list_min(s) < 0.3)::INT), 6) AS flat_share FROM w GROUP BY 1")
def flat_windows(spark, sf_dir):
    return rounded(segments(spark, sf_dir).select("vec_id", G.flat_share(F.col("samples"), 10, 0.3).alias("flat_share")), "flat_share")


@query("sqi_amplitude", f"WITH {X}, s AS (SELECT vec_id, x, list_max([abs(x[i + 1] - x[i]) FOR i IN range(1, 64)]) AS st FROM x) SELECT vec_id, round(list_max(x) - list_min(x), 8) AS ampdiff, round(st / nullif(list_max(x) - list_min(x), 0), 8) AS rampdiff FROM s")
def sqi_amplitude(spark, sf_dir):
    x = segments(spark, sf_dir).select("vec_id", *(v.alias(k) for k, v in G.amplitude_features(F.col("samples")).items()))
    return rounded(x, "ampdiff", "rampdiff", digits=8)


@query("qc_metrics", f"WITH {X} SELECT vec_id, round(sqrt(list_avg([v * v FOR v IN x])), 8) AS rms, round(list_stddev_pop(x), 8) AS std, round(100.0 * len([d FOR d IN [abs(x[i + 1] - x[i]) FOR i IN range(1, 64)] IF d < 0.02]) / 63, 6) AS flat_pct FROM x")
def qc_metrics(spark, sf_dir):
    x = segments(spark, sf_dir).select("vec_id", *(v.alias(k) for k, v in S.qc_metrics(F.col("samples"), 0.02).items()))
    return rounded(rounded(x, "rms", "std", digits=8), "flat_pct")


DFT = "list_sum([x[i + 1] * {f}(2 * pi() * ((k * i) % 64) / 64) FOR i IN range(64)])"


@query("dft_band_ratios", f"""WITH {X}, k AS (SELECT vec_id, k, {DFT.format(f='cos')} ** 2 + {DFT.format(f='sin')} ** 2 AS p FROM x, LATERAL (SELECT unnest(range(33)) AS k)) SELECT vec_id, round(sum(p) FILTER (WHERE k BETWEEN 5 AND 15) / sum(p), 6) AS qrs_ratio, round(sum(p) FILTER (WHERE k > 15) / sum(p), 6) AS hf_ratio FROM k GROUP BY 1""")
def dft_band_ratios(spark, sf_dir):
    x = segments(spark, sf_dir).select("vec_id", S.dft_power(F.col("samples")).alias("p"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    out = x.select("vec_id", (total(F.slice("p", 6, 11)) / total(F.col("p"))).alias("qrs_ratio"), (total(F.slice("p", 17, 17)) / total(F.col("p"))).alias("hf_ratio"))
    return rounded(out, "qrs_ratio", "hf_ratio")


@query("teager_energy", f"WITH {X}, s AS (SELECT vec_id, i, x[i] * x[i] - x[i - 1] * x[i + 1] AS e FROM x, LATERAL (SELECT unnest(range(2, 64)) AS i)) SELECT vec_id, round(sum(e), 8) AS energy FROM s GROUP BY 1")
def teager_energy(spark, sf_dir):
    rows = segments(spark, sf_dir).select("vec_id", F.posexplode("samples").alias("i", "x"))
    return rounded(S.teager(rows, KEY, "i", "x").groupBy("vec_id").agg(F.sum("tkeo").alias("energy")), "energy", digits=8)


@query("fir_filter", f"WITH {X}, s AS (SELECT vec_id, i, coalesce(CASE WHEN i > 1 THEN x[i - 1] END, 0) * 0.25 + x[i] * 0.5 + coalesce(CASE WHEN i < 64 THEN x[i + 1] END, 0) * 0.25 AS y FROM x, LATERAL (SELECT unnest(range(1, 65)) AS i)) SELECT vec_id, round(sqrt(sum(y * y)), 8) AS norm FROM s GROUP BY 1")
def fir_filter(spark, sf_dir):
    rows = segments(spark, sf_dir).select("vec_id", F.posexplode("samples").alias("i", "x"))
    y = S.fir(rows, KEY, "i", "x", [0.25, 0.5, 0.25], "y")
    return rounded(y.groupBy("vec_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm")), "norm", digits=8)


@query("decimate_polarity", f"WITH {X}, s AS (SELECT vec_id, x, list_sort(x) AS o FROM x) SELECT vec_id, round(list_sum([x[i] FOR i IN range(1, 65, 4)]), 8) AS kept_sum, CASE WHEN abs(o[4]) > o[60] THEN -1 ELSE 1 END AS polarity FROM s")
def decimate_polarity(spark, sf_dir):
    x = segments(spark, sf_dir)
    kept = F.aggregate(S.decimated(F.col("samples"), 4), F.lit(0.0), lambda a, v: a + v)
    return rounded(x.select("vec_id", kept.alias("kept_sum"), S.polarity(F.col("samples")).alias("polarity")), "kept_sum", digits=8)


#: The density of a segment in SQL: the transform's sums over the windowed samples less their mean.
PSD = f"""{X}, y AS (SELECT vec_id, [(x[n + 1] - list_avg(x)) * (0.5 - 0.5 * cos(2 * pi() * n / 64)) FOR n IN range(64)] AS y FROM x),
d AS (SELECT vec_id, k * {FS} / 64 AS f, (pow(list_sum([y[n + 1] * cos(2 * pi() * ((k * n) % 64) / 64) FOR n IN range(64)]), 2) + pow(list_sum([y[n + 1] * sin(2 * pi() * ((k * n) % 64) / 64) FOR n IN range(64)]), 2)) / ({FS} * 24) * CASE WHEN k BETWEEN 1 AND 31 THEN 2 ELSE 1 END AS p FROM y, LATERAL (SELECT unnest(range(33)) AS k)),
tr AS (SELECT *, lead(f) OVER (PARTITION BY vec_id ORDER BY f) AS f1, lead(p) OVER (PARTITION BY vec_id ORDER BY f) AS p1 FROM d)"""
BANDS = {"lf": (0, 5), "qrs": (5, 15), "hf": (15, 40), "line": (49, 53)}


def band_sql(bands: dict[str, tuple[int, int]]) -> str:
    """Power and share of each band, by trapezoids."""
    rows = ", ".join(f"('{b}', {lo}, {hi})" for b, (lo, hi) in bands.items())
    return f"""bw AS (SELECT vec_id, band, coalesce(sum((f1 - f) * (p + p1) / 2) FILTER (WHERE f >= lo AND f1 <= hi), 0) AS power, sum((f1 - f) * (p + p1) / 2) AS total FROM tr, (VALUES {rows}) v(band, lo, hi) GROUP BY 1, 2), sh AS (SELECT *, power / nullif(total, 0) AS share FROM bw)"""


@query("psd_bands", f"WITH {PSD}, {band_sql(BANDS)} SELECT vec_id, band, round(power, 6) AS power, round(share, 6) AS share FROM sh")
def psd_bands(spark, sf_dir):
    return rounded(S.band_powers(S.psd(segments(spark, sf_dir), KEY, "samples", FS, 64), KEY, {b: (float(lo), float(hi)) for b, (lo, hi) in BANDS.items()}), "power", "share")


@query("psd_percentiles", f"WITH {PSD} SELECT (f * 64 / {FS})::INT AS bin, round(quantile_cont(p, 0.1), 9) AS p10, round(quantile_cont(p, 0.5), 9) AS p50, round(quantile_cont(p, 0.9), 9) AS p90 FROM d GROUP BY f")
def psd_percentiles(spark, sf_dir):
    return rounded(S.psd_bands(S.psd(segments(spark, sf_dir), KEY, "samples", FS, 64)), "p10", "p50", "p90", digits=9)


@query("power_outliers", f"""WITH {PSD}, {band_sql({'low': (5, 15)})}, b AS (SELECT b.vec_id, label, power FROM bw b JOIN embeddings e ON e.vec_id = b.vec_id)
SELECT vec_id, label, round(power, 6) AS power, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(power, 9) DESC, vec_id) AS rank FROM b) WHERE rank <= 8""")
def power_outliers(spark, sf_dir):
    """The eight segments of each label with most power in a band."""
    p = S.psd(segments(spark, sf_dir), KEY, "samples", FS, 64).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return rounded(S.power_outliers(p, KEY, (5.0, 15.0), 8, ["label"]).select("vec_id", "label", "power", "rank"), "power")


@query("spectral_uniqueness", f"WITH {PSD}, l AS (SELECT vec_id, f, log10(greatest(p, 1e-20)) AS lp FROM d), m AS (SELECT f, median(lp) AS m FROM l GROUP BY 1) SELECT vec_id, round(sqrt(avg(pow(lp - m, 2))), 6) AS uniqueness FROM l JOIN m USING (f) GROUP BY 1")
def spectral_uniqueness(spark, sf_dir):
    return rounded(S.spectral_uniqueness(S.psd(segments(spark, sf_dir), KEY, "samples", FS, 64), KEY), "uniqueness")


@query("noise_features", f"""WITH {PSD}, {band_sql({'qrs': (5, 15), 'hf': (40, 64), 'pl': (50, 52)})}, g AS (SELECT vec_id, max(power) FILTER (WHERE band = 'qrs') AS q, max(power) FILTER (WHERE band = 'hf') AS h, max(power) FILTER (WHERE band = 'pl') AS l, max(total) AS total FROM bw GROUP BY 1),
z AS (SELECT vec_id, sqrt(list_avg([v * v FOR v IN x])) AS rms, list_avg([((x[i + 1] < list_avg(x)) <> (x[i] < list_avg(x)))::INT FOR i IN range(1, 64)]) AS zcr FROM x), n AS (SELECT *, l / total AS pl, 10 * log10(greatest(q, 1e-12) / greatest(h, 1e-12)) AS snr FROM g JOIN z USING (vec_id))
SELECT vec_id, round(rms, 6) AS rms, 0.0::DOUBLE AS bw_ratio, round(h / total, 6) AS hf_ratio, round(pl, 6) AS pl_ratio, round(zcr, 6) AS zcr, round(snr, 6) AS snr_db,
round(0.45 + 0.4 * least(greatest(snr / 20, 0), 1) + 0.15 * (1 - least(greatest((pl - 0.01) / 0.19, 0), 1)), 6) AS sqi FROM n""")
def noise_features(spark, sf_dir):
    cols = ("rms", "bw_ratio", "hf_ratio", "pl_ratio", "zcr", "snr_db")
    x = S.noise_features(segments(spark, sf_dir), KEY, "samples", FS, 51.0)
    score = S.composite_sqi(F.col("snr_db"), F.col("bw_ratio"), F.col("pl_ratio"), F.lit(0.0), F.lit(0.0))
    return rounded(x.withColumn("sqi", score), *cols, "sqi")


@query("band_pass")
def band_pass(spark, sf_dir):
    x = S.band_pass(segments(spark, sf_dir), KEY, "samples", FS, 5.0, 15.0)
    return rounded(x.select("vec_id", F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)).alias("norm")), "norm")


@query("wavelet_energy")
def wavelet_energy(spark, sf_dir):
    return rounded(S.wavelet_energy(segments(spark, sf_dir), KEY, "samples", 3), "energy")


@query("scalogram")
def scalogram(spark, sf_dir):
    return rounded(S.scalogram(segments(spark, sf_dir), KEY, "samples", FS, [8.0, 16.0, 32.0]), "magnitude")


@query("detect_peaks")
def detect_peaks(spark, sf_dir):
    return S.detect_peaks(segments(spark, sf_dir), KEY, "samples", FS, "prominence", distance_s=0.05)


@query("kmeans_quality")
def kmeans_quality(spark, sf_dir):
    """Recordings (label groups of vectors) clustered by standardised features: sizes and medians of clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = segments(spark, sf_dir).select("vec_id", *(v.alias(k) for k, v in G.array_stats(F.col("samples")).items()))
    x = VectorAssembler(inputCols=["mean", "ptp", "rms"], outputCol="v").transform(x)
    x = StandardScaler(inputCol="v", outputCol="z", withMean=True).fit(x).transform(x)
    x = KMeans(k=3, seed=42, featuresCol="z", predictionCol="cluster").fit(x).transform(x)
    return rounded(x.groupBy("cluster").agg(F.count("*").alias("n"), F.median("ptp").alias("ptp"), F.median("mean").alias("mean")), "ptp", "mean")
