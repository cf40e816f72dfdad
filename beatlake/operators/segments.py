"""Windows laid over recordings, and slices of chunked signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatlake.operators.intervals import overlap_flag

Keys = list[str]


def tiles(recordings: DataFrame, duration: str, length: float, partial: bool = False) -> DataFrame:
    """Windows of fixed length over each recording; the partial last one only if asked for."""
    n = F.ceil(F.col(duration) / length) if partial else F.floor(F.col(duration) / length)
    idx = F.when(n >= 1, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    x = recordings.withColumn("window_idx", F.explode(idx))
    return x.withColumns({"win_start_s": F.col("window_idx") * float(length), "win_end_s": (F.col("window_idx") + 1) * float(length)})


def sliding(recordings: DataFrame, duration: str, length: float, step: float, at_least_one: bool = True) -> DataFrame:
    """Windows every `step`; those that end beyond the recording go, but a first one stays where asked for."""
    n = F.floor((F.col(duration) - length) / step) + 1
    n = F.greatest(n, F.lit(1 if at_least_one else 0))
    idx = F.when(n >= 1, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    x = recordings.withColumn("window_idx", F.explode(idx))
    return x.withColumns({"win_start_s": F.col("window_idx") * float(step), "win_end_s": F.col("window_idx") * float(step) + length})


def segment_index(recordings: DataFrame, events: DataFrame, keys: Keys, duration: str, e: tuple[str, str], length: float = 60.0, buffer: float = 60.0) -> DataFrame:
    """Tiles labelled seizure_core, seizure_extended (within the buffer) or baseline, the first that applies."""
    w = tiles(recordings, duration, length)
    wide = events.select(*keys, (F.col(e[0]) - buffer).alias("_b0"), (F.col(e[1]) + buffer).alias("_b1"))
    x = overlap_flag(w, events, keys, ["window_idx"], ("win_start_s", "win_end_s"), e, out="_core")
    x = overlap_flag(x, wide, keys, ["window_idx"], ("win_start_s", "win_end_s"), ("_b0", "_b1"), out="_near")
    label = F.when(F.col("_core"), "seizure_core").when(F.col("_near"), "seizure_extended").otherwise("baseline")
    return x.withColumn("context", label).drop("_core", "_near")


#: Offsets in seconds of windows around an onset: before, and after the end of the event.
ROLES = {"pre_20min": ("t0", -1200.0), "pre_2min": ("t0", -120.0), "post_2min": ("t1", 120.0), "post_20min": ("t1", 1200.0)}


def peri_windows(events: DataFrame, e: tuple[str, str] = ("t0", "t1"), length: float = 60.0, roles: dict[str, tuple[str, float]] = ROLES) -> DataFrame:
    """A window for each role around each event, and the event itself (ictal); those before the start of the recording are cut at 0, empty ones go."""
    col = {"t0": F.col(e[0]), "t1": F.col(e[1])}
    rows = [F.struct(F.lit(r).alias("role"), (col[a] + o).alias("w_start"), (col[a] + o + length).alias("w_end")) for r, (a, o) in roles.items()]
    rows.append(F.struct(F.lit("ictal").alias("role"), col["t0"].alias("w_start"), col["t1"].alias("w_end")))
    x = events.withColumn("_r", F.explode(F.array(*rows))).select(*events.columns, "_r.role", F.greatest("_r.w_start", F.lit(0.0)).alias("w_start"), F.col("_r.w_end").alias("w_end"))
    return x.where("w_end > w_start")


def shifted_windows(events: DataFrame, onset: Column, duration: str, half: float = 300.0, shifts: list[float] = (-7200.0, -3600.0, 0.0, 3600.0, 7200.0)) -> DataFrame:
    """Windows of ±half around shifted onsets, cut to the recording, with whether they were cut."""
    x = events.withColumn("shift_s", F.explode(F.array(*(F.lit(float(s)) for s in shifts))))
    low, high = onset + F.col("shift_s") - half, onset + F.col("shift_s") + half
    x = x.withColumns({"w_start": F.greatest(low, F.lit(0.0)), "w_end": F.least(high, F.col(duration)), "truncated": (low < 0) | (high > F.col(duration))})
    return x.where("w_end > w_start")


def trimmed(t: Column, trim: Column) -> Column:
    """A time on the trimmed axis; what lies before the trim is 0."""
    return F.greatest(t - trim, F.lit(0.0))


def build_events(rows: DataFrame, rec_start: str, rec_end: str, eeg: tuple[str, str], clinical: tuple[str, str], trim: str) -> DataFrame:
    """Annotated events on their recording's axis: the EEG times where both are known, else the clinical ones; clipped to the recording, others go."""
    have = F.col(eeg[0]).isNotNull() & F.col(eeg[1]).isNotNull()
    x = rows.withColumns({"chosen": F.when(have, "eeg").otherwise("clinical"), "_s": F.when(have, F.col(eeg[0])).otherwise(F.col(clinical[0])), "_e": F.when(have, F.col(eeg[1])).otherwise(F.col(clinical[1]))})
    x = x.where((F.col("_s") < F.col(rec_end)) & (F.col("_e") > F.col(rec_start)) & (F.col("_e") >= F.col("_s")))
    x = x.withColumns({"absolute_start": F.greatest("_s", rec_start), "absolute_end": F.least("_e", rec_end)})
    sec = lambda c: (micros(F.col(c)) - micros(F.col(rec_start))) / 1e6
    x = x.withColumns({"t0": sec("absolute_start"), "t1": sec("absolute_end")})
    x = x.withColumns({"duration_s": F.col("t1") - F.col("t0"), "t0_trim": trimmed(F.col("t0"), F.col(trim)), "t1_trim": trimmed(F.col("t1"), F.col(trim))})
    return x.withColumn("in_trim", F.col("t1_trim") > 0).drop("_s", "_e")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def absolute_times(windows: DataFrame, start: str, seconds: dict[str, str]) -> DataFrame:
    """Timestamps of seconds since the recording's start."""
    add = lambda c: F.timestamp_micros(micros(F.col(start)) + F.round(F.col(c) * 1e6).cast("bigint")).cast("timestamp_ntz")
    return windows.withColumns({out: add(c) for c, out in seconds.items()})


def to_samples(events: DataFrame, t: tuple[str, str], fs: Column, n: Column) -> DataFrame:
    """First and end sample of each event, rounded half to even, within the recording, at least one sample long."""
    i0 = F.least(F.greatest(F.rint(F.col(t[0]) * fs).cast("bigint"), F.lit(0).cast("bigint")), n - 1)
    x = events.withColumn("i0", i0)
    return x.withColumn("i1", F.greatest(F.least(F.rint(F.col(t[1]) * fs).cast("bigint"), n), F.col("i0") + 1))


def chunked(samples: DataFrame, keys: Keys, i: str, x: str, size: int) -> DataFrame:
    """Rows of arrays from one row a sample."""
    g = samples.groupBy(*keys, F.floor(F.col(i) / size).cast("bigint").alias("chunk_idx")).agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(x).alias("x")))).alias("_s"))
    return g.select(*keys, "chunk_idx", F.col("_s")[0]["i"].alias("start_sample"), F.transform("_s", lambda s: s["x"]).alias("samples"))


def slices(chunks: DataFrame, spans: DataFrame, keys: Keys, span_id: list[str], i0: str, i1: str) -> DataFrame:
    """Samples [i0, i1) of each span, put together from the chunks it touches."""
    x = chunks.join(spans.select(*keys, *span_id, i0, i1), keys).where((F.col("start_sample") < F.col(i1)) & (F.col("start_sample") + F.size("samples") > F.col(i0)))
    low = F.greatest(F.col(i0) - F.col("start_sample"), F.lit(0))
    high = F.least(F.col(i1) - F.col("start_sample"), F.size("samples"))
    x = x.withColumn("_p", F.struct("start_sample", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("s")))
    g = x.groupBy(*keys, *span_id).agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return g.select(*keys, *span_id, F.flatten(F.transform("_p", lambda p: p["s"])).alias("samples"))


def trim_samples(x: Column, fs: float, start_s: float, end_s: float, mode: str = "round") -> Column:
    """Samples without the first and last seconds, whose numbers are rounded (half to even) or cut; an error for an unknown mode."""
    count = {"round": round, "cut": int}[mode]
    a, b = count(start_s * fs), count(end_s * fs)
    return F.slice(x, F.lit(a + 1), F.greatest(F.size(x) - (a + b), F.lit(0)))


def array_stats(x: Column) -> dict[str, Column]:
    """Statistics of a sample array: mean, min, max, population deviation, rms, peak to peak, median."""
    n = F.nullif(F.size(x).cast("double"), F.lit(0.0))
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    square = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n
    var = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    s, k = F.array_sort(x), F.size(x)
    mid = (s[F.floor((k - 1) / 2).cast("int")] + s[F.floor(k / 2).cast("int")]) / 2
    return {"mean": mean, "min": F.array_min(x), "max": F.array_max(x), "std": F.sqrt(var), "rms": F.sqrt(square), "ptp": F.array_max(x) - F.array_min(x), "median": mid}


def flat_share(x: Column, width: int, limit: float) -> Column:
    """Share of sub-windows of `width` samples, the partial last one among them, whose range is below the limit."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / width).cast("int") - 1, F.lit(0)))
    flat = F.transform(starts, lambda i: F.array_max(F.slice(x, i * width + 1, width)) - F.array_min(F.slice(x, i * width + 1, width)) < limit)
    return F.size(F.filter(flat, lambda f: f)) / F.size(flat)


def amplitude_features(x: Column) -> dict[str, Column]:
    """Amplitude difference, and the largest relative step between neighbours."""
    steps = F.zip_with(F.slice(x, 2, F.size(x) - 1), F.slice(x, 1, F.size(x) - 1), lambda b, a: F.abs(b - a))
    span = F.array_max(x) - F.array_min(x)
    return {"ampdiff": span, "rampdiff": F.array_max(steps) / F.when(span > 0, span)}


def event_profile(points: DataFrame, events: DataFrame, keys: Keys, t: str, value: str, onset: str, before: int, after: int) -> DataFrame:
    """Mean value on a 1 s grid around event onsets."""
    x = points.join(events.select(*keys, F.col(onset).alias("_on")), keys).withColumn("rel_s", F.floor(F.col(t) - F.col("_on")).cast("bigint"))
    return x.where(F.col("rel_s").between(-before, after)).groupBy("rel_s").agg(F.avg(value).alias("mean_value"), F.count("*").alias("n"))


def align_day_shift(rows: DataFrame, e: tuple[str, str], r: tuple[str, str], shifts: tuple[int, ...] = (0, -1, 1, -2, 2)) -> DataFrame:
    """Events moved by the whole days that give the largest overlap with the recording; ties to the smaller move, in the given order."""
    day = 86400.0
    spine = [F.struct((-F.greatest(F.least(F.col(e[1]) + s * day, F.col(r[1])) - F.greatest(F.col(e[0]) + s * day, F.col(r[0])), F.lit(0.0))).alias("lost"), F.lit(i).alias("rank"), F.lit(s).alias("day_shift")) for i, s in enumerate(shifts)]
    x = rows.withColumn("_b", F.array_min(F.array(*spine)))
    return x.select(*rows.columns, F.col("_b.day_shift").alias("day_shift"), (-F.col("_b.lost")).alias("overlap_s"))


def repaired_end(start: Column, end: Column, time_only: Column, most: float = 172800.0, default: float = 120.0) -> Column:
    """An end in seconds: missing gives start + default; time only is put on the start's day (or the next); one before the start or too late gives the default."""
    e = F.when(time_only & (end < start), end + 86400.0).otherwise(end)
    return F.when(e.isNull() | (e < start) | (e - start > most), start + default).otherwise(e)
