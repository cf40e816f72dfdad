"""Text sources: LabVIEW interval files, annotation tables, study tables, file listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from beatlake import schema as S
from beatlake.functions.scalars import parse_date, parse_rr_file, parse_time_seconds, truthy
from beatlake.operators import scan

HEADER_LINES = 22


#: Lines of a file that one task works on where values run on from line to line.
LINES = 1 << 20


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), text of text files, read by split.

    A split's rows come in order and with rising ids, so a line's number is
    its id's distance from the split's first one, on from the lines of all
    splits before: a count and an id a split, no line leaves its task.
    """
    m = F.col("_metadata")
    lines = spark.read.text(path).select(m["file_path"].alias("path"), m["file_block_start"].alias("_split"), F.col("value").alias("text"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("path", "_split").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("path").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("path", "_split", (before - F.col("_first") + 1).alias("_shift"))
    return lines.join(starts, ["path", "_split"]).select("path", (F.col("_id") + F.col("_shift")).alias("line"), "text")


def running(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums up to each line of a file, a block of lines at a time."""
    return scan.running_sums(scan.blocked(rows, "line", LINES), keys, ["line"], sums, LINES).drop("_block")


def decimal(text: Column) -> Column:
    """A number with a decimal comma or point, else null."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def read_lvm_rr(spark: SparkSession, path: str, skip: int = HEADER_LINES, column: int = 1) -> DataFrame:
    """path, ord, rr (seconds) of LabVIEW interval files: tab separated, decimal comma; the unit is told by the file's median."""
    rows = numbered_lines(spark, path).where(F.col("line") > skip).select("path", "line", decimal(F.get(F.split("text", "\t"), F.lit(column))).alias("raw")).where("raw is not null")
    unit = rows.groupBy("path").agg(F.median("raw").alias("m"))
    factor = F.when(F.col("m") > 10_000, 1e-6).when(F.col("m") > 5, 1e-3).otherwise(1.0)
    x = rows.join(unit, "path").select("path", "line", (F.col("raw") * factor).alias("rr"))
    return running(x, ["path"], {"ord": F.lit(1)}).select("path", F.col("ord").cast("int").alias("ord"), "rr")


def read_lvm_start(spark: SparkSession, path: str, skip: int = HEADER_LINES) -> DataFrame:
    """path and start (no zone) from a file's header lines Date and Time."""
    head = numbered_lines(spark, path).where(F.col("line") <= skip)
    field = lambda name: F.max(F.when(F.col("text").rlike(rf"^{name}\t"), F.trim(F.get(F.split("text", "\t"), F.lit(1)))))
    x = head.groupBy("path").agg(field("Date").alias("d"), field("Time").alias("t"))
    clock, part = F.regexp_extract("t", r"^(\d+:\d+:\d+)", 1), F.regexp_extract("t", r"[.,](\d+)", 1)
    # the fraction counts to the microsecond, rounded on its seventh digit
    micros = F.coalesce(F.round(F.rpad(part, 7, "0").try_cast("bigint") / 10).cast("bigint"), F.lit(0))
    day = F.unix_date(parse_date(F.col("d"))).cast("bigint")
    stamp = F.timestamp_micros(day * 86_400_000_000 + parse_time_seconds(clock).cast("bigint") * 1_000_000 + micros)
    return x.select("path", stamp.cast("timestamp_ntz").alias("start"))


def read_lvm_segments(spark: SparkSession, path: str) -> DataFrame:
    """path, segment, ord, rr, t of files with several headers: a header end starts a segment, and time starts anew in it."""
    x = running(numbered_lines(spark, path), ["path"], {"segment": F.col("text").startswith("***End_of_Header***").cast("int")})
    x = x.withColumn("rr", decimal(F.get(F.split("text", "\t"), F.lit(1)))).where("segment > 0 and rr is not null")
    x = running(x, ["path", "segment"], {"ord": F.lit(1), "t": F.col("rr")})
    return x.select("path", "segment", F.col("ord").cast("int").alias("ord"), "rr", "t")


def read_consensus_csv(spark: SparkSession, path: str, first: int = 9) -> DataFrame:
    """path, ord, start, end (exclusive), class from columns `first`.. of header-less annotation files; class 0 goes. Where rows overlap, the larger ord holds."""
    cells = numbered_lines(spark, path).select("path", F.col("line").alias("ord"), F.split("text", ",").alias("c"))
    get = lambda i: F.get("c", F.lit(first + i)).try_cast("bigint")
    x = cells.select("path", "ord", get(0).alias("start"), get(1).alias("end"), get(2).alias("class"))
    return x.where("start is not null and `end` is not null and class <> 0")


def read_annotators_csv(spark: SparkSession, path: str, annotators: int = 4) -> DataFrame:
    """path, annotator (from 0), ord, start, end, class: one row for each annotator's triplet."""
    cells = numbered_lines(spark, path).select("path", F.col("line").alias("ord"), F.split("text", ",").alias("c"))
    get = lambda a, i: F.get("c", F.lit(3 * a + i)).try_cast("bigint")
    triples = F.array(*(F.struct(F.lit(a).alias("annotator"), get(a, 0).alias("start"), get(a, 1).alias("end"), get(a, 2).alias("class")) for a in range(annotators)))
    return cells.select("path", "ord", F.explode(triples).alias("t")).select("path", "t.annotator", "ord", "t.start", "t.end", "t.class").where("start is not null")


def class_at(intervals: DataFrame, points: DataFrame, t: str) -> DataFrame:
    """The class of each point of a file: that of the last row that covers it (0 without one)."""
    from beatlake.operators.intervals import overlap_pairs

    at = points.select("path", F.col(t), F.col(t).alias("_u")).distinct()
    hit = overlap_pairs(at, intervals.select("path", "start", "end", "ord", "class"), ["path"], (t, "_u"), ("start", "end"), closed=True).where(F.col(t) < F.col("end"))
    best = hit.groupBy("path", t).agg(F.max_by("class", "ord").alias("class"))
    return points.join(best, ["path", t], "left").na.fill(0, ["class"])


# Column names of annotation tables in English and Danish.
STARTS = ("start", "onset", "begin", "anfaldsstart", "starttid", "start_time")
ENDS = ("end", "stop", "offset", "anfaldsslut", "sluttid", "end_time")
DEFAULT_S = 30.0


def normalise_annotations(raw: DataFrame, recording: str = "path") -> DataFrame:
    """recording, start_s, end_s, start_ts, end_ts: numbers count as seconds where more than 80 % of starts are, else as times; a missing end is 30 s later."""
    names = {c.lower().strip(): c for c in raw.columns}
    pick = lambda options: next((names[n] for n in names if n in options or any(o in n for o in options)), None)
    s, e = pick(STARTS), pick(ENDS)
    if s is None:
        raise KeyError(f"no start column in {raw.columns}")
    x = raw.select(F.col(recording), F.col(s).cast("string").alias("_s"), (F.col(e).cast("string") if e else F.lit(None).cast("string")).alias("_e"))
    share = x.groupBy(recording).agg(F.avg(decimal(F.col("_s")).isNotNull().cast("int")).alias("_n"))
    x = x.join(share, recording)
    numeric = F.col("_n") > 0.8
    stamp = lambda c: F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in ("dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"))).cast("timestamp_ntz")
    ss, es, st, et = decimal(F.col("_s")), decimal(F.col("_e")), stamp(F.col("_s")), stamp(F.col("_e"))
    later = F.timestamp_micros(F.unix_micros(st.cast("timestamp")) + int(DEFAULT_S * 1e6)).cast("timestamp_ntz")
    return x.select(
        recording, F.when(numeric, ss).alias("start_s"), F.when(numeric, F.coalesce(es, ss + DEFAULT_S)).alias("end_s"),
        F.when(~numeric, st).alias("start_ts"), F.when(~numeric, F.coalesce(et, later)).alias("end_ts"),
    )


def below_header(rows: DataFrame, first: tuple[str, ...], second: tuple[str, ...], most: int = 10) -> DataFrame:
    """path, line, name, cell of sheets given as rows (path, line from 1, cells): the header is the first of the `most` top rows that holds a token of `first` in one cell and a token of `second` in one; sheets without it give none."""
    has = lambda tokens: F.exists("cells", lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(t.lower()) for t in tokens]))
    head = rows.where((F.col("line") <= most) & F.coalesce(has(first), F.lit(False)) & F.coalesce(has(second), F.lit(False)))
    head = head.groupBy("path").agg(F.min(F.struct("line", "cells")).alias("h")).select("path", F.col("h.line").alias("_line"), F.col("h.cells").alias("_names"))
    x = rows.join(head, "path").where("line > _line").select("path", "line", F.explode(F.arrays_zip(F.col("_names").alias("name"), F.col("cells").alias("cell"))).alias("c"))
    return x.select("path", "line", F.trim("c.name").alias("name"), "c.cell").where("name <> '' and cell is not null")


def annotations_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each annotation source (eeg, clinical) of wide rows with <source>_start and <source>_end."""
    rows = F.array(*(F.struct(F.lit(s).alias("source"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")) for s in ("eeg", "clinical")))
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*").where("start is not null")


def preferred_events(long: DataFrame, keys: list[str], prefer: str = "eeg") -> DataFrame:
    """Of each event the preferred source's row, else the other's."""
    w = W.partitionBy(*keys).orderBy(F.when(F.col("source") == prefer, 0).otherwise(1), "source")
    return long.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def read_table(spark: SparkSession, path: str, ddl: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A CSV or Parquet table with the columns of `ddl`; booleans may be text, rows whose keys are no numbers go."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raw = spark.read.option("header", True).csv(path)
    want = [f for f in spark.createDataFrame([], ddl).schema if f.name in raw.columns]
    cast = lambda f: truthy(F.col(f.name)) if f.dataType.simpleString() == "boolean" else F.col(f.name).try_cast(f.dataType.simpleString())
    x = raw.select(*(cast(f).alias(f.name) for f in want))
    return x.na.drop(subset=list(keys)) if keys else x


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    return S.require_columns(read_table(spark, path, S.RECORDINGS, ("recording_uid", "patient_id")), "recording_uid", "patient_id", "recording_id")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return S.require_columns(read_table(spark, path, S.EVENTS, ("recording_uid",)), "recording_uid", "t0", "t1")


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    from beatlake.operators.quality import acceptable

    return acceptable(S.require_columns(read_table(spark, path, S.WINDOWS, ("recording_uid", "window_idx")), "recording_uid", "window_idx", "win_start_s", "win_end_s"))


def read_rr_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Aligned interval pairs of all files of a folder, with what their names say and the beats' order; other files are passed over."""
    lines = numbered_lines(spark, f"{folder}/*_rr_aligned.csv").withColumn("f", parse_rr_file(F.col("path"))).where("f is not null and line > 1")
    cells = F.split("text", ",")
    x = lines.select("path", "f.*", (F.col("line") - 1).alias("ord"), F.get(cells, F.lit(0)).try_cast("double").alias("rr_labview_s"), F.get(cells, F.lit(1)).try_cast("double").alias("rr_python_s"))
    return x.where("rr_labview_s is not null or rr_python_s is not null")


def manifest(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, folder, extension, bytes and time of change of all files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def recording_index(files: DataFrame) -> DataFrame:
    """recording_uid (from 0 by patient, enrollment, recording, path) and keys of recording files in a manifest."""
    from beatlake.functions.scalars import parse_recording_file

    x = files.select("path", parse_recording_file(F.regexp_extract("path", r"([^/]+)$", 1)).alias("k")).where("k is not null").select("path", "k.*")
    return scan.numbered(x, ["patient_id", F.coalesce("enrollment_id", F.lit("")), "recording_id", "path"], "recording_uid")


def annotation_lookup(recordings: DataFrame, files: DataFrame) -> DataFrame:
    """The annotation file of each recording: its enrollment's before its patient's, .xls before .xlsx before others."""
    f = files.select(F.col("path").alias("annotation_path"), F.regexp_extract("path", r"(?i)p(?:atient)?\s*(\d+)([abc])?[^/]*$", 1).try_cast("bigint").alias("_p"), F.nullif(F.lower(F.regexp_extract("path", r"(?i)p(?:atient)?\s*(\d+)([abc])?[^/]*$", 2)), F.lit("")).alias("_e"), "extension")
    fit = recordings.join(f, (F.col("patient_id") == F.col("_p")) & (F.col("_e").isNull() | F.col("_e").eqNullSafe(F.col("enrollment_id"))), "left")
    rank = F.struct(F.col("_e").isNull().cast("int"), F.when(F.col("extension") == "xls", 0).when(F.col("extension") == "xlsx", 1).otherwise(2), F.col("annotation_path"))
    best = fit.groupBy("recording_uid").agg(F.min_by("annotation_path", rank).alias("annotation_path"))
    return recordings.join(best, "recording_uid", "left")


def read_thresholds(spark: SparkSession, pdf) -> DataFrame:
    """patient_id, thr_modcsi, thr_csi from a small threshold sheet (a pandas frame of an Excel or CSV file)."""
    names = {c.lower(): c for c in pdf.columns}
    find = lambda *tokens: next((names[n] for n in names if all(t in n for t in tokens)), None)
    p, m = find("patient"), find("modcsi")
    c = next((v for k, v in names.items() if "csi" in k and "modcsi" not in k and "threshold" in k), None)
    if p is None or (m is None and c is None):
        raise KeyError(f"no patient or threshold column in {list(pdf.columns)}")
    x = spark.createDataFrame(pdf[[v for v in (p, m, c) if v]].astype(str))
    num = lambda col: F.when(decimal(F.col(f"`{col}`")).between(-1e300, 1e300), decimal(F.col(f"`{col}`"))) if col else F.lit(None).cast("double")
    return x.select(num(p).cast("bigint").alias("patient_id"), num(m).alias("thr_modcsi"), num(c).alias("thr_csi")).where("patient_id is not null")
