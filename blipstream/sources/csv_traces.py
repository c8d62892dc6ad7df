"""Vendor CSV layouts as points. Lines are read by Spark; only the few header lines decide the layout."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blipstream.functions.parsing import seconds_of_day
from blipstream.operators.scan import neighbours, numbered, running_sum
from blipstream.operators.traces import cps_to_counts, looks_like_counts
from blipstream.plans.stored import stored

POINTS = ["sample_id", "channel", "idx", "time_s", "intensity"]


def below(path: str, file: Column) -> Column:
    """How many folders lie between path and the file; 1 for a file in path, 0 for path itself."""
    return F.size(F.split(F.regexp_replace(F.substring_index(file, path.rstrip("/").rsplit("/", 1)[-1], -1), "/+", "/"), "/")) - 1


def numbered_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", depth: int | None = None, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """SRC13, SRC15: (file, line, text) of every file under path that isn't blank, lines numbered from 0 over all lines of their file.

    ``depth`` limits how far below path a file may lie (1: in path itself); ``keep`` and ``drop`` are endings with their
    dot, as they are written. A file is read in as many tasks as Spark splits it into, whatever its size: a line's number
    is its place in its split plus the lines of the file's splits before, of which there is one row each. Lines are
    written once, as those numbers depend on the order of reading. Texts are decoded by Spark's decode. Encodings whose line ends aren't single bytes (UTF-16,
    UTF-32) and compressed files can't be split: one task a file.
    """
    wide = encoding.upper().replace("_", "-").startswith(("UTF-16", "UTF-32"))
    reader = spark.read.option("recursiveFileLookup", "true")
    raw = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    text = F.regexp_replace(raw, "^\ufeff", "")  # a byte order mark
    name = F.col("_metadata.file_path")
    ending = F.regexp_extract(name, r"(\.[^./]*)$", 1)
    kept = F.lit(True)
    if keep:
        kept = kept & ending.isin(*keep)
    if drop:
        kept = kept & ~ending.isin(*drop)
    if depth is not None:
        kept = kept & (below(path, name) <= depth)
    if wide:
        whole = reader.text(path, wholetext=True).where(kept).select(name.alias("file"), text.alias("value"))
        lines = F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")
        return whole.select("file", F.posexplode(lines).alias("line", "text")).where(F.trim("text") != "")
    rows = reader.text(path).where(kept).select(name.alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__at"), text.alias("text"))
    rows = stored(rows, "lines")
    ahead = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "__split").agg(F.count("*").alias("__n"), F.min("__at").alias("__first")).select("file", "__split", (F.coalesce(F.sum("__n").over(ahead), F.lit(0)) - F.col("__first")).alias("__ahead"))
    placed = rows.where(F.trim("text") != "").join(splits, ["file", "__split"])
    return placed.select("file", (F.col("__at") + F.col("__ahead")).cast("int").alias("line"), "text")


def cells(text: Column, sep: str = ",") -> Column:
    return F.transform(F.split(text, "[" + sep.replace("\t", "\\t") + "]", -1), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))


def long_points(rows: DataFrame, header: DataFrame, time: Column, first: int) -> DataFrame:
    """rows (file, line, cells) and header (file, names) to (file, channel, line, time_s, intensity); value columns start at ``first``."""
    values = rows.join(header, "file").select("file", "line", time.alias("time_s"), "names", F.posexplode(F.slice("cells", first + 1, F.size("cells"))).alias("__k", "__v"))
    return values.select("file", F.element_at("names", (F.col("__k") + first + 1).cast("int")).alias("channel"), "line", "time_s", F.col("__v").try_cast("double").alias("intensity")).where("intensity is not null and channel <> ''")


def indexed(df: DataFrame, sample: Column, *keys: str) -> DataFrame:
    """Points numbered along each channel of a file (or of what keys name), by ranges: no file is one task."""
    by = [*(keys or ("file",)), "channel"]
    at = numbered(df, [F.col("line")], "__nth", by)
    return at.select(sample.alias("sample_id"), "channel", F.col("__nth").cast("int").alias("idx"), "time_s", "intensity", *[c for c in ("over_range",) if c in df.columns])


def file_name(column: str = "file") -> Column:
    return F.regexp_extract(column, r"([^/]+?)(?:\.[^./]*)?$", 1)


CONVERSIONS = ("AUTOMATIC", "CONVERT", "KEEP_AS_IS")


def common_step(at: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, step): the commonest of the first 99 differences of time_s along nth, of equally common ones the first to occur."""
    early = at.where("nth < 100")
    before = early.select(*keys, (F.col("nth") + 1).alias("nth"), F.col("time_s").alias("__before"))
    steps = early.join(before, [*keys, "nth"]).withColumn("__d", F.round(F.col("time_s") - F.col("__before"), 12))
    counted = steps.groupBy(*keys, "__d").agg(F.count("*").alias("__k"), F.min("nth").alias("__first"))
    return counted.groupBy(*keys).agg(F.max_by("__d", F.struct("__k", -F.col("__first"))).alias("step"))


def agilent(spark: SparkSession, path: str, gap_s: float = 5.0, scanned: bool = False, conversion: str = "AUTOMATIC", encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """SRC1: four heading lines (path; unit; batch; names), then data: time and a column for each channel.

    Columns of unequal length are cut to the shortest: a row's valid numbers belong to the channels in order. A pause over
    gap_s starts a new section, a sample of its own; of each only the channels with a positive sum stay. Times of three
    points or more are anew k + 1 times the commonest step; ``scanned`` divides them by the number of channels. Rates become
    counts by that step if the unit says CPS, always (CONVERT) or never (KEEP_AS_IS); without a known unit AUTOMATIC
    converts traces that don't look like counts. A file whose columns and names differ in number has no points.
    """
    if conversion not in CONVERSIONS:
        raise ValueError(f"no conversion {conversion!r}")
    lines = numbered_lines(spark, path, encoding).withColumn("cells", cells(F.col("text"), sep))
    unit = lines.where("line = 1").select("file", F.lower("text").alias("__unit"))
    header = lines.where("line = 3").select("file", F.filter(F.slice("cells", 2, F.size("cells")), lambda c: c != "").alias("names"))
    data = stored(lines.where("line > 3").select("file", "line", "cells"), "agilent")
    stamps = data.select("file", "line", F.try_element_at("cells", F.lit(1)).try_cast("double").alias("time_s")).where("time_s is not null")
    stamps = stored(numbered(stamps, [F.col("line")], "idx", ["file"]), "agilent-times")
    numbers = F.filter(F.transform(F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1))), lambda c: c.try_cast("double")), lambda x: x.isNotNull())
    series = numbered(data.select("file", "line", F.posexplode(numbers).alias("k", "intensity")), [F.col("line")], "idx", ["file", "k"])
    lengths = series.groupBy("file", "k").agg(F.count("*").alias("n")).groupBy("file").agg(F.min("n").alias("__series"), F.count("*").alias("__channels"))
    sizes = stamps.groupBy("file").agg(F.count("*").alias("__n")).join(lengths, "file").join(header, "file").where(F.size("names") == F.col("__channels"))
    sizes = sizes.select("file", F.least("__n", "__series").alias("__n"), "__channels", "names")
    trimmed = stamps.join(sizes.select("file", "__n"), "file").where(F.col("idx") < F.col("__n")).select("file", F.col("idx").cast("long").alias("idx"), "time_s")
    gaps = neighbours(trimmed, "time_s", "__before", -1, ["file"]).withColumn("__new", F.coalesce((F.col("time_s") - F.col("__before") > gap_s).cast("long"), F.lit(0).cast("long")))
    parts = stored(running_sum(gaps, F.col("__new"), "part", ["file"]).select("file", "idx", "time_s", "part"), "agilent-parts")
    starts = parts.groupBy("file", "part").agg(F.min("idx").alias("__start"), F.count("*").alias("__size"))
    at = parts.join(starts, ["file", "part"]).withColumn("nth", F.col("idx") - F.col("__start"))
    step = common_step(at, ["file", "part"])
    time = F.when(F.col("__size") > 2, (F.col("nth") + 1) * F.col("step")).otherwise(F.col("time_s"))
    by = F.when(F.lit(scanned), F.col("__channels")).otherwise(1)
    timed = at.join(step, ["file", "part"], "left").join(sizes.select("file", "__channels"), "file").select("file", "part", "idx", "nth", (time / by).alias("time_s"), (F.col("step") / by).alias("__step"))
    long = series.join(sizes.select("file", "names"), "file").select("file", F.element_at("names", F.col("k") + 1).alias("channel"), "idx", "intensity").join(timed, ["file", "idx"])
    keys = ["file", "part", "channel"]
    live = long.groupBy(*keys).agg(F.sum("intensity").alias("__sum"))
    several = parts.groupBy("file").agg((F.max("part") > 0).alias("__several"))
    long = stored(long.join(live, keys).join(several, "file").where(~F.col("__several") | (F.col("__sum") > 0)), "agilent-long")
    made = long.select(F.concat_ws("#", file_name(), F.col("part").cast("string")).alias("sample_id"), "file", "channel", F.col("nth").cast("int").alias("idx"), "time_s", "intensity", "__step")
    if conversion == "KEEP_AS_IS":
        return made.select(*POINTS)
    rates = F.lit(True)
    if conversion == "AUTOMATIC":
        kinds = looks_like_counts(made)
        made = made.join(unit, "file", "left").join(kinds, ["sample_id", "channel"], "left")
        rates = F.when(F.col("__unit").contains("cps"), True).when(F.col("__unit").rlike("count|cts"), False).otherwise(~F.coalesce("is_counts", F.lit(False)))
    return made.withColumn("intensity", F.when(rates, F.coalesce(F.col("intensity") * F.col("__step"), F.col("intensity"))).otherwise(F.col("intensity"))).select(*POINTS)


def rebuilt_times(long: DataFrame) -> DataFrame:
    """Times of three points or more anew from their index: first stamps of exports are off, and stamps may repeat for want of digits.

    The step is the commonest of the first 99 differences (of equally common ones the smallest), or, where stamps
    repeat, the last stamp over the number of points. long has (file, channel, line, time_s, intensity).
    """
    keys = ["file", "channel"]
    at = numbered(long, [F.col("line")], "__nth", keys)
    s = at.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_distinct("time_s").alias("__distinct"), F.max_by("time_s", "line").alias("__last"))
    before = at.where("__nth < 99").select(*keys, (F.col("__nth") + 1).alias("__nth"), F.col("time_s").alias("__before"))
    steps = at.where("__nth < 100").join(before, [*keys, "__nth"]).withColumn("__d", F.round(F.col("time_s") - F.col("__before"), 12))
    common = steps.groupBy(*keys, "__d").agg(F.count("*").alias("__k")).groupBy(*keys).agg(F.max_by("__d", F.struct("__k", -F.col("__d"))).alias("__mode"))
    joined = at.join(s, keys).join(common, keys, "left")
    dt = F.when(F.col("__distinct") == F.col("__n"), F.col("__mode")).otherwise(F.col("__last") / F.col("__n"))
    return joined.withColumn("time_s", F.when(F.col("__n") > 2, (F.col("__nth") + 1) * dt).otherwise(F.col("time_s"))).select(*long.columns)


def thermo_xy(spark: SparkSession, path: str, rebuild: bool = True) -> DataFrame:
    """SRC2: the layouts of the XY export, told apart by their first 200 lines; points also have dwell_s (null where the file doesn't say).

    A first line ``sep=`` names the separator, else it is a semicolon if the heading has one, else a comma. The heading
    is the first line with a cell that begins with Time; the time column is that cell's, wherever it stands, and Number
    columns aren't values. Names lose an ``Intensity (..)`` before them. A line below the heading that says
    ``dwell time=`` gives the dwell time of each column. Without a heading the first column is the time. Times are
    decimals or HH:mm:ss, and rebuilt from the index (see rebuilt_times) unless ``rebuild`` is false. A file without
    any point raises, as far as one can tell from the whole: an empty result is never silent.
    """
    lines = numbered_lines(spark, path)
    early = lines.where("line < 200")
    timed = F.regexp_like(F.lower("text"), F.lit(r"(^|[,;\t])\"?time"))
    facts = early.groupBy("file").agg(
        F.max(F.when(F.col("line") == 0, F.regexp_extract("text", r"^sep=(.)", 1))).alias("__sep"),
        F.min_by("text", F.when(timed, F.col("line"))).alias("__head_text"),
        F.min(F.when(timed, F.col("line"))).alias("head"),
        F.min_by("text", "line").alias("__first"),
    )
    facts = facts.withColumn("sep", F.when(F.col("__sep") != "", F.col("__sep")).when(F.coalesce("__head_text", "__first").contains(";"), ";").otherwise(","))
    parted = lines.join(facts.select("file", "head", "sep"), "file").withColumn(
        "cells", F.transform(F.split("text", F.concat(F.lit("\\Q"), F.col("sep"), F.lit("\\E")), -1), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    )
    plain = F.transform("cells", lambda c, i: F.when(i == 0, F.lit("Time")).otherwise(F.concat(F.lit("ch"), i.cast("string"))))
    heads = parted.where("line = head").select("file", F.col("cells").alias("names")).unionByName(
        parted.where("head is null").groupBy("file").agg(F.min_by(plain, "line").alias("names"))
    )
    is_time = F.transform("names", lambda c: F.lower(c).startswith("time"))
    heads = heads.withColumn("time_at", F.array_position(is_time, True).cast("int"))
    dwell = parted.where((F.col("line") > F.col("head")) & (F.col("line") < 200) & F.col("text").contains("dwell time=")).groupBy("file").agg(
        F.min_by(F.transform("cells", lambda c: F.regexp_extract(c, r"dwell time=([0-9.eE+-]+)", 1).try_cast("double")), "line").alias("dwells")
    )
    data = parted.where(F.col("head").isNull() | (F.col("line") > F.col("head"))).join(heads, "file").join(dwell, "file", "left")
    raw = F.try_element_at("cells", F.col("time_at"))
    stamped = data.withColumn("time_s", F.when(raw.contains(":"), seconds_of_day(raw)).otherwise(raw.try_cast("double"))).where("time_s is not null")
    cell = stamped.select("file", "line", "time_s", "names", "dwells", F.posexplode("cells").alias("__k", "__v"))
    name = F.try_element_at("names", F.col("__k") + 1)
    named = cell.withColumn("__name", name).where(~F.lower("__name").startswith("time") & (F.lower("__name") != "number") & (F.col("__name") != ""))
    long = named.select(
        "file", F.trim(F.regexp_replace("__name", r"(?i)^intensity\s*(\([^)]*\))?", "")).alias("channel"), "line", "time_s", F.col("__v").try_cast("double").alias("intensity"), F.try_element_at("dwells", F.col("__k") + 1).alias("dwell_s")
    ).where("intensity is not null")
    out = stored(rebuilt_times(long) if rebuild else long, "thermo")
    if out.isEmpty():
        raise ValueError(f"no points in {path}: not a known layout, or another separator")
    at = numbered(out, [F.col("line")], "idx", ["file", "channel"])
    return at.select(file_name().alias("sample_id"), "channel", F.col("idx").cast("int").alias("idx"), "time_s", "intensity", "dwell_s")


def thermo_top_down(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: rows named Time, Counter or Y, samples across; a negative counter flags over-range."""
    lines = numbered_lines(spark, path).withColumn("cells", cells(F.col("text")))
    kinds = lines.withColumn("kind", F.lower(F.element_at("cells", 2))).where(F.col("kind").isin("time", "counter", "y")).withColumn("channel", F.element_at("cells", 1))
    nth = numbered(kinds, [F.col("line")], "nth", ["file", "channel", "kind"])
    flat = nth.select("file", "channel", "nth", "kind", F.posexplode(F.slice("cells", 3, F.size("cells"))).alias("at", "v")).withColumn("v", F.col("v").try_cast("double"))
    wide = flat.groupBy("file", "at", "channel", "nth").agg(*[F.max(F.when(F.col("kind") == k, F.col("v"))).alias(n) for k, n in (("time", "time_s"), ("counter", "counter"), ("y", "intensity"))])
    over = F.coalesce(F.col("counter") < 0, F.lit(False))
    long = wide.where("intensity is not null").select("file", "at", "channel", F.col("nth").alias("line"), "time_s", "intensity", over.alias("over_range"))
    return indexed(long, F.concat_ws("#", file_name(), F.col("at").cast("string")), "file", "at")


def analytik_jena(spark: SparkSession, path: str, trigger: float | None = None, counts: bool = False, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """SRC4: blocks start at a line with a cell that says Processed; the sample's name stands one line below, the channels' names two.

    The time is in the column headed Time, else in the second, and is divided by the number of channels; values follow it.
    ``trigger`` flags values as over_range: those at least as large if it is positive, at most as small if negative.
    ``counts`` turns the rates, which these files hold, into counts; flags are those of the rates. Numbers of points along
    a trace count valid values only.
    """
    lines = numbered_lines(spark, path, encoding).withColumn("cells", cells(F.col("text"), sep))
    marked = lines.withColumn("__starts", F.exists("cells", lambda c: c.contains("Processed")).cast("long"))
    blocks = running_sum(numbered(marked, [F.col("line")], "idx", ["file"]), F.col("__starts"), "block", ["file"]).where("block > 0")
    first = blocks.where("__starts = 1").select("file", "block", F.col("idx").alias("__first"))
    placed = stored(blocks.join(first, ["file", "block"]).withColumn("at", F.col("idx") - F.col("__first")).select("file", "block", "line", "at", "cells"), "jena")
    names = placed.where("at = 1").select("file", "block", F.element_at("cells", 1).alias("sample_id"))
    timed = F.array_position(F.transform("cells", lambda c: F.lower(c).startswith("time")), True).cast("int")
    header = placed.where("at = 2").select("file", "block", F.when(timed > 0, timed).otherwise(2).alias("__time"), F.col("cells").alias("__names"))
    header = header.select("file", "block", "__time", F.slice("__names", F.col("__time") + 1, F.size("__names")).alias("names"))
    rows = placed.where("at > 2").join(header, ["file", "block"]).join(names, ["file", "block"])
    t = F.try_element_at("cells", F.col("__time")).try_cast("double") / F.size(F.filter("names", lambda c: c != ""))
    values = F.slice("cells", F.col("__time") + 1, F.greatest(F.size("cells"), F.lit(1)))
    long = rows.select("file", "block", "sample_id", "line", t.alias("time_s"), "names", F.posexplode(values).alias("k", "v")).where("time_s is not null")
    over = F.lit(False) if not trigger else F.col("intensity") >= trigger if trigger > 0 else F.col("intensity") <= trigger
    long = long.select("file", "block", "sample_id", "line", "time_s", F.try_element_at("names", F.col("k") + 1).alias("channel"), F.col("v").try_cast("double").alias("intensity")).where("intensity is not null and channel <> ''").withColumn("over_range", over)
    points = indexed(long, F.col("sample_id"), "file", "block", "sample_id")
    if not counts:
        return points
    return cps_to_counts(points).withColumn("intensity", F.coalesce("counts", "intensity")).drop("counts")


def custom_points(spark: SparkSession, path: str, first_line: int = 0, dwell_s: float | None = None, sep: str = ",") -> DataFrame:
    """SRC5: names in first_line; the first column is time, or every column is a channel if a dwell time is given."""
    lines = numbered_lines(spark, path).withColumn("cells", cells(F.col("text"), sep))
    header = lines.where(F.col("line") == first_line).select("file", F.col("cells").alias("names"))
    rows = lines.where(F.col("line") > first_line)
    time = (F.col("line") - first_line) * F.lit(dwell_s) if dwell_s else F.element_at("cells", 1).try_cast("double")
    return indexed(long_points(rows, header, time, 0 if dwell_s else 1), file_name())


def custom_peaks(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: five numeric columns; rows that aren't numbers (headings) are skipped."""
    schema = "center_time_s double, area double, height double, duration_us double, n_points double"
    return spark.read.csv(path, schema=schema, mode="PERMISSIVE").where("area is not null").withColumn("population_id", F.lit("EXTERNAL"))


def lpc(spark: SparkSession, path: str, target: str) -> DataFrame:
    """SRC7: image-particle tables whose first heading is 'particle id' or 'id'; one column is the target."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = {c.strip().lower(): c for c in raw.columns}
    if not raw.columns or raw.columns[0].strip().lower() not in ("particle id", "id") or len(raw.columns) < 14:
        raise ValueError("not a light-particle-counter table")
    return raw.select(F.col(f"`{raw.columns[0]}`").alias("particle"), F.col(f"`{names[target.lower()]}`").try_cast("double").alias("target"), F.struct(*[F.col(f"`{c}`").try_cast("double").alias(c.strip()) for c in raw.columns[1:]]).alias("all"))


def mzmine(spark: SparkSession, path: str, subtract_floor: bool = False) -> DataFrame:
    """SRC8: minutes, then channels named before '('; optionally min(own least non-zero, commonest least) + 1 is taken off, clamped at 0."""
    lines = numbered_lines(spark, path).withColumn("cells", cells(F.col("text")))
    header = lines.where("line = 0").select("file", F.transform("cells", lambda c: F.trim(F.split(c, r"\(")[0])).alias("names"))
    points = indexed(long_points(lines.where("line > 0"), header, F.element_at("cells", 1).try_cast("double") * 60, 1), file_name())
    if not subtract_floor:
        return points
    least = points.where("intensity > 0").groupBy("sample_id", "channel").agg(F.min("intensity").alias("least"))
    common = least.groupBy("sample_id").agg(F.mode("least", True).alias("common"))
    floor = least.join(common, "sample_id").select("sample_id", "channel", (F.least("least", "common") + 1).alias("floor"))
    return points.join(floor, ["sample_id", "channel"], "left").withColumn("intensity", F.greatest(F.lit(0.0), F.col("intensity") - F.coalesce("floor", F.lit(0.0)))).drop("floor")


def merge_columns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC17: files side by side by line number; short ones are padded with empty cells."""
    out = None
    for k, path in enumerate(paths):
        part = numbered_lines(spark, path).select("line", F.col("text").alias(f"f{k}"))
        out = part if out is None else out.join(part, "line", "full")
    return out.select("line", F.concat_ws(",", *[F.coalesce(f"f{k}", F.lit("")) for k in range(len(paths))]).alias("text"))
