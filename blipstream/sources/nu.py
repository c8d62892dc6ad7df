"""Time-of-flight runs: a directory with run.info, integrated.index, autob.index and numbered .integ and .autob files."""

import gzip
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blipstream.operators.scan import neighbours, numbered
from blipstream.plans.stored import stored

#: A record: cycle, segment, acquisition and number of channels, then so many of VALUES.
HEAD = np.dtype([("cycle", "<i4"), ("segment", "<i4"), ("acquisition", "<i4"), ("channels", "<i4")])
VALUES = np.dtype([("centre", "<f4"), ("signal", "<f4"), ("baseline", "<f4"), ("flag", "u1")])
#: A blanking event: cycle, segment, acquisition, two times, its type (0 opens, 1 closes) and its number of edges, each an unsigned integer.
BLANKING = struct.Struct("<5iBi")
#: Ticks of a blanking edge to the time unit of its calibration.
EDGE_TICK = 1.25
#: Values that a batch of points has at most.
BATCH = 1 << 19


def unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def records(content: bytes) -> Iterator[np.ndarray]:
    """The records of a file, plain or gzip, as arrays of those in a row that have equally many channels; a cut last record is left out."""
    data, at = unpacked(content), 0
    while at + HEAD.itemsize <= len(data):
        n = int(np.frombuffer(data, HEAD, 1, at)["channels"][0])
        kind = np.dtype([("head", HEAD), ("values", VALUES, (n,))])
        many = (len(data) - at) // kind.itemsize
        if n < 0 or not many:
            return
        rows = np.frombuffer(data, kind, many, at)
        other = np.flatnonzero(rows["head"]["channels"] != n)
        rows = rows[: other[0]] if len(other) else rows
        yield rows
        at += len(rows) * kind.itemsize


def masses(centres, c0: float, c1: float, delay: float):
    return (c0 + c1 * (0.5 * np.asarray(centres, float) + delay)) ** 2


def json_of(spark: SparkSession, path: str):
    """A small file of settings, or of one entry for each data file, through Spark's reader."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def run_info(spark: SparkSession, path: str) -> dict:
    return json_of(spark, f"{path}/run.info")


def binary_files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """(number, content) of the numbered files; Spark's own reader, so any store that it knows will do, and a file is the unit of work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ending}").load(path)
    return files.select(F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1).try_cast("int").alias("number"), "content").where("number is not null")


POINTS = "sample_id string, channel string, idx int, time_s double, intensity double, mz double"


def point_batches(rows: np.ndarray, idx: np.ndarray, mz: np.ndarray | None, masses_of, area: float, dt: float, sample_id: str) -> Iterator[pa.RecordBatch]:
    """Points of some records: a channel is its place in the record, named mz000 and so on."""
    n = rows["values"].shape[1] if mz is None else min(rows["values"].shape[1], len(mz))
    names = pa.array([f"mz{k:03d}" for k in range(n)])
    for at in range(0, len(rows) if n else 0, max(1, BATCH // n)):
        some, i = rows[at : at + max(1, BATCH // n)], idx[at : at + max(1, BATCH // n)]
        mass = masses_of(some["values"]["centre"][:, :n]) if mz is None else np.broadcast_to(mz[:n], (len(some), n))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(some) * n, sample_id, object), pa.string()),
                names.take(pa.array(np.tile(np.arange(n), len(some)))),
                pa.array(np.repeat(i, n).astype(np.int32)),
                pa.array(np.repeat((i + 1) * dt, n)),
                pa.array((some["values"]["signal"][:, :n].astype(float) / area).reshape(-1)),
                pa.array(np.ascontiguousarray(mass).reshape(-1)),
            ],
            ["sample_id", "channel", "idx", "time_s", "intensity", "mz"],
        )


def read_run(spark: SparkSession, path: str, sample_id: str = "run") -> DataFrame:
    """Points of a run without index files: a point's index is its acquisition, its mass that of its own record; run.info gives MassCalCoefficients, DelayNs, AverageSingleIonArea and DwellTimeS."""
    info = run_info(spark, path)
    c0, c1 = info["MassCalCoefficients"]
    delay, area, dt = info.get("DelayNs", 0.0), info.get("AverageSingleIonArea", 1.0), info["DwellTimeS"]

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for rows in records(content):
                    yield from point_batches(rows, rows["head"]["acquisition"], None, lambda c: masses(c, c0, c1, delay), area, dt, sample_id)

    return binary_files(spark, path, "integ").select("content").mapInArrow(run, POINTS)


@dataclass(frozen=True)
class Run:
    """points (sample_id, channel, idx, time_s, intensity, mz) and blanked (sample_id, channel, start_idx, end_idx), both ends included."""

    points: DataFrame
    blanked: DataFrame


def indexed_run(spark: SparkSession, path: str, sample_id: str = "run") -> Run:
    """SRC9: a run as its index files tell it.

    integrated.index lists the .integ files in order, each with the cycle, segment and acquisition that it begins with; a
    file that is missing or begins otherwise is left out. A point's index counts the records before it in all files kept.
    Counts are signal / AverageSingleIonArea. The mass axis is that of the first record: (c0 + c1 (centre / 2 + delay of
    its segment))**2. The dwell time is a segment's period times all accumulations, to the nanosecond. autob.index lists
    the .autob files: an opening and the next closing event blank the masses between each pair of the opening's edges,
    from the index of the one to that of the other; points aren't changed (see blanked).

    Files are read twice, first to count their records; of each the driver gets that number and the first centres, as it
    has a row of the index for each anyway. Records become Arrow batches without passing through rows of Python.
    """
    info, index = run_info(spark, path), json_of(spark, f"{path}/integrated.index")
    segments = info["SegmentInfo"]
    accumulations, area = info["NumAccumulations1"] * info["NumAccumulations2"], info["AverageSingleIonArea"]
    if not segments or not index or not area > 0:
        raise ValueError(f"no segments, no files or no single-ion area in {path}")
    dt = round(segments[0]["AcquisitionPeriodNs"] * accumulations) * 1e-9
    expected = {e["FileNum"]: (e["FirstCycNum"], e["FirstSegNum"], e["FirstAcqNum"]) for e in index}

    def count(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, first = 0, None
                for rows in records(content):
                    first = rows[0] if first is None else first
                    n += len(rows)
                if first is not None and tuple(first["head"])[:3] == expected.get(number):
                    yield pa.RecordBatch.from_pylist([{"number": number, "n": n, "segment": int(first["head"]["segment"]), "centres": first["values"]["centre"].astype(float).tolist()}], pa.schema([("number", pa.int32()), ("n", pa.int64()), ("segment", pa.int32()), ("centres", pa.list_(pa.float64()))]))

    files = binary_files(spark, path, "integ").where(F.col("number").isin(list(expected)))
    found = {r["number"]: r for r in files.mapInArrow(count, "number int, n long, segment int, centres array<double>").collect()}
    ahead, before = {}, 0
    for e in index:
        if e["FileNum"] in found and e["FileNum"] not in ahead:
            ahead[e["FileNum"]] = before
            before += found[e["FileNum"]]["n"]
    if not ahead:
        raise ValueError(f"no file in {path} is as its index says")
    first = found[next(iter(ahead))]
    delays = [s["AcquisitionTriggerDelayNs"] for s in segments]
    c0, c1 = info["MassCalCoefficients"]
    axis = masses(first["centres"], c0, c1, delays[first["segment"] - 1] if 1 <= first["segment"] <= len(delays) else 0.0)

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = ahead[number]
                for rows in records(content):
                    yield from point_batches(rows, np.arange(at, at + len(rows)), axis, None, area, dt, sample_id)
                    at += len(rows)

    points = files.where(F.col("number").isin(list(ahead))).mapInArrow(run, POINTS)
    return Run(points, blanked_ranges(spark, path, info, axis, accumulations, segments[0]["AcquisitionCount"], sample_id))


def blanking_events(content: bytes) -> list[tuple[int, int, int, list[int]]]:
    """(type, cycle, acquisition, edges) of a file; a cut last event is left out."""
    out, at = [], 0
    while at + BLANKING.size <= len(content):
        cycle, _, acquisition, _, _, kind, n = BLANKING.unpack_from(content, at)
        at += BLANKING.size
        if at + 4 * n > len(content):
            break
        out.append((kind, cycle, acquisition, np.frombuffer(content, "<u4", n, at).astype(np.int64).tolist()))
        at += 4 * n
    return out


def blanked_ranges(spark: SparkSession, path: str, info: dict, axis: np.ndarray, accumulations: int, acquisitions: int, sample_id: str) -> DataFrame:
    """(sample_id, channel, start_idx, end_idx) from the .autob files in the order of autob.index.

    Events alternate: further openings before a closing, and closings without an opening, don't count. They are
    numbered by ranges, and each meets its neighbours by equi-joins.
    """
    order = {e["FileNum"]: k for k, e in reversed(list(enumerate(json_of(spark, f"{path}/autob.index"))))}
    schema = pa.schema([("all", pa.int32()), ("at", pa.int64()), ("nth", pa.int64()), ("kind", pa.int32()), ("t", pa.int64()), ("edges", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = [{"all": 1, "at": order[number], "nth": k, "kind": kind, "t": ((cycle - 1) * acquisitions + acq) // accumulations, "edges": edges} for k, (kind, cycle, acq, edges) in enumerate(blanking_events(unpacked(content)))]
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema)

    files = binary_files(spark, path, "autob").where(F.col("number").isin(list(order)))
    read = files.mapInArrow(run, "all int, at long, nth long, kind int, t long, edges array<long>").where(F.col("kind").isin(0, 1))
    events = stored(numbered(read, [F.col("at"), F.col("nth")], "idx", ["all"]), "blanking")
    changes = neighbours(events, "kind", "__before", -1, ["all"]).where(F.col("__before").isNull() | (F.col("__before") != F.col("kind")))
    turns = stored(numbered(changes.drop("idx", "__before"), [F.col("at"), F.col("nth")], "idx", ["all"]), "blanking-turns")
    pairs = neighbours(turns, "t", "__end", 1, ["all"]).where("kind = 0 and __end is not null")
    start, end = info["BlMassCalStartCoef"], info["BlMassCalEndCoef"]

    def mass(edge, coef):
        x = coef[0] + coef[1] * edge * EDGE_TICK
        return x * x

    windows = pairs.select("t", "__end", F.posexplode("edges").alias("k", "edge"), "edges").where((F.col("k") % 2 == 0) & (F.col("k") + 1 < F.size("edges")))
    windows = windows.select("t", "__end", mass(F.col("edge"), start).alias("lo"), mass(F.get("edges", F.col("k") + 1), end).alias("hi"))
    channels = F.array(*(F.struct(F.lit(f"mz{c:03d}").alias("channel"), F.lit(float(m)).alias("mz")) for c, m in enumerate(axis)))  # of one record
    hit = windows.select("t", "__end", F.explode(F.filter(channels, lambda c: (c["mz"] >= F.col("lo")) & (c["mz"] < F.col("hi")))).alias("c"))
    return hit.select(F.lit(sample_id).alias("sample_id"), F.col("c.channel").alias("channel"), F.col("t").cast("int").alias("start_idx"), F.col("__end").cast("int").alias("end_idx"))


def blanked(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Points outside the ranges (start_idx, end_idx per sample, or per sample and channel), by spread-out equi-join."""
    keys = ["sample_id", *(c for c in ["channel"] if c in ranges.columns)]
    gone = ranges.select(*keys, F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).distinct()
    return points.join(gone, [*keys, "idx"], "left_anti")


def busy_channels(points: DataFrame, limit: float, more_than: int) -> DataFrame:
    """SRC10: channels with more than so many points above max(10, limit)."""
    n = points.groupBy("sample_id", "channel").agg(F.sum((F.col("intensity") > max(10.0, limit)).cast("int")).alias("n"))
    return n.where(F.col("n") > more_than)
