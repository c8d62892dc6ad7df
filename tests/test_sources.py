"""Every file layout from small files, the time-of-flight reader, sinks and streaming."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from blipstream.sources import csv_traces as src
from blipstream.sources import nu, sinks
from blipstream.streaming.live import live_average, live_events


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_agilent_splits_at_pauses_and_counts(spark, tmp_path):
    body = "".join(f"{t:.1f},{y},{2 * y}\n" for t, y in [(0.1, 10), (0.2, 20), (0.3, 30), (9.0, 40), (9.1, 50)])
    p = put(tmp_path / "a.csv", "C:\\run\\a.d\nIntensity Vs Time,CPS\nbatch\nTime [Sec],Ag107,Au197\n" + body)
    got = rows(src.agilent(spark, p), "sample_id", "channel", "idx", "intensity")
    assert len(got) == 10 and ("a#0", "Ag107", 2, pytest.approx(3.0)) in got and ("a#1", "Au197", 1, pytest.approx(10.0)) in got


def test_thermo_layouts(spark, tmp_path):
    a = put(tmp_path / "named.csv", "some,metadata\nTime,Ag107,Au197\n0.1,1,2\n0.2,3,4\n")
    b = put(tmp_path / "clock.csv", "Time,Au197\n00:00:01.5,7\n00:01:00,8\n")
    c = put(tmp_path / "bare.csv", "0.1,5\n0.2,6\n")
    assert rows(src.thermo_xy(spark, a), "channel", "idx", "time_s", "intensity") == [("Ag107", 0, 0.1, 1.0), ("Ag107", 1, 0.2, 3.0), ("Au197", 0, 0.1, 2.0), ("Au197", 1, 0.2, 4.0)]
    assert rows(src.thermo_xy(spark, b), "time_s", "intensity") == [(1.5, 7.0), (60.0, 8.0)]
    assert rows(src.thermo_xy(spark, c), "channel", "time_s", "intensity") == [("ch1", 0.1, 5.0), ("ch1", 0.2, 6.0)]
    live = put(tmp_path / "live.csv", "sep=,\nNumber,Time 197Au,Intensity (cps) 197Au\n1,00:00:05.38,0\n2,00:00:05.39,7\n")
    assert rows(src.thermo_xy(spark, live), "channel", "time_s", "intensity") == [("197Au", pytest.approx(5.38), 0.0), ("197Au", pytest.approx(5.39), 7.0)]
    semi = put(tmp_path / "semi.csv", "sep=;\nNumber;Time 197Au;197Au\n" + "".join(f"{i};{0.003 + 0.001 * (i // 2):.3f};{10 * i}\n" for i in range(1, 7)))
    assert rows(src.thermo_xy(spark, semi, rebuild=False), "channel", "time_s", "intensity")[0] == ("197Au", 0.003, 10.0)
    assert rows(src.thermo_xy(spark, semi), "time_s", "intensity") == [(pytest.approx(0.001 * i), 10.0 * i) for i in range(1, 7)]
    bare = put(tmp_path / "bare2.csv", "".join(f"{t};{y}\n" for t, y in [(0.5, 1), (0.6, 2), (0.7, 3), (0.8, 4)]))
    assert rows(src.thermo_xy(spark, bare), "channel", "time_s", "intensity") == [("ch1", pytest.approx(0.1 * y), float(y)) for y in range(1, 5)]
    tq = put(tmp_path / "tq.csv", "sep=;\nNumber;Time 28Si16O;28Si16O\n1;0;10003.2\n2;0;20012.8\n")
    assert rows(src.thermo_xy(spark, tq), "channel", "intensity") == [("28Si16O", 10003.2), ("28Si16O", 20012.8)]
    laser = put(tmp_path / "laser.csv", "Run:12/08/2021 12:28:53 PM;\nSoftware:Name=x;Version=2;\n\nTime,24Mg | 24Mg,56Fe | 56Fe.16O,\n,dwell time=0.1;xcal factor=7,dwell time=0.2;xcal factor=8,\n0.11,264029.3,40284.8,\n1.09,259189.6,39131.2,\n")
    assert rows(src.thermo_xy(spark, laser), "channel", "time_s", "dwell_s") == [("24Mg | 24Mg", 0.11, 0.1), ("24Mg | 24Mg", 1.09, 0.1), ("56Fe | 56Fe.16O", 0.11, 0.2), ("56Fe | 56Fe.16O", 1.09, 0.2)]
    with pytest.raises(ValueError, match="no points"):
        src.thermo_xy(spark, put(tmp_path / "none.csv", "only;words\nin;here\n"))
    t = put(tmp_path / "down.csv", "Au197,Time,0.1,0.1\nAu197,Counter,5,-1\nAu197,Y,9,8\n")
    assert rows(src.thermo_top_down(spark, t), "sample_id", "intensity", "over_range") == [("down#0", 9.0, False), ("down#1", 8.0, True)]


def test_other_csv_layouts(spark, tmp_path):
    j = put(tmp_path / "j.csv", "Processed x\nfirst\nTime,A,B\n2.0,1,2\nProcessed y\nsecond\nTime,A,B\n4.0,3,4\n")
    assert rows(src.analytik_jena(spark, j), "sample_id", "channel", "time_s", "intensity") == [("first", "A", 1.0, 1.0), ("first", "B", 1.0, 2.0), ("second", "A", 2.0, 3.0), ("second", "B", 2.0, 4.0)]
    c = put(tmp_path / "c.csv", "t;x\n0.5;3\n")
    assert rows(src.custom_points(spark, c, sep=";"), "channel", "time_s", "intensity") == [("x", 0.5, 3.0)]
    assert rows(src.custom_points(spark, c, dwell_s=0.1, sep=";"), "channel", "intensity") == [("t", 0.5), ("x", 3.0)]
    k = put(tmp_path / "k.csv", "peak,area,height,duration,points\n1.0,5,3,20,4\n")
    assert rows(src.custom_peaks(spark, k), "center_time_s", "area", "population_id") == [(1.0, 5.0, "EXTERNAL")]
    m = put(tmp_path / "m.csv", "time,100.5 (a),200 (b)\n1,5,0\n2,9,4\n")
    assert rows(src.mzmine(spark, m), "channel", "time_s", "intensity")[0] == ("100.5", 60.0, 5.0)
    assert rows(src.mzmine(spark, m, True), "channel", "intensity") == [("100.5", 0.0), ("100.5", 4.0), ("200", 0.0), ("200", 0.0)]
    names = ",".join(["Particle ID", *(f"v{i}" for i in range(13)), "Diameter"])
    lpc = put(tmp_path / "l.csv", names + "\n" + ",".join(map(str, range(15))) + "\n")
    assert src.lpc(spark, lpc, "diameter").first().target == 14.0
    assert [r.text for r in src.merge_columns(spark, [c, k]).orderBy("line").collect()] == ["t;x,peak,area,height,duration,points", "0.5;3,1.0,5,3,20,4"]


def test_unequal_columns_scans_and_units(spark, tmp_path):
    head = "C:\\run\\b.d\nIntensity Vs Time,{}\nbatch\nTime [Sec],Ag107,Au197\n"
    lines = [(0.1, "1", "5"), (0.2, "2", ""), (0.3, "3", "7"), (0.3, "4", "8"), (20.0, "0", "9"), (20.1, "0", "9"), (20.2, "0", "9")]
    body = "".join(f"{t},{a},{b}\n" for t, a, b in lines)
    got = rows(src.agilent(spark, put(tmp_path / "u.csv", head.format("CPS") + body), conversion="KEEP_AS_IS"), "sample_id", "channel", "idx", "time_s", "intensity")
    # Au197 has six values, so all is cut to six rows; the value that is missing lets the later ones move up. A second section keeps Au197 alone.
    assert got == [("u#0", "Ag107", i, pytest.approx(0.1 * (i + 1)), float(i + 1)) for i in range(4)] + [("u#0", "Au197", i, pytest.approx(0.1 * (i + 1)), v) for i, v in enumerate((5.0, 7.0, 8.0, 9.0))] + [
        ("u#1", "Au197", i, pytest.approx(20.0 + 0.1 * i), 9.0) for i in range(2)
    ]
    even = "".join(f"{0.1 * i:.1f},{i},{2 * i}\n" for i in range(1, 5))
    scan = rows(src.agilent(spark, put(tmp_path / "s.csv", head.format("CPS") + even), scanned=True), "channel", "time_s", "intensity")
    assert scan[0] == ("Ag107", pytest.approx(0.05), pytest.approx(0.05)) and scan[-1] == ("Au197", pytest.approx(0.2), pytest.approx(0.4))
    assert rows(src.agilent(spark, put(tmp_path / "c.csv", head.format("Counts") + even)), "channel", "intensity")[3] == ("Ag107", 4.0)
    assert rows(src.agilent(spark, put(tmp_path / "n.csv", head.format("?") + even), conversion="CONVERT"), "channel", "intensity")[3] == ("Ag107", pytest.approx(0.4))
    assert src.agilent(spark, put(tmp_path / "m.csv", head.format("CPS").replace(",Au197", "") + even)).count() == 0
    with pytest.raises(ValueError):
        src.agilent(spark, str(tmp_path), conversion="MAYBE")


def test_scan_blocks_with_flags_and_counts(spark, tmp_path):
    block = "x,Processed data,,\n{},,,\n,,Ag107,Au197\n" + "".join(f"{i},{0.2 * i:.1f},{10 * i},{100 * i}\n" for i in range(1, 5))
    p = put(tmp_path / "j.csv", block.format("one") + block.format("two") + "bad,0.9,n/a,5\n")
    got = rows(src.analytik_jena(spark, p, trigger=300.0), "sample_id", "channel", "idx", "time_s", "intensity", "over_range")
    assert got[:2] == [("one", "Ag107", 0, pytest.approx(0.1), 10.0, False), ("one", "Ag107", 1, pytest.approx(0.2), 20.0, False)]
    assert [r[2] for r in got if r[5]] == [2, 3, 2, 3] and len(got) == 17 and got[-1][:3] == ("two", "Au197", 4)
    counts = rows(src.analytik_jena(spark, p, trigger=300.0, counts=True), "sample_id", "channel", "idx", "intensity", "over_range")
    assert counts[3] == ("one", "Ag107", 3, pytest.approx(4.0), False) and counts[7] == ("one", "Au197", 3, pytest.approx(40.0), True)
    assert {r.over_range for r in src.analytik_jena(spark, p, trigger=-1.0).collect()} == {False}
    wide = "Processed\nw\n,Time," + ",".join(f"m{i}" for i in range(120)) + "\n0,1.2," + ",".join(map(str, range(120))) + "\n"
    assert src.analytik_jena(spark, put(tmp_path / "w.csv", wide)).count() == 120


def test_lines_of_split_files(spark, tmp_path):
    """A file of many splits gives the lines, and a layout the points, that reading it in one piece gives."""
    text = "".join("\n" if i % 7 == 3 else f"{0.1 * i:.1f},{i}\n" if i else "Time,Ag107\n" for i in range(3000))
    (tmp_path / "a" / "b").mkdir(parents=True)
    p = put(tmp_path / "a" / "long.csv", text)
    put(tmp_path / "a" / "b" / "deep.csv", "0.5,1\r\n\r\n0.6,2\r\n")
    put(tmp_path / "a" / "notes.txt", "no,points\n")
    whole = {(r.file, r.line): r.text for r in src.numbered_lines(spark, p).collect()}
    assert len(whole) == sum(1 for i in range(3000) if i % 7 != 3) and {t for (_, k), t in whole.items() if k == 2998} == {"299.8,2998"}
    points = rows(src.custom_points(spark, p), "channel", "idx", "time_s", "intensity")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
        assert spark.read.text(p).rdd.getNumPartitions() > 10
        assert {(r.file, r.line): r.text for r in src.numbered_lines(spark, p).collect()} == whole
        assert rows(src.custom_points(spark, p), "channel", "idx", "time_s", "intensity") == points
        every = src.numbered_lines(spark, str(tmp_path / "a"))
        assert {r[0].rsplit("/", 1)[1] for r in every.select("file").distinct().collect()} == {"long.csv", "deep.csv", "notes.txt"}
        assert [(r.line, r.text) for r in every.where("file like '%deep.csv'").orderBy("line").collect()] == [(0, "0.5,1"), (2, "0.6,2")]
        for found, names in ((dict(depth=1), {"long.csv", "notes.txt"}), (dict(keep=[".csv"]), {"long.csv", "deep.csv"}), (dict(drop=[".csv"]), {"notes.txt"}), (dict(depth=1, keep=[".csv"]), {"long.csv"})):
            assert {r[0].rsplit("/", 1)[1] for r in src.numbered_lines(spark, str(tmp_path / "a"), **found).select("file").distinct().collect()} == names
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "latin.csv").write_bytes("µ,é\n1,2\n".encode("latin-1"))
    (tmp_path / "wide.csv").write_bytes("µ,é\n\n1,2\n".encode("utf-16"))
    assert src.numbered_lines(spark, str(tmp_path / "latin.csv"), "ISO-8859-1").orderBy("line").first().text == "µ,é"
    assert [(r.line, r.text) for r in src.numbered_lines(spark, str(tmp_path / "wide.csv"), "UTF-16").orderBy("line").collect()] == [(0, "µ,é"), (2, "1,2")]


def test_time_of_flight_run(spark, tmp_path):
    d = tmp_path / "run"
    d.mkdir()
    (d / "run.info").write_text(json.dumps({"MassCalCoefficients": [1.0, 0.5], "DelayNs": 2.0, "AverageSingleIonArea": 2.0, "DwellTimeS": 0.1}))
    for k in range(2):
        record = struct.pack("<4i", 0, 0, k, 2) + b"".join(struct.pack("<fffB", c, s, 0.0, 0) for c, s in ((4.0, 6.0), (8.0, 2.0 * k)))
        (d / f"{k}.integ").write_bytes(gzip.compress(record) if k else record)
    got = rows(nu.read_run(spark, str(d)), "channel", "idx", "time_s", "intensity", "mz")
    assert got == [("mz000", 0, 0.1, 3.0, 9.0), ("mz000", 1, 0.2, 3.0, 9.0), ("mz001", 0, 0.1, 0.0, 16.0), ("mz001", 1, 0.2, 1.0, 16.0)]
    p = nu.read_run(spark, str(d))
    assert nu.blanked(p, spark.createDataFrame([("run", 0, 0)], "sample_id string, start_idx int, end_idx int")).count() == 2
    assert nu.busy_channels(p.withColumn("intensity", F.col("intensity") * 10), 0.0, 1).count() == 1


def test_run_by_its_index(spark, tmp_path):
    d = tmp_path / "run"
    d.mkdir()
    segments = [{"Num": 1, "AcquisitionPeriodNs": 25_000.0, "AcquisitionTriggerDelayNs": 4.0, "AcquisitionCount": 10}]
    coefs = {"MassCalCoefficients": [0.0, 1.0], "BlMassCalStartCoef": [-0.1, 0.8], "BlMassCalEndCoef": [-0.1, 0.8]}
    (d / "run.info").write_text(json.dumps({**coefs, "NumAccumulations1": 2, "NumAccumulations2": 1, "AverageSingleIonArea": 2.0, "SegmentInfo": segments}))
    centres = [2.0, 4.0, 6.0]  # masses 25, 36, 49

    def record(cycle, acq, signals):
        return struct.pack("<4i", cycle, 1, acq, len(signals)) + b"".join(struct.pack("<fffB", c, s, 0.0, 0) for c, s in zip(centres, signals, strict=False))

    files = {7: [record(1, 2 * k, [k, 2 * k, 3 * k]) for k in range(1, 4)], 3: [record(1, 8, [8, 8, 8]), record(2, 0, [9, 9]), record(2, 2, [10, 10, 10])], 4: [record(9, 9, [1, 1, 1])], 5: [record(2, 4, [11, 11, 11])]}
    for n, made in files.items():
        content = b"".join(made) + (b"\x01\x02" if n == 7 else b"")  # the end of one is cut
        (d / f"{n}.integ").write_bytes(gzip.compress(content) if n == 3 else content)
    index = [(7, 1, 1, 2), (3, 1, 1, 8), (4, 1, 1, 0), (8, 1, 1, 0), (5, 2, 1, 4)]  # 4 begins otherwise, 8 is missing
    (d / "integrated.index").write_text(json.dumps([dict(zip(("FileNum", "FirstCycNum", "FirstSegNum", "FirstAcqNum"), e, strict=True)) for e in index]))

    def event(kind, cycle, acq, edges):
        return struct.pack("<5iBi", cycle, 1, acq, 0, 0, kind, len(edges)) + struct.pack(f"<{len(edges)}I", *edges)

    # Edges less 0.1 are square roots of masses here. A closing at first, an opening within an opening, and a cut event don't count.
    (d / "2.autob").write_bytes(event(1, 1, 0, []) + event(0, 1, 4, [5, 6, 7, 8]) + event(0, 1, 6, [5, 8]))
    (d / "1.autob").write_bytes(event(1, 2, 1, []) + event(0, 2, 2, [7, 5]) + event(1, 2, 4, []) + event(0, 3, 0, [5, 6])[:-2])
    (d / "autob.index").write_text(json.dumps([{"FileNum": 2}, {"FileNum": 1}]))
    run = nu.indexed_run(spark, str(d))
    got = rows(run.points, "channel", "idx", "time_s", "intensity", "mz")
    signals = [[1, 2, 3], [2, 4, 6], [3, 6, 9], [8, 8, 8], [9, 9], [10, 10, 10], [11, 11, 11]]
    assert got == sorted((f"mz{c:03d}", i, pytest.approx(5e-5 * (i + 1)), s / 2, [25.0, 36.0, 49.0][c]) for i, of in enumerate(signals) for c, s in enumerate(of))
    assert rows(run.blanked, "sample_id", "channel", "start_idx", "end_idx") == [("run", "mz000", 2, 5), ("run", "mz002", 2, 5)]
    left = nu.blanked(run.points, run.blanked)
    assert left.count() == len(got) - 4 - 3 and left.where("channel = 'mz001'").count() == 7
    (d / "integrated.index").write_text("[]")
    with pytest.raises(ValueError):
        nu.indexed_run(spark, str(d))


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([("s", "a", 0, 1.0), ("s", "b", 0, 2.0)], "sample_id string, channel string, idx int, intensity double")
    assert sinks.raw_table(p, ["a", "b"]).collect()[0][2:] == (1.0, 2.0)
    sinks.write_csv(p, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    assert sinks.side_by_side(p, "channel", ["a", "b"], ["intensity"], "idx").columns[0] == "row"


def test_streaming(spark, tmp_path):
    ys = [0.0, 5.0, 6.0, 1.0, 0.0, 7.0, 0.0]
    made = spark.createDataFrame([("s", "a", i, y) for i, y in enumerate(ys)], "sample_id string, channel string, idx int, intensity double").withColumn("ts", F.timestamp_seconds(F.col("idx")))
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    q = live_events(stream, 4.0, 1.0, 4.5).writeStream.format("memory").queryName("runs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("runs"), "start_idx", "end_idx", "height") == [(1, 3, 6.0), (5, 5, 7.0)]
    q = live_average(stream, "2 seconds").writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").agg(F.sum("n")).first()[0] == 7
