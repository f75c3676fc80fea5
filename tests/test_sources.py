"""Files in and out: logs, configs, playlists, fleet config, catalog, media bytes."""

import json
import struct
from pathlib import Path

from pyspark.sql import functions as F

from liveops.operators import catalog, fleet
from liveops.sources import logs, media_files, playlists, slices


def test_server_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2024-01-02 03:04:05 :  RECEIVE_CB      : _ERROR_  : no : data\n"
        "2024-01-02 03:04:05 :  RECEIVE_CB      : _ERROR_  : errno = 32 (Broken pipe)\n"
        "2024-01-02 03:04:06 :  ToWrite         : _HAPPY_  : ok\n"
        "odd line\n"
    )
    rows = logs.server(spark, str(tmp_path)).drop("file").collect()
    assert [r.msg for r in rows] == ["no : data", "errno = 32 (Broken pipe)", "ok", "odd line"]
    assert [r.errno for r in rows] == [None, 32, None, None]
    assert rows[3].ts is None and rows[0].module == "RECEIVE_CB"
    kept = logs.at_most(logs.server(spark, str(tmp_path)), "_PEACE_", logs.FILE_LEVELS)
    assert kept.count() == 0


def test_access_log(spark, tmp_path):
    (tmp_path / "access.log").write_text(
        '[02/Jan/2024:03:04:05 +0800] 0.012 10.1.1.1 200 345 POST http://h/a?b=1  - "curl" "-" '
        '"{\\x22a\\x22:1}"\nbroken\n'
    )
    row = sorted(logs.access(spark, str(tmp_path)).collect(), key=lambda r: r.rejected or "")
    assert len(row) == 2 and row[1].rejected == "broken" and row[1].status is row[1].url is None
    assert row[0].rejected is None and row[0].status == 200 and row[0].url == "http://h/a?b=1"
    assert str(row[0].time) and row[0].agent == "curl" and row[0].request_time == 0.012


def test_ini(spark, tmp_path):
    (tmp_path / "one.conf").write_text("#c\n[server]\nport = 80\n\nport=81\n[media]\nport=9\n")
    (tmp_path / "two.conf").write_text("lonely=1\n")
    rows = logs.ini_inventory(spark, str(tmp_path)).collect()
    assert {(r.section, r.key, r.value) for r in rows} == {
        ("server", "port", "80"), ("media", "port", "9"), (None, "lonely", "1"),
    }


def test_playlists(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.m3u8").write_text(
        "#EXTM3U\n#EXT-X-TARGETDURATION:12\n#EXTINF:10.5,\na.ts\n#EXTINF:9,\n#EXT-X-KEY\n"
        "#EXTINF:8,\nb.ts\n#EXT-X-ENDLIST\n"
    )
    rows = playlists.read(spark, str(tmp_path / "in"), "cdn").orderBy("pos").collect()
    assert [(r.pos, r.duration, r.url, r.target) for r in rows] == [
        (0, 10.5, "http://cdn/a.ts", 12), (1, 8.0, "http://cdn/b.ts", 12),
    ]
    out = str(tmp_path / "out")
    first = spark.createDataFrame(
        [("x", 1, ["1.ts"], 1), ("x", 5, ["3.ts", "4.ts", "5.ts"], 3), ("y", 1, ["q.ts"], 1)],
        "channel string, seq bigint, urls array<string>, media_sequence bigint",
    )
    playlists.write(first, out)
    playlists.write(first.where("channel = 'y'").withColumn("seq", F.lit(9)), out)
    texts = {r.channel: r.value for r in spark.read.text(out, wholetext=True).collect()}
    assert set(texts) == {"x", "y"}
    assert "#EXT-X-MEDIA-SEQUENCE:3\n#EXTINF:15,\n3.ts\n" in texts["x"]
    odd = first.limit(1).withColumn("channel", F.explode(F.array(F.lit("a b/ü%=c"), F.lit(None))))
    assert playlists.write(odd, str(tmp_path / "odd")) == 2
    read = spark.read.text(str(tmp_path / "odd"), wholetext=True).collect()
    assert {r.channel for r in read} == {"a b/ü%=c", None}


def test_playlists_by_name(spark, tmp_path):
    """Playlists are fetched by the names that ``write`` gives; no folder is listed."""
    rows = spark.createDataFrame(
        [(c, 1, ["u"], n) for n, c in enumerate(["a", "x/y=%", None])],
        "channel string, seq long, urls array<string>, media_sequence long",
    )
    playlists.write(rows, str(tmp_path))
    asked = rows.select("channel").unionByName(spark.createDataFrame([("none",)], "channel string"))
    got = {r.channel: r.text for r in playlists.fetch(asked, str(tmp_path)).collect()}
    want = {r.channel: r.text for r in rows.select("channel", playlists.text().alias("text")).collect()}
    assert got == want | {"none": None}


def test_playlists_share_folders(spark, tmp_path):
    """A file for each channel, in a few folders."""
    schema = "channel string, seq long, urls array<string>, media_sequence long"
    names = [None, "x/y=%", "é" * 60, "", ".", *map(str, range(300))]
    rows = spark.createDataFrame([(c, 1, ["u"], n) for n, c in enumerate(names)], schema)
    assert playlists.write(rows, str(tmp_path), 7) == len(names)
    assert playlists.write(rows.where("channel = '9'").withColumn("seq", F.lit(2)), str(tmp_path), 7) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == list("0123456")
    found = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert len(found) == len(names) and all(p.name.startswith("channel=") for p in found)
    asked = rows.select("channel").unionByName(spark.createDataFrame([("none",)], "channel string"))
    got = {r.channel: r.text for r in playlists.fetch(asked, str(tmp_path), 7).collect()}
    want = {r.channel: r.text for r in rows.select("channel", playlists.text().alias("text")).collect()}
    assert got == want | {"none": None}


def test_playlist_files_share_folders(spark, folder, monkeypatch):
    from liveops.plans.fixtures import Tables
    from liveops.plans.registry import QUERIES

    made, store = [], slices.store
    monkeypatch.setattr(slices, "store", lambda rows, path: made.append(path) or store(rows, path))
    rows = QUERIES["playlist_files"](spark, folder).count()
    assert rows == Tables(spark, folder).lineitem.select("l_orderkey").distinct().count()
    at = Path(made[0].removeprefix("file:"))
    inside = list(at.rglob("*"))
    assert sum(p.is_file() and p.suffix == ".m3u8" for p in inside) == rows
    assert sum(p.is_dir() for p in inside) < rows / 4


def test_playlists_with_odd_lines(spark):
    """Directives, empty lines, line ends of all kinds and texts that end early, against a plain loop."""
    import random
    import re

    pieces = ["#EXTINF:", "#EXTINF:1.5,", "#EXTINF: \t2", "#EXTM3U", "#EXT-X-TARGETDURATION:7", "\n",
              "\n", "\n", "\r\n", "\r\n", "\r", " ", "9.", "1.2.3", "a.ts", "é\u2028😀", "#", "\x0b"]
    pick = random.Random(5)
    texts = ["".join(pick.choices(pieces, k=pick.randrange(40))) for _ in range(6000)]

    def number(text):
        try:
            return float(text)
        except ValueError:
            return None

    want = set()
    for name, text in enumerate(texts):
        lines, pos = re.split(r"\r?\n", text), 0
        target = re.search(r"#EXT-X-TARGETDURATION:([0-9]+)", text)
        for line, url in zip(lines, lines[1:]):
            if line.startswith("#EXTINF:") and url and not url.startswith("#EXT"):
                found = re.match(r"#EXTINF:\s*([0-9.]+)", line, re.ASCII)
                want.add((name, pos, number(found[1]) if found else None, "http://cdn/" + url,
                          int(target[1]) if target else None))
                pos += 1
    files = spark.createDataFrame(
        [*enumerate(texts), (-1, None)], "playlist long, value string"
    )
    got = [tuple(r) for r in playlists.entries(files, "cdn").collect()]
    assert len(got) == len(want) > 1000 and set(got) == want


def test_playlist_text_of_odd_windows(spark):
    head = "#EXTM3U\n#EXT-X-TARGETDURATION:15\n#EXT-X-VERSION:3\n#EXT-X-MEDIA-SEQUENCE:"
    rows = spark.createDataFrame(
        [(["a", None, "", "b"], 4), ([], 1), ([None], -2), (None, 3), (["c"], None)],
        "urls array<string>, media_sequence long",
    )
    assert [r.t for r in rows.select(playlists.text().alias("t")).collect()] == [
        head + "4\n#EXTINF:15,\na\n#EXTINF:15,\n\n#EXTINF:15,\nb\n", head + "1\n", head + "-2\n",
        None, head + "null\n#EXTINF:15,\nc\n",
    ]


def test_playlists_are_searched_once(spark, folder):
    """No step of the plan is interpreted for each line, and none reads a text's lines again."""
    from liveops.plans.registry import QUERIES

    plan = QUERIES["playlist_entries"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
    assert plan.count("regexp_extract_all(") == 1


def test_small_files_of_queries(spark, folder, monkeypatch):
    """Queries with a file for each row write them in many tasks and list no folder for each."""
    from liveops.plans.fixtures import Tables
    from liveops.plans.registry import QUERIES

    files = QUERIES["playlist_files"](spark, folder)
    assert "Scan text" not in files._jdf.queryExecution().toString()
    made, store = [], slices.store
    monkeypatch.setattr(slices, "store", lambda rows, path: made.append(rows) or store(rows, path))
    QUERIES["fleet_config_servers"](spark, folder)
    assert made[0].rdd.getNumPartitions() > 8
    assert made[0].count() == Tables(spark, folder).supplier.count()


def test_playlists_are_never_missing(spark, tmp_path):
    """A reader that looks all the time while a playlist is written over and over."""
    import threading

    rows = spark.createDataFrame([("x", 1, ["1.ts"], 1)], "channel string, seq bigint, urls array<string>, media_sequence bigint")
    playlists.write(rows, str(tmp_path))
    file, seen, over = tmp_path / "channel=x" / "playlist.m3u8", [], threading.Event()

    def look():
        while not over.is_set():
            seen.append(file.read_text().endswith("1.ts\n"))

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(5):
        playlists.write(rows.withColumn("seq", F.lit(n)), str(tmp_path))
    over.set()
    reader.join()
    assert seen and all(seen)


def test_fleet_config(spark, tmp_path):
    server = {"IP": "1.2.3.4", "ISP": "a", "region": "r", "regionID": 1, "concurrency": 3000,
              "bandwidth": 10485760, "areaID": 7}
    (tmp_path / "f.conf").write_text(
        json.dumps({"streamsrvlist": [server, server | {"areaID": 8}]}, indent=2)
    )
    assert fleet.servers(spark, str(tmp_path)).count() == 2
    assert fleet.servers(spark, str(tmp_path), 8).first().IP == "1.2.3.4"


def test_catalog_scan_and_append(spark, tmp_path):
    path = str(tmp_path / "cat")
    blank = {f: None for f in ("name",)}
    spark.createDataFrame([{"ID": 7, "uid": 1} | blank], catalog.SCHEMA).write.parquet(path)
    known = catalog.scan(spark, path)
    new = spark.createDataFrame([(5,), (6,)], "uid bigint")
    added = catalog.append(new, known, ["uid"])
    assert sorted((r.ID, r.uid) for r in added.collect()) == [(8, 5), (9, 6)]


def flv(*tags):
    out = b"FLV\x01\x05\x00\x00\x00\x09\x00\x00\x00\x00"
    for kind, ts, body in tags:
        head = bytes([kind]) + len(body).to_bytes(3, "big") + (ts & 0xFFFFFF).to_bytes(3, "big")
        out += head + bytes([ts >> 24]) + b"\0\0\0" + body + struct.pack(">I", len(body) + 11)
    return out


def test_flv(spark, tmp_path):
    data = flv((8, 5, b"\xaf\x00x"), (9, 0x1000002, b"\x17\x01yy"))
    (tmp_path / "a.flv").write_bytes(data)
    (tmp_path / "cut.flv").write_bytes(data[:-6])
    (tmp_path / "note.txt").write_text("x")
    found = media_files.files(spark, str(tmp_path))
    assert found.where("kind is null").count() == 1
    rows = media_files.flv_tags(found).orderBy("path", "pos").collect()
    whole, cut = [r for r in rows if "a.flv" in r.path], [r for r in rows if "cut" in r.path]
    assert [(r.type, r.ts, r.codec, r.frame_type, r.packet_type) for r in whole] == [
        (8, 5, 10, None, 0), (9, 0x1000002, 7, 1, 1),
    ]
    assert [r.error for r in cut] == [None, "tag body cut"]


def box(name, body):
    return struct.pack(">I", len(body) + 8) + name + body


def test_mp4(spark, tmp_path):
    mdhd = b"\0" * 12 + struct.pack(">IIHH", 600, 1200, 0x15C7, 0)
    wide = b"\1" + b"\0" * 19 + struct.pack(">IQHH", 44100, 2**33, 0x15C7, 0)
    hdlr = b"\0" * 8 + b"soun" + b"\0" * 13

    def trak(head):
        return box(b"trak", box(b"mdia", box(b"mdhd", head) + box(b"hdlr", hdlr)))

    data = box(b"mdat", b"12345") + box(b"moov", trak(mdhd) + trak(wide)) + box(b"ftyp", b"isom")
    (tmp_path / "a.mp4").write_bytes(data)
    (tmp_path / "b.mp4").write_bytes(data[:-2])
    boxes = media_files.mp4_boxes(media_files.files(spark, str(tmp_path)))
    a = [r.box for r in boxes.where("path like '%a.mp4'").collect()]
    assert a == ["mdat", "moov", "trak", "mdia", "mdhd", "hdlr", "trak", "mdia", "mdhd", "hdlr",
                 "ftyp"]
    assert boxes.where("error is not null").count() == 1
    tracks = media_files.mp4_tracks(boxes.where("path like '%a.mp4'")).orderBy("track").collect()
    assert [(r.timescale, r.duration, r.language, r.handler) for r in tracks] == [
        (600, 1200, "eng", "soun"), (44100, 2**33, "eng", "soun"),
    ]


def test_transport_packets(spark, tmp_path):
    packet = bytes([0x47, 0x41, 0x00, 0x1F]) + b"\xff" * 184
    (tmp_path / "a.ts").write_bytes(packet + b"\x00" + packet[1:] + b"\x47\x00")
    rows = media_files.ts_packets(media_files.files(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.pid, r.unit_start, r.cc, r.error) for r in rows] == [
        (256, 1, 15, None), (256, 1, 15, "no sync byte"), (None, None, None, "packet cut"),
    ]


def test_websocket_frames(spark):
    mask = b"\x01\x02\x03\x04"

    def framed(text):
        body = bytes(b ^ mask[i % 4] for i, b in enumerate(text.encode()))
        size = bytes([0x80 | len(body)]) if len(body) < 126 else b"\xfe" + struct.pack(">H", len(body))
        return b"\x81" + size + mask + body

    long = "é" * 400
    df = spark.createDataFrame(
        [("c", framed("hi") + framed(long) + b"\x81")], "path string, content binary"
    )
    rows = media_files.ws_frames(df).orderBy("pos").collect()
    assert [r.text for r in rows] == ["hi", long, None]
    assert rows[2].error == "frame header cut"
