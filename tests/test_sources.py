import os
import struct
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from mediagrove.functions import udf
from mediagrove.sources import files, formats, paged
from mediagrove.streaming import roots as streams
from mediagrove.streaming import scan

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 6, 9) + b"\x08\x02\0\0\0"


def tree(pairs, names=None):
    out = b""
    for k, v in pairs:
        key = k.encode() + b"\0" if names is None else struct.pack("<I", names.index(k))
        if isinstance(v, list):
            out += b"\0" + key + tree(v, names)
        elif isinstance(v, int):
            out += b"\x02" + key + struct.pack("<I", v)
        else:
            out += b"\x01" + key + v.encode() + b"\0"
    return out + b"\x08"


def app_info(records, version):
    names = ["appinfo", "common", "name"] if version == 29 else None
    body = b""
    for app, title, bad in records:
        t = tree([("appinfo", [("common", [("name", title)])])], names)
        t = b"\x63" + t if bad else t
        body += struct.pack("<II", app, 60 + len(t)) + b"\0" * 60 + t
    body += struct.pack("<I", 0)
    if version == 28:
        return struct.pack("<II", 0x07564428, 1) + body
    table = struct.pack("<I", 3) + b"".join(n.encode() + b"\0" for n in names)
    return struct.pack("<IIq", 0x07564429, 1, 16 + len(body)) + body + table


@pytest.mark.parametrize("version", [28, 29])
def test_app_info(version):
    assert formats.app_info(app_info([(10, "Ten", 0), (11, "x", 1), (4294967295, "Last", 0)], version)) == ({10: "Ten", 4294967295: "Last"}, 1)
    for cut in (3, 20, 40):
        with pytest.raises(formats.Damaged):
            formats.app_info(app_info([(10, "Ten", 0)], version)[:cut])


def test_shortcuts():
    data = tree([("shortcuts", [("0", [("appid", 5), ("appname", "Five")]), ("1", [("AppName", "no id")]), ("2", [("appid", 5), ("appname", "again")])])])[:-1]
    assert formats.shortcuts(data) == ({5: "Five"}, 1)


def test_text_trees():
    data = b'"libraryfolders" { // note\n "0" { "path" "/games" } "1" { "path" "C:\\\\Games" } "2" { "path" "relative" } "3" { "path" "/a/../b" } "x" { "path" "/no" } }'
    assert formats.library_folders(data) == ["/games", "C:\\Games", "/no"]  # entries may have any name
    assert formats.library_folders(b'LibraryFolders { 0 "/a//b/./c/" 1 { PATH " /a/b/c " path "/d" } 2 "" } LIBRARYFOLDERS { 0 "/e" }') == ["/a/b/c", "/d", "/e"]
    assert formats.app_manifest(b'"AppState" { "appid" "7" "name" " Seven " }') == (7, "Seven")
    assert formats.app_manifest(b'appstate { AppID 7 "appid" " 8 " "name" "x" NAME " y " } appstate { appid 9 name z }') == (8, "y")
    assert formats.app_manifest(b'"AppState" { "appid" "4294967296" "name" "x" }') is None and formats.app_manifest(b'"AppState" { "appid" "1" "name" " " }') is None
    assert formats.text_tree(rb'''"a\n\r\t\q\\" b"c // whole
      "k" { } // end''') == [("a\n\r\tq\\", 'b"c'), ("k", [])]
    for bad in (b'"a" {', b'"a', b"}", b'"a"', b"a / b", b"/", b'"a\\', b"a { b }", b"{ }", b"a { { } }", b"a b }", b'a "\xff"', b"a { " * 66 + b"} " * 66, b'a "' + b"x" * ((1 << 20) + 1) + b'"'):
        with pytest.raises(formats.Damaged):
            formats.text_tree(bad)


def test_gamelist():
    good = b"<gameList><game><path>./a/Game One.zip</path><name>One &amp; only</name></game><game><path>x.zip</path></game></gameList>"
    assert formats.gamelist(good) == [("Game One", "One & only")]
    for bad in (good[:-5], b'<!DOCTYPE x [<!ENTITY e "v">]><gameList/>', b"<a>" * 40 + b"</a>" * 40):
        with pytest.raises(formats.Damaged):
            formats.gamelist(bad)


def document(pairs):
    body = b"".join(pairs) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


def test_bson():
    raw = uuid.UUID("12345678-1234-4123-8123-123456789abc")
    text = lambda k, v: b"\x02" + k + b"\0" + struct.pack("<i", len(v) + 1) + v + b"\0"
    ident = b"\x05_id\0" + struct.pack("<iB", 16, 3) + raw.bytes_le
    double = b"\x01d\0" + struct.pack("<d", 1.5)
    game = formats.library_game(document([ident, text(b"Name", b"Alpha"), double, text(b"GameId", b"7"), b"\x08Hidden\0\x01"]))
    assert (game["guid"], game["name"], game["game_id"], game["hidden"]) == (str(raw), "Alpha", "7", True)
    assert formats.library_game(document([ident])) is None
    assert formats.library_game(document([ident, text(b"Name", b"a"), text(b"Name", b"b")])) is None
    assert formats.library_game(b"\x05\0\0\0") is None


def page(number, kind, body, count, after=0xFFFFFFFF):
    raw = struct.pack("<IBIIHH", number, kind, 0xFFFFFFFF, after, count, 0) + b"\0" * 8 + body
    return raw + b"\0" * (4096 - len(raw))


def library(documents, **change):
    """A file of a header, a collection, an index and a data page, and an overflow page for the first document."""
    ids = [uuid.UUID(int=k + 1) for k in range(len(documents))]
    node = lambda slot, key, data, after: struct.pack("<HBB12xHB", slot, 1, 0, len(key), 11 if key else 0) + key + struct.pack("<IH", *data) + struct.pack("<IH", 0, 0) + struct.pack("<IH", *after)
    n = len(documents)
    order = [(2, k + 1) for k in range(n)] + [(2, n + 1)]
    index = node(0, b"", (0, 0), order[0]) + b"".join(node(k + 1, ids[k].bytes_le, (3, k), order[k + 1]) for k in range(n)) + node(n + 1, b"", (0, 0), (0, 0))
    text = lambda v: struct.pack("<i", len(v)) + v
    slots = text(b"_id=$._id") + b"\1" + struct.pack("<IHIHI", 2, 0, 2, n + 1, 0) + (text(b"") + b"\0" * 17) * 15
    head = bytearray(4096)
    head[4], head[52], head[101] = 1, 7, 1
    head[25:52] = b"** This is a LiteDB file **"
    head[59:63] = struct.pack("<I", 4)
    head[102:115] = text(b"Games") + struct.pack("<I", 1)
    for at, value in change.items():
        head[int(at[1:])] = value
    data = struct.pack("<HIH", 0, 4, 0) + b"".join(struct.pack("<HIH", k, 0xFFFFFFFF, len(d)) + d for k, d in enumerate(documents) if k)
    return bytes(head) + page(1, 2, text(b"Games") + b"\0" * 12 + slots, 0) + page(2, 3, index, n + 2) + page(3, 4, data, n) + page(4, 5, documents[0], len(documents[0]))


def test_library():
    text = lambda k, v: b"\x02" + k + b"\0" + struct.pack("<i", len(v) + 1) + v + b"\0"
    game = lambda k, name: document([b"\x05_id\0" + struct.pack("<iB", 16, 3) + uuid.UUID(int=k).bytes_le, text(b"Name", name)])
    docs = [game(1, b"beta"), game(2, b"Alpha"), b"\x05\0\0\0\1"]
    status, games, skipped = paged.read_library(library(docs))
    assert (status, [g["name"] for g in games], skipped) == ("ok", ["Alpha", "beta"], 1)
    assert paged.read_library(library([game(9, b"x")]))[0] == "corrupt"
    for change, want in (({"b52": 8}, "unsupported"), ({"b70": 1}, "encrypted"), ({"b4095": 1}, "recovering")):
        assert paged.read_library(library(docs, **change)) == (want, [], 0)
    assert paged.read_library(library(docs) + b"x")[0] == "journal"
    assert paged.read_library(library(docs)[:-1])[0] == "corrupt"


def test_sniffing_and_sizes():
    assert udf.sniff(PNG) == "image/png" and udf.image_size(PNG) == (6, 9)
    assert udf.sniff(b"plain") == "text/plain; charset=utf-8" and udf.sniff(b"\0\1", "mkv") == "video/x-matroska"
    assert udf.sniff(b"\0\0\0\x18ftypmp42") == "video/mp4" and udf.sniff(b"%PDF-1") == "application/pdf"
    assert udf.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4) and udf.image_size(b"\x89PNG") == (0, 0)
    assert udf.clean_path("a//b/../c/.") == "a/c" and udf.clean_path("") == "."
    with pytest.raises(ValueError):
        udf.strict_json('{"a": 1}', {"b"})


def test_parsing_rows(spark):
    rows = [("good", app_info([(10, "Ten", 0), (11, "x", 1)], 28)), ("bad", b"nothing")]
    got = formats.parse(spark.createDataFrame(rows, "path string, content binary"), "appinfo").collect()
    assert sorted((r.path, r.number, r.status) for r in got) == [("bad", 0, "unsupported"), ("good", 1, "skipped"), ("good", 10, "ok")]


def test_file_scan(spark, tmp_path):
    (tmp_path / "artwork/set1/grid").mkdir(parents=True)
    (tmp_path / "artwork/set1/grid/.deck-profile-empty").write_text("")
    (tmp_path / "artwork/set1/grid/123p.png").write_bytes(PNG)
    os.symlink("123p.png", tmp_path / "artwork/set1/grid/link.png")
    got = {r.path: r for r in files.scan(spark, [("cat", "decky-catalog", "", str(tmp_path))]).collect()}
    assert got["artwork/set1/grid/.deck-profile-empty"].size == 0
    assert (got["artwork/set1/grid/123p.png"].width, got["artwork/set1/grid/123p.png"].mime) == (6, "image/png")
    assert got["artwork/set1/grid/link.png"].issue == "symlink-rejected"


def test_scan_splits_and_takes_filters_over(spark, tmp_path):
    for folder, n in (("a/x", 120), ("a/x/deep/er", 30), ("a/y", 3), ("a", 2)):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        for i in range(n):
            (tmp_path / folder / f"f{i}.{'png' if i % 2 else 'txt'}").write_bytes(b"x" * i)
    os.symlink("x", tmp_path / "a/link")
    (tmp_path / "b").mkdir()
    roots = [("a", "romm", "", str(tmp_path / "a")), ("b", "romm", "", str(tmp_path / "b"))]
    whole = files.scan(spark, roots, entries=25)
    paths = sorted(r.path for r in whole.select("path").collect())
    assert len(paths) == len(set(paths)) == 156 and "link" in paths
    assert whole.rdd.getNumPartitions() == 1 + 5 + 2 + 1  # root a, x in shares of 25, er in two, y
    assert sorted(r.path for r in files.scan(spark, roots, entries=25, folders=2).select("path").collect()) == paths  # what the plan doesn't open is walked by tasks
    some = whole.where("root_id = 'a' and path like 'x/deep/%' and path like '%.png'")
    assert some.count() == 15 and some.where("size > 10").count() == 10
    assert some.rdd.getNumPartitions() < whole.rdd.getNumPartitions()
    assert whole.where(F.col("root_id").isin("b", "c")).count() == 0 and files.scan(spark, roots[1:]).count() == 0


def test_changes_as_a_stream_of_scans(spark, tmp_path):
    for folder in ("a/x/y", "b"):
        (tmp_path / folder).mkdir(parents=True)
    for i in range(10):
        (tmp_path / f"a/x/y/{i}").write_bytes(b"x" * i)
    (tmp_path / "b/one").write_bytes(b"123")
    roots, out = [(n, "romm", "", str(tmp_path / n)) for n in "abc"], str(tmp_path / "table")

    def scanned():
        streams.run(files.changes(spark, roots, str(tmp_path / "state"), streams.begin(spark, out)), out)
        return sorted(map(tuple, streams.states(spark, out).collect()))

    assert scanned() == [("a", 1, "complete", 10, 45), ("b", 1, "complete", 1, 3), ("c", 1, "error", 0, 0)]
    (tmp_path / "a/x/y/9").unlink()
    (tmp_path / "a/x/y/1").write_bytes(b"x" * 100)
    (tmp_path / "c").mkdir()
    os.rename(tmp_path / "b", tmp_path / "gone")
    assert scanned() == [("a", 2, "complete", 9, 135), ("b", 2, "error", 0, 0), ("c", 2, "complete", 0, 0)]
    os.rename(tmp_path / "gone", tmp_path / "b")
    assert scanned() == [("a", 3, "complete", 9, 135), ("b", 3, "complete", 1, 3), ("c", 3, "complete", 0, 0)]


def test_generations_are_handed_out_once(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: streams.begin(spark, str(tmp_path)), range(24)))
    assert sorted(got) == list(range(1, 25)) and streams.newest(spark, str(tmp_path)) == 24
    assert streams.states(spark, str(tmp_path)).count() == 0 and streams.progress(streams.states(spark, str(tmp_path))).first().status == "idle"


def test_versions_of_totals(spark, tmp_path):
    facts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "root_id string, size int")
    facts.write.parquet(str(tmp_path / "facts"))
    path = str(tmp_path / "totals")

    def run(generation, only):
        frame = scan.summaries(scan.read(spark, str(tmp_path / "facts"), facts.schema).where(only))
        scan.run_versions(frame, path, generation, str(tmp_path / f"checkpoint{generation}"))
        return sorted(map(tuple, scan.current(spark, path).collect()))

    assert run(2, "true") == [("a", 2, 3), ("b", 1, 3)]
    assert run(1, "root_id = 'a'") == [("a", 2, 3), ("b", 1, 3)]  # a stale scan that ends later
    assert run(3, "root_id = 'b'") == [("b", 1, 3)]
