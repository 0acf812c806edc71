import os

import pytest

from mediagrove.functions import udf
from mediagrove.operators import detect
from mediagrove.plans import host


def test_json_and_artifacts(tmp_path):
    p = str(tmp_path / "a" / "x.json")
    host.write_json(p, {"b": 1, "a": "<é>"})
    assert host.read_json(p) == {"a": "<é>", "b": 1}
    assert host.read_json(str(tmp_path / "none"), {}) == {}
    q = str(tmp_path / "once.json")
    assert host.write_once(q, [1]) and not host.write_once(q, [1])
    with pytest.raises(host.Conflict):
        host.write_once(q, [2])


def test_drafts(tmp_path):
    p = str(tmp_path / "d.json")
    one = host.save_draft(p, {"v": 1}, "")
    with pytest.raises(host.Conflict):
        host.save_draft(p, {"v": 2}, "")
    assert host.save_draft(p, {"v": 2}, one) != one


def test_digest_is_canonical():
    assert udf.canonical_json({"b": "<&>", "a": [1, None]}) == '{"a":[1,null],"b":"\\u003c\\u0026\\u003e"}'
    a = {"destinationRoot": "r", "destinationPath": "a"}
    b = {"destinationRoot": "r", "destinationPath": "b"}
    assert host.operation_id("k", [a, b]) == host.operation_id("k", [b, a])


def test_containment_and_overlap(tmp_path):
    os.symlink("/", tmp_path / "out")
    assert host.contain(str(tmp_path), "x/y").endswith("x/y")
    for bad in ("../x", "out/etc"):
        with pytest.raises(ValueError):
            host.contain(str(tmp_path), bad)
    assert host.overlaps(str(tmp_path), str(tmp_path / "x")) and not host.overlaps(str(tmp_path / "a"), str(tmp_path / "ab"))


def test_ledger(tmp_path):
    ledger = host.Ledger(str(tmp_path))
    a = ledger.add("A", {"n": 1})
    b = ledger.add("B", {"n": 2}, a)
    c = ledger.add("C", {"n": 3, "executable": True}, b)
    assert host.read_json(str(tmp_path / "C" / f"{c}.json"))["executable"] is False
    host.write_json(str(tmp_path / "A" / f"{a}.json"), {"n": 9})
    assert not ledger.verified("A", a) and ledger.verified("B", b)
    with pytest.raises(host.Conflict):
        ledger.add("B", {}, a)
    with pytest.raises(ValueError):
        ledger.add("B", {})


def test_publish_and_roll_back(tmp_path):
    target, state = tmp_path / "t", tmp_path / "s"
    target.mkdir()
    (target / "old").write_text("old")
    (tmp_path / "new").write_text("new")
    new, old = host.file_sha256(str(tmp_path / "new")), host.file_sha256(str(target / "old"))
    assert host.verify_file(str(tmp_path / "new"), new.upper())
    p = host.Publisher(str(target), str(state))
    files = [{"source": str(tmp_path / "new"), "path": "old", "sha256": new, "previous": old}, {"source": str(tmp_path / "new"), "path": "d/x", "sha256": new, "previous": ""}]
    assert p.publish("r1", files)["state"] == "complete"
    assert (target / "old").read_text() == "new" and (target / "d/x").exists()
    with pytest.raises(host.Conflict):
        p.publish("r2", files)
    assert p.rollback("r1")["state"] == "rolled-back"
    assert (target / "old").read_text() == "old" and not (target / "d/x").exists()


def test_well_known_places(tmp_path, spark):
    home = tmp_path / "home"
    grid = home / ".local/share/Steam/userdata/42/config/grid"
    grid.mkdir(parents=True)
    (home / ".local/share/Steam/userdata/name").mkdir()
    (home / ".steam").mkdir()
    (home / ".steam/steam").symlink_to(home / ".local/share/Steam")  # the same folder by another way
    (home / "GamingProfiles").mkdir()
    for k in range(3):
        (grid / f"{k}.png").write_text("x")
    (grid / "link.png").symlink_to(grid / "0.png")
    rows = host.well_known_places(str(home), {}, False)
    assert [r[1] for r in rows] == ["steam-42", "steam-42", "retrodeck-media", "gaming-profiles-syncthing", "gaming-profiles-home"]
    assert [r[5] for r in rows] == [True, True, False, False, True] and rows[0][6] == rows[1][6]
    places = spark.createDataFrame(rows, "seq int, id string, kind string, name string, path string, is_dir boolean, file_key string")
    files = spark.createDataFrame([(r[4], host.count_files(r[4])) for r in rows], "path string, n int")
    roots = spark.createDataFrame([(str(grid),)], "path string")
    got = sorted((r.id, r["items"], r.status) for r in detect.detect(places, files, roots).collect())
    assert got == [("gaming-profiles-home", 0, "detected"), ("steam-42", 3, "connected")]
    assert host.count_files(str(grid), 2) == 2
    assert [r[1] for r in host.well_known_places("/none", {"ProgramFiles": "/none", "APPDATA": "/none"}, True)][:2] == ["playnite-library", "playnite-extra"]


def test_single_flight():
    flight = host.SingleFlight()
    assert flight.refresh("a", lambda: 1) and flight.get("a") == 1 and flight.get("b") is None
    assert not flight.refresh("a", lambda: 2)
    assert flight.refresh("b", lambda: flight.refresh("c", lambda: 3)) and flight.get("b") is False  # a second one meets the first
    assert flight.get("a") is None
