"""Chat files, metadata, sessions, and messages without repeats."""

import pytest

from tideline.operators import prepare, selection, sessions
from tideline.sources import chat_xml, media

HEAD = "<metadata><platform>P</platform><user_name>s</user_name><room_id>1</room_id><live_start_time>1786000000000</live_start_time></metadata>"


def doc(body, head=HEAD, end="</i>"):
    return f'<?xml version="1.0" encoding="utf-8"?><i>{head}{body}{end}'.encode()


def test_reading():
    ok = doc('<d uid="a" timestamp="1000000">first</d><d uid="b">no time</d><d timestamp="5">no user</d><d uid="c" timestamp="x">bad</d><g><d uid="e" timestamp=" 12 "/></g>')
    r = chat_xml.read_bytes(ok)
    assert r.messages == [("a", 1000000, "first"), ("e", 12, "")] and r.repair is None
    assert chat_xml.read_bytes(doc("")).messages == []
    assert chat_xml.read_bytes(doc('<d uid="a" timestamp="1">before<b>in</b>after</d>')).messages == [("a", 1, "before")]


def test_repairs():
    r = chat_xml.read_bytes(doc('<d p="0" user="\x01bad" uid="1" timestamp="1786000001000">hi</d>'))
    assert len(r.messages) == 1 and "control" in r.repair
    r = chat_xml.read_bytes(doc('<d uid="1" timestamp="5">hi</d>', end=""))
    assert r.messages == [("1", 5, "hi")] and "breaks off" in r.repair
    r = chat_xml.read_bytes(doc('<d uid="1" timestamp="5">hi</d><d uid="2" timestamp="6">half', end=""))
    assert r.messages == [("1", 5, "hi"), ("2", 6, "half")]


@pytest.mark.parametrize("bad", [b"no xml", b"", doc('<d uid="1" timestamp="5">a < b</d>'), doc('<d uid="1" timest', end=""), doc('<d uid="1">x</d>'), doc('<x><d uid="1" timestamp="5">x</d>', end="")])
def test_unreadable(bad):
    with pytest.raises(chat_xml.UnreadableFile):
        chat_xml.read_bytes(bad, "name")


def test_missing_file():
    with pytest.raises(FileNotFoundError):
        chat_xml.read_file("/nowhere/at/all.xml")


def test_metadata():
    assert chat_xml.metadata(doc("<d bad <"))["platform"] == "P"
    assert chat_xml.metadata(doc("", head="")) == {}
    assert chat_xml.metadata(doc("", head="<metadata><room_title/></metadata>")) == {"room_title": None}
    assert chat_xml.metadata(b"x" * 70_000 + doc("")) == {}


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xml").write_bytes(doc('<d uid="1" timestamp="1000">hi</d><d uid="1" timestamp="2000">ho</d>'))
    (tmp_path / "sub" / "b.xml").write_bytes(doc('<d uid="1" timestamp="2000">ho</d><d uid="2" timestamp="3000">x</d>'))
    (tmp_path / "c.xml").write_bytes(b"junk")
    (tmp_path / "d.txt").write_text("other")
    read = chat_xml.contents(chat_xml.files(spark, str(tmp_path)))
    assert sorted(r["status"] for r in read.collect()) == ["ok", "ok", "skipped"]
    chunks = chat_xml.chunk_table(read, chat_xml.listed(spark, str(tmp_path)))
    known, unknown = sessions.classified(chunks)
    assert (known.count(), unknown.count()) == (2, 1)
    (s,) = sessions.sessions(known).collect()
    assert (s["platform"], s["user_name"], s["n_chunks"]) == ("P", "s", 2)
    own = chat_xml.messages(read).selectExpr("'one' as stream_id", "uid", "ts_ms", "text")
    assert sorted(r["ts_ms"] for r in prepare.deduplicated(own).collect()) == [1000, 2000, 3000]


def chunk(spark, rows):
    return spark.createDataFrame(rows, "path string, created_ms bigint, modified_ms bigint, platform string, user_name string, room_title string")


HOUR = 3_600_000


@pytest.mark.parametrize(
    ("second", "n"),
    [((HOUR + HOUR // 2, 2 * HOUR, "p", "u", "t"), 1), ((3 * HOUR, 4 * HOUR, "p", "u", "t"), 2), ((HOUR, 2 * HOUR, "p", "u", "other"), 2), ((HOUR, 2 * HOUR, "p", "v", "t"), 2), ((2 * HOUR, 3 * HOUR, "p", "u", " t "), 1)],
)
def test_session_rule(spark, second, n):
    assert sessions.sessions(chunk(spark, [("a", 0, HOUR, "p", "u", "t"), ("b", *second)])).count() == n


def test_labels(spark):
    day = 24 * HOUR
    rows = [("a", 0, HOUR, "p", "u", "t"), ("b", 5 * HOUR, 6 * HOUR, "p", "u", None), ("c", day, day + HOUR, "p", "u", "")]
    labels = [r["label"] for r in sessions.sessions(chunk(spark, rows)).orderBy("start_ms").collect()]
    assert labels == ["1970-01-01 第1场 · t", "1970-01-01 第2场", "1970-01-02 第1场"]


def test_dedup_keeps_the_first_by_order(spark):
    df = spark.createDataFrame([("s", "u", 1, "x", 2), ("s", "u", 1, "x", 1), ("s", "u", 2, "x", 3)], "stream_id string, uid string, ts_ms bigint, text string, place int")
    assert sorted(r["place"] for r in prepare.deduplicated(df, "place").collect()) == [1, 3]


def test_interval(spark):
    df = spark.createDataFrame([("s", "u", 1000 + t * 1000, "x") for t in (0, 100, 300, 400)], "stream_id string, uid string, ts_ms bigint, text string")
    assert prepare.between_relative(df, 60, 360).count() == 2
    assert prepare.between(df, 101_000, 301_000).count() == 2


def test_pairing(spark):
    def files(*names):
        return spark.createDataFrame([(f"file:/r/{n}",) for n in names], "path string")

    t = "2026-08-07-22-24-43-052"
    found = media.paired(files("a.xml", f"{t}-x.xml", "c.xml", f"{t[:-1]}3-y.xml"), files("a.mp4", f"{t}-z.flv", "c.mp4", "c.mkv", "d.txt")).collect()
    by = {r["path"].split("/")[-1]: (r["video"], r["problem"]) for r in found}
    assert by["a.xml"] == ("file:/r/a.mp4", None)
    assert by[f"{t}-x.xml"] == (f"file:/r/{t}-z.flv", None)
    assert by["c.xml"] == (None, "ambiguous") and by[f"{t[:-1]}3-y.xml"] == (None, "missing")


def test_heads_and_probes(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<i><metadata><platform>P</platform><empty/></metadata>" + "<d uid='u' timestamp='1'>x</d>" * 9000 + "broken")
    (tmp_path / "b.xml").write_text(" " * 70_000 + "<metadata><platform>late</platform></metadata>")
    rows = {r["path"].split("/")[-1]: r["metadata"] for r in chat_xml.heads(chat_xml.listed(spark, str(tmp_path))).collect()}
    assert rows == {"a.xml": {"platform": "P", "empty": None}, "b.xml": {}}
    (r,) = media.probed(media.listed(spark, str(tmp_path)).where("path like '%b.xml'"), "/no/such/probe").collect()
    assert r["duration_s"] is None and "probe" in r["problem"]


def test_choices(spark):
    rows = [("a", 0, HOUR, "p", "u", "t"), ("b", HOUR, 2 * HOUR, "p", "u", "t"), ("c", 9 * HOUR, 10 * HOUR, "p", "u", "t"), ("d", 0, HOUR, "p", "a", "t"), ("e", 0, HOUR, "o", "u", "t")]
    found = sessions.sessions(chunk(spark, rows))
    assert [r["platform"] for r in selection.platforms(found).collect()] == ["o", "p"]
    assert [r["user_name"] for r in selection.streamers(found, "p").collect()] == ["a", "u"]
    assert [(r["start_ms"], r["n_chunks"]) for r in selection.sessions_of(found, "p", "u").collect()] == [(0, 2), (9 * HOUR, 1)]
    assert [(r["chunk"], r["path"]) for r in selection.chunks_of(found, "p", "u", 0).collect()] == [(0, "a"), (1, "b")]
    assert {(r["platform"], r["user_name"]): (r["n_sessions"], r["n_chunks"]) for r in selection.choices(found).collect()} == {("p", "u"): (2, 3), ("p", "a"): (1, 1), ("o", "u"): (1, 1)}
    times = spark.createDataFrame([("s", "u", 1000 + t * 1000, "x") for t in (0, 100, 300, 400)] + [("z", "u", 5, "x")], "stream_id string, uid string, ts_ms bigint, text string")
    assert {r["stream_id"]: r["n"] for r in selection.preview_counts(times, 60, 360).collect()} == {"s": 2, "z": 0}


def test_probe_result():
    assert media.probe_result('{"format": {"duration": "3.5"}, "streams": [{"codec_type": "video"}]}') == (3.5, True, False)
    for bad in ("x", "{}"):
        with pytest.raises(media.MediaError):
            media.probe_result(bad)
    with pytest.raises(media.MediaError):
        media.probe("/none.mp4", ffprobe="/no/such/probe")
