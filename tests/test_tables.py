"""Tables that are written in parts, and streams that write several of them: killed writes and repeated batches."""

import json

import pytest
from pyspark.sql import functions as F

from bidspark.sources.tables import Table, refresh_in, replace_in, upsert_into
from bidspark.streaming import events


class Killed(Exception):
    pass


def killer(step):
    def at(name):
        if name == step:
            raise Killed(name)

    return at


KIND = "document_id string, provider string, v int, created_at int"


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def test_upserts_are_written_once_and_survive_kills(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", KIND, buckets=8)
    assert rows(t) == [] and t.written("w") == -1
    first = spark.createDataFrame([(f"d{i}", "x", i, 10) for i in range(40)] + [(None, "x", 1, 10)], KIND)
    assert upsert_into(t, first, "w", 0) and not upsert_into(t, first.withColumn("v", F.lit(-1)), "w", 0)
    assert len(rows(t)) == 41
    change = spark.createDataFrame([("d1", "x", 100, 99), ("new", "x", 5, 99)], KIND)
    want = sorted([*(r for r in rows(t) if r[0] != "d1"), ("d1", "x", 100, 10), ("new", "x", 5, 99)], key=repr)
    for step in ("stage", "rename", "manifest"):
        before = rows(t)
        with pytest.raises(Killed):
            upsert_into(t, change, "w", 1, at=killer(step))
        assert rows(t) == before and t.written("w") == 0
    with pytest.raises(Killed):
        upsert_into(t, change, "w", 1, at=killer("clean"))  # committed by then
    assert rows(t) == want and not upsert_into(t, change, "w", 1)
    again = Table(spark, f"file://{tmp_path}/t", KIND, buckets=3)  # the first write fixed the buckets
    assert upsert_into(again, change, "other", 0) and rows(again) == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", KIND, buckets=16)
    replace_in(t, spark.createDataFrame([(f"d{i}", "x", i, 0) for i in range(200)], KIND), "w", 0)
    old = dict(t.manifest()["buckets"])
    assert replace_in(t, spark.createDataFrame([("d7", "y", 1, 1)], KIND), "w", 1)
    new = t.manifest()["buckets"]
    assert sum(old[b] != new[b] for b in old) == 1
    assert [r[1:] for r in rows(t) if r[0] == "d7"] == [("y", 1, 1)] and len(rows(t)) == 200
    gone = spark.createDataFrame([("d8",)], "document_id string")
    assert replace_in(t, spark.createDataFrame([], KIND), "w", 2, gone) and len(rows(t)) == 199
    for k in range(3, 7):
        assert replace_in(t, spark.createDataFrame([], KIND), "w", k, gone)
    assert sum(p.name.startswith("_manifest-") for p in (tmp_path / "t").iterdir()) == 2 and len(rows(t)) == 199


def test_points_of_a_file_give_way(spark, tmp_path):
    kind = "point_id string, project_id string, filename string, text string"
    t = Table(spark, f"{tmp_path}/t", kind, ("project_id", "filename"), 4)
    refresh_in(t, spark.createDataFrame([("a", "p", "f", "1"), ("b", "p", "f", "2"), ("c", "p", "g", "3")], kind), "w", 0)
    refresh_in(t, spark.createDataFrame([("a", "p", "f", "4"), ("a", "p", "f", "4")], kind), "w", 1)
    assert rows(t) == [("a", "p", "f", "4"), ("c", "p", "g", "3")]


@pytest.mark.parametrize("step", ["requirements:manifest", "chunks:clean", "index:rename"])
def test_a_stream_restarted_between_sinks_gives_the_same_tables(spark, tmp_path, step):
    texts = {"d1": "The contractor shall deliver. Fine.", "d2": "It must run. The offeror shall submit plans.", "d3": None, "d4": "No duty here."}
    lines = [json.dumps({"event_type": "document.extracted", "document_id": d, "project_id": "p", "filename": f"{d}.docx", "extracted_text": t, "created_at": "2024-01-01T00:00:00Z"}) for d, t in texts.items()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    read = lambda s: tuple(rows(x) for x in (s.requirements, s.chunks, s.index))
    stream = lambda: events.stream_document_events(spark.readStream.text(f"{tmp_path}/in"))
    plain, killed = (events.Sinks.at(spark, f"{tmp_path}/{n}", 4) for n in ("plain", "killed"))
    events.stream_refresh(stream(), plain, f"{tmp_path}/ck1").awaitTermination(120)
    with pytest.raises(Exception, match="Killed|foreachBatch|FOREACH"):
        events.stream_refresh(stream(), killed, f"{tmp_path}/ck2", at=killer(step)).awaitTermination(120)
    events.stream_refresh(stream(), killed, f"{tmp_path}/ck2").awaitTermination(120)
    assert read(killed) == read(plain)
    got = read(plain)
    assert len(got[0]) == 3 and {r[1] for r in got[1]} == {"d1", "d2", "d4"} and len(got[2]) == len(got[1]) and all(len(r[-1]) == 64 for r in got[2])
    # a repeated batch changes nothing
    batch = spark.createDataFrame([("p", "d1", "d1.docx", "other text")], "project_id string, document_id string, filename string, extracted_text string")
    assert events.refresh(batch, 0, plain) == {"requirements": False, "chunks": False, "index": False} and read(plain) == got
    assert events.refresh(batch, 99, plain)["index"] and {r[1] for r in rows(plain.chunks) if r[9].endswith("other text")} == {"d1"}
