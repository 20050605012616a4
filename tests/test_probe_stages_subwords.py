"""Media boxes made by hand, stages that resume, and subword counts against brute force."""

from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from sessionweave.functions import subwords
from sessionweave.sources import boxes, readers
from sessionweave.sources.stages import Stages


def box(name, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, name, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), name) + body


def head(name, scale, length, new=False):
    return box(name, struct.pack(">B3xQQIQ", 1, 0, 0, scale, length) if new else struct.pack(">B3xIIII", 0, 0, 0, scale, length), bytes(80))


def track(kind, entry, scale, length, times=(), new=False):
    table = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stts", struct.pack(">II", 0, len(times)), *(struct.pack(">II", *t) for t in times)))
    return box(b"trak", box(b"mdia", head(b"mdhd", scale, length, new), box(b"hdlr", bytes(8), kind, bytes(13)), box(b"minf", table)))


def video(codec=b"avc1", width=640, height=360, times=((100, 1001), (1, 500)), scale=30_000, length=101_000, new=False):
    return track(b"vide", box(codec, bytes(24), struct.pack(">HH", width, height), bytes(50)), scale, length, times, new)


def sound(codec=b"mp4a", channels=2, rate=44_100):
    return track(b"soun", box(codec, bytes(16), struct.pack(">HHHHI", channels, 16, 0, 0, rate << 16)), rate, rate * 3)


def movie(*tracks, scale=1000, length=3366, after=True, wide=False):
    moov = box(b"moov", head(b"mvhd", scale, length), *tracks, wide=wide)
    data = box(b"mdat", bytes(5000), wide=wide)
    return box(b"ftyp", b"isom", bytes(12)) + (data + moov if after else moov + data)


def test_media_files_are_indexed_from_their_boxes(spark, tmp_path):
    files = {
        "both": movie(video(), sound()), "first": movie(video(b"hvc1", new=True), sound(b"Opus", 1, 48_000), after=False, wide=True), "silent": movie(video(b"abcd")), "heard": movie(sound()),
        "still": movie(video(times=(), scale=0)), "frozen": movie(video(times=((5, 0),)), scale=0), "nothing": movie(), "other": movie(track(b"text", box(b"tx3g", bytes(20)), 1, 1), sound()),
        "cut": movie(video(), sound())[:-40], "broken": movie(video()).replace(b"mdia", b"mdia", 1)[: 5000 + 60] + b"\0\0\0\3moov", "text": b"no media at all, just text", "headless": box(b"ftyp", bytes(8)) + box(b"mdat", bytes(9)),
        "inner": box(b"ftyp", bytes(8)) + box(b"moov", struct.pack(">I4s", 999, b"mvhd")),
    }
    (tmp_path / "v").mkdir()
    for name, data in files.items():
        (tmp_path / "v" / f"{name}.mp4").write_bytes(data)
    listed = readers.list_media(spark, str(tmp_path))
    rows = {r["local_video_id"]: r for r in readers.index_media(listed, boxes.probe).collect()}
    assert set(rows) == set(files)
    both = rows["both"]
    assert (both["duration_sec"], both["has_video"], both["has_audio"], both["width"], both["height"], both["video_codec"], both["audio_codec"], both["sample_rate"], both["channels"], both["index_status"]) == (3.366, True, True, 640, 360, "h264", "aac", "44100", 2, "OK")
    assert abs(both["fps"] - 30_000 / 1001) < 1e-9
    assert (rows["first"]["video_codec"], rows["first"]["audio_codec"], rows["first"]["channels"]) == ("hevc", "opus", 1)
    assert (rows["silent"]["has_audio"], rows["silent"]["video_codec"], rows["silent"]["audio_codec"]) == (False, "abcd", None)
    assert (rows["heard"]["has_video"], rows["heard"]["width"], rows["heard"]["fps"]) == (False, None, None)
    assert rows["still"]["fps"] is None and rows["frozen"]["fps"] is None and rows["frozen"]["duration_sec"] == pytest.approx(101_000 / 30_000)
    assert (rows["nothing"]["has_video"], rows["nothing"]["has_audio"], rows["nothing"]["index_status"]) == (False, False, "OK")
    assert rows["other"]["has_audio"] and not rows["other"]["has_video"]
    said = {n: rows[n]["index_status"] for n in ("cut", "text", "headless", "inner")}
    assert said == {"cut": "ERROR: the description is cut off", "text": "ERROR: not a media file of boxes", "headless": "ERROR: no description in the file", "inner": "ERROR: a broken box at 0"}
    assert rows["broken"]["index_status"].startswith("ERROR: ") and rows["broken"]["duration_sec"] is None


def test_only_heads_and_the_description_are_fetched():
    class Watched:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.read_bytes += n
            return self.data[self.at : self.at + n]

    data = movie(video(), sound())
    file = Watched(data)
    assert json.dumps(boxes.described(boxes.description(file, len(data)))) and file.read_bytes < len(data) - 4900


def test_stages_start_at_the_first_changed_one(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/stages"
    spark.range(100).write.parquet(source)

    def go(factor=2, least=10):
        stages = Stages(spark, folder)
        read = lambda: spark.read.parquet(source)
        first = stages.run("doubled", lambda: read().select((F.col("id") * factor).alias("x")), {"factor": factor})
        second = stages.run("large", lambda: first.where(F.col("x") >= least))
        third = stages.run("counted", lambda: second.agg(F.count("*").alias("n")))
        return third.first()[0], stages.ran, stages.reused

    every = ["doubled", "large", "counted"]
    assert go() == (95, every, [])
    assert go() == (95, [], every)
    assert go(least=20) == (90, every[1:], every[:1])
    assert go(factor=3, least=20) == (93, every, [])
    spark.range(100, 110).write.mode("append").parquet(source)
    assert go(factor=3, least=20) == (103, every, [])
    assert go(factor=3, least=20) == (103, [], every)


def test_a_killed_stage_leaves_no_result(spark, tmp_path):
    folder = f"file://{tmp_path}/stages"

    @F.udf("long")
    def dies(x):
        raise RuntimeError("killed")

    for _ in range(2):
        stages = Stages(spark, folder)
        with pytest.raises(Exception, match="killed"):
            stages.run("one", lambda: spark.range(3).select(dies("id").alias("id")))
        assert stages.ran == [] and not (tmp_path / "stages/one/manifest.json").exists()
    (tmp_path / "stages/one").mkdir(parents=True, exist_ok=True)
    stages = Stages(spark, folder)
    assert stages.run("one", lambda: spark.range(3).toDF("id")).count() == 3 and stages.ran == ["one"]


def brute_count(word, vocabulary, most=100):
    if len(word) > most:
        return 1
    at = n = 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if ("##" if at else "") + word[at:end] in vocabulary:
                break
        else:
            return 1
        at, n = end, n + 1
    return n


def test_subword_counts_equal_brute_force(spark):
    rng = random.Random(9)
    vocabulary = {"".join(rng.choices("abcé", k=rng.randrange(1, 4))) for _ in range(30)} | {"##" + "".join(rng.choices("abcé", k=rng.randrange(1, 3))) for _ in range(12)} | {",", "##", "#"}
    words = ["".join(rng.choices("abcéx", k=rng.randrange(1, 12))) for _ in range(150)] + ["a" * 99, "a" * 101]
    texts = {k: "".join(rng.choice([" ", "  ", ",", "\n", " "]) + w for w in rng.choices(words, k=rng.randrange(9))) for k in range(80)} | {900: "", 901: "a##b", 902: None}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").withColumn("_word", F.lit(1))
    pieces = spark.createDataFrame([(p,) for p in vocabulary] + [(None,)], "piece string")
    found = {r["id"]: r["token_count"] for r in subwords.subword_counts(df, ["id"], "text", pieces).collect()}
    split = lambda t: (t or "").replace(" ", " ").replace(",", " , ").replace("#", " # ").split()
    assert found == {k: 2 + sum(brute_count(w, vocabulary) for w in split(t)) for k, t in texts.items()}


@pytest.mark.parametrize("most_sent", [0, 9, 60])
def test_vocabularies_of_any_size_count_alike(spark, monkeypatch, most_sent):
    """Doubled pieces are one; more distinct ones than are sent to the tasks are joined."""
    monkeypatch.setattr(subwords, "LARGEST", most_sent)
    rng = random.Random(4)
    vocabulary = {"".join(rng.choices("abcé", k=rng.randrange(1, 4))) for _ in range(20)} | {"##" + "".join(rng.choices("abcé", k=rng.randrange(1, 3))) for _ in range(12)} | {",", "##", "#"}
    words = ["".join(rng.choices("abcé", k=rng.randrange(1, 9))) for _ in range(60)] + ["x", "ax", "a" * 100, "a" * 101, "#", ","]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)] + [(900, None)], "id long, text string")
    pieces = spark.createDataFrame([(p,) for p in vocabulary] * 3 + [(None,)] * 99, "piece string")
    found = {r["id"]: r["token_count"] for r in subwords.subword_counts(df, ["id"], "text", pieces).collect()}
    assert found == {k: 2 + brute_count(w, vocabulary) for k, w in enumerate(words)} | {900: 2}
