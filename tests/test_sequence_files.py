"""Sequence files made by hand are read back equal, in all layouts; missing parts and faults are named."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from sessionweave.operators import align
from sessionweave.sources.container import Container, Unsupported
from sessionweave.sources.sequences import load_pair, read_sequence_file

from .hand_made import Maker


def rows_of(df):
    return {(r["source_id"], r["pos"]): (r["start"], r["end"], r["features"]) for r in df.collect()}


def words_file(path, below_root=True, sources=23):
    m, groups, wanted = Maker(), {}, {}
    for k in range(sources):
        times = np.arange(2 * (k + 1), dtype="<f8").reshape(-1, 2) / 4
        words = np.array([[f"wört{k}-{i}".encode()] for i in range(k + 1)], "S16")
        layout = [{}, {"chunk": (2, 1)}, {"chunk": (3, 1), "filters": (2, 1)}, {"compact": True}][k % 4]
        groups[f"video{k}"] = m.group({"intervals": m.dataset(times, **({"chunk": (2, 2), "filters": (1,)} if k % 2 else {})), "features": m.dataset(words, **layout)}, split=0 if k == 5 else None)
        wanted |= {(f"video{k}", i): (times[i, 0], times[i, 1], [f"wört{k}-{i}"]) for i in range(k + 1)}
    groups["no features"] = m.group({"intervals": m.dataset(np.zeros((1, 2), "<f8"))})
    groups["no group"] = m.dataset(np.zeros(3, "<i4"))
    data = m.group(groups, per_node=3)
    root = m.group({"data": data}) if not below_root else m.group({"a": m.group({}), "words": m.group({"data": data, "metadata": m.group({})})})
    return m.save(str(path), root), wanted


@pytest.mark.parametrize("below", [True, False])
def test_words_read_back_equal(spark, tmp_path, below):
    path, wanted = words_file(tmp_path / "words.csd", below)
    found = read_sequence_file(spark, path, 4)
    assert found.schema["features"].dataType.elementType.typeName() == "string"
    assert rows_of(found) == wanted and found.rdd.getNumPartitions() == 7
    assert rows_of(read_sequence_file(spark, f"file://{path}")) == wanted


def test_numbers_strings_of_any_length_and_newer_headers(spark, tmp_path):
    m, wanted = Maker(), {}
    labels = np.arange(21, dtype=">f4").reshape(3, 7)
    m_labels = labels.astype("<f4")
    groups = {"x": m.links({"intervals": m.dataset(np.array([[0, 1], [1, 2], [2, 4]], "<i8")), "features": m.dataset(m_labels, chunk=(2, 4), filters=(2, 1, 3))})}
    wanted = {("x", k): (float([0, 1, 2][k]), float([1, 2, 4][k]), labels[k].tolist()) for k in range(3)}
    groups["none"] = m.links({"intervals": m.dataset(np.zeros((0, 2), "<f8")), "features": m.dataset(np.zeros((0, 7), "<f4"))})
    path = m.save_new(str(tmp_path / "labels.csd"), m.links({"All Labels": m.links({"data": m.links(groups)})}))
    assert rows_of(read_sequence_file(spark, path)) == wanted
    m = Maker()
    said = [b"", "é字".encode(), b"long " * 100]
    one = m.group({"intervals": m.dataset(np.zeros((3, 2), "<f8")), "features": m.strings(said)})
    path = m.save(str(tmp_path / "strings.csd"), m.group({"data": m.group({"y": one})}))
    assert [v[2] for _, v in sorted(rows_of(read_sequence_file(spark, path)).items())] == [[s.decode()] for s in said]


def test_a_pair_of_files_is_aligned(spark, tmp_path):
    m = Maker()
    words = np.array([[b" hello "], [b"sp"], [b"there"]], "S8")
    one = m.group({"intervals": m.dataset(np.array([[0, 1], [1, 2], [2, 3]], "<f8")), "features": m.dataset(words)})
    first = m.save(str(tmp_path / "w.csd"), m.group({"data": m.group({"v": one, "only words": one})}))
    m = Maker()
    one = m.group({"intervals": m.dataset(np.array([[0, 1.5], [2.5, 9]], "<f8")), "features": m.dataset(np.arange(14, dtype="<f4").reshape(2, 7))})
    second = m.save(str(tmp_path / "l.csd"), m.group({"data": m.group({"v": one})}))
    said, labels = load_pair(spark, first, second)
    found = sorted(align.align_words(labels, said).collect())
    assert [(r["source_id"], r["label_idx"], r["text"], r["label"][0]) for r in found] == [("v", 0, "hello", 0.0), ("v", 1, "there", 7.0)]


def test_faults_are_named(spark, tmp_path):
    with pytest.raises(Exception, match="not found"):
        read_sequence_file(spark, str(tmp_path / "none.csd")).collect()
    with pytest.raises(Exception, match="not a file"):
        read_sequence_file(spark, str(tmp_path)).collect()
    (tmp_path / "text").write_text("no such thing " * 20)
    with pytest.raises(Exception, match="not a hierarchical data file"):
        read_sequence_file(spark, str(tmp_path / "text")).collect()
    m = Maker()
    with pytest.raises(Exception, match="no group 'data'"):
        read_sequence_file(spark, m.save(str(tmp_path / "empty.csd"), m.group({}))).collect()
    m = Maker()
    with pytest.raises(Exception, match="no sequences"):
        read_sequence_file(spark, m.save(str(tmp_path / "none.csd"), m.group({"data": m.group({})}))).collect()
    m = Maker()
    odd = m.header((0x01, struct.pack("<BBB5xQ", 1, 1, 0, 1)), (0x03, b"\x16\0\0\0" + struct.pack("<I", 8)), (0x08, struct.pack("<BBQQ", 3, 1, 8, 8)))
    with open(m.save(str(tmp_path / "odd.csd"), m.group({})), "rb") as file, pytest.raises(Unsupported, match="class 6"):
        Container(file).dataset(odd)
