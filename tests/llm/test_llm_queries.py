"""The training-data queries against SQL or brute force, at the smallest scale."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from sessionweave.llm.queries import ORACLES, QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name])


def check_pieces(rows, ids):
    """Every id in one piece, digests right, sequences gapless and at most 2048 long; gives the share of padding."""
    for doc, own in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own) and zlib.crc32(own[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(own)
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return 1 - sum(r["length"] for r in rows) / (2048 * len(sequences))


def token_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return {k: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts.items()}


def test_packing_covers_every_id(spark, sf_dir, documents):
    rows = QUERIES["op2_packing"](spark, sf_dir).collect()
    assert check_pieces(rows, token_ids(documents)) < 0.01


def brute_fingerprint(text):
    import xxhash

    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_shingles(text, words=5):
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def similar(a, b):
    """Jaccard similarity of 0.8 or more."""
    return 10 * len(a & b) >= 8 * len(a | b)


def brute_components(prints, linked=lambda a, b: (a ^ b).bit_count() <= 2):
    component = {d: d for d in prints}

    def root(d):
        while component[d] != d:
            d = component[d]
        return d

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(prints[a], prints[b]):
                x, y = sorted((root(a), root(b)))
                component[y] = x
    return {d: root(d) for d in ids}


def test_simhash_matches_all_pairs(spark, sf_dir, documents):
    found = {r["doc_id"]: r for r in QUERIES["op4_simhash"](spark, sf_dir).collect()}
    prints = {d: brute_fingerprint(t) for d, t in documents.items()}
    wanted = brute_components(prints)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in found.items()} == {d: (f"{prints[d]:016x}", wanted[d]) for d in prints}


def test_suffixes_match_all_windows(spark, sf_dir, documents):
    seen, wanted = set(), {}
    for d, t in sorted(documents.items()):
        b = t.encode()
        out = np.zeros(len(b), bool)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                out[i : i + 100] = True
            seen.add(w)
        runs = int(np.count_nonzero(out & ~np.concatenate([[False], out[:-1]]))) if len(b) else 0
        wanted[d] = (len(b), int(out.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~out].tobytes()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op7_suffix_dedup"](spark, sf_dir).collect()} == wanted


def test_classifier_ranks_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r for r in QUERIES["op10_quality_classifier"](spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    held = [(scored[r["doc_id"]], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(s["held_out"] for s, _ in held) and all(0 <= s["score"] <= 1 and s["predicted"] == (s["score"] >= 0.3) for s in scored.values())
    good, bad = [s["score"] for s, q in held if q], [s["score"] for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_pipeline_matches_its_stages_by_brute_force(spark, sf_dir, documents):
    import corpus_pipeline as p
    from sessionweave.llm.decontamination import words_of
    from sessionweave.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = written(p.quality(spark, docs, sf_dir), "t")
    kept = {r["doc_id"] for r in QUERIES["op10_quality_classifier"](spark, sf_dir).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and good.columns == list(p.COLUMNS)
    single = written(p.near_duplicates(spark, good, sf_dir), "t")
    wanted = {d for d, c in brute_components({d: brute_shingles(documents[d]) for d in kept}, similar).items() if d == c}
    assert {r["doc_id"] for r in single.collect()} == wanted
    clean = written(p.clean_of_benchmark(spark, single, sf_dir), "t")
    items = [words_of((r[0] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()]
    windows = {tuple(w[i : i + 13]) for w in items if w for i in range(max(1, len(w) - 12))}
    for d in sorted(wanted):
        w = words_of(documents[d].encode())
        hit = set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
        if hit and 20 * len(hit) >= len(w):
            wanted = wanted - {d}
    assert {r["doc_id"] for r in clean.collect()} == wanted
    safe = p.redact_secrets(spark, clean, sf_dir).select("doc_id", "text", "n_chars").collect()
    spans = {r["doc_id"]: r["spans"] for r in QUERIES["op6_secret_scan"](spark, sf_dir).collect()}
    for r in safe:
        assert (r["text"] == documents[r["doc_id"]]) == (spans[r["doc_id"]] == "") and (spans[r["doc_id"]] == "" or r["n_chars"] == len(r["text"]))
    check_pieces(p.run(spark, sf_dir).collect(), token_ids({r["doc_id"]: r["text"] for r in safe}))
