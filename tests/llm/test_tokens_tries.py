"""Byte-level BPE, the divergence audit and the conversation tree: brute force, hard texts, ties, empty tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionweave.llm import byte_bpe, conversation_trie, divergence
from sessionweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, public_tokenizers.PATTERN, tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})


def same_ids(rows, texts, encoding):
    assert len(rows) == len(texts)
    for key, text in texts.items():
        assert np.frombuffer(rows[key]["ids"], "<u4").tolist() == encoding.encode_ordinary(text)
        assert bytes(rows[key]["decoded"]) == text.encode()


def test_ids_are_the_librarys_on_all_documents(spark, sf_dir, tokenizer):
    found = {r["doc_id"]: r for r in QUERIES["op11_byte_bpe"](spark, sf_dir).collect()}
    for key, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = tokenizer[2].encode_ordinary(text or "")
        wanted = (key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        row = found.pop(key)
        assert (row["doc_id"], row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == wanted
    assert not found


def test_ids_of_hard_texts_in_small_blocks(spark, tokenizer):
    rng = random.Random(5)
    marks = ["'s", "'LL", " ", "  ", "\n", "\t ", " ", "a", "Éa", "ß", "1", "٣", "½", "\U0001d7d8", "\U00010400", "😀", "𠀀", "՘", "࢏", "\U0001e5f1", "字", "-", "\x1c", "\x85", "​", "'", "<|endoftext|>"]
    texts = {k: "".join(rng.choices(marks, k=rng.randrange(60))) for k in range(300)}
    texts |= {900: "", 901: " \n\t " * 50, 902: "x" * 30_000, 903: "no space" * 4000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in byte_bpe.encode_and_decode(docs, *tokenizer[:2], block_bytes=2000, bucket_bytes=9000).collect()}
    same_ids(found, texts, tokenizer[2])


def test_long_texts_are_cut_where_pretokens_end(tokenizer, monkeypatch):
    monkeypatch.setattr(byte_bpe, "_STEP", 7)
    rng = random.Random(6)
    split = byte_bpe.PreTokens(tokenizer[1])
    for _ in range(200):
        text = "".join(rng.choices(["ab", " ", "  ", "\n", "12", "!", "'s", "\U0001d7d8", "é"], k=60))
        words = [w for ws in split(text) for w in ws]
        assert "".join(words) == text
        assert [i for w in words for i in tokenizer[2].encode_ordinary(w)] == tokenizer[2].encode_ordinary(text)


def test_null_repeated_and_odd_rows_of_bpe(spark, tokenizer):
    docs = spark.createDataFrame([(1, None, "x"), (1, "a b", "y"), (None, "a b", "z"), (2, "a b", None)], "doc_id long, text string, block string").withColumns({"ids": F.lit(1), "decoded": F.lit(2), "kind": F.lit(3)})
    found = byte_bpe.encode_and_decode(docs, *tokenizer[:2]).collect()
    ids = np.array(tokenizer[2].encode_ordinary("a b"), "<u4").tobytes()
    assert sorted((r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in found) == sorted([(1, b"", b""), (1, ids, b"a b"), (0, ids, b"a b"), (2, ids, b"a b")])
    assert byte_bpe.encode_and_decode(docs.limit(0), *tokenizer[:2]).collect() == []


def brute_audit(rows, least_docs, most_terms):
    counts, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in rows:
        words = divergence._TERM.findall((text or "").encode().lower())
        lang, source = lang or "", source or ""
        counts[lang, source].update(words)
        docs.update((lang, w) for w in set(words))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [w for (a, w), n in docs.items() if a == lang and n >= least_docs]
        count = {s: {w: counts[lang, s][w] for w in kept} for s in sources}
        count[None] = {w: sum(count[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept} for s, c in count.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s)
            terms = sorted((p[None][w] - p[s][w], w) for w in kept if count[s][w] and p[s][w] > p[None][w])[:most_terms]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)}
    return out


@pytest.mark.parametrize(("chunk", "block"), [(1024, 32), (3, 2)])
def test_divergence_equals_brute_force(spark, chunk, block):
    rng = random.Random(chunk)
    words = ["Alpha", "alpha", "été", "Été", "字", "x1y", "a-b", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", None, "s9"])) for _ in range(250)]
    rows += [("", "it", "only"), (None, "fr", "a"), ("mot", "fr", "b"), ("!!", "fr", "c")] + [("alpha " * 3000, "en", "s1")] * 3
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "chunk": F.lit(3), "v": F.lit(4)}).repartition(5)
    found = divergence.audit_sources(docs, 4, 3, chunk_of=chunk, block_of=block).collect()
    assert {tuple(r) for r in found} == brute_audit(rows, 4, 3) and len(found) == len(set(found))
    assert divergence.audit_sources(docs.limit(0)).collect() == []


def test_shares_are_exact_for_large_counts():
    for count, total in [(0, 7), (10**15, 10**15 + 12), (4 * 10**15 + 1, 9 * 10**15 - 1), (123456789012345, 987654321098765)]:
        assert int(divergence.shares(np.array([count], np.int64), total)[0]) == 1 + 10**9 * (count + 5) // total


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        whole = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    out = set()
    for node, found in members.items():
        inside = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in members) for n in inside)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in inside if n)
        children = sum(len(n) == len(node) + 1 for n in inside)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.add((min(found), len(node), min(members[node[:-1]]) if node else None, len(found), children, leaves, saved, digest))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_of(docs, **how):
    rows = conversation_trie.prefix_trie(docs, **how).select(*NODE).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def rebuild():
    return {"base": F.col("conv") - F.col("conv") % 100, "heads": F.crc32(F.col("conv").cast("string").cast("binary")) % 6, "most_heads": 5}


@pytest.mark.parametrize("span", [1024, 2])
def test_trie_equals_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(conversation_trie, "SPAN", span)
    monkeypatch.setattr(conversation_trie.running, "__defaults__", (False, span))
    rng = random.Random(span)
    rows = []
    for conv in [*rng.sample(range(400), 50), 0, 200]:
        for turn in rng.sample(range(30), rng.randrange(1, 9)):
            rows.append((conv, rng.choice([turn, turn, None, 3]), rng.choice(["user", "bot", None]), rng.choice(["a", "é字", "", None, "aa"])))
    rows += [(None, 1, "user", "lost")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("x"), "depth": F.lit(0), "owner": F.lit(1)}).repartition(4)
    assert trie_of(docs, **rebuild()) == brute_trie(rows)
    assert trie_of(docs) == brute_trie(rows, False)


def test_trie_of_growing_and_equal_conversations(spark):
    """Each conversation logged after every turn (a chain of chains), copies, and a long one."""
    rows = [(k, t, "u", f"turn {t}") for k in range(40) for t in range(k + 1)] + [(100 + k, t, "u", f"same {t % 3}") for k in range(30) for t in range(5)] + [(500, t, "u", "x") for t in range(1500)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = trie_of(docs)
    short = trie_of(docs.where("conv_id < 500"))
    assert short == brute_trie([r for r in rows if r[0] < 500], False)
    deep = {r for r in found if r[0] == 500}
    assert len(deep) == 1500 and {r[5] for r in deep} == {1} and found - deep >= {r for r in short if r[1] > 0}


def test_empty_trie(spark):
    docs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie_of(docs) == set() and trie_of(docs, **rebuild()) == set()
