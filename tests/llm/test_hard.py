"""Texts, keys and sizes that once broke an operator or took it quadratic time, and parts of the methods on their own."""

from __future__ import annotations

import random
import re
import time

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionweave.llm import common, decontamination, packing, quality_classifier, secret_scan, simhash, substring_dedup, suffix_dedup, url_filter, warc
from sessionweave.llm.queries import listed_urls, tokenizer_path

from .test_llm_queries import brute_components


def in_seconds(most, use):
    began = time.time()
    out = use()
    assert time.time() - began < most
    return out


def test_packing_tells_words_of_one_hash_apart():
    """Thue-Morse words and their complements collide in any polynomial hash modulo 2**64."""
    from tokenizers import Tokenizer

    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"{word} {other}", f"{other} x {word} {other}", word]
    ids, ends = packing.WordTokenizer(tokenizer_path(), 1).encode([t.encode() for t in texts])
    plain = Tokenizer.from_file(tokenizer_path())
    assert ids.tolist() == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 1]] and len(ends) == 3


def test_words_are_compared_byte_by_byte():
    rnd = random.Random(2)
    for _ in range(200):
        words = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 3, 7, 8, 9, 15, 16, 17, 30]))) for _ in range(60)]
        sizes = np.array([len(w) for w in words])
        first = np.cumsum(sizes + 1) - sizes - 1
        other = np.array([rnd.randrange(60) if rnd.random() < 0.5 else words.index(words[k]) for k in range(60)])
        found = packing._unlike(np.frombuffer(" ".join(words).encode(), np.uint8), first, first + sizes, other)
        assert found.tolist() == [k for k in range(60) if words[k] != words[other[k]]]


SECRET_PATTERNS = [
    (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 6),
    (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    (re.compile("[0-9a-f]+"), 0, 24),
    (re.compile("gh[opsu]_[A-Za-z0-9]{36}"), 0, 1),
    (re.compile("-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"), 0, 1),
]


def brute_secrets(text):
    found = [(m.start(), m.end(), k) for k, (p, group, least) in enumerate(SECRET_PATTERNS) for m in p.finditer(text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_secrets_match_regular_expressions():
    rnd, scanner = random.Random(1), secret_scan.Scanner()
    bits = ["password", "Secret", "token", "api_key", "apikey", "=", ": ", '"', "'", " ", "AKIA", "ABCD0123", "deadbeef0123", "0123456789abcdef", "é", "日", "ghp_", "abcdefghijklmnopqr", "XYZ", ",", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN ", "\n", "a", "f", "0"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert scanner.spans([text.encode(), b"x"]) == [brute_secrets(text), []]


@pytest.mark.parametrize("text", ["é password = 'abcdef1', " * 100_000, "a" * 1_000_000, "password" + " " * 1_000_000, "ghp_" * 250_000, "AKIA" * 250_000, "token:" * 100_000], ids=["finds", "hex", "blanks", "ghp", "AKIA", "token"])
def test_secrets_of_long_texts_take_linear_time(text):
    assert in_seconds(25, lambda: secret_scan.Scanner().spans([text.encode()])[0]) == brute_secrets(text)


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 1_000_000 + "\nb", "a" * 1_000_000, "a " * 300_000, "a, " * 300_000, "\n" * 1_000_000 + "x"], ids=["blanks", "gap", "word", "words", "marks", "lines"])
def test_sentences_of_long_texts_take_linear_time(text):
    cutter = substring_dedup.Spans(3, 14, 12)
    assert len(in_seconds(15, lambda: cutter.of([text.encode()]))[0]) <= max(1, len(text.split()))


def test_benchmark_in_many_blocks_gives_what_one_block_gives(spark):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice("abcde") for _ in range(n))
    items = spark.createDataFrame([(k, text(rnd.choice([1, 5, 13, 20]))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(rnd.choice([None, 1, 2]), text(rnd.randrange(60)), "en") for _ in range(50)], "doc_id long, text string, items string")
    one = decontamination.decontaminate(docs, items, carry=("text", "items"))
    many = decontamination.decontaminate(docs, items, carry=("text", "items"), most_windows=7)
    assert one.columns == many.columns == ["doc_id", "n_words", "n_hit", "spans", "items", "contaminated", "text"]  # the result named items, not the column
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_columns_to_carry_give_way_to_results(spark):
    docs = spark.createDataFrame([(1, "some words here", "s", 0.5)], "doc_id long, text string, spans string, score double")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert secret_scan.scan_secrets(docs, carry=("spans", "text", "score", "doc_id")).columns == ["doc_id", "spans", "text", "score"]
    found = quality_classifier.score_quality(docs, labels, carry=("score", "text", "spans"))
    assert found.columns == ["doc_id", "held_out", "score", "predicted", "text", "spans"] and found.first()["text"] == "some words here"


@pytest.mark.parametrize("widths", [{4: 10**9}, {2: 10**9}, {}], ids=["4", "2", "1"])
@pytest.mark.parametrize("dense", [64, 2])
def test_simhash_links_at_every_width(spark, monkeypatch, widths, dense):
    rnd = random.Random(9)
    prints = {}
    for k in range(40):
        seed = rnd.getrandbits(64)
        for j in range(4):
            prints[10 * k + j] = seed
            for b in rnd.sample(range(64), rnd.randrange(4)):
                seed ^= 1 << b
    prints |= {1000 + k: 1 << k for k in range(64)} | {2000: 0, 2001: (1 << 64) - 1, 2002: (1 << 63) - 1}
    monkeypatch.setattr(simhash, "WIDTHS", widths)
    monkeypatch.setattr(simhash, "DENSE_CELL", dense)
    rows = spark.createDataFrame([(d, p - (1 << 64) if p >> 63 else p) for d, p in prints.items()], "id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: rows)
    assert {r["doc_id"]: r["component"] for r in simhash.near_duplicates(rows).collect()} == brute_components(prints)


def test_archives_are_cut_by_key_whatever_the_keys_are(spark):
    """Negative and far-off keys: shards stay small, in order of key, and files are rolled; one hot key is split."""
    rnd = random.Random(6)
    keys = [-(2**62), 2**62, *range(400), *[7] * 200]
    rows = [(k, f"http://h/{j}", "".join(rnd.choice("abcdefgh") for _ in range(3000))) for j, k in enumerate(keys)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = common.scratch_path(spark, "archive")
    settings = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffleDependency.fileCleanup.enabled")}
    manifest = warc.write_warc(pages, path, "page_id", "url", "html", shard_bytes=100_000, roll_bytes=20_000).orderBy("file").collect()
    assert {k: spark.conf.get(k) for k in settings} == settings
    shards: dict[str, list] = {}
    for m in manifest:
        shards.setdefault(m["file"].split("-")[0], []).append(m)
    assert sum(m["records"] for m in manifest) == len(rows) and all(m["bytes"] <= 20_000 for m in manifest)
    assert len(shards) > 10 and max(len(s) for s in shards.values()) > 1
    assert all(sum(m["records"] for m in s) <= 80 for s in shards.values())  # about 30 rows are 100,000 bytes
    ends = [(min(m["first_key"] for m in s), max(m["last_key"] for m in s)) for _, s in sorted(shards.items())]
    ends = [e for e in ends if not 0 <= e[0] <= 7 <= e[1] <= 15]  # the step around the hot key is split by a hash
    assert len(ends) > 10
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert sorted((r["key"], r["url"], r["payload"].decode()) for r in warc.read_warc(spark, path).collect()) == sorted(rows)


def test_five_batches_added_one_by_one_equal_one_batch(spark):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "x", "y", "é"]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 60))) + rnd.choice(["", passage, passage[40:200], passage[:150] * 2]) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string")

    def covered(frames):
        out: dict[int, set] = {}
        for df in frames:
            for key, begin, end in df.collect():
                out.setdefault(key, set()).update(range(begin, min(end, len(texts[key].encode()))))
        return out

    one, five = suffix_dedup.SuffixIndex(40, 16), suffix_dedup.SuffixIndex(40, 16, most_contexts=5)
    wanted = covered([one.add(rows)])
    found = covered([five.add(rows.where(f"key >= {8 * k} and key < {8 * k + 8}")) for k in range(5)])
    assert [rank for rank, _ in five.levels] == [2, 0]  # five equal batches: four merged, one alone
    seen, brute = set(), {}
    for key, text in enumerate(texts):
        b = text.encode()
        for i in range(len(b) - 39):
            if b[i : i + 40] in seen:
                brute.setdefault(key, set()).update(range(i, i + 40))
            seen.add(b[i : i + 40])
    assert wanted == brute and found == brute
    with pytest.raises(ValueError):
        five.extend(rows)
    one.close(), five.close()


def test_levels_are_sorted_suffix_arrays(spark):
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcde ") for _ in range(4000))
    index = suffix_dedup.SuffixIndex(40, 16)
    index.extend(spark.createDataFrame([(0, text)], "key long, text string"))
    rows = index._entries(index.levels[0][1]).collect()
    ordered = sorted(rows, key=lambda r: tuple(r[c] for c in index.order))
    suffixes = [text.encode()[r["at"] : r["at"] + 16] for r in ordered]
    assert len(rows) > 100 and suffixes == sorted(suffixes)
    index.close()


def test_false_positives_of_the_filter_are_removed(spark, monkeypatch):
    """With one bit for a URL most URLs pass the filter; only listed ones are blocked, whatever is broadcast."""
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 1)
    listed = spark.range(2000).select(F.format_string("http://l.net/%d", "id").alias("url"))
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.format_string("http://www.l.net/%d/", F.col("id") * 2).alias("url"))
    for bound in (8 << 20, 0):
        found = url_filter.filter_urls(pages, listed, [], most_broadcast=bound)
        assert found.where("listed").count() == found.where("verdict = 'block'").count() == 1000 and found.where("possible").count() > 1500
        assert found.where("listed and not possible").count() == 0 and found.count() == 3000


def test_canonical_urls(spark):
    urls = {"http://www.a.net/x/": "a.net/x", "http://m.a.net/x/index.html": "a.net/x", "http://a.net/x.html": "a.net/x", "http://a.net/": "a.net", "http://a.net": "a.net", "http://ww.a.net/X": "ww.a.net/X"}
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    found = rows.select("url", url_filter.canonical_of(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("c")).collect()
    assert {r["url"]: r["c"] for r in found} == urls
    assert listed_urls(spark).distinct().count() == listed_urls(spark).count() == 2000 * 72


def test_rule_models(spark):
    """Every rule is a path of a tree, the weights meet the lasso's conditions, and the column scores as the model does."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality_classifier.STATISTICS)))
    y = ((x[:, 0] > 0.2) & (x[:, 1] < 0.5) | (x[:, 2] > 1)).astype(float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    rules, fitted = quality_classifier._tree(bins, cuts, y, 3, 5)
    for r in rules:  # its path but for the last step is a rule too (or the root), and so is the step's other side
        f, above, t = r[-1]
        assert (len(r) == 1 or r[:-1] in rules) and (*r[:-1], (f, not above, t)) in rules and all(t in cuts[f] for f, _, t in r)
    leaves = [r for r in rules if not any(o[: len(r)] == r and len(o) > len(r) for o in rules)]
    held = np.array([quality_classifier._holds(r, x) for r in leaves])
    assert (held.sum(axis=0) == 1).all() and all(np.allclose(fitted[h], y[h].mean()) for h in held)
    z = np.column_stack([quality_classifier._holds(r, x) for r in rules]).astype(float)
    z = np.unique(z, axis=1)
    w, b = quality_classifier.RuleModel._lasso(z, y, 5e-3, 20_000)
    slope = z.T @ (quality_classifier._sigmoid(z @ w + b) - y) / len(y)
    assert abs((quality_classifier._sigmoid(z @ w + b) - y).mean()) < 1e-4 and np.all(np.abs(slope) <= 5e-3 + 2e-4) and np.allclose(slope[np.abs(w) > 1e-3], -5e-3 * np.sign(w[np.abs(w) > 1e-3]), atol=2e-4)
    model = quality_classifier.RuleModel.fit(x, y)
    rows = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "k int, " + ", ".join(f"{s} double" for s in quality_classifier.STATISTICS))
    found = {r[0]: r[1] for r in rows.select("k", model.column()).collect()}
    assert 1 < len(model.rules) < len(rules) * 40 and np.allclose([found[k] for k in range(len(x))], model.predict(x), atol=1e-12)
    assert np.mean((model.predict(x) > 0.5) == y) > 0.97


def test_keys_follow_ids_then_texts(spark):
    rows = [("b", "x"), ("a", "y"), (None, "z"), ("a", "y"), ("a", None)]
    found = sorted(common.keyed(spark.createDataFrame(rows, "doc_id string, text string").repartition(3), "doc_id", "text").collect())
    assert [r["id"] for r in found] == [None, "a", "a", "a", "b"] and len({r["key"] for r in found}) == 5
    assert sorted((r["id"], r["text"]) for r in found if r["id"] == "a" and r["text"]) == [("a", "y")] * 2


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_empty_tables_give_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string")
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.dedup_substrings(docs).count() == secret_scan.scan_secrets(docs).count() == quality_classifier.score_quality(docs, labels).count() == 0
    assert url_filter.filter_urls(pages, pages.select("url"), []).count() == 0
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_pipeline_with_null_and_repeated_ids_loses_no_clean_text(spark, tmp_path, sf_dir):
    """The stages after the classifier: unlike texts stay, whatever their ids; each token is packed once."""
    texts = [" ".join(f"{w}{k}" for w in ("north", "south", "east", "west", "up", "down")) + "." for k in range(8)]
    docs = spark.createDataFrame([(None if k < 3 else 7 if k < 6 else k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(docs.where("doc_id is null"))  # copies without an id
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.clean_of_benchmark, corpus_pipeline.redact_secrets):
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert sorted(r["text"] for r in docs.collect()) == sorted(texts) and docs.columns == list(corpus_pipeline.COLUMNS)
    packed = corpus_pipeline.pack(spark, docs, "")
    assert sorted(r[0] for r in packed.where("start = 0").select("doc_tokens").collect()) == sorted(r[0] for r in packed.groupBy("doc_id", "ids_crc32").agg(F.first("doc_tokens")).select(F.col("first(doc_tokens)")).collect())


@pytest.mark.parametrize("where", ["end", "start", "both"])
def test_many_windows_that_are_alike(where):
    """Windows of one ending or one beginning in a text that is full of them: as fast as others, and all found."""
    import time

    from sessionweave.llm.decontamination import Windows

    common = "this closing phrase is shared by every item of the set".split()
    middle = lambda k: [f"w{k}"] if where != "both" else [f"w{k}", "x"]
    cut = {"end": lambda k: [*middle(k), *common, "end"], "start": lambda k: [*common, "end", *middle(k)], "both": lambda k: [*common[:5], *middle(k), *common[5:]]}[where]
    patterns = [" " + " ".join(cut(k)) + " " for k in range(60_000)]
    tables = Windows({p.encode(): {str(k)} for k, p in enumerate(patterns)} | {b" this closing ": {"short"}, b" phrase is ": {"inner"}})
    text = " ".join(p.strip() for p in patterns[: (1 << 20) // len(patterns[0])])
    began = time.process_time()
    counts, found = tables.search([text.encode(), b"w1 this closing phrase", b"closing"])
    assert time.process_time() - began < 2
    n = (1 << 20) // len(patterns[0])
    assert found[0][1] == {"inner", "short", *map(str, range(n))} and found[1][1] == {"short"} and set(found) == {0, 1}
    assert found[0][0] == [(0, counts[0])]


def test_windows_that_start_with_others():
    from sessionweave.llm.decontamination import WuManber

    patterns = [b" a b c d ", b" a b c d e ", b" a b c d e f ", b" a b c d x ", b" b c d e f "]
    text = b" a b c d e f a b c d e a b c d " + b"\0" * 8
    found = sorted(WuManber(patterns).find(text))
    wanted = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
    assert found == wanted
