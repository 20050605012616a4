"""The training-data queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_trie, decontamination, divergence, packing, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, suffix_dedup, url_filter, warc
from .common import scratch_path, table

BASE_KINDS = ("assign", "access", "hex")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), F.col("component").alias("component_id"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_warc(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    return warc.read_warc(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def _joined(spans: F.Column) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def _of(spans: str, *kinds: str) -> F.Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    counts = [F.size(_of("spans", k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = _of("spans", *BASE_KINDS)
    return out.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Verdict, host and path prefix.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Names, domains and sections of the listed sites. The list has each section's first LISTED_PAGES pages.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = ("example.com", "example.net", "example.org")
LISTED_SECTIONS = ("en", "de", "fr", "es")
LISTED_PAGES = 2000


def listed_urls(spark: SparkSession) -> DataFrame:
    """The block list, a table of its own whatever the pages are."""
    each = lambda names: F.explode(F.array(*map(F.lit, names)))
    sites = spark.range(LISTED_PAGES).select("id", each(LISTED_NAMES).alias("name")).select("*", each(LISTED_DOMAINS).alias("domain")).select("*", each(LISTED_SECTIONS).alias("section"))
    return sites.select(F.format_string("https://www.%s.%s/%s/%d", "name", "domain", "section", "id").alias("url"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, listed_urls(spark), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("conv") - F.col("conv") % 100
    heads = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"), base=base, heads=heads, most_heads=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_packing": op2_packing,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_warc": op5_warc,
    "op6_secret_scan": op6_secret_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_trie": op13_conversation_trie,
}

#: The words of a text by the contamination rule.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length
_RULES = [
    ("assign", _ASSIGN, 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("forge", "gh[opsu]_[A-Za-z0-9]{36}", 0, 1),
    ("private_key", "-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 0, 1),
]


def _secrets_sql() -> str:
    found = " union all ".join(
        f"""select doc_id, '{kind}' as kind, {rank} as rank, length(v) as v, length(m) as n, sum(length(p) + length(m)) over (partition by doc_id order by k) - length(m) as a
        from (select doc_id, unnest(range(1, len(m) + 1)) as k, unnest(m) as m, unnest(v) as v, unnest(p[1:len(m)]) as p
        from (select doc_id, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {group}) as v, string_split_regex(text, '{pattern.replace("([A-Za-z0-9+/_.=-]+)", "[A-Za-z0-9+/_.=-]+")}') as p from docs))"""
        for rank, (kind, pattern, group, _) in enumerate(_RULES)
    )
    least = " ".join(f"when '{kind}' then {n}" for kind, _, _, n in _RULES)
    base = "kind in ('assign', 'access', 'hex')"
    join = "string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, rank)"
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE_KINDS)
    return f"""with docs as (select doc_id, coalesce(text, '') as text from documents),
    spans as (select doc_id, kind, rank, a::bigint as a, n::bigint as n from ({found}) where v >= case kind {least} end)
    select doc_id, {counts}, sha256(coalesce({join} filter (where {base}), '')) as base_sha256, coalesce({join}, '') as spans
    from docs left join spans using (doc_id) group by doc_id"""


def _rules_sql() -> str:
    """Repeats of at least ten words cover what ten-word windows found twice cover; one over 200 words holds a 201-word window twice."""
    gram = "array_to_string(w[k:k + {n} - 1], ' ')"
    def windows(n: int, source: str) -> str:
        return f"""select doc_id, {n} as n, unnest(ks) as k from (select doc_id, list(k) as ks
        from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) as k from {source} where len(w) >= {n}) group by doc_id, {gram.format(n=n)} having count(*) > 1)"""

    def words(windows: str) -> str:
        return f"select doc_id, n, count(distinct j) as words from (select doc_id, n, unnest(range(k, k + n)) as j from ({windows})) group by doc_id, n"

    return rf"""with docs as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    shorter as ({words(windows(3, "docs") + " union all " + windows(10, "docs"))}),
    covered as (select * from shorter union all {words(windows(201, "(select docs.* from docs join shorter s on s.doc_id = docs.doc_id and s.n = 10 and s.words > 200)"))}),
    lines as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
    base as (select doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(lines.n, 0)::bigint as n_dup_lines,
        coalesce(c3.words, 0)::bigint as n_repeat_words, coalesce(c10.words, 0) as in_repeats, c201.words is not null as long_repeat
        from docs left join lines using (doc_id) left join covered c3 on c3.doc_id = docs.doc_id and c3.n = 3
        left join covered c10 on c10.doc_id = docs.doc_id and c10.n = 10 left join covered c201 on c201.doc_id = docs.doc_id and c201.n = 201),
    judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and not (in_repeats > 0.3 * n_words or long_repeat) as kept from judged"""


def _urls_sql() -> str:
    host = rf"translate(regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = rf"regexp_extract(coalesce(url, ''), '{url_filter.PARTS}', 2)"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then" for _, h, p in ordered]
    rule = " ".join(f"{f} '{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    words = lambda names: "unnest([" + ", ".join(f"'{n}'" for n in names) + "])"
    return rf"""with parts as (select page_id, {host} as host, {path} as path from pages),
    named as (select *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/index)?(\.html)?/*$', '') as canonical from parts),
    listed as (select name || '.' || domain || '/' || section || '/' || id as canonical from (select unnest(range(0, {LISTED_PAGES})) as id) cross join (select {words(LISTED_NAMES)} as name)
        cross join (select {words(LISTED_DOMAINS)} as domain) cross join (select {words(LISTED_SECTIONS)} as section))
    select page_id, host, path, case {rule} end as rule,
        case {verdict} when host <> '' and canonical in (select canonical from listed) then 'block' else 'allow' end as verdict from named"""


def _substrings_sql(run: int = 3, least_words: int = 14, most_words: int = 12) -> str:
    """Sentences come from a regular expression; of long ones, each word that has the least MD5 of some most_words neighbours ends a piece."""
    space = r" \t\n\r\f\x0B"
    sentence = rf"[{space}]*(?:[^{space}]*[^{space}.,;:!?|][ \t]+)*[^{space}]+[{space}]*"
    word = rf"[{space}]*[^{space}]+[{space}]*"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""with docs as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '{sentence}') as s from documents),
    said as (select doc_id, unnest(range(1, len(s) + 1)) as j, unnest(s) as sentence from docs),
    split as (select doc_id, j, regexp_extract_all(sentence, '{word}') as w from said),
    hashed as (select *, list_transform(w, lambda x: md5(trim(x, {blanks}))[:16]) as h from split),
    ends as (select doc_id, j, w, case when len(w) <= {most_words} then [len(w)] else list_sort(list_distinct(list_append(
        list_transform(range(1, len(w) - {most_words - 2}), lambda i: i - 1 + list_position(h[i:i + {most_words - 1}], list_min(h[i:i + {most_words - 1}]))), len(w)))) end as e from hashed),
    parts as (select doc_id, j, unnest(range(1, len(e) + 1)) as i, unnest(list_transform(range(1, len(e) + 1), lambda i: array_to_string(w[(case when i = 1 then 0 else e[i - 1] end) + 1:e[i]], ''))) as raw,
        unnest(list_transform(range(1, len(e) + 1), lambda i: e[i] - case when i = 1 then 0 else e[i - 1] end)) as words from ends),
    pieces as (select doc_id, row_number() over (partition by doc_id order by j, i) as k, raw, trim(raw, {blanks}) as piece, words, count(*) over (partition by doc_id) as n,
        sum(words) over (partition by doc_id order by j, i) as upto, sum(words) over (partition by doc_id) as total from parts),
    near as (select a.doc_id, a.k, b.k as e, a.n, a.upto - a.words as before, b.upto as upto from pieces a join pieces b on a.doc_id = b.doc_id and b.k >= a.k + {run - 1} and b.k <= a.k + {max(run, least_words)}
        where a.n >= {run} and a.total >= {least_words}),
    fits as (select * from near where upto - before >= {least_words}),
    spans as (select doc_id, k, min(e) as e from fits group by doc_id, k union select doc_id, max(k), e from fits group by doc_id, e
        union select doc_id, 1, n from pieces where n < {run} or total < {least_words}),
    lists as (select doc_id, list(piece order by k) as b from pieces group by doc_id),
    said_spans as (select s.doc_id, k, e, array_to_string(b[k:e], chr(10)) as span from spans s join lists using (doc_id)),
    later as (select doc_id, k, e from (select *, row_number() over (partition by span order by doc_id, k) as r from said_spans) where r > 1),
    gone as (select distinct doc_id, unnest(range(k, e + 1)) as k from later),
    left_over as (select p.doc_id, string_agg(raw, '' order by p.k) filter (where g.k is null) as kept, count(*) as n, count(g.k) as lost from pieces p left join gone g on g.doc_id = p.doc_id and g.k = p.k group by p.doc_id)
    select d.doc_id, case when coalesce(lost, 0) = 0 then d.text else coalesce(kept, '') end as text, coalesce(n, 0)::bigint as n_sentences, coalesce(lost, 0)::bigint as n_removed from docs d left join left_over l on l.doc_id = d.doc_id"""


def _warc_sql() -> str:
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v{g} >> {35 - 5 * k}) & 31)::int + 1, 1)" for g in range(4) for k in range(8))
    parts = ", ".join(f"('0x' || substr(sha1(payload), {10 * g + 1}, 10))::bigint as v{g}" for g in range(4))
    return f"""with records as (select *, min(page_id) over (partition by payload) as first, {parts} from (select page_id, coalesce(html, '') as payload from pages))
    select page_id, strlen(payload)::bigint as payload_bytes, {letters} as payload_digest,
        case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from records"""


def _divergence_sql(least_docs: int = 30, most_terms: int = 50) -> str:
    share = "1 + (1000000000::hugeint * ({n} + 5)) // ({total} + 5 * v)"
    return rf"""with docs as (select row_number() over () as k, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    words as (select k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
    counts as (select lang, source, term, count(*) as n, count(distinct k) as docs from words group by all),
    kept as (select lang, term, sum(n) as in_lang from counts group by all having sum(docs) >= {least_docs}),
    langs as (select lang, count(*) as v, sum(in_lang) as lang_total from kept group by all),
    groups as (select distinct lang, source from docs),
    entries as (select lang, term, source, n, in_lang from counts join kept using (lang, term)),
    sizes as (select g.lang, g.source, coalesce(sum(n), 0) as total from groups g left join entries e on e.lang = g.lang and e.source = g.source group by all),
    cells as (select s.lang, s.source, k.term, {share.format(n="coalesce(e.n, 0)", total="s.total")} as p
        from sizes s join langs using (lang) join kept k on k.lang = s.lang left join entries e on e.lang = s.lang and e.source = s.source and e.term = k.term),
    sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as f from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    terms as (select lang, source, 'term' as part, term as item, ({share.format(n="n", total="total")} - ({share.format(n="in_lang", total="lang_total")}))::bigint as value
        from entries join sizes using (lang, source) join langs using (lang)),
    ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as r from (select * from pairs union all select * from terms where value > 0))
    select lang, source, part, item, value, r::int as rank from ranked where part = 'pair' or r <= {most_terms}"""


def _trie_sql() -> str:
    """crc32 by its definition; a node is named by a digest of its turns' digests."""
    shift = "list_reduce([a::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda d: ascii(d)::bigint)), lambda s, b: {shift.replace('a::bigint', 'xor(s, b)')}), 4294967295)"
    return f"""with turns as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as k, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    convs as (select c, n, c - c % 100 as base, {crc} % 6 as h from (select c, count(*) as n from turns group by c)),
    grafts as (select a.c, a.n, a.base, a.h, coalesce(least(a.h, b.n), 0) as g from convs a left join convs b on b.c = a.base),
    rebuilt as (select g.c, t.k as d, role, text from grafts g join turns t on t.c = g.base and t.k <= g.g union all select g.c, t.k - h + g.g, role, text from grafts g join turns t on t.c = g.c and t.k > g.h),
    said as (select c, d, length(text) as chars, md5(length(role) || ':' || role || text) as m from rebuilt),
    prefixes as (select c, d, chars, md5(string_agg(m, '') over (partition by c order by d)) as key from said union all select c, 0, 0, '' from convs),
    nodes as (select key, d, min(c) as owner, count(*) as n, min(chars) as chars from prefixes group by key, d),
    lengths as (select c, max(d) as d from prefixes group by c),
    parents as (select n.key, n.d, p.key as up, q.owner as parent from nodes n join prefixes p on p.c = n.owner and p.d = n.d - 1 join nodes q on q.key = p.key and q.d = p.d),
    children as (select up as key, d - 1 as d, count(*) as k from parents group by all),
    ends as (select p.key, p.d, string_agg(p.c::varchar, ',' order by p.c) as ids from lengths l join prefixes p on p.c = l.c and p.d = l.d group by all),
    sums as (select p.key, p.d, sum((n.n - 1) * n.chars) as saved, count(*) filter (where k is null) as leaves
        from nodes n left join children k on k.key = n.key and k.d = n.d join prefixes p on p.c = n.owner and p.d <= n.d group by all)
    select owner as conv_id, n.d::bigint as depth, parent as parent_conv_id, n.n::bigint as n_convs, coalesce(k, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens,
        sha256(coalesce(ids, '')) as ends_sha256
    from nodes n join sums s on s.key = n.key and s.d = n.d left join parents p on p.key = n.key and p.d = n.d left join children c on c.key = n.key and c.d = n.d left join ends e on e.key = n.key and e.d = n.d"""


ORACLES: dict[str, str] = {
    "op1_substring_dedup": _substrings_sql(),
    "op3_decontamination": f"""with windows as (
        select distinct item_id::varchar as item, len(w) as size, array_to_string(w, ' ') as words from (
            select item_id, unnest(case when len(w) = 0 then [] when len(w) < 13 then [w] else list_transform(range(1, len(w) - 11), lambda k: w[k:k + 12]) end) as w
            from (select item_id, {_WORDS} as w from benchmark))),
    docs as (select doc_id, {_WORDS} as w from documents),
    grams as (select doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') as words from (
        select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from docs, (select distinct size from windows))),
    hits as (select doc_id, k, g.size, item from grams g join windows using (size, words)),
    covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(k, k + size)) as j from hits) group by doc_id),
    named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc_id)
    select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
        sha256(coalesce(items, '')) as items_sha256, coalesce(n, 0) > 0 and 20 * coalesce(n, 0) >= len(w) as contaminated
    from docs left join covered using (doc_id) left join named using (doc_id)""",
    "op5_warc": _warc_sql(),
    "op6_secret_scan": _secrets_sql(),
    "op8_quality_rules": _rules_sql(),
    "op9_url_filter": _urls_sql(),
    "op12_source_divergence": _divergence_sql(),
    "op13_conversation_trie": _trie_sql(),
}
