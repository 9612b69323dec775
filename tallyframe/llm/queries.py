"""The registered queries of this folder, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bpe, chat, fim, fingerprint, language, mixing, packing, pii, quality, sharding, simhash, urls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


# --- 5: mixing -------------------------------------------------------------------------------

@query
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


ORACLES["op5_source_mix"] = r"""
WITH docs AS (
    SELECT doc_id, source,
        CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))), 1, 15) AS BIGINT) AS k
    FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
    FROM sources
), ordered AS (
    -- sources reach their cap in this order as the common rate rises
    SELECT *,
        coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
        sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
        sum(source_size) OVER () AS total
    FROM weighed
), rates AS (
    SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - 2.0::DOUBLE * CAST(earlier AS DOUBLE)) / left_w AS rate FROM ordered
), goal AS (
    SELECT source, source_size, least(2.0::DOUBLE * source_size, (SELECT max(rate) FROM rates) * w) AS target FROM rates
), parts AS (
    SELECT source, source_size, target,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times
    FROM goal
), by_key AS (
    SELECT source, k, CAST(sum(size) AS BIGINT) AS n FROM docs GROUP BY source, k
), running AS (
    SELECT source, k, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY k) AS BIGINT) AS upto FROM by_key
), more AS (
    SELECT r.source, r.k, CASE
        WHEN r.upto <= p.target - p.times * p.source_size THEN 1
        WHEN r.upto - r.n <= p.target - p.times * p.source_size
            AND r.upto - (p.target - p.times * p.source_size) < (p.target - p.times * p.source_size) - (r.upto - r.n) THEN 1
        ELSE 0 END AS extra
    FROM running r JOIN parts p ON r.source IS NOT DISTINCT FROM p.source
)
SELECT d.doc_id, d.size, p.source_size, p.target, CAST(d.size * (p.times + m.extra) AS BIGINT) AS taken
FROM docs d
JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
JOIN more m ON d.source IS NOT DISTINCT FROM m.source AND d.k = m.k
"""


# --- 10: URL filters -------------------------------------------------------------------------

#: The rules of the contract: host, path, verdict.
URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)
#: Names of sites whose pages make up the list.
LISTED_SITES = ("adult-x", "ads-track", "cheap-pills", "free-bets", "spam-farm")


@query
def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules first, then the list of the URLs of known bad sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    site = F.element_at(F.split(F.regexp_replace(urls.host(F.col("url")), r"^(www|m|blog)\.", ""), r"\."), 1)
    listed = pages.filter(site.isin(*LISTED_SITES)).select("url")
    return urls.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op10_url_verdicts"] = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS asked
    FROM cut
), named AS (
    SELECT *, list_sort(list_filter(string_split(asked, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS kept
    FROM parts
), keyed AS (
    SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '')
        || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS k,
        split_part(regexp_replace(host, '^(www|m|blog)\.', ''), '.', 1) AS site
    FROM named
), listed AS (
    SELECT DISTINCT k FROM keyed WHERE site IN ('adult-x', 'ads-track', 'cheap-pills', 'free-bets', 'spam-farm')
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
        END AS rule
    FROM keyed
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN k IN (SELECT k FROM listed WHERE k IS NOT NULL) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""


# --- 6: near copies by SimHash ---------------------------------------------------------------

@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at three differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words_in_shingle=3, radius=3)


# --- 1: packing ------------------------------------------------------------------------------

@query
def op1_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents in sequences of 2048 tokens; a checksum stands for the ids."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), limit=2048)


# --- 8: quality rules ------------------------------------------------------------------------

@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the two fixed rules, and thresholds per language and source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rated = quality.rate(docs, least_words=20, most_repeats=30, least_rows=30, reach=5)
    return rated.drop("n_lines", "n_capitals", "n_echoes")


ORACLES["op8_quality"] = r"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, text,
        CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS lang, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS source,
        coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(w[i : i + 7], ' ') AS v
    FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM split WHERE len(w) >= 8)
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM windows) WHERE c > 1
), covered AS (
    SELECT r, count(DISTINCT i + j) AS n FROM again, (SELECT unnest(range(0, 8)) AS j) GROUP BY r
), counted AS (
    SELECT s.r, doc_id, lang, source, len(w) AS n_words,
        length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
        length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_capitals,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echoes
    FROM split s LEFT JOIN covered c ON s.r = c.r
), rated AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        100 * word_chars // greatest(n_words, 1) AS word_length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
        1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
        1000 * n_capitals // greatest(word_chars, 1) AS capitals, 1000 * n_echoes // greatest(n_words, 1) AS echoes
    FROM counted
), long AS (
    SELECT r, lang, source, u.measure, u.v FROM rated,
        unnest([{'measure': 'word_length', 'v': word_length}, {'measure': 'symbols', 'v': symbols}, {'measure': 'dup_lines', 'v': dup_lines},
            {'measure': 'capitals', 'v': capitals}, {'measure': 'echoes', 'v': echoes}, {'measure': 'n_words', 'v': n_words},
            {'measure': 'n_lines', 'v': n_lines}, {'measure': 'word_chars', 'v': word_chars}]) AS t(u)
    WHERE NOT base_failed
), bins AS (
    SELECT *, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS b FROM long
), ranked AS (
    SELECT 1 AS level, lang, source, measure, b, row_number() OVER (PARTITION BY lang, source, measure ORDER BY b) AS k, count(*) OVER (PARTITION BY lang, source, measure) AS n FROM bins
    UNION ALL SELECT 2, lang, NULL, measure, b, row_number() OVER (PARTITION BY lang, measure ORDER BY b), count(*) OVER (PARTITION BY lang, measure) FROM bins
    UNION ALL SELECT 3, NULL, NULL, measure, b, row_number() OVER (PARTITION BY measure ORDER BY b), count(*) OVER (PARTITION BY measure) FROM bins
), quartiles AS (
    SELECT level, lang, source, measure, max(n) AS n, min(b) FILTER (4 * k >= n) AS q1, min(b) FILTER (4 * k >= 2 * n) AS q2, min(b) FILTER (4 * k >= 3 * n) AS q3
    FROM ranked GROUP BY ALL
), fences AS (
    SELECT q.*, greatest(q.q3 - q.q1, (m.k + greatest(d.q2, 1) - 1) // greatest(d.q2, 1)) AS spread
    FROM quartiles q
    JOIN (VALUES ('word_length', 'n_words', 100), ('symbols', 'n_words', 1000), ('dup_lines', 'n_lines', 1000),
        ('capitals', 'word_chars', 1000), ('echoes', 'n_words', 1000)) m(measure, size, k) ON m.measure = q.measure
    JOIN quartiles d ON d.measure = m.size AND d.level = q.level AND d.lang IS NOT DISTINCT FROM q.lang AND d.source IS NOT DISTINCT FROM q.source
), outside AS (
    SELECT DISTINCT l.r FROM long l
    LEFT JOIN fences a ON a.level = 1 AND a.lang = l.lang AND a.source = l.source AND a.measure = l.measure AND a.n >= 30
    LEFT JOIN fences b ON b.level = 2 AND b.lang = l.lang AND b.measure = l.measure AND b.n >= 30
    JOIN fences c ON c.level = 3 AND c.measure = l.measure
    WHERE v < coalesce(a.q1 - 5 * a.spread, b.q1 - 5 * b.spread, c.q1 - 5 * c.spread)
        OR v > coalesce(a.q3 + 5 * a.spread, b.q3 + 5 * b.spread, c.q3 + 5 * c.spread)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND r NOT IN (SELECT r FROM outside) AS kept
FROM rated
"""


# --- 2: document fingerprints ----------------------------------------------------------------

@query
def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk digests of each text and its edited text, and their containment."""
    return fingerprint.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


# --- 3: language identification --------------------------------------------------------------

@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text by a network that learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


# --- 7: personal data ------------------------------------------------------------------------

@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for what identifies people."""
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), key="an example key")


# --- 9: sharding -----------------------------------------------------------------------------

SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.place(docs, SHARDS).select("doc_id", "slot", "shard")


# The table's filling takes turns, which SQL can't say well; its owners are given as letters. Tests hold them against a plain version.
ORACLES["op9_sharding"] = rf"""
WITH slots AS (
    SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || coalesce(text, ''))), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot
    FROM documents
)
SELECT doc_id, CAST(slot AS INTEGER) AS slot,
    'shard-' || lpad(CAST(ascii(substr('{"".join(chr(64 + i) for i in sharding.fill(SHARDS))}', slot + 1, 1)) - 64 AS VARCHAR), 3, '0') AS shard
FROM slots
"""


# --- 4: chat formatting ----------------------------------------------------------------------

@query
def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that no other one continues, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


ORACLES["op4_chat"] = r"""
WITH placed AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text) AS k FROM conversations
    WHERE conv_id IS NOT NULL
), whole AS (
    SELECT conv_id, count(*) AS n, list(struct_pack(r := role, t := text) ORDER BY k) AS told FROM placed GROUP BY conv_id
), single AS (
    SELECT n, told, min(conv_id) AS conv_id FROM whole GROUP BY n, told
), beginnings AS (
    SELECT DISTINCT k AS n, told[1 : k] AS told FROM (SELECT told, unnest(range(1, n)) AS k FROM whole)
), staying AS (
    SELECT s.conv_id FROM single s ANTI JOIN beginnings b ON s.n = b.n AND s.told = b.told
)
SELECT conv_id, CAST((k - 1) // 512 AS INTEGER) AS part, count(*) AS turns,
    string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
FROM placed WHERE conv_id IN (SELECT conv_id FROM staying) GROUP BY ALL
"""


# --- 11: fill in the middle ------------------------------------------------------------------

@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the texts with their middle at the end, and what they are taken back to, by digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fim.restore(fim.transform(docs, rate=50, spm=80, seed=42))
    digests = [F.sha2(c, 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op11_fill_in_middle"] = r"""
WITH drawn AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), numbers AS (
    SELECT *, len(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM drawn
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT *, array_to_string(t[1 : a], '') AS p, array_to_string(t[a + 1 : b], '') AS m, array_to_string(t[b + 1 :], '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
    CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


# --- 12: filter interaction audit ------------------------------------------------------------

@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes at each step of all their orders, for each source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(docs, table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = r"""
WITH split AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
        min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
    FROM documents
), told AS (
    SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
        + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS INT)
        + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(s.doc_id > first, false) AS INT) AS bits
    FROM split s LEFT JOIN told t ON s.doc_id = t.doc_id
), masks AS (
    SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flags GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS places
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, places[step] AS own, CAST(coalesce(list_sum(places[1 : step - 1]), 0) AS INT) AS before
    FROM orders, (SELECT unnest(range(1, 6)) AS step)
), sums AS (
    SELECT part, filter_order, step, own, CAST(sum(n) FILTER (bits & (before | own) = 0) AS BIGINT) AS kept,
        sum(n) FILTER (bits & own > 0 AND bits & before = 0) AS removed, sum(n) FILTER (bits & own > 0 AND bits & before > 0) AS redundant,
        sum(n) FILTER (bits = own) AS unique_fails, sum(good) FILTER (bits & own > 0 AND bits & before = 0) AS good_lost,
        sum(toxic) FILTER (bits & own > 0 AND bits & before = 0) AS toxic_lost
    FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
    CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""


# --- 13: byte-level BPE ----------------------------------------------------------------------

@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Token ids of each text, and the bytes that they are decoded to, by digests."""
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return told.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
