"""The numbered queries over the given tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from headway.llm import decontam, fim, langid, licenses, mixing, pii, quality, search, simhash, tokens, trie, urls, warc
from headway.llm.common import held_out, table
from headway.session import scratch_path
from headway.sinks.tables import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


ITEM_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query(
    "op1_decontamination",
    rf"""
    WITH item AS (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
    sized AS (SELECT item_id, w, least(len(w), 13) AS k FROM item WHERE len(w) > 0),
    win AS (
        SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
    doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce({ITEM_WORDS}, []) AS w FROM documents),
    lens AS (SELECT DISTINCT k FROM win),
    grams AS (
        SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, lens WHERE len(w) >= k)),
    hits AS (SELECT r, i, grams.k, item_id FROM grams JOIN win USING (k, g)),
    pos AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)),
    cnt AS (SELECT r, count(*) AS n_hit FROM pos GROUP BY r),
    ids AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM hits GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM doc LEFT JOIN cnt USING (r) LEFT JOIN ids USING (r)""",
)
def op1_decontamination(spark, folder):
    found = decontam.scan(table(spark, folder, "documents"), "text", table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query("op5_language_id")
def op5_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    model = langid.train(docs, "text", "lang", "doc_id", ~held_out("doc_id") & F.col("doc_id").isNotNull())
    out = langid.predict(docs, "text", model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "entropy", "rejected")


@query("op6_simhash")
def op6_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"), "text", "doc_id")


#: The rules of the query, as (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query(
    "op2_url_filter",
    r"""
    WITH rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS s FROM pages),
    u AS (SELECT r, page_id,
        coalesce(translate(regexp_extract(s, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(s, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
    fit AS (SELECT r, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM u JOIN rules
        ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
    SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN fit USING (r)""",
)
def op2_url_filter(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = urls.verdicts(table(spark, folder, "pages").select("page_id", "url"), "url", rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query("op7_source_mixing")
def op7_source_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), "text", "source", "doc_id", keep=["doc_id", "source"])
    shards = F.array_sort(F.array_distinct(F.transform("pieces", lambda p: p["shard"])))
    return mixed.select("doc_id", "source", "size", "source_size", "target", mixing.taken_words().alias("taken"), shards.alias("shards"))


#: The key of the query's pseudonyms; a real run takes its own from a secret store.
PII_KEY = "example key of the registered query"


@query("op8_pii")
def op8_pii(spark, folder):
    return pii.pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), "text", PII_KEY)


@query("op9_token_counts")
def op9_token_counts(spark, folder, path: str | None = None):
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    docs = table(spark, folder, "documents")
    out = tokens.count_tokens(docs, "text", spec, public_tokenizers.PATTERN, ["doc_id"])
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


@query("op4_quality")
def op4_quality(spark, folder):
    docs = table(spark, folder, "documents")
    described = stage(quality.with_statistics(docs, "text", ["doc_id"]), "quality-stats")
    model = quality.train(described, table(spark, folder, "labels"), "doc_id", "quality", ~held_out("doc_id"))
    out = quality.predict(described, model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_bm25_search")
def op3_bm25_search(spark, folder):
    docs = table(spark, folder, "documents")
    index = search.build_index(docs, "text", "doc_id")
    return search.search(index, docs.where(F.col("doc_id") % 20 == 0), "text", "doc_id", 10)


@query("op10_license_scan")
def op10_license_scan(spark, folder):
    docs = table(spark, folder, "documents")
    found = licenses.scan(docs, "text", licenses.train(docs, "text", "doc_id"), ["doc_id"])
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_windows", "confidence", "n_unconfirmed")


@query(
    "op11_prefix_trie",
    r"""
    WITH RECURSIVE own AS (
        SELECT conv_id AS c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text)) AS l
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1),
    crc AS (
        SELECT c, 0 AS i, CAST(4294967295 AS BIGINT) AS x FROM own
        UNION ALL SELECT c, i + 1, list_reduce(range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)), xor(x, CAST(ascii(substr(CAST(c AS VARCHAR), i + 1, 1)) AS BIGINT)))
        FROM crc WHERE i < len(CAST(c AS VARCHAR))),
    h AS (SELECT c, xor(x, CAST(4294967295 AS BIGINT)) % 9 AS h FROM crc WHERE i = len(CAST(c AS VARCHAR))),
    r AS (SELECT o.c, list_concat(coalesce(b.l, [])[:h], o.l[h + 1:]) AS s FROM own o JOIN h ON h.c = o.c LEFT JOIN own b ON b.c = o.c - o.c % 5),
    pos AS (SELECT c, len(s) AS n, d, s[:d] AS k FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM r)),
    node AS (
        SELECT k, d, min(c) AS c, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE strlen(any_value(k[d].text)) END AS w,
            sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS e FROM pos GROUP BY k, d),
    kids AS (SELECT k[:d - 1] AS k, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1),
    full_node AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kids ON kids.k = node.k),
    sub AS (SELECT k[:x] AS k, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(d + 1)) AS x FROM full_node) GROUP BY 1)
    SELECT a.c AS conv_id, CAST(a.d AS BIGINT) AS depth, p.c AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, leaves AS n_leaves,
        CAST(saved AS BIGINT) AS saved_tokens, a.e AS ends_sha256
    FROM full_node a JOIN sub ON sub.k = a.k LEFT JOIN node p ON p.d = a.d - 1 AND p.k = a.k[:a.d - 1]""",
)
def op11_prefix_trie(spark, folder):
    own = trie.sequences(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    base = own.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("begin"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    both = own.withColumn("base", F.expr("conv_id - conv_id % 5")).join(base, "base", "left").withColumn("h", h)
    begin = F.coalesce(F.slice("begin", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rebuilt = F.concat(begin, F.slice("turns", F.col("h") + 1, F.size("turns")))
    return trie.prefix_nodes(both.select("conv_id", rebuilt.alias("turns")))


@query(
    "op12_fill_in_middle",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
        sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
    k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS x FROM d),
    f AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 100 THEN 'plain'
            WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, array_to_string(u[:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
)
def op12_fill_in_middle(spark, folder):
    out = fim.restored(fim.fill_in_middle(table(spark, folder, "documents"), "text", "doc_id", keep=["doc_id"]))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


@query(
    "op13_warc",
    r"""
    WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS t FROM pages),
    q AS (SELECT *, sha1(t) AS h, row_number() OVER w AS k, first_value(page_id) OVER w AS f FROM p WINDOW w AS (PARTITION BY t ORDER BY page_id NULLS LAST, r)),
    d AS (SELECT *, [CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) FOR i IN range(8)] AS v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a FROM q)
    SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
        array_to_string([substr(a, CAST(x >> 15 AS BIGINT) + 1, 1) || substr(a, ((x >> 10) & 31) + 1, 1) || substr(a, ((x >> 5) & 31) + 1, 1)
            || substr(a, (x & 31) + 1, 1) FOR x IN v], '') AS payload_digest,
        CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM d""",
)
def op13_warc(spark, folder):
    root = scratch_path(spark, "archives")
    warc.write_arc(table(spark, folder, "pages"), f"{root}/arc", "url", "html", "page_id", "20240101000000")
    warc.convert(spark, f"{root}/arc", f"{root}/warc")
    found = warc.read_warc(spark, f"{root}/warc").where("type <> 'warcinfo'")
    return found.select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to_key").cast("long").alias("refers_to"),
    )
