"""The registered queries of the text operators, and SQL for those that SQL can express."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.llm.decontaminate import find_items
from cardwatch.llm.html import extract_main_text
from cardwatch.llm.infill import fill_in_middle, restored
from cardwatch.llm.lines import drop_repeated_lines
from cardwatch.llm.near_duplicates import near_duplicate_groups
from cardwatch.llm.pieces import SPACE, decode, encode
from cardwatch.llm.resampling import log_ratios, resample
from cardwatch.llm.secrets import BASE, as_text, scan_secrets
from cardwatch.llm.spelling import count_words, spelling_groups
from cardwatch.llm.token_counts import count_tokens
from cardwatch.llm.top_k import exact_top_k, usable
from cardwatch.llm.toxicity import add_severity, fit_severity
from cardwatch.llm.url_filter import ALLOW, BLOCK, Rule, judge_urls

#: The rules of the url filter.
URL_RULES = [
    Rule(ALLOW, "com", "/"),
    Rule(BLOCK, "example.com", "/en/"),
    Rule(ALLOW, "www.example.com", "/en/"),
    Rule(BLOCK, "net", "/es/"),
    Rule(BLOCK, "net", "/fr/"),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = find_items(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.item_id", "hit.distance")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = tokenizer_file("piece_bpe_32k.model")
    coded = decode(encode(docs, model), model, into="decoded")
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(SPACE), F.lit(" "))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    base = [r.kind for r in BASE]
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))

    def count(kind):
        return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan_secrets(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"),
        *map(count, base),
        F.sha2(as_text(found, lambda s: s["kind"].isin(base)), 256).alias("base_sha256"),
        as_text(found).alias("spans"),
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = fit_severity(docs, table(spark, folder, "labels"))
    return add_severity(docs, model).select("doc_id", "expected_severity", "toxic")


def op8_quality_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    good = table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return resample(docs, log_ratios(docs, good))


def op9_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = usable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return exact_top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(table(spark, folder, "documents"))


def op11_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    words = count_words(table(spark, folder, "documents").select("doc_id", "text"))
    return spelling_groups(words.where("n >= 2"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    changed = fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return changed.select(
        "doc_id",
        F.col("n_tokens").alias("n"),
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_toxicity": op7_toxicity,
    "op8_quality_resampling": op8_quality_resampling,
    "op9_top_k": op9_top_k,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_spelling_groups": op11_spelling_groups,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_url_filter": op13_url_filter,
}

ORACLES = {
    "op9_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM scored
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op5_line_dedup": r"""
        WITH parts AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM parts
        ), judged AS (
            SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op12_fill_in_middle": r"""
        WITH given AS (
            SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
            FROM documents
        ), parts AS (
            SELECT doc_id, body,
                   regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
                   CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2,
                   CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4
            FROM given
        ), cut AS (
            SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS one,
                   greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS two,
                   CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                             OR h3 % 100 >= 50 THEN 'plain'
                        WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
            FROM parts
        ), made AS (
            SELECT *, array_to_string(units[1:one], '') AS p, array_to_string(units[one + 1:two], '') AS m,
                   array_to_string(units[two + 1:], '') AS s
            FROM cut
        )
        SELECT doc_id, len(units) AS n, form,
               CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                                WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE body END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM made
    """,
    "op13_url_filter": r"""
        WITH RECURSIVE rules(rank, verdict, host, path) AS (
            VALUES (1, 'allow', 'com', '/'), (2, 'block', 'net', '/es/'), (2, 'block', 'net', '/fr/'),
                   (3, 'block', 'example.com', '/en/'), (4, 'allow', 'www.example.com', '/en/')
        ), tags AS (
            SELECT url, unnest(regexp_extract_all(regexp_replace(html,
                '<!--.*?-->|<(script|style|template|noscript)[\s>].*?</(script|style|template|noscript)', ' ', 'gis'),
                '<(?:link|meta)\s[^>]*>', 0, 'i')) AS tag
            FROM pages WHERE contains(url, '://') AND regexp_matches(html, 'canonical|refresh', 'i')
        ), found AS (
            SELECT url, trim(replace(CASE
                WHEN regexp_matches(tag, '^<link', 'i') AND regexp_matches(tag, '[\s"'']rel\s*=\s*["'']?([^"''>]*\s)?canonical[\s"''/>]', 'i')
                    THEN regexp_extract(tag, '[\s"'']href\s*=\s*(?:"([^"]*)"|''[^'']*''|[^\s"''>]+)', 1, 'i') ||
                         regexp_extract(tag, '[\s"'']href\s*=\s*(?:"[^"]*"|''([^'']*)''|[^\s"''>]+)', 1, 'i') ||
                         regexp_extract(tag, '[\s"'']href\s*=\s*(?:"[^"]*"|''[^'']*''|([^\s"''>]+))', 1, 'i')
                WHEN regexp_matches(tag, '^<meta', 'i') AND regexp_matches(tag, '[\s"'']http-equiv\s*=\s*["'']?\s*refresh[\s"''/>]', 'i')
                    THEN regexp_extract(tag, '[\s"'']content\s*=\s*["'']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*["'']?([^"''>]*)', 1, 'i')
                END, '&amp;', '&')) AS link
            FROM tags
        ), split AS (
            SELECT DISTINCT url, link, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) AS scheme,
                   regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS root, regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) AS way
            FROM found WHERE link <> '' AND link NOT LIKE '#%'
        ), links AS (
            SELECT url AS a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
                WHEN link LIKE '//%' THEN scheme || ':' || link
                WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
                WHEN link LIKE '/%' THEN scheme || '://' || root || link
                WHEN link LIKE '?%' THEN scheme || '://' || root || CASE way WHEN '' THEN '/' ELSE way END || link
                ELSE scheme || '://' || root || regexp_extract(CASE way WHEN '' THEN '/' ELSE way END, '^(.*/)', 1) || link END AS b
            FROM split
        ), urls AS (
            SELECT DISTINCT url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM (SELECT url FROM pages UNION SELECT a FROM links UNION SELECT b FROM links WHERE b IS NOT NULL)
        ), named AS (
            SELECT url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) AS query
            FROM urls
        ), ruled AS (
            SELECT n.*, n.host || CASE n.path WHEN '' THEN '/' ELSE n.path END || n.query AS address,
                   (SELECT arg_max(r.host || r.path, r.rank) FROM rules r
                    WHERE (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)) AS rule,
                   (SELECT arg_max(r.verdict, r.rank) FROM rules r
                    WHERE (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)) AS vote
            FROM named n
        ), edges AS (
            SELECT x.address AS a, y.address AS b FROM links l JOIN ruled x ON x.url = l.a JOIN ruled y ON y.url = l.b
            UNION SELECT y.address, x.address FROM links l JOIN ruled x ON x.url = l.a JOIN ruled y ON y.url = l.b
        ), reach AS (
            SELECT a AS start, a AS node FROM edges
            UNION SELECT reach.start, edges.b FROM reach JOIN edges ON edges.a = reach.node
        ), judged AS (
            SELECT start, count(*) FILTER (WHERE vote = 'block') > 0 AND count(*) FILTER (WHERE vote = 'allow') = 0 AS blocked
            FROM reach JOIN ruled ON ruled.address = reach.node
            WHERE ruled.url IN (SELECT a FROM links UNION SELECT b FROM links)
            GROUP BY start
        )
        SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule AS rule,
               coalesce(r.vote, CASE WHEN j.blocked THEN 'block' ELSE 'allow' END) AS verdict
        FROM pages p LEFT JOIN ruled r ON r.url = p.url LEFT JOIN judged j ON j.start = r.address
    """,
}
