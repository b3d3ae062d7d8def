"""The dealt operators over the given tables, and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from labelspring.llm.archives import archive_index
from labelspring.llm.decontaminate import contamination
from labelspring.llm.licenses import (
    COPYRIGHT_LINE,
    KNOWN_LICENSES,
    SPELLINGS,
    license_scan,
    license_texts,
)
from labelspring.llm.lines import without_boilerplate
from labelspring.llm.minhash import near_duplicates
from labelspring.llm.mixing import mixed
from labelspring.llm.phrases import collocations
from labelspring.llm.quality import quality_verdicts
from labelspring.llm.scoring import pseudo_likelihood
from labelspring.llm.search import ranked_search
from labelspring.llm.suffixes import repeat_report
from labelspring.llm.token_counts import token_counts
from labelspring.llm.urls import url_host, url_path, url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of two-word shingles are 80 % alike."""
    return near_duplicates(_table(spark, folder, "documents"), words=2, percent=80)


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule counts of every document and its verdict, the host's included."""
    return quality_verdicts(_table(spark, folder, "documents"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """The masked pseudo-likelihood of every document under a network of the corpus."""
    return pseudo_likelihood(_table(spark, folder, "documents"))


START = 1_704_067_200  # 2024-01-01, UTC


def _draw(value: Column, tag: str) -> Column:
    """An integer from a text, the same in SQL."""
    return F.conv(F.substring(F.md5(F.concat(value, F.lit(tag))), 1, 8), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages, spread over two years by their ids."""
    second = F.pmod(F.col("page_id") * 7919, F.lit(63_072_000)) + START
    return pages.select("page_id", "url", F.timestamp_seconds(second).alias("fetched"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list about the pages' own hosts, domains and paths.

    A third of the hosts are added, removed and in part added again; some
    domains and paths are added for good.
    """
    urls = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    hosts = urls.select(F.col("host").alias("pattern")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", _draw(F.col("pattern"), "host")).where("h % 3 = 0")
    domains = urls.select(F.regexp_extract("host", "([^.]+\\.[^.]+)$", 1).alias("pattern"))
    domains = domains.where("pattern <> ''").distinct()
    domains = domains.withColumn("h", _draw(F.col("pattern"), "domain")).where("h % 7 = 0")
    paths = urls.where("host <> '' and length(path) > 1").select(F.concat("host", "path").alias("pattern"))
    paths = paths.distinct().withColumn("h", _draw(F.col("pattern"), "path")).where("h % 5 = 0")

    def entry(rows: DataFrame, action: str, day: str) -> DataFrame:
        at = F.timestamp_seconds(F.expr(day) * 86400 + START)
        return rows.select("pattern", F.lit(action).alias("action"), at.alias("dated"))

    return (
        entry(hosts, "add", "h % 200")
        .union(entry(hosts, "remove", "h % 200 + 60 + h % 90"))
        .union(entry(hosts.where("h % 2 = 0"), "add", "h % 200 + 400"))
        .union(entry(domains, "add", "h % 700"))
        .union(entry(paths, "add", "h % 365"))
    )


def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """For every page the list entries that were active when it was fetched."""
    pages = _table(spark, folder, "pages")
    verdicts = url_verdicts(page_captures(pages), dated_list(pages))
    return verdicts.select(
        "page_id",
        "n_active",
        "pattern",
        F.unix_seconds("valid_from").alias("valid_from"),
        "kept",
    )


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """For every document the licences whose entire text it, or one of its lines, is."""
    known = spark.createDataFrame([*KNOWN_LICENSES, *license_texts()], "license_id string, text string")
    return license_scan(_table(spark, folder, "documents"), known)


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, from the merged index of the archives that hold it."""
    pages = _table(spark, folder, "pages")
    at = F.timestamp_seconds(F.pmod(F.col("page_id") * 7919, F.lit(63_072_000)) + START)
    captured = pages.withColumn("captured", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return archive_index(captured).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """For every document the benchmark items that it holds, substitutions allowed."""
    return contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that stand elsewhere too."""
    return repeat_report(_table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's domain posteriors and the rate at which it is to be read."""
    documents = _table(spark, folder, "documents")
    labelled = corpus_pipeline.domains(_table(spark, folder, "labels"))
    targets = corpus_pipeline.TARGETS
    rows = mixed(documents, labelled, targets)
    posteriors = [
        F.round(F.col("posterior")[i], 6).alias(f"p_{name}") for i, name in enumerate(targets)
    ]
    return rows.select("doc_id", "n_tokens", *posteriors, F.round("rate", 6).alias("rate"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text without its host's boilerplate lines, as length and digest."""
    cleaned = without_boilerplate(_table(spark, folder, "documents"))
    return cleaned.select(
        "doc_id",
        F.col("_n_dropped").alias("n_dropped"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best collocations of each language."""
    return collocations(_table(spark, folder, "documents"))


def op12_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return ranked_search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 2048 tokens."""
    definition = public_tokenizers.path("word_bpe_49k.json")
    return token_counts(_table(spark, folder, "documents"), definition)


LLM_QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filters": op4_url_filters,
    "op5_license_scan": op5_license_scan,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_phrases": op11_phrases,
    "op12_search": op12_search,
    "op13_token_counts": op13_token_counts,
    "pipeline": corpus_pipeline.run,
}

QUALITY = r"""
WITH texts AS (
  SELECT doc_id, source,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS n_symbols
  FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts
), windows AS (
  SELECT doc_id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS t
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), twice AS (
  SELECT doc_id, t FROM windows WHERE t IS NOT NULL GROUP BY doc_id, t HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows JOIN twice USING (doc_id, t))
  GROUP BY doc_id
), counted AS (
  SELECT doc_id, source, len(words) AS n_words,
    length(array_to_string(words, '')) AS word_chars, n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM texts LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
      OR 100 * n_dup_lines > 30 * n_lines AS failed
  FROM counted
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE failed) AS bad FROM judged GROUP BY source
), moments AS (
  SELECT sum(bad) / sum(n) AS mean, count(*) / sum(n) AS spread,
    sum(bad * bad / n) / sum(n) AS squares FROM hosts
), prior AS (
  SELECT mean, squares - mean * mean - mean * (1 - mean) * spread AS between_hosts FROM moments
), weighted AS (
  SELECT mean, CASE WHEN between_hosts > 0
    THEN least(1e6, greatest(0, mean * (1 - mean) / between_hosts - 1)) ELSE 1e6 END AS k FROM prior
), verdicts AS (
  SELECT source, (bad + mean * k) / (n + k) > 0.5 AS host_failed FROM hosts, weighted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, host_failed,
  NOT base_failed AND NOT host_failed AS kept
FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source
"""

LINES = r"""
WITH split AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), placed AS (
  SELECT doc_id, source, text, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split
), stripped AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM placed
), counted AS (
  SELECT source, bare, count(DISTINCT text) AS n FROM stripped WHERE bare <> '' GROUP BY ALL
), hosts AS (
  SELECT source, count(*) AS total FROM (SELECT DISTINCT source, text FROM documents) GROUP BY source
),
bad AS (
  SELECT source, bare FROM counted JOIN hosts USING (source) WHERE n >= 3 AND n > total * 0.1
), rest AS (
  SELECT doc_id, count(*) FILTER (WHERE bad.bare IS NOT NULL) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.bare IS NULL), '') AS text
  FROM stripped LEFT JOIN bad ON stripped.source = bad.source AND stripped.bare = bad.bare
  GROUP BY doc_id
)
SELECT doc_id, CAST(n_dropped AS BIGINT) AS n_dropped,
  CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
FROM rest
"""

URLS = r"""
WITH parsed AS (
  SELECT page_id, url, page_id * 7919 % 63072000 AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^/?#]*)', 1) AS path
  FROM pages
), named AS (
  SELECT DISTINCT host AS pattern, 'host' AS tag FROM parsed WHERE host <> ''
  UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'domain' FROM parsed
    WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
  UNION SELECT host || path, 'path' FROM parsed WHERE host <> '' AND length(path) > 1
), drawn AS (
  SELECT pattern, tag, CAST('0x' || substr(md5(pattern || tag), 1, 8) AS BIGINT) AS h FROM named
), entries AS (
  SELECT pattern, 'add' AS action, h % 200 AS day FROM drawn WHERE tag = 'host' AND h % 3 = 0
  UNION SELECT pattern, 'remove', h % 200 + 60 + h % 90 FROM drawn WHERE tag = 'host' AND h % 3 = 0
  UNION SELECT pattern, 'add', h % 200 + 400 FROM drawn WHERE tag = 'host' AND h % 6 = 0
  UNION SELECT pattern, 'add', h % 700 FROM drawn WHERE tag = 'domain' AND h % 7 = 0
  UNION SELECT pattern, 'add', h % 365 FROM drawn WHERE tag = 'path' AND h % 5 = 0
), changes AS (
  SELECT lower(pattern) AS pattern, day * 86400 AS dated, max(action) AS action
  FROM entries GROUP BY ALL
), labelled AS (
  SELECT *, string_split(host, '.') AS labels FROM parsed WHERE host <> ''
), asked AS (
  SELECT DISTINCT page_id, fetched, unnest(list_concat(
    list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(labels[i:], '.')),
    CASE WHEN length(path) > 1 THEN [host || path] ELSE [] END)) AS pattern
  FROM labelled
), latest AS (
  SELECT page_id, asked.pattern, dated, action
  FROM asked ASOF JOIN changes ON asked.pattern = changes.pattern AND asked.fetched >= changes.dated
), active AS (
  SELECT page_id, count(*) AS n_active,
    min(struct_pack(l := -length(pattern), p := pattern, d := dated)) AS best
  FROM latest WHERE action = 'add' GROUP BY page_id
)
SELECT page_id, CAST(coalesce(n_active, 0) AS BIGINT) AS n_active, best.p AS pattern,
  CAST(best.d + 1704067200 AS BIGINT) AS valid_from, n_active IS NULL AS kept
FROM pages LEFT JOIN active USING (page_id)
"""

WARC = """
WITH paid AS (
  SELECT page_id, coalesce(html, '') AS html,
    CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), typed AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html)
    ELSE page_id END AS response FROM paid
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM typed
"""


PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), split AS (
  SELECT lang, doc, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS words FROM pieces
), worded AS (
  SELECT lang, doc, piece, regexp_extract_all(words, '[^\x20\x09]+') AS words FROM split
), placed AS (
  SELECT lang, doc, piece, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM worded
), followed AS (
  SELECT lang, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c
  FROM placed WINDOW w AS (PARTITION BY doc, piece ORDER BY i)
), total AS (
  SELECT lang, count(*) AS n FROM followed GROUP BY lang
), one AS (
  SELECT lang, a AS p, count(*) AS f FROM followed GROUP BY ALL
), two AS (
  SELECT lang, a, b, count(*) AS f FROM followed WHERE b IS NOT NULL GROUP BY ALL
), three AS (
  SELECT lang, a, b, c, count(*) AS f FROM followed WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, a, b, max(f) AS f
  FROM (SELECT lang, a, b, f FROM three UNION ALL SELECT lang, b, c, f FROM three) GROUP BY ALL
), cuts AS (
  SELECT two.lang, two.a || ' ' || two.b AS phrase, two.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM two JOIN one x ON x.lang = two.lang AND x.p = two.a JOIN one y ON y.lang = two.lang AND y.p = two.b
  LEFT JOIN longer ON longer.lang = two.lang AND longer.a = two.a AND longer.b = two.b
  WHERE two.f >= 10 AND 100 * coalesce(longer.f, 0) < 50 * two.f
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 1, x.f, y.f
  FROM three t JOIN one x ON x.lang = t.lang AND x.p = t.a
  JOIN two y ON y.lang = t.lang AND y.a = t.b AND y.b = t.c
  UNION ALL
  SELECT t.lang, t.a || ' ' || t.b || ' ' || t.c, t.f, 2, x.f, y.f
  FROM three t JOIN two x ON x.lang = t.lang AND x.a = t.a AND x.b = t.b
  JOIN one y ON y.lang = t.lang AND y.p = t.c
), scored AS (
  SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM weakest JOIN total USING (lang) QUALIFY rank <= 2000
"""

SEARCH = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT doc_id, terms, len(terms) AS n FROM lowered WHERE len(terms) > 0
), facts AS (
  SELECT CAST(count(*) AS BIGINT) AS all_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM sized
), occurs AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(all_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM occurs, facts GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * all_docs // all_terms)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN occurs USING (term), facts GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""


def _licenses_sql() -> str:
    """The canonical forms as SQL, from the same patterns."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def form(text: str) -> str:
        sql = f"regexp_replace(regexp_replace(lower(coalesce({text}, '')), '\\r\\n?', chr(10), 'g'), {quoted(COPYRIGHT_LINE)}, '', 'g')"
        for pattern, written in SPELLINGS:
            target = written.replace("$", "\\")
            sql = f"regexp_replace({sql}, {quoted(pattern)}, {quoted(target)}, 'g')"
        spaced = f"regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
        trimmed = f"list_transform(string_split({spaced}, chr(10)), lambda line: trim(line, ' '))"
        return f"list_filter({trimmed}, lambda line: line <> '')"

    known = ", ".join(f"({quoted(i)}, {quoted(t)})" for i, t in KNOWN_LICENSES)
    return f"""
WITH known AS (
  SELECT array_to_string({form("t")}, ' ') AS form, min(i) AS license_id
  FROM (VALUES {known}) AS given(i, t) GROUP BY 1
), formed AS (
  SELECT doc_id, {form("text")} AS lines FROM documents
), whole AS (
  SELECT doc_id, lines, array_to_string(lines, ' ') AS form FROM formed
), noticed AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids
  FROM (SELECT doc_id, unnest(lines) AS line FROM whole) JOIN known ON line = form GROUP BY doc_id
)
SELECT doc_id, CASE WHEN whole.form <> '' THEN sha256(whole.form) END AS text_digest,
  license_id, coalesce(notice_ids, '') AS notice_ids
FROM whole LEFT JOIN known ON whole.form = known.form LEFT JOIN noticed USING (doc_id)
"""


LLM_ORACLE: dict[str, str] = {
    "op2_quality_rules": QUALITY,
    "op4_url_filters": URLS,
    "op5_license_scan": _licenses_sql(),
    "op6_warc": WARC,
    "op10_line_dedup": LINES,
    "op11_phrases": PHRASES,
    "op12_search": SEARCH,
}
