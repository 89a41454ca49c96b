"""WARC derivatives: response records become linked metadata and plain-text conversion records.

Everything is a DataFrame expression over one scan: no shuffle, no Python. Record ids are name-based, so a rerun
gives the same ids. Digests are labelled sha256 in hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_DATE = "1970-01-01T00:00:00Z"
DROPPED = r"(?is)<(?:!--.*?-->|(?:script|style|noscript|template)\b[^>]*>.*?</(?:script|style|noscript|template)\s*>)"
BLOCK_TAG = r"(?i)</?(p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|section|article|header|footer|nav|main|aside|title|head|body|html|blockquote|pre|hr)\b[^>]*>"
ANY_TAG = r"(?s)<[a-zA-Z/!?][^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
HREF = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"
# Named entities that are decoded; the ampersand last, so no entity is decoded twice.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&pound;", "£"), ("&deg;", "°"), ("&times;", "×"), ("&#38;", "&"), ("&amp;", "&"),
]
OFTEN = ("&lt;", "&gt;", "&quot;", "&nbsp;", "&copy;", "&middot;", "&amp;")
RARE = "&(?:#|" + "|".join(name[1:] for name, _ in ENTITIES if name not in OFTEN) + ")"
NUMERIC = "&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def _character(entity: Column) -> Column:
    """What a numeric entity stands for; itself where that is no character, or an ampersand."""
    body = F.replace(F.replace(entity, F.lit("&#"), F.lit("")), F.lit(";"), F.lit(""))
    code = F.when(F.lower(F.left(body, F.lit(1))) == "x", F.conv(F.substr(body, F.lit(2)), 16, 10)).otherwise(body).cast("int")
    known = ((code > 0) & (code < 0xD800) & (code != 38)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def _named(c: Column, entities: list[tuple[str, str]]) -> Column:
    for name, char in entities:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def decode_entities(c: Column) -> Column:
    """Numeric entities, then named ones. Numbers and rare names are looked for only where there are any."""
    numbers = F.array_distinct(F.regexp_extract_all(c, F.lit(NUMERIC), F.lit(0)))
    numeric = F.aggregate(numbers, c, lambda acc, e: F.replace(acc, e, _character(e)))
    often = [e for e in ENTITIES if e[0] in OFTEN]
    return F.when(c.rlike(RARE), _named(numeric, ENTITIES)).otherwise(_named(c, often))


def without_tags(html: Column) -> Column:
    """Comments, scripts and styles go, block tags end lines, other tags are blanks."""
    c = F.regexp_replace(html, DROPPED, " ")
    return F.regexp_replace(F.regexp_replace(c, BLOCK_TAG, "\n"), ANY_TAG, " ")


def folded(text: Column) -> Column:
    """Blanks fold and empty lines go."""
    c = F.regexp_replace(text, "[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(c, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a page table: one per row; a null url is kept as the empty URI, a null body as the empty one."""
    url, body = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"), urn(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), url).alias("record_id"),
        url.alias("target_uri"), F.lit(NO_DATE).alias("date"), F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8").alias("http_headers"), body.alias("payload"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows per response: `metadata` and `conversion`.

    Needs record_id, target_uri, date, http_headers, payload; other columns but page_id are not read. Each row has
    refers_to (the response's id), its URI, date and HTTP headers, the digest of the response payload as
    source_digest, and a block with its own digest and length in bytes. The metadata block is JSON: headers, title,
    link targets in order, payload length, and the id of the conversion record; the conversion names the metadata
    record in turn. A null payload gives empty blocks; repeated responses give repeated records; malformed HTML is
    text between tags as far as they close. An empty table gives no rows.
    """
    payload = F.coalesce(F.col("payload"), F.lit(""))
    of = lambda kind: urn(F.lit(kind), F.col("record_id"))
    source = [F.col("page_id")] if "page_id" in records.columns else []
    # Each step is a column of its own, so that no expression is worked out twice.
    cut = records.select(
        *source, "record_id", "target_uri", "date", F.coalesce(F.col("http_headers"), F.lit("")).alias("head"), digest(payload).alias("source_digest"), F.octet_length(payload).cast("long").alias("source_length"),
        F.regexp_replace(F.regexp_extract(payload, TITLE, 1), ANY_TAG, " ").alias("title"), F.regexp_extract_all(payload, F.lit(HREF), F.lit(1)).alias("links"), without_tags(payload).alias("text"),
    )
    read = cut.withColumns({"title": decode_entities(F.col("title")), "links": F.transform("links", decode_entities), "text": decode_entities(F.col("text"))})
    done = read.withColumns({"title": F.trim(F.regexp_replace("title", "[ \t\r\n\f]+", " ")), "text": folded(F.col("text"))})
    meta = F.to_json(F.struct(F.col("head").alias("source_headers"), "source_length", "title", "links", of("conversion").alias("conversion_id")))
    one = lambda kind, other, media, block: F.struct(
        F.lit(kind).alias("warc_type"), of(kind).alias("derived_id"), of(other).alias("linked_id"), F.lit(media).alias("content_type"), block.alias("block"), F.size("links").cast("long").alias("n_links")
    )
    both = F.array(one("metadata", "conversion", "application/json", meta), one("conversion", "metadata", "text/plain", F.col("text")))
    rows = done.select(*source, F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("head").alias("source_headers"), "source_digest", F.explode(both).alias("r"))
    kept = [c for c in rows.columns if c != "r"]
    return rows.select(*kept, "r.*").withColumns({"block_digest": digest(F.col("block")), "content_length": F.octet_length("block").cast("long")})


def write_warc(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Write derivative rows as WARC/1.1 files, one per partition. Every record ends with two line ends. The response's HTTP
    status line and headers are carried as WARC-Source-HTTP-Header fields, one a line."""
    head = [
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("derived_id")), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Concurrent-To", F.col("linked_id")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")), ("WARC-Source-Payload-Digest", F.col("source_digest")), ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ]
    source = F.transform(F.filter(F.split("source_headers", "\r?\n"), lambda x: x != ""), lambda x: F.concat(F.lit("WARC-Source-HTTP-Header: "), x))
    lines = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in head], source)
    raw = F.concat(lines, F.lit("\r\n\r\n"), F.col("block"))
    rows.select(raw.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def page_derivatives(pages: DataFrame) -> DataFrame:
    return derivatives(responses(pages))


def _decoded_sql(text: str) -> str:
    code = "CAST(CASE WHEN lower(e[3]) = 'x' THEN '0x' || e[4:-2] ELSE e[3:-2] END AS INTEGER)"
    char = f"CASE WHEN ({code} > 0 AND {code} < 55296 AND {code} <> 38) OR ({code} > 57343 AND {code} <= 1114111) THEN chr({code}) ELSE e END"
    out = f"list_reduce(list_distinct(regexp_extract_all({text}, '{NUMERIC}')), lambda a, e: replace(a, e, {char}), {text})"
    for name, shown in ENTITIES:
        out = "replace({}, '{}', '{}')".format(out, name, shown.replace("'", "''"))
    return out


ORACLE_SQL = (
    r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS h FROM pages),
r AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS refers_to,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' AS source_headers,
    list_transform(regexp_extract_all(payload, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1), lambda x: {links}) AS links,
    regexp_replace(regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title\s*>', 1), '(?s)<[a-zA-Z/!?][^>]*>', ' ', 'g') AS t0,
    regexp_replace(regexp_replace(regexp_replace(payload, '(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</(script|style|noscript|template)\s*>', ' ', 'g'),
      '(?i)</?(p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|section|article|header|footer|nav|main|aside|title|head|body|html|blockquote|pre|hr)\b[^>]*>', chr(10), 'g'), '(?s)<[a-zA-Z/!?][^>]*>', ' ', 'g') AS c0 FROM p),
s AS (
  SELECT *, md5('metadata|' || refers_to) AS hm, md5('conversion|' || refers_to) AS hc, trim(regexp_replace({title}, '[ \t\r\n\f]+', ' ', 'g')) AS title,
    regexp_replace(regexp_replace(regexp_replace({text}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS plain FROM r),
u AS (
  SELECT *, '<urn:uuid:' || hm[1:8] || '-' || hm[9:12] || '-' || hm[13:16] || '-' || hm[17:20] || '-' || hm[21:32] || '>' AS mid,
    '<urn:uuid:' || hc[1:8] || '-' || hc[9:12] || '-' || hc[13:16] || '-' || hc[17:20] || '-' || hc[21:32] || '>' AS cid FROM s),
b AS (
  SELECT page_id, refers_to, target_uri, source_headers, payload, 'metadata' AS warc_type, mid AS derived_id, cid AS linked_id, 'application/json' AS content_type,
    CAST(to_json({'source_headers': source_headers, 'source_length': strlen(payload), 'title': title, 'links': links, 'conversion_id': cid}) AS VARCHAR) AS block, CAST(len(links) AS BIGINT) AS n_links FROM u
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_headers, payload, 'conversion', cid, mid, 'text/plain', plain, CAST(len(links) AS BIGINT) FROM u)
SELECT page_id, refers_to, target_uri, '1970-01-01T00:00:00Z' AS date, source_headers, 'sha256:' || sha256(payload) AS source_digest, warc_type, derived_id, linked_id, content_type, block, n_links,
  'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM b
"""
    .replace("{links}", _decoded_sql("x")).replace("{title}", _decoded_sql("t0")).replace("{text}", _decoded_sql("c0"))
)
