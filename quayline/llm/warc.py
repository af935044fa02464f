"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Both refer to the response by its record id and repeat its address, date and payload digest; the
metadata record keeps the HTTP headers.  Records are rows; ``write_warc`` turns them into files.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
UNDATED = "1970-01-01T00:00:00Z"

# elements whose content is no text, elements that end a line: fixed values
SILENT = ["script", "style", "noscript", "template", "svg", "title"]
BLOCKS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|"
    "nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
# named references as HTML defines them: from Python's table of them, with the final semicolon or, for the older
# ones, without
NAMED: dict[str, str] = dict(html5)
# the references that most pages get by with, the ampersand last
COMMON = ["&lt;", "&gt;", "&quot;", "&nbsp;", "&copy;", "&middot;", "&amp;"]
UNCOMMON_PATTERN = "&(?!(?:" + "|".join(c[1:] for c in COMMON) + "))[#a-zA-Z]"
LONGEST_OLD = max(len(name) for name in NAMED if not name.endswith(";"))
REFERENCE_PATTERN = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)"
# code points 128 to 159 mean what they are in windows-1252; the five that it lacks stay as they are
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
REPLACEMENT, NO_BREAK = "\ufffd", "\u00a0"

# what is never closed runs to the end, and a tag stops at the next one: no page is read again and again
HIDDEN_PATTERN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{tag}[^a-z].*?(?:</{tag}\s*>|\z)" for tag in SILENT)
BLOCK_PATTERN = rf"(?i)</?({BLOCKS})(\s[^<>]*)?/?>"
TAG_PATTERN = "</?[a-zA-Z!][^<>]*>"
TITLE_PATTERN = r"(?is)<title[^<>]*>(.*?)(?:</title\s*>|\z)"
LINK_PATTERN = r"(?i)<a\s[^<>]*href\s*="


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def record_id(*parts: Column) -> Column:
    """The same id for the same parts: a name-based UUID as URN."""
    name = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    groups = [F.substring(name, 1, 8), F.substring(name, 9, 4), F.concat(F.lit("3"), F.substring(name, 14, 3))]
    groups += [F.concat(F.lit("a"), F.substring(name, 18, 3)), F.substring(name, 21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *groups))


def responses(pages: DataFrame, date: str = UNDATED) -> DataFrame:
    """Pages (``page_id, url, html``) as response records: ``page_id, record_id, target_uri,
    warc_date, http_headers, payload``.  A null page is empty, a null address the empty address."""
    html = F.coalesce("html", F.lit(""))
    length = F.octet_length(html).cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length)
    uri = F.coalesce("url", F.lit(""))
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id"), uri, F.lit(date), digest(html)).alias("record_id"),
        uri.alias("target_uri"),
        F.lit(date).alias("warc_date"),
        headers.alias("http_headers"),
        html.alias("payload"),
    )


def _table(values: dict[str, str]) -> Column:
    """A constant map."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in values.items())), F.lit("\x01"), F.lit("\x02"))


def _character(number: Column) -> Column:
    """The character of a code point (a long): as browsers read it, the replacement character for what is none."""
    encoded = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    none = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    windows = F.element_at(_table({str(k): v for k, v in WINDOWS.items()}), number.cast("string"))
    return F.when(none, REPLACEMENT).when(number.between(128, 159), F.coalesce(windows, encoded)).otherwise(encoded)


def _resolved(reference: Column) -> Column:
    """The text of one match of the pattern; what is no reference stays as it is."""
    # leading zeros mean nothing, and more digits than a code point has are none
    digits = F.regexp_replace(reference, "^&#[xX]?0*|;$", "")
    digits = F.when(F.length(digits) > 7, "10000000").when(digits == "", "0").otherwise(digits)
    decimal, hexadecimal = digits.try_cast("bigint"), F.conv(digits, 16, 10).try_cast("bigint")
    named = _table(NAMED)
    name = F.substring(reference, 2, 1 << 30)
    # the longest older name that the reference begins with
    begun = [
        F.concat(F.element_at(named, F.substring(name, 1, n)), F.substring(name, n + 1, 1 << 30)) for n in range(LONGEST_OLD, 1, -1)
    ]
    return (
        F.when(F.substring(reference, 2, 1) != "#", F.coalesce(F.element_at(named, name), *begun, reference))
        .when(F.lower(F.substring(reference, 3, 1)) == "x", _character(hexadecimal))
        .otherwise(_character(decimal))
    )


def references_resolved(text: Column) -> Column:
    """Named and numeric references of a column, each once: what one yields is not resolved again.

    A text with common ones only has them replaced one kind after the other; the ampersand comes last, so
    that what it yields is left alone."""
    simple = text
    for reference in COMMON:
        simple = F.replace(simple, F.lit(reference), F.lit(html5[reference[1:]]))
    found = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), F.lit(0))
    pieces = F.zip_with(F.split(text, REFERENCE_PATTERN, -1), found, lambda gap, own: F.concat(gap, F.when(own.isNull(), "").otherwise(_resolved(own))))
    return F.when(text.rlike(UNCOMMON_PATTERN), F.array_join(pieces, "")).otherwise(simple)


def untagged(html: Column) -> Column:
    """The text without comments, silent elements and tags, a line end for each block's border."""
    text = F.regexp_replace(html, HIDDEN_PATTERN, " ")
    text = F.regexp_replace(F.regexp_replace(text, "[\\t\\r\\n\\f ]+", " "), BLOCK_PATTERN, "\n")
    return F.regexp_replace(text, TAG_PATTERN, "")


def plain_text(text: Column) -> Column:
    """The visible text from ``untagged`` with references resolved: one line per block, single spaces."""
    single = F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text)
    return F.trim(F.regexp_replace(single, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def title(found: Column) -> Column:
    """The title from what stands in its element."""
    return F.trim(F.regexp_replace(F.replace(references_resolved(found), F.lit(NO_BREAK), F.lit(" ")), "[\\t\\r\\n\\f ]+", " "))


def derivatives(response: DataFrame) -> DataFrame:
    """Two records for each response, ``metadata`` and ``conversion``: ``page_id, warc_type,
    record_id, refers_to, refers_to_target_uri, refers_to_date, content_type, content_length,
    block_digest, source_payload_digest, source_headers, block``.

    Responses without content give records with an empty text; repeated responses give repeated
    records with the same ids, as the response has; an empty table gives none."""
    payload = F.col("payload")
    # columns of their own, which several expressions read
    read = response.withColumns({"untagged": untagged(payload), "titled": F.regexp_extract(payload, TITLE_PATTERN, 1)})
    read = read.withColumn("resolved", F.replace(references_resolved(F.col("untagged")), F.lit(NO_BREAK), F.lit(" ")))
    source = read.select(
        "page_id", "record_id", "target_uri", "warc_date", "http_headers",
        digest(payload).alias("source_digest"),
        plain_text(F.col("resolved")).alias("text"),
        F.concat(
            F.lit("title: "), title(F.col("titled")), F.lit(f"{CRLF}links: "), F.regexp_count(payload, F.lit(LINK_PATTERN)).cast("string"),
            F.lit(f"{CRLF}source-payload-digest: "), digest(payload),
            F.lit(f"{CRLF}source-http: "), F.replace(F.col("http_headers"), F.lit(CRLF), F.lit(f"{CRLF}source-http: ")), F.lit(CRLF),
        ).alias("fields"),
    )

    def record(kind: str, content_type: str, block: str) -> Column:
        own = F.col(block)
        return F.struct(
            F.lit(kind).alias("warc_type"),
            record_id(F.lit(kind), F.col("record_id")).alias("record_id"),
            F.lit(content_type).alias("content_type"),
            F.octet_length(own).cast("bigint").alias("content_length"),
            digest(own).alias("block_digest"),
            own.alias("block"),
        )

    both = F.array(record("metadata", "application/warc-fields", "fields"), record("conversion", "text/plain; charset=utf-8", "text"))
    rows = source.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "http_headers", "source_digest", F.explode(both).alias("r")
    )
    return rows.select(
        "page_id", "r.warc_type", "r.record_id", "refers_to", F.col("target_uri").alias("refers_to_target_uri"),
        F.col("warc_date").alias("refers_to_date"), "r.content_type", "r.content_length", "r.block_digest",
        F.col("source_digest").alias("source_payload_digest"), F.col("http_headers").alias("source_headers"), "r.block",
    )


def record_text(record: DataFrame) -> DataFrame:
    """``record``: headers, empty line and block of each record, without the two line ends behind."""
    headers = [
        ("WARC-Type", "warc_type", "{}"), ("WARC-Record-ID", "record_id", "<{}>"), ("WARC-Refers-To", "refers_to", "<{}>"),
        ("WARC-Target-URI", "refers_to_target_uri", "{}"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri", "{}"),
        ("WARC-Refers-To-Date", "refers_to_date", "{}"), ("WARC-Date", "refers_to_date", "{}"),
        ("WARC-Block-Digest", "block_digest", "{}"), ("X-Source-Payload-Digest", "source_payload_digest", "{}"),
        ("Content-Type", "content_type", "{}"), ("Content-Length", "content_length", "{}"),
    ]
    lines = []
    for name, column, form in headers:
        before, after = form.split("{}")
        lines.append(F.concat(F.lit(f"{name}: {before}"), F.col(column).cast("string"), F.lit(after)))
    return record.select(F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines), F.lit(CRLF + CRLF), F.col("block")).alias("record"))


def write_warc(record: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC files below ``path``, one per task: each record ends with two line ends, which the text
    writer puts behind each row."""
    record_text(record).write.option("lineSep", CRLF + CRLF).option("compression", compression).text(path)
