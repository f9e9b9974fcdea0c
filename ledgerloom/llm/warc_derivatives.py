"""WARC derivatives: a metadata and a conversion record for every response record.

Both refer to the response by its identifier, address and date. The metadata record carries the source's
status, HTTP headers, title and the digests of its block and payload; the conversion record is the plain
text of the page. Everything is DataFrame expressions; digests are labelled sha256.

Defined cases: a null block is empty, a block without a blank line is all headers with an empty payload; a null
address or date is an empty field; a script, style or comment that does not end goes on to the end of the page;
pages of any length are converted whole; repeated responses give repeated derivatives with equal identifiers; an
empty table gives none; only record_id, target_uri, warc_date and block (and `keep`) are read.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import let
from ledgerloom.llm.binary_files import write_files

# Names of HTML 4's character references; a map is searched from its front, so the commonest stand there.
_COMMON = ("amp", "nbsp", "quot", "lt", "gt", "apos")
_NAMES = {name: chr(code) for name, code in {**dict.fromkeys(_COMMON, 39), **dict(sorted(name2codepoint.items()))}.items()}
_NUMBER = r"^#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6})\z"


def record_urn(*parts: Column) -> Column:
    """A stable identifier in the form of a uuid."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records (page_id, record_id, target_uri, warc_date, block) of stored pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n")
    )
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long"), record_urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
        url.alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head, html).alias("block"),
    )


def _character(point: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes; U+FFFD where there is none."""
    part = lambda shift: F.shiftright(point, shift).bitwiseAND(63).bitwiseOR(128)
    lead = lambda shift, mark: F.shiftright(point, shift).bitwiseOR(mark)
    raw = (
        F.when(point < 0x80, F.hex(point)).when(point < 0x800, F.concat(F.hex(lead(6, 0xC0)), F.hex(part(0))))
        .when(point < 0x10000, F.concat(F.hex(lead(12, 0xE0)), F.hex(part(6)), F.hex(part(0))))
        .otherwise(F.concat(F.hex(lead(18, 0xF0)), F.hex(part(12)), F.hex(part(6)), F.hex(part(0))))
    )
    real = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    return F.when(real, F.decode(F.unhex(raw), "UTF-8")).otherwise("\ufffd")


def unescaped(text: Column) -> Column:
    """The text with its character references, by number and by the names of HTML 4, as characters; others stay."""
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])

    def numbered(ref: Column) -> Column:
        code = F.when(F.lower(F.left(ref, F.lit(2))) == "#x", F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2)))
        return F.when(F.regexp_like(ref, F.lit(_NUMBER)), let(code.try_cast("bigint"), _character))

    def replaced(x: Column, ref: Column, char: Column) -> Column:
        return F.when(char.isNull(), F.concat(F.lit("&"), x)).otherwise(F.concat(char, F.substr(x, F.length(ref) + 2)))

    def one(x: Column, i: Column) -> Column:
        # What stands before the first semicolon, or all if there is none.
        named = lambda ref: F.when(F.startswith(ref, F.lit("#")), numbered(ref)).otherwise(F.try_element_at(names, ref))
        found = lambda ref: F.when(F.octet_length(ref) < F.octet_length(x), named(ref))
        return F.when(i == 0, x).otherwise(let(F.substring_index(x, ";", 1), lambda ref: let(found(ref), lambda char: replaced(x, ref, char))))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), F.array_join(F.transform(F.split(t, "&"), one), "")).otherwise(t))


def plain_text(html: Column) -> Column:
    """Text of a page: no scripts, styles or comments; block ends become line breaks; spaces are joined."""
    # Patterns begin with one character, which is quickly looked for, and leave single spaces alone.
    text = F.regexp_replace(html, r"(?is)<(?:script\b.*?(?:</script\s*>|\z)|style\b.*?(?:</style\s*>|\z)|!--.*?(?:-->|\z))", " ")
    text = F.regexp_replace(text, r"(?i)<(?:br\s*/?|/(?:p|div|li|h[1-6]|tr|title|article|footer|nav)\s*)>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    text = F.regexp_replace(unescaped(text), r"[ \t\r\u00a0](?:(?<! )[ \t\r\u00a0]*|[ \t\r\u00a0]+)", " ")
    return F.btrim(F.regexp_replace(text, r"[ \n](?:(?<=\n)|\n)[ \n]*", "\n"), F.lit(" \n"))


def derivatives(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two rows per response: keep, record_type, record_id, refers_to, target_uri, content_type, headers, block,
    content_length, block_digest, source_block_digest, source_payload_digest."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    block = text("block")
    blank = F.instr(block, "\r\n\r\n")
    parsed = records.select(
        *keep, text("record_id").alias("refers_to"), text("target_uri").alias("target_uri"), text("warc_date").alias("refers_to_date"),
        F.when(blank > 0, F.left(block, blank - 1)).otherwise(block).alias("head"),
        F.when(blank > 0, F.substr(block, blank + 4)).otherwise(F.lit("")).alias("payload"),
        F.concat(F.lit("sha256:"), F.sha2(block, 256)).alias("source_block_digest"),
    )
    parsed = parsed.withColumn("source_payload_digest", F.concat(F.lit("sha256:"), F.sha2("payload", 256)))
    # On one line, so that a title cannot end its field or start another.
    title = F.trim(F.regexp_replace(unescaped(F.regexp_extract("payload", r"(?is)<title>([^<]*)</title>", 1)), r"[\s\p{Z}]+", " "))
    fields = F.concat(
        F.lit("source-status: "), F.regexp_extract("head", r"^HTTP/[0-9.]+ ([0-9]+)", 1), F.lit("\r\ntitle: "), title,
        F.lit("\r\nsource-block-digest: "), F.col("source_block_digest"), F.lit("\r\nsource-payload-digest: "), F.col("source_payload_digest"),
        F.regexp_replace(F.concat(F.lit("\r\n"), F.regexp_replace("head", r"^[^\r\n]*(\r\n)?", "")), r"\r\n", "\r\nsource-header: "), F.lit("\r\n"),
    )
    both = parsed.select(
        *keep, "refers_to", "target_uri", "refers_to_date", "source_block_digest", "source_payload_digest",
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
            F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")),
        )).alias("r"),
    ).select(*keep, "refers_to", "target_uri", "refers_to_date", "source_block_digest", "source_payload_digest", "r.*")
    described = both.withColumn("record_id", record_urn("record_type", "refers_to")).withColumn(
        "content_length", F.octet_length("block").cast("long")
    ).withColumn("block_digest", F.concat(F.lit("sha256:"), F.sha2("block", 256)))
    lines = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"),
        ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "refers_to_date"),
        ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ]
    headers = F.concat(F.lit("WARC/1.1\r\n"), *[F.concat(F.lit(f"{n}: "), F.col(c).cast("string"), F.lit("\r\n")) for n, c in lines])
    return described.withColumn("headers", headers)


def write_warc(derived: DataFrame, path: str) -> None:
    """Gzip WARC files, one per partition, each record a gzip member of its own that ends with two line ends."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                record = f"{batch.column(0)[i].as_py()}\r\n{batch.column(1)[i].as_py()}\r\n\r\n".encode()
                yield pa.RecordBatch.from_pydict({"data": pa.array([gzip.compress(record, mtime=0)], pa.binary())})

    write_files(derived.select("headers", "block").mapInArrow(packed, "data binary"), path, ".warc.gz")
