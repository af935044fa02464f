import gzip
import hashlib
import re

import pytest

from quayline.llm import warc


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.001/pages.parquet")


def parsed(folder):
    """Records of WARC files by their lengths."""
    found = []
    for path in sorted(folder.glob("part-*")):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            found.append((fields, rest[:size]))
            data = rest[size + 4 :]
    return found


def test_files_round_trip(pages, tmp_path):
    records = warc.derivatives(warc.responses(pages))
    warc.write_warc(records.repartition(3), str(tmp_path / "out"))
    rows = {r.record_id: r for r in records.collect()}
    found = parsed(tmp_path / "out")
    assert len(found) == len(rows) == 2 * pages.count()
    for fields, block in found:
        row = rows[fields["WARC-Record-ID"].strip("<>")]
        assert block.decode() == row.block and fields["WARC-Type"] == row.warc_type
        assert fields["WARC-Refers-To"] == f"<{row.refers_to}>" and fields["WARC-Target-URI"] == row.refers_to_target_uri
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()


def test_records_are_linked(pages):
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    records = warc.derivatives(warc.responses(pages)).collect()
    assert len(source) == pages.count() and {r.refers_to for r in records} == set(source)
    for r in records:
        response = source[r.refers_to]
        assert r.source_payload_digest == "sha256:" + hashlib.sha256(response.payload.encode()).hexdigest()
        assert (r.page_id, r.source_headers, r.refers_to_target_uri) == (response.page_id, response.http_headers, response.target_uri)
        assert re.fullmatch("urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}", r.record_id)
        if r.warc_type == "metadata":
            assert f"source-payload-digest: {r.source_payload_digest}\r\n" in r.block
            assert all(f"source-http: {line}\r\n" in r.block for line in response.http_headers.split("\r\n"))


def test_plain_text(spark):
    html = (
        "<!DOCTYPE html><html><head><title> A\n title &amp; more</title><style>p{x}</style></head><body><!-- gone <p> -->"
        "<header>Top</header><script>if (a < b) { '</p>' }</script><p class='x'>One <b>bold</b>&nbsp;word<br>two &lt;tags&gt; &amp;amp;</p>"
        "<a href='/x'>link</a> 1 < 2 <SCRIPT type='t'>x</SCRIPT><ul><li>a</li><li>b</li></ul>\n\n  end</body></html>"
    )
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    rows = {r.warc_type: r for r in warc.derivatives(warc.responses(pages)).collect()}
    assert "head" not in rows["conversion"].block
    assert rows["conversion"].block == "Top\nOne bold word\ntwo <tags> &amp;\nlink 1 < 2\na\nb\nend"
    assert rows["metadata"].block.startswith("title: A title & more\r\nlinks: 1\r\n")


def test_references(spark):
    """Every name of the standard, numbers of both kinds, older names that run into words, and what is none."""
    import html
    from html.entities import html5

    from pyspark.sql import functions as F

    texts = [f"x&{name}y" for name in html5]
    texts += ["&copy; 2020 caf&eacute; &#8217;x&#x2019; &middot;", "&copy2020 &notit; &amp;amp; &ampamp; &am &bogus; &; &# &#x; &#12x &", "&#0; &#xD800; &#1114112; &#99999999999999; &#x110000; &#00000065; &#x000041"]
    texts += [f"&#{n};" for n in (*range(130, 141), 145, 159, 160, 8364, 128512)] + [f"&#x{n:X}" for n in (65, 233, 8217, 0x1F600)] + ["no reference", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in rows.select("i", warc.references_resolved(F.col("text")).alias("found")).collect():
        assert r.found == html.unescape(texts[r.i]), texts[r.i]


def test_odd_pages(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<"), (3, "u", "<script>" * 3000), (4, "u", "<p>x" * 50_000)]
    rows += [(5, "u", part * 200_000) for part in ("<a", "<title>", "<!--", "<p ", "&lt;", " \n")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, record_id string")
    records = warc.derivatives(warc.responses(pages)).collect()
    assert len(records) == 2 * len(rows)
    assert all(r.content_length == len(r.block.encode()) for r in records)
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []
