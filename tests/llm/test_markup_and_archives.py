"""Broken markup in linear time, against a plain pattern; records without an empty line, folded headers, dates."""

from __future__ import annotations

import gzip
import random
import re
import time

import pytest

from cuespark.llm import htmltext, warc
from cuespark.llm.htmltext import Tags, main_text

#: The markup that Tags gives, as one pattern; it takes quadratic time on broken pages.
PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^<]*\Z", re.S)


def test_tags_equal_a_plain_pattern():
    rng = random.Random(4)
    compared = 0
    while compared < 20_000:
        page = "".join(rng.choice("<<>ab\"'/!- \n") for _ in range(rng.randint(1, 40)))
        if re.search(r"<[a-zA-Z][^\s/>]*[\"']|</[a-zA-Z][^\s/>]*[\"']", page):
            continue  # a name that holds a quote may end at other places
        compared += 1
        want, tags, at, got = [(m.start(), m.end(), m[2], m[3]) for m in PLAIN.finditer(page)], Tags(page), 0, []
        while found := tags.after(at):
            at, m = found[1:]
            got.append((*found[:2], m and m[2], m and m[3]))
        assert got == want, page


@pytest.mark.parametrize("piece", ['<b "', "<a ", "<a \"'<b '\"", "<p><button><div><b>", "<li><i>", "<script></script ", "<!x ", "<svg><b>x</b>", "<a'b\"c "])
def test_broken_pages_take_linear_time(piece):
    began = time.time()
    main_text(piece * (1_000_000 // len(piece)) + ">")
    assert time.time() - began < 15


@pytest.mark.parametrize("name", ["leftSidebar", "adsbygoogle", "commentlist", "siteFooter", "topbanner", "SocialButtons"])
def test_names_run_together_are_boilerplate(name):
    page = f"<body><article><p>{'The story goes on for a while. ' * 5}</p><div class='{name}'>Other words.</div></article></body>"
    assert "Other words" not in main_text(page)
    assert htmltext.named(name, True)


@pytest.mark.parametrize("name", ["sharePrice", "noSidebar", "story", "loader", "shadow", "headline", "commentary"])
def test_other_names_are_not(name):
    assert not htmltext.named(name, True)


def block_of(kind, body, **more):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("form", ["plain", "members", "one", "skipping"])
def test_headers_without_an_end_and_folded_ones(spark, tmp_path, form):
    http = {"Content_Type": "application/http; msgtype=response"}
    records = [
        block_of("response", b"HTTP/1.1 200 OK\r\nServer: s", WARC_Record_ID="<urn:uuid:1>", **http),
        block_of("response", b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Target_URI="\r\n http://a/\r\n\tb", WARC_Record_ID="<urn:uuid:2>", **http),
        block_of("response", b"", WARC_Record_ID="<urn:uuid:3>", **http),
    ]
    data = {"plain": b"".join, "members": lambda x: b"".join(map(gzip.compress, x)), "one": lambda x: gzip.compress(b"".join(x)), "skipping": lambda x: b"".join(map(warc.member, x))}[form](records)
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r.record_id, bytes(r.payload), r.payload_length) for r in rows] == [("urn:uuid:1", b"", 0), ("urn:uuid:2", b"body", 4), ("urn:uuid:3", b"", 0)]
    assert rows[1].target_uri == "http://a/ b"


def test_records_have_a_date_and_a_name(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>x"), (None, "v", "<p>y")], "page_id long, url string, html string")
    warc.write_warc(warc.to_records(pages), str(tmp_path / "w"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz")).decode()
    assert len(re.findall(r"WARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", text)) == 2
    assert len(set(re.findall(r"WARC-Record-ID: (<urn:[^>]+>)", text))) == 2
    assert sorted((str(r.record_id), r.target_uri) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == [("1", "u"), ("None", "v")]
