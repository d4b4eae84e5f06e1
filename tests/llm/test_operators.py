"""The training-data operators against brute force, libraries and round trips, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuespark.llm import components, decontam, htmltext, jaccard, langid, maxscore, quality, queries, sentencepieces, sharding, tokenbin, warc

SCHEMA = "doc_id long, text string, lang string, TEXT2 string, keys string"
WORDS = [f"word{i}" for i in range(300)]


def texts() -> list[str | None]:
    """Copies, near copies, null, empty, blank, short and long texts."""
    rng = random.Random(5)
    out: list[str | None] = [None, "", " \t\n", "One", "One", "ä ö  ü 日本語 \U0001f600", "A b C d"]
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 120))]
        out += [" ".join(base), " ".join(base).upper()]
        for cuts in (1, 2, 4):
            near = list(base)
            for _ in range(cuts):
                near[rng.randrange(len(near))] = rng.choice(WORDS)
            out.append(" ".join(near))
    out.append(" ".join(rng.choice(WORDS) for _ in range(20_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", "other", "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_is_stable_and_gapless(docs, empty):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(texts())
    for r in rows:
        data = (texts()[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 16)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).collect() == []


def test_sharding_follows_weights(spark):
    shards = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count()
    counts = {r.s: r["count"] for r in shards.collect()}
    assert abs(counts[1] / 20_000 - 0.75) < 0.02


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_components_equal_brute_force(docs, width, percent):
    sets = []
    for t in texts():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_components(docs, width, percent).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert len(set(root)) < len(root)


@pytest.mark.parametrize("percent", [20, 34, 50, 60])
def test_jaccard_links_across_several_bands(spark, percent):
    """Sets and their parts, at the least size that links and one below it."""
    rows, expect = [], {}
    for n in range(4, 40):
        small = -(-percent * n // 100)
        for size, linked in ((small, True), (small - 1, False)):
            words, at = [f"n{n}s{size}w{i}" for i in range(n)], len(rows)
            rows += [(at, " ".join(words)), (at + 1, " ".join(words[n - size :]))]
            expect |= {at: at, at + 1: at if linked or size == n else at + 1}
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == expect


def test_jaccard_frequent_keys_lose_no_link(spark):
    """More near copies than a frequent key has, in two groups that share most words."""
    rng = random.Random(2)
    base = [rng.choice(WORDS) for _ in range(200)]
    rows = []
    for i in range(60):
        near = list(base)
        near[rng.randrange(200)] = f"odd{i}"
        rows.append((i, " ".join(near)))
    found = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}


def test_components_that_are_not_settled_are_an_error(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.connected_components(path, rounds=1)
    assert {(r.node, r.root) for r in components.connected_components(path).collect()} == {(i, 0) for i in range(41)}


def test_jaccard_of_an_empty_table(empty):
    assert jaccard.similar_components(empty).collect() == []


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=8).tolist() for _ in range(150)]
    vectors[3], vectors[4], vectors[5] = None, [1.0, None] + [0.0] * 6, [float("nan")] * 8
    vectors[7] = vectors[8] = vectors[9]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    whole = {i: np.floor(64 * np.array(v)) for i, v in enumerate(vectors) if i not in (3, 4, 5)}
    expect = set()
    for q in whole:
        if q % 20 == 0:
            ranked = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:20]
            expect |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    got = maxscore.top_k(table, F.col("vec_id") % 20 == 0, shard_rows=16, query_rows=4)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()} == expect
    assert maxscore.top_k(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_sentencepiece_equals_the_library(docs, empty):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepieces.encode(docs, path)
    for r in sentencepieces.decode(encoded, path).collect():
        text = texts()[r.doc_id] or ""
        assert list(r.ids) == library.encode(text)
        assert (r.text or "") == library.decode(library.encode(text))
    assert sentencepieces.encode(empty, path).collect() == []


def test_token_files_round_trip(spark, docs, empty):
    import tokenizers

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library, start = tokenizers.Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in tokenbin.token_digest(spark, docs, path).collect()}
    for i, text in enumerate(texts()):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenbin.token_digest(spark, empty, path).collect() == []


@pytest.mark.parametrize("ids", [[], [7], [0] * 300, [5, 6, 7, 2**32 - 1], list(range(1000, 1128))])
def test_blocks_keep_outliers(ids):
    if ids:
        assert tokenbin.unpack_block(tokenbin.pack_block(np.array(ids, np.uint32))).tolist() == ids


def test_warc_round_trip(spark):
    long, short = "<p>" + "é" * 600, "<p>short"
    pages = [(1, "u1", long), (2, "u2", long), (3, "u3", short), (4, "u4", short), (5, "u5", None), (6, None, "")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.warc_digest(spark, table).collect()}
    for page_id, _, html in pages:
        data = (html or "").encode()
        assert (got[page_id].payload_bytes, got[page_id].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (got[page_id].record_type, got[page_id].refers_to) == (("revisit", 2) if page_id == 1 else ("response", None))
    assert warc.warc_digest(spark, table.limit(0)).collect() == []


def test_html_keeps_the_article_alone(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1>"
        "<p>First <b>part</b>\n of it.</p><script>x()</script><p>Second&nbsp;part.</p><div class='comments'><p>me too</p></div></article>"
        "<footer>Imprint</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>open <a")]
    got = {r.page_id: r for r in htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "A & B First part of it. Second part."
    assert [got[i].text for i in (2, 3)] == ["", ""] and got[4].text.startswith("open")
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_without_article_keeps_title_lead_and_text():
    """Pages built from known parts, without an article and without class words: menus, footers and teasers go."""
    rng = random.Random(9)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    entries = lambda n, linked: "<ul>" + "".join(f"<li><a href=/x>Go {w}</a></li>" if linked else f"<li>Go {w}</li>" for w in WORDS[:n]) + "</ul>"
    teasers = lambda n: "<div><h3>More</h3>" + "".join(f"<div><a href=/t>{sentence(9)}</a></div>" for _ in range(n)) + "</div>"
    for _ in range(300):
        title, lead, items = f"About {rng.choice(WORDS)}", sentence(2), [f"Item {w}" for w in WORDS[: rng.randint(1, 5)]]
        first, more = sentence(30), [sentence(rng.choice([2, 20, 40])) for _ in range(rng.randint(0, 4))]
        listed = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if (with_list := rng.random() < 0.4) else ""
        gap = rng.choice(["", "<div class=ad>" + "<p>Buy this now, all of you.</p>" * 4 + "</div>", "<div>" + entries(4, True) + "</div>"])
        page = (
            f"<html><body><div>{entries(rng.randint(0, 6), rng.random() < 0.5)}</div><div><h1>{title}</h1><p>{lead}</p>{gap}<p>{first}</p>"
            + "".join(f"<p>{x}</p>" for x in more) + listed + "</div>" + rng.choice(["", teasers(rng.randint(1, 5))])
            + f"<div>{entries(rng.randint(0, 6), rng.random() < 0.5)}</div><p>© 2024 Word Ltd. All rights reserved.</p></body></html>"
        )
        assert htmltext.main_text(page) == " ".join([title, lead, first, *more, *(items if with_list else [])]), page


def test_html_window_and_surge_decide():
    short, long = "<div>Ten letters</div>" * 4, "<div>" + "Long text here. " * 10 + "</div>"
    page = short + long + short
    assert htmltext.main_text(page) == ("Long text here. " * 10).strip()
    assert htmltext.main_text(page, surge=10).count("Ten letters") == 8
    assert htmltext.main_text("<p>Tiny page.</p>") == "Tiny page."


@pytest.mark.parametrize(
    "page",
    [
        "<header><form><input><datalist><option value=a>A</option><option value=b>B</option></datalist></form></header><article><p>Kept one.</p><p>Kept two.</p></article>",
        "<select><optgroup><option>A</option><option>B</option></optgroup><optgroup><option>C</option></optgroup></select><main><p>Kept one.</p><p>Kept two.</p></main>",
        "<article><ul><li class=ad>Buy</li><li>Kept one.</li><li>Kept two.</li></ul></article>",
        "<article><ul><li>Kept one.<ul><li class=ad>Buy</li></ul></li><li>Kept two.</li></ul></article>",
        "<article><dl><dt class=ad>Buy</dt><dd class=ad>this</dd><dt>Kept one.</dt><dd>Kept two.</dd></dl></article>",
        "<article><table><tbody><tr class=ad><td>Buy</td><th>this</th></tr><tr><td class=ad>now</td><td>Kept one.</td></tr></tbody><tbody><tr><th>Kept two.</th></tr></tbody></table></article>",
        "<article><p class=ad>Buy <b>this</p><p>Kept one.</p><hr><p class=ad>Buy <i>more</p><div>Kept two.</div></article>",
    ],
)
def test_html_missing_end_tags_lose_nothing(page):
    """Pages give the same text with and without the end tags that HTML lets authors leave out."""
    bare = re.sub("</(option|optgroup|li|dt|dd|tr|td|th|tbody|p)>", "", page)
    assert bare != page
    assert htmltext.main_text(page) == htmltext.main_text(bare) == "Kept one. Kept two."


@pytest.mark.parametrize("name", "option object svg canvas math select noscript template iframe textarea title".split())
def test_html_unclosed_element_does_not_cut_the_page(name):
    rest = "<article><p>Kept one.</p><p>Kept two.</p></article>"
    assert htmltext.main_text(f"<div><{name} x=y></div>{rest}") == "Kept one. Kept two."
    assert htmltext.main_text(f"<body><{name} x=y>{rest}</body>") == "Kept one. Kept two."
    assert htmltext.main_text(f"<div><{name} x=y>Unseen</{name}></div>{rest}") == "Kept one. Kept two."


def test_decontamination_equals_brute_force(spark, docs):
    source = texts()
    items = [("i1", " ".join(source[7].split()[2:16])), ("i2", "a B c"), ("i3", None), ("i4", "..."), ("i5", " ".join(["nowhere"] * 12)), (None, "one")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    got = {r.doc_id: r for r in decontam.contamination_digest(docs, bench).collect()}
    for i, text in enumerate(source):
        words, hit, names = cut(text), set(), set()
        for name, item in items:
            own = cut(item)
            size = min(10, len(own))
            if name is None or not size:
                continue
            wanted = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
            for k in range(len(words) - size + 1):
                if tuple(words[k : k + size]) in wanted:
                    hit |= set(range(k, k + size))
                    names.add(name)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(names), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    assert any(r.contaminated for r in got.values())
    assert not any(r.contaminated for r in decontam.contamination_digest(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("slop,block_chars", [(0, 10**6), (7, 10**6), (54, 100), (120, 10**6), (120, 100)])
def test_proximity_equals_brute_force(spark, slop, block_chars):
    rng = random.Random(slop)
    vocabulary = [f"t{i}" for i in range(14)] + [f"u{i}" for i in range(30)]
    source = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 40, 150]))] for _ in range(40)]
    source.append(["t0", *["x"] * 100, "t1"])
    items = [("i0", "t0 t1"), ("i1", " ".join(vocabulary[2:14])), ("i2", "t3 t3 u4"), ("i3", "t1 u1 nowhere")]
    found = decontam.find_contamination(
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(source)], "doc_id long, text string").repartition(2),
        spark.createDataFrame(items, "item_id string, text string"), slop=slop, block_chars=block_chars,
    )
    got = {r.doc_id: (sorted(r.hit), r["items"]) for r in found.collect()}
    for i, words in enumerate(source):
        hit, names = set(), set()
        for name, item in items:
            own = item.split()
            size = min(10, len(own))
            for k in range(len(own) - size + 1):
                wanted, ranges = set(own[k : k + size]), []
                for a in range(len(words)):
                    b = next((b for b in range(a, min(a + size + slop, len(words))) if wanted <= set(words[a : b + 1])), None)
                    if b is not None:
                        ranges.append((a, b))
                for a, b in ranges:
                    if not any(a <= c and d <= b and (a, b) != (c, d) for c, d in ranges):
                        hit |= set(range(a, b + 1))
                        names.add(name)
        assert got[i] == (sorted(hit), sorted(names)), i
    assert slop < 100 or got[40] == (list(range(102)), ["i0"])


def test_language_held_out_accuracy(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = rows.select("doc_id", "lang")
    got = langid.language_digest(rows).join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark, docs, empty):
    odd = {r.doc_id: r for r in langid.language_digest(docs).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3
    assert langid.language_digest(empty).collect() == []


@pytest.mark.parametrize("foreign", ["de", "en", "es", "fr"])
def test_language_filter_rejects_what_was_not_learned(spark, foreign):
    """With three languages learned, texts of a fourth go and almost all others stay."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 200")
    hidden = rows.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.col("lang") != foreign, F.col("lang")))
    total = {r.truth: r["count"] for r in hidden.groupBy("truth").count().collect()}
    kept = {r.truth: r["count"] for r in corpus_pipeline.language(spark, hidden, "").groupBy("truth").count().collect()}
    assert kept.get(foreign, 0) < 0.1 * total[foreign]
    assert all(kept[lang] > 0.97 * n for lang, n in total.items() if lang != foreign)


def test_quality_keeps_prose_and_rejects_noise(spark, empty):
    prose = [f"The {a} went to the {b} and found it quite calm. Later they came home again, tired." for a in WORDS[:20] for b in ("sea", "hill")]
    noise = [" ".join(f"{w.upper()}$$ |" for w in WORDS[i : i + 15]) for i in range(40)]
    rows = [(i, t) for i, t in enumerate([*prose, *noise, None, "", "  "])]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].keep for i in range(40)) and not any(got[i].keep for i in range(40, 83))
    assert quality.classify(empty).collect() == []
