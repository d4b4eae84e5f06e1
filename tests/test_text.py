import gzip

import pytest
from pyspark.sql import functions as F

from cuespark.functions import text as X
from cuespark.operators import corpus as C
from cuespark.operators import counts, filters, infer
from cuespark.sources import readers, sinks


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()["v"]


def words(spark, *ws):
    return F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")


def test_windows(spark):
    got = one(spark, X.consecutive_words(words(spark, *"ABCD"), 3))
    assert got == [["A"], ["A", "B"], ["A", "B", "C"], ["B", "C", "D"], ["C", "D"], ["D"]]
    assert one(spark, X.consecutive_words(words(spark), 3)) == []
    assert one(spark, X.consecutive_words(words(spark, "A", "B"), 3)) == [["A"], ["A", "B"], ["B"]]
    got = one(spark, X.word_to_word(words(spark, *"ABCD"), 2, 1))
    assert [(list(r["cues"]), r["outcomes"][0]) for r in got] == [(["B"], "A"), (["A", "C"], "B"), (["A", "B", "D"], "C"), (["B", "C"], "D")]


def test_ngrams_cross_words_and_count_characters(spark):
    assert one(spark, X.ngrams(words(spark, "ab", "🎉"), 3)) == ["#ab", "ab#", "b#🎉", "#🎉#"]
    assert one(spark, X.ngrams(words(spark, "a"), 2)) == ["#a", "a#"]


def test_tokens_split_at_single_blanks_and_strip_all_space(spark):
    assert one(spark, X.tokens(X.clean(F.col("text"))), "a  b  c_d ") == ["a", "b", "c", "d"]
    assert one(spark, X.tokens(X.clean(F.col("text"), "a-z", True)), "Ab1C é") == ["ab", "c"]
    assert one(spark, X.tokens(X.clean(F.col("text"), lambda c: c in "ab ")), "ab xb") == ["ab", "b"]


def test_time_code(spark):
    assert one(spark, X.time_code(F.col("text")), "01:02:03,015") == 3723.5


def corpus(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_documents_end_at_markers(spark):
    text = "a b---END.OF.DOCUMENT---c\nd---end.of.document------end.of.document---"
    got = C.corpus_to_events(corpus(spark, text), event_structure="line", cue_structure="word_to_word").orderBy("context").collect()
    assert [r["cues"] for r in got] == [["a", "b"], ["c", "d"]]


def test_structures(spark):
    with pytest.raises(NotImplementedError):
        C.corpus_to_events(corpus(spark, "a"), context_structure="paragraph")
    with pytest.raises(NotImplementedError):
        C.corpus_to_events(corpus(spark, "a"), event_structure="sentence")
    with pytest.raises(NotImplementedError):
        C.corpus_to_events(corpus(spark, "a"), cue_structure="letters")
    got = C.corpus_to_events(corpus(spark, "hand foot"), event_options=(1,), cue_structure="bigrams_to_word").orderBy("place").collect()
    assert [(r["cues"], r["outcomes"]) for r in got] == [(["#h", "ha", "an", "nd", "d#"], ["hand"]), (["#f", "fo", "oo", "ot", "t#"], ["foot"])]
    got = C.corpus_to_events(corpus(spark, "a b"), event_structure="word_to_word", event_options=(1, 1), cue_structure="bigrams_to_word").orderBy("place").collect()
    assert got[0]["outcomes"] == ["b", "a"]


def events(spark, *rows):
    return readers.events_from_list(spark, rows)


def text_of(df):
    return [(r["cues"], r["outcomes"]) for r in C.as_text(df, "event_id").orderBy("event_id").collect()]


def test_filters(spark):
    e = events(spark, ("#of_alb_NEI_b_of#_XX", "term_not_of"), ("alb_NEI_b_XX", "term_not_of"), ("#of_of#_#of", "term_not"))
    rules = {"keep_cues": ["#of", "of#"], "keep_outcomes": ["of"]}
    expected = [("#of_of#", "of"), ("#of_of#_#of", "")]
    assert text_of(filters.filter_events(e, **rules)) == expected
    keys = spark.createDataFrame([("#of",), ("of#",)], "token string")
    assert text_of(filters.filter_events(e, keep_cues=keys, keep_outcomes=["of"])) == expected
    assert filters.filter_line("#of_alb_of#\tterm_not_of\n", **rules) == "#of_of#\tof\n"
    assert filters.filter_line("alb\tof\n", **rules) is None
    with pytest.raises(ValueError):
        filters.filter_line("no tab", **rules)
    with pytest.raises(ValueError):
        filters.filter_events(e, keep_cues=["a"], remove_cues=["b"])
    assert text_of(filters.filter_events(e, cue_map={"#of": "x", "of#": "x", "XX": ""}))[0] == ("x_x", "term_not_of")
    assert text_of(filters.filter_events(e, remove_cues=["alb", "NEI", "b", "XX"])) == [("#of_of#", "term_not_of"), ("#of_of#_#of", "term_not")]


@pytest.mark.parametrize(
    "rules",
    [
        {"keep_cues": ["#of", "of#", "of#", "other"]},
        {"remove_cues": ("alb", "NEI", "b", "XX")},
        {"cue_map": {"#of": "x", "of#": "x", "XX": "", "b": "y"}},
        {"keep_outcomes": {"of", "not"}, "remove_cues": ["b", "XX"]},
        {"outcome_map": {"of": "o", "term": "", "not": "n"}, "keep_cues": ["#of", "b", "XX"]},
    ],
)
def test_many_tokens_are_joined(spark, monkeypatch, rules):
    e = events(spark, ("#of_alb_NEI_b_of#_XX", "term_not_of"), ("alb_NEI_b_XX", "term_not_of"), ("#of_of#_#of", "term_not"), ("alb", ""))
    expected = text_of(filters.filter_events(e, **rules))
    monkeypatch.setattr(filters, "INLINE", 1)
    joined = filters.filter_events(e, **rules)
    assert text_of(joined) == expected
    assert "Join" in joined._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        filters.filter_events(e, keep_cues=["a", "b"], remove_cues=["c", "d"])


def test_event_files(spark, tmp_path):
    e = events(spark, ("a_b", "A"), ("b", ""), ("a_a", "A_B"))
    sinks.write_events(e, str(tmp_path / "e"))
    back = readers.read_events(spark, str(tmp_path / "e"))
    assert text_of(back) == [("a_b", "A"), ("b", ""), ("a_a", "A_B")]
    assert back.where("event_id = 1").first()["outcomes"] == [""]
    with gzip.open(tmp_path / "f.tab.gz", "wt", encoding="utf-8") as f:
        f.write("Cues\tOutcomes\tFrequency\na\tA\t2\nb\tB\t1\nc\tC\t0\nd\tD\t1\n")
    assert text_of(readers.read_events(spark, str(tmp_path / "f.tab.gz"))) == [("a", "A"), ("a", "A"), ("b", "B"), ("d", "D")]
    assert text_of(readers.read_events(spark, str(tmp_path / "f.tab.gz"), start=1, step=2)) == [("b", "B"), ("d", "D")]
    with pytest.raises(ValueError):
        readers.read_events(spark, "x", compression="bz2")
    (tmp_path / "bad.tab").write_text("cues\toutcomes\nonly one column\n")
    with pytest.raises(Exception, match="two or three columns"):
        readers.read_events(spark, str(tmp_path / "bad.tab"), None).collect()


def test_counters(spark, tmp_path):
    c = spark.createDataFrame([("b", 1), ("a", 3), ("c", 1)], "key string, freq long")
    sinks.write_counter(c, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_text()
    assert text == "key\tfreq\na\t3\nb\t1\nc\t1\n"
    assert sorted(map(tuple, readers.read_counter(spark, str(tmp_path / "c")).collect())) == [("a", 3), ("b", 1), ("c", 1)]
    (tmp_path / "d.tsv").write_text("key\tfreq\na\t1\na\t2\n")
    with pytest.raises(ValueError):
        readers.read_counter(spark, str(tmp_path / "d.tsv"))


def test_counts(spark):
    got = counts.cues_outcomes(events(spark, ("a_a_b", ""), ("a", "A")))
    assert got.n_events == 2
    assert {r["key"]: r["freq"] for r in got.cues.collect()} == {"a": 3, "b": 1}
    assert {r["key"]: r["freq"] for r in got.outcomes.collect()} == {"": 1, "A": 1}
    ws = counts.words_symbols(corpus(spark, "The the, (end)\n*"), lower_case=True)
    assert {r["key"]: r["freq"] for r in ws.words.collect()} == {"the": 2, "end": 1}
    assert {r["key"]: r["freq"] for r in ws.symbols.collect()} == {"t": 2, "h": 2, "e": 3, "n": 1, "d": 1}


def test_encoding(spark):
    e = events(spark, ("b_a_b", "B"), ("a", ""))
    v, o = counts.vocabulary(e, "cues"), counts.vocabulary(e, "outcomes")
    got = counts.encode(e, v, o).orderBy("event_id").collect()
    assert [(r["cue_ids"], r["outcome_ids"]) for r in got] == [([1, 0, 1], [1]), ([0], [0])]
    assert counts.encode(e, v, o, True).orderBy("event_id").first()["cue_ids"] == [0, 1, 1]
    with pytest.raises(Exception, match="unknown token"):
        counts.encode(e, v.where("key = 'a'"), o).collect()


def test_bandsample(spark):
    c = spark.createDataFrame([(f"w{i:03}", i // 10 + 1) for i in range(200)], "key string, freq long")
    got = counts.bandsample(c, 20, cutoff=3).collect()
    assert len(got) in (19, 20) and min(r["freq"] for r in got) >= 3
    with pytest.raises(NotImplementedError):
        counts.bandsample(c, seed=1)


def test_activation(spark):
    w = spark.createDataFrame([("o1", "c2", 1.0), ("o2", "c1", 1.0), ("o1", "c1", 0.0), ("o1", "c3", 0.0)], "outcome string, cue string, weight double")
    e = events(spark, ("c1_c2_c3", ""), ("c1_c3", ""), ("c2", ""), ("c1_c1", ""))

    def run(e, **k):
        return {(r["outcome"], r["event_id"]): r["activation"] for r in infer.activation(e, w, **k).collect()}

    got = run(e, remove_duplicates=True)
    assert [got["o1", i] for i in range(4)] == [1, 0, 1, 0] and [got["o2", i] for i in range(4)] == [1, 1, 0, 1]
    with pytest.raises(ValueError):
        run(e)
    with pytest.raises(KeyError):
        run(events(spark, ("c2_c4", "")))
    assert run(events(spark, ("c2_c4", ""), ("c9", "")), ignore_missing_cues=True) == {("o1", 0): 1, ("o2", 0): 0, ("o1", 1): 0, ("o2", 1): 0}


def test_correlation(spark):
    import numpy as np

    rng = np.random.default_rng(20190507)
    a, b = rng.normal(size=(12, 4)), rng.normal(size=(12, 5))
    sem = spark.createDataFrame([(i, str(j), float(a[i, j])) for i in range(12) for j in range(4)], "dim int, outcome string, value double")
    act = spark.createDataFrame([(i, j, float(b[i, j])) for i in range(12) for j in range(5)], "dim int, event_id long, value double")
    for r in infer.correlation(sem, act).collect():
        assert r["r"] == pytest.approx(np.corrcoef(a[:, int(r["outcome"])], b[:, r["event_id"]])[0, 1])
    flat = act.withColumn("value", F.when(F.col("event_id") == 1, 1.0).otherwise(F.col("value")))
    with pytest.raises(ValueError):
        infer.correlation(sem, flat)
    assert any(np.isnan(r["r"]) for r in infer.correlation(sem, flat, allow_nan=True).collect())
    with pytest.raises(AssertionError):
        infer.correlation(sem, act.where("dim < 5"))


def test_paths_and_parts(tmp_path):
    p = tmp_path / "a.txt"
    assert sinks.safe_path(p) == p
    p.write_text("")
    assert sinks.safe_path(p) == tmp_path / "a-1.txt"
    (tmp_path / "a-1.txt").write_text("")
    assert sinks.safe_path(p) == tmp_path / "a-2.txt"
    assert counts.slice_list([1, 2, 3], 2) == [[1, 2], [3]]
    with pytest.raises(ValueError):
        counts.slice_list([1], 0)
    with pytest.raises(AssertionError):
        counts.slice_list([1, 1], 1)


SUBTITLE = """<?xml version="1.0" encoding="utf-8"?>
<document>
<s id="1"><time id="T1S" value="00:00:01,000"/><w>A</w><w>B</w><w>:</w><time id="T1E" value="00:00:02,000"/></s>
<s id="2"><time id="T2S" value="00:00:12,000"/><w>M</w><w>.</w><time id="T2E" value="00:00:13,000"/></s>
<s id="3"><time id="T3S" value="00:00:14,000"/><w>N</w><w>O</w><w>.</w><time id="T3E" value="00:00:15,000"/></s>
</document>"""


def test_subtitles(spark, tmp_path):
    (tmp_path / "2017").mkdir()
    with gzip.open(tmp_path / "2017" / "1.xml.gz", "wt", encoding="utf-8") as f:
        f.write(SUBTITLE)
    got = [r["text"] for r in readers.read_subtitles(spark, str(tmp_path)).orderBy("path", "line_no").collect()]
    assert got == ["A B:", "", "M.", "N O.", "", "---END.OF.DOCUMENT---", ""]
    with pytest.raises(ValueError):
        readers.subtitle_lines(SUBTITLE.replace("T1S", "T1X").encode())


def test_sysinfo(capsys):
    from cuespark.info import sysinfo

    assert "Spark" in sysinfo() and "Spark" in capsys.readouterr().out


def test_texts_are_laid_out_and_lines_numbered_without_moving_events(spark, tmp_path, monkeypatch):
    """Texts that share an id, nulls among them, still give the order of (id, context, place); with ids of their own no event is laid out."""
    from cuespark import storage

    texts = [(3, "c d e---END.OF.DOCUMENT---f"), (1, "a b"), (None, "n"), (2, None), (5, "x y z w")]
    cases = {"own": texts, "shared": [*texts, (3, "g h")]}
    for name, rows in cases.items():
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        want = [r.place for r in C.corpus_to_events(table).orderBy("doc_id", "context", "place").collect()]
        laid = C.laid_events(table)
        assert [r.place for r in laid.collect()] == want  # as they stand
        written, real = [], storage.materialise
        monkeypatch.setattr(storage, "materialise", lambda df, what: written.append(what) or real(df, what))
        sinks.write_events(laid, str(tmp_path / name), laid_out=True)
        back = readers.read_events(spark, str(tmp_path / name))
        assert [r.event_id for r in back.orderBy("event_id").collect()] == list(range(len(want))) and "ordered" not in written
        assert text_of(back) == [tuple("_".join(x) for x in (r.cues, r.outcomes)) for r in laid.collect()]
        monkeypatch.undo()


def test_lines_of_split_files_are_numbered_by_blocks(spark, tmp_path):
    rows = [(i, [f"c{i}"], ["o"]) for i in range(300)]
    sinks.write_events(spark.createDataFrame(rows, "event_id long, cues array<string>, outcomes array<string>"), str(tmp_path / "e"), compression=None, per_file=100)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        for start, step in ((0, 1), (7, 3)):
            got = readers.read_events(spark, str(tmp_path / "e"), None, start, step)
            assert sorted((r.event_id, r.cues[0]) for r in got.collect()) == [(k, f"c{i}") for k, i in enumerate(range(start, 300, step))]
        held = readers.read_events(spark, str(tmp_path / "e"), None)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # other splits than those that were counted
        with pytest.raises(Exception, match="read otherwise than it was counted"):
            held.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_words_at_once_and_different_ngrams(spark):
    """Odd white space, tabs, line ends, reserved and wide letters, empty and null texts: as by lines, and as the n-grams with repeats."""
    texts = ["a b\tc\nd", "  ", "", None, "x y z ", " in  out\r\n", "a#b_c  d\n\n e", "\U0001f600é Straße é \U0001f600é", "aaaa aaaa"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    slow = F.flatten(F.transform(F.split(c, "\n"), lambda t: X.tokens(X.clean(X.strip(t)))))
    got = table.select(X.words(c, X.clean).alias("got"), slow.alias("want"))
    assert [r.got for r in got.collect()] == [r.want for r in got.collect()]
    for n in (2, 3):
        grams = got.select(X.distinct_ngrams(F.col("got"), n).alias("got"), F.array_distinct(X.ngrams(F.col("want"), n)).alias("want"))
        assert [r.got or None for r in grams.collect()] == [r.want or None for r in grams.collect()]
