import numpy as np
import pytest

from cuespark.operators.learn import Weights, rw_learn, wh_learn

SIMPLE = "a A;a_b A;b_c B;a_b_c C;a_b A;a_b A;a_b A;c C;c C;c C;c C;b_c B;b_c B;b_c B;a A;a A;a D"
DOUBLE = "a_a A;a_b A;b_c B;a_b_c C;a_a_b A;a_a_b A;a_b A;c C;c C;c C;c C;b_b_c B;b_b_c B;b_c B;a A;a A;a D"
SINGLE = "a A;a A;b B;a C;a A;a A;a A;c C;c C;c C;c C;b B;b B;b B;a A;a A;a D"
GOLD_SIMPLE = {
    "a": (0.0664228958019371, -0.0004679542492416, 0.00913237656408, 0.01),
    "b": (0.0369453054439119, 0.0383650579363088, 0.0076940833315796, 0),
    "c": (-0.00148720933211834, 0.0382611772343088, 0.0472921134315796, 0),
}
GOLD_DOUBLE = {
    "a": (0.0922958560231934, -0.000637584443199, 0.00839070911745, 0.01),
    "b": (0.033396811752139, 0.0566582680337533, 0.0060580709494085, 0),
    "c": (-0.00220704388828405, 0.0376010015902643, 0.0471512345263585, 0),
}
GOLD_SINGLE = {("A", "a"): 0.0670679510, ("B", "b"): 0.0394039900, ("C", "a"): 0.0094148015, ("C", "c"): 0.0394039900, ("D", "a"): 0.01}


def events(spark, text, start=0):
    rows = [(start + i, e.split()[0].split("_"), e.split()[1].split("_")) for i, e in enumerate(text.split(";"))]
    return spark.createDataFrame(rows, "event_id long, cues array<string>, outcomes array<string>")


def table(w):
    a, b = w.axes
    return {(r[a], r[b]): r["weight"] for r in w.dense().collect()}


def reference(text, alpha=0.1, betas=(0.1, 0.1), lam=1.0):
    rows = [(e.split()[0].split("_"), e.split()[1].split("_")) for e in text.split(";")]
    w = {(o, c): 0.0 for o in {o for _, os in rows for o in os} for c in {c for cs, _ in rows for c in cs}}
    for cs, os in rows:
        for o in {o for o, _ in w}:
            a = sum(w[o, c] for c in cs)
            u = betas[0] * (lam - a) if o in os else -betas[1] * a
            for c in cs:
                w[o, c] += alpha * u
    return w


@pytest.mark.parametrize("strategy", ["fold", "kernel"])
def test_goldens(spark, strategy):
    for text, gold in ((SIMPLE, GOLD_SIMPLE), (DOUBLE, GOLD_DOUBLE)):
        got = table(rw_learn(events(spark, text), remove_duplicates=False, strategy=strategy, outcomes_per_chunk=2))
        for cue, values in gold.items():
            for outcome, v in zip("ABCD", values):
                assert got[outcome, cue] == pytest.approx(v, abs=1e-12)


def test_all_strategies_agree_on_single_cues(spark):
    e = events(spark, SINGLE)
    tables = [table(rw_learn(e, strategy=s, betas=(0.1, 0.05), lambda_=2.0)) for s in ("closed", "fold", "kernel", None)]
    expected = reference(SINGLE, betas=(0.1, 0.05), lam=2.0)
    for t in tables:
        assert t.keys() == expected.keys()
        assert all(t[k] == pytest.approx(v, abs=1e-12) for k, v in expected.items())
    got = table(rw_learn(e))
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in GOLD_SINGLE.items())


def test_rates_for_each_cue(spark):
    rates = {"a": 0.1, "b": 0.3, "c": 0.05}
    got = [table(rw_learn(events(spark, SIMPLE), rates, strategy=s)) for s in ("fold", "kernel")]
    assert all(got[0][k] == pytest.approx(got[1][k], abs=1e-12) for k in got[0])
    assert got[0]["A", "b"] != pytest.approx(0.0369453054439119)


def test_continued_learning_is_one_pass(spark, tmp_path):
    parts = SIMPLE.split(";")
    first = rw_learn(events(spark, ";".join(parts[:3])))
    first.write(str(tmp_path / "w"))
    again = Weights.read(spark, str(tmp_path / "w"))
    got = rw_learn(events(spark, ";".join(parts[3:]), 3), weights=again)
    one = table(rw_learn(events(spark, SIMPLE)))
    assert all(table(got)[k] == pytest.approx(v, abs=1e-12) for k, v in one.items())
    assert " | " in got.attrs["alpha"]


def test_old_outcomes_are_still_unlearned(spark):
    first = rw_learn(events(spark, "a A;a A"))
    got = table(rw_learn(events(spark, "a B", 2), weights=first))
    assert got["A", "a"] == pytest.approx(table(first)["A", "a"] * (1 - 0.01))


def test_duplicates_policy(spark):
    with pytest.raises(ValueError):
        rw_learn(events(spark, DOUBLE))
    with pytest.raises(ValueError):
        rw_learn(events(spark, SIMPLE), remove_duplicates="yes")
    assert table(rw_learn(events(spark, DOUBLE), remove_duplicates=True))


def vectors(spark, rows):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in rows.items()], "label string, vec array<double>")


def unit(names):
    return {n: [float(n == m) for m in names] for n in names}


def test_widrow_hoff_with_unit_vectors_is_rescorla_wagner(spark):
    e = events(spark, SIMPLE)
    expected = table(wh_learn(e, 0.01))
    cues, outcomes = vectors(spark, unit("abc")), vectors(spark, unit("ABCD"))
    for x, y in ((cues, None), (None, outcomes), (cues, outcomes)):
        got = table(wh_learn(e, 0.01, cue_vectors=x, outcome_vectors=y, cue_dims=x and list("abc"), outcome_dims=y and list("ABCD"), rows_per_chunk=3))
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(v, abs=1e-12) for k, v in expected.items())


def test_widrow_hoff_against_loops(spark):
    cv = {"a": [0.2, 0.11, 0.5, 0, 0], "b": [0, 0, 0.5, 0.11, 0.2], "c": [0.2, 0, 0, 0, 0.2]}
    ov = {"A": [0.2, 1], "B": [0.5, 0], "C": [0, 0.5], "D": [1, 0.2]}
    got = table(wh_learn(events(spark, SIMPLE), 0.01, cue_vectors=vectors(spark, cv), outcome_vectors=vectors(spark, ov)))
    w = np.zeros((2, 5))
    for e in SIMPLE.split(";"):
        x = sum(np.array(cv[c]) for c in e.split()[0].split("_"))
        y = np.array(ov[e.split()[1]])
        w += 0.01 * np.outer(y - w @ x, x)
    assert all(got[str(i), str(j)] == pytest.approx(w[i, j], abs=1e-12) for i in range(2) for j in range(5))
    with pytest.raises(ValueError):
        wh_learn(events(spark, SIMPLE), 0.01, cue_vectors=vectors(spark, {"a": [1.0]}))
