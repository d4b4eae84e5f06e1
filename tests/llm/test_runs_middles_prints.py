"""Periodic runs, fill-in-middle and SimHash against plain versions, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cuespark.llm import fim, periodic, simhash

SCHEMA = "doc_id long, text string, TEXT2 string, runs string, fp string, `key` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 --------------------------------------------------------------------------------------


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def plain_runs(w):
    """All runs by every lag, start and end; the smallest period by trying all."""
    found, n = set(), len(w)
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(6, 4 * p) and smallest_period(w[i : j + p]) == p:
                found.add((i, length, p))
            i = j
    return sorted(found)


def sequences():
    rng = random.Random(3)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 400, [1] * 50 + [2], [2] + [1] * 50, [1, 2] * 3, [1, 2] * 4, [1, 2] * 4 + [1], [1, 2, 3] * 9 + [1, 2] + [1, 2, 3] * 5]
    for _ in range(300):
        w = []
        while len(w) < rng.randint(10, 160):
            unit = [rng.randint(0, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, 12))]
            times = rng.choice([1, 1, 2, 3, 4, 5, 9])
            w += unit * times + unit[: rng.randint(0, len(unit))]
        out.append(w)
    fibonacci, other = [0], [0, 1]
    for _ in range(9):
        fibonacci, other = other, other + fibonacci
    return [*out, other, [0, 0, 0, 1] * 12 + [0] * 9 + [1]]


def test_runs_equal_a_plain_search():
    for w in sequences():
        if w:
            assert periodic.runs_of(np.array(w, np.uint32)) == plain_runs(w), w


def test_a_run_in_other_alphabets_and_longer_powers():
    w = [70_000, 3] * 6 + list(range(100, 140))
    assert periodic.runs_of(np.array(w, np.uint32)) == [(0, 12, 2)]
    assert periodic.runs_of(np.array(w, np.uint32), powers=7) == []
    with pytest.raises(ValueError):
        periodic.runs_of(np.array(w, np.uint32), powers=3)


def test_long_texts_take_few_lags():
    began = time.time()
    assert periodic.runs_of(np.zeros(1_000_000, np.uint32)) == [(0, 1_000_000, 1)]
    assert periodic.runs_of(np.arange(1_000_000, dtype=np.uint32)) == []
    assert time.time() - began < 20


def altered(doc_id, words):
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_run_digest_equals_the_contract(spark):
    rng = random.Random(7)
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, "a\x1cb a\x1cb"), (6, "A a A a A a A a"), (6, "A a A a A a A a"), (-7, "ä ä ä ä ä ä"), (None, None)]
    rows += [(i, " \t\v\f\r\n"[i % 6].join(rng.choice(["a", "b", "wort", "日本"]) for _ in range(rng.randint(0, 150)))) for i in range(10, 160)]
    rows.append((200, " ".join(str(i % 700) for i in range(30_000))))
    got = sorted(map(tuple, periodic.run_digest(table(spark, rows)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        w = altered(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs = plain_runs(w) if len(w) < 1000 else [(0, 30_000, 700)]
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        best = (top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((doc_id, len(runs), *best, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in dropped))))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10
    assert periodic.run_digest(table(spark, []).where("false")).collect() == []


def test_find_runs_keeps_texts_and_spans(spark):
    row = periodic.find_runs(table(spark, [(1, "x y go go  go go go go z")])).first()
    assert (row.doc_id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (1, 9, [(2, 6, 1)], "x y go z")


# 12 --------------------------------------------------------------------------------------


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digits = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    u, v = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, u), (u, v), (v, n)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(output), sha(text)


def test_fill_in_middle_equals_the_contract(spark):
    rng = random.Random(11)
    rows = [(None, "a b  c"), (None, None), (1, None), (2, ""), (3, "   "), (4, " a"), (4, " a"), (5, "a "), (6, "\x1c   x"), (7, "x <P> y"), (8, "<S"), (9, "<S><M")]
    signs = ["a", "ß", "日", "\U0001f600", " ", " ", "\n", "\t\t", "<", "<P", "S>", "\x00"]
    rows += [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))) for i in range(20, 320)]
    rows += [(i, " ".join(rng.choice(["wort", "\U0001f600x", "z" * 5000]) for _ in range(4000))) for i in range(320, 332)]
    got = sorted(map(tuple, fim.fim_digest(table(spark, rows)).collect()), key=str)
    assert got == sorted((plain_fim(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fim.fim_digest(table(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_cuts_in_chunks_of_any_size(spark, size):
    rng = random.Random(size)
    rows = [(i, "".join(rng.choice("ab  \n😀") for _ in range(rng.randint(0, 30)))) for i in range(150)]
    made = fim.fill_in_middle(table(spark, rows), rate=100, chunk=size)
    for r in made.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect():
        text = dict(rows)[r.doc_id]
        assert r.back == text
        if text:
            assert r.prefix + r.middle + r.suffix == text
            want = plain_fim(r.doc_id, text)
            assert r.n == want[1] and (want[2] == "plain" or (len(r.prefix), len(r.middle)) == want[3:5])


def test_nothing_is_shuffled_and_python_stays_out(spark):
    plan = fim.fim_digest(table(spark, [(1, "a b")]).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Python" not in plan and "Arrow" not in plan


# 13 --------------------------------------------------------------------------------------


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components_of(prints, links=lambda x, y: bin(x ^ y).count("1") <= 2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(prints)), 2):
        if links(prints[a], prints[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_a_plain_version(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, None), (40, ""), (41, " \t"), (42, "One"), (42, "oNE"), (43, "one two"), (44, "ÄB äb"), (None, "one two"), (None, "only null ids"), (None, "only null ids")]
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        rows.append((1000 - 3 * i, " ".join(base)))
        for k in (1, 2):
            near = list(base)
            near[rng.randrange(len(near))] = "other"
            rows.append((1000 - 3 * i + k, "  ".join(near).upper()))
    rows.append((5, " ".join(rng.choice(words) for _ in range(70_000))))
    prints = [plain_print(t) for _, t in rows]
    roots = components_of(prints)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = [(d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots)]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert len(set(roots)) < len(set(prints))
    assert simhash.near_duplicates(table(spark, []).where("false")).collect() == []


@pytest.mark.parametrize("frequent", [1, 3, 16])
def test_links_of_close_prints_lose_none(spark, monkeypatch, frequent):
    """Groups around some centres, so that keys of all sizes occur: pairs from counts, joined ones, and neighbour keys."""
    monkeypatch.setattr(simhash, "FREQUENT", frequent)
    rng = random.Random(frequent)
    prints = {0, (1 << 64) - 1, 1 << 63, 1 << 31, 3 << 31}
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(60):
            p = centre
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 6])):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = [tuple(r) for r in simhash.close_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    at = {p: i for i, p in enumerate(signed)}
    assert all(a in at and b in at for a, b in found)
    joined = {frozenset(x) for x in found}
    assert components_of(list(range(len(prints))), lambda i, j: frozenset((signed[i], signed[j])) in joined) == components_of(prints)


def test_a_link_comes_once_and_only_close_prints_link(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(30)]
    prints = [*base, *(p ^ 1 << rng.randrange(63) for p in base), *(p ^ 5 << rng.randrange(50) for p in base)]
    found = simhash.close_links(spark.createDataFrame([(p,) for p in set(prints)], "fp long")).collect()
    want = {(a, b) for a, b in itertools.combinations(sorted(set(prints)), 2) if (a ^ b).bit_count() <= 2}
    assert len(found) == len(want) and {tuple(r) for r in found} == want


def test_a_tie_of_votes_leaves_the_bit_unset():
    a, b = (xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d"))
    assert simhash.fingerprint("a b c d") & (1 << 64) - 1 == a & b
