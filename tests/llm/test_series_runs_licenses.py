"""Resampling, runs of words and license scans against brute force, with their edge cases."""

import datetime as dt
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import licenses, queries, resample, runs

POINT = "key long, t long, v long"


def series(points, bucket, max_gap, signal):
    """Brute force: {(key, bucket): (n, covered, area2, avg)} in Python's whole numbers."""
    out = {}
    for key in {p[0] for p in points}:
        own = sorted(p[1:] for p in points if p[0] == key)
        for k, (t, v) in enumerate(own):
            row = out.setdefault((key, t // bucket * bucket), [0, 0, 0])
            row[0] += 1
            after = own[k + 1] if k + 1 < len(own) else None
            d = after[0] - t if after else max_gap
            if signal == "step":
                w, cover = v, min(d, max_gap)
            else:
                if after is None or d > max_gap:
                    continue
                w, cover = after[1], d
            upto = lambda u: 2 * v * u + (w - v) * u * u // d  # noqa: B023, E731
            for b in range(t // bucket * bucket, t + cover, bucket):
                low, high = max(b, t) - t, min(b + bucket, t + cover) - t
                row = out.setdefault((key, b), [0, 0, 0])
                row[1] += high - low
                row[2] += upto(high) - upto(low)
    return {k: (n, s, a, a // (2 * s) if s else None) for k, (n, s, a) in out.items()}


@pytest.mark.parametrize("signal", ["step", "linear"])
@pytest.mark.parametrize(("bucket", "max_gap", "fan_in"), [(21600, 300, 32), (100, 250, 2), (7, 3, 3), (86400, 4000, 2)])
def test_resampling_equals_brute_force(spark, signal, bucket, max_gap, fan_in):
    rng = random.Random(bucket)
    times = {(k, rng.randrange(-5000, 40_000) if k else rng.randrange(-90_000, 400_000)) for k in range(4) for _ in range(60)} | {(9, 0), (8, -1), (8, 10**6)}
    points = [(k, t, rng.choice([rng.randrange(-500, 500), rng.randrange(-(2**40), 2**40)])) for k, t in sorted(times)]
    rows = resample.resample(spark.createDataFrame(points, POINT), bucket=bucket, max_gap=max_gap, signal=signal, fan_in=fan_in)
    got = {(r["key"], r["bucket_start"]): (r["n_points"], r["covered_seconds"], r["area2"], r["avg"]) for r in rows.collect()}
    assert got == series(points, bucket, max_gap, signal)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(-(2**50), 2**50), st.integers(-(2**50), 2**50), st.integers(1, 4000)), min_size=1, max_size=30))
def test_floored_integrals(spark, rows):
    rows = [(u % (d + 1), v, w, d) for u, v, w, d in rows]
    df = spark.createDataFrame(rows, "u long, v long, w long, d long")
    got = [r[0] for r in df.select(resample.integral2(F.col("u"), F.col("v"), F.col("w"), F.col("d"))).collect()]
    assert got == [2 * v * u + (w - v) * u * u // d for u, v, w, d in rows]


def test_points_of_clicks(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [
        (1, at(0.2), 5, 1.005, "x"), (2, at(0.9), 5, 2.0, "x"), (2, at(0.9), 5, 2.0, "x"), (2, at(0.5), 5, 1.0, "x"), (None, at(0.1), 5, 9.0, "x"),
        (3, at(7), None, 1.0, "x"), (4, None, 5, 1.0, "x"), (5, at(8), 5, None, "x"), (6, at(9), 5, float("nan"), "x"), (7, at(10), 5, float("inf"), "x"), (8, at(11), 5, -0.015, "x"), (None, at(12), 5, 3.0, "x"),
    ]
    for kind in ("timestamp_ntz", "timestamp"):
        clicks = spark.createDataFrame(rows, f"click_id long, ts {kind}, client_id long, value double, key string")
        options = dict(key_column="client_id", time_column="ts", value_column="value", order_column="click_id")
        got = sorted(tuple(r) for r in resample.latest_points(clicks, **options).collect())
        if kind == "timestamp_ntz":
            assert got == [(5, 1704067200, 200), (5, 1704067211, -1), (5, 1704067212, 300)]
        assert [r[2] for r in got] == [200, -1, 300]
        assert resample.resample(resample.latest_points(clicks.filter("false"), **options)).count() == 0
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, client_id long, value double, key string")
        assert resample.latest_points(clicks, **options).agg(F.min("t")).first()[0] == 1704067200
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [resample.leaf_of(b) for b in (1, 7, 21600, 86400, 30 * 86400, 43201)] == [1, 7, 21600, 21600, 21600, 43201 // next(n for n in range(3, 43202) if 43201 % n == 0)]


def periods(s, least, repeats=2):
    """Brute force: (start, length, period) of all runs."""
    n, out = len(s), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            length = j - i + p
            part = s[i : i + length]
            if j > i and length >= max(least, repeats * p) and not any(all(part[x] == part[x + q] for x in range(length - q)) for q in range(1, p)):
                out.add((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=4), st.sampled_from([2, 5, 12]), st.sampled_from([2, 3]))
def test_runs_equal_brute_force(texts, least, repeats):
    text, start, length, period = runs.find_runs([np.array(t, "int64") for t in texts], least, repeats)
    for k, t in enumerate(texts):
        mine = text == k
        assert list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist())) == periods(t, least, repeats)


def test_runs_of_structured_words():
    words = ["a", "b"]
    while len(words[-1]) < 400:
        words.append(words[-1] + words[-2])  # Fibonacci words hold the most runs
    for s in (words[-1], "a" * 500, "ab" * 200 + "a", "abcabcabd" * 30, ("x" * 20 + "y") * 15):
        text, start, length, period = runs.find_runs([np.array([ord(c) for c in s], "int64")], 4)
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == periods(s, 4)


def tail(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def runs_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = tail(doc_id, words) if doc_id is not None else words
    found = periods(words, 12)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op12_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one", "la " * 30, "la " * 30, "a\x0bb\x0cc " * 9, "é 　x\x1c é 　x\x1c " * 8, "A a " * 11 + "A"]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    texts += ["word " * 300]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(4, texts[4], "c"), (None, "x y " * 10, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((runs_row(i, t) for i, t, _ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    assert queries.runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string"), min_repeats=1)


def license_words(text):
    return re.findall(licenses.WORD, (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))


def license_row(doc_id, text, templates, threshold=0.8, width=64):
    ws = license_words(text)
    at, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split(" ")
        spots = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        at += spots
        base |= {label} if spots else set()
    best, more, half = 0.0, set(), width // 2
    for label, template in templates:
        whole = license_words(template)
        cuts = -(-len(whole) // half) or 1
        size = -(-len(whole) // cuts)
        for k in range(cuts):
            part = set(whole[k * size : (k + 1) * size])
            for b in range(max(1, -(-len(ws) // half) - 1)):
                shared = len(part & set(ws[b * half : b * half + width]))
                if part and shared >= len(part) * threshold - 1e-9:
                    more.add(label)
                    best = max(best, shared / len(part))
    return (doc_id, len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best)


@pytest.mark.parametrize("max_lookup", [20_000, 0])
def test_license_scan_equals_brute_force(spark, max_lookup):
    rng = random.Random(3)
    templates = [*licenses.TEMPLATES, ("long", " ".join(f"w{k % 50}" for k in range(150))), ("tiny", "zz"), ("none", "  ")]
    vocabulary = [w for _, t in licenses.TEMPLATES for w in license_words(t)] + ["été", "x1"]
    texts = [None, "", " ,;", "MIT", "Released UNDER the MIT-License.", "under the mit license under the mit license", "cc by\nnc cc BY-NC", "apache license version 2.0 / ApAchE License, version 2", "K under the mit license", "İunder the mit license", "underé the mit license"]
    for _, t in templates:
        ws = re.findall(r"\S+", t)
        for gone in range(0, len(ws), 4):
            lead = ["filler"] * rng.randrange(0, 70)
            texts.append(" ".join(lead + [w for w in ws if gone == 0 or rng.random() > 0.12] + ["more"] * rng.randrange(0, 90)))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts += ["the license " * 4000 + licenses.TEMPLATES[3][1]]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "clash"), (3, texts[4], "clash"), (None, texts[5], "clash"), (None, texts[5], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = licenses.scan(docs, licenses.template_table(spark, templates), max_lookup=max_lookup).collect()
    rounded = lambda r: (*r[:-1], round(r[-1], 12))
    assert sorted((rounded(tuple(r)) for r in got), key=str) == sorted((rounded(license_row(i, t, templates)) for i, t, _ in rows), key=str)


def test_license_scan_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(none, licenses.template_table(spark, licenses.TEMPLATES)).count() == 0
    one = spark.createDataFrame([(1, "under the MIT license")], "doc_id long, text string")
    assert tuple(licenses.scan(one, licenses.template_table(spark, [])).first()) == (1, 4, 1, 0, 0, "mit", "mit", 1.0)
    with pytest.raises(ValueError):
        licenses.scan(none, licenses.template_table(spark, []), width=3)
