"""Language scores against a naive Bayes over dictionaries, placement against plain best-fit decreasing, and what packing leaves open."""

import math
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import langid, packing


def grams(text):
    kept = "".join(c.lower() if c.isalpha() else " " for c in text or "")
    padded = f" {' '.join(kept.split())} "
    return [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip()]


def test_scores_equal_a_dictionary_of_ngrams(spark):
    rng, buckets, smoothing = random.Random(11), 1 << 20, 0.1
    letters = {"aa": "abcde", "bb": "cdefé", "cc": "ABxy"}
    text = lambda label: "".join(rng.choice(letters[label] + "  ,1") for _ in range(rng.randrange(1, 200)))
    rows = [(i, text(label), label) for i, label in enumerate(["aa"] * 30 + ["bb"] * 20 + ["cc"] * 10)] + [(99, "abc", None), (98, None, "aa"), (97, "é, é!", None), (96, "1 2", "bb"), (95, "axe d", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, buckets=buckets, smoothing=smoothing)
    assert model.labels == sorted(letters)

    counts = {label: Counter(g for _, t, own in rows if own == label and t is not None for g in grams(t)) for label in letters}
    sizes = Counter(own for _, t, own in rows if own and t is not None)
    for r in langid.predict(docs, model).collect():
        found = grams(r["text"])
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        scale = min(1.0, 60 / len(found))
        logit = {}
        for label, seen in counts.items():
            total = sum(seen.values()) + smoothing * buckets
            logit[label] = scale * sum(math.log((seen[g] + smoothing) / total) for g in found) + math.log(sizes[label] / sum(sizes.values()))
        top = max(logit.values())
        odds = {label: math.exp(x - top) for label, x in logit.items()}
        best = max(sorted(odds), key=odds.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(odds[best] / sum(odds.values()), abs=1e-4)


def test_tails_go_where_they_fit_most_tightly():
    rng, window = random.Random(8), 100
    tree, plain, opened = packing.OpenWindows(window), [], 0
    for tail in sorted((rng.randrange(1, window) for _ in range(2000)), reverse=True):
        found = tree.tightest(tail)
        best = min((free for free in plain if free >= tail), default=None)
        if best is None:
            assert found is None
            free, number, opened = window, opened, opened + 1
        else:
            free, number = found
            assert free == best
            plain.remove(best)
        tree.put(free - tail, number)
        if free > tail:
            plain.append(free - tail)
    assert opened < 1.1 * 2000 / 2


def test_windows_are_filled_and_the_rest_is_powers_of_two(spark):
    rng, window = random.Random(3), 64
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" ".join(rng.choice(["the", "red", "fox", "runs", "away"]) for _ in range(rng.choice([0, 1, 5, 20, 40, 63, 64, 65, 130, 200]) + rng.randrange(3))) for _ in range(150)]
    sizes = [len(e.ids) + 1 for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs, path, window=window, end_id=0).collect()

    fills = Counter()
    for r in rows:
        fills[r["sequence_id"]] += r["length"]
    # Windows are full; what is left at the end is cut at powers of two, where no padding is due.
    open_ = sorted(n for n in fills.values() if n < window)
    assert sum(fills.values()) == sum(sizes) and len(set(open_)) == len(open_) and all(n & (n - 1) == 0 for n in open_)
    for doc, size in enumerate(sizes):  # overlong documents give full windows and one rest
        own = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == doc)
        assert [n for _, n in own if n == window] == [window] * (size // window) and sum(n for _, n in own) == size
    assert F is not None
