"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from flightline.llm import common, phrases


def plain(rows, support, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3, 4):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            longer = [q for q in found if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * found[q] >= 80 * a for q in longer):
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def made(seed, rows=400):
    rng = random.Random(seed)
    letters = ["the", "The", "of", "ÀB", "àb", "x\0y", "new", "york", "city", "hall", "e\x1fe", "日本", "a"]
    texts = [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(letters) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!", "\x0b", "\xa0"])
                                                              for _ in range(rng.randint(0, 40)))) for _ in range(rows)]
    return texts + [("en", None), ("en", ""), ("en", " ,.\n"), ("en", "new york " * 3000)] + [("de", "Same words here again, same words here.")] * 40


@pytest.mark.parametrize("seed, support, top", [(1, 30, 2000), (2, 5, 7), (3, 1, 50)])
def test_same_as_plain(spark, seed, support, top):
    rows = made(seed)
    frame = spark.createDataFrame([(i, lang, text, 1, "z") for i, (lang, text) in enumerate(rows)], "key long, lang string, text string, n int, phrase string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(frame, support=support, top=top).collect())
    assert got == plain(rows, support, top)


def test_no_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).collect() == []


def test_full_filters_change_nothing(spark, monkeypatch):
    """Where so many phrases share a place that the filters say nothing, the counts are still exact."""
    for module in (phrases, common):
        monkeypatch.setattr(module, "SLOTS", 4)
    monkeypatch.setattr(common, "PAGE", 2)
    rows = made(4, 150)
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(frame, support=6).collect()) == plain(rows, 6, 2000)
