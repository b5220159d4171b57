"""Every stage against a plain version of what it should keep, on its own input."""

from collections import Counter

import corpus_pipeline
from flightline.llm import mixing
from tests.llm.test_jaccard import brute as groups


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(9000, None, "en", "src0", 0), (9001, "", "en", "src0", 0), (9002, "12 34 !", None, None, 7), (9003, "one two three four", None, None, 18), (9004, "One two three four", "en", "src1", 18)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    stage = dict(corpus_pipeline.STAGES)
    names = docs.columns
    told = stage["language_id"](spark, docs, folder)
    before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r["text"] for r in told.collect()}
    assert told.columns == names and set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
    exact = stage["exact_dedup"](spark, told, folder)
    last = {}
    for i, t in after.items():
        last[low(t)] = max(i, last.get(low(t), i))
    kept = {r["doc_id"]: r["text"] for r in exact.collect()}
    assert exact.columns == names and set(kept) == set(last.values())
    near = stage["jaccard_join"](spark, exact, folder)
    want = {i for i, _, c in groups(list(kept.items())) if i == c}
    assert near.columns == names and {r["doc_id"] for r in near.collect()} == want
    mixed = stage["mix_sources"](spark, near, folder)
    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(near).collect() if r["size"]}
    assert mixed.columns == names and Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in times.items() if n})
    final = stage["bpe_round_trip"](spark, mixed, folder)
    assert Counter(r["doc_id"] for r in final.collect()) == Counter({i: n for i, n in times.items() if n})
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), folder).collect() == []


def test_near_copies_share_four_fifths_of_their_five_word_shingles(spark):
    words = [f"word{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], *"vwxyz", *words[55:]])), (3, " ".join([*words[:50], *(f"new{i}" for i in range(8)), *words[58:]]))]
    found = corpus_pipeline.stages.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    # of 96 shingles each, 1 and 2 share 87 of 105; 1 and 3 share 84 of 108
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 3]


def test_repeated_rows_repeated_ids_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    close = long.replace("w59", "other")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    row = lambda i, t, s="a": (i, t, "en", s, len(t))
    left = lambda f, rows: sorted(((r["doc_id"], r["text"]) for r in f(spark, frame(rows), "").collect()), key=repr)
    odd = [row(1, "same words"), row(1, "same words"), row(2, "old text"), row(2, "New"), row(3, "OLD text"), row(None, "new"), row(None, "alone"), row(None, "alone")]
    assert left(corpus_pipeline.stages.exact_copies, odd) == sorted([(1, "same words"), (2, "New"), (3, "OLD text"), (None, "alone")], key=repr)
    odd = [row(4, long), row(4, long), row(5, close), row(5, "quite another text of few words"), row(None, long), row(None, "no id one two three"), row(None, "no id one two three")]
    assert left(corpus_pipeline.stages.near_copies, odd) == sorted([(4, long), (5, "quite another text of few words"), (None, "no id one two three")], key=repr)
    assert left(corpus_pipeline.stages.languages, [row(6, "one two"), row(6, "12 34"), row(None, "three"), row(None, "5")]) == sorted([(6, "one two"), (None, "three")], key=repr)
    # the first source is to have most of the words, at most three times its own; the second gives few of its
    odd = [row(7, "x y " * 40), row(7, "z " * 30, "b"), row(None, "u " * 50), row(None, "v " * 700, "b"), row(8, "t " * 90, "b")]
    mixed = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.stages.mixture(spark, frame(odd), "").collect())
    want = {(r["doc_id"], r["size"]): int(r["taken"] / r["size"] + 0.5) for r in mixing.mix(frame(odd)).collect()}
    assert mixed == Counter({(i, t): want[i, len(t.split())] for i, t, *_ in odd if want[i, len(t.split())]})
    assert len({want[7, 80], want[7, 30]}) == 2


def test_columns_with_clashing_names_pass_untouched(spark):
    """Columns named as the stages name their own keep their values, in their places."""
    names = ["_none", "_hash", "_row", "_times", "_time", "key", "hash", "id", "n", "row", "_id", "_nr", "_again", "size", "taken", "set_id", "root", "kept", "times", "digest"]
    texts = ["some words in a row", "some Words in a row", "another text with other words", "yet another of them with more words in it"]
    rows = [(i, t, "en", "a" if i % 2 else None, len(t), *[1000 * i + k for k in range(len(names))]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in names))
    whole = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == names, name
        left = {tuple(r) for r in docs.collect()}
        assert left and left <= whole, name
    assert {r[0] for r in left} <= {1, 2, 3}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
