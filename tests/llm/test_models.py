"""Language identification, toxicity and quality rules."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest

from fleetledger.llm import kneser, langid, quality, toxicity
from fleetledger.llm.common import Workspace
from fleetledger.llm.hasharray import HashArray
from tests.llm.util import AWKWARD, SF, documents, labels, pandas


def test_hash_array_finds_all_and_only_its_keys():
    keys = np.arange(0, 5000, 3, dtype=np.int64)
    table = HashArray.build(keys, keys * 2)
    row = table.find(np.arange(5000))
    assert ((row >= 0) == (np.arange(5000) % 3 == 0)).all()
    assert (table.values[row[row >= 0]] == keys * 2).all()


def test_probabilities_of_each_context_sum_to_one(spark):
    words = spark.createDataFrame([("a", "abab", 3), ("a", "abc", 2), ("b", "cab", 4)], "cls string, word string, n long")
    model = kneser.train(Workspace(spark), words)
    for context in ("", "a", "ab", "ca", "zz"):
        total = np.zeros(2)
        for code in [*range(1, 2048)]:
            keys = 0
            for c in context:
                keys = keys << kneser.BITS | ord(c)
            total += np.exp(kneser._below(model, np.array([keys << kneser.BITS | code]), len(context) + 1)[0])
        left = (kneser.SLOTS - 2047) / kneser.SLOTS
        assert (total <= 1.001).all() and (total >= 1 - left - 0.001).all()


def test_scores_equal_a_plain_walk(spark):
    words = spark.createDataFrame([("a", "abab", 3), ("a", "abc", 2), ("b", "cab", 4)], "cls string, word string, n long")
    model = kneser.train(Workspace(spark), words)
    total, _, size = model.score(["ab", "cabx"])
    assert size.tolist() == [3, 5]
    plain = 0
    marked = [1, ord("a"), ord("b"), 2]
    for i in range(1, 4):
        key = 0
        for c in marked[: i + 1]:
            key = key << kneser.BITS | c
        plain = plain + kneser._below(model, np.array([key]), i + 1)[0]
    assert np.allclose(total[0], plain, atol=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = pandas(langid.identify(docs, Workspace(spark)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id"))
    assert (got.lang == got.lang_pred).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_language_of_awkward_rows(spark):
    got = langid.identify(documents(spark, AWKWARD), Workspace(spark)).collect()
    assert len(got) == len(AWKWARD)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[1] == by[2] == by[3] == by[7] == "und" and by[8] != "und"
    assert langid.identify(documents(spark, []), Workspace(spark)).count() == 0
    assert {r.lang_pred for r in langid.identify(documents(spark, [(4, "abc", None)]), Workspace(spark)).collect()} == {"und"}


def test_toxic_expressions_are_found_in_held_out_documents(spark):
    rng = np.random.default_rng(5)
    plain = ["".join(rng.choice(list("aeioubcd"), 3)) for _ in range(60)]
    rows, marks = [], []
    for i in range(400):
        w = rng.choice(plain, 40).tolist()
        if i % 4 == 0:
            w[7] = "Nasty!"
        rows.append((i, " ".join(w), "en"))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = documents(spark, rows + [(None, None, None), (1000, "", None)])
    got = pandas(toxicity.classify(docs, labels(spark, [*marks, (None, 1, 1), (7, None, None)]), Workspace(spark)))
    assert len(got) == 402 and got.score.between(0, 1).all()
    known = got[got.doc_id < 400]
    assert ((known.doc_id % 4 == 0) == (known.predicted == 1)).mean() > 0.99


def test_rare_toxic_expressions_count_in_large_texts(spark):
    rng = np.random.default_rng(3)
    plain = ["".join(w) for w in itertools.product("abcde", "aeiou", "abcde", "aeiou")]
    rows, marks = [], []
    for i in range(3000):
        w = rng.choice(plain, 500, replace=False).tolist()
        toxic = i % 150 == 0
        rows.append((i, " ".join([*w, "znasty"] if toxic else w), "en"))
        marks.append((i, 1, int(toxic)))
    got = pandas(toxicity.classify(documents(spark, rows), labels(spark, marks), Workspace(spark)))
    toxic = got.doc_id % 150 == 0
    assert toxic.sum() == 20 and (got.ratio[toxic] > 0).all() and (got.ratio[~toxic] <= 0).all()


def test_expressions_far_inside_long_words_count(spark, monkeypatch):
    """What tells is the 40th letter of a word; ordinary words agree with it up to there."""
    rng = np.random.default_rng(4)
    plain, stem = ["".join(rng.choice(list("aeioubcd"), 3)) for _ in range(60)], "abcdefghij" * 4
    rows, marks = [], []
    for i in range(600):
        rows.append((i, " ".join([*rng.choice(plain, 20), stem + ("nasty" if i % 3 == 0 else "gentle")]), "en"))
        marks.append((i, 1, int(i % 3 == 0)))
    for most in (toxicity.BROADCAST_PREFIXES, 0):
        monkeypatch.setattr(toxicity, "BROADCAST_PREFIXES", most)
        got = pandas(toxicity.classify(documents(spark, rows), labels(spark, marks), Workspace(spark)))
        assert ((got.doc_id % 3 == 0) == (got.predicted == 1)).all()


def test_toxicity_by_join_equals_that_by_broadcast(spark, monkeypatch):
    tables = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")]
    docs = tables[0].select("doc_id", "text").union(documents(spark, AWKWARD).select("doc_id", "text"))
    order = ["doc_id", "ratio", "score"]
    one = pandas(toxicity.classify(docs, tables[1], Workspace(spark))).sort_values(order).reset_index(drop=True)
    monkeypatch.setattr(toxicity, "BROADCAST_PREFIXES", 0)
    two = pandas(toxicity.classify(docs, tables[1], Workspace(spark))).sort_values(order).reset_index(drop=True)
    assert len(one) == len(two) and np.allclose(one.ratio, two.ratio) and (one.predicted == two.predicted).all()
    assert (one.ratio != 0).any()


@pytest.mark.parametrize("marks", [[], [(5, 1, 0), (8, 1, 0)], [(5, 1, 1)]])
def test_toxicity_without_both_classes(spark, marks):
    got = toxicity.classify(documents(spark, AWKWARD), labels(spark, marks), Workspace(spark)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(documents(spark, []), labels(spark, marks), Workspace(spark)).count() == 0


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()] + AWKWARD + [(70, "a b c d e f g h " * 3 + "\nq\nq\n \n", "en")]
    marks = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = quality.judge(documents(spark, rows), labels(spark, marks), Workspace(spark)).collect()
    mine = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got if r.doc_id is not None)
    assert mine == sorted((i, *plain_counts(t)) for i, t, _ in rows if i is not None)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_without_labels_leaves_the_base_rules(spark):
    got = quality.judge(documents(spark, AWKWARD), labels(spark, []), Workspace(spark)).collect()
    assert all(r.kept != r.base_failed for r in got) and len(got) == len(AWKWARD)
    assert quality.judge(documents(spark, []), labels(spark, []), Workspace(spark)).count() == 0


def test_symbols_are_rejected_and_prose_is_kept(spark):
    rng = np.random.default_rng(1)
    part = ["an", "the", "ing", "er", "on", "th", "re", "st"]
    prose = lambda n: " ".join("".join(rng.choice(part, rng.integers(1, 4))) for _ in range(n))
    rows = [(i, prose(60), "en") for i in range(300)]
    junk = [(1000 + i, re.sub(" ", "*** ", prose(60).upper()), "en") for i in range(20)]
    got = pandas(quality.judge(documents(spark, rows + junk), labels(spark, [(i, 1, 0) for i in range(200)]), Workspace(spark)))
    assert got[got.doc_id < 1000].kept.all() and not got[got.doc_id >= 1000].kept.any()
