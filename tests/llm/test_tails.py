"""What tasks hold of a model does not change what it says."""

import numpy as np

from fleetledger.llm import kneser, langid, quality
from fleetledger.llm.common import Workspace
from tests.llm.util import AWKWARD, SF, documents


def test_words_outside_the_held_tables_are_scored_by_the_whole(spark):
    words = spark.createDataFrame([("a", "abab", 300), ("a", "abc", 2), ("b", "cab", 40), ("b", "xyz", 1)], "cls string, word string, n long")
    whole, none = kneser.learn(Workspace(spark), words)
    part, rest = kneser.learn(Workspace(spark), words, limit=4)
    assert none is None and whole.whole and not part.whole
    names = ["abab", "xyz", "abc", "cabx", "", "é", "zzzzzzz"]
    total, squares, size = whole.score(names)
    got, got_squares, got_size, sure = part.sure_score(names)
    assert sure[0] and not sure.all() and (size == got_size).all()
    assert np.allclose(got[sure], total[sure], atol=1e-4) and np.allclose(got_squares[sure], squares[sure], rtol=1e-4)
    asked = spark.createDataFrame([(w,) for w in names], "word string")
    rows = {r.word: r for r in kneser.word_scores(rest, asked, part.classes).collect()}
    assert np.allclose([rows[w].totals for w in names], total, atol=1e-4)
    assert np.allclose([rows[w].squares for w in names], squares, rtol=1e-4)


def test_languages_do_not_depend_on_what_tasks_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").union(documents(spark, AWKWARD).select("doc_id", "text", "lang"))
    runs = []
    for limit in (kneser.MAX_ENTRIES, 300):
        rows = langid.identify(docs, Workspace(spark), limit).collect()
        runs.append(sorted((r.doc_id is None, r.doc_id or 0, r.lang_pred, round(r.score, 3), round(r.entropy or 0, 3)) for r in rows))
    assert len(runs[0]) == len(runs[1])
    near = [a[:3] == b[:3] and abs(a[3] - b[3]) < 0.01 and abs(a[4] - b[4]) < 0.01 for a, b in zip(*runs, strict=True)]
    assert all(near)


def test_verdicts_do_not_depend_on_what_tasks_hold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    runs = []
    for limit in (kneser.MAX_ENTRIES, 300):
        rows = quality.judge(docs, labels, Workspace(spark), limit).collect()
        runs.append({r.doc_id: (r.kept, r.base_failed, r.n_words, r.log_perplexity or 0, r.low or 0, r.high or 0) for r in rows})
    assert runs[0].keys() == runs[1].keys()
    for doc, a in runs[0].items():
        assert a[:3] == runs[1][doc][:3] and np.allclose(a[3:], runs[1][doc][3:], atol=1e-3)
