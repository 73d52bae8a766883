import random
import re
from fractions import Fraction

from fleetledger.llm.common import Workspace
from fleetledger.llm.minhash import least_overlap, near_duplicates
from tests.llm.util import AWKWARD, documents


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute_force(rows, threshold):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * threshold.denominator >= len(sets[i] | sets[j]) * threshold.numerator:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = (rows[i][0], len(sets[i]), min(ids) if ids else None)
    return sorted(out.values(), key=str)


def check(spark, rows, threshold=Fraction(85, 100), **more):
    found = near_duplicates(documents(spark, rows), Workspace(spark), threshold, **more)
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=str)
    assert found == brute_force(rows, threshold)


def corpus(seed, n=250):
    """Groups of edited copies around the threshold, exact copies, a passage that many share, and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(rng.choice([4, 6, 12, 40, 90, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = [word() for _ in range(rng.randint(5, 60))] + passage
        text = rng.choice([" ", "\n"]).join(w)
        rows.append((i if i % 40 else None, text.upper() if rng.random() < 0.1 else text, "en"))
    rng.shuffle(rows)
    return rows


def test_links_equal_brute_force(spark):
    check(spark, corpus(1))
    check(spark, corpus(2), Fraction(80, 100))


def test_small_sketches_still_find_all_links(spark):
    check(spark, corpus(3), sketch_size=32)


def test_awkward_rows_and_empty_table(spark):
    check(spark, AWKWARD)
    check(spark, [])


def test_kept_is_the_least_id(spark):
    rows = [(3, "a b c d e f", "en"), (2, "A b c d e f", "en"), (None, "a b c d e f", "en"), (9, "q", "en"), (None, "z", "en")]
    got = near_duplicates(documents(spark, rows), Workspace(spark)).collect()
    assert sorted((r.doc_id, r.kept) for r in got if r.doc_id) == [(2, True), (3, False), (9, True)]
    assert [r.kept for r in got if r.doc_id is None] == [False, False]


def test_least_overlap_bound():
    assert 20 < least_overlap(48, Fraction(85, 100)) < 35
    assert least_overlap(10, Fraction(1, 1)) == 10


def appended(base_words, copies, seed, longest=4):
    """One text, and copies of it with one to four words behind."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(base_words)]
    rows = [(i, " ".join(base + [f"x{rng.randrange(10**9)}" for _ in range(rng.randint(1, longest))]), "en") for i in range(copies)]
    return rows


class Counting(Workspace):
    """Counts the rows of the tables of pairs."""

    pairs = 0

    def save(self, df, name):
        saved = super().save(df, name)
        if name.endswith(("-pairs", "-likely")):
            self.pairs += saved.count()
        return saved


def test_groups_of_mutual_copies_make_pairs_in_proportion(spark):
    for base, threshold, longest in ((36, Fraction(85, 100), 4), (24, Fraction(80, 100), 9)):
        made = []
        for copies in (300, 600):
            work = Counting(spark)
            rows = appended(base, copies, copies, longest)
            found = near_duplicates(documents(spark, rows), work, threshold).collect()
            if copies == 300:
                assert sorted((r.doc_id, r.component_id) for r in found) == sorted(
                    (i, c) for i, _, c in brute_force(rows, threshold)
                )
            made.append(work.pairs)
        assert made[1] < 2.6 * made[0] and made[1] < 8 * 600


def test_drifting_copies_form_one_component(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        rows.append((i, " ".join(words), "en"))
        words[rng.randrange(60)] = f"n{i}"
    work = Counting(spark)
    found = near_duplicates(documents(spark, rows), work, Fraction(80, 100)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == sorted((i, c) for i, _, c in brute_force(rows, Fraction(80, 100)))
