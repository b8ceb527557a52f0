"""The pipeline's stages against brute force over small tables."""

import random

import corpus_pipeline
from arborist.llm import simhash, zquality
from arborist.llm.common import table

from .test_operators import union_find


def jaccard(a, b):
    s = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split() for x in (a, b))]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def families(rng):
    """Groups of near copies: a text amid its ids, and copies of it with 1 to 7 changed words."""
    vocabulary, rows = [f"w{i}" for i in range(900)], []
    for k in range(8):
        base = [rng.choice(vocabulary) for _ in range(150)]
        rows.append((k * 100 + 50, " ".join(base)))
        for j in range(9):
            w = list(base)
            for p in rng.sample(range(150), rng.choice([1, 2, 4, 7])):
                w[p] = f"e{rng.randrange(10**6)}"
            rows.append((k * 100 + j + (51 if j > 4 else 0), " ".join(w)))
    return rows


def test_near_copies_match_all_pairs(spark):
    rows = families(random.Random(1)) + [(5000, ""), (5001, ""), (5002, "one two"), (5003, "One  two")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows] + [(None, None, "n"), (None, "one two", "n")], "doc_id long, text string, component_id string")
    want = union_find([(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if jaccard(a[1], b[1]) >= 0.8], [i for i, _ in rows])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i] == i)
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_are_linked_by_fingerprints_too(spark):
    """Of a text that says one line again and again a copy with a few words more has few shingles in common, but the same fingerprint."""
    line = [f"q{i}" for i in range(11)]
    once, again = " ".join(line * 40), " ".join([*line * 40, "z1", "z2", "z3", "z4", "z5"])
    docs = spark.createDataFrame([(1, again), (2, once), (3, "something else altogether"), (None, once)], "doc_id long, text string")
    assert jaccard(once, again) < 0.8
    prints = [r.fingerprint for r in simhash.near_duplicates(docs.where("doc_id < 3")).collect()]
    assert bin(int(prints[0], 16) ^ int(prints[1], 16)).count("1") <= 2
    assert sorted(r.doc_id or 0 for r in simhash.drop_near_duplicates(docs).collect()) == [0, 1, 3]
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == [0, 1, 3]


def test_links_beside_a_star_are_found(spark):
    """A centre's copies link with copies of their own that are too far from the centre; and a chain."""
    rng, rows = random.Random(2), []
    for k in range(6):
        base = [f"v{rng.randrange(10**6)}" for _ in range(155)]
        cut = lambda w, n: [*[f"n{rng.randrange(10**6)}" for _ in range(n)], *w[n:]]
        back = lambda w, n: [*w[:-n], *[f"n{rng.randrange(10**6)}" for _ in range(n)]]
        rows += [(k * 100 + j, " ".join(cut(base, 1 + j % 4))) for j in range(4, 12)] + [(k * 100, " ".join(base))]
        for j in range(12, 18):
            near = cut(base, 12)
            rows += [(k * 100 + j, " ".join(near)), (k * 100 + j + 20, " ".join(back(near, 12)))]
    link = [f"c{i}" for i in range(155)]
    for j in range(12):
        rows.append((2000 - j, " ".join(link)))
        link = [*link[12:], *[f"c{j}.{i}" for i in range(12)]]
    want = union_find([(a[0], b[0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if jaccard(a[1], b[1]) >= 0.8], [i for i, _ in rows])
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 7


def test_block_edits_are_found_without_a_third_copy(spark):
    """Pairs at 0.8 to 0.9 by a cut end, an added end and a paragraph in another's place, repeated words included."""
    rng, rows = random.Random(7), []
    for k in range(90):
        base = [f"w{rng.randrange(400)}" for _ in range(300)]
        new = [f"w{rng.randrange(400)}" for _ in range(rng.choice([30, 45, 60, 70]))]
        n, at = len(new), rng.randrange(200)
        half = new[: n // 2]
        other = [base[: 300 - n + 10], [*base, *new], [*base[:at], *half, *base[at + len(half) :]]][k % 3]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    want = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2]) if jaccard(a[1], b[1]) >= 0.8}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 40 and {(c, d) for d, c in got.items() if d != c} == want


def test_a_repeated_id_counts_by_its_smallest_text(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, two), (1, one), (2, one), (3, one), (4, two), (5, two), (6, None), (6, two)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4}


def test_pipeline_keeps_good_documents(spark, sf):
    docs = table(spark, sf, "documents")
    model = zquality.train(docs, table(spark, sf, "labels"))
    good = {r.doc_id for r in zquality.score(docs, model).where("predicted = 1").collect()}
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect()} == good
    assert corpus_pipeline.secrets(spark, docs, sf).columns == docs.columns
    kept = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert kept <= good and len(kept) > 0.5 * docs.count()
