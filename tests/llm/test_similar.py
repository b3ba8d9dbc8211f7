"""Near copies of the pipeline against all pairs of shingle sets."""

import itertools
import random

import corpus_pipeline
import numpy as np

from rollbook.llm import similar


def edited_texts():
    rng = random.Random(11)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]

    texts = []
    for size, edits in ((60, 1), (120, 2), (200, 4), (400, 7)):
        own = words(size)
        texts.append(" ".join(own))
        for _ in range(6):  # scattered edits: similar sets, fingerprints more than 4 bits apart
            copy = list(own)
            for at in rng.sample(range(size), edits):
                copy[at] = words(1)[0]
            texts.append(" ".join(copy))
    common = words(40)
    texts += [" ".join(common + words(rng.randint(5, 60))) for _ in range(12)]
    return [*texts, texts[0].upper(), "", " \n", None, "a b", "A  b", "a b c"]


def sets_of(texts):
    found = []
    for text in texts:
        words = (text or "").lower().split()
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return found


def components_of(texts):
    root, sets = list(range(len(texts))), sets_of(texts)
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return root


def test_all_pairs_are_found_and_no_others(spark):
    texts = edited_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components_of(texts)
    assert 15 < len(set(want)) < len(texts) - 10
    assert {r.id: r.component_id for r in similar.similar_copies(df).collect()} == dict(enumerate(want))


def test_the_stage_drops_copies_with_scattered_edits(spark):
    texts = edited_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = {r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, df, "").collect()}
    assert kept == set(components_of(texts))


def test_cells_above_a_block_are_compared_in_pairs_of_blocks(spark):
    texts = edited_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = similar.similar_copies(df, block=2).collect()
    assert {r.id: r.component_id for r in found} == dict(enumerate(components_of(texts)))


def test_copies_of_an_absent_original(spark):
    """Every document is a copy with scattered edits, most of them similar to some others only."""
    rng = random.Random(21)
    own = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)]
    texts = []
    for n in range(60):
        copy = list(own)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 4))):
            copy[at] = f"x{n}y{at}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in similar.similar_copies(df).collect()} == dict(enumerate(components_of(texts)))


def test_a_large_group_with_pairs_outside_its_main_component(spark):
    """Copies of one text, and chains of copies that are too far from it but near each other."""
    rng = random.Random(31)
    own = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]

    def edited(base, edits, mark):
        copy = list(base)
        for at in rng.sample(range(len(base)), edits):
            copy[at] = f"{mark}{at}"
        return copy

    texts = [own, *(edited(own, rng.choice((1, 2, 3)), f"n{n}x") for n in range(60))]
    for n in range(8):
        far = edited(own, 9, f"far{n}y")
        texts += [far, edited(far, 2, f"one{n}z"), edited(far, 2, f"two{n}z")]
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components_of(texts)
    assert 5 < len(set(want)) < 12
    for block in (1024, 16):
        assert {r.id: r.component_id for r in similar.similar_copies(df, block=block).collect()} == dict(enumerate(want))


def test_the_centre_shares_most_cells(spark):
    cells = spark.createDataFrame([(c, i, n) for c, ids in ((1, (5, 6, 9)), (2, (6, 9)), (3, (9, 7))) for i in ids for n in [len(ids)]], "cell long, id long, count long")
    assert sorted(map(tuple, similar._stars(cells).collect())) == [(5, 9), (6, 9), (7, 9)]


def test_bands_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(400):
        size = int(rng.integers(20, 600))
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        edit = max(1, size // 10)
        b = np.unique(np.concatenate([a[: size - edit], rng.integers(0, 1 << 63, edit, np.uint64) * np.uint64(2)]))
        c = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        found = similar.bands(similar.signatures([a, b, c, a]))
        met += bool((found[0] == found[1]).any())
        assert not (found[0] == found[2]).any() and (found[0] == found[3]).all()
    assert met >= 399
    signed = similar.signatures([a[:0], b[:0]])
    assert (similar.bands(signed)[0] == similar.bands(signed)[1]).all()


def test_min_hashes_agree_as_sets_are_similar():
    rng = np.random.default_rng(6)
    for share in (0.5, 0.8, 0.9):
        a = np.unique(rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[: int(400 * 2 * share / (1 + share))], rng.integers(0, 1 << 63, 400 - int(400 * 2 * share / (1 + share)), np.uint64) * np.uint64(2)]))
        signed = similar.signatures([a, b])
        assert abs((signed[0] == signed[1]).mean() - similar.jaccard(a, b)) < 0.1


def test_bucket_counts_never_rule_out_similar_sets():
    rng = np.random.default_rng(4)
    for size in (1, 9, 60, 300, 330, 2000, 2600):
        a = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        for share in (1.0, 0.9, 0.85, 0.81):
            b = a[: max(1, int(share * len(a)))]
            marks = [(len(s), similar.bucket_counts(s).tobytes()) for s in (a, b)]
            assert similar.jaccard(a, b) < 0.8 or similar.possible(*marks[0], *marks[1], 0.8)
        other = np.unique(rng.integers(0, 1 << 63, size, np.uint64) * np.uint64(2))
        assert size < 60 or not similar.possible(*marks[0], len(other), similar.bucket_counts(other).tobytes(), 0.8)


def test_a_group_that_is_almost_similar_makes_no_rows_of_its_pairs(spark, monkeypatch):
    """60 documents of similarity 0.77, all pairs of which the min-hashes leave possible."""
    texts = [" ".join([f"c{i}" for i in range(180)] + [f"d{n}w{i}" for i in range(27)]) for n in range(60)]
    sizes = {}

    def counted(df, name, plain=similar.stored):
        table = plain(df, name)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table

    monkeypatch.setattr(similar, "stored", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = similar.similar_copies(df, words=1)
    assert {r.id: r.component_id for r in found.collect()} == {n: n for n in range(60)}
    assert max(sizes.get(name, 0) for name in ("pairs", "tried", "candidates", "agreed", "links")) < 10 * len(texts), sizes


def test_texts_stay_where_they_are(spark):
    df = spark.createDataFrame(list(enumerate(edited_texts())), "doc_id long, text string")
    plan = corpus_pipeline.one_of_near_copies(spark, df, "")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
