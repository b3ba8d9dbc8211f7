"""Neighbour votes, conversation trie and Merkle manifest against brute force and against their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, docs, empty  # noqa: F401  (fixtures)

from rollbook.llm import conversations, merkle, neighbours, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(last node, siblings per leaf) of a tree of eights."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    own = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf in own:
            at = place[leaf]
            run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
            proofs[leaf].append((run[: at % 8], run[at % 8 + 1 :]))
            place[leaf] = at // 8
        nodes = [digest(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], proofs


def manifest_by_hand(rows):
    """Rows (id, text, lang, source, n_chars) to the columns of op13."""

    def leaf(i, text, lang, source, n):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))

    groups = {}
    for row in rows:
        i, text = row[:2]
        lowered = text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        hit = i is None or zlib.crc32(str(i).encode()) % 3 == 0
        groups.setdefault(row[2], []).append((i, leaf(*row), leaf(i, lowered, *row[2:]) if hit else leaf(*row)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, out = [], []
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        top, proofs = tree([r[1] for r in groups[g]])
        subroots.append((top, proofs))
    root, crowns = tree([s for s, _ in subroots])
    for g, (top, proofs), crown in zip(order, subroots, crowns, strict=True):
        for (i, own, checked), proof in zip(groups[g], proofs, strict=True):
            node, text = checked, ""
            for before, after in proof + crown:
                node, text = digest(*before, node, *after), text + "".join(before + after)
            out.append((i, own, top, root, digest(text), node, node == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows_of(df, columns=COLUMNS):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_manifest_on_the_fixture(spark, docs):  # noqa: F811
    want = manifest_by_hand([(i, t, lang, None, None) for i, t, lang, *_ in ROWS])
    assert rows_of(queries.op13_merkle_manifest(spark, docs)) == Counter(want)


@pytest.mark.parametrize("langs", [["x"], [f"l{n:02d}" for n in range(70)] + [None, "é", "Z"]])
def test_manifest_over_many_superblocks(spark, langs):
    rng = random.Random(2)
    rows = [(n, f"Text {n}", rng.choice(langs[:1] * len(langs) + langs), "s", n) for n in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lowered = F.translate("text", "T", "t")
    checked = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.leaf_of("doc_id", "source", "lang", "n_chars", lowered))
    found = merkle.manifest(df, checked, proofs=True, block_levels=1).withColumnRenamed("id", "doc_id").cache()
    assert rows_of(found) == Counter(manifest_by_hand(rows))
    for r in found.collect():
        node = r.leaf
        for before, after in r.proof:
            node = digest(before, node, after)
        assert node == r.root


def crc(c):
    return zlib.crc32(str(c).encode())


def rebuilt_by_hand(rows):
    """Conversations of rows (conv_id, turn, role, text) as op12 rebuilds them."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    return {c: tuple(own.get(c - c % 20, [])[: crc(c) % 4] + turns[crc(c) % 4 :]) for c, turns in own.items()}


def trie_by_hand(found):
    members = {}
    for c, turns in sorted(found.items()):
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, convs in members.items():
        inside = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in inside)
        saved = sum((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) for p in inside if p)
        children = sum(len(q) == len(path) + 1 for q in inside)
        ends = ",".join(str(c) for c in convs if len(found[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        out.append((convs[0], len(path), parent, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string, key string, depth string"


def some_conversations():
    rng = random.Random(4)
    rows = []
    for c in range(130):
        if c % 11 == 3 or c == 40:
            continue  # absent, among them one that others begin like
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn, rng.choice(["user", "user", None]), rng.choice(["hi there", "a  b\nc", "", None, "x y"])))
    rows += [(200, t, "user", "one of many") for t in range(60)] + [(201, t, "user", "one of many") for t in range(60)] + [(202, t, "user", "one of many") for t in range(57)]
    rows += [(None, 1, "user", "nobody's")]
    return [(*r, "k", "d") for r in rows]


def test_trie_on_small_conversations(spark, tmp_path):
    rows = some_conversations()
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    want = Counter(trie_by_hand(rebuilt_by_hand([r[:4] for r in rows])))
    assert rows_of(queries.op12_conversation_trie(spark, str(tmp_path)), NODE) == want


@pytest.mark.parametrize("band, shard", [(4, 3), (1, 2), (3, 1000)])
def test_fragments_and_shards_do_not_show(spark, band, shard):
    rows = some_conversations()
    df = spark.createDataFrame(rows, TURNS)
    found = conversations.trie(conversations.with_shared_starts(conversations.turn_rows(df), 20, 4), band, shard)
    assert rows_of(found, NODE) == Counter(trie_by_hand(rebuilt_by_hand([r[:4] for r in rows])))


def test_equal_turns_and_repeated_rows_are_turns_of_their_own(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a"), (1, 0, "u", "b"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    found = conversations.trie(conversations.turn_rows(df)).collect()
    assert max(r.depth for r in found) == 3 and sum(r.depth == 0 for r in found) == 1
    assert next(r for r in found if r.depth == 0).n_convs == 2


def test_sql_gives_the_same(spark, docs, tmp_path):  # noqa: F811
    spark.createDataFrame(some_conversations(), TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    for name, folder, columns, tables in (("op12_conversation_trie", str(tmp_path), NODE, "conversations"), ("op13_merkle_manifest", docs, COLUMNS, "documents")):
        db = duckdb.connect()
        db.execute(f"create view {tables} as select * from '{folder}/{tables}.parquet/*.parquet'")
        found = db.sql(queries.oracle_sql()[name])
        assert sorted(found.columns) == sorted(columns)
        want = Counter(found.project(", ".join(columns)).fetchall())
        assert rows_of(queries.queries()[name](spark, folder), columns) == want


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_conversation_trie(spark, str(tmp_path)).collect() == []


def test_nearest_are_exact_and_ties_go_to_the_earlier():
    rng = np.random.default_rng(1)
    vectors = neighbours.unit(rng.normal(size=(3000, 8)).astype(np.float32))
    vectors[2000] = vectors[5]
    model = neighbours.Model(None, None, vectors, np.zeros(3000), np.ones(3000), 0.0)
    asked = neighbours.unit(rng.normal(size=(50, 8)).astype(np.float32))
    asked[0] = vectors[5]
    numbers, similar = model.nearest(asked)
    assert numbers[0][:2].tolist() == [5, 2000]
    for q, own, cosines in zip(asked, numbers, similar, strict=True):
        steps = np.rint((vectors @ q) * neighbours.STEP)
        want = np.lexsort((np.arange(3000), -steps))[: neighbours.NEIGHBOURS]
        assert np.abs(vectors[want] @ q - cosines).max() < 1e-4
        assert len(set(own) & set(want)) >= neighbours.NEIGHBOURS - 1


def test_terms_against_a_plain_count():
    texts = ["The the THE a### 北京 x1", "", "b b b b", " \n ", "one"]
    shape = {"The": "Aa", "the": "a", "THE": "A", "a###": "a###", "北京": "a", "x1": "a0", "b": "a", "one": "a"}
    rows, terms, counts = neighbours._slice_counts(pa.array(texts))
    found = {(int(r), int(t)): int(c) for r, t, c in zip(rows, terms, counts, strict=True)}
    want = Counter()
    for n, text in enumerate(texts):
        words = WORD.findall(text)
        for kind, names in (("word", [w.lower() for w in words]), ("shape", [shape[w] for w in words])):
            want.update((n, int(t)) for t in neighbours._buckets(kind, pa.array(names, pa.string())))
        if words:
            want[n, 0] += sum(a == b for a, b in zip(words, words[1:]))
            want[n, 1 + min(3, 4 * len(set(words)) // len(words))] += 4
    assert found == {k: v for k, v in want.items() if v}


def labelled(rng, n):
    syllables = "th er on an re he in ed nd ha".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 80))]
    good = n % 5 != 0
    return (n, " ".join(words if good else [w + rng.choice(["###", "&&&"]) for w in words]), int(good))


def test_votes_tell_labelled_kinds_apart_and_equal_a_plain_vote(spark, tmp_path):
    rng = random.Random(8)
    rows = [labelled(rng, n) for n in range(300)] + [(1000, "", None), (1001, None, None), (None, "no id", 1), (7, "twice", 0)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id long, text string, found string, terms string")
    marks = spark.createDataFrame([(i, q) for i, _, q in rows if q is not None], "doc_id long, quality int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in queries.op11_neighbour_quality(spark, str(tmp_path)).collect() if r.doc_id != 7}
    held = [r for i, r in found.items() if i is not None and i < 300 and r.held_out]
    assert len(held) > 30 and all(r.predicted == int(r.doc_id % 5 != 0) for r in held)
    assert found[1000].score == found[1001].score and 0 < found[1000].score < 1
    # the same votes by a plain loop over the model's vectors
    counted = neighbours.counted_texts(df.select("doc_id", "text"))
    model, rows_found = neighbours.fit_counted(counted, marks), counted.select("doc_id", "found.*").toArrow()
    scores = {r.doc_id: r.s for r in counted.select("doc_id", neighbours.score(counted, model).alias("s")).collect() if r.doc_id != 7}
    for i, terms, counts in zip(*(rows_found[c].to_pylist() for c in ("doc_id", "terms", "counts")), strict=True):
        if i in (None, 7):
            continue
        x = np.zeros(neighbours.TERMS)
        for t, c in zip(terms, counts, strict=True):
            x[t] = (1 + np.log(c)) * model.idf[t]
        y = x @ model.basis
        if not np.abs(y).sum():
            assert scores[i] == pytest.approx(model.prior)
            continue
        cosines = model.vectors @ (y / np.sqrt(y @ y))
        best = np.argsort(-cosines)[: neighbours.NEIGHBOURS]
        votes = np.maximum(cosines[best], 0) ** neighbours.SHARPNESS * model.weights[best]
        assert scores[i] == pytest.approx((votes * model.labels[best]).sum() / votes.sum(), abs=0.02)


@pytest.mark.parametrize("labels, score", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0)])
def test_votes_without_two_kinds(spark, labels, score):
    counted = neighbours.counted_texts(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"))
    model = neighbours.fit_counted(counted, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {r.s for r in counted.select(neighbours.score(counted, model).alias("s")).collect()} == {score}
