"""The native methods against plain Python: the randomness battery with its step-up procedure, and weak supervision by EM."""

import collections
import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from rollbook.llm import quality, queries, secrets

ALPHABETS = {
    "base62": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567",
    "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "lower": string.ascii_lowercase + string.digits,
}
SYLLABLES = "th er on an re he in ed nd ha ein ich sch ung ver zu ge be que la ent ción".split()


def battery_by_hand(token):
    """(band, bin, passes) of a candidate."""
    n = len(token)
    has = {k: any(c in s for c in token) for k, s in (("l", string.ascii_lowercase), ("u", string.ascii_uppercase), ("d", string.digits), ("s", "+/_-"))}
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        size = 16
    elif re.fullmatch("[A-Z2-7]+", token):
        size = 32
    elif not has["s"] and not (has["u"] and has["l"]):
        size = 36
    else:
        size = 64 if has["s"] else 62
    mixed = has["d"] and (has["l"] or has["u"]) or (has["l"] and has["u"] and bool(re.search("[a-z][A-Z].*[a-z][A-Z]", token)))
    squares = sum(c * c for c in collections.Counter(token).values())
    uniform = (squares * size / n - n - (size - 1)) / math.sqrt(2 * (size - 1))
    codes = [ord(c) for c in token]
    mean = sum(codes) / n
    shifted = [c - mean for c in codes]
    spread = max(sum(c * c for c in shifted), 1e-9)
    alike = sum(a * b for a, b in zip(shifted, shifted[1:])) / spread
    above = sum(c > 0 for c in shifted)
    both = 2 * above * (n - above)
    runs = (1 + sum((a > 0) != (b > 0) for a, b in zip(shifted, shifted[1:])) - both / n - 1) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9))
    passes = mixed and all(abs(z) <= secrets.BATTERY_Z for z in (uniform, alike * math.sqrt(n), runs))
    couples, rate = n * (n - 1) / 2, max(secrets.ORDINARY_RATE, 1.6 / size)
    repeats = (couples * rate - 0.5 - (squares - n) / 2) / math.sqrt(couples * rate * (1 - rate))
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else c for c in token]
    q = secrets.ORDINARY_CHANGES
    switches = (sum(a != b for a, b in zip(kinds, kinds[1:])) - 0.5 - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q))
    near = [(a, b) for a, b in zip(token.lower(), token.lower()[1:]) if a.isalpha() and b.isalpha()]
    q = secrets.ORDINARY_CONSONANTS
    hard = sum(a not in "aeiou" and b not in "aeiou" for a, b in near)
    consonants = (hard - len(near) * q) / math.sqrt(len(near) * q * (1 - q)) if near else 0.0
    z = (repeats + switches + (secrets.ORDINARY_SERIAL - alike) * math.sqrt(n) + consonants) / math.sqrt(4 + 2 * secrets.SHARED)
    limited = max(-35.0, min(35.0, -z))
    p = max(1 / (1 + math.exp(-(1.5976 * limited + 0.07056 * limited**3))), 10.0**-secrets.DECADES)
    return sum(n >= k for k in secrets.LENGTHS), -math.log10(p) * secrets.BINS_PER_DECADE, passes


def step_up_by_hand(rows):
    """Least bin per class that Benjamini and Hochberg's procedure lets through."""
    out = {}
    for band in {b for b, _, _ in rows}:
        family = sorted((bin_ for b, bin_, passes in rows if b == band and passes), reverse=True)
        good = [x for x in set(family) if 10 ** (-x / secrets.BINS_PER_DECADE) * len(family) <= secrets.DISCOVERY_RATE * sum(y >= x for y in family)]
        if good:
            out[band] = min(good)
    return out


def tokens(seed, each=20):
    rng = random.Random(seed)
    return [(kind, n, "".join(rng.choice(letters) for _ in range(n))) for kind, letters in ALPHABETS.items() for n in (24, 32, 40, 64) for _ in range(each)]


def ordinary(rng, n):
    """Words, long compounds, paths, names with numbers, rules of dashes."""
    out = []
    for _ in range(n):
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 12)))
        out.append(rng.choice([word, word, word.upper(), f"{word}/{word[::-1]}/page_{rng.randint(1, 99)}", f"{word}{rng.randint(1, 2030)}", "-" * rng.randint(3, 40), f"2024-{rng.randint(10, 12)}-{word}",
                               "".join(w.title() for w in (word[:6], word[2:8], word))]))
    return " ".join(out)


def test_battery_equals_a_plain_one(spark):
    rng = random.Random(6)
    words = [t for _, _, t in tokens(1, 3)] + re.findall(secrets.CANDIDATE, ordinary(rng, 400)) + ["a" * 25, "ab1" * 9, "A1" * 12, "0" * 30, "aA" * 15]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    found = {r.doc_id: r.secret_runs for r in secrets.scan(df).select("doc_id", "secret_runs", "secret_base").collect()}
    checked = 0
    for i, word in enumerate(words):
        for run in found[i]:
            band, bin_, passes = battery_by_hand(word[run.start : run.end])
            assert (run.band, run.passes) == (band, passes)
            assert abs(run.bin - math.floor(bin_)) <= 1 and abs(bin_ - run.bin - 0.5) < 0.52
            checked += 1
    assert checked > 80


def test_step_up_equals_a_plain_one(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 3), rng.randint(0, 160) if rng.random() < 0.5 else rng.randint(0, 30), rng.random() < 0.7) for _ in range(600)]
    df = spark.createDataFrame(rows, "band int, bin int, passes boolean")
    runs = df.groupBy(F.monotonically_increasing_id() % 7).agg(F.collect_list(F.struct("band", "bin", "passes")).alias("secret_runs"))
    assert secrets.thresholds(runs) == step_up_by_hand(rows)


def test_planted_random_tokens_are_found_and_ordinary_text_is_left(spark, tmp_path):
    rng = random.Random(3)
    planted = tokens(2)
    rows = [(i, f"{ordinary(rng, 30)} {t} {ordinary(rng, 20)}") for i, (_, _, t) in enumerate(planted)]
    rows += [(10_000 + i, ordinary(rng, 120)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits, wrong = collections.Counter(), 0
    for r in queries.op7_secret_spans(spark, str(tmp_path)).collect():
        spans = [s.split(":") for s in r.spans.split(",") if s]
        text = dict(rows)[r.doc_id]
        if r.doc_id >= 10_000:
            wrong += sum(k == "random" for k, *_ in spans)
            continue
        kind, n, token = planted[r.doc_id]
        at = text.index(token)
        hits[kind, n] += any(int(a) <= at and at + n <= int(b) for _, a, b in spans)
        wrong += sum(k == "random" and int(a) != at for k, a, _ in spans)
    assert wrong <= 3
    assert all(hits[kind, n] >= 16 for kind in ALPHABETS for n in (24, 32, 40, 64)), hits
    assert sum(hits.values()) >= 0.95 * len(planted)


def em_by_hand(votes, names, rounds=quality.ROUNDS):
    first, held = quality.FIRST_ACCURACY, quality.HOLD * len(votes)
    accuracy, prior = dict.fromkeys(names, (first, first)), quality.FIRST_PRIOR

    def good_of(row):
        odds = math.log(prior / (1 - prior))
        for n, v in zip(names, row, strict=True):
            g, b = accuracy[n]
            odds += math.log(g / (1 - b)) if v == 1 else math.log((1 - g) / b) if v == -1 else 0
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds):
        good = [good_of(r) for r in votes]
        new = {}
        for k, n in enumerate(names):
            pair = []
            for side, weight in ((1, good), (-1, [1 - g for g in good])):
                cast = sum(w for w, r in zip(weight, votes, strict=True) if r[k])
                right = sum(w for w, r in zip(weight, votes, strict=True) if r[k] == side)
                pair.append(min(max((right + held * first) / (cast + held), 1 - quality.MOST), quality.MOST))
            new[n] = tuple(pair)
        before = [prior, *(v for p in accuracy.values() for v in p)]
        prior, accuracy = min(max(sum(good) / len(votes), 0.01), 0.99), new
        if max(abs(a - b) for a, b in zip(before, [prior, *(v for p in accuracy.values() for v in p)], strict=True)) < 1e-4:
            break
    return [good_of(r) for r in votes], accuracy, prior


def noisy_documents():
    rng = random.Random(12)
    rows = []
    for i in range(240):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(25, 120))]
        kind = i % 8
        if kind == 0:
            words = [w + rng.choice(["###", "&&&", "***", "%%%"]) for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = [x for w in words for x in (w, "|")]
        text = " ".join(w + ("." if rng.random() < 0.08 and kind > 2 else "") for w in words)
        rows.append((i, text, int(kind > 2)))
    return rows


def test_posteriors_equal_a_plain_expectation_maximisation(spark):
    rows = noisy_documents()
    df = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "short text")], "doc_id long, text string")
    names = list(quality.rules())
    found = quality.judge(df).collect()
    learned = [r for r in found if not r.base_failed]
    want, _, _ = em_by_hand([tuple(r[f"vote_{n}"] for n in names) for r in learned], names)
    for r, posterior in zip(learned, want, strict=True):
        assert r.quality == pytest.approx(posterior, abs=1e-6) and r.kept == (posterior >= 0.5)
    assert all(not r.kept for r in found if r.base_failed)


def test_noise_beyond_the_base_limits_is_rejected_and_text_kept(spark):
    rows = noisy_documents()
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    kept = {r.id: r.kept for r in quality.judge(df).where("not base_failed").collect()}
    assert len(kept) > 200
    assert all(kept[i] == bool(good) for i, _, good in rows if i in kept)


def test_counts_of_the_rules(spark):
    texts = ["One, two three. four. x,, A1 (b) ünï\tend", "", None, "- - -", "a. b."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_plain, r.n_letters, r.n_distinct) for r in quality.features(df).collect()}
    for i, text in enumerate(texts):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        plain = sum(bool(re.fullmatch(r"[^\W\d_]+[,.]?", w)) for w in words)
        assert got[i] == (plain, sum(c.isalpha() for c in text or ""), len(set(words)))
