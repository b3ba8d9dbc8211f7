"""Secret scans: patterns, and a battery of randomness tests, with DataFrame functions only.

Patterns give the base spans. Beside them every long run of letters, digits and `+/_-` is a candidate if it mixes character kinds
and passes as random in the alphabet of its inferred encoding: chi-squared uniformity, runs above and below the middle, serial
correlation. Only those form the family that is tested further, so long words, paths and rules of dashes don't weigh on it.

Four measures tell a candidate from ordinary text of its length: how rarely its characters repeat each other (the chi-squared sum
against the rate of ordinary words), how often the kind of character changes (a runs test over capitals, small letters, digits and
signs), how little neighbours resemble each other (serial correlation against that of ordinary text), and how many neighbouring
letters are both consonants (letter pairs). Their z values are added up, with the correlation of the second and third allowed for,
and give the p-value as ordinary text; p-values are held to a false-discovery rate by the step-up procedure, in classes of length,
because a short run can't be as surprising as a long one. Runs that overlap a base span add nothing.

Positions are code points. Null text is empty. Repeated rows come back repeated, a table without rows gives none. Nothing
is exploded but the p-values' histogram, whose size is fixed.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import stored

#: Kind, pattern, group to be measured, least length of that group.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
UPPER, LOWER, DIGITS = ascii_uppercase, ascii_lowercase, "0123456789"
CONSONANTS = "".join(c for c in LOWER if c not in "aeiou")
RANDOM = "random"
KINDS = (*(p[0] for p in PATTERNS), RANDOM)
#: Of ordinary text: how often two characters of a word agree, how often the kind of character changes from one to the next, how
#: alike neighbours are, and how often two neighbouring letters are both consonants.
ORDINARY_RATE = 0.065
ORDINARY_CHANGES = 0.15
ORDINARY_SERIAL = 0.45
ORDINARY_CONSONANTS = 0.38
#: Correlation of changes of kind and serial correlation, for adding them up.
SHARED = 0.5
DISCOVERY_RATE = 0.01
#: Two-sided limit of the battery's z values.
BATTERY_Z = 3.3
BINS_PER_DECADE, DECADES = 20, 20
LENGTHS = (24, 32, 64)


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, value) of the matches whose measured group is long enough, leftmost first."""
    expression = F.lit(pattern)
    whole, between = F.regexp_extract_all(text, expression, F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, expression, F.lit(group)) if group else whole
    parts = F.arrays_zip(whole.alias("whole"), value.alias("value"), F.slice(between, F.lit(1), F.size(whole)).alias("before"))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["before"])
        end = start + F.length(part["whole"])
        own = F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value")))
        return F.struct(end.alias("at"), F.concat(state["spans"], own).alias("spans"))

    spans = F.aggregate(parts, first, step, lambda state: state["spans"])
    kept = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    return F.when(F.regexp_like(text, expression), kept).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _of_kind(spans: Column, kind: int) -> Column:
    """(start, kind, end) of spans."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _normal(z: Column) -> Column:
    """Distribution function of the standard normal (logistic approximation, exact enough for ranking)."""
    limited = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))
    return 1 / (1 + F.exp(-(1.5976 * limited + 0.07056 * limited * limited * limited)))


def _tested(span: Column) -> Column:
    """Battery of a candidate: struct of start, end, length class, bin of p as ordinary text, and whether it may be random."""
    token = span["value"]
    n = F.length(token).cast("double")
    lower, upper = F.regexp_like(token, F.lit("[a-z]")), F.regexp_like(token, F.lit("[A-Z]"))
    digit, sign = F.regexp_like(token, F.lit("[0-9]")), F.regexp_like(token, F.lit("[+/_-]"))
    size = (
        F.when(F.regexp_like(token, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), 16)
        .when(F.regexp_like(token, F.lit("^[A-Z2-7]+$")), 32)
        .when(~upper & ~sign, 36)
        .when(~lower & ~sign, 36)
        .when(~sign, 62)
        .otherwise(64)
    )
    mixed = digit & (lower | upper) | (lower & upper & F.regexp_like(token, F.lit("[a-z][A-Z].*[a-z][A-Z]")))
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("double"))

    def beside(values: Column, of) -> Column:  # noqa: ANN001
        """Sum of a function of each value and the next."""
        later = F.slice(values, F.lit(2), F.size(values) - 1)
        return F.aggregate(F.zip_with(F.slice(values, F.lit(1), F.size(values) - 1), later, of), F.lit(0.0), lambda total, x: total + x)

    counts = F.transform(F.array_distinct(F.split(token, "")), lambda c: n - F.length(F.replace(token, c, F.lit(""))))
    squares = F.aggregate(counts, F.lit(0.0), lambda total, c: total + c * c)
    chi = squares * size / n - n
    uniform = (chi - (size - 1)) / F.sqrt(2.0 * (size - 1))
    mean = F.aggregate(codes, F.lit(0.0), lambda total, c: total + c) / n
    shifted = F.transform(codes, lambda c: c - mean)
    spread = F.aggregate(shifted, F.lit(0.0), lambda total, c: total + c * c)
    alike = beside(shifted, lambda a, b: a * b) / F.greatest(spread, F.lit(1e-9))
    above = F.aggregate(shifted, F.lit(0.0), lambda total, c: total + F.when(c > 0, 1.0).otherwise(0.0))
    changes = 1 + beside(shifted, lambda a, b: F.when((a > 0) != (b > 0), 1.0).otherwise(0.0))
    both = 2 * above * (n - above)
    deviation = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
    runs = (changes - both / n - 1) / deviation
    serial = alike * F.sqrt(n)
    passes = mixed & (F.abs(uniform) <= BATTERY_Z) & (F.abs(serial) <= BATTERY_Z) & (F.abs(runs) <= BATTERY_Z)

    # against ordinary text: larger is more random
    couples = n * (n - 1) / 2
    rate = F.greatest(F.lit(ORDINARY_RATE), 1.6 / size)
    repeats = (couples * rate - 0.5 - (squares - n) / 2) / F.sqrt(couples * rate * (1 - rate))
    kinds = F.transform(F.split(F.translate(token, UPPER + LOWER + DIGITS, "A" * 26 + "a" * 26 + "0" * 10), ""), lambda c: F.ascii(c).cast("double"))
    switches = (beside(kinds, lambda a, b: F.when(a != b, 1.0).otherwise(0.0)) - 0.5 - (n - 1) * ORDINARY_CHANGES) / F.sqrt((n - 1) * ORDINARY_CHANGES * (1 - ORDINARY_CHANGES))
    unlike = (ORDINARY_SERIAL - alike) * F.sqrt(n)
    # 1 for consonants, 0 for vowels, far below for all else
    sounds = F.transform(F.split(F.translate(F.lower(token), "aeiou" + CONSONANTS, "0" * 5 + "1" * 21), ""), lambda c: F.when(c == "1", 1.0).when(c == "0", 0.0).otherwise(-9.0))
    # digits are told from vowels by the token itself
    letters = F.zip_with(F.split(F.lower(token), ""), sounds, lambda c, v: F.when(F.regexp_like(c, F.lit("[a-z]")), v).otherwise(-9.0))
    pairs = beside(letters, lambda a, b: F.when((a >= 0) & (b >= 0), 1.0).otherwise(0.0))
    hard = beside(letters, lambda a, b: F.when((a > 0) & (b > 0), 1.0).otherwise(0.0))
    consonants = F.when(pairs > 0, (hard - pairs * ORDINARY_CONSONANTS) / F.sqrt(F.greatest(pairs, F.lit(1.0)) * ORDINARY_CONSONANTS * (1 - ORDINARY_CONSONANTS))).otherwise(0.0)
    z = (repeats + switches + unlike + consonants) / math.sqrt(4 + 2 * SHARED)
    band = sum((F.when(n >= limit, 1).otherwise(0) for limit in LENGTHS), F.lit(0))
    p = F.greatest(_normal(-z), F.lit(10.0**-DECADES))
    bin_ = F.floor(-F.log10(p) * BINS_PER_DECADE).cast("int")
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), band.cast("int").alias("band"), bin_.alias("bin"), passes.alias("passes"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of docs and `secret_*` columns: base spans per kind, and tested candidates that meet no base span.

    A column of such a name is replaced; id_column is only kept.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    base = [_found(text, pattern, group, least) for _, pattern, group, least in PATTERNS]
    kinds = [_of_kind(found, k) for k, found in enumerate(base)]
    out = docs.withColumns({f"secret_{kind}": spans for (kind, *_), spans in zip(PATTERNS, kinds, strict=True)})
    out = out.withColumn("secret_base", F.sort_array(F.concat(*[F.col(f"secret_{p[0]}") for p in PATTERNS])))
    runs = F.filter(_found(text, CANDIDATE, 0, 20), lambda c: ~F.exists("secret_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return out.withColumn("secret_runs", F.transform(runs, _tested))


def thresholds(scanned: DataFrame) -> dict[int, int]:
    """Least bin of p per length class that the step-up procedure lets through; the histogram has a fixed size."""
    runs = scanned.select(F.explode(F.filter("secret_runs", lambda r: r["passes"])).alias("r")).select("r.band", "r.bin")
    counts = runs.groupBy("band", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("band").orderBy(F.col("bin").desc())
    total = Window.partitionBy("band")
    ranked = counts.select("band", "bin", F.sum("n").over(order).alias("found"), F.sum("n").over(total).alias("all"))
    chance = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    good = ranked.filter(chance * F.col("all") <= DISCOVERY_RATE * F.col("found"))
    return {r.band: r.bin for r in good.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def with_spans(scanned: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Adds `secret_spans`: base spans and the runs found random, by start, then kind."""
    def random(run: Column) -> Column:
        passed = [(run["band"] == b) & (run["bin"] >= n) for b, n in limits.items()]
        return run["passes"] & (passed[0] if len(passed) == 1 else F.greatest(*passed) if passed else F.lit(False))

    added = _of_kind(F.filter("secret_runs", random), len(PATTERNS))
    return scanned.withColumn("secret_spans", F.sort_array(F.concat("secret_base", added)))


def listed(spans: str) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, spans per kind (`secret_*`) and `secret_spans` of every document; texts are read once."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    scanned = stored(scan(narrow, "id", "text").drop("text"), "secrets")
    return with_spans(scanned, thresholds(scanned))


def redact(docs: DataFrame, text_column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced by `mark`; all other columns stay. The text of null stays null."""
    scanned = scan(docs, text_column=text_column)
    marked = with_spans(scanned, thresholds(scanned))
    text = F.col(text_column).cast("string")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        new = F.when(s["start"] >= state["at"], F.concat(state["text"], kept, F.lit(mark))).otherwise(state["text"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), new.alias("text"))

    done = F.aggregate("secret_spans", first, step, lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))))
    changed = F.when(F.size("secret_spans") > 0, done).otherwise(text)
    return marked.withColumn(text_column, changed).select(*docs.columns)
