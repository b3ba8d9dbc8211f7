"""Prefix trie of conversations from vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations that start with it. Conversations are cut into
fragments of `BAND` turns and dealt by ranges of (band, conversation); each task takes shards of at most `SHARD` fragments. A
shard is indexed vertically: for every (position, turn) one bitset of the fragments that have this turn there, and for every
position one of those that end. A depth-first search intersects the parent's bitset with the postings of the next position:
what is left over are the children, popcounts and end lists of the shard. Rows of equal nodes are then added up over shards.

Nodes are known by a key: the hash of the parent's key and the turn. A fragment behind the first starts at the key of the whole
text before it, which is a sum of hashes of (band, fragment), taken as a running sum over segments, so a conversation of any
length is spread over tasks like any other rows.

Sums over subtrees need no walk: every node is owned by its smallest member, and a conversation owns the nodes from some depth
to its end. So the subtree of a node holds all that its other members own and what its owner owns from there on.

Null role and text are empty, rows without conversation id are left out. Turns stand in the order of `turn`, nulls first, equal
ones in the order of their hash; repeated rows are turns of their own. An empty table gives no rows. The end list of one node is
hashed in one task, as SHA-256 takes its input in order, but read as a stream of one row per shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import stored
from rollbook.scale import keyed_join, segmented

#: Turns of a fragment and fragments of a shard, at most.
BAND = 256
SHARD = 1024
KEY_BYTES = 16
LANES = 4
EMPTY_LIST = sha256(b"").hexdigest()
PIECES = "key binary, parent binary, depth int, words long, members array<long>, first_end long, ends string"


def n_words(text: Column) -> Column:
    """Words between blanks (space and the characters 9 to 13)."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, place, turn_hash, words) of conversations, place from 0; texts stay where they are."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    narrow = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.unhex(F.sha2(both, 256)), 1, KEY_BYTES).alias("turn_hash"), n_words(text).alias("words"),
    )
    narrow = stored(narrow.withColumn("row", F.monotonically_increasing_id()), "turns")
    placed = segmented(narrow, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("turn_hash"), F.asc("row")], "place")
    return placed.select("conv_id", (F.col("place") - 1).alias("place"), "turn_hash", "words")


def with_shared_starts(rows: DataFrame, every: int, most: int) -> DataFrame:
    """Conversations that begin like another one: the first h turns (crc32 of the id modulo `most`) are taken from the
    conversation whose id is the next lower multiple of `every`, all if it has fewer, none if it is absent.

    Takes and returns rows as of `turn_rows`; every conversation also gets a row without place, so those left without turns stay.
    """
    length = F.expr(f"cast(crc32(cast(cast(conv_id as string) as binary)) % {most} as int)")
    own = stored(rows.withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(every)), "h": length}), "own-turns")
    heads = own.where((F.col("place") < most - 1) & (F.col("conv_id") == F.col("base"))).groupBy("base")
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("place", "turn_hash", "words"))).alias("head"))
    heads = stored(heads, "heads")
    named = own.where(F.col("place") == 0).select("conv_id", "base", "h")
    starts = named.join(heads, "base", "left").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("s")).select("conv_id", "s.*")
    rest = keyed_join(own.where(F.col("place") >= F.col("h")), heads.select("base", F.size("head").alias("n")), ["base"])
    shift = F.least("h", F.coalesce("n", F.lit(0))) - F.col("h")
    rest = rest.select("conv_id", (F.col("place") + shift).alias("place"), "turn_hash", "words")
    marks = named.select("conv_id", F.lit(None).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_hash"), F.lit(None).cast("long").alias("words"))
    return rest.unionByName(starts).unionByName(marks)


def _starts(rows: DataFrame, band_turns: int) -> DataFrame:
    """Per full fragment (conv_id, band) the key `next` of all turns up to its end."""
    long = rows.where(F.col("place") == band_turns - 1).select("conv_id")
    full = keyed_join(rows, long, ["conv_id"], "left_semi").groupBy("conv_id", "band")
    full = full.agg(F.array_sort(F.collect_list(F.struct("place", "turn_hash"))).alias("t")).where(F.size("t") == band_turns)
    turns = F.array_join(F.transform("t", lambda x: F.hex(x["turn_hash"])), "")
    digest = F.sha2(F.concat_ws(":", F.col("band").cast("string"), turns).cast("binary"), 256)
    lanes = {f"lane{i}": F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(LANES)}
    hashed = full.select("conv_id", "band", *[lane.alias(name) for name, lane in lanes.items()])
    summed = segmented(hashed, ["conv_id"], [F.asc("band")], None, {f"before_{name}": F.col(name) for name in lanes})
    sums = [((F.col(f"before_{name}") + F.col(name)) % (1 << 32)).cast("string") for name in lanes]
    text = F.concat_ws(",", F.lit("band"), (F.col("band") + 1).cast("string"), *sums)
    return summed.select("conv_id", "band", F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, KEY_BYTES).alias("next"))


class Shard:
    """Fragments of one band, in the order of their conversations, with their vertical index."""

    def __init__(self, band: int, band_turns: int):
        self.band, self.band_turns = band, band_turns
        self.convs: list[int] = []
        self.turns: list[list[tuple[bytes, int]]] = []
        self.starts: list[bytes] = []
        self.nexts: list[bytes | None] = []
        self.postings: dict[tuple[int, bytes], int] = defaultdict(int)
        self.ending: dict[int, int] = defaultdict(int)

    def add(self, conv: int, turns: list[tuple[bytes, int]], start: bytes, after: bytes | None, last: bool) -> None:
        bit = 1 << len(self.convs)
        self.convs.append(conv)
        self.turns.append(turns)
        self.starts.append(start)
        self.nexts.append(after)
        for place, (turn, _) in enumerate(turns):
            self.postings[place, turn] |= bit
        if last:
            self.ending[len(turns)] |= bit

    def members(self, bits: int) -> list[int]:
        found = []
        while bits:
            low = bits & -bits
            found.append(self.convs[low.bit_length() - 1])
            bits ^= low
        return found

    def nodes(self) -> Iterator[tuple]:
        """Rows of `PIECES`, by depth-first intersection."""
        first = self.band * self.band_turns
        groups: dict[bytes, int] = defaultdict(int)
        for n, start in enumerate(self.starts):
            groups[start] |= 1 << n
        stack = [(bits, 0, start, None, 0) for start, bits in groups.items()]
        while stack:
            bits, place, key, parent, words = stack.pop()
            ends = bits & self.ending.get(place, 0)
            if place or not first:
                ended = self.members(ends)
                yield key, parent, first + place, words, self.members(bits), ended[0] if ended else None, ",".join(map(str, ended)) if ended else None
            left = bits & ~ends if place < self.band_turns else 0
            while left:
                one = (left & -left).bit_length() - 1
                turn, words = self.turns[one][place]
                child = left & self.postings[place, turn]
                left &= ~child
                after = self.nexts[one] if place + 1 == self.band_turns else None
                stack.append((child, place + 1, after or blake2b(key + turn, digest_size=KEY_BYTES).digest(), key, words))


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(band, conversation, turns, start, next, last) from rows in the order of (band, conv_id, place); rows without place tell
    what is known of the fragment."""
    now, turns, known = None, [], {}
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("band", "conv_id", "place", "turn_hash", "words", "start", "next", "last")]
        for band, conv, place, turn, words, *facts in zip(*columns, strict=True):
            if now != (band, conv):
                if now:
                    yield *now, turns, known.get(0, b""), known.get(1), known.get(2, False)
                now, turns, known = (band, conv), [], {}
            if place is None:
                known |= {n: fact for n, fact in enumerate(facts) if fact is not None}
            else:
                turns.append((turn, words))
    if now:
        yield *now, turns, known.get(0, b""), known.get(1), known.get(2, False)


def _pieces(batches: Iterator[pa.RecordBatch], band_turns: int, fragments: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("words", pa.int64()), ("members", pa.list_(pa.int64())), ("first_end", pa.int64()), ("ends", pa.string())])

    def out(shard: Shard) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*shard.nodes(), strict=True)), strict=True)), schema=schema)

    shard = None
    for band, *fragment in _fragments(batches):
        if shard and (shard.band != band or len(shard.convs) >= fragments):
            yield out(shard)
            shard = None
        shard = shard or Shard(band, band_turns)
        shard.add(*fragment)
    if shard:
        yield out(shard)


def _list_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined end lists of each key, from rows in the order of (key, first_end)."""
    now, state = None, None
    for batch in batches:
        keys, values = [], []
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if key != now:
                if state:
                    keys.append(now)
                    values.append(state.hexdigest())
                now, state = key, sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "ends_sha256": pa.array(values, pa.string())})
    if state:
        yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def trie(rows: DataFrame, band_turns: int = BAND, shard_fragments: int = SHARD) -> DataFrame:
    """Nodes of the prefix trie of conversations given as rows (conv_id, place, turn_hash, words), places dense from 0.

    Rows without place only name their conversation. Per node: key, parent (its key), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    rows = stored(rows.withColumn("band", F.coalesce(F.expr(f"place div {band_turns}"), F.lit(0).cast("long"))), "trie-rows")
    final = rows.groupBy("conv_id").agg(F.max("place").alias("final"))
    turns = rows.where(F.col("place").isNotNull())
    keys = stored(_starts(turns, band_turns), "fragment-keys")
    last = final.select("conv_id", F.coalesce(F.expr(f"final div {band_turns}"), F.lit(0).cast("long")).alias("band"), F.lit(True).alias("last"))
    begins = keys.join(final, "conv_id").where(F.col("final") >= (F.col("band") + 1) * band_turns)
    begins = begins.select("conv_id", (F.col("band") + 1).alias("band"), F.col("next").alias("start"))
    fragments = begins.unionByName(keys, True).unionByName(last, True).unionByName(turns, True)
    dealt = fragments.repartitionByRange("band", "conv_id").sortWithinPartitions("band", "conv_id", "place")
    pieces = stored(dealt.mapInArrow(lambda found: _pieces(found, band_turns, shard_fragments), PIECES), "trie-pieces")

    merged = pieces.groupBy("key", "parent", "depth", "words").agg(F.min(F.element_at("members", 1)).alias("conv_id"), F.sum(F.size("members")).alias("n_convs"))
    merged = stored(merged, "trie-nodes")
    children = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = stored(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-counts")

    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("all_saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("all_leaves"))
    pairs = pieces.select("key", F.explode("members").alias("conv_id"))
    below = keyed_join(pairs, owned, ["conv_id"], "inner").groupBy("key").agg(F.sum("all_saved").alias("all_saved"), F.sum("all_leaves").alias("n_leaves"))
    shared = nodes.where(F.col("n_convs") > 1).select("key", "conv_id", "depth", "saved")
    above = segmented(shared, ["conv_id"], [F.asc("depth")], None, {"above": F.col("saved")}).select("key", "above")

    listed = pieces.where(F.col("ends").isNotNull()).select("key", "first_end", "ends")
    listed = listed.repartition("key").sortWithinPartitions("key", "first_end").mapInArrow(_list_hashes, "key binary, ends_sha256 string")

    owners = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = keyed_join(nodes, owners, ["parent"]).join(below, "key").join(above, "key", "left").join(listed, "key", "left")
    saved = F.when(F.col("n_convs") > 1, F.col("all_saved") - F.col("above")).otherwise(F.lit(0).cast("long"))
    return found.select(
        "key", "parent", "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_LIST)).alias("ends_sha256"),
    )
