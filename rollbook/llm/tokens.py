"""Ids of whole texts by a tokenizer file whose pieces never reach over white space.

A text is split at ASCII white space; its distinct words of plain Latin characters are split into pieces by the file's own
pattern, all at once, and every distinct piece is encoded by the library once per worker, so long corpora cost a look-up per
piece. All other words go to the library as they are. `test_tokens` holds the ids against whole-text encoding.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rollbook.llm.shared import kept, words_of

#: Pieces and words kept per worker; the half that was not met again goes when they are so many; about 200 bytes each.
CACHE_WORDS = 400_000
#: Pieces that are encoded in one call.
JOINED = 64

#: Words whose pieces the file's pattern tells apart as it does in a whole text; the dotted capital I becomes two characters.
PLAIN = "^[\x21-\x7e\u00a1-\u012f\u0131-\u024f]+$"


def _expand(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, first + 1, ... `counts` times each, and where each run begins in that."""
    before = np.concatenate([[0], np.cumsum(counts)])
    largest = max(int(before[-1]), int(first.max(initial=0)) + int(counts.max(initial=0)))
    kind = np.int32 if largest < 1 << 31 else np.int64  # these arrays are the largest of an encoder
    out = np.repeat((first - before[:-1]).astype(kind), counts)
    out += np.arange(len(out), dtype=kind)
    return out, before


class WordEncoder:
    """Encodes texts with one tokenizer file; keep one per worker (`encoder`)."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        # ids of pieces and whole words met since the last eviction, and those of the time before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.specials = [t["content"] for t in spec.get("added_tokens", ())]
        self.pattern, self.ends = self._split(spec)

    def _split(self, spec: dict) -> tuple[str | None, np.ndarray]:
        """The file's own splitting pattern, and which ids end a piece; None where a file has no such marks."""
        suffix = spec["model"].get("end_of_word_suffix")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split" and "Regex" in s["pattern"]]
        lower = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", ()))
        ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if not suffix or len(patterns) != 1 or not lower:
            return None, ends
        for token, number in spec["model"]["vocab"].items():
            ends[number] = token.endswith(suffix)
        return patterns[0], ends

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Which words may be encoded side by side."""
        plain = pc.match_substring_regex(words, PLAIN)
        for special in self.specials:
            plain = pc.and_(plain, pc.invert(pc.match_substring(words, special)))
        return plain.to_numpy(zero_copy_only=False)

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Piece numbers of plain words, where each word's begin, and the pieces."""
        return words_of(pc.replace_substring_regex(pc.utf8_lower(words), f"(?:{self.pattern})", r"\0 "))

    def _learn(self, units: list[str], pieces: bool) -> list[bytes]:
        """Ids of units that are not kept; pieces are encoded side by side, as the vocabulary marks the last id of each."""
        if not pieces:
            return [self._one(u) for u in units]
        out: list[bytes] = []
        parts = [units[at : at + JOINED] for at in range(0, len(units), JOINED)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                data, until = ids.tobytes(), (stops * 4).tolist()
                out += [data[a:b] for a, b in zip([0, *until], until, strict=False)]
            else:
                out += [self._one(u) for u in part]
        return out

    def _coded(self, units: list[str], pieces: bool) -> list[bytes]:
        coded = list(map(self.known.get, units))
        fresh = []
        for i in [i for i, c in enumerate(coded) if c is None]:
            found = coded[i] = self.older.get(units[i])
            if found is None:
                fresh.append(i)
            else:
                self.known[units[i]] = found
        for i, c in zip(fresh, self._learn([units[i] for i in fresh], pieces), strict=True):
            coded[i] = self.known[units[i]] = c
        if len(self.known) > self.cache_words // 2:
            self.older, self.known = self.known, {}
        return coded

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and the offsets of the texts in it."""
        numbers, offsets, words = words_of(texts)
        plain = self._plain(words) if self.pattern is not None else np.zeros(len(words), bool)
        side, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        piece, begins, pieces = self._pieces(words.take(pa.array(side)))
        coded = self._coded(pieces.to_pylist(), True) + self._coded(words.take(pa.array(other)).to_pylist(), False)
        # every word is a run of units: its pieces, or itself
        runs = np.ones(len(words), np.int64)
        runs[side] = np.diff(begins)
        order = np.empty(len(words), np.int64)
        order[side], order[other] = begins[:-1], len(piece) + np.arange(len(other))
        units = np.concatenate([piece, len(pieces) + np.arange(len(other))])
        spread, starts = _expand(order[numbers], runs[numbers])
        unit, begin = units[spread], starts[offsets]
        del spread, starts, numbers, piece, units
        pool = np.frombuffer(b"".join(coded), "<u4")
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        at, ends = _expand((np.cumsum(lengths) - lengths)[unit], lengths[unit])
        return pool[at], ends[begin]

    def encode_with_end(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, with `end_id` behind the ids of each text."""
        ids, offsets = self.encode(texts)
        return np.insert(ids, offsets[1:], end_id).astype("<u4", copy=False), offsets + np.arange(len(offsets))


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The worker's encoder of a file."""
    return kept("tokens", path, lambda: WordEncoder(path, cache_words))
