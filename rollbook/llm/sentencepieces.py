"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; normaliser (character map, blanks, dummy prefix), metaspace marker, unigram scores or
pair merges, byte fallback, user-defined pieces and the decoder are rebuilt for the tokenizers library. Texts are cut at
blanks, and words further wherever no piece of the model holds the two neighbouring characters, so no piece is lost; every
distinct part is encoded once per worker, in multithreaded batches, and each word's ids are held against the SentencePiece
library. Texts that cannot be cut so are encoded whole.

Null text is empty and has no ids. Repeated rows come back repeated, empty tables give no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.llm.shared import kept, slices, text_or_empty

MARK = "▁"
#: Fixed values of the model format: piece kinds and model kinds.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, PAIRS = 1, 2
THREADS = 2
CACHE_WORDS = 400_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, kind
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    character_map: bytes = b""
    dummy_prefix: bool = True
    strip_blanks: bool = True
    escape_blanks: bool = True


def parse(data: bytes) -> Spec:
    """Read a serialized model."""
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            spec.pieces.append((own[1].decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
            spec.kind, spec.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            spec.unknown = trainer.get(40, 0)
        elif number == 3:
            rules = dict(_fields(value))
            spec.character_map = rules.get(2, b"")
            spec.dummy_prefix, spec.strip_blanks = bool(rules.get(3, 1)), bool(rules.get(4, 1))
            spec.escape_blanks = bool(rules.get(5, 1))
    if spec.kind not in (UNIGRAM, PAIRS):
        raise ValueError("only unigram and pair-merge models are supported")
    return spec


def _model(spec: Spec):  # noqa: ANN202
    from tokenizers import models

    vocabulary = {text: n for n, (text, _, _) in enumerate(spec.pieces)}
    if spec.kind == UNIGRAM:
        return models.Unigram([(text, score) for text, score, _ in spec.pieces], unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    merges = []
    usable = {text for text, _, kind in spec.pieces if kind == NORMAL}
    for text, score, kind in spec.pieces:
        if kind != NORMAL:
            continue
        halves = [(text[:i], text[i:]) for i in range(1, len(text)) if text[:i] in usable and text[i:] in usable]
        merges += [(-score, vocabulary[text], vocabulary[a], vocabulary[b], (a, b)) for a, b in halves]
    ordered = [m[-1] for m in sorted(merges)]
    return models.BPE(vocabulary, ordered, unk_token=spec.pieces[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)


def build(spec: Spec):  # noqa: ANN201
    """A whole-text tokenizer: normaliser, model, user pieces and decoder."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, normalizers

    tokenizer = Tokenizer(_model(spec))
    steps = [normalizers.Precompiled(spec.character_map)] if spec.character_map else []
    if spec.strip_blanks:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_blanks else " "))
    if spec.escape_blanks:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    users = [AddedToken(text, normalized=True, special=False) for text, _, kind in spec.pieces if kind == USER]
    if users:
        tokenizer.add_tokens(users)
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence([*parts, *([decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else [])])
    return tokenizer


class Pieces:
    """Encodes and decodes with one model file; keep one per worker (`pieces`)."""

    def __init__(self, data: bytes, threads: int = THREADS):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.spec = spec = parse(data)
        self.tokenizer, self.bare = build(spec), build(spec)
        self.bare.normalizer = None
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.words: dict[str, tuple[bytes, bool]] = {}
        self.parts: dict[str, bytes] = {}
        texts = [text for text, _, kind in spec.pieces if kind in (NORMAL, USER)]
        self.beside = {text[i : i + 2] for text in texts for i in range(len(text) - 1)}
        users = any(kind == USER for _, _, kind in spec.pieces)
        plain = spec.dummy_prefix and spec.escape_blanks and not spec.strip_blanks and not spec.character_map and not users
        # a run of unknown characters is one id, so cutting it changes ids unless bytes stand in
        self.cuts = plain and spec.byte_fallback and not any(MARK in text.lstrip(MARK) for text in texts)
        coded = [bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() for t, _, k in spec.pieces]
        coded = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else c for c, (_, _, k) in zip(coded, spec.pieces, strict=True)]
        self.bytes = np.frombuffer(b"".join(coded), np.uint8)
        self.sizes = np.array([len(c) for c in coded], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _cut(self, word: str) -> list[str]:
        out, begin, beside = [], 0, self.beside
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in beside:
                out.append(word[begin:i])
                begin = i
        return [*out, word[begin:]]

    def _learn(self, words: list[str]) -> None:
        cut = [self._cut(MARK + w) for w in words]
        fresh = list({p: None for parts in cut for p in parts if p not in self.parts})
        for at in range(0, len(fresh), 50_000):
            some = fresh[at : at + 50_000]
            for part, coded in zip(some, self.bare.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[part] = np.array(coded.ids, "<u4").tobytes()
        # alone, the empty word between blanks would be no text at all
        alone = self.other.encode("a ")[len(self.other.encode("a")) :]
        for word, parts, found in zip(words, cut, self.other.encode(words, num_threads=1), strict=True):
            wanted = found if word else alone
            ids = b"".join([self.parts[p] for p in parts])
            self.words[word] = (ids, ids == struct.pack(f"<{len(wanted)}I", *wanted))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (uint32), offsets of the texts in them, and whether each text agrees with the SentencePiece library."""
        if len(self.words) > CACHE_WORDS or len(self.parts) > CACHE_WORDS:
            self.words, self.parts = {}, {}
        apart = pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))
        # marks in the text itself join the blanks around them
        apart = pc.or_(apart, pc.match_substring(texts, MARK)).to_numpy(zero_copy_only=False) | (not self.cuts)
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts.filter(pa.array(~apart & ~empty)), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self._learn([w for w in words if w not in self.words])
        found = [self.words[w] for w in words]
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        pool = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
        lengths = np.fromiter((len(f[0]) // 4 for f in found), np.int64, len(found))
        agree = np.fromiter((f[1] for f in found), bool, len(found))
        starts = np.cumsum(lengths) - lengths
        own = lengths[numbers]
        before = np.concatenate([[0], np.cumsum(own)])
        ids = pool[np.repeat(starts[numbers] - before[:-1], own) + np.arange(before[-1])]
        bounds = cut.offsets.to_numpy() - (cut.offsets[0].as_py() if len(cut) else 0)
        wrong = np.concatenate([[0], np.cumsum(~agree[numbers])])[bounds]
        at = before[bounds]
        rows = np.flatnonzero(~apart & ~empty)
        result: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        parity = np.ones(len(texts), bool)
        for n, row in enumerate(rows.tolist()):
            result[row], parity[row] = ids[at[n] : at[n + 1]], wrong[n + 1] == wrong[n]
        rest = np.flatnonzero(apart & ~empty).tolist()
        whole = [texts[row].as_py() for row in rest]
        for row, text, coded_text in zip(rest, whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False) if whole else (), strict=True):
            result[row] = np.array(coded_text.ids, "<u4")
            parity[row] = result[row].tolist() == self.other.encode(text, num_threads=1)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in result], dtype=np.int64)])
        return np.concatenate([np.zeros(0, "<u4"), *result]).astype("<u4", copy=False), offsets, parity

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of each run of ids; the dummy prefix is dropped. Bytes that are no UTF-8 are left as they are."""
        own = self.sizes[ids]
        before = np.concatenate([[0], np.cumsum(own)])
        data = self.bytes[np.repeat(self.starts[ids] - before[:-1], own) + np.arange(before[-1])].tobytes()
        at = before[offsets].tolist()
        out = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return [o[1:] if self.spec.dummy_prefix and o[:1] == b" " else o for o in out]


def pieces(path: str, threads: int = THREADS) -> Pieces:
    """The worker's coder of a model file."""

    def load() -> Pieces:
        with open(path, "rb") as file:
            return Pieces(file.read(), threads)

    return kept("pieces", path, load)


def encode(path: str, column: str | Column, threads: int = THREADS) -> Column:
    """Array of ids of a text column."""

    def of(texts: pa.Array) -> pa.Array:
        coder, plain = pieces(path, threads), text_or_empty(texts)
        parts = [coder.encode(plain[a:b]) for a, b in slices(plain)]
        lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(i.astype(np.int32))) for i, o, _ in parts]
        return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))

    return F.arrow_udf(of, "array<int>")((F.col(column) if isinstance(column, str) else column).cast("string"))


def decode(path: str, column: str | Column) -> Column:
    """Text of a column of ids; null ids give null, damaged UTF-8 the replacement character."""

    def of(ids: pa.Array) -> pa.Array:
        coder = pieces(path)
        lists = [np.array(row.as_py() or [], np.int64) for row in ids]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        texts = coder.decode(np.concatenate([np.zeros(0, np.int64), *lists]), offsets)
        return pa.array([t.decode("utf-8", "replace") if row.is_valid else None for t, row in zip(texts, ids, strict=True)], pa.string())

    return F.arrow_udf(of, "string")(F.col(column) if isinstance(column, str) else column)


DIGEST = "n_ids long, ids_crc32 long, parity boolean, round_trip boolean, decoded_sha256 string"


def round_trip(path: str, column: str | Column, threads: int = THREADS) -> Column:
    """Struct column `DIGEST`: the ids' number and crc32, agreement with the SentencePiece library, and the decoded text's."""

    def of(texts: pa.Array) -> pa.Array:
        coder, plain = pieces(path, threads), text_or_empty(texts)
        rows = []
        for a, b in slices(plain):
            ids, offsets, parity = coder.encode(plain[a:b])
            data = memoryview(ids.tobytes())
            wanted = plain[a:b].cast(pa.binary()).to_pylist()
            for n, text in enumerate(coder.decode(ids, offsets)):
                begin, until = int(offsets[n]), int(offsets[n + 1])
                check = zlib.crc32(data[4 * begin : 4 * until])
                rows.append((until - begin, check, bool(parity[n]), text == wanted[n], hashlib.sha256(text).hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, [f.split()[0] for f in DIGEST.split(", ")])

    return F.arrow_udf(of, DIGEST)((F.col(column) if isinstance(column, str) else column).cast("string"))
