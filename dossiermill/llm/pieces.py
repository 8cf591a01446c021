"""SentencePiece models on the tokenizers library: encoding, decoding, and proof of parity.

The model file is one protobuf message; its pieces, trainer and normaliser fields
are read here without generated classes. From them the backend is rebuilt: the
dummy prefix and the metaspace marker as a normaliser, unigram scores or, for
merge models, the merges that the scores imply, and byte fallback for characters
outside the vocabulary. Batches are encoded by the library's threads.

Texts are cut before every run of markers that follows another character, and around
characters that no longer piece contains. That changes nothing as long as no piece
has a marker behind another character; the model is refused otherwise. The ids are the
backend's. ``encode`` compares them with the sentencepiece library's, part by part and
each part when a worker meets it first, or text by text where the normaliser does more
than place markers; ``parity`` is false where they differ, as merges of equal rank might.

A worker remembers parts, and what stands between two spaces, in two generations of
``HELD`` entries, so its memory is bounded and it does not matter what came first.

Defined cases: a null text is an empty one and has no ids; an empty list of ids
decodes to an empty text; rows are encoded one by one, so repeated rows and null ids
give a row each; an empty table gives an empty result; other columns are not looked
at and, except where documents are handed on, not returned.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memory

MARK = "▁"
BREAK = "\n"
THREADS = 2
#: parts whose ids a worker remembers, a generation
HELD = 250_000
#: parts to the libraries in one text
JOINED = 64
#: texts to the library at once: this many characters, or one text
CHUNK = 1 << 20
# fixed values of the format: kinds of pieces and of models
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; fixed 32 and 64 bits stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = varint()
        yield tag >> 3, message[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    whitespace_as_suffix: bool = False


def parse(message: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(message):
        if number == 1:
            got = dict(fields(value))
            spec.pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0], got.get(3, NORMAL)))
        elif number == 2:
            got = dict(fields(value))
            spec.model_type = got.get(3, UNIGRAM)
            spec.byte_fallback = bool(got.get(35, 0))
            spec.whitespace_as_suffix = bool(got.get(24, 0))
            spec.unk_surface = got.get(44, spec.unk_surface.encode()).decode()
        elif number == 3:
            got = dict(fields(value))
            spec.charsmap = got.get(2, b"")
            spec.add_dummy_prefix, spec.remove_extra_whitespaces = bool(got.get(3, 1)), bool(got.get(4, 1))
            spec.escape_whitespaces = bool(got.get(5, 1))
    return spec


def lone_characters(spec: Spec) -> list[str]:
    """Characters of ASCII that no longer piece contains: they are tokens of their own wherever they stand."""
    joined = set("".join(p for p, _, kind in spec.pieces if kind in (NORMAL, USER) and len(p) > 1))
    return [c for c in map(chr, range(128)) if c not in joined]


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges that a piece list implies: every split of a piece into two pieces, best score first."""
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    found = []
    for piece in score:
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                found.append((-score[piece], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def backend(spec: Spec):
    """A ``tokenizers.Tokenizer`` of the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if spec.whitespace_as_suffix or not spec.escape_whitespaces:
        raise ValueError("models with suffix markers or without markers are not supported")
    if any(MARK in p.lstrip(MARK) for p, _, _ in spec.pieces):
        raise ValueError("a piece has a marker behind another character")
    ids = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    unknown = next((i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), None)
    if spec.model_type == BPE:
        unk = spec.pieces[unknown][0] if unknown is not None else None
        model = models.BPE(ids, merges(spec.pieces), unk_token=unk, fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type} is not supported")
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] if spec.add_dummy_prefix else []
    steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(model)
    out.normalizer = normalizers.Sequence(steps)
    if spec.model_type == BPE:
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), behavior="isolated")
    strip = [decoders.Strip(" ", left=1, right=0)] if spec.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


_codecs: dict = {}


class Codec:
    """A model in a worker: the rebuilt backend, and the sentencepiece library for parity."""

    def __init__(self, message: bytes, threads: int = THREADS, held: int = HELD) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.spec = spec = parse(message)
        self.fast = backend(spec)
        # parts stand for themselves in both libraries where normalising only places markers
        simple = spec.add_dummy_prefix and not spec.charsmap and not spec.remove_extra_whitespaces and spec.byte_fallback
        self.alone = lone_characters(spec)
        whole = spec.model_type == BPE and any(p == MARK for p, _, _ in spec.pieces) and BREAK in self.alone
        self.parts = Tokenizer(self.fast.model) if simple and whole else None
        stop = re.escape("".join(self.alone)) + MARK
        self.cut = re.compile(f"[{re.escape(''.join(self.alone))}]|{MARK}+[^{stop}]*|[^{stop}]+")
        self.plain = SentencePieceProcessor(model_proto=message)
        self.lead = len(alone := self.plain.encode(BREAK))
        self.line = alone[-1]
        if self.parts and self.parts.encode(BREAK, add_special_tokens=False).ids != [self.line]:
            self.parts = None
        #: of parts, and of what stands between spaces: ids as 32-bit integers, whether they are the library's, and whether they decode
        self.known, self.chunks = Memory(held), Memory(held)
        self.strings = [p.replace(MARK, " ") if kind in (NORMAL, USER) else None for p, _, kind in spec.pieces]

    def encode(self, texts: list[str]) -> list[tuple[list[int], bool, bool]]:
        """Ids of each text, whether they are the library's, and whether they decode to the text."""
        return [(np.frombuffer(ids, dtype=np.int32).tolist(), same, back) for ids, same, back in self.packed(texts)]

    def packed(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """As ``encode``, the ids as 32-bit integers."""
        if self.parts:
            return self._by_parts(texts)
        mine = [e.ids for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.plain.encode(texts, num_threads=1)
        rows = zip(mine, theirs, texts, self.decode(mine), strict=True)
        return [(np.array(a, dtype=np.int32).tobytes(), a == b, t == u) for a, b, t, u in rows]

    def _by_parts(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """As ``packed``: between single spaces the parts are the same wherever they stand, so these chunks are looked up first."""
        even = ["  " not in t and MARK not in t and not t.startswith(" ") for t in texts]
        cut = [(t.split(" ") if e else self._cut(t)) if t else [] for t, e in zip(texts, even, strict=True)]
        got = [list(map((self.chunks if e else self.known).young.get, names)) for names, e in zip(cut, even, strict=True)]
        missing: tuple[dict, dict] = ({}, {})
        for names, found, e in zip(cut, got, even, strict=True):
            if None in found:
                missing[e].update((x, None) for x, g in zip(names, found, strict=True) if g is None)
        chunks = {c: self.chunks.get(c) or self._cut(c) for c in missing[True]}
        fresh = {c: g for c, g in chunks.items() if isinstance(g, list)}
        # a chunk of one part is remembered as a chunk only
        alone = {g[0]: None for g in fresh.values() if len(g) == 1}
        want = dict.fromkeys([*missing[False], *(p for g in fresh.values() if len(g) > 1 for p in g)])
        parts = {p: self.known.get(p) for p in want}
        learned = self._learned([*(p for p, g in parts.items() if g is None), *(p for p in alone if parts.get(p) is None and p not in parts)])
        for p, g in parts.items():
            if g is None:
                self.known.keep(p, learned[p])
        parts = learned | {p: g for p, g in parts.items() if g is not None}
        for c, g in fresh.items():
            x = [parts[p] for p in g]
            chunks[c] = x[0] if len(x) == 1 else (b"".join([y[0] for y in x]), all([y[1] for y in x]), all([y[2] for y in x]))
            self.chunks.keep(c, chunks[c])
        out = []
        for names, found, e in zip(cut, got, even, strict=True):
            if None in found:
                more = chunks if e else parts
                found = [more[x] if g is None else g for x, g in zip(names, found, strict=True)]
            out.append((b"".join([g[0] for g in found]), all([g[1] for g in found]), all([g[2] for g in found])))
        # a marker in a text decodes to a space
        return [(ids, same, back and MARK not in t) for (ids, same, back), t in zip(out, texts, strict=True)]

    def _cut(self, text: str) -> list[str]:
        """The parts of a text, or of a chunk, which starts with a marker like one."""
        return self.cut.findall((MARK + text).replace(" ", MARK))

    def _learned(self, parts: list[str]) -> dict[str, tuple[bytes, bool, bool]]:
        """Ids by the backend, whether the sentencepiece library gives the same, and whether they decode to the part.

        Parts go to the libraries ``JOINED`` at a time with line breaks between them,
        which join with nothing, so that none is given a dummy prefix.
        """
        out = {BREAK: (np.array([self.line], dtype=np.int32).tobytes(), True, True)}
        parts = [p for p in parts if p != BREAK]
        mark = self.fast.token_to_id(MARK)
        for at in range(0, len(parts), JOINED * JOINED):
            groups = [parts[i : i + JOINED] for i in range(at, min(at + JOINED * JOINED, len(parts)), JOINED)]
            lines = [BREAK.join(g) for g in groups]
            mine = self.parts.encode_batch_fast(lines, add_special_tokens=False)
            theirs = self.plain.encode([BREAK + x.replace(MARK, " ") for x in lines], num_threads=1)
            for group, fast, ids in zip(groups, mine, theirs, strict=True):
                ids = ids[self.lead :]
                found = self._split(fast.ids)
                other = found if fast.ids == ids else self._split(ids)
                for part, a, b in zip(group, found, other, strict=True):
                    back = list(map(self.strings.__getitem__, a))
                    # bytes are joined by the decoder, which drops one leading space, so it is given one more
                    shown = "".join(back) if None not in back else self.decode([[mark, *a]])[0]
                    out[part] = array("i", a).tobytes(), a == b, shown == part.replace(MARK, " ")
        return out

    def _split(self, ids: list[int]) -> list[list[int]]:
        """Ids between the line breaks."""
        out, start = [], 0
        for at, i in enumerate(ids):
            if i == self.line:
                out.append(ids[start:at])
                start = at + 1
        return [*out, ids[start:]]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.fast.decode_batch(ids, skip_special_tokens=False)


def codec_of(message: bytes, threads: int) -> Codec:
    """The worker's codec of a model; the next task of the worker finds it, and the parts it knows."""
    if (message, threads) not in _codecs:
        _codecs.clear()
        _codecs[message, threads] = Codec(message, threads)
    return _codecs[message, threads]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """A column of texts in turns of about ``CHUNK`` characters, each with the place of its first one."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def encode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threads: int = THREADS) -> DataFrame:
    """``keep`` columns with ``piece_ids``, ``parity`` and ``round_trip``.

    ``parity``: the backend's ids are the sentencepiece library's. ``round_trip``:
    the ids decode to the text. ``model`` is a path that executors can read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(open(model, "rb").read())
    narrow = docs.select(*[F.col(k) for k in keep], F.col(text).alias("_text"))
    schema = T.StructType(
        [
            *narrow.schema.fields[:-1],
            T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
            T.StructField("parity", T.BooleanType()),
            T.StructField("round_trip", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, threads)
        for b in batches:
            for at, part in _chunks(b.columns[-1]):
                got = codec.packed(part)
                ids = np.frombuffer(b"".join([g[0] for g in got]), dtype=np.int32)
                ends = np.cumsum([0, *(len(g[0]) // 4 for g in got)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(at, len(part)) for c in b.columns[:-1]],
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                        pa.array([g[1] for g in got], pa.bool_()),
                        pa.array([g[2] for g in got], pa.bool_()),
                    ],
                    names=schema.names,
                )

    return narrow.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "piece_ids", keep: tuple[str, ...] = ("doc_id",), threads: int = THREADS) -> DataFrame:
    """``keep`` columns with the ``text`` of the ids; null ids are none."""
    shared = encoded.sparkSession.sparkContext.broadcast(open(model, "rb").read())
    narrow = encoded.select(*[F.col(k) for k in keep], F.col(ids).cast("array<int>").alias("_ids"))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value, threads)
        for b in batches:
            back = codec.decode([x or [] for x in b.columns[-1].to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(back, pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)
