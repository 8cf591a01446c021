"""BPE encoding and decoding by a queue of merge ranks over a linked list of symbols.

A pre-token starts as one symbol per byte. Symbols stand in a doubly linked list, and
every neighbouring pair with a merge goes into a priority queue by (rank, place). The
least entry is merged: its left symbol takes the pair's symbol, the right one leaves
the list, and the two new neighbours enter the queue. An entry whose symbols have
changed since is stale and is skipped. Decoding joins the vocabulary strings of the
ids the way the library does for a file without a decoder: with a space between them.

Tokenizers of one build are taken, others are refused: added tokens matched in the raw
text, NFC, white space, lower case; one splitting pattern that drops white space; the
byte alphabet; merges with or without an end-of-word suffix. Since no pre-token holds
white space, normalised text is cut at white space first, and what lies between is
worked out once for as long as a worker remembers it, and so is every pre-token: two
generations of ``HELD`` and twice ``HELD`` entries, of which the older goes when the younger is full, so that what keeps coming
stays and memory is bounded (about 250 MB a worker). Characters outside ``_PLAIN`` go through the library's own
normaliser and splitter, whose Unicode tables they depend on.

Defined cases: a null text is an empty one and has no tokens; an empty list of ids
decodes to an empty text; texts are cut and encoded whole, whatever their length; rows
are encoded one by one, so repeated rows and null ids give a row each; an empty table
gives an empty result; other columns are not looked at and not returned.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memory

HELD = 150_000
#: characters that Python and the library lower, split and leave composed alike: ASCII without the separators
#: U+001C to U+001F, Latin letters up to U+017F without the dotted capital I, and common punctuation
_PLAIN = "\x00-\x1b\x20-\x7f\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-įı-ſ‐-‧‰-⁞€"
_ODD = re.compile(f"[^{_PLAIN}]")
#: the pattern that ``_SPLIT`` stands for, which must be the file's own (a fixed value of the format)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class Merges:
    """A vocabulary and its merges, by ids."""

    def __init__(self, model: dict) -> None:
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.wide = 1 + max(self.ids.values(), default=0)
        #: (left id * wide + right id) -> rank, and the id of the pair by rank
        self.rank = {self.ids[a] * self.wide + self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.pair = [self.ids[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.first = [self.ids.get(s) for s in symbols]
        self.last = [self.ids.get(s + self.suffix) for s in symbols]

    def start(self, data: bytes) -> list[int]:
        """The ids that a pre-token's bytes start as; the last one carries the end of the word."""
        found = [self.first[b] for b in data[:-1]] + [self.last[b] for b in data[-1:]]
        if None in found:
            raise ValueError("the vocabulary lacks a byte")
        return found

    def encode(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbol = self.start(data)
        n = len(symbol)
        if n < 2:
            return symbol
        rank, pair, wide = self.rank.get, self.pair, self.wide
        #: the rank of the pair that starts at a place, while it can merge
        live = [rank(a * wide + b, -1) for a, b in zip(symbol, symbol[1:], strict=False)]
        live.append(-1)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r << 32 | at for at, r in enumerate(live) if r >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            at = entry & 0xFFFFFFFF
            if live[at] != entry >> 32:
                continue  # stale: a symbol of the pair has grown or left the list since
            new, to = pair[live[at]], after[at]
            symbol[at], symbol[to], live[to] = new, -1, -1
            end = after[at] = after[to]
            got = -1
            if end >= 0:
                before[end] = at
                got = rank(new * wide + symbol[end], -1)
                if got >= 0:
                    heappush(queue, got << 32 | at)
            live[at] = got
            start = before[at]
            if start >= 0:
                live[start] = got = rank(symbol[start] * wide + new, -1)
                if got >= 0:
                    heappush(queue, got << 32 | start)
        return [s for s in symbol if s >= 0]


class Codec:
    """A tokenizer file in a worker."""

    def __init__(self, file_text: str, held: int = HELD) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(file_text)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        build = (
            steps == [{"type": "NFC"}, space, {"type": "Lowercase"}]
            and len(parts) == 2
            and parts[0] == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}
            and (parts[1]["type"], parts[1]["use_regex"], parts[1]["add_prefix_space"]) == ("ByteLevel", False, False)
            and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"])
            and spec["post_processor"] is None
            and spec["decoder"] is None
            and not (spec["model"].get("dropout") or spec["model"].get("continuing_subword_prefix") or spec["model"].get("ignore_merges"))
        )
        if not build:
            raise ValueError("a tokenizer of another build")
        self.merges = Merges(spec["model"])
        self.tool = Tokenizer.from_str(file_text)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.strings = {i: s for s, i in self.merges.ids.items()} | {i: s for s, i in self.added.items()}
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.chunks, self.words = Memory(held), Memory(2 * held)

    def pretokens(self, chunk: str) -> list[str]:
        """The pre-tokens of normalised text without white space; odd ones behind a space and in the characters of their bytes."""
        if _ODD.search(chunk) is None:
            return _SPLIT.findall(chunk)
        return [" " + p for p, _ in self.tool.pre_tokenizer.pre_tokenize_str(chunk)]

    def word(self, pretoken: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and their strings with a space between them."""
        got = self.words.get(pretoken)
        if got is None:
            data = bytes(map(self.byte_of.__getitem__, pretoken[1:])) if pretoken[0] == " " else pretoken.encode()
            ids = self.merges.encode(data)
            got = packed(ids), self.decode(ids)
            self.words.keep(pretoken, got)
        return got

    def known(self, chunk: str) -> tuple[bytes, str]:
        """``word`` of all pre-tokens of a chunk, remembered."""
        got = self.chunks.get(chunk)
        if got is None:
            parts = [self.word(p) for p in self.pretokens(chunk)]
            got = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
            self.chunks.keep(chunk, got)
        return got

    def normal(self, text: str) -> str:
        """The normalised text; white space may be longer than the file has it, which no pre-token shows."""
        return text.lower() if _ODD.search(text) is None else self.tool.normalizer.normalize_str(text)

    def encode(self, text: str) -> tuple[bytes, str]:
        """As ``work_out``, of a whole text with the strings of added tokens in it."""
        if self.cut and "<" in text and (bits := self.cut.split(text))[1:]:
            out = [self._plain(b) if i % 2 == 0 else (packed([self.added[b]]), b) for i, b in enumerate(bits)]
            out = [x for x in out if x[0]]
            return b"".join(x[0] for x in out), " ".join(x[1] for x in out)
        return self._plain(text)

    def _plain(self, text: str) -> tuple[bytes, str]:
        # U+001C to U+001F are odd, so what is lowered here is parted at the same characters by both
        chunks = self.normal(text).split() if _ODD.search(text) is None else _SPACE.split(self.normal(text))
        got = list(map(self.chunks.young.get, chunks))
        if None in got:
            got = [self.known(c) if g is None else g for c, g in zip(chunks, got, strict=True)]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


#: white space as the file's pattern has it: without U+001C to U+001F
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_codecs: dict[tuple[str, int], Codec] = {}


def packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def unpacked(data: bytes) -> list[int]:
    out = array("I", data)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tolist()


def codec_of(file_text: str, held: int = HELD) -> Codec:
    """The worker's codec; the next task of the worker finds it, and what it remembers."""
    key = hashlib.sha256(file_text.encode()).hexdigest(), held
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(file_text, held)
    return _codecs[key]


def _read(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``ids``; ``tokenizer`` is the path of a tokenizer file, read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            ids = [unpacked(codec.encode(t.as_py() or "")[0]) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return narrow.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and the ``text`` of the ids; null ids are none."""
    shared = encoded.sparkSession.sparkContext.broadcast(_read(tokenizer))
    narrow = encoded.select(F.col(key).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    schema = T.StructType([T.StructField("doc_id", encoded.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            texts = [codec.decode(x.as_py() or []) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    return narrow.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: both directions in one reading, without handing the ids on."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in batches:
            rows = []
            for t in b.column(1):
                ids, back = codec.encode(t.as_py() or "")
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            columns = zip(*rows, strict=True) if rows else ([], [], [])
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, types, strict=True))], names=schema.names)

    return narrow.mapInArrow(run, schema)
