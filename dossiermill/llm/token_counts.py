"""Token counts of texts without token ids.

A tokenizer cuts a text into pre-tokens and then each pre-token into pieces, so a
text has as many tokens as its pre-tokens have pieces together. All texts are read
once for the distinct pre-tokens and their frequency, each distinct pre-token is
given to the model once, and a second reading joins every document's pre-token
frequencies to those counts. The ``HEAD`` most frequent pre-tokens, a bounded table,
are joined inside the tasks that read the texts; the others leave as rows, are joined
by pre-token and added up.

Pre-tokens are found as the tokenizer file says: strings of added tokens first, one
token each, as the library's default has it; then the file's own normaliser; then its
pattern. Only tokenizers of this build (added tokens matched in raw text, NFC, white
space, lower case; one splitting pattern that drops what it does not match; byte
alphabet; merges) are taken, others are refused.

Defined cases: a null text is an empty one with 0 bytes and 0 tokens; rows are
counted one by one, so repeated rows and null ids give a row each; an empty table
gives an empty result; other columns are not looked at and not returned.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage
from .common import most_frequent

HEAD = 200_000
_HELD = 300_000


class Splitter:
    """Pre-tokens of a text, for one tokenizer file; the text of the file is all it needs."""

    def __init__(self, file_text: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(file_text)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        lower = steps[-1:] == ["Lowercase"] and all(
            n == {"type": "NFC"} or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ")
            for n in spec["normalizer"]["normalizers"][:-1]
        )
        drops = len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["invert"] and parts[0]["behavior"] == "Removed"
        whole = drops and parts[1]["type"] == "ByteLevel" and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"]
        raw = all(not (a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"]) for a in spec["added_tokens"])
        if not (lower and whole and raw and spec["post_processor"] is None):
            raise ValueError("a tokenizer of another build")
        self.tool = Tokenizer.from_str(file_text)
        added = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.strings = added

        import regex

        # the file's pattern; in texts whose word characters are all letters or digits both engines agree on the second one
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"], regex.V1)

    def normal(self, text: str) -> str:
        """The normalised text. Python's lower() differs from the file's only at a capital sigma, NFC only beyond Latin-1."""
        if text.isascii() or ("Σ" not in text and max(text) < "̀"):
            return text.lower()
        return self.tool.normalizer.normalize_str(text)

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many added tokens stand between them."""
        if self.added and any(s in text for s in self.strings):
            bits = self.added.split(text)
            found = [p for bit in bits[::2] if bit for p in self.pattern.findall(self.normal(bit))]
            return found, len(bits) // 2
        return (self.pattern.findall(self.normal(text)) if text else []), 0

    def pieces(self, pretoken: str) -> int:
        """Tokens of one pre-token."""
        return sum(len(self.tool.model.tokenize(p)) for p, _ in self._bytes.pre_tokenize_str(pretoken))

    @property
    def _bytes(self):
        from tokenizers.pre_tokenizers import ByteLevel

        if not hasattr(self, "_alphabet"):
            self._alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        return self._alphabet


def pretoken_counts(docs: DataFrame, file_text: str, text: str = "text") -> DataFrame:
    """``token, n, pieces``: each distinct pre-token of all texts, given to the model once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = Splitter(file_text), Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["token", "n"])
            held.clear()
            return b

        for b in batches:
            for t in b.column(0):
                held.update(splitter.pretokens(t.as_py())[0])
                if len(held) > _HELD:
                    yield out()
        if held:
            yield out()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(file_text)
        for b in batches:
            yield b.append_column("pieces", pa.array([splitter.pieces(t.as_py()) for t in b.column(0)], pa.int64()))

    texts = docs.select(F.col(text)).where(F.col(text).isNotNull())
    distinct = texts.mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(cut, "token string, n bigint, pieces bigint")


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """``doc_id, n_bytes, n_tokens``; ``tokenizer`` is the path of a tokenizer file, read on the driver."""
    with open(tokenizer, encoding="utf-8") as f:
        file_text = f.read()
    spark = docs.sparkSession
    known = stage(pretoken_counts(docs, file_text, text), "pretokens")
    frequent = most_frequent(known, "n", "token", head).select("token", "pieces").toArrow()
    shared = spark.sparkContext.broadcast((frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), file_text))

    narrow = docs.select(
        F.col(key).alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"), F.col(text).alias("text")
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[key].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("sure", T.LongType()),
            T.StructField("rare", T.ArrayType(T.StringType())),
            T.StructField("times", T.ArrayType(T.LongType())),
        ]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, numbers, tokenizer_text = shared.value
        pieces, splitter = dict(zip(names, numbers, strict=True)), Splitter(tokenizer_text)
        for b in batches:
            sure, rare, times = [], [], []
            for t in b.column(2):
                found, total = splitter.pretokens(t.as_py() or "")
                parts = list(map(pieces.get, found))
                if None in parts:
                    odd = Counter(p for p, n in zip(found, parts, strict=True) if n is None)
                    rare.append(list(odd))
                    times.append(list(odd.values()))
                    total += sum(n for n in parts if n is not None)
                else:
                    rare.append([])
                    times.append([])
                    total += sum(parts)
                sure.append(total)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sure, pa.int64()), pa.array(rare, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                names=schema.names,
            )

    # written once, which also fixes the row numbers that the rare pre-tokens are added up by
    per_doc = stage(narrow.mapInArrow(read, schema).withColumn("row", F.monotonically_increasing_id()), "doc-pretokens")
    rows = per_doc.select("row", F.explode(F.arrays_zip("rare", "times")).alias("p")).select("row", F.col("p.rare").alias("token"), F.col("p.times").alias("times"))
    sums = rows.join(known.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    return per_doc.select("row", "doc_id", "n_bytes", "sure").join(sums, "row", "left").select(
        "doc_id", "n_bytes", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    )
