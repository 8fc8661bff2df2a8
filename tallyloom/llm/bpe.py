"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that stand side by side in no vocabulary token can't be merged: between them
is a certain cut. The pieces between certain cuts are encoded independently, each once, and their
ids concatenated. ASCII white space is in no token at all, so it always cuts; inside words the
table of byte pairs decides.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean, ship

#: Pieces that a Python worker remembers at once, each of so many bytes at most.
CACHE_PIECES, CACHE_BYTES = 160_000, 64


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


#: Characters whose composition, lower case and classes are the same in every library: printable, before the
#: combining marks, no white space. Deleting them leaves nothing of a text that has no others.
_PLAIN = {i: None for i in range(0x21, 0x250) if not 0x7F <= i <= 0xA0 and i != 0xAD and unicodedata.category(chr(i)) != "Cn"}


class ForcedBoundaryBPE:
    """A tokenizer file of the ``tokenizers`` library (byte-level BPE with word ends), by pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.inner = BPE(vocab=model["vocab"], merges=merges)
        self.last = BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.token = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.pairs = {t[i : i + 2] for x in model["vocab"] if (t := x.removesuffix(self.suffix)) for i in range(len(t) - 1)}
        self.seen: dict[bytes, tuple[bytes, bytes]] = {}
        self.seen_words: dict[str, tuple[bytes, bytes]] = {}
        self.to_chars = {b: c for b, c in _byte_chars().items() if chr(b) != c}
        self.simple = regex.compile(split) if (split := self._split_of(spec)) else None
        if self.whole.decoder is not None:
            raise ValueError("only files without a decoder: their tokens are joined by spaces")

    @staticmethod
    def _split_of(spec: dict) -> str | None:
        """The word pattern of a file that composes, collapses white space, lower-cases, splits by a pattern and maps bytes; else None."""
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in before] != ["Split", "ByteLevel"]:
            return None
        split, level = before
        if split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            return None
        return split["pattern"]["Regex"]

    def cuts(self, word: str) -> list[str]:
        """Pieces of a word (in byte characters) between certain cuts."""
        at = [0, *(i + 1 for i in range(len(word) - 1) if word[i : i + 2] not in self.pairs), len(word)]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def words(self, piece: str) -> list[str]:
        """The words that the file's normalizer and pre-tokenizer make of a piece, in byte characters."""
        if self.simple is not None and piece.translate(_PLAIN) == "":
            return [w.encode().decode("latin-1").translate(self.to_chars) for w in self.simple.findall(piece.lower())]
        plain = self.whole.normalizer.normalize_str(piece) if self.whole.normalizer else piece
        return [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(plain)]

    def encode_word(self, word: str) -> tuple[bytes, bytes]:
        *start, end = self.cuts(word)
        ids = [t.id for part in start for t in self.inner.tokenize(part)] + [t.id for t in self.last.tokenize(end)]
        return self.pair(ids)

    def pair(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join([i.to_bytes(4, "little") for i in ids]), "".join([self.token[i] + " " for i in ids]).encode()

    def remember(self, piece: bytes) -> tuple[bytes, bytes]:
        """Ids of a piece as little-endian 32-bit integers, and its decoded text, with a space after it if not empty."""
        text = piece.decode("utf-8", "replace")
        if any(s in text for s in self.special):
            found = self.pair(self.whole.encode(text, add_special_tokens=False).ids)
        else:
            parts = []
            for word in self.words(text):
                if (part := self.seen_words.get(word)) is None:
                    part = self.encode_word(word)
                    if len(word) <= CACHE_BYTES:
                        if len(self.seen_words) >= CACHE_PIECES:
                            self.seen_words.clear()
                        self.seen_words[word] = part
                parts.append(part)
            found = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts]))
        if len(piece) <= CACHE_BYTES:
            if len(self.seen) >= CACHE_PIECES:
                self.seen.clear()
            self.seen[piece] = found
        return found

    def pieces(self, text: bytes) -> list[tuple[bytes, bytes]]:
        get, remember = self.seen.get, self.remember
        return [get(w) or remember(w) for w in text.split()]

    def encode_text(self, text: bytes) -> bytes:
        return b"".join([p[0] for p in self.pieces(text)])

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return " ".join(self.token[int.from_bytes(ids[i : i + 4], "little")] for i in range(0, len(ids), 4))


@lru_cache(maxsize=2)
def loaded(path: str) -> ForcedBoundaryBPE:
    """One encoder for each file and Python worker."""
    return ForcedBoundaryBPE(path)


def _texts(column: pa.Array):
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def _slices(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``df`` with the ids of its texts as a binary column of little-endian unsigned 32-bit integers.

    ``path`` is a tokenizer file that every executor finds. Defined cases: a null or empty text has
    no ids (an empty binary); special tokens written in a text are encoded as the library does;
    repeated rows are encoded alike; an empty table gives no rows. A column named ``ids_col`` is
    replaced; all others are passed on.
    """
    ship(df.sparkSession)
    keep = df.drop(ids_col)
    schema = keep.withColumn(ids_col, F.lit(None).cast("binary")).schema

    def run(batches):
        bpe = loaded(path)
        for batch in _slices(batches):
            at = batch.schema.get_field_index(text_col)
            ids = pa.array([bpe.encode_text(t) for t in _texts(batch.column(at))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, ids_col])

    return keep.mapInArrow(lean(run), schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids, special tokens kept. Null or no ids give an empty text."""
    ship(df.sparkSession)
    keep = df.drop(text_col)
    schema = keep.withColumn(text_col, F.lit(None).cast("string")).schema

    def run(batches):
        bpe = loaded(path)
        for batch in _slices(batches):
            at = batch.schema.get_field_index(ids_col)
            texts = pa.array([bpe.decode(t) for t in _texts(batch.column(at))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text_col])

    return keep.mapInArrow(lean(run), schema)


def bpe_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding in one pass."""
    ship(df.sparkSession)
    keep = df.select(id_col, text_col)
    schema = keep.select(id_col, F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema

    def run(batches):
        bpe, digest = loaded(path), lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in _texts(batch.column(1)):
                pieces = bpe.pieces(text)
                encoded = b"".join([p[0] for p in pieces])
                counts.append(len(encoded) // 4)
                ids.append(digest(encoded))
                texts.append(digest(b"".join([p[1] for p in pieces])[:-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return keep.mapInArrow(lean(run), schema)


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path())
