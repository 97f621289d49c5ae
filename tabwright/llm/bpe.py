"""Byte-level BPE encoding by backtracking, decoding by an offset table.

The encoder never replays merges.  An Aho-Corasick automaton over the
vocabulary finds the longest token at every byte of a piece; tokens are laid
end to end, each checked against its left neighbour in a table of compatible
pairs (pairs that BPE would leave as they are); a token that does not fit is
replaced by its longest prefix in the vocabulary, and a dead end is remembered,
so every position is given up at most once and time is linear.

The vocabulary is a parameter: the path of a tokenizer file that executors
can read too.  Null texts encode as empty; special tokens written out in a
text become their ids, as the library does by default.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.llm.batches import slices
from tabwright.llm.columns import free_names
from tabwright.llm.registry import llm_query

# fixed value: the pre-tokenizer's pattern of this vocabulary
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_KEPT, PAIRS_KEPT, LONGEST_KEPT = 300_000, 400_000, 64
DECODE_IDS = 1 << 20
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocabulary.values(), *special.values()]) + 1
        self.bytes = [b""] * size
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, k in special.items():
            self.bytes[k] = token.encode()
        # how each token is made: the rank of its merge and its two parts
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole, a, b = vocabulary[a + b], vocabulary[a], vocabulary[b]
            self.merges[a, b] = rank
            self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
        plain = {self.bytes[k]: k for k in vocabulary.values() if k not in special.values()}
        self.shorter = [-1] * size
        self.automaton = ahocorasick.Automaton()
        for text, k in plain.items():
            self.shorter[k] = next((plain[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in plain), -1)
            self.automaton.add_word(text.decode("latin-1"), (k, len(text)))
        self.automaton.make_automaton()
        self.special = special
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = regex.compile(PIECE)
        self.kept: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.lengths, self.offsets = lengths, np.cumsum(lengths) - lengths

    def _stays(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` apart.

        Undo both tokens, the later merge first.  At each moment the pieces at
        the seam are known, and so is when each was swallowed; a merge across
        the seam that comes before both ends wins.  Of equal merges the left one is first.
        """
        a_ends = b_ends = NEVER
        while True:
            across = self.merges.get((a, b), NEVER)
            if across < a_ends and across <= b_ends and across != NEVER:
                return False
            if self.rank[a] > self.rank[b]:
                a_ends, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                b_ends, b = self.rank[b], self.left[b]
            else:
                return True

    def _compatible(self, a: int, b: int) -> bool:
        fits = self.pairs.get((a, b))
        if fits is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            fits = self.pairs[a, b] = self._stays(a, b)
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        longest = [-1] * len(piece)
        for last, (token, length) in self.automaton.iter(piece.decode("latin-1")):
            longest[last - length + 1] = token  # matches come by their end, so the longest is last
        size, laid, at, dead = len(piece), [], 0, set()
        token = longest[0]
        while at < size:
            to = at + len(self.bytes[token])
            if to not in dead and (not laid or self._compatible(laid[-1], token)):
                laid.append(token)
                at = to
                token = longest[at] if at < size else -1
                continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: give the position up and shorten the token before it
                dead.add(at)
                if not laid:
                    raise ValueError("the vocabulary lacks a byte of the text")
                at -= len(self.bytes[laid[-1]])
                token = self.shorter[laid.pop()]
        return laid

    def _piece(self, piece: str) -> bytes:
        ids = array("i", self.encode_piece(piece.encode("utf-8"))).tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self.kept) >= PIECES_KEPT:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as packed 32-bit integers."""
        found, kept, piece = self.pieces.findall, self.kept, self._piece
        if self.split_special is None or not any(s in text for s in self.special):
            return b"".join([kept.get(p) or piece(p) for p in found(text)])
        out = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                out += [kept.get(p) or piece(p) for p in found(part)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids: one gather over the offset table per block."""
        out = []
        for k in range(0, len(ids), DECODE_IDS):
            block = ids[k : k + DECODE_IDS]
            lengths = self.lengths[block]
            shift = self.offsets[block] - (np.cumsum(lengths) - lengths)
            out.append(self.blob[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def load_bpe(path: str) -> ByteBpe:
    """One instance per worker process."""
    return ByteBpe(path)


def encode_documents(
    docs: DataFrame, path: str, text_col: str = "text", ids_name: str = "token_ids", decoded_name: str = "decoded"
) -> DataFrame:
    """Append the ids of every text and the text decoded from them (names given way to taken ones)."""
    ids_name, decoded_name = free_names(docs, ids_name, decoded_name)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField(ids_name, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded_name, T.StringType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load_bpe(path)
        for batch in batches:
            for part in slices(batch, text_col):
                packed = [bpe.encode(t or "") for t in part.column(text_col).to_pylist()]
                ends = np.cumsum([0] + [len(p) // 4 for p in packed])
                flat_ids = np.frombuffer(b"".join(packed), np.int32)
                plain = [bpe.decode(flat_ids[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat_ids))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(plain, pa.string())], names=schema.names)

    return docs.mapInArrow(work, schema)


def default_path() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Replace the decoded text, and the ids unless they are kept, by number and digests.

    Ids and decoded text are the last two columns, as ``encode_documents`` appends them, whatever their names;
    the new columns give way to names that are taken.
    """
    ids, decoded = encoded.columns[-2:]
    kept = encoded.columns[: -1 if keep_ids else -2]
    n_tokens, ids_sha256, decoded_sha256 = free_names(encoded.select(*[F.col(f"`{c}`") for c in kept]), "n_tokens", "ids_sha256", "decoded_sha256")
    return encoded.select(
        *[F.col(f"`{c}`") for c in kept],
        F.size(f"`{ids}`").cast("long").alias(n_tokens),
        F.sha2(F.array_join(F.col(f"`{ids}`"), ","), 256).alias(ids_sha256),
        F.sha2(F.col(f"`{decoded}`"), 256).alias(decoded_sha256),
    )


@llm_query("op6_bpe", "documents")
def op6_bpe(docs: DataFrame, folder: str) -> DataFrame:
    encoded = encode_documents(docs.select("doc_id", "text"), default_path())
    return digests(encoded.drop("text"))
