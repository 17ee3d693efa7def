"""The two tokenizers of an alignment: a byte-level BPE and a sentence-piece BPE, both over given vocabulary files."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Where the vocabulary files lie, on the driver; they are read there and go to the tasks as bytes.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The most bytes of a vocabulary file.
MOST_BYTES = 64 << 20
#: Fixed value: the pattern by which byte-level BPE cuts texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "▁"
#: Parts that are encoded by one call.
TOGETHER = 10_000
#: A single space between two characters that aren't space: both tokenizers begin a token there.
BORDER = re.compile(rf"(?<=[^\s{_SPACE}])\x20(?=[^\s{_SPACE}])")


def vocabulary_files(folder: str = TOKENIZERS) -> tuple[bytes, bytes]:
    out = []
    for name in (A_FILE, B_FILE):
        with open(f"{folder}/{name}", "rb") as file:
            out.append(file.read(MOST_BYTES + 1))
        if len(out[-1]) > MOST_BYTES:
            raise ValueError(f"{name} has more than {MOST_BYTES} bytes")
    return out[0], out[1]


@dataclass(frozen=True)
class Ragged:
    """Lists in one array: list i is values[start[i]:start[i + 1]]."""

    values: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, lists: list, dtype) -> Ragged:
        start = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64)))
        if dtype == np.uint8:
            return cls(np.frombuffer(b"".join(lists), np.uint8), start)
        return cls(np.fromiter((x for one in lists for x in one), dtype, int(start[-1])), start)

    @classmethod
    def joined(cls, parts: list[Ragged], dtype) -> Ragged:
        sizes = np.concatenate([np.empty(0, np.int64), *(p.sizes() for p in parts)])
        return cls(np.concatenate([np.empty(0, dtype), *(p.values for p in parts)]), np.concatenate(([0], np.cumsum(sizes))))

    def sizes(self) -> np.ndarray:
        return np.diff(self.start)

    def take(self, which: np.ndarray) -> Ragged:
        size = self.sizes()[which]
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(int(start[-1])) + np.repeat(self.start[which] - start[:-1], size)
        return Ragged(self.values[at], start)


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 letters are themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoders:
    """ids_a() and ids_b() of texts; bytes_a and bytes_b are the bytes of each id."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        spec, letters = json.loads(a_file), _byte_letters()
        special = {x["content"] for x in spec["added_tokens"] if x["special"]}
        ranks = {bytes(letters[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if entry not in special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if [spec["model"]["vocab"][m] for m in merged] != list(range(256, 256 + len(merged))) or spec["normalizer"]:
            raise ValueError("ids of the byte-level vocabulary don't follow the order of its merges")
        self._a = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        entries = [b""] * (max(ranks.values()) + 1)
        for entry, i in ranks.items():
            entries[i] = entry
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_a = Ragged.of(entries, np.uint8)
        self.bytes_b = Ragged.of([bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)], np.uint8)
        #: Whether no entry of B goes on after a space, so that texts may be cut at borders.
        self.borders = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """The text cut at borders, without the spaces there: tokens of space+part, one part after another, are those of space+text."""
        return BORDER.split(text) if self.borders else [text]

    def ids_a(self, parts: list[str]) -> Ragged:
        return self._ids(parts, lambda own: [self._a.encode_ordinary(" " + p) for p in own])

    def ids_b(self, parts: list[str]) -> Ragged:
        return self._ids(parts, lambda own: self._b.encode(own, num_threads=1))

    @staticmethod
    def _ids(parts: list[str], encode) -> Ragged:
        """A few parts at a time, as lists of numbers take much more room than arrays."""
        return Ragged.joined([Ragged.of(encode(parts[i : i + TOGETHER]), np.int32) for i in range(0, len(parts), TOGETHER)], np.int32)


@lru_cache(2)
def encoders(a_file: bytes, b_file: bytes) -> Encoders:
    """Built once in a Python worker."""
    return Encoders(a_file, b_file)
