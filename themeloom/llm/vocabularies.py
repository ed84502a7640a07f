"""Two public tokenizers and the bytes of each of their tokens.

The files are read on the machine that runs a task, from a folder that is a parameter;
on a cluster it has to be at that path on every executor.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import sentencepiece
import tiktoken


@dataclass(frozen=True)
class VocabularyFiles:
    folder: str = "/opt/tokenizers"
    byte_level: str = "byte_bpe_50k.json"
    pieces: str = "piece_bpe_32k.model"


# How a byte-level vocabulary is split into words before merging, and the
# printable bytes that its entries spell as themselves (all others are spelled from
# U+0100 on, in order).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]


@dataclass
class Vocabulary:
    """``cut`` gives the ids of a space and a text, or none if their tokens are other
    bytes; ``tokens[id]`` are the bytes, ``sizes`` their lengths, and ``names[mark][id]``
    is the id in decimal with a mark behind it."""

    cut: Callable[[str], np.ndarray | None]
    tokens: list[bytes]

    def __post_init__(self) -> None:
        self.sizes = np.array([len(x) for x in self.tokens], np.int64)
        self.names = {mark: np.array([f"{i}{mark}" for i in range(len(self.tokens))], object) for mark in ",|;"}
        self.small = self.sizes.astype(np.uint8) if self.sizes.max(initial=0) < 256 else None

    def lengths(self, ids: np.ndarray) -> bytes | list[int]:
        """Lengths of the tokens, as bytes if they fit."""
        return self.sizes[ids].tolist() if self.small is None else self.small[ids].tobytes()

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def byte_level(path: str) -> Vocabulary:
    """A byte-level BPE file. Its merges are in the order of the ids, so the ids serve
    as merge ranks; special tokens are left out, their strings are plain text."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    special = {x["id"] for x in content["added_tokens"]}
    same = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    others = [b for b in range(256) if b not in set(same)]
    letter = {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = [b""] * (max([*model["vocab"].values(), *special]) + 1)
    for spelled, i in model["vocab"].items():
        if i not in special:
            tokens[i] = bytes(letter[c] for c in spelled)
    merged = [model["vocab"]["".join(x.split(" ") if isinstance(x, str) else x)] for x in model["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"{path}: the merges are not in the order of the ids")
    ranks = {token: i for i, token in enumerate(tokens) if token}
    coder = tiktoken.Encoding(path, pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def cut(text: str) -> np.ndarray:
        # Every byte is a token and merges only join bytes: these tokens give any text back.
        return coder.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)

    return Vocabulary(cut, tokens)


def piece_level(path: str) -> Vocabulary:
    """A sentence-piece model; it puts a space in front of a text itself."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        tokens.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def cut(text: str) -> np.ndarray | None:
        ids = model.encode(text, num_threads=1)
        same = b"".join(map(tokens.__getitem__, ids)) == (" " + text).encode()
        return np.fromiter(ids, np.int64, len(ids)) if same else None

    return Vocabulary(cut, tokens)


def load(files: VocabularyFiles) -> tuple[Vocabulary, Vocabulary]:
    return (
        byte_level(os.path.join(files.folder, files.byte_level)),
        piece_level(os.path.join(files.folder, files.pieces)),
    )
