"""Token ids of whole texts by the byte-level BPE file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os

import numpy as np

# Fixed value: how byte-level BPE files of this kind split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such a file: printable Latin-1 for itself, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of whole texts.

    With ``added_tokens`` the added tokens of the file, such as ``<|endoftext|>``, are known in a text, as
    ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` does; without, they are ordinary text.

    The vocabulary is read from the JSON file. Merging is done by tiktoken, which gives the same ids four times faster
    (the tests compare them with those of ``tokenizers``); a text it refuses, such as one with a million spaces in a
    row, goes to ``tokenizers`` itself.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import tiktoken

        self.path, self.added_tokens = path, added_tokens
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
        self.bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.slow = None

    def _refused(self, text: str) -> list[int]:
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = not self.added_tokens
        return self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            try:
                ids = self.bpe.encode(text, allowed_special="all") if self.added_tokens else self.bpe.encode_ordinary(text)
            except ValueError:
                ids = self._refused(text)
            out.append(np.array(ids, "<u4").tobytes())
        return out
