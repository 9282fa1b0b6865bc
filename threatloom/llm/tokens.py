"""Token ids of a public byte-level BPE file, cached per Python worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# Fixed value: split pattern of the byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below U+3000 both libraries were found to split alike, character by character.
_WIDE = re.compile("[\u3000-\U0010ffff]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_sign() -> dict[str, int]:
    """Inverse of the printable alphabet in which the file writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids as ``encode(text, add_special_tokens=False)`` of the ``tokenizers`` library gives them for the file.

    Merging runs in ``tiktoken`` with the ranks of the same file, several times faster.  The two libraries read white
    space and character classes from different Unicode tables, so a text with characters from U+3000 on goes to
    ``tokenizers`` itself; so does one that holds the string of an added token, such as ``<|endoftext|>``, which is one id.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        added = {token["content"]: token["id"] for token in content.get("added_tokens", [])}
        sign = _byte_of_sign()
        pieces: dict[bytes, int] = {}
        for token, number in vocabulary.items():
            if all(s in sign for s in token) and token not in added:
                pieces[bytes(sign[s] for s in token)] = number
        size = max([*vocabulary.values(), *added.values()]) + 1
        self.byte_length = np.zeros(size, np.int64)
        self.ends_sentence = np.zeros(size, bool)
        for piece, number in pieces.items():
            self.byte_length[number] = len(piece)
            self.ends_sentence[number] = piece[-1:] in b".!?\n" or b"\n" in piece
        for token, number in added.items():
            self.byte_length[number] = len(token.encode())
        self._added = tuple(added)
        self._fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens={})
        self._exact = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if (text.isascii() or not _WIDE.search(text)) and not any(token in text for token in self._added):
            return np.array(self._fast.encode_ordinary(text), np.uint32)
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
