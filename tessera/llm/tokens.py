"""Token ids of texts by a public byte-level BPE vocabulary.

The vocabulary file is a parameter and is read where it lies.  A vocabulary
whose ids are also its merge ranks (byte-level BPE without normaliser) is
handed to a faster encoder of the same ids; texts that hold the string of a
special token, and every other vocabulary, go through ``tokenizers``.
"""

from __future__ import annotations

import json

import numpy as np

_loaded: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1
    bytes stand for themselves, the others are numbered from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        self.path, self._exact = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True):
            import public_tokenizers
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            self.fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def exact(self):
        """The file's own tokenizer, loaded when a text first needs it."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
