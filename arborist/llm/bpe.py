"""Byte-level BPE ids of whole texts, from a tokenizer file of the tokenizers library.

The vocabulary and its merges are read from that file. Where ids are in the order of the merges (as in
the public byte-level files) tiktoken's core applies them, several times faster and with the same
ids; for any other file the tokenizers library itself does. White space of LONG characters or more, in
which the core's pattern looks ahead again for every character and at last runs out of stack, is cut
off by the same rule beforehand: time is linear in a text's length.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

# Fixed value: the pre-tokenizer's rule of byte-level BPE, as the tokenizers library has it built in.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LONG = 300
_SPACES = regex.compile(r"\p{White_Space}{%d,}+" % LONG)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(model: dict) -> dict[bytes, int] | None:
    """Token bytes to ids, if merging by ids is merging by the file's order."""
    at, vocab = byte_of(), model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [vocab[m] for m in merged]
    singles = [t for t in vocab if len(t) == 1 and t in at]
    if ids != sorted(set(ids)) or len(singles) != 256 or max(vocab[t] for t in singles) > min(ids, default=256):
        return None
    return {bytes(at[c] for c in t): vocab[t] for t in [*singles, *merged]}


class Encoder:
    """encode(text) gives the ids as bytes of `kind` ('<u4' or '<u2'). special_as_text: special tokens spelled out in a text are ordinary text."""

    def __init__(self, path: str, kind: str = "<u4", special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind, self.fast = kind, None
        self.largest = max([*spec["model"]["vocab"].values(), *(a["id"] for a in spec.get("added_tokens", []))], default=0) if isinstance(spec["model"]["vocab"], dict) else 0
        if self.largest > np.iinfo(kind).max:
            raise ValueError(f"ids up to {self.largest} do not fit {kind}")
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        simple = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        ranks = _ranks(spec["model"]) if simple and spec["model"]["type"] == "BPE" and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added) else None
        if ranks:
            import tiktoken

            special = {} if special_as_text else {a["content"]: a["id"] for a in added}
            self.special = list(special)
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = special_as_text

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at its very long white space; those parts that are white space and one pre-token are marked.

        White space is one pre-token but for its last character, which goes with what follows; at the end
        of the text or before a special token it is whole.
        """
        out, at = [], 0
        for m in _SPACES.finditer(text):
            whole = m.end() == len(text) or any(text.startswith(s, m.end()) for s in self.special)
            cut = m.end() if whole else m.end() - 1
            out += [(text[at : m.start()], False), (text[m.start() : cut], True)]
            at = cut
        return [p for p in [*out, (text[at:], False)] if p[0]]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.fast:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        if len(text) >= LONG and _SPACES.search(text):
            parts = [self.fast._core_bpe.encode_single_piece(p.encode()) if one else self.fast.encode(p, allowed_special="all", disallowed_special=()) for p, one in self._parts(text)]
            return np.concatenate([np.array(p, self.kind) for p in parts]).tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype(self.kind, copy=False).tobytes()
