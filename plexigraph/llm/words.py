"""A word-level cache in front of a BPE tokenizer with word ends (lower case, white space dropped).

The tokenizer's pre-tokens never hold white space, and its normalisation (NFC, lower case) does not
reach across ASCII white space, so a text's ids are those of its white-space separated parts in turn.
Each part is encoded once a worker and then looked up.  Parts of printable ASCII and Latin letters are
split here by the pattern in the vocabulary's file; all others go through the tokenizer's own steps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

#: Printable ASCII and Latin letters that NFC leaves alone.
_PLAIN = re.compile("[\x21-\x7eÀ-įı-ſ]+")
_LIMIT = 500_000
_made: dict[str, Callable[[bytes], np.ndarray]] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _splitter(tokenizer: str) -> Callable[[str], list[str]] | None:
    """The vocabulary's own pre-token pattern, or None if it is not made of lower case, one pattern and byte letters."""
    import regex

    made = json.loads(tokenizer)
    steps = (made.get("normalizer") or {}).get("normalizers", [])
    pre = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in pre] != ["Split", "ByteLevel"]:
        return None
    split, letters = pre
    if split["behavior"] != "Removed" or not split["invert"] or "Regex" not in split["pattern"] or letters["add_prefix_space"] or letters["use_regex"]:
        return None
    return regex.compile(split["pattern"]["Regex"]).findall


def encoder(path: str) -> Callable[[bytes], np.ndarray]:
    """A function from UTF-8 bytes to token ids, without special tokens; made once a worker."""
    if path in _made:
        return _made[path]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    model, letters, split = whole.model, _byte_letters(), _splitter(whole.to_str())
    table = {b: letters[b] for b in range(256)}
    known: dict[str, bytes] = {}

    def token(part: str) -> bytes:
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(table)
        return np.array([t.id for t in model.tokenize(mapped)], "<u2").tobytes()

    class Cache(dict):
        def __missing__(self, word: bytes) -> bytes:
            text = word.decode()
            if split is not None and _PLAIN.fullmatch(text):
                out = []
                for part in split(text.lower()):
                    if (ids := known.get(part)) is None:
                        ids = known[part] = token(part)
                    out.append(ids)
                ids = out[0] if len(out) == 1 else b"".join(out)
            else:
                ids = np.array(whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
            self[word] = ids
            return ids

    cache = Cache()

    def encode(text: bytes) -> np.ndarray:
        if len(cache) > _LIMIT or len(known) > _LIMIT:
            cache.clear()
            known.clear()
        return np.frombuffer(b"".join(map(cache.__getitem__, text.lower().split())), "<u2").astype(np.uint32)

    _made[path] = encode
    return encode
