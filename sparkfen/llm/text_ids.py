"""Ids of whole texts from byte-pair tokenizers, faster than through the tokenizer's whole chain of steps.

Plain texts (ASCII, composed Latin letters, ASCII white space) are cut as the tokenizer's own steps would cut them, and merged
by tiktoken, which gets the ranks from the tokenizer's vocabulary; it needs no cache. In a text with other characters, chunks
between white space that are not plain go through the whole tokenizer. So does a text with a special string.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

from sparkfen.llm import token_counts
from sparkfen.llm.token_counts import OTHER_SPACE, byte_chars, tokenizer

#: The steps before the merges for which TextIds knows a shorter way.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
PLAIN = re.compile("[\t-\r -~À-įı-ſ]*")
#: Plain text cut as by steps that lower-case it and remove white space.
WORD_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^{LETTERS}0-9\t-\r ]+")
#: A blank between two printable characters: no cut of a tokenizer reaches over it from before.
BORDER = re.compile(rb"(?<=[!-~]) (?=[!-~])")
STRETCH = 1 << 20
#: Stands for the end of a word in the ranks; no plain text has it.
END = "\x01"


def stretches(data: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The text in stretches of about size bytes, cut only before single blanks between words."""
    at = 0
    while len(data) - at > size:
        cut = BORDER.search(data, at + size)
        if not cut:
            break
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:]


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """bytes of each token -> its id, or None if ids do not follow the order of the merges."""
    pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
    ids = [model["vocab"].get("".join(p), -1) for p in pairs]
    if any(a >= b for a, b in zip(ids, ids[1:])):
        return None
    back, end = {c: bytes([b]) for b, c in byte_chars().items()}, model.get("end_of_word_suffix") or ""
    out: dict[bytes, int] = {}
    for token, i in model["vocab"].items():
        word = token.removesuffix(end) if end else token
        if all(c in back for c in word) and (i <= ids[-1]):
            out[b"".join(back[c] for c in word) + (END.encode() if word != token else b"")] = i
    return out if all(bytes([b]) in out for b in range(256)) else None


class TextIds:
    """encode(data) gives the ids of a whole text as bytes (uint32, little endian)."""

    def __init__(self, path: str) -> None:
        self.encoder, self.merge = tokenizer(path), None
        steps = json.loads(self.encoder.to_str())
        known = lambda fixed: all(steps.get(k) == v for k, v in fixed.items()) and steps["model"]["type"] == "BPE" and not steps["model"].get("dropout")
        self.words = known(WORD_STEPS)
        if (self.words or known(token_counts.KNOWN_STEPS)) and (ranks := ranks_of(steps["model"])):
            import tiktoken

            pattern = f"[^{END}]+{END}" if self.words else token_counts.CUT.pattern
            self.merge = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: Lower-casing may make a special string out of another, so they are looked for in any case.
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in steps["added_tokens"]) or b"(?!)", re.IGNORECASE)

    def whole(self, data: bytes) -> bytes:
        """The tokenizer's own way."""
        return array("I", self.encoder.encode(data.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, data: bytes | None) -> bytes:
        """The ids of one text; a missing or empty one has none."""
        if not data:
            return b""
        if self.merge is None or self.special.search(data):
            return self.whole(data)
        return b"".join(map(self._stretch, stretches(data)))

    def _stretch(self, data: bytes) -> bytes:
        text = data.decode()
        if PLAIN.fullmatch(text):
            return self._plain(text)
        if self.words:
            return b"".join(self._plain(c) if PLAIN.fullmatch(c) else self.whole(c.encode()) for c in map(bytes.decode, data.split()))
        if OTHER_SPACE.search(text):
            return self.whole(data)
        return b"".join(self._plain(p) if PLAIN.fullmatch(p) else self.whole(p.encode()) for p in map(bytes.decode, token_counts.PIECE.findall(data)))

    def _plain(self, text: str) -> bytes:
        if self.words:
            text = END.join([*WORD_CUT.findall(text.lower()), ""])
        return array("I", self.merge(text)).tobytes()
