"""Byte-pair ids of many texts at once, for code that runs inside tasks.

Most words of a corpus repeat. Texts are cut before each blank and line break, which the tokenizer
never merges across when what follows is no white space, every cut word is hashed in one pass over
the bytes, and ids of known words are gathered from a bounded pool. Only unknown words reach the
tokenizer, all of a chunk in one call. Texts with other or doubled white space, where cutting could
change ids, go to the tokenizer whole. Words are told apart by 64-bit hashes. Texts that hold an added token
are split at it, and the parts go to the tokenizer one by one.
"""

from __future__ import annotations

import base64
import json
import re
from itertools import pairwise

import numpy as np

#: Words held at a time, and ids held for them.
WORD_SLOTS = 1 << 20
POOL_IDS = 1 << 23
#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 20

_BLANK, _BREAK, _START = 0x20, 0x0A, 0xFF  # 0xFF occurs in no UTF-8 text
_SPACE_BYTES = np.zeros(256, bool)
_SPACE_BYTES[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_OTHER_SPACE = re.compile(
    rb"[\t\x0b\x0c\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
_FACTOR = 0x5851F42D4C957F2D


def _powers(factor: int, count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    out[0] = 1
    done = 1
    while done < count:
        step = np.uint64(pow(factor, done, 1 << 64))
        take = min(done, count - done)
        out[done : done + take] = out[:take] * step
        done += take
    return out


def load_encoding(path: str, pattern: str):
    """The tokenizer of a rank file, without added tokens."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, which it finds in a text before anything else."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in found):
        raise ValueError("added tokens that take white space or whole words are not supported")
    return {token["content"]: token["id"] for token in found}


class TokenIds:
    """Ids of lists of UTF-8 texts, equal to those of the tokenizer for each text alone."""

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        self.encoding = load_encoding(path, pattern)
        self.added = {token.encode(): number for token, number in (added or {}).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = re.compile(b"(" + b"|".join(map(re.escape, longest_first)) + b")").split
        self.n_ids = max([self.encoding.n_vocab, *(number + 1 for number in self.added.values())])
        self.dtype = np.uint16 if self.n_ids <= 1 << 16 else np.uint32
        self.line_break = self.encoding.encode_ordinary("\n")[0]
        spread = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64)
        self.byte_value = spread.view(np.uint64)
        self.limit = CHUNK_BYTES
        self.power = _powers(_FACTOR, self.limit + 1)
        self.back = _powers(pow(_FACTOR, -1, 1 << 64), self.limit + 1)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(WORD_SLOTS, np.uint64)
        self.at = np.zeros(WORD_SLOTS, np.int64)
        self.size = np.zeros(WORD_SLOTS, np.int64)
        self.pool = np.zeros(POOL_IDS, self.dtype)
        self.used = 0

    def _alone(self, text: bytes) -> np.ndarray:
        if self._holds_added(text):
            parts = [part for part in self.split_added(text) if part]
            return np.concatenate([self._plain(x) if x not in self.added else np.array([self.added[x]], self.dtype) for x in parts])
        return self._plain(text)

    def _holds_added(self, text: bytes) -> bool:
        return any(token in text for token in self.added)

    def _plain(self, text: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), self.dtype)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        waiting: list[bytes] = []
        held = 0
        for text in texts:
            if held + len(text) + 1 > self.limit and waiting:
                out += self._chunk(waiting)
                waiting, held = [], 0
            if len(text) + 1 > self.limit:
                out.append(self._alone(text))
                continue
            waiting.append(text)
            held += len(text) + 1
        return out + self._chunk(waiting) if waiting else out

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"\xff" + b"\xff".join(texts)
        raw = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero((raw == _BLANK) | (raw == _BREAK) | (raw == _START))
        ends = np.append(cuts[1:], len(raw))
        starts_text = raw[cuts] == _START
        text_of = np.cumsum(starts_text) - 1
        odd = np.zeros(len(texts), bool)
        odd[text_of[ends - cuts == 1]] = True
        suspects = np.flatnonzero(_SPACE_BYTES[raw])
        for t in np.unique(text_of[np.searchsorted(cuts, suspects, side="right") - 1]):
            odd[t] = odd[t] or _OTHER_SPACE.search(texts[t]) is not None
        if any(token in data for token in self.added):
            odd |= [self._holds_added(text) for text in texts]

        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.byte_value[raw] * self.power[: len(raw)], out=total[1:])
        hashes = (total[ends] - total[cuts]) * self.back[cuts]
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes = (hashes ^ (hashes >> np.uint64(32))) | np.uint64(1)
        usable = ~odd[text_of]
        cuts, ends, hashes, text_of = cuts[usable], ends[usable], hashes[usable], text_of[usable]
        slots = ((hashes >> np.uint64(3)) & np.uint64(WORD_SLOTS - 1)).astype(np.int64)
        known = self.key[slots] == hashes
        at, sizes = self.at[slots], self.size[slots]
        if not known.all():
            found = self._learn(data, cuts, ends, hashes, slots, known, at, sizes)
            if not found and known.any():
                self._forget()
                found = self._learn(data, cuts, ends, hashes, slots, np.zeros(len(cuts), bool), at, sizes)
            if not found:
                return [self._alone(text) for text in texts]
        after = np.cumsum(sizes)
        count = int(after[-1]) if len(after) else 0
        place = np.repeat(at - (after - sizes), sizes)
        ids = self.pool[place + np.arange(count)]
        per_text = np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)
        parts = np.split(ids, np.cumsum(per_text)[:-1])
        return [self._alone(texts[t]) if odd[t] else parts[t] for t in range(len(texts))]

    def _learn(self, data: bytes, cuts, ends, hashes, slots, known, at, sizes) -> bool:
        """Put the ids of unknown words into the pool and their places into ``at`` and ``sizes``.

        False if the pool has no room or the answers can't be told apart.
        """
        unknown = np.flatnonzero(~known)
        _, first, each = np.unique(hashes[unknown], return_index=True, return_inverse=True)
        new = unknown[first]
        words = [data[a:b] for a, b in zip(cuts[new].tolist(), ends[new].tolist(), strict=True)]
        asked = b"".join([b"\n" + (word if word[0] == _BLANK else word[1:]) for word in words])
        ids = np.array(self.encoding.encode_ordinary(asked.decode("utf-8", "replace")), np.int64)
        breaks = np.flatnonzero(ids == self.line_break)
        if len(breaks) != len(words) or self.used + len(ids) > POOL_IDS:
            return False
        self.pool[self.used : self.used + len(ids)] = ids
        keeps_break = np.frombuffer(data, np.uint8)[cuts[new]] == _BREAK
        begins = breaks + np.where(keeps_break, 0, 1)
        lengths = np.append(breaks[1:], len(ids)) - begins
        at[unknown], sizes[unknown] = (self.used + begins)[each], lengths[each]
        # A later word takes the slot of an earlier one.
        self.key[slots[new]], self.at[slots[new]], self.size[slots[new]] = hashes[new], self.used + begins, lengths
        self.used += len(ids)
        return True


def windows(length: int, size: int) -> list[tuple[int, int]]:
    """Full windows (start, stop) of a run of ``length`` ids; what is left over is not in them."""
    return list(pairwise(range(0, length + 1, size)))
