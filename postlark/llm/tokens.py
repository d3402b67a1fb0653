"""Token ids of a byte-level BPE vocabulary, with a bounded cache of words.

Byte-level BPE never merges across the start of a white-space run, so a text cut
in front of single blanks and line ends tokenizes piece by piece.  Frequent words
come from a dictionary of packed ids; all other words of a batch go to the
library in one call.  Texts with irregular white space take the
library's path as a whole, so the ids are always those of the whole text.
"""

from __future__ import annotations

import base64
import functools
import gc
import re
from collections import Counter

import numpy as np

ID_BYTES = 4
#: Words held by a worker: the frequent ones, few enough for a processor's cache.
WORDS_KEPT = 30_000
TEXTS_AT_ONCE = 200


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


#: White space besides blanks and line ends, in the widest sense of any library.
_OTHER_BLANKS = re.compile(r"[^\S \n]")


class Encoder:
    """``pack_all(texts)`` gives texts' ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.byte_lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.byte_lengths[rank] = len(token)
        self._words = {"\n": self._whole("\n")}

    def _whole(self, text: str) -> bytes:
        return np.array(self._library.encode_ordinary(text), "<u4").tobytes()

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Encode pieces in one call; their ids are told apart by their byte lengths."""
        if not pieces:
            return []
        ids = np.array(self._library.encode_ordinary("".join(pieces)), "<u4")
        text = np.frombuffer("".join(pieces).encode(), np.uint8)
        ends = np.r_[np.nonzero((text == 32) | (text == 10))[0][1:], len(text)]  # every piece begins with its only white space
        at = ((np.searchsorted(np.cumsum(self.byte_lengths[ids]), ends) + 1) * ID_BYTES).tolist()
        packed = ids.tobytes()
        return [packed[i:j] for i, j in zip([0, *at], at)]  # noqa: B905  one start more than ends

    def pack_all(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; null has none."""
        gc.disable()  # millions of short-lived strings in lists: collector runs cost a fifth and free nothing
        try:
            return [ids for i in range(0, len(texts), TEXTS_AT_ONCE) for ids in self._some(texts[i:i + TEXTS_AT_ONCE])]
        finally:
            gc.enable()

    def _some(self, texts: list[str | None]) -> list[bytes]:
        known, out, pieces, todo = self._words.get, [], [], []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            odd = text[0] in " \n" or text[-1] == " " or text.endswith("\n\n")
            if odd or _OTHER_BLANKS.search(text) or "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text:
                out.append(self._whole(text))
                continue
            words = text.replace("\n", " \n").split(" ")
            parts = list(map(known, words))
            parts[0] = None
            new = [i for i, part in enumerate(parts) if part is None]
            found = [w if (w := words[i])[0] == "\n" else " " + w for i in new[1:]]
            todo.append((len(out), parts, new))
            out.append(b"")
            pieces.append("\n" + words[0])
            pieces += found
        ids = self._new(pieces)
        if len(self._words) < WORDS_KEPT:
            seen = Counter(pieces)
            self._words |= {p[p[0] == " ":]: i for p, i in zip(pieces, ids, strict=True) if seen[p] > 2}
        start = 0
        for k, parts, new in todo:
            parts[0] = ids[start][ID_BYTES:]  # without the line end put in front
            for i, part in zip(new[1:], ids[start + 1:start + len(new)], strict=True):
                parts[i] = part
            start += len(new)
            out[k] = b"".join(parts)
        return out

    def pack(self, text: str | None) -> bytes:
        return self.pack_all([text])[0]

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.pack(text), "<u4")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker; workers serve many tasks."""
    return Encoder(path)
