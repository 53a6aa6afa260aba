"""Token ids of whole texts by the `tokenizers` library, with caches of the words met before.

The word-level tokenizer normalises and splits at white space, and no later step joins what a space or a
line feed separates, so the ids of a text are those of its space-separated chunks one after the other.
Within a chunk of plain Latin letters the same holds for the pieces that its splitting pattern finds. So each
distinct chunk of a batch is looked at once, and the ids of the batch are gathered from those.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What the tokenizer's splitter takes besides runs of letters.
_BETWEEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+"
#: Chunks that lower-casing and that pattern treat alike in any library; the others go to the tokenizer itself.
_PLAIN = "^[\x21-\x7e\xa1-\xac\xae-\u012f\u0131-\u024f]*$"
#: Byte-level alphabet: a byte that prints stands for itself, the others for U+0100 onwards in their order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_SHOWN = {b: 256 + i for i, b in enumerate(_HIDDEN)}
#: Texts of about so many bytes are encoded at a time.
BATCH_BYTES = 4 << 20


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `codes` of `flat`, which holds runs of `sizes`, one after the other; and where each ends."""
    size = sizes[codes]
    ends = np.cumsum(size)
    at = np.repeat((np.cumsum(sizes) - sizes)[codes] - ends + size, size)
    return flat[at + np.arange(len(at))], ends


def bounds_of(lists: pa.ListArray, ends: np.ndarray) -> np.ndarray:
    at = lists.offsets.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], ends])[at - at[0]]


class ChunkEncoder:
    """Ids of texts; it holds at most `limit` words that it has met, of at most 32 characters."""

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """A piece as the splitter leaves it needs the merges alone, over its bytes as characters."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        found = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(word) <= 32:
            if len(self.words) >= self.limit:
                self.words.clear()
            self.words[word] = found
        return found

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks one after the other, and how many each has."""
        plain = pc.and_not(pc.match_substring_regex(chunks, _PLAIN), pc.match_substring(chunks, "<|"))
        low = pc.utf8_lower(pc.if_else(plain, chunks, ""))
        parts = pc.split_pattern(pc.replace_substring_regex(low, _BETWEEN, r" \0 "), " ")
        codes = parts.values.dictionary_encode()
        get, word = self.words.get, self._word
        each = [word(w) if (b := get(w)) is None else b for w in codes.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, each), np.int64, len(each)) >> 2
        flat, ends = gather(np.frombuffer(b"".join(each), "<u4"), sizes, codes.indices.to_numpy(zero_copy_only=False))
        bounds = bounds_of(parts, ends)
        size = np.diff(bounds)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(odd):
            own = [np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, "<u4") for c in chunks.take(pa.array(odd)).to_pylist()]
            flat = np.insert(flat, np.repeat(bounds[odd], [len(x) for x in own]), np.concatenate(own))
            size[odd] = [len(x) for x in own]
        return flat, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `texts` (no nulls) one after the other, and the places where the texts' ids begin and end."""
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        codes = chunks.values.dictionary_encode()
        flat, sizes = self._distinct(codes.dictionary)
        flat, ends = gather(flat, sizes, codes.indices.to_numpy(zero_copy_only=False))
        return flat, bounds_of(chunks, ends)


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """`texts` in parts of about `most` bytes, each with the row where it begins."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most)))
        yield begin, texts.slice(begin, end - begin)
        begin = end


_ENCODERS: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for each tokenizer file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
