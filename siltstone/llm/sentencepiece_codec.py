"""Exact encoding with merge-type SentencePiece models by backtracking, and decoding.

An encoding is the one that merging gives if, and only if, every two neighbours in it stay apart when their joint
text is merged anew. So a unit of text is encoded from the left with the longest pieces that an Aho-Corasick
automaton finds; a piece whose pair with the one before fails that check gives way to the next shorter one; where none
is left, the position is marked in a bitfield as failed and the piece before gives way in turn.

No piece of the model holds a letter beside anything but letters, or a space mark after another character. So
units are runs of letters or runs of other characters, each with the space marks before it, and each distinct
unit of a batch is encoded once. (A model where that doesn't hold is refused.) Only the model file's pieces and scores are
taken from the sentencepiece library for encoding; its decoder decodes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import table, text_or_empty
from siltstone.llm.tokens import bounds_of, gather, slices

_SPACE, _CUT = "▁", "\uffff"
_UNITS = rf"{_SPACE}*(?:\p{{L}}+|[^\p{{L}}{_SPACE}]+)"
#: Texts where a run of space marks may reach over the end of a space-separated chunk.
_RUNS = rf"^ |  | $|[{_SPACE}{_CUT}]"
_KEPT = 32


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder of a model; holds at most `limit` units, of at most 32 characters, and as many checked pairs."""

    def __init__(self, path: str, limit: int = 400_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library, self.limit = SentencePieceProcessor(model_file=path), limit
        model = self.library
        every = range(model.get_piece_size())
        plain = [i for i in every if not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i) or model.is_byte(i))]
        self.rank = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.units: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        if any(_CUT in p for p in self.rank) or any(len(found) != 1 for found in self._split(pa.array([p for p in self.rank if p.strip(_SPACE)]))):
            raise ValueError("the model has pieces that join letters with other characters")
        scores = [s for s, _ in self.rank.values()]
        self.tied = len(set(scores)) < len(scores)
        self.chars = frozenset(p for p in self.rank if len(p) == 1)
        self.piece = {i: p for p, (_, i) in self.rank.items()}
        automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:
                automaton.add_word(piece, (len(piece), i))
        automaton.make_automaton()
        self.automaton = automaton

    @staticmethod
    def _split(chunks: pa.Array) -> list[list[str]]:
        return [x[1:] for x in pc.split_pattern(pc.replace_substring_regex(chunks, _UNITS, _CUT + r"\0"), _CUT).to_pylist()]

    def merge(self, text: str) -> list[str]:
        """`text` by merging: always the neighbours of the best score, of equal ones the first."""
        parts, rank, never = list(text), self.rank, (float("inf"), 0)
        pairs = [rank.get(a + b, never)[0] for a, b in zip(text, text[1:])]
        while pairs and (best := min(pairs)) != never[0]:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank.get(parts[i - 1] + parts[i], never)[0]
            if i < len(pairs):
                pairs[i] = rank.get(parts[i] + parts[i + 1], never)[0]
        return parts

    def _apart(self, left: int, right: int) -> bool:
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            a, b = self.piece[left], self.piece[right]
            found = self.pairs[left, right] = self.merge(a + b) == [a, b]
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Ids of `text`, all of whose characters are pieces. If the longest pieces stay apart, none gives way."""
        apart, get = self._apart, self.pairs.get
        ids = [i for _, (_, i) in self.automaton.iter_long(text)]
        if all([apart(*x) if (known := get(x)) is None else known for x in zip(ids, ids[1:])]):
            return ids
        found: list[list[tuple[int, int]]] = [[] for _ in text]
        for end, match in self.automaton.iter(text):
            found[end - match[0] + 1].append(match)
        alive = (1 << (len(text) + 1)) - 1
        ids, sizes, tried = [], [], []  # tried: for each piece, its place among the matches at its beginning
        at, choice = 0, -1
        while at < len(text):
            matches = found[at]
            if choice < 0:
                matches.sort(reverse=True)
            for k in range(choice + 1, len(matches)):
                size, i = matches[k]
                if alive >> (at + size) & 1 and (not ids or apart(ids[-1], i)):
                    ids.append(i)
                    sizes.append(size)
                    tried.append(k)
                    at, choice = at + size, -1
                    break
            else:
                alive &= ~(1 << at)
                ids.pop()
                at, choice = at - sizes.pop(), tried.pop()
        return ids

    def _unit(self, unit: str) -> bytes:
        if self.chars.issuperset(unit):
            parts = [unit]
        else:  # characters without a piece become bytes and join nothing
            parts = "".join(c if c in self.chars else f"{_CUT}{c}{_CUT}" for c in unit).split(_CUT)
        ids: list[int] = []
        for part in parts:
            if not self.chars.issuperset(part):
                ids += [self.byte[b] for b in part.encode("utf-8", "replace")]
            elif self.tied and _SPACE * 2 in part:
                ids += [self.rank[p][1] for p in self.merge(part)]
            elif part:
                ids += self._backtrack(part)
        found = array("i", ids).tobytes()
        if len(unit) <= _KEPT:
            if len(self.units) >= self.limit:
                self.units.clear()
            self.units[unit] = found
        return found

    def _ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        get, own = self.units.get, self._unit
        each = [own(u) if (b := get(u)) is None else b for u in units.to_pylist()]
        return np.frombuffer(b"".join(each), "<i4"), np.fromiter(map(len, each), np.int64, len(each)) >> 2

    def _spread(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of lists of units one after the other, and the places where the lists' ids begin and end."""
        codes = lists.values.dictionary_encode()
        flat, sizes = self._ids(codes.dictionary)
        flat, ends = gather(flat, sizes, codes.indices.to_numpy(zero_copy_only=False))
        return flat, bounds_of(lists, ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of `texts` (no nulls), without an end id, and the places where the texts' ids begin and end."""
        chunks = pc.split_pattern(texts, " ")
        codes = chunks.values.dictionary_encode()
        marked = pc.binary_join_element_wise(_SPACE, codes.dictionary, "")
        flat, bounds = self._spread(pc.split_pattern(pc.replace_substring_regex(marked, _UNITS, _CUT + r"\0"), _CUT))
        flat, ends = gather(flat, np.diff(bounds), codes.indices.to_numpy(zero_copy_only=False))
        bounds = bounds_of(chunks, ends)
        odd = np.flatnonzero(pc.or_(pc.match_substring_regex(texts, _RUNS), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False))
        if not len(odd):
            return flat, bounds
        parts = [flat[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        for i in odd.tolist():
            parts[i] = self._whole(texts[i].as_py())
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _whole(self, text: str) -> np.ndarray:
        """Units of one text with runs of space marks; the cut mark itself has no piece, so it parts units anyway."""
        found: list[bytes] = []
        for k, part in enumerate((_SPACE + text.replace(" ", _SPACE) if text else "").split(_CUT)):
            if k:
                found.append(array("i", [self.byte[b] for b in _CUT.encode()]).tobytes())
            if part:
                marked = pc.replace_substring_regex(pa.array([part]), _UNITS + f"|{_SPACE}+", _CUT + r"\0")[0].as_py()
                found += [self._unit(u) if (b := self.units.get(u)) is None else b for u in marked.split(_CUT)[1:]]
        return np.frombuffer(b"".join(found), "<i4")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each model file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    work = codec(path)
    end = np.array([work.library.eos_id()], np.int32)
    for batch in batches:
        for begin, texts in slices(batch.column(1)):
            flat, bounds = work.encode(texts)
            flat = np.insert(flat, bounds[1:], end[0]).astype(np.int32)
            bounds = bounds + np.arange(len(bounds))
            decoded = [work.library.decode(flat[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """For each row of `docs` its doc_id, `ids` (with the model's end id) and the text that these decode to.

    A null text counts as empty: the end id alone, decoded to an empty text. Rows that repeat are all kept; an empty
    table gives no rows; other columns are ignored. Memory follows the longest text, which is never cut."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("ids array<int>, decoded string")])
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(partial(_encode, path=path), schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), model_path())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
