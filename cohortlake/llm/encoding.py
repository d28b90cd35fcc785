"""Ids of whole texts by a byte-level BPE vocabulary of the tokenizers library, each distinct piece encoded once."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a Python worker remembers; those seen first, mostly the frequent ones, outlast the others.
KNOWN = 400_000
#: Ids that they may have together; long runs of signs are the reason for a bound of its own.
KNOWN_IDS = 8 * KNOWN
#: Pieces that are numbered at a time.
BLOCK = 1_000_000

# Letters, numbers and white space below U+0250.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
#: Kinds of characters below U+0250, and of the bytes of a text: what stands between texts, letters, numbers, other signs, white space.
_NONE, _LETTER, _NUMBER, _SIGN, _SPACE = range(5)
_KINDS = np.full(0x250, _SIGN, np.uint8)
for _kind, _class in ((_LETTER, _LETTERS), (_NUMBER, _NUMBERS), (_SPACE, _SPACES)):
    _KINDS[[c for c in range(len(_KINDS)) if re.match(f"[{_class}]", chr(c))]] = _kind
#: Stands between texts: no byte of UTF-8.
GAP = b"\xff"
_BYTES = np.full(256, _SIGN, np.uint8)
_BYTES[:128], _BYTES[GAP[0]] = _KINDS[:128], _NONE
#: Characters above U+024F that are neither letters, numbers nor white space: dashes, quotes, bullets, the euro sign.
_OTHER = re.compile("[^\u0000-ɏ‐-‧‰-⁞€]")


def _kinds(data: np.ndarray) -> np.ndarray:
    """The kind of every byte; bytes of one character have one kind."""
    kind = _BYTES[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # U+0080 to U+024F; longer characters are signs
    kind[lead] = kind[lead + 1] = _KINDS[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    return kind


def piece_starts(data: np.ndarray) -> np.ndarray:
    """First bytes of all pieces of ``data``: texts of known characters in UTF-8, with ``GAP`` before, between and after them.

    The split of byte-level vocabularies: ``'s|'t|'re|'ve|'m|'ll|'d| ?letters+| ?numbers+| ?signs+|spaces+(?!not a space)|spaces+``.
    A gap is a piece of its own.
    """
    kind = _kinds(data)
    first = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    cut = kind == _NONE
    cut[first] = True
    # the last white space before anything else: a blank goes with what follows, another one is a piece of its own
    first = first[(kind[first - 1] == _SPACE) & (kind[first] != _NONE)]
    cut[first - 1 - (data[first - 1] >= 0x80)] = True
    cut[first[data[first - 1] == 0x20]] = False
    # endings behind an apostrophe that begins a piece
    at = np.flatnonzero(data == 0x27)
    at = at[(kind[at - 1] != _SIGN) & (data[at - 1] != 0x20) & (kind[at + 1] == _LETTER)]
    one, two = data[at + 1], data[at + 2]
    short = at[np.isin(one, np.frombuffer(b"stmd", np.uint8))]
    long = at[(np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
    cut[short + 1] = cut[long + 1] = False
    cut[short + 2] = cut[long + 3] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts, as unsigned 32-bit integers.

    A text whose characters are all of known class is split as the vocabulary's own pre-tokenizer splits it.
    Distinct pieces go to tokenizers once and are looked up from then on, since no merge crosses a piece.
    A text with any other character goes to tokenizers whole.  Which way a text takes follows from its
    characters alone, and both give the ids that tokenizers gives; the tests compare them.
    Special-token strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        #: Pieces remembered; piece i has ids[edges[i]:edges[i + 1]].
        self.known = pa.array([GAP], pa.large_binary())
        self.edges, self.ids = np.zeros(2, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of texts that are not split here."""
        found = self.own.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _numbers(self, data: np.ndarray) -> np.ndarray:
        """The numbers of all pieces; a new piece gets the next number."""
        edges = np.append(piece_starts(data), len(data))
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data)])
        out = np.empty(len(pieces), np.int64)
        for low in range(0, len(pieces), BLOCK):
            block = pieces.slice(low, BLOCK)
            found = pc.fill_null(pc.index_in(block, self.known), -1).to_numpy()
            fresh = np.flatnonzero(found < 0)
            new = block.take(pa.array(fresh)).dictionary_encode()
            own = out[low : low + BLOCK]
            own[:] = found
            own[fresh] = new.indices.to_numpy() + np.int64(len(self.known))
            self.known = pa.concat_arrays([self.known, new.dictionary])
        return out

    def _learn(self) -> None:
        """Get the ids of all pieces that were numbered since the last time."""
        fresh = self.known.slice(len(self.edges) - 1).cast(pa.large_string()).to_pylist()
        if not fresh:
            return
        found = self.own.encode(fresh, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(fresh))
        self.ids = np.concatenate([self.ids, np.array(found.ids, np.uint32)])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(counts)])

    def _forget(self) -> None:
        if len(self.known) > KNOWN or len(self.ids) > KNOWN_IDS:
            keep = min(KNOWN // 2, int(np.searchsorted(self.edges, KNOWN_IDS // 2, "right")) - 1)
            self.known = self.known.take(pa.array(np.arange(keep)))
            self.edges, self.ids = self.edges[: keep + 1].copy(), self.ids[: self.edges[keep]].copy()

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of every text, in order."""
        odd = [i for i, t in enumerate(texts) if _OTHER.search(t)]
        done: list = [None] * len(texts)
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            done[i] = ids
        rest = [i for i in range(len(texts)) if done[i] is None]
        own = self._numbers(np.frombuffer(GAP + b"".join(texts[i].encode() + GAP for i in rest), np.uint8))
        self._learn()
        first = self.edges[own]
        count = self.edges[own + 1] - first
        ends = np.cumsum(count)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends + count, count)]
        bounds = ends[own == 0]  # gaps have no ids
        for i, low, high in zip(rest, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            done[i] = ids[low:high]
        self._forget()
        return done


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary, kept from task to task by a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
