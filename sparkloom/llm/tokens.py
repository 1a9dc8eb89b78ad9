"""Exact, cached encoding of whole texts with a public byte-level BPE file.

A byte-level BPE of this family never merges across the boundary in front of a
space or line end that is followed by a letter, digit or ASCII punctuation, so a
text can be cut there and each cut encoded on its own.  Natural text repeats its
cuts, hence a bounded cache per Python worker replaces most calls of the
tokenizer.

A block of texts is cut, hashed and looked up by array operations: the cache is
a sorted array of 64-bit hashes with a second hash of 32 bits that tells
collisions apart and the place of the cut's ids in one pool.  A full cache keeps
what was met again since it was last full.  Cuts that are not there yet are
encoded by the tokenizers library, many in one call.  A cut that is a run of
letters, with or without a mark after it, is one piece of the tokenizer's
pattern (two with the mark), so these are given to the library's BPE directly,
parted by a delimiter; all others go through the whole tokenizer.
``tests/llm/test_tokens.py`` compares the ids with plain ``Tokenizer.encode``.
"""

from __future__ import annotations

import os
import string
from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_128_digest

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Cuts and ids that a worker's cache holds at most, between blocks.
CACHE_CUTS, CACHE_IDS = 1_500_000, 10_000_000
BLOCK_BYTES = 1_000_000
JOINED_CUTS = 20_000
_HASHED = 64
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

_encoders: dict[str, Encoder] = {}


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str = TOKENIZER_FILE) -> Encoder:
    """The worker's encoder for ``name``, made on first use."""
    if name not in _encoders:
        _encoders[name] = Encoder(tokenizer_path(name))
    return _encoders[name]


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary spells each byte: printable
    Latin-1 spells itself, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _starts() -> tuple[np.ndarray, np.ndarray]:
    """Whether an ASCII byte, and a character below U+0250, may follow a cut."""
    letters = np.array([chr(c).isalnum() for c in range(0x250)])
    ascii_ = np.zeros(256, dtype=bool)
    ascii_[:128] = letters[:128]
    ascii_[[ord(c) for c in string.punctuation]] = True
    return ascii_, letters


_ASCII_STARTS, _LETTER_STARTS = _starts()
_ALPHABET = np.array([chr(c).isalpha() for c in range(0x280)]) & (np.arange(0x280) < 0x250)
_ASCII_ALPHABET = np.append(_ALPHABET[:128], np.zeros(128, bool))
_MARKS = np.isin(np.arange(256), list(b",.;:!?"))


class Encoder:
    """Whole text to its ids, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cuts: int = CACHE_CUTS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        #: The same BPE over what stands between line ends.
        self._pieces = Tokenizer(self._tokenizer.model)
        self._pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        letters = _byte_letters()
        #: 0xFF, which UTF-8 never holds, becomes the delimiter.
        self._spelled = letters | {0xFF: "\n"}
        self._limit = cuts
        #: Special tokens are found before any cut, so texts that spell one aren't cut.
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab()
        #: Bytes of each id: a byte-level vocabulary spells a byte as a character.
        self._bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self._bytes[list(vocabulary.values())] = list(map(len, vocabulary))
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._checks = np.zeros(0, np.uint32)
        self._at = np.zeros(0, np.uint32)
        self._n = np.zeros(0, np.uint32)
        self._met = np.zeros(0, bool)
        self._pool = np.zeros(0, np.uint16 if len(self._bytes) <= 1 << 16 else np.uint32)

    def _keep_met(self) -> None:
        """Drop the cuts that were not met again; all, if that frees too little."""
        if 2 * self._met.sum() > self._limit or 2 * self._n[self._met].sum() > CACHE_IDS:
            self._clear()
            return
        at, n = self._at[self._met].astype(np.int64), self._n[self._met].astype(np.int64)
        end = np.cumsum(n)
        self._pool = self._pool[np.repeat(at - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        self._keys, self._checks = self._keys[self._met], self._checks[self._met]
        self._at, self._n = (end - n).astype(np.uint32), n.astype(np.uint32)
        self._met = np.zeros(len(n), bool)

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        done = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in done]

    def _parted(self, ids: np.ndarray, sizes: list[int]) -> np.ndarray | None:
        """How many of the ids belong to each of consecutive texts of ``sizes``
        bytes; none if an id reaches across two texts."""
        ends, after = np.cumsum(sizes), np.cumsum(self._bytes[ids])
        stops = np.searchsorted(after, ends) + 1
        if not len(ids) or stops[-1] != len(ids) or not np.array_equal(after[stops - 1], ends):
            return None
        return np.diff(stops, prepend=0)

    def _plain(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of cuts by the whole tokenizer: many as one text,
        as ids never reach across cuts that start with a space or line end."""
        found, counts = [], []
        for i in range(0, len(cuts), JOINED_CUTS):
            part = cuts[i : i + JOINED_CUTS]
            ids = self._raw([b"".join(part).decode()])[0]
            n = self._parted(ids, list(map(len, part)))
            if n is None:
                ids, n = self._alone(part)
            found.append(ids)
            counts.append(n)
        return np.concatenate(found), np.concatenate(counts)

    def _alone(self, cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of cuts by the whole tokenizer, each on its own."""
        each = self._raw([c.decode() for c in cuts])
        return np.concatenate(each), np.array(list(map(len, each)))

    def _words(self, cuts: list[bytes], pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of cuts given as pieces of the pattern, delimited."""
        found, counts = [], []
        for i in range(0, len(cuts), JOINED_CUTS):
            text = b"\xff".join(pieces[i : i + JOINED_CUTS]).decode("latin-1").translate(self._spelled)
            ids = np.array(self._pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            n = self._parted(ids, list(map(len, cuts[i : i + JOINED_CUTS])))
            if n is None:
                return self._alone(cuts)
            found.append(ids)
            counts.append(n)
        return np.concatenate(found), np.concatenate(counts)

    def _learn(self, joined: bytes, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place, count) of new cuts; ``first`` marks those that begin a text."""
        ends = starts + lengths
        marked = _MARKS[raw[ends - 1]]
        core_start, core_end = starts + (raw[starts] == 32), ends - marked
        others = np.concatenate([[0], np.cumsum(~_letters(raw))])
        word = (core_end > core_start) & (others[np.maximum(core_end, core_start)] == others[core_start])
        kinds = [np.flatnonzero(x) for x in (word & ~marked, word & marked, ~word & ~first, ~word & first)]
        ends, starts, core_end = ends.tolist(), starts.tolist(), core_end.tolist()
        cuts = [[joined[starts[k] : ends[k]] for k in kind.tolist()] for kind in kinds]
        pieces = cuts[0] + [joined[starts[k] : core_end[k]] + b"\xff" + joined[core_end[k] : ends[k]] for k in kinds[1].tolist()]
        ids, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for some, encode in ((cuts[0] + cuts[1], lambda x: self._words(x, pieces)), (cuts[2], self._plain), (cuts[3], self._alone)):
            if some:
                found, n = encode(some)
                ids.append(found)
                counts.append(n)
        order, counted = np.concatenate(kinds), np.concatenate(counts)
        at, n = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        n[order], at[order] = counted, np.cumsum(counted) - counted
        return np.concatenate(ids), at, n

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null counts as empty."""
        return next(self.encode_many([text]))

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each whole text, in order; about ``BLOCK_BYTES`` at a time."""
        block, size = [], 0
        for text in texts:
            block.append((text or "").encode("utf-8", "replace"))
            size += len(block[-1])
            if size >= BLOCK_BYTES:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, texts: list[bytes]) -> Iterator[bytes]:
        whole = {i: self._raw([t.decode()])[0].tobytes() for i, t in enumerate(texts) if any(x in t for x in self._special)}
        cuttable = [b"" if i in whole else t for i, t in enumerate(texts)]
        sizes = np.array(list(map(len, cuttable)), dtype=np.int64)
        if not sizes.any():
            yield from (whole.get(i, b"") for i in range(len(texts)))
            return
        ids, ends = self._ids(b"\0".join([*cuttable, bytes(2 * _HASHED)]), sizes)
        raw, at = ids.tobytes(), 0
        for i, end in enumerate((4 * ends).tolist()):
            yield whole[i] if i in whole else raw[at:end]
            at = end

    def _ids(self, joined: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that stand one zero byte apart, and where each's ids end."""
        text_end = np.cumsum(sizes + 1) - 1
        text_start = text_end - sizes
        raw = np.frombuffer(joined, np.uint8)
        starts, lengths, firsts = _cuts(raw, text_start, text_end)
        key, check = _hashes(joined, starts, lengths)
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        head = order[new]
        found, at, n = self._looked_up(joined, raw, ranked[new], check[head], starts[head], lengths[head], firsts[head])
        if not np.array_equal(check[head][group], check):  # two cuts with one key
            each = self._raw([joined[a:b].decode() for a, b in zip(text_start.tolist(), text_end.tolist(), strict=True)])
            return np.concatenate(each), np.cumsum(list(map(len, each)))
        n = n[group]
        end = np.cumsum(n)
        ids = found[np.repeat(at[group] - (end - n), n) + np.arange(end[-1])].astype("<u4")
        cuts_before = np.searchsorted(starts, text_end)  # a text's cuts start before its end
        return ids, np.concatenate([[0], end])[cuts_before]

    def _looked_up(self, joined: bytes, raw: np.ndarray, keys: np.ndarray, checks: np.ndarray, starts: np.ndarray, lengths: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool, place, count) of the ids of different cuts, in order of keys;
        what the cache lacks is learned."""
        if len(self._keys) > self._limit or len(self._pool) > CACHE_IDS:
            self._keep_met()
        place = np.searchsorted(self._keys, keys)
        near = np.minimum(place, max(len(self._keys) - 1, 0))
        known = (self._keys[near] == keys) & (self._checks[near] == checks) if len(self._keys) else np.zeros(len(keys), bool)
        at, n = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at[known], n[known] = self._at[near[known]], self._n[near[known]]
        self._met[near[known]] = True
        lacks = np.flatnonzero(~known)
        if len(lacks):
            ids, own, count = self._learn(joined, raw, starts[lacks], lengths[lacks], firsts[lacks])
            at[lacks], n[lacks] = own + len(self._pool), count
            self._pool = np.concatenate([self._pool, ids.astype(self._pool.dtype)])
            into = place[lacks]
            self._keys = np.insert(self._keys, into, keys[lacks])
            self._checks = np.insert(self._checks, into, checks[lacks])
            self._at = np.insert(self._at, into, at[lacks])
            self._n = np.insert(self._n, into, count)
            self._met = np.insert(self._met, into, False)
        return self._pool, at, n


def _cuts(raw: np.ndarray, text_start: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, begins a text) of the cuts of texts in ``raw``."""
    space = np.flatnonzero((raw == 32) | (raw == 10))
    after = raw[space + 1]
    fits = _ASCII_STARTS[after]
    wide = np.flatnonzero((after >= 0xC3) & (after < 0xCA))
    code = (after[wide].astype(np.int64) - 0xC0) * 64 + (raw[space[wide] + 2] & 0x3F)
    fits[wide] = (code < len(_LETTER_STARTS)) & _LETTER_STARTS[np.minimum(code, len(_LETTER_STARTS) - 1)]
    marks = np.zeros(len(raw), bool)
    marks[space[fits]] = True
    own = text_start[text_end > text_start]
    inner = marks[own]
    marks[own] = True
    starts = np.flatnonzero(marks)
    firsts = np.zeros(len(starts), bool)
    firsts[np.searchsorted(starts, own[~inner])] = True
    text = np.searchsorted(text_start, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(raw)), text_end[text])
    return starts, ends - starts, firsts


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes are those of ASCII letters and of letters in U+00C0 to U+024F."""
    out = _ASCII_ALPHABET[raw]
    wide = np.flatnonzero((raw >= 0xC3) & (raw < 0xCA))
    wide = wide[_ALPHABET[(raw[wide].astype(np.int64) - 0xC0) * 64 + (raw[wide + 1] & 0x3F)]]
    out[wide] = out[wide + 1] = True
    return out


def _hashes(joined: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each cut, eight bytes a step; long ones by xxh3."""
    words = np.ndarray((len(joined) - 7,), "<u8", joined, 0, (1,))
    key = lengths.astype(np.uint64) * _MIX[1]
    check = lengths.astype(np.uint64) * _MIX[0]
    left = np.arange(len(starts))
    for at in range(0, _HASHED, 8):
        if at:
            left = left[lengths[left] > at]
        if not len(left):
            break
        rest = np.minimum(lengths[left] - at, 8).astype(np.uint64)
        part = words[starts[left] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8)))
        for h, mix in zip((key, check), _MIX, strict=True):
            x = (h[left] ^ part) * mix
            h[left] = (x ^ (x >> np.uint64(32))) * mix
    for i in np.flatnonzero(lengths > _HASHED):
        digest = xxh3_128_digest(joined[starts[i] : starts[i] + lengths[i]])
        key[i], check[i] = np.frombuffer(digest, "<u8")
    return key ^ (key >> np.uint64(29)), (check >> np.uint64(32)).astype(np.uint32)
