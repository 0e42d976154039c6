"""Token ids by the tokenizers library, with a bounded memory of the pieces between spaces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np

from crossweave.llm.shared import span_hashes

#: Pieces that a worker remembers for good, the first that it meets (about 35 bytes each); others only while it encodes a batch.
REMEMBERED = 500_000
#: New pieces are encoded so many to a call.
JOINED = 20
#: Characters of texts that are looked up at a time.
JOINED_CHARS = 1_000_000

#: White space besides the space and the newline.
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x00]")
_DOUBLE = ("  ", "\n\n", " \n", "\n ", "<|")


def plain(text: str) -> bool:
    """All white space is single spaces and newlines; other texts are encoded whole."""
    return not any(x in text for x in _DOUBLE) and not _OTHER_SPACE.search(text)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memory:
    """The ids of pieces by two hashes of a piece (96 bits in all), in arrays that grow to REMEMBERED pieces."""

    def __init__(self) -> None:
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begins = np.zeros((1 << 14) + 1, np.int64)
        self.size = 0
        self._resize(15)

    def _resize(self, bits: int) -> None:
        """Slots for half as many pieces; the slot of a piece is the first free one from that of its hash on."""
        old = getattr(self, "entry", np.zeros(0, np.int32))
        there = np.nonzero(old)[0]
        key, check, entry = (x[there] for x in (self.key, self.check, old)) if len(old) else (np.zeros(0, np.uint64), np.zeros(0, np.uint32), old)
        self.mask = (1 << bits) - 1
        self.key, self.check, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.int32)
        self._place(key, check, entry)

    def _place(self, key: np.ndarray, check: np.ndarray, entry: np.ndarray) -> None:
        slot = (key & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = left[self.entry[slot[left]] == 0]
            self.entry[slot[free]] = entry[free]  # of several pieces for one slot the last gets it
            got = free[self.entry[slot[free]] == entry[free]]
            self.key[slot[got]], self.check[slot[got]] = key[got], check[got]
            left = left[self.entry[slot[left]] != entry[left]]
            slot[left] = slot[left] + 1 & self.mask

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Each piece's number, -1 for a new one."""
        found = np.full(len(key), -1, np.int64)
        slot = (key & np.uint64(self.mask)).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            entry = self.entry[at]
            hit = (self.key[at] == key[left]) & (self.check[at] == check[left]) & (entry != 0)
            found[left[hit]] = entry[hit] - 1
            left = left[~hit & (entry != 0)]
            slot[left] = slot[left] + 1 & self.mask
        return found

    def add(self, key: np.ndarray, check: np.ndarray, begins: np.ndarray, ids: np.ndarray) -> None:
        """The first of these new pieces for which there is room; begins has their places in ids, and the end."""
        n = min(len(key), REMEMBERED - self.size)
        if n <= 0:
            return
        new, end = self.size + n, int(self.begins[self.size])
        ids = ids[: begins[n]]
        if end + len(ids) > len(self.ids):
            self.ids = grown(self.ids, max(2 * len(self.ids), end + len(ids)))
        if new >= len(self.begins):
            self.begins = grown(self.begins, max(2 * len(self.begins), new + 1))
        self.ids[end : end + len(ids)] = ids
        self.begins[self.size + 1 : new + 1] = end + begins[1 : n + 1]
        if 2 * new > self.mask:
            self._resize(int(2 * new).bit_length())
        self._place(key[:n], check[:n], np.arange(self.size + 1, new + 1, dtype=np.int32))
        self.size = new


def grown(x: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, x.dtype)
    out[: len(x)] = x
    return out


def copied(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs of the given beginnings and lengths, one run after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - lengths), lengths)


class Encoder:
    """The ids of whole texts, the same as of tokenizer.encode(text, add_special_tokens=False).

    A byte-level BPE of this kind splits text before its merges, and a space in front of a word always
    begins a new part. A text whose white space is single spaces and newlines is thus the sequence of
    its pieces, each encoded once and remembered. A batch's pieces are looked up all at once, by
    hashes, in arrays."""

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = Memory()
        names = self.tokenizer.get_vocab()
        self.byte_lengths = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.byte_lengths[i] = len(name)  # each character of a byte-level name is one byte

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of each of these pieces."""
        known: dict[str, bytes] = {}
        spaced = [p for p in new if p[0] == " " and len(p) > 1]
        bare = [p for p in new if p[0] != " " and p != "\n"]
        for found, glue in ((spaced, ""), (bare, "\n")):
            for k in range(0, len(found), 20_000):
                self._joined(found[k : k + 20_000], glue, known)
        return [known[p] if p in known else self._whole(p) for p in new]

    def _joined(self, found: list[str], glue: str, known: dict[str, bytes]) -> None:
        """Pieces that follow each other in one text keep their own ids; byte positions tell whose an id is."""
        texts = ["".join(p + glue for p in found[k : k + JOINED]) for k in range(0, len(found), JOINED)]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.fromiter((i for e in encoded for i in e.ids), np.uint32)
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.byte_lengths[ids])])
        lengths = np.array([len(p.encode()) for p in found], np.int64)
        ends = np.cumsum(lengths + len(glue)) - len(glue)
        first, last = np.searchsorted(at, ends - lengths), np.searchsorted(at, ends)
        exact = (at[np.minimum(first, len(at) - 1)] == ends - lengths) & (at[np.minimum(last, len(at) - 1)] == ends)
        raw = ids.tobytes()
        for p, a, b, ok in zip(found, (first * 4).tolist(), (last * 4).tolist(), exact.tolist(), strict=True):
            if ok:
                known[p] = raw[a:b]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; nothing for null."""
        easy = [k for k, t in enumerate(texts) if t and plain(t)]
        out = [self._whole(t) if t and not plain(t) else b"" for t in texts] if len(easy) < sum(map(bool, texts)) else [b""] * len(texts)
        at = 0
        while at < len(easy):  # so many at a time that the arrays stay small
            size, to = 0, at
            while to < len(easy) and size < JOINED_CHARS:
                size += len(texts[easy[to]])
                to += 1
            for k, raw in zip(easy[at:to], self._pieces([texts[k].encode() for k in easy[at:to]]), strict=True):
                out[k] = raw
            at = to
        return out

    def _pieces(self, texts: list[bytes]) -> Iterator[bytes]:
        whole = b"".join(texts)
        data = np.frombuffer(whole, np.uint8)
        heads = np.cumsum([0, *map(len, texts)])
        # a piece begins at a text's beginning, at a space, at a newline, and after one
        begins = (data == 0x20) | (data == 0x0A)
        begins[1:] |= data[:-1] == 0x0A
        begins[heads[:-1]] = True
        first = np.nonzero(begins)[0]
        key, check = span_hashes(data, first, seeds=(2, 3))
        check = (check >> np.uint64(32)).astype(np.uint32)
        memory = self.memory
        piece = memory.find(key, check)
        ids, limits = memory.ids, memory.begins
        missing = np.nonzero(piece < 0)[0]
        if len(missing):
            order = np.lexsort((check[missing], key[missing]))
            k, c = key[missing][order], check[missing][order]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            spots = missing[order[new]]
            ends = np.append(first[1:], len(data))
            learned = self._learn([whole[a:b].decode() for a, b in zip(first[spots].tolist(), ends[spots].tolist(), strict=True)])
            own_ids = np.frombuffer(b"".join(learned), "<u4")
            own = np.cumsum([0, *map(len, learned)]) // 4
            number = np.empty(len(missing), np.int64)
            number[order] = np.cumsum(new) - 1
            piece[missing] = memory.size + number
            size = int(limits[memory.size])
            ids, limits = np.concatenate([ids[:size], own_ids]), np.concatenate([limits[: memory.size], size + own])
            memory.add(k[new], c[new], own, own_ids)
        lengths = limits[piece + 1] - limits[piece]
        raw = memoryview(ids[copied(limits[piece], lengths)].astype("<u4").tobytes())
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[np.searchsorted(first, heads)] * 4
        for a, b in zip(done[:-1].tolist(), done[1:].tolist(), strict=True):
            yield bytes(raw[a:b])


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
