"""Batch byte-pair encoding for a word-level BPE file of the `tokenizers` library.

Texts are split on white space, each distinct word is split into pre-tokens and
each distinct pre-token is encoded once, all pre-tokens of one length at a time.
Words outside the plain range (other scripts, combining marks, special tokens)
go through the library itself, so the ids are always the library's.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .ragged import positions, sums, utf8

#: Characters whose normalisation and classes need no library: printable ASCII and Latin letters that NFC leaves alone.
UNUSUAL = r"[^\x21-\x7E\x{A1}-\x{12F}\x{131}-\x{17E}]"
PRETOKEN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
#: Pre-tokens of more bytes than this go through the library.
LONGEST = 48
NONE = np.uint32(0xFFFFFFFF)


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [names[b] for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.uint32)
        self.last = np.array([vocab[s + end] for s in symbols], np.uint32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        self.merged = np.array([vocab[a + b] for a, b in pairs] + [0], np.uint32)
        self._build(keys)

    def _build(self, keys: np.ndarray) -> None:
        """An open-addressing table of the merge ranks."""
        bits = 19
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, NONE, np.uint32)
        self.ranks = np.full(1 << bits, NONE, np.uint32)
        self.probes = 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            probe = 1
            while self.keys[slot] != NONE:
                slot, probe = (slot + 1) & self.mask, probe + 1
            self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, probe)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left << np.uint32(16)) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != NONE))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != NONE)]
        return out

    def _merge(self, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows of symbols of one length; (row numbers, ids) of each final length."""
        rows, done = np.arange(len(s)), []
        if s.shape[1] == 1:
            return [(rows, s)]
        r = self.rank(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(s), -1)
        while True:
            at = r.argmin(axis=1)
            line = np.arange(len(s))
            best = r[line, at]
            over = best == NONE
            if over.any():
                done.append((rows[over], s[over]))
                s, r, rows, at, best = s[~over], r[~over], rows[~over], at[~over], best[~over]
                line = line[: len(s)]
            if not len(s):
                return done
            width = s.shape[1]
            keep = np.arange(width - 1)[None, :]
            s = np.take_along_axis(s, keep + (keep > at[:, None]), axis=1)
            s[line, at] = self.merged[best]
            if width == 2:
                done.append((rows, s))
                return done
            keep = keep[:, : width - 2]
            r = np.take_along_axis(r, keep + (keep >= at[:, None]), axis=1)
            left, right = at > 0, at < width - 2
            r[line[left], at[left] - 1] = self.rank(s[line[left], at[left] - 1], s[line[left], at[left]])
            r[line[right], at[right]] = self.rank(s[line[right], at[right]], s[line[right], at[right] + 1])

    def _library(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch(words, add_special_tokens=False)] if words else []
        counts = np.array([len(x) for x in ids], np.int64)
        return np.array([y for x in ids for y in x], np.uint32), counts

    def _pretokens(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, starts and counts of distinct pre-tokens."""
        raw, offsets = utf8(tokens)
        length = np.diff(offsets)
        counts, parts, owners = np.zeros(len(tokens), np.int64), [], []
        for n in np.unique(length):
            rows = np.flatnonzero(length == n)
            if n == 0:
                continue
            if n > LONGEST:
                ids, c = self._library(tokens.take(pa.array(rows)).to_pylist())
                counts[rows] = c
                parts.append(ids)
                owners.append(np.repeat(rows, c))
                continue
            letters = raw[offsets[rows][:, None] + np.arange(n)[None, :]]
            s = self.inner[letters]
            s[:, -1] = self.last[letters[:, -1]]
            for line, ids in self._merge(s):
                counts[rows[line]] = ids.shape[1]
                parts.append(ids.ravel())
                owners.append(np.repeat(rows[line], ids.shape[1]))
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.uint32)
        if parts:
            owner, ids = np.concatenate(owners), np.concatenate(parts)
            order = np.argsort(owner, kind="stable")
            flat[:] = ids[order]
        return flat, starts, counts

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, starts and counts of distinct words without white space."""
        odd = pc.or_(pc.match_substring_regex(words, UNUSUAL), pc.match_substring(words, "<|"))
        odd = np.asarray(odd.fill_null(False)).astype(bool)
        plain = np.flatnonzero(~odd)
        split = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(pc.utf8_lower(words.take(pa.array(plain))), PRETOKEN, r"\1 "), " "), " ")
        n = np.asarray(pc.list_value_length(split)).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        flat, starts, counts = self._pretokens(coded.dictionary)
        piece = np.asarray(coded.indices)
        per_piece = counts[piece]
        ids = flat[positions(starts[piece], per_piece)]
        word_counts = np.zeros(len(words), np.int64)
        word_counts[plain] = sums(per_piece, n)
        rows = np.flatnonzero(odd)
        extra, c = self._library(words.take(pa.array(rows)).to_pylist())
        word_counts[rows] = c
        starts = np.zeros(len(words), np.int64)
        starts[plain] = np.cumsum(word_counts[plain]) - word_counts[plain]
        starts[rows] = len(ids) + np.cumsum(c) - c
        return np.concatenate([ids, extra]), starts, word_counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the count of each; nulls are empty."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        per_text = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        flat, starts, counts = self.encode_words(coded.dictionary)
        word = np.asarray(coded.indices)
        per_word = counts[word]
        return flat[positions(starts[word], per_word)], sums(per_word, per_text)


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)
