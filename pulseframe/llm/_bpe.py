"""Byte-level BPE with word ends over many words at once.

``WordBpe.ids`` gives the ids of the ``tokenizers`` library for a file whose
pre-tokenizer drops white space, so a text is the sequence of its blank-separated
units.  Units are cached in two bounded generations; new ones are merged
together with array operations: each round finds the lowest merge rank of
every word and applies it everywhere in that word.  Units with characters
beyond U+024F, or with a special string, go through the library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from . import _words

NONE = np.int32(1 << 30)
#: Parts units among 16-bit ids: no id has a high byte of 255, so it can't be met out of step.
PART = b"\xff\xff"
FAR = re.compile("[\u0250-\U0010ffff]")


def _alphabet() -> list[str]:
    """The public byte-to-character table of byte-level BPE: printable bytes stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + n)
            n += 1
    return [table[b] for b in range(256)]


class WordBpe:
    def __init__(self, path: str, cache: int = 250_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.special = spec["model"], tuple(x["content"].encode() for x in spec["added_tokens"])
        vocab = model["vocab"]
        if max(vocab.values()) >= 0xFF00:
            raise ValueError("ids must fit 16 bits")
        self.parts = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + r"|\n")
        self.byte = np.array([vocab[c] for c in _alphabet()], np.uint32)
        self.last = np.array([vocab[c + "</w>"] for c in _alphabet()], np.uint32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        key = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.uint32)  # by rank
        # An open table for the keys, so that most look-ups are one gather.
        self.bits = 20
        self.slot = np.full(1 << self.bits, -1, np.int32)
        home = self._home(self.key)
        self.slot[home] = np.arange(len(self.key))
        self.crowded = np.zeros(1 << self.bits, bool)
        twice = home[self.slot[home] != np.arange(len(self.key))]
        self.crowded[twice] = True
        self.cap, self.new, self.old = cache, {}, {}

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def ranks(self, key: np.ndarray) -> np.ndarray:
        home = self._home(key)
        at = self.slot[home]
        out = np.where((at >= 0) & (self.key[at] == key), self.rank[at], NONE)
        again = np.flatnonzero(self.crowded[home] & (out == NONE))
        if len(again):
            k = key[again]
            at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
            out[again] = np.where(self.key[at] == k, self.rank[at], NONE)
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 16 bits) of each piece."""
        if not pieces:  # units may consist of characters that the pre-tokenizer drops
            return []
        size = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.byte[data]
        end = np.cumsum(size) - 1
        sym[end] = self.last[data[end]]
        word = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
        done_sym, done_word = [], []
        while len(sym):
            rank = np.full(len(sym), NONE, np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside] = self.ranks((sym[inside] << np.uint32(16)) | sym[inside + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            each = np.repeat(best, np.diff(np.r_[first, len(sym)]))
            over = each == NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            hit = np.flatnonzero((rank == each) & ~over)
            if not len(hit):
                break
            # aaa: of touching hits every second one counts, from the left
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.flatnonzero(fresh)
            parity = (np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0
            hit = hit[parity]
            sym[hit] = self.into[rank[hit]]
            stay = ~over
            stay[hit + 1] = False
            sym, word = sym[stay], word[stay]
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        flat = np.concatenate(done_sym)[order].astype("<u2").tobytes()
        cuts = 2 * np.r_[0, np.cumsum(np.bincount(word, minlength=len(pieces)))]
        cuts = cuts.tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, units: list[bytes]) -> None:
        whole = b"\n".join(units)
        hard = [u for u in units if any(s in u for s in self.special)] if any(s in whole for s in self.special) else []
        if hard:
            units = list(set(units).difference(hard))
            whole = b"\n".join(units)
        text = whole.decode("utf-8", "replace").lower()
        if not text.isascii() and FAR.search(text):
            far = [i for i, t in enumerate(text.split("\n")) if FAR.search(t)]
            hard += [units[i] for i in far]
            units = list(set(units).difference(hard))
            text = b"\n".join(units).decode("utf-8", "replace").lower()
        if units:
            # One pass over all units: their pieces, with the line feeds that part the units.
            flat = self.parts.findall(text)
            pieces = set(flat).difference("\n")
            pieces = list(pieces)
            ids = dict(zip(pieces, self.merge([p.encode() for p in pieces]), strict=True))
            ids["\n"] = PART
            self.new.update(zip(units, b"".join(map(ids.__getitem__, flat)).split(PART), strict=True))
        if hard:
            for u, e in zip(hard, self.tokenizer.encode_batch_fast([u.decode("utf-8", "replace") for u in hard], add_special_tokens=False), strict=True):
                self.new[u] = np.array(e.ids, "<u2").tobytes()

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, one after another, and where each text's begin (and the end); null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(column, "") if column.null_count else column)
        units = split.flatten().dictionary_encode()  # a unit is looked up once a batch
        code = units.indices.to_numpy()
        data, at = _words.strings(units.dictionary)
        data, at = data.tobytes(), at.tolist()
        keys = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        found = list(map(self.new.get, keys))
        if None in found:
            missing = []
            for k, v in zip(keys, found, strict=True):
                if v is None:
                    if k in self.old:
                        self.new[k] = self.old[k]
                    else:
                        missing.append(k)
            if missing:
                self._learn(missing)
            found = list(map(self.new.__getitem__, keys))
        size = np.fromiter(map(len, found), np.int64, len(found)) >> 1
        begin = np.cumsum(size) - size
        each = size[code]
        ends = np.cumsum(each)
        flat = np.frombuffer(b"".join(found), "<u2")
        ids = flat[np.repeat(begin[code] - (ends - each), each) + np.arange(int(each.sum()))]
        if len(self.new) > self.cap:
            self.old, self.new = self.new, {}
        offsets = np.asarray(split.offsets)
        return ids, np.r_[0, ends][offsets - offsets[0]]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, little-endian, 16 bits each."""
        ids, cut = self.encode(pa.array(texts, pa.binary()).cast(pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
