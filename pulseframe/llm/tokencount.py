"""Token counts (operator 2).

Counts are those of the ``tokenizers`` library for a byte-level BPE file.  Two
exact devices keep that affordable:

* Stable units.  The byte-level pre-tokenizer scans from left to right and
  never looks back, so a piece begins wherever a single space stands between
  two characters that aren't white space, and likewise before and after a
  single line feed.  A text is the sum of its units between such places, and a
  unit's count is kept in a bounded two-generation cache.
* Overlap resynchronisation.  Documents of over ``huge`` characters are
  encoded in overlapping chunks with offsets.  Two chunks are spliced where
  both begin a token and the place is stable in the sense above; if the overlap
  has no such place, it is doubled, at last up to the end of the document.

Memory: one Arrow slice, one chunk and the cache.  No shuffle: each document
is counted where it is read.  Null text counts as empty; further columns pass
through (``n_bytes``, ``n_tokens``, ``over_limit`` replace columns of those
names); rows are never merged, so repeated rows and ids are kept. An empty table
gives an empty one; no order is asked of the rows, so there are no ties.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import _store, _words

_ODD = re.compile(r"[^\S \n]")
_STABLE = re.compile(r"(?<=\S)(?= \S)")


class Counter:
    def __init__(self, path: str, huge: int = 1 << 16, chunk: int = 1 << 15, overlap: int = 1 << 8, cache: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        pre = spec.get("pre_tokenizer") or {}
        bare = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        #: whether the argument above holds: special strings with white space, or that swallow it, would break it
        self.proven = bare and not any(re.search(r"\s", s) for s in self.special) and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec["added_tokens"])
        self.huge, self.chunk, self.overlap, self.cap = huge, chunk, max(overlap, 4 * max(map(len, self.special), default=1)), cache
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.line = self.whole("\n")

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def units(self, text: str) -> tuple[list[str], int]:
        """The text's units, and the tokens of the line feeds between them."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1].isspace() or text[-1:].isspace() or _ODD.search(text):
            return _STABLE.split(text), 0
        return text.replace(" ", "\n ").split("\n"), text.count("\n") * self.line

    def batch(self, texts: list[str]) -> list[int]:
        out, todo = [0] * len(texts), []
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.proven:
                out[i] = self.whole(t)
            elif len(t) > self.huge:
                out[i] = self.spliced(t)
            else:
                u, out[i] = self.units(t)
                todo.append((i, u))
        missing = set().union(*(u for _, u in todo)).difference(self.new)
        for k in [k for k in missing if k in self.old]:
            self.new[k] = self.old[k]
            missing.discard(k)
        if missing:
            keys = list(missing)
            self.new.update(zip(keys, map(len, self.tokenizer.encode_batch_fast(keys, add_special_tokens=False)), strict=True))
        get = self.new.__getitem__
        for i, u in todo:
            out[i] += sum(map(get, u))
        if len(self.new) > self.cap:
            self.old, self.new = self.new, {}
        return out

    def spliced(self, text: str) -> int:
        """Overlapping chunks, each encoded with offsets; every token is counted in one of them."""
        total, start, lower = 0, 0, 0  # the chunk's first character; tokens before ``lower`` are counted already
        while True:
            overlap, end = self.overlap, min(start + self.chunk, len(text))
            ours = self.starts(text, start, end)
            while end < len(text):
                after = max(end - overlap, start + 1)
                theirs = self.starts(text, after, min(after + self.chunk, len(text)))
                cut = self.common(text, ours, theirs, max(after, lower) + 1, end - self.overlap // 4)
                if cut is not None:
                    break
                overlap *= 2  # widen on both sides
                end = min(end + overlap, len(text))
                ours = self.starts(text, start, end)
            if end >= len(text):
                return total + len(ours) - bisect_left(ours, lower)
            total += bisect_left(ours, cut) - bisect_left(ours, lower)
            start, lower = after, cut

    def starts(self, text: str, a: int, b: int) -> list[int]:
        return [a + x for x, _ in self.tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    def common(self, text: str, ours: list[int], theirs: list[int], lo: int, hi: int) -> int | None:
        both = set(ours[bisect_left(ours, lo) : bisect_left(ours, hi)]).intersection(theirs)
        for x in sorted(both, reverse=True):
            if text[x] == " " and not text[x - 1].isspace() and not text[x + 1].isspace():
                return x
        return None


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; ``tokenizer`` is the path of a .json file on every node."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ship(docs.sparkSession)
    tokenizer = str(tokenizer)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    schema = docs.withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches):
        counter = Counter(tokenizer, **how)
        for b in _words.slices(batches, text_col, 1 << 20):
            texts = pc.fill_null(b.column(b.schema.get_field_index(text_col)), "").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(counter.batch(texts), pa.int64())], names=[*b.schema.names, "n_tokens"])

    out = docs.mapInArrow(run, schema)
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    return out.withColumns({"n_bytes": size, "over_limit": F.col("n_tokens") > limit})


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
