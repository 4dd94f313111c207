"""Token counts: rank-synchronous merging of ragged arrays.

Pre-tokens of many texts that a worker has not met are laid out as one flat array of symbols with their
lengths. In each round every sequence looks up the rank of its neighbouring pairs and applies all
occurrences of its own lowest-ranked pair at once; sequences without a known pair are done. What survives
is the token count. Counts are kept in a bounded table per worker.

Null and empty texts have 0 tokens. The file's added tokens count as one token wherever they occur, as the
library does by default. Nothing is truncated.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.text import distinct, flat, slices

#: fixed: the pattern of byte-level BPE
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KEPT = 1_000_000
FLAT = 1 << 20  # symbols merged at a time
SLICE_BYTES = 8 << 20
_BYTES = np.arange(256)
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: bytes that cannot end a white-space character, so that a part may end after them
ENDS_PART = ~(SPACE | ((_BYTES >= 0x1C) & (_BYTES <= 0x1F)) | ((_BYTES >= 0x80) & (_BYTES <= 0x8A))
              | np.isin(_BYTES, [0x9F, 0xA0, 0xA8, 0xA9, 0xAF]))


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeTable:
    """Ranks of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre["type"] != "ByteLevel" \
                or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["model"].get("ignore_merges"):
            raise ValueError("only byte-level BPE without normaliser is known")
        vocab = spec["model"]["vocab"]
        letters = _byte_letters()
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        keys, news = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[a] << 32 | vocab[b])
            news.append(vocab[a + b])
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.news = keys[order], order, np.array(news, np.int64)[order]
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.counts: dict[str, int] = {}

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of symbols left of each sequence; lengths are 1 at least."""
        out = lengths.copy()
        live = np.flatnonzero(lengths > 1)
        keep = np.repeat(lengths > 1, lengths)
        symbols, lengths = symbols[keep], lengths[live]
        none = len(self.keys)
        while len(live):
            first = np.cumsum(lengths) - lengths
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], none)
            rank = np.append(rank, none)
            rank[first[1:] - 1] = none  # a pair doesn't cross sequences
            rank[-1] = none
            lowest = np.minimum.reduceat(rank, first)
            hit = (rank == np.repeat(lowest, lengths)) & (rank < none)
            # in a run of overlapping hits (one symbol repeated) every second one counts
            place = np.flatnonzero(hit)
            head = np.append(True, np.diff(place) > 1)
            run_start = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))] if len(place) else place
            place = place[(place - run_start) % 2 == 0]
            if len(place):
                symbols = symbols.copy()
                symbols[place] = self.news[at[place]]
                gone = np.zeros(len(symbols), bool)
                gone[place + 1] = True
                lengths = lengths - np.add.reduceat(gone, first, dtype=np.int64)
                symbols = symbols[~gone]
            out[live] = lengths
            more = (lowest < none) & (lengths > 1)
            symbols, live, lengths = symbols[np.repeat(more, lengths)], live[more], lengths[more]
        return out

    def learn(self, tokens: list[str]) -> dict[str, int]:
        """Counts of pre-tokens that are not in the table."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.array([len(r) for r in raw], np.int64)
        fresh: dict[str, int] = {}
        begin, upto = 0, np.cumsum(sizes)
        while begin < len(raw):
            base = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, base + FLAT, "right")))
            flat = self.of_byte[np.frombuffer(b"".join(raw[begin:end]), np.uint8)]
            fresh.update(zip(tokens[begin:end], self.merge(flat, sizes[begin:end]).tolist(), strict=True))
            begin = end
        return fresh

    def count_parts(self, parts: list[str]) -> list[int]:
        """Token counts of texts; each may hold several pre-tokens."""
        split = [PRE_TOKENS.findall(p) for p in parts]
        unknown = list({p for tokens in split for p in tokens if p not in self.counts})
        fresh = self.learn(unknown)
        if len(self.counts) + len(fresh) > KEPT:
            known = {p: self.counts[p] for tokens in split for p in tokens if p in self.counts} | fresh
            self.counts = {}
        else:
            self.counts.update(fresh)
            known = self.counts
        return [sum([known[p] for p in tokens]) for tokens in split]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Token counts of whole texts. A text is cut where a run of white space begins, which no
        pre-token crosses, and the distinct parts are counted once."""
        raw = texts.to_pylist()
        special = np.zeros(len(raw), np.int64)
        owner = np.arange(len(raw))
        if self.added is not None:
            found = [k for k, t in enumerate(raw) if t and self.added.search(t)]
            if found:  # such texts fall into the parts between the added tokens
                special[found] = [len(self.added.findall(raw[k])) for k in found]
                pieces = [self.added.split(t) if special[k] else [t] for k, t in enumerate(raw)]
                owner = np.repeat(owner, [len(p) for p in pieces])
                texts = pa.array([p for own in pieces for p in own], pa.string())
        data, off = flat(texts)
        if not len(data):
            return special
        cut = np.zeros(len(data), bool)
        cut[1:] = SPACE[data[1:]] & ENDS_PART[data[:-1]]
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        parts, which = distinct(data, starts, np.append(starts[1:], len(data)))
        each = np.array(self.count_parts(parts), np.int64)[which]
        upto = np.concatenate([[0], np.cumsum(each)])
        per_piece = np.diff(upto[np.searchsorted(starts, off)])
        return special + np.bincount(owner, weights=per_piece, minlength=len(raw)).astype(np.int64)


_tables: dict[str, MergeTable] = {}


def table(path: str) -> MergeTable:
    if path not in _tables:
        _tables[path] = MergeTable(path)
    return _tables[path]


def count_tokens(text: Column, path: str) -> Column:
    """Number of tokens of a text column, as a long."""
    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        merges, out = table(path), []
        for part in slices(pa.record_batch([texts], names=["text"]), size=SLICE_BYTES):
            out.append(pa.array(merges.count(part.column(0)), pa.int64()))
        return pa.concat_arrays(out) if out else pa.array([], pa.int64())

    return run(text)


def with_token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit; columns of these names are replaced."""
    own = ("n_bytes", "n_tokens", "over_limit")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in own]
    return docs.select(
        *rest, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        count_tokens(F.col("text"), path).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
