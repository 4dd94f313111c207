"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A token sequence is the merge encoding of a text exactly when every two neighbours, put together and
merged again, come out as the same two tokens. So no merge queue runs over the text: at each position the
longest piece that an Aho-Corasick automaton finds there is tried, then the shorter ones; a piece is taken
if it is compatible with the one before. Where nothing fits, the position is flagged as failed, as no
encoding of the text passes through it, and the search steps back. Compatibility is decided by re-merging
the two tokens, once per pair.

Texts are cut before each run of U+2581 (which stands for a blank), which no piece of the model crosses;
the distinct units of a slice of texts are searched side by side in numpy, in runs of bounded size. Null and empty texts have no
tokens; every other text is encoded whole. Characters without a piece become byte pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeframe.llm.text import distinct, flat, lists, slices

BLANK = "\u2581"
KEPT_PAIRS = 1 << 20    # verdicts on token pairs kept per worker (9 MB); beyond it the table starts anew
RUN_CHARS = 1 << 17     # characters of units searched side by side; a longer unit stands alone
RUN_ITEMS = 1 << 18     # numbers put together at a time; a longer run stands alone

ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType()),
])


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + count] put one after another."""
    upto = np.cumsum(counts)
    begin = upto - counts
    out, at = np.empty(int(counts.sum()), flat.dtype), 0
    while at < len(counts):
        base = int(begin[at])
        end = max(at + 1, int(np.searchsorted(upto, base + RUN_ITEMS, "right")))
        out[base:upto[end - 1]] = flat[np.arange(base, upto[end - 1]) + np.repeat(starts[at:end] - begin[at:end], counts[at:end])]
        at = end
    return out


class PieceModel:
    """A BPE model file with byte fallback, blanks escaped, one blank put before each text, no other
    normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        vocab = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [vocab.id_to_piece(i) for i in range(vocab.get_piece_size())]
        self.size = len(self.pieces)
        is_byte = [vocab.is_byte(i) for i in range(self.size)]
        plain = [i for i in range(self.size)
                 if not (is_byte[i] or vocab.is_control(i) or vocab.is_unknown(i) or vocab.is_unused(i))]
        self.scores = {self.pieces[i]: vocab.get_score(i) for i in plain}
        if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.scores):
            raise ValueError("a piece crosses the start of a word or a line")
        # a piece that its own merges don't lead to never occurs
        self.ids = {self.pieces[i]: i for i in plain if len(self.merged(self.pieces[i])) == 1}
        # beyond the vocabulary, the number size + code stands for a character without a piece
        self.lengths = np.ones(self.size + 0x110000, np.int32)
        self.lengths[:self.size] = [len(p) for p in self.pieces]
        self.shorter = np.full(self.size + 0x110000, -1, np.int32)
        self.single = self.size + np.arange(0x110000, dtype=np.int32)
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
            else:
                self.matcher.add_word(piece, i)
                self.shorter[i] = next(
                    (self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), -1)
        self.matcher.make_automaton()
        self.byte_ids = np.zeros(256, np.int64)
        self.raw: list[bytes] = []
        for i, piece in enumerate(self.pieces):
            if is_byte[i]:
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            else:
                self.raw.append(b"" if vocab.is_control(i) else piece.replace(BLANK, " ").encode())
        self.raw_flat = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_counts = np.array([len(r) for r in self.raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_counts) - self.raw_counts
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for one or two tokens: best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours survives re-merging. Numbers beyond the vocabulary stand for
        characters without a piece, which merge with nothing."""
        out = np.ones(len(left), bool)
        both = np.flatnonzero((left < self.size) & (right < self.size))
        if not len(both):
            return out
        keys = left[both] << 32 | right[both]

        def find() -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
            return at, self.pair_keys[at] == keys if len(self.pair_keys) else np.zeros(len(keys), bool)

        at, known = find()
        if not known.all():
            if len(self.pair_keys) > KEPT_PAIRS:
                self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
                known[:] = False
            new = np.unique(keys[~known])
            verdicts = []
            for key in new.tolist():
                a, b = self.pieces[key >> 32], self.pieces[key & 0xFFFFFFFF]
                verdicts.append(self.merged(a + b) == [a, b])
            place = np.searchsorted(self.pair_keys, new)
            self.pair_keys = np.insert(self.pair_keys, place, new)
            self.pair_fits = np.insert(self.pair_fits, place, verdicts)
            at, known = find()
        out[both] = self.pair_fits[at]
        return out

    def units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every unit, one after another, and how many each has."""
        upto, at, parts = np.cumsum(np.fromiter(map(len, units), np.int64, len(units))), 0, []
        while at < len(units):
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + RUN_CHARS, "right")))
            parts.append(self.searched(units[at:end]))
            at = end
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([counts for _, counts in parts])

    def searched(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As units, of a run of them searched side by side."""
        joined = "\n".join(units) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, units), np.int64, len(units))
        end = np.cumsum(size + 1) - 1
        begin = end - size
        longest, lengths, shorter = self.single[chars], self.lengths, self.shorter
        hits = np.fromiter(chain.from_iterable(self.matcher.iter(joined)), np.int64)
        ends, found = hits[::2], hits[1::2]  # by end: of one start the longest comes last
        longest[ends + 1 - lengths[found]] = found
        failed = np.zeros(len(chars) + 1, bool)
        taken = np.full(len(chars) + 1, -1, np.int64)  # token that ends before a position
        pos, first, last = begin[size > 0], begin[size > 0], end[size > 0]
        token = longest[pos]
        while len(pos):
            none = token < 0
            if none.any():
                at = pos[none]
                if (at == first[none]).any():
                    raise ValueError("a text has no encoding")
                failed[at] = True
                back = taken[at]
                pos[none] = at - lengths[back]
                token[none] = shorter[back]
            some = np.flatnonzero(token >= 0)
            at, cand = pos[some], token[some]
            stop = at + lengths[cand]
            good = ~failed[stop]
            pair = np.flatnonzero(good & (at > first[some]))
            good[pair] = self.fits(taken[at[pair]], cand[pair])
            token[some[~good]] = shorter[cand[~good]]
            done = stop[good]
            taken[done] = cand[good]
            pos[some[good]] = done
            token[some[good]] = longest[done]
            live = pos < last
            if not live.all():
                pos, first, last, token = pos[live], first[live], last[live], token[live]
        ends = np.zeros(len(chars) + 1, bool)
        at, first = end[size > 0], begin[size > 0]
        while len(at):
            ends[at] = True
            at = at - lengths[taken[at]]
            live = at > first
            at, first = at[live], first[live]
        place = np.flatnonzero(ends)
        tokens = taken[place]
        owner = np.searchsorted(end, place)
        many = np.ones(len(tokens), np.int64)
        odd = np.flatnonzero(tokens >= self.size)
        if len(odd):  # byte pieces
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in (tokens[odd] - self.size).tolist()]
            many[odd] = [len(r) for r in raw]
            flat = np.repeat(tokens, many)
            fill = np.repeat(tokens >= self.size, many)
            flat[fill] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            flat = tokens
        return flat, np.bincount(owner, weights=many, minlength=len(units)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        mark, none = pa.scalar(BLANK, pa.large_string()), pa.scalar("", pa.large_string())
        data, off = flat(pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(
            mark, pc.replace_substring(texts, " ", BLANK), none)))
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        mark = np.frombuffer(BLANK.encode(), np.uint8)
        blank = np.zeros(len(data) + 3, bool)
        if len(data) >= 3:
            blank[:len(data) - 2] = (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
        cut = blank[:len(data)].copy()
        cut[3:] &= ~blank[:len(data) - 3]  # only the first blank of a run starts a unit
        cut[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        units, which = distinct(data, starts, ends)
        ids, counts = self.units(units)
        first = np.cumsum(counts) - counts
        per_unit = counts[which]
        upto = np.concatenate([[0], np.cumsum(per_unit)])
        return gather(ids, first[which], per_unit), np.diff(upto[np.searchsorted(starts, off)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of id sequences: pieces put together, the blank that encoding puts before a text removed,
        runs of byte pieces read as UTF-8 (what is not UTF-8 becomes U+FFFD)."""
        sizes = self.raw_counts[ids]
        raw = gather(self.raw_flat, self.raw_starts[ids], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        off = upto[np.concatenate([[0], np.cumsum(counts)])]
        plain = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(off), pa.py_buffer(raw)])
        try:
            texts = plain.cast(pa.large_string())
        except pa.ArrowInvalid:
            texts = pa.array([b.as_py().decode("utf-8", "replace") for b in plain], pa.large_string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model of a worker, read once."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def decode(ids: Column, path: str) -> Column:
    """Text of a column of ids; null ids give an empty text."""
    @F.arrow_udf(T.StringType())
    def run(rows: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return model(path).decode(rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts).cast(pa.string())

    return run(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with the columns ids and decoded (columns of these names are replaced). Results leave the worker
    slice by slice, so its memory follows the slice, not the batch."""
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in slices(batch):
                ids, counts = m.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, lists(ids, counts, pa.int32()), m.decode(ids, counts).cast(pa.string())],
                    names=[*part.schema.names, "ids", "decoded"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *ENCODED.fields]))
