"""SentencePiece encoding and decoding by vectorised merge rounds.

The model file is read once on the driver; tasks get its tables (their size is
that of the vocabulary).  A task cuts texts into words no piece can span, encodes
each distinct word once, all words together in flat symbol arrays, and keeps the
words of a few slices in a cache that is emptied when it is full.

Nulls count as empty texts; an empty text has the end id only.  Rows are handled
one by one, so repeated rows and ties cannot matter; an empty table gives an
empty table.  Other columns of the input are left out of the result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.shared import SLICE_BYTES, in_arrow, slices, take

MARK = "▁"
NONE = np.int32(2**31 - 1)
CACHED_WORDS = 300_000


@dataclass
class Vocabulary:
    """Tables of a BPE model with identity normalisation and a dummy prefix."""

    texts: list[bytes]  # what a piece stands for
    kinds: np.ndarray  # 0 ordinary, 1 byte, 2 control, 3 unknown
    leading: np.ndarray  # whether a piece starts with the mark
    symbols: dict[int, int]  # code point -> id
    keys: np.ndarray  # sorted pairs of ids that merge
    merged: np.ndarray  # into what
    ranks: np.ndarray  # and how early
    byte_ids: np.ndarray
    end: int
    unknown: int
    alone: str  # white space that is in no piece
    run: int  # longest piece of marks, 0 if marks follow no simple rule

    @property
    def size(self) -> int:
        return len(self.texts)


def load(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " x  ﬁ "
    if "".join(sp.encode(probe, out_type=str)) not in (f"{MARK}{probe}".replace(" ", MARK), f"{MARK}{MARK}x{MARK}{MARK}<0xEF><0xAC><0x81>{MARK}"):
        raise ValueError("only models with identity normalisation and a dummy prefix are supported")
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    kinds = np.array([1 if sp.is_byte(i) else 2 if sp.is_control(i) else 3 if sp.is_unknown(i) else 0 for i in range(n)], np.int8)
    ordinary = {p: i for i, p in enumerate(pieces) if not kinds[i]}
    single = {p: i for p, i in ordinary.items() if len(p) == 1}
    extra = sorted({c for p in ordinary for c in p} - single.keys())
    symbols = {ord(c): i for c, i in single.items()} | {ord(c): n + ord(c) for c in extra}
    of = ordinary | {c: n + ord(c) for c in extra}
    scores = {i: sp.get_score(i) for i in ordinary.values()}
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    rows = [
        (of[p[:k]], of[p[k:]], i, order[scores[i]])
        for p, i in ordinary.items()
        for k in range(1, len(p))
        if p[:k] in of and p[k:] in of
    ]
    table = np.array(rows, np.int64).reshape(-1, 4)
    keys = table[:, 0] << 32 | table[:, 1]
    at = np.argsort(keys)
    marks = [p for p in ordinary if len(p) > 1 and p == MARK * len(p)]
    apart = all(scores[ordinary[m]] < scores[i] for m in marks for p, i in ordinary.items() if len(p) > 1 and p not in marks)
    simple = apart and not any(p.count(MARK) > 1 for p in ordinary.keys() - set(marks))
    if any(MARK in p.lstrip(MARK) for p in ordinary):
        raise ValueError("a piece spans words")
    used = set("".join(ordinary))
    v = Vocabulary(
        texts=[b"" if kinds[i] == 2 else " ⁇ ".encode() if kinds[i] == 3 else bytes([int(p[3:5], 16)]) if kinds[i] == 1 else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)],
        kinds=kinds,
        leading=np.array([p.startswith(MARK) and not kinds[i] for i, p in enumerate(pieces)]),
        symbols=symbols,
        keys=keys[at],
        merged=table[at, 2].astype(np.int32),
        ranks=table[at, 3].astype(np.int32),
        byte_ids=np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32) if (kinds == 1).sum() == 256 else np.empty(0, np.int32),
        end=sp.eos_id(),
        unknown=sp.unk_id(),
        alone="".join(c for c in "\n\t\r" if c not in used),
        run=0,
    )
    if simple and marks:
        v.run = _closed_run(v, max(map(len, marks)))
    return v


def _closed_run(v: Vocabulary, longest: int) -> int:
    """``longest`` if every run of marks encodes as blocks of that length and the rest, else 0."""
    runs = [MARK * n for n in range(1, 4 * longest + 1)]
    ids, sizes = Encoder(v).merge(runs)
    parts = [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]
    block = parts[longest - 1]
    return longest if all(p == block * (n // longest) + parts[n % longest] for n, p in enumerate(parts)) else 0


class Encoder:
    """Encodes texts; lives in one task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.symbol = np.arange(v.size, v.size + 0x110000, dtype=np.int32)
        for point, i in v.symbols.items():
            self.symbol[point] = i
        rest = f"[^{MARK}{re.escape(v.alone)}]"
        runs = f"{MARK}{{{v.run}}}(?={MARK})|{MARK}{{1,{v.run}}}{rest}*" if v.run else f"{MARK}+{rest}*"
        self.words = re.compile(f"{runs}|{rest}+" + (f"|[{re.escape(v.alone)}]" if v.alone else ""))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, each with the end id, and where each text starts."""
        cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.forget()
        words = [w for one in cut for w in one]
        fresh = list(set(words).difference(self.known))
        if fresh:
            ids, lengths = self.merge(fresh)
            base = len(self.known)
            self.known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        slots = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        sizes = self.starts[slots + 1] - self.starts[slots]
        flat = self.ids[_spread(self.starts[slots], sizes)]
        per_text = np.bincount(np.repeat(np.arange(len(cut)), [len(c) for c in cut]), sizes, len(cut)).astype(np.int64)
        return np.insert(flat, np.cumsum(per_text), self.v.end).astype(np.int32), np.concatenate([[0], np.cumsum(per_text + 1)])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        hit = self.v.keys[at] == key
        return np.where(hit, self.v.ranks[at], NONE), self.v.merged[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and their number for each word.

        Each round finds the least rank of each word and merges its pairs of that
        rank from the left.  Where a merge opens a pair that must come first (its
        rank is not higher), only the leftmost pair of the word is merged.
        """
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        rank, into = self._pairs(sym, word)
        done_sym, done_word = [], []
        while sym.size:
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=sym.size)
            if (low == NONE).any():
                ended = np.repeat(low == NONE, size)
                done_sym.append(sym[ended])
                done_word.append(word[ended])
                left = ~ended
                sym, word, rank, into = sym[left], word[left], rank[left], into[left]
                size, low = size[low != NONE], low[low != NONE]
                if not sym.size:
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            at = self._apart(at)
            at = self._in_turn(at, sym, word, rank, into)
            sym[at] = into[at]
            keep = np.ones(sym.size, bool)
            keep[at + 1] = False
            changed = np.zeros(sym.size, bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            before = at[at > 1] - 2  # the left neighbour may itself have been merged into the place before
            changed[before] |= ~keep[before + 1]
            sym, word, rank, into, changed = sym[keep], word[keep], rank[keep], into[keep], changed[keep]
            again = np.flatnonzero(changed)
            rank[again] = NONE
            again = again[again + 1 < sym.size]
            again = again[word[again] == word[again + 1]]
            rank[again], into[again] = self._rank(sym[again], sym[again + 1])
        sym = np.concatenate(done_sym) if done_sym else np.empty(0, np.int32)
        word = np.concatenate(done_word) if done_word else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        return self._in_bytes(sym[order], word[order], len(words))

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(sym.size, NONE, np.int32), np.zeros(sym.size, np.int32)
        if sym.size > 1:
            r, m = self._rank(sym[:-1], sym[1:])
            rank[:-1], into[:-1] = np.where(word[:-1] == word[1:], r, NONE), m
        return rank, into

    @staticmethod
    def _apart(at: np.ndarray) -> np.ndarray:
        """Of places in a row, every other one from the left."""
        opens = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        within = np.arange(at.size) - np.repeat(opens, np.diff(opens, append=at.size))
        return at[within % 2 == 0]

    def _in_turn(self, at, sym, word, rank, into) -> np.ndarray:
        first = np.diff(word[at], prepend=-1) > 0
        if first.all():
            return at
        low, here = rank[at], np.zeros(sym.size, bool)
        here[at] = True
        has = at + 2 < sym.size
        has[has] = word[at[has] + 2] == word[at[has]]
        right = np.full(at.size, NONE, np.int32)
        right[has] = self._rank(into[at[has]], sym[at[has] + 2])[0]
        had = at > 0
        had[had] = word[at[had] - 1] == word[at[had]]
        back = np.flatnonzero(had)
        merged = (at[back] > 1) & here[np.maximum(at[back] - 2, 0)]
        before = np.where(merged, into[np.maximum(at[back] - 2, 0)], sym[at[back] - 1])
        left = np.full(at.size, NONE, np.int32)
        left[back] = self._rank(before, into[at[back]])[0]
        early = np.unique(word[at[(right <= low) | (left <= low)]])
        return at[first | ~np.isin(word[at], early)]

    def _in_bytes(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        strange = np.flatnonzero(sym >= self.v.size)
        if strange.size:
            if self.v.byte_ids.size:
                parts = [self.v.byte_ids[list(chr(c).encode())] for c in sym[strange] - self.v.size]
                size = np.ones(sym.size, np.int64)
                size[strange] = [len(p) for p in parts]
                at = np.concatenate([[0], np.cumsum(size)])
                sym, word, old = np.repeat(sym, size), np.repeat(word, size), strange
                sym[_spread(at[old], size[old])] = np.concatenate(parts)
            else:
                same = np.diff(word, prepend=-1) == 0
                after = np.zeros(sym.size, bool)
                after[1:] = (sym[1:] >= self.v.size) & (sym[:-1] >= self.v.size)
                sym = np.where(sym >= self.v.size, self.v.unknown, sym)[~(after & same)]
                word = word[~(after & same)]
        return sym.astype(np.int32), np.bincount(word, minlength=n)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of all places of the ranges that start at ``starts``."""
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.flat = np.frombuffer(b"".join(vocabulary.texts), np.uint8)
        self.sizes = np.array([len(t) for t in vocabulary.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of flat ids; text i takes ``ids[starts[i]:starts[i + 1]]``."""
        data = self.flat[_spread(self.starts[ids], self.sizes[ids])]
        at = np.concatenate([[0], np.cumsum(self.sizes[ids])])
        kinds = self.v.kinds[ids]
        out = []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            shown = np.flatnonzero(kinds[a:b] != 2)
            skip = int(shown.size > 0 and self.v.leading[ids[a + shown[0]]])
            try:
                out.append(data[at[a] + skip : at[b]].tobytes().decode())
            except UnicodeDecodeError:
                out.append(self._broken(ids[a:b], kinds[a:b])[skip:])
        return out

    def _broken(self, ids: np.ndarray, kinds: np.ndarray) -> str:
        """With byte pieces that are no UTF-8: each such byte becomes U+FFFD."""
        parts = np.split(ids, np.flatnonzero(np.diff(kinds == 1)) + 1)
        return "".join(_lenient(b"".join(self.v.texts[i] for i in p)) for p in parts)


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        at += n
    return "".join(out)


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int, end id last) of each row."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches):
        encoder = Encoder(vocabulary)
        for part in slices(batches, text, SLICE_BYTES // 2):
            ids, starts = encoder.encode([t or "" for t in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], [key, "ids"])

    return in_arrow(take(df, key, text), run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``ids`` and ``decoded`` (the text of the ids; null ids give an empty text)."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{ids}` array<int>, decoded string"

    def run(batches):
        decoder = Decoder(vocabulary)
        for part in slices(batches, ids, SLICE_BYTES // 2):
            lists = part.column(ids).fill_null([])
            starts = np.asarray(lists.offsets)
            texts = decoder.decode(np.asarray(lists.values)[starts[0] : starts[-1]], starts - starts[0])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], [key, ids, "decoded"])

    return in_arrow(take(df, key, ids), run, schema)


def digest(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the decoded text."""
    both = decode(encode(df, vocabulary), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
