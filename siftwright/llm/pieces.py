"""SentencePiece encoding and decoding over a lattice of the pieces in each word.

A text becomes words (a run of word marks and what follows it, which no piece crosses; where a vocabulary has pieces that do, the
whole text is one word). For each distinct word all substrings up to the longest piece's length are joined to the piece table
by equality; those found are the word's edges, and a fold over its edges gives its pieces:

* unigram models: Viterbi, the path with the largest sum of scores;
* BPE models: the best-scored edge that joins two neighbouring symbols is taken, the leftmost of equals, until none is
  left. (A Viterbi fold would give other pieces than the model's own merges.)

What no piece covers is spelled in byte pieces, or is the unknown piece in models without these. Words' pieces are kept in a
bounded memory per worker, so frequent words are looked up once. Texts never leave their rows, nothing is shuffled.

Models must use the identity normalisation; other settings raise an error. The piece table is read on the driver and sent with
the tasks (at most MAX_PIECES pieces).

Defined results: null texts have null ids, empty texts none. A word mark in a text decodes to a space, as the model's own
library does. Each row gives one row; an input column of a result's name is replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import arrow_map, named, slices, widened, without

MARK = "▁"
MAX_PIECES, KEPT_WORDS, FOLDED_WORDS = 1_000_000, 200_000, 20_000
# Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, UNUSED, BYTE = 1, 2, 4, 5, 6


@dataclass
class PieceTable:
    """Pieces with scores and ids; plain data."""

    kind: int
    prefix: bool
    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    unknown: int
    spelled: list[bytes]

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.scores), default=1)
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        alone = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in joined)  # control characters that no piece joins to others
        self.word = re.compile(r"(?s).+" if crossing else f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.lowest = min(self.scores.values(), default=0.0)

    def edges(self, word: str) -> dict[tuple[int, int], float]:
        """The substrings of a word that are pieces."""
        n, scores = len(word), self.scores
        return {(i, j): scores[s] for i in range(n) for j in range(i + 1, min(n, i + self.longest) + 1) if (s := word[i:j]) in scores}

    def cuts(self, word: str) -> list[tuple[int, int]]:
        return _merged(word, self) if self.kind == BPE else _viterbi(word, self.edges(word), self.lowest - 10.0)

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        for i, j in self.cuts(word):
            found = self.ids.get(word[i:j])
            if found is not None:
                out.append(found)
            elif self.bytes_:
                out += [self.bytes_[b] for b in word[i:j].encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out


def _viterbi(word: str, edges: dict[tuple[int, int], float], missing: float) -> list[tuple[int, int]]:
    n = len(word)
    by_end: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for (i, j), s in edges.items():
        by_end[j].append((i, s))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for j in range(1, n + 1):
        options = [(best[i][0] + s, i) for i, s in by_end[j]]
        if (j - 1, j) not in edges:
            options.append((best[j - 1][0] + missing, j - 1))
        best.append(max(options, key=lambda x: x[0]))
    out, j = [], n
    while j:
        out.append((best[j][1], j))
        j = best[j][1]
    return out[::-1]


def _merged(word: str, table: PieceTable) -> list[tuple[int, int]]:
    n, scores = len(word), table.scores
    edges = table.edges(word) if n <= 64 else None  # a long word's edges are looked up as they are needed
    end, start, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    queue: list[tuple[float, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            k = end[j]
            s = edges.get((i, k)) if edges is not None else scores.get(word[i:k]) if k - i <= table.longest else None
            if s is not None:
                heapq.heappush(queue, (-s, i, j, k))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while queue:
        _, i, j, k = heapq.heappop(queue)
        if not (alive[i] and j < n and alive[j] and after[i] == j and end[j] == k):
            continue
        alive[j] = False
        end[i], after[i] = k, after[j]
        if after[i] < n:
            start[after[i]] = i
        offer(i)
        if start[i] >= 0:
            offer(start[i])
    return [(i, end[i]) for i in range(n) if alive[i]]


def load(path: str) -> PieceTable:
    """The piece table of a model file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, spec = model.normalizer_spec, model.trainer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normalisation are supported")
    if spec.model_type not in (UNIGRAM, BPE) or any(p.type == USER for p in model.pieces):
        raise ValueError("only unigram and BPE models without user-defined symbols are supported")
    if len(model.pieces) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (NORMAL, UNUSED)}
    bytes_ = [i for i, p in enumerate(model.pieces) if p.type == BYTE]
    spelled = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == 3 else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode() for p in model.pieces]
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
    return PieceTable(spec.model_type, norm.add_dummy_prefix, {p: i for p, (i, _) in normal.items()}, {p: s for p, (_, s) in normal.items()}, bytes_, unknown, spelled)


class Lattice:
    """The folds of many words of a BPE model side by side, over arrays of their symbols.

    Symbols are pieces and the characters of pieces. Joining all splits of all pieces with the symbols gives the edges that
    two neighbouring symbols can have; a round takes the best (leftmost) edge of each word, until no word has one left.
    """

    NONE = np.int64(1) << 60

    def __init__(self, table: PieceTable) -> None:
        self.pieces = list(table.scores)
        names = self.pieces + sorted({c for p in self.pieces for c in p} - set(self.pieces))
        symbol = {p: i for i, p in enumerate(names)}
        self.ids = np.array([table.ids[p] for p in self.pieces] + [-1] * (len(names) - len(self.pieces)), np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted(set(table.scores.values()), reverse=True))}
        edges = [(symbol[p[:c]] << 32 | symbol[p[c:]], order[table.scores[p]] << 32 | symbol[p]) for p in self.pieces for c in range(1, len(p)) if p[:c] in symbol and p[c:] in symbol]
        keys, values = np.array(sorted(edges), np.int64).reshape(-1, 2).T
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self.probes = 0
        left = np.arange(len(keys))
        while len(left):  # open addressing, a probe at a time
            at = self._slot(keys[left], self.probes)
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.values[at[mine]] = values[left[mine]]
            left = left[~mine]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def edge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and symbol of the pieces that a and b make together, NONE where there is none."""
        keys = a.astype(np.int64) << 32 | b.astype(np.int64)
        out = np.full(len(keys), self.NONE)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        for probe in range(self.probes):
            at = self._slot(keys[left], probe)
            found = self.keys[at] == keys[left]
            out[left[found]] = self.values[at[found]]
            left = left[~found & (self.keys[at] != -1)]
            if not len(left):
                break
        return out

    def fold(self, words: list[str]) -> list[bytes | None]:
        """Each word's ids as bytes of int32; None where a symbol is no piece."""
        sizes = np.array([len(w) for w in words], np.int64)
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        best = np.full(len(sym), self.NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        best[inner] = self.edge(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(first, len(sym)))
            rank = best >> 32
            least = np.minimum.reduceat(rank, first)
            open_ = least < (self.NONE >> 32)
            if not open_.all():
                over = np.repeat(~open_, count)
                done.append((word[over], self.ids[sym[over]] if len(self.ids) else sym[over]))
                done[-1][1][sym[over] < 0] = -1
                word, sym, best, rank, least, count = word[~over], sym[~over], best[~over], rank[~over], least[open_], count[open_]
                if not len(sym):
                    break
                first = np.concatenate([[0], np.cumsum(count)[:-1]])
            at = np.minimum.reduceat(np.where(rank == np.repeat(least, count), np.arange(len(sym)), len(sym)), first)
            sym[at] = (best[at] & 0xFFFFFFFF).astype(np.int32)
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # places after one symbol of each word before has gone
            word, sym, best = word[keep], sym[keep], best[keep]
            best[now] = self.NONE
            for i in (now - 1, now):
                i = i[(i >= 0) & (i < len(sym) - 1)]
                i = i[word[i] == word[i + 1]]
                best[i] = self.edge(sym[i], sym[i + 1])
        if not done:
            return [b""] * len(words)
        owner, ids = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        owner, ids = owner[order], ids[order]
        ends = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        bad = set(owner[ids < 0].tolist())
        data = ids.astype(np.int32).tobytes()
        return [None if i in bad else data[4 * ends[i] : 4 * ends[i + 1]] for i in range(len(words))]


class Encoder(dict):
    """Words' piece ids as bytes of int32, filled as words are met; forgets all when it is full."""

    def __init__(self, table: PieceTable) -> None:
        super().__init__()
        self.table = table
        self.lattice = Lattice(table) if table.kind == BPE and table.scores else None

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Ids of texts; their short words that are not known yet are folded all together."""
        split = [self.words(t) if t else [] for t in texts]
        if self.lattice is not None:
            if len(self) >= KEPT_WORDS:
                self.clear()
            new = [w for w in set(chain.from_iterable(split)).difference(self) if len(w) <= 64]
            for i in range(0, len(new), FOLDED_WORDS):
                part = new[i : i + FOLDED_WORDS]
                self.update((w, x) for w, x in zip(part, self.lattice.fold(part)) if x is not None)
        return [None if t is None else np.frombuffer(b"".join(map(self.__getitem__, x)), np.int32) for t, x in zip(texts, split)]

    def words(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        return self.table.word.findall(MARK + text if self.table.prefix else text)

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.table.encode_word(word), np.int32).tobytes()
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


def decode(ids: list[int], table: PieceTable) -> str:
    text = b"".join(map(table.spelled.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if table.prefix and text.startswith(" ") else text


def _encoded(table: PieceTable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(table)
    for batch in batches:
        for start, end in slices(batch.column("text")):
            part = batch.slice(start, end - start)
            texts = part.column("text").to_pylist()
            ids = encoder.encode_all(texts)
            restored = [None if t is None else decode(x.tolist(), table) == t for t, x in zip(texts, ids)]
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)]))
            missing = pa.array([*(x is None for x in ids), False]) if any(x is None for x in ids) else None
            offsets = pa.array(ends) if missing is None else pa.array(ends, mask=missing.to_numpy(zero_copy_only=False))
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(offsets, values), pa.array([None if x is None else len(x) for x in ids], pa.int64()), pa.array(restored, pa.bool_())], [*names, "token_ids", "n_tokens", "restored"])


def with_tokens(docs: DataFrame, table: PieceTable) -> DataFrame:
    """``docs`` (a text column and others) with ``token_ids``, ``n_tokens`` and ``restored``: whether decoding gives the text."""
    docs = without(named(docs, "text"), "token_ids", "n_tokens", "restored")
    return arrow_map(docs, lambda b: _encoded(table, b), widened(docs, "token_ids array<int>, n_tokens long, restored boolean"))


def _decoded(table: PieceTable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else decode(x, table) for x in batch.column("token_ids").to_pylist()]
        keep = [c for c in batch.schema.names if c != "token_ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])


def decoded(rows: DataFrame, table: PieceTable) -> DataFrame:
    """``rows`` with ``text`` in place of ``token_ids``."""
    rows = without(named(rows, "token_ids"), "text")
    return arrow_map(rows, lambda b: _decoded(table, b), widened(rows.drop("token_ids"), "text string"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
