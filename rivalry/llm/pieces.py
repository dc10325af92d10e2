"""SentencePiece encoding and decoding (byte-pair models with byte fallback).

Encoding is by merge rounds over flat numpy arrays that hold the symbols of
many words one after the other: a round finds the best-ranked pair of every
word (a segmented minimum), merges all its occurrences in the word at once,
leftmost first where they overlap, closes the gaps, looks up only the pairs
that changed, and puts words without a pair aside; it ends when none is left.
The result is that of the library, which merges one pair at a time, best score
first, leftmost among equals:

* no merge crosses a place where no piece of the vocabulary has the two
  characters next to each other, so texts are cut there and the parts do not
  touch each other;
* where a merge would give a pair that ranks before the round's own, only the
  leftmost occurrence is merged in that round;
* pieces of equal score (runs of spaces in the public model) and parts of more
  than ``LONG`` symbols go through a queue of pairs, one merge at a time: a
  round per distinct pair would cost the square of their length.

Words seen before come from a bounded memory of the Python worker, so the
rounds run over a batch's new words only.

The model file is a parameter and is read where the task runs.

Cases: a NULL text is empty and has the begin and end ids alone; texts of any
length are encoded whole; ids play no part; an empty table gives an empty
result; other columns pass through (an input column named like the new one
gives way).
"""

from __future__ import annotations

import heapq
import re
import sys
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

NAME = "piece_bpe_32k.model"
SPACE = "▁"
NONE = np.int32(2 ** 31 - 1)     # rank of a pair that is no piece
LONG = 4096                      # symbols of a part that rounds take
WORDS_KEPT = 200_000             # words a Python worker remembers, about
WORD_KEPT = 64                   # characters of the longest of them
STEP = 1 << 20                   # characters split into words at a time
ROUNDS = 1 << 18                 # characters of new words in one array
_WIDE = 1 << 22                  # above all piece ids and code points


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path(NAME)


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        kinds, normal = proto.ModelProto.SentencePiece, {}
        spec, trained = model.normalizer_spec, model.trainer_spec
        if (trained.model_type != trained.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces
                or not spec.escape_whitespaces or not spec.add_dummy_prefix or trained.treat_whitespace_as_suffix):
            raise ValueError("only byte-pair models with identity normalisation and a leading space are supported")
        self.size = len(model.pieces)
        self.begin, self.end, self.unknown = trained.bos_id, trained.eos_id, trained.unk_id
        self.byte_id, self.plain, self.kind = {}, [], []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                normal[p.piece] = i
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("a piece reaches over a space")
                self.plain.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value] = i
                self.plain.append(bytes([value]))
            elif p.type in (kinds.CONTROL, kinds.UNKNOWN):
                self.plain.append(b"" if p.type == kinds.CONTROL else trained.unk_surface.encode())
            else:
                raise ValueError("user-defined and unused pieces are not supported")
            self.kind.append(p.type)
        self.BYTE = kinds.BYTE
        self.controls = {i for i, k in enumerate(self.kind) if k == kinds.CONTROL}
        self.spaced = [p.piece.startswith(SPACE) and p.type == kinds.NORMAL for p in model.pieces]

        # ranks: equal scores share one
        scores = sorted({model.pieces[i].score for i in normal.values()}, reverse=True)
        place = {s: r for r, s in enumerate(scores)}
        self.rank_of = np.full(self.size, NONE, np.int32)
        for i in normal.values():
            self.rank_of[i] = place[model.pieces[i].score]
        self.tied = np.bincount(self.rank_of[list(normal.values())], minlength=len(scores)) > 1

        self.char = np.arange(0x110000, dtype=np.int32) + self.size       # beyond the ids: no piece
        beside, pairs = set(), {}
        for text, i in normal.items():
            if len(text) == 1:
                self.char[ord(text)] = i
            for a, b in zip(text, text[1:]):
                beside.add(ord(a) * _WIDE + ord(b))
            for k in range(1, len(text)):
                x, y = normal.get(text[:k]), normal.get(text[k:])
                if x is not None and y is not None:
                    pairs[x * _WIDE + y] = i
        self.pairs = pairs
        self.beside = np.array(sorted(beside), np.int64)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_key.tolist()], np.int32)

        alone = "".join(c for c in "\n\t\r" if c not in set("".join(normal)))
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]+" if alone else "")).findall
        self.memory: dict[str, bytes] = {}
        self.ends = tuple(np.array([x], "<u4").tobytes() for x in (self.begin, self.end))

    # ---- encoding --------------------------------------------------------

    def _merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, rank) of pairs of symbols; rank ``NONE`` where they are no piece."""
        key = left * _WIDE + right
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        hit = self.pair_key[at] == key
        piece = np.where(hit, self.pair_piece[at], -1)
        return piece, np.where(hit, self.rank_of[piece], NONE)

    def _queue(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(place, symbol) left of a part, one merge at a time."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                piece = self.pairs.get(symbols[i] * _WIDE + symbols[j])
                if piece is not None:
                    heapq.heappush(heap, (int(self.rank_of[piece]), i, symbols[i], j, symbols[j], piece))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, x, j, y, piece = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and after[i] == j and symbols[i] == x and symbols[j] == y):
                continue
            symbols[i], alive[j] = piece, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [(i, symbols[i]) for i in range(n) if alive[i]]

    def encode_words(self, words: Sequence[str]) -> list[bytes]:
        """Ids of escaped words as little-endian unsigned 32-bit bytes."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        if not len(code):
            return [b""] * len(words)
        ends = np.cumsum([len(w) for w in words])
        cut = ~self._in(self.beside, code[:-1] * _WIDE + code[1:])
        cut[ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(code))] - 1] = True
        seg = np.concatenate(([0], np.cumsum(cut)))
        sym, pos = self.char[code].astype(np.int64), np.arange(len(code))
        out_pos, out_sym = [], []

        def aside(rows: np.ndarray) -> None:
            """Parts whose rows are marked leave the rounds through the queue."""
            at = np.flatnonzero(rows)
            for part in np.split(at, np.flatnonzero(np.diff(seg[at])) + 1) if len(at) else ():
                left = self._queue(sym[part].tolist())
                out_pos.append(pos[part[[i for i, _ in left]]])
                out_sym.append(np.array([s for _, s in left], np.int64))

        long = np.bincount(seg)[seg] > LONG
        if long.any():
            aside(long)
            sym, pos, seg = sym[~long], pos[~long], seg[~long]
        piece, rank = self._pairs(sym, seg)
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            sizes = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            done = np.repeat(best == NONE, sizes)
            tied = np.repeat((best != NONE) & self.tied[np.where(best == NONE, 0, best)], sizes)
            if tied.any():
                aside(tied)
            if done.any() or tied.any():                   # compaction: only parts with a pair go on
                out_pos.append(pos[done])
                out_sym.append(sym[done])
                stay = ~(done | tied)
                sym, pos, seg, piece, rank = sym[stay], pos[stay], seg[stay], piece[stay], rank[stay]
                keep = (best != NONE) & ~self.tied[np.where(best == NONE, 0, best)]
                best, sizes = best[keep], sizes[keep]
                if not len(sym):
                    break
                first = np.cumsum(sizes) - sizes
            want = rank == np.repeat(best, sizes)
            # every other one of pairs that overlap, from the left
            at = np.flatnonzero(want)
            new = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            at = self._safe(at, sym, seg, piece, rank)
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            sym[at] = piece[at]
            fresh = np.zeros(len(sym), bool)               # pairs that changed: the merged symbol with its neighbours
            fresh[at] = True
            stay = ~gone
            sym, pos, seg, piece, rank, fresh = sym[stay], pos[stay], seg[stay], piece[stay], rank[stay], fresh[stay]
            look = fresh.copy()
            look[:-1] |= fresh[1:]
            self._refresh(np.flatnonzero(look), sym, seg, piece, rank)
        where, what = np.concatenate(out_pos), np.concatenate(out_sym)
        order = np.argsort(where, kind="stable")
        return self._spelled(where[order], what[order], ends)

    @staticmethod
    def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(sorted_keys):
            return np.zeros(len(keys), bool)
        at = np.searchsorted(sorted_keys, keys)
        at[at == len(sorted_keys)] = 0
        return sorted_keys[at] == keys

    def _pairs(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NONE, np.int32)
        self._refresh(np.arange(len(sym)), sym, seg, piece, rank)
        return piece, rank

    def _refresh(self, at, sym, seg, piece, rank) -> None:
        """Look the pairs that start at ``at`` up again."""
        rank[at] = NONE
        at = at[at < len(sym) - 1]
        at = at[seg[at] == seg[at + 1]]
        piece[at], rank[at] = self._merged(sym[at], sym[at + 1])

    def _safe(self, at, sym, seg, piece, rank) -> np.ndarray:
        """The merges ``at`` that one round may do: all of a part, or its
        first one where a merge but the last gives a pair that goes first."""
        own = seg[at]
        last = np.concatenate((own[1:] != own[:-1], [True]))
        if last.all():
            return at
        made, n = piece[at].astype(np.int64), len(sym)
        check = np.flatnonzero(~last)
        bad = np.zeros(len(at), bool)
        i = at[check]
        right = i + 2                                       # not merged yet when this one is
        ok = (right < n) & (seg[np.minimum(right, n - 1)] == seg[i])
        _, r = self._merged(made[check[ok]], sym[right[ok]])
        bad[check[ok]] |= r < rank[i[ok]]
        left = i - 1
        ok = (left >= 0) & (seg[np.maximum(left, 0)] == seg[i])
        before = np.where((check > 0) & (at[check - 1] == i - 2), made[check - 1], sym[np.maximum(left, 0)])
        _, r = self._merged(before[ok], made[check[ok]])
        bad[check[ok]] |= r < rank[i[ok]]
        if not bad.any():
            return at
        lone = np.isin(own, own[bad])
        leads = np.concatenate(([True], own[1:] != own[:-1]))
        return at[~lone | leads]

    def _spelled(self, where: np.ndarray, what: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Ids by word; a character without a piece becomes its bytes."""
        strange = np.flatnonzero(what >= self.size)
        if len(strange):
            spelled = [[self.byte_id.get(b, self.unknown) for b in chr(c).encode("utf-8", "surrogatepass")]
                       if self.byte_id else [self.unknown] for c in (what[strange] - self.size).tolist()]
            times = np.ones(len(what), np.int64)
            times[strange] = [len(s) for s in spelled]
            ids = np.repeat(what, times)
            ids[np.repeat(what >= self.size, times)] = [x for s in spelled for x in s]
            where = np.repeat(where, times)
        else:
            ids = what
        data, bounds = ids.astype("<u4").tobytes(), (4 * np.searchsorted(where, ends)).tolist()
        return [data[a:b] for a, b in zip([0, *bounds], bounds)]

    def encode(self, texts: Iterable[str]) -> Iterator[list[bytes]]:
        """Ids of whole texts with begin and end ids, as little-endian
        unsigned 32-bit bytes, some texts at a time."""
        split, size = [], 0
        for t in texts:
            split.append(self.words(SPACE + t.replace(" ", SPACE)) if t else [])
            size += len(t)
            if size >= STEP:
                yield self._joined(split)
                split, size = [], 0
        if split:
            yield self._joined(split)

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        words, memory = set().union(*split), self.memory
        new = [w for w in words if w not in memory]
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and (to == at or size + len(new[to]) <= ROUNDS):
                size += len(new[to])
                to += 1
            memory.update(zip(new[at:to], self.encode_words(new[at:to])))
            at = to
        a, b = self.ends
        out = [b"".join((a, *map(memory.__getitem__, own), b)) for own in split]
        if len(memory) > WORDS_KEPT:       # the words of this step stay
            self.memory = {w: memory[w] for w in words if len(w) <= WORD_KEPT}
        else:
            for w in new:
                if len(w) > WORD_KEPT:
                    del memory[w]
        return out

    # ---- decoding --------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids."""
        n = np.frombuffer(ids, "<u4").tolist()
        a, b = 0, len(n)
        while a < b and n[a] in self.controls:
            a += 1
        while a < b and n[b - 1] in self.controls:
            b -= 1
        n = n[a:b]
        parts = [self.plain[i] for i in n]
        if parts and self.spaced[n[0]]:
            parts[0] = parts[0][1:]
        if self.controls.isdisjoint(n):    # one in between ends a run of bytes
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""                 # broken byte runs: one mark for each byte that is no character
        for i, part in zip(n, parts):
            if self.kind[i] == self.BYTE:
                run += part
                continue
            out.append(_mended(run))
            run = b""
            out.append(part.decode())
        return "".join([*out, _mended(run)])


def _mended(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        for k in (1, 2, 3, 4):
            try:
                out.append(data[i:i + k].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k = 1
        i += k
    return "".join(out)


def pieces(path: str) -> Pieces:
    """One encoder for each Python worker and model file."""
    held = sys.modules.setdefault("_rivalry_llm_pieces", type(sys)("_rivalry_llm_pieces")).__dict__
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def encode(docs: DataFrame, text: str = "text", out: str = "ids", model: str | None = None) -> DataFrame:
    """``docs`` plus ``out``: the ids of every whole text with begin and end
    ids, little-endian unsigned 32-bit numbers in a binary."""
    path = model_path(model)

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pieces(path)
        for texts in batches:
            made = [pa.array(part, pa.binary()) for part in own.encode(t.as_py() or "" for t in texts)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.binary())

    return unpacked(packed(docs, _ids=ids(F.col(text).cast("string"))), docs.columns, F.col("_ids").alias(out))


def decode(frame: DataFrame, ids: str = "ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``frame`` plus ``out``: the text of the ids (NULL for NULL)."""
    path = model_path(model)

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pieces(path)
        for found in batches:
            made = [pa.array([own.decode(x.as_py()) if x.is_valid else None for x in found.slice(i, 500)], pa.string())
                    for i in range(0, len(found), 500)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.string())

    return unpacked(packed(frame, _decoded=text(F.col(ids))), frame.columns, F.col("_decoded").alias(out))
