"""SentencePiece encoding and decoding by suffix-array matching.

The distinct segments of a batch of texts (a segment begins with its word-begin
signs, and no piece reaches over its start) are concatenated and indexed with a
suffix array; every piece of the vocabulary is binary-searched in it, which gives
all its occurrences as a range; the occurrences are edges between positions, and
placed by position they are relaxed from left to right, all segments side by side.

The model is a BPE one, so the relaxation doesn't add up scores: from a position it
goes on along the longest edge that may follow the one that led there, and comes back
for a shorter one if that leads nowhere. A sequence of pieces is the BPE encoding of
a text exactly if each piece by itself and each two that are next to each other
encode to themselves; each prefix has one such sequence, so that each position is
tried once.
"""

from __future__ import annotations

import functools
import heapq
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

SPACE = "▁"
#: Segments whose ids a task keeps; when there are more, only those met again stay.
CACHE_SEGMENTS = 80_000
#: Pairs of pieces that a worker keeps, each at a place of its own: a power of two.
CACHE_PAIRS = 1 << 20
#: Characters of new segments that are indexed at once, if no one segment is longer.
INDEX_CHARS = 1 << 18
#: Bytes of text in which segments are told apart at once.
SLICE_BYTES = 2 << 20
#: So few segments are gone on with one by one.
FEW = 48
#: Characters of such a segment for which pairs of pieces are looked at together.
AHEAD = 1 << 10


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, and how each piece comes about."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        kinds = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.out: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score = [sp.get_score(i) for i in range(n)]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.out.append(bytes([value]))
                continue
            self.out.append(b"" if kinds[i] else piece.replace(SPACE, " ").encode())
            if not kinds[i]:
                self.ids[piece] = i
        halves = {p: self.halves(p) for p in self.ids}
        #: pieces that encode to themselves; no others are ever given
        self.pieces = sorted(p for p in self.ids if halves[p])
        self.longest = max(map(len, self.pieces))
        number = {p: i for i, p in enumerate(self.pieces)}
        single = np.array([len(p) == 1 for p in self.pieces])
        #: order in which pieces are merged; single characters are there from the start
        self.rank = np.where(single, -1, np.unique([-self.score[self.ids[p]] for p in self.pieces], return_inverse=True)[1])
        self.left = np.array([number.get(halves[p][0], i) for i, p in enumerate(self.pieces)])
        self.right = np.array([number.get(halves[p][1], i) for i, p in enumerate(self.pieces)])
        joined = [(number[p[:k]] * len(self.pieces) + number[p[k:]], r) for p, r in zip(self.pieces, self.rank.tolist()) for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        pairs = np.array(sorted(joined), np.int64).reshape(-1, 2)
        #: all pairs of pieces that are a piece together, and that one's rank
        self.pair, self.pair_rank = pairs[:, 0].copy(), pairs[:, 1].copy()
        self.asked = np.full(CACHE_PAIRS, -1, np.int64)  # pair and answer, at a place by the pair's hash

    def merge(self, text: str) -> tuple[list[str], tuple[str, str]]:
        """The BPE encoding of a short text, and the last two to be merged: the best-scored neighbours become one, the leftmost first, until none can."""
        part = list(text)
        nxt, prev = [*range(1, len(part)), -1], list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []
        last = (text, text)

        def offer(i: int) -> None:
            j = nxt[i]
            if j != -1 and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, part[i] + part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if not part[i] or j == -1 or part[i] + part[j] != both:
                continue
            last = (part[i], part[j])
            part[i], part[j] = both, ""
            nxt[i] = nxt[j]
            if nxt[j] != -1:
                prev[nxt[j]] = i
            if prev[i] != -1:
                offer(prev[i])
            offer(i)
        return [p for p in part if p], last

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of which ``piece`` is made last, itself twice for a character; none if it doesn't encode to itself."""
        parts, last = self.merge(piece)
        return last if parts == [piece] else None

    def may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each ``piece`` may come after ``before`` (numbers in ``pieces``; -1: nothing that it could merge with).

        The merges that made the two are undone from the last on. If at some time
        what touches could have become one before the merge that was undone last,
        the two would not have come about.
        """
        ok = before < 0
        key = before * len(self.pieces) + piece
        at = (key * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> 32 & (CACHE_PAIRS - 1)
        kept = self.asked[at]
        hit = kept >> 1 == key
        ok |= hit & (kept & 1 == 1)
        todo = np.flatnonzero(~hit & (before >= 0))
        if len(todo):
            new, back = np.unique(key[todo], return_inverse=True)
            got = self.undo(new // len(self.pieces), new % len(self.pieces))
            ok[todo] = got[back]
            self.asked[at[todo]] = key[todo] << 1 | got[back]
        return ok

    def undo(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            key = a * len(self.pieces) + b
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            bad = (self.pair[at] == key) & (self.pair_rank[at] < limit)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb  # of equal ones the left one was merged first
            go = ~bad & ((ra >= 0) | (rb >= 0))
            limit = np.where(first, ra, rb + 1)[go]
            a, b, live = np.where(first, self.right[a], a)[go], np.where(first, b, self.left[b])[go], live[go]
        return ok

    def spell(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")]


class SuffixArray:
    """Positions of ``codes`` in the order of their suffixes' first ``depth`` codes at least.

    Ranks of runs of as many codes as fit a number are doubled in width until they
    reach ``depth``; the distinct runs of each width are kept for searching.
    """

    def __init__(self, codes: np.ndarray, bits: int, depth: int) -> None:
        self.bits, self.width = bits, max(1, 62 // bits)
        padded = np.concatenate([codes, np.zeros(self.width, np.int64)])
        key = np.zeros(len(codes), np.int64)
        for j in range(self.width):
            key = key << bits | padded[j : j + len(codes)]
        self.runs: list[np.ndarray] = []
        runs, rank = np.unique(key, return_inverse=True)
        self.runs.append(runs)
        self.widths = [self.width]
        while self.widths[-1] < depth:
            w = self.widths[-1]
            later = np.zeros_like(rank)
            later[:-w] = rank[w:] + 1
            runs, rank = np.unique(rank * np.int64(len(runs) + 1) + later, return_inverse=True)
            self.runs.append(runs)
            self.widths.append(2 * w)
        self.order = np.argsort(rank, kind="stable")
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(runs)))])

    def _ranks(self, level: int, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of ranks at a level for the packed ``keys`` (rows x numbers of ``width`` codes) of runs no longer than its width."""
        if not level:
            low = keys[:, 0]
            return np.searchsorted(self.runs[0], low), np.searchsorted(self.runs[0], low + (np.int64(1) << self.bits * (self.width - lengths)))
        half, m = self.widths[level - 1], np.int64(len(self.runs[level - 1]) + 1)
        columns = half // self.width
        a, b = self._ranks(level - 1, keys[:, :columns], np.minimum(lengths, half))
        low, high = a * m, b * m
        more = np.flatnonzero((lengths > half) & (a < b))
        if len(more):
            c, d = self._ranks(level - 1, keys[more, columns:], lengths[more] - half)
            low[more], high[more] = a[more] * m + c + 1, a[more] * m + d + 1
        return np.searchsorted(self.runs[level], low), np.searchsorted(self.runs[level], high)

    def find(self, keys: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each run of codes, packed to a row of ``keys``, the range of ``order`` whose suffixes begin with it."""
        low, high = self._ranks(len(self.runs) - 1, keys, lengths)
        return self.ends[low], self.ends[high]


class Numbers(dict):
    """Numbers its keys as they are asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """Ids of texts as the sentencepiece library gives them for the model file, found by suffix-array matching."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        pieces = self.v.pieces
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        #: characters of pieces as numbers from 1, all others as one more
        chars = np.unique(np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32))
        self.code = np.full(0x110001, len(chars) + 1, np.int32)
        self.code[chars] = np.arange(1, len(chars) + 1)
        self.code[0] = 0  # between segments
        self.bits = (len(chars) + 1).bit_length()
        width = max(1, 62 // self.bits)
        depth = width
        while depth < self.v.longest:
            depth *= 2
        grid = np.zeros((len(pieces), depth), np.int64)
        for i, p in enumerate(pieces):
            grid[i, : len(p)] = self.code[[ord(c) for c in p]]
        self.keys = np.zeros((len(pieces), depth // width), np.int64)
        for j in range(width):
            self.keys = self.keys << self.bits | grid[:, j::width]
        self.alone = np.zeros(len(chars) + 2, bool)  # characters that are pieces by themselves
        self.alone[grid[self.lengths == 1, 0]] = True
        self.piece_ids = np.array([self.v.ids[p] for p in pieces], np.int32)
        self.known: dict[str, bytes] = {}  # ids as int32
        self.older: dict[str, bytes] = {}
        self.cut_lines = not any("\n" in p for p in pieces)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends and pieces of all occurrences by their start, the longest first, and where each start's begin."""
        index = SuffixArray(codes, self.bits, self.v.longest)
        lo, hi = index.find(self.keys, self.lengths)
        n = hi - lo
        piece = np.repeat(np.arange(len(n), dtype=np.int32), n)
        start = index.order[np.arange(len(piece)) + np.repeat(lo - np.cumsum(n) + n, n)]
        del index
        # a start has one piece of a length at most, so that each occurrence has a place of its own
        longest = self.v.longest
        grid = np.full((len(codes) + 1) * longest, -1, np.int32)
        grid[start * longest + longest - self.lengths[piece]] = piece
        at = np.flatnonzero(grid >= 0)
        bounds = np.searchsorted(at, np.arange(len(codes) + 3) * longest)
        return at // longest + longest - at % longest, grid[at], bounds

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids (int32) of segments, all indexed together."""
        text = "\0".join(segments)  # no piece has a zero in it
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points].astype(np.int64)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.cumsum(sizes + 1) - sizes - 1
        # a zero inside a segment is a character like any other that no piece has
        codes[(codes == 0)] = self.code[-1]
        codes[(starts[1:] - 1)] = 0
        end, piece, bounds = self.edges(codes)
        taken = np.full(len(codes) + 2, -2, np.int64)  # the edge taken from a place; -1: its character is spelled
        came = np.full(len(codes) + 2, -1, np.int64)  # the place from which a place was reached
        dead = np.zeros(len(codes) + 2, bool)  # from which no way leads to the end
        where, stop = starts.copy(), starts + sizes
        before, k = np.full(len(where), -1, np.int64), bounds[starts]
        single = self.alone[codes]
        live = np.flatnonzero(sizes > 0)
        where, stop, before, k = where[live], stop[live], before[live], k[live]
        while len(where) > FEW:
            left = k < bounds[where + 1]
            ok = np.zeros(len(where), bool)
            i = np.flatnonzero(left)
            i = i[~dead[end[k[i]]]]
            ok[i] = self.v.may_follow(before[i], piece[k[i]].astype(np.int64))
            spelled = ~left & ~single[where] & ~dead[where + 1] & (taken[where] != -1)
            back = ~left & ~spelled
            k[left & ~ok] += 1
            go = ok | spelled
            here = where[go]
            edge = np.where(ok, k, -1)[go]
            there = np.where(edge >= 0, end[edge], here + 1)
            taken[here], came[there] = edge, here
            where[go], before[go], k[go] = there, np.where(edge >= 0, piece[edge], -1), bounds[there]
            if back.any():
                here = where[back]
                dead[here] = True
                there = came[here]
                edge = taken[there]
                where[back], k[back] = there, np.where(edge >= 0, edge + 1, bounds[there + 1])
                last = np.where(came[there] >= 0, taken[came[there]], -1)
                before[back] = np.where(last >= 0, piece[last], -1)
            on = where < stop
            if not on.all():
                where, stop, before, k = where[on], stop[on], before[on], k[on]
        for at, to, b, e in zip(where.tolist(), stop.tolist(), before.tolist(), k.tolist()):
            self.walk(at, to, b, e, end, piece, bounds, taken, came, dead, single)
        return self.collect(points, starts, sizes, taken, end, piece)

    def walk(self, where: int, stop: int, before: int, k: int, end, piece, bounds, taken, came, dead, single) -> None:
        """Goes on with one segment as :meth:`encode_segments` does with many."""
        asked: dict[int, bool] = {}
        n_pieces, asked_to = len(self.v.pieces), where
        while where < stop:
            last = bounds[where + 1]
            while k < last:
                if not dead[end[k]]:
                    if before < 0:
                        break
                    key = before * n_pieces + int(piece[k])
                    if key not in asked:
                        begin, asked_to = max(0, min(where, asked_to) - self.v.longest), max(asked_to, min(where + AHEAD, stop))
                        asked |= self.meetings(begin, asked_to, end, piece, bounds)
                    if asked[key]:
                        break
                k += 1
            if k < last:
                taken[where], came[end[k]] = k, where
                where, before = int(end[k]), int(piece[k])
                k = int(bounds[where])
            elif not single[where] and not dead[where + 1] and taken[where] != -1:
                # a character that is no piece merges with nothing and stands for its bytes
                taken[where], came[where + 1] = -1, where
                where, before, k = where + 1, -1, int(bounds[where + 1])
            else:
                # what leads to a place is one sequence, so a place is tried once
                dead[where] = True
                where = int(came[where])
                k = int(taken[where]) + 1 if taken[where] >= 0 else int(bounds[where + 1])
                one = taken[came[where]] if came[where] >= 0 else -1
                before = int(piece[one]) if one >= 0 else -1

    def meetings(self, begin: int, stop: int, end: np.ndarray, piece: np.ndarray, bounds: np.ndarray) -> dict[int, bool]:
        """Of all edges that begin from ``begin`` to ``stop`` and those that begin where one ends: pairs of pieces, and whether the second may follow."""
        first = np.arange(bounds[begin], bounds[stop])
        at = end[first]
        n = bounds[at + 1] - bounds[at]
        second = np.arange(n.sum()) + np.repeat(bounds[at] - np.cumsum(n) + n, n)
        keys = np.unique(np.repeat(piece[first], n).astype(np.int64) * len(self.v.pieces) + piece[second])
        ok = self.v.may_follow(keys // len(self.v.pieces), keys % len(self.v.pieces))
        return dict(zip(keys.tolist(), ok.tolist()))

    def collect(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, taken: np.ndarray, end: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """The ids along the edges taken from each start to its segment's end."""
        on = np.zeros(len(points) + 1, bool)
        at, stop = starts[sizes > 0], (starts + sizes)[sizes > 0]
        while len(at):
            on[at] = True
            edge = taken[at]
            at = np.where(edge >= 0, end[edge], at + 1)
            some = at < stop
            at, stop = at[some], stop[some]
        at = np.flatnonzero(on)
        edge = taken[at]
        ids = np.where(edge >= 0, self.piece_ids[piece[edge]], -1).astype(np.int32) if len(piece) else np.full(len(at), -1, np.int32)
        cuts = np.searchsorted(at, np.append(starts, len(points) + 1))
        strange = np.flatnonzero(ids < 0)
        if len(strange):
            bytes_ = [self.v.spell(chr(c)) for c in points[at[strange]].tolist()]
            n = np.ones(len(ids), np.int64)
            n[strange] = list(map(len, bytes_))
            new = np.cumsum(n) - n
            whole = np.repeat(ids, n)
            for i, b in zip(new[strange].tolist(), bytes_):
                whole[i : i + len(b)] = b
            cuts, ids = np.append(new, len(whole))[cuts], whole
        flat, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn(self, segments: list[str]) -> None:
        start = size = 0
        for i, s in enumerate(segments, 1):
            size += len(s) + 1
            if size >= INDEX_CHARS or i == len(segments):
                some = segments[start:i]
                self.known.update(zip(some, self.encode_segments(some)))
                start, size = i, 0

    def forget(self) -> None:
        """Free what is known of segments."""
        self.known, self.older = {}, {}

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        number = Numbers()  # distinct segments of the texts, which are kept as numbers
        cut = [array("i", map(number.__getitem__, segments_of(t.decode("utf-8", "replace"), self.cut_lines)) if t else []) for t in texts]
        if len(self.known) > CACHE_SEGMENTS:
            self.known, self.older = {}, self.known
        new = number.keys() - self.known.keys()
        again = new & self.older.keys()
        self.known.update((s, self.older[s]) for s in again)
        self.learn(sorted(new - again))
        ids = [self.known[s] for s in number]
        return [np.frombuffer(b"".join(map(ids.__getitem__, c)), np.int32) for c in cut]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: pieces with blanks for word-begin signs, byte pieces joined to characters, without the blank put before a text."""
        return b"".join(map(self.v.out.__getitem__, ids)).decode("utf-8", "replace")[1:]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process."""
    return Encoder(path)


def segments_of(text: str, cut_lines: bool = True) -> list[str]:
    """``text`` with the sign put before it, cut before each run of signs, and around line breaks if no piece has one."""
    if cut_lines and "\n" in text:
        first, *others = text.split("\n")
        out = segments_of(first, False)
        for line in others:
            out.append("\n")
            if line:
                own = segments_of(line, False)  # but no sign is put before a line
                own[0] = own[0][1:]
                out += own if own[0] else own[1:]
        return out
    if "  " not in text and not text.startswith((" ", SPACE)) and SPACE not in text and not text.endswith(" "):
        return [SPACE + w for w in text.split(" ")]
    out = []
    signs = SPACE
    for w in text.replace(" ", SPACE).split(SPACE):
        if w:
            out.append(signs + w)
            signs = ""
        signs += SPACE
    if signs := signs[:-1]:
        out.append(signs)
    return out


def encode(docs: DataFrame, model: str, keys: dict[str, F.Column | str], text: str = "text") -> DataFrame:
    """``keys`` and ``ids, n_tokens, decoded`` for every row; ``decoded`` is the text that the ids stand for.

    Null and empty texts have no ids and decode to the empty text. All else decodes
    to itself, but the word-begin sign U+2581, which decodes to a blank as in the
    library. Repeated rows keep their rows; no rows give none.
    """

    def start():
        encoder = encoder_of(model)

        def work(texts):
            ids = encoder(texts)
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "n_tokens": lengths, "decoded": [encoder.decode(x.tolist()) for x in ids]}

        return work

    def done():
        encoder_of(model).forget()

    return map_texts(docs, keys, text, start, "ids array<int>, n_tokens long, decoded string", SLICE_BYTES, done)
