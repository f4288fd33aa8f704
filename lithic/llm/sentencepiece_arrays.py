"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text is laid end to end in one array and cut at the boundaries that no piece of the model
crosses. Equal parts are numbered once; the distinct ones that are not remembered are indexed
together: their suffixes are sorted by as many characters as the longest piece has. Every piece of
the model is binary-searched in that order; its range of suffixes is its occurrences. Each
occurrence is an edge from its first to its last character; edges are sorted by where they end and
relaxed in that order, all parts at once. Texts, parts and pieces are arrays throughout.

The model's pieces are merges ranked by score, so relaxing keeps no sums. A text's encoding is the
one path in which each piece encodes to itself and any two neighbours encode to just those two;
each prefix of a text has one last piece, so an edge is taken if its piece goes with the last
piece of the prefix that it extends. Which pairs go together is worked out by merging, once a
pair, and remembered. That argument needs unequal scores: parts with runs of spaces, whose
pieces tie in this kind of model, are merged pair by pair, as is a part without a path.

Characters that no piece has are spelled in byte pieces. Decoding joins pieces, reads byte pieces
as UTF-8 and takes off the one space that encoding adds in front.

Defined cases: a null text is an empty one, without pieces; a text of any length is encoded whole;
repeated rows are encoded each on their own; an empty table gives no rows; columns of ``docs``
are passed through, those named as a new one are replaced. Decoding restores every text but
for U+2581, the model's own mark for a space, which reads as a space. Parts are told apart by
their characters, not by their keys alone. What is remembered is bounded and changes speed only.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lithic.llm.common import give_back, sliced, with_small_batches

SPACE = "▁"
#: Bounds of what is remembered between batches, in parts and pairs of pieces.
PARTS, PAIRS = 250_000, 400_000
#: Characters that are cut and numbered at once, and of new parts that are indexed at once.
WINDOW, BLOCK_CHARS = 1 << 19, 150_000
PACK = 5  # characters of 12 bits in a key

_MIX, _STEP, _SIZE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


class Model:
    """The pieces of a BPE model file and the encoder over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        held = SentencePieceProcessor(model_file=path)
        ids = range(held.get_piece_size())
        plain = [i for i in ids if not (held.is_byte(i) or held.is_control(i) or held.is_unknown(i) or held.is_unused(i))]
        self.text = {i: held.id_to_piece(i) for i in plain}
        self.score = {held.id_to_piece(i): (-held.get_score(i), i) for i in plain}
        byte_of = {int(held.id_to_piece(i)[3:5], 16): i for i in ids if held.is_byte(i)}
        self.bytes = np.array([byte_of[b] for b in range(256)], np.int32)
        self.other = len(ids)  # stands for the beginning of a part
        shown = {i: self.text[i].replace(SPACE, " ").encode() for i in plain} | {i: bytes([b]) for b, i in byte_of.items()}
        self.shown = [shown.get(i, b"") for i in ids]
        self.shown_bytes = np.frombuffer(b"".join(self.shown), np.uint8)
        self.shown_size = np.array([len(x) for x in self.shown], np.int32)
        self.shown_at = (np.cumsum(self.shown_size) - self.shown_size).astype(np.int32)

        letters = sorted({c for t in self.score for c in t})
        if len(letters) > 4090 or any(c not in self.score for c in letters) or any(SPACE in t.lstrip(SPACE) for t in self.score):
            raise ValueError("this encoder needs a piece for each of up to 4,090 characters, and spaces only in front of pieces")
        self.code = np.ones(0x110000, np.uint16)  # 0 ends a part, 1 is any character that no piece has
        self.code[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2, dtype=np.uint16)
        usable = [i for i in plain if self.merge(self.text[i]) == [i]]
        self.longest = max(len(self.text[i]) for i in usable)
        self.pieces = np.array(usable, np.int32)
        self.lengths = np.array([len(self.text[i]) for i in usable], np.int32)
        width = -(-self.longest // PACK)
        codes = np.zeros((len(usable), width * PACK), np.uint64)
        for row, i in enumerate(usable):
            codes[row, : len(self.text[i])] = self.code[[ord(c) for c in self.text[i]]]
        self.low = _packed_rows(codes, width)
        codes[np.arange(width * PACK) >= self.lengths[:, None]] = 4095
        self.high = _packed_rows(codes, width)
        #: Neighbouring characters that stand in some piece, a bit a pair; no piece crosses any other.
        self.n_codes = len(letters) + 2
        inside = np.zeros(self.n_codes * self.n_codes, bool)
        for t in self.score:
            at = self.code[[ord(c) for c in t]].astype(np.int64)
            inside[at[:-1] * self.n_codes + at[1:]] = True
        self.inside = np.packbits(inside, bitorder="little")
        self.pairs: dict[int, bool] = {}
        self.sorted_pairs, self.sorted_goes = np.empty(0, np.int64), np.empty(0, bool)
        self.forget()

    def forget(self) -> None:
        """Drop the remembered parts: keys in order, where each stands, its characters and pieces."""
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.points, self.point_at, self.point_n = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.tokens, self.token_at, self.token_n = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def merge(self, text: str) -> list[int]:
        """Piece ids by merging the best adjacent pair again and again; ``other`` where none is."""
        parts, score = list(text), self.score
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap = [(score[p][0], i, p) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or parts[i] + parts[j] != p:
                continue
            parts[i], parts[j] = p, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (q := p + parts[k]) in score:
                    heapq.heappush(heap, (score[q][0], i, q))
            if (h := before[i]) >= 0 and (q := parts[h] + p) in score:
                heapq.heappush(heap, (score[q][0], h, q))
        return [score[p][1] if p in score else self.other for p in parts if p]

    def goes(self, pair: int) -> bool:
        """Whether two pieces stay as they are when they stand side by side."""
        a, b = divmod(pair, self.other + 1)
        return a == self.other or self.merge(self.text[a] + self.text[b]) == [a, b]

    def all_go(self, pairs: np.ndarray) -> np.ndarray:
        """``goes`` for an array of different pairs: known ones by binary search, new ones merged."""
        if len(self.pairs) > 20_000:
            keys = np.concatenate([self.sorted_pairs, np.fromiter(self.pairs, np.int64, len(self.pairs))])
            goes = np.concatenate([self.sorted_goes, np.fromiter(self.pairs.values(), bool, len(self.pairs))])
            order = np.argsort(keys)[-PAIRS:]
            self.sorted_pairs, self.sorted_goes, self.pairs = keys[order], goes[order], {}
        out = np.zeros(len(pairs), bool)
        at = np.searchsorted(self.sorted_pairs, pairs)
        held = at < len(self.sorted_pairs)
        held[held] = self.sorted_pairs[at[held]] == pairs[held]
        out[held] = self.sorted_goes[at[held]]
        known = self.pairs
        for k in np.flatnonzero(~held).tolist():
            pair = int(pairs[k])
            if pair not in known:
                known[pair] = self.goes(pair)
            out[k] = known[pair]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece in parts laid end to end."""
        width = self.low.shape[1]
        padded = np.concatenate([codes.astype(np.uint64), np.zeros(width * PACK, np.uint64)])
        packed = padded[: -PACK + 1 or None][: len(codes) + (width - 1) * PACK]
        for k in range(1, PACK):
            packed = (packed << np.uint64(12)) | padded[k : k + len(packed)]
        keys = [packed[k * PACK : k * PACK + len(codes)] for k in range(width)]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        first, last = _bound(keys, self.low, False), _bound(keys, self.high, True)
        many = last - first
        start = order[np.repeat(first, many) + ranges(many)].astype(np.int32)
        return start, start + np.repeat(self.lengths, many), np.repeat(self.pieces, many)

    def matched(self, codes: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many a part) of parts that lie at ``begin``, a 0 after each; none without a path."""
        start, end, piece = self.edges(codes)
        # Relax by distance from the part's first character; edges of one end are of one distance.
        part_at = np.repeat(begin, sizes + 1).astype(np.int32)
        distance = end - part_at[start]
        order = np.argsort(distance, kind="stable")
        start, end, piece, distance = start[order], end[order], piece[order], distance[order]
        last, size = np.full(len(codes) + 1, -1, np.int32), np.zeros(len(codes) + 1, np.int32)
        cuts = np.flatnonzero(np.diff(distance, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            left = np.where(s == part_at[s], self.other, last[s])
            reached = left >= 0
            s, e, p, left = s[reached], e[reached], p[reached], left[reached]
            pairs, back = np.unique(left * np.int64(self.other + 1) + p, return_inverse=True)
            ok = self.all_go(pairs)[back]
            last[e[ok]], size[e[ok]] = p[ok], (e - s)[ok]

        # Walk all parts back from their ends at once.
        stop, place, whose = begin, begin + sizes, np.arange(len(begin))
        found, steps = [], []
        while len(whose):
            going = (place > stop) & (last[place] >= 0)
            whose, place, stop = whose[going], place[going], stop[going]
            found.append(last[place]), steps.append(whose)
            place = place - size[place]
        found, steps = np.concatenate(found)[::-1], np.concatenate(steps)[::-1]
        counts = np.bincount(steps, minlength=len(begin))
        return found[np.argsort(steps, kind="stable")], counts

    def encode_parts(self, points: np.ndarray, codes: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many a part) of different parts."""
        marks = np.concatenate([[0], np.cumsum(points == ord(SPACE))])
        spelled = codes[first] == 1  # a part of its own
        merged = marks[first + length] - marks[first + 1] > 0
        plain = np.flatnonzero(~spelled & ~merged)
        where, pieces, counts = [], [], []
        block = np.cumsum(length[plain] + 1) // BLOCK_CHARS
        for i in np.split(plain, np.flatnonzero(np.diff(block)) + 1):
            if not len(i):
                continue
            n = length[i]
            begin = np.cumsum(n + 1) - n - 1
            laid = np.zeros(int(n.sum()) + len(n), np.uint16)
            laid[np.repeat(begin, n) + ranges(n)] = codes[np.repeat(first[i], n) + ranges(n)]
            found, many = self.matched(laid, begin, n)
            merged[i[many == 0]] = True  # no path
            where.append(i[many > 0]), pieces.append(found), counts.append(many[many > 0])
        for k in np.flatnonzero(spelled | merged).tolist():
            text = points[first[k] : first[k] + length[k]].tobytes().decode("utf-32-le")
            found = self.bytes[list(text.encode())] if spelled[k] else np.array(self.merge(text), np.int32)
            where.append(np.array([k])), pieces.append(found), counts.append(np.array([len(found)]))
        where, laid, many = np.concatenate(where), np.concatenate(pieces), np.concatenate(counts)
        counts = np.zeros(len(first), np.int64)
        counts[where] = many
        begin = np.cumsum(counts) - counts
        out = np.empty(len(laid), np.int32)
        out[np.repeat(begin[where], many) + ranges(many)] = laid
        return out, counts

    def remembered(self, uniq: np.ndarray, points: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where each different part stands among the remembered ones, or -1."""
        at = np.searchsorted(self.keys, uniq)
        hit = np.flatnonzero(at < len(self.keys))
        hit = hit[self.keys[at[hit]] == uniq[hit]]
        place = self.place[at[hit]]
        same = self.point_n[place] == length[hit]
        hit, place = hit[same], place[same]
        n = length[hit]
        unlike = self.points[np.repeat(self.point_at[place], n) + ranges(n)] != points[np.repeat(first[hit], n) + ranges(n)]
        wrong = np.zeros(len(hit), bool)
        wrong[np.repeat(np.arange(len(hit)), n)[unlike]] = True
        out = np.full(len(uniq), -1, np.int64)
        out[hit[~wrong]] = place[~wrong]
        return out

    def window(self, points: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many a part) of parts that lie side by side."""
        if len(self.keys) > PARTS:
            self.forget()
        length = np.diff(first, append=len(points))
        key = part_keys(points, first, length)
        uniq, sample, back = np.unique(key, return_index=True, return_inverse=True)
        twin = sample[back]
        told = (length == length[twin]).all() and (points == points[np.repeat(first[twin], length) + ranges(length)]).all()
        if not told:  # different parts with one key: number them by their characters
            seen: dict[bytes, int] = {}
            back = np.array([seen.setdefault(points[a : a + n].tobytes(), len(seen)) for a, n in zip(first.tolist(), length.tolist(), strict=True)])
            _, sample = np.unique(back, return_index=True)
            uniq = key[sample]
        own, n = first[sample], length[sample]
        place = self.remembered(uniq, points, own, n)
        new = np.flatnonzero(place < 0)
        if len(new):
            pieces, counts = self.encode_parts(points, codes, own[new], n[new])
            place[new] = len(self.token_n) + np.arange(len(new))
            self.token_at = np.concatenate([self.token_at, len(self.tokens) + np.cumsum(counts) - counts])
            self.token_n = np.concatenate([self.token_n, counts])
            self.tokens = np.concatenate([self.tokens, pieces])
            self.point_at = np.concatenate([self.point_at, len(self.points) + np.cumsum(n[new]) - n[new]])
            self.point_n = np.concatenate([self.point_n, n[new]])
            self.points = np.concatenate([self.points, points[np.repeat(own[new], n[new]) + ranges(n[new])]])
            keys, places = np.concatenate([self.keys, uniq[new]]), np.concatenate([self.place, place[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.place = keys[order], places[order]
        place = place[back]
        counts = self.token_n[place]
        return self.tokens[np.repeat(self.token_at[place], counts) + ranges(counts)], counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts laid end to end, and how many each has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        out = np.zeros(len(texts), np.int64)
        if not sizes.any():
            return np.empty(0, np.int32), out
        points = np.frombuffer("".join([SPACE + t for t in texts if t]).encode("utf-32-le"), np.uint32).copy()
        points[points == 32] = ord(SPACE)
        codes = self.code[points]
        pair = codes[:-1].astype(np.uint32) * np.uint32(self.n_codes) + codes[1:]
        opens = np.concatenate([[True], (self.inside[pair >> np.uint32(3)] >> (pair & np.uint32(7)).astype(np.uint8)) & 1 == 0])
        del pair
        some = np.flatnonzero(sizes)
        begin = np.cumsum(sizes[some] + 1) - sizes[some] - 1
        opens[begin] = True
        first = np.flatnonzero(opens)
        bounds = np.unique(np.concatenate([[0], np.searchsorted(first, np.arange(WINDOW, len(points), WINDOW)), [len(first)]]))
        pieces, counts = [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            low, high = first[a], first[b] if b < len(first) else len(points)
            found, many = self.window(points[low:high], codes[low:high], first[a:b] - low)
            pieces.append(found), counts.append(many)
        out[some] = np.add.reduceat(np.concatenate(counts), np.searchsorted(first, begin))
        return np.concatenate(pieces), out

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.shown.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """The texts that ``encode`` made ids of, as an Arrow array."""
        n = self.shown_size[ids]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        data = np.empty(int(ends[-1]), np.uint8)
        for a in range(0, len(ids), WINDOW):
            i, m = ids[a : a + WINDOW], n[a : a + WINDOW]
            data[ends[a] : ends[a + len(i)]] = self.shown_bytes[np.repeat(self.shown_at[i], m) + ranges(m)]
        at = ends[np.concatenate([[0], np.cumsum(sizes)])]
        lead = at[:-1][sizes > 0]
        lead = lead[data[lead] == 32]
        at = at - np.searchsorted(lead, at)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.delete(data, lead)))


def part_keys(points: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit key of each part's characters and their number."""
    powers = np.multiply.accumulate(np.full(int(length.max()), _STEP))
    mixed = (points.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= powers[ranges(length)]
    key = np.add.reduceat(mixed, first) + length.astype(np.uint64) * _SIZE
    return (key ^ (key >> np.uint64(32))) * _MIX


def _packed_rows(codes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(codes), width), np.uint64)
    for k in range(width * PACK):
        out[:, k // PACK] = (out[:, k // PACK] << np.uint64(12)) | codes[:, k]
    return out


def _bound(keys: list[np.ndarray], wanted: np.ndarray, above: bool) -> np.ndarray:
    """Binary search of every wanted row: the first place not below it, or the first above it."""
    lo, hi = (np.searchsorted(keys[0], wanted[:, 0], side) for side in ("left", "right"))
    rows = np.flatnonzero(lo < hi)
    while len(rows):
        mid = (lo[rows] + hi[rows]) >> 1
        less, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
        for key, want in zip(keys[1:], wanted[rows, 1:].T, strict=True):
            x = key[mid]
            less |= same & (x < want)
            same &= x == want
        down = less | same if above else less
        lo[rows[down]], hi[rows[~down]] = mid[down] + 1, mid[~down]
        rows = rows[lo[rows] < hi[rows]]
    return lo


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model a process."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode_documents(docs: DataFrame, model_file: str, text_col: str = "text", ids_col: str = "token_ids", n_col: str = "n_tokens", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text, their number and, if named, the decoded text."""
    new = {ids_col: T.ArrayType(T.IntegerType()), n_col: T.LongType()} | ({decoded_col: T.StringType()} if decoded_col else {})
    docs = docs.drop(*(c for c in new if c in docs.columns))
    kept = docs.columns

    def run(batches):
        held = model(model_file)
        for batch in (part for whole in batches for part in sliced(whole)):
            ids, sizes = held.encode([t or "" for t in batch.column(text_col).to_pylist()])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            arrays = [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(sizes)]
            if decoded_col:
                arrays.append(held.decode_all(ids, sizes))
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *new])
            del batch, ids, arrays
        give_back()

    return with_small_batches(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, kind) for n, kind in new.items())]))


def decode_documents(encoded: DataFrame, model_file: str, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that each row's ids stand for; null ids give null."""
    encoded = encoded.drop(decoded_col)
    kept = encoded.columns

    def run(batches):
        held = model(model_file)
        for batch in (part for whole in batches for part in sliced(whole)):
            texts = [None if x is None else held.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, decoded_col])
        give_back()

    return with_small_batches(encoded).mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(decoded_col, T.StringType())]))
