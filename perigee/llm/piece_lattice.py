"""SentencePiece encoding and decoding by the best paths of the piece lattice.

A text becomes its pieces' best segmentation and the next best ones. Forward Viterbi
scores are computed over the lattice, with the runner-up at every place; as the exact
distance to the start they guide an A-star search that grows segmentations backwards
from the end and finds them in order of their scores.

No piece holds a space after another character, and none holds a line feed, so every
path passes the places before a run of spaces and around a line feed. The lattice is
cut there. The N best paths of the chain differ from the best one in chunks whose
second path costs least: at most N - 1 chunks, those with the smallest losses, need the
backward search. Chunks repeat, so a bounded memory of chunks saves most of the work.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from perigee.llm.shared import column, map_batches, texts

SPACE = "▁"
NEVER = float("-inf")
UNKNOWN_COST = 10.0
REMEMBERED = 250_000
LONGEST_REMEMBERED = 40
N_BEST = 3
# characters of texts whose chunks are made distinct together
TOGETHER = 1 << 20
# characters of new chunks whose lattices grow together
GROWN = 1 << 16
# bytes of texts whose results a worker holds
SLICE = 1 << 22
# 32-bit words of a remembered chunk before its ids
HEAD = 5
SAME = 6
# piece kinds of the model format
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Pieces:
    """Pieces with scores: the arcs of the lattice, and what ids decode to."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.arcs: dict[str, tuple[float, tuple[int, ...]]] = {}
        self.content: list[bytes] = []
        self.bytes_: dict[int, int] = {}
        self.unknown = 0
        for number, (piece, score, kind) in enumerate(pieces):
            if kind in (NORMAL, USER_DEFINED):
                self.arcs[piece] = (score, (number,))
                self.content.append(piece.replace(SPACE, " ").encode())
            elif kind == BYTE:
                value = int(piece[3:-1], 16)
                self.bytes_[value] = number
                self.content.append(bytes([value]))
            else:
                if kind == UNKNOWN:
                    self.unknown = number
                self.content.append(b"")
        if any(SPACE in piece.lstrip(SPACE) or "\n" in piece for piece in self.arcs):
            raise ValueError("pieces with a space or line feed inside can't be cut into chunks")
        self.longest = max(map(len, self.arcs), default=1)
        scores = [score for score, _ in self.arcs.values() if score > -1e8]
        self.worst = min(scores, default=0.0) - UNKNOWN_COST

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The pieces of a SentencePiece model file on the driver."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        kind = lambda i: BYTE if model.is_byte(i) else UNKNOWN if model.is_unknown(i) else CONTROL if model.is_control(i) else UNUSED if model.is_unused(i) else NORMAL
        return cls([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])

    def fallback(self, character: str) -> tuple[float, tuple[int, ...]]:
        """The arc of a character that is no piece: its bytes, or the unknown piece."""
        if self.bytes_:
            return self.worst, tuple(self.bytes_[b] for b in character.encode())
        return self.worst, (self.unknown,)

    @cached_property
    def tree(self) -> dict:
        """Pieces by their characters: each leads to (what may follow, the piece's arc)."""
        root: dict = {}
        for piece, arc in self.arcs.items():
            level = root
            for character in piece[:-1]:
                level = level.setdefault(character, [{}, None])[0]
            level.setdefault(piece[-1], [{}, None])[1] = arc
        return root

    def forward(self, text: str) -> tuple[list[float], list[float], list]:
        """Best and second score to every place, and the best arc that ends there."""
        n, root = len(text), self.tree
        best, second, back = [NEVER] * (n + 1), [NEVER] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            base, other, level, j = best[i], second[i], root, i
            for character in text[i : i + self.longest]:
                j += 1
                node = level.get(character)
                if node is None:
                    if j > i + 1:
                        break
                    level, arc = {}, self.fallback(character)
                else:
                    level, arc = node
                    if arc is None:
                        if j > i + 1:
                            continue
                        arc = self.fallback(character)
                cost, ids = arc
                score = base + cost
                if score > best[j]:
                    kept = best[j]
                    second[j] = kept if kept > other + cost else other + cost
                    best[j], back[j] = score, (i, ids)
                elif score > second[j]:
                    second[j] = score
                if not level:
                    break
        return best, second, back

    @cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The tree of pieces as sorted keys (place in the tree, next character) and where
        each leads; where the first character leads; what piece ends there: its score (NaN:
        none) and number in a list of ids."""
        keys, to, place = [], [], {id(self.tree): 0}
        score, number, ids = [np.nan], [0], [0]
        level = [self.tree]
        while level:
            under = []
            for node in level:
                for character, (below, arc) in node.items():
                    keys.append((place[id(node)] << 21) | ord(character))
                    to.append(len(score))
                    place[id(below)] = len(score)
                    score.append(np.nan if arc is None else arc[0])
                    number.append(len(ids) if arc else 0)
                    if arc:
                        ids.append(arc[1][0])
                    under.append(below)
            level = under
        keys, to = np.array(keys, np.int64), np.array(to, np.int64)
        first = np.zeros(0x110000, np.int32)
        first[keys[: len(self.tree)]] = to[: len(self.tree)]
        order = np.argsort(keys)
        return keys[order], to[order], first, np.array(score), np.array(number, np.int32), np.array(ids, np.int32)

    def arcs_of(self, text: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, score, piece) of all arcs of one character, of two, and so on.

        text: characters; after: where the next character of the same chunk is, or -1. All
        places go down the tree together. A character that is no piece has an arc of its
        own, piece 0.
        """
        keys, to, first, score, number, _ = self.steps
        node, at = first[text], np.arange(len(text))
        other = np.isnan(score[node])
        yield at, np.where(other, self.worst, score[node]), np.where(other, 0, number[node])
        at = at[node > 0]
        place, node = after[at], node[at]
        while True:
            more = place >= 0
            at, place, node = at[more], place[more], node[more].astype(np.int64)
            if not len(at):
                return
            wanted = (node << 21) | text[place]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            on = keys[found] == wanted
            at, place, node = at[on], place[on], to[found[on]]
            piece = ~np.isnan(score[node])
            yield at[piece], score[node[piece]], number[node[piece]]
            place = after[place]

    def grown(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores, losses, numbers of ids, ids) of the chunks that lie one after the other
        in `text`: what `best` finds, with the lattices of all of them grown together.

        The c-th characters of all chunks lie in a row, the longest chunk's first, so the
        chunks that go on are always the head of the rows before.
        """
        order = np.argsort(-lengths, kind="stable")
        length, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
        wide = np.searchsorted(-length, -np.arange(length[0] + 1))
        at = np.cumsum(wide) - wide
        chunk, place = np.arange(at[-1]) - np.repeat(at, wide), np.repeat(np.arange(len(wide)), wide)
        characters = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)[begin[chunk] + place]
        after = np.where(chunk < wide[place + 1], at[place + 1] + chunk, -1)
        costs, numbers, there = [], [], []
        for start, cost, number in self.arcs_of(characters, after):
            costs.append(np.full(len(characters), NEVER))
            costs[-1][start] = cost
            numbers.append(np.zeros(len(characters), np.int32))
            numbers[-1][start] = number
            there.append((np.bincount(place[start], minlength=len(wide)) > 0).tolist())
        # scores by the character that a path has come to
        best, second = np.full(len(characters), NEVER), np.full(len(characters), NEVER)
        back = np.zeros(len(characters), np.int64)
        rows, counts = at.tolist(), wide.tolist()
        for c, (a, m) in enumerate(zip(rows[:-1], counts[:-1], strict=True)):
            most, next_, by = best[a : a + m], second[a : a + m], back[a : a + m]
            # from the arc that starts first: among equal scores it is kept
            for size in range(min(c + 1, len(costs)), 0, -1):
                if not there[size - 1][c + 1 - size]:
                    continue
                score = costs[size - 1][rows[c + 1 - size] : rows[c + 1 - size] + m]
                if size <= c:
                    before = rows[c - size]
                    np.maximum(next_, second[before : before + m] + score, out=next_)
                    score = best[before : before + m] + score
                np.maximum(next_, np.minimum(most, score), out=next_)
                np.copyto(by, size, where=score > most)
                np.maximum(most, score, out=most)
        last = at[length - 1] + np.arange(len(length))
        scores, losses = np.empty(len(length)), np.empty(len(length))
        scores[order], losses[order] = best[last], best[last] - second[last]
        sizes, ids = self._along(order, length, at, back, np.concatenate(numbers), characters)
        return scores, losses, sizes, ids

    def _along(self, order: np.ndarray, length: np.ndarray, at: np.ndarray, back: np.ndarray, numbers: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of every chunk's best path, all paths walked back together."""
        chunk, place, walked, count = np.arange(len(order)), length, [], np.zeros(len(order), np.int64)
        while len(chunk):
            size = back[at[place - 1] + chunk]
            place = place - size
            start = at[place] + chunk
            walked.append((order[chunk], numbers[(size - 1) * len(characters) + start], characters[start]))
            count[order[chunk]] += 1
            chunk, place = chunk[place > 0], place[place > 0]
        ends = np.cumsum(count)
        piece, first = np.empty(ends[-1], np.int64), np.empty(ends[-1], np.uint32)
        for k, (owner, number, character) in enumerate(walked, 1):
            piece[ends[owner] - k], first[ends[owner] - k] = number, character
        ids = self.steps[5][piece]
        other = piece == 0
        if not other.any():
            return count, ids
        if not self.bytes_:
            ids[other] = self.unknown
            return count, ids
        width = np.where(other, 1 + (first >= 0x80) + (first >= 0x800) + (first >= 0x10000), 1)
        ids = np.repeat(ids, width)
        ids[np.repeat(other, width)] = [self.bytes_[b] for b in first[other].tobytes().decode("utf-32-le").encode()]
        return np.add.reduceat(width, ends - count), ids

    def best_of(self, chunks: list[str]) -> list[tuple[float, float, tuple[int, ...]]]:
        """`best` of many chunks at once."""
        if not chunks:
            return []
        scores, losses, sizes, ids = self.grown("".join(chunks), np.fromiter(map(len, chunks), np.int64, len(chunks)))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        return list(zip(scores.tolist(), losses.tolist(), (tuple(x.tolist()) for x in parts), strict=True))

    def best(self, chunk: str) -> tuple[float, float, tuple[int, ...]]:
        """Score, loss of the second path (infinite if there is none), best ids."""
        best, second, back = self.forward(chunk)
        place, parts = len(chunk), []
        while place:
            place, ids = back[place]
            parts.append(ids)
        return best[-1], best[-1] - second[-1], tuple(chain.from_iterable(reversed(parts)))

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The best n paths in order, found backwards with the forward scores as guide.

        Among equal scores (to SAME decimals) the path that is nearest to the start goes
        first: else all ways to cut a run of one character would grow side by side.
        """
        best, _, _ = self.forward(chunk)
        agenda, order, out = [(-best[-1], len(chunk), 0, 0.0, None)], 0, []
        while agenda and len(out) < n:
            _, place, _, behind, path = heapq.heappop(agenda)
            if place == 0:
                parts = []
                while path:
                    ids, path = path
                    parts.append(ids)
                out.append((behind, tuple(chain.from_iterable(parts))))
                continue
            for i in range(max(0, place - self.longest), place):
                arc = self.arcs.get(chunk[i:place])
                if arc is None:
                    if i < place - 1:
                        continue
                    arc = self.fallback(chunk[i])
                order += 1
                score = behind + arc[0]
                heapq.heappush(agenda, (-round(best[i] + score, SAME), i, order, score, (arc[1], path)))
        return out

    @cached_property
    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the bytes of each id end, and the bytes of all ids."""
        return np.cumsum([len(x) for x in self.content]), np.frombuffer(b"".join(self.content), np.uint8)

    def decoded_alike(self, text: str, lengths: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether the ids of each chunk decode to it; the chunks (without marks) and their
        ids lie one after the other."""
        ends, content = self.contents
        width = np.diff(ends, prepend=0)[ids]
        shift = np.repeat(ends[ids] - np.cumsum(width), width)
        got = content[shift + np.arange(len(shift))]
        size = np.bincount(np.repeat(np.arange(len(sizes)), sizes), width, len(sizes)).astype(np.int64)
        want = np.frombuffer(text.encode(), np.uint8)
        heads = np.flatnonzero((want & 0xC0) != 0x80)
        whole = np.diff(np.append(heads, len(want))[np.append(0, np.cumsum(lengths))])
        alike = size == whole
        wrong = got[np.repeat(alike, size)] != want[np.repeat(alike, whole)]
        alike[np.repeat(np.flatnonzero(alike), size[alike])[wrong]] = False
        return alike

    def content_of(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.content.__getitem__, ids)).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; one leading space, set when encoding, is taken off."""
        text = self.content_of(ids)
        return text[1:] if text[:1] == " " else text


def _chunks(values: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """The chunks of all texts, one text after the other, and how many each has.

    Texts begin with a space unless they are empty; a space mark in a text is a space.
    """
    marked = [(" " + text.replace(SPACE, " ")).encode() if text else b"" for text in values]
    data = b"".join(marked)
    text = np.frombuffer(data, np.uint8)
    ends = np.cumsum([0, *map(len, marked)])
    line, cut = text == 10, text == 32
    cut[1:] &= ~cut[:-1]
    cut |= line
    cut[1:] |= line[:-1]
    cut[ends[:-1][np.diff(ends) > 0]] = True
    starts = np.flatnonzero(cut)
    offsets = np.append(starts, len(text)).astype(np.int32)
    chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return chunks, np.diff(np.searchsorted(starts, ends))


class Encoder:
    """Encodes whole texts; remembers a bounded number of chunks."""

    def __init__(self, pieces: Pieces, n: int = N_BEST) -> None:
        self.pieces, self.n = pieces, n
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.others: dict[str, list] = {}

    def encode(self, text: str) -> tuple[float, list[int], list[dict]]:
        """Score and ids of the best segmentation, then the next best ones.

        Each of these is its score and its edits: `n` pieces from `at` on are replaced.
        """
        scores, sizes, ids, more, _ = self.encode_all([text])
        return scores[0], ids.tolist(), more[0]

    def encode_all(self, values: list[str]) -> tuple[list[float], np.ndarray, np.ndarray, list[list[dict]], list[bool]]:
        """(scores, numbers of pieces, ids one text after the other, next best, round trip).

        The chunks of all texts are made distinct first: the lattice of each is looked at
        once, and so is what its ids decode to; texts gather from the distinct ones.
        """
        chunks, many = _chunks(values)
        coded = chunks.dictionary_encode()
        distinct, number = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self._known(distinct)
        flat = np.frombuffer(b"".join(known), np.int32)
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        start = np.cumsum(length) - length
        scored = flat[start[:, None] + np.arange(4)].view(np.float64)
        best, loss, right, held = scored[number, 0], scored[number, 1], flat[start + 4][number] > 0, length[number] - HEAD
        shift = np.repeat(start[number] + HEAD - (np.cumsum(held) - held), held)
        ids = flat[shift + np.arange(len(shift))]
        ends = [0, *np.cumsum(many).tolist()]
        scores, sizes, more, back = [], [], [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            scores.append(float(best[a:b].sum()))
            sizes.append(int(held[a:b].sum()))
            back.append(bool(right[a:b].all()))
            more.append(self._next_best(scores[-1], loss[a:b], held[a:b], lambda i, a=a: float(best[a + i]), lambda i, a=a: distinct[number[a + i]]))
        return scores, np.array(sizes, np.int64), ids, more, back

    def _next_best(self, total: float, losses: np.ndarray, sizes: np.ndarray, score_of, chunk_of) -> list[dict]:
        weakest = np.argsort(losses, kind="stable")[: self.n - 1].tolist()
        combined = [(0.0, ())]
        for i in weakest:
            if losses[i] == float("inf"):
                continue
            other = self._others(chunk_of(i))
            joined = [(loss + score_of(i) - score, edits + ((i, path),) * (k > 0)) for loss, edits in combined for k, (score, path) in enumerate(other)]
            combined = heapq.nsmallest(self.n, joined, key=lambda x: x[0])
        more = []
        for loss, edits in combined[1:]:
            changed = [{"at": int(sizes[:i].sum()), "n": int(sizes[i]), "ids": list(path)} for i, path in sorted(edits)]
            more.append({"score": total - loss, "edits": changed})
        return more

    def _known(self, distinct: list[str]) -> list[bytes]:
        """Each chunk's best path, and whether it decodes to the chunk, as `_packed` has
        them; chunks not used since the memory last filled are forgotten."""
        known = list(map(self.chunks.get, distinct))
        unseen = [k for k, found in enumerate(known) if found is None]
        new = []
        for k in unseen:
            known[k] = self.older.get(distinct[k])
            if known[k] is None:
                new.append(k)
        lengths = np.fromiter((len(distinct[k]) for k in new), np.int64, len(new))
        short = np.flatnonzero(lengths <= LONGEST_REMEMBERED)
        group = np.cumsum(lengths[short]) // GROWN
        for several in np.split(short, np.flatnonzero(np.diff(group)) + 1) if len(short) else []:
            several = several.tolist()
            text = "".join([distinct[new[i]] for i in several])
            for i, found in zip(several, self._packed_together(text, lengths[several]), strict=True):
                known[new[i]] = found
        for i in np.flatnonzero(lengths > LONGEST_REMEMBERED).tolist():
            chunk = distinct[new[i]]
            known[new[i]] = self._packed(chunk, *self.pieces.best(chunk.replace(" ", SPACE)))
        if len(self.chunks) >= REMEMBERED:
            self.chunks, self.older, unseen = {}, self.chunks, range(len(known))
        self.chunks.update((distinct[k], known[k]) for k in unseen if len(distinct[k]) <= LONGEST_REMEMBERED)
        return known

    def _packed_together(self, text: str, lengths: np.ndarray) -> list[bytes]:
        """`_packed` of the best paths of the chunks that lie one after the other."""
        scores, losses, sizes, ids = self.pieces.grown(text.replace(" ", SPACE), lengths)
        ends = np.cumsum(sizes + HEAD)
        heads = (ends - sizes - HEAD)[:, None] + np.arange(HEAD)
        packed, is_id = np.empty(ends[-1], np.int32), np.ones(ends[-1], bool)
        is_id[heads] = False
        packed[is_id] = ids
        packed[heads[:, :4]] = np.stack((scores, losses), axis=1).view(np.int32)
        packed[heads[:, 4]] = self.pieces.decoded_alike(text, lengths, sizes, ids)
        data, cuts = packed.tobytes(), [0, *(ends * 4).tolist()]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _packed(self, chunk: str, score: float, loss: float, ids: tuple[int, ...]) -> bytes:
        """Score, loss, round trip and ids as bytes, as the objects take far more memory."""
        return struct.pack(f"=ddi{len(ids)}i", score, loss, self.pieces.content_of(ids) == chunk, *ids)

    def _others(self, chunk: str) -> list:
        found = self.others.get(chunk)
        if found is None:
            if len(self.others) >= REMEMBERED // 20:
                self.others.clear()
            found = self.pieces.n_best(chunk.replace(" ", SPACE), self.n)
            if len(chunk) <= LONGEST_REMEMBERED:
                self.others[chunk] = found
        return found


# Of a worker process: its tasks share what is remembered.
ENCODERS: dict[tuple[str, int], Encoder] = {}
ENCODED = (
    "n_pieces bigint, score double, ids array<int>, "
    "next_best array<struct<score:double,edits:array<struct<at:int,n:int,ids:array<int>>>>>, round_trip boolean"
)


def _together(batch: Iterable[bytes | None]) -> Iterable[list[str | None]]:
    """The texts in lists of about `TOGETHER` characters."""
    held, size = [], 0
    for text in batch:
        held.append(None if text is None else text.decode())
        size += len(text or b"")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    yield held


def encode(documents: DataFrame, model_path: str, n: int = N_BEST, text_col: str = "text") -> DataFrame:
    """`documents` with n_pieces, score, ids, next_best and round_trip.

    `next_best` holds up to n - 1 further segmentations in order of their scores, as
    edits of `ids`. `round_trip` tells that decoding `ids` gives the text back (a text
    with U+2581 itself, the space mark of the pieces, comes back with a space there).
    A null text has null ids and score and no pieces; an empty text has none and score
    zero. Equal scores come in the order of the search. Rows may repeat; an input
    column with the name of an output column is replaced by it.
    """
    pieces = Pieces.load(model_path)
    made = ("n_pieces", "score", "ids", "next_best", "round_trip")
    names = [x for x in documents.columns if x not in made]
    schema = ", ".join(f"`{x}` {documents.schema[x].dataType.simpleString()}" for x in names)
    def work(batch: pa.RecordBatch) -> dict:
        encoder = ENCODERS.get((model_path, n))
        if encoder is None:
            encoder = ENCODERS.setdefault((model_path, n), Encoder(pieces, n))
        scores, more, back, sizes, flat = [], [], [], [0], [np.zeros(0, np.int32)]
        for values in _together(texts(batch, text_col)):
            there = [v for v in values if v is not None]
            found = encoder.encode_all(there)
            flat.append(found[2])
            rows = zip(found[0], found[1].tolist(), found[3], found[4], strict=True)
            for value in values:
                score, size, others, right = (None, 0, None, None) if value is None else next(rows)
                scores.append(score), more.append(others), back.append(right)
                sizes.append(sizes[-1] + size)
        missing = np.array([s is None for s in scores] + [False])
        offsets = pa.array(np.array(sizes, np.int32), mask=missing)
        values = pa.array(np.concatenate(flat))
        out = {x: column(batch, x) for x in names}
        return out | {
            "n_pieces": np.diff(sizes).tolist(),
            "score": scores,
            "ids": pa.ListArray.from_arrays(offsets, values),
            "next_best": more,
            "round_trip": back,
        }

    frame = documents.select(*[f"`{x}`" for x in names])
    return map_batches(frame, f"{schema}, {ENCODED}" if schema else ENCODED, work, text_col, SLICE)
