"""SentencePiece encoding by exact N-best search, and decoding.

A text's lattice has an edge for each piece of the model that matches at a
position, and a byte edge group for each character that no piece covers.  A
forward Viterbi pass gives every position the best score from the start; a
backward A* from the end uses it as its heuristic, which is exact, so paths leave
the queue in order of score and the first N are the N best.

Two characters that stand side by side in no piece of the model part the lattice
between them, so a text falls into units that no piece crosses; each distinct unit
is searched once and kept (up to ``_CACHE_BYTES``), and the N best of a text are the
N least sums of its units' losses, found by another best-first search.  A unit may
be as long as the text: the search keeps one number per position, and looks up the
edges only where its paths pass.

Scores are the model's own for unigram models.  A merge-rank model has ranks for
scores, which are no log-probabilities; there the score of rank r is -ln(r + 2),
a Zipf prior.  A byte edge costs the least piece score less 10 per byte.

Defined cases: null text gives one empty segmentation, as an empty text does;
ties go to the path that the search met first; a U+2581 in a text reads back as a
space;
repeated rows are encoded alike; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

_MARK = "\u2581"
#: Estimated bytes of units that a worker keeps.
_CACHE_BYTES = 192 << 20
#: Units up to this length keep their lattices while they are searched.
_SHORT = 512
_loaded: dict[str, Pieces] = {}


class Pieces:
    """The pieces of a model file with their scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = range(sp.vocab_size())
        self.text = [sp.id_to_piece(i) for i in n]
        self.byte = {int(self.text[i][3:5], 16): i for i in n if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        ids = [i for i in n if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = {i: sp.get_score(i) for i in ids}
        ranks = all(float(s).is_integer() for s in raw.values()) and min(raw.values()) < -1000
        self.piece = {self.text[i]: (i, -math.log(2 - s) if ranks else s) for i, s in raw.items()}
        self.longest = max(map(len, self.piece))
        self.single = {p for p in self.piece if len(p) == 1}
        self.gap = min(s for _, s in self.piece.values()) - 10
        # What each id reads back as, end to end.
        raw = [bytes([self.value[i]]) if i in self.value else t.replace(_MARK, " ").encode() for i, t in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int32)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size
        self.names: list[str] | None = None

    def _prepare(self) -> None:
        """What only encoding needs."""
        self.matcher = ahocorasick.Automaton()
        for p, (i, score) in self.piece.items():
            self.matcher.add_word(p, (len(p), score, (i,)))
        self.matcher.make_automaton()
        # Characters by number, 0 for those in no piece, and which may stand side by side in a piece.
        chars = sorted({c for p in self.piece for c in p})
        number = {c: k for k, c in enumerate(chars, 1)}
        self.number = np.zeros(0x110000, np.uint16 if len(chars) < 65_535 else np.uint32)
        self.number[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        self.width = len(chars) + 1
        pairs = {number[x] * self.width + number[y] for p in self.piece for x, y in zip(p, p[1:])}
        self.joined = np.zeros(self.width**2 // 8 + 1, np.uint8)
        at = np.array(sorted(pairs), np.int64)
        np.bitwise_or.at(self.joined, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        self.names = []
        self._forget(0, [])

    def _forget(self, n: int, keep: list[int]) -> None:
        """Drop all units but those of these rows; from now on, units get ``n`` segmentations."""
        found = [(self.names[k], self.loss[k], [self.ids[self.at[k, j] : self.at[k, j + 1]] for j in range(n)]) for k in keep]
        self.row: dict[str, int] = {}
        self.names, self.cached_for, self.held, self.used = [], n, 0, 0
        # Segmentation j of unit k is ids[at[k, j]:at[k, j + 1]], with loss[k, j] (for j = 0 the best score).
        self.ids, self.at = np.zeros(1 << 16, "<u4"), np.zeros((1 << 14, n + 1), np.int64)
        self.loss, self.times = np.zeros((1 << 14, n)), np.zeros(1 << 14, np.int64)
        for x in found:
            self._keep(*x)

    def _keep(self, name: str, losses, paths: list) -> int:
        k, used = len(self.names), self.used
        if k == len(self.times):
            self.at, self.loss, self.times = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.loss, self.times))
        while used + sum(map(len, paths)) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        at = [used]
        for ids in paths:
            self.ids[used : used + len(ids)] = ids
            used += len(ids)
            at.append(used)
        missing = self.cached_for - len(paths)
        self.at[k], self.loss[k] = at + [used] * missing, [*losses, *[math.inf] * missing]
        self.held += 250 + 4 * len(name) + 4 * (used - self.used) + 16 * self.cached_for
        self.used = used
        self.names.append(name)
        self.row[name] = k
        return k

    def _row(self, name: str) -> int:
        found = self.row.get(name)
        return self._keep(name, *self.search(name, self.cached_for)) if found is None else found

    def units(self, s: str) -> list[str]:
        """``s`` cut wherever no piece joins the characters on both sides."""
        if self.names is None:
            self._prepare()
        x = self.number[np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        pair = x[:-1] * self.width + x[1:]
        joined = self.joined[pair >> 3] >> (pair & 7).astype(np.uint8) & 1
        cuts = (np.flatnonzero(joined == 0) + 1).tolist()
        return [s[a:b] for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]

    def _bytes_of(self, c: str) -> tuple[tuple[int, ...], float]:
        """The edge of a character that is no piece."""
        ids = tuple(self.byte.get(b, self.unknown) for b in c.encode()) if self.byte else (self.unknown,)
        return ids, self.gap * len(ids)

    def edges(self, s: str, at: int):
        """The (start, ids, score) of the edges that end at ``at``."""
        for start in range(max(0, at - self.longest), at):
            found = self.piece.get(s[start:at])
            if found is not None:
                yield start, (found[0],), found[1]
        if s[at - 1] not in self.single:
            yield at - 1, *self._bytes_of(s[at - 1])

    def lattice(self, s: str) -> tuple[list[list[tuple[int, tuple[int, ...], float]]], list[float]]:
        """For each end, the edges that end there, and the best score of a path from 0 to there."""
        into = [[], *(list(self.edges(s, at)) for at in range(1, len(s) + 1))]
        return into, list(self.forward(s))

    def forward(self, s: str, into: list[list] | None = None) -> list[float]:
        """Viterbi: the best score of a path from 0 to each position; edges go to ``into``, if given."""
        best = [0.0] + [-math.inf] * len(s)
        if self.names is None:
            self._prepare()
        if self.single.issuperset(s):
            # Matches come by their ends, so the scores of their starts are final.
            for last, (n, score, ids) in self.matcher.iter(s):
                last += 1
                if into is not None:
                    into[last].append((last - n, score, ids))
                score += best[last - n]
                if score > best[last]:
                    best[last] = score
        else:
            for at in range(1, len(s) + 1):
                edges = [(start, score, ids) for start, ids, score in self.edges(s, at)]
                best[at] = max(best[start] + score for start, score, _ in edges)
                if into is not None:
                    into[at] = edges
        return best

    def search(self, s: str, n: int) -> tuple[list[float], list[list[int]]]:
        """The best score and the losses of the next n - 1 segmentations of one unit, and the ids of all.

        Forward Viterbi gives each position its best score; against that, every
        edge has a loss, and a path's loss is the sum of its edges'.  The queue
        holds partial paths from the end by loss.  A path taken from it goes on
        along edges without loss; its other edges, at most n at a position, open
        new entries unless n better ones are known.
        """
        into = [[] for _ in range(len(s) + 1)] if len(s) <= _SHORT else None
        best = self.forward(s, into)
        ranked: dict[int, list] = {}
        queue, losses, paths, serial, worst = [(0.0, 0, len(s), None)], [], [], 0, []
        while queue and len(paths) < n:
            loss, _, at, tail = heapq.heappop(queue)
            while at:
                steps = ranked.get(at)
                if steps is None:
                    top = best[at]
                    if into is not None:
                        steps = [(top - best[start] - score, start, ids) for start, score, ids in into[at]]
                    else:
                        steps = [(top - best[start] - score, start, ids) for start, ids, score in self.edges(s, at)]
                    if len(steps) > 1:
                        steps.sort()
                        del steps[n:]
                    ranked[at] = steps
                for extra, start, ids in steps[1:]:
                    total = loss + extra
                    if len(worst) < n:
                        heapq.heappush(worst, -total)
                    elif total < -worst[0]:
                        heapq.heapreplace(worst, -total)
                    else:
                        break
                    serial += 1
                    heapq.heappush(queue, (total, serial, start, (ids, tail)))
                _, at, ids = steps[0]
                tail = (ids, tail)
            ids = []
            while tail:
                ids += tail[0]
                tail = tail[1]
            losses.append(loss)
            paths.append(ids)
        losses[0] = best[-1]
        return losses, paths

    def nbest(self, text: str, n: int) -> list[tuple[float, bytes]]:
        """The n best (score, packed ids) of a whole text."""
        if not text:
            return [(0.0, b"")]
        if self.names is None:
            self._prepare()
        if self.cached_for != n:
            self._forget(n, [])
        elif self.held > _CACHE_BYTES:
            # What was used again since the last time stays, unless that is most of it.
            again = np.flatnonzero(self.times[: len(self.names)] > 1).tolist()
            self._forget(n, again if 2 * len(again) < len(self.names) else [])
        names = self.units(_MARK + text.replace(" ", _MARK))
        rows = list(map(self.row.get, names))
        if None in rows:
            rows = [self._row(u) if k is None else k for u, k in zip(names, rows, strict=True)]
        rows = np.array(rows)
        np.add.at(self.times, rows, 1)
        first, end = self.at[rows, 0], self.at[rows, 1]
        top, size = math.fsum(self.loss[rows, 0].tolist()), end - first
        end = np.cumsum(size)
        ids = self.ids[np.repeat(first - end + size, size) + np.arange(end[-1])]
        out = [(top, ids.tobytes())]
        if n > 1:
            # Only the n - 1 units with the least first losses can differ in the n best.
            least = self.loss[rows, 1]
            near = np.argpartition(least, n - 2)[: n - 1] if n - 1 < len(least) else np.arange(len(least))
            near = sorted(near[np.isfinite(least[near])].tolist(), key=lambda k: (least[k], k))
            options = [(k, [0.0, *(x for x in self.loss[rows[k], 1:].tolist() if x < math.inf)]) for k in near]
            for extra, choice in _least_sums(options, n)[1:]:
                parts, at = [], 0
                for k, c in sorted(choice):
                    place = self.at[rows[k]]
                    parts += ids[at : end[k] - size[k]], self.ids[place[c] : place[c + 1]]
                    at = end[k]
                out.append((top - extra, np.concatenate([*parts, ids[at:]]).tobytes()))
        return out

    def decode(self, ids) -> str:
        """The text of ids, with runs of byte pieces read as UTF-8."""
        out = bytearray()
        for i in ids:
            b = self.value.get(i)
            out += self.text[i].encode() if b is None else bytes([b])
        text = out.decode("utf-8", "replace").replace(_MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode_packed(self, column: pa.Array) -> pa.Array:
        """The texts of a binary column of packed ids."""
        data, offsets, _ = K.parts(column)
        ids = data[offsets[0] : offsets[-1]].tobytes()
        ids = np.frombuffer(ids, "<u4")
        size = self.raw_size[ids]
        end = np.cumsum(size, dtype=np.int64)
        out = self.raw[np.repeat((self.raw_first[ids] - end + size).astype(np.int32), size) + np.arange(len(ids) and end[-1], dtype=np.int32)]
        at = np.append(0, end)[(offsets - offsets[0]) // 4]
        # The blank before a text, which encoding has put there.
        lead = at[:-1][at[1:] > at[:-1]]
        drop = lead[out[lead] == 32]
        out = np.delete(out, drop)
        at -= np.searchsorted(drop, at)
        raw, first = out.tobytes(), at[:-1][at[1:] > at[:-1]]
        try:
            raw.decode()
            whole = not ((out[first] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if not whole:
            return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        return pa.StringArray.from_buffers(len(column), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(raw))


def _least_sums(options: list[tuple[int, list[float]]], n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n least sums that take one loss (0 first, then ascending) of each option."""
    queue, out, seen = [(0.0, (0,) * len(options))], [], set()
    while queue and len(out) < n:
        loss, pick = heapq.heappop(queue)
        out.append((loss, [(options[i][0], c) for i, c in enumerate(pick) if c]))
        for i, c in enumerate(pick):
            if c + 1 < len(options[i][1]):
                more = pick[:i] + (c + 1,) + pick[i + 1 :]
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(queue, (loss + options[i][1][c + 1] - options[i][1][c], more))
    return out


def load(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, place, score, ids): the ``n`` best segmentations, best (place 1) first.

    ``ids`` is binary: little-endian unsigned 32-bit piece ids.  Fewer rows come
    where a text has fewer segmentations.
    """

    def run(batches):
        model = load(model_path)
        for batch in batches:
            for a, b in K.slices(batch.column(1), 1 << 19):
                part = batch.slice(a, b - a)
                rows = [(k, place, score, data) for k, t in enumerate(part.column(1).to_pylist()) for place, (score, data) in enumerate(model.nbest(t or "", n), 1)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0])), *(pa.array(c, t) for c, t in zip(cols[1:], [pa.int32(), pa.float64(), pa.binary()], strict=True))], ["doc_id", "place", "score", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, place int, score double, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with a column ``text``."""

    def run(batches):
        model = load(model_path)
        for batch in batches:
            for a, b in K.slices(batch.column(batch.schema.get_field_index("ids"))):
                part = batch.slice(a, b - a)
                yield part.append_column("text", model.decode_packed(part.column("ids")))

    return encoded.mapInArrow(run, encoded.schema.simpleString()[7:-1].replace(":", " ") + ", text string")
