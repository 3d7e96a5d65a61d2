"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are lower-cased, and what isn't a letter becomes a blank.  Their UTF-8
bytes are read in stretches of ``STRETCH``, each from a fresh state, by one recurrent layer in each direction
(its input weights are a table, one row per byte value, and its squashing function
is x / (1 + abs(x))); a softmax over both
states labels every position, and a document's probabilities are the mean over
its positions.  The network is trained in numpy by backpropagation through time.

Training uses a bounded sample, about ``per_language`` documents of each language,
with ``windows`` places of each; prediction reads whole texts.

Defined cases: texts that are null or have no letter are ``und`` with score 0, as
is every text when nothing could be learned; ties go to the language first in
order; repeated rows are labelled alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import releasing

STRETCH = 32
_HIDDEN = 8
_BLOCK = 4096
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    if not text.isascii():
        text = re.sub(r"[^\x00-\x7F\w]", " ", text.lower())
    return b" ".join(text.encode().translate(_PLAIN).split())


def stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretches of byte values, their lengths, the text of each)."""
    data = [plain(t) for t in texts]
    n = np.array([len(d) for d in data])
    rows = -(-n // STRETCH)
    flat = np.frombuffer(b"".join(d.ljust(r * STRETCH) for d, r in zip(data, rows.tolist(), strict=True)), np.uint8)
    owner = np.repeat(np.arange(len(data)), rows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows)
    return flat.reshape(-1, STRETCH), np.minimum(STRETCH, n[owner] - place * STRETCH), owner


def _squash(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """x / (1 + abs(x)) in place: like tanh in shape, at a seventh of its cost."""
    y = np.abs(x, out=spare)
    y += 1
    x /= y
    return x


def _gate(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """From 0 to 1, in place."""
    _squash(x, spare)
    x += 1
    x *= 0.5
    return x


class Network:
    """Weights: for each direction, input table X and recurrent U; output V and c."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng, k = np.random.default_rng(seed), 3 * _HIDDEN
        self.languages = languages
        self.w = {f"X{d}": rng.normal(0, 0.3, (256, k)).astype(np.float32) for d in "fb"}
        self.w |= {f"U{d}": rng.normal(0, 0.3, (_HIDDEN, k)).astype(np.float32) for d in "fb"}
        self.w |= {"V": rng.normal(0, 0.3, (2 * _HIDDEN, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}

    def _pass(self, d: str, seq: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, batch, hidden) of one direction; seq is (time, batch)."""
        x, u, n = self.w["X" + d], self.w["U" + d], _HIDDEN
        h = np.zeros((seq.shape[1], n), np.float32)
        out = np.empty((len(seq), seq.shape[1], n), np.float32)
        for t in range(len(seq)) if d == "f" else reversed(range(len(seq))):
            a, r = np.take(x, seq[t], axis=0), h @ u
            gates = _gate(a[:, : 2 * n] + r[:, : 2 * n])
            z, g = gates[:, :n], gates[:, n:]
            new = _squash(a[:, 2 * n :] + g * r[:, 2 * n :])
            if keep is not None:
                keep.append((t, h, z, g, r[:, 2 * n :], new))
            h = new + z * (h - new)
            out[t] = h
        return out

    def positions(self, seq: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Language probabilities (time, batch, language) of every position."""
        states = np.concatenate([self._pass(d, seq, keep.setdefault(d, []) if keep is not None else None) for d in "fb"], axis=2)
        if keep is not None:
            keep["states"] = states
        logits = states.reshape(-1, 2 * _HIDDEN) @ self.w["V"] + self.w["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*seq.shape, -1)

    def gradients(self, seq: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over masked positions, and its gradients by backpropagation through time."""
        keep: dict = {}
        p = self.positions(seq, keep)
        total = mask.sum()
        loss = -(np.log(p[:, np.arange(seq.shape[1]), target] + 1e-9) * mask).sum() / total
        p[:, np.arange(seq.shape[1]), target] -= 1
        p *= (mask / total)[:, :, None].astype(np.float32)
        flat, s = p.reshape(-1, p.shape[2]), keep["states"].reshape(-1, 2 * _HIDDEN)
        g = {"V": s.T @ flat, "c": flat.sum(axis=0)}
        back, n = (flat @ self.w["V"].T).reshape(*seq.shape, -1), _HIDDEN
        for d, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            u, gu, dh, rows, at = self.w["U" + d], np.zeros_like(self.w["U" + d]), 0, [], []
            for t, h, z, r, m, new in reversed(keep[d]):
                dh = dh + part[t]
                da = dh * (1 - z) * (1 - np.abs(new)) ** 2
                dz, dr = (dh * (h - new), da * m)
                dz, dr = (x * 0.5 * (1 - np.abs(2 * y - 1)) ** 2 for x, y in ((dz, z), (dr, r)))
                du = np.concatenate([dz, dr, da * r], axis=1)
                gu += h.T @ du
                rows.append(np.concatenate([dz, dr, da], axis=1))
                at.append(seq[t])
                dh = dh * z + du @ u.T
            rows, at = np.concatenate(rows), np.concatenate(at)
            g["U" + d] = gu
            g["X" + d] = np.stack([np.bincount(at, rows[:, j], 256) for j in range(3 * n)], axis=1).astype(np.float32)
        return float(loss), g

    def train(self, rows: np.ndarray, lengths: np.ndarray, target: np.ndarray, steps: int, batch: int = 256, rate: float = 0.03, seed: int = 5) -> None:
        """Adam over random batches that hold every language alike."""
        rng = np.random.default_rng(seed)
        one, two = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        pools = [np.flatnonzero(target == c) for c in np.unique(target)]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(p, max(1, batch // len(pools))) for p in pools])
            seq = np.ascontiguousarray(rows[pick].T)
            _, g = self.gradients(seq, target[pick], (np.arange(STRETCH)[:, None] < lengths[pick]).astype(np.float32))
            now = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, v in g.items():
                one[k] += 0.1 * (v - one[k])
                two[k] += 0.01 * (v * v - two[k])
                self.w[k] -= now * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)

    def _fast(self, rows: np.ndarray) -> np.ndarray:
        """``positions`` of stretches (batch, time) for prediction: gates apart, buffers used again."""
        n, b = _HIDDEN, len(rows)
        seq = np.ascontiguousarray(rows.T).astype(np.intp)
        logits = np.empty((STRETCH, b, len(self.languages)), np.float32)
        logits[:] = self.w["c"]
        for d, v in (("f", self.w["V"][:n]), ("b", self.w["V"][n:])):
            tables = [np.ascontiguousarray(self.w[k + d][:, i * n : (i + 1) * n]) for k in "XU" for i in range(3)]
            h = np.zeros((b, n), np.float32)
            z, g, new, r, spare = (np.empty((b, n), np.float32) for _ in range(5))
            y = np.empty((b, logits.shape[2]), np.float32)
            for t in range(STRETCH) if d == "f" else reversed(range(STRETCH)):
                for gate, x, u in ((z, tables[0], tables[3]), (g, tables[1], tables[4])):
                    np.take(x, seq[t], axis=0, out=gate, mode="clip")
                    np.matmul(h, u, out=r)
                    gate += r
                    _gate(gate, spare)
                np.take(tables[2], seq[t], axis=0, out=new, mode="clip")
                np.matmul(h, tables[5], out=r)
                r *= g
                new += r
                _squash(new, spare)
                h -= new
                h *= z
                h += new
                np.matmul(h, v, out=y)
                logits[t] += y
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def documents(self, texts: list[str]) -> np.ndarray:
        """Mean probabilities of each text's positions; zeros for a text without letters."""
        rows, lengths, owner = stretches(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for i in range(0, len(rows), _BLOCK):
            n = lengths[i : i + _BLOCK]
            p = self._fast(rows[i : i + _BLOCK])
            part = np.einsum("tbc,tb->bc", p, (np.arange(STRETCH)[:, None] < n).astype(np.float32))
            for c in range(part.shape[1]):
                out[:, c] += np.bincount(owner[i : i + _BLOCK], part[:, c], len(texts))
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=out, where=total > 0)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 400, windows: int = 6, steps: int = 200) -> Network | None:
    """Train on a sample of ``docs``: those of each language with the least hashes of their ids, in expectation ``per_language``."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = named.groupBy(lang_col).count().collect()  # one row for each language
    if not counts:
        return None
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, per_language / n))]), F.col(lang_col))
    size, wide = F.length(text_col), 2 * STRETCH
    start = lambda k: 1 + F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), F.greatest(size - wide, F.lit(1)))
    parts = F.array(*[F.substring(F.col(text_col), start(k).cast("int"), F.lit(wide)) for k in range(windows)])
    share = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit("sample")), 11) / float(1 << 53)
    rows = named.where(share < chance).select(share.alias("share"), F.col(lang_col).alias("lang"), parts.alias("parts")).collect()
    rows.sort(key=lambda r: (r.share, r.lang, r.parts))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    network = Network(languages)
    data, lengths, owner = stretches([p for r in rows for p in r.parts])
    target = np.array([languages.index(r.lang) for r in rows for _ in r.parts])[owner]
    long = lengths >= STRETCH // 2
    if not long.any():
        long[:] = True
    network.train(data[long], lengths[long], target[long], steps)
    return network


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, *keep, lang_pred, score, probs) of whole texts; probs is a map from language to probability."""
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    columns = [id_col, *(keep or [])]
    inner = docs.select(*columns, F.when(has_letter, F.col(text_col)).alias("__t"))
    schema = ", ".join(f"`{c}` {t}" for c, t in inner.dtypes[:-1])

    def run(batches):
        for batch in batches:
            for a, b in K.slices(batch.column(batch.num_columns - 1), 1 << 20):
                part = batch.slice(a, b - a)
                texts = part.column(part.num_columns - 1).to_pylist()
                best, score, probs = [], [], []
                p = network.documents([t or "" for t in texts]) if network else np.zeros((b - a, 0))
                for t, row in zip(texts, p, strict=True):
                    if t is None or not len(row):
                        best.append("und"), score.append(0.0), probs.append([])
                    else:
                        k = int(row.argmax())
                        best.append(network.languages[k]), score.append(min(1.0, float(row[k]))), probs.append([(lang, float(x)) for lang, x in zip(network.languages, row, strict=True)])
                arrays = [*part.columns[:-1], pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(probs, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*part.schema.names[:-1], "lang_pred", "score", "probs"])

    return inner.mapInArrow(releasing(run), schema + ", lang_pred string, score double, probs map<string, double>")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 2 modulo 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2
