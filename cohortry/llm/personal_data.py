"""Personal data in texts: patterns, and a character-level BiLSTM with CRF transitions for what they miss.

The patterns give the base spans. The tagger, trained in numpy on labelled spans, reads
overlapping windows around marks (digits and at signs, without which no span exists). Every
window is decoded by itself; the spans of all windows of a text are then reconciled: parts
of one span found in different windows are united, each must have the form of its kind, and
none may overlap a base span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.labelled_spans import KINDS, example, luhn
from cohortry.llm.shared import in_tasks, portions, spread_rows, with_fields

TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
WINDOW = 96
STEP = 48
MARGIN = 32
BATCH = 512
MARK = re.compile(r"[0-9@]|[(\[]at[)\]]")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number that fails from its first digit fails from the others too, so one try a number is enough.
NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]|\([0-9]{2,4}\) ?[0-9]{2,4}[ .-][0-9]{2,5}|[0-9]{2,4}([.-])[0-9]{2,4}\1[0-9]{2,5}"),
}

Span = tuple[str, int, int]


def fits(kind: str, found: str) -> bool:
    """Whether numbers have the sizes and check digits of their kind."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[Span]:
    """From one at sign to the next; the name is what can stand before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at + 1)
        if found:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield "email", start, found.end()
                done = found.end()
        at = text.find("@", at + 1)


def numbers(text: str) -> Iterator[tuple[Span, bool]]:
    """Matches of the other patterns, and whether they pass."""
    for kind, pattern in (("ip", NUMBERS), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            yield (kind, *m.span()), fits(kind, m.group())


def base(text: str) -> list[Span]:
    """Base spans by kind and start; the time is linear in the text."""
    return [*emails(text), *(span for span, passes in numbers(text) if passes)]


#: Characters the tagger tells apart; 0 is beyond the end, 1 any white space, 2 and 3 other letters and the rest.
ALPHABET = {chr(c): c - 0x21 + 4 for c in range(0x21, 0x7F)}
SIZE = len(ALPHABET) + 4


def letters(text: str) -> list[int]:
    return [ALPHABET.get(c) or (1 if c.isspace() else 2 if c.isalpha() else 3) for c in text]


@dataclass(frozen=True)
class TaggerSpec:
    """``sample`` bounds the texts that give plain words and base spans to learn from, ``examples`` the made-up ones."""

    sample: int = 400
    examples: int = 2_000
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    embedding: int = 12
    hidden: int = 24
    seed: int = 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Embeddings, one LSTM a direction, tag scores, and a CRF over the tags of a window."""

    def __init__(self, spec: TaggerSpec):
        rng, e, h, k = np.random.default_rng(spec.seed), spec.embedding, spec.hidden, len(TAGS)
        part = lambda *shape: (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"emb": part(SIZE, e) * 3, "out": part(2 * h, k), "out_b": np.zeros(k, np.float32), "move": np.zeros((k, k), np.float32), "start": np.zeros(k, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": part(e, 4 * h), f"u{side}": part(h, 4 * h), f"b{side}": np.repeat([0, 1, 0, 0], h).astype(np.float32)}
        self.hidden = h

    def _lstm(self, ids: np.ndarray, side: str, keep: bool):
        """Hidden states by place, of one direction; ``keep`` what the way back needs."""
        h, n, t = self.hidden, *ids.shape
        inputs = self.p["emb"] @ self.p["w" + side] + self.p["b" + side]
        states, kept = np.empty((t, n, h), np.float32), []
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for at in range(t) if side == "f" else range(t - 1, -1, -1):
            z = inputs[ids[:, at]] + state @ self.p["u" + side]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o, g = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :], np.tanh(z[:, 3 * h :])
            before, cell = cell, f * cell + i * g
            bent = np.tanh(cell)
            if keep:
                kept.append((at, i, f, o, g, before, bent, state))
            state = o * bent
            states[at] = state
        return states, kept

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (place, window, tag)."""
        forward, kept_f = self._lstm(ids, "f", keep)
        backward, kept_b = self._lstm(ids, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return both @ self.p["out"] + self.p["out_b"], both, {"f": kept_f, "b": kept_b}

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags of all windows, and its gradients."""
        (n, t), h = ids.shape, self.hidden
        scores, both, kept = self.emissions(ids, keep=True)
        move, start, rows = self.p["move"], self.p["start"], np.arange(n)
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = start + scores[0]
        for at in range(1, t):
            alpha[at] = _logsum(alpha[at - 1][:, :, None] + move, 1) + scores[at]
        for at in range(t - 2, -1, -1):
            beta[at] = _logsum(move + (scores[at + 1] + beta[at + 1])[:, None, :], 2)
        total = _logsum(alpha[-1], 1)
        g_scores = np.exp(alpha + beta - total[None, :, None])
        g_start = g_scores[0].sum(axis=0)
        # pairs of neighbouring tags: those expected, less those that are there
        k = len(move)
        pairs = alpha[:-1, :, :, None] + move + (scores[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        g_move = np.exp(pairs).sum(axis=(0, 1))
        g_move -= np.bincount((tags[:, :-1] * k + tags[:, 1:]).reshape(-1), minlength=k * k).reshape(k, k)
        gold = start[tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        places = (np.arange(t)[:, None], rows[None, :], tags.T)
        gold = gold + scores[places].sum(axis=0)
        g_scores[places] -= 1
        g_start -= np.bincount(tags[:, 0], minlength=k)
        grads = {"move": g_move, "start": g_start, "out": np.einsum("tnh,tnk->hk", both, g_scores), "out_b": g_scores.sum(axis=(0, 1)), "emb": np.zeros_like(self.p["emb"])}
        g_both = (g_scores @ self.p["out"].T).astype(np.float32)
        order = np.argsort(ids.T, axis=None, kind="stable")
        present, firsts = np.unique(ids.T.reshape(-1)[order], return_index=True)
        for k, side in enumerate("fb"):
            u, w = self.p["u" + side], self.p["w" + side]
            g_state, g_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            g_u, moved = np.zeros_like(u), np.empty((t, n, 4 * h), np.float32)
            for at, i, f, o, g, before, bent, state in reversed(kept[side]):
                g_h = g_both[at, :, k * h : (k + 1) * h] + g_state
                g_cell = g_cell + g_h * o * (1 - bent**2)
                z = np.concatenate([g_cell * g * i * (1 - i), g_cell * before * f * (1 - f), g_h * bent * o * (1 - o), g_cell * i * (1 - g**2)], axis=1)
                g_u += state.T @ z
                moved[at] = z
                g_state, g_cell = z @ u.T, g_cell * f
            g_inputs = np.zeros((SIZE, 4 * h), np.float32)
            g_inputs[present] = np.add.reduceat(moved.reshape(-1, 4 * h)[order], firsts)
            grads |= {"u" + side: g_u, "w" + side: self.p["emb"].T @ g_inputs, "b" + side: g_inputs.sum(axis=0)}
            grads["emb"] += g_inputs @ w.T
        return float((total - gold).mean()), {name: g / n for name, g in grads.items()}

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of every window."""
        scores, _, _ = self.emissions(ids)
        t, n, _ = scores.shape
        best, back = self.p["start"] + scores[0], np.empty(scores.shape, np.int8)
        for at in range(1, t):
            ways = best[:, :, None] + self.p["move"]
            back[at] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[at]
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for at in range(t - 1, 0, -1):
            tags[:, at - 1] = back[at][np.arange(n), tags[:, at]]
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def laid_out(texts: list[str]) -> np.ndarray:
    ids = np.zeros((len(texts), WINDOW), np.int16)
    for row, text in zip(ids, texts):
        found = letters(text[:WINDOW])
        row[: len(found)] = found
    return ids


def tagged(length: int, spans: list[Span]) -> list[int]:
    tags = [0] * length
    for kind, a, b in spans:
        inside = 2 + 2 * KINDS.index(kind)
        for at in range(a, min(b, length)):
            tags[at] = inside - (at == a)
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    """Runs of one kind; a beginning starts anew."""
    found: list[list] = []
    last = -1
    for at in np.flatnonzero(tags).tolist():
        kind, begins = (int(tags[at]) - 1) // 2, tags[at] % 2 == 1
        if found and not begins and last == at - 1 and found[-1][0] == KINDS[kind]:
            found[-1][2] = at + 1
        else:
            found.append([KINDS[kind], at, at + 1])
        last = at
    return [tuple(s) for s in found]


def train(texts: list[tuple[str, list[Span]]], spec: TaggerSpec) -> Tagger:
    """Adam steps over labelled windows."""
    tagger, rng = Tagger(spec), np.random.default_rng(spec.seed + 1)
    ids = laid_out([t for t, _ in texts])
    tags = np.asarray([tagged(WINDOW, s) for _, s in texts], np.int64)
    first = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    second = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    step, steps = 0, spec.epochs * -(-len(texts) // spec.batch)
    for _ in range(spec.epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), spec.batch):
            rows = order[a : a + spec.batch]
            loss, grads = tagger.loss(ids[rows], tags[rows])
            step += 1
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            rate, shrink = spec.rate * (1 - 0.95 * step / steps), min(1.0, 20.0 / max(size, 1e-9))
            for k, g in grads.items():
                first[k] += 0.1 * (g * shrink - first[k])
                second[k] += 0.001 * ((g * shrink) ** 2 - second[k])
                tagger.p[k] = (tagger.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tagger


def windows(text: str) -> list[tuple[int, str]]:
    """Overlapping windows (start, text) over everything within ``MARGIN`` of a mark."""
    regions: list[list[int]] = []
    for m in MARK.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    return [(s, text[s : min(s + WINDOW, b)]) for a, b in regions for s in range(a, max(a + 1, b - WINDOW + STEP), STEP)]


def reconciled(text: str, found: list[Span], kept: list[Span]) -> list[Span]:
    """Spans beyond ``kept`` from those of all windows: united, of the form of their kind, apart from each other."""
    chosen: list[Span] = []
    for kind in KINDS:
        united: list[list] = []
        for a, b in sorted((a, b) for k, a, b in found if k == kind):
            if united and a < united[-1][1]:
                united[-1][1] = max(b, united[-1][1])
                united[-1][2].append((a, b))
            else:
                united.append([a, b, [(a, b)]])
        for a, b, parts in united:
            for part in [(a, b), *(sorted(set(parts)) if len(parts) > 1 else [])]:
                settled = _settled(kind, text, *part)
                if settled:
                    chosen.append((kind, *settled))
                    if part == (a, b):
                        break
    out: list[Span] = []
    taken = sorted((a, b) for _, a, b in kept)
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.empty(0, np.int64)
    starts = np.asarray([a for a, _ in taken])
    last = 0
    for kind, a, b in sorted(chosen, key=lambda s: (s[1], -s[2])):
        before = int(np.searchsorted(starts, b)) if taken else 0
        if a >= last and not (before and reach[before - 1] > a):
            out.append((kind, a, b))
            last = b
    return out


#: Moves of the two ends of a span, small ones first.
MOVES = sorted(((x, y) for x in range(-2, 3) for y in range(-2, 3)), key=lambda m: (abs(m[0]) + abs(m[1]), m))


def _settled(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The span whose ends lie nearest to those decoded, at most two places off, that has the form of its kind and cuts no number (an email address: no word)."""
    of_run = str.isalnum if kind == "email" else str.isdigit
    for x, y in MOVES:
        low, high = max(0, a + x), min(len(text), b + y)
        before, after = text[low - 1 : low] if low else "", text[high : high + 1]
        cut = (of_run(text[low : low + 1]) and of_run(before)) or (of_run(text[high - 1 : high]) and of_run(after))
        if low < high and not cut and FORMS[kind].fullmatch(text, low, high) and fits(kind, text[low:high]):
            return low, high
    return None


def added(tagger: Tagger, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """What the tagger adds to the base spans of every text. Equal windows are read once."""
    cut = [windows(t) for t in texts]
    known: dict[str, list[Span]] = {}
    every = list({w: None for ws in cut for _, w in ws})
    for a in range(0, len(every), BATCH):
        part = every[a : a + BATCH]
        tags = tagger.decode(laid_out(part))
        known.update(zip(part, [[(k, s, min(e, len(w))) for k, s, e in spans_of(t) if s < len(w)] for t, w in zip(tags, part)]))
    return [
        reconciled(t, [(k, s + at, e + at) for at, w in ws for k, s, e in known[w]], kept) if ws else []
        for t, ws, kept in zip(texts, cut, bases)
    ]


def fit(docs: DataFrame, spec: TaggerSpec = TaggerSpec()) -> Tagger:
    """Train on the base spans of at most ``spec.sample`` texts with marks, chosen by hash, and on made-up spans set between their words.

    One window of at most ``WINDOW`` characters per text reaches the driver. Windows with
    a number that a pattern met but that failed are left out: their labels are not known.
    """
    marked = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64("text", F.lit(spec.seed)).alias("h"), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, 4_000_000):
            rows = [(h, windows(t)) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            picked = [(h, ws[h % len(ws)][1], t) for (h, ws), t in zip(rows, batch.column(1).to_pylist())]
            plain = [t[h % len(t) :][:WINDOW] for h, _, t in picked]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in picked], pa.int64()), pa.array([w for _, w, _ in picked]), pa.array(plain)], names=["h", "window", "plain"])

    got = in_tasks(marked, task, "h bigint, window string, plain string").distinct().orderBy("h", "window").limit(spec.sample).collect()
    rng = np.random.default_rng(spec.seed)
    texts = []
    for r in got:
        if not any(not passes and (kind != "card" or len(re.sub("[^0-9]", "", r["window"][a:b])) >= 13) for (kind, a, b), passes in numbers(r["window"])):
            clear: list[Span] = []
            for span in sorted(base(r["window"]), key=lambda s: (s[1], -s[2])):
                if not clear or span[1] >= clear[-1][2]:
                    clear.append(span)
            texts.append((r["window"], clear))
    plain = [r["plain"] for r in got if not MARK.search(r["plain"])]
    texts += [example(rng, plain) for _ in range(spec.examples)]
    return train(texts, spec)


def find(docs: DataFrame, tagger: Tagger, redact: bool = False) -> DataFrame:
    """``docs`` with ``spans``: (kind, start, end, base) in code points, by kind as in KINDS, then start.

    Whole texts are read; null and empty texts have no spans. Very long texts are cut into
    windows like all others, in time linear in their length, and so are equal texts. Base
    spans always stay; spans of different kinds may overlap there. With ``redact`` the text
    with every span replaced by its kind in brackets follows as ``redacted`` (null stays
    null). Columns of these names are replaced, all others stay. Empty tables give no rows.
    """
    docs = docs.drop("spans", "redacted")
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index("text")
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = sent.value
        for batch in portions(batches, at, 4_000_000):
            column = batch.column(at)
            marked = np.flatnonzero(np.asarray(pc.match_substring_regex(column.fill_null(""), r"[0-9@]|[(\[]at[)\]]")))
            texts = column.take(pa.array(marked)).to_pylist()
            bases = [base(t) for t in texts]
            rows: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, kept, more in zip(marked.tolist(), bases, added(tagger, texts, bases)):
                both = [(KINDS.index(k), a, b, True) for k, a, b in kept] + [(KINDS.index(k), a, b, False) for k, a, b in more]
                rows[row] = [{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted(both)]
            columns = [*batch.columns, pa.array(rows, pa.list_(kind))]
            if redact:
                hidden = dict(zip(marked.tolist(), [redacted(t, rows[r]) for r, t in zip(marked.tolist(), texts)]))
                columns.append(pa.array([hidden.get(k, t) for k, t in enumerate(column.to_pylist())], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "spans", *(["redacted"] if redact else [])])

    fields = "spans array<struct<kind: string, start: int, end: int, base: boolean>>" + (", redacted string" if redact else "")
    return in_tasks(spread_rows(docs, "text"), task, with_fields(docs, fields))


def redacted(text: str, spans: list[dict]) -> str:
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
