"""Personal data: pattern spans, and a semi-Markov conditional random field over whole candidate segments.

The field scores segments, not characters: features look at a whole span (how many digits in how many groups, its
separators, checksum, neighbours), so boundaries and types are chosen together. A dynamic program over segment ends
tries entities of at most ``Model.longest`` atoms and single atoms outside entities.

An entity holds a digit or an at sign in each of its space-separated parts. A text therefore falls into zones, runs
of such parts, between which everything is outside any entity. Scores do not reach across zones, so the zones' best
segmentations together are the best one of the whole text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, texts

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = len(KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
BLANK = re.compile(r"\s")
ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, leftmost and not overlapping within a kind; failing matches are dropped."""
    out = []
    at, cursor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            cursor = found.end()
        at = text.find("@", max(at + 1, cursor))
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def zones(text: str) -> Iterator[tuple[int, int]]:
    """Longest runs of parts that hold a digit or an at sign, joined by single spaces."""
    held = None
    m = ANCHOR.search(text)
    while m:
        width, p = 64, m.start()
        floor = held[1] if held else 0
        while True:
            low = max(floor, p - width)
            cut = max(map(text[low:p].rfind, " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0  "))
            if cut >= 0 or low == floor:
                break
            width *= 8
        start = low + cut + 1
        stop = BLANK.search(text, p)
        end = stop.start() if stop else len(text)
        if held and start == held[1] + 1 and text[held[1]] == " ":
            held = (held[0], end)
        else:
            if held:
                yield held
            held = (start, end)
        m = ANCHOR.search(text, end)
    if held:
        yield held


def _kind_of(c: str) -> str:
    return "9" if c in "0123456789" else "a" if c.isalpha() else "_" if c.isspace() else c if c in "@.+-()" else "?"


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


def segment_features(text: str, start: int, end: int) -> list[str]:
    """Of the whole span: its shape, counts, checks and both neighbours."""
    span = text[start:end]
    groups = re.findall("[0-9]+", span)
    digits = sum(map(len, groups))
    shape = re.sub(r"(.)\1+", r"\1", "".join(map(_kind_of, span)))[:24]
    numeric = digits and not any(c.isalpha() for c in span)
    out = [
        "bias",
        f"shape:{shape}",
        f"digits:{_bucket(digits, (1, 4, 7, 8, 10, 12, 14, 16, 20))}",
        f"groups:{_bucket(len(groups), (1, 2, 3, 4, 5))}",
        f"dots:{min(span.count('.'), 4)}",
        f"at:{min(span.count('@'), 2)}",
        f"plus:{span[:1] == '+'}:{min(span.count('+'), 2)}",
        f"first:{_kind_of(span[0])}",
        f"last:{_kind_of(span[-1])}",
        f"before:{_kind_of(text[start - 1]) if start else '^'}",
        f"after:{_kind_of(text[end]) if end < len(text) else '$'}",
        f"numeric:{bool(numeric)}:{' ' in span}",
    ]
    if numeric and 16 <= digits <= 19:
        out.append(f"luhn:{luhn(''.join(groups))}")
    if len(groups) == 4 and span.count(".") == 3 and numeric:
        out.append(f"octets:{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    return out


@dataclass
class Model:
    """Weights by feature: one value for each kind and one for outside. ``step``: from a segment's kind to the next
    one's."""

    weights: dict[str, np.ndarray]
    step: np.ndarray
    longest: int = 16


@dataclass(frozen=True)
class Training:
    """The field is fitted on zones of at most ``rows`` documents, labelled by the patterns, and on made-up zones in
    other spellings; both bounds are small, as the weights are few."""

    rows: int = 2000
    zones_per_kind: int = 30
    made_up: int = 168
    epochs: int = 5
    rate: float = 0.3
    seed: int = 5
    longest: int = 16
    widest: int = field(default=48)


class Lattice:
    """All admissible segments of one zone, by end: (start atom, entity allowed, features)."""

    def __init__(self, text: str, start: int, end: int, longest: int):
        self.cuts = [start, *(m.end() for m in ATOM.finditer(text, start, end))]
        self.n = len(self.cuts) - 1
        self.segments: list[list[tuple[int, list[str]]]] = [[]]
        blank = [text[self.cuts[k]].isspace() for k in range(self.n)]
        anchor = [bool(ANCHOR.match(text[self.cuts[k]])) for k in range(self.n)]
        for j in range(1, self.n + 1):
            ends = []
            for i in range(j - 1, max(-1, j - 1 - longest), -1):
                fits = not blank[i] and not blank[j - 1] and any(anchor[i:j])
                if fits or i == j - 1:
                    ends.append((i, fits, segment_features(text, self.cuts[i], self.cuts[j])))
            self.segments.append(ends)


NEVER = -1e9


def _scores(lattice: Lattice, model: Model) -> list[list[tuple[int, np.ndarray]]]:
    none = np.zeros(OUTSIDE + 1)
    out = []
    for ends in lattice.segments:
        row = []
        j = len(out)
        for i, fits, names in ends:
            s = sum((model.weights.get(f, none) for f in names), none)
            if not fits or i < j - 1:
                s = s.copy()
                if not fits:
                    s[:OUTSIDE] = NEVER
                if i < j - 1:
                    s[OUTSIDE] = NEVER
            row.append((i, s))
        out.append(row)
    return out


def best(lattice: Lattice, model: Model) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the entities in the best segmentation."""
    scores = _scores(lattice, model)
    top = np.full((lattice.n + 1, OUTSIDE + 1), NEVER)
    back: list[list[tuple[int, int]]] = [[(0, 0)] * (OUTSIDE + 1) for _ in range(lattice.n + 1)]
    top[0, OUTSIDE] = 0.0
    for j in range(1, lattice.n + 1):
        for i, s in scores[j]:
            come = top[i][:, None] + model.step
            prior = come.argmax(axis=0)
            total = come.max(axis=0) + s
            for y in np.flatnonzero(total > top[j]):
                top[j, y] = total[y]
                back[j][y] = (i, int(prior[y]))
    out, j, y = [], lattice.n, int(top[lattice.n].argmax())
    while j > 0:
        i, prior = back[j][y]
        if y != OUTSIDE:
            out.append((y, lattice.cuts[i], lattice.cuts[j]))
        j, y = i, prior
    return out[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def _gradient(lattice: Lattice, gold: list[tuple[int, int, int]], model: Model) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the log-likelihood of one labelled zone: what the labels have less what the field expects."""
    scores, n = _scores(lattice, model), lattice.n
    forward, backward = np.full((n + 1, OUTSIDE + 1), NEVER), np.full((n + 1, OUTSIDE + 1), NEVER)
    forward[0, OUTSIDE] = 0.0
    backward[n] = 0.0
    for j in range(1, n + 1):
        forward[j] = _log_sum(np.array([_log_sum(forward[i][:, None] + model.step, 0) + s for i, s in scores[j]]), 0)
    follow: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i, s in scores[j]:
            follow[i].append((j, s))
    for i in range(n - 1, -1, -1):
        backward[i] = _log_sum(np.array([_log_sum(model.step + (s + backward[j])[None, :], 1) for j, s in follow[i]]), 0)
    norm = _log_sum(forward[n], 0)
    weights: dict[str, np.ndarray] = {}
    step = np.zeros_like(model.step)

    def add(names: list[str], amount: np.ndarray) -> None:
        for f in names:
            weights[f] = weights.get(f, 0.0) + amount

    for j in range(1, n + 1):
        for (i, _, names), (_, s) in zip(lattice.segments[j], scores[j], strict=True):
            joint = np.exp(forward[i][:, None] + model.step + (s + backward[j])[None, :] - norm)
            step -= joint
            add(names, -joint.sum(axis=0))
    by_end = {e: (k, s) for k, s, e in gold}
    place = {c: k for k, c in enumerate(lattice.cuts)}
    j = n
    path = []
    while j > 0:
        kind, start = by_end.get(lattice.cuts[j], (OUTSIDE, lattice.cuts[j - 1]))
        path.append((place[start], j, kind))
        j = place[start]
    after = OUTSIDE
    for i, j, kind in reversed(path):
        names = next(f for k, _, f in lattice.segments[j] if k == i)
        one = np.zeros(OUTSIDE + 1)
        one[kind] = 1.0
        add(names, one)
        step[after, kind] += 1.0
        after = kind
    return weights, step


def made_up_zones(how: Training) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled zones by rule: entities in spellings that the patterns miss, and numbers that are no entities."""
    rng = random.Random(how.seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        start = "4" + number(14)
        return start + next(d for d in "0123456789" if luhn(start + d))

    def entity(kind: int) -> str:
        if kind == 0:
            name = rng.choice(("sales", "jo", "info", "max", "anna", "web"))
            return f"{name}{rng.choice(('', '.'))}{number(2)}@{rng.choice(('mail', 'post', 'inbox'))}{number(1)}.{rng.choice(('example', 'test'))}.com"
        if kind == 1:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            c, sep = card(), rng.choice(("", " ", "-", "."))
            return sep.join(c[k : k + 4] for k in range(0, 16, 4))
        area, a, b = number(3), number(3), number(4)
        return rng.choice((f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{number(2)} {area} {a} {b}"))

    def plain() -> str:
        return rng.choice(
            (
                number(rng.choice((1, 2, 3, 4, 5, 6, 8, 12))),
                f"{rng.randint(1900, 2099)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                f"{rng.randint(0, 99)}.{number(2)}",
                f"v{number(1)}.{number(1)}.{number(1)}",
                f"{number(2)}:{number(2)}",
                f"{number(40)}",
                f"{number(1)}.",
                f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{number(2)}.{number(2)}",
                f"x{number(4)}ab{number(3)}",
            )
        )

    out = []
    for k in range(how.made_up):
        kind = k % (len(KINDS) + 2)
        if kind >= len(KINDS):
            out.append((" ".join(plain() for _ in range(rng.randint(1, 2))), []))
            continue
        text, tail = entity(kind), rng.choice(("", "", ".", ",", "!!", "###"))
        out.append((text + tail, [(kind, 0, len(text))]))
    return out


def fit(sample: list[str], how: Training) -> Model:
    """Stochastic gradient steps with adaptive rates on the labelled zones of ``sample`` and on the made-up ones."""
    rng = random.Random(how.seed)
    taken = [0] * (OUTSIDE + 1)
    labelled = made_up_zones(how)
    for text in sample:
        spans = base_spans(text)
        for start, end in zones(text):
            if end - start > how.widest:
                continue
            inside = [s for s in spans if start <= s[1] and s[2] <= end]
            if any(a[1] < b[2] and b[1] < a[2] for a in inside for b in inside if a is not b):
                continue
            kind = inside[0][0] if inside else OUTSIDE
            if taken[kind] < how.zones_per_kind:
                taken[kind] += 1
                left, right = max(0, start - 1), min(len(text), end + 1)
                labelled.append((text[left:right], [(k, s - left, e - left) for k, s, e in inside]))
    model = Model({}, np.zeros((OUTSIDE + 1, OUTSIDE + 1)), how.longest)
    data = []
    for text, gold in labelled:
        for start, end in zones(text):
            own = [g for g in gold if start <= g[1] and g[2] <= end]
            lattice = Lattice(text, start, end, how.longest)
            ends = set(lattice.cuts)
            if all(s in ends and e in ends for _, s, e in own) and all(
                any(i == lattice.cuts.index(s) for i, _, _ in lattice.segments[lattice.cuts.index(e)]) for _, s, e in own
            ):
                data.append((lattice, own))
    seen: dict[str, np.ndarray] = {}
    seen_step = np.zeros_like(model.step)
    for _ in range(how.epochs):
        rng.shuffle(data)
        for lattice, gold in data:
            weights, step = _gradient(lattice, gold, model)
            for f, g in weights.items():
                seen[f] = seen.get(f, 1e-2) + g * g
                model.weights[f] = model.weights.get(f, 0.0) * (1 - 1e-4) + how.rate * g / np.sqrt(seen[f])
            seen_step += step * step
            model.step = model.step + how.rate * step / np.sqrt(seen_step + 1e-2)
    return model


def all_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Base spans, and the field's entities that overlap none of them."""
    out = list(base)
    taken = sorted((s, e) for _, s, e in base)
    k = 0
    for start, end in zones(text):
        for kind, s, e in best(Lattice(text, start, end, model.longest), model):
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            near = taken[max(0, k - 4) : k + 8]
            if not any(a < e and s < b for a, b in near):
                out.append((kind, s, e))
    return sorted(out)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def train(docs: DataFrame, how: Training | None = None, text_col: str = "text") -> Model:
    """The field, from a bounded sample of the documents that hold a digit or an at sign. The sample is the texts with
    the smallest hashes, so it does not depend on the order of rows. Hashes are chosen first; only the sample's texts
    reach the driver, each once."""
    how = how or Training()
    short = F.rlike("text", F.lit("[0-9@]")) & (F.length("text") < 20000)
    marked = docs.select(F.col(text_col).alias("text")).where(short).withColumn("hash", F.xxhash64("text"))
    hashes = [r["hash"] for r in marked.select("hash").distinct().orderBy("hash").limit(how.rows).collect()]
    if not hashes:
        return fit([], how)
    sample = marked.where(F.col("hash") <= max(hashes)).groupBy("hash").agg(F.first("text").alias("text"))
    return fit([r["text"] for r in sample.orderBy("hash").collect()], how)


def find_personal_data(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) by kind, then start; code points, ends exclusive.

    A missing or empty text has no spans. Repeated rows and missing ids give one row each; other columns are left
    out. An empty table gives an empty result.
    """
    rows = texts(docs, id_col, text_col)

    def packed(spans: list[list[tuple[int, int, int]]]) -> pa.Array:
        kinds = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row] for row in spans]
        return pa.array(kinds, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text"):
            base, spans = [], []
            for text in batch["text"].to_pylist():
                own = base_spans(text)
                base.append(own)
                spans.append(all_spans(text, own, model) if ANCHOR.search(text) else [])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], packed(base), packed(spans)], ["doc_id", "base", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, base {SPANS}, spans {SPANS}")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans are one, named by the first.
    All columns stay; a missing text stays missing."""

    def clean(text: str | None) -> str | None:
        if text is None or not ANCHOR.search(text):
            return text
        out, cursor = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e in all_spans(text, base_spans(text), model)):
            if start >= cursor:
                out += [text[cursor:start], f"<{KINDS[kind].upper()}>"]
            cursor = max(cursor, end)
        return "".join([*out, text[cursor:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, text_col):
            at = batch.schema.get_field_index(text_col)
            cleaned = pa.array([clean(t) for t in batch[text_col].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], cleaned, *batch.columns[at + 1 :]], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
