"""Secret scans: pattern spans, and stretches of high entropy in long strings. DataFrame functions only.

Spans are found inside each row, without a shuffle. ``split`` and ``regexp_extract_all`` give the stretches between
and in the matches; running sums of their lengths are the positions, in code points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern, the group that must be long enough, and its least length. The patterns for access keys and hex
#: strings state the length themselves: both are runs of one class, so a shorter run can match nowhere inside.
KINDS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        8,
    ),
    "access": (r"AKIA[A-Z0-9]{12,}+", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
}
ENTROPY = "entropy"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
BLOCK = 512


@dataclass(frozen=True)
class EntropyRule:
    """A character class: which candidates and windows belong to it, and the bits a window must reach."""

    name: str
    member: str
    bits: float


@dataclass(frozen=True)
class EntropyScan:
    """Parameters of the entropy scan. A window must reach the bits of the first class that its candidate belongs to,
    or of the first that it belongs to itself. A candidate that a pattern of ``allow`` matches is left alone; a match
    of ``allow_parts`` takes out the windows that it overlaps."""

    window: int = 20
    rules: Sequence[EntropyRule] = field(
        default_factory=lambda: (
            EntropyRule("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.0),
            EntropyRule("mixed", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.7),
            EntropyRule("upper", r"^(?=(?:[^0-9]*[0-9]){2})(?=.*[A-Z])[A-Z0-9+/_=-]+$", 3.6),
            EntropyRule("lower", r"^(?=(?:[^0-9]*[0-9]){2})(?=.*[a-z])[a-z0-9+/_=-]+$", 3.6),
        )
    )
    allow: Sequence[str] = (r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",)
    allow_parts: Sequence[str] = (
        r"(?i)example|placeholder|changeme",
        r"(?i)0123456789|abcdefghij|qwertyuiop",
    )


def _running(sizes: Column) -> Column:
    """Sums of all earlier elements. In blocks, as appending copies an array: linear but for the blocks' totals."""

    def plain(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            xs,
            start,
            lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")),
            lambda a: a["out"],
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(BLOCK)).cast("int")),
        lambda b: F.slice(sizes, b * BLOCK + 1, BLOCK),
    )
    total = F.transform(blocks, lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x))
    bound = F.array(F.struct(blocks.alias("blocks"), plain(total).alias("bases")))
    return F.transform(
        bound,
        lambda s: F.flatten(
            F.transform(s["blocks"], lambda xs, b: F.transform(plain(xs), lambda x: x + F.element_at(s["bases"], b + 1)))
        ),
    )[0]


SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"
RUNS = "array<struct<first:int,last:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, found>> of the leftmost non-overlapping matches."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    bound = F.array(F.struct(gaps.alias("gaps"), found.alias("found")))

    def place(s: Column) -> Column:
        sizes = F.zip_with(s["gaps"], s["found"], lambda g, m: F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0)))
        starts = F.zip_with(_running(sizes), s["gaps"], lambda before, g: before + F.char_length(g))
        placed = F.zip_with(starts, s["found"], lambda at, m: F.struct(at.alias("start"), m.alias("found")))
        return F.slice(placed, 1, F.size(s["found"]))

    return F.transform(bound, place)[0]


def _base(text: Column, kind: str, order: int) -> Column:
    pattern, group, least = KINDS[kind]
    long_enough = (
        (lambda m: F.char_length(F.regexp_extract(m["found"], f"^{pattern}$", group)) >= least)
        if group
        else (lambda m: F.char_length(m["found"]) >= least)
    )
    spans = F.transform(
        F.filter(_matches(text, pattern), long_enough),
        lambda m: F.struct(
            m["start"].cast("int").alias("start"),
            F.lit(order).alias("order"),
            F.lit(kind).alias("kind"),
            (m["start"] + F.char_length(m["found"])).cast("int").alias("end"),
        ),
    )
    return F.when(F.rlike(text, F.lit(pattern)), spans.cast(SPAN)).otherwise(F.array().cast(SPAN))


def _hot_runs(word: Column, taken: Column, scan: EntropyScan) -> Column:
    """array<struct<first, last>>: the runs of windows of ``word`` that reach the bits of a class, from the first
    character of a run's first window to the last one of its last (from 1). Windows that share a character are one
    run. Those that touch an allowed part or a span of ``taken`` (start, end in the word) are in none.

    A window's entropy is log2(w) - sum(c log2 c) / w over its character counts. One step adds a character and takes
    one out, and changes the sum by the two terms alone.
    """
    w = scan.window
    lowest = min((rule.bits for rule in scan.rules), default=math.inf)

    def bits_of(part: Column) -> Column:
        bits = F.lit(math.inf)
        for rule in reversed(scan.rules):
            bits = F.when(F.rlike(part, F.lit(rule.member)), F.lit(rule.bits)).otherwise(bits)
        return bits

    def covered(s: Column, i: Column) -> Column:
        return F.exists(
            s["taken"], lambda m: (m["start"] < i) & (m["end"] > i - w)
        )

    def ended(a: Column) -> Column:
        run = F.array(F.struct(a["first"].alias("first"), a["last"].alias("last")))
        return F.when(a["last"] > 0, F.concat(a["runs"], run.cast(RUNS))).otherwise(a["runs"])

    def term(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))

    def scanned(s: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
            F.lit(0.0).alias("sum"),
            F.lit(0).alias("first"),
            F.lit(0).alias("last"),
            F.array().cast(RUNS).alias("runs"),
        )

        def step(a: Column, i: Column) -> Column:
            new = F.element_at(s["codes"], i)
            old = F.when(i > w, F.element_at(s["codes"], F.greatest(i - w, F.lit(1)))).otherwise(F.lit(0))
            more = F.element_at(a["counts"], new)
            less = F.when(old > 0, F.element_at(a["counts"], F.greatest(old, F.lit(1)))).otherwise(F.lit(0))
            same = old == new
            total = F.when(same, a["sum"]).otherwise(
                a["sum"] + term(more + 1) - term(more) + F.when(old > 0, term(less - 1) - term(less)).otherwise(0.0)
            )
            counts = F.transform(
                a["counts"],
                lambda c, k: c + (k + 1 == new).cast("int") - (k + 1 == old).cast("int"),
            )
            found = F.lit(math.log2(w)) - total / F.lit(float(w)) + F.lit(1e-9)
            window = F.substr(s["word"], i - (w - 1), F.lit(w))
            hot = (found >= s["bits"]) | (found >= bits_of(window))
            # The first two terms are cheap, and the last is not looked at where they fail.
            hit = (i >= w) & (found >= lowest) & hot & ~covered(s, i)
            # One look at ``hit``: its window's end, or 0.
            bound = F.array(F.struct(F.when(hit, i).otherwise(F.lit(0)).alias("end"), a.alias("a")))

            def moved(t: Column) -> Column:
                end, old_run = t["end"], t["a"]
                new_run = (end > 0) & (old_run["last"] <= end - w)
                return F.struct(
                    F.when(new_run, end - (w - 1)).otherwise(old_run["first"]).alias("first"),
                    F.when(end > 0, end).otherwise(old_run["last"]).alias("last"),
                    F.when(new_run, ended(old_run)).otherwise(old_run["runs"]).alias("runs"),
                )

            run = F.transform(bound, moved)[0]
            return F.transform(
                F.array(run),
                lambda r: F.struct(
                    counts.alias("counts"), total.alias("sum"), r["first"].alias("first"), r["last"].alias("last"), r["runs"].alias("runs")
                ),
            )[0]

        return F.aggregate(
            F.sequence(F.lit(1), F.size(s["codes"])),
            start,
            step,
            ended,
        )

    codes = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    parts = F.transform(
        _matches(word, "|".join(f"(?:{p})" for p in scan.allow_parts) or "(?!)"),
        lambda m: F.struct(m["start"].cast("int").alias("start"), (m["start"] + F.char_length(m["found"])).cast("int").alias("end")),
    )
    bound = F.array(
        F.struct(codes.alias("codes"), bits_of(word).alias("bits"), word.alias("word"), F.concat(parts, taken).alias("taken"))
    )
    return F.transform(bound, scanned)[0]


def _entropy(text: Column, base: Column, scan: EntropyScan) -> Column:
    allowed = "|".join(f"(?:{p})" for p in scan.allow) or "(?!)"
    kept = F.filter(_matches(text, CANDIDATE), lambda m: ~F.rlike(m["found"], F.lit(allowed)))

    def spans(m: Column) -> Column:
        end = m["start"] + F.char_length(m["found"])
        taken = F.transform(
            F.filter(base, lambda b: (b["start"] < end) & (b["end"] > m["start"])),
            lambda b: F.struct((b["start"] - m["start"]).cast("int").alias("start"), (b["end"] - m["start"]).cast("int").alias("end")),
        )
        return F.transform(
            _hot_runs(m["found"], taken, scan),
            lambda h: F.struct(
                (m["start"] + h["first"] - 1).cast("int").alias("start"),
                F.lit(len(KINDS)).alias("order"),
                F.lit(ENTROPY).alias("kind"),
                (m["start"] + h["last"]).cast("int").alias("end"),
            ),
        )

    found = F.flatten(F.transform(kept, spans))
    return F.when(F.rlike(text, F.lit(CANDIDATE)), found.cast(SPAN)).otherwise(F.array().cast(SPAN))


def find_secrets(
    docs: DataFrame, scan: EntropyScan | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, order, kind, end) sorted by start and kind, ends exclusive.

    ``base`` holds the pattern spans. ``spans`` adds runs of windows of high entropy that touch none of them; two keys
    with plain text between them are two spans, and a key right behind a pattern span is one of its own. A missing
    or empty text has no spans. Repeated rows and missing ids give one row each; other columns are left out.
    """
    scan = scan or EntropyScan()
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(*(_base(text, kind, k) for k, kind in enumerate(KINDS))))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), base.alias("base"))
    more = _entropy(F.col("text"), F.col("base"), scan)
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
