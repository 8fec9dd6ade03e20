"""Secret scan: fixed patterns plus sliding-window Shannon entropy, in DataFrame functions only.

Patterns ``assign``, ``access`` and ``hex`` are matched leftmost and non-overlapping, each over the whole text. Positions come
from the texts between matches (``split``) and the matches themselves (``regexp_extract_all``), both by one regular
expression, so lengths add up to offsets in code points.

Candidate strings are maximal runs of a character class. A window slides over each; per step one count grows and one
shrinks, and the sum of c * log2(c), in integers scaled by 1e6, follows from a table, so a window's entropy never needs a
recount. Windows at or over the class's threshold merge into ``entropy`` spans. A candidate is suppressed when the allow-list
matches it or when it lacks letters or digits; a span inside a pattern's span is not repeated.

Defined cases: null texts count as empty and have no spans; repeated rows give repeated, equal results; ids pass through,
null ones too; an empty table gives an empty result; extra columns are kept unless they are named ``spans``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE, WINDOW = 6, 20
ALLOW = r"(?i)example|sample|dummy|placeholder|changeme|redacted|0123456789|abcdefghij|(.)\1{7}|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
SCALE = 1_000_000


@dataclass(frozen=True)
class CharClass:
    """Candidate strings of one alphabet and the bits per character from which a window counts as random."""

    alphabet: str
    members: str
    threshold: float

    @property
    def pattern(self) -> str:
        return rf"(?<![{self.members}])[{self.members}]{{{WINDOW},}}"


CLASSES = (
    CharClass("0123456789abcdef", "0-9a-f", 3.0),
    CharClass("0123456789ABCDEF", "0-9A-F", 3.0),
    CharClass("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "A-Za-z0-9+/_=-", 3.9),
)
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _no_spans() -> Column:
    return F.array().cast(_SPANS)


def _span(start: Column, kind: int | Column, end: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"))


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """array<start, kind, end, value> of all matches; value is the group."""
    lit = F.lit(pattern)
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, lit, F.lit(group))
    parts = F.arrays_zip(gaps.alias("g"), whole.alias("m"), value.alias("v"))
    kind_of = "array<struct<start:int,kind:int,end:int,value:string>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["g"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        hit = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["v"].alias("value")))
        return F.struct(
            end.alias("at"), F.when(x["m"].isNotNull(), F.concat(state["found"], hit)).otherwise(state["found"]).alias("found")
        )

    return F.aggregate(parts, zero, step, lambda s: s["found"])


def _entropy_windows(value: Column, start: Column, cls: CharClass, window: int) -> Column:
    """Merged spans of the windows of value that reach the class's threshold."""
    table = F.array(*[F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("bigint") for c in range(window + 2)])
    most = math.floor(SCALE * window * (math.log2(window) - cls.threshold))
    codes = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(cls.alphabet), ch))
    steps = F.transform(
        codes, lambda ch, i: F.struct(ch.alias("enters"), i.alias("i"))
    )
    zero = F.struct(
        F.array_repeat(F.lit(0), len(cls.alphabet) + 1).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
        F.lit(-1).alias("a"), F.lit(-1).alias("b"), _no_spans().alias("found"),
    )

    def fold(codes: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            enters = x["enters"]
            leaves = F.when(x["i"] >= window, F.get(codes, x["i"] - window)).otherwise(F.lit(0))
            inn, out = F.get(state["counts"], enters), F.get(state["counts"], leaves)
            gain = F.get(table, inn + 1) - F.get(table, inn)
            loss = F.when(leaves > 0, F.get(table, out) - F.get(table, out - 1)).otherwise(F.lit(0).cast("bigint"))
            total = F.when(enters == leaves, state["sum"]).otherwise(state["sum"] + gain - loss)
            counts = F.transform(
                state["counts"], lambda c, j: c + F.when(j == enters, 1).otherwise(0) - F.when((j == leaves) & (leaves > 0), 1).otherwise(0)
            )
            return F.struct(counts.alias("counts"), total.alias("sum"), *_grown(state, x["i"], total))

        def _grown(state: Column, i: Column, total: Column) -> list[Column]:
            hit = (i >= window - 1) & (total <= most)
            joins = state["b"] >= i - (window - 1)
            opened = F.when(hit & ~joins, i - (window - 1)).otherwise(state["a"])
            closed = F.when(hit, i + 1).otherwise(state["b"])
            pushed = F.when(
                hit & ~joins & (state["b"] >= 0), F.concat(state["found"], F.array(_span(start + state["a"], 3, start + state["b"])))
            ).otherwise(state["found"])
            return [opened.alias("a"), closed.alias("b"), pushed.alias("found")]

        def last(s: Column) -> Column:
            return F.when(s["b"] >= 0, F.concat(s["found"], F.array(_span(start + s["a"], 3, start + s["b"])))).otherwise(s["found"])

        return F.aggregate(steps, zero, step, last)

    # a one-element transform binds the codes, so that they are computed once per candidate
    return F.flatten(F.transform(F.array(codes), fold))


def _entropy_spans(text: Column, cls: CharClass, window: int, allow: str) -> Column:
    candidates = F.filter(
        _matches(text, cls.pattern, 3),
        lambda c: c["value"].rlike("[0-9]") & c["value"].rlike("[A-Za-z]") & ~c["value"].rlike(allow),
    )
    return F.flatten(F.transform(candidates, lambda c: _entropy_windows(c["value"], c["start"], cls, window)))


def scan_secrets(
    docs: DataFrame, text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, window: int = WINDOW, allow: str = ALLOW
) -> DataFrame:
    """docs with ``spans``: array of (start, kind, end), kind an index into KINDS, sorted. No shuffle, no Python."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = lambda found: F.transform(found, lambda m: _span(m["start"], m["kind"], m["end"]))
    assigned = F.filter(_matches(text, ASSIGN, 0, 2), lambda m: F.length(m["value"]) >= MIN_VALUE)
    base = F.concat(
        F.when(text.rlike("(?i)password|passwd|secret|token|api_?key"), plain(assigned)).otherwise(_no_spans()),
        F.when(text.contains("AKIA"), plain(_matches(text, ACCESS, 1))).otherwise(_no_spans()),
        F.when(F.col("__pg_run"), plain(_matches(text, HEX, 2))).otherwise(_no_spans()),
    )
    any_run = rf"(?<![{CLASSES[-1].members}])[{CLASSES[-1].members}]{{{WINDOW},}}"
    entropy = F.when(
        F.col("__pg_run") if classes is CLASSES and window >= WINDOW else F.lit(True),
        F.array_distinct(F.concat(*[_entropy_spans(text, c, window, allow) for c in classes])),
    ).otherwise(_no_spans())
    kept = [c for c in docs.columns if c != "spans"]
    found = docs.select(*kept, text.rlike(any_run).alias("__pg_run")).select(*kept, base.alias("__pg_base"), entropy.alias("__pg_more"))
    added = F.filter(
        F.col("__pg_more"),
        lambda e: ~F.exists(F.col("__pg_base"), lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])),
    )
    return found.select(*kept, F.array_sort(F.concat(F.col("__pg_base"), added)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secret_digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned.select(
        F.col(id_col).alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
