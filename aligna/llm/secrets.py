"""Secret scans with DataFrame functions alone: fixed patterns, and sliding-window entropy by character class."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aligna.functions.text import let

# The base patterns. Runs of one class are greedy, so asking for a least length inside the
# pattern gives the same matches as dropping short ones; assign is filtered after matching.
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i)(?:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Least bits a character in a window, by the class of the whole candidate; log2(20) = 4.32 is the most.
CLASSES = [(r"^[0-9a-fA-F]+$", 2.8), (r"^[A-Za-z]+$", 4.1), (r"^[A-Za-z0-9]+$", 3.4), (r"", 3.7)]
#: Candidates that are no secrets: UUIDs and rulers; for entropy, words joined by marks and paths of words too.
ALLOW = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^[-_=+/]+$"
#: Words of placeholders, which clear the characters of a run up to NEAR before and behind them.
WORDS, NEAR = "example|placeholder|changeme|dummy|xxxx|your[_-]", 64
CLEARED = rf"(?i)(?<=(?:{WORDS}).{{0,{NEAR}}}).|.(?=.{{0,{NEAR}}}(?:{WORDS}))|(?:{WORDS})"
JOINED = r"(?i)^[/=_-]*+[a-z]++(?:[-_/=+]++[a-z]++)++[/=_-]*+$|^[/=_-]*+[a-z]++(?:[-_/=+]++[a-z]++)*+[-_/=+]++$"
#: The 200 most frequent pairs of letters in half of some English source code and its comments.
PAIRS = """
ab ac ad ag ai al am an ap ar as at av ax ay ba be bi bj bl bo bu ca ce ch ci ck cl co ct da dd de di do dt du ea ec ed
ee ef eg el em en ep eq er es et ew ex fa ff fi fl fo fr fu ge gi gn gr gs ha he hi ho ia ic id ie if ig il im in io ip
ir is it iv iz ke la ld le lf li ll lo ls lt lu ly ma mb me mi mo mp ms mu na nc nd ne nf ng ni no ns nt nu nv oa ob oc
od ol om on oo op or os ot ou ow pa pe pi pl po pp pr pt py qu ra rc rd re rg ri rk rm rn ro rr rs rt ru ry sa sc se sh
si sk so sp ss st su ta te th ti to tr ts tt tu ty ua ub ue ul um un up ur us ut va ve wa wh wi wr xi xp xt yp ys yt ze
""".split()
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
FOLLOWERS = {a: "".join(sorted({p[1] for p in [*PAIRS, *map("".join, itertools.pairwise(ALPHABET))] if p[0] == a})) for a in ALPHABET}
#: A letter that makes with the next one neither a frequent pair nor a step of the alphabet.
RARE = rf"(?=[a-z]{{2}})(?!{'|'.join(f'{a}[{b}]' for a, b in FOLLOWERS.items() if b)})[a-z]"
#: Least rare pairs and least different characters in a window of a run without digits.
RARE_LEAST, CHARS_LEAST = 7, 9

SPAN = "array<struct<start:bigint,ord:int,end:bigint>>"


def _located(text: Column, pattern: str, build) -> Column:
    """Array of what build(match, start, end) gives for each match, left to right.

    The text's pieces between matches and the matches themselves take turns, so their lengths (code points) sum up
    to the places. build returns an array: empty to drop a match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.cast("long").alias("at"), F.concat(acc["out"], build(x["match"], start.cast("long"), end.cast("long"))).alias("out"))

    zipped = F.filter(F.arrays_zip(between.alias("gap"), found.alias("match")), lambda x: x["match"].isNotNull())
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))
    return F.aggregate(zipped, zero, step, lambda acc: acc["out"])


def _span(ok: Column, start: Column, kind: int, end: Column) -> Column:
    return F.when(ok, F.array(F.struct(start.alias("start"), F.lit(kind).alias("ord"), end.alias("end")))).otherwise(F.array()).cast(SPAN)


def _count(text: Column, char: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


#: A run is searched in pieces of so many windows, so that the work on it grows with its length alone.
PIECE = 236
#: Counts are kept in words of 12 times 5 bits, by the character's place after "+"; "z" is the 80th.
FIRST, PER_WORD, N_WORDS = 43, 12, 7
#: What n * log2(n) gains at n = 1, 2, ...
GAIN = [0.0, *(n * math.log2(n) - (n - 1) * math.log2(n - 1) for n in range(2, WINDOW + 2))]


def _outer(run: Column, inner) -> Column:
    """array(start of the first, end of the last) of the windows of a run that inner finds in its pieces; null: none.

    inner(piece) gives the same for a piece. Each piece goes on for one character less than a window, so that each
    window lies in one. Pieces are searched from the left up to the first find and from the right up to the last.
    """
    heads = F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    none = F.lit(None).cast("array<bigint>")

    def piece(h, p, k):
        return F.struct((k * PIECE).cast("long").alias("at"), F.concat(p, F.coalesce(F.substring(F.get(h, k + 1), 1, WINDOW - 1), F.lit(""))).alias("text"))

    def search(acc, p):
        return F.when(acc.isNull(), let(inner(p["text"]), lambda r: F.when(r.isNotNull(), F.array(p["at"], p["at"] + r[0], p["at"] + r[1])))).otherwise(acc).cast("array<bigint>")

    def both(ps):
        def ends(left):
            right = F.aggregate(F.reverse(F.filter(ps, lambda p: p["at"] > left[0])), none, search)
            return F.when(left.isNotNull(), F.array(left[1], F.coalesce(right[2], left[2])))

        return let(F.aggregate(ps, none, search), ends)

    return let(let(heads, lambda h: F.transform(h, lambda p, k: piece(h, p, k))), both)


def _hot(s: Column, least: Column) -> Column:
    """array(start, end) over a piece's windows with at least that entropy; null: none.

    Each step adds the character that enters or takes away the one that leaves: its count, kept by character in
    packed words, changes by one, and the sum of n * log2(n) by what that gains; entropy = log2(W) - sum / W.
    """
    w = WINDOW

    def event(code, d, i):
        s = F.pmod(code, F.lit(PER_WORD)) * 5
        return F.struct(F.floor(code / PER_WORD).cast("int").alias("w"), s.cast("int").alias("s"), F.lit(d).alias("d"), F.call_function("shiftleft", F.lit(d).cast("long"), s.cast("int")).alias("m"), i.cast("long").alias("i"))

    def events(codes):
        enters = F.transform(codes, lambda c, i: F.when(i >= w, F.array(event(F.get(codes, i - w), -1, F.lit(-1)), event(c, 1, i))).otherwise(F.array(event(c, 1, i))))
        return F.flatten(enters)

    names = [f"w{j}" for j in range(N_WORDS)]
    gain, limit = F.lit(GAIN), w * (math.log2(w) - least) + 2e-11

    def step(acc, e):
        word = F.element_at(F.array(*[acc[x] for x in names]), e["w"] + 1)
        n = F.call_function("shiftright", word, e["s"]).bitwiseAND(F.lit(31)).cast("int")
        total = acc["sum"] + e["d"] * F.element_at(gain, n + F.when(e["d"] > 0, 1).otherwise(0))

        def after(t):
            hot = (e["i"] >= w - 1) & (t <= acc["limit"])
            kept = [F.when(e["w"] == j, acc[x] + e["m"]).otherwise(acc[x]).alias(x) for j, x in enumerate(names)]
            first = F.when(hot & acc["first"].isNull(), e["i"] - (w - 1)).otherwise(acc["first"])
            return F.struct(t.alias("sum"), acc["limit"].alias("limit"), first.alias("first"), F.when(hot, e["i"] + 1).otherwise(acc["last"]).alias("last"), *kept)

        return let(total, after)

    none, nil = F.lit(None).cast("long"), F.lit(0).cast("long")
    zero = F.struct(F.lit(0.0).alias("sum"), limit.cast("double").alias("limit"), none.alias("first"), none.alias("last"), *[nil.alias(x) for x in names])
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c) - FIRST)
    found = F.aggregate(let(codes, events), zero, step, lambda acc: F.when(acc["first"].isNotNull(), F.array(acc["first"], acc["last"])))
    return F.when(F.length(s) >= w, found)


def _rare(s: Column) -> Column:
    """As _hot, for a piece of a run without digits: windows that hold enough rare pairs of letters to be no words."""
    w = WINDOW

    def search(low):
        def windows(x):
            def rare(i):
                pairs = _count(F.substring(x["marked"], i, F.lit(w - 1)), F.lit("1"))
                return (pairs >= RARE_LEAST) & (F.size(F.array_distinct(F.slice(x["chars"], i, w))) >= CHARS_LEAST)

            return F.filter(F.sequence(F.lit(1), F.greatest(F.length(x["marked"]) - w + 1, F.lit(1))), rare)

        starts = let(F.struct(F.regexp_replace(low, RARE, "1").alias("marked"), F.split(low, "").alias("chars")), windows)
        return let(starts, lambda i: F.when(F.size(i) > 0, F.array((F.array_min(i) - 1).cast("long"), (F.array_max(i) - 1 + w).cast("long"))))

    return F.when(F.length(s) >= w, let(F.lower(s), search))


def _named(found: Column) -> Column:
    return let(found, lambda x: F.struct(x[0].alias("first"), x[1].alias("last")))


def hot_range(s: Column, least: Column) -> Column:
    """struct(first, last): start of the first and end of the last window of a run with at least that entropy; null: none.

    The run's characters lie between "+" and "z".
    """
    return _named(let(least, lambda bits: _outer(s, lambda piece: _hot(piece, bits))))


def rare_range(s: Column) -> Column:
    """As hot_range, for windows that hold enough rare pairs of letters to be no words."""
    return _named(_outer(s, _rare))


def _entropy(match: Column, start: Column, end: Column) -> Column:
    least = F.lit(CLASSES[-1][1])
    for pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(match.rlike(pattern), F.lit(bits)).otherwise(least)
    digit = match.rlike("[0-9]")

    def search(run):
        hot = F.when((digit | match.rlike("^[A-Za-z]+$")) & ~match.rlike(JOINED), hot_range(run, least))
        return F.struct(hot.alias("h"), F.when(~digit, rare_range(run)).alias("r"))

    def spans(x):
        first, last = F.least(x["h"]["first"], x["r"]["first"]), F.greatest(x["h"]["last"], x["r"]["last"])
        return _span(first.isNotNull(), start + first, 3, start + last)

    known = F.when(match.rlike(f"(?i){WORDS}"), F.regexp_replace(match, CLEARED, "=")).otherwise(match)
    return F.when(~match.rlike(ALLOW), let(let(known, search), spans)).otherwise(F.array().cast(SPAN))


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with base and spans: arrays of (start, ord, end), ord a place in KINDS, in code points.

    base: matches of the three patterns, each kind leftmost and without overlap. spans: base, and the windows of
    high entropy, or without digits of many rare pairs of letters, in long runs that no base span covers; the
    allow-list takes out runs of known forms, and of others what stands near a placeholder's word. Base spans are
    never dropped. Map-only, no Python; the work on a run grows in proportion to its length. Null and empty texts
    have empty arrays and stay as they are; repeated rows give a row each; all columns stay, those named base or spans
    are replaced; an empty table gives no rows.
    """
    text = F.coalesce(F.col("_t"), F.lit(""))
    none = F.array().cast(SPAN)
    assign = F.when(text.rlike(ASSIGN_HINT), _located(text, ASSIGN, lambda m, a, b: _span(F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12, a, 0, b))).otherwise(none)
    access = F.when(F.contains(text, F.lit("AKIA")), _located(text, ACCESS, lambda m, a, b: _span(F.lit(True), a, 1, b))).otherwise(none)
    hexes = F.when(text.rlike(HEX), _located(text, HEX, lambda m, a, b: _span(F.lit(True), a, 2, b))).otherwise(none)
    runs = F.when(text.rlike(CANDIDATE), _located(text, CANDIDATE, _entropy)).otherwise(none)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_id"), F.col(text_col).alias("_t"))
    out = out.select("_id", "_t", assign.alias("_a"), access.alias("_k"), hexes.alias("_h"), runs.alias("_e"))
    base = F.array_sort(F.concat("_a", "_k", "_h"))
    out = out.select("_id", "_t", base.alias("base"), "_e")
    more = F.filter("_e", lambda e: ~F.exists("base", lambda b: (b["start"] <= e["start"]) & (b["end"] >= e["end"])))
    return out.select(*[F.col("_id").getField(c).alias(c) for c in docs.columns if c not in ("base", "spans")], "base", F.array_sort(F.concat("base", more)).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by the mark."""

    def step(acc, x):
        new = x["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
