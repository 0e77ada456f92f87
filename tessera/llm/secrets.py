"""Secret scans in DataFrame functions only: fixed formats, and sliding-window entropy over candidate strings.

Base kinds are taken leftmost and non-overlapping, each for itself. Positions come from the lengths of the text between
matches, in code points. The entropy kind looks at runs of key-like characters: a window slides by one character, and the
sum of c*log2(c) over its counts changes only by the counts of the character that leaves and of the one that enters. A
run is a span if some window reaches its class's threshold, no allow-list pattern suppresses it and no base span holds it.
Work and memory grow with a text's length, but for the positions of its n matches, which take n * sqrt(n) steps; repeated
groups of patterns are possessive, so no run is long enough for a stack.
Defined cases: a null or empty text has no spans; texts and runs of many megabytes are read whole; rows with a null doc_id
and repeated rows are scanned like any other; an empty table gives no rows; extra columns of the input are carried along
by scan(), one named spans is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character over a window of 20, by class: hexadecimal runs, runs with letters of one case, mixed runs.
LIMITS = {"hex": 3.0, "cased": 3.5, "mixed": 3.8}
#: Runs that look random but are none: numbers, words and identifiers of words, version 1-5 UUIDs, placeholders, alphabets.
ALLOWED = (
    r"^[0-9+/_=-]+$",
    r"^[a-z+/_=-]+$",
    r"^[A-Z+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"^(?:[A-Za-z]++[0-9]{0,2}+[+/_=-])++[A-Za-z]*+[0-9]{0,2}+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|x{8,}",
    r"(?i)0123456789|abcdefghijkl",
)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _let(value: str, name: str, body: str) -> str:
    """SQL of body, in which name stands for value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, join) -> str:
    """SQL of the n + 1 running results over an array of n longs from zero on; join(a, x) is SQL of one step.

    Blocks of sqrt(n) values run each for themselves, then the blocks' ends do: an array is copied when it grows, so one
    run over all values would take n * n steps.
    """
    run = lambda v, x: f"aggregate({v}, array(0L), (a, x) -> array_append(a, {join('element_at(a, -1)', x)}))"
    blocks = f"transform(sequence(0, (size(vs) - 1) div wide), j -> {run('slice(vs, j * wide + 1, wide)', 'x')})"
    ends = run("bs", "element_at(x, -1)")
    whole = f"flatten(zip_with(bs, slice({ends}, 1, size(bs)), (b, o) -> transform(slice(b, 2, size(b) - 1), y -> {join('o', 'y')})))"
    spread = _let("CAST(ceil(sqrt(size(vs))) AS INT)", "wide", _let(blocks, "bs", f"concat(array(0L), {whole})"))
    return _let(values, "vs", f"IF(size(vs) = 0, array(0L), {spread})")


SPAN = "struct<start:int,kind:int,end:int,hit:string>"


def _placed(text: str, pattern: str, hits: str, kind: int) -> str:
    """SQL of an array of (start, kind, end, hit) for the matches `hits` of the pattern in the text."""
    none = f"CAST(array() AS array<{SPAN}>)"
    gaps = f"transform(slice(split({text}, '{_quoted(pattern)}', -1), 1, size({hits})), g -> CAST(length(g) AS BIGINT))"
    sums = _running(f"zip_with(gs, {hits}, (g, h) -> g + length(h))", lambda a, x: f"{a} + {x}")
    begins = f"zip_with(slice({sums}, 1, size(gs)), gs, (s, g) -> CAST(s + g AS INT))"
    found = f"zip_with({begins}, {hits}, (b, h) -> named_struct('start', b, 'kind', {kind}, 'end', b + length(h), 'hit', h))"
    return f"IF(size({hits}) = 0, {none}, CAST({_let(gaps, 'gs', found)} AS array<{SPAN}>))"


def entropy(run: str, window: int = WINDOW) -> str:
    """SQL of the highest Shannon entropy, in bits a character, of the windows of an ASCII run; NULL if it is shorter.

    Step i moves the window by one character: the sum of c * log2(c) changes by the count of the character that leaves,
    taken among the window's, and by that of the one that enters, among those that stay.
    """
    f = "array(" + ", ".join(f"{c * math.log2(c) if c else 0!r}D" for c in range(window + 2)) + ")"
    count = lambda among, c: f"(length({among}) - length(replace({among}, {c}, '')))"
    text = lambda at, n: f"CAST(substring(raw, {at}, {n}) AS STRING)"
    after = f"a.s + {_let(count('stay', 'enters'), 'c', f'{f}[c + 1] - {f}[c]')} - IF(i > {window}, {_let(count('old', 'substring(old, 1, 1)'), 'c', f'{f}[c] - {f}[c - 1]')}, 0D)"
    best = f"IF(i < {window}, a.b, greatest(a.b, {math.log2(window)!r}D - s / {window}))"
    moved = _let(text("i", 1), "enters", _let(f"IF(i > {window}, substring(old, 2), old)", "stay", _let(after, "s", f"named_struct('s', s, 'b', {best})")))
    step = _let(text(f"greatest(i - {window}, 1)", f"least(i - 1, {window})"), "old", moved)
    whole = f"aggregate(sequence(1, octet_length(raw)), named_struct('s', 0D, 'b', 0D), (a, i) -> {step}, a -> a.b)"
    return f"IF(length({run}) < {window}, NULL, {_let(f'CAST({run} AS BINARY)', 'raw', whole)})"


def _unheld() -> str:
    """SQL of the runs of _s3 that no base span holds.

    A hexadecimal or access span holds a run only if it is the run. The runs that an assignment holds are those of its own
    text, placed; places and texts are compared as strings, by hashing.
    """
    coded = lambda at: f"x -> concat(lpad(CAST(x.start + {at} AS STRING), 10, '0'), x.hit)"
    inside = _placed("b.hit", RUN, "hs", 3)
    held = f"flatten(transform(filter(base, b -> b.kind = 0), b -> {_let(f'''regexp_extract_all(b.hit, '{_quoted(RUN)}', 0)''', 'hs', f'transform({inside}, {coded('b.start')})')}))"
    own = f"filter(_s3, x -> NOT x.hit RLIKE '^(?:[0-9a-f]{{24,}}+|AKIA[A-Z0-9]{{16,}}+)$')"
    rest = f"array_except(transform({own}, {coded('0')}), {held})"
    return f"""IF(size(base) = 0 OR size(_s3) = 0, _s3, transform({rest}, c -> named_struct('start', CAST(substring(c, 1, 10) AS INT), 'kind', 3,
        'end', CAST(substring(c, 1, 10) AS INT) + length(c) - 10, 'hit', substring(c, 11))))"""


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED, limits: dict[str, float] | None = None) -> DataFrame:
    """docs with text (null as empty) and spans: an array of (start, kind, end, hit) in order; kind counts KINDS from 0."""
    limits, keep = limits or LIMITS, ["row"]
    like = docs.drop("spans")
    d = carried(like).select("row", _text("text").alias("text"))
    hits = {0: ASSIGN, 1: ACCESS, 2: HEX, 3: RUN}
    d = d.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"_h{k}") for k, p in hits.items()])
    d = d.select(*keep, "text", *[F.expr(_placed("text", p, f"_h{k}", k)).alias(f"_s{k}") for k, p in hits.items()])
    d = d.select(
        *keep, "text", "_s3",
        F.expr(f"concat(filter(_s0, x -> length(regexp_extract(x.hit, '{_quoted(ASSIGN)}', 2)) >= 6), filter(_s1, x -> length(x.hit) >= 20), _s2)").alias("base"),
    )
    suppressed = " OR ".join(f"x.hit RLIKE '{_quoted(p)}'" for p in allowed) or "false"
    d = d.select(*keep, "text", "base", F.expr(f"filter({_unheld()}, x -> NOT ({suppressed}))").alias("runs"))
    limit = f"CASE WHEN x.hit RLIKE '(?i)^[0-9a-f]++$' THEN {limits['hex']}D WHEN x.hit RLIKE '^([^a-z]++|[^A-Z]++)$' THEN {limits['cased']}D ELSE {limits['mixed']}D END"
    d = d.select(*keep, "text", "base", F.expr(f"filter(runs, x -> {entropy('x.hit')} >= {limit} - 1e-9D)").alias("found"))
    d = d.select("row", "text", F.expr("array_sort(concat(base, found))").alias("spans"))
    return d.select(*[F.col("row").getField(c).alias(c) for c in like.columns if c != "text"], "text", "spans")


def named(spans: str, kinds: int) -> Column:
    """kind:start:end, comma-joined, of the spans of the first `kinds` kinds."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform(filter({spans}, x -> x.kind < {kinds}), x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")


def redacted(text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark.

    Pieces are cut from four bytes a character, so that none is looked for from the start of the text.
    """
    cut = lambda at, n: f"decode(substring(raw, 4 * {at} + 1, {n}), 'UTF-32')"
    ends = _running(f"transform({spans}, x -> CAST(x.end AS BIGINT))", lambda a, x: f"greatest({a}, {x})")
    each = f"zip_with({spans}, slice(es, 1, size({spans})), (x, e) -> IF(x.start < e, '', concat({cut('CAST(e AS INT)', '4 * (x.start - CAST(e AS INT))')}, '{mark}')))"
    whole = f"concat(array_join({each}, ''), {cut('CAST(element_at(es, -1) AS INT)', 'octet_length(raw)')})"
    return F.expr(f"IF(size({spans}) = 0, {text}, {_let(f'''encode({text}, 'UTF-32')''', 'raw', _let(ends, 'es', whole))})")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return d.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(named("spans", 3).cast("binary"), 256).alias("base_sha256"), named("spans", 4).alias("spans"),
    )
