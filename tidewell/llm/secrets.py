"""Secret scans by a battery of randomness tests, in DataFrame and SQL functions only.

Three patterns give base spans.  Other runs of 20 or more token characters are candidates, and
so is what base spans leave of such runs.  A candidate's encoding (hex, base32, base64, URL-safe
base64) is the least alphabet that holds its letters, and three tests compare it with
ordinary writing of that encoding, each with a p-value:

* chi-squared alphabet uniformity: the statistic grows with the number of equal pairs of
  letters, of which ordinary writing has more; mean and variance under ordinary letter
  frequencies are exact;
* runs: changes between upper case, lower case, digits and signs, of which ordinary writing
  has fewer;
* serial correlation of neighbouring letters' places in the alphabet: sequences and counters
  have much, random letters hardly any.

What ordinary writing is, the corpus says: letter frequencies are counted over all its texts.
The null hypothesis is letters drawn independently with these frequencies (shuffled
writing), under which each test's score is about standard normal; their sum over the root
of three gives the p-value.  Benjamini-Hochberg control runs within each stratum of encoding
and length, over all candidates of the corpus, on a fixed grid of p-values, so what is
gathered doesn't grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import materialise

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that have 32 letters or more
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: The alphabets of encodings, in the order of their values.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {"hex": DIGITS + "abcdef", "HEX": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base64": UPPER + LOWER + DIGITS + "+/", "url64": UPPER + LOWER + DIGITS + "-_"}
KINDS = ("assign", "access", "hex", "random")
GRID = 20
FDR = 0.001


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str) -> str:
    """SQL: array of (s, m), the code point where each match begins and the match."""
    p = _sql(pattern)
    return f"""case when {text} rlike {p} then aggregate(
        arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)),
        named_struct('at', 0L, 'out', cast(array() as array<struct<s: bigint, m: string>>)),
        (x, y) -> named_struct('at', x.at + length(y.`0`) + coalesce(length(y.`1`), 0),
            'out', if(y.`1` is null, x.out, array_append(x.out, named_struct('s', x.at + length(y.`0`), 'm', y.`1`)))),
        x -> x.out) else cast(array() as array<struct<s: bigint, m: string>>) end"""


def _tail(z: str) -> str:
    """SQL: -log10 of the upper normal tail at z (Mills ratio bound for z > 0, which overstates p)."""
    return f"(case when {z} <= 0 then 0D else ({z} * {z} / 2 + ln(2.5066282746D * ({z} + 1 / ({z} + 1)) )) / 2.302585093D end)"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _tests() -> str:
    """SQL: what the battery counts in candidate c (s, m): encoding, length, equal pairs, changes of class, serial correlation."""
    alphabet = "case e " + " ".join(f"when '{k}' then '{v}'" for k, v in ENCODINGS.items()) + " end"
    body = "named_struct('s', c.s, 'e', c.s + length(c.m), 'enc', e, 'n', length(c.m), 'pairs', pairs, 'changes', changes, 'serial', serial)"
    var = "aggregate(v, 0D, (x, y) -> x + (y - mu) * (y - mu))"
    cov = "aggregate(sequence(1, size(v) - 1), 0D, (x, k) -> x + (v[k] - mu) * (v[k - 1] - mu))"
    body = _let("serial", f"coalesce({cov} / nullif({var}, 0D), 1D)", body)
    body = _let("mu", "aggregate(v, 0D, (x, y) -> x + y) / size(v)", body)
    body = _let("v", f"transform(ch, x -> cast(instr({alphabet}, x) as double))", body)
    body = _let("changes", "aggregate(sequence(1, size(k) - 1), 0, (x, i) -> x + if(k[i] <> k[i - 1], 1, 0))", body)
    body = _let("k", f"split(translate(c.m, '{UPPER}{LOWER}{DIGITS}+/_-', '{'U' * 26}{'L' * 26}{'D' * 10}SSSS'), '')", body)
    body = _let("pairs", "aggregate(array_distinct(ch), 0L, (x, y) -> x + cast(length(c.m) - length(replace(c.m, y, '')) as bigint) * (length(c.m) - length(replace(c.m, y, '')) - 1) div 2)", body)
    body = _let("ch", "split(c.m, '')", body)
    return _let("e", "case when c.m rlike '^[0-9a-f]+$' then 'hex' when c.m rlike '^[0-9A-F]+$' then 'HEX' when c.m rlike '^[A-Z2-7]+$' then 'base32' when c.m rlike '[-_]' then 'url64' else 'base64' end", body)


def _free(text: str) -> str:
    """SQL: parts of 20 or more letters of candidates that no base span covers; a candidate that none overlaps is its own part."""
    starts = "array_append(transform(filter(base, b -> b.s < c.s + length(c.m) and c.s < b.e), b -> b.e), c.s)"
    part = "substring(c.m, cast(x - c.s + 1 as int), cast(coalesce(array_min(transform(filter(base, b -> b.s >= x and b.s < c.s + length(c.m)), b -> b.s)), c.s + length(c.m)) - x as int))"
    parts = f"transform(filter({starts}, x -> x < c.s + length(c.m) and not exists(base, b -> b.s <= x and x < b.e)), x -> named_struct('s', x, 'm', {part}))"
    return f"filter(array_distinct(flatten(transform({text}, c -> if(exists(base, b -> b.s < c.s + length(c.m) and c.s < b.e), {parts}, array(c))))), c -> length(c.m) >= 20)"


def tested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, base, tests, keep...): base spans and the battery's figures for each text (null: empty)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), *[F.col(f"`{c}`").alias(f"keep_{c}") for c in keep])
    rows = rows.select("*", F.expr(f"filter({_matches('t', ASSIGN)}, x -> length(regexp_extract(x.m, {_sql(ASSIGN)}, 2)) >= 8)").alias("assign"), F.expr(f"filter({_matches('t', ACCESS)}, x -> length(x.m) >= 16)").alias("access"), F.expr(_matches("t", HEX)).alias("hex"), F.expr(_matches("t", CANDIDATE)).alias("cand"))
    base = "flatten(array(" + ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.s + length(x.m)))" for i, k in enumerate(KINDS[:3])) + "))"
    rows = rows.withColumn("base", F.expr(f"case when size(assign) + size(access) + size(hex) = 0 then cast(array() as array<struct<s: bigint, k: int, e: bigint>>) else array_sort({base}) end"))
    none = f"cast(array() as {TESTS})"
    return rows.select("id", "base", F.expr(f"case when size(cand) = 0 then {none} else cast(transform({_free('cand')}, c -> {_tests()}) as {TESTS}) end").alias("tests"), *[f"keep_{c}" for c in keep])


TESTS = "array<struct<s: bigint, e: bigint, enc: string, n: int, pairs: bigint, changes: int, serial: double>>"


def letters(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """How often each letter that encodings use occurs in all texts: 66 sums."""
    every = sorted(set("".join(ENCODINGS.values())))
    text = F.col(text_col).cast("string")
    row = docs.agg(*[F.coalesce(F.sum(F.length(text) - F.length(F.replace(text, F.lit(c)))), F.lit(0)).alias(f"n{ord(c)}") for c in every]).first()
    return {c: row[f"n{ord(c)}"] for c in every}


def ordinary(counts: dict[str, int]) -> dict[str, tuple[float, ...]]:
    """For each encoding: chances that two and that three ordinary letters are equal, that neighbours differ in class, and that both neighbours of a letter do.

    Writing in one case uses letters as often as writing in both cases together.
    """
    out = {}
    for name, alphabet in ENCODINGS.items():
        one_case = not set(UPPER + LOWER) <= set(alphabet)
        n = {c: 1 + sum(counts.get(x, 0) for x in ({c.lower(), c.upper()} if one_case else {c})) for c in alphabet}  # a letter never seen counts once
        q = {c: x / sum(n.values()) for c, x in n.items()}
        classes = [sum(q.get(c, 0.0) for c in x) for x in (UPPER, LOWER, DIGITS, "+/_-")]
        out[name] = (sum(x**2 for x in q.values()), sum(x**3 for x in q.values()), 1 - sum(x**2 for x in classes), sum(x * (1 - x) ** 2 for x in classes))
    return out


def _scores(model: dict[str, tuple[float, ...]], x: str = "x") -> dict[str, str]:
    """SQL: the tests' scores of tested candidate x, each about standard normal for ordinary letters, high for random ones."""
    pick = lambda k: f"(case {x}.enc " + " ".join(f"when '{e}' then {v[k]!r}D" for e, v in model.items()) + " end)"
    two, three, change, both = (pick(k) for k in range(4))
    n, possible = f"cast({x}.n as double)", f"({x}.n * ({x}.n - 1) / 2D)"
    spread = f"sqrt({possible} * ({two} * (1 - {two}) + 2 * ({n} - 2) * ({three} - {two} * {two})))"
    vary = f"sqrt(({n} - 1) * {change} * (1 - {change}) + 2 * ({n} - 2) * ({both} - {change} * {change}))"
    serial = f"({x}.serial * {x}.serial * {n})"  # chi-squared with one degree of freedom; its cube root is about normal
    return {
        "uniform": f"(({possible} * {two} - {x}.pairs - 5e-1) / {spread})",
        "runs": f"(({x}.changes - 5e-1 - ({n} - 1) * {change}) / {vary})",
        "serial": f"((7D / 9 - cbrt({serial})) / sqrt(2D / 9))",
    }


def graded(rows: DataFrame, model: dict[str, tuple[float, ...]]) -> DataFrame:
    """rows of tested() with each test as (s, e, stratum, grid): stratum of encoding and length, grid place of the p-value."""
    z = "((" + " + ".join(_scores(model).values()) + ") / sqrt(3D))"
    body = _let("z", z, f"named_struct('s', x.s, 'e', x.e, 'stratum', concat(x.enc, ':', cast(floor(log2(cast(x.n as double))) as int)), 'grid', cast(least(400, floor({GRID} * {_tail('z')})) as int))")
    return rows.withColumn("tests", F.expr(f"transform(tests, x -> {body})"))


def thresholds(rows: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """For each stratum the weakest grid place that Benjamini-Hochberg control at ``fdr`` accepts."""
    seen = rows.select(F.explode("tests").alias("x")).groupBy("x.stratum", "x.grid").agg(F.count(F.lit(1)).alias("n"))
    out: dict[str, int] = {}
    by: dict[str, dict[int, int]] = {}
    for r in seen.collect():  # at most 401 grid places in each of a few dozen strata
        by.setdefault(r["stratum"], {})[r["grid"]] = r["n"]
    for stratum, counts in by.items():
        total, above = sum(counts.values()), 0
        for g in sorted(counts, reverse=True):
            above += counts[g]
            if g and 10 ** (-g / GRID) <= fdr * above / total:
                out[stratum] = g
    return out


def _spans(found: dict[str, int]) -> str:
    """SQL: base and added spans in order."""
    if not found:
        return "base"
    ok = " or ".join(f"(x.stratum = '{k}' and x.grid >= {g})" for k, g in sorted(found.items()))
    return f"case when size(tests) = 0 then base else array_sort(concat(base, transform(filter(tests, x -> {ok}), x -> named_struct('s', x.s, 'k', 3, 'e', x.e)))) end"


def _joined(spans: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_assign, n_access, n_hex, base_sha256, spans).

    Null or empty text: no spans, and the digest of the empty string.  Null and repeated ids
    are kept.  Positions are code points, ends exclusive.  A text of any length is scanned
    whole.  Of candidates that overlap a base span the rest is tested; base spans always stay.
    An empty table gives an empty one.  Other columns aren't read, so their names don't matter.
    """
    rows = graded(materialise(tested(docs, id_col, text_col)), ordinary(letters(docs, text_col)))
    rows = rows.withColumn("all", F.expr(_spans(thresholds(rows))))
    count = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return rows.select(F.col("id").alias(id_col), *count, F.sha2(F.expr(_joined("base")), 256).alias("base_sha256"), F.expr(_joined("all")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by ``mark`` (overlapping spans by one); null texts stay null.

    Texts are scanned once; what was found is kept with them.  Null and repeated ids are kept,
    other columns stay as they are, whatever their names.
    """
    rows = graded(materialise(tested(docs, id_col, text_col, tuple(docs.columns))), ordinary(letters(docs, text_col)))
    rows = rows.withColumn("all", F.expr(_spans(thresholds(rows))))
    text = f"keep_{text_col}"
    cut = f"""case when size(all) = 0 then `{text}` else aggregate(all,
        named_struct('at', 0L, 'out', ''),
        (x, y) -> named_struct('at', greatest(x.at, y.e), 'out', case
            when y.s < x.at then x.out
            else concat(x.out, substring(`{text}`, cast(x.at + 1 as int), cast(y.s - x.at as int)), {_sql(mark)}) end),
        x -> concat(x.out, substring(`{text}`, cast(x.at + 1 as int)))) end"""
    return rows.select(*[F.expr(cut).alias(c) if c == text_col else F.col(f"`keep_{c}`").alias(c) for c in docs.columns])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
