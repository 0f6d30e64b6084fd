"""The source divergence audit against plain Python integers."""

import random
import re
from collections import Counter, defaultdict

from tidewell.llm import divergence as D


def brute(rows, min_df, top):
    """(lang, source, part, item, value, rank) by the definition."""
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for lang, source, text in rows]
    df, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        sources[lang].add(source)
        df[lang].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= min_df) for lang, c in df.items()}
    for lang, source, terms in docs:
        for t in terms:
            if df[lang][t] >= min_df:
                count[lang, source][t] += 1
                count[lang, None][t] += 1
    p = lambda c, t, v: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c.values()) + 2 * v)
    f = lambda a, b: (a - b) ** 2 // (a + b)
    out = []
    for lang, ss in sources.items():
        v = len(kept[lang])
        for s in ss:
            pairs = [(sum(f(p(count[lang, s], t, v), p(count[lang, o], t, v)) for t in kept[lang]), o) for o in ss if o != s]
            terms = [(f(a, b), t) for t in kept[lang] if count[lang, s][t] and (a := p(count[lang, s], t, v)) > (b := p(count[lang, None], t, v))]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(items[:most])]
    return sorted(out)


def made(seed=3, n=120):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "épée", "ÉPÉE", "日本", "𝒳y", "of", "the", "zeta", "eta"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", "", None]), rng.choice(["a", "b", "B", "ä", "", None])
        rows.append((lang, source, " ".join(rng.choice(words[: 4 + len(source or "x") * 7]) + rng.choice(["", "1", "-x", "\n"]) for _ in range(rng.randint(0, 30)))))
    rows += [rows[0]] * 5 + [("fr", "a", "rare words only"), ("fr", "b", None), ("xx", "a", "1 2 3"), ("en", "none", None), ("en", "none2", ""), ("yy", "only", "word " * 12)]
    rows += [("en", "long", "the épée " * 60_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as terms", "2 as idx", "3 as count", "4 as doc_id").repartition(4)


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_audit(spark):
    rows = made()
    for min_df, top in ((10, 10), (3, 2)):
        out = D.audit(frame(spark, rows), min_df=min_df, top=top)
        assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert collected(out) == brute(rows, min_df, top)


def test_sources_in_parts_and_flushed_sums(spark, monkeypatch):
    rows = made(4, 80)
    want = brute(rows, 3, 10)
    monkeypatch.setattr(D, "CELLS", 8)  # two sources or fewer at once
    assert collected(D.audit(frame(spark, rows), min_df=3)) == want


def test_counts_beyond_long(spark):
    df = spark.createDataFrame([(10**17, 3 * 10**17, 5)], "count long, total long, size long")
    assert df.select(D.chance("count", "total", "size")).first()[0] == 1 + 10**9 * (10**17 + 2) // (3 * 10**17 + 10)


def test_no_terms_and_empty(spark):
    assert collected(D.audit(frame(spark, []))) == []
    rows = [("en", "a", "one"), ("en", "b", None)]
    assert collected(D.audit(frame(spark, rows))) == brute(rows, 10, 10) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
