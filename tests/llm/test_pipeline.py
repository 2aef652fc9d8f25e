"""The stages in turn against plain versions of their rules."""

import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as P
from candlewake.llm import line_quality as Q
from candlewake.llm import secret_scan as S
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_near_dedup import sets_of

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def clean(text):
    """The cleaned text, or None for a rejected one."""
    ws = words(text)
    tri = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {j for i in range(len(ws) - 2) if tri[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    if len(ws) < 50 or 100 * len(hit) > 50 * len(ws):
        return None
    left, n_left = [], 0
    for line in text.split("\n"):
        n = len(words(line))
        seps, syms = sum(line.count(c) for c in Q.SEPARATORS), sum(line.count(c) for c in Q.SYMBOLS)
        fails = n and (
            not re.search(Q.SENTENCE_END, line)
            or seps >= max(2, n * 0.25)
            or syms >= max(2, n * 0.3)
            or (line.upper() == line and line.lower() != line and n >= 4)
            or (n <= 25 and re.search(Q.BOILERPLATE, line))
        )
        if not fails:
            left.append(line)
            n_left += n
    return "\n".join(left) if n_left >= 0.7 * len(ws) else None


def redact(text):
    data, out, at = text.encode(), b"", 0
    spans = []
    for rule in S.RULES:
        for m in re.finditer((rule.core + (f"{rule.tail}*" if rule.tail else "")).encode(), data):
            if m.end() - m.start(rule.group) >= rule.least:
                spans.append(m.span())
    for a, b in sorted(spans):
        if a >= at:
            out += data[at:a] + b"[SECRET]"
        at = max(at, b)
    return (out + data[at:]).decode()


@pytest.fixture(scope="module")
def rows():
    return duckdb.execute(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


def test_the_run_equals_plain_rules(spark, rows):
    source = {d: s for d, _, s in rows}
    kept = {d: c for d, t, _ in rows if (c := clean(t)) is not None}
    comp = groups(list(kept.items()))
    kept = {d: t for d, t in kept.items() if comp[d][1] == d}
    items = [sets_of(t) for (t,) in duckdb.execute(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = {d: t for d, t in kept.items() if not any(100 * len(i & sets_of(t)) >= 75 * len(i) for i in items if i)}
    kept = {d: redact(t) for d, t in kept.items()}
    got = P.run(spark, SF).collect()
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    taken = Counter(r.doc_id for r in got)
    assert max(taken.values()) <= 2 and set(taken) <= set(kept)
    assert all(r.text == kept[r.doc_id] and r.n_chars == len(r.text) for r in got)
    size = {d: len(words(t)) for d, t in kept.items()}
    total = sum(size.values())
    assert sum(size[d] * n for d, n in taken.items()) == pytest.approx(1.5 * total, rel=0.05)
    # Targets by handing round the excess of full sources until there is none.
    by = Counter()
    for d, n in size.items():
        by[source[d]] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by))}
    target, free, rest = {}, set(by), 1.5 * total
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * by[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s], rest = 2 * by[s], rest - 2 * by[s]
            free.discard(s)
    got_by = Counter()
    for d, n in taken.items():
        got_by[source[d]] += size[d] * n
    for s in by:
        assert abs(got_by[s] - target[s]) <= 1.05 * max(size[d] for d in kept if source[d] == s)


def test_odd_rows_pass_all_stages(spark):
    text = " ".join(f"Word{i} goes on." for i in range(40))
    rows = [(1, text, "en", "a", 9), (1, text, "en", "a", 9), (2, None, None, None, None), (3, "", "en", None, 0),
            (None, text + " More.", None, None, 1), (5, text.upper(), "en", "b", 3), (6, "long " * 40000 + ".", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"n_words": P.F.lit(1), "id": P.F.lit("x"), "kept": P.F.lit(True)})
    for empty in (False, True):
        df = docs.limit(0) if empty else docs
        for _, apply in P.STAGES:
            df = apply(spark, df, SF)
            assert set(df.columns) == set(docs.columns)
        assert (df.count() == 0) == empty
