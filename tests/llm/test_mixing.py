"""Mixing to target weights."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftlens.llm.mixing import exact_total, mix_documents, mix_report, water_fill, whole_total

NAMES = list("abcdef")


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(NAMES), st.integers(0, 10_000), max_size=6), st.lists(st.tuples(st.sampled_from(NAMES), st.floats(0, 1), st.integers(0, 4)), max_size=6, unique_by=lambda t: t[0]))
def test_water_fill(sizes, targets):
    shares = water_fill(sizes, targets, whole_total(sizes, targets))
    by = {s.source: s for s in shares}
    usable = [t for t in targets if t[1] > 0 and t[2] > 0 and sizes.get(t[0], 0) > 0]
    for s in shares:
        assert -1e-9 <= s.amount <= s.most * s.size + 1e-6
    total = sum(sizes[t[0]] for t in usable)
    most = sum(sizes[t[0]] * t[2] for t in usable)
    assert sum(s.amount for s in shares) == pytest.approx(min(total, most), rel=1e-6, abs=1e-6)
    free = [by[t[0]] for t in usable if by[t[0]].amount < by[t[0]].most * by[t[0]].size * (1 - 1e-9)]
    for a in free:  # those below their maximum keep the proportions of their targets
        for b in free:
            assert a.amount * b.target == pytest.approx(b.amount * a.target, rel=1e-6, abs=1e-6)


def test_exact():
    sizes, targets = {"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.5, 1), ("gone", 0.2, 3)]
    total = exact_total(sizes, targets)
    shares = {s.source: s.amount for s in water_fill(sizes, targets)}
    assert total == 400 and shares == {"a": 200, "b": 200, "gone": 0}
    assert water_fill({}, []) == [] and exact_total({}, []) == 0.0 and water_fill({"a": 5}, [("a", None, None), (None, 1.0, 1)])[0].amount == 0


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.sampled_from(NAMES), st.integers(0, 10_000), max_size=6), st.lists(st.tuples(st.sampled_from(NAMES), st.floats(0.01, 1), st.integers(0, 4)), max_size=6, unique_by=lambda t: t[0]))
def test_exact_shares_meet_their_targets(sizes, targets):
    shares = [s for s in water_fill(sizes, targets) if s.most and s.size]
    weight, total = sum(s.target for s in shares), sum(s.amount for s in shares)
    for s in shares:
        assert total > 0 and s.amount / total == pytest.approx(s.target / weight, rel=1e-6) and s.amount <= s.most * s.size * (1 + 1e-9)
    assert not shares or any(s.amount >= s.most * s.size * (1 - 1e-9) for s in shares)  # no larger mix does


def test_mix(spark):
    tokens = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 50 = 1 then 'small' when id % 7 = 1 then null else 'mid' end as source", "case when id % 11 = 0 then 0 else 1 + id % 90 end as tokens").cache()
    sizes = {r.source: r.t for r in tokens.groupBy("source").sum("tokens").toDF("source", "t").collect() if r.source}
    shares = water_fill(sizes, [("hot", 0.3, 1), ("small", 0.3, 3), ("mid", 0.4, 2), ("gone", 0.1, 2)], sum(sizes.values()))
    mix = mix_documents(tokens, shares)
    rows = mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.tokens > 0 and r.source for r in rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in mix_documents(tokens.repartition(5), shares).collect()}
    assert {r.doc_id for r in rows} != {r.doc_id for r in mix_documents(tokens, shares, seed=9).collect()}
    for s in shares:
        got = sum(r.tokens * r.repeats for r in rows if r.source == s.source)
        assert abs(got - s.amount) <= 90 and all(r.repeats <= s.most for r in rows if r.source == s.source)
    report = {r.source: r for r in mix_report(mix, shares).collect()}
    assert report["gone"].actual_share == 0 and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert all(abs(r.actual_share - r.reachable_share) < 0.002 for r in report.values()) and report["small"].most_uses <= 3


def test_empty(spark):
    tokens = spark.createDataFrame([], "doc_id long, source string, tokens long")
    shares = water_fill({}, [("a", 1.0, 2)])
    assert mix_documents(tokens, shares).count() == 0
    assert [(r.source, r.actual_share, r.docs) for r in mix_report(mix_documents(tokens, shares), shares).collect()] == [("a", 0.0, 0)]
