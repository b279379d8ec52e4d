"""Random small graphs: recursion and negation against plain Python."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from factspark import Ref, TripleSource, fact, same

EDGES = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=1, max_size=10)
FEW = settings(max_examples=4, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])


def closure(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


@FEW
@given(EDGES)
def test_closure_and_unreachable(spark, edges):
    db = TripleSource.create(spark, [("g/to", Ref(str(a)), Ref(str(b))) for a, b in edges])
    Edge = fact("g", to=object)
    Reach = fact(a=object, b=object).when(lambda v: {"one": [Edge(this=v.a, to=v.b)], "more": [Reach(a=v.a, b=v.m), Reach(a=v.m, b=v.b)]})
    want = closure(set(edges))
    assert {(int(r["a"]), int(r["b"])) for r in Reach().query(db).collect()} == want
    # pairs of starts without a path between them: negation over recursion
    Apart = fact(a=object, b=object).where(lambda v: [Edge(this=v.a, to=v.x), Edge(this=v.b, to=v.y), same.not_(v.a, v.b), Reach.not_(a=v.a, b=v.b)])
    starts = {a for a, _ in edges}
    assert {(int(r["a"]), int(r["b"])) for r in Apart().query(db).collect()} == {(a, b) for a in starts for b in starts if a != b and (a, b) not in want}
