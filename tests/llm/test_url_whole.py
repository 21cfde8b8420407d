"""The models read whole URLs."""

from fotolith.llm import url_filter


def test_query_and_fragment_are_scored(spark):
    rows = [(i, f"http://s{i}.{'org' if i % 2 else 'com'}/{'a' if i % 2 else 'de/a'}?{'id=ok' if i % 2 else 'casino-win'}{i}") for i in range(200)]
    rows += [(1000, "http://x.net/?casino-win"), (1001, "http://x.net/?id=ok"), (1002, "HTTP://X.net/?id=ok"), (1003, "http://x.net/#casino-win"), (1004, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1000].score < got[1001].score and (got[1000].verdict, got[1001].verdict) == ("block", "allow")
    assert got[1002].score == got[1001].score and got[1003].score < got[1001].score
    assert {(got[i].host, got[i].path) for i in (1000, 1001, 1002, 1003)} == {("x.net", "/")}
    assert got[1004].score == 0
