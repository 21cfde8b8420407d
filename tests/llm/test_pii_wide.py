"""Personal data in wider forms than the base patterns."""

import pytest

from fotolith.llm import pii

WIDE = ["write to jo (at) site (dot) com today", "ring (555) 123-4567 tonight", "paid with 4111.1111.1111.1111 here", "paid with 5500/0000/0000/0004 here"]
CLEAN = ["order 123456789 of 2020-2021 2022", "book 978-3-16-148410-0", "see you @ noon. Then we go", "sum 5 @ 3.20", "part 4111.1111.1111.1112", "on 2024/01/15 12.30.45", "999.1.2.3.4"]
BASE = ["jo@site.com", "+1 (555) 123-4567", "4111 1111 1111 1111", "10.0.0.1"]


@pytest.mark.parametrize("texts", [WIDE + CLEAN, WIDE + CLEAN + BASE * 5, (WIDE + CLEAN) * 20])
def test_wide_forms_are_redacted(docs_of, texts):
    docs = docs_of(texts)
    model = pii.fit(docs)
    got = {r.doc_id: r.text for r in pii.redact(docs, model=model).collect()}
    assert [got[i] for i in range(len(WIDE))] == ["write to <EMAIL> today", "ring <PHONE> tonight", "paid with <CARD> here", "paid with <CARD> here"]
    assert [got[len(WIDE) + i] for i in range(len(CLEAN))] == CLEAN
    spans = {r.doc_id: r.spans for r in pii.report(docs, model=model).collect()}
    assert [spans[i] for i in range(3)] == ["email:9:31", "phone:5:19", "card:10:29"]
