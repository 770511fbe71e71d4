"""Lines with combining marks, and lines above the limit that are too many to broadcast."""

import pytest

from inkglass.llm import line_rules, quotes

from . import brute

FILLER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_with_marks(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(line_rules, "fits", lambda *a: False)
    docs = []
    for i in range(60):
        lines = [f"{FILLER} {i}", "कि यह पंक्ति" if i < 30 else "की यह पंक्ति", "café noir" if i % 20 else "cafe noir", "***" if i % 2 else "--"]
        docs.append((i, "\n".join(lines), "h" if i % 3 else None))
    docs += [docs[4], (None, docs[5][1], "h"), (90, None, "h"), (91, "", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    for least in (10, 25):
        found = [tuple(r) for r in line_rules.judge(frame, least_docs=least, share=0.4).collect()]
        assert order(found) == order(brute.quality(docs, least, 0.4))
    # the two Hindi lines differ by a mark: neither reaches the limit that both together would
    kept = {r.doc_id: r.text for r in line_rules.apply_rules(frame.where("source IS NOT NULL"), least_docs=30, share=0.4).collect()}
    assert "कि यह पंक्ति" in kept[1] and "café noir" not in kept[1]


def test_quotes_with_marks(spark):
    rows = [(1, 0, "user", "कि"), (1, 1, "user", "की"), (1, 2, "assistant", "> की\nok")]
    found = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.quoted_conv, r.quoted_turn) for r in found.where("turn = 2").collect()] == [(1, 1)]
