"""Chains of patterns and instances, found over several rounds."""

from lattica.llm import pii

LEVELS = 5


def test_chain_of_rounds(spark):
    """Each pattern's new values support the next pattern alone, so the chain takes a round a level."""
    rows, spans = [], {}

    def add(text, value=None):
        rows.append((len(rows), text))
        if value is not None:
            spans[len(rows) - 1] = f"phone:{text.index(value)}:{text.index(value) + len(value)}"

    for k in range(24):
        add(f"please dial alpha line +1 (555) 123-45{10 + k} ends", f"+1 (555) 123-45{10 + k}")
    before = ["alpha line", "bravo line", "carol line", "delta line", "ember line"]
    for level in range(LEVELS):
        for j in range(3):
            value = f"77{level}-12{j}4"
            add(f"so the {before[level]} {value}, and more", value)
            for _ in range(8 if level + 1 < LEVELS else 0):
                add(f"on the {before[level + 1]} {value} again", value)
    add("770-1204 stands first", "770-1204")
    add("zebra code 999-1234 stays")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert got == {i: spans.get(i, "") for i, _ in rows}
